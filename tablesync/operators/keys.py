"""Key joins, duplicate keys and SQL ``NOT IN`` compatibility."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


RIGHT = "_r_"


def right_side(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The right side of a join under names that cannot clash with the left's,
    also when both sides derive from the same rows."""
    return df.select(*[F.col(f"`{c}`").alias(RIGHT + c) for c in (columns or df.columns)])


def left(name: str) -> Column:
    return F.col(f"`{name}`")


def right(name: str) -> Column:
    return F.col(f"`{RIGHT}{name}`")


def key_condition(keys: Sequence[str], null_safe: bool = True) -> Column:
    """Equality on every key column with a :func:`right_side`; an equi-join also when null-safe.

    Keys of a stored primary key hold no NULLs, so they use plain equality,
    which can also reuse the bucketing of the target.
    """
    return reduce(and_, (left(k).eqNullSafe(right(k)) if null_safe else left(k) == right(k) for k in keys))


def any_null(keys: Sequence[str]) -> Column:
    return reduce(or_, (F.col(f"`{k}`").isNull() for k in keys))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows.

    Counts are combined on the map side, so a key shared by most rows sends
    one row per input task.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def one_row_per_key(df: DataFrame, keys: Sequence[str], order_by: str | None = None) -> DataFrame:
    """Keep one row per key: the one with the highest ``order_by``.

    Ties, and a missing ``order_by``, are settled by the remaining columns, so
    the choice does not depend on row order. The rank limit is applied before
    the shuffle as well, which bounds what a hot key sends.
    """
    rest = [f.name for f in df.schema.fields if f.name not in (*keys, order_by) and _sortable(f.dataType)]
    first = [F.desc_nulls_last(order_by)] if order_by else []
    window = Window.partitionBy(*keys).orderBy(*first, *[F.desc_nulls_last(f"`{c}`") for c in rest], *keys)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def _sortable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _sortable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_sortable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def _null_mask(keys: Sequence[str]) -> Column:
    bits = [F.when(F.col(f"`{k}`").isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)]
    return reduce(lambda a, b: a + b, bits)


def _masks_of(df: DataFrame, keys: Sequence[str]) -> Column:
    """The NULL patterns that occur, found when the query runs: at most 2^len(keys) numbers."""
    return df.agg(F.collect_set(_null_mask(keys))).scalar()


def _common_part(keys: Sequence[str], mine: Column, theirs: Column) -> Column:
    """Both patterns and the values of the columns known in both; NULLs in a struct are equal."""
    hidden = mine.bitwiseOR(theirs)
    shown = [F.when(hidden.bitwiseAND(F.lit(1 << i)) == 0, left(k)).alias(f"k{i}") for i, k in enumerate(keys)]
    return F.struct(mine.alias("mine"), theirs.alias("theirs"), *shown)


#: Shares that the rows of one cut are dealt in, where only some of the columns are known in both.
SHARES = 16


def flag_not_in_blocked(
    df: DataFrame, others: DataFrame, keys: Sequence[str], flag: str = "_blocked", same_keys: DataFrame | None = None
) -> DataFrame:
    """Mark rows for which SQL ``keys NOT IN (others)`` is not true.

    A row is blocked by any other key that is equal on all columns where both are known. Each
    key of a side is cut down, for every NULL pattern that occurs on the other side, to the columns
    known in both; equal cuts then meet in one equi-join, however many key columns there are. What
    is cut on the other side is made distinct before it is shuffled. ``same_keys`` has the keys
    of ``df`` where that is cheaper to read.

    Where two patterns leave no column known in both, any two keys of them match: that takes no
    join, and such rows are dealt by their values. Where some columns are left, a cut may be that of
    most rows: they are dealt in :data:`SHARES`, and the different cuts go to each.
    """
    rows = df if same_keys is None else same_keys
    own = _null_mask(keys)
    hidden, none_known = F.col("_m").bitwiseOR(own), (1 << len(keys)) - 1
    theirs = others.select(*keys, F.explode(_masks_of(rows, keys)).alias("_m")).filter(hidden != none_known)
    cuts = theirs.select(_common_part(keys, F.col("_m"), own).alias("_cut"), (hidden != 0).alias("_partly")).distinct()
    shares = F.when(F.col("_partly"), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    cuts = cuts.select("_cut", F.explode(shares).alias("_share"))
    mine = rows.select(*keys, F.explode(_masks_of(others, keys)).alias("_m")).filter(hidden != none_known)
    share = F.when(hidden != 0, F.pmod(F.xxhash64(*[left(k) for k in keys]), F.lit(SHARES))).otherwise(F.lit(0)).cast("int")
    mine = mine.select(_key_struct(keys).alias("_key"), _common_part(keys, own, F.col("_m")).alias("_cut"), share.alias("_share"))
    blocked = mine.join(cuts, ["_cut", "_share"], "left_semi").select("_key").distinct().withColumn(flag, F.lit(True))
    any_key = F.exists("_theirs", lambda m: m.bitwiseOR(own) == none_known)
    flagged = df.withColumn("_theirs", _masks_of(others, keys)).withColumn("_any", any_key).drop("_theirs")
    # A row without any known column has no partner here, so it may go anywhere; partners have no place.
    place = F.when(own == none_known, F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _sortable(f.dataType)]))
    wanted = F.struct(F.col("_key").alias("key"), F.lit(None).cast("long").alias("place"))
    joined = flagged.join(blocked, F.struct(_key_struct(keys).alias("key"), place.alias("place")) == wanted, "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_any") | F.coalesce(F.col(flag), F.lit(False))).alias(flag))


def _key_struct(keys: Sequence[str]) -> Column:
    return F.struct(*[left(k).alias(f"k{i}") for i, k in enumerate(keys)])


# --- rows counted where they are joined ---------------------------------------------

NTH = "_nth"


def numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows numbered within their key, in no particular order.

    The window needs the rows by key, as a sorted join by the same key does: it
    adds neither an exchange nor a sort there, and keeps no rows back.
    """
    window = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*[F.col(f"`{k}`") for k in keys])
    return df.withColumn(NTH, F.row_number().over(window))
