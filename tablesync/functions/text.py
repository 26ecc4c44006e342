"""Text helpers as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesync.spec import FALSE_WORDS, TRUE_WORDS

# Characters trimmed by default and around quoted words.
BLANKS = " \t\r\n"
QUOTES_AND_BLANKS = "'\"\r\n\t "


def trim_chars(col: Column, chars: str = BLANKS, keep_blank: bool = False) -> Column:
    """Strip ``chars`` from both ends.

    ``keep_blank`` leaves a text made only of those characters as it is.
    """
    trimmed = F.btrim(col, F.lit(chars))
    return F.when(trimmed == "", col).otherwise(trimmed) if keep_blank else trimmed


def split_on(col: Column, separator: str) -> Column:
    """Split on one literal character, keeping empty parts."""
    return F.split(col, rf"\Q{separator}\E", -1)


def join_with(col: Column, separator: str) -> Column:
    return F.array_join(col, separator)


def replace_all(col: Column, needle: str, replacement: str) -> Column:
    """Replace every occurrence, left to right; an empty needle changes nothing."""
    return F.replace(col, F.lit(needle), F.lit(replacement)) if needle else col


def lower_name(col: Column) -> Column:
    return F.lower(col)


def edit_distance(left: Column, right: Column) -> Column:
    return F.levenshtein(left, right)


def bool_from_words(col: Column) -> Column:
    """Yes/no words to boolean; any other text gives NULL."""
    word = F.lower(F.btrim(col, F.lit(QUOTES_AND_BLANKS)))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def fixed_point(col: Column, digits: int = 6) -> Column:
    """Decimal text of a double with a fixed number of digits (ties away from zero)."""
    return F.format_string(f"%.{digits}f", col)


def double_text(col: Column) -> Column:
    """Shortest text of a double that reads back equal, without ``.0`` or exponents
    for magnitudes a table usually holds."""
    shortest = col.cast("string")
    size = F.abs(col)
    digits = F.rtrim(F.rtrim(shortest.try_cast("decimal(38,20)").cast("string"), F.lit("0")), F.lit("."))
    return (
        F.when(col == 0, F.lit("0"))
        .when((size >= 1e-3) & (size < 1e7), F.regexp_replace(shortest, r"\.0$", ""))
        .when((size >= 1e-4) & (size < 1e15), digits)
        .otherwise(shortest)
    )


def date_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def time_text(col: Column) -> Column:
    return F.date_format(col, "HH:mm:ss")


def timestamp_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")


def utc_instant_text(col: Column) -> Column:
    """Second-resolution UTC text; the column already holds UTC wall time."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def array_literal(col: Column) -> Column:
    """``{a,b}`` for numeric lists, ``{"a","b"}`` with escapes for text lists."""
    return F.concat(F.lit("{"), F.array_join(col.cast("array<string>"), ","), F.lit("}"))


def text_array_literal(col: Column) -> Column:
    quoted = F.transform(
        col,
        lambda item: F.concat(
            F.lit('"'),
            F.replace(F.replace(item, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
            F.lit('"'),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def attribute_sets_from_json(col: Column) -> Column:
    """JSON list of objects to ``array<map<string,string>>`` without empty objects."""
    parsed = F.from_json(col, "array<map<string,string>>")
    return F.filter(parsed, lambda attributes: F.size(attributes) > 0)
