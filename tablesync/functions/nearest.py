"""Closest name among a short list, for "did you mean" hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: names this far apart, or farther, are no hint.
HINT_CUTOFF = 12


def nearest_name(wanted: Column, candidates: Sequence[str], cutoff: int = HINT_CUTOFF) -> Column:
    """``struct(distance, name)`` of the closest candidate below ``cutoff``, else NULL.

    The first candidate wins a tie. Candidates are the layers of one dataset,
    a list the driver already holds, so each row compares against an array
    literal and nothing is joined.
    """
    if not candidates:
        return F.lit(None).cast("struct<distance:int,name:string>")
    scored = F.array(
        *[
            F.struct(
                F.levenshtein(wanted, F.lit(name)).alias("distance"),
                F.lit(position).alias("position"),
                F.lit(name).alias("name"),
            )
            for position, name in enumerate(candidates)
        ]
    )
    best = F.array_min(scored)
    return F.when(
        best["distance"] < cutoff, F.struct(best["distance"].alias("distance"), best["name"].alias("name"))
    )
