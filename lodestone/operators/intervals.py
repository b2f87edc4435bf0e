"""Joins of intervals by bins: each interval meets those of its key in the bins that it covers, not all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places a bin by default: some of the spans that text is cut into.
WIDTH = 4096


def _binned(rows: DataFrame, low: Column, high: Column, width: int, first: str) -> DataFrame:
    """Each row once for every bin that [low, high) touches; an empty interval lies in the bin of its place. first: the bin where it begins."""
    begin = F.floor(low / width)
    end = F.greatest(F.floor((high - 1) / width), begin)
    return rows.withColumn(first, begin).withColumn("_bin", F.explode(F.sequence(begin, end)))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = WIDTH, touching: bool = False) -> DataFrame:
    """Pairs of rows of one key whose intervals overlap: left low < right high and right low < left high (<= if touching: closed ends).

    Both sides are dealt out by key and bin, so a key with very many intervals is spread over its bins; a pair that shares several bins
    is given in the one where the later of both begins. Column names of both sides, keys aside, must differ. Nulls overlap nothing.
    """
    (a, b), (c, d) = left_span, right_span
    closed = 1 if touching else 0
    one = _binned(left.where(f"{a} is not null and {b} is not null"), F.col(a), F.col(b) + closed, width, "_left")
    two = _binned(right.where(f"{c} is not null and {d} is not null"), F.col(c), F.col(d) + closed, width, "_right")
    meet = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) if not touching else (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b))
    return one.join(two, [*by, "_bin"]).where(meet & (F.col("_bin") == F.greatest("_left", "_right"))).drop("_bin", "_left", "_right")


def containing(points: DataFrame, intervals: DataFrame, by: list[str], point: str, low: str, high: str, width: int = WIDTH) -> DataFrame:
    """Points with each interval of their key that holds them (low <= point < high); a point lies in one bin."""
    one = points.withColumn("_bin", F.floor(F.col(point) / width))
    two = _binned(intervals.where(F.col(low) < F.col(high)), F.col(low), F.col(high), width, "_right")
    return one.join(two, [*by, "_bin"]).where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop("_bin", "_right")
