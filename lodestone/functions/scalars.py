"""Numeric, time and identity functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def backoff_seconds(attempt: Column, base: int = 30, cap: int = 3600) -> Column:
    """base * 2^(attempt - 1), at most cap."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(cap)))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return (ts.cast("double") + seconds).cast("timestamp")


def dcg_gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def round6(value: Column) -> Column:
    """Half-even rounding to six places."""
    return F.bround(value, 6)


def relative_gain(candidate: Column, baseline: Column) -> Column:
    """(candidate - baseline) / baseline; from a baseline of 0 it is 0 or infinite."""
    return F.when(baseline == 0, F.when(candidate == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise((candidate - baseline) / baseline)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def first_argmax(values: Column, names: tuple[str, ...]) -> Column:
    """Name of the largest value, of equal ones the first."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(values, F.array_max(values)).cast("int"))


def stable_key(seed: str, *parts: Column) -> Column:
    """SHA-256 of seed and parts joined by colons: an order for reproducible samples."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def short_id(prefix: str, text: Column, length: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def iso_date(text: Column) -> Column:
    """The date of `year-month-day` in digits; null for any other text and for days that don't exist."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "y-M-d"))


def has_zone(text: Column) -> Column:
    """Whether a time in ISO form names its zone, as Z or an offset."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))


def enum_place(value: Column, names: tuple[str, ...]) -> Column:
    """Place of a value among the names, from 1; values that aren't named come last."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(place > 0, place).otherwise(F.lit(len(names) + 1))


def is_contract_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"), F.lit(False))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[a-f0-9]{64}$"), F.lit(False))
