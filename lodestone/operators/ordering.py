"""Numbers, running sums and order statistics over all rows without one task that holds them all.

`keep(df)` writes a frame once on shared storage and gives it back; by default a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts into which a pass of order_statistics cuts each group's remaining range.
BUCKETS = 1024


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint()


def _ranged(df: DataFrame, order: list[Column | str], keep) -> DataFrame:
    """The rows in partitions by range of the order, `_part` naming each row's; written, so that every reader sees the same parts."""
    return keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _before(parts: DataFrame, value: Column) -> DataFrame:
    """_part, _before: the sum of all earlier partitions, from one row a partition."""
    sums = parts.groupBy("_part").agg(value.alias("n")).orderBy("_part").collect()
    rows, so_far = [], 0
    for r in sums:
        rows.append((r["_part"], so_far))
        so_far += r["n"] or 0
    return F.broadcast(parts.sparkSession.createDataFrame(rows, "_part int, _before long"))


def numbered(df: DataFrame, order: list[Column | str], name: str = "position", start: int = 0, keep=_kept) -> DataFrame:
    """Adds each row's place in the order of all rows. The order must be total, or equal rows get any of their places.

    Rows are dealt out by range of the order and numbered within each range; what each range adds is a prefix sum of their counts, one row a range.
    """
    parts = _ranged(df, order, keep)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + start
    return parts.join(_before(parts, F.count(F.lit(1))), "_part").withColumn(name, (place + F.col("_before")).cast("long")).drop("_part", "_before")


def running_sum(df: DataFrame, value: Column, order: list[Column | str], name: str, keep=_kept) -> DataFrame:
    """Adds the sum of a whole-number value over this row and all before it in a total order."""
    parts = _ranged(df.withColumn(name, value.cast("long")), order, keep)
    own = F.sum(name).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(_before(parts, F.sum(name)), "_part").withColumn(name, (F.coalesce(own, F.lit(0)) + F.col("_before")).cast("long")).drop("_part", "_before")


def order_statistics(df: DataFrame, by: list[str], value: str, wanted, keep=_kept) -> DataFrame:
    """by, k, value of each group's k-th smallest value (k from 0) for the k that wanted(n), an array column of the group's count, asks for.

    Each pass counts the values that are left by equal parts of their range and goes on within the part that holds the rank, until that
    holds one value. A group of any size costs some passes and at most 1,024 rows a rank and pass; nothing sorts or collects it. Nulls and
    NaN are no values; a group without any has no row.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = keep(ends.select(*by, F.explode(F.array_distinct(wanted(F.col("n")))).alias("k"), F.lit(0).cast("long").alias("before"), "lo", "hi"))
    done = None
    while True:
        settled = state.where("lo = hi").select(*by, "k", F.col("lo").alias("value"))
        done = settled if done is None else done.unionByName(settled)
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            return done
        mine = rows.join(open_, by) if by else rows.crossJoin(F.broadcast(open_))  # a row a rank asked for
        # halves, as the width of a range may exceed the largest double
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        counted = mine.where("_v between lo and hi").groupBy(*by, "k", "before", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by, "k").orderBy("bucket"))
        placed = counted.withColumn("upto", F.col("before") + upto)
        inside = placed.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
        state = keep(inside.select(*by, "k", (F.col("upto") - F.col("n")).alias("before"), "lo", "hi"))


def percentiles(df: DataFrame, by: list[str], value: str, asked: dict[str, float], keep=_kept) -> DataFrame:
    """by, n and for each name the exact percentile, linear between neighbours at (n - 1) * p, by order_statistics."""
    low = lambda n, p: F.floor((n - 1) * F.lit(p)).cast("long")
    high = lambda n, p: F.ceil((n - 1) * F.lit(p)).cast("long")
    found = order_statistics(df, by, value, lambda n: F.array(*[f(n, p) for p in asked.values() for f in (low, high)]), keep)
    n = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    held = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("_at"))  # two entries a percentile at most
    both = n.join(held, by) if by else n.crossJoin(F.broadcast(held))  # one row each

    def of(p: float) -> Column:
        a, b, place = F.element_at("_at", low(F.col("n"), p)), F.element_at("_at", high(F.col("n"), p)), (F.col("n") - 1) * F.lit(p)
        return a + (b - a) * (place - F.floor(place))

    return both.select(*by, "n", *[of(p).alias(name) for name, p in asked.items()])
