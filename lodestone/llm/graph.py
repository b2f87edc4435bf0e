"""Connected components of a link table, distributed and by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: a row for each node that has a link; nodes have equal roots if and only if links connect them.

    In each round every node steps to the neighbour (or stays) that comes first in an order drawn anew by hashing, and the links
    are redrawn between the steps' ends, without loops and repeats. The order being random, the nodes left shrink by a constant
    factor a round, on long chains too. Rounds end when no link is left; then the steps are put together from the last back to the
    first. Each round loses at least one node of every component left, so rounds end. Every table is written to the shared folder, so lineage stays short. Nulls and loops don't link; repeated links are one.
    """
    spark = links.sparkSession
    kind = dict(links.dtypes)[a]
    both = links.where(f"{a} <> {b}").select(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        salt = F.lit(len(steps))
        ends = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("node", "next")
        order = lambda c: F.struct(F.xxhash64(salt, F.col(c)).alias("h"), F.col(c).alias("id"))
        first = ends.groupBy("node").agg(F.min(order("next")).alias("near"))
        step = cut(first.select("node", F.least(order("node"), "near").getField("id").alias("root")), "steps")
        steps.append(step)
        one = edges.join(step.toDF("a", "ra"), "a").select("ra", "b")
        two = one.join(step.toDF("b", "rb"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = cut(two.distinct(), "links")
    if not steps:
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    total = steps.pop()
    while steps:
        step = steps.pop()
        total = step.join(total.toDF("root", "end"), "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return cut(total, "components")
