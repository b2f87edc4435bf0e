"""Counts, percentiles, digests and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interpolated_percentile(value, p: float) -> Column:
    """Exact percentile, linear between neighbours at (n - 1) * p."""
    return F.percentile(value, F.lit(p))


def nearest_rank_percentile(value: str, p: float) -> Column:
    """The value at place ceil(n * p) of the sorted values: another percentile than the interpolated one."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def scoped_counts(rows: DataFrame, columns: list[str], owner, ended: tuple[str, ...] = ("SUCCEEDED", "FAILED"), owner_col: str = "owner_id", status_col: str = "status") -> DataFrame:
    """reach, columns, n: an owner's rows (OWNER) and all rows that haven't ended (GLOBAL_OPEN), counted alike."""
    mine = status_counts(rows.where(F.col(owner_col) == owner), columns).select(F.lit("OWNER").alias("reach"), *columns, "n")
    return mine.union(status_counts(rows.where(~F.col(status_col).isin(*ended)), columns).select(F.lit("GLOBAL_OPEN").alias("reach"), *columns, "n"))


def status_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def length_summary(chunks: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    n = F.length(text_col)
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(n).cast("long").alias("min_chars"), F.percentile(n, F.lit(0.5)).alias("median_chars"), F.round(F.avg(n), 6).alias("mean_chars"), nearest_rank_percentile(f"length({text_col})", 0.95).cast("long").alias("p95_chars"), F.max(n).cast("long").alias("max_chars"))


def document_summary(chunks: DataFrame, by: str = "document_id") -> DataFrame:
    """Per document: n_chunks, pages, sorted versions and a digest of its (chunk_id, text) in order."""
    body = F.array_sort(F.collect_list(F.struct("chunk_id", F.sha2("text", 256).alias("h"))))
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks"), F.min("page_start").cast("long").alias("page_start"), F.max("page_end").cast("long").alias("page_end"), F.array_join(F.sort_array(F.collect_set("version_id")), ",").alias("versions"), F.sha2(F.array_join(F.transform(body, lambda x: F.concat(x["chunk_id"], F.lit(":"), x["h"])), "\n"), 256).alias("digest"))


def category_summary(cases: DataFrame, categories: DataFrame, category: str = "category", passed: str = "passed") -> DataFrame:
    """category, total, passed with every category of the dimension, absent ones as 0."""
    have = cases.groupBy(category).agg(F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("passed"))
    return categories.join(have, category, "left").select(category, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("passed", F.lit(0)).alias("passed"))


def distribution(df: DataFrame, column: str, many: bool = False) -> DataFrame:
    value = F.explode(column) if many else F.col(column)
    rows = df.select(value.alias("value"))
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def usage_totals(df: DataFrame, column: str) -> DataFrame:
    """key, total of a map column's values over all rows."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def rank_concat(df: DataFrame, by: str, rank: str, text: str, separator: str = " ") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    return df.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias("joined"))


def last_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Of rows with one key the one of the last frame that has it; keys of later frames unknown to the first are errors to check with unknown_keys."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_file", F.lit(i))
        out = f if out is None else out.unionByName(f)
    columns = [c for c in frames[0].columns if c != key]
    return out.groupBy(key).agg(F.max_by(F.struct(*columns), "_file").alias("_r")).select(key, "_r.*")


def unknown_keys(frames: list[DataFrame], key: str) -> DataFrame:
    later = frames[1].select(key)
    for f in frames[2:]:
        later = later.union(f.select(key))
    return later.distinct().join(frames[0], key, "left_anti")


def ordered_fingerprint(df: DataFrame, position: str, columns: list[str], block: int = 1000) -> DataFrame:
    """One row: n and a digest of the rows in order of an integer position; digests of blocks first, so that no group grows with the data but the list of blocks."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = df.select(F.col(position).alias("p"), row.alias("h")).groupBy(F.floor(F.col("p") / block).alias("b"))
    blocks = parts.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
    return blocks.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))
