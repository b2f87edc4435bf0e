"""Invariants as queries: each returns its violations as (rule, key, detail), none where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import intervals as binned


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; a rule that comes out null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def require_none(found: DataFrame, what: str) -> None:
    """Fail closed: an error if there is any violation."""
    if first := found.head():
        raise ValueError(f"{what}: {first.asDict()}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ranking_errors(ranking: DataFrame, top_k: int, by: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """keys, code: ranks with gaps, repeated chunks, too many candidates, scores that aren't finite."""
    df = ranking.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("top"), F.min("rank").alias("low"), F.count_distinct("rank").alias("ranks"), F.count_distinct("chunk_id").alias("chunks"), F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("bad"))
    code = F.array_compact(F.array(F.when((F.col("low") != 1) | (F.col("top") != F.col("n")) | (F.col("ranks") != F.col("n")), "RANKS_NOT_CONTIGUOUS"), F.when(F.col("chunks") != F.col("n"), "CHUNK_REPEATED"), F.when(F.col("n") > top_k, "TOO_MANY"), F.when(F.col("bad") > 0, "SCORE_NOT_FINITE")))
    return df.select(*by, F.explode(code).alias("code"))


def link_errors(chunks: DataFrame) -> DataFrame:
    """Chunks whose previous or next link isn't answered by the other chunk."""
    back = chunks.select(F.col("chunk_id").alias("to"), F.col("previous_chunk_id").alias("answer"))
    forth = chunks.select(F.col("chunk_id").alias("to"), F.col("next_chunk_id").alias("answer"))
    a = chunks.where("next_chunk_id is not null").join(back, F.col("next_chunk_id") == F.col("to"), "left").where(~F.col("answer").eqNullSafe(F.col("chunk_id"))).select("chunk_id", F.lit("NEXT").alias("side"))
    b = chunks.where("previous_chunk_id is not null").join(forth, F.col("previous_chunk_id") == F.col("to"), "left").where(~F.col("answer").eqNullSafe(F.col("chunk_id"))).select("chunk_id", F.lit("PREVIOUS").alias("side"))
    return a.union(b)


def item_errors(items: DataFrame) -> DataFrame:
    """rule, key of evaluation items: question_id, answerability, split, blind_holdout, expected_citations, chunk_judgments, reference_claims."""
    supported = F.transform(F.filter("chunk_judgments", lambda j: j["relevance"] >= 2), lambda j: j["chunk_id"])
    refusal = F.col("answerability").isin("NO_EVIDENCE", "FORBIDDEN")
    return violations(
        items,
        "question_id",
        {
            "CITATIONS_NOT_SUPPORTED": F.size(F.array_except("expected_citations", supported)) == 0,
            "ANSWERABLE_WITHOUT_SUPPORT": refusal | (F.size(supported) > 0),
            "REFUSAL_WITH_SUPPORT": ~refusal | ((F.size(supported) == 0) & (F.size("reference_claims") == 0)),
            "ACCEPTANCE_NOT_BLIND": (F.col("split") != "acceptance") | F.col("blind_holdout"),
        },
    )


def version_errors(versions: DataFrame) -> DataFrame:
    """rule, key of version rows: READY needs its times and both indexes and no failure; INACTIVE and end times go together; FAILED needs a code."""
    times = F.lit(True)
    for c in ("parsed_at", "embedded_at", "indexed_at", "verified_at", "ready_at"):
        times = times & F.col(c).isNotNull()
    ended = F.col("deleted_at").isNotNull() | F.col("expired_at").isNotNull()
    status = F.col("lifecycle_status")
    return violations(
        versions,
        "document_version_id",
        {
            "READY_INCOMPLETE": (status != "READY") | (times & (F.col("elasticsearch_state") == "READY") & (F.col("milvus_state") == "READY") & F.col("failure_code").isNull()),
            "INACTIVE_WITHOUT_END": (status == "INACTIVE") == ended,
            "FAILED_WITHOUT_CODE": (status != "FAILED") | F.col("failure_code").isNotNull(),
        },
    )


def job_errors(jobs: DataFrame) -> DataFrame:
    """rule, key of queue rows: RUNNING and lease go together, RETRY and FAILED need a code, ended jobs a time, attempts stay within their number."""
    status = F.col("status")
    lease = F.col("lease_token").isNotNull() & F.col("lease_expires_at").isNotNull()
    return violations(jobs, "job_id", {"LEASE": (status == "RUNNING") == lease, "CODE": status.isin("RETRY", "FAILED") == F.col("failure_code").isNotNull(), "COMPLETION": status.isin("SUCCEEDED", "FAILED") == F.col("completed_at").isNotNull(), "ATTEMPTS": F.col("attempt_count") <= F.col("max_attempts")})


def several_active(versions: DataFrame) -> DataFrame:
    """Documents of an owner with more than one active version."""
    return versions.where("is_active").groupBy("owner_id", "document_id").agg(F.count(F.lit(1)).alias("n_active")).where("n_active > 1")


def identity_changes(old: DataFrame, new: DataFrame, keys: list[str], fixed: list[str]) -> DataFrame:
    """Keys whose identity columns differ between two frames."""
    a, b = old.select(*keys, F.struct(*fixed).alias("_a")), new.select(*keys, F.struct(*fixed).alias("_b"))
    return a.join(b, keys).where("not (_a <=> _b)").select(*keys)


def contained_ranges(ranges: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Source page ranges (key, page_start, page_end) that lie in no accepted range of their key."""
    acc = accepted.select(key, F.col("page_start").alias("_a"), F.col("page_end").alias("_b"))
    asked = ranges.select(key, "page_start", "page_end").distinct()
    held = binned.overlapping(asked, acc, [key], ("page_start", "page_end"), ("_a", "_b"), 16, touching=True).where("_a <= page_start and _b >= page_end")
    return ranges.join(held.select(key, "page_start", "page_end").distinct(), [key, "page_start", "page_end"], "left_anti")


def containing(points: DataFrame, intervals: DataFrame, by: str, point: str = "offset", low: str = "low", high: str = "high") -> DataFrame:
    """Points with the interval of their key that holds them (low <= point < high); intervals of a key don't overlap, points outside all drop out."""
    return binned.containing(points, intervals, [by], point, low, high)


def numbered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def composite_match(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, status of each left row: MATCHED with the one right row of equal keys, MISSING or AMBIGUOUS (on either side)."""
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"), F.min(right_id).alias(right_id))
    mine = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    df = left.select(left_id, *keys).join(mine, keys).join(one, keys, "left")
    status = F.when(F.col("_r").isNull(), "MISSING").when((F.col("_r") > 1) | (F.col("_l") > 1), "AMBIGUOUS").otherwise("MATCHED")
    return df.select(left_id, F.when(status == "MATCHED", F.col(right_id)).alias(right_id), status.alias("status"))
