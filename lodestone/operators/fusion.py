"""Fusing, re-ranking and selecting rankings."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions import text as X

# Words that make a question a comparison.
COMPARISON_MARKERS = ("比较", "对比", "区别", "差异", "不同", "相比", "compare", "comparison", "difference", "versus", " vs ")


def rrf(rankings: DataFrame, k: int = 60, candidates: int | None = 20, top: int | None = None, by: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Reciprocal rank fusion: score = sum of 1 / (k + rank) (12 places), best_rank, rank.

    rankings: the keys, chunk_id and rank of any number of backends, one below the other. Ties go to the better single rank, then
    to the smaller chunk_id.
    """
    used = rankings if candidates is None else rankings.where(F.col("rank") <= candidates)
    fused = used.groupBy(*by, "chunk_id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best_rank"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "best_rank", "chunk_id")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def payload_conflicts(rankings: DataFrame, payload: str = "payload_hash") -> DataFrame:
    """Chunks that backends return with different payloads; fusing them is an error."""
    return rankings.groupBy("question_id", "chunk_id").agg(F.count_distinct(payload).alias("n_payloads")).where("n_payloads > 1")


def route_rrf(hits: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """RRF over one ranking a route (document) and backend, ranked anew within each; hits: question_id, route, backend, chunk_id, score."""
    own = Window.partitionBy("question_id", "route", "backend").orderBy(F.desc("score"), "chunk_id")
    return rrf(hits.withColumn("rank", F.row_number().over(own)), k, None, top)


def score_pairs(pairs: DataFrame, scorer, left: str, right: str, batch: int = 16) -> DataFrame:
    """Adds pair_score by scorer(list of (left, right)) -> list of numbers, and pair_error where there is none.

    A pair with a null side is TITLE_OR_TEMPLATE_UNAVAILABLE; a scorer that raises is MODEL_SCORING_UNAVAILABLE for its batch; a wrong number
    of scores, or one that is no finite number, is MODEL_SCORE_INVALID for its batch.
    """

    def scored(some: list[tuple]) -> tuple[list, list]:
        if any(x is None for p in some for x in p):
            return [None] * len(some), ["TITLE_OR_TEMPLATE_UNAVAILABLE"] * len(some)
        try:
            got = list(scorer(some))
        except Exception:  # noqa: BLE001  a scorer is foreign code; its failure is a result here
            return [None] * len(some), ["MODEL_SCORING_UNAVAILABLE"] * len(some)
        if len(got) != len(some) or not all(isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) for x in got):
            return [None] * len(some), ["MODEL_SCORE_INVALID"] * len(some)
        return [float(x) for x in got], [None] * len(some)

    def run(it):
        for part in it:
            both = list(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in (left, right)), strict=True))
            scores: list = []
            errors: list = []
            for at in range(0, len(both), batch):
                a, b = scored(both[at : at + batch])
                scores += a
                errors += b
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(errors, pa.string())], names=[*part.schema.names, "pair_score", "pair_error"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("pair_score", T.DoubleType()), T.StructField("pair_error", T.StringType())]))


def rerank(candidates: DataFrame, top: int, score: str = "pair_score", depth: int = 20) -> DataFrame:
    """Order by score, then former rank; questions with an invalid score among their candidates keep the former order.

    Adds status APPLIED or FALLBACK and failure_code (the first in order of pair_error, where candidates have it), and replaces rank;
    former_rank keeps the old one.
    """
    used = candidates.where(F.col("rank") <= depth)
    group = Window.partitionBy("question_id")
    bad = F.max(F.when(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 1).otherwise(0)).over(group)
    code = F.lit("MODEL_SCORE_INVALID")
    if "pair_error" in candidates.columns:
        for name in ("MODEL_SCORING_UNAVAILABLE", "TITLE_OR_TEMPLATE_UNAVAILABLE"):
            code = F.when(F.max(F.when(F.col("pair_error") == name, 1).otherwise(0)).over(group) == 1, name).otherwise(code)
    marked = used.withColumn("_bad", bad == 1).withColumn("failure_code", F.when(F.col("_bad"), code)).withColumn("status", F.when(F.col("_bad"), "FALLBACK").otherwise("APPLIED"))
    order = group.orderBy(F.desc(F.when(~F.col("_bad"), F.col(score))), "rank")
    return marked.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top).drop("_bad").withColumnRenamed("rank", "former_rank").withColumnRenamed("new_rank", "rank")


def coverage(candidates: DataFrame, top: int = 3, question: str = "question", enabled: bool = True) -> DataFrame:
    """Selection for two-document comparisons: the best candidate of each route, then the best others, in their former order.

    candidates: question_id, question, requested_routes (array), route, chunk_id, rank. Adds status APPLIED, FALLBACK or DISABLED and
    failure_code, the first precondition that fails; unless APPLIED, the first `top` candidates stay.
    """
    group = Window.partitionBy("question_id")
    routes = F.col("requested_routes")
    n = F.count(F.lit(1)).over(group)
    unknown = F.max(F.when(F.array_contains(routes, F.col("route")), 0).otherwise(1)).over(group)
    present = F.size(F.collect_set("route").over(group))
    code = F.lit("SWITCH_DISABLED") if not enabled else (
        F.when((F.size(routes) != 2) | (F.size(F.array_distinct(routes)) != 2), "ROUTE_COUNT_NOT_TWO").when(F.lit(top != 3), "FINAL_TOP_K_NOT_THREE").when(~X.has_any(F.lower(question), COMPARISON_MARKERS), "COMPARISON_NOT_PROVEN")
        .when(n < top, "CANDIDATE_COUNT_INSUFFICIENT").when(unknown == 1, "CANDIDATE_ROUTE_OUTSIDE_SCOPE").when(present < 2, "ROUTE_CANDIDATE_UNAVAILABLE")
    )
    first = F.row_number().over(Window.partitionBy("question_id", "route").orderBy("rank")) == 1
    marked = candidates.withColumn("failure_code", code).withColumn("_first", first)
    marked = marked.withColumn("status", F.when(F.col("failure_code").isNull(), "APPLIED").when(F.col("failure_code") == "SWITCH_DISABLED", "DISABLED").otherwise("FALLBACK"))
    place = F.row_number().over(group.orderBy(F.when((F.col("status") == "APPLIED") & F.col("_first"), 0).otherwise(1), "rank"))
    kept = marked.withColumn("_place", place).where(F.col("_place") <= top)
    return kept.withColumn("new_rank", F.row_number().over(group.orderBy("rank"))).drop("_first", "_place").withColumnRenamed("rank", "former_rank").withColumnRenamed("new_rank", "rank")


def apply_selection(ranking: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected chunks of each question in the ranking's order, ranked from 1; a selection outside the ranking is an error to check with selection_errors."""
    kept = ranking.join(selection.select("question_id", "chunk_id").distinct(), ["question_id", "chunk_id"], "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def selection_errors(ranking: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected chunks that the ranking doesn't hold or that are selected twice."""
    foreign = selection.join(ranking, ["question_id", "chunk_id"], "left_anti").select("question_id", "chunk_id", F.lit("FOREIGN").alias("code"))
    twice = selection.groupBy("question_id", "chunk_id").count().where("count > 1").select("question_id", "chunk_id", F.lit("REPEATED").alias("code"))
    return foreign.union(twice)


def decisions(questions: DataFrame, ranking: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """question_id, n_candidates, decision: FORBIDDEN, EVIDENCE_FOUND or NO_EVIDENCE for every question."""
    counted = ranking.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    out = questions.select("question_id").join(counted, "question_id", "left")
    refused: Column = F.lit(False)
    if forbidden is not None:
        out = out.join(forbidden.select("question_id", F.lit(True).alias("_f")).distinct(), "question_id", "left")
        refused = F.coalesce(F.col("_f"), F.lit(False))
    n = F.when(refused, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return out.select("question_id", n.alias("n_candidates"), F.when(refused, "FORBIDDEN").when(n > 0, "EVIDENCE_FOUND").otherwise("NO_EVIDENCE").alias("decision"))
