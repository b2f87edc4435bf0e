"""Evaluation items: their texts, classes, review risks, cases, and candidates made canonical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let

# Reasons to review an item in order, with their priority.
RISK_PRIORITY = {"CONFLICTING_EVIDENCE_CONFIRMATION": 0, "SECURITY_BOUNDARY_CONFIRMATION": 0, "EXPERT_REVIEW": 1, "ACCEPTANCE_CONFIRMATION": 1, "NO_EVIDENCE_CONFIRMATION": 2}
# Question types that make an item a rewrite in meaning.
SEMANTIC_TYPES = ("single_document_explanation", "cross_document_semantic", "teaching_explanation", "multi_hop", "standards_freshness")


def _has(types: str | Column, *names: str) -> Column:
    return F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))


def risk_reasons(answerability="answerability", types="question_types", difficulty="difficulty", split="split") -> Column:
    """Reasons to review an item, in fixed order; empty if there is none."""
    a = F.col(answerability)
    rules = {
        "CONFLICTING_EVIDENCE_CONFIRMATION": a == "CONFLICTING_EVIDENCE",
        "SECURITY_BOUNDARY_CONFIRMATION": (a == "FORBIDDEN") | _has(types, "adversarial_security"),
        "EXPERT_REVIEW": (F.col(difficulty) == "hard") | _has(types, "standards_freshness"),
        "ACCEPTANCE_CONFIRMATION": F.col(split) == "acceptance",
        "NO_EVIDENCE_CONFIRMATION": a == "NO_EVIDENCE",
    }
    return F.array_compact(F.array(*[F.when(ok, name) for name, ok in rules.items()]))


def priority(reasons: Column) -> Column:
    """`P` and the smallest priority among reasons; null without reasons."""
    ranks = F.create_map(*[x for k, v in RISK_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.concat(F.lit("P"), F.array_min(F.transform(reasons, lambda r: ranks[r])).cast("string"))


def category(answerability="answerability", types="question_types") -> Column:
    """The first class that fits an item; null if none does."""
    a = F.col(answerability)
    return (
        F.when((a == "FORBIDDEN") | _has(types, "adversarial_security"), "security")
        .when(a.isin("NO_EVIDENCE", "PARTIALLY_ANSWERABLE", "CONFLICTING_EVIDENCE"), "evidence_boundary")
        .when(_has(types, "exact_lookup"), "exact_lookup")
        .when(_has(types, "single_document_fact"), "single_document_fact")
        .when(_has(types, "comparison"), "comparison")
        .when(_has(types, *SEMANTIC_TYPES), "semantic_rewrite")
    )


def case_category(answerability="answerability") -> Column:
    """ANSWERABLE (in part or conflicting too), NO_EVIDENCE or FORBIDDEN; null for others."""
    a = F.col(answerability)
    return F.when(a.isin("ANSWERABLE", "PARTIALLY_ANSWERABLE", "CONFLICTING_EVIDENCE"), "ANSWERABLE").when(a.isin("NO_EVIDENCE", "FORBIDDEN"), a)


def taxonomy_category(answerability="answerability") -> Column:
    """As case_category, but conflicting evidence has no class."""
    a = F.col(answerability)
    return F.when(a.isin("ANSWERABLE", "PARTIALLY_ANSWERABLE"), "ANSWERABLE").when(a.isin("NO_EVIDENCE", "FORBIDDEN"), a)


def question_text(history="conversation_history", question="question") -> Column:
    lines = F.array_join(F.transform(history, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    return F.btrim(F.concat(lines, F.lit("\nquestion: "), F.col(question)), F.lit(" \n\t"))


def answer_text(claims="reference_claims", points="acceptable_answer_points", answerability="answerability", question="question") -> Column:
    """Claims and answer points, one a line; an item without any says so with its class and question."""
    text = F.btrim(F.concat(F.array_join(F.transform(claims, lambda c: c["text"]), "\n"), F.lit("\n"), F.array_join(points, "\n")), F.lit(" \n\t"))
    return F.when(text != "", text).otherwise(F.concat(F.lit("NO SUPPORTING ANSWER: "), F.col(answerability), F.lit("\n"), F.col(question)))


def evidence_targets(citations="expected_citations", judgments="chunk_judgments") -> Column:
    """Distinct (document_id, page_start, page_end) of the cited chunks in order of citation; a citation without a judgment is null."""
    place = lambda j: F.struct(j["document_id"].alias("document_id"), j["page_start"].alias("page_start"), j["page_end"].alias("page_end"))
    return F.array_distinct(F.transform(citations, lambda c: place(F.get(F.filter(judgments, lambda j: j["chunk_id"] == c), 0))))


def build_cases(items: DataFrame, warnings: dict[str, str]) -> DataFrame:
    """Cases as evaluation.case_failures takes them, from items; warnings: by case category. Answerable items without a target have error."""
    kind = case_category()
    none = F.array().cast("array<string>")
    df = items.withColumn("category", kind).withColumn("required", F.when(kind == "ANSWERABLE", evidence_targets()).otherwise(F.array().cast("array<struct<document_id:string,page_start:int,page_end:int>>")))
    warned = F.array()
    for k, v in warnings.items():
        warned = F.when(kind == k, F.array(F.lit(v))).otherwise(warned if k != next(iter(warnings)) else none)
    return df.select(
        F.col("question_id").alias("case_id"),
        "category",
        F.when(kind == "FORBIDDEN", 403).otherwise(200).alias("http_status"),
        F.when(kind == "ANSWERABLE", "COMPLETED").when(kind == "NO_EVIDENCE", "NO_EVIDENCE").alias("answer_status"),
        F.when(kind == "FORBIDDEN", "RAG_FORBIDDEN_SCOPE").alias("error_code"),
        F.when(kind == "ANSWERABLE", 1).otherwise(0).alias("min_evidence"),
        F.when(kind != "ANSWERABLE", 0).alias("max_evidence"),
        "required",
        F.when(kind == "FORBIDDEN", F.col("expected_filters.document_ids")).otherwise(none).alias("forbidden"),
        warned.alias("warnings"),
        ((kind == "ANSWERABLE") & (F.size("required") == 0)).alias("error"),
    )


def _first_of_each(values: Column, key: str) -> Column:
    """Elements whose key no earlier element has."""
    return let(F.transform(values, lambda v: v[key]), lambda keys: F.filter(values, lambda v, i: F.array_position(keys, v[key]) == i + 1))


def canonical_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates brought into line with their slot and sources, with the distinct actions taken.

    candidates: slot (primary_question_type, answerability, source_document_ids), evidence (array of chunk_id, document_id, page_start,
    page_end), question_types, expected_route, reference_claims (claim_id, text, required), chunk_judgments (chunk_id, document_id,
    page_start, page_end, relevance, supports_claims), acceptable_answer_points, expected_citations, expected_document_ids. Judgments on
    chunks that aren't evidence are errors, as is another class than the slot's; error names the first.
    """
    negative = F.col("slot.answerability").isin("NO_EVIDENCE", "FORBIDDEN")
    df = candidates.withColumns({"_claims": _first_of_each(F.col("reference_claims"), "claim_id"), "_judged": _first_of_each(F.col("chunk_judgments"), "chunk_id")})
    known = F.transform("_claims", lambda c: c["claim_id"])
    source = lambda j: F.get(F.filter("evidence", lambda e: e["chunk_id"] == j["chunk_id"]), 0)
    links = lambda j: F.array_distinct(F.filter(j["supports_claims"], lambda c: F.array_contains(known, c)))

    def canonical(j: Column) -> Column:
        s = source(j)
        relevance = F.when(negative, F.least(j["relevance"], F.lit(1))).otherwise(j["relevance"])
        supports = F.when(negative, F.array().cast("array<string>")).otherwise(links(j))
        return F.struct(j["chunk_id"].alias("chunk_id"), s["document_id"].alias("document_id"), s["page_start"].alias("page_start"), s["page_end"].alias("page_end"), relevance.alias("relevance"), supports.alias("supports_claims"))

    df = df.withColumn("_new", F.transform("_judged", canonical))
    cited = F.transform(F.filter("_new", lambda j: j["relevance"] >= 2), lambda j: j["chunk_id"])
    documents = F.array_distinct("slot.source_document_ids")
    moved = F.exists("_judged", lambda j: F.coalesce(~((j["document_id"] == source(j)["document_id"]) & (j["page_start"] == source(j)["page_start"]) & (j["page_end"] == source(j)["page_end"])), F.lit(True)))
    actions = {
        "SET_PRIMARY_QUESTION_TYPE_FROM_SLOT": F.col("question_types") != F.array("slot.primary_question_type"),
        "SET_EXPECTED_ROUTE_HYBRID_QA": F.col("expected_route") != "HYBRID_QA",
        "DROP_DUPLICATE_REFERENCE_CLAIM": F.size("_claims") < F.size("reference_claims"),
        "DEFAULT_REFERENCE_CLAIM_REQUIRED_TRUE": F.exists("_claims", lambda c: c["required"].isNull()),
        "DROP_DUPLICATE_CHUNK_JUDGMENT": F.size("_judged") < F.size("chunk_judgments"),
        "CANONICALIZE_CHUNK_METADATA_FROM_SOURCE": moved,
        "FILTER_UNKNOWN_OR_DUPLICATE_CLAIM_LINKS": F.exists("_judged", lambda j: links(j) != j["supports_claims"]),
        "ENFORCE_NON_SUPPORTING_NEGATIVE_JUDGMENT": negative & F.exists("_judged", lambda j: (j["relevance"] > 1) | (F.size(links(j)) > 0)),
        "CLEAR_SUPPORT_CONTENT_FOR_NEGATIVE_ITEM": negative & ((F.size("_claims") > 0) | (F.size("acceptable_answer_points") > 0)),
        "DERIVE_EXPECTED_CITATIONS_FROM_RELEVANT_JUDGMENTS": F.col("expected_citations") != cited,
        "SET_EXPECTED_DOCUMENTS_FROM_SLOT": F.col("expected_document_ids") != documents,
    }
    error = F.when(F.col("answerability") != F.col("slot.answerability"), "ANSWERABILITY_DRIFTS").when(F.exists("_judged", lambda j: source(j).isNull()), "JUDGMENT_ON_UNKNOWN_CHUNK")
    filled = F.transform("_claims", lambda c: F.struct(c["claim_id"].alias("claim_id"), c["text"].alias("text"), F.coalesce(c["required"], F.lit(True)).alias("required")))
    empty = lambda c: F.filter(c, lambda _: F.lit(False))
    done = F.array_compact(F.array(*[F.when(ok, name) for name, ok in actions.items()]))
    df = df.withColumns({"actions": done, "error": error, "_cited": cited})
    df = df.withColumns({"reference_claims": F.when(negative, empty(filled)).otherwise(filled), "acceptable_answer_points": F.when(negative, empty(F.col("acceptable_answer_points"))).otherwise(F.col("acceptable_answer_points")), "question_types": F.array("slot.primary_question_type"), "expected_route": F.lit("HYBRID_QA"), "expected_citations": F.col("_cited"), "expected_document_ids": documents, "chunk_judgments": F.col("_new")})
    return df.drop("_claims", "_judged", "_new", "_cited")


def observation_summary(observations: DataFrame, least_samples: int = 30, limit_ms: float = 300.0) -> DataFrame:
    """One row over re-ranking observations: counts, bounds, P50 and P95 of each latency, status and the first error in order.

    observations: reranker_status, failure_code, candidate_count, output_count, base_ms, combined_ms, rerank_ms.
    """
    applied = (F.col("reranker_status") == "APPLIED") & F.col("failure_code").isNull()
    grown, unbounded = F.col("candidate_count") < F.col("output_count"), (F.col("candidate_count") > 20) | (F.col("output_count") > 3)
    p = [F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_p{round(100 * q)}") for c in ("base_ms", "combined_ms", "rerank_ms") for q in (0.5, 0.95)]
    df = observations.agg(F.count(F.lit(1)).alias("n"), F.count_if(applied).alias("n_applied"), F.count_if((F.col("reranker_status") == "FALLBACK") | F.col("failure_code").isNotNull()).alias("n_fallback"), F.coalesce(F.bool_or(grown), F.lit(False)).alias("expanded"), F.coalesce(F.bool_or(unbounded), F.lit(False)).alias("bound_violated"), *p)
    bad = (F.col("n_applied") < F.col("n")) | F.col("expanded") | F.col("bound_violated")
    error = F.when(F.col("n") < least_samples, "ONLINE_RERANKER_LATENCY_SAMPLE_INVALID").when(bad, "ONLINE_RERANKER_FALLBACK_OBSERVED").when(F.col("combined_ms_p95") > limit_ms, "ONLINE_RERANKER_COMBINED_P95_EXCEEDED")
    return df.withColumn("error_code", error).withColumn("status", F.when(error.isNull(), "PASS").otherwise("FAIL"))


def nli_workload(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """Distinct (pair_key, premise, hypothesis) of claims with their quotes; claims: claim_id, text; quotes: claim_id, quote."""
    pairs = claims.join(quotes, "claim_id").select(F.sha2(F.concat_ws("\n", "quote", "text"), 256).alias("pair_key"), F.col("quote").alias("premise"), F.col("text").alias("hypothesis"))
    return pairs.dropDuplicates(["pair_key"])


def intake_counts(reviews: DataFrame, verdicts: DataFrame) -> DataFrame:
    """relation, status, n: reviewed relations against machine verdicts, both by (question_id, claim_id); a missing verdict is NONE."""
    df = reviews.join(verdicts, ["question_id", "claim_id"], "left")
    return df.groupBy("relation", F.coalesce("status", F.lit("NONE")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def canary_differences(control: DataFrame, treatment: DataFrame, columns: list[str], case: str = "case_id") -> DataFrame:
    """Cases whose control and treatment results differ in any column, or that only one side has."""
    a = control.select(case, F.struct(*columns).alias("_a"))
    b = treatment.select(case, F.struct(*columns).alias("_b"))
    return a.join(b, case, "full_outer").where("not (_a <=> _b)").select(case)
