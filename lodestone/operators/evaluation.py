"""Retrieval metrics, paired comparisons and release gates over rankings and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import dcg_gain

KS = (3, 5, 10, 20, 50)
# Classes of questions that ranking metrics count, and the two that only refusal metrics do.
ELIGIBLE = ("ANSWERABLE", "PARTIALLY_ANSWERABLE", "CONFLICTING_EVIDENCE")


def question_metrics(questions: DataFrame, ranking: DataFrame, judgments: DataFrame, ks: tuple[int, ...] = KS, backends: tuple[str, ...] | None = None) -> DataFrame:
    """question_id, backend, k, recall, precision, mrr, ndcg for every question, backend and k.

    Naming the backends saves looking for them, and tells of those without any candidate.

    ranking: backend, question_id, chunk_id, rank; judgments: question_id, chunk_id, relevance (0 to 3). Relevant means a grade of 2 or
    more; nDCG uses all grades, its ideal list all judged ones. A question without relevant chunks has null recall; precision
    divides by k. Questions without candidates count with zeros.
    """
    graded = ranking.join(judgments, ["question_id", "chunk_id"]).select("backend", "question_id", "rank", "relevance")
    # the ideal list has the grades in falling order, so how often each was given tells all its places
    given = judgments.where("relevance is not null").groupBy("question_id", "relevance").agg(F.count(F.lit(1)).alias("n"))
    known = ranking.select("backend").distinct() if backends is None else None
    return metrics_of_grades(questions, graded, given, ks, backends, known)


def metrics_of_grades(questions: DataFrame, graded: DataFrame, given: DataFrame, ks: tuple[int, ...] = KS, backends: tuple[str, ...] | None = None, known: DataFrame | None = None) -> DataFrame:
    """The same from graded (backend, question_id, rank, relevance of what is ranked and judged) and given (question_id, relevance, n: how often).

    The backends are named, or known is their table.
    """
    asked = questions.select("question_id")
    asked = asked.crossJoin(known) if backends is None else asked.select("*", F.explode(F.array(*[F.lit(b) for b in backends])).alias("backend"))
    cut = asked.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    at_k = graded.join(cut, ["question_id", "backend"]).where("rank <= k")
    hit = F.col("relevance") >= 2
    got = at_k.groupBy("question_id", "backend", "k").agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(dcg_gain(F.col("relevance"), F.col("rank"))).alias("dcg"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("question_id").orderBy(F.desc("relevance")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = given.withColumn("before", before).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    places = F.filter(F.sequence(F.lit(1), F.lit(max(ks))), lambda i: (i > F.col("before")) & (i <= F.col("before") + F.col("n")) & (i <= F.col("k")))
    gains = F.aggregate(F.transform(places, lambda i: dcg_gain(F.col("relevance"), i)), F.lit(0.0), lambda s, x: s + x)
    best = at.groupBy("question_id", "k").agg(F.sum(gains).alias("ideal"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("relevant"))
    df = cut.join(got, ["question_id", "backend", "k"], "left").join(best, ["question_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.select(
        "question_id",
        "backend",
        "k",
        F.when(F.col("relevant") > 0, zero(F.col("hits") / F.col("relevant"))).alias("recall"),
        zero(F.col("hits") / F.col("k")).alias("precision"),
        zero(1 / F.col("first")).alias("mrr"),
        F.when(F.col("ideal") > 0, zero(F.col("dcg") / F.col("ideal"))).otherwise(0.0).alias("ndcg"),
    )


def macro_metrics(per_question: DataFrame, items: DataFrame) -> DataFrame:
    """backend, k, n and means (6 places) over the eligible questions; items: question_id, answerability."""
    used = per_question.join(items.where(F.col("answerability").isin(*ELIGIBLE)).select("question_id"), "question_id", "left_semi")
    return used.groupBy("backend", "k").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in ("recall", "precision", "mrr", "ndcg")])


def refusal_metrics(results: DataFrame, items: DataFrame) -> DataFrame:
    """backend and four rates (6 places, null on an empty denominator); results: backend, question_id, decision."""
    df = results.join(items.select("question_id", "answerability"), "question_id")
    none, refused, found = F.col("answerability") == "NO_EVIDENCE", F.col("decision") == "NO_EVIDENCE", F.col("decision") != "EVIDENCE_FOUND"
    eligible, forbidden = F.col("answerability").isin(*ELIGIBLE), F.col("answerability") == "FORBIDDEN"
    ratio = lambda a, b: F.round(F.sum(F.when(a & b, 1.0).otherwise(0.0)) / F.nullif(F.sum(F.when(b, 1.0).otherwise(0.0)), F.lit(0.0)), 6)
    return df.groupBy("backend").agg(ratio(refused, none).alias("no_answer_recall"), ratio(none, refused).alias("refusal_precision"), ratio(found, eligible).alias("wrong_refusal_rate"), ratio(F.col("decision") == "FORBIDDEN", forbidden).alias("forbidden_block_rate"))


def by_question_type(per_question: DataFrame, items: DataFrame, k: int = max(KS)) -> DataFrame:
    """backend, question_type, n, recall, ndcg at k over the eligible questions of each type; a type without any has n 0 and nulls.

    items: question_id, answerability, question_types (array).
    """
    top = per_question.where(F.col("k") == k)
    counts = F.col("answerability").isin(*ELIGIBLE)
    types = items.select("question_id", counts.alias("counts"), F.explode(F.array_distinct("question_types")).alias("question_type"))
    mean = lambda m: F.round(F.avg(F.when(F.col("counts"), F.col(m))), 6).alias(m)
    return top.join(types, "question_id").groupBy("backend", "question_type").agg(F.count_if("counts").alias("n"), mean("recall"), mean("ndcg"))


def metrics_report(macro: DataFrame, refusal: DataFrame, results: DataFrame) -> DataFrame:
    """backend, metric, value of every metric of a run: recall@k and the like, the rates of refusal, latency_ms_p50 and _p95.

    results: backend, question_id, latency_ms.
    """
    ranked = macro.unpivot(["backend", "k"], ["recall", "precision", "mrr", "ndcg"], "m", "value").select("backend", F.concat_ws("@", "m", F.col("k").cast("string")).alias("metric"), "value")
    rates = refusal.unpivot(["backend"], ["no_answer_recall", "refusal_precision", "wrong_refusal_rate", "forbidden_block_rate"], "metric", "value")
    p = lambda q: F.round(F.percentile("latency_ms", F.lit(q)), 6)
    times = results.groupBy("backend").agg(p(0.5).alias("latency_ms_p50"), p(0.95).alias("latency_ms_p95")).unpivot(["backend"], ["latency_ms_p50", "latency_ms_p95"], "metric", "value")
    return ranked.union(rates).union(times)


def comparisons(report: DataFrame) -> DataFrame:
    """candidate, baseline, metric, delta (candidate - baseline, 6 places) for every ordered pair of runs and metric that both have."""
    known = report.where("value is not null")
    a, b = known.toDF("candidate", "metric", "va"), known.toDF("baseline", "metric", "vb")
    return a.join(b, "metric").where("candidate <> baseline").select("candidate", "baseline", "metric", F.round(F.col("va") - F.col("vb"), 6).alias("delta"))


def report_errors(report: DataFrame, limits: dict[str, tuple[float, float]], gains: dict[str, tuple[str, str]]) -> DataFrame:
    """key, code of paired reports that can't pass: report has a key and numeric columns.

    limits: column -> (least, most), VALUE_OUT_OF_RANGE beyond or where it is missing or no finite number. gains: column ->
    (treatment, control), GAIN_ARITHMETIC where it isn't their difference within 1e-9.
    """
    key, rest = report.columns[0], report.columns[1:]
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    range_ = [F.when(~F.coalesce(sound(c) & F.col(c).between(*limits[c]), F.lit(False)), F.concat(F.lit("VALUE_OUT_OF_RANGE:"), F.lit(c))) for c in rest if c in limits]
    differs = lambda g, t, c: ~F.coalesce(F.abs(F.col(g) - (F.col(t) - F.col(c))) <= 1e-9, F.lit(False))
    arithmetic = [F.when(differs(g, t, c), F.concat(F.lit("GAIN_ARITHMETIC:"), F.lit(g))) for g, (t, c) in gains.items()]
    return report.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*range_, *arithmetic))).alias("code"))


def location_gate(evidence: DataFrame, required: DataFrame) -> DataFrame:
    """case_id, code: null, EVIDENCE_IDENTITY_FAILED (evidence of another document or version) or LOCATION_GATE_FAILED (a required range that no evidence overlaps).

    required: case_id, document_id, version_id, page_start, page_end (one row a range); evidence: case_id, document_id, version_id,
    page_start, page_end.
    """
    asked = required.select("case_id", "document_id", "version_id").distinct()
    e = evidence.select("case_id", F.col("document_id").alias("_d"), F.col("version_id").alias("_v"), F.col("page_start").alias("_a"), F.col("page_end").alias("_b"))
    foreign = asked.join(e, "case_id").where(~(F.col("_d").eqNullSafe(F.col("document_id")) & F.col("_v").eqNullSafe(F.col("version_id")))).select("case_id", F.lit(True).alias("_foreign")).distinct()
    overlap = (e["case_id"] == required["case_id"]) & (F.col("_a") <= F.col("page_end")) & (F.col("_b") >= F.col("page_start"))
    unmet = required.join(e, overlap, "left_anti").select("case_id", F.lit(True).alias("_unmet")).distinct()
    df = asked.select("case_id").distinct().join(foreign, "case_id", "left").join(unmet, "case_id", "left")
    return df.select("case_id", F.when(F.col("_foreign"), "EVIDENCE_IDENTITY_FAILED").when(F.col("_unmet"), "LOCATION_GATE_FAILED").alias("code"))


def model_selection(attempts: DataFrame, baseline: str, candidate: str, replays: int = 2) -> DataFrame:
    """One row: decision KEEP, PROMOTE or EXECUTION_INCOMPLETE, and how many cases pass all hard gates a model.

    attempts: model, case_id, attempt, error, identity_ok, citations_ok, terms_ok, forbidden_absent. A case passes if all its replays
    ended without error and every gate holds in each. Execution is complete if that number of replays ended for every case of both.
    """
    ended = F.col("error").isNull()
    gates = F.lit(True)
    for c in ("identity_ok", "citations_ok", "terms_ok", "forbidden_absent"):
        gates = gates & F.coalesce(F.col(c), F.lit(False))
    cases = attempts.groupBy("model", "case_id").agg((F.count_if(ended) == replays).alias("complete"), F.bool_and(ended & gates).alias("good"))
    mine = lambda m: F.col("model") == m
    passed = lambda m: F.count_if(mine(m) & F.col("complete") & F.col("good"))
    of = lambda m: F.count_if(mine(m))
    whole = F.coalesce(F.bool_and("complete"), F.lit(False)) & (of(baseline) > 0) & (of(baseline) == of(candidate))
    df = cases.where(F.col("model").isin(baseline, candidate)).agg(whole.alias("_whole"), passed(baseline).alias("baseline_passed"), passed(candidate).alias("candidate_passed"), of(candidate).alias("n_cases"))
    decision = F.when(~F.col("_whole"), "EXECUTION_INCOMPLETE").when(F.col("candidate_passed") == F.col("n_cases"), "PROMOTE").otherwise("KEEP")
    return df.select(decision.alias("decision"), "baseline_passed", "candidate_passed", "n_cases")


def route_work(samples: DataFrame, stages: list[str], by: str = "request_id") -> DataFrame:
    """request, n_routes and each stage's time summed over the request's routes."""
    return samples.groupBy(by).agg(F.count(F.lit(1)).alias("n_routes"), *[F.sum(s).alias(s) for s in stages])


def deltas(macro: DataFrame, metrics: tuple[str, ...] = ("recall", "precision", "mrr", "ndcg")) -> DataFrame:
    """backend_a < backend_b, k, metric, delta (b - a, 6 places)."""
    long = macro.unpivot(["backend", "k"], list(metrics), "metric", "value")
    a, b = long.toDF("backend_a", "k", "metric", "va"), long.toDF("backend_b", "k", "metric", "vb")
    return a.join(b, ["k", "metric"]).where("backend_a < backend_b").select("backend_a", "backend_b", "k", "metric", F.round(F.col("vb") - F.col("va"), 6).alias("delta"))


def coverage_errors(items: DataFrame, results: DataFrame, most_k: int, dataset_version: str | None = None) -> DataFrame:
    """code, backend, question_id: missing and extra questions, more than one run or too small a top_k in a backend.

    With a dataset_version, results of another one are DATASET_VERSION; results with a run_label other than their backend are LABEL.
    """
    want = items.select("question_id").crossJoin(results.select("backend").distinct())
    missing = want.join(results, ["backend", "question_id"], "left_anti").select(F.lit("MISSING").alias("code"), "backend", "question_id")
    extra = results.join(items, "question_id", "left_anti").select(F.lit("EXTRA").alias("code"), "backend", "question_id")
    runs = results.groupBy("backend").agg(F.count_distinct("run_id").alias("runs"), F.min("top_k").alias("top"))
    bad = lambda cond, code: runs.where(cond).select(F.lit(code).alias("code"), "backend", F.lit(None).cast("string").alias("question_id"))
    out = missing.union(extra).union(bad("runs > 1", "MORE_RUNS")).union(bad(F.col("top") < most_k, "TOP_K_TOO_SMALL"))
    rows = lambda cond, code: results.where(cond).select(F.lit(code).alias("code"), "backend", "question_id")
    if dataset_version is not None:
        out = out.union(rows(~F.col("dataset_version").eqNullSafe(F.lit(dataset_version)), "DATASET_VERSION"))
    return out.union(rows(~F.col("run_label").eqNullSafe(F.col("backend")), "LABEL")) if "run_label" in results.columns else out


def two_sided(ranking: DataFrame, judgments: DataFrame, k: int = 3) -> DataFrame:
    """question_id, backend, strict: whether the documents of the relevant chunks in the first k are exactly the two relevant documents."""
    relevant = judgments.where("relevance >= 2")
    ends = relevant.groupBy("question_id").agg(F.min("document_id").alias("lo"), F.max("document_id").alias("hi"))
    # two documents if the first and the last differ and none lies between; no list of them is made
    between = relevant.join(ends, "question_id").where("document_id > lo and document_id < hi").select("question_id").distinct().withColumn("more", F.lit(True))
    want = ends.join(between, "question_id", "left").select("question_id", F.when((F.col("lo") < F.col("hi")) & F.col("more").isNull(), F.array("lo", "hi")).alias("want"))
    got = ranking.where(F.col("rank") <= k).join(relevant.select("question_id", "chunk_id", "document_id"), ["question_id", "chunk_id"])
    got = got.groupBy("question_id", "backend").agg(F.array_sort(F.collect_set("document_id")).alias("got"))
    backends = ranking.select("backend").distinct()
    df = want.crossJoin(backends).join(got, ["question_id", "backend"], "left")
    return df.select("question_id", "backend", F.coalesce(F.col("got") == F.col("want"), F.lit(False)).alias("strict"))


def promotion(macro: DataFrame, types: DataFrame, baseline: str, candidate: str, critical: tuple[str, ...], least_gain: float = 0.08, most_loss: float = 0.02, k: int = 10) -> DataFrame:
    """One row: relative nDCG gain, precision change, worst change of a critical type, promoted."""
    pick = lambda b: macro.where((F.col("backend") == b) & (F.col("k") == k))
    both = pick(baseline).select(F.col("ndcg").alias("n0"), F.col("precision").alias("p0")).crossJoin(pick(candidate).select(F.col("ndcg").alias("n1"), F.col("precision").alias("p1")))
    of = lambda b, n: types.where((F.col("backend") == b) & F.col("question_type").isin(*critical)).select("question_type", F.col("ndcg").alias(n))
    worst = of(baseline, "a").join(of(candidate, "b"), "question_type").agg(F.round(F.min(F.col("b") - F.col("a")), 6).alias("worst_type_change"))
    df = both.crossJoin(worst).select(F.round(F.when(F.col("n0") == 0, F.when(F.col("n1") == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise((F.col("n1") - F.col("n0")) / F.col("n0")), 6).alias("relative_gain"), F.round(F.col("p1") - F.col("p0"), 6).alias("precision_change"), "worst_type_change")
    return df.withColumn("promoted", (F.col("relative_gain") >= least_gain) & (F.col("precision_change") >= 0) & (F.coalesce("worst_type_change", F.lit(0.0)) >= -most_loss))


def case_failures(cases: DataFrame, observed: DataFrame, evidence: DataFrame) -> DataFrame:
    """case_id, passed, failures (array of lines that say what was expected and what came).

    cases: case_id, http_status, answer_status, error_code, min_evidence, max_evidence, required (array of document_id, page_start,
    page_end), forbidden (array of document_id), warnings (array); a null status, code or maximum isn't checked. observed: case_id,
    http_status, answer_status, error_code, warnings. evidence: case_id, document_id, page_start, page_end.
    """
    none = F.array().cast("array<string>")
    o = observed.select("case_id", F.col("http_status").alias("o_http"), F.col("answer_status").alias("o_status"), F.col("error_code").alias("o_error"), F.coalesce("warnings", none).alias("o_warnings"))
    found = evidence.groupBy("case_id").agg(F.collect_list(F.struct("document_id", "page_start", "page_end")).alias("found"))
    df = cases.join(o, "case_id", "left").join(found, "case_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<document_id:string,page_start:int,page_end:int>>"))).withColumn("o_warnings", F.coalesce("o_warnings", none))
    met = lambda r: F.exists("found", lambda e: (e["document_id"] == r["document_id"]) & (e["page_start"] <= r["page_end"]) & (e["page_end"] >= r["page_start"]))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    n = F.size("found")
    hits = F.array_sort(F.array_intersect("forbidden", F.transform("found", lambda e: e["document_id"])))
    lacking = F.array_sort(F.array_except("warnings", "o_warnings"))
    line = lambda cond, *parts: F.when(F.coalesce(cond, F.lit(True)), F.concat(*[F.lit(p) if isinstance(p, str) else text(p) for p in parts]))
    differs = lambda want, got: F.col(want).isNotNull() & ~F.col(want).eqNullSafe(F.col(got))
    lines = F.array(
        line(differs("http_status", "o_http"), "http_status expected ", F.col("http_status"), ", got ", F.col("o_http")),
        line(differs("answer_status", "o_status"), "answer_status expected ", F.col("answer_status"), ", got ", F.col("o_status")),
        line(differs("error_code", "o_error"), "error_code expected ", F.col("error_code"), ", got ", F.col("o_error")),
        line(n < F.coalesce("min_evidence", F.lit(0)), "evidence_count expected >= ", F.col("min_evidence"), ", got ", n),
        line(F.col("max_evidence").isNotNull() & (n > F.col("max_evidence")), "evidence_count expected <= ", F.col("max_evidence"), ", got ", n),
    )
    missing = F.transform(F.filter("required", lambda r: ~met(r)), lambda r: F.concat(F.lit("required_evidence missing "), r["document_id"], F.lit(":"), text(r["page_start"]), F.lit("-"), text(r["page_end"])))
    rest = F.array(line(F.size(hits) > 0, "forbidden_document_ids present: ", F.array_join(hits, ",")), line(F.size(lacking) > 0, "required_warnings missing: ", F.array_join(lacking, ",")))
    failures = F.array_compact(F.concat(lines, missing, rest))
    return df.select("case_id", (F.size(failures) == 0).alias("passed"), failures.alias("failures"))


def paired_latency(control: DataFrame, treatment: DataFrame, most_more: float = 50.0) -> DataFrame:
    """control_p95, treatment_p95, more, within; frames with latency_ms."""
    p = lambda df, n: df.agg(F.round(F.percentile("latency_ms", F.lit(0.95)), 6).alias(n))
    df = p(control, "control_p95").crossJoin(p(treatment, "treatment_p95"))
    return df.withColumn("more", F.round(F.col("treatment_p95") - F.col("control_p95"), 6)).withColumn("within", F.col("more") <= most_more)


def stage_latencies(samples: DataFrame, stages: list[str]) -> DataFrame:
    """stage, n, p50, p95 of each stage's column."""
    long = samples.select(*[F.col(s).cast("double") for s in stages]).unpivot([], stages, "stage", "ms").where("ms is not null")
    return long.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("ms", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("ms", F.lit(0.95)), 6).alias("p95"))


def nli_retention(scores: DataFrame, pairs: DataFrame, least: float = 0.85) -> DataFrame:
    """group_kind, n, retained, rate, passed: claims of a kind of which any pair is labelled ENTAILMENT.

    scores: pair_key, label; pairs: group_kind, claim_id, pair_key.
    """
    held = pairs.join(scores, "pair_key", "left").groupBy("group_kind", "claim_id").agg(F.max(F.when(F.col("label") == "ENTAILMENT", 1).otherwise(0)).alias("kept"))
    df = held.groupBy("group_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("kept").alias("retained"))
    return df.withColumn("rate", F.round(F.col("retained") / F.col("n"), 6)).withColumn("passed", F.col("rate") >= least)


def plan_determinism(plans: DataFrame, most_p95: float = 5.0, repetitions: tuple[int, int] | None = None) -> DataFrame:
    """case_id, repetitions, stable, p95_ms, passed; plans: case_id, plan_hash, elapsed_ms.

    With bounds of the number of repetitions a case outside them fails. Where plans have arm, status, query and question, a control
    that isn't the question as it is and a treatment that isn't APPLIED fail too.
    """
    df = plans.groupBy("case_id").agg(F.count(F.lit(1)).alias("repetitions"), (F.count_distinct("plan_hash") == 1).alias("stable"), F.round(F.percentile("elapsed_ms", F.lit(0.95)), 6).alias("p95_ms"))
    df = df.withColumn("passed", F.col("stable") & (F.col("p95_ms") <= most_p95))
    if repetitions is not None:
        df = df.withColumn("passed", F.col("passed") & F.col("repetitions").between(*repetitions))
    if {"arm", "status", "query", "question"} <= set(plans.columns):
        kept = F.when(F.col("arm") == "control", F.col("query").eqNullSafe(F.col("question"))).otherwise(F.col("status").eqNullSafe(F.lit("APPLIED")))
        df = df.join(plans.groupBy("case_id").agg(F.bool_and(kept).alias("_kept")), "case_id").withColumn("passed", F.col("passed") & F.col("_kept")).drop("_kept")
    return df


def no_evidence_regressions(items: DataFrame, control: DataFrame, treatment: DataFrame) -> DataFrame:
    """question_id of NO_EVIDENCE items that the control refuses and the treatment doesn't; frames: question_id, decision."""
    pick = lambda df, n: df.select("question_id", F.col("decision").alias(n))
    asked = items.where("answerability = 'NO_EVIDENCE'").select("question_id")
    return asked.join(pick(control, "a"), "question_id").join(pick(treatment, "b"), "question_id").where("a = 'NO_EVIDENCE' and b <> 'NO_EVIDENCE'").select("question_id")
