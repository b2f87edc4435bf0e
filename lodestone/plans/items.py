"""Items, sources, sinks and the remaining gates over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.stemming import fts_tokens
from lodestone.operators import checks, chunking, dense, evaluation, fusion, items, lexical, summaries
from lodestone.plans import retrieval as R
from lodestone.plans.frames import ITEMS, passages, questions, table
from lodestone.plans.frames import items as base_items
from lodestone.plans.registry import query, stored, with_checkpoints
from lodestone.sources import readers, sinks


def _items(spark, sf_dir):
    extra = F.element_at(F.array(*[F.lit(x) for x in ("exact_lookup", "adversarial_security", "standards_freshness", "multi_hop", "single_document_fact", "other", "teaching_explanation")]), (F.col("question_id") % 7 + 1).cast("int"))
    df = base_items(spark, sf_dir)
    return df.withColumn("question_types", F.array(extra)).withColumn("difficulty", F.when(F.col("question_id") % 6 == 0, "hard").otherwise("easy"))


_TYPED = f"""{ITEMS}, typed AS (SELECT * EXCLUDE (question_types), ['exact_lookup', 'adversarial_security', 'standards_freshness', 'multi_hop', 'single_document_fact', 'other', 'teaching_explanation'][question_id % 7 + 1] AS t, CASE WHEN question_id % 6 = 0 THEN 'hard' ELSE 'easy' END AS difficulty FROM items)"""


@query(f"""WITH {_TYPED}, r AS (SELECT question_id, list_filter([CASE WHEN answerability = 'CONFLICTING_EVIDENCE' THEN 'CONFLICTING_EVIDENCE_CONFIRMATION' END, CASE WHEN answerability = 'FORBIDDEN' OR t = 'adversarial_security' THEN 'SECURITY_BOUNDARY_CONFIRMATION' END,
  CASE WHEN difficulty = 'hard' OR t = 'standards_freshness' THEN 'EXPERT_REVIEW' END, CASE WHEN split = 'acceptance' THEN 'ACCEPTANCE_CONFIRMATION' END, CASE WHEN answerability = 'NO_EVIDENCE' THEN 'NO_EVIDENCE_CONFIRMATION' END], lambda x: x IS NOT NULL) AS r FROM typed)
SELECT question_id, array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN NULL WHEN r[1] IN ('CONFLICTING_EVIDENCE_CONFIRMATION', 'SECURITY_BOUNDARY_CONFIRMATION') THEN 'P0' WHEN r[1] IN ('EXPERT_REVIEW', 'ACCEPTANCE_CONFIRMATION') THEN 'P1' ELSE 'P2' END AS priority FROM r""")
def prj_risk_reasons(spark, sf_dir):
    df = _items(spark, sf_dir).withColumn("r", items.risk_reasons())
    return df.select("question_id", F.array_join("r", ",").alias("reasons"), items.priority(F.col("r")).alias("priority"))


@query(f"""WITH {_TYPED} SELECT question_id, CASE WHEN t = 'adversarial_security' THEN 'security' WHEN answerability IN ('NO_EVIDENCE', 'PARTIALLY_ANSWERABLE', 'CONFLICTING_EVIDENCE') THEN 'evidence_boundary' WHEN t = 'exact_lookup' THEN 'exact_lookup' WHEN t = 'single_document_fact' THEN 'single_document_fact'
  WHEN t IN ('standards_freshness', 'multi_hop', 'teaching_explanation') THEN 'semantic_rewrite' END AS category, CASE WHEN answerability = 'NO_EVIDENCE' THEN 'NO_EVIDENCE' ELSE 'ANSWERABLE' END AS case_category,
  CASE WHEN answerability = 'NO_EVIDENCE' THEN 'NO_EVIDENCE' WHEN answerability <> 'CONFLICTING_EVIDENCE' THEN 'ANSWERABLE' END AS taxonomy FROM typed""")
def prj_categories(spark, sf_dir):
    return _items(spark, sf_dir).select("question_id", items.category().alias("category"), items.case_category().alias("case_category"), items.taxonomy_category().alias("taxonomy"))


@query("""WITH h AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history, arg_min(text, turn) AS q, count(*) FILTER (role = 'assistant') AS n, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS claims FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(trim(history || chr(10) || 'question: ' || q, ' ' || chr(10) || chr(9))) AS question_digest, md5(CASE WHEN n > 0 THEN trim(claims || chr(10), ' ' || chr(10) || chr(9)) ELSE 'NO SUPPORTING ANSWER: NO_EVIDENCE' || chr(10) || q END) AS answer_digest FROM h""")
def prj_item_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    df = c.groupBy("conv_id").agg(turns.alias("conversation_history"))
    df = df.withColumns({"question": F.col("conversation_history")[0]["content"], "reference_claims": F.transform(F.filter("conversation_history", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["content"].alias("text"))), "acceptable_answer_points": F.array().cast("array<string>"), "answerability": F.lit("NO_EVIDENCE")})
    return df.select("conv_id", F.md5(items.question_text()).alias("question_digest"), F.md5(items.answer_text()).alias("answer_digest"))


def _candidates(spark, sf_dir):
    """Benchmark items as candidates with faults in turn."""
    i = F.col("item_id")
    name = lambda k: F.concat(F.lit("k"), (i + k).cast("string"))
    judged = lambda k, r, s: F.struct(name(k).alias("chunk_id"), F.lit("d").alias("document_id"), F.when(i % 4 == 0, 9).otherwise(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit(r).alias("relevance"), s.alias("supports_claims"))
    claim = lambda n, req: F.struct(F.lit(n).alias("claim_id"), F.lit("t").alias("text"), req.alias("required"))
    source = lambda k: F.struct(name(k).alias("chunk_id"), F.lit("d").alias("document_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    kind = F.when(i % 5 == 0, "NO_EVIDENCE").otherwise("ANSWERABLE")
    linked = F.when(i % 3 == 0, F.array(F.lit("c1"), F.lit("c9"))).otherwise(F.array(F.lit("c1")))
    return table(spark, sf_dir, "benchmark").select(
        i.alias("question_id"), F.struct(F.lit("fact").alias("primary_question_type"), kind.alias("answerability"), F.array(F.lit("d"), F.lit("d")).alias("source_document_ids")).alias("slot"), F.array(source(0), source(1)).alias("evidence"),
        F.array(F.lit("fact")).alias("question_types"), F.when(i % 2 == 0, "HYBRID_QA").otherwise("OTHER").alias("expected_route"), kind.alias("answerability"),
        F.array(claim("c1", F.lit(True)), claim("c2", F.when(i % 7 != 0, F.lit(True))), claim("c1", F.lit(True))).alias("reference_claims"), F.array(judged(0, 3, linked), judged(1, 1, F.array().cast("array<string>")), judged(0, 0, linked)).alias("chunk_judgments"),
        F.array(F.lit("p")).alias("acceptable_answer_points"), F.array(name(0)).alias("expected_citations"), F.array(F.lit("d")).alias("expected_document_ids"),
    )


@query("""SELECT item_id AS question_id, array_to_string(list_filter([CASE WHEN item_id % 2 = 1 THEN 'SET_EXPECTED_ROUTE_HYBRID_QA' END, 'DROP_DUPLICATE_REFERENCE_CLAIM', CASE WHEN item_id % 7 = 0 THEN 'DEFAULT_REFERENCE_CLAIM_REQUIRED_TRUE' END, 'DROP_DUPLICATE_CHUNK_JUDGMENT',
  CASE WHEN item_id % 4 = 0 THEN 'CANONICALIZE_CHUNK_METADATA_FROM_SOURCE' END, CASE WHEN item_id % 3 = 0 THEN 'FILTER_UNKNOWN_OR_DUPLICATE_CLAIM_LINKS' END, CASE WHEN item_id % 5 = 0 THEN 'ENFORCE_NON_SUPPORTING_NEGATIVE_JUDGMENT' END, CASE WHEN item_id % 5 = 0 THEN 'CLEAR_SUPPORT_CONTENT_FOR_NEGATIVE_ITEM' END,
  CASE WHEN item_id % 5 = 0 THEN 'DERIVE_EXPECTED_CITATIONS_FROM_RELEVANT_JUDGMENTS' END], lambda x: x IS NOT NULL), ',') AS actions, CASE WHEN item_id % 5 = 0 THEN 0 ELSE 1 END AS n_cited, CASE WHEN item_id % 5 = 0 THEN 0 ELSE 2 END AS n_claims, 2 AS n_judgments FROM benchmark""")
def prj_canonical_candidates(spark, sf_dir):
    return items.canonical_candidates(_candidates(spark, sf_dir)).select("question_id", F.array_join("actions", ",").alias("actions"), F.size("expected_citations").alias("n_cited"), F.size("reference_claims").alias("n_claims"), F.size("chunk_judgments").alias("n_judgments"))


@query("SELECT item_id AS case_id, CASE WHEN item_id % 5 = 0 THEN 'NO_EVIDENCE' ELSE 'ANSWERABLE' END AS category, 200 AS http_status, CASE WHEN item_id % 5 = 0 THEN 'NO_EVIDENCE' ELSE 'COMPLETED' END AS answer_status, CASE WHEN item_id % 5 = 0 THEN 0 ELSE 1 END AS n_required, CASE WHEN item_id % 5 = 0 THEN 'none' ELSE 'found' END AS warning FROM benchmark")
def prj_cases(spark, sf_dir):
    c = items.canonical_candidates(_candidates(spark, sf_dir)).withColumn("expected_filters", F.struct(F.array(F.lit("d")).alias("document_ids")))
    cases = items.build_cases(c, {"ANSWERABLE": "found", "NO_EVIDENCE": "none"})
    return cases.select("case_id", "category", "http_status", "answer_status", F.size("required").alias("n_required"), F.col("warnings")[0].alias("warning"))


@query("""WITH o AS (SELECT * FROM events WHERE event_type IN ('view', 'click')) SELECT count(*) AS n, count(*) FILTER (value < 900) AS n_applied, count(*) FILTER (value >= 900) AS n_fallback, false AS expanded, false AS bound_violated,
  round(quantile_cont(value, 0.5), 6) AS base_ms_p50, round(quantile_cont(value, 0.95), 6) AS base_ms_p95, round(quantile_cont(value * 1.5, 0.5), 6) AS combined_ms_p50, round(quantile_cont(value * 1.5, 0.95), 6) AS combined_ms_p95, round(quantile_cont(value * 0.5, 0.5), 6) AS rerank_ms_p50, round(quantile_cont(value * 0.5, 0.95), 6) AS rerank_ms_p95,
  CASE WHEN max(value) >= 900 THEN 'ONLINE_RERANKER_FALLBACK_OBSERVED' WHEN quantile_cont(value * 1.5, 0.95) > 300 THEN 'ONLINE_RERANKER_COMBINED_P95_EXCEEDED' END AS error_code, CASE WHEN max(value) >= 900 OR quantile_cont(value * 1.5, 0.95) > 300 THEN 'FAIL' ELSE 'PASS' END AS status FROM o""")
def evl_observations(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    v = F.col("value")
    return items.observation_summary(e.select(F.when(v < 900, "APPLIED").otherwise("FALLBACK").alias("reranker_status"), F.lit(None).cast("string").alias("failure_code"), F.lit(20).alias("candidate_count"), F.lit(3).alias("output_count"), v.alias("base_ms"), (v * 1.5).alias("combined_ms"), (v * 0.5).alias("rerank_ms")))


@query("""WITH c AS (SELECT event_type AS group_kind, user_id AS claim_id, bool_or(value > 100) AS kept FROM events GROUP BY ALL), g AS (SELECT group_kind, count(*) AS n, count(*) FILTER (kept) AS retained FROM c GROUP BY group_kind)
SELECT group_kind, n, retained, round(retained / n, 6) AS rate, round(retained / n, 6) >= 0.85 AS passed FROM g""")
def evl_nli_retention(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    scores = e.select(F.col("event_id").alias("pair_key"), F.when(F.col("value") > 100, "ENTAILMENT").otherwise("NEUTRAL").alias("label"))
    return evaluation.nli_retention(scores, e.select(F.col("event_type").alias("group_kind"), F.col("user_id").alias("claim_id"), F.col("event_id").alias("pair_key")))


@query("SELECT user_id AS case_id, count(*) AS repetitions, count(DISTINCT event_type) = 1 AS stable, round(quantile_cont(value, 0.95), 6) AS p95_ms, count(DISTINCT event_type) = 1 AND round(quantile_cont(value, 0.95), 6) <= 5 AS passed FROM events GROUP BY user_id")
def evl_plan_determinism(spark, sf_dir):
    return evaluation.plan_determinism(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("plan_hash"), F.col("value").alias("elapsed_ms")))


@query("WITH p AS (SELECT DISTINCT sha256(a.text || chr(10) || b.text) AS pair_key FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT pair_key FROM p")
def evl_nli_workload(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    return items.nli_workload(c.select(key(F.col("turn")).alias("claim_id"), "text"), c.select(key(F.col("turn") + 1).alias("claim_id"), F.col("text").alias("quote"))).select("pair_key")


@query("SELECT role AS relation, CASE WHEN turn % 3 = 0 THEN 'SUPPORTED' WHEN turn % 3 = 1 THEN 'UNSUPPORTED' ELSE 'NONE' END AS status, count(*) AS n FROM conversations GROUP BY ALL")
def evl_intake_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("claim_id"), F.col("role").alias("relation"))
    v = c.where("claim_id % 3 <> 2").select("question_id", "claim_id", F.when(F.col("claim_id") % 3 == 0, "SUPPORTED").otherwise("UNSUPPORTED").alias("status"))
    return items.intake_counts(c.select("question_id", "claim_id", "relation"), v)


@query("SELECT doc_id AS case_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def evl_canary_differences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit(1).alias("quality"))
    return items.canary_differences(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), "quality"), ["quality"])


def _shared(spark, name):
    with_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def src_jsonl(spark, sf_dir):
    """Written as JSON lines, read again with a typed schema."""
    at = _shared(spark, "jsonl")
    c = table(spark, sf_dir, "conversations")
    sinks.write_jsonl(c, at)
    back = readers.jsonl(spark, at, T.StructType(sorted(c.schema.fields, key=lambda f: f.name)))
    return back.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv(spark, sf_dir):
    at = _shared(spark, "csv")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.option("header", True).csv(at)
    return readers.csv(spark, at, n.schema)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def snk_publish(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sinks.publish(d, _shared(spark, "published")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_good FROM labels")
def snk_ensure_staged(spark, sf_dir):
    """Half of the rows first, then all: only the missing half is appended."""
    at = _shared(spark, "staged")
    rows = table(spark, sf_dir, "labels")
    sinks.ensure_staged(rows.where("doc_id % 2 = 0"), at, ["doc_id"])
    sinks.ensure_staged(rows, at, ["doc_id"])
    return spark.read.parquet(at).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"))


@query("SELECT count(DISTINCT sha256(html)) AS n, 0::BIGINT AS damaged FROM pages")
def snk_objects(spark, sf_dir):
    at = _shared(spark, "objects")
    sinks.put_objects(table(spark, sf_dir, "pages").select(F.encode("html", "UTF-8").alias("content")), at)
    return spark.read.parquet(at).agg(F.count(F.lit(1)).alias("n")).crossJoin(sinks.damaged_objects(spark, at).agg(F.count(F.lit(1)).alias("damaged")))


@query("SELECT rule, key FROM (SELECT 'LEASE' AS rule, CAST(event_id AS VARCHAR) AS key FROM events WHERE (event_type = 'click') <> (value > 50) UNION ALL SELECT 'COMPLETION', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'ATTEMPTS', CAST(event_id AS VARCHAR) FROM events WHERE user_id % 10 > 5)")
def chk_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    leased = F.when(F.col("value") > 50, "x")
    status = F.when(F.col("event_type") == "click", "RUNNING").when(F.col("event_type") == "purchase", "SUCCEEDED").otherwise("PENDING")
    return checks.job_errors(e.select(F.col("event_id").alias("job_id"), status.alias("status"), leased.alias("lease_token"), leased.alias("lease_expires_at"), none.alias("failure_code"), none.alias("completed_at"), (F.col("user_id") % 10).alias("attempt_count"), F.lit(5).alias("max_attempts")))


@query("SELECT o_custkey AS owner_id, o_orderpriority AS document_id, count(*) AS n_active FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL HAVING count(*) > 1")
def chk_several_active(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("document_id"), (F.col("o_orderstatus") == "O").alias("is_active"))
    return checks.several_active(o)


def _stemmed(spark, sf_dir):
    return lexical.batch(questions(spark, sf_dir), passages(spark, sf_dir), R._fields(), {"body": 1.0, "section": 2.0}, stored, fts_tokens)


@query()
def lex_bm25_porter(spark, sf_dir):
    """BM25 over stemmed tokens without accents."""
    return _stemmed(spark, sf_dir).bm25_best(10)


@query()
def evl_four_backends(spark, sf_dir):
    """One run of token overlap, BM25, dense and their fusion over all questions; the dense vectors come from the hashing provider."""
    number = F.substring("chunk_id", 2, 10).cast("bigint")
    lexical_two = R.two_rankings(spark, sf_dir).select("backend", "question_id", number.alias("chunk_id"), "score", "rank")
    asked = dense.embed(questions(spark, sf_dir), dense.hashed_embedding, "question").select(F.col("question_id").alias("id"), "vector")
    held = stored(dense.embed(passages(spark, sf_dir).select(number.alias("id"), "text"), dense.hashed_embedding).select("id", "vector"), "vectors")
    near = stored(dense.cosine_top_k(stored(asked, "question-vectors"), held, 20, 0.5, "id", "vector").withColumn("backend", F.lit("dense")), "nearest")
    three = lexical_two.unionByName(near)
    fused = fusion.rrf(three, top=20).select(F.lit("rrf").alias("backend"), "question_id", "chunk_id", "score", "rank")
    return three.unionByName(fused)


@query()
def evl_chunk_strategies(spark, sf_dir):
    """Number and lengths of chunks by strategy."""
    out = None
    for name in chunking.STRATEGIES:
        rows = chunking.chunked(table(spark, sf_dir, "documents"), name, "doc_id").withColumn("strategy", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return summaries.length_summary(out, ["strategy"])


@query("""WITH l AS (SELECT o_orderkey, o_custkey, o_orderpriority, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL),
m AS (SELECT l.o_orderkey, r.k, CASE WHEN r.n IS NULL THEN 'MISSING' WHEN r.n > 1 OR l.n > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status FROM l LEFT JOIN r USING (o_custkey, o_orderpriority))
SELECT status, count(*) AS n, CAST(sum(CASE WHEN status = 'MATCHED' THEN k ELSE 0 END) AS BIGINT) AS keys FROM m GROUP BY status""")
def jn_composite_unique(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = checks.composite_match(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "other"), ["o_custkey", "o_orderpriority"], "o_orderkey", "other")
    return m.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("other", F.lit(0))).alias("keys"))


@query(f"WITH {ITEMS} SELECT question_id FROM items WHERE answerability = 'NO_EVIDENCE' AND question_id % 2 = 1")
def evl_no_evidence_regressions(spark, sf_dir):
    i = base_items(spark, sf_dir)
    control = i.select("question_id", F.lit("NO_EVIDENCE").alias("decision"))
    return evaluation.no_evidence_regressions(i, control, i.select("question_id", F.when(F.col("question_id") % 2 == 1, "EVIDENCE_FOUND").otherwise("NO_EVIDENCE").alias("decision")))


@query("""WITH r AS (SELECT item_id, sha256('{"item_id":' || CAST(item_id AS VARCHAR) || ',"n":' || CAST(length(text) AS VARCHAR) || '}') AS h FROM benchmark), b AS (SELECT item_id // 16 AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY item_id)) AS h FROM r GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM b""")
def agg_fingerprint(spark, sf_dir):
    return summaries.ordered_fingerprint(table(spark, sf_dir, "benchmark").withColumn("n", F.length("text")), "item_id", ["item_id", "n"], 16)


@query(f"SELECT item_id AS question_id, {R._COUNTED} FROM benchmark")
def vec_embed_cached(spark, sf_dir):
    """Twice over one cache: the second time nothing is asked of the provider."""
    at = _shared(spark, "vectors")
    q = questions(spark, sf_dir)
    dense.embed_cached(q, at, R.counted, "question", 3)
    v = F.col("vector")
    return dense.embed_cached(q, at, lambda texts: 1 // 0, "question", 3).select("question_id", v[0].alias("a"), v[1].alias("b"), v[2].alias("c"))
