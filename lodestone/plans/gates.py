"""Claims of known verdict, further gates, corpus checks, sources and the answer in one call, over the supplied tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.answering import answer
from lodestone.functions import scalars as S
from lodestone.functions import text as X
from lodestone.operators import checks, chunking, claims, corpus, decompose, dense, evaluation, fusion, lexical, lifecycle, summaries
from lodestone.plans import retrieval as R
from lodestone.plans.frames import CHUNKS, ITEMS, SCOPES, VISIBLE, chunks, items, questions, scopes, table
from lodestone.plans.items import _shared
from lodestone.plans.quality import _METRICS, _RESULTS, _found, _per_question, _results
from lodestone.plans.registry import query, with_checkpoints
from lodestone.sources import readers, sinks

# Claims whose verdict follows from the rules by hand. {n} and {m} are numbers of an order that are equal for some orders.
# (text, quotes, positions, verdict of the claim and its reason, verdict of the evidence set and its reason)
_CASES = (
    ("The trial took {n} days", ["The trial took {m} days"], [1], "", "", "", ""),  # by whether the numbers are equal
    ("", ["The trial took {m} days"], [1], "UNSUPPORTED", "CLAIM_TEXT_EMPTY", None, None),
    ("The trial took {m} days", ["The trial took {m} days"], [], "UNSUPPORTED", "CLAIM_CITATION_MISSING", None, None),
    ("The trial took {m} days", ["The trial took {m} days", "x"], [2, 1], "UNSUPPORTED", "CLAIM_CITATION_SET_INVALID", None, None),
    ("The trial took {m} days", ["The trial took {m} days", "x"], [3], "UNSUPPORTED", "CLAIM_CITATION_OUT_OF_RANGE", None, None),
    ("The trial took {m} days", [" "], [1], "UNSUPPORTED", "BOUND_EVIDENCE_TEXT_EMPTY", None, None),
    ("The trial took {n} days", ["The trial took {n} days", "The trial took 9{m} days"], [1, 2], "UNSUPPORTED", "BOUND_NUMERIC_CONFLICT_NOT_DISCLOSED", "CONFLICTING_EVIDENCE", "BOUND_NUMERIC_CONFLICT_NOT_DISCLOSED"),
    ("Reports differ: {n} days and 9{m} days for the trial", ["The trial took {n} days", "The trial took 9{m} days"], [1, 2], "CONFLICTING_EVIDENCE", "BOUND_NUMERIC_CONFLICT_DISCLOSED", "CONFLICTING_EVIDENCE", "BOUND_NUMERIC_CONFLICT_DISCLOSED"),
    ("Reports differ: {n} days for the trial", ["The trial took {n} days", "The trial took 9{m} days"], [1, 2], "UNSUPPORTED", "BOUND_NUMERIC_CONFLICT_VALUES_INCOMPLETE", "CONFLICTING_EVIDENCE", "BOUND_NUMERIC_CONFLICT_DISCLOSED"),
    ("Results differ for the trial", ["The trial took {m} days"], [1], "UNSUPPORTED", "CONFLICT_NOT_DETERMINISTICALLY_PROVEN", "INSUFFICIENT_EVIDENCE", "CONFLICT_NOT_DETERMINISTICALLY_PROVEN"),
    ("The trial was not reported", ["The trial took {m} days"], [1], "INSUFFICIENT_EVIDENCE", "SAFE_LIMITATION_WITH_BOUND_EVIDENCE", "INSUFFICIENT_EVIDENCE", "SAFE_LIMITATION_WITH_BOUND_EVIDENCE"),
    ("The trial took {m} weeks", ["The trial took {m} days"], [1], "UNSUPPORTED", "NUMERIC_UNIT_NOT_ESTABLISHED", "INSUFFICIENT_EVIDENCE", "NUMERIC_UNIT_NOT_ESTABLISHED"),
    ("The trial causes growth", ["The trial had growth"], [1], "UNSUPPORTED", "CAUSAL_RELATION_NOT_ESTABLISHED", "INSUFFICIENT_EVIDENCE", "CAUSAL_RELATION_NOT_ESTABLISHED"),
    ("The trial is always long", ["The trial is long"], [1], "UNSUPPORTED", "UNIVERSAL_SCOPE_NOT_ESTABLISHED", "INSUFFICIENT_EVIDENCE", "UNIVERSAL_SCOPE_NOT_ESTABLISHED"),
    ("Alpha is better than beta", ["Alpha was seen with beta"], [1], "UNSUPPORTED", "COMPARISON_NOT_ESTABLISHED", "INSUFFICIENT_EVIDENCE", "COMPARISON_NOT_ESTABLISHED"),
    ("Alpha is better than beta", ["Gamma is superior to delta"], [1], "UNSUPPORTED", "COMPARISON_OBJECTS_NOT_ESTABLISHED", "INSUFFICIENT_EVIDENCE", "COMPARISON_OBJECTS_NOT_ESTABLISHED"),
    ("Alpha is the first drug", ["Alpha is a drug"], [1], "UNSUPPORTED", "NOVELTY_OR_SUPERLATIVE_NOT_ESTABLISHED", "INSUFFICIENT_EVIDENCE", "NOVELTY_OR_SUPERLATIVE_NOT_ESTABLISHED"),
    ("At least two trial arms", ["The trial had two arms"], [1], "UNSUPPORTED", "QUALIFYING_CONDITION_NOT_ESTABLISHED", "INSUFFICIENT_EVIDENCE", "QUALIFYING_CONDITION_NOT_ESTABLISHED"),
    ("Zebra stripes", ["The trial took {m} days"], [1], "UNSUPPORTED", "CORE_LEXICAL_OVERLAP_NOT_ESTABLISHED", "INSUFFICIENT_EVIDENCE", "CORE_LEXICAL_OVERLAP_NOT_ESTABLISHED"),
    ("\t\n\u3000\u00a0", ["The trial took {m} days"], [1], "UNSUPPORTED", "CLAIM_TEXT_EMPTY", None, None),
    ("The trial took {m} days", ["\n\u3000\u2003\r\n"], [1], "UNSUPPORTED", "BOUND_EVIDENCE_TEXT_EMPTY", None, None),
    ("The trial took \uff17 days", ["The trial took {m} days"], [1], "UNSUPPORTED", "NUMERIC_ANCHOR_MISSING_FROM_EVIDENCE", "INSUFFICIENT_EVIDENCE", "NUMERIC_ANCHOR_MISSING_FROM_EVIDENCE"),
    ("The trial took \uff17\u3000days", ["The trial took 7 days"], [1], "SUPPORTED", "DETERMINISTIC_ANCHORS_AND_CORE_OVERLAP_PASS", "SUPPORTED_BY_EVIDENCE_SET", "DETERMINISTIC_EVIDENCE_SET_PASS"),
    ("The trial took {m} days, zebra stripes", ["The trial took {m} days"], [1], "UNSUPPORTED", "CORE_LEXICAL_OVERLAP_NOT_ESTABLISHED", "PARTIALLY_SUPPORTED", "CORE_LEXICAL_OVERLAP_NOT_ESTABLISHED"),
)
_VALID = [i for i, c in enumerate(_CASES) if c[5] is not None]


def _case_claims(spark, sf_dir):
    """Orders as claims, customers as answers."""
    n, m = (10 + F.col("o_custkey") % 5).cast("string"), (10 + F.col("o_orderkey") % 5).cast("string")
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{n}"), n), F.lit("{m}"), m)
    kind = F.col("o_orderkey") % len(_CASES)
    texts = F.array(*[fill(c[0]) for c in _CASES])
    quotes = F.array(*[F.array(*[fill(q) for q in c[1]]) for c in _CASES])
    places = F.array(*[F.array(*[F.lit(p) for p in c[2]]).cast("array<int>") for c in _CASES])
    at = (kind + 1).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("answer_id"), kind.alias("kind"), F.element_at(texts, at).alias("text"), F.element_at(quotes, at).alias("quotes"), F.element_at(places, at).alias("citation_ids"))


def _listed(column: int) -> str:
    return "[" + ", ".join("NULL" if c[column] is None else f"'{c[column]}'" for c in _CASES) + "]"


_VERDICTS = f"""cases AS (SELECT o_orderkey AS claim_id, o_custkey AS answer_id, CAST(o_orderkey % {len(_CASES)} AS INTEGER) AS kind, o_custkey % 5 = o_orderkey % 5 AS same FROM orders),
verdicts AS (SELECT claim_id, answer_id, kind, CASE WHEN kind = 0 THEN CASE WHEN same THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END ELSE {_listed(3)}[kind + 1] END AS status,
  CASE WHEN kind = 0 THEN CASE WHEN same THEN 'DETERMINISTIC_ANCHORS_AND_CORE_OVERLAP_PASS' ELSE 'NUMERIC_ANCHOR_MISSING_FROM_EVIDENCE' END ELSE {_listed(4)}[kind + 1] END AS reason,
  CASE WHEN kind = 0 THEN CASE WHEN same THEN 'SUPPORTED_BY_EVIDENCE_SET' ELSE 'INSUFFICIENT_EVIDENCE' END ELSE {_listed(5)}[kind + 1] END AS set_status,
  CASE WHEN kind = 0 THEN CASE WHEN same THEN 'DETERMINISTIC_EVIDENCE_SET_PASS' ELSE 'NUMERIC_ANCHOR_MISSING_FROM_EVIDENCE' END ELSE {_listed(6)}[kind + 1] END AS set_reason FROM cases)"""


@query(f"WITH {_VERDICTS} SELECT claim_id, status, reason FROM verdicts")
def clm_rules(spark, sf_dir):
    """Every rule of a claim's verdict, in turn."""
    return claims.verify(_case_claims(spark, sf_dir)).select("claim_id", "status", "reason")


@query(f"""WITH {_VERDICTS} SELECT answer_id, count(*) AS n_claims, round(avg(CASE WHEN kind = 2 THEN 0.0 ELSE 1.0 END), 6) AS citation_completeness, round(avg(CASE WHEN status = 'UNSUPPORTED' THEN 1.0 ELSE 0.0 END), 6) AS unsupported_rate,
  bool_or(status = 'UNSUPPORTED') AND bool_or(status <> 'UNSUPPORTED') AS partial FROM verdicts GROUP BY answer_id""")
def clm_rules_report(spark, sf_dir):
    return claims.report(claims.verify(_case_claims(spark, sf_dir)))


@query(f"WITH {_VERDICTS} SELECT claim_id, set_status AS status, set_reason AS reason FROM verdicts WHERE set_status IS NOT NULL")
def clm_set_rules(spark, sf_dir):
    c = _case_claims(spark, sf_dir)
    return claims.verify_set(c.where(F.col("kind").isin(*_VALID))).select("claim_id", "status", "reason")


@query(f"""WITH {_VERDICTS} SELECT answer_id, count(*) AS n_claims, bool_or(set_status = 'CONFLICTING_EVIDENCE') AS has_conflict,
  bool_or(set_status = 'PARTIALLY_SUPPORTED') OR bool_or(set_status = 'SUPPORTED_BY_EVIDENCE_SET') AND bool_or(set_status = 'INSUFFICIENT_EVIDENCE') AS partial FROM verdicts WHERE set_status IS NOT NULL GROUP BY answer_id""")
def clm_set_report(spark, sf_dir):
    c = _case_claims(spark, sf_dir)
    return claims.set_report(claims.verify_set(c.where(F.col("kind").isin(*_VALID))))


@query("""WITH c AS (SELECT o_orderkey AS claim_id, o_orderkey % 3 AS kind, o_custkey % 5 = o_orderkey % 5 AS same FROM orders)
SELECT claim_id, CASE WHEN kind = 0 AND NOT same THEN 'CONFLICTING_EVIDENCE' WHEN kind = 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SUPPORTED_BY_EVIDENCE_SET' END AS status, kind = 1 OR kind = 0 AND NOT same AS expanded,
  CASE WHEN kind = 0 AND NOT same THEN 'BOUND_NUMERIC_CONFLICT_NOT_DISCLOSED,SAME_DOCUMENT_VERSION_ADJACENT_EVIDENCE_ADDED,RETRIEVAL_SCORE_UNCHANGED' WHEN kind = 0 THEN 'DETERMINISTIC_EVIDENCE_SET_PASS'
    WHEN kind = 1 THEN 'DETERMINISTIC_EVIDENCE_SET_PASS,SAME_DOCUMENT_VERSION_ADJACENT_EVIDENCE_ADDED,RETRIEVAL_SCORE_UNCHANGED' ELSE 'CORE_LEXICAL_OVERLAP_NOT_ESTABLISHED' END AS codes FROM c""")
def clm_expanded(spark, sf_dir):
    """Claims with two neighbours, of which the second settles some: a number that differs, a number that was missing, nothing to the point."""
    o = table(spark, sf_dir, "orders")
    n, m = (10 + F.col("o_custkey") % 5).cast("string"), (10 + F.col("o_orderkey") % 5).cast("string")
    took = lambda x: F.concat(F.lit("The trial took "), x, F.lit(" days"))
    kind = F.col("o_orderkey") % 3
    c = o.select(F.col("o_orderkey").alias("claim_id"), F.when(kind == 2, "Zebra stripes").otherwise(took(n)).alias("text"), F.array(F.when(kind == 0, took(m)).otherwise("The trial began")).alias("quotes"), F.array(F.lit(1)).alias("citation_ids"))
    near = o.select(F.col("o_orderkey").alias("claim_id"), F.explode(F.array(F.struct(F.lit(1).alias("position"), F.lit("Nothing here").alias("quote")), F.struct(F.lit(2).alias("position"), took(n).alias("quote")))).alias("x")).select("claim_id", "x.*")
    return claims.with_adjacent(c, near).select("claim_id", "status", "expanded", F.array_join("reason_codes", ",").alias("codes"))


_PAGES = ["A line.\nNext line\n1. Head\nbody", "\u3000Introduction\nText one.\u00a0\n\u00a0\n\u00a0\uff11. Setup\u3000\nmore", "x" * 1000 + "\n" + "y" * 1000 + "\nz", "  \nonly.\nOne\n\ntwo.\nand three"]
_PAGE_BLOCKS = [(0, 0, 7, False), (0, 8, 17, False), (0, 18, 25, True), (0, 26, 30, False), (1, 0, 13, True), (1, 14, 24, False), (1, 27, 37, True), (1, 38, 42, False), (2, 0, 2001, False), (2, 2002, 2003, False), (3, 3, 8, False), (3, 9, 28, False)]


@query("WITH b AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}, {b}, {h})" for k, a, b, h in _PAGE_BLOCKS) + ") AS t(kind, a, b, h)) SELECT n_nationkey, a AS source_start, b AS source_end, h AS is_heading, b - a AS n FROM nation JOIN b ON b.kind = n_nationkey % 4")
def prj_blocks(spark, sf_dir):
    """Four pages whose blocks were found by hand: marks of headings and sentences, blanks and digits beyond ASCII, a long block, blank lines."""
    p = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*[F.lit(x) for x in _PAGES]), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("text"))
    b = chunking.blocks(p, ["n_nationkey"])
    return b.select("n_nationkey", F.col("source_start").cast("int").alias("source_start"), F.col("source_end").cast("int").alias("source_end"), "is_heading", F.length("text").alias("n"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g'), ' ')) AS digest FROM documents")
def fn_squeeze(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 'Infinity'::DOUBLE END ELSE round((p_partkey % 3 - p_size % 7)::DOUBLE / (p_size % 7), 6) END AS gain FROM part")
def fn_relative_gain(spark, sf_dir):
    c, b = (F.col("p_partkey") % 3).cast("double"), (F.col("p_size") % 7).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.relative_gain(c, b), 6).alias("gain"))


_TIMES = "t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN '2024-02-30' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00Z' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00' END AS s, o_orderdate FROM orders)"


@query(f"WITH {_TIMES} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 5 = 3 AS zoned FROM t")
def fn_dates(spark, sf_dir):
    """Dates in and out of form, a day that doesn't exist, times with and without a zone."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, day).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, "2024-02-30").when(k == 3, F.concat(day, F.lit("T10:00:00Z"))).otherwise(F.concat(day, F.lit("T10:00:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", S.iso_date(F.col("s")).cast("string").alias("day"), S.has_zone(F.col("s")).alias("zoned"))


_PRIORITIES = ("3-MEDIUM", "1-URGENT", "5-LOW")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END, o_orderkey) AS INTEGER) AS position FROM orders")
def win_enum_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return checks.numbered(o, ["o_custkey"], [S.enum_place(F.col("o_orderpriority"), _PRIORITIES), "o_orderkey"]).select("o_orderkey", "position")


@query("SELECT vec_id, round(list_sum(list_transform(CAST(list_transform(embedding, lambda x: x * 3.0::DOUBLE) AS FLOAT[]), lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def vec_float32(spark, sf_dir):
    tripled = dense.as_float32(F.transform("embedding", lambda x: x.cast("double") * 3.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(tripled, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


_SEEN = "list_contains(['s' || CAST(v.vec_id % 3 AS VARCHAR), 's' || CAST(v.label % 2 AS VARCHAR)], q.scope)"


@query(f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id, e, 's' || CAST(vec_id % 2 AS VARCHAR) AS scope FROM v WHERE vec_id % 20 = 0),
n AS (SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM q JOIN v ON q.vec_id <> v.vec_id AND {_SEEN})
SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM n WHERE score >= 0.1) WHERE rank <= 5""")
def vec_ann_topk(spark, sf_dir):
    """Cells with as many probes as cells, so exact; what a scope may not see is left out before the cut."""
    e = table(spark, sf_dir, "embeddings")
    name = lambda x: F.concat(F.lit("s"), x.cast("string"))
    held = e.withColumn("visible", F.array(name(F.col("vec_id") % 3), name(F.col("label") % 2)))
    asked = e.where("vec_id % 20 = 0").withColumn("scope", name(F.col("vec_id") % 2))
    return dense.ann_top_k(asked, held, 5, 0.1, cell_size=100, probes=1 << 14, scope_col="scope", visible_col="visible", same=False)


@query(f"WITH {R._RANKS}, s AS (SELECT question_id, chunk_id, rank FROM rrf WHERE rank <= 10 AND rank % 3 = question_id % 3) SELECT question_id, chunk_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank) AS INTEGER) AS rank FROM s")
def fus_selection(spark, sf_dir):
    ranked = fusion.rrf(R.two_rankings(spark, sf_dir), top=10).checkpoint()
    return fusion.apply_selection(ranked, ranked.where(F.col("rank") % 3 == F.col("question_id") % 3)).select("question_id", "chunk_id", "rank")


@query(f"WITH {R._RANKS}, r AS (SELECT question_id, chunk_id, rank FROM rrf WHERE rank <= 10) SELECT question_id, chunk_id, 'REPEATED' AS code FROM r WHERE rank = 2 UNION ALL SELECT DISTINCT question_id, 'foreign', 'FOREIGN' FROM r WHERE question_id % 2 = 0")
def fus_selection_errors(spark, sf_dir):
    ranked = fusion.rrf(R.two_rankings(spark, sf_dir), top=10).select("question_id", "chunk_id", "rank").checkpoint()
    chosen = ranked.union(ranked.where("rank = 2")).union(ranked.where("question_id % 2 = 0 and rank = 1").withColumn("chunk_id", F.lit("foreign")))
    return fusion.selection_errors(ranked, chosen)


_ALIASES = "a AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4 = 0 THEN 'Alias ' ELSE 'alias ' END || CAST(c_custkey // 3 AS VARCHAR) AS alias FROM customer WHERE c_custkey % 3 <> 1)"


def _aliases(spark, sf_dir):
    start = F.when(F.col("c_custkey") % 4 == 0, "Alias ").otherwise("alias ")
    return table(spark, sf_dir, "customer").where("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("document_id"), F.concat(start, F.floor(F.col("c_custkey") / 3).cast("string")).alias("alias"))


@query(f"WITH {_ALIASES} SELECT lower(alias) AS alias, count(DISTINCT document_id) AS n_documents FROM a GROUP BY lower(alias) HAVING count(DISTINCT document_id) > 1")
def fus_ambiguous_aliases(spark, sf_dir):
    return decompose.ambiguous_aliases(_aliases(spark, sf_dir))


@query(f"WITH {_ALIASES} SELECT 'n' || CAST(document_id AS VARCHAR) AS document_id, alias FROM a WHERE document_id % 2 = 0")
def fus_remapped_aliases(spark, sf_dir):
    m = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("new_document_id"))
    return decompose.remapped_aliases(_aliases(spark, sf_dir), m)


_LEASES = """e AS (SELECT 'j' || CAST(user_id AS VARCHAR) AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'ENQUEUED' WHEN 'view' THEN 'CLAIMED' WHEN 'click' THEN 'CLAIMED' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS kind, 'l' || CAST(event_id % 3 AS VARCHAR) AS lease_token FROM events),
p AS (SELECT *, max(CASE WHEN kind = 'CLAIMED' THEN o END) OVER (PARTITION BY job_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS claim FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS o FROM e)),
v AS (SELECT p.*, p.kind IN ('FAILED', 'COMPLETED') AND c.lease_token = p.lease_token AS good FROM p LEFT JOIN p c ON c.job_id = p.job_id AND c.o = p.claim),
f AS (SELECT * FROM v WHERE kind IN ('ENQUEUED', 'CLAIMED') OR good AND o = (SELECT min(w.o) FROM v w WHERE w.job_id = v.job_id AND w.claim = v.claim AND w.good))"""


def _lease_events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "ENQUEUED").when(F.col("event_type").isin("view", "click"), "CLAIMED").when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"), F.concat(F.lit("l"), (F.col("event_id") % 3).cast("string")).alias("lease_token"))


@query(f"WITH {_LEASES} SELECT job_id, count(*) FILTER (kind = 'CLAIMED') AS attempts, CASE WHEN bool_or(kind = 'COMPLETED') THEN 'SUCCEEDED' WHEN arg_max(kind, o) = 'FAILED' AND count(*) FILTER (kind = 'CLAIMED') >= 5 THEN 'FAILED' WHEN arg_max(kind, o) = 'FAILED' THEN 'RETRY' WHEN arg_max(kind, o) = 'CLAIMED' THEN 'RUNNING' ELSE 'PENDING' END AS status FROM f GROUP BY job_id")
def lif_fenced_queue(spark, sf_dir):
    """Reports of workers whose lease has passed to another don't count."""
    return lifecycle.queue_state(lifecycle.fenced(_lease_events(spark, sf_dir))).select("job_id", "attempts", "status")


@query(f"WITH {_LEASES} SELECT event_id FROM f WHERE kind IN ('FAILED', 'COMPLETED')")
def lif_fencing(spark, sf_dir):
    return lifecycle.fenced(_lease_events(spark, sf_dir)).where("kind in ('FAILED', 'COMPLETED')").select("event_id")


def _owned(spark, sf_dir):
    """Orders as versions: customer, order and status; of some the status or the version changes afterwards."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("document_id"), F.lit("v1").alias("version_id"), F.when(F.col("o_orderstatus") == "O", "READY").otherwise("INACTIVE").alias("lifecycle_status"), (F.col("o_orderstatus") == "O").alias("is_active"))


@query("SELECT o_custkey AS owner_id, NOT bool_or(o_orderkey % 17 = 0) AS unchanged FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def lif_revalidated(spark, sf_dir):
    v = _owned(spark, sf_dir)
    routes = v.where("lifecycle_status = 'READY'").select("owner_id", "document_id", "version_id")
    later = v.withColumn("version_id", F.when(F.col("document_id") % 17 == 0, "v2").otherwise(F.col("version_id")))
    return lifecycle.revalidated(routes, later)


@query("SELECT l_orderkey || '-' || l_linenumber AS chunk_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderstatus = 'O') AND o_orderstatus = 'O' AND o_orderkey % 5 <> 0")
def jn_online_chunks(spark, sf_dir):
    """Three keys and the filters of READY: the chunks of one owner's orders."""
    v = _owned(spark, sf_dir).withColumns({"deleted_at": F.when(F.col("document_id") % 5 == 0, "2024-01-01"), "expired_at": F.lit(None).cast("string")})
    first = v.where("lifecycle_status = 'READY'").agg(F.min("owner_id")).first()[0]
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id"), F.col("l_orderkey").alias("document_id"), F.lit("v1").alias("version_id"))
    owned = lines.join(v.select("document_id", "owner_id"), "document_id")
    return lifecycle.online_chunks(owned, v, first).select("chunk_id")


@query("SELECT n_name AS migration_id, CASE WHEN n_nationkey % 3 = 0 THEN 'APPLY' WHEN n_nationkey % 5 = 0 THEN 'DRIFT' ELSE 'SKIP' END AS action FROM nation")
def lif_migrations(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    wanted = n.select(F.col("n_name").alias("migration_id"), F.sha2("n_name", 256).alias("sha256"))
    applied = n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("migration_id"), F.sha2(F.when(F.col("n_nationkey") % 5 == 0, "old").otherwise(F.col("n_name")), 256).alias("sha256"))
    return lifecycle.migration_plan(wanted, applied)


_STEPS = ("REGISTER", "PARSE", "EMBED", "INDEX", "VERIFY")


@query("""WITH c AS (SELECT c_custkey, c_custkey % 5 AS done, c_custkey % 7 AS bad FROM customer)
SELECT c_custkey AS version_id, CASE WHEN bad <= done THEN 'FAILED' WHEN done = 4 THEN 'READY' ELSE 'PROCESSING' END AS status, CASE WHEN bad <= done THEN CASE WHEN c_custkey % 2 = 0 THEN 'STEP_BROKE' ELSE 'UNEXPECTED_FAILURE' END END AS failure_code,
  CASE WHEN bad <= done THEN ['REGISTER', 'PARSE', 'EMBED', 'INDEX', 'VERIFY'][CAST(bad + 1 AS BIGINT)] END AS failed_step FROM c""")
def lif_ingestion(spark, sf_dir):
    """Customers as ingestions that have come to some step; one step of each may have failed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("version_id"), F.posexplode(F.array(*[F.lit(s) for s in _STEPS])).alias("p", "step"))
    key = F.col("version_id")
    ok = F.col("p") != key % 7
    steps = c.where(F.col("p") <= key % 5).select("version_id", "step", ok.alias("ok"), F.when(~ok & (key % 2 == 0), "STEP_BROKE").alias("failure_code"))
    return lifecycle.ingestion_outcomes(steps)


@query("SELECT (SELECT count(*) FROM nation) AS n_first, (SELECT count(*) FROM region) AS n_second, true AS failed, false AS left_behind")
def snk_publish_all(spark, sf_dir):
    """Two tables published together; then two of which the second fails its check, so that neither stays."""
    at = _shared(spark, "together")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    good = sinks.publish_all({f"{at}/a": n, f"{at}/b": r})

    def refuse(_):
        raise ValueError("refused")

    try:
        sinks.publish_all({f"{at}/c": n, f"{at}/d": r}, {f"{at}/d": refuse})
        failed = False
    except ValueError:
        failed = True
    left = sinks.exists(spark, f"{at}/c") or sinks.exists(spark, f"{at}/d")
    both = good[f"{at}/a"].agg(F.count(F.lit(1)).alias("n_first")).crossJoin(good[f"{at}/b"].agg(F.count(F.lit(1)).alias("n_second")))
    return both.select("*", F.lit(failed).alias("failed"), F.lit(left).alias("left_behind"))


def _quotas(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("place"), F.col("n_name").alias("value"), (F.col("n_nationkey") % 4).cast("long").alias("n"))


_QUOTA = "x AS (SELECT n_nationkey, n_name AS value, unnest(range(CAST(n_nationkey % 4 AS BIGINT))) AS i FROM nation WHERE n_nationkey % 4 > 0), quota AS (SELECT row_number() OVER (ORDER BY n_nationkey, i) - 1 AS position, value FROM x)"


@query(f"WITH {_QUOTA} SELECT position, value FROM quota")
def cor_quota(spark, sf_dir):
    q = _quotas(spark, sf_dir)
    return corpus.expanded_quota(q, q.agg(F.sum("n")).first()[0])


@query(f"WITH {_QUOTA} SELECT row_number() OVER (ORDER BY sha256('seed:' || CAST(position AS VARCHAR))) - 1 AS position, value FROM quota")
def cor_shuffled_quota(spark, sf_dir):
    with_checkpoints(spark)
    q = _quotas(spark, sf_dir)
    return corpus.shuffled_quota(q, q.agg(F.sum("n")).first()[0], "seed")


@query("""WITH s AS (SELECT item_id AS position, ['security', 'none', 'multi_hop', 'comparison', 'fact'][item_id % 5 + 1] AS kind FROM benchmark),
a AS (SELECT *, CASE kind WHEN 'security' THEN 'FORBIDDEN' WHEN 'none' THEN 'NO_EVIDENCE' END AS v FROM s),
b AS (SELECT position, kind, CASE WHEN v IS NULL AND kind IN ('multi_hop', 'comparison') AND count(*) FILTER (v IS NULL AND kind IN ('multi_hop', 'comparison')) OVER (ORDER BY position) <= 6 THEN 'CONFLICTING_EVIDENCE' ELSE v END AS v FROM a),
c AS (SELECT position, kind, CASE WHEN v IS NULL AND count(*) FILTER (v IS NULL) OVER (ORDER BY position) <= 5 THEN 'PARTIALLY_ANSWERABLE' ELSE v END AS v FROM b) SELECT position, kind, coalesce(v, 'ANSWERABLE') AS value FROM c""")
def cor_assignment(spark, sf_dir):
    with_checkpoints(spark)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("security", "none", "multi_hop", "comparison", "fact")]), (F.col("item_id") % 5 + 1).cast("int"))
    slots = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("position"), kind.alias("kind"))
    return corpus.constrained_assignment(slots, {"security": "FORBIDDEN", "none": "NO_EVIDENCE"}, [(("multi_hop", "comparison"), "CONFLICTING_EVIDENCE", 6), (None, "PARTIALLY_ANSWERABLE", 5)], "ANSWERABLE")


_BREAKS = ("QUEUE_ENTRY_MISSING", "REVIEW_ID_DRIFT", "PROPOSAL_HASH_DRIFT", "OUTCOME_INCOMPLETE", "CHECK_IDENTITY_DRIFT", "CHECK_PENDING", "APPROVED_LABELS_DIFFER", "APPROVED_WITH_FAILED_CHECK", "EDIT_WITHOUT_CHANGE", "EDIT_WITHOUT_FAILED_CHECK", "REVIEWER_MISSING", "REVIEW_TIME_WITHOUT_ZONE", "JUDGMENT_OF_UNKNOWN_CHUNK", "CHUNK_IDENTITY_DRIFT", "UNKNOWN_CLAIM", "CITATION_OUTSIDE_EVIDENCE")


@query(f"SELECT c_custkey AS question_id, [{', '.join(repr(b) for b in _BREAKS)}][CAST(c_custkey % 19 + 1 AS BIGINT)] AS code FROM customer WHERE c_custkey % 19 < {len(_BREAKS)}")
def cor_decisions(spark, sf_dir):
    """Decisions that break one rule each, in turn; three of nineteen break none: approved, edited, approved with a later check."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), (F.col("c_custkey") % 19).alias("k"))
    k = lambda *names: F.col("k").isin(*[_BREAKS.index(n) for n in names])
    piece = lambda name, page: F.struct(F.lit(name).alias("chunk_id"), F.lit("d").alias("document_id"), page.alias("page_start"), F.lit(1).alias("page_end"))
    entry = c.where(~k("QUEUE_ENTRY_MISSING")).select("question_id", F.lit("r").alias("review_id"), F.lit("h").alias("labels_sha256"), F.array(F.lit("a"), F.lit("b")).alias("check_names"), F.lit("P").alias("proposal"), F.array(piece("c1", F.lit(1)), piece("c2", F.lit(1))).alias("evidence"))
    edits = k("EDIT_WITHOUT_CHANGE", "EDIT_WITHOUT_FAILED_CHECK") | (F.col("k") == 17)
    result = F.when(k("CHECK_PENDING"), "PENDING").when(k("APPROVED_WITH_FAILED_CHECK", "EDIT_WITHOUT_CHANGE") | (F.col("k") == 17), "FAIL").otherwise("PASS")
    judged = F.struct(F.when(k("JUDGMENT_OF_UNKNOWN_CHUNK"), "c9").otherwise("c1").alias("chunk_id"), F.lit("d").alias("document_id"), F.when(k("CHUNK_IDENTITY_DRIFT"), 7).otherwise(1).alias("page_start"), F.lit(1).alias("page_end"), F.array(F.when(k("UNKNOWN_CLAIM"), "x9").otherwise("x1")).alias("supports_claims"))
    decisions = c.select(
        "question_id",
        F.when(k("REVIEW_ID_DRIFT"), "other").otherwise("r").alias("review_id"),
        F.when(k("PROPOSAL_HASH_DRIFT"), "other").otherwise("h").alias("labels_sha256"),
        F.when(k("OUTCOME_INCOMPLETE"), "REJECT").when(edits, "EDIT_LABELS").otherwise("APPROVE_AS_IS").alias("outcome"),
        F.create_map(F.lit("a"), result, F.when(k("CHECK_IDENTITY_DRIFT"), "z").otherwise("b"), F.lit("PASS")).alias("checks"),
        F.when(k("APPROVED_LABELS_DIFFER", "EDIT_WITHOUT_FAILED_CHECK") | (F.col("k") == 17), "Q").otherwise("P").alias("corrected"),
        F.when(~k("REVIEWER_MISSING"), "someone").alias("reviewer_id"),
        F.when(k("REVIEW_TIME_WITHOUT_ZONE"), "2024-01-01T10:00:00").otherwise("2024-01-01T10:00:00+02:00").alias("reviewed_at"),
        F.array(judged).alias("judged"),
        F.array(F.lit("x1")).alias("claim_ids"),
        F.array(F.when(k("CITATION_OUTSIDE_EVIDENCE"), "c9").otherwise("c2")).alias("citations"),
    )
    return corpus.decision_errors(decisions, entry)


@query("""SELECT 'ROW_COUNT' AS code, CAST(count(*) AS VARCHAR) AS detail FROM benchmark HAVING count(*) <> 7 UNION ALL SELECT 'SPLIT', 'test' FROM (SELECT 1 FROM benchmark WHERE item_id % 11 = 3 LIMIT 1)
UNION ALL SELECT 'REQUIRED_MISSING', '-5' UNION ALL SELECT 'CATEGORY_COUNT', 'ANSWERABLE' FROM benchmark WHERE item_id % 3 <> 0 HAVING count(*) <> 9 UNION ALL SELECT 'CATEGORY_COUNT', 'NO_EVIDENCE' FROM benchmark WHERE item_id % 3 = 0 HAVING count(*) <> 3 UNION ALL SELECT 'CATEGORY_COUNT', 'FORBIDDEN'""")
def cor_frozen_input(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 11 == 3, "test").otherwise("dev").alias("split"), F.when(F.col("item_id") % 3 == 0, "NO_EVIDENCE").otherwise("ANSWERABLE").alias("category"))
    required = rows.where("question_id % 10 = 0").select("question_id").union(spark.createDataFrame([(-5,)], "question_id long"))
    return corpus.frozen_input_errors(rows, "dev", 7, required, {"ANSWERABLE": 9, "NO_EVIDENCE": 3, "FORBIDDEN": 3})


@query("SELECT vec_id AS id, 'group=g' || CAST(label AS VARCHAR) || ';split=' || ['dev', 'test'][CAST(vec_id % 2 + 1 AS BIGINT)] AS provenance FROM embeddings WHERE vec_id % 3 <> 0")
def cor_formal_records(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    groups = e.select("id", F.concat(F.lit("g"), F.col("label").cast("string")).alias("group_id"))
    splits = e.where("id % 3 <> 0").select("id", F.when(F.col("id") % 2 == 0, "dev").otherwise("test").alias("assigned_split"))
    return corpus.formal_records(e, groups, splits).select("id", "provenance")


def _metric_report(spark, sf_dir):
    found = _found(spark, sf_dir)
    it = items(spark, sf_dir)
    results = _results(spark, sf_dir, lexical.best_of(found, 20)).withColumn("latency_ms", F.when(F.col("backend") == "bm25", F.col("question_id") * 2.0).otherwise(F.col("question_id") * 1.0))
    return evaluation.metrics_report(evaluation.macro_metrics(_per_question(spark, sf_dir, found), it), evaluation.refusal_metrics(results, it), results)


_REPORT = f"""{_METRICS}, {_RESULTS}, j AS (SELECT *, answerability IN ('ANSWERABLE', 'PARTIALLY_ANSWERABLE', 'CONFLICTING_EVIDENCE') AS e FROM results JOIN items USING (question_id)),
rates AS (SELECT backend, round(count(*) FILTER (decision = 'NO_EVIDENCE' AND answerability = 'NO_EVIDENCE') / nullif(count(*) FILTER (answerability = 'NO_EVIDENCE'), 0), 6) AS no_answer_recall,
  round(count(*) FILTER (decision = 'NO_EVIDENCE' AND answerability = 'NO_EVIDENCE') / nullif(count(*) FILTER (decision = 'NO_EVIDENCE'), 0), 6) AS refusal_precision, round(count(*) FILTER (decision <> 'EVIDENCE_FOUND' AND e) / nullif(count(*) FILTER (e), 0), 6) AS wrong_refusal_rate,
  round(count(*) FILTER (decision = 'FORBIDDEN' AND answerability = 'FORBIDDEN') / nullif(count(*) FILTER (answerability = 'FORBIDDEN'), 0), 6) AS forbidden_block_rate,
  round(quantile_cont((CASE backend WHEN 'bm25' THEN 2 ELSE 1 END * question_id)::DOUBLE, 0.5), 6) AS latency_ms_p50, round(quantile_cont((CASE backend WHEN 'bm25' THEN 2 ELSE 1 END * question_id)::DOUBLE, 0.95), 6) AS latency_ms_p95 FROM j GROUP BY backend),
report AS (SELECT backend, metric || '@' || CAST(k AS VARCHAR) AS metric, value FROM macro UNPIVOT INCLUDE NULLS (value FOR metric IN (recall, "precision", mrr, ndcg))
  UNION ALL SELECT backend, metric, value FROM rates UNPIVOT INCLUDE NULLS (value FOR metric IN (no_answer_recall, refusal_precision, wrong_refusal_rate, forbidden_block_rate, latency_ms_p50, latency_ms_p95)))"""


@query(f"WITH {_REPORT} SELECT backend, metric, value FROM report")
def evl_report(spark, sf_dir):
    return _metric_report(spark, sf_dir)


@query(f"WITH {_REPORT} SELECT a.backend AS candidate, b.backend AS baseline, metric, round(a.value - b.value, 6) AS delta FROM report a JOIN report b USING (metric) WHERE a.backend <> b.backend AND a.value IS NOT NULL AND b.value IS NOT NULL")
def evl_comparisons(spark, sf_dir):
    return evaluation.comparisons(_metric_report(spark, sf_dir).checkpoint())


@query(f"WITH {ITEMS} SELECT 'DATASET_VERSION' AS code, 'a' AS backend, CAST(question_id AS VARCHAR) AS question_id FROM items WHERE question_id % 6 = 0 UNION ALL SELECT 'LABEL', 'a', CAST(question_id AS VARCHAR) FROM items WHERE question_id % 9 = 0 UNION ALL SELECT 'EXTRA', 'a', '-1'")
def evl_run_identity(spark, sf_dir):
    it = items(spark, sf_dir).select(F.col("question_id").cast("string").alias("question_id"))
    n = F.col("question_id").cast("int")
    r = it.union(spark.createDataFrame([("-1",)], "question_id string")).select("question_id", F.lit("a").alias("backend"), F.lit("r").alias("run_id"), F.lit(50).alias("top_k"), F.when((n >= 0) & (n % 6 == 0), "v0").otherwise("v1").alias("dataset_version"), F.when((n >= 0) & (n % 9 == 0), "b").otherwise("a").alias("run_label"))
    return evaluation.coverage_errors(it, r, 50, "v1")


@query("""SELECT p_partkey AS key, unnest(list_filter([CASE WHEN p_size > 45 THEN 'VALUE_OUT_OF_RANGE:treatment' END, CASE WHEN p_partkey % 6 = 0 THEN 'VALUE_OUT_OF_RANGE:gain' END, CASE WHEN p_partkey % 6 = 0 OR p_partkey % 4 = 0 THEN 'GAIN_ARITHMETIC:gain' END], lambda x: x IS NOT NULL)) AS code FROM part""")
def evl_adjudication(spark, sf_dir):
    """Parts as paired reports: a value out of range, a gain that is missing, one that isn't the difference."""
    c, t = F.lit(10.0), F.col("p_size").cast("double")
    gain = F.when(F.col("p_partkey") % 6 != 0, t - c + F.when(F.col("p_partkey") % 4 == 0, 0.5).otherwise(0.0))
    r = table(spark, sf_dir, "part").select("p_partkey", c.alias("control"), t.alias("treatment"), gain.alias("gain"))
    return evaluation.report_errors(r, {"treatment": (0.0, 45.0), "gain": (-100.0, 100.0)}, {"gain": ("treatment", "control")})


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 40 AS a, o_orderkey % 40 + 2 AS b, o_orderkey % 101 = 0 AS other FROM orders), c AS (SELECT DISTINCT o_custkey FROM orders)
SELECT o_custkey AS case_id, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.o_custkey = c.o_custkey AND other) THEN 'EVIDENCE_IDENTITY_FAILED' WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = c.o_custkey AND a <= 5 AND b >= 3) OR NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = c.o_custkey AND a <= 30 AND b >= 20) THEN 'LOCATION_GATE_FAILED' END AS code FROM c""")
def evl_location_gate(spark, sf_dir):
    """Customers as cases, their orders as evidence on pages; pages 3 to 5 and 20 to 30 are required."""
    o = table(spark, sf_dir, "orders")
    page = F.col("o_orderkey") % 40
    e = o.select(F.col("o_custkey").alias("case_id"), F.lit("d").alias("document_id"), F.when(F.col("o_orderkey") % 101 == 0, "v0").otherwise("v1").alias("version_id"), page.alias("page_start"), (page + 2).alias("page_end"))
    ranges = F.explode(F.array(F.struct(F.lit(3).alias("page_start"), F.lit(5).alias("page_end")), F.struct(F.lit(20).alias("page_start"), F.lit(30).alias("page_end"))))
    required = o.select(F.col("o_custkey").alias("case_id")).distinct().select("case_id", F.lit("d").alias("document_id"), F.lit("v1").alias("version_id"), ranges.alias("r")).select("case_id", "document_id", "version_id", "r.*")
    return evaluation.location_gate(e, required)


@query("SELECT 'KEEP' AS decision, (SELECT count(*) FROM benchmark) AS baseline_passed, (SELECT count(*) FROM benchmark WHERE item_id % 8 <> 0) AS candidate_passed, (SELECT count(*) FROM benchmark) AS n_cases")
def evl_model_selection(spark, sf_dir):
    """Two replays of every case and model; the candidate misses citations in one replay of some."""
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.explode(F.array(F.lit("base"), F.lit("new"))).alias("model")).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    bad = (F.col("model") == "new") & (F.col("case_id") % 8 == 0) & (F.col("attempt") == 2)
    yes = F.lit(True)
    return evaluation.model_selection(a.select("model", "case_id", "attempt", F.lit(None).cast("string").alias("error"), yes.alias("identity_ok"), (~bad).alias("citations_ok"), yes.alias("terms_ok"), yes.alias("forbidden_absent")), "base", "new")


@query("""WITH e AS (SELECT user_id AS case_id, count(*) AS repetitions, bool_and(event_type = 'click' OR user_id % 2 = 0) AS kept, count(DISTINCT user_id % 5) = 1 AS stable, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY user_id)
SELECT case_id, repetitions, stable, p95_ms, stable AND p95_ms <= 200 AND repetitions BETWEEN 30 AND 1000 AND kept AS passed FROM e""")
def evl_plan_rules(spark, sf_dir):
    """Users as cases: clicks are treatments, everything else a control whose query is the question for even users only."""
    e = table(spark, sf_dir, "events")
    arm = F.when(F.col("event_type") == "click", "treatment").otherwise("control")
    p = e.select(F.col("user_id").alias("case_id"), (F.col("user_id") % 5).cast("string").alias("plan_hash"), F.col("value").alias("elapsed_ms"), arm.alias("arm"), F.lit("APPLIED").alias("status"), F.lit("q").alias("question"), F.when(F.col("user_id") % 2 == 0, "q").otherwise("other").alias("query"))
    return evaluation.plan_determinism(p, 200.0, (30, 1000))


@query("SELECT user_id AS request_id, count(*) AS n_routes, CAST(sum(event_id % 10) AS BIGINT) AS search_ms, CAST(sum(user_id % 7) AS BIGINT) AS embed_ms FROM events GROUP BY user_id")
def agg_route_work(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), (F.col("event_id") % 10).alias("search_ms"), (F.col("user_id") % 7).alias("embed_ms"))
    return evaluation.route_work(e, ["search_ms", "embed_ms"])


@query("SELECT 'OWNER' AS reach, o_orderpriority, count(*) AS n FROM orders WHERE o_custkey = 1 GROUP BY ALL UNION ALL SELECT 'GLOBAL_OPEN', o_orderpriority, count(*) FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL")
def agg_scoped_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "owner_id").withColumn("status", F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("PENDING"))
    return summaries.scoped_counts(o, ["o_orderpriority"], 1)


@query("SELECT doc_id, CAST(i AS INTEGER) AS section FROM (SELECT doc_id, doc_id % 700 AS p, unnest(range(5)) AS i FROM documents) WHERE p >= 100 * i AND p < 100 * i + 90")
def jn_point_interval(spark, sf_dir):
    """Five sections of 90 characters with gaps; a point in a gap or behind them is in none."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 700).alias("offset"))
    i = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("section")).select("doc_id", "section", (F.col("section") * 100).alias("low"), (F.col("section") * 100 + 90).alias("high"))
    return checks.containing(d, i, "doc_id").select("doc_id", "section")


@query("SELECT count(*) FILTER (item_id % 5 = 0) AS n FROM benchmark")
def lex_blank_questions(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("question", F.when(F.col("question_id") % 5 == 0, " \t ").when(F.col("question_id") % 5 == 1, "the of").otherwise(F.col("question")))
    return lexical.blank_questions(q).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {R._POSTINGS} SELECT token, CAST(sum(tf_body) AS BIGINT) AS n FROM postings GROUP BY token")
def src_postings(spark, sf_dir):
    """The index written with its facts, then opened against them."""
    at = _shared(spark, "index")
    lexical.write_index(lexical.postings(chunks(spark, sf_dir), R._fields()), at, "corpus-1")
    return lexical.open_index(spark, at, "corpus-1").groupBy("token").agg(F.sum("tf_body").alias("n"))


def _json(spark, name, rows):
    """One JSON document of a few rows, as a caller's file would be; returns its folder."""
    at = _shared(spark, name)
    spark.createDataFrame([(json.dumps(rows),)], "value string").coalesce(1).write.text(at)
    return at


@query("SELECT 'k' || CAST(r_regionkey AS VARCHAR) AS chunk_id, r_name AS text, CAST(r_regionkey AS INTEGER) AS page_start FROM region")
def src_chunks(spark, sf_dir):
    """A JSON array of chunks, read with the chunk's schema."""
    rows = [{"chunk_id": f"k{r['r_regionkey']}", "text": r["r_name"], "page_start": r["r_regionkey"]} for r in table(spark, sf_dir, "region").toLocalIterator()]
    return readers.chunks(spark, _json(spark, "chunks", rows)).select("chunk_id", "text", "page_start")


@query("SELECT 'u1' AS user_id, 2::BIGINT AS n_libraries, false AS include_public")
def src_scope(spark, sf_dir):
    at = _json(spark, "scope", {"user_id": "u1", "tenant_id": "t", "acl_version": "1", "library_ids": ["a", "b"], "folder_ids": [], "document_ids": [], "include_public": False})
    return readers.scope(spark, at).select("user_id", F.size("library_ids").cast("long").alias("n_libraries"), "include_public")


@query("SELECT CAST(item_id AS VARCHAR) AS question_id, CAST(item_id % 4 AS INTEGER) AS n FROM benchmark")
def src_rankings(spark, sf_dir):
    at = _shared(spark, "rankings")
    one = lambda i: F.struct(i.cast("int").alias("rank"), F.concat(F.lit("k"), i.cast("string")).alias("chunk_id"), F.lit("d").alias("document_id"), F.lit(1.0).alias("score"))
    n = (F.col("item_id") % 4).cast("int")
    some = F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), one), lambda c: c["rank"] <= n)
    sinks.write_jsonl(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.lit("r").alias("run_id"), F.lit("a").alias("backend"), some.alias("candidates")), at)
    return readers.rankings(spark, at).select("question_id", F.size("candidates").alias("n"))


@query("SELECT CAST(item_id AS VARCHAR) AS case_id, item_id % 3 = 0 AS refused FROM benchmark")
def src_cases(spark, sf_dir):
    at = _shared(spark, "cases")
    kind = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("category", T.StringType())])
    sinks.write_jsonl(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.when(F.col("item_id") % 3 == 0, "NO_EVIDENCE").otherwise("ANSWERABLE").alias("category")), at)
    return readers.cases(spark, at, kind).select("case_id", (F.col("category") == "NO_EVIDENCE").alias("refused"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS document_id, n_name AS title FROM nation")
def src_titles(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), F.struct(F.col("n_nationkey").cast("string").alias("document_id"), F.col("n_name").alias("title")).alias("d"))
    return readers.titles(n.groupBy("r").agg(F.collect_list("d").alias("documents")))


@query("SELECT CAST(item_id AS VARCHAR) AS question_id, ['dev', 'test'][CAST(item_id % 2 + 1 AS BIGINT)] AS split FROM benchmark")
def src_manifest(spark, sf_dir):
    """Items whose file must have the digest that the manifest names."""
    at = _shared(spark, "formal")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.when(F.col("item_id") % 2 == 0, "dev").otherwise("test").alias("split"))
    b.orderBy("question_id").coalesce(1).write.json(f"{at}/items")  # a few hundred items, one file
    file = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{at}/items").select("path", F.sha2("content", 256).alias("h")).first()
    spark.createDataFrame([(json.dumps({"items_path": file["path"].rsplit("/", 1)[-1], "items_sha256": file["h"]}),)], "value string").coalesce(1).write.text(f"{at}/manifest")
    return readers.manifest(spark, f"{at}/manifest", f"{at}/items")[1].select("question_id", "split")


@query("SELECT count(*) AS n, count(*) FILTER (page_id % 2 = 0) AS n_bad FROM pages")
def src_binary(spark, sf_dir):
    """Files by signature and size: pages written one a file, half of them without the signature."""
    at = _shared(spark, "files")
    p = table(spark, sf_dir, "pages").select(F.concat(F.when(F.col("page_id") % 2 == 0, "<html>").otherwise("%PDF-1"), F.col("page_id").cast("string")).alias("value"))
    sinks.write_files(p, at)
    d = readers.binary_documents(spark, at, "*.txt")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") == "SIGNATURE_INVALID").alias("n_bad"))


_ACTIVE = CHUNKS.replace("chunks AS (", "all_chunks AS (", 1) + ", chunks AS (SELECT * FROM all_chunks WHERE is_active)"


_ANSWERED = f"""WITH {R._POSTINGS.replace(CHUNKS, _ACTIVE)}, {SCOPES}, numbered AS (SELECT *, row_number() OVER (ORDER BY scope_id) - 1 AS i, count(*) OVER () AS many FROM scopes),
first_doc AS (SELECT source AS tenant_id, 'd' || lpad(CAST(min(doc_id) AS VARCHAR), 10, '0') AS d FROM documents GROUP BY source),
base AS (SELECT b.item_id AS question_id, b.item_id % 4 = 0 AS named, f.d, n.* FROM benchmark b JOIN numbered n ON n.i = b.item_id % n.many JOIN first_doc f USING (tenant_id)),
refused AS (SELECT question_id FROM base s WHERE named AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = s.d AND {VISIBLE})),
own AS (SELECT question_id, tenant_id, include_public, CASE WHEN named THEN [d] ELSE document_ids END AS document_ids, CASE WHEN named THEN CAST([] AS VARCHAR[]) ELSE library_ids END AS library_ids, CASE WHEN named THEN CAST([] AS VARCHAR[]) ELSE folder_ids END AS folder_ids FROM base WHERE question_id NOT IN (SELECT question_id FROM refused)),
seen AS (SELECT s.question_id, c.chunk_id FROM own s JOIN chunks c ON {VISIBLE}),
o AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM overlap JOIN seen USING (question_id, chunk_id)),
b AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM bm25 JOIN seen USING (question_id, chunk_id)),
fused AS (SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(rank) AS best_rank FROM (SELECT * FROM o WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20) GROUP BY ALL),
top AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM fused),
told AS (SELECT question_id, md5(string_agg(c.text || ' [' || CAST(rank AS VARCHAR) || ']', ' ' ORDER BY rank)) AS answer_digest, count(*) AS n, string_agg(chunk_id, ',' ORDER BY rank) AS cited FROM top JOIN chunks c USING (chunk_id) WHERE rank <= 3 GROUP BY question_id)
SELECT i.item_id AS question_id, CASE WHEN r.question_id IS NOT NULL THEN 'FAILED' WHEN t.n > 0 THEN 'COMPLETED' ELSE 'NO_EVIDENCE' END AS status, CASE WHEN r.question_id IS NOT NULL THEN 'RAG_FORBIDDEN_SCOPE' END AS error_code, t.answer_digest, coalesce(t.n, 0) AS n_evidence, t.cited
FROM benchmark i LEFT JOIN refused r ON r.question_id = i.item_id LEFT JOIN told t ON t.question_id = i.item_id"""


@query(_ANSWERED)
def ans_batch(spark, sf_dir):
    """The answer to every benchmark item in one call: each under some scope, every fourth naming a document, which some scopes don't reach."""
    asked, s = _asked(spark, sf_dir)
    return _told(answer(spark, asked, s, chunks(spark, sf_dir)))


def _asked(spark, sf_dir):
    """Questions each under some scope, every fourth naming a document; and the scopes."""
    from pyspark.sql.window import Window

    with_checkpoints(spark)
    s = scopes(spark, sf_dir).withColumn("i", F.row_number().over(Window.orderBy("scope_id")) - 1)  # four rows a source
    many = s.count()
    first = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("tenant_id")).agg(F.format_string("d%010d", F.min("doc_id")).alias("d"))
    q = questions(spark, sf_dir).withColumn("i", F.col("question_id") % many).join(s.select("i", "scope_id", "tenant_id"), "i").join(first, "tenant_id")
    asked = q.select("question_id", "question", "scope_id", F.when(F.col("question_id") % 4 == 0, F.array("d")).alias("requested_document_ids"))
    return asked, s.drop("i")


def _told(out):
    return out.select("question_id", "status", "error_code", F.md5("answer").alias("answer_digest"), "n_evidence", F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), ",").alias("cited"))


_LETTERS = "aeinrst"
_COUNTS = "[" + ", ".join(f"CAST(length(text) - length(replace(text, '{x}', '')) AS DOUBLE)" for x in _LETTERS) + "]"
_DENSE = f"""qv AS (SELECT item_id AS question_id, {_COUNTS} AS v FROM benchmark), cv AS (SELECT chunk_id, {_COUNTS} AS v FROM chunks),
near AS (SELECT question_id, chunk_id, round(list_cosine_similarity(qv.v, cv.v), 6) AS score FROM qv JOIN seen USING (question_id) JOIN cv USING (chunk_id) WHERE list_sum(cv.v) > 0 AND list_sum(qv.v) > 0),
o AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM near WHERE score >= 0.5),"""
_OVERLAP_RANK = "o AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM overlap JOIN seen USING (question_id, chunk_id)),"
_HYBRID = _ANSWERED.replace(_OVERLAP_RANK, _DENSE)


def _vectors(spark, sf_dir):
    """Letters counted, as vectors that any engine can follow: of questions and of chunks."""
    counts = lambda c: F.array(*[(F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))).cast("double") for x in _LETTERS]).alias("vector")
    return questions(spark, sf_dir).select("question_id", counts("question")), chunks(spark, sf_dir).select("chunk_id", counts("text"))


@query(_HYBRID)
def ans_hybrid(spark, sf_dir):
    """The same by BM25 and vectors fused."""
    asked, s = _asked(spark, sf_dir)
    return _told(answer(spark, asked, s, chunks(spark, sf_dir), vectors=_vectors(spark, sf_dir)))


@query(_HYBRID.replace("SELECT * FROM o WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20", "SELECT * FROM o WHERE rank <= 20"))
def ans_vector(spark, sf_dir):
    """The same by vectors alone."""
    asked, s = _asked(spark, sf_dir)
    return _told(answer(spark, asked, s, chunks(spark, sf_dir), "vector", vectors=_vectors(spark, sf_dir)))
