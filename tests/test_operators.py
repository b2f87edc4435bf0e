"""Operators on small frames whose results are worked out by hand."""

import collections
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import scalars, text
from lodestone.operators import access, answers, checks, chunking, claims, corpus, decompose, dense, evaluation, fusion, lexical, lifecycle, scores, summaries
from lodestone.schemas import CHUNK, SCOPE, require_schema, schema_violations
from lodestone.sources import readers, sinks


def one(df):
    return df.head().asDict()


def chunk(**k):
    return {"chunk_id": "c1", "document_id": "d1", "version_id": "v1", "text": "t", "section_path": "s", "page_start": 1, "page_end": 1, "parent_chunk_id": None, "previous_chunk_id": None, "next_chunk_id": None, "tenant_id": "t1", "visibility": "private", "library_scope_ids": ["l1"], "parse_version": "p", "embedding_version": "e", "is_active": True} | k


def scope(**k):
    return {"user_id": "u", "tenant_id": "t1", "library_ids": [], "folder_ids": [], "document_ids": [], "include_public": True, "acl_version": "a"} | k


ACCESS = [
    ({}, {}, False), ({}, {"document_ids": ["d1"]}, True), ({}, {"library_ids": ["l1"]}, True), ({}, {"folder_ids": ["f"]}, False), ({"tenant_id": "t2"}, {"document_ids": ["d1"]}, False),
    ({"visibility": "tenant"}, {}, True), ({"visibility": "tenant"}, {"document_ids": ["other"]}, False), ({"visibility": "tenant"}, {"folder_ids": ["f"]}, False), ({"visibility": "tenant", "tenant_id": "t2"}, {}, False),
    ({"visibility": "public", "tenant_id": "t2"}, {}, True), ({"visibility": "public"}, {"include_public": False}, False), ({"visibility": "public"}, {"library_ids": ["l9"]}, False), ({"visibility": "public", "tenant_id": "t2"}, {"document_ids": ["d1"]}, True),
    ({"visibility": "secret"}, {"document_ids": ["d1"]}, False), ({"is_active": False, "visibility": "public"}, {}, False), ({"is_active": None, "visibility": "public"}, {}, False), ({"text": ""}, {"document_ids": ["d1"]}, False), ({"library_scope_ids": None}, {"document_ids": ["d1"]}, False),
    ({}, {"document_ids": None, "library_ids": ["l1"]}, False), ({}, {"document_ids": ["d1", ""]}, True), ({"visibility": "public"}, {"include_public": None}, False), ({"visibility": None}, {}, False), ({}, {"document_ids": ["d1"], "folder_ids": ["f"]}, True),
]


def test_access(spark):
    from pyspark.sql import types as T

    loose = lambda s: T.StructType([T.StructField(f.name, f.dataType, True) for f in s])
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("chunk", loose(CHUNK)), T.StructField("scope", loose(SCOPE))])
    rows = [(i, tuple(chunk(**c).values()), tuple(scope(**s).values())) for i, (c, s, _) in enumerate(ACCESS)]
    df = spark.createDataFrame(rows, schema)
    got = {r.n: (r.loose, r.strict) for r in df.select("n", access.authorized().alias("loose"), access.authorized(strict=True).alias("strict")).collect()}
    assert [got[i][0] for i in range(len(ACCESS))] == [x for *_, x in ACCESS]
    assert not got[19][1] and all(got[i][1] == got[i][0] for i in got if i != 19)


def test_overlap_and_bm25(spark):
    q = spark.createDataFrame([(1, "What is the Alpha beta?"), (2, "the of"), (3, "zeta")], "question_id long, question string")
    c = spark.createDataFrame([("a", "alpha beta gamma", "x"), ("b", "Alpha ALPHA", "x"), ("c", "nothing", "alpha")], "chunk_id string, text string, section_path string")
    scores = lexical.top_k(lexical.overlap_scores(q, c, F.concat_ws(" ", "section_path", "text")), 2, ["question_id"]).collect()
    assert [(r.question_id, r.chunk_id, r.score, r.rank) for r in scores] == [(1, "a", 2, 1), (1, "b", 1, 2)]
    index = lexical.postings(c, {"body": F.col("text"), "section": F.col("section_path")})
    ranked = lexical.top_k(lexical.bm25_scores(q, index, {"body": 1.0, "section": 2.0}), None, ["question_id"]).collect()
    assert [r.chunk_id for r in ranked] == ["a", "c", "b"] or {r.chunk_id for r in ranked} == {"a", "b", "c"}
    import math

    tf, n, length, mean = 2.0, 3, 3, (4 + 3 + 2) / 3  # chunk b: alpha twice of three tokens
    want = math.log((n - 3 + 0.5) / 3.5 + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    assert [r.score for r in ranked if r.chunk_id == "b"][0] == pytest.approx(want, abs=1e-6)


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    got = dense.cosine_top_k(v.where("vec_id = 1"), v, 5, 0.5, block=1).collect()
    assert [(r.chunk_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1.0), (2, 1.0), (3, 0.707107)]
    assert v.select(dense.normalized(F.col("embedding"))).where("normalized is null" if False else F.lit(True)).count() == 6
    assert dense.fingerprint(v).head().n == 6
    with pytest.raises(Exception):
        dense.embed(v.select(F.lit("x").alias("text")), lambda ts: [[1.0]] * len(ts), dims=2).collect()


def test_rrf_and_coverage(spark):
    r = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2), ("b", 1, "y", 1), ("b", 1, "z", 2), ("b", 1, "w", 30)], "backend string, question_id long, chunk_id string, rank int")
    got = fusion.rrf(r).collect()
    assert [x.chunk_id for x in sorted(got, key=lambda x: x.rank)] == ["y", "x", "z"]
    pool = [(1, "compare a and b", ["r1", "r2"], "r1", f"c{i}", i) for i in range(1, 5)] + [(1, "compare a and b", ["r1", "r2"], "r2", "c9", 9)]
    pool += [(2, "tell", ["r1", "r2"], "r1", f"d{i}", i) for i in range(1, 5)]
    c = fusion.coverage(spark.createDataFrame(pool, "question_id long, question string, requested_routes array<string>, route string, chunk_id string, rank int")).collect()
    assert [(x.chunk_id, x.rank, x.status) for x in sorted(c, key=lambda x: (x.question_id, x.rank))] == [("c1", 1, "APPLIED"), ("c2", 2, "APPLIED"), ("c9", 3, "APPLIED"), ("d1", 1, "FALLBACK"), ("d2", 2, "FALLBACK"), ("d3", 3, "FALLBACK")]
    assert {x.failure_code for x in c} == {None, "COMPARISON_NOT_PROVEN"}


def test_rerank_falls_back(spark):
    rows = [(1, "a", 1, 0.1), (1, "b", 2, 0.9), (2, "a", 1, 0.1), (2, "b", 2, None), (3, "a", 1, 0.5), (3, "b", 2, float("nan"))]
    got = fusion.rerank(spark.createDataFrame(rows, "question_id long, chunk_id string, rank int, pair_score double"), 2).collect()
    assert {(r.question_id, r.chunk_id): (r.rank, r.status) for r in got} == {(1, "b"): (1, "APPLIED"), (1, "a"): (2, "APPLIED"), (2, "a"): (1, "FALLBACK"), (2, "b"): (2, "FALLBACK"), (3, "a"): (1, "FALLBACK"), (3, "b"): (2, "FALLBACK")}
    pairs = spark.createDataFrame([("q", "t")] * 3, "l string, r string")
    for bad, code in ((lambda p: [1.0] * (len(p) + 1), "MODEL_SCORE_INVALID"), (lambda p: 1 / 0, "MODEL_SCORING_UNAVAILABLE"), (lambda p: [True] * len(p), "MODEL_SCORE_INVALID"), (lambda p: [float("inf")] * len(p), "MODEL_SCORE_INVALID")):
        assert {(r.pair_score, r.pair_error) for r in fusion.score_pairs(pairs, bad, "l", "r").collect()} == {(None, code)}
    none = fusion.score_pairs(pairs.select("l", F.lit(None).cast("string").alias("r")), lambda p: [0.0] * len(p), "l", "r")
    assert {r.pair_error for r in none.collect()} == {"TITLE_OR_TEMPLATE_UNAVAILABLE"}


def test_identity_gate(spark):
    good = {"owner": "u", "owner_id": "u", "chunk_id": "k1", "document_id": "d1", "version_id": "v1", "is_active": True, "quote": "q"}
    sets = {
        "ok": [{}, {"chunk_id": "k2"}], "id": [{"chunk_id": "-bad"}], "owner": [{"owner_id": "x"}], "active": [{"is_active": None}], "twice": [{}, {}], "cross": [{}, {"chunk_id": "k3", "version_id": "v2"}], "version": [{"document_id": "d2", "chunk_id": "k4", "version_id": "v1"}],
        "chunk": [{"chunk_id": "k9"}], "empty": [{"quote": " "}], "first": [{"quote": ""}, {"owner_id": "x", "chunk_id": "k2"}],
    }
    rows = [(claim, i + 1, *(good | e).values()) for claim, es in sets.items() for i, e in enumerate(es)]
    cited = spark.createDataFrame(rows, "claim_id string, position int, owner string, owner_id string, chunk_id string, document_id string, version_id string, is_active boolean, quote string")
    versions = spark.createDataFrame([("d1", "v1"), ("d2", "v7")], "document_id string, version_id string")
    live = spark.createDataFrame([("k1", "d1", "v1"), ("k2", "d1", "v1"), ("k4", "d2", "v1")], "chunk_id string, document_id string, version_id string")
    got = {r.claim_id: r.reason for r in claims.identity_failures(cited, versions, live).collect()}
    assert got == {"ok": None, "id": "EVIDENCE_IDENTITY_INVALID", "owner": "EVIDENCE_OWNER_MISMATCH", "active": "EVIDENCE_VERSION_NOT_ACTIVE", "twice": "EVIDENCE_CHUNK_ID_DUPLICATE", "cross": "EVIDENCE_SET_CROSS_VERSION", "version": "EVIDENCE_VERSION_NOT_CURRENT", "chunk": "EVIDENCE_CHUNK_IDENTITY_NOT_CURRENT", "empty": "BOUND_EVIDENCE_TEXT_EMPTY", "first": "BOUND_EVIDENCE_TEXT_EMPTY"}


CONFIG = decompose.ComparisonConfig({"A": ("alpha net", "AlphaNet"), "B": ("betanet",)}, ("compare", "difference", "比较"), ("in contrast", "turning to"))
PLANS = [
    ("Compare AlphaNet vs BetaNet如何训练?", None, {"A": "AlphaNet Compare 如何训练", "B": "BetaNet Compare 如何训练"}),
    ("比较 AlphaNet 的方法和 BetaNet 的方法在训练中的差异。请详述", None, {"A": "AlphaNet 的方法 比较 在训练中的差异 请详述", "B": "BetaNet 的方法 比较 在训练中的差异 请详述"}),
    ("Compare methods; AlphaNet uses x; BetaNet uses y", None, {"A": "AlphaNet uses x Compare methods", "B": "BetaNet uses y Compare methods"}),
    ("Compare the first one; in contrast AlphaNet uses x", None, {"A": "in contrast AlphaNet uses x", "B": "Compare the first one"}),
    ("Compare the first one; in contrast AlphaNet uses x; and more", None, {"A": "in contrast AlphaNet uses x and more", "B": "Compare the first one and more"}),
    ("Compare the first one; AlphaNet uses x", "BILATERAL_DECOMPOSITION_UNPROVEN", None),
    ("Compare AlphaNet vs BetaNet", "BILATERAL_DECOMPOSITION_UNPROVEN", None),
    ("Compare AlphaNet BetaNet如何", "BILATERAL_DECOMPOSITION_UNPROVEN", None),
    ("Compare nothing", "BILATERAL_DECOMPOSITION_UNPROVEN", None),
    ("AlphaNet vs BetaNet如何", "COMPARISON_NOT_PROVEN", None),
    ("  ", "QUESTION_BLANK", None),
]


def planned(spark, rows, config=CONFIG):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, question string, document_ids array<string>")
    return [(r.status, r.failure_code, r.queries) for r in decompose.decompose(df, config).orderBy("i").collect()]


def test_decompose(spark):
    got = planned(spark, [(q, ["A", "B"]) for q, _, _ in PLANS])
    assert got == [("FALLBACK" if code else "APPLIED", code, queries or {"A": q, "B": q}) for q, code, queries in PLANS]
    turned = planned(spark, [(q, ["B", "A"]) for q, _, _ in PLANS])
    assert turned == got


def test_decompose_preconditions(spark):
    rows = [("q", ["A"]), ("q", ["A", "A"]), ("compare", ["A", "C"]), (None, None), (None, ["A", "B"]), ("\u3000\n", ["A", "B"])]
    got = planned(spark, rows)
    assert [c for _, c, _ in got] == ["ROUTE_COUNT_NOT_TWO", "ROUTE_COUNT_NOT_TWO", "DOCUMENT_IDENTITY_UNAVAILABLE", "ROUTE_COUNT_NOT_TWO", "QUESTION_BLANK", "QUESTION_BLANK"]
    assert [q for _, _, q in got] == [{"A": "q"}, {"A": "q"}, {"A": "compare", "C": "compare"}, {}, {"A": "", "B": ""}, {"A": "\u3000\n", "B": "\u3000\n"}]
    off = decompose.ComparisonConfig(CONFIG.aliases, CONFIG.comparison_markers, enabled=False)
    assert planned(spark, [("compare", ["A", "B"])], off) == [("DISABLED", "SWITCH_DISABLED", {"A": "compare", "B": "compare"})]
    a = spark.createDataFrame([("A", "Net"), ("B", "net"), ("B", "other")], "document_id string, alias string")
    assert [r.alias for r in decompose.ambiguous_aliases(a).collect()] == ["net"]


CLAIMS = [
    ("The model reached 92% accuracy.", [1], ["The model reached 92% accuracy on the test."], "SUPPORTED", "DETERMINISTIC_ANCHORS_AND_CORE_OVERLAP_PASS"),
    ("The model reached 93% accuracy.", [1], ["The model reached 92% accuracy."], "UNSUPPORTED", "NUMERIC_ANCHOR_MISSING_FROM_EVIDENCE"),
    ("Training took 3 weeks.", [1], ["Training took 3 days."], "UNSUPPORTED", "NUMERIC_UNIT_NOT_ESTABLISHED"),
    ("Noise causes failure.", [1], ["Noise and failure are seen."], "UNSUPPORTED", "CAUSAL_RELATION_NOT_ESTABLISHED"),
    ("The method always works.", [1], ["The method works."], "UNSUPPORTED", "UNIVERSAL_SCOPE_NOT_ESTABLISHED"),
    ("Alpha outperforms beta.", [1], ["Alpha and beta were tested."], "UNSUPPORTED", "COMPARISON_NOT_ESTABLISHED"),
    ("Alpha outperforms beta.", [1], ["Something is higher than another."], "UNSUPPORTED", "COMPARISON_OBJECTS_NOT_ESTABLISHED"),
    ("Alpha is the first system.", [1], ["Alpha is a system."], "UNSUPPORTED", "NOVELTY_OR_SUPERLATIVE_NOT_ESTABLISHED"),
    ("It holds only for cats.", [1], ["It holds for cats."], "UNSUPPORTED", "QUALIFYING_CONDITION_NOT_ESTABLISHED"),
    ("Bananas grow.", [1], ["The model is trained."], "UNSUPPORTED", "CORE_LEXICAL_OVERLAP_NOT_ESTABLISHED"),
    ("模型在测试集上训练。", [1], ["该模型在测试集上训练完成"], "SUPPORTED", "DETERMINISTIC_ANCHORS_AND_CORE_OVERLAP_PASS"),
    ("Training took 3 weeks.", [1, 2], ["Training took 3 weeks.", "Training took 5 weeks."], "UNSUPPORTED", "BOUND_NUMERIC_CONFLICT_NOT_DISCLOSED"),
    ("Training reports differ: 3 weeks and 5 weeks.", [1, 2], ["Training took 3 weeks.", "Training took 5 weeks."], "CONFLICTING_EVIDENCE", "BOUND_NUMERIC_CONFLICT_DISCLOSED"),
    ("Training times differ with 3 weeks and 5 weeks.", [1, 2], ["Training times were 3 weeks.", "Training took 5 weeks."], "CONFLICTING_EVIDENCE", "BOUND_NUMERIC_CONFLICT_DISCLOSED"),
    ("Training times differ.", [1, 2], ["Training times were 3 weeks.", "Training took 5 weeks."], "UNSUPPORTED", "BOUND_NUMERIC_CONFLICT_VALUES_INCOMPLETE"),
    ("The reports conflict.", [1], ["The reports."], "UNSUPPORTED", "CONFLICT_NOT_DETERMINISTICALLY_PROVEN"),
    ("The size is not reported.", [1], ["The model."], "INSUFFICIENT_EVIDENCE", "SAFE_LIMITATION_WITH_BOUND_EVIDENCE"),
    ("", [1], ["x"], "UNSUPPORTED", "CLAIM_TEXT_EMPTY"), ("x", [], ["x"], "UNSUPPORTED", "CLAIM_CITATION_MISSING"), ("x", None, ["x"], "UNSUPPORTED", "CLAIM_CITATION_MISSING"), ("x", [2, 1], ["x", "y"], "UNSUPPORTED", "CLAIM_CITATION_SET_INVALID"), ("x", [1, 1], ["x", "y"], "UNSUPPORTED", "CLAIM_CITATION_SET_INVALID"), ("x", [3], ["x", "y"], "UNSUPPORTED", "CLAIM_CITATION_OUT_OF_RANGE"), ("x", [2], ["x", " "], "UNSUPPORTED", "BOUND_EVIDENCE_TEXT_EMPTY"),
]


def test_claims(spark):
    df = spark.createDataFrame([(i, t, c, q) for i, (t, c, q, *_) in enumerate(CLAIMS)], "claim_id int, text string, citation_ids array<int>, quotes array<string>")
    got = {r.claim_id: (r.status, r.reason) for r in claims.verify(df).collect()}
    assert [got[i] for i in range(len(CLAIMS))] == [x[3:] for x in CLAIMS]
    rep = claims.report(claims.verify(df).withColumn("answer_id", F.lit("a"))).head()
    assert rep.n_claims == len(CLAIMS) and rep.partial


def test_evidence_sets(spark):
    rows = [(1, "The model is trained. Bananas grow.", [1], ["The model is trained on text."]), (2, "Training took 3 weeks.", [1, 2], ["Training took 3 weeks.", "Training took 5 weeks."]), (3, "The model is trained.", [1], ["The model is trained."]), (4, "Bananas grow.", [1], ["The model."])]
    df = spark.createDataFrame(rows, "claim_id int, text string, citation_ids array<int>, quotes array<string>")
    got = {r.claim_id: r.status for r in claims.verify_set(df).collect()}
    assert got == {1: "PARTIALLY_SUPPORTED", 2: "CONFLICTING_EVIDENCE", 3: "SUPPORTED_BY_EVIDENCE_SET", 4: "INSUFFICIENT_EVIDENCE"}
    more = spark.createDataFrame([(1, 1, "nothing"), (1, 2, "bananas grow on trees"), (2, 1, "Training took 9 weeks."), (4, 1, "nothing")], "claim_id int, position int, quote string")
    got = {r.claim_id: (r.status, r.expanded) for r in claims.with_adjacent(df, more).collect()}
    assert got[1] == ("SUPPORTED_BY_EVIDENCE_SET", True) and got[4] == ("INSUFFICIENT_EVIDENCE", False) and got[3] == ("SUPPORTED_BY_EVIDENCE_SET", False) and got[2] == ("CONFLICTING_EVIDENCE", False)


def test_claim_payloads(spark):
    good = {"claims": [{"text": "a", "citation_ids": [1]}]}
    rows = [json.dumps(good), "nonsense", json.dumps({"claims": []}), json.dumps({"claims": good["claims"] * 9}), json.dumps({"claims": [{"text": "a [1]", "citation_ids": [1]}]}), json.dumps({"claims": [{"text": "a", "citation_ids": [4]}]})]
    df = spark.createDataFrame([(i, p, 3) for i, p in enumerate(rows)], "i int, payload string, evidence_count int")
    assert [r.error for r in claims.parse_claims(df).orderBy("i").collect()] == [None, "CLAIMS_MALFORMED", "CLAIM_COUNT_INVALID", "CLAIM_COUNT_INVALID", "CLAIM_INVALID", "CLAIM_INVALID"]


def test_cases(spark):
    schema = "case_id string, http_status int, answer_status string, error_code string, min_evidence int, max_evidence int, required array<struct<document_id:string,page_start:int,page_end:int>>, forbidden array<string>, warnings array<string>"
    c = spark.createDataFrame([("a", 200, None, None, 1, None, [("d", 2, 3)], ["x"], ["w"]), ("b", 403, None, "E", 0, 0, [], [], []), ("c", 200, "DONE", None, 2, None, [("d", 9, 9)], ["d"], ["w", "v"])], schema)
    o = spark.createDataFrame([("a", 200, "ANY", "ANY", ["w"]), ("b", 403, None, "E", None), ("c", 500, "DONE", None, [])], "case_id string, http_status int, answer_status string, error_code string, warnings array<string>")
    e = spark.createDataFrame([("a", "d", 3, 4), ("c", "d", 1, 2)], "case_id string, document_id string, page_start int, page_end int")
    got = {r.case_id: (r.passed, r.failures) for r in evaluation.case_failures(c, o, e).collect()}
    assert got["a"] == (True, []) and got["b"] == (True, [])
    assert got["c"] == (False, ["http_status expected 200, got 500", "evidence_count expected >= 2, got 1", "required_evidence missing d:9-9", "forbidden_document_ids present: d", "required_warnings missing: v,w"])


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "question_id long")
    ranking = spark.createDataFrame([("b", 1, "x", 1), ("b", 1, "y", 2), ("b", 1, "z", 3)], "backend string, question_id long, chunk_id string, rank int")
    j = spark.createDataFrame([(1, "y", 3), (1, "z", 1), (1, "w", 2), (2, "x", 2)], "question_id long, chunk_id string, relevance int")
    got = {(r.question_id, r.k): r for r in evaluation.question_metrics(q, ranking, j, (3,)).collect()}
    import math

    r = got[1, 3]
    assert (r.recall, r.precision, r.mrr) == (0.5, pytest.approx(1 / 3), 0.5)
    assert r.ndcg == pytest.approx((7 / math.log2(3) + 1 / 2) / (7 + 3 / math.log2(3) + 1 / 2))
    assert (got[2, 3].recall, got[2, 3].precision, got[2, 3].mrr, got[2, 3].ndcg) == (0, 0, 0, 0)


PROSE = st.lists(st.sampled_from([*"ab .!?\n", "1. Title words\n", "\n\n", "Appendix\n", "II. BIG TITLE\n", "long" * 40]), max_size=200).map("".join)


@settings(max_examples=150, deadline=None)
@given(PROSE, st.sampled_from(chunking.STRATEGIES[1:]))
def test_structural_chunks_tile(doc, strategy):
    spans = chunking.split(doc, strategy)
    assert all(0 <= a < b <= len(doc) and b - a <= 1280 + 400 and doc[a:b].strip() for a, b, *_ in spans)
    covered = set()
    for a, b, *_ in spans:
        covered |= set(range(a, b))
    assert all(not doc[i].strip() for i in range(len(doc)) if i not in covered)
    assert [a for a, *_ in spans] == sorted(a for a, *_ in spans)


def test_fixed_chunks():
    rng = random.Random(1)
    doc = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "."]) for _ in range(3000))
    spans = chunking.split(doc, chunking.STRATEGIES[0])
    assert len(spans) > 10 and all(b - a <= 1024 for a, b, *_ in spans)
    assert spans[0][0] == 0 and spans[-1][1] == len(doc) and all(x[1] >= y[0] for x, y in zip(spans, spans[1:]))
    assert chunking.split("x" * 3000, chunking.STRATEGIES[0]) == [(0, 1024, None, None), (824, 1848, None, None), (1648, 2672, None, None), (2472, 3000, None, None)]
    assert chunking.split("  ", chunking.STRATEGIES[0]) == []
    with pytest.raises(ValueError):
        chunking.split("x", "other")


def test_sections():
    doc = "intro\n1. First part\ntext\n1.1. Sub part\nmore\nIV. Results and so\nAppendix\nend"
    assert [s[3] for s in chunking.sections(doc)] == ["UNKNOWN", "1. First part", "1.1. Sub part", "Appendix"]
    assert [s[2:] for s in chunking.sections(doc, True)] == [("parent-unknown-000", "UNKNOWN"), ("parent-001", "1. First part"), ("parent-002", "Appendix")]


LINES = [("Introduction", True), ("1. Setup", True), ("1.2 Deep part", True), ("21. Too far", False), ("3. this is lower", False), ("4. It is a sentence", False), ("II. RESULTS HERE", True), ("II. results here", False), ("word " * 40, False), ("plain line", False), ("2) Other", True)]


def test_headings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "i int, t string")
    got = [r.h for r in df.select("i", text.is_heading(F.col("t")).alias("h")).orderBy("i").collect()]
    assert got == [x for _, x in LINES]
    assert [r[0] for r in spark.createDataFrame([("1.2.3 x",), ("x",), ("4 y",)], "t string").select(text.heading_level(F.col("t"))).collect()] == [3, 1, 1]


def test_blocks(spark):
    texts = ["A line.\nNext line\n1. Head\nbody", "", None, "\n \n", "x" * 900 + "\n" + "x" * 899 + "\n" + "x" * 5 + "\nIntroduction"]
    df = spark.createDataFrame(list(enumerate(texts)), "page int, text string")
    rows = sorted((r.page, r.source_start, r.source_end, r.is_heading) for r in chunking.blocks(df, ["page"]).collect())
    assert rows == [(0, 0, 7, False), (0, 8, 17, False), (0, 18, 25, True), (0, 26, 30, False), (4, 0, 1800, False), (4, 1801, 1806, False), (4, 1807, 1819, True)]
    assert all(r.text == texts[r.page][r.source_start : r.source_end] for r in chunking.blocks(df, ["page"]).collect())


def test_section_paths_keep_parts_by_position(spark):
    """A level skipped leaves a shorter path; levels have no end; what stands before the first heading is under the document."""
    rows = [("d", 0, False, 1, "x"), ("d", 1, True, 1, "1 A"), ("d", 2, True, 3, "1.2.3 C"), ("d", 3, True, 3, "1.2.4 D"), ("d", 4, True, 9, "deep"), ("e", 0, True, 2, "2.1 E"), ("f", 0, False, 1, "y")]
    df = spark.createDataFrame(rows, "document_id string, source_start int, is_heading boolean, level int, text string")
    got = [r.section_path for r in chunking.section_paths(df).orderBy("document_id", "source_start").collect()]
    assert got == ["Document", "1 A", "1 A > 1.2.3 C", "1 A > 1.2.3 C > 1.2.4 D", "1 A > 1.2.3 C > 1.2.4 D > deep", "Document > 2.1 E", "Document"]


def test_parse_status(spark):
    pages = [(1, "x" * 100), (1, "y"), (2, "x"), (3, ""), (3, "x" * 99), (4, ""), (4, None), (5, "é" * 3_000_000)]
    got = {r.document_id: tuple(r)[3:] for r in chunking.parse_status(spark.createDataFrame(pages, "document_id int, text string")).collect()}
    assert got == {1: ("PASS", None, None), 2: ("REVIEW", "EXTRACTED_TEXT_TOO_SHORT", None), 3: ("REVIEW", "EMPTY_TEXT_PAGE_DETECTED", None), 4: ("FAILED", "NO_EXTRACTABLE_TEXT", None), 5: ("PASS", None, "CLEAN_TEXT_TOO_LARGE")}


def test_partial_answers(spark):
    rows = [("a", "SUPPORTED"), ("a", "INSUFFICIENT_EVIDENCE"), ("b", "INSUFFICIENT_EVIDENCE"), ("b", "UNSUPPORTED"), ("c", "UNSUPPORTED")]
    df = spark.createDataFrame(rows, "answer_id string, status string").withColumn("citation_ids", F.array(F.lit(1)))
    assert {r.answer_id: r.partial for r in claims.report(df).collect()} == {"a": False, "b": True, "c": False}


def test_types_count_eligible_questions_only(spark):
    per = spark.createDataFrame([(1, "x", 50, 1.0, 1.0), (2, "x", 50, None, 0.0)], "question_id int, backend string, k int, recall double, ndcg double")
    its = spark.createDataFrame([(1, "ANSWERABLE", ["t"]), (2, "NO_EVIDENCE", ["t", "u"])], "question_id int, answerability string, question_types array<string>")
    assert {r.question_type: (r.n, r.ndcg) for r in evaluation.by_question_type(per, its).collect()} == {"t": (1, 1.0), "u": (0, None)}


def test_numbers_agree_to_six_digits(spark):
    df = spark.createDataFrame([("12345678 and 12345679 and 1.2345678e7, 0.5 and .5",)], "t string")
    assert len(df.select(text.numbers(F.col("t")).alias("n")).head().n) == 3


def runs_by_rule(tiles, target=1024, most=1280, overlap=200):
    """The rule of grouping said over all possible ends and starts, not walked."""
    out, first = [], 0
    while True:
        low = tiles[first][0]
        size = [b - low for _, b in tiles]
        inside = [j for j in range(first, len(tiles)) if size[j] <= target]
        last = max(inside, default=first)
        after = last + 1
        if after < len(tiles) and size[after] <= most and size[after] - target <= abs(size[last] - target):
            last = after
        out.append((low, tiles[last][1]))
        if last == len(tiles) - 1:
            return out
        if tiles[last + 1][1] - tiles[last + 1][0] + overlap > most:
            first = last + 1
        else:
            far = [j for j in range(first + 1, last + 1) if tiles[last][1] - tiles[j][0] >= overlap]
            first = max(far, default=first + 1)


def test_grouping_follows_the_rule():
    rng = random.Random(3)
    for _ in range(300):
        ends, at = [], 0
        for _ in range(rng.randrange(1, 30)):
            at += rng.choice([5, 40, 150, 199, 200, 300, 512, 900, 1024, 1280])
            ends.append(at)
        tiles = list(zip([0, *ends], ends, strict=False))
        assert chunking.grouped(tiles) == runs_by_rule(tiles)


def test_granted_pairs_are_those_of_the_expression(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    c = [(f"k{i}", f"d{i % 7}", pick("v", ""), pick("t", "t", None), 1, 1, pick("t1", "t2"), pick("public", "tenant", "private", "odd"), pick(["a"], ["a", "b"], [], None), pick(True, True, None)) for i in range(80)]
    s = [(f"s{i}", "u", pick("t1", "t2", ""), "1", pick([], ["a"], ["b", ""], ["a", "b"]), pick([], ["f"]), pick([], ["d1", "d2"], [None, "d3"]), pick(True, False)) for i in range(30)]
    cd = spark.createDataFrame(c, "chunk_id string, document_id string, version_id string, text string, page_start int, page_end int, tenant_id string, visibility string, library_scope_ids array<string>, is_active boolean")
    sd = spark.createDataFrame(s, "scope_id string, user_id string, tenant_id string, acl_version string, library_ids array<string>, folder_ids array<string>, document_ids array<string>, include_public boolean")
    for strict in (False, True):
        both = cd.select(F.struct(*cd.columns).alias("chunk")).crossJoin(sd.select("scope_id", F.struct(*sd.columns[1:]).alias("scope")))
        want = {(r.scope_id, r.k) for r in both.where(access.authorized(strict=strict)).select("scope_id", F.col("chunk.chunk_id").alias("k")).collect()}
        got = [(r.scope_id, r.chunk_id) for r in access.granted(cd, sd, strict=strict).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_cells_find_most_neighbours(spark):
    """Few probes of many cells against brute force, on vectors with clusters."""
    import numpy as np

    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    x = centre[rng.integers(0, 40, 2000)] + 0.35 * rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    got = {(r.question_id, r.chunk_id) for r in dense.ann_top_k(asked, df, 5, 0.5, cell_size=40, probes=6, same=False).collect()}
    want = {(r.question_id, r.chunk_id) for r in dense.cosine_top_k(asked, df, 5, 0.5, same=False).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_leases_fence_stale_workers(spark):
    rows = [("j", 1, "CLAIMED", "a"), ("j", 2, "CLAIMED", "b"), ("j", 3, "COMPLETED", "a"), ("k", 1, "CLAIMED", "a"), ("k", 2, "COMPLETED", "a"), ("k", 3, "COMPLETED", "a"), ("m", 1, "COMPLETED", None)]
    df = spark.createDataFrame(rows, "job_id string, event_id long, kind string, lease_token string").withColumn("ts", F.timestamp_seconds("event_id"))
    assert {(r.job_id, r.event_id) for r in lifecycle.fenced(df).where("kind = 'COMPLETED'").collect()} == {("k", 2)}


def test_section_paths(spark):
    rows = [("d", 0, True, 1, "1. A"), ("d", 1, False, 1, "x"), ("d", 2, True, 2, "1.1. B"), ("d", 3, False, 1, "y"), ("d", 4, True, 1, "2. C"), ("d", 5, False, 1, "z")]
    df = spark.createDataFrame(rows, "document_id string, source_start int, is_heading boolean, level int, text string")
    assert [r.section_path for r in chunking.section_paths(df).orderBy("source_start").collect()] == ["1. A", "1. A", "1. A > 1.1. B", "1. A > 1.1. B", "2. C", "2. C"]


def test_page_ranges(spark):
    blocks = spark.createDataFrame([("d", 0, 5, 1, "A"), ("d", 5, 9, 1, "B"), ("d", 9, 12, 2, "A"), ("d", 12, 20, 3, "C")], "document_id string, source_start int, source_end int, page_number int, section_path string")
    c = spark.createDataFrame([("d", "k1", 0, 10), ("d", "k2", 0, 3), ("d", "k3", 10, 20)], "document_id string, chunk_id string, source_start int, source_end int")
    got = {r.chunk_id: tuple(r)[1:] for r in chunking.page_ranges(c, blocks).collect()}
    assert got == {"k1": (1, 2, "A -> B"), "k2": (1, 1, "A"), "k3": (2, 3, "A -> C")}


def test_text_functions(spark):
    df = spark.createDataFrame([("Took 3 weeks, 1.5e3 x and -2% of 7 days; v2.0 ok. Next 中文测试 [2][1][2]",)], "t string")
    t = F.col("t")
    r = df.select(text.numbers(t).alias("n"), text.unit_facts(t).alias("u"), text.clauses(t).alias("c"), text.cjk_bigrams(t).alias("b"), text.citation_positions(t, F.lit(2)).alias("p"), text.citation_positions(t, F.lit(1)).alias("none")).head()
    assert set(r.n) >= {3.0, 1500.0, -2.0, 7.0} and {(x.unit, x.value) for x in r.u} == {("weeks", 3.0), ("%", -2.0), ("days", 7.0)}
    assert r.c[0] == "Took 3 weeks" and r.c[-1].startswith("Next") and r.b == ["中文", "文测", "测试"] and r.p == [1, 2] and r.none is None
    assert one(df.select(text.page_text(F.lit("a\r\n\x07 b  c \n\n\td")).alias("x")))["x"] == "a\nb c\nd"
    s = spark.range(1).select(scalars.relative_gain(F.lit(1.0), F.lit(0.0)).alias("a"), scalars.relative_gain(F.lit(0.0), F.lit(0.0)).alias("b"), scalars.first_argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)), ("x", "y", "z")).alias("c"), scalars.is_contract_id(F.lit("-a")).alias("d"), scalars.backoff_seconds(F.lit(9)).alias("e")).head()
    assert (s.a, s.b, s.c, s.d, s.e) == (float("inf"), 0.0, "x", False, 3600.0)


def test_splits():
    groups = [("g1", [("a", "test"), ("b", "test"), ("c", "dev")]), ("g2", [("d", "dev")]), ("g3", [("e", "dev")]), ("g4", [("f", "acceptance")])]
    got = corpus.assign_splits(groups, {"dev": 2, "test": 3, "acceptance": 1})
    assert got == {"a": "test", "b": "test", "c": "test", "d": "dev", "e": "dev", "f": "acceptance"}
    with pytest.raises(ValueError):
        corpus.assign_splits(groups, {"dev": 1})
    with pytest.raises(ValueError):
        corpus.assign_splits([("g", [("a", "dev")] * 3)], {"dev": 2, "test": 1})


def test_components(spark):
    nodes = spark.range(1, 40).withColumnRenamed("id", "id")
    links = spark.createDataFrame([*((i, i + 1) for i in range(1, 20)), (30, 31)], "a long, b long")
    got = {r.id: r.component for r in corpus.components(nodes, links, lambda df: df.checkpoint()).collect()}
    assert all(got[i] == 1 for i in range(1, 21)) and got[31] == 30 and got[25] == 25


def test_lifecycle(spark):
    e = spark.createDataFrame([("v", 1, "REGISTERED", 1), ("v", 2, "READY", 2), ("v", 3, "INACTIVE", 3), ("w", 1, "READY", 1), ("x", 1, "REGISTERED", 1), ("x", 2, "PROCESSING", 3)], "version_id string, sequence int, status string, revision long")
    assert {(r.version_id, r.sequence, r.code) for r in lifecycle.transition_errors(e).collect()} == {("v", 2, "TRANSITION_FORBIDDEN"), ("w", 1, "NOT_REGISTERED"), ("x", 2, "REVISION_SKIPPED")}
    stored = spark.createDataFrame([("k", 1, 5)], "id string, fixed int, at int")
    got = lifecycle.upsert(stored, spark.createDataFrame([("k", 9, 7), ("n", 2, 1), ("n", 1, 1)], "id string, fixed int, at int"), ["id"], {"at": "max"}).collect()
    assert {tuple(r) for r in got} == {("k", 1, 7), ("n", 1, 1)}
    q = spark.createDataFrame([("j", 1, "ENQUEUED"), ("j", 2, "CLAIMED"), ("j", 3, "FAILED"), ("k", 1, "ENQUEUED"), ("m", 1, "CLAIMED"), ("m", 2, "COMPLETED")], "job_id string, s long, kind string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.job_id: (r.status, r.attempts, r.due) for r in lifecycle.queue_state(q).select("job_id", "status", "attempts", F.unix_seconds("next_attempt_at").alias("due")).collect()}
    assert got == {"j": ("RETRY", 1, 33), "k": ("PENDING", 0, 1), "m": ("SUCCEEDED", 1, None)}


def test_checks(spark):
    assert schema_violations(spark.createDataFrame([], SCOPE), SCOPE) == []
    with pytest.raises(ValueError):
        require_schema(spark.range(1), SCOPE)
    jobs = spark.createDataFrame([("a", "RUNNING", None, None, None, None, 1, 5), ("b", "SUCCEEDED", None, None, None, "2024-01-01", 1, 5), ("c", "RETRY", None, None, None, None, 9, 5)], "job_id string, status string, lease_token string, lease_expires_at string, failure_code string, completed_at string, attempt_count int, max_attempts int")
    assert {tuple(r) for r in checks.job_errors(jobs).collect()} == {("LEASE", "a"), ("CODE", "c"), ("ATTEMPTS", "c")}
    with pytest.raises(ValueError):
        checks.require_none(checks.job_errors(jobs), "jobs")
    c = spark.createDataFrame([("a", None, "b"), ("b", "a", "c"), ("c", None, None)], "chunk_id string, previous_chunk_id string, next_chunk_id string")
    assert [tuple(r) for r in checks.link_errors(c).collect()] == [("b", "NEXT")]


def test_summaries(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert v.agg(summaries.interpolated_percentile("v", 0.95), summaries.nearest_rank_percentile("v", 0.95)).head()[:] == (3.8499999999999996, 4.0)
    a, b = spark.createDataFrame([("x", 1), ("y", 1)], "k string, n int"), spark.createDataFrame([("x", 2), ("q", 2)], "k string, n int")
    assert {tuple(r) for r in summaries.last_wins([a, b], "k").collect()} == {("x", 2), ("y", 1), ("q", 2)}
    assert [r.k for r in summaries.unknown_keys([a, b], "k").collect()] == ["q"]


def test_answers(spark):
    assert one(spark.createDataFrame([([("a", [1, 2]), ("b", [3])],)], "c array<struct<text:string,citation_ids:array<int>>>").select(answers.rendered_claims(F.col("c")).alias("x")))["x"] == "a [1][2]\nb [3]"


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "chunks.json"
    p.write_text(json.dumps([chunk(), chunk(chunk_id="c2")]))
    assert readers.chunks(spark, str(p)).count() == 2
    lines = tmp_path / "cases.jsonl"
    lines.write_text('{"case_id":"a"}\n\n{"case_id":"a"}\n')
    schema = CHUNK.__class__([CHUNK["chunk_id"].__class__("case_id", CHUNK["chunk_id"].dataType)])
    assert readers.jsonl(spark, str(lines), schema).count() == 2
    with pytest.raises(ValueError):
        readers.cases(spark, str(lines), schema)
    csv = tmp_path / "x.csv"
    csv.write_text("wrong\na\n")
    with pytest.raises(Exception):
        readers.csv(spark, str(csv), schema).collect()
    pdf = tmp_path / "docs"
    pdf.mkdir()
    (pdf / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (pdf / "b.pdf").write_bytes(b"nope")
    got = {r.path[-5:]: r.error for r in readers.binary_documents(spark, str(pdf)).collect()}
    assert got == {"a.pdf": None, "b.pdf": "SIGNATURE_INVALID"}
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert sinks.publish(df, str(tmp_path / "t")).count() == 10
    with pytest.raises(FileExistsError):
        sinks.publish(df, str(tmp_path / "t"))
    with pytest.raises(RuntimeError):
        sinks.publish(df, str(tmp_path / "u"), check=lambda d: (_ for _ in ()).throw(RuntimeError("no")))
    assert not (tmp_path / "u").exists() and not list(tmp_path.glob("u.staging*"))
    assert sinks.ensure_staged(df, str(tmp_path / "s"), ["id"]) == 10
    assert sinks.ensure_staged(spark.range(12).withColumn("x", F.col("id") * 2), str(tmp_path / "s"), ["id"]) == 2
    objects = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary")
    assert sinks.put_objects(objects, str(tmp_path / "o")) == 2 and sinks.put_objects(objects, str(tmp_path / "o")) == 2
    assert sinks.damaged_objects(spark, str(tmp_path / "o")).count() == 0
    assert one(spark.range(1).select(readers.html_text(F.lit("<p>a&amp;<script>x</script> b</p><!-- c -->")).alias("h")))["h"] == "a& b"


def test_index_grows_by_stream(spark, tmp_path):
    from lodestone.streaming import states

    df = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha")], "chunk_id string, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    states.grow_index(stream, str(tmp_path / "index"), str(tmp_path / "ck"), lambda d: {"body": F.col("text")})
    assert spark.read.parquet(str(tmp_path / "index")).count() == 3


STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil"}


def test_porter(spark):
    from lodestone.functions import stemming

    assert {w: stemming.stem(w) for w in STEMS} == STEMS
    assert stemming.full_text_tokens("Ponies, CAFÉS & x_y 42") == ["poni", "cafe", "x", "y", "42"]
    c = spark.createDataFrame([("a", "the ponies hopped"), ("b", "nothing here")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "pony hopping")], "question_id long, question string")
    index = lexical.postings(c, {"body": F.col("text")}, stemming.fts_tokens)
    assert [r.chunk_id for r in lexical.bm25_scores(q, index, {"body": 1.0}, tokenizer=stemming.fts_tokens).collect()] == ["a"]


def test_publish_all_or_none(spark, tmp_path):
    df = spark.range(3)
    fail = {str(tmp_path / "b"): lambda d: (_ for _ in ()).throw(RuntimeError("no"))}
    with pytest.raises(RuntimeError):
        sinks.publish_all({str(tmp_path / "a"): df, str(tmp_path / "b"): df}, fail)
    assert not (tmp_path / "a").exists() and not (tmp_path / "b").exists()
    assert sinks.publish_all({str(tmp_path / "a"): df, str(tmp_path / "b"): df})[str(tmp_path / "a")].count() == 3


def test_clm_parse_takes_whole_texts(spark, tmp_path):
    """Spaces to 2,600 characters, then a word: the end of a turn counts."""
    from lodestone.plans import quality

    spark.createDataFrame([(1, 0, " " * 2600 + "word")], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    seen = []
    plain = quality.claims.parse_claims
    quality.claims.parse_claims = lambda df, *a: seen.extend(df.collect()) or plain(df, *a)
    try:
        quality.clm_parse(spark, str(tmp_path)).collect()
    finally:
        quality.claims.parse_claims = plain
    assert seen[0].payload.count(" ") == 2600 and "word" in seen[0].payload


def test_cor_readiness_counts_all_blockers(spark, tmp_path):
    """All documents in English: en, de, fr and es are out of their ranges."""
    from lodestone.plans import quality

    spark.createDataFrame([(i, "en") for i in range(16)], "doc_id long, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert quality.cor_readiness(spark, str(tmp_path)).head().n_blockers == 4


def test_block_max_retrieval_is_exact(spark, tmp_path):
    """The k best by bounds are the k best of all pairs, for BM25 and overlap, from memory and from a stored index; few pairs are scored."""
    from lodestone.operators import blockmax

    rng = random.Random(6)
    words = [f"t{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    c = spark.createDataFrame([(f"c{i:04d}", " ".join(rng.choices(words, weight, k=rng.randrange(1, 60))), f"head t{i % 40}") for i in range(800)] + [("c9999", None, "")], "chunk_id string, text string, section_path string")
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, weight, k=rng.randrange(1, 14)))) for i in range(30)] + [(98, "the of"), (99, None), (100, "unknownword")], "question_id long, question string")
    fields, weights = {"body": F.col("text"), "section": F.col("section_path")}, {"body": 1.0, "section": 2.0}
    keep = lambda df, name: df.cache()
    full, few = blockmax.batch(q, c, fields, weights, keep)
    rows = lambda df: sorted((r.question_id, r.rank, r.chunk_id, round(float(r.score), 6)) for r in df.collect())
    all_bm25, all_overlap = lexical.bm25_scan(q, c, fields, weights), lexical.overlap_scores(q, c, F.concat_ws(" ", "section_path", "text"))
    for k in (1, 3, 10):
        assert rows(blockmax.best(*full, k)) == rows(lexical.top_k(all_bm25, k, ["question_id"]))
        assert rows(blockmax.best(*few, k)) == rows(lexical.top_k(all_overlap, k, ["question_id"]))
    seen = c.where("chunk_id like '%7'").select("chunk_id")
    assert rows(blockmax.best(*full, 3, seen)) == rows(lexical.top_k(all_bm25.join(seen, "chunk_id"), 3, ["question_id"]))
    some = blockmax.candidates(*full, blockmax.threshold(*full, 3)).count()
    assert some < 0.5 * all_bm25.count()
    theta = q.select("question_id", F.lit(3.0).alias("theta"))
    assert {(r.question_id, r.chunk_id) for r in blockmax.at_least(*few, theta).collect()} == {(r.question_id, r.chunk_id) for r in all_overlap.where("score >= 3").collect()}
    at = f"file://{tmp_path}/index"
    blockmax.write(c, fields, weights, at, "corpus-1", buckets=8)
    index = blockmax.open_index(spark, at, "corpus-1")
    assert rows(index.top_k(q, 5)) == rows(lexical.top_k(all_bm25, 5, ["question_id"]))
    with pytest.raises(ValueError, match="another corpus"):
        blockmax.open_index(spark, at, "corpus-2")
    next((tmp_path / "index" / "blocks").rglob("*.parquet")).write_bytes(b"x")
    with pytest.raises(ValueError, match="isn't what was written"):
        blockmax.open_index(spark, at, "corpus-1")


def test_stored_cells(spark, tmp_path):
    """Within all cells the answer is exact, by names and under scopes; with the measured number of cells recall of evenly spread vectors is 0.95 or nearly so."""
    import numpy as np

    from lodestone.operators import cells

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    rows = [(f"v{i:04d}", [float(a) for a in v], [f"s{i % 3}", "all"]) for i, v in enumerate(x)] + [("bad", [0.0] * 16, ["all"]), ("none", None, ["all"])]
    v = spark.createDataFrame(rows, "chunk_id string, vector array<double>, visible array<string>")
    q = v.where("chunk_id like 'v%' and cast(substring(chunk_id, 2) as int) % 20 = 0").select(F.col("chunk_id").alias("question_id"), "vector", F.lit("s1").alias("scope"))
    at = f"file://{tmp_path}/cells"
    cells.write(v, at, "x", cell_size=100, visible_col="visible")
    index = cells.open_index(spark, at, "x")
    pairs = lambda df: sorted((r.question_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    exact = dense.cosine_top_k(q.withColumnRenamed("question_id", "chunk_id"), v, 10, 0.2, "chunk_id", "vector", same=False)
    assert pairs(index.top_k(q, 10, 0.2, probes=30, same=False)) == pairs(exact)
    mine = dense.cosine_top_k(q, v, 4, 0.1, "chunk_id", "vector", query_id="question_id", scope_col="scope", visible_col="visible")
    assert pairs(index.top_k(q, 4, 0.1, probes=30, scope_col="scope")) == pairs(mine) and all(int(r.chunk_id[1:]) % 3 == 1 for r in mine.collect())
    best = dense.cosine_top_k(q.withColumnRenamed("question_id", "chunk_id"), v, 10, -1.0, "chunk_id", "vector", same=False)
    found = index.top_k(q, 10, -1.0, same=False)
    assert found.join(best, ["question_id", "chunk_id"]).count() >= 0.93 * best.count()
    assert 1 <= index.probes <= 30
    with pytest.raises(ValueError, match="components"):
        index.top_k(spark.createDataFrame([("q", [1.0])], "question_id string, vector array<double>"), 1)
    with pytest.raises(ValueError, match="other vectors"):
        cells.open_index(spark, at, "y")


def test_numbers_sums_and_order_statistics(spark):
    from lodestone.operators import ordering

    keep = lambda df: df.cache()
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([1.0, 2.5, -1e300, 1e300, 3.0, rng.random(), rng.gauss(0, 1e-9)]), i) for i in range(4000)] + [("c", 5.0, -1), ("d", None, -2), ("d", float("nan"), -3)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(7)
    got = {r.i: r.position for r in ordering.numbered(df, ["i"], keep=keep).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got) and sorted(got.values()) == list(range(4003))
    sums, so_far = {r.i: r.s for r in ordering.running_sum(df, F.col("i") % 5, ["i"], "s", keep=keep).collect()}, 0
    for i in sorted(sums):
        so_far += int(math.fmod(i, 5))
        assert sums[i] == so_far
    asked = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p1": 1.0}
    got = {r.g: r for r in ordering.percentiles(df, ["g"], "v", asked, keep).collect()}
    plain = df.where("v is not null and not isnan(v)").groupBy("g").agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(p)).alias(n) for n, p in asked.items()])
    for r in plain.collect():
        assert got[r.g].n == r.n and all(got[r.g][n] == pytest.approx(r[n], rel=1e-12, abs=1e-300) for n in asked)
    assert set(got) == {"a", "b", "c"}
    assert ordering.percentiles(df.where("g = 'a'"), [], "v", {"p50": 0.5}, keep).first().p50 == pytest.approx(got["a"].p50)


def test_intervals_of_one_crowded_document(spark):
    """10^5 spans in one document meet theirs bin by bin; pairs as by the plain condition."""
    from lodestone.operators import intervals

    few = spark.createDataFrame([("d", 0, 10), ("d", 5, 20_000), ("d", 9000, 9000), ("d", 4096, 4096), ("e", 0, 5), ("d", None, 3)], "doc string, a int, b int")
    other = spark.createDataFrame([("d", 9, 12), ("d", 0, 1), ("d", 8999, 9001), ("d", 4000, 5000), ("d", 30_000, 30_001), ("e", 5, 6), ("d", 10, 10)], "doc string, c int, d int")
    got = sorted((r.a, r.b, r.c, r.d) for r in intervals.overlapping(few, other, ["doc"], ("a", "b"), ("c", "d"), 64).collect())
    want = sorted((r.a, r.b, r.c, r.d) for r in few.join(other, "doc").where("a < d and c < b").collect())
    assert got == want and len(want) > 5
    shut = intervals.overlapping(few, other, ["doc"], ("a", "b"), ("c", "d"), 64, touching=True)
    assert sorted((r.a, r.b, r.c, r.d) for r in shut.collect()) == sorted((r.a, r.b, r.c, r.d) for r in few.join(other, "doc").where("a <= d and c <= b").collect())
    many = spark.range(100_000).select(F.lit("d").alias("doc"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 15).alias("b"))
    points = spark.range(50_000).select(F.lit("d").alias("doc"), (F.col("id") * 20 + 7).alias("p"))
    assert intervals.containing(points, many, ["doc"], "p", "a", "b", 256).count() >= points.count()
    pairs = intervals.overlapping(many, many.toDF("doc", "c", "d"), ["doc"], ("a", "b"), ("c", "d"), 256)
    assert pairs.count() == 100_000 + 2 * 99_999


def test_places_of_packed_chunks():
    """Chunks of the packed line lie where they stand in the text, wide white space and repeats notwithstanding."""
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "cde", "x" * 9]) + rng.choice([" ", ". ", "!\n", "\n\n", ";  \n", "\t "]) for _ in range(rng.randrange(0, 80)))
        for size, overlap in ((40, 10), (25, 0), (30, 29)):
            spans = [s[:2] for s in chunking.fixed(text, size, overlap)]
            assert all(text[a:b] == text[a:b].strip() and b - a for a, b in spans)
            held = {i for a, b in spans for i in range(a, b)}
            assert all(c.isspace() or i in held for i, c in enumerate(text))
            assert [b for _, b in spans] == sorted(b for _, b in spans)


@pytest.mark.parametrize("least", [0.8, 0.3])
def test_similarity_join(spark, least):
    """All pairs at the threshold, none below; blocks of clustered vectors that can't hold one are not compared."""
    import numpy as np

    from lodestone.operators import similar

    rng = np.random.default_rng(5)
    homes = rng.normal(size=(12, 10)) * 3
    x = np.concatenate([homes[i % 12] + 0.6 * rng.normal(size=10) for i in range(600)]).reshape(600, 10)
    rows = [(i, [float(a) for a in v], "hot" if i % 3 else f"k{i % 4}") for i, v in enumerate(x)] + [(900, [0.0] * 10, "hot"), (901, None, "hot")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = unit @ unit.T
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if cosines[i, j] >= least and rows[i][2] == rows[j][2]}
    got = [(r.a, r.b) for r in similar.similar_pairs(df, least, lambda d: d.cache(), by="label", pivots=12, block=40).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    pivots = unit[:12]
    placed = similar._placed(df.where("vec_id < 600").select(F.col("vec_id").alias("id"), F.lit("").alias("key"), dense.normalized(F.col("embedding")).alias("v")), pivots).withColumn("sub", F.lit(0))
    met = similar.block_pairs(placed, pivots, least).agg(F.sum(F.col("n") * F.col("n2"))).first()[0]
    assert met < (0.5 if least > 0.5 else 1.01) * 600 * 600


def _brute_components(ids: list, linked) -> dict:
    """id, smallest id reachable, by trying all pairs."""
    near = {i: [j for j in ids if i != j and linked(i, j)] for i in ids}
    out = {}
    for i in sorted(ids):
        todo = [] if i in out else [i]
        while todo:
            if (j := todo.pop()) not in out:
                out[j] = i
                todo += near[j]
    return out


@pytest.mark.parametrize(("least", "block", "text"), [(0.9, 1000, False), (0.9, 40, True), (0.97, 25, False), (-0.5, 60, False)])
def test_linking_forest(spark, least, block, text):
    """Links kept connect what all links connect, whatever the blocks; a pair of blocks keeps fewer than it has vectors."""
    import numpy as np

    from lodestone.operators import similar

    rng = np.random.default_rng(6)
    homes = rng.normal(size=(30, 8)) * 3
    x = np.array([homes[i % 30] + 0.9 * rng.normal(size=8) for i in range(300)])
    x[40:60] = x[40]
    name = (lambda i: f"n{i}") if text else (lambda i: i - 150)
    rows = [(name(i), [float(a) for a in v], "hot" if i % 3 else f"k{i % 2}") for i, v in enumerate(x)]
    odd = [None, [0.0] * 8, [], [1.0, None] + [1.0] * 6, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7]
    rows += [(name(900 + i), v, "hot") for i, v in enumerate(odd)] + [(name(950), rows[1][1], None), (None, rows[1][1], "hot")]
    df = spark.createDataFrame(rows, f"vec_id {'string' if text else 'long'}, embedding array<double>, label string")
    unit = {r[0]: (x[i] / np.linalg.norm(x[i]), x[i, :4] / np.linalg.norm(x[i, :4]), r[2]) for i, r in enumerate(rows[:300])}

    def linked(a, b):
        (u, h, k), (v, g, m) = unit[a], unit[b]
        return k == m and (u @ v >= least or h @ g >= least + 0.01) and u @ v < 0.9999 and h @ g > -0.2

    rule = lambda a, b, whole, half: (whole < 0.9999) & (half > -0.2)
    kept = [(r.a, r.b) for r in similar.linking_forest(df, {None: least, 4: least + 0.01}, rule, by="label", block=block, rows=16).collect()]
    want = _brute_components(list(unit), linked)
    links = {*kept, *((b, a) for a, b in kept)}
    assert links and _brute_components(list(unit), lambda i, j: (i, j) in links) == want
    sizes = [sum(r[2] == k for r in rows[:300]) for k in ("hot", "k0", "k1")]
    assert len(kept) < sum(n * -(-n // block) for n in sizes) + len(rows)
    with pytest.raises(Exception, match="differ in length"):
        similar.linking_forest(df.unionByName(spark.createDataFrame([(name(999), [1.0] * 7, "hot")], df.schema)), {None: least, 4: least}, rule, by="label").collect()


def test_components_store_fewer_links_than_vectors(spark, tmp_path, monkeypatch):
    """A label of copies has links with the square of its vectors; cor_group_ids and cor_components keep no more than connect them. Groups equal those of all pairs."""
    from lodestone.plans import quality

    half, same, other = [1.0] * 32 + [0.0] * 32, [1.0] * 64, [(-1.0) ** i for i in range(64)]
    rows = [(i, same, 1) for i in range(120)] + [(-i, other if i % 2 else half, 2) for i in range(1, 60)]
    rows += [(500, None, 1), (501, [0.0] * 64, 1), (502, [0.0] * 32 + [1.0] * 32, 1), (503, [math.nan] + [1.0] * 63, 1), (504, same, None), (505, same, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    counts = []

    def counted(df, name):
        if name == "links":
            counts.append(df.count())
        return df.cache()

    monkeypatch.setattr(quality, "stored", counted)
    got = {r.id: r.component for r in quality.cor_components(spark, str(tmp_path)).collect()}
    links = {(r.a, r.b) for r in quality.cor_near_dup_pairs(spark, str(tmp_path)).collect()}
    assert len(links) > 120 * 119 / 2 and got == _brute_components([r[0] for r in rows], lambda i, j: (i, j) in links or (j, i) in links)
    assert len(counts) == 1 and counts[0] < len(rows)
    assert sum(r.n_members for r in quality.cor_group_ids(spark, str(tmp_path)).collect()) == len(rows)


def test_bulk_sink_commits_all_or_none(spark, tmp_path):
    from lodestone.sources import bulk

    spark.dataSource.register(bulk.BulkSink)
    df = spark.range(1000).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).repartition(4)
    at = f"file://{tmp_path}/bulk"
    save = lambda d, **o: d.write.format("lodestone_bulk").option("path", at).options(**o).mode("append").save()
    save(df)
    save(df.where("id < 10"))
    assert bulk.published(spark, at, df.schema).count() == 1010
    before = sorted(p.name for p in (tmp_path / "bulk").iterdir())
    assert not any(n.startswith("_staging") for n in before)
    with pytest.raises(Exception, match="rows in one file"):
        save(df.coalesce(2), most_rows=400)
    with pytest.raises(Exception, match="rows in one file"):
        save(df.where("id < 300").union(df).coalesce(2), most_rows=600)
    assert sorted(p.name for p in (tmp_path / "bulk").iterdir()) == before
    assert bulk.published(spark, at, df.schema).count() == 1010
    writer = bulk.BulkWriter(at, 100)
    import pyarrow as pa

    done = writer.write(iter([pa.record_batch({"id": [1], "text": ["a"]})]))
    with pytest.raises(ValueError, match="isn't what its task wrote"):
        writer.commit([bulk.Staged(done.name, 2, done.digest)])
    assert sorted(p.name for p in (tmp_path / "bulk").iterdir()) == before
    assert bulk.published(spark, f"file://{tmp_path}/none", df.schema).count() == 0


def test_batches_are_scored_where_postings_lie(spark, tmp_path):
    """Scores of a batch equal those of all pairs; postings are dealt by chunk, and no pair is shuffled before its question's best are taken."""
    rng = random.Random(8)
    words = [f"t{i}" for i in range(60)]
    c = spark.createDataFrame([(f"c{i:04d}", " ".join(rng.choices(words, k=rng.randrange(0, 40))), f"head t{i % 40}") for i in range(200)] + [("c9999", None, "")], "chunk_id string, text string, section_path string")
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(1, 14)))) for i in range(30)] + [(98, "the of"), (99, None)], "question_id long, question string")
    q.write.parquet(f"file://{tmp_path}/q")
    q = spark.read.parquet(f"file://{tmp_path}/q")  # of a known size
    fields, weights = {"body": F.col("text"), "section": F.col("section_path")}, {"body": 1.0, "section": 2.0}
    b = lexical.batch(q, c, fields, weights, lambda df, name: df.cache())
    rows = lambda df: sorted((r.question_id, r.chunk_id, round(float(r.score), 5)) for r in df.collect())
    assert rows(b.bm25()) == rows(lexical.bm25_scan(q, c, fields, weights))
    assert rows(b.overlap()) == rows(lexical.overlap_scores(q, c, F.concat_ws(" ", "section_path", "text")))
    seen = c.where("chunk_id like '%7'").select("chunk_id")
    assert rows(b.bm25(seen)) == rows(lexical.bm25_scan(q, c, fields, weights).join(seen, "chunk_id"))
    best = lexical.top_k(b.overlap(), 3, ["question_id"])
    plan = best._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan
    assert not re.search(r"hashpartitioning\((question_id#\d+L?, chunk_id|chunk_id#\d+, question_id)", best._jdf.queryExecution().executedPlan().toString())
    empty = lexical.batch(q, c.where("false"), fields, weights, lambda df, name: df.cache())
    assert empty.bm25().count() == empty.overlap().count() == 0


def test_batch_candidates(spark, monkeypatch):
    """The best of all tasks' candidates are the best of all pairs, ties included; counts of shared terms are those of all pairs; rows of one chunk are one."""
    rng = random.Random(5)
    words = [f"t{i}" for i in range(25)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(120)]
    rows = [(f"c{i:04d}", texts[i % 70], f"t{i % 3}") for i in range(120)] + [("c0007", "t1 t2 t2", "t1"), ("c0009", texts[9], "t0"), ("c9998", None, None), ("c9998", "", "")]
    c = spark.createDataFrame(rows, "chunk_id string, text string, section_path string").repartition(5)
    q = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(20)] + [("q98", "each or"), ("q99", None)], "question_id string, question string")
    fields, weights = {"body": F.col("text"), "section": F.col("section_path")}, {"body": 1.0, "section": 2.0}
    b = lexical.batch(q, c, fields, weights, lambda df, name: df.cache())
    got = b.candidates(4).cache()
    best = {k: sorted((r.question_id, r["rank"], r.chunk_id, round(r.score, 5)) for r in lexical.best_of(got, 4).where(F.col("backend") == k).collect()) for k in ("overlap", "bm25")}
    one_row = c.groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"), F.array_join(F.sort_array(F.collect_list("section_path")), " ").alias("section_path"))
    pairs = {"overlap": lexical.overlap_scores(q, one_row, F.concat_ws(" ", "section_path", "text")), "bm25": lexical.bm25_scan(q, one_row, fields, weights)}
    for k, all_pairs in pairs.items():
        assert best[k] == sorted((r.question_id, r["rank"], r.chunk_id, round(float(r.score), 5)) for r in lexical.top_k(all_pairs, 4, ["question_id"]).collect())
    shared = {(r.question_id, r.chunk_id): r.score for r in pairs["overlap"].collect()}
    assert all(r.shared == shared.get((r.question_id, r.chunk_id), 0) for r in lexical.best_of(got, 4).collect())
    assert {(r.question_id, r.shared): r.n for r in lexical.shared_counts(got).collect()} == dict(collections.Counter((k[0], s) for k, s in shared.items()))
    monkeypatch.setattr(lexical, "QUESTIONS_A_PASS", 6)
    parts = lexical.batch(q, c, fields, weights, lambda df, name: df.cache())
    assert len(parts.passes) == 4 and sorted(map(tuple, parts.bm25_best(4).collect())) == sorted(map(tuple, b.bm25_best(4).collect()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("abyz019 _-.,\n\t\0ÀéñßİıΣςσǅﬁａ３٣अकि्中文𝒳𐐀\u0301\u0323\u00a0\u2028") | st.characters(exclude_categories=["Cs"]), max_size=30) | st.sampled_from(["Running RUNNERS ponies", "ΟΔΟΣ", "naïve cafés", "x_y", "e\u0301_\u0301"]), max_size=8))
def test_token_lists(texts):
    """Tokens of many texts at once are those of each text by itself, as the rule has them: accents off, lower case, runs of letters and digits, stems."""
    import unicodedata

    from lodestone.functions import stemming

    rule = lambda t: [stemming.stem(w) for w in re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", t or "") if not unicodedata.combining(c)).lower())]
    assert stemming.token_lists(pa.array(texts, pa.string())).to_pylist() == [stemming.full_text_tokens(t) for t in texts] == [rule(t) for t in texts]


def test_stemmed_batch(spark, monkeypatch):
    """A tokenizer with a form inside tasks gets texts as they are, in bounded pieces, and finds what it finds as a function of columns."""
    from lodestone.functions import stemming

    c = spark.createDataFrame([("a", "Cafés, running ponies", "s"), ("b", "The runner ran", None), ("c", None, "Pony"), ("d", "", "")], "chunk_id string, text string, section_path string")
    q = spark.createDataFrame([(1, "cafe runs"), (2, "ponies"), (3, "the")], "question_id long, question string")
    fields, weights = {"body": F.col("text"), "section": F.col("section_path")}, {"body": 1.0, "section": 2.0}
    b = lexical.batch(q, c, fields, weights, lambda df, name: df.cache(), stemming.fts_tokens)
    assert "ArrowEvalPython" not in b.passes[0].held._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted((r.question_id, r.chunk_id, round(r.score, 5)) for r in df.collect())
    assert rows(b.bm25()) == rows(lexical.bm25_scores(q, lexical.postings(c, fields, stemming.fts_tokens), weights, tokenizer=stemming.fts_tokens))
    batch = pa.RecordBatch.from_arrays([pa.array("abcde"), pa.array(["x" * n for n in (3, 9, 1, 1, 1)])], names=["chunk_id", "body"])
    monkeypatch.setattr(scores, "TEXTS_A_PIECE", 4)
    assert [p.column(0).to_pylist() for p in scores._pieces(batch)] == [["a"], ["b"], ["c", "d", "e"]]


def test_blocks_of_scores_are_bounded(monkeypatch):
    """Sums don't depend on how many rows a task adds up at a time; what it keeps stays near the k best a question."""
    rng = np.random.default_rng(2)
    n, n_terms, n_questions = 300, 12, 7
    held = [sorted(rng.choice(n_terms, rng.integers(0, 9), replace=False).tolist()) for _ in range(n)]
    ints, many = pa.list_(pa.int32()), rng.integers(1, 4, n_terms).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array([f"c{i:03d}" for i in range(n)]), pa.array([10 + i % 5 for i in range(n)]), pa.array(held, ints), pa.array([[many[p] for p in row] for row in held], ints)], names=["chunk_id", "length", "places", "tf_body"])
    first = np.arange(n_terms + 1) * 3
    asked = scores.Asked(pa.array(range(n_questions)), first, np.concatenate([rng.choice(n_questions, 3, replace=False) for _ in range(n_terms)]), np.arange(3 * n_terms) % 5 > 0, np.linspace(0.1, 2, 3 * n_terms), (1.0,), 12.0, 1.2, 0.75)
    schema = pa.schema([("backend", pa.string()), ("question_id", pa.int64()), ("chunk_id", pa.string()), ("score", pa.float64()), ("shared", pa.int64()), ("n", pa.int64())])
    run = lambda: [r for b in scores.best_and_counts(asked, 3, ("overlap", "bm25"), schema)(iter([batch])) for r in b.to_pylist()]
    whole = run()
    assert len(whole) <= 2 * 3 * n_questions + n_questions * n_terms
    monkeypatch.setattr(scores, "PAIRS_A_BLOCK", 20)
    assert run() == whole and max(len(s) for _, s, _ in asked.blocks(batch)) == 2
    monkeypatch.setattr(scores, "PAIRS_A_BLOCK", 10_000)
    monkeypatch.setattr(scores, "ADDENDS_A_BLOCK", 30)
    assert run() == whole and max(s.sum() for _, s, _ in asked.blocks(batch)) <= 30


def test_metrics_write_no_judgments(spark, sf, monkeypatch):
    """Metrics count judgments by grade in the task that scores: what is written grows with questions and tasks, not with pairs of question and chunk."""
    from lodestone.plans import quality, registry, retrieval

    written = {}

    def kept(df, name):
        out = registry.stored(df, name)
        written[name] = out.count()
        return out

    for m in (quality, retrieval):
        monkeypatch.setattr(m, "stored", kept)
    q = quality.questions(spark, sf)
    got = quality._per_question(spark, sf)
    rows = lambda df: sorted((r.question_id, r.backend, r.k, *[None if r[m] is None else round(r[m], 9) for m in ("recall", "precision", "mrr", "ndcg")]) for r in df.collect())
    n_chunks, n_questions = quality.chunks(spark, sf).count(), q.count()
    assert rows(got) and set(written) == {"held-terms", "candidates"} and written["held-terms"] == n_chunks
    assert written["candidates"] < n_questions * n_chunks
    want = evaluation.question_metrics(q, *quality._ranked_and_judged(spark, sf), backends=("overlap", "bm25"))
    assert rows(got) == rows(want)


def test_passages_need_no_labels(spark, sf, tmp_path):
    """Texts to be searched meet no labels, so no text is shuffled; where labels name a document twice they are the rows of the chunks all the same."""
    from lodestone.plans import frames

    rows = lambda df: collections.Counter(map(tuple, df.select("chunk_id", "text", "section_path").collect()))
    got = frames.passages(spark, sf)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and rows(got) == rows(frames.chunks(spark, sf))
    d, labels = (frames.table(spark, sf, t) for t in ("documents", "labels"))
    d.limit(50).union(d.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.union(labels.limit(9)).union(labels.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"file://{tmp_path}/labels.parquet")
    assert rows(frames.passages(spark, f"file://{tmp_path}")) == rows(frames.chunks(spark, f"file://{tmp_path}"))


def test_texts_are_embedded_once(spark, sf):
    """Four backends: vectors are written when they are made, so counting, blocking and fusing them doesn't ask the provider again."""
    from lodestone.plans import items

    df = items.evl_four_backends(spark, sf)
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.backend for r in df.select("backend").distinct().collect()} == {"overlap", "bm25", "dense", "rrf"}


def test_metrics_of_many_judgments(spark):
    """The ideal list and the two relevant documents come from counts and ends: nothing sorts or lists a question's judgments."""
    q = spark.createDataFrame([(1,), (2,), (3,)], "question_id long")
    grades = {1: [3] * 4 + [2] * 9 + [1] * 200, 2: [1], 3: [0, 2, 2]}
    j = spark.createDataFrame([(k, f"c{i}", f"d{i // 2}" if k == 1 else f"d{i}", g) for k, gs in grades.items() for i, g in enumerate(gs)], "question_id long, chunk_id string, document_id string, relevance int")
    r = spark.createDataFrame([("a", 1, "c0", 1), ("a", 1, "c12", 2), ("a", 3, "c1", 1), ("a", 3, "c2", 2), ("a", 2, "x", 1)], "backend string, question_id long, chunk_id string, rank int")
    df = evaluation.question_metrics(q, r, j, (3, 50))
    assert "rank(" not in df._jdf.queryExecution().optimizedPlan().toString() and "row_number(" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(x.question_id, x.k): x for x in df.collect()}
    import math

    for k, gs in grades.items():
        for cut in (3, 50):
            ideal = sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(sorted(gs, reverse=True)[:cut]))
            ranked = {1: [3, 2], 2: [], 3: [2, 2]}[k]
            dcg = sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(ranked))
            assert got[k, cut].ndcg == pytest.approx(dcg / ideal)
            relevant = sum(g >= 2 for g in gs)
            assert got[k, cut].recall == (pytest.approx(len(ranked) / relevant) if relevant else None)
    two = evaluation.two_sided(r, j)
    assert two._jdf.queryExecution().optimizedPlan().toString().count("collect_set(") == 1  # of the first ranks only
    assert {(x.question_id, x.backend): x.strict for x in two.collect()} == {(1, "a"): False, (3, "a"): True}


def test_stream_state_is_written_by_tasks(spark, sf):
    """The drained stream is a scan of files, not a table of the driver's memory."""
    from lodestone.plans.relations import lif_stream_state

    df = lif_stream_state(spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "MemoryPlan" not in plan
    assert df.count() == spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.mark.parametrize("block", [37, 10_000])
def test_blocked_products_find_and_count_all_pairs(spark, block):
    """Pairs by any of two cosines, and exact quantiles from counts, equal brute force with any size of block; a vector goes to blocks + 1 tasks at most."""
    import numpy as np

    from lodestone.operators import similar

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(a) for a in v], [float(a) for a in v[:4]], "hot" if i % 4 else f"k{i % 3}") for i, v in enumerate(x)] + [(900, [0.0] * 8, [0.0] * 4, "hot"), (901, None, None, "hot")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, half array<double>, label string")
    cos = lambda y: (lambda u: u @ u.T)(y / np.linalg.norm(y, axis=1, keepdims=True))
    whole, half = cos(x), cos(x[:, :4])
    same = [(i, j) for i in range(300) for j in range(i + 1, 300) if rows[i][3] == rows[j][3]]
    keep = lambda d: d.cache()
    got = similar.any_similar(df, {"embedding": 0.7, "half": 0.9}, keep, by="label", block=block).collect()
    assert sorted((r.a, r.b) for r in got) == [p for p in same if whole[p] >= 0.7 or half[p] >= 0.9]
    assert all(r.embedding == pytest.approx(whole[r.a, r.b]) and r.half == pytest.approx(half[r.a, r.b]) for r in got)
    values = sorted(round(whole[p] + 0.5, 6) for p in same)
    found = similar.cosine_quantiles(df, [0.5, 0.99, 1.0], 6, keep, plus=0.5, by="label", block=block)
    assert found == pytest.approx([float(np.quantile(values, q)) for q in (0.5, 0.99, 1.0)], abs=1e-9)
    assert similar.cosine_quantiles(df.where("false"), [0.5], 6, keep) == [None]
    sent = similar.blocks_of(df, ["embedding"], keep, by="label", block=block).groupBy("id").count().agg(F.max("count")).first()[0]
    assert sent <= -(-232 // block) + 1


def test_all_cells_probed_is_blocked(spark):
    """With as many probes as cells the answer equals the exact one, and queries aren't repeated for every cell."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)], [f"s{i % 3}"]) for i in range(300)], "vec_id long, embedding array<double>, visible array<string>")
    asked = df.where("vec_id % 20 = 0").withColumn("scope", F.lit("s1"))
    how = {"scope_col": "scope", "visible_col": "visible", "same": False}
    got = dense.ann_top_k(asked, df, 5, 0.1, cell_size=10, probes=30, **how)
    assert "cell#" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(got.collect()) == sorted(dense.cosine_top_k(asked, df, 5, 0.1, **how).collect()) and got.count()
    few = dense.ann_top_k(asked, df, 5, 0.1, cell_size=10, probes=29, **how)
    assert "cell#" in few._jdf.queryExecution().optimizedPlan().toString()


def test_all_stored_cells_searched_is_blocked(spark, tmp_path):
    """A search of all stored cells equals the exact one under scopes, and repeats no query a cell."""
    from lodestone.operators import cells

    rng = random.Random(9)
    df = spark.createDataFrame([(f"v{i}", [rng.gauss(0, 1) for _ in range(6)], [f"s{i % 3}"]) for i in range(200)], "chunk_id string, vector array<double>, visible array<string>")
    cells.write(df, f"file://{tmp_path}/all", "x", cell_size=20, visible_col="visible")
    index = cells.open_index(spark, f"file://{tmp_path}/all", "x")
    asked = df.where("chunk_id like '%7'").select(F.expr("cast(substring(chunk_id, 2) as long)").alias("question_id"), "vector", F.lit("s1").alias("scope"))
    got = index.top_k(asked, 5, 0.1, probes=len(index.centres), scope_col="scope")
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = dense.cosine_top_k(asked, df, 5, 0.1, "chunk_id", "vector", query_id="question_id", scope_col="scope", visible_col="visible")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count()


def test_claims_of_one_large_tenant_are_spread(spark, tmp_path):
    """Each document is checked with the next of its tenant, and no task holds a tenant whole."""
    from lodestone.plans import quality

    rows = [(i, f"Line {i}\nmore {i}", "en", None if i % 40 == 7 else "rare" if i % 40 == 9 else "big", 10) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [[(r.claim_id, r.answer_id, r.quotes) for r in part] for part in quality._claims(spark, str(tmp_path)).rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = []
    for source in (None, "rare", "big"):
        mine = [r for r in rows if r[3] == source]
        want += [(f"c{r[0]:010d}", source, [r[1], *([n[1]] if n else [])]) for r, n in zip(mine, [*mine[1:], None], strict=True)]
    assert sorted((x for part in got for x in part), key=str) == sorted(want, key=str)
    assert max(sum(x[1] == "big" for x in part) for part in got) < 300


def test_neighbours_are_verified_once_and_only_for_open_claims(spark):
    """The verdict isn't taken again in a condition of the join, and is as before: the first neighbour that settles an open claim."""
    df = spark.createDataFrame([(1, "Alpha took 3 days", [1], ["Alpha took long"]), (2, "Alpha grows", [1], ["Alpha grows"]), (3, "Beta falls", [1], ["Gamma"]), (4, None, [1], ["x"])], "claim_id int, text string, citation_ids array<int>, quotes array<string>")
    near = spark.createDataFrame([(1, 3, "Alpha took 3 days too"), (1, 2, "Alpha took 3 days"), (1, 1, "none"), (2, 1, "Alpha took 4 days"), (3, 1, "none"), (5, 1, "x")], "claim_id int, position int, quote string")
    out = claims.with_adjacent(df, near)
    got = {r.claim_id: (r.status, r.expanded, r.citation_ids, r.quotes, len(r.reason_codes)) for r in out.collect()}
    assert got == {
        1: ("SUPPORTED_BY_EVIDENCE_SET", True, [1, 2], ["Alpha took long", "Alpha took 3 days"], 3),
        2: ("SUPPORTED_BY_EVIDENCE_SET", False, [1], ["Alpha grows"], 1),
        3: ("INSUFFICIENT_EVIDENCE", False, [1], ["Gamma"], 1),
        4: ("SUPPORTED_BY_EVIDENCE_SET", False, [1], ["x"], 1),
    }
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("format_string(%.5e") <= 2 * claims.verify_set(df)._jdf.queryExecution().optimizedPlan().toString().count("format_string(%.5e")


def test_files_lie_in_one_folder(spark, tmp_path):
    """One file a row, no folder a file, and the reader gets each whole."""
    texts = spark.range(0, 30, 1, 3).select(F.concat(F.lit("%PDF-"), F.col("id").cast("string")).alias("value"))
    sinks.write_files(texts, str(tmp_path / "files"))
    assert not [p for p in (tmp_path / "files").iterdir() if p.is_dir()]
    d = readers.binary_documents(spark, str(tmp_path / "files"), "*.txt")
    assert sorted(bytes(r.content).decode().strip() for r in d.collect()) == sorted(f"%PDF-{i}" for i in range(30))
