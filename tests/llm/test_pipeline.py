"""The pipeline against the same steps put together plainly."""

import hashlib
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import mixing, pii, quality, simhash
from lodestone.llm import queries as Q
from tests.llm.test_text_operators import similar_by_brute_force


def test_run_equals_brute_force(spark, sf, paths):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    score = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    rows = [r for r in docs.collect() if score[r.doc_id]]
    rows.sort(key=lambda r: r.doc_id)
    root = similar_by_brute_force([r.text for r in rows])
    kept = [r for i, r in enumerate(rows) if root[i] == i]
    frame = spark.createDataFrame(kept, docs.schema)
    chance = pii.learn(pii.find(frame))
    clean = {}
    for r in kept:
        text, spans = r.text, [s for s in pii.candidates(r.text) if s[3] or chance.get(pii.code_of(r.text, *s[:3]), 0) >= 0.5]
        ends = len(text) + 1
        for kind, a, b, _ in sorted(spans, key=lambda s: (-s[1], -s[2])):
            assert b <= ends
            text, ends = text[:a] + f"<{kind}>" + text[b:], a
        clean[r.doc_id] = text
    got = corpus_pipeline.run(spark, sf).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(clean) and max(copies.values()) <= 3
    words = lambda t: len(t.split())
    sizes = Counter()
    for r in kept:
        sizes[r.source] += words(clean[r.doc_id])
    targets = mixing.weight_targets(dict(sizes))
    taken = Counter()
    for r in kept:
        taken[r.source] += copies[r.doc_id] * words(clean[r.doc_id])
    longest = {s: max(words(clean[r.doc_id]) for r in kept if r.source == s) for s in targets}
    assert all(abs(taken[s] - targets[s]) <= max(0.02 * targets[s], longest[s] / 2) for s in targets)
    lib = Tokenizer.from_file(paths["word_bpe_49k.json"])
    for r in got:
        ids = lib.encode(clean[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_stages_take_any_rows(spark, edge_documents, empty_documents, sf):
    for docs in (edge_documents, empty_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
            stage(spark, docs, sf).count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_queries_and_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    named = Q.queries()
    assert [n.split("_")[0] for n in named if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    tidy = lambda v: None if v is None or v != v else v
    for name, sql in Q.oracle_sql().items():
        df = named[name](spark, sf)
        cols = sorted(df.columns)
        want = con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(str([tidy(v) for v in r]) for r in want) == sorted(str([tidy(r[c]) for c in cols]) for r in df.collect()), name


def test_rows_that_say_something(spark, sf):
    """The rules reject by their method where holdouts suffice, and the copies of vectors have links."""
    named = Q.queries()
    judged = named["llm_rules_loose"](spark, f"{sf}/../sf0.01")
    assert judged.where("not base_failed and not kept").count() > 0
    linked = named["llm_vector_copies"](spark, sf)
    assert linked.where("n_links > 0").count() > 0 and linked.where("n_links = 0").count() > 0
