"""SimHash, mixing, PII, licences, quality and rules against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import graph, licenses, mixing, pii, quality, rules, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """Component of each index by brute force."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprints_are_spark_hashes(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).head()[0] == np.array(xxhash.xxh64_intdigest(b"a b c", 42), np.uint64).view(np.int64)


def test_simhash(spark, edge_documents, empty_documents):
    rows = edge_documents.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    root = classes(fps)
    least = {c: min((r.doc_id for r, x in zip(rows, root, strict=True) if x == c and r.doc_id is not None), default=None) for c in set(root)}
    want = sorted(((r.doc_id, f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, root, strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(edge_documents).collect()), key=str) == want
    assert simhash.near_duplicates(empty_documents).count() == 0
    kept = simhash.keep_one(edge_documents)
    assert kept.columns == edge_documents.columns and kept.count() == len(set(root))
    assert {r.doc_id for r in kept.collect()} == set(least.values())


@pytest.mark.parametrize("split", [20_000, 2])
def test_links_lose_no_connection(spark, split):
    rng = random.Random(split)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:150]:
        for _ in range(3):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(f)
    one = rng.getrandbits(64)
    fps |= {one ^ (1 << a) for a in range(64)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {int(np.int64(r.node).view(np.uint64)): r.root for r in graph.connected_components(simhash.fingerprint_links(df, split)).collect()}
    root = classes(fps)
    groups = Counter(root)
    assert {f for f, r in zip(fps, root, strict=True) if groups[r] > 1} == set(got)
    assert len({(got[f], r) for f, r in zip(fps, root, strict=True) if f in got}) == len(set(got.values())) == sum(n > 1 for n in groups.values())


def test_keep_one_by_shingle_similarity(spark):
    """Near copies at similarities around 0.8 and a chain of them; what stays is as by brute force over all pairs."""
    rng = random.Random(4)
    texts = [None, "", "one two", "One  two"]
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for _ in range(3):
            words = list(words)
            for at in rng.sample(range(200), 1 + base % 6):
                words[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    root = similar_by_brute_force(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    from lodestone.llm.common import cut

    assert 40 < len(set(root)) < len(texts) - 40
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, cut(df, "texts"), "").collect()) == sorted(set(root))


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_keep_one_when_splits_change(spark, tmp_path, monkeypatch, similarity):
    """Each job plans its splits otherwise, as when executors come and go: one of each pair of copies stays, the smaller doc_id."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame([(i, texts[i % 200]) for i in range(400)], "doc_id long, text string")
    df.repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    calls, plain, key = [], simhash.cut, "spark.sql.files.maxPartitionBytes"

    def moved(df, name):
        out = plain(df, name)
        calls.append(name)
        spark.conf.set(key, str((5_000, 1 << 27, 30_000)[len(calls) % 3]))
        return out

    monkeypatch.setattr(simhash, "cut", moved)
    try:
        got = [r.doc_id for r in simhash.keep_one(spark.read.parquet(str(tmp_path / "documents.parquet")), similarity=similarity).collect()]
    finally:
        spark.conf.unset(key)
    assert sorted(got) == list(range(200))


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_keep_one_when_keys_collide(spark, monkeypatch, similarity):
    """With row keys and set keys of a few values only, unlike rows still stay, one of each group of copies."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([(i, texts[i % 60]) for i in range(120)] + [(7, texts[7])] * 2, "doc_id long, text string").repartition(3)
    plain = simhash.row_key
    monkeypatch.setattr(simhash, "row_key", lambda docs, order=0: plain(docs, order) if order else F.pmod(plain(docs), F.lit(5)))
    limits = {} if similarity is None else {"key_of": lambda shingles: int(shingles.sum()) % 7}
    assert sorted(r.doc_id for r in simhash.keep_one(df, width=5, similarity=similarity, **limits).collect()) == list(range(60))


def test_forest_beyond_a_block():
    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 20, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    assert len(simhash.forest(fps, 2, exact=10)) == len(simhash.forest(fps, 2, exact=10**6))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (5, 5), (None, 3), (300, 301), (301, 302), (302, 300)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == {*range(61), 100, 200, 300, 301, 302}
    assert len({got[i] for i in range(61)}) == 1 and len(set(got.values())) == 3
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_weight_targets():
    got = mixing.weight_targets({None: 10, "b": 1000, "a": 1, "c": 0})
    assert got["a"] == 3 and got["c"] == 0 and got[None] == 30 and got["b"] == 1011 - 33
    assert mixing.weight_targets({}) == {}
    assert sum(mixing.weight_targets({"a": 5, "b": 5, "c": 5}).values()) == pytest.approx(15)


def test_mixing(spark, edge_documents, empty_documents):
    mix = mixing.Mix(edge_documents)
    rows = mix.table().collect()
    assert len(rows) == edge_documents.count()
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    want = {r.source: r.n for r in edge_documents.groupBy("source").agg(F.sum(F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)"))).alias("n")).collect()}
    assert mix.sizes == want
    assert sorted(map(tuple, mixing.Mix(edge_documents).table().collect()), key=str) == sorted(map(tuple, rows), key=str)
    out = mixing.Mix(edge_documents, whole_rows=True).documents()
    assert out.columns == edge_documents.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.Mix(empty_documents).table().count() == 0


def test_mix_when_splits_change(spark, tmp_path, monkeypatch):
    """Each job plans its splits otherwise; with many equal rows the documents taken are as many as the table says."""
    rows = [(i % 40, " w" * (30 + i % 3), f"s{i % 3}") for i in range(3100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    calls, plain, key = [], mixing.cut, "spark.sql.files.maxPartitionBytes"

    def moved(df, name):
        out = plain(df, name)
        calls.append(name)
        spark.conf.set(key, str((2_000, 1 << 27, 9_000)[len(calls) % 3]))
        return out

    monkeypatch.setattr(mixing, "cut", moved)
    try:
        mix = mixing.Mix(spark.read.parquet(str(tmp_path / "documents.parquet")), whole_rows=True)
        want = mix.copies(mix.sized).agg(F.sum("copies"), F.sum(F.col("copies") * F.col("size"))).first()
        got = []
        for most in (1_500, 1 << 27):
            spark.conf.set(key, str(most))
            got.append(Counter(map(tuple, mix.documents().collect())))
    finally:
        spark.conf.unset(key)
    assert got[0] == got[1] and sum(got[0].values()) == want[0]
    words = {g: sum(k * len(t.split()) for (_, t, s), k in got[0].items() if s == g) for g in mix.targets}
    assert all(abs(words[g] - mix.targets[g]) <= 40 for g in words) and sum(words.values()) == want[1]


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " w" * rng.choice([5, 20, 90, 300, 1500]), "hot" if i % 3 == 0 else f"s{i % 20}") for i in range(2000)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = Counter()
    for r in mix.table().collect():
        got[r.source_size] += r.taken
    for g, n in mix.sizes.items():
        assert abs(got[n] - mix.targets[g]) <= max(40, 0.01 * mix.targets[g]), g


def tilted(size, lam, half, cap=3.0):
    return min(cap, np.exp(min(lam * size / (size + half), 50.0)))


def test_rates_solve_the_dual(spark):
    """Multipliers and rates equal those that bisection finds over the documents; taken tokens come within 1 % of the targets."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([3, 30, 200, 900, 4000]), None if i % 11 == 0 else f"s{i * i % 7}") for i in range(1200)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sizes = {i: len(t.split()) for i, t, _ in rows}
    half = sum(sizes.values()) / len(sizes)
    assert mix.half == pytest.approx(half)
    taken, rates = Counter(), {r.doc_id: r for r in mix.table().collect()}
    for g, goal in mix.targets.items():
        mine = [sizes[i] for i, _, s in rows if s == g]
        low, high = -1e6, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(s * tilted(s, mid, half) for s in mine) < goal else (low, mid)
        for i, _, s in rows:
            if s == g:
                assert rates[i].rate == pytest.approx(tilted(sizes[i], low, half), rel=1e-6), g
                taken[g] += rates[i].taken
        assert taken[g] == pytest.approx(goal, rel=0.01)
    assert len({round(r.rate, 6) for r in rates.values()}) > len(mix.targets)


def test_two_columns_of_groups(spark):
    rows = [(f"s{i % 4}", f"l{i % 3}", 10 + i % 7) for i in range(600)]
    df = spark.createDataFrame(rows, "source string, lang string, size long")
    sizes = {c: mixing.group_sizes(df, c, 100) for c in ("source", "lang")}
    total = sum(sizes["source"].values())
    targets = {"source": {g: total * w for g, w in zip(sorted(sizes["source"]), (0.4, 0.3, 0.2, 0.1), strict=True)}, "lang": {g: total * w for g, w in zip(sorted(sizes["lang"]), (0.5, 0.3, 0.2), strict=True)}}
    lam = mixing.solve(df, targets, cap=50, half=5.0)
    got = {"source": Counter(), "lang": Counter()}
    for s, lang, n in rows:
        rate = tilted(n, lam["source"][s] + lam["lang"][lang], 5.0, 50)
        got["source"][s] += n * rate
        got["lang"][lang] += n * rate
    for c in targets:
        for g, t in targets[c].items():
            assert got[c][g] == pytest.approx(t, rel=1e-4)


def test_keys_are_refined(spark):
    """With a small residue the histograms are refined down; a group of equal keys in front is parted by place."""
    rng = random.Random(4)
    rows = [("a", (0 if i < 700 else rng.getrandbits(36)) << 24 | rng.getrandbits(24), rng.randrange(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "source string, key long, size long")
    for need in (0.0, 37.0, 2500.0, 6000.0, 1e9, -5.0):
        key, taken = mixing.cut_keys(df, "source", {"a": need}, residue=5)["a"]
        assert taken == sum(s for _, k, s in rows if k <= key)
        assert need < 0 and taken == 0 or abs(taken - min(need, sum(r[2] for r in rows))) <= 8


def base(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    out = [("email", m.start(), m.end()) for m in email.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer("[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans():
    rng = random.Random(0)
    pieces = ["a", "@", ".", "1", "25", "9", " ", "-", "+", "(", ")", "4111111111111111", "b.c", "é", "%"]
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert pii.base_spans(t) == base(t), t


def test_pii_is_linear():
    import time

    began = time.time()
    for t in ("9" * 300_000, "a" * 300_000 + "@", "@a.b" * 80_000, "1." * 200_000, "+1" * 150_000, "9 " * 150_000):
        pii.candidates(t)
    assert time.time() - began < 20


def test_pii(spark, edge_documents, empty_documents):
    rows = {r.doc_id: r for r in pii.scan_documents(edge_documents).where("doc_id > 2").collect()}
    for r in edge_documents.where("doc_id > 2").collect():
        spans = base(r.text or "")
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [rows[r.doc_id][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(rows[r.doc_id].spans.split(","))
    assert pii.scan_documents(edge_documents).count() == edge_documents.count()
    assert pii.scan_documents(empty_documents).count() == 0
    clean = pii.redact(edge_documents)
    assert clean.columns == edge_documents.columns and clean.count() == edge_documents.count()
    assert clean.where("doc_id = 8").head().text == "mail <email> <phone> card <card> at <ip> now"
    assert clean.where("doc_id = 3").head().text is None


def test_label_model():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.4
    votes = np.stack([np.where(rng.random(5000) < good, np.where(truth, 1, -1), np.where(truth, -1, 1)) for good in (0.95, 0.8, 0.7, 0.55)], axis=1)
    p, rates = pii.em(votes, np.ones(5000))
    assert ((p > 0.5) == truth).mean() > 0.93
    assert rates[1, 0, 2] > rates[1, 1, 2] > rates[1, 3, 2]


def test_licence_expressions():
    assert licenses.parse("MIT") == ["MIT"]
    assert licenses.parse("A OR B AND C WITH D") == ["A", "B", "C", "D", "with", "and", "or"]
    assert licenses.parse("(A or B) and C */") == ["A", "B", "or", "C", "and"]
    for bad in ("", "AND A", "A AND", "(A", "()", "A OR OR B"):
        assert licenses.parse(bad) is None, bad
    assert licenses.evaluate(licenses.parse("MIT OR CC-BY-NC-4.0"))[1] == 0.95
    assert licenses.evaluate(licenses.parse("MIT AND CC-BY-NC-4.0"))[1] == 0.2


def test_licence_places():
    rng = random.Random(1)
    scanner, words_of = licenses.Scanner(), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for _ in range(3000):
        t = "".join(rng.choice(["cc", "by", "CC BY", "general public", "license", "License.", "all rights", "reserved", "é", " ", "\n", "-", "nc", "gpl"]) + rng.choice([" ", "", "-"]) for _ in range(rng.randrange(14)))
        words = words_of.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        places = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        got = scanner.scan(t)
        assert got[:2] == (len(words), len(places))
        assert got[2:4] == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got[4] == ",".join(sorted({x for _, x in places})) and 0 <= got[6] <= 1
        assert {x for _, x in places} <= set(got[5].split(",")) or not places


def test_licences(spark, edge_documents, empty_documents):
    r = licenses.scan_documents(edge_documents).where("doc_id = 9").head()
    assert r.base_labels == "cc-by,reserved" and r.labels == "apache,cc-by,gpl,mit,reserved" and r.score == 0.0
    assert licenses.scan_documents(edge_documents).count() == edge_documents.count()
    assert licenses.scan_documents(empty_documents).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] < 0.3)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit(x[:10], np.ones(10)).score(x[:2]) > 0.5).all()


def test_quality(spark, edge_documents, empty_documents, labels):
    rows = quality.classify(edge_documents, labels).collect()
    assert len(rows) == edge_documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert quality.classify(empty_documents, labels).count() == 0
    kept = quality.keep_good(edge_documents, labels)
    assert kept.columns == edge_documents.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.keep_good(empty_documents, labels.where("false")).count() == 0


def test_quality_held_out(spark, sf):
    d, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(d, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    good = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(good) > 0.95


def counts(text):
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:]))
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, edge_documents, empty_documents, labels):
    extra = spark.createDataFrame([(50, "a b c a b c\na b c\n\na b c\n a b c #$"), (51, "w x " * 40), (52, "\n".join(["one two three four"] * 30))], "doc_id long, text string")
    docs = edge_documents.unionByName(extra, allowMissingColumns=True)
    rows = rules.judge(docs, labels).collect()
    want = [(r.doc_id, *counts(r.text)) for r in docs.collect()]
    assert sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows))) == sorted(map(str, want))
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert all(r.kept == (not r.base_failed) for r in rows)  # too few holdouts to reject by
    assert rules.judge(empty_documents, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    rows = [(n, k) for n in (0, 1, 5, 40, 300) for k in range(0, n + 1, max(1, n // 7))]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", rules.binomial_tail(F.col("n"), F.col("k"), 0.2).alias("p")).collect()
    for r in got:
        want = 1.0 if r.k > r.n * 0.2 else sum(comb(r.n, i) * 0.2**i * 0.8 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(want)


def test_cutoffs_part_good_from_bad(spark):
    """The cutoff rejects the bad holdouts and keeps its bound on fresh good documents; a stratum with few holdouts has none."""
    rng = np.random.default_rng(1)
    rows = [(i, "big" if i < 4000 else "small", float(abs(rng.normal(0, 0.004)) if i % 8 else 0.2)) for i in range(4200)]
    m = spark.createDataFrame(rows, "doc_id long, stratum string, symbols double").withColumns({"lines_again": F.lit(0.0), "words_again": F.lit(0.0), "capitals": F.lit(0.0), "bangs": F.lit(0.0), "base_failed": F.lit(False), "text_hash": F.col("doc_id")})
    got = {r.stratum: r for r in rules.cutoffs(m, m.select("doc_id", (F.col("doc_id") % 8 != 0).cast("int").alias("quality"))).collect()}
    assert set(got) == {"big"} and 0.01 < got["big"].cut_symbols < 0.2 and got["big"].cut_bangs is None
    assert np.mean(np.abs(rng.normal(0, 0.004, 100_000)) > got["big"].cut_symbols) <= 0.01


def test_forest_of_one_bit():
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 16, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 16, 900).astype(np.uint64)) ^ rng.integers(0, 40, 900).astype(np.uint64))
    assert len(simhash.forest(fps, 1, exact=10)) == len(simhash.forest(fps, 1, exact=10**6))
    assert simhash.forest(np.array([1, 7, 8, 11], np.uint64), 1, exact=1) == []


def test_sketches_tell_similar_sets():
    rng = np.random.default_rng(5)
    found = passed = 0
    for _ in range(300):
        both, own = rng.integers(0, 1 << 63, 200, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 25), dtype=np.uint64)
        a, b = (simhash.smallest_hashes(np.concatenate([both, x])) for x in own)  # similarity 0.8
        found += bool(set(simhash.bands(a)) & set(simhash.bands(b)))
        sketch = np.frombuffer(simhash.sketch_of(a) + simhash.sketch_of(b), np.uint8).reshape(2, -1)
        passed += bool(simhash._alike(np.array([225, 225]), sketch, 0.8, 0, 1))
    assert found >= 299 and passed == 300


def similar_by_brute_force(texts, similarity=0.8):
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [grams((t or "").lower().split()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_large_groups_are_dealt_out(spark):
    """A group far larger than a block, a band far larger than its limit: what stays is as by brute force."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(300), i % 14):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:150] + [f"y{i}_{j}" for j in range(150)]) for i in range(60)]
    from lodestone.llm.common import cut

    docs = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "texts")
    root = similar_by_brute_force(texts)
    assert len(set(root)) > 60
    for limits in ({}, {"split": 40, "block": 60}, {"block_words": 3000}):
        assert sorted(r.doc_id for r in simhash.keep_one(docs, width=5, similarity=0.8, **limits).collect()) == sorted(set(root)), limits


def test_long_secrets_are_redacted_whole(spark):
    secret = "aB3" * 300
    docs = spark.createDataFrame([(i, f"the api_key = {secret} is set, token: {secret[:40]} too", "x") for i in range(30)], "doc_id long, text string, _codes string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert {r.text for r in out.collect()} == {"the api_key = <secret> is set, token: <secret> too"}


def plain_em(rows, rounds=100):
    """The label model candidate by candidate, in plain Python."""
    p = [min(0.95, max(0.05, 0.5 + sum(r) / (2 * max(1, sum(map(abs, r)))))) for r in rows]
    k = len(rows[0])
    for _ in range(rounds):
        rate = [[[sum((w if c else 1 - w) for w, r in zip(p, rows) if r[j] == v) + (2 if v == (1 if c else -1) else 1) for v in (-1, 0, 1)] for j in range(k)] for c in (0, 1)]
        rate = [[[x / sum(vs) for x in vs] for vs in js] for js in rate]
        yes = (sum(p) + 1) / (len(p) + 2)
        new = []
        for r in rows:
            a, b = yes, 1 - yes
            for j, v in enumerate(r):
                a, b = a * rate[1][j][v + 1], b * rate[0][j][v + 1]
            new.append(a / (a + b))
        p = new
    return p


def test_em_and_spans_equal_plain_versions(spark):
    rng = random.Random(3)
    rows = [tuple(rng.choice((-1, 0, 1) if rng.random() < 0.3 else ((1, 1, 0) if i % 3 else (-1, -1, 0))) for _ in range(5)) for i in range(60)]
    kinds = sorted(set(rows))
    p, _ = pii.em(np.array(kinds), np.array([rows.count(k) for k in kinds], float))
    want = dict(zip(rows, plain_em(rows), strict=True))
    assert all(p[i] == pytest.approx(want[k], abs=1e-4) for i, k in enumerate(kinds))
    texts = [f"call {100 + i}-555-{1000 + i} or write x{i} [at] host [dot] org, card 4111 1111 1111 111{i % 10}, 10.0.0.{i} password={'ab' * i}Z9" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    codes = Counter(pii.code_of(t, *s[:3]) for t in texts for s in pii.candidates(t))
    chance = pii.decide(dict(codes))
    for r in pii.scan_documents(docs).collect():
        spans = [s for s in pii.candidates(texts[r.doc_id]) if s[3] or chance[pii.code_of(texts[r.doc_id], *s[:3])] >= 0.5]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def plain_statistics(text):
    """The statistics by characters and lists, as far as they differ from counting bytes."""
    words = text.split()
    n = len(words)
    if not n:
        return {}
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    lines = [x for x in text.split("\n") if x.strip()]
    size = len(text.encode())
    return {
        "log_words": np.log(1 + n), "log_chars": np.log(1 + size), "mean_word": sum(len(w.encode()) for w in words) / n, "long_words": sum(len(w.encode()) > 14 for w in words) / n,
        "unique": len(set(words)) / n, "top_word": max(words.count(w) for w in set(words)) / n, "symbols": sum(c in "#*$%&|<>" for c in text) / size, "upper": sum("A" <= c <= "Z" for c in text) / size,
        "digits": sum(c in "0123456789" for c in text) / size, "windows_again": 1 - len(set(grams)) / len(grams) if grams else 0.0, "same_next": sum(a == b for a, b in zip(words, words[1:])) / n,
        "lines_again": 1 - len(set(lines)) / len(lines), "line_words": n / len(lines), "stops": text.count(".") / n, "bars": text.count("|") / size, "bangs": text.count("!") / size,
    }


def test_statistics_and_trees_equal_plain_versions():
    rng = random.Random(1)
    some = ["", "one", "a a a\n\na b!", *(" ".join(rng.choice(["the", "Fox", "é", "9%", "|x|", "supercalifragilistic", "end.\n"]) for _ in range(rng.randrange(1, 80))) for _ in range(60))]
    for t in some:
        got = dict(zip(quality.NAMES, quality.statistics(t), strict=True))
        for k, v in plain_statistics(t).items():
            assert got[k] == pytest.approx(v), (k, t)
    g = np.random.default_rng(2)
    x = g.random((500, 4))
    model = quality.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float), trees=7, depth=3)
    for row, score in zip(x, model.score(x), strict=True):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_classifier_equals_plain_training(spark, sf):
    """The query's scores are those of trees fitted to the statistics of exactly the labelled rows that aren't held out."""
    import zlib

    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    known = sorted(((r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2))
    by_hash = {r.doc_id: r.h for r in spark.createDataFrame(known, "doc_id long, y int").select("doc_id", F.xxhash64("doc_id", "y").alias("h")).collect()}
    known.sort(key=lambda k: by_hash[k[0]])
    model = quality.fit(np.array([quality.statistics(texts[i]) for i, _ in known]), np.array([float(y) for _, y in known]))
    for r in quality.classify(d, labels).collect():
        assert r.score == pytest.approx(float(model.score(np.array([quality.statistics(texts[r.doc_id])]))[0]), abs=1e-9)


def test_holdouts_are_independent(spark):
    """Copies of a text and repeated labels are one trial, contradicting labels none: too few are left to certify a cutoff."""
    shares = {"lines_again": F.lit(0.0), "words_again": F.lit(0.0), "capitals": F.lit(0.0), "bangs": F.lit(0.0), "base_failed": F.lit(False)}
    rows = [(i, "x", 0.2 if i % 8 == 0 else 0.0, i) for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 8 != 0)) for i in range(4000)], "doc_id long, quality int")
    m = spark.createDataFrame(rows, "doc_id long, stratum string, symbols double, text_hash long").withColumns(shares)
    assert rules.cutoffs(m, labels.union(labels)).count() == 1
    assert rules.cutoffs(m.withColumn("text_hash", F.col("doc_id") % 300), labels).count() == 0
    assert rules.cutoffs(m, labels.union(labels.withColumn("quality", 1 - F.col("quality")))).count() == 0


def test_false_rejections_stay_under_the_bound():
    """Over many draws of holdouts the cutoff that the tests admit loses more than alpha of the good documents in at most delta of them."""
    rng = np.random.default_rng(0)
    alpha, delta, n = 0.05, 0.1, 400
    from math import comb

    bad = 0
    for _ in range(300):
        good = rng.exponential(0.01, n)
        cutoff = None
        for level in reversed(rules.LEVELS):
            k = int((good > level).sum())
            tail = 1.0 if k > n * alpha else sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
            if tail > delta:
                break
            cutoff = level
        bad += cutoff is not None and np.exp(-cutoff / 0.01) > alpha
    assert bad <= 300 * delta + 3 * (300 * delta * (1 - delta)) ** 0.5


def test_row_keys_tell_rows_apart(spark):
    rows = [(1, None, "x", {"a": 1}), (1, "x", None, {"a": 1}), (1, None, "x", {"a": 2}), (1, None, "x", {"a": 1}), (None, "1", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd name` string, more map<string,int>")
    keys = [r[0] for r in df.select(simhash.row_key(df)).collect()]
    assert len(set(keys)) == 4
    many = spark.range(400).select((F.col("id") % 4).alias("doc_id"), F.lit("one two three four five six").alias("text"))
    for similarity in (None, 0.8):
        assert [tuple(r) for r in simhash.keep_one(many, similarity=similarity).collect()] == [(0, "one two three four five six")]
