"""Winnowing, divergence and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import divergence, spelling, winnowing

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_text(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


# winnowing


def contaminated(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add("" if item is None else str(item))
    sizes = {len(g) for g in grams}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def some_items():
    rng = random.Random(3)
    base = [f"w{rng.randrange(30)}" for _ in range(400)]
    items = [(i, " ".join(base[i * 7 : i * 7 + 5 + 2 * i])) for i in range(12)]
    return base, [*items, (3, "again Item Three"), (40, "lazy dog"), (41, "É à"), (None, "null id item here"), (42, None), (43, ""), (44, " .. "), (45, "x" * 200_000), (46, "the the the the the the the the the the the the"), (47, items[5][1]), (100, items[5][1])]


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_winnowing(spark, edge_documents, most):
    base, items = some_items()
    rng = random.Random(5)
    docs = [(r.doc_id, r.text) for r in edge_documents.select("doc_id", "text").collect()]
    extra = [(900, " ".join(base[20:90])), (901, "Lazy-DOG é À É à."), (902, "the " * 40), (903, "a null id item here b"), (904, " ".join(w if rng.random() < 0.93 else "zz" for w in base)), (904, "again item three")]
    more = edge_documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], "item_id long, text string, h string, n string")
    got = winnowing.contaminated(more, bench, most_broadcast_bytes=most).collect()
    want = list(contaminated(docs + extra, items))
    assert by_text(got) == by_text(want) and 5 < sum(r.contaminated for r in got) < len(got)


def test_winnowing_of_nothing(spark, edge_documents, empty_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert by_text(winnowing.contaminated(edge_documents, none).collect()) == by_text(contaminated([(r.doc_id, r.text) for r in edge_documents.select("doc_id", "text").collect()], []))
    assert winnowing.contaminated(empty_documents, spark.createDataFrame([(1, "a b")], none.schema)).count() == 0


def test_every_window_has_a_fingerprint_of_its_own(spark):
    """What the method guarantees: for each length of window, text holding it keeps the hash that the benchmark's side keeps of it."""
    words = " ".join(f"v{i * i % 61}" for i in range(40))
    df = spark.createDataFrame([(1, words)], "item_id long, text string")
    for n in range(1, 11):
        kept = {r.h for r in winnowing.benchmark_windows(df, n).collect()}
        table = winnowing.bit_table(winnowing.benchmark_windows(df, n))
        seen = df.select(_prints(df, n, table)).head()[0]
        assert {r["h"] for r in seen} == kept and len(seen) == 40 - n + 1


def _prints(df, n, table):
    def of(ws):
        return winnowing.fingerprints(ws, n, table)

    return winnowing._bound(winnowing.words(df.text), of)


# divergence


def audited(rows, least=30, most=50):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(ASCII_LOWER))
    rows = [tuple(x or "" for x in r) for r in rows]
    for lang in {r[0] for r in rows}:
        held, n, of_lang, seen = set(), defaultdict(Counter), Counter(), Counter()
        for _, source, text in (r for r in rows if r[0] == lang):
            ts = terms(text)
            held.add(source)
            n[source].update(ts)
            of_lang.update(ts)
            seen.update(set(ts))
        kept = sorted(t for t, k in seen.items() if k >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(n[s]) for s in held}, share(of_lang)
        for s in held:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in held - {s})
            own = sorted((q[t] - p[s][t], t) for t in kept if n[s][t] and p[s][t] > q[t])[:most]
            for part, ranked in (("pair", pairs), ("term", own)):
                yield from ((lang, s, part, item, -v, k) for k, (v, item) in enumerate(ranked, 1))


@pytest.mark.parametrize("tiles", [{}, {"tile_terms": 3, "tile_groups": 2}])
def test_divergence(spark, tiles):
    rng = random.Random(8)
    vocabulary = [f"t{'abcdefgh'[i % 8] * (i // 8 + 1)}" for i in range(60)] + ["Éa", "éa", "ça"]
    rows = []
    for i in range(300):
        rows.append((rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "é", None]), ", ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(63)], k=rng.randrange(30)))))
    rows += [("en", "wordless", None), ("fr", "one", "lone"), ("fr", "two", None), ("xx", "single", "solo"), *[("en", "a", "Ta TA ta0tb")] * 3]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(5)
    assert by_text(divergence.audit(df, **tiles).collect()) == by_text(audited(rows))
    assert by_text(divergence.audit(df, least_docs=3, most_terms=4, **tiles).collect()) == by_text(audited(rows, 3, 4))


def test_divergence_edges(edge_documents, empty_documents):
    rows = [(r.lang, r.source, r.text) for r in edge_documents.select("lang", "source", "text").collect()]
    for least in (1, 30):
        assert by_text(divergence.audit(edge_documents, least_docs=least).collect()) == by_text(audited(rows, least))
    assert divergence.audit(empty_documents).count() == 0


def test_terms():
    for text in ("", "Ab-c É1ÉA\tz\x85\xa0q", "ǅ Ⅷ漢字x\x7fY"):
        assert [t.decode() for t in divergence.terms(text)] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(ASCII_LOWER))


# spelling


def spelled(docs, least=5, least_n=3):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= least and k >= least_n}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(near[w]), n.get(form[w])


def misspelled(rng, k=150):
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 8))) for _ in range(k)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÿÿÿÿÿ", "ÿÿÿÿÿÿ", "straße", "naïve", "x×÷yz"]
    return [(i - 5 if i else None, " ".join(rng.choices(words, [1 / (j % 7 + 1) ** 3 for j in range(len(words))], k=120)) + " Śab0AAAAA_aaaaa") for i in range(40)]


@pytest.mark.parametrize("most_words", [20_000, 12, 1])
def test_spelling(spark, most_words):
    docs = misspelled(random.Random(2))
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    want = list(spelled(docs))
    assert len(want) > 60 and any(w[2] != w[0] and w[2] != w[1] for w in want)
    assert by_text(spelling.variants(df, most_words=most_words).collect()) == by_text(want)


def test_spelling_edges(spark, edge_documents, empty_documents):
    rows = [(r.doc_id, r.text) for r in edge_documents.select("doc_id", "text").collect()]
    assert by_text(spelling.variants(edge_documents).collect()) == by_text(spelled(rows))
    assert spelling.variants(empty_documents).count() == 0
    long = ["q" * 300, "q" * 299, "q" * 150 + "z" + "q" * 149]
    df = spark.createDataFrame([(1, " ".join(long * 4))], "doc_id long, text string")
    assert by_text(spelling.variants(df).collect()) == by_text(spelled([(1, " ".join(long * 4))]))


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 17, 200):
        values = rng.permutation(size)
        tree = spelling.Wavelet(values)
        lo, hi, least, most = (rng.integers(0, size + 1, 60) for _ in range(4))
        at, value = tree.report(lo, hi, least, most)
        want = sorted((r, v) for r in range(60) for v in values[lo[r] : hi[r]] if least[r] <= v < most[r])
        assert sorted(zip(at.tolist(), value.tolist(), strict=True)) == [(r, int(v)) for r, v in want]
