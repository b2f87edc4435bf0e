"""WARC bundles and vector cells against plain versions."""

import io

import numpy as np
import pytest
import zstandard

from lodestone.llm import vectors, warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a/", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (9, "http://c/ d\r\ne", "<p>same</p>"), (2, None, None), (5, "http://e/", ""), (6, "http://f/", "é" * 100_000), (7, "x", "HTTP/1.1 200\r\n\r\nContent-Length: 5"), (None, "n", "<p>same</p>"), (8, "r", "twice"), (8, "r", "twice"), (None, None, "alone")]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, payload string, digest string").repartition(2)


def plain(rows):
    first = {}
    for r in rows:
        p = (r.html or "").encode()
        if r.page_id is not None:
            first[p] = min(first.get(p, r.page_id), r.page_id)
    for r in rows:
        p = (r.html or "").encode()
        to = first.get(p)
        to = None if to == r.page_id else to
        yield (r.page_id, len(p), warc.digest_of(p), "response" if to is None else "revisit", to)


def test_bundles(spark, pages):
    index = warc.write_bundles(pages, frame_bytes=300)
    assert sorted(map(tuple, warc.read_bundles(index).collect()), key=str) == sorted(plain(pages.collect()), key=str)
    got = warc.lookup(index, spark.createDataFrame([(9,), (6,), (77,)], "page_id long")).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(9, "revisit", 1), (6, "response", None)}
    uri = index.head().uri.removeprefix("file://")
    with open(uri, "rb") as f:  # any reader of Zstandard reads a bundle from start to end
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert raw.startswith(b"WARC/1.1\r\n")
    none = warc.write_bundles(pages.where("false"))
    assert none.count() == 0 and warc.read_bundles(none).count() == 0
    small = warc.read_bundles(warc.write_bundles(pages, least=12)).where("record_type = 'revisit'")
    assert small.count() == 0


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dims = max(len(v) for _, v in good)
    x = np.array([np.pad(v, (0, dims - len(v))) for _, v in good])
    x /= np.abs(x).max(1)[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    out, seen = [], set()
    for s in range(len(x)):
        if s in seen:
            continue
        group, todo = [], [s]
        seen.add(s)
        while todo:
            u = todo.pop()
            group.append(u)
            new = [v for v in np.flatnonzero(near[u]) if v not in seen]
            seen.update(new)
            todo += new
        ids = [good[u][0] for u in group if good[u][0] is not None]
        least = min(ids, default=None)
        out += [(good[u][0], int(near[u].sum()), least, good[u][0] == least) for u in group]
    out += [(i, 0, i, True) for i, v in rows if not (v and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    return sorted(out, key=str)


def test_vectors_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0]), (11, [0.0, 5.0]), (None, [0.0, 7.0]), (12, [1e-200, 0.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, key string")
    assert sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str) == brute(rows)
    assert vectors.near_duplicates(df.where("false")).count() == 0
    assert vectors.near_duplicates(df.where("vec_id in (4, 6)")).count() == 2


def test_vectors_cells_and_blocks(spark):
    """A group of a third of all rows, cells and small blocks: nothing is lost or counted twice."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 16))
    hot = base[0] + 0.02 * rng.normal(size=(300, 16))
    pairs = base[1:101] + 0.02 * rng.normal(size=(100, 16))
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *hot, *pairs])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vectors.near_duplicates(df, cell_size=100, block=64, sample_per_cell=40).collect()), key=str)
    assert got == brute(rows)


def test_vectors_at_the_threshold_in_many_cells(spark):
    """Partners at cosines of 0.90 to 0.95 in evenly spread vectors of 64 dims, about 60 cells: every link is found, as by brute force."""
    rng = np.random.default_rng(3)
    one = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    base = one(rng.normal(size=(1200, 64)))
    across = rng.normal(size=(600, 64))
    across = one(across - (across * base[:600]).sum(1)[:, None] * base[:600])
    cos = rng.uniform(0.9001, 0.95, 600)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *(cos * base[:600] + np.sqrt(1 - cos * cos) * across)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vectors.near_duplicates(df, cell_size=30, block=500, sample_per_cell=8).collect()), key=str)
    want = brute(rows)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)
    assert got == want
