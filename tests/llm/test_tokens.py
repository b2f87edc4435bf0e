"""Token shards and backtracking BPE against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe, sstable

POOLS = ("abcdefghij lmnoprst'", "the quick'll've're's't'd'm ", "".join(map(chr, range(32, 0x250))), "\x00\x1c\x1f\x85\xa0 ab", "ΣσςαβΑΒİıſéÉ1²½٣", "漢字仮名交じり文한국어🙂👩", "!?.,;:-_=+*&^%$#@ ")


def texts(n, seed=3):
    rng = random.Random(seed)
    for _ in range(n):
        pool = "".join(rng.sample(POOLS, rng.randrange(1, 4)))
        s = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        yield s[:5] + rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endoftext|"]) + s[5:] if rng.random() < 0.1 else s


def test_backtracking_equals_library(paths):
    lib, own = Tokenizer.from_file(paths["word_bpe_49k.json"]), bpe.Bpe(paths["word_bpe_49k.json"])
    for t in texts(5000):
        want = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert got.tolist() == want, ascii(t)
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_full_cache_changes_nothing(paths):
    small, own = bpe.Bpe(paths["word_bpe_49k.json"], cache=3), bpe.Bpe(paths["word_bpe_49k.json"])
    enc, whole = sstable.TextEncoder(paths["byte_bpe_50k.json"], cache=3), sstable.TextEncoder(paths["byte_bpe_50k.json"])
    some = list(texts(300, 5))
    assert [small.encode(t).tolist() for t in some] == [own.encode(t).tolist() for t in some]
    assert enc.encode(some) == whole.encode(some)


def test_encoder_equals_library(paths):
    lib, own = Tokenizer.from_file(paths["byte_bpe_50k.json"]), sstable.TextEncoder(paths["byte_bpe_50k.json"])
    some = list(texts(5000, 4))
    for t, v in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(v, own.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_digests(spark, edge_documents, empty_documents, paths):
    import hashlib

    lib = Tokenizer.from_file(paths["word_bpe_49k.json"])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in edge_documents.select("doc_id", "text").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.encoded_digests(edge_documents, paths["word_bpe_49k.json"]).collect()), key=str) == sorted(want, key=str)
    assert bpe.encoded_digests(empty_documents, paths["word_bpe_49k.json"]).count() == 0


def test_round_trip_of_frames(spark, edge_documents, paths):
    lib = Tokenizer.from_file(paths["word_bpe_49k.json"])
    enc = bpe.encode_documents(edge_documents, paths["word_bpe_49k.json"])
    got = {r.doc_id: r.text for r in bpe.decode_documents(enc, paths["word_bpe_49k.json"]).where("doc_id > 7").collect()}
    for r in edge_documents.where("doc_id > 7").collect():
        assert got[r.doc_id] == lib.decode(lib.encode(r.text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_shards(spark, edge_documents, empty_documents, paths):
    lib = Tokenizer.from_file(paths["byte_bpe_50k.json"])
    manifest = sstable.write_shards(edge_documents, paths["byte_bpe_50k.json"], shards=3, block_bytes=500)
    got = sorted(map(tuple, sstable.read_shards(manifest).collect()), key=lambda r: r[1])
    rows = [(r.doc_id, [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in edge_documents.collect()]
    want = sorted((i is not None, i or 0, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for i, ids in rows)
    assert sorted((r[0] is not None, r[0] or 0, r[3], r[2]) for r in got) == want
    assert [(r[0] is not None, r[0] or 0) for r in got] == [w[:2] for w in want]  # ascending, null first
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    found = sstable.lookup(manifest, spark.createDataFrame([(2,), (-3,), (99,), (None,)], "doc_id long")).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in found) == sorted((str(i), len(ids)) for i, ids in rows if i in (2, -3, None))
    none = sstable.write_shards(empty_documents, paths["byte_bpe_50k.json"])
    assert none.count() == 0 and sstable.read_shards(none).count() == 0


def test_shard_file(tmp_path):
    path = str(tmp_path / "a.sst")
    with open(path, "wb") as f:
        w = sstable.Writer(f, 2, block_bytes=300)
        for i in range(-500, 500, 2):
            w.add(sstable.key_of(i), np.arange(abs(i) % 7, dtype="<u2").tobytes())
        w.close()
    r = sstable.Reader(path)
    assert r.entries == 500 and len(r.index) > 5
    assert all(len(r.get(i)[0]) == abs(i) % 7 for i in range(-500, 500, 2))
    assert all(r.get(i) == [] for i in range(-501, 501, 2))
    assert sum(r.may_hold(sstable.key_of(i)) for i in range(1001, 21001)) < 400
    assert [k for k, _ in r.scan()] == list(range(-500, 500, 2))
    with open(path, "r+b") as f:
        f.seek(10)
        f.write(b"\xff")
    with pytest.raises(ValueError):
        sstable.Reader(path).get(-500)
