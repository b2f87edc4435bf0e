"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is the majority vote, bit by bit, of the 64-bit hashes of a text's word shingles. Two fingerprints that differ in at
most two bits, cut into two segments of 32, have a segment with at most one differing bit, so both own the same one-wildcard
variant of that segment (the segment without one of its bits, and which bit and segment). Equal variants are met by an equality
join, and every meeting is verified on the whole fingerprints.

Copies share a fingerprint and are one row from the start. In a bucket of equal variants nothing is paired up: a linear search links
each fingerprint to the ones near it and only a spanning forest leaves the task. A bucket with more fingerprints than `split` is dealt
out again by the exact pieces of its other segment (of three pieces one is equal, as at most two bits differ), so that no task ever
holds more than the few fingerprints that share 42 bits.

`keep_one` can also go by the similarity of the shingle sets themselves, which fingerprints of 64 bits tell too coarsely: texts that
share four shingles in five differ in some ten bits. Fingerprints then are one source of candidates, bands of smallest hashes the
other, and every candidate is decided by the exact similarity of its whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batches, cut, id_and_text
from lodestone.llm.graph import connected_components

_WORD_END = bytes.maketrans(b"\t\n\x0b\f\r" + bytes(range(65, 91)), b"     " + bytes(range(97, 123)))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 with seed 42 of the shingles of a whole text, repeats included: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, `width` words each.

    A text of fewer words has one shingle, all its words; a text without a word has none.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_WORD_END).split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], "<u8")
    hashed = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((hashed(s, 42) for s in shingles), "<u8", len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; zero without any."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, width: int = 3) -> int:
    """The majority of a whole text's shingle hashes."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (signed long with the fingerprint's bits). Null text: no word."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it):
        for batch in batches(it, "text"):
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], schema=schema)

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, "doc_id long, fp long")


def _variants(fp, segment: int, bit: int):
    """One-wildcard variant as a long: the segment's other 31 bits, the bit's place and the segment's number."""
    part = F.shiftrightunsigned(fp, 32 * segment).bitwiseAND(F.lit((1 << 32) - 1))
    low = part.bitwiseAND(F.lit((1 << bit) - 1))
    high = F.shiftleft(F.shiftrightunsigned(part, bit + 1), bit)
    return F.shiftleft(F.lit(32 * segment + bit).cast("long"), 31).bitwiseOR(high).bitwiseOR(low)


def _union(parent: np.ndarray, i: int, j: int) -> bool:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    while parent[j] != j:
        parent[j] = parent[parent[j]]
        j = parent[j]
    parent[max(i, j)] = min(i, j)
    return i != j


def forest(fps: np.ndarray, bits: int, exact: int = 512) -> list[tuple[int, int]]:
    """Pairs of indices that span the graph of fingerprints within `bits` (1 or 2) differing bits; fps are distinct.

    Up to `exact` of them are compared in one block; more of them by sorting them among all their one-bit neighbours: those at two
    bits have a one-bit neighbour in common, so equal neighbours link their owners; those at one bit are the neighbour itself.
    Linear in their number but for the sort.
    """
    n, parent, out = len(fps), np.arange(len(fps)), []
    if n <= exact:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
        a, b = np.nonzero(np.triu(near, 1))
    else:
        flips = np.uint64(1) << np.arange(64, dtype=np.uint64)
        owner = np.arange(n)
        at, of = [fps], [owner]
        for flip in flips:
            at.append(fps ^ flip)
            of.append(owner)
        at, of = np.concatenate(at), np.concatenate(of)
        order = np.argsort(at, kind="stable")
        at, of = at[order], of[order]
        same = np.flatnonzero(at[1:] == at[:-1])
        a, b = of[same], of[same + 1]
        if bits == 1:  # of equal neighbours only the fingerprint that stands there itself, which the stable sort puts first, is one bit off
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            start = first[np.searchsorted(first, same, side="right") - 1]
            own = order[start] < n
            a, b = of[start[own]], b[own]
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if _union(parent, i, j):
            out.append((i, j))
    return out


def _link_buckets(rows: DataFrame, bits: int, most: int | None = None) -> DataFrame:
    """a, b: links that span each bucket's graph; rows: key columns, then fp. Buckets of more than `most` rows only give their key, as k."""
    keys = rows.columns[:-1]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64())])

    def batch_of(a: np.ndarray, b: np.ndarray, large: list[int]):
        a, b, none = pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(large), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, none]), pa.concat_arrays([b, none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(large, pa.int64())])], schema=schema)

    def changes(table: np.ndarray) -> np.ndarray:
        return np.flatnonzero((table[:-1, 1:] != table[:-1, :-1]).any(0)) + 1

    def links(table: np.ndarray, borders: np.ndarray):
        fps, size = np.ascontiguousarray(table[-1]).view(np.uint64), np.diff(borders)
        two = borders[:-1][size == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits]
        a, b, large = [fps[near]], [fps[near + 1]], []
        for start, n in zip(borders[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if most is not None and n > most:
                large.append(int(table[0, start]))
                continue
            some = fps[start : start + n]
            if pairs := forest(some, bits):
                i, j = np.array(pairs).T
                a.append(some[i])
                b.append(some[j])
        return batch_of(np.concatenate(a), np.concatenate(b), large)

    def run(it):
        held = skipped = None
        for batch in it:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if skipped is not None:  # the rest of a bucket that is too large
                table = table[:, (table[:-1] != skipped[:, None]).any(0)]
                if not table.shape[1]:
                    continue
                skipped = None
            if held is not None:
                table = np.concatenate([held, table], axis=1)
            if not table.shape[1]:
                continue
            cuts = changes(table)
            if len(cuts):
                yield links(table[:, : cuts[-1]], np.concatenate([[0], cuts]))
                table = table[:, cuts[-1] :]
            held = table
            if most is not None and held.shape[1] > most:
                skipped, held = held[:-1, 0].copy(), None
                yield batch_of(np.empty(0, np.uint64), np.empty(0, np.uint64), [int(skipped[0])])
        if held is not None and held.shape[1]:
            yield links(held, np.array([0, held.shape[1]]))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, k long")


def fingerprint_links(fps: DataFrame, split: int = 20_000) -> DataFrame:
    """a, b: links that span the graph of distinct fingerprints (column fp) within two differing bits; loses no connection."""
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = F.array(*[_variants(F.col("fp"), s, b) for s in (0, 1) for b in range(32)])
    rows = fps.select("fp").repartition(tasks).select(F.explode(both).alias("k"), "fp")  # few bytes a row, before they become 64 rows
    found = cut(_link_buckets(rows, 2, split), "variant-links")
    near, hot = found.where("k is null").select("a", "b"), found.where("k is not null").select("k").distinct()
    if hot.isEmpty():
        return near
    other = F.when(F.shiftrightunsigned("k", 36) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))  # of the other segment the low 32 bits
    pieces = F.array(*[F.lit(i << 11).cast("long").bitwiseOR(F.expr(f"shiftrightunsigned(other, {at}) & {(1 << n) - 1}L")) for i, (at, n) in enumerate(((0, 11), (11, 11), (22, 10)))])
    again = rows.join(hot, "k").withColumn("other", other).select("k", F.explode(pieces).alias("k2"), "fp")
    return near.union(_link_buckets(again, 2).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most two differing bits.

    One row for each row of docs. Empty and null texts have fingerprint zero and link like any other. Rows with null doc_id get a
    component but never name one; a component of such rows only has null as its id.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width), "fingerprints")
    one = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(one.select("fp")))
    linked = one.join(roots.toDF("fp", "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(linked.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, width: int) -> np.ndarray:
    """Distinct shingle hashes of a whole text, ascending. No word: none."""
    return np.unique(shingle_hashes(text, width))


#: Smallest hashes of a set under so many orders, and how many of them make a band. Sets of similarity s share one of the 16 bands but
#: for a chance of (1 - s ** 4) ** 16, at 0.8 of 0.0002.
_ORDERS, _BAND = 64, 4
_FACTORS = np.random.default_rng(42).integers(1 << 62, (1 << 63) - 1, _ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Equal halves of a byte, by the exclusive or of two bytes.
_EQUAL_HALVES = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], np.uint8)


def smallest_hashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each of the orders; a set without members has the largest number everywhere."""
    out = np.full(_ORDERS, ~np.uint64(0))
    for at in range(0, len(shingles), 2048):
        np.minimum(out, (_FACTORS[:, None] * shingles[None, at : at + 2048]).min(1), out=out)
    return out


def bands(smallest: np.ndarray) -> list[int]:
    """A signed long for each band, equal for equal bands only (but for a chance of 2 ** -64)."""
    return [int(np.uint64(xxhash.xxh64_intdigest(smallest[i : i + _BAND].tobytes(), i)).view(np.int64)) for i in range(0, _ORDERS, _BAND)]


def sketch_of(smallest: np.ndarray) -> bytes:
    """Four bits of each of the smallest hashes, two to a byte."""
    high = (smallest >> np.uint64(60)).astype(np.uint8)
    return (high[::2] << 4 | high[1::2]).tobytes()


def least_equal(similarity: float) -> int:
    """Of 64 four-bit hashes so many are equal at least in sets of that similarity, five standard deviations being allowed for."""
    p = similarity + (1 - similarity) / 16
    return max(0, int(_ORDERS * p - 5 * (_ORDERS * p * (1 - p)) ** 0.5))


def _alike(n: np.ndarray, sketch: np.ndarray, similarity: float, i, j) -> np.ndarray:
    """Whether sets i and j may be so similar, by size (exact) and sketch."""
    equal = _EQUAL_HALVES[sketch[i] ^ sketch[j]].sum(-1, dtype=np.int64)
    return (equal >= least_equal(similarity)) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)


def _spanning(side: np.ndarray, near) -> list[tuple[int, int]]:
    """Pairs that span the graph of the nodes; near(i, some) tells which of some are linked to i. Nodes found are not compared again.

    Only nodes of unlike sides are compared, or all where the sides are negative: then the nodes are one block.
    """
    out, left = [], np.arange(len(side))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            open_ = np.flatnonzero(side[left] != side[i]) if side[i] >= 0 else np.arange(len(left))
            hit = open_[near(i, left[open_])]
            new = left[hit].tolist()
            out += [(i, j) for j in new]
            front += new
            left = np.delete(left, hit)
    return out


def _links_of(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _in_blocks(rows: DataFrame, key: str, blocks, member: str = "set") -> DataFrame:
    """Rows once for each pair of blocks of their key that theirs is one of, with `work` (which pair) and `side` (-1 within a block, else 0 or 1).

    A key of one block is as it was. Every two members of a key meet in one pair of blocks (or in their own block).
    """
    df = rows.withColumn("_blocks", blocks).withColumn("_mine", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    work = F.when(F.col("_blocks") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("_mine", "_other"), F.greatest("_mine", "_other")))
    side = F.when(F.col("_mine") == F.col("_other"), -1).otherwise((F.col("_mine") > F.col("_other")).cast("int"))
    return df.withColumns({"work": work, "side": side}).drop("_blocks", "_mine", "_other")


def _band_links(one: DataFrame, similarity: float, split: int) -> DataFrame:
    """a, b: links that span each band's graph of sets whose sizes and sketches allow the similarity; one: set, n, keys, sketch.

    Bands that very many sets share are found on a sample of the sets before anything is shuffled (one in 64, so any band of `split`
    sets shows; at most one in split / 128 of the sampled rows is such a band, which bounds what is broadcast) and are dealt out in
    blocks, each pair of which is a task's work.
    """
    keyed = one.select(F.explode("keys").alias("k"), "set", "n", "sketch")
    rare = max(2, split // 128)
    hot = one.where(F.col("set").bitwiseAND(63) == 0).select(F.explode("keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= rare)
    hot = cut(hot.select("k", F.ceil(F.col("m") * 128 / split).cast("int").alias("blocks")), "hot-bands")
    rows = _in_blocks(keyed.join(F.broadcast(hot), "k", "left"), "k", F.coalesce("blocks", F.lit(1))).select("work", "set", "n", "sketch", "side")

    def links(parts, last: bool):
        k, of, n, sketch, side = (np.concatenate(x) for x in zip(*parts, strict=True))
        borders = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        done = len(borders) - 1 if last else len(borders) - 2
        start, size = borders[:done], np.diff(borders)[:done]
        two = start[size == 2]
        two = two[((side[two] < 0) | (side[two] != side[two + 1])) & _alike(n, sketch, similarity, two, two + 1)]
        a, b = of[two].tolist(), of[two + 1].tolist()
        for at, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for i, j in _spanning(side[at : at + m], lambda i, some, at=at: _alike(n, sketch, similarity, at + i, at + some)):
                a.append(int(of[at + i]))
                b.append(int(of[at + j]))
        rest = borders[done]
        return _links_of(a, b), [tuple(x[rest:] for x in (k, of, n, sketch, side))] if rest < len(k) else []

    def run(it):
        held = []
        for batch in it:
            if not len(batch):
                continue
            k, of, n, side = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            held.append((k, of, n, np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(k), -1), side))
            if held[0][0][0] != k[-1]:
                out, held = links(held, False)
                yield out
        if held:
            yield links(held, True)[0]

    return rows.repartition("work").sortWithinPartitions("work").mapInArrow(run, "a long, b long")


def _fingerprint_candidates(one: DataFrame) -> DataFrame:
    """a, b: sets with one fingerprint, each with the smallest, and sets whose fingerprints deletion variants link."""
    first = cut(one.groupBy("fp").agg(F.min("set").alias("first")), "fingerprint-sets")
    same = one.select("fp", "set").join(first, "fp").where("set <> first").select(F.col("set").alias("a"), F.col("first").alias("b"))
    near = fingerprint_links(first.select("fp"))
    named = near.join(first.toDF("a", "sa"), "a").join(first.toDF("b", "sb"), "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    return same.union(named)


def _similar_links(table: pa.Table, width: int, similarity: float) -> pa.Table:
    """Links that span the graph of a piece of work's sets (columns set, text, side) with at least that similarity, by exact counts."""
    of, side = (table[c].to_numpy() for c in ("set", "side"))
    sets = [shingle_set(t.as_py() or "", width) for t in table["text"]]
    n = np.array([len(x) for x in sets], np.int64)
    sketch = np.frombuffer(b"".join(sketch_of(smallest_hashes(x)) for x in sets), np.uint8).reshape(len(of), -1)

    def near(i, some):
        hit = np.zeros(len(some), bool)
        for at in np.flatnonzero(_alike(n, sketch, similarity, i, some)):
            mine, other = sets[i], sets[some[at]]
            place = np.searchsorted(mine, other)
            common = int((mine[np.minimum(place, len(mine) - 1)] == other).sum())
            hit[at] = common >= similarity * (len(mine) + len(other) - common)
        return hit

    pairs = _spanning(side, near)
    return pa.Table.from_batches([_links_of([int(of[i]) for i, _ in pairs], [int(of[j]) for _, j in pairs])])


#: Rows of a few numbers that are broadcast at most, some 50 MB in an executor; more of them meet the texts by a shuffle.
MOST_BROADCAST = 1 << 19


def _few(rows: DataFrame, n: int) -> DataFrame:
    """n rows to be joined to texts, which are shuffled only where the rows are too many to broadcast."""
    return F.broadcast(rows) if n <= MOST_BROADCAST else rows.hint("shuffle_hash")


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of a shingle set; sets that share one are told apart by a second hash."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42)


def _distinct_sets(marked: DataFrame) -> DataFrame:
    unlike = (F.min("other") != F.max("other")).alias("unlike")
    return marked.groupBy("set").agg(*[F.min(c).alias(a) for c, a in (("doc_id", "least"), ("fp", "fp"))], *[F.first(c).alias(c) for c in ("n", "keys", "sketch")], unlike)


def similar_components(placed: DataFrame, at: str, text_col: str, width: int, similarity: float, split: int = 20_000, block: int = 1024, block_words: int = 1 << 20, key_of=set_key) -> DataFrame:
    """doc_id, component_id: the smallest `at` reachable over links of shingle sets with Jaccard similarity >= `similarity`.

    `at` is a key of the rows; rows with one key have one text. Equal sets are one row from the start and texts without a word are copies. Sets whose fingerprints lie within two bits, and sets
    that share a band of smallest hashes and whose sizes and sketches allow the similarity, make groups; within each the sets are
    compared exactly, from the whole texts. A group is dealt out in blocks of about `block` sets and `block_words` words, each pair
    of which is a task's work, so that no task holds more, however large the group.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(it):
        for batch in batches(it, "text"):
            of, other, n, fps, keys, sketches = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, width)
                shingles = np.unique(hashes)
                smallest = smallest_hashes(shingles)
                of.append(key_of(shingles))
                other.append(xxhash.xxh64_intdigest(shingles.tobytes(), 43))
                n.append(len(shingles))
                fps.append(majority(hashes))
                keys.append(bands(smallest))
                sketches.append(sketch_of(smallest))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (of, other, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), signed[0], signed[1], pa.array(n, pa.int64()), signed[2], pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=schema)

    marked = cut(id_and_text(placed, at, text_col).mapInArrow(run, "doc_id long, set long, other long, n long, fp long, keys array<long>, sketch binary"), "shingle-sets")
    one = cut(_distinct_sets(marked), "distinct-sets")
    shared = cut(one.where("unlike").select("set"), "shared-keys")
    if n := shared.count():  # unlike sets with one key get keys of both their hashes
        own = marked.join(_few(shared.withColumn("twice", F.lit(True)), n), "set", "left")
        marked = cut(own.withColumn("set", F.when(F.col("twice"), F.xxhash64("set", "other")).otherwise(F.col("set"))).drop("twice"), "shingle-sets")
        one = cut(_distinct_sets(marked), "distinct-sets")
    groups = connected_components(_band_links(one, similarity, split).union(_fingerprint_candidates(one))).toDF("set", "group")
    members = cut(one.select("set", "least", "n").join(groups, "set"), "set-groups")
    sizes = members.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / block_words)).cast("int").alias("blocks"))
    several = members.join(sizes, "group").select(F.col("least").alias(at), "set", "group", "blocks")
    texts = placed.select(at, F.col(text_col).alias("text")).join(_few(several, members.count()), at)
    if marked.count() > marked.select("doc_id").distinct().count():
        texts = texts.dropDuplicates([at])
    work = _in_blocks(texts, "group", F.col("blocks")).select("work", "set", "side", "text")
    roots = connected_components(work.groupBy("work").applyInArrow(lambda t: _similar_links(t, width, similarity), "a long, b long"))
    linked = one.select("set", "least").join(roots.toDF("set", "root"), "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(linked.join(least, "root").select("set", "component_id"), "set-components")
    return marked.select("doc_id", "set").join(named, "set").select("doc_id", "component_id")


def row_key(docs: DataFrame, order: int = 0):
    """A 64-bit hash of a row's columns, the same for equal rows wherever they lie; another one for each order."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    places = [F.when(F.col(f"`{f.name}`").isNull(), i).otherwise(-1) for i, f in enumerate(docs.schema)]  # a null by itself leaves a hash as it is
    return F.xxhash64(*[F.lit(order)] * (order > 0), *plain, *places)


def _keyed(docs: DataFrame, at: str, other: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs with a key, and a: i, h, m (least identifier, least text hash, rows) of every key. Unlike rows have unlike keys.

    Two hashes are taken of each row. Rows that share the first but not the second, few if any among 10^11, are known by a hash of both
    instead; what then still goes wrong has a chance of about 10^-17 in all at 10^11 rows.
    """

    def facts(rows: DataFrame) -> DataFrame:
        ids = rows.select(F.col(at).alias("a"), F.col(other).alias("o"), F.col(id_col).cast("long").alias("i"), F.xxhash64(F.col(text_col)).alias("h"))
        return cut(ids.groupBy("a").agg(F.min("i").alias("i"), F.min("h").alias("h"), F.count(F.lit(1)).alias("m"), (F.min("o") != F.max("o")).alias("unlike")), "row-keys")

    keyed = docs.withColumns({at: row_key(docs), other: row_key(docs, 1)})
    ids = facts(keyed)
    shared = cut(ids.where("unlike").select(F.col("a").alias(at)), "shared-keys")
    if n := shared.count():
        flag = other + "_"
        while flag in docs.columns:
            flag += "_"
        keyed = keyed.join(_few(shared.withColumn(flag, F.lit(True)), n), at, "left").withColumn(at, F.when(F.col(flag), F.xxhash64(at, other)).otherwise(F.col(at)))
        ids = facts(keyed)
    return keyed, ids


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None, **limits) -> DataFrame:
    """The rows of docs, columns as they are, that are the first of their component: smallest doc_id, nulls last.

    Components are those of `near_duplicates`, or with a similarity those of shingle sets at least so similar (Jaccard), with the
    limits of `similar_components`. Of rows with one doc_id in one component the one with the smallest text hash stays, then with the
    smallest hash of all columns; of equal rows one stays. Rows are known by 128 bits of their contents alone, so that it doesn't matter in what
    places each job reads them and nothing is numbered. Null and empty texts are copies of each other; no rows give no rows.
    """
    at = "_at"
    while at in docs.columns:
        at += "_"
    other = at + "other"
    while other in docs.columns:
        other += "_"
    keyed, ids = _keyed(docs, at, other, id_col, text_col)
    if similarity is None:
        found = near_duplicates(keyed.select(at, text_col), at, text_col, width)
    else:
        found = similar_components(keyed.select(at, text_col), at, text_col, width, similarity, **limits)
    keys = found.groupBy(F.col("doc_id").alias("a")).agg(F.min("component_id").alias("of"))
    placed = cut(ids.join(keys, "a"), "row-components")
    order = F.struct(F.col("i").isNull().alias("n"), "i", "h", "a", "m")
    first = cut(placed.groupBy("of").agg(F.min(order).alias("x")).select("x.a", "x.m"), "first-copies")
    dropped = cut(placed.select("a").join(first.select("a"), "a", "left_anti").withColumnRenamed("a", at), "other-copies")
    out = keyed.join(_few(dropped, dropped.count()), at, "left_anti")
    again = first.where("m > 1").select(F.col("a").alias(at))
    if n := again.count():  # equal rows: each of them is as good as the others
        again = _few(again, n)
        out = out.join(again, at, "left_anti").unionByName(out.join(again, at, "left_semi").dropDuplicates([at]))
    return out.select(*[f"`{c}`" for c in docs.columns])
