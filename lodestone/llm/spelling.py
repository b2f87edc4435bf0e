"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Words are maximal runs of `[A-Za-z\\u00C0-\\u00FF]`, so each is a string of Latin-1 bytes. Two words are near if one inserted,
deleted or replaced letter parts them: a longer word t and an edit position i such that what stands before i in t begins the other word
and what stands after i ends it. In the forward order of all words of t's length the prefix is an interval, in the order of the
reversed words the suffix is one, and the words looked for are the points of the permutation between both orders that lie in the
rectangle. A wavelet tree over the permutation reports them level by level, for all words and positions of a group at once in numpy.

The dictionary is never whole in one task. A group holds the words of one length that share all but a free stretch of positions, and
finds the edits within that stretch; it starts with half the word free, either half. A group with more than `most_words` rows is split
anew: half its stretch stays free, the other half becomes part of the key, once for each half. Every edit position thus lies in just
one group of each word, whatever was split, and so each pair is found once. Small groups of one stretch are dealt by hash into bundles of about
`most_words`, each searched as a whole: near words share the group and so the bundle. The splits end by themselves: words that share all but one
letter are 90 at most.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batches, cut, id_and_text

#: Latin-1 bytes that belong to runs, A-Z lower-cased; all others become blanks, and code points beyond Latin-1 a question mark first.
_RUN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Words that a task holds before it hands their counts on.
HELD = 300_000
#: Of so many occurrences, by checksum of document and run, one loses a letter.
DAMAGED_OF = 97
#: Rectangles that are followed down the wavelet tree at once.
AT_ONCE = 1 << 18


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_RUN_BYTES).split()


def altered(doc: bytes, run: bytes) -> bytes:
    """The run as document `doc` has it: without one of its letters where the checksum says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(doc))
    if h % DAMAGED_OF:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
        n.clear()
        return batch

    for batch in batches(it, "text"):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc = b"%s:" % (b"" if i is None else str(i).encode())
            for run, k in Counter(runs(text)).items():
                n[altered(doc, run)] += k
            if len(n) > HELD:
                yield out()
    if n:
        yield out()


def dictionary(docs: DataFrame, least_letters: int = 5, least_n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: every word of so many letters with so many occurrences over all documents."""
    counted = id_and_text(docs, id_col, text_col).mapInArrow(_counted, "word string, n long")
    return counted.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class Wavelet:
    """A permutation as a wavelet tree, one level a bit, the values of a level grouped by their higher bits."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.ones = [], []
        level = values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = level >> b & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(int(len(bit) - bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))  # all zeros of a level stand before its ones

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rectangles of positions [lo, hi) and values [least, most): (rectangle, value) of every point inside."""
        at = np.flatnonzero((lo < hi) & (least < most))
        lo, hi, node = lo[at], hi[at], np.zeros(len(at), np.int64)
        for k in range(self.bits):
            b = self.bits - 1 - k
            ones = self.ones[k]
            lo1, hi1 = ones[lo], ones[hi]
            sides = ((lo - lo1, hi - hi1, node), (self.zeros[k] + lo1, self.zeros[k] + hi1, node | 1 << b))
            kept = []
            for s_lo, s_hi, s_node in sides:
                keep = (s_lo < s_hi) & (s_node < most[at]) & (s_node + (1 << b) > least[at])
                kept.append((at[keep], s_lo[keep], s_hi[keep], s_node[keep]))
            at, lo, hi, node = (np.concatenate(x) for x in zip(*kept, strict=True))
        return at, node


def _bytes_of(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def _as_keys(letters: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel() if letters.shape[1] else np.zeros(len(letters), "S1")


def near_in(targets: list[bytes], queries: list[bytes], first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, target) of every pair parted by one edit at a position of [first, last) in the target; all targets of one length, queries of it or one less.

    Queries as long as the targets are met by replacing a letter, shorter ones by inserting one; of equal letters in a row the first is taken as
    inserted, so a pair has one position.
    """
    length = len(targets[0])
    letters = _bytes_of(targets, length)
    forward = np.argsort(_as_keys(letters), kind="stable")
    ordered, back = letters[forward], letters[:, ::-1]
    backward = np.argsort(_as_keys(back), kind="stable")
    reversed_ = back[backward]
    place = np.empty(len(targets), np.int64)
    place[backward] = np.arange(len(targets))
    tree = Wavelet(place[forward])
    by_prefix, by_suffix = _as_keys(ordered), _as_keys(reversed_)

    def interval(keys: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that begin with each part."""
        full = np.full((len(parts), length), 255, np.uint8)
        full[:, : parts.shape[1]] = parts
        low = np.zeros_like(full)
        low[:, : parts.shape[1]] = parts
        return np.searchsorted(keys, _as_keys(low), "left"), np.searchsorted(keys, _as_keys(full), "right")

    for short in (False, True):
        asked = np.array([j for j, q in enumerate(queries) if len(q) == length - short], np.int64)
        if not len(asked):
            continue
        every = _bytes_of([queries[j] for j in asked], length - short)
        step = max(1, AT_ONCE // max(1, last - first))
        for begin in range(0, len(asked), step):
            who, q = asked[begin : begin + step], every[begin : begin + step]
            for i in range(first, last):
                lo, hi = interval(by_prefix, q[:, :i])
                least, most = interval(by_suffix, q[:, i + (not short) :][:, ::-1])
                at, value = tree.report(lo, hi, least, most)
                found = backward[value]
                new = letters[found, i]
                fit = new != letters[found, i - 1] if short and i else np.ones(len(at), bool) if short else new != q[at, i]
                yield who[at[fit]], found[fit]


def _place(words: DataFrame) -> DataFrame:
    """Each word among the words of its length, and asking there and among those one letter longer, once with either half free."""
    size = F.char_length("word")
    roles = F.array(F.struct(size.alias("length"), F.lit(True).alias("target")), F.struct((size + 1).alias("length"), F.lit(False).alias("target")))
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*", F.lit(0).alias("first"), F.col("r.length").alias("last"), F.lit("").alias("shared"))
    return _halved(rows)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row with either half of its free stretch left free, the other half added to what its group shares."""
    mid = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    # a shorter word has the letters after the edit one place further to the left
    shift = F.when(F.col("target"), F.lit(0)).otherwise(F.lit(1))
    piece = lambda a, b: F.substring("word", a + 1, b - a)
    back_free = F.struct(mid.alias("first"), F.col("last"), F.concat("shared", F.lit("<"), piece(F.col("first"), mid)).alias("shared"))
    front_free = F.struct(F.col("first"), mid.alias("last"), F.concat("shared", F.lit(">"), piece(mid - shift, F.col("last") - shift)).alias("shared"))
    return rows.select("length", F.explode(F.array(front_free, back_free)).alias("s"), "word", "n", "target").select("length", "s.*", "word", "n", "target")


_STRETCH = ["length", "first", "last"]
_GROUP = [*_STRETCH, "shared"]


def _bundles(words: DataFrame, most_words: int) -> DataFrame:
    """Words placed in groups of at most `most_words` rows, or of one free letter, and small groups of one stretch in bundles of about that size."""
    rows, done = cut(_place(words), "placed"), None
    while True:
        sizes = rows.where("last - first > 1").groupBy(*_GROUP).agg(F.count("*").alias("members"))
        large = cut(sizes.where(F.col("members") > most_words).select(*_GROUP), "large-groups")
        split = not large.isEmpty()
        left = rows.join(large, _GROUP, "left_anti") if split else rows
        done = left if done is None else done.unionByName(left)
        if not split:
            break
        rows = cut(_halved(rows.join(large, _GROUP, "left_semi")), "placed")
    shares = done.groupBy(*_STRETCH).agg(F.ceil(F.count("*") / most_words).alias("bundles"))
    return done.join(cut(shares, "bundles"), _STRETCH).withColumn("bundle", F.pmod(F.xxhash64("shared"), "bundles")).select(*_STRETCH, "bundle", "word", "n", "target")


def _credits(words: list[bytes], n: np.ndarray, met: np.ndarray, count: np.ndarray, best: np.ndarray) -> pd.DataFrame:
    named = lambda at: np.array([words[j].decode("latin-1") for j in at], object)
    return pd.DataFrame({"word": pd.Series(named(met), dtype=object), "n_near": count, "near": pd.Series(named(best), dtype=object), "near_n": n[best]})


def _credit(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each word of a bundle that is near another: how many it meets here and the most frequent of them."""
    words = [w.encode("latin-1") for w in pdf["word"]]
    n, target = pdf["n"].to_numpy(np.int64), pdf["target"].to_numpy(bool)
    at = np.flatnonzero(target)
    targets = [words[j] for j in at]
    if not targets:
        return _credits(words, n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(np.array(words), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    # frequency first, then the smaller word: one sortable number
    prize = np.empty(len(words), np.int64)
    prize[np.lexsort((-rank, n))] = np.arange(len(words))
    by_prize = np.argsort(prize)
    for q, t in near_in(targets, words, int(pdf["first"].iloc[0]), int(pdf["last"].iloc[0])):
        t = at[t]
        short = np.array([len(words[j]) for j in q], np.int64) < len(targets[0]) if len(q) else np.zeros(0, bool)
        for one, other in ((q, t), (t[short], q[short])):
            np.add.at(count, one, 1)
            np.maximum.at(best, one, prize[other])
    met = np.flatnonzero(count)
    return _credits(words, n, met, count[met], by_prize[best[met]])


def near_words(words: DataFrame, most_words: int = 20_000) -> DataFrame:
    """word, n_near, near, near_n: for each word that is near another, how many are and the most frequent one (the smallest of equal ones)."""
    found = _bundles(words, most_words).groupBy(*_STRETCH, "bundle").applyInPandas(_credit, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.near", (-F.col("b.less")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of all words that have a form: the end of the chain of forms, by doubling steps. Counts at least double along it."""
    steps = cut(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if steps.join(ahead, "root", "left_semi").isEmpty():
            return steps
        steps = cut(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "steps")


def variants(docs: DataFrame, least_letters: int = 5, least_n: int = 3, most_words: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n; one row a word of the dictionary.

    A word's form is its most frequent near word (the smallest of equal ones) if that occurs at least twice as often, else null; the root is where
    the chain of forms ends, the word itself if it has none. Null and empty texts have no words, a null doc_id enters the checksum as the empty
    string, repeated rows count each, no rows give no rows. Very long runs are words like others. Only the two named columns are read.
    """
    words = cut(dictionary(docs, least_letters, least_n, id_col, text_col), "words")
    known = words.join(cut(near_words(words, most_words), "near"), "word", "left")
    formed = F.col("near_n") >= 2 * F.col("n")
    rows = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    ends = _roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
