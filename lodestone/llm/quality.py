"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the text alone. Training is on the driver over a bounded sample of labelled rows; trees are complete and
lie flattened in arrays (feature, threshold, leaf value by position), so a batch walks down all trees by numpy indexing.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batches, bound_batches, cut, hash_sample, id_and_text

_SYMBOLS, _UPPER, _LOWER, _DIGITS, _PUNCT = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:!?\"'()-"
NAMES = ("log_words", "log_chars", "mean_word", "long_words", "unique", "top_word", "symbols", "bars", "bangs", "upper", "digits", "punct", "other_bytes", "windows_again", "same_next", "lines", "lines_again", "line_words", "odd_words", "stops", "char_kinds", "edge_symbols")


def statistics(text: str) -> list[float]:
    """The numbers in NAMES of one whole text; all zero where there is no word."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size, share = len(raw), lambda some: (len(raw) - len(raw.translate(None, some))) / len(raw)
    counted = Counter(words)
    inside = sum(map(len, words))
    grams = set(zip(words, words[1:], words[2:], strict=False)) if n > 2 else ()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = list(counted)
    longs = sum(c for w, c in counted.items() if len(w) > 14)
    odd = sum(c for w, c in counted.items() if not w.strip(_PUNCT + _SYMBOLS))
    edges = sum(c for w, c in counted.items() if w[-1:] in b"#*$%&|<>!" or w[:1] in b"#*$%&|<>")
    again = sum(map(bytes.__eq__, words, words[1:]))
    return [
        math.log1p(n),
        math.log1p(size),
        inside / n,
        longs / n,
        len(distinct) / n,
        max(counted.values()) / n,
        share(_SYMBOLS),
        share(b"|"),
        share(b"!"),
        share(_UPPER),
        share(_DIGITS),
        share(_PUNCT),
        1 - len(raw.translate(None, bytes(range(128, 256)))) / size,
        1 - len(grams) / (n - 2) if n > 2 else 0.0,
        again / n,
        math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        odd / n,
        raw.count(b".") / n,
        math.log1p(len(set(raw))),
        edges / n,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stats (array<double>) of every row; null text: empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])

    def run(it):
        for batch in batches(it, "text"):
            stats = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], schema=schema)

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Trees:
    """Flattened trees: row t of each array is a complete tree, node i's children are 2i+1 and 2i+2; leaves are the last level."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 by row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.value[t, node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 5.0) -> Trees:
    """Boosting of the logistic loss; splits are searched over histograms of at most `bins` quantile bins a feature.

    Without rows the score is 0.5 for all; with one class only it is that class's smoothed share.
    """
    n, nodes = len(y), 2**depth - 1
    positive = (y.sum() + 1) / (n + 2)
    model = Trees(math.log(positive / (1 - positive)), depth, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    total = np.full(n, model.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, gain = [None] * width, np.full(width, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * bins + binned[f]
                hg, hh = (np.bincount(at, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h))
                tg, th = hg[:, -1:], hh[:, -1:]
                won = hg**2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg**2 / (th + ridge)
                won[(hh < least * 0.1) | (th - hh < least * 0.1)] = 0
                won[:, len(e) :] = 0
                top = won.argmax(1)
                for k in np.flatnonzero(won[np.arange(width), top] > gain):
                    gain[k], best[k] = won[k, top[k]], (f, top[k])
            right = np.zeros(n, bool)
            for k, found in enumerate(best):
                if found:
                    f, b = found
                    feature[first + k], threshold[first + k] = f, edges[f][b]
                    mine = node == first + k
                    right[mine] = binned[f][mine] > b
            node = 2 * node + 1 + right
        leaf = node - nodes
        value = -rate * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + ridge)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    model.feature, model.threshold, model.value = np.array(features), np.array(thresholds), np.array(values)
    return model


def remainder(doc_id, parts: int = 4):
    """crc32 of the identifier as text, modulo `parts`; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int = 2, sample: int = 30_000, label_col: str = "quality", id_col: str = "doc_id", doc_col: str = "doc_id") -> DataFrame:
    """key (doc_id), y: at most `sample` pairs of a row of docs and its label, drawn by hash of both; no identifier with the held-out remainder."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(remainder(F.col("doc_id")) != held_out)
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id")).join(known, "doc_id").select(F.struct("doc_id", "y").alias("key"))
    return hash_sample(rows, "key", sample, known.count()).select(F.col("key.doc_id").alias("doc_id"), F.col("key.y").alias("y"))


def train(stats: DataFrame, chosen: DataFrame, sample: int = 30_000) -> Trees:
    """Fit on the statistics of the chosen training rows, at most `sample` of them where rows repeat a doc_id.

    No chosen rows: a model that scores 0.5.
    """
    rows = stats.join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", "y", "stats")  # the chosen are at most `sample` rows
    got = rows.orderBy(F.xxhash64("doc_id", "y"), "doc_id", "y", "stats").limit(sample).toArrow()
    x = np.array(got.column(2).to_pylist(), float).reshape(len(got), len(NAMES))
    return fit(x, got.column(1).to_numpy().astype(float))


def score(stats: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score of every row of statistics."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(it):
        for batch in it:
            if len(batch):
                x = batch.column(1).flatten().to_numpy().reshape(len(batch), len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], schema=schema)

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """doc_id, held_out, score, predicted; one row a row of docs, repeated rows repeated, none for an empty table.

    Empty and null texts get the score of all-zero statistics. A null doc_id is never trained on and not held out. Without labels
    every score is 0.5. Other columns of docs, whatever their names, play no part.
    """
    stats = cut(with_statistics(docs, id_col, text_col), "statistics")
    scored = score(stats, train(stats, training_rows(stats, labels, **training), training.get("sample", 30_000)))
    held = F.coalesce(remainder(F.col("doc_id")) == training.get("held_out", 2), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """The rows of docs, columns as they are, whose score reaches the threshold.

    Statistics for training are taken of the chosen labelled rows only, then once of every row. Null and empty texts score as
    all-zero statistics; rows with a null doc_id are scored like any other. Repeated rows stay or go together.
    """
    chosen = cut(training_rows(docs, labels, doc_col=id_col, **training), "training-rows")
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    model = train(with_statistics(some), chosen, training.get("sample", 30_000))

    def run(it):
        for batch in it:
            for part in batches(iter([batch]), text_col):
                if len(part):
                    stats = [statistics(t or "") for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                    yield part.filter(pa.array(model.score(np.array(stats)) >= threshold))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
