"""Listing and scoring of a batch of questions' terms inside tasks, on Arrow batches of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Sums of a chunk and a question, and addends of such sums, that a task holds at a time, about.
PAIRS_A_BLOCK, ADDENDS_A_BLOCK = 250_000, 1_000_000
#: Bytes of text that are split at a time, about.
TEXTS_A_PIECE = 2_000_000


def _places(tokens: pa.Array, asked: pa.Array) -> np.ndarray:
    """Each token's place in asked, or -1."""
    if pa.types.is_dictionary(tokens.type):
        return _places(tokens.dictionary, asked)[tokens.indices.to_numpy()]
    return pc.fill_null(pc.index_in(tokens, value_set=asked.cast(tokens.type)), -1).to_numpy()


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of texts of TEXTS_A_PIECE bytes at a time, about; a longer row alone."""
    size = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64) for c in batch.columns[1:]), np.zeros(len(batch), np.int64)))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXTS_A_PIECE, "right")))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, end - at)]) for c in batch.columns], names=batch.schema.names)
        at = end


def lister(asked: pa.Array, schema: pa.Schema, split: Callable | None = None) -> Callable:
    """Batches of chunk_id and lists of tokens, one a field, to chunk_id, length, places in asked of the tokens held, and how often each field holds them.

    With split (texts to lists of tokens) batches bring texts.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it if split is None else (piece for batch in it for piece in _pieces(batch)):
            n, length, held = len(batch), np.zeros(len(batch), np.int64), []
            for column in batch.columns[1:]:
                column = split(column) if split else column
                row, place = pc.list_parent_indices(column).to_numpy(), _places(pc.list_flatten(column), asked)
                length += np.bincount(row, minlength=n)
                known = place >= 0
                held.append(np.unique(row[known] * len(asked) + place[known], return_counts=True))
            posting = np.unique(np.concatenate([key for key, _ in held]))
            border = pa.array(np.searchsorted(posting, np.arange(n + 1) * len(asked)), pa.int32())
            counts = [np.zeros(len(posting), np.int32) for _ in held]
            for out, (key, count) in zip(counts, held, strict=True):
                out[np.searchsorted(posting, key)] = count
            lists = [pa.ListArray.from_arrays(border, pa.array(x, pa.int32())) for x in (posting % max(1, len(asked)), *counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), *(x.cast(t) for x, t in zip(lists, schema.types[2:], strict=True))], schema=schema)

    return run


def counter(n_terms: int) -> Callable:
    """Batches of length and places to one (place, n) a place and task: how many chunks hold it; -1 counts chunks with a token, -2 tokens."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms + 2, np.int64)
        for batch in it:
            length, place = batch.column(0).to_numpy(), pc.list_flatten(batch.column(1)).to_numpy()
            n += np.concatenate([np.bincount(place, minlength=n_terms), [length.sum(), (length > 0).sum()]])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some < n_terms, some, some - n_terms - 2)), pa.array(n[some])], names=["place", "n"])

    return run


@dataclass(frozen=True)
class Asked:
    """A batch's terms in order of their tokens' places: those of place t are first[t] to first[t + 1].

    question tells a term's place in ids; few whether token overlap counts it; idf is its weight in BM25, zero for terms that BM25 passes over.
    """

    ids: pa.Array
    first: np.ndarray
    question: np.ndarray
    few: np.ndarray
    idf: np.ndarray
    weights: tuple[float, ...]
    mean: float
    k1: float
    b: float

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, terms shared and unrounded BM25 (rows by questions) of some rows of (chunk_id, length, places, counts a field) at a time."""
        row, place = pc.list_parent_indices(batch.column(2)).to_numpy(), pc.list_flatten(batch.column(2)).to_numpy()
        tf = sum((w * pc.list_flatten(c).to_numpy() for w, c in zip(self.weights, batch.columns[3:], strict=True)), np.zeros(len(row)))
        impact = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * batch.column(1).to_numpy()[row] / self.mean))
        many = self.first[place + 1] - self.first[place]
        n, border = max(1, len(self.ids)), np.searchsorted(row, np.arange(len(batch) + 1))
        addends = np.concatenate([[0], np.cumsum(many)])[border]
        at = 0
        while at < len(batch):
            end = min(at + max(1, PAIRS_A_BLOCK // n), max(at + 1, int(np.searchsorted(addends, addends[at] + ADDENDS_A_BLOCK, "right")) - 1), len(batch))
            some = slice(border[at], border[end])
            times = many[some]
            term = np.repeat(self.first[place[some]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            pair = np.repeat((row[some] - at) * n, times) + self.question[term]
            shared = np.bincount(pair[self.few[term]], minlength=(end - at) * n).reshape(-1, n)
            yield at, shared, np.bincount(pair, np.repeat(impact[some], times) * self.idf[term], (end - at) * n).reshape(-1, n)
            at = end


def all_pairs(asked: Asked, backend: str, schema: pa.Schema) -> Callable:
    """question_id, chunk_id, score of every pair with a term that the backend (overlap or bm25) scores."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, shared, score in asked.blocks(batch):
                found = shared if backend == "overlap" else score
                i, j = np.nonzero(found)
                if len(i):
                    values = found[i, j] if backend == "overlap" else np.round(found[i, j], 6)
                    yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(j)), batch.column(0).take(pa.array(at + i)), pa.array(values)], schema=schema)

    return run


class _Best:
    """The k best chunks a question so far, by score, then chunk_id: what can't be among them any more is left out early."""

    def __init__(self, k: int, n: int):
        self.k, self.least, self.kept, self.n_kept = k, np.full(n, -np.inf), [], 0

    def add(self, score: np.ndarray, shared: np.ndarray, places: int, chunk_ids: pa.Array) -> None:
        i, j = np.nonzero((score > 0) & (score >= self.least - 1e-5))
        value = np.round(score[i, j], 6)
        still = value >= self.least[j]
        i, j, value = i[still], j[still], value[still]
        self.kept.append(pa.table({"question": j, "chunk_id": chunk_ids.take(pa.array(places + i)), "score": value, "shared": shared[i, j].astype(np.int64)}))
        self.n_kept += len(i)
        if self.n_kept > max(100_000, 2 * self.k * len(self.least)):
            self.table()

    def table(self) -> pa.Table:
        t = pa.concat_tables(self.kept).sort_by([("question", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
        question = t["question"].to_numpy()
        rank = np.arange(len(t)) - np.searchsorted(question, question)
        t = t.filter(pa.array(rank < self.k))
        last = t.filter(pa.array(rank[rank < self.k] == self.k - 1))
        self.least[last["question"].to_numpy()] = last["score"].to_numpy()
        self.kept, self.n_kept = [t], len(t)
        return t


def best_and_counts(asked: Asked, k: int, backends: tuple[str, ...], schema: pa.Schema) -> Callable:
    """backend, question_id, chunk_id, score, shared of the task's k best a backend and question, and rows without these of question_id, shared, n: n chunks share so many terms."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {b: _Best(k, len(asked.ids)) for b in backends}
        wide = int(np.bincount(asked.question, minlength=1).max()) + 1
        counts = np.zeros(len(asked.ids) * wide, np.int64)
        for batch in it:
            for at, shared, score in asked.blocks(batch):
                for b, kept in best.items():
                    kept.add(shared.astype(float) if b == "overlap" else score, shared, at, batch.column(0))
                i, j = np.nonzero(shared)
                np.add.at(counts, j * wide + shared[i, j], 1)
        for b, kept in best.items():
            if kept.kept:
                t = kept.table().combine_chunks()
                columns = [pa.repeat(b, len(t)), asked.ids.take(t["question"]), t["chunk_id"], t["score"], t["shared"], pa.nulls(len(t), pa.int64())]
                yield from pa.table(columns, schema=schema).to_batches()
        some = np.flatnonzero(counts)
        nothing = [pa.nulls(len(some), schema.field(c).type) for c in ("backend", "chunk_id", "score")]
        yield pa.RecordBatch.from_arrays([nothing[0], asked.ids.take(pa.array(some // wide)), *nothing[1:], pa.array(some % wide), pa.array(counts[some])], schema=schema)

    return run
