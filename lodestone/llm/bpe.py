"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton finds the longest token at each place of a word. Tokens are taken greedily from the left; a token may
follow another only if byte-pair merging would leave the two side by side, which a pair-compatibility table answers. Where it may
not, the next shorter token that is a prefix is tried, and where none is left, the last token is taken back and its end marked
dead, so that no place is tried twice: linear time in the word's length.

Words meet the same normaliser and pattern as in the tokenizer's file: canonical composition, white space, lower case one code
point at a time, then contractions, runs of letters, single numbers and runs of other signs, the last symbol of a word marked.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import batches, id_and_text

#: Stands for the end-of-word suffix as one symbol; outside the 256 symbols of bytes.
END = chr(0xE000)

#: Words of texts of printable Latin alone; other texts get their words from the library's normaliser and pre-tokenizer.
_LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sA-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ0-9\xb2\xb3\xb9\xbc-\xbe]+")
_NOT_LATIN = re.compile("[^\t\n\r -~\xa1-ɏ]")


def byte_symbols() -> list[str]:
    """The public byte alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


class _Table:
    """Byte strings one behind the other with their offsets; gather() lays out those of many ids without a Python loop."""

    def __init__(self, strings: list[bytes]):
        self.blob = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.size = np.array([len(s) for s in strings], dtype=np.int64)
        self.offset = np.cumsum(self.size) - self.size

    def gather(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids joined, and where each id's bytes end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64)
        at += np.repeat(self.offset[ids] - (ends - size), size)
        return self.blob[at].tobytes(), ends


class Bpe:
    """Encoder and decoder of a BPE file with byte symbols and an end-of-word suffix."""

    def __init__(self, path: str, cache: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        mark = lambda t: t.removesuffix(suffix) + END if t.endswith(suffix) else t
        ids = {mark(t): i for t, i in vocab.items()}
        #: By pair of tokens what their merge makes; by token its merge's rank (-1: a symbol) and its two parts.
        self.pair: dict[tuple[int, int], int] = {}
        self.rank = dict.fromkeys(ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        whole = {i for i in self.rank}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = ids[mark(a)], ids[mark(b)], ids[mark(a + b)]
            self.pair[left, right], self.rank[made], self.parts[made] = made, rank, (left, right)
        for made, (left, right) in self.parts.items():  # in order of rank
            if left not in whole or right not in whole or not self._stay_apart(left, right, self.rank[made]):
                whole.discard(made)  # merging never gives this token
        self.ids = {t: i for t, i in ids.items() if i in whole}
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.shorter = {i: next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.symbols = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
        self.added = added
        #: Added tokens that strip, ask for word borders or meet normalised text are left to the library, texts whole.
        self.by_library = any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self.added_start = os.path.commonprefix(list(added))
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.path, self._library = path, None
        self.cache: dict[str, bytes] = {}
        self.most = cache
        top = max([*ids.values(), *added.values()]) + 1
        self.dtype = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        names = [b" "] * top
        for t, i in [*vocab.items(), *added.items()]:
            names[i] = t.encode() + b" "  # without a decoder in the file, tokens are joined by a space
        self.names, self.decimals = _Table(names), _Table([b"%d " % i for i in range(top)])

    def _stay_apart(self, left: int, right: int, below: int) -> bool:
        """Whether no merge of a rank under `below` joins the symbols at the border of two tokens.

        Goes back in time: the token whose last merge came later is taken apart, and the pair then at the border must not have had
        a merge that came before that one. Of equal merges that overlap, the left one is done first.
        """
        rank, parts, pair = self.rank, self.parts, self.pair
        while True:
            made = pair.get((left, right))
            if made is not None and rank[made] < below:
                return False
            if rank[left] > rank[right]:
                below = rank[left]
                left = parts[left][1]
            elif rank[right] >= 0:
                below = rank[right] + 1
                right = parts[right][0]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        s = (word[1:] if word[0] == END else word.encode().decode("latin-1").translate(self.symbols)) + END
        one = self.ids.get(s)
        if one is not None:
            return [one]
        n, length, shorter, compatible = len(s), self.length, self.shorter, self.compatible
        longest, size = [-1] * (n + 1), [0] * n
        for end, (m, token) in self.automaton.iter(s):
            if m > size[end - m + 1]:
                size[end - m + 1], longest[end - m + 1] = m, token
        alive = [x >= 0 for x in longest]
        alive[n] = True
        taken: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = taken[-1] if taken else -1
            while True:
                end = at + length[token]
                if alive[end]:
                    if last < 0:
                        break
                    known = compatible.get(last << 32 | token)
                    if known is None:
                        if len(compatible) > 150_000:
                            compatible.clear()
                        known = compatible[last << 32 | token] = self._stay_apart(last, token, 1 << 60)
                    if known:
                        break
                token = shorter[token]
                if token < 0:
                    break
            if token >= 0:
                taken.append(token)
                at, token = end, longest[end]
            else:
                alive[at] = False
                token = taken.pop()
                at -= length[token]
        return taken

    @property
    def library(self) -> Tokenizer:
        """Loaded when the first text beyond printable Latin comes."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without added tokens; END before those whose bytes are symbols already."""
        lower = text.lower()
        if not _NOT_LATIN.search(lower):
            return _LATIN_WORD.findall(lower)
        return [END + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def encode(self, text: str) -> np.ndarray:
        if self.by_library:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
        pieces = self.split_added.split(text) if self.split_added and self.added_start in text else (text,)
        out = []
        for piece in pieces:
            if piece in self.added:
                out.append(np.array([self.added[piece]], self.dtype).tobytes())
                continue
            words, cache = self.words(piece), self.cache
            try:
                out.append(b"".join(map(cache.__getitem__, words)))
            except KeyError:
                new = {w: np.array(self.encode_word(w), self.dtype).tobytes() for w in set(words).difference(cache)}
                if len(cache) + len(new) <= self.most:  # frequent words come early; once the cache is full, it stays
                    cache.update(new)
                out.append(b"".join([cache.get(w) or new[w] for w in words]))
        return np.frombuffer(b"".join(out), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return self.names.gather(ids)[0][:-1].decode("utf-8", "replace")

    def digests(self, texts: list[str], most: int = 250_000) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the decimal ids joined by one space, SHA-256 of the decoded text; about `most` ids at a time."""
        out: list[tuple[int, str, str]] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            ids = np.concatenate(held) if held else np.empty(0, self.dtype)
            stops = np.cumsum([len(x) for x in held])
            (dec, dec_ends), (names, name_ends) = self.decimals.gather(ids), self.names.gather(ids)
            a = b = 0
            for x, stop in zip(held, stops, strict=True):
                c, d = (int(dec_ends[stop - 1]), int(name_ends[stop - 1])) if len(x) else (a, b)
                out.append((len(x), hashlib.sha256(memoryview(dec)[a : max(a, c - 1)]).hexdigest(), hashlib.sha256(memoryview(names)[b : max(b, d - 1)]).hexdigest()))
                a, b = c, d
            held.clear()

        n = 0
        for text in texts:
            ids = self.encode(text)
            held.append(ids)
            n += len(ids)
            if n >= most:
                flush()
                n = 0
        flush()
        return out


_kept: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """One encoder a worker process and file, so that its cache outlives a task."""
    if path not in _kept:
        _kept[path] = Bpe(path)
    return _kept[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text. Null text: no ids. Repeated rows give repeated rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(it):
        for batch in it:
            for part in batches(iter([batch]), "text"):
                enc = bpe(tokenizer_path)
                ids = [enc.encode(t).astype(np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded text of every row of ids. Null ids: the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(it):
        for batch in it:
            enc = bpe(tokenizer_path)
            texts = [enc.decode(np.asarray(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def encoded_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one pass.

    Null text: empty. Repeated rows give repeated rows; no rows, no rows. Other columns play no part.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(it):
        for part in batches(it, "text"):
            n, ids, decoded = zip(*bpe(tokenizer_path).digests(part.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], schema=schema)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col)
