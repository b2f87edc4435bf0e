"""Full-text tokens as an Arrow function: letters and digits, accents dropped, lower case, Porter's stemmer of 1980."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[^\W_]+")
_VOWELS = "aeiou"

# The published suffix rules of steps 2, 3 and 4.
_STEP2 = dict((("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")))
_STEP3 = dict((("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWELS or ch == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _by_end(suffixes) -> dict[str, list[str]]:
    """Suffixes by their last letter, long ones first, so that few are compared with a word."""
    out: dict[str, list[str]] = {}
    for s in sorted(suffixes, key=len, reverse=True):
        out.setdefault(s[-1], []).append(s)
    return out


_STEP2_ENDS, _STEP3_ENDS, _STEP4_ENDS = _by_end(_STEP2), _by_end(_STEP3), _by_end(_STEP4)


def _longest(word: str, ends: dict[str, list[str]]) -> str | None:
    return next((s for s in ends.get(word[-1:], ()) if word.endswith(s)), None)


def _replace(word: str, rules: dict[str, str], ends: dict[str, list[str]], least: int) -> str:
    """The longest suffix that fits decides; it is replaced where the stem before it has more than `least` measures."""
    fits = _longest(word, ends)
    if fits is None:
        return word
    stem = word[: len(word) - len(fits)]
    return stem + rules[fits] if _measure(stem) > least else word


def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of two letters or with other signs than a to z stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                word = cut + "e"
            elif _double(cut) and cut[-1] not in "lsz":
                word = cut[:-1]
            else:
                word = cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, _STEP2, _STEP2_ENDS, 0)
    word = _replace(word, _STEP3, _STEP3_ENDS, 0)
    last = _longest(word, _STEP4_ENDS)
    if last:
        rest = word[: -len(last)]
        if _measure(rest) > 1 and (last != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _cvc(rest):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


_known: dict[str, str] = {}


def _known_stem(token: str) -> str:
    if token not in _known:
        if len(_known) > 500_000:
            _known.clear()
        _known[token] = stem(token)
    return _known[token]


#: What a code point is to the tokenizer.
_APART, _INSIDE, _COMBINING = 0, 1, 2


@functools.cache
def _kinds() -> np.ndarray:
    """_INSIDE for code points that a token may hold, _COMBINING for combining ones."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    for run in _TOKEN.finditer(every):
        out[run.start() : run.end()] = _INSIDE
    out[[i for i, c in enumerate(every) if unicodedata.combining(c)]] = _COMBINING
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def full_text_tokens(text: str | None) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c))
    return [_known_stem(token) for token in _TOKEN.findall(plain.lower())]


def _all_tokens(text: pd.Series) -> pd.Series:
    return text.map(full_text_tokens)


def fts_tokens(text: Column) -> Column:
    """Stemmed tokens of a text, in order with repeats; give it to lexical functions as their tokenizer."""
    return F.pandas_udf(_all_tokens, T.ArrayType(T.StringType()))(text)


def token_lists(texts: pa.Array) -> pa.ListArray:
    """The same tokens of many texts at once, for use inside a task: found as borders in an array of code points, and each distinct one stemmed once."""
    apart = [t if t.isascii() else unicodedata.normalize("NFD", t) for t in (t or "" for t in texts.to_pylist())]
    whole, row = f" {' '.join(apart)} ", np.cumsum([1, *(len(t) + 1 for t in apart)])
    if whole.isascii():
        codes = _codes(whole.lower())
    else:
        codes = _codes(whole)
        plain = _kinds()[codes] != _COMBINING
        row = np.concatenate([[0], np.cumsum(plain)])[row]
        codes = _codes(codes[plain].tobytes().decode("utf-32-le").lower())  # decomposed letters have one lower-case letter each, so places stay
    inside = _kinds()[codes] == _INSIDE
    border = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    kept = codes[inside]
    width = np.concatenate([[0], np.cumsum(1 + (kept >= 0x80) + (kept >= 0x800) + (kept >= 0x10000))])
    offsets = width[np.concatenate([[0], np.cumsum(border[1::2] - border[::2])])].astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(kept.tobytes().decode("utf-32-le").encode()))
    coded = tokens.dictionary_encode()
    stems = pa.array([_known_stem(t) for t in coded.dictionary.to_pylist()], pa.string())
    first = np.searchsorted(border[::2], row).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(first), pa.DictionaryArray.from_arrays(coded.indices, stems))


fts_tokens.in_task = token_lists
