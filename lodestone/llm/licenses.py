"""Licence scans: Aho-Corasick for identifier tags and notice phrases, a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batches, id_and_text

#: Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices: phrase and label.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
}
TAG = "spdx license identifier"
#: How freely text under a label may be used, 1 most. Labels not listed count as 0.5.
FREEDOM = {"cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "mit": 0.95, "bsd": 0.95, "isc": 0.95, "apache": 0.9, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "agpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "reserved": 0.0}

_FOLD = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_TAG_LINE = re.compile(r"(?i)spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
_PART = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")


def family(identifier: str) -> str:
    """Label of an identifier in a tag: its family, as far as it is known."""
    name = identifier.lower().rstrip("+").removesuffix("-only").removesuffix("-or-later")
    for known in sorted(FREEDOM, key=len, reverse=True):
        if name == known or name.startswith(known + "-"):
            return known
    return name


def parse(expression: str) -> list[str] | None:
    """Postfix form of a licence expression by the shunting-yard algorithm: `with` binds before `and`, that before `or`.

    None where it isn't one. Signs behind a whole expression (a comment's end, say) are left out.
    """
    binds = {"or": 1, "and": 2, "with": 3}
    out: list[str] = []
    held: list[str] = []
    operand, depth = True, 0
    for part in _PART.findall(expression):
        low = part.lower()
        if operand:
            if part == "(":
                held.append(part)
                depth += 1
            elif part == ")" or low in binds:
                return None
            else:
                out.append(part)
                operand = False
        elif part == ")":
            if not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        elif low in binds:
            while held and held[-1] != "(" and binds[held[-1]] >= binds[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        else:
            break
    if operand or depth:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named by an expression and its freedom: of both for `and` the lesser, of a choice the greater; an exception adds a little."""
    stack: list[tuple[set[str], float]] = []
    for part in postfix:
        if part not in ("and", "or", "with"):
            stack.append(({family(part)}, FREEDOM.get(family(part), 0.5)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        stack.append((a, min(1.0, x + 0.1)) if part == "with" else (a | b, min(x, y) if part == "and" else max(x, y)))
    return stack[0]


class Scanner:
    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        phrases = {p: (p.count(" ") + 1, p in BASE, label) for p, label in (NOTICES | BASE).items()}
        for phrase, what in (phrases | {TAG: (3, False, "")}).items():
            self.automaton.add_word(f" {phrase} ", what)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = text.encode("utf-8", "replace").translate(_FOLD).split()
        line = b"".join((b" ", b" ".join(words), b" ")).decode("latin-1") if words else ""
        n_base, first, last, base, labels, tagged = 0, None, None, set(), set(), False
        at = seen = 0
        for end, (n, counted, label) in self.automaton.iter(line):
            seen += line.count(" ", at, end)  # spaces before the match's last one: words up to its end
            at = end
            if counted:
                start = seen - n
                n_base += 1
                first = start if first is None or start < first else first
                last = start if last is None or start > last else last
                base.add(label)
            if label:
                labels.add(label)
            else:
                tagged = True
        freedom = [FREEDOM.get(x, 0.5) for x in labels]
        if tagged:
            for m in _TAG_LINE.finditer(text):
                if postfix := parse(m[1]):
                    named, free = evaluate(postfix)
                    labels |= named
                    freedom.append(free)
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels | base)), min(freedom, default=0.0)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, places of the base phrases, first and last of them, labels, and score: the freedom of the least free finding.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Null text: empty. Without any finding the labels are
    empty and the score is 0, as nothing permits use. Repeated rows give repeated rows; no rows, no rows. Other columns play no part.
    """

    def run(it):
        scanner = Scanner()
        for batch in batches(it, "text"):
            rows = [(d, *scanner.scan(t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
