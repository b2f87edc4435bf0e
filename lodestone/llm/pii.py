"""Personal data by weak supervision.

Patterns find the base spans, which always count, and further candidates (looser addresses and numbers, secrets). On each candidate
labelers vote yes, no or nothing: pattern shape, checksum and range rules, gazetteers of address endings, card and country prefixes,
words in front of the span, and its neighbours. What the documents hold is gathered as numbers of candidates by kind, votes and
coarse features, over all rows. Expectation maximisation on these counts estimates each labeler's reliability and each candidate
class's probability; a logistic span classifier is then fitted to the probabilities and decides on the candidates that aren't base
spans.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batches, bound_batches, cut, id_and_text

#: Kinds in the order of a document's spans; base kinds first.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Candidates beyond the base patterns.
_SPOKEN_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+")
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_=-]{16,})")

#: Gazetteers and words of context.
_ENDINGS = frozenset("com org net edu gov info io de fr es it uk nl pl eu us ca ch at be se no fi dk jp cn in br ru".split())
_CARD_PREFIX = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "36", "6011", "62", "65")
_CALLING = tuple(f"+{c}" for c in (1, 7, 20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 52, 54, 55, 61, 62, 81, 82, 86, 90, 91))
_CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach)"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|login)"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|debit|payment|account)"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|number)"),
    "secret": re.compile(r"(?i)\b(?:token|secret|password|key|auth)"),
}
_AGAINST = re.compile(r"(?i)\b(?:version|release|section|figure|isbn|issn|order|example|sample|build)\b[^\n]{0,10}$")
LABELERS = ("shape", "check", "gazetteer", "context", "against", "neighbours")


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start; leftmost non-overlapping matches of each kind, those that fail a rule dropped. Linear time."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            low = max(done, text.rfind("@", done, m.start()) + 1)
            local = text[low : m.start()]
            start = low + len(local.rstrip(_LOCAL))
            if start < m.start():
                out.append(("email", start, m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans and further candidates (kind, start, end, base), by kind as in KINDS, then start; none of a kind overlap.

    A candidate that overlaps a base span of another kind is left out: that text is taken already.
    """
    base = base_spans(text)
    more = []
    low = text.find("at]") >= 0 or text.find("at)") >= 0 or text.find("AT]") >= 0 or text.find("AT)") >= 0
    if low:
        more += [("email", m.start(), m.end()) for m in _SPOKEN_EMAIL.finditer(text)]
    if ":" in text:
        more += [("ip", m.start(), m.end()) for m in _SIX.finditer(text)]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and (len(d) < 16 or not luhn(d)):
            more.append(("card", m.start(), m.end()))
    more += [("phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    if "=" in text or ":" in text:
        more += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    out = [(*s, True) for s in base]
    if more:
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken])
        tops = np.maximum.accumulate([b for _, b in taken]) if taken else np.array([])
        for kind, a, b in more:
            i = int(np.searchsorted(starts, b)) if taken else 0
            if not i or tops[i - 1] <= a:
                out.append((kind, a, b, False))
        out.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """A vote (1, 0, -1) of each labeler."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 2]
    digits = _digits(span) if kind in ("card", "phone", "ip") else ""
    if kind == "email":
        shape = 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}", span) else -1 if ".." in span else 0
        check = 1 if span.count("@") == 1 and len(span) <= 254 else -1
        gazetteer = 1 if re.split(r"[.\])]", span)[-1].strip().lower() in _ENDINGS else -1
    elif kind == "ip":
        shape = 1 if not re.search(r"(?:^|\.)0[0-9]", span) else -1
        check = 1 if ":" in span or not span.startswith("0.") else -1
        gazetteer = -1 if span.startswith(("0.", "255.")) else 1
    elif kind == "card":
        shape = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span) else -1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(_CARD_PREFIX) else -1
    elif kind == "phone":
        shape = 1 if re.fullmatch(r"\+[0-9]{1,3}[ .-]?(\([0-9]{1,5}\)[ .-]?)?[0-9][0-9 .-]*[0-9]|\([0-9]{3}\)[ .-][0-9]{3}[ .-][0-9]{4}", span) else -1
        check = 1 if 10 <= len(digits) <= 13 else -1
        gazetteer = 1 if span.startswith(_CALLING) else 0 if span.startswith("+") else -1
    else:
        mixed = bool(re.search("[0-9]", span)) and bool(re.search("[A-Za-z]", span))
        shape = 1 if mixed else -1
        check = 1 if len(set(span)) >= 10 else -1
        gazetteer = 1 if re.fullmatch(r"[0-9a-f]{32,64}|[A-Za-z0-9+/_=-]{20,}", span) else 0
    context = 1 if _CONTEXT[kind].search(before) else 0
    against = -1 if _AGAINST.search(before) else 0
    left = not before or not (before[-1].isalnum() or before[-1] in "._+@/-")
    right = not after or not (after[0].isalnum() or after[0] in "_@/-%" or after[0] == "." and after[1:].isdigit())
    return shape, check, gazetteer, context, against, 1 if left and right else -1


def features(text: str, start: int, end: int) -> tuple[int, ...]:
    """Coarse numbers of a span, each 0 to 3: length, share of digits, share of distinct signs, signs that are neither letter nor digit."""
    span = text[start:end]
    n = len(span)
    other = sum(not c.isalnum() for c in span)
    return min(3, n // 12), min(3, 4 * len(_digits(span)) // n), min(3, 4 * len(set(span)) // n), min(3, other)


def code_of(text: str, kind: str, start: int, end: int) -> str:
    """Kind, votes and features of a candidate as one short string; there is a bounded number of them."""
    return f"{kind}:{''.join('-0+'[v + 1] for v in votes(text, kind, start, end))}:{''.join(map(str, features(text, start, end)))}"


def em(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Probability of yes by row of votes, and reliabilities [class, labeler, vote]; rows stand for `counts` candidates.

    Starts from the share of yes among the votes cast; labelers are taken as independent given the class, and a labeler's three
    vote rates are smoothed towards voting rightly, so that the classes keep their meaning.
    """
    cast = np.abs(votes).sum(1)
    p = np.clip(0.5 + votes.sum(1) / (2 * np.maximum(cast, 1)), 0.05, 0.95)
    prior = np.array([[[2.0, 1.0, 1.0]], [[1.0, 1.0, 2.0]]]) * smooth
    rates = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        for c, w in ((0, (1 - p) * counts), (1, p * counts)):
            for v in (-1, 0, 1):
                rates[c, :, v + 1] = ((votes == v) * w[:, None]).sum(0)
        rates += prior
        rates /= rates.sum(2, keepdims=True)
        yes = ((p * counts).sum() + 1) / (counts.sum() + 2)
        at = np.arange(votes.shape[1])[None, :]
        odds = np.log(yes / (1 - yes)) + (np.log(rates[1][at, votes + 1]) - np.log(rates[0][at, votes + 1])).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max(initial=0) < 1e-7:
            break
        p = new
    return p, rates


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (constant first) of a logistic regression on soft labels y with row weights w, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def decide(codes: dict[str, int], threshold: float = 0.5) -> dict[str, float]:
    """Probability by code, from how often each code occurs in the corpus: label model by kind, then the span classifier."""
    out: dict[str, float] = {}
    for kind in KINDS:
        mine = sorted(c for c in codes if c.startswith(kind + ":"))
        if not mine:
            continue
        cast = np.array([["-0+".index(v) - 1 for v in c.split(":")[1]] for c in mine])
        coarse = np.array([[int(f) for f in c.split(":")[2]] for c in mine])
        n = np.array([codes[c] for c in mine], float)
        p, _ = em(cast, n)
        x = np.column_stack([cast == 1, cast == -1, *(coarse == k for k in (1, 2, 3))]).astype(float)
        w = n / n.sum() * min(n.sum(), 10_000)
        beta = logistic(x, p, w)
        out |= dict(zip(mine, 1 / (1 + np.exp(-(beta[0] + x @ beta[1:]))), strict=True))
    return out


_FOUND = "doc_id long, base string, more string, codes array<string>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (base spans joined), more (other candidates joined), codes (theirs, in the same order) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("more", pa.string()), ("codes", pa.list_(pa.string()))])

    def run(it):
        for batch in batches(it, "text"):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = candidates(text)
                rows.append((doc_id, _join(s for s in spans if s[3]), _join(s for s in spans if not s[3]), [("*" if s[3] else "") + code_of(text, *s[:3]) for s in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, _FOUND)


def _join(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def learn(found: DataFrame, most_codes: int = 5 * 3**6 * 4**4) -> dict[str, float]:
    """Probability by code from the counts of all candidates. The bound is the number of codes that there are: 5 kinds, 6 votes of 3, 4 features of 4."""
    rows = found.select(F.explode("codes").alias("code")).select(F.ltrim(F.col("code"), F.lit("*")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).limit(most_codes + 1).collect()
    if len(rows) > most_codes:
        raise ValueError("too many codes of votes and features")
    return decide({r[0]: r[1] for r in rows})


_DIGEST = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def label(found: DataFrame, chance: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """doc_id, numbers of base spans, base_sha256 and all accepted spans of every row of find()."""
    good = {c for c, p in chance.items() if p >= threshold}

    def run(it):
        for batch in it:
            rows = []
            for doc_id, base, more, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = base.split(",") if base else []
                kept = [s for s, c in zip(more.split(",") if more else [], [c for c in codes if c[0] != "*"], strict=True) if c in good]
                spans = sorted((first + kept), key=lambda s: (KINDS.index((x := s.split(":"))[0]), int(x[1]))) if kept else first
                count = [sum(s.startswith(k + ":") for s in first) for k in BASE_KINDS]
                rows.append((doc_id, *count, hashlib.sha256(base.encode()).hexdigest(), ",".join(spans)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All spans of every document. Null text: empty. No rows: no rows. Repeated rows give repeated rows."""
    found = cut(find(docs, id_col, text_col), "pii-candidates")
    return label(found, learn(found), threshold)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with every span of its texts replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    One pass finds the candidates of every row and writes them beside it, the label model is learned from all of them, and a second
    pass replaces what it accepts. Null texts stay null; other columns, whatever their names, stay as they are; repeated rows are
    redacted alike. No rows: no rows.
    """
    bound_batches(docs.sparkSession)
    own = "_codes"
    while own in docs.columns:
        own += "_"
    at = docs.columns.index(text_col)

    def mark(it):
        for batch in it:
            for part in batches(iter([batch]), text_col):
                codes, places = [], []
                for text in part.column(at).to_pylist():
                    spans = candidates(text) if text else []
                    codes.append([("*" if s[3] else "") + code_of(text, *s[:3]) for s in spans])
                    places.append([x for s in spans for x in s[1:3]])
                extra = [pa.array(codes, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, own, own + "at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked = cut(docs.mapInArrow(mark, f"{schema}, `{own}` array<string>, `{own}at` array<int>"), "pii-marked")
    good = {c for c, p in learn(marked.select(F.col(own).alias("codes"))).items() if p >= threshold}

    def clean(text: str, codes: list[str], places: list[int]) -> str:
        out, done = [], 0
        for a, b, code in sorted(zip(places[::2], places[1::2], codes, strict=True), key=lambda s: (*s[:2], s[2].lstrip("*"))):
            if code[0] == "*" or code in good:
                if a >= done:
                    out += [text[done:a], f"<{code.lstrip('*').partition(':')[0]}>"]
                done = max(done, b)
        return "".join([*out, text[done:]]) if out else text

    def run(it):
        for batch in it:
            for part in batches(iter([batch]), text_col):
                rows = zip(*(c.to_pylist() for c in (part.column(at), *part.columns[-2:])), strict=True)
                cleaned = pa.array([clean(*r) if r[1] else r[0] for r in rows], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([cleaned if i == at else c for i, c in enumerate(part.columns[:-2])], names=part.schema.names[:-2])

    return marked.mapInArrow(run, docs.schema)
