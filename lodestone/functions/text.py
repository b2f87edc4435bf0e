"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two stop-word lists, for overlap and for full-text queries.
STOP_WORDS = ("a", "an", "and", "are", "before", "does", "for", "how", "in", "is", "of", "the", "to", "what")
QUERY_STOP_WORDS = ("a", "an", "and", "are", "before", "does", "each", "for", "how", "in", "is", "of", "or", "the", "to", "what")
# Stop words of claims.
CLAIM_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "evidence", "of", "on", "or", "paper", "report", "reported", "reports", "result", "results", "study", "that", "the", "this", "to", "was", "were", "with")
#: White space and digits of all of Unicode, as classes of a pattern.
BLANK, DIGIT = r"[\s\x1c-\x1f\x85\p{Z}]", r"\p{Nd}"
# Number, number with unit, Latin token and clause border. What can't start a number is passed over before it is looked behind.
NUMBER = rf"(?i)(?=[-+{DIGIT}])(?<![A-Za-z_])[-+]?{DIGIT}+(?:\.{DIGIT}+)?(?:e[-+]?{DIGIT}+)?%?"
NUMBER_WITH_UNIT = rf"(?i)(?=[-+{DIGIT}])(?<![A-Za-z_])([-+]?{DIGIT}+(?:\.{DIGIT}+)?){BLANK}*-?{BLANK}*(%|％|周|星期|天|日|月|年|小时|分钟|秒|weeks?|days?|months?|years?|hours?|minutes?|seconds?)(?![A-Za-z])"
LATIN_TOKEN = r"[A-Za-zΑ-Ωα-ω][A-Za-z0-9_Α-Ωα-ω+./-]*"
CLAUSE_BORDER = rf"[。！？!?；;，,]{BLANK}*|\.(?!{DIGIT}){BLANK}+"


def let(value: Column, use) -> Column:
    """use(x) with x evaluated once a row, also where use refers to it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(strip(text), F.lit("")) == ""


@functools.cache
def _digits() -> tuple[str, str]:
    """Every decimal digit beyond ASCII, and the ASCII digit of its value."""
    all_ = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(all_), "".join(str(unicodedata.decimal(c)) for c in all_)


def ascii_digits(number: Column) -> Column:
    return F.when(number.rlike("[^\\x00-\\x7F]"), F.translate(number, *_digits())).otherwise(number)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def n_tokens(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+"))


def without(values: Column, words: tuple[str, ...]) -> Column:
    return F.array_except(values, F.array(*[F.lit(w) for w in words]))


def query_tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct tokens but the stop words, in order of first place."""
    return without(F.array_distinct(tokens(text)), stop)


def query_expression(text: Column) -> Column:
    """Distinct tokens, each in quotes, joined by OR; safe against injection as a token has letters and digits only."""
    return F.array_join(F.transform(query_tokens(text, QUERY_STOP_WORDS), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, rf"{BLANK}+", " "))


def clauses(text: Column) -> Column:
    """Clauses at Latin and CJK punctuation, without blank ones; a full stop before a digit is part of a number."""
    parts = F.transform(F.split(text, CLAUSE_BORDER), lambda c: F.btrim(c, F.lit(" \t\n:：")))
    return F.filter(parts, lambda c: c != "")


def six_digits(number: Column) -> Column:
    """A number rounded to six significant digits: numbers that agree so far are one."""
    return F.format_string("%.5e", ascii_digits(number).cast("double")).cast("double")


def numbers(text: Column) -> Column:
    """Distinct numbers of a text as doubles of six significant digits; a percent sign is dropped."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: six_digits(F.regexp_replace(n, "[%]$", ""))))


def unit(name: Column) -> Column:
    """One name for singular and plural units; others in lower case."""
    low = F.lower(name)
    plural = F.when(low.rlike("^(week|day|month|year|hour|minute|second)$"), F.concat(low, F.lit("s")))
    return F.when(low == "％", F.lit("%")).otherwise(F.coalesce(plural, low))


def unit_facts(text: Column) -> Column:
    """Distinct (unit, value) of a text, values of six significant digits."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER_WITH_UNIT), F.lit(0)))  # a match alone matches again in the same parts
    of = lambda match, group: F.regexp_extract(match, NUMBER_WITH_UNIT, group)
    return F.array_distinct(F.transform(found, lambda m: F.struct(unit(of(m, 2)).alias("unit"), six_digits(of(m, 1)).alias("value"))))


def latin_tokens(text: Column, content_only: bool) -> Column:
    """Lower-cased Latin and Greek tokens without signs at the ends; content_only leaves out single letters and stop words."""
    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(LATIN_TOKEN), F.lit(0))), lambda t: F.btrim(F.lower(t), F.lit(".+/-")))
    kept = F.filter(found, lambda t: F.length(t) > (1 if content_only else 0))
    return without(F.array_distinct(kept), CLAIM_STOP_WORDS) if content_only else F.array_distinct(kept)


def cjk(text: Column) -> Column:
    return F.regexp_replace(text, r"[^一-鿿]+", "")


def cjk_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring CJK characters, other characters left out first."""
    return let(cjk(text), lambda s: F.when(F.length(s) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: s.substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>")))


def has_any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def citation_positions(answer: Column, evidence_count: Column) -> Column:
    """Distinct `[n]` markers in ascending order; null if there is none or one is out of range."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))))
    ok = (F.size(found) > 0) & F.forall(found, lambda n: (n >= 1) & (n <= evidence_count))
    return F.when(ok, found)


def term_groups_pass(answer: Column, groups: Column, forbidden: Column) -> Column:
    """Whether each group has a term in the answer and no forbidden term is there, white space and case left aside."""
    plain = F.regexp_replace(F.lower(answer), rf"{BLANK}+", "")
    inside = lambda t: F.contains(plain, F.regexp_replace(F.lower(t), rf"{BLANK}+", ""))
    return F.forall(groups, lambda g: F.exists(g, inside)) & ~F.exists(forbidden, inside)


def first_alias_place(text: Column, aliases: Column) -> Column:
    """Smallest place (from 1) of any alias in a text, case left aside; null if none stands in it."""
    return F.array_min(F.transform(aliases, lambda a: F.nullif(F.instr(F.lower(text), F.lower(a)), F.lit(0))))


def upper_ratio(text: Column) -> Column:
    """Share of upper-case letters among letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)


def page_text(text: Column) -> Column:
    """Normalised page text: line ends as \\n, control characters but tab dropped, blanks squeezed, empty lines dropped."""
    plain = F.regexp_replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"[\p{Cc}&&[^\n\t]]", "")
    lines = F.transform(F.split(plain, "\n"), lambda x: strip(F.regexp_replace(x, r"[\t ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def heading_level(text: Column) -> Column:
    number = F.regexp_extract(strip(text), rf"^({DIGIT}+(?:\.{DIGIT}+)*)", 1)
    return F.when(number == "", F.lit(1)).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)


# Names of sections and words that make a numbered line a sentence.
_NAMED = r"(?i)^(?:abstract|introduction|related work|methods?|methodology|experiments?|results?|discussion|conclusions?|references)$"
_SENTENCE = r"\b(?:is|are|was|were|has|have|shows|denotes|contains)\b"


def is_heading(line: Column) -> Column:
    """A named section, a roman number with a mostly upper-case title, or a number from 1 to 20 with a capitalised title."""
    v = strip(line)
    roman = strip(F.regexp_extract(v, rf"(?i)^[IVXLCDM]+\.{BLANK}+(.+)$", 1))
    number = ascii_digits(F.regexp_extract(v, rf"^({DIGIT}+)(?:\.{DIGIT}+)*[.)]?{BLANK}+.+$", 1))
    title = strip(F.regexp_extract(v, rf"^{DIGIT}+(?:\.{DIGIT}+)*[.)]?{BLANK}+(.+)$", 1))
    numbered = (number != "") & (F.length(number) <= 9) & number.cast("long").between(1, 20) & title.rlike(r"^\p{Lu}") & ~title.rlike(_SENTENCE)
    body = F.when(v.rlike(_NAMED), True).when(roman != "", upper_ratio(roman) >= 0.7).otherwise(F.coalesce(numbered, F.lit(False)))
    return (F.length(v) <= 160) & ~F.contains(v, F.lit("\n")) & body
