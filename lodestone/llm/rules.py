"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Five shares of a document (signs, repeated lines, repeated windows, capitals, exclamation marks) may each reject it when above a
cutoff. Cutoffs are chosen by stratum on labelled holdouts: a level of the fixed grid LEVELS is admissible if the exact binomial
test rejects "more than alpha of the good documents lie above it" at delta / (number of strata times shares). Along the grid the
tests go from the loosest level to stricter ones and stop at the first failure, so the grid itself costs no correction. With
probability 1 - delta, then, every admissible cutoff of every stratum loses at most alpha of its good documents a share. Among
the admissible levels the one that best parts bad from good holdouts is taken, on ties the loosest; where none is admissible (too
few holdouts) or none rejects more bad than good ones, nothing is rejected by that share: the bound comes first.

The test's trials must be independent, so a text counts once in its stratum however many rows hold it, and a document or a text
whose labels contradict each other is no trial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import SPACE, cut

SHARES = ("symbols", "lines_again", "words_again", "capitals", "bangs")
#: Candidate cutoffs of every share, loosest last.
LEVELS = tuple(round(0.002 * 1.17**j, 6) for j in range(39))
_SIGNS = "#*$%&|<>"


def _bound(value: Column, use) -> Column:
    """use(x) with x evaluated once a row; a reference inside a lambda would be evaluated anew for each element."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window standing twice or more in the text.

    Windows, as 64-bit hashes with their places, are sorted; equal neighbours are the repeated ones, and a walk over their places
    in order adds up what each covers beyond the one before.
    """

    def places(hashed: Column) -> Column:
        def again(s: Column) -> Column:
            same = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
            return F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])

        placed = F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.sort_array(_bound(F.sort_array(placed), again))

    def covered(hashed: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end"))
        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), F.lit(0).cast("long")).otherwise(F.aggregate(places(hashed), start, step, lambda acc: acc["n"]))

    def of(w: Column) -> Column:
        hashed = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return _bound(hashed, covered)

    return _bound(words, of)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the shares and base_failed of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda signs: (F.char_length("text") - F.char_length(F.translate("text", signs, ""))).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    both = _bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("again")))
    lined = _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    df = rows.select(
        "doc_id",
        "stratum",
        both.alias("w"),
        lined.alias("l"),
        F.xxhash64("text").alias("text_hash"),
        F.char_length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        count(_SIGNS).alias("n_symbols"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        count("!").alias("n_bangs"),
    )
    df = df.select("doc_id", "stratum", "text_hash", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.again").alias("n_dup_lines"), F.col("w.again").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_capitals", "n_bangs")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    df = df.withColumns({"symbols": share("n_symbols", "word_chars"), "lines_again": share("n_dup_lines", "n_lines"), "words_again": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars"), "bangs": share("n_bangs", "word_chars")})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("n_lines", "n_capitals", "n_bangs")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial X, exactly, its terms added up from their logarithms; 1 where k exceeds the mean."""
    import math

    ratio = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)
    start = F.struct(first.cast("double").alias("log"), F.exp(first).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i) + ratio
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(steps, start, step, lambda acc: acc["sum"]))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """stratum and for each share its cutoff (null: none), from all labelled texts that the base rules keep, each once.

    Labels that contradict each other, on a doc_id or on a text of one stratum, make no trial; repeated labels make one.
    """
    agreed = F.min("y") == F.max("y")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("least"), agreed.alias("agreed")).where("agreed").select("doc_id", F.col("least").alias("y"))
    held = measured.where(~F.col("base_failed")).select("doc_id", "stratum", "text_hash", *SHARES).join(known, "doc_id")
    held = held.groupBy("stratum", "text_hash").agg(F.min("y").alias("least"), agreed.alias("agreed"), *[F.min(s).alias(s) for s in SHARES]).where("agreed").withColumnRenamed("least", "y")
    above = [F.struct(F.lit(s).alias("share"), sum((F.when(F.col(s) > c, 1).otherwise(0) for c in LEVELS), F.lit(0)).alias("passes")) for s in SHARES]
    counts = held.select("stratum", "y", F.explode(F.array(*above)).alias("x")).groupBy("stratum", "x.share", "x.passes").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    # documents above level j are those that pass more than j levels
    every = counts.select("stratum", "share").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(len(LEVELS)))).alias("passes"))
    same = ["share", "passes"]
    full = every.alias("e").join(counts.alias("c"), F.col("e.stratum").eqNullSafe(F.col("c.stratum")) & (F.col("e.share") == F.col("c.share")) & (F.col("e.passes") == F.col("c.passes")), "left").select("e.stratum", *[f"e.{x}" for x in same], F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    group = Window.partitionBy("stratum", "share")
    up = group.orderBy(F.desc("passes"))
    strata = F.size(F.collect_set(F.struct("stratum")).over(Window.partitionBy("share")))
    levels = full.select("stratum", "share", (F.col("passes") - 1).alias("level"), F.sum("good").over(up).alias("k"), F.sum("bad").over(up).alias("hit"), F.sum("good").over(group).alias("n"), F.sum("bad").over(group).alias("n_bad"), strata.alias("strata")).where("level >= 0")
    admissible = levels.where(binomial_tail(F.col("n"), F.col("k"), alpha) <= F.lit(delta) / (F.col("strata") * len(SHARES)))
    gain = F.col("hit") / F.greatest("n_bad", F.lit(1)) - F.col("k") / F.col("n")
    best = admissible.withColumn("gain", gain).where("gain > 0").groupBy("stratum", "share").agg(F.max_by("level", F.struct(F.round("gain", 9), F.col("level"))).alias("level"))
    cutoff = F.get(F.array(*[F.lit(c) for c in LEVELS]), F.col("level"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("share") == s, cutoff)).alias(f"cut_{s}") for s in SHARES])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; one row a row of docs.

    Null and empty texts have no words and so fail the base rules. Repeated rows give repeated rows and no rows none. A null stratum is a stratum. Without labels only the base rules
    reject. Windows count as equal if their 64-bit hashes are, within one text.
    """
    measured = cut(measures(docs, id_col, text_col, stratum_col), "rule-measures")
    limits = cut(cutoffs(measured, labels, alpha, delta), "rule-cutoffs").withColumnRenamed("stratum", "of")
    joined = measured.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left")
    rejected = [F.coalesce(F.col(s) > F.col(f"cut_{s}"), F.lit(False)) for s in SHARES]
    kept = ~F.col("base_failed")
    for r in rejected:
        kept = kept & ~r
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
