"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. For windows of n words the
text is cut into k-grams, k being half of n rounded up, and of every n - k + 1 successive k-grams, a window, the smallest hash is
kept as its fingerprint. Whoever shares n words in a row shares all k-grams of such a run and so the fingerprint kept of it: no
occurrence of a window is missed. Windows of documents meet those of the benchmark by fingerprint, and each hit is extended from its k-gram to
the n words around it, which must be the same. Hence a hit is exact: hashes only choose what is compared.

Cost: a text is read, cut up and hashed once, where it lies, and no text is shuffled. A table of bits of fixed size, made of the
benchmark's fingerprints, passes few others, so windows are seldom spelled out in vain (a very large benchmark fills the table, which costs
time and loses nothing). With a benchmark of bounded size (`most_broadcast_bytes`, measured) windows meet it where they are made, and only hits
are shuffled. Beyond it the join shuffles, the documents' side dealt out by `SALTS` salts, so a passage that stands in a third of all
documents is no one task's. A window of a document meets at most one distinct window of the benchmark, so rows never multiply; the items that
share a window are looked up once for each distinct set of windows, not once for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut
from lodestone.llm.rules import _bound

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, upper-case letters being none of it.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of the benchmark's side for one of its windows where the join shuffles.
SALTS = 16


def _gram(n: int) -> int:
    """Words of a k-gram for windows of n words."""
    return (n + 1) // 2


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null: none."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the faster one, and says the same where no letter lies beyond ASCII
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _hashes(ws: Column, k: int) -> Column:
    """Hash of each k words in a row."""
    starts = ws if k == 1 else F.slice(ws, 1, F.greatest(F.size(ws) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(ws, i + d) for d in range(1, k)]))


def _least(hashes: Column, width: int) -> Column:
    """The least of each `width` hashes in a row."""
    if width == 1:
        return hashes
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))), lambda x, j: F.least(x, *[F.get(hashes, j + d) for d in range(1, width)]))


#: Places of the table that tells most fingerprints apart from the benchmark's before words are gathered.
FILTER = 1 << 18
#: n words a window, the fingerprint kept of it, its place and its words.
_PRINT = "struct<n:int,h:bigint,at:int,gram:string>"


def _slot(h: Column) -> Column:
    return h.bitwiseAND(FILTER - 1).cast("int")


def bit_table(prints: DataFrame) -> str:
    """A digit for each of the `FILTER` places: 1 where a fingerprint of the benchmark falls."""
    held = bytearray(b"0" * FILTER)
    for r in prints.select(_slot(F.col("h")).alias("at")).distinct().collect():
        held[r["at"]] = ord("1")
    return held.decode()


def fingerprints(ws: Column, n: int, bits: str) -> Column:
    """Array of a text's windows of n words (n, h, at, gram) whose fingerprint the table of bits may hold."""
    k = _gram(n)
    # folded into one constant by the optimizer
    table = F.split(F.lit(",".join(bits)), ",").cast("array<boolean>")

    def row(h: Column, at: Column) -> Column:
        # reads each word by its place: slice() would copy the whole text for every window
        gram = F.array_join(F.transform(F.sequence(at, at + (n - 1)), lambda i: F.get(ws, i)), " ")
        return F.when(F.get(table, _slot(h)), F.struct(F.lit(n).alias("n"), h.alias("h"), at.alias("at"), gram.alias("gram")))

    windows = F.filter(_bound(_hashes(ws, k), lambda h: F.transform(_least(h, n - k + 1), row)), lambda x: x.isNotNull())
    return F.when(F.size(ws) < n, F.array().cast(f"array<{_PRINT}>")).otherwise(windows)


def benchmark_windows(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """n, gram, h, items: each distinct window of n words (joined by blanks), a fingerprint that all its occurrences keep, and the ids that hold it."""
    ws = words(F.col(text_col))
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), _bound(ws, lambda w: F.struct(w.alias("w"), F.least(F.size(w), F.lit(window)).alias("n"))).alias("x"))
    rows = rows.select("item", "x.w", "x.n").where("n > 0").select("item", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("at"))
    grams = rows.select("item", "n", F.slice("w", F.col("at") + 1, F.col("n")).alias("w"))
    least = F.coalesce(*[F.when(F.col("n") == n, F.array_min(_hashes(F.col("w"), _gram(n)))) for n in range(1, window + 1)])
    return grams.groupBy("n", F.array_join("w", " ").alias("gram"), least.alias("h")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _read(docs: DataFrame, sizes: list[int], bits: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each document (n 0, at its number of words) and one for each window whose fingerprint the table of bits may hold. Texts are cut up once."""

    def rows(ws: Column) -> Column:
        itself = F.struct(F.lit(0).alias("n"), F.xxhash64(F.col(text_col)).alias("h"), F.size(ws).alias("at"), F.lit(None).cast("string").alias("gram"))
        return F.concat(F.array(itself).cast(f"array<{_PRINT}>"), *[fingerprints(ws, n, bits) for n in sizes])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *key(id_col, text_col), F.explode(_bound(words(F.col(text_col)), rows)).alias("f")).select("doc_id", "k1", "k2", "f.*")


def hits(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", most_broadcast_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, k1, k2, n_words); places (k1, k2, at, n, set_id) where a window of n words stands; sets (set_id, items) of the items that hold a window."""
    wins = cut(benchmark_windows(items, window, text_col=text_col).withColumn("set_id", F.sha2(F.concat_ws(",", "items"), 256)), "windows")
    held = wins.agg(F.coalesce(F.sum(F.octet_length("gram") + 200), F.lit(0)).alias("bytes"), F.collect_set("n").alias("sizes")).head()
    rows, known = _read(docs, sorted(held["sizes"]), bit_table(wins), id_col, text_col), wins.select("n", "h", "gram", "set_id")
    if held["bytes"] <= most_broadcast_bytes:
        met = rows.join(F.broadcast(known), ["n", "h", "gram"], "left")
    else:
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("k1", "at"), F.lit(SALTS))).join(spread, ["n", "h", "gram", "salt"], "left")
    met = cut(met.where("set_id is not null or n = 0").select("doc_id", "k1", "k2", "n", "at", "set_id"), "fingerprints")
    documents = met.where("n = 0").select("doc_id", "k1", "k2", F.col("at").cast("long").alias("n_words"))
    return documents, met.where("n > 0").select("k1", "k2", "at", "n", "set_id"), wins.select("set_id", "items").distinct()


def key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of identifier and text: rows with equal ones have equal results."""
    what = [F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))]
    return [F.xxhash64(*what).alias("k1"), F.xxhash64(F.lit("second"), *what).alias("k2")]


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", most_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row a row of docs.

    n_hit counts the words that lie in any window's occurrence, n_items the items with an occurring window, items_sha256 is over
    their ids, sorted as strings and comma-joined. Null, empty and wordless texts have no words and no hits; empty or wordless items
    no windows; an empty benchmark hits nothing; a null item id counts as the empty string; items of equal id are one item. Repeated rows
    give repeated rows, no rows none. Very long texts and words are cut within their row; a row's hits are as many as its words at most for each length of window.
    Only the two named columns of either table are read, so others may bear any name.
    """
    docs, items = docs.select(id_col, text_col), items.select("item_id", text_col)
    rows, places, sets = hits(docs, items, window, id_col, text_col, most_broadcast_bytes)
    by_doc = places.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", "n", "set_id"))).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["at"] + x["n"] - F.greatest(x["at"], acc["end"]), F.lit(0))).alias("n"), F.greatest(x["at"] + x["n"], acc["end"]).alias("end"))
    found = by_doc.select("k1", "k2", F.aggregate("at", start, step, lambda acc: acc["n"]).alias("n_hit"), F.sort_array(F.array_distinct(F.col("at.set_id"))).alias("sets"))
    found = cut(found, "hits")
    listed = found.select("sets").distinct().select("sets", F.explode("sets").alias("set_id")).join(sets, "set_id").select("sets", F.explode("items").alias("item"))
    digest = listed.groupBy("sets").agg(F.sort_array(F.collect_set("item")).alias("i")).select("sets", F.size("i").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "i"), 256).alias("items_sha256"))
    found = found.join(digest, "sets").select("k1", "k2", "n_hit", "n_items", "items_sha256")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(found, ["k1", "k2"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
