"""How far the sources of a language lie apart in their words, by dense tiles of groups and terms.

A group is one (lang, source) of the documents. Each group, and each language, gives each term that its language keeps (in at least
`least_docs` documents) a smoothed frequency p in parts of a billion; two groups differ by the sum of |p - q| over all kept terms,
and a group's own terms are those that it gives more than its language does.

1. Texts become counts by (lang, source, term) within Arrow batches, a bounded table of counts a task; Spark adds them up. One hot
   source sends no more rows than its tasks have different terms.
2. Kept terms fall into blocks by hash, groups into blocks by hash; block counts follow from the counted terms and groups, so a tile
   of one term block and two group blocks stays near `tile_terms` x 2 `tile_groups`. Each pair of group blocks within a language and
   each term block is one task's group: numpy int64 matrices are filled from the sparse counts (a term that a group lacks has the
   group's floor value), all pairs are formed by broadcasting, and partial sums come out. Terms that no group of the tile has are
   counted, not stored: their contribution is one product.
3. Spark adds up the partial pair matrices and merges the tiles' lists of each group's best terms, with a limit of ranks in each task
   before rows are shuffled.

All arithmetic is in whole numbers: counts and p by decimals in the JVM, differences and sums in int64 (p is at most a billion and one).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import batches, bound_batches, cut

#: Bytes of UTF-8 that belong to terms stay, A-Z lower-cased; all others become blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Counts that a task holds before it hands them on.
HELD = 300_000
PARTS, ADDED = 1_000_000_000, 5


def terms(text: str) -> list[bytes]:
    """Terms of a text in UTF-8: runs of letters a-z (A-Z lower-cased) and of code points from U+0080 on."""
    # bytes.split parts at ASCII blanks only, and the table leaves no other blank than 0x20
    return text.encode("utf-8", "replace").translate(_TERM_BYTES).split()


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in n.items():
            size = len(count)
            named = [pa.array([x], pa.string()).take(pa.array(np.zeros(size, np.int64))) for x in (lang, source)]
            terms_ = pa.array(list(count), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*named, terms_, pa.array(list(count.values()), pa.int64()), pa.array([docs[t] for t in count], pa.int64())], ["lang", "source", "term", "n", "docs"])
        n.clear()

    held = 0
    for batch in batches(it, "text"):
        for lang, source, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", "text")), strict=True):
            if found := terms(text):
                count, docs = n.setdefault((lang, source), (Counter(), Counter()))
                held -= len(count)
                count.update(found)
                docs.update(set(found))
                held += len(count)
        if held > HELD:
            yield from out()
            held = 0
    yield from out()


def _shares(counts: DataFrame, groups: DataFrame, least_docs: int, tile_terms: int, tile_groups: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, kept, floor, row_block, row_blocks, col_blocks) and entries (lang, source, term, p, q)."""
    term = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    entries = cut(counts.select("lang", "source", "term", "n").join(term, ["lang", "term"]), "kept-counts")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = entries.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(totals.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang", "left").join(kept, "lang", "left").na.fill(0, ["lang_total", "kept"])

    def p(count: str, total: str):
        whole = lambda c: f"cast({c} as decimal(19,0))"
        return F.expr(f"case when kept > 0 then 1 + (cast({PARTS} as decimal(10,0)) * ({whole(count)} + {ADDED})) div ({whole(total)} + {ADDED} * {whole('kept')}) end")

    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("long")
    groups = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    groups = groups.select("lang", "source", "kept", "lang_total", "total", p("0", "total").alias("floor"), blocks("n_groups", tile_groups).alias("row_blocks"), blocks("kept", tile_terms).alias("col_blocks"))
    groups = cut(groups.withColumn("row_block", F.pmod(F.xxhash64("source"), "row_blocks")), "groups")
    facts = groups.select("lang", "source", "kept", "lang_total", "total", "row_block", "row_blocks", "col_blocks")
    entries = entries.join(facts, ["lang", "source"]).select("lang", "source", "row_block", "row_blocks", F.pmod(F.xxhash64("term"), "col_blocks").alias("col_block"), "term", p("n", "total").alias("p"), p("of_lang", "lang_total").alias("q"))
    return groups, entries


def _best(values: np.ndarray, names: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest values, equal ones by name."""
    if len(values) > most:
        least = np.partition(values, len(values) - most)[len(values) - most]
        at = np.flatnonzero(values >= least)
    else:
        at = np.arange(len(values))
    return at[np.lexsort((names[at], -values[at]))][:most]


def _tile(most_terms: int):
    """Partial pair sums and best terms of one tile: the groups of two blocks by the terms of one block."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        head = rows["term"].isna().to_numpy()
        heads, cells = rows[head].sort_values("source"), rows[~head]
        names, floors, blocks = heads["source"].to_numpy(), heads["p"].to_numpy(np.int64), heads["row_block"].to_numpy()
        col, term = pd.factorize(cells["term"].to_numpy(object), sort=True)
        row, p = pd.Index(names).get_indexer(cells["source"]), cells["p"].to_numpy(np.int64)
        dense = np.repeat(floors[:, None], len(term), axis=1)
        dense[row, col] = p
        unseen = int(heads["q"].iloc[0]) - len(term)
        a, b = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        sums = unseen * np.abs(floors[a][:, None] - floors[b][None, :])
        wide = max(1, (4 << 20) // max(1, len(b) * max(1, len(term))))
        for i in range(0, len(a), wide):
            sums[i : i + wide] += np.abs(dense[a[i : i + wide]][:, None, :] - dense[b][None, :, :]).sum(axis=2)
        one, two = np.repeat(names[a], len(b)), np.tile(names[b], len(a))
        pairs, other = sums.ravel(), one != two
        frames = [(one[other], "pair", two[other], pairs[other])]
        if low != high:
            frames.append((two, "pair", one, pairs))
        else:
            above = p - cells["q"].to_numpy(np.int64)
            for g in range(len(names)):
                at = np.flatnonzero((row == g) & (above > 0))
                at = at[_best(above[at], term[col[at]], most_terms)]
                frames.append((np.repeat(names[g], len(at)), "term", term[col[at]], above[at]))
        lang = rows["lang"].iloc[0]
        columns = [np.concatenate([np.broadcast_to(np.asarray(f[j], object if j < 3 else np.int64), len(f[3])) for f in frames]) for j in range(4)]
        named = {c: pd.Series(v, dtype=object) for c, v in zip(("source", "part", "item"), columns, strict=False)}
        return pd.DataFrame({"lang": pd.Series([lang] * len(columns[3]), dtype=object), **named, "value": columns[3]})

    return of


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, tile_terms: int = 2048, tile_groups: int = 64, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: each group's other sources of its language by distance, and its own terms above the language's.

    Part `pair` has every other source of the language (0 where the language keeps no term), part `term` the terms that occur in the group and
    whose p there exceeds the language's, to rank `most_terms`. Ranks go by value downwards, then by item. Null texts, languages and sources
    count as empty; repeated rows count each; groups without terms have pairs only, a language of one source no pairs, an empty table no rows.
    Long texts are counted by themselves; columns but the three named ones aren't read, whatever their names.
    """
    bound_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    groups, entries = _shares(counts, read.select("lang", "source").distinct(), least_docs, tile_terms, tile_groups)
    sizes = entries.select("lang", "col_block", "term").distinct().groupBy("lang", "col_block").agg(F.count("*").alias("q"))
    heads = groups.join(sizes, "lang").select("lang", "source", "row_block", "row_blocks", "col_block", F.lit(None).cast("string").alias("term"), F.col("floor").alias("p"), "q")
    with_blocks = entries.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_blocks") - 1)))
    placed = with_blocks.select("lang", "source", "row_block", "col_block", "term", "p", "q", F.least("row_block", "other").alias("low"), F.greatest("row_block", "other").alias("high"))
    tiles = placed.groupBy("lang", "col_block", "low", "high").applyInPandas(_tile(most_terms), "lang string, source string, part string, item string, value long")
    sums = cut(tiles.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence")
    bare = groups.where("kept = 0").select("lang", "source")
    alike = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.where("part = 'pair'").unionByName(alike).withColumn("rank", F.row_number().over(by_value))
    own = sums.where("part = 'term'").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= most_terms)
    return pairs.unionByName(own).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
