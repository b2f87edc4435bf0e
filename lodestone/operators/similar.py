"""Cosine similarity join by pivots: blocks of vectors meet only where the angles to their pivots leave room for the threshold."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.operators.dense import _matrix, fit_cells, normalized


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell, the nearest pivot, and angle, that between it and unit vector v."""

    def run(it):
        for batch in it:
            if len(batch):
                cosines = _matrix(batch.column(batch.schema.get_field_index("v")), len(batch)) @ pivots.T
                cell = cosines.argmax(1)
                angle = np.arccos(np.clip(cosines[np.arange(len(batch)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def block_pairs(placed: DataFrame, pivots: np.ndarray, least: float) -> DataFrame:
    """key, cell, sub, cell2, sub2, n, n2: pairs of blocks of one key (a block with itself too) that may hold a pair of cosine `least`.

    Two vectors are at least as far apart as their pivots less their own angles to these; a pair of blocks is passed over where that exceeds
    the threshold's angle for the widest angles of both.
    """
    spark = placed.sparkSession
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    rows = [(i, j, float(between[i, j])) for i in range(len(pivots)) for j in range(len(pivots))]
    angles = F.broadcast(spark.createDataFrame(rows, "cell int, cell2 int, between double"))  # pivots squared
    blocks = placed.groupBy("key", "cell", "sub").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    other = blocks.toDF("key", "cell2", "sub2", "radius2", "n2")
    both = blocks.join(other, "key").where("cell < cell2 or cell = cell2 and sub <= sub2").join(angles, ["cell", "cell2"])
    return both.where(F.col("between") - F.col("radius") - F.col("radius2") <= math.acos(max(-1.0, min(1.0, least))) + 1e-9).select("key", "cell", "sub", "cell2", "sub2", "n", "n2")


def similar_pairs(vectors: DataFrame, least: float, keep, id_col: str = "vec_id", vector_col: str = "embedding", by: str | None = None, pivots: int | None = None, sample_per_pivot: int = 32, block: int = 1024, most_pivots: int = 256) -> DataFrame:
    """a, b, cosine of all pairs a < b (of one value of `by`, where given) with cosine of at least `least`.

    Pivots, one for four blocks of vectors and at most `most_pivots` unless given, are fitted on a bounded sample. A key's vectors near one pivot are dealt into blocks of about `block`, so a key of any size is spread; a
    pair of blocks is one matrix product, of which only the pairs found leave the task. Invalid vectors pair with nothing. keep(df) writes
    a frame once on shared storage.
    """
    key = F.col(by).cast("string") if by else F.lit("")
    good = vectors.select(F.col(id_col).alias("id"), key.alias("key"), normalized(F.col(vector_col)).alias("v")).where("v is not null")
    pivots = pivots or max(1, min(most_pivots, good.count() // (4 * block)))
    centres = fit_cells(good, pivots, pivots * sample_per_pivot, "id", "v")
    many = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("key", "cell")) / block)
    placed = _placed(good, centres) if len(centres) else good.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)})
    placed = keep(placed.withColumn("sub", F.pmod(F.xxhash64("id"), many).cast("int")))
    pairs = keep(block_pairs(placed, centres if len(centres) else np.ones((1, 1)), least))
    members = placed.select("key", "cell", "sub", "id", "v")
    left = members.join(pairs.drop("n", "n2"), ["key", "cell", "sub"])
    right = members.toDF("key", "cell2", "sub2", "id2", "w").join(pairs.drop("n", "n2"), ["key", "cell2", "sub2"])
    work = ["key", "cell", "sub", "cell2", "sub2"]
    kind = dict(good.dtypes)["id"]

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": x["id"][:0], "b": y["id2"][:0], "cosine": np.zeros(0)})
        a, b = x["id"].to_numpy(), y["id2"].to_numpy()
        cosines = np.stack(x["v"].to_numpy()) @ np.stack(y["w"].to_numpy()).T
        i, j = np.nonzero(cosines >= least)
        a, b, found = a[i], b[j], cosines[i, j]
        if x["cell"].iloc[0] == y["cell2"].iloc[0] and x["sub"].iloc[0] == y["sub2"].iloc[0]:
            once = a < b
            a, b, found = a[once], b[once], found[once]
        swap = a > b
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "cosine": found})

    one = left.select(*work, "id", "v")
    both = right.select(*[F.col(c).alias(f"{c}_") for c in work], "id2", "w").toDF(*work, "id2", "w")  # columns of its own, as both sides are grouped by them
    return one.groupBy(*work).cogroup(both.groupBy(*work)).applyInPandas(product, f"a {kind}, b {kind}, cosine double")


def blocks_of(vectors: DataFrame, columns: list[str], keep, id_col: str = "vec_id", by: str | None = None, block: int = 16_384) -> DataFrame:
    """The pairs of blocks of one key, each with itself too: key, i, j, id and the unit vectors v_0.. of block i (side 0) and j (side 1), one row a vector and side.

    A key's vectors are dealt into g blocks of about `block` by hash of the identifier, so a vector is sent to g + 1 tasks, whatever
    the key's size. A vector that isn't valid in any of the columns is null there.
    """
    key = F.col(by).cast("string") if by else F.lit("")
    return _block_pairs(keep(vectors.select(F.col(id_col).alias("id"), key.alias("key"), *[normalized(F.col(c)).alias(f"v_{n}") for n, c in enumerate(columns)])), block)


def _block_pairs(good: DataFrame, block: int) -> DataFrame:
    """key, i, j, side, id and what else the rows (id, key, ..) hold, for each pair of blocks of their key that they belong to."""
    rest = [c for c in good.columns if c not in ("id", "key")]
    sizes = good.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("g"))
    dealt = good.join(F.broadcast(sizes), "key").withColumn("b", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    other = F.sequence(F.lit(0), F.col("g") - 1)
    sides = F.concat(
        F.transform(F.filter(other, lambda o: o >= F.col("b")), lambda o: F.struct(F.col("b").alias("i"), o.alias("j"), F.lit(0).alias("side"))),
        F.transform(F.filter(other, lambda o: o < F.col("b")), lambda o: F.struct(o.alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"))),
    )
    return dealt.select("key", "id", *rest, F.explode(sides).alias("x")).select("key", "x.i", "x.j", "x.side", "id", *rest)


def _products(frame: pd.DataFrame, columns: int, dims: list[int], rows: int = 512):
    """(identifiers of some rows, of all columns, cosines by column, which of them are pairs a row before b) of a block pair, some rows at a time."""

    def side(x: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        none = lambda n: np.full(dims[n], np.nan)
        return x["id"].to_numpy(), [np.stack([none(n) if v is None else v for v in x[f"v_{n}"]]) if len(x) else np.zeros((0, dims[n])) for n in range(columns)]

    a, av = side(frame[frame["side"] == 0])
    alone = frame["i"].iloc[0] == frame["j"].iloc[0]
    b, bv = (a, av) if alone else side(frame[frame["side"] == 1])
    for at in range(0, len(a), rows):
        some = a[at : at + rows]
        yield some, b, [x[at : at + rows] @ y.T for x, y in zip(av, bv, strict=True)], (some[:, None] < b[None, :]) if alone else np.ones((len(some), len(b)), bool)


def _dims(frame: pd.DataFrame, columns: int) -> list[int]:
    return [next((len(v) for v in frame[f"v_{n}"] if v is not None), 1) for n in range(columns)]


def any_similar(vectors: DataFrame, least: dict[str, float], keep, id_col: str = "vec_id", by: str | None = None, block: int = 16_384) -> DataFrame:
    """a, b and the cosine by each column of all pairs a < b of one key with at least one column's cosine at its least; a null is no cosine."""
    columns = list(least)
    pairs = blocks_of(vectors, columns, keep, id_col, by, block)
    kind = dict(pairs.dtypes)["id"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b, cosines, once in _products(frame, len(columns), _dims(frame, len(columns))):
            i, j = np.nonzero(once & np.logical_or.reduce([c >= least[n] for n, c in zip(columns, cosines, strict=True)]))
            x, y = a[i], b[j]
            out.append(pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), **{n: c[i, j] for n, c in zip(columns, cosines, strict=True)}}))
        return pd.concat(out) if out else pd.DataFrame({"a": frame["id"][:0], "b": frame["id"][:0], **{n: np.zeros(0) for n in columns}})

    found = pairs.groupBy("key", "i", "j").applyInPandas(run, f"a {kind}, b {kind}, " + ", ".join(f"`{n}` double" for n in columns))
    return found.select("a", "b", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in columns])


def _units(vectors: pa.ChunkedArray, lengths: list[int | None]) -> list[np.ndarray]:
    """Unit vectors of a prefix of each length (None: the whole vector) in double precision; NaN where one isn't valid."""
    if len(pc.unique(pc.list_value_length(vectors))) != 1:
        raise ValueError("vectors differ in length")
    x = _matrix(vectors.combine_chunks(), len(vectors)).astype(np.float64)
    out = []
    for n in lengths:
        with np.errstate(all="ignore"):
            norm = np.sqrt((x[:, :n] ** 2).sum(1))
            out.append(x[:, :n] / np.where(np.isfinite(norm) & (norm > 0), norm, np.nan)[:, None])
    return out


def _join_trees(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a and b pair by pair; root holds every node's root, and stays so."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def _forest(table: pa.Table, least: dict[int | None, float], linked, rows: int) -> pa.Table:
    """a, b: a star for each set of identifiers that links of one pair of blocks connect. Pairs whose ends are connected already are not looked at."""
    alone = table["i"][0].as_py() == table["j"][0].as_py()
    table = table.take(pc.sort_indices(table, [("side", "ascending"), ("id", "ascending")]))
    ids, units = table["id"].to_numpy(), _units(table["v"], list(least))
    first = len(ids) if alone else pc.sum(pc.equal(table["side"], 0)).as_py()
    root = np.arange(len(ids))
    for at in range(0, first, rows):
        here, there = np.arange(at, min(at + rows, first)), np.arange(at if alone else first, len(ids))
        main = np.bincount(root).argmax()  # the largest tree: its nodes need not meet one another
        for i, j in ((here[root[here] == main], there[root[there] != main]), (here[root[here] != main], there)):
            if len(i) and len(j):
                cosines = [u[i] @ u[j].T for u in units]
                x, y = np.nonzero(np.logical_or.reduce([c >= n for c, n in zip(cosines, least.values(), strict=True)]) & (root[i][:, None] != root[j][None, :]))
                good = linked(ids[i[x]], ids[j[y]], *[c[x, y] for c in cosines])
                _join_trees(root, i[x[good]], j[y[good]])
    order = np.argsort(ids, kind="stable")
    _, lowest, tree = np.unique(root[order], return_index=True, return_inverse=True)
    a, b = ids[order][lowest[tree]], ids[order]
    return pa.table({"a": pa.array(a[a != b], table["id"].type), "b": pa.array(b[a != b], table["id"].type)})


def linking_forest(vectors: DataFrame, least: dict[int | None, float], linked, id_col: str = "vec_id", vector_col: str = "embedding", by: str | None = None, block: int = 65_536, rows: int = 128) -> DataFrame:
    """a, b: pairs that connect the same identifiers as all linked pairs of one key do, fewer than the vectors of each pair of blocks.

    A pair is linked where the cosine of one of the prefixes of both vectors (None: the whole) is at its `least` and linked(a, b,
    cosines by prefix), on numpy arrays, says so; the order of a and b must not matter to it. Links are reduced in the task that finds
    them, so what is sent doesn't grow with their number: a vector goes, as it is stored, to one task for each block of its key.
    """
    key = F.col(by).cast("string") if by else F.lit("")
    good = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), key.alias("key"), F.col(vector_col).alias("v"))
    kind = dict(good.dtypes)["id"]
    return _block_pairs(good, block).groupBy("key", "i", "j").applyInArrow(lambda t: _forest(t, least, linked, rows), f"a {kind}, b {kind}")


def cosine_counts(vectors: DataFrame, places: int, keep, id_col: str = "vec_id", vector_col: str = "embedding", by: str | None = None, block: int = 16_384, width: int = 1, within: tuple[int, list[int]] | None = None) -> DataFrame:
    """part, n: how many pairs a < b of one key have a cosine in each part of `width` units of 10 ** -places, rounded to units.

    within (a width, parts of that width): only pairs in these parts are counted.
    """
    pairs = blocks_of(vectors, [vector_col], keep, id_col, by, block)
    unit = 10**places

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * unit // width + 3, np.int64)
        for _, _, (c,), once in _products(frame, 1, _dims(frame, 1)):
            whole = np.floor(c[once & ~np.isnan(c)] * unit + 0.5).astype(np.int64) + unit
            if within is not None:
                asked = np.zeros(2 * unit // within[0] + 3, bool)
                asked[np.array(within[1]) + unit // within[0]] = True
                whole = whole[asked[whole // within[0]]]
            total += np.bincount(whole // width, minlength=len(total))
        at = np.nonzero(total)[0]
        return pd.DataFrame({"part": at - unit // width, "n": total[at]})

    return pairs.groupBy("key", "i", "j").applyInPandas(run, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))


def cosine_quantiles(vectors: DataFrame, asked: list[float], places: int, keep, coarse: int = 1000, plus: float = 0.0, **how) -> list[float | None]:
    """Exact quantiles (linear between neighbours at (n - 1) * p) of the rounded cosines, plus a number, of all pairs of one key.

    Two passes of counts: by parts of `coarse` units, then by unit within the parts that hold the ranks, so no task holds more than counts,
    and the driver gets one row a part.
    """
    listed = lambda **more: sorted((r["part"], r["n"]) for r in cosine_counts(vectors, places, keep, **more, **how).collect())
    counts = listed(width=coarse)
    n = sum(c for _, c in counts)
    if not n:
        return [None for _ in asked]
    ranks = {f((n - 1) * p) for p in asked for f in (math.floor, math.ceil)}
    home = {k: _at(counts, k) for k in ranks}
    fine = listed(within=(coarse, sorted({part for part, _ in home.values()})))
    value = {k: round(_at([x for x in fine if x[0] // coarse == part], k - before)[0] / 10**places + plus, places) for k, (part, before) in home.items()}
    out = []
    for p in asked:
        at = (n - 1) * p
        lo, hi = value[math.floor(at)], value[math.ceil(at)]
        out.append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def _at(counts: list[tuple[int, int]], k: int) -> tuple[int, int]:
    """The part that holds rank k, and how many ranks lie before it."""
    before = 0
    for part, n in counts:
        if k < before + n:
            return part, before
        before += n
    raise IndexError(k)
