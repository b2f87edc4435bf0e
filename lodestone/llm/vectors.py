"""Near-duplicates among embeddings: spherical k-means cells, blocked cosine products, one representative a group.

Equal vectors are one row from the start. Centroids are fitted on a bounded sample, then every vector goes to its nearest cell (its
home) and meets the members of each other cell whose border is so near that a vector within the threshold can live behind it: no
link is lost, and in spaces where borders are far whole cells are passed over. A cell's members are dealt into blocks of bounded
size; each pair of blocks is one task's work, whose cosines are matrix products in double precision. A task returns sums of links a
vector and a spanning forest of the links, never the pairs. Two vectors meet in one pair of blocks only.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, hash_sample
from lodestone.llm.graph import connected_components

_UNITS = "vec_id long, key string, unit binary"


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """vec_id, key (digest of the vector's bytes), unit (little-endian doubles, padded with zeros to `dims`).

    Key and unit are null for vectors that are null, empty or zero or hold a null or non-finite component.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.string()), ("unit", pa.binary())])

    def run(it):
        for batch in it:
            col = batch.column(1)
            keys: list = [None] * len(col)
            units: list = [None] * len(col)
            for i, v in enumerate(col):
                if not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy().astype(np.float64)
                top = np.abs(x).max()
                if not np.isfinite(top) or top == 0:
                    continue
                keys[i] = hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).hexdigest()
                whole = np.zeros(dims)
                whole[: len(x)] = x / top  # so that squares neither overflow nor vanish
                units[i] = (whole / np.sqrt((whole * whole).sum())).astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(units, pa.binary())], schema=schema)

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, _UNITS)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit rows; an empty cell keeps its old centroid."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1))
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centres)
    return centres


def fit_cells(distinct: DataFrame, n: int, cell_size: int, most_cells: int, sample_per_cell: int) -> np.ndarray:
    """Centroids for about n / cell_size cells, at most `most_cells`, from a sample of `sample_per_cell` vectors a cell drawn by hash of the key."""
    k = max(1, min(most_cells, math.ceil(n / cell_size)))
    take = hash_sample(distinct.select("key", "unit"), "key", k * sample_per_cell, n).select("unit").toArrow()
    x = np.frombuffer(b"".join(take.column(0).to_pylist()), "<f8").reshape(len(take), -1)
    return spherical_kmeans(x, min(k, len(x)))


_LINKS = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links within a block, or between two (side 0 and 1): a row (key, null, linked vectors) and rows (key, key, null) that span the graph."""
    keys = table["key"].to_pylist()
    n = table["n"].to_numpy().astype(np.float64)
    x = np.frombuffer(b"".join(table["unit"].to_pylist()), "<f8").reshape(len(keys), -1)
    side = table["side"].to_numpy()
    within = table["one"][0].as_py() == table["two"][0].as_py()
    left, right = (np.arange(len(keys)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    sums, label = np.zeros(len(keys)), np.arange(len(keys))
    out_a, out_b = [], []
    y = x[right]
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        hit = x[rows] @ y.T >= threshold
        if within:
            hit[np.arange(len(rows)), rows] = False
        if not hit.any():
            continue
        weights = hit.astype(np.float64)
        sums[rows] += weights @ n[right]
        if not within:
            sums[right] += n[rows] @ weights
        for i in np.flatnonzero(hit.any(1)):
            others = right[hit[i]]
            labels, first = np.unique(label[others], return_index=True)
            new = labels != label[rows[i]]
            if new.any():
                out_a += [keys[rows[i]]] * int(new.sum())
                out_b += [keys[j] for j in others[first[new]]]
                label[np.isin(label, labels[new])] = label[rows[i]]
    some = np.flatnonzero(sums)
    counted = [keys[i] for i in some]
    sizes = sums[some].astype(np.int64).tolist()
    return pa.Table.from_arrays([pa.array(counted + out_a, pa.string()), pa.array([None] * len(some) + out_b, pa.string()), pa.array(sizes + [None] * len(out_a), pa.int64())], schema=_LINKS)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, cell_size: int = 16384, most_cells: int = 4096, sample_per_cell: int = 8, block: int = 16384) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable), kept (the component's representative); one row a row of the input.

    Links are all pairs with cosine >= threshold, whatever the number of cells. Blocks have at most `block` vectors, and
    at most 8 MB. Vectors that are null, empty or zero or hold null or non-finite components have no link
    and stay. Shorter vectors count as padded with zeros. Several rows with one vec_id are several vectors. A null vec_id names no
    component; a component of such rows only has a null id and keeps them.
    """
    dims = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    units = cut(unit_vectors(rows, id_col, vector_col, max(dims, 1)), "unit-vectors")
    distinct = cut(units.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit")), "distinct-vectors")
    total = distinct.count()
    if not total:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    centres = fit_cells(distinct, total, cell_size, most_cells, sample_per_cell)
    # of two linked vectors each lies within this distance of the plane between their homes' centroids
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else 1.0
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), ("unit", pa.binary()), ("home", pa.int32()), ("meets", pa.list_(pa.int32()))])

    def assign(it):
        apart = np.sqrt(np.maximum(0.0, np.square(centres).sum(1)[:, None] + np.square(centres).sum(1)[None, :] - 2 * centres @ centres.T))
        for batch in it:
            if not len(batch):
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(len(batch), -1)
            homes, meets = np.empty(len(x), np.int32), []
            for at in range(0, len(x), 1024):
                near = x[at : at + 1024] @ centres.T
                home = near.argmax(1)
                homes[at : at + 1024] = home
                meets += [np.flatnonzero(m).tolist() for m in near.max(1)[:, None] - near <= reach * apart[home] + 1e-9]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes), pa.array(meets, pa.list_(pa.int32()))], schema=schema)

    placed = cut(distinct.select("key", "n", "unit").mapInArrow(assign, "key string, n long, unit binary, home int, meets array<int>"), "cells")
    rows_a_block = max(1, min(block, (8 << 20) // (8 * max(dims, 1))))
    sizes = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / rows_a_block).cast("int").alias("blocks"))
    own = placed.join(sizes.toDF("home", "own"), "home").withColumn("block", F.pmod(F.xxhash64("key"), F.col("own")).cast("int"))
    met = own.select("key", "n", "unit", F.struct("home", "block").alias("mine"), F.explode("meets").alias("cell")).join(sizes, "cell")
    met = met.select("key", "n", "unit", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "cell").withColumn("other", F.struct(F.col("cell").alias("home"), F.col("b").alias("block")))
    work = met.select(F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), "key", "n", "unit")
    found = cut(work.groupBy("one", "two").applyInArrow(lambda t: _compare(t, threshold), "a string, b string, n long"), "vector-links")
    linked = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("more"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    known = distinct.select("key", "least", "n").join(linked, "key", "left").join(roots.toDF("key", "root"), "key", "left")
    known = known.select("key", "least", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(known.join(least, "root").select("key", "n_links", "component_id"), "vector-components")
    joined = units.select("vec_id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
