"""Exact dense retrieval in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let
from lodestone.operators.lexical import top_k


def valid_vector(v: Column) -> Column:
    """Not null or empty, every component finite, norm not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit vector in double precision; null where the vector isn't valid."""
    return F.when(valid_vector(v), let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def as_float32(v: Column) -> Column:
    return v.cast("array<float>")


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, rows: int, names: tuple[str, str, str], extra: Column) -> DataFrame:
    """Arrays of about `rows` (id, unit vector, extra) each, dealt by hash of the identifier."""
    good = vectors.select(F.col(id_col).alias("id"), normalized(F.col(vector_col)).alias("v"), extra.alias("s")).where("v is not null")
    n = good.count()
    parts = max(1, -(-n // rows))
    dealt = good.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("block"))
    return dealt.agg(F.collect_list(F.struct("id", "v", "s")).alias("rows")).select(*[F.col(f"rows.{f}").alias(n) for f, n in zip(("id", "v", "s"), names, strict=True)])


def _matrix(vectors: pa.Array, rows: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _hidden(asked: list, seen: list) -> np.ndarray:
    """Which vectors (columns) a query's scope (rows) isn't among the visible scopes of."""
    rows: dict = {}
    for i, scope in enumerate(asked):
        rows.setdefault(scope, []).append(i)
    out = np.ones((len(asked), len(seen)), bool)
    for j, scopes in enumerate(seen):
        for scope in () if scopes is None else scopes:
            out[rows.get(scope, []), j] = False
    return out


def _nearest(q: pa.Array, qv: pa.Array, qs: pa.Array, c: pa.Array, cv: pa.Array, cs: pa.Array, k: int, min_score: float, same: bool, scoped: bool, schema: pa.Schema) -> pa.RecordBatch:
    """At most k (query, vector, score) a query of two blocks: one matrix product, then the best by score and identifier."""
    ids, others = (x.to_numpy(zero_copy_only=False) for x in (q, c))
    scores = np.round(_matrix(qv, len(q)) @ _matrix(cv, len(c)).T, 6)
    if not same:
        scores[ids[:, None] == others[None, :]] = -2
    if scoped:
        scores[_hidden(qs.to_pylist(), cs.to_pylist())] = -2
    place = np.empty(len(others), np.int64)
    place[np.argsort(others, kind="stable")] = np.arange(len(others))
    order = np.lexsort((np.broadcast_to(place, scores.shape), -scores), axis=1)[:, :k]
    best = np.take_along_axis(scores, order, 1)
    i, j = np.nonzero(best >= min_score)
    return pa.RecordBatch.from_arrays([q.take(pa.array(i)), c.take(pa.array(order[i, j])), pa.array(best[i, j])], schema=schema)


def _scored_schema(queries: DataFrame, vectors: DataFrame, id_col: str, query_id: str) -> tuple[pa.Schema, str]:
    """Arrow and SQL schema of question_id, chunk_id, score, with the identifiers' own types."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [queries.schema[query_id].dataType, vectors.schema[id_col].dataType]
    arrow = pa.schema([("question_id", to_arrow_type(kinds[0])), ("chunk_id", to_arrow_type(kinds[1])), ("score", pa.float64())])
    return arrow, f"question_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, min_score: float = 0.5, id_col: str = "vec_id", vector_col: str = "embedding", same: bool = True, block: int = 2048, query_id: str | None = None, scope_col: str | None = None, visible_col: str | None = None) -> DataFrame:
    """question_id, chunk_id, score (6 places), rank: the k nearest by cosine >= min_score, ties by chunk_id.

    A stated query set meets all rows block by block: each pair of blocks is one matrix product that gives at most k rows a query,
    so no pair is ever shuffled. Identifiers may be numbers or strings; same=False leaves out a query's own identifier. With scope_col (of
    queries) and visible_col (of vectors, an array of scopes) a vector that a scope may not see is left out before the k best are taken.
    Invalid vectors are in no block.
    """
    query_id, scoped = query_id or id_col, bool(scope_col and visible_col)
    none = F.lit(None).cast("string")
    asked = _blocks(queries, query_id, vector_col, block, ("q", "qv", "qs"), F.col(scope_col) if scoped else none)
    held = _blocks(vectors, id_col, vector_col, block, ("c", "cv", "cs"), F.col(visible_col) if scoped else none)
    schema, fields = _scored_schema(queries, vectors, id_col, query_id)

    def run(it):
        for batch in it:
            for row in range(len(batch)):
                q, qv, qs, c, cv, cs = (batch.column(i)[row].values for i in range(6))
                yield _nearest(q, qv, qs, c, cv, cs, k, min_score, same, scoped, schema)

    near = asked.crossJoin(held).mapInArrow(run, fields)
    return top_k(near, k, ["question_id"])


def fit_cells(vectors: DataFrame, cells: int, sample: int, id_col: str, vector_col: str, rounds: int = 8) -> np.ndarray:
    """Unit centroids of spherical k-means over at most `sample` unit vectors, drawn by hash of the identifier."""
    rows = vectors.select(F.xxhash64(id_col).alias("h"), normalized(F.col(vector_col)).alias("v")).where("v is not null").orderBy("h", "v").limit(sample).toArrow()
    x = np.array(rows.column(1).to_pylist(), float).reshape(len(rows), -1)
    centres = x[: max(1, min(cells, len(x)))]
    for _ in range(rounds if len(x) else 0):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def ann_top_k(queries: DataFrame, vectors: DataFrame, k: int, min_score: float = 0.5, cell_size: int = 4096, probes: int = 16, sample_per_cell: int = 32, most_cells: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding", scope_col: str | None = None, visible_col: str | None = None, same: bool = True) -> DataFrame:
    """question_id, chunk_id, score (6 places), rank: about the k nearest by cosine >= min_score, looked for in the query's `probes` nearest cells.

    Cells are fitted on a bounded sample; every vector is in one, and only pairs that share a cell are multiplied. With as many
    probes as cells the answer is exact: cells then part nothing, so queries and vectors meet in large blocks and no query is sent to
    every cell. With scope_col (of queries) and visible_col (of vectors, an array of scopes) a vector that a
    scope may not see is left out before the k best are taken. same=False leaves out a query's own identifier.
    """
    n = vectors.count()
    if probes >= min(most_cells, -(-n // cell_size)):
        number = lambda df: df.withColumn(id_col, F.col(id_col).cast("long"))
        return cosine_top_k(number(queries), number(vectors), k, min_score, id_col, vector_col, same, scope_col=scope_col if visible_col else None, visible_col=visible_col)
    centres = fit_cells(vectors, min(most_cells, -(-n // cell_size)), min(most_cells, -(-n // cell_size)) * sample_per_cell, id_col, vector_col)
    many = max(1, min(probes, len(centres)))

    def placed(df: DataFrame, most: int, extra) -> DataFrame:
        good = df.select(F.col(id_col).cast("long").alias("id"), normalized(F.col(vector_col)).alias("v"), extra.alias("s")).where("v is not null")

        def run(it):
            for batch in it:
                if len(batch):
                    x = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
                    order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :most]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "v", "s", "cells"])

        kind = good.schema["s"].dataType.simpleString()
        return good.mapInArrow(run, f"id long, v array<double>, s {kind}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")

    asked = placed(queries, many, F.col(scope_col) if scope_col else F.lit(None).cast("string"))
    held = placed(vectors, 1, F.col(visible_col) if visible_col else F.lit(None).cast("array<string>"))
    pairs = asked.groupBy("cell").agg(F.collect_list(F.struct("id", "v", "s")).alias("q"))  # a stated query set
    blocks = held.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (2048 * max(1, len(centres)))))).alias("block")).agg(F.collect_list(F.struct("id", "v", "s")).alias("c"))
    schema = pa.schema([("question_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])

    def compare(it):
        for batch in it:
            for row in range(len(batch)):
                qs, cs = (batch.column(i)[row].values for i in range(2))
                (q, qv, qscope), (c, cv, cscope) = ([x.field(i) for i in range(3)] for x in (qs, cs))
                q, c = q.to_numpy(), c.to_numpy()
                scores = np.round(qv.flatten().to_numpy().reshape(len(q), -1) @ cv.flatten().to_numpy().reshape(len(c), -1).T, 6)
                if not same:
                    scores[q[:, None] == c[None, :]] = -2
                if visible_col:
                    sees = [set(x or ()) for x in cscope.to_pylist()]
                    for i, scope in enumerate(qscope.to_pylist()):
                        scores[i, [scope not in s for s in sees]] = -2
                order = np.lexsort((np.broadcast_to(c, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, 1)
                i, j = np.nonzero(best >= min_score)
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(c[order[i, j]]), pa.array(best[i, j])], schema=schema)

    near = blocks.join(pairs, "cell").select("q", "c").mapInArrow(compare, "question_id long, chunk_id long, score double")
    return top_k(near, k, ["question_id"])


def embed(texts: DataFrame, provider, text_col: str = "text", dims: int = 64, batch: int = 16) -> DataFrame:
    """Adds vector: provider(list of texts) -> list of vectors, called in batches of `batch`; a wrong length or size is an error."""
    fields = texts.schema

    def run(it):
        for part in it:
            texts_, out = part.column(part.schema.get_field_index(text_col)).to_pylist(), []
            for at in range(0, len(texts_), batch):
                got = provider(texts_[at : at + batch])
                if len(got) != len(texts_[at : at + batch]) or any(len(v) != dims for v in got):
                    raise ValueError("the provider returned another number or size of vectors")
                out += [[float(x) for x in v] for v in got]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.float64()))], names=[*part.schema.names, "vector"])

    from pyspark.sql import types as T

    return texts.mapInArrow(run, T.StructType([*fields.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def hashed_embedding(texts: list[str], dims: int = 64) -> list[list[float]]:
    """The default provider: counts of token hashes, for tests and offline use; no model is trained or loaded."""
    import re
    import zlib

    out = []
    for t in texts:
        v = [0.0] * dims
        for token in re.findall(r"\w+", (t or "").lower()):
            v[zlib.crc32(token.encode()) % dims] += 1.0
        out.append(v)
    return out


def fingerprint(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """n and a digest of all (id, vector) that doesn't depend on row order; combined before the shuffle, so it scales."""
    each = F.conv(F.substring(F.sha2(F.to_json(F.struct(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(each).cast("string").alias("digest"))


def embed_cached(texts: DataFrame, path: str, provider, text_col: str = "text", dims: int = 64) -> DataFrame:
    """Adds vector from a table of (digest of the text, vector) at path; only texts that it lacks go to the provider, and are appended."""
    from lodestone.sources.sinks import exists

    spark = texts.sparkSession
    keyed = texts.withColumn("_key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    asked = keyed.select("_key", F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["_key"])
    if exists(spark, path):
        asked = asked.join(spark.read.parquet(path), "_key", "left_anti")
    embed(asked, provider, "text", dims).select("_key", "vector").write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path), "_key").drop("_key")
