"""A vector index on disk: cells with compressed residuals, searched by bounds and scored exactly.

Vectors are dealt to the nearest of the centres that k-means finds on a bounded sample. Of each its residual to the centre is stored as one
signed byte a component with a scale of its own, beside the norm of what that rounding leaves out. A query's score with centre and residual
code is then off by at most this norm, so a vector is looked at in full only if its score may reach the k-th best that is certain; within the
cells searched the answer is exact. Codes and whole vectors are two tables, partitioned by cell: a search reads the codes of its cells, and of
the whole vectors those few.

How many cells a query must search is measured when the index is built: so many that of a sample of queries `recall` of the true nearest lie in them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.operators.blockmax import _size
from lodestone.operators.dense import _hidden, _matrix, cosine_top_k, fit_cells, normalized
from lodestone.operators.lexical import top_k

#: Vectors or queries of a task's group.
BLOCK = 2048


def _near_cells(df: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    """Adds cells: the `most` nearest centres of unit vector v, nearest first."""

    def run(it):
        for batch in it:
            if len(batch):
                order = np.argsort(-(_matrix(batch.column(batch.schema.get_field_index("v")), len(batch)) @ centres.T), axis=1, kind="stable")[:, :most]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _coded(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, v, visible, cell -> the same with code (bytes), scale and error."""

    def run(it):
        for batch in it:
            if not len(batch):
                continue
            x = _matrix(batch.column(batch.schema.get_field_index("v")), len(batch))
            rest = x - centres[batch.column(batch.schema.get_field_index("cell")).to_numpy()]
            scale = np.maximum(np.abs(rest).max(1), 1e-30) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            error = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(1)) + 1e-12
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error)], names=[*batch.schema.names, "code", "scale", "error"])

    more = [T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("error", T.DoubleType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more]))


def write(vectors: DataFrame, path: str, identity: str, k: int = 10, recall: float = 0.95, cell_size: int = 4096, most_cells: int = 16_384, sample_per_cell: int = 32, asked: int = 200, id_col: str = "chunk_id", vector_col: str = "vector", visible_col: str | None = None) -> None:
    """Codes, whole vectors, centres and facts below path, the facts last. Invalid vectors are left out and counted.

    Centres are fitted on sample_per_cell vectors a cell and the number of cells to search on `asked` vectors, both drawn by hash; every
    vector is indexed. Vectors of several lengths are an error.
    """
    from lodestone.sources.sinks import publish

    spark = vectors.sparkSession
    visible = F.col(visible_col) if visible_col else F.lit(None).cast("array<string>")
    good = vectors.select(F.col(id_col).alias("id"), normalized(F.col(vector_col)).alias("v"), visible.alias("visible")).where("v is not null")
    seen = good.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if seen["least"] != seen["most"]:
        raise ValueError("vectors of several lengths")
    cells = max(1, min(most_cells, -(-seen["n"] // cell_size)))
    centres = fit_cells(good, cells, cells * sample_per_cell, "id", "v")
    blocks = lambda: F.greatest(F.ceil(F.count(F.lit(1)).over(Window.partitionBy("cell")) / BLOCK), F.lit(1))
    placed = _near_cells(good, centres, 1).withColumn("cell", F.get("cells", F.lit(0))).drop("cells") if len(centres) else good.withColumn("cell", F.lit(0))
    placed = _coded(placed, centres).withColumn("block", F.pmod(F.xxhash64("id"), blocks()).cast("int"))
    placed.write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    spread = placed.repartition("cell", "block").sortWithinPartitions("cell", "block")
    spread.select("cell", "block", "id", "code", "scale", "error", "visible").write.partitionBy("cell").parquet(f"{path}/codes")
    spread.select("cell", "id", "v").write.partitionBy("cell").parquet(f"{path}/vectors")
    publish(spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>"), f"{path}/centres")
    probes = _probes(placed, centres, k, recall, asked)
    sizes = [_size(spark, f"{path}/{name}") for name in ("codes", "vectors")]
    facts = (identity, seen["n"], vectors.count() - seen["n"], seen["most"] or 0, len(centres), probes, *sizes)
    publish(spark.createDataFrame([facts], "identity string, n long, n_invalid long, dims int, n_cells int, probes int, code_bytes long, vector_bytes long"), f"{path}/facts")


def _probes(placed: DataFrame, centres: np.ndarray, k: int, recall: float, asked: int) -> int:
    """The fewest nearest cells that hold `recall` of the k nearest of a sample, found by exact search of all vectors."""
    if len(centres) < 2:
        return max(1, len(centres))
    some = placed.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(asked)
    true = cosine_top_k(some, placed.select("id", "v"), k, -1.0, "id", "v", same=False)
    cells = _near_cells(some, centres, len(centres)).select(F.col("id").alias("question_id"), "cells")
    place = true.join(cells, "question_id").join(placed.select(F.col("id").alias("chunk_id"), "cell"), "chunk_id").select(F.array_position("cells", F.col("cell")).alias("at"))
    counts = {r["at"]: r["n"] for r in place.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
    need, so_far = recall * sum(counts.values()), 0
    for at in sorted(counts):
        so_far += counts[at]
        if so_far >= need:
            return int(at)
    return len(centres)


@dataclass(frozen=True)
class Cells:
    """A stored index."""

    codes: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    dims: int
    probes: int

    def top_k(self, queries: DataFrame, k: int, min_score: float = 0.5, probes: int | None = None, query_id: str = "question_id", vector_col: str = "vector", scope_col: str | None = None, same: bool = True) -> DataFrame:
        """question_id, chunk_id, score (6 places), rank: the k nearest by cosine >= min_score in the `probes` nearest cells (as measured, unless given).

        With scope_col only vectors whose visible list holds the query's scope take part, from the first bound on. Queries of another length are
        an error, invalid ones have no row. same=False leaves out a query's own identifier. Where all cells are searched the stored vectors
        are multiplied in blocks, as codes would bound nothing that a block doesn't.
        """
        scope = F.col(scope_col).cast("string") if scope_col else F.lit(None).cast("string")
        asked = queries.select(F.col(query_id).alias("q"), normalized(F.col(vector_col)).alias("v"), scope.alias("scope")).where("v is not null")
        odd = asked.where(F.size("v") != self.dims).limit(1).count()
        if odd:
            raise ValueError(f"a query's vector hasn't {self.dims} components")
        many = max(1, min(probes or self.probes, len(self.centres)))
        if many == len(self.centres):  # no cell is passed over: large blocks, and no query repeated for every cell
            held = self.vectors.join(self.codes.select("cell", "id", "visible"), ["cell", "id"]) if scope_col else self.vectors
            return cosine_top_k(asked, held, k, min_score, "id", "v", same, query_id="q", scope_col="scope" if scope_col else None, visible_col="visible" if scope_col else None)
        probed = _near_cells(asked, self.centres, many).select("q", "v", "scope", F.explode("cells").alias("cell")) if len(self.centres) else asked.withColumn("cell", F.lit(0))
        wanted = [r["cell"] for r in probed.select("cell").distinct().collect()]  # at most the cells
        codes = self.codes if len(wanted) >= len(self.centres) else self.codes.where(F.col("cell").isin(wanted))
        per_cell = probed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        blocks = codes.select("cell", (F.col("block") + 0).alias("block")).distinct()  # a column of its own, as both sides are grouped by it
        held = codes.join(per_cell, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        dealt = probed.join(per_cell, "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).drop("parts").join(blocks, "cell")
        kinds = f"q {dict(asked.dtypes)['q']}, id {dict(codes.dtypes)['id']}, cell int, low double, high double"
        key = ["cell", "block", "part"]
        near = dealt.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(_bounded(self.centres, k, min_score, bool(scope_col), same), kinds)
        certain = Window.partitionBy("q").orderBy(F.desc("low"))
        theta = near.withColumn("n", F.row_number().over(certain)).where(F.col("n") == k).select("q", F.col("low").alias("theta"))
        open_ = near.join(theta, "q", "left").where(F.col("high") >= F.coalesce("theta", F.lit(-2.0))).select("q", "id", "cell")
        both = open_.join(self.vectors.withColumnRenamed("v", "w"), ["cell", "id"]).join(asked.select("q", "v"), "q")
        dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return top_k(both.select(F.col("q").alias("question_id"), F.col("id").alias("chunk_id"), F.round(dot, 6).alias("score")).where(F.col("score") >= min_score), k, ["question_id"])


def _bounded(centres: np.ndarray, k: int, min_score: float, scoped: bool, same: bool):
    def of(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"q": queries["q"][:0], "id": rows["id"][:0], "cell": np.zeros(0, np.int32), "low": np.zeros(0), "high": np.zeros(0)})
        cell = int(rows["cell"].iloc[0])
        code = np.frombuffer(b"".join(rows["code"]), np.int8).reshape(len(rows), -1)
        asked = np.stack(queries["v"].to_numpy())
        scores = asked @ centres[cell][:, None] + (asked @ code.T.astype(float)) * rows["scale"].to_numpy()
        error = rows["error"].to_numpy() + 1e-6  # scores are rounded
        if scoped:
            scores[_hidden(queries["scope"].tolist(), rows["visible"].tolist())] = -9
        if not same:
            scores[queries["q"].to_numpy()[:, None] == rows["id"].to_numpy()[None, :]] = -9
        low, high = scores - error, scores + error
        sure = np.full(len(asked), -3.0) if len(rows) < k else np.partition(low, len(rows) - k, axis=1)[:, len(rows) - k]
        i, j = np.nonzero((high >= np.maximum(sure, min_score)[:, None]) & (scores > -5))
        return pd.DataFrame({"q": queries["q"].to_numpy()[i], "id": rows["id"].to_numpy()[j], "cell": np.int32(cell), "low": low[i, j], "high": high[i, j]})

    return of


def open_index(spark: SparkSession, path: str, identity: str) -> Cells:
    """The stored index; an error if it belongs to other vectors, or if its files or centres aren't what the facts say. Reads facts and centres."""
    facts = spark.read.parquet(f"{path}/facts").first()
    if facts["identity"] != identity:
        raise ValueError("the index was built for other vectors")
    if [_size(spark, f"{path}/{name}") for name in ("codes", "vectors")] != [facts["code_bytes"], facts["vector_bytes"]]:
        raise ValueError("the index isn't what was written")
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    centres = np.array([r["centre"] for r in rows], float).reshape(len(rows), -1)
    if len(rows) != facts["n_cells"] or len(rows) and centres.shape[1] != facts["dims"]:
        raise ValueError("the index's centres aren't what was written")
    return Cells(spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"), centres, facts["dims"], facts["probes"])


def visible_to(seen: DataFrame, scope: Column) -> DataFrame:
    """chunk_id, visible: the scopes (as strings) that may see a chunk, from pairs of both."""
    return seen.groupBy("chunk_id").agg(F.collect_set(scope.cast("string")).alias("visible"))
