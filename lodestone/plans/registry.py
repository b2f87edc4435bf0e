"""Queries by name, each with its SQL for a second engine where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder: spark.checkpoint.dir, or on a local master, where none is named, a temporary one."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not named and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the checkpoint folder and read again, so that several readers share it and columns are pruned."""
    spark = with_checkpoints(df.sparkSession)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
