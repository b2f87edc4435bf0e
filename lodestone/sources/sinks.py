"""Sinks that publish only what has been verified."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.lifecycle import missing_rows


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def publish(df: DataFrame, path: str, check=None, partition_by: list[str] | None = None) -> DataFrame:
    """Write beside the target, verify there, then rename; an existing target is an error. check(frame) raises on a fault.

    Rows are compared by number and by a digest that doesn't depend on order, taken of what is given while it is written, and of what was
    written by reading it back: the input is computed once, so it may differ from run to run, as a model's answers do.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    facts = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")).alias("digest")]
    given = Observation()
    df.observe(given, *facts).write.partitionBy(*partition_by or []).parquet(staged)
    written = spark.read.schema(df.schema).parquet(staged)
    try:
        if given.get != written.agg(*facts).first().asDict():
            raise ValueError("what was written isn't what was given")
        if check:
            check(written)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target):
            raise OSError(f"{path} could not be published")
    except Exception:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
        raise
    return spark.read.parquet(path)


def publish_all(frames: dict[str, DataFrame], checks: dict | None = None) -> dict[str, DataFrame]:
    """Publish several tables or none: when one fails, those published before it are taken back and the error is raised."""
    done: dict[str, DataFrame] = {}
    try:
        for path, df in frames.items():
            done[path] = publish(df, path, (checks or {}).get(path))
    except Exception:
        for path, df in done.items():
            fs, target = _fs(df.sparkSession, path)
            fs.delete(target, True)
        raise
    return done


def ensure_staged(expected: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows that the table lacks, verify that none is missing then; returns how many were appended."""
    spark = expected.sparkSession
    fs, target = _fs(spark, path)
    lacking = missing_rows(expected, spark.read.parquet(path), keys) if fs.exists(target) else expected
    n = lacking.count()
    if n:
        lacking.write.mode("append").parquet(path)
    if not missing_rows(expected, spark.read.parquet(path), keys).isEmpty():
        raise ValueError("rows are missing after the write")
    return n


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order and nulls kept."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).json(path)


def write_files(texts: DataFrame, path: str) -> None:
    """One file a row of one column of text, all in one folder, so that reading lists one folder and not one a file.

    Tasks move their own files to the folder when they commit, which the driver would else do one by one.
    """
    rows = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number: the work is in the files, not in the bytes
    rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)


def write_batches(batched: DataFrame, path: str, column: str = "batch") -> None:
    """One folder of JSON lines a batch."""
    batched.repartition(column).write.partitionBy(column).json(path)


def put_objects(objects: DataFrame, path: str, content: str = "content") -> int:
    """Content-addressed objects: those with new digests are appended under their first two digits; returns how many there are then."""
    spark = objects.sparkSession
    rows = objects.select(F.sha2(content, 256).alias("sha256"), F.col(content).alias("content")).dropDuplicates(["sha256"])
    fs, target = _fs(spark, path)
    new = missing_rows(rows, spark.read.parquet(path), ["sha256"]) if fs.exists(target) else rows
    new.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
    return spark.read.parquet(path).count()


def damaged_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects whose content has another digest than their name."""
    return spark.read.parquet(path).where(F.sha2("content", 256) != F.col("sha256")).select("sha256")
