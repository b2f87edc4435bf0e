"""Streaming forms of the stateful operators: an extension, as the batch forms in operators.lifecycle are what is asked for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.lexical import postings
from lodestone.operators.lifecycle import TRANSITIONS

_STATE = "status string, revision long"
_OUT = "version_id string, sequence long, status string, revision long, code string"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, revision = state.get if state.exists else (None, 0)
    rows = []
    for r in pd.concat(list(frames)).sort_values("sequence").itertuples():
        if status is None:
            code = None if r.status == "REGISTERED" else "NOT_REGISTERED"
        else:
            code = None if (status, r.status) in TRANSITIONS else "TRANSITION_FORBIDDEN"
        if code is None and r.revision != revision + 1:
            code = "REVISION_SKIPPED"
        status, revision = r.status, int(r.revision)
        rows.append((key[0], int(r.sequence), status, revision, code))
    state.update((status, revision))
    yield pd.DataFrame(rows, columns=["version_id", "sequence", "status", "revision", "code"])


def version_states(events: DataFrame) -> DataFrame:
    """Each event with the state it leads to and the code of the rule it breaks; one small state a version."""
    return events.groupBy("version_id").applyInPandasWithState(_step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; ts is cast as a watermark needs a time with zone."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return df.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def grow_index(stream: DataFrame, path: str, checkpoint: str, fields) -> None:
    """Append each batch's postings to an index table; a batch that is run again replaces itself, as its number names its folder."""

    def add(df: DataFrame, batch: int) -> None:
        postings(df, fields(df)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its result from memory; for tests and small results."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def drain_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append stream over what is there now, its result written as Parquet below path by its tasks; results of any size."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
