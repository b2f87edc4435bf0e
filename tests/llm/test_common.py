"""Batches, samples and word counts."""

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import common


def test_batches_hold_whole_rows():
    batch = pa.record_batch({"id": list(range(6)), "text": ["a" * 10, None, "b" * 300, "", "c" * 5, "d" * 20]})
    parts = list(common.batches(iter([batch, batch.slice(0, 0)]), "text", 30))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]
    assert [p.num_rows for p in common.batches(iter([batch]), "text")] == [6]


def test_hash_sample(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    one = {r.key for r in common.hash_sample(df, "key", 500, 5000).collect()}
    assert len(one) == 500 and one == {r.key for r in common.hash_sample(df.repartition(7), "key", 500, 5000).collect()}
    assert common.hash_sample(df, "key", 9000, 5000).count() == 5000
    assert common.hash_sample(df.where("false"), "key", 10, 0).count() == 0


def test_words(spark):
    rows = [None, "", " \t\n\v\f\r", "a", " a b ", "a\tb\nc d\x1fe", "é f g"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", common.n_words(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [0, 0, 0, 1, 2, 4, 2]


def test_cut_and_removal(spark):
    from pathlib import Path

    df = common.cut(spark.range(3), "some")
    assert df.count() == 3
    top = Path(common.shared_dir(spark).removeprefix("file:")) / f"lodestone-{spark.sparkContext.applicationId}"
    assert top.exists()
    common.remove_cuts(spark)
    assert not top.exists()
