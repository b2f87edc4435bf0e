"""What the operators of this subpackage share: the cluster's shared folder, tables written to cut lineage, files by URI."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that end a word where a contract says `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: spark.checkpoint.dir of the session.

    Only where none is named and master is local (tests on one machine) a temporary folder is made and set; elsewhere that is an
    error, as executors wouldn't see each other's files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        own = sc._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A folder for one table or set of files, unique to this call and grouped by application."""
    return f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: a lost executor costs no recomputation from the start."""
    spark = df.sparkSession
    at = fresh(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def remove_cuts(spark: SparkSession) -> None:
    """Delete every table and file that this application has put in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a plain local path; used on executors, where there is no JVM gateway."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


#: Bytes and rows of texts that Spark hands to Python at once; sessions with larger limits get these.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits of an Arrow batch where they are larger: JVM and worker each hold a batch of texts outside the heap."""
    size = (spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) or "").rstrip("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (long) and text (null: empty) of every row, to be streamed to Python in small batches."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def batches(it: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts together stay near `most` bytes; one longer text is a slice by itself."""
    for batch in it:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        if col.nbytes <= most:
            yield batch
            continue
        start = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def n_words(text):
    """Words `[^\\x20\\x09-\\x0D]+` of a text column; null: 0. Stays in the JVM."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def hash_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, at most that many, drawn by hash of a key: the same in every run, whatever the partitions.

    Rows are thinned by hash before they are ordered, so that tasks together send the driver little more than what is asked for.
    """
    share = min(1.0, 1.3 * (rows + 100) / max(total, 1))
    thin = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(key), 11)).where(F.col("_h") <= int(share * (1 << 53)))
    return thin.orderBy("_h", key).limit(rows).drop("_h")
