"""Typed readers: schemas are given, never inferred, and malformed input is an error unless asked for as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schemas import ANNOTATION, CHUNK, EVALUATION_ITEM, RANKING_RESULT, SCOPE


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file with a JSON array of objects, or one object."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, CHUNK)


def scope(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, SCOPE)


def jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines, blank ones skipped; not strict adds _corrupt_record for lines that don't parse."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(path)


def rankings(spark: SparkSession, path: str) -> DataFrame:
    return _not_empty(jsonl(spark, path, RANKING_RESULT), "the ranking file")


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, EVALUATION_ITEM)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, ANNOTATION)


def cases(spark: SparkSession, path: str, schema: T.StructType, key: str = "case_id") -> DataFrame:
    """JSON lines whose key is unique."""
    df = jsonl(spark, path, schema)
    if twice := df.groupBy(key).count().where("count > 1").head():
        raise ValueError(f"{key} {twice[0]} stands twice")
    return df


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with exactly the schema's header; other headers and rows of another width are errors."""
    return spark.read.schema(schema).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)


def titles(catalog: DataFrame) -> DataFrame:
    """document_id, title of a catalog with an array of documents."""
    return catalog.select(F.explode("documents").alias("d")).select("d.document_id", "d.title")


def binary_documents(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 50_000_000, signature: bytes = b"%PDF-") -> DataFrame:
    """path, sha256, size, error of files: SIGNATURE_INVALID or TOO_LARGE; content only where there is no error."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    error = F.when(F.col("length") > most_bytes, "TOO_LARGE").when(F.substring("content", 1, len(signature)) != F.lit(bytearray(signature)), "SIGNATURE_INVALID")
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), error.alias("error"), F.when(error.isNull(), F.col("content")).alias("content"))


def html_text(html) -> F.Column:
    """Visible text of raw HTML: scripts, styles and tags dropped, common entities resolved, blanks squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.btrim(F.regexp_replace(bare, r"\s+", " "))


def manifest(spark: SparkSession, path: str, base: str) -> tuple[dict, DataFrame]:
    """A manifest and its items, whose file must have the digest that the manifest names."""
    head = json.loads(spark.read.text(path, wholetext=True).head()[0])
    file = f"{base}/{head['items_path']}"
    digest = spark.read.format("binaryFile").load(file).select(F.sha2("content", 256)).head()[0]
    if digest != head["items_sha256"]:
        raise ValueError("the items file has another digest than the manifest")
    return head, evaluation_items(spark, file)
