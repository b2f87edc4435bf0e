"""The supplied tables as the engine's entities, and the same as SQL for the second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk; unlabelled ones are inactive, as access fails closed."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    active = labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("is_active"))
    kind = F.pmod("doc_id", F.lit(3))
    return d.join(active, "doc_id", "left").select(
        F.format_string("c%010d", "doc_id").alias("chunk_id"),
        F.format_string("d%010d", "doc_id").alias("document_id"),
        F.lit("v1").alias("version_id"),
        "text",
        F.concat("lang", F.lit(" > "), "source").alias("section_path"),
        F.lit(1).alias("page_start"),
        (F.floor(F.col("n_chars") / 2000) + 1).cast("int").alias("page_end"),
        F.col("source").alias("tenant_id"),
        F.when(kind == 0, "public").when(kind == 1, "tenant").otherwise("private").alias("visibility"),
        F.array("lang").alias("library_scope_ids"),
        F.coalesce("is_active", F.lit(False)).alias("is_active"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, text, section_path of every chunk.

    Labels say nothing of these; they are joined, with all texts shuffled, only where they name a document twice, so that its rows are as many.
    """
    named_twice = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    d = chunks(spark, sf_dir) if not named_twice.isEmpty() else _passages(table(spark, sf_dir, "documents"))
    return d.select("chunk_id", "text", "section_path")


def _passages(documents: DataFrame) -> DataFrame:
    return documents.select(F.format_string("c%010d", "doc_id").alias("chunk_id"), "text", F.concat("lang", F.lit(" > "), "source").alias("section_path"))


CHUNKS = """chunks AS (
  SELECT 'c' || lpad(CAST(d.doc_id AS VARCHAR), 10, '0') AS chunk_id, 'd' || lpad(CAST(d.doc_id AS VARCHAR), 10, '0') AS document_id, 'v1' AS version_id, d.text,
    d.lang || ' > ' || d.source AS section_path, 1 AS page_start, CAST(d.n_chars // 2000 + 1 AS INTEGER) AS page_end, d.source AS tenant_id,
    CASE d.doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'tenant' ELSE 'private' END AS visibility, [d.lang] AS library_scope_ids,
    coalesce(l.quality = 1 AND l.toxic = 0, false) AS is_active
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scopes a source: without selectors, one library, one folder only, two documents."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    none = F.array().cast("array<string>")
    one = lambda name, public, library, folder, documents: F.struct(F.lit(name).alias("variant"), F.lit(public).alias("include_public"), library.alias("library_ids"), folder.alias("folder_ids"), documents.alias("document_ids"))
    both = F.array(F.format_string("d%010d", "a"), F.format_string("d%010d", "b"))
    kinds = F.array(one("open", True, none, none, none), one("library", False, F.array(F.lit("en")), none, none), one("folder", True, none, F.array(F.lit("f1")), none), one("document", True, none, none, both))
    return d.select("source", F.explode(kinds).alias("k")).select(F.concat_ws(":", "source", "k.variant").alias("scope_id"), F.concat(F.lit("user-"), "source").alias("user_id"), F.col("source").alias("tenant_id"), "k.library_ids", "k.folder_ids", "k.document_ids", "k.include_public", F.lit("acl-v1").alias("acl_version"))


SCOPES = """scopes AS (
  SELECT source || ':' || variant AS scope_id, source AS tenant_id, include_public, library_ids, folder_ids, document_ids FROM (
    SELECT source, unnest([
      {'variant': 'open', 'include_public': true, 'library_ids': CAST([] AS VARCHAR[]), 'folder_ids': CAST([] AS VARCHAR[]), 'document_ids': CAST([] AS VARCHAR[])},
      {'variant': 'library', 'include_public': false, 'library_ids': ['en'], 'folder_ids': CAST([] AS VARCHAR[]), 'document_ids': CAST([] AS VARCHAR[])},
      {'variant': 'folder', 'include_public': true, 'library_ids': CAST([] AS VARCHAR[]), 'folder_ids': ['f1'], 'document_ids': CAST([] AS VARCHAR[])},
      {'variant': 'document', 'include_public': true, 'library_ids': CAST([] AS VARCHAR[]), 'folder_ids': CAST([] AS VARCHAR[]),
       'document_ids': ['d' || lpad(CAST(a AS VARCHAR), 10, '0'), 'd' || lpad(CAST(b AS VARCHAR), 10, '0')]}], recursive := true)
    FROM (SELECT source, min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY source)))"""

#: Whether chunk c is visible under scope s, as SQL.
SELECTED = "(list_contains(s.document_ids, c.document_id) OR len(list_intersect(s.library_ids, c.library_scope_ids)) > 0)"
UNSELECTIVE = "(len(s.document_ids) + len(s.library_ids) + len(s.folder_ids) = 0)"
VISIBLE = f"""(c.is_active AND length(c.text) > 0 AND CASE c.visibility WHEN 'public' THEN s.include_public AND ({UNSELECTIVE} OR {SELECTED})
  WHEN 'tenant' THEN c.tenant_id = s.tenant_id AND ({UNSELECTIVE} OR {SELECTED}) WHEN 'private' THEN c.tenant_id = s.tenant_id AND {SELECTED} ELSE false END)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: Question tokens, passage tokens and overlap scores as SQL.
OVERLAP = f"""{CHUNKS},
q AS (SELECT DISTINCT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM benchmark),
terms AS (SELECT * FROM q WHERE token NOT IN ({_STOP})),
held AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(section_path || ' ' || text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM chunks),
overlap AS (SELECT question_id, chunk_id, count(*) AS score FROM terms JOIN held USING (token) GROUP BY ALL)"""


def judgments(overlap: DataFrame, terms: DataFrame) -> DataFrame:
    """question_id, chunk_id, document_id, relevance 1 to 3: four times the share of the question's tokens that a chunk holds, rounded down."""
    return graded(overlap, terms).select("question_id", "chunk_id", F.concat(F.lit("d"), F.substring("chunk_id", 2, 10)).alias("document_id"), "relevance")


def graded(rows: DataFrame, terms: DataFrame, shared: str = "score") -> DataFrame:
    """Rows of question_id and a number of shared tokens with their relevance, of those that have one."""
    n = terms.groupBy("question_id").agg(F.count_distinct("token").alias("n_terms"))
    return rows.join(n, "question_id").withColumn("relevance", F.least(F.lit(3), F.floor(4 * F.col(shared) / F.col("n_terms"))).cast("int")).where("relevance >= 1").drop("n_terms")


JUDGMENTS = """n_terms AS (SELECT question_id, count(*) AS n_terms FROM terms GROUP BY question_id),
judgments AS (SELECT * FROM (SELECT question_id, chunk_id, 'd' || substr(chunk_id, 2, 10) AS document_id, CAST(least(3, floor(4 * score / n_terms)) AS INTEGER) AS relevance FROM overlap JOIN n_terms USING (question_id)) WHERE relevance >= 1)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with an answerability class, types and a split, in turn."""
    i = F.col("item_id")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(i, F.lit(n)) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(i.alias("question_id"), pick(5, "ANSWERABLE", "ANSWERABLE", "PARTIALLY_ANSWERABLE", "NO_EVIDENCE", "CONFLICTING_EVIDENCE").alias("answerability"), F.array(pick(2, "single", "comparison"), pick(3, "fact", "number", "method")).alias("question_types"), pick(4, "dev", "test", "dev", "acceptance").alias("split"))


ITEMS = """items AS (SELECT item_id AS question_id, ['ANSWERABLE', 'ANSWERABLE', 'PARTIALLY_ANSWERABLE', 'NO_EVIDENCE', 'CONFLICTING_EVIDENCE'][item_id % 5 + 1] AS answerability,
  [['single', 'comparison'][item_id % 2 + 1], ['fact', 'number', 'method'][item_id % 3 + 1]] AS question_types, ['dev', 'test', 'dev', 'acceptance'][item_id % 4 + 1] AS split FROM benchmark)"""


def version_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of a version's status, the user being the version."""
    e = table(spark, sf_dir, "events")
    from pyspark.sql.window import Window

    names = {"signup": "REGISTERED", "view": "PROCESSING", "click": "READY", "error": "FAILED"}
    status = F.lit("INACTIVE")
    for k, v in names.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    revision = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("version_id"), F.col("event_id").alias("sequence"), status.alias("status"), revision.cast("long").alias("revision"), F.col("ts").cast("timestamp").alias("ts"), "value")


EVENTS = """version_events AS (SELECT 'v' || CAST(user_id AS VARCHAR) AS version_id, event_id AS sequence,
  CASE event_type WHEN 'signup' THEN 'REGISTERED' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'READY' WHEN 'error' THEN 'FAILED' ELSE 'INACTIVE' END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision, ts, value FROM events)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "ENQUEUED").when(F.col("event_type").isin("view", "click"), "CLAIMED").when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED")
    job = F.concat(F.lit("j"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    return e.select(job.alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), "event_id")


JOBS = """job_events AS (SELECT 'j' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS job_id, ts, event_id,
  CASE WHEN event_type = 'signup' THEN 'ENQUEUED' WHEN event_type IN ('view', 'click') THEN 'CLAIMED' WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS kind FROM events)"""
