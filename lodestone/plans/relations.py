"""Chunking, joins, aggregations, ordering, set operations and lifecycle over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import scalars as S
from lodestone.functions import text as X
from lodestone.operators import checks, chunking, corpus, lifecycle, ordering, summaries
from lodestone.plans.frames import CHUNKS, EVENTS, JOBS, chunks, job_events, table, version_events
from lodestone.plans.registry import query, with_checkpoints
from lodestone.sources.readers import html_text

_WINDOWS = """win AS (SELECT doc_id, length(text) AS n, text, unnest(range(CAST(greatest(ceil((length(text) - 200) / 824), 1) AS BIGINT))) AS ordinal FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(ordinal * 824 AS INTEGER) AS source_start, CAST(least(ordinal * 824 + 1024, n) AS INTEGER) AS source_end, substr(text, ordinal * 824 + 1, 1024) AS text FROM win)"""


def _windows(spark, sf_dir):
    return chunking.windows(table(spark, sf_dir, "documents"))


@query(f"WITH {_WINDOWS} SELECT doc_id, ordinal, source_start, source_end, md5(text) AS digest FROM w")
def prj_chunk_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("doc_id", "ordinal", F.col("source_start").cast("int").alias("source_start"), F.col("source_end").cast("int").alias("source_end"), F.md5("text").alias("digest"))


def _named(spark, sf_dir):
    w = _windows(spark, sf_dir).withColumn("document_id", F.col("doc_id").cast("string"))
    return w.withColumn("chunk_id", chunking.chunk_id(F.col("document_id"), F.lit("v1"), F.lit("windows"), F.col("source_start").cast("int"), F.col("source_end").cast("int")))


_IDS = _WINDOWS + """, ids AS (SELECT *, CAST(doc_id AS VARCHAR) AS document_id, 'chunk_' || substr(sha256('{"document_id":"' || CAST(doc_id AS VARCHAR) || '","source_end":' || CAST(source_end AS VARCHAR) || ',"source_start":' || CAST(source_start AS VARCHAR) || ',"strategy":"windows","version_id":"v1"}'), 1, 24) AS chunk_id FROM w)"""


@query(f"WITH {_IDS} SELECT document_id, ordinal, chunk_id FROM ids")
def prj_chunk_ids(spark, sf_dir):
    return _named(spark, sf_dir).select("document_id", "ordinal", "chunk_id")


@query(f"WITH {_IDS} SELECT chunk_id, lag(chunk_id) OVER p AS previous_chunk_id, lead(chunk_id) OVER p AS next_chunk_id FROM ids WINDOW p AS (PARTITION BY document_id ORDER BY ordinal)")
def prj_neighbors(spark, sf_dir):
    return chunking.neighbours(_named(spark, sf_dir)).select("chunk_id", "previous_chunk_id", "next_chunk_id")


_LINES = """lines AS (SELECT doc_id, CAST(i AS INTEGER) AS page_number, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
pages_at AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM lines)"""


def _pages(spark, sf_dir):
    """Lines as pages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return chunking.page_offsets(d.select("doc_id", (F.col("p") + 1).alias("page_number"), "text"), "doc_id")


@query(f'WITH {_LINES} SELECT doc_id, page_number, CAST("offset" AS BIGINT) AS "offset" FROM pages_at')
def prj_page_offsets(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page_number", F.col("offset").cast("bigint").alias("offset"))


def _blocks(spark, sf_dir):
    p = _pages(spark, sf_dir).where(F.length("text") > 0)
    return p.select("doc_id", "page_number", F.col("offset").alias("source_start"), (F.col("offset") + F.length("text")).alias("source_end"), F.concat(F.lit("s"), F.floor((F.col("page_number") - 1) / 3).cast("string")).alias("section_path"))


_BLOCKS = f"""{_LINES}, blocks AS (SELECT doc_id, page_number, "offset" AS source_start, "offset" + length(text) AS source_end, 's' || CAST((page_number - 1) // 3 AS VARCHAR) AS section_path FROM pages_at WHERE length(text) > 0),
hits AS (SELECT w.doc_id, w.ordinal, b.* EXCLUDE (doc_id) FROM w JOIN blocks b ON w.doc_id = b.doc_id AND b.source_start < w.source_end AND b.source_end > w.source_start)"""


@query(f"WITH {_WINDOWS}, {_BLOCKS} SELECT doc_id, ordinal, count(*) AS n_blocks FROM hits GROUP BY ALL")
def jn_interval_overlap(spark, sf_dir):
    return chunking.overlapping_blocks(_windows(spark, sf_dir), _blocks(spark, sf_dir), "doc_id").groupBy("doc_id", "ordinal").agg(F.count(F.lit(1)).alias("n_blocks"))


@query(f"""WITH {_WINDOWS}, {_BLOCKS} SELECT doc_id, ordinal, min(page_number) AS page_start, max(page_number) AS page_end,
  CASE WHEN count(DISTINCT section_path) = 1 THEN min(section_path) ELSE arg_min(section_path, source_start) || ' -> ' || arg_max(section_path, source_start) END AS section FROM hits GROUP BY ALL""")
def prj_chunk_pages(spark, sf_dir):
    w = _windows(spark, sf_dir).withColumn("chunk_id", F.struct("doc_id", "ordinal"))
    return chunking.page_ranges(w, _blocks(spark, sf_dir), "doc_id").select("chunk_id.doc_id", "chunk_id.ordinal", "page_start", "page_end", "section")


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(parts) AS n_pages, CAST(len(list_filter(parts, lambda x: trim(x, ' ') = '')) AS BIGINT) AS n_empty, list_sum(list_transform(parts, lambda x: length(x))) AS chars, list_sum(list_transform(parts, lambda x: octet_length(encode(x)) + 2)) - 2 AS bytes FROM p)
SELECT doc_id, n_pages, n_empty, CASE WHEN n_empty = n_pages THEN 'FAILED' WHEN n_empty > 0 OR chars < 80 THEN 'REVIEW' ELSE 'PASS' END AS status,
  CASE WHEN n_empty = n_pages THEN 'NO_EXTRACTABLE_TEXT' WHEN n_empty > 0 THEN 'EMPTY_TEXT_PAGE_DETECTED' WHEN chars < 80 THEN 'EXTRACTED_TEXT_TOO_SHORT' END AS warning,
  CASE WHEN n_pages > 2000 THEN 'PAGE_LIMIT_EXCEEDED' WHEN bytes > 5242880 THEN 'CLEAN_TEXT_TOO_LARGE' END AS error FROM n""")
def prj_parse_status(spark, sf_dir):
    return chunking.parse_status(_pages(spark, sf_dir), "doc_id")


def _chunked(spark, sf_dir, strategy):
    c = chunking.chunked(table(spark, sf_dir, "documents"), strategy, "doc_id")
    return c.select("document_id", "ordinal", "source_start", "source_end", "section", "parent", F.md5("text").alias("digest"))


@query()
def prj_chunk_boundary(spark, sf_dir):
    return _chunked(spark, sf_dir, chunking.STRATEGIES[0])


@query()
def prj_chunk_paragraph(spark, sf_dir):
    return _chunked(spark, sf_dir, chunking.STRATEGIES[1])


@query()
def prj_chunk_section(spark, sf_dir):
    return _chunked(spark, sf_dir, chunking.STRATEGIES[2])


_VISIBLE = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_entity}', '{_sign}')"


@query(f"""WITH l AS (SELECT page_id, html, list_transform(string_split(regexp_replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\\t ]+', ' ', 'g'), ' ')) AS lines FROM pages)
SELECT page_id, md5(array_to_string(list_filter(lines, lambda x: x <> ''), chr(10))) AS page_digest, CAST(length(trim(regexp_replace({_VISIBLE}, '[\\s\\x0b]+', ' ', 'g'), ' ')) AS INTEGER) AS n_visible FROM l""")
def prj_page_text(spark, sf_dir):
    """Pages with blanks of other kinds around them and in a line of their own, which change nothing."""
    p = table(spark, sf_dir, "pages")
    around = F.concat(F.lit("\u3000\u00a0"), "html", F.lit("\u2003\n\u00a0\u3000\n\u2028"))
    return p.select("page_id", F.md5(X.page_text(around)).alias("page_digest"), F.length(html_text(F.col("html"))).alias("n_visible"))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey AS d, l_quantity > 20 AS h, 1 + (l_orderkey + 3 * l_linenumber) % 9 AS lv, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
w AS (SELECT d, n, i, CASE WHEN NOT h THEN ['Document'] WHEN lv = 1 THEN ['h' || n] ELSE ['Document', 'h' || n] END AS p FROM o WHERE i = 1
  UNION ALL SELECT o.d, o.n, o.i, CASE WHEN NOT h THEN w.p WHEN lv = 1 THEN ['h' || o.n] ELSE list_slice(w.p, 1, CAST(lv - 1 AS BIGINT)) || ['h' || o.n] END FROM w JOIN o ON o.d = w.d AND o.i = w.i + 1)
SELECT d AS document_id, n AS source_start, array_to_string(p, ' > ') AS section_path FROM w""")
def prj_section_paths(spark, sf_dir):
    """Lines of orders as blocks, some of them headings of levels 1 to 9 that skip levels."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("source_start")).agg(F.max("l_quantity").alias("q"))
    level = (1 + (F.col("document_id") + 3 * F.col("source_start")) % 9).cast("int")
    b = rows.select("document_id", "source_start", (F.col("q") > 20).alias("is_heading"), level.alias("level"), F.concat(F.lit("h"), F.col("source_start").cast("string")).alias("text"))
    return chunking.section_paths(b).select("document_id", "source_start", "section_path")


_SPLIT = "c AS (SELECT c_custkey AS document_id, CAST(c_custkey % {} AS BIGINT) AS n FROM customer)"


def _made(spark, sf_dir, most, part, between):
    """Customers as documents of so many equal parts."""
    n = (F.col("c_custkey") % most).cast("int")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n, part(i))), between).alias("text"))


def _cut(docs, strategy):
    c = chunking.chunked(docs, strategy)
    return c.select(F.col("document_id").cast("long").alias("document_id"), "ordinal", "source_start", "source_end", "section", "parent", F.length("text").alias("n"))


_SPAN = "CAST(k AS INTEGER) AS ordinal, CAST(a AS INTEGER) AS source_start, CAST(b AS INTEGER) AS source_end"


@query(f"WITH {_SPLIT.format(40)}, k AS (SELECT document_id, n, unnest(range(1 + greatest(0, CAST(ceil((n - 10) / 8) AS BIGINT)))) AS k FROM c WHERE n > 0), s AS (SELECT *, 800 * k AS a, least(800 * k + 999, 100 * n - 1) AS b FROM k) SELECT document_id, {_SPAN}, NULL::VARCHAR AS section, NULL::VARCHAR AS parent, CAST(b - a AS INTEGER) AS n FROM s")
def prj_chunk_boundary_made(spark, sf_dir):
    """Sentences of 99 characters: ten fill a chunk, two are shared with the next."""
    return _cut(_made(spark, sf_dir, 40, lambda i: F.lit("S" + "x" * 97 + "."), " "), chunking.STRATEGIES[0])


@query(f"WITH {_SPLIT.format(13)}, k AS (SELECT document_id, n, unnest(range(1 + greatest(0, CAST(ceil((n - 3) / 2) AS BIGINT)))) AS k FROM c WHERE n > 0), s AS (SELECT *, 604 * k AS a, CASE WHEN 2 * k + 3 >= n THEN 302 * n - 2 ELSE 302 * (2 * k + 3) END AS b FROM k) SELECT document_id, {_SPAN}, NULL::VARCHAR AS section, NULL::VARCHAR AS parent, CAST(b - a AS INTEGER) AS n FROM s")
def prj_chunk_paragraph_made(spark, sf_dir):
    """Paragraphs of 300 characters: three come nearest to the target, one is shared."""
    return _cut(_made(spark, sf_dir, 13, lambda i: F.lit("p" + "x" * 298 + "."), "\n\n"), chunking.STRATEGIES[1])


@query(f"WITH {_SPLIT.format(9)}, k AS (SELECT document_id, n, unnest(range(n)) AS k FROM c WHERE n > 0), s AS (SELECT *, 309 * k AS a, CASE WHEN k = n - 1 THEN 309 * n - 1 ELSE 309 * (k + 1) END AS b FROM k) SELECT document_id, {_SPAN}, CAST(k + 1 AS VARCHAR) || '. Part' AS section, 'parent-00' || CAST(k + 1 AS VARCHAR) AS parent, CAST(b - a AS INTEGER) AS n FROM s")
def prj_chunk_section_made(spark, sf_dir):
    """Numbered sections with one paragraph each: a chunk a section, whose section is its parent."""
    return _cut(_made(spark, sf_dir, 9, lambda i: F.concat((i + 1).cast("string"), F.lit(". Part\n" + "x" * 300)), "\n"), chunking.STRATEGIES[2])


@query(f"WITH {CHUNKS} SELECT chunk_id FROM chunks c WHERE EXISTS (SELECT 1 FROM labels l WHERE l.quality = 1 AND 'c' || lpad(CAST(l.doc_id AS VARCHAR), 10, '0') = c.chunk_id)")
def jn_semi_ready(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.format_string("c%010d", "doc_id").alias("chunk_id"))
    return chunks(spark, sf_dir).join(good, "chunk_id", "left_semi").select("chunk_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn_anti_missing(spark, sf_dir):
    return lifecycle.missing_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def jn_composite_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return checks.duplicate_keys(o, ["o_custkey", "y"])


@query("SELECT n.n_name, r.r_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL")
def jn_star_lookup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


_SPANS = "s AS (SELECT doc_id, lang, CAST(doc_id % 50 AS INTEGER) AS page_start, CAST(doc_id % 50 + n_chars // 2000 AS INTEGER) AS page_end FROM documents), acc AS (SELECT lang, page_start, page_end FROM s WHERE doc_id % 10 = 0)"


@query(f"WITH {_SPANS} SELECT doc_id FROM s WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.lang = s.lang AND acc.page_start <= s.page_start AND acc.page_end >= s.page_end)")
def jn_range_containment(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    start = (F.col("doc_id") % 50).cast("int")
    s = d.select("doc_id", "lang", start.alias("page_start"), (start + F.floor(F.col("n_chars") / 2000)).cast("int").alias("page_end"))
    return checks.contained_ranges(s, s.where("doc_id % 10 = 0"), "lang").select("doc_id")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def agg_status_counts(spark, sf_dir):
    return summaries.status_counts(table(spark, sf_dir, "documents"), ["source", "lang"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.95), 6) AS nearest_p95 FROM events GROUP BY event_type")
def agg_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(summaries.interpolated_percentile("value", 0.5), 6).alias("p50"), F.round(summaries.interpolated_percentile("value", 0.95), 6).alias("p95"), F.round(summaries.nearest_rank_percentile("value", 0.95), 6).alias("nearest_p95"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY event_type")
def agg_percentiles_refined(spark, sf_dir):
    """Exact percentiles by refined counts, whatever a group's size."""
    with_checkpoints(spark)
    got = ordering.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p999": 0.999})
    return got.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p999")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place FROM lineitem")
def win_global_number(spark, sf_dir):
    """Every line's place among all lines, without a task that holds them all."""
    with_checkpoints(spark)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ordering.numbered(rows, rows.columns, "place").select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("SELECT source, count(*) AS n, min(length(text)) AS min_chars, quantile_cont(length(text), 0.5) AS median_chars, round(avg(length(text)), 6) AS mean_chars, quantile_disc(length(text), 0.95) AS p95_chars, max(length(text)) AS max_chars FROM documents GROUP BY source")
def agg_chunk_lengths(spark, sf_dir):
    return summaries.length_summary(table(spark, sf_dir, "documents"), ["source"])


@query("""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(conv_id AS VARCHAR) || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS chunk_id, turn, role, sha256(text) AS h FROM conversations)
SELECT document_id, count(*) AS n_chunks, min(turn) AS page_start, max(turn) AS page_end, array_to_string(list_sort(list(DISTINCT role)), ',') AS versions, sha256(string_agg(chunk_id || ':' || h, chr(10) ORDER BY chunk_id, h)) AS digest FROM c GROUP BY document_id""")
def agg_document_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("document_id"), F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("chunk_id"), F.col("turn").alias("page_start"), F.col("turn").alias("page_end"), F.col("role").alias("version_id"), "text")
    return summaries.document_summary(rows)


@query("WITH c AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS category) SELECT category, count(d.doc_id) AS total, count(*) FILTER (d.n_chars > 2000) AS passed FROM c LEFT JOIN documents d ON d.lang = c.category GROUP BY category")
def agg_category_summary(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), (F.col("n_chars") > 2000).alias("passed"))
    return summaries.category_summary(cases, spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "category string"))


@query("SELECT role AS value, count(*) AS n FROM conversations GROUP BY role")
def agg_distribution(spark, sf_dir):
    return summaries.distribution(table(spark, sf_dir, "conversations"), "role")


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(url, '/')) AS value FROM pages) GROUP BY value")
def agg_distribution_multi(spark, sf_dir):
    return summaries.distribution(table(spark, sf_dir, "pages").withColumn("parts", F.split("url", "/")), "parts", many=True)


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def agg_rank_concat(spark, sf_dir):
    return summaries.rank_concat(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("SELECT key, CAST(sum(v) AS BIGINT) AS total FROM (SELECT 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events UNION ALL SELECT 'n', 1 FROM events) GROUP BY key")
def agg_usage_totals(spark, sf_dir):
    used = F.map_concat(F.from_json("props", "map<string,bigint>"), F.create_map(F.lit("n"), F.lit(1).cast("bigint")))
    return summaries.usage_totals(table(spark, sf_dir, "events").withColumn("usage", used), "usage")


@query("SELECT event_type, last_value, first_value FROM (SELECT event_type, arg_max(value, event_id) AS last_value, arg_min(value, event_id) AS first_value FROM events GROUP BY event_type)")
def agg_first_last(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("value", "event_id").alias("last_value"), F.min_by("value", "event_id").alias("first_value"))


@query("SELECT doc_id, CASE WHEN quality IS NOT NULL AND doc_id % 2 = 0 THEN 'repair' ELSE 'raw' END AS file FROM documents d LEFT JOIN labels l USING (doc_id)")
def agg_last_wins(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.lit("raw").alias("file"))
    repair = table(spark, sf_dir, "labels").where("doc_id % 2 = 0").select("doc_id", F.lit("repair").alias("file"))
    return summaries.last_wins([raw, repair], "doc_id")


_LAST = f"{EVENTS}, last AS (SELECT version_id, arg_max(status, sequence) AS status, max(revision) AS revision, count(*) AS n_events FROM version_events GROUP BY version_id)"


@query(f"WITH {_LAST}, {JOBS}, j AS (SELECT job_id, count(*) FILTER (kind = 'COMPLETED') > 0 AS done FROM job_events GROUP BY job_id) SELECT (SELECT count(*) FROM last WHERE status = 'READY') AS n_active, (SELECT count(*) FROM last WHERE status <> 'INACTIVE') AS n_not_inactive, (SELECT count(*) FROM j WHERE NOT done) AS n_unfinished, 'RESIDUAL' AS decision")
def agg_residual_audit(spark, sf_dir):
    v = lifecycle.latest_state(version_events(spark, sf_dir)).withColumn("is_active", F.col("status") == "READY")
    j = job_events(spark, sf_dir).groupBy("job_id").agg(F.when(F.count_if(F.col("kind") == "COMPLETED") > 0, "SUCCEEDED").otherwise("PENDING").alias("status"))
    return lifecycle.audit(j, v)


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY rank <= 5")
def win_topk_total_order(spark, sf_dir):
    from lodestone.operators.lexical import top_k

    return top_k(table(spark, sf_dir, "events"), 5, ["user_id"], "value", "event_id").select("event_id", "user_id", "rank")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts), ts, event_id) AS n FROM events WHERE event_type IN ('signup', 'view') AND date_trunc('day', ts) <= TIMESTAMP '2024-01-20 00:00:00') WHERE n = 1")
def win_due_job(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'view')")
    jobs = e.select("user_id", F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "signup", "PENDING").otherwise("RETRY").alias("status"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("next_attempt_at"), F.col("ts").alias("created_at"))
    return lifecycle.due_jobs(jobs, F.to_timestamp(F.lit("2024-01-20 00:00:00")), ["user_id"]).select("user_id", F.col("job_id").alias("event_id"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('seed:' || lang || ':' || CAST(doc_id AS VARCHAR))) AS INTEGER) AS place FROM documents")
def win_hash_order(spark, sf_dir):
    key = S.stable_key("seed", F.col("lang"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(key)).alias("place"))


@query("""WITH u AS (SELECT n_nationkey AS u, n_nationkey % 4 AS t, coalesce(sum(n_nationkey % 4) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM nation),
p AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS i, count(*) OVER () AS n FROM region), w AS (SELECT u, unnest(range(CAST(t AS BIGINT))) AS k, b FROM u WHERE t > 0) SELECT CAST(u AS INTEGER) AS n_nationkey, r_name FROM w JOIN p ON p.i = (w.b + w.k) % p.n""")
def win_round_robin(spark, sf_dir):
    with_checkpoints(spark)
    units = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), (F.col("n_nationkey") % 4).cast("int").alias("takes"))
    return corpus.dealt_round_robin(units, table(spark, sf_dir, "region"), "n_nationkey", "takes", "r_name")


@query("SELECT item_id, CAST((row_number() OVER (ORDER BY item_id) - 1) // 10 AS BIGINT) AS batch FROM benchmark")
def win_batches(spark, sf_dir):
    with_checkpoints(spark)
    return corpus.batches(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", F.col("batch").cast("bigint").alias("batch"))


@query("SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_insert_absent(spark, sf_dir):
    stored = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("origin"))
    return lifecycle.insert_absent(stored, table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("origin")), ["doc_id"])


@query("SELECT c_custkey, greatest(c_nationkey, coalesce(m, c_nationkey)) AS updated FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderkey % 100) AS INTEGER) AS m FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def set_upsert_newest(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("updated"))
    got = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 100).cast("int").alias("updated"))
    return lifecycle.upsert(stored, got.join(stored, "c_custkey", "left_semi"), ["c_custkey"], {"updated": "max"})


@query("SELECT side, n FROM (SELECT 'EXPECTED_ONLY' AS side, count(*) AS n FROM (SELECT user_id, event_type FROM events EXCEPT ALL SELECT user_id, 'view' FROM events) UNION ALL SELECT 'STORED_ONLY', count(*) FROM (SELECT user_id, 'view' FROM events EXCEPT ALL SELECT user_id, event_type FROM events))")
def set_drift(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return lifecycle.drift(e.select("user_id", "event_type"), e.select("user_id", F.lit("view").alias("event_type"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'de' UNION SELECT doc_id FROM labels WHERE quality = 0")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id").union(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars > 100000) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def set_purged(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    left = lifecycle.purged(d, d.where("n_chars > 100000"), ["source"])
    return lifecycle.purged(left, table(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"]).select("doc_id")


@query(r"""SELECT conv_id, turn, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), ['the', 'of', 'de', 'la', 'und'])) AS INTEGER) AS shared,
  len(list_filter(['the', 'of'], lambda w: NOT list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), w))) = 0 AS subset FROM conversations""")
def set_token_overlap(spark, sf_dir):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    t = X.tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.array_intersect(t, words("the", "of", "de", "la", "und"))).alias("shared"), (F.size(F.array_except(words("the", "of"), t)) == 0).alias("subset"))


_ALLOWED = ", ".join(f"'{a}>{b}'" for a, b in lifecycle.TRANSITIONS)


@query(f"""WITH {EVENTS}, e AS (SELECT *, lag(status) OVER (PARTITION BY version_id ORDER BY sequence) AS before FROM version_events)
SELECT version_id, sequence, CASE WHEN before IS NULL AND status <> 'REGISTERED' THEN 'NOT_REGISTERED' WHEN before IS NOT NULL AND before || '>' || status NOT IN ({_ALLOWED}) THEN 'TRANSITION_FORBIDDEN' END AS code FROM e
WHERE before IS NULL AND status <> 'REGISTERED' OR before IS NOT NULL AND before || '>' || status NOT IN ({_ALLOWED})""")
def lif_transition_check(spark, sf_dir):
    return lifecycle.transition_errors(version_events(spark, sf_dir))


@query(f"WITH {_LAST} SELECT version_id, status, revision, n_events FROM last")
def lif_latest_state(spark, sf_dir):
    return lifecycle.latest_state(version_events(spark, sf_dir))


@query(f"""WITH {JOBS}, f AS (SELECT job_id, count(*) FILTER (kind = 'CLAIMED') AS attempts, bool_or(kind = 'COMPLETED') AS done, arg_max(kind, (ts, kind)) AS last_kind, max(ts) AS last_ts FROM job_events GROUP BY job_id),
s AS (SELECT *, CASE WHEN done THEN 'SUCCEEDED' WHEN last_kind = 'FAILED' AND attempts >= 5 THEN 'FAILED' WHEN last_kind = 'FAILED' THEN 'RETRY' WHEN last_kind = 'CLAIMED' THEN 'RUNNING' ELSE 'PENDING' END AS status FROM f)
SELECT job_id, attempts, status, CAST(CASE WHEN status = 'RETRY' THEN epoch_us(last_ts) // 1000000 + CAST(least(30.0 * pow(2.0, attempts - 1), 3600.0) AS BIGINT) WHEN status = 'PENDING' THEN epoch_us(last_ts) // 1000000 END AS BIGINT) AS due FROM s""")
def lif_queue_fold(spark, sf_dir):
    """Failures before any claim wait half the base time, as the attempts are none."""
    q = lifecycle.queue_state(job_events(spark, sf_dir))
    return q.select("job_id", "attempts", "status", F.floor(F.unix_micros("next_attempt_at") / 1000000).cast("bigint").alias("due"))


@query(f"""WITH {CHUNKS}, r AS (SELECT DISTINCT document_id FROM chunks WHERE visibility = 'public'), y AS (SELECT DISTINCT document_id FROM chunks WHERE is_active), a AS (SELECT document_id FROM chunks WHERE tenant_id <> 'src1'), b AS (SELECT document_id FROM chunks WHERE page_end > 1)
SELECT document_id, r.document_id IS NOT NULL AS requested, y.document_id IS NOT NULL AS ready, a.document_id IS NOT NULL AS lexical, b.document_id IS NOT NULL AS dense,
  r.document_id IS NOT NULL AND y.document_id IS NOT NULL AND a.document_id IS NOT NULL AND b.document_id IS NOT NULL AS consistent
FROM (SELECT document_id FROM r UNION SELECT document_id FROM y UNION SELECT document_id FROM a UNION SELECT document_id FROM b) u LEFT JOIN r USING (document_id) LEFT JOIN y USING (document_id) LEFT JOIN a USING (document_id) LEFT JOIN b USING (document_id)""")
def lif_reconcile(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return lifecycle.reconcile(c.where("visibility = 'public'"), c.where("is_active"), {"lexical": c.where("tenant_id <> 'src1'"), "dense": c.where("page_end > 1")})


_INACTIVE = f"{_LAST}, inactive AS (SELECT version_id FROM last WHERE status = 'INACTIVE'), jobs AS (SELECT version_id, unnest(['elasticsearch', 'milvus', 'postgresql']) AS backend FROM inactive)"


def _inactive(spark, sf_dir):
    v = lifecycle.latest_state(version_events(spark, sf_dir)).where("status = 'INACTIVE'")
    return v.select(F.lit("owner").alias("owner_id"), F.col("version_id").alias("document_id"), "version_id")


@query(f"WITH {_INACTIVE} SELECT version_id, backend, 'PENDING' AS status, 0 AS attempts FROM jobs")
def lif_cleanup_fanout(spark, sf_dir):
    return lifecycle.cleanup_jobs(_inactive(spark, sf_dir)).select("version_id", "backend", "status", "attempts")


@query(f"WITH {_INACTIVE} SELECT version_id, backend, 'EXPECTED_ONLY' AS side FROM jobs WHERE backend = 'milvus' UNION ALL SELECT 'foreign', 'milvus', 'STORED_ONLY'")
def lif_scope_proof(spark, sf_dir):
    v = _inactive(spark, sf_dir)
    jobs = lifecycle.cleanup_jobs(v).where("backend <> 'milvus'").select("version_id", "backend").union(spark.createDataFrame([("foreign", "milvus")], "version_id string, backend string"))
    return lifecycle.scope_proof(v, jobs)


@query(f"WITH {_INACTIVE} SELECT (SELECT count(*) FROM inactive) >= 0 AS before, (SELECT count(*) FROM jobs) = 0 AS after")
def lif_recovery_checks(spark, sf_dir):
    v = _inactive(spark, sf_dir)
    return lifecycle.recovery_checks(v.withColumn("status", F.lit("INACTIVE")), lifecycle.cleanup_jobs(v), v.where("false"))


@query("SELECT event_id, CASE WHEN event_type = 'click' AND value < 10 THEN CASE WHEN user_id % 3 = 0 THEN 'FAILED' ELSE 'RETRY' END WHEN event_type = 'click' THEN 'RUNNING' ELSE 'PENDING' END AS status FROM events")
def lif_lease_recovery(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    jobs = e.select("event_id", F.when(F.col("event_type") == "click", "RUNNING").otherwise("PENDING").alias("status"), F.when(F.col("value") < 10, now).otherwise(S.plus_seconds(now, F.lit(300.0))).alias("lease_expires_at"), F.when(F.col("user_id") % 3 == 0, 5).otherwise(1).alias("attempts"), F.lit(5).alias("max_attempts"))
    return lifecycle.recovered(jobs, now).select("event_id", "status")


@query(f"WITH {_IDS} SELECT count(*) AS n FROM ids WHERE false")
def chk_links_and_slices(spark, sf_dir):
    """Neighbour links answer each other and chunk texts are slices of their documents: no violation."""
    w = chunking.neighbours(_named(spark, sf_dir))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    bad = checks.link_errors(w).select("chunk_id").union(chunking.slice_errors(w, d).select("chunk_id"))
    return bad.agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS} SELECT version_id, sequence, status, revision, CASE WHEN before IS NULL AND status <> 'REGISTERED' THEN 'NOT_REGISTERED' WHEN before IS NOT NULL AND before || '>' || status NOT IN ({_ALLOWED}) THEN 'TRANSITION_FORBIDDEN' END AS code FROM (SELECT *, lag(status) OVER (PARTITION BY version_id ORDER BY sequence) AS before FROM version_events)")
def lif_stream_state(spark, sf_dir):
    """The state machine as a stream over files, run to the end of what is there."""
    import uuid

    from lodestone.streaming.states import drain_to, version_states

    with_checkpoints(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    events = version_events(spark, sf_dir).select("version_id", "sequence", "status", "revision")
    events.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{at}/in")
    return drain_to(version_states(stream), f"{at}/out", f"{at}/checkpoint")
