"""Access, lexical and dense retrieval, fusion and answers over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import access, answers, blockmax, cells, dense, fusion, lexical
from lodestone.plans.frames import CHUNKS, EVENTS, OVERLAP, SCOPES, SELECTED, UNSELECTIVE, VISIBLE, chunks, passages, questions, scopes, table, version_events
from lodestone.plans.registry import query, stored, with_checkpoints


@query(f"WITH {CHUNKS}, {SCOPES} SELECT s.scope_id, c.visibility, count(*) AS n FROM chunks c, scopes s WHERE {VISIBLE} GROUP BY ALL")
def flt_acl_authorized(spark, sf_dir):
    return access.granted(chunks(spark, sf_dir), scopes(spark, sf_dir)).groupBy("scope_id", "visibility").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS}, {SCOPES} SELECT s.scope_id, CAST(sum(CASE WHEN {SELECTED} THEN 1 ELSE 0 END) AS BIGINT) AS n_selected, bool_or(NOT {UNSELECTIVE}) AS selective FROM chunks c, scopes s GROUP BY ALL")
def flt_selected(spark, sf_dir):
    return access.selected_counts(chunks(spark, sf_dir), scopes(spark, sf_dir))


@query(f"""WITH {CHUNKS}, {SCOPES}, odd AS (SELECT s.*, CASE WHEN scope_id LIKE 'src1%' THEN ['en', ''] ELSE library_ids END AS listed FROM scopes s)
SELECT scope_id, count(*) AS n FROM chunks c, odd s WHERE scope_id NOT LIKE 'src1%' AND {VISIBLE} GROUP BY scope_id""")
def flt_acl_strict(spark, sf_dir):
    """Scopes with an unusable member of a list see nothing in the strict form."""
    s = scopes(spark, sf_dir)
    odd = s.withColumn("library_ids", F.when(F.col("scope_id").startswith("src1"), F.array(F.lit("en"), F.lit(""))).otherwise(F.col("library_ids")))
    return access.granted(chunks(spark, sf_dir), odd, strict=True).groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS}, {SCOPES} SELECT s.scope_id, count(*) AS n FROM chunks c, scopes s WHERE {VISIBLE} AND s.scope_id LIKE 'src2%' GROUP BY ALL")
def flt_acl_expression(spark, sf_dir):
    """The boolean expression itself, for the few scopes of some sources, beside every chunk."""
    c, s = chunks(spark, sf_dir), scopes(spark, sf_dir).where("scope_id like 'src2%'")
    pairs = c.select(F.struct(*c.columns).alias("chunk")).join(s.select("scope_id", F.struct(*[x for x in s.columns if x != "scope_id"]).alias("scope")), access.authorized())
    return pairs.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"))


_REQUESTS = "requests AS (SELECT source || ':open' AS scope_id, min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY source)"


def _requests(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.concat("source", F.lit(":open")).alias("scope_id")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return d.select("scope_id", F.array(F.format_string("d%010d", "a"), F.format_string("d%010d", "b")).alias("requested_document_ids"))


@query(f"WITH {SCOPES}, {_REQUESTS} SELECT s.scope_id, CASE WHEN r.a IS NULL THEN array_to_string(s.document_ids, ',') ELSE 'd' || lpad(CAST(r.a AS VARCHAR), 10, '0') || ',' || 'd' || lpad(CAST(r.b AS VARCHAR), 10, '0') END AS documents, CASE WHEN r.a IS NULL THEN array_to_string(s.library_ids, ',') ELSE '' END AS libraries FROM scopes s LEFT JOIN requests r USING (scope_id)")
def flt_scope_narrow(spark, sf_dir):
    df = access.narrowed(scopes(spark, sf_dir).join(_requests(spark, sf_dir), "scope_id", "left"))
    return df.select("scope_id", F.array_join("document_ids", ",").alias("documents"), F.array_join("library_ids", ",").alias("libraries"))


@query(f"""WITH {CHUNKS}, {SCOPES}, {_REQUESTS},
asked AS (SELECT scope_id, 'd' || lpad(CAST(unnest([a, b]) AS VARCHAR), 10, '0') AS document_id FROM requests),
granted AS (SELECT s.scope_id, c.document_id FROM chunks c, scopes s WHERE {VISIBLE})
SELECT scope_id, count(DISTINCT document_id) AS n_forbidden FROM asked a WHERE NOT EXISTS (SELECT 1 FROM granted g WHERE g.scope_id = a.scope_id AND g.document_id = a.document_id) GROUP BY scope_id""")
def flt_forbidden_scope(spark, sf_dir):
    asked = _requests(spark, sf_dir).select("scope_id", F.explode("requested_document_ids").alias("document_id"))
    few = chunks(spark, sf_dir).join(asked.select("document_id").distinct(), "document_id", "left_semi")  # only what is asked for can be granted
    granted = access.granted(few, scopes(spark, sf_dir).join(asked.select("scope_id").distinct(), "scope_id", "left_semi"))
    return access.forbidden_requests(asked, granted.select("scope_id", "document_id"), ["scope_id"])


@query(f"WITH {EVENTS}, last AS (SELECT version_id, arg_max(status, sequence) AS status FROM version_events GROUP BY version_id) SELECT version_id FROM last WHERE status = 'READY'")
def flt_visible_versions(spark, sf_dir):
    last = version_events(spark, sf_dir).groupBy("version_id").agg(F.max_by("status", "sequence").alias("lifecycle_status"))
    return access.visible_versions(last.withColumn("is_active", F.col("lifecycle_status") == "READY")).select("version_id")


def _overlap(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return lexical.overlap_scores(questions(spark, sf_dir), c, F.concat_ws(" ", "section_path", "text"))


@query(f"WITH {OVERLAP}, r AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM overlap JOIN chunks USING (chunk_id) WHERE is_active) SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def lex_overlap_topk(spark, sf_dir):
    """Token overlap of every question with every active chunk, three best."""
    live = chunks(spark, sf_dir).where("is_active")
    return lexical.top_k(lexical.overlap_scores(questions(spark, sf_dir), live, F.concat_ws(" ", "section_path", "text")), 3, ["question_id"])


_POSTINGS = f"""{OVERLAP},
tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token, 1 AS body, 0 AS section FROM chunks
  UNION ALL SELECT chunk_id, unnest(regexp_extract_all(lower(section_path), '[\\p{{L}}\\p{{N}}]+')), 0, 1 FROM chunks),
postings AS (SELECT token, chunk_id, sum(body) AS tf_body, sum(section) AS tf_section FROM tok GROUP BY ALL),
lens AS (SELECT chunk_id, count(*) AS length FROM tok GROUP BY chunk_id),
dfs AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
corpus AS (SELECT count(*) AS n_chunks, avg(length) AS mean_length FROM lens),
full_terms AS (SELECT * FROM q WHERE token NOT IN ({", ".join(f"'{w}'" for w in X.QUERY_STOP_WORDS)})),
bm25 AS (SELECT question_id, chunk_id, round(sum(ln((n_chunks - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score
  FROM (SELECT p.*, CAST(1.0 AS DOUBLE) * tf_body + CAST(2.0 AS DOUBLE) * tf_section AS tf FROM postings p) p JOIN full_terms USING (token) JOIN dfs USING (token) JOIN lens USING (chunk_id), corpus GROUP BY ALL)"""


def _fields():
    return {"body": F.col("text"), "section": F.col("section_path")}


_WEIGHTS = {"body": 1.0, "section": 2.0}


def held_batch(spark, sf_dir):
    """The chunks' terms that any question asks for, written to shared storage, and all questions' terms."""
    return lexical.batch(questions(spark, sf_dir), passages(spark, sf_dir), _fields(), _WEIGHTS, stored)


@query(f"WITH {_POSTINGS} SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 10")
def lex_bm25_topk(spark, sf_dir):
    return held_batch(spark, sf_dir).bm25_best(10)


@query(f"WITH {_POSTINGS} SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 10")
def lex_bm25_index(spark, sf_dir):
    """The same over a stored index."""
    with_checkpoints(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"
    blockmax.write(chunks(spark, sf_dir), _fields(), _WEIGHTS, at, "documents")
    return blockmax.open_index(spark, at, "documents").top_k(questions(spark, sf_dir), 10)


@query(f"WITH {_POSTINGS}, scored AS (SELECT question_id, chunk_id, score FROM bm25 JOIN chunks c USING (chunk_id) WHERE is_active AND visibility = 'public') SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5")
def lex_bm25_authorized(spark, sf_dir):
    """Corpus statistics from all chunks, access applied after scoring and before the cut."""
    c = chunks(spark, sf_dir).where("is_active and visibility = 'public'").select("chunk_id")
    return held_batch(spark, sf_dir).bm25_best(5, c)


@query(f"WITH {_POSTINGS} SELECT token, chunk_id, CAST(length AS INTEGER) AS length, CAST(tf_body AS BIGINT) AS tf_body, CAST(tf_section AS BIGINT) AS tf_section FROM postings JOIN lens USING (chunk_id)")
def lex_postings(spark, sf_dir):
    return lexical.postings(chunks(spark, sf_dir), _fields()).select("token", "chunk_id", F.col("length").cast("int").alias("length"), "tf_body", "tf_section")


@query(f"WITH {_POSTINGS} SELECT token, df FROM dfs")
def lex_df_stats(spark, sf_dir):
    return lexical.corpus_statistics(lexical.postings(chunks(spark, sf_dir), _fields()))[0]


def _one_field(name: str, column: str) -> str:
    return f"""{name}_p AS (SELECT token, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+')) AS token FROM chunks) GROUP BY ALL),
{name}_l AS (SELECT chunk_id, sum(tf) AS length FROM {name}_p GROUP BY chunk_id), {name}_d AS (SELECT token, count(*) AS df FROM {name}_p GROUP BY token),
{name}_c AS (SELECT count(*) AS n_chunks, avg(length) AS mean_length FROM {name}_l),
{name}_s AS (SELECT question_id, chunk_id, round(sum(ln((n_chunks - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score
  FROM {name}_p JOIN full_terms USING (token) JOIN {name}_d USING (token) JOIN {name}_l USING (chunk_id), {name}_c GROUP BY ALL)"""


@query(f"""WITH {_POSTINGS}, {_one_field("b", "text")}, {_one_field("s", "section_path")},
best AS (SELECT question_id, chunk_id, round(max(score), 6) AS score FROM (SELECT * FROM b_s UNION ALL SELECT question_id, chunk_id, score * 2 FROM s_s) GROUP BY ALL)
SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM best) WHERE rank <= 5""")
def lex_best_field(spark, sf_dir):
    return lexical.top_k(lexical.best_field_scores(questions(spark, sf_dir), chunks(spark, sf_dir), _fields(), {"body": 1.0, "section": 2.0}), 5, ["question_id"])


@query(f"""WITH q AS (SELECT item_id AS question_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')), lambda t: t NOT IN ({", ".join(f"'{w}'" for w in X.QUERY_STOP_WORDS)})) AS t FROM benchmark)
SELECT question_id, CAST(len(t) AS INTEGER) AS n_terms, array_to_string(list_sort(t), ' ') AS terms FROM q""")
def prj_query_terms(spark, sf_dir):
    t = X.query_tokens(F.col("question"), X.QUERY_STOP_WORDS)
    return questions(spark, sf_dir).select("question_id", F.size(t).alias("n_terms"), F.array_join(F.array_sort(t), " ").alias("terms"))


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"


@query(f"WITH {_V} SELECT vec_id, CAST(len(e) AS INTEGER) AS dims, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(list_max(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 6) AS largest FROM v")
def vec_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(dense.valid_vector(F.col("embedding")))
    return e.select("vec_id", F.size("embedding").alias("dims"), F.round(dense.norm(F.col("embedding")), 6).alias("norm"), F.round(F.array_max(dense.normalized(F.col("embedding"))), 6).alias("largest"))


_COSINE = f"""{_V}, near AS (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM near WHERE score >= 0.2)"""


def _cosine(spark, sf_dir, k=10):
    e = table(spark, sf_dir, "embeddings")
    return dense.cosine_top_k(e.where("vec_id % 20 = 0"), e, k, 0.2, same=False)


@query(f"WITH {_COSINE} SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 10")
def vec_cosine_topk(spark, sf_dir):
    """Every row whose id is divisible by 20 as a query, against all rows."""
    return _cosine(spark, sf_dir)


_NAMED = _COSINE.replace("a.vec_id AS question_id, b.vec_id AS chunk_id", "a.vec_id AS question_id, 'v' || CAST(b.vec_id AS VARCHAR) AS chunk_id")


@query(f"WITH {_NAMED.replace('AND a.vec_id <> b.vec_id', 'AND a.vec_id % 4 = b.vec_id % 4')} SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 10")
def vec_index_topk(spark, sf_dir):
    """The same from a stored index of cells by names, all cells searched, each query seeing a quarter of the vectors."""
    with_checkpoints(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cells-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "embeddings")
    quarter = F.concat(F.lit("scope "), (F.col("vec_id") % 4).cast("string"))
    named = e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("embedding").alias("vector"), F.array(quarter).alias("visible"))
    cells.write(named, at, "embeddings", cell_size=128, visible_col="visible")
    index = cells.open_index(spark, at, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"), quarter.alias("scope"))
    return index.top_k(asked, 10, 0.2, probes=len(index.centres), scope_col="scope")


@query("SELECT len(embedding) AS dims, count(*) AS n FROM embeddings GROUP BY ALL")
def vec_dims(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n, CAST(sum(('0x' || substr(sha256('{"id":' || CAST(vec_id AS VARCHAR) || ',"v":[' || CAST(label AS VARCHAR) || ',' || CAST(vec_id % 1000 AS VARCHAR) || ']}'), 1, 15))::BIGINT::HUGEINT) AS VARCHAR) AS digest FROM embeddings""")
def vec_fingerprint(spark, sf_dir):
    """Over vectors of whole numbers, whose text is the same everywhere."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.col("label").cast("long"), F.col("vec_id") % 1000).alias("v"))
    return dense.fingerprint(e, vector_col="v")


def counted(texts: list[str]) -> list[list[float]]:
    """A provider that any engine can follow: length, letters e, blanks."""
    return [[float(len(t or "")), float((t or "").count("e")), float((t or "").count(" "))] for t in texts]


_COUNTED = "CAST(length(text) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS b, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS c"


@query(f"SELECT item_id AS question_id, {_COUNTED} FROM benchmark")
def vec_embed(spark, sf_dir):
    """Through a provider, in batches."""
    v = F.col("vector")
    return dense.embed(questions(spark, sf_dir), counted, "question", 3).select("question_id", v[0].alias("a"), v[1].alias("b"), v[2].alias("c"))


_RANKS = f"""{_POSTINGS},
o AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM overlap),
b AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM bm25),
both_ranks AS (SELECT 'overlap' AS backend, * FROM o WHERE rank <= 20 UNION ALL SELECT 'bm25', * FROM b WHERE rank <= 20),
fused AS (SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(rank) AS best_rank FROM both_ranks GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM fused)"""


def two_rankings(spark, sf_dir, depth=20, held=None):
    """backend, question_id, chunk_id, score, rank of token overlap and BM25 (from a batch that is known already where given)."""
    held = held or held_batch(spark, sf_dir)
    return stored(lexical.best_of(held.candidates(depth), depth).select("question_id", "chunk_id", "score", "rank", "backend"), "rankings")


@query(f"WITH {_RANKS} SELECT question_id, chunk_id, score, CAST(best_rank AS INTEGER) AS best_rank, CAST(rank AS INTEGER) AS rank FROM rrf WHERE rank <= 10")
def fus_rrf_topk(spark, sf_dir):
    return fusion.rrf(two_rankings(spark, sf_dir), top=10)


@query(f"""WITH {_RANKS}, routed AS (SELECT backend, r.question_id, r.chunk_id, c.tenant_id AS route, row_number() OVER (PARTITION BY r.question_id, c.tenant_id, backend ORDER BY r.rank) AS rank FROM both_ranks r JOIN chunks c USING (chunk_id)),
f AS (SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(rank) AS best_rank FROM routed GROUP BY ALL)
SELECT question_id, chunk_id, score, CAST(best_rank AS INTEGER) AS best_rank, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM f) WHERE rank <= 5""")
def fus_route_rrf(spark, sf_dir):
    hits = two_rankings(spark, sf_dir).join(chunks(spark, sf_dir).select("chunk_id", F.col("tenant_id").alias("route")), "chunk_id")
    return fusion.route_rrf(hits.withColumn("score", -F.col("rank").cast("double")), top=5)


@query(f"WITH {_RANKS} SELECT question_id, chunk_id, count(DISTINCT h) AS n_payloads FROM (SELECT r.question_id, r.chunk_id, sha256(c.text || CASE WHEN backend = 'bm25' AND c.tenant_id = 'src1' THEN '!' ELSE '' END) AS h FROM both_ranks r JOIN chunks c USING (chunk_id)) GROUP BY ALL HAVING count(DISTINCT h) > 1")
def fus_payload_check(spark, sf_dir):
    c = chunks(spark, sf_dir).select("chunk_id", "text", "tenant_id")
    damaged = F.when((F.col("backend") == "bm25") & (F.col("tenant_id") == "src1"), "!").otherwise("")
    return fusion.payload_conflicts(two_rankings(spark, sf_dir).join(c, "chunk_id").withColumn("payload_hash", F.sha2(F.concat("text", damaged), 256)))


@query(f"""WITH {_RANKS}, pool AS (SELECT r.question_id, r.chunk_id, r.rank AS former_rank, round(c.page_end::DOUBLE / (1 + o.score), 6) AS s FROM rrf r JOIN chunks c USING (chunk_id) LEFT JOIN overlap o ON o.question_id = r.question_id AND o.chunk_id = r.chunk_id WHERE r.rank <= 20),
p AS (SELECT *, CASE WHEN bool_or(s IS NULL) OVER (PARTITION BY question_id) THEN 'FALLBACK' ELSE 'APPLIED' END AS status FROM pool)
SELECT question_id, chunk_id, CAST(former_rank AS INTEGER) AS former_rank, status, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN status = 'APPLIED' THEN s END DESC NULLS LAST, former_rank) AS rank FROM p) WHERE rank <= 10""")
def fus_rerank_topk(spark, sf_dir):
    """A stand-in score (pages by overlap), missing where token overlap has none, so that some questions fall back."""
    held = held_batch(spark, sf_dir)
    pool = stored(fusion.rrf(two_rankings(spark, sf_dir, held=held), top=20).select("question_id", "chunk_id", "rank"), "pool")
    c = chunks(spark, sf_dir).select("chunk_id", "page_end")
    o = held.overlap(pool).withColumnRenamed("score", "shared")
    scored = pool.join(c, "chunk_id").join(o, ["question_id", "chunk_id"], "left").withColumn("pair_score", F.round(F.col("page_end").cast("double") / (1 + F.col("shared")), 6))
    return fusion.rerank(scored, 10).select("question_id", "chunk_id", "former_rank", "status", "rank")


@query(f"""WITH {_RANKS}, words AS (SELECT item_id AS question_id, list_distinct(list_filter(regexp_split_to_array(text, '[\\s\\x0b]+'), lambda w: w <> '')) AS w FROM benchmark),
pool AS (SELECT r.question_id, r.chunk_id, r.rank AS former_rank, CAST(len(list_intersect(w, list_filter(regexp_split_to_array(c.text, '[\\s\\x0b]+'), lambda x: x <> ''))) AS DOUBLE) / greatest(len(w), 1) AS s FROM rrf r JOIN chunks c USING (chunk_id) JOIN words USING (question_id) WHERE r.rank <= 20)
SELECT question_id, chunk_id, CAST(former_rank AS INTEGER) AS former_rank, 'APPLIED' AS status, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, former_rank) AS rank FROM pool) WHERE rank <= 10""")
def fus_rerank_provider(spark, sf_dir):
    """The same through a scorer of text pairs: the share of question words in the passage."""
    pool = fusion.rrf(two_rankings(spark, sf_dir), top=20).select("question_id", "chunk_id", "rank")
    pairs = pool.join(questions(spark, sf_dir), "question_id").join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")

    def share(some):
        return [len(set(q.split()) & set(t.split())) / (len(set(q.split())) or 1) for q, t in some]

    return fusion.rerank(fusion.score_pairs(pairs, share, "question", "text"), 10).select("question_id", "chunk_id", "former_rank", "status", "rank")


@query(f"""WITH {_RANKS}, pool AS (SELECT r.question_id, r.chunk_id, r.rank, c.visibility AS route FROM rrf r JOIN chunks c USING (chunk_id) WHERE r.rank <= 20 AND c.visibility <> 'private'),
ranked AS (SELECT question_id, chunk_id, route, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM pool),
m AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS n, min(route) OVER (PARTITION BY question_id) <> max(route) OVER (PARTITION BY question_id) AS two, row_number() OVER (PARTITION BY question_id, route ORDER BY rank) = 1 AS first FROM ranked),
st AS (SELECT *, CASE WHEN question_id % 2 = 1 THEN 'COMPARISON_NOT_PROVEN' WHEN n < 3 THEN 'CANDIDATE_COUNT_INSUFFICIENT' WHEN NOT two THEN 'ROUTE_CANDIDATE_UNAVAILABLE' END AS failure_code FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN failure_code IS NULL AND first THEN 0 ELSE 1 END, rank) AS place FROM st)
SELECT question_id, chunk_id, route, CASE WHEN failure_code IS NULL THEN 'APPLIED' ELSE 'FALLBACK' END AS status, failure_code, CAST(rank AS INTEGER) AS former_rank, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank) AS INTEGER) AS rank FROM k WHERE place <= 3""")
def fus_route_coverage(spark, sf_dir):
    """Two routes by visibility; questions with an even id ask for a comparison."""
    from pyspark.sql.window import Window

    pool = fusion.rrf(two_rankings(spark, sf_dir), top=20).join(chunks(spark, sf_dir).select("chunk_id", F.col("visibility").alias("route")), "chunk_id").where("route <> 'private'")
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))
    asked = F.when(F.pmod("question_id", F.lit(2)) == 0, "compare the two").otherwise("tell of one")
    given = ranked.withColumns({"question": asked, "requested_routes": F.array(F.lit("public"), F.lit("tenant"))})
    return fusion.coverage(given).select("question_id", "chunk_id", "route", "status", "failure_code", "former_rank", "rank")


@query(f"""WITH {_COSINE}, n AS (SELECT question_id, count(*) AS n FROM dense WHERE rank <= 10 GROUP BY question_id),
a AS (SELECT e.vec_id AS question_id, CASE WHEN e.vec_id % 100 = 0 THEN 0 ELSE coalesce(n.n, 0) END AS n FROM embeddings e LEFT JOIN n ON n.question_id = e.vec_id WHERE e.vec_id % 20 = 0)
SELECT question_id, CAST(n AS BIGINT) AS n_candidates, CASE WHEN question_id % 100 = 0 THEN 'FORBIDDEN' WHEN n > 0 THEN 'EVIDENCE_FOUND' ELSE 'NO_EVIDENCE' END AS decision FROM a""")
def fus_decision(spark, sf_dir):
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"))
    return fusion.decisions(asked, _cosine(spark, sf_dir), asked.where("question_id % 100 = 0"))


_ASKED = "trim(regexp_replace(regexp_replace(text, '[。！？!?；;，,]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT item_id AS question_id, CASE WHEN item_id % 3 = 0 THEN 'FALLBACK' ELSE 'APPLIED' END AS status, CASE WHEN item_id % 3 = 0 THEN 'COMPARISON_NOT_PROVEN' END AS failure_code,
  CASE WHEN item_id % 3 = 0 THEN 'Tell the first report vs the second report在 ' || {_ASKED} ELSE 'first report Compare the 在 ' || {_ASKED} END AS left_query,
  CASE WHEN item_id % 3 = 0 THEN 'Tell the first report vs the second report在 ' || {_ASKED} ELSE 'second report Compare the 在 ' || {_ASKED} END AS right_query FROM benchmark""")
def fus_decompose(spark, sf_dir):
    """Questions put together from benchmark items, parted again by their aliases; a third of them don't say that they compare."""
    from lodestone.operators.decompose import ComparisonConfig, decompose

    config = ComparisonConfig({"even": ("first report",), "odd": ("second report",)}, ("compare",), ("then",))
    plain = X.squeeze(F.regexp_replace("question", "[。！？!?；;，,]", ""))
    verb = F.when(F.col("question_id") % 3 == 0, "Tell the ").otherwise("Compare the ")
    q = questions(spark, sf_dir).select("question_id", F.concat(verb, F.lit("first report vs the second report在 "), plain).alias("question"), F.array(F.lit("even"), F.lit("odd")).alias("document_ids"))
    return decompose(q, config).select("question_id", "status", "failure_code", F.col("queries")["even"].alias("left_query"), F.col("queries")["odd"].alias("right_query"))


_TOP3 = f"{_RANKS}, top3 AS (SELECT * FROM rrf WHERE rank <= 3)"


@query(f"WITH {_TOP3} SELECT question_id, CAST(rank AS INTEGER) AS rank, 'evidence_' || lpad(CAST(rank AS VARCHAR), 3, '0') AS evidence_id, 'citation_' || lpad(CAST(rank AS VARCHAR), 3, '0') AS citation_id, chunk_id, document_id, page_start, page_end, text AS quote FROM top3 JOIN chunks USING (chunk_id)")
def prj_evidence_rows(spark, sf_dir):
    return answers.evidence_rows(fusion.rrf(two_rankings(spark, sf_dir), top=3), chunks(spark, sf_dir))


@query(f"WITH {_TOP3} SELECT question_id, 'COMPLETED' AS status, string_agg(text || ' [' || CAST(rank AS VARCHAR) || ']', ' ' ORDER BY rank) AS answer, count(*) AS n_evidence FROM top3 JOIN chunks USING (chunk_id) GROUP BY question_id")
def prj_answers(spark, sf_dir):
    top = fusion.rrf(two_rankings(spark, sf_dir), top=3)
    return answers.answers(fusion.decisions(questions(spark, sf_dir), top), answers.evidence_rows(top, chunks(spark, sf_dir)))


@query(f"WITH {_TOP3} SELECT b.item_id AS question_id, 'Question: ' || b.text || chr(10) || chr(10) || string_agg('[' || CAST(rank AS VARCHAR) || '] ' || c.text, chr(10) || chr(10) ORDER BY rank) AS prompt FROM benchmark b JOIN top3 t ON t.question_id = b.item_id JOIN chunks c USING (chunk_id) GROUP BY b.item_id, b.text")
def prj_prompt(spark, sf_dir):
    top = fusion.rrf(two_rankings(spark, sf_dir), top=3)
    return answers.user_prompt(questions(spark, sf_dir), answers.evidence_rows(top, chunks(spark, sf_dir)))


@query(f"""WITH {SCOPES} SELECT scope_id, substr(sha256('local' || chr(10) || scope_id || chr(10) || '{{"acl_version":"acl-v1","document_ids":[' || array_to_string(list_transform(document_ids, lambda x: '"' || x || '"'), ',') || '],"folder_ids":[' || array_to_string(list_transform(folder_ids, lambda x: '"' || x || '"'), ',') || '],"include_public":' || CAST(include_public AS VARCHAR) || ',"library_ids":[' || array_to_string(list_transform(library_ids, lambda x: '"' || x || '"'), ',') || '],"tenant_id":"' || tenant_id || '","user_id":"user-' || tenant_id || '"}}'), 1, 20) AS request_id FROM scopes""")
def prj_request_identity(spark, sf_dir):
    s = scopes(spark, sf_dir)
    df = s.select("scope_id", F.struct(*[c for c in s.columns if c != "scope_id"]).alias("scope"))
    return df.select("scope_id", answers.request_identity(F.col("scope_id"), answers.canonical_scope(), "local").alias("request_id"))


@query(f"WITH {CHUNKS} SELECT chunk_id, sha256('Title: ' || document_id || chr(10) || 'Section: ' || section_path || chr(10) || text) AS digest, sha256(section_path || chr(10) || text) AS short_digest FROM chunks")
def prj_passages(spark, sf_dir):
    c = chunks(spark, sf_dir)
    titles = c.select("document_id", F.col("document_id").alias("title"))
    long = answers.rerank_passages(c, titles).select("chunk_id", F.sha2("passage", 256).alias("digest"))
    return long.join(c.select("chunk_id", F.sha2(answers.passage(F.col("text"), F.col("section_path")), 256).alias("short_digest")), "chunk_id")
