"""Questions answered in batch: scope, retrieval, fusion, evidence, claims and citations in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import access, answers, blockmax, claims, dense, fusion, lexical, lifecycle

BACKENDS = ("lexical_overlap", "bm25", "vector", "rrf")
_WEIGHTS = {"body": 1.0, "section": 2.0}


def _rankings(questions: DataFrame, chunks: DataFrame, seen: DataFrame, backend: str, candidates: int, vectors, min_score: float) -> list[DataFrame]:
    """One ranking (question_id, chunk_id, score, rank, backend) for each of the backend's parts, of what each question may see."""
    fields = {"body": F.col("text"), "section": F.col("section_path")}
    out = []
    if backend != "vector":
        full, few = blockmax.batch(questions, chunks, fields, _WEIGHTS, lambda df, name: df.checkpoint())
        if backend != "bm25" and vectors is None:
            out.append(blockmax.best(*few, candidates, seen).withColumn("backend", F.lit("overlap")))
        if backend != "lexical_overlap":
            out.append(blockmax.best(*full, candidates, seen).withColumn("backend", F.lit("bm25")))
    if backend == "vector" or backend == "rrf" and vectors is not None:
        asked, held = vectors
        who = seen.groupBy("chunk_id").agg(F.collect_set("question_id").alias("_who"))  # at most the batch of questions
        ranked = dense.cosine_top_k(asked.join(questions.select("question_id"), "question_id", "left_semi").withColumn("_self", F.col("question_id")), held.join(who, "chunk_id"), candidates, min_score, "chunk_id", "vector", query_id="question_id", scope_col="_self", visible_col="_who")
        out.append(ranked.withColumn("backend", F.lit("vector")))
    return out


def answer(spark: SparkSession, questions: DataFrame, scopes: DataFrame, chunks: DataFrame, backend: str = "rrf", top_k: int = 3, candidates: int = 20, reranker=None, provider=None, enforce: bool = True, boundary: str = "LOCAL", vectors: tuple[DataFrame, DataFrame] | None = None, min_score: float = 0.5, routes: DataFrame | None = None, versions_now=None) -> DataFrame:
    """question_id, status, error_code, answer, n_evidence, evidence (array of rank, chunk_id, document_id, page_start, page_end, quote), warning.

    questions: question_id, question, scope_id, requested_document_ids (null or empty: the whole scope). A request under an unknown scope, or
    one that names a document which its scope doesn't reach, is FAILED with RAG_FORBIDDEN_SCOPE, a blank one with RAG_INVALID_REQUEST.
    Otherwise the scope is narrowed to the request and only chunks that it may see are ranked; scopes with an unusable list member see
    nothing. Corpus statistics are those of all active chunks.

    backend: token overlap, BM25, `vector` (cosine of at least min_score), or `rrf`, which fuses BM25 with vectors where they are given and
    with token overlap where not. vectors: (question_id, vector) and (chunk_id, vector).
    reranker(frame of question_id, question, chunk_id, text, rank) adds pair_score. provider(frame of question_id, question, quotes) gives
    question_id and claims (array of text, citation_ids); claims are verified against what they cite and, if enforce, dropped where unsupported.
    An answer of which nothing is left is DEGRADED and keeps its evidence. routes (owner_id, document_id, version_id, for questions with an
    owner_id) are compared with versions_now(), read after retrieval: owners whose ready versions changed get RAG_FORBIDDEN_SCOPE.
    Checkpoints need a folder, as sinks do.
    """
    if backend not in BACKENDS:
        raise ValueError(f"unsupported retrieval backend: {backend}")
    if backend == "vector" and vectors is None:
        raise ValueError("the vector backend needs vectors")
    known = questions.join(scopes.select("scope_id"), "scope_id", "left_semi")
    asked = questions.join(scopes, "scope_id")
    blank = lexical.blank_questions(questions)
    wanted = asked.select("question_id", "scope_id", F.explode("requested_document_ids").alias("document_id"))
    reach = access.granted(chunks.join(wanted.select("document_id").distinct(), "document_id", "left_semi"), scopes, strict=True).select("scope_id", "document_id")
    allowed = wanted.select("question_id", "scope_id").distinct().join(reach, "scope_id").select("question_id", "document_id")
    forbidden = access.forbidden_requests(wanted, allowed, ["question_id"]).select("question_id").union(questions.join(known, "question_id", "left_anti").select("question_id"))
    forbidden = forbidden.distinct().checkpoint()
    live = asked.join(forbidden, "question_id", "left_anti").join(blank, "question_id", "left_anti")
    # every question is a scope of its own, narrowed to what it asks for
    own = access.narrowed(live.withColumn("scope_id", F.col("question_id").cast("string")))
    names = [c for c in scopes.columns if c != "scope_id"]
    seen = access.granted(chunks, own.select("scope_id", *names), strict=True).select(F.col("scope_id").alias("question"), "chunk_id")
    seen = seen.join(live.select("question_id", F.col("question_id").cast("string").alias("question")), "question").select("question_id", "chunk_id").checkpoint()
    rankings = _rankings(live, chunks.where("is_active"), seen, backend, candidates, vectors, min_score)
    if len(rankings) == 2:
        columns = ["question_id", "chunk_id", "rank", "backend"]
        ranked = fusion.rrf(rankings[0].select(columns).unionByName(rankings[1].select(columns)), candidates=candidates, top=candidates if reranker else top_k)
    else:
        ranked = rankings[0] if reranker else rankings[0].where(F.col("rank") <= top_k)
    ranked = ranked.select("question_id", "chunk_id", "rank")
    if reranker:
        pairs = ranked.join(live.select("question_id", "question"), "question_id").join(chunks.select("chunk_id", "text"), "chunk_id")
        ranked = fusion.rerank(reranker(pairs), top_k).select("question_id", "chunk_id", "rank")
    evidence = answers.evidence_rows(ranked, chunks).checkpoint()
    if routes is not None:
        changed = lifecycle.revalidated(routes, versions_now()).where(~F.col("unchanged")).select("owner_id")
        moved = questions.join(changed, "owner_id", "left_semi").select("question_id")
        forbidden = forbidden.union(moved).distinct()
        evidence = evidence.join(moved, "question_id", "left_anti")
    given = answers.answers(fusion.decisions(questions, evidence, forbidden), evidence).withColumn("warning", F.lit(None).cast("string"))
    cited = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", "page_start", "page_end", "quote"))).alias("evidence"))
    if provider:
        given = _generated(given, questions, cited, provider, enforce, boundary)
    df = given.join(cited, "question_id", "left").join(blank.select("question_id", F.lit(True).alias("_blank")), "question_id", "left")
    code = F.when(F.col("_blank"), "RAG_INVALID_REQUEST").when(F.col("status") == "FAILED", "RAG_FORBIDDEN_SCOPE")
    return df.select("question_id", F.when(F.col("_blank"), "FAILED").otherwise(F.col("status")).alias("status"), code.alias("error_code"), "answer", "n_evidence", "evidence", "warning")


def _generated(given: DataFrame, questions: DataFrame, cited: DataFrame, provider, enforce: bool, boundary: str) -> DataFrame:
    """Answers with evidence given anew from the provider's claims, as far as these hold; without claims they are DEGRADED."""
    quotes = cited.select("question_id", F.transform("evidence", lambda e: e["quote"]).alias("quotes"))
    made = provider(questions.select("question_id", "question").join(quotes, "question_id")).select("question_id", "claims").checkpoint()
    one = made.join(quotes, "question_id").select(F.col("question_id").alias("answer_id"), "quotes", F.posexplode("claims").alias("position", "c")).select("answer_id", F.concat_ws("-", "answer_id", "position").alias("claim_id"), "position", "c.text", "c.citation_ids", "quotes")
    held = answers.enforced(claims.verify(one), enforce, boundary).select(F.col("answer_id").alias("question_id"), F.col("status").alias("_status"), F.col("answer").alias("_answer"), F.col("warning").alias("_warning"))
    df = given.join(held, "question_id", "left")
    called = F.col("status") == "COMPLETED"
    status, told = F.coalesce("_status", F.lit("DEGRADED")), F.coalesce("_warning", F.lit(f"{boundary}_FAILED_CLOSED_EVIDENCE_ONLY"))
    text = F.when(status == "COMPLETED", F.col("_answer")).otherwise(F.lit(answers.DEGRADED_ANSWER))
    skipped = F.when(F.col("status") == "NO_EVIDENCE", F.lit(f"{boundary}_NOT_CALLED_NO_EVIDENCE"))
    return df.select("question_id", F.when(called, status).otherwise(F.col("status")).alias("status"), F.when(called, text).otherwise(F.col("answer")).alias("answer"), "n_evidence", F.when(called, told).otherwise(skipped).alias("warning"))
