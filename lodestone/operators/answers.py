"""Evidence, citations and answers in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_rows(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, rank, evidence_id, citation_id, chunk_id, document_id, pages, quote: one row a ranked chunk."""
    held = chunks.select("chunk_id", "document_id", "page_start", "page_end", F.col("text").alias("quote"))
    return ranking.join(held, "chunk_id").select("question_id", "rank", F.format_string("evidence_%03d", "rank").alias("evidence_id"), F.format_string("citation_%03d", "rank").alias("citation_id"), "chunk_id", "document_id", "page_start", "page_end", "quote")


def answers(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, status, answer, n_evidence: quotes in order of rank, each with its marker; NO_EVIDENCE and FORBIDDEN without text."""
    quoted = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "quote"))).alias("q"))
    text = F.array_join(F.transform("q", lambda x: F.concat(x["quote"], F.lit(" ["), x["rank"].cast("string"), F.lit("]"))), " ")
    df = decisions.join(quoted, "question_id", "left")
    found = F.col("decision") == "EVIDENCE_FOUND"
    return df.select("question_id", F.when(found, "COMPLETED").when(F.col("decision") == "FORBIDDEN", "FAILED").otherwise("NO_EVIDENCE").alias("status"), F.when(found, text).alias("answer"), F.when(found, F.size("q")).otherwise(0).cast("long").alias("n_evidence"))


def canonical_scope(scope: str = "scope") -> Column:
    """The scope as JSON with keys in order and nulls kept."""
    names = sorted(("user_id", "tenant_id", "library_ids", "folder_ids", "document_ids", "include_public", "acl_version"))
    return F.to_json(F.struct(*[F.col(f"{scope}.{n}").alias(n) for n in names]), {"ignoreNullFields": "false"})


def request_identity(question: Column, scope_json: Column, boundary: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", F.lit(boundary), question, scope_json), 256), 1, 20)


def user_prompt(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, prompt: the question and numbered evidence blocks."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("quote"))
    blocks = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return questions.join(blocks, "question_id", "left").select("question_id", F.concat_ws("\n\n", F.concat(F.lit("Question: "), "question"), F.array_join(F.transform("x", lambda r: r["b"]), "\n\n")).alias("prompt"))


def rendered_claims(claims: Column, most: int = 8000) -> Column:
    """Claims with their markers, one a line; null if longer than `most`."""
    one = lambda c: F.concat(c["text"], F.lit(" "), F.array_join(F.transform(c["citation_ids"], lambda p: F.concat(F.lit("["), p.cast("string"), F.lit("]"))), ""))
    text = F.array_join(F.transform(claims, one), "\n")
    return F.when(F.length(text) <= most, text)


# Fixed value: what stands in place of a text that did not pass.
DEGRADED_ANSWER = "真实生成模型未通过本次门禁；已保留经过授权和版本校验的证据卡。"


def enforced(verified: DataFrame, enforce: bool = True, boundary: str = "LOCAL", keep: list[str] = ()) -> DataFrame:
    """answer_id, status, answer, n_dropped, warning: unsupported claims dropped (enforce) or only counted; DEGRADED when none is left or the text is too long.

    verified: answer_id, position, text, citation_ids, status. The warning says, after the name of the boundary, how the claims fared.
    """
    is_ = lambda *names: F.col("status").isin(*names)
    bad = is_("UNSUPPORTED")
    kept = F.array_sort(F.collect_list(F.when(~bad if enforce else F.lit(True), F.struct("position", "text", "citation_ids"))))
    facts = [F.count_if(bad).alias("n_dropped"), F.bool_or(is_("CONFLICTING_EVIDENCE")).alias("_clash"), F.bool_and(is_("INSUFFICIENT_EVIDENCE")).alias("_limited")]
    df = verified.groupBy("answer_id", *keep).agg(kept.alias("claims"), *facts).withColumn("answer", F.when(F.size("claims") > 0, rendered_claims(F.col("claims"))))
    if enforce:
        told = F.when(F.col("n_dropped") > 0, "PARTIAL_ANSWER_UNSUPPORTED_DROPPED").when(F.col("_clash"), "CONFLICT_DISCLOSED").when(F.col("_limited"), "SAFE_LIMITATION").otherwise("VALIDATED")
        told = F.concat(F.lit("CITATION_IDS_VALIDATED_CLAIM_EVIDENCE_"), told)
    else:
        told = F.concat(F.lit("CITATION_IDS_VALIDATED_CLAIM_EVIDENCE_AUDIT_"), F.when(F.col("n_dropped") > 0, "FAILED").otherwise("PASS"), F.lit("_NOT_ENFORCED"))
    told = F.when(F.size("claims") == 0, "CLAIM_EVIDENCE_FAILED_CLOSED_EVIDENCE_ONLY").when(F.col("answer").isNull(), "FAILED_CLOSED_EVIDENCE_ONLY").otherwise(told)
    return df.select("answer_id", *keep, F.when(F.col("answer").isNotNull(), "COMPLETED").otherwise("DEGRADED").alias("status"), "answer", "n_dropped", F.concat(F.lit(f"{boundary}_"), told).alias("warning"))


def passage(chunk_text: Column, section_path: Column) -> Column:
    return F.concat_ws("\n", section_path, chunk_text)


def rerank_passages(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """chunk_id, passage with title, section and text; null passage where the document has no title, an error for the caller."""
    text = F.concat(F.lit("Title: "), F.col("title"), F.lit("\nSection: "), F.col("section_path"), F.lit("\n"), F.col("text"))
    return chunks.join(titles.select("document_id", "title"), "document_id", "left").select("chunk_id", text.alias("passage"))
