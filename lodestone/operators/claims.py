"""Checking claims against the evidence they cite, by rules in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X

# Marker words, in two languages.
CONFLICT = ("存在差异", "不一致", "冲突", "分别为", "different", "differ", "conflict", "inconsistent", "whereas", "but")
INSUFFICIENT = ("证据不足", "无法确定", "未提供", "未提及", "没有说明", "不能判断", "insufficient evidence", "cannot determine", "does not identify", "does not report", "not reported", "not provided")
CAUSAL = ("导致", "证明", "因此必然", "因而必然", "必然带来", "causes", "caused by", "proves", "must result")
CAUSAL_EVIDENCE = (*CAUSAL, "消融", "对照", "控制变量", "干预", "ablation", "controlled", "control group", "intervention")
UNIVERSAL = ("所有任务", "所有模型", "普遍有效", "始终", "all tasks", "all models", "universally", "always")
COMPARATIVE = ("优于", "更优", "最佳", "胜过", "提高", "提升", "降低", "下降", "高于", "低于", "outperform", "superior", "better than", "best", "improve", "increase", "decrease", "higher", "lower")
NOVELTY = ("首次", "首个", "首创", "唯一", "最全面", "first-ever", "the first", "the only", "most comprehensive", "state-of-the-art", "state of the art")
QUALIFIERS = (("至少", "at least"), ("至多", "最多", "不超过", "at most", "no more than"), ("仅", "只在", "only"), ("分别", "respectively"), ("条件下", "under"))


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def evidence_facts(evidence: Column, claim: Column) -> Column:
    """What the rules ask of an evidence text (in lower case) for a claim or its clauses, taken from it once; what a claim without digits,
    Latin letters or CJK characters can't ask for is left empty.
    """
    asked = lambda sign, fact, kind: F.when(claim.rlike(sign), fact).otherwise(F.array().cast(kind))
    return F.struct(
        evidence.alias("text"),
        asked(X.DIGIT, X.numbers(evidence), "array<double>").alias("numbers"),
        asked(X.DIGIT, X.unit_facts(evidence), "array<struct<unit:string,value:double>>").alias("units"),
        asked("[A-Za-zΑ-Ωα-ω]", X.latin_tokens(evidence, False), "array<string>").alias("latin"),
        asked("[一-鿿]", X.cjk_bigrams(evidence), "array<string>").alias("pairs"),
    )


def core_overlap(claim: Column, facts: Column) -> Column:
    """A shared Latin content token, or a claim of four CJK characters or more with bigram overlap of 0.12 or more."""
    latin = F.arrays_overlap(X.latin_tokens(claim, True), facts["latin"])
    share = X.let(X.cjk_bigrams(claim), lambda p: F.size(F.array_intersect(p, facts["pairs"])) / F.greatest(F.size(p), F.lit(1)))
    return latin | ((F.length(X.cjk(claim)) >= 4) & (share >= 0.12))


def shares_objects(claim: Column, facts: Column) -> Column:
    """Two shared Latin content tokens or two shared CJK bigrams."""
    latin = F.size(F.array_intersect(X.latin_tokens(claim, True), facts["latin"])) >= 2
    return latin | (F.size(F.array_intersect(X.cjk_bigrams(claim), facts["pairs"])) >= 2)


def support_failure(claim: Column, facts: Column) -> Column:
    """First of nine rules that fails, null if none does; facts: evidence_facts, bound once a row."""
    low, evidence = F.lower(claim), facts["text"]
    need = lambda asked, held: X.has_any(low, asked) & ~X.has_any(evidence, held)
    qualifier = F.lit(False)
    for group in QUALIFIERS:
        qualifier = qualifier | need(group, group)
    no_overlap = X.let(X.clauses(claim), lambda parts: (F.size(parts) == 0) | ~F.forall(parts, lambda p: core_overlap(p, facts)))
    return (
        F.when(~_subset(X.numbers(claim), facts["numbers"]), "NUMERIC_ANCHOR_MISSING_FROM_EVIDENCE")
        .when(~_subset(X.unit_facts(claim), facts["units"]), "NUMERIC_UNIT_NOT_ESTABLISHED")
        .when(need(CAUSAL, CAUSAL_EVIDENCE), "CAUSAL_RELATION_NOT_ESTABLISHED")
        .when(need(UNIVERSAL, UNIVERSAL), "UNIVERSAL_SCOPE_NOT_ESTABLISHED")
        .when(need(COMPARATIVE, COMPARATIVE), "COMPARISON_NOT_ESTABLISHED")
        .when(X.has_any(low, COMPARATIVE) & ~shares_objects(claim, facts), "COMPARISON_OBJECTS_NOT_ESTABLISHED")
        .when(need(NOVELTY, NOVELTY), "NOVELTY_OR_SUPERLATIVE_NOT_ESTABLISHED")
        .when(qualifier, "QUALIFYING_CONDITION_NOT_ESTABLISHED")
        .when(no_overlap, "CORE_LEXICAL_OVERLAP_NOT_ESTABLISHED")
    )


def is_safe_limitation(claim: Column) -> Column:
    """No number, and every clause says that evidence is missing."""
    every = X.let(X.clauses(F.lower(claim)), lambda parts: (F.size(parts) > 0) & F.forall(parts, lambda p: X.has_any(p, INSUFFICIENT)))
    return ~claim.rlike(X.NUMBER) & X.has_any(F.lower(claim), INSUFFICIENT) & every


def conflicts(quotes: Column) -> Column:
    """Units with two values or more over at least two quotes: array of (unit, values)."""
    several = F.when(F.size(quotes) < 2, F.array().cast("array<string>")).otherwise(quotes)
    facts = F.flatten(F.transform(several, lambda q, i: F.transform(X.unit_facts(q), lambda f: F.struct(f["unit"].alias("unit"), f["value"].alias("value"), i.alias("quote")))))

    def grouped(all_: Column) -> Column:
        units = F.array_distinct(F.transform(all_, lambda f: f["unit"]))
        of = lambda u, name: F.array_distinct(F.transform(F.filter(all_, lambda f: f["unit"] == u), lambda f: f[name]))
        rows = F.transform(units, lambda u: F.struct(u.alias("unit"), of(u, "value").alias("values"), F.size(of(u, "quote")).alias("n_quotes")))
        return F.filter(rows, lambda r: (r["n_quotes"] >= 2) & (F.size(r["values"]) >= 2))

    return X.let(facts, grouped)


def numeric_conflicts(quotes: DataFrame) -> DataFrame:
    """claim_id, unit, n_quotes, n_values of conflicting units; quotes: claim_id, quote_id, quote. One row a fact is shuffled."""
    facts = quotes.select("claim_id", "quote_id", F.explode(X.unit_facts(F.col("quote"))).alias("f"))
    return facts.groupBy("claim_id", F.col("f.unit").alias("unit")).agg(F.count_distinct("quote_id").alias("n_quotes"), F.count_distinct("f.value").alias("n_values")).where("n_quotes >= 2 and n_values >= 2")


def citation_failure(citations: Column, quotes: Column) -> Column:
    """First thing wrong with a claim's citation positions among all quotes, null if nothing is."""
    sorted_ = F.array_sort(F.array_distinct(citations))
    cited = F.transform(citations, lambda p: F.get(quotes, p - 1))
    return (
        F.when(F.coalesce(F.size(citations), F.lit(0)) <= 0, "CLAIM_CITATION_MISSING")
        .when(F.exists(citations, lambda p: p.isNull()) | (sorted_ != citations), "CLAIM_CITATION_SET_INVALID")
        .when(F.exists(citations, lambda p: (p < 1) | (p > F.size(quotes))), "CLAIM_CITATION_OUT_OF_RANGE")
        .when(F.exists(cited, lambda q: X.is_blank(q)), "BOUND_EVIDENCE_TEXT_EMPTY")
    )


def verify(claims: DataFrame) -> DataFrame:
    """Adds status and reason to claims: claim_id, text, citation_ids (array<int>), quotes (array<string>, all evidence in order)."""
    cited = F.transform("citation_ids", lambda p: X.strip(F.get(F.col("quotes"), p - 1)))
    bad = F.when(X.is_blank(F.col("text")), "CLAIM_TEXT_EMPTY").otherwise(citation_failure(F.col("citation_ids"), F.col("quotes")))
    df = claims.withColumn("_bad", bad).withColumn("_cited", F.when(F.col("_bad").isNull(), cited))
    df = df.withColumn("_evidence", F.lower(F.array_join("_cited", "\n"))).withColumn("_conflicts", conflicts(F.col("_cited"))).withColumn("_facts", X.unit_facts(F.col("text")))
    df = df.withColumn("_failure", X.let(evidence_facts(F.col("_evidence"), F.col("text")), lambda e: support_failure(F.col("text"), e)))
    told = X.has_any(F.lower("text"), CONFLICT)
    stated = F.exists("_conflicts", lambda c: F.size(F.array_intersect(c["values"], F.transform(F.filter("_facts", lambda f: f["unit"] == c["unit"]), lambda f: f["value"]))) >= 2)
    clash = F.size("_conflicts") > 0
    reason = (
        F.when(F.col("_bad").isNotNull(), F.col("_bad"))
        .when(clash & ~told, "BOUND_NUMERIC_CONFLICT_NOT_DISCLOSED")
        .when(clash & ~stated, "BOUND_NUMERIC_CONFLICT_VALUES_INCOMPLETE")
        .when(clash, F.coalesce("_failure", F.lit("BOUND_NUMERIC_CONFLICT_DISCLOSED")))
        .when(told, "CONFLICT_NOT_DETERMINISTICALLY_PROVEN")
        .when(is_safe_limitation(F.col("text")), "SAFE_LIMITATION_WITH_BOUND_EVIDENCE")
        .otherwise(F.coalesce("_failure", F.lit("DETERMINISTIC_ANCHORS_AND_CORE_OVERLAP_PASS")))
    )
    status = F.when(F.col("reason") == "BOUND_NUMERIC_CONFLICT_DISCLOSED", "CONFLICTING_EVIDENCE").when(F.col("reason") == "SAFE_LIMITATION_WITH_BOUND_EVIDENCE", "INSUFFICIENT_EVIDENCE").when(F.col("reason") == "DETERMINISTIC_ANCHORS_AND_CORE_OVERLAP_PASS", "SUPPORTED").otherwise("UNSUPPORTED")
    return df.withColumn("reason", reason).withColumn("status", status).drop("_bad", "_cited", "_evidence", "_conflicts", "_facts", "_failure")


def verify_set(claims: DataFrame) -> DataFrame:
    """Verdict on a whole evidence set, clause by clause where the claim as a whole fails; claims as for verify, citations valid.

    Rules are asked only where nothing before them gives the verdict, clauses only where the whole claim fails.
    """
    text, clash, told = F.col("text"), F.col("_clash"), X.has_any(F.lower("text"), CONFLICT)
    cited = F.transform("citation_ids", lambda p: X.strip(F.get(F.col("quotes"), p - 1)))
    df = claims.withColumn("_cited", cited).withColumn("_clash", F.size(conflicts(F.col("_cited"))) > 0).withColumn("_limited", is_safe_limitation(text))
    known = F.coalesce(clash, F.lit(False)) | F.coalesce(told, F.lit(False)) | F.coalesce("_limited", F.lit(False))
    good = lambda e: F.size(F.filter(X.clauses(text), lambda p: support_failure(p, e).isNull()))
    both = lambda e: X.let(support_failure(text, e), lambda f: F.struct(f.alias("whole"), F.when(f.isNotNull(), good(e)).alias("good")))
    rules = X.let(evidence_facts(F.lower(F.array_join("_cited", "\n")), text), both)
    df = df.withColumn("_both", F.when(~known, rules)).withColumn("_parts", X.clauses(text))
    failure, good_parts = F.col("_both.whole"), F.col("_both.good")
    status = (
        F.when(clash, "CONFLICTING_EVIDENCE").when(told, "INSUFFICIENT_EVIDENCE").when(F.col("_limited"), "INSUFFICIENT_EVIDENCE").when(failure.isNull(), "SUPPORTED_BY_EVIDENCE_SET")
        .when((good_parts > 0) & (good_parts < F.size("_parts")), "PARTIALLY_SUPPORTED").otherwise("INSUFFICIENT_EVIDENCE")
    )
    reason = (
        F.when(clash & told, "BOUND_NUMERIC_CONFLICT_DISCLOSED").when(clash, "BOUND_NUMERIC_CONFLICT_NOT_DISCLOSED").when(told, "CONFLICT_NOT_DETERMINISTICALLY_PROVEN")
        .when(F.col("_limited"), "SAFE_LIMITATION_WITH_BOUND_EVIDENCE").otherwise(F.coalesce(failure, F.lit("DETERMINISTIC_EVIDENCE_SET_PASS")))
    )
    return df.withColumn("status", status).withColumn("reason", reason).drop("_cited", "_clash", "_limited", "_both", "_parts")


def report(verified: DataFrame, by: str = "answer_id") -> DataFrame:
    """Per answer: claims, share with citations, share unsupported, and whether it is partial: some claim is unsupported, some other is kept."""
    cited = F.avg(F.when(F.size("citation_ids") > 0, 1.0).otherwise(0.0))
    dropped = F.col("status") == "UNSUPPORTED"
    return verified.groupBy(by).agg(F.count(F.lit(1)).alias("n_claims"), F.round(cited, 6).alias("citation_completeness"), F.round(F.avg(F.when(F.col("status") == "UNSUPPORTED", 1.0).otherwise(0.0)), 6).alias("unsupported_rate"), (F.bool_or(dropped) & ~F.bool_and(dropped)).alias("partial"))


def set_report(verified: DataFrame, by: str = "answer_id") -> DataFrame:
    """Per answer: claims, has_conflict, and partial: a claim is partially supported, or one is supported while another lacks evidence.

    verified: rows of verify_set or with_adjacent.
    """
    some = lambda *names: F.bool_or(F.col("status").isin(*names))
    partial = some("PARTIALLY_SUPPORTED") | (some("SUPPORTED_BY_EVIDENCE_SET") & some("INSUFFICIENT_EVIDENCE"))
    return verified.groupBy(by).agg(F.count(F.lit(1)).alias("n_claims"), some("CONFLICTING_EVIDENCE").alias("has_conflict"), partial.alias("partial"))


def identity_failures(cited: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """claim_id, reason: the first rule that the first faulty piece of a claim's evidence breaks, null if all is well.

    cited: claim_id, position, owner (expected), owner_id, chunk_id, document_id, version_id, is_active, quote. versions: document_id,
    version_id (current); chunks: chunk_id, document_id, version_id (current). Pieces are taken by position.
    """
    valid = lambda c: F.coalesce(F.col(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"), F.lit(False))
    now = versions.select("document_id", F.col("version_id").alias("_version")).dropDuplicates(["document_id"])
    live = chunks.select("chunk_id", F.struct("document_id", "version_id").alias("_chunk")).dropDuplicates(["chunk_id"])
    df = cited.join(now, "document_id", "left").join(live, "chunk_id", "left")
    again = F.row_number().over(Window.partitionBy("claim_id", "chunk_id").orderBy("position")) > 1
    first = F.first("version_id").over(Window.partitionBy("claim_id", "document_id").orderBy("position"))
    code = (
        F.when(~(valid("chunk_id") & valid("document_id") & valid("version_id") & valid("owner_id")), "EVIDENCE_IDENTITY_INVALID")
        .when(F.col("owner_id") != F.col("owner"), "EVIDENCE_OWNER_MISMATCH")
        .when(~F.coalesce(F.col("is_active"), F.lit(False)), "EVIDENCE_VERSION_NOT_ACTIVE")
        .when(again, "EVIDENCE_CHUNK_ID_DUPLICATE")
        .when(first != F.col("version_id"), "EVIDENCE_SET_CROSS_VERSION")
        .when(~F.col("version_id").eqNullSafe(F.col("_version")), "EVIDENCE_VERSION_NOT_CURRENT")
        .when(~F.struct("document_id", "version_id").eqNullSafe(F.col("_chunk")), "EVIDENCE_CHUNK_IDENTITY_NOT_CURRENT")
        .when(X.is_blank(F.col("quote")), "BOUND_EVIDENCE_TEXT_EMPTY")
    )
    marked = df.withColumn("_code", code)
    return marked.groupBy("claim_id").agg(F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col("position"))).alias("reason"))


def adjacent_pairs(chunks: DataFrame) -> DataFrame:
    """chunk_id, next_chunk_id whose links point at each other within one version of one owner."""
    a = chunks.select("chunk_id", F.col("next_chunk_id").alias("to"), "owner_id", "version_id")
    b = chunks.select(F.col("chunk_id").alias("to"), F.col("previous_chunk_id").alias("back"), F.col("owner_id").alias("o"), F.col("version_id").alias("v"))
    return a.join(b, "to").where("back = chunk_id and o = owner_id and v = version_id").select("chunk_id", F.col("to").alias("next_chunk_id"))


def with_adjacent(claims: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Claims verified again with one adjacent quote where that settles the verdict: supported by the set, or in conflict.

    neighbours: claim_id, position (order of trial), quote. At most one neighbour is used, the first that helps; no score changes.
    Adds expanded and reason_codes, which tell of the neighbour.
    """
    settled = lambda status: status.isin("SUPPORTED_BY_EVIDENCE_SET", "CONFLICTING_EVIDENCE")
    dealt = claims.repartition(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), "claim_id")  # by number: the work is far more than the bytes
    alone = verify_set(dealt)
    near = neighbours.select(F.col("claim_id").alias("_of"), F.col("position").alias("_position"), F.col("quote").alias("_quote"))
    rows = alone.withColumn("_own", F.struct(*alone.columns)).join(near, (F.col("claim_id") == F.col("_of")) & ~settled(F.col("status")), "left")
    # a claim that no neighbour is tried for has no text here, so nothing is taken from it again
    added = F.concat("_own.citation_ids", F.array(F.size("_own.quotes") + 1)), F.concat("_own.quotes", F.array("_quote"))
    tried = F.col("_of").isNotNull()
    again = rows.select("claim_id", "_own", tried.alias("_tried"), "_position", *[F.when(tried, c).alias(n) for c, n in zip((F.col("_own.text"), *added), ("text", "citation_ids", "quotes"), strict=True)])
    both = verify_set(again).withColumn("expanded", F.col("_tried") & settled(F.col("status")))
    order = Window.partitionBy("claim_id").orderBy(F.col("expanded").desc(), "_position")
    first = both.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    from_row = {"citation_ids", "quotes", "status", "reason"}
    picked = first.select(*[(F.when(F.col("expanded"), F.col(c)).otherwise(F.col(f"_own.{c}")) if c in from_row else F.col(f"_own.{c}")).alias(c) for c in alone.columns], "expanded")
    codes = F.when(F.col("expanded"), F.array("reason", F.lit("SAME_DOCUMENT_VERSION_ADJACENT_EVIDENCE_ADDED"), F.lit("RETRIEVAL_SCORE_UNCHANGED"))).otherwise(F.array("reason"))
    return picked.withColumn("reason_codes", codes)


_CLAIMS = "OBJECT<claims: ARRAY<OBJECT<citation_ids: ARRAY<BIGINT>, text: STRING>>>"


def parse_claims(payloads: DataFrame, json_col: str = "payload", count_col: str = "evidence_count") -> DataFrame:
    """Adds claims (array of text, stripped, and citation_ids, distinct and ascending) and error.

    CLAIMS_MALFORMED: no JSON object whose only key is `claims`, an array; CLAIM_COUNT_INVALID: not 1 to 8 of them; CLAIM_INVALID: a claim with
    other keys than text and citation_ids, another type than text and whole numbers, a blank text or one of more than 2,000 characters
    between its blanks, an inline marker, no citation or one out of range. Else null.
    """
    outer = F.json_object_keys(json_col)
    shape = F.schema_of_variant(F.try_parse_json(json_col))
    parsed = F.from_json(F.col(json_col), "struct<claims:array<struct<text:string,citation_ids:array<bigint>>>>")["claims"]
    tidy = F.transform(parsed, lambda c: F.struct(X.strip(c["text"]).alias("text"), F.array_sort(F.array_distinct(c["citation_ids"])).cast("array<int>").alias("citation_ids")))
    whole = F.coalesce((outer == F.array(F.lit("claims"))) & F.startswith(shape, F.lit("OBJECT<claims: ARRAY<")), F.lit(False))
    df = payloads.withColumn("_n", F.when(whole, F.size(F.from_json(F.col(json_col), "struct<claims:array<string>>")["claims"]))).withColumn("claims", F.when(F.try_parse_json(json_col).isNotNull(), F.when(shape == _CLAIMS, tidy)))
    in_range = lambda c: (F.size(c["citation_ids"]) > 0) & F.forall(c["citation_ids"], lambda p: p.between(1, F.col(count_col)))
    good = F.forall("claims", lambda c: (F.length(c["text"]) > 0) & (F.length(c["text"]) <= 2000) & ~c["text"].rlike(rf"\[{X.DIGIT}+\]") & in_range(c))
    error = F.when(F.col("_n").isNull(), "CLAIMS_MALFORMED").when(~F.col("_n").between(1, 8), "CLAIM_COUNT_INVALID").when(~F.coalesce(good, F.lit(False)), "CLAIM_INVALID")
    return df.withColumn("error", error).drop("_n")
