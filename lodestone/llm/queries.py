"""The registered queries of this subpackage, each an operator applied to its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, divergence, licenses, mixing, pii, quality, rules, simhash, spelling, sstable, vectors, warc, winnowing

#: The tokenizer's vocabulary files stay outside the repository; operators take their paths as parameters.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=2)
    return sstable.read_shards(manifest)


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).table()


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(warc.write_bundles(table(spark, sf_dir, "pages")))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def llm_rules_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of op2 at bounds that the small tables' few holdouts can certify: 10 % a share at 80 %."""
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), alpha=0.1, delta=0.2)


def llm_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over every vector and a copy without its first components (as many as its id modulo 20): cosines from under 0.9 to 1."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    less = F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 20, F.lit(0.0).cast("float")).otherwise(x))
    return vectors.near_duplicates(e.union(e.select(F.col("vec_id") + F.lit(1000000000000), less)))


def queries() -> dict:
    ops = (op1_sstable, op2_rules, op3_quality, op4_pii, op5_simhash, op6_mixing, op7_warc, op8_vectors, op9_licenses, op10_bpe, op11_winnowing, op12_divergence, op13_spelling)
    return {f.__name__: f for f in (*ops, llm_rules_loose, llm_vector_copies)}


#: Five hex digits of the SHA-1 are four letters of its base32 form.
_BASE32 = "array_to_string(list_transform(range(40), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '')"

OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS n, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  {_BASE32.replace("range(40)", "range(32)")} AS payload_digest,
  CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM d
"""

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""

#: The same over every vector and its copy.
COPIES_SQL = OP8_SQL.replace("embeddings", "copies").replace("WITH RECURSIVE v AS", """WITH RECURSIVE copies AS (SELECT vec_id, embedding FROM embeddings
  UNION ALL SELECT vec_id + 1000000000000, list_transform(embedding, lambda x, i: CASE WHEN i <= vec_id % 20 THEN 0 ELSE x END) FROM embeddings),
v AS""")


_LEVELS = "[" + ", ".join(f"{c}::DOUBLE" for c in rules.LEVELS) + "]"


def _rules_sql(alpha: float, delta: float) -> str:
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (SELECT r, doc_id, stratum, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, length(text) - length(replace(text, '!', '')) AS n_bangs
  FROM s LEFT JOIN covered c USING (r)),
b AS (SELECT m.*, s.text, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbols, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS lines_again,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS words_again, coalesce(n_capitals / nullif(word_chars, 0), 0) AS capitals, coalesce(n_bangs / nullif(word_chars, 0), 0) AS bangs FROM m JOIN s USING (r)),
long AS (UNPIVOT (SELECT r, doc_id, stratum, base_failed, symbols, lines_again, words_again, capitals, bangs FROM b) ON symbols, lines_again, words_again, capitals, bangs INTO NAME share VALUE v),
known AS (SELECT doc_id, min(quality) AS y FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
trial AS (SELECT min(r) AS r, min(y) AS y FROM b JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY stratum, text HAVING min(y) = max(y)),
held AS (SELECT stratum, share, t.y, len(list_filter({_LEVELS}, lambda c: v > c)) AS passes FROM long JOIN trial t USING (r)),
size AS (SELECT stratum, share, sum(y) AS n, sum(1 - y) AS n_bad FROM held GROUP BY ALL),
level AS (SELECT s.*, j AS level, (SELECT count(DISTINCT coalesce(stratum, chr(0))) FROM held) AS strata,
    (SELECT count(*) FROM held h WHERE h.stratum IS NOT DISTINCT FROM s.stratum AND h.share = s.share AND h.y = 1 AND h.passes > j) AS k, (SELECT count(*) FROM held h WHERE h.stratum IS NOT DISTINCT FROM s.stratum AND h.share = s.share AND h.y = 0 AND h.passes > j) AS hit
  FROM size s, range({len(rules.LEVELS)}) x(j)),
tail AS (SELECT *, CASE WHEN k > n * {alpha} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})))) END AS p FROM level),
best AS (SELECT stratum, share, arg_max(level, (round(hit / greatest(n_bad, 1) - k / n, 9), level)) AS level FROM tail WHERE p <= {delta} / (strata * {len(rules.SHARES)}) AND hit / greatest(n_bad, 1) - k / n > 0 GROUP BY ALL),
over AS (SELECT DISTINCT r FROM long JOIN best ON best.stratum IS NOT DISTINCT FROM long.stratum AND best.share = long.share WHERE v > {_LEVELS}[best.level + 1])
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND r NOT IN (SELECT r FROM over) AS kept FROM b
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, place.n, i, item FROM place JOIN win ON place.n = win.n AND place.gram = win.gram),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT l.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept ON kept.lang = l.lang GROUP BY l.lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM cell JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM cell GROUP BY ALL) JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
own AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM own)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _crc_table() -> list[int]:
    """What the CRC-32 of reversed polynomial 0xEDB88320 makes of each byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


OP13_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {_crc_table()}::BIGINT[] AS t),
run AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT run, k, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':', ''), lambda x: CAST(ord(x) AS BIGINT))
    || flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) AS BIGINT) - 64] END)) AS b FROM run),
h AS (SELECT run, k, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM bytes, crc),
occ AS (SELECT k, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM h),
dict AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM occ WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
gap AS (SELECT word, left(word, i - 1) || '*' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM dict)),
near AS (SELECT a.word AS a, b.word AS b FROM gap a JOIN gap b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT word, less FROM gap WHERE less IN (SELECT word FROM dict) UNION SELECT less, word FROM gap WHERE less IN (SELECT word FROM dict)),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM near JOIN dict ON dict.word = near.b GROUP BY a),
form AS (SELECT dict.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM dict LEFT JOIN best ON best.word = dict.word),
walk AS (SELECT word, word AS top, 0 AS step FROM form UNION ALL SELECT walk.word, form.form, step + 1 FROM walk JOIN form ON form.word = walk.top WHERE form.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN (SELECT word, arg_max(top, step) AS root FROM walk GROUP BY word) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_rules": _rules_sql(0.01, 0.05), "op7_warc": OP7_SQL, "op8_vectors": OP8_SQL, "op11_winnowing": OP11_SQL, "op12_divergence": OP12_SQL, "op13_spelling": OP13_SQL, "llm_rules_loose": _rules_sql(0.1, 0.2), "llm_vector_copies": COPIES_SQL}
