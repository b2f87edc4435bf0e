"""Top-k retrieval that skips what cannot win: postings in blocks by falling impact, with upper bounds.

A posting's impact is what it adds to a score but for the question's own weight of the token, so a score is the sum of weight x impact
over the tokens that a chunk holds. Each token's postings are stored by falling impact in blocks of `BLOCK`, each block with its largest
impact. For a question, tokens are put in order of the most that they can add. If the k-th best score is at least theta, then a chunk that
can be among the k best, and whose last token in that order is t, has at t itself an impact of theta less what all tokens before t can add at
most. So only blocks, and in them postings, that reach this need yield candidates; all others are skipped, whatever the number of
questions. Candidates are then scored exactly.

theta comes from the heads of the lists: the chunks with the best partial sums there are scored in full, and the k-th best of these full
scores is a score that k chunks reach. Where a threshold is asked for instead of k, it is theta itself.

Lists are cut into shards by hash of the chunk, so that a token of every chunk is no one task's sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import QUERY_STOP_WORDS, STOP_WORDS
from lodestone.operators import lexical

#: Postings a block, and of the head of a list as many times k as are looked at to find theta.
BLOCK, HEADS = 128, 4
#: Chunks a shard of a list at most, about.
SHARD = 1_000_000
#: Scores are rounded to six places before they are compared.
_ROUNDING = 2e-6


def impact(weights: dict[str, float], mean_length: float, k1: float = 1.2, b: float = 0.75) -> Column:
    """What a posting adds to BM25 but for the token's idf: rising with the fields' weighted frequency, falling with the length."""
    tf = sum((F.lit(float(w)) * F.col(f"tf_{n}") for n, w in weights.items()), F.lit(0.0))
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(float(mean_length))))


def blocks(postings: DataFrame, value: Column, n_chunks: int, size: int = BLOCK) -> DataFrame:
    """token, shard, block, bound (its largest impact) and postings (chunk_id, impact) by falling impact."""
    shards = max(1, -(-n_chunks // SHARD))
    rows = postings.select("token", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), "chunk_id", value.alias("impact"))
    place = F.row_number().over(Window.partitionBy("token", "shard").orderBy(F.desc("impact"), "chunk_id")) - 1
    dealt = rows.withColumn("block", F.floor(place / size).cast("int"))
    held = dealt.groupBy("token", "shard", "block").agg(F.max("impact").alias("bound"), F.sort_array(F.collect_list(F.struct("impact", "chunk_id")), asc=False).alias("p"))
    return held.select("token", "shard", "block", "bound", F.transform("p", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["impact"].alias("impact"))).alias("postings"))


def vocabulary(held: DataFrame) -> DataFrame:
    """token, df, most: chunks that hold a token, and its largest impact."""
    return held.groupBy("token").agg(F.sum(F.size("postings")).cast("long").alias("df"), F.max("bound").alias("most"))


def idf(n_chunks: int) -> Column:
    return F.log((F.lit(n_chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)


def weighted(terms: DataFrame, words: DataFrame, weight: Column) -> DataFrame:
    """question_id, token, weight, df, most of the terms that any chunk holds."""
    return terms.join(words, "token").select("question_id", "token", weight.alias("weight"), "df", "most")


def exact(pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """question_id, chunk_id, score (6 places) of the pairs, from the postings of their own tokens alone."""
    flat = held.join(asked.select("token").distinct(), "token", "left_semi").select("token", F.explode("postings").alias("p")).select("token", "p.chunk_id", "p.impact")
    wanted = pairs.select("question_id", "chunk_id").join(asked.select("question_id", "token", "weight"), "question_id")
    return wanted.join(flat, ["token", "chunk_id"]).groupBy("question_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score"))


def _seen(rows: DataFrame, visible: DataFrame | None) -> DataFrame:
    if visible is None:
        return rows
    return rows.join(visible.select(*[c for c in ("question_id", "chunk_id") if c in visible.columns]).distinct(), [c for c in ("question_id", "chunk_id") if c in visible.columns], "left_semi")


def threshold(held: DataFrame, asked: DataFrame, k: int, visible: DataFrame | None = None) -> DataFrame:
    """question_id, theta: a score that at least k chunks reach; questions for which the heads name fewer chunks have no row."""
    heads = held.where("block = 0").select("token", F.explode(F.slice("postings", 1, HEADS * k)).alias("p")).select("token", "p.*")
    partial = _seen(heads.join(asked, "token").select("question_id", "chunk_id", (F.col("weight") * F.col("impact")).alias("s")), visible).groupBy("question_id", "chunk_id").agg(F.sum("s").alias("score"))
    some = lexical.top_k(partial, HEADS * k, ["question_id"])
    best = lexical.top_k(exact(some, asked, held), k, ["question_id"])
    return best.where(F.col("rank") == k).select("question_id", F.col("score").alias("theta"))


def needs(asked: DataFrame, theta: DataFrame) -> DataFrame:
    """question_id, token, weight, need: the least weight x impact at which a chunk whose last token this is can still reach theta."""
    order = Window.partitionBy("question_id").orderBy(F.col("weight") * F.col("most"), F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("weight") * F.col("most")).over(order), F.lit(0.0))
    need = F.coalesce(F.col("theta"), F.lit(0.0)) - before - _ROUNDING
    rows = asked.withColumn("before", before).join(theta, "question_id", "left").withColumn("need", F.when(F.col("theta").isNull(), F.lit(0.0)).otherwise(need))
    return rows.where(F.col("weight") * F.col("most") >= F.col("need")).select("question_id", "token", "weight", "need")


def candidates(held: DataFrame, asked: DataFrame, theta: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """question_id, chunk_id of every pair that may reach theta; blocks whose bound stays below the need are not opened."""
    n = needs(asked, theta)
    reach = held.join(n, "token").where(F.col("bound") * F.col("weight") >= F.col("need"))
    one = reach.select("question_id", "weight", "need", F.explode("postings").alias("p")).where(F.col("p.impact") * F.col("weight") >= F.col("need"))
    return _seen(one.select("question_id", "p.chunk_id").distinct(), visible)


def best(held: DataFrame, asked: DataFrame, k: int, visible: DataFrame | None = None) -> DataFrame:
    """question_id, chunk_id, score, rank: the k best, as if all pairs were scored; visible: chunk_id, or question_id and chunk_id, of what may be ranked."""
    return lexical.top_k(exact(candidates(held, asked, threshold(held, asked, k, visible), visible), asked, held), k, ["question_id"])


def at_least(held: DataFrame, asked: DataFrame, theta: DataFrame) -> DataFrame:
    """question_id, chunk_id, score of every pair whose score reaches its question's theta (question_id, theta)."""
    found = exact(candidates(held, asked, theta), asked, held)
    return found.join(theta, "question_id").where("score >= theta").drop("theta")


@dataclass(frozen=True)
class Index:
    """Stored blocks, vocabulary and the collection's facts."""

    blocks: DataFrame
    words: DataFrame
    n_chunks: int
    mean_length: float

    def asked(self, questions: DataFrame, stop: tuple[str, ...] = QUERY_STOP_WORDS, tokenizer=None) -> tuple[DataFrame, DataFrame]:
        """The questions' terms with their idf, and the blocks of these terms only: buckets that hold none of them are not read."""
        terms = lexical.question_terms(questions, stop, tokenizer=tokenizer).withColumn("bucket", bucket_of(F.col("token"), self.n_buckets))
        asked = terms.join(self.words, ["bucket", "token"]).select("question_id", "bucket", "token", idf(self.n_chunks).alias("weight"), "df", "most")
        return asked.drop("bucket"), self.blocks.join(F.broadcast(asked.select("bucket", "token").distinct()), ["bucket", "token"], "left_semi").drop("bucket")

    n_buckets: int = 64

    def top_k(self, questions: DataFrame, k: int, visible: DataFrame | None = None) -> DataFrame:
        asked, held = self.asked(questions)
        return best(held, asked, k, visible)


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write(chunks: DataFrame, fields: dict[str, Column], weights: dict[str, float], path: str, identity: str, k1: float = 1.2, b: float = 0.75, buckets: int = 64, tokenizer=lexical.tokens) -> None:
    """Blocks, vocabulary and facts below path, each published after it has been read back; the facts come last.

    Blocks lie in `buckets` partitions by token, in order of token, so that a search reads the buckets and row groups of its tokens.
    """
    from lodestone.sources.sinks import publish

    listed = publish(lexical.postings(chunks, fields, tokenizer), f"{path}/postings")
    facts = listed.select("chunk_id", "length").distinct().agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("length").alias("mean_length")).first()
    n, mean = facts["n_chunks"], facts["mean_length"] or 1.0
    held = blocks(listed, impact(weights, mean, k1, b), n).withColumn("bucket", bucket_of(F.col("token"), buckets))
    spread = held.repartition(buckets, "bucket").sortWithinPartitions("bucket", "token", "shard", "block")
    spread.write.partitionBy("bucket").parquet(f"{path}/blocks")
    spark = chunks.sparkSession
    words = vocabulary(spark.read.parquet(f"{path}/blocks")).withColumn("bucket", bucket_of(F.col("token"), buckets))
    words.repartition(buckets, "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/words")
    sizes = [_size(spark, f"{path}/{name}") for name in ("blocks", "words")]
    publish(spark.createDataFrame([(identity, n, float(mean), buckets, *sizes)], "identity string, n_chunks long, mean_length double, n_buckets int, block_bytes long, word_bytes long"), f"{path}/facts")


def _size(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def open_index(spark: SparkSession, path: str, identity: str) -> Index:
    """The stored index; an error if it belongs to another corpus or its files aren't as large as they were written. Reads one row of facts."""
    facts = spark.read.parquet(f"{path}/facts").first()
    if facts["identity"] != identity:
        raise ValueError("the index was built for another corpus")
    if [_size(spark, f"{path}/{name}") for name in ("blocks", "words")] != [facts["block_bytes"], facts["word_bytes"]]:
        raise ValueError("the index isn't what was written")
    return Index(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/words"), facts["n_chunks"], facts["mean_length"], facts["n_buckets"])


def batch(questions: DataFrame, chunks: DataFrame, fields: dict[str, Column], weights: dict[str, float], keep) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """(blocks, asked) of BM25 and of token overlap for one batch of questions without a stored index; keep(frame, name) writes a table once.

    Only tokens that a question asks for are looked at, and the chunks' texts once. Token overlap has impact and weight one.
    """
    few, full = lexical.question_terms(questions, STOP_WORDS), lexical.question_terms(questions, QUERY_STOP_WORDS)
    held = keep(lexical.asked_postings([few, full], chunks, fields), "asked-postings")
    facts = lexical.collection(chunks, fields).first()
    n, mean = facts["n_chunks"], facts["mean_length"] or 1.0
    scored = keep(blocks(held, impact(weights, mean), n), "impact-blocks")
    plain = keep(blocks(held, F.lit(1.0), n), "overlap-blocks")
    words = vocabulary(scored)
    return (scored, keep(weighted(full, words, idf(n)), "asked")), (plain, keep(weighted(few, words.withColumn("most", F.lit(1.0)), F.lit(1.0)), "asked"))
