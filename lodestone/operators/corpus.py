"""Building evaluation corpora: near-duplicate groups, leakage-safe splits, quotas and blockers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import has_zone, stable_key
from lodestone.operators.ordering import numbered, running_sum

# Thresholds of the four pair rules, and the targets of the splits in order of priority.
Q_ALONE, A_SHARED_DOCUMENT, Q_SHARED_CHUNK, Q_AND_A = 0.88, 0.92, 0.82, (0.76, 0.88)
SPLIT_TARGETS = {"dev": 300, "test": 100, "acceptance": 100}


def _pair_rules(q, a, same_class, shared_document, shared_chunk) -> tuple:
    """(condition, name) of the rules in order, on columns or on arrays alike."""
    return (
        (q >= Q_ALONE, "QUESTION"),
        (same_class & shared_document & (a >= A_SHARED_DOCUMENT), "ANSWER_AND_DOCUMENT"),
        (shared_chunk & (q >= Q_SHARED_CHUNK), "QUESTION_AND_CHUNK"),
        (same_class & shared_chunk & (q >= Q_AND_A[0]) & (a >= Q_AND_A[1]), "QUESTION_ANSWER_AND_CHUNK"),
    )


def pair_reasons(pairs: DataFrame) -> DataFrame:
    """Pairs with the first rule that links them; pairs: a, b, q, answer (cosines), same_class, shared_document, shared_chunk."""
    rules = _pair_rules(*map(F.col, ("q", "answer", "same_class", "shared_document", "shared_chunk")))
    reason = F.coalesce(*[F.when(c, name) for c, name in rules])
    return pairs.withColumn("reason", reason).where("reason is not null")


def pairs_linked(q: np.ndarray, answer: np.ndarray, same_class: np.ndarray, shared_document: np.ndarray, shared_chunk: np.ndarray) -> np.ndarray:
    """Which pairs any rule of `pair_reasons` links, on arrays in a task; NaN is no cosine."""
    return np.logical_or.reduce([c for c, _ in _pair_rules(q, answer, same_class, shared_document, shared_chunk)])


def components(nodes: DataFrame, links: DataFrame, checkpoint) -> DataFrame:
    """id, component (smallest id reachable); nodes: id, links: a, b. checkpoint(df) cuts the lineage, on shared storage on a cluster.

    Every node takes the smallest label among itself and its neighbours, then the label of that label, until nothing changes; the
    jump halves chains, so rounds grow with the logarithm of their length.
    """
    both = links.select("a", "b").union(links.select("b", "a"))  # repeats don't change a minimum
    label = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = both.join(label, both.b == label.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = label.join(near, "id", "left").select("id", F.least("component", "near").alias("component"))
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = checkpoint(least.join(jump, "component", "left").select("id", F.least("component", "root").alias("component")))
        changed = new.join(label.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty()
        label = new
        if changed:
            return label


def group_ids(members: DataFrame, length: int = 20) -> DataFrame:
    """component, group_id (digest of the sorted members), n_members."""
    ids = F.array_sort(F.collect_list(F.col("id").cast("string")))
    return members.groupBy("component").agg(F.substring(F.sha2(F.array_join(ids, "\n"), 256), 1, length).alias("group_id"), F.count(F.lit(1)).alias("n_members"))


def assign_splits(groups: list[tuple[str, list[tuple[str, str]]]], targets: dict[str, int] = SPLIT_TARGETS) -> dict[str, str]:
    """Split by member, groups kept whole; groups: (key, [(member, former split)]). On a group summary only, as each choice depends on the room left.

    The rule is one table: a row of figures for each group and split, of which the group takes the best split that has room. Groups
    of several come first, the largest first, and look at their members there already, then the share of room left; single members
    only ask whether they were there, then for the most room. Ties go by the order of the splits. Targets must be met exactly.
    """
    names, sizes = list(targets), np.array(list(targets.values()))
    members = [sorted(m) for _, m in groups]
    if sizes.sum() != sum(map(len, members)):
        raise ValueError("targets and members differ in number")
    queue = sorted(members, key=lambda m: (-len(m), m[0]) if len(m) > 1 else (0, m[0]))
    held = np.array([[sum(was == s for _, was in m) for s in names] for m in queue]).reshape(len(queue), len(names))
    room, out = sizes.copy(), {}
    for m, here in zip(queue, held, strict=True):
        fits = room >= len(m)
        if not fits.any():
            raise ValueError("no split has room for a group" if len(m) > 1 else "no split has room left")
        second = room / np.maximum(sizes, 1) if len(m) > 1 else room
        best = np.lexsort((-np.arange(len(names)), second, here, fits))[-1]
        room[best] -= len(m)
        out.update((x, names[best]) for x, _ in m)
    return out


def expanded_quota(quotas: DataFrame, total: int) -> DataFrame:
    """position, value: each value as often as its quota says, positions from 0; quotas: place (order), value, n. Other totals are an error."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a value
    got = quotas.agg(F.sum("n"), F.min("n")).first()
    if got[0] != total or got[1] < 0:
        raise ValueError("quotas must not be negative and must sum to the total")
    rows = quotas.withColumn("_at", before).where("n > 0")
    each = rows.select("_at", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("_i"))
    return each.select((F.col("_at") + F.col("_i")).cast("long").alias("position"), "value")


def shuffled_quota(quotas: DataFrame, total: int, seed: str) -> DataFrame:
    """position, value of the expanded quota in an order by hash of seed and position: reproducible in any engine."""
    df = expanded_quota(quotas, total).withColumn("_key", stable_key(seed, F.col("position")))
    return numbered(df.withColumnRenamed("position", "_was"), ["_key", "_was"]).select("position", "value")


def constrained_assignment(slots: DataFrame, fixed: dict[str, str], ranked: list[tuple[tuple[str, ...] | None, str, int]], rest: str) -> DataFrame:
    """position, kind, value: kinds in `fixed` get their value; of the others the first n by position of each listed kind (None: any) get that value; what is left gets `rest`."""
    df = slots.withColumn("value", F.element_at(F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]), F.col("kind")))
    for kinds, value, n in ranked:
        free = F.col("value").isNull() & (F.lit(True) if kinds is None else F.col("kind").isin(*kinds))
        placed = running_sum(df, free.cast("int"), ["position"], "_place")
        df = placed.withColumn("value", F.when(free & (F.col("_place") <= n), value).otherwise(F.col("value"))).drop("_place")
    return df.withColumn("value", F.coalesce("value", F.lit(rest)))


def decision_errors(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """question_id, code: the first rule that a pre-review decision breaks against its queue entry, none where all hold.

    decisions: question_id, review_id, labels_sha256, outcome, checks (map), corrected, reviewer_id, reviewed_at (text), judged
    (array of chunk_id, document_id, page_start, page_end, supports_claims), claim_ids, citations. queue: question_id, review_id,
    labels_sha256, check_names, proposal, evidence (array of chunk_id, document_id, page_start, page_end).
    """
    q = queue.select("question_id", F.struct("review_id", "labels_sha256", "check_names", "proposal", "evidence").alias("_q"))
    results = F.map_values("checks")
    failed = F.array_contains(results, "FAIL")
    pick = lambda j: F.struct(j["chunk_id"].alias("chunk_id"), j["document_id"].alias("document_id"), j["page_start"].alias("page_start"), j["page_end"].alias("page_end"))
    known = F.transform("_q.evidence", lambda e: e["chunk_id"])
    same = F.transform("_q.evidence", pick)
    edited = ~F.col("corrected").eqNullSafe(F.col("_q.proposal"))
    rules = (
        (F.col("_q").isNull(), "QUEUE_ENTRY_MISSING"),
        (~F.col("review_id").eqNullSafe(F.col("_q.review_id")), "REVIEW_ID_DRIFT"),
        (~F.col("labels_sha256").eqNullSafe(F.col("_q.labels_sha256")), "PROPOSAL_HASH_DRIFT"),
        (~F.coalesce(F.col("outcome").isin("APPROVE_AS_IS", "EDIT_LABELS"), F.lit(False)), "OUTCOME_INCOMPLETE"),
        (F.array_sort(F.map_keys("checks")) != F.array_sort("_q.check_names"), "CHECK_IDENTITY_DRIFT"),
        (F.exists(results, lambda r: ~F.coalesce(r.isin("PASS", "FAIL", "NOT_APPLICABLE"), F.lit(False))), "CHECK_PENDING"),
        ((F.col("outcome") == "APPROVE_AS_IS") & edited, "APPROVED_LABELS_DIFFER"),
        ((F.col("outcome") == "APPROVE_AS_IS") & failed, "APPROVED_WITH_FAILED_CHECK"),
        ((F.col("outcome") == "EDIT_LABELS") & ~edited, "EDIT_WITHOUT_CHANGE"),
        ((F.col("outcome") == "EDIT_LABELS") & ~failed, "EDIT_WITHOUT_FAILED_CHECK"),
        (F.coalesce(F.length("reviewer_id"), F.lit(0)) == 0, "REVIEWER_MISSING"),
        (~has_zone(F.col("reviewed_at")), "REVIEW_TIME_WITHOUT_ZONE"),
        (F.exists("judged", lambda j: ~F.array_contains(known, j["chunk_id"])), "JUDGMENT_OF_UNKNOWN_CHUNK"),
        (F.exists("judged", lambda j: ~F.array_contains(same, pick(j))), "CHUNK_IDENTITY_DRIFT"),
        (F.exists("judged", lambda j: F.size(F.array_except(j["supports_claims"], F.col("claim_ids"))) > 0), "UNKNOWN_CLAIM"),
        (F.size(F.array_except("citations", known)) > 0, "CITATION_OUTSIDE_EVIDENCE"),
    )
    code = F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), name) for broken, name in rules])
    return decisions.join(q, "question_id", "left").select("question_id", code.alias("code")).where("code is not null")


def frozen_input_errors(rows: DataFrame, split: str, n: int, required: DataFrame, categories: dict[str, int]) -> DataFrame:
    """code, detail of what differs from a frozen input: ROW_COUNT, SPLIT, REQUIRED_MISSING, CATEGORY_COUNT; none where all is as frozen.

    rows: question_id, split, category; required: question_id; categories: number of rows of each.
    """
    spark = rows.sparkSession
    text = lambda code, detail: (F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    count = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != n).select(*text("ROW_COUNT", F.col("n")))
    other = rows.where(~F.col("split").eqNullSafe(F.lit(split))).select("split").distinct().select(*text("SPLIT", F.coalesce("split", F.lit("null"))))
    lacking = required.join(rows, "question_id", "left_anti").select(*text("REQUIRED_MISSING", F.col("question_id")))
    want = spark.createDataFrame(list(categories.items()), "category string, want long")
    have = rows.groupBy("category").agg(F.count(F.lit(1)).alias("have"))
    differs = want.join(have, "category", "full_outer").where("coalesce(want, 0) <> coalesce(have, 0)")
    return count.union(other).union(lacking).union(differs.select(*text("CATEGORY_COUNT", F.coalesce("category", F.lit("null")))))


def leaking_groups(items: DataFrame, group: str = "leakage_group_id", split: str = "split") -> DataFrame:
    """Groups whose members stand in more than one split."""
    return items.groupBy(group).agg(F.count_distinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_items")).where("n_splits > 1")


def ratio_blockers(items: DataFrame, targets: DataFrame, column: str, total: int | None = None) -> DataFrame:
    """value, n, ratio, blocked: shares of a column outside [min_ratio, max_ratio]; targets: value, min_ratio, max_ratio. Absent values count 0."""
    n = total if total is not None else items.count()
    have = items.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    df = targets.join(have, "value", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ratio", F.round(F.col("n") / F.lit(max(n, 1)), 6))
    return df.select("value", "n", "ratio", ((F.col("ratio") < F.col("min_ratio")) | (F.col("ratio") > F.col("max_ratio"))).alias("blocked"))


def lineage_errors(annotations: DataFrame) -> DataFrame:
    """annotation_id, code: unknown parent, parent of another question, adjudication with fewer than two parents, own parent.

    annotations: annotation_id, question_id, role, based_on_annotation_ids.
    """
    edges = annotations.select("annotation_id", "question_id", F.explode("based_on_annotation_ids").alias("parent"))
    parents = annotations.select(F.col("annotation_id").alias("parent"), F.col("question_id").alias("parent_question"))
    df = edges.join(parents, "parent", "left")
    code = F.when(F.col("parent") == F.col("annotation_id"), "OWN_PARENT").when(F.col("parent_question").isNull(), "UNKNOWN_PARENT").when(F.col("parent_question") != F.col("question_id"), "OTHER_QUESTION")
    few = annotations.where((F.col("role") == "adjudicator") & (F.size(F.array_distinct("based_on_annotation_ids")) < 2)).select("annotation_id", F.lit("TOO_FEW_PARENTS").alias("code"))
    return df.select("annotation_id", code.alias("code")).where("code is not null").union(few)


def readiness(items: DataFrame, blockers: DataFrame, least_audit: float = 0.10) -> DataFrame:
    """One row: n_items, n_groups, audit_ratio, engineering_ready, lock_ready; items: leakage_group_id, human_audited; blockers: code."""
    n = blockers.agg(F.count(F.lit(1)).alias("n_blockers"))
    df = items.agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("leakage_group_id").alias("n_groups"), F.round(F.avg(F.when(F.col("human_audited"), 1.0).otherwise(0.0)), 6).alias("audit_ratio")).crossJoin(n)
    return df.withColumn("engineering_ready", F.col("n_blockers") == 0).withColumn("lock_ready", (F.col("n_blockers") == 0) & (F.col("audit_ratio") >= least_audit))


def quota_sample(items: DataFrame, quotas: list[tuple[str, str, int]], seed: str) -> DataFrame:
    """A reproducible sample with quotas by category and split, one item a leakage group over all categories.

    quotas: (category, split, n) in order of precedence; items: question_id, category, split, leakage_group_id. Within a category and
    split the order is by hash; a group taken by an earlier quota is passed over. Sampling is the feature here.
    """
    key = stable_key(seed, F.col("category"), F.col("question_id"))
    left = items.withColumn("_key", key)
    out = None
    for category, split, n in quotas:
        mine = left.where((F.col("category") == category) & (F.col("split") == split))
        first = mine.withColumn("_n", F.row_number().over(Window.partitionBy("leakage_group_id").orderBy("_key"))).where("_n = 1").drop("_n")
        got = first.orderBy("_key").limit(n)
        left = left.join(got.select("leakage_group_id"), "leakage_group_id", "left_anti")
        out = got if out is None else out.unionByName(got)
    return out.drop("_key")


def dealt_round_robin(units: DataFrame, pool: DataFrame, unit: str, takes: str, member: str) -> DataFrame:
    """unit, member: each unit takes its number of members from the ordered pool, going on where the one before stopped, around the end."""
    n = pool.count()
    wanted = running_sum(units, F.col(takes), [unit], "_at").withColumn("_at", F.col("_at") - F.col(takes)).where(F.col(takes) > 0).select(unit, F.explode(F.transform(F.sequence(F.lit(0), F.least(F.col(takes), F.lit(n)) - 1), lambda i: ((F.col("_at") + i) % n).cast("int"))).alias("_i"))
    return wanted.join(numbered(pool.select(member), [member], "_i"), "_i").select(unit, member)


def batches(requests: DataFrame, order: str, size: int = 10) -> DataFrame:
    """Adds batch: requests in order, `size` to a batch; for a partitioned sink."""
    return numbered(requests, [order], "batch").withColumn("batch", F.floor(F.col("batch") / size))


def formal_records(rows: DataFrame, groups: DataFrame, splits: DataFrame) -> DataFrame:
    """rows joined with their group and assigned split, and a provenance line; groups: id, group_id; splits: id, assigned_split."""
    df = rows.join(groups, "id").join(splits, "id")
    return df.withColumn("provenance", F.concat_ws(";", F.concat(F.lit("group="), "group_id"), F.concat(F.lit("split="), "assigned_split")))
