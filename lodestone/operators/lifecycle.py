"""Versions, queues and their consistency, as folds over events and comparisons of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import backoff_seconds, plus_seconds

# Allowed changes of a version's status.
TRANSITIONS = (
    ("REGISTERED", "PROCESSING"), ("REGISTERED", "INACTIVE"), ("PROCESSING", "REVIEW"), ("PROCESSING", "READY"), ("PROCESSING", "FAILED"), ("PROCESSING", "INACTIVE"), ("PROCESSING", "PROCESSING"),
    ("REVIEW", "PROCESSING"), ("REVIEW", "FAILED"), ("REVIEW", "INACTIVE"), ("READY", "INACTIVE"), ("FAILED", "PROCESSING"), ("FAILED", "INACTIVE"),
)
BACKENDS = ("elasticsearch", "milvus", "postgresql")


def transition_errors(events: DataFrame, key: str = "version_id") -> DataFrame:
    """key, sequence, code for each event that breaks the state machine or skips a revision.

    events: key, sequence (order), status, revision. The first status must be REGISTERED with revision 1; each further one must be
    allowed after the one before and raise the revision by one.
    """
    order = Window.partitionBy(key).orderBy("sequence")
    before, revision = F.lag("status").over(order), F.lag("revision").over(order)
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    df = events.withColumns({"_before": before, "_revision": revision})
    code = (
        F.when(F.col("_before").isNull() & (F.col("status") != "REGISTERED"), "NOT_REGISTERED")
        .when(F.col("_before").isNotNull() & ~F.array_contains(allowed, F.concat("_before", F.lit(">"), "status")), "TRANSITION_FORBIDDEN")
        .when(F.coalesce("_revision", F.lit(0)) + 1 != F.col("revision"), "REVISION_SKIPPED")
    )
    return df.withColumn("code", code).where("code is not null").select(key, "sequence", "code")


def latest_state(events: DataFrame, key: str = "version_id", columns: tuple[str, ...] = ("status", "revision")) -> DataFrame:
    """key, the columns of its last event, n_events; combined before the shuffle."""
    last = F.max_by(F.struct(*columns), "sequence")
    return events.groupBy(key).agg(last.alias("_l"), F.count(F.lit(1)).alias("n_events")).select(key, *[F.col(f"_l.{c}").alias(c) for c in columns], "n_events")


def upsert(stored: DataFrame, arriving: DataFrame, keys: list[str], newest: dict[str, str] | None = None) -> DataFrame:
    """stored with arriving rows whose keys are new; for known keys, columns named in `newest` take the greater value.

    Repeated arriving keys count once, the row that is smallest in all columns. Identity columns of known keys never change.
    """
    rest = [c for c in arriving.columns if c not in keys]
    one = arriving.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest or keys))).where("_n = 1").drop("_n")
    fresh = one.join(stored, keys, "left_anti")
    if not newest:
        return stored.unionByName(fresh.select(*stored.columns))
    got = arriving.groupBy(*keys).agg(*[F.max(c).alias(f"_{c}") for c in newest])
    known = stored.join(got, keys, "left").select(*[F.greatest(F.col(c), F.col(f"_{c}")).alias(c) if c in newest else F.col(c) for c in stored.columns])
    return known.unionByName(fresh.select(*stored.columns))


def insert_absent(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    return upsert(stored, arriving, keys)


def missing_rows(expected: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows that storage lacks; appending these alone makes a repeated write harmless."""
    return expected.join(stored.select(*keys).distinct(), keys, "left_anti")


def drift(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """side, and the rows that only one side has, repeats counted."""
    a, b = expected.exceptAll(stored), stored.exceptAll(expected)
    return a.withColumn("side", F.lit("EXPECTED_ONLY")).unionByName(b.withColumn("side", F.lit("STORED_ONLY")))


def purged(stored: DataFrame, inactive: DataFrame, keys: list[str]) -> DataFrame:
    """What is left after deleting the rows of inactive versions."""
    return stored.join(inactive.select(*keys).distinct(), keys, "left_anti")


def cleanup_jobs(inactive: DataFrame, keys: tuple[str, ...] = ("owner_id", "document_id", "version_id"), backends: tuple[str, ...] = BACKENDS) -> DataFrame:
    """One PENDING job a version and backend."""
    return inactive.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(b) for b in backends])).alias("backend")).withColumns({"status": F.lit("PENDING"), "attempts": F.lit(0)})


def queue_state(events: DataFrame, most_attempts: int = 5, base: int = 30, cap: int = 3600) -> DataFrame:
    """job_id, attempts, status, next_attempt_at folded from events: job_id, ts, kind (ENQUEUED, CLAIMED, COMPLETED, FAILED).

    A job that completed is SUCCEEDED for good; a failed one is RETRY after base * 2^(attempts - 1) seconds, at most cap, or FAILED
    once its attempts are used up; a claimed one is RUNNING.
    """
    df = events.groupBy("job_id").agg(F.count_if(F.col("kind") == "CLAIMED").alias("attempts"), F.max(F.when(F.col("kind") == "COMPLETED", 1).otherwise(0)).alias("_done"), F.max_by(F.struct("kind", "ts"), F.struct("ts", "kind")).alias("_last"))
    failed = F.col("_last.kind") == "FAILED"
    status = F.when(F.col("_done") == 1, "SUCCEEDED").when(failed & (F.col("attempts") >= most_attempts), "FAILED").when(failed, "RETRY").when(F.col("_last.kind") == "CLAIMED", "RUNNING").otherwise("PENDING")
    due = F.when(status == "RETRY", plus_seconds(F.col("_last.ts"), backoff_seconds(F.col("attempts"), base, cap))).when(status == "PENDING", F.col("_last.ts"))
    return df.select("job_id", "attempts", status.alias("status"), due.alias("next_attempt_at"))


def fenced(events: DataFrame) -> DataFrame:
    """events without the reports of stale workers: a COMPLETED or FAILED counts only with the token of the job's latest claim, once.

    events: job_id, ts, event_id (order of equal times), kind, lease_token. What is left can be folded by queue_state.
    """
    so_far = Window.partitionBy("job_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("kind").isin("COMPLETED", "FAILED")
    df = events.withColumn("_claim", F.last(F.when(F.col("kind") == "CLAIMED", F.struct("ts", "event_id", "lease_token")), ignorenulls=True).over(so_far))
    df = df.withColumn("_valid", ends & F.coalesce(F.col("lease_token") == F.col("_claim.lease_token"), F.lit(False)))
    earlier = Window.partitionBy("job_id", "_claim").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_again", F.coalesce(F.max(F.col("_valid").cast("int")).over(earlier), F.lit(0)) == 1)
    return df.where(~ends | (F.col("_valid") & ~F.col("_again"))).drop("_claim", "_valid", "_again")


def revalidated(routes: DataFrame, versions: DataFrame) -> DataFrame:
    """owner_id, unchanged: whether an owner's READY, active versions after retrieval are exactly the routes that were searched.

    routes: owner_id, document_id, version_id; versions: the same with lifecycle_status and is_active, read anew. Answers of an owner
    whose versions changed must not be given.
    """
    own = ["owner_id", "document_id", "version_id"]
    now = versions.where((F.col("lifecycle_status") == "READY") & F.coalesce("is_active", F.lit(False))).select(*own)
    changed = drift(routes.select(*own), now).select("owner_id", F.lit(True).alias("_changed")).distinct()
    return routes.select("owner_id").distinct().join(changed, "owner_id", "left").select("owner_id", F.col("_changed").isNull().alias("unchanged"))


def online_chunks(chunks: DataFrame, versions: DataFrame, owner: str) -> DataFrame:
    """An owner's chunks of READY, active versions without an end, joined on version, owner and document."""
    live = versions.where((F.col("owner_id") == owner) & (F.col("lifecycle_status") == "READY") & F.coalesce("is_active", F.lit(False)) & F.col("deleted_at").isNull() & F.col("expired_at").isNull())
    return chunks.join(live.select("version_id", "owner_id", "document_id").distinct(), ["version_id", "owner_id", "document_id"], "left_semi")


def migration_plan(wanted: DataFrame, applied: DataFrame) -> DataFrame:
    """migration_id, action: APPLY for what isn't applied, SKIP for the same checksum, DRIFT for another one, which is an error; frames: migration_id, sha256."""
    df = wanted.join(applied.select("migration_id", F.col("sha256").alias("_had")), "migration_id", "left")
    return df.select("migration_id", F.when(F.col("_had").isNull(), "APPLY").when(F.col("_had") == F.col("sha256"), "SKIP").otherwise("DRIFT").alias("action"))


def ingestion_outcomes(steps: DataFrame, order: tuple[str, ...] = ("REGISTER", "PARSE", "EMBED", "INDEX", "VERIFY")) -> DataFrame:
    """version_id, status, failure_code, failed_step of ingestions whose steps run in order and stop at the first failure.

    steps: version_id, step, ok, failure_code. All steps done: READY. A step failed: FAILED with its code (UNEXPECTED_FAILURE where it
    has none), whatever later steps say. Otherwise PROCESSING.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("step"))
    failed = F.when(~F.coalesce("ok", F.lit(False)), F.struct(place.alias("p"), "step", F.coalesce("failure_code", F.lit("UNEXPECTED_FAILURE")).alias("code")))
    df = steps.where(place > 0).groupBy("version_id").agg(F.min(failed).alias("f"), F.count_distinct(F.when(F.col("ok"), F.col("step"))).alias("done"))
    status = F.when(F.col("f").isNotNull(), "FAILED").when(F.col("done") == len(order), "READY").otherwise("PROCESSING")
    return df.select("version_id", status.alias("status"), F.col("f.code").alias("failure_code"), F.col("f.step").alias("failed_step"))


def recovered(jobs: DataFrame, now) -> DataFrame:
    """Jobs with leases that ended by `now` put back to RETRY, or FAILED once their attempts are used up."""
    ended = (F.col("status") == "RUNNING") & (F.col("lease_expires_at") <= now)
    status = F.when(ended & (F.col("attempts") >= F.col("max_attempts")), "FAILED").when(ended, "RETRY").otherwise(F.col("status"))
    return jobs.withColumn("status", status).withColumn("lease_expires_at", F.when(~ended, F.col("lease_expires_at")))


def due_jobs(jobs: DataFrame, now, by: list[str], n: int = 1) -> DataFrame:
    """The first n due jobs of each group, by next attempt, then time of creation, then id."""
    due = jobs.where(F.col("status").isin("PENDING", "RETRY") & (F.col("next_attempt_at") <= now))
    return due.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("next_attempt_at", "created_at", "job_id"))).where(F.col("_n") <= n).drop("_n")


def reconcile(requested: DataFrame, ready: DataFrame, routes: dict[str, DataFrame], key: str = "document_id") -> DataFrame:
    """key, whether requested, READY and in each physical index, and consistent: all of these or none."""
    df = requested.select(key).distinct().withColumn("requested", F.lit(True))
    for name, frame in {"ready": ready, **routes}.items():
        df = df.join(frame.select(key).distinct().withColumn(name, F.lit(True)), key, "full_outer")
    names = ["requested", "ready", *routes]
    df = df.select(key, *[F.coalesce(n, F.lit(False)).alias(n) for n in names])
    all_ = F.lit(True)
    for n in names:
        all_ = all_ & F.col(n)
    return df.withColumn("consistent", all_)


def scope_proof(versions: DataFrame, jobs: DataFrame, backends: tuple[str, ...] = BACKENDS) -> DataFrame:
    """version_id, backend, side of jobs that are missing or foreign against versions x backends."""
    want = versions.select("version_id").distinct().select("version_id", F.explode(F.array(*[F.lit(b) for b in backends])).alias("backend"))
    have = jobs.select("version_id", "backend")
    return drift(want, have)


def audit(jobs: DataFrame, versions: DataFrame) -> DataFrame:
    """One row: active versions, not inactive ones, unfinished jobs, and CLEAN or RESIDUAL."""
    v = versions.agg(F.count_if(F.col("is_active")).alias("n_active"), F.count_if(F.col("status") != "INACTIVE").alias("n_not_inactive"))
    j = jobs.agg(F.count_if(~F.col("status").isin("SUCCEEDED", "FAILED")).alias("n_unfinished"))
    return v.crossJoin(j).withColumn("decision", F.when((F.col("n_active") == 0) & (F.col("n_not_inactive") == 0) & (F.col("n_unfinished") == 0), "CLEAN").otherwise("RESIDUAL"))


def recovery_checks(versions: DataFrame, jobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: before (all inactive, jobs = versions x backends, all PENDING without attempts) and after (all SUCCEEDED, no snapshot row)."""
    v = versions.agg(F.count(F.lit(1)).alias("n_versions"), F.count_if(F.col("status") != "INACTIVE").alias("n_live"))
    j = jobs.agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if((F.col("status") == "PENDING") & (F.col("attempts") == 0)).alias("n_fresh"), F.count_if(F.col("status") == "SUCCEEDED").alias("n_done"))
    s = snapshots.agg(F.count(F.lit(1)).alias("n_rows"))
    df = v.crossJoin(j).crossJoin(s)
    before = (F.col("n_live") == 0) & (F.col("n_jobs") == F.col("n_versions") * len(BACKENDS)) & (F.col("n_fresh") == F.col("n_jobs"))
    return df.select(before.alias("before"), ((F.col("n_done") == F.col("n_jobs")) & (F.col("n_rows") == 0)).alias("after"))
