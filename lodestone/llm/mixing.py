"""Mixing sources to target weights by entropy balancing.

Of all rates r >= 0 that give each group its target tokens, with no rate above `cap`, those nearest to one in relative entropy, a
document of s tokens weighing s + half, are r = min(cap, exp(lambda * s / (s + half))): tilted exponentially by the document's own
size, lambda being the sum of the multipliers of the document's groups. Short documents stay near rate one and long ones approach
exp(lambda), so that no document is driven out by its length alone; `half` is the corpus's mean size unless given. The multipliers
minimise a convex dual; Newton steps with a line search find them, each step's gradient and Hessian being sums that Spark takes
over the token counts by group and size. One column of groups gives a diagonal Hessian, more columns (source and language, say) a
full one. Sums are of decimals, so that their order doesn't matter and reruns agree.

Rates then become whole copies: the whole part, and one more for the documents that come first in an order by hash, as many as
bring each source nearest to its target; four classes of length, one after the other, leave but a short document's error, which a
few single exchanges then mend.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import cut, n_words

#: Bits of the rounding order: so many from the hash of identifier and text, the rest from the row's place, which parts equal rows.
HASH_BITS, PLACE_BITS, STEP_BITS = 36, 24, 12
#: Rounding goes from long documents to short ones: what the longer ones take too much or too little, the shorter ones make up for.
TIERS = (512, 128, 32)


def weight_targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> dict:
    """Target tokens by group: groups in code point order, null last, weigh `weights` in turn and share all tokens.

    A target stops at `most` times its group's size, and what is over is shared again by weight until none is above.
    """
    order = sorted(sizes, key=lambda g: (g is None, "" if g is None else g))
    weight = {g: weights[i % len(weights)] for i, g in enumerate(order)}
    rest, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        share = rest / sum(weight[g] for g in open_)
        full = [g for g in open_ if weight[g] * share > most * sizes[g]]
        if not full:
            return out | {g: weight[g] * share for g in open_}
        for g in full:
            out[g] = most * float(sizes[g])
            rest -= out[g]
        open_ = [g for g in open_ if g not in out]
    return out


def group_sizes(sized: DataFrame, column: str, most_groups: int) -> dict:
    """Tokens by group, collected: the number of groups must stay under `most_groups`."""
    rows = sized.groupBy(column).agg(F.sum("size").alias("n")).limit(most_groups + 1).collect()
    if len(rows) > most_groups:
        raise ValueError(f"{column} has more than {most_groups} groups")
    return {r[0]: r[1] for r in rows}


def _table(spark, column: str, values: dict, name: str) -> DataFrame:
    return spark.createDataFrame([(g, float(v)) for g, v in values.items()], f"`{column}` string, `{name}` double")


def _null_safe(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Left join on a column whose null is a group too; the right side is one row a group, so at most `most_groups` rows, and broadcast."""
    renamed = F.broadcast(right.withColumnRenamed(column, "_group"))
    return left.join(renamed, left[column].eqNullSafe(renamed["_group"]), "left").drop("_group")


def half_size(sized: DataFrame) -> float:
    """Mean size of the documents with a word; 1 without any."""
    n, words = sized.where("size > 0").agg(F.count(F.lit(1)), F.sum("size")).first()
    return max(1.0, words / n) if n else 1.0


def _exact(col: Column) -> Column:
    """A sum of a column's values that doesn't depend on their order."""
    return F.sum(col.cast("decimal(30,9)")).cast("double")


#: Multiplier of a group whose target is the cap itself: every rate reaches the cap.
_AT_CAP = 1e6


def solve(sized: DataFrame, targets: dict[str, dict], cap: float = 3.0, half: float | None = None, tolerance: float = 1e-9, most_steps: int = 60) -> dict[str, dict]:
    """Multipliers by column and group for rates that meet the targets; groups without tokens get zero.

    Targets of several columns must agree (the same total, reachable under the cap); what cannot be met is met as nearly as the
    last step came, with a warning where `most_steps` ended the search.
    """
    spark, columns = sized.sparkSession, list(targets)
    half = half_size(sized) if half is None else half
    tilt = F.col("size") / (F.col("size") + half)
    cells = cut(sized.where("size > 0").groupBy(*columns, "size").agg(F.sum("size").cast("double").alias("tokens")).withColumn("u", tilt), "mix-cells")
    names = [(c, g) for c in columns for g in targets[c]]
    at = {x: i for i, x in enumerate(names)}
    goal = np.array([targets[c][g] for c, g in names], float)
    scale = max(goal.sum() / max(len(columns), 1), 1.0)

    def sums(lam: np.ndarray):
        """Dual value, tokens by group and, by pairs of groups, how fast they grow with the multipliers."""
        df = cells
        for c in columns:
            df = _null_safe(df, _table(spark, c, {g: lam[at[c, g]] for g in targets[c]}, f"lam_{c}"), c)
        eta = sum((F.coalesce(F.col(f"lam_{c}"), F.lit(0.0)) for c in columns), F.lit(0.0)) * F.col("u")
        top = F.lit(math.log(cap))
        rate = F.exp(F.least(eta, top))
        value = F.col("tokens") / F.col("u") * (rate + cap * F.greatest(eta - top, F.lit(0.0)))
        df = df.select(*columns, (F.col("tokens") * rate).alias("taken"), F.when(eta < top, F.col("tokens") * F.col("u") * rate).otherwise(0.0).alias("moves"), value.alias("value"))
        total, taken = 0.0, np.zeros(len(names))
        h = np.zeros((len(names),) * 2 if len(columns) > 1 else len(names))
        for i, c in enumerate(columns):
            for r in df.groupBy(c).agg(_exact(F.col("taken")), _exact(F.col("moves")), _exact(F.col("value"))).collect():
                k = at[c, r[0]]
                taken[k] = r[1]
                h[(k, k) if h.ndim == 2 else k] = r[2]
                total += r[3] if i == 0 else 0.0
            for d in columns[:i] if h.ndim == 2 else []:
                for r in df.groupBy(c, d).agg(_exact(F.col("moves"))).collect():
                    h[at[c, r[0]], at[d, r[1]]] = h[at[d, r[1]], at[c, r[0]]] = r[2]
        return total - lam @ goal, taken, h

    lam, open_ = np.zeros(len(names)), np.ones(len(names), bool)
    value, taken, h = sums(lam)
    if len(columns) == 1:  # groups are independent: start from the answer for a group of equal documents, leave out those at the cap
        open_ = (taken > 0) & (goal < cap * taken * (1 - 1e-9))
        some = open_ & (goal > 0)
        lam[some] = np.log(goal[some] / taken[some]) * taken[some] / h[some]
        lam[(taken > 0) & ~open_] = _AT_CAP
        value, taken, h = sums(lam)
    for _ in range(most_steps):
        slope = np.where(open_, taken - goal, 0.0)
        if np.abs(slope).max(initial=0.0) <= tolerance * scale:
            break
        ridge = 1e-12 * scale + 1e-9 * np.abs(slope)
        step = -slope / (h + ridge) if h.ndim == 1 else -np.linalg.solve(h + np.diag(ridge), slope)
        pace = np.maximum(taken / np.maximum(h if h.ndim == 1 else np.diag(h), 1e-9 * scale), 1.0)  # 1 / tilt of a group's typical document
        step = np.where(open_, np.clip(step, -2.0 * pace, 2.0 * pace), 0.0)
        size = 1.0
        while True:
            new = lam + size * step
            v, t, k = sums(new)
            if v <= value + 1e-4 * size * (slope @ step) + 1e-12 * abs(value) or size < 1e-6:
                break
            size /= 2
        if np.array_equal(new, lam):
            break
        lam, value, taken, h = new, v, t, k
    else:
        warnings.warn(f"the mix is off its targets by up to {np.abs(np.where(open_, taken - goal, 0.0)).max(initial=0.0):.6g} tokens after {most_steps} steps", stacklevel=2)
    return {c: {g: float(lam[at[c, g]]) for g in targets[c]} for c in columns}


def sized_rows(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """The columns to keep, the groups as strings, size (words) and place (the row's key in the order of rounding)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    high = F.shiftrightunsigned(F.xxhash64(F.col(id_col), text), 64 - HASH_BITS)
    low = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - PLACE_BITS)
    groups = [F.col(c).cast("string").alias(c) for c in columns if c not in keep]
    return docs.select(*[F.col(c) for c in keep], *groups, n_words(F.col(text_col)).alias("size"), high.alias("_hash"), low.alias("_tie"))


def with_rates(sized: DataFrame, lam: dict[str, dict], cap: float, half: float) -> DataFrame:
    """Adds rate, whole copies and key: documents are given one copy more in ascending key while their source lacks tokens.

    The key rises with hash / fraction, so that a document's chance is its rate's fraction; without a fraction it is null.
    """
    df, spark = sized, sized.sparkSession
    for c, values in lam.items():
        df = _null_safe(df, _table(spark, c, values, f"lam_{c}"), c)
    eta = sum((F.coalesce(F.col(f"lam_{c}"), F.lit(0.0)) for c in lam), F.lit(0.0))
    eta = eta * F.col("size") / (F.col("size") + half)  # a document without a word keeps rate one
    df = df.withColumn("rate", F.least(F.exp(F.least(eta, F.lit(math.log(cap)))), F.lit(float(cap)))).drop(*[f"lam_{c}" for c in lam])
    df = df.withColumn("whole", F.floor(F.col("rate") + 1e-9))
    part = F.col("rate") - F.col("whole")
    v = (F.col("_hash") + 0.5) / float(1 << HASH_BITS) / part
    spread = F.floor(v / (v + 1) * float(1 << HASH_BITS)).cast("long")
    key = F.shiftleft(spread, PLACE_BITS).bitwiseOR(F.col("_tie"))
    return df.withColumn("key", F.when((part > 1e-9) & (F.col("size") > 0), key)).drop("_hash", "_tie")


def cut_keys(rows: DataFrame, column: str, need: dict, residue: int = 1_000) -> dict:
    """By group (largest key taken, tokens taken), so that the rows up to the key come nearest to the tokens needed.

    Histograms of the keys' leading bits, refined 12 bits at a time within the bucket where the need is crossed, leave a few rows a
    group, which are ordered outright; only sums by group and bucket are shuffled, however large a group is.
    """
    spark = rows.sparkSession
    bits, state = HASH_BITS + PLACE_BITS, {g: (0, float(n)) for g, n in need.items()}
    while True:
        table = spark.createDataFrame([(g, p, n) for g, (p, n) in state.items()], f"`{column}` string, _prefix long, _need double")
        inside = _null_safe(rows, table, column).where(F.shiftrightunsigned("key", bits) == F.col("_prefix"))
        most = inside.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= residue or bits < STEP_BITS:
            break
        bits -= STEP_BITS
        sums = inside.groupBy(column, "_need", F.shiftrightunsigned("key", bits).alias("bucket")).agg(F.sum("size").alias("n"))
        before = F.sum("n").over(Window.partitionBy(column).orderBy("bucket")) - F.col("n")  # at most 4,096 rows a group
        crossed = sums.withColumn("before", before).groupBy(column).agg(F.max_by(F.struct("bucket", (F.col("_need") - F.col("before")).alias("left")), F.when(F.col("before") <= F.greatest("_need", F.lit(0.0)), F.col("bucket"))).alias("x"))
        found = {r[0]: (r["x"]["bucket"], r["x"]["left"]) for r in crossed.collect()}
        state = {g: found.get(g, (p << STEP_BITS, n)) for g, (p, n) in state.items()}
    running = F.sum("size").over(Window.partitionBy(column).orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("sum", running).where(F.col("sum") - F.col("size") / 2 <= F.col("_need")).groupBy(column).agg(F.max("key"), F.max("sum"))
    found = {r[0]: (r[1], need[r[0]] - state[r[0]][1] + r[2]) for r in last.collect()}
    return {g: found.get(g, ((p << bits) - 1, need[g] - n)) for g, (p, n) in state.items()}


class Mix:
    """A solved mix: targets, multipliers and cut keys; apply() gives every row its copies."""

    def __init__(self, docs: DataFrame, column: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", most_groups: int = 1_000_000, half: float | None = None, whole_rows: bool = False):
        """With `whole_rows` the rows are written as they are beside their key, for documents(); else identifier and size only, for table()."""
        self.column, self.cap, self.own = column, cap, docs.columns
        kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row") if whole_rows else F.col(id_col).alias("_id")
        # written once with its key: whatever splits a later job reads, each of equal rows keeps its own place in the order of rounding
        self.sized = cut(sized_rows(docs.select(kept, *dict.fromkeys((id_col, column, text_col))), [column], id_col, text_col, keep=["_row" if whole_rows else "_id"]), "mix-rows")
        self.sizes = group_sizes(self.sized, column, most_groups)
        self.targets = weight_targets(self.sizes, weights, cap)
        self.half = half_size(self.sized) if half is None else half
        self.lam = solve(self.sized, {column: self.targets}, cap, self.half)
        rated = cut(with_rates(self.sized, self.lam, cap, self.half).select(column, "key", "size", "whole", self._tier().alias("tier"), (F.col("rate") - F.col("whole")).alias("part")), "mix-keys")
        rounded = {(r[0], r[1]): r[2] for r in rated.where("key is not null").groupBy(column, "tier").agg(_exact(F.col("size") * F.col("part"))).collect()}
        self.cuts: list[dict] = []
        over = dict.fromkeys(self.targets, 0.0)
        for tier in range(len(TIERS) + 1):
            need = {g: rounded.get((g, tier), 0.0) - over[g] for g in self.targets}
            cuts = cut_keys(rated.where((F.col("tier") == tier) & F.col("key").isNotNull()).select(column, "key", "size"), column, need)
            over = {g: cuts[g][1] - need[g] for g in self.targets}
            self.cuts.append({g: k for g, (k, _) in cuts.items()})
        self.flips = self._mended(rated, over)

    def _mended(self, rated: DataFrame, over: dict, rounds: int = 3) -> dict:
        """By group keys whose copy is given or taken back against the cut, one a round, where that brings the group nearer to its target."""
        spark, flips = rated.sparkSession, {g: [] for g in self.targets}
        tiers = range(len(TIERS) + 1)
        for _ in range(rounds):
            rows = [(g, float(over[g]), flips[g], [self.cuts[t][g] for t in tiers]) for g in self.targets]
            state = spark.createDataFrame(rows, f"`{self.column}` string, _over double, _flips array<long>, _cuts array<long>")
            df = _null_safe(rated.where("key is not null"), state, self.column)
            given = (F.col("key") <= F.get("_cuts", F.col("tier"))) != F.array_contains("_flips", F.col("key"))
            change = F.when(given, -F.col("size")).otherwise(F.col("size"))
            left = F.abs(F.col("_over") + change)
            best = df.where(left < F.abs("_over")).groupBy(self.column).agg(F.min_by(F.struct("key", change.alias("change")), F.struct(left, "key")).alias("x"))
            found = best.collect()
            for r in found:
                over[r[0]] += r["x"]["change"]
                flips[r[0]] = [k for k in flips[r[0]] if k != r["x"]["key"]] + [r["x"]["key"]] * (r["x"]["key"] not in flips[r[0]])
            if not found:
                break
        return flips

    @staticmethod
    def _tier():
        return sum((F.when(F.col("size") <= s, 1).otherwise(0) for s in TIERS), F.lit(0))

    def copies(self, sized: DataFrame) -> DataFrame:
        tiers = range(len(TIERS) + 1)
        rows = [(g, float(self.targets[g]), int(self.sizes[g]), *(self.cuts[t][g] for t in tiers), self.flips[g]) for g in self.targets]
        cuts = sized.sparkSession.createDataFrame(rows, f"`{self.column}` string, target double, source_size long, " + ", ".join(f"_cut{t} long" for t in tiers) + ", _flips array<long>")
        rated = _null_safe(with_rates(sized, self.lam, self.cap, self.half), cuts, self.column)
        given = (F.col("key") <= F.get(F.array(*[f"_cut{t}" for t in tiers]), self._tier())) != F.array_contains("_flips", F.col("key"))
        more = F.when(given, 1).otherwise(0)
        return rated.withColumn("copies", (F.col("whole") + more).cast("int")).drop("key", "whole", "_flips", *[f"_cut{t}" for t in tiers])

    def table(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, rate, copies of every row. Null texts have size 0; no rows give no rows."""
        cols = [F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate", "copies"]
        return self.copies(self.sized).select(*cols)

    def documents(self) -> DataFrame:
        """Every row as often as it has copies, with its columns as they are; of a mix made with `whole_rows`."""
        many = self.copies(self.sized).where("copies > 0").select(F.explode(F.array_repeat("_row", F.col("copies"))).alias("_row"))
        return many.select("_row.*")
