"""The review loop: what to ask, what was decided, and what the decisions teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.55, 0.95


def priority(p: Column, name_score: Column, pin_equal: Column) -> Column:
    """0.6 x uncertainty + 0.4 x disagreement between name and pin, rounded to four places."""
    uncertainty = F.greatest(F.lit(0.0), 1 - F.abs(p - 0.775) / 0.15)
    disagreement = F.coalesce(F.abs(name_score - pin_equal), F.lit(0.5))
    return F.round(0.6 * uncertainty + 0.4 * disagreement, 4)


def enqueue(scored: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """Pairs in the review band, each once, that are not queued yet; highest priority first."""
    keys = ["canonical_id_a", "canonical_id_b"]
    rows = scored.where((F.col("p") >= LOW) & (F.col("p") < HIGH)).groupBy(*keys).agg(F.max("p").alias("p"), F.max("name_score").alias("name_score"), F.max("pin_equal").alias("pin_equal"))
    if queue is not None:
        rows = rows.join(queue.select(*keys), keys, "left_anti")
    rows = rows.select(*keys, "p", priority(F.col("p"), F.col("name_score"), F.col("pin_equal")).alias("priority"), F.lit("pending").alias("status"))
    return rows.orderBy(F.desc("priority"), *keys)


def pending_items(queue: DataFrame, records: DataFrame, low_stakes: float | None = None, limit: int | None = None) -> DataFrame:
    """What a reviewer is shown: pending pairs of the queue with the names and sources of both records, the
    highest priority first; with `low_stakes` only pairs up to that priority, the most certain first (for
    juniors). Pairs one of whose records is gone are left out."""
    rows = queue.where("status = 'pending'")
    order = [F.desc("priority")]
    if low_stakes is not None:
        rows, order = rows.where(F.col("priority") <= low_stakes), [F.desc("p")]
    for s in "ab":
        rows = rows.join(records.select(F.col("canonical_id").alias(f"canonical_id_{s}"), F.col("name_raw").alias(f"name_{s}"), F.col("source_system").alias(f"source_{s}")), f"canonical_id_{s}")
    rows = rows.orderBy(*order, "canonical_id_a", "canonical_id_b")
    return rows if limit is None else rows.limit(limit)


def decision_log(log: DataFrame, records: DataFrame) -> DataFrame:
    """Decisions with the names of both records, latest first; records that are gone leave the name NULL."""
    for s in "ab":
        log = log.join(records.select(F.col("canonical_id").alias(s), F.col("name_raw").alias(f"name_{s}")), s, "left")
    return log.orderBy(F.desc("decided_at"), "a", "b")


def retrain_report(before: DataFrame, after: DataFrame, labels: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Quality of the scores before and after a retraining on the same labelled pairs: run, precision, recall,
    f1, brier. Scores: a, b, p; labels: a, b, y."""
    runs = None
    for name, scores in (("before", before), ("after", after)):
        own = scores.join(labels, ["a", "b"]).withColumn("run", F.lit(name)).select("run", "p", "y")
        runs = own if runs is None else runs.unionByName(own)
    hit, true = F.col("p") >= threshold, F.col("y") == 1
    out = runs.groupBy("run").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    share = lambda n, d: F.round(F.when(d > 0, n / d).otherwise(0.0), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("run", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), F.round("brier", 4).alias("brier"))


def retrain_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The latest retraining runs (started_at, ...), newest first."""
    return runs.orderBy(F.desc("started_at")).limit(limit)


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last decision of each unordered pair: a, b, decision, reviewer, tier, decided_at."""
    rows = log.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct("decided_at", "decision", "reviewer", "tier").alias("d"))
    return rows.groupBy("a", "b").agg(F.max("d").alias("d")).select("a", "b", "d.*")


def apply_decisions(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(constraints, labels, queue status) a decision log amounts to. confirm: must-link, label 1;
    reject: cannot-link, label 0; defer by a junior: pending again, priority raised by 0.3 each time;
    flag_quality: logged only."""
    ruled = log.where(F.col("decision").isin("confirm", "reject"))
    last = latest_decisions(ruled)
    yes = F.col("decision") == "confirm"
    constraints = last.select("a", "b", F.when(yes, "must_link").otherwise("cannot_link").alias("constraint"))
    labels = last.select("a", "b", yes.cast("int").alias("label"), "decided_at")
    latest = latest_decisions(log.where(F.col("decision") != "flag_quality"))
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    raised = log.where("decision = 'defer' AND tier = 'junior'").groupBy(*pair).agg(F.least(F.lit(1.0), 0.3 * F.count(F.lit(1))).alias("raise"))
    status = F.when(F.col("decision").isin("confirm", "reject"), "decided").when(F.col("tier") == "junior", "pending").otherwise("deferred")
    queue = latest.join(raised, ["a", "b"], "left").select("a", "b", status.alias("status"), F.coalesce("raise", F.lit(0.0)).alias("priority_raise"))
    return constraints, labels, queue


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pending").alias("pending")).withColumn("decided", F.col("total") - F.col("pending"))


def leaderboard(log: DataFrame, decisions: tuple[str, ...] = ("confirm", "reject", "defer", "flag_quality")) -> DataFrame:
    """Decisions by reviewer and tier, a column per decision, missing ones 0."""
    return log.groupBy("reviewer", "tier").pivot("decision", list(decisions)).agg(F.count(F.lit(1))).fillna(0)


def label_budget(labels: DataFrame, last_retrain) -> DataFrame:
    """total, since the last retraining (a timestamp or None), and a recommendation."""
    new = F.count_if(F.col("decided_at") > F.lit(last_retrain)) if last_retrain is not None else F.count(F.lit(1))
    advice = F.when(F.col("since") == 0, "nothing_new").when(F.col("since") < 20, "wait").when(F.col("since") < 200, "retrain_soon").otherwise("retrain_now")
    return labels.agg(F.count(F.lit(1)).alias("total"), new.alias("since")).withColumn("recommendation", advice)


def audit_timeline(links: DataFrame, decisions: DataFrame, constraints: DataFrame) -> DataFrame:
    """at, kind, detail of all three logs, latest first."""
    parts = [f.select("at", F.lit(k).alias("kind"), F.col("detail").cast("string").alias("detail")) for f, k in ((links, "link"), (decisions, "decision"), (constraints, "constraint"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(F.desc("at"), "kind", "detail")


def training_pairs(truth: DataFrame, negatives_per_positive: int = 3, seed: int = 42) -> DataFrame:
    """a, b, label from (record, entity): all pairs within an entity, and pseudo-random pairs across
    entities: every record is paired with others `negatives_per_positive` times by hashed position, so
    no cross product is formed and the draw is repeatable."""
    a = truth.select("entity", F.col("record").alias("a"))
    b = truth.select("entity", F.col("record").alias("b"))
    positive = a.join(b, "entity").where("a < b").select("a", "b", F.lit(1).alias("label"))
    parts = [positive]
    buckets = F.lit(max(1, truth.count() // 2))
    for i in range(negatives_per_positive):
        at = lambda c, side: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.lit(side), c), buckets)  # noqa: E731, B023
        left = truth.select(F.col("record").alias("a"), F.col("entity").alias("ea"), at(F.col("record"), 0).alias("k"))
        right = truth.select(F.col("record").alias("b"), F.col("entity").alias("eb"), at(F.col("record"), 1).alias("k"))
        parts.append(left.join(right, "k").where("ea <> eb AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def holdout(pairs: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) by hash of the pair: disjoint and the same at every run."""
    at = F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(1000)) < int(share * 1000)
    return pairs.where(~at), pairs.where(at)


def pair_evidence(membership: DataFrame, scored: DataFrame, constraints: DataFrame) -> DataFrame:
    """Pairs within identities with their latest probability and constraint, if any."""
    a, b = membership.select("ubid", F.col("canonical_id").alias("a")), membership.select("ubid", F.col("canonical_id").alias("b"))
    pairs = a.join(b, "ubid").where("a < b")
    scores = scored.select(F.least("canonical_id_a", "canonical_id_b").alias("a"), F.greatest("canonical_id_a", "canonical_id_b").alias("b"), F.struct("scored_at", "calibrated_probability").alias("s"))
    scores = scores.groupBy("a", "b").agg(F.max("s")["calibrated_probability"].alias("probability"))
    return pairs.join(scores, ["a", "b"], "left").join(constraints.select("a", "b", "constraint"), ["a", "b"], "left").select("ubid", "a", "b", "probability", "constraint")
