"""Analytical queries over identities, records, verdicts and events, and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_businesses(
    identities: DataFrame, records: DataFrame, events: DataFrame, verdict: str = "active", pin: str | None = None, district: str | None = None,
    sector: str | None = None, source: str | None = None, no_event_type: str | None = None, days: int = 365, reference: str | None = None,
    limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """ubid, verdict, score, pin_code, district, n_records, total: identities of a verdict, filtered by
    what is given. `source`: has a record there. `no_event_type`: none such event in the last `days`
    days before `reference`. Ordered by score and ubid; total counts all rows before paging."""
    rows = identities.where(F.col("verdict") == verdict)
    if pin:
        rows = rows.where(F.col("pin_code") == pin)
    if district:
        rows = rows.where(F.lower("district") == district.lower())
    if sector:
        rows = rows.where(F.contains(F.lower("sector"), F.lit(sector.lower())))
    if source:
        rows = rows.join(records.where(F.col("source_system") == source).select("ubid"), "ubid", "left_semi")
    if no_event_type:
        recent = events.where((F.col("event_type") == no_event_type) & (F.col("event_date") >= F.date_sub(F.lit(reference).cast("date"), days)) & F.col("ubid").isNotNull())
        rows = rows.join(recent.select("ubid"), "ubid", "left_anti")
    members = records.groupBy("ubid").agg(F.count("canonical_id").alias("n_records"))
    rows = rows.join(members, "ubid", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc("score"), "ubid")
    if offset:
        page = page.offset(offset)
    if limit is not None:
        page = page.limit(limit)
    return page.crossJoin(F.broadcast(total)).select("ubid", "verdict", "score", "pin_code", "district", "n_records", "total")  # total: one row


def listing(
    identities: DataFrame, records: DataFrame, constraints: DataFrame, min_records: int = 1, source: str | None = None, search: str | None = None, audit: str | None = None,
) -> DataFrame:
    """One row per identity: verdict (default 'unknown'), sources, a name, number of records, must-linked
    pairs inside it, and audit status: singleton, approved (every pair must-linked) or pending.
    The filter 'pending' also keeps singletons."""
    held = records.where("ubid IS NOT NULL")
    if source:
        held = held.join(held.where(F.col("source_system") == source).select("ubid").distinct(), "ubid", "left_semi")
    if search:
        held = held.join(held.where(F.contains(F.lower("name_raw"), F.lit(search.lower()))).select("ubid").distinct(), "ubid", "left_semi")
    grouped = held.groupBy("ubid").agg(
        F.array_join(F.sort_array(F.collect_set("source_system")), ",").alias("sources"),
        F.max("name_raw").alias("name"),
        F.count(F.lit(1)).alias("n_records"),
    )
    la = records.select(F.col("canonical_id").alias("a"), F.col("ubid").alias("ua"))
    lb = records.select(F.col("canonical_id").alias("b"), F.col("ubid").alias("ub"))
    inside = constraints.where("constraint = 'must_link'").join(la, "a").join(lb, "b").where("ua = ub").groupBy(F.col("ua").alias("ubid")).agg(F.count(F.lit(1)).alias("n_must"))
    rows = grouped.where(F.col("n_records") >= min_records).join(inside, "ubid", "left").join(identities.select("ubid", "verdict"), "ubid", "left")
    must = F.coalesce("n_must", F.lit(0))
    approved = (F.col("n_records") >= 2) & (F.col("n_records") * (F.col("n_records") - 1) / 2 == must)
    if audit == "approved":
        rows = rows.where(approved)
    elif audit == "pending":
        rows = rows.where(~approved)
    status = F.when(F.col("n_records") < 2, "singleton").when(approved, "approved").otherwise("pending")
    return rows.select("ubid", F.coalesce("verdict", F.lit("unknown")).alias("verdict"), "sources", "name", "n_records", must.alias("n_must"), status.alias("audit_status"))


def audit_size(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n == 2, "2").when(n == 3, "3").when(n <= 5, "4-5").when(n <= 10, "6-10").otherwise("11+")


def lookup(records: DataFrame, source: str | None = None, record: str | None = None, pan: str | None = None, pin_name: str | None = None, limit: int = 10) -> DataFrame:
    """ubid by source and record id, else by PAN (own or derived), else by pin|prefix block key."""
    if source and record:
        hit = (F.col("source_system") == source) & (F.col("source_record_id") == record)
    elif pan:
        hit = (F.col("pan") == pan) | (F.col("legal_entity_pan") == pan)
    else:
        hit = F.col("blocking_pin_name") == pin_name
    return records.where(hit & F.col("ubid").isNotNull()).select("ubid").distinct().orderBy("ubid").limit(limit)


def legal_entities(records: DataFrame) -> DataFrame:
    """PAN-anchored parents: legal_entity_pan, its identities and sources."""
    return records.where("legal_entity_pan IS NOT NULL").groupBy("legal_entity_pan").agg(
        F.count_distinct("ubid").alias("n_identities"), F.sort_array(F.collect_set("ubid")).alias("ubids"), F.sort_array(F.collect_set("source_system")).alias("sources")
    )


def platform_stats(identities: DataFrame, records: DataFrame) -> DataFrame:
    """metric, key, n: identities and records in all, identities by verdict, records by source."""
    one = lambda frame, metric, key: frame.groupBy(F.lit(metric).alias("metric"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    parts = [one(identities, "identities", F.lit("all")), one(records, "records", F.lit("all")), one(identities, "verdict", F.col("verdict")), one(records, "source", F.col("source_system"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def event_summary(events: DataFrame) -> DataFrame:
    """One row: events, events with identity, identities, first and last day."""
    return events.agg(
        F.count(F.lit(1)).alias("total"), F.count("ubid").alias("with_identity"), F.count_distinct("ubid").alias("identities"),
        F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"),
    )


def events_by(events: DataFrame, column: str) -> DataFrame:
    return events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def duplicate_events(events: DataFrame) -> DataFrame:
    return events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def events_of_identity(events: DataFrame, identity: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Events of one identity, latest first; undated ones last."""
    rows = events.where(F.col("ubid") == identity).orderBy(F.desc_nulls_last("event_date"), "event_id")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def recall_of_all_pairs(scored: DataFrame, records: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row: true pairs counted from the sizes of the groups (ubid), so that those which blocking never
    retrieved count too; how many were retrieved and linked; the recall of both. scored: a, b, p."""
    named = records.where("ubid IS NOT NULL").select("canonical_id", "ubid").distinct()
    sizes = named.groupBy("ubid").agg(F.count(F.lit(1)).alias("n"))
    true = sizes.agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("bigint")).alias("pairs"))
    x = named.select(F.col("canonical_id").alias("a"), F.col("ubid").alias("ua"))
    y = named.select(F.col("canonical_id").alias("b"), F.col("ubid").alias("ub"))
    met = scored.join(x, "a").join(y, "b").where("ua = ub").agg(F.count(F.lit(1)).alias("retrieved"), F.count_if(F.col("p") >= threshold).alias("linked"))
    share = lambda c: F.round(F.col(c) / F.col("pairs"), 4)
    both = true.crossJoin(met)  # one row each
    return both.select("pairs", "retrieved", "linked", share("retrieved").alias("recall_of_blocking"), share("linked").alias("recall"))


def confusion(scored: DataFrame, threshold: float, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 (0 where undefined), brier, ece. The last bin is
    closed; a score above 1 is in no bin but counts in the denominator."""
    hit, true = F.col(p) >= threshold, F.col(y) == 1
    binned = scored.where(F.col(p).between(0, 1)).groupBy(_bin(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"))
    ece = binned.agg(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))).alias("gap"))
    base = scored.agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"),
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = share(2 * precision * recall, precision + recall)
    return base.crossJoin(F.broadcast(ece)).select(  # one row each
        "tp", "fp", "fn", "tn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
        F.round("brier", 4).alias("brier"), F.round(F.coalesce("gap", F.lit(0.0)) / F.col("n"), 4).alias("ece"),
    )


def _bin(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability(scored: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """bin, n, mean_p, share_true; empty bins stay with n = 0 and NULLs."""
    spine = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    got = scored.where(F.col(p).between(0, 1)).groupBy(_bin(F.col(p), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean_p"), F.round(F.avg(F.col(y).cast("double")), 4).alias("share_true")
    )
    return spine.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "share_true")


def b_cubed(assigned: DataFrame, entity: str = "entity", cluster: str = "cluster") -> DataFrame:
    """One row: precision, recall, f1, from the sizes of entity, cluster and their overlaps; grouped,
    so that no window covers a large cluster."""
    cells = assigned.groupBy(entity, cluster).agg(F.count(F.lit(1)).alias("n"))
    sizes_c = cells.groupBy(cluster).agg(F.sum("n").alias("nc"))
    sizes_e = cells.groupBy(entity).agg(F.sum("n").alias("ne"))
    joined = cells.join(sizes_c, cluster).join(sizes_e, entity)
    out = joined.agg(
        (F.sum(F.col("n") * F.col("n") / F.col("nc")) / F.sum("n")).alias("p"), (F.sum(F.col("n") * F.col("n") / F.col("ne")) / F.sum("n")).alias("r")
    )
    return out.select(F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 4).alias("f1"))


ACTIVITY_ORDER = ("active", "nascent", "dormant", "closed_by_silence", "closed")


def verdict_confusion(truth: DataFrame, verdict_rows: DataFrame) -> DataFrame:
    """Truth (entity, identity, status) against verdicts: an entity of several identities takes the most
    active one, silence counts as closed. status, predicted, n."""
    rank = F.coalesce(*[F.when(F.col("verdict") == v, F.lit(i)) for i, v in enumerate(ACTIVITY_ORDER)], F.lit(9))
    best = truth.join(verdict_rows.select("identity", "verdict"), "identity", "left").groupBy("entity", "status").agg(F.min_by("verdict", rank).alias("verdict"))
    said = F.when(F.col("verdict") == "closed_by_silence", "closed").otherwise(F.coalesce("verdict", F.lit("none")))
    return best.groupBy(F.lower("status").alias("status"), said.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def histogram(frame: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """bucket, n over uneven buckets [edge, next); values outside count in the first and last; empty
    buckets stay."""
    spine = frame.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bucket"))
    at = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        at = F.when(F.col(value) >= e, F.lit(i)).otherwise(at)
    at = F.greatest(*[F.when(F.col(value) >= e, F.lit(i)).otherwise(F.lit(0)) for i, e in enumerate(edges[:-1])]) if len(edges) > 3 else at
    got = frame.where(F.col(value).isNotNull()).groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def geocode_coverage(records: DataFrame) -> DataFrame:
    """source_system, located, missing, n_points (distinct coordinates at three decimals)."""
    point = F.when(F.col("latitude").isNotNull(), F.struct(F.round("latitude", 3), F.round("longitude", 3)))
    return records.groupBy("source_system").agg(
        F.count("latitude").alias("located"), F.count_if(F.col("latitude").isNull()).alias("missing"), F.count_distinct(point).alias("n_points")
    )


def metric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, value_a, value_b, difference of two runs (metric, value)."""
    left, right = a.withColumnRenamed("value", "value_a"), b.withColumnRenamed("value", "value_b")
    return left.join(right, "metric", "full_outer").withColumn("difference", F.col("value_b") - F.col("value_a"))


def top_per_group(frame: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
