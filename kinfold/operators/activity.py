"""From event streams to activity verdicts: identity resolution, decay, thresholds, evidence.

The catalogue of signals is a constant map inside the expressions, so scoring is a projection over the
date-pruned log followed by one aggregate per identity, combined map-side; a busy identity costs no
more than any other. The reference day is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import dictionaries as D
from kinfold.functions.canonical import sector_multiplier

ALPHA, ACTIVE, DORMANT, NASCENT_DAYS, LOOKBACK = 1.5, 1.5, 0.4, 90, 730
DEFAULT_CADENCE = 365
#: Parts into which the events of an identity are ranked first.
SALTS = 64


def _signal(event_type: Column, signals: dict) -> Column:
    entries = [x for k, (w, tau, sign, closes) in signals.items() for x in (F.lit(k), F.struct(F.lit(float(w)).alias("weight"), F.lit(float(tau or DEFAULT_CADENCE)).alias("cadence"), F.lit(float(sign)).alias("sign"), F.lit(bool(closes)).alias("closes")))]
    return F.create_map(*entries)[event_type]


def contributions(events: DataFrame, reference: str, identity: str = "ubid", signals: dict | None = None, alpha: float = ALPHA, lookback: int = LOOKBACK) -> DataFrame:
    """identity, event_id, event_type, event_date, closes, contribution of catalogued events within
    the lookback. Closing events keep their weight; others fade with age over alpha x cadence."""
    day = F.lit(reference).cast("date")
    known = events.where((F.col("event_date") >= F.date_sub(day, lookback)) & (F.col("event_date") <= day) & F.col(identity).isNotNull())
    s = F.col("s")
    age = F.greatest(F.datediff(day, "event_date"), F.lit(0))
    value = F.when(s["closes"], s["weight"]).otherwise(s["sign"] * s["weight"] * F.exp(-age / (alpha * s["cadence"])))
    return (
        known.withColumn("s", _signal(F.col("event_type"), signals or D.SIGNALS))
        .where("s IS NOT NULL")
        .select(F.col(identity).alias("identity"), "event_id", "event_type", "event_date", s["closes"].alias("closes"), value.alias("contribution"))
    )


def verdicts(identities: DataFrame, contributed: DataFrame, active: float = ACTIVE, dormant: float = DORMANT, reference: str | None = None) -> DataFrame:
    """One row per identity: verdict, score (rounded after the thresholds are tested on the raw sum),
    n_events, closed_by (the latest closing event). `identities` has identity and may have sector (its
    threshold multiplier applies) and registration_date (with `reference`: nascent if young and
    without events but amendments)."""
    agg = contributed.groupBy("identity").agg(
        F.sum("contribution").alias("raw"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") != "se_amendment").alias("n_substantial"),
        F.max(F.when(F.col("closes"), F.struct("event_date", "event_id", "event_type")))["event_type"].alias("closed_by"),
    )
    rows = identities.join(agg, "identity", "left")
    raw = F.coalesce("raw", F.lit(0.0))
    low = F.lit(dormant) * (sector_multiplier(F.col("sector")) if "sector" in identities.columns else F.lit(1.0))
    young = F.lit(False)
    if "registration_date" in identities.columns and reference:
        young = F.coalesce(F.datediff(F.lit(reference).cast("date"), "registration_date") <= NASCENT_DAYS, F.lit(False)) & (F.coalesce("n_substantial", F.lit(0)) == 0)
    verdict = (
        F.when(F.col("closed_by").isNotNull(), "closed")
        .when(young, "nascent")
        .when(raw >= active, "active")
        .when(raw >= low, "dormant")
        .otherwise("closed_by_silence")
    )
    score = F.when(F.col("closed_by").isNotNull(), F.lit(0.0)).otherwise(F.round(raw, 4))
    return rows.select("identity", verdict.alias("verdict"), score.alias("score"), F.coalesce("n_events", F.lit(0)).alias("n_events"), "closed_by")


def verdict_distribution(verdict_rows: DataFrame) -> DataFrame:
    return verdict_rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def evidence(contributed: DataFrame) -> DataFrame:
    """Timelines as rows, one per event, as an identity may hold a tenth of all: identity, event_date,
    event_id, event_type, contribution."""
    return contributed.select("identity", "event_date", "event_id", "event_type", (F.round("contribution", 4) + F.lit(0.0)).alias("contribution"))


def top_evidence(contributed: DataFrame, k: int = 7) -> DataFrame:
    """The k strongest contributions of each identity and, as rank k + 1, the sum of the others."""
    strongest = [F.desc(F.abs("contribution")), F.asc("event_id")]
    part = Window.partitionBy("identity", "salt").orderBy(*strongest)
    # first within parts of an identity, so that no task sorts all events of a large one
    some = contributed.select("identity", "event_id", "contribution", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).alias("salt"))
    some = some.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("identity").orderBy(*strongest))).where(F.col("rank") <= k)
    top = top.select("identity", "rank", "contribution", "event_id")
    zero = F.lit(0.0)  # added to results, as there is to be no negative zero
    named = top.select("identity", "rank", (F.round("contribution", 4) + zero).alias("contribution"), "event_id", F.lit(1).cast("bigint").alias("n_events"))
    whole = contributed.groupBy("identity").agg(F.sum("contribution").alias("all"), F.count(F.lit(1)).alias("n"))
    held = top.groupBy("identity").agg(F.sum("contribution").alias("held"), F.count(F.lit(1)).alias("k"))
    rest = whole.join(held, "identity").where("n > k").select(
        "identity",
        F.lit(k + 1).alias("rank"),
        (F.round(F.col("all") - F.col("held"), 4) + zero).alias("contribution"),
        F.lit(None).cast("string").alias("event_id"),
        (F.col("n") - F.col("k")).alias("n_events"),
    )
    return named.unionByName(rest)


def source_lanes(events: DataFrame, reference: str, identity: str = "ubid") -> DataFrame:
    """Per identity and source: first and last event, events in all and in the last 30 days."""
    day = F.lit(reference).cast("date")
    return events.where(F.col(identity).isNotNull()).groupBy(F.col(identity).alias("identity"), "source_system").agg(
        F.min("event_date").alias("first_event"),
        F.max("event_date").alias("last_event"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if((F.col("event_date") > F.date_sub(day, 30)) & (F.col("event_date") <= day)).alias("n_last_30d"),
    )


def resolve(events: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, quarantined) by source and source record id; mapping: source_system, source_record_id,
    ubid. Of several identities of a record the smallest counts."""
    both = remap(events, mapping)
    reason = F.concat(F.lit("no identity for "), F.coalesce("source_system", F.lit("?")), F.lit("/"), F.coalesce("source_record_id", F.lit("?")))
    waiting = both.where("ubid IS NULL").drop("ubid").withColumns({"reason": reason, "retry_count": F.lit(0), "resolved": F.lit(False)})
    return both.where("ubid IS NOT NULL"), waiting


def remap(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events with the identity their record has now; those of unknown records keep NULL."""
    one = mapping.groupBy("source_system", "source_record_id").agg(F.min("ubid").alias("ubid"))
    columns = [c for c in events.columns if c != "ubid"] + ["ubid"]
    return events.drop("ubid").join(one, ["source_system", "source_record_id"], "left").select(*columns)


def retry_quarantine(quarantined: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events resolved now, quarantine after the attempt): resolved entries are marked, the others
    have one retry more."""
    one = mapping.groupBy("source_system", "source_record_id").agg(F.min("ubid").alias("resolved_ubid"))
    tried = quarantined.drop("resolved_ubid").join(one, ["source_system", "source_record_id"], "left")
    hit = F.col("resolved_ubid").isNotNull() & ~F.col("resolved")
    after = tried.withColumns(
        {"retry_count": F.col("retry_count") + F.when(F.col("resolved") | hit, 0).otherwise(1), "resolved": F.col("resolved") | hit}
    )
    return tried.where(hit).withColumnRenamed("resolved_ubid", "ubid").drop("reason", "retry_count", "resolved"), after


def quarantine_stats(quarantined: DataFrame) -> DataFrame:
    return quarantined.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if("resolved").alias("resolved"))


def append_events(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows to append: each event_id once (earliest arrival first) and none that is stored already."""
    columns = [c for c in new.columns if c != "event_id"]
    first = new.where("event_id IS NOT NULL").groupBy("event_id").agg(F.min(F.struct("ingested_at", *[c for c in columns if c != "ingested_at"])).alias("r"))
    rows = first.select(*[F.col(c) if c == "event_id" else F.col(f"r.{c}").alias(c) for c in new.columns])
    return rows if existing is None else rows.join(existing.select("event_id"), "event_id", "left_anti")
