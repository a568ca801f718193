"""Best surviving value per field of each duplicate group, by learned currency.

The question per group and field is which of the disagreeing values is the present one. What is
learned from the rows is value-transition precedence: for a value reported by a register and seen so
long before the group's newest report, how often it is still the value at the end rather than one
that a later report replaced. Each class (field, register, age) gets the log odds of "kept" against
"superseded"; a class of higher odds precedes no class of lower odds. In a group those odds add up
over a value's reports, which orders the group's values; the maximal element of that order, the
topologically latest value, survives. Reports without a timestamp have a class of their own whose
odds come from where such values ended up, so they are ordered by what they agree with.

Learning is by rounds: the present values of all groups under the current odds give the next odds.
Reviewed survivors, if given, weigh `LABEL_WEIGHT` times as much, and also fit how much the summed
odds count beside which registers report a value, how lately, and whether it was there first: a
conditional logit, in which one value supersedes another with probability sigma(w . difference).
At most `MAX_LABELS` reviewed values, chosen by hash, are used for it; without any the odds decide.
Digits swapped in typing support the value they were typed for: values of a group with the same
digits in another order form one candidate, and the best supported spelling stands for it.

All steps are grouped aggregates over (group, field, value, register, age), combined map-side; no
window, sort or list ever covers a whole group, so a group holding a third of the rows is only a
longer sum. What is broadcast is the table of odds: fields x registers x ages.

Defined results: re-delivered canonical_ids count once. Groups need two distinct canonical_ids.
Values that stand for "unknown" (one digit repeated, counting sequences, zero or negative counts)
and values of the wrong length are not usable; a field without a usable value has no row. A value
that the reference list of places does not know loses to one it knows. Ties: smallest value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.fitting import choice
from kinfold.session import Scratch

FIELDS = ("phone", "employee_count", "pin_code")
ROUNDS = 3
LABEL_WEIGHT = 8
MAX_LABELS = 20_000
#: Registers whose reports get weights of their own.
MAX_SOURCES = 30
#: Ages in days that bound the classes; class 0 is the newest report of the group itself.
AGES = (0, 60, 180, 365, 730, 1460)
#: Stand-ins that no rule on repeated digits covers (fixed values).
STAND_INS = ("9876543210", "9123456789", "6789012345", "123456", "654321")


def usable_phone(raw: Column) -> Column:
    """Ten digits beginning 6-9, after an 0, 91 or +91 in front; NULL if not usable."""
    digits = F.regexp_replace(raw, r"\D", "")
    local = F.regexp_extract(digits, r"^(?:0|91|091)?([6-9]\d{9})$", 1)
    return _real(local)


def usable_pin(raw: Column) -> Column:
    """Six digits not beginning with 0; NULL if not usable."""
    return _real(F.regexp_extract(F.regexp_replace(raw, r"\D", ""), r"^([1-9]\d{5})$", 1))


def usable_count(raw: Column) -> Column:
    """A positive whole number that is not a row of nines; NULL if not usable."""
    n = raw.try_cast("bigint")
    return F.when((n > 0) & ~n.cast("string").rlike(r"^9{4,}$"), n.cast("string"))


def _real(v: Column) -> Column:
    return F.when((v != "") & ~v.rlike(r"^(\d)\1*$") & ~v.isin(*STAND_INS), v)


def reports(records: DataFrame) -> DataFrame:
    """A row per group, field and record with a usable value: ubid, field_name, value, source, at."""
    once = (
        records.where(F.col("ubid").isNotNull() & F.col("canonical_id").isNotNull())
        .groupBy("ubid", "canonical_id")
        .agg(
            F.max(
                F.struct(
                    F.col("ingested_at").cast("timestamp_ntz").alias("at"),
                    F.coalesce("source_system", F.lit("")).alias("source"),
                    "phone",
                    F.col("employee_count").cast("string").alias("employee_count"),
                    "pin_code",
                )
            ).alias("r")
        )
    )
    values = F.array(
        F.struct(F.lit("phone").alias("field_name"), usable_phone(F.col("r.phone")).alias("value")),
        F.struct(F.lit("employee_count").alias("field_name"), usable_count(F.col("r.employee_count")).alias("value")),
        F.struct(F.lit("pin_code").alias("field_name"), usable_pin(F.col("r.pin_code")).alias("value")),
    )
    long = once.select("ubid", "canonical_id", F.col("r.at").alias("at"), F.col("r.source").alias("source"), F.explode(values).alias("v"))
    return long.select("ubid", "canonical_id", "at", "source", "v.field_name", "v.value")


def _age_class(days: Column) -> Column:
    """Position of an age among AGES; -1 where there is no timestamp."""
    cls = F.lit(len(AGES))
    for i in range(len(AGES) - 1, -1, -1):
        cls = F.when(days <= AGES[i], F.lit(i)).otherwise(cls)
    return F.when(days.isNull(), F.lit(-1)).otherwise(cls)


def survivors(records: DataFrame, localities: DataFrame | None = None, labels: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """ubid, field_name, field_value: the surviving value of each group and field."""
    scratch = Scratch(records.sparkSession, "survivor")
    rows = reports(records)
    groups = rows.groupBy("ubid").agg(F.count_distinct("canonical_id").alias("_n")).where("_n >= 2").select("ubid")
    found = rows.where(F.col("value").isNotNull()).join(groups, "ubid", "left_semi")
    span = found.groupBy("ubid", "field_name").agg(
        F.max("at").alias("newest"), F.min("at").alias("oldest"), F.count(F.lit(1)).alias("size")
    )
    days = F.datediff("newest", "at")
    aged = found.join(span, ["ubid", "field_name"]).withColumn("days", days).withColumn("age", _age_class(F.col("days")))
    # digits in another order are one candidate, except for counts, where 12 and 21 both occur
    key = F.when(F.col("field_name") == "employee_count", F.col("value")).otherwise(
        F.array_join(F.array_sort(F.split("value", "")), "")
    )
    obs = aged.groupBy("ubid", "field_name", "size", key.alias("key"), "value", "source", "age").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("days").alias("days"),
        F.max((F.col("at") == F.col("newest")).cast("int")).alias("is_newest"),
        F.max((F.col("at") == F.col("oldest")).cast("int")).alias("is_oldest"),
    )
    if localities is not None:
        pins = localities.select(usable_pin(F.col("pin_code")).alias("value"), F.lit(True).alias("known")).where("value IS NOT NULL").distinct()
        obs = obs.join(pins, "value", "left").withColumn("known", F.coalesce("known", F.col("field_name") != "pin_code"))
    else:
        obs = obs.withColumn("known", F.lit(True))
    obs = scratch.write(obs, "reports")

    truth = None
    if labels is not None:
        given = labels.where("ubid IS NOT NULL AND field_value IS NOT NULL").orderBy(F.xxhash64("ubid", "field_name"), "field_value").limit(MAX_LABELS)
        truth = scratch.write(given.groupBy("ubid", "field_name").agg(F.min("field_value").alias("truth")), "labels")

    odds = None
    for _ in range(rounds):
        best = _latest(_candidates(obs, odds, ()), {})
        judged = obs.join(best, ["ubid", "field_name"])
        weight = F.when(F.col("size") >= 3, 1.0).otherwise(0.1)  # small groups mostly agree with themselves
        present = F.col("field_value")
        if truth is not None:
            judged = judged.join(truth, ["ubid", "field_name"], "left")
            weight = F.when(F.col("truth").isNotNull(), F.lit(float(LABEL_WEIGHT))).otherwise(weight)
            present = F.coalesce("truth", "field_value")
        w = F.col("n") * weight
        kept = F.sum(F.when(F.col("value") == present, w).otherwise(0.0))
        learned = judged.groupBy("field_name", "source", "age").agg(F.log((kept + 1.0) / (F.sum(w) - kept + 1.0)).alias("odds"))
        odds = scratch.write(learned, "odds")
    if truth is None:
        return _latest(_candidates(obs, odds, ()), {})
    sources = [r[0] for r in obs.select("source").distinct().orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} registers: source_system is not a catalogue column")
    candidates = scratch.write(_candidates(obs, odds, sources), "candidates")
    return _latest(candidates, _fit(candidates, truth, sources))


def _candidates(obs: DataFrame, odds: DataFrame | None, sources: list[str] | tuple) -> DataFrame:
    """A row per group, field and candidate: its best spelling, summed odds and, for the sources
    named, whether and how lately they report it."""
    if odds is None:  # before anything is learned newer reports outweigh older ones
        weighed = obs.withColumn("odds", 1.0 / (1.0 + F.greatest("age", F.lit(0))))
    else:
        weighed = obs.join(F.broadcast(odds), ["field_name", "source", "age"])  # one row per class
    recent = [F.min(F.when(F.col("source") == s, F.coalesce("days", F.lit(1500)))).alias(f"d{i}") for i, s in enumerate(sources)]
    spelled = weighed.groupBy("ubid", "field_name", "key", "value").agg(
        F.sum(F.col("odds") * F.col("n")).alias("score"),
        F.sum("n").alias("n"),
        F.max("known").alias("known"),
        F.max("is_newest").alias("is_newest"),
        F.max("is_oldest").alias("is_oldest"),
        *recent,
    )
    # swapped digits: the candidate has the evidence of all its spellings and shows the best of them
    return spelled.groupBy("ubid", "field_name", "key").agg(
        F.max("known").alias("known"),
        F.sum("score").alias("score"),
        F.sum("n").alias("n"),
        F.max("is_newest").alias("is_newest"),
        F.max("is_oldest").alias("is_oldest"),
        F.max(F.struct("known", "n", "score", _descending("value").alias("low"), "value"))["value"].alias("value"),
        *[F.min(f"d{i}").alias(f"d{i}") for i in range(len(sources))],
    )


def _descending(value: str) -> Column:
    return F.translate(value, "0123456789", "9876543210")


def _terms(sources: list[str]) -> list[Column]:
    """What the conditional logit weighs, besides nothing that a group of any size could inflate."""
    terms = [F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))), F.log1p(F.col("n").cast("double")), F.col("is_newest").cast("double"), F.col("is_oldest").cast("double")]
    for i in range(len(sources)):
        seen = F.col(f"d{i}").isNotNull().cast("double")
        terms += [seen, F.coalesce(F.least(F.col(f"d{i}") / 365.0, F.lit(4.0)), F.lit(0.0)), F.coalesce((F.col(f"d{i}") == 0).cast("double"), F.lit(0.0))]
    return terms


def _fit(candidates: DataFrame, truth: DataFrame, sources: list[str]) -> dict[str, list[float]]:
    """Weights per field from the reviewed groups: a conditional logit."""
    # a group of very many candidates teaches no more than others, so only its size keeps it out
    rows = (
        candidates.join(truth, ["ubid", "field_name"])
        .groupBy("ubid", "field_name")
        .agg(F.count(F.lit(1)).alias("k"), F.max_by("key", (F.col("value") == F.col("truth")).cast("int")).alias("hit"), F.max((F.col("value") == F.col("truth")).cast("int")).alias("has"))
        .where("k BETWEEN 2 AND 40 AND has = 1")
        .join(candidates, ["ubid", "field_name"])
        .select("field_name", "ubid", (F.col("key") == F.col("hit")).alias("y"), F.array(*_terms(sources)).alias("x"))
        .toPandas()
    )
    weights: dict[str, list[float]] = {}
    for field, of_field in rows.groupby("field_name"):
        sets = [(np.array(g["x"].tolist(), float), int(np.argmax(g["y"].to_numpy()))) for _, g in of_field.groupby("ubid")]
        dim = sets[0][0].shape[1]
        if len(sets) < 10:
            continue
        prior = np.zeros(dim)
        prior[0] = 1.0  # few labels: the learned odds decide
        w = choice(sets, prior)
        weights[field] = [round(float(v), 9) for v in w]
    return weights


def _latest(candidates: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """The topologically latest candidate of each group and field under the learned precedence."""
    utility = F.col("score")
    if weights:
        sources = [c for c in candidates.columns if c[0] == "d" and c[1:].isdigit()]
        terms = _terms(sources)
        for field, w in weights.items():
            total = sum((F.lit(v) * t for v, t in zip(w[1:], terms[1:])), F.lit(w[0]) * terms[0])
            utility = F.when(F.col("field_name") == field, total).otherwise(utility)
    top = F.max(F.struct("known", F.round(utility, 9).alias("u"), _descending("value").alias("low"), "value"))["value"]
    return candidates.groupBy("ubid", "field_name").agg(top.alias("field_value"))
