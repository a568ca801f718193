"""Registered queries of the review, evaluation and paging operators and of single functions, with their SQL.

The decision log is read off the scored pairs: what a score amounts to stands for what a reviewer decided.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import canonical as C
from kinfold.functions import dictionaries as D
from kinfold.operators import activity, adapters, clustering, reports, review
from kinfold.operators.features import expressions
from kinfold.plans import reference as R
from kinfold.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__], ORACLE[fn.__name__] = fn, sql
        return fn

    return keep


# --- review ----------------------------------------------------------------------------------------

_DECISION = "CASE WHEN calibrated_probability >= 0.95 THEN 'confirm' WHEN calibrated_probability < 0.2 THEN 'reject' WHEN calibrated_probability < 0.6 THEN 'flag_quality' ELSE 'defer' END"
_LOG = f"""(SELECT DISTINCT canonical_id_a AS a, canonical_id_b AS b, scored_at AS decided_at, {_DECISION} AS decision,
  CASE WHEN deterministic_tier_fired THEN 'rules' ELSE 'model' END AS reviewer, CASE WHEN raw_score > 0.5 THEN 'senior' ELSE 'junior' END AS tier
  FROM linkage_pairs WHERE canonical_id_a <> canonical_id_b AND calibrated_probability IS NOT NULL)"""


def _log(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "linkage_pairs").where("canonical_id_a <> canonical_id_b AND calibrated_probability IS NOT NULL")
    reviewer = F.expr("CASE WHEN deterministic_tier_fired THEN 'rules' ELSE 'model' END")
    tier = F.expr("CASE WHEN raw_score > 0.5 THEN 'senior' ELSE 'junior' END")
    named = rows.select(F.col("canonical_id_a").alias("a"), F.col("canonical_id_b").alias("b"), F.col("scored_at").alias("decided_at"), F.expr(_DECISION).alias("decision"), reviewer.alias("reviewer"), tier.alias("tier"))
    return named.distinct()


def _last(which: str) -> str:
    return f"""(SELECT least(a, b) AS a, greatest(a, b) AS b, decision, tier, decided_at FROM {_LOG} WHERE {which}
QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY decided_at DESC NULLS LAST, decision DESC, reviewer DESC, tier DESC) = 1)"""


_RULED = _last("decision IN ('confirm', 'reject')")


@query(f"SELECT a, b, CASE decision WHEN 'confirm' THEN 'must_link' ELSE 'cannot_link' END AS \"constraint\" FROM {_RULED}")
def ruled_constraints(spark, root):
    return review.apply_decisions(_log(spark, root))[0]


@query(f"SELECT a, b, (decision = 'confirm')::INT AS label, decided_at FROM {_RULED}")
def ruled_labels(spark, root):
    return review.apply_decisions(_log(spark, root))[1]


@query(f"""SELECT l.a, l.b, CASE WHEN decision IN ('confirm', 'reject') THEN 'decided' WHEN tier = 'junior' THEN 'pending' ELSE 'deferred' END AS status, round(coalesce(r, 0), 4) AS priority_raise
FROM {_last("decision <> 'flag_quality'")} l LEFT JOIN (SELECT least(a, b) AS a, greatest(a, b) AS b, least(1.0, 0.3 * count(*)) AS r FROM {_LOG} WHERE decision = 'defer' AND tier = 'junior' GROUP BY 1, 2) d ON d.a = l.a AND d.b = l.b""")
def decided_queue(spark, root):
    rows = review.apply_decisions(_log(spark, root))[2]
    return rows.withColumn("priority_raise", F.round(F.col("priority_raise").cast("double"), 4))


@query("SELECT reviewer, tier, " + ", ".join(f"count(*) FILTER (decision = '{d}') AS {d}" for d in ("confirm", "reject", "defer", "flag_quality")) + f" FROM {_LOG} GROUP BY 1, 2")
def reviewer_board(spark, root):
    return review.leaderboard(_log(spark, root))


@query(f"SELECT count(*) AS total, count(*) AS since, CASE WHEN count(*) = 0 THEN 'nothing_new' WHEN count(*) < 20 THEN 'wait' WHEN count(*) < 200 THEN 'retrain_soon' ELSE 'retrain_now' END AS recommendation FROM {_RULED}")
def label_budget(spark, root):
    return review.label_budget(review.apply_decisions(_log(spark, root))[1], None)


@query(f"""SELECT l.a, l.b, decision, reviewer, l.tier, decided_at, x.name_raw AS name_a, y.name_raw AS name_b
FROM {_LOG} l LEFT JOIN {R._RECORDS} x ON x.canonical_id = a LEFT JOIN {R._RECORDS} y ON y.canonical_id = b""")
def decision_log(spark, root):
    return review.decision_log(_log(spark, root), R._records(spark, root).select("canonical_id", "name_raw"))


@query(f"""SELECT q.*, x.name_raw AS name_a, x.source_system AS source_a, y.name_raw AS name_b, y.source_system AS source_b FROM ({R.ORACLE["review_queue"]}) q
JOIN {R._RECORDS} x ON x.canonical_id = canonical_id_a JOIN {R._RECORDS} y ON y.canonical_id = canonical_id_b WHERE status = 'pending'""")
def pending_pairs(spark, root):
    return review.pending_items(R.review_queue(spark, root), R._records(spark, root))


_TRUE = f"(SELECT s.a, s.b, (x.ubid = y.ubid)::INT AS y FROM {R._PAIRS} WHERE x.ubid IS NOT NULL AND y.ubid IS NOT NULL)"
_RAW = R._SCORED.replace("calibrated_probability AS p", "raw_score AS p").replace("calibrated_probability DESC NULLS LAST", "raw_score DESC NULLS LAST")


@query(f"""SELECT run, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1, round(brier, 4) AS brier FROM (
SELECT run, count(*) FILTER (p >= 0.95 AND y = 1) AS tp, count(*) FILTER (coalesce(p >= 0.95, FALSE) AND y = 0) AS fp, count(*) FILTER (NOT p >= 0.95 AND y = 1) AS fn, avg(pow(p - y, 2)) AS brier
FROM (SELECT 'before' AS run, * FROM {_RAW} UNION ALL SELECT 'after', * FROM {R._SCORED}) s JOIN {_TRUE} t ON t.a = s.a AND t.b = s.b GROUP BY run)""")
def retrain_report(spark, root):
    rows = table(spark, root, "linkage_pairs").where("canonical_id_a <> canonical_id_b")
    ends = rows.select(F.least("canonical_id_a", "canonical_id_b").alias("a"), F.greatest("canonical_id_a", "canonical_id_b").alias("b"), F.struct("scored_at", "raw_score").alias("s"))
    before = ends.groupBy("a", "b").agg(F.max("s")["raw_score"].alias("p"))
    ids = R._records(spark, root).select("canonical_id", "ubid")
    x, y = ids.select(F.col("canonical_id").alias("a"), F.col("ubid").alias("ua")), ids.select(F.col("canonical_id").alias("b"), F.col("ubid").alias("ub"))
    after = R._scored(spark, root).select("a", "b", "p")
    labels = after.select("a", "b").join(x, "a").join(y, "b").select("a", "b", (F.col("ua") == F.col("ub")).cast("int").alias("y")).where("y IS NOT NULL")
    return review.retrain_report(before, after, labels)


# --- clusters and evaluation -----------------------------------------------------------------------


@query(f"SELECT a, b FROM {R._SCORED} WHERE p >= 0.95 AND NOT (p >= 0.97 AND p < 0.98)")
def inline_links(spark, root):
    scored = R._scored(spark, root)
    return clustering.inline_edges(scored, scored.where("p >= 0.99").select("a", "b"), scored.where("p >= 0.97 AND p < 0.98").select("a", "b"))


@query(R._CLUSTERS + " SELECT node, cluster, 'U' || substr(sha256(cluster), 1, 16) AS identity FROM clusters")
def assigned_identities(spark, root):
    return clustering.assign_identities(R._clusters(spark, root))


@query(f"""WITH f AS (SELECT count(*) FILTER (p >= 0.95) AS linked, count(*) AS retrieved FROM {R._PAIRS} WHERE x.ubid = y.ubid),
t AS (SELECT sum(n * (n - 1) / 2)::BIGINT AS pairs FROM (SELECT count(DISTINCT canonical_id) AS n FROM {R._RECORDS} WHERE ubid IS NOT NULL GROUP BY ubid))
SELECT pairs, retrieved, linked, round(retrieved / pairs, 4) AS recall_of_blocking, round(linked / pairs, 4) AS recall FROM f, t""")
def recall_of_all_pairs(spark, root):
    return reports.recall_of_all_pairs(R._scored(spark, root), R._records(spark, root))


# --- activity --------------------------------------------------------------------------------------


@query(f"""SELECT event_id, 'no identity for ' || coalesce(source_system, '?') || '/' || coalesce(source_record_id, '?') AS reason, 0 AS retry_count, FALSE AS resolved
FROM {R._EVENTS} e LEFT JOIN {R._MAP} m USING (source_system, source_record_id) WHERE u IS NULL""")
def quarantine_list(spark, root):
    return activity.resolve(R._events(spark, root), R._mapping(spark, root))[1].select("event_id", "reason", "retry_count", "resolved")


@query(f"SELECT count(*) AS total, count(*) AS unresolved, 0::BIGINT AS resolved FROM {R._EVENTS} e LEFT JOIN {R._MAP} m USING (source_system, source_record_id) WHERE u IS NULL")
def quarantine_stats(spark, root):
    return activity.quarantine_stats(activity.resolve(R._events(spark, root), R._mapping(spark, root))[1])


_FIRST = "(SELECT min(ubid) FROM activity_events WHERE ubid IS NOT NULL)"


@query(f"SELECT event_id, event_type, source_system, event_date FROM {R._EVENTS} WHERE ubid = {_FIRST}")
def events_of_identity(spark, root):
    first = table(spark, root, "activity_events").agg(F.min("ubid")).first()[0]
    return reports.events_of_identity(R._events(spark, root), first).select("event_id", "event_type", "source_system", "event_date")


def _multiplier(column: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{word}') THEN {m}" for _, m, words in D.SECTORS for word in words) + " ELSE 1.0 END"


_SINCE = "(SELECT ubid, max(registration_date) AS since, max(name_raw) AS sector FROM canonical_records WHERE ubid IS NOT NULL GROUP BY ubid)"


@query(f"""SELECT s.ubid AS identity, CASE WHEN closed_by IS NOT NULL THEN 'closed' WHEN coalesce(DATE '{R.REFERENCE_DAY}' - since <= 90, FALSE) AND coalesce(n_substantial, 0) = 0 THEN 'nascent'
  WHEN coalesce(raw, 0) >= 1.5 THEN 'active' WHEN coalesce(raw, 0) >= 0.4 * {_multiplier("sector")} THEN 'dormant' ELSE 'closed_by_silence' END AS verdict
FROM {_SINCE} s LEFT JOIN (SELECT identity, sum(contribution) AS raw, count(*) FILTER (event_type <> 'se_amendment') AS n_substantial, arg_max(event_type, (event_date, event_id)) FILTER (closes) AS closed_by
  FROM {R._CONTRIB} GROUP BY identity) c ON c.identity = s.ubid""")
def verdicts_by_sector_and_age(spark, root):
    """The name stands for the sector, as the earlier intake has none."""
    rows = table(spark, root, "canonical_records").where("ubid IS NOT NULL").groupBy(F.col("ubid").alias("identity")).agg(F.max("registration_date").alias("registration_date"), F.max("name_raw").alias("sector"))
    return activity.verdicts(rows, R._contributions(spark, root), reference=R.REFERENCE_DAY).select("identity", "verdict")


@query(f"""SELECT v.identity AS ubid, verdict, score, p.pin_code, p.district, (SELECT count(*) FROM {R._RECORDS} r WHERE r.ubid = v.identity) AS n_records, count(*) OVER () AS total
FROM {R._VERDICTS} v JOIN {R._PLACES} p ON p.ubid = v.identity WHERE verdict = 'dormant' AND lower(p.district) = 'kelnenagara district' ORDER BY score DESC, v.identity LIMIT 20 OFFSET 5""")
def dormant_page(spark, root):
    """The second page of a filtered listing."""
    return reports.active_businesses(R._identities(spark, root), R._records(spark, root), R._events(spark, root), verdict="dormant", district="Kelnenagara District", limit=20, offset=5)


@query(f"SELECT ubid FROM {R._RECORDS} WHERE pan = (SELECT min(pan) FROM {R._RECORDS}) AND ubid IS NOT NULL GROUP BY ubid ORDER BY ubid LIMIT 10")
def lookup_by_pan(spark, root):
    records = R._records(spark, root)
    return reports.lookup(records, pan=records.agg(F.min("pan")).first()[0])


# --- single functions ------------------------------------------------------------------------------


@query("""SELECT coalesce(CASE lower(trim(industry_category)) WHEN 'r' THEN 'red' WHEN 'o' THEN 'orange' WHEN 'g' THEN 'green' WHEN 'w' THEN 'white' WHEN 'red' THEN 'red' WHEN 'orange' THEN 'orange'
  WHEN 'green' THEN 'green' WHEN 'white' THEN 'white' END, 'none') AS category, count(DISTINCT consent_file_no) AS n FROM kspcb_records GROUP BY 1""")
def board_categories(spark, root):
    rows = adapters.adapt(table(spark, root, "kspcb_records"), "kspcb")
    return rows.groupBy(F.coalesce("kspcb_category", F.lit("none")).alias("category")).agg(F.count_distinct("source_record_id").alias("n"))


@query(r"""SELECT DISTINCT consent_file_no AS key, CASE WHEN regexp_matches(replace(upper(trim(cin)), ' ', ''), '^[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$') THEN replace(upper(trim(cin)), ' ', '') END AS cin,
  latitude, longitude, date_of_commissioning AS registration_date, valid_until AS consent_valid_until, nullif(trim(nic_code), '') AS nic_code, nullif(trim(sector), '') AS sector_raw FROM kspcb_records""")
def board_fields(spark, root):
    rows = adapters.adapt(table(spark, root, "kspcb_records"), "kspcb")
    return rows.select(F.col("source_record_id").alias("key"), "cin", "latitude", "longitude", "registration_date", "consent_valid_until", "nic_code", "sector_raw").distinct()


@query("""SELECT DISTINCT licence_number AS key, round(installed_hp * 0.7457, 6) AS kw, employee_count, registration_date, licence_valid_until, nullif(trim(taluk), '') AS taluk, lower(nullif(trim(district), '')) AS district FROM fbis_records""")
def factory_fields(spark, root):
    """Fields of the adapter that the table's own columns decide; taluk and district only where given."""
    rows = adapters.adapt(table(spark, root, "fbis_records"), "fbis").select("source_record_id", F.round("sanctioned_load_kw", 6).alias("kw"), "employee_count", "registration_date", "licence_valid_until")
    given = table(spark, root, "fbis_records").select(F.col("licence_number").alias("source_record_id"), C.blank_to_null(F.col("taluk")).alias("taluk"), F.lower(C.blank_to_null(F.col("district"))).alias("district")).distinct()
    return rows.distinct().join(given, "source_record_id").withColumnRenamed("source_record_id", "key")


@query(r"""SELECT DISTINCT upper(trim(rr_number)) AS rr_number, nullif(trim(account_id), '') AS account_id, upper(nullif(trim(k_number), '')) AS k_number, sanctioned_load_kw, nullif(trim(tariff_category), '') AS tariff_category FROM bescom_records""")
def connection_fields(spark, root):
    rows = adapters.adapt(table(spark, root, "bescom_records"), "bescom")
    return rows.select("rr_number", "account_id", "k_number", "sanctioned_load_kw", "tariff_category").distinct()


@query("SELECT DISTINCT upper(trim(knca_number)) AS rr_number, nullif(trim(account_id), '') AS account_id, nullif(trim(consumer_number), '') AS k_number, connection_size_mm::DOUBLE AS sanctioned_load_kw FROM bwssb_records")
def water_fields(spark, root):
    rows = adapters.adapt(table(spark, root, "bwssb_records"), "bwssb")
    return rows.select("rr_number", "account_id", "k_number", "sanctioned_load_kw").distinct()


@query("SELECT DISTINCT establishment_registration_no AS key, employee_count, date_of_commencement AS registration_date, nullif(trim(nature_of_business), '') AS sector_raw FROM ekarmika_records")
def shop_fields(spark, root):
    rows = adapters.adapt(table(spark, root, "ekarmika_records"), "ekarmika")
    return rows.select(F.col("source_record_id").alias("key"), "employee_count", "registration_date", "sector_raw").distinct()


_STEP_WORDS = {"1st": 1, "2nd": 2, "3rd": 3, "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}


@query("SELECT DISTINCT rr_number AS key, array_to_string(list_filter(list_transform(regexp_extract_all(service_address, '" + C.STEP + "', 1), lambda w: coalesce(element_at(MAP {"
       + ", ".join(f"'{k}': {v}" for k, v in _STEP_WORDS.items()) + "}, lower(w))[1], TRY_CAST(regexp_replace(lower(w), 'th$', '') AS INT))), lambda n: n IS NOT NULL), ',') AS steps FROM bescom_records")
def step_numbers(spark, root):
    steps = F.array_join(F.transform(C.step_numbers(F.col("service_address")), lambda n: n.cast("string")), ",")
    return table(spark, root, "bescom_records").select(F.col("rr_number").alias("key"), steps.alias("steps")).distinct()


@query(f"SELECT DISTINCT consent_file_no AS key, {_multiplier('sector')}::DOUBLE AS multiplier FROM kspcb_records")
def sector_multipliers(spark, root):
    return table(spark, root, "kspcb_records").select(F.col("consent_file_no").alias("key"), C.sector_multiplier(F.col("sector")).alias("multiplier")).distinct()


def _contained(column: str, entries) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{w}') THEN '{v}'" for w, v in entries) + " END"


@query(f"SELECT DISTINCT rr_number AS key, {_contained('service_address', D.DISTRICTS)} AS district, {_contained('service_address', D.TALUKS)} AS taluk FROM bescom_records")
def places_named(spark, root):
    a = F.col("service_address")
    return table(spark, root, "bescom_records").select(F.col("rr_number").alias("key"), C.district(a).alias("district"), C.taluk(a).alias("taluk")).distinct()


@query(f"""SELECT s.a AS canonical_id_a, s.b AS canonical_id_b, coalesce(x.stripped = y.stripped AND x.stripped <> '', FALSE)::DOUBLE AS name_exact_stripped, coalesce(x.pan = y.pan, FALSE)::DOUBLE AS blk_shared_pan,
  coalesce(x.pan = y.pan, FALSE)::DOUBLE AS blk_shared_derived_pan, coalesce(x.pin_name = y.pin_name AND x.pin_name <> '', FALSE)::DOUBLE AS blk_shared_pin_name, coalesce(x.phone = y.phone, FALSE)::DOUBLE AS blk_shared_phone,
  round(CASE WHEN x.address_raw <> '' AND y.address_raw <> '' THEN 1 - levenshtein(left(x.address_raw, 128), left(y.address_raw, 128)) / greatest(length(x.address_raw), length(y.address_raw), 1) END, 4) AS addr_levenshtein_residual
FROM {R._PAIRS}""")
def pair_features_blocks(spark, root):
    e = expressions()
    names = ("name_exact_stripped", "blk_shared_pan", "blk_shared_derived_pan", "blk_shared_pin_name", "blk_shared_phone")
    return R._pairs(spark, root).select("canonical_id_a", "canonical_id_b", *[e[n].alias(n) for n in names], F.round(e["addr_levenshtein_residual"], 4).alias("addr_levenshtein_residual"))
