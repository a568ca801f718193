"""Registered queries of the entity-resolution and activity operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import canonical as C
from kinfold.functions import dictionaries as D
from kinfold.functions import similarity as S
from kinfold.operators import activity, adapters, blocking, clustering, features, reports, review, scoring
from kinfold.session import Scratch, table

REFERENCE_DAY = "2025-05-01"
SQL_WEIGHTS = {k: v for k, v in D.HEURISTIC_WEIGHTS.items() if k in ("name_jaccard_trigram", "addr_pin_eq", "id_phone_eq", "id_pan_agreement", "blk_shared_pan")}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


# --- inputs ----------------------------------------------------------------------------------------


def _events(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "activity_events").withColumn("event_type", F.lower(F.trim("event_type")))
    return activity.append_events(rows)


def _records(spark: SparkSession, root: str) -> DataFrame:
    """Earlier intake, each record once, with block keys."""
    rows = table(spark, root, "canonical_records").where("canonical_id IS NOT NULL").distinct()
    email = C.clean_email(F.col("email"))
    parts = rows.withColumns(
        {
            "pan": C.clean_pan(F.col("pan")), "legal_entity_pan": C.clean_pan(F.col("pan")), "phone": C.clean_phone(F.col("phone")),
            "pin_code": C.pin_code(F.col("pin_code")), "name_legal_form_stripped": C.strip_legal_suffix(F.col("name_normalized")),
            "door_number": C.door_number(F.col("address_raw")), "email": email, "email_domain": C.email_domain(email), "legal_form": _legal_form(F.col("name_normalized")),
        }
    )
    _, pin_name, pin_door = C.block_keys(F.col("name_legal_form_stripped"), F.col("pin_code"), F.col("door_number"))
    return parts.withColumns({"blocking_pin_name": pin_name, "blocking_pin_door": pin_door})


def _legal_form(name: Column) -> Column:
    """The legal form that a name states in whole words; NULL if none."""
    words = (("limited liability partnership", "llp"), ("private ltd", "pvt_ltd"), ("pvt limited", "pvt_ltd"), *D.FACTORY_LEGAL_FORMS)
    return C.first_contained(F.concat(F.lit(" "), F.regexp_replace(name, r"\.", ""), F.lit(" ")), tuple((f" {w} ", v) for w, v in words))


def _sql_blocks(spark: SparkSession, root: str) -> DataFrame:
    """The records with the blocks that the SQL of union_blocking and block_sizes states: all but pin_door."""
    return _records(spark, root).withColumn("blocking_pin_door", F.lit(""))


def _scored(spark: SparkSession, root: str) -> DataFrame:
    """Latest score of each unordered pair: a, b, p."""
    rows = table(spark, root, "linkage_pairs").where("canonical_id_a <> canonical_id_b")
    ends = rows.select(F.least("canonical_id_a", "canonical_id_b").alias("a"), F.greatest("canonical_id_a", "canonical_id_b").alias("b"), F.struct("scored_at", "calibrated_probability").alias("s"))
    return ends.groupBy("a", "b").agg(F.max("s")["calibrated_probability"].alias("p")).withColumn("det_match", F.lit(None).cast("boolean"))


_EVENTS = """(SELECT event_id, source_system, source_record_id, lower(trim(event_type)) AS event_type, event_date, ingested_at, ubid
  FROM activity_events WHERE event_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at) = 1)"""

_RECORDS = r"""(SELECT *, CASE WHEN pin IS NULL THEN '' ELSE pin || '|' || rpad(left(replace(stripped, ' ', ''), 4), 4, '_') END AS pin_name FROM (
  SELECT DISTINCT canonical_id, source_system, source_record_id, name_raw, name_normalized, ubid, employee_count, registration_date, address_raw, ingested_at,
    trim(regexp_replace(name_normalized, ' (?:SUFFIXES)$', '')) AS stripped,
    CASE WHEN regexp_matches(regexp_replace(upper(trim(pan)), '[ -]', '', 'g'), '^[A-Z]{5}[0-9]{4}[A-Z]$') THEN regexp_replace(upper(trim(pan)), '[ -]', '', 'g') END AS pan,
    nullif(regexp_extract(pin_code, '\b[1-9][0-9]{5}\b', 0), '') AS pin,
    CASE WHEN regexp_matches(dg, '^[6-9][0-9]{9}$') THEN dg END AS phone
  FROM (SELECT *, CASE WHEN regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^91[0-9]{10}$') THEN substr(regexp_replace(phone, '[^0-9]', '', 'g'), 3, 10)
    ELSE regexp_replace(phone, '[^0-9]', '', 'g') END AS dg FROM canonical_records WHERE canonical_id IS NOT NULL)))""".replace(
    "SUFFIXES", "|".join(sorted((s for s in D.LEGAL_SUFFIXES if s.replace(" ", "").isalnum()), key=len, reverse=True))
)

_SCORED = """(SELECT least(canonical_id_a, canonical_id_b) AS a, greatest(canonical_id_a, canonical_id_b) AS b, calibrated_probability AS p
  FROM linkage_pairs WHERE canonical_id_a <> canonical_id_b
  QUALIFY row_number() OVER (PARTITION BY 1, least(canonical_id_a, canonical_id_b), greatest(canonical_id_a, canonical_id_b) ORDER BY scored_at DESC NULLS LAST, calibrated_probability DESC NULLS LAST) = 1)"""

_SIGNALS = "(VALUES " + ", ".join(f"('{k}', {w}, {t or 365}.0, {s}, {str(c).upper()})" for k, (w, t, s, c) in D.SIGNALS.items()) + ") AS sig(event_type, w, tau, sgn, closes)"

_CONTRIB = f"""(SELECT ubid AS identity, event_id, e.event_type, event_date, closes,
    CASE WHEN closes THEN w ELSE sgn * w * exp(-greatest(DATE '{REFERENCE_DAY}' - event_date, 0) / (1.5 * tau)) END AS contribution
  FROM {_EVENTS} e JOIN {_SIGNALS} ON e.event_type = sig.event_type
  WHERE ubid IS NOT NULL AND event_date BETWEEN DATE '{REFERENCE_DAY}' - 730 AND DATE '{REFERENCE_DAY}')"""

_VERDICTS = f"""(SELECT identity, CASE WHEN closed_by IS NOT NULL THEN 'closed' WHEN coalesce(raw, 0) >= 1.5 THEN 'active' WHEN coalesce(raw, 0) >= 0.4 THEN 'dormant' ELSE 'closed_by_silence' END AS verdict,
    CASE WHEN closed_by IS NOT NULL THEN 0.0 ELSE round(coalesce(raw, 0), 4) END AS score, coalesce(n, 0) AS n_events, closed_by
  FROM (SELECT DISTINCT ubid AS identity FROM canonical_records WHERE ubid IS NOT NULL)
  LEFT JOIN (SELECT identity, sum(contribution) AS raw, count(*) AS n, arg_max(event_type, (event_date, event_id)) FILTER (closes) AS closed_by FROM {_CONTRIB} GROUP BY identity) USING (identity))"""

# --- activity --------------------------------------------------------------------------------------


def _contributions(spark: SparkSession, root: str) -> DataFrame:
    return activity.contributions(_events(spark, root), REFERENCE_DAY)


def _verdicts(spark: SparkSession, root: str) -> DataFrame:
    identities = table(spark, root, "canonical_records").where("ubid IS NOT NULL").select(F.col("ubid").alias("identity")).distinct()
    return activity.verdicts(identities, _contributions(spark, root))


@query(f"SELECT * FROM {_VERDICTS}")
def verdict_scores(spark, root):
    return _verdicts(spark, root)


@query(f"SELECT verdict, count(*) AS n FROM {_VERDICTS} GROUP BY verdict")
def verdict_distribution(spark, root):
    return activity.verdict_distribution(_verdicts(spark, root))


@query(f"""SELECT identity, rank, round(sum(contribution), 4) + 0.0 AS contribution, CASE WHEN rank <= 7 THEN min(event_id) END AS event_id, count(*) AS n_events
FROM (SELECT *, least(row_number() OVER (PARTITION BY identity ORDER BY abs(contribution) DESC, event_id), 8)::INT AS rank FROM {_CONTRIB}) GROUP BY identity, rank""")
def evidence_top7(spark, root):
    return activity.top_evidence(_contributions(spark, root))


@query(f"SELECT identity, count(*) AS n_entries, max(event_date) AS latest FROM {_CONTRIB} GROUP BY identity")
def evidence_timeline(spark, root):
    lines = activity.evidence(_contributions(spark, root))
    return lines.groupBy("identity").agg(F.count(F.lit(1)).alias("n_entries"), F.max("event_date").alias("latest"))


@query(f"SELECT identity, event_date, event_id, event_type, round(contribution, 4) + 0.0 AS contribution FROM {_CONTRIB}")
def evidence_lines(spark, root):
    return activity.evidence(_contributions(spark, root))


@query(f"""SELECT ubid AS identity, source_system, min(event_date) AS first_event, max(event_date) AS last_event, count(*) AS n_events,
count(*) FILTER (event_date > DATE '{REFERENCE_DAY}' - 30 AND event_date <= DATE '{REFERENCE_DAY}') AS n_last_30d FROM {_EVENTS} WHERE ubid IS NOT NULL GROUP BY 1, 2""")
def source_lanes(spark, root):
    return activity.source_lanes(_events(spark, root), REFERENCE_DAY)


_MAP = "(SELECT source_system, source_record_id, min(ubid) AS u FROM canonical_records GROUP BY 1, 2)"


def _mapping(spark, root):
    return table(spark, root, "canonical_records").select("source_system", "source_record_id", "ubid")


@query(f"SELECT source_system, count(u) AS joined, count(*) - count(u) AS quarantined FROM {_EVENTS} e LEFT JOIN {_MAP} m USING (source_system, source_record_id) GROUP BY source_system")
def event_join_quarantine(spark, root):
    joined, waiting = activity.resolve(_events(spark, root), _mapping(spark, root))
    both = joined.select("source_system", F.lit(1).alias("j")).unionByName(waiting.select("source_system", F.lit(0).alias("j")))
    return both.groupBy("source_system").agg(F.sum("j").alias("joined"), F.sum(1 - F.col("j")).alias("quarantined"))


@query(f"SELECT event_id, u AS ubid FROM {_EVENTS} e LEFT JOIN {_MAP} m USING (source_system, source_record_id)")
def event_remap(spark, root):
    return activity.remap(_events(spark, root), _mapping(spark, root)).select("event_id", "ubid")


@query(f"SELECT event_id, event_type, source_system, ubid, event_date FROM {_EVENTS}")
def events_first_wins(spark, root):
    return _events(spark, root).select("event_id", "event_type", "source_system", "ubid", "event_date")


@query("SELECT event_id, count(*) AS n FROM activity_events GROUP BY event_id HAVING count(*) > 1")
def duplicate_events(spark, root):
    return reports.duplicate_events(table(spark, root, "activity_events"))


@query("SELECT count(*) AS total, count(ubid) AS with_identity, count(DISTINCT ubid) AS identities, min(event_date) AS first_day, max(event_date) AS last_day FROM activity_events")
def event_summary(spark, root):
    return reports.event_summary(table(spark, root, "activity_events"))


@query("SELECT event_type, count(*) AS n FROM activity_events WHERE event_type IS NOT NULL GROUP BY event_type")
def events_by_type(spark, root):
    return reports.events_by(table(spark, root, "activity_events"), "event_type")


# --- analytical queries ----------------------------------------------------------------------------


def _identities(spark, root):
    at = table(spark, root, "canonical_records").where("ubid IS NOT NULL").groupBy(F.col("ubid").alias("identity")).agg(F.min("pin_code").alias("pin_code"), F.min("district").alias("district"))
    return _verdicts(spark, root).join(at, "identity").withColumnRenamed("identity", "ubid").withColumn("sector", F.lit(None).cast("string"))


_PLACES = "(SELECT ubid, min(pin_code) AS pin_code, min(district) AS district FROM canonical_records WHERE ubid IS NOT NULL GROUP BY ubid)"


@query(f"""WITH rows AS (SELECT v.identity AS ubid, verdict, score, pin_code, district,
  (SELECT count(*) FROM {_RECORDS} r WHERE r.ubid = v.identity) AS n_records
  FROM {_VERDICTS} v JOIN {_PLACES} p ON p.ubid = v.identity
  WHERE verdict = 'active' AND v.identity IN (SELECT ubid FROM canonical_records WHERE source_system = 'fbis')
  AND NOT EXISTS (SELECT 1 FROM {_EVENTS} e WHERE e.ubid = v.identity AND e.event_type = 'fac_inspection' AND event_date >= DATE '{REFERENCE_DAY}' - 365))
SELECT *, count(*) OVER () AS total FROM rows""")
def active_without_inspection(spark, root):
    return reports.active_businesses(_identities(spark, root), _records(spark, root), _events(spark, root), source="fbis", no_event_type="fac_inspection", days=365, reference=REFERENCE_DAY)


@query(f"""SELECT r.ubid, coalesce(any_value(v.verdict), 'unknown') AS verdict, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS sources, max(name_raw) AS name, count(*) AS n_records,
  coalesce(any_value(m.n_must), 0) AS n_must,
  CASE WHEN count(*) < 2 THEN 'singleton' WHEN count(*) * (count(*) - 1) / 2 = coalesce(any_value(m.n_must), 0) THEN 'approved' ELSE 'pending' END AS audit_status
FROM {_RECORDS} r LEFT JOIN {_VERDICTS} v ON v.identity = r.ubid
LEFT JOIN (SELECT ra.ubid, count(*) AS n_must FROM {_SCORED} s JOIN {_RECORDS} ra ON ra.canonical_id = s.a JOIN {_RECORDS} rb ON rb.canonical_id = s.b WHERE s.p >= 0.95 AND ra.ubid = rb.ubid GROUP BY 1) m ON m.ubid = r.ubid
WHERE r.ubid IS NOT NULL GROUP BY r.ubid""")
def identity_listing(spark, root):
    must = _scored(spark, root).where("p >= 0.95").select("a", "b", F.lit("must_link").alias("constraint"))
    return reports.listing(_identities(spark, root), _records(spark, root), must)


@query(f"SELECT pan AS legal_entity_pan, count(DISTINCT ubid) AS n_identities FROM {_RECORDS} WHERE pan IS NOT NULL GROUP BY pan")
def legal_entities(spark, root):
    return reports.legal_entities(_records(spark, root)).select("legal_entity_pan", "n_identities")


@query(f"""SELECT 'identities' AS metric, 'all' AS key, count(*) AS n FROM {_VERDICTS} UNION ALL SELECT 'records', 'all', count(*) FROM {_RECORDS}
UNION ALL SELECT 'verdict', verdict, count(*) FROM {_VERDICTS} GROUP BY verdict UNION ALL SELECT 'source', source_system, count(*) FROM {_RECORDS} GROUP BY source_system""")
def platform_stats(spark, root):
    return reports.platform_stats(_verdicts(spark, root), _records(spark, root))


# --- canonicalization ------------------------------------------------------------------------------

_ABBR = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in D.ABBREVIATIONS.items()) + "}"
_TOKENS = r"list_transform(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(trim(name))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: coalesce(element_at(ABBR, w)[1], w))".replace("ABBR", _ABBR)
_SUFFIX = "|".join(sorted((s for s in D.LEGAL_SUFFIXES if s.replace(" ", "").isalnum()), key=len, reverse=True))


@query(f"""SELECT key, normalized, stripped, rpad(left(replace(stripped, ' ', ''), 4), 4, '_') AS prefix4 FROM (
SELECT key, normalized, trim(regexp_replace(normalized, ' (?:{_SUFFIX})$', '')) AS stripped FROM (
SELECT DISTINCT establishment_registration_no AS key, array_to_string({_TOKENS}, ' ') AS normalized FROM ekarmika_records))""")
def name_normalize(spark, root):
    rows = table(spark, root, "ekarmika_records").select(F.col("establishment_registration_no").alias("key"), C.name_normalized(F.col("name")).alias("normalized")).distinct()
    stripped = C.strip_legal_suffix(F.col("normalized"))
    return rows.withColumn("stripped", stripped).withColumn("prefix4", C.name_prefix4(F.col("stripped")))


_DOOR = r"(?i)(?:no[.\s]?|#|plot\s*no[.\s]?|door\s*no[.\s]?|flat\s*no[.\s]?|site\s*no[.\s]?)?\b[0-9]{1,5}(?:[/-][0-9A-Za-z]{1,5})*\b"


@query(rf"""SELECT DISTINCT rr_number AS key, nullif(regexp_extract(service_address, '\b[1-9][0-9]{{5}}\b', 0), '') AS pin_code,
trim(nullif(regexp_extract(regexp_replace(regexp_replace(trim(service_address), '\b[1-9][0-9]{{5}}\b', '', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g'), '{_DOOR}', 0), '')) AS door_number, left(service_address, 64) AS street_raw FROM bescom_records""")
def address_parts(spark, root):
    a = F.col("service_address")
    return table(spark, root, "bescom_records").select(F.col("rr_number").alias("key"), C.pin_code(a).alias("pin_code"), C.door_number(a).alias("door_number"), C.street_raw(a).alias("street_raw")).distinct()


@query(r"""SELECT DISTINCT licence_number AS key,
CASE WHEN regexp_matches(regexp_replace(upper(trim(occupier_pan)), '[ -]', '', 'g'), '^[A-Z]{5}[0-9]{4}[A-Z]$') THEN regexp_replace(upper(trim(occupier_pan)), '[ -]', '', 'g') END AS pan,
CASE WHEN regexp_matches(replace(upper(trim(gstin)), ' ', ''), '^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$') THEN replace(upper(trim(gstin)), ' ', '') END AS gstin,
CASE WHEN regexp_matches(lower(trim(email)), '^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$') THEN split_part(lower(trim(email)), '@', 2) END AS email_domain,
CASE WHEN regexp_matches(d, '^[6-9][0-9]{9}$') THEN d END AS phone
FROM (SELECT *, CASE WHEN regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^91[0-9]{10}$') THEN substr(regexp_replace(phone, '[^0-9]', '', 'g'), 3, 10) ELSE regexp_replace(phone, '[^0-9]', '', 'g') END AS d FROM fbis_records)""")
def clean_identifiers(spark, root):
    return table(spark, root, "fbis_records").select(
        F.col("licence_number").alias("key"), C.clean_pan(F.col("occupier_pan")).alias("pan"), C.clean_gstin(F.col("gstin")).alias("gstin"),
        C.email_domain(C.clean_email(F.col("email"))).alias("email_domain"), C.clean_phone(F.col("phone")).alias("phone"),
    ).distinct()


_WORDS = ", ".join(f"'{w}'" for w in D.BUSINESS_WORDS)


@query(rf"""SELECT risk, count(*) AS n FROM (SELECT DISTINCT rr_number, trim(consumer_name) <> '' AND len(regexp_split_to_array(trim(lower(consumer_name)), '\s+')) <= 2
AND NOT list_has_any(regexp_split_to_array(trim(lower(consumer_name)), '\s+'), [{_WORDS}]) AND NOT regexp_matches(consumer_name, '[0-9]') AS risk FROM bescom_records) GROUP BY risk""")
def landlord_risk(spark, root):
    rows = table(spark, root, "bescom_records").select("rr_number", C.looks_like_individual(F.col("consumer_name")).alias("risk")).distinct()
    return rows.groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


@query()
def canonical_all(spark, root):
    return adapters.adapt_all({s: table(spark, root, f"{s}_records") for s in adapters.ADAPTERS})


@query("SELECT source_system, n FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS source_system, count(DISTINCT {k}) AS n FROM {s}_records" for s, k in (("ekarmika", "establishment_registration_no"), ("fbis", "licence_number"), ("kspcb", "consent_file_no"), ("bescom", "rr_number"), ("bwssb", "knca_number"))) + ")")
def canonical_counts(spark, root):
    return canonical_all(spark, root).groupBy("source_system").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source_system, count(lat) AS located, count(*) - count(lat) AS missing, count(DISTINCT CASE WHEN lat IS NOT NULL THEN round(lat, 3)::VARCHAR || '|' || round(lon, 3)::VARCHAR END) AS n_points
FROM (SELECT DISTINCT 'kspcb' AS source_system, consent_file_no, latitude AS lat, longitude AS lon FROM kspcb_records) GROUP BY source_system""")
def geocode_coverage(spark, root):
    rows = table(spark, root, "kspcb_records").select(F.lit("kspcb").alias("source_system"), "consent_file_no", "latitude", "longitude").distinct()
    return reports.geocode_coverage(rows)


@query("""SELECT a.pin_code, round(max(2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2))))), 4) AS km
FROM (SELECT pin_code, min(latitude) AS la, min(longitude) AS lo FROM kspcb_records WHERE latitude IS NOT NULL AND pin_code IS NOT NULL GROUP BY 1) a
JOIN (SELECT pin_code, max(latitude) AS la, max(longitude) AS lo FROM kspcb_records WHERE latitude IS NOT NULL AND pin_code IS NOT NULL GROUP BY 1) b USING (pin_code) GROUP BY a.pin_code""")
def pin_extent_km(spark, root):
    rows = table(spark, root, "kspcb_records").where("latitude IS NOT NULL AND pin_code IS NOT NULL").groupBy("pin_code").agg(
        F.min("latitude").alias("la"), F.min("longitude").alias("lo"), F.max("latitude").alias("lb"), F.max("longitude").alias("ob")
    )
    return rows.select("pin_code", F.round(C.haversine_km(F.col("la"), F.col("lo"), F.col("lb"), F.col("ob")), 4).alias("km"))


# --- blocking, features, scores --------------------------------------------------------------------

_BLOCKS = f"""(SELECT canonical_id, 'phone' AS t, phone AS k FROM {_RECORDS} WHERE phone <> '' UNION ALL SELECT canonical_id, 'pan', pan FROM {_RECORDS} WHERE pan <> ''
UNION ALL SELECT canonical_id, 'legal_entity_pan', pan FROM {_RECORDS} WHERE pan <> '' UNION ALL SELECT canonical_id, 'pin_name', pin_name FROM {_RECORDS} WHERE pin_name <> '')"""


@query(f"""WITH blocks AS {_BLOCKS} SELECT x.canonical_id AS canonical_id_a, y.canonical_id AS canonical_id_b, string_agg(DISTINCT x.t, ',' ORDER BY x.t) AS shared_blocks
FROM blocks x JOIN blocks y ON x.t = y.t AND x.k = y.k AND x.canonical_id < y.canonical_id GROUP BY 1, 2""")
def union_blocking(spark, root):
    return blocking.candidates(_sql_blocks(spark, root)).withColumn("shared_blocks", F.array_join("shared_blocks", ","))


@query()
def union_blocking_all(spark, root):
    """union_blocking with all of BLOCKS."""
    return blocking.candidates(_records(spark, root)).withColumn("shared_blocks", F.array_join("shared_blocks", ","))


@query(f"WITH blocks AS {_BLOCKS} SELECT t AS block_type, count(*) AS n_keys, max(n) AS largest, sum(n * (n - 1) / 2)::BIGINT AS n_pairs FROM (SELECT t, k, count(*) AS n FROM blocks GROUP BY 1, 2) GROUP BY t")
def block_sizes(spark, root):
    return blocking.block_sizes(_sql_blocks(spark, root))


@query()
def block_sizes_all(spark, root):
    """block_sizes with all of BLOCKS."""
    return blocking.block_sizes(_records(spark, root))


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)))"


@query(f"""WITH g AS (SELECT canonical_id AS id, pin, name_normalized AS name, unnest({_GRAMS.format('name_normalized')}) AS g, len({_GRAMS.format('name_normalized')}) AS n FROM {_RECORDS} WHERE pin IS NOT NULL AND length(name_normalized) >= 3)
SELECT a.id AS id_a, b.id AS id_b FROM g a JOIN g b ON a.pin = b.pin AND a.g = b.g AND a.id <> b.id WHERE length(a.name) >= 4 GROUP BY 1, 2 HAVING count(*) >= max(a.n) * 0.6""")
def trigram_block(spark, root):
    names = _records(spark, root).where("pin_code IS NOT NULL").select(F.col("canonical_id").alias("id"), F.col("name_normalized").alias("name"), "pin_code")
    return blocking.trigram_candidates(names, "pin_code")


def _pairs(spark, root):
    pairs = _scored(spark, root).select(F.col("a").alias("canonical_id_a"), F.col("b").alias("canonical_id_b"), "p")
    records = _records(spark, root)
    none = {c: F.lit(None).cast(t) for c, t in adapters.COLUMNS.items() if c not in records.columns}
    return features.paired(pairs, records.withColumns(none))


_PAIRS = f"{_SCORED} s JOIN {_RECORDS} x ON x.canonical_id = s.a JOIN {_RECORDS} y ON y.canonical_id = s.b"
_JACCARD = f"len(list_intersect({_GRAMS.format('x.name_normalized')}, {_GRAMS.format('y.name_normalized')})) / len(list_distinct(list_concat({_GRAMS.format('x.name_normalized')}, {_GRAMS.format('y.name_normalized')})))"


@query(f"""SELECT s.a AS canonical_id_a, s.b AS canonical_id_b, round({_JACCARD}, 4) AS name_jaccard_trigram,
  (x.pin = y.pin)::DOUBLE AS addr_pin_eq, (x.phone = y.phone)::DOUBLE AS id_phone_eq, (x.pan = y.pan)::DOUBLE AS id_pan_agreement,
  round(CASE WHEN x.employee_count > 0 AND y.employee_count > 0 THEN ln(1 + least(x.employee_count, y.employee_count) / greatest(x.employee_count, y.employee_count)) END, 4) AS struct_employee_ratio_log,
  round(ln(1 + abs(x.registration_date - y.registration_date)), 4) AS struct_reg_date_diff_log
FROM {_PAIRS}""")
def pair_features_sql(spark, root):
    e = features.expressions()
    names = ("name_jaccard_trigram", "addr_pin_eq", "id_phone_eq", "id_pan_agreement", "struct_employee_ratio_log", "struct_reg_date_diff_log")
    return _pairs(spark, root).select("canonical_id_a", "canonical_id_b", *[F.round(e[n], 4).alias(n) for n in names])


@query()
def pair_features_all(spark, root):
    return features.pair_features(_pairs(spark, root)).select("canonical_id_a", "canonical_id_b", *features.NAMES)


@query(f"""SELECT reason, fired, is_match, count(*) AS n FROM (SELECT CASE WHEN x.pan = y.pan AND (substr(x.pan, 4, 1) = 'P' OR substr(y.pan, 4, 1) = 'P') THEN 'same_pan_proprietorship'
  WHEN x.pan = y.pan AND coalesce(x.pin <> y.pin, FALSE) THEN 'same_pan_other_pin' WHEN x.pan = y.pan THEN 'same_pan' WHEN x.pan <> y.pan THEN 'different_pan' ELSE 'none' END AS reason,
  reason <> 'none' AS fired, CASE reason WHEN 'same_pan' THEN TRUE WHEN 'different_pan' THEN FALSE END AS is_match FROM {_PAIRS}) GROUP BY ALL""")
def deterministic_tier(spark, root):
    pairs = _pairs(spark, root)
    for s in "ab":
        pairs = pairs.withColumn(s, F.col(s).withField("pan_is_proprietorship", C.pan_is_proprietorship(F.col(f"{s}.pan"))))
    t = pairs.select(scoring.deterministic_tier().alias("t"))
    return t.groupBy(F.col("t.reason").alias("reason"), F.col("t.fired").alias("fired"), F.col("t.is_match").alias("is_match")).agg(F.count(F.lit(1)).alias("n"))


_TERMS = {"name_jaccard_trigram": _JACCARD, "addr_pin_eq": "(x.pin = y.pin)::DOUBLE", "id_phone_eq": "(x.phone = y.phone)::DOUBLE", "id_pan_agreement": "(x.pan = y.pan)::DOUBLE", "blk_shared_pan": "coalesce(x.pan = y.pan, FALSE)::DOUBLE"}


@query(f"""SELECT a AS canonical_id_a, b AS canonical_id_b, round(raw, 4) AS score, CASE WHEN raw >= 0.95 THEN 'auto_link' WHEN raw >= 0.55 THEN 'review' ELSE 'reject' END AS decision FROM (
SELECT s.a, s.b, ({' + '.join(f"coalesce({w} * ({_TERMS[n]}), 0)" for n, w in SQL_WEIGHTS.items())}) / ({' + '.join(f"CASE WHEN ({_TERMS[n]}) IS NULL THEN 0 ELSE {w} END" for n, w in SQL_WEIGHTS.items())}) AS raw FROM {_PAIRS})""")
def heuristic_score(spark, root):
    e = features.expressions()
    rows = _pairs(spark, root).select("canonical_id_a", "canonical_id_b", *[e[n].alias(n) for n in SQL_WEIGHTS]).withColumn("raw", scoring.heuristic_score(SQL_WEIGHTS))
    return rows.select("canonical_id_a", "canonical_id_b", F.round("raw", 4).alias("score"), scoring.band(F.col("raw"), F.lit(None).cast("boolean")).alias("decision"))


@query()
def scored_pairs(spark, root):
    scored = scoring.score_pairs(_pairs(spark, root))
    top = scoring.top_factors(F.col("explanation"))
    return scored.select("canonical_id_a", "canonical_id_b", "tier.reason", "raw_score", "probability", "decision", F.to_json(top).alias("factors"))


@query()
def trained_scores(spark, root):
    """Trees trained on whether pairs share their group, applied to every pair; `held` marks the labelled
    pairs the trees were not trained on. They stop the training and fit the calibration."""
    rows = features.pair_features(_pairs(spark, root)).withColumn("label", (F.col("a.ubid") == F.col("b.ubid")).cast("int")).drop("a", "b")
    rows = Scratch(spark, "trained").write(rows)  # read by the training, the calibration and the scores
    scorer = scoring.TrainedScorer()
    scored = scorer.fit(rows.where("label IS NOT NULL")).transform(rows).withColumn("held", scorer.held() & F.col("label").isNotNull())
    return scored.select("canonical_id_a", "canonical_id_b", "label", "raw_score", "calibrated_probability", "held")


@query("SELECT DISTINCT canonical_id_a, canonical_id_b FROM linkage_pairs WHERE calibrated_probability BETWEEN 0.2 AND 0.97")
def rescore_pairs(spark, root):
    pairs = table(spark, root, "linkage_pairs")
    return scoring.to_rescore(pairs, pairs.where(F.col("calibrated_probability").between(scoring.REVIEW, scoring.AUTO)))


@query(f"SELECT a AS canonical_id_a, b AS canonical_id_b, p, round(0.6 * greatest(0, 1 - abs(p - 0.775) / 0.15) + 0.4 * 0.5, 4) AS priority, 'pending' AS status FROM {_SCORED} WHERE p >= 0.55 AND p < 0.95")
def review_queue(spark, root):
    none = F.lit(None).cast("double")
    rows = _scored(spark, root).select(F.col("a").alias("canonical_id_a"), F.col("b").alias("canonical_id_b"), "p", none.alias("name_score"), none.alias("pin_equal"))
    return review.enqueue(rows)


# --- clusters and quality --------------------------------------------------------------------------


def _reach(edges: str) -> str:
    return f"""e AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
reach(s, t) AS (SELECT a, b FROM e UNION SELECT r.s, e.b FROM reach r JOIN e ON e.a = r.t),
comp AS (SELECT s AS node, least(s, min(t)) AS component FROM reach GROUP BY s)"""


def _auto(spark, root):
    return _scored(spark, root).where("p >= 0.95")


@query(f"WITH RECURSIVE auto AS (SELECT a, b FROM {_SCORED} WHERE p >= 0.95), {_reach('auto')} SELECT * FROM comp")
def connected_components(spark, root):
    return clustering.connected_components(_auto(spark, root))


_CLUSTERS = f"""WITH RECURSIVE auto AS (SELECT a, b FROM {_SCORED} WHERE p >= 0.95), {_reach('auto')},
torn AS (SELECT DISTINCT x.component FROM {_SCORED} n JOIN comp x ON x.node = n.a JOIN comp y ON y.node = n.b WHERE n.p < 0.2 AND x.component = y.component),
clusters AS (SELECT r.node, CASE WHEN comp.component IS NULL OR comp.component IN (SELECT component FROM torn) THEN r.node ELSE comp.component END AS cluster
  FROM (SELECT DISTINCT canonical_id AS node FROM canonical_records WHERE canonical_id IS NOT NULL) r LEFT JOIN comp USING (node))"""


def _clusters(spark, root):
    none = spark.createDataFrame([], "a string, b string")
    nodes = table(spark, root, "canonical_records").where("canonical_id IS NOT NULL").select(F.col("canonical_id").alias("node"))
    return clustering.constrained_clusters(nodes, _scored(spark, root), none, none)


@query(_CLUSTERS + " SELECT * FROM clusters")
def constrained_clusters(spark, root):
    return _clusters(spark, root)


@query(_CLUSTERS + " SELECT size, count(*) AS n_clusters FROM (SELECT cluster, count(*) AS size FROM clusters GROUP BY 1) GROUP BY 1")
def cluster_sizes(spark, root):
    return clustering.cluster_sizes(_clusters(spark, root))


@query(_CLUSTERS + """, cells AS (SELECT ubid AS entity, cluster, count(*) AS n FROM clusters JOIN (SELECT DISTINCT canonical_id, ubid FROM canonical_records WHERE ubid IS NOT NULL) ON canonical_id = node GROUP BY 1, 2),
sized AS (SELECT n, sum(n) OVER (PARTITION BY cluster) AS nc, sum(n) OVER (PARTITION BY entity) AS ne FROM cells),
m AS (SELECT sum(n * n / nc) / sum(n) AS p, sum(n * n / ne) / sum(n) AS r FROM sized)
SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM m""")
def b_cubed(spark, root):
    truth = _records(spark, root).where("ubid IS NOT NULL").select(F.col("canonical_id").alias("node"), F.col("ubid").alias("entity"))
    return reports.b_cubed(_clusters(spark, root).join(truth, "node"))


def _judged(spark, root):
    records = _records(spark, root)
    a, b = records.select(F.col("canonical_id").alias("a"), F.col("ubid").alias("ua")), records.select(F.col("canonical_id").alias("b"), F.col("ubid").alias("ub"))
    return _scored(spark, root).where("p IS NOT NULL").join(a, "a").join(b, "b").select("p", (F.col("ua") == F.col("ub")).cast("int").alias("y")).where("y IS NOT NULL")


_JUDGED = f"(SELECT s.p, (x.ubid = y.ubid)::INT AS y FROM {_PAIRS} WHERE s.p IS NOT NULL AND x.ubid IS NOT NULL AND y.ubid IS NOT NULL)"


@query(f"""WITH j AS {_JUDGED}, c AS (SELECT count(*) FILTER (p >= 0.95 AND y = 1) AS tp, count(*) FILTER (p >= 0.95 AND y = 0) AS fp, count(*) FILTER (p < 0.95 AND y = 1) AS fn, count(*) FILTER (p < 0.95 AND y = 0) AS tn, count(*) AS n, avg(pow(p - y, 2)) AS brier FROM j),
g AS (SELECT sum(n * abs(mp - my)) AS gap FROM (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM j GROUP BY 1))
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1, round(brier, 4) AS brier, round(gap / n, 4) AS ece FROM c, g""")
def pair_quality(spark, root):
    return reports.confusion(_judged(spark, root), 0.95)


@query(f"""WITH j AS {_JUDGED} SELECT r.bin::INT AS bin, coalesce(n, 0) AS n, mean_p, share_true FROM (SELECT unnest(range(10)) AS bin) r
LEFT JOIN (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, round(avg(p), 4) AS mean_p, round(avg(y), 4) AS share_true FROM j GROUP BY 1) USING (bin)""")
def reliability_bins(spark, root):
    return reports.reliability(_judged(spark, root))


@query(f"SELECT b.bucket::INT AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(5)) AS bucket) b LEFT JOIN (SELECT CASE WHEN score >= 1.5 THEN 4 WHEN score >= 1.0 THEN 3 WHEN score >= 0.4 THEN 2 WHEN score >= 0.1 THEN 1 ELSE 0 END AS bucket, count(*) AS n FROM {_VERDICTS} GROUP BY 1) USING (bucket)")
def score_histogram(spark, root):
    return reports.histogram(_verdicts(spark, root), "score", (0.0, 0.1, 0.4, 1.0, 1.5, 1e9))


@query(f"""SELECT x.ubid, x.canonical_id AS a, y.canonical_id AS b, s.p AS probability FROM {_RECORDS} x JOIN {_RECORDS} y ON x.ubid = y.ubid AND x.canonical_id < y.canonical_id
LEFT JOIN {_SCORED} s ON s.a = x.canonical_id AND s.b = y.canonical_id""")
def pair_evidence(spark, root):
    none = spark.createDataFrame([], "a string, b string, constraint string")
    members = _records(spark, root).select("ubid", "canonical_id")
    return review.pair_evidence(members, table(spark, root, "linkage_pairs").where("canonical_id_a <> canonical_id_b"), none).drop("constraint")


@query("""SELECT scored_at AS at, 'link' AS kind, canonical_id_a AS detail FROM linkage_pairs UNION ALL SELECT ingested_at, 'decision', canonical_id FROM canonical_records
UNION ALL SELECT ingested_at, 'constraint', event_id FROM activity_events""")
def audit_timeline(spark, root):
    return review.audit_timeline(
        table(spark, root, "linkage_pairs").select(F.col("scored_at").alias("at"), F.col("canonical_id_a").alias("detail")),
        table(spark, root, "canonical_records").select(F.col("ingested_at").alias("at"), F.col("canonical_id").alias("detail")),
        table(spark, root, "activity_events").select(F.col("ingested_at").alias("at"), F.col("event_id").alias("detail")),
    )


@query()
def name_similarities(spark, root):
    """Ratios of the names of scored pairs."""
    na, nb = F.col("a.name_normalized"), F.col("b.name_normalized")
    return _pairs(spark, root).select(
        "canonical_id_a", "canonical_id_b", S.weighted_ratio_udf(na, nb).alias("weighted"), S.token_set_ratio_udf(na, nb).alias("token_set"),
        S.lcs_ratio_udf(na, nb).alias("lcs"), S.jaro_winkler_udf(na, nb).alias("jaro_winkler"), S.jaccard_trigram(na, nb).alias("jaccard"),
    )
