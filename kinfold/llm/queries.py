"""Registered queries of the subpackage and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import consolidate, matching, mixing, packing, pagespam, parties, premises, spellings, survivor
from kinfold.session import Scratch, table


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    wanted = {t: table(spark, root, t) for t in ("ekarmika_records", "bescom_records", "bwssb_records")}
    more = {t: table(spark, root, t) for t in ("fbis_records", "kspcb_records")}
    parsed = premises.parsed_addresses(spark, wanted, more, table(spark, root, "localities"), Scratch(spark, "p1"))
    return premises.same_premises(parsed)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return premises.premises_pairs(p1_classes(spark, root))


def _parties(spark: SparkSession, root: str, label: str, *registers: str) -> DataFrame:
    wanted = {t: table(spark, root, t) for t in registers}
    more = {t: table(spark, root, t) for t in ("fbis_records", "kspcb_records")}
    return parties.read_all(spark, wanted, table(spark, root, "localities"), Scratch(spark, label), more)


def p2_matches(spark: SparkSession, root: str) -> DataFrame:
    records = _parties(spark, root, "p2", "ekarmika_records", "fbis_records", "kspcb_records", "bescom_records")
    return matching.closed(matching.match(records, table(spark, root, "review_pairs")), records)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_matches(spark, root).select("record_a", "record_b")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return spellings.variants(_parties(spark, root, "p4", "fbis_records", "ekarmika_records", "bescom_records"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return survivor.survivors(*(table(spark, root, t) for t in ("canonical_records", "localities", "survivor_labels")))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return consolidate.consolidate(table(spark, root, "linkage_pairs"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return pagespam.spam_pages(table(spark, root, "documents"), table(spark, root, "page_labels"))


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"), table(spark, root, "container_sizes"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, root), table(spark, root, "container_sizes"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, root), table(spark, root, "mix_targets"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_matches": p2_matches,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

ORACLE: dict[str, str] = {
    "p7_found": """
WITH RECURSIVE latest AS (
  SELECT least(canonical_id_a, canonical_id_b) AS u, greatest(canonical_id_a, canonical_id_b) AS v, calibrated_probability AS p,
         row_number() OVER (PARTITION BY least(canonical_id_a, canonical_id_b), greatest(canonical_id_a, canonical_id_b)
                            ORDER BY scored_at DESC NULLS LAST, calibrated_probability DESC NULLS LAST) AS k
  FROM linkage_pairs WHERE canonical_id_a <> canonical_id_b),
e AS (SELECT u AS a, v AS b FROM latest WHERE k = 1 AND p >= 0.95 UNION SELECT v, u FROM latest WHERE k = 1 AND p >= 0.95),
reach(s, t) AS (SELECT a, b FROM e UNION SELECT r.s, e.b FROM reach r JOIN e ON e.a = r.t)
SELECT s AS canonical_id, least(s, min(t)) AS group_id FROM reach GROUP BY s""",
}
