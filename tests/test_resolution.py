from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kinfold.functions import canonical as C
from kinfold.functions import similarity as S
from kinfold.operators import activity, adapters, blocking, clustering, features, reports, review, scoring
from kinfold.sources import readers
from kinfold.streaming import ingest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (C.name_normalized, "M/s. Sharma  Trdrs Pvt. Ltd", "m s sharma traders pvt ltd"),
        (C.name_normalized, "Café Élan", "cafe elan"),
        (C.pin_code, "12, Peenya, Bengaluru 560058", "560058"),
        (C.pin_code, "no pin 01234", None),
        (C.door_number, "Plot No 7, Peenya 560058", "Plot No 7"),
        (C.door_number, "Plot No. 7, Peenya", "7"),
        (C.door_number, "", None),
        (C.locality_raw, "Plot No 7, Peenya 2nd Stage, 560058", "Peenya 2nd Stage"),
        (C.district, "x, Bangalore Urban, Mysore", "bengaluru urban"),
        (C.clean_pan, " abcpe1234f ", "ABCPE1234F"),
        (C.clean_pan, "ABC", None),
        (C.clean_gstin, "29ABCPE1234F1Z5", "29ABCPE1234F1Z5"),
        (C.clean_phone, "+91 98450-12345", "9845012345"),
        (C.clean_phone, "12345", None),
        (C.clean_email, " A@B.com ", "a@b.com"),
        (C.locality_canonical, "Peenya 1st Stage", "peenya industrial area phase 1"),
        (C.locality_canonical, "nowhere", None),
        (C.clean_connection_id, " (rr1) ", "RR1"),
        (C.looks_like_individual, "Ravi Kumar", True),
        (C.looks_like_individual, "Ravi Traders", False),
        (C.looks_like_individual, "", False),
        (C.parse_date, "05/02/2024", dt.date(2024, 2, 5)),
        (C.parse_date, "soon", None),
        (C.parse_int, "12.0", None),
        (C.parse_int, " 12 ", 12),
        (C.sector_multiplier, "Rice Mill", 2.0),
        (C.sector_multiplier, None, 1.0),
    ],
)
def test_scalars(spark, column, value, want):
    assert one(spark, column, value) == want


def test_suffix_prefix_steps_and_distance(spark):
    r = spark.createDataFrame([("sharma traders pvt ltd", "3rd Cross, II Main, Phase", 12.9, 77.5)], "n string, a string, la double, lo double").select(
        C.strip_legal_suffix(F.col("n")).alias("s"), C.name_prefix4(F.lit("ab")).alias("p"), C.step_numbers(F.col("a")).alias("k"),
        C.haversine_km(F.col("la"), F.col("lo"), F.lit(13.9), F.col("lo")).alias("km"),
        C.geocode(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("x"), F.lit("560058"), F.lit("mysuru")).alias("g"),
    ).first()
    assert (r.s, r.p, r.k) == ("sharma traders", "ab__", [3, 2])
    assert abs(r.km - 111.19) < 0.1 and r.g.latitude == 13.0286


def test_kannada_names(spark):
    df = spark.createDataFrame([("ಕಮಲ",), ("Kamala",), (None,)], "n string")
    assert sorted(x.n or "" for x in C.transliterate_kannada(df, "n").collect()) == ["", "Kamala", "kamala"]


def test_similarities():
    assert S.ratio("abcd", "abxd") == 75.0 and S.token_set_ratio("a b", "b a c") == 100.0 and S.token_set_ratio("", "a") == 0.0
    assert S.weighted_ratio("sharma traders", "traders sharma") >= 95 and S.weighted_ratio("", "x") == 0.0
    assert S.lcs_ratio("abcde", "xbcdy") == 0.6 and abs(S.jaro_winkler("martha", "marhta") - 0.9611) < 1e-3


def test_adapters_share_one_schema_and_survive_nulls(spark):
    shop = spark.createDataFrame([("S1", "Om Traders", "No 5, Peenya 560058", "ABCPE1234F", None, None, "9845012345", None, "7")] * 2 + [(None,) * 9], "establishment_registration_no string, name string, address string, pan string, gstin string, email string, phone string, nature_of_business string, employee_count string")
    power = spark.createDataFrame([("(r1)", None, None, "Ravi Kumar", None, "LT", "x")], "rr_number string, account_id string, k_number string, consumer_name string, service_address string, tariff_category string, sanctioned_load_kw string")
    rows = {r.source_record_id: r for r in adapters.adapt_all({"ekarmika": shop, "bescom": power}).collect()}
    assert set(rows) == {"S1", "R1"}
    s = rows["S1"]
    assert (s.pin_code, s.door_number, s.blocking_pin_door, s.employee_count, s.pan_is_proprietorship, s.name_legal_form_stripped) == ("560058", "No 5", "560058|No 5", 7, True, "om")
    assert rows["R1"].bescom_consumer_name_risk and rows["R1"].blocking_pin_name == ""


RECORD = {"pan": None, "gstin": None, "legal_entity_pan": None, "pan_is_proprietorship": False, "pin_code": None}


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ({"pan": "A"}, {"pan": "A"}, (True, True, 1.0)),
        ({"pan": "A"}, {"pan": "B"}, (True, False, 0.0)),
        ({"pan": "A", "pan_is_proprietorship": True}, {"pan": "A"}, (True, None, 0.7)),
        ({"pan": "A", "pin_code": "1"}, {"pan": "A", "pin_code": "2"}, (True, None, 0.6)),
        ({"gstin": "29ABCDE1234F1Z5"}, {"gstin": "29ABCDE1234F1Z5"}, (True, True, 1.0)),
        ({"gstin": "29ABCDE1234F1Z5"}, {"gstin": "29ABCDE1234F2Z5"}, (False, None, None)),
        ({"legal_entity_pan": "A"}, {"legal_entity_pan": "A"}, (True, None, 0.75)),
        ({}, {}, (False, None, None)),
    ],
)
def test_deterministic_tier(spark, a, b, want):
    kind = "struct<pan:string,gstin:string,legal_entity_pan:string,pan_is_proprietorship:boolean,pin_code:string>"
    row = spark.createDataFrame([(tuple({**RECORD, **a}.values()), tuple({**RECORD, **b}.values()))], f"a {kind}, b {kind}")
    t = row.select(scoring.deterministic_tier().alias("t")).first().t
    assert (t.fired, t.is_match, t.probability) == want


def test_features_blocks_and_bands(spark):
    shop = spark.createDataFrame(
        [("S1", "Om Traders", "No 5, Peenya 560058", "9845012345"), ("S2", "Om Trdrs", "No 5, Peenya, 560058", "9845012345"), ("S3", "Zed Mills", "x", None)],
        "establishment_registration_no string, name string, address string, phone string",
    )
    records = adapters.adapt(shop, "ekarmika")
    pairs = blocking.candidates(records)
    assert [r.shared_blocks for r in pairs.collect()] == [["phone", "pin_door", "pin_name"]]
    f = features.pair_features(features.paired(pairs, records)).first()
    assert len(features.NAMES) == 25 and f.blk_n_shared == 3.0 and f.id_pan_agreement is None and f.addr_pin_eq == 1.0 and 0.8 < f.name_jaro_winkler <= 1.0
    out = scoring.score(features.pair_features(features.paired(pairs, records))).first()
    assert out.decision in ("review", "auto_link") and not out.tier.fired
    assert blocking.candidates(records, seen=pairs).count() == 0 and blocking.oversized(records, 1).count() == 3


def test_decay_and_verdicts(spark):
    day = "2024-02-01"
    rows = [("e1", "bescom_bill_paid", dt.date(2024, 1, 20), "A"), ("e2", "bescom_bill_paid", dt.date(2024, 1, 30), "A"), ("e3", "se_closure", dt.date(2023, 5, 1), "B"), ("e4", "bescom_bill_paid", dt.date(2024, 1, 30), "B"), ("e5", "fac_inspection", dt.date(2020, 1, 1), "C"), ("e6", "se_renewal_pre2019", dt.date(2023, 9, 1), "D"), ("e7", "nonsense", dt.date(2024, 1, 1), "E")]
    events = spark.createDataFrame(rows, "event_id string, event_type string, event_date date, ubid string")
    c = activity.contributions(events, day)
    assert abs({r.event_id: r.contribution for r in c.collect()}["e1"] - 0.9 * math.exp(-12 / 45)) < 1e-12
    ids = spark.createDataFrame([(x, None, dt.date(2024, 1, 15) if x == "F" else None) for x in "ABCDEF"], "identity string, sector string, registration_date date")
    got = {r.identity: r for r in activity.verdicts(ids, c, reference=day).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"A": "active", "B": "closed", "C": "closed_by_silence", "D": "dormant", "E": "closed_by_silence", "F": "nascent"}
    assert got["B"].score == 0.0 and got["B"].closed_by == "se_closure"
    top = activity.top_evidence(c, 1).where("identity = 'A'").orderBy("rank").collect()
    assert [(r.event_id, r.n_events) for r in top] == [("e2", 1), (None, 1)]


def test_quarantine_and_retry(spark):
    events = spark.createDataFrame([("e1", "bescom", "r1"), ("e2", "bescom", "r9"), ("e3", None, None)], "event_id string, source_system string, source_record_id string")
    mapping = spark.createDataFrame([("bescom", "r1", "U2"), ("bescom", "r1", "U1")], "source_system string, source_record_id string, ubid string")
    joined, waiting = activity.resolve(events, mapping)
    assert [(r.event_id, r.ubid) for r in joined.collect()] == [("e1", "U1")] and waiting.count() == 2
    more = spark.createDataFrame([("bescom", "r9", "U9")], "source_system string, source_record_id string, ubid string")
    resolved, after = activity.retry_quarantine(waiting, more)
    assert [r.event_id for r in resolved.collect()] == ["e2"]
    assert sorted((r.event_id, r.retry_count, r.resolved) for r in after.collect()) == [("e2", 0, True), ("e3", 1, False)]
    assert activity.quarantine_stats(after).first().asDict() == {"total": 2, "unresolved": 1, "resolved": 1}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


def test_clustering(spark):
    e = edges(spark, [("1", "2"), ("3", "2"), ("4", "5"), ("6", "6"), (None, "7")])
    assert {r.node: r.component for r in clustering.connected_components(e).collect()} == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4"}
    chain = edges(spark, [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)])
    assert {r.component for r in clustering.connected_components(chain).collect()} == {"000"}
    nodes = spark.createDataFrame([(str(i),) for i in range(1, 8)], "node string")
    scored = spark.createDataFrame([("1", "2", 0.99, None), ("2", "3", 0.99, None), ("1", "3", 0.1, None), ("4", "5", 0.5, True)], "a string, b string, p double, det_match boolean")
    none = spark.createDataFrame([], "a string, b string")
    got = {r.node: r.cluster for r in clustering.constrained_clusters(nodes, scored, none, none).collect()}
    assert got == {"1": "1", "2": "2", "3": "3", "4": "4", "5": "4", "6": "6", "7": "7"}
    got = {r.node: r.cluster for r in clustering.constrained_clusters(nodes, scored, edges(spark, [("1", "3")]), edges(spark, [("4", "5")])).collect()}
    assert got["1"] == got["2"] == got["3"] == "1" and got["4"] != got["5"]


def test_identities_merge_split_regroup(spark):
    clusters = spark.createDataFrame([("1", "1"), ("2", "1"), ("3", "3")], "node string, cluster string")
    before = spark.createDataFrame([("2", "U7"), ("1", "U9")], "node string, identity string")
    got = {r.node: r.identity for r in clustering.assign_identities(clusters, before).collect()}
    assert got["1"] == got["2"] == "U7" and got["3"].startswith("U") and got["3"] != "U7"
    members = spark.createDataFrame([("1", "U1"), ("2", "U2"), ("3", "U2")], "node string, identity string")
    merged = {r.node: r.identity for r in clustering.merge_identities(members, edges(spark, [("1", "3"), ("8", "9")])).collect()}
    assert merged["1"] == merged["2"] == merged["3"] == "U1" and merged["8"] == merged["9"] not in ("U1", "U2")
    split = {r.node: r.identity for r in clustering.split_identities(members, edges(spark, [("2", "3"), ("1", "2")])).collect()}
    assert split["1"] == "U1" and split["2"] == "U2" and split["3"] not in ("U1", "U2")
    groups = spark.createDataFrame([("2", "x"), ("3", "solo"), ("1", "x"), ("7", "x")], "node string, label string")
    moved, rules, wrong = clustering.regroup(members, groups)
    assert {r.node: r.identity for r in moved.collect()}["2"] == "U2" and [(r.node, r.problem) for r in wrong.collect()] == [("7", "foreign")]
    assert [(r.a, r.b, r.constraint) for r in rules.collect()] == [("2", "3", "cannot_link")]
    assert clustering.approve(members.where("identity = 'U2'")).count() == 1


def test_review_loop(spark):
    log = spark.createDataFrame(
        [("a", "b", "confirm", "r1", "senior", "2024-01-01"), ("b", "a", "reject", "r1", "senior", "2024-01-02"), ("c", "d", "defer", "r2", "junior", "2024-01-01"), ("e", "f", "flag_quality", "r2", "junior", "2024-01-01")],
        "a string, b string, decision string, reviewer string, tier string, decided_at string",
    )
    rules, labels, queue = review.apply_decisions(log)
    assert [(r.a, r.b, r.constraint) for r in rules.collect()] == [("a", "b", "cannot_link")] and labels.first().label == 0
    assert sorted((r.a, r.status, r.priority_raise) for r in queue.collect()) == [("a", "decided", 0.0), ("c", "pending", 0.3)]
    board = {r.reviewer: r for r in review.leaderboard(log).collect()}
    assert (board["r1"]["confirm"], board["r1"]["reject"], board["r2"]["confirm"]) == (1, 1, 0)
    truth = spark.createDataFrame([(f"r{i}", f"e{i // 3}") for i in range(30)], "record string, entity string")
    pairs = review.training_pairs(truth)
    assert pairs.where("label = 1").count() == 30 and pairs.where("label = 0").count() > 0
    train, held = review.holdout(pairs)
    assert train.intersect(held).count() == 0 and train.count() + held.count() == pairs.count()
    assert review.label_budget(labels, None).first().recommendation == "wait"


def test_quality_metrics(spark):
    rows = spark.createDataFrame([(0.99, 1), (0.96, 0), (0.3, 0), (0.2, 1), (1.5, 1)], "p double, y int")
    m = reports.confusion(rows, 0.95).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.precision, m.recall) == (2, 1, 1, 1, 0.6667, 0.6667)
    bins = {r.bin: r.n for r in reports.reliability(rows, 10).collect()}
    assert len(bins) == 10 and sum(bins.values()) == 4 and bins[9] == 2
    assert reports.b_cubed(spark.createDataFrame([("e", "c"), ("e", "c"), ("f", "c")], "entity string, cluster string")).first().precision == round(5 / 9, 4)
    assert [r.n for r in reports.histogram(spark.createDataFrame([(0.5,), (9.0,), (None,)], "v double"), "v", (0.0, 1.0, 2.0, 3.0)).orderBy("bucket").collect()] == [1, 0, 1]


def test_readers_and_streaming(spark, tmp_path):
    good = '{"event_id": "e1", "source_system": "bescom", "source_record_id": "r1", "event_type": "bescom_bill_paid", "event_date": "2024-01-01", "metadata": {"amount": "1"}}'
    later = good.replace('"e1"', '"e2"').replace("r1", "r2")
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(good + "\n\nnot json\n" + good + "\n" + later + '\n{"event_id": "e3", "source_system": "bescom", "event_type": "zzz", "event_date": "2024-01-01"}\n')
    valid, rejected = readers.read_events_jsonl(spark, str(src))
    assert valid.count() == 3 and sorted(r.reason for r in rejected.collect()) == ["not an event object", "unknown event type"]
    mapping = spark.createDataFrame([("bescom", "r1", "U1")], "source_system string, source_record_id string, ubid string")
    stream = spark.readStream.schema("value string").text(str(src))
    for _ in range(2):  # the second run finds nothing new
        q = ingest.start_ingest(stream, lambda: mapping, str(tmp_path / "out"), str(tmp_path / "ckpt"))
        q.processAllAvailable()
        q.stop()
        (src / "b.json").write_text(good + "\n")
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "out/joined")).collect()] == ["e1"]
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "out/quarantine")).collect()] == ["e2"]
    assert readers.synthetic_water_events(spark, 3, 4).count() == 12
    truth = spark.createDataFrame([("E1", "s1; s2", None)], "entity_id string, shops string, power string")
    assert readers.ground_truth(truth, {"shops": "ekarmika", "power": "bescom"}).count() == 2
    csv = tmp_path / "r.csv"
    csv.write_text("a,b\n1,\n")
    assert readers.read_register_csv(spark, str(csv), ["a", "b"]).first().b is None


def test_approximate_localities(spark):
    df = spark.createDataFrame([("Area Industrial Jigani",), ("Peenya 1st Stage",), ("nowhere at all",), (None,)], "l string")
    got = {r.l: r.l_canonical for r in S.resolve_localities(df, "l").collect()}
    assert got == {"Area Industrial Jigani": "jigani industrial area", "Peenya 1st Stage": "peenya industrial area phase 1", "nowhere at all": None, None: None}
