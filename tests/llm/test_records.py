from __future__ import annotations

import itertools
import os
import random
import subprocess
import sys

import pyarrow as pa
import pytest

from kinfold.llm import addresses, matching, names, parties, premises, spellings
from kinfold.session import Scratch

PLACES = [(1, "Kellasandra Industrial Area", "Nidutamangala", "Manegogundi", "Kelnenagara District", "500000"), (2, "Savikabasti Layout Phase 1", None, "Bannavidoddi", "Jakkanabagilu District", "626512"), (3, "Savikabasti Layout Phase 2", None, "Bannavidoddi", "Jakkanabagilu District", "634419")]
LOCALITIES = "locality_id bigint, locality string, old_name string, taluk string, district string, pin_code string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("No. 24, 12th Crs, 7th Mn Rd, Savikabasti L/O Ph-1, 626512", ("2", "24", "", "", "12x7")),
        ("PLOT # 285 / 2, XII CROSS VII MAIN, SAVIKABASTI II PH", ("3", "285/2", "", "", "12x7")),
        ("Sy.219C, 3rd Flr, Quarry Main Road, Kellasandra I.A.", ("1", "219/c", "", "", "quarry")),
        ("Old 188/New 171, Nidu tamangala, Manegogundi Tq", ("1", "171", "188", "", "")),
        ("Shed-53 [old 18], Casnatec Godowns, SIDB Est., Kellasanrda Indl Area", ("1", "53", "18", "casnatec godowns", "sidb")),
        ("Godown 7, Near Water Tank, Export Park, 500 000", ("1", "", "", "", "export")),
        ("", ("", "", "", "", "")),
        (None, ("", "", "", "", "")),
    ],
)
def test_reading_addresses(text, want):
    a = addresses.read(text, addresses.Places(PLACES))
    assert (a.place, a.number, a.old, a.building, a.street) == want


@pytest.mark.parametrize(
    ("text", "core", "trade", "firm"),
    [
        ("M/S. Navto Marmifer Mill L.L.P.", ("navto", "marmifer"), "mills", True),
        ("FOODS, LYND OPOL PRIVATE LIM", ("lynd", "opol"), "foods", True),
        ("Sri Jayalatha C. Kesapan", ("jayalatha", "kesapan"), "", False),
        ("Royal Rinta Electls Pvt Ltd", ("rinta",), "electricals", True),
        ("", (), "", False),
        (None, (), "", False),
    ],
)
def test_reading_names(text, core, trade, firm):
    n = names.read(text)
    assert (n.core, n.trade, n.firm) == (core, trade, firm)


def test_judging_premises():
    base = ("24", "", "", "12x7")
    assert premises.judge(base, base) == 2 and premises.judge(base, ("24", "", "", "")) == 1
    assert premises.judge(base, ("24", "", "", "12x8")) == 0 and premises.judge(base, ("24/a", "", "", "12x7")) == 0
    assert premises.judge(("", "", "gresa nivas", ""), ("9", "", "gresaa nivas", "sidb")) == 2
    assert premises.judge(("", "7", "", "ring"), ("9", "7", "", "ring")) == 2 and premises.judge(("", "", "", "ring"), ("", "", "", "ring")) == 0


SHOP = "establishment_registration_no string, name string, address string, pan string, gstin string, phone string, email string, cell string, score double"
POWER = "rr_number string, consumer_name string, service_address string, phone string"
WATER = "knca_number string, consumer_name string, service_address string, phone string"
FACTORY = "licence_number string, factory_name string, address string, village_town string, taluk string, district string, pin_code string, occupier_pan string, gstin string, phone string, email string"
BOARD = "consent_file_no string, industry_name string, industrial_area string, taluk string, district string, pin_code string, pan string, gstin string, phone string, email string"


def registers(spark, hot=0):
    here = "Kellasandra Industrial Area, Manegogundi, Kelnenagara District - 500000"
    shop = [
        ("S1", "Navto Marmifer Mills LLP", f"No. 24, 12th Cross, 7th Main, {here}", None, None, "9845012345", None, "x", 1.0),
        ("S1", "Navto Marmifer Mills LLP", f"No. 24, 12th Cross, 7th Main, {here}", None, None, None, None, "x", 1.0),
        ("S2", "Kesapan Works", f"Shed No. 30, Quarry Road, {here}", "ABCPK1234F", None, None, None, None, None),
        ("S3", None, None, None, None, None, None, None, None),
        ("S4", "", "", None, None, "9999999999", None, None, None),
        ("S5", "Zorvo Ganpet Tools Private Limited", f"# 31, Mill Street, {here}", None, None, None, None, None, None),
        *[(f"SH{i:04d}", f"Hot Number{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} Foods", f"No. {i % 7 + 300}, Ring Road, {here}", None, None, None, None, None, None) for i in range(hot)],
    ]
    power = [("P1", "NAVTO MARMIFR MILL L.L.P.", "Plot # 24; Kellasndra I.A.", None), ("P2", "Jayalatha Kesapan", f"#30, Quarry Rd, {here}", "9812345678"), ("P3", "Kesapan Jayalatha", "30, Quarry St, Kellasandra Indl Area", "9812345678"), ("P4", "Gopal Landlord", f"24, 12th Cross, 7th Main, {here}", None), (None, "x", "y", None)]
    water = [("W1", "Navto Marmifer Mills", "NO. 24, XII CROSS VII MAIN, NIDUTAMANGALA", None), ("W2", "x", f"No. 24/A, 12th Cross, 7th Main, {here}", None)]
    factory = [("F1", "Marmifer Navto Mills", "No 24, 12th Cross, 7th Main", "Kellasandra Industrial Area", "Manegogundi", "Kelnenagara District", "500000", None, None, "+91 98450 12345", None), ("F2", "Zorvo Ganpet Castings", f"31, Mill St, {here}", None, None, None, None, None, None, None, None)]
    board = [("K1", "Kesapan Wks", "Kellasandra Industrial Area", "Manegogundi", "Kelnenagara District", "500000", "ABCPK1234F", None, None, None)]
    data = {"ekarmika_records": (shop, SHOP), "bescom_records": (power, POWER), "bwssb_records": (water, WATER), "fbis_records": (factory, FACTORY), "kspcb_records": (board, BOARD)}
    tables = {n: spark.createDataFrame(rows, schema) for n, (rows, schema) in data.items()}
    return tables, spark.createDataFrame(PLACES, LOCALITIES)


def pick(tables, *wanted):
    return {n: tables[n] for n in wanted}


def test_same_premises(spark):
    tables, places = registers(spark)
    parsed = premises.parsed_addresses(spark, pick(tables, "ekarmika_records", "bescom_records", "bwssb_records"), pick(tables, "fbis_records", "kspcb_records"), places, Scratch(spark, "t"))
    got = {tuple(r) for r in premises.premises_pairs(premises.same_premises(parsed)).collect()}
    assert got == {*itertools.combinations(["P1", "P4", "S1", "W1"], 2), *itertools.combinations(["P2", "P3", "S2"], 2)}


def test_streetless_records_with_number_and_building_keep_their_pairs(spark):
    forms = {"A": "gresa nivas|", "B": "gresa nivas|", "C": "gresa nivas|ring", "D": "|quarry", "E": "|", "F": "|", "G": "torva plaza|", "H": "torva plaza|"}
    rows = [(k, "r", "1", "24", "", *f.split("|")) for k, f in forms.items()]
    parsed = spark.createDataFrame(rows, "key string, register string, place string, number string, old string, building string, street string")
    got = {tuple(r) for r in premises.premises_pairs(premises.same_premises(parsed)).collect()}
    assert got == {("A", "B"), ("A", "C"), ("B", "C"), ("G", "H")}  # E and F: 24 is in two streets, and they name nothing else


def test_prefix_index_finds_what_brute_force_finds(spark):
    rnd = random.Random(7)
    parts = [("1", rnd.choice(["12", "12/3", "13", "140", ""]), "", rnd.choice(["", "gresa nivas", "gresaa nivas", "torva plaza"]), rnd.choice(["", "ring", "4x5"])) for _ in range(60)]
    rows = sorted({p for p in parts if p[1] or p[3]})
    forms = spark.createDataFrame([("|".join(p), *p) for p in rows], "form string, place string, number string, old string, building string, street string")
    index = premises._index(forms, premises.COSINE)
    vectors = {r.form: dict(zip(r.grams, r.weights)) for r in index.collect()}
    of = {"|".join(p): p[1:] for p in rows}
    want = {(a, b): premises.judge(of[a], of[b]) for a, b in itertools.combinations(sorted(of), 2)}
    want = {k for k, s in want.items() if s and sum(vectors[k[0]].get(g, 0) * w for g, w in vectors[k[1]].items()) >= premises.COSINE}
    assert {(r.form_a, r.form_b) for r in premises._verified(index, forms, premises.COSINE).collect()} == want


def test_radius_join_against_brute_force(spark):
    rnd = random.Random(11)
    base = ["navtomarmifer", "zorvoganpet", "kesapan", "tongugodur", "x"]
    texts = sorted({"".join(c for c in (rnd.choice(base)) if rnd.random() > 0.12) + rnd.choice(["", "a", "bz"]) for _ in range(150)} - {""})
    spots = spark.createDataFrame([("L1", "f", t) for t in texts] + [("L2", "f", "kesapan")], "cell string, kind string, text string")
    want = {(a, b) for a, b in itertools.combinations(texts, 2) if addresses.edit(a, b) <= 3}
    for cell in (10_000, 20):  # whole, and cut into rings and blocks
        assert {(r.text_a, r.text_b) for r in spellings.radius_join(spots, 3, cell).collect()} == want


def read(spark, tables, places, *wanted):
    return parties.read_all(spark, pick(tables, *wanted), places, Scratch(spark, "t"), pick(tables, "fbis_records", "kspcb_records"))


def test_name_variants(spark):
    tables, places = registers(spark)
    got = {tuple(r) for r in spellings.variants(read(spark, tables, places, "ekarmika_records", "fbis_records", "bescom_records")).collect()}
    assert got == {("P1", "S1"), ("F1", "S1"), ("F1", "P1"), ("P2", "P3")}


def test_names_are_compared_across_localities(spark):
    pan = "ABCPK1234F"
    rows = [("A", "MELFA PVT LTD", ["melfa"], "", True, "1", pan, None), ("B", "Mellfa Private Limited", ["mellfa"], "", True, "2", None, f"29{pan}1Z5"), ("C", "Mellfa Foods", ["mellfa"], "foods", True, "3", None, None),
            ("D", "Norlu Agencies", ["norlu"], "agencies", True, "1", None, None), ("E", "norloo agencies", ["norloo"], "agencies", True, "2", None, None),
            ("F", "Vinatke Zorvo Tools", ["vinatke", "zorvo"], "tools", True, "1", None, None), ("G", "Binatke Zorvo Tools", ["binatke", "zorvo"], "tools", True, "", None, None),
            ("H", "Kesa Torva Melfa", ["kesa", "torva", "melfa"], "", True, "1", None, None), ("I", "Kesa Torva Mellfa", ["kesa", "torva", "mellfa"], "", True, "2", None, None),
            ("J", "Jayalatha", ["jayalatha"], "", False, "1", None, None), ("K", "Jayalata", ["jayalata"], "", False, "2", None, None)]
    schema = "key string, name string, core array<string>, trade string, firm boolean, place string, pan string, gstin string, initials array<string>, number string, old string, building string, street string, phone string"
    records = spark.createDataFrame([(*r, [], "", "", "", "", None) for r in rows], schema)
    assert {tuple(r) for r in spellings.variants(records).collect()} == {("A", "B"), ("F", "G"), ("H", "I")}


def test_matching_without_labels(spark):
    tables, places = registers(spark)
    records = read(spark, tables, places, "ekarmika_records", "fbis_records", "kspcb_records", "bescom_records")
    found = matching.closed(matching.match(records), records)
    got = {(r.record_a, r.record_b) for r in found.collect()}
    assert {("F1", "S1"), ("P1", "S1"), ("K1", "S2"), ("P2", "S2")} <= got
    assert not {("F2", "S5"), ("P4", "S1"), ("S3", "P1")} & got
    assert all(0 <= r.confidence <= 1 for r in found.collect())


def test_misspelt_names_are_retrieved_across_localities(spark):
    rows = [("A", "r", "1", ["vinatke", "zorvo"], None), ("B", "s", "2", ["binatke", "zorvo"], None), ("C", "s", "", ["vinadke", "sorvo"], None),
            ("D", "r", "3", ["kesapan", "torva"], "ABCPK1234F"), ("E", "s", "4", ["kesapam", "torva"], "XYZPK1234F")]
    schema = "key string, register string, place string, core array<string>, pan string, trade string, firm boolean, initials array<string>, number string, old string, building string, street string, phone string, gstin string, email string"
    records = spark.createDataFrame([(*r, "tools", True, [], "", "", "", "", None, None, None) for r in rows], schema)
    assert {(r.record_a, r.record_b) for r in matching.match(records).collect()} == {("A", "B"), ("A", "C")}


def test_top_sets_do_not_depend_on_blocks(spark):
    tables, places = registers(spark, hot=60)
    records = read(spark, tables, places, "ekarmika_records", "fbis_records", "kspcb_records", "bescom_records")
    index = matching.weighted(matching.documents(records)).persist()
    whole, cut = ({(r.query, r.target, round(r.score, 6)) for r in matching.top_sets(index, block=b).collect()} for b in (10_000, 9))
    assert whole == cut and whole
    plain = {(r.query, r.target, round(r.score, 6)) for r in matching.top_sets(index, prune=False).collect()}
    assert whole == plain  # closing the search early changes no row


def test_likeness_of_names():
    def part(core, initials="", firm=True):
        return {"core": core.split(), "initials": initials.split(), "firm": firm}

    assert names.firms_alike(part("corsoo"), part("corsu")) == 1.0  # typed as it sounds
    assert names.firms_alike(part("prafa"), part("parfa")) >= 0.6  # one slip
    assert names.firms_alike(part("tele ganti"), part("teleganti")) == 1.0
    assert names.firms_alike(part("norfa", "a"), part("norfa altsa")) == 0.9
    assert names.firms_alike(part("norfa", "b"), part("norfa altsa")) < 0.9
    assert names.firms_alike(part(""), part("norfa")) == 0.0
    assert names.person_in_firm(part("harishwar salilore", firm=False), part("saali lore")) == 1.0
    assert names.read("Epip Iris Traders").core == ("epip", "iris") and names.read("Epip Iris Traders").trade == "traders"
    assert names.read("Stave Rynvodan (Private Limited) Modern").quality == "modern"


def test_pairs_need_evidence_beside_nearness(spark):
    # both alone in their place, so each other's best, but of other names
    rows = [("A", "r", "1", ["gundakatti"], "timbers", True), ("B", "s", "1", ["belalakatti"], "timbers", True), ("C", "s", "2", ["nelamane"], "printers", True), ("D", "r", "2", ["lavilamane"], "", False)]
    schema = "key string, register string, place string, core array<string>, trade string, firm boolean, initials array<string>, number string, old string, building string, street string, phone string, pan string, gstin string, email string"
    records = spark.createDataFrame([(*r, [], "", "", "", "", None, None, None, None) for r in rows], schema)
    assert matching.match(records).count() == 0


def test_workers_need_no_copy_of_the_package(tmp_path):
    """p1, p2 and p4 from a driver in another folder, with the package on the driver's path only."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from kinfold.session import build_session\n"
        "from kinfold.llm import queries\n"
        "spark = build_session('away', 'local[2]', spark__sql__shuffle__partitions='2', spark__driver__memory='2g')\n"
        "for name in ('p1_found', 'p2_found', 'p4_found'):\n"
        "    print(name, queries.QUERIES[name](spark, '/root/testdata/sf0.001').count())\n"
    )
    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("_found ") == 3


def test_empty_registers(spark):
    tables, places = registers(spark)
    none = {n: t.limit(0) for n, t in tables.items()}
    parsed = premises.parsed_addresses(spark, pick(none, "ekarmika_records", "bescom_records"), pick(none, "fbis_records", "kspcb_records"), places.limit(0), Scratch(spark, "t"))
    assert premises.premises_pairs(premises.same_premises(parsed)).count() == 0
    records = read(spark, none, places, "ekarmika_records", "fbis_records")
    assert spellings.variants(records).count() == 0
    assert matching.closed(matching.match(records), records).count() == 0


def plain_distance(a, b, exchanges):
    """The whole table of edit distances, with exchanged neighbours as one slip if asked for."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if exchanges and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distances_equal_the_plain_table():
    rnd = random.Random(8)
    for _ in range(3000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 8)))
        b = "".join(rnd.sample(a, len(a))) if rnd.random() < 0.3 else "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40)))
        most = rnd.choice([1, 3, 99])
        for measure, exchanges in ((addresses.edit, False), (addresses.slips, True)):
            got, want = measure(a, b, most), plain_distance(a, b, exchanges)
            assert got == want or min(got, want) > most, (a, b, most)


def test_places_met_before_are_not_looked_up_again(monkeypatch):
    """A worker keeps its places between tasks and finds the place of a wording once."""
    rows = [("1", "Hosugere Layout", "", "Kadur", "Mysagar District", "560001"), ("2", "Belinagara", "", "Kadur", "Mysagar District", "560002")]
    looked, find = [], addresses.Places._find
    monkeypatch.setattr(addresses.Places, "_find", lambda self, *x: looked.append(x) or find(self, *x))
    for n in range(50):
        known = addresses.opened(list(rows))
        assert addresses.read(f"{n + 1}, Kiln Road, Hosugare Layout", known).place == "1"
        assert [p for p, _ in addresses.places_named(f"# {n + 1}, Belinagara", known, "Belinagar ; Kadur", None)] == ["2"] * 3
    assert len(looked) <= 4
    assert addresses.opened(rows, [("navagrama", "2")]).find("navagrama", "", 0)[0] == "2"


def test_rows_read_by_column_equal_to_pylist():
    kind = pa.struct([("a", pa.string()), ("b", pa.list_(pa.string())), ("c", pa.bool_()), ("d", pa.list_(pa.float64())), ("e", pa.float64()), ("f", pa.int64())])
    rows = [{"a": None if i % 3 == 0 else f"é{i}", "b": [str(k) for k in range(i % 4)], "c": i % 2 == 0, "d": [0.5 * k for k in range(i % 3)], "e": i / 7, "f": None if i == 4 else i} for i in range(50)]
    held = pa.array([*rows, dict.fromkeys("abcdef")], kind)
    for some in (held, held[:50], held[7:31], held[49:], held[:0]):
        assert parties.dicts(some) == some.to_pylist()
    assert parties.dicts(pa.RecordBatch.from_struct_array(held).slice(9, 5)) == rows[9:14]


def test_words_compared_before_are_not_measured_again(monkeypatch):
    measured, slips = [], names.slips
    monkeypatch.setattr(names, "slips", lambda *x: measured.append(x) or slips(*x))
    first = names.closeness("hosugereqx", "hosagereqx")
    assert 0.5 < first < 1.0 and len(measured) <= 2
    assert all(names.closeness("hosugereqx", "hosagereqx") == first for _ in range(9)) and len(measured) <= 2
