from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter

import numpy as np

from kinfold.llm import fitting, pagespam, survivor

DOCS = "doc_id bigint, text string, term string, n bigint, is_spam int"


def corpus(spark):
    rnd = random.Random(2)
    subjects, verbs, rest = ["the court", "the tenant", "the carrier", "the clerk"], ["finds", "denies", "accepts", "records"], ["the claim for rent.", "that notice was served.", "the order of costs.", "no further appeal."]
    towns = ["Pellam", "Orrin", "Isker", "Quarley", "Rostow", "Dunmarsh"]
    rows, labels = [], []
    for i in range(160):
        if i % 4 == 0:
            words = [rnd.choice(["tax refund", "lawyer", "loan today", "bail bonds"]) + " " + rnd.choice(towns) for _ in range(60)]
            text = rnd.choice([", ", " / ", "\n"]).join(words)
        else:
            text = " ".join(f"{rnd.choice(subjects)} {rnd.choice(verbs)} {rnd.choice(rest)}" for _ in range(rnd.randint(8, 40)))
        rows.append((i, text, "t", 1, 1))
        if i < 80:
            labels.append((i, int(i % 4 == 0)))
    odd = [(900, None, None, None, None), (901, "", None, None, None), (902, "tax refund", None, None, None), (None, "tax refund " * 50, None, None, None), rows[0], (903, "x " * 30000, None, None, None)]
    return spark.createDataFrame([*rows, *odd], DOCS), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, is_spam int")


def test_information_against_brute_force(spark):
    docs, _ = corpus(spark)
    got = {bytes(r.term): r.pmi for r in pagespam.pair_information(pagespam.corpus_counts(docs)).collect()}
    single, pairs = Counter(), Counter()
    for r in docs.collect():
        w = pagespam.words(r.text)
        single.update(w)
        pairs.update(zip(w, w[1:]))
    n, m = sum(single.values()), sum(pairs.values())
    want = {a + b" " + b: math.log((k / m) / (single[a] / n * single[b] / n)) for (a, b), k in pairs.items()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_spam_pages_held_out_and_both_paths(spark):
    docs, labels = corpus(spark)
    found = {r.doc_id for r in pagespam.spam_pages(docs, labels).collect()}
    unseen = set(range(80, 160))
    assert found & unseen == {i for i in unseen if i % 4 == 0}
    assert not found & {900, 901, 902, None}
    joined = {r.doc_id for r in pagespam.spam_pages(docs, labels, max_broadcast=0).collect()}
    assert joined == found
    assert pagespam.spam_pages(docs.limit(0), labels).count() == 0
    assert pagespam.scored(docs, labels.limit(0)).count() == docs.count()


def test_fit_survives_separable_samples():
    x = np.array([[i / 10, 1.0] for i in range(-50, 50)])
    w = fitting.logistic(x, (x[:, 0] > 0).astype(float), np.ones(100), 0.01)
    assert np.isfinite(w).all() and w[0] > 0
    sets = [(np.array([[0.0], [1.0]]), 1)] * 50
    assert fitting.choice(sets, np.zeros(1))[0] > 1


RECORDS = "canonical_id string, ubid string, source_system string, ingested_at timestamp_ntz, phone string, employee_count int, pin_code string, value string, field_name string"


def record(i, u, source="fbis", day=1, phone="9845012345", n=5, pin="560058"):
    return (f"C{i}", u, source, None if day is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=day), phone, n, pin, "v", "f")


def test_survivors_by_hand(spark):
    rows = [
        record(1, "A", day=1, phone="09845012345", pin="560 058"),
        record(2, "A", day=400, phone="+91 98450 12345", n=None),
        record(3, "A", day=800, phone="9999999999", n=0, pin="560085"),  # stand-in; digits swapped
        record(3, "A", day=800, phone="9999999999", n=0, pin="560085"),
        record(4, "B"), record(4, "B"),  # one record delivered twice
        record(5, "C", day=None, phone=None, n=None, pin=None), record(6, "C", day=None, phone="NA", n=9999, pin="999999"),
        record(7, "D", day=None), record(8, "D", day=None, phone="9845012399"), record(9, "D", day=None, phone="9845012399"),
        record(10, None),
    ]
    places = spark.createDataFrame([("560058",)], "pin_code string")
    got = {(r.ubid, r.field_name): r.field_value for r in survivor.survivors(spark.createDataFrame(rows, RECORDS), places).collect()}
    assert got["A", "phone"] == "9845012345" and got["A", "employee_count"] == "5" and got["A", "pin_code"] == "560058"
    assert {u for u, _ in got} == {"A", "D"} and got["D", "phone"] == "9845012399"
    assert survivor.survivors(spark.createDataFrame([], RECORDS)).count() == 0


def test_survivors_learn_from_labels(spark):
    rnd = random.Random(5)
    rows, labels, truth = [], [], {}
    for g in range(120):
        now, old = f"98{rnd.randint(10**7, 10**8 - 1)}", f"87{rnd.randint(10**7, 10**8 - 1)}"
        truth[f"G{g}"] = now
        # register x is always right, y repeats the old number later
        rows += [record(g * 3, f"G{g}", "x", rnd.randint(1, 50), now), record(g * 3 + 1, f"G{g}", "y", rnd.randint(51, 90), old), record(g * 3 + 2, f"G{g}", "x", rnd.randint(1, 50), now)]
        if g < 40:
            labels.append((f"G{g}", "phone", now))
    df = spark.createDataFrame(rows, RECORDS)
    got = {r.ubid: r.field_value for r in survivor.survivors(df, None, spark.createDataFrame(labels, "ubid string, field_name string, field_value string")).where("field_name = 'phone'").collect()}
    assert sum(got[u] == v for u, v in truth.items()) >= 0.95 * len(truth)


def test_pages_without_labels_are_judged_by_their_distance(spark):
    import random as r

    rnd = r.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i % 7}" for i in range(900)]
    subjects, verbs = ["the court of the", "a tenant in the", "the carrier and the"], ["finds that", "denies that", "records that"]
    rows = []
    for i in range(200):
        if i % 20 == 0:  # a few odd words in turns, frequent ones absent
            few = rnd.sample(vocabulary, 6)
            rows.append((i, " ".join(rnd.choice(few) for _ in range(40)) + " " + " ".join(rnd.sample(vocabulary, 30))))
        else:
            rows.append((i, " ".join(f"{rnd.choice(subjects)} {rnd.choice(vocabulary)} {rnd.choice(verbs)} it was so." for _ in range(rnd.randint(8, 30)))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {x.doc_id for x in pagespam.spam_pages(docs).collect()}
    assert found <= {i for i in range(200) if i % 20 == 0} and len(found) >= 6
    assert found == {x.doc_id for x in pagespam.spam_pages(docs, max_broadcast=0).collect()}
    assert pagespam.spam_pages(docs.limit(0)).count() == 0
