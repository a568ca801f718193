from __future__ import annotations

import random

import pytest

from kinfold.llm.consolidate import components, consolidate

SCHEMA = "canonical_id_a string, canonical_id_b string, calibrated_probability double, scored_at timestamp_ntz, node string"


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_levels_agree_with_brute_force(spark, shape):
    rnd = random.Random(3)
    ids = [f"N{i:05d}" for i in range(600)]
    if shape == "random":
        edges = {tuple(sorted(rnd.sample(ids, 2))) for _ in range(420)}
    elif shape == "chain":
        order = rnd.sample(ids, 400)
        edges = {tuple(sorted(p)) for p in zip(order, order[1:])}
    else:
        edges = {tuple(sorted((ids[300], x))) for x in ids if x != ids[300]}
    df = spark.createDataFrame(sorted(edges), "u string, v string")
    for bound in (40, 10_000):
        got = {r.node: r.component for r in components(df, max_edges=bound).collect()}
        assert got == brute(edges)


def test_latest_score_either_order_and_odd_rows(spark):
    rows = [
        ("A", "B", 0.99, "2024-01-01 00:00:00", "x"),
        ("B", "A", 0.10, "2024-01-02 00:00:00", "x"),  # the later score unlinks
        ("C", "D", 0.10, "2024-01-01 00:00:00", None),
        ("D", "C", 0.97, "2024-01-03 00:00:00", None),
        ("D", "C", 0.97, "2024-01-03 00:00:00", None),
        ("E", "E", 1.0, "2024-01-01 00:00:00", None),
        ("F", "G", None, "2024-01-05 00:00:00", None),
        ("F", "G", 0.99, "2024-01-01 00:00:00", None),
        ("H", None, 0.99, "2024-01-01 00:00:00", None),
        ("I", "J", 0.99, None, None),
        ("D", "K", 0.95, "2024-01-01 00:00:00", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA.replace("scored_at timestamp_ntz", "scored_at string"))
    df = df.withColumn("scored_at", df.scored_at.cast("timestamp_ntz"))
    got = sorted(map(tuple, consolidate(df).collect()))
    assert got == [("C", "C"), ("D", "C"), ("I", "I"), ("J", "I"), ("K", "C")]


def test_empty(spark):
    assert consolidate(spark.createDataFrame([], SCHEMA)).count() == 0
