from __future__ import annotations

import os
import random
from collections import Counter as Bag
from collections import defaultdict

import numpy as np
import pytest

from kinfold.llm import mixing, packing
from kinfold.llm.tokens import VOCABULARY, Counter, _encoding
from kinfold.session import vocabulary_dir

PATH = f"{vocabulary_dir()}/{VOCABULARY}"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@needs_vocabulary
def test_cached_counts_equal_the_tokenizer():
    count, encode = Counter(PATH).count, _encoding(PATH).encode_ordinary
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab \n\t.,é█ 1 ' ") for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    for t in [*texts, "", "one two  three \n four", "x" * 5000, " lead", "trail "]:
        assert count(t) == len(encode(t)), repr(t)
    assert count(None) == 0


def brute_bins(sizes, capacity):
    """First-fit decreasing, an upper bound that best fit should not miss by much."""
    bins = []
    for s in sorted(sizes, reverse=True):
        for i, b in enumerate(bins):
            if b + s <= capacity:
                bins[i] += s
                break
        else:
            bins.append(s)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_a_packing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([20, 100, 512])
    sizes = [rnd.randint(1, capacity) for _ in range(rnd.choice([1, 50, 400]))]
    patterns = packing.solve(dict(Bag(sizes)), capacity)
    placed = Bag()
    for pattern, n in patterns:
        assert sum(s * q for s, q in pattern) <= capacity
        for s, q in pattern:
            placed[s] += q * n
    assert placed == Bag(sizes)
    assert -(-sum(sizes) // capacity) <= sum(n for _, n in patterns) <= brute_bins(sizes, capacity) + 1


def exact_bins(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_reduction_never_costs_a_container(seed):
    rnd = random.Random(seed)
    sizes = sorted((rnd.randint(1, 12) for _ in range(8)), reverse=True)
    counts = dict(Bag(sizes))
    fixed = packing.reduce_instance(counts, 12)
    rest = [s for s, n in counts.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (exact_bins(sorted(rest, reverse=True), 12) if rest else 0) == exact_bins(sizes, 12)


DOCS = "doc_id bigint, text string, source string, container_kind string, n_tokens bigint"


def documents(spark, n=120):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "of", "court"]) for _ in range(rnd.randint(1, 90))), ["a", "b", "c"][i % 7 % 3], "k", 5) for i in range(n)]
    return spark.createDataFrame([*rows, rows[3], (n, None, None, None, None), (n + 1, "", "a", None, None), (n + 2, "word " * 700, "b", None, None), (None, "x", "a", None, None)], DOCS)


@needs_vocabulary
def test_every_piece_gets_one_place(spark):
    docs = documents(spark)
    kinds = spark.createDataFrame([("small", 64), ("large", 256), ("bad", 0), (None, 9)], "container_kind string, capacity_tokens int")
    rows = packing.pack(docs, kinds, bucket_rows=20).collect()
    tokens = {r.doc_id: Counter(PATH).count(r.text) for r in docs.collect() if r.doc_id is not None}
    for kind, capacity in (("small", 64), ("large", 256)):
        mine = [r for r in rows if r.container_kind == kind]
        load, of = defaultdict(int), defaultdict(list)
        for r in mine:
            load[r.container_id] += r.n_tokens
            of[r.doc_id].append(r)
        assert max(load.values()) <= capacity and set(of) == set(tokens)
        for doc, pieces in of.items():
            assert sum(p.n_tokens for p in pieces) == tokens[doc]
            assert len(pieces) == max(1, -(-tokens[doc] // capacity)) == len({p.piece_no for p in pieces})
        assert set(load) == set(range(len(load)))
    report = {r.container_kind: r for r in packing.fill_report(packing.pack(docs, kinds), kinds).collect()}
    assert report["small"].n_containers <= report["small"].fewest_possible + 2
    assert packing.pack(docs.limit(0), kinds).count() == 0 and packing.pack(docs, kinds.limit(0)).count() == 0


@needs_vocabulary
def test_broadcast_shifts_do_not_grow_with_sizes(spark, monkeypatch):
    """What the driver broadcasts stays under two rows for every `bucket_rows` pieces, however many sizes there are."""
    written, write = {}, packing.Scratch.write

    def counted(self, frame, name="part"):
        kept = write(self, frame, name)
        written[name] = kept.count()
        return kept

    monkeypatch.setattr(packing.Scratch, "write", counted)
    docs = spark.createDataFrame([(i, "law " * (1 + i % 50 if i % 2 else 7)) for i in range(1000)], "doc_id bigint, text string")
    kinds = spark.createDataFrame([("small", 16), ("large", 64)], "container_kind string, capacity_tokens int")
    rows = packing.pack(docs, kinds, bucket_rows=100).collect()
    assert sum(n for name, n in written.items() if name != "tokens") <= 2 * len(rows) / 100
    filled = Bag()
    for r in rows:
        filled[r.container_kind, r.container_id] += r.n_tokens
    assert all(n <= (16 if k == "small" else 64) for (k, _), n in filled.items())
    assert len({(r.container_kind, r.doc_id, r.piece_no) for r in rows}) == len(rows)
    assert len({r.doc_id for r in rows}) == 1000


def test_quotas_are_exact():
    q = mixing.split_quotas([100, 7, 0, 55], 9, 3)
    assert q.sum(0).tolist() == [100, 7, 0, 55] and abs(q.sum(1) - 18).max() <= 2
    assert (q == mixing.split_quotas([100, 7, 0, 55], 9, 3)).all()


@needs_vocabulary
def test_mixture_shares_and_caps(spark):
    docs = documents(spark, 600)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 1), ("c", 0.3, 3), ("none", 0.1, 4), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets, shard_tokens=3000, block_docs=10)
    rows = mixed.collect()
    assert rows == mixing.mix(docs, targets, shard_tokens=3000, block_docs=10).collect() or sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs, targets, shard_tokens=3000, block_docs=10).collect()))
    seen = Bag((r.doc_id, r.copy_no) for r in rows)
    assert max(seen.values()) == 1
    most = {s: max(r.copy_no for r in rows if r.source == s) for s in "abc"}
    assert most["a"] == 1 and most["b"] == 1 and most["c"] <= 3
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    want = {"a": 0.5, "b": 0.2, "c": 0.3}
    assert all(abs(got[s].actual_share - want[s]) < 0.01 for s in want) and got["none"].tokens == 0
    load = defaultdict(int)
    for r in rows:
        load[r.shard_id] += r.n_tokens
    assert np.std(list(load.values())) < 0.35 * np.mean(list(load.values()))
    for s in load:
        assert sorted(r.position for r in rows if r.shard_id == s) == list(range(1, 1 + sum(r.shard_id == s for r in rows)))
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
