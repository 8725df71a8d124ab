"""Hard negatives: dual-tree search against brute force, bounds, pruning, odd tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from actaflow.llm import negatives as hn

RELABEL = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"


def brute(rows, positives=5, negatives=10, low=30, high=90, every=100):
    """The contract, row by row."""
    kept = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        row = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * v) for v in x])
        kept[vec_id] = min(kept[vec_id], row) if vec_id in kept else row
    out = []
    for a, (label, x) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in kept.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            band = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(band, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, wants string")
    return sorted(tuple(r) for r in hn.hard_negatives(table, relabel=RELABEL, **more).collect())


def test_random_and_clustered_vectors_with_ties(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 64), monkeypatch.setattr(hn, "ANCHOR_BLOCK", 8), monkeypatch.setattr(hn, "LEAF", 16), monkeypatch.setattr(hn, "ANCHOR_LEAF", 4)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        x = centers[i % 6] + rng.normal(size=8) * 0.2 if i < 500 else rng.normal(size=8) * 0.3
        x = np.float32(np.round(x, 1) if i % 3 or not rows else rows[-1][1])  # ties and equal vectors
        rows.append((i, [float(v) for v in x], 1 if i % 3 else int(rng.integers(0, 10)), "x"))
    expected = brute([r[:3] for r in rows], every=20)
    assert mined(spark, rows, is_anchor="vec_id % 20 = 0") == expected and len(expected) > 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1, "x"), (100, [0.5, 0.5], 1, "x"), (200, None, 1, "x"), (300, [nan, 1.0], 1, "x"), (400, [1.0, None], 1, "x"), (500, [inf, 0.0], 1, "x"), (600, [1.0, 1.0], None, "x"), (None, [1.0, 1.0], 1, "x")]
    rows += [(1, [1.0], 1, "x"), (2, [0.9, 0.5, 7.0], 2, "x"), (3, [], 2, "x"), (4, [0.4, 0.4], 2, "x"), (4, [0.4, 0.4], 2, "x"), (5, [0.7, 0.1], 3, "x"), (5, [0.3, 0.1], 3, "x"), (6, [-1.0, -1.0], 3, "x"), (8, [0.0, 0.0], 1, "x")]
    assert mined(spark, rows) == brute([r[:3] for r in rows]) != []
    assert mined(spark, rows[:2]) == [] and mined(spark, rows[2:8]) == []
    table = spark.createDataFrame(rows[:0], "vec_id long, embedding array<float>, label int, wants string")
    assert hn.hard_negatives(table).collect() == []
    huge = [(0, [1e30, 1.0], 1, "x"), (1, [1e30, 2.0], 1, "x"), (2, [1.0, 1.0], 2, "x")]
    assert mined(spark, huge) == []  # the products are at the end of the range; no negative is near


def test_a_hot_label_and_group_of_copies_is_many_blocks(spark):
    rows = spark.range(20_000).selectExpr("id vec_id", "array(cast(1.0 as float), cast(id % 7 as float)) embedding", "if(id % 11 = 0, cast(id % 5 + 2 as int), 1) label")
    prepared = hn.usable_rows(rows, 256).withColumn("wants", hn.F.lit(None).cast("array<struct<key:long,low:long,high:long>>"))
    blocks = hn.cut_blocks(hn.ordered(prepared, hn.fit_planes(np.random.default_rng(0).normal(size=(100, 2)))), hn.BLOCK, hn.LEAF).select("n", "label_low", "label_high").collect()
    assert sum(b.n for b in blocks) == 20_000 and max(b.n for b in blocks) <= hn.BLOCK and len(blocks) >= 10


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_intervals_hold_every_product(spread):
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, c = (np.round(256 * (rng.normal(size=5) + spread * rng.normal(size=(rng.integers(1, 9), 5)))) for _ in range(2))
        low, high = hn.intervals(hn.bounds(a, [0], [len(a)]), hn.bounds(c, [0], [len(c)]))
        products = a @ c.T
        assert low[0] <= products.min() and products.max() <= high[0]


def test_whole_groups_of_anchors_are_pruned():
    """On clustered vectors many pairs of leaves are never scored, and the finds stay exact."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 16)) * 300

    def block(n):
        x = np.round(np.repeat(centers, n // 8, 0) + rng.normal(size=(n, 16)) * 5).astype(np.int64)
        return x[hn.halves(x, 32)]

    a, c = block(256), block(2048)
    labels_a, labels_c = np.zeros(256, np.int32), np.ones(2048, np.int32)
    wants = np.array([(i, i, -(1 << 62), 1 << 62, -(1 << 62)) for i in range(256)], hn._WANT)
    count = {}
    found = hn.search_blocks(a, np.arange(256), labels_a, wants, c, np.arange(2048), labels_c, False, 10, count)
    products = a @ c.T
    for i in range(256):
        own = found.row == i
        order = np.lexsort((np.arange(2048), -products[i]))[:10]
        assert found.id[own].tolist() == order.tolist() and found.score[own].tolist() == products[i][order].tolist()
    assert count["scored"] < 0.6 * (256 // hn.ANCHOR_LEAF) * (2048 // hn.LEAF) and count["pruned"] > 0


def test_products_beyond_doubles_are_exact():
    a, c = np.array([[1 << 52, 3]]), np.array([[1 << 10, 1], [1 << 52, 1]])
    assert hn._products(a, c).tolist() == [[(1 << 62) + 3, (1 << 63) - 1]]
    assert hn._products(np.array([[(1 << 30) + 1]]), np.array([[(1 << 30) + 1]])).tolist() == [[((1 << 30) + 1) ** 2]]
