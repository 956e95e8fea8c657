import math
from collections import defaultdict

import numpy as np
import pytest
from oracles import assert_equal
from pyspark.sql import functions as F

from skirmish.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, b int"


def brute(rows, scale=256, every=50, n_pos=5, n_neg=3, low=50, high=95):
    """All pairs with Python's integers; (id, label, vector)."""
    known = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            new = (label, [math.floor(scale * float(np.float32(x))) for x in v])
            known[i] = min(known.get(i, new), new)
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        same, other = [], []
        for i, (own, w) in known.items():
            if i != a:
                (same if own == label else other).append((-sum(x * y for x, y in zip(v, w)), i))
        for s, p in sorted(same)[:n_pos]:
            fit = sorted((t, i) for t, i in other if low * -s <= 100 * -t <= high * -s)[:n_neg]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x", "y", 3) for i, v, label in rows], SCHEMA)
    got = negatives.mined(negatives.scaled(df, F.col("label")), F.col("id") % 50 == 0, **more)
    return sorted(map(tuple, got.collect()))


def test_equals_sql(spark, sf):
    assert assert_equal(spark, queries.op11_hard_negatives, queries.OP11_SQL, sf, ["embeddings"])


@pytest.mark.parametrize("width", [3, 64, 100])
def test_equals_brute_force_with_ties_nulls_and_repeats(spark, monkeypatch, width):
    monkeypatch.setattr(negatives, "BLOCK", 160)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = np.random.default_rng(width)
    base = rng.normal(size=(30, width))
    near = lambda i: (base[i % 30] + 0.4 * rng.normal(size=width)).tolist()
    rows = [(i, near(i), i % 3 if i % 5 else 0) for i in range(900)]
    rows += [(1000 + i, rows[50][1], i % 2) for i in range(60)] + rows[:40]  # ties and repeats
    rows += [(7, near(1), 2), (2000, None, 1), (2050, near(3), None), (None, near(4), 1), (2100, [1.0, None], 1), (2150, [float("nan")] * 3, 1), (2200, [float("inf")], 1), (2250, [], 1), (2300, [0.5], 1)]
    want = brute(rows)
    assert len(want) > 50
    assert found(spark, rows) == want


def test_other_counts_and_an_empty_table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), i % 2) for i in range(150)]
    assert found(spark, rows, n_positives=2, n_negatives=500, low=-100, high=90) == brute(rows, n_pos=2, n_neg=500, low=-100, high=90)
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0], 1)]) == [] == found(spark, [(50, [0.0], 1), (51, [0.0], 2)])


def test_bounds_hold_and_leave_few(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(2000, 64)) * 32
    vectors = np.floor(base).astype(np.int64)
    frame = negatives.Frame(vectors.mean(0), 64)
    codes, fit = frame.coded(vectors.astype(float))
    block = negatives.Block.__new__(negatives.Block)
    block.ids, block.labels, block.vectors = np.arange(2000), np.zeros(2000), vectors
    block.codes, block.fit = codes.reshape(2000, negatives.LEVELS, -1), fit
    for q in range(20):
        anchor, seen = negatives.Anchor(vectors[q], frame), []
        scores = vectors @ vectors[q]

        def wanted(low, high, scores=scores, seen=seen):
            assert len(low) < 2000 or ((low <= scores) & (scores <= high)).all()
            seen.append(len(low))
            return high >= np.partition(low, -5)[-5]

        at, low, high = block.refined(anchor, np.arange(2000), wanted)
        assert ((low <= scores[at]) & (scores[at] <= high)).all() and seen[0] == 2000
        assert (high >= np.sort(scores)[-5]).sum() < 500  # what is integer-scored once the best estimates are
