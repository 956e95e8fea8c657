import numpy as np

from skirmish.llm import topk

SCHEMA = "vec_id long, embedding array<float>, distance string"


def codes_of(rows):
    return {i: sum(1 << b for b, x in enumerate(v) if x > 0) for i, v, _ in rows if i is not None and v is not None and len(v) == 64}


def test_equals_brute_force_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 64))
    rows = [(i, (base[i % 20] + rng.normal(size=64) * (i % 3)).tolist(), "x") for i in range(400)]
    rows += [(1000 + i, rows[0][1], "x") for i in range(30)] + [(2000, None, "x"), (2020, [1.0] * 3, "x"), (None, rows[0][1], "x")]
    codes = topk.sign_codes(spark.createDataFrame(rows, SCHEMA))
    known = codes_of(rows)
    assert {r.id: r.code & (1 << 64) - 1 for r in codes.collect()} == known
    got = sorted(map(tuple, topk.nearest(codes.where("id % 20 = 0"), codes, 7).collect()))
    want = []
    for q in known:
        if q % 20 == 0:
            near = sorted(((known[q] ^ c).bit_count(), i) for i, c in known.items())[:7]
            want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert got == sorted(want)


def test_small_and_empty_index(spark):
    codes = spark.createDataFrame([(1, 5), (2, -1)], "id long, code long")
    assert topk.nearest(codes, codes, 10).count() == 4
    assert topk.nearest(codes, codes.limit(0), 10).count() == 0
    assert topk.nearest(codes.limit(0), codes, 10).count() == 0


def test_repeated_ids_nulls_and_further_columns(spark):
    rows = [(20, 5, 1), (20, 5, 2), (21, 7, 3), (22, None, 4), (None, 5, 5), (23, 6, 6), (23, 4, 7)]
    codes = spark.createDataFrame(rows, "id long, code long, rank int")
    got = sorted(map(tuple, topk.nearest(codes.where("id = 20"), codes, 3).collect()))
    assert got == [(20, 1, 20, 0), (20, 2, 21, 1), (20, 3, 23, 1)]
    assert topk.nearest(codes, codes.where("id > 99"), 3).count() == 0


def test_queries_go_through_the_radii_together():
    rng = np.random.default_rng(3)
    codes, ids = rng.integers(-(2**63), 2**63 - 1, 3000), rng.permutation(3000).astype(np.int64)
    codes[:40] = codes[0]
    asked = np.concatenate((codes[:60], rng.integers(-(2**63), 2**63 - 1, 100)))
    q, near, dist = topk.Index(ids, codes).search(asked, 10)
    assert (q == np.repeat(np.arange(160), 10)).all()
    for j, code in enumerate(asked):
        off = np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64))
        best = np.lexsort((ids, off))[:10]
        assert (near[q == j] == ids[best]).all() and (dist[q == j] == off[best]).all()
