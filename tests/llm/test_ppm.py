import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skirmish.llm import ppm

SCHEMA = "doc_id long, text string, score string, key int"


def counted(texts):
    """Counts of bytes after each context of 0 to ORDER bytes, starts padded."""
    after = {}
    for t in texts:
        full = bytes([255] * ppm.ORDER) + t + b"\xff"
        for i in range(ppm.ORDER, len(full)):
            for o in range(ppm.ORDER + 1):
                after.setdefault(full[i - o : i], Counter())[full[i]] += 1
    return after


def brute_log10(after, context, symbol):
    gone, p = set(), 1.0
    for o in range(ppm.ORDER, -1, -1):
        own = after.get(context[len(context) - o :], {})
        left = {s: c for s, c in own.items() if s not in gone}
        if left:
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return math.log10(p * left[symbol] / whole)
            p *= len(left) / whole
        gone |= set(own)
    return math.log10(p / (256 - len(gone)))


def model(texts, least=1):
    keys = np.concatenate([ppm.grams([t])[0] for t in texts])
    nodes = []
    for o in range(ppm.ORDER + 1):
        k, c = np.unique(keys & np.uint64((1 << 8 * (o + 1)) - 1), return_counts=True)
        nodes.append((k[c >= least], c[c >= least]))
    return ppm.Trie(nodes, len(keys))


@pytest.mark.parametrize("least", [1, 4])
def test_trie_is_a_distribution_and_equals_brute_force(least):
    rng = random.Random(0)
    texts = ["".join(rng.choices("abcd é", k=rng.randrange(200))).encode() for _ in range(20)]
    trie, after = model(texts, least), counted(texts)
    for _ in range(60):
        context = bytes(rng.choices(b"abcd \xc3\xa9\xff", k=ppm.ORDER))
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        got = trie.log10(keys)
        assert abs((10**got).sum() - 1) < 1e-9
        if least == 1:
            assert np.allclose(got, [brute_log10(after, context, s) for s in range(256)])


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["The", "cat", "été", "sat", "on", "x" * 30]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "cat of no id"), (5, "cat cat"), (5, "cat cat"), (102, "ab " * 40_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    train = [(i, t) for i, t in rows if not out(i)]
    count = Counter(w for _, t in train for w in split(t))
    n, v = sum(count.values()), len(count)
    after = counted([(t or "").encode() for _, t in train])
    want = []
    for i, t in rows:
        w = split(t)
        full = bytes([255] * ppm.ORDER) + (t or "").encode() + b"\xff"
        code = sum(brute_log10(after, full[k - ppm.ORDER : k], full[k]) for k in range(ppm.ORDER, len(full))) if len(full) < 5000 else None
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((-1 if i is None else i, out(i), len(w), sum(count[x] > 0 for x in w), n, base, code))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in ppm.scores(df).collect())
    for a, b in zip(got, sorted(want, key=lambda x: x[:6]), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
        assert b[6] is None or math.isclose(a[6], b[6], rel_tol=1e-5)


def test_rare_words_over_several_buckets(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i} w{i % 7} the", "x", 1) for i in range(200)], SCHEMA)
    one = {r.doc_id: r for r in ppm.scores(df).collect()}
    monkeypatch.setattr(ppm, "BUCKET", 50)
    monkeypatch.setattr(ppm, "COMMON", 0.2)
    for r in ppm.scores(df).collect():
        assert (r.n_known, r.n_tokens) == (one[r.doc_id].n_known, one[r.doc_id].n_tokens)
        assert math.isclose(r.base_score, one[r.doc_id].base_score, rel_tol=1e-12)


def test_empty_tables(spark):
    df = spark.createDataFrame([(None, "only held out", "x", 1)], SCHEMA)
    assert [r.train_tokens for r in ppm.scores(df).collect()] == [0]
    assert ppm.scores(df.limit(0)).count() == 0


def test_grams_below_every_floor_count(spark, monkeypatch):
    monkeypatch.setattr(ppm, "RATE", 2.0**-5)
    monkeypatch.setattr(ppm, "BUCKET", 300)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("aaaab cdé", k=rng.randrange(60)))) for i in range(120)]
    after = counted([t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 10])
    got = {r.doc_id: r.score for r in ppm.scores(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    for i, t in rows:
        full = bytes([255] * ppm.ORDER) + t.encode() + b"\xff"
        assert math.isclose(got[i], sum(brute_log10(after, full[k - ppm.ORDER : k], full[k]) for k in range(ppm.ORDER, len(full))), rel_tol=1e-5)
