import random
from collections import Counter

import numpy as np
import pytest

from skirmish.llm import induced, suffixes

SCHEMA = "doc_id long, text string, spans string, k1 int"


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for k in range(600):
        size = rng.choice([1, 2, 3, 5, 20])
        values = [rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 60))]
        if k % 4 == 0:
            values = values[: rng.randrange(1, 9)] * rng.randrange(1, 9)
        t = [*values, 0]
        assert induced.suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 199):
            if count[t[s : s + 200]] > 1:
                gone[s : s + 200] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((-1 if i is None else i, len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out)


def fixture():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (45, 60, 120, 300)]
    rows = [(i, f"{text(rng.randrange(60))} {rng.choice(shared)} {text(rng.randrange(60))}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "short"), (103, shared[1] + shared[1]), (None, shared[2]), (104, text(20_000)), (105, "ab" * 700), (106, "x" * 199), (107, "x" * 200)]
    return [*rows, rows[0], rows[5], (7, shared[3])]


@pytest.mark.parametrize("frequent", [1 << 14, 8])
def test_equals_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    monkeypatch.setattr(suffixes, "SHARD", 20_000)
    monkeypatch.setattr(suffixes, "BITS", 1 << 16)
    rows = fixture()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffixes.deduplicated(df).collect()]
    assert sorted(got) == brute(rows)


def test_empty_table(spark):
    assert suffixes.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
