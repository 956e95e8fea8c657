import random
import re
from collections import Counter

import numpy as np
import pytest
from oracles import assert_equal

from skirmish.llm import collocations, queries

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, most=2000, least=30, share=80):
    """Counts all phrases at once, with Python's integers."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    good = {k: a for k, a in f.items() if a >= least and len(k) > 2}
    gone = set()
    for k, a in good.items():
        words = k[1:]
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = (k[0], *words[i : i + m])
                if 100 * a >= share * f[part]:
                    gone.add(part)
    out = {}
    for k, a in good.items():
        if k not in gone:
            words = k[1:]
            cuts = [(2000000 * a // (f[k[0], *words[:c]] + f[k[0], *words[c:]]), c) for c in range(1, len(words))]
            score, c = min(cuts)
            out.setdefault(k[0], []).append((-score, -a, " ".join(words).encode(), f[k[0], *words[:c]], f[k[0], *words[c:]]))
    found = []
    for lang, all_of in out.items():
        found += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(all_of)[:most])]  # noqa: E741
    return sorted(found)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, lang, "x", 1, "y") for i, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, collocations.mined(docs, **more).collect()))


def prose(seed, docs=300, words=120, vocabulary=60, langs=("aa", "bb", None)):
    rng = random.Random(seed)
    names = [f"{c}{i}" for i in range(vocabulary // 2) for c in ("w", "É")]
    fixed = [" ".join(rng.sample(names, k)) for k in (2, 3, 4, 5, 3, 4) for _ in range(4)]
    rows = []
    for _ in range(docs):
        parts = []
        for _ in range(words):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else names[min(len(names) - 1, int(rng.expovariate(0.1)))])
            parts.append(rng.choice([" "] * 12 + [", ", "\n", " \t", ".", "!x? "]))
        rows.append(("".join(parts), rng.choice(langs)))
    return rows


def test_equals_sql(spark, sf):
    assert len(assert_equal(spark, queries.op13_collocations, queries.OP13_SQL, sf, ["documents"])) > 10


@pytest.mark.parametrize(("most", "share"), [(2000, 80), (25, 80), (3, 40), (60, 100)])
def test_equals_brute_force_in_several_floors(spark, monkeypatch, most, share):
    monkeypatch.setattr(collocations, "AHEAD", 1)
    monkeypatch.setattr(collocations, "FURTHER", 2)
    monkeypatch.setattr(collocations, "CHUNK", 900)
    rows = prose(most)
    want = brute(rows, most, 30, share)
    assert found(spark, rows, most=most, share=share) == want
    assert {r[0] for r in want} == {"aa", "bb", "und"}


def test_an_end_that_no_prefix_gives(spark, monkeypatch):
    """b c d is rare beside b and c, so only a b c d asks for its count."""
    monkeypatch.setattr(collocations, "AHEAD", 1)
    rows = [("a b c d. ", "l")] * 40 + [("b. b. b. b c. c d. c. d x. ", "l")] * 200 + [(f"p{i} q{i}. ", "l") for i in range(3) for _ in range(100)]
    for most in (1, 2, 4, 8):
        assert found(spark, rows, most=most) == brute(rows, most)


def test_nulls_ties_long_texts_and_overlaps(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 64)
    rows = [(None, "l"), ("", None), ("z " * 5000, "l"), ("one two " * 40, None), ("A aÉ " * 35 + "x" * 500, "")] + [("t1 t2, t3 t4", "l")] * 31
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, most=2) == brute(rows, 2)


def test_empty_and_rare(spark):
    assert found(spark, []) == [] == found(spark, [("a b c", "l")] * 29)


def test_words_that_share_a_number_are_numbered_anew(spark, monkeypatch):
    plain = collocations.Cutter.words

    def clashing(self, data, lang, check=False):
        for chunk, starts, ends, numbers, glued, other in plain(self, data, lang, check):
            yield chunk, starts, ends, numbers if self.seed else np.minimum(numbers, np.uint64(1 << 63)), glued, other

    monkeypatch.setattr(collocations.Cutter, "words", clashing)
    rows = [("a b c. d e f g", "l")] * 40
    assert found(spark, rows) == brute(rows)


def test_phrases_that_a_task_adds_up_stay_small():
    assert collocations.BUFFER * 4 * 8 <= 8 << 20  # bytes of phrases of four words, before copies
