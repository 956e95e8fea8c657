import math
from collections import Counter

import numpy as np
import xxhash

from skirmish.llm import quality

SCHEMA = "doc_id long, text string, score string, keep int"


def test_label_model_finds_planted_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    right, counts = [0.95, 0.8, 0.7, 0.9], {}
    for y in truth:
        votes = tuple(int(y if rng.random() < r else not y) if rng.random() < 0.8 else -1 for r in right)
        counts[votes] = counts.get(votes, 0) + 1
    share, chances = quality.fit_label_model(counts)
    assert abs(share - 0.7) < 0.03
    for j, r in enumerate(right):
        assert abs(chances[j, 1, 2] - r) < 0.04 and abs(chances[j, 0, 1] - r) < 0.04


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.keep) for r in quality.score(docs, quality.train(docs)).collect() if r.doc_id in labels]
    assert np.mean([k for q, k in got if q == 1]) > 0.98
    assert np.mean([not k for q, k in got if q == 0]) > 0.9


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "The words of a text are here."), (3, "| " * 50_000), (3, "| " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = quality.score(df, quality.train(df)).collect()
    assert len(got) == 5 and all(r.score == 0 and not r.keep for r in got if r.doc_id in (1, 2))
    empty = quality.train(df.limit(0))
    assert quality.score(df.limit(0), empty).count() == 0


def plain_words(text):
    return [w.decode("utf-8", "replace") for w in text.encode().split()]


def place(kind, text):
    return xxhash.xxh64_intdigest(kind.encode() + text) % quality.DIMENSIONS


def plain_measures(text):
    """A text's measures, each by its definition, one word at a time."""
    raw, words = text.encode().split(), plain_words(text)
    n = len(words)
    core = [w.strip(".,;:!?\"'()«»¿¡") for w in words]
    ids = [place("w", w.lower()) for w in raw]
    share = lambda each: sum(map(bool, each)) / n
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    runs = [ids[i : i + quality.RUN] for i in range(0, n, quality.RUN)]
    return quality.Measures(
        words=n,
        alpha=share(c.isalpha() for c in core),
        function=share(w.lower().strip(b".,;:!?") in quality.FUNCTION_WORDS for w in raw),
        marks=share(not any(map(str.isalnum, w)) for w in words),
        odd=share(sum(not c.isalnum() and c not in ".,;:!?'\"-()" for c in w) >= 2 for w in words),
        repeated=sum(a == b for a, b in zip(ids, ids[1:], strict=False)) / n,
        distinct=sum(len(set(r)) / len(r) for r in runs) / len(runs),
        lines_again=1 - len(set(lines)) / len(lines),
        mean_length=len(text.encode()) / n,
        stops=min(1.0, sum(map(text.count, ".!?")) / n),
        capitals=share(len(c) >= 2 and c.isupper() for c in core),
        doubled=share(len(w) >= 2 and w[-1] == w[-2] and not w[-1].isalnum() for w in words),
    )


def plain_posteriors(votes, rounds=200):
    """Expectation-maximisation over the documents themselves, without patterns or arrays of counts."""
    post = []
    for v in votes:
        keeps, rejects = v.count(1), v.count(0)
        post.append(0.1 if rejects >= 2 else (keeps + 0.5) / (keeps + rejects + 1))
    for _ in range(rounds):
        share = min(max(sum(post) / len(post), 1e-3), 1 - 1e-3)
        chance = {}
        for j in range(len(votes[0])):
            for c in (0, 1):
                got = [0.5 + sum(p if c else 1 - p for v, p in zip(votes, post, strict=True) if v[j] == x) for x in (0, 1)]
                chance[j, c] = [x / sum(got) for x in got]
        new = []
        for v in votes:
            keep, reject = math.log(share), math.log(1 - share)
            for j, x in enumerate(v):
                if x >= 0:
                    keep, reject = keep + math.log(chance[j, 1][x]), reject + math.log(chance[j, 0][x])
            new.append(1 / (1 + math.exp(reject - keep)))
        ended = max(abs(a - b) for a, b in zip(post, new, strict=True)) < 1e-6
        if ended:
            break
        post = new
    return new


def plain_shape(word):
    core = word.strip(".,;:!?\"'()«»¿¡")
    if core.isalpha() and len(word) - len(core) <= 1:
        kind = "a" if core.islower() else "A" if core.isupper() else "Aa" if core.istitle() else "aA"
        return word.replace(core, kind, 1)
    signs = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word]
    return "".join(c for i, c in enumerate(signs) if i == 0 or signs[i - 1] != c)


def plain_score(text, m, weights):
    total = weights[-1]
    for kind, each in (("w", [w.lower() for w in text.encode().split()]), ("s", [plain_shape(w).encode() for w in plain_words(text)])):
        times = Counter(place(kind, x) for x in each)
        length = max(1.0, math.sqrt(sum(times.values())))
        total += sum(weights[p] * math.sqrt(n) / length for p, n in times.items())
    names = ("alpha", "function", "marks", "odd", "repeated", "distinct", "lines_again", "stops", "capitals", "doubled")
    binned = [f"{k}{min(9, int(getattr(m, k) * 10))}" for k in names] + [f"length{min(20, int(m.mean_length))}", f"words{m.words.bit_length()}"]
    total += sum(weights[place("m", x.encode())] for x in binned) / math.sqrt(len(binned))
    return 1 / (1 + math.exp(-total))


def test_equals_brute_force(spark, sf):
    """The whole query on whole texts: words, posteriors and scores of every document, from plain loops."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(texts) == docs.count() and set(got) == set(texts)
    measured = {i: plain_measures(t) if t.split() else quality.Measures(*[0] * 12) for i, t in texts.items()}
    votes = {i: [said(m) for said in quality.LABELLERS.values()] for i, m in measured.items()}
    posts = dict(zip(votes, plain_posteriors(list(votes.values())), strict=True))
    for i, text in texts.items():
        m, r = measured[i], got[i]
        assert r.n_words == m.words
        assert abs(r.posterior - (posts[i] if m.words else 0)) < 1e-4
        want = plain_score(text, m, model.weights) if m.words else 0
        assert abs(r.score - want) < 1e-4
        assert r.keep == (want >= 0.5) or abs(want - 0.5) < 1e-4


def test_filtered_keeps_rows_as_they_are(spark, sf):
    """Nulls, repeated rows, equal texts of several ids, and columns named as the operator's own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs)
    kept = [r.doc_id for r in quality.score(docs, model).where("keep").collect()]
    good = docs.where(docs.doc_id == kept[0]).first().text
    rows = [(1, good, "a", 7), (1, good, "a", 7), (2, good, None, 8), (None, good, "b", 9), (3, None, "c", 1), (4, "", "d", 2), (5, " \n\t ", "e", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    left = quality.filtered(df, model)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted(rows[:4], key=str)
    assert {r.score for r in quality.score(df.where("text <> ''"), model).collect() if r.n_words} == {r.score for r in quality.score(df.limit(1), model).collect()}
    assert quality.filtered(df.limit(0), model).count() == 0
