import random

from skirmish.llm import decontam

DOCS, BENCH = "doc_id long, text string, items string, hash int", "item_id long, text string, length int"


def brute(docs, bench):
    words = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() or ord(c) > 127 and False else c if ord(c) > 127 else " " for c in t or "").split(" ")
    split = lambda t: [w for w in words(t) if w]
    out = []
    for i, t in dict.fromkeys(docs):
        w, hit, items = split(t), set(), set()
        for item, text in bench:
            b = split(text)
            n = min(10, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    items.add(str(item))
        out.append((i, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(7)
    vocab = ["Alpha", "beta", "été", "x1", "the", "of"]
    run = lambda n: " ".join(rng.choices(vocab, k=n))
    bench = [(i, run(rng.randrange(10, 40))) for i in range(12)] + [(20, "of the x1"), (21, None), (22, "..."), (23, "Zeta"), (24, bench_text := run(9)), (24, "été, beta! x1")]
    docs = [(i, f"{run(rng.randrange(0, 60))} {rng.choice(bench)[1] or ''}; {run(rng.randrange(0, 60))}") for i in range(60)]
    docs += [(100, None), (101, ""), (102, "zeta-ZETA"), (103, bench_text.upper()), (104, "word " * 30_000 + bench[0][1]), docs[0], (0, "another text"), (None, bench[1][1])]
    got = decontam.contaminated(spark.createDataFrame([(*d, "c", 1) for d in docs], DOCS), spark.createDataFrame([(*b, 1) for b in bench], BENCH)).collect()
    # the fixture's only letters outside ASCII are lower case, which stay as they are
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=str) == brute(docs, bench)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b", "c", 1)], DOCS), spark.createDataFrame([(1, "a b", 1)], BENCH)
    assert [tuple(r)[2:] for r in decontam.contaminated(docs, bench.limit(0)).collect()] == [(2, [], [], 0)]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_winnowing_keeps_a_shared_print_of_every_shared_window():
    rng = random.Random(3)
    cache = decontam._Hashes()
    for _ in range(300):
        shared = rng.choices(b"abcdefgh", k=10)
        texts = [bytes(x for c in [*rng.choices(b"abcdefgh", k=rng.randrange(9)), *shared, *rng.choices(b"abcdefgh", k=rng.randrange(9))] for x in (c, 32)) for _ in range(2)]
        prints = []
        for t in texts:
            _, h, starts = decontam._flat([t], cache)
            prints.append(set(decontam._places(h, starts)[1].tolist()))
        assert prints[0] & prints[1]
