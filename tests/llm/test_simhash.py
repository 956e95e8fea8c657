import numpy as np
import xxhash

from skirmish.llm import simhash

DOCS = "doc_id long, text string, fp string, component_id int"


def brute(rows):
    """Components over all pairs, by repeated sweeps."""
    fps = []
    for _, text in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    root = [r[0] for r in rows]
    for _ in rows:
        for i, a in enumerate(fps):
            near = [root[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 4 and root[j] is not None]
            root[i] = min(near, default=None)
    return sorted((r[0] is None, r[0] or 0, f"{f:016x}", c) for r, f, c in zip(rows, fps, root, strict=True))


def test_matches_brute_force_with_nulls_repeats_and_clashing_columns(spark):
    base = " ".join(f"Word{i}" for i in range(400))
    rows = [(5, base), (9, base + " extra"), (3, base), (3, base), (7, None), (8, ""), (11, " \t"), (None, base), (20, "One two"), (21, "one\ttwo"), (30, "x" * 200_000)]
    rows += [(100 + i, base.replace(f"Word{i}", "Other")) for i in range(30)]
    rows += [(200 + i, " ".join(f"t{i}{j}" for j in range(20))) for i in range(30)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], DOCS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_links_of_a_dense_group_and_of_split_buckets(monkeypatch):
    rng = np.random.default_rng(3)
    fp = np.full(3000, 0x123456789ABCDEF0, np.uint64)
    for _ in range(7):
        fp ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    fp = np.unique(fp)
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert np.array_equal(simhash.bucket_links(np.zeros(len(fp), int), fp, 4), simhash._roots(len(fp), a, b))


def test_tiles_keep_all_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**60, 20, dtype=np.uint64)[rng.integers(0, 20, 600)]
    for _ in range(4):
        fp ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    fp = np.unique(fp)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")).collect()
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    got = simhash._roots(len(fp), np.array([at[e.src] for e in edges]), np.array([at[e.dst] for e in edges]))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert np.array_equal(got, simhash._roots(len(fp), a, b))
