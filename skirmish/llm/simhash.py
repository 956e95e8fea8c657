"""SimHash near-duplicates: fingerprints, and links found with a Gray-ordered hierarchical index.

Each distinct fingerprint goes to one bucket per pigeonhole block (two fingerprints that differ in at
most ``radius`` bits agree on one of ``radius + 1`` blocks). Inside a task the fingerprints of a bucket
are sorted by Gray rank; runs of neighbours become nodes that hold their shared bits as (pattern, mask),
and nodes become upper nodes. Two nodes whose masked patterns already differ in more than ``radius`` bits
are dropped with all that is below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Children of an index node, and pairs looked at in one numpy step.
FANOUT, STEP = 8, 1 << 18
#: Fingerprints of one bucket that a task takes together; larger buckets are cut into tiles.
BUCKET = 1 << 15


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 text: bit set if over half of the word shingles' XXH64 values have it."""
    words = text.translate(common.LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))[: len(words) - shingle + 1].tolist()
    ends = np.concatenate((spaces, [len(joined)]))[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    n, counts = len(starts), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint's 64 bits as a signed long. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in common.binary_column(batch, "text")], np.uint64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray code."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of 0..n-1's component under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def bucket_links(group: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Root index for each row: rows of one group join if a chain of steps of at most ``radius`` bits links them.

    Rows come sorted by group and, within it, by Gray rank.
    """
    n = len(fp)
    levels = [(group, fp, np.full(n, ~np.uint64(0)), np.arange(n), np.arange(1, n + 1))]  # group, pattern, mask, first row, end row
    parents_of, bound = [], np.uint64(radius)
    while True:
        g, pattern, mask, first, end = levels[-1]
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        if len(starts) == len(g):
            break
        within = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
        heads = np.flatnonzero(within % FANOUT == 0)
        ones = np.bitwise_and.reduceat(pattern & mask, heads)
        some = np.bitwise_or.reduceat(pattern & mask, heads)
        shared = np.bitwise_and.reduceat(mask, heads) & ~(ones ^ some)
        stops = np.append(heads[1:], len(g))
        parents_of.append((heads, stops))
        levels.append((g[heads], ones & shared, shared, first[heads], end[stops - 1]))
    root = np.arange(n)
    top = len(levels) - 1
    every = np.arange(len(levels[top][0]))
    todo = [(top, every[i : i + STEP], every[i : i + STEP]) for i in range(0, len(every), STEP)]
    while todo:
        at, i, j = todo.pop()
        _, pattern, mask, first, end = levels[at]
        apart = (pattern[i] ^ pattern[j]) & mask[i] & mask[j]
        keep = np.bitwise_count(apart) <= bound
        i, j, apart = i[keep], j[keep], apart[keep]
        if at == 0:
            keep = (i != j) & (root[i] != root[j])
            if keep.any():
                root = _roots(n, np.concatenate((i[keep], np.arange(n))), np.concatenate((j[keep], root)))
            continue
        widest = np.bitwise_count(apart | ~(mask[i] & mask[j])) <= bound  # everything below links
        if widest.any():
            x, y = i[widest], j[widest]
            marks = np.zeros(n + 1, np.int64)
            np.add.at(marks, np.concatenate((first[x], first[y])) + 1, 1)
            np.add.at(marks, np.concatenate((end[x], end[y])), -1)
            chained = np.flatnonzero(np.cumsum(marks)[:n] > 0)
            root = _roots(n, np.concatenate((first[x], chained, np.arange(n))), np.concatenate((first[y], chained - 1, root)))
        i, j = i[~widest], j[~widest]
        same = (root[first[i]] == root[first[j]]) & _one_root(root, first[i], end[i]) & _one_root(root, first[j], end[j])
        i, j = i[~same], j[~same]
        heads, stops = parents_of[at - 1]
        for s in range(0, len(i), STEP // FANOUT**2 + 1):
            x, y = i[s : s + STEP // FANOUT**2 + 1], j[s : s + STEP // FANOUT**2 + 1]
            step = np.arange(FANOUT)
            left = np.repeat(heads[x][:, None] + step, FANOUT, axis=1)
            right = np.tile(heads[y][:, None] + step, (1, FANOUT))
            real = (left < stops[x][:, None]) & (right < stops[y][:, None]) & (left <= right)
            todo.append((at - 1, left[real], right[real]))
    return root


def _one_root(root: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether all rows from first to end have one root."""
    changes = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
    return changes[end - 1] == changes[first] if len(first) else np.zeros(0, bool)


def links(reps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (column fp of ``reps``), enough to connect each group.

    A task returns at most one edge for each row it reads.
    """
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = F.array(*[
        F.lit(i << 32).cast("long").bitwiseOR(F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)))
        for i in range(blocks)
    ])
    rows = reps.select("fp", F.explode(keys).alias("key"))
    # at most blocks * 2^13 keys exist, whatever the input, so this side has a proven bound
    large = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET)
    rows = rows.join(F.broadcast(large), "key", "left").select(
        "fp", "key", F.explode(common.tile(F.col("key"), F.col("size"), BUCKET, F.col("fp"))).alias("tile")
    )
    rows = rows.select("fp", F.xxhash64("key", "tile").alias("bucket")).repartition(common.partitions(reps.sparkSession), "bucket").sortWithinPartitions("bucket")

    def joined(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fp), bucket))
        bucket, fp = bucket[order], fp[order]
        root = bucket_links(bucket, fp, radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.record_batch([pa.array(fp[moved].view(np.int64)), pa.array(fp[root[moved]].view(np.int64))], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            bucket = np.concatenate((bucket, batch.column(1).to_numpy()))
            fp = np.concatenate((fp, batch.column(0).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0  # the last bucket may go on
            if cut >= BUCKET:
                yield joined(bucket[:cut], fp[:cut])
                bucket, fp = bucket[cut:], fp[cut:]
        if len(bucket):
            yield joined(bucket, fp)

    return rows.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most ``radius``
    bits, own id included. Null and empty texts have fingerprint zero and link like any other. Rows that
    repeat an id each get a row, in the component of its own text. A row without id keeps a null id; it takes the component of its
    fingerprint's other rows and links nothing itself. Other columns of ``docs`` are not read.
    """
    fps = common.checkpoint(fingerprints(docs, id_col, text_col, shingle))
    reps = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    members = common.components(links(reps, radius))
    known = reps.join(members, reps.fp == members.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("class"))
    classes = known.join(known.groupBy("class").agg(F.min("rep").alias("component_id")), "class").select("fp", "component_id")
    return fps.join(classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
