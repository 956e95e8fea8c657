"""Hard negatives by rotated one-bit codes with deterministic bounds.

A vector less the mean of all is rotated; the signs of its components are a code, a unit vector c, and stored with it
are the vector's alignment t with c and the length of what t * c leaves over. What is left gets a code of its own, LEVELS times in
all. An anchor is rotated too and its components are rounded to PLANES bits, so its product with a code is a few
popcounts. The sum over codes of t times that product estimates the score, and by Cauchy-Schwarz the score is no farther from it than
the rounding times the alignments and the anchor's part beside the last code times what is left over. Rows whose interval can't
matter go after each code; the integer scores of the best estimates then bound the rest, and only rows whose intervals survive are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Codes of a vector, bits of an anchor's component, seed of the rotation.
LEVELS, PLANES, SEED = 4, 8, 11
#: Rows of a block, and anchors that meet a block in one task.
BLOCK, ANCHORS = 1 << 15, 1 << 10
#: Rounding of floating-point sums, as a part of the lengths that go into them.
SLACK = 1e-9
#: Components beyond this have scores that don't fit 64 bits.
LARGEST = 1 << 28
CODED = "id long, label long, v binary, codes binary, fit binary"


def scaled(vectors: DataFrame, label: Column, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, label, v): v has floor(scale * x) of each component x, as a double.

    Rows without id, label or vector go, and those of which a component is null, not finite or, scaled, beyond 2^28. Repeated ids count
    once, by the least (label, v).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector_col, lambda x: x.cast("double") * scale).alias("x"))
    whole = F.forall("x", lambda x: x.isNotNull() & (F.abs(x) <= LARGEST))  # NaN is larger than any number
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & whole)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", F.transform("x", lambda x: F.floor(x)).alias("v"))).alias("r"))
    return rows.select("id", "r.label", "r.v")


class Frame:
    """Mean and rotation; vectors shorter than ``size`` count as followed by zeros."""

    def __init__(self, centre: np.ndarray, size: int):
        self.size, self.width = size, -(-max(1, size) // 64) * 64
        self.centre = centre
        self.turn = np.linalg.qr(np.random.default_rng(SEED).normal(size=(self.width, self.width)))[0]

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.turn[:, : self.size].T

    def coded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (row, level, word) and alignments followed by lengths left over (row, 2 * LEVELS)."""
        left, codes, fit = self.rotated(vectors - self.centre), [], []
        for _ in range(LEVELS):
            bits = left > 0
            code = np.where(bits, 1.0, -1.0) / np.sqrt(self.width)
            along = (left * code).sum(1)
            left = left - along[:, None] * code
            codes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
            fit.append((along, np.sqrt((left * left).sum(1))))
        return np.stack(codes, 1), np.column_stack([a for a, _ in fit] + [r for _, r in fit])


class Anchor:
    """A rounded and rotated anchor: its products with codes by popcounts."""

    def __init__(self, vector: np.ndarray, frame: Frame):
        p = frame.rotated(vector[None].astype(np.float64))[0]
        self.vector, self.width = vector, frame.width
        self.low = p.min()
        self.step = (p.max() - self.low) / ((1 << PLANES) - 1) or 1.0
        level = np.rint((p - self.low) / self.step).astype(np.int64)
        near = self.low + self.step * level
        self.planes = [np.packbits(level >> j & 1, bitorder="little").view(np.uint64) for j in range(PLANES)]
        self.total, self.norm, self.gap = near.sum(), np.sqrt(p @ p), np.sqrt((p - near) @ (p - near))
        self.shift = float(vector @ frame.centre)

    def along(self, codes: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        rising = sum(np.bitwise_count(codes & plane).sum(1, dtype=np.int64) << j for j, plane in enumerate(self.planes))
        return (2 * (self.low * ones + self.step * rising) - self.total) / np.sqrt(self.width)


class Block:
    """Rows of a block with their codes; finds what an anchor asks for among them."""

    def __init__(self, rows: pa.Table, frame: Frame):
        many = rows.num_rows
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        read = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).reshape(many, -1)
        self.vectors = read("v", np.int64)
        self.codes = read("codes", np.uint64).reshape(many, LEVELS, -1)
        self.fit = read("fit", np.float64)

    def refined(self, anchor: Anchor, at: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows ``at``, those that ``wanted(low, high)`` keeps of the intervals after each code, and their last intervals."""
        estimate, aligned = np.full(len(at), anchor.shift), np.zeros(len(at))
        low = high = estimate
        for level in range(LEVELS):
            along = anchor.along(self.codes[at, level])
            t, left = self.fit[at, level], self.fit[at, LEVELS + level]
            estimate, aligned = estimate + t * along, aligned + t
            beside = np.sqrt(np.maximum(0, anchor.norm**2 - np.maximum(0, np.abs(along) - anchor.gap) ** 2))
            half = anchor.gap * aligned + beside * left + SLACK * (anchor.norm * (aligned + left) + abs(anchor.shift) + 1)
            low, high = estimate - half, estimate + half
            keep = wanted(low, high)
            at, estimate, aligned, low, high = at[keep], estimate[keep], aligned[keep], low[keep], high[keep]
        return at, low, high

    def best(self, anchor: Anchor, at: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        order = np.lexsort((self.ids[at], -scores))[:k]
        return [(int(self.ids[i]), int(s)) for i, s in zip(at[order], scores[order], strict=True)]

    def nearest(self, anchor: Anchor, own: int, label: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best other rows of a label."""

        def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return high >= (np.partition(low, -k)[-k] if len(low) > k else -np.inf)

        at, low, high = self.refined(anchor, np.flatnonzero((self.labels == label) & (self.ids != own)), wanted)
        if len(at) > 4 * k:
            first = np.argpartition(-(low + high), 4 * k)[: 4 * k]
            at = at[high >= np.partition(self.vectors[at[first]] @ anchor.vector, -k)[-k]]
        return self.best(anchor, at, self.vectors[at] @ anchor.vector, k)

    def below(self, anchor: Anchor, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (least, most), (id, score) of the k best rows of other labels whose score is within."""
        some = [w for w in windows if w[0] <= w[1]]
        if not some:
            return [[] for _ in windows]
        least, most = min(w[0] for w in some), max(w[1] for w in some)
        at, low, high = self.refined(anchor, np.flatnonzero(self.labels != label), lambda low, high: (high >= least) & (low <= most))
        scores, known = np.zeros(len(at), np.int64), np.zeros(len(at), bool)

        def scored(which: np.ndarray) -> np.ndarray:
            new = which[~known[which]]
            scores[new], known[new] = self.vectors[at[new]] @ anchor.vector, True
            return scores[which]

        out = []
        for least, most in windows:
            inside = np.flatnonzero((high >= least) & (low <= most)) if least <= most else np.zeros(0, np.int64)
            likely = inside[low[inside] + high[inside] <= 2 * most]
            if len(likely) > 16 * k:  # the best estimates under the window's end are scored first
                likely = likely[np.argpartition(-(low + high)[likely], 16 * k)[: 16 * k]]
                found = scored(likely)
                found = found[(found >= least) & (found <= most)]
                if len(found) >= k:
                    inside = inside[high[inside] >= np.partition(found, -k)[-k]]
            found = scored(inside)
            inside = inside[(found >= least) & (found <= most)]
            out.append(self.best(anchor, at[inside], scores[inside], k))
        return out


def coded(rows: DataFrame) -> tuple[DataFrame, Frame]:
    """(id, label, v, codes, fit), written once, and the frame they were made in."""
    rows = common.checkpoint(rows)
    n, size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    # one row a component goes to the driver
    sums = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect() if n else []
    centre = np.zeros(size or 0)
    for r in sums:
        centre[r["at"]] = float(r["s"]) / n
    frame = Frame(centre, size or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.zeros((batch.num_rows, frame.size), np.int64)
            for to, x in zip(v, batch.column(2).to_pylist(), strict=True):
                to[: len(x)] = x
            codes, fit = frame.coded(v.astype(np.float64))
            binary = lambda rows: pa.array([x.tobytes() for x in rows], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), binary(v), binary(codes), binary(fit)], ["id", "label", "v", "codes", "fit"])

    return common.checkpoint(rows.mapInArrow(run, CODED)), frame


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _blocks(n: Column, rows: DataFrame) -> Column:
    """Blocks of n rows: as few as BLOCK allows, but enough for all tasks."""
    return F.greatest(F.ceil(n / BLOCK), F.least(F.lit(common.partitions(rows.sparkSession)), F.ceil(n / (BLOCK / 16))), F.lit(1)).cast("int")


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def positives(rows: DataFrame, anchors: DataFrame, frame: Frame, k: int) -> DataFrame:
    """(anchor_id, positive_id, score): each anchor's k best other rows of its label, in blocks of a label's rows."""
    size = rows.groupBy("label").agg(F.count("*").alias("n")).select("label", _blocks(F.col("n"), rows).alias("blocks"))
    asks = anchors.groupBy("label").agg(F.count("*").alias("n")).select("label", F.ceil(F.col("n") / ANCHORS).alias("groups"))
    both = size.join(asks, "label")
    left = anchors.join(both, "label").select("id", "label", "v", _block(F.col("groups")).alias("g"), "blocks").select("id", "label", "v", "g", _every(F.col("blocks")).alias("b"))
    right = rows.join(both, "label").select(*rows.columns, _block(F.col("blocks")).alias("b"), "groups").select(*rows.columns, "b", _every(F.col("groups")).alias("g"))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if held.num_rows:
            block = Block(held, frame)
            for q, label, v in zip(asked.column("id").to_pylist(), asked.column("label").to_pylist(), asked.column("v").to_pylist(), strict=True):
                out += [(q, *x) for x in block.nearest(Anchor(np.frombuffer(v, np.int64), frame), q, label, k)]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["anchor_id", "positive_id", "score"])

    key = ["label", "b", "g"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "anchor_id long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def negatives(rows: DataFrame, asked: DataFrame, frame: Frame, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, negative_id, positive_score, score) of ``asked``: (id, label, v, found: positives with their scores)."""
    blocks = rows.agg(_blocks(F.count("*"), rows)).first()[0]
    groups = max(1, -(-asked.count() // ANCHORS))
    left = asked.withColumn("g", _block(F.lit(groups))).withColumn("b", _every(F.lit(blocks)))
    right = rows.withColumn("b", _block(F.lit(blocks))).withColumn("g", _every(F.lit(groups)))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if held.num_rows:
            block = Block(held, frame)
            for r in asked.select(["id", "label", "v", "found"]).to_pylist():
                windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in r["found"]]
                for p, some in zip(r["found"], block.below(Anchor(np.frombuffer(r["v"], np.int64), frame), r["label"], windows, k), strict=True):
                    out += [(r["id"], p["positive_id"], i, p["score"], s) for i, s in some]
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names)

    spread = lambda rows: rows.repartition(blocks * groups, "b", "g").groupBy("b", "g")
    found = spread(left).cogroup(spread(right)).applyInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def mined(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label, v) as ``scaled`` gives them.

    A score is the integer product with the anchor. An anchor's positives are its best ``n_positives`` other rows of its label, ties by
    smaller id; for each of these come the best ``n_negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of the
    positive's, ties by smaller id. Anchors without positives, and positives without such rows, give none; an empty
    table gives none. Every anchor meets every row, in blocks: of a label's rows first, then of all.
    """
    held, frame = coded(rows)
    anchors = held.where(is_anchor).select(*[F.col(c).alias(c) for c in ("id", "label", "v")])  # names of their own beside held's
    best = common.checkpoint(positives(held, anchors, frame, n_positives))
    found = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("found"))  # at most n_positives
    asked = anchors.join(found, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "found")
    return negatives(held, asked, frame, n_negatives, low, high).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
