"""Exact nearest codes by incremental multi-index hashing.

A 64-bit code is cut in SEGMENTS segments, and each block of the index holds, for each segment, its codes
by that segment's value. A query looks up the values within radius 0, 1, 2, ... of its own segments; after
radius r in the first s segments it has seen every code within SEGMENTS * r + s - 1 bits, and it
ends once its kth best verified distance is no more than that. The queries of a block go through the radii together. Blocks of
queries meet blocks of codes in separate tasks; the best of each block are then merged. An index of one block is
spread by its queries alone: cutting a small index would have each query search each part to a larger radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Segments of a code; codes of a block, and queries of a block.
SEGMENTS, BLOCK, QUERIES = 4, 1 << 18, 1 << 12
#: Queries that go through the radii together, and probes that are looked up at a time.
TOGETHER, PROBES = 64, 1 << 18
WIDTH = 64 // SEGMENTS


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit i is set if component i (of 64) is above zero. Rows without id, or whose vector is null, has
    a null or has not 64 components, have no code and are left out."""
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get("v", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0))
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.where((F.size("v") == 64) & ~F.exists("v", lambda x: x.isNull()) & F.col("id").isNotNull()).select("id", bits.alias("code"))


def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)], np.int64)


class Index:
    """Codes of a block by segment value: one table of places for each segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[order], codes[order].view(np.uint64)
        self.tables, self.values = [], [self.segment(self.codes, s) for s in range(SEGMENTS)]
        for value in self.values:
            place = np.argsort(value, kind="stable")
            self.tables.append((place, np.searchsorted(value[place], np.arange((1 << WIDTH) + 1))))
        self.masks = [_masks(r) for r in range(WIDTH + 1)]

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, distance) of each query's k nearest, by query, distance and then id."""
        found = [self._together(asked[at : at + TOGETHER].view(np.uint64), min(k, len(self.ids)), at) for at in range(0, len(asked), TOGETHER)]
        return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *found, strict=True))

    def _together(self, asked: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """search() for a few queries; those whose kth best distance is covered leave the search."""
        values = np.stack([self.segment(asked, s) for s in range(SEGMENTS)])
        open_, counts, parts = np.arange(len(asked)), np.zeros((len(asked), 66), np.int64), []
        bound = np.full(len(asked), 64)  # kth best distance as far as known
        for radius in range(WIDTH + 1):
            for s in range(SEGMENTS):
                if k == 0 or len(open_) == 0:
                    break
                step = max(1, PROBES // len(self.masks[radius]))
                for part in [open_[i : i + step] for i in range(0, len(open_), step)]:
                    q, at = self._probed(values[:, part], radius, s)
                    q = part[q]
                    dist = np.bitwise_count(self.codes[at] ^ asked[q]).astype(np.int64)
                    counts += np.bincount(q * 66 + dist, minlength=counts.size).reshape(counts.shape)
                    near = dist <= bound[q]
                    parts.append((q[near], at[near], dist[near]))
                above = np.cumsum(counts[open_], axis=1)
                bound[open_] = np.minimum(np.where(above[:, -1] >= k, np.argmax(above >= k, axis=1), 64), 64)
                # every code within SEGMENTS * radius + s bits is among the found
                open_ = open_[(above[:, -1] < k) | (bound[open_] > SEGMENTS * radius + s)]
        q, at, dist = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *parts, strict=True))
        near = dist <= bound[q]
        q, at, dist = q[near], at[near], dist[near]
        order = np.lexsort((at, dist, q))
        q, at, dist = q[order], at[order], dist[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[first] + base, self.ids[at[first]], dist[first]

    def _probed(self, values: np.ndarray, radius: int, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, place) of the codes that are ``radius`` bits off in segment s and that no look-up before this one gave."""
        place, start = self.tables[s]
        probes = (values[s][:, None] ^ self.masks[radius]).ravel()
        low = start[probes]
        size = start[probes + 1] - low
        hit = np.flatnonzero(size)
        low, size = low[hit], size[hit]
        q = np.repeat(hit // len(self.masks[radius]), size)
        at = place[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(len(q))]
        new = np.ones(len(q), bool)
        for t in range(SEGMENTS):
            if t != s:
                new &= np.bitwise_count(self.values[t][at] ^ values[t][q]) >= (radius + 1 if t < s else radius)
        return q[new], at[new]


PAIRS = "query_id long, neighbour_id long, distance int"


def nearest(queries: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): each query's k nearest codes, ties by smaller id.

    Both sides are (id, code); a query that is in the index finds itself first. Repeated rows count once, and of
    several codes of one id the least (as a signed number) counts; rows without id or code are left out. Further columns
    are ignored. An index of fewer than k codes returns all of them, an empty one none.
    """
    one = lambda rows: rows.where("id IS NOT NULL AND code IS NOT NULL").groupBy("id").agg(F.min("code").alias("code"))
    queries, index = one(queries), one(index)
    size, asked = index.count(), queries.count()
    blocks = max(1, -(-size // BLOCK))
    groups = max(1, -(-asked // QUERIES), min(common.partitions(index.sparkSession) // blocks, -(-asked // TOGETHER)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.select("id", "code", block(groups).alias("g"), every(blocks).alias("b"))
    right = index.select("id", "code", block(blocks).alias("b"), every(groups).alias("g"))

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        index = Index(held["id"].to_numpy(), held["code"].to_numpy())
        q, ids, dist = index.search(asked["code"].to_numpy(np.int64), k)
        return pd.DataFrame({"query_id": asked["id"].to_numpy(np.int64)[q], "neighbour_id": ids, "distance": dist.astype(np.int32)})

    # a stated number of partitions: small blocks are much work, and merged by their bytes they would be one task
    spread = lambda rows: rows.repartition(blocks * groups, "b", "g").groupBy("b", "g")
    pairs = spread(left).cogroup(spread(right)).applyInPandas(run, PAIRS)
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k)  # at most k from each block
    ranked = pairs.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("x.neighbour_id").alias("neighbour_id"), F.col("x.distance").cast("long").alias("distance"))
