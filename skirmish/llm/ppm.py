"""Language-model scores by prediction by partial matching over bytes, beside a word unigram base.

The pretrained model is a byte-context trie of order ORDER: each node holds how often a byte followed a
context of 0 to ORDER bytes. All counts come from one table of (ORDER + 1)-byte grams over all training
texts; a shorter context's counts are sums over the longer ones. Every node counts, at any size of input. A
context gives a byte its count over (total + distinct), and escapes to the next shorter context with the
rest (distinct); bytes that the longer context knows are excluded there. Beyond order 0 the bytes left are
equally likely. A text's code ends with an end symbol.

The trie is cut in buckets by the NEAR bytes before the symbol: all longer contexts of a gram lie in its bucket, and
what is shorter has at most 256 ** NEAR nodes and goes to every task. The most frequent grams, 1 / RATE at most, go to
every task with their scores; occurrences of the others go to their bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of context; one over the number of grams whose scores go to every task; byte that pads starts and ends a text (in no UTF-8).
ORDER, RATE, EDGE = 5, 2.0**-20, 0xFF
#: Bytes of context that choose a gram's bucket.
NEAR = 3
#: Words with at least this share of the training tokens go to every task (at most 1 / COMMON of them); a bucket of the others' occurrences.
COMMON, BUCKET = 2.0**-17, 1_500_000
#: Counts that a task holds before it passes them on; remembered word hashes and grams.
HELD, CACHE, MEMO = 1 << 20, 1 << 18, 1 << 20
#: The end of a text counts as a token; no word is empty.
END = xxhash.xxh64_intdigest(b"")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def held_out(doc_id: int | None) -> bool:
    """Whether a document is scored only; one without id counts as if its id were the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens(text: bytes, cache: _Hashes) -> np.ndarray:
    """Hashes of a text's words and its end."""
    words = text.translate(common.LOWER).split()
    return np.fromiter(map(cache.__getitem__, (*words, b"")), np.uint64, len(words) + 1)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER + 1)-byte grams that end at each byte, and at the end, of each text; and where each text's begin."""
    pad = bytes([EDGE]) * ORDER
    flat = np.frombuffer(b"".join(x for t in texts for x in (pad, t, pad[:1])), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    keys = np.zeros(len(flat), np.uint64)
    for i in range(ORDER + 1):
        keys[ORDER:] |= flat[ORDER - i : len(flat) - i].astype(np.uint64) << np.uint64(8 * i)
    symbols = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    for i in range(ORDER):
        symbols[starts + i] = False
    return keys[symbols], np.cumsum(sizes) - sizes


class _Counts:
    """Counts of 64-bit keys, merged now and then."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        new, counts = np.unique(keys, return_counts=True)
        both = np.concatenate((self.keys, new))
        order = np.argsort(both, kind="stable")
        both, counts = both[order], np.concatenate((self.counts, counts))[order]
        heads = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
        self.keys, self.counts = both[heads], np.add.reduceat(counts, heads) if len(heads) else counts

    def take(self, kind: int) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(np.full(len(self.keys), kind, np.int8)), pa.array(self.keys.view(np.int64)), pa.array(self.counts)], ["kind", "key", "n"])
        self.__init__()
        return out


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over the training rows of (doc_id, text): kind 0 byte grams, kind 1 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sums = _Hashes(), (_Counts(), _Counts())
        for batch in common.slices(batches, "text"):
            keep = [not held_out(i) for i in batch.column(0).to_pylist()]
            texts = [t for t, k in zip(common.binary_column(batch, "text"), keep, strict=True) if k]
            if texts:
                sums[0].add(grams(texts)[0])
                sums[1].add(np.concatenate([tokens(t, cache) for t in texts]))
            for kind in (0, 1):
                if len(sums[kind].keys) >= HELD:
                    yield sums[kind].take(kind)
        for kind in (0, 1):
            yield sums[kind].take(kind)

    return docs.mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """The pretrained model: for each order, nodes (context and byte) with counts, and what contexts need to escape."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], total: int):
        """nodes: for each order, sorted keys of order + 1 bytes and their counts; total: all training bytes and ends."""
        self.nodes, self.contexts = nodes, []
        for order, (keys, counts) in enumerate(nodes):
            context, head, d = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
            known = np.add.reduceat(counts, head) if len(head) else np.zeros(0, np.int64)
            if order == 0:
                seen = np.full(len(context), total, np.int64)
                below = np.zeros(len(context), np.int64)
            else:
                seen = np.where(self._found(order - 1, context), self._count(order - 1, context), known)
                shorter = keys & np.uint64((1 << 8 * order) - 1)
                below = np.add.reduceat(self._count(order - 1, shorter), head) if len(head) else known
            self.contexts.append((context, known, np.maximum(seen - known, 0), d, below))

    def _place(self, keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, keys), max(0, len(among) - 1))
        return at, among[at] == keys if len(among) else np.zeros(len(keys), bool)

    def _found(self, order: int, keys: np.ndarray) -> np.ndarray:
        return self._place(keys, self.nodes[order][0])[1]

    def _count(self, order: int, keys: np.ndarray) -> np.ndarray:
        at, found = self._place(keys, self.nodes[order][0])
        return np.where(found, self.nodes[order][1][at], 0) if len(self.nodes[order][0]) else np.zeros(len(keys), np.int64)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        excluded, gone = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # counts here, and number, of bytes known above
        for order in range(ORDER, -1, -1):
            key = keys[open_] & np.uint64((1 << 8 * (order + 1)) - 1)
            context, known, rest, d, below = self.contexts[order]
            at, there = self._place(key >> np.uint64(8), context)
            if there.any():
                spot, own = open_[there], at[there]
                escape = rest[own] + d[own] - gone[spot]
                whole = known[own] - excluded[spot] + escape
                count = self._count(order, key[there])
                hit = count > 0
                out[spot] += np.log10(np.where(hit, count, np.maximum(escape, 1)) / np.maximum(whole, 1))
                excluded[spot], gone[spot] = below[own], d[own]
                done = np.zeros(len(keys), bool)
                done[spot[hit]] = True
                open_ = open_[~done[open_]]
            # a context that isn't there knows no byte and is passed over; what is excluded stays excluded
        out[open_] -= np.log10(256 - gone[open_])
        return out


@dataclass(frozen=True)
class Model:
    grams: np.ndarray  # common grams, sorted, and their log10 probabilities
    logs: np.ndarray
    short: list[tuple[np.ndarray, np.ndarray]]  # nodes of orders below NEAR
    size: int  # training bytes and ends
    rare: int  # training occurrences of other grams, or number of all grams if that is more
    common: np.ndarray  # hashes of common tokens, sorted
    counts: np.ndarray
    tokens: int
    distinct: int


def train(counts: DataFrame) -> Model:
    """From all training rows' counts, fetch what goes to every task: at most 1 / RATE grams, 256 ** NEAR short nodes and 1 / COMMON words."""
    totals = {r["kind"]: (r["n"], r["keys"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("keys")).collect()}
    (size, nodes), (total, distinct) = totals.get(0, (0, 0)), totals.get(1, (0, 0))
    own = counts.where("kind = 0").select("key", "n")
    near = own.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * NEAR) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    steps = F.floor(F.log2("n") * 8).cast("int")  # few hundred, whatever the input
    floor, room = None, 1 / RATE
    for r in sorted(own.groupBy(steps.alias("step")).agg(F.count("*").alias("grams")).collect(), key=lambda r: -r["step"]):
        room -= r["grams"]
        if room < 0:
            break
        floor = r["step"]
    often = own.where(steps >= floor if floor is not None else F.lit(False)).select("key", "n", F.shiftrightunsigned("key", 8).alias("context"))
    contexts = own.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(F.sum("n").alias("known"), F.count("*").alias("d"))
    kept = often.join(contexts, "context").select("key", "n", F.log10(F.col("n") / (F.col("known") + F.col("d"))).alias("log")).toArrow()
    words = counts.where((F.col("kind") == 1) & (F.col("n") >= max(1.0, total * COMMON))).select("key", "n").toArrow()
    key, n, logs = (kept.column(i).to_numpy() for i in range(3))
    first = np.argsort(key.view(np.uint64))
    hashes, times = words.column(0).to_numpy().view(np.uint64), words.column(1).to_numpy()
    sort = np.argsort(hashes)
    short = shorter(near.column(0).to_numpy().view(np.uint64), near.column(1).to_numpy(), range(NEAR))
    return Model(key.view(np.uint64)[first], logs[first], short, size, max(size - int(n.sum()), nodes), hashes[sort], times[sort], total, distinct)


def shorter(keys: np.ndarray, counts: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted nodes of each order, with counts summed over longer grams."""
    out = []
    for order in orders:
        node, place = np.unique(keys & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
        sums = np.zeros(len(node), np.int64)
        np.add.at(sums, place, counts)
        out.append((node, sums))
    return out


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each gram, by the NEAR bytes before its last."""
    near = keys >> np.uint64(8) & np.uint64((1 << 8 * NEAR) - 1)
    return ((near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class _Memo:
    """Scores of common grams, NaN for others, remembered in a table of fixed size."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        self.grams, self.logs = grams, logs
        self.keys, self.values = np.full(MEMO, ~np.uint64(0)), np.zeros(MEMO, np.float32)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        at = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - MEMO.bit_length())
        out, known = self.values[at].astype(np.float64), self.keys[at] == keys
        if not known.all():
            new, back = np.unique(keys[~known], return_inverse=True)
            values = np.full(len(new), np.nan, np.float32)
            if len(self.grams):
                spot = np.minimum(np.searchsorted(self.grams, new), len(self.grams) - 1)
                found = self.grams[spot] == new
                values[found] = self.logs[spot[found]]
            out[~known] = values[back]
            place = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - MEMO.bit_length())
            place, first = np.unique(place, return_index=True)
            self.keys[place], self.values[place] = new[first], values[first]
        return out


def cut(order_by: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Distinct values of ``order_by``, and for each the rows of the arrays as bytes."""
    order = np.argsort(order_by, kind="stable")
    found, first = np.unique(order_by[order], return_index=True)
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True))
    return found, [[x[a:b].tobytes() for a, b in cuts] for x in (y[order] for y in arrays)]


#: Rows of a slice of texts, packed in arrays; occurrences of rare words, and what a bucket makes of them.
PARTS = "bucket int, slice long, ids array<long>, held array<boolean>, sizes binary, known binary, base binary, score binary, hashes binary, owners binary, grams binary, times binary"
SUMS = "slice long, ids array<long>, held array<boolean>, sizes binary, known binary, base binary, score binary, owners binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod 10 is not 0 train both models; all rows are scored. Null text is empty:
    its only token, and its only symbol, is the end. Rows without id train unless crc32 of the empty text says
    otherwise (it does: they are held out). Repeated rows count and score each. Other columns are not read.

    Words' counts are exact: common words' come with the model; of the others every occurrence goes to
    the bucket of its word's hash, where it is counted and turned into a part of its row's base score. Grams are
    scored likewise, by the trie's nodes of their bucket.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, _Hashes()
        memo, logs = _Memo(own.grams, own.logs), np.log10(own.counts + 0.1)
        next_key = TaskContext.get().partitionId() << 32
        for batch in common.slices(batches, "text"):
            ids, texts = batch.column(0).to_pylist(), common.binary_column(batch, "text")
            n = len(ids)
            keys, starts = grams(texts)
            each_gram = memo.log10(keys)
            rare = np.flatnonzero(np.isnan(each_gram))
            score, rare_keys = np.add.reduceat(np.nan_to_num(each_gram, copy=False), starts), keys[rare]
            del keys, each_gram
            each = [tokens(t, cache) for t in texts]
            sizes = np.array([len(x) for x in each])
            h, owner = np.concatenate(each), np.repeat(np.arange(n), sizes)
            at = np.minimum(np.searchsorted(own.common, h), max(0, len(own.common) - 1))
            often = own.common[at] == h if len(own.common) else np.zeros(len(h), bool)
            base = np.bincount(owner[often], weights=logs[at[often]], minlength=n).astype(np.float64)
            known = np.bincount(owner[often], minlength=n)
            held = np.array([held_out(i) for i in ids])
            key, next_key = next_key, next_key + 1
            whole = [[ids], [held.tolist()], *([x.tobytes()] for x in (sizes.astype(np.int64), known.astype(np.int64), base, score))]
            yield packed([key % (buckets + tries)], [key], *whole)
            if not often.all():
                h, owner = h[~often], owner[~often]
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                found, (hashes, owners) = cut(bucket, h, (owner << 1 | ~held[owner]).astype(np.int32))
                yield packed(found, np.full(len(found), key), hashes=hashes, owners=owners)
            if len(rare):
                owner = (np.searchsorted(starts, rare, side="right") - 1).astype(np.int32)
                found, (asked, owners) = cut(buckets_of(rare_keys, tries), rare_keys, owner)
                yield packed(found + buckets, np.full(len(found), key), owners=owners, grams=asked)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All grams of the training rows, for their buckets."""
        for batch in batches:
            keys, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            if len(keys):
                found, (own, times) = cut(buckets_of(keys, tries), keys, n)
                yield packed(found + buckets, np.full(len(found), -1), grams=own, times=times)

    parts_schema = pa.schema(
        [("bucket", pa.int32()), ("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((n, pa.binary()) for n in ("sizes", "known", "base", "score", "hashes", "owners", "grams", "times"))]
    )

    def packed(bucket, key, *whole, **parts) -> pa.RecordBatch:
        """Rows of PARTS: those of a slice with ``whole`` columns, or parts of it for buckets."""
        own = {"bucket": bucket, "slice": key} | dict(zip(("ids", "held", "sizes", "known", "base", "score"), whole, strict=False)) | parts
        return pa.record_batch([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(bucket), f.type) for f in parts_schema], schema=parts_schema)

    def rest(table: pa.Table) -> pa.Table:
        """Scores of a bucket's words or grams, as sums for each slice and row; rows of slices pass."""
        names = [f.split()[0] for f in SUMS.split(", ")]
        whole = table.filter(pa.compute.is_valid(table["ids"])).select(names)
        asked = table.filter(pa.compute.and_(pa.compute.is_valid(table["grams"]), pa.compute.is_valid(table["owners"])))
        if asked.num_rows:
            return pa.concat_tables([whole.cast(schema), grams_of(asked, table.filter(pa.compute.is_valid(table["times"])))])
        parts = table.filter(pa.compute.is_valid(table["hashes"]))
        if parts.num_rows == 0:
            return whole
        hashes = [np.frombuffer(x, np.uint64) for x in parts["hashes"].to_pylist()]
        owners = [np.frombuffer(x, np.int32) for x in parts["owners"].to_pylist()]
        _, word = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.bincount(word, weights=np.concatenate(owners) & 1)[word]
        known, base, rows, at = [], [], [], 0
        for own in owners:
            count, at = c[at : at + len(own)], at + len(own)
            row, place = np.unique(own >> 1, return_inverse=True)
            rows.append(row.astype(np.int32).tobytes())
            known.append(np.bincount(place, weights=count > 0).astype(np.int64).tobytes())
            base.append(np.bincount(place, weights=np.log10(count + 0.1)).tobytes())
        m = len(rows)
        sums = [
            parts["slice"].combine_chunks(), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.bool_())), pa.nulls(m, pa.binary()),
            pa.array(known, pa.binary()), pa.array(base, pa.binary()), pa.nulls(m, pa.binary()), pa.array(rows, pa.binary()),
        ]
        return pa.concat_tables([whole.cast(schema), pa.table(sums, schema=schema)])

    def grams_of(asked: pa.Table, known: pa.Table) -> pa.Table:
        """Scores of the grams that slices ask of a bucket, by its part of the trie."""
        own = shared.value
        keys, times = (np.frombuffer(b"".join(known[c].to_pylist()), t) for c, t in (("grams", np.uint64), ("times", np.int64)))
        trie = Trie(own.short + shorter(keys, times, range(NEAR, ORDER + 1)), own.size)
        wanted = [np.frombuffer(x, np.uint64) for x in asked["grams"].to_pylist()]
        each, back = np.unique(np.concatenate(wanted), return_inverse=True)
        values = trie.log10(each)[back]
        score, rows, at = [], [], 0
        for owner in asked["owners"].to_pylist():
            owner = np.frombuffer(owner, np.int32)
            row, place = np.unique(owner, return_inverse=True)
            rows.append(row.tobytes())
            score.append(np.bincount(place, weights=values[at : at + len(owner)]).tobytes())
            at += len(owner)
        own = {"slice": asked["slice"].combine_chunks(), "score": pa.array(score, pa.binary()), "owners": pa.array(rows, pa.binary())}
        return pa.table([own.get(f.name, pa.nulls(len(rows), f.type)) for f in schema], schema=schema)

    schema = pa.schema(
        [("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((n, pa.binary()) for n in ("sizes", "known", "base", "score", "owners"))]
    )

    def unpacked(table: pa.Table) -> pa.Table:
        """The rows of one slice, with the sums of all buckets."""
        whole = table.filter(pa.compute.is_valid(table["ids"]))
        number = lambda name, kind: np.frombuffer(whole[name][0].as_py(), kind).copy()
        known, base, score = number("known", np.int64), number("base", np.float64), number("score", np.float64)
        parts = table.filter(pa.compute.is_null(table["ids"]))
        for k, b, x, rows in zip(*(parts[c].to_pylist() for c in ("known", "base", "score", "owners")), strict=True):
            rows = np.frombuffer(rows, np.int32)
            if x is not None:
                score[rows] += np.frombuffer(x, np.float64)
                continue
            known[rows] += np.frombuffer(k, np.int64)
            base[rows] += np.frombuffer(b, np.float64)
        columns = [pa.array(whole["ids"][0].as_py(), pa.int64()), pa.array(whole["held"][0].as_py(), pa.bool_()), pa.array(number("sizes", np.int64)), pa.array(known), pa.array(base), pa.array(score)]
        return pa.table(columns, [f.split()[0] for f in RESULT.split(", ")])

    with common.written(corpus_counts(texts)) as counts:
        model = train(counts)
        # buckets of words come first, then those of grams
        buckets, tries = max(1, -(-model.tokens // BUCKET)), max(1, -(-model.rare // BUCKET))
        trie = common.checkpoint(counts.where("kind = 0").select("key", "n").mapInArrow(nodes, PARTS))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by RATE, NEAR and COMMON
    parts = texts.mapInArrow(run, PARTS).unionByName(trie)
    got = parts.groupBy("bucket").applyInArrow(rest, SUMS).groupBy("slice").applyInArrow(unpacked, RESULT)
    scale = float(np.log10(model.tokens + 0.1 * (model.distinct + 1)))
    return got.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score"
    )
