"""Benchmark decontamination by winnowed word k-grams.

A fingerprint is a word k-gram's hash, kept where it is the least of a sliding window of k-gram hashes;
with k = 5 and 6 hashes in a window, any 10 shared consecutive words share a kept fingerprint at the
same place. Training and benchmark fingerprints are joined on the hash, and each hit is extended word
by word over the words around it to the full length of the match. Items shorter than the window have
all their n-grams of that length looked up instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Word bytes after lower-casing A-Z: digits, a-z and all of non-ASCII; the rest separate words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words that a benchmark window holds, words in a fingerprint, and fingerprints in a winnowing window.
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Bits of the filter of benchmark fingerprints that the document scan gets: a fixed 4 MB.
FILTER_BITS = 1 << 25
#: Remembered word hashes in a task.
CACHE = 1 << 18


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, from the words' hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(length))
    for i in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return _mixed(h)


def winnow(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the least hash (the last of equals) in each run of SPAN hashes whose words are all of one text."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h[:n].copy(), np.arange(n)
    for i in range(1, SPAN):
        less = h[i : i + n] <= best
        best = np.where(less, h[i : i + n], best)
        at = np.where(less, np.arange(i, i + n), at)
    return np.unique(at[doc[:n] == doc[WINDOW - 1 : WINDOW - 1 + n]])


def _flat(texts: list[bytes], cache: _Hashes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of the texts, their hashes, and where each text's words begin (one more at the end)."""
    words: list[bytes] = []
    starts = [0]
    for t in texts:
        words += split_words(t)
        starts.append(len(words))
    return words, np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), np.array(starts)


def _grams(hashes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word runs, and the text of each (-1 where a run crosses texts)."""
    h = gram_hashes(hashes, length)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    doc = np.where(owner[: len(h)] == owner[length - 1 :][: len(h)], owner[: len(h)], -1)
    return h, doc


def _places(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed k-grams of the texts: where they begin, and their hashes."""
    h = gram_hashes(hashes, GRAM)
    at = winnow(h, np.repeat(np.arange(len(starts) - 1), np.diff(starts)))
    return at, h[at]


def _around(words: list[bytes], at: int, low: int, high: int) -> bytes:
    """The k-gram at ``at`` with the words of a window on either side; a line break marks where it begins."""
    a, b = max(low, at - SPAN + 1), min(high, at + WINDOW)
    return b" ".join(words[a:at]) + b"\n" + b" ".join(words[at:b])


BENCH = "item_id string, length int, hash long, around binary"


def bench_fingerprints(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, hash, around): winnowed k-grams of long items (length WINDOW), or the whole short item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in common.slices(batches, "text"):
            ids, lengths, out, around = [], [], [], []
            words, hashes, starts = _flat(common.binary_column(batch, "text"), cache)
            names = batch.column(0).to_pylist()
            at, h = _places(hashes, starts)
            owner = np.searchsorted(starts, at, side="right") - 1
            for p, value, o in zip(at.tolist(), h.tolist(), owner.tolist(), strict=True):
                ids.append(names[o]), lengths.append(WINDOW), out.append(value)
                around.append(_around(words, p, starts[o], starts[o + 1]))
            for o in np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < WINDOW)).tolist():
                a, b = starts[o], starts[o + 1]
                ids.append(names[o]), lengths.append(int(b - a)), out.append(int(gram_hashes(hashes[a:b], int(b - a))[0]))
                around.append(b" ".join(words[a:b]))
            yield pa.record_batch(
                [pa.array(ids, pa.string()), pa.array(lengths, pa.int32()), pa.array(np.array(out, np.uint64).view(np.int64)), pa.array(around, pa.binary())],
                ["item_id", "length", "hash", "around"],
            )

    return bench.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null").mapInArrow(run, BENCH)


def fingerprint_filter(prints: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set where a benchmark fingerprint's hash falls; built in tasks, of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.record_batch([pa.array(at), pa.array(words[at])], ["at", "bits"])

    rows = prints.select("hash").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits"))
    found = rows.toPandas()  # at most FILTER_BITS / 64 rows
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words


def extend(own: bytes, other: bytes) -> tuple[int, int] | None:
    """How many words before and from a shared k-gram's start are equal, if they make up a window."""
    (a, b), (c, d) = (x.split(b"\n") for x in (own, other))
    left, right = 0, 0
    for x, y in zip(reversed(a.split()), reversed(c.split()), strict=False):
        if x != y:
            break
        left += 1
    for x, y in zip(b.split(), d.split(), strict=False):
        if x != y:
            break
        right += 1
    return (left, right) if right >= GRAM and left + right >= WINDOW else None


SCAN = "doc_id long, text_key long, n_words long, length int, hash long, around binary, places array<int>"
HITS = "doc_id long, text_key long, n_words long, item_id string, spans array<struct<a:int,b:int>>"


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, text_key, n_words, items (sorted ids as strings), spans (of words hit, from a to before b),
    n_hit (words in any span).

    Windows are WINDOW consecutive words of an item; an item with fewer words, but not none, is one
    window. Null and empty texts have no words. Items without id, or without words, hit nothing. Rows
    that repeat both id and text give one row; an id with several texts gives one for each (text_key,
    which equals xxhash64 of the text, null as empty, tells them apart). Other columns are not read.
    """
    prints = common.checkpoint(bench_fingerprints(bench, item_col, item_text))
    bits = docs.sparkSession.sparkContext.broadcast(fingerprint_filter(prints))
    lengths = sorted(r["length"] for r in prints.select("length").distinct().collect() if r["length"] < WINDOW)  # below 10 rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, there = _Hashes(), bits.value.view(np.uint64)

        def passes(h: np.ndarray) -> np.ndarray:
            at = h >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
            return (there[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

        for batch in common.slices(batches, "text"):
            texts = common.binary_column(batch, "text")
            words, hashes, starts = _flat(texts, cache)
            sizes = np.diff(starts)
            rows: dict[tuple[int, int, int, bytes], list[int]] = {}
            at, h = _places(hashes, starts)
            kept = passes(h)
            for p, value in zip(at[kept].tolist(), h[kept].tolist(), strict=True):
                o = int(np.searchsorted(starts, p, side="right")) - 1
                rows.setdefault((o, WINDOW, value, _around(words, p, starts[o], starts[o + 1])), []).append(p - int(starts[o]))
            for length in lengths:
                h, doc = _grams(hashes, starts, length)
                for p in np.flatnonzero(passes(h) & (doc >= 0)).tolist():
                    o = int(doc[p])
                    rows.setdefault((o, length, int(h[p]), b" ".join(words[p : p + length])), []).append(p - int(starts[o]))
            full = {o for o, *_ in rows}
            keys = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)
            # a document without candidates keeps one row that can't match; its hash spreads such rows
            for o in range(len(texts)):
                if o not in full:
                    rows[o, -1, int(keys[o]) & (1 << 63) - 1, b""] = []
            owner = np.array([o for o, *_ in rows], np.int64)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(owner)),
                    pa.array(keys[owner]),
                    pa.array(sizes[owner]),
                    pa.array([x[1] for x in rows], pa.int32()),
                    pa.array(np.array([x[2] for x in rows], np.uint64).view(np.int64)),
                    pa.array([x[3] for x in rows], pa.binary()),
                    pa.array(list(rows.values()), pa.list_(pa.int32())),
                ],
                ["doc_id", "text_key", "n_words", "length", "hash", "around", "places"],
            )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            items = batch.column(6).to_pylist()
            for length, own, other, item, places in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6, 7)), strict=True):
                if item is None:
                    spans.append([])
                elif length < WINDOW:
                    spans.append([{"a": p, "b": p + length} for p in places] if own == other else [])
                else:
                    grown = extend(own, other)
                    spans.append([{"a": p - grown[0], "b": p + grown[1]} for p in places] if grown else [])
            items = [i if s else None for i, s in zip(items, spans, strict=True)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(items, pa.string()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                ["doc_id", "text_key", "n_words", "item_id", "spans"],
            )

    scan = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCAN)
    side = prints.select("item_id", F.col("length").alias("l"), F.col("hash").alias("h"), F.col("around").alias("item_around")).distinct()
    hits = scan.join(side, (scan.length == side.l) & (scan.hash == side.h), "left").select(
        "doc_id", "text_key", "n_words", "length", "around", "item_around", "item_id", "places"
    ).mapInArrow(verify, HITS)
    found = hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return found.withColumn("n_hit", covered)
