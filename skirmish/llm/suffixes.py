"""Removal of long repeated byte strings by suffix sorting in shards.

Every string of LENGTH bytes has an anchor: the place of the least hash among its GRAM-byte strings, the last
of equals. Equal strings have their anchors at the same place in them, so their anchors' hashes are equal, and
strings only have to meet others of the same hash. The strings of an anchor are one short body of text. Bodies
that are equal as a whole are found first, by hash, within a task and then over all. What is left are anchors
with different bodies, which may be equal in part: those bodies go to the shard of the anchor's hash. A
shard collapses equal bodies, sorts the suffixes by induction (module induced), and compares neighbours; shards
are as many as keep each at about SHARD bytes. An anchor with very many different bodies isn't left to one
shard: the strings of its bodies are grouped by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, induced

#: Bytes of a repeated string, and of an anchor.
LENGTH, GRAM = 200, 32
#: Bytes of a shard on average; different bodies in slices of text from which an anchor counts as very frequent; bits of the two anchor filters.
SHARD, FREQUENT, BITS = 2_000_000, 1 << 14, 1 << 27
#: Fixed pseudo-random numbers, one for each byte value.
BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place (a power of two of them)."""
    h, factor = BYTE[flat], 0x9E3779B97F4A7C15
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % 2**64, 2 * step
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: its hash, its text, and the first and last start of the strings it stands for."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if sizes.sum() < LENGTH:
        return none.view(np.uint64), none, none, none
    begins = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(texts), np.uint8)
    h = gram_hashes(flat)
    low = np.uint64(0xFFFFFFFF)
    least = (h >> np.uint64(32) << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64))
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :]) if span > width else least
    counts = np.maximum(sizes - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[text]
    place = (low - (least[starts] & low)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))) if len(place) else none
    ends = np.append(heads[1:], len(place)) - 1 if len(place) else none
    of = text[heads]
    return h[place[heads]], of, starts[heads] - begins[of], starts[ends] - begins[of]


def marked(bodies: list[bytes]) -> list[np.ndarray | None]:
    """For each body of a shard, which of its strings occur elsewhere in the shard (None: all)."""
    seen: dict[bytes, int] = {}
    of, times = [], []
    for b in bodies:
        i = seen.setdefault(b, len(seen))
        of.append(i)
        if i == len(times):
            times.append(0)
        times[i] += 1
    own = list(seen)
    ends = np.cumsum([len(b) + 1 for b in own])
    joined = b"\0".join(own) + b"\0"
    flat = np.frombuffer(joined, np.uint8).astype(np.int16) + 2
    flat[ends - 1] = 1
    order = induced.suffix_array(np.append(flat, 0).astype(np.int16))[1:]
    left = np.repeat(ends, np.diff(ends, prepend=0)) - 1 - np.arange(len(flat))
    order = order[left[order] >= LENGTH]
    again = induced.shared_with_previous(joined, order, LENGTH)
    twice = again | np.append(again[1:], False)
    flags = np.zeros(len(flat), bool)
    flags[order[twice]] = True
    begins = ends - np.array([len(b) + 1 for b in own])
    return [None if times[i] > 1 else flags[begins[i] : begins[i] + len(own[i]) - LENGTH + 1] for i in of]


def _runs(start: int, flags: np.ndarray) -> list[dict[str, int]]:
    """Removed byte ranges of marked string starts."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"a": start + int(a), "b": start + int(b) - 1 + LENGTH} for a, b in zip(edges[::2], edges[1::2], strict=True)]


SPANS = "k1 long, k2 long, spans array<struct<a:int,b:int>>"
SPAN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
BODIES = "anchor long, k1 long, k2 long, start int, body binary"
PLACE = "struct<k1:long,k2:long,a:int,b:int>"
PLACES = f"anchor long, d long, own {PLACE}, others array<{PLACE}>"
PLACE_TYPE = pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
FOUND = "k1 long, k2 long, spans array<struct<a:int,b:int>>, mixed array<long>, many array<long>"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k1, k2); a row is known by two hashes of id and text, which repeated rows share."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))


def whole_bodies(rows: DataFrame) -> DataFrame:
    """Per keyed row: spans of bodies that occur elsewhere as a whole, and its anchors that have different bodies.

    (k1, k2, spans, mixed, many): ``many`` are the mixed anchors with over FREQUENT different bodies. A
    slice of text passes on one row for each of its bodies, with the places of its repeats in the slice, so a
    body that is very common is as many rows as slices hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            texts = common.binary_column(batch, "text")
            h, text, first, last = anchors(texts)
            ends = (last + LENGTH).tolist()
            d = np.fromiter((xxhash.xxh64_intdigest(texts[t][a:b]) for t, a, b in zip(text.tolist(), first.tolist(), ends, strict=True)), np.uint64, len(h))
            order = np.lexsort((d, h))
            h, d, text, first, last = h[order], d[order], text[order], first[order], last[order]
            head = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, bool)
            k1, k2 = (batch.column(i).to_numpy()[text] for i in (1, 2))
            place = pa.StructArray.from_arrays([pa.array(k1), pa.array(k2), pa.array(first.astype(np.int32)), pa.array((last + LENGTH).astype(np.int32))], fields=list(PLACE_TYPE))
            starts = np.flatnonzero(head)
            more = np.flatnonzero(~head)
            offsets = np.concatenate((np.cumsum(np.diff(np.append(starts, len(h))) - 1), [0]))
            offsets = np.concatenate(([0], offsets[:-1]))
            others = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), place.take(pa.array(more)))
            yield pa.record_batch([pa.array(h[starts].view(np.int64)), pa.array(d[starts].view(np.int64)), place.take(pa.array(starts)), others], ["anchor", "d", "own", "others"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"a": a, "b": b} for a, b in merged(x)] for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, SPAN_TYPE), batch.column(3), batch.column(4)], ["k1", "k2", "spans", "mixed", "many"])

    by_anchor = Window.partitionBy("anchor")
    each = rows.select("text", "k1", "k2").mapInArrow(run, PLACES)
    each = each.withColumn("n", F.count("*").over(Window.partitionBy("anchor", "d"))).withColumn("kind", F.dense_rank().over(by_anchor.orderBy("d")))
    each = each.withColumn("kinds", F.max("kind").over(by_anchor))
    again = (F.col("n") > 1) | (F.size("others") > 0)
    entry = lambda p, known, anchor: F.struct(p["k1"].alias("k1"), p["k2"].alias("k2"), F.when(known, F.struct(p["a"].alias("a"), p["b"].alias("b"))).alias("span"), anchor.alias("mixed"))
    own = entry(F.col("own"), again, F.when(F.col("kinds") > 1, F.col("anchor")))
    entries = F.concat(F.array(own), F.transform("others", lambda p: entry(p, F.lit(True), F.lit(None).cast("long"))))
    each = each.select((F.col("kinds") > FREQUENT).alias("often"), F.explode(entries).alias("e")).select("e.*", "often").where("span is not null or mixed is not null")
    found = each.groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"), F.collect_list("mixed").alias("mixed"), F.collect_list(F.when(F.col("often"), F.col("mixed"))).alias("many"))
    return found.mapInArrow(merge, FOUND)


def repeated(rows: DataFrame) -> DataFrame:
    """(k1, k2, spans) of keyed rows that hold a repeated string: the byte ranges, from a to before b, that such strings cover."""
    spark = rows.sparkSession
    found = common.checkpoint(whole_bodies(rows))
    mixed = found.select(F.explode("mixed").alias("anchor"))
    wanted = spark.sparkContext.broadcast(common.bit_filter(mixed, BITS))
    total = found.agg(F.sum(F.size("mixed")).alias("n"), F.sum(F.size("many")).alias("many")).first()
    shards = max(1, -(-(total["n"] or 0) * (LENGTH + 85) // SHARD))
    often = spark.sparkContext.broadcast(common.bit_filter(found.select(F.explode("many").alias("anchor")), BITS)) if total["many"] else None

    def bodies(of_frequent: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, "text", 2 << 20):
                texts = common.binary_column(batch, "text")
                h, text, first, last = anchors(texts)
                kept = common.passes(wanted.value, h)
                if often:
                    kept &= common.passes(often.value, h) == of_frequent
                h, text, first, last = h[kept], text[kept], first[kept], last[kept]
                out = [texts[t][a : b + LENGTH] for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True)]
                # bodies that occur again are marked already; one of them is enough to compare with
                one = np.array(sorted({b: i for i, b in enumerate(out)}.values()), np.int64)
                h, text, first, out = h[one], text[one], first[one], [out[i] for i in one.tolist()]
                yield pa.record_batch(
                    [pa.array(h.view(np.int64)), batch.column(1).take(pa.array(text)), batch.column(2).take(pa.array(text)), pa.array(first.astype(np.int32)), pa.array(out, pa.binary())],
                    ["anchor", "k1", "k2", "start", "body"],
                )

        return rows.select("text", "k1", "k2").mapInArrow(run, BODIES)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            own = pa.Table.from_batches(parts)
            spans: dict[tuple[int, int], list] = {}
            texts = own["body"].to_pylist()
            for k1, k2, start, body, flags in zip(own["k1"].to_pylist(), own["k2"].to_pylist(), own["start"].to_pylist(), texts, marked(texts), strict=True):
                if flags is None:
                    spans.setdefault((k1, k2), []).append({"a": start, "b": start + len(body)})
                elif flags.any():
                    spans.setdefault((k1, k2), []).extend(_runs(start, flags))
            k1, k2 = zip(*spans, strict=True) if spans else ((), ())
            return pa.record_batch([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(list(spans.values()), SPAN_TYPE)], ["k1", "k2", "spans"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if held and held[0].column(0)[0].as_py() != part.column(0)[0].as_py():
                    yield done(held)
                    held = []
                held.append(part)
        if held:
            yield done(held)

    sharded = bodies(False).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    sharded = sharded.select("shard", "k1", "k2", "start", "body").repartition(common.partitions(spark), "shard").sortWithinPartitions("shard")
    partly = sharded.mapInArrow(shard, SPANS)
    partly = partly.unionByName(_frequent(bodies(True))) if often else partly
    return partly.unionByName(found.where(F.size("spans") > 0).select("k1", "k2", "spans"))


def _frequent(bodies: DataFrame) -> DataFrame:
    """Spans for anchors of any number of occurrences: no task holds more than one body at a time."""
    h = F.sha2("body", 256)
    rows = bodies.select("anchor", "k1", "k2", "start", h.alias("h"), F.length("body").alias("size"), "body")
    distinct = rows.groupBy("h").agg(F.count("*").alias("n"), F.first("body").alias("body"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(body) - LENGTH + 1
                digests = [hashlib.md5(body[i : i + LENGTH]).digest() for i in range(n)]
                yield pa.record_batch([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(digests, pa.binary())], ["h", "at", "digest"])

    each = distinct.select("h", "body").mapInArrow(strings, "h string, at int, digest binary")
    twice = each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    marks = each.join(twice, "digest").groupBy("h").agg(F.collect_set("at").alias("at"))
    marks = distinct.select("h", "n").join(marks, "h", "left")
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b")))
    parts = F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda i: F.struct((F.col("start") + i).alias("a"), (F.col("start") + i + LENGTH).alias("b")))
    return rows.drop("body").join(marks, "h").select("k1", "k2", F.when(F.col("n") > 1, whole).otherwise(parts).cast("array<struct<a:int,b:int>>").alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<a:int,b:int>>, kept binary"


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, spans (removed byte ranges), kept (the other bytes).

    A byte goes if it lies in a string of LENGTH bytes that also starts at another place of any text, its
    own included; whether it does is judged on the input. Null text is empty; a null id stays null; a
    repeated row is another place, so all of it goes if it has LENGTH bytes. Other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeated(rows).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            texts, n, gone, kept, removed = common.binary_column(batch, "text"), [], [], [], []
            for text, own in zip(texts, batch.column(2).to_pylist(), strict=True):
                ranges = merged(own or [])
                n.append(len(text))
                gone.append([{"a": a, "b": b} for a, b in ranges])
                removed.append(sum(b - a for a, b in ranges))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *(r[1] for r in ranges)], [*(r[0] for r in ranges), len(text)], strict=True)))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(gone, SPAN_TYPE), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(cut, RESULT)
