"""Phrases of two to four words that stick together, by best-first branch and bound over prefixes.

A phrase's score is that of its worst cut, so for any phrase that begins with p it is at most that of a count of p
against its first word: the count of a prefix bounds all that grows from it. Words and pairs are counted once. Then each
language expands its prefixes in order of their bounds, a batch at a time: all those whose bound reaches a floor, taken from the
scores of the pairs. Phrases found at or above the floor are whole, as no other prefix can give one. A language whose survivors
there are enough is settled, ties included; the others lower their floor, down to 0.

A word is a 64-bit number of its language and bytes. That no two words share one is checked, else they are numbered anew. Each
count reads the texts again; tasks add up what they have read, and fixed-size filters spare them phrases that nothing asked for, so
a count is whole for every phrase that it has.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes that end a piece, and bytes between the words of one.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.array([2 if c in BREAKS else 1 if c in SPACES else 0 for c in range(256)], np.uint8)
_GAP = re.compile(b"[" + re.escape(BREAKS + SPACES) + b"]")
#: Bytes that are cut into words at a time, and phrases that a task adds up at a time.
CHUNK, BUFFER = 1 << 20, 1 << 18
#: Bits of a filter: 4 MB, whatever the input.
FILTER_BITS = 1 << 25
#: Pairs above a language's first floor, for each phrase asked for, and how much lower each further floor goes.
AHEAD, FURTHER = 2, 8
#: Languages whose floors are broadcast; more are joined, and Spark splits the skew.
LANGUAGES = 1 << 14
#: A score counts in parts of this.
SCALE = 2_000_000


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hash of the phrases whose first, second, ... words are given."""
    h = np.full(len(words[0]), np.uint64(len(words)))
    for x in words:
        h = h * np.uint64(0x9E3779B97F4A7C15) + x
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on."""
    n = max(0, len(numbers) - size + 1)
    return phrase_hash([numbers[i : i + n] for i in range(size)])


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            powers = lambda b: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))))
            self.up, self.down = powers(self.base), powers(self.inverse)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hash of data[start:end] for each pair."""
        self.reach(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])))
        return (sums[ends] - sums[starts]) * self.down[starts]


def chunks(data: bytes) -> Iterator[bytes]:
    """data in parts of about CHUNK bytes, cut before a byte that is in no word."""
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + CHUNK)
        stop = gap.start() if gap else len(data)
        yield data[start:stop]
        start = stop


class Cutter:
    """Numbers of the words of texts, and whether a word follows the one before in the same piece."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.seed = seed
        self.powers, self.others = (Powers(int(x) | 1) for x in rng.integers(1 << 62, 1 << 63, 2, np.uint64))

    def words(self, data: bytes, lang: str, check: bool = False) -> Iterator[tuple]:
        """(chunk, starts, ends, numbers, glued, second hash if asked for) of each chunk of lower-cased data."""
        own, glue = np.uint64(xxhash.xxh64_intdigest(lang.encode(), self.seed)), False
        for chunk in chunks(data):
            values = np.frombuffer(chunk, np.uint8)
            kind = KIND[values]
            edge = np.diff((kind == 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            breaks = np.concatenate((np.zeros(1, np.int64), np.cumsum(kind == 2)))
            if len(starts) == 0:
                glue = glue and breaks[-1] == 0
                continue
            glued = breaks[starts] == np.concatenate(([0 if glue else -1], breaks[ends[:-1]]))
            glue = breaks[-1] == breaks[ends[-1]]
            numbers = phrase_hash([self.powers.hashes(values, starts, ends), (ends - starts).astype(np.uint64) ^ own])
            yield chunk, starts, ends, numbers, glued, self.others.hashes(values, starts, ends) if check else None


def texts_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, its texts of a slice, lower-cased, each ended by a line feed) of batches (lang, text)."""
    for batch in batches:
        at, ends = 0, np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:  # only a slice becomes Python's bytes at a time
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            part, at = batch.slice(at, stop - at), stop
            found: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), common.binary_column(part, "text"), strict=True):
                found.setdefault(lang, []).append(text)
            for lang, texts in found.items():
                yield lang, (b"\n".join(texts) + b"\n").translate(common.LOWER)


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, n) of all words; a row without word says that two words share a number."""
    cutter = Cutter(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in texts_by_language(batches):
            for chunk, starts, ends, numbers, _, other in cutter.words(data, lang, check=True):
                ids, first, back, n = np.unique(numbers, return_index=True, return_inverse=True, return_counts=True)
                words = [chunk[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                if (other != other[first][back]).any():
                    ids, words, n = np.append(ids, np.uint64(0)), [*words, None], np.append(n, 0)
                yield pa.record_batch([pa.array([lang] * len(ids)), pa.array(words, pa.binary()), pa.array(ids.view(np.int64)), pa.array(n)], ["lang", "word", "id", "n"])

    found = docs.mapInArrow(run, "lang string, word binary, id long, n long")
    return found.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")).withColumn("word", F.col("word").cast("string"))


def gram_columns(size: int) -> list[str]:
    return [f"w{i}" for i in range(size)]


def counted(docs: DataFrame, seed: int, size: int, wanted: Callable[[np.ndarray], np.ndarray], least: int) -> DataFrame:
    """(w0, w1, ..., a): phrases of ``size`` words that ``wanted`` keeps, with their counts from ``least`` on.

    ``wanted`` gets the numbers of consecutive words and says of each place whether the phrase that begins there counts; its answer
    depends on the phrase alone.
    """
    cutter, names = Cutter(seed), gram_columns(size)

    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts, axis=1)
        parts.clear()  # what is added up isn't held twice
        rows = rows[:, np.argsort(phrase_hash(list(rows)), kind="stable")]  # equal phrases side by side; of two that share the hash, a few rows more are sent
        at = np.concatenate(([0], np.flatnonzero((rows[:, 1:] != rows[:, :-1]).any(0)) + 1, [rows.shape[1]]))
        return pa.record_batch([*(pa.array(x.view(np.int64)) for x in rows[:, at[:-1]]), pa.array(np.diff(at))], [*names, "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for lang, data in texts_by_language(batches):
            before, joined = np.zeros(0, np.uint64), np.zeros(0, bool)
            for _, _, _, numbers, glued, _ in cutter.words(data, lang):
                numbers, glued = np.concatenate((before, numbers)), np.concatenate((joined, glued))
                before, joined = numbers[len(numbers) - size + 1 :] if len(numbers) >= size else numbers, glued[len(glued) - size + 1 :] if len(glued) >= size else glued
                n = len(numbers) - size + 1
                if n <= 0:
                    continue
                whole = np.logical_and.reduce([glued[i : i + n] for i in range(1, size)])
                at = np.flatnonzero(whole & wanted(numbers))
                parts.append(np.stack([numbers[at + i] for i in range(size)]))
                held += len(at)
                if held >= BUFFER:
                    yield summed(parts)
                    held = 0
        if held:
            yield summed(parts)

    # tasks have added up what they read, so rows go to their phrase's task as they are
    rows = docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "a"])).repartition(*names)
    return rows.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def phrase_filter(phrases: DataFrame, size: int) -> np.ndarray:
    """A fixed-size filter of phrases (w0, w1, ...)."""
    names = gram_columns(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = phrase_hash([batch.column(i).to_numpy().view(np.uint64) for i in range(size)])
            yield pa.record_batch([pa.array(hashes.view(np.int64))], ["h"])

    return common.bit_filter(phrases.select(*names).mapInArrow(run, "h long"), FILTER_BITS)


def floor_rate(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)), in decimals: the product may pass 64 bits."""
    return F.expr(f"cast({SCALE} as decimal(7,0)) * cast({a} as decimal(20,0)) div (cast({l} as decimal(20,0)) + cast({r} as decimal(20,0)))")


def scored(phrases: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """phrases with l, r and score of their worst cut (least score, then fewest words before it) and the bound of what begins with them."""
    each = F.array(*[F.struct(floor_rate("a", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate(cuts)])
    rows = phrases.withColumn("worst", F.array_min(each)).withColumn("bound", floor_rate("a", cuts[0][0], "a"))
    return rows.withColumns({c: F.col(f"worst.{c}") for c in ("score", "l", "r")}).drop("worst")


def floors(pairs: DataFrame, most: int) -> DataFrame:
    """(lang, floor): the score that ``most`` pairs of a language reach, or 0; from counts of each score, at most SCALE / 2 + 1 a language."""
    counts = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))
    above = counts.withColumn("above", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score"))))
    return above.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= most, F.col("score"))), F.lit(0)).alias("floor"))


def surviving(phrases: DataFrame, longer: DataFrame, size: int, share: int) -> DataFrame:
    """phrases of ``size`` words without those inside one of one more word that has ``share`` hundredths of their count or more.

    A still longer phrase has no more occurrences than its parts of one more word, so these decide.
    """
    names = gram_columns(size)
    ends = [longer.select(*[F.col(f"w{i + j}").alias(f"w{i}") for i in range(size)], F.col("a").alias("x")) for j in (0, 1)]
    most = ends[0].unionByName(ends[1]).groupBy(*names).agg(F.max("x").alias("x"))
    kept = F.col("x").isNull() | (F.col("x").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share)
    return phrases.join(most, names, "left").where(kept).drop("x")


def _joined(rows: DataFrame, other: DataFrame, at: int, size: int, take: dict[str, str], how: str = "inner") -> DataFrame:
    """rows with columns of ``other``'s phrase of ``size`` words that stands at word ``at``."""
    names = [f"w{at + i}" for i in range(size)]
    return rows.join(other.select(*[F.col(f"w{i}").alias(n) for i, n in enumerate(names)], *[F.col(a).alias(b) for a, b in take.items()]), names, how)


def of_languages(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined by language with a table of one row a language, which is broadcast if these are at most LANGUAGES."""
    return rows.join(F.broadcast(table) if table.count() <= LANGUAGES else table, "lang", how)


def expanded(docs: DataFrame, seed: int, pairs: DataFrame, least: int, share: int) -> DataFrame:
    """(lang, w0 ... w3, a, l, r, score): all surviving phrases whose score reaches their language's floor.

    ``pairs`` has all pairs of the languages at hand, scored, with their floor.
    """
    with ExitStack() as held:
        table = lambda df: held.enter_context(common.written(df))
        pairs = table(pairs)
        good = pairs.where("score >= floor")
        every, grow, end = phrase_filter(pairs, 2), phrase_filter(pairs.where("bound >= floor"), 2), phrase_filter(good, 2)

        def three(numbers: np.ndarray) -> np.ndarray:
            h = run_hashes(numbers, 2)
            known = common.passes(every, h)
            return known[:-1] & known[1:] & (common.passes(grow, h[:-1]) | common.passes(end, h[1:]))

        found = counted(docs, seed, 3, three, least)
        found = _joined(found, pairs, 0, 2, {"lang": "lang", "floor": "floor", "l": "f0", "a": "f01"})
        triples = table(scored(_joined(found, pairs, 1, 2, {"a": "f12", "r": "f2"}), [("f0", "f12"), ("f01", "f2")]))
        good3 = triples.where("score >= floor")
        grow3, end3 = phrase_filter(triples.where("bound >= floor"), 3), phrase_filter(good3, 3)

        def four(numbers: np.ndarray) -> np.ndarray:
            h, known = run_hashes(numbers, 3), common.passes(every, run_hashes(numbers, 2))
            return known[:-2] & known[1:-1] & known[2:] & (common.passes(grow3, h[:-1]) | common.passes(end3, h[1:]))

        quads = table(counted(docs, seed, 4, four, least))
        own = _joined(quads, triples.where("bound >= floor"), 0, 3, {"lang": "lang", "floor": "floor", "f0": "f0", "f01": "f01", "a": "f012"})
        own = _joined(own, pairs, 2, 2, {"a": "f23", "r": "f3"})
        own = own.where(floor_rate("a", "f01", "f23") >= F.col("floor")).where(floor_rate("a", "f012", "f3") >= F.col("floor"))
        own = table(_joined(own, triples, 1, 3, {"a": "f123"}, "left"))
        missing = table(own.where("f123 IS NULL").select(*[F.col(f"w{i + 1}").alias(f"w{i}") for i in range(3)]).distinct())
        if not missing.isEmpty():  # ends that no prefix above the floor gave
            asked = phrase_filter(missing, 3)
            more = counted(docs, seed, 3, lambda numbers: common.passes(asked, run_hashes(numbers, 3)), least)
            own = _joined(own, more, 1, 3, {"a": "g123"}, "left").withColumn("f123", F.coalesce("f123", "g123"))
        good4 = scored(own, [("f0", "f123"), ("f01", "f23"), ("f012", "f3")]).where("score >= floor")
        none = lambda c: F.lit(None).cast("long").alias(c)
        tail = ["lang", "a", "l", "r", "score", "floor"]
        return common.checkpoint(
            surviving(good, triples, 2, share).select("w0", "w1", none("w2"), none("w3"), *tail)
            .unionByName(surviving(good3, quads, 3, share).select("w0", "w1", "w2", none("w3"), *tail))
            .unionByName(good4.select(*gram_columns(4), *tail))
        )


def mined(docs: DataFrame, most: int = 2000, least: int = 30, share: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases by score, then count, then bytes.

    Words are lower-cased (A-Z only) and stand between blanks and tabs, within pieces between ``.,;:!?`` and ends of lines. a counts the
    phrase, l and r what is before and after the worst cut, n all words of the language. Phrases of two to four words that occur
    ``least`` times or more are candidates; those inside a longer candidate of at least ``share`` hundredths of their count go. Null language
    is ``und``, null text has no words, repeated rows count each time, further columns don't matter, and an empty table gives no rows.
    """
    docs = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    with ExitStack() as held:
        for seed in count():
            with ExitStack() as own:
                words = own.enter_context(common.written(vocabulary(docs, seed)))
                clash = words.groupBy("id").agg(F.count("*").alias("n"), F.count("word").alias("words")).where("n > 1 OR words = 0")
                if clash.isEmpty():
                    held.enter_context(own.pop_all())
                    break
        total = words.groupBy("lang").agg(F.sum("n").alias("n"))
        known = words.where(F.col("n") >= least)
        frequent = common.bit_filter(known.select("id"), FILTER_BITS)

        def two(numbers: np.ndarray) -> np.ndarray:
            good = common.passes(frequent, numbers)
            return good[:-1] & good[1:]

        ids = lambda c, n: known.select(F.col("id").alias(c), F.col("n").alias(n))
        pairs = counted(docs, seed, 2, two, least).join(known.select(F.col("id").alias("w0"), "lang", F.col("n").alias("f0")), "w0").join(ids("w1", "f1"), "w1")
        pairs = held.enter_context(common.written(scored(pairs, [("f0", "f1")])))
        found, open_pairs, ahead = None, pairs, AHEAD * most
        while True:
            floor = common.checkpoint(floors(open_pairs, ahead))
            new = expanded(docs, seed, of_languages(open_pairs, floor), least, share)
            enough = new.groupBy("lang").agg(F.count("*").alias("n"))
            settled = common.checkpoint(floor.join(enough, "lang", "left").where((F.col("floor") == 0) | (F.col("n") >= most)).select("lang"))
            new = of_languages(new, settled, "left_semi")
            found = new if found is None else found.unionByName(new)
            left = common.checkpoint(floor.join(settled, "lang", "left_anti").select("lang"))
            if left.isEmpty():
                break
            open_pairs, ahead = common.checkpoint(of_languages(open_pairs, left, "left_semi")), ahead * FURTHER
        spelled = found
        for i in range(4):
            spelled = spelled.join(known.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}", "left")
        spelled = spelled.withColumn("phrase", F.concat_ws(" ", *[f"word{i}" for i in range(4)]))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        first = spelled.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
        return common.checkpoint(first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
