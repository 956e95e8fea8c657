"""Quality classifier: a label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

Labellers vote keep (1), reject (0) or abstain (-1) on each document. The label model has an unknown class
for each document and, for each labeller and class, the chance of a vote to keep, if it votes; expectation-maximisation fits
them to the counts of vote patterns over all documents (at most 3^n patterns, whatever the input). The
posterior of each pattern labels a bounded sample of documents, on which a logistic model over hashed words,
word shapes and binned measures is fitted; it scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashed features; documents that the scorer is fitted on, at most (chosen by a hash of id and text).
DIMENSIONS, SAMPLE = 1 << 14, 6000
#: Remembered words of a task; words of a run whose variety is measured; the bits of a word's flags.
CACHE, RUN = 1 << 18, 500
FLAGS = np.array([1 << i for i in range(6)])

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it for on was as with be by at this are from or an not "
    b"der die und das den von zu mit sich des auf ist im dem ein eine nicht als auch "
    b"le la les de des et en un une du que qui dans est pour pas sur au "
    b"el los las y del se por con una para su al lo como".split()
)


class _Words(dict):
    """For each word, in the bits of one number: its hashed feature, its shape's, and flags (letters only, function word, marks only, odd marks, capitals, doubled mark)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.strip(".,;:!?\"'()«»¿¡")
        flags = core.isalpha() | (word.lower().strip(b".,;:!?") in FUNCTION_WORDS) << 1 | (len(core) >= 2 and core.isupper()) << 4
        flags |= (text[-2:-1] == text[-1:] and not text[-1:].isalnum()) << 5
        if flags & 1 and len(text) - len(core) <= 1:  # a plain word, with one mark at most
            kind = "a" if core.islower() else "A" if core.isupper() else "Aa" if core.istitle() else "aA"
            shape = kind + text[len(core) :] if text.startswith(core) else text[:1] + kind
        else:
            flags |= (not any(map(str.isalnum, text))) << 2 | (sum(not c.isalnum() and c not in ".,;:!?'\"-()" for c in text) >= 2) << 3
            shape = re.sub(r"(.)\1+", r"\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in text))
        feature, form = (xxhash.xxh64_intdigest(x) % DIMENSIONS for x in (b"w" + word.lower(), b"s" + shape.encode()))
        self[word] = value = feature << 40 | form << 16 | flags
        return value


@dataclass(frozen=True)
class Measures:
    """What the labellers look at; shares lie between 0 and 1."""

    words: int
    alpha: float
    function: float
    marks: float
    odd: float
    repeated: float
    distinct: float
    lines_again: float
    mean_length: float
    stops: float
    capitals: float
    doubled: float


def measure(text: bytes, known: _Words) -> tuple[Measures, np.ndarray]:
    """Measures of a text, and what is known of its words."""
    words = text.split()
    n = len(words)
    seen = np.fromiter(map(known.__getitem__, words), np.int64, n)
    if n == 0:
        return Measures(*[0] * 12), seen
    lines = [x for x in text.split(b"\n") if x.strip()]
    flags = np.bitwise_count(seen[:, None] & FLAGS).sum(axis=0) / n
    ids = seen >> 40
    repeated = float((ids[1:] == ids[:-1]).sum()) / n
    # distinct words of each run of RUN words, the last one shorter
    run = np.arange(n) // RUN
    pairs = np.sort(run << 16 | ids)
    distinct = float(np.mean(np.bincount(pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] >> 16) / np.bincount(run)))
    stops = sum(text.count(x) for x in (b".", b"!", b"?")) / n
    alpha, function, marks, odd, capitals, doubled = flags.tolist()
    return Measures(n, alpha, function, marks, odd, repeated, distinct, 1 - len(set(lines)) / len(lines), len(text) / n, min(1.0, stops), capitals, doubled), seen


def _vote(keep: bool, reject: bool) -> int:
    return 0 if reject else 1 if keep else -1


#: Each labeller sees the measures and says keep, reject or neither.
LABELLERS = {
    "letters": lambda m: _vote(m.alpha > 0.9, m.alpha < 0.6),
    "function_words": lambda m: _vote(m.function > 0.08, m.words > 30 and m.function < 0.02),
    "loose_marks": lambda m: _vote(m.words > 5 and m.marks < 0.02, m.marks > 0.2),
    "odd_words": lambda m: _vote(m.words > 5 and m.odd < 0.02, m.odd > 0.2),
    "capitals": lambda m: _vote(m.words > 5 and m.capitals < 0.1, m.words > 5 and m.capitals > 0.4),
    "doubled_marks": lambda m: _vote(m.words > 5 and m.doubled < 0.02, m.doubled > 0.2),
    "repeats": lambda m: _vote(m.words > 5 and m.repeated < 0.03, m.repeated > 0.2),
    "variety": lambda m: _vote(m.words > 30 and m.distinct > 0.35, m.words > 30 and m.distinct < 0.15),
    "lines": lambda m: _vote(False, m.lines_again > 0.5),
    "sentences": lambda m: _vote(m.words > 20 and 0.01 < m.stops < 0.5, m.words > 60 and m.stops < 0.003),
    "word_length": lambda m: _vote(3 <= m.mean_length <= 11, m.words > 5 and not 2 <= m.mean_length <= 20),
}


@cache
def _measure_feature(name: str) -> int:
    return xxhash.xxh64_intdigest(b"m" + name.encode()) % DIMENSIONS


def features(m: Measures, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a document's hashed features; words, shapes and measures have length one each."""
    places, weights = [], []
    for part in (seen >> 40, seen >> 16 & 0xFFFFFF):
        part = np.sort(part)
        heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        place, count = part[heads], np.diff(np.append(heads, len(part)))
        w = np.sqrt(count)
        places.append(place)
        weights.append(w / max(1.0, float(np.sqrt((w * w).sum()))))
    binned = [f"{k}{min(9, int(getattr(m, k) * 10))}" for k in ("alpha", "function", "marks", "odd", "repeated", "distinct", "lines_again", "stops", "capitals", "doubled")]
    binned += [f"length{min(20, int(m.mean_length))}", f"words{m.words.bit_length()}"]
    places.append(np.array([_measure_feature(x) for x in binned]))
    weights.append(np.full(len(binned), len(binned) ** -0.5))
    return np.concatenate(places).astype(np.int32), np.concatenate(weights).astype(np.float32)


def fit_label_model(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of kept documents, and chances [labeller, class, vote + 1], by expectation-maximisation.

    Starts from labellers that are right more often than not, so that class 1 is keep.
    """
    votes = np.array(list(patterns), np.int64).reshape(len(patterns), len(next(iter(patterns), LABELLERS)))
    count = np.array(list(patterns.values()), float)
    rejects, keeps = (votes == 0).sum(axis=1), (votes == 1).sum(axis=1)
    post = (keeps + 0.5) / (keeps + rejects + 1)
    post = np.where(rejects >= 2, 0.1, post)
    share, chances = 0.5, np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        share = float((count * post).sum() / max(1.0, count.sum())) if len(count) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        for j in range(votes.shape[1]):
            for c, w in ((0, count * (1 - post)), (1, count * post)):
                got = np.bincount(votes[:, j] + 1, weights=w, minlength=3) + 0.5
                chances[j, c] = got / got[1:].sum()
                chances[j, c, 0] = 1.0  # to abstain says nothing, so that short texts don't count as odd
        new = posterior(votes, share, chances)
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return share, chances


def posterior(votes: np.ndarray, share: float, chances: np.ndarray) -> np.ndarray:
    """Chance that a document with these votes is to be kept."""
    odds = np.full(len(votes), np.log(share / (1 - share)))
    for j in range(votes.shape[1]):
        odds += np.log(chances[j, 1, votes[:, j] + 1] / chances[j, 0, votes[:, j] + 1])
    return 1 / (1 + np.exp(-odds))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights (the last is the bias) by adaptive gradient steps over small groups of documents."""
    weights, past = np.zeros(DIMENSIONS + 1, np.float64), np.full(DIMENSIONS + 1, 1e-6)
    order = np.random.default_rng(0)
    for _ in range(rounds if rows else 0):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), 32):
            group = [rows[i] for i in shuffled[at : at + 32]]
            places = np.concatenate([p for p, _, _ in group])
            values = np.concatenate([v for _, v, _ in group]).astype(np.float64)
            owner = np.repeat(np.arange(len(group)), [len(p) for p, _, _ in group])
            z = np.bincount(owner, weights=weights[places] * values, minlength=len(group)) + weights[-1]
            off = 1 / (1 + np.exp(-z)) - np.array([y for *_, y in group])
            step = np.bincount(places, weights=off[owner] * values, minlength=DIMENSIONS + 1) / len(group)
            step[-1] = off.mean()
            step += decay * weights
            past += step * step
            weights -= rate * step / np.sqrt(past)
    return weights


@dataclass(frozen=True)
class Model:
    share: float
    chances: np.ndarray
    weights: np.ndarray


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on all documents' vote patterns, and the scorer on at most ``sample`` documents' posteriors.

    The sample is the documents with the least hashes of id and text, so it doesn't depend on how the table is cut.
    """
    names = list(LABELLERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        counts: dict[str, int] = {}
        for batch in common.slices(batches, "text"):
            for text in common.binary_column(batch, "text"):
                m, _ = measure(text, cache)
                votes = ",".join(str(LABELLERS[k](m)) for k in names)
                counts[votes] = counts.get(votes, 0) + 1
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["votes", "n"])

    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("order"))
    found = texts.select("text").mapInArrow(run, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # at most 3^labellers rows
    share, chances = fit_label_model({tuple(map(int, r["votes"].split(","))): r["n"] for r in found})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in common.slices(batches, "text"):
            places, weights, labels = [], [], []
            for text in common.binary_column(batch, "text"):
                m, seen = measure(text, cache)
                p, w = features(m, seen)
                places.append(p.tobytes()), weights.append(w.astype(np.float16).tobytes())
                labels.append(float(posterior(np.array([[LABELLERS[k](m) for k in names]]), share, chances)[0]))
            yield pa.record_batch([pa.array(places, pa.binary()), pa.array(weights, pa.binary()), pa.array(labels, pa.float64()), batch.column(1)], ["places", "weights", "label", "order"])

    total = sum(r["n"] for r in found)
    part = min(1.0, 1.5 * sample / max(1, total))  # hashes below this are enough for the sample, or all
    low = F.lit(min(2**63 - 1, int(-(2**63) + part * 2**64)))
    chosen = texts.where(F.col("order") <= low).mapInArrow(look, "places binary, weights binary, label double, order long")
    rows = chosen.orderBy("order", "label").limit(sample).collect()  # at most sample rows
    return Model(share, chances, fit_scorer([(np.frombuffer(r["places"], np.int32), np.frombuffer(r["weights"], np.float16), r["label"]) for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, posterior, score, keep) for each row: the label model's and the scorer's chance to keep.

    Null and empty texts have no words and are rejected: score and posterior are 0. A null id stays null,
    repeated rows each get a row, and other columns are not read.
    """
    names, shared = list(LABELLERS), docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, own = _Words(), shared.value
        for batch in common.slices(batches, "text"):
            n, weak, strong = [], [], []
            for text in common.binary_column(batch, "text"):
                m, seen = measure(text, cache)
                n.append(m.words)
                if m.words == 0:
                    weak.append(0.0), strong.append(0.0)
                    continue
                weak.append(float(posterior(np.array([[LABELLERS[k](m) for k in names]]), own.share, own.chances)[0]))
                p, w = features(m, seen)
                strong.append(float(1 / (1 + np.exp(-(own.weights[p] @ w + own.weights[-1])))))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(weak, pa.float64()), pa.array(strong, pa.float64()), pa.array([s >= threshold for s in strong], pa.bool_())],
                ["doc_id", "n_words", "posterior", "score", "keep"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, posterior double, score double, keep boolean")


def filtered(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts the scorer keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, own = _Words(), shared.value
        for batch in common.slices(batches, text_col):
            keep = []
            for text in common.binary_column(batch, text_col):
                m, seen = measure(text, cache)
                p, w = features(m, seen)
                keep.append(m.words > 0 and own.weights[p] @ w + own.weights[-1] >= np.log(threshold / (1 - threshold)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
