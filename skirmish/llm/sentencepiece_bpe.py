"""SentencePiece BPE encoding by the unique last token of each prefix.

A text's BPE tokens are those of its prefixes cut back: every prefix has one BPE segmentation, and its
last token is the one suffix token t for which the segmentation of the prefix before t ends in a token
that stays apart from t (the two tokens' joint text encodes to just the two). A table holds that last
token for each prefix, filled from the tokens an Aho-Corasick automaton reports at each end and from pair
tests; the ids are then read backwards from the end.

Texts are first cut where no merge can cross: between two characters that stand side by side in no
piece. For the usual vocabularies that is before each word's space mark and between letters and punctuation,
and repeated chunks are remembered in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Chunks, and pairs of tokens, that a worker remembers; the table starts anew when full.
CHUNKS, PAIRS = 400_000, 400_000


class PrefixEncoder:
    """Encoder for one BPE model; gives the ids that the library's encode() gives."""

    def __init__(self, model_file: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = size = sp.get_piece_size()
        self.merges = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in self.merges}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in self.merges}
        self.byte_of = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.text_of = {i: p for p, i in self.id_of.items()}
        inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.cuts = not any(x[1:] == SPACE and x[0] != SPACE or "\n" in x for x in inside | set(self.id_of))
        after, before = self.marks(inside)
        runs, kinds = [f"[^{SPACE}\n]+"], lambda found: "".join(map(re.escape, sorted(found)))
        if both := kinds(after & before):  # runs of marks that end where a letter begins; else all up to the next space mark
            runs.insert(0, rf"[{both}]++(?=[^\W_]|[{SPACE}\n]|\Z)")
        if after:  # and runs of letters that end where a mark begins
            runs.insert(0, rf"[^\W_]++(?=[{kinds(after)}{SPACE}\n]|\Z)")
        self.split = re.compile("|".join([f"{SPACE}+(?:{'|'.join(runs)})?", *runs, "\n+"])).findall
        self.decimal = [b"%d," % i for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if len(self.merged(piece)) == 1:  # else no text encodes to this piece
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.length = [len(self.text_of.get(i, "")) for i in range(size)]
        self.ids: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def marks(inside: set[str]) -> tuple[set[str], set[str]]:
        """Characters, none of them letters or digits, that no piece has right after a letter or digit; and those that none has right before one."""
        own = {c for c in "".join(inside) if not (c.isalnum() or c in f"{SPACE}\n_")}
        return own - {x[1] for x in inside if x[0].isalnum()}, own - {x[0] for x in inside if x[1].isalnum()}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the best-scored adjacent pair, the leftmost of equals, until none is a piece.

        Only for the text of one or two tokens.
        """
        parts, score = list(text), self.score.get
        worth = [score(x + y) for x, y in itertools.pairwise(parts)]
        while True:
            best, at = None, -1
            for i, w in enumerate(worth):
                if w is not None and (best is None or w > best):
                    best, at = w, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del worth[at]
            if at:
                worth[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(worth):
                worth[at] = score(parts[at] + parts[at + 1])

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay two tokens when their texts meet."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        x, y = self.text_of[a], self.text_of[b]
        apart = self.pairs[a * self.size + b] = self.merged(x + y) == [x, y]
        return apart

    def prefix_tokens(self, text: str) -> list[int]:
        """Last token of each prefix, by the character it ends at; -1 where that is a character outside the vocabulary.

        The automaton reports the tokens that end at a character, longest first.
        """
        last, known, test, length, size = [-1] * len(text), self.pairs.get, self.compatible, self.length, self.size
        for end, i in self.automaton.iter(text):
            if last[end] < 0:
                start = end - length[i]
                if start < 0 or (before := last[start]) < 0:
                    last[end] = i
                elif (apart := known(before * size + i)) or apart is None and test(before, i):
                    last[end] = i
        return last

    def tokens(self, text: str, last: list[int], low: int, high: int) -> list[int]:
        """Ids of text[low:high], which no token crosses the ends of, read backwards from the table."""
        ids, end = [], high - 1
        while end >= low:
            if (i := last[end]) >= 0:
                ids.append(i)
                end -= self.length[i]
            else:
                ids += [self.byte_of[x] for x in reversed(text[end].encode())] if self.byte_of else [self.unknown]
                end -= 1
        ids.reverse()
        return ids

    def encode(self, text: str) -> tuple[np.ndarray, bytes]:
        """Ids, and the ids in decimal with a comma after each."""
        if not text:
            return np.zeros(0, np.int32), b""
        text = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            ids = self.tokens(text, self.prefix_tokens(text), 0, len(text))
            return np.array(ids, np.int32), b"".join(map(self.decimal.__getitem__, ids))
        chunks, held = self.split(text), self.ids
        if len(held) >= CHUNKS:
            held.clear()
        new = list(set(chunks).difference(held))
        if new:
            joined, at = "\n".join(new), 0
            last = self.prefix_tokens(joined)
            for chunk in new:
                ids = self.tokens(joined, last, at, at + len(chunk))
                held[chunk] = pack(f"{len(ids)}i", *ids)
                at += len(chunk) + 1
        ids = np.frombuffer(b"".join(map(held.__getitem__, chunks)), np.int32)
        if len(text) > 1 << 20:  # a very long text may bring very many chunks
            held.clear()
        return ids, b"".join(map(self.decimal.__getitem__, ids.tolist()))

    def forget(self) -> None:
        """Let the chunks go, at the end of a task: a worker that idles or does other work holds no memory for them."""
        self.ids.clear()

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_held: dict[str, PrefixEncoder] = {}


def encoder(model_file: str) -> PrefixEncoder:
    """The worker's encoder for a model file, made once."""
    if model_file not in _held:
        _held[model_file] = PrefixEncoder(model_file)
    return _held[model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row. Null text is empty and has no ids; rows stay as they are, repeats too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for batch in common.slices(batches, "text"):
            ids = [enc.encode(t or "")[0] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        enc.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for batch in batches:
            texts = [enc.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each row in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    One row for each row of ``docs``, in any order; null text is empty. A null id stays null. Other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for batch in common.slices(batches, "text"):
            n, a, b, all_ids = [], [], [], []
            for t in batch.column(1).to_pylist():
                ids, said = enc.encode(t or "")
                n.append(len(ids))
                a.append(hashlib.sha256(said[:-1]).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                all_ids.append(ids if with_ids else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(all_ids, pa.list_(pa.int32()))]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
        enc.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGEST).drop(*() if with_ids else ("ids",))
