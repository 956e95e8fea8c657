"""Chat formatting: token-level assembly of conversations with reserved ids and a loss mask.

Each turn is ``[INST]`` role ``[/INST]`` text ``</s>``, after one ``<s>``. Role and text are encoded apart
from each other and from the control strings, whose ids are reserved beyond the vocabulary and spliced in
between; so no text can make a control id. In the text form, a control string that occurs in a role or
text gets a backslash after its first character (one more if it has some already), which undoes exactly.
The loss mask is a running sum of +1 where an assistant's text begins and -1 where it ends.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The byte-pair vocabulary's pattern of pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@dataclass(frozen=True)
class Template:
    """Control strings; the first character of each occurs in no other place of any of them."""

    begin: str = "<s>"
    role: str = "[INST]"
    text: str = "[/INST]"
    end: str = "</s>"
    learn: str = "assistant"

    def __post_init__(self) -> None:
        firsts = {c[0] for c in self.controls}
        if any(x in firsts or x == "\\" for c in self.controls for x in c[1:]) or "\\" in firsts or min(map(len, self.controls)) < 2:
            raise ValueError("a control string's first character must occur nowhere else in them, nor may a backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.begin, self.role, self.text, self.end

    @property
    def occurs(self) -> re.Pattern:
        return re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in self.controls))

    def escape(self, text: str) -> str:
        return self.occurs.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.occurs.sub(lambda m: m[0][0] + (m[0][2:] if m[0][1] == "\\" else m[0][1:]), text)


class Encoder:
    """Byte-level vocabulary from a rank file, with the control strings' ids after its own."""

    def __init__(self, ranks_file: str, template: Template):
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.template = template
        self.first = max(ranks.values()) + 1
        self.begin, self.role, self.text, self.end = range(self.first, self.first + 4)

    def segment(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(self.template.escape(text))

    def plain(self, ids: list[int]) -> str:
        return self.bpe.decode_bytes(ids).decode()

    def formatted(self, ids: np.ndarray) -> str:
        """Text form of token ids, control strings included."""
        out, at = [], 0
        for i in np.flatnonzero(ids >= self.first).tolist():
            out += [self.plain(ids[at:i].tolist()), self.template.controls[ids[i] - self.first]]
            at = i + 1
        return "".join([*out, self.plain(ids[at:].tolist())])


_held: dict[tuple[str, Template], Encoder] = {}


def encoder(ranks_file: str, template: Template) -> Encoder:
    key = (ranks_file, template)
    if key not in _held:
        _held[key] = Encoder(ranks_file, template)
    return _held[key]


PARTS = "conv_id long, part long, offset long, ids array<int>, loss_mask array<byte>, formatted string"


def encoded_turns(turns: DataFrame, ranks_file: str, template: Template = Template()) -> DataFrame:
    """Each turn's tokens, control ids included, as 4-byte numbers; null role and text are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file, template)
        for batch in common.slices(batches, "text"):
            ids = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ids.append(np.array([enc.role, *enc.segment(role or ""), enc.text, *enc.segment(text or ""), enc.end], np.int32).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(ids, pa.binary())], ["conv_id", "turn", "role", "text", "ids"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary")


def assembled(turns: DataFrame, ranks_file: str, template: Template = Template()) -> DataFrame:
    """The token stream of each conversation, one row for each turn.

    Returns conv_id, part (0, 1, ... within the conversation), offset (of the row's first token in the
    conversation), ids, loss_mask (one 0/1 for each id) and formatted (the text form). A conversation's
    sequence is its rows' ids in order of part; rows stay apart so that no conversation has to fit in
    one value. Turns are ordered by turn, then role, then text, nulls first; repeated rows stay. Turns
    without conv_id are one conversation without id. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file, template)
        learn = enc.segment(template.learn)
        held: object = run  # no conversation yet
        part = offset = 0
        for batch in common.slices(batches, "ids", 1 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for conv, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, np.int32)
                if conv != held or part == 0:
                    held, part, offset = conv, 0, 0
                    ids = np.concatenate(([enc.begin], ids)).astype(np.int32)
                marks = np.zeros(len(ids) + 1, np.int8)
                opens, middle = int(np.flatnonzero(ids == enc.role)[0]), int(np.flatnonzero(ids == enc.text)[0])
                if ids[opens + 1 : middle].tolist() == learn:
                    marks[middle + 1] += 1
                    marks[len(ids) - 1] -= 1
                for column, value in zip(out, (conv, part, offset, ids, np.cumsum(marks[:-1], dtype=np.int8), enc.formatted(ids)), strict=True):
                    column.append(value)
                part, offset = part + 1, offset + len(ids)
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.list_(pa.int8())), pa.array(out[5], pa.string())],
                ["conv_id", "part", "offset", "ids", "loss_mask", "formatted"],
            )

    rows = encoded_turns(turns, ranks_file, template)
    rows = rows.repartition(common.partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "ids").mapInArrow(run, PARTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def digests(parts: DataFrame, ranks_file: str, template: Template = Template()) -> DataFrame:
    """Read conversations back from what assembled() returns: one row for each, hashed as a stream.

    Roles and texts come from the text form, the learnt text from the ids under the loss mask.
    """
    shape = re.compile(f"(?:{re.escape(template.begin)})?{re.escape(template.role)}(.*){re.escape(template.text)}(.*){re.escape(template.end)}", re.S)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file, template)
        now: list | None = None

        def row(state: list) -> pa.RecordBatch:
            conv, turns, said, chars, learnt, formatted, tokens = state
            values = (conv, turns, said.hexdigest(), chars, learnt.hexdigest(), formatted, tokens)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        for batch in batches:
            done = []
            for conv, part, ids, mask, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if part == 0:
                    done += [row(now)] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, said = map(template.unescape, shape.fullmatch(text).groups())
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
                learnt = template.unescape(enc.plain([i for i, m in zip(ids, mask, strict=True) if m]))
                now[3] += len(learnt)
                now[4].update(learnt.encode())
                now[5] += len(text)
                now[6] += len(ids)
            if done:
                yield pa.record_batch([pa.concat_arrays(x) for x in zip(*done, strict=True)], names)
        if now:
            yield pa.record_batch(row(now), names)

    # parts come from assembled() as they are: each conversation's rows in order, in one partition
    return parts.mapInArrow(run, DIGEST)
