import hashlib
import random

import public_tokenizers
import pytest

from skirmish.llm import chat

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string, ids string"


def test_escape_is_reversible_and_leaves_no_control_string():
    t, rng = chat.Template(), random.Random(2)
    for _ in range(3000):
        x = "".join(rng.choices(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "s>", "é", "[", "x"], k=rng.randrange(12)))
        y = t.escape(x)
        assert t.unescape(y) == x and not any(c in y for c in t.controls)
    with pytest.raises(ValueError):
        chat.Template(end="<<s>")


def test_digests_of_nulls_repeats_long_texts_and_control_strings(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a" * 50_000 + "<"), (1, 2, "assistant", "\\/s> </s>"), (1, 2, "assistant", "\\/s> </s>"), (2, 0, None, None), (3, 0, "[INST]", ""), (3, None, "assistant", "é\n")]
    turns += [(None, 0, "assistant", "lost"), (4, 0, "assistant", "")]
    rows = [(*t, "clash") for t in turns]
    parts = chat.assembled(spark.createDataFrame(rows, SCHEMA), RANKS)
    got = {r.conv_id: r for r in chat.digests(parts, RANKS).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        learnt = "".join(x for *_, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    seen = sorted(parts.collect(), key=lambda r: (r.conv_id or 0, r.part))
    for a, b in zip(seen, seen[1:]):
        assert b.offset == (a.offset + len(a.ids) if a.conv_id == b.conv_id else 0)
    assert all(len(r.ids) == len(r.loss_mask) for r in seen)
    assert chat.digests(chat.assembled(spark.createDataFrame([], SCHEMA), RANKS), RANKS).count() == 0
