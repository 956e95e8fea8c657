import hashlib
import random

import public_tokenizers
import sentencepiece

from skirmish.llm import sentencepiece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_equal_the_library_on_random_texts():
    enc, rng = sentencepiece_bpe.PrefixEncoder(MODEL), random.Random(5)
    pieces = list(enc.id_of)
    for k in range(3000):
        text = "".join(rng.choices("  \n▁abceé日本aa###  ||\0\t0123", k=rng.randrange(40))) if k % 2 else "".join(rng.choices(pieces, k=rng.randrange(8)))
        assert enc.encode(text)[0].tolist() == enc.library.encode(text), text


def test_uncut_model_gives_the_same_ids():
    enc = sentencepiece_bpe.PrefixEncoder(MODEL)
    text = "Some words, and more\nwords  here"
    cut = enc.encode(text)[0].tolist()
    enc.cuts = False
    assert enc.encode(text)[0].tolist() == cut


def test_round_trip_query_rows(spark):
    long = "ab" * 30_000 + " " + "word " * 20_000
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (2, None), (3, ""), (None, "x"), (4, long)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def expected(doc_id, text):
        ids = lib.encode(text or "")
        return doc_id or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()

    got = sentencepiece_bpe.round_trip(df, MODEL).collect()
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted(expected(*r) for r in rows)
    ids = sentencepiece_bpe.encode(df, MODEL)
    back = {(r.doc_id, r.text) for r in sentencepiece_bpe.decode(ids, MODEL).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert sentencepiece_bpe.round_trip(df.limit(0), MODEL).count() == 0


def test_letters_and_marks_that_no_piece_joins_are_chunks_of_their_own():
    enc = sentencepiece_bpe.PrefixEncoder(MODEL)
    assert enc.split("▁word,▁(more)\n▁,x") == ["▁word", ",", "▁(", "more", ")", "\n", "▁,", "x"]
    assert enc.marks({"a,", "x.", ".c", "!?"}) == ({"!", "?"}, {",", "!", "?"})
    for text in ["word, (more)\n ,x", "it's p.m. a.com,b", "é,è (日本)!? x_y_"]:
        assert enc.encode(text)[0].tolist() == enc.library.encode(text), text
