import random
import re

from skirmish.llm import licenses

SCHEMA = "doc_id long, text string, coverage string"


def whole_alignment(doc, template):
    """Most matched words of any local alignment, without a band."""
    best, rows = (0, 0), [[(0, 0)] * (len(doc) + 1)]
    for t in template:
        row = [(0, 0)]
        for j, d in enumerate(doc, 1):
            diag = rows[-1][j - 1]
            options = [(diag[0] + 2, diag[1] + 1)] if d == t else [(diag[0] - 1, diag[1])]
            options += [(x[0] - 1, x[1]) for x in (rows[-1][j], row[j - 1])]
            row.append(max([o for o in options if o[0] > 0], default=(0, 0)))
        rows.append(row)
        best = max(best, *row)
    return best[1]


def test_banded_alignment_equals_the_whole_one_and_spans_are_places(spark):
    rng = random.Random(9)
    noise = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "été"]) for _ in range(n))
    rows, expected = [], {}
    for k, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        words = text.split()
        for change in (0, 1):
            own = list(words)
            if change and len(own) > 30:
                for _ in range(3):
                    own[rng.randrange(len(own))] = "changed"
                own.insert(len(own) // 2, "added")
            doc_id = 10 * k + change
            rows.append((doc_id, f"{noise(20)}\n{' '.join(own)}\n{noise(15)}"))
            expected[doc_id] = name
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        if not doc_id % 10:
            assert r.license_id == expected[doc_id] and r.coverage == 1.0
        split = lambda t: [w.lower() for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", t)]
        assert r.matched_words == whole_alignment(split(text), split(licenses.TEMPLATES[r.license_id]))
        inside = split(text[r.span_start : r.span_end])
        assert inside == split(text)[r.first_word : r.end_word]


def test_edge_cases(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, "clean words only here"), (4, f"{mit}. {mit}."), (4, f"{mit}. {mit}."), (None, mit.upper()), (5, "word " * 50_000 + mit)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.license_id) for r in licenses.scan(df).collect())
    assert got == [(0, "MIT"), *[(4, "MIT")] * 4, (5, "MIT")]
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, {}).count() == 0
