import hashlib
import math
import zlib

import pytest
from oracles import assert_equal

from skirmish.llm import queries, sharding
from skirmish.llm.sharding import Leaf

SCHEMA = "doc_id long, text string, shard string, slot int, _part int"


def descend(key, tree):
    """The plain form: three levels of the least weighted draw."""
    node, below = "", sharding.children(tree)
    for _ in range(3):
        u = lambda c: (int(hashlib.md5((key + c).encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        node = min((-math.log(u(c)) / w, c) for c, w in below[node])[1]
    return int(node.rsplit("/", 1)[1])


def shards(spark, keys, tree):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    return {r.k: r.s for r in df.select("k", sharding.shard_of(df.k, tree).alias("s")).collect()}


def test_equals_sql(spark, sf):
    rows = assert_equal(spark, queries.op12_hash_tree_shards, queries.OP12_SQL, sf, ["documents"])
    assert len({r[3] for r in rows}) == 40 or len(rows) < 1000


def test_descent_and_movement_by_weights(spark):
    tree = [Leaf(f"r{i // 6}", f"k{i // 3}", i, 1 + i % 3) for i in range(18)] + [Leaf("r0", "k0", 99, 0)]
    keys = [str(i) for i in range(4000)]
    before = shards(spark, keys, tree)
    assert before == {k: descend(k, tree) for k in keys}
    for s in (0, 1, 2):
        share = sum(x == s for x in before.values()) / len(keys)
        assert abs(share - tree[s].weight / 36) < 0.02
    heavier = [Leaf(x.region, x.rack, x.shard, x.weight + 4 * (x.shard == 7)) for x in tree]
    after = shards(spark, keys, heavier)
    moved = [(before[k], after[k]) for k in keys if before[k] != after[k]]
    of = {x.shard: (x.region, x.rack) for x in tree}
    assert moved
    for a, b in moved:  # into the region and rack that grew, or, inside the rack, to the shard that did
        assert of[b][0] == of[7][0]
        assert of[a][0] != of[7][0] or of[b][1] == of[7][1]
        assert of[a] != of[7] or b == 7
    more = shards(spark, keys, sharding.grown(tree, 40))
    assert {b for k, b in more.items() if b != before[k]} == {40}


def test_slots_repeated_rows_nulls_and_clashing_names(spark):
    rows = [(5, "hot", "x", 1, 2)] * 300 + [(i, f"text {i} é", "x", 1, 2) for i in range(200)] + [(None, "a", "x", 1, 2), (None, None, "x", 1, 2), (7, None, "x", 1, 2), (7, "", "x", 1, 2)]
    tree = sharding.even_tree(5, 4, 2)
    got = sharding.assigned(spark.createDataFrame(rows, SCHEMA), tree, sharding.grown(tree, 5)).collect()
    assert len(got) == len(rows)
    want = sorted(("" if i is None else str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted(("" if r.doc_id is None else str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    for s in range(5):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in own]
        assert order == sorted(order)
    for r in got:
        assert r.shard == descend("" if r.doc_id is None else str(r.doc_id), tree)
        assert r.grown_shard in (r.shard, 5)


def test_written_shards_hold_every_row_in_bounded_files(spark, tmp_path):
    rows = [(5, "hot", "x", 1, 2)] * 90 + [(i, f"t{i}", "x", 1, 2) for i in range(60)]
    tree = sharding.even_tree(3, 3, 1)
    sharding.written(spark.createDataFrame(rows, SCHEMA), tree, str(tmp_path / "out"), rows=16)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.shard) for r in found.collect()) == sorted((i, t, descend(str(i), tree)) for i, t, *_ in rows)
    assert len(list((tmp_path / "out").glob("shard=*/*.parquet"))) >= 9


def test_empty_table_and_bad_trees(spark):
    assert sharding.assigned(spark.createDataFrame([], SCHEMA), sharding.even_tree(4)).count() == 0
    for tree in ([], [Leaf("a", "b", 1, 0)], [Leaf("a", "b", 1, -1)], [Leaf("a", "b", 1), Leaf("a", "c", 1)]):
        with pytest.raises(ValueError):
            sharding.children(tree)
