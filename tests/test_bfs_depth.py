from collections import defaultdict

from skirmish.plans import registry


def test_depths_are_those_of_the_whole_graph(spark, tmp_path):
    orders = [(i, c) for i, c in enumerate([1, 3, 3, 4, 4, 6, 6, 7, 7, 8, 9, 2, 5])]
    items = list(zip([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], [11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 20, 20, 33], strict=True))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([*items, items[0]], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(c,) for c in range(1, 10)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    of, at = defaultdict(set), defaultdict(set)
    for (_, actor), (_, match) in zip(orders, items, strict=True):
        of[actor].add(match)
        at[match].add(actor)
    depth = dict.fromkeys((1, 2, 5), 0)
    for d in (1, 2, 3):
        for b in {b for a in list(depth) for m in of[a] for b in at[m]} - set(depth):
            depth[b] = d
    assert {r.actor_id: r.depth for r in registry.QUERIES["bfs_depth"](spark, str(tmp_path)).collect()} == depth
