"""Ordered and globbed sources, matches in training form, profiles, marts, and small functions."""

import pytest
from pyspark.sql import functions as F

from skirmish.functions import text as tx
from skirmish.operators import dimensions as dims
from skirmish.operators import discovery as dc
from skirmish.operators import mart
from skirmish.operators import matches as ma
from skirmish.operators import models as mo
from skirmish.operators import rates as rt
from skirmish.operators import teams as tm
from skirmish.sources import games as gm


def test_seeds_keep_their_order_over_files_and_splits(spark, tmp_path):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # a file is many splits
    try:
        (tmp_path / "z").mkdir()
        names = lambda lo, hi, end: "".join(f"n{i}#{end}\n" for i in range(lo, hi))
        (tmp_path / "b.txt").write_text(names(0, 900, "B1") + "bad\n n3#B1 \n")
        (tmp_path / "z" / "2.txt").write_text(names(0, 300, "Z2"))
        (tmp_path / "z" / "1.txt").write_text("n5#B1\n" + names(0, 700, "Z1"))
        (tmp_path / "a.txt").write_text(names(0, 5, "B1") + names(0, 400, "A1"))
        paths = [f"{tmp_path}/{x}" for x in ("b.txt", "z", "missing.txt", "a.txt")]
        got = [r.seed for r in gm.read_seeds(spark, paths, ids=("me#X1", "n7-B1", "no")).orderBy("position").collect()]
        want = list(dict.fromkeys(["me#X1", "n7#B1", *names(0, 900, "B1").split(), *names(0, 700, "Z1").split(), *names(0, 300, "Z2").split(), *names(0, 400, "A1").split()]))
        assert got == want
        assert [r.position for r in gm.read_seeds(spark, paths).orderBy("position").collect()] == list(range(2300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_sources_by_pattern_without_the_own_output(spark, sf, tmp_path):
    captured = gm.capture(spark, sf).limit(12).cache()
    for name in ("games_b", "games_a", "out", "other"):
        captured.write.parquet(f"{tmp_path}/{name}")
    found = gm.read_sources(spark, [f"{tmp_path}/other", f"{tmp_path}/games_b/"], exclude=(f"{tmp_path}/out",), globs=[f"{tmp_path}/games_*", f"{tmp_path}/o*", f"{tmp_path}/none*"])
    ranks = {(r.source_rank, r.source.rsplit("/", 1)[1]) for r in found.select("source_rank", "source").distinct().collect()}
    assert ranks == {(0, "other"), (1, "games_b"), (2, "games_a")} and found.count() == 36
    with pytest.raises(ValueError):
        gm.read_sources(spark, [], globs=[f"{tmp_path}/none*"])


def test_matches_in_training_form(spark, sf, tmp_path):
    gm.export_matches(gm.capture(spark, sf)).drop("platform").write.parquet(f"{tmp_path}/m")
    rows = gm.read_matches(spark, f"{tmp_path}/m")
    assert rows.schema == spark.createDataFrame([], gm.MATCHES).schema and rows.where("platform IS NULL").count() == rows.count() > 1000
    plan = rows.select("match_id", "blue_wins").where("queue_id = 450")._jdf.queryExecution().executedPlan().toString()
    assert "blue_champions" not in plan and "PushedFilters: [IsNotNull(queue_id), EqualTo(queue_id,450)]" in plan


def test_profiles_fall_back_by_bucket(spark):
    dim = spark.createDataFrame([(1, ["Mage", "Tank"]), (2, None), (3, ["Fighter"]), (4, []), (5, ["Tank"])], "entity_id long, tags array<string>")
    scores = spark.createDataFrame([(1, 500.0, 0.1, 0.8, "x", 2.0), (3, None, 0.9, 0.0, "x", None), (5, 100.0, 0.0, 0.0, "y", 1.0), (5, None, 0.0, 0.0, "y", 9.0)],
        "champion_id int, empirical_damage_per_min double, empirical_physical_damage_ratio double, empirical_magic_damage_ratio double, role string, cc_score double")
    got = {r.entity_id: (r.role, r.damage, r.physical, r.magic, r.cc, r.wave) for r in dims.entity_profiles(dim, scores).collect()}
    assert got == {1: ("Mage", "magic", 50.0, 400.0, 2.0, 0.0), 2: ("Unknown", "mixed", 0.5, 0.5, 0.0, 0.0), 3: ("Fighter", "physical", 1.0, 0.0, 0.0, 0.0), 4: ("Unknown", "mixed", 0.5, 0.5, 0.0, 0.0), 5: ("Tank", "mixed", 0.5, 0.5, 1.0, 0.0)}


def test_published_mart_of_an_entity_without_anything(spark):
    tiers = spark.createDataFrame([(1, "OP"), (2, "T1")], "entity_id long, tier string")
    ends = spark.createDataFrame([(1, "kGold", 5, 30, 0.61234, 0.5, 0.12345, 0.06789, 1, 9)], "entity_id long, rarity string, attribute_id long, games long, posterior double, baseline double, rank_score double, lcb_lift double, top_rank int, bottom_rank int")
    picks = spark.createDataFrame([(1, 5, 0.2, 0.1, 0.69315)], "entity_id long, attribute_id long, share double, peer_share double, pick_lift double")
    pairs = spark.createDataFrame([(1, 2, 40, 0.5, 0.4, 0.1, 2.0)], "anchor long, mate long, games long, raw double, expected double, lift double, z double")
    sets = spark.createDataFrame([(1, "s", 50, 0.6, 0.1, 0.04, 0.01, 0.08, 1, 5)], "entity_id long, set string, games long, posterior double, lift double, residual double, lcb double, ucb double, top_rank int, bottom_rank int")
    profiles = spark.createDataFrame([(1, "Mage", 1.23456)], "entity_id long, role string, physical double")
    rows = {r.entity_id: r for r in mart.published_mart(tiers, ends, picks, pairs, {"sets": (sets, "set")}, profiles).collect()}
    best, = rows[1].best
    assert (best.id, best.g, best.wr, best.lift, best.lcb, best.score, best.pick, best.peer_pick, best.pick_lift) == (5, 30, 0.6123, 0.1123, 0.0679, 0.1235, 0.2, 0.1, 0.693)
    top, = rows[1].sets.top
    assert rows[1].worst == [] == rows[1].sets.bottom and (top.name, top.wr, top.avg, top.res, top.score, top.bad_score) == ("s", 0.6, 0.06, 0.04, 0.01, 0.08)
    assert rows[1].profile.physical == 1.235 and rows[1].pairs[0].id == 2
    assert rows[2].best == rows[2].pairs == rows[2].sets.top == [] and rows[2].profile is None
    used = mart.used_attributes(mart.published_mart(tiers, ends, picks, pairs, {"sets": (sets, "set")}, profiles).select(F.transform("best", lambda x: F.struct(x["id"].alias("attribute_id"))).alias("best"), F.transform("worst", lambda x: F.struct(x["id"].alias("attribute_id"))).alias("worst")), spark.createDataFrame([(5,), (6,)], "attribute_id long"))
    assert [r.attribute_id for r in used.collect()] == [5]


def test_search_returns_entities(spark):
    rows = spark.createDataFrame([("Ahri", "fox", ["Mage"], "T1"), ("Ash", None, ["Marksman"], "T2"), ("Zed", "mageslayer", None, "T1")], "name string, alias string, tags array<string>, tier string")
    assert {r.name for r in ma.found_entities(rows, None, " MAGE ").collect()} == {"Ahri", "Zed"}
    assert {r.name for r in ma.found_entities(rows, "Mage", "").collect()} == {"Ahri"}
    assert {(r.tier, r.n) for r in ma.search_entities(rows, None, "a").collect()} == {("T1", 2), ("T2", 1)}


def test_workers_alive_and_dead(spark):
    signs = spark.createDataFrame([("a", 100), ("a", 900), ("b", 800), ("c", None), (None, 900)], "worker_id string, seen_ms long")
    assert tuple(dc.worker_counts(signs, 1000, 150).first()) == (1, 2, ["a"])
    games = spark.createDataFrame([("g", 2400, "16.1", 5, 1)], "game_id string, queue_id int, patch string, created_ms long, blue_wins int")
    row = dc.status_snapshot(games, spark.createDataFrame([("pending",)], "status string"), 2400, signs, 1000).first()
    assert (row.total, row.pending, row.alive, row.dead) == (1, 1, 2, 1)  # two minutes, unless told otherwise


def test_versions_by_number_and_ranks(spark):
    games = spark.createDataFrame([(1, "16.9.1", 5, 1), (1, "16.10.2", 5, 0), (2, None, None, 1)], "queue_id int, patch string, created_ms long, blue_wins int")
    assert {(r.queue_id, r.min_patch, r.max_patch, r.n) for r in rt.mode_summary(games).collect()} == {(1, "16.9.1", "16.10.2", 2), (2, None, None, 1)}
    assert tuple(rt.latest_version(games, 1).first()) == ("16.10", 1, 5)
    assert rt.latest_version(games, 3).count() == 0
    got = rt.with_rank(spark.range(50), [-F.col("id")]).collect()
    assert {r.id: r["rank"] for r in got} == {i: 50 - i for i in range(50)}


def test_labels(spark):
    side = "struct<ad_share:double,front_group:string,poke_group:string,wave_group:string,engage_group:string,lacks_group:string>"
    plain = (0.5, "1 front", "poke ok", "wave ok", "engage ok", "0")
    row = lambda fit, cov, g, z, part, mix, before=plain, after=plain: (fit, cov, g, z, part, mix, before, after)
    rows = [
        row(0.06, 4, 70, -1.2, 0.012, 0.005, after=(0.6, *plain[1:])), row(0.03, 2, 50, 0.7, 0.012, 0.005), row(0.01, 1, 90, 3.0, -0.02, -0.005), row(0.0, 4, 59, 1.0, 0.0123, 0.0, (0.5, "0 front", *plain[2:])),
        row(0.0, 4, 60, 1.0, 0.002, 0.0, (0.5, "1 front", "poke lack", *plain[3:])), row(0.0, 0, 0, 0.0, 0.0005, 0.0), row(0.0, 0, 0, 0.0, -0.004, 0.0), row(0.0, 0, 0, 0.0, 0.004, 0.0),
    ]
    df = spark.createDataFrame(rows, f"fit double, coverage long, min_games long, avg_z double, composition_part double, mix_part double, before {side}, after {side}")
    got = [(r.strength, r.confidence, r.reason) for r in tm.recommendation_labels(df, 4).collect()]
    assert got == [
        ("excellent fit", "high confidence", "adds AD +1.2%"), ("good fit", "medium confidence", "adds AP +1.2%"), ("playable fit", "early signal", "damage skew -2.0%"), ("low edge", "medium confidence", "adds frontline +1.2%"),
        ("low edge", "high confidence", "adds poke +0.2%"), ("low edge", "early signal", "team neutral"), ("low edge", "early signal", "team -0.4%"), ("low edge", "early signal", "team +0.4%"),
    ]


def test_run_summary_and_known_rows(spark):
    rows = [("val", "lr", 0.68, 0.56, 0.01), ("test", "lr", 0.69, 0.55, 0.02), ("val", "fm", 0.67, 0.57, 0.01), ("train", "fm", 0.5, 0.9, 0.0)]
    row = mo.run_summary(spark.createDataFrame(rows, "split string, model string, log_loss double, accuracy double, ece double"), 9, ["16.9"], 0.51, 1.2).first()
    assert (row.best_model, row.n_entities, row.versions, row.temperature) == ("fm", 9, ["16.9"], 1.2)
    assert {k: v.accuracy for k, v in row.figures.items()} == {"lr/val": 0.56, "lr/test": 0.55, "fm/val": 0.57}
    train = spark.createDataFrame([([1, 2], [3])], "blue array<long>, red array<long>")
    other = spark.createDataFrame([("a", [1], [3]), ("b", [1], [4]), ("c", [], [])], "game_id string, blue array<long>, red array<long>")
    assert {r.game_id for r in mo.known_only(train, other).collect()} == {"a", "c"}


def test_times_and_lookups(spark):
    df = spark.createDataFrame([(1_700_000_000_000, 60, "b"), (None, None, None)], "t long, s int, k string")
    got = df.select(tx.end_ms(F.col("t"), F.col("s")), tx.start_ms(F.col("t"), F.col("s")), tx.utc_text(F.col("t")), tx.is_recent(F.col("t"), F.lit(1_700_003_600_000), 1), tx.looked_up(F.col("k"), {"a": 1, "b": 2}, -1, {"b": 7})).collect()
    assert [tuple(r) for r in got] == [(1_700_000_060_000, 1_699_999_940_000, "2023-11-14T22:13:20Z", True, 7), (None, None, None, False, -1)]
