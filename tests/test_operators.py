"""Hand-worked values and invariants of operators that no query covers."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.functions import estimators as est
from skirmish.functions import text as tx
from skirmish.operators import dimensions as dims
from skirmish.operators import discovery as dc
from skirmish.operators import matches as ma
from skirmish.operators import models as mo
from skirmish.operators import picks as pk
from skirmish.operators import rates as rt
from skirmish.operators import teams as tm
from skirmish.sources import games as gm
from skirmish.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_estimators(spark):
    assert one(spark, est.bayes_rate(F.lit(6), F.lit(10), 0.5, 200)) == pytest.approx(106 / 210)
    assert one(spark, est.wilson_interval(F.lit(0), F.lit(0))[0]) == 0.5
    assert one(spark, est.wilson_lower(F.lit(8), F.lit(10))) == pytest.approx(0.4901568, abs=1e-6)
    assert one(spark, est.assign_tier(F.lit(0.52))) == "T1" and one(spark, est.assign_tier(F.lit(0.1))) == "T5"
    for x in (0.3, 1.0, 7.5, 400.0):
        assert one(spark, est.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-9)


def test_text(spark):
    assert one(spark, tx.slugify(F.lit(" Dr. Mundo! "))) == "dr-mundo"
    assert one(spark, tx.clean_markup(F.lit("a<br>b @Dmg@ %i:x% <b>c</b>"))) == "a b Dmg c"
    assert [one(spark, tx.account_id(F.lit(x))) for x in ("Some-One-EUW1", "https://x/y/Na%20me-AB1?q=1", "noTag", "A#TOOLONG")] == ["Some-One#EUW1", "Na me#AB1", None, None]
    assert one(spark, tx.version_parts(F.lit("16.10.x"))) == [16, 10, -1]
    assert one(spark, tx.version_parts(F.lit("16.10")) > tx.version_parts(F.lit("16.9")))
    assert one(spark, tx.truncate_version(F.lit(None).cast("string"))) == "unknown"


def detail(**change):
    people = [{"teamId": 100 if i < 5 else 200, "championId": i + 1, "timePlayed": 900 - i, "puuid": f"p{i}"} for i in range(10)]
    info = {"participants": people, "teams": [{"teamId": 100, "win": True}, {"teamId": 200, "win": False}], "gameVersion": "16.1.7.8", "queueId": 450, "platformId": "EU", "gameDuration": 900, "gameCreation": 5, "gameEndTimestamp": 9}
    return json.dumps({"metadata": {"matchId": "m"}, "info": info | change})


def test_match_details_are_dropped_if_not_whole(spark):
    whole = json.loads(detail())["info"]["participants"]
    bad = [detail(participants=whole[:9]), detail(participants=[whole[0] | {"teamId": 300}, *whole[1:]]), detail(participants=[whole[0] | {"championId": None}, *whole[1:]]),
           detail(participants=[whole[0] | {"teamId": 200}, *whole[1:]]), detail(teams=[{"teamId": 200, "win": True}]), "{broken", None]
    rows = ma.flatten_match_detail(spark.createDataFrame([(x,) for x in [detail(), *bad]], "json string")).collect()
    assert len(rows) == 1 and rows[0].blue == [1, 2, 3, 4, 5] and rows[0].max_leaver_gap_sec == 9 and rows[0].blue_wins


def test_end_block_game_detail_and_history(spark):
    stats = {f"playerAugment{i}": i % 3 for i in range(1, 7)}
    block = {"gameId": 7, "gameMode": "KIWI", "gameLength": 300, "endOfGameTimestamp": 400_000, "teams": [{"teamId": t, "isWinningTeam": t == 100, "players": [{"championId": t + i, "stats": stats} for i in range(5)]} for t in (100, 200)]}
    rows = ma.flatten_end_block(spark.createDataFrame([(json.dumps(block),), (json.dumps(block | {"gameLength": 299}),), (json.dumps(block | {"gameMode": "X"}),)], "json string")).collect()
    assert [(r.queue_id, r.created_ms, r.blue_wins) for r in rows] == [(2400, 100_000, 1)]
    assert json.loads(rows[0].participants_json)[0] == {"teamId": 100, "championId": 100, "augments": [1, 2, 1, 2]}
    game = {"gameId": 1, "queueId": -1, "gameMode": "ARAM", "gameDuration": 600, "gameCreation": 3, "gameVersion": "16.2.3.4", "participants": [{"teamId": 100 if i < 5 else 200, "championId": i + 1, "stats": {"win": "true" if i < 5 else "false"}} for i in range(10)]}
    rows = ma.flatten_game_detail(spark.createDataFrame([(json.dumps(game | {"teams": t}),) for t in ([{"teamId": 100, "win": "Fail"}], [])], "json string")).collect()
    assert [(r.queue_id, r.patch, r.blue_wins) for r in rows] == [(450, "16.2.3", 0), (450, "16.2.3", 1)]
    shapes = ['{"games": {"games": [{"gameId": 1}]}}', '{"games": [{"gameId": 1}]}', '{"gameId": 1}', '[{"gameId": 1}]', "{}", None]
    assert [json.loads(r.game)["gameId"] for r in ma.normalize_history(spark.createDataFrame([(s,) for s in shapes], "json string")).collect()] == [1] * 4


def test_sessions_and_bridges(spark):
    good = {"localPlayerCellId": 1, "myTeam": [{"cellId": 0, "championId": 9}, {"cellId": 1, "championId": 4}], "benchChampions": [{"championId": 3}, {"championId": 2}], "benchEnabled": True}
    bad = good | {"myTeam": [{"cellId": 1, "championId": 0}]}
    rows = ma.parse_session(spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), (json.dumps(good | {"benchEnabled": False}),)], "json string")).collect()
    assert [(r.team, r.current, r.bench) for r in rows] == [([4, 9], 4, [2, 3]), ([4, 9], 4, [])]
    bridge = spark.createDataFrame([("a", "1"), ("b", None)], "public_id string, actor_id string")
    found = {r.public_id: r.resolve_status for r in ma.bridge_ids(spark.createDataFrame([("a",), ("b",), ("c",)], "public_id string"), bridge).collect()}
    assert found == {"a": "resolved", "b": "failed", "c": "pending"}


def test_merge_does_not_depend_on_row_order(spark):
    rows = [("g", 0, 5, ""), ("g", 1, 6, "[1]"), ("g", 2, 7, "[2]"), ("h", 1, 1, None), ("h", 2, 1, "")]
    want = {("g", 0, 5, "[1]"), ("h", 1, 1, None)}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "game_id string, source_rank int, created_ms long, participants_json string")
        assert {(r.game_id, r.source_rank, r.created_ms, r.participants_json) for r in ma.merge_games(df).collect()} == want


def test_forbidden_keys_and_validity(spark):
    df = spark.createDataFrame([('[{"puuid": "x"}]',), ('[{"teamId": 1}]',), ("",), (None,), ("{broken",)], "j string")
    assert [r.x for r in df.select(ma.has_forbidden_keys(F.col("j"), ["puuid"]).alias("x")).collect()] == [True, False, False, False, False]


def test_pairs_and_mirror(spark, sf):
    games = gm.games(spark, sf)
    teams = rt.mirror_teams(games)
    assert teams.agg(F.avg("y")).first()[0] == 0.5
    n = games.count()
    assert rt.entity_rates(gm.players(spark, sf)).agg(F.sum("games")).first()[0] == 10 * n
    a = rt.pair_rates(games).agg(F.sum("games"), F.sum("wins")).first()
    assert tuple(a) == (40 * n, 20 * n)
    assert one(spark, rt.unordered_pairs(F.array(F.lit(1), F.lit(2), F.lit(3)))) == [(1, 2), (1, 3), (2, 3)]


def test_features_are_antisymmetric_and_pair_places_unique(spark, sf):
    games = gm.games(spark, sf).limit(50)
    ids = list(range(1, 102))
    swapped = games.withColumns({"blue": F.col("red"), "red": F.col("blue")})
    a = {r.game_id: r.features.toArray() for r in mo.two_team_features(games, ids).select("game_id", "features").collect()}
    b = {r.game_id: r.features.toArray() for r in mo.two_team_features(swapped, ids).select("game_id", "features").collect()}
    assert all(np.array_equal(a[k], -b[k]) for k in a)
    places = [one(spark, mo.pair_index(F.lit(i), F.lit(j), 6)) for i in range(6) for j in range(i + 1, 6)]
    assert sorted(places) == list(range(6, 6 + 15))


def test_prior_strength_finds_the_planted_one(spark):
    rng = np.random.default_rng(1)
    p = rng.beta(0.5 * 120, 0.5 * 120, 1500)
    rows = [(int(rng.binomial(400, x)), 400, 0.5) for x in p]
    df = spark.createDataFrame(rows, "wins int, games int, baseline double")
    assert 85 < pk.prior_strength(df) < 170
    assert pk.prior_strength(df.limit(5)) == pk.DEFAULT


def test_planted_weights_are_found_and_shuffled_labels_are_not(spark):
    rng = np.random.default_rng(2)
    w = rng.normal(0, 0.5, 50)
    rows = []
    for k in range(4000):
        picks = rng.permutation(50)[:10]
        z = w[picks[:5]].sum() - w[picks[5:]].sum()
        rows.append((str(k), k, [int(x) for x in picks[:5]], [int(x) for x in picks[5:]], int(rng.random() < 1 / (1 + math.exp(-z)))))
    df = spark.createDataFrame(rows, "game_id string, created_ms long, blue array<long>, red array<long>, blue_wins int")
    split = mo.time_split(df)
    ids = list(range(50))
    label = lambda d: mo.two_team_features(d.withColumn("label", F.col("blue_wins").cast("double")), ids)
    model = mo.fit_lr(label(split.where("split = 'train'")))
    assert np.corrcoef(model.coefficients.toArray(), w)[0, 1] > 0.9
    assert mo.binary_metrics(mo.predicted(model, label(split.where("split = 'test'"))), "label", "p").first().log_loss < 0.65
    noise = mo.time_split(mo.shuffled_labels(df))
    got = mo.binary_metrics(mo.predicted(mo.fit_lr(label(noise.where("split = 'train'")), c=0.001), label(noise.where("split = 'test'"))), "label", "p").first()
    assert got.log_loss > got.constant_log_loss - 0.005
    t = mo.fit_temperature(spark.createDataFrame([(2.0, 1), (2.0, 0), (-2.0, 0), (-2.0, 1), (2.0, 1), (-2.0, 0)], "z double, y int"), "y", "z")
    assert t == pytest.approx(2 / math.log(2), rel=0.02)


def test_calibration_leaves_one_out_unless_closed(spark):
    df = spark.createDataFrame([(1.0, 1), (0.95, 1)], "p double, y int")
    assert mo.calibration(df, "y", "p").agg(F.sum("n")).first()[0] == 1
    assert mo.calibration(df, "y", "p", close_last=True).agg(F.sum("n")).first()[0] == 2


def test_graph_and_discovery(spark):
    edges = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (4, 12), (3, 13), (5, 13)], "actor_id long, match_id long")
    seeds = spark.createDataFrame([(1, "web")], "actor_id long, family string")
    assert {(r.actor_id, r.depth, r.family) for r in dc.bfs_expand(edges, seeds, 2).collect()} == {(1, 0, "web"), (2, 1, "web"), (3, 2, "web")}
    found = spark.createDataFrame([(1, "", 0), (1, "web", 2), (1, "ladder", 3), (2, "unknown", 0)], "actor_id long, family string, position int")
    assert {(r.actor_id, r.family) for r in dc.attribute_family(found).collect()} == {(1, "web"), (2, "unknown")}
    pages = spark.createDataFrame([("I", 1, 1, "a"), ("I", 1, 2, "b"), ("I", 2, 1, "a"), ("I", 3, 1, "z")], "tier string, page int, position int, actor_id string")
    assert {r.actor_id for r in dc.collect_actors(pages, full=2).collect()} == {"a", "b"}


def test_damage_mix_and_composition_bounds(spark):
    assert one(spark, tm.damage_mix_score(F.lit(0.4))) == 0.0
    assert one(spark, tm.damage_mix_score(F.lit(0.9), False)) == pytest.approx(-0.018)


def test_sources_round_trip(spark, sf, tmp_path):
    captured = gm.capture(spark, sf).limit(40).cache()
    captured.drop("participants_json", "seed_family").write.parquet(f"{tmp_path}/a")
    captured.write.parquet(f"{tmp_path}/b")
    assert gm.read_games(spark, f"{tmp_path}/a").where("participants_json is not null").count() == 0
    both = gm.read_sources(spark, [f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/a/"])
    assert both.count() == 80 and ma.merge_games(both).count() == 40
    gm.write_partitioned(captured, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 40
    gm.export_weights(spark.createDataFrame([(0, 5, 0.1), (1, 6, 0.2)], "index int, id long, weight double"), f"{tmp_path}/w")
    assert gm.load_weights(spark, f"{tmp_path}/w").count() == 2
    (tmp_path / "s.txt").write_text("One-EUW1\nOne#EUW1\nbad\nTwo#AB12\n")
    assert {r.seed for r in gm.read_seeds(spark, [f"{tmp_path}/s.txt"]).collect()} == {"One#EUW1", "Two#AB12"}


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = jobs.events_stream(spark, f"{tmp_path}/in", files=10)
    query = jobs.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, jobs.tumbling(events).collect()))
    query = jobs.capture_stream(stream.union(stream)).writeStream.format("memory").queryName("captured").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("captured").count() == events.select("event_id").distinct().count()


def test_family_backoff(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", 1, "web" if i % 2 else "ladder", 0.0, "") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.events_stream(spark, f"{tmp_path}/in").withColumn("gain", F.when(F.col("event_id") == 3, 1.0).otherwise(0.0))
    query = jobs.family_backoff(stream, limit=4).writeStream.format("memory").queryName("backed").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.family, r["at"].minute, r.until.minute) for r in spark.table("backed").collect()] == [("ladder", 6, 51)]


def test_upsert_fills_payloads_and_repeats_safely(spark, tmp_path):
    write = jobs.upsert_batch(f"{tmp_path}/t")
    batch = lambda rows: spark.createDataFrame(rows, "game_id string, created_ms long, participants_json string")
    write(batch([("a", 1, ""), ("b", 1, "[1]")]), 0)
    for _ in range(2):
        write(batch([("a", 2, "[2]"), ("b", 2, "[3]"), ("c", 2, None)]), 1)
    got = {(r.game_id, r.created_ms, r.participants_json) for r in spark.read.parquet(f"{tmp_path}/t/v1").collect()}
    assert got == {("a", 1, "[2]"), ("b", 1, "[1]"), ("c", 2, None)}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_splits_lose_no_row_whatever_is_kept(spark, adaptive):
    """64 input partitions, payload columns, ties in time: every row keeps its place and its split."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 20_000
        df = spark.range(0, n, 1, 64).selectExpr("id", "floor(id * 7919 % 20000 / 50) created_ms", "cast(id as string) game_id", "repeat('x', cast(id % 40 as int)) payload", "id % 2 blue_wins", "concat('16.', 5 + id % 2, '.1') patch")
        order = sorted((i * 7919 % n // 50, str(i)) for i in range(n))
        at = {g: p for p, (_, g) in enumerate(order)}
        assert {r.game_id: r.place for r in mo.numbered(df, ["created_ms", "game_id"]).collect()} == at
        got = {r.game_id: r.split for r in mo.time_split(df).select("game_id", "split", "payload").collect()}
        assert got == {g: "test" if p >= 17_000 else "val" if p >= 14_000 else "train" for g, p in at.items()}
        assert {(r.split, r.n) for r in mo.split_base_rate(mo.time_split(df)).collect()} == {("train", 14_000), ("val", 3_000), ("test", 3_000)}
        folds = mo.expanding_folds(df).where("part = 'test'")
        assert {r.game_id: r.fold for r in folds.select("game_id", "fold", "payload").collect()} == {g: p * 6 // n for g, p in at.items() if p * 6 // n}
        late = sorted((i * 7919 % n // 50, str(i)) for i in range(1, n, 2))
        want = {g: "train" if p < 7_000 else "val" if p < 8_500 else "test" for p, (_, g) in enumerate(late)} | {str(i): "train" for i in range(0, n, 2)}
        assert {r.game_id: r.split for r in mo.version_time_split(df, ["16.5"], "16.6").collect()} == want
        assert mo.shuffled_labels(df).agg(F.sum("blue_wins"), F.countDistinct("id")).first()[:] == (n // 2, n)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_splits_of_tiny_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "created_ms long, game_id string")
    assert {r.game_id: r.split for r in mo.time_split(df).collect()} == {"c": "train", "a": "val", "b": "test"}
    assert mo.time_split(df.limit(0)).count() == 0
    assert [r.split for r in mo.time_split(df.limit(1)).collect()] == ["test"]


def test_raw_records_are_parsed_once(spark):
    """However many fields and filters use a record, its text is parsed by one expression of the optimized plan."""
    raw = spark.createDataFrame([("{}",), (None,), ("broken",)], "json string")
    for flatten in (ma.flatten_match_detail, ma.flatten_end_block, ma.flatten_game_detail, ma.parse_session):
        found = flatten(raw)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") + plan.count("jsontostructs(") == 1, flatten.__name__
        assert found.count() == 0


def test_beta_fraction_goes_on_only_with_values_that_still_change(monkeypatch):
    """One value that needs many terms doesn't make the others take them too."""
    sizes, where = [], np.where
    monkeypatch.setattr(np, "where", lambda test, x, y: sizes.append(len(test)) or where(test, x, y))
    a, x = np.array([3.0] * 99 + [1e6]), np.array([0.1] * 99 + [0.499])
    got = est._fraction(x, a, a)
    assert sum(n == 100 for n in sizes) < len(sizes) / 2
    monkeypatch.undo()
    each = [est._fraction(x[i : i + 1], a[i : i + 1], a[i : i + 1])[0] for i in (0, 99)]
    assert np.allclose(got[[0, 99]], each, rtol=1e-12) and (got[:99] == got[0]).all()


def test_equal_participants_are_counted_before_their_categories(spark):
    rows = [("g", 100, 7, 1, [1, 2])] * 5 + [("h", 100, 7, 0, [1, 2]), ("h", 200, 7, 1, None), ("i", 100, 7, 1, [2, 2])]
    players = spark.createDataFrame(rows, "game_id string, team_id int, entity_id long, win int, attributes array<long>")
    dim = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "attribute_id long, categories array<string>")
    got = dims.categories_of(players, dim, counted=True)
    assert sorted(map(tuple, got.collect())) == [(7, 0, "a", 1), (7, 0, "b", 1), (7, 1, "a", 5), (7, 1, "b", 1), (7, 1, "b", 5)]
    r = spark.createDataFrame([(7, 10, 5)], "entity_id long, games long, wins long")
    assert sorted((x.category, x.games, x.wins) for x in pk.category_counts(players, dim, r).collect()) == [("a", 6, 5), ("b", 7, 6)]


def test_expansion_makes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: made.add(1) or x, "long").asNondeterministic()
    edges = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (3, 12), (4, 12)], "actor_id long, match_id long").select(count("actor_id").alias("actor_id"), "match_id")
    seeds = spark.createDataFrame([(1, "web")], "actor_id long, family string")
    assert {(r.actor_id, r.depth) for r in dc.bfs_expand(edges, seeds, 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert made.value == 6


@pytest.mark.parametrize("most", [8, 1])
def test_blended_scores_in_the_row_and_by_joins(spark, most):
    sessions = spark.createDataFrame([("g", [1, 2, 3], 1, [4, 5]), ("h", [4, 9, None], 4, [2]), ("i", [6], 6, [1])], "game_id string, team array<long>, current long, bench array<long>")
    deltas = spark.createDataFrame([(2, 4, 0.1), (3, 4, 0.3), (3, 1, -0.2), (9, 2, 0.5)], "anchor long, mate long, delta double")
    weights = spark.createDataFrame([(1, 0.5), (2, -0.25), (4, 1.0)], "entity_id long, weight double")
    got = {(r.game_id, r.candidate): (r.anchors, r.score) for r in tm.blended_swap_score(sessions, deltas, weights, most=most).collect()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    change = lambda whole, out, in_: 0.3 * (sig(whole - out + in_) - sig(whole))
    want = {("g", 1): (1, -0.14), ("g", 4): (2, 0.14 + change(0.25, 0.5, 1.0)), ("g", 5): (0, change(0.25, 0.5, 0.0)), ("h", 4): (0, 0.0), ("h", 2): (1, 0.35 + change(1.0, 1.0, -0.25))}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
