"""Styles, types, exact quantiles, categories, backfill, mart and version features on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.functions import estimators as est
from skirmish.operators import dimensions as dims
from skirmish.operators import discovery as dc
from skirmish.operators import mart, picks


@pytest.mark.parametrize(("a", "b"), [(1, 1), (0.5, 0.5), (3, 7), (45.5, 12.25), (1200, 800), (250_000, 240_000), (1, 5000)])
def test_beta_quantile_against_numeric_integration(spark, a, b):
    (x, y), = spark.range(1).select(est.beta_quantile(0.1, F.lit(a), F.lit(b)), est.beta_quantile(0.9, F.lit(a), F.lit(b))).collect()
    at = np.linspace(0, 1, 4_000_001)
    mid = (at[1:] + at[:-1]) / 2
    logs = (a - 1) * np.log(mid) + (b - 1) * np.log1p(-mid)
    mass = np.cumsum(np.exp(logs - logs.max()))
    for q, found in ((0.1, x), (0.9, y)):
        assert abs(np.interp(found, at[1:], mass / mass[-1]) - q) < 2e-3


def test_beta_quantile_of_what_is_no_distribution(spark):
    rows = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (2.0, -1.0), (1.0, 1.0)], "a double, b double")
    assert [r[0] if r[0] is None else round(r[0], 9) for r in rows.select(est.beta_quantile(0.1, "a", "b")).collect()] == [None, None, None, 0.1]


def test_item_style(spark):
    rows = [
        ("support", ["Damage"], "Moonstone X", 2000), (None, ["CriticalStrike"], "x", 1799), ("crit", ["CriticalStrike", "SpellDamage"], "x", 1800), ("ap_onhit", ["SpellDamage", "OnHit"], "x", 3000),
        ("ap_burst", ["SpellDamage", "OnHit", "Damage"], "x", 3000), ("ap_burn", ["SpellDamage"], "Liandry", 3000), ("ap_bruiser", ["SpellDamage", "Armor"], "x", 3000),
        ("ap_burst", ["SpellDamage", "Armor", "MagicPenetration"], "x", 3000), ("ad_poke", ["Damage", "OnHit"], "muramana", 3000), ("onhit", ["Damage", "OnHit"], "x", 3000), ("ad_bruiser", ["Damage"], "x", 3000),
        ("ad_assassin", ["Lethality", "Slow"], "x", 3000), ("ad_poke", ["Lethality", "Mana"], "x", 3000), ("tank", ["Health"], "x", 3000), (None, ["Mana"], "x", 3000), (None, None, None, None), ("tank", ["Health", None], None, 1800),
    ]
    df = spark.createDataFrame(rows, "want string, c array<string>, n string, p int")
    assert [r.got for r in df.select(dims.item_style(F.col("c"), F.col("n"), F.col("p")).alias("got")).collect()] == [r[0] for r in rows]


def test_attribute_types_and_scope(spark):
    df = spark.createDataFrame([("Gain Healing", ["archmage", "none", None]), (None, None), ("Spell Damage", [])], "t string, s array<string>")
    got = df.select(dims.attribute_types(F.col("t"), F.col("s")), dims.peer_scope(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(["spell", "sustain", "utility"], "role"), ([], "role"), (["damage", "spell"], "role_damage")]


@pytest.mark.parametrize("small", [0, 512])
def test_categories_count_a_participant_once(spark, small):
    players = spark.createDataFrame([("g", 1, 7, 1, [1, 2, 2, 9]), ("g", 1, 8, 0, None), ("h", 2, 7, 0, [2, None])], "game_id string, team_id int, entity_id int, win int, attributes array<int>")
    dim = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["c"]), (4, None)], "attribute_id int, categories array<string>")
    assert sorted(map(tuple, dims.categories_of(players, dim, small=small).collect())) == [(7, 0, "b"), (7, 1, "a"), (7, 1, "b")]


def test_primary_style_ties_and_nulls(spark):
    items = spark.createDataFrame([(1, "b", 10), (2, "a", 4), (3, "a", 6), (4, None, 99), (5, "c", None)], "item_id int, style string, price int")
    used = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 4), ("z", 5), ("z", 5)], "k string, item_id int")
    assert sorted(map(tuple, dims.primary_style(used, items, "k").collect())) == [("x", "a", 10), ("z", "c", 2)]


def test_category_strength_needs_eight_rows(spark):
    rows = spark.createDataFrame([(i, 5, 10, 0.5) for i in range(7)], "i int, wins int, games int, prior double")
    assert picks.category_prior_strength(rows) == picks.DEFAULT
    assert picks.category_prior_strength(rows.unionByName(rows.limit(1))) > 4000


def test_backfill_only_zeros_with_a_key(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 5), (3, None, 0), (4, "q", 0)], "i int, k string, t long")
    other = spark.createDataFrame([("a", 9), ("a", 8)], "id string, ms long")
    assert sorted(map(tuple, dc.backfill_from(df, other, "k", "id", "t", "ms").collect())) == [(1, "a", 9), (2, "a", 5), (3, None, 0), (4, "q", 0)]


def test_mart_of_an_entity_without_anything(spark):
    tiers = spark.createDataFrame([(1, "OP"), (2, "T1")], "entity_id long, tier string")
    ends = spark.createDataFrame([(1, "kGold", 5, 3, 0.12345, 0.6, 1, 9)], "entity_id long, rarity string, attribute_id long, games long, rank_score double, lcb double, top_rank int, bottom_rank int")
    pairs = spark.createDataFrame([(1, 2, 40, 0.5, 0.4, 0.1, 2.0)], "anchor long, mate long, games long, raw double, expected double, lift double, z double")
    rows = {r.entity_id: r for r in mart.entity_mart(tiers, ends, mart.visible_pairs(pairs, tiers)).collect()}
    assert [x.rank_score for x in rows[1].best] == [0.1235] and rows[1].worst == [] and rows[1].pairs[0].id == 2
    assert rows[2].best == rows[2].worst == rows[2].pairs == []
