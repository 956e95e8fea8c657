"""Sparse features, strengths by one pass, pooled pairs, leak checks, exact quantiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.functions import estimators as est
from skirmish.operators import models as mo
from skirmish.operators import picks as pk
from skirmish.operators import rates as rt


def matches(n=3000, entities=30, seed=0, weight=0.7):
    rng = np.random.default_rng(seed)
    w = rng.normal(0, weight, entities)
    rows = []
    for i in range(n):
        picks = rng.permutation(entities)[:10]
        blue, red = picks[:5], picks[5:]
        y = int(rng.random() < 1 / (1 + math.exp(w[red].sum() - w[blue].sum())))
        rows.append((str(i), i, [int(x) + 100 for x in blue], [int(x) + 100 for x in red], y))
    return rows, w


MATCH = "game_id string, created_ms long, blue array<long>, red array<long>, blue_wins int"


def test_sparse_features_give_the_dense_coefficients(spark):
    rows, w = matches(1500)
    df = spark.createDataFrame(rows, MATCH).withColumn("label", F.col("blue_wins").cast("double"))
    ids = [r.entity_id for r in mo.build_vocab(df).collect()]
    sparse = mo.as_vectors(mo.two_team_places(df, ids), len(ids))
    a, b = (mo.fit_lr(x, c=0.5) for x in (sparse, mo.two_team_features(df, ids)))
    assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-6)
    assert np.corrcoef(a.coefficients.toArray(), w)[0, 1] > 0.9
    assert type(sparse.first().features).__name__ == "SparseVector"


def test_places_accumulate_and_leave_unknown_entities_out(spark):
    df = spark.createDataFrame([([1, 1, 2, 9], [2, 3, -4], [3, 1, 3]), ([], [9], [7]), ([-4], None, None)], "blue array<long>, red array<long>, team array<long>")
    vocab = [1, 2, 3, -4]
    got = [[(x.place, x.value) for x in r.sparse] for r in mo.two_team_places(df.where("red IS NOT NULL"), vocab).collect()]
    assert got == [[(0, 2.0), (2, -1.0), (3, -1.0)], []]
    got = [[x.place for x in r.sparse] for r in mo.team_places(df.where("team IS NOT NULL"), vocab, pairs=True).collect()]
    assert got == [[0, 2, 5], []]  # the pair (0, 2) stands second after the four entities


def test_a_wide_vocabulary_and_its_pairs_fit(spark):
    ids = [7 * i - 9000 for i in range(5000)]
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.sample(ids, 5), i) for i in range(40)], "team array<long>, i int")
    width = mo.sparse_width(len(ids), True)
    assert width == 5000 + 5000 * 4999 // 2
    rows = mo.as_vectors(mo.team_places(df, ids, pairs=True), width).collect()
    at = {v: p for p, v in enumerate(ids)}
    for r in rows:
        own = sorted(at[x] for x in r.team)
        want = own + [len(ids) + a * len(ids) - a * (a + 1) // 2 + b - a - 1 for i, a in enumerate(own) for b in own[i + 1 :]]
        assert r.features.size == width and r.features.indices.tolist() == want
    model = mo.fit_lr(mo.as_vectors(mo.team_places(df.withColumn("label", (F.col("i") % 2).cast("double")), ids[:600] + ids[600:], pairs=False), 5000), c=1.0)
    assert model.coefficients.size == 5000


def strengths(seed, k, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        b, g = rng.uniform(0.3, 0.7), int(rng.integers(1, 400))
        rows.append((int(rng.binomial(g, rng.beta(b * k, (1 - b) * k))), g, float(b)))
    return rows


@pytest.mark.parametrize("k", [4, 30, 250, 4900])
def test_strength_of_one_pass_agrees_with_a_fine_grid(spark, k):
    rows = strengths(k, k)
    found = pk.prior_minimum(spark.createDataFrame(rows, "wins long, games long, baseline double"))
    logs = np.linspace(math.log(5), math.log(5000), 20001)
    ks = np.exp(logs)
    lg = np.vectorize(math.lgamma)
    loss = np.zeros_like(ks)
    for w, g, b in rows:
        b = min(max(b, 1e-4), 1 - 1e-4)
        loss -= lg(w + b * ks) + lg(g - w + (1 - b) * ks) - lg(g + ks) - lg(b * ks) - lg((1 - b) * ks) + lg(ks)
    assert abs(math.log(found) - logs[int(np.argmin(loss))]) < 1e-3


def test_strength_of_too_few_rows(spark):
    rows = strengths(3, 50, 19)
    df = spark.createDataFrame(rows + [(0, 0, 0.5)] * 30, "wins long, games long, baseline double")
    assert pk.prior_minimum(df) == pk.DEFAULT == pk.prior_minimum(df.limit(0))
    assert pk.prior_minimum(df, least=19) != pk.DEFAULT


def test_pooled_pairs_recover_planted_effects(spark):
    rng, rows, true = np.random.default_rng(4), [], {}
    for i in range(900):
        games, p = int(rng.integers(20, 600)), float(rng.uniform(0.35, 0.65))
        true[i] = float(rng.normal(0, 0.25))
        rate = 1 / (1 + math.exp(-(math.log(p / (1 - p)) + true[i])))
        rows.append((i, games, int(rng.binomial(games, rate)), p))
    got = rt.pooled_pairs(spark.createDataFrame(rows, "pair int, games long, wins long, expected double")).collect()
    assert abs(math.sqrt(got[0].tau2) - 0.25) < 0.03
    error = lambda c: np.mean([(r[c] - true[r.pair]) ** 2 for r in got])
    assert error("pooled") < 0.75 * error("effect")
    assert np.mean([abs(r.pooled - true[r.pair]) < 1.96 * r.sd for r in got]) > 0.9
    flat = rt.pooled_pairs(spark.createDataFrame([(i, 100, 50, 0.5) for i in range(9)], "pair int, games long, wins long, expected double")).collect()
    assert {(r.pooled, r.sd, r.z, round(r.rate, 9)) for r in flat} == {(0.0, 0.0, 0.0, 0.5)}
    assert rt.pooled_pairs(spark.createDataFrame([], "pair int, games long, wins long, expected double")).count() == 0


@pytest.mark.parametrize("leak", [False, True])
def test_leak_checks_flag_a_planted_leak_only(spark, leak):
    rows, _ = matches(6000, 25, 3, 0.12)
    df = mo.time_split(spark.createDataFrame(rows, MATCH)).where("split <> 'test'")
    noise = (F.pmod(F.xxhash64("game_id"), F.lit(1000)) - 500) / 500
    df = df.withColumn("leak_column", (F.col("blue_wins") - 0.5) * 2 + noise if leak else noise)
    got = {r.check: r.alarm for r in mo.leak_checks(df).collect()}
    assert got == {"shuffled_loss": False, "shuffled_accuracy": False, "planted_correlation": False, "accuracy": leak}


def test_shuffled_check_flags_labels_that_survive_the_shuffle(spark, monkeypatch):
    rows, _ = matches(4000, 25, 5, 0.8)
    df = mo.time_split(spark.createDataFrame(rows, MATCH)).where("split <> 'test'")
    monkeypatch.setattr(mo, "shuffled_labels", lambda df, seed=0: df)
    got = {r.check: r.alarm for r in mo.leak_checks(df).collect()}
    assert got["shuffled_loss"] and got["shuffled_accuracy"]


@pytest.mark.parametrize(("a", "b"), [(1, 1), (1, 30), (1, 2500.5), (0.25, 1), (7, 1), (900, 1)])
def test_exact_quantile_has_its_closed_forms(spark, a, b):
    for q in (0.01, 0.1, 0.5, 0.9, 0.999):
        want = 1 - (1 - q) ** (1 / b) if a == 1 else q ** (1 / a)
        assert spark.range(1).select(est.beta_quantile(q, F.lit(a), F.lit(b))).first()[0] == pytest.approx(want, abs=1e-9)


def labelled(spark, rows):
    return spark.createDataFrame(rows, MATCH).withColumn("label", F.col("blue_wins").cast("double"))


def test_swaps_turn_about_half_and_are_repeatable(spark):
    rows, _ = matches(2000)
    df = spark.createDataFrame(rows, MATCH)
    before = {r.game_id: (r.blue, r.red, r.blue_wins) for r in df.collect()}
    got = {s: {r.game_id: (r.blue, r.red, r.blue_wins) for r in mo.swap_augment(df.repartition(s + 2), s).collect()} for s in (1, 2)}
    for after in got.values():
        turned = [i for i in before if after[i] != before[i]]
        assert all(after[i] == (before[i][1], before[i][0], 1 - before[i][2]) for i in turned)
        assert 0.45 < len(turned) / len(before) < 0.55
    assert got[1] == {r.game_id: (r.blue, r.red, r.blue_wins) for r in mo.swap_augment(df, 1).collect()} and got[1] != got[2]


def test_model_lift_equals_a_loop_over_its_draws(spark):
    rng = random.Random(3)
    weights = {10 + 7 * i: rng.gauss(0, 0.4) for i in range(40)}
    table = spark.createDataFrame(list(weights.items()), "entity_id long, weight double")
    team, n, seed = [10, 24, 45], 60, 5
    at = spark.range(n).selectExpr("id draw", "explode(sequence(0, 3)) mate").select("draw", F.pmod(F.xxhash64("draw", "mate", F.lit(seed)), F.lit(len(weights))).alias("place")).collect()
    ids, draws = sorted(weights), {}
    for r in at:
        draws.setdefault(r.draw, []).append(ids[r.place])
    draws = [d for d in draws.values() if len(set(d)) == 4]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    want = {}
    for c in set(ids) - set(team):
        own = [sigmoid(weights[c] + sum(weights[e] for e in d)) for d in draws if c not in d]
        want[c] = (len(own), sigmoid(weights[c] + sum(weights[e] for e in team)) - sum(own) / len(own))
    got = {r.candidate: (r.draws, r.lift) for r in mo.model_lift(team, table, table, n, seed).collect()}
    assert set(got) == set(want)
    assert all(got[c][0] == want[c][0] and math.isclose(got[c][1], want[c][1], abs_tol=1e-12) for c in want)


def test_windows_are_compared_on_the_same_matches(spark):
    rows, _ = matches(2400, 20)
    train, val, test = (labelled(spark, rows[a:b]).drop("label") for a, b in ((0, 1600), (1600, 2000), (2000, 2400)))
    ids = [r.entity_id for r in mo.build_vocab(train).collect()]
    # the short window's labels say nothing, so it must lose
    noise = train.where("created_ms < 200").withColumn("blue_wins", (F.col("created_ms") % 2).cast("int"))
    found = {(r.window, r.split): r for r in mo.compare_windows({"long": train, "short": noise}, val, test, ids).collect()}
    assert set(found) == {(w, s) for w in ("long", "short") for s in ("val", "test")}
    assert all(r.n == 400 for r in found.values())
    for split in ("val", "test"):
        assert found["long", split].log_loss < found[("short", split)].log_loss
        assert found["long", split].constant_log_loss == found["short", split].constant_log_loss


def test_stacked_model_uses_what_the_first_lacks(spark):
    rng = np.random.default_rng(4)
    rows, _ = matches(2400, 20, weight=0.3)
    known = [(*r[:4], int(rng.random() < 1 / (1 + math.exp(-3 * x))), float(x)) for r, x in zip(rows, rng.normal(size=len(rows)), strict=True)]
    df = spark.createDataFrame(known, MATCH + ", extra double").withColumn("label", F.col("blue_wins").cast("double"))
    ids = [r.entity_id for r in mo.build_vocab(df).collect()]
    train, test = (mo.two_team_features(df.where(w), ids) for w in ("created_ms < 1800", "created_ms >= 1800"))
    base = mo.fit_lr(train)
    stacked = mo.fit_stacked(train.drop("p"), base, ["extra"])
    first = mo.predicted(base, test)
    second = mo.predicted(stacked, mo.stacked_features(first, ["extra"]).drop("p"))
    loss = lambda scored: mo.binary_metrics(scored, "label", "p").first().log_loss
    assert loss(second) < loss(first) - 0.2
    assert 1.5 < stacked.coefficients[1] < 4.5


def test_factorisation_machine_finds_planted_interactions(spark):
    """Labels that depend on a pair of entities only, which no linear model sees."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append((str(i), i, [1 + int(a), 3 + int(b)], [9], int(rng.random() < (0.9 if a == b else 0.1))))
    df = mo.two_team_features(labelled(spark, rows), [1, 2, 3, 4])
    train, test = df.where("created_ms < 2400"), df.where("created_ms >= 2400")
    loss = lambda model: mo.binary_metrics(mo.predicted(model, test), "label", "p").first()
    assert loss(mo.fit_lr(train)).log_loss > 0.66
    found = loss(mo.fit_fm(train))
    assert found.log_loss < 0.5 and found.accuracy > 0.85


def test_choice_of_model_looks_at_val_only(spark):
    rows = [("val", "a", 0.6, 0.61), ("val", "b", 0.6, 0.60), ("val", "c", 0.5, 0.4), ("test", "c", 0.9, 0.1)]
    table = spark.createDataFrame(rows, "split string, model string, accuracy double, log_loss double")
    assert mo.choose_model(table).first().model == "b"
