"""Empirical-Bayes strengths, ranked attributes, pick lift and category affinities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import estimators as est
from skirmish.operators.dimensions import categories_of
from skirmish.operators.discovery import checkpointed

#: Bounds of a prior strength, what stands for one when there are too few rows, and the places of each search round.
LOW, HIGH, DEFAULT, STEPS, ROUNDS = 5.0, 5000.0, 350.0, 25, 3


def with_attribute_dim(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Attribute rows with their dimension; unknown attributes go."""
    return df.join(dim, "attribute_id")


def with_baseline(df: DataFrame, rates: DataFrame, default: float = 0.5) -> DataFrame:
    return df.join(rates.select("entity_id", est.raw_rate("wins", "games").alias("baseline")), "entity_id", "left").withColumn("baseline", F.coalesce("baseline", F.lit(default)))


def negative_log_likelihood(k: Column, prior: str = "baseline") -> Column:
    """Of beta-binomial counts (wins, games) under a prior of strength k."""
    b, w, g = est.clip(prior, 1e-4, 1 - 1e-4), est.number("wins"), est.number("games")
    return -(est.log_beta(w + b * k, g - w + (1 - b) * k) - est.log_beta(b * k, (1 - b) * k))


def prior_grid(rows: DataFrame, low: float = LOW, high: float = HIGH, prior: str = "baseline") -> DataFrame:
    """(n, step, k, nll) over STEPS values of k, even in its logarithm; each row meets each of these values inside the row."""
    ks = [low * (high / low) ** (i / (STEPS - 1)) for i in range(STEPS)]
    each = rows.select("wins", "games", prior, F.posexplode(F.array(*map(F.lit, ks))).alias("step", "k"))
    return each.groupBy("step", "k").agg(F.count("*").alias("n"), F.sum(negative_log_likelihood(F.col("k"), prior)).alias("nll")).select("n", "step", "k", "nll")


def prior_strength(rows: DataFrame, prior: str = "baseline", least: int = 20) -> float:
    """k of least negative log-likelihood by rounds of ever finer grids; DEFAULT with fewer than ``least`` rows."""
    low, high, best = LOW, HIGH, DEFAULT
    rows = checkpointed(rows.select("wins", "games", prior))
    for _ in range(ROUNDS):
        grid = prior_grid(rows, low, high, prior).orderBy("nll", "step").limit(1).collect()
        if not grid or grid[0]["n"] < least:
            return DEFAULT
        best, step = grid[0]["k"], math.log(high / low) / (STEPS - 1)
        low, high = max(LOW, best * math.exp(-step)), min(HIGH, best * math.exp(step))
    return best


def prior_minimum(rows: DataFrame, prior: str = "baseline", least: int = 20, low: float = LOW, high: float = HIGH, nodes: int = 48) -> float:
    """k of least negative log-likelihood, from one pass; DEFAULT with fewer than ``least`` rows.

    Equal counts are added up first. The sum is a smooth function of log k, so its values at Chebyshev nodes, one row each, give a polynomial that equals it
    to rounding between the bounds; its minimum is bracketed by a scan and narrowed by golden sections.
    """
    middle, half = (math.log(low) + math.log(high)) / 2, (math.log(high) - math.log(low)) / 2
    angles = math.pi * (np.arange(nodes) + 0.5) / nodes
    ks = [float(math.exp(middle + half * x)) for x in np.cos(angles)]
    counts = rows.where("games > 0").groupBy("wins", "games", prior).agg(F.count("*").alias("rows"))
    each = counts.select("*", F.posexplode(F.array(*map(F.lit, ks))).alias("step", "k"))
    found = each.groupBy("step").agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * negative_log_likelihood(F.col("k"), prior)).alias("nll")).orderBy("step").collect()
    if not found or found[0]["n"] < least:
        return DEFAULT
    values = np.array([r["nll"] for r in found])
    loss = np.polynomial.Chebyshev([(1 + (m > 0)) / nodes * float(values @ np.cos(m * angles)) for m in range(nodes)])
    scan = np.linspace(-1, 1, 2001)
    at = int(np.argmin(loss(scan)))
    a, b = scan[max(0, at - 1)], scan[min(2000, at + 1)]
    part = (math.sqrt(5) - 1) / 2
    while b - a > 1e-9:
        x, y = b - part * (b - a), a + part * (b - a)
        a, b = (a, y) if loss(x) <= loss(y) else (x, b)
    return float(min(high, max(low, math.exp(middle + half * (a + b) / 2))))


def prior_strength_moment(rows: DataFrame) -> DataFrame:
    """(rho, k) from the median excess variance of the rows' rates over what chance gives (the upper median)."""
    v = est.number("baseline") * (1 - est.number("baseline"))
    excess = F.pow(est.raw_rate("wins", "games") - est.number("baseline"), 2) - v / est.number("games")
    own = rows.select((F.greatest(excess, F.lit(0.0)) / v).alias("rho")).where("rho > 0")
    # the element at n // 2 is the least one that reaches the exact middle
    ranked = own.agg(F.count("*").alias("n"), F.percentile("rho", F.lit(0.5)).alias("middle"))
    upper = own.join(F.broadcast(ranked), F.col("rho") >= F.col("middle")).agg(F.min("rho").alias("rho"))
    return upper.select("rho", F.coalesce(est.clip(1 / F.col("rho") - 1, LOW, HIGH), F.lit(DEFAULT)).alias("k"))


def rank_attributes(attr: DataFrame, k: float, dim: DataFrame, exact: bool = False) -> DataFrame:
    """Posterior mean and lower bound of each (entity, attribute), and the bound's lift over the baseline, which ranks it.

    The bound is the tenth part's quantile: exact, or in its normal form.
    """
    a = est.number("wins") + est.number("baseline") * k
    b = est.number("games") - est.number("wins") + (1 - est.number("baseline")) * k
    low = est.beta_quantile(0.1, a, b) if exact else est.beta_quantile_normal(a, b)
    rows = with_attribute_dim(attr, dim).select("*", est.beta_mean(a, b).alias("posterior"), low.alias("lcb"))
    return rows.withColumn("lcb_lift", F.col("lcb") - F.col("baseline")).withColumn("rank_score", F.col("lcb_lift"))


def pick_totals(picks: DataFrame) -> DataFrame:
    """Picks in all, by role, by role and damage, and by entity, for each rarity and attribute: one pass of grouping sets."""
    return picks.groupingSets(
        [("rarity", "attribute_id"), ("rarity", "role", "attribute_id"), ("rarity", "role", "damage", "attribute_id")], "rarity", "role", "damage", "attribute_id"
    ).agg(F.sum("games").alias("games"), F.grouping_id().alias("level"))


def pick_lift(attr: DataFrame, dim: DataFrame, entities: DataFrame) -> DataFrame:
    """ln of an entity's smoothed share of picks for an attribute over that of its peers, itself left out.

    The attribute's scope names the peers: those of the role, or of role and damage unless they have too few picks, when it
    is the role; where that has none, all. Every share is smoothed to the next wider one. ``dim`` has (attribute_id, rarity,
    scope), ``entities`` (entity_id, role, damage). Counts by entity and attribute are made once; totals come from them.
    """
    rows = attr.select("entity_id", "attribute_id", "games").join(dim.where("rarity <> ''").select("attribute_id", "rarity", "scope"), "attribute_id")
    rows = checkpointed(rows.join(entities.select("entity_id", "role", "damage"), "entity_id"))
    levels = {"own": ("rarity", "entity_id"), "all": ("rarity",), "role": ("rarity", "role"), "damage": ("rarity", "role", "damage")}
    own = rows
    own = own.join(rows.groupBy("rarity").agg(F.count_distinct("attribute_id").alias("m")), "rarity")
    for name, by in levels.items():
        own = own.join(rows.groupBy(*by).agg(F.sum("games").alias(f"t_{name}")), list(by))
        if name != "own":
            own = own.join(rows.groupBy(*by, "attribute_id").agg(F.sum("games").alias(f"c_{name}")), [*by, "attribute_id"])
    d = est.number
    overall = (d("c_all") + 0.5) / (d("t_all") + 0.5 * d("m"))
    use_damage = (F.col("scope") == "role_damage") & ((F.col("t_damage") - F.col("t_own")) >= F.greatest(F.lit(50), 2 * F.col("m")))
    peer_total = F.when(use_damage, F.col("t_damage")).otherwise(F.col("t_role")) - F.col("t_own")
    peer_count = F.when(use_damage, F.col("c_damage")).otherwise(F.col("c_role")) - F.col("games")
    peer = F.when(peer_total <= 0, overall).otherwise((d(peer_count) + 0.5 * d("m") * overall) / (d(peer_total) + 0.5 * d("m")))
    share = (d("games") + 0.5 * d("m") * peer) / (d("t_own") + 0.5 * d("m"))
    scope = F.when(use_damage, "role_damage").otherwise("role")
    return own.select("entity_id", "attribute_id", "rarity", "games", scope.alias("peer_scope"), peer.alias("peer_share"), share.alias("share"), F.log(share / peer).alias("pick_lift"))


def category_counts(players: DataFrame, dim: DataFrame, rates: DataFrame, categories: str = "categories", name: str = "category") -> DataFrame:
    """Games, wins and baseline by (entity, category); a participant counts once for each category. ``dim`` has (attribute_id, array)."""
    rows = categories_of(players, dim, categories, name, counted=True).groupBy("entity_id", name).agg(F.sum("n").alias("games"), F.sum(F.col("win") * F.col("n")).cast("long").alias("wins"))
    return with_baseline(rows, rates)


def category_prior_strength(rows: DataFrame) -> float:
    """Strength of the prior that rows (wins, games, prior) show; DEFAULT with fewer than eight."""
    return prior_strength(rows, "prior", 8)


def category_affinity(counts: DataFrame, k: float | None = None, min_games: int = 45, fallback: int = 15, exact: bool = True, name: str = "category") -> DataFrame:
    """Posterior of each (entity, category) around the entity's rate plus the category's mean lift, with bounds of the residual.

    ``k`` is estimated unless given. Rows under ``min_games`` stay from ``fallback`` games on, marked as not primary. The
    bounds are the quantiles of one and nine tenths, exact or in their normal form.
    """
    mean = counts.groupBy(name).agg(((F.sum("wins") - F.sum(F.col("baseline") * F.col("games"))) / F.sum("games")).alias("avg_lift"))
    rows = counts.where(F.col("games") >= fallback).join(mean, name).withColumn("prior", est.clip(F.col("baseline") + F.col("avg_lift"), 1e-4, 1 - 1e-4))
    if k is None:
        rows = checkpointed(rows)
        k = category_prior_strength(rows)
    a, b = est.number("wins") + est.number("prior") * k, est.number("games") - est.number("wins") + (1 - est.number("prior")) * k
    low, high = (est.beta_quantile(0.1, a, b), est.beta_quantile(0.9, a, b)) if exact else (est.beta_quantile_normal(a, b), est.beta_quantile_normal(a, b, est.Z90))
    rows = rows.select("entity_id", name, "games", "wins", "baseline", "avg_lift", est.beta_mean(a, b).alias("posterior"), "prior", low.alias("_low"), high.alias("_high"))
    return rows.select(
        "entity_id", name, "games", "wins", "posterior", (F.col("posterior") - F.col("baseline")).alias("lift"), (F.col("posterior") - F.col("prior")).alias("residual"),
        (F.col("_low") - F.col("prior")).alias("lcb"), (F.col("_high") - F.col("prior")).alias("ucb"), (F.col("games") >= min_games).alias("primary_sample"), F.lit(float(k)).alias("prior_strength"),
    )


def top_bottom_affinity(df: DataFrame, n: int = 4, name: str = "category") -> DataFrame:
    """First n by lower bound and first n by least upper bound of each entity, then by residual, games and name; among primary rows if it has any."""
    some = F.max(F.col("primary_sample").cast("int")).over(Window.partitionBy("entity_id"))
    rows = df.withColumn("_some", some).where(F.col("primary_sample") | (F.col("_some") == 0))
    top = Window.partitionBy("entity_id").orderBy(F.desc("lcb"), F.desc("residual"), F.desc("games"), name)
    low = Window.partitionBy("entity_id").orderBy("ucb", "residual", "games", name)
    rows = rows.withColumn("top_rank", F.row_number().over(top)).withColumn("bottom_rank", F.row_number().over(low)).drop("_some")
    return rows.where((F.col("top_rank") <= n) | (F.col("bottom_rank") <= n))


def set_affinity(counts: DataFrame, k: float = 30.0) -> DataFrame:
    """Rates of (entity, set) shrunk to the entity's rate, lift, and lift less the set's mean lift."""
    mean = counts.groupBy("set").agg(((F.sum("wins") - F.sum(F.col("baseline") * F.col("games"))) / F.sum("games")).alias("avg_lift"))
    rows = counts.join(mean, "set").withColumn("smoothed", est.bayes_rate("wins", "games", F.col("baseline"), k)).withColumn("lift", F.col("smoothed") - F.col("baseline"))
    return rows.withColumn("residual", F.col("lift") - F.col("avg_lift"))


def set_rates_from_attributes(attr: DataFrame, dim: DataFrame, rates: DataFrame) -> DataFrame:
    """Set counts summed from attribute counts; a participant with two attributes of a set counts twice."""
    rows = with_baseline(with_attribute_dim(attr, dim), rates)
    return rows.groupBy("entity_id", "set").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins"), F.max("baseline").alias("baseline"))
