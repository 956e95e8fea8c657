"""Rows and rates of entities, attributes and pairs.

Pairs are built inside the row of a team, so no self-join of the players is needed; counts are
aggregated map-side before their one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import estimators as est
from skirmish.functions import text as tx
from skirmish.operators import ordered


def mirror_teams(matches: DataFrame) -> DataFrame:
    """Two rows for each match: (game_id, team, y), the second with the label turned round."""
    both = F.array(F.struct(F.col("blue").alias("team"), F.col("blue_wins").alias("y")), F.struct(F.col("red").alias("team"), (1 - F.col("blue_wins")).alias("y")))
    kept = [c for c in matches.columns if c not in ("team", "y")]
    return matches.select(*kept, F.explode(both).alias("_side")).select(*kept, F.col("_side.team").alias("team"), F.col("_side.y").cast("int").alias("y"))


def ordered_pairs(team: Column) -> Column:
    """All (anchor, mate) of a team, anchor and mate different places."""
    return F.flatten(F.transform(team, lambda a, i: F.transform(F.filter(team, lambda b, j: j != i), lambda b: F.struct(a.alias("anchor"), b.alias("mate")))))


def unordered_pairs(team: Column) -> Column:
    return F.flatten(F.transform(team, lambda a, i: F.transform(F.filter(team, lambda b, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def count_rates(rows: DataFrame, *keys: str) -> DataFrame:
    """Games and wins for each key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("games"), F.sum("win").cast("long").alias("wins"))


def entity_rates(players: DataFrame) -> DataFrame:
    return count_rates(players, "entity_id")


def entity_tiers(players: DataFrame, k: float = 200.0) -> DataFrame:
    rates = entity_rates(players)
    return rates.select("*", est.raw_rate("wins", "games").alias("win_rate"), est.bayes_rate("wins", "games", 0.5, k).alias("bayes"), est.laplace_rate("wins", "games").alias("laplace"), est.wilson_lower("wins", "games").alias("wilson")).withColumn("tier", est.assign_tier("bayes"))


def with_attributes(players: DataFrame) -> DataFrame:
    """A row for each attribute that a participant has; participants without payload have none."""
    return players.select("*", F.explode(F.array_distinct("attributes")).alias("attribute_id"))


def entity_attribute_rates(players: DataFrame) -> DataFrame:
    return count_rates(with_attributes(players), "entity_id", "attribute_id")


def attribute_rates(players: DataFrame) -> DataFrame:
    return count_rates(with_attributes(players), "attribute_id")


def _team_pairs(team: Column, size: int = 5) -> Column:
    """unordered_pairs, written out for teams of the usual size."""
    written = F.array(*[F.struct(F.get(team, F.lit(i)).alias("a"), F.get(team, F.lit(j)).alias("b")) for i in range(size) for j in range(i + 1, size)])
    return F.when(F.size(team) == size, written).otherwise(unordered_pairs(team))


def pair_rates(matches: DataFrame) -> DataFrame:
    """Games and wins for each ordered pair of team mates: counted once a pair, and turned round when they are few."""
    rows = mirror_teams(matches.select("blue", "red", "blue_wins")).select(F.explode(_team_pairs(F.col("team"))).alias("p"), F.col("y").alias("win"))
    once = count_rates(rows.select("p.a", "p.b", "win"), "a", "b")
    both = F.explode(F.array(F.struct(F.col("a").alias("anchor"), F.col("b").alias("mate")), F.struct(F.col("b").alias("anchor"), F.col("a").alias("mate")))).alias("p")
    return once.select(both, "games", "wins").groupBy("p.anchor", "p.mate").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins"))


def rates_of_pairs(pairs: DataFrame, size: int = 5) -> DataFrame:
    """Games and wins of each entity from pair_rates() over teams of one size: every game of an entity is in size - 1 of its pairs."""
    return pairs.groupBy(F.col("anchor").alias("entity_id")).agg((F.sum("games") / (size - 1)).cast("long").alias("games"), (F.sum("wins") / (size - 1)).cast("long").alias("wins"))


def global_rate(rates: DataFrame) -> DataFrame:
    """Games, wins, rate over all entities, and matches (ten participants each)."""
    return rates.agg(F.sum("games").alias("games"), F.sum("wins").alias("wins")).select("*", est.raw_rate("wins", "games").alias("rate"), F.floor(F.col("games") / 10).alias("matches"))


def attribute_lift(attr: DataFrame, rates: DataFrame, k: float = 20.0) -> DataFrame:
    """Attribute rates shrunk to the entity's own raw rate, and the lift over it."""
    base = rates.select("entity_id", est.raw_rate("wins", "games").alias("baseline"))
    rows = attr.join(base, "entity_id")
    return rows.withColumn("smoothed", est.bayes_rate("wins", "games", F.col("baseline"), k)).withColumn("lift", F.col("smoothed") - F.col("baseline"))


def anchor_rest(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """Each pair with its anchor's totals, and the totals without the mate."""
    totals = rates.select(F.col("entity_id").alias("anchor"), F.col("games").alias("anchor_games"), F.col("wins").alias("anchor_wins"))
    rows = pairs.join(totals, "anchor")
    return rows.select("*", (F.col("anchor_games") - F.col("games")).alias("rest_games"), (F.col("anchor_wins") - F.col("wins")).alias("rest_wins"))


def pair_synergy(pairs: DataFrame, rates: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Pair rate against what the two entities' rates let expect, additive in logits; with z and difference to the anchor's rest."""
    whole = global_rate(rates).select(F.col("rate").alias("overall"))
    mates = rates.select(F.col("entity_id").alias("mate"), F.col("games").alias("mate_games"), F.col("wins").alias("mate_wins"))
    rows = anchor_rest(pairs, rates).join(mates, "mate").join(F.broadcast(whole), how="cross")  # one row
    anchor, mate = est.raw_rate("anchor_wins", "anchor_games"), est.raw_rate("mate_wins", "mate_games")
    expected = est.sigmoid(est.logit(anchor, eps) + est.logit(mate, eps) - est.logit("overall", eps))
    variance = est.binomial_variance("wins", "games") + est.binomial_variance("anchor_wins", "anchor_games") + est.binomial_variance("mate_wins", "mate_games")
    raw = est.raw_rate("wins", "games")
    rest = F.coalesce(est.raw_rate("rest_wins", "rest_games"), anchor)
    rows = rows.select("anchor", "mate", "games", "wins", raw.alias("raw"), expected.alias("expected"), variance.alias("_v"), (raw - rest).alias("delta_vs_rest"))
    rows = rows.withColumn("lift", F.col("raw") - F.col("expected"))
    return rows.withColumn("z", F.when(F.col("_v") > 0, F.col("lift") / F.sqrt("_v")).otherwise(0.0)).drop("_v")


def anchor_delta(pairs: DataFrame, rates: DataFrame, z: float = est.Z95) -> DataFrame:
    """Pair rate less the anchor's rate without the mate, with standard error, interval and whether it excludes zero."""
    rows = anchor_rest(pairs, rates).where("rest_games > 0")
    delta = est.raw_rate("wins", "games") - est.raw_rate("rest_wins", "rest_games")
    se = F.sqrt(est.binomial_variance("wins", "games") + est.binomial_variance("rest_wins", "rest_games"))
    rows = rows.select("anchor", "mate", "games", "wins", "rest_games", "rest_wins", delta.alias("delta"), se.alias("se"))
    rows = rows.select("*", (F.col("delta") - z * F.col("se")).alias("low"), (F.col("delta") + z * F.col("se")).alias("high"))
    return rows.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def noise_floor(deltas: DataFrame, z: float = est.Z95) -> DataFrame:
    """Median size of the differences, median half width of their intervals, and the ratio."""
    rows = deltas.select(F.abs("delta").alias("size"), (F.col("se") * z).alias("half_width"))
    rows = ordered.quantiles(rows, {"median_delta": ("size", 0.5), "median_half_width": ("half_width", 0.5)})
    return rows.withColumn("ratio", F.col("median_delta") / F.col("median_half_width"))


def anchor_candidates(teams: DataFrame, anchors: list[int]) -> DataFrame:
    """(anchor, candidate, win) for each team that has an anchor, over its other members that aren't anchors."""
    here = F.array_intersect("team", F.array(*[F.lit(a).cast("long") for a in anchors]))
    rows = teams.where(F.size(here) > 0).select("team", "y", F.explode(here).alias("anchor"))
    rows = rows.select("anchor", F.col("y").alias("win"), F.explode("team").alias("candidate"))
    return rows.where(~F.col("candidate").isin(anchors))


def synergy_lift(teams: DataFrame, anchors: list[int], min_total: int = 200, min_pair: int = 15) -> DataFrame:
    """Mean over anchors of a candidate's rate beside them, less its own rate, with a lower bound.

    Needs two anchors with ``min_pair`` games and ``min_total`` games of its own.
    """
    own = count_rates(teams.select(F.explode("team").alias("candidate"), F.col("y").alias("win")), "candidate").where(F.col("games") >= min_total)
    beside = count_rates(anchor_candidates(teams, anchors), "anchor", "candidate").where(F.col("games") >= min_pair)
    rate, variance = est.raw_rate("wins", "games"), est.binomial_variance("wins", "games")
    mean = beside.groupBy("candidate").agg(F.count("*").alias("n_anchors"), F.avg(rate).alias("pair_rate"), (F.avg(variance) / F.count("*")).alias("_v"), F.sum("games").alias("pair_games")).where("n_anchors >= 2")
    rows = mean.join(own, "candidate").select("candidate", "n_anchors", "pair_games", "games", "pair_rate", rate.alias("solo_rate"), (F.col("_v") + variance).alias("_v"))
    rows = rows.withColumn("lift", F.col("pair_rate") - F.col("solo_rate"))
    return rows.withColumn("lower", F.col("lift") - est.Z95 * F.sqrt("_v")).drop("_v")


def fun_picks(lift: DataFrame) -> DataFrame:
    """Candidates of middling own rate that gain much beside the anchors."""
    return lift.where("solo_rate > 0.48 AND solo_rate < 0.54 AND lift > 0.04")


def pick_advisor(pairs: DataFrame, rates: DataFrame, weights: DataFrame, anchors: list[int], min_pair: int = 15, min_games: int = 200) -> DataFrame:
    """Candidates by mean difference over the anchors, joint error, and weight + half the difference."""
    deltas = anchor_delta(pairs.where(F.col("anchor").isin(anchors) & ~F.col("mate").isin(anchors) & (F.col("games") >= min_pair)), rates)
    rows = deltas.groupBy(F.col("mate").alias("candidate")).agg(F.count("*").alias("n_anchors"), F.avg("delta").alias("avg_delta"), (F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count("*")).alias("se"))
    own = weights.where(F.col("games") >= min_games).select(F.col("entity_id").alias("candidate"), "weight")
    return rows.join(own, "candidate").withColumn("hybrid", F.col("weight") + 0.5 * F.col("avg_delta"))


def log_odds_weights(rates: DataFrame, k: float = 200.0) -> DataFrame:
    """A weight for each entity: the logit of its shrunk rate."""
    return rates.select("entity_id", "games", "wins", est.logit(est.bayes_rate("wins", "games", 0.5, k)).alias("weight"))


def rollup_candidates(synergy: DataFrame, picks: list[int]) -> DataFrame:
    """Over the picked anchors: how many a candidate has a pair with, sums of lift and z, fewest games."""
    rows = synergy.where(F.col("anchor").isin(picks) & ~F.col("mate").isin(picks))
    return rows.groupBy(F.col("mate").alias("candidate")).agg(F.count("*").alias("coverage"), F.sum("lift").alias("sum_lift"), F.sum("z").alias("sum_z"), F.sum("raw").alias("sum_raw"), F.min("games").alias("min_games"))


def top_bottom_per_group(df: DataFrame, group: list[str], keys: list[str], last: str, n: int = 5) -> DataFrame:
    """The first and last n of each group by falling keys, with rank from either end; ``last`` is a unique key."""
    top = Window.partitionBy(*group).orderBy(*[F.desc(k) for k in keys], F.asc(last))
    bottom = Window.partitionBy(*group).orderBy(*[F.asc(k) for k in keys], F.asc(last))
    rows = df.withColumn("top_rank", F.row_number().over(top)).withColumn("bottom_rank", F.row_number().over(bottom))
    return rows.where((F.col("top_rank") <= n) | (F.col("bottom_rank") <= n))


def ranked_pairs(synergy: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("anchor").orderBy(F.desc("lift"), F.desc("z"), F.desc("games"), "mate")
    return synergy.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def tier_blocks(tiers: DataFrame) -> DataFrame:
    return tiers.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("bayes"), "entity_id")))


def top_bottom(df: DataFrame, key: str, last: str, n: int, min_games: int = 0) -> DataFrame:
    """Globally first and last n rows by key among those with enough games; two bounded sorts."""
    rows = df.where(F.col("games") >= min_games)
    top = rows.orderBy(F.desc(key), last).limit(n).withColumn("end", F.lit("top"))
    return top.unionByName(rows.orderBy(F.asc(key), last).limit(n).withColumn("end", F.lit("bottom")))


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its rank, from 1, in the order of ascending expressions that tell all rows apart; no task gets the whole table."""
    keys = {f"_order{i}": x for i, x in enumerate(order)}
    return ordered.placed(df.withColumns(keys), [], list(keys), name).withColumn(name, F.col(name) + 1).drop(*keys)


def mode_summary(games: DataFrame) -> DataFrame:
    """For each mode: matches, base rate, first and last version by number, and the latest time."""
    by = tx.version_parts(F.col("patch"))
    return games.groupBy("queue_id").agg(
        F.count("*").alias("n"), F.avg(F.col("blue_wins").cast("double")).alias("base_rate"), F.min_by("patch", by).alias("min_patch"), F.max_by("patch", by).alias("max_patch"), F.max("created_ms").alias("latest_ms")
    )


def latest_version(games: DataFrame, mode: int | None = None, parts: int = 2) -> DataFrame:
    """One row: the version (its first parts) with the latest match of a mode, how many it has, and that time; the greater version of equals."""
    rows = games if mode is None else games.where(F.col("queue_id") == mode)
    rows = rows.groupBy(tx.truncate_version(F.col("patch"), parts).alias("version")).agg(F.count("*").alias("n"), F.max("created_ms").alias("latest_ms"))
    best = F.max_by(F.struct("version", "n", "latest_ms"), F.struct("latest_ms", tx.version_parts(F.col("version"))))
    return rows.agg(best.alias("x")).where("x IS NOT NULL").select("x.*")


def tier_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """How each entity's tier changed between two tier lists: up, down, same, new or gone."""
    order = F.array(*[F.lit(t) for t, _ in est.TIERS], F.lit("T5"))
    rows = previous.select("entity_id", F.col("tier").alias("before")).join(current.select("entity_id", F.col("tier").alias("after")), "entity_id", "full_outer")
    a, b = F.array_position(order, F.col("before")), F.array_position(order, F.col("after"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(b < a, "up").when(b > a, "down").otherwise("same")
    return rows.withColumn("change", change)


def pooled_pairs(pairs: DataFrame, expected: str = "expected") -> DataFrame:
    """pairs with their effects on the logit beside what their members alone give, shrunk towards none.

    ``pairs`` has games, wins and the expected rate. A pair's own effect is (wins - expected wins) / information, the information being
    games * p * (1 - p); effects are taken as normal around 0 with a variance that all pairs give together: what their weighted squares exceed
    chance by, over the summed information (0 if they don't). Adds effect, pooled (the posterior mean), sd, z, rate (the pooled one) and tau2.
    """
    p = est.clip(expected, 1e-4, 1 - 1e-4)
    rows = pairs.withColumn("_info", est.number("games") * p * (1 - p)).withColumn("_over", est.number("wins") - est.number("games") * p)
    sums = rows.agg(F.sum(F.pow("_over", 2) / F.col("_info")).alias("q"), F.count("*").alias("n"), F.sum("_info").alias("info"))
    tau2 = sums.select(F.greatest(F.lit(0.0), F.coalesce((F.col("q") - F.col("n")) / F.col("info"), F.lit(0.0))).alias("tau2"))
    rows = rows.crossJoin(F.broadcast(tau2))  # one row
    shrink = F.col("tau2") / (F.col("tau2") * F.col("_info") + 1)
    rows = rows.withColumn("effect", F.col("_over") / F.col("_info")).withColumn("pooled", F.col("_over") * shrink).withColumn("sd", F.sqrt(shrink))
    return rows.withColumn("z", F.when(F.col("sd") > 0, F.col("pooled") / F.col("sd")).otherwise(0.0)).withColumn("rate", est.sigmoid(est.logit(expected, 1e-4) + F.col("pooled"))).drop("_info", "_over")
