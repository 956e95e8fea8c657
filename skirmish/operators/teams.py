"""Team composition, its score, recommendations, and swaps scored by weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import estimators as est
from skirmish.operators.discovery import checkpointed

#: What a team of five needs at least of each score; weights of the tables; and the tables.
THRESHOLDS = {"wave": 3.0, "cc": 3.0, "engage": 2.2, "damage_score": 5.5, "poke": 2.0, "sustain": 1.5, "front": 1.8}
WEIGHTS = {"ad_front": 0.55, "poke_front": 0.30, "wave_engage": 0.15, "all_lacks": 0.15, "mage_ad": 0.20, "marksman_ad": 0.20}
TABLES = {
    "ad_front": {
        "0 front|<35% AD": -0.0393,
        "0 front|35-45% AD": 0.0181,
        "0 front|45-55% AD": -0.0189,
        "0 front|55-65% AD": -0.0201,
        "0 front|>=65% AD": -0.0383,
        "1 front|<35% AD": -0.0019,
        "1 front|35-45% AD": 0.0187,
        "1 front|45-55% AD": 0.0149,
        "1 front|55-65% AD": 0.0185,
        "1 front|>=65% AD": -0.0037,
        "2+ front|<35% AD": -0.0146,
        "2+ front|35-45% AD": 0.0160,
        "2+ front|45-55% AD": 0.0097,
        "2+ front|55-65% AD": -0.0148,
        "2+ front|>=65% AD": -0.0388,
    },
    "poke_front": {
        "0 front|poke lack": -0.0447,
        "0 front|poke ok": -0.0164,
        "1 front|poke lack": 0.0228,
        "1 front|poke ok": 0.0102,
        "2+ front|poke lack": -0.0497,
        "2+ front|poke ok": -0.0006,
    },
    "wave_engage": {
        "wave lack|engage lack": -0.0160,
        "wave lack|engage ok": -0.0105,
        "wave ok|engage lack": 0.0073,
        "wave ok|engage ok": 0.0002,
    },
    "all_lacks": {
        "0": 0.0026,
        "1": -0.0053,
        "2+": -0.0119,
    },
    "mage_ad": {
        "0|>=65% AD": -0.0499,
        "1|35-45% AD": 0.0006,
        "1|45-55% AD": -0.0118,
        "1|55-65% AD": -0.0042,
        "1|>=65% AD": -0.0285,
        "2+|<35% AD": -0.0135,
        "2+|35-45% AD": 0.0187,
        "2+|45-55% AD": 0.0110,
        "2+|55-65% AD": 0.0013,
        "2+|>=65% AD": -0.0099,
    },
    "marksman_ad": {
        "0|<35% AD": -0.0266,
        "0|35-45% AD": -0.0141,
        "0|45-55% AD": -0.0037,
        "0|55-65% AD": -0.0354,
        "1|<35% AD": -0.0030,
        "1|35-45% AD": 0.0267,
        "1|45-55% AD": 0.0176,
        "1|55-65% AD": -0.0063,
        "1|>=65% AD": -0.0153,
        "2+|<35% AD": -0.0318,
        "2+|35-45% AD": 0.0188,
        "2+|45-55% AD": -0.0016,
        "2+|55-65% AD": 0.0071,
        "2+|>=65% AD": -0.0299,
    },
}
#: Weight of a composition's change and its bound, and of the nearness of the physical share to its target.
COMPOSITION_WEIGHT, COMPOSITION_CLAMP, MIX_TARGET, MIX_WEIGHT, MIX_CLAMP = 0.25, 0.05, 0.40, 0.18, 0.025


def table_entries(tables: dict[str, dict[str, float]] = TABLES) -> list[tuple[str, str, float]]:
    """(table, key, value) of all tables."""
    return [(t, key, value) for t, values in tables.items() for key, value in values.items()]


def team_composition(teams: DataFrame, entities: DataFrame, key: str = "game_id", thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """For each team: size, sums, strong fronts, roles, what it lacks of a team of five in proportion, and groups of these.

    ``teams`` has (key, team array). The team is exploded, joined with the entities' profiles, and summed. Members
    without a profile count for the size only.
    """
    rows = teams.select(key, F.explode("team").alias("entity_id")).join(entities, "entity_id", "left")
    total = lambda c: F.coalesce(F.round(F.sum(F.col(c).cast("decimal(20,6)")), 6).cast("double"), F.lit(0.0)).alias(c)
    sums = rows.groupBy(key).agg(
        F.count("*").alias("size"), *[total(c) for c in ("physical", "magic", *thresholds)],
        F.count_if(F.col("front") >= 2).alias("fronts"), F.count_if(F.col("role") == "Mage").alias("mages"), F.count_if(F.col("role") == "Marksman").alias("marksmen"),
    )
    lack = lambda c: F.col(c) < F.lit(thresholds[c]) * F.col("size") / 5
    both = F.col("physical") + F.col("magic")
    rows = sums.select("*", *[lack(c).alias(f"lacks_{c}") for c in thresholds], F.when(both > 0, F.col("physical") / both).otherwise(0.5).alias("ad_share"))
    lacks = sum((F.col(f"lacks_{c}").cast("int") for c in thresholds), F.lit(0))
    s = F.col("ad_share")
    bins = F.when(s < 0.35, "<35% AD").when(s < 0.45, "35-45% AD").when(s < 0.55, "45-55% AD").when(s < 0.65, "55-65% AD").otherwise(">=65% AD")

    def group(n: Column) -> Column:
        whole = n * 5 / F.col("size")
        return F.when(whole < 0.5, "0").when(whole < 1.5, "1").otherwise("2+")

    said = lambda c: F.when(F.col(f"lacks_{c}"), f"{c} lack").otherwise(f"{c} ok").alias(f"{c}_group")
    return rows.select(
        "*", bins.alias("ad_bin"), F.concat(group(F.col("fronts")), F.lit(" front")).alias("front_group"), group(F.col("mages")).alias("mage_group"), group(F.col("marksmen")).alias("marksman_group"),
        *[said(c) for c in ("wave", "engage", "poke")], group(lacks).alias("lacks_group"),
    )


#: The groups of a composition that make the key of each table.
TABLE_KEYS = {
    "ad_front": ("front_group", "ad_bin"), "poke_front": ("front_group", "poke_group"), "wave_engage": ("wave_group", "engage_group"), "all_lacks": ("lacks_group",),
    "mage_ad": ("mage_group", "ad_bin"), "marksman_ad": ("marksman_group", "ad_bin"),
}


def lookup_score(df: DataFrame, tables: DataFrame, table: str, column: str) -> DataFrame:
    """Adds the table's value for a column, 0 where it has none. ``tables`` has (table, value_key, value)."""
    own = tables.where(F.col("table") == table).select(F.col("value_key").alias(column), F.col("value").alias(f"score_{table}"))
    return df.join(own, column, "left").withColumn(f"score_{table}", F.coalesce(f"score_{table}", F.lit(0.0)))


def composition_score(comp: DataFrame, tables: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted sum of six tables' values, within .05 either way, in proportion to how full the team is.

    The fixed tables are literals that are looked up inside the row; ``tables`` (table, value_key, value) of a caller's own are joined.
    """
    for table, columns in TABLE_KEYS.items():
        key = F.concat_ws("|", *columns)
        if tables is None:
            values = F.create_map(*[F.lit(x) for entry in TABLES[table].items() for x in entry])
            comp = comp.withColumn(f"score_{table}", F.coalesce(values[key], F.lit(0.0)))
        else:
            comp = lookup_score(comp.withColumn("_key", key), tables, table, "_key").drop("_key")
    total = sum((F.col(f"score_{t}") * w for t, w in weights.items()), F.lit(0.0))
    return comp.withColumn("composition_score", est.clip(total, -COMPOSITION_CLAMP, COMPOSITION_CLAMP) * est.clip((F.col("size") - 1) / 4, 0, 1))


def damage_mix(share: Column, fix_ad_share: bool = True) -> Column:
    """Nearness of the physical share to its target; without the fix the share counts as .5, as it always did."""
    return -F.abs((share if fix_ad_share else F.lit(0.5)) - MIX_TARGET)


def damage_mix_score(share: Column, fix_ad_share: bool = True) -> Column:
    """That nearness by its weight, within .025 either way."""
    return est.clip(damage_mix(share, fix_ad_share) * MIX_WEIGHT, -MIX_CLAMP, MIX_CLAMP)


def recommend(rolled: DataFrame, rates: DataFrame, picks: list[int], entities: DataFrame | None = None, limit: int = 12, fix_ad_share: bool = True) -> DataFrame:
    """Candidates by fit, then pair fit, mean lift, mean z, coverage, games, id; the worst one takes the last place.

    ``rolled`` is rollup_candidates(). With the entities' profiles the fit adds what the candidate changes in the
    composition's score and in the mix of damage, more the more picks it was seen beside. Both ends are bounded sorts.
    """
    own = rates.select(F.col("entity_id").alias("candidate"), est.bayes_rate("wins", "games").alias("solo"))
    rows = rolled.join(own, "candidate").withColumn("pair_fit", F.col("sum_lift") / len(picks)).withColumn("avg_lift", F.col("sum_lift") / F.col("coverage")).withColumn("avg_z", F.col("sum_z") / F.col("coverage"))
    if entities is None:
        rows = rows.withColumn("composition_delta", F.lit(0.0)).withColumn("mix_delta", F.lit(0.0))
    else:
        team = F.array(*[F.lit(p).cast("long") for p in picks])
        teams = rows.select("candidate", F.concat(team, F.array("candidate")).alias("team")).unionByName(rates.sparkSession.range(1).select(F.lit(None).cast("long").alias("candidate"), team.alias("team")))
        groups = ["ad_share", *[f"{c}_group" for c in ("front", "poke", "wave", "engage", "lacks")]]
        comp = composition_score(team_composition(teams, entities, "candidate")).select("candidate", "composition_score", damage_mix(F.col("ad_share"), fix_ad_share).alias("mix"), F.struct(*groups).alias("after"))
        before = comp.where("candidate IS NULL").select(F.col("composition_score").alias("_score"), F.col("mix").alias("_mix"), F.col("after").alias("before"))
        rows = rows.join(comp, "candidate").crossJoin(F.broadcast(before))  # one row
        rows = rows.withColumn("composition_delta", F.col("composition_score") - F.col("_score")).withColumn("mix_delta", F.col("mix") - F.col("_mix")).drop("composition_score", "mix", "_score", "_mix")
    sure = 0.5 + 0.5 * F.col("coverage") / len(picks)
    rows = rows.withColumn("mix_part", est.clip(MIX_WEIGHT * F.col("mix_delta") * sure, -MIX_CLAMP, MIX_CLAMP))
    rows = rows.withColumn("composition_part", COMPOSITION_WEIGHT * F.col("composition_delta") * sure + F.col("mix_part"))
    fit = F.col("pair_fit") + F.col("composition_part")
    rows = checkpointed(rows.withColumn("fit", fit).withColumn("_fit", F.round("fit", 12)))  # a row a candidate, for both ends
    keys = ["_fit", "pair_fit", "avg_lift", "avg_z", "coverage", "min_games"]
    top = rows.orderBy(*[F.desc(k) for k in keys], "candidate").limit(limit - 1)
    worst = rows.join(top.select("candidate"), "candidate", "left_anti").orderBy(*[F.asc(k) for k in keys], F.desc("candidate")).limit(1)
    return top.withColumn("place", F.lit("best")).unionByName(worst.withColumn("place", F.lit("worst"))).drop("_fit")


def recommendation_labels(rows: DataFrame, picks: int) -> DataFrame:
    """Words for the strength, the confidence and the reason of ``recommend`` rows.

    Strength follows the fit; confidence the share of picks covered, the fewest games and the size of the mean z. The reason is what
    the candidate does to the team: to its damage if that part counts, else the first gap that it fills, else the change in percent.
    """
    covered, signal = F.col("coverage") / picks, F.abs("avg_z")
    strength = F.when(F.col("fit") >= 0.05, "excellent fit").when(F.col("fit") >= 0.03, "good fit").when(F.col("fit") >= 0.01, "playable fit").otherwise("low edge")
    sure = F.when((covered >= 0.75) & (F.col("min_games") >= 60) & (signal >= 1), "high confidence")
    sure = sure.when((covered >= 0.5) & (F.col("min_games") >= 40) & (signal >= 0.6), "medium confidence").otherwise("early signal")
    if "after" not in rows.columns:
        return rows.select("*", strength.alias("strength"), sure.alias("confidence"), F.lit("team neutral").alias("reason"))
    part, mix = F.col("composition_part"), F.col("mix_part")
    change = F.format_string("%+.1f%%", part * 100)
    adds = lambda what: F.concat(F.lit(f"adds {what} "), change)
    fills = lambda c: (F.col(f"before.{c}_group") == f"{c} lack") & (F.col(f"after.{c}_group") == f"{c} ok")
    moved = lambda c: F.col(f"before.{c}_group") != F.col(f"after.{c}_group")
    gain = F.when(moved("front") & (F.col("after.front_group") != "0 front"), adds("frontline")).when(fills("poke"), adds("poke"))
    gain = gain.when(fills("wave"), adds("waveclear")).when(fills("engage"), adds("engage")).when(moved("lacks"), F.concat(F.lit("rounds team "), change))
    skew = F.when(mix <= 0, F.concat(F.lit("damage skew "), change)).when(F.col("after.ad_share") > F.col("before.ad_share"), adds("AD")).otherwise(adds("AP"))
    plain = F.when(F.abs(part) < 0.001, "team neutral").otherwise(F.concat(F.lit("team "), change))
    reason = F.when(F.abs(mix) >= 0.004, skew).when(part > 0.001, F.coalesce(gain, plain)).otherwise(plain)
    return rows.select("*", strength.alias("strength"), sure.alias("confidence"), reason.alias("reason"))


#: Weights up to which they are one map inside the row.
SMALL = 4096


def _weight_map(weights: DataFrame, small: int) -> DataFrame | None:
    """One row with a map of the weights, or None if they are more than ``small``."""
    rows = weights.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.max("weight").alias("weight"))
    if rows.limit(small + 1).count() > small:
        return None
    return rows.agg(F.map_from_entries(F.collect_list(F.struct(F.col("entity_id").cast("long"), "weight"))).alias("_weights"))


def team_probability(teams: DataFrame, weights: DataFrame, key: str = "game_id", small: int = SMALL) -> DataFrame:
    """sigmoid of the summed weights against an unknown opponent, and how many members have none.

    At most ``small`` weights are looked up inside the row, and nothing is shuffled; more are joined to the members.
    """
    table = _weight_map(weights, small)
    if table is None:
        rows = teams.select(key, F.explode("team").alias("entity_id")).join(weights.select("entity_id", "weight"), "entity_id", "left")
        rows = rows.groupBy(key).agg(F.sum(F.coalesce("weight", F.lit(0.0)).cast("decimal(30,12)")).cast("double").alias("logit"), F.count_if(F.col("weight").isNull()).alias("unknown"))
    else:
        own = F.transform("team", lambda e: F.col("_weights")[e.cast("long")])
        rows = teams.where(F.size("team") > 0).crossJoin(F.broadcast(table)).select(key, own.alias("_own"))  # one row
        total = F.aggregate("_own", F.lit(0).cast("decimal(30,12)"), lambda acc, w: (acc + F.coalesce(w, F.lit(0.0)).cast("decimal(30,12)")).cast("decimal(30,12)"))
        rows = rows.select(key, total.cast("double").alias("logit"), F.size(F.filter("_own", lambda w: w.isNull())).cast("long").alias("unknown"))
    return rows.withColumn("p", est.sigmoid("logit"))


def swap_suggestions(sessions: DataFrame, weights: DataFrame, key: str = "game_id", small: int = SMALL) -> DataFrame:
    """For each session (team, current, bench): keeping or swapping in each of the bench; probability, change, z of the weight, order.

    Unknown entities come last. At most ``small`` weights are looked up inside the row; more are joined.
    """
    moments = weights.agg(F.avg("weight").alias("mu"), F.stddev_pop("weight").alias("sd"))
    table = _weight_map(weights, small)
    candidates = F.explode(F.concat(F.array("current"), "bench")).alias("candidate")
    if table is None:
        base = team_probability(sessions, weights, key, small).select(key, F.col("logit").alias("_whole"))
        rows = sessions.select(key, "current", candidates).join(base, key)
        w = lambda c, n: weights.select(F.col("entity_id").alias(c), F.col("weight").alias(n))
        rows = rows.join(w("current", "_out"), "current", "left").join(w("candidate", "_in"), "candidate", "left")
    else:
        of = lambda c: F.col("_weights")[F.col(c).cast("long")]
        whole = F.aggregate("team", F.lit(0.0), lambda acc, e: acc + F.coalesce(F.col("_weights")[e.cast("long")], F.lit(0.0)))
        rows = sessions.crossJoin(F.broadcast(table)).select(key, "current", "_weights", whole.alias("_whole"), of("current").alias("_out"), candidates)  # one row
        rows = rows.withColumn("_in", of("candidate")).drop("_weights")
    rows = rows.crossJoin(F.broadcast(moments))  # one row
    p = est.sigmoid(F.col("_whole") - F.coalesce("_out", F.lit(0.0)) + F.coalesce("_in", F.lit(0.0)))
    rows = rows.select(key, "current", "candidate", F.col("_in").isNotNull().alias("known"), p.alias("p"), (p - est.sigmoid("_whole")).alias("delta"), ((F.col("_in") - F.col("mu")) / F.col("sd")).alias("z"))
    order = Window.partitionBy(key).orderBy(F.desc("known"), F.desc("delta"), "candidate")
    return rows.withColumn("rank", F.row_number().over(order))


def blended_swap_score(sessions: DataFrame, deltas: DataFrame, weights: DataFrame, key: str = "game_id", small: int = SMALL, most: int = 8) -> DataFrame:
    """.7 of the mean pair difference beside the rest of the team and .3 of the probability change; with covered anchors.

    With at most ``small`` weights, 16 * ``small`` pairs and ``most`` others in a team, a candidate's row takes the difference beside each of them from a
    broadcast of the pairs, and nothing is shuffled; else candidates and team mates are joined.
    """
    rest = F.array_except("team", F.array("current"))
    pairs = deltas.select("anchor", F.col("mate").alias("candidate"), F.col("delta").alias("_d"))
    mates = sessions.agg(F.max(F.size(rest)).alias("n")).first()["n"] or 0
    table = _weight_map(weights, small)
    if table is None or mates > most or pairs.limit(16 * small + 1).count() > 16 * small:
        swaps = swap_suggestions(sessions, weights, key, small)
        rows = swaps.select(key, "candidate").join(sessions.select(key, F.explode(rest).alias("anchor")), key).join(pairs, ["anchor", "candidate"], "left")
        mean = rows.groupBy(key, "candidate").agg(F.avg("_d").alias("synergy"), F.count("_d").alias("anchors"))
        rows = swaps.join(mean, [key, "candidate"])
    else:
        whole = F.aggregate("team", F.lit(0.0), lambda acc, e: acc + F.coalesce(F.col("_weights")[e.cast("long")], F.lit(0.0)))
        out = F.coalesce(F.col("_weights")[F.col("current").cast("long")], F.lit(0.0))
        rows = sessions.crossJoin(F.broadcast(table)).select(key, "current", "bench", rest.alias("_rest"), whole.alias("_whole"), out.alias("_out")).where(F.size("_rest") > 0)  # one row
        others = [F.get("_rest", F.lit(i)).alias(f"_e{i}") for i in range(mates)]
        rows = rows.select(key, "current", "_whole", "_out", *others, F.explode(F.concat(F.array("current"), "bench")).alias("candidate"))
        own = weights.groupBy(F.col("entity_id").alias("candidate")).agg(F.max("weight").alias("_in"))
        rows = rows.join(F.broadcast(own), "candidate", "left")  # at most ``small`` rows
        for i in range(mates):  # at most 16 * ``small`` rows, one broadcast for all
            beside = pairs.select(F.col("anchor").alias(f"_a{i}"), F.col("candidate").alias("_c"), F.col("_d").alias(f"_d{i}"))
            rows = rows.join(F.broadcast(beside), (F.col(f"_e{i}") == F.col(f"_a{i}")) & (F.col("candidate") == F.col("_c")), "left").drop("_c", f"_a{i}")
        n = sum((F.col(f"_d{i}").isNotNull().cast("long") for i in range(mates)), F.lit(0).cast("long"))
        total = sum((F.coalesce(f"_d{i}", F.lit(0.0)) for i in range(mates)), F.lit(0.0))
        p = est.sigmoid(F.col("_whole") - F.col("_out") + F.coalesce("_in", F.lit(0.0)))
        rows = rows.select(key, "current", "candidate", (p - est.sigmoid("_whole")).alias("delta"), F.when(n > 0, total / n).alias("synergy"), n.alias("anchors"))
    score = 0.7 * F.coalesce("synergy", F.lit(0.0)) + 0.3 * F.col("delta")
    return rows.select(key, "current", "candidate", "delta", "synergy", "anchors", score.alias("score"))


def weight_tier_list(weights: DataFrame) -> DataFrame:
    """Weight, its worth in percent points, shrunk and raw rate."""
    return weights.select("entity_id", "games", "weight", (F.col("weight") * 25).alias("points"), est.bayes_rate("wins", "games", 0.5, 30).alias("bayes"), est.raw_rate("wins", "games").alias("win_rate"))


def extreme_teams(weights: DataFrame, n: int = 5) -> DataFrame:
    """Probability of a team of the n heaviest entities, and of the n lightest."""
    top = weights.orderBy(F.desc("weight"), "entity_id").limit(n).agg(F.sum("weight").alias("logit")).withColumn("team", F.lit("top"))
    low = weights.orderBy(F.asc("weight"), "entity_id").limit(n).agg(F.sum("weight").alias("logit")).withColumn("team", F.lit("bottom"))
    return top.unionByName(low).select("team", est.sigmoid("logit").alias("p"))
