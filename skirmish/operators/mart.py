"""The published mart: one nested record for each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_pairs(pairs: DataFrame, visible: DataFrame) -> DataFrame:
    """Pairs whose mate is among the entities shown."""
    return pairs.join(visible.select(F.col("entity_id").alias("mate")), "mate", "left_semi")


def entity_mart(tiers: DataFrame, ends: DataFrame, pairs: DataFrame, n: int = 5) -> DataFrame:
    """tiers' row of each entity with best and worst attributes by rarity and its pairs, rounded to four places.

    ``ends`` is top_bottom_per_group() by (entity, rarity); ``pairs`` has anchor, mate, games, raw, expected, lift and z. A
    list holds at most n for each rarity, or one for each other entity; entities without any have empty lists.
    """
    short = lambda c, places=4: F.round(c, places).alias(c)
    pick = lambda rank: F.struct("rarity", F.col(rank).alias("rank"), "attribute_id", "games", short("rank_score"), short("lcb"))
    own = ends.groupBy("entity_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col(rank) <= n, pick(rank)))).alias(name) for name, rank in (("best", "top_rank"), ("worst", "bottom_rank"))
    ])
    mates = pairs.groupBy(F.col("anchor").alias("entity_id")).agg(F.sort_array(F.collect_list(F.struct(short("lift"), F.col("mate").alias("id"), F.col("games").alias("g"), short("raw"), short("expected"), short("z", 3))), False).alias("pairs"))
    rows = tiers.join(own, "entity_id", "left").join(mates, "entity_id", "left")
    return rows.select(*tiers.columns, *[F.when(F.col(c).isNull(), F.from_json(F.lit("[]"), t)).otherwise(F.col(c)).alias(c) for c, t in rows.select("best", "worst", "pairs").dtypes])


def used_attributes(mart: DataFrame, dim: DataFrame) -> DataFrame:
    """The attributes that the mart names."""
    named = mart.select(F.explode(F.concat("best.attribute_id", "worst.attribute_id")).alias("attribute_id"))
    return dim.join(named, "attribute_id", "left_semi")


def published_mart(tiers: DataFrame, ends: DataFrame, picks: DataFrame, pairs: DataFrame, categories: dict[str, tuple[DataFrame, str]], profiles: DataFrame, n: int = 5) -> DataFrame:
    """The whole record of each entity: tiers' columns, best and worst attributes by rarity, categories of each kind, pairs, and its profile.

    ``ends`` is top_bottom_per_group() over ranked attributes, ``picks`` is pick_lift(), ``categories`` has a name for each kind of category with its
    top_bottom_affinity() and that table's name column, ``profiles`` is entity_profiles(). Rates are rounded to four places, logarithms, z and profiles to three. What
    an entity has nothing of is an empty list, and its profile null.
    """
    at = lambda c, places=4: F.round(c, places)
    seen = ends.join(picks.select("entity_id", "attribute_id", "share", "peer_share", "pick_lift"), ["entity_id", "attribute_id"], "left")
    lift = F.col("posterior") - F.col("baseline")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    pick = lambda rank: F.struct(
        "rarity", F.col(rank).alias("rank"), F.col("attribute_id").alias("id"), F.col("games").alias("g"), at("posterior").alias("wr"), at(lift).alias("lift"), at("rank_score").alias("score"), at("lcb_lift").alias("lcb"),
        at(none("share")).alias("pick"), at(none("peer_share")).alias("peer_pick"), at(none("pick_lift"), 3).alias("pick_lift"),
    )
    out = tiers.join(seen.groupBy("entity_id").agg(*[F.array_sort(F.collect_list(F.when(F.col(rank) <= n, pick(rank)))).alias(name) for name, rank in (("best", "top_rank"), ("worst", "bottom_rank"))]), "entity_id", "left")
    for kind, (rows, name) in categories.items():
        row = lambda rank, name=name: F.struct(
            F.col(rank).alias("rank"), F.col(name).alias("name"), F.col("games").alias("g"), at("posterior").alias("wr"), at("lift").alias("lift"), at(F.col("lift") - F.col("residual")).alias("avg"), at("residual").alias("res"),
            at("lcb").alias("score"), at("ucb").alias("bad_score"),
        )
        own = rows.groupBy("entity_id").agg(F.struct(*[F.array_sort(F.collect_list(F.when(F.col(rank) <= 4, row(rank)))).alias(end) for end, rank in (("top", "top_rank"), ("bottom", "bottom_rank"))]).alias(kind))
        out = out.join(own, "entity_id", "left")
    mates = F.struct(at("lift").alias("lift"), F.col("mate").alias("id"), F.col("games").alias("g"), at("raw").alias("wr"), at("expected").alias("expected"), at("z", 3).alias("z"))
    out = out.join(pairs.groupBy(F.col("anchor").alias("entity_id")).agg(F.sort_array(F.collect_list(mates), False).alias("pairs")), "entity_id", "left")
    own = profiles.select("entity_id", F.struct(*[at(c, 3).alias(c) for c, t in profiles.dtypes if t == "double"]).alias("profile"))
    out = out.join(own, "entity_id", "left")
    kinds = dict(out.dtypes)
    empty = lambda c: F.coalesce(c, F.from_json(F.lit("[]" if kinds[c].startswith("array") else '{"top": [], "bottom": []}'), kinds[c])).alias(c)
    return out.select(*tiers.columns, *[empty(c) for c in ("best", "worst", *categories, "pairs")], "profile")
