"""Match data: a games view over the test tables, readers and writers of match tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.text import account_id
from skirmish.operators import dimensions as dims
from skirmish.operators import ordered

#: Categories that the items made of parts can have.
CATEGORIES = (
    "SpellDamage", "HealAndShieldPower", "CriticalStrike", "OnHit", "AttackSpeed", "Damage", "Health", "Armor", "SpellBlock", "MagicResist", "MagicPenetration", "ArmorPenetration", "Lethality",
    "LifeSteal", "Tenacity", "Active", "Slow", "AbilityHaste", "Mana",
)
PARTICIPANT = "array<struct<teamId:int,championId:int,augments:array<int>>>"
GAMES = "game_id string, queue_id int, patch string, blue_champs string, red_champs string, blue_wins int, duration_sec int, created_ms long, captured_at string, participants_json string, seed_family string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entity(slot: Column | int) -> Column:
    """The entity at a place (0 to 4 blue, 5 to 9 red) of an order's match."""
    k = F.col("o_orderkey")
    return 1 + ((k * 37 + 11) % 101 + slot * (1 + (k * 13) % 100)) % 101


def _attributes(entity: Column) -> Column:
    k = F.col("o_orderkey")
    return F.array(*[1000 + (entity * a + k * b) % 60 for a, b in ((7, 3), (11, 5), (13, 7))])


def _facts() -> dict[str, Column]:
    """Columns of a match that don't depend on its participants one by one."""
    k = F.col("o_orderkey")
    score = sum((((_entity(i) * 29) % 21 - 10) * (1 if i < 5 else -1) for i in range(10)), F.lit(0).cast("long")) + (k * 7919) % 121 - 60
    return {
        "game_id": k.cast("string"),
        "k": k,
        "queue_id": F.when(F.col("o_orderpriority") == "1-URGENT", 450).otherwise(2400),
        "patch": F.concat(F.lit("16."), (F.year("o_orderdate") - 1990).cast("string"), F.lit("."), (700 + F.month("o_orderdate")).cast("string")),
        "created_ms": F.unix_millis(F.col("o_orderdate").cast("timestamp")),
        "actor_id": F.col("o_custkey"),
        "duration_sec": 240 + (k * 17) % 1500,
        "has_payload": k % 10 != 0,
        "blue_wins": (score >= 0).cast("int"),
    }


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match for each order, with both teams and the participants in arrays; made inside the row, without a shuffle.

    Every column is plain arithmetic over ten fixed places, so columns that nothing asks for cost nothing.
    """
    facts = _facts()

    def participant(slot: int) -> Column:
        entity, blue = _entity(slot), slot < 5
        return F.struct(
            F.lit(slot).alias("slot"), entity.alias("entity_id"), F.lit(100 if blue else 200).alias("team_id"), (((entity * 29) % 21 - 10) * (1 if blue else -1)).alias("weight"), _attributes(entity).alias("attributes")
        )

    facts |= {name: F.array_sort(F.array(*[_entity(i) for i in slots])) for name, slots in (("blue", range(5)), ("red", range(5, 10)))}
    facts["participants"] = F.array(*[participant(i) for i in range(10)])
    order = ["game_id", "k", "queue_id", "patch", "created_ms", "actor_id", "duration_sec", "has_payload", "blue", "red", "blue_wins", "participants"]
    return table(spark, sf_dir, "orders").select(*[facts[c].alias(c) for c in order])


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each participant: game_id, queue_id, patch, team_id, entity_id, win, attributes (null without payload)."""
    facts = _facts()
    own = ["game_id", "k", "queue_id", "patch", "created_ms", "duration_sec"]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[facts[c].alias(c) for c in (*own, "has_payload", "blue_wins")], F.explode(F.sequence(F.lit(0), F.lit(9))).alias("slot"))
    rows = rows.select("o_orderkey", *own, "has_payload", "blue_wins", F.when(F.col("slot") < 5, 100).otherwise(200).alias("team_id"), _entity(F.col("slot")).alias("entity_id"))
    win = ((F.col("blue_wins") == 1) == (F.col("team_id") == 100)).cast("int").alias("win")
    return rows.select(*own, "team_id", "entity_id", win, F.when(F.col("has_payload"), _attributes(F.col("entity_id"))).alias("attributes"))


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches in the capture form: JSON text arrays and payload."""
    payload = F.transform(
        F.array_sort(F.transform("participants", lambda p: F.struct(p["team_id"].cast("int").alias("teamId"), p["entity_id"].cast("int").alias("championId"), p["attributes"].cast("array<int>").alias("augments")))),
        lambda p: p,
    )
    return games(spark, sf_dir).select(
        "game_id", "queue_id", "patch", F.to_json("blue").alias("blue_champs"), F.to_json("red").alias("red_champs"), "blue_wins",
        F.col("duration_sec").cast("int").alias("duration_sec"), "created_ms",
        F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"),
        F.when(F.col("has_payload"), F.to_json(payload)).alias("participants_json"),
        F.element_at(F.array(*[F.lit(x) for x in ("ladder", "web", "friend", "match")]), ((F.col("k") % 4) + 1).cast("int")).alias("seed_family"),
    )


def attribute_dim(spark: SparkSession) -> DataFrame:
    """Dimension of the attributes that matches hold: rarity, set, slugs of its sets, and a text, all by the id."""
    i = F.col("id") - 1000
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    said = [w for words in (*dims.TYPE_WORDS.values(), dims.DAMAGE_WORDS) for w in words]
    return spark.range(1000, 1060).select(
        F.col("id").alias("attribute_id"), pick(("kPrismatic", "kGold", "kSilver"), F.col("id")).alias("rarity"), F.concat(F.lit("set-"), (F.col("id") % 9).cast("string")).alias("set"),
        F.array(pick(list(dims.SET_TYPES), i)).alias("slugs"), F.concat_ws(" ", pick(said, i * 7), pick(said, i * 11 + 5)).alias("text"),
    ).select("*", dims.peer_scope(F.col("text")).alias("scope"), dims.attribute_types(F.col("text"), F.col("slugs")).alias("types"))


def entity_dim(rates: DataFrame) -> DataFrame:
    """Dimension of the entities that occur: role, damage shares and seven scores, all by the id."""
    roles = F.array(*[F.lit(r) for r in ("Tank", "Fighter", "Mage", "Marksman", "Support", "Assassin")])
    e = F.col("entity_id")
    scores = {"wave": e * 3 % 13, "cc": e * 5 % 13, "engage": e * 11 % 11, "damage_score": e * 17 % 23, "poke": e * 19 % 9, "sustain": e * 23 % 7}
    rows = rates.select(
        e, F.element_at(roles, (e % 6 + 1).cast("int")).alias("role"), ((e * 13 % 101) / 100.0).cast("double").alias("physical"), (e * 7 % 4).cast("double").alias("front"),
        *[(v / 10.0).cast("double").alias(c) for c, v in scores.items()],
    )
    rows = rows.withColumn("magic", F.greatest(F.lit(0.0), 0.95 - F.col("physical")))
    return rows.withColumn("damage", dims.damage_bucket(F.col("physical"), F.col("magic"), F.col("role")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items made of the parts: name with a word of the item lists, three categories, price, and the style they give."""
    k = F.col("p_partkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    names = [*(w for words in dims.ITEM_WORDS.values() for w in words), *["plain"] * 100]
    kinds = [pick(CATEGORIES, k * 7), pick(CATEGORIES, k * 11 + 3), pick(CATEGORIES, k * 13 + 8)]
    rows = table(spark, sf_dir, "part").select(k.alias("item_id"), F.concat("p_name", F.lit(" "), pick(names, k * 17)).alias("name"), F.array(*kinds).alias("categories"), (1700 + k * 37 % 1500).alias("price"))
    return rows.select("*", dims.item_style(F.col("categories"), F.col("name"), F.col("price")).alias("style"))


def used_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, slot, item_id): the parts of an order's lines, dealt to the participants of its match."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("game_id"), (F.col("l_suppkey") % 10).alias("slot"), F.col("l_partkey").alias("item_id"))


def read_games(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Match fact in capture form; columns that the files lack are null."""
    wanted = spark.createDataFrame([], GAMES).schema
    found = spark.read.format(fmt).load(path)
    return found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def decoded(captured: DataFrame) -> DataFrame:
    """Capture form with real arrays: blue, red, participants (null where the payload is missing, empty or broken)."""
    array = lambda c: F.array_sort(F.from_json(c, "array<int>"))
    return captured.select(
        "*", array("blue_champs").alias("blue"), array("red_champs").alias("red"), F.from_json(F.nullif(F.col("participants_json"), F.lit("")), PARTICIPANT).alias("participants")
    )


def write_matches(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)


def export_matches(captured: DataFrame, modes: list[int] | None = None, platform: str = "local") -> DataFrame:
    """Training form of the captured matches: prefixed id, sorted arrays, boolean label, derived end time."""
    rows = decoded(captured if not modes else captured.where(F.col("queue_id").isin(modes)))
    return rows.select(
        F.concat(F.lit("LCU_"), "game_id").alias("match_id"), "patch", F.col("queue_id").cast("int").alias("queue_id"), F.lit(platform).alias("platform"), "duration_sec",
        F.col("blue").alias("blue_champions"), F.col("red").alias("red_champions"), (F.col("blue_wins") == 1).alias("blue_wins"),
        F.col("created_ms").alias("game_creation_ms"), (F.col("created_ms") + F.col("duration_sec") * 1000).alias("game_end_ms"), F.lit(0).alias("max_leaver_gap_sec"), "participants_json",
    )


def write_rates_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    """CSV in falling order of the keys; the header stands even without rows."""
    df.orderBy(*[F.desc(k) for k in keys]).write.option("header", True).mode("overwrite").csv(path)


def read_profiles(spark: SparkSession, primary: str, fallback: str | None = None) -> DataFrame:
    """Entity profiles from CSV; rows without a whole-number key go, a byte-order mark is taken off, the fallback serves if primary is absent."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(primary)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.option("header", True).csv(primary if there or not fallback else fallback)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    own = [F.col(c).try_cast("double").alias(c) for c in rows.columns if c != "champion_id"]
    return rows.select(F.col("champion_id").try_cast("int").alias("champion_id"), *own).where("champion_id is not null")


def append_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def tail_snapshots(spark: SparkSession, path: str, n: int, order: str = "captured_at_unix") -> DataFrame:
    """The n latest whole objects of a JSON-lines store."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc(order)).limit(n)


#: Columns of the training form of matches.
MATCHES = (
    "match_id string, patch string, queue_id int, platform string, duration_sec int, blue_champions array<int>, red_champions array<int>, blue_wins boolean, game_creation_ms long, game_end_ms long, "
    "max_leaver_gap_sec int, participants_json string"
)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Match fact in training form; columns that the files lack are null, and only columns that are asked for are read."""
    wanted = spark.createDataFrame([], MATCHES).schema
    found = spark.read.parquet(path)
    return found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def resolved(spark: SparkSession, paths: list[str], globs: list[str] | None = None, exclude: tuple[str, ...] = ()) -> list[str]:
    """Paths in the order given, then what each pattern matches by name; each once, without those excluded, by their full names.

    A path that doesn't exist stays, so that reading it fails; a pattern that matches nothing adds nothing.
    """
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def full(path: str) -> str:
        p = name(path)
        files = p.getFileSystem(conf)
        return files.makeQualified(p).toString().rstrip("/")

    found = [full(p) for p in paths]
    for pattern in globs or []:
        p = name(pattern)
        found += sorted(x.getPath().toString().rstrip("/") for x in p.getFileSystem(conf).globStatus(p) or [])
    gone = {full(p) for p in exclude}
    return [p for p in dict.fromkeys(found) if p not in gone]


def read_sources(spark: SparkSession, paths: list[str], exclude: tuple[str, ...] = (), globs: list[str] | None = None) -> DataFrame:
    """Several capture files as one table with their place in the list; a path given twice, or also found by a pattern, counts once, and what is excluded (the own output) not at all."""
    out = None
    for rank, path in enumerate(resolved(spark, paths, globs, exclude)):
        rows = read_games(spark, path).select("*", F.lit(rank).alias("source_rank"), F.lit(path).alias("source"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no source is left to read")
    return out


def read_seeds(spark: SparkSession, paths: list[str], ids: tuple[str, ...] = ()) -> DataFrame:
    """(seed, position): normalised ids, those given first, then those of text files, one a line; the first appearance counts, and positions run from 0.

    Order is that of the ids, then of the paths, of the files' names below a path, and of the lines, however files are split among tasks. A path that doesn't exist is left out.
    """
    name, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    place = F.struct(F.lit(-1).alias("rank"), F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.col("at"))
    rows = spark.createDataFrame(list(enumerate(ids)), "at long, value string").select("value", place.alias("place"))
    for rank, path in enumerate(paths):
        if not name(path).getFileSystem(conf).exists(name(path)):
            continue
        found = spark.read.text(path).select(
            "value", F.struct(F.lit(rank).alias("rank"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place")
        )  # lines of one block of a file are read in order, by one task
        rows = rows.unionByName(found)
    first = rows.select(account_id(F.col("value")).alias("seed"), "place").where("seed IS NOT NULL").groupBy("seed").agg(F.min("place").alias("place"))
    return ordered.placed(first, [], ["place"], "position").select("seed", "position")


def write_partitioned(df: DataFrame, path: str) -> None:
    """Matches by mode and minor version, so that filters on them prune folders."""
    minor = F.array_join(F.slice(F.split("patch", r"\."), 1, 2), ".")
    df.withColumn("version_minor", minor).write.option("compression", "zstd").mode("overwrite").partitionBy("queue_id", "version_minor").parquet(path)


def freeze_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write once and read back, so that all variants train on one input."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def round_ready(now: int, last: int, least: int = 30) -> bool:
    return now - last >= least


def export_weights(weights: DataFrame, path: str) -> None:
    weights.select("index", "id", "weight").write.mode("overwrite").json(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """Exported weights; an index that is missing or given twice is an error."""
    rows = spark.read.schema("index int, id long, weight double").json(path)
    n = rows.agg(F.count("*").alias("n"), F.count_distinct("index").alias("d"), F.max("index").alias("m")).first()
    if n["n"] != n["d"] or n["n"] and n["m"] != n["n"] - 1:
        raise ValueError("weights and ids don't match")
    return rows
