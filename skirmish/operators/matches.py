"""Filters, validity, merging and reports over captured matches; parsing of raw match records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import text as tx

#: Modes by name.
MODES = {"KIWI": 2400, "ARAM": 450}
SIDES = (100, 200)


def mode_in(df: DataFrame, modes: list[int] | None) -> DataFrame:
    return df.where(F.col("queue_id").isin(modes)) if modes else df


def version_prefix(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Versions that begin with any of the texts; 16.1 takes 16.10 too."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.col("patch").startswith(p)
    return df.where(found) if prefixes else df


def version_minor_in(df: DataFrame, minors: list[str]) -> DataFrame:
    return df.where(tx.truncate_version(F.col("patch"), 2).isin(minors))


def min_duration(df: DataFrame, sec: int = 300) -> DataFrame:
    return df.where(F.col("duration_sec") >= sec)


def max_leaver_gap(df: DataFrame, sec: int = 120) -> DataFrame:
    return df.where(F.col("max_leaver_gap_sec") <= sec)


def min_games(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("games") >= n)


def reject_reason(modes: list[int], minors: list[str], duration: int = 300, gap: int = 120) -> Column:
    """First rule that a match fails, null if none: parse, queue, duration, leaver, patch."""
    return (
        F.when((F.size("blue") != 5) | (F.size("red") != 5), "parse").when(~F.col("queue_id").isin(modes), "queue").when(F.col("duration_sec") < duration, "duration")
        .when(F.col("max_leaver_gap_sec") > gap, "leaver").when(~tx.truncate_version(F.col("patch"), 2).isin(minors), "patch")
    )


def reject_audit(df: DataFrame, modes: list[int], minors: list[str]) -> DataFrame:
    return df.groupBy(F.coalesce(reject_reason(modes, minors), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def resolve_mode(queue: Column, name: Column) -> Column:
    """The queue unless it is -1 or missing, else the mode of the name, else -1."""
    named = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])
    return F.coalesce(F.nullif(queue, F.lit(-1)), named[name], F.lit(-1))


def all_known(df: DataFrame, arrays: list[str], vocab: DataFrame, column: str = "entity_id") -> DataFrame:
    """Rows of matches whose array elements all are in the vocabulary (a table of any size)."""
    each = df.select("game_id", F.explode(F.array_distinct(F.concat(*arrays))).alias(column))
    return df.join(each.join(vocab, column, "left_anti").select("game_id").distinct(), "game_id", "left_anti")


def min_group_count(df: DataFrame, key: str, n: int = 500) -> DataFrame:
    kept = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(key)
    return df.join(kept, key, "left_semi")


def pack_attributes(columns: list[Column]) -> Column:
    """Attributes of numbered columns, zeros and nulls away."""
    return F.filter(F.array(*columns), lambda x: x > 0)


def build_participants(participants: Column) -> Column:
    """Participants of the two sides with an entity, in order of side and entity, reduced to what is analysed."""
    attrs = lambda p: pack_attributes([p["stats"][f"playerAugment{i}"] for i in range(1, 7)])
    kept = F.filter(participants, lambda p: p["teamId"].isin(*SIDES) & (p["championId"] > 0))
    return F.array_sort(F.transform(kept, lambda p: F.struct(p["teamId"].alias("teamId"), p["championId"].alias("championId"), attrs(p).alias("augments"))))


def row_valid() -> Column:
    """Whether a decoded captured match is whole; false, never null."""
    team = lambda c: (F.size(c) == 5) & F.forall(c, lambda x: x.isNotNull() & x.between(1, 9999))
    payload = F.col("participants_json").isNull() | (F.col("participants_json") == "") | (
        (F.size("participants") == 10) & F.forall("participants", lambda p: p["teamId"].isin(*SIDES) & p["championId"].between(1, 9999))
    )
    ok = F.col("blue_wins").isin(0, 1) & team("blue") & team("red") & (F.col("duration_sec") >= 300) & payload
    return F.coalesce(ok, F.lit(False))


def has_forbidden_keys(payload: Column, keys: list[str]) -> Column:
    """Whether any object of a JSON array has one of the keys; broken and missing payloads have none."""
    objects = F.from_json(payload, "array<string>")
    return F.coalesce(F.exists(objects, lambda o: F.arrays_overlap(F.coalesce(F.json_object_keys(o), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in keys]))), F.lit(False))


def found_entities(entities: DataFrame, role: str | None, text: str) -> DataFrame:
    """Entities with a role chip (any, if none is asked for) whose name, alias or tags contain the trimmed text, in any case."""
    blob = F.lower(F.concat_ws(" ", "name", "alias", F.array_join("tags", " ")))
    rows = entities.where(blob.contains(text.strip().lower()))
    return rows.where(F.array_contains("tags", role)) if role else rows


def search_entities(entities: DataFrame, role: str | None, text: str) -> DataFrame:
    """How many of ``found_entities`` each tier has."""
    return found_entities(entities, role, text).groupBy("tier").agg(F.count("*").alias("n"))


def conform(df: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with the columns of a schema: missing ones null or their default, nulls as the default."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    out = []
    for f in wanted:
        value = (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType)
        default = (defaults or {}).get(f.name)
        out.append((F.coalesce(value, F.lit(default)) if default is not None else value).cast(f.dataType).alias(f.name))
    return df.select(*out)


def backfill_family(family: Column, source: Column, roots: list[str]) -> Column:
    """A known family stays; a root source names its own; match is legacy_match; else unknown."""
    return F.when(F.coalesce(family, F.lit("")) != "", family).when(source.isin(roots), source).when(source == "match", "legacy_match").otherwise("unknown")


def drop_bad_ids(df: DataFrame, source: str = "riot_tier", length: int = 36) -> DataFrame:
    return df.where(~((F.col("source") == source) & (F.length("actor_id") != length)))


def backfill_payload(old: Column, new: Column) -> Column:
    """The old payload unless it is null or empty; an empty list is a payload."""
    return F.coalesce(F.nullif(old, F.lit("")), new)


def new_rows(batch: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """First row of each key of the batch that the base lacks."""
    return dedup_by_id(batch.join(base.select(key).distinct(), key, "left_anti"), key, ["created_ms"])


def dedup_by_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by the order, by aggregation: rows meet only their own partial result before the shuffle."""
    rest = [c for c in df.columns if c != key]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(key).agg(F.min(ordered).alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def merge_games(sources: DataFrame) -> DataFrame:
    """One row for each game: the first by source and time, with the first payload that isn't empty."""
    order = F.struct("source_rank", "created_ms")
    payload = F.nullif(F.col("participants_json"), F.lit(""))
    rest = [c for c in sources.columns if c not in ("game_id", "participants_json")]
    rows = sources.groupBy("game_id").agg(
        F.min(F.struct("source_rank", "created_ms", *[c for c in rest if c not in ("source_rank", "created_ms")])).alias("r"),
        F.min_by(payload, F.when(payload.isNotNull(), F.struct(order.alias("o"), payload.alias("p")))).alias("participants_json"),
    )
    return rows.select("game_id", *[F.col(f"r.{c}").alias(c) for c in rest], "participants_json")


def merge_report(sources: DataFrame) -> DataFrame:
    """For each source: rows read, games it brought in, payloads it filled in for games of earlier sources."""
    rows = sources.groupBy("game_id", "source_rank").agg(F.count("*").alias("n"), F.max(F.col("participants_json").isNotNull() & (F.col("participants_json") != "")).alias("full"))
    by_game = Window.partitionBy("game_id")
    rows = rows.withColumn("first", F.min("source_rank").over(by_game)).withColumn("first_full", F.min(F.when(F.col("full"), F.col("source_rank"))).over(by_game))
    return rows.groupBy("source_rank").agg(
        F.sum("n").alias("rows_read"), F.count_if(F.col("source_rank") == F.col("first")).alias("inserted"),
        F.count_if((F.col("source_rank") == F.col("first_full")) & (F.col("first") < F.col("source_rank"))).alias("backfilled"),
    )


def export_share(captured: DataFrame, modes: list[int] | None, prefixes: list[str]) -> DataFrame:
    """Facts only, without discovery columns, for the given modes and versions."""
    facts = ["game_id", "queue_id", "patch", "blue_champs", "red_champs", "blue_wins", "duration_sec", "created_ms", "participants_json"]
    return version_prefix(mode_in(captured, modes), prefixes).select(*facts)


def share_summary(shared: DataFrame) -> DataFrame:
    """Games, modes, versions, base rate, and a title: the one version, the one with 60 % or more, else lowest to highest."""
    minor = tx.truncate_version(F.col("patch"), 2)
    by = shared.groupBy(minor.alias("version")).agg(F.count("*").alias("n"), F.sum("blue_wins").alias("w"), F.collect_set("queue_id").alias("modes"))
    key = tx.version_parts(F.col("version"))
    rows = by.agg(
        F.sum("n").alias("games"), F.array_size(F.array_distinct(F.flatten(F.collect_list("modes")))).cast("long").alias("modes"), F.count("*").alias("versions"), F.sum("w").alias("_w"),
        F.max_by("version", F.struct("n", "version")).alias("_top"), F.max("n").alias("_most"), F.min_by("version", key).alias("_low"), F.max_by("version", key).alias("_high"),
    )
    title = F.when(F.col("versions") == 1, F.col("_top")).when(F.col("_most") >= 0.6 * F.col("games"), F.col("_top")).otherwise(F.concat("_low", F.lit("-"), "_high"))
    return rows.select("games", "modes", "versions", F.round(F.col("_w") / F.col("games"), 6).alias("base_rate"), title.alias("title"))


def verify_report(df: DataFrame, source: str = "source", modes: tuple[int, ...] = (450, 2400)) -> DataFrame:
    """For each source of decoded matches: rows, bad rows, repeated ids, base rate, odd modes, and warnings."""
    # one row an id first, so that distinct ids are a count and each payload is read once
    each = df.groupBy(source, "game_id").agg(
        F.count("*").alias("n"), F.count_if(~row_valid()).alias("bad"), F.sum("blue_wins").alias("wins"), F.count("blue_wins").alias("known"), F.count_if(~F.col("queue_id").isin(*modes)).alias("odd_modes"),
        F.count_if(has_forbidden_keys(F.col("participants_json"), ["puuid", "summonerName", "gameName"])).alias("identities"),
    )
    total = lambda c: F.sum(c).alias(c)
    rows = each.groupBy(source).agg(F.sum("n").alias("total"), total("bad"), (F.sum("n") - F.count("game_id")).alias("repeated"), F.round(F.sum("wins").cast("double") / F.sum("known"), 6).alias("base_rate"), total("odd_modes"), total("identities"))
    said = [("bad rows", F.col("bad") > 0), ("repeated ids", F.col("repeated") > 0), ("base rate out of range", ~F.col("base_rate").between(0.40, 0.60)), ("odd modes", F.col("odd_modes") > 0), ("identities", F.col("identities") > 0)]
    return rows.withColumn("warnings", F.array_compact(F.array(*[F.when(c, t) for t, c in said])))


def verify_share(df: DataFrame, source: str = "source", strict: bool = False) -> DataFrame:
    """The report with a verdict; in strict mode any warning fails, else only bad rows and identities."""
    bad = F.size("warnings") > 0 if strict else (F.col("bad") > 0) | (F.col("identities") > 0)
    return verify_report(df, source).withColumn("passed", ~bad)


def tally(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts for several groupings in one pass."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([tuple(s) for s in sets], *names).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def unexpected_values(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.where(~F.col(column).isin(allowed) | F.col(column).isNull()).select(column).distinct()


def forbidden_names(names: list[str], forbidden: list[str]) -> list[str]:
    return sorted(set(names) & set(forbidden))


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def ordered_distinct(df: DataFrame, key: str, position: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(position).alias(position)).orderBy(position, key)


def union_sorted(frames: list[DataFrame], order: list[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(*order)


# raw records

DETAIL = "metadata struct<matchId:string>, info struct<participants:array<struct<teamId:int,championId:int,timePlayed:int,puuid:string>>,teams:array<struct<teamId:int,win:boolean>>,gameVersion:string,queueId:int,platformId:string,gameDuration:int,gameCreation:long,gameEndTimestamp:long>"
END_BLOCK = "gameId long, gameMode string, gameLength int, endOfGameTimestamp long, teams array<struct<teamId:int,isWinningTeam:boolean,players:array<struct<championId:int,stats:struct<" + ",".join(f"playerAugment{i}:int" for i in range(1, 7)) + ">>>>>"
GAME_DETAIL = "gameId long, queueId int, gameMode string, gameDuration int, gameCreation long, gameVersion string, participants array<struct<teamId:int,championId:int,stats:struct<win:string," + ",".join(f"playerAugment{i}:int" for i in range(1, 7)) + ">>>, teams array<struct<teamId:int,win:string>>"


def parsed_once(record: Column) -> Column:
    """The record as the one row of a generator: filters and fields above use its result, where they would each parse the text again."""
    return F.explode(F.array(record))


def _team(participants: Column, side: int) -> Column:
    return F.array_sort(F.transform(F.filter(participants, lambda p: p["teamId"] == side), lambda p: p["championId"]))


def _whole(df: DataFrame) -> DataFrame:
    return df.where((F.size("blue") == 5) & (F.size("red") == 5) & F.forall(F.concat("blue", "red"), lambda x: F.coalesce(x > 0, F.lit(False))) & F.col("blue_wins").isNotNull())


def flatten_match_detail(raw: DataFrame, column: str = "json") -> DataFrame:
    """Match rows of nested details; records without ten participants, two known sides, five entities each and a blue result go."""
    p = F.col("d.info.participants")
    rows = raw.select(parsed_once(F.from_json(column, DETAIL)).alias("d")).where((F.size(p) == 10) & F.forall(p, lambda x: x["teamId"].isin(*SIDES)))
    blue = F.element_at(F.filter("d.info.teams", lambda t: t["teamId"] == 100), 1)
    return _whole(rows.where(F.exists("d.info.teams", lambda t: t["teamId"] == 100)).select(
        F.col("d.metadata.matchId").alias("match_id"), F.col("d.info.gameVersion").alias("patch"), F.col("d.info.queueId").alias("queue_id"), F.col("d.info.platformId").alias("platform"),
        F.col("d.info.gameDuration").alias("duration_sec"), _team(p, 100).alias("blue"), _team(p, 200).alias("red"), blue["win"].alias("blue_wins"),
        F.col("d.info.gameCreation").alias("game_creation_ms"), F.col("d.info.gameEndTimestamp").alias("game_end_ms"),
        F.array_max(F.transform(p, lambda x: F.col("d.info.gameDuration") - x["timePlayed"])).alias("max_leaver_gap_sec"),
    ))


def flatten_end_block(raw: DataFrame, column: str = "json") -> DataFrame:
    """Match rows of end-of-game blocks of known modes with 300 seconds or more."""
    rows = raw.select(parsed_once(F.from_json(column, END_BLOCK)).alias("d"))
    players = F.flatten(F.transform("d.teams", lambda t: F.transform(t["players"], lambda p: F.struct(t["teamId"].alias("teamId"), p["championId"].alias("championId"), p["stats"].alias("stats")))))
    win = F.exists("d.teams", lambda t: (t["teamId"] == 100) & t["isWinningTeam"])
    rows = rows.select("d", players.alias("p")).select(
        F.col("d.gameId").cast("string").alias("game_id"), resolve_mode(F.lit(None).cast("int"), F.col("d.gameMode")).alias("queue_id"), F.col("d.gameLength").alias("duration_sec"),
        _team(F.col("p"), 100).alias("blue"), _team(F.col("p"), 200).alias("red"), win.cast("int").alias("blue_wins"),
        (F.col("d.endOfGameTimestamp") - F.col("d.gameLength") * 1000).alias("created_ms"), F.to_json(build_participants(F.col("p"))).alias("participants_json"),
    )
    return _whole(rows.where((F.col("queue_id") > 0) & (F.col("duration_sec") >= 300)))


def flatten_game_detail(raw: DataFrame, column: str = "json") -> DataFrame:
    """Match rows of game details; the winner from the teams' flag or word, else from the first blue participant."""
    rows = raw.select(parsed_once(F.from_json(column, GAME_DETAIL)).alias("d")).withColumn("p", F.col("d.participants"))
    word = lambda w: F.when(F.lower(w).isin("win", "true"), 1).when(F.lower(w).isin("fail", "false"), 0)
    team = F.get(F.filter("d.teams", lambda t: t["teamId"] == 100), F.lit(0))["win"]
    first = F.get(F.filter("p", lambda x: x["teamId"] == 100), F.lit(0))["stats"]["win"]
    return _whole(rows.select(
        F.col("d.gameId").cast("string").alias("game_id"), resolve_mode(F.col("d.queueId"), F.col("d.gameMode")).alias("queue_id"), tx.truncate_version(F.col("d.gameVersion"), 3).alias("patch"),
        F.col("d.gameDuration").alias("duration_sec"), _team(F.col("p"), 100).alias("blue"), _team(F.col("p"), 200).alias("red"), F.coalesce(word(team), word(first)).alias("blue_wins"),
        F.col("d.gameCreation").alias("created_ms"), F.to_json(build_participants(F.col("p"))).alias("participants_json"),
    ).where(F.col("duration_sec") >= 300))


def normalize_history(raw: DataFrame, column: str = "json") -> DataFrame:
    """(position, game) of a history record in any of its four shapes: nested, flat, one object, bare list."""
    text = F.col(column)
    nested, flat = F.get_json_object(text, "$.games.games"), F.get_json_object(text, "$.games")
    bare = F.when(F.ltrim(text).startswith("["), text)
    single = F.when(F.get_json_object(text, "$.gameId").isNotNull(), F.concat(F.lit("["), text, F.lit("]")))
    found = F.from_json(F.coalesce(nested, F.when(F.ltrim(flat).startswith("["), flat), bare, single), "array<string>")
    return raw.select("*", F.posexplode(found).alias("position", "game"))


def build_dimension(en: DataFrame, zh: DataFrame, key: str, overrides: DataFrame | None = None) -> DataFrame:
    """Names of both languages by key, the English one where the other lacks; overrides win."""
    rows = en.select(key, F.col("name").alias("name_en")).join(zh.select(key, F.col("name").alias("name_zh")), key, "left")
    if overrides is not None:
        rows = rows.join(overrides.select(key, F.col("name").alias("_name")), key, "left")
    else:
        rows = rows.withColumn("_name", F.lit(None).cast("string"))
    return rows.select(key, "name_en", F.coalesce("name_zh", "name_en").alias("name_zh"), F.coalesce("_name", "name_zh", "name_en").alias("name"))


def resolve_text(ids: DataFrame, keys: DataFrame, strings: DataFrame) -> DataFrame:
    """Text of ids over two hops: the summary's text, else the tooltip's; ids without either go."""
    s = strings.select(F.col("key").alias("summary_key"), F.nullif(F.col("text"), F.lit("")).alias("_s"))
    t = strings.select(F.col("key").alias("tooltip_key"), F.nullif(F.col("text"), F.lit("")).alias("_t"))
    rows = ids.join(keys, "id").join(s, "summary_key", "left").join(t, "tooltip_key", "left")
    return rows.select("id", F.coalesce("_s", "_t").alias("text")).where("text is not null")


def resolve_alias(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Ids of aliases; an unknown alias has none."""
    known = dim.select(F.lower("alias").alias("_alias"), F.col("entity_id"))
    return df.join(known, F.lower("alias") == F.col("_alias"), "left").drop("_alias")


def bridge_ids(df: DataFrame, bridge: DataFrame) -> DataFrame:
    """Internal ids of public ones, with resolve_status: resolved, failed (known without id) or pending."""
    rows = df.join(bridge.select("public_id", "actor_id", F.lit(True).alias("_known")), "public_id", "left")
    status = F.when(F.col("actor_id").isNotNull(), "resolved").when(F.col("_known"), "failed").otherwise("pending")
    return rows.withColumn("resolve_status", status).drop("_known")


def parse_session(raw: DataFrame, column: str = "json") -> DataFrame:
    """Team, own entity and bench of a pick session; no row if a cell has no entity or the own cell isn't in the team."""
    shape = "localPlayerCellId int, myTeam array<struct<cellId:int,championId:int>>, benchChampions array<struct<championId:int>>, benchEnabled boolean"
    rows = raw.select("*", parsed_once(F.from_json(column, shape)).alias("d"))
    own = F.get(F.filter("d.myTeam", lambda c: c["cellId"] == F.col("d.localPlayerCellId")), F.lit(0))["championId"]
    rows = rows.where((F.size("d.myTeam") > 0) & F.forall("d.myTeam", lambda c: F.coalesce(c["championId"] > 0, F.lit(False))) & own.isNotNull())
    bench = F.when(F.col("d.benchEnabled"), F.array_sort(F.transform("d.benchChampions", lambda c: c["championId"]))).otherwise(F.array().cast("array<int>"))
    return rows.select(*raw.columns, F.array_sort(F.transform("d.myTeam", lambda c: c["championId"])).alias("team"), own.alias("current"), bench.alias("bench"))


