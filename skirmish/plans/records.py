"""Registered queries over raw records, dimensions and stores: what the games and reference tables hold is written as JSON, CSV or Parquet in the
shapes that the readers meet, with broken records among it, and read back by them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions import estimators as est
from skirmish.functions import text as tx
from skirmish.operators import discovery as dc
from skirmish.operators import matches as ma
from skirmish.operators import models as mo
from skirmish.operators import rates as rt
from skirmish.plans.registry import SCORED, SPLIT, query, rates, scored
from skirmish.sources import games as gm


def long_arrays(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("array<long>") for c in names})


def _json(df: DataFrame, **fields: Column) -> DataFrame:
    return df.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("json"))


def _stats(p: Column) -> Column:
    """Six numbered attributes of a participant; the second is zero at odd places, and the last three are always."""
    own = p["attributes"]
    second = F.when(p["slot"] % 2 == 1, F.lit(0).cast("long")).otherwise(own[1])
    return F.struct(*[x.alias(f"playerAugment{i}") for i, x in enumerate([own[0], second, own[2], F.lit(0), F.lit(0), F.lit(0)], 1)])


@query("""!SELECT 'M' || game_id match_id, patch, queue_id, 'EUW' platform, duration_sec, blue, red, blue_wins = 1 blue_wins, created_ms game_creation_ms, created_ms + duration_sec*1000 game_end_ms, (k*3) % 150 max_leaver_gap_sec
 FROM g WHERE k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0""")
def match_details(spark, d):
    """Nested details; every seventh has a participant without entity, every eleventh nine participants, every thirteenth no blue side."""
    g, k = gm.games(spark, d), F.col("k")
    gone = (k * 3) % 150
    people = F.transform("participants", lambda p: F.struct(
        p["team_id"].alias("teamId"), F.when((k % 7 == 0) & (p["slot"] == 3), 0).otherwise(p["entity_id"]).alias("championId"), (F.col("duration_sec") - F.when(p["slot"] == 0, gone).otherwise(0)).alias("timePlayed")
    ))
    people = F.when(k % 11 == 0, F.slice(people, 1, 9)).otherwise(people)
    side = lambda team, win: F.struct(F.lit(team).alias("teamId"), win.alias("win"))
    red = F.array(side(200, F.col("blue_wins") == 0))
    teams = F.when(k % 13 == 0, red).otherwise(F.concat(F.array(side(100, F.col("blue_wins") == 1)), red))
    info = F.struct(
        people.alias("participants"), teams.alias("teams"), F.col("patch").alias("gameVersion"), F.col("queue_id").alias("queueId"), F.lit("EUW").alias("platformId"), F.col("duration_sec").alias("gameDuration"),
        F.col("created_ms").alias("gameCreation"), tx.end_ms(F.col("created_ms"), F.col("duration_sec")).alias("gameEndTimestamp"),
    )
    raw = _json(g, metadata=F.struct(F.concat(F.lit("M"), "game_id").alias("matchId")), info=info)
    return long_arrays(ma.flatten_match_detail(raw), "blue", "red")


def end_blocks_of(spark: SparkSession, d: str) -> DataFrame:
    """End-of-game blocks of all matches; every ninth is of a mode that isn't known."""
    mode = F.when(F.col("k") % 9 == 0, "CLASSIC").when(F.col("queue_id") == 450, "ARAM").otherwise("KIWI")
    people = lambda team: F.transform(F.filter("participants", lambda p: p["team_id"] == team), lambda p: F.struct(p["entity_id"].alias("championId"), _stats(p).alias("stats")))
    side = lambda team, win: F.struct(F.lit(team).alias("teamId"), (F.col("blue_wins") == win).alias("isWinningTeam"), people(team).alias("players"))
    ended = tx.end_ms(F.col("created_ms"), F.col("duration_sec"))
    return _json(gm.games(spark, d), gameId=F.col("k"), gameMode=mode, gameLength=F.col("duration_sec"), endOfGameTimestamp=ended, teams=F.array(side(100, 1), side(200, 0)))


@query("!SELECT game_id, queue_id, duration_sec, blue, red, CAST(blue_wins AS BIGINT) blue_wins, created_ms FROM g WHERE duration_sec >= 300 AND k % 9 <> 0")
def end_blocks(spark, d):
    return long_arrays(ma.flatten_end_block(end_blocks_of(spark, d)).drop("participants_json"), "blue", "red")


@query("""!SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY team_id, entity_id) - 1 "position", team_id, entity_id, list_filter([attrs[1], CASE WHEN slot % 2 = 1 THEN 0 ELSE attrs[2] END, attrs[3]], lambda x: x > 0) augments
 FROM p WHERE duration_sec >= 300 AND k % 9 <> 0""")
def payload_participants(spark, d):
    """Participants of the payloads that end blocks leave: in order of side and entity, attributes without zeros."""
    rows = ma.flatten_end_block(end_blocks_of(spark, d)).select("game_id", F.posexplode(F.from_json("participants_json", gm.PARTICIPANT)).alias("position", "p"))
    return rows.select("game_id", "position", F.col("p.teamId").alias("team_id"), F.col("p.championId").alias("entity_id"), F.col("p.augments").cast("array<long>").alias("augments"))


@query("!SELECT game_id, unnest(CASE WHEN k % 4 = 2 THEN [0] ELSE [0, 1] END)::BIGINT \"position\", k + unnest(CASE WHEN k % 4 = 2 THEN [0] ELSE [0, 1] END) inner_id FROM g")
def history_envelopes(spark, d):
    """Histories in the four shapes in turn: games in games, a list, one object, a bare list."""
    rows, k = gm.games(spark, d).select("game_id", "k"), F.col("k")
    game = lambda i: F.to_json(F.struct((k + i).alias("gameId"), F.lit("x").alias("gameMode")))
    both = F.concat(F.lit("["), game(0), F.lit(","), game(1), F.lit("]"))
    nested, flat = F.concat(F.lit('{"games":{"games":'), both, F.lit("}}")), F.concat(F.lit('{"games":'), both, F.lit("}"))
    rows = rows.withColumn("json", F.when(k % 4 == 0, nested).when(k % 4 == 1, flat).when(k % 4 == 2, game(0)).otherwise(both))
    return ma.normalize_history(rows).select("game_id", "position", F.get_json_object("game", "$.gameId").cast("long").alias("inner_id"))


@query("!SELECT game_id, blue team, blue[1 + k % 5] \"current\", CASE WHEN k % 2 = 0 THEN red[1:3] ELSE [] END bench FROM g WHERE k % 8 <> 0")
def pick_sessions(spark, d):
    """Pick sessions of the blue sides with three of the red entities as bench; every eighth has a cell without entity."""
    k = F.col("k")
    cells = F.transform("blue", lambda e, i: F.struct(i.alias("cellId"), F.when((k % 8 == 0) & (i == 2), 0).otherwise(e).alias("championId")))
    bench = F.transform(F.slice("red", 1, 3), lambda e: F.struct(e.alias("championId")))
    raw = gm.games(spark, d).select("game_id", F.to_json(F.struct((k % 5).alias("localPlayerCellId"), cells.alias("myTeam"), bench.alias("benchChampions"), (k % 2 == 0).alias("benchEnabled"))).alias("json"))
    return long_arrays(ma.parse_session(raw).drop("json"), "team", "bench")


@query("""SELECT p_partkey part_id, p_name name_en, CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE p_name END name_zh,
 CASE WHEN p_partkey % 10 = 0 THEN p_brand WHEN p_partkey % 3 <> 0 THEN p_type ELSE p_name END "name" FROM part""")
def bilingual_parts(spark, d):
    """Names of the parts in two languages, of which the second lacks every third, and overrides for every tenth."""
    part = gm.table(spark, d, "part").withColumnRenamed("p_partkey", "part_id")
    named = lambda c, where: part.where(where).select("part_id", F.col(c).alias("name"))
    return ma.build_dimension(named("p_name", "true"), named("p_type", "part_id % 3 <> 0"), "part_id", named("p_brand", "part_id % 10 = 0"))


@query("""WITH st AS (SELECT 'n' || n_nationkey "key", CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END "text" FROM nation UNION ALL SELECT 't' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'tip ' || n_name END FROM nation)
SELECT c_custkey id, coalesce(nullif(s.text, ''), nullif(t.text, '')) "text" FROM customer LEFT JOIN st s ON s.key = 'n' || c_nationkey LEFT JOIN st t ON t.key = 't' || c_nationkey WHERE coalesce(nullif(s.text, ''), nullif(t.text, '')) IS NOT NULL""")
def text_of_ids(spark, d):
    """Texts of the customers over the keys of their nations; some nations have no summary, some no tooltip, some neither."""
    nation, customer = gm.table(spark, d, "nation"), gm.table(spark, d, "customer")
    key = lambda c, at: F.concat(F.lit(c), F.col(at).cast("string"))
    own = nation.select(key("n", "n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("text"))
    tips = nation.select(key("t", "n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("tip "), "n_name")).alias("text"))
    keys = customer.select(F.col("c_custkey").alias("id"), key("n", "c_nationkey").alias("summary_key"), key("t", "c_nationkey").alias("tooltip_key"))
    return ma.resolve_text(customer.select(F.col("c_custkey").alias("id")), keys, own.unionByName(tips))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END alias, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey END::BIGINT entity_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def alias_lookup(spark, d):
    """Entities of the suppliers' nations by name in any case; every fifth nation isn't in the dimension."""
    nation = gm.table(spark, d, "nation")
    rows = gm.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    alias = F.when(F.col("s_suppkey") % 2 == 0, F.upper("n_name")).otherwise(F.lower("n_name")).alias("alias")
    return ma.resolve_alias(rows.select("s_suppkey", alias), nation.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("entity_id")))


@query("""SELECT o_orderkey order_id, 'P' || o_custkey public_id, CASE WHEN o_custkey % 4 >= 2 THEN 'A' || o_custkey END actor_id, CASE o_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'resolved' END resolve_status FROM orders""")
def bridged_actors(spark, d):
    """Internal ids of the orders' customers over a bridge that lacks some customers and has others without id."""
    orders, c = gm.table(spark, d, "orders"), F.col("c_custkey")
    bridge = gm.table(spark, d, "customer").where(c % 4 != 0).select(F.concat(F.lit("P"), c.cast("string")).alias("public_id"), F.when(c % 4 >= 2, F.concat(F.lit("A"), c.cast("string"))).alias("actor_id"))
    return ma.bridge_ids(orders.select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("public_id")), bridge)


@query("SELECT s_nationkey::BIGINT nation_id FROM supplier UNION SELECT c_nationkey FROM customer")
def key_union(spark, d):
    own = lambda t, c: gm.table(spark, d, t).select(F.col(c).alias("nation_id"))
    return ma.key_union(own("supplier", "s_nationkey"), own("customer", "c_nationkey"), "nation_id")


@query("SELECT n_nationkey::BIGINT id, n_name \"name\", n_regionkey::BIGINT region_id FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def union_sorted(spark, d):
    """Nations and regions in one table; what one of them lacks is null."""
    nation = gm.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id"))
    return ma.union_sorted([nation, gm.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))], ["name", "id"])


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view') OR event_type IS NULL")
def unexpected_values(spark, d):
    return ma.unexpected_values(gm.table(spark, d, "events"), "event_type", ["click", "view"])


@query("SELECT o_custkey, min(o_orderkey) o_orderkey FROM orders GROUP BY 1")
def ordered_distinct(spark, d):
    return ma.ordered_distinct(gm.table(spark, d, "orders"), "o_custkey", "o_orderkey")


@query("!SELECT game_id, CASE WHEN blue_wins = 1 THEN blue ELSE red END winners, CASE WHEN blue_wins = 1 THEN red ELSE blue END losers FROM g")
def swapped_sides(spark, d):
    """Winners and losers after about half of the matches had their sides turned round: they stay who they were."""
    rows = mo.swap_augment(gm.games(spark, d).select("game_id", "blue", "red", "blue_wins"), 3)
    side = lambda won: F.when(F.col("blue_wins") == won, F.col("blue")).otherwise(F.col("red"))
    return rows.select("game_id", side(1).alias("winners"), side(0).alias("losers"))


WILSON = """CAST(wins AS DOUBLE)/games pr, 3.8416::DOUBLE/games zz"""


@query(f"""!SELECT entity_id, games, wins, round((pr + zz/2 - h)/(1 + zz), 6) low, round((pr + zz/2 + h)/(1 + zz), 6) high FROM (SELECT *, 1.96::DOUBLE*sqrt(pr*(1-pr)/games + zz/(4*games)) h FROM (SELECT *, {WILSON} FROM er))""")
def wilson_bounds(spark, d):
    low, high = est.wilson_interval("wins", "games")
    return rates(spark, d).select("entity_id", "games", "wins", low.alias("low"), high.alias("high"))


@query("!SELECT game_id, (k*3) % 150 max_leaver_gap_sec FROM g WHERE (k*3) % 150 <= 120")
def leaver_filter(spark, d):
    rows = gm.games(spark, d).withColumn("max_leaver_gap_sec", (F.col("k") * 3) % 150)
    return ma.max_leaver_gap(rows).select("game_id", "max_leaver_gap_sec")


@query("""SELECT variant, arg_max(run, run) run, round(arg_max(acc, run), 6) val_accuracy FROM (SELECT o_orderpriority || o_orderstatus variant, o_orderkey run, o_totalprice acc FROM orders) GROUP BY 1""")
def run_leaderboard(spark, d):
    """The latest run of each variant; orders stand for runs, their price for the figure."""
    runs = gm.table(spark, d, "orders").select(F.concat("o_orderpriority", "o_orderstatus").alias("variant"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("val_accuracy"))
    return dc.leaderboard(runs).withColumnRenamed("at", "run")


@query("""SELECT p_size::BIGINT tier, count(*) n FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring') AND p_type = 'ECONOMY' GROUP BY 1""")
def entity_search(spark, d):
    """Parts of one kind whose name, brand or kind holds a text that is given in another case, by size."""
    rows = gm.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("alias"), F.array("p_type").alias("tags"), F.col("p_size").alias("tier"))
    return ma.search_entities(rows, "ECONOMY", "  RING ")


@query("SELECT c_custkey, c_custkey % 6 = 0 forbidden FROM customer")
def forbidden_payloads(spark, d):
    """Payloads with an identity key in the second object of every sixth; some are broken, null or empty."""
    k = F.col("c_custkey")
    named = F.concat(F.lit('[{"teamId":100},{"puuid":"'), "c_name", F.lit('"}]'))
    payload = F.when(k % 6 == 0, named).when(k % 6 == 1, '[{"teamId":').when(k % 6 == 2, "").when(k % 6 == 3, F.lit(None)).otherwise('[{"teamId":100,"x":"puuid"}]')
    return gm.table(spark, d, "customer").select(k, ma.has_forbidden_keys(payload, ["puuid", "gameName"]).alias("forbidden"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' WHEN o_orderkey % 4 = 0 THEN 'ladder' WHEN o_orderkey % 4 = 1 THEN 'web' WHEN o_orderkey % 4 = 2 THEN 'legacy_match' ELSE 'unknown' END family FROM orders""")
def family_backfill(spark, d):
    k = F.col("o_orderkey")
    source = F.element_at(F.array(*map(F.lit, ("ladder", "web", "match", "other"))), (k % 4 + 1).cast("int"))
    family = F.when(k % 3 == 0, "kept").when(k % 3 == 1, "")
    return gm.table(spark, d, "orders").select(k, ma.backfill_family(family, source, ["ladder", "web"]).alias("family"))


@query("SELECT c_custkey, length(c_name || repeat('x', (c_custkey % 3)::INT + 17))::BIGINT n FROM customer WHERE c_custkey % 2 = 1 OR length(c_name || repeat('x', (c_custkey % 3)::INT + 17)) = 36")
def right_ids(spark, d):
    """Ids of one source that have another length than 36 go; those of other sources stay."""
    k = F.col("c_custkey")
    rows = gm.table(spark, d, "customer").select(k, F.concat("c_name", F.expr("repeat('x', int(c_custkey % 3) + 17)")).alias("actor_id"), F.when(k % 2 == 0, "riot_tier").otherwise("other").alias("source"))
    return ma.drop_bad_ids(rows).select("c_custkey", F.length("actor_id").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE p_brand END p_brand, p_size::BIGINT p_size, 'unknown' family, NULL::BIGINT depth FROM part")
def conformed_parts(spark, d):
    """Parts brought to a later form: two columns more, one with a default, and nulls of the brand filled."""
    rows = gm.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("p_brand"), "p_size")
    return ma.conform(rows, "p_partkey long, p_brand string, p_size int, family string, depth int", {"family": "unknown", "p_brand": "none"})


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'Player ' || c_custkey || '#EUW' WHEN c_custkey % 4 = 2 THEN 'Player' || c_custkey || '#K2R4' END account FROM customer""")
def account_ids(spark, d):
    """Accounts from addresses with coded signs, plain ids and ids with a hyphen; a tag that is too long gives none."""
    k = F.col("c_custkey").cast("string")
    url = F.concat(F.lit("https://site.example/profile/Player%20"), k, F.lit("%23EUW?tab=1"))
    plain, hyphen, bad = F.concat(F.lit("Player "), k, F.lit("#EUW")), F.concat(F.lit("Player"), k, F.lit("-K2R4")), F.concat(F.lit("Player"), k, F.lit("#TOOLONG"))
    at = F.col("c_custkey") % 4
    return gm.table(spark, d, "customer").select("c_custkey", tx.account_id(F.when(at == 0, url).when(at == 1, plain).when(at == 2, hyphen).otherwise(bad)).alias("account"))


@query("""SELECT p_partkey, 'https://cdn.example/' || lower(replace(p_name, ' ', '_')) || '.png' asset, CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice, 6) ELSE 0.5 END price, CASE WHEN p_partkey % 3 = 1 THEN p_size ELSE -1 END::BIGINT size,
 CASE p_type WHEN 'ECONOMY' THEN 10 WHEN 'STANDARD' THEN 2 ELSE 7 END::BIGINT weight FROM part""")
def tolerant_parts(spark, d):
    """Asset addresses, numbers read from text with defaults, and a lookup with override and default."""
    at = F.col("p_partkey") % 3
    path = F.concat(F.lit("/Game/Assets/"), F.regexp_replace(F.initcap("p_name"), " ", "_"), F.lit(".PNG"))
    price, size = F.when(at == 0, F.col("p_retailprice").cast("string")).when(at == 1, "n/a"), F.when(at == 1, F.col("p_size").cast("string")).when(at == 2, "x1")
    return gm.table(spark, d, "part").select(
        "p_partkey", tx.asset_path(path, "/game/assets/", "https://cdn.example/").alias("asset"), tx.to_double(price, 0.5).alias("price"), tx.to_int(size, -1).alias("size"),
        tx.looked_up(F.col("p_type"), {"ECONOMY": 1, "STANDARD": 2}, 7, {"ECONOMY": 10}).alias("weight"),
    )


@query("""!SELECT game_id, created_ms + duration_sec*1000 ended_ms, created_ms started_ms, strftime(to_timestamp(created_ms // 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') started, created_ms >= 880000000000 - 24*3600000 recent FROM g""")
def match_times(spark, d):
    ended = tx.end_ms(F.col("created_ms"), F.col("duration_sec"))
    return gm.games(spark, d).select(
        "game_id", ended.alias("ended_ms"), tx.start_ms(ended, F.col("duration_sec")).alias("started_ms"), tx.utc_text(F.col("created_ms")).alias("started"), tx.is_recent(F.col("created_ms"), F.lit(880_000_000_000), 24).alias("recent")
    )


@query(SPLIT + SCORED + """, ce AS (SELECT split, sum(abs(c - r)*n)/sum(n) ece FROM (SELECT split, count(*) n, avg(p) c, avg(y) r FROM sd WHERE p < 1 GROUP BY split, floor(p*10)) GROUP BY 1)
SELECT split, 'sum' model, count(*) n, round(avg(-(y*ln(p)+(1-y)*ln(1-p))), 6) log_loss, round(avg(((p >= .5) = (y = 1))::INT::DOUBLE), 6) accuracy, round(avg((p-y)*(p-y)), 6) brier, round(-(avg(y)*ln(avg(y)) + (1-avg(y))*ln(1-avg(y))), 6) constant_log_loss, round(any_value(ece), 6) ece
 FROM sd JOIN ce USING (split) GROUP BY 1""")
def evaluation_table(spark, d):
    return mo.evaluation_table(scored(spark, d).withColumn("model", F.lit("sum")))


def _place(spark: SparkSession, name: str) -> str:
    return f"{dc.shared_folder(spark)}/{name}-{uuid.uuid4()}"


@query("!SELECT game_id, queue_id, patch, blue, red, CAST(blue_wins AS BIGINT) blue_wins, duration_sec, created_ms, has_payload FROM g")
def captured_round_trip(spark, d):
    """The captured matches, written as Parquet without the payloads of every tenth and read back in capture form."""
    place = _place(spark, "captured")
    gm.write_matches(gm.capture(spark, d).drop("captured_at"), place)
    rows = gm.decoded(gm.read_games(spark, place))
    return long_arrays(rows, "blue", "red").select("game_id", "queue_id", "patch", "blue", "red", "blue_wins", "duration_sec", "created_ms", F.col("participants").isNotNull().alias("has_payload"))


@query("!SELECT entity_id, games::DOUBLE games, wins::DOUBLE wins, round(CAST(wins AS DOUBLE)/games, 6) win_rate FROM er")
def rates_by_csv(spark, d):
    """Rates written as sorted CSV and read back as profiles."""
    place = _place(spark, "rates")
    rows = rates(spark, d).withColumn("win_rate", est.raw_rate("wins", "games")).withColumnRenamed("entity_id", "champion_id")
    gm.write_rates_csv(rows.select("champion_id", "games", "wins", "win_rate"), place, ["win_rate", "games"])
    return gm.read_profiles(spark, place).withColumnRenamed("champion_id", "entity_id")


@query(", wl AS (SELECT entity_id, ln((wins+100.0::DOUBLE)/(games+200)/(1-(wins+100.0::DOUBLE)/(games+200))) w FROM er) SELECT row_number() OVER (ORDER BY entity_id) - 1 \"index\", entity_id id, round(w, 6) weight FROM wl")
def weights_round_trip(spark, d):
    """Weights of the vocabulary's entities, exported and loaded again with the check of their places."""
    place, g = _place(spark, "weights"), gm.games(spark, d)
    weights = rt.log_odds_weights(rates(spark, d)).join(mo.build_vocab(g), "entity_id").select("index", F.col("entity_id").alias("id"), "weight")
    gm.export_weights(weights, place)
    return gm.load_weights(spark, place)


@query("SELECT epoch_us(ts) // 1000 captured_at_unix, event_id, event_type FROM events ORDER BY epoch_us(ts) DESC LIMIT 50")
def snapshot_tail(spark, d):
    """The fifty latest of the events, appended to a store in two goes."""
    place = _place(spark, "snapshots")
    rows = gm.table(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("captured_at_unix"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    gm.append_snapshot(rows.where("event_id % 2 = 0"), place)
    gm.append_snapshot(rows.where("event_id % 2 = 1"), place)
    return gm.tail_snapshots(spark, place, 50, "at").drop("at")


@query("!SELECT version, count(*) n, CAST(sum(blue_wins) AS BIGINT) wins, count(*) - 2 >= 30 ready FROM g GROUP BY 1")
def frozen_snapshot(spark, d):
    """Matches frozen once and counted by version from the frozen files, and whether each version has enough new ones for a round."""
    rows = gm.games(spark, d).select(tx.truncate_version(F.col("patch"), 2).alias("version"), "blue_wins")
    counts = gm.freeze_snapshot(rows, _place(spark, "frozen")).groupBy("version").agg(F.count("*").alias("n"), F.sum("blue_wins").alias("wins"))
    return counts.withColumn("ready", gm.round_ready(F.col("n"), F.lit(2)))


@query(""", tr AS (SELECT * FROM g WHERE len(list_filter(list_concat(blue, red), lambda x: x % 10 = 3)) = 0), vo AS (SELECT list(DISTINCT e) v FROM (SELECT unnest(list_concat(blue, red)) e FROM tr))
SELECT game_id FROM g, vo WHERE list_has_all(v, list_concat(blue, red))""")
def known_rows(spark, d):
    """Matches whose entities all occur in a training set that lacks some entities."""
    g = gm.games(spark, d)
    train = g.where(~F.exists(F.concat("blue", "red"), lambda x: x % 10 == 3))
    return mo.known_only(train, g).select("game_id")


@query(SPLIT + SCORED + """, va AS (SELECT y, ln(p/(1-p)) l FROM sd WHERE split = 'val'), ts AS (SELECT 0.05::DOUBLE*exp(i*ln(400.0::DOUBLE)/800) t FROM range(0, 801) r(i)),
lo AS (SELECT t, avg(ln(1+exp(-abs(l/t))) + greatest(l/t, 0) - y*l/t) loss FROM va, ts GROUP BY t)
SELECT (SELECT count(*) FROM va) n, round((SELECT avg(ln(1+exp(-abs(l))) + greatest(l, 0) - y*l) FROM va), 4) raw_loss, round(min(loss), 4) calibrated_loss FROM lo""")
def temperature_loss(spark, d):
    """Log-loss of the val matches before and after the temperature that is fitted on them."""
    rows = scored(spark, d).where("split = 'val'").select(F.col("label").alias("y"), est.logit("p").alias("l"))
    rows = dc.checkpointed(rows)
    t = mo.fit_temperature(rows, "y", "l")
    loss = lambda z: F.round(F.avg(F.log(1 + F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col("y") * z), 4)
    return rows.agg(F.count("*").alias("n"), loss(F.col("l")).alias("raw_loss"), loss(F.col("l") / t).alias("calibrated_loss"))


@query("""SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n/1024.0::DOUBLE) ELSE printf('%.1f MB', n/1048576.0::DOUBLE) END size, printf('%+.1f', (p_retailprice/1000 - 1)*100 + 0.013) points
 FROM (SELECT *, p_partkey*p_partkey*p_size*2 + 1 n FROM part)""")
def formatted_parts(spark, d):
    """Sizes and signed percent points as text."""
    n = F.col("p_partkey") * F.col("p_partkey") * F.col("p_size") * 2 + 1
    return gm.table(spark, d, "part").select("p_partkey", tx.human_size(n).alias("size"), tx.signed_points(F.col("p_retailprice") / 1000 - 1 + 0.00013).alias("points"))
