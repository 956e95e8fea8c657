"""All registered queries over the reference data shapes, with their DuckDB oracles.

Matches come from the orders table (see sources.games); an oracle builds them by its own SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.functions import estimators as est
from skirmish.functions import text as tx
from skirmish.operators import dimensions as dims
from skirmish.operators import discovery as dc
from skirmish.operators import mart
from skirmish.operators import matches as ma
from skirmish.operators import models as mo
from skirmish.operators import ordered
from skirmish.operators import picks as pk
from skirmish.operators import privacy as pv
from skirmish.operators import rates as rt
from skirmish.operators import teams as tm
from skirmish.sources import games as gm
from skirmish.streaming import jobs, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Matches and participants in DuckDB.
PLAYERS = """
o AS (SELECT o_orderkey k, o_orderpriority pr, o_orderdate dt, o_custkey actor, (o_orderkey*37+11) % 101 base, 1 + (o_orderkey*13) % 100 stride FROM orders),
s AS (SELECT *, unnest(range(0, 10)) slot FROM o),
c AS (SELECT *, 1 + (base + slot*stride) % 101 ent, CASE WHEN slot < 5 THEN 100 ELSE 200 END team FROM s),
sc AS (SELECT k, sum(((ent*29) % 21 - 10) * (CASE WHEN slot < 5 THEN 1 ELSE -1 END)) + (k*7919) % 121 - 60 score FROM c GROUP BY k),
p AS (SELECT CAST(c.k AS VARCHAR) game_id, c.k, CASE WHEN pr = '1-URGENT' THEN 450 ELSE 2400 END queue_id, actor,
  '16.' || (year(dt) - 1990) || '.' || (700 + month(dt)) patch, '16.' || (year(dt) - 1990) version, epoch_ms(dt) created_ms, team team_id, ent entity_id,
  CASE WHEN (score >= 0) = (team = 100) THEN 1 ELSE 0 END win, 240 + (c.k*17) % 1500 duration_sec, c.k % 10 <> 0 has_payload,
  [1000 + (ent*7 + c.k*3) % 60, 1000 + (ent*11 + c.k*5) % 60, 1000 + (ent*13 + c.k*7) % 60] attrs, slot
  FROM c JOIN sc ON c.k = sc.k),
g AS (SELECT game_id, k, any_value(queue_id) queue_id, any_value(patch) patch, any_value(version) version, any_value(created_ms) created_ms, any_value(duration_sec) duration_sec,
  any_value(actor) actor, bool_or(has_payload) has_payload, max(win) FILTER (team_id = 100) blue_wins,
  list_sort(list(entity_id) FILTER (team_id = 100)) blue, list_sort(list(entity_id) FILTER (team_id = 200)) red FROM p GROUP BY game_id, k),
er AS (SELECT entity_id, count(*) games, CAST(sum(win) AS BIGINT) wins FROM p GROUP BY 1)"""
ATTRS = """, a AS (SELECT DISTINCT game_id, entity_id, win, unnest(attrs) attribute_id FROM p WHERE has_payload),
ar AS (SELECT entity_id, attribute_id, count(*) games, CAST(sum(win) AS BIGINT) wins FROM a GROUP BY 1, 2),
eb AS (SELECT entity_id, games eg, wins ew, CAST(wins AS DOUBLE)/games b FROM er)"""
PAIRS = """, pr2 AS (SELECT x.entity_id anchor, y.entity_id mate, count(*) games, CAST(sum(x.win) AS BIGINT) wins FROM p x JOIN p y ON x.game_id = y.game_id AND x.team_id = y.team_id AND x.entity_id <> y.entity_id GROUP BY 1, 2),
pd AS (SELECT pr2.*, e.games ag, e.wins aw, e.games - pr2.games rg, e.wins - pr2.wins rw FROM pr2 JOIN er e ON e.entity_id = anchor)"""
DELTA = PAIRS + """, ad AS (SELECT *, d - 1.96*se low, d + 1.96*se high FROM (SELECT *, CAST(wins AS DOUBLE)/games - CAST(rw AS DOUBLE)/rg d,
  sqrt(CAST(wins AS DOUBLE)/games*(1-CAST(wins AS DOUBLE)/games)/games + CAST(rw AS DOUBLE)/rg*(1-CAST(rw AS DOUBLE)/rg)/rg) se FROM pd WHERE rg > 0))"""
SYN = PAIRS + """, ov AS (SELECT sum(wins)/CAST(sum(games) AS DOUBLE) r FROM er),
sy0 AS (SELECT pd.*, m.games mg, m.wins mw, CAST(pd.wins AS DOUBLE)/pd.games raw, greatest(least(CAST(aw AS DOUBLE)/ag, 0.9999), 0.0001) a, greatest(least(CAST(m.wins AS DOUBLE)/m.games, 0.9999), 0.0001) t, r FROM pd JOIN er m ON m.entity_id = mate, ov),
sy AS (SELECT *, 1/(1+exp(-(ln(a/(1-a)) + ln(t/(1-t)) - ln(r/(1-r))))) expected, raw*(1-raw)/games + a*(1-a)/ag + t*(1-t)/mg v, raw - CASE WHEN rg > 0 THEN CAST(rw AS DOUBLE)/rg ELSE CAST(aw AS DOUBLE)/ag END dr FROM sy0),
syn AS (SELECT *, raw - expected lift, CASE WHEN v > 0 THEN (raw - expected)/sqrt(v) ELSE 0 END z FROM sy)"""
ANCHORS = [7, 21, 40]


def query(oracle: str | None = None, rounded: int = 6):
    """Register a query under its function's name; doubles are rounded, counts are long."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            kinds = {"double": lambda c: F.round(c, rounded) + F.lit(0.0), "int": lambda c: c.cast("long")}
            return df.select(*[kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])

        run.__doc__, run.__name__ = build.__doc__, build.__name__
        QUERIES[build.__name__] = run
        if oracle:
            ORACLES[build.__name__] = f"WITH {PLAYERS}{oracle}" if oracle.lstrip()[:1] in (",", "!") else oracle
            ORACLES[build.__name__] = ORACLES[build.__name__].replace(f"{PLAYERS}!", f"{PLAYERS} ")
        return run

    return add


def tiers(spark: SparkSession, d: str) -> DataFrame:
    return rt.entity_tiers(gm.players(spark, d))


def rates(spark: SparkSession, d: str) -> DataFrame:
    return rt.entity_rates(gm.players(spark, d))


@query("!SELECT entity_id, games, wins, round(CAST(wins AS DOUBLE)/games, 6) win_rate FROM er")
def entity_rates(spark, d):
    return rates(spark, d).withColumn("win_rate", est.raw_rate("wins", "games"))


TIER = "CASE WHEN {0} >= .55 THEN 'OP' WHEN {0} >= .52 THEN 'T1' WHEN {0} >= .5 THEN 'T2' WHEN {0} >= .48 THEN 'T3' WHEN {0} >= .46 THEN 'T4' ELSE 'T5' END"
TIERS = f""", ti AS (SELECT *, {TIER.format('bayes')} tier FROM (SELECT *, CAST(wins AS DOUBLE)/games win_rate, (wins + 100.0::DOUBLE)/(games + 200) bayes, (wins + 1.0::DOUBLE)/(games + 2) laplace,
  (CAST(wins AS DOUBLE)/games + 3.8416::DOUBLE/(2*games) - 1.96::DOUBLE*sqrt(CAST(wins AS DOUBLE)/games*(1-CAST(wins AS DOUBLE)/games)/games + 3.8416::DOUBLE/(4.0::DOUBLE*games*games)))/(1 + 3.8416::DOUBLE/games) wilson FROM er))"""


@query(TIERS + " SELECT entity_id, games, wins, round(win_rate, 6) win_rate, round(bayes, 6) bayes, round(laplace, 6) laplace, round(wilson, 6) wilson, tier FROM ti")
def entity_tiers(spark, d):
    return tiers(spark, d)


@query(TIERS + " SELECT entity_id, tier, round(bayes, 6) bayes, row_number() OVER (PARTITION BY tier ORDER BY bayes DESC, entity_id) rank FROM ti")
def tier_blocks(spark, d):
    return rt.tier_blocks(tiers(spark, d)).select("entity_id", "tier", "bayes", "rank")


@query("!SELECT CAST(sum(games) AS BIGINT) games, CAST(sum(wins) AS BIGINT) wins, round(sum(wins)/CAST(sum(games) AS DOUBLE), 6) rate, CAST(sum(games)//10 AS BIGINT) matches FROM er")
def global_rate(spark, d):
    return rt.global_rate(rates(spark, d))


@query(ATTRS + " SELECT attribute_id, CAST(sum(games) AS BIGINT) games, CAST(sum(wins) AS BIGINT) wins FROM ar GROUP BY 1")
def attribute_rates(spark, d):
    return rt.attribute_rates(gm.players(spark, d))


@query(ATTRS + """ SELECT entity_id, attribute_id, games, wins, round(b, 6) baseline, round((wins + b*20)/(games + 20), 6) smoothed, round((wins + b*20)/(games + 20) - b, 6) lift FROM ar JOIN eb USING (entity_id)""")
def entity_attribute_lift(spark, d):
    p = gm.players(spark, d)
    return rt.attribute_lift(rt.entity_attribute_rates(p), rt.entity_rates(p))


@query(PAIRS + " SELECT anchor, mate, games, wins FROM pr2")
def pair_rates(spark, d):
    return rt.pair_rates(gm.games(spark, d))


@query(PAIRS + " SELECT anchor, mate, games, wins, ag anchor_games, aw anchor_wins, rg rest_games, rw rest_wins FROM pd")
def anchor_rest(spark, d):
    return rt.anchor_rest(*pairs_and_rates(spark, d))


def pairs_and_rates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rates of all pairs and of the entities, from one pass over the matches; a row a pair is kept."""
    pairs = dc.checkpointed(rt.pair_rates(gm.games(spark, d)))
    return pairs, rt.rates_of_pairs(pairs)


def synergy(spark: SparkSession, d: str) -> DataFrame:
    return rt.pair_synergy(*pairs_and_rates(spark, d))


def deltas(spark: SparkSession, d: str) -> DataFrame:
    return rt.anchor_delta(*pairs_and_rates(spark, d))


@query(SYN + " SELECT anchor, mate, games, wins, round(raw, 6) raw, round(expected, 6) expected, round(dr, 6) delta_vs_rest, round(lift, 6) lift, round(z, 6) z FROM syn")
def pair_synergy(spark, d):
    return synergy(spark, d)


@query(SYN + " SELECT * FROM (SELECT anchor, mate, games, round(lift, 6) lift, row_number() OVER (PARTITION BY anchor ORDER BY lift DESC, z DESC, games DESC, mate) rank FROM syn WHERE games >= 5) WHERE rank <= 10")
def ranked_pairs(spark, d):
    return rt.ranked_pairs(synergy(spark, d).where("games >= 5")).select("anchor", "mate", "games", "lift", "rank")


@query(DELTA + " SELECT anchor, mate, games, wins, rg rest_games, rw rest_wins, round(d, 6) delta, round(se, 6) se, round(low, 6) low, round(high, 6) high, low > 0 OR high < 0 significant FROM ad")
def anchor_delta(spark, d):
    return deltas(spark, d)


@query(DELTA + " SELECT round(m, 6) median_delta, round(h, 6) median_half_width, round(m/h, 6) ratio FROM (SELECT quantile_cont(abs(d), 0.5) m, quantile_cont(se*1.96, 0.5) h FROM ad)")
def noise_floor(spark, d):
    return rt.noise_floor(deltas(spark, d))


@query(DELTA + """ SELECT mate candidate, count(*) n_anchors, round(avg(d), 6) avg_delta, round(sqrt(sum(se*se))/count(*), 6) se, round(any_value(w), 6) weight, round(any_value(w) + 0.5*avg(d), 6) hybrid
 FROM ad JOIN (SELECT entity_id, ln((wins+100.0::DOUBLE)/(games+200)/(1-(wins+100.0::DOUBLE)/(games+200))) w FROM er WHERE games >= 50) ON entity_id = mate
 WHERE anchor IN (7,21,40) AND mate NOT IN (7,21,40) AND games >= 3 GROUP BY mate""")
def pick_advisor(spark, d):
    pairs, r = pairs_and_rates(spark, d)
    return rt.pick_advisor(pairs, r, rt.log_odds_weights(r), ANCHORS, 3, 50)


SLIFT = PAIRS + """, sl AS (SELECT mate candidate, count(*) n_anchors, CAST(sum(games) AS BIGINT) pair_games, avg(CAST(wins AS DOUBLE)/games) pair_rate, avg(CAST(wins AS DOUBLE)/games*(1-CAST(wins AS DOUBLE)/games)/games)/count(*) v FROM pr2
 WHERE anchor IN (7,21,40) AND mate NOT IN (7,21,40) AND games >= 3 GROUP BY mate HAVING count(*) >= 2),
sl2 AS (SELECT candidate, n_anchors, pair_games, games, pair_rate, CAST(wins AS DOUBLE)/games solo_rate, v + CAST(wins AS DOUBLE)/games*(1-CAST(wins AS DOUBLE)/games)/games v FROM sl JOIN er ON entity_id = candidate WHERE games >= 50)"""


@query(SLIFT + " SELECT candidate, n_anchors, pair_games, games, round(pair_rate, 6) pair_rate, round(solo_rate, 6) solo_rate, round(pair_rate - solo_rate, 6) lift, round(pair_rate - solo_rate - 1.96*sqrt(v), 6) lower FROM sl2")
def synergy_lift(spark, d):
    return rt.synergy_lift(rt.mirror_teams(gm.games(spark, d)), ANCHORS, 50, 3)


@query(SLIFT + " SELECT candidate, round(pair_rate - solo_rate, 6) lift FROM sl2 WHERE solo_rate > .48 AND solo_rate < .54 AND pair_rate - solo_rate > .04")
def fun_picks(spark, d):
    return rt.fun_picks(rt.synergy_lift(rt.mirror_teams(gm.games(spark, d)), ANCHORS, 50, 3)).select("candidate", "lift")


@query("!SELECT game_id, unnest([blue, red]) team, unnest([blue_wins, 1 - blue_wins]) y FROM g")
def mirror_rows(spark, d):
    return rt.mirror_teams(gm.games(spark, d)).select("game_id", "team", "y")


RANKED = ATTRS + """, ra AS (SELECT entity_id, attribute_id, games, wins, b, CASE attribute_id % 3 WHEN 0 THEN 'kPrismatic' WHEN 1 THEN 'kGold' ELSE 'kSilver' END rarity, wins + b*350 x, games - wins + (1-b)*350 y FROM ar JOIN eb USING (entity_id)),
rb AS (SELECT *, x/(x+y) posterior, greatest(0, least(1, x/(x+y) - 1.2815515655446004::DOUBLE*sqrt(x*y/((x+y)*(x+y)*(x+y+1))))) lcb FROM ra)"""


def ranked(spark: SparkSession, d: str, attr: DataFrame | None = None, r: DataFrame | None = None) -> DataFrame:
    p = gm.players(spark, d)
    attr, r = attr or rt.entity_attribute_rates(p), r or rt.entity_rates(p)
    return pk.rank_attributes(pk.with_baseline(attr, r), 350.0, gm.attribute_dim(spark))


@query(RANKED + " SELECT entity_id, attribute_id, rarity, games, wins, round(posterior, 6) posterior, round(lcb, 6) lcb, round(lcb - b, 6) rank_score FROM rb")
def ranked_attributes(spark, d):
    return ranked(spark, d).select("entity_id", "attribute_id", "rarity", "games", "wins", "posterior", "lcb", "rank_score")


TOPN = RANKED + """, rk AS (SELECT entity_id, rarity, attribute_id, games, row_number() OVER (PARTITION BY entity_id, rarity ORDER BY round(lcb-b, 9) DESC, games DESC, attribute_id) t,
 row_number() OVER (PARTITION BY entity_id, rarity ORDER BY round(lcb-b, 9), games, attribute_id) u FROM rb)"""


def _ends(spark: SparkSession, d: str, attr: DataFrame | None = None, r: DataFrame | None = None) -> DataFrame:
    rows = ranked(spark, d, attr, r).withColumn("rank_score", F.round("rank_score", 9))
    return rt.top_bottom_per_group(rows, ["entity_id", "rarity"], ["rank_score", "games"], "attribute_id")


@query(TOPN + " SELECT entity_id, rarity, attribute_id, t top_rank FROM rk WHERE t <= 5")
def topn_per_group(spark, d):
    return _ends(spark, d).where("top_rank <= 5").select("entity_id", "rarity", "attribute_id", "top_rank")


@query(TOPN + " SELECT entity_id, rarity, attribute_id, u bottom_rank FROM rk WHERE u <= 5")
def bottomn_per_group(spark, d):
    return _ends(spark, d).where("bottom_rank <= 5").select("entity_id", "rarity", "attribute_id", "bottom_rank")


GRID = ATTRS + """, ks AS (SELECT i step, 5.0::DOUBLE * pow(1000.0::DOUBLE, i/24.0::DOUBLE) k FROM range(25) t(i)), nl AS (SELECT step, k, sum(-(lgamma(wins+q*k)+lgamma(games-wins+(1-q)*k)-lgamma(games+k)-lgamma(q*k)-lgamma((1-q)*k)+lgamma(k))) nll
 FROM (SELECT ar.*, greatest(least(b, 0.9999), 0.0001) q FROM ar JOIN eb USING (entity_id)), ks GROUP BY 1, 2)"""


@query(GRID + " SELECT step, round(k, 3) k, round(nll, 3) nll FROM nl", rounded=3)
def eb_prior_grid(spark, d):
    p = gm.players(spark, d)
    return pk.prior_grid(pk.with_baseline(rt.entity_attribute_rates(p), rt.entity_rates(p))).select("step", "k", "nll")


def strength_sql(rows: str, prior: str, least: int) -> str:
    """CTEs that end in kk(k): three rounds of 25 values over a relation with wins, games and a prior."""
    nll = "sum(-(lgamma(wins+q*k)+lgamma(games-wins+(1-q)*k)-lgamma(games+k)-lgamma(q*k)-lgamma((1-q)*k)+lgamma(k)))"
    out, low, high = [f"qq AS (SELECT wins, games, greatest(least({prior}, 0.9999), 0.0001) q FROM {rows})"], "5.0::DOUBLE", "5000.0::DOUBLE"
    for i in range(3):
        bounds = f"SELECT {low} lo, {high} hi" + (f" FROM kb{i - 1}" if i else "")
        out.append(f"kl{i} AS ({bounds}), kg{i} AS (SELECT i step, lo*pow(hi/lo, i/24.0::DOUBLE) k, ln(hi/lo)/24 w FROM range(25) t(i), kl{i})")
        out.append(f"kb{i} AS (SELECT k, w FROM (SELECT step, k, w, {nll} nll FROM qq, kg{i} GROUP BY 1, 2, 3) ORDER BY nll, step LIMIT 1)")
        low, high = "greatest(5.0::DOUBLE, k*exp(-w))", "least(5000.0::DOUBLE, k*exp(w))"
    return ", " + ", ".join([*out, f"kk AS (SELECT CASE WHEN (SELECT count(*) FROM qq) < {least} THEN 350.0::DOUBLE ELSE k END k FROM kb2)"])


@query(ATTRS + strength_sql("ar JOIN eb USING (entity_id)", "b", 20) + " SELECT entity_id, attribute_id, round(k, 6) k, round((wins + b*k)/(games + k), 6) posterior FROM ar JOIN eb USING (entity_id), kk")
def eb_prior_strength(spark, d):
    """Strength found by the finer grids; the posterior mean it gives for each attribute."""
    p = gm.players(spark, d)
    rows = pk.with_baseline(rt.entity_attribute_rates(p), rt.entity_rates(p))
    k = pk.prior_strength(rows)
    return rows.select("entity_id", "attribute_id", F.lit(k).alias("k"), est.bayes_rate("wins", "games", F.col("baseline"), k).alias("posterior"))


@query(ATTRS + strength_sql("ar JOIN eb USING (entity_id)", "b", 20) + " SELECT (SELECT count(*) FROM ar) n, round(log10(k), 2) log_k FROM kk")
def eb_prior_minimum(spark, d):
    """The strength that one pass over the counts gives."""
    p = gm.players(spark, d)
    rows = dc.checkpointed(pk.with_baseline(rt.entity_attribute_rates(p), rt.entity_rates(p)))
    k = pk.prior_minimum(rows)
    return rows.agg(F.count("*").alias("n"), F.round(F.log10(F.lit(k)), 2).alias("log_k"))


@query(ATTRS + """, rho AS (SELECT greatest(0, pow(CAST(wins AS DOUBLE)/games - b, 2) - b*(1-b)/games)/(b*(1-b)) rho FROM ar JOIN eb USING (entity_id)), r2 AS (SELECT rho, row_number() OVER (ORDER BY rho) - 1 i, count(*) OVER () n FROM rho WHERE rho > 0)
SELECT round(rho, 6) rho, round(greatest(5, least(5000, 1/rho - 1)), 6) k FROM r2 WHERE i = n // 2""")
def eb_prior_moment(spark, d):
    p = gm.players(spark, d)
    return pk.prior_strength_moment(pk.with_baseline(rt.entity_attribute_rates(p), rt.entity_rates(p)))


SETS = ATTRS + """, st AS (SELECT entity_id, 'set-' || s "set", count(*) games, CAST(sum(win) AS BIGINT) wins, any_value(b) baseline FROM (SELECT DISTINCT game_id, entity_id, win, attribute_id % 9 s FROM a) JOIN eb USING (entity_id) GROUP BY 1, 2),
al AS (SELECT "set", (sum(wins) - sum(baseline*games))/sum(games) avg_lift FROM st GROUP BY 1)"""


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted([w])})" for w in words) + ")"


SAID = [w for words in (*dims.TYPE_WORDS.values(), dims.DAMAGE_WORDS) for w in words]
AD = f""", ad AS (SELECT attribute_id, slug, CASE WHEN {any_sql('txt', dims.DAMAGE_WORDS)} THEN 'role_damage' ELSE 'role' END "scope",
 list_sort(list_distinct(list_concat([x FOR x IN [{', '.join(f"CASE WHEN {any_sql('txt', w)} THEN '{t}' END" for t, w in dims.TYPE_WORDS.items())}] IF x IS NOT NULL],
 CASE slug {' '.join(f"WHEN '{k}' THEN [{quoted(v)}]" for k, v in dims.SET_TYPES.items())} END))) types
 FROM (SELECT 1000+i attribute_id, [{quoted(dims.SET_TYPES)}][i % 9 + 1] slug, [{quoted(SAID)}][(i*7) % {len(SAID)} + 1] || ' ' || [{quoted(SAID)}][(i*11+5) % {len(SAID)} + 1] txt FROM range(60) t(i)))"""
TYPES = ATTRS + AD + """, st AS (SELECT entity_id, category, count(*) games, CAST(sum(win) AS BIGINT) wins, any_value(b) baseline FROM (SELECT DISTINCT game_id, entity_id, win, unnest(types) category FROM a JOIN ad USING (attribute_id)) JOIN eb USING (entity_id) GROUP BY 1, 2),
al AS (SELECT category, (sum(wins) - sum(baseline*games))/sum(games) avg_lift FROM st GROUP BY 1),
af AS (SELECT *, greatest(least(baseline + avg_lift, 0.9999), 0.0001) pr FROM st JOIN al USING (category) WHERE games >= 15)"""


def set_counts(spark: SparkSession, d: str, r: DataFrame | None = None) -> DataFrame:
    p = gm.players(spark, d)
    return pk.category_counts(p, gm.attribute_dim(spark).withColumn("categories", F.array("set")), r or rt.entity_rates(p), name="set")


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    p = gm.players(spark, d)
    return pk.category_counts(p, gm.attribute_dim(spark), rt.entity_rates(p), "types")


@query(SETS + ' SELECT entity_id, "set", games, wins, round(baseline, 6) baseline, round(avg_lift, 6) avg_lift, round((wins+baseline*30)/(games+30), 6) smoothed, round((wins+baseline*30)/(games+30) - baseline, 6) lift, round((wins+baseline*30)/(games+30) - baseline - avg_lift, 6) residual FROM st JOIN al USING ("set")')
def set_affinity(spark, d):
    return pk.set_affinity(set_counts(spark, d))


@query(ATTRS + """ SELECT entity_id, 'set-' || (attribute_id % 9) "set", CAST(sum(games) AS BIGINT) games, CAST(sum(wins) AS BIGINT) wins, round(max(b), 6) baseline FROM ar JOIN eb USING (entity_id) GROUP BY 1, 2""")
def set_rates_from_attributes(spark, d):
    p = gm.players(spark, d)
    attr = rt.entity_attribute_rates(p)
    return pk.set_rates_from_attributes(attr, gm.attribute_dim(spark), rt.entity_rates(p))


AFF = SETS + """, af AS (SELECT *, greatest(least(baseline + avg_lift, 0.9999), 0.0001) pr FROM st JOIN al USING ("set") WHERE games >= 15),
ag AS (SELECT *, wins + pr*350 x, games - wins + (1-pr)*350 y FROM af), ah AS (SELECT *, x/(x+y) m, sqrt(x*y/((x+y)*(x+y)*(x+y+1))) sd FROM ag)"""


@query(AFF + ' SELECT entity_id, "set", games, wins, round(m, 6) posterior, round(m - baseline, 6) lift, round(m - pr, 6) residual, round(greatest(0, least(1, m - 1.2815515655446004::DOUBLE*sd)) - pr, 6) lcb, round(greatest(0, least(1, m + 1.2815515655446004::DOUBLE*sd)) - pr, 6) ucb, games >= 45 primary_sample FROM ah')
def category_affinity_normal(spark, d):
    return pk.category_affinity(set_counts(spark, d), 350.0, exact=False, name="set").drop("prior_strength")


BOUND = "round(greatest(0, least(1, m {0} 1.2815515655446004::DOUBLE*sd)) - pr, 6)"


@query(TYPES + strength_sql("af", "pr", 8) + f""", ag AS (SELECT *, wins + pr*k x, games - wins + (1-pr)*k y FROM af, kk), ah AS (SELECT *, x/(x+y) m, sqrt(x*y/((x+y)*(x+y)*(x+y+1))) sd FROM ag)
SELECT entity_id, category, games, wins, round(m, 6) posterior, round(m - baseline, 6) lift, round(m - pr, 6) residual, {BOUND.format('-')} lcb, {BOUND.format('+')} ucb, games >= 45 primary_sample, round(k, 6) prior_strength FROM ah""")
def type_affinity_normal(spark, d):
    """Affinities to attribute types with the strength of the prior that the rows show."""
    return pk.category_affinity(type_counts(spark, d), exact=False)


@query()
def type_affinity(spark, d):
    """The same with exact quantiles, which SQL hasn't."""
    return pk.category_affinity(type_counts(spark, d))


@query()
def ranked_attributes_exact(spark, d):
    """Attributes ranked by the exact tenth-part quantile; SQL has none."""
    p = gm.players(spark, d)
    attr, r = rt.entity_attribute_rates(p), rt.entity_rates(p)
    return pk.rank_attributes(pk.with_baseline(attr, r), 350.0, gm.attribute_dim(spark), exact=True).select("entity_id", "attribute_id", "games", "wins", "posterior", "lcb", "rank_score")


@query(AFF + """, aj AS (SELECT *, m - 1.2815515655446004::DOUBLE*sd lo, m + 1.2815515655446004::DOUBLE*sd hi, m - pr res, games >= 45 prim, max(CASE WHEN games >= 45 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id) n_prim FROM ah),
ak AS (SELECT entity_id, "set", row_number() OVER (PARTITION BY entity_id ORDER BY greatest(0, least(1, lo)) - pr DESC, res DESC, games DESC, "set") top_rank, row_number() OVER (PARTITION BY entity_id ORDER BY greatest(0, least(1, hi)) - pr, res, games, "set") bottom_rank FROM aj WHERE prim OR n_prim = 0)
SELECT * FROM ak WHERE top_rank <= 4 OR bottom_rank <= 4""")
def top_bottom_affinity(spark, d):
    rows = pk.category_affinity(set_counts(spark, d), 350.0, exact=False, name="set")
    return pk.top_bottom_affinity(rows, name="set").select("entity_id", "set", "top_rank", "bottom_rank")


KINDS, NAMES = list(gm.CATEGORIES), [*(w for words in dims.ITEM_WORDS.values() for w in words), *["plain"] * 100]


def style_sql() -> str:
    has = lambda *some: f"list_has_any(c, [{quoted(some)}])"
    w = {k: any_sql("lower(nm)", v) for k, v in dims.ITEM_WORDS.items()}
    spell, pierce, hard, hit = f"({has('SpellDamage')} OR contains(lower(nm), 'ability power'))", has("ArmorPenetration", "Lethality"), has("Health", "Armor", "SpellBlock", "MagicResist"), has("OnHit", "AttackSpeed")
    harm = has("Damage", "ArmorPenetration", "Lethality")
    return f"""CASE WHEN price < 1800 THEN NULL WHEN {has('HealAndShieldPower')} OR {w['support']} THEN 'support' WHEN {has('CriticalStrike')} THEN 'crit'
 WHEN {spell} THEN CASE WHEN {w['ap_onhit']} OR ({hit} AND NOT {has('Damage')}) THEN 'ap_onhit' WHEN {w['ap_burn']} THEN 'ap_burn' WHEN {w['ap_bruiser']} THEN 'ap_bruiser' WHEN {w['ap_burst']} THEN 'ap_burst' WHEN {hard} AND NOT {has('MagicPenetration')} THEN 'ap_bruiser' ELSE 'ap_burst' END
 WHEN {harm} AND (contains(lower(nm), 'manamune') OR contains(lower(nm), 'muramana')) THEN 'ad_poke' WHEN {hit} THEN 'onhit'
 WHEN {harm} THEN CASE WHEN {w['ad_poke']} THEN 'ad_poke' WHEN {w['ad_assassin']} THEN 'ad_assassin' WHEN {w['ad_bruiser']} THEN 'ad_bruiser' WHEN {has('Health', 'Armor', 'SpellBlock', 'MagicResist', 'LifeSteal', 'SpellVamp', 'Tenacity')} THEN 'ad_bruiser'
  WHEN {pierce} AND {has('Active', 'NonbootsMovement', 'Slow', 'Stealth')} THEN 'ad_assassin' WHEN {pierce} AND {has('AbilityHaste', 'CooldownReduction', 'Mana')} THEN 'ad_poke' WHEN {pierce} THEN 'ad_assassin' ELSE 'ad_bruiser' END
 WHEN {hard} THEN 'tank' END"""


ITEMS = f""", it AS (SELECT *, {style_sql()} style FROM (SELECT k item_id, p_name || ' ' || [{quoted(NAMES)}][(k*17) % {len(NAMES)} + 1] nm,
 [[{quoted(KINDS)}][(k*7) % {len(KINDS)} + 1], [{quoted(KINDS)}][(k*11+3) % {len(KINDS)} + 1], [{quoted(KINDS)}][(k*13+8) % {len(KINDS)} + 1]] c, 1700 + k*37 % 1500 price FROM (SELECT *, p_partkey k FROM part)))"""


@query(ITEMS + " SELECT item_id, price, style FROM it")
def item_styles(spark, d):
    return gm.items(spark, d).select("item_id", "price", "style")


@query(ITEMS + """, us AS (SELECT CAST(l_orderkey AS VARCHAR) game_id, l_suppkey % 10 slot, style, sum(price) weight FROM lineitem JOIN it ON item_id = l_partkey WHERE style IS NOT NULL GROUP BY 1, 2, 3)
SELECT game_id, slot, style, CAST(weight AS BIGINT) weight FROM (SELECT *, row_number() OVER (PARTITION BY game_id, slot ORDER BY weight DESC, style) i FROM us) WHERE i = 1""")
def primary_styles(spark, d):
    return dims.primary_style(gm.used_items(spark, d), gm.items(spark, d), "game_id", "slot")


@query(ATTRS + AD + """ SELECT category, count(*) picks, CAST(sum(win) AS BIGINT) wins FROM (SELECT win, unnest(types) category FROM a JOIN ad USING (attribute_id)) GROUP BY 1""")
def type_picks(spark, d):
    """Picks and wins of each attribute type, an attribute once for each of its types."""
    rows = dims.with_categories(rt.with_attributes(gm.players(spark, d)), gm.attribute_dim(spark), categories="types")
    return rows.groupBy("category").agg(F.count("*").alias("picks"), F.sum("win").cast("long").alias("wins"))


ENT = """, en AS (SELECT entity_id, ['Tank','Fighter','Mage','Marksman','Support','Assassin'][entity_id % 6 + 1] AS role, (entity_id*13 % 101)/100.0::DOUBLE physical, CAST(entity_id*7 % 4 AS DOUBLE) front,
 entity_id*3 % 13 wave, entity_id*5 % 13 cc, entity_id*11 % 11 engage, entity_id*17 % 23 dmg, entity_id*19 % 9 poke, entity_id*23 % 7 sustain FROM er),
ed AS (SELECT *, greatest(0, 0.95::DOUBLE - physical) magic FROM en),
ee AS (SELECT *, CASE WHEN physical >= .55 AND physical - magic >= .15 THEN 'physical' WHEN magic >= .55 AND magic - physical >= .15 THEN 'magic' WHEN role IN ('Marksman','Assassin','Fighter') THEN 'physical' ELSE CASE WHEN role IN ('Mage','Support') THEN 'magic' ELSE 'mixed' END END damage FROM ed)"""


@query(ENT + " SELECT entity_id, role, round(physical, 6) physical, front, round(magic, 6) magic, damage FROM ee")
def entity_profiles(spark, d):
    return gm.entity_dim(rates(spark, d)).select("entity_id", "role", "physical", "front", "magic", "damage")


PICK = ATTRS + ENT + AD + """, pk AS (SELECT ar.entity_id, attribute_id, games, attribute_id % 3 rarity, role, damage, "scope" = 'role_damage' dmg FROM ar JOIN ee USING (entity_id) JOIN ad USING (attribute_id)),
pt AS (SELECT *, sum(games) OVER (PARTITION BY rarity, entity_id) t, sum(games) OVER (PARTITION BY rarity) ta, sum(games) OVER (PARTITION BY rarity, attribute_id) ca, sum(games) OVER (PARTITION BY rarity, role) tr, sum(games) OVER (PARTITION BY rarity, role, attribute_id) cr,
 sum(games) OVER (PARTITION BY rarity, role, damage) td, sum(games) OVER (PARTITION BY rarity, role, damage, attribute_id) cd FROM pk),
pm AS (SELECT pt.*, m FROM pt JOIN (SELECT rarity, count(DISTINCT attribute_id) m FROM pk GROUP BY 1) USING (rarity)),
po AS (SELECT *, dmg AND td - t >= greatest(50, 2*m) near FROM pm),
pg AS (SELECT *, (ca + .5::DOUBLE)/(ta + .5::DOUBLE*m) gs, CASE WHEN near THEN td ELSE tr END - t tt, CASE WHEN near THEN cd ELSE cr END - games cc FROM po),
ph AS (SELECT *, CASE WHEN tt <= 0 THEN gs ELSE (cc + .5::DOUBLE*m*gs)/(tt + .5::DOUBLE*m) END peer FROM pg)"""


@query(PICK + " SELECT entity_id, attribute_id, CASE rarity WHEN 0 THEN 'kPrismatic' WHEN 1 THEN 'kGold' ELSE 'kSilver' END rarity, games, CASE WHEN near THEN 'role_damage' ELSE 'role' END peer_scope, round(peer, 6) peer_share, round((games + .5*m*peer)/(t + .5*m), 6) share, round(ln((games + .5*m*peer)/(t + .5*m)/peer), 6) pick_lift FROM ph")
def pick_lift(spark, d):
    p = gm.players(spark, d)
    attr = rt.entity_attribute_rates(p)
    return pk.pick_lift(attr, gm.attribute_dim(spark), gm.entity_dim(rt.entity_rates(p)))


@query(ATTRS + ENT + """ SELECT CASE attribute_id % 3 WHEN 0 THEN 'kPrismatic' WHEN 1 THEN 'kGold' ELSE 'kSilver' END rarity, role, damage, attribute_id, CAST(sum(games) AS BIGINT) games FROM ar JOIN ee USING (entity_id)
 GROUP BY GROUPING SETS ((1, attribute_id), (1, role, attribute_id), (1, role, damage, attribute_id))""")
def pick_totals(spark, d):
    p = gm.players(spark, d)
    attr = rt.entity_attribute_rates(p)
    rows = pk.with_attribute_dim(attr, gm.attribute_dim(spark)).join(gm.entity_dim(rt.entity_rates(p)), "entity_id")
    return pk.pick_totals(rows).drop("level")


# matches


@query("!SELECT queue_id, count(*) n, round(avg(blue_wins::DOUBLE), 6) base_rate, max(created_ms) latest_ms FROM g GROUP BY 1")
def mode_summary(spark, d):
    return rt.mode_summary(gm.games(spark, d)).drop("min_patch", "max_patch")


@query("!SELECT queue_id, count(*) n, arg_min(patch, [CAST(x AS INT) FOR x IN string_split(patch, '.')]) min_patch, arg_max(patch, [CAST(x AS INT) FOR x IN string_split(patch, '.')]) max_patch FROM g GROUP BY 1")
def mode_versions(spark, d):
    """First and last version of each mode, by number."""
    return rt.mode_summary(gm.games(spark, d)).select("queue_id", "n", "min_patch", "max_patch")


@query("!SELECT version, count(*) n, max(created_ms) latest_ms FROM g GROUP BY 1 ORDER BY latest_ms DESC, CAST(split_part(version, '.', 2) AS INT) DESC LIMIT 1")
def latest_version(spark, d):
    return rt.latest_version(gm.games(spark, d))


@query(TIERS + " SELECT entity_id, tier, row_number() OVER (ORDER BY bayes DESC, entity_id) rank FROM ti")
def ranked_tiers(spark, d):
    """All entities with their rank by shrunk rate."""
    return rt.with_rank(tiers(spark, d), [-F.col("bayes"), F.col("entity_id")]).select("entity_id", "tier", "rank")


@query(TIERS + " (SELECT entity_id, 'top' AS \"end\" FROM ti WHERE games >= 50 ORDER BY bayes DESC, entity_id LIMIT 7) UNION ALL (SELECT entity_id, 'bottom' FROM ti WHERE games >= 50 ORDER BY bayes, entity_id LIMIT 7)")
def global_ends(spark, d):
    return rt.top_bottom(tiers(spark, d), "bayes", "entity_id", 7, 50).select("entity_id", "end")


@query("!SELECT game_id, created_ms FROM g ORDER BY created_ms DESC, game_id DESC LIMIT 5")
def most_recent(spark, d):
    return dc.most_recent(gm.games(spark, d), ["created_ms", "game_id"]).select("game_id", "created_ms")


@query("!SELECT actor actor_id, max(created_ms) created_ms, arg_max(patch, (created_ms, patch)) patch FROM g GROUP BY 1")
def latest_per_actor(spark, d):
    """Each actor's last match time, and the greatest version text of that time."""
    return dc.latest_per_key(gm.games(spark, d), "actor_id", "created_ms", "patch")


@query("!SELECT game_id, patch FROM g WHERE patch LIKE '16.5%' OR patch LIKE '16.1%'")
def version_filter(spark, d):
    return ma.version_prefix(gm.games(spark, d), ["16.5", "16.1"]).select("game_id", "patch")


@query("!SELECT game_id, patch FROM g WHERE version IN ('16.5', '16.7') AND duration_sec >= 300 AND queue_id = 2400")
def version_minor_filter(spark, d):
    return ma.min_duration(ma.version_minor_in(ma.mode_in(gm.games(spark, d), [2400]), ["16.5", "16.7"])).select("game_id", "patch")


@query("!SELECT coalesce(CASE WHEN queue_id <> 2400 THEN 'queue' WHEN duration_sec < 300 THEN 'duration' WHEN (k*3) % 150 > 120 THEN 'leaver' WHEN version NOT IN ('16.5','16.6','16.7','16.8') THEN 'patch' END, 'kept') reason, count(*) n FROM g GROUP BY 1")
def reject_audit(spark, d):
    rows = gm.games(spark, d).withColumn("max_leaver_gap_sec", (F.col("k") * 3) % 150)
    return ma.reject_audit(rows, [2400], ["16.5", "16.6", "16.7", "16.8"])


SOURCES = """, so AS (SELECT game_id, k, created_ms, 0 src, has_payload AND k % 14 <> 0 full_ FROM g UNION ALL SELECT game_id, k, created_ms + 1000, 1, has_payload FROM g WHERE k % 7 = 0)"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    """The captured matches, some payloads emptied, and a later capture of every seventh."""
    rows = gm.capture(spark, d)
    k = F.col("game_id").cast("long")
    first = rows.withColumn("participants_json", F.when(k % 14 == 0, "").otherwise(F.col("participants_json"))).withColumn("source_rank", F.lit(0))
    return first.unionByName(rows.where(k % 7 == 0).withColumn("created_ms", F.col("created_ms") + 1000).withColumn("source_rank", F.lit(1)))


@query(SOURCES + " SELECT game_id, min(created_ms) created_ms, bool_or(full_) has_payload FROM so GROUP BY 1")
def dedup_merge(spark, d):
    return ma.merge_games(sources(spark, d)).select("game_id", "created_ms", F.col("participants_json").isNotNull().alias("has_payload"))


@query(SOURCES + """, sf AS (SELECT *, min(src) OVER (PARTITION BY game_id) f, min(CASE WHEN full_ THEN src END) OVER (PARTITION BY game_id) ff FROM so)
 SELECT src source_rank, count(*) rows_read, count(*) FILTER (src = f) inserted, count(*) FILTER (src = ff AND f < src) backfilled FROM sf GROUP BY 1""")
def merge_report(spark, d):
    return ma.merge_report(sources(spark, d))


@query("!SELECT game_id, created_ms FROM g WHERE k % 7 <> 0")
def append_new(spark, d):
    rows = gm.capture(spark, d)
    return ma.new_rows(rows, rows.where(F.col("game_id").cast("long") % 7 == 0), "game_id").select("game_id", "created_ms")


@query("!SELECT game_id, queue_id, patch, blue_wins, duration_sec, created_ms FROM g WHERE queue_id = 2400 AND patch LIKE '16.6%'")
def share_export(spark, d):
    return ma.export_share(gm.capture(spark, d), [2400], ["16.6"]).select("game_id", "queue_id", "patch", "blue_wins", "duration_sec", "created_ms")


@query("""!SELECT CAST(sum(n) AS BIGINT) games, CAST(2 AS BIGINT) modes, count(*) versions, round(sum(w)/CAST(sum(n) AS DOUBLE), 6) base_rate,
 '16.' || min(v) || '-16.' || max(v) title FROM (SELECT CAST(split_part(version, '.', 2) AS INT) v, count(*) n, sum(blue_wins) w FROM g GROUP BY 1)""")
def share_summary(spark, d):
    return ma.share_summary(ma.export_share(gm.capture(spark, d), None, []))


@query("!SELECT CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END source, count(*) total, count(*) FILTER (duration_sec < 300) bad, CAST(0 AS BIGINT) repeated, round(avg(blue_wins::DOUBLE), 6) base_rate, CAST(0 AS BIGINT) odd_modes, CAST(0 AS BIGINT) identities, ['bad rows'] warnings, FALSE passed FROM g GROUP BY 1")
def verify_report(spark, d):
    rows = gm.decoded(gm.capture(spark, d)).withColumn("source", F.when(F.col("game_id").cast("long") % 2 == 0, "even").otherwise("odd"))
    return ma.verify_share(rows)


@query("!SELECT 'LCU_' || game_id match_id, patch, queue_id, 'local' platform, duration_sec, blue blue_champions, red red_champions, blue_wins = 1 blue_wins, created_ms game_creation_ms, created_ms + duration_sec*1000 game_end_ms, CAST(0 AS BIGINT) max_leaver_gap_sec FROM g WHERE queue_id = 450")
def export_matches(spark, d):
    return gm.export_matches(gm.capture(spark, d), [450]).drop("participants_json").withColumns({c: F.col(c).cast("array<long>") for c in ("blue_champions", "red_champions")})


@query("!SELECT queue_id, version, count(*) n FROM g GROUP BY GROUPING SETS ((queue_id), (queue_id, version))")
def tally(spark, d):
    rows = gm.games(spark, d).withColumn("version", tx.truncate_version(F.col("patch"), 2))
    return ma.tally(rows, [["queue_id"], ["queue_id", "version"]]).drop("level")


@query("!SELECT version, count(*) n FROM g GROUP BY 1 HAVING count(*) >= 1000")
def min_group_count(spark, d):
    rows = gm.games(spark, d).withColumn("version", tx.truncate_version(F.col("patch"), 2))
    return ma.min_group_count(rows, "version", 1000).groupBy("version").agg(F.count("*").alias("n"))


@query("!SELECT game_id FROM g WHERE len(list_filter(list_concat(blue, red), lambda x: x % 10 = 3)) = 0")
def all_known(spark, d):
    rows = gm.games(spark, d)
    return ma.all_known(rows, ["blue", "red"], mo.build_vocab(rows).select("entity_id").where("entity_id % 10 <> 3")).select("game_id")


@query("!SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 \"index\" FROM er")
def vocab(spark, d):
    return mo.build_vocab(gm.games(spark, d))


@query()
def parse_round_trip(spark, d):
    """Raw game details made of the matches, parsed back: mode, version, teams, result and payload."""
    g = gm.games(spark, d)
    stats = F.struct(F.lit(None).cast("string").alias("win"), *[F.lit(0).alias(f"playerAugment{i}") for i in range(1, 7)])
    people = F.transform("participants", lambda p: F.struct(p["team_id"].alias("teamId"), p["entity_id"].alias("championId"), stats.alias("stats")))
    sides = F.array(F.struct(F.lit(100).alias("teamId"), F.when(F.col("blue_wins") == 1, "Win").otherwise("Fail").alias("win")))
    raw = g.select(F.to_json(F.struct(F.col("k").alias("gameId"), F.col("queue_id").alias("queueId"), F.col("duration_sec").alias("gameDuration"), F.col("created_ms").alias("gameCreation"), F.col("patch").alias("gameVersion"), people.alias("participants"), sides.alias("teams"))).alias("json"))
    return ma.flatten_game_detail(raw).drop("participants_json").withColumns({c: F.col(c).cast("array<long>") for c in ("blue", "red")})


ORACLES["parse_round_trip"] = f"WITH {PLAYERS} SELECT game_id, queue_id, patch, duration_sec, blue, red, CAST(blue_wins AS BIGINT) blue_wins, created_ms FROM g WHERE duration_sec >= 300"


# teams

def comp_sql(rows: str, key: str) -> str:
    """CTEs that end in cs: composition and score of the teams in a relation (key, entity_id)."""
    value = lambda t, *k: f"""coalesce((SELECT v FROM tb WHERE t = '{t}' AND tb.k = {" || '|' || ".join(k)}), 0)"""
    lacks = {c: f"{c} < {low}::DOUBLE*size/5" for c, low in (("wave", 3), ("cc", 3), ("engage", 2.2), ("dmg", 5.5), ("poke", 2), ("sustain", 1.5), ("front", 1.8))}
    group = lambda n: f"CASE WHEN {n}*5.0::DOUBLE/size < .5 THEN '0' WHEN {n}*5.0::DOUBLE/size < 1.5 THEN '1' ELSE '2+' END"
    entries = ", ".join(f"('{t}', '{k}', {v}::DOUBLE)" for t, k, v in tm.table_entries())
    return f""", tb(t, k, v) AS (VALUES {entries}),
tc AS (SELECT {key}, count(*) size, sum(front) front, round(sum(physical), 6) physical, round(sum(magic), 6) magic, count(*) FILTER (front >= 2) fronts, count(*) FILTER (role = 'Mage') mages, count(*) FILTER (role = 'Marksman') marksmen,
 {', '.join(f'CAST(sum({c}) AS DOUBLE)/10 {c}' for c in ('wave', 'cc', 'engage', 'dmg', 'poke', 'sustain'))} FROM {rows} JOIN ee USING (entity_id) GROUP BY 1),
td AS (SELECT *, physical/(physical+magic) ad_share, {' + '.join(f'CASE WHEN {x} THEN 1 ELSE 0 END' for x in lacks.values())} lacks FROM tc),
te AS (SELECT *, CASE WHEN ad_share < .35 THEN '<35% AD' WHEN ad_share < .45 THEN '35-45% AD' WHEN ad_share < .55 THEN '45-55% AD' WHEN ad_share < .65 THEN '55-65% AD' ELSE '>=65% AD' END ad_bin, {group('fronts')} || ' front' front_group,
 {group('mages')} mage_group, {group('marksmen')} marksman_group, {group('lacks')} lacks_group, {', '.join(f"'{c} ' || CASE WHEN {lacks[c]} THEN 'lack' ELSE 'ok' END {c}_group" for c in ('wave', 'engage', 'poke'))} FROM td),
tf AS (SELECT *, .55::DOUBLE*{value('ad_front', 'front_group', 'ad_bin')} + .3::DOUBLE*{value('poke_front', 'front_group', 'poke_group')} + .15::DOUBLE*{value('wave_engage', 'wave_group', 'engage_group')} + .15::DOUBLE*{value('all_lacks', 'lacks_group')}
 + .2::DOUBLE*{value('mage_ad', 'mage_group', 'ad_bin')} + .2::DOUBLE*{value('marksman_ad', 'marksman_group', 'ad_bin')} total FROM te),
cs AS (SELECT *, greatest(-.05, least(.05, total))*least(1, greatest(0, (size - 1)/4.0::DOUBLE)) score, -abs(ad_share - .4) mix FROM tf)"""


COMP = ENT + comp_sql("(SELECT * FROM p WHERE team_id = 100)", "game_id")


def blue_teams(spark: SparkSession, d: str) -> DataFrame:
    return gm.games(spark, d).select("game_id", F.col("blue").alias("team"), F.col("blue_wins").alias("y"))


@query(COMP + " SELECT game_id, size, front, physical, magic, wave, poke, fronts, mages, marksmen, lacks, round(ad_share, 6) ad_share, ad_bin, front_group, mage_group, marksman_group, wave_group, engage_group, poke_group, lacks_group FROM cs")
def team_composition(spark, d):
    rows = tm.team_composition(blue_teams(spark, d), gm.entity_dim(rates(spark, d)))
    lacks = sum((F.col(f"lacks_{c}").cast("int") for c in tm.THRESHOLDS), F.lit(0)).alias("lacks")
    return rows.select("game_id", "size", "front", "physical", "magic", "wave", "poke", "fronts", "mages", "marksmen", lacks, "ad_share", "ad_bin", *[f"{c}_group" for c in ("front", "mage", "marksman", "wave", "engage", "poke", "lacks")])


@query(COMP + " SELECT game_id, round(score, 6) + 0.0 composition_score, round(greatest(-.025, least(.025, mix*.18)), 6) + 0.0 mix FROM cs")
def composition_score(spark, d):
    """Scores of the blue teams, with the nearness of their damage to the wanted mix."""
    comp = tm.team_composition(blue_teams(spark, d), gm.entity_dim(rates(spark, d)))
    return tm.composition_score(comp).select("game_id", "composition_score", tm.damage_mix_score(F.col("ad_share")).alias("mix"))


RECO = SYN + ENT + """, ro AS (SELECT mate candidate, count(*) coverage, sum(lift)/3 pair_fit, sum(lift)/count(*) avg_lift, sum(z)/count(*) avg_z, min(games) min_games FROM syn WHERE anchor IN (7,21,40) AND mate NOT IN (7,21,40) GROUP BY 1),
rt AS (SELECT candidate, unnest([7, 21, 40, candidate]) entity_id FROM ro UNION ALL SELECT -1, unnest([7, 21, 40]))""" + comp_sql("rt", "candidate") + """,
rq AS (SELECT ro.*, (er.wins+100.0::DOUBLE)/(er.games+200) solo, .5 + .5*coverage/3.0::DOUBLE sure, cs.score - c0.score dc, cs.mix - c0.mix dm FROM ro JOIN er ON entity_id = candidate JOIN cs USING (candidate), (SELECT score, mix FROM cs WHERE candidate = -1) c0),
rf AS (SELECT *, round(pair_fit + .25*dc*sure + greatest(-.025, least(.025, .18*dm*sure)), 12) fit FROM rq),
rw AS (SELECT *, row_number() OVER (ORDER BY fit DESC, pair_fit DESC, avg_lift DESC, avg_z DESC, coverage DESC, min_games DESC, candidate) i, count(*) OVER () n FROM rf)"""


@query(RECO + " SELECT candidate, coverage, round(fit, 6) fit, round(pair_fit, 6) pair_fit, round(avg_z, 6) avg_z, round(solo, 6) solo, min_games, CASE WHEN i <= 11 THEN 'best' ELSE 'worst' END place FROM rw WHERE i <= 11 OR i = n")
def recommendation(spark, d):
    pairs, r = pairs_and_rates(spark, d)
    r = dc.checkpointed(r)
    rolled = dc.checkpointed(rt.rollup_candidates(rt.pair_synergy(pairs, r), ANCHORS))
    rows = tm.recommendation_labels(tm.recommend(rolled, r, ANCHORS, gm.entity_dim(r)), 3)
    return rows.select("candidate", "coverage", "fit", "pair_fit", "avg_z", "solo", "min_games", "place")


@query(RECO + """, rx AS (SELECT rf.*, coverage/3.0::DOUBLE cv, .25*dc*sure + greatest(-.025, least(.025, .18*dm*sure)) part, greatest(-.025, least(.025, .18*dm*sure)) mp FROM rf)
SELECT rx.candidate, CASE WHEN fit >= .05 THEN 'excellent fit' WHEN fit >= .03 THEN 'good fit' WHEN fit >= .01 THEN 'playable fit' ELSE 'low edge' END strength,
 CASE WHEN cv >= .75 AND min_games >= 60 AND abs(avg_z) >= 1 THEN 'high confidence' WHEN cv >= .5 AND min_games >= 40 AND abs(avg_z) >= .6 THEN 'medium confidence' ELSE 'early signal' END confidence,
 CASE WHEN abs(mp) >= .004 THEN CASE WHEN mp <= 0 THEN 'damage skew' WHEN af.ad_share > be.ad_share THEN 'adds AD' ELSE 'adds AP' END
  WHEN part > .001 AND be.front_group <> af.front_group AND af.front_group <> '0 front' THEN 'adds frontline' WHEN part > .001 AND be.poke_group = 'poke lack' AND af.poke_group = 'poke ok' THEN 'adds poke'
  WHEN part > .001 AND be.wave_group = 'wave lack' AND af.wave_group = 'wave ok' THEN 'adds waveclear' WHEN part > .001 AND be.engage_group = 'engage lack' AND af.engage_group = 'engage ok' THEN 'adds engage'
  WHEN part > .001 AND be.lacks_group <> af.lacks_group THEN 'rounds team' WHEN abs(part) < .001 THEN 'team neutral' ELSE 'team' END reason
FROM rx JOIN cs af USING (candidate), (SELECT * FROM cs WHERE candidate = -1) be""")
def recommendation_reasons(spark, d):
    """Every candidate's words: strength, confidence, and what it does to the team (without the percents)."""
    pairs, r = pairs_and_rates(spark, d)
    r = dc.checkpointed(r)
    rolled = dc.checkpointed(rt.rollup_candidates(rt.pair_synergy(pairs, r), ANCHORS))
    rows = tm.recommendation_labels(tm.recommend(rolled, r, ANCHORS, gm.entity_dim(r), limit=1 << 20), 3)
    return rows.select("candidate", "strength", "confidence", F.regexp_replace("reason", " [-+]?[0-9.]+%$", "").alias("reason"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every match as a pick session: blue's first as the current pick, red as the bench."""
    return gm.games(spark, d).select("game_id", F.col("blue").alias("team"), F.col("blue")[0].alias("current"), F.col("red").alias("bench"))


WEIGHT = ", w AS (SELECT entity_id, games, wins, ln((wins+100.0::DOUBLE)/(games+200)/(1-(wins+100.0::DOUBLE)/(games+200))) weight FROM er)"


@query(WEIGHT + """, tp AS (SELECT game_id, sum(weight) l FROM p JOIN w USING (entity_id) WHERE team_id = 100 GROUP BY 1),
ss AS (SELECT game_id, blue[1] cur, unnest(list_concat([blue[1]], red)) candidate FROM g)
SELECT ss.game_id, cur current, candidate, round(1/(1+exp(-(l - wc.weight + wi.weight))), 6) p, round(1/(1+exp(-(l - wc.weight + wi.weight))) - 1/(1+exp(-l)), 6) + 0.0::DOUBLE delta FROM ss JOIN tp USING (game_id) JOIN w wc ON wc.entity_id = cur JOIN w wi ON wi.entity_id = candidate""")
def swap_suggestions(spark, d):
    return tm.swap_suggestions(sessions(spark, d), rt.log_odds_weights(rates(spark, d))).select("game_id", "current", "candidate", "p", "delta")


@query(DELTA + WEIGHT + """, tp AS (SELECT game_id, sum(weight) l FROM p JOIN w USING (entity_id) WHERE team_id = 100 GROUP BY 1),
ss AS (SELECT game_id, blue[1] cur, unnest(list_concat([blue[1]], red)) candidate FROM g),
sw AS (SELECT game_id, cur, candidate, 1/(1+exp(-(l - wc.weight + wi.weight))) - 1/(1+exp(-l)) delta FROM ss JOIN tp USING (game_id) JOIN w wc ON wc.entity_id = cur JOIN w wi ON wi.entity_id = candidate),
rs AS (SELECT game_id, unnest(blue[2:]) anchor FROM g)
SELECT game_id, cur current, candidate, count(d) anchors, round(.7*coalesce(avg(d), 0) + .3*any_value(delta), 6) + 0.0 score FROM sw JOIN rs USING (game_id) LEFT JOIN ad ON ad.anchor = rs.anchor AND mate = candidate GROUP BY 1, 2, 3""")
def blended_swap_score(spark, d):
    r = dc.checkpointed(rates(spark, d))
    found = tm.blended_swap_score(sessions(spark, d), dc.checkpointed(rt.anchor_delta(rt.pair_rates(gm.games(spark, d)), r)), rt.log_odds_weights(r))
    return found.select("game_id", "current", "candidate", "anchors", "score")


@query(WEIGHT + " SELECT entity_id, games, round(weight, 6) weight, round(weight*25, 6) points, round((wins+15.0::DOUBLE)/(games+30), 6) bayes, round(CAST(wins AS DOUBLE)/games, 6) win_rate FROM w")
def weight_tier_list(spark, d):
    return tm.weight_tier_list(rt.log_odds_weights(rates(spark, d)))


@query(WEIGHT + " SELECT round(avg(weight), 6) mu, round(stddev_pop(weight), 6) sd FROM w")
def weight_moments(spark, d):
    return rt.log_odds_weights(rates(spark, d)).agg(F.avg("weight").alias("mu"), F.stddev_pop("weight").alias("sd"))


@query(WEIGHT + """, x AS (SELECT weight, row_number() OVER (ORDER BY weight DESC, entity_id) i, row_number() OVER (ORDER BY weight, entity_id) j FROM w)
SELECT 'top' team, round(1/(1+exp(-sum(weight))), 6) p FROM x WHERE i <= 5 UNION ALL SELECT 'bottom', round(1/(1+exp(-sum(weight))), 6) FROM x WHERE j <= 5""")
def extreme_teams(spark, d):
    return tm.extreme_teams(rt.log_odds_weights(rates(spark, d)))


@query(TIERS + """, pv AS (SELECT entity_id, (wins + 100.0::DOUBLE)/(games + 200) b FROM (SELECT entity_id, count(*) games, sum(win) wins FROM p WHERE queue_id = 2400 GROUP BY 1)),
q AS (SELECT coalesce(ti.entity_id, pv.entity_id) entity_id, """ + TIER.format("pv.b") + """ before, ti.tier after FROM pv FULL JOIN ti USING (entity_id))
SELECT *, CASE WHEN before = after THEN 'same' WHEN list_position(['OP','T1','T2','T3','T4','T5'], after) < list_position(['OP','T1','T2','T3','T4','T5'], before) THEN 'up' ELSE 'down' END change FROM q""")
def tier_diff(spark, d):
    p = gm.players(spark, d)
    return rt.tier_diff(rt.entity_tiers(p.where("queue_id = 2400")), rt.entity_tiers(p))


# splits and evaluation

SPLIT = """, sp AS (SELECT *, CASE WHEN i >= n - greatest(1, CAST(floor(n*0.15::DOUBLE) AS INT)) THEN 'test' WHEN i >= n - 2*greatest(1, CAST(floor(n*0.15::DOUBLE) AS INT)) THEN 'val' ELSE 'train' END split FROM (SELECT *, row_number() OVER (ORDER BY created_ms, game_id) - 1 i, count(*) OVER () n FROM g))"""


@query(SPLIT + " SELECT game_id, split FROM sp")
def time_split(spark, d):
    return mo.time_split(gm.games(spark, d)).select("game_id", "split")


@query(SPLIT + " SELECT split, count(*) n, round(avg(blue_wins::DOUBLE), 6) base_rate FROM sp GROUP BY 1")
def split_base_rate(spark, d):
    return mo.split_base_rate(mo.time_split(gm.games(spark, d)))


@query(SPLIT + " SELECT split, version, count(*) n FROM sp GROUP BY 1, 2")
def split_version_counts(spark, d):
    return mo.split_version_counts(mo.time_split(gm.games(spark, d)))


@query("""!, vs AS (SELECT *, row_number() OVER (ORDER BY created_ms, game_id) - 1 i, count(*) OVER () n FROM g WHERE version = '16.6'), vt AS (SELECT *, CAST(floor(n*0.7::DOUBLE) AS INT) a FROM vs)
SELECT game_id, CASE WHEN i < a THEN 'train' WHEN i < a + (n-a)//2 THEN 'val' ELSE 'test' END split FROM vt UNION ALL SELECT game_id, 'train' FROM g WHERE version = '16.5'""".replace("!,", ","))
def version_time_split(spark, d):
    return mo.version_time_split(gm.games(spark, d), ["16.5"], "16.6").select("game_id", "split")


@query(", bl AS (SELECT game_id, CAST(floor((row_number() OVER (ORDER BY created_ms, game_id) - 1)*6/count(*) OVER ()) AS BIGINT) b FROM g) SELECT f fold, CASE WHEN b = f THEN 'test' ELSE 'train' END part, count(*) n FROM bl, range(1, 6) t(f) WHERE b <= f GROUP BY 1, 2")
def expanding_folds(spark, d):
    return mo.expanding_folds(gm.games(spark, d)).groupBy("fold", "part").agg(F.count("*").alias("n"))


SCORED = WEIGHT + """, sd AS (SELECT sp.game_id, split, blue_wins y, 1/(1+exp(-l)) p FROM sp JOIN (SELECT game_id, sum(weight) l FROM (SELECT game_id, CASE WHEN team_id = 100 THEN weight ELSE -weight END weight FROM p JOIN w USING (entity_id)) GROUP BY 1) USING (game_id))"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Every match with its split and a probability from the summed weights of both teams."""
    g = mo.time_split(gm.games(spark, d)).select("game_id", "split", "blue", "red", F.col("blue_wins").alias("label"))
    w = rt.log_odds_weights(rates(spark, d)).select("entity_id", "weight")
    each = F.concat(F.transform("blue", lambda e: F.struct(e.alias("entity_id"), F.lit(1).alias("sign"))), F.transform("red", lambda e: F.struct(e.alias("entity_id"), F.lit(-1).alias("sign"))))
    rows = g.select("game_id", "split", "label", F.explode(each).alias("x")).select("game_id", "split", "label", "x.*").join(w, "entity_id")
    sums = rows.groupBy("game_id", "split", "label").agg(F.sum((F.col("weight") * F.col("sign")).cast("decimal(30,15)")).cast("double").alias("logit"))
    return sums.withColumn("p", est.sigmoid("logit"))


@query(SPLIT + SCORED + """ SELECT split, count(*) n, round(avg(-(y*ln(p)+(1-y)*ln(1-p))), 6) log_loss, round(avg(((p >= .5) = (y = 1))::INT::DOUBLE), 6) accuracy, round(avg((p-y)*(p-y)), 6) brier, round(-(avg(y)*ln(avg(y)) + (1-avg(y))*ln(1-avg(y))), 6) constant_log_loss FROM sd GROUP BY 1""")
def log_loss(spark, d):
    return mo.binary_metrics(scored(spark, d), "label", "p", "split")


@query(SPLIT + SCORED + ", cb AS (SELECT split, CAST(floor(p*10) AS INT) b, count(*) n, abs(avg(p) - avg(y)) gap FROM sd GROUP BY 1, 2) SELECT split, round(sum(n*gap)/sum(n), 6) ece FROM cb GROUP BY 1")
def calibration_ece(spark, d):
    return mo.calibration_error(scored(spark, d), "label", "p", by=("split",))


@query(SPLIT + """, up AS (SELECT sp.game_id, split, x.entity_id a, y.entity_id b FROM sp JOIN p x USING (game_id) JOIN p y ON x.game_id = y.game_id AND x.team_id = y.team_id AND x.entity_id < y.entity_id),
us AS (SELECT up.game_id, count(*) FILTER (t.a IS NULL) unseen FROM up LEFT JOIN (SELECT DISTINCT a, b FROM up WHERE split = 'train') t ON t.a = up.a AND t.b = up.b WHERE split = 'test' GROUP BY 1)
SELECT game_id, unseen, CASE WHEN unseen = 0 THEN 'low' WHEN unseen <= 3 THEN 'mid' ELSE 'high' END level FROM us""")
def unseen_pairs(spark, d):
    rows = mo.time_split(gm.games(spark, d))
    return mo.unseen_pairs(rows.where("split = 'test'"), rows.where("split = 'train'"))


@query("!SELECT game_id, list_sort(list_concat([x - 1 FOR x IN blue], list_sort([101 + (x.a-1)*101 - (x.a-1)*x.a//2 + (x.b-x.a-1) FOR x IN q]))) places FROM (SELECT game_id, any_value(blue) blue, list({'a': u.entity_id, 'b': v.entity_id}) q FROM g JOIN p u USING (game_id) JOIN p v USING (game_id) WHERE u.team_id = 100 AND v.team_id = 100 AND u.entity_id < v.entity_id GROUP BY 1)")
def solo_pair_places(spark, d):
    rows = gm.games(spark, d)
    return mo.solo_pair_features(blue_teams(spark, d), mo.build_vocab(rows), 101).select("game_id", "places")


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, list[int]]:
    rows = mo.time_split(gm.games(spark, d)).withColumn("label", F.col("blue_wins").cast("double"))
    ids = [r["entity_id"] for r in mo.build_vocab(rows.where("split = 'train'")).collect()]  # one row for each entity
    return mo.as_vectors(mo.two_team_places(rows, ids), len(ids)), ids


@query(", v AS (SELECT entity_id, CAST(row_number() OVER (ORDER BY entity_id) - 1 AS INTEGER) i FROM er) SELECT game_id, CAST(list_sum(list_transform(list(i ORDER BY i), lambda x: x)) AS BIGINT) place_sum, string_agg(i || ':' || CASE WHEN team_id = 100 THEN 1 ELSE -1 END, ' ' ORDER BY i) said FROM p JOIN v USING (entity_id) GROUP BY 1")
def two_team_places(spark, d):
    """Sparse features of both teams of each match, as text."""
    games = gm.games(spark, d)
    ids = [r["entity_id"] for r in mo.build_vocab(games).collect()]  # one row for each entity
    rows = mo.two_team_places(games, ids)
    said = F.array_join(F.transform("sparse", lambda x: F.concat_ws(":", x["place"].cast("string"), x["value"].cast("int").cast("string"))), " ")
    return rows.select("game_id", F.aggregate("sparse.place", F.lit(0).cast("long"), lambda a, x: a + x).alias("place_sum"), said.alias("said"))


@query(rounded=4)
def leak_checks(spark, d):
    """Shuffled labels, planted weights and accuracy over the matches' split by time."""
    rows = mo.time_split(gm.games(spark, d)).where("split <> 'test'")
    return mo.leak_checks(rows.select("game_id", "created_ms", "blue", "red", "blue_wins", "split"))


@query(rounded=4)
def model_table(spark, d):
    """Logistic model of both teams, tuned on val, then calibrated: metrics of each split."""
    rows, _ = _labelled(spark, d)
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    model, _c = mo.sweep_lr(train, val)
    scored_rows = mo.predicted(model, rows).select("split", "label", "p", est.logit("p", 1e-6).alias("logit"))
    t = mo.fit_temperature(scored_rows.where("split = 'val'"), "label", "logit")
    both = scored_rows.withColumn("model", F.lit("lr")).unionByName(scored_rows.withColumn("p", est.sigmoid(F.col("logit") / t)).withColumn("model", F.lit("lr_calibrated")))
    return mo.evaluation_table(both)


@query(rounded=4)
def version_model(spark, d):
    """Logistic model of both teams with effects of each version, fitted on train: metrics of each split."""
    rows, ids = _labelled(spark, d)
    rows = rows.withColumn("version", tx.truncate_version(F.col("patch"), 2))
    train = rows.where("split = 'train'")
    rows = mo.version_features(train, rows, len(ids)).select("split", "label", "features")
    model = mo.fit_lr(rows.where("split = 'train'"), c=0.01)
    return mo.evaluation_table(mo.predicted(model, rows).select("split", "label", "p").withColumn("model", F.lit("lr_version")))


@query("!SELECT CASE WHEN k % 3 = 0 THEN 'web' ELSE 'ladder' END family, queue_id, count(*) matches, round(avg(blue_wins::DOUBLE), 3) base_rate FROM g GROUP BY ROLLUP (1, 2)", rounded=3)
def family_mode_rollup(spark, d):
    rows = gm.games(spark, d).withColumn("family", F.when(F.col("k") % 3 == 0, "web").otherwise("ladder"))
    return dc.family_mode_rollup(rows).drop("level")


# discovery


def actors(spark: SparkSession, d: str) -> DataFrame:
    """Customers as actors, with a family, what they brought and when they were visited."""
    seen = gm.games(spark, d).groupBy("actor_id").agg(F.count("*").alias("new_games"), F.max("created_ms").alias("latest_match_ms"))
    c = F.col("c_custkey")
    rows = gm.table(spark, d, "customer").select(
        c.alias("actor_id"), F.element_at(F.array(*[F.lit(x) for x in ("ladder", "web", "friend")]), (c % 3 + 1).cast("int")).alias("family"), (c % 5).alias("priority"), (c % 4).alias("depth"),
        (c % 2 == 0).alias("processed"), F.when(c % 3 != 0, F.lit(880000000000) + c * 1000).alias("last_crawled_ms"),
    )
    return rows.join(seen, "actor_id", "left").withColumn("new_games", F.coalesce("new_games", F.lit(0)))


ACTORS = """, ac AS (SELECT c_custkey actor_id, ['ladder','web','friend'][c_custkey % 3 + 1] AS family, c_custkey % 5 priority, c_custkey % 4 depth, c_custkey % 2 = 0 processed, CASE WHEN c_custkey % 3 <> 0 THEN 880000000000 + c_custkey*1000 END last_crawled_ms, coalesce(n, 0) new_games, l latest_match_ms
 FROM customer LEFT JOIN (SELECT actor, count(*) n, max(created_ms) l FROM g GROUP BY 1) ON actor = c_custkey)"""


@query(ACTORS + """, fa AS (SELECT family, count(*) actors, count(*) FILTER (processed) processed, count(*) FILTER (new_games > 0) productive, CAST(sum(new_games) AS BIGINT) "yield" FROM ac GROUP BY 1),
fg AS (SELECT CASE WHEN k % 4 = 0 THEN 'web' WHEN k % 4 = 1 THEN 'ladder' ELSE 'match' END family, count(*) matches FROM g GROUP BY 1)
SELECT coalesce(fa.family, fg.family) family, coalesce(actors, 0) actors, coalesce(processed, 0) processed, coalesce(productive, 0) productive, coalesce("yield", 0) "yield", coalesce(matches, 0) matches FROM fa FULL JOIN fg USING (family)""")
def family_roi(spark, d):
    k = F.col("k") % 4
    return dc.family_roi(actors(spark, d), gm.games(spark, d).withColumn("family", F.when(k == 0, "web").when(k == 1, "ladder").otherwise("match")))


NOW = 900_000_000_000


@query(ACTORS + " SELECT actor_id, new_games FROM (SELECT * FROM ac WHERE coalesce(last_crawled_ms, 0) <= 900000000000 - 3600000 AND new_games > 0 AND latest_match_ms >= 900000000000 - 259200000 ORDER BY new_games DESC, latest_match_ms DESC, priority, last_crawled_ms NULLS FIRST, actor_id LIMIT 80)")
def reseed_candidates(spark, d):
    return dc.reseed(actors(spark, d), NOW, 80).select("actor_id", "new_games")


@query(ACTORS + " SELECT actor_id, new_games FROM ac WHERE family IN ('web', 'friend') AND new_games > 0 AND coalesce(last_crawled_ms, 0) <= 900000000000 - 3600000 ORDER BY priority, latest_match_ms DESC, depth, actor_id % 7 DESC, actor_id LIMIT 120")
def reseed_family(spark, d):
    rows = actors(spark, d).select("*", F.col("family").alias("source"), F.col("depth").alias("process_count"), (F.col("actor_id") % 7).alias("first_seen_ms"))
    return dc.reseed_family(rows, ["web", "", "friend"], NOW).select("actor_id", "new_games")


@query("WITH w AS (SELECT user_id, max(epoch_ms(ts)) s FROM events GROUP BY 1), n AS (SELECT max(s) n FROM w) SELECT count(*) FILTER (s >= n - 7200000) alive, count(*) FILTER (s < n - 7200000) dead, CAST(sum(user_id) FILTER (s >= n - 7200000) AS BIGINT) ids FROM w, n")
def worker_counts(spark, d):
    """Users as workers: alive if seen in the last two hours of events."""
    signs = gm.table(spark, d, "events").select(F.col("user_id").alias("worker_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("seen_ms"))
    now = signs.agg(F.max("seen_ms")).first()[0]
    return dc.worker_counts(signs, now, 7_200_000).select("alive", "dead", F.aggregate("workers", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


@query("!SELECT actor actor_id, coalesce(arg_min(f, k) FILTER (f NOT IN ('', 'unknown', 'legacy_match')), 'unknown') family FROM (SELECT actor, k, ['ladder', '', 'unknown', 'web', 'legacy_match', 'friend'][k % 6 + 1] f FROM g WHERE k % 6 <> 2 OR k % 12 = 2) GROUP BY 1")
def attribute_family(spark, d):
    """First known root family of each actor by order of discovery."""
    k = F.col("k")
    rows = gm.games(spark, d).where((k % 6 != 2) | (k % 12 == 2)).select("actor_id", k.alias("position"), F.element_at(F.array(*map(F.lit, ("ladder", "", "unknown", "web", "legacy_match", "friend"))), (k % 6 + 1).cast("int")).alias("family"))
    return dc.attribute_family(rows)


@query("""WITH p AS (SELECT c_nationkey tier, c_custkey % 9 page, c_custkey position, c_custkey % 400 actor_id FROM customer), z AS (SELECT tier, page, count(*) n FROM p GROUP BY 1, 2), l AS (SELECT tier, min(page) FILTER (n < 2) AS last FROM z GROUP BY 1)
SELECT actor_id, s[1] tier, s[2] page, s[3] AS position FROM (SELECT actor_id, min([tier, page, position]) s FROM p JOIN l USING (tier) WHERE page <= coalesce(last, 2147483647) GROUP BY 1)""")
def collect_actors(spark, d):
    """Distinct actors over pages, up to and with each tier's first page that isn't full."""
    c = F.col("c_custkey")
    rows = gm.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("tier"), (c % 9).alias("page"), c.alias("position"), (c % 400).alias("actor_id"))
    return dc.collect_actors(rows, full=2)


@query("SELECT DISTINCT user_id actor_id, CAST(event_id // 10 AS BIGINT) match_id FROM events WHERE user_id % 11 <> 0")
def participants_of(spark, d):
    """Actors of groups of ten events, once each; some ids are missing."""
    e = gm.table(spark, d, "events")
    rows = e.groupBy(F.expr("event_id div 10").alias("match_id")).agg(F.collect_list(F.struct(F.when(F.col("user_id") % 11 != 0, F.col("user_id")).alias("a"))).alias("x"))
    return dc.participants_of(rows.select(F.transform("x", lambda x: x["a"]).alias("actors"), "match_id"))


@query(ACTORS + " SELECT actor_id, latest_match_ms FROM ac WHERE NOT processed AND latest_match_ms IS NOT NULL ORDER BY latest_match_ms DESC, priority, depth, actor_id LIMIT 50")
def next_batch(spark, d):
    rows = actors(spark, d).where("latest_match_ms is not null").select("*", F.when(F.col("processed"), "done").otherwise("pending").alias("status"), F.lit(0).alias("eligible_ms"), F.lit(0).alias("updated_ms"), F.col("actor_id").alias("queue_idx"))
    return dc.best_candidates(rows, NOW, 50).select("actor_id", "latest_match_ms")


@query(ACTORS + """, inc AS (SELECT c_custkey + 100 actor_id, c_custkey % 3 priority, c_custkey % 2 depth FROM customer)
SELECT inc.actor_id, inc.priority, inc.depth, CASE WHEN ac.priority IS NULL THEN 'new' WHEN processed AND inc.priority < ac.priority THEN 'requeued' WHEN inc.priority < ac.priority OR inc.depth < ac.depth THEN 'updated' ELSE 'noop' END outcome FROM inc LEFT JOIN ac USING (actor_id)""")
def classify_upsert(spark, d):
    c = F.col("c_custkey")
    return dc.classify_upsert(actors(spark, d), gm.table(spark, d, "customer").select((c + 100).alias("actor_id"), (c % 3).alias("priority"), (c % 2).alias("depth")))


def queued(spark: SparkSession, d: str) -> DataFrame:
    """Customers as entries of the frontier: status, source, the match they were found in, and its time where known."""
    c = F.col("c_custkey")
    word = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    found = F.when(c % 5 != 0, (c * 3 + 1).cast("string"))
    return gm.table(spark, d, "customer").select(
        c.alias("actor_id"), word(("pending", "done", "failed"), c).alias("status"), word(("ladder", "web", "friend"), c * 7).alias("source"), (c % 6).alias("priority"),
        found.alias("found_in"), F.when(c % 4 == 0, F.lit(880000000000) + c).otherwise(0).alias("found_ms"),
    )


QUEUED = """, qu AS (SELECT c_custkey actor_id, ['pending','done','failed'][c_custkey % 3 + 1] status, ['ladder','web','friend'][c_custkey*7 % 3 + 1] source, c_custkey % 6 priority,
 CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey*3 + 1 AS VARCHAR) END found_in, CASE WHEN c_custkey % 4 = 0 THEN 880000000000 + c_custkey ELSE 0 END found_ms FROM customer)"""


@query(QUEUED + " SELECT (SELECT count(*) FROM g) games, (SELECT count(*) FROM g WHERE queue_id = 2400) mode_2400, (SELECT count(*) FROM qu WHERE status = 'pending') pending")
def scalar_counts(spark, d):
    return dc.scalar_counts(gm.games(spark, d), queued(spark, d))


@query(QUEUED + " SELECT actor_id, CASE WHEN found_ms = 0 AND found_in IS NOT NULL THEN coalesce((SELECT max(created_ms) FROM g WHERE game_id = found_in), found_ms, 0) ELSE found_ms END found_ms FROM qu")
def backfill_times(spark, d):
    return dc.backfill_from(queued(spark, d), gm.games(spark, d), "found_in", "game_id", "found_ms", "created_ms").select("actor_id", "found_ms")


@query(QUEUED + """ SELECT 'status' kind, status name, count(*) n, min(priority) priority FROM qu GROUP BY 2 UNION ALL SELECT 'source', source, count(*), min(priority) FROM qu GROUP BY 2""")
def frontier_counts(spark, d):
    return dc.frontier_counts(queued(spark, d), queued(spark, d))


@query(QUEUED + """, v AS (SELECT patch, count(*) n, max(created_ms) m FROM g WHERE queue_id = 2400 GROUP BY 1 ORDER BY m DESC, patch DESC LIMIT 1)
SELECT (SELECT count(*) FROM g) total, (SELECT count(*) FROM g WHERE queue_id = 2400) mode_total, patch latest_patch, n latest_patch_games, m latest_ms, (SELECT round(avg(blue_wins::DOUBLE), 6) FROM g WHERE queue_id = 2400) base_rate,
 (SELECT count(*) FROM qu WHERE status = 'pending') pending, (SELECT count(*) FROM qu WHERE status = 'done') done, (SELECT count(*) FROM qu WHERE status = 'failed') failed, (SELECT count(*) FROM qu) known FROM v""")
def status_snapshot(spark, d):
    return dc.status_snapshot(gm.games(spark, d), queued(spark, d), 2400)


@query(PAIRS + " SELECT anchor, mate, games, wins FROM pr2 WHERE mate IN (SELECT entity_id FROM er WHERE CAST(wins AS DOUBLE)/games >= .5)")
def visible_pairs(spark, d):
    seen = rates(spark, d).where(est.raw_rate("wins", "games") >= 0.5)
    return mart.visible_pairs(rt.pair_rates(gm.games(spark, d)), seen).select("anchor", "mate", "games", "wins")


@query(SYN + """, po AS (SELECT *, greatest(least(expected, 0.9999), 0.0001) q FROM syn WHERE anchor < mate), pi AS (SELECT *, games*q*(1-q) info, wins - games*q ov FROM po),
t2 AS (SELECT greatest(0, (sum(ov*ov/info) - count(*))/sum(info)) tau2 FROM pi)
SELECT anchor, mate, games, round(ov/info, 6) effect, round(ov*tau2/(tau2*info+1), 6) + 0.0 pooled, round(sqrt(tau2/(tau2*info+1)), 6) sd, round(1/(1+exp(-(ln(q/(1-q)) + ov*tau2/(tau2*info+1)))), 6) rate, round(tau2, 6) tau2 FROM pi, t2""")
def pooled_pairs(spark, d):
    """Effects of pairs over their members' logits, shrunk by a strength that all pairs give."""
    return rt.pooled_pairs(synergy(spark, d).where("anchor < mate")).select("anchor", "mate", "games", "effect", "pooled", "sd", "rate", "tau2")


@query(SYN + TOPN + TIERS + """, mp AS (SELECT entity_id, string_agg(rarity || ':' || attribute_id, ',' ORDER BY rarity, t) FILTER (t <= 5) best, string_agg(rarity || ':' || attribute_id, ',' ORDER BY rarity, u) FILTER (u <= 5) worst FROM rk GROUP BY 1),
mm AS (SELECT anchor entity_id, count(*) n_pairs, string_agg(mate, ',' ORDER BY mate) mates FROM syn WHERE mate IN (SELECT entity_id FROM er) AND games >= 30 GROUP BY 1)
SELECT entity_id, games, tier, round(bayes, 4) rate, best, worst, coalesce(n_pairs, 0) n_pairs, coalesce(mates, '') mates FROM ti JOIN mp USING (entity_id) LEFT JOIN mm USING (entity_id)""", rounded=4)
def entity_mart(spark, d):
    """The nested mart of the entities, its lists as text."""
    t = dc.checkpointed(tiers(spark, d))
    pairs = rt.pair_synergy(rt.pair_rates(gm.games(spark, d)), t.select("entity_id", "games", "wins")).where("games >= 30")
    rows = mart.entity_mart(t, _ends(spark, d), mart.visible_pairs(pairs, t))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["rarity"], x["attribute_id"].cast("string"))), ",").alias(c)
    return rows.select("entity_id", "games", "tier", F.col("bayes").alias("rate"), said("best"), said("worst"), F.size("pairs").alias("n_pairs"), F.array_join(F.array_sort(F.transform("pairs", lambda x: x["id"])), ",").alias("mates"))


def minute_scores(spark: SparkSession, d: str, r: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A dimension of entities with role tags, and scores as a profile file has them, with gaps."""
    e = F.col("entity_id")
    r = r or rates(spark, d)
    dim = r.select(e, F.when(e % 10 != 0, F.array(F.element_at(F.array(*map(F.lit, ("Tank", "Fighter", "Mage", "Marksman", "Support", "Assassin"))), (e % 6 + 1).cast("int")))).alias("tags"))
    part = lambda x: (x / 100.0).cast("double")
    scores = r.where(e % 9 != 0).select(
        e.alias("champion_id"), F.when(e % 7 != 0, (300 + e * 37 % 900).cast("double")).alias("empirical_damage_per_min"), part(e * 13 % 101).alias("empirical_physical_damage_ratio"),
        part(F.greatest(F.lit(0), 95 - e * 13 % 101)).alias("empirical_magic_damage_ratio"), F.lit(0.05).alias("empirical_true_damage_ratio"), (e * 3 % 13 / 10.0).cast("double").alias("wave_clear_score"),
    )
    return dim, scores


MINUTE = """, mi AS (SELECT entity_id, CASE WHEN entity_id % 10 = 0 THEN 'Unknown' ELSE ['Tank','Fighter','Mage','Marksman','Support','Assassin'][entity_id % 6 + 1] END AS role, entity_id % 9 <> 0 AS scored,
 CASE WHEN entity_id % 9 <> 0 AND entity_id % 7 <> 0 THEN CAST(300 + entity_id*37 % 900 AS DOUBLE) ELSE 0 END dpm, CASE WHEN entity_id % 9 <> 0 THEN (entity_id*13 % 101)/100.0::DOUBLE ELSE 0 END ph, CASE WHEN entity_id % 9 <> 0 THEN greatest(0, 95 - entity_id*13 % 101)/100.0::DOUBLE ELSE 0 END mg,
 CASE WHEN entity_id % 9 <> 0 THEN .05::DOUBLE ELSE 0 END tr, CASE WHEN entity_id % 9 <> 0 THEN (entity_id*3 % 13)/10.0::DOUBLE ELSE 0 END wave FROM er),
mb AS (SELECT *, CASE WHEN ph >= .55 AND ph >= mg + .15::DOUBLE THEN 'physical' WHEN mg >= .55 AND mg >= ph + .15::DOUBLE THEN 'magic' WHEN role IN ('Marksman','Fighter','Assassin') THEN 'physical' WHEN role IN ('Mage','Support') THEN 'magic' ELSE 'mixed' END damage FROM mi),
mc AS (SELECT entity_id, role, damage, CASE WHEN dpm*ph + dpm*mg > 0 THEN dpm*ph WHEN damage = 'physical' THEN 1 WHEN damage = 'mixed' THEN .5 ELSE 0 END physical,
 CASE WHEN dpm*ph + dpm*mg > 0 THEN dpm*mg WHEN damage = 'magic' THEN 1 WHEN damage = 'mixed' THEN .5 ELSE 0 END magic, dpm*tr true_damage, wave FROM mb)"""


@query(MINUTE + " SELECT entity_id, role, damage, round(physical, 6) physical, round(magic, 6) magic, round(true_damage, 6) true_damage, wave FROM mc")
def profiles_by_minute(spark, d):
    """Profiles from damage a minute and its shares, with what stands in where there is none."""
    return dims.entity_profiles(*minute_scores(spark, d)).select("entity_id", "role", "damage", "physical", "magic", "true_damage", "wave")


def whole_mart(spark: SparkSession, d: str) -> DataFrame:
    """The published record of each entity; rates and attributes are counted once for all its parts."""
    p = gm.players(spark, d)
    t = dc.checkpointed(tiers(spark, d))
    pairs = rt.pair_synergy(rt.pair_rates(gm.games(spark, d)), t.select("entity_id", "games", "wins")).where("games >= 30")
    attr = dc.checkpointed(rt.entity_attribute_rates(p))
    picks = pk.pick_lift(attr, gm.attribute_dim(spark), gm.entity_dim(t))
    sets = pk.top_bottom_affinity(pk.category_affinity(dc.checkpointed(set_counts(spark, d, t)), 350.0, exact=False, name="set"), name="set")
    return mart.published_mart(t.select("entity_id", "games", "tier"), _ends(spark, d, attr, t), picks, mart.visible_pairs(pairs, t), {"sets": (sets, "set")}, dims.entity_profiles(*minute_scores(spark, d, t)))


def both_ends(mart_rows: DataFrame, *lists: str) -> DataFrame:
    """(entity_id, end, x): the entries of two lists of each record, with the list's name."""
    named = lambda end: lambda x: F.struct(F.lit(end).alias("end"), x.alias("x"))
    each = [F.transform(c, named(c.rsplit(".", 1)[-1])) for c in lists]
    return mart_rows.select("entity_id", F.explode(F.concat(*each)).alias("e")).select("entity_id", "e.end", "e.x")


ENDS = """ SELECT rk.entity_id, e AS "end", rk.rarity, CASE e WHEN 'best' THEN t ELSE u END rank, rk.attribute_id, rk.games, round(posterior, 4) wr, round(posterior - b, 4) lift, round(lcb - b, 4) lcb, round(peer, 4) peer_pick, round((ph.games + .5*m*peer)/(ph.t + .5*m), 4) pick,
 round(ln((ph.games + .5*m*peer)/(ph.t + .5*m)/peer), 3) pick_lift FROM (SELECT *, unnest(['best', 'worst']) e FROM rk) rk JOIN rb USING (entity_id, attribute_id) JOIN ph USING (entity_id, attribute_id) WHERE CASE e WHEN 'best' THEN rk.t ELSE rk.u END <= 5"""


@query((PICK + TOPN[len(ATTRS) :] + ENDS).replace("rk.games", "rb.games").replace("CASE e WHEN 'best' THEN t ELSE u END rank", "CASE e WHEN 'best' THEN rk.t ELSE rk.u END rank"), rounded=4)
def mart_attributes(spark, d):
    """The attributes at either end of each entity's record, with their numbers."""
    rows = both_ends(whole_mart(spark, d), "best", "worst")
    x = "x.rarity", "x.rank", F.col("x.id").alias("attribute_id"), F.col("x.g").alias("games"), "x.wr", "x.lift", "x.lcb", "x.peer_pick", "x.pick", "x.pick_lift"
    return rows.select("entity_id", "end", *x)


@query(AFF + """, aj AS (SELECT *, m - pr res, greatest(0, least(1, m - 1.2815515655446004::DOUBLE*sd)) - pr lo, greatest(0, least(1, m + 1.2815515655446004::DOUBLE*sd)) - pr hi, games >= 45 prim, max(CASE WHEN games >= 45 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id) n_prim FROM ah),
ak AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY lo DESC, res DESC, games DESC, "set") a, row_number() OVER (PARTITION BY entity_id ORDER BY hi, res, games, "set") z FROM aj WHERE prim OR n_prim = 0)
SELECT entity_id, e AS "end", CASE e WHEN 'top' THEN a ELSE z END rank, "set" AS name, games g, round(m, 4) wr, round(m - baseline, 4) lift, round(res, 4) res, round(lo, 4) score, round(hi, 4) bad_score FROM (SELECT *, unnest(['top', 'bottom']) e FROM ak) WHERE CASE e WHEN 'top' THEN a ELSE z END <= 4""", rounded=4)
def mart_categories(spark, d):
    """The sets at either end of each entity's record, with their numbers."""
    rows = both_ends(whole_mart(spark, d), "sets.top", "sets.bottom")
    return rows.select("entity_id", "end", *[f"x.{c}" for c in ("rank", "name", "g", "wr", "lift", "res", "score", "bad_score")])


@query(SYN + MINUTE + """ SELECT anchor entity_id, mate id, syn.games g, round(raw, 4) wr, round(expected, 4) expected, round(lift, 4) lift, round(z, 3) z, round(physical, 3) physical, round(magic, 3) magic FROM syn JOIN mc ON mc.entity_id = anchor WHERE syn.games >= 30""", rounded=4)
def mart_pairs(spark, d):
    """The pairs of each entity's record, with their numbers, beside the damage of its profile."""
    rows = whole_mart(spark, d).select("entity_id", F.explode("pairs").alias("x"), "profile.physical", "profile.magic")
    return rows.select("entity_id", *[f"x.{c}" for c in ("id", "g", "wr", "expected", "lift", "z")], "physical", "magic")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(actor_id, match_id): customers and the suppliers that served their orders."""
    o, li = gm.table(spark, d, "orders"), gm.table(spark, d, "lineitem")
    return o.join(li.select("l_orderkey", "l_suppkey").distinct(), o.o_orderkey == F.col("l_orderkey")).select(F.col("o_custkey").alias("actor_id"), F.col("l_suppkey").alias("match_id")).distinct()


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey a, l_suppkey m FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
h0 AS (SELECT DISTINCT a FROM e WHERE a IN (1, 2, 5)), s AS (SELECT a FROM (VALUES (1), (2), (5)) t(a)),
h1 AS (SELECT DISTINCT y.a FROM e x JOIN e y USING (m) WHERE x.a IN (SELECT a FROM s) AND y.a NOT IN (SELECT a FROM s)),
h2 AS (SELECT DISTINCT y.a FROM e x JOIN e y USING (m) WHERE x.a IN (SELECT a FROM h1) AND y.a NOT IN (SELECT a FROM h1) AND y.a NOT IN (SELECT a FROM s)),
h3 AS (SELECT DISTINCT y.a FROM e x JOIN e y USING (m) WHERE x.a IN (SELECT a FROM h2) AND y.a NOT IN (SELECT a FROM h2) AND y.a NOT IN (SELECT a FROM h1) AND y.a NOT IN (SELECT a FROM s))
SELECT CAST(a AS BIGINT) actor_id, CAST(0 AS BIGINT) depth FROM s UNION ALL SELECT a, 1 FROM h1 UNION ALL SELECT a, 2 FROM h2 UNION ALL SELECT a, 3 FROM h3""")
def bfs_depth(spark, d):
    seeds = gm.table(spark, d, "customer").where("c_custkey IN (1, 2, 5)").select(F.col("c_custkey").alias("actor_id"), F.lit("ladder").alias("family"))
    return dc.bfs_expand(edges(spark, d), seeds, 3).select("actor_id", "depth")


@query("SELECT o_custkey actor_id, o_orderkey match_id, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) place FROM orders) WHERE place <= 3")
def first_n_per_actor(spark, d):
    rows = gm.table(spark, d, "orders").select(F.col("o_custkey").alias("actor_id"), F.col("o_orderkey").alias("match_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms"))
    return dc.first_n_per_actor(rows, 3).select("actor_id", "match_id", "place")


@query("!SELECT actor actor_id, count(*) FILTER (queue_id = 2400) target_matches, max(created_ms) FILTER (queue_id = 2400) latest_ms FROM g GROUP BY 1")
def actor_history_summary(spark, d):
    return dc.actor_history_summary(gm.games(spark, d), [2400])


@query("SELECT o_custkey actor_id, max(priority) FILTER (i = 1) priority, min(depth) min_depth FROM (SELECT o_custkey, o_orderkey % 7 priority, o_orderkey % 4 depth, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7, o_orderkey % 4, o_orderpriority) i FROM orders) GROUP BY 1")
def fold_metadata(spark, d):
    k = F.col("o_orderkey")
    return dc.fold_metadata(gm.table(spark, d, "orders").select(F.col("o_custkey").alias("actor_id"), (k % 7).alias("priority"), (k % 4).alias("depth"), F.col("o_orderpriority").alias("source"))).select("actor_id", "priority", "min_depth")


# events, documents, pages


@query("""SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) start_ms, event_type, count(*) n, round(sum(CAST(value AS DECIMAL(20,6)))::DOUBLE, 6) total FROM events GROUP BY 1, 2""")
def tumbling_counts(spark, d):
    return jobs.tumbling(gm.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.unix_millis("start").alias("start_ms"), "event_type", "n", "total")


@query("""SELECT epoch_ms(time_bucket(INTERVAL 6 HOUR, ts)) - 21600000*j start_ms, event_type, count(*) n FROM events, range(4) t(j) GROUP BY 1, 2""")
def sliding_counts(spark, d):
    return jobs.tumbling(gm.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "6 hours").select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


@query("""SELECT user_id, epoch_us(min(ts)) // 1000 start_ms, count(*) n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END new FROM events)) GROUP BY user_id, s""")
def session_counts(spark, d):
    return jobs.sessions(gm.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.unix_millis("start").alias("start_ms"), "n")


@query("""SELECT event_type, first_event, streak FROM (SELECT event_type, r, min(event_id) FILTER (g = 0) first_event, count(*) FILTER (g = 0) streak FROM (SELECT *, sum(g) OVER (PARTITION BY event_type ORDER BY ts, event_id) r FROM (SELECT *, CASE WHEN value > 50 THEN 1 ELSE 0 END g FROM events)) GROUP BY 1, 2) WHERE streak >= 5""")
def zero_streaks(spark, d):
    return jobs.zero_streaks(gm.table(spark, d, "events").withColumn("gain", (F.col("value") > 50).cast("int")), 5)


def timed_events(spark: SparkSession, d: str) -> DataFrame:
    return gm.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH e AS (SELECT *, row_number() OVER w pl, lag(ts) OVER w b FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY pl) run FROM e),
s AS (SELECT *, min(pl) OVER (PARTITION BY event_type, run) f, min(CASE WHEN value > 50 THEN pl END) OVER (PARTITION BY event_type, run) g FROM r)
SELECT event_type, epoch_us(ts) at_us, epoch_us(ts) + 2700000000 until_us FROM s WHERE (pl - f + 1) % 3 = 0 AND (g IS NULL OR pl < g)""")
def family_backoffs(spark, d):
    """When event types back off: three results without gain, none in the run, whose parts are less than an hour apart."""
    found = ordered.backoffs(timed_events(spark, d), "event_type", ["ts", "event_id"], F.col("value") > 50, limit=3, idle_s=3600)
    return found.select("event_type", F.unix_micros("at").alias("at_us"), F.unix_micros("until").alias("until_us"))


@query("""SELECT user_id, event_id, rank source_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY rank, ts, event_id) i FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END rank, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) s
 FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END new FROM events))) WHERE i = 1""")
def best_of_sources(spark, d):
    """One event of each user and stretch of hours: the first purchase, or else the first event."""
    rows = timed_events(spark, d).select("user_id", "ts", "event_id", "event_type")
    bought = F.col("event_type") == "purchase"
    found = stateful.best_of_sources([rows.where(bought), rows.where(~bought)], "user_id", "ts", wait="6 hours", ties=("event_id",))
    return found.select("user_id", "event_id", "source_rank")


SNAP = "sn AS (SELECT date_trunc('day', ts) dt, count(*) c, count(*) FILTER (event_type = 'purchase') dn FROM events GROUP BY 1), s2 AS (SELECT epoch(dt)::BIGINT captured_at_unix, CAST(sum(c) OVER (ORDER BY dt) AS BIGINT) total, CAST(sum(dn) OVER (ORDER BY dt) AS BIGINT) done, CAST(day(dt)//10 AS VARCHAR) version FROM sn)"


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot for each day: events so far, purchases so far."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    rows = gm.table(spark, d, "events").groupBy(day.alias("dt")).agg(F.count("*").alias("c"), F.count_if(F.col("event_type") == "purchase").alias("dn"))
    w = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)  # one row for each day
    return rows.select(F.unix_timestamp("dt").alias("captured_at_unix"), F.sum("c").over(w).alias("total"), F.sum("dn").over(w).alias("done"), F.floor(F.dayofmonth("dt") / 10).cast("string").alias("version"))


@query(f"WITH {SNAP} SELECT captured_at_unix, total, total - lag(total) OVER w delta, CASE WHEN version = lag(version) OVER w THEN total - lag(total) OVER w END version_delta, round((total - lag(total) OVER w)/((captured_at_unix - lag(captured_at_unix) OVER w)/3600.0::DOUBLE), 6) per_hour, CASE WHEN done - lag(done) OVER w > 0 THEN round(100.0::DOUBLE*(total - lag(total) OVER w)/(done - lag(done) OVER w), 6) END yield_per_100 FROM s2 WINDOW w AS (ORDER BY captured_at_unix)")
def snapshot_deltas(spark, d):
    return dc.snapshot_deltas(snapshots(spark, d), "captured_at_unix").select("captured_at_unix", "total", "delta", "version_delta", F.col("per_hour"), F.col("yield_per_100").cast("double").alias("yield_per_100"))


@query(f"""WITH RECURSIVE {SNAP}, de AS (SELECT captured_at_unix t, total % 3 workers, total % 400 pending, done - lag(done) OVER w dd, total - lag(total) OVER w d FROM s2 WINDOW w AS (ORDER BY captured_at_unix)),
rs AS (SELECT *, CASE WHEN workers = 0 THEN 1 ELSE 0 END + CASE WHEN pending <= 120 THEN 1 ELSE 0 END + CASE WHEN dd >= 2 AND d <= 0 THEN 1 ELSE 0 END n FROM de),
se AS (SELECT min(t) t FROM rs WHERE n > 0 UNION ALL SELECT (SELECT min(t) FROM rs WHERE n > 0 AND rs.t >= se.t + 200000) FROM se WHERE t IS NOT NULL)
SELECT t captured_at_unix, n, t IN (SELECT t FROM se WHERE t IS NOT NULL) sent FROM rs""")
def alarm_cooldown(spark, d):
    """Reasons for alarm in each day's snapshot, and whether it is sent: not within two days or so of the last one sent."""
    rows = snapshots(spark, d).select("*", (F.col("total") % 3).alias("workers"), (F.col("total") % 400).alias("pending"))
    rows = dc.health_triggers(dc.snapshot_deltas(rows, "captured_at_unix"), 120, 2)
    rows = ordered.cooled_down(rows, [], F.col("captured_at_unix"), 200_000, F.size("reasons") > 0)
    return rows.select("captured_at_unix", F.size("reasons").alias("n"), "sent")


@query("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events) WHERE b IS NULL OR b <> event_type")
def state_changes(spark, d):
    return dc.state_changes(gm.table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type")).select("user_id", "event_id")


@query("SELECT date_trunc('day', ts) AS start, count(*) n, count(*) FILTER (event_type = 'purchase') done, max(ts) AS last FROM events GROUP BY 1")
def snapshot_stream(spark, d):
    return jobs.snapshot_stream(gm.table(spark, d, "events"))


@query("""SELECT count(*) FILTER (a BETWEEN 0 AND 86400) hot, count(*) FILTER (a BETWEEN 0 AND 259200) warm FROM (SELECT epoch(TIMESTAMP '2024-01-20')::BIGINT - floor(epoch(ts))::BIGINT a FROM events)""")
def recent_activity(spark, d):
    return jobs.recent_activity(gm.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.to_timestamp(F.lit("2024-01-20 00:00:00")))


PII = "WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id, source, '{c}' category, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for c, p in pv.PATTERNS.items()) + ")"


@query(PII + " SELECT doc_id, source, category, value, regexp_matches(value, '(?i)xxxx|name#tag|example@|noreply') placeholder FROM f")
def pii_scan(spark, d):
    return pv.pii_scan(gm.table(spark, d, "documents"))


@query(PII + ", v AS (SELECT source, category, count(*) finds, count(*) FILTER (NOT regexp_matches(value, '(?i)xxxx|name#tag|example@|noreply')) AS \"real\", substring(min(value), 1, 2) || '***' sample FROM f GROUP BY 1, 2) SELECT source, category, finds, \"real\", CASE WHEN \"real\" > 0 AND category IN ('api_key','token','email') THEN 'LEAKED' WHEN \"real\" > 0 THEN 'SUSPICIOUS' ELSE 'CLEAN' END verdict, sample FROM v")
def pii_verdict(spark, d):
    return pv.pii_verdict(pv.pii_scan(gm.table(spark, d, "documents")))


@query("SELECT slug, min(page_id) page_id FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) slug FROM pages) GROUP BY 1")
def slug_links(spark, d):
    return pv.extract_profile_slugs(gm.table(spark, d, "pages"), 'href="(/[^"]*)"').select("slug", "page_id")


@query("SELECT doc_id, 'token' AS marker, CAST(len(regexp_extract_all(text, 'token')) AS BIGINT) n FROM documents WHERE length(text) >= 200 AND len(regexp_extract_all(text, 'token')) > 0")
def raw_markers(spark, d):
    return pv.raw_markers(gm.table(spark, d, "documents"), ["token"], 200)


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br */?>', ' ', 'gi'), '@([^@]*)@', '\1', 'g'), '%i:[^%]*%', '', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def clean_markup(spark, d):
    return gm.table(spark, d, "pages").select("page_id", tx.clean_markup(F.col("html")).alias("text"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') slug FROM part")
def slugify(spark, d):
    return gm.table(spark, d, "part").select("p_partkey", tx.slugify(F.col("p_name")).alias("slug"))
