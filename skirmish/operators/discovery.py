"""Graph expansion over co-participation, frontier and family analytics, snapshots."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the folder that the session shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def participants_of(details: DataFrame) -> DataFrame:
    """(actor_id, match_id), once each, without missing actors."""
    return details.select(F.explode("actors").alias("actor_id"), "match_id").where("actor_id is not null").distinct()


def bfs_expand(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(actor_id, depth, family): actors reached from the seeds over shared matches, a child with its parent's family.

    Each hop joins the frontier with the edges twice, leaves out what is visited, and cuts lineage; of
    several parents the smallest family is taken. The edges are made once and written; a match that a hop has met is left out of later ones,
    as all its actors are visited then.
    """
    edges = checkpointed(edges.select("actor_id", "match_id"))
    visited = checkpointed(seeds.groupBy("actor_id").agg(F.min("family").alias("family")).select("actor_id", F.lit(0).alias("depth"), "family"))
    frontier, met = visited, None
    for depth in range(1, max_depth + 1):
        matches = edges.join(frontier.select("actor_id", "family"), "actor_id").groupBy("match_id").agg(F.min("family").alias("family"))
        if met is not None:
            matches = matches.join(met, "match_id", "left_anti")
        matches = checkpointed(matches)
        met = matches.select("match_id") if met is None else met.unionByName(matches.select("match_id"))
        found = edges.join(matches, "match_id").groupBy("actor_id").agg(F.min("family").alias("family"))
        frontier = checkpointed(found.join(visited, "actor_id", "left_anti").select("actor_id", F.lit(depth).alias("depth"), "family"))
        if frontier.isEmpty():
            break
        visited = checkpointed(visited.unionByName(frontier))
    return visited


def fold_metadata(discoveries: DataFrame) -> DataFrame:
    """For each actor the source of best priority, then depth; and the least depth seen."""
    return discoveries.groupBy("actor_id").agg(F.min(F.struct("priority", "depth", "source")).alias("b"), F.min("depth").alias("min_depth")).select("actor_id", "b.source", "b.priority", "min_depth")


def attribute_family(discoveries: DataFrame, unknown: tuple[str, ...] = ("", "unknown", "legacy_match")) -> DataFrame:
    """The first known root family of each actor by discovery order; unknown ones only where no other is."""
    known = ~F.coalesce("family", F.lit("")).isin(*unknown)
    return discoveries.groupBy("actor_id").agg(F.coalesce(F.min_by("family", F.when(known, F.col("position"))), F.lit("unknown")).alias("family"))


def reseed(actors: DataFrame, now_ms: int, cap: int, families: list[str] | None = None, cooldown_ms: int = 3_600_000, recent_ms: int = 72 * 3_600_000) -> DataFrame:
    """Actors to visit again: productive, seen lately (or of given families), not visited in the cooldown; best first."""
    rows = actors.where(F.coalesce("last_crawled_ms", F.lit(0)) <= now_ms - cooldown_ms)
    rows = rows.where(F.col("family").isin(families)) if families else rows.where((F.col("new_games") > 0) & (F.col("latest_match_ms") >= now_ms - recent_ms))
    return rows.orderBy(F.desc("new_games"), F.desc("latest_match_ms"), "priority", F.asc_nulls_first("last_crawled_ms"), "actor_id").limit(cap)


def reseed_family(actors: DataFrame, sources: list[str], now_ms: int, cap: int = 120, cooldown_ms: int = 3_600_000) -> DataFrame:
    """Productive actors of given sources not visited in the cooldown: best priority, then the latest match, fewest visits, last seen first; no source, no actor."""
    rows = actors.where(F.col("source").isin([s for s in sources if s]) & (F.col("new_games") > 0) & (F.coalesce("last_crawled_ms", F.lit(0)) <= now_ms - cooldown_ms))
    return rows.orderBy("priority", F.desc("latest_match_ms"), "process_count", F.desc("first_seen_ms"), "actor_id").limit(cap)


def best_candidates(frontier: DataFrame, now_ms: int, k: int) -> DataFrame:
    """The k pending, eligible entries to visit next."""
    rows = frontier.where((F.col("status") == "pending") & (F.coalesce("eligible_ms", F.lit(0)) <= now_ms))
    return rows.orderBy(F.desc("latest_match_ms"), "priority", "depth", "updated_ms", "queue_idx").limit(k)


def classify_upsert(actors: DataFrame, incoming: DataFrame) -> DataFrame:
    """What an incoming discovery does to a known actor: new, requeued (was processed, better priority), updated or noop."""
    old = actors.select("actor_id", F.col("priority").alias("_p"), F.col("depth").alias("_d"), "processed")
    rows = incoming.join(old, "actor_id", "left")
    better = (F.col("priority") < F.col("_p")) | (F.col("depth") < F.col("_d"))
    what = F.when(F.col("_p").isNull(), "new").when(F.col("processed") & (F.col("priority") < F.col("_p")), "requeued").when(better, "updated").otherwise("noop")
    return rows.select(*incoming.columns, what.alias("outcome"))


def actor_history_summary(history: DataFrame, modes: list[int]) -> DataFrame:
    """Matches of the target modes and the latest of them, for each actor."""
    target = F.col("queue_id").isin(modes)
    return history.groupBy("actor_id").agg(F.count_if(target).alias("target_matches"), F.max(F.when(target, F.col("created_ms"))).alias("latest_ms"))


def first_n_per_actor(history: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("actor_id").orderBy(F.desc("created_ms"), "match_id")
    return history.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def latest_per_key(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The newest value of each key, the greatest of equals in time."""
    return df.groupBy(key).agg(F.max(F.struct(ts, value)).alias("x")).select(key, F.col(f"x.{ts}").alias(ts), F.col(f"x.{value}").alias(value))


def most_recent(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def collect_actors(pages: DataFrame, full: int = 200) -> DataFrame:
    """Distinct actors over the pages of each tier in order of first sight, up to and with the first page that isn't full."""
    sizes = pages.groupBy("tier", "page").agg(F.count("*").alias("n"))
    last = sizes.where(F.col("n") < full).groupBy("tier").agg(F.min("page").alias("last"))
    rows = pages.join(last, "tier", "left").where(F.col("page") <= F.coalesce("last", F.lit(2**31 - 1)))
    return rows.groupBy("actor_id").agg(F.min(F.struct("tier", "page", "position")).alias("seen")).select("actor_id", "seen.*")


def family_footprint(actors: DataFrame) -> DataFrame:
    return actors.groupBy("family").agg(
        F.count("*").alias("actors"), F.count_if("processed").alias("processed"), F.count_if(F.col("new_games") > 0).alias("productive"), F.coalesce(F.sum("new_games"), F.lit(0)).alias("yield")
    )


def family_roi(actors: DataFrame, games: DataFrame) -> DataFrame:
    """Footprint of each family beside the matches it brought; a family of one side only has zeros on the other."""
    rows = family_footprint(actors).join(games.groupBy("family").agg(F.count("*").alias("matches")), "family", "full_outer")
    return rows.select("family", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("actors", "processed", "productive", "yield", "matches")])


def family_mode_rollup(games: DataFrame) -> DataFrame:
    """Matches and base rate by family and mode, by family, and in all."""
    return games.rollup("family", "queue_id").agg(F.count("*").alias("matches"), F.round(F.avg(F.col("blue_wins").cast("double")), 3).alias("base_rate"), F.grouping_id().alias("level"))


def snapshot_deltas(snapshots: DataFrame, order: str, key: str = "all") -> DataFrame:
    """Each snapshot against the one before: new rows, hours, rate an hour, yield per 100 done; version change blanks its count."""
    rows = snapshots if key in snapshots.columns else snapshots.withColumn(key, F.lit(0))
    w = Window.partitionBy(key).orderBy(order)
    hours = (F.col(order) - F.lag(order).over(w)) / 3600.0
    done = F.col("done") - F.lag("done").over(w)
    new = F.col("total") - F.lag("total").over(w)
    rows = rows.select("*", new.alias("delta"), hours.alias("hours"), done.alias("done_delta"), F.when(F.col("version") == F.lag("version").over(w), new).alias("version_delta"))
    return rows.withColumn("per_hour", F.when(F.col("hours") > 0, F.col("delta") / F.col("hours"))).withColumn("yield_per_100", F.when(F.col("done_delta") > 0, 100.0 * F.col("delta") / F.col("done_delta")))


def health_triggers(deltas: DataFrame, frontier_least: int, window: int) -> DataFrame:
    """Reasons for alarm in a snapshot: no workers, short frontier, work done without growth."""
    said = [("no workers", F.col("workers") == 0), ("short frontier", F.col("pending") <= frontier_least), ("no growth", (F.col("done_delta") >= window) & (F.col("delta") <= 0))]
    return deltas.withColumn("reasons", F.array_compact(F.array(*[F.when(c, t) for t, c in said])))


def activity_bucket(age_ms: Column) -> Column:
    """hot within a day, warm within three, else cold."""
    return F.when(age_ms <= 24 * 3_600_000, "hot").when(age_ms <= 72 * 3_600_000, "warm").otherwise("cold")


def state_changes(df: DataFrame, key: str, order: list[str], state: Column) -> DataFrame:
    """Rows whose state differs from the one before of their key."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("state", F.xxhash64(state))
    return rows.withColumn("_before", F.lag("state").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("state"))).drop("_before")


def scalar_counts(games: DataFrame, frontier: DataFrame) -> DataFrame:
    """All matches, those of mode 2400, and pending entries in one row."""
    a = games.agg(F.count("*").alias("games"), F.count_if(F.col("queue_id") == 2400).alias("mode_2400"))
    return a.crossJoin(F.broadcast(frontier.agg(F.count_if(F.col("status") == "pending").alias("pending"))))


def leaderboard(runs: DataFrame) -> DataFrame:
    """The latest run of each variant, best validation accuracy first."""
    last = runs.groupBy("variant").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "variant"]), F.col("at")).alias("r"))
    return last.select("variant", "r.*").orderBy(F.desc("val_accuracy"), "variant")


def backfill_from(df: DataFrame, other: DataFrame, key: str, other_key: str, column: str, other_column: str) -> DataFrame:
    """df with zeros of a column filled from the row of other that its key names; zero stays where there is none.

    Of several rows with the key the greatest value counts.
    """
    found = other.groupBy(F.col(other_key).alias(key)).agg(F.max(other_column).alias("_found"))
    rows = df.join(found, key, "left")
    return rows.withColumn(column, F.when((F.col(column) == 0) & F.col(key).isNotNull(), F.coalesce("_found", column, F.lit(0))).otherwise(F.col(column))).select(*df.columns)


def frontier_counts(frontier: DataFrame, actors: DataFrame) -> DataFrame:
    """(kind, name, n, priority): entries of each status and actors of each source, with the least priority, by which sources are listed."""
    count = lambda df, c: df.groupBy(F.lit(c).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"), F.min("priority").alias("priority"))
    return count(frontier, "status").unionByName(count(actors, "source")).orderBy("kind", "priority", F.desc("n"), "name")


def worker_counts(workers: DataFrame, now_ms: int | Column, alive_ms: int = 120_000) -> DataFrame:
    """One row: workers alive (their last sign of life is at most ``alive_ms`` old), dead, and the ids of the living. ``workers`` has (worker_id, seen_ms), a row a sign."""
    last = workers.where("worker_id IS NOT NULL").groupBy("worker_id").agg(F.max("seen_ms").alias("seen_ms"))
    alive = F.coalesce(F.col("seen_ms") >= now_ms - alive_ms, F.lit(False))
    return last.agg(F.count_if(alive).alias("alive"), F.count_if(~alive).alias("dead"), F.array_sort(F.collect_list(F.when(alive, F.col("worker_id")))).alias("workers"))


def status_snapshot(games: DataFrame, frontier: DataFrame, mode: int, workers: DataFrame | None = None, now_ms: int | Column = 0) -> DataFrame:
    """One row: matches in all and of a mode, the mode's latest version with its count and time, its base rate, the frontier by status, and workers alive and dead if given."""
    of = F.col("queue_id") == mode
    counts = games.agg(F.count("*").alias("total"), F.count_if(of).alias("mode_total"), F.avg(F.when(of, F.col("blue_wins").cast("double"))).alias("base_rate"))
    patches = games.where(of).groupBy("patch").agg(F.count("*").alias("latest_patch_games"), F.max("created_ms").alias("latest_ms"))
    latest = patches.agg(F.max(F.struct("latest_ms", "patch", "latest_patch_games")).alias("x")).select(F.col("x.patch").alias("latest_patch"), "x.latest_patch_games", "x.latest_ms")
    states = frontier.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "done", "failed")], F.count("*").alias("known"))
    row = counts.crossJoin(F.broadcast(latest)).crossJoin(F.broadcast(states))  # one row each
    return row if workers is None else row.crossJoin(F.broadcast(worker_counts(workers, now_ms)))
