"""Structured Streaming forms of capture, merging, back-off and counts. Each has an event time and a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skirmish.operators import ordered
from skirmish.streaming.stateful import best_of_sources

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def capture_stream(stream: DataFrame, key: str = "event_id", watermark: str = "1 hour") -> DataFrame:
    """Each id once within the watermark, rejected ids too."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def tumbling(rows: DataFrame, size: str = "1 day", slide: str | None = None, watermark: str = "1 day") -> DataFrame:
    """Counts and sums by event type in tumbling (or sliding) windows; batch and stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    sums = rows.withWatermark("ts", watermark).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(20,6)")), 6).cast("double").alias("total"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    """Sessions of a user: events less than the gap apart."""
    found = rows.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


def family_yield(rows: DataFrame) -> DataFrame:
    """Running sums for each family (event type), for update mode."""
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("long")).alias("yield"))


def snapshot_stream(rows: DataFrame, size: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """A snapshot of each window: events, purchases and the last time; batch and stream."""
    sums = rows.withWatermark("ts", watermark).groupBy(F.window("ts", size).alias("w"))
    out = sums.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.max("ts").alias("last"))
    return out.select(F.col("w.start").alias("start"), "n", "done", "last")


def recent_activity(rows: DataFrame, now: Column) -> DataFrame:
    """Events within 24 and 72 hours of now."""
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    return rows.agg(F.count_if(age.between(0, 24 * 3600)).alias("hot"), F.count_if(age.between(0, 72 * 3600)).alias("warm"))


def attach_version(stream: DataFrame, history: DataFrame) -> DataFrame:
    """Version of the same match in the history (static), else the latest version there."""
    exact = history.select("game_id", F.col("patch").alias("_exact"))
    latest = history.where(F.coalesce("patch", F.lit("")) != "").agg(F.max_by("patch", F.struct("created_ms", "game_id")).alias("_latest"))
    return stream.join(exact, "game_id", "left").join(F.broadcast(latest), how="cross").withColumn("version", F.coalesce(F.nullif("_exact", F.lit("")), "_latest")).drop("_exact", "_latest")


def merge_primary_fallback(primary: DataFrame, fallback: DataFrame, key: str, watermark: str = "1 hour") -> DataFrame:
    """One record of each id: the primary one if there is one, whichever arrives first, else the earliest of the fallback."""
    return best_of_sources([primary, fallback], key, "ts", watermark, watermark)


def upsert_batch(target: str, key: str = "game_id") -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: writes, as version ``batch_id`` of the table, first records with payloads filled in by later ones.

    A batch that runs again writes the same version again. Each batch writes the whole table: for one that is large beside
    its batches, see ``upserts.merge_into``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_at", F.lit(batch_id))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v{batch_id - 1}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = spark.read.parquet(f"{target}/v{batch_id - 1}").unionByName(rows)
        payload = F.nullif("participants_json", F.lit(""))
        rest = [c for c in batch.columns if c not in (key, "participants_json")]
        merged = rows.groupBy(key).agg(F.min(F.struct("_at", *rest)).alias("r"), F.min_by(payload, F.when(payload.isNotNull(), F.struct("_at", payload.alias("p")))).alias("participants_json"))
        merged.select(key, *[f"r.{c}" for c in rest], "participants_json", "r._at").write.mode("overwrite").parquet(f"{target}/v{batch_id}")

    return write


BACKOFF = "family string, at timestamp, until timestamp"
STATE = "streak int, yield long, until double"


def next_backoff(streak: int, total: int, until: float, at: float, value: float, limit: int, hold: float) -> tuple[int, int, float, bool]:
    """State after one result, and whether a back-off begins: ``limit`` results without yield in a row, none before."""
    if value > 0:
        return 0, total + 1, 0.0, False
    streak += 1
    if streak >= limit and total == 0 and at >= until:
        return 0, total, at + hold, True
    return streak, total, until, False


def family_backoff(stream: DataFrame, limit: int = 25, hold_s: float = 45 * 60.0, watermark: str = "1 hour") -> DataFrame:
    """(family, at, until) whenever a family (event type) begins a back-off, at once: results in order of time within a batch.

    Late results count where they arrive, and state stays; ``stateful.family_backoff`` waits for the watermark and forgets.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, total, until = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for ts, value in zip(rows["ts"], rows["gain"], strict=True):
            streak, total, until, begins = next_backoff(streak, total, until, ts.timestamp(), value, limit, hold_s)
            if begins:
                out.append((key[0], ts, pd.Timestamp(until, unit="s")))
        state.update((streak, total, until))
        yield pd.DataFrame(out, columns=["family", "at", "until"]).astype({"at": "datetime64[ns]", "until": "datetime64[ns]"})

    rows = stream.withWatermark("ts", watermark).groupBy("event_type")
    return rows.applyInPandasWithState(run, BACKOFF, STATE, "append", GroupStateTimeout.NoTimeout)


def zero_streaks(rows: DataFrame, least: int) -> DataFrame:
    """Batch form: runs of results without yield in each family, between its yields."""
    return ordered.streaks(rows, "event_type", ["ts", "event_id"], F.col("gain"), least, "event_id")
