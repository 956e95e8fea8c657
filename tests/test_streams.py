"""Streams with state against their batch forms, rows arriving out of order, and what is left of the state."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skirmish.operators import discovery as dc
from skirmish.operators import ordered
from skirmish.streaming import jobs, stateful, upserts

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "event_id long, ts timestamp, family string, gain double, kind string"
LAST = START + timedelta(days=900)


def events(seed, n=600, step=(0, 1, 20)):
    rng, rows, now = random.Random(seed), [], 0
    for i in range(n):
        now += rng.choice(step) if rng.random() < 0.99 else 9 * 3600
        rows.append((i, START + timedelta(seconds=now), "hot" if rng.random() < 0.7 else rng.choice("ab"), 2.0 if rng.random() < 0.02 else 0.0, rng.choice("xyz")))
    return rows


@pytest.fixture
def stores(spark):
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    stateful.with_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files_of(spark, rows, place, schema=EVENTS, batches=4, shuffle=40, seed=1):
    """rows in files of about equal size, each moved by up to ``shuffle`` places from its order; a row of far later ends the stream."""
    rng = random.Random(seed)
    rows = [r for _, r in sorted((i + rng.uniform(0, shuffle), r) for i, r in enumerate(rows))]
    cut = [rows[len(rows) * i // batches : len(rows) * (i + 1) // batches] for i in range(batches)]
    for i, part in enumerate([*cut, [(-1, LAST, "end", 0.0, "x")], [(-2, LAST + timedelta(days=1), "end", 0.0, "x")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{place}/{i}")


def stream_of(spark, place, schema=EVENTS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(place)


def run(df, name, place, mode="append"):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{place}/state-{name}").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_backoff_of_a_hot_family_equals_its_batch_form(spark, tmp_path, stores):
    rows = events(4)
    files_of(spark, rows, f"{tmp_path}/in")
    found = stateful.family_backoff(stream_of(spark, f"{tmp_path}/in"), "family", "ts", ["event_id"], "gain", limit=5, hold_s=60, idle_s=3600, watermark="30 minutes")
    query = run(found, "backoffs", tmp_path)
    want = ordered.backoffs(spark.createDataFrame(rows, EVENTS), "family", ["ts", "event_id"], F.col("gain"), 5, 60, 3600)
    got = spark.table("backoffs").where("family <> 'end'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10
    state = query.lastProgress.stateOperators[0]
    held = spark.read.format("state-metadata").load(f"{tmp_path}/state-backoffs").count()
    assert held >= 1 and state.numRowsTotal <= 4  # only the last row, and it still waits


def test_changes_and_deltas_equal_their_batch_forms(spark, tmp_path, stores):
    rows = events(7, step=(60, 900, 7200))
    files_of(spark, rows, f"{tmp_path}/in", shuffle=3)
    source = lambda: stream_of(spark, f"{tmp_path}/in")
    df = spark.createDataFrame(rows, EVENTS)
    run(stateful.state_changes(source(), "family", "ts", ["event_id"], F.col("kind"), watermark="10 hours"), "changes", tmp_path)
    got = sorted(r.event_id for r in spark.table("changes").where("event_id >= 0").collect())
    assert got == sorted(r.event_id for r in dc.state_changes(df, "family", ["ts", "event_id"], F.col("kind")).collect())
    run(stateful.snapshot_deltas(source(), "ts", F.col("kind") == "x", F.dayofmonth("ts") > 15, watermark="10 hours"), "deltas", tmp_path)
    days = df.groupBy(F.date_trunc("day", "ts").alias("start")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "x").alias("d"), F.max((F.dayofmonth("ts") > 15).cast("string")).alias("version"))
    snaps = ordered.swept(days, [], ["start"], {"total": F.col("n"), "done": F.col("d")}).withColumn("at", F.unix_timestamp("start"))
    want = dc.snapshot_deltas(snaps, "at").select("start", "total", "delta", "version_delta", "per_hour", F.col("yield_per_100").cast("double"))
    plain = lambda rows: sorted([x if not isinstance(x, float) else round(x, 9) for x in r] for r in rows)
    assert plain(spark.table("deltas").where(f"start < timestamp '{LAST:%Y-%m-%d}'").collect()) == plain(want.collect()) and want.count() > 5


def test_alarms_of_a_stream(spark, tmp_path, stores):
    rows = events(11)
    files_of(spark, rows, f"{tmp_path}/in", shuffle=10)
    run(stateful.sent_alarms(stream_of(spark, f"{tmp_path}/in"), "family", "ts", F.col("kind") == "x", 120, watermark="30 minutes"), "alarms", tmp_path)
    want = ordered.cooled_down(spark.createDataFrame(rows, EVENTS), ["family"], F.unix_micros("ts") / 1e6, 120, F.col("kind") == "x").where("sent").select("family", "ts").distinct()
    assert sorted(map(tuple, spark.table("alarms").where("family <> 'end'").collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


RECORD = "game_id string, ts timestamp, body string"


@pytest.mark.parametrize("order", ["primary first", "fallback first", "together"])
def test_the_end_block_wins_in_either_order(spark, tmp_path, order):
    at = lambda m: START + timedelta(minutes=m)
    primary = [("a", at(1), "end a"), ("b", at(40), "end b")]
    fallback = [("a", at(2), "detail a"), ("b", at(3), "detail b"), ("c", at(5), "detail c"), ("c", at(6), "detail c again")]
    late = [("z", LAST, "z")], [("y", LAST + timedelta(days=1), "y")]
    batches = {"primary first": [(primary, []), ([], fallback)], "fallback first": [([], fallback), (primary, [])], "together": [(primary, fallback)]}[order]
    for i, (p, f) in enumerate([*batches, *((x, []) for x in late)]):
        spark.createDataFrame(p, RECORD).coalesce(1).write.parquet(f"{tmp_path}/p/{i}")
        spark.createDataFrame(f, RECORD).coalesce(1).write.parquet(f"{tmp_path}/f/{i}")
    both = [stream_of(spark, f"{tmp_path}/{x}", RECORD) for x in "pf"]
    run(stateful.best_of_sources(both, "game_id", "ts"), f"best{order[:3]}", tmp_path)
    want = {("a", "end a", 0), ("b", "end b", 0), ("c", "detail c", 1)}
    assert {(r.game_id, r.body, r.source_rank) for r in spark.table(f"best{order[:3]}").where("game_id < 'x'").collect()} == want
    batch = stateful.best_of_sources([spark.createDataFrame(primary, RECORD), spark.createDataFrame(fallback, RECORD)], "game_id", "ts")
    assert {(r.game_id, r.body, r.source_rank) for r in batch.collect()} == want


GAME = "game_id string, ts timestamp, patch string, participants_json string"


def test_merge_rewrites_touched_buckets_only_and_repeats_safely(spark, tmp_path):
    target = f"{tmp_path}/t"
    write = upserts.merge_into(target, "game_id", "ts", "participants_json", late_after_s=3600, buckets=16)
    at = lambda m: START + timedelta(minutes=m)
    table = lambda before=None: {(r.game_id, r.patch, r.participants_json) for r in upserts.read_table(spark, target, before).collect()}
    batch = lambda rows: spark.createDataFrame(rows, GAME)
    first = [(f"g{i}", at(i), "1", "" if i % 2 else f"[{i}]") for i in range(100)]
    write(batch(first), 0)
    assert table() == {(g, p, j or None) for g, _, p, j in first}
    second = [("g1", at(101), "2", "[new]"), ("g2", at(102), "2", "[other]"), ("late", at(1), "2", "[x]"), ("fresh", at(99), "2", None), ("fresh", at(98), "1", "[f]")]
    want = {(g, p, j or None) for g, _, p, j in first if g != "g1"} | {("g1", "1", "[new]"), ("fresh", "1", "[f]")}
    for _ in range(2):
        write(batch(second), 3)  # batches needn't be numbered without gaps
        assert table() == want and table(before=3) == {(g, p, j or None) for g, _, p, j in first}
    assert upserts.late_counts(spark, target) == {0: 0, 3: 1}
    assert [r.game_id for r in spark.read.parquet(f"{target}/late/v3").collect()] == ["late"]
    size = lambda v: len(list((tmp_path / "t" / "data" / f"v{v}").glob("_bucket=*")))
    assert size(0) == 16 and size(3) <= 3
    write(batch([]), 4)
    assert table() == want
    write(batch([("g1", at(200), "9", "[later]")]), 5)
    assert table() == want and upserts.vacuum(spark, target, keep=1) == [] and table() == want


def test_merge_as_a_sink(spark, tmp_path):
    rows = [(f"g{i % 50}", START + timedelta(minutes=i), str(i), "[1]" if i % 3 else None) for i in range(200)]
    for i in range(4):
        spark.createDataFrame(rows[i * 50 : i * 50 + 50], GAME).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    sink = upserts.merge_into(f"{tmp_path}/t", "game_id", "ts", "participants_json", buckets=4)
    stream_of(spark, f"{tmp_path}/in", GAME).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {(r.game_id, r.patch, r.participants_json) for r in upserts.read_table(spark, f"{tmp_path}/t").collect()}
    assert got == {(f"g{i}", str(i), "[1]") for i in range(50)}
