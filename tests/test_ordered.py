"""Running sums, quantiles, runs, back-offs and cooldowns against plain loops, at several numbers of partitions."""

import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from skirmish.operators import ordered

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "event_id long, ts timestamp, family string, gain double"


@pytest.fixture(params=[3, 64])
def parts(spark, request):
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a group does lie in many ranges
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", was[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])


def results(seed, n=1500, rare=0.02):
    """Results of families, one of which has most of them, with gaps now and then and ties in time."""
    rng, rows, now = random.Random(seed), [], 0
    for i in range(n):
        now += rng.choice([0, 1, 5, 60]) if rng.random() < 0.99 else 9 * 3600
        family = "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None])
        rows.append((i, START + timedelta(seconds=now), family, rng.choice([None, 3.0]) if rng.random() < rare else 0.0))
    return rows


def backoff_loop(rows, limit, hold, idle):
    out, state = [], {}
    for i, ts, family, gain in sorted(rows, key=lambda r: (r[1], r[0])):
        last, streak, gained = state.get(family, (None, 0, False))
        if last is None or (ts - last).total_seconds() > idle:
            streak, gained = 0, False
        if (gain or 0) > 0:
            streak, gained = 0, True
        else:
            streak += 1
            if streak == limit:
                if not gained:
                    out.append((family, ts, ts + timedelta(seconds=hold)))
                streak = 0
        state[family] = (ts, streak, gained)
    return out


def utc(t):
    return t.astimezone(timezone.utc) if t.tzinfo else t.replace(tzinfo=timezone.utc)


def test_sums_and_rows_before(spark, parts):
    rows = results(1)
    df = spark.createDataFrame(rows, EVENTS).repartition(7)
    got = {r.event_id: (r.s, r.n, r.b) for r in ordered.swept(df, ["family"], ["ts", "event_id"], {"s": F.col("gain").cast("long"), "n": F.lit(1)}, {"b": "event_id"}).collect()}
    want, last = {}, {}
    for i, ts, family, gain in sorted(rows, key=lambda r: (r[1], r[0])):
        s, n, b = last.get(family, (0, 0, None))
        last[family] = (s + int(gain or 0), n + 1, i)
        want[i] = (s + int(gain or 0), n + 1, b)
    assert got == want
    same = spark.range(500).select(F.lit(1).alias("k"))
    assert sorted(r.place for r in ordered.placed(same, ["k"], ["k"]).collect()) == list(range(500))
    assert ordered.swept(df.limit(0), ["family"], ["ts"], {"s": F.lit(1)}, {"b": "gain"}).count() == 0


def test_quantiles_equal_duckdb(spark, parts, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.gauss(0, 1), 1.5]), float(i % 7)) for i in range(997)]
    spark.createDataFrame(rows, "x double, y double").write.parquet(f"{tmp_path}/t")
    got = ordered.quantiles(spark.read.parquet(f"{tmp_path}/t"), {"m": ("x", 0.5), "z": ("y", 0.37), "lo": ("x", 0.0), "hi": ("x", 1.0), "p": ("x", 0.913)}).first()
    want = duckdb.sql(f"SELECT quantile_cont(x, .5), quantile_cont(y, .37), min(x), max(x), quantile_cont(x, .913) FROM '{tmp_path}/t/*.parquet'").fetchall()[0]
    assert tuple(got) == pytest.approx(want, abs=1e-12)
    assert tuple(ordered.quantiles(spark.createDataFrame([], "x double"), {"m": ("x", 0.5)}).first()) == (None,)


def test_streaks(spark, parts):
    rows = results(2, rare=0.2)
    got = {(r.family, r.streak, r.first_event) for r in ordered.streaks(spark.createDataFrame(rows, EVENTS), "family", ["ts", "event_id"], F.col("gain"), 4, "event_id").collect()}
    want, runs = set(), {}
    for i, ts, family, gain in [*sorted(rows, key=lambda r: (r[1], r[0])), *[(0, None, f, 1.0) for f in ("hot", "a", "b", None)]]:
        if (gain or 0) > 0:
            run = runs.pop(family, [])
            if len(run) >= 4:
                want.add((family, len(run), min(run)))
        else:
            runs.setdefault(family, []).append(i)
    assert got == want and len(want) > 5


def test_backoffs(spark, parts):
    rows = results(5)
    got = ordered.backoffs(spark.createDataFrame(rows, EVENTS), "family", ["ts", "event_id"], F.col("gain"), limit=6, hold_s=90, idle_s=3600).collect()
    want = backoff_loop(rows, 6, 90, 3600)
    # null families are a group of their own
    key = lambda r: (r[0] or "", r[1])
    assert sorted(((r.family, utc(r["at"]), utc(r.until)) for r in got), key=key) == sorted(want, key=key) and len(want) > 10


def test_cooldown_counts_from_the_last_one_sent(spark, parts):
    rng, rows, now = random.Random(9), [], 0
    for i in range(600):
        now += rng.choice([0, 2, 7]) if rng.random() < 0.97 else 100
        rows.append((i, rng.choice(["x", "x", "x", "y", None]), float(now) if rng.random() < 0.98 else None, rng.random() < 0.5))
    got = {r.i for r in ordered.cooled_down(spark.createDataFrame(rows, "i int, k string, t double, on boolean"), ["k"], F.col("t"), 30, F.col("on")).where("sent").collect()}
    want, last = set(), {}
    for i, k, t, on in rows:
        if on and t is not None and (k not in last or t - last[k] >= 30 or t == last[k]):
            want.add(i)
            last[k] = t
    assert got == want and len(want) > 20
