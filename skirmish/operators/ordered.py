"""Running sums, previous rows, places and quantiles in an order, without a group or the whole table in one task.

Rows are sorted once by ranges of (group, order); the sorted rows are written, as a checkpoint in the shared folder. What a range
contributes to each of its groups is one row, and these rows, summed in order, are what the ranges before have. So a group
that holds most rows is many ranges, and a window runs over one group's rows of one range only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.operators.discovery import checkpointed


def ranged(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df sorted by ranges, with its range (_part), its place there (_at) and its group as a struct (_group); equal rows may be in two ranges."""
    sort = [*group, *order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie")
    rows = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_group", F.struct(*group) if group else F.lit(0))


def sweep(rows: DataFrame, sums: dict[str, Column] | None = None, previous: dict[str, str] | None = None) -> DataFrame:
    """``ranged`` rows with running sums of expressions (this row included) and values of the row before, in the order of their group."""
    sums, previous = sums or {}, previous or {}
    added = {f"_s_{name}": F.coalesce(x, F.lit(0)) for name, x in sums.items()}
    rows = rows.withColumns(added) if added else rows
    own = Window.partitionBy("_group", "_part").orderBy("_at")
    last = [F.max_by(F.struct(*sorted(set(previous.values()))), "_at").alias("_last")] if previous else []
    cells = rows.groupBy("_group", "_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in added], *last)
    ahead = Window.partitionBy("_group").orderBy("_part")
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        F.col("_group").alias("_g"), F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in added],
        *[F.lag("_last").over(ahead).alias("_last")] * bool(previous),
    )
    found = {name: F.sum(f"_s_{name}").over(own) for name in sums} | {f"_l_{name}": F.lag(F.struct(c)).over(own) for name, c in previous.items()}
    kept = rows.drop(*added).columns
    rows = rows.withColumns(found).join(cells, (F.col("_group") == F.col("_g")) & (F.col("_part") == F.col("_p")))
    done = {name: F.col(name) + F.col(f"_b_s_{name}") for name in sums}
    done |= {name: F.when(F.col(f"_l_{name}").isNotNull(), F.col(f"_l_{name}")[c]).otherwise(F.col("_last")[c]) for name, c in previous.items()}
    return rows.select(*kept, *[x.alias(name) for name, x in done.items()])


def swept(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None, previous: dict[str, str] | None = None) -> DataFrame:
    """df with running sums and values of the row before in the order of its group.

    A null adds nothing. The first row of a group has null for what is before. Null groups are a group; rows equal in group and order
    keep an order of their own.
    """
    return sweep(ranged(df, group, order), sums, previous).drop("_part", "_at", "_group")


def placed(df: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """df with its place in its group, from 0."""
    return swept(df, group, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def quantiles(df: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of exact quantiles, each name from (column, q): between the two nearest places, linearly; nulls don't count.

    Each column is sorted once by ranges; two rows a quantile are what is left of it.
    """
    out = None
    for column in sorted({c for c, _ in columns.values()}):
        rows = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
        rows = placed(rows, [], ["x"])
        n = rows.count()
        asked = {name: q * (n - 1) for name, (c, q) in columns.items() if c == column}
        at = lambda p: F.max(F.when(F.col("place") == p, F.col("x")))
        between = lambda p: at(math.floor(p)) + (at(math.ceil(p)) - at(math.floor(p))) * F.lit(p - math.floor(p))
        ends = sorted({end for p in asked.values() for end in (math.floor(p), math.ceil(p))})
        found = rows.where(F.col("place").isin(ends)).agg(*[between(p).alias(name) for name, p in asked.items()])
        out = found if out is None else out.crossJoin(F.broadcast(found))  # one row each
    return out.select(*columns)


def streaks(df: DataFrame, group: str, order: list[str], gain: Column, least: int, first: str) -> DataFrame:
    """(group, streak, first_...): runs of rows without gain, of ``least`` rows or more, with the least value of a column in each.

    A run is what stands between two gains of its group, whichever ranges it lies in.
    """
    rows = swept(df.withColumn("_gain", gain.cast("double")), [group], order, {"_run": (F.col("_gain") > 0).cast("long")})
    runs = rows.where(~F.coalesce(F.col("_gain") > 0, F.lit(False))).groupBy(group, "_run").agg(F.count("*").alias("streak"), F.min(first).alias(f"first_{first.removesuffix('_id')}"))
    return runs.where(F.col("streak") >= least).drop("_run")


def backoffs(df: DataFrame, group: str, order: list[str], gain: Column, limit: int = 25, hold_s: int = 45 * 60, idle_s: int = 6 * 3600) -> DataFrame:
    """(group, at, until): when a group begins to back off, with the time column first in ``order``.

    A group's run ends after ``idle_s`` without a result. In a run, every ``limit`` results in a row without gain begin a back-off of ``hold_s``
    and a new count, as long as nothing in the run has had a gain. So only the results before a run's first gain matter: the table of
    runs, one row each, says at which places of the group back-offs begin, and a join by place finds their times.
    """
    ts = order[0]
    rows = sweep(ranged(df.select(group, *order, gain.cast("double").alias("_gain")), [group], order), {"_place": F.lit(1).cast("long")}, {"_before": ts})
    rest = F.unix_micros(ts) - F.unix_micros("_before") > idle_s * 1_000_000
    rows = sweep(rows, {"_run": F.coalesce(rest, F.lit(True)).cast("long")})
    gains = F.min(F.when(F.col("_gain") > 0, F.col("_place")))
    runs = rows.groupBy(group, "_run").agg(F.min("_place").alias("_from"), F.coalesce(gains, F.max("_place") + 1).alias("_to"))
    n = F.floor((F.col("_to") - F.col("_from")) / limit)
    places = runs.where(n > 0).select(F.struct(group).alias("_g"), F.explode(F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.col("_from") + i * limit - 1)).alias("_p"))
    found = rows.select(group, F.col(ts).alias("at"), F.struct(group).alias("_g"), F.col("_place").alias("_p")).join(places, ["_g", "_p"])
    return found.select(group, "at", (F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hold_s))).alias("until"))


def cooled_down(df: DataFrame, key: list[str], ts: Column, cooldown_s: float, triggered: Column) -> DataFrame:
    """df with ``sent``: whether a triggered row is ``cooldown_s`` or more after the last one sent of its key; the first always is.

    ``ts`` is in seconds. After a gap of the cooldown's length between triggers the next one is sent whatever was before, so a key falls into stretches
    between such gaps; inside a stretch the sent times are folded in order. Rows of one time are sent or not together.
    """
    rows = df.withColumn("_ts", ts.cast("double")).withColumn("_on", F.coalesce(triggered, F.lit(False)) & F.col("_ts").isNotNull())
    times = sweep(ranged(rows.where("_on").select(*key, "_ts").distinct(), key, ["_ts"]), previous={"_before": "_ts"})
    gap = F.col("_before").isNull() | (F.col("_ts") - F.col("_before") >= cooldown_s)
    times = sweep(times, {"_stretch": gap.cast("long")})
    stretches = times.groupBy(*key, "_stretch").agg(F.array_sort(F.collect_list("_ts")).alias("_all"))
    start = F.array(F.get("_all", F.lit(0)))
    fold = F.aggregate("_all", start, lambda own, t: F.when(t - F.element_at(own, -1) >= cooldown_s, F.array_append(own, t)).otherwise(own))
    sent = stretches.select(*key, F.explode(fold).alias("_ts")).select(F.struct(*key, "_ts").alias("_sent"))
    same = F.struct(*[rows[c] for c in key], rows["_ts"]) == F.col("_sent")
    return rows.join(sent, same, "left").withColumn("sent", F.col("_on") & F.col("_sent").isNotNull()).select(*df.columns, "sent")
