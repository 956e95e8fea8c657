"""A keyed table that a stream merges into, bucket by bucket.

The table is files by version and bucket, and a manifest for each batch: which version of each bucket is current, and the latest event time so
far. A batch rewrites the buckets that its keys fall in and no other, then writes its manifest; a batch that runs again starts from the
manifest before its own and so writes the same table again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, version long, seen_us long, late long"


def _versions(spark: SparkSession, place: str) -> list[int]:
    """Numbers of the finished versions below a folder; one entry a batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = [x.getPath() for x in files.listStatus(path)]
    return sorted(int(p.getName()[1:]) for p in done if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _manifest(spark: SparkSession, target: str, before: int | None = None) -> list:
    """Rows of the last manifest (before a batch): one a bucket."""
    found = [v for v in _versions(spark, f"{target}/manifest") if before is None or v < before]
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest/v{found[-1]}").collect() if found else []


def read_table(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The table as of the last batch (or the last one before a number); None if there is none."""
    return _read(spark, target, [(r["bucket"], r["version"]) for r in _manifest(spark, target, before) if r["version"] is not None])


def _read(spark: SparkSession, target: str, held: list[tuple[int, int]]) -> DataFrame | None:
    return spark.read.parquet(*[f"{target}/data/v{v}/_bucket={b}" for b, v in held]) if held else None


def merge_into(target: str, key: str, ts: str, payload: str, late_after_s: float | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the first record of each key stays, and an empty payload is filled by the first later record that has one.

    Of records of one batch the earliest by ``ts`` counts as first (ties by the other columns). Records older than the latest time of the batches before by more than
    ``late_after_s`` aren't merged; they are kept under ``late`` and counted in the manifest. Null keys share a record. Work and bytes
    written follow the buckets touched: choose so many that a bucket is some hundred megabytes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = {r["bucket"]: r for r in _manifest(spark, target, batch_id)}
        seen = max((r["seen_us"] for r in before.values() if r["seen_us"] is not None), default=None)
        us = F.unix_micros(F.col(ts).cast("timestamp"))
        is_late = us < seen - int(late_after_s * 1e6) if seen is not None and late_after_s is not None else F.lit(False)
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).withColumn("_late", F.coalesce(is_late, F.lit(False)))
        found = rows.groupBy("_bucket").agg(F.count_if(~F.col("_late")).alias("n"), F.count_if("_late").alias("late"), F.max(us).alias("us")).collect()  # a row a bucket
        touched = {r["_bucket"] for r in found if r["n"]}
        late = sum(r["late"] for r in found)
        if late:
            rows.where("_late").drop("_bucket", "_late").write.mode("overwrite").parquet(f"{target}/late/v{batch_id}")
        if touched:
            new = rows.where(~F.col("_late")).drop("_late").withColumn("_at", F.lit(batch_id).cast("long"))
            old = _read(spark, target, [(b, before[b]["version"]) for b in touched if b in before and before[b]["version"] is not None])
            if old is not None:
                new = old.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).unionByName(new)
            filled = F.nullif(payload, F.lit(""))
            rest = [c for c in batch.columns if c not in (key, payload)]
            order = F.struct("_at", ts, *[c for c in rest if c != ts])
            one = new.groupBy("_bucket", key).agg(F.min_by(F.struct(*rest, "_at"), order).alias("r"), F.min_by(filled, F.when(filled.isNotNull(), F.struct(order, filled))).alias(payload))
            merged = one.select(*[F.col(c) if c in (key, payload) else F.col(f"r.{c}").alias(c) for c in batch.columns], F.col("r._at").alias("_at"), "_bucket")
            merged.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/data/v{batch_id}")
        seen = max((x for x in (seen, *(r["us"] for r in found)) if x is not None), default=None)
        now = [(b, batch_id if b in touched else before[b]["version"] if b in before else None, seen, late) for b in range(buckets)]
        spark.createDataFrame(now, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/v{batch_id}")

    return write


def late_counts(spark: SparkSession, target: str) -> dict[int, int]:
    """Late records of each batch, from its manifest."""
    return {v: spark.read.schema(MANIFEST).parquet(f"{target}/manifest/v{v}").agg(F.max("late")).first()[0] for v in _versions(spark, f"{target}/manifest")}


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> list[int]:
    """Deletes versions that none of the last ``keep`` manifests refers to, and older manifests; returns the numbers of those."""
    manifests = _versions(spark, f"{target}/manifest")
    kept = manifests[-max(1, keep):]
    used = {r["version"] for v in kept for r in spark.read.schema(MANIFEST).parquet(f"{target}/manifest/v{v}").collect()}
    gone = [v for v in _versions(spark, f"{target}/data") if v not in used and v <= kept[-1]] if kept else []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for place in [*(f"{target}/manifest/v{v}" for v in manifests if v not in kept), *(f"{target}/data/v{v}" for v in gone)]:
        path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(place), True)
    return gone
