"""Helpers shared by the text operators: shared-folder checkpoints, word splitting, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes nothing: maps A-Z to a-z and leaves every other byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``; only a session that names
    none (a local test) gets a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage: shuffle files and checkpoints of steps that are over stay on disk until then."""
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)  # of a string: its bytes
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def tile(key: Column, size: Column, most: int, salt: Column) -> Column:
    """Array of (a, b) chunk pairs that a row of a group of ``size`` rows has to visit.

    Groups of at most ``most`` rows have the one tile (0, 0). A larger one is cut in chunks by a hash of
    ``salt``, and each row goes to every tile that its chunk is part of, so that any two rows of the
    group still meet in some tile while no tile holds more than about twice ``most`` rows.
    """
    chunks = F.ceil(F.coalesce(size, F.lit(1)) / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64(key, salt), chunks).cast("int")
    other = F.sequence(F.lit(0), chunks - 1)
    pair = lambda x: F.struct(F.least(own, x).alias("a"), F.greatest(own, x).alias("b"))
    several = F.filter(F.transform(other, pair), lambda t: t["a"] != t["b"])
    return F.when(chunks <= 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(several)


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two columns of one orderable type; returns (node, component) for every node that an
    edge names, the component being its smallest node. Each step keeps at most as many edges as it
    gets; lineage is cut after each round, and rounds end when the edges no longer change.
    """
    now = checkpoint(
        edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v"))
        .where("u > v")
        .distinct()
    )
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = checkpoint(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """df as a Parquet table in the shared checkpoint folder, for as long as the block runs."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-tables-")
    place = f"{folder}/table-{uuid.uuid4()}"
    try:
        df.write.parquet(place)
        yield spark.read.parquet(place)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits (a power of two), set where the top of a value of the first column falls.

    It is built in tasks and has that size whatever the input, so it can go to the driver and to every task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(65 - bits.bit_length())
            np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        full = np.flatnonzero(own)
        yield pa.record_batch([pa.array(full), pa.array(own[full].view(np.int64))], ["at", "bits"])

    rows = hashes.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # at most bits / 64 rows
    own = np.zeros(bits // 64, np.uint64)
    own[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return own


def passes(own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash falls on a set bit of a filter."""
    at = hashes >> np.uint64(65 - (64 * len(own)).bit_length())
    return (own[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
