"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

Regions hold racks and racks hold shards; a shard has a weight, a rack or region the sum of its shards' weights. A
row descends from the root: every child of the node it stands at draws -ln(u) / weight, u being a hash of the row's key
and the child's name, and the least draw wins, so a child gets rows in proportion to its weight. A draw depends on the key
and that child alone: when weights change, a row changes sides only towards a child whose weight grew or away from one
whose weight fell, and below a node that nothing changed in, all rows stay where they were. A shard that comes as
a region of its own takes rows only into itself.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hexadecimal digits of a digest that make a draw.
DIGITS = 13
#: Rows of a written file, at most.
FILE_ROWS = 1 << 17


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks: int = 8, regions: int = 4) -> list[Leaf]:
    """Shards 0, 1, ... of weight one, dealt in runs to racks, and these in runs to regions."""
    rack = lambda s: s * racks // shards
    return [Leaf(f"r{rack(s) * regions // racks}", f"k{rack(s)}", s) for s in range(shards)]


def grown(tree: list[Leaf], shard: int, weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, as a region of its own."""
    return [*tree, Leaf(f"own{shard}", f"own{shard}", shard, weight)]


def children(tree: list[Leaf]) -> dict[str, list[tuple[str, float]]]:
    """Names and weights below each node, by the node's path; the root is ''. Shards without weight get no rows."""
    out: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for x in tree:
        if x.weight < 0:
            raise ValueError(f"shard {x.shard} has a negative weight")
        if x.weight > 0:
            region, rack = f"/{x.region}", f"/{x.region}/{x.rack}"
            for node, child in (("", region), (region, rack), (rack, f"{rack}/{x.shard}")):
                out[node][child] += x.weight
    if not out or len({x.shard for x in tree}) < len(tree):
        raise ValueError("a tree needs a shard with weight, and each shard once")
    return {node: sorted(below.items()) for node, below in out.items()}


def draw(key: Column, child: Column, weight: Column) -> Column:
    """The weighted draw of a child: exponential, of mean 1 / weight."""
    n = F.conv(F.substring(F.md5(F.concat(key, child).cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return -F.ln((n + 0.5) / float(16**DIGITS)) / weight


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key (its text; null is the empty key): three descents, by the tree as a literal."""
    below = children(tree)
    entry = lambda c, w: F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight"))
    nodes = F.map_from_entries(F.array(*[F.struct(F.lit(node).alias("node"), F.array(*[entry(*c) for c in found]).alias("below")) for node, found in below.items()]))
    key = F.coalesce(key.cast("string"), F.lit(""))

    def descend(node: Column) -> Column:
        return F.array_min(F.transform(F.element_at(nodes, node), lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name"))))["name"]

    return F.element_at(F.split(descend(descend(descend(F.lit("")))), "/"), -1).cast("int")


def numbered_within(rows: DataFrame, group: str, order: list[str], slot: str = "slot") -> DataFrame:
    """rows with their places, gapless from 0, in each group, in the order of further columns (nulls first).

    Rows are sorted once by ranges of (group, order) and a number that tells equal rows apart, so neither a
    large group nor many equal rows make a large task. The sorted rows are checkpointed, and how many rows of a group the
    ranges before have is a table of at most one row for each range and each group that ends in it.
    """
    sort = [group, *order, "_tie"]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = common.checkpoint(tied.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    cells = ranged.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col(group).alias("_group"), "_part", (before - F.col("_first")).alias("_shift"))
    joined = ranged.join(F.broadcast(cells), (F.col(group).eqNullSafe(F.col("_group"))) & (ranged["_part"] == cells["_part"]))
    return joined.withColumn(slot, F.col("_at") + F.col("_shift")).select(*rows.columns, slot)


def assigned(docs: DataFrame, tree: list[Leaf], more: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot) of each row, repeated rows included.

    The shard is decided by the id's text and the tree alone, so rows of one id share a shard, rows without id
    another, whatever their texts. ``size`` is the text's bytes in UTF-8 and 16 more; null text has none. ``more`` is the
    tree after a change, whose shard is ``grown_shard`` (null without one). Slots follow the id, then size and CRC-32. An
    empty table gives none; further columns don't matter.
    """
    key, text = F.col(id_col), F.coalesce(text_col, F.lit(""))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, more) if more else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return numbered_within(rows, "shard", ["doc_id", "size", "text_crc32"])


def written(docs: DataFrame, tree: list[Leaf], place: str, id_col: str = "doc_id", rows: int = FILE_ROWS) -> None:
    """Writes docs as Parquet under ``place``, a folder shard=N for each shard, in files of at most ``rows`` rows.

    A shard's rows are dealt over several tasks by their whole content and a number, so neither a large
    shard nor a repeated row makes a large task. A column named shard gives way to the folder's.
    """
    found = docs.drop("shard").withColumn("shard", shard_of(F.col(id_col), tree))
    counts = found.groupBy("shard").agg(F.ceil(F.count("*") / rows).cast("int").alias("_files"))
    found = found.join(F.broadcast(counts), "shard").withColumn("_file", F.pmod(F.monotonically_increasing_id(), F.col("_files")))
    files = max(1, counts.agg(F.sum("_files")).first()[0] or 1)
    found.repartition(files, "shard", "_file").drop("_files", "_file").write.option("maxRecordsPerFile", rows).partitionBy("shard").parquet(place)
