"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns a number of points on the 64-bit ring; a key belongs to the first point clockwise. A shard takes no
more keys than its bound. Keys that overflow a full shard, the last of their arc in hash order, continue clockwise to
the next point whose shard has room. The bound is exact: with n keys on k shards every shard ends with n div k keys or
one more, the extra ones going to the shards with the most keys of their own. What moves when shards change is the
arcs of the changed shard plus the overflow.

The plan is over arcs: keys are counted per arc, the few thousand counts are settled by one clockwise pass, and each key
finds its shard from its arc and its rank there. Keys that repeat get a replica number each before hashing, so even
one row that makes up a third of the table is spread over the whole ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, fresh, numbered

POINTS = 128  # virtual nodes per shard
CELL_BITS = 12
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def ring(spark: SparkSession, shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise. shards * points entries, whatever the data."""
    nodes = spark.range(shards * points).select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("v"))
    return sorted((r.at, r.shard) for r in nodes.select(F.xxhash64(F.lit("ring"), "shard", "v").alias("at"), "shard").collect())


def arcs(spark: SparkSession, nodes: list[tuple[int, int]]) -> DataFrame:
    """(cell, lo, hi, arc): the arcs cut along equal cells of the ring, so that a hash finds its arc by an equi-join on the cell."""
    shift, rows = 64 - CELL_BITS, []
    bounds = [LOW, *[at + 1 for at, _ in nodes[:-1]]]
    pieces = [(lo, at, i) for i, (lo, (at, _)) in enumerate(zip(bounds, nodes, strict=True))]
    if nodes[-1][0] < HIGH:
        pieces.append((nodes[-1][0] + 1, HIGH, 0))  # past the last point: on to the first
    for lo, hi, arc in pieces:
        rows += [(cell, max(lo, cell << shift), min(hi, (cell + 1 << shift) - 1), arc) for cell in range(lo >> shift, (hi >> shift) + 1)]
    return spark.createDataFrame(rows, "cell bigint, lo bigint, hi bigint, arc int")


def settle(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank, shard, slot of the first) for all keys, given the number of keys in each arc."""
    total, own = sum(counts), [0] * shards
    for n, s in zip(counts, owners, strict=True):
        own[s] += n
    room = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-own[s], s))[: total % shards]:
        room[s] += 1
    used, left, out = [0] * shards, list(counts), []

    def take(arc: int, shard: int) -> None:
        n = min(left[arc], room[shard] - used[shard])
        if n:
            first = counts[arc] - left[arc]
            out.append((arc, first, first + n - 1, shard, used[shard]))
            used[shard] += n
            left[arc] -= n

    for arc, shard in enumerate(owners):
        take(arc, shard)
    for arc in range(len(owners)):
        at = arc
        while left[arc]:
            at = (at + 1) % len(owners)
            take(arc, owners[at])
    return out


def place(rows: DataFrame, shards: int, points: int = POINTS) -> DataFrame:
    """``rows`` with shard and slot (from 0 in each shard, without gaps). Every column is part of the key.

    Equal rows are told apart by a replica number only, so the result is the same whichever of them is which. Nulls are
    values like any other. Rows that have a column named shard or slot already are refused, as are columns of map type, which
    Spark cannot group by; other names do not matter. An empty table gives an empty result.
    """
    spark, taken = rows.sparkSession, {c.lower() for c in rows.columns} & {"shard", "slot"}
    if taken:
        raise ValueError(f"columns of these names are to be added: {sorted(taken)}")
    single = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    hashed = numbered(single, "copies", "replica").select("row", "replica", F.xxhash64("row", "replica").alias("h"))
    nodes = ring(spark, shards, points)
    lookup = arcs(spark, nodes)  # at most 2 ** CELL_BITS + shards * points rows
    keyed = cut(hashed.withColumn("cell", F.shiftright("h", 64 - CELL_BITS)).join(F.broadcast(lookup), "cell").where("h between lo and hi").drop("cell", "lo", "hi"))
    counts = [0] * len(nodes)
    for r in keyed.groupBy("arc").count().collect():  # one row per virtual node
        counts[r.arc] = r["count"]
    parts = spark.createDataFrame(settle(counts, [s for _, s in nodes], shards), "arc int, first bigint, last bigint, shard int, base bigint")
    rank = F.row_number().over(Window.partitionBy("arc").orderBy("h", "row", "replica")) - 1
    ranked = keyed.withColumn("rank", rank.cast("long"))
    return ranked.join(F.broadcast(parts), "arc").where("rank between first and last").select("row.*", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document. Law: row counts at most one apart."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_hash_"))
    return place(rows, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, rows_per_file: int = 1_000_000) -> None:
    """Write whole rows to ``path``/shard=N. Rows of a shard go to as many tasks as they need, not to one.

    Nulls are values like any other, rows that repeat are written as often as they occur, long texts whole; all columns of ``docs`` are
    kept, whatever their names, but for shard and slot, which ``place`` refuses. An empty table leaves a folder without a shard.
    """
    placed = place(docs, shards)
    part = fresh(placed, "part_")
    spread = placed.withColumn(part, F.expr(f"slot div {rows_per_file}"))
    spread.repartition("shard", part).drop(part).write.mode("overwrite").partitionBy("shard").parquet(path)

