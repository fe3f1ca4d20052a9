"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone.

The ring has 2^16 cells. Each shard owns `nodes` virtual nodes at hashed cells; a row belongs to the cell of its hash, and the cell to
the next virtual node clockwise. Every shard has a bound (rows // shards, one more for the first of them); rows of a full shard go on
clockwise to the next virtual node whose shard has room. So counts differ by one at most, and a further shard moves few rows.

Which rows overflow is decided on the counts of the cells (2^16 at most, whatever the input), then each row finds its place by its
rank within its cell: one narrow shuffle. The small table of decisions is broadcast; its size is bounded by cells and shards.

Defined results: a null text has no bytes; null and repeated ids are keys like any other (equal rows are told apart by rank alone, so
their places are interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CELLS = 1 << 16


def ring(spark, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node by cell; of two nodes on one cell the lower shard stays."""
    ids = spark.range(shards * nodes).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    rows = ids.select(F.pmod(F.xxhash64("shard", "node"), F.lit(CELLS)).alias("cell"), "shard").groupBy("cell").agg(F.min("shard").alias("shard")).collect()
    return sorted((r["cell"], r["shard"]) for r in rows)


def settle(counts: dict[int, int], nodes: list[tuple[int, int]], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where the rows of each cell go.

    Round by round every virtual node takes, in ring order, what waits at it while its shard has room; what is left goes on to the next
    node whose shard has room. A round that leaves rows fills a shard, so there are no more rounds than shards."""
    room, used, out = list(bounds), [0] * len(bounds), []
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
    at = 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        waiting[at % len(nodes)].append((cell, 0, counts[cell]))
    while any(waiting):
        left: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
        for k, (_, shard) in enumerate(nodes):
            for cell, a, b in waiting[k]:
                n = min(b - a, room[shard])
                if n:
                    out.append((cell, a, a + n, shard, used[shard]))
                    room[shard] -= n
                    used[shard] += n
                if a + n < b:
                    left[k].append((cell, a + n, b))
        following, waiting = None, [[] for _ in nodes]
        for k in reversed(range(2 * len(nodes))):
            k %= len(nodes)
            if room[nodes[k][1]]:
                following = k
            elif left[k] and following is not None:
                waiting[following] += left[k]
                left[k] = []
    return out


def shard_rows(docs: DataFrame, shards: int = 8, nodes: int = 64, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: columns `keep`, size, text_crc32, shard, slot (gapless from 0 within a shard)."""
    common.reserved(keep, ("size", "text_crc32", "shard", "slot"))
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col("doc_id").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    hashed = narrow.withColumn("h", F.xxhash64("id", "text_crc32", "size")).withColumn("cell", F.pmod("h", F.lit(CELLS)).cast("int"))
    hashed = common.written(hashed, "shards")
    counts = {r["cell"]: r["count"] for r in hashed.groupBy("cell").count().collect()}
    total = sum(counts.values())
    places = settle(counts, ring(spark, shards, nodes), [total // shards + (s < total % shards) for s in range(shards)])
    plan = spark.createDataFrame(places, "at int, low long, high long, shard int, base long")
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("h", "id", "text_crc32", "size")).cast("long") - 1)
    placed = ranked.join(F.broadcast(plan), (F.col("cell") == F.col("at")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_rows(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
