"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Workspace

#: Points of the ring, a power of 2; points that each shard owns on it; ranges of the order in which keys are taken in.
POINTS_BITS, NODES, RANGE_BITS = 12, 96, 12


def ring(shards: int, nodes: int = NODES) -> list[list[int]]:
    """For each point the shards in the order in which their virtual nodes come clockwise."""
    size = 1 << POINTS_BITS
    owned: list[tuple[int, int]] = []
    for s in range(shards):
        for v in range(nodes):
            h = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
            owned.append((h, s))
    owned.sort()
    shift = 64 - POINTS_BITS
    out, at = [], 0
    for point in range(size):
        while at < len(owned) and owned[at][0] >> shift < point:
            at += 1
        order: list[int] = []
        for i in range(len(owned)):
            s = owned[(at + i) % len(owned)][1]
            if s not in order:
                order.append(s)
                if len(order) == shards:
                    break
        out.append(order)
    return out


def ring_shards(docs: DataFrame, shards: int = 8, slack: float = 0.0) -> DataFrame:
    """Every row of docs as (doc_id, size, text_crc32, shard, slot).

    docs: doc_id, text, and other columns, which are ignored. size is the text's UTF-8 bytes (null: none) plus 1. A
    row's point on the ring comes from its doc_id. A shard takes at most ceil((1 + slack) * rows / shards), or with
    slack 0 its exact share, rows // shards and one more for the first rows % shards; rows beyond it continue clockwise
    to the next shard with room. Who comes first is decided by a hash of doc_id, text and size, so the result does not
    depend on partitioning. slot numbers the rows of a shard from 0 without gaps. The result is a table in the shared
    folder.

    Equal rows are taken as one item with a count, which may be divided at a full shard, so a key with a third of all
    rows is never one task's work. A null doc_id is a key like any other; null and empty texts have size 1; no rows
    give no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    items = keyed.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("m"))
    rank = F.xxhash64(F.lit("rank"), "doc_id", "size", "text_crc32")
    point = F.shiftrightunsigned(F.xxhash64(F.lit("point"), "doc_id"), 64 - POINTS_BITS).cast("int")
    items = work.write(items.withColumn("rank", rank).withColumn("part", F.shiftrightunsigned("rank", 64 - RANGE_BITS).cast("int")).withColumn("point", point))
    total = items.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    room = [total // shards + (s < total % shards) for s in range(shards)] if not slack else [-int(-total * (1 + slack) // shards)] * shards
    filled = [0] * shards
    # 2 ** POINTS_BITS rows, whatever the data
    clockwise = F.broadcast(spark.range(1).select(F.posexplode(F.array(*[F.lit(",".join(map(str, x))) for x in ring(shards)])).alias("point", "order")).select("point", F.split("order", ",").cast("array<int>").alias("order")))
    waiting, placed = items.join(clockwise, "point"), None
    while total:
        open_now = F.array(*[F.lit(s) for s in range(shards) if filled[s] < room[s]])
        aimed = waiting.withColumn("shard", F.filter("order", lambda s: F.array_contains(open_now, s))[0])
        # at most shards * 2 ** RANGE_BITS sums come to the driver
        sums = sorted(tuple(r) for r in aimed.groupBy("shard", "part").agg(F.sum("m")).collect())
        if not sums:
            break
        ahead, starts = dict.fromkeys(range(shards), 0), []
        for s, p, k in sums:
            starts.append((s, p, ahead[s]))
            ahead[s] += k
        offsets = spark.range(1).select(F.explode(F.split(F.lit(" ".join(f"{s},{p},{k}" for s, p, k in starts)), " ")).alias("v")).select(F.split("v", ",").alias("v")).select(F.col("v")[0].cast("int").alias("shard"), F.col("v")[1].cast("int").alias("part"), F.col("v")[2].cast("long").alias("ahead"))
        running = F.sum("m").over(Window.partitionBy("shard", "part").orderBy("rank", "doc_id", "size", "text_crc32"))
        left = F.element_at(F.array(*[F.lit(int(room[s] - filled[s])) for s in range(shards)]).cast("array<bigint>"), F.col("shard") + 1)
        base = F.element_at(F.array(*[F.lit(int(filled[s])) for s in range(shards)]).cast("array<bigint>"), F.col("shard") + 1)
        ranked = aimed.join(F.broadcast(offsets), ["shard", "part"]).withColumn("start", F.col("ahead") + running - F.col("m"))
        ranked = work.write(ranked.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least("m", left - F.col("start")))).withColumn("slot", base + F.col("start")))
        now = ranked.where("taken > 0").select("doc_id", "size", "text_crc32", "shard", "slot", "taken")
        placed = now if placed is None else placed.unionByName(now)
        filled = [filled[s] + min(room[s] - filled[s], ahead[s]) for s in range(shards)]
        waiting = ranked.where("taken < m").select("point", "doc_id", "size", "text_crc32", (F.col("m") - F.col("taken")).alias("m"), "rank", "part", "order")
    if placed is None:
        placed = items.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("taken")).where("false")
    # a large count is laid out in two steps, so that no array is long
    step = 4096
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / step))))
    each = F.sequence(F.lit(0).cast("long"), F.least(F.lit(step).cast("long"), F.col("taken") - F.col("block") * step) - 1)
    out = blocks.withColumn("i", F.explode(each)).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("block") * step + F.col("i")).alias("slot"))
    out = work.write(out)
    work.keep(out)
    return out


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, size, text_crc32, law (rows), shard, slot, grown_shard (null)."""
    out = ring_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
