"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``REPLICAS`` points on a ring of 65,536 cells. A document falls
into the cell its hash names and belongs to the next point clockwise; where that
point's shard is full the document goes on clockwise to the next shard with room.
Loads are row counts and the bounds are as tight as they can be, n / shards
rounded down or up, so every shard ends up full and counts differ by at most one
(the ``rows`` law). Only documents that overflow leave the shard of their point.

Documents of one arc (the cells before a point) walk the same way, so the walk
needs one count per arc: at most shards x replicas numbers, whatever the size of
the table. Ranks inside an arc come from counts of small hash ranges; no shard
or arc is ever gathered or sorted in one task.

Defined results: a null text has no bytes and checksum 0; a null doc_id has a
hash like any other; rows that agree in doc_id and text share a place on the
ring and get different slots. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.recovery import checkpointed

SHARDS, REPLICAS = 24, 64
CELLS = 1 << 16
RANGE_ROWS = 256
_SPREAD = 0x9E3779B97F4A7C15


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(cell, shard) of every point in clockwise order; of points that meet in a cell the smaller shard stays."""
    owner: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(replicas):
            h = (shard * 1_000_003 + replica + 1) * _SPREAD & ((1 << 64) - 1)
            h ^= h >> 29
            h = h * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1)
            owner.setdefault(h >> 48, shard)
    return sorted(owner.items())


def walk(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where the documents of each arc end up: (arc, from rank, to rank, shard, first slot).

    Round by round every waiting stretch asks the point it has reached; the
    shard takes what it has room for, the rest goes on to the next point with room.
    """
    n = sum(counts)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    load = [0] * shards
    out, waiting = [], [(a, 0, c, a) for a, c in enumerate(counts) if c]
    while waiting:
        on = []
        for arc, lo, hi, at in waiting:
            shard = owners[at]
            took = min(hi - lo, room[shard] - load[shard])
            if took:
                out.append((arc, lo, lo + took, shard, load[shard]))
                load[shard] += took
            if lo + took < hi:
                on.append((arc, lo + took, hi, at))
        waiting = []
        for arc, lo, hi, at in on:
            while load[owners[at]] == room[owners[at]]:
                at = (at + 1) % len(owners)
            waiting.append((arc, lo, hi, at))
    return out


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, replicas: int = REPLICAS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"))
    slim = checkpointed(slim.withColumn("h", F.xxhash64("id", "crc", "size")))
    points = ring(shards, replicas)
    arcs, begin = [], points[-1][0] + 1
    for arc, (cell, _) in enumerate(points):
        # cells after the last point up to this one; the first arc runs over the end of the ring
        arcs += [(arc, begin, CELLS - 1, -CELLS), (arc, 0, cell, 0)] if arc == 0 and begin < CELLS else [(arc, 0 if arc == 0 else begin, cell, 0)]
        begin = cell + 1
    cells = spark.createDataFrame(arcs, "arc int, a int, b int, shift int").select("arc", F.explode(F.sequence("a", "b")).alias("cell"), "shift")
    cells = cells.select("arc", "cell", (F.col("cell") + F.col("shift")).alias("ord"))
    rows = slim.count()
    bits = max(0, math.ceil(math.log2(max(rows, 1) / CELLS / RANGE_ROWS)))
    cell: Column = F.shiftrightunsigned("h", 48).cast("int")
    sub: Column = F.shiftrightunsigned(F.shiftleft("h", 16), 64 - bits).cast("int") if bits else F.lit(0)
    placed = slim.withColumn("cell", cell).withColumn("sub", sub)
    bins = placed.groupBy("cell", "sub").agg(F.count("*").alias("n")).join(F.broadcast(cells), "cell")  # one row per cell of the ring
    ahead = F.sum("n").over(Window.partitionBy("arc").orderBy("ord", "sub").rowsBetween(Window.unboundedPreceding, -1))
    bins = checkpointed(bins.withColumn("ahead", F.coalesce(ahead, F.lit(0))))
    counts = [0] * len(points)
    for r in bins.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # at most shards x replicas rows
        counts[r.arc] = r.n
    moves = spark.createDataFrame(walk(counts, [s for _, s in points], shards), "arc int, lo long, hi long, shard int, base long")
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("cell", "sub").orderBy("h", "id", "crc", "size")) - 1)
    ranked = ranked.join(bins.select("cell", "sub", "arc", "ahead"), ["cell", "sub"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    done = ranked.join(F.broadcast(moves), (ranked["arc"] == moves["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return done.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
