"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many places of a ring of cells; a row belongs to the owner of the next place
clockwise from the hash of its key. A shard takes no more rows than its bound: rows beyond it go on
clockwise to the next shard that has room. With ``slack`` 0 the bounds add up to the row count, so
counts differ by one at most; more slack moves fewer rows when a shard is added.

The ring is a table whose size is a parameter. Rows are placed in rounds: after each round one more
shard is full, so there are at most as many rounds as shards, and only overflowing rows enter the
next one. Nothing but one count per shard comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.operators.ordered import Ordered, row_number
from tallyfield.session import checkpoint

CELLS = 4096  # of the ring; its table is broadcast and has this many rows
VIRTUAL = 64  # places of each shard on the ring


def ring(spark: SparkSession, shards: list[int], virtual: int = VIRTUAL, cells: int = CELLS) -> DataFrame:
    """(cell, shard): the owner of every cell, the next virtual node at or after it."""
    node = spark.range(virtual).select(
        F.explode(F.array(*[F.lit(s) for s in shards])).alias("shard"), F.col("id").alias("replica")
    )
    h = F.xxhash64(F.lit("node"), "shard", "replica")
    node = node.select("shard", F.pmod(h, F.lit(cells)).alias("cell"), h.alias("h"))
    node = node.groupBy("cell").agg(F.min_by("shard", F.struct("h", "shard")).alias("node"))
    all_cells = spark.range(cells).withColumnRenamed("id", "cell")
    back = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.last("node", ignorenulls=True)
    return all_cells.join(node, "cell", "left").select(
        "cell", F.coalesce(after.over(back), after.over(every)).alias("shard")
    )


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows each shard takes."""
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def placed(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slack: float = 0.0,
    virtual: int = VIRTUAL, cells: int = CELLS,
) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; slots of a shard run from 0 without gaps.

    Rows that repeat, or share a key, start at the same cell, count one each and may part where a
    shard is full. A null key is a key like others; a null text has size 1 and the checksum of an
    empty one. An empty table gives an empty result. Other columns are not looked at.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("_size"),
        F.crc32(body).cast("long").alias("_crc"),
        F.xxhash64(F.lit("row"), F.col(key).cast("string")).alias("_hash"),
    )
    # written once: the number of a row, which parts equal rows, must not change
    pending = checkpoint(rows.withColumn("_row", F.monotonically_increasing_id()))
    room = dict(enumerate(bounds(pending.count(), shards, slack)))
    order = ["_hash", "_key", "_crc", "_row"]
    done: list[DataFrame] = []
    while True:
        open_shards = [s for s, n in room.items() if n > 0] or list(room)
        owner = ring(spark, open_shards, virtual, cells)  # CELLS rows
        cell = F.pmod(F.col("_hash"), F.lit(cells))
        asked = pending.withColumn("_cell", cell).join(
            F.broadcast(owner.select(F.col("cell").alias("_cell"), F.col("shard").alias("_shard"))), "_cell"
        ).drop("_cell")
        counts = {r["_shard"]: r["count"] for r in asked.groupBy("_shard").count().collect()}
        full = [s for s, n in counts.items() if n > room[s]]
        if not full:
            done.append(asked)
            break
        fits = ~F.col("_shard").isin(full)
        over = Ordered(asked.where(~fits), ["_shard"], order).add(_place=row_number()).result()
        limit = F.element_at(
            F.create_map(*[F.lit(x) for s in full for x in (s, room[s])]), F.col("_shard")
        )
        over = checkpoint(over.withColumn("_in", F.col("_place") <= limit))
        done += [asked.where(fits), over.where("_in").select(asked.columns)]
        pending = over.where("not _in").select(rows.columns + ["_row"])
        room = {s: 0 if s in full else n - counts.get(s, 0) for s, n in room.items()}
    out = Ordered(reduce(DataFrame.union, done), ["_shard"], order).add(_slot=row_number()).result()
    return out.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_slot") - 1).alias("slot"),
    )
