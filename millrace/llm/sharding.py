"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size (an offset and a step from hashes of its
name).  Shards take turns; each claims the next free slot of its order until the table is full, so slots are shared
evenly and a change of the shards moves few slots.  A row's key is hashed to a slot and the slot's shard is looked up:
a broadcast join with the table, whose size is fixed by ``table_size``.

Defined cases: rows with equal keys share a shard.  A null key is placed by ``fallback`` (another column) or, without
one, all null keys share one slot.  Columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, turns: Sequence[int] | None = None) -> list[int]:
    """Index into ``shards`` for every slot; ``turns`` gives a shard several claims a round (capacity)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime, so that every step visits all slots")
    if len(shards) > size:
        raise ValueError("more shards than slots")
    turns = turns or [1] * len(shards)
    place = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for shard in range(len(shards)):
            for _ in range(turns[shard]):
                if not free:
                    break
                while table[place[shard]] >= 0:
                    place[shard] = (place[shard] + step[shard]) % size
                table[place[shard]] = shard
                free -= 1
    return table


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE, turns: Sequence[int] | None = None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill_table(shards, size, turns))), "slot int, shard int")


def place_rows(
    df: DataFrame, key: Column, shards: Sequence[str], size: int = TABLE_SIZE, turns: Sequence[int] | None = None, fallback: Column | None = None
) -> DataFrame:
    """``df`` with slot and shard (index into ``shards``)."""
    hashed = F.xxhash64(key)
    if fallback is not None:
        hashed = F.when(key.isNull(), F.xxhash64(fallback)).otherwise(hashed)
    placed = df.withColumn("_slot", F.pmod(hashed, F.lit(size)).cast("int")).drop("slot", "shard").withColumnRenamed("_slot", "slot")
    table = table_frame(df.sparkSession, shards, size, turns)
    return placed.join(F.broadcast(table), "slot").select(*(F.col(f"`{c}`") for c in placed.columns), "shard")


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per shard; files of about ``rows_per_file`` rows, so a full shard is written by many tasks."""
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files"))
    salted = placed.join(F.broadcast(sizes), "shard").withColumn("_salt", F.floor(F.rand(7) * F.col("_files")))
    salted.repartition("shard", "_salt").drop("_salt", "_files").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").mode("overwrite").parquet(path)
