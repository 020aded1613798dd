"""Consistent sharding by a permutation-filled lookup table, in DataFrame functions only."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

SLOTS = 65537
#: Largest table that is broadcast: slots are at most this many rows of two ints.
MAX_SLOTS = 1 << 20


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


@lru_cache(maxsize=16)
def fill_table(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """Slot -> index of its shard.

    Each shard has its own preference order of the slots, ``offset + i * skip`` modulo the prime ``slots``. Shards
    take turns; each claims the first free slot of its order. All shards get equally many slots, give or take one,
    and adding or losing one shard moves few others. Shard names are distinct; at least one is needed.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("distinct shard names are needed, no more than slots")
    if not 2 <= slots <= MAX_SLOTS or any(slots % p == 0 for p in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime of at most 2**20")
    at = [_digest("offset:" + s) % slots for s in shards]
    skip = [_digest("skip:" + s) % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return tuple(table)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 32 bits of the MD5 of its text, modulo the table. Null keys take the empty text's slot."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def table_frame(spark: SparkSession, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the lookup table, of a size fixed by ``slots``."""
    return spark.createDataFrame(list(enumerate(fill_table(tuple(shards), slots))), "slot int, shard int")


def assign_shards(df: DataFrame, shards: tuple[str, ...], key: str = "doc_id", slots: int = SLOTS, into: str = "shard") -> DataFrame:
    """``df`` with its shard index in the column ``into``, which replaces a column of that name.

    Every row stays, in any number of copies; rows with a null key share one slot. A hot key lands in one shard by
    definition, while rows of a hot source spread, since placement looks at the key alone. One narrow map with a
    broadcast of ``slots`` rows (at most MAX_SLOTS): no shuffle.
    """
    look = table_frame(df.sparkSession, tuple(shards), slots)
    slot, shard = fresh(df, "slot_of_key", "shard_of_slot")
    look = look.select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    kept = [c for c in df.columns if c.lower() != into.lower()]
    slotted = df.withColumn(slot, slot_of(F.col(key), slots))
    return slotted.join(F.broadcast(look), slot, "left").select(*[F.col(f"`{c}`") for c in kept], F.col(shard).alias(into))


def write_shards(df: DataFrame, path: str, shards: tuple[str, ...], key: str = "doc_id") -> None:
    """Write each shard to its own folder ``shard=<i>``; tasks write only the shards that they hold."""
    assign_shards(df, shards, key).write.partitionBy("shard").parquet(path)
