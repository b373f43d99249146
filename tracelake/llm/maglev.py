"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: an
offset and a step, both from a hash of its name. Shards take turns, each claiming the first
slot in its order that is still free, until the table is full. Shares differ by one slot at
most, and when a shard comes or goes few other slots change. Rows are placed in constant time:
the key's hash gives the slot, a broadcast of the table the shard.

The table's size is a parameter (``slots``), so the fill on the driver and the broadcast are
bounded; placing rows is a projection and a broadcast join without a shuffle, whatever the
distribution of keys.

Defined cases: a null key is hashed as a value of its own that no text has; equal keys get
equal shards; rows keep their other columns, ``slot`` and ``shard`` replace columns of these
names; no shards or fewer slots than shards fail.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime about a hundred times the number of shards or more.
SLOTS = 1_621


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot."""
    if not shards or slots < len(shards):
        raise ValueError(f"{slots} slots cannot hold {len(shards)} shards")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime")
    place = [_number(f"{s}/offset") % slots for s in shards]
    step = [_number(f"{s}/step") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for shard in range(min(len(shards), left)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % slots
            table[place[shard]] = shard
            left -= 1
    return table


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as ``slot, shard``."""
    names = F.array(*(F.lit(s) for s in shards))
    held = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    rows = spark.range(1).select(F.posexplode(held).alias("slot", "number"))
    return rows.select(F.col("slot").cast("long"), F.element_at(names, F.col("number").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of its text's MD5, modulo the table's size."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``."""
    rows = rows.withColumn("slot", slot_of(F.col(f"`{key}`"), slots)).drop("shard")
    return rows.join(F.broadcast(lookup(rows.sparkSession, shards, slots)), "slot")
