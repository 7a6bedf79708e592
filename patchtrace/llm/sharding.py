"""Sharding: a permutation-filled lookup table of prime size.

Every shard has its own order of preference over the slots, ``(offset + j * skip) mod M``
with both numbers taken from hashes of its name. The shards take turns; each claims the
next slot of its order that is still free, until all M slots are taken, so the shares
differ by one slot at most. When a shard joins or leaves, few keys move between the others.

The table (M rows of two numbers, whatever the corpus) is broadcast; placement is one hash
and one look-up. Hashes are taken from md5, which other engines have, too.

Defined results: the key is the id's text; a null id is placed by the md5 of its text (null:
empty), so rows without an id don't meet in one shard; equal keys go to one shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchtrace.llm.common import pick

#: Prime, and more than a hundred slots for each of several hundred shards.
SLOTS = 65537


def _hash(text: str) -> int:
    """The first 60 bits of the text's md5."""
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Shard number of each slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least, and no more than the slots")
    place = [_hash("offset " + s) % slots for s in shards]
    skip = [_hash("skip " + s) % (slots - 1) + 1 for s in shards]
    table, left = np.full(slots, -1, np.int32), slots
    while True:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            table[place[i]] = i
            left -= 1
            if left == 0:
                return table


def place(docs: DataFrame, shards: list[str], *, id_col: str = "doc_id", text_col: str = "text",
          slots: int = SLOTS) -> DataFrame:
    """One row per document: id_col, slot, shard (a number in ``shards``)."""
    table = lookup_table(shards, slots)
    held = docs.sparkSession.createDataFrame(
        pa.table({"slot": pa.array(np.arange(slots, dtype=np.int64)), "shard": pa.array(table)}))
    key = F.coalesce(F.col("id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    slot = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots
    return (pick(docs, id=id_col, text=text_col).select(F.col("id").alias(id_col), slot.alias("slot"))
            .join(F.broadcast(held), "slot").select(id_col, "slot", "shard"))


def write_shards(docs: DataFrame, path: str, shards: list[str], *, id_col: str = "doc_id",
                 text_col: str = "text", files: int = 4, slots: int = SLOTS) -> None:
    """Write all columns of ``docs`` to one folder per shard, each shard from ``files`` tasks."""
    table = lookup_table(shards, slots)
    held = docs.sparkSession.createDataFrame(
        pa.table({"_slot": pa.array(np.arange(slots, dtype=np.int64)), "shard": pa.array(table)}))
    key = F.coalesce(docs[id_col].cast("string"), F.md5(F.coalesce(docs[text_col], F.lit(""))))
    slot = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots
    (docs.withColumn("_slot", slot).join(F.broadcast(held), "_slot")
     .repartition("shard", F.col("_slot") % files).drop("_slot")
     .write.partitionBy("shard").parquet(path))
