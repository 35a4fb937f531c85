"""Placement of documents on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: slots ``offset + i * skip``
modulo the table's size. Shards take turns, and in its turn a shard claims the first slot of its order
that is still free, until the table is full. A key is hashed to a slot, and the slot names the shard;
adding or removing one shard moves few keys besides its own.

The table is built on the driver: its size is a parameter (``slots``, at most ``MAX_SLOTS``), never a
function of the data, so its broadcast is bounded. Placement is one broadcast hash join on DataFrame
functions only; the documents are not shuffled.

Defined results: a null key is placed as the text ``null`` would be; equal keys share a shard; an empty
table gives an empty result; extra columns are untouched, and a column already named ``shard`` or
``shard_slot`` is replaced.
"""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import table

MAX_SLOTS = 1 << 20
SHARDS, SLOTS = 64, 16381


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


@cache
def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """Index into `shards` for each slot."""
    if not 0 < len(set(shards)) == len(shards) <= slots <= MAX_SLOTS:
        raise ValueError("shards must be distinct, and no more than slots, which are at most MAX_SLOTS")
    if any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError("slots must be prime, so that every skip visits all slots")
    at = [_number(f"offset|{s}") % slots for s in shards]
    skip = [_number(f"skip|{s}") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return tuple(owner)


def slot_of(key: Column, slots: int) -> Column:
    """Slot by the first 60 bits of the key's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """`docs` with the columns ``shard_slot`` (long) and ``shard`` (int; an index into the sorted shard names)."""
    names = tuple(f"shard-{i:05d}" for i in range(shards)) if isinstance(shards, int) else tuple(sorted(shards))
    owner = F.split(F.lit(",".join(map(str, lookup_table(names, slots)))), ",").cast("array<int>")
    places = docs.sparkSession.range(1).select(F.posexplode(owner).alias("shard_slot", "shard"))
    places = places.select(F.col("shard_slot").cast("long"), "shard")
    placed = docs.drop("shard", "shard_slot").withColumn("shard_slot", slot_of(F.col(key), slots))
    return placed.join(F.broadcast(places), "shard_slot", "left")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, with the size of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return assign_shards(docs).select("doc_id", "shard_slot", "shard", "n_bytes")


def oracle() -> str:
    names = tuple(f"shard-{i:05d}" for i in range(SHARDS))
    owner = ",".join(map(str, lookup_table(names, SLOTS)))
    return f"""
    WITH places AS (SELECT string_split('{owner}', ',') AS owner),
    placed AS (
      SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT % {SLOTS} AS shard_slot,
             CAST(strlen(text) AS INTEGER) AS n_bytes
      FROM documents)
    SELECT doc_id, shard_slot, CAST(owner[shard_slot + 1] AS INTEGER) AS shard, n_bytes FROM placed, places
    """
