"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size, from two hashes of its
name: (offset + j * skip) mod size. The shards take turns; at its turn a shard claims the first slot of its
order that is still free. A key's slot is its hash mod the size, so placement is one lookup. When a
shard leaves or joins, few of the other shards' slots move.

The table's size is a parameter (65,537 slots here, about 1 MB broadcast), whatever the data's size, and
rows never shuffle, so hot keys cost nothing.

Defined cases: a null key is a key like any other; repeated keys share a slot; an empty table gives no
rows; added columns named slot or shard are refused if the input has them already.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SEED = 42


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard's index in each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, one at least and no more than slots")
    if size < 3 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime over 2")
    offset = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    tried, owner, taken = [0] * len(shards), [-1] * size, 0
    while True:
        for s in range(len(shards)):
            while owner[slot := (offset[s] + tried[s] * skip[s]) % size] >= 0:
                tried[s] += 1
            owner[slot] = s
            taken += 1
            if taken == size:
                return owner


def lookup(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """slot int, shard string: one row a slot."""
    names = F.array(*[F.lit(s) for s in shards])
    owners = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "o")).select("slot", F.get(names, F.col("o").cast("int")).alias("shard"))


def assign(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """df with the slot (int) and shard (string) of its key, in columns of the given names; these must be new ones."""
    if clash := {slot_column, shard_column} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    slot = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(size)).cast("int")
    table = lookup(df.sparkSession, shards, size).withColumnsRenamed({"slot": slot_column, "shard": shard_column})
    return df.withColumn(slot_column, slot).join(F.broadcast(table), slot_column, "left").select(*df.columns, slot_column, shard_column)
