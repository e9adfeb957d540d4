"""Operator 8 [native]: placement of rows on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: offset and step
from its name's digest.  Shards take turns claiming their next free slot until none is
left, so shares differ by one slot, and a shard that goes away frees its own slots while
few others move.  A row's key hashes to a slot, and the table (an array of `size` numbers,
a parameter) gives the shard in constant time, without a shuffle.

Placement does not depend on other rows, so a hot key would fill its shard alone: keys
should be row ids; spread > 1 splits each key over so many neighbouring slots by `salt`.
Defined cases: a null key takes the place of the empty string; repeated keys share a shard;
an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 4099


def preference(name: str, size: int) -> tuple[int, int]:
    h = hashlib.md5(name.encode()).hexdigest()
    return int(h[:15], 16) % size, int(h[15:30], 16) % (size - 1) + 1


def lookup_table(shards: list[str], size: int = SIZE) -> np.ndarray:
    """The shard number of each slot."""
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be prime, so that every step visits all slots")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one and at most as many as slots")
    table = np.full(size, -1, np.int32)
    place, step = map(list, zip(*(preference(s, size) for s in shards)))
    left = size
    while left:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % size
            table[place[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot(key: Column, size: int = SIZE, spread: int = 1, salt: Column | None = None) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    at = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    if spread > 1:
        at = at + F.pmod(F.xxhash64(salt), F.lit(spread))
    return F.pmod(at, F.lit(size)).cast("int")


def place(df: DataFrame, key: Column, shards: list[str], size: int = SIZE, spread: int = 1, salt: Column | None = None) -> DataFrame:
    """df with slot int and shard string."""
    table, names = F.lit(lookup_table(shards, size)), F.array(*map(F.lit, shards))
    at = df.withColumn("slot", slot(key, size, spread, salt))
    return at.withColumn("shard", F.get(names, F.get(table, F.col("slot"))))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard; no shuffle, so a hot shard is written by many tasks."""
    placed.write.partitionBy("shard").mode("errorifexists").parquet(path)
