"""Placement of keys on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that owns each slot.

    Each shard walks the slots in an order of its own, ``(offset + i * skip) mod size``, which is a
    permutation because ``size`` is prime. The shards take turns, each claiming the first free slot
    of its order, until none is free, so any two shares differ by one slot at most. The table holds
    ``size`` small numbers, whatever the data.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given, and each once")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime and no smaller than the number of shards")
    at = [_number(f"{s}#offset") % size for s in shards]
    skip = [_number(f"{s}#skip") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    free = size
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of md5 of its text, modulo the table size. A null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(size)


def lookup_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows ``slot``, ``shard``; made in the JVM from one literal."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("owner").cast("int")).alias("shard"))


def place(df: DataFrame, key_col: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row, without a shuffle of ``df``.

    The table is broadcast: it has ``size`` rows (a fixed parameter), not as many as the data. Equal
    keys share a shard, null keys share that of the empty text, repeated rows stay, and an empty
    table stays empty. Columns of ``df`` named ``slot`` or ``shard`` are replaced. Taking a shard
    away moves its own keys and only few of the others.
    """
    kept = df.drop("slot", "shard")
    table = F.broadcast(lookup_frame(df.sparkSession, shards, size))
    return kept.withColumn("slot", slot_of(F.col(key_col), size)).join(table, "slot").select(*kept.columns, "slot", "shard")
