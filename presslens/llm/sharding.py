"""Sharding by a permutation-filled lookup table (operator 3). DataFrame functions alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.llm.common import given_back, renamed, set_aside

#: Hexadecimal digits of an MD5 that fit a signed 64-bit number.
DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def lookup_table(shards: list[str], size: int = 8191) -> list[int]:
    """For each slot of a table of prime size, the position of the shard that claimed it.

    Each shard prefers the slots offset, offset + skip, offset + 2 skip, ... modulo size, both numbers drawn from its name: as size is prime, that is a permutation of all slots.
    The shards take turns, each claiming the first slot of its preference that is still free, until none is. Shares differ by one slot at most, and when a shard comes or goes few slots change hands.
    """
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is not a prime")
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("needs 1 to size shards with different names")
    place = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % size
            table[place[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot(key: Column, size: int) -> Column:
    """Where a key falls in the table: its MD5 modulo size. A null key counts as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long"), F.lit(size)).cast("int")


def shard(docs: DataFrame, shards: list[str] | int = 64, size: int = 8191, key: str = "doc_id", shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """docs with the columns slot and shard (the shard's position). Every row is kept; columns of docs that have these names are replaced, any other name may be used.

    The table has ``size`` entries whatever the number of rows; it is broadcast, and each row looks its slot up: no shuffle, no key can be hot in a task.
    Rows with equal keys, repeated rows included, share a shard; a null key goes where the empty string goes. An empty table stays empty.
    """
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else shards
    text = ",".join(map(str, lookup_table(names, size)))
    table = docs.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "to"))
    rows, own = set_aside(docs, slot_col, shard_col)
    found = rows.withColumn("slot", slot(F.col(renamed(docs, key)), size)).join(F.broadcast(table), "slot")
    return found.select(*given_back(own), F.col("slot").alias(slot_col), F.col("to").cast("int").alias(shard_col))


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1, shard_col: str = "shard", key: str = "doc_id") -> None:
    """One folder for each shard at any path that Spark can write. With several files per shard its rows are dealt by their key; rows with equal or null keys share a file. An empty table writes no folder."""
    salt = F.pmod(F.xxhash64(key), F.lit(files_per_shard))
    sharded.repartition(F.col(shard_col), salt).write.partitionBy(shard_col).mode("errorifexists").parquet(path)


def table_sql(shards: int = 64, size: int = 8191, docs: str = "documents", key: str = "doc_id") -> str:
    """The placement of docs in DuckDB's SQL, with the table as a list."""
    table = ",".join(map(str, lookup_table([f"shard-{i:05d}" for i in range(shards)], size)))
    return f"""
        WITH slots AS (SELECT {key}, CAST(CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, {DIGITS}) AS BIGINT) % {size} AS INTEGER) AS slot FROM {docs}),
        lookup AS (SELECT [{table}] AS t)
        SELECT {key}, slot, CAST(t[slot + 1] AS INTEGER) AS shard FROM slots, lookup"""
