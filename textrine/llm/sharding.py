"""Sharding by a permutation-filled lookup table.

A table of a prime number of slots is filled by turns: each shard walks its own
permutation of the slots (offset + step * i, both from the shard's name) and
claims the first free one. Placement is the hash of the key modulo the number
of slots, then one lookup in the table, which is broadcast: its size is
``slots`` rows, whatever the data's. When a shard leaves, few other slots move.

Everything is DataFrame functions; the table is made of shard names alone.
Keys that hold a large part of the rows can be spread over several slots by
``spread``: a hot key gets as many sub-keys as its share needs, from counts
that are aggregated before they are shuffled.

Defined results: a null key is placed as the empty string; equal keys share a
shard (without ``spread``); columns named like the results are overwritten;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, at least a hundred times the number of shards, so that shards differ by 1 % at most.
SLOTS = 65_537
SHARDS = 256
#: Groups over which the rows of one hot key are dealt where ``spread`` joins its count.
SALTS = 64


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The table: for each slot the index of the shard that claimed it."""
    if not names or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("a table needs shards and a prime number of slots")
    number = lambda tag, name: int(hashlib.md5(f"{tag}:{name}".encode()).hexdigest()[:15], 16)
    place = [number("offset", x) % slots for x in names]
    step = [number("step", x) % (slots - 1) + 1 for x in names]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(names)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            free -= 1
            if not free:
                return table


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: the filled table as a relation made from one literal."""
    text = ",".join(map(str, fill(names, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key, slots: int = SLOTS) -> F.Column:
    """The first 60 bits of the key's md5, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with slot and shard; one broadcast lookup, no shuffle."""
    names = names or shard_names()
    found = lookup_table(df.sparkSession, names, slots)
    keyed = df.drop("shard").withColumn("slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(found), "slot")


def spread(df: DataFrame, key: str, rows_per_key: int, salt_from: str, out: str = "placement_key", salts: int = SALTS) -> DataFrame:
    """``df`` with a key that splits each hot value of ``key`` into sub-keys.

    A value with n rows gets ceil(n / rows_per_key) sub-keys; rows are dealt by
    a hash of ``salt_from``. Only hot values are joined back; they are at most
    (rows / rows_per_key) in number, and each stands ``salts`` times in the join,
    so that its rows are dealt over as many groups. A column called ``out`` is
    overwritten, all others may have any name.
    """
    hot = df.groupBy(F.col(f"`{key}`").alias("hot")).count().where(F.col("count") > rows_per_key)
    hot = hot.select("hot", F.ceil(F.col("count") / rows_per_key).alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("hot_salt"))
    deal = F.xxhash64(f"`{salt_from}`")
    # the row goes along as one struct, so that its columns may have any names
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    rows = df.select(row.alias("row"), F.col(f"`{key}`").alias("key"), deal.alias("deal"), F.pmod(F.xxhash64(deal), F.lit(salts)).cast("int").alias("salt"))
    joined = rows.join(hot, F.col("key").eqNullSafe(F.col("hot")) & (F.col("salt") == F.col("hot_salt")), "left")
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    made = F.when(F.col("parts").isNull(), name).otherwise(F.concat_ws("#", name, F.pmod("deal", "parts")))
    return joined.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns if c.lower() != out.lower()), made.alias(out))


def write_shards(df: DataFrame, key: str, path: str, names: list[str] | None = None, files_per_shard: int = 1, deal_by: list[str] | None = None) -> None:
    """Parquet under ``path/shard=k``; a shard's rows are dealt over ``files_per_shard`` tasks.

    They are dealt by a hash of ``deal_by`` (all columns that can be hashed, if
    not given), so that one hot key's rows share a shard but not a task. Only rows
    that are equal in all of these stay together: name a column that tells copies apart.
    """
    placed = place(df, key, names)
    deal_by = deal_by or [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and f.name.lower() not in ("slot", "shard")]
    file = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in deal_by)), F.lit(files_per_shard))
    placed.repartition("shard", file).drop("slot").write.mode("overwrite").partitionBy("shard").parquet(path)
