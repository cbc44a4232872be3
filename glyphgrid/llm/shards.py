"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL functions alone.

The shard of a key depends on the key and the number of shards only: no ring, no table.
With one shard more, a key stays where it is or moves to the new shard.

The generator of the paper multiplies 64-bit unsigned numbers; here DECIMAL(38, 0) holds
the product exactly, so that overflow checks of ANSI mode never strike.

A negative key counts as its unsigned 64-bit value; a null key as -1. Null texts have
size 1 and crc32 0. Equal rows get slots of their own. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Groups within a shard, by a hash of the key, that are numbered side by side.
SLOT_GROUPS = 4096


def jump_sequence(key: Column, shards: int) -> Column:
    """struct(shard, grown): where the key goes among so many shards, and with one more.

    A jump goes forward by one shard at least, so shards + 1 steps always suffice.
    """
    two_64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    unsigned = F.coalesce(key.cast("long"), F.lit(-1)).cast("decimal(38,0)")
    unsigned = F.when(unsigned < 0, unsigned + two_64).otherwise(unsigned).cast("decimal(38,0)")

    def step(s: Column, _: Column) -> Column:
        drawn = ((s["k"] * F.lit("2862933555777941757").cast("decimal(19,0)") + 1) % two_64).cast("decimal(38,0)")
        return F.when(
            s["j"] <= shards,
            F.struct(drawn.alias("k"), F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"), s["j"].alias("grown"), F.lit(None).cast("long").alias("j")),
        ).otherwise(s)

    def jump(s: Column) -> Column:
        high = F.floor(s["k"] / F.lit(8589934592).cast("decimal(11,0)")).cast("double")
        ahead = F.floor((s["grown"] + 1) * (F.lit(2147483648.0) / (high + 1.0))).cast("long")
        return F.when(s["j"].isNull(), F.struct(s["k"].alias("k"), s["shard"].alias("shard"), s["grown"].alias("grown"), ahead.alias("j"))).otherwise(s)

    start = F.struct(unsigned.alias("k"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("j"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, lambda s, i: jump(step(s, i)))
    return F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))


def shard_by_key(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of each row.

    The texts are read once and never shuffled. Slots count the rows of a shard from 0:
    groups of a hash of the key are numbered in parallel, then shifted by the rows of the
    groups before; a shard's rows never meet in one task.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), jump_sequence(F.col(key), shards).alias("jump"))
    rows = rows.select(key, "size", "text_crc32", F.col("jump.shard").alias("shard"), F.col("jump.grown").alias("grown_shard"), F.pmod(F.xxhash64(key), F.lit(SLOT_GROUPS)).alias("part"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.col(key), "text_crc32", "size"))
    placed = rows.withColumn("own", own).join(shifts, ["shard", "part"])
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), "grown_shard")
