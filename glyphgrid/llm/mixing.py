"""Mixing sources to target weights by Sainte-Laguë apportionment, in SQL functions alone.

1. Targets: the sources share a budget by weight; no target exceeds ``most`` times its
   source's size, and the excess is shared again until none does.
2. Seats: a seat is a block of so many words. Seats go one by one to the source with the
   highest quotient target / (2 k - 1), ties to the source that sorts first. The seats of
   a shard are the next so many of that one list, so that a shard's quotas are integers
   and those of all shards add up to the whole.
3. Blocks: a source's documents stand in an order seeded by a hash, and its stream of words
   is cut into blocks. A seeded stride through the blocks, coprime with their number, says
   which block each of the source's seats takes; when all have been taken it starts over.

Sizes are words between the six ASCII white-space characters. Null texts have size 0. A null
source is a source like others and sorts last. Rows of equal key and size are interchangeable.
An empty table gives no rows; a table of empty texts takes none. Other columns, whatever their names, are carried
along by ``texts_taken``. A very long text is words like others.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphgrid.llm.common import written

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 32
SHARDS = 16
#: Primes over any number of blocks of a source, hence coprime with it: the second from the first one's size on.
STRIDE, LONG_STRIDE = 2147483647, 2305843009213693951


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with their weight, place and target. A row for each source meets in one task."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last(F.col("source").cast("binary"))))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    rows = sources.withColumn("place", place).withColumn("weight", weigh).withColumn("ceiling", (F.col("source_size") * most).cast("double"))
    # Sources reach their ceiling in order of ceiling / weight: the first that doesn't sets the level for the rest.
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "place")
    left = F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("ceiling"))
    # Once one source is free, so are all after it, at the level of the first.
    shared = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("target", F.when(shared.isNull(), F.col("ceiling")).otherwise(shared * F.col("weight"))).select("source", "source_size", "place", "target")


def quotas(goals: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """(source, shard, seats) by highest quotients, shard by shard.

    After n seats every source s has round(target_s / L) of them for an L between
    total / (n + S) and total / (n - S), S being the number of sources. So all but a few
    seats of a source are certain; only the doubtful ones, about five for each source and
    shard, are ranked.
    """
    whole = Window.partitionBy()
    rows = goals.withColumn("total", F.sum("target").over(whole)).withColumn("s", F.count("*").over(whole))
    rows = rows.withColumn("n_all", F.round(F.col("total") / block_words)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = rows.withColumn("n", F.round(F.col("n_all") * (F.col("shard") + 1) / shards)).filter("total > 0")
    sure = F.greatest(F.lit(0.0), F.floor(F.col("target") * (F.col("n") - F.col("s")) / F.col("total")) - 1).cast("long")
    last = (F.ceil(F.col("target") * (F.col("n") + F.col("s")) / F.col("total")) + 1).cast("long")
    rows = rows.withColumn("sure", sure)
    doubt = rows.withColumn("seat", F.explode(F.sequence(F.col("sure") + 1, last))).withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1))
    by_shard = Window.partitionBy("shard")
    spare = F.col("n") - F.sum(F.when(F.col("seat") == F.col("sure") + 1, F.col("sure"))).over(by_shard)
    rank = F.row_number().over(by_shard.orderBy(F.desc("quotient"), "place"))
    won = doubt.withColumn("spare", spare).withColumn("rank", rank).groupBy("source", "place", "shard").agg((F.first("sure") + F.sum((F.col("rank") <= F.col("spare")).cast("long"))).alias("so_far"))
    return won.select("source", "place", "shard", (F.col("so_far") - F.coalesce(F.lag("so_far").over(Window.partitionBy("place").orderBy("shard")), F.lit(0))).alias("seats"))


def mix(docs: DataFrame, key: str = "doc_id", seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, keep: tuple = ()) -> DataFrame:
    """key, size, source_size, target and taken of each row (and the kept columns)."""
    rows = placed(docs, key, seed, weights, share, most, block_words, shards, keep)
    return rows.select(key, *docs.limit(0).select(*keep).columns, "size", "source_size", "target", taken(block_words).alias("taken"))


def placements(docs: DataFrame, key: str = "doc_id", seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """key, shard, first and words: a row for each time that a block's part of a document is taken, and for which shard.

    A source's seats are dealt out shard by shard, as many to each as its quota; a seat takes the block that the stride
    leads to, so the shard of a block's copy is that of its seat. ``first`` is the place of the part in the document, in words.
    """
    rows = placed(docs, key, seed, weights, share, most, block_words, shards, ()).filter("size > 0")
    first, last = F.floor(F.col("p0") / block_words), F.floor((F.col("p0") + F.col("size") - 1) / block_words)
    rows = rows.withColumn("block", F.explode(F.sequence(first, last))).withColumn("seat", seat_of(F.col("block")))
    times = F.col("rounds") + F.when(F.col("seat") < F.col("rest"), 1).otherwise(0)
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), times))).filter(F.col("round") < times)
    seat = F.col("round") * F.col("n_blocks") + F.col("seat")
    low, high = F.greatest("p0", F.col("block") * block_words), F.least(F.col("p0") + F.col("size"), (F.col("block") + 1) * block_words)
    return rows.select(key, F.size(F.filter("ends", lambda e: e <= seat)).alias("shard"), (low - F.col("p0")).alias("first"), (high - low).alias("words"))


def texts_taken(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """The rows that the mix takes, with the columns of docs: a source's words are as many as ``taken`` of its rows.

    Each row comes whole once for each full round through its source's blocks; the words of its
    blocks that are taken once more, with the white space after them, come as a row of their own.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = placed(docs, key, seed, weights, share, most, block_words, shards, (whole,), text).filter("size > 0")
    block = lambda i: F.floor((F.col("p0") + i) / block_words)
    body = F.col("_row").getField(text)
    words = F.filter(F.regexp_extract_all(body, F.lit(f"{WORD}{SPACE}"), F.lit(0)), lambda w, i: once_more(block(i)))
    rest = F.when(F.size(words) == F.col("size"), body).when(F.size(words) > 0, F.array_join(words, ""))
    texts = F.concat(F.array_repeat(body, F.col("rounds").cast("int")), F.array_compact(F.array(rest)))
    rows = rows.select("_row", F.explode(texts).alias("_taken"))
    return rows.select(*[(F.col("_taken") if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def placed(docs: DataFrame, key: str, seed: int, weights: tuple, share: float, most: int, block_words: int, shards: int, keep: tuple, text: str = "text") -> DataFrame:
    """key, the kept columns, size and p0, the words before it in its source, of each row, and its source's plan."""
    sizes = docs.select(key, F.col("source").cast("string").alias("source"), count_words(F.col(f"`{text}`").cast("string")).alias("size"), *keep)
    sizes, _ = written(sizes, "mix-sizes")
    plan = plan_sources(sizes, seed, weights, share, most, block_words, shards)
    # Stand the documents of a source in seeded order, and find the words before each: groups
    # of the leading digits of the hash are summed in parallel, then shifted.
    rows = sizes.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))).withColumn("part", F.substring("h", 1, 3))
    rows = rows.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sums = rows.groupBy("name", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("name", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.sum("size").over(Window.partitionBy("name", "part").orderBy("h", key, "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("own", own).join(shifts, ["name", "part"]).withColumn("p0", F.col("shift") + F.col("own")).join(plan, "name")


def plan_sources(sizes: DataFrame, seed: int, weights: tuple, share: float, most: int, block_words: int, shards: int) -> DataFrame:
    """A row for each source: target, seats and the stride through its blocks."""
    sources, _ = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    goals = targets(sources, weights, share, most)
    by_shard = F.transform(F.sort_array(F.collect_list(F.struct("shard", "seats"))), lambda q: q["seats"])
    seats = quotas(goals, block_words, shards).groupBy("place").agg(F.sum("seats").alias("seats"), by_shard.alias("by_shard"))
    plan = goals.join(seats, "place", "left").withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    plan = plan.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    plan = plan.withColumn("seats", F.least(F.coalesce(F.col("seats"), F.lit(0)), F.col("n_blocks") * most))
    some = F.greatest(F.col("n_blocks"), F.lit(1))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("blocks"), F.lit(str(seed)), "name")), 1, 7), 16, 10).cast("long")
    plan = plan.select(
        "name", "source_size", "target",
        some.alias("n_blocks"), F.floor(F.col("seats") / some).alias("rounds"), (F.col("seats") % some).alias("rest"),
        (F.when(some < STRIDE, F.lit(STRIDE).cast("long")).otherwise(F.lit(LONG_STRIDE)) % some).alias("stride"), (offset % some).alias("offset"),
        F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice(F.coalesce("by_shard", F.array_repeat(F.lit(0).cast("long"), shards)), F.lit(1), k), F.lit(0).cast("long"), lambda n, v: n + v)).alias("ends"),
    )
    return written(plan, "mix-plan")[0]


def seat_of(j: Column) -> Column:
    """The place of block j in its source's stride: the seat that takes it in the first round."""
    wide = F.col("stride").cast("decimal(19,0)") * j.cast("decimal(19,0)") % F.col("n_blocks").cast("decimal(19,0)")
    step = F.when(F.col("n_blocks") < STRIDE, F.try_multiply("stride", j) % F.col("n_blocks")).otherwise(wide.cast("long"))
    return (step + F.col("offset")) % F.col("n_blocks")


def once_more(j: Column) -> Column:
    """Whether block j of a source is taken once more than the full rounds take it."""
    return seat_of(j) < F.col("rest")


def taken(block_words: int) -> Column:
    """Words of a document, standing at p0 in its source, in the blocks that the seats take."""
    p0, p1 = F.col("p0"), F.col("p0") + F.col("size")

    def add(total: Column, j: Column) -> Column:
        times = F.col("rounds") + F.when(once_more(j), 1).otherwise(0)
        return total + times * (F.least(p1, (j + 1) * block_words) - F.greatest(p0, j * block_words))

    first, last = F.floor(p0 / block_words), F.floor((p1 - 1) / block_words)
    return F.when(F.col("size") > 0, F.aggregate(F.sequence(first, F.greatest(first, last)), F.lit(0).cast("long"), add)).otherwise(F.lit(0)).cast("long")
