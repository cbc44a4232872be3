"""Document fingerprints by one-permutation MinHash, in SQL functions alone.

1. Each shingle of ``WORDS`` words is hashed once. The leading bits choose one of ``BINS`` bins,
   and each bin keeps its least hash.
2. An empty bin copies the filled bin that a hash of (empty bin, filled bin) puts first. That is
   optimal densification, each empty bin drawing its donors independently of the others, with
   the repeats of the draw left out.
3. The low ``BITS`` bits of every bin are packed as hexadecimal digits. Two fingerprints match in
   a share m of the bins; chance makes 2 ** -BITS of the others match, which is taken off.

A shorter text is one shingle. Null texts and texts without words have the empty fingerprint,
which is like itself (1) and unlike others (0). Rows are independent in ``fingerprint``; in
``edited_pairs`` null keys come first and rows of equal key stand in the order of a hash of their texts, the same for the
edited text and the next document. Very long texts are arrays of hashes like others. Other columns aren't
read. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphgrid.llm.common import maybe_in, written

WORDS, BINS, BITS = 5, 128, 8
#: Rows of a run on average, put in order in one task; runs of a stretch.
RUN, STRETCH = 1024, 4096
#: Rows of a run that is cut again, how many are at once, and how often.
MOST, SPLITS, ROUNDS = 8 * RUN, 10_000, 8


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(found, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        size = F.size(h)
        many = F.transform(F.sequence(F.lit(0), size - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(size >= words, many).when(size > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, windows)


def fingerprint(text: Column, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> Column:
    shift = 64 - (bins.bit_length() - 1)
    digits = bits // 4

    def bin_of(h: Column) -> Column:
        return F.shiftrightunsigned(h, shift).cast("int")

    # In sorted order the hashes of a bin stand together, the least first.
    def minima(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1))))

    def dense(kept: Column) -> Column:
        def filled(owners: Column) -> Column:
            def of(j: Column) -> Column:
                at = F.array_position(owners, j).cast("int")
                donor = F.array_min(F.transform(kept, lambda x: F.struct(F.xxhash64(j, bin_of(x)).alias("h"), x.alias("x"))))["x"]
                value = F.when(at > 0, F.get(kept, at - 1)).otherwise(donor)
                return F.lpad(F.lower(F.hex(value.bitwiseAND(F.lit((1 << bits) - 1)))), digits, "0")

            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), of), "")

        return let(F.transform(kept, bin_of), filled)

    kept = let(F.sort_array(shingle_hashes(text, words)), minima)
    return let(kept, lambda k: F.when(F.size(k) > 0, dense(k)).otherwise(F.lit("")))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    digits = bits // 4
    same = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0), lambda n, j: n + (F.substring(a, j * digits + 1, F.lit(digits)) == F.substring(b, j * digits + 1, F.lit(digits))).cast("int"))
    chance = 1.0 / (1 << bits)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance)))


def in_runs(rows: DataFrame) -> DataFrame:
    """rows (id, order, ...) with ``run``, an array that names a stretch of neighbours by id and order: some RUN rows, few of them far more.

    The ids' range is cut evenly. Where ids lie unevenly, the runs of more than MOST rows, the largest SPLITS of them, are cut again, each
    over its own range, until none is left; a run of one id (or of null) is cut by the order, a hash. What is looked at are
    counts of ids, and what is sent to the tasks are SPLITS rows of a few numbers at most.
    """
    spark = rows.sparkSession
    bounds = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).first()
    low, high = (0, 0) if bounds.low is None else (bounds.low, bounds.high)
    width = max(1.0, (high - low + 1) * RUN / max(bounds.n, 1))
    rows = rows.withColumn("run", F.array(F.coalesce(F.floor((F.col("id").cast("double") - F.lit(float(low))) / F.lit(width)), F.lit(-1))))
    by_order: set = set()
    for _ in range(ROUNDS):
        large = rows.groupBy("run").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).filter(F.col("n") > MOST).orderBy(F.desc("n"), "run").limit(SPLITS).collect()
        cuts = []
        for r in large:
            if tuple(r.run[:-1]) in by_order:
                continue
            hashed = r.low is None or r.low == r.high
            cuts.append((r.run, hashed, -(2.0**63) if hashed else float(r.low), max(1.0, (2.0**64 if hashed else float(r.high - r.low + 1)) * RUN / r.n)))
            if hashed:
                by_order.add(tuple(r.run))
        if not cuts:
            break
        table = spark.createDataFrame(cuts, "run array<bigint>, hashed boolean, _low double, _width double")
        part = F.floor((F.when(F.col("hashed"), F.col("order")).otherwise(F.col("id")).cast("double") - F.col("_low")) / F.col("_width"))
        rows = rows.join(F.broadcast(table), "run", "left").withColumn("run", F.when(F.col("hashed").isNull(), F.col("run")).otherwise(F.concat("run", F.array(part)))).drop("hashed", "_low", "_width")
    return rows


def with_next(rows: DataFrame) -> DataFrame:
    """rows (id, order, body), with the next row's body as ``follow``; by ascending id and order, the first after the last.

    Runs are put in order in parallel. Only the last row of a run needs another run's first row; which run that is, is found
    among the runs of one stretch, and among the first runs of all stretches.
    """
    rows = in_runs(rows)
    firsts = rows.groupBy("run").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "order")).alias("f")).select("run", "f.*")
    # Numbers that go up with the runs: parts of the range, and places in them.
    firsts, _ = written(firsts.repartitionByRange("known", "id", "order").sortWithinPartitions("known", "id", "order").select("run", "id", "order", F.monotonically_increasing_id().alias("no")), "firsts")
    both = [F.col("id"), F.col("order")]
    heads = maybe_in(rows.select("id", "order", "body"), both, firsts, both).alias("r").join(firsts.alias("f"), F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.order") == F.col("f.order"))).groupBy("no", "run").agg(F.first("body").alias("head"))
    heads, _ = written(heads, "heads")
    runs = heads.select("run", "no", F.floor(F.col("no") / STRETCH).alias("stretch"))
    ends = runs.groupBy("stretch").agg(F.min("no").alias("no"))
    # A row for each STRETCH runs of some RUN rows: all that meets in one task.
    ends = ends.select("stretch", F.lead("no").over(Window.orderBy("stretch")).alias("after"), F.first("no").over(Window.orderBy("stretch")).alias("least"))
    runs = runs.withColumn("to", F.lead("no").over(Window.partitionBy("stretch").orderBy("no"))).join(ends, "stretch")
    heads = runs.select("run", F.coalesce("to", "after", "least").alias("to")).join(heads.select(F.col("no").alias("to"), "head"), "to").select("run", "head")
    side = rows.withColumn("follow", F.lead("body").over(Window.partitionBy("run").orderBy("id", "order")))
    return side.join(heads, "run").select("id", "order", "body", F.when(F.col("follow").isNull(), F.col("head")).otherwise(F.col("follow")).alias("follow"))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = with_next(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(body).alias("order"), body.alias("body")))
    size = F.char_length("body")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), size - cut), F.substring("follow", F.lit(1), cut))
    made = F.struct(size.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("body")).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"))
    prints, _ = written(rows.select("id", "order", made.alias("body")), "prints")
    own = F.col("body.fingerprint")
    return with_next(prints).select(
        F.col("id").alias(key), "body.n_chars", "body.edited_sha256", own.alias("fingerprint"), "body.edited_fingerprint",
        likeness(own, F.col("body.edited_fingerprint")).alias("near_edited"),
        likeness(own, F.col("follow.fingerprint")).alias("near_next"),
    )
