"""Merging of histograms: costs of populations, gains of pairs, bins of like entropy, greedy merging, and the nearest cluster.

A histogram is an array of counts, the populations of several kinds of symbols one behind the other, each over ``size``
symbols. Its cost in bits is that of its populations:

- no symbol: the choice of three ways of storing;
- one symbol: that, and which one;
- more: that, how many (of the tiles or symbols, whichever are fewer), the stored counts (each in the bits of the largest, as
  a list with names or in full, whichever is shorter), and the symbols' own bits under their counts.

An image may have any number of tiles. Where it has many, its histograms are first put into bins by their costs,
at most ``parts ** dims`` of them, and those of a bin are summed by a groupBy; so the greedy merging, which looks at all
pairs of an image, gets a bounded number of rows for each image, and all images are merged at once.
"""

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphgrid.functions.fixed import let

WAYS = 3


def _bits(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))) + 1


def population_cost(counts: Column, size: int, n_tiles: Column) -> Column:
    """Bits of one population; see above."""
    used = lambda counts: F.filter(counts, lambda c: c > 0)
    total = lambda used: F.aggregate(used, F.lit(0).cast("long"), lambda s, c: s + c)
    named = lambda used: F.struct(used.alias("used"), F.size(used).cast("long").alias("n"), _bits(F.array_max(used)).alias("bits"), F.log2(total(used).cast("double")).alias("log"))

    def of(held):
        n, bits = held["n"], held["bits"]
        own = F.aggregate(held["used"], F.lit(0.0), lambda s, c: s + c * (held["log"] - F.log2(c.cast("double"))))
        stored = F.least(n * (bits + F.log2(F.lit(float(size)))), size * bits)
        many = F.log2(F.greatest(F.least(n_tiles, F.lit(size)) - 1, F.lit(1)).cast("double")) + stored + own
        return F.log2(F.lit(float(WAYS))) + F.when(n == 0, 0.0).when(n == 1, F.log2(F.lit(float(size)))).otherwise(many)

    # What is read more than once is computed once for a row, not for each symbol.
    return let(let(used(counts), named), of)


def populations(counts: Column, size: int, kinds: int) -> list:
    return [F.slice(counts, k * size + 1, size) for k in range(kinds)]


def histogram_cost(counts: Column, size: int, kinds: int, n_tiles: Column) -> Column:
    """Bits of all populations; nothing for an empty histogram."""
    of = lambda c: F.when(F.forall(c, lambda n: n == 0), 0.0).otherwise(sum((population_cost(p, size, n_tiles) for p in populations(c, size, kinds)), F.lit(0.0)))
    return let(counts, of)


def merged(first: Column, second: Column) -> Column:
    return F.zip_with(first, second, lambda p, q: p + q)


def costs(counts: np.ndarray, n_tiles) -> np.ndarray:
    """The same of many histograms at once: counts is (..., kinds, size), n_tiles one number or (...)."""
    size, c = counts.shape[-1], counts.astype(np.float64)
    n, total, most = (c > 0).sum(-1), c.sum(-1), c.max(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(c > 0, c * (np.log2(total)[..., None] - np.log2(c)), 0.0).sum(-1)
        bits = np.floor(np.log2(most)) + 1
    stored = np.minimum(n * (bits + np.log2(size)), size * bits)
    many = np.log2(np.maximum(np.minimum(np.asarray(n_tiles)[..., None], size) - 1, 1)) + stored + own
    each = np.log2(WAYS) + np.where(n == 0, 0.0, np.where(n == 1, np.log2(size), many))
    return np.where((total == 0).all(-1), 0.0, each.sum(-1))


def with_costs(rows: DataFrame, size: int, kinds: int, **histograms: Column) -> DataFrame:
    """The rows (with n_tiles), without their arrays, and the cost of each of these histograms; by numpy, for a batch at once."""
    kept = [f for f in rows.schema.fields if f.dataType.typeName() != "array"]
    k, names = len(kept), [*(f.name for f in kept), *histograms]

    def run(batches):
        for batch in batches:
            n_tiles = batch.column(k).to_numpy()
            found = [costs(c.flatten().to_numpy().reshape(len(c), kinds, size), n_tiles) for c in batch.columns[k + 1 :]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *[pa.array(f, pa.float64()) for f in found]], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` double" for n in histograms])
    return rows.select(*[f.name for f in kept], F.col("n_tiles").cast("long").alias("_n"), *[c.alias(f"_{n}") for n, c in histograms.items()]).mapInArrow(run, schema)


def greedy(counts: np.ndarray, n_tiles: int) -> tuple:
    """(the cluster of each histogram, the merges): always the pair that saves most, the first of equal ones, as long as any saves.

    The queue keeps pairs of histograms that have been merged since; they are stale and skipped.
    """
    own, live = costs(counts, n_tiles), list(range(len(counts)))
    counts, version, into, steps, queue = counts.copy(), [0] * len(counts), list(range(len(counts))), [], []

    def gains(i: int, others: list):
        if others:
            gain = costs(counts[i] + counts[others], n_tiles) - own[i] - own[others]
            for j, g in zip(others, gain.tolist()):
                if g < 0:
                    a, b = min(i, j), max(i, j)
                    yield round(g, 9), a, b, version[a], version[b]

    for i in live:
        queue += gains(i, [j for j in live if j > i])
    heapify(queue)
    while queue:
        gain, i, j, vi, vj = heappop(queue)
        if (version[i], version[j]) != (vi, vj):
            continue
        counts[i] += counts[j]
        version[i], version[j] = version[i] + 1, -1
        own[i] = costs(counts[i], n_tiles)
        live.remove(j)
        into[j] = i
        steps.append((i, j, gain))
        for entry in gains(i, [k for k in live if k != i]):
            heappush(queue, entry)
    for k in range(len(into)):  # a cluster's number is that of its first histogram, so it comes before its others
        into[k] = into[into[k]]
    return into, steps


def merge_greedily(histograms: DataFrame, size: int, key: str = "image_id") -> DataFrame:
    """(key, tile, cluster, step, gain): what each histogram is merged into, and of merged ones when and by what gain.

    histograms: key, tile, counts, n_tiles; a bounded number for each key.
    """

    def run(table):
        table = table.sort_by("tile")
        tiles = table.column("tile").to_numpy()
        counts = table.column("counts").combine_chunks().flatten().to_numpy().reshape(len(tiles), -1, size).astype(np.int64)
        into, steps = greedy(counts, table.column("n_tiles")[0].as_py())
        step, gain = [None] * len(tiles), [None] * len(tiles)
        for k, (_, j, g) in enumerate(steps):
            step[j], gain[j] = k, g
        return pa.table({key: table.column(key), "tile": table.column("tile"), "cluster": pa.array(tiles[into]), "step": pa.array(step, pa.int64()), "gain": pa.array(gain, pa.float64())})

    kind = histograms.schema[key].dataType.simpleString()
    return histograms.select(key, F.col("tile").cast("long").alias("tile"), "counts", F.col("n_tiles").cast("long").alias("n_tiles")).groupBy(key).applyInArrow(run, f"{key} {kind}, tile long, cluster long, step long, gain double")


def entropy_bins(histograms: DataFrame, size: int, kinds: int, parts: int = 4, dims: int = 3, key: str = "image_id") -> DataFrame:
    """With a bin: the costs of the kinds whose costs spread most over the image's histograms, each in equal parts.

    Kinds of equal spread go by descending place.
    """
    rows = histograms.withColumn("_costs", F.array(*[population_cost(p, size, F.col("n_tiles")) for p in populations(F.col("counts"), size, kinds)]))
    low, high = (F.array(*[f(F.col("_costs")[k]) for k in range(kinds)]) for f in (F.min, F.max))
    rows = rows.join(rows.groupBy(key).agg(low.alias("_low"), high.alias("_high")), key)
    spread = F.array(*[F.struct((F.round(F.col("_high")[k] - F.col("_low")[k], 9)).alias("spread"), F.lit(k).alias("kind")) for k in range(kinds)])
    rows = rows.withColumn("_widest", F.slice(F.sort_array(spread, asc=False), 1, dims))
    part = lambda s: F.least(F.floor(F.round(parts * (F.get("_costs", s["kind"]) - F.get("_low", s["kind"])) / s["spread"], 9)), F.lit(parts - 1))
    of = F.aggregate("_widest", F.lit(0).cast("long"), lambda b, s: F.when(s["spread"] == 0, b).otherwise(b * parts + part(s)))
    return rows.withColumn("bin", of).drop("_costs", "_low", "_high", "_widest")


def merge_bins(binned: DataFrame, length: int, key: str = "image_id") -> DataFrame:
    """(key, tile, counts, n_tiles, tiles): the histograms of each bin summed; tile is the least of them."""
    sums = F.array(*[F.sum(F.col("counts")[k]) for k in range(length)])
    return binned.groupBy(key, "bin").agg(F.min("tile").alias("tile"), sums.alias("counts"), F.first("n_tiles").alias("n_tiles"), F.sort_array(F.collect_list("tile")).alias("tiles")).drop("bin")


def nearest(histograms: DataFrame, clusters: DataFrame, size: int, kinds: int, key: str = "image_id") -> DataFrame:
    """(key, tile, cluster): where each histogram adds the fewest bits; of equal ones the least cluster.

    clusters: key, cluster, counts, a bounded number for each key.
    """
    both = histograms.join(clusters.select(key, "cluster", F.col("counts").alias("own")), key)
    both = with_costs(both, size, kinds, both_cost=merged(F.col("counts"), F.col("own")), own_cost=F.col("own"))
    best = F.min(F.struct(F.round(F.col("both_cost") - F.col("own_cost"), 9).alias("bits"), "cluster"))
    return both.groupBy(key, "tile").agg(best.alias("b")).select(key, "tile", F.col("b.cluster").alias("cluster"))


def histogram_image(histograms: DataFrame, size: int, kinds: int, parts: int = 4, dims: int = 1, key: str = "image_id") -> DataFrame:
    """(key, tile, label): bins where an image has more than twice as many histograms as bins, then greedy merging, then each
    histogram to its nearest cluster; labels count up in the order of tiles."""
    many = F.col("n_tiles") > 2 * parts**dims
    binned = merge_bins(entropy_bins(histograms.filter(many), size, kinds, parts, dims, key), size * kinds, key)
    start = binned.drop("tiles").unionByName(histograms.filter(~many).select(key, "tile", "counts", "n_tiles"))
    grown = merge_greedily(start, size, key).join(start, [key, "tile"])
    sums = F.array(*[F.sum(F.col("counts")[k]) for k in range(size * kinds)])
    clusters = grown.groupBy(key, "cluster").agg(sums.alias("counts"))
    found = nearest(histograms, clusters, size, kinds, key)
    names = found.groupBy(key, "cluster").agg(F.min("tile").alias("first"))  # a bounded number for each key
    names = names.select(key, "cluster", (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("long").alias("label"))
    return found.join(names, [key, "cluster"]).select(key, "tile", "label")
