"""Queries on the merging of histograms of image tiles, with DuckDB SQL where SQL states them."""

from pyspark.sql import functions as F

from glyphgrid.functions.fixed import idiv, let
from glyphgrid.operators import grid, merging
from glyphgrid.plans.fixtures import images
from glyphgrid.plans.query import Query

QUERIES: dict = {}
#: Pixels of a tile's side, symbols of a channel, channels.
SIDE, SIZE, KINDS = 4, 16, 4


def query(name: str, build, sql: str, needs: str, ints: str = "", **kinds) -> None:
    QUERIES[name] = Query(build, sql, tuple(needs.split()), ints, **kinds)


def tile_histograms(s, d):
    """image_id, tile, tiles_across, n_tiles and the counts of the channels' upper four bits."""
    sizes = images(s, d).select("image_id", idiv(F.col("w") + SIDE - 1, SIDE).alias("tiles_across"), idiv(F.col("h") + SIDE - 1, SIDE).alias("tiles_down"))
    rows = grid.exploded(images(s, d)).join(sizes, "image_id")
    tile = idiv(F.col("y"), SIDE) * F.col("tiles_across") + idiv(F.col("x"), SIDE)
    place = F.explode(F.array(*[k * SIZE + F.shiftright(c, 4) for k, c in enumerate(grid.CHANNELS)]))
    rows = rows.select("image_id", tile.cast("long").alias("tile"), "tiles_across", (F.col("tiles_across") * F.col("tiles_down")).cast("long").alias("n_tiles"), place.alias("place"))
    # The map is made once for a tile, not again for each place.
    in_full = lambda m: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SIZE * KINDS - 1).cast("long")), lambda i: F.coalesce(F.element_at(m, i), F.lit(0)))
    counted = rows.groupBy("image_id", "tile", "tiles_across", "n_tiles", "place").count()
    found = counted.groupBy("image_id", "tile", "tiles_across", "n_tiles").agg(F.map_from_entries(F.collect_list(F.struct("place", "count"))).alias("m"))
    return found.select("image_id", "tile", "tiles_across", "n_tiles", let(F.col("m"), in_full).alias("counts"))


#: Of each tile, channel and symbol that occurs, the count c.
_COUNTS = f"SELECT image_id, (w + {SIDE - 1}) // {SIDE} AS tiles_across, ((w + {SIDE - 1}) // {SIDE}) * ((h + {SIDE - 1}) // {SIDE}) AS n_tiles, (y // {SIDE}) * ((w + {SIDE - 1}) // {SIDE}) + x // {SIDE} AS tile, k, v // 16 AS sym, count(*) AS c FROM (SELECT image_id, w, h, y, x, unnest([a, r, g, b]) AS v, unnest([0, 1, 2, 3]) AS k FROM img) GROUP BY ALL"


def _cost_sql(source: str, keys: str) -> str:
    """source: keys, n_tiles, k, sym and c, once for each symbol that occurs. Gives keys, k, nonzeros and cost."""
    sums = f"SELECT {keys}, n_tiles, k, count(*) AS n, sum(c) AS total, max(c) AS most, sum(c * log2(c)) AS logs FROM ({source}) GROUP BY ALL"
    bits = "(floor(log2(most)) + 1)"
    many = f"log2(greatest(least(n_tiles, {SIZE}) - 1, 1)) + least(n * ({bits} + 4), {SIZE} * {bits}) + total * log2(total) - logs"
    return f"SELECT {keys}, k, n AS nonzeros, log2(3) + CASE WHEN n = 1 THEN 4 ELSE {many} END AS cost FROM ({sums})"


def _pairs(s, d):
    """Each tile with its right and its lower neighbour."""
    own = tile_histograms(s, d)
    to = F.explode(F.array(F.when((F.col("tile") + 1) % F.col("tiles_across") != 0, F.col("tile") + 1), F.col("tile") + F.col("tiles_across")))
    return own.select("image_id", "tile", "n_tiles", "counts", to.alias("tile2")).join(own.select("image_id", F.col("tile").alias("tile2"), F.col("counts").alias("counts2")), ["image_id", "tile2"])


_PAIRS = "p AS (SELECT DISTINCT t.image_id, t.n_tiles, t.tile, u.tile AS tile2 FROM tc t JOIN tc u ON u.image_id = t.image_id AND (u.tile = t.tile + 1 AND u.tile % t.tiles_across <> 0 OR u.tile = t.tile + t.tiles_across))"
_BOTH = "SELECT p.image_id, p.n_tiles, p.tile, p.tile2, k, sym, sum(c) AS c FROM p JOIN tc ON tc.image_id = p.image_id AND (tc.tile = p.tile OR tc.tile = p.tile2) GROUP BY ALL"


def _cost(counts: str):
    return merging.histogram_cost(F.col(counts), SIZE, KINDS, F.col("n_tiles"))


def _population(s, d):
    rows = tile_histograms(s, d).select("image_id", "tile", "n_tiles", F.posexplode(F.array(*merging.populations(F.col("counts"), SIZE, KINDS))).alias("k", "c"))
    return rows.select("image_id", "tile", "k", F.size(F.filter("c", lambda v: v > 0)).alias("nonzeros"), merging.population_cost(F.col("c"), SIZE, F.col("n_tiles")).alias("cost"))


query("o8_24_population_cost", _population, f"WITH tc AS ({_COUNTS}) " + _cost_sql("SELECT * FROM tc", "image_id, tile"), "img", "image_id tile k nonzeros", doubles="cost")
query("o8_25_merged_cost", lambda s, d: _pairs(s, d).select("image_id", "tile", "tile2", merging.histogram_cost(merging.merged(F.col("counts"), F.col("counts2")), SIZE, KINDS, F.col("n_tiles")).alias("cost")), f"WITH tc AS ({_COUNTS}), {_PAIRS} SELECT image_id, tile, tile2, sum(cost) AS cost FROM ({_cost_sql(_BOTH, 'image_id, tile, tile2')}) GROUP BY ALL", "img", "image_id tile tile2", doubles="cost")


def _gain(s, d):
    costs = {"both": merging.merged(F.col("counts"), F.col("counts2")), "first": F.col("counts"), "second": F.col("counts2")}
    rows = merging.with_costs(_pairs(s, d), SIZE, KINDS, **costs).withColumn("gain", F.col("both") - F.col("first") - F.col("second"))
    return rows.filter("round(gain, 9) < 0").select("image_id", "tile", "tile2", "gain")


_OWN = f"own AS (SELECT image_id, tile, sum(cost) AS cost FROM ({_cost_sql('SELECT * FROM tc', 'image_id, tile')}) GROUP BY ALL)"
query("o8_26_merge_gain", _gain, f"WITH tc AS ({_COUNTS}), {_PAIRS}, {_OWN} SELECT m.image_id, m.tile, m.tile2, m.cost - o.cost - q.cost AS gain FROM (SELECT image_id, tile, tile2, sum(cost) AS cost FROM ({_cost_sql(_BOTH, 'image_id, tile, tile2')}) GROUP BY ALL) m JOIN own o ON o.image_id = m.image_id AND o.tile = m.tile JOIN own q ON q.image_id = m.image_id AND q.tile = m.tile2 WHERE round(m.cost - o.cost - q.cost, 9) < 0", "img", "image_id tile tile2", doubles="gain")
query("o8_27_histogram_cost", lambda s, d: tile_histograms(s, d).select("image_id", "tile", _cost("counts").alias("cost")), f"WITH tc AS ({_COUNTS}), {_OWN} SELECT * FROM own", "img", "image_id tile", doubles="cost")
query("o8_28_greedy_clusters", lambda s, d: merging.merge_greedily(tile_histograms(s, d), SIZE), "", "", "image_id tile cluster")
query("o8_31_merge_order", lambda s, d: merging.merge_greedily(tile_histograms(s, d), SIZE).filter("step is not null"), "", "", "image_id step tile", doubles="gain")


def _bins(s, d):
    binned = merging.merge_bins(merging.entropy_bins(tile_histograms(s, d), SIZE, KINDS, 4, 1), SIZE * KINDS)
    return binned.select("image_id", "tile", F.size("tiles").alias("members"), F.aggregate("tiles", F.lit(0).cast("long"), lambda t, v: t + v).alias("sum_of_tiles"), F.aggregate(F.transform("counts", lambda c, i: c * (i + 1)), F.lit(0).cast("long"), lambda t, v: t + v).alias("weighed"))


query("o8_30_entropy_bins", _bins, f"WITH tc AS ({_COUNTS}), cost AS ({_cost_sql('SELECT * FROM tc', 'image_id, tile')}), lims AS (SELECT image_id, k, min(cost) AS low, round(max(cost) - min(cost), 9) AS spread FROM cost GROUP BY ALL), widest AS (SELECT image_id, arg_max(k, spread * 1e6 + k * 1e-6) AS k FROM lims GROUP BY image_id), bin AS (SELECT cost.image_id, tile, CASE WHEN spread = 0 THEN 0 ELSE least(floor(round(4 * (cost - low) / spread, 9)), 3) END AS bin FROM cost JOIN widest USING (image_id, k) JOIN lims USING (image_id, k)) SELECT t.image_id, t.bin, min(t.tile) AS tile, count(DISTINCT t.tile) AS members, sum(DISTINCT t.tile) AS sum_of_tiles, sum(c * (k * {SIZE} + sym + 1)) AS weighed FROM bin t JOIN tc ON tc.image_id = t.image_id AND tc.tile = t.tile GROUP BY t.image_id, t.bin", "img", "image_id tile members sum_of_tiles weighed")
query("o8_30_histogram_image", lambda s, d: merging.histogram_image(tile_histograms(s, d), SIZE, KINDS), "", "", "image_id tile label")


def _nearest(s, d):
    own = tile_histograms(s, d)
    return merging.nearest(own, own.filter("tile % 3 = 0").select("image_id", F.col("tile").alias("cluster"), "counts"), SIZE, KINDS)


query("o6_8_nearest_cluster", _nearest, f"WITH tc AS ({_COUNTS}), {_OWN}, p AS (SELECT DISTINCT t.image_id, t.n_tiles, t.tile, u.tile AS tile2 FROM tc t JOIN tc u ON u.image_id = t.image_id AND u.tile % 3 = 0), added AS (SELECT p.image_id, p.n_tiles, p.tile, p.tile2, k, sym, sum(c * CASE WHEN p.tile = p.tile2 THEN 2 ELSE 1 END) AS c FROM p JOIN tc ON tc.image_id = p.image_id AND (tc.tile = p.tile OR tc.tile = p.tile2) GROUP BY ALL), total AS (SELECT image_id, tile, tile2, sum(cost) AS cost FROM ({_cost_sql('SELECT * FROM added', 'image_id, tile, tile2')}) GROUP BY ALL), ranked AS (SELECT m.image_id, m.tile, m.tile2 AS cluster, row_number() OVER (PARTITION BY m.image_id, m.tile ORDER BY round(m.cost - o.cost, 9), m.tile2) AS rank FROM total m JOIN own o ON o.image_id = m.image_id AND o.tile = m.tile2) SELECT image_id, tile, cluster FROM ranked WHERE rank = 1", "img", "image_id tile cluster")
