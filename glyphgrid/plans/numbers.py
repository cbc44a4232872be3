"""Queries on metrics, histograms, moments, blocks, frames and sequences, with DuckDB SQL where SQL states them."""

from pyspark.sql import Window, functions as F

from glyphgrid.functions import fixed
from glyphgrid.functions.fixed import idiv
from glyphgrid.operators import color, frames as fr, grid, histo, kernels, metrics, moments, predict, sequences
from glyphgrid.plans.fixtures import frames, histograms, images, over_255, pairs, rect_pairs
from glyphgrid.plans.query import Query

CH = grid.CHANNELS
QUERIES: dict = {}


def query(name: str, build, sql: str, needs: str, ints: str = "", **kinds) -> None:
    QUERIES[name] = Query(build, sql, tuple(needs.split()), ints, **kinds)


def _list(template: str, names=CH) -> str:
    return ", ".join(template.replace("@", c) for c in names)


# Metrics

_DB = "a_db r_db g_db b_db all_db"
_ln = lambda t, n: f"CASE WHEN {t} = 0 THEN 99 ELSE least(98.9::DOUBLE, -4.3429448::DOUBLE * ln({t} / ({n} * 65025.0::DOUBLE))) END"
_log = lambda t, n: f"CASE WHEN {t} >= {n} THEN 99 WHEN 1 - {t} / {n} <= 0 THEN 98.9 ELSE least(98.9::DOUBLE, -10 * log10(1 - {t}::DOUBLE / {n})) END"


def _report_sql(sums: str, of, alpha: bool = True, single: bool = False) -> str:
    """sums: image_id, n, clear (whether any alpha isn't 255) and t_a to t_b."""
    cast = (lambda e: f"{e}::FLOAT::DOUBLE") if single else (lambda e: e)
    counted = "clear" if alpha else "false"
    total = " + ".join(cast(f"t_{c}") for c in "rgb") + f" + CASE WHEN {counted} THEN {cast('t_a')} ELSE 0 END"
    return f"SELECT image_id, {', '.join(f'{of(f't_{c}', 'n')} AS {c}_db' for c in CH)}, {of(f'({total})', f'(n * CASE WHEN {counted} THEN 4 ELSE 3 END)')} AS all_db FROM ({sums}) q"


_SSE = "SELECT image_id, count(*) AS n, bool_or(a <> 255) AS clear, " + _list("sum((@ - @2) * (@ - @2)) AS t_@") + " FROM {0} GROUP BY image_id"
query("o7_1_psnr", lambda s, d: metrics.distortion(pairs(s, d)), _report_sql(_SSE.format("pair"), _ln, True, True), "pair", "image_id", doubles=_DB)


def _ssim_sql(source: str, luminance: bool = True, channels: str = "argb") -> str:
    """Moments by joining each pixel with its window, then the index, summed over the image."""
    weight = "[4, 3, 2, 1][abs(q.x - p.x) + 1] * [4, 3, 2, 1][abs(q.y - p.y) + 1]"
    m = ", ".join(f"sum(k * {e.replace('@', c)}) AS {n}_{c}" for c in channels for n, e in (("xm", "@"), ("ym", "@2"), ("xx", "@ * @"), ("xy", "@ * @2"), ("yy", "@2 * @2")))
    top = "((2 * greatest(0, xy_@ * k - xm_@ * ym_@) + 60 * k * k) // 256)"
    low = "((xx_@ * k - xm_@ * xm_@ + yy_@ * k - ym_@ * ym_@ + 60 * k * k) // 256)"
    ratio = f"greatest(0, (2 * xm_@ * ym_@ + 20 * k * k)::DOUBLE * {top}) / ((xm_@ * xm_@ + ym_@ * ym_@ + 20 * k * k)::DOUBLE * {low})" if luminance else f"{top}::DOUBLE / {low}"
    index = _list(f"CASE WHEN xm_@ * xm_@ + ym_@ * ym_@ >= 64 * k * k THEN {ratio} ELSE 1 END AS s_@", channels)
    return f"SELECT image_id, y, x, clear, {index} FROM (SELECT image_id, y, x, clear, sum(k) AS k, {m} FROM (SELECT p.image_id, p.y, p.x, q.* EXCLUDE (image_id, y, x), {weight} AS k, bool_or(q.a <> 255) OVER (PARTITION BY p.image_id) AS clear FROM {source} p JOIN {source} q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 3 AND abs(q.y - p.y) <= 3) w GROUP BY image_id, y, x, clear) m"


_SSIM = "SELECT image_id, count(*) AS n, bool_or(clear) AS clear, " + _list("sum(s_@) AS t_@") + " FROM ({0}) s GROUP BY image_id"
query("o7_2_log_ssim", lambda s, d: metrics.distortion(pairs(s, d), "ssim"), _report_sql(_SSIM.format(_ssim_sql("pair")), _log), "pair", "image_id", doubles=_DB)
query("o7_3_row_sse", lambda s, d: pairs(s, d).select("image_id", F.posexplode(grid.each(F.col("h"), lambda y: grid.summed(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda x: (grid.value("r", x, y) - grid.value("r2", x, y)) * (grid.value("r", x, y) - grid.value("r2", x, y)))))).alias("y", "sse")), "SELECT image_id, y, sum((r - r2) ** 2) AS sse FROM pair GROUP BY image_id, y", "pair", "image_id y sse")
query("o7_4_sse", lambda s, d: pairs(s, d).select("image_id", *[metrics.sse(c).alias(f"sse_{c}") for c in CH]), "SELECT image_id, " + _list("sum((@ - @2) ** 2) AS sse_@") + " FROM pair GROUP BY image_id", "pair", "image_id sse_a sse_r sse_g sse_b")
query("o7_5_sse_16_bits", lambda s, d: grid.mapped(grid.held(pairs(s, d), **{f"{c}2": F.transform(f"{c}2", lambda v: v * 257) for c in CH}), lambda c, x, y: grid.value(c, x, y) * 257 - grid.value(f"{c}2", x, y)).select("image_id", *[grid.summed(F.transform(c, lambda v: v * v)).alias(f"sse_{c}") for c in CH]), "SELECT image_id, " + _list("sum((@ - @2) ** 2) * 66049 AS sse_@") + " FROM pair GROUP BY image_id", "pair", "image_id sse_a sse_r sse_g sse_b")
query("o7_6_block_sse", lambda s, d: metrics.block_sse(pairs(s, d), 3, ("g",)), "SELECT image_id, y // 3 AS by, x // 3 AS bx, sum((g - g2) ** 2) AS sse FROM pair GROUP BY image_id, y // 3, x // 3", "pair", "image_id by bx sse")


def _moments(s, d, clipped: bool):
    rows = grid.exploded(metrics.ssim_moments(pairs(s, d), "g"), *metrics.MOMENTS)
    # Inside, the weights are those of the whole window.
    return (rows if clipped else rows.filter("weights = 256")).withColumnRenamed("weights", "w")


_MOMENTS = "SELECT p.image_id, p.y, p.x, sum(k) AS w, sum(k * q.g) AS xm, sum(k * q.g2) AS ym, sum(k * q.g * q.g) AS xxm, sum(k * q.g * q.g2) AS xym, sum(k * q.g2 * q.g2) AS yym FROM pair p, (SELECT a.i AS dy, b.i AS dx, (4 - abs(a.i)) * (4 - abs(b.i)) AS k FROM range(-3, 4) a(i), range(-3, 4) b(i)) t JOIN pair q ON q.image_id = p.image_id AND q.y = p.y + t.dy AND q.x = p.x + t.dx"
query("o7_7_ssim_moments", lambda s, d: _moments(s, d, True), _MOMENTS + " GROUP BY p.image_id, p.y, p.x", "pair", "image_id y x w xm ym xxm xym yym")
query("o7_8_inner_moments", lambda s, d: _moments(s, d, False), _MOMENTS + " WHERE p.x BETWEEN 3 AND p.w - 4 AND p.y BETWEEN 3 AND p.h - 4 GROUP BY p.image_id, p.y, p.x", "pair", "image_id y x w xm ym xxm xym yym")
_map = lambda s, d, luminance: grid.exploded(metrics.maps(pairs(s, d), "ssim", ("r", "g"), luminance), "r", "g")
query("o7_9_ssim", lambda s, d: _map(s, d, True), f"SELECT image_id, y, x, s_r AS r, s_g AS g FROM ({_ssim_sql('pair', True, 'rg')}) s", "pair", "image_id y x", doubles="r g")
query("o7_10_structure", lambda s, d: _map(s, d, False), f"SELECT image_id, y, x, s_r AS r, s_g AS g FROM ({_ssim_sql('pair', False, 'rg')}) s", "pair", "image_id y x", doubles="r g")
query("o7_11_ssim_sum", lambda s, d: metrics.sums(pairs(s, d), "ssim", ("r", "g", "b")).select("image_id", *[F.col(f"t_{c}").alias(c) for c in "rgb"]), f"SELECT image_id, {_list('sum(s_@) AS @', 'rgb')} FROM ({_ssim_sql('pair', True, 'rgb')}) s GROUP BY image_id", "pair", "image_id", doubles="r g b")
_BEST = "SELECT p.image_id, p.y, p.x, p.a <> 255 AS clear, " + _list("min((q.@ - p.@2) ** 2)::BIGINT AS m_@") + " FROM pair p JOIN pair q ON q.image_id = p.image_id AND q.y BETWEEN p.y - 2 AND p.y + 2 AND q.x BETWEEN p.x - 2 AND p.x + 2 GROUP BY p.image_id, p.y, p.x, p.a"
query("o7_12_lsim", lambda s, d: metrics.distortion(pairs(s, d), "lsim"), _report_sql(f"SELECT image_id, count(*) AS n, bool_or(clear) AS clear, {_list('sum(m_@) AS t_@')} FROM ({_BEST}) b GROUP BY image_id", _ln), "pair", "image_id", doubles=_DB)
query("o6_16_lsim_neighbours", lambda s, d: grid.exploded(metrics.maps(pairs(s, d), "lsim")), f"SELECT image_id, y, x, {_list('m_@ AS @')} FROM ({_BEST}) b", "pair", "image_id y x a r g b")


def _spot() -> tuple:
    return (F.col("image_id") % F.col("w")).cast("int"), (F.col("image_id") % F.col("h")).cast("int")


_SPOT = "y = image_id % h AND x = image_id % w"
query("o7_14_at_pixel", lambda s, d: metrics.at_pixel(pairs(s, d), *_spot()), f"SELECT image_id, {_ln('((a - a2) ** 2 + (r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2)', '4')} AS psnr, {_log('(s_a + s_r + s_g + s_b)', '4')} AS ssim, {_ln('m_b', '4')} AS lsim FROM pair JOIN ({_ssim_sql('pair')}) s USING (image_id, y, x) JOIN ({_BEST}) b USING (image_id, y, x) WHERE {_SPOT}", "pair", "image_id", doubles="psnr ssim lsim")
_white = lambda c, a: f"{c} + {over_255(f'(255 - {a}) * 255')}"
_WHITE = "SELECT image_id, " + ", ".join(f"{_white(f'{c}', 'a')} AS {c}, {_white(f'{c}2', 'a2')} AS {c}2" for c in CH) + " FROM pair"
query("o7_15_black_or_white", lambda s, d: metrics.distortion_on_black_or_white(pairs(s, d)), f"SELECT k.image_id, k.a_db, " + ", ".join(f"CASE WHEN asked AND v.all_db < k.all_db THEN v.{c}_db ELSE k.{c}_db END AS {c}_db" for c in ("r", "g", "b", "all")) + f" FROM ({_report_sql(_SSE.format('pair'), _ln, False, True)}) k JOIN ({_report_sql(_SSE.format(f'({_WHITE}) w'), _ln, False, True)}) v USING (image_id) JOIN (SELECT image_id, bool_or(a2 <> 255) AS asked FROM pair GROUP BY image_id) USING (image_id)", "pair", "image_id", doubles=_DB)


def _window(s, d):
    from glyphgrid.operators import geometry

    x, y = F.least(F.lit(1), F.col("w") - 1), F.least(F.lit(2), F.col("h") - 1)
    both = pairs(s, d)
    names = (*CH, *[f"{c}2" for c in CH])
    return metrics.distortion(grid.regridded(both, F.col("w") - x, F.col("h") - y, lambda c, i, j: grid.value(c, x + i, y + j), names))


query("o7_16_window_psnr", _window, _report_sql(_SSE.format("(SELECT * FROM pair WHERE x >= least(1, w - 1) AND y >= least(2, h - 1)) p"), _ln, True, True), "pair", "image_id", doubles=_DB)


def _yuv_pairs(s, d):
    own = color.planes(images(s, d), "YCbCr")
    return grid.paired(own, own.withColumn("image_id", F.col("image_id") - 64), color.YUV)


query("o7_17_plane_report", lambda s, d: metrics.plane_report(_yuv_pairs(s, d), color.YUV), "", "", "image_id", doubles="yy_db uu_db vv_db yy_ssim uu_ssim vv_ssim")
query("o7_18_plane_sse", lambda s, d: pairs(s, d).select("image_id", metrics.sse("b").alias("sse")), "SELECT image_id, sum(b * b) - 2 * sum(b * b2) + sum(b2 * b2) AS sse FROM pair GROUP BY image_id", "pair", "image_id sse")
query("o7_19_plane_ssim", lambda s, d: metrics.sums(pairs(s, d), "ssim", ("b",)).select("image_id", F.col("t_b").alias("score")), f"SELECT image_id, sum(s_b) AS score FROM ({_ssim_sql('pair', True, 'b')}) s GROUP BY image_id", "pair", "image_id", doubles="score")
query("o7_20_window_sse", lambda s, d: metrics.block_sse(pairs(s, d), 4), "SELECT image_id, y // 4 AS by, x // 4 AS bx, sum((a - a2) ** 2 + (r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2) AS sse FROM pair GROUP BY image_id, y // 4, x // 4", "pair", "image_id by bx sse")


def _rate(s, d):
    """Bits of a block's symbols under its image's histogram, times lambda, and the squared errors."""
    size = F.col("w") * F.col("h")
    rows = grid.exploded(images(s, d), "g").withColumn("sym", F.shiftright("g", 3))
    counts = rows.groupBy("image_id", "sym").agg(F.count("*").alias("c"))
    of = images(s, d).select("image_id", size.alias("n"), (F.col("image_id") % 5 + 0.5).alias("lambda"))
    bits = rows.join(counts, ["image_id", "sym"]).join(of, "image_id").groupBy("image_id", "lambda", idiv(F.col("y"), 4).alias("by"), idiv(F.col("x"), 4).alias("bx")).agg(F.sum(F.log2("n") - F.log2("c")).alias("bits"))
    return metrics.block_sse(pairs(s, d), 4).join(bits, ["image_id", "by", "bx"]).withColumn("score", F.col("bits") * F.col("lambda") + F.col("sse"))


query("o7_21_rate_distortion", _rate, "WITH c AS (SELECT image_id, g // 8 AS sym, count(*) AS c FROM pair GROUP BY ALL) SELECT p.image_id, y // 4 AS by, x // 4 AS bx, sum(log2(w * h) - log2(c)) * (p.image_id % 5 + 0.5::DOUBLE) + sum((a - a2) ** 2 + (r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2) AS score FROM pair p JOIN c ON c.image_id = p.image_id AND c.sym = g // 8 GROUP BY p.image_id, y // 4, x // 4", "pair", "image_id by bx", doubles="score")


def _report(s, d):
    from glyphgrid.sources import files

    sizes = files.written_size(images(s, d), "PPM")
    both = pairs(s, d).join(sizes, "image_id").withColumn("size2", F.col("size"))
    base = metrics.report(both, "psnr", gray=True)
    return base.join(both.select("image_id", F.col("size").alias("n_bytes"), (F.lit(8.0) * F.col("size") / (F.col("w") * F.col("h"))).alias("bpp")), "image_id")


_GREY = "SELECT image_id, a, a2, " + ", ".join(f"floor(0.2126::DOUBLE * r{k} + 0.7152::DOUBLE * g{k} + 0.0722::DOUBLE * b{k} + 0.5::DOUBLE) AS {c}{k}" for k in ("", "2") for c in "rgb") + " FROM pair"
query("o18_1_report", _report, f"SELECT r.*, n_bytes, 8 * n_bytes::DOUBLE / n AS bpp FROM ({_report_sql(_SSE.format(f'({_GREY}) g'), _ln, True, True)}) r JOIN (SELECT image_id, count(*) AS n, 3 * count(*) + 9 + length(w::VARCHAR) + length(h::VARCHAR) AS n_bytes FROM pair GROUP BY image_id, w, h) s USING (image_id)", "pair", "image_id n_bytes", doubles=_DB + " bpp")

_EIGHT = (*CH, *[f"{c}2" for c in CH])
_HALVED = "(WITH t AS (SELECT *, y // 2 AS v, x // 2 AS u, h % 2 = 1 AND y = h - 1 AS lone, w % 2 = 1 AND x = w - 1 AS side FROM pair) SELECT image_id, " + _list("CASE WHEN bool_or(side) THEN min(CASE WHEN y % 2 = 0 THEN @ END) ELSE (sum(CASE WHEN lone THEN 2 * @ ELSE @ END) + 2) // 4 END AS @", _EIGHT) + " FROM t GROUP BY image_id, v, u) p"
query("o18_1_report_halved", lambda s, d: metrics.report(pairs(s, d), "psnr", halved=True), _report_sql(_SSE.format(_HALVED), _ln, True, True), "pair", "image_id", doubles=_DB)
query("o18_1_report_cropped", lambda s, d: metrics.report(pairs(s, d), "psnr", window=(0, 0, idiv(F.col("w") + 1, 2).cast("int"), idiv(F.col("h") + 1, 2).cast("int"))), _report_sql(_SSE.format("(SELECT * FROM pair WHERE x < (w + 1) // 2 AND y < (h + 1) // 2) p"), _ln, True, True), "pair", "image_id", doubles=_DB)

# Histograms


def _buckets(s, d):
    rows = images(s, d).select("image_id", histo.buckets(F.col("r"), 16).alias("h"))
    return rows.select("image_id", "h.low", "h.high", F.explode("h.bucket").alias("bucket")).groupBy("image_id", "low", "high", "bucket").agg(F.count("*").alias("cnt"))


query("o8_1_histogram", _buckets, "WITH m AS (SELECT image_id, min(r) AS low, max(r) AS high, greatest(1, max(r) - min(r)) AS d FROM img GROUP BY image_id) SELECT image_id, low, high, ((r - low) * (least(d, 16) - 1) + d // 2) // d AS bucket, count(*) AS cnt FROM img JOIN m USING (image_id) GROUP BY ALL", "img", "image_id low high bucket cnt")


def _one_colour(s, d):
    rows = grid.exploded(images(s, d))
    return rows.groupBy("image_id", idiv(F.col("y"), 2).alias("by"), idiv(F.col("x"), 2).alias("bx")).agg(*[(F.min(c) == F.max(c)).alias(f"same_{c}") for c in CH]).select("image_id", "by", "bx", (F.col("same_a") & F.col("same_r") & F.col("same_g") & F.col("same_b")).alias("flat"))


query("o8_5_one_colour", _one_colour, "SELECT image_id, y // 2 AS by, x // 2 AS bx, count(DISTINCT [a, r, g, b]) = 1 AS flat FROM img GROUP BY image_id, y // 2, x // 2", "img", "image_id by bx", bools="flat")
_h = lambda s, d, value, name: histograms(s, d).select("image_id", value.alias(name))
_by_symbol = lambda s, d, array, name: histograms(s, d).select("image_id", F.posexplode(array).alias("sym", name))
#: Names of columns stand for them in these functions.
C1, C2 = "counts", "counts2"
query("o8_7_cross_cost", lambda s, d: _h(s, d, histo.cross_cost(C1, C2), "bits"), "SELECT image_id, greatest(0, coalesce(sum(c) FILTER (WHERE c2 > 0) * log2(sum(c2)) - sum(c * log2(c2)) FILTER (WHERE c2 > 0), 0)) AS bits FROM hist GROUP BY image_id", "hist", "image_id", doubles="bits")
query("o8_9_symbol_cost", lambda s, d: _by_symbol(s, d, histo.symbol_costs(C1), "cost"), "SELECT image_id, sym, CASE WHEN c = 0 THEN 0 ELSE log2(sum(c) OVER (PARTITION BY image_id)) - log2(c) END AS cost FROM hist", "hist", "image_id sym", doubles="cost")
query("o8_10_entropy", lambda s, d: _h(s, d, histo.cost(C1), "bits"), "SELECT image_id, sum(c) * log2(sum(c)) - coalesce(sum(c * log2(c)) FILTER (WHERE c > 0), 0) AS bits FROM hist GROUP BY image_id", "hist", "image_id", doubles="bits")
query("o8_11_bounded_cost", lambda s, d: histograms(s, d).select("image_id", histo.bounded_cost(C1, (F.col("image_id") % 64).cast("int"), (F.col("image_id") % 64 + 5).cast("int")).alias("cost")), "SELECT image_id, CASE WHEN max(c) FILTER (WHERE sym = image_id % 64) = 0 THEN 0 ELSE log2(sum(c) FILTER (WHERE sym <= image_id % 64 + 5)) - log2(max(c) FILTER (WHERE sym = image_id % 64)) END AS cost FROM hist GROUP BY image_id", "hist", "image_id", doubles="cost")
_CDF = "(SELECT image_id, sym, c, c2, sum(c) OVER u * 16384 // sum(c) OVER i - (sum(c) OVER u - c) * 16384 // sum(c) OVER i AS p, sum(c2) OVER u * 16384 // sum(c2) OVER i - (sum(c2) OVER u - c2) * 16384 // sum(c2) OVER i AS p2 FROM hist WINDOW i AS (PARTITION BY image_id), u AS (PARTITION BY image_id ORDER BY sym))"
query("o8_12_l1_distance", lambda s, d: _h(s, d, histo.l1_distance(histo.cumulated(F.col(C1)), histo.cumulated(F.col(C2))), "l1"), f"SELECT image_id, sum(abs(p - p2)) / (64 * 16384.0::DOUBLE) AS l1 FROM {_CDF} GROUP BY image_id", "hist", "image_id", doubles="l1")
_BY_48 = lambda s, d: histograms(s, d, 48).select("image_id", histo.cumulated(F.col(C1)).alias("p"))
query("o8_13_l2_from_uniform", lambda s, d: _BY_48(s, d).select("image_id", histo.l2_from_uniform(F.col("p")).alias("l2")), "WITH n AS (SELECT image_id, s.s AS sym, count(*) FILTER (WHERE r % 48 = s.s) AS c FROM pair, range(0, 48) s(s) GROUP BY image_id, s.s), t AS (SELECT image_id, sym, sum(c) OVER u * 16384 // sum(c) OVER i - (sum(c) OVER u - c) * 16384 // sum(c) OVER i AS p FROM n WINDOW i AS (PARTITION BY image_id), u AS (PARTITION BY image_id ORDER BY sym)) SELECT image_id, list_reduce(list(((p::FLOAT - (16384::FLOAT / 48::FLOAT)::FLOAT) * (p::FLOAT - (16384::FLOAT / 48::FLOAT)::FLOAT))::FLOAT ORDER BY sym), lambda x, y: floor((x::FLOAT + y)::FLOAT)::FLOAT, 0::FLOAT) / (16384.0::DOUBLE * 16384) AS l2 FROM t GROUP BY image_id", "pair", "image_id", doubles="l2")
query("o8_14_offsets", lambda s, d: histo.offsets(histograms(s, d)).select("image_id", F.posexplode(F.arrays_zip("start", "freq")).alias("sym", "p")).select("image_id", "sym", "p.*"), "SELECT image_id, sym, coalesce(sum(c) OVER (PARTITION BY image_id ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, c AS freq FROM hist", "hist", "image_id sym start freq")
query("o8_15_normalised", lambda s, d: histo.normalised(histograms(s, d), 256).select("image_id", F.posexplode(C1).alias("sym", "n")), "", "hist", "image_id sym n")
query("o8_15_normalised_totals", lambda s, d: histo.normalised(histograms(s, d), 256).select("image_id", histo.total(C1).alias("total"), F.size(F.filter(C1, lambda n: n > 0)).alias("kept")), "SELECT image_id, 256 AS total, count(*) FILTER (WHERE c > 0) AS kept FROM hist GROUP BY image_id", "hist", "image_id total kept")
query("o8_16_spread", lambda s, d: histo.spread(histograms(s, d)).select("image_id", F.posexplode(F.arrays_zip("sym", "offset", "freq")).alias("slot", "p")).select("image_id", "slot", "p.*"), "SELECT image_id, o + k.k AS slot, sym, o AS offset, c AS freq FROM (SELECT *, coalesce(sum(c) OVER (PARTITION BY image_id ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM hist) h, range(0, 67) k(k) WHERE k.k < c", "hist", "image_id slot sym offset freq")
query("o8_17_powers_of_two", lambda s, d: _by_symbol(s, d, histo.powers_of_two(C1, 3), "n"), "WITH t AS (SELECT *, max(c) OVER (PARTITION BY image_id) AS m FROM hist) SELECT image_id, sym, CASE WHEN c = 0 THEN 0 ELSE 2 ** floor(log2(greatest(1.0::DOUBLE, c * (1.0::DOUBLE * least(4, m) / m))) + 0.5) END AS n FROM t", "hist", "image_id sym n")
query("o8_18_scaled", lambda s, d: _by_symbol(s, d, histo.scaled(C1, 3, True), "n"), "WITH t AS (SELECT *, max(c) OVER (PARTITION BY image_id) AS m FROM hist) SELECT image_id, sym, CASE WHEN c = 0 THEN 0 WHEN m = 3 THEN c ELSE greatest(1, floor(c * (3.0::DOUBLE / m) + 0.5)) END AS n FROM t", "hist", "image_id sym n")
_x = lambda e: f"sum(CASE WHEN {e} > 0 THEN {e} * log2({e}) ELSE 0 END)"
query("o8_19_combined_entropy", lambda s, d: _h(s, d, histo.combined_entropy(C1, C2), "bits"), f"SELECT image_id, sum(c) * log2(sum(c)) + (sum(c) + sum(c2)) * log2(sum(c) + sum(c2)) - {_x('c')} - {_x('(c + c2)')} AS bits FROM hist GROUP BY image_id", "hist", "image_id", doubles="bits")
query("o8_20_extra_cost", lambda s, d: _h(s, d, histo.extra_cost(C1), "bits"), "SELECT image_id, sum((sym - 2) // 2 * c) FILTER (WHERE sym >= 4) AS bits FROM hist GROUP BY image_id", "hist", "image_id bits")
query("o8_21_extra_cost_of_two", lambda s, d: _h(s, d, histo.extra_cost(histo.added(C1, C2)[0]), "bits"), "SELECT image_id, sum((sym - 2) // 2 * (c + c2)) FILTER (WHERE sym >= 4) AS bits FROM hist GROUP BY image_id", "hist", "image_id bits")
query("o8_22_added", lambda s, d: histograms(s, d).select("image_id", histo.added(C1, C2)[1].alias("nonzeros"), F.posexplode(histo.added(C1, C2)[0]).alias("sym", "n")), "SELECT image_id, count(*) FILTER (WHERE c + c2 > 0) OVER (PARTITION BY image_id) AS nonzeros, sym, c + c2 AS n FROM hist", "hist", "image_id nonzeros sym n")
query("o8_23_tile_histograms", lambda s, d: grid.exploded(images(s, d), "r").groupBy("image_id", idiv(F.col("y"), 4).alias("ty"), idiv(F.col("x"), 4).alias("tx"), (F.col("r") % 64).alias("sym")).agg(F.count("*").alias("n")), "SELECT image_id, y // 4 AS ty, x // 4 AS tx, r % 64 AS sym, count(*) AS n FROM img GROUP BY ALL", "img", "image_id ty tx sym n")
query("o9_11_clusters", lambda s, d: histo.clustered(histograms(s, d), 4).select("image_id", F.posexplode("labels").alias("sym", "label")), "", "", "image_id sym label")
_EVENTS = lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_type", F.length("props").cast("long").alias("bits"))
query("o8_32_tally", lambda s, d: histo.tallied(_EVENTS(s, d), "event_type"), "SELECT event_type, count(*) AS n, sum(length(props)) AS bits, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS place FROM events GROUP BY event_type", "", "n bits place", strings="event_type")
query("o8_33_sorted_dump", lambda s, d: _dump(s, d), "SELECT event_type, length(props) AS value, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, length(props)) AS place FROM events GROUP BY event_type, length(props)", "", "value n place", strings="event_type")


def _dump(s, d):
    """The values of each key by how often they occur."""
    rows = s.read.parquet(f"{d}/events.parquet").groupBy("event_type", F.length("props").alias("value")).agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "value")))


# Moments


def _cells(s, d):
    cw, ch = idiv(F.col("w") + 2, 3), idiv(F.col("h") + 2, 3)
    both = grid.pixels(cw, ch, lambda x, y: F.struct(x.alias("cx"), y.alias("cy"), *[v.alias(n) for v, n in zip(moments.cell(F.col("g"), F.col("w"), F.col("h"), x, y, 3), ("m", "q"))]))
    return images(s, d).select("image_id", F.explode(both).alias("p")).select("image_id", "p.*")


_CELL = "SELECT c.image_id, c.cy, c.cx, sum(i.g) AS m, sum(i.g * i.g) AS q FROM (SELECT DISTINCT image_id, w, h, y // 3 AS cy, x // 3 AS cx FROM img) c, range(0, 3) j(j), range(0, 3) k(k) JOIN img i ON i.image_id = c.image_id AND i.y = least(c.h - 1, 3 * c.cy + j.j) AND i.x = least(c.w - 1, 3 * c.cx + k.k) GROUP BY c.image_id, c.cy, c.cx"
query("o9_1_cell_sums", _cells, _CELL, "img", "image_id cy cx m q")


def _integral_rows(df):
    rows = df.select("image_id", "cw", F.posexplode(F.arrays_zip("i1", "i2")).alias("i", "p"))
    return rows.select("image_id", idiv(F.col("i"), F.col("cw") + 1).alias("y"), (F.col("i") % (F.col("cw") + 1)).alias("x"), "p.i1", "p.i2")


query("o9_2_integral", lambda s, d: _integral_rows(moments.integral(images(s, d), "g")), "SELECT c.image_id, j.j AS y, k.k AS x, coalesce(sum(i.g), 0) AS i1, coalesce(sum(i.g * i.g), 0) AS i2 FROM (SELECT DISTINCT image_id, w, h FROM img) c CROSS JOIN range(0, 65) j(j) CROSS JOIN range(0, 65) k(k) LEFT JOIN img i ON i.image_id = c.image_id AND i.y < j.j AND i.x < k.k WHERE j.j <= c.h AND k.k <= c.w GROUP BY c.image_id, j.j, k.k", "img", "image_id y x i1 i2")
query("o9_3_integral_of_planes", lambda s, d: _integral_rows(moments.integral(moments.mixed_luma(color.planes(images(s, d), "YCoCg"), 0.25), "v", 2)), "", "", "image_id y x i1 i2")


def _deviation(s, d):
    x1, y1 = F.greatest(F.lit(1), F.col("cw") - 1), F.greatest(F.lit(1), F.col("ch") - 1)
    return moments.integral(images(s, d), "g").select("image_id", F.round(moments.deviation(F.lit(0), F.lit(0), x1, y1), 3).alias("std_dev"))


query("o9_4_std_dev", _deviation, "WITH t AS (SELECT image_id, (1::FLOAT / count(*)::FLOAT) * sum(g)::FLOAT AS m, (1::FLOAT / count(*)::FLOAT) * sum(g * g)::FLOAT AS q FROM img WHERE x < greatest(1, w - 1) AND y < greatest(1, h - 1) GROUP BY image_id) SELECT image_id, round(sqrt(greatest(0::FLOAT, q - m * m)::DOUBLE), 3) AS std_dev FROM t", "img", "image_id", doubles="std_dev")
_drd = lambda n, d: f"CASE WHEN {n} < 0 THEN -((abs({n}) + {d} // 2) // {d}) ELSE (abs({n}) + {d} // 2) // {d} END"
_FIT = f"WITH s AS (SELECT image_id, count(*)::HUGEINT AS n, sum(g)::HUGEINT AS l, sum(b)::HUGEINT AS c, sum(g * b)::HUGEINT AS lc, sum(g * g)::HUGEINT AS ll FROM img GROUP BY image_id), t AS (SELECT *, lc * n - l * c AS num, ll * n - l * l AS den FROM s) SELECT image_id, CASE WHEN num = 0 OR den = 0 THEN 0 ELSE greatest(-32768, least(32767, {_drd('(num * 256)', 'den')})) END AS a, CASE WHEN num = 0 OR den = 0 THEN {_drd('(c * 4)', 'n')} ELSE greatest(-32768, least(32767, {_drd('((den * c - num * l) * 4)', '(n * den)')})) END AS b FROM t"
query("o9_5_line_fit", lambda s, d: images(s, d).select("image_id", moments.line_fit(F.col("g"), F.col("b")).alias("f")).select("image_id", "f.*"), _FIT.replace("den = 0 THEN 0 ELSE", "den = 0 THEN 0 ELSE"), "img", "image_id a b")


def _block_fit(s, d):
    rows = grid.exploded(images(s, d), "g", "b").groupBy("image_id", idiv(F.col("y"), 4).alias("by"), idiv(F.col("x"), 4).alias("bx")).agg(F.collect_list(F.struct("g", "b")).alias("p"))
    return rows.select("image_id", "by", "bx", moments.line_fit(F.transform("p", lambda v: v["g"]), F.transform("p", lambda v: v["b"])).alias("f")).select("image_id", "by", "bx", "f.*")


query("o9_6_block_fit", _block_fit, _FIT.replace("SELECT image_id, count(*)", "SELECT image_id, y // 4 AS by, x // 4 AS bx, count(*)").replace("FROM img GROUP BY image_id)", "FROM img GROUP BY image_id, y // 4, x // 4)").replace("SELECT image_id, CASE", "SELECT image_id, \"by\", bx, CASE"), "img", "image_id by bx a b")
_NORMAL = lambda s, d: moments.normal_equations(grid.exploded(images(s, d)), ["r", "g"], "b", "image_id")
query("o9_8_normal_equations", _NORMAL, "SELECT image_id, sum(r * r) AS xx_0_0, sum(r * g) AS xx_0_1, sum(r) AS xx_0_2, sum(g * g) AS xx_1_1, sum(g) AS xx_1_2, count(*) AS xx_2_2, sum(r * b) AS xy_0, sum(g * b) AS xy_1, sum(b) AS xy_2, count(*) AS n FROM img GROUP BY image_id", "img", "image_id n", doubles="xx_0_0 xx_0_1 xx_0_2 xx_1_1 xx_1_2 xx_2_2 xy_0 xy_1 xy_2")
query("o9_9_solved", lambda s, d: moments.solved(_NORMAL(s, d), 2, "image_id").select("image_id", F.posexplode_outer("x").alias("i", "x")), "", "", "image_id i", doubles="x")
query("o9_16_block_range", lambda s, d: moments.block_range(images(s, d), "b", 3), "SELECT image_id, y // 3 AS by, x // 3 AS bx, min(b) AS lo, max(b) AS hi FROM img GROUP BY image_id, y // 3, x // 3", "img", "image_id by bx lo hi")
query("o9_17_block_min_max", lambda s, d: moments.block_range(images(s, d), "r", 4), "SELECT image_id, y // 4 AS by, x // 4 AS bx, list_min(list(r)) AS lo, list_max(list(r)) AS hi FROM img GROUP BY image_id, y // 4, x // 4", "img", "image_id by bx lo hi")
_mean = lambda c: f"(sum({c}) + count(*) // 2) // count(*) AS {c}"
query("o9_18_average_colour", lambda s, d: moments.average_colour(images(s, d), *_spot(), F.lit(2)), "SELECT image_id, " + ", ".join(map(_mean, CH)) + " FROM img WHERE abs(x - image_id % w) <= 2 AND abs(y - image_id % h) <= 2 GROUP BY image_id", "img", "image_id a r g b")


def _average(s, d):
    from glyphgrid.operators import geometry

    rows = moments.average_colour(images(s, d), F.lit(0), F.lit(0), F.lit(1 << 24))
    return rows.select("image_id", *[geometry.to_four_bits(F.col(c), F.col("a")).alias(f"{c}4") for c in "rgb"])


query("o9_19_average_rgb444", _average, "SELECT image_id, " + _list("CASE WHEN a = 0 THEN 15 ELSE least(255, @ * 255 // a) // 16 END AS @4", "rgb") + " FROM (SELECT image_id, " + ", ".join(map(_mean, CH)) + " FROM img GROUP BY image_id) t", "img", "image_id r4 g4 b4")
_GREYS = "SELECT image_id, w, h, y, x, floor(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b + 0.5::DOUBLE)::BIGINT AS v FROM img"
query("o9_22_edges", lambda s, d: grid.exploded(moments.edges(images(s, d), F.lit(3), F.lit(2)), "edge"), f"WITH t AS ({_GREYS}), e AS (SELECT p.image_id, p.y * 2 // p.h AS y, p.x * 3 // p.w AS x, abs(sum(q.v) - 4 * p.v) AS d FROM t p JOIN t q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 WHERE p.x > 0 AND p.y > 0 AND p.x < p.w - 1 AND p.y < p.h - 1 GROUP BY p.image_id, p.w, p.h, p.y, p.x, p.v) SELECT i.image_id, j.j AS y, k.k AS x, least(32767, coalesce(sum(e.d), 0)) AS edge FROM (SELECT DISTINCT image_id FROM img) i CROSS JOIN range(0, 2) j(j) CROSS JOIN range(0, 3) k(k) LEFT JOIN e ON e.image_id = i.image_id AND e.y = j.j AND e.x = k.k GROUP BY i.image_id, j.j, k.k", "img", "image_id y x edge")
query("o9_23_window_difference", lambda s, d: moments.window_difference(pairs(s, d), F.col("image_id") % 4, F.col("image_id") % 3, 4, 3, 1), "WITH c AS (SELECT DISTINCT image_id, w, h, ((image_id % 4) * (w - 1) + 1) // 3 AS cx, ((image_id % 3) * (h - 1) + 1) // 2 AS cy FROM pair) SELECT c.image_id, sum(" + " + ".join(f"abs(p.{x} - p.{x}2)" for x in CH) + ") / 9.0::DOUBLE AS diff FROM c, range(-1, 2) j(j), range(-1, 2) k(k) JOIN pair p ON p.image_id = c.image_id AND p.y = greatest(0, least(c.h - 1, c.cy + j.j)) AND p.x = greatest(0, least(c.w - 1, c.cx + k.k)) GROUP BY c.image_id", "pair", "image_id", doubles="diff")

# Blocks: each whole 8x8 image of the table is four 4x4 blocks, with values around 0 as residuals

E = "WITH g AS (SELECT vec_id AS image_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, floor((embedding[i]::DOUBLE + 1) * 128)::BIGINT - 128 AS v FROM embeddings, range(1, 65) t(i)), blocks AS (SELECT image_id, y // 4 * 2 + x // 4 AS k, y % 4 AS y, x % 4 AS x, v FROM g)"


def blocks(s, d):
    """image_id, k, v: 16 values row by row."""
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    at = lambda i: ((idiv(F.col("k"), 2) * 4 + idiv(i, 4)) * 8 + F.col("k") % 2 * 4 + i % 4).cast("int")
    return grid.held(e, v=F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.floor((F.get("embedding", at(i)).cast("double") + 1) * 128) - 128).cast("long"))).select("image_id", "k", "v")


def contexts(s, d):
    """Of blocks: a context of 4 + 1 + 4 + 1 + 4 values taken from the block's own, and the values."""
    return grid.held(blocks(s, d), c=F.slice("v", 1, 14))


_spread = lambda df, name="p": df.select("image_id", "k", F.posexplode(name).alias("i", "v"))
_ctx = "l AS (SELECT image_id, k, list(v ORDER BY y, x) AS c FROM blocks GROUP BY image_id, k), o AS (SELECT image_id, k, c, j.j AS y, i.i AS x FROM l, range(0, 4) j(j), range(0, 4) i(i))"
_rd = lambda n, d: f"CASE WHEN {n} < 0 THEN -((abs({n}) + {d // 2}) // {d}) ELSE ({n} + {d // 2}) // {d} END"


def _block_query(name, spark, sql):
    query(name, lambda s, d: _spread(contexts(s, d).select("image_id", "k", spark(F.col("c")).alias("p"))), f"{E}, {_ctx} SELECT image_id, k, 4 * y + x AS i, {sql} AS v FROM o", "", "image_id k i v")


_block_query("o13_13_predict_dc", lambda C: kernels.predict_dc(C, 4, 4), _rd("list_sum(c[1:9])::BIGINT", 9))
_block_query("o13_14_predict_dc_left", lambda C: kernels.predict_dc(C, 4, 4, "left"), _rd("list_sum(c[1:4])::BIGINT", 4))
_block_query("o13_15_predict_dc_top", lambda C: kernels.predict_dc(C, 4, 4, "top"), _rd("list_sum(c[6:9])::BIGINT", 4))
_W = "[255, 149, 85, 64]"
_across = f"(c[4 - y] * {_W}[x + 1] + c[11 + y] * (256 - {_W}[x + 1]))"
_down = f"(c[6 + x] * {_W}[y + 1] + c[1] * (256 - {_W}[y + 1]))"
_block_query("o13_16_predict_smooth", lambda C: kernels.predict_smooth(C, 4, 4), f"floor(({_across} + {_down} + 256) / 512.0)")
_block_query("o13_17_predict_smooth_across", lambda C: kernels.predict_smooth(C, 4, 4, "across"), f"floor(({_across} + 128) / 256.0)")
_block_query("o13_18_predict_smooth_down", lambda C: kernels.predict_smooth(C, 4, 4, "down"), f"floor(({_down} + 128) / 256.0)")
_block_query("o13_19_predict_gradient", lambda C: kernels.predict_gradient(C, 4, 4, -60, 60), "greatest(-60, least(60, c[6 + x] + c[4 - y] - c[5]))")
_l, _t, _k = "c[4 - y]", "c[6 + x]", "c[5]"
_pl, _pt, _pk = f"abs({_t} - {_k})", f"abs({_l} - {_k})", f"abs({_t} + {_l} - 2 * {_k})"
_block_query("o13_20_predict_paeth", lambda C: kernels.predict_paeth(C, 4, 4), f"CASE WHEN {_pl} <= {_pt} AND {_pl} <= {_pk} THEN {_l} WHEN {_pt} <= {_pk} THEN {_t} ELSE {_k} END")
_block_query("o13_25_predict_zero", lambda C: kernels.predict_zero(4, 4), "0")
_block = lambda name, spark, sql: query(name, lambda s, d: _spread(blocks(s, d).select("image_id", "k", spark(F.col("v")).alias("p"))), f"{E}, {_ctx} SELECT image_id, k, 4 * y + x AS i, {sql} AS v FROM o", "", "image_id k i v")
_own = "c[4 * y + x + 1]"
_block("o13_27_with_residual", lambda V: kernels.with_residual(V, F.transform(V, lambda v: v * 2 - 7), -80, 80), f"greatest(-80, least(80, 3 * {_own} - 7))")
_block("o13_28_residual", lambda V: kernels.residual(V, F.reverse(V)), f"{_own} - c[16 - 4 * y - x]")
_block("o13_34_identity", lambda V: kernels.identity(V, 3, True), f"trunc({_own} / 3.0)")
_block("o13_35_transpose", lambda V: kernels.transposed(V, 4, 4), "c[4 * x + y + 1]")
_block("o13_40_quantise", lambda V: kernels.quantised(V, F.transform(V, lambda v, i: 9000 + 100 * i), F.transform(V, lambda v, i: F.lit(20000))), f"sign({_own}) * ((abs({_own}) * (9000 + 100 * (4 * y + x)) + 20000) // 65536)")
_block("o13_41_dequantise", lambda V: kernels.dequantised(F.slice(V, 1, 10), F.transform(F.slice(V, 1, 10), lambda v, i: 3 + i), 16), f"CASE WHEN 4 * y + x < 10 THEN {_own} * (3 + 4 * y + x) ELSE 0 END")
_block("o13_44_zigzag", lambda V: kernels.zigzag(V), "c[[0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15][4 * y + x + 1] + 1]")
query("o13_45_bounding_box", lambda s, d: blocks(s, d).select("image_id", "k", kernels.bounding_box(F.transform(F.col("v"), lambda v: F.when(F.abs(v) > 20, v).otherwise(0)), 4).alias("p")).select("image_id", "k", "p.*"), f"{E} SELECT image_id, k, coalesce(max(x) FILTER (WHERE abs(v) > 20), 0) AS max_x, coalesce(max(y) FILTER (WHERE abs(v) > 20), 0) AS max_y FROM blocks GROUP BY image_id, k", "", "image_id k max_x max_y")
query("o13_33_hadamard", lambda s, d: _spread(blocks(s, d).select("image_id", "k", kernels.hadamard(F.slice("v", 1, 8), 8).alias("p"))), "", "", "image_id k i v")
query("o13_38_halved", lambda s, d: _spread(blocks(s, d).select("image_id", "k", kernels.halved(F.col("v"), 4, 4).alias("p"))), f"{E} SELECT image_id, k, 2 * y + x AS i, floor((v + CASE WHEN v < 0 THEN 1 ELSE 0 END) / 2.0) AS v FROM blocks WHERE y < 2 AND x < 2", "", "image_id k i v")


def _whole(s, d):
    rows = s.read.parquet(f"{d}/embeddings.parquet").withColumnRenamed("vec_id", "image_id")
    return grid.held(rows, v=F.transform("embedding", lambda e: (F.floor((e.cast("double") + 1) * 128) - 128).cast("long"))).select("image_id", "v")


_norm = lambda k: f"(CASE WHEN {k} = 0 THEN sqrt(0.125::DOUBLE) ELSE 0.5::DOUBLE END)"
query("o13_39_dct_coefficient", lambda s, d: _whole(s, d).select("image_id", kernels.dct_coefficient(F.col("v"), (F.col("image_id") % 8).cast("int"), (idiv(F.col("image_id"), 8) % 8).cast("int")).alias("c")).select("image_id", F.floor(F.col("c") / 8 + 0.5).alias("c")), f"{E} SELECT image_id, floor(round(256 * sum(v * cos(pi() * (2 * x + 1) * (image_id % 8) / 16) * cos(pi() * (2 * y + 1) * (image_id // 8 % 8) / 16)) * max({_norm('image_id % 8')}) * max({_norm('image_id // 8 % 8')})) / 8 + 0.5) AS c FROM g GROUP BY image_id", "", "image_id c")

# Scalars

_ints = lambda name, columns, sql, ints: query(name, lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), *columns(F.col("event_id"), F.col("event_id") * 37 % 2001 - 1000)), f"SELECT event_id AS id, {sql} FROM events", "", ints)
_SQ = "(event_id * 37 % 2001 - 1000)"
_ints("o13_1_right_shift_round", lambda n, v: [fixed.right_shift_round(v, 3).alias("v")], f"floor(({_SQ} + 4) / 8.0) AS v", "id v")
_ints("o13_2_div_by_255", lambda n, v: [fixed.div_by_255(n % 256 * (n * 7 % 256)).alias("v")], "((event_id % 256) * (event_id * 7 % 256) + (event_id % 256) * (event_id * 7 % 256) // 256 + 128) // 256 AS v", "id v")
_ints("o13_3_unmultiply", lambda n, v: [fixed.unmultiply(F.least(n % 256, n * 7 % 256), n % 256).alias("v")], "CASE WHEN event_id % 256 = 0 THEN 0 ELSE least(255, (least(event_id % 256, event_id * 7 % 256) * ((16711680 + event_id % 256 - 1) // (event_id % 256)) + 32768) // 65536) END AS v", "id v")
_ints("o13_4_clamp_signed", lambda n, v: [fixed.clamp_signed(v, 9).alias("v")], f"greatest(-256, least(255, {_SQ})) AS v", "id v")
_ints("o13_5_change_precision", lambda n, v: [fixed.change_precision(v, 10, 8).alias("down"), fixed.change_precision(v, 8, 10).alias("up")], f"floor(({_SQ} + 2) / 4.0) AS down, {_SQ} * 4 AS up", "id down up")
_ints("o13_6_multiply3", lambda n, v: [c.alias(k) for c, k in zip(fixed.multiply3(v, n % 11, n % 13, (1, -2, 3, 4, 5, -6, 7, 8, 9)), "xyz")], f"{_SQ} - 2 * (event_id % 11) + 3 * (event_id % 13) AS x, 4 * {_SQ} + 5 * (event_id % 11) - 6 * (event_id % 13) AS y, 7 * {_SQ} + 8 * (event_id % 11) + 9 * (event_id % 13) AS z", "id x y z")
query("o13_9_inner_product", lambda s, d: pairs(s, d).select("image_id", grid.summed(F.zip_with("r", "r2", lambda p, q: p * q)).alias("v")), "SELECT image_id, sum(r * r2) AS v FROM pair GROUP BY image_id", "pair", "image_id v")
query("o13_12_has_other", lambda s, d: images(s, d).select("image_id", F.exists("a", lambda v: v != 255).alias("alpha"), F.exists("r", lambda v: v != F.get("r", F.lit(0))).alias("red")), "SELECT image_id, bool_or(a <> 255) AS alpha, count(DISTINCT r) > 1 AS red FROM img GROUP BY image_id", "img", "image_id", bools="alpha red")
_D = "(event_id % 5000 + 1)"
_high = "floor(log2(greatest(@, 1)))::BIGINT"
_hp = _high.replace("@", f"({_D} - 1)")
_ints("o13_49_prefix_code", lambda n, v: [c.alias(k) for c, k in zip(fixed.prefix_code(n % 5000 + 1), ("code", "extra", "rest"))], f"CASE WHEN {_D} <= 2 THEN {_D} - 1 ELSE 2 * {_hp} + (({_D} - 1) // (2 ** ({_hp} - 1))::BIGINT) % 2 END AS code, CASE WHEN {_D} <= 2 THEN 0 ELSE {_hp} - 1 END AS extra, CASE WHEN {_D} <= 2 THEN 0 ELSE ({_D} - 1) % (2 ** ({_hp} - 1))::BIGINT END AS rest", "id code extra rest")
_vp = _high.replace("@", "(event_id % 5000)")
_ints("o13_47_golomb", lambda n, v: [c.alias(k) for c, k in zip(kernels.golomb(n % 5000, 2), ("code", "extra", "rest"))], f"CASE WHEN event_id % 5000 < 4 THEN event_id % 5000 ELSE 2 * {_vp} + (event_id % 5000) // (2 ** ({_vp} - 1))::BIGINT % 2 END AS code, CASE WHEN event_id % 5000 < 4 THEN 0 ELSE {_vp} - 1 END AS extra, CASE WHEN event_id % 5000 < 4 THEN 0 ELSE (event_id % 5000) % (2 ** ({_vp} - 1))::BIGINT END AS rest", "id code extra rest")
_ints("o13_48_ungolomb", lambda n, v: [kernels.ungolomb(p, r, k).alias(name) for name, k in (("one", 1), ("two", 2)) for p, _, r in [kernels.golomb(n % 5000, k)]], "event_id % 5000 AS one, event_id % 5000 AS two", "id one two")
query("o13_54_status_text", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 20).alias("code"), fixed.status_text((F.col("event_id") % 20).cast("int")).alias("text")), "SELECT event_id, event_id % 20 AS code, ['OK. no error.', 'mismatch between user and system library version', 'memory error allocating objects', 'a parameter value is invalid', 'a pointer parameter is NULL', 'picture has invalid width/height', 'abort request by user', 'unsupported feature', 'bitstream has syntactic error', 'premature end-of-file during decoding', 'error while reading bytes', 'neural decode failure', 'memory error while flushing bits', 'encoding configuration is invalid', 'error while flushing bytes', 'file is bigger than 4G', 'encoder called with improper colorspace', 'neural encode failure', 'last', 'undefined status'][event_id % 20 + 1] AS text FROM events", "", "event_id code", strings="text")

# Frames

_FINAL = "f AS (SELECT *, coalesce(sum(CASE WHEN duration_ms > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY anim_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS final_idx, coalesce(sum(num_bytes) OVER (PARTITION BY anim_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM frames)"
_CHAIN = f"{_FINAL}, g AS (SELECT f.*, d.final_idx AS last_dispose FROM f ASOF JOIN (SELECT anim_id, frame_idx, final_idx FROM f WHERE disposes) d ON d.anim_id = f.anim_id AND d.frame_idx <= f.frame_idx)"
query("o15_7_final_frames", lambda s, d: fr.final_index(frames(s, d)).select("anim_id", "frame_idx", "final_idx"), f"WITH {_FINAL} SELECT anim_id, frame_idx, final_idx FROM f", "frames", "anim_id frame_idx final_idx")
query("o15_8_frame_features", lambda s, d: fr.features(frames(s, d)), f"WITH {_CHAIN} SELECT g.anim_id, g.frame_idx, g.final_idx, g.position, g.last_dispose, min(o.x) AS wx, min(o.y) AS wy, max(o.x + o.w) - min(o.x) AS ww, max(o.y + o.h) - min(o.y) AS wh FROM g JOIN f o ON o.anim_id = g.anim_id AND o.final_idx = g.final_idx AND (o.frame_idx = g.frame_idx OR (g.duration_ms > 0 AND o.frame_idx < g.frame_idx)) GROUP BY ALL", "frames", "anim_id frame_idx final_idx position last_dispose wx wy ww wh")
query("o6_14_first_raw_frame", lambda s, d: fr.first_raw_frame(frames(s, d)), f"WITH {_FINAL} SELECT anim_id, final_idx, arg_min(frame_idx, frame_idx) AS first_idx FROM f GROUP BY anim_id, final_idx", "frames", "anim_id final_idx first_idx")
query("o6_15_last_dispose", lambda s, d: fr.features(frames(s, d)).select("anim_id", "frame_idx", "last_dispose"), f"WITH {_CHAIN} SELECT anim_id, frame_idx, last_dispose FROM g", "frames", "anim_id frame_idx last_dispose")
_PLAN = f"{_CHAIN}, n AS (SELECT anim_id, count(*) AS n FROM f GROUP BY anim_id), t AS (SELECT anim_id, last_dispose FROM g WHERE duration_ms > 0 AND final_idx = 5), p AS (SELECT t.anim_id, min(f.frame_idx) AS first_idx FROM t JOIN f ON f.anim_id = t.anim_id AND f.final_idx = t.last_dispose GROUP BY t.anim_id), plan AS (SELECT n.anim_id, coalesce(p.first_idx, n.n) AS discard FROM n LEFT JOIN p USING (anim_id))"
query("o15_9_skip_plan", lambda s, d: fr.skip_plan(frames(s, d), 5), f"WITH {_PLAN} SELECT * FROM plan", "frames", "anim_id discard")
query("o15_13_discarded", lambda s, d: fr.discarded(frames(s, d), 5).select("anim_id", "frame_idx"), f"WITH {_PLAN} SELECT anim_id, frame_idx FROM f JOIN plan USING (anim_id) WHERE frame_idx >= discard", "frames", "anim_id frame_idx")
query("o15_12_next_header", lambda s, d: fr.next_header(frames(s, d)), "SELECT p.anim_id, p.frame_idx, q.duration_ms AS next_duration_ms, q.anim_id IS NULL AS is_last FROM frames p LEFT JOIN frames q ON q.anim_id = p.anim_id AND q.frame_idx = p.frame_idx + 1", "frames", "anim_id frame_idx next_duration_ms", bools="is_last")
query("o15_22_frame_validity", lambda s, d: fr.valid(frames(s, d), 14, 11), f"WITH {_CHAIN}, c AS (SELECT anim_id, max(frame_idx) AS last FROM frames GROUP BY anim_id) SELECT anim_id, frame_idx, (frame_idx > 0 OR disposes) AND (frame_idx < last OR duration_ms > 0) AND x + w <= 14 AND y + h <= 11 AND (disposes OR duration_ms > 0 OR frame_idx - coalesce((SELECT max(q.frame_idx) FROM g q WHERE q.anim_id = g.anim_id AND q.frame_idx < g.frame_idx AND q.duration_ms > 0), 0) <= 4) AND (disposes OR final_idx - last_dispose <= 17) AS ok FROM g JOIN c USING (anim_id)", "frames", "anim_id frame_idx", bools="ok")
query("o2_19_dimension_guard", lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), fr.sizes_ok(F.col("event_id") * 7919 % 40000, F.col("event_id") * 104729 % 40000).alias("ok")), "SELECT event_id AS id, event_id * 7919 % 40000 BETWEEN 1 AND 16777216 AND event_id * 104729 % 40000 BETWEEN 1 AND 16777216 AND (event_id * 7919 % 40000) * (event_id * 104729 % 40000) <= 268435456 AS ok FROM events", "", "id", bools="ok")

# Sequences and sets

query("o12_7_covering_rectangles", lambda s, d: sequences.covered(predict.changed(pairs(s, d), 50.0), 3), "", "", "image_id k x y w h")
query("o12_8_bounding_rectangle", lambda s, d: predict.changed(pairs(s, d), 50.0).groupBy("image_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")), "SELECT image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM pair WHERE (a - a2) ** 2 + (r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2 > 56 GROUP BY image_id", "pair", "image_id x y w h")
query("o12_9_cumulative_area", lambda s, d: rect_pairs(s, d).groupBy((F.col("id") % 50).alias("k")).agg(F.sum(F.col("w") * F.col("h")).alias("area")), "SELECT id % 50 AS k, sum(w * h) AS area FROM rect_pairs GROUP BY id % 50", "rect_pairs", "k area")
query("o10_21_run_parse", lambda s, d: sequences.parsed(grid.held(images(s, d), q=F.transform("r", lambda v: idiv(v, 64))), "q"), "", "", "image_id k place length distance", strings="kind")
query("o10_30_recency", lambda s, d: sequences.listed(grid.held(images(s, d), q=F.transform("r", lambda v: idiv(v, 8))), "q", 6).select("image_id", F.posexplode("places").alias("i", "place")), "", "", "image_id i place")
query("o10_32_move_to_front", lambda s, d: sequences.listed(grid.held(images(s, d), q=F.transform("r", lambda v: idiv(v, 8))), "q", 32, True).select("image_id", F.posexplode("places").alias("i", "place")), "", "", "image_id i place")

# Bytes and files


def _read_back(s, d, size: int):
    from glyphgrid.streaming import animation

    return animation.read_frames(animation.chunks(animation.streams(frames(s, d), 18, 13), size))


_READ = "SELECT anim_id, frame_idx, CASE WHEN frame_idx = max(frame_idx) OVER (PARTITION BY anim_id) THEN greatest(1, duration_ms) ELSE duration_ms END AS duration_ms, disposes, x, y, w, h, num_bytes FROM frames"
for _size in (7, 512):
    query(f"o15_{1 if _size == 512 else 5}_frames_of_chunks_{_size}", lambda s, d, n=_size: _read_back(s, d, n), _READ, "frames", "anim_id frame_idx duration_ms x y w h num_bytes", bools="disposes")


def _sniffed(s, d):
    from glyphgrid.sources import files

    head = F.get(F.array(*[F.unhex(F.lit(h)) for h in HEADS]), (F.col("event_id") % len(HEADS)).cast("int"))
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), files.sniffed(F.concat(head, F.lit(bytes(8)))).alias("format"))


HEADS = ("89504E470D0A1A0A", "FFD8FFE000104A46", "49492A0008000000", "4D4D002A00000008", "474946383961", "474946383761", "474946383861", "524946460000000057454250", "424D36000000", "50350A312031", "50360A312031", "50370A57", "50340A31", "00", "595556344D504547322043343230")
_FORMATS = ("PNG", "JPEG", "TIFF", "TIFF", "GIF", "GIF", "UNSUPPORTED", "WEBP", "BMP", "PGM", "PPM", "PAM", "UNSUPPORTED", "UNSUPPORTED", "Y4M_420")
query("o2_1_sniffed", _sniffed, f"SELECT event_id AS id, {list(_FORMATS)}[event_id % {len(HEADS)} + 1] AS format FROM events", "", "id", strings="format")


def _through(kind: str):
    """Images written to bytes of a format and read again."""

    def build(s, d):
        from glyphgrid.sources import files

        return grid.exploded(files.decoded(files.encoded(images(s, d), kind), ("image_id",)))

    return build


_unmultiplied = lambda c: f"CASE WHEN a = 0 THEN 0 ELSE least(255, ({c} * ((16711680 + a - 1) // a) + 32768) // 65536) END"
_STRAIGHT = "WITH t AS (SELECT image_id, y, x, a, " + ", ".join(f"{_unmultiplied(c)} AS {c}" for c in "rgb") + " FROM img)"
_again = "SELECT image_id, y, x, a, " + ", ".join(f"CASE WHEN a < 255 THEN {over_255(f'{c} * a')} ELSE {c} END AS {c}" for c in "rgb") + " FROM t"
query("o2_13_ppm", _through("PPM"), f"{_STRAIGHT} SELECT image_id, y, x, 255 AS a, r, g, b FROM t", "img", "image_id y x a r g b")
query("o3_5_pam", _through("PAM"), f"{_STRAIGHT} {_again}", "img", "image_id y x a r g b")
query("o2_12_bmp", _through("BMP"), f"{_STRAIGHT} {_again}", "img", "image_id y x a r g b")
query("o2_5_png", _through("PNG"), f"{_STRAIGHT} {_again}", "img", "image_id y x a r g b")


def _sizes(s, d):
    from glyphgrid.sources import files

    return files.written_size(images(s, d), "BMP")


query("o3_13_counted_size", _sizes, "SELECT image_id, 54 + h * ((w * CASE WHEN bool_or(a <> 255) THEN 4 ELSE 3 END + 3) // 4 * 4) AS size FROM img GROUP BY image_id, w, h", "img", "image_id size")

# More of the survey's small operators

_EV = lambda s, d: s.read.parquet(f"{d}/events.parquet")



def _found_in_copy(s, d):
    """The dictionary at each place of a set, and the one at the same place of its copy; none where the sets are of different sizes."""
    parts = lambda c: F.array(*[F.slice(F.col(c), k * 16 + 1, 16) for k in range(4)])
    sets = histograms(s, d).select("image_id", parts(C1).alias("own"), parts(C2).alias("copy"))
    sets = sets.withColumn("copy", F.when(F.col("image_id") % 5 == 0, F.slice("copy", 1, 3)).otherwise(F.col("copy")))
    own, copy = (sets.select("image_id", F.size(c).alias("size"), F.posexplode(c).alias("place", c)) for c in ("own", "copy"))
    both = own.join(copy, ["image_id", "size", "place"], "left")
    return both.select("image_id", "place", histo.total(F.col("own")).alias("symbols"), histo.total(F.col("copy")).alias("symbols2"))


query("o6_17_same_position", _found_in_copy, "SELECT image_id, sym // 16 AS place, sum(c) AS symbols, sum(CASE WHEN image_id % 5 <> 0 THEN c2 END) AS symbols2 FROM hist GROUP BY ALL", "hist", "image_id place symbols symbols2")



def _label_stats(s, d):
    """Each tile's map from value to count, then the maps of a label merged."""
    of_tiles = _EV(s, d).groupBy("event_type", (F.col("user_id") % 16).alias("tile"), F.length("props").cast("long").alias("value")).agg(F.count("*").alias("n"))
    of_tiles = of_tiles.groupBy("event_type", "tile").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("values"))
    each = of_tiles.select("event_type", F.explode("values").alias("value", "n"))
    return each.groupBy("event_type", "value").agg(F.sum("n").alias("occurrences"), F.sum(F.col("value") * F.col("n")).alias("bits"))


query("o8_34_label_stats", _label_stats, "SELECT event_type, length(props) AS value, count(*) AS occurrences, sum(length(props)) AS bits FROM events GROUP BY ALL", "", "value occurrences bits", strings="event_type")
query("o8_35_cluster_counts", lambda s, d: grid.exploded(images(s, d), "r", "g").groupBy("image_id", (F.col("g") % 3).alias("cluster"), (F.col("r") % 16).alias("sym")).agg(F.count("*").alias("n")), "SELECT image_id, g % 3 AS cluster, r % 16 AS sym, count(*) AS n FROM img GROUP BY ALL", "img", "image_id cluster sym n")


def _context_fit(s, d):
    """For each 4x4 block that has one: the fit over its context, the pixels left of it and those above, corners included."""
    rows = grid.exploded(images(s, d), "g", "b")
    left = F.when(F.col("x") % 4 == 3, F.struct(idiv(F.col("y"), 4).alias("by"), (idiv(F.col("x"), 4) + 1).alias("bx")))
    above = [F.when(F.col("y") % 4 == 3, F.struct((idiv(F.col("y"), 4) + 1).alias("by"), (idiv(F.col("x"), 4) + k).alias("bx"))) for k in (0,)]
    corners = [F.when((F.col("y") % 4 == 3) & (F.col("x") % 4 == at), F.struct((idiv(F.col("y"), 4) + 1).alias("by"), (idiv(F.col("x"), 4) + k).alias("bx"))) for at, k in ((3, 1), (0, -1))]
    seen = rows.select("image_id", "g", "b", F.explode(F.array_compact(F.array(left, *above, *corners))).alias("k")).select("image_id", "k.*", "g", "b")
    blocks = rows.select("image_id", idiv(F.col("y"), 4).alias("by"), idiv(F.col("x"), 4).alias("bx")).distinct()
    found = seen.join(blocks, ["image_id", "by", "bx"], "left_semi").groupBy("image_id", "by", "bx").agg(F.collect_list(F.struct("g", "b")).alias("p"))
    return found.select("image_id", "by", "bx", moments.line_fit(F.transform("p", lambda v: v["g"]), F.transform("p", lambda v: v["b"])).alias("f")).select("image_id", "by", "bx", "f.*")


_CONTEXT = "(SELECT o.image_id, o.by, o.bx, p.g, p.b FROM (SELECT DISTINCT image_id, y // 4 AS by, x // 4 AS bx FROM img) o JOIN img p ON p.image_id = o.image_id AND (p.x = 4 * o.bx - 1 AND p.y BETWEEN 4 * o.by - 1 AND 4 * o.by + 3 OR p.y = 4 * o.by - 1 AND p.x BETWEEN 4 * o.bx AND 4 * o.bx + 4)) c"
query("o9_7_context_fit", _context_fit, _FIT.replace("SELECT image_id, count(*)", "SELECT image_id, \"by\", bx, count(*)").replace("FROM img GROUP BY image_id)", f"FROM {_CONTEXT} GROUP BY image_id, \"by\", bx)").replace("SELECT image_id, CASE", "SELECT image_id, \"by\", bx, CASE"), "img", "image_id by bx a b")
_parse = lambda s, d: predict.hash_cached(grid.exploded(images(s, d)).withColumns({c: F.floor(F.col(c) / 64) for c in CH}), 4)
query("o10_22_literals_and_hits", lambda s, d: _parse(s, d).select("image_id", "y", "x", F.when(F.col("hit"), "cache").otherwise("literal").alias("kind"), F.when(F.col("hit"), F.col("slot")).otherwise(((F.col("a") * 256 + F.col("r")) * 256 + F.col("g")) * 256 + F.col("b")).alias("value")), "WITH t AS (SELECT image_id, y, x, y * w + x AS p, ((a // 64 * 256 + r // 64) * 256 + g // 64) * 256 + b // 64 AS v FROM img), h AS (SELECT *, (v * 506832829) % 4294967296 // 268435456 AS slot FROM t), k AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY image_id, slot ORDER BY p), 4294967295) = v AS hit FROM h) SELECT image_id, y, x, CASE WHEN hit THEN 'cache' ELSE 'literal' END AS kind, CASE WHEN hit THEN slot ELSE v END AS value FROM k", "img", "image_id y x value", strings="kind")
_place = lambda s, d, *order: rect_pairs(s, d).select("id", (F.col("id") % 20).alias("k"), F.row_number().over(Window.partitionBy(F.col("id") % 20).orderBy(*order)).alias("place"))
query("o11_3_blocks_in_order", lambda s, d: _place(s, d, "y", "x", "id"), "SELECT id, id % 20 AS k, row_number() OVER (PARTITION BY id % 20 ORDER BY y * 1000 + x, id) AS place FROM rect_pairs", "rect_pairs", "id k place")
query("o11_5_area_major", lambda s, d: _place(s, d, idiv(F.col("y"), 2), idiv(F.col("x"), 2), "y", "x", "id"), "SELECT id, id % 20 AS k, row_number() OVER (PARTITION BY id % 20 ORDER BY y // 2 * 100 + x // 2, y * 1000 + x, id) AS place FROM rect_pairs", "rect_pairs", "id k place")
query("o11_6_best_of_group", lambda s, d: rect_pairs(s, d).groupBy((F.col("id") % 20).alias("k")).agg(F.min_by("id", F.struct(-F.col("w") * F.col("h"), "id")).alias("id"), F.max(F.col("w") * F.col("h")).alias("area")), "SELECT k, id, area FROM (SELECT id % 20 AS k, id, w * h AS area, row_number() OVER (PARTITION BY id % 20 ORDER BY w * h DESC, id) AS n FROM rect_pairs) t WHERE n = 1", "rect_pairs", "k id area")
query("o11_18_score", lambda s, d: rect_pairs(s, d).select("id", fixed.partition_score(F.col("id") % 100, F.col("w"), F.col("h"), F.col("w2"), F.col("h2")).alias("score")), "WITH t AS (SELECT *, greatest(0.01::DOUBLE, least(0.99::DOUBLE, (id % 100) / 95.0::DOUBLE)) AS q FROM rect_pairs) SELECT id, CASE WHEN w2 > w OR h2 > h THEN 0 ELSE 1 / (1 + q * CASE WHEN w > 0 THEN w2 / w ELSE 1 END + (1 - q) * CASE WHEN h > 0 THEN h2 / h ELSE 1 END) END AS score FROM t", "rect_pairs", "id", doubles="score")



def _appended(s, d):
    """Both images' dictionaries, one for each channel, in one set: the second's behind the first's."""
    both = pairs(s, d)
    own, other = (F.array(*[histo.counts_of(F.transform(f"{c}{k}", lambda v: v % 16), 16) for c in CH]) for k in ("", "2"))
    rows = both.select("image_id", F.posexplode(F.concat(own, other)).alias("place", "counts"))
    return rows.select("image_id", "place", F.posexplode("counts").alias("sym", "n"))


query("o12_1_appended_dictionaries", _appended, "WITH v AS (SELECT image_id, unnest([a, r, g, b, a2, r2, g2, b2]) % 16 AS s, unnest(range(0, 8)) AS place FROM pair), c AS (SELECT image_id, place, s, count(*) AS n FROM v GROUP BY ALL) SELECT i.image_id, p.p AS place, s.s AS sym, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT image_id FROM pair) i CROSS JOIN range(0, 8) p(p) CROSS JOIN range(0, 16) s(s) LEFT JOIN c ON c.image_id = i.image_id AND c.place = p.p AND c.s = s.s", "pair", "image_id place sym n")
query("o12_2_appended_streams", lambda s, d: pairs(s, d).select("image_id", F.posexplode(F.concat("r", "r2")).alias("i", "v")), "SELECT image_id, y * w + x AS i, r AS v FROM pair UNION ALL SELECT image_id, w * h + y * w + x AS i, r2 AS v FROM pair", "pair", "image_id i v")
query("o12_3_erased_range", lambda s, d: images(s, d).select("image_id", F.posexplode(F.concat(F.slice("r", F.lit(1), F.lit(3)), F.slice("r", F.lit(7), F.greatest(F.size("r") - 6, F.lit(0))))).alias("i", "v")), "SELECT image_id, CASE WHEN y * w + x < 3 THEN y * w + x ELSE y * w + x - 3 END AS i, r AS v FROM img WHERE y * w + x < 3 OR y * w + x >= 6", "img", "image_id i v")
query("o13_26_predicted_chroma", lambda s, d: images(s, d).select("image_id", F.posexplode(moments.predicted_chroma(F.col("g"), F.col("image_id") % 700 - 300, F.col("image_id") % 90, -200, 200)).alias("i", "v")), "SELECT image_id, y * w + x AS i, greatest(-200, least(200, floor((g * (image_id % 700 - 300) + (image_id % 90) * 64 + 128) / 256.0))) AS v FROM img", "img", "image_id i v")
query("o13_36_forward_2d", lambda s, d: _spread(blocks(s, d).select("image_id", "k", kernels.separable(F.col("v"), 4, 4, kernels.dct4).alias("p"))), "", "", "image_id k i v")
query("o13_37_inverse_2d", lambda s, d: _spread(blocks(s, d).select("image_id", "k", kernels.separable(F.col("v"), 4, 4, kernels.inverse_dct4).alias("p"))), "", "", "image_id k i v")
_four = "l AS (SELECT image_id, k, list(v ORDER BY y, x) AS c FROM blocks GROUP BY image_id, k)"
_halve = lambda e, bits: f"floor(({e} + {1 << bits - 1}) / {1 << bits}.0)"
_F4 = (_halve("c[1] + c[2] + c[3] + c[4]", 1), _halve("277 * (c[2] - c[3]) + 669 * (c[1] - c[4])", 10), _halve("c[1] + c[4] - c[2] - c[3]", 1), _halve("277 * (c[1] - c[4]) - 669 * (c[2] - c[3])", 10))
_IL, _IH = _halve("554 * c[2] - 1337 * c[4]", 10), _halve("1337 * c[2] + 554 * c[4]", 10)
_I4 = tuple(f"floor(({e}) / 2.0)" for e in (f"c[1] + c[3] + {_IH}", f"c[1] - c[3] + {_IL}", f"c[1] - c[3] - {_IL}", f"c[1] + c[3] - {_IH}"))
_1d = lambda parts: f"{E}, {_four} " + " UNION ALL ".join(f"SELECT image_id, k, {i} AS i, {e} AS v FROM l" for i, e in enumerate(parts))
query("o13_29_forward_dct4", lambda s, d: _spread(blocks(s, d).select("image_id", "k", kernels.dct4(F.col("v")).alias("p"))), _1d(_F4), "", "image_id k i v")
query("o13_30_inverse_dct4", lambda s, d: _spread(blocks(s, d).select("image_id", "k", kernels.inverse_dct4(F.col("v")).alias("p"))), _1d(_I4), "", "image_id k i v")



def _skips(s, d, most: int = 40):
    """Final frames that are given out: those that no call before them has skipped. Clicks are the calls; the sum is held at most."""
    calls = F.when(F.col("event_type") == "click", F.least(F.col("event_id") % 4, F.lit(most))).otherwise(0)
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _EV(s, d).select(F.col("user_id").alias("anim_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("frame_idx"), F.least(F.lit(most), F.coalesce(F.sum(calls).over(before), F.lit(0))).alias("skipped"))
    found = fr.final_index(frames(s, d)).filter("duration_ms > 0").join(rows, ["anim_id", "frame_idx"])
    return found.select("anim_id", "frame_idx", "final_idx", "skipped", (F.col("final_idx") >= F.col("skipped")).alias("given"))


query("o15_10_skips", _skips, f"WITH {_FINAL}, e AS (SELECT user_id AS anim_id, row_number() OVER u - 1 AS frame_idx, least(40, coalesce(sum(CASE WHEN event_type = 'click' THEN event_id % 4 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS skipped FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT f.anim_id, f.frame_idx, final_idx, skipped, final_idx >= skipped AS given FROM f JOIN e USING (anim_id, frame_idx) WHERE duration_ms > 0", "frames", "anim_id frame_idx final_idx skipped", bools="given")
query("o2_17_whole_files", lambda s, d: s.read.format("binaryFile").load(f"{d}/nation.parquet").select(F.octet_length("content").alias("size"), F.lit(1).alias("n")), "", "", "size n")
