"""Queries on rasters: geometry, layouts, colour, compositing, palettes and predictors, each with DuckDB SQL of its own.

The Spark side works on arrays, the SQL on a row for each pixel with joins, so the two are separate statements.
"""

from pyspark.sql import functions as F

from glyphgrid.functions.fixed import idiv
from glyphgrid.operators import color, composite, fit, geometry, grid, multipliers, predict
from glyphgrid.plans.fixtures import images, over_255, pairs, raw_images, rect_pairs, table
from glyphgrid.plans.query import Query

CH = grid.CHANNELS
PX = "image_id y x a r g b"
QUERIES: dict = {}
BACKGROUND = {"a": 200, "r": 10, "g": 100, "b": 180}
PALETTE = [(a, r, g, b) for a in (128, 255) for r in (60, 120) for g in (40, 160) for b in (80, 200)]


def query(name: str, build, sql: str, needs: str, ints: str = PX, **kinds) -> None:
    QUERIES[name] = Query(build, sql, tuple(needs.split()), ints, **kinds)


def _list(template: str, names=CH) -> str:
    return ", ".join(template.replace("@", c) for c in names)


# Rectangles and orientations

def R1():
    return [F.col(c) for c in ("x", "y", "w", "h")]


def R2():
    return [F.col(f"{c}2") for c in ("x", "y", "w", "h")]


_INSIDE = "x2 >= x AND x2 < x + w AND y2 >= y AND y2 < y + h"
query("o4_1_rect_area", lambda s, d: rect_pairs(s, d).select("id", geometry.area(F.col("w"), F.col("h")).alias("area")), "SELECT id, w * h AS area FROM rect_pairs", "rect_pairs", "id area")
query("o4_2_point_in_rect", lambda s, d: rect_pairs(s, d).select("id", geometry.holds_point(*R1(), *R2()[:2]).alias("inside")), f"SELECT id, {_INSIDE} AS inside FROM rect_pairs", "rect_pairs", "id", bools="inside")
query("o4_3_rect_contains", lambda s, d: rect_pairs(s, d).select("id", geometry.holds(*R1(), *R2()).alias("holds")), f"SELECT id, {_INSIDE} AND (w2 * h2 = 0 OR (x2 + w2 <= x + w AND y2 + h2 <= y + h)) AS holds FROM rect_pairs", "rect_pairs", "id", bools="holds")
query("o4_4_rect_intersects", lambda s, d: rect_pairs(s, d).select("id", geometry.meets(*R1(), *R2()).alias("meets")), "SELECT id, (x = x2 AND w + w2 > 0 OR x < x2 AND x2 < x + w OR x2 < x AND x < x2 + w2) AND (y = y2 AND h + h2 > 0 OR y < y2 AND y2 < y + h OR y2 < y AND y < y2 + h2) AS meets FROM rect_pairs", "rect_pairs", "id", bools="meets")
_rect = lambda parts: [p.alias(n) for p, n in zip(parts, ("x", "y", "w", "h"))]
query("o4_5_rect_clip", lambda s, d: rect_pairs(s, d).select("id", *_rect(geometry.clipped(*R1(), *R2()))), "SELECT id, greatest(x, x2) AS x, greatest(y, y2) AS y, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) AS w, greatest(0, least(y + h, y2 + h2) - greatest(y, y2)) AS h FROM rect_pairs", "rect_pairs", "id x y w h")
query("o4_6_rect_merge", lambda s, d: rect_pairs(s, d).select("id", *_rect(geometry.merged(*R1(), *R2()))), "SELECT id, list_min([x, x2]) AS x, list_min([y, y2]) AS y, list_max([x + w, x2 + w2]) - list_min([x, x2]) AS w, list_max([y + h, y2 + h2]) - list_min([y, y2]) AS h FROM rect_pairs", "rect_pairs", "id x y w h")


def O():
    """Quarter turns."""
    return F.col("id") % 4


query("o4_17_rotated_size", lambda s, d: rect_pairs(s, d).select("id", *[v.alias(n) for v, n in zip(geometry.rotated_size(O(), F.col("w"), F.col("h")), ("w", "h"))]), "SELECT id, [w, h, w, h][id % 4 + 1] AS w, [h, w, h, w][id % 4 + 1] AS h FROM rect_pairs", "rect_pairs", "id w h")
query("o4_18_rotated_x", lambda s, d: rect_pairs(s, d).select("id", geometry.rotated_point(O(), F.lit(9), F.lit(7), F.col("x"), F.col("y"))[0].alias("x")), "SELECT id, [x, 6 - y, 8 - x, y][id % 4 + 1] AS x FROM rect_pairs", "rect_pairs", "id x")
query("o4_19_rotated_y", lambda s, d: rect_pairs(s, d).select("id", geometry.rotated_point(O(), F.lit(9), F.lit(7), F.col("x"), F.col("y"))[1].alias("y")), "SELECT id, [y, x, 6 - y, 8 - x][id % 4 + 1] AS y FROM rect_pairs", "rect_pairs", "id y")
query("o4_20_rotated_rect", lambda s, d: rect_pairs(s, d).select("id", *_rect(geometry.rotated_rect(O(), F.lit(9), F.lit(8), *R1()))), "SELECT id, [x, 8 - y - greatest(h, 1), 9 - x - greatest(w, 1), y][id % 4 + 1] AS x, [y, x, 8 - y - greatest(h, 1), 9 - x - greatest(w, 1)][id % 4 + 1] AS y, [w, h, w, h][id % 4 + 1] AS w, [h, w, h, w][id % 4 + 1] AS h FROM rect_pairs", "rect_pairs", "id x y w h")


def IO():
    return F.col("image_id") % 4


_TURN = "SELECT image_id, [y, x, h - 1 - y, w - 1 - x][image_id % 4 + 1] AS y, [x, h - 1 - y, w - 1 - x, y][image_id % 4 + 1] AS x, a, r, g, b FROM "
query("o4_21_rotate", lambda s, d: grid.exploded(geometry.rotate(images(s, d), IO())), _TURN + "img", "img")


def spot() -> tuple:
    """A place in each image."""
    return (F.col("image_id") % F.col("w")).cast("int"), (F.col("image_id") % F.col("h")).cast("int")


def window() -> tuple:
    """What lies right of and below it."""
    x, y = spot()
    return x, y, F.col("w") - x, F.col("h") - y


_WINDOW = "(SELECT image_id, w - image_id % w AS w, h - image_id % h AS h, y - image_id % h AS y, x - image_id % w AS x, a, r, g, b FROM img WHERE y >= image_id % h AND x >= image_id % w) t"
query("o4_22_rotate_window", lambda s, d: grid.exploded(geometry.rotate_window(images(s, d), IO(), *window())), _TURN + _WINDOW, "img")

# Windows and resampling

query("o4_7_crop", lambda s, d: grid.exploded(geometry.crop(images(s, d), *window())), f"SELECT image_id, y, x, a, r, g, b FROM {_WINDOW}", "img")
query("o4_8_fill", lambda s, d: grid.exploded(geometry.fill(images(s, d), F.lit(1), F.lit(2), F.lit(3), F.lit(2), BACKGROUND)), "SELECT image_id, y, x, " + ", ".join(f"CASE WHEN x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 3 THEN {BACKGROUND[c]} ELSE {c} END AS {c}" for c in CH) + " FROM img", "img")
query("o4_9_border", lambda s, d: grid.exploded(geometry.border(images(s, d), F.lit(1), F.lit(1), F.lit(4), F.lit(3), BACKGROUND)), "SELECT image_id, y, x, " + ", ".join(f"CASE WHEN (x IN (1, 4) AND y BETWEEN 1 AND 3) OR (y IN (1, 3) AND x BETWEEN 1 AND 4) THEN {BACKGROUND[c]} ELSE {c} END AS {c}" for c in CH) + " FROM img", "img")
query("o4_29_fill_outside", lambda s, d: grid.exploded(geometry.fill_outside(images(s, d), F.lit(1), F.lit(2), F.lit(3), F.lit(2), BACKGROUND)), "SELECT image_id, y, x, " + ", ".join(f"CASE WHEN x IN (1, 2, 3) AND y IN (2, 3) THEN {c} ELSE {BACKGROUND[c]} END AS {c}" for c in CH) + " FROM img", "img")
query("o4_23_rescale", lambda s, d: grid.exploded(geometry.rescale(images(s, d), F.lit(5), F.lit(3))), "SELECT i.image_id, j.j AS y, k.k AS x, i.a, i.r, i.g, i.b FROM img i, range(0, 3) j(j), range(0, 5) k(k) WHERE i.y = j.j * i.h // 3 AND i.x = k.k * i.w // 5", "img")
query("o4_24_half", lambda s, d: grid.exploded(geometry.half(images(s, d))), "WITH t AS (SELECT *, y // 2 AS v, x // 2 AS u, h % 2 = 1 AND y = h - 1 AS lone, w % 2 = 1 AND x = w - 1 AS side FROM img) SELECT image_id, v AS y, u AS x, " + _list("CASE WHEN bool_or(side) THEN min(CASE WHEN y % 2 = 0 THEN @ END) ELSE (sum(CASE WHEN lone THEN 2 * @ ELSE @ END) + 2) // 4 END AS @") + " FROM t GROUP BY image_id, v, u", "img")
_TAPS = "SELECT * FROM (VALUES (-1, -2), (0, 10), (1, 10), (2, -2)) v(d, t)"
query("o4_25_plane_half", lambda s, d: grid.exploded(geometry.plane_half(images(s, d)), "r"), f"WITH taps AS ({_TAPS}), o AS (SELECT DISTINCT image_id, w, h, y // 2 AS y, x // 2 AS x FROM img) SELECT o.image_id, o.y, o.x, floor((sum(p.r * a.t * b.t) + 128) / 256.0) AS r FROM o, taps a, taps b JOIN img p ON p.image_id = o.image_id AND p.x = greatest(0, least(o.w - 1, 2 * o.x + a.d)) AND p.y = greatest(0, least(o.h - 1, 2 * o.y + b.d)) GROUP BY o.image_id, o.y, o.x", "img", "image_id y x r")
_UP = "SELECT * FROM (VALUES (0, -2, 1), (0, -1, 3), (0, 0, 11), (0, 1, 1), (1, -1, 1), (1, 0, 11), (1, 1, 3), (1, 2, 1)) v(odd, d, t)"
query("o4_26_plane_double", lambda s, d: grid.exploded(geometry.plane_double(images(s, d), 2 * F.col("w") - IO() % 2, 2 * F.col("h")), "r"), f"WITH taps AS ({_UP}), o AS (SELECT image_id, w, h, 2 * y + j.j AS y, 2 * x + i.i AS x FROM img, range(0, 2) i(i), range(0, 2) j(j) WHERE 2 * x + i.i < 2 * w - image_id % 2) SELECT o.image_id, o.y, o.x, floor((sum(p.r * a.t * b.t) + 128) / 256.0) AS r FROM o, taps a, taps b JOIN img p ON p.image_id = o.image_id AND p.x = greatest(0, least(o.w - 1, o.x // 2 + a.d)) AND p.y = greatest(0, least(o.h - 1, o.y // 2 + b.d)) WHERE a.odd = o.x % 2 AND b.odd = o.y % 2 GROUP BY o.image_id, o.y, o.x", "img", "image_id y x r")
query("o4_27_tap_sample", lambda s, d: images(s, d).select("image_id", geometry.sample(F.col("g"), F.col("w"), F.col("h"), *spot(), geometry.DOWN_SHARP, geometry.UP_FULL).alias("g")), f"WITH across AS ({_TAPS}), down AS (SELECT d, t FROM ({_UP}) WHERE odd = 0) SELECT o.image_id, floor((sum(p.g * a.t * b.t) + 128) / 256.0) AS g FROM img o, across a, down b JOIN img p ON p.image_id = o.image_id AND p.x = greatest(0, least(o.w - 1, o.x + a.d)) AND p.y = greatest(0, least(o.h - 1, o.y + b.d)) WHERE o.x = o.image_id % o.w AND o.y = o.image_id % o.h GROUP BY o.image_id", "img", "image_id g")
query("o4_28_pad", lambda s, d: grid.exploded(geometry.padded(images(s, d), 4)), "SELECT i.image_id, j.j AS y, k.k AS x, i.a, i.r, i.g, i.b FROM img i, range(0, 68) j(j), range(0, 68) k(k) WHERE j.j < (i.h + 3) // 4 * 4 AND k.k < (i.w + 3) // 4 * 4 AND i.y = least(j.j, i.h - 1) AND i.x = least(k.k, i.w - 1)", "img")
_DIFF = "SELECT image_id, y, x, " + _list("abs(@ - @2) AS @") + " FROM pair"
query("o4_30_difference_scaled", lambda s, d: grid.exploded(geometry.difference(pairs(s, d), True)), f"WITH t AS ({_DIFF}) SELECT image_id, y, x, " + _list("CASE WHEN max(@) OVER i = 0 THEN 0 ELSE (@ * (16711680 // max(@) OVER i) + 32768) // 65536 END AS @") + " FROM t WINDOW i AS (PARTITION BY image_id)", "pair")
query("o4_31_difference", lambda s, d: grid.exploded(geometry.difference(pairs(s, d))), _DIFF, "pair")
query("o4_32_luma", lambda s, d: grid.exploded(geometry.luma(images(s, d))), "WITH t AS (SELECT image_id, y, x, a, floor(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b + 0.5::DOUBLE) AS v FROM img) SELECT image_id, y, x, a, v AS r, v AS g, v AS b FROM t", "img")

# Layouts and depths

LAYOUT_NAMES = list(geometry.LAYOUTS)


def _LAYOUT():
    return F.get(F.array(*[F.lit(n) for n in LAYOUT_NAMES]), (F.col("image_id") % len(LAYOUT_NAMES)).cast("int"))


def _samples(s, d):
    return raw_images(s, d).select("image_id", "w", "h", *[F.col(c).alias(f"s{k}") for k, c in enumerate(CH)])


def _import_sql(source: str) -> str:
    rows = []
    for k, (name, (*places, premultiplied)) in enumerate(geometry.LAYOUTS.items()):
        s = [("a", "r", "g", "b")[p] if p >= 0 else "255" for p in places]
        v = [c if premultiplied or places[0] < 0 else f"CASE WHEN {s[0]} < 255 THEN {over_255(f'{c} * {s[0]}')} ELSE {c} END" for c in s[1:]]
        rows.append(f"SELECT image_id, y, x, {s[0]} AS a, {v[0]} AS r, {v[1]} AS g, {v[2]} AS b FROM {source} WHERE image_id % {len(LAYOUT_NAMES)} = {k}")
    return " UNION ALL ".join(rows)


query("o4_11_import", lambda s, d: grid.exploded(geometry.imported(_samples(s, d), _LAYOUT())), _import_sql("raw"), "raw")
query("o4_12_import_row", lambda s, d: grid.exploded(geometry.row_of(geometry.imported(_samples(s, d), _LAYOUT()), spot()[1])), _import_sql("(SELECT * EXCLUDE (y), 0 AS y FROM raw WHERE y = image_id % h) t"), "raw")


def _convert_sql() -> str:
    rows = []
    for k, (name, (*places, premultiplied)) in enumerate(geometry.LAYOUTS.items()):
        out = ["NULL"] * 4
        for p, c in zip(places, CH):
            if p >= 0:
                straight = f"CASE WHEN a = 0 THEN 0 ELSE least(255, ({c} * ((16711680 + a - 1) // a) + 32768) // 65536) END"
                out[p] = c if premultiplied or c == "a" else straight
        if "X" in name:
            out[0 if name == "XRGB" else 3] = "255"
        rows.append(f"SELECT image_id, y, x, {', '.join(f'{v} AS s{i}' for i, v in enumerate(out))} FROM img WHERE image_id % {len(LAYOUT_NAMES)} = {k}")
    return " UNION ALL ".join(rows)


query("o4_13_convert", lambda s, d: grid.exploded(geometry.converted(images(s, d), _LAYOUT()), "s0", "s1", "s2", "s3"), _convert_sql(), "img", "image_id y x s0 s1 s2 s3")
query("o4_10_transparency", lambda s, d: images(s, d).select("image_id", F.exists("a", lambda v: v != 255).alias("has_transparency")), "SELECT image_id, bool_or(a <> 255) AS has_transparency FROM img GROUP BY image_id", "img", "image_id", bools="has_transparency")
query("o4_14_premultiply", lambda s, d: grid.exploded(images(s, d)), "SELECT * EXCLUDE (w, h) FROM img", "img")
query("o4_15_unmultiply", lambda s, d: grid.exploded(geometry.converted(images(s, d), F.lit("ARGB")), "s0", "s1", "s2", "s3"), "SELECT image_id, y, x, a AS s0, " + ", ".join(f"CASE WHEN a = 0 THEN 0 ELSE least(255, ({c} * ((16711680 + a - 1) // a) + 32768) // 65536) END AS s{k}" for k, c in ((1, "r"), (2, "g"), (3, "b"))) + " FROM img", "img", "image_id y x s0 s1 s2 s3")


def _depths(s, d):
    rows = grid.exploded(images(s, d))
    ten = [geometry.to_ten_bits(F.col(c)).alias(f"{c}10") for c in "rgb"]
    four = [geometry.to_four_bits(F.col(c), F.col("a")).alias(f"{c}4") for c in "rgb"]
    back = [geometry.from_four_bits(geometry.to_four_bits(F.col(c), F.col("a"))).alias(f"{c}8") for c in "rgb"]
    r, g, b = (F.col(c) for c in "rgb")
    small = [F.shiftright("a", 7).alias("a1"), F.shiftright(1 + 2 * g + r + b, 4).alias("y6"), F.shiftright(256 + r - b, 3).alias("co6"), F.shiftright(512 + 2 * g - r - b, 4).alias("cg6")]
    return rows.select("image_id", "y", "x", *ten, *four, *back, *small)


query("o4_16_depths", _depths, "WITH t AS (SELECT image_id, y, x, a, r, g, b, " + _list("CASE WHEN a = 0 THEN 15 ELSE @ * 255 // a // 16 END AS @4", "rgb") + " FROM img) SELECT image_id, y, x, " + _list("4 * @ + @ // 64 AS @10, @4, 17 * @4 AS @8", "rgb") + ", a // 128 AS a1, (1 + g + g + r + b) // 16 AS y6, (256 + r - b) // 8 AS co6, (512 + g + g - r - b) // 16 AS cg6 FROM t", "img", "image_id y x r10 g10 b10 r4 g4 b4 r8 g8 b8 a1 y6 co6 cg6")


def _PATH():
    return F.concat(F.lit("dir.x/img_"), F.col("event_id").cast("string"), F.get(F.array(*[F.lit(e) for e in (".png", ".JPG", ".jpeg", ".bmp", ".Pgm", ".tar.ppm", ".txt", "", ".webp", ".gif", ".TIFF")]), (F.col("event_id") % 11).cast("int")))


query("o4_33_extension", lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), geometry.format_of(_PATH()).alias("format")), "SELECT event_id AS id, ['PNG', 'JPEG', 'JPEG', 'BMP', 'PGM', 'PPM', 'UNSUPPORTED', 'UNSUPPORTED', 'WEBP', 'GIF', 'TIFF'][event_id % 11 + 1] AS format FROM events", "", "id", strings="format")

# Colour spaces

YUV = color.YUV


def _to_yuv(kind: str, source: str = "img") -> str:
    """By the rounded inverse matrix, which is worked out by numpy elsewhere in the tests."""
    m = color.transform(kind)[1]
    low, high, _ = color.bounds(m)
    rows = [f"greatest({low}, least({high}, floor(({m[k]} * (r - 128) + {m[k + 1]} * (g - 128) + {m[k + 2]} * (b - 128) + 2048) / 4096.0)::BIGINT)) AS {n}" for k, n in zip((0, 3, 6), YUV)]
    return f"SELECT image_id, w, h, y, x, a, {', '.join(rows)} FROM {source}"


def _to_rgb(kind: str, top: str = "255") -> str:
    m = color.TO_RGB[kind]
    return ", ".join(f"greatest(0, least({top}, 128 + floor(({m[k]} * yy + {m[k + 1]} * uu + {m[k + 2]} * vv + 2048) / 4096.0)::BIGINT)) AS {c}" for k, c in zip((0, 3, 6), "rgb"))


for _n, _kind in ((3, "YCoCg"), (4, "YCbCr"), (5, "YIQ")):
    query(f"o5_{_n}_{_kind.lower()}", lambda s, d, k=_kind: grid.exploded(color.planes(images(s, d), k), *YUV), f"WITH t AS ({_to_yuv(_kind)}) SELECT image_id, y, x, yy, uu, vv FROM t", "img", "image_id y x yy uu vv")


def _custom(s, d):
    """A matrix in fixed point from the first nine values of each vector, and its inverse where it has one in range."""
    entry = lambda k: (F.floor(F.col("embedding")[k].cast("double") * 1500) + (2000 if k % 4 == 0 else 0)).cast("long")
    rows = grid.held(table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.array(*[entry(k) for k in range(9)]).alias("im")), im=F.col("im"))
    back = [v * float(1 << 2 * color.SHIFT) for v in fit.inverse([F.col("im")[k].cast("double") for k in range(9)])]
    rows = grid.held(rows, back=F.array(*[(F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("long") for v in back]))
    return rows.withColumn("fits", F.coalesce(F.forall("back", lambda v: F.abs(v) <= color.MOST), F.lit(False)))


def _inverse_sql() -> str:
    """The inverse in SQL: adjugate over determinant, rounded half away from zero."""
    m = ", ".join(f"floor(embedding[{k + 1}]::DOUBLE * 1500)::BIGINT{' + 2000' if k % 4 == 0 else ''}" for k in range(9))
    at = lambda i, j: f"m[{3 * (i % 3) + j % 3 + 1}]::DOUBLE"
    minor = lambda i, j: f"({at(i + 1, j + 1)} * {at(i + 2, j + 2)} - {at(i + 1, j + 2)} * {at(i + 2, j + 1)})"
    det = f"({at(0, 0)} * {minor(0, 0)} + {at(0, 1)} * {minor(0, 1)} + {at(0, 2)} * {minor(0, 2)})"
    back = ", ".join(f"round({minor(i, j)} / {det} * 16777216)" for j in range(3) for i in range(3))
    return f"t AS (SELECT vec_id AS image_id, [{m}] AS m FROM embeddings), b AS (SELECT image_id, m, CASE WHEN {det} <> 0 THEN [{back}] END AS back FROM t), f AS (SELECT *, coalesce(list_max(back) <= {color.MOST} AND list_min(back) >= -{color.MOST}, false) AS fits FROM b)"


query("o5_1_transform", lambda s, d: _custom(s, d).select("image_id", F.posexplode(F.arrays_zip("im", "back")).alias("i", "p"), "fits").select("image_id", "i", "p.im", F.when(F.col("fits"), F.col("p.back")).alias("m")), f"WITH {_inverse_sql()} SELECT image_id, i, m[i + 1] AS im, CASE WHEN fits THEN back[i + 1] END AS m FROM (SELECT *, unnest(range(0, 9)) AS i FROM f)", "", "image_id i im m")
query("o5_6_rgb_to_yuv", lambda s, d: grid.exploded(images(s, d)).select("image_id", "y", "x", *[v.alias(n) for v, n in zip(color.rgb_to_yuv(F.col("r"), F.col("g"), F.col("b"), "YIQ"), YUV)]), f"WITH t AS ({_to_yuv('YIQ')}) SELECT image_id, y, x, yy, uu, vv FROM t", "img", "image_id y x yy uu vv")
query("o5_7_yuv_to_rgb", lambda s, d: grid.exploded(color.from_planes(color.planes(images(s, d), "YCbCr"), "YCbCr")), f"WITH t AS ({_to_yuv('YCbCr')}) SELECT image_id, y, x, 255 AS a, {_to_rgb('YCbCr')} FROM t", "img")
query("o5_11_round_trip", lambda s, d: grid.exploded(color.round_trip_error(images(s, d)), "error"), "SELECT image_id, y, x, 0 AS error FROM img", "img", "image_id y x error")
_CUSTOM = (1000, -200, 30, 50, 900, -70, 10, 20, 1100)
_OFFSET = (5, -3, 7)
query("o5_20_yuv_to_custom", lambda s, d: grid.exploded(color.to_custom(color.planes(images(s, d), "YCoCg"), _CUSTOM, _OFFSET), *YUV), f"WITH t AS ({_to_yuv('YCoCg')}) SELECT image_id, y, x, " + ", ".join(f"floor(({_CUSTOM[k]} * (yy + 5) + {_CUSTOM[k + 1]} * (uu - 3) + {_CUSTOM[k + 2]} * (vv + 7) + 2048) / 4096.0) AS {n}" for k, n in zip((0, 3, 6), YUV)) + " FROM t", "img", "image_id y x yy uu vv")
query("o5_18_padded_planes", lambda s, d: grid.exploded(color.planes(images(s, d), "YCbCr", 4), *YUV), f"WITH t AS ({_to_yuv('YCbCr')}) SELECT t.image_id, j.j AS y, k.k AS x, yy, uu, vv FROM t, range(0, 68) j(j), range(0, 68) k(k) WHERE j.j < (h + 3) // 4 * 4 AND k.k < (w + 3) // 4 * 4 AND y = least(j.j, h - 1) AND x = least(k.k, w - 1)", "img", "image_id y x yy uu vv")
query("o5_19_planes_to_rgb", lambda s, d: grid.exploded(color.from_planes(color.planes(images(s, d), "YIQ"), "YIQ")), f"WITH t AS ({_to_yuv('YIQ')}) SELECT image_id, y, x, 255 AS a, {_to_rgb('YIQ')} FROM t", "img")
query("o5_21_yuv_to_straight", lambda s, d: grid.exploded(color.from_planes(color.planes(images(s, d), "YCbCr"), "YCbCr", "straight")), f"WITH t AS ({_to_yuv('YCbCr')}), p AS (SELECT image_id, y, x, a, {_to_rgb('YCbCr', 'a')} FROM t) SELECT image_id, y, x, a, " + _list("CASE WHEN a = 0 THEN 0 ELSE least(255, (@ * ((16711680 + a - 1) // a) + 32768) // 65536) END AS @", "rgb") + " FROM p", "img")
query("o5_22_yuv_to_premultiplied", lambda s, d: grid.exploded(color.from_planes(color.planes(images(s, d), "YCbCr"), "YCbCr", "premultiplied")), f"WITH t AS ({_to_yuv('YCbCr')}) SELECT image_id, y, x, a, {_to_rgb('YCbCr', 'a')} FROM t", "img")
query("o5_23_subtract_green", lambda s, d: grid.exploded(color.subtract_green(images(s, d))), "SELECT image_id, y, x, a, (r - g + 256) % 256 AS r, g, (b - g + 256) % 256 AS b FROM img", "img")
query("o5_24_add_green", lambda s, d: grid.exploded(color.subtract_green(images(s, d), sign=1)), "SELECT image_id, y, x, a, (r + g) % 256 AS r, g, (b + g) % 256 AS b FROM img", "img")
# The multipliers of a 4x4 tile, from its place.
_factors = lambda x, y: (3 * idiv(x, 4) - 5, 7 - 4 * idiv(y, 4), 2 + idiv(x, 4) + idiv(y, 4))
_G = "(CASE WHEN @ >= 128 THEN @ - 256 ELSE @ END)"
_delta = lambda f, c: f"floor(({f}) * {_G.replace('@', c)} / 32.0)::BIGINT"
_GR, _GB, _RB = "3 * (x // 4) - 5", "7 - 4 * (y // 4)", "2 + x // 4 + y // 4"
_mod = lambda e: f"((({e}) % 256) + 256) % 256"
query("o5_25_cross_colour", lambda s, d: grid.exploded(color.cross_colour(images(s, d), _factors)), f"SELECT image_id, y, x, a, {_mod('r - ' + _delta(_GR, 'g'))} AS r, g, {_mod('b - ' + _delta(_GB, 'g') + ' - ' + _delta(_RB, 'r'))} AS b FROM img", "img")
query("o5_26_undo_cross_colour", lambda s, d: grid.exploded(color.undo_cross_colour(images(s, d), _factors)), f"WITH t AS (SELECT *, {_mod('r + ' + _delta(_GR, 'g'))} AS q FROM img) SELECT image_id, y, x, a, q AS r, g, {_mod('b + ' + _delta(_GB, 'g') + ' + ' + _delta(_RB, 'q'))} AS b FROM t", "img")
query("o5_13_block_covariance", lambda s, d: color.block_covariance(images(s, d)), "SELECT image_id, y // 4 AS by, x // 4 AS bx, " + _list("avg(@) AS mean_@", "rgb") + ", " + ", ".join(f"covar_pop({p}, {q}) AS {p}{q}" for p in "rgb" for q in "rgb") + " FROM img WHERE y < h // 4 * 4 AND x < w // 4 * 4 GROUP BY image_id, y // 4, x // 4", "img", "image_id by bx", doubles="mean_r mean_g mean_b " + " ".join(p + q for p in "rgb" for q in "rgb"))

# Compositing and palettes

query("o6_1_pair", lambda s, d: grid.exploded(pairs(s, d), *CH, *[f"{c}2" for c in CH]), "SELECT * EXCLUDE (w, h) FROM pair", "pair", PX + " a2 r2 g2 b2")
_over = lambda top, alpha, below: f"{top} + {over_255(f'(255 - {alpha}) * {below}')}"
query("o6_2_over", lambda s, d: grid.exploded(composite.over(pairs(s, d))), "SELECT image_id, y, x, " + ", ".join(f"{_over(c, 'a', f'{c}2')} AS {c}" for c in CH) + " FROM pair", "pair")
query("o6_3_over_colour", lambda s, d: grid.exploded(composite.over_colour(images(s, d), BACKGROUND)), "SELECT image_id, y, x, " + ", ".join(f"{_over(c, 'a', str(BACKGROUND[c]))} AS {c}" for c in CH) + " FROM img", "img")
query("o6_4_under", lambda s, d: grid.exploded(composite.under(pairs(s, d), (1, 1, 3, 2))), "SELECT image_id, y, x, " + ", ".join(f"CASE WHEN x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 2 THEN {_over(f'{c}2', 'a2', c)} ELSE {c} END AS {c}" for c in CH) + " FROM pair", "pair")


def _yuv_pairs(s, d):
    own = color.planes(images(s, d), "YCbCr")
    return grid.paired(own, own.withColumn("image_id", F.col("image_id") - 64), ("a", *YUV))


_BLACK = "SELECT yy AS y0, uu AS u0, vv AS v0 FROM (" + _to_yuv("YCbCr", "(SELECT 0 AS image_id, 1 AS w, 1 AS h, 0 AS y, 0 AS x, 255 AS a, 0 AS r, 0 AS g, 0 AS b) z") + ")"
_signed = lambda v: f"floor((({v}) + floor(({v}) / 256.0) + 128) / 256.0)::BIGINT"
query("o6_5_over_planes", lambda s, d: grid.exploded(composite.over_planes(_yuv_pairs(s, d)), "a", *YUV), f"WITH t AS ({_to_yuv('YCbCr')}), z AS ({_BLACK}) SELECT p.image_id, p.y, p.x, p.a + {_signed('(255 - p.a) * q.a')} AS a, " + ", ".join(f"p.{n} + {_signed(f'(255 - p.a) * (q.{n} - {k}0)')} AS {n}" for n, k in zip(YUV, "yuv")) + " FROM t p JOIN t q ON q.image_id = p.image_id + 64 AND q.y = p.y AND q.x = p.x, z", "img", "image_id y x a yy uu vv")
_FOUND = "SELECT image_id, a, r, g, b, row_number() OVER (PARTITION BY image_id ORDER BY a, r, g, b) - 1 AS idx, count(*) OVER (PARTITION BY image_id) AS n FROM (SELECT DISTINCT image_id, a, r, g, b FROM img)"
query("o6_6_indexed", lambda s, d: grid.exploded(composite.indexed(images(s, d)), "idx"), f"WITH p AS ({_FOUND}) SELECT i.image_id, i.y, i.x, p.idx FROM img i JOIN p USING (image_id, a, r, g, b) WHERE p.n > 1", "img", "image_id y x idx")
query("o6_7_unindexed", lambda s, d: grid.exploded(composite.unindexed(composite.indexed(images(s, d)))), f"WITH p AS ({_FOUND}) SELECT i.image_id, i.y, i.x, i.a, i.r, i.g, i.b FROM img i JOIN p USING (image_id, a, r, g, b) WHERE p.n > 1", "img")


def _FIXED():
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(p, CH)]) for p in PALETTE])


_FIXED_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {r}, {g}, {b})" for i, (a, r, g, b) in enumerate(PALETTE)) + ") v(idx, pa, pr, pg, pb)"
_NEAREST = f"WITH p AS ({_FIXED_SQL}), t AS (SELECT i.image_id, i.y, i.x, p.idx, (a - pa) ** 2 + (r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2 AS d FROM img i, p), n AS (SELECT image_id, y, x, min(d)::BIGINT AS d, arg_min(idx, d * 1000 + idx) AS idx FROM t GROUP BY image_id, y, x)"


def _nearest(s, d):
    rows = grid.held(composite.colours(images(s, d)), near=F.transform("px", lambda p: composite.nearest_colour(p, _FIXED())))
    return grid.exploded(rows.select("image_id", "w", "h", F.transform("near", lambda n: n["d"]).alias("d"), F.transform("near", lambda n: n["i"]).alias("idx")), "d", "idx")


query("o6_9_nearest_colour", _nearest, _NEAREST + " SELECT * FROM n", "img", "image_id y x d idx")
query("o6_13_tile_of_pixel", lambda s, d: grid.exploded(images(s, d), "r").select("image_id", "y", "x", idiv(F.col("y"), 3).alias("ty"), idiv(F.col("x"), 3).alias("tx")), "SELECT image_id, y, x, floor(y / 3.0) AS ty, floor(x / 3.0) AS tx FROM img", "img", "image_id y x ty tx")
query("o8_2_colors", lambda s, d: composite.palettes(images(s, d), 12).select("image_id", F.col("n_colors").alias("colors")), "SELECT image_id, CASE WHEN n > CASE WHEN w * h < 2 THEN 2 ELSE least(12, w * h) END THEN 0 ELSE n END AS colors FROM (SELECT image_id, w, h, count(DISTINCT ((a * 256 + r) * 256 + g) * 256 + b) AS n FROM img GROUP BY image_id, w, h)", "img", "image_id colors")
query("o8_3_palette", lambda s, d: composite.palettes(images(s, d)).select("image_id", F.posexplode("palette").alias("idx", "p")).select("image_id", "idx", "p.*"), f"SELECT image_id, idx, a, r, g, b FROM ({_FOUND}) WHERE n > 1", "img", "image_id idx a r g b")
query("o8_4_gray_palette", lambda s, d: composite.palettes(images(s, d)).filter("palette is not null").select("image_id", F.forall("palette", lambda p: (p["r"] == p["g"]) & (p["g"] == p["b"])).alias("is_gray")), f"SELECT image_id, bool_and(r = g AND g = b) AS is_gray FROM ({_FOUND}) WHERE n > 1 GROUP BY image_id", "img", "image_id", bools="is_gray")
query("o9_21_palette_usage", lambda s, d: composite.palette_usage(images(s, d), _FIXED()), _NEAREST + " SELECT i.image_id, p.idx, count(n.idx) AS n FROM (SELECT DISTINCT image_id FROM img) i CROSS JOIN p LEFT JOIN n ON n.image_id = i.image_id AND n.idx = p.idx GROUP BY i.image_id, p.idx", "img", "image_id idx n")


def _sorted(s, d, weight=None):
    rows = composite.palettes(images(s, d)).filter("palette is not null")
    order = F.col("palette") if weight is None else composite.sorted_by_deltas(F.col("palette"), weight)
    return rows.select("image_id", F.posexplode(order).alias("place", "p")).select("image_id", "place", "p.*")


query("o11_1_sorted_palette", _sorted, f"SELECT image_id, idx AS place, a, r, g, b FROM ({_FOUND}) WHERE n > 1", "img", "image_id place a r g b")
query("o11_2_palette_by_deltas", lambda s, d: _sorted(s, d, 192), "", "img", "image_id place a r g b")

# Predictors and scans of neighbours

_NEAR = "SELECT p.*, " + ", ".join(f"{t}.{c} AS {t}{c}" for t in ("l", "u", "c", "n") for c in CH) + " FROM img p LEFT JOIN img l ON l.image_id = p.image_id AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN img u ON u.image_id = p.image_id AND u.y = p.y - 1 AND u.x = p.x LEFT JOIN img c ON c.image_id = p.image_id AND c.y = p.y - 1 AND c.x = p.x - 1 LEFT JOIN img n ON n.image_id = p.image_id AND n.y = CASE WHEN p.x + 1 < p.w THEN p.y - 1 ELSE p.y END AND n.x = (p.x + 1) % p.w"
_TELL = " + ".join(f"abs(l{c} - c{c}) - abs(u{c} - c{c})" for c in CH)
_GUESS = [
    "", "l@", "u@", "n@", "c@", "((l@ + n@) // 2 + u@) // 2", "(l@ + c@) // 2", "(l@ + u@) // 2", "(c@ + u@) // 2", "(u@ + n@) // 2", "((l@ + c@) // 2 + (u@ + n@) // 2) // 2",
    f"CASE WHEN {_TELL} <= 0 THEN u@ ELSE l@ END", "greatest(0, least(255, l@ + u@ - c@))", "greatest(0, least(255, (l@ + u@) // 2 + trunc(((l@ + u@) // 2 - c@) / 2.0)::BIGINT))",
]
MODES = ("black", "left", "top", "top_right", "top_left", "average_3", "left_top_left", "left_top", "top_left_top", "top_top_right", "average_4", "select", "clamped_gradient", "half_gradient")


def _residual_sql(mode) -> str:
    def of(c: str) -> str:
        black = "255" if c == "a" else "0"
        guess = lambda m: (_GUESS[m] or black).replace("@", c)
        inner = guess(mode) if isinstance(mode, int) else "CASE " + " ".join(f"WHEN (image_id + x // 4) % 14 = {m} THEN {guess(m)}" for m in range(14)) + " END"
        return f"({c} - (CASE WHEN x = 0 AND y = 0 THEN {black} WHEN y = 0 THEN l{c} WHEN x = 0 THEN u{c} ELSE {inner} END) + 512) % 256 AS {c}"

    return f"WITH near AS ({_NEAR}) SELECT image_id, y, x, {', '.join(map(of, CH))} FROM near"


for _m, _name in enumerate(MODES):
    query(f"o10_{_m + 1}_{_name}", lambda s, d, m=_m: grid.exploded(predict.residuals(images(s, d), m)), _residual_sql(_m), "img")
query("o10_15_residuals_by_tile", lambda s, d: grid.exploded(predict.residuals(images(s, d), lambda x, y: (F.col("image_id") + idiv(x, 4)) % 14)), _residual_sql(None), "img")


def _smooth_sql(quality: int) -> str:
    parts, last = [], "img"
    for bits in range(min(4, max(1, 100 - quality)), 0, -1):
        limit, mask = max(1, ((1 << bits) - 1) // 2), (1 << bits) - 1
        far = " OR ".join(f"abs(p.{c} - q.{c}) >= {limit}" for c in CH)
        parts.append(f"f{bits} AS (SELECT p.image_id, p.y, p.x, bool_or({far}) AS far FROM {last} p JOIN {last} q ON q.image_id = p.image_id AND ((q.y = p.y AND abs(q.x - p.x) = 1) OR (q.x = p.x AND abs(q.y - p.y) = 1)) WHERE p.x > 0 AND p.x < p.w - 1 GROUP BY p.image_id, p.y, p.x)")
        v = f"(@ + {mask >> 1} + (@ // {1 << bits}) % 2)"
        parts.append(f"t{bits} AS (SELECT p.image_id, p.w, p.h, p.y, p.x, " + _list(f"CASE WHEN f.far THEN CASE WHEN {v} > 255 THEN 255 ELSE {v} // {mask + 1} * {mask + 1} END ELSE @ END AS @").replace("@", "@") + f" FROM {last} p LEFT JOIN f{bits} f USING (image_id, y, x))")
        last = f"t{bits}"
    return f"WITH {', '.join(parts)} SELECT image_id, y, x, a, r, g, b FROM {last}"


query("o10_35_near_lossless", lambda s, d: grid.exploded(predict.near_lossless(images(s, d), 97)), _smooth_sql(97), "img")
query("o9_15_spread", lambda s, d: grid.exploded(predict.spread(images(s, d)), "spread"), "SELECT p.image_id, p.y, p.x, max(q.r) - min(q.r) AS spread FROM img p JOIN img q ON q.image_id = p.image_id AND q.y BETWEEN p.y - 2 AND p.y + 2 AND q.x BETWEEN p.x - 2 AND p.x + 2 GROUP BY p.image_id, p.y, p.x", "img", "image_id y x spread")
query("o12_4_changed_pixels", lambda s, d: predict.changed(pairs(s, d), 0.0), "SELECT image_id, y, x FROM pair WHERE (a - a2) ** 2 + (r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2 > 225", "pair", "image_id y x")


_YCOCG = color.TO_RGB["YCoCg"]
query("o5_2_chosen_transform", lambda s, d: _custom(s, d).select("image_id", F.posexplode(F.when(F.col("fits"), F.col("im")).otherwise(F.array(*[F.lit(v).cast("long") for v in _YCOCG]))).alias("i", "im")), f"WITH {_inverse_sql()} SELECT image_id, i, CASE WHEN fits THEN m[i + 1] ELSE [1024, 1024, -1024, 1024, 0, 1024, 1024, -1024, -1024][i + 1] END AS im FROM (SELECT *, unnest(range(0, 9)) AS i FROM f)", "", "image_id i im")


def _labels(s, d):
    """A label for each 2x2 tile."""
    return grid.regridded(images(s, d), idiv(F.col("w") + 1, 2), idiv(F.col("h") + 1, 2), lambda c, x, y: (F.col("image_id") + 3 * x + 5 * y) % 4, ("v",))


def _pixel_labels(s, d):
    sizes = images(s, d).select("image_id", F.col("w").alias("pw"), F.col("h").alias("ph"))
    return grid.exploded(composite.clusters_of_pixels(_labels(s, d).join(sizes, "image_id"), F.col("pw"), F.col("ph"), 1), "v")


query("o6_11_cluster_of_pixel", _pixel_labels, "SELECT image_id, y, x, (image_id + 3 * (x // 2) + 5 * (y // 2)) % 4 AS v FROM img", "img", "image_id y x v")
query("o6_12_scattered_blocks", lambda s, d: rect_pairs(s, d).filter("w > 0 and h > 0").select("id", F.col("x2").alias("feature"), F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("cy"), "x", "w").select("id", "feature", "cy", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1)).alias("cx")), "SELECT id, x2 AS feature, j.j AS cy, i.i AS cx FROM rect_pairs, range(0, 8) j(j), range(0, 8) i(i) WHERE j.j >= y AND j.j < y + h AND i.i >= x AND i.i < x + w", "rect_pairs", "id feature cy cx")
query("o10_33_colour_map", lambda s, d: grid.exploded(composite.first_places(images(s, d)), "idx"), "WITH f AS (SELECT image_id, a, r, g, b, row_number() OVER (PARTITION BY image_id ORDER BY min(y * w + x)) - 1 AS idx FROM img GROUP BY image_id, a, r, g, b) SELECT i.image_id, i.y, i.x, f.idx FROM img i JOIN f USING (image_id, a, r, g, b)", "img", "image_id y x idx")
_partners = lambda s, d: grid.exploded(pairs(s, d), "r2").select("image_id", F.col("r2").alias("r"))
query("o12_11_membership", lambda s, d: grid.exploded(images(s, d), "r").join(_partners(s, d), ["image_id", "r"], "left_semi"), "SELECT image_id, y, x, r FROM img i WHERE EXISTS (SELECT 1 FROM pair p WHERE p.image_id = i.image_id AND p.r2 = i.r)", "img pair", "image_id y x r")
_mean_of = lambda c: f"(sum(q.{c}) + count(*) // 2) // count(*)"
query("o14_14_blurred", lambda s, d: grid.exploded(predict.blurred(images(s, d), 1, 12)), "SELECT p.image_id, p.y, p.x, " + ", ".join(f"CASE WHEN abs({_mean_of(c)} - p.{c}) < 12 THEN {_mean_of(c)} ELSE p.{c} END AS {c}" for c in CH) + " FROM img p JOIN img q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.image_id, p.y, p.x, p.a, p.r, p.g, p.b", "img")
query("o10_29_hash_cache", lambda s, d: predict.hash_cached(grid.exploded(images(s, d)).withColumns({c: F.floor(F.col(c) / 64) for c in CH}), 4), "WITH t AS (SELECT image_id, y, x, y * w + x AS p, ((a // 64 * 256 + r // 64) * 256 + g // 64) * 256 + b // 64 AS v FROM img), h AS (SELECT *, (v * 506832829) % 4294967296 // 268435456 AS slot FROM t) SELECT h.image_id, h.y, h.x, h.slot, coalesce(arg_max(q.v, q.p), 4294967295) = h.v AS hit FROM h LEFT JOIN h q ON q.image_id = h.image_id AND q.slot = h.slot AND q.p < h.p GROUP BY h.image_id, h.y, h.x, h.slot, h.v", "img", "image_id y x slot", bools="hit")

# The best predictor of each tile

TILE = 8


def _tile_rows(rows, *names):
    cells = rows.select("image_id", "across", F.posexplode(F.arrays_zip(*names)).alias("i", "p"))
    return cells.select("image_id", idiv(F.col("i"), F.col("across")).alias("ty"), (F.col("i") % F.col("across")).alias("tx"), "p.*")


def _best_sql() -> str:
    every = " UNION ALL ".join(f"SELECT image_id, y // {TILE} AS ty, x // {TILE} AS tx, {m} AS mode, {_residual_sql(m).split(' SELECT image_id, y, x, ')[-1].rsplit(' FROM near', 1)[0]} FROM near" for m in range(14))
    small = f"CASE WHEN sym = 0 THEN 1.0::DOUBLE WHEN sym < 16 THEN {predict.SMALL}::DOUBLE * {predict.DECAY}::DOUBLE ** (sym - 1) WHEN sym > 240 THEN {predict.SMALL}::DOUBLE * {predict.DECAY}::DOUBLE ** (255 - sym) ELSE 0 END"
    counts = "SELECT image_id, ty, tx, mode, k, sym, count(*) AS c FROM (SELECT image_id, ty, tx, mode, unnest([a, r, g, b]) AS sym, unnest([0, 1, 2, 3]) AS k FROM every) GROUP BY ALL"
    costs = f"SELECT image_id, ty, tx, mode, k, 2 * (sum(c) * log2(sum(c)) - sum(c * log2(c))) - {predict.SHARE}::DOUBLE * sum(c * {small}) AS bits FROM counts GROUP BY ALL"
    return f"WITH near AS ({_NEAR}), every AS ({every}), counts AS ({counts}), costs AS (SELECT image_id, ty, tx, mode, round(sum(bits), 6) AS bits FROM ({costs}) GROUP BY ALL) SELECT image_id, ty, tx, mode AS modes, bits FROM costs QUALIFY row_number() OVER (PARTITION BY image_id, ty, tx ORDER BY bits, mode) = 1"


query("o10_16_best_mode_alone", lambda s, d: _tile_rows(predict.best_modes_alone(images(s, d), TILE), "modes", "bits"), _best_sql(), "img", "image_id ty tx modes", doubles="bits")
query("o10_16_best_mode", lambda s, d: _tile_rows(predict.best_modes(images(s, d), TILE), "modes"), "", "", "image_id ty tx modes")
query("o10_17_predicted_image", lambda s, d: grid.exploded(predict.predicted_image(images(s, d), TILE)), "", "", PX)
_MULTIPLIERS = ("green_to_red", "green_to_blue", "red_to_blue")
query("o10_18_best_green_to_red", lambda s, d: _tile_rows(multipliers.best_multipliers(images(s, d), TILE), *_MULTIPLIERS).select("image_id", "ty", "tx", "green_to_red"), "", "", "image_id ty tx green_to_red")
query("o10_19_best_to_blue", lambda s, d: _tile_rows(multipliers.best_multipliers(images(s, d), TILE), *_MULTIPLIERS).select("image_id", "ty", "tx", "green_to_blue", "red_to_blue"), "", "", "image_id ty tx green_to_blue red_to_blue")
query("o10_20_cross_colour_image", lambda s, d: grid.exploded(multipliers.transformed(images(s, d), TILE)), "", "", PX)
