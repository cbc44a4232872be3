"""Queries on filters over block edges and on rasters in tiles, with DuckDB SQL that knows no tiles."""

from pyspark.sql import functions as F

from glyphgrid.functions.fixed import idiv
from glyphgrid.operators import deblock, directional, grid, metrics, predict, segments, stencils
from glyphgrid.plans.fixtures import images, pairs
from glyphgrid.plans.images import QUERIES as IMAGES
from glyphgrid.plans.query import Query

QUERIES: dict = {}
BLOCK, QUALITY, TILE = 8, 6, 16
PX = "image_id y x a r g b"


def query(name: str, build, sql: str, needs: str, ints: str = "", **kinds) -> None:
    QUERIES[name] = Query(build, sql, tuple(needs.split()), ints, **kinds)


def rasters(s, d):
    """Red values that differ less between neighbours, with the bits and residuals of blocks of 8 pixels."""
    block = lambda f: lambda x, y: f(F.col("image_id"), idiv(y, BLOCK), idiv(x, BLOCK)).cast("long")
    w, h = F.col("w"), F.col("h")
    of = {"v": lambda x, y: (96 + idiv(grid.value("r", x, y), 8)).cast("long"), "bits": block(lambda i, by, bx: (i * 37 + by * 53 + bx * 71) % 256), "density": block(lambda i, by, bx: (i * 11 + by * 5 + bx * 17) % 100)}
    return grid.held(images(s, d), **{c: grid.pixels(w, h, f) for c, f in of.items()}).select("image_id", "w", "h", *of)


_PX = f"SELECT image_id, w, h, y, x, 96 + r // 8 AS v, (image_id * 37 + y // {BLOCK} * 53 + x // {BLOCK} * 71) % 256 AS bits, (image_id * 11 + y // {BLOCK} * 5 + x // {BLOCK} * 17) % 100 AS density FROM img"


def _lines_sql(source: str, at: str, along: str, side: str) -> str:
    """Of each pixel near an edge across ``at``: its distance d and side, and what its line over the edge has."""
    top = f"least(63, (2 * (14 - {QUALITY}) * 63 + 7) // 14)"
    near = f"SELECT *, ({at} + {BLOCK // 2}) // {BLOCK} AS e, least({BLOCK // 2}, {side} - ({at} + {BLOCK // 2}) // {BLOCK} * {BLOCK}) AS half FROM {source}"
    sided = f"SELECT *, {at} >= e * {BLOCK} AS q, CASE WHEN {at} >= e * {BLOCK} THEN {at} - e * {BLOCK} ELSE e * {BLOCK} - 1 - {at} END AS d FROM ({near}) WHERE e > 0 AND half > 0"
    line = f"PARTITION BY image_id, {along}, e"
    first = lambda n, q: f"max(v) FILTER (d = {n} AND {'' if q else 'NOT '}q) OVER ({line})"
    known = f"SELECT *, {first(0, False)} AS p0, {first(0, True)} AS q0, {first(1, False)} AS p1, {first(1, True)} AS q1, least({top}, (255 - min(bits) OVER ({line})) * 63 // 255) AS strong, greatest(({QUALITY} * 7 + 7) // 14, least(7, greatest(0, max(density) OVER ({line}) - 25) * 7 // 50)) AS sharp FROM ({sided}) WHERE d < half"
    steps = f"SELECT *, CASE WHEN d = 0 THEN CASE WHEN q THEN q0 - p0 ELSE p0 - q0 END ELSE v - lag(v) OVER (PARTITION BY image_id, {along}, e, q ORDER BY d) END AS step FROM ({known})"
    bent = f"SELECT *, d > 0 AND abs(step - lag(step) OVER (PARTITION BY image_id, {along}, e, q ORDER BY d)) > {[list(r) for r in deblock.SLOPES]}[sharp + 1][d + 1] AS bent FROM ({steps})"
    return f"SELECT *, coalesce(min(d) FILTER (bent) OVER ({line}), half) AS flat, [{', '.join(str(-(-v // 2) if v % 2 else v // 2) for v in deblock.JUMPS)}][sharp + 1] AS jump FROM ({bent})"


def _pass_sql(source: str, at: str, along: str, side: str) -> str:
    delta = "(CASE WHEN flat > 1 THEN q0 + floor((q0 - q1) / 2.0) - p0 - floor((p0 - p1) / 2.0) ELSE q0 - p0 END)"
    weights = [list(r) + [0] * (8 - len(r)) for r in deblock.WEIGHTS[1:]]
    moved = f"floor(({delta} * strong * {weights}[flat][d + 1] + 16384) / 32768.0)::BIGINT"
    new = f"SELECT image_id, y, x, CASE WHEN abs({delta}) BETWEEN 2 AND jump THEN greatest(0, least(255, CASE WHEN q THEN v - {moved} ELSE v + {moved} END)) ELSE v END AS u FROM ({_lines_sql(source, at, along, side)})"
    return f"SELECT s.* EXCLUDE (v), coalesce(n.u, s.v) AS v FROM {source} s LEFT JOIN ({new}) n USING (image_id, y, x)"


def _lines(s, d):
    """What a line over an upright edge has: how far it is flat."""

    def body(p):
        v, w = p["v"], p["v"].shape[1]
        edges = list(range(BLOCK, w, BLOCK))
        flats = []
        for e in edges:
            half = min(BLOCK // 2, w - e)
            sharp = deblock.sharpness(QUALITY, deblock.np.maximum(p["density"][:, e - 1], p["density"][:, e]))
            flats.append(deblock.flat_length(v[:, e - 1 - deblock.np.arange(half)], v[:, e + deblock.np.arange(half)], sharp))
        return {"flat": deblock.np.array(flats).T if edges else deblock.np.empty((v.shape[0], 0))}

    rows = stencils.on_rasters(rasters(s, d), deblock.PLANES, {"flat": "array<long>"}, body)
    n = F.floor((F.col("w") - 1) / BLOCK)
    return rows.filter(n > 0).select("image_id", n.alias("n"), F.posexplode("flat").alias("i", "flat")).select("image_id", idiv(F.col("i"), F.col("n")).alias("y"), (F.col("i") % F.col("n") + 1).alias("e"), "flat")


def _upright(s, d):
    body = lambda p: {"v": deblock.over_upright_edges(p["v"], p["bits"], p["density"], 0, p["v"].shape[1], BLOCK, QUALITY, 9, 0, 255)}
    return grid.exploded(stencils.on_rasters(rasters(s, d), deblock.PLANES, {"v": "array<long>"}, body), "v")


_HEAD = f"WITH px AS ({_PX}), "
_DEBLOCKED = f"{_HEAD} one AS ({_pass_sql('px', 'x', 'y', 'w')}), two AS ({_pass_sql('one', 'y', 'x', 'h')}) SELECT image_id, y, x, v FROM two"
query("o14_1_upright_edges", _upright, f"{_HEAD} one AS ({_pass_sql('px', 'x', 'y', 'w')}) SELECT image_id, y, x, v FROM one", "img", "image_id y x v")
query("o14_2_flat_lengths", _lines, f"{_HEAD} one AS ({_lines_sql('px', 'x', 'y', 'w')}) SELECT DISTINCT image_id, y, e, flat FROM one", "img", "image_id y e flat")
query("o14_3_deblocked", lambda s, d: grid.exploded(deblock.deblock(rasters(s, d), BLOCK, QUALITY), "v"), _DEBLOCKED, "img", "image_id y x v")
query("o14_4_deblocked_tiles", lambda s, d: stencils.pixels_of(deblock.deblock_tiles(stencils.cut(rasters(s, d), deblock.PLANES, TILE), BLOCK, QUALITY, TILE), "v"), _DEBLOCKED, "img", "image_id y x v")


# The functions of a window again, on tiles: the same SQL as on whole rasters.


def _tiled_psnr(kind):
    def build(s, d):
        return metrics.tile_sums(stencils.cut(pairs(s, d), (*grid.CHANNELS, *[f"{c}2" for c in grid.CHANNELS]), TILE), kind, size=TILE)

    return build


def _tiled(f):
    return lambda s, d: stencils.pixels_of(f(stencils.cut(images(s, d), grid.CHANNELS, TILE)), *grid.CHANNELS)


query("o10_35_near_lossless_tiles", _tiled(lambda t: predict.near_lossless_tiles(t, 97, TILE)), IMAGES["o10_35_near_lossless"].body, "img", PX)
query("o14_14_blurred_tiles", _tiled(lambda t: predict.blurred_tiles(t, 1, 12, TILE)), IMAGES["o14_14_blurred"].body, "img", PX)
query("o7_12_lsim_tiles", _tiled_psnr("lsim"), "SELECT image_id, count(*) AS n, " + ", ".join(f"sum(m_{c}) AS t_{c}" for c in grid.CHANNELS) + " FROM (SELECT p.image_id, p.y, p.x, " + ", ".join(f"min((q.{c} - p.{c}2) ** 2)::BIGINT AS m_{c}" for c in grid.CHANNELS) + " FROM pair p JOIN pair q ON q.image_id = p.image_id AND q.y BETWEEN p.y - 2 AND p.y + 2 AND q.x BETWEEN p.x - 2 AND p.x + 2 GROUP BY p.image_id, p.y, p.x) GROUP BY image_id", "pair", "image_id n t_a t_r t_g t_b")

# Directions of blocks, and smoothing along them

SIZE = 4


def directed(s, d):
    """Red values, with strengths by block: along 0, 1, 2 or 4, beside 0, 1 or 2."""
    at = lambda x, y: F.col("image_id") + idiv(y, SIZE) + 3 * idiv(x, SIZE)
    pick = lambda of, n: F.get(F.array(*[F.lit(v).cast("long") for v in of]), (n % len(of)).cast("int"))
    of = {"v": lambda x, y: grid.value("r", x, y).cast("long"), "along": lambda x, y: pick((0, 1, 2, 4), at(x, y)), "beside": lambda x, y: pick((0, 1, 2), at(x, y))}
    return grid.held(images(s, d), **{c: grid.pixels(F.col("w"), F.col("h"), f) for c, f in of.items()}).select("image_id", "w", "h", *of)


def _directions(size: int):
    def build(s, d):
        rows = directional.block_directions(directed(s, d), size).filter("across > 0")
        cells = rows.select("image_id", "across", F.posexplode(F.arrays_zip("direction", "certainty")).alias("i", "p"))
        return cells.select("image_id", idiv(F.col("i"), F.col("across")).alias("by"), (F.col("i") % F.col("across")).alias("bx"), "p.*")

    return build


def _lines_of(size: int) -> str:
    y, x = f"y % {size}", f"x % {size}"
    return f"[{y} + {x}, {y} + {x} // 2, {y}, {y} - {x} // 2 + {size}, {y} - {x} + {size}, {x} - {y} // 2 + {size}, {x}, {x} + {y} // 2]".replace(f"{x} // 2", f"({x}) // 2").replace(f"{y} // 2", f"({y}) // 2")


def _direction_sql(size: int) -> str:
    px = f"SELECT image_id, y // {size} AS by, x // {size} AS bx, r, unnest(range(0, 8)) AS d, unnest({_lines_of(size)}) AS line FROM img WHERE y // {size} * {size} + {size} <= h AND x // {size} * {size} + {size} <= w"
    if size == 8:
        scores = f"SELECT image_id, by, bx, d, sum(s * s * (840 // n)) AS score FROM (SELECT image_id, by, bx, d, line, sum(r) AS s, count(*) AS n FROM ({px}) GROUP BY ALL) GROUP BY ALL"
        order, gap = "score DESC, d", "a.score - o.score"
    else:
        scores = f"SELECT image_id, by, bx, d, sum((4 * r - m) ** 2)::BIGINT AS score FROM (SELECT *, (sum(4 * r) OVER l + count(*) OVER l // 2) // count(*) OVER l AS m FROM ({px}) WINDOW l AS (PARTITION BY image_id, by, bx, d, line)) GROUP BY ALL"
        order, gap = "score, d", "o.score - a.score"
    scores, order = scores.replace("by,", '"by",').replace("AS by", 'AS "by"'), order
    return f"sc AS ({scores}), best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY image_id, \"by\", bx ORDER BY {order}) = 1), directed AS (SELECT a.image_id, a.\"by\", a.bx, a.d AS direction, floor(({gap}) / 1024.0)::BIGINT AS certainty FROM best a JOIN sc o ON o.image_id = a.image_id AND o.\"by\" = a.\"by\" AND o.bx = a.bx AND o.d = (a.d + 4) % 8)".replace("px AS (", "px AS (")


query("o14_5_directions_of_4", _directions(4), f"WITH {_direction_sql(4)} SELECT * FROM directed", "img", "image_id by bx direction certainty")
query("o14_5_directions_of_8", _directions(8), f"WITH {_direction_sql(8)} SELECT * FROM directed", "img", "image_id by bx direction certainty")


def _enhanced_sql() -> str:
    taps = []
    for d in range(8):
        for turn, kind in ((0, "along"), (-2, "beside"), (2, "beside")):
            for k in range(2):
                for sign in (-1, 1):
                    dy, dx = (sign * s for s in directional.STEPS[(d + turn) % 8][k])
                    taps.append(f"({d}, '{kind}', {dy}, {dx}, {directional.ALONG[0][k] if kind == 'along' else directional.BESIDE[k]}, {directional.ALONG[1][k] if kind == 'along' else directional.BESIDE[k]})")
    at = f"(image_id + y // {SIZE} + 3 * (x // {SIZE}))"
    px = f"SELECT image_id, y, x, r AS v, [0, 1, 2, 4][{at} % 4 + 1] AS along, [0, 1, 2][{at} % 3 + 1] AS beside FROM img"
    seen = f"SELECT p.*, q.v AS u, CASE WHEN t.kind = 'along' THEN p.along ELSE p.beside END AS strength, CASE WHEN p.along % 2 = 0 THEN t.even ELSE t.odd END AS weight FROM px p JOIN directed b ON b.image_id = p.image_id AND b.\"by\" = p.y // {SIZE} AND b.bx = p.x // {SIZE} JOIN taps t ON t.d = b.direction JOIN px q ON q.image_id = p.image_id AND q.y = p.y + t.dy AND q.x = p.x + t.dx"
    counted = "SELECT *, sign(u - v) * greatest(0, least(abs(u - v), strength - abs(u - v) // [1, 32, 16, 0, 8][strength + 1])) * weight AS part FROM seen WHERE strength > 0"
    sums = "SELECT image_id, y, x, any_value(v) AS v, any_value(along) AS along, any_value(beside) AS beside, sum(part) AS total, list_min([min(u), any_value(v)]) AS low, list_max([max(u), any_value(v)]) AS high FROM counted GROUP BY image_id, y, x"
    moved = "v + floor((8 + total - CASE WHEN total < 0 THEN 1 ELSE 0 END) / 16.0)::BIGINT"
    return f"WITH {_direction_sql(SIZE)}, taps AS (SELECT * FROM (VALUES {', '.join(taps)}) t(d, kind, dy, dx, even, odd)), px AS ({px}), seen AS ({seen}), counted AS ({counted}), sums AS ({sums}) SELECT p.image_id, p.y, p.x, CASE WHEN s.v IS NULL THEN p.v WHEN s.along > 0 AND s.beside > 0 THEN greatest(s.low, least(s.high, s.{moved[:1]}{moved[1:].replace('total', 's.total')})) ELSE s.{moved[:1]}{moved[1:].replace('total', 's.total')} END AS v FROM px p LEFT JOIN sums s USING (image_id, y, x)"


query("o14_6_enhanced", lambda s, d: grid.exploded(directional.enhance(directed(s, d), SIZE), "v"), _enhanced_sql(), "img", "image_id y x v")
query("o14_7_enhanced_tiles", lambda s, d: stencils.pixels_of(directional.enhance_tiles(stencils.cut(directed(s, d), directional.PLANES, TILE), SIZE, side=TILE), "v"), _enhanced_sql(), "img", "image_id y x v")


# Differences as they are seen


def _hvs_sql() -> str:
    def of(c: str, table: str) -> str:
        px = f"SELECT p.image_id, 7 * a.a AS wy, 7 * b.b AS wx, y - 7 * a.a AS j, x - 7 * b.b AS i, {c} AS p, {c}2 AS q FROM pair p, range(0, 9) a(a), range(0, 9) b(b) WHERE y - 7 * a.a BETWEEN 0 AND 7 AND x - 7 * b.b BETWEEN 0 AND 7 AND 7 * a.a + 8 <= h AND 7 * b.b + 8 <= w"
        ratio = lambda v: f"CASE WHEN var_pop({v}) > 0 THEN (var_pop({v}) FILTER (j < 4 AND i < 4) + var_pop({v}) FILTER (j < 4 AND i > 3) + var_pop({v}) FILTER (j > 3 AND i < 4) + var_pop({v}) FILTER (j > 3 AND i > 3)) * 4 / (64 * var_pop({v})) ELSE 0 END"
        coefficient = lambda v: f"round(256 * sum({v} * cos(pi() * (2 * i + 1) * u.u / 16) * cos(pi() * (2 * j + 1) * v.v / 16)))"
        return (
            f"{c}0 AS ({px}), {c}1 AS (SELECT image_id, wy, wx, {ratio('p')} AS rp, {ratio('q')} AS rq FROM {c}0 GROUP BY ALL), "
            f"{c}2 AS (SELECT image_id, wy, wx, v.v AS v, u.u AS u, {list(metrics.VISIBLE[table])}[8 * v.v + u.u + 1]::DOUBLE AS m, {coefficient('p')} AS a, {coefficient('q')} AS b FROM {c}0, range(0, 8) u(u), range(0, 8) v(v) GROUP BY ALL), "
            f"{c}3 AS (SELECT image_id, wy, wx, greatest(sqrt(sum(floor(a * a * m)) FILTER (u + v > 0) * any_value(rp)), sqrt(sum(floor(b * b * m)) FILTER (u + v > 0) * any_value(rq))) / 8192 AS mask FROM {c}2 JOIN {c}1 USING (image_id, wy, wx) GROUP BY ALL), "
            f"{c}4 AS (SELECT image_id, avg((CASE WHEN u + v = 0 THEN abs(a - b) ELSE greatest(abs(a - b) * m - mask, 0) END) ** 2) AS t FROM {c}2 JOIN {c}3 USING (image_id, wy, wx) GROUP BY image_id)"
        )

    db = lambda t: f"CASE WHEN {t} = 0 THEN 99 ELSE least(98.9::DOUBLE, -4.3429448::DOUBLE * ln({t} / (n * 65025.0::DOUBLE))) END"
    return f"WITH {of('r', 'y')}, {of('g', 'u')}, n AS (SELECT image_id, count(*) AS n FROM pair GROUP BY image_id) SELECT n.image_id, {db('coalesce(r4.t, 0)')} AS r_db, {db('coalesce(g4.t, 0)')} AS g_db FROM n LEFT JOIN r4 ON r4.image_id = n.image_id LEFT JOIN g4 ON g4.image_id = n.image_id"


query("o7_13_hvs", lambda s, d: metrics.hvs_distortion(pairs(s, d), {"r": "y", "g": "u"}), _hvs_sql(), "pair", "image_id", doubles="r_db g_db")

# Segments by risk, and labels with filled holes

LEVELS, SEGMENTS = 16, 4
_DEVIATION = f"SELECT image_id, y // {segments.SIDE} AS by, x // {segments.SIDE} AS bx, sqrt((count(*) * sum(g * g) - sum(g) * sum(g))::DOUBLE) / count(*) AS sd FROM img GROUP BY image_id, y // {segments.SIDE}, x // {segments.SIDE}"
_AWAY = "7 - least(greatest(CASE WHEN sd > 0 THEN ln(sd) ELSE 0 END, 0), 7)"
query("o9_12_risks", lambda s, d: segments.block_risks(images(s, d), "g", LEVELS), f'WITH b AS ({_DEVIATION.replace("AS by", "AS \"by\"")}), a AS (SELECT image_id, "by", bx, {_AWAY} AS away FROM b) SELECT image_id, "by", bx, floor(CASE WHEN away > 5 THEN 5 * (1 - (away - 5) / 2.0::DOUBLE) ELSE away END / 5 * {LEVELS - 1} + 0.5) AS score FROM a', "img", "image_id by bx score")
query("o9_12_segments", lambda s, d: segments.segments(segments.block_risks(images(s, d), "g", LEVELS), LEVELS, SEGMENTS), "", "", "image_id by bx score segment")


def block_labels(s, d):
    """For each block of 2 pixels whether it is far from the partner's, and whether it has one colour."""
    side = 2
    far = metrics.block_sse(pairs(s, d), side, ("r", "g", "b"))
    rows = grid.exploded(images(s, d), "r").groupBy("image_id", idiv(F.col("y"), side).alias("by"), idiv(F.col("x"), side).alias("bx")).agg((F.max("r") - F.min("r") < 20).cast("long").alias("flat"))
    cells = far.join(rows, ["image_id", "by", "bx"]).withColumn("label", (F.col("sse") < 40_000).cast("long"))
    whole = cells.groupBy("image_id").agg((F.max("bx") + 1).cast("int").alias("w"), (F.max("by") + 1).cast("int").alias("h"), F.sort_array(F.collect_list(F.struct("by", "bx", "label", "flat"))).alias("c"))
    return whole.select("image_id", "w", "h", F.transform("c", lambda c: c["label"]).alias("label"), F.transform("c", lambda c: c["flat"]).alias("flat"))


query("o10_36_filled_holes", lambda s, d: grid.exploded(segments.with_filled_holes(block_labels(s, d)), "label"), "", "", "image_id y x label")
