"""Rasters, planes, rectangles and frames derived from the driver's tables, as DataFrames; and the same as DuckDB views.

Every value of a vector is a pixel; where a shape has a pixel or two more, the first values come again. Odd sides and single
rows and columns occur. The two sides are written apart: arrays and their positions here, a row for each pixel there.
"""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphgrid.functions.fixed import div_by_255, idiv
from glyphgrid.operators import grid

#: How far an image's partner, of the same size, is away.
PARTNER = 64
#: Tasks for each core that make images; a given number isn't merged into fewer by the bytes, which say little of the work.
TASKS = 3
#: Widths and heights, by an image's id.
WIDTHS, HEIGHTS = [8, 64, 1, 5, 13, 3, 2, 22], [8, 1, 64, 13, 5, 22, 32, 3]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours that aren't premultiplied.

    A vector is short, and making its image takes far longer than reading it: the vectors are dealt out first, as a
    file of one row group is read by one task, however long it is.
    """
    side = lambda of: F.get(F.array(*[F.lit(n) for n in of]), (F.col("vec_id") % len(of)).cast("int"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(TASKS * spark.sparkContext.defaultParallelism, "vec_id")
    rows = vectors.select(F.col("vec_id").alias("image_id"), side(WIDTHS).alias("w"), side(HEIGHTS).alias("h"), "embedding")
    w = F.col("w")
    rows = grid.held(rows, v=grid.each(w * F.col("h"), lambda i: F.floor((F.get("embedding", i % 64).cast("double") + 1) * 128)))
    alpha = lambda v: F.when(F.col("image_id") % 2 == 0, 255).otherwise(3 * v % 256).cast("long")
    of = {"a": alpha, "r": lambda v: v, "g": lambda v, i: (7 * v + 13 * (i % w)) % 256, "b": lambda v, i: (11 * v + 29 * idiv(i, w)) % 256}
    return grid.held(rows, **{c: F.transform("v", f) for c, f in of.items()}).select("image_id", "w", "h", *grid.CHANNELS)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premultiplied."""
    of = lambda c: F.zip_with(c, "a", lambda v, a: F.when(a < 255, div_by_255(v * a)).otherwise(v))
    return grid.held(raw_images(spark, sf_dir), **{c: F.col(c) if c == "a" else of(c) for c in grid.CHANNELS}).select("image_id", "w", "h", *grid.CHANNELS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir)
    return grid.paired(own, own.withColumn("image_id", F.col("image_id") - PARTNER))


def rect_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small rectangles that often start alike, touch, or have no area."""
    i = F.col("event_id")
    of = {"x": i % 5, "y": idiv(i, 5) % 5, "w": idiv(i, 25) % 4, "h": idiv(i, 100) % 4, "x2": idiv(i, 7) % 5, "y2": idiv(i, 11) % 5, "w2": idiv(i, 13) % 4, "h2": idiv(i, 17) % 4}
    return table(spark, sf_dir, "events").select(i.alias("id"), *[v.cast("long").alias(k) for k, v in of.items()])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events")
    i = F.col("event_id")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rows.select(
        F.col("user_id").alias("anim_id"), idx.cast("long").alias("frame_idx"),
        F.when(F.col("event_type") == "view", 0).otherwise(F.floor("value") + 1).cast("long").alias("duration_ms"),
        ((idx == 0) | (F.col("event_type") == "signup")).alias("disposes"),
        (i % 13).alias("x"), (i % 7).alias("y"), (1 + i % 5).alias("w"), (1 + i % 6).alias("h"), F.length("props").cast("long").alias("num_bytes"),
    )


def histograms(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """How often each of red's values modulo size occurs in an image, and in its partner."""
    from glyphgrid.operators import histo

    of = lambda c: histo.counts_of(F.transform(c, lambda v: v % size), size)
    return grid.held(pairs(spark, sf_dir), counts=of("r"), counts2=of("r2")).select("image_id", "counts", "counts2")


def over_255(v: str) -> str:
    return f"(({v}) + (({v}) // 256) + 128) // 256"


def _straight(v: str, end: str) -> str:
    return f"CASE WHEN image_id % 2 = 0 THEN 255 ELSE 3 * {v} % 256 END AS a{end}, {v} AS r{end}, (7 * {v} + 13 * x) % 256 AS g{end}, (11 * {v} + 29 * y) % 256 AS b{end}"


def _premultiplied(end: str) -> str:
    return f"a{end}, " + ", ".join(f"CASE WHEN a{end} = 255 THEN {c}{end} ELSE {over_255(f'{c}{end} * a{end}')} END AS {c}{end}" for c in "rgb")


_LEVEL = "floor((@[i % 64 + 1]::DOUBLE + 1) * 128)::BIGINT"
_SIZED = f"SELECT *, {WIDTHS}[vec_id % 8 + 1] AS w, {HEIGHTS}[vec_id % 8 + 1] AS h"

#: The same for DuckDB: tables by name, each after those that it needs. Partners meet as whole vectors, before there are pixels.
DUCK = {
    "gray": f"SELECT vec_id AS image_id, w, h, i // w AS y, i % w AS x, {_LEVEL.replace('@', 'embedding')} AS v FROM (SELECT *, unnest(range(0, w * h)) AS i FROM ({_SIZED} FROM embeddings))",
    "raw": f"SELECT image_id, w, h, y, x, {_straight('v', '')} FROM gray",
    "img": f"SELECT image_id, w, h, y, x, {_premultiplied('')} FROM raw",
    "gray_pair": f"SELECT vec_id AS image_id, w, h, i // w AS y, i % w AS x, {_LEVEL.replace('@', 'embedding')} AS v, {_LEVEL.replace('@', 'other')} AS v2 FROM (SELECT *, unnest(range(0, w * h)) AS i FROM ({_SIZED} FROM (SELECT e.vec_id, e.embedding, f.embedding AS other FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + {PARTNER})))",
    "raw_pair": f"SELECT image_id, w, h, y, x, {_straight('v', '')}, {_straight('v2', '2')} FROM gray_pair",
    "pair": f"SELECT image_id, w, h, y, x, {_premultiplied('')}, {_premultiplied('2')} FROM raw_pair",
    "rect_pairs": "SELECT event_id AS id, event_id % 5 AS x, event_id // 5 % 5 AS y, event_id // 25 % 4 AS w, event_id // 100 % 4 AS h, event_id // 7 % 5 AS x2, event_id // 11 % 5 AS y2, event_id // 13 % 4 AS w2, event_id // 17 % 4 AS h2 FROM events",
    "frames": """SELECT user_id AS anim_id, row_number() OVER u - 1 AS frame_idx, CASE WHEN event_type = 'view' THEN 0 ELSE floor(value)::BIGINT + 1 END AS duration_ms,
        row_number() OVER u = 1 OR event_type = 'signup' AS disposes, event_id % 13 AS x, event_id % 7 AS y, 1 + event_id % 5 AS w, 1 + event_id % 6 AS h, length(props) AS num_bytes
        FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "hist": f"SELECT image_id, s.s AS sym, count(*) FILTER (WHERE r % 64 = s.s) AS c, count(*) FILTER (WHERE r2 % 64 = s.s) AS c2 FROM pair, range(0, 64) s(s) GROUP BY image_id, s.s",
}
DUCK_NEEDS = {"raw": ["gray"], "img": ["raw"], "raw_pair": ["gray_pair"], "pair": ["raw_pair"], "hist": ["pair"]}


def duck_sql(body: str, *names: str) -> str:
    """The statement with the tables that it names, each computed once, so that no join is planned through them."""
    order: list = []

    def add(name: str) -> None:
        for below in DUCK_NEEDS.get(name, []):
            add(below)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    heads = ", ".join(f"{n} AS ({DUCK[n]})" for n in order)
    if heads:
        body = f"WITH {heads}, {body[5:]}" if body.startswith("WITH ") else f"WITH {heads} {body}"
    return re.sub(r"\bAS \((?=SELECT|WITH)", "AS MATERIALIZED (", body)
