"""Queries on fitted colour spaces, of images of eighty vectors each, with DuckDB SQL where SQL states them."""

from pyspark.sql import functions as F

from glyphgrid.functions.fixed import idiv
from glyphgrid.operators import fit
from glyphgrid.plans.fixtures import table
from glyphgrid.plans.query import Query

QUERIES: dict = {}
ROWS = 80


def query(name: str, build, sql: str, needs: str, ints: str = "", **kinds) -> None:
    QUERIES[name] = Query(build, sql, tuple(needs.split()), ints, **kinds)


def pixel_rows(s, d):
    """A vector is a row of pixels: brightness from its values, colours from the values mirrored."""
    level = lambda v: F.floor((v.cast("double") + 1) * 128).cast("long")
    rows = table(s, d, "embeddings").select(idiv(F.col("vec_id"), ROWS).alias("image_id"), (F.col("vec_id") % ROWS).cast("int").alias("y"), F.transform("embedding", level).alias("v"))
    other = F.reverse("v")
    mix = lambda p, q: F.zip_with("v", other, lambda v, u: F.floor((p * v + q * u) / (p + q)).cast("long"))
    return rows.select("image_id", "y", mix(5, 3).alias("r"), mix(7, 1).alias("g"), mix(15, 1).alias("b"))


_PX = f"SELECT vec_id // {ROWS} AS image_id, vec_id % {ROWS} AS y, x, (5 * v + 3 * u) // 8 AS r, (7 * v + u) // 8 AS g, (15 * v + u) // 16 AS b FROM (SELECT vec_id, unnest(range(0, 64)) AS x, floor((unnest(embedding)::DOUBLE + 1) * 128)::BIGINT AS v, floor((unnest(list_reverse(embedding))::DOUBLE + 1) * 128)::BIGINT AS u FROM embeddings)"
_COV = f"WITH px AS ({_PX}), blocks AS (SELECT image_id, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, " + ", ".join(f"sum({k[0]} * {k[1]}) AS {k}" for k in fit.PAIRS) + " FROM px GROUP BY image_id, y // 8, x // 8), cov AS (SELECT image_id, sum(n) AS n, floor(sum(sr) / sum(n)) AS avg_r, " + ", ".join(f"sum({k} - s{k[0]}::DOUBLE * s{k[1]} / n) / sum(n) AS {k}" for k in fit.PAIRS) + " FROM blocks GROUP BY image_id HAVING sum(n) > 4096)"
query("o5_14_covariance", lambda s, d: fit.covariance(pixel_rows(s, d)), f"{_COV} SELECT * FROM cov", "", "image_id n avg_r", doubles=" ".join(fit.PAIRS))


def _inverse(s, d):
    cov = fit.covariance(pixel_rows(s, d)).select("image_id", *[F.round(k, 3).alias(k) for k in fit.PAIRS])
    return cov.select("image_id", *[(v * 1000).alias(m) for v, m in zip(fit.inverse([F.col(k) for k in fit.PAIRS]), fit.ENTRIES)])


def _inverse_sql() -> str:
    at = lambda i, j: fit.PAIRS[3 * (i % 3) + j % 3]
    minor = lambda i, j: f"({at(i + 1, j + 1)} * {at(i + 2, j + 2)} - {at(i + 1, j + 2)} * {at(i + 2, j + 1)})"
    det = f"({at(0, 0)} * {minor(0, 0)} + {at(0, 1)} * {minor(0, 1)} + {at(0, 2)} * {minor(0, 2)})"
    return f"{_COV}, r AS (SELECT image_id, " + ", ".join(f"round({k}, 3) AS {k}" for k in fit.PAIRS) + " FROM cov) SELECT image_id, " + ", ".join(f"1000 * {minor(i, j)} / {det} AS m{3 * j + i}" for j in range(3) for i in range(3)) + " FROM r"


query("o5_12_inverse", _inverse, _inverse_sql(), "", "image_id", doubles=" ".join(fit.ENTRIES))
query("o5_15_axes", lambda s, d: fit.axes(fit.covariance(pixel_rows(s, d))), "", "", "image_id avg_r", doubles="l0 l1 l2 " + " ".join(fit.ENTRIES), bools="good")


def _reach(s, d):
    """Along the axes of a fixed rotation, so that SQL states it."""
    rows = pixel_rows(s, d)
    fixed = fit.covariance(rows).select("image_id", "avg_r", *[F.lit(v).alias(f"i{k}") for k, v in enumerate(_AXES)])
    return fit.reach(rows, fixed)


_AXES = (0.5, 0.75, 0.25, 0.5, -0.5, 0.25, -0.25, 0.5, -0.75)
query("o5_16_reach", _reach, f"{_COV} SELECT image_id, max(list_max([1, " + ", ".join(f"abs({_AXES[3 * k]}::DOUBLE * (r - avg_r) + {_AXES[3 * k + 1]}::DOUBLE * (g - 128) + {_AXES[3 * k + 2]}::DOUBLE * (b - 128))" for k in range(3)) + "])) AS most FROM px JOIN (SELECT image_id, avg_r FROM cov) USING (image_id) GROUP BY image_id", "", "image_id", doubles="most")
query("o5_17_fitted", lambda s, d: fit.fitted(pixel_rows(s, d)), "", "", "image_id avg_r " + " ".join(fit.ENTRIES), bools="fits")
