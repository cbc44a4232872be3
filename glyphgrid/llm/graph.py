"""Connected components by alternating large-star and small-star steps (Kiveris and others, 2014)."""

from pyspark.sql import DataFrame, functions as F

from glyphgrid.llm.common import drop, shuffles_end, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Large: larger neighbours go to the least one; small: smaller ones and the node itself do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if large:
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    with shuffles_end(edges.sparkSession):
        return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """edges (a, b) to rows (a, b): b is the least node of a's component, for each a that isn't the least itself; and their path."""
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = written(now, "edges")
    while not _settled(now):
        step, after = written(_star(_star(now, True), False), "stars")
        drop(spark, path)
        now, path = step, after
    return now, path
