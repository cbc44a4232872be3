"""Segments of an image: a risk for each block by its deviation, clusters of the risks' histogram, labels of blocks; and labels whose holes are filled."""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from glyphgrid.functions.fixed import idiv
from glyphgrid.operators import grid, histo, stencils

#: Pixels of a block's side, the largest logarithm of a deviation, that of the highest risk, and passes that fill holes.
SIDE, MOST, RISKIEST, PASSES = 4, 7.0, 2.0, 5


def risk(deviation: Column, levels: int) -> Column:
    """From 0 to levels - 1: highest for blocks of some detail, lower for smooth ones and for those of much detail."""
    log = F.when(deviation > 0, F.ln(deviation)).otherwise(0.0)
    top = MOST - RISKIEST
    away = MOST - F.least(F.greatest(log, F.lit(0.0)), F.lit(MOST))
    height = F.when(away > top, top * (1 - (away - top) / RISKIEST)).otherwise(away)
    return F.floor(height / top * (levels - 1) + 0.5).cast("long")


def block_risks(images: DataFrame, channel: str, levels: int) -> DataFrame:
    """(image_id, by, bx, score) of blocks of SIDE pixels, those cut by the border by what they have."""
    rows = grid.exploded(images, channel).groupBy("image_id", idiv(F.col("y"), SIDE).alias("by"), idiv(F.col("x"), SIDE).alias("bx"))
    sums = rows.agg(F.count("*").alias("n"), F.sum(channel).alias("s"), F.sum(F.col(channel) * F.col(channel)).alias("q"))
    # The variance in whole numbers first, so that flat blocks have none.
    spread = F.sqrt((F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")) / F.col("n")
    return sums.select("image_id", "by", "bx", risk(spread, levels).alias("score"))


def segments(risks: DataFrame, levels: int, most: int) -> DataFrame:
    """(image_id, by, bx, score, segment): scores clustered image by image into at most so many segments, counted by a groupBy before."""
    counted = risks.groupBy("image_id", "score").agg(F.count("*").alias("n")).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("score", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(levels - 1).cast("long")), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)))
    labels = histo.clustered(counted.select("image_id", counts.alias("counts")), most)
    return risks.join(labels.select("image_id", "labels"), "image_id").select("image_id", "by", "bx", "score", F.get("labels", F.col("score").cast("int")).alias("segment"))


def filled(label: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Labels of blocks, 0 or 1. Blocks of one colour take that of the block before them, or above in the first column. Then, block after block and
    PASSES times at most, a label that at most one of three or more neighbours has, or none, changes."""
    out = label.astype(bool).copy()
    h, w = out.shape
    for y in range(h):
        for x in range(w):
            if flat[y, x]:
                out[y, x] = out[y, x - 1] if x else out[y - 1, x] if y else False
    for _ in range(PASSES):
        changed = False
        for y in range(h):
            for x in range(w):
                around = [out[j, i] for j, i in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= j < h and 0 <= i < w]
                alike = sum(bool(a) == bool(out[y, x]) for a in around)
                if alike == 0 or (len(around) >= 3 and alike <= 1):
                    out[y, x] = not out[y, x]
                    changed = True
        if not changed:
            break
    return out.astype(np.int64)


def with_filled_holes(labels: DataFrame) -> DataFrame:
    """labels (image_id, w, h and the planes label and flat, a value for each block) to image_id, w, h and label. An image's labels are one row."""
    return stencils.on_rasters(labels, ("label", "flat"), {"label": "array<long>"}, lambda p: {"label": filled(p["label"], p["flat"] > 0)})
