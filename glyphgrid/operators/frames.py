"""Frames of animations: final frames, dispose chains, windows, validity, and what a skip lets be discarded.

Frames are rows (anim_id, frame_idx, duration_ms, disposes, x, y, w, h, num_bytes). Frames of no duration
are preframes: they belong to the next regular frame.
"""

from pyspark.sql import DataFrame, Window, functions as F

#: Preframes of one regular frame, and regular frames after one that disposes, at most; largest side.
MOST_PREFRAMES, MOST_DEPENDENT, MOST_SIDE, MOST_AREA = 4, 16, 1 << 24, 1 << 28


def _rows(to: int):
    """An animation's frames up to so many after this one."""
    return Window.partitionBy("anim_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, to)


def final_index(frames: DataFrame) -> DataFrame:
    """With ``final_idx``: how many regular frames are before."""
    return frames.withColumn("final_idx", F.coalesce(F.sum(F.when(F.col("duration_ms") > 0, 1).otherwise(0)).over(_rows(-1)), F.lit(0)))


def features(frames: DataFrame) -> DataFrame:
    """With final_idx, position in bytes, the final index of the last frame that disposes, and a regular frame's window united
    with those of its preframes."""
    rows = final_index(frames)
    rows = rows.withColumn("position", F.coalesce(F.sum("num_bytes").over(_rows(-1)), F.lit(0)))
    rows = rows.withColumn("last_dispose", F.last(F.when(F.col("disposes"), F.col("final_idx")), ignorenulls=True).over(_rows(0)))
    group = Window.partitionBy("anim_id", "final_idx").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    regular = F.col("duration_ms") > 0
    left, top = F.min("x").over(group), F.min("y").over(group)
    right, bottom = F.max(F.col("x") + F.col("w")).over(group), F.max(F.col("y") + F.col("h")).over(group)
    whole = {"wx": F.when(regular, left).otherwise(F.col("x")), "wy": F.when(regular, top).otherwise(F.col("y")), "ww": F.when(regular, right - left).otherwise(F.col("w")), "wh": F.when(regular, bottom - top).otherwise(F.col("h"))}
    return rows.withColumns(whole)


def valid(frames: DataFrame, width: int, height: int) -> DataFrame:
    """With ``ok``: the first frame disposes, the last isn't a preframe, windows lie inside, and no chain is too long."""
    rows = features(frames)
    n = F.count("*").over(Window.partitionBy("anim_id"))
    preframes = F.col("frame_idx") - F.coalesce(F.max(F.when(F.col("duration_ms") > 0, F.col("frame_idx"))).over(_rows(-1)), F.lit(0))
    ok = (F.col("frame_idx") > 0) | F.col("disposes")
    ok &= (F.col("frame_idx") < n - 1) | (F.col("duration_ms") > 0)
    ok &= (F.col("x") + F.col("w") <= width) & (F.col("y") + F.col("h") <= height)
    ok &= F.col("disposes") | (F.col("duration_ms") > 0) | (preframes <= MOST_PREFRAMES)
    ok &= F.col("disposes") | (F.col("final_idx") - F.col("last_dispose") <= MOST_DEPENDENT + 1)
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def first_raw_frame(frames: DataFrame) -> DataFrame:
    """anim_id, final_idx, first_idx: the frame after the regular frame before."""
    return final_index(frames).groupBy("anim_id", "final_idx").agg(F.min("frame_idx").alias("first_idx"))


def skip_plan(frames: DataFrame, skip) -> DataFrame:
    """anim_id, discard: how many raw frames needn't be decoded to show the final frame numbered skip.

    None if it is 0; otherwise those before the first raw frame of the last final frame that disposes; all if there are fewer final frames.
    """
    rows = features(frames)
    target = rows.filter((F.col("duration_ms") > 0) & (F.col("final_idx") == skip)).select("anim_id", "last_dispose")
    start = first_raw_frame(frames).select("anim_id", F.col("final_idx").alias("last_dispose"), "first_idx")
    found = target.join(start, ["anim_id", "last_dispose"]).select("anim_id", "first_idx")
    whole = rows.groupBy("anim_id").agg(F.count("*").alias("n"))
    return whole.join(found, "anim_id", "left").select("anim_id", F.when(F.lit(skip) == 0, 0).otherwise(F.coalesce("first_idx", "n")).alias("discard"))


def discarded(frames: DataFrame, skip) -> DataFrame:
    """The frames that are left when a skip is planned."""
    return frames.join(skip_plan(frames, skip), "anim_id").filter(F.col("frame_idx") >= F.col("discard")).drop("discard")


def next_header(frames: DataFrame) -> DataFrame:
    """With what is known of the next frame before its pixels: its duration, and whether there is one."""
    ahead = Window.partitionBy("anim_id").orderBy("frame_idx")
    return frames.withColumn("next_duration_ms", F.lead("duration_ms").over(ahead)).withColumn("is_last", F.lead("frame_idx").over(ahead).isNull())


def sizes_ok(w, h):
    """Whether an image's sides and area are within the limits."""
    return (w >= 1) & (h >= 1) & (w <= MOST_SIDE) & (h <= MOST_SIDE) & (w.cast("long") * h <= MOST_AREA)


def tile_of(x, y, size: int):
    from glyphgrid.functions.fixed import idiv

    return idiv(y, size), idiv(x, size)
