"""Interval operators: islands, merging, tiling, chunk planning and projection to frames.

All are windows or generators over one partition key (a recording, user or session), so one
exchange on that key serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, key: str, start: str, end: str, gap: float | int | Column = 0) -> DataFrame:
    """Key, start, end of maximal chains where each interval starts at most `gap` after all earlier ones have ended.

    The running maximum of ends, not the previous end, decides, so nested intervals don't split a chain.
    """
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col(start) - reach <= gap, 0).otherwise(1))
    numbered = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def expanded(df: DataFrame, key: str, start: str, end: str, margin: int | Column, total: str) -> DataFrame:
    """Widened by the margin inside [0, total], empty ones dropped, touching ones merged."""
    wide = df.withColumn(start, F.greatest(F.col(start) - margin, F.lit(0))).withColumn(end, F.least(F.col(end) + margin, F.col(total)))
    return merged(wide.where(F.col(end) > F.col(start)), key, start, end)


def true_runs(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Key, first, last (positions) of maximal runs of true flags over consecutive rows."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_row", F.row_number().over(w.orderBy(order)))
    on = ranked.where(F.col(flag)).withColumn("_run", F.col("_row") - F.row_number().over(w.orderBy(order)))
    return on.groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_run")


def long_enough(start: Column, end: Column, least: float | int) -> Column:
    """F3."""
    return end - start >= least


def padded(start: Column, end: Column, padding: int | Column, total: Column) -> tuple[Column, Column]:
    """wider on both sides, inside [0, total]."""
    return F.greatest(start - padding, F.lit(0)), F.least(end + padding, total)


def tiles(length: Column, chunk: Column, overlap: Column) -> Column:
    """Array of struct(raw_start, raw_end, main_start, main_end) that tiles [0, length); raw ends reach into the neighbours by the overlap.

    A chunk of 0 or less gives one tile. The overlap is at most half a chunk.
    """
    length, chunk = length.cast("long"), chunk.cast("long")
    whole = (chunk <= 0) | (length <= 0)
    step = F.when(whole, F.greatest(length, F.lit(1))).otherwise(chunk)
    reach = F.greatest(F.least(overlap.cast("long"), F.floor(step / 2).cast("long")), F.lit(0).cast("long"))
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(length - 1, F.lit(0)), step))

    def tile(s: Column) -> Column:
        end = F.when(whole, length).otherwise(F.least(s + step, length))
        near = F.when(whole, F.lit(0).cast("long")).otherwise(reach)
        return F.struct(F.greatest(s - near, F.lit(0).cast("long")).alias("raw_start"), F.least(end + near, length).alias("raw_end"), s.alias("main_start"), end.alias("main_end"))

    return F.transform(starts, tile)


def chunk_plan(recordings: DataFrame, speech: DataFrame, chunk: int, overlap: int, margin: int, key: str = "recording_id") -> DataFrame:
    """Chunk windows of every recording. recordings: key, total; speech: key, start_sample, end_sample.

    Speech ranges are widened and merged, then each is tiled by itself, so overlaps never cross a range. A recording without speech is
    tiled as a whole.
    """
    ranges = expanded(speech.join(recordings, key), key, "start_sample", "end_sample", margin, "total")
    silent = recordings.join(speech.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("start_sample"), F.col("total").cast("long").alias("end_sample"))
    tiled = ranges.select(key, "start_sample", "end_sample").unionByName(silent)
    tile = tiles(F.col("end_sample") - F.col("start_sample"), F.lit(chunk), F.lit(overlap))
    cut = tiled.select(key, F.col("start_sample").alias("_at"), F.explode(tile).alias("t"))
    names = ("raw_start", "raw_end", "main_start", "main_end")
    placed = cut.select(key, *((F.col(f"t.{c}") + F.col("_at")).alias(c) for c in names))
    return placed.withColumn("chunk_idx", (F.row_number().over(Window.partitionBy(key).orderBy("main_start")) - 1).cast("int")).select(key, "chunk_idx", *names)


def split_long(df: DataFrame, start: str, end: str, most: int | None) -> DataFrame:
    """Intervals cut into pieces of at most `most`; null or 0 leaves them."""
    if not most or most <= 0:
        return df
    cuts = F.explode(F.sequence(F.col(start), F.greatest(F.col(end) - 1, F.col(start)), F.lit(most)))
    others = [c for c in df.columns if c not in (start, end)]
    return df.select(*others, F.col(end).alias("_end"), cuts.alias(start)).select(*others, start, F.least(F.col(start) + most, F.col("_end")).alias(end))


def frame_probabilities(frames: DataFrame, segments: DataFrame, hop: float, key: str = "recording_id") -> DataFrame:
    """Largest speech probability of the segments that touch a frame, 0 without any.

    frames: key, frame_idx; segments: key, start, end, no_speech_prob (null and what isn't finite count as 0). Intervals that are
    reversed or not finite are left out. Each segment becomes its frame numbers, so the range join is an equi-join; frames beyond
    the last one of a key are not made.
    """
    from talkweave.functions.scalars import finite

    last = frames.groupBy(key).agg(F.max("frame_idx").alias("_last"))
    usable = segments.select(key, finite(F.col("start")).alias("start"), finite(F.col("end")).alias("end"), finite(F.col("no_speech_prob")).alias("no_speech_prob")).where("end > start").join(last, key)
    low, high = F.greatest(F.floor(F.col("start") / hop), F.lit(0)).cast("long"), F.least(F.ceil(F.col("end") / hop).cast("long"), F.col("_last").cast("long") + 1)
    probability = F.least(F.greatest(1 - F.coalesce("no_speech_prob", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    spread = usable.where(high > low).select(key, probability.alias("p"), F.explode(F.sequence(low, high - 1)).alias("frame_idx"))
    best = spread.groupBy(key, "frame_idx").agg(F.max("p").alias("p"))
    return frames.join(best, [key, "frame_idx"], "left").withColumn("probability", F.coalesce("p", F.lit(0.0))).drop("p")


#: Seconds of one cell that intervals are joined by.
CELL = 60.0


def beside(left: DataFrame, right: DataFrame, on: list[str], start: Column, end: Column, right_start: Column, right_end: Column, cell: float = CELL) -> DataFrame:
    """left joined to the right rows of equal `on` whose interval overlaps or touches its own, as an equi-join on cells of time.

    Both sides are filed under the cells that they touch; a pair is made in the first cell that both have, so a long recording's
    rows meet only what lies near them. start, end: of left rows; right_start, right_end: of right rows.
    """
    cells = lambda a, b: F.sequence(F.floor(a / cell), F.greatest(F.floor(b / cell), F.floor(a / cell)))
    l_rows = left.withColumn("_first", F.floor(start / cell)).withColumn("_cell", F.explode(cells(start, end)))
    r_rows = right.withColumn("_right_first", F.floor(right_start / cell)).withColumn("_cell", F.explode(cells(right_start, right_end)))
    both = l_rows.join(r_rows, [*on, "_cell"]).where(F.col("_cell") == F.greatest("_first", "_right_first"))
    return both.drop("_first", "_right_first", "_cell")


def clipped_to(segments: DataFrame, windows: DataFrame, on: list[str]) -> DataFrame:
    """Segments joined to their window by position and clipped to its main part, in seconds. windows: on, window_start, window_end."""
    from talkweave.functions.scalars import clipped

    both = beside(segments, windows, on, F.col("start"), F.col("end"), F.col("window_start"), F.col("window_end"))
    cut = both.withColumn("_c", clipped(F.col("start"), F.col("end"), F.col("window_start"), F.col("window_end"))).where("_c is not null")
    return cut.withColumn("start", F.col("_c.start")).withColumn("end", F.col("_c.end")).drop("_c")
