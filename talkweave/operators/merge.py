"""Overlap-aware merge of chunk transcripts.

Shifting, clipping, margins and boundary flags are projections; only "compare with the last kept
segment" is sequential and runs as one walk over the segments sorted by recording and place.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.config import ChunkConfig
from talkweave.functions import scalars
from talkweave.functions import text as T

NO_METRIC = -99.0
METRICS = ("avg_logprob", "no_speech_prob", "compression_ratio", "temperature")
DISPOSED = "{key}, chunk_idx int, seq int, disposition string, start double, end double, text string, avg_logprob double, no_speech_prob double, compression_ratio double, temperature double, kept boolean"


def similarity(left: str, right: str) -> float:
    """M3: Ratcliff-Obershelp ratio on texts without white space, left first."""
    if left == right:
        return 1.0
    if not left or not right:
        return 0.0
    return difflib.SequenceMatcher(None, left, right).ratio()


def placed(segments: DataFrame, windows: DataFrame, cfg: ChunkConfig = ChunkConfig(), key: str = "recording_id") -> DataFrame:
    """Segments on the recording's time line, clipped to their window (M1's projections, M5, P7).

    segments: key, chunk_idx, seq, start, end (relative to raw_start), text, metrics; windows: chunk plan in samples.
    An end of 0 or null falls back to the shifted start and is shifted once more, as the merge has always done.
    Clipped is null for segments outside their main window.
    """
    return placed_rows(segments.join(windows, [key, "chunk_idx"]), cfg, key)


def placed_rows(both: DataFrame, cfg: ChunkConfig = ChunkConfig(), key: str = "recording_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """placed(), of segments that have their window's columns beside them; keep: further columns to carry."""
    rate = float(cfg.sample_rate)
    offset, low, high = F.col("raw_start") / rate, F.col("main_start") / rate, F.col("main_end") / rate
    start = F.coalesce("start", F.lit(0.0)) + offset
    end = F.when(F.coalesce("end", F.lit(0.0)) == 0, start).otherwise(F.col("end")) + offset
    both = both.withColumn("raw_from", start).withColumn("raw_to", end).withColumn("clipped", scalars.clipped(start, end, low, high))
    left, right = scalars.edge_distances(F.col("clipped.start"), F.col("clipped.end"), low, high)
    near = lambda margin: ((F.col("raw_start") < F.col("main_start")) & (left <= margin)) | ((F.col("raw_end") > F.col("main_end")) & (right <= margin))
    metric = lambda c, score: F.coalesce(score, F.lit(NO_METRIC))
    known = sum((F.col(c).isNotNull().cast("int") for c in METRICS[1:3]), F.col("avg_logprob").isNotNull().cast("int"))
    # M4: compared from left to right
    score = F.array(
        F.least(left, right),
        known.cast("double"),
        metric("avg_logprob", F.col("avg_logprob")),
        metric("no_speech_prob", -F.col("no_speech_prob")),
        metric("compression_ratio", -F.abs(F.col("compression_ratio") - 1)),
        F.col("clipped.end") - F.col("clipped.start"),
    )
    return both.select(
        key, "chunk_idx", "seq", "raw_from", "raw_to", F.col("clipped.start").alias("start"), F.col("clipped.end").alias("end"), F.coalesce("text", F.lit("")).alias("text"), *METRICS,
        T.without_space(F.coalesce("text", F.lit(""))).alias("bare"), near(cfg.boundary_margin).alias("boundary"), near(cfg.contained_margin).alias("contained"), score.alias("score"), *keep,
    )


def _ratio(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Overlap of two intervals relative to the shorter one."""
    shorter = min(max(a[1] - a[0], 1e-6), max(b[1] - b[0], 1e-6))
    return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / shorter


def duplicate(prev: dict, new: dict, cfg: ChunkConfig) -> bool:
    """M2: are two neighbours the same utterance?"""
    if not prev["bare"] or not new["bare"]:
        return False
    gap = new["start"] - prev["end"]
    if prev["bare"] == new["bare"] and gap <= cfg.duplicate_gap:
        return True
    at_edge, inside = prev["boundary"] or new["boundary"], prev["contained"] or new["contained"]
    raw = _ratio((prev["raw_from"], prev["raw_to"]), (new["raw_from"], new["raw_to"])) >= cfg.overlap_ratio
    if gap <= cfg.near_gap and raw:
        if inside and (prev["bare"] in new["bare"] or new["bare"] in prev["bare"]):
            return True
        if at_edge and similarity(prev["bare"], new["bare"]) >= cfg.similarity:
            return True
    clipped = gap <= cfg.clipped_gap and _ratio((prev["start"], prev["end"]), (new["start"], new["end"])) >= cfg.overlap_ratio
    return at_edge and clipped and similarity(prev["bare"], new["bare"]) >= cfg.similarity


class Walk:
    """M1 over the segments of one recording in order: what becomes of each. The last kept segment may still be replaced, so it is settled when the next one is kept."""

    def __init__(self, cfg: ChunkConfig, last: tuple[dict, str] | None = None) -> None:
        self.cfg, self.last = cfg, last

    def feed(self, row: dict) -> list[tuple[dict, str, bool]]:
        """(segment, disposition, is it in the result) of the segments that this one settles."""
        if row["start"] is None or row["start"] != row["start"]:
            return [(row, "clipped", False)]
        if self.last is None:
            self.last = (row, "kept")
            return []
        prev, how = self.last
        if not duplicate(prev, row, self.cfg):
            self.last = (row, "kept")
            return [(prev, how, True)]
        old, new = tuple(prev["score"]), tuple(row["score"])
        if new > old or new == old and row["end"] >= prev["end"]:
            self.last = (row, "replaced")
            return [(prev, how, False)]
        return [(row, "skipped", False)]

    def end(self) -> list[tuple[dict, str, bool]]:
        last, self.last = self.last, None
        return [] if last is None else [(*last, True)]


def _disposed(key: str, settled: list[tuple[dict, str, bool]]) -> pd.DataFrame:
    rows = [(r[key], r["chunk_idx"], r["seq"], what, *(r[c] for c in ("start", "end", "text", *METRICS)), kept) for r, what, kept in settled]
    return pd.DataFrame(rows, columns=[key, "chunk_idx", "seq", "disposition", "start", "end", "text", *METRICS, "kept"])


def _disposed_batch(key: str, kind: pa.DataType, settled: list[tuple[dict, str, bool]]) -> pa.RecordBatch:
    numbers = ("start", "end", *METRICS)
    of = lambda c, type_: pa.array([r[c] for r, _, _ in settled], type_, from_pandas=True)
    columns = {key: of(key, kind), "chunk_idx": of("chunk_idx", pa.int32()), "seq": of("seq", pa.int32()), "disposition": pa.array([what for _, what, _ in settled], pa.string())}
    columns |= {c: of(c, pa.string() if c == "text" else pa.float64()) for c in (*numbers[:2], "text", *METRICS)} | {"kept": pa.array([kept for _, _, kept in settled], pa.bool_())}
    return pa.record_batch(list(columns.values()), names=list(columns))


def dispositions(placed_segments: DataFrame, cfg: ChunkConfig = ChunkConfig(), key: str = "recording_id") -> DataFrame:
    """M1: what became of every segment: clipped, kept, skipped or replaced (it took the place of the one before); `kept` marks those in the result.

    Segments are sorted by recording and place (which spills) and walked batch by batch, so a recording costs its rows and no call of its own."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, current, kind = None, None, None
        for batch in batches:
            out, kind = [], batch.schema.field(key).type
            for row in batch.to_pylist():
                if walk is None or row[key] != current:
                    out += walk.end() if walk else []
                    walk, current = Walk(cfg), row[key]
                out += walk.feed(row)
            yield _disposed_batch(key, kind, out)
        if walk is not None:
            yield _disposed_batch(key, kind, walk.end())

    ordered = placed_segments.repartition(key).sortWithinPartitions(key, "chunk_idx", "seq")
    return ordered.mapInArrow(fold, DISPOSED.format(key=f"{key} {placed_segments.schema[key].dataType.simpleString()}"))


def merge_counters(disposed: DataFrame, key: str = "recording_id") -> DataFrame:
    """Input, clipped, kept, skipped and replaced per window and, with a null chunk_idx, per recording."""
    of = lambda name: F.count_if(F.col("disposition") == name).alias(name)
    return disposed.rollup(key, "chunk_idx").agg(F.count("*").alias("input"), of("clipped"), of("kept"), of("skipped"), of("replaced")).where(F.col(key).isNotNull())


def merged_results(disposed: DataFrame, partials: DataFrame, windows: DataFrame, cfg: ChunkConfig = ChunkConfig(), key: str = "recording_id") -> DataFrame:
    """M6: key, segments, text, duration.

    partials: key, chunk_idx, text, duration, n_segments. Without any kept segment: 0 seconds if all chunks were silent, else the
    joined partial texts and the end of the last window.
    """
    metrics = ["start", "end", "chunk_idx", "seq", "text", *METRICS]
    kept = disposed.where("kept").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*metrics))).alias("_s"))
    kept = kept.select(key, F.transform("_s", lambda s: s.dropFields("chunk_idx", "seq")).alias("segments"))
    blank = T.strip(F.coalesce("text", F.lit(""))) == ""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "")
    told = partials.groupBy(key).agg(F.bool_and((F.coalesce("n_segments", F.lit(0)) == 0) & blank & F.coalesce(F.col("duration") == 0, F.lit(False))).alias("silent"), T.strip(whole).alias("fallback"))
    last = windows.groupBy(key).agg(F.max_by("main_end", "chunk_idx").alias("_end"))
    out = told.join(last, key, "left").join(kept, key, "left")
    some = F.col("segments").isNotNull()
    text = F.when(some, T.strip(F.array_join(F.transform("segments", lambda s: s["text"]), ""))).otherwise(F.when(F.col("silent"), F.lit("")).otherwise(F.col("fallback")))
    duration = F.when(some, F.element_at("segments", -1)["end"]).when(F.col("silent"), F.lit(0.0)).otherwise(F.col("_end") / float(cfg.sample_rate))
    return out.select(key, F.coalesce("segments", F.array().cast(kept.schema["segments"].dataType)).alias("segments"), text.alias("text"), duration.alias("duration"))


def numbered(segments: DataFrame, key: str, order: str) -> DataFrame:
    """Ids by (start, end), ties by the order column."""
    return segments.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy("start", "end", order)) - 1)
