"""Energy-based voice activity detection as relational operators.

PCM becomes one row per hop (sum and count of absolute samples) in Python; all the rest is windows and
aggregates over (recording, frame), with one exchange on the recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.config import VadConfig
from talkweave.functions import scalars
from talkweave.operators import intervals
from talkweave.sources import pcm

KEY = "recording_id"


def silent(mean_abs: Column, max_abs: Column, n: Column, threshold: float = 1e-3) -> Column:
    """nothing there, or quiet on average and nowhere loud."""
    return (F.coalesce(n, F.lit(0)) == 0) | ((mean_abs < threshold) & (max_abs < 5 * threshold))


def frame_energies(hops: DataFrame, hops_per_frame: int, key: str = KEY, order: str = "frame_idx") -> DataFrame:
    """A1: mean absolute sample of overlapping frames from sums per hop; frames at the end are shorter and divided by what they hold."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, hops_per_frame - 1)
    return hops.withColumn("energy", F.sum("sum_abs").over(w) / F.sum("n").over(w))


def smoothed(df: DataFrame, value: str, width: int, key: str = KEY, order: str = "frame_idx") -> DataFrame:
    """Centred moving sum over a fixed width, zero-padded at the edges."""
    if width <= 1:
        return df
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn(value, F.sum(value).over(w) / width)


def quantile(frames: DataFrame, value: str, share: float, key: str = KEY) -> DataFrame:
    """key, quantile, top: the two values around a share of the sorted ones, low * (1 - d) + high * d, and the largest one. Nulls don't count.

    Energies are compared with multiples of it, so its last bit decides where they meet exactly. The first product isn't rounded, as in the
    queries' SQL; percentile() has the same weights but rounds it, and is a bit off for some keys."""
    values = frames.select(key, F.col(value).cast("double").alias("_v"))
    ranked = values.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_v").asc_nulls_last())) - 1).withColumn("_at", (F.count("_v").over(Window.partitionBy(key)) - 1) * F.lit(float(share)))
    of = lambda n: F.max(F.when(F.col("_n") == n, F.col("_v")))
    found = ranked.groupBy(key).agg(of(F.floor("_at")).alias("_a"), of(F.ceil("_at")).alias("_b"), F.max("_at").alias("_at"), F.max("_v").alias("top"))
    d = F.col("_at") - F.floor("_at")
    between = F.when(d == 0, F.col("_a")).otherwise(scalars.multiply_add(F.col("_a"), 1 - d, F.col("_b") * d))
    return found.select(key, between.alias("quantile"), "top")


def thresholds(frames: DataFrame, cfg: VadConfig, key: str = KEY) -> DataFrame:
    """A2, A3: key, on, off. Exact interpolated noise quantile; the lower of a noise multiple and a share of the dynamic range, below the peak."""
    got = quantile(frames, "energy", cfg.noise_quantile, key).withColumnsRenamed({"quantile": "noise", "top": "peak"})
    ratio = F.greatest(F.col("noise") * cfg.energy_ratio, F.lit(cfg.min_energy))
    dynamic = F.when(F.col("peak") > F.col("noise"), F.col("noise") + cfg.dynamic_share * (F.col("peak") - F.col("noise"))).otherwise(F.col("peak"))
    value = F.least(F.least(ratio, dynamic), cfg.peak_share * F.col("peak"))
    value = F.when(F.isnan(value) | value.isNull() | (value <= 0), F.lit(cfg.min_energy)).otherwise(value)
    if cfg.fixed_threshold is not None and cfg.fixed_threshold > 0:
        value = F.lit(float(cfg.fixed_threshold))
    return got.select(key, value.alias("on"), F.least(value * cfg.hysteresis_ratio, value).alias("off"))


def hysteresis(df: DataFrame, value: str, on: Column, off: Column, start: int, end: int, key: str = KEY, order: str = "frame_idx") -> DataFrame:
    """Column `flag`. On after `start` values at or above on, back-dated; off after `end` values at or below off, back-dated.

    Values that aren't finite count as 0, and off is clamped to on. Where off is below on (the same for all rows of a key), windows decide: a row
    decides on if the last `start` values are all high, off if the last `end` are all low; the state holds in between, and a change
    reaches back over the run that caused it. Where both are equal, a value may be high and low at once and
    only the order of events tells, so the rows of such a key are walked.
    """
    df = df.withColumn("_value", F.coalesce(scalars.finite(F.col(value)), F.lit(0.0))).withColumn("_on", on.cast("double")).withColumn("_off", F.least(off, on).cast("double"))
    apart = F.col("_off") < F.col("_on")
    names = [c for c in df.columns if c not in ("_value", "_on", "_off")]
    w = Window.partitionBy(key).orderBy(order)
    full = lambda n: F.count(F.lit(1)).over(w.rowsBetween(-(n - 1), 0)) == n
    event = F.when(full(start) & (F.min("_value").over(w.rowsBetween(-(start - 1), 0)) >= F.col("_on")), 1).when(full(end) & (F.max("_value").over(w.rowsBetween(-(end - 1), 0)) <= F.col("_off")), 0)
    wide = df.where(apart).withColumn("_event", event)
    wide = wide.withColumn("_state", F.coalesce(F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    wide = wide.withColumn("_turn", F.when(F.col("_state") != F.coalesce(F.lag("_state").over(w), F.lit(0)), F.col("_state")))
    ahead = lambda kind, n: F.max((F.coalesce(F.col("_turn"), F.lit(-1)) == kind).cast("int")).over(w.rowsBetween(0, n - 1)) == 1
    flag = ((F.col("_state") == 1) | ahead(1, start)) & ~ahead(0, end)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(flag=hysteresis_walk(pdf["_value"].to_numpy(), float(pdf["_on"].iloc[0]), float(pdf["_off"].iloc[0]), start, end))[[*names, "flag"]]

    schema = T.StructType([*(f for f in df.schema if f.name in names), T.StructField("flag", T.BooleanType())])
    level = df.where(~F.coalesce(apart, F.lit(False)) & F.col("_on").isNotNull()).groupBy(key).applyInPandas(walk, schema)
    return wide.select(*names, flag.alias("flag")).unionByName(level)


def hysteresis_walk(values: np.ndarray, on: float, off: float, start: int, end: int) -> np.ndarray:
    """W2 on one series, event by event."""
    flags = np.zeros(len(values), bool)
    state, run = False, 0
    for k, v in enumerate(values):
        run = run + 1 if (v <= off if state else v >= on) else 0
        flags[k] = state
        if run >= max(1, end if state else start):
            state = not state
            flags[k - run + 1 : k + 1] = state
            run = 0
    return flags


def model_segments(recordings: DataFrame, model: Callable[[np.ndarray], dict] | None) -> DataFrame:
    """Key, start, end, no_speech_prob from a model hook: waveform -> {"segments": [...]}. Without a model, or where it fails on a recording,
    there are no segments, and the caller's energies decide alone; a recording that the model finds empty has one segment of no length, so it counts as known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, rate, raw in zip(pdf[KEY], pdf["sample_rate"], pdf["pcm"], strict=True):
                try:
                    found = model(pcm.waveform(raw, int(rate))).get("segments") or []
                    rows.append((name, 0.0, 0.0, None))
                    rows += [(name, float(s["start"]), float(s["end"]), s.get("no_speech_prob")) for s in found if isinstance(s, dict) and all(isinstance(s.get(c), (int, float)) for c in ("start", "end"))]
                except Exception:  # a model that fails tells nothing
                    rows = [r for r in rows if r[0] != name]
            yield pd.DataFrame(rows, columns=[KEY, "start", "end", "no_speech_prob"])

    usable = recordings if model is not None else recordings.where("false")
    return usable.select(KEY, "sample_rate", "pcm").mapInPandas(run, f"{KEY} string, start double, end double, no_speech_prob double")


def fused(frames: DataFrame, cfg: VadConfig, key: str = KEY) -> DataFrame:
    """`score` from `energy`, `on` and `probability`: weighted by normalised weights, gated by the model, smoothed."""
    total = cfg.energy_weight + cfg.model_weight
    we, wm = (cfg.energy_weight / total, cfg.model_weight / total) if total > 0 else (0.5, 0.5)
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    width = cfg.fusion_smoothing_frames or cfg.smoothing_frames
    frames = smoothed(frames.withColumn("probability", unit(F.col("probability"))), "probability", width, key)
    gate = unit(F.col("probability") / cfg.fusion_gate) if cfg.fusion_gate > 0 else F.lit(1.0)
    energy = unit(F.col("energy") / (2 * F.col("on")))
    frames = frames.withColumn("score", (we * energy + wm * F.col("probability")) * gate)
    return smoothed(frames, "score", width, key)


def speech_segments(hops: DataFrame, recordings: DataFrame, cfg: VadConfig = VadConfig(), segments: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """Key, seg_idx, start_sample, end_sample, start, end.

    hops: key, frame_idx, sum_abs, n (samples per hop); recordings: key, sample_rate, total (samples).
    With cfg.fusion and model segments (key, start, end, no_speech_prob), frames are judged on the fused score.
    """
    per_frame = max(1, round(cfg.frame_duration / cfg.hop_duration))
    frames = smoothed(frame_energies(hops, per_frame, key), "energy", cfg.smoothing_frames, key)
    frames = frames.join(thresholds(frames, cfg, key), key)
    if cfg.fusion and segments is not None:
        known = segments.select(key).distinct().withColumn("_known", F.lit(True))
        frames = fused(intervals.frame_probabilities(frames, segments, cfg.hop_duration, key), cfg, key).join(known, key, "left")
        frames = frames.withColumn("energy", F.when(F.col("_known"), F.col("score")).otherwise(F.col("energy")))
        frames = frames.withColumn("on", F.when(F.col("_known"), F.lit(cfg.fusion_on)).otherwise(F.col("on"))).withColumn("off", F.when(F.col("_known"), F.lit(cfg.fusion_off)).otherwise(F.col("off")))
    flagged = hysteresis(frames, "energy", F.col("on"), F.col("off"), cfg.start_frames, cfg.end_frames, key)
    runs = intervals.true_runs(flagged, key, "frame_idx", "flag").join(recordings, key)
    hop, size = F.floor(F.col("sample_rate") * cfg.hop_duration).cast("long"), F.floor(F.col("sample_rate") * cfg.frame_duration).cast("long")
    runs = runs.withColumn("start_sample", F.least(F.col("first") * hop, F.col("total"))).withColumn("end_sample", F.least(F.col("last") * hop + size, F.col("total")))
    # seconds to samples, half-even; the gap differs by recording, so it is subtracted from starts beforehand
    at = lambda s: F.rint(F.lit(s) * F.col("sample_rate")).cast("long")
    rows = runs.select(key, "start_sample", "end_sample", at(cfg.min_silence).alias("_gap"))
    chains = intervals.merged(rows, key, "start_sample", "end_sample", F.col("_gap")).join(recordings, key)
    kept = chains.where(intervals.long_enough(F.col("start_sample"), F.col("end_sample"), at(cfg.min_speech)))
    low, high = intervals.padded(F.col("start_sample"), F.col("end_sample"), at(cfg.padding), F.col("total"))
    out = kept.select(key, low.alias("start_sample"), high.alias("end_sample"), "sample_rate")
    index = F.row_number().over(Window.partitionBy(key).orderBy("start_sample")) - 1
    return out.select(key, index.cast("int").alias("seg_idx"), "start_sample", "end_sample", (F.col("start_sample") / F.col("sample_rate")).alias("start"), (F.col("end_sample") / F.col("sample_rate")).alias("end"))
