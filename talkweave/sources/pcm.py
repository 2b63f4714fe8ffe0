"""PCM recordings: decoding, slicing, resampling, hop sums.

Samples never become rows. Bytes are sliced natively before decoding wherever the
rate allows it, and one Python pass turns bytes into one row per hop (sum and count of absolute samples).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions import scalars

TARGET_RATE = 16_000
#: Hops in a batch that a task gives out.
BATCH_HOPS = 1 << 16


def error_kind(pcm: Column, rate: Column) -> Column:
    """What is wrong with an upload, null if nothing: invalid-sample-rate, empty-input or invalid-length."""
    size = F.coalesce(F.octet_length(pcm), F.lit(0))
    return F.when(F.coalesce(rate, F.lit(0)) <= 0, "invalid-sample-rate").when(size == 0, "empty-input").when(size % 2 == 1, "invalid-length")


def quarantine(recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) recordings; bad ones have error_kind."""
    judged = recordings.withColumn("error_kind", error_kind(F.col("pcm"), F.col("sample_rate")))
    return judged.where("error_kind is null").drop("error_kind"), judged.where("error_kind is not null")


def sliced(recordings: DataFrame, start: str, end: str) -> DataFrame:
    """Recordings cut to a window of seconds, by bytes, with the effective bounds in `window`. Resampling comes before slicing in
    meaning, so this is exact for recordings at the target rate; others are sliced by their own rate."""
    n = F.octet_length("pcm") / 2
    bounds = scalars.window_bounds(n, F.col("sample_rate"), F.col(start), F.col(end))
    cut = recordings.withColumn("window", bounds)
    at = F.col("window.start_sample")
    return cut.withColumn("pcm", F.substring(F.col("pcm"), (2 * at + 1).cast("int"), (2 * (F.col("window.end_sample") - at)).cast("int")))


def rolling(recordings: DataFrame, seconds: float = 25.0, step: float = 5.0) -> DataFrame:
    """The windows that a client which sends the last `seconds` every `step` seconds would send, each sliced out: recordings with now_total, window, pcm."""
    total = F.octet_length("pcm") / 2 / F.col("sample_rate")
    ends = F.sequence(F.lit(1).cast("long"), F.greatest(F.ceil(total / step), F.lit(1).cast("long")))
    sent = recordings.where("sample_rate > 0").withColumn("_total", total).withColumn("_n", F.explode(ends)).withColumn("now_total", F.least(F.col("_n") * step, F.col("_total")))
    cut = sliced(sent.withColumn("_start", F.greatest(F.col("now_total") - seconds, F.lit(0.0))), "_start", "now_total")
    return cut.drop("_total", "_n", "_start")


def resampled(wave: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation to max(1, round(n * target / source)) samples, on grids of float32 as models are fed them."""
    if source <= 0 or target <= 0:
        raise ValueError("invalid-sample-rate")
    if source == target or not len(wave):
        return wave
    n = max(1, round(len(wave) * target / source))
    grid = np.linspace(0, len(wave) - 1, num=n, dtype=np.float32)
    return np.interp(grid, np.arange(len(wave), dtype=np.float32), wave).astype(np.float32)


def waveform(pcm: bytes | pa.Buffer, rate: int, target: int = TARGET_RATE) -> np.ndarray:
    """16-bit little-endian mono as float32 in [-1, 1) at the target rate."""
    return resampled(np.frombuffer(pcm, "<i2").astype(np.float32) / 32768.0, rate, target)


def mono(wave: np.ndarray) -> np.ndarray:
    """Mean over the last axis; a scalar is one sample."""
    wave = np.atleast_1d(np.asarray(wave, np.float32))
    return wave if wave.ndim == 1 else wave.mean(axis=-1)


def hop_sums(recordings: DataFrame, hop_seconds: float = 0.01, target: int = TARGET_RATE) -> DataFrame:
    """recording_id, frame_idx, sum_abs, n for each hop of every recording, at the target rate.

    C5: a recording that can't be decoded has no hops, hence no speech, and is tiled as a whole; the others go on.
    """

    hop = max(1, int(target * hop_seconds))
    names = ["recording_id", "frame_idx", "sum_abs", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[pa.RecordBatch] = []
            held = 0
            for key, rate, raw in zip(*(batch.column(c) for c in ("recording_id", "sample_rate", "pcm")), strict=True):
                wave = _waveform_or_none(raw, rate.as_py(), target)
                if wave is None or not len(wave):
                    continue
                loud = np.abs(wave.astype(np.float64))
                at = np.arange(0, len(loud), hop)
                parts.append(pa.record_batch([pa.repeat(key, len(at)), pa.array(np.arange(len(at))), pa.array(np.add.reduceat(loud, at)), pa.array(np.minimum(hop, len(loud) - at))], names=names))
                held += len(at)
                if held > BATCH_HOPS:
                    yield _joined(parts)
                    parts, held = [], 0
            if parts:
                yield _joined(parts)

    return recordings.select("recording_id", "sample_rate", "pcm").mapInArrow(run, "recording_id string, frame_idx long, sum_abs double, n long")


def _waveform_or_none(raw: pa.Scalar, rate: int | None, target: int) -> np.ndarray | None:
    try:
        return waveform(raw.as_buffer(), int(rate), target)
    except (ValueError, TypeError, AttributeError):
        return None


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def loudness(recordings: DataFrame) -> DataFrame:
    """recording_id, mean_abs, max_abs, n: what F1 needs, one row per recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = []
            for rate, raw in zip(batch.column("sample_rate").to_pylist(), batch.column("pcm"), strict=True):
                wave = np.abs(waveform(raw.as_buffer(), int(rate)))
                facts.append((float(wave.mean()), float(wave.max()), len(wave)) if len(wave) else (0.0, 0.0, 0))
            columns = list(zip(*facts, strict=True)) or [(), (), ()]
            yield pa.record_batch([batch.column("recording_id"), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], names=["recording_id", "mean_abs", "max_abs", "n"])

    return recordings.select("recording_id", "sample_rate", "pcm").mapInArrow(run, "recording_id string, mean_abs double, max_abs double, n long")
