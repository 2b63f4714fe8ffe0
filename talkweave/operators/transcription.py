"""The whole path of a recording: PCM to a cleaned, diagnosed transcript.

Recognition itself is a hook: a function (waveform, language, condition_on_previous_text) ->
{"text", "segments": [...]} that runs in mapInPandas, once for each chunk with sound in it and once more for looping
decodes. Chunks are cut out of the bytes before they reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.config import ChunkConfig, QualityConfig, VadConfig
from talkweave.functions import text as T
from talkweave.operators import intervals, merge, quality, vad
from talkweave.session import materialized, small_batches
from talkweave.sources import pcm

Recognizer = Callable[[np.ndarray, str, bool], dict]
METRICS = ("avg_logprob", "no_speech_prob", "compression_ratio", "temperature")
DECODED = "recording_id string, chunk_idx int, attempt_no int, condition boolean, text string, segments array<struct<seq: int, start: double, end: double, text: string, avg_logprob: double, no_speech_prob: double, compression_ratio: double, temperature: double>>"


def planned(recordings: DataFrame, chunks: ChunkConfig = ChunkConfig(), activity: VadConfig = VadConfig()) -> DataFrame:
    """Chunk windows. Recordings no longer than a chunk are one window without a look for speech."""
    rate = chunks.sample_rate
    sized = recordings.select("recording_id", "sample_rate", "pcm", F.rint(F.octet_length("pcm") / 2 * rate / F.col("sample_rate")).cast("long").alias("total"))
    samples = lambda s: round(s * rate)
    short = (F.col("total") <= samples(chunks.chunk_seconds)) if chunks.chunk_seconds > 0 else F.lit(True)
    long = sized.where(~short)
    rated = long.select("recording_id", F.lit(rate).alias("sample_rate"), "total")
    speech = vad.speech_segments(pcm.hop_sums(long, activity.hop_duration, rate), rated, activity)
    plan = intervals.chunk_plan(rated.select("recording_id", "total"), speech.select("recording_id", "start_sample", "end_sample"), samples(chunks.chunk_seconds), samples(chunks.overlap), samples(chunks.margin))
    zero = F.lit(0).cast("long")
    whole = sized.where(short).select("recording_id", F.lit(0).alias("chunk_idx"), zero.alias("raw_start"), F.col("total").alias("raw_end"), zero.alias("main_start"), F.col("total").alias("main_end"))
    return plan.unionByName(whole)


def decoded(pieces: DataFrame, recognize: Recognizer, language: str, attempt: int, condition: bool, threshold: float) -> DataFrame:
    """One decode of each piece (recording_id, chunk_idx, sample_rate, pcm); silent ones give no text and never reach the recognizer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, idx, rate, raw in zip(pdf["recording_id"], pdf["chunk_idx"], pdf["sample_rate"], pdf["pcm"], strict=True):
                wave = pcm.waveform(raw, int(rate))
                loud = np.abs(wave)
                quiet = not len(wave) or (loud.mean() < threshold and loud.max() < 5 * threshold)
                got = {"text": "", "segments": []} if quiet else recognize(wave, language, condition)
                segments = [{"seq": i, "start": s.get("start"), "end": s.get("end"), "text": s.get("text") or "", **{m: s.get(m) for m in METRICS}} for i, s in enumerate(got.get("segments") or [])]
                rows.append((key, idx, attempt, condition, got.get("text") or "", segments))
            yield pd.DataFrame(rows, columns=["recording_id", "chunk_idx", "attempt_no", "condition", "text", "segments"])

    small_batches(pieces.sparkSession)
    return pieces.select("recording_id", "chunk_idx", "sample_rate", "pcm").mapInPandas(run, DECODED)


def judged(attempts: DataFrame, cfg: QualityConfig) -> DataFrame:
    """Each decode with F9 (repeated) and F5 (forced), by native aggregates over its segments."""
    names = ["recording_id", "chunk_idx", "attempt_no"]
    key = F.concat_ws("\0", *names)
    flat = attempts.select(key.alias("k"), F.explode_outer("segments").alias("s")).select("k", "s.seq", "s.text", *(f"s.{m}" for m in METRICS)).where("seq is not null")
    facts = quality.metrics(flat, "k", cfg).join(quality.repeated_segments(flat, "k", "seq", cfg), "k")
    both = attempts.withColumn("k", key).withColumnRenamed("segments", "items").join(facts.drop("segments"), "k", "left").withColumn("segments", F.size("items"))
    forced = quality.forced_silence(F.col("text"), cfg)
    return both.select(*names, "condition", "text", F.coalesce("repeated", F.lit(False)).alias("repeated"), forced.alias("forced"), F.col("items").alias("segments"))


def transcribed(recordings: DataFrame, recognize: Recognizer, language: str = "ja", chunks: ChunkConfig = ChunkConfig(), activity: VadConfig = VadConfig(), cfg: QualityConfig = QualityConfig(), remove_fillers: bool = False) -> DataFrame:
    """recording_id, text, duration, segments, flags and metrics. recordings: recording_id, sample_rate, pcm, without errors.

    What is used more than once is computed once: each recognizer call happens once per piece and attempt, whatever reads its result.
    Order: plan, decode, retry, silence, merge, fillers, diagnostics on the cleaned text (C11).
    """
    windows = materialized(planned(recordings, chunks, activity))
    scale = F.col("sample_rate") / float(chunks.sample_rate)
    first, size = F.rint(F.col("raw_start") * scale).cast("int"), F.rint((F.col("raw_end") - F.col("raw_start")) * scale).cast("int")
    pieces = windows.join(recordings.select("recording_id", "sample_rate", "pcm"), "recording_id").select("recording_id", "chunk_idx", "sample_rate", F.substring(F.col("pcm"), 2 * first + 1, 2 * size).alias("pcm"))
    one = judged(materialized(decoded(pieces, recognize, language, 1, True, cfg.silence_threshold)), cfg)
    looping = one.where((T.repeated_tail(F.col("text")) | F.col("repeated")) & ~T.garbled(F.col("text"))).select("recording_id", "chunk_idx")
    two = judged(materialized(decoded(pieces.join(looping, ["recording_id", "chunk_idx"], "left_semi"), recognize, language, 2, False, cfg.silence_threshold)), cfg)
    attempts = materialized(one.unionByName(two))
    settled = quality.retry_decision(attempts, ["recording_id", "chunk_idx"])
    last = attempts.groupBy("recording_id", "chunk_idx").agg(F.max_by("segments", "attempt_no").alias("segments"))
    partials = materialized(settled.join(last, ["recording_id", "chunk_idx"]))
    kept = partials.where("decision = 'keep'")
    flat = kept.select("recording_id", "chunk_idx", F.explode("segments").alias("s")).select("recording_id", "chunk_idx", "s.*")
    disposed = materialized(merge.dispositions(merge.placed(flat, windows, chunks), chunks))
    size_of = F.when(F.col("decision") == "keep", F.size("segments")).otherwise(0)
    silent = F.when((F.col("decision") != "keep") | ((F.size("segments") == 0) & (T.strip(F.col("text")) == "")), F.lit(0.0))
    parts = partials.select("recording_id", "chunk_idx", "text", silent.alias("duration"), size_of.alias("n_segments"))
    out = materialized(merge.merged_results(disposed, parts, windows, chunks))
    rows = out.select("recording_id", F.posexplode("segments").alias("seq", "s")).select("recording_id", "seq", "s.*")
    if remove_fillers:
        rows = rows.withColumn("text", T.without_fillers(F.col("text")))
        cleaned = rows.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text", *METRICS))), lambda s: s.dropFields("seq")).alias("segments"))
        joined = quality.combined_text(rows.where(T.strip(F.col("text")) != ""), "recording_id", ["seq"])
        out = out.drop("segments").join(cleaned, "recording_id", "left").withColumnRenamed("text", "_whole").join(joined, "recording_id", "left")
        out = out.withColumn("text", F.when(F.col("segments").isNull(), T.without_fillers(F.col("_whole"))).otherwise(F.coalesce("text", F.lit("")))).drop("_whole")
        out = out.withColumn("segments", F.coalesce("segments", F.array().cast(cleaned.schema["segments"].dataType)))
    found = quality.diagnostics(rows, "recording_id", "seq", cfg).drop("text", "segments", "forced_silence", "repeated")
    return out.join(found, "recording_id", "left").select("recording_id", "text", "duration", "segments", F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), F.coalesce("flagged", F.lit(0).cast("long")).alias("flagged_segments"), F.coalesce("max_no_speech", F.lit(0.0)).alias("max_no_speech"), F.coalesce("min_logprob", F.lit(0.0)).alias("min_logprob"), F.coalesce("max_compression", F.lit(0.0)).alias("max_compression"))
