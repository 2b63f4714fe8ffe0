"""Repetition, silence and confidence diagnostics of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.config import QualityConfig
from talkweave.functions import text as T

CFG = QualityConfig()


def segment_reasons(cfg: QualityConfig = CFG) -> Column:
    """reasons to flag a segment, in a fixed order; null metrics flag nothing."""
    spoken = T.strip(F.coalesce(F.col("text"), F.lit(""))) != ""
    return F.array_compact(
        F.array(
            F.when(F.col("avg_logprob") <= cfg.flag_logprob, "low_logprob"),
            F.when(F.col("compression_ratio") >= cfg.flag_compression, "high_compression_ratio"),
            F.when((F.col("no_speech_prob") >= cfg.flag_no_speech) & spoken, "high_no_speech"),
        )
    )


def repeated_segments(segments: DataFrame, key: str, order: str, cfg: QualityConfig = CFG) -> DataFrame:
    """key, repeated: a run of equal neighbours, or few distinct texts among many; blanks don't count."""
    w = Window.partitionBy(key)
    said = segments.withColumn("_t", T.strip(F.coalesce(F.col("text"), F.lit("")))).where("_t <> ''")
    said = said.withColumn("_island", F.row_number().over(w.orderBy(order)) - F.row_number().over(Window.partitionBy(key, "_t").orderBy(order)))
    runs = said.groupBy(key, "_t", "_island").agg(F.count("*").alias("run")).groupBy(key).agg(F.max("run").alias("run"), F.sum("run").alias("n"), F.count_distinct("_t").alias("kinds"))
    hit = (F.col("n") >= cfg.min_run) & ((F.col("run") >= cfg.min_run) | ((F.col("n") >= cfg.many_segments) & (F.col("kinds") / F.col("n") < cfg.distinct_share)))
    return segments.select(key).distinct().join(runs.select(key, hit.alias("repeated")), key, "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))


def combined_text(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Key, text: texts in order, joined without separator, stripped."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col("text"), F.lit("")).alias("_t"))))
    return segments.groupBy(key).agg(T.strip(F.array_join(F.transform(rows, lambda x: x["_t"]), "")).alias("text"))


def metrics(segments: DataFrame, key: str, cfg: QualityConfig = CFG) -> DataFrame:
    """A4: one aggregate per transcript; F.avg and F.max skip null metrics."""
    reasons = F.size(segment_reasons(cfg)) > 0
    return segments.groupBy(key).agg(
        F.count("*").alias("segments"),
        F.coalesce(F.max("no_speech_prob"), F.lit(0.0)).alias("max_no_speech"),
        F.coalesce(F.min("avg_logprob"), F.lit(0.0)).alias("min_logprob"),
        F.coalesce(F.max("compression_ratio"), F.lit(0.0)).alias("max_compression"),
        F.count_if(reasons).alias("flagged"),
        F.max("no_speech_prob").alias("_max_ns"),
        F.avg("no_speech_prob").alias("_avg_ns"),
        F.min("avg_logprob").alias("_min_lp"),
        F.max("compression_ratio").alias("_max_cr"),
    )


def forced_silence(text: Column, cfg: QualityConfig = CFG) -> Column:
    """F5 over metrics(): decisions in a fixed order; without no-speech scores only the phrase rule can fire."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    both = lambda cr, lp: sure(F.col("_max_cr") >= cr) & sure(F.col("_min_lp") <= lp)
    phrase = T.has_phrase(text, cfg.phrases) & (sure(F.col("_max_ns") >= cfg.phrase_no_speech) | both(cfg.phrase_compression, cfg.phrase_logprob))
    return (
        F.when((F.coalesce(T.strip(text), F.lit("")) == "") | (F.col("segments") == 0), False)
        .when(phrase, True)
        .when(F.col("_max_ns").isNull(), False)
        .when(sure(F.col("_max_ns") >= cfg.no_speech_max) | sure(F.col("_avg_ns") >= cfg.no_speech_mean), True)
        .otherwise(both(cfg.silence_compression, cfg.silence_logprob))
    )


def flags(text: Column, repeated: Column, flagged: Column, cfg: QualityConfig = CFG) -> Column:
    """A5: transcript flags in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(T.repeated_tail(text), "repeat_tail"),
            F.when(repeated, "repeat_segments"),
            F.when(T.has_phrase(text, cfg.phrases), "hallucination_phrase_match"),
            F.when(flagged > 0, "low_confidence_segments"),
        )
    )


def diagnostics(segments: DataFrame, key: str, order: str, cfg: QualityConfig = CFG) -> DataFrame:
    """Key, text, flags, the metrics, and forced_silence of every transcript, all on one exchange by key."""
    whole = combined_text(segments, key, [order]).join(metrics(segments, key, cfg), key).join(repeated_segments(segments, key, order, cfg), key)
    return whole.withColumn("flags", flags(F.col("text"), F.col("repeated"), F.col("flagged"), cfg)).withColumn("forced_silence", forced_silence(F.col("text"), cfg)).drop("_max_ns", "_avg_ns", "_min_lp", "_max_cr")


def flagged_segments(segments: DataFrame, cfg: QualityConfig = CFG) -> DataFrame:
    """Segments with reasons."""
    return segments.withColumn("reasons", segment_reasons(cfg)).where(F.size("reasons") > 0)


def without_fillers(segments: DataFrame, key: str, order: str) -> DataFrame:
    """R2: texts without fillers, and per transcript what is left, non-blank texts only."""
    return combined_text(segments.withColumn("text", T.without_fillers(F.col("text"))), key, [order])


def retry_decision(attempts: DataFrame, key: list[str]) -> DataFrame:
    """What becomes of a decode: keep, silence or retry, and the text that is kept.

    attempts: key, attempt_no, condition (null: the default, true), text, repeated (F9), forced (F5). Attempt 2 is the
    decode without conditioning, present only where attempt 1 asked for it.
    """
    looping = T.repeated_tail(F.col("text")) | F.col("repeated")
    facts = F.struct(F.col("text"), looping.alias("looping"), T.garbled(F.col("text")).alias("garbled"), F.coalesce("condition", F.lit(True)).alias("condition"), F.col("forced"))
    both = attempts.groupBy(*key).agg(F.max(F.when(F.col("attempt_no") == 1, facts)).alias("one"), F.max(F.when(F.col("attempt_no") == 2, facts)).alias("two"))
    settle = lambda x: F.when(F.col(f"{x}.forced"), "silence").otherwise("keep")
    decision = (
        F.when(F.col("one.looping") & F.col("one.garbled"), "silence")
        .when(F.col("one.looping") & F.col("one.condition") & F.col("two").isNull(), "retry")
        .when(F.col("one.looping") & F.col("one.condition") & F.col("two.looping"), "silence")
        .when(F.col("one.looping") & F.col("one.condition"), settle("two"))
        .otherwise(settle("one"))
    )
    second = F.col("one.looping") & F.col("one.condition") & ~F.col("one.garbled")
    text = F.when(decision == "keep", F.when(second, F.col("two.text")).otherwise(F.col("one.text"))).when(decision == "silence", F.lit(""))
    return both.select(*key, decision.alias("decision"), text.alias("text"))
