"""Key-term accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions import text as T


def key_term_accuracy(transcript: Column, terms: Column) -> Column:
    """Share of non-blank terms that the transcript holds; duplicates count, no terms give 1."""
    said = T.squeezed(F.coalesce(transcript, F.lit("")))
    wanted = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), T.squeezed), lambda t: F.coalesce(t, F.lit("")) != "")
    hits = F.size(F.filter(wanted, lambda t: T.term_hit(said, t)))
    return F.when(F.size(wanted) > 0, hits / F.size(wanted)).otherwise(F.lit(1.0))


def evaluated(samples: DataFrame, transcripts: DataFrame) -> DataFrame:
    """id, accuracy of every sample. samples: id, key_terms; transcripts: id, transcript."""
    return samples.join(transcripts, "id").select("id", key_term_accuracy(F.col("transcript"), F.col("key_terms")).alias("accuracy"))


def average(results: DataFrame) -> DataFrame:
    """A10: samples and mean accuracy; no row without samples."""
    return results.agg(F.count("*").alias("samples"), F.avg("accuracy").alias("avg_kta")).where("samples > 0")
