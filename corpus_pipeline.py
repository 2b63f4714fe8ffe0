"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read back as the next stage's docs. All but the last return the columns of
documents; each one's decisions take effect on the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import mixing, neardup, packing, quality, rows, storage, suffixdedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified rule reject go."""
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id.

    Rows that have no doc_id, or share it with other texts, are documents of their own; rows equal in doc_id and text are one.
    """
    row, keeps = rows.fresh(docs.columns, "_row", "_kept")
    named, unique = rows.with_row_ids(docs, row)
    found = neardup.near_duplicates(named.select(F.col(row).alias("doc_id"), "text"))
    kept = found.where("kept").select(F.col("doc_id").alias(keeps)).distinct()
    left = named.join(kept, named[row] == kept[keeps], "left_semi")
    return (left if unique else left.dropDuplicates([row])).select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut from texts; documents of which no word is left go. n_chars follows the text."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = dict(zip(carry, rows.fresh(docs.columns, *("_carried" for _ in carry)), strict=True))
    left = suffixdedup.without_repeats(docs.withColumnsRenamed(own), carry=tuple(own.values()))
    left = left.where("n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    if "n_chars" in own:
        left = left.withColumn(own["n_chars"], F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as the mix takes it (0 to 2 times); documents without words stay out."""
    row, taken, copies, copy = rows.fresh(docs.columns, "_row", "_taken", "_copies", "_copy")
    named, _ = rows.with_row_ids(docs, row)
    sized = mixing.mix_sources(named.select(F.col(row).alias("doc_id"), "source", "text"))
    chosen = sized.groupBy(F.col("doc_id").alias(taken)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    mixed = named.join(chosen, named[row] == chosen[taken])
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("pack", pack),
]

#: Suffix sorting, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with storage.scratch(spark):
            kept = storage.staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
