"""File sources and sinks: knowledge-base files, evaluation sets, decoder payloads, JSON results."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave import schemas
from talkweave.functions import text as T
from talkweave.session import small_batches

SUFFIXES = ("txt", "md", "markdown", "pdf", "html", "htm")


#: Stands for an ampersand that begins no reference while a page is parsed; decoded texts hold no lone surrogates.
_AMPERSAND = "\udc26"


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        data = data.replace(_AMPERSAND, "&")
        if data.strip():
            self.parts.append(data.strip())


def _closed_only(html: str) -> str:
    """Ampersands of all but whole references, name and semicolon, set aside."""
    return re.sub(r"&(?!#\d+;|#[xX][0-9a-fA-F]+;)(\w*;?)", lambda m: m[0] if m[1] in html5 and m[1].endswith(";") else _AMPERSAND + m[1], html)


def html_text(html: str | None, unclosed: bool = True) -> str:
    """All text nodes, stripped, joined by blanks. unclosed: names of references count without their semicolon (`&amp`), as in browsers; else they are text."""
    p = _Visible()
    p.feed((html or "") if unclosed else _closed_only(html or ""))
    p.close()
    return " ".join(p.parts)


def html_to_text(html: Column, unclosed: bool = True) -> Column:
    """html_text on batches."""
    if (spark := SparkSession.getActiveSession()) is not None:
        small_batches(spark)

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda page: html_text(page, unclosed))

    return run(html)


def discovered(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """S3: path, suffix, content of supported files under root (or matching a glob), whatever the case of their suffix. A missing root has none."""
    from pyspark.errors import AnalysisException

    reader = spark.read.format("binaryFile")
    try:
        found = reader.load(f"{root}/{pattern}") if pattern else reader.option("recursiveFileLookup", True).load(root)
    except AnalysisException:
        found = spark.createDataFrame([], "path string, content binary")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    return found.select("path", suffix.alias("suffix"), "content").where(F.col("suffix").isin(*SUFFIXES))


def loaded(files: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """Path, text, error. Plain text drops bytes that aren't UTF-8; PDF needs an extractor (pages joined by line breaks); other kinds are errors, not exceptions."""

    @F.pandas_udf("string")
    def plain(content: pd.Series) -> pd.Series:
        return content.map(lambda b: (b or b"").decode("utf-8", "ignore"))

    @F.pandas_udf("struct<text: string, error: string>")
    def from_pdf(content: pd.Series) -> pd.DataFrame:
        def one(b: bytes) -> tuple[str | None, str | None]:
            try:
                return pdf(b), None
            except Exception as e:  # a damaged file is reported, the others go on
                return None, str(e)

        return pd.DataFrame([one(b) for b in content], columns=["text", "error"])

    small_batches(files.sparkSession)
    # a Python function runs on all rows whatever CASE says, so kinds are split first
    texts = files.where(F.col("suffix").isin("txt", "md", "markdown")).select("path", plain("content").alias("text"), F.lit(None).cast("string").alias("error"))
    pages = files.where(F.col("suffix").isin("html", "htm")).select("path", html_to_text(plain(F.col("content"))).alias("text"), F.lit(None).cast("string").alias("error"))
    pdfs = files.where("suffix = 'pdf'")
    if pdf is None:
        pdfs = pdfs.select("path", F.lit(None).cast("string").alias("text"), F.lit("no PDF extractor").alias("error"))
    else:
        pdfs = pdfs.select("path", from_pdf("content").alias("x")).select("path", "x.text", "x.error")
    other = files.where(~F.col("suffix").isin(*SUFFIXES)).select("path", F.lit(None).cast("string").alias("text"), F.lit("unsupported file type").alias("error"))
    return texts.unionByName(pages).unionByName(pdfs).unionByName(other)


def key_term_samples(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Id, audio_path (relative ones against base), key_terms (null: none). Blank lines are skipped."""
    rows = spark.read.schema(schemas.KEY_TERMS).json(path).where("id is not null or audio_path is not null")
    where = F.when(F.col("audio_path").startswith("/") | (F.lit(base) == ""), F.col("audio_path")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "audio_path"))
    return rows.select("id", where.alias("audio_path"), F.coalesce("key_terms", F.array().cast("array<string>")).alias("key_terms"))


def save_samples(samples: DataFrame, path: str) -> None:
    """Samples as JSON lines; null fields are left out."""
    samples.select("id", "audio_path", "key_terms").write.mode("overwrite").json(path)


def results(payloads: DataFrame, source: str = "source", payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Decoder payloads (JSON) as typed rows, with the columns named by `keep`; unknown keys are dropped."""
    return payloads.withColumn("_p", F.from_json(payload, schemas.PAYLOAD)).select(*keep, T.base_name(F.col(source)).alias("filename"), F.coalesce("_p.text", F.lit("")).alias("text"), "_p.language", "_p.duration", F.coalesce("_p.segments", F.array().cast(f"array<{schemas.SEGMENT}>")).alias("segments"))


def response(columns: list[str] | None = None) -> Column:
    """A row as a JSON response, a list of one result."""
    return F.concat(F.lit("["), F.to_json(F.struct(*(columns or ["*"]))), F.lit("]"))
