"""What goes to a Python worker at once is bounded by bytes, not by rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from talkweave.operators import knowledge
from talkweave.sources import files

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", ["units", "simhash", "blake2b", "minhash", "loaded", "html"])
def test_batches_are_bounded(spark, name):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    made = {
        "units": lambda: knowledge.units(docs, "doc_id", "text"),
        "simhash": lambda: knowledge.simhash(docs, "doc_id", "text", "md5"),
        "blake2b": lambda: knowledge.simhash(docs, "doc_id", "text"),
        "minhash": lambda: knowledge.minhash(docs, "doc_id", "text"),
        "loaded": lambda: files.loaded(docs.select(F.lit("/a.txt").alias("path"), F.lit("txt").alias("suffix"), F.col("text").cast("binary").alias("content"))),
        "html": lambda: docs.select(files.html_to_text(F.col("text"))),
    }[name]
    spark.conf.unset(LIMIT)
    assert made().count() == 1
    assert int(spark.conf.get(LIMIT).rstrip("b")) <= 4 << 20


def test_slices_of_long_lists():
    lists = pd.Series([list(range(n)) for n in (40_000, 40_000, 3, 70_000, 1, 1)])
    parts = list(knowledge._slices(lists))
    assert [len(x) for p in parts for x in p] == [len(x) for x in lists] and max(sum(map(len, p)) for p in parts) < 2 * knowledge.VALUES_AT_ONCE and len(parts) > 2
    assert list(knowledge._slices(lists.iloc[:0])) == []
