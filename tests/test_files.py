"""Files of the knowledge base."""

from pyspark.sql import functions as F

from talkweave.sources import files


def read(spark, pages, **how):
    df = spark.createDataFrame(list(enumerate(pages)), "i long, html string")
    return [r.text for r in df.select("i", files.html_to_text(F.col("html"), **how).alias("text")).orderBy("i").collect()]


def test_references_without_semicolon(spark):
    pages = ["<title>a&amp;&amp;&amp</title><p>b &lt c &lt; d", "&notit; &#65 &#66; x&y &amp;amp", "<script>a && b &amp</script>", None]
    assert read(spark, pages, unclosed=False) == ["a&&&amp b &lt c < d", "&notit; &#65 B x&y &amp", "a && b &amp", ""]
    assert read(spark, pages[:1]) == ["a&&& b < c < d"]
