"""Alignment of utterances with screen contexts and speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions import scalars
from talkweave.functions import text as T

MAX_UTTERANCES, MAX_TEXT = 100, 80


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, value: str, into: str) -> DataFrame:
    """Each left row with the `value` of the right row of its key nearest to it in `at`; of equally near ones the least value; null without any.

    One pass over the sorted union of both sides: the last right row up to here and the first from
    here on are the only candidates, so no pair is ever made and a key's rows stream through the window.
    Of right rows at one place only the least value counts.
    """
    points = right.groupBy(key, at).agg(F.min(value).alias("_v"))
    names = [c for c in left.columns if c not in (key, at)]
    both = left.select(key, at, F.struct(*names).alias("_row"), F.lit(None).cast(points.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    both = both.unionByName(points.select(key, at, F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), "_v", F.lit(0).alias("_side")))
    point = F.when(F.col("_side") == 0, F.struct(F.col(at).alias("t"), F.col("_v").alias("v")))
    w = Window.partitionBy(key)
    before = F.last(point, ignorenulls=True).over(w.orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(point, ignorenulls=True).over(w.orderBy(F.col(at).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_b", before).withColumn("_a", after).where("_side = 1")
    far = lambda c: F.abs(F.col(c)["t"] - F.col(at))
    pick = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull(), F.col("_b.v")).when(far("_b") < far("_a"), F.col("_b.v")).when(far("_a") < far("_b"), F.col("_a.v")).otherwise(F.least("_a.v", "_b.v"))
    return both.select(key, at, *(F.col(f"_row.{n}").alias(n) for n in names), pick.alias(into))


def utterances(transcript: DataFrame, contexts: DataFrame, speakers: DataFrame | None = None, key: str = "recording_id") -> DataFrame:
    """Segments (a speaker transcript where a recording has one, else the plain one) with the index of the nearest screen.

    transcript, speakers: key, seq, start, end, text (speakers: and speaker); contexts: key, frame_index, timestamp.
    """
    plain = transcript.select(key, "seq", "start", "end", "text", F.lit(None).cast("string").alias("speaker"))
    if speakers is not None:
        spoken = speakers.select(key, "seq", "start", "end", "text", "speaker")
        plain = plain.join(spoken.select(key).distinct(), key, "left_anti").unionByName(spoken)
    middle = plain.withColumn("middle", (F.col("start") + F.col("end")) / 2)
    index = F.row_number().over(Window.partitionBy(key).orderBy("timestamp", "frame_index")) - 1
    numbered = contexts.withColumn("context_index", index) if "context_index" not in contexts.columns else contexts
    return nearest(middle, numbered.withColumnRenamed("timestamp", "middle"), key, "middle", "context_index", "image_context_index").drop("middle")


def mindmap(said: DataFrame, contexts: DataFrame, names: DataFrame, key: str = "recording_id") -> DataFrame:
    """Key, mindmap. said: utterances(); contexts: key, context_index, label; names: key, filename, speakers (array)."""
    line = lambda section, a, b, text: F.struct(F.lit(section).alias("section"), a.cast("long").alias("a"), F.lit(b).alias("b"), text.alias("line"))
    zero = F.lit(0)
    heads = names.select(key, F.explode(F.concat(
        F.array(line(0, zero, 0, F.lit("mindmap")), line(0, zero, 1, F.concat(F.lit("  "), "filename"))),
        F.when(F.size("speakers") > 0, F.concat(F.array(line(1, F.lit(-1), 0, F.lit("    Speakers"))), F.transform("speakers", lambda s, i: line(1, i, 0, F.concat(F.lit("      "), s))))).otherwise(F.array()),
    )).alias("x"))
    screens = contexts.select(key, line(2, F.col("context_index"), 0, F.concat(F.lit("      "), F.format_string("%02d", F.col("context_index").cast("int")), F.lit(": "), "label")).alias("x"))
    screens = screens.unionByName(contexts.select(key).distinct().select(key, line(2, F.lit(-1), 0, F.lit("    Screens")).alias("x")))
    first = said.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where(F.col("n") <= MAX_UTTERANCES)
    first = first.join(contexts.select(key, F.col("context_index").alias("image_context_index"), "label"), [key, "image_context_index"], "left")
    stamp = F.concat(F.lit("      ["), scalars.clock(F.col("start")), F.lit("-"), scalars.clock(F.col("end")), F.lit("] "))
    text = F.substring(F.regexp_replace(T.strip(F.coalesce("text", F.lit(""))), "\n", " "), 1, MAX_TEXT)
    by = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat("speaker", F.lit(": "))).otherwise("")
    spoken = first.select(key, line(3, F.col("n"), 0, F.concat(stamp, by, text)).alias("x"))
    shown = first.where("label is not null").select(key, line(3, F.col("n"), 1, F.concat(F.lit("        screen: "), "label")).alias("x"))
    title = said.select(key).distinct().select(key, line(3, F.lit(0), 0, F.lit("    Transcript")).alias("x"))
    lines = heads.unionByName(screens).unionByName(spoken).unionByName(shown).unionByName(title)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return lines.groupBy(key).agg(F.concat(ordered, F.lit("\n")).alias("mindmap"))
