"""Uploads of recordings and of window updates, as tables or as streams of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkweave.functions import text as T
from talkweave.streaming import committer

#: Fields of an upload that come with its PCM; all but the rate may be null.
FIELDS = "recording_id string, sample_rate int, model string, language string, task string, chunk_seconds double, overlap_seconds double, window_start_seconds double, window_end_seconds double, prompt_agenda string, prompt_participants string, prompt_products string, prompt_style string, prompt_terms string, prompt_dictionary string"
NAMED = FIELDS.partition(", ")[2]
COLUMNS = ("pcm", *(c.split()[0] for c in NAMED.split(", ")))
AUDIO = "path string, modificationTime timestamp, length long, content binary"
PROMPTS = ("agenda", "participants", "products", "terms", "dictionary")


def _audio(files: DataFrame) -> DataFrame:
    return files.select(T.stem(F.col("path")).alias("recording_id"), F.col("content").alias("pcm"))


def _fields(read: DataFrame) -> DataFrame:
    """Fields by the id they state, or by their file where that can't be read."""
    return read.withColumn("recording_id", F.coalesce("recording_id", T.stem(F.col("_metadata.file_path"))))


def recordings(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Uploads as recordings: FIELDS from <name>.json beside the bytes of <name>.pcm. As a stream, one row per PCM file as it arrives, named by its file and without fields."""
    if stream:
        files = _streamed(spark, "binaryFile", AUDIO, "*.pcm", folder)
        return files.select(T.stem(F.col("path")).alias("recording_id"), F.col("content").alias("pcm"), F.col("modificationTime").alias("arrived"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcm").load(folder)
    fields = _fields(spark.read.schema(FIELDS).option("pathGlobFilter", "*.json").option("multiLine", True).json(folder))
    return _audio(files).join(fields, "recording_id", "left")


def _streamed(spark: SparkSession, source: str, schema: str, glob: str, folder: str, **options) -> DataFrame:
    return spark.readStream.format(source).schema(schema).options(pathGlobFilter=glob, **options).load(folder)


def _plain(column: str, value):
    """A value of a pandas row as state and Arrow take it: integers beside nulls come as floats."""
    if isinstance(value, bytes):
        return value
    return None if pd.isna(value) else int(value) if column == "sample_rate" else getattr(value, "item", lambda: value)()


class Meeting(StatefulProcessor):
    """The halves of an upload: whichever comes first waits in state for the other. At most one half and one outcome per upload are kept, and for
    a bounded time: a half that waited too long is given out as an orphan, and that it was is remembered for a while."""

    def __init__(self, wait: float, remember: float) -> None:
        self.wait, self.remember = int(wait * 1000), int(remember * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.half = handle.getValueState("half", f"pcm binary, {NAMED}")
        self.outcome = handle.getValueState("outcome", "orphan string")

    def _timer(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        out, now = [], 0
        for row in pd.concat(list(rows)).to_dict("records"):
            now = max(now, int(row["seen"].timestamp() * 1000))
            audio = row["pcm"] is not None
            new = tuple(_plain(c, row[c]) for c in COLUMNS)
            held = tuple(self.half.get()) if self.half.exists() else None
            if held is not None and (held[0] is not None) != audio:
                both = (new[0], *held[1:]) if audio else (held[0], *new[1:])
                out.append((key[0], *both, None))
                self.half.clear()
                self.outcome.update(("",))
            elif held is None and self.outcome.exists() and self.outcome.get()[0]:
                out.append((key[0], *new, "late-audio" if audio else "late-fields"))
            elif held is None:
                self.half.update(new)
            else:
                out.append((key[0], *new, "repeated-audio" if audio else "repeated-fields"))
        self._timer(now + (self.wait if self.half.exists() else self.remember))
        yield pd.DataFrame(out, columns=["recording_id", *COLUMNS, "error_kind"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.half.exists():
            held = tuple(self.half.get())
            missing = "missing-audio" if held[0] is None else "missing-fields"
            out.append((key[0], *held, missing))
            self.half.clear()
            self.outcome.update((missing,))
            self._timer(expiredTimerInfo.getExpiryTimeInMs() + self.remember)
        else:
            self.outcome.clear()
        yield pd.DataFrame(out, columns=["recording_id", *COLUMNS, "error_kind"])

    def close(self) -> None:
        pass


def upload_stream(spark: SparkSession, folder: str, wait: float = 600.0, remember: float = 3600.0) -> DataFrame:
    """S2 as a stream: PCM files and their JSON fields, joined as both halves arrive, in whatever order. Needs the RocksDB state store.

    error_kind is null for whole uploads. A half whose other one isn't there `wait` seconds after it is given out with missing-fields or
    missing-audio; one that comes within `remember` seconds after that with late-fields or late-audio; one more of the same half, while the first
    still waits, with repeated-audio or repeated-fields. Time is that of arrival, and passes as files arrive. State is one
    half per upload that still waits and a word per upload that has ended, both for a bounded time.
    """
    audio = _audio(_streamed(spark, "binaryFile", AUDIO, "*.pcm", folder)).withColumn("pcm", F.coalesce("pcm", F.lit(b"")))
    fields = _fields(_streamed(spark, "json", FIELDS, "*.json", folder, multiLine=True))
    halves = audio.unionByName(fields, allowMissingColumns=True).withColumn("seen", F.current_timestamp()).withWatermark("seen", "0 seconds")
    return halves.groupBy("recording_id").transformWithStateInPandas(Meeting(wait, remember), f"recording_id string, pcm binary, {NAMED}, error_kind string", outputMode="append", timeMode="eventTime")


def whole(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole uploads, halves with error_kind) of upload_stream."""
    return uploads.where("error_kind is null").drop("error_kind"), uploads.where("error_kind is not null")


def requests(uploads: DataFrame, default_style: bool = True) -> DataFrame:
    """Uploads with the initial prompt of each."""
    parts = {name: F.col(f"prompt_{name}") for name in PROMPTS}
    return uploads.withColumn("initial_prompt", T.request_prompt(F.coalesce("language", F.lit("ja")), default_style, F.col("prompt_style"), **parts))


def updates(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of window updates from JSON files, as commit_stream takes them."""
    return spark.readStream.schema(committer.UPDATES).json(folder)
