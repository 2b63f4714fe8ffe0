"""Video descriptions from a paged REST service, as a Python data source.

The fetcher is a function (endpoint, parameters) -> dict, so that tests run without a network.
Ids are listed on the driver page by page; batches of ids are partitions, fetched in parallel.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from talkweave import schemas
from talkweave.session import materialized

BATCH, PAUSE = 50, 0.1
Fetch = Callable[[str, dict], dict]


def http_fetch(base: str, key: str, pause: float = PAUSE) -> Fetch:
    def fetch(endpoint: str, params: dict) -> dict:
        time.sleep(pause)
        with urllib.request.urlopen(f"{base}/{endpoint}?{urllib.parse.urlencode({**params, 'key': key})}", timeout=30) as r:
            return json.load(r)

    return fetch


def channel_of(fetch: Fetch, handle: str) -> str:
    """A handle's channel id."""
    items = fetch("channels", {"part": "id", "forHandle": handle.lstrip("@")}).get("items") or []
    if not items:
        raise LookupError(f"no channel for {handle}")
    return items[0]["id"]


def uploads_of(fetch: Fetch, channel: str) -> str:
    """The playlist of a channel's uploads."""
    items = fetch("channels", {"part": "contentDetails", "id": channel}).get("items") or []
    if not items:
        raise LookupError(f"no channel {channel}")
    return items[0]["contentDetails"]["relatedPlaylists"]["uploads"]


def page_of(fetch: Fetch, playlist: str, token: str | None) -> tuple[list[str], str | None]:
    """Ids of a page of a playlist, and the token of the next one."""
    page = fetch("playlistItems", {"part": "contentDetails", "playlistId": playlist, "maxResults": BATCH, **({"pageToken": token} if token else {})})
    return [x["contentDetails"]["videoId"] for x in page.get("items", [])], page.get("nextPageToken")


def video_ids(fetch: Fetch, channel: str) -> Iterator[str]:
    playlist, token = uploads_of(fetch, channel), None
    while True:
        ids, token = page_of(fetch, playlist, token)
        yield from ids
        if not token:
            return


def batches(ids: list[str], size: int = BATCH) -> list[list[str]]:
    """S6 on the driver: fixed-size batches, the last one partial."""
    return [ids[i : i + size] for i in range(0, len(ids), size)]


def _described(fetch: Fetch, ids: list[str]) -> Iterator[tuple]:
    for item in fetch("videos", {"part": "snippet", "id": ",".join(ids)}).get("items", []):
        s = item.get("snippet", {})
        yield item["id"], s.get("title"), s.get("description"), s.get("publishedAt")


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, channel: str) -> None:
        self.fetch, self.channel = fetch, channel

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(b) for b in batches(list(video_ids(self.fetch, self.channel)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _described(self.fetch, partition.value)


def descriptions(spark: SparkSession, fetch: Fetch, handle: str | None = None, channel: str | None = None) -> DataFrame:
    """video_id, title, description, published_at of a channel's uploads."""
    if not (handle or channel):
        raise ValueError("a handle or a channel is needed")
    found = channel or channel_of(fetch, handle)

    class Videos(DataSource):
        @classmethod
        def name(cls) -> str:
            return "talkweave_videos"

        def schema(self) -> str:
            return schemas.VIDEO_DESCRIPTIONS

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, found)

    spark.dataSource.register(Videos)
    return spark.read.format("talkweave_videos").load()


class _Pages(SimpleDataSourceStreamReader):
    """Ids of a playlist, a page a batch. An offset names the page to come by its token, so a restarted query asks for exactly that one."""

    def __init__(self, fetch: Fetch, channel: str) -> None:
        self.fetch, self.channel = fetch, channel

    def initialOffset(self) -> dict:
        return {"page": 0, "token": "", "playlist": uploads_of(self.fetch, self.channel), "end": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["end"]:
            return iter(()), start
        ids, token = page_of(self.fetch, start["playlist"], start["token"] or None)
        rows = [(v, start["page"], k) for k, v in enumerate(ids)]
        return iter(rows), start | {"page": start["page"] + 1, "token": token or "", "end": not token}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["page"] < end["page"]:
            rows, start = self.read(start)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


def id_stream(spark: SparkSession, fetch: Fetch, handle: str | None = None, channel: str | None = None) -> DataFrame:
    """S5 as a stream: video_id, page, place of a channel's uploads. A query that is stopped anywhere in the playlist goes on from its checkpoint, with no id lost or repeated."""
    if not (handle or channel):
        raise ValueError("a handle or a channel is needed")
    found = channel or channel_of(fetch, handle)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "talkweave_video_pages"

        def schema(self) -> str:
            return "video_id string, page int, place int"

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Pages(fetch, found)

    spark.dataSource.register(Pages)
    return spark.readStream.format("talkweave_video_pages").load()


def described(ids: DataFrame, fetch: Fetch) -> DataFrame:
    """VIDEO_DESCRIPTIONS of a table or stream of video_id, asked for in batches where the rows are."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for asked in batches(part.column("video_id").to_pylist()):
                rows = list(_described(fetch, asked))
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 4, names=["video_id", "title", "description", "published_at"])

    return ids.select("video_id").mapInArrow(run, schemas.VIDEO_DESCRIPTIONS)


def batched(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """S6 for tables: batch number and the batch's values, in order. Numbering is per key.

    Rows are sorted by ranges of (key, order), so a key of any size spreads over tasks; each range counts its rows per
    key, and what the ranges before it hold is added to the number inside it. Ranges are written once, so both see the same ones.
    """
    rows = materialized(df.select(key, order).repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), before.alias("_before"))
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)) - 1)
    placed = inside.join(starts, inside[key].eqNullSafe(starts["_key"]) & (inside["_range"] == starts["_of"]))
    number = F.floor((F.col("_before") + F.col("_at")) / size).cast("long")
    return placed.withColumn("batch", number).groupBy(key, "batch").agg(F.array_sort(F.collect_list(F.col(order))).alias("items"))


def save_json(df: DataFrame, path: str, ascii_only: bool = False) -> None:
    """JSON, one object a line."""
    writer = df.write.mode("overwrite")
    (writer.option("writeNonAsciiCharacterAsCodePoint", True) if ascii_only else writer).json(path)
