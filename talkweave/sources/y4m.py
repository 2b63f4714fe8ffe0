"""Uncompressed video (YUV4MPEG2) as a data source: frames by range, without reading what isn't asked for.

A file is a header line (width, height, frame rate, colour format) and frames of equal size, each behind a line of its own, so the place
of any frame follows from its number. Files are split into ranges of about PART_BYTES of frames; bounds on idx and names of
videos in a filter reach the reader, which opens only files and ranges that can hold such frames. Files up to PART_BYTES are read
many to a task (FILES_AT_ONCE), which also reads their headers; the driver only lists them.

    frames(spark, folder).where("idx between 100 and 200")

Formats: mono, 444 and 420 (its variants of chroma siting alike), eight bits a sample; pixels come as RGB. A damaged file (no or
an unknown header, a rest that isn't a whole frame) gives one row with its error instead of frames, for S14's quarantine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "video_id string, idx int, ts double, image binary, h int, w int, error string"
MAGIC, MARK = b"YUV4MPEG2", b"FRAME\n"
PART_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
FILES_AT_ONCE = 512


@dataclass
class Header:
    size: int
    w: int
    h: int
    fps: float
    color: str

    @property
    def frame_bytes(self) -> int:
        """Bytes of the samples of a frame."""
        n = self.w * self.h
        return n if self.color == "mono" else 3 * n if self.color == "444" else n + 2 * ((self.w + 1) // 2) * ((self.h + 1) // 2)


def parsed_header(begin: bytes) -> Header:
    """The header at the beginning of a file; ValueError if there is none that can be read."""
    line, found, _ = begin.partition(b"\n")
    fields = {f[:1].decode("ascii", "replace"): f[1:].decode("ascii", "replace") for f in line.split(b" ")[1:] if f}
    rate = re.fullmatch(r"(\d+):(\d+)", fields.get("F", "30:1"))
    color = re.match(r"mono$|444$|420", fields.get("C", "420"))
    if not found or not line.startswith(MAGIC) or not rate or not color or not fields.get("W", "").isdigit() or not fields.get("H", "").isdigit() or not int(fields["W"]) or not int(fields["H"]):
        raise ValueError("no header that can be read")
    return Header(len(line) + 1, int(fields["W"]), int(fields["H"]), int(rate[1]) / max(int(rate[2]), 1) or 30.0, color[0])


def header_of(w: int, h: int, fps: int = 30, color: str = "mono") -> bytes:
    return b"%s W%d H%d F%d:1 Ip A1:1 C%s\n" % (MAGIC, w, h, fps, color.encode())


def rgb(samples: bytes, header: Header) -> bytes:
    """Pixels of a frame: grey as it is, else by the usual matrix for studio levels."""
    w, h, data = header.w, header.h, np.frombuffer(samples, np.uint8)
    if header.color == "mono":
        return np.repeat(data, 3).tobytes()
    luma = data[: w * h].reshape(h, w).astype(np.float64) - 16
    if header.color == "444":
        u, v = data[w * h :].reshape(2, h, w).astype(np.float64) - 128
    else:
        u, v = data[w * h :].reshape(2, (h + 1) // 2, (w + 1) // 2).repeat(2, 1).repeat(2, 2)[:, :h, :w].astype(np.float64) - 128
    y = luma * 255 / 219
    pixels = np.stack([y + 1.596027 * v, y - 0.391762 * u - 0.812968 * v, y + 2.017232 * u], axis=-1)
    return np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


@dataclass
class Frames(InputPartition):
    """Frames first to last - 1 of a file, as far as it has them, or what is wrong with it; then those of other files."""

    path: str
    video: str
    first: int
    last: int
    error: str | None = None
    more: list[Frames] = field(default_factory=list)


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.low, self.high = 0, 1 << 31
        self.videos: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on idx and names of videos decide what is opened; Spark evaluates everything else, and frames of damaged files have no idx."""
        for f in filters:
            match f:
                case EqualTo(("idx",), n):
                    self.low, self.high = max(self.low, n), min(self.high, n + 1)
                case GreaterThan(("idx",), n):
                    self.low = max(self.low, n + 1)
                case GreaterThanOrEqual(("idx",), n):
                    self.low = max(self.low, n)
                case LessThan(("idx",), n):
                    self.high = min(self.high, n)
                case LessThanOrEqual(("idx",), n):
                    self.high = min(self.high, n + 1)
                case EqualTo(("video_id",), name):
                    self._only({name})
                case In(("video_id",), names):
                    self._only(set(names))
            yield f

    def _only(self, names: set[str]) -> None:
        self.videos = names if self.videos is None else self.videos & names

    def partitions(self) -> list[Frames]:
        where, path = fs.FileSystem.from_uri(self.path)
        found = where.get_file_info(path)
        files = [found] if found.is_file else [f for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.extension.lower() == "y4m"]
        pieces = []
        for f in sorted(files, key=lambda f: f.path):
            video = f.base_name.rpartition(".")[0] or f.base_name
            if self.videos is not None and video not in self.videos:
                continue
            if f.size <= PART_BYTES:
                pieces.append((Frames(f.path, video, max(self.low, 0), self.high), f.size))
                continue
            with where.open_input_file(f.path) as opened:
                try:
                    header, frames = self._shape(opened, f.size)
                except ValueError as e:
                    pieces.append((Frames(f.path, video, 0, 0, str(e)), 0))
                    continue
            step = len(MARK) + header.frame_bytes
            each = max(1, PART_BYTES // step)
            low, high = max(self.low, 0), min(self.high, frames)
            pieces += [(Frames(f.path, video, max(a, self.low), min(a + each, high)), (min(a + each, high) - a) * step) for a in range(low - low % each, high, each)]
        out: list[Frames] = []
        held = 0
        for piece, size in pieces:
            if out and held + size <= PART_BYTES and len(out[-1].more) + 1 < FILES_AT_ONCE and (out[-1].more or out)[-1].path != piece.path:
                out[-1].more.append(piece)
                held += size
            else:
                out.append(piece)
                held = size
        return out

    @staticmethod
    def _shape(opened, size: int) -> tuple[Header, int]:
        """Header and number of frames of an open file; ValueError if it is damaged."""
        header = parsed_header(opened.read(4096))
        frames, rest = divmod(size - header.size, len(MARK) + header.frame_bytes)
        if rest:
            raise ValueError("not a whole number of frames")
        return header, frames

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for piece in (part, *part.more):
            for row in self._rows(where, piece):
                rows.append(row)
                held += len(row[3] or b"")
                if held > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _rows(where: fs.FileSystem, piece: Frames) -> Iterator[tuple]:
        wrong = lambda error: (piece.video, None, None, None, None, None, error)
        if piece.error is not None:
            yield wrong(piece.error)
            return
        with where.open_input_file(piece.path) as opened:
            try:
                header, frames = Reader._shape(opened, opened.size())
            except ValueError as e:
                yield wrong(str(e))
                return
            step = len(MARK) + header.frame_bytes
            opened.seek(header.size + min(piece.first, frames) * step)
            for idx in range(piece.first, min(piece.last, frames)):
                raw = opened.read(step)
                if raw[: len(MARK)] != MARK:
                    yield wrong(f"no frame where {idx} should be")
                    return
                yield piece.video, idx, idx / header.fps, rgb(raw[len(MARK) :], header), header.h, header.w, None

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int32(), pa.float64(), pa.binary(), pa.int32(), pa.int32(), pa.string())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class Y4M(DataSource):
    """The frames of .y4m files below a path (a URI)."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]
        return Reader(path if "://" in path or path.startswith("file:") else f"file://{path}")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """SCHEMA of the files below a path. Lets the session hand filters to Python data sources, which Spark doesn't by itself."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Y4M)
    return spark.read.format(Y4M.name()).load(folder)


def write_grey(folder: str, video: str, pictures: Iterator[bytes], w: int, h: int, fps: int = 30) -> str:
    """A file of grey pictures (a byte per pixel) under a URI; its path."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/{video}.y4m") as out:
        out.write(header_of(w, h, fps))
        for picture in pictures:
            out.write(MARK)
            out.write(picture)
    return f"{path}/{video}.y4m"
