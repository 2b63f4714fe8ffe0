"""Packing documents into fixed windows: best-fit decreasing.

A document is its token ids with an end id. What is longer than a window is cut
into full windows first, which are sequences as they are; the rest of each document, at most one piece, is packed.
Rests are dealt to bins by a hash of their row's number, so that rows without ids and equal rows spread as all others; each
bin holds about PIECES_PER_BIN of them whatever the size of the corpus, so a bin is a bounded
group, and a bin wastes about one open window. Within a bin pieces go longest
first into the open window with the least room that still holds them; a segment
tree over remaining capacities finds it.

Only pieces (ids, lengths, a checksum) are written and shuffled; texts and token ids are not.

Defined results: a null or empty text is its end id alone; equal rows give equal
pieces apart from their place; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import bytetext, storage, tokens

WINDOW = 4096
PIECES_PER_BIN = 2048
#: Sequence ids of full windows begin here; those of packed ones are below.
FULL = 1 << 62
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


class CapacityTree:
    """Counts of open windows by remaining capacity, as a segment tree over 0..capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open: list[list[int]] = [[] for _ in range(self.size)]
        self.count = [0] * (2 * self.size)

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least `need`, removed from the tree: (room, window)."""
        node = need + self.size
        if not self.count[node]:
            while True:  # climb to the nearest ancestor with something to the right
                if node == 1:
                    return None
                if not node & 1 and self.count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        window = self.open[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; lengths are 1..capacity, taken longest first."""
    tree, windows = CapacityTree(capacity), 0
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[i])
        if found is None:
            found, windows = (capacity, windows), windows + 1
        room, window = found
        where[i], offset[i] = window, capacity - room
        if room > lengths[i]:
            tree.add(room - lengths[i], window)
    return where, offset


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer_path: str | None = None) -> DataFrame:
    """Cut every document into full windows and a rest."""
    path = tokenizer_path or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.tokenizer(path)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            nulls = np.asarray(batch.column("doc_id").is_null())
            for row, end, data, offsets in bytetext.slices(batch.column("text"), tokens.SLICE_BYTES):
                ids, before = coder.encode(data, offsets)
                n = np.diff(before)
                parts = -(-n // window)
                of = np.repeat(np.arange(end - row), parts)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(n[of] - start, window)
                raw = memoryview(ids.astype("<u4").tobytes())
                first = before[of] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                ids_of = pa.array(doc_ids[row:end][of], pa.int64(), mask=nulls[row:end][of], from_pandas=True)
                yield pa.record_batch([ids_of, start, length, pa.array(crc, pa.int64()), n[of]], schema=_SCHEMA)

    storage.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(cut: DataFrame, window: int = WINDOW, pieces_per_bin: int = PIECES_PER_BIN) -> DataFrame:
    """Give each piece a sequence and an offset there. cut: a written table of pieces()."""
    numbered = cut.withColumn("_row", F.monotonically_increasing_id())
    full, rest = numbered.where(F.col("length") == window), numbered.where(F.col("length") < window)
    bins = max(1, -(-rest.count() // pieces_per_bin))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        base = int(pdf["bin"].iloc[0]) << 32
        return pdf.drop(columns="bin").assign(sequence_id=np.asarray(where, np.int64) + base, offset=offset)

    packed = rest.withColumn("bin", F.pmod(F.xxhash64("_row"), F.lit(bins))).drop("_row").groupBy("bin").applyInPandas(fill, PACKED)
    return packed.unionByName(full.withColumn("sequence_id", F.col("_row") + F.lit(FULL)).withColumn("offset", F.lit(0).cast("long")).drop("_row"))


def pack_documents(docs: DataFrame, window: int = WINDOW, tokenizer_path: str | None = None, pieces_per_bin: int = PIECES_PER_BIN) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(storage.staged(pieces(docs, window, tokenizer_path), "pack-pieces"), window, pieces_per_bin)
