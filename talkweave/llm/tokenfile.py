"""Token-id files: canonical length-limited Huffman codes in independent blocks.

File: MAGIC, header length (u32), header (zlib: JSON with the longest code and,
as bytes, the code length of every id), then blocks. Each document is one block:
its codes from a byte boundary on, with the bit length of every run of
CHECKPOINT ids, so that any run is decoded without those before it. The block
index (doc_id, ids, byte place, run bit lengths) follows the blocks and is found
by the fixed-size tail (index place u64, index length u64, MAGIC).

Codes come from the counts of ids over the whole corpus. Lengths are limited to
MAX_BITS by package-merge; codes are canonical, so lengths alone define them. The
decoder looks up MAX_BITS bits at once in a table and decodes all runs of a block
group in step.

Size: the number of files follows the data. A file takes about FILE_IDS ids, a document counting for DOC_IDS more, which bounds its index; small
corpora get smaller files, so that as many tasks as the session has shuffle partitions write them. A file is read in splits
of about SPLIT_IDS ids, each by a task of its own that reads the index and its range of blocks.

Order: documents are range-partitioned by doc_id (rows that share one or have none, by a hash of their bits, so that they
spread as well), each partition is one file, and a manifest names the files that count, so attempts of lost executors leave no
trace in what is read.

Defined results: a null or empty text is its end id alone; repeated rows are
written as often as they occur; a null doc_id comes first; an empty table gives
no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import bytetext, storage, tokens

MAGIC = b"TWHF0001"
MAX_BITS = 18
CHECKPOINT = 256
DECODE_IDS = 1 << 20
FILE_IDS, LEAST_IDS, DOC_IDS, SPLIT_IDS = 1 << 26, 1 << 20, 64, 1 << 22
MAX_READERS = 1 << 16
TAIL = "<QQ8s"  # index place, index length, MAGIC


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length of each id by package-merge: optimal among prefix codes of at most max_bits. 0 for unused ids."""
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([weight, packages])
        leaf = np.concatenate([np.ones(len(weight), bool), np.zeros(len(packages), bool)])
        by = np.argsort(merged, kind="stable")
        merged, leaf = merged[by], leaf[by]
        levels.append(leaf)
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    take, lengths = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), as the usual canonical order has it."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code = last = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = order[np.searchsorted(lengths[order], bits) : np.searchsorted(lengths[order], bits, side="right")]
        code <<= bits - last
        last = bits
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every window of max_bits bits."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    repeat = (1 << (max_bits - lengths[used].astype(np.int64))).astype(np.int64)
    ids, bits = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.uint8)
    n = int(repeat.sum())
    ids[:n], bits[:n] = np.repeat(used, repeat), np.repeat(lengths[used], repeat)
    return ids, bits


def pack_bits(ids: np.ndarray, before: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts' codes, each text from a byte boundary on: bytes, byte place of each text, bits before each id in its text."""
    n = lengths[ids].astype(np.int64)
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    size = (total[before[1:]] - total[before[:-1]] + 7) // 8
    place = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=place[1:])
    row = np.repeat(np.arange(len(size)), np.diff(before))
    inside = total[:-1] - total[before[:-1]][row]
    at = inside + 8 * place[row]
    word, free = at >> 6, 64 - (at & 63) - n
    code = codes[ids]
    high = np.where(free >= 0, code << np.maximum(free, 0).astype(np.uint64), code >> np.maximum(-free, 0).astype(np.uint64))
    out = np.zeros((int(place[-1]) >> 3) + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(high, first)
        over = free < 0
        out[word[over] + 1] += code[over] << (64 + free[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(place[-1])], place, inside


def unpack_bits(data: bytes, bit: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, np.ndarray], max_bits: int) -> np.ndarray:
    """Ids of runs that begin at the given bits, in a row; all runs are decoded in step."""
    ids, bits = table
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    place = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint32)
    order = np.argsort(-count, kind="stable")
    bit, count, place = bit[order].astype(np.int64), count[order], place[order]
    mask, step = (1 << max_bits) - 1, 0
    live = int(np.searchsorted(-count, 0))
    while live:
        at = bit[:live] >> 3
        window = raw[at].astype(np.int64) << 24 | raw[at + 1].astype(np.int64) << 16 | raw[at + 2].astype(np.int64) << 8 | raw[at + 3]
        key = (window >> (32 - max_bits - (bit[:live] & 7))) & mask
        out[place[:live] + step] = ids[key]
        bit[:live] += bits[key]
        step += 1
        live = int(np.searchsorted(-count, -step))
    return out


def encoded(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian; 2 bytes each where the vocabulary allows it), n_tokens."""
    path = tokenizer_path or tokens.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.tokenizer(path)
        kind = id_type(path)
        for batch in batches:
            for row, end, data, offsets in bytetext.slices(batch.column("text"), tokens.SLICE_BYTES):
                ids, before = coder.encode(data, offsets)
                if len(ids) * np.dtype(kind).itemsize >= 1 << 31:
                    raise ValueError("a text whose ids take 2 GB or more doesn't fit in a row")
                raw = pa.py_buffer(ids.astype(kind).tobytes())
                places = pa.py_buffer((before * np.dtype(kind).itemsize).astype(np.int32).tobytes())
                blob = pa.Array.from_buffers(pa.binary(), end - row, [None, places, raw])
                yield pa.record_batch([batch.column("doc_id").slice(row, end - row), blob, pa.array(np.diff(before), pa.int64())], names=["doc_id", "ids", "n_tokens"])

    storage.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids binary, n_tokens long")


def id_type(path: str) -> str:
    return "<u2" if tokens.tokenizer(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(coded: DataFrame, kind: str, vocabulary: int) -> np.ndarray:
    """Occurrences of every id over all documents; the driver gets one row per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(bytetext.buffers(batch.column("ids"))[0].tobytes(), kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for id_, n in coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[id_] = n
    return out


def file_count(ids: int, docs: int, tasks: int) -> int:
    """How many files so many ids in so many documents take, where `tasks` tasks write side by side."""
    size = ids + DOC_IDS * docs
    return max(1, -(-size // FILE_IDS), min(tasks, -(-size // LEAST_IDS)))


def write_files(coded: DataFrame, folder: str, lengths: np.ndarray, kind: str, files: int) -> DataFrame:
    """Write the documents in ascending doc_id order; the manifest of files: uri, first_doc, first_tie, n_tokens, n_docs, n_bytes."""
    max_bits = max(1, int(lengths.max(initial=1)))
    header = zlib.compress(json.dumps({"max_bits": max_bits, "checkpoint": CHECKPOINT}).encode() + b"\n" + lengths.tobytes())

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for batch in batches:
            for row, end, data, offsets in bytetext.slices(batch.column("ids")):
                ids = np.frombuffer(data.tobytes(), kind).astype(np.int64)
                before = offsets // np.dtype(kind).itemsize
                blob, place, inside = pack_bits(ids, before, codes, lengths)
                marks = []
                for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
                    at = inside[a:b:CHECKPOINT]
                    size = int(inside[b - 1] + lengths[ids[b - 1]]) if b > a else 0
                    marks.append(np.diff(at, append=size).astype("<u2").tobytes())
                packed = pa.Array.from_buffers(pa.binary(), end - row, [None, pa.py_buffer(place.astype(np.int32).tobytes()), pa.py_buffer(blob)])
                yield pa.record_batch([batch.column("doc_id").slice(row, end - row), pa.array(np.diff(before), pa.int64()), pa.array(marks, pa.binary()), packed], names=["doc_id", "n_tokens", "marks", "bits"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: list[pa.RecordBatch] = []
        uri = f"{folder}/{uuid.uuid4().hex}.twhf"

        def parts():
            head = MAGIC + struct.pack("<I", len(header)) + header
            at = len(head)
            yield head
            for batch in _chain(first, batches):
                data, offsets = bytetext.buffers(batch.column("bits"))
                yield data.tobytes()
                index.append(pa.record_batch([batch.column("doc_id"), batch.column("n_tokens"), pa.array(offsets[:-1] + at, pa.int64()), batch.column("marks")], names=["doc_id", "n_tokens", "place", "marks"]))
                at += len(data)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, index[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for x in index:
                    w.write_batch(x)
            tail = sink.getvalue().to_pybytes()
            yield tail
            yield struct.pack(TAIL, at, len(tail), MAGIC)

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        size = storage.write_file(uri, parts())
        n = sum(int(np.sum(x.column("n_tokens").to_numpy())) for x in index)
        yield pa.record_batch([pa.array([uri]), pa.array([first.column("doc_id")[0].as_py()], pa.int64()), pa.array([first.column("tie")[0].as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([sum(x.num_rows for x in index)], pa.int64()), pa.array([size], pa.int64())], names=["uri", "first_doc", "first_tie", "n_tokens", "n_docs", "n_bytes"])

    ranged = coded.mapInArrow(bits, "doc_id long, n_tokens long, marks binary, bits binary").withColumn("tie", F.xxhash64("bits"))
    ranged = ranged.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return storage.staged(ranged.mapInArrow(write, "uri string, first_doc long, first_tie long, n_tokens long, n_docs long, n_bytes long"), "token-manifest")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        self.file = storage.open_file(uri)
        size = self.file.size()
        at, n, magic = struct.unpack(TAIL, self._range(size - struct.calcsize(TAIL), struct.calcsize(TAIL)))
        head = self._range(0, len(MAGIC) + 4)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        info, lengths = zlib.decompress(self._range(len(head), struct.unpack("<I", head[len(MAGIC) :])[0])).split(b"\n", 1)
        info = json.loads(info)
        self.max_bits, self.checkpoint = info["max_bits"], info["checkpoint"]
        self.table = decode_table(np.frombuffer(lengths, np.uint8), self.max_bits)
        self.end = at
        self.index = pa.ipc.open_stream(self._range(at, n)).read_all().combine_chunks()

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def read(self, row: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents of index rows row..end, in a row, and the ids before each."""
        part = self.index.slice(row, end - row)
        place, n = (part[c].to_numpy() for c in ("place", "n_tokens"))
        last = int(self.index["place"][end].as_py()) if end < len(self.index) else self.end
        data = self._range(int(place[0]), last - int(place[0]))
        marks, offsets = bytetext.buffers(part["marks"])
        size = np.frombuffer(marks.tobytes(), "<u2").astype(np.int64)
        runs = -(-n // self.checkpoint)
        of = np.repeat(np.arange(len(n)), runs)
        first = np.cumsum(runs) - runs
        nth = np.arange(len(of)) - first[of]
        total = np.cumsum(size) - size
        bit = 8 * (place[of] - place[0]) + total - total[np.minimum(first, max(len(total) - 1, 0))][of] if len(of) else np.zeros(0, np.int64)
        count = np.minimum(n[of] - nth * self.checkpoint, self.checkpoint)
        before = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=before[1:])
        return unpack_bits(data, bit, count, self.table, self.max_bits), before

    def rows_from(self, low: int, high: int) -> tuple[int, int]:
        """The index rows of documents whose first id is in low..high."""
        n = self.index["n_tokens"].to_numpy()
        starts = np.cumsum(n) - n
        return int(np.searchsorted(starts, low)), int(np.searchsorted(starts, high))

    def groups(self, row: int, last: int, ids: int = DECODE_IDS) -> Iterator[tuple[int, int]]:
        """The index rows row..last in runs of whole documents of about so many ids."""
        total = np.cumsum(self.index["n_tokens"].to_numpy())
        while row < last:
            done = total[row - 1] if row else 0
            end = min(last, max(row + 1, int(np.searchsorted(total, done + ids, side="right"))))
            yield row, end
            row = end


def read_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. The driver sees one manifest row per file."""
    files = sorted(manifest.collect(), key=lambda r: (r["first_doc"] is not None, r["first_doc"] or 0, r["first_tie"]))
    base, rows, splits = 0, [], 0
    for r in files:
        rows.append((r["uri"], base, -(-r["n_tokens"] // SPLIT_IDS)))
        base += r["n_tokens"]
        splits += rows[-1][2]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base, split in zip(*(batch.column(c).to_pylist() for c in ("uri", "base", "split")), strict=True):
                file = TokenFile(uri)
                first, last = file.rows_from(split * SPLIT_IDS, (split + 1) * SPLIT_IDS)
                start = base + int(file.index["n_tokens"].to_numpy()[:first].sum())
                for row, end in file.groups(first, last):
                    ids, before = file.read(row, end)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                    yield pa.record_batch([file.index["doc_id"].slice(row, end - row).combine_chunks(), pa.array(before[:-1] + start, pa.int64()), pa.array(np.diff(before), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(before[-1])

    table = spark.createDataFrame(rows, "uri string, base long, splits long")
    each = table.select("uri", "base", F.explode(F.expr("sequence(0L, splits - 1)")).alias("split"))
    return each.repartition(max(1, min(splits, MAX_READERS))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_documents(docs: DataFrame, tokenizer_path: str | None = None, folder: str | None = None) -> DataFrame:
    """Encode, code and write all documents; returns the manifest."""
    path = tokenizer_path or tokens.default_path()
    coded = storage.staged(encoded(docs, path), "token-ids")
    kind = id_type(path)
    counts = id_counts(coded, kind, tokens.tokenizer(path).tokenizer.get_vocab_size())
    files = file_count(int(counts.sum()), coded.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return write_files(coded, folder or storage.new_folder(docs.sparkSession, "token-files"), code_lengths(counts), kind, files)
