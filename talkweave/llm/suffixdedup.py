"""Removal of repeated passages: every byte covered by a LENGTH-byte string that starts earlier.

Whole texts, UTF-8 bytes, any number of documents, without a global suffix array:

1. Anchors. In each window of LENGTH bytes the ANCHOR-byte string with the least hash is its
   anchor, so equal windows have equal anchors, wherever they are. Windows in a row with one anchor
   are a run: about one run in 35 bytes, with a context of about 135 bytes, named by a keyed 128-bit digest.
2. Runs meet by anchor. Runs with equal contexts repeat the first of them as a whole. That is
   combined per Arrow batch before the shuffle, and folded as it comes in after it, so a passage
   in a third of all documents sends one entry a batch. A first run is open if its anchor has other contexts.
3. Open runs (the edges of repeats) send their bytes; windows with equal anchors at equal places are sorted
   by the hash-compared suffix mergesort of `suffixarray`, and neighbours in that order that are equal
   byte by byte are repeats of the first.
4. An anchor with more than HOT_CONTEXTS contexts (the edge of a passage that very many documents share) is too much
   for one sort: its runs are cut into runs of one window each, which meet by digest as in step 2, spread evenly.
5. Repeated ranges come back to their row by doc_id and a hash of the text, and are cut out.

Texts are shuffled once, runs once; a task holds the distinct runs of one bucket at a time, and the number of
buckets grows with the bytes of the texts.

Defined results: null counts as empty; texts below LENGTH bytes lose nothing; doc_id null sorts before all ids;
rows that share a doc_id (or have none) don't repeat each other, whether their texts are equal or not, but each
repeats itself and documents with smaller ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm import bytetext, storage, workers
from talkweave.llm.suffixarray import HashedText, merge_sorted

LENGTH = 100
ANCHOR = 32
NO_ID = -(1 << 63)
#: Distinct contexts of one anchor that are sorted together; beyond, windows meet by digest.
HOT_CONTEXTS = 512
#: Bytes of texts for one bucket of runs.
BUCKET_BYTES = 32 << 20
#: Bytes of runs that a task takes in before it folds them.
FOLD_BYTES = 8 << 20
KEY = b"talkweave passage"
#: `text` is a hash of the text: with doc it names the row. low and high: digest of the context.
FIELDS = (("anchor", "<u8"), ("low", "<u8"), ("high", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("at", "<u4"), ("windows", "<u2"), ("shift", "<u2"))
RUN_BYTES = sum(np.dtype(t).itemsize for _, t in FIELDS)
#: What is known to repeat an earlier run of its batch, as stretches of the text.
SPANS = (("doc", "<i8"), ("text", "<i8"), ("at", "<u4"), ("end", "<u4"))
#: Runs that a task holds before it sends them.
HELD_RUNS = 1 << 18
RANGES = "doc long, text long, at int, end int, anchor long, shift int, hot boolean"


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: row, at (first window in its text), windows, shift (of the anchor in the first window), hash of the anchor, digest of the context."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return {"row": none, "at": none, "windows": none, "shift": none} | {f: none.view(np.uint64) for f in ("anchor", "low", "high")}
    prefix = bytetext.prefix_hashes(data)
    at = np.arange(len(data) - anchor + 1)
    bits = np.uint64(len(data).bit_length())
    low = bytetext.span_hashes(prefix, at, at + anchor) >> bits << bits | at.astype(np.uint64)
    width, have = length - anchor + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    least = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the window that starts here
    size = np.diff(offsets)
    count = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + offsets[row]
    where = least[start]
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (row[1:] != row[:-1])])) if len(row) else none
    windows = np.diff(np.append(new, len(row)))
    row, start, where = row[new], start[new], where[new]
    low, high = digests(data, start, start + windows + length - 1)
    return {"row": row, "at": start - offsets[row], "windows": windows, "shift": where - start, "anchor": bytetext.span_hashes(prefix, where, where + anchor), "low": low, "high": high}


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keyed 128-bit digests of data[start:end], as two numbers."""
    raw = memoryview(np.ascontiguousarray(data))
    joined = b"".join([hashlib.blake2b(raw[a:b], digest_size=16, key=KEY).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(joined, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _pack(x: dict[str, np.ndarray], items: np.ndarray, fields: tuple = FIELDS) -> bytes:
    return b"".join(x[f][items].astype(t).tobytes() for f, t in fields)


def _unpack(blobs: list[bytes], fields: tuple = FIELDS) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {f: [np.zeros(0, t)] for f, t in fields}
    size = sum(np.dtype(t).itemsize for _, t in fields)
    for blob in blobs:
        n, place = len(blob) // size, 0
        for f, t in fields:
            parts[f].append(np.frombuffer(blob, t, n, place))
            place += n * np.dtype(t).itemsize
    return {f: np.concatenate(p) for f, p in parts.items()}


def stretches(doc: np.ndarray, text: np.ndarray, at: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """SPANS: the ranges of each row, those that overlap or touch as one. In a row, later ranges must not end before earlier ones."""
    order = np.lexsort((at, text, doc))
    doc, text, at, end = doc[order], text[order], at[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (at[1:] > end[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc))[: len(begin)] - 1
    return {"doc": doc[begin], "text": text[begin], "at": at[begin], "end": end[last]}


def later_ones(group_starts: np.ndarray, doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of items in order of (group, doc, text, place): has an equal one a smaller doc, or an earlier place in the same row."""
    at = np.arange(len(doc))
    first = np.maximum.accumulate(np.where(group_starts, at, 0))
    row_starts = group_starts.copy()
    row_starts[1:] |= (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    return (doc > doc[first]) | ~row_starts


def _firsts(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by (context, doc, text, at), and which in that order repeat an earlier equal context."""
    order = np.lexsort((x["at"], x["text"], x["doc"], x["high"], x["low"]))
    low, high = x["low"][order], x["high"][order]
    new = np.ones(len(order), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return order, later_ones(new, x["doc"][order], x["text"][order])


def _range_batch(doc: np.ndarray, text: np.ndarray, at: np.ndarray, end: np.ndarray, anchor: np.ndarray | None = None, shift: np.ndarray | None = None, hot: bool = False) -> pa.RecordBatch:
    """Ranges; open ones have an anchor."""
    n = len(doc)
    none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())
    more = none if anchor is None else (pa.array(anchor.view(np.int64)), pa.array(shift.astype(np.int32)))
    return pa.record_batch([pa.array(doc, pa.int64()), pa.array(text, pa.int64()), pa.array(at.astype(np.int32)), pa.array(end.astype(np.int32)), *more, pa.array(np.full(n, hot))], names=["doc", "text", "at", "end", "anchor", "shift", "hot"])


def _messages(x: dict[str, np.ndarray], buckets: int, length: int) -> pa.RecordBatch:
    """Runs by bucket of their anchor, but for those that repeat an earlier one among them: what these cover goes as stretches, dealt by row."""
    order, repeats = _firsts(x)
    out = []

    def send(values: dict[str, np.ndarray], items: np.ndarray, by: np.ndarray, flag: bool, fields: tuple) -> None:
        bucket = (bytetext.mix(by) % np.uint64(buckets)).astype(np.int64)
        items = items[np.argsort(bucket[items], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[items])) + 1
        out.extend((int(bucket[g[0]]), flag, _pack(values, g, fields)) for g in np.split(items, cuts) if len(g))

    send(x, order[~repeats], x["anchor"], False, FIELDS)
    again = order[repeats]
    at = x["at"][again].astype(np.int64)
    spans = stretches(x["doc"][again], x["text"][again], at, at + x["windows"][again] + length - 1)
    send(spans, np.arange(len(spans["doc"])), spans["text"].astype(np.int64).view(np.uint64), True, SPANS)
    return pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.bool_()), pa.array([r[2] for r in out], pa.binary())], names=["bucket", "repeats", "blob"])


MESSAGES = "bucket long, repeats boolean, blob binary"


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets): a slice of texts as it is, or parts of one long text that share length - 1 bytes, so that each window is in one.
    A run that is cut there is two; what equals a part of it alone is found like any edge of a repeat."""
    if len(offsets) > 2 or len(data) <= 2 * bytetext.SLICE_BYTES:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - length + 1, bytetext.SLICE_BYTES):
        part = data[at : at + bytetext.SLICE_BYTES + length - 1]
        yield at, part, np.array([0, len(part)])


def run_messages(texts: DataFrame, buckets: int, length: int, anchor: int) -> DataFrame:
    """MESSAGES of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.drop()
        for batch in batches:
            docs, names = batch.column("doc").to_numpy(), batch.column("name").to_numpy()
            parts, held = [], 0
            for row, _, data, offsets in bytetext.slices(batch.column("text")):
                for place, part, cut in pieces(data, offsets, length):
                    x = anchored_runs(part, cut, length, anchor)
                    of = row + x.pop("row")
                    parts.append(x | {"at": x["at"] + place, "doc": docs[of], "text": names[of]})
                    held += len(of)
                    if held > HELD_RUNS:
                        yield _messages({f: np.concatenate([p[f] for p in parts]) for f, _ in FIELDS}, buckets, length)
                        parts, held = [], 0
            if parts:
                yield _messages({f: np.concatenate([p[f] for p in parts]) for f, _ in FIELDS}, buckets, length)

    return texts.mapInArrow(run, MESSAGES)


def by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """Rows of each bucket together, in as many partitions as keep a few buckets each."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition("bucket") if buckets <= 8 * usual else df.repartition(buckets // 8, "bucket")
    return dealt.sortWithinPartitions("bucket")


class RunFold:
    """The distinct runs of one bucket, folded as they come in."""

    def __init__(self, length: int) -> None:
        self.length, self.held = length, _unpack([])
        self.hot = np.zeros(0, np.uint64)
        self.waiting: list[bytes] = []
        self.size = 0

    def ranges(self, x: dict[str, np.ndarray], items: np.ndarray, open_: bool = False, hot: bool = False) -> Iterator[pa.RecordBatch]:
        if len(items):
            y = {f: x[f][items] for f, _ in FIELDS}
            end = y["at"].astype(np.int64) + y["windows"] + self.length - 1
            yield _range_batch(y["doc"], y["text"], y["at"], end, *((y["anchor"], y["shift"], hot) if open_ else ()))

    def add(self, blob: bytes) -> Iterator[pa.RecordBatch]:
        self.waiting.append(blob)
        self.size += len(blob)
        if self.size > max(FOLD_BYTES, RUN_BYTES * len(self.held["doc"])):
            yield from self.fold()

    def fold(self) -> Iterator[pa.RecordBatch]:
        """Take in what waits: repeats and runs of hot anchors go out."""
        new = _unpack(self.waiting)
        self.waiting, self.size = [], 0
        known = np.isin(new["anchor"], self.hot)
        yield from self.ranges(new, np.flatnonzero(known), True, True)
        x = {f: np.concatenate([self.held[f], new[f][~known]]) for f, _ in FIELDS}
        order, repeats = _firsts(x)
        yield from self.ranges(x, order[repeats])
        left = order[~repeats]
        anchors, of, contexts = self.contexts(x, left)
        crowded = contexts > HOT_CONTEXTS
        yield from self.ranges(x, left[crowded[of]], True, True)
        self.hot = np.concatenate([self.hot, anchors[crowded]])
        self.held = {f: x[f][left[~crowded[of]]] for f, _ in FIELDS}

    @staticmethod
    def contexts(x: dict[str, np.ndarray], items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of items in order of context, which of them each has, and how many contexts it has."""
        anchors, of = np.unique(x["anchor"][items], return_inverse=True)
        low, high = x["low"][items], x["high"][items]
        new = np.ones(len(items), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        return anchors, of, np.bincount(of, new, len(anchors))

    def close(self) -> Iterator[pa.RecordBatch]:
        """First runs whose anchor has other contexts."""
        yield from self.fold()
        _, of, contexts = self.contexts(self.held, np.arange(len(self.held["doc"])))
        yield from self.ranges(self.held, np.flatnonzero(contexts[of] > 1), True)


def run_ranges(messages: DataFrame, length: int, buckets: int) -> DataFrame:
    """RANGES: whole runs that repeat an earlier run (anchor null), and first runs whose anchor has other contexts (open: with anchor; hot: too many contexts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, last = RunFold(length), None
        for batch in batches:
            for bucket, repeats, blob in zip(*(batch.column(c) for c in ("bucket", "repeats", "blob")), strict=True):
                if bucket != last:
                    yield from fold.close()
                    fold, last = RunFold(length), bucket
                raw = blob.as_buffer().to_pybytes()
                if repeats.as_py():
                    yield _range_batch(*_unpack([raw], SPANS).values())
                else:
                    yield from fold.add(raw)
        yield from fold.close()

    return by_bucket(messages, buckets).mapInArrow(run, RANGES)


def _flat(ranges: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row numbers and fields (at, end, anchor, shift, hot, open) of all ranges of a column of lists."""
    n = pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False)
    items = ranges.flatten()
    x = {f: np.asarray(pc.fill_null(items.field(f), 0).to_numpy(zero_copy_only=False), np.int64) for f in ("at", "end", "anchor", "shift")}
    x["open"] = np.asarray(items.field("anchor").is_valid())
    x["hot"] = np.asarray(items.field("hot").to_numpy(zero_copy_only=False), bool)
    return np.repeat(np.arange(len(n)), n), x


def _open(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Bytes of the texts of a batch, begins and fields (doc and text among them) of its open runs, some at a time."""
    docs, names = batch.column("doc").to_numpy(), batch.column("name").to_numpy()
    data, offsets = bytetext.buffers(batch.column("text"))
    rows, x = _flat(batch.column("ranges"))
    use = np.flatnonzero(x["open"] & (x["hot"] == hot) & (x["end"] <= np.diff(offsets)[rows]))
    for k in range(0, len(use), 1 << 14):
        part = use[k : k + (1 << 14)]
        yield data, offsets[rows[part]] + x["at"][part], {f: v[part] for f, v in x.items()} | {"doc": docs[rows[part]], "text": names[rows[part]]}


def hot_messages(joined: DataFrame, buckets: int, length: int) -> DataFrame:
    """MESSAGES of the windows of hot open runs, as runs of one window each, which their digest serves as anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, begin, x in _open(batch, True):
                n = x["end"] - x["at"] - length + 1
                of = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                low, high = digests(data, begin[of] + nth, begin[of] + nth + length)
                one, none = np.ones(len(of), np.int64), np.zeros(len(of), np.int64)
                yield _messages({"anchor": low, "low": low, "high": high, "doc": x["doc"][of], "text": x["text"][of], "at": x["at"][of] + nth, "windows": one, "shift": none}, buckets, length)

    return joined.mapInArrow(run, MESSAGES)


def open_contexts(joined: DataFrame, buckets: int) -> DataFrame:
    """(bucket, anchor, doc, text, at, shift, bytes) of every open run that isn't hot."""
    names = ["bucket", "anchor", "doc", "text", "at", "shift", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, begin, x in _open(batch, False):
                n = x["end"] - x["at"]
                place = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n, out=place[1:])
                raw = data[np.repeat(begin - place[:-1], n) + np.arange(int(place[-1]))]
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(place.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                bucket = (bytetext.mix(x["anchor"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                yield pa.record_batch([pa.array(bucket), pa.array(x["anchor"]), pa.array(x["doc"]), pa.array(x["text"]), pa.array(x["at"].astype(np.int32)), pa.array(x["shift"].astype(np.int32)), blob], names=names)

    return joined.mapInArrow(run, "bucket long, anchor long, doc long, text long, at int, shift int, bytes binary")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket, from batches sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and a < b and held[0].column("bucket")[0].as_py() != bucket[a]:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def window_ranges(contexts: DataFrame, length: int, buckets: int) -> DataFrame:
    """RANGES of windows in open runs that equal an earlier window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.drop()
        for rows in grouped(batches):
            data, offsets = bytetext.buffers(rows["bytes"])
            text = HashedText(data, length)
            anchor, doc, name, at, shift = (rows[f].to_numpy().astype(np.int64) for f in ("anchor", "doc", "text", "at", "shift"))
            windows = np.diff(offsets) - length + 1
            of = np.repeat(np.arange(len(windows)), windows)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
            suffix = offsets[:-1][of] + nth
            # equal windows have equal anchors at equal places; what is alone there needs no sorting
            group = bytetext.mix(anchor[of].view(np.uint64) + bytetext.mix((shift[of] - nth).astype(np.uint64)))
            order = np.argsort(group)
            alike = np.diff(group[order]) == 0
            some = np.zeros(len(group), bool)
            some[order[1:][alike]] = some[order[:-1][alike]] = True
            group, suffix, of, nth = group[some], suffix[some], of[some], nth[some]
            order = np.lexsort((at[of] + nth, name[of], doc[of], group))
            group, suffix, of, nth = group[order], suffix[order], of[order], nth[order]
            ranked = merge_sorted(text, suffix, group)
            group, suffix, of, nth = group[ranked], suffix[ranked], of[ranked], nth[ranked]
            new = np.ones(len(of), bool)
            together = np.flatnonzero(group[1:] == group[:-1]) + 1
            new[together] = ~text.equal(suffix[together], suffix[together - 1])
            hit = later_ones(new, doc[of], name[of])
            d, t, p = doc[of][hit], name[of][hit], (at[of] + nth)[hit]
            order = np.lexsort((p, t, d))
            d, t, p = d[order], t[order], p[order]
            begin = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
            last = np.append(begin[1:], len(d)) - 1 if len(d) else begin
            yield _range_batch(d[begin], t[begin], p[begin], p[last] + length)

    return by_bucket(contexts, buckets).mapInArrow(run, RANGES)


def _removed(offsets: np.ndarray, ranges: pa.Array, n_bytes: int) -> np.ndarray:
    """Mask of the bytes that the closed ranges of each text cover."""
    rows, x = _flat(ranges)
    closed = ~x["open"]
    rows, limit = rows[closed], offsets[rows[closed] + 1]
    edge = np.bincount(np.minimum(offsets[rows] + x["at"][closed], limit), minlength=n_bytes + 1)
    edge -= np.bincount(np.minimum(offsets[rows] + x["end"][closed], limit), minlength=n_bytes + 1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, carry: tuple[str, ...] = (), texts_too: bool = True) -> DataFrame:
    """doc_id, text (what is left), n_bytes, n_removed, n_spans, kept_sha256, and the columns named by `carry`.

    Cuts fall on bytes: where one splits a character, its rest is dropped from `text` (kept_sha256 is of the bytes as cut).
    Without texts_too, text is null.
    """
    storage.bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    kept_too = [f"_{i}" for i in range(len(carry))]
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string"), *(F.col(c).alias(k) for c, k in zip(carry, kept_too, strict=True)))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    texts = texts.withColumn("name", F.xxhash64("text"))
    ranges = storage.staged(run_ranges(run_messages(texts.select("doc", "name", "text"), buckets, length, anchor), length, buckets), "suffix-ranges")

    def joined(found: DataFrame) -> DataFrame:
        lists = found.groupBy("doc", F.col("text").alias("name")).agg(F.collect_list(F.struct("at", "end", "anchor", "shift", "hot")).alias("ranges"))
        return texts.join(lists, ["doc", "name"], "left")

    edges = joined(ranges.where("anchor is not null")).where("ranges is not null")
    more = window_ranges(open_contexts(edges, buckets), length, buckets)
    if ranges.where("hot").limit(1).count():
        # windows of few runs: fewer buckets, or a batch's message to each would hold a window or two
        few = max(16, buckets // 8)
        hot = run_ranges(hot_messages(joined(ranges.where("hot")).where("ranges is not null"), few, length), length, few)
        more = more.unionByName(hot)
    final = joined(ranges.where("anchor is null").unionByName(more))
    names = ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", *kept_too]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            ids = pa.array(ids, pa.int64(), mask=ids == NO_ID)
            for row, end, data, offsets in bytetext.slices(batch.column("text")):
                gone = _removed(offsets, batch.column("ranges").slice(row, end - row), len(data))
                _, _, spans = bytetext.runs(gone, offsets)
                kept = data[~gone].tobytes()
                total = np.zeros(len(data) + 1, np.int64)
                np.cumsum(gone, out=total[1:])
                removed = total[offsets[1:]] - total[offsets[:-1]]
                place = (offsets - total[offsets]).tolist()
                left = [kept[a:b] for a, b in zip(place[:-1], place[1:], strict=True)]
                columns = [ids.slice(row, end - row), pa.array([x.decode("utf-8", "ignore") for x in left] if texts_too else [None] * len(left), pa.string()), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(spans), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
                yield pa.record_batch(columns + [batch.column(k).slice(row, end - row) for k in kept_too], names=names)

    schema = T.StructType.fromDDL("doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    for c, k in zip(carry, kept_too, strict=True):
        schema = schema.add(k, docs.schema[c].dataType)
    return final.mapInArrow(cut, schema).withColumnsRenamed(dict(zip(kept_too, carry, strict=True)))
