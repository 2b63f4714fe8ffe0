"""Media columns: interleaved document sequences with media payloads by digest.

`interleaved` parses HTML into an ordered array of parts: text, or a reference to
media (its src, and the digest where the reference names one or holds the payload itself as a data URI) with its caption; positions count both kinds,
so captions and media stay aligned with the text around them. `resolve` finds the digests of other references in a table of what was fetched,
and joins digests to a store of media. `store` writes payloads losslessly as 8-bit mono WAV
files, one per row, in the shared folder; `decoded` reads the stored bytes back
and computes features where they lie, so payloads themselves are never shuffled.

Captions: a figcaption belongs to all media of its figure, before or after it, and takes the place of their alternative
texts; in a figure without media, and outside figures, it is text like any other. One that isn't closed ends with its
figure, or, if that isn't closed either, before the next block, so the rest of the page stays text.

Defined results: null html has no parts; a reference whose digest isn't known or stored resolves to null; an element
without a src is skipped; of the sources of an audio or video element the first counts; null text is an empty payload, padded like any other; equal payloads give equal
values whatever row they come from; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import struct
import urllib.parse
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import markup, storage

UNIT = 192
SAMPLE_RATE = 16000
SCHEME = "media:sha256-"
MEDIA_TAGS = frozenset("img audio video embed source".split())
PLAYERS = frozenset(["audio", "video"])
SKIPPED = frozenset("script style template noscript".split())
#: Elements that don't end a block of text.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
WAV_HEADER = "<4sL4s4sLHHLLHH4sL"
PART = "struct<position: int, kind: string, text: string, src: string, digest: string, caption: string>"
_PART = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
DECODED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest_of(src: str) -> str | None:
    """The digest that a reference names, or that of the payload it holds."""
    if src.startswith(SCHEME):
        return src[len(SCHEME) :]
    if src[:5].lower() == "data:":
        head, comma, body = src[5:].partition(",")
        if comma:
            raw = urllib.parse.unquote_to_bytes(body)
            try:
                return hashlib.sha256(base64.b64decode(raw) if head.lower().endswith(";base64") else raw).hexdigest()
            except binascii.Error:
                return None
    return None


class Figure:
    """An open figure: its media, and what its caption holds, block by block."""

    def __init__(self) -> None:
        self.media: list[dict] = []
        self.caption: list[dict] = []
        self.closed = False

    def settle(self) -> None:
        """Give the caption to the media; what isn't a caption stays text."""
        if self.media and self.caption:
            said = self.caption if self.closed else self.caption[:1]
            text = " ".join(p["text"] for p in said)
            for p in said:
                p["kind"] = "caption"
            for m in self.media:
                m["caption"] = text


class Interleaver:
    """Ordered text and media parts of a page."""

    def __init__(self, base: str | None = None) -> None:
        self.base, self.parts, self.words = base, [], []
        self.skip = 0
        self.figures: list[Figure] = []
        self.captioning: Figure | None = None
        self.player: str | None = None  # an audio or video element that has no source yet

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            part = {"kind": "text", "text": text, "src": None, "digest": None, "caption": None}
            self.parts.append(part)
            if self.captioning:
                self.captioning.caption.append(part)

    def _refer(self, src: str, alt: str | None) -> None:
        src = urllib.parse.urljoin(self.base, src) if self.base else src
        part = {"kind": "media", "text": None, "src": src, "digest": digest_of(src), "caption": alt or None}
        self.parts.append(part)
        if self.figures:
            self.figures[-1].media.append(part)

    def _start(self, tag: str, raw: str) -> None:
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag not in INLINE:
            self._flush()
        if tag == "figure":
            self.figures.append(Figure())
        elif tag == "figcaption" and self.figures:
            self.captioning = self.figures[-1]
        elif tag in MEDIA_TAGS:
            at = markup.attributes(raw)
            src = (at.get("src") or at.get("data-src") or "").strip()
            if tag == "source":
                if src and self.player:
                    self._refer(src, None)
                    self.player = None
            elif src:
                self._refer(src, at.get("alt") or at.get("title"))
            elif tag in PLAYERS:
                self.player = tag

    def _end(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag not in INLINE:
            self._flush()
        if tag == "figcaption" and self.captioning:
            self.captioning.closed, self.captioning = True, None
        elif tag == "figure" and self.figures:
            figure = self.figures.pop()
            figure.closed = True
            if self.captioning is figure:
                self.captioning = None
            figure.settle()
        elif tag == self.player:
            self.player = None

    def read(self, source: str) -> list[dict]:
        for kind, value, raw in markup.Scanner(source).events():
            if kind == "start":
                self._start(value, raw)
            elif kind == "end":
                self._end(value)
            elif not self.skip:
                self.words.append(value)
        self._flush()
        for figure in self.figures:
            figure.settle()
        return [{"position": k, **p} for k, p in enumerate(p for p in self.parts if p["kind"] != "caption")]


def parts_of(html: str | None, base: str | None = None) -> list[dict]:
    return Interleaver(base).read(html or "")


def interleaved(pages: DataFrame, key: str, html: str, base: str | None = None) -> DataFrame:
    """key, parts: the ordered parts of each page. base: a column of URLs that relative references are resolved against."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [parts_of(h, b) for h, b in zip(batch.column("html").to_pylist(), batch.column("base").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("key"), pa.array(parts, pa.list_(_PART))], names=["key", "parts"])

    typed = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"), (F.col(base) if base else F.lit(None)).cast("string").alias("base"))
    return typed.mapInArrow(run, f"key {pages.schema[key].dataType.simpleString()}, parts array<{PART}>").withColumnRenamed("key", key)


def resolve(sequences: DataFrame, index: DataFrame, key: str, fetched: DataFrame | None = None) -> DataFrame:
    """One row per part with what the index has for its digest (null for text and for media that isn't there).

    fetched: (src, digest), one row a src, of what was fetched for references that don't name a digest.
    """
    parts = sequences.select(key, F.explode("parts").alias("part")).select(key, "part.*")
    if fetched is not None:
        known = fetched.select(F.col("src").alias("_src"), F.col("digest").alias("_of"))
        parts = parts.join(known, (parts["src"] == known["_src"]) & parts["digest"].isNull(), "left").withColumn("digest", F.coalesce("digest", "_of")).drop("_src", "_of")
    found = index.withColumnRenamed("digest", "_digest")
    return parts.join(found, parts["digest"] == found["_digest"], "left").drop("_digest")


def wav(samples: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """8-bit mono PCM."""
    head = struct.pack(WAV_HEADER, b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(data: bytes) -> bytes:
    riff, _, wave, fmt, _, kind, channels, _, _, _, bits, tag, size = struct.unpack_from(WAV_HEADER, data)
    if (riff, wave, fmt, kind, channels, bits, tag) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data"):
        raise ValueError("not an 8-bit mono WAV file")
    at = struct.calcsize(WAV_HEADER)
    return data[at : at + size]


def feature(samples: bytes) -> str:
    """Mean, deviation, zero crossings and the energy of detail at five scales (Haar), in thousandths."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    out = [x.mean(), x.std(), np.count_nonzero(np.diff(np.signbit(x))) / len(x)]
    y = x
    for _ in range(5):
        y = y[: len(y) // 2 * 2].reshape(-1, 2)
        out.append(float(np.abs(y[:, 0] - y[:, 1]).mean()) / 2 if len(y) else 0.0)
        y = y.mean(axis=1)
    return ",".join(str(round(v * 1000)) for v in out)


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """Padded with blanks to a positive multiple of unit."""
    return text + b" " * ((-len(text)) % unit if text else unit)


def store(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """The written media table: doc_id, digest, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column("text")]
                full = [padded(r, unit) for r in raw]
                yield pa.record_batch([part.column("doc_id"), pa.array([hashlib.sha256(p).hexdigest() for p in full], pa.string()), pa.array([len(r) for r in raw], pa.int64()), pa.array([wav(p) for p in full], pa.binary())], names=["doc_id", "digest", "n_bytes", "media"])

    storage.bounded_batches(docs.sparkSession)
    typed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return storage.staged(typed.mapInArrow(run, "doc_id long, digest string, n_bytes long, media binary"), "media")


def decoded(media: DataFrame) -> DataFrame:
    """One row per digest: what the stored bytes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                data = data.as_buffer().to_pybytes()
                samples = wav_samples(data)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "media").mapInArrow(run, DECODED).dropDuplicates(["digest"])


def document_pages(media: DataFrame) -> DataFrame:
    """document (doc_id, n_bytes), html: each stored document as a page: its lines as paragraphs, with its media as a figure behind the first one."""
    head = struct.calcsize(WAV_HEADER)
    body = F.decode(F.substring(F.col("media"), F.lit(head + 1), F.col("n_bytes").cast("int")), "UTF-8")
    safe = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(safe, "\n")
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.col("digest"), F.lit('" alt="text as samples"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure>"))
    rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "</p><p>")
    page = F.concat(F.lit("<article><p>"), lines[0], F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))
    return media.select(F.struct("doc_id", "n_bytes").alias("document"), page.alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """Each document as a sequence of its lines and its stored media, and what its digest resolves to: one row a document, with the place of the media in the sequence."""
    media = store(docs)
    sequences = interleaved(document_pages(media), "document", "html")
    index = storage.staged(decoded(media), "media-index")  # so that the join has an exchange of its own, which a digest of very many copies doesn't skew
    # texts of a sequence stay where they are: only references travel to their digests
    refs = sequences.select(F.struct("document", F.size("parts").alias("n_parts")).alias("key"), F.filter("parts", lambda p: p["kind"] == "media").alias("parts"))
    parts = resolve(refs, index, "key")
    return parts.select("key.document.doc_id", "key.document.n_bytes", "position", "key.n_parts", "caption", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
