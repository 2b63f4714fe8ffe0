"""Key frames and screen contexts of decoded video.

Frames come as pixels (height x width x 3 bytes, RGB); decoding video is a hook, as is reading text
off a screen. Sampling looks at the last saved frame and so is an ordered fold per video; all else is per frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.functions import scalars
from talkweave.functions import text as T
from talkweave.session import materialized, small_batches

MIN_SPAN, MIN_DIFFERENCE, DEFAULT_FPS = 1.0, 0.3, 30.0
BROADCAST_ROWS = 200_000
FRAMES = "video_id string, idx int, ts double, image binary, h int, w int"
CONTEXTS = "video_id string, frame_index int, timestamp double, ocr_text string, hash string, dominant_colors array<array<int>>, edge_density double"


def quarantine(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) frames; bad ones have error_kind: missing-frame, invalid-size or invalid-length (of the pixels)."""
    size = F.octet_length("image")
    kind = F.when(size.isNull() | (size == 0), "missing-frame").when(F.coalesce(F.least("h", "w"), F.lit(0)) <= 0, "invalid-size").when(size != F.col("h").cast("long") * F.col("w") * 3, "invalid-length")
    judged = frames.withColumn("error_kind", kind)
    return judged.where("error_kind is null").drop("error_kind"), judged.where("error_kind is not null")


def pixels(image: bytes | pa.Buffer, h: int, w: int) -> np.ndarray:
    return np.frombuffer(image, np.uint8)[: h * w * 3].reshape(h, w, 3)


def once(look: Callable) -> Callable:
    """look, at each picture only once: screens mostly stand still, so a batch of frames holds few different ones. What is kept goes with the batch."""
    known: dict[tuple, object] = {}

    def remembered(image: bytes, h: int, w: int):
        key = (bytes(image), int(h), int(w))
        if key not in known:
            known[key] = look(*key)
        return known[key]

    return remembered


def hue_saturation(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue in 0..180 and saturation in 0..256 of every pixel."""
    x = rgb.reshape(-1, 3).astype(np.float64)
    high, low = x.max(axis=1), x.min(axis=1)
    span = np.where(high > low, high - low, 1)
    r, g, b = x.T
    hue = np.select([high == low, high == r, high == g], [0, (g - b) / span % 6, (b - r) / span + 2], (r - g) / span + 4) * 30
    return hue, np.where(high > 0, (high - low) / np.where(high > 0, high, 1) * 255, 0)


def histogram(rgb: np.ndarray, bins: int = 32) -> np.ndarray:
    """Hue by saturation, scaled to unit length, flat."""
    hue, saturation = hue_saturation(rgb)
    at = np.minimum(hue * bins // 180, bins - 1).astype(int) * bins + np.minimum(saturation * bins // 256, bins - 1).astype(int)
    h = np.bincount(at, minlength=bins * bins).astype(np.float64)
    return h / (np.linalg.norm(h) or 1.0)


def sparse(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins of a histogram that hold anything, and what they hold."""
    at = np.flatnonzero(hist)
    return at.astype(np.int16), hist[at]


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Bhattacharyya distance of sparse histograms."""
    norm = np.sqrt(a[1].sum() * b[1].sum())
    if norm <= 0:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return float(np.sqrt(max(0.0, 1 - np.sqrt(a[1][i] * b[1][j]).sum() / norm)))


class Sampler:
    """W12 over the frames of videos in order: what is remembered is the last saved frame of the current video."""

    def __init__(self, gap: int, min_difference: float, max_frames: int | None) -> None:
        self.gap, self.min_difference, self.max_frames = gap, min_difference, max_frames
        self.video: str | None = None
        self.saved, self.at = 0, 0
        self.last: tuple[np.ndarray, np.ndarray] | None = None

    def takes(self, video: str, idx: int, hist: tuple[np.ndarray, np.ndarray]) -> bool:
        if video != self.video or self.last is None:
            self.video, self.saved, self.last = video, 0, None
        if self.max_frames is not None and self.saved >= self.max_frames:
            return False
        if self.last is not None and (idx - self.at < self.gap or distance(self.last, hist) < self.min_difference):
            return False
        self.saved, self.last, self.at = self.saved + 1, hist, idx
        return True


def key_frames(frames: DataFrame, fps: float = DEFAULT_FPS, min_span: float = MIN_SPAN, min_difference: float = MIN_DIFFERENCE, max_frames: int | None = None) -> DataFrame:
    """The first frame, then each that is far enough in time and looks different from the last saved one.

    Histograms come first, per frame and in parallel, as the few bins that hold anything. They are sorted by video and frame (which spills) and walked batch
    by batch; a video of any length takes the memory of a batch and one saved frame. Pixels aren't shuffled
    while the keys of saved frames are few (BROADCAST_ROWS, counted)."""
    fps = fps if fps > 0 else DEFAULT_FPS
    gap = max(int(fps * min_span), 1)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("h").to_pylist(), batch.column("w").to_pylist(), strict=True)
            look = once(lambda x, h, w: sparse(histogram(pixels(x, h, w))))
            found = [look(x, h, w) for x, (h, w) in zip(batch.column("image").to_pylist(), sizes, strict=True)]
            yield pa.record_batch([batch.column("video_id"), batch.column("idx"), pa.array([b for b, _ in found], pa.list_(pa.int16())), pa.array([v for _, v in found], pa.list_(pa.float64()))], names=["video_id", "idx", "bins", "values"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(gap, min_difference, max_frames)
        for batch in batches:
            bins, values = (batch.column(c).flatten().to_numpy() for c in ("bins", "values"))
            ends = np.cumsum(batch.column("bins").value_lengths().to_numpy(zero_copy_only=False)).tolist()
            keys = zip(batch.column("video_id").to_pylist(), batch.column("idx").to_pylist(), [0, *ends[:-1]], ends, strict=True)
            hit = [sampler.takes(video, idx, (bins[a:b], values[a:b])) for video, idx, a, b in keys]
            yield batch.select(["video_id", "idx"]).filter(pa.array(hit, pa.bool_()))

    small_batches(frames.sparkSession)
    described = frames.select("video_id", "idx", "image", "h", "w").mapInArrow(describe, "video_id string, idx int, bins array<short>, values array<double>")
    ordered = described.repartition("video_id").sortWithinPartitions("video_id", "idx")
    chosen = materialized(ordered.mapInArrow(walk, "video_id string, idx int"))
    few = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return frames.join(F.broadcast(chosen) if few else chosen, ["video_id", "idx"], "left_semi").withColumn("ts", F.col("idx") / fps)


def average_hash(rgb: np.ndarray, size: int = 8) -> str:
    """Area-averaged grey, a bit for each cell above the mean; hex."""
    grey = np.rint(rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114]))

    def shrunk(x: np.ndarray) -> np.ndarray:
        total = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        edges = np.linspace(0, len(x), size + 1)
        whole = np.minimum(edges.astype(int), len(x) - 1)
        at = total[whole] + (edges - whole)[:, None] * x[whole]
        return np.diff(at, axis=0) / (len(x) / size)

    cells = np.rint(shrunk(shrunk(grey).T).T)
    bits = (cells > cells.mean()).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{size * size // 4}x}"


def dominant_colors(rgb: np.ndarray, k: int = 3, rounds: int = 10) -> list[tuple[int, int, int]]:
    """Centres of k clusters of pixels, by size (k-means from evenly spaced pixels by brightness, so that reruns agree)."""
    x = rgb.reshape(-1, 3).astype(np.float64)
    k = max(1, min(k, len(x)))
    centres = x[np.argsort(x.sum(axis=1), kind="stable")[np.linspace(0, len(x) - 1, k).astype(int)]]
    for _ in range(rounds):
        label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[label == i].mean(axis=0) if (label == i).any() else centres[i] for i in range(k)])
        if np.abs(moved - centres).max() < 1:
            break
        centres = moved
    return [tuple(c) for c in centres[np.argsort(-np.bincount(label, minlength=k), kind="stable")].astype(int).tolist()]


#: Weights of red, green and blue in grey levels, in 2^-14; the tangent of 22.5 degrees.
GREY = np.array([4899, 9617, 1868])
TANGENT = np.sqrt(2) - 1


def gradient(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives to the right and downwards; the border's pixels are repeated outwards."""
    x = np.pad(grey.astype(np.int64), 1, mode="edge")
    across, down = x[:-2] + 2 * x[1:-1] + x[2:], x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]
    return across[:, 2:] - across[:, :-2], down[2:] - down[:-2]


def ridges(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Where the gradient is largest along its own direction, taken to the next of four; of two equal neighbours the first in reading order."""
    size = np.pad(np.abs(dx) + np.abs(dy), 1)
    h, w = dx.shape
    at = lambda i, j: size[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    own, ax, ay = at(0, 0), np.abs(dx), np.abs(dy)
    flat, steep = ay < TANGENT * ax, ay * TANGENT > ax
    rising = (dx < 0) != (dy < 0)
    pairs = [(flat, at(0, -1), at(0, 1), True), (steep, at(-1, 0), at(1, 0), True), (~flat & ~steep & ~rising, at(-1, -1), at(1, 1), False), (~flat & ~steep & rising, at(-1, 1), at(1, -1), False)]
    out = np.zeros((h, w), bool)
    for there, before, after, tie in pairs:
        out |= there & (own > before) & ((own >= after) if tie else (own > after))
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected components of a mask, 0 elsewhere: runs of each row, joined in rounds over all of them at once."""
    h, w = mask.shape
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    # runs of the row above that touch, corners too: those that end at or behind the begin and begin at or before the end
    own, above = row * (w + 2), (row - 1) * (w + 2)
    first = np.searchsorted(own + end, above + start)
    n = np.maximum(np.searchsorted(own + start, above + end, side="right") - first, 0)
    below = np.repeat(np.arange(len(row)), n)
    upper = np.arange(len(below)) + np.repeat(first - (np.cumsum(n) - n), n)
    root = np.arange(len(row))
    while len(below):  # roots hook onto the least root that they touch, then all runs point at their root
        p, q = root[upper], root[below]
        apart = p != q
        upper, below, p, q = upper[apart], below[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    out = np.zeros((h, w + 1), np.int64)
    if len(row):
        out[row, start] += root + 1
        out[row, end] -= root + 1
    return np.cumsum(out, axis=1)[:, :w]


def grey_levels(rgb: np.ndarray) -> np.ndarray:
    return (rgb.astype(np.int64) @ GREY + (1 << 13)) >> 14


def edges(grey: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Canny's edges: ridges of the gradient above low, in components that somewhere exceed high."""
    dx, dy = gradient(grey)
    size = np.abs(dx) + np.abs(dy)
    label = components(ridges(dx, dy) & (size > low))
    strong = np.zeros(int(label.max(initial=0)) + 1, bool)
    strong[label[size > high]] = True
    strong[0] = False
    return strong[label]


def edge_density(rgb: np.ndarray, low: float = 100, high: float = 200) -> float:
    """P10: the share of edge pixels."""
    return float(edges(grey_levels(rgb), low, high).mean())


def edge_counts(pictures: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """P10 of grey pictures (video_id, grey: a byte per pixel, h, w): carry and edge_pixels, a picture at a time."""
    names = ["video_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("h").to_pylist(), batch.column("w").to_pylist(), strict=True)
            found = [int(edges(np.frombuffer(x.as_buffer(), np.uint8)[: h * w].reshape(h, w)).sum()) for x, (h, w) in zip(batch.column("grey"), sizes, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(found, pa.int64())], names=[*names, "edge_pixels"])

    small_batches(pictures.sparkSession)
    schema = ", ".join(f"{c} {pictures.schema[c].dataType.simpleString()}" for c in names)
    return pictures.select(*names, "grey", "h", "w").mapInArrow(run, f"{schema}, edge_pixels long")


def contexts(frames: DataFrame, ocr: Callable[[np.ndarray, str], str] | None = None, languages: tuple[str, ...] = ("jpn", "eng")) -> DataFrame:
    """What each frame shows. ocr: (pixels, language) -> text; the first language with text counts, a failure is no text."""

    def read(rgb: np.ndarray) -> str:
        for language in languages if ocr else ():
            try:
                text = ocr(rgb, language).strip()
            except Exception:  # a reader that fails reads nothing
                text = ""
            if text:
                return text
        return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            look = once(lambda i, h, w: tuple(f(pixels(i, h, w)) for f in (read, average_hash, dominant_colors, edge_density)))
            seen = [look(i, h, w) for i, h, w in zip(pdf["image"], pdf["h"], pdf["w"], strict=True)]
            columns = dict(zip(("ocr_text", "hash", "dominant_colors", "edge_density"), map(list, zip(*seen, strict=True)) if seen else ([],) * 4, strict=True))
            yield pd.DataFrame({"video_id": pdf["video_id"], "frame_index": pdf["idx"], "timestamp": pdf["ts"], **columns})

    small_batches(frames.sparkSession)
    seen = frames.select("video_id", "idx", "ts", "image", "h", "w").mapInPandas(run, CONTEXTS)
    seen = seen.withColumn("dominant_colors", F.transform("dominant_colors", lambda c: scalars.color_name(c[0], c[1], c[2])))
    return seen.withColumn("tags", T.screen_keywords(F.col("ocr_text"))).withColumn("label", T.screen_label(F.col("tags"), F.col("ocr_text"), F.col("frame_index")))


def video_contexts(frames: DataFrame, ocr: Callable[[np.ndarray, str], str] | None = None, **sampling) -> DataFrame:
    """Contexts of the key frames."""
    return contexts(key_frames(frames, **sampling), ocr)
