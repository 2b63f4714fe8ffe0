"""Uncompressed video: written, read by range, and damaged."""

import random

import numpy as np

from talkweave.operators import screens
from talkweave.sources import y4m


def video(folder, name, frames, w=8, h=6):
    rng = random.Random(name)
    pictures = [bytes(rng.randrange(256) for _ in range(w * h)) for _ in range(frames)]
    y4m.write_grey(f"file://{folder}", name, iter(pictures), w, h, 10)
    return pictures


def test_round_trip_by_range(spark, tmp_path, monkeypatch):
    made = {n: video(tmp_path, n, k) for n, k in (("a", 25), ("b", 7), ("c", 0))}
    (tmp_path / "note.txt").write_text("no video")
    df = y4m.frames(spark, str(tmp_path))
    got = {(r.video_id, r.idx): r for r in df.collect()}
    assert set(got) == {(n, k) for n, p in made.items() for k in range(len(p))}
    assert all(bytes(r.image) == np.repeat(np.frombuffer(made[n][k], np.uint8), 3).tobytes() and (r.h, r.w, r.ts) == (6, 8, k / 10) for (n, k), r in got.items())
    assert {(r.video_id, r.idx) for r in df.where("video_id in ('a', 'c') and idx > 3 and idx <= 6").collect()} == {("a", 4), ("a", 5), ("a", 6)}
    # only ranges that can hold such frames are planned
    monkeypatch.setattr(y4m, "PART_BYTES", 4 * (8 * 6 + 6))
    reader = y4m.Reader(f"file://{tmp_path}")
    assert len(reader.partitions()) == 7 + 2
    list(reader.pushFilters([y4m.GreaterThanOrEqual(("idx",), 9), y4m.LessThan(("idx",), 13), y4m.EqualTo(("video_id",), "a")]))
    parts = reader.partitions()
    assert [(p.video, p.first, p.last) for p in parts] == [("a", 9, 12), ("a", 12, 13)]
    assert [i for p in parts for b in reader.read(p) for i in b.column("idx").to_pylist()] == [9, 10, 11, 12]


def test_colours(tmp_path):
    w, h = 5, 3
    for color, planes in (("444", [(235, h, w), (128, h, w), (128, h, w)]), ("420jpeg", [(16, h, w), (128, 2, 3), (128, 2, 3)]), ("444", [(81, h, w), (90, h, w), (240, h, w)])):
        head = y4m.parsed_header(y4m.header_of(w, h, 30, color))
        data = b"".join(bytes([v]) * (a * b) for v, a, b in planes)
        assert len(data) == head.frame_bytes
        pixel = np.frombuffer(y4m.rgb(data, head), np.uint8).reshape(h, w, 3)[2, 4].astype(int)
        assert np.abs(pixel - {235: [255] * 3, 16: [0] * 3, 81: [255, 0, 0]}[planes[0][0]]).max() <= 2


def test_damaged(spark, tmp_path):
    good = y4m.header_of(2, 2) + y4m.MARK + b"abcd"
    for name, data in {"good": good, "cut": good[:-1], "empty": b"", "odd": b"RIFF....", "wide": b"YUV4MPEG2 W0 H2 F1:1 Cmono\n", "mark": good + b"FRAMX\nabcd"}.items():
        (tmp_path / f"{name}.y4m").write_bytes(data)
    got = {(r.video_id, r.idx, r.error) for r in y4m.frames(spark, str(tmp_path)).collect()}
    assert got == {("good", 0, None), ("mark", 0, None), ("mark", None, "no frame where 1 should be"), ("cut", None, "not a whole number of frames"), ("empty", None, "no header that can be read"), ("odd", None, "no header that can be read"), ("wide", None, "no header that can be read")}


def test_key_frames_of_a_long_video(spark):
    """A video of many frames passes as batches: what is kept between them is one frame."""
    shades = [(255, 0, 0), (0, 255, 0), (0, 0, 255)]
    frames = spark.range(60_000).selectExpr("'v' as video_id", "cast(id as int) as idx", f"element_at(array({', '.join('X' + repr(bytes(c * 4).hex()) for c in shades)}), cast(id div 1000 % 3 + 1 as int)) as image", "2 as h", "2 as w").repartition(5)
    got = [r.idx for r in screens.key_frames(frames, fps=30).orderBy("idx").collect()]
    assert got == list(range(0, 60_000, 1000))
    sampler, video = screens.Sampler(2, 0.3, 3), []
    one = lambda b: (np.array([b], np.int16), np.array([1.0]))
    for name, idx, b in [("a", 0, 1), ("a", 1, 2), ("a", 2, 2), ("a", 4, 2), ("b", 0, 2), ("b", 9, 3), ("b", 12, 4), ("b", 15, 5)]:
        if sampler.takes(name, idx, one(b)):
            video.append((name, idx))
    assert video == [("a", 0), ("a", 2), ("b", 0), ("b", 9), ("b", 12)]


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    """Thousands of small videos are few partitions, not one each; the driver opens none of them."""
    made = {f"v{n}": video(tmp_path, f"v{n}", n % 4) for n in range(1200)}
    (tmp_path / "cut.y4m").write_bytes(y4m.header_of(2, 2) + y4m.MARK + b"abc")
    df = y4m.frames(spark, str(tmp_path))
    got = {(r.video_id, r.idx): bytes(r.image) for r in df.where("idx >= 1").collect()}
    assert got == {(n, k): np.repeat(np.frombuffer(p[k], np.uint8), 3).tobytes() for n, p in made.items() for k in range(1, len(p))}
    assert [(r.video_id, r.error) for r in df.where("error is not null").collect()] == [("cut", "not a whole number of frames")]
    monkeypatch.setattr(y4m, "parsed_header", None)
    assert len(y4m.Reader(f"file://{tmp_path}").partitions()) == 3


def test_equal_pictures_are_looked_at_once():
    """Frames of a batch that show the same are described once; size counts, not only bytes."""
    seen = []
    look = screens.once(lambda image, h, w: seen.append((image, h, w)) or len(seen))
    assert [look(*x) for x in [(b"abc", 1, 1), (b"abd", 1, 1), (b"abc", 1, 1), (b"abc" * 2, 1, 2), (b"abc" * 2, 2, 1), (b"abd", 1, 1)]] == [1, 2, 1, 3, 4, 2]
    assert len(seen) == 4
