"""The committer as a batch fold and as a stream."""

import json
import os
import random

import pytest

from talkweave.streaming import committer


def updates(spark, rows):
    return spark.createDataFrame([(s, n, [(float(a), float(b), t) for a, b, t in segs], float(ws), float(now), final, float(look)) for s, n, segs, ws, now, final, look in rows], committer.UPDATES)


def replay(rows):
    """One session at a time, update by update."""
    out = {}
    for session, _, segs, ws, now, final, look in sorted(rows, key=lambda r: (r[0], r[1])):
        kept, until = out.setdefault(session, [[], 0.0])
        cut = now if final else max(0, now - look)
        if not final and cut <= ws:
            cut = float("inf")
        for e, s, t in sorted((b + ws, a + ws, t) for a, b, t in segs):
            if e > cut or e <= until + 1e-6:
                continue
            until = e
            if not (kept and kept[-1][1].strip() == t.strip() and s - kept[-1][0] <= 0.5):
                kept.append((e, t))
        out[session][1] = until
    return {s: ("".join(t for _, t in k).strip(), round(u, 6)) for s, (k, u) in out.items()}


CASES = {
    "lookback": ([("s", 0, [(8, 9, "A"), (9, 10, "B")], 0, 10, False, 1)], ("A", 9.0)),
    "final": ([("s", 0, [(8, 9, "A"), (9, 10, "B")], 0, 10, False, 1), ("s", 1, [(8, 9, "A"), (9, 10, "B")], 0, 10, True, 1)], ("AB", 10.0)),
    "absolute": ([("s", 0, [(0, 1, "X")], 5, 6, True, 0)], ("X", 6.0)),
    "repeat": ([("s", 0, [(0, 1, "Hi")], 0, 1, True, 0), ("s", 1, [(0.1, 0.9, "Hi")], 1.1, 2.0, True, 0)], ("Hi", 2.0)),
    "lifted": ([("s", 0, [(0, 0.5, "A"), (0.5, 0.9, "B")], 4.5, 5.2, False, 1)], ("AB", 5.4)),
    "nothing": ([("s", 0, [], 0, 1, True, 0)], ("", 0.0)),
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    rows, expected = CASES[case]
    r = committer.committed(updates(spark, rows)).first()
    assert (r.text, round(r.duration, 6)) == expected


def random_rows():
    rng, rows = random.Random(5), []
    for s in range(25):
        now = 0.0
        for n in range(rng.randint(1, 5)):
            ws = max(0.0, now - 3)
            now += rng.randint(1, 4)
            at, segs = 0.0, []
            while ws + at < now - 1:
                step = rng.choice([0.5, 1.0, 1.5])
                segs.append((at, at + step, rng.choice(["a ", "b ", "c "])))
                at += step
            rows.append((f"s{s}", n, segs, ws, now, False, 1.0))
        rows[-1] = (*rows[-1][:5], True, 1.0)
    return rows


def test_fold_equals_replay(spark):
    rows = random_rows()
    got = {r.session: (r.text, round(r.duration, 6)) for r in committer.committed(updates(spark, rows)).collect()}
    assert got == replay(rows)


def test_stream_equals_fold(spark, tmp_path):
    rows = random_rows()
    source, names = tmp_path / "in", ("session", "update_seq", "segments", "window_start", "now_total", "final", "lookback")
    source.mkdir()
    for n in range(5):  # one file a micro-batch
        with (source / f"{n}.json").open("w") as f:
            for r in rows:
                if r[1] == n:
                    f.write(json.dumps(dict(zip(names, (r[0], r[1], [{"start": a, "end": b, "text": t} for a, b, t in r[2]], *r[3:]), strict=True))) + "\n")
        os.utime(source / f"{n}.json", (1_000_000_000 + 10 * n,) * 2)  # files are taken in the order of their times
    stream = spark.readStream.schema(committer.UPDATES).option("maxFilesPerTrigger", 1).json(str(source))
    q = committer.commit_stream(stream).writeStream.format("memory").queryName("commits").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination(300)
    got = {}
    for r in spark.sql("select * from commits order by session, update_seq, end").collect():
        got[r.session] = got.get(r.session, "") + r.text
    assert {s: t.strip() for s, t in got.items()} == {s: t for s, (t, _) in replay(rows).items() if t}


def test_silent_sessions_end(spark, tmp_path):
    """A session without a final update commits its rest when its time is up, and nothing of it is remembered."""
    source = tmp_path / "in"
    source.mkdir()
    rows = random_rows()
    silent = {"s1", "s2", "s3"}
    rows = [(*r[:5], r[5] and r[0] not in silent, r[6]) for r in rows]
    names = ("session", "update_seq", "segments", "window_start", "now_total", "final", "lookback")
    got = []

    def batch(n, found, second):
        with (source / f"{n}.json").open("w") as f:
            for r in found:
                f.write(json.dumps(dict(zip(names, (r[0], r[1], [{"start": a, "end": b, "text": t} for a, b, t in r[2]], *r[3:]), strict=True)) | {"at": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}"}) + "\n")
        stream = spark.readStream.schema(committer.UPDATES + ", at timestamp").json(str(source))
        df = committer.commit_stream(stream, idle=60, event_time="at")
        df.writeStream.foreachBatch(lambda d, _: got.extend(d.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)

    for n in range(5):
        batch(n, [r for r in rows if r[1] == n], 10 * n)
    before = {r.session for r in got}
    batch(5, [("other", 0, [(0, 1, "z ")], 0, 1, True, 1.0)], 500)
    batch(6, [("another", 0, [(0, 1, "z ")], 0, 1, True, 1.0)], 1000)
    text = {}
    for r in sorted(got, key=lambda r: (r.session, r.update_seq, r.end)):
        text[r.session] = text.get(r.session, "") + r.text
    ended = replay([(*r[:5], r[5] or r[0] in silent and r[1] == max(x[1] for x in rows if x[0] == r[0]), r[6]) for r in rows])
    assert {s: t.strip() for s, t in text.items() if s not in ("other", "another")} == {s: t for s, (t, _) in ended.items() if t} and before
    left = {r.key.session for r in spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "committed").load().collect()}
    assert left <= {"other", "another"}


def chunk_results(rng, chunks):
    """One recording: overlapping windows whose segments often repeat at the edges."""
    rows, rate, said = [], 16_000, ["はい", "はい、お願いします", "きょうは天気です", "きょうわ天気です", "yes", "no"]
    for k in range(chunks):
        main = (25 * k * rate, 25 * (k + 1) * rate)
        raw = (max(0, main[0] - rate), main[1] + (rate if k < chunks - 1 else 0))
        segments, at = [], rng.choice([0.0, 0.3])
        while at < 27 and rng.random() < 0.93:
            long = rng.choice([0.4, 1.0, 3.0])
            segments.append((at, at + long, rng.choice(said), *(rng.choice([None, -0.2, -1.4, 0.5]) for _ in range(4))))
            at += long + rng.choice([0.0, 0.2, 6.0])
        rows.append((k, k == chunks - 1, *raw, *main, segments))
    return rows


def test_merge_stream_in_every_order(spark, tmp_path):
    """Recordings whose chunks come in all orders of four, in one batch or several, some twice: dispositions as in batch."""
    import itertools

    from pyspark.sql import functions as F

    from talkweave.operators import merge
    from talkweave.streaming import merging

    rng, source = random.Random(6), tmp_path / "in"
    source.mkdir()
    orders = list(itertools.permutations(range(4)))
    recordings = {f"r{k}": chunk_results(rng, 4) for k in range(len(orders))}
    names = ("chunk_idx", "is_last", "raw_start", "raw_end", "main_start", "main_end")
    parts = ("start", "end", "text", *merge.METRICS[:1], "no_speech_prob", "compression_ratio", "temperature")
    got, settled = [], []
    for step in range(4):
        with (source / f"{step}.json").open("w") as f:
            for (name, rows), order in zip(recordings.items(), orders, strict=True):
                for chunk in (order[step], order[0])[: 2 if step == 2 else 1]:
                    row = rows[chunk]
                    f.write(json.dumps({"recording_id": name} | dict(zip(names, row[:6], strict=True)) | {"segments": [dict(zip(parts, s, strict=True)) for s in row[6]]}) + "\n")
        stream = spark.readStream.schema(merging.CHUNKS).json(str(source))
        q = merging.disposition_stream(stream).writeStream.foreachBatch(lambda d, _: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        settled.append(len(got))
    chunks = spark.read.schema(merging.CHUNKS).json(str(source)).dropDuplicates(["recording_id", "chunk_idx"])
    segments = chunks.select("recording_id", "chunk_idx", F.posexplode("segments").alias("seq", "s")).select("recording_id", "chunk_idx", "seq", "s.*")
    expected = merge.dispositions(merge.placed(segments, chunks.drop("segments"))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, expected)) and len({r.disposition for r in expected}) == 4
    assert 0 < settled[0] < settled[1] < settled[3]  # recordings whose chunks come in order are given out at once
    assert spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "waiting").load().count() == 0
