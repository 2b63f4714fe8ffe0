"""Uploads as tables and as streams."""

import json
import random
import time

import numpy as np

from talkweave.functions import text as T
from talkweave.sources import pcm, uploads


def wave(n):
    return (np.arange(n) % 100).astype("<i2").tobytes()


def test_upload_table(spark, tmp_path):
    (tmp_path / "a.pcm").write_bytes(wave(300))
    (tmp_path / "b.pcm").write_bytes(wave(301)[:-1])
    (tmp_path / "a.json").write_text(json.dumps({"recording_id": "a", "sample_rate": 16000, "language": "en", "prompt_agenda": "x, y", "unknown": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"recording_id": "b", "sample_rate": 8000, "window_start_seconds": 0.01, "window_end_seconds": 0.02}))
    got = {r.recording_id: r for r in uploads.requests(uploads.recordings(spark, str(tmp_path))).collect()}
    assert bytes(got["a"].pcm) == wave(300) and got["a"].initial_prompt == f"{T.STYLE['en']} 議題: x, y" and got["b"].initial_prompt == T.STYLE["ja"]
    good, bad = pcm.quarantine(uploads.recordings(spark, str(tmp_path)))
    assert [r.recording_id for r in good.collect()] == ["a"] and [r.error_kind for r in bad.collect()] == ["invalid-length"]
    cut = pcm.sliced(uploads.recordings(spark, str(tmp_path)).where("recording_id = 'b'"), "window_start_seconds", "window_end_seconds").first()
    assert bytes(cut.pcm) == wave(301)[160:320]


def run(stream, folder, mode="append"):
    """Rows of all batches that are there now."""
    rows = []
    stream.writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start().awaitTermination(120)
    return rows


def test_upload_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcm").write_bytes(wave(100))
    (tmp_path / "in" / "a.json").write_text("{}")
    assert [r.recording_id for r in run(uploads.recordings(spark, str(tmp_path / "in"), stream=True), tmp_path / "c1")] == ["a"]
    (tmp_path / "in" / "b.pcm").write_bytes(wave(50))
    again = run(uploads.recordings(spark, str(tmp_path / "in"), stream=True), tmp_path / "c1")
    assert [(r.recording_id, bytes(r.pcm)) for r in again] == [("b", wave(50))]


def test_updates_to_commits(spark, tmp_path):
    """Window updates from files, through the stateful committer."""
    from talkweave.streaming import committer

    (tmp_path / "in").mkdir()
    for n, (segments, now, final) in enumerate([([(0, 1, "A"), (1, 2, "B")], 2.5, False), ([(1, 2, "B"), (2, 3, "C")], 3.0, True)]):
        row = {"session": "s", "update_seq": n, "segments": [{"start": a, "end": b, "text": t} for a, b, t in segments], "window_start": 0.0, "now_total": now, "final": final, "lookback": 1.0}
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(row))
        got = run(committer.commit_stream(uploads.updates(spark, str(tmp_path / "in"))), tmp_path / "c", "update")
        assert "".join(r.text for r in sorted(got, key=lambda r: r.start)) == ("A" if n == 0 else "BC")


def halves(folder, name, rate=16000):
    (folder / f"{name}.pcm").write_bytes(wave(10 + len(name)))
    return json.dumps({"recording_id": name, "sample_rate": rate, "prompt_agenda": f"agenda {name}"})


def test_upload_stream_equals_table_in_any_order(spark, tmp_path):
    rng, source = random.Random(4), tmp_path / "in"
    source.mkdir()
    store = tmp_path / "store"
    store.mkdir()
    files = []
    for k in range(12):
        (store / f"u{k}.json").write_text(halves(store, f"u{k}", 8000 + k))
        files += [f"u{k}.json", f"u{k}.pcm"]
    rng.shuffle(files)
    got = []
    for at in range(0, len(files), 6):
        for f in files[at : at + 6]:
            (source / f).write_bytes((store / f).read_bytes())
        got += run(uploads.upload_stream(spark, str(source)), tmp_path / "c")
    table = uploads.recordings(spark, str(source)).collect()
    assert sorted(map(repr, ((r.recording_id, bytes(r.pcm), r.sample_rate, r.prompt_agenda, r.language) for r in table))) == sorted(map(repr, ((r.recording_id, bytes(r.pcm), r.sample_rate, r.prompt_agenda, r.language) for r in got)))
    assert len(got) == 12 and all(r.error_kind is None for r in got)


def test_halves_that_stay_alone(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def batch(*names, to="c", remember=600.0):
        for n in names:
            (source / n).write_bytes(fields[n[:-5]].encode() if n.endswith("json") else wave(20))
        time.sleep(1.2)
        return {(r.recording_id, r.error_kind) for r in run(uploads.upload_stream(spark, str(source), wait=1.0, remember=remember), tmp_path / to)}

    def remembered(state, to="c"):
        return {r.key.recording_id for r in spark.read.format("statestore").option("path", str(tmp_path / to)).option("stateVarName", state).load().collect()}

    fields = {n: json.dumps({"recording_id": n, "sample_rate": 1}) for n in "abxyz"}
    fields["b"] = "{ damaged"
    assert batch("a.pcm", "b.json") | batch("x.json", "x.pcm") | batch("y.json", "y.pcm") == {("a", "missing-fields"), ("b", "missing-audio"), ("x", None), ("y", None)}
    late = batch("a.json") | batch("z.pcm", "z.json")
    assert late == {("a", "late-fields"), ("z", None)} and not remembered("half")
    # once time has passed, nothing but the latest uploads is remembered
    batch(to="d", remember=0.1)
    for n in "pqr":
        fields[n] = json.dumps({"recording_id": n})
        batch(f"{n}.pcm", f"{n}.json", to="d", remember=0.1)
    assert not remembered("half", "d") and remembered("outcome", "d") <= {"q", "r"}
