"""Quality, knowledge base, timeline, evaluation, screens, sources and the whole path."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave import config, schemas
from talkweave.config import ChunkConfig
from talkweave.operators import evaluation, knowledge, quality, screens, timeline, transcription
from talkweave.sources import files, snapshots, videos


def test_config():
    env = {"ASR_SILENCE_THRESHOLD": "-1", "ASR_FLAG_AVG_LOGPROB": "x", "ASR_HALLUCINATION_PHRASES": "a, b", "ASR_VAD_FUSION": "yes", "ASR_VAD_BOUNDARY_MARGIN_SECONDS": "0.25", "ASR_OVERLAP_SECONDS": "99"}
    q = config.QualityConfig.from_env(env)
    assert (q.silence_threshold, q.flag_logprob, q.phrases) == (1e-3, -1.0, ("a", "b"))
    assert not config.VadConfig.from_env(env).fusion and config.VadConfig.from_env({**env, "ASR_VAD_TRANSFORMER_MODEL": "m"}).fusion
    c = ChunkConfig.from_env(env)
    assert (c.overlap, c.margin, ChunkConfig().margin, ChunkConfig(chunk_seconds=0).overlap) == (12.5, 0.25, 1.0, 0.0)
    assert config.filler_enabled(" Final ") and not config.filler_enabled(None)
    assert config.RequestConfig().resolved("", None) == ("whisper-large-v3", "ja")


SEG = "k string, n int, text string, avg_logprob double, no_speech_prob double, compression_ratio double"


def force(m, text):
    """F5, in order."""
    lp, ns, cr = ([x[i] for x in m if x[i] is not None] for i in range(3))
    if not text.strip() or not m:
        return False
    both = bool(cr and lp and max(cr) >= 2.4 and min(lp) <= -1)
    if "ご視聴ありがとうございました" in text and (ns and max(ns) >= 0.6 or both):
        return True
    if not ns:
        return False
    return max(ns) >= 0.85 or sum(ns) / len(ns) >= 0.75 or both


def test_forced_silence(spark):
    rows, expected, k = [], {}, 0
    for lp in (None, -0.5, -1.0):
        for ns in (None, 0.6, 0.8, 0.85):
            for cr in (None, 1.0, 2.4):
                for text in ("ok", "ご視聴ありがとうございました", " "):
                    m = [(lp, ns, cr), (None, 0.1 if ns else None, None)]
                    rows += [(str(k), i, text if i == 0 else "", *x) for i, x in enumerate(m)]
                    expected[str(k)] = force(m, text)
                    k += 1
    got = {r.k: r.forced_silence for r in quality.diagnostics(spark.createDataFrame(rows, SEG), "k", "n").collect()}
    assert got == expected


def test_flags_and_metrics(spark):
    rows = [("a", i, t, -2.0 if i == 0 else None, None, None) for i, t in enumerate(["x", " x ", "", "x"])] + [("b", 0, "fine", None, None, None)]
    got = {r.k: r for r in quality.diagnostics(spark.createDataFrame(rows, SEG), "k", "n").collect()}
    assert got["a"].flags == ["repeat_segments", "low_confidence_segments"] and got["b"].flags == []
    assert (got["b"].max_no_speech, got["b"].min_logprob, got["b"].flagged) == (0.0, 0.0, 0)
    assert quality.flagged_segments(spark.createDataFrame(rows, SEG)).first().reasons == ["low_logprob"]


def test_retry(spark):
    loop = "foo bar " * 4
    rows = [("one", 1, None, loop), ("kept", 1, False, loop), ("fixed", 1, None, loop), ("fixed", 2, False, "good"), ("lost", 1, None, loop), ("lost", 2, False, loop), ("garble", 1, None, "ababababab"), ("fine", 1, None, "good")]
    df = spark.createDataFrame(rows, "k string, attempt_no int, condition boolean, text string").withColumn("repeated", F.lit(False)).withColumn("forced", F.lit(False))
    got = {r.k: (r.decision, r.text) for r in quality.retry_decision(df, ["k"]).collect()}
    assert got == {"one": ("retry", None), "kept": ("keep", loop), "fixed": ("keep", "good"), "lost": ("silence", ""), "garble": ("silence", ""), "fine": ("keep", "good")}


def fingerprint(text):
    votes = [0] * 64
    for t in text.lower().split() or [text]:
        v = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        votes = [n + (1 if v >> i & 1 else -1) for i, n in enumerate(votes)]
    return f"{sum(1 << i for i, n in enumerate(votes) if n >= 0):016x}"


def test_simhash(spark):
    texts = ["", "   ", "a a b", "x y", "The quick　brown\nfox", "a"]
    got = dict(knowledge.simhash(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect())
    assert got == {i: fingerprint(t) for i, t in enumerate(texts)}


def test_minhash(spark):
    rows = [(0, "a b c d e f g h"), (1, "h g f e d c b a"), (2, "p q r s t u v w")]
    sig = {r.i: r.signature for r in knowledge.minhash(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}
    assert sig[0] == sig[1] and len(sig[0]) == 128 and not set(sig[0]) & set(sig[2])


def test_split_text():
    text = "\n\n".join("Sentence number one. " * 9 for _ in range(9)) + "x" * 3000
    pieces = knowledge.split_text(text, 200)
    assert max(map(len, pieces)) <= 200
    assert "".join("".join(p.split()) for p in pieces) == "".join(text.split())
    assert knowledge.split_text("short") == ["short"] and knowledge.split_text(" \n ") == []


def test_ingest(spark, tmp_path):
    for name, body in {"a.txt": "one text", "b.MD": "one text", "sub/c.html": "<p>Hi <b>you</b></p>", "d.pdf": "%", "e.png": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    loaded = files.loaded(files.discovered(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 1)[1]: r.text for r in loaded.where("error is null").collect()} == {"a.txt": "one text", "b.MD": "one text", "c.html": "Hi you"}
    notes, units, stats, errors = knowledge.ingest(loaded)
    r = stats.first()
    assert (r.discovered, r.created, units.count(), r.skipped, r.failed) == (4, 2, 2, 1, 1)
    assert [e.path.rsplit("/", 1)[1] for e in errors.collect()] == ["d.pdf"]
    assert {n.title for n in notes.collect()} == {"a", "c"}
    assert knowledge.ingest(loaded, notes.select("hash"))[2].first().created == 0
    kept = snapshots.Snapshots(spark, str(tmp_path / "kb"))
    assert kept.commit({"notes": notes.drop("created_at"), "units": units}) == 1 and kept.read("notes").count() == 2
    assert files.discovered(spark, str(tmp_path / "none")).count() == 0
    assert files.loaded(files.discovered(spark, str(tmp_path)), lambda b: "pages").where("text = 'pages'").count() == 1


def test_orphans(spark):
    notes = spark.createDataFrame([(1,)], "id long")
    units = spark.createDataFrame([(10, 1, None), (11, 1, 99), (12, 2, None), (13, 1, 10)], "id long, note_id long, parent_id long")
    assert {(r.id, r.parent_id) for r in knowledge.without_orphans(units, notes).collect()} == {(10, None), (11, None), (13, 10)}
    assert set(schemas.KNOWLEDGE_BASE) == {"notes", "units", "entities", "relations", "tags", "unit_tags"}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    left = [(int(k), float(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 80), rng.integers(0, 50, 80), strict=True))]
    right = [(int(k), float(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 30), rng.integers(0, 50, 30), strict=True))]
    got = {r.i: r.v2 for r in timeline.nearest(spark.createDataFrame(left, "k int, t double, i int"), spark.createDataFrame(right, "k int, t double, v int"), "k", "t", "v", "v2").collect()}
    assert got == {i: min(((abs(t - u), v) for k2, u, v in right if k2 == k), default=(0, None))[1] for k, t, i in left}


def test_meeting(spark):
    said = spark.createDataFrame([("m", 0, 0.0, 2.0, "hello\nthere"), ("m", 1, 70.0, 72.0, "bye"), ("p", 0, 0.0, 1.0, "plain")], "recording_id string, seq int, start double, end double, text string")
    spoken = spark.createDataFrame([("m", 0, 0.0, 2.0, "hello\nthere", "Ann"), ("m", 1, 70.0, 72.0, "bye", None)], "recording_id string, seq int, start double, end double, text string, speaker string")
    shown = spark.createDataFrame([("m", 0, 1.0, 0, "Slack"), ("m", 9, 60.0, 1, "Zoom")], "recording_id string, frame_index int, timestamp double, context_index int, label string")
    u = timeline.utterances(said, shown, spoken)
    assert {(r.recording_id, r.seq, r.image_context_index) for r in u.collect()} == {("m", 0, 0), ("m", 1, 1), ("p", 0, None)}
    names = spark.createDataFrame([("m", "f.wav", ["Ann"]), ("p", "g.wav", [])], "recording_id string, filename string, speakers array<string>")
    maps = {r.recording_id: r.mindmap for r in timeline.mindmap(u, shown, names).collect()}
    assert maps["m"].splitlines() == ["mindmap", "  f.wav", "    Speakers", "      Ann", "    Screens", "      00: Slack", "      01: Zoom", "    Transcript", "      [00:00-00:02] Ann: hello there", "        screen: Slack", "      [01:10-01:12] bye", "        screen: Zoom"]
    assert maps["p"].splitlines() == ["mindmap", "  g.wav", "    Transcript", "      [00:00-00:01] plain"]


def test_key_terms(spark, tmp_path):
    rows = [{"id": "a", "audio_path": "x.wav", "key_terms": ["API", "C++", "天気", "api", "API"]}, {"id": "b", "audio_path": "/y.wav", "key_terms": None}, {"id": "c", "audio_path": "z.wav", "key_terms": [" ", ""]}]
    (tmp_path / "s.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows))
    samples = files.key_term_samples(spark, str(tmp_path / "s.jsonl"), "/base")
    assert {r.id: r.audio_path for r in samples.collect()} == {"a": "/base/x.wav", "b": "/y.wav", "c": "/base/z.wav"}
    said = spark.createDataFrame([("a", "the API  in C++"), ("b", "x"), ("c", "")], "id string, transcript string")
    got = evaluation.evaluated(samples, said)
    assert {r.id: round(r.accuracy, 3) for r in got.collect()} == {"a": 0.6, "b": 1.0, "c": 1.0}
    assert evaluation.average(got).first().samples == 3 and not evaluation.average(got.where("false")).collect()


def test_payloads(spark):
    df = spark.createDataFrame([("/in/a.wav", json.dumps({"text": "t", "junk": 1, "segments": [{"id": 0, "start": 0, "end": 1.5, "text": "t", "tokens": [1]}]}))], "source string, payload string")
    r = files.results(df).first()
    assert (r.filename, r.text, r.segments[0].end, r.segments[0].avg_logprob) == ("a.wav", "t", 1.5, None)
    assert json.loads(files.results(df).select(files.response(["filename", "text"]).alias("j")).first().j) == [{"filename": "a.wav", "text": "t"}]


def fake_service():
    def service(endpoint, params):
        ids = [f"v{i}" for i in range(120)]
        if endpoint == "channels":
            return {"items": [{"id": "ch", "contentDetails": {"relatedPlaylists": {"uploads": "up"}}}]} if params.get("forHandle", "me") == "me" else {"items": []}
        if endpoint == "playlistItems":
            at = int(params.get("pageToken", 0))
            return {"items": [{"contentDetails": {"videoId": v}} for v in ids[at : at + 50]], **({"nextPageToken": str(at + 50)} if at + 50 < len(ids) else {})}
        return {"items": [{"id": v, "snippet": {"title": f"T {v}", "description": "d"}} for v in params["id"].split(",")]}

    return service


def test_videos(spark, tmp_path):
    service = fake_service()
    got = videos.descriptions(spark, service, handle="@me")
    assert got.count() == 120 and got.where("video_id = 'v119'").first().title == "T v119"
    videos.save_json(got, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).count() == 120
    with pytest.raises(LookupError):
        videos.descriptions(spark, service, handle="@you")
    with pytest.raises(ValueError):
        videos.descriptions(spark, service)


def picture(color, size=16):
    return np.full((size, size, 3), color, np.uint8).tobytes()


def test_screens(spark):
    colors = [(255, 0, 0)] * 3 + [(0, 255, 0)] * 3 + [(0, 250, 0)] * 3
    rows = [("v", i, i / 2.0, picture(c), 16, 16) for i, c in enumerate(colors)]
    df = spark.createDataFrame(rows, screens.FRAMES)
    assert [r.idx for r in screens.key_frames(df, fps=2, min_span=1).orderBy("idx").collect()] == [0, 3]
    assert screens.key_frames(df, fps=2, max_frames=0).count() == 0 and screens.key_frames(df, fps=2, max_frames=1).count() == 1
    r = screens.video_contexts(df, lambda x, language: "Zoom call" if language == "eng" else "", fps=2).orderBy("frame_index").first()
    assert (r.label, r.ocr_text, r.dominant_colors[0], r.edge_density, r.hash) == ("Zoom", "Zoom call", "red-ish", 0.0, "0" * 16)
    half = np.zeros((16, 16, 3), np.uint8)
    half[:, 8:] = 255
    assert screens.average_hash(half) == "0f" * 8 and screens.edge_density(half) > 0
    assert {min(c) > 200 for c in screens.dominant_colors(half)} == {True, False}


def test_transcription(spark):
    rate = 16_000
    n = np.arange(rate * 40)
    loud = np.where((n // rate) % 10 < 8, 8000 * np.sin(n / 7), 0).astype("<i2").tobytes()
    rows = [("long", rate, loud), ("short", rate, loud[: rate * 4]), ("quiet", rate, b"\0\0" * rate * 30)]
    recs = spark.createDataFrame(rows, "recording_id string, sample_rate int, pcm binary")

    def recognize(wave, language, condition):
        text = "stuck stuck " * 5 if condition and len(wave) < 3 * 16_000 else f"えーと、heard {len(wave) // 16_000} "
        return {"text": text, "segments": [{"start": 0.0, "end": len(wave) / 16_000, "text": text, "avg_logprob": -0.2, "no_speech_prob": 0.1, "compression_ratio": 1.1}]}

    got = {r.recording_id: r for r in transcription.transcribed(recs, recognize, remove_fillers=True).collect()}
    assert (got["quiet"].text, got["quiet"].duration, got["quiet"].segments) == ("", 0.0, [])
    assert got["short"].text == "heard 2" and got["short"].duration == 2.0 and got["short"].flags == []
    assert got["long"].text.startswith("heard") and "えーと" not in got["long"].text


def test_discard(spark):
    import os

    from talkweave import session

    folder = session.new_folder(spark, "some").removeprefix("file://")
    os.makedirs(folder)
    kept = session.materialized(spark.range(3))
    assert kept.count() == 3
    session.discard(spark)
    assert not os.path.exists(folder) and session.materialized(spark.range(4)).count() == 4
