"""Settings, request inputs and failures that fall back."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signal import by_key, frames, switched

from talkweave import config
from talkweave.functions import text as T
from talkweave.operators import intervals, knowledge, transcription, vad
from talkweave.sources import pcm


def test_vad_settings():
    env = {"ASR_VAD_MODE": " Hybrid ", "ASR_VAD_TRANSFORMER_MODEL": "m", "ASR_VAD_FUSION_WEIGHT_ENERGY": "0.3", "ASR_VAD_FUSION_WEIGHT_TRANSFORMER": "0.9", "ASR_VAD_FUSION_ON": "0.7", "ASR_VAD_FUSION_OFF": "x", "ASR_VAD_FUSION_GATE": "0.2", "ASR_VAD_FUSION_SMOOTHING_FRAMES": "7.9"}
    c = config.VadConfig.from_env(env)
    assert (c.fusion, c.model, c.energy_weight, c.model_weight, c.fusion_on, c.fusion_off, c.fusion_gate, c.fusion_smoothing_frames) == (True, "m", 0.3, 0.9, 0.7, 0.4, 0.2, 7)
    for mode in ("fused", "fusion"):
        assert config.VadConfig.from_env({"ASR_VAD_MODE": mode, "ASR_VAD_TRANSFORMER_MODEL": "m"}).fusion
    assert config.VadConfig.from_env({**env, "ASR_VAD_TRANSFORMER_MODEL": " "}) == config.VadConfig()
    assert config.VadConfig.from_env({"ASR_VAD_TRANSFORMER_MODEL": "m"}) == config.VadConfig()
    assert config.VadConfig.from_env({**env, "ASR_VAD_FUSION_SMOOTHING_FRAMES": "-1"}).fusion_smoothing_frames is None
    style = lambda **e: config.RequestConfig.from_env(e).default_style
    assert style() and style(ASR_DEFAULT_STYLE_PROMPT="yes") and not style(ASR_DEFAULT_STYLE_PROMPT="") and not style(ASR_DEFAULT_STYLE_PROMPT="0")


def test_request_prompt(spark):
    rows = [("ja", None, None, None), ("en-US", " ", ",", None), ("en", "plan, budget", None, None), ("ja", None, "a/b", "My style"), ("en", None, " / ", None), (None, "x", None, " ")]
    df = spark.createDataFrame(rows, "language string, agenda string, terms string, style string")
    said = lambda on: [r[0] for r in df.select(T.request_prompt(F.col("language"), on, F.col("style"), agenda=F.col("agenda"), terms=F.col("terms"))).collect()]
    ja, en = T.STYLE["ja"], T.STYLE["en"]
    assert said(True) == [ja, en, f"{en} 議題: plan, budget", "My style 重要語彙: a, b", en, f"{ja} 議題: x"]
    assert said(False) == [None, None, f"{en} 議題: plan, budget", "My style 重要語彙: a, b", None, f"{ja} 議題: x"]


@pytest.mark.parametrize("on,off", [(0.5, 0.5), (0.5, 0.9), (0.4, 0.3)])
def test_hysteresis_on_odd_values(spark, on, off):
    rng = random.Random(3)
    pick = lambda: rng.choice([0.0, 0.3, 0.4, 0.5, 0.5, 0.5, 0.9, math.nan, math.inf, -math.inf, None])
    series = [[pick() for _ in range(rng.randint(1, 40))] for _ in range(40)]
    rows = [(str(k), i, v) for k, values in enumerate(series) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "recording_id string, frame_idx int, energy double")
    plain = [[v if v is not None and math.isfinite(v) else 0.0 for v in values] for values in series]
    got = by_key(vad.hysteresis(df, "energy", F.lit(on), F.lit(off), 2, 3), "flag")
    assert got == {k: switched(v, on, off, 2, 3) for k, v in enumerate(plain)}


def test_frame_probabilities_of_odd_segments(spark):
    segs = [("0", 0.0, 1.0, math.nan), ("0", 2.0, math.inf, 0.1), ("0", math.nan, 3.0, 0.1), ("0", 4.0, 3.0, 0.1), ("0", 5.0, 1e9, 0.25), ("0", -2.0, 0.5, 0.4)]
    got = intervals.frame_probabilities(frames(spark, [[0] * 7]), spark.createDataFrame(segs, "recording_id string, start double, end double, no_speech_prob double"), 1.0)
    assert by_key(got, "probability") == {0: [1.0, 0.0, 0.0, 0.0, 0.0, 0.75, 0.75]}


def test_bad_recordings_are_tiled(spark):
    """One that can't be decoded doesn't stop the others."""
    wave = (np.sin(np.arange(16_000 * 30) / 9) * 9000).astype("<i2").tobytes()
    rows = [("good", 16_000, wave), ("odd", 16_000, wave + b"x"), ("none", 16_000, None)]
    df = spark.createDataFrame(rows, "recording_id string, sample_rate int, pcm binary")
    assert {r.recording_id for r in pcm.hop_sums(df).select("recording_id").distinct().collect()} == {"good"}
    plan = transcription.planned(df.where("pcm is not null"), config.ChunkConfig(chunk_seconds=10.0, overlap_seconds=1.0)).collect()
    tiles = [(r.raw_start, r.raw_end) for r in sorted(plan, key=lambda r: r.chunk_idx) if r.recording_id == "odd"]
    assert [a // 16_000 for a, _ in tiles] == [0, 9, 19] and tiles[-1][1] == 480_000


def test_model_segments(spark):
    wave = lambda n: np.full(n, 1000, "<i2").tobytes()
    df = spark.createDataFrame([("a", 16_000, wave(16_000)), ("b", 16_000, wave(8000)), ("c", 16_000, wave(100))], "recording_id string, sample_rate int, pcm binary")

    def model(x):
        if len(x) == 8000:
            raise RuntimeError("no model")
        return {"segments": [{"start": 0, "end": 0.5, "no_speech_prob": 0.25}, {"start": None, "end": 1}, "junk"]} if len(x) == 16_000 else {}

    got = vad.model_segments(df, model).collect()
    assert sorted((r.recording_id, r.start, r.end, r.no_speech_prob) for r in got if r.no_speech_prob) == [("a", 0.0, 0.5, 0.25)]
    assert {r.recording_id for r in got} == {"a", "c"} and vad.model_segments(df, None).count() == 0


def test_intervals_meet_by_cell(spark):
    rng = random.Random(1)
    side = lambda n: [(rng.choice("ab"), k, a, a + rng.choice([0.0, 1.0, 7.0, 130.0])) for k in range(n) for a in [rng.randint(0, 300) / 1.0]]
    left, right = side(60), side(40)
    l_df = spark.createDataFrame(left, "k string, i int, start double, end double")
    r_df = spark.createDataFrame(right, "k string, j int, s double, e double")
    got = [(r.i, r.j) for r in intervals.beside(l_df, r_df, ["k"], F.col("start"), F.col("end"), F.col("s"), F.col("e"), 10.0).where("end >= s and start <= e").collect()]
    assert sorted(got) == sorted((i, j) for k, i, a, b in left for m, j, c, d in right if k == m and b >= c and a <= d)


def test_bm25_in_blocks(spark, monkeypatch):
    """Against the formula, with many blocks of documents and of queries."""
    import math
    import random

    monkeypatch.setattr(knowledge, "POSTINGS_AT_ONCE", 50)
    monkeypatch.setattr(knowledge, "QUERIES_AT_ONCE", 3)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghijkl") * 2 for _ in range(n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(60)] + [(100, None), (101, "zz zz"), (102, "zz zz")]
    queries = [(i, text(rng.randint(1, 5))) for i in range(8)] + [(50, "zz zz"), (51, "nothing"), (52, None)]
    got = knowledge.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), 3).collect()
    words = {i: (t or "").split() or [""] for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = lambda t: sum(t in w for w in words.values())
    idf = lambda t: math.log(1 + (len(words) - df(t) + 0.5) / (df(t) + 0.5))
    expected = set()
    for q, t in queries:
        score = {}
        for i, w in words.items():
            s = sum(idf(x) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set((t or "").split()) if x in w)
            if s > 0:
                score[i] = round(s, 9)
        expected |= {(q, i, n + 1, round(score[i], 6)) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:3])}
    assert {(r.query_id, r.doc_id, r["rank"], round(r.score, 6)) for r in got if r.query_id != 52} == expected
