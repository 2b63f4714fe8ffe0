"""Voice activity, intervals and PCM against NumPy and Python versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.config import VadConfig
from talkweave.operators import intervals, vad
from talkweave.sources import pcm


def frames(spark, series):
    rows = [(str(k), i, float(v)) for k, values in enumerate(series) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "recording_id string, frame_idx int, energy double")


def by_key(df, value):
    out = {}
    for r in df.orderBy("recording_id", "frame_idx").collect():
        out.setdefault(int(r.recording_id), []).append(r[value])
    return out


def switched(values, on, off, start, end):
    """Hysteresis, one value at a time."""
    state, run, out = False, 0, []
    for v in values:
        run = run + 1 if (v <= min(off, on) if state else v >= on) else 0
        out.append(state)
        if run == (end if state else start):
            state, n, run = not state, run, 0
            out[-n:] = [state] * n
    return out


@pytest.mark.parametrize("on,off,start,end", [(0.5, 0.35, 2, 3), (0.6, 0.2, 1, 1), (0.4, 0.39, 3, 2)])
def test_hysteresis(spark, on, off, start, end):
    rng = random.Random(start)
    series = [[round(rng.random(), 2) for _ in range(rng.randint(1, 60))] for _ in range(60)]
    df = frames(spark, series)
    expected = {k: switched(v, on, off, start, end) for k, v in enumerate(series)}
    assert by_key(vad.hysteresis(df, "energy", F.lit(on), F.lit(off), start, end), "flag") == expected
    assert {k: list(vad.hysteresis_walk(np.array(v), on, off, start, end)) for k, v in enumerate(series)} == expected


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5])
def test_smoothing(spark, width):
    values = list(np.random.default_rng(0).random(40))
    got = by_key(vad.smoothed(frames(spark, [values]), "energy", width), "energy")[0]
    assert np.allclose(got, np.convolve(values, np.ones(width) / width, "same"))


def test_merge_and_runs(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for k in range(40):
        spans = sorted((s := rng.randint(0, 300), s + rng.randint(1, 40)) for _ in range(rng.randint(1, 12)))
        rows += [(k, *s) for s in spans]
        out = []
        for s, e in spans:
            if out and s - out[-1][1] <= 7:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        expected[k] = [tuple(x) for x in out]
    got = {}
    for r in intervals.merged(spark.createDataFrame(rows, "k int, s int, e int"), "k", "s", "e", 7).orderBy("k", "s").collect():
        got.setdefault(r.k, []).append((r.s, r.e))
    assert got == expected


def test_chunk_plan(spark):
    total = spark.createDataFrame([("a", 480_000), ("b", 900_000), ("c", 1)], "recording_id string, total long")
    speech = spark.createDataFrame([("a", 160_000, 176_000)], "recording_id string, start_sample long, end_sample long")
    got = [tuple(r) for r in intervals.chunk_plan(total, speech, 400_000, 16_000, 16_000).orderBy("recording_id", "chunk_idx").collect()]
    assert got == [("a", 0, 144_000, 192_000, 144_000, 192_000), ("b", 0, 0, 416_000, 0, 400_000), ("b", 1, 384_000, 816_000, 400_000, 800_000), ("b", 2, 784_000, 900_000, 800_000, 900_000), ("c", 0, 0, 1, 0, 1)]


def test_split(spark):
    df = spark.createDataFrame([(0, 10, 35)], "k int, s int, e int")
    assert [tuple(r)[1:] for r in intervals.split_long(df, "s", "e", 10).orderBy("s").collect()] == [(10, 20), (20, 30), (30, 35)]
    assert intervals.split_long(df, "s", "e", None).count() == 1


def test_projection_of_nulls(spark):
    f = spark.createDataFrame([("r", i) for i in range(6)], "recording_id string, frame_idx long")
    s = spark.createDataFrame([("r", 0.0, 2.0, None), ("r", 1.0, 3.5, 0.75), ("r", 5.0, 4.0, 0.0), ("r", float("nan"), 4.0, 0.0)], "recording_id string, start double, end double, no_speech_prob double")
    assert [r.probability for r in intervals.frame_probabilities(f, s, 1.0).orderBy("frame_idx").collect()] == [1.0, 1.0, 0.25, 0.25, 0.0, 0.0]


def tone(spans, seconds, rate):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 5, int(seconds * rate))
    for a, b in spans:
        n = np.arange(int(a * rate), int(b * rate))
        x[n] += 8000 * np.sin(2 * np.pi * 220 * n / rate)
    return x.astype("<i2").tobytes()


def recordings(spark):
    return spark.createDataFrame([("a", "a.wav", 16_000, tone([(1, 2), (2.1, 3), (5, 5.1), (6, 7)], 9, 16_000)), ("b", "b.wav", 8_000, tone([(1, 3)], 4, 8_000))], "recording_id string, filename string, sample_rate int, pcm binary")


def test_speech_segments(spark):
    recs = recordings(spark)
    sized = recs.select("recording_id", F.lit(16_000).alias("sample_rate"), F.rint(F.octet_length("pcm") / 2 * 16_000 / F.col("sample_rate")).cast("long").alias("total"))
    got = [(r.recording_id, r.seg_idx, round(r.start, 1), round(r.end, 1)) for r in vad.speech_segments(pcm.hop_sums(recs), sized).orderBy("recording_id", "seg_idx").collect()]
    assert [g[:2] for g in got] == [("a", 0), ("a", 1), ("b", 0)]
    for (_, _, s, e), (a, b) in zip(got, [(1, 3), (6, 7), (1, 3)], strict=True):
        assert abs(s - a) < 0.15 and abs(e - b) < 0.15


def test_fusion_overrules_energy(spark):
    recs = recordings(spark).where("recording_id = 'a'")
    sized = recs.select("recording_id", "sample_rate", (F.octet_length("pcm") / 2).cast("long").alias("total"))
    model = spark.createDataFrame([("a", 1.0, 3.0, 0.02)], "recording_id string, start double, end double, no_speech_prob double")
    got = vad.speech_segments(pcm.hop_sums(recs), sized, VadConfig(fusion=True, model="m"), model).collect()
    assert len(got) == 1 and abs(got[0].start - 1) < 0.2


def test_pcm(spark):
    half = (1000 * np.sin(np.linspace(0, np.pi, 1600))).astype("<i2").tobytes()
    rows = [("ok", 16_000, half), ("odd", 16_000, b"\0"), ("empty", 16_000, b""), ("null", 16_000, None), ("rate", 0, half)]
    good, bad = pcm.quarantine(spark.createDataFrame(rows, "recording_id string, sample_rate int, pcm binary"))
    assert [r.recording_id for r in good.collect()] == ["ok"]
    assert {r.recording_id: r.error_kind for r in bad.collect()} == {"odd": "invalid-length", "empty": "empty-input", "null": "empty-input", "rate": "invalid-sample-rate"}
    cut = pcm.sliced(good.withColumn("a", F.lit(0.02)).withColumn("b", F.lit(0.05)), "a", "b").first()
    assert bytes(cut.pcm) == half[640:1600] and cut.window.end_sample == 800
    loud = pcm.loudness(good).select(vad.silent(F.col("mean_abs"), F.col("max_abs"), F.col("n"))).first()[0]
    assert not loud
    assert len(pcm.resampled(np.zeros(800, np.float32), 8_000, 16_000)) == 1600
    assert pcm.mono(np.ones((4, 2))).shape == (4,) and pcm.mono(3.0).shape == (1,)
    with pytest.raises(ValueError):
        pcm.resampled(np.zeros(3), 0, 1)


def _odd_series():
    rng = random.Random(7)
    return [[round(rng.expovariate(0.02), 2) for _ in range(rng.randint(1, 90))] for _ in range(2000)]


def test_noise_quantile_to_the_last_bit(spark):
    """The noise level is the SQL engine's, bit for bit."""
    duckdb = pytest.importorskip("duckdb")
    df = frames(spark, _odd_series()).cache()
    con = duckdb.connect()
    con.execute("create table en (k varchar, energy double)")
    rows = df.select("recording_id", "energy").toPandas()
    con.execute("insert into en select recording_id, energy from rows")
    wanted = dict(con.execute("select k, quantile_cont(energy, 0.2) from en group by k").fetchall())
    assert {r.recording_id: r.quantile for r in vad.quantile(df, "energy", 0.2).collect()} == wanted
    odd = spark.createDataFrame([("a", None), ("b", None), ("b", 2.0)], "recording_id string, energy double")
    assert {tuple(r) for r in vad.quantile(odd, "energy", 0.2).collect()} == {("a", None, None), ("b", 2.0, 2.0)}


def test_values_at_the_threshold(spark):
    """Energies that equal 2.5 times the noise level: the speech begins where the SQL engine lets it begin."""
    duckdb = pytest.importorskip("duckdb")
    from talkweave.plans import catalog

    rng, rows = random.Random(3), []
    for k in range(3000):
        low = rng.randint(100, 4000)
        # in hundredths; of 8 or more values the second and third decide, at a rank of 1.4 or more
        n = rng.choice((8, 9, 10))
        high = low + 10 * rng.randint(1, 20)
        top = round((low + ((n - 1) % 5) / 5 * (high - low)) * 2.5)
        values = [1, low, high, *[top] * 2, *[9 * top] * (n - 5)]
        rows += [(str(k), i, v / 100) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "user_id string, frame_idx int, energy double")
    con = duckdb.connect()
    pdf = df.toPandas()
    con.execute("create table en as select * from pdf")
    wanted = {tuple(r) for r in con.execute(f"WITH {catalog._FLAGS} SELECT user_id, frame_idx, flag FROM fl").fetchall()}
    on = df.join(vad.thresholds(df, VadConfig(), "user_id"), "user_id")
    got = vad.hysteresis(on, "energy", F.col("on"), F.col("off"), 2, 3, "user_id").select("user_id", "frame_idx", "flag")
    assert {tuple(r) for r in got.collect()} == wanted
    spans = intervals.true_runs(got, "user_id", "frame_idx", "flag").select("user_id", "first", "last")
    runs = con.execute(f"WITH {catalog._FLAGS} SELECT user_id, min(frame_idx), max(frame_idx) FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY user_id ORDER BY frame_idx) AS g FROM fl WHERE flag) GROUP BY user_id, g").fetchall()
    assert {tuple(r) for r in spans.collect()} == {tuple(r) for r in runs}


def test_speech_segments_query_at_the_threshold(spark, tmp_path):
    """The whole query against its SQL, where users' energies meet 2.5 times their noise level: events of random order, each user's values dealt anew."""
    duckdb = pytest.importorskip("duckdb")
    from talkweave.plans import catalog

    rng, rows = random.Random(5), []
    for user in range(3000):
        low, n = rng.randint(100, 4000), rng.choice((8, 9, 10))
        high = low + 10 * rng.randint(1, 20)
        top = round((low + ((n - 1) % 5) / 5 * (high - low)) * 2.5)
        # the quiet ones first, then as many at the threshold as make a segment, then louder ones
        rows += [(user, second, v / 100) for second, v in enumerate([1, low, high, *[top] * 2, *[9 * top] * (n - 5)])]
    rng.shuffle(rows)
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, second int, value double")
    events = events.select("event_id", F.timestamp_seconds(F.col("second") + 1_700_000_000).alias("ts"), "user_id", F.lit("view").alias("event_type"), "value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    wanted = con.execute(catalog.ORACLES["speech_segments"]).fetchall()
    got = catalog.QUERIES["speech_segments"](spark, str(tmp_path)).collect()
    assert len(wanted) > 1000 and sorted(tuple(r) for r in got) == sorted(wanted)
