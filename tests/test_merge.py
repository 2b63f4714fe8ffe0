"""Overlap merge: expected outcomes by case."""

import functools

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.operators import merge

A, B, W = (0, 26, 0, 25), (24, 51, 25, 50), (0, 30, 0, 30)
CASES = {
    "better": ([(A, 24.6, 25.2, "きょうわ天気です", -1.4, 0.62, 2.8), (B, 0.6, 1.2, "きょうは天気です", -0.2, 0.05, 1.2)], ["きょうは天気です"]),
    "contained": ([(W, 10.0, 10.2, "はい"), (W, 10.25, 10.9, "はい、お願いします")], ["はい", "はい、お願いします"]),
    "near_edge": ([(W, 0.05, 0.2, "はい"), (W, 0.25, 0.9, "はい、お願いします")], ["はい", "はい、お願いします"]),
    "center": ([(W, 10.0, 10.5, "きょうは天気です"), (W, 10.55, 11.1, "きょうも天気です")], ["きょうは天気です", "きょうも天気です"]),
    "across": ([(A, 24.4, 25.1, "きょうは天気です"), (B, 0.9, 1.6, "きょうも天気です")], ["きょうは天気です", "きょうも天気です"]),
    "raw_duration": ([(A, 24.95, 25.20, "abcdeX"), (B, 1.08, 1.30, "abcdeY")], ["abcdeX", "abcdeY"]),
    "no_similarity": ([(A, 24.50, 24.90, "こんにちは"), (A, 24.58, 24.98, "ありがとうございます")], ["こんにちは", "ありがとうございます"]),
    "repeat": ([(W, 1.0, 2.0, "yes"), (W, 2.4, 3.0, " yes ")], [" yes "]),
    "repeat_far": ([(W, 1.0, 2.0, "yes"), (W, 2.6, 3.0, "yes")], ["yes", "yes"]),
    "contained_overlap": ([(A, 24.7, 25.4, "はい"), (B, 0.7, 1.5, "はい、お願いします")], ["はい、お願いします"]),
    "null_metrics": ([(A, 24.6, 25.2, "abcdefgh", None, None, None), (B, 0.6, 1.2, "abcdefgX", -0.5, None, None)], ["abcdefgX"]),
    "outside": ([(A, 25.5, 25.9, "late")], []),
}


def run(spark, rows):
    windows = list(dict.fromkeys(r[0] for r in rows))
    segs = [("r", windows.index(r[0]), i, float(r[1]), float(r[2]), r[3], *(r[4:] if len(r) > 4 else (None, None, None)), None) for i, r in enumerate(rows)]
    s = spark.createDataFrame(segs, "recording_id string, chunk_idx int, seq int, start double, end double, text string, avg_logprob double, no_speech_prob double, compression_ratio double, temperature double")
    w = spark.createDataFrame([("r", i, *(x * 16_000 for x in v)) for i, v in enumerate(windows)], "recording_id string, chunk_idx int, raw_start long, raw_end long, main_start long, main_end long")
    return merge.dispositions(merge.placed(s, w)), s, w


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    rows, expected = CASES[case]
    disposed, _, _ = run(spark, rows)
    assert [r.text for r in disposed.where("kept").orderBy("start", "end").collect()] == expected


def test_counters_and_fallback(spark):
    disposed, _, w = run(spark, CASES["better"][0] + [(B, 27.5, 28.0, "outside")])
    total = merge.merge_counters(disposed).where("chunk_idx is null").first()
    assert (total.input, total.clipped, total.kept, total.skipped, total.replaced) == (3, 1, 1, 0, 1)
    parts = spark.createDataFrame([("r", 0, "so ", None, 0), ("r", 1, "long ", None, 0), ("q", 0, "", 0.0, 0)], "recording_id string, chunk_idx int, text string, duration double, n_segments int")
    out = {r.recording_id: r for r in merge.merged_results(disposed.where("false"), parts, w).collect()}
    assert (out["r"].text, out["r"].duration, out["r"].segments) == ("so long", 50.0, [])
    assert (out["q"].text, out["q"].duration) == ("", 0.0)


def test_zero_end_is_shifted_twice(spark):
    disposed, _, _ = run(spark, [(B, 2.0, 0.0, "x")])
    r = disposed.first()
    assert (r.start, r.end) == (26.0, 50.0)


def test_similarity():
    assert merge.similarity("abc", "abc") == 1 and merge.similarity("", "abc") == 0
    assert merge.similarity("abcd", "abXd") == 0.75


def test_walk_goes_on_over_batches(spark):
    """Recordings are walked in sorted batches, not in a call each, and their state passes from batch to batch."""
    cases = [c for c in CASES if c not in ("null_metrics",)]
    parts = [run(spark, CASES[c][0])[1:] for c in cases]
    segments, windows = (functools.reduce(DataFrame.unionByName, (p[i].withColumn("recording_id", F.lit(c)) for c, p in zip(cases, parts, strict=True))) for i in (0, 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        disposed = merge.dispositions(merge.placed(segments, windows))
        got = disposed.where("kept").orderBy("recording_id", "start", "end").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [[r.text for r in got if r.recording_id == c] for c in cases] == [CASES[c][1] for c in cases]
    assert "FlatMapGroups" not in disposed._jdf.queryExecution().toString()
