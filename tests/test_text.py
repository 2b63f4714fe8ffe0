"""Text functions against small Python versions written from their meaning."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkweave.functions import scalars
from talkweave.functions import text as T

QUIET = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def ends_in_repeat(t, lengths, times):
    return any(len(t) >= u * times and t.endswith(t[len(t) - u :] * times) for u in lengths)


def bare(t):
    return re.sub("[\n\r ]", "", t)


unit = st.tuples(st.text("ab あ😀", max_size=6), st.text("xyあ😀 ", min_size=1, max_size=34), st.integers(0, 6), st.sampled_from(["", "\n", " "])).map(lambda p: p[0] + p[1] * p[2] + p[3])


@QUIET
@given(st.lists(unit, min_size=60, max_size=80))
def test_repeats(spark, values):
    got = column(spark, values, T.repeated_tail)
    assert got == [ends_in_repeat(bare(v), range(6, 31), 3) or ends_in_repeat(bare(v), range(1, 4), 5) for v in values]
    got = column(spark, values, T.garbled)
    assert got == [len(bare(v)) >= 5 and len(set(bare(v))) <= 2 and ends_in_repeat(bare(v), range(1, 4), 5) for v in values]


FILLER = "(?:え[ー〜]*っと|え[ー〜]*と|うーん|あの|[んン][ー〜]+|[あア][ー〜]+|[えエ][ー〜]+)"


def no_fillers(t):
    lead = t[: len(t) - len(t.lstrip())]
    body = t.lstrip()
    while m := re.match(rf"^{FILLER}(?:[、,。\s…ー〜]+|$)(.*)$", body):
        body = m[1]
    body = re.sub(rf"(^|[、。,\s]){FILLER}($|[、。,\s])", r"\1\2", body)
    body = re.sub(r"\s{2,}", " ", re.sub("[、,]{2,}", "、", body))
    out = lead + body
    return "" if re.match(r"^[\s、。,.!?…ー〜]*$", out) else out


piece = st.sampled_from(["えーと", "えっと", "うーん", "あの", "んー", "あー", "エー", "、", "。", ",", " ", "　", "…", "ー", "人", "天気", "、", " "])


@QUIET
@given(st.lists(st.lists(piece, max_size=9).map("".join), min_size=80, max_size=100))
def test_fillers(spark, values):
    assert column(spark, values, T.without_fillers) == [no_fillers(v) for v in values]


def test_terms(spark):
    rows = [("the API works", "API"), ("the APIs work", "API"), ("今日の天気です", "天気"), ("uses C++ a lot", "C++"), ("api", "API"), ("new york city", "new york")]
    df = spark.createDataFrame(rows, "said string, term string")
    assert [r[0] for r in df.select(T.term_hit(F.col("said"), F.col("term"))).collect()] == [True, False, True, True, False, True]


def test_prompts(spark):
    assert column(spark, ["a, b /c\n\n d", None, " , ", "x、y"], T.prompt_items) == [["a", "b", "c", "d"], [], [], ["x、y"]]
    long = "あ" * 500 + "。" + "い" * 300 + "、" + "う" * 300
    assert column(spark, [long, "short"], T.truncated_prompt) == ["あ" * 500 + "。" + "い" * 300 + "、", "short"]
    assert column(spark, ["en-US", "ja_JP", None, "  ", "fr"], T.language_key) == ["en", "ja", "ja", "ja", "fr"]
    df = spark.createDataFrame([(["p"], [], ["a", "b"])], "products array<string>, agenda array<string>, terms array<string>")
    got = df.select(T.initial_prompt(F.lit(" s "), products=F.col("products"), agenda=F.col("agenda"), terms=F.col("terms"))).first()[0]
    assert got == "s 製品・サービス: p 重要語彙: a, b"


def test_screens(spark):
    assert column(spark, ["Google Slides in Chrome, alpha beta99 gamma alpha"], T.screen_keywords) == [["Google Slides", "Slides", "Chrome", "alpha", "gamma", "google"]]
    df = spark.createDataFrame([(["a", "b", "c"], "x", 1), ([], "line one\nline two", 2), ([], "", 3)], "tags array<string>, ocr string, n int")
    assert [r[0] for r in df.select(T.screen_label(F.col("tags"), F.col("ocr"), F.col("n"))).collect()] == ["a, b", "line one", "frame#3"]


def test_names(spark):
    assert column(spark, ["/a/b.c.txt", "x", "/a/.env"], T.base_name) == ["b.c.txt", "x", ".env"]
    assert column(spark, ["/a/b.c.txt", "x", "/a/.env"], T.stem) == ["b.c", "x", ".env"]
    assert column(spark, ["@@a", "b"], T.bare_handle) == ["a", "b"]


def test_window_bounds(spark):
    cases = [(48_000, 16_000, None, None), (30, 10, -1.0, 10.0), (30, 10, 2.5, 1.0), (10, 0, None, None), (30, 10, float("nan"), float("inf"))]
    df = spark.createDataFrame(cases, "n long, rate int, a double, b double")
    got = [r[0] for r in df.select(scalars.window_bounds(*(F.col(c) for c in ("n", "rate", "a", "b")))).collect()]
    assert [g and (g.start_seconds, g.end_seconds, g.end_sample - g.start_sample) for g in got] == [(0, 3, 48_000), (0, 3, 30), (2.5, 2.5, 0), None, (0, 3, 30)]


def test_scalars(spark):
    assert column(spark, [None, -5, 0, 512, 2048, 5 * 1024**4], scalars.byte_size, "long") == ["0B", "0B", "0B", "512.00B", "2.00KB", "5.00TB"]
    assert column(spark, [0.0, 61.9, 6000.0], scalars.clock, "double") == ["00:00", "01:01", "100:00"]
    assert column(spark, [0.5, 1.5, None, -2.0], lambda x: scalars.samples(x, F.lit(1)), "double") == [0, 2, 0, 0]
    assert column(spark, ["1.5", "x", None], lambda x: scalars.parsed_or(x, 7.0)) == [1.5, 7.0, 7.0]


def test_sizes_round_halves_to_even(spark):
    sizes = [4736, 4746, 37 * 128, 1024 * 1024 - 1, 1280 * 1024 + 5243, 1029, 1039]
    assert column(spark, sizes, scalars.byte_size, "long") == [f"{n / 1024:.2f}KB" if n < 1 << 20 else f"{n / (1 << 20):.2f}MB" for n in sizes]
    assert column(spark, [4736], scalars.byte_size, "long") == ["4.62KB"]
