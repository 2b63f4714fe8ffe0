"""Quality rules with risk-controlled thresholds.

Measures of whole texts (words, symbols, repeated lines, repeated three-word
windows and ratios of them) feed one-sided rules "reject above" or "reject below".
Each stratum (language) learns its rules from labelled documents: a third of
the labels proposes a cutoff for each rule, in steps of a grid, and ranks the rules by what they catch;
the rest, held out, certifies them together. What is certified is the share of good documents that
any rule of the stratum rejects, so RISK bounds a stratum's false rejection as a whole: the first rule
is tested, then the first two together, then the first three, each by the exact (Clopper-Pearson)
upper bound against RISK, until a test fails; the rules before that hold. The order is
fixed by the proposals alone, so this fixed sequence needs no correction within a stratum; over
strata, DELTA is divided by the number of strata with proposals (Bonferroni). With probability 1 - DELTA no
stratum rejects more than RISK of its good documents. A stratum with too few labels to
certify anything, or with none, keeps all that passes the base rules.

Labels are joined by doc_id and become counts per stratum, rule and grid step, and per stratum and length of
the sequence; the driver sees only those counts, whose number doesn't depend on the corpus.

Defined results: a null or empty text has no words and fails the base rules;
a null lang is a stratum of its own; repeated rows get equal verdicts; labels
with null quality or doc_id, or repeated for a document, count as they are
(nulls dropped, repeats counted once by the least quality); other columns stay aside.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm import bytetext, storage, workers

RISK = 0.02
DELTA = 0.05
STEPS = 200
MIN_CATCH = 0.01

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_letters")
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
IS_MARK = np.zeros(256, bool)
IS_MARK[[ord(c) for c in "!?"]] = True
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_LETTER = IS_UPPER.copy()
IS_LETTER[97:123] = True
#: Not a continuation byte: one per code point.
IS_POINT = np.ones(256, bool)
IS_POINT[0x80:0xC0] = False

#: rule: (measure in 0..1, True if high values are rejected)
RULES: dict[str, tuple[str, bool]] = {
    "symbols": ("least(n_symbols / greatest(n_words, 1L), 1D)", True),
    "duplicate_lines": ("least(n_dup_lines / greatest(n_lines, 1L), 1D)", True),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1L)", True),
    "marks": ("least(n_marks / greatest(n_words, 1L), 1D)", True),
    "upper_case": ("n_upper / greatest(n_letters, 1L)", True),
    "long_words": ("least(word_chars / greatest(n_words, 1L) / 20D, 1D)", True),
    "short_words": ("least(word_chars / greatest(n_words, 1L) / 20D, 1D)", False),
}


def _inside(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items with a number below 2^32 and a row, both in reading order: is the number found twice or more in its row; is there an earlier equal one."""
    both = rows.astype(np.uint64) << np.uint64(32) | keys.astype(np.uint64)
    order = np.argsort(both, kind="stable")  # the order in the row stays
    same = np.diff(both[order]) == 0
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice | later, later


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of every text of a slice. Words and lines are told apart byte by byte, windows by the numbers of their words."""
    starts, ends, before = bytetext.words(data, offsets)
    rows = bytetext.row_of(before)
    n_words = np.diff(before)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(IS_POINT[data] & ~bytetext.IS_SPACE[data], out=points[1:])
    chars = points[offsets[1:]] - points[offsets[:-1]]
    # windows of three words that cross no text
    repeat = np.zeros(len(starts), bool)
    if len(starts) > 2:
        word = bytetext.identities(data, starts, ends)
        whole = np.flatnonzero(rows[2:] == rows[:-2])
        pair = bytetext.distinct(word[whole] << 32 | word[whole + 1])[2]
        window = bytetext.distinct(pair << 32 | word[whole + 2])[2]
        found = whole[_repeated(window, rows[whole])[0]]
        for k in range(3):
            repeat[found + k] = True
    # lines with a word; leading and trailing white space counts
    lo, hi, lines_before = bytetext.runs(data != 10, offsets)
    worded = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~bytetext.IS_SPACE[data], out=worded[1:])
    full = worded[hi] > worded[lo]
    line_rows = bytetext.row_of(lines_before)[full]
    later = _repeated(bytetext.identities(data, lo[full], hi[full]), line_rows)[1]
    n = len(offsets) - 1
    count = lambda items: np.bincount(items, minlength=n)
    inside = [_inside(t, data, offsets) for t in (IS_SYMBOL, IS_MARK, IS_UPPER, IS_LETTER)]
    return [n_words, chars, inside[0], count(line_rows[later]), count(rows[repeat]), count(line_rows), *inside[1:]]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and COUNTS of every document."""
    names = ["doc_id", "lang", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.drop()
        for batch in batches:
            for row, end, data, offsets in bytetext.slices(batch.column("text")):
                got = [pa.array(x, pa.int64()) for x in measure(data, offsets)]
                yield pa.record_batch([batch.column(c).slice(row, end - row) for c in ("doc_id", "lang")] + got, names=names)

    storage.bounded_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS))


def upper_bound(bad: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate p with P(at most `bad` of n | p) >= level, by bisection on the exact binomial tail."""
    if bad >= n:
        return 1.0
    ks = np.arange(bad + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in ks])
    lo, hi = bad / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        tail = float(np.exp(logs + ks * math.log(p) + (n - ks) * math.log1p(-p)).sum()) if p < 1 else 0.0
        lo, hi = (p, hi) if tail >= level else (lo, p)
    return hi


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def step_of(rule: str) -> Column:
    """The grid step of a document's measure, 0 to STEPS: what cutoffs are learned, certified and applied on."""
    return F.least(F.floor(F.expr(RULES[rule][0]) * STEPS).cast("int"), F.lit(STEPS))


def hit(rule: str, cut: int) -> Column:
    """Does the rule reject: a step of at least `cut` if high values are rejected, else of at most `cut`."""
    return F.coalesce(step_of(rule) >= cut if RULES[rule][1] else step_of(rule) <= cut, F.lit(False))


def learned_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str | None, list[tuple[str, int]]]:
    """Certified rules of each stratum: (rule, cut step), in the order of the sequence."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) > 0
    known = measured.where(~base_failed()).join(label, "doc_id").withColumn("held_out", held_out)
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), step_of(r).alias("step")) for r in RULES))).alias("x")
    counts = known.where("not held_out").select("lang", "quality", steps).groupBy("lang", "x.rule", "x.step").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()
    table: dict[str | None, dict[str, np.ndarray]] = {}
    for r in counts:
        table.setdefault(r["lang"], {}).setdefault(r["rule"], np.zeros((2, STEPS + 1), np.int64))[:, r["step"]] += (r["good"], r["bad"])
    proposed = {lang: found for lang, rules in table.items() if (found := sequence(rules))}
    if not proposed:
        return {}
    # of the held-out good documents: how many does each beginning of the sequence reject
    first = F.lit(0)
    for lang, rules in proposed.items():
        place = F.coalesce(*(F.when(hit(r, cut), F.lit(k + 1)) for k, (r, cut) in enumerate(rules)), F.lit(0))
        first = F.when(F.col("lang").eqNullSafe(F.lit(lang)), place).otherwise(first)
    rows = known.where("held_out and quality = 1").groupBy("lang", first.alias("first")).count().collect()
    level, out = delta / len(proposed), {}
    for lang, rules in proposed.items():
        rejected = np.zeros(len(rules) + 1, np.int64)
        for r in rows:
            if r["lang"] == lang:
                rejected[r["first"]] += r["count"]
        passed = certified(np.cumsum(rejected[1:]).tolist(), int(rejected.sum()), risk, level)
        if passed:
            out[lang] = rules[:passed]
    return out


def certified(rejected: list[int], good: int, risk: float, level: float) -> int:
    """How long a beginning of the sequence is certified, by how many of `good` held-out good documents each beginning rejects."""
    for k, n in enumerate(rejected):
        if not good or upper_bound(n, good, level) > risk:
            return k
    return len(rejected)


def sequence(grids: dict[str, np.ndarray]) -> list[tuple[str, int]]:
    """Proposed rules of a stratum with their cut steps, best first. grids: (good, bad) by step for each rule."""
    found = []
    for k, rule in enumerate(RULES):
        if rule in grids and (at := proposal(grids[rule], RULES[rule][1])) is not None:
            found.append((-at[1], k, rule, at[0] if RULES[rule][1] else STEPS - at[0]))
    return [(rule, cut) for _, _, rule, cut in sorted(found)]


def proposal(grid: np.ndarray, above: bool) -> tuple[int, float] | None:
    """The step, counted from the side that is kept, from which a rule would reject, and its gain; None if it catches too little. grid: (good, bad) by step."""
    grid = grid if above else grid[:, ::-1]
    total_good, total_bad = grid.sum(axis=1)
    if not total_bad or not total_good:
        return None
    good, bad = grid[:, ::-1].cumsum(axis=1)[:, ::-1]
    gain = bad / total_bad - 20 * good / total_good
    best = float(gain.max())
    if best < MIN_CATCH:
        return None
    at = int(np.flatnonzero(gain >= best - 1e-12)[-1])  # the loosest of the best
    below = np.flatnonzero(grid[0, :at])
    return (at + (int(below[-1]) + 1 if len(below) else 0) + 1) // 2, best  # halfway down to the good documents


def verdict(cutoffs: dict[str | None, list[tuple[str, int]]]) -> Column:
    """True for documents that no certified rule of their stratum rejects."""
    out = F.lit(True)
    for lang, rules in cutoffs.items():
        any_ = functools.reduce(operator.or_, (hit(rule, cut) for rule, cut in rules))
        out = out & ~(F.col("lang").eqNullSafe(F.lit(lang)) & any_)
    return out


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, lang, COUNTS, base_failed, kept."""
    measured = storage.staged(measures(docs), "quality-measures")
    cutoffs = learned_cutoffs(measured, labels, risk, delta)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(cutoffs))


def passing(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs, as they are, that pass. Measures are taken twice, once for the cutoffs (and written, since those read them twice) and once beside the row, so that texts are never shuffled."""
    cutoffs = learned_cutoffs(storage.staged(measures(docs), "quality-measures"), labels, risk, delta)
    own = [f"_{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.drop()
        for batch in batches:
            for row, end, data, offsets in bytetext.slices(batch.column(text).cast(pa.large_string())):
                got = [pa.array(x, pa.int64()) for x in measure(data, offsets)]
                yield pa.record_batch([c.slice(row, end - row) for c in batch.columns] + got, names=[*own, *COUNTS])

    schema = T.StructType([T.StructField(o, f.dataType) for o, f in zip(own, docs.schema, strict=True)])
    for c in COUNTS:
        schema = schema.add(c, "long")
    measured = docs.toDF(*own).mapInArrow(run, schema).withColumn("lang", F.col(own[docs.columns.index("lang")]).cast("string"))
    return measured.where(~base_failed() & verdict(cutoffs)).select(*(F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)))
