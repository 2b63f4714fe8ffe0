"""Mixing sources to target weights: subset-sum budget fitting.

Every source gets a target number of words. A source whose target is above its
size is taken whole as often as that goes (at most `most` times); what is left of
the target is a budget to be hit by a subset of its documents. Documents count
only by their exact length: each length class first gives its share of the
budget, rounded down; longer lengths then fill the gap greedily down to a slack of a few
documents, and a bounded-knapsack dynamic program over the remaining counts
closes that slack exactly where it can. Within a length class documents are
chosen by a seeded hash, so reruns agree.

A length class may hold a third of all rows (a group of copies), so it is never
sorted as a whole: documents of a class fall into hash bins, classes take whole
bins in order, and only within the one bin where the count runs out is it
decided by row.

The driver sees one row per source (targets by water filling); documents, lengths
and choices stay distributed. The dynamic program of a source reads its
(length, count) pairs only.

Defined results: a null or empty text has size 0 and is taken 0 times; null is a
source of its own, last in order; repeated rows are distinct documents only by
their doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm import bytetext, storage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
HASH_BINS = 1024
#: Beyond HASH_BINS times so many documents there are more bins, so that a bin of one huge length class stays sortable by one task.
DOCS_PER_BIN = 1 << 20
SLACK = 4096
SEED = 17


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words of each whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.zeros(0, np.int64)]
            for _, _, data, offsets in bytetext.slices(batch.column("text")):
                sizes.append(np.diff(bytetext.words(data, offsets)[2]))
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(sizes), pa.int64())], names=["doc_id", "source", "size"])

    storage.bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return narrow.mapInArrow(count, "doc_id long, source string, size long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets of all sources: share * total by weight, none above most * its size; the excess goes to the others by weight."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, slack: int = SLACK) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget as
    possible from below."""
    take = np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = sum(n * c for n, c in zip(lengths.tolist(), counts.tolist(), strict=True))
    if budget >= total:
        take[order] = counts
        return take
    # counts times budgets pass 2^63 on large corpora, so these are Python's integers
    part = np.array([c * max(budget, 0) // total for c in counts.tolist()], np.int64)
    left = budget - sum(n * c for n, c in zip(lengths.tolist(), part.tolist(), strict=True))
    for i in range(len(lengths) - 1, -1, -1):
        more = min(int(counts[i] - part[i]), (left - slack) // int(lengths[i])) if lengths[i] else 0
        if more > 0:
            part[i] += more
            left -= more * int(lengths[i])
    part += knapsack(lengths, counts - part, left)
    take[order] = part
    return take


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum by dynamic programming: the reachable sum nearest to the budget from below."""
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int64)
    for i in range(len(lengths)):
        k = int(lengths[i])
        if not k or k > budget or not counts[i]:
            continue
        fresh = reach
        for _ in range(min(int(counts[i]), budget // k)):
            moved = np.zeros(budget + 1, bool)
            moved[k:] = fresh[:-k]
            fresh = moved & ~reach
            if not fresh.any():
                break
            reach = reach | fresh
            by[fresh] = i
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        take[by[at]] += 1
        at -= int(lengths[by[at]])
    return take


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the document is in the mix), taken (copies * size)."""
    spark = docs.sparkSession
    sized = storage.staged(with_sizes(docs), "mix-sizes")
    bins = max(HASH_BINS, sized.count() // DOCS_PER_BIN)
    sized = sized.withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(bins)))
    classes = storage.staged(sized.groupBy("source", "size", "bin").count(), "mix-classes")
    # UTF-8 bytes sort as code points do
    table = sorted(((r["source"], int(r["words"])) for r in classes.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("words")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    goal = targets([n for _, n in table], [weights[i % len(weights)] for i in range(len(table))], share, most)
    aims = spark.createDataFrame([(s, n, g, int(min(g // n, most)) if n else 0) for (s, n), g in zip(table, goal, strict=True)], "source string, source_size long, target double, base int")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        n, target, base = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0]), int(pdf["base"].iloc[0])
        take = fit_budget(pdf["size"].to_numpy(), pdf["count"].to_numpy(), round(target) - base * n) if base < most and n else np.zeros(len(pdf), np.int64)
        return pdf.assign(chosen=take)

    lengths = classes.where("size > 0").groupBy("source", "size").agg(F.sum("count").alias("count"))
    chosen = _joined(lengths, F.broadcast(aims), ["source"], "inner").groupBy("source").applyInPandas(choose, "source string, size long, count long, source_size long, target double, base int, chosen long")
    quota = _joined(classes, chosen.select("source", "size", "chosen"), ["source", "size"])
    earlier = F.sum("count").over(Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    quota = quota.select("source", "size", "bin", F.greatest(F.lit(0), F.coalesce("chosen", F.lit(0)) - F.coalesce(earlier, F.lit(0))).alias("quota"))
    row = F.row_number().over(Window.partitionBy("source", "size", "bin").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"))
    out = _joined(_joined(sized.withColumn("row", row), quota, ["source", "size", "bin"]), F.broadcast(aims), ["source"])
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("row") <= F.col("quota")).cast("int")).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on columns where null equals null, keeping the left side's."""
    right = right.select(*(F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns))
    return left.join(right, [left[c].eqNullSafe(right[f"_{c}"]) for c in on], how).drop(*(f"_{c}" for c in on))
