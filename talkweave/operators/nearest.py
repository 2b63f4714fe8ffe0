"""Exact nearest vectors by cosine: cells around pivots, and the triangle inequality on angles.

Every vector belongs to the cell of the pivot at the smallest angle to it; a cell's radius is the largest of these angles. No vector of a
cell can be nearer to a query than the query's angle to the pivot less the radius. A query first opens cells in the order
of that bound until they hold k vectors; the k-th best of those is a limit that the true k-th best can't exceed. Then it opens all other cells whose bound is
within the limit, and no others. Pivots only decide how many cells that are; results don't depend on them.

Work is dealt in units of a block of a cell's vectors and a block of the queries that open it, each compared as one matrix product, so a
hot cell (very many alike vectors) spreads over the cluster, no pair is ever a row, and a unit returns k vectors for each query.
Pivots are CELLS vectors (those with the smallest hashes of their ids), a bound that doesn't depend on the data; cells and their radii go with them.

Vectors that are null, empty or without length aren't near anything; nor do such queries get any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions import scalars
from talkweave.session import materialized

CELLS = 64
BLOCK, QUERY_BLOCK = 4096, 1024
#: Angles are compared with this much to spare, for rounding.
SLACK = 1e-6


def unit_vectors(values: list) -> np.ndarray:
    x = np.array(values, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def usable(df: DataFrame, id_: str) -> DataFrame:
    """id_ and embed (doubles) of vectors that have a direction."""
    typed = df.select(id_, F.col("embed").cast("array<double>").alias("embed"))
    return typed.where("embed is not null and exists(embed, x -> x <> 0) and forall(embed, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def celled(vectors: DataFrame, id_: str, pivots: np.ndarray) -> DataFrame:
    """id_, embed, cell, angle of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to = angles(unit_vectors(batch.column("embed").to_pylist()), pivots)
                cell = to.argmin(axis=1)
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(to[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "angle"])

    return vectors.mapInArrow(run, f"{id_} {vectors.schema[id_].dataType.simpleString()}, embed array<double>, cell int, angle double")


def opened(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, size: np.ndarray, k: int, limit: bool) -> DataFrame:
    """query_id, embed, cell: the cells that each query opens first or, with its column `limit`, those that it opens then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = np.maximum(angles(unit_vectors(batch.column("embed").to_pylist()), pivots) - radius, 0)
            bound[:, size == 0] = np.inf
            order = np.argsort(bound, axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1)
            first = np.zeros(bound.shape, bool)  # up to the cell with which k vectors are there
            np.put_along_axis(first, order, (held - size[order] < k) & (size[order] > 0), axis=1)
            use = (bound <= batch.column("limit").to_numpy()[:, None] + SLACK) & ~first if limit else first
            row, cell = np.nonzero(use)
            of = pa.array(row)
            yield pa.record_batch([batch.column("query_id").take(of), batch.column("embed").take(of), pa.array(cell.astype(np.int32))], names=["query_id", "embed", "cell"])

    return queries.mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, embed array<double>, cell int")


def best_of(asked: DataFrame, vectors: DataFrame, size: np.ndarray, k: int) -> DataFrame:
    """query_id, id, near (cosine, about): the k best of each unit for each of its queries."""
    blocks = F.element_at(F.array(*(F.lit(max(1, -(-int(n) // BLOCK))) for n in size)), F.col("cell") + 1)
    counts = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    query_blocks = F.element_at(F.array(*(F.lit(max(1, -(-counts.get(c, 0) // QUERY_BLOCK))) for c in range(len(size)))), F.col("cell") + 1)
    here = F.array(*(F.lit(c in counts) for c in range(len(size))))
    left = vectors.where(F.element_at(here, F.col("cell") + 1)).select("id", "embed", "cell", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), query_blocks - 1)).alias("qb"))
    right = asked.select("query_id", "embed", "cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("vb"), F.pmod(F.xxhash64("query_id"), query_blocks).cast("int").alias("qb"))
    types = [f"{n} {d.schema[n].dataType.simpleString()}" for n, d in (("query_id", asked), ("id", vectors))]

    def compare(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": q["query_id"].iloc[:0], "id": v["id"].iloc[:0], "near": np.zeros(0)})
        v = v.sort_values("id", kind="stable").reset_index(drop=True)
        near = np.round(unit_vectors(q["embed"].tolist()) @ unit_vectors(v["embed"].tolist()).T, 12)
        top = np.argsort(-near, axis=1, kind="stable")[:, :k]  # equal ones by id
        row = np.repeat(np.arange(len(q)), top.shape[1])
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[row], "id": v["id"].to_numpy()[top.ravel()], "near": near[row, top.ravel()]})

    keys = ("cell", "vb", "qb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, f"{', '.join(types)}, near double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, cells: int = CELLS) -> DataFrame:
    """query_id, id, score, rank of the k vectors (id, embed) with the largest cosine to each query (query_id, embed); ties by id.

    `compared` says how many vectors a query was compared with. Any number of queries."""
    known, asked = usable(vectors, "id"), usable(queries, "query_id")
    picked = [r["embed"] for r in known.orderBy(F.xxhash64("id"), "id").limit(cells).collect()]
    types = [f"{n} {d.schema[n].dataType.simpleString()}" for n, d in (("query_id", asked), ("id", known))]
    if not picked or k < 1:
        return vectors.sparkSession.createDataFrame([], f"{', '.join(types)}, score double, rank int, compared long")
    pivots = unit_vectors(picked)
    placed = materialized(celled(known, "id", pivots))
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
        radius[r["cell"]], size[r["cell"]] = r["radius"], r["n"]
    begin = materialized(opened(asked, pivots, radius, size, k, False))
    some = materialized(best_of(begin, placed, size, k))
    w = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "id")
    limits = some.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("query_id").agg(F.when(F.count("*") < k, F.lit(4.0)).otherwise(F.acos(F.greatest(F.least(F.min("near"), F.lit(1.0)), F.lit(-1.0)))).alias("limit"))
    rest = materialized(opened(asked.join(limits, "query_id"), pivots, radius, size, k, True))
    both = some.unionByName(best_of(rest, placed, size, k))
    best = both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    sizes = F.element_at(F.array(*(F.lit(int(n)) for n in size)), F.col("cell") + 1)
    compared = begin.unionByName(rest).groupBy("query_id").agg(F.sum(sizes).cast("long").alias("compared"))
    told = best.join(asked.withColumnRenamed("embed", "_q"), "query_id").join(placed.select("id", "embed"), "id").withColumn("score", scalars.cosine(F.col("embed"), F.col("_q")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return told.join(compared, "query_id").select("query_id", "id", "score", F.row_number().over(order).alias("rank"), "compared")
