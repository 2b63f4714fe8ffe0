"""Exact nearest vectors against all pairs."""

import numpy as np
import pytest

from talkweave.operators import nearest


def tables(spark, rows, asked):
    units = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x") for i, v in enumerate(rows)], "id int, embed array<double>, cell string")
    queries = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(asked)], "query_id int, embed array<double>")
    return units, queries


def by_hand(rows, asked, k):
    out = {}
    for q, a in enumerate(asked):
        score = {i: float(np.dot(a, r) / np.linalg.norm(a) / np.linalg.norm(r)) for i, r in enumerate(rows)}
        for n, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 10), i))[:k]):
            out[q, n + 1] = i
    return out


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies", "few"])
def test_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "BLOCK", 40)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(len(kind))
    centres = rng.normal(size=(12, 8))
    rows = centres[rng.integers(0, 12, 400)] + 0.02 * rng.normal(size=(400, 8))
    asked = centres[rng.integers(0, 12, 9)] + 0.02 * rng.normal(size=(9, 8))
    if kind == "noise":
        rows, asked = rng.normal(size=(300, 8)), rng.normal(size=(9, 8))
    elif kind == "copies":
        rows[::3] = rows[0]
        asked[0] = rows[0]
    elif kind == "few":
        rows = rows[:3]
    got = nearest.nearest(*tables(spark, rows, asked), 5, cells=16).collect()
    assert {(r.query_id, r["rank"]): r.id for r in got} == by_hand(rows, asked, 5)
    compared = {r.query_id: r.compared for r in got}
    if kind == "clusters":
        assert sum(compared.values()) < 0.5 * len(rows) * len(asked)
    assert all(n <= len(rows) for n in compared.values())


def test_odd_vectors(spark):
    rows = [[1, 0], None, [], [0, 0], [float("nan"), 1], [0, 2], [float("inf"), 1], [3, 3]]
    got = nearest.nearest(*tables(spark, rows, [[1, 0.1], None, [0, 0]]), 9).collect()
    assert [(r.query_id, r.id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 0), (0, 7), (0, 5)]
    units, queries = tables(spark, rows, [[1, 0]])
    assert nearest.nearest(units.where("false"), queries, 3).count() == 0 and nearest.nearest(units, queries.where("false"), 3).count() == 0


def test_blocks_meet_in_many_partitions(spark):
    """Vectors and queries of a cell's blocks come together however many partitions the shuffle has."""
    rng = np.random.default_rng(4)
    rows, asked = rng.normal(size=(300, 8)), rng.normal(size=(9, 8))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = nearest.nearest(*tables(spark, rows, asked), 5, cells=16).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.query_id, r["rank"]): r.id for r in got} == by_hand(rows, asked, 5)
