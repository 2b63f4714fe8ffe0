"""Transactions over tables, and deletions that follow references."""

import random

import pytest

from talkweave.operators import knowledge
from talkweave.sources.snapshots import Conflict, Snapshots


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_all_or_nothing(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "kb"))
    assert tables.latest() == 0 and tables.versions() == []
    assert tables.commit({"notes": numbers(spark, 1), "units": numbers(spark, 10, 11)}) == 1
    pinned = tables.read("notes", 1)
    with pytest.raises(RuntimeError, match="between"), tables.begin() as t:
        t.write("notes", numbers(spark, 2))
        assert ids(t.read("notes")) == [2] and ids(t.read("units")) == [10, 11]
        raise RuntimeError("between two tables")
    assert tables.latest() == 1 and ids(tables.read("notes")) == [1] and len(list((tmp_path / "kb/data").iterdir())) == 2
    with tables.begin() as t:
        t.write("notes", numbers(spark, 2, 3))
    assert (t.version, tables.versions()) == (2, [1, 2])
    # readers of a version keep it; tables that weren't written stay
    assert ids(pinned) == ids(tables.read("notes", 1)) == [1] and ids(tables.read("notes")) == [2, 3] and ids(tables.read("units")) == [10, 11]


def test_two_writers(spark, tmp_path):
    tables, others = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    tables.commit({"notes": numbers(spark, 1)})
    first, second = tables.begin(), others.begin()
    first.write("notes", numbers(spark, 2))
    second.write("notes", numbers(spark, 3))
    with first:
        pass
    with pytest.raises(Conflict), second:
        pass
    assert ids(tables.read("notes")) == [2] and tables.versions() == [1, 2]
    assert not [f for f in (tmp_path / "versions").iterdir() if f.name.startswith("_")]


def test_rollback_and_vacuum(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path))
    for v in (1, 2, 3):
        tables.commit({"notes": numbers(spark, v)})
    assert tables.rollback(1) == 4 and ids(tables.read("notes")) == [1] and ids(tables.read("notes", 3)) == [3]
    tables.vacuum(keep=2)
    assert tables.versions() == [3, 4] and ids(tables.read("notes", 3)) == [3] and ids(tables.read("notes")) == [1]
    assert len(list((tmp_path / "data").iterdir())) == 2
    with pytest.raises(KeyError):
        tables.read("units")


def test_deletions(spark):
    """All tables of the knowledge base against loops, with chains and cycles of parents in both ways."""
    rng = random.Random(3)
    for parents in ("SET NULL", "CASCADE"):
        keys = tuple((c, k, p, parents if (c, k) == ("units", "parent_id") else a) for c, k, p, a in knowledge.FOREIGN_KEYS)
        pick = lambda n: rng.choice([None, *range(n)])
        rows = {
            "notes": [(i,) for i in range(12)],
            "units": [(i, pick(12), i - 1 if i % 10 else pick(60)) for i in range(60)],
            "entities": [(i,) for i in range(15)],
            "relations": [(i, pick(15), pick(15), pick(60)) for i in range(50)],
            "tags": [(i,) for i in range(6)],
            "unit_tags": sorted({(rng.randrange(60), rng.randrange(6)) for _ in range(60)}),
        }
        columns = {"notes": "id long", "units": "id long, note_id long, parent_id long", "entities": "id long", "relations": "id long, head_id long, tail_id long, evidence_unit_id long", "tags": "id long", "unit_tags": "unit_id long, tag_id long"}
        names = {t: [c.split()[0] for c in x.split(", ")] for t, x in columns.items()}
        doomed = {"notes": [1, 5], "entities": [3], "tags": [2], "units": [20, 999]}
        gone = {t: {r for r in rows[t] if r[0] in doomed.get(t, ())} for t in rows}
        while True:
            more = {(c, r) for c, k, p, a in keys if a == "CASCADE" for r in rows[c] if r not in gone[c] and r[names[c].index(k)] in {x[0] for x in gone[p]}}
            for c, r in more:
                gone[c].add(r)
            if not more:
                break
        expected = {}
        for t in rows:
            left = [dict(zip(names[t], r, strict=True)) for r in rows[t] if r not in gone[t]]
            for c, k, p, a in keys:
                if c == t and a == "SET NULL":
                    left = [r | {k: None if r[k] in {x[0] for x in gone[p]} else r[k]} for r in left]
            expected[t] = sorted(repr(tuple(r.values())) for r in left)
        tables = {t: spark.createDataFrame(r, columns[t]) for t, r in rows.items()}
        got = knowledge.deleted(tables, {t: numbers(spark, *v) for t, v in doomed.items()}, keys)
        assert {t: sorted(repr(tuple(r)) for r in df.collect()) for t, df in got.items()} == expected
