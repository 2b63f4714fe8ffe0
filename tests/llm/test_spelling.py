"""Spelling variants: pairs against edit distance, blocks and small units, chains of forms, odd rows. SQL covers the whole query."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkweave.llm import spelling as sp


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rng, count, letters="aeiost", lengths=(7, 10)):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(count)})


def test_masks_differ_in_two_bits_at_most():
    rng = random.Random(1)
    alphabet = sp.LETTERS + "".join(chr(c) for c in range(0xC0, 0x100))
    for _ in range(3000):
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(7, 12)))
        p, c = rng.randrange(len(a)), rng.choice(alphabet)
        for b in (a[:p] + a[p + 1 :], a[:p] + c + a[p:], a[:p] + c + a[p + 1 :]):
            differing = sp.parity(a) ^ sp.parity(b)
            assert differing.bit_count() <= 2 and any(not differing >> sp.BAND_BITS * k & sp.BAND for k in range(3))
            assert sp.near(a, b) == sp.near(b, a) == one_edit(a, b)


@pytest.mark.parametrize("block, small", [(2048, 48), (16, 48), (16, 2), (7, 10**6)])
def test_near_words(spark, monkeypatch, block, small):
    monkeypatch.setattr(sp, "BLOCK", block)
    monkeypatch.setattr(sp, "SMALL", small)
    rng = random.Random(block)
    words = words_of(rng, 900, "abst", (7, 8))
    n = {w: rng.choice((2, 2, 3, 30, 400)) for w in words}
    table = sp.masked(spark.createDataFrame(list(n.items()), "word string, n long"))
    got = {r.word: (r.n_near, r.best, r.best_n) for r in sp.near_words(table).collect()}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    assert got == {w: (len(v), min(v, key=lambda x: (-n[x], x)), max(n[x] for x in v)) for w, v in near.items() if v} and len(got) > 300


def test_units_in_process(monkeypatch):
    """best_near sees what workers see: several units in a table, some split in sides."""
    words = words_of(random.Random(4), 90, "ab", (7, 8))
    monkeypatch.setattr(sp, "PAIRS_AT_ONCE", 50)
    rows = sorted((7, int(k % 2 == 0), w) for k, w in enumerate(words))
    table = pa.table({"word": [w for *_, w in rows], "n": np.ones(len(rows), np.int64), "mask": [sp.parity(w) for *_, w in rows], "size": pa.array([len(w) for *_, w in rows], pa.int32()), "key": np.full(len(rows), 7), "unit": np.full(len(rows), 1), "side": pa.array([s for _, s, _ in rows], pa.int32())})
    for small in (2, 1000):
        monkeypatch.setattr(sp, "SMALL", small)
        got = sp.best_near(table).to_pydict()
        side = {w: s for _, s, w in rows}
        want = {w: sum(one_edit(v, w) and side[v] != side[w] and not len(v) == len(w) == 8 for v in words) for w in words}
        assert dict(zip(got["word"], got["seen"], strict=True)) == {w: k for w, k in want.items() if k}


def test_chains_and_odd_rows(spark):
    def rows(word, n):  # rows whose runs stay as they are
        found, i = [], 0
        while len(found) < n:
            if zlib.crc32(f"{i}:{word}".encode()) % 31:
                found.append((i, f"{word.upper()}, "))
            i += 1
        return found

    docs = rows("spelling", 2000) + rows("speling", 150) + rows("spleing", 3) + rows("spelingx", 12) + rows("abcdefg", 1) + rows("äbcdefgh", 2) + [(None, "nullidword nullidword"), (3, None), (4, ""), (5, "short 1234567 _______")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("word", "n", "mask", "size", "key", "_id", "_run")))
    got = {r.word: tuple(r)[1:] for r in sp.variants(df).collect()}
    assert got == {
        "spelling": (None, "spelling", 2000, 1, None),
        "speling": ("spelling", "spelling", 150, 2, 2000),
        "spelingx": ("speling", "spelling", 12, 1, 150),
        "spleing": (None, "spleing", 3, 0, None),
        "Äbcdefgh": (None, "Äbcdefgh", 2, 0, None),
        "nullidword": (None, "nullidword", 2, 0, None),
    }
    assert sp.variants(df.where("false")).count() == 0


def test_long_words(spark):
    long = "ab" * 100_000
    docs = [(1, long), (2, long), (3, long + "c"), (4, long + "c")]
    docs = [(i + 1000 * k, t) for i, t in docs for k in range(2)]
    got = {r.word: r.n_near for r in sp.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[long] >= 1
