"""Suffix-array dedup and near-duplicates against brute force, with hostile inputs."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm import graph, neardup, suffixdedup
from talkweave.llm.suffixarray import HashedText, merge_sorted

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside.
CLASHES = ("doc", "ranges", "at", "end", "key", "component", "size", "row", "bin", "signature", "_0", "words")


def documents(spark, rows):
    """doc_id, text, lang, source, n_chars and columns with clashing names."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(c).alias(c) for c in CLASHES))


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéüß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  TWO"), (5, "x" * 700), (6, "ab" * 900), (7, passage), (8, passage)]
    for i in range(9, 90):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 160))]
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        rows.append((i, " ".join(words)))
        if i % 7 == 0:  # a near copy
            k = rng.randrange(len(words))
            rows.append((1000 + i, " ".join(words[:k] + ["zz"] + words[k + 1 :])))
        if i % 11 == 0:
            rows.append((2000 + i, rows[-1][1]))
    rows.append((3000, " ".join(rng.choice(vocab) for _ in range(30_000))))  # very long
    rows.append((3001, rows[-1][1][50_000:]))
    return rows


def cut_by_hand(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone, done = bytearray(len(b)), 0
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[max(p, done) : p + length] = b"\1" * (p + length - max(p, done))
                done = p + length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
    return out


def test_suffix_dedup(spark):
    rows = corpus()
    got = suffixdedup.without_repeats(documents(spark, rows), carry=("lang", "ranges"))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in got.collect()} == cut_by_hand(rows)
    assert got.first().ranges == "ranges"


def test_suffix_dedup_edges(spark):
    long = "abcdefghij " * 30
    rows = [(5, long), (5, long), (None, "q" * 60 + long)]
    got = suffixdedup.without_repeats(documents(spark, rows))
    out = [(r.doc_id, r.n_removed) for r in got.orderBy("doc_id").collect()]
    # a null id sorts first; equal rows don't repeat each other, but both repeat what came before
    assert out[0][0] is None and out[1] == out[2] and out[1][1] > 0
    assert suffixdedup.without_repeats(documents(spark, [])).count() == 0


def cut_of_rows(rows, length=100):
    """cut_by_hand for rows with null or shared ids: only smaller ids and the own text count as earlier."""
    out = []
    for d, t in rows:
        before = [(-1, x) for e, x in rows if (e is None and d is not None) or (e is not None and d is not None and e < d)]
        seen = {b[p : p + length] for _, x in before for b in [(x or "").encode()] for p in range(len(b) - length + 1)}
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        out.append((-1 if d is None else d, sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return sorted(out)


def test_suffix_dedup_of_rows_without_ids_of_their_own(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, tail = text(30), text(20)
    rows = [(None, shared + " " + text(40)), (None, text(50)), (None, text(20) + " " + shared + " " + text(9)), (None, tail + " | " + tail)]
    rows += [(4, text(20) + shared), (4, text(30) + " " + shared + text(10)), (4, tail + text(5)), (9, shared + tail), (9, text(40)), (9, text(40))]
    got = suffixdedup.without_repeats(documents(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed, r.text) for r in got) == cut_of_rows(rows)


def test_suffix_dedup_of_hot_passages(spark, monkeypatch):
    """One passage with a different context in each document: more contexts of one anchor than are sorted together, folded in small steps."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(35)
    rows = [(i, text(rng.randint(2, 25)) + " " + passage + " " + text(rng.randint(2, 25))) for i in range(700)]
    rows += [(1000 + i, passage[rng.randrange(60) :] + text(9)) for i in range(100)]
    expected = cut_by_hand(rows)
    seen = []
    real = suffixdedup.hot_messages
    monkeypatch.setattr(suffixdedup, "hot_messages", lambda *a: seen.append(1) or real(*a))
    got = suffixdedup.without_repeats(documents(spark, rows).repartition(3))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in got.collect()} == expected and seen
    fold, out = suffixdedup.RunFold(100), []
    monkeypatch.setattr(suffixdedup, "FOLD_BYTES", 100)
    x = {f: np.arange(2000) * (f in ("low", "doc", "at")) + (f == "windows") for f, _ in suffixdedup.FIELDS}
    x["low"] //= 2  # each context twice; the second repeats the first
    for k in range(0, 2000, 7):
        out += fold.add(suffixdedup._pack(x, np.arange(2000)[::-1][k : k + 7]))
    out += fold.close()
    closed = [d for b in out for d, a in zip(b.column("doc").to_pylist(), b.column("anchor").to_pylist(), strict=True) if a is None]
    hot = [d for b in out for d, h in zip(b.column("doc").to_pylist(), b.column("hot").to_pylist(), strict=True) if h]
    assert len(fold.held["doc"]) == 0 and sorted(closed + hot) == list(range(2000))


def test_merge_sort():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    text = HashedText(data, 20)
    suffix, group = rng.integers(0, 3900, 500), np.sort(rng.integers(0, 9, 500))
    order = merge_sorted(text, suffix, group)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(500), key=lambda k: (group[k], raw[suffix[k] : suffix[k] + 20], k))
    i, j = suffix[:-1], suffix[1:]
    lengths = [next((k for k in range(20) if raw[a + k] != raw[b + k]), 20) for a, b in zip(i, j, strict=True)]
    assert text.extension(i, j).tolist() == lengths
    assert text.equal(i, j).tolist() == [n == 20 for n in lengths]


def shingle_set(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_by_hand(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    common = collections.Counter((a, b) for ds in where.values() for a in ds for b in ds if a < b)
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    for i in range(60):  # a family of copies edited to different degrees
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((5000 + i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == components_by_hand(rows)


def test_near_duplicates_edges(spark):
    text = "a b c d e f g h"
    got = neardup.near_duplicates(documents(spark, [(None, text), (7, text), (7, text), (9, text)]))
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got.collect()) == [(0, 0, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_pigeonhole():
    """Every pair within the distance that is promised shares a key."""
    rng = np.random.default_rng(4)
    n = neardup.CHUNKS * neardup.CHUNK
    limit = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 16, n).astype(np.uint16)
        b = a.copy()
        b[rng.choice(n, limit, replace=False)] += 1
        keys = neardup.bucket_keys(np.stack([a, b]))
        shared = set(keys[0].tolist()) & set(keys[1].tolist())
        assert shared
        assert int(neardup.first_shared_key(a, (a == b)[None])[0]) in shared


def test_pairs_in_a_bucket_are_compared_whatever_their_signatures():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, neardup.CHUNKS * neardup.CHUNK).astype(np.uint16)
    b = a.copy()
    b[neardup.CHUNK :] += 1  # only the first chunk is equal
    key = int(neardup.first_shared_key(a, (a == b)[None])[0].view(np.int64))
    held = {"doc_id": [1, 2], "component": [1, 2], "own": [0, 0], "signature": [a.tobytes(), b.tobytes()]}
    bucket = neardup.Bucket((key, 0, 0), held)
    assert bucket.owned(0).tolist() == [1] and not len(bucket.near(0)[0])


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    """Every pair across components meets in exactly one pair of blocks; those inside the largest component don't make rows of their own."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = [(1, d, 0 if d < 60 else d % 5) for d in range(75)] + [(2, d, d) for d in range(20)] + [(3, d, 7) for d in range(30)]
    got = neardup.in_blocks(spark.createDataFrame(rows, "key long, doc_id long, component long")).collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.key, r.i, r.j].append(r)
    met = collections.Counter((k, min(x.doc_id, y.doc_id), max(x.doc_id, y.doc_id)) for (k, i, j), g in groups.items() for n, x in enumerate(g) for y in g[:n] if i == j or x.own != y.own)
    across = {(k, a, b) for k, a, c in rows for k2, b, c2 in rows if k == k2 and a < b and c != c2}
    assert across <= set(met) and max(met.values()) == 1
    assert not any(r.key == 3 for r in got) and sum(r.key == 1 for r in got) < 75 * 10


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_randomly_numbered_path(spark):
    ids = random.Random(5).sample(range(1, 10**6), 1000)
    edges = list(zip(ids[:-1], ids[1:], strict=True)) + [(0, 10**6 + k) for k in range(300)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: min(ids) for i in ids}, 0: 0, **{10**6 + k: 0 for k in range(300)}}


def test_periodic_texts(spark, monkeypatch):
    """Long runs of one letter or of two, in one document and in many: like brute force, and in a few entries a piece."""
    import hashlib

    monkeypatch.setattr(suffixdedup.bytetext, "SLICE_BYTES", 700)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("cdefgh") for _ in range(n))
    run = "a" * 3000
    rows = [(1, run), (2, noise(400) + "ab" * 1200), (3, "ab" * 700 + noise(300)), (4, noise(50) + run), (5, "abc" * 900), (6, "a" * 99)] + [(10 + k, "xy" * 400) for k in range(30)]
    got = {r.doc_id: r for r in suffixdedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = set()
    for i, text in rows:
        gone = bytearray(len(text))
        for at in range(len(text) - 99):
            window = text[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        left = "".join(c for c, g in zip(text, gone, strict=True) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(left.encode()).hexdigest())


def test_messages_of_periodic_texts(spark):
    for unit in ("a", "ab", "abc"):
        docs = spark.createDataFrame([(1, 7, unit * (3_000_000 // len(unit)))], "doc long, name long, text string")
        sent = suffixdedup.run_messages(docs, 64, 100, 32).selectExpr("sum(octet_length(blob)) as n").first().n
        assert sent < 100_000
