"""Weighted fingerprints: exact samples by plain Python, likeness against generalised Jaccard, and the order of documents."""

import collections
import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from talkweave.llm import fingerprint as fp
from talkweave.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R, C = fp.quantiles(True).tolist(), [math.log(v) for v in fp.quantiles(False)]


def hash64(data):
    return xxhash.xxh64_intdigest(data, seed=42)


def by_hand(text):
    """The signature of a text, sample by sample."""
    out = []
    for mx, my in fp.MASKS:
        best = None
        for word, n in collections.Counter(WORD.findall(text)).items():
            term = hash64(word.encode())
            x, y = (hash64(((term ^ m) & (1 << 64) - 1).to_bytes(8, "little")) for m in (mx, my))
            zeros = lambda bits, most: min((bits & -bits).bit_length() - 1 if bits else 64, most - 1)
            r, c = R[zeros(x >> 5, 40) * 32 + x % 32], C[zeros(y >> 5 & (1 << 27) - 1, 27) * 32 + y % 32]
            b = ((y >> 32) + 0.5) / 2**32
            t = math.floor(math.log(n) / r + b)
            found = (int((c - r * (t - b + 1)) * 4194304.0) << 32 | ((x >> 32) ^ t))
            best = found if best is None or found < best else best
        out.append(None if best is None else best & 0xFFFFFFFF)
    return out


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(1).alias(c) for c in ("bucket", "row", "n", "_key", "_at", "ghost", "next_text", "fingerprint")))


def expected(rows):
    """(doc_id, n_chars, sha, likenesses) of rows whose ids differ."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = by_hand(text), by_hand(edited), by_hand(after)
        like = lambda u: sum(p == q for p, q in zip(a, u, strict=True)) / 64  # noqa: E731, B023
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(b), like(c), "".join(f"{v or 0:08x}" for v in a)))
    return out


def test_against_plain_python(spark):
    rng = random.Random(3)
    words = [f"wö{i}" for i in range(60)]
    rows = [(rng.randrange(-(10**15), 10**15) * (i + 1), " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(90)]
    rows += [(i, t) for i, t in enumerate(["", None, " \t\n\x0b\x0c\r", "one", "one two three", "😀 é " * 40, "tie tie tie", "x" * 300_000, "a b\nc\td " * 500])] + [(None, "no id here")]
    got = fp.fingerprints(documents(spark, rows).repartition(3)).collect()
    assert sorted(map(repr, expected(rows))) == sorted(repr((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint)) for r in got)
    assert {r.fingerprint for r in got if r.doc_id == 0} == {"0" * 512}


def test_repeated_rows_and_shared_ids(spark):
    rows = [(1, "first words"), (1, "first words"), (1, "other words"), (2, "two"), (None, "n"), (None, "n"), (None, None)]
    got = fp.fingerprints(documents(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((i or -1, len(t or "")) for i, t in rows)
    assert len({tuple(r) for r in got if r.n_chars == 11 and r.edited_sha256}) == 2
    two = next(r for r in got if r.doc_id == 2)
    assert two.edited_sha256 in {hashlib.sha256(f"tw{t}".encode()).hexdigest() for t in ("f", "o")}


def test_one_document_and_none(spark):
    (r,) = fp.fingerprints(documents(spark, [(5, "alone with itself")])).collect()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"alone witalone wi").hexdigest()
    none = fp.fingerprints(documents(spark, [(5, "x")]).where("false"))
    assert none.count() == 0 and none.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_likeness_is_generalised_jaccard(spark):
    """Over 200 pairs, errors are those of 64 fair coins: no bias, and the spread of a binomial."""
    rng = random.Random(8)
    pairs = []
    for _ in range(200):
        a = {f"t{i}": rng.randint(1, 9) for i in rng.sample(range(400), rng.randint(5, 120))}
        b = {t: max(1, n + rng.randint(-2, 3)) for t, n in a.items() if rng.random() < rng.choice((0.5, 0.9))} | {f"u{i}": 1 for i in range(rng.randint(0, 30))}
        pairs.append((" ".join(t for t, n in a.items() for _ in range(n)), " ".join(t for t, n in b.items() for _ in range(n)), sum(min(a.get(t, 0), b.get(t, 0)) for t in a) / sum(max(a.get(t, 0), b.get(t, 0)) for t in a | b)))
    df = spark.createDataFrame([(2 * k + s, p[s]) for k, p in enumerate(pairs) for s in (0, 1)], "id long, text string")
    sig = {r.id: r.signature for r in fp.signatures(df, ["id"]).collect()}
    z = [(sum(x == y for x, y in zip(sig[2 * k], sig[2 * k + 1], strict=True)) / 64 - p[2]) / math.sqrt(max(p[2] * (1 - p[2]), 0.01) / 64) for k, p in enumerate(pairs)]
    assert abs(sum(z) / len(z)) < 0.25 and sum(v * v for v in z) / len(z) == pytest.approx(1, abs=0.35)


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_fingerprints"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(repr, expected([tuple(r) for r in rows]))) == sorted(repr((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint)) for r in got)
