"""Identity of words, lines and shingles on texts made to share polynomial hashes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_corpus import documents, encoded, measures_by_hand

from talkweave.llm import bytetext, neardup, packing, quality, tokenfile, tokens

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(SWAP)
    return s


PAIRS = [(thue_morse(n), thue_morse(n).translate(SWAP)) for n in (1024, 2048, 4096)]


def test_names_tell_thue_morse_words_apart():
    for u, v in PAIRS:
        data = np.frombuffer((u + v).encode(), np.uint8)
        n = len(u)
        at = np.array([0, n])
        quick = bytetext.span_hashes(bytetext.prefix_hashes(data), at, at + n)
        assert quick[0] == quick[1]  # this is what the bytes are compared for
        names = bytetext.names_of(data, at, at + n)
        assert names[0] != names[1]
        assert bytetext.identities(data, at, at + n)[0] != bytetext.identities(data, at, at + n)[1]


def test_equal_spans():
    rng = random.Random(1)
    raw = bytes(rng.choice(b"ab") for _ in range(300))
    view = bytetext.wide(np.frombuffer(raw, np.uint8))
    a, b, n = (np.array([rng.randint(0, 250) for _ in range(4000)]) for _ in range(3))
    n = np.array([rng.randint(0, 40) for _ in range(4000)])
    a[:50] = 300 - n[:50]
    got = bytetext.equal_spans(view, a, view, b, n)
    assert got.tolist() == [raw[x : x + k] == raw[y : y + k] for x, y, k in zip(a, b, n, strict=True)]


@pytest.mark.parametrize("hashes", ["thue-morse", "length"])
def test_tokenizer_on_colliding_words(monkeypatch, hashes):
    texts = [f"x {u} {v} {u}\n{v} y" for u, v in PAIRS] if hashes == "thue-morse" else ["the cat sat on a mat", "dog and cat", "", "a on mat the"]
    if hashes == "length":
        monkeypatch.setattr(bytetext, "span_hashes", lambda p, s, e: (e - s).astype(np.uint64) % np.uint64(3))
    coder = tokens.WordTokenizer(tokens.default_path())
    for _ in range(2):
        for _, _, data, offsets in bytetext.slices(pa.array(texts)):
            ids, before = coder.encode(data, offsets)
            assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:], strict=True)] == [encoded(t) for t in texts]


def test_operators_on_colliding_words(spark):
    rows = [(i, f"{u} {v} c {u} {u} c\n{v}\n{u}", "s") for i, (u, v) in enumerate(PAIRS)] + [(10 + i, " ".join(p), "s") for i, p in enumerate(PAIRS)]
    rows += [(20 + i, " ".join(p[::-1]), "s") for i, p in enumerate(PAIRS)]
    docs = documents(spark, rows)
    texts = {i: t for i, t, _ in rows}
    assert {r.doc_id: tuple(r[c] for c in quality.COUNTS[:5]) for r in quality.measures(docs).collect()} == {i: measures_by_hand(t) for i, t in texts.items()}
    assert {r.doc_id: r.n_shingles for r in neardup.signed(docs).collect()} == {i: max(1, len(set(zip(*(t.split()[k:] for k in range(5)), strict=False)))) for i, t in texts.items()}
    assert all(r.kept for r in neardup.near_duplicates(docs).collect())
    from test_corpus import crc

    for r in packing.pack_documents(docs).collect():
        assert r.ids_crc32 == crc(encoded(texts[r.doc_id])[r.start : r.start + r.length])
    for r in tokenfile.read_files(spark, tokenfile.write_documents(docs)).collect():
        assert r.ids_crc32 == crc(encoded(texts[r.doc_id]))
