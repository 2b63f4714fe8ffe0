"""Mixing, packing, token files, WARC, media, language, quality and HTML, against brute force and by edge case."""

import gzip
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkweave.llm import bytetext, language, media, mixing, packing, quality, queries, storage, template, tokenfile, tokens, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("size", "row", "bin", "base", "copies", "ids", "bits", "marks", "n_words", "kept", "half", "digest", "payload", "html", "slots", "host", "place", "_0")
ODD = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "Hello wörld <|endoftext|> x", "b"), (5, "tie tie", "b"), (6, "tie tie", "b"), (6, "tie tie", "b"), (7, "long word " * 9000, "c"), (None, "no id", None), (8, "日本語　テスト", "é")]


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, None if s is None else "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHES))


def test_words_on_bytes():
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab é\n\t\x0b\x1f 日") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, ""]
    found = []
    for _, _, data, offsets in bytetext.slices(pa.array(texts), 50):
        starts, ends, before = bytetext.words(data, offsets)
        raw = data.tobytes()
        found += [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(before[:-1], before[1:], strict=True)]
    assert found == [WORD.findall(t or "") for t in texts]


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 10], [3, 1]) == [0, 15] and mixing.targets([], []) == []
    rng = random.Random(1)
    sizes = [rng.randint(0, 1000) for _ in range(30)]
    got = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(30)])
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes, strict=True))


def test_knapsack():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 6))))
        counts = np.array([rng.randint(0, 4) for _ in lengths])
        budget = rng.randint(0, 120)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        take = mixing.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and take @ lengths == max(s for s in sums if s <= budget)
        take = mixing.fit_budget(lengths, counts, budget, slack=30)
        assert (take <= counts).all() and take @ lengths <= budget


def test_budgets_beyond_64_bits():
    lengths, counts = np.array([700, 1000, 1301]), np.array([10**9, 2 * 10**8, 3 * 10**9])
    for budget in (10**13 // 7, 3 * 10**12 + 1, 10**12 + 13):
        total = sum(map(int, lengths * counts))
        take = mixing.fit_budget(lengths, counts, min(budget, total - 1))
        assert (take >= 0).all() and (take <= counts).all() and 0 <= min(budget, total - 1) - int(take @ lengths) < 1301


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    assert {r.doc_id: r.taken for r in rows} == again
    texts = {r.doc_id: len(WORD.findall(r.text)) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == texts and all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: s.encode())
    goal = mixing.targets([by[n][0].source_size for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    for n, g in zip(names, goal, strict=True):
        assert by[n][0].target == pytest.approx(g) and abs(sum(r.taken for r in by[n]) - g) <= max(2, 0.02 * g)


def test_mixing_edges(spark):
    rows = mixing.mix_sources(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r["size"] for r in rows)
    assert [r.taken for r in rows if r.doc_id == 2] == [0]
    copies = [(i, "one two three four", "s") for i in range(3000)] + [(9999, "x y", "t")]
    rows = mixing.mix_sources(documents(spark, copies)).collect()
    assert abs(sum(r.taken for r in rows if r.source == "s") - rows[0].target if rows[0].source == "s" else 0) <= 8
    assert mixing.mix_sources(documents(spark, [])).count() == 0


def test_best_fit():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 80))]
        where, offset = packing.best_fit_decreasing(lengths, 64)
        room, slow = [], []
        for n in sorted(lengths, reverse=True):  # the tightest window by scan
            fits = [(r, k) for k, r in enumerate(room) if r >= n]
            if not fits:
                room.append(64)
                fits = [(64, len(room) - 1)]
            k = min(fits)[1]
            room[k] -= n
            slow.append(n)
        assert max(where) + 1 == len(room)
        for w in set(where):
            spans = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if where[i] == w)
            assert all(a + n == b for (a, n), (b, _) in zip(spans, [*spans[1:], (spans[-1][0] + spans[-1][1], 0)], strict=True)) and spans[-1][0] + spans[-1][1] <= 64


def encoded(text):
    return tokens.tokenizer(tokens.default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    rows = packing.pack_documents(documents(spark, ODD)).collect()
    ids = {d: encoded(t) for d, t, _ in ODD}
    seen, room = {}, {}
    for r in rows:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(n for v in seen.values() for _, n in v) == sum(len(encoded(t)) for _, t, _ in ODD)
    for spans in room.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_tokenizer_equals_library():
    rng = random.Random(4)
    alphabet = list("aB\t\n.,!'sΣéÉ́ 　한ﬁ1٣😀 ") + ["<|endoftext|>", "ΑΣ ", "İ", "don't"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    coder = tokens.WordTokenizer(tokens.default_path(), cache_words=200)
    for _, _, data, offsets in bytetext.slices(pa.array(texts), 3000):
        ids, before = coder.encode(data, offsets)
        raw = data.tobytes()
        for k in range(len(offsets) - 1):
            assert ids[before[k] : before[k + 1]].tolist() == encoded(raw[offsets[k] : offsets[k + 1]].decode())


def test_code_lengths():
    rng = np.random.default_rng(5)
    for n, bits in ((2, 1), (5, 3), (300, 9), (300, 16), (1, 4)):
        counts = np.concatenate([rng.integers(1, 1 << 30, n), [0]]) ** 2
        lengths = tokenfile.code_lengths(counts, bits).astype(int)
        assert lengths[-1] == 0 and lengths.max() <= bits and sum(2.0**-x for x in lengths if x) <= 1
    # without a binding limit the cost is Huffman's
    import heapq

    counts = rng.integers(1, 5000, 200)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert (tokenfile.code_lengths(counts, 18) * counts).sum() == cost
    with pytest.raises(ValueError):
        tokenfile.code_lengths(np.ones(5), 2)


def test_token_files(spark):
    manifest = tokenfile.write_documents(documents(spark, ODD))
    got = sorted(tokenfile.read_files(spark, manifest).collect(), key=lambda r: r.start)
    at, expected = 0, []
    for d, t, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0])):
        ids = encoded(t)
        expected.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == expected
    file = tokenfile.TokenFile(manifest.orderBy("first_doc").collect()[-1].uri)
    ids, before = file.read(len(file.index) - 1, len(file.index))
    assert ids.tolist() == encoded("日本語　テスト") and before.tolist() == [0, len(ids)]
    assert tokenfile.read_files(spark, tokenfile.write_documents(documents(spark, []))).count() == 0


def test_warc(spark):
    big = "<p>" + "ü" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2 x\ny", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", ""), (3, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(1).alias(c) for c in ("payload", "digest", "refers_to", "n")))
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        body = {i: (h or "").encode() for i, _, h in rows}[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        revisit = r.page_id in (1, 2, None)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == body
    assert warc.round_trip(pages.where("false")).count() == 0


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_zip64(monkeypatch):
    """Archives whose sizes and counts need the ZIP64 records."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = gzip.compress(warc.record(5, "http://x", b"body", None, False))
    out = Bytes()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("padding", b"z" * 500)
        z.writestr("archive/data.warc.gz", b"junk" + raw)
        z.writestr("indexes/index.cdxj", 'k {"offset": 4, "length": %d}\n' % len(raw))
    assert warc.END64 in out.getvalue()
    archive = warc.ZipArchive(out)
    assert [archive.read(*r)["payload"] for r in archive.records()] == [b"body"]
    with pytest.raises(ValueError):
        warc.ZipArchive(Bytes(b"no archive"))
    out = Bytes()
    with zipfile.ZipFile(out, "w") as z:
        for k in "ab":
            z.writestr(f"archive/{k}.warc.gz", raw)
        z.writestr("indexes/a.cdxj", 'k {"offset": 0, "length": 3, "filename": "b.warc.gz"}\n')
        z.writestr("indexes/b.cdxj", 'k {"offset": 0, "length": 3}\n')
    with pytest.raises(ValueError):
        warc.ZipArchive(out).records()
    url = "http://x/\u3000end\u2003"
    assert warc.parse_record(warc.record(1, url, b"p", None, False))["url"] == url


def test_media(spark):
    got = media.document_media(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        texts = {(t or "") for d, t, _ in ODD if d == r.doc_id}
        body = texts.pop().encode()
        full = body + b" " * (-len(body) % 192) if body else b" " * 192
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(body), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-16:]) and r.media_sha256 == hashlib.sha256(media.wav(full)).hexdigest() and r.media_bytes == len(full) + 44
        assert r.feature == media.feature(full) and r.caption == f"{len(body)} bytes"
        said = [bool(x.strip()) for x in body.decode().split("\n")]
        assert (r.position, r.n_parts) == (int(said[0]), sum(said) + 1)
    assert media.document_media(documents(spark, [])).count() == 0


def test_interleaving(spark):
    page = '<p>One <b>two</b></p><figure><img src="media:sha256-aa" alt="alt"><img src="x.png"><figcaption>Both &amp; all</figcaption></figure>tail<script>no</script><img src="media:sha256-bb">'
    parts = media.parts_of(page)
    assert [(p["position"], p["kind"], p["text"] or p["src"], p["digest"], p["caption"]) for p in parts] == [(0, "text", "One two", None, None), (1, "media", "media:sha256-aa", "aa", "Both & all"), (2, "media", "x.png", None, "Both & all"), (3, "text", "tail", None, None), (4, "media", "media:sha256-bb", "bb", None)]
    seq = media.interleaved(spark.createDataFrame([(1, page), (2, None)], "k int, h string"), "k", "h")
    found = media.resolve(seq, spark.createDataFrame([("aa", 7)], "digest string, n int"), "k")
    assert {(r.position, r.n) for r in found.collect()} == {(0, None), (1, 7), (2, None), (3, None), (4, None)}
    fetched = spark.createDataFrame([("x.png", "cc"), ("media:sha256-aa", "zz"), ("other", "aa")], "src string, digest string")
    index = spark.createDataFrame([("aa", 7), ("cc", 8)], "digest string, n int")
    assert {(r.position, r.n) for r in media.resolve(seq, index, "k", fetched).collect()} == {(0, None), (1, 7), (2, 8), (3, None), (4, None)}


def test_captions_and_sources():
    def told(page, base=None):
        return [p["text"] if p["kind"] == "text" else (p["src"], p["caption"]) for p in media.parts_of(page, base)]

    assert told("<figure><figcaption>Before</figcaption><img src=a alt=x></figure>") == [("a", "Before")]
    assert told('<figure><img src=a alt="only alt"></figure><img src=b>') == [("a", "only alt"), ("b", None)]
    assert told("<figure><figcaption>No picture</figcaption></figure><figcaption>Loose</figcaption><img src=a>") == ["No picture", "Loose", ("a", None)]
    assert told("<figure><img src=a><figcaption>open<p>rest of page<p>more") == [("a", "open"), "rest of page", "more"]
    assert told("<figure><img src=a><figcaption>two<p>blocks</figure>after") == [("a", "two blocks"), "after"]
    assert told("<figure>x<figure><img src=a><figcaption>in</figcaption></figure><img src=b><figcaption>out</figcaption></figure>") == ["x", ("a", "in"), ("b", "out")]
    assert told("<video controls><source src=v.mp4><source src=v.webm>Sorry</video><audio src=s.mp3></audio><picture><source srcset=z><img src=p.jpg></picture>") == [("v.mp4", None), "Sorry", ("s.mp3", None), ("p.jpg", None)]
    assert told("<img src='../i.png'><script>no<img src=n></script>t", "http://h.example/a/b/c") == [("http://h.example/a/i.png", None), "t"]
    parts = media.parts_of('<img src="data:text/plain;base64,aGk="><img src="data:,hi"><img src="data:;base64,%%%"><img>')
    assert [p["digest"] for p in parts] == [hashlib.sha256(b"hi").hexdigest()] * 2 + [parts[2]["digest"]] and len(parts) == 3


def test_interleaving_of_the_pages_table(spark):
    """Real pages: the text of all parts is that of the page, in order."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = media.interleaved(pages, "page_id", "html", "url").join(pages, "page_id").collect()
    for r in got:
        said = "".join(p.text or "" for p in r.parts)
        assert [p.position for p in r.parts] == list(range(len(r.parts)))
        body = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!.*?>|<[^>]*>", " ", r.html or "")
        import html

        assert "".join(said.split()) == "".join(html.unescape(body).split())


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = {(r.doc_id, r.lang_pred) for r in language.identified(documents(spark, [*ODD, (70, "12 34", "s")]), language.training_text(docs)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (70, "und")} <= odd
    assert {r.lang_pred for r in language.identified(docs, ()).collect()} == {"und"}
    assert language.identified(documents(spark, [])).count() == 0


def test_automaton():
    rng = np.random.default_rng(6)
    text = rng.integers(1, 4, 200)
    a = language.SuffixAutomaton(text)
    table = {(s, c): t for s, c, t in zip(a.state.tolist(), a.letter.tolist(), a.next.tolist(), strict=True)}
    assert len(table) == len(a.state) <= 3 * len(text) and a.size <= 2 * len(text)
    raw = bytes(text.tolist())
    for _ in range(300):
        word = rng.integers(1, 4, rng.integers(1, 9)).tolist()
        state = 0
        for c in word:
            state = table.get((state, c), 0)
            if not state:
                break
        assert bool(state) == (bytes(word) in raw)


def test_hash_table():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    table = language.HashTable(keys, np.arange(len(keys)))
    assert table.get(keys).tolist() == list(range(len(keys))) and (table.get(keys + (1 << 41)) == -1).all()
    assert language.HashTable(keys[:0], keys[:0]).get(keys[:3]).tolist() == [-1] * 3


def test_large_alphabets(monkeypatch):
    """Memory follows the length of the training texts, not their alphabets; letters beyond the common ones parse alike."""
    rng = np.random.default_rng(8)
    chinese = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 40_000))
    parser = language.CrossParser((("en", "the quick brown fox jumps over the lazy dog " * 900), ("zh", chinese)))
    held = sum(x.nbytes for x in (parser.dense, parser.rare.keys, parser.rare.values, parser.code))
    assert held < 100 << 20 and parser.letters > 10_000
    data = np.frombuffer((chinese[500:900] + "over the lazy fox").encode(), np.uint8)
    assert parser.predict(data, np.array([0, 1200, len(data)]))[0] == ["zh", "en"]
    texts = ["abcabd", "xyxz", "abxyab", "qqabc", "abdq", "zzzz", "cab dab"]
    found = []
    for common in (64, 3, 1):
        monkeypatch.setattr(language, "COMMON", common)
        small = language.CrossParser((("a", "abc abcabd"), ("b", "xyxyxz")))
        found.append([small.phrases(small.code[np.array([ord(c) for c in t])], np.array([0, len(t)])).ravel().tolist() for t in texts])
    assert found[0] == found[1] == found[2]


def test_training_sample(spark):
    rows = [(None, f"kein Name {i} " * 5, "s") for i in range(50)] + [(3 * k, f"text {k} of some words", "s") for k in range(200)] + [(9, "same row", "s")] * 40 + [(1000, "x" * 5000, "s")]
    docs = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 1000, "long").when(F.col("doc_id").isNull(), "none").otherwise("en"))
    got = dict(language.training_text(docs, 5, 100))
    learned = [d for d, _, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    assert "none" not in got and set(got) == {"en"} | ({"long"} if 1000 in learned else set())
    assert len(got["en"]) <= 5 * 30 and ("long" not in got or got["long"] == "x" * 5000)


def test_phrases():
    parser = language.CrossParser((("a", "abcabcabd"), ("b", "xyxyxz")))

    def greedy(text, train):
        n = k = 0
        while k < len(text):
            size = 1
            while k + size < len(text) and text[k : k + size + 1] in train:
                size += 1
            n, k = n + 1, k + size
        return n

    for text in ("abcabd", "xyxz", "abxyab", "qqabc", "q", "abdq", "zzzz"):
        codes = parser.code[np.array([ord(c) for c in text])]
        assert parser.phrases(codes, np.array([0, len(text)])).ravel().tolist() == [greedy(text, "abcabcabd"), greedy(text, "xyxyxz")]


def measures_by_hand(t):
    w = WORD.findall(t or "")
    tri = {}
    for k in range(len(w) - 2):
        tri.setdefault(tuple(w[k : k + 3]), []).append(k)
    repeat = {k + i for at in tri.values() if len(at) > 1 for k in at for i in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(repeat)


def test_quality_measures(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "é| ", " \n", "日&"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1000 + i, t, s) for i, (_, t, s) in enumerate(ODD)]
    got = {r.doc_id: tuple(r[c] for c in quality.COUNTS[:5]) for r in quality.measures(documents(spark, rows)).collect()}
    assert got == {d: measures_by_hand(t) for d, t, _ in rows}


def test_upper_bound():
    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n in ((0, 50), (3, 40), (10, 11)):
        p = quality.upper_bound(k, n, 0.01)
        assert tail(k, n, p) == pytest.approx(0.01, rel=1e-4)
    assert quality.upper_bound(0, 300, 0.05) == pytest.approx(1 - 0.05 ** (1 / 300)) and quality.upper_bound(5, 5, 0.1) == 1


def test_quality(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        rows.append((i, " ".join(word() + ("|" if bad else "") for _ in range(60)), "s"))
        labels.append((i, 0 if bad else 1))
    rows += [(2000, " ".join(word() for _ in range(60)), None), (2001, None, None), (2002, "a b c " * 40, "s")]
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    docs = documents(spark, rows)
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.judged(docs, lab).collect()}
    assert all(kept[i][1] == bool(i % 5) for i in range(1500))
    assert kept[2000] == (False, True) and kept[2001] == (True, False) and kept[2002] == (True, False)
    passed = quality.passing(docs, lab)
    assert passed.columns == docs.columns and {r.doc_id for r in passed.collect()} == {d for d, k in kept.items() if k[1]}
    # too few labels certify nothing, so nothing but the base rules rejects
    few = quality.judged(docs, lab.where("doc_id < 60"))
    assert few.where("not kept and not base_failed").count() == 0
    assert quality.judged(docs.where("false"), lab).count() == 0 and quality.judged(docs, lab.where("false")).count() == len(rows)


def test_false_rejection_of_a_stratum_is_bounded():
    """Many small worlds: the rules that hold together reject more than RISK of the good documents in at most DELTA of them."""
    rng = np.random.default_rng(11)
    names, bad_worlds, some, trials = list(quality.RULES), 0, 0, 400

    def steps(n, good):  # good documents have heavy tails in all measures, at the ends that rules reject
        x = rng.exponential(6 if good else 40, (n, len(names))).astype(int)
        return np.clip(np.where([quality.RULES[r][1] for r in names], x, quality.STEPS - x), 0, quality.STEPS)

    def rejected(x, rules):
        hits = [x[:, names.index(r)] >= c if quality.RULES[r][1] else x[:, names.index(r)] <= c for r, c in rules]
        return np.any(hits, axis=0) if hits else np.zeros(len(x), bool)

    for _ in range(trials):
        train_good, train_bad, held = steps(60, True), steps(60, False), steps(400, True)
        grids = {r: np.stack([np.bincount(t[:, k], minlength=quality.STEPS + 1) for t in (train_good, train_bad)]) for k, r in enumerate(names)}
        rules = quality.sequence(grids)
        n = quality.certified([int(rejected(held, rules[: k + 1]).sum()) for k in range(len(rules))], len(held), quality.RISK, quality.DELTA)
        some += n > 0
        bad_worlds += rejected(steps(20000, True), rules[:n]).mean() > quality.RISK
    assert some > trials / 10 and bad_worlds <= trials * quality.DELTA + 3 * math.sqrt(trials * quality.DELTA)


def test_cutoffs_are_applied_as_certified(spark):
    """Steps decide, so that values on the edge of a step are judged as they were counted."""
    pairs = [(k, n) for n in range(50, 120) for k in range(0, n + 1, 7)]
    counts = spark.createDataFrame([(k, n, *[0] * 7) for k, n in pairs], "n_symbols long, n_words long, word_chars long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_upper long, n_letters long")
    rows = counts.select("n_symbols", "n_words", quality.step_of("symbols").alias("s"), quality.hit("symbols", 116).alias("hit")).collect()
    assert all(r.hit == (r.s >= 116) for r in rows) and all(abs(r.s - 200 * r.n_symbols / r.n_words) < 1.001 for r in rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><div class=intro>Always the same words</div>
<!-- ad --><div class="ad">Buy</div><article><header><h1>Head &amp; line %d</h1></header><p>First %d <b>bold<br>text</b> %d<p>Second&nbsp;para&#8212;graph %d<aside>Side</aside><form>Sign up</form></p>
<section id="comments"><p>Nice!</p></section></article><aside>More</aside><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % (i, i, i, i)) for i in range(9)] + [(10, None, None), (11, "bad url", ""), (12, "http://x.example/", "<p>no article <i>here</i><div>block</div>"), (13, "http://x.example/", "plain < 3 & text &lt;ok&gt;")]
    rows += [(20 + i, f"https://u:p@H2.example:8/{i}", f"<body><div>Shared line</div><div>Shared two</div><p>Own words {i}</p></body>") for i in range(9)]
    rows += [(40 + i, "http://copies.example/", "<div><p>Only this</p><p>And that</p></div>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(1).alias(c) for c in ("host", "blocks", "slots", "text", "tokens")))
    got = {r.page_id: r.text for r in template.main_text(pages).collect()}
    assert got[0] == "Head & line 0 First 0 bold text 0 Second para—graph 0"
    assert (got[10], got[11], got[12], got[13]) == ("", "", "no article here block", "plain < 3 & text <ok>")
    assert got[23] == "Own words 3" and got[40] == "Only this And that"
    assert template.main_text(pages.where("false")).count() == 0
    assert all(r.n_chars == len(r.text) for r in template.main_text(pages).collect())


def test_main_text_of_small_hosts(spark):
    page = "<body><div>Shared line</div><div>Shared two</div>%s<p>Own words %d</p></body>"
    # "Of some" is on four of the five pages of c
    rows = [(n * 10 + i, f"http://{h}.example/{i}", page % ("<p>Of some</p><hr><ul><li>So is this</ul>" * (h == "c" and i > 0), i)) for n, h in ((1, "a"), (2, "b"), (3, "c")) for i in range(n + 2)]
    got = {r.page_id: r.text for r in template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[11] == "Shared line Shared two Own words 1"
    assert got[21] == "Own words 1" and got[30] == "Own words 0" and got[31] == "Of some So is this Own words 1"


def test_main_text_keeps_articles_in_named_elements():
    def text(source):
        blocks = [dict(zip(("at", "token", "text", "article", "region"), b, strict=True)) for b in template.Page(source).blocks]
        return " ".join(template.chosen([], blocks, None, None))

    assert text('<div class="layout has-sidebar"><article><p>One</p></article><div class="sidebar">x</div></div>') == "One"
    assert text('<article class="story promo"><p>One</p></article>') == "One"
    inside = '<div class="entry-header">A</div><div class="article-header">B</div><p class="share-price">C</p><p class="warning">D</p><div class="side">E</div><div class="header">F</div>'
    assert text(f'<article>{inside}<div class="ad">x</div><div class="comments">y</div></article>') == "A B C D E F"
    assert text('<form id="form"><div class="sidebar"><p>x</p><main><p>One</p></main></div></form>') == "One"
    # articles in lists of comments and sidebars are not the page's, if it has one
    cards = '<div class="comments"><article>x</article></div><aside><article>y</article></aside><div class="site-footer">z</div>'
    assert text(f"<article><p>One</p></article>{cards}") == "One"
    assert text(cards) == "x y"



def test_queries_have_rows(spark):
    for name in ("op2_warc", "op4_media", "op8_main_text"):
        df = queries.QUERIES[name](spark, SF)
        assert df.count() == spark.read.parquet(f"{SF}/{'documents' if name == 'op4_media' else 'pages'}.parquet").count()


def test_shared_folder(spark, tmp_path):
    assert storage.shared_folder(spark).startswith("file:")
    storage.write_file(f"file://{tmp_path}/a/b", [b"x", b"yz"])
    f = storage.open_file(f"file://{tmp_path}/a/b")
    f.seek(1)
    assert f.read(2) == b"yz"


def test_token_files_follow_the_data(spark, monkeypatch):
    """Many files for much data, several splits a file, a document longer than a split, and ids as by brute force."""
    assert [tokenfile.file_count(n, 0, 200) for n in (0, 1, 10**7, 10**9, 10**12)] == [1, 1, 10, 200, 14902] and tokenfile.file_count(0, 1 << 20, 8) == 8
    monkeypatch.setattr(tokenfile, "LEAST_IDS", 900)
    monkeypatch.setattr(tokenfile, "SPLIT_IDS", 250)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.choice((0, 1, 20, 200)))), "a") for i in rng.sample(range(10**6), 60)] + [(5, "long one " * 900, "b"), (None, None, None)]
    manifest = tokenfile.write_documents(documents(spark, rows))
    files = manifest.collect()
    assert len(files) == 4 and max(f.n_tokens for f in files) < 0.8 * sum(f.n_tokens for f in files)
    read = tokenfile.read_files(spark, manifest)
    got = sorted(read.collect(), key=lambda r: r.start)
    at, texts = 0, {i: t for i, t, _ in rows}
    assert [r.doc_id for r in got] == sorted(texts, key=lambda i: (i is not None, i or 0))
    for r in got:
        ids = encoded(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 2 * len(files)
