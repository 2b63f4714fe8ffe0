"""The registered queries that SQL can't express, on small tables of their own, against plain Python."""

import hashlib
import html
import random
import re
import zlib

import pytest
from test_corpus import WORD, crc, encoded, measures_by_hand

from talkweave.llm import media, mixing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels: two languages with enough labels for some rules, one without, odd rows; two without ids, two of one id."""
    where, rng = tmp_path_factory.mktemp("queries"), random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    docs, labels = [], []
    for i in range(2600):
        lang, bad, loud = ("en", "de", "fr")[i % 3 if i % 30 else 2], i % 4 == 0, rng.random() < 0.03
        words = [word() + ("|#" if bad and rng.random() < 0.5 or loud and rng.random() < 0.2 else "") for _ in range(rng.randint(40, 90))]
        docs.append((i, " ".join(words).upper() if bad and i % 8 == 0 else " ".join(words), lang, ("a", "b", None)[i % 5 % 3]))
        labels.append((i, 0 if bad else 1))
    docs += [(5000, None, "en", "a"), (5001, "", "en", None), (5002, "a b c " * 60, None, "b"), (5003, "line\n" * 70, "de", "a"), (5004, " ".join(word() for _ in range(9000)), "en", "c")]
    docs += [(None, "no id " * 20, "en", "a"), (None, "none either", None, None), (7, "same id\nother text", "en", "b"), (8, docs[8][1], docs[8][2], docs[8][3])]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), docs, labels


def test_op3(spark, folder):
    where, docs, _ = folder
    got = queries.QUERIES["op3_source_mixing"](spark, where).collect()
    size = {(d, s): set() for d, _, _, s in docs}
    for d, t, _, s in docs:
        size[d, s].add(len(WORD.findall(t or "")))
    total = {}
    for _, t, _, s in docs:
        total[s] = total.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([total[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))]), strict=True))
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r["size"] in size[r.doc_id, r.source] and r.source_size == total[r.source] and r.target == pytest.approx(goal[r.source]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    assert len(got) == len(docs) and sum(goal.values()) == pytest.approx(1.5 * sum(total.values()))
    assert all(abs(taken[s] - goal[s]) <= max(3, 0.01 * goal[s]) for s in names)
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in queries.QUERIES["op3_source_mixing"](spark, where).collect())


def test_op4(spark, folder):
    where, docs, _ = folder
    got = queries.QUERIES["op4_media"](spark, where).collect()
    expected = []
    for d, t, _, _ in docs:
        body = (t or "").encode()
        full = body + b" " * (-len(body) % 192 if body else 192)
        wav = media.wav(full)
        expected.append((d, len(body), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), media.feature(full)))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature)) for r in got)


def test_op5(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op5_language"](spark, SF).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    judged = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id] is not None]
    assert sum(judged) >= 0.97 * len(judged) > 20


def test_op6(spark, folder):
    where, docs, _ = folder
    got = queries.QUERIES["op6_packing"](spark, where).collect()
    ids = {}
    for d, t, _, _ in docs:
        ids.setdefault(d, []).append(encoded(t))
    pieces, sequences = {}, {}
    for r in got:
        fits = [k for k, x in enumerate(ids[r.doc_id]) if len(x) == r.doc_tokens and crc(x[r.start : r.start + r.length]) == r.ids_crc32]
        assert fits and r.length == min(4096, r.doc_tokens - r.start)
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces == {d: sum(map(len, x)) for d, x in ids.items()}
    for spans in sequences.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 4096
    assert sum(pieces.values()) >= 0.98 * 4096 * (len(sequences) - 3)


def rules_by_hand(docs, labels):
    """Certified rules of each language, from the definitions in plain loops."""
    measures = {}
    for k, (_, t, _, _) in enumerate(docs):
        t = t or ""
        n, chars, symbols, dup, repeat = measures_by_hand(t)
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        letters, upper, marks = sum(c.isascii() and c.isalpha() for c in t), sum("A" <= c <= "Z" for c in t), sum(c in "!?" for c in t)
        value = [min(symbols / max(n, 1), 1), min(dup / max(lines, 1), 1), repeat / max(n, 1), min(marks / max(n, 1), 1), upper / max(letters, 1), min(chars / max(n, 1) / 20, 1), min(chars / max(n, 1) / 20, 1)]
        measures[k] = (n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n, dict(zip(quality.RULES, (min(int(v * 200), 200) for v in value), strict=True)))
    told = dict(labels)
    known = [(docs[k][2], zlib.crc32(str(docs[k][0]).encode()) % 3 > 0, told[docs[k][0]], m[6]) for k, m in measures.items() if not m[5] and docs[k][0] in told]
    import numpy as np

    found = {}
    for lang in {x[0] for x in known}:
        grids = {r: np.zeros((2, 201), int) for r in quality.RULES}
        for l, held, good, steps in known:
            if l == lang and not held:
                for r, s in steps.items():
                    grids[r][0 if good else 1, s] += 1
        if rules := quality.sequence(grids):
            found[lang] = rules
    hits = lambda steps, rules: any(steps[r] >= c if quality.RULES[r][1] else steps[r] <= c for r, c in rules)
    kept = {}
    for lang, rules in found.items():
        good = [steps for l, held, q, steps in known if l == lang and held and q]
        n = 0
        while n < len(rules) and good and quality.upper_bound(sum(hits(s, rules[: n + 1]) for s in good), len(good), quality.DELTA / len(found)) <= quality.RISK:
            n += 1
        kept[lang] = rules[:n]
    return measures, lambda k: not measures[k][5] and not hits(measures[k][6], kept.get(docs[k][2], [])), kept


def test_op7(spark, folder):
    where, docs, labels = folder
    measures, keeps, rules = rules_by_hand(docs, labels)
    got = queries.QUERIES["op7_quality"](spark, where).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)) for r in got) == sorted(repr((d[0], *measures[k][:6], keeps(k))) for k, d in enumerate(docs))
    assert any(rules.values()) and sum(not r.kept and not r.base_failed for r in got) > 100


def article_by_hand(page):
    inside = re.search(r"(?s)<article>(.*)</article>", page)[1]
    inside = re.sub(r"<br[^>]*>|</?(?:p|h1|div|ul|li)\b[^>]*>", " ", re.sub(r"(?s)<!--.*?-->", "", inside))
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inside)).split())


def test_op8(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op8_main_text"](spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == article_by_hand(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_op10(spark, folder):
    where, docs, _ = folder
    got = sorted(queries.QUERIES["op10_token_files"](spark, where).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((d[0] for d in docs), key=lambda d: (d is not None, d or 0))
    ids = [(d, encoded(t)) for d, t, _, _ in docs]
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(repr((d, len(x), crc(x))) for d, x in ids)
