"""The corpus pipeline, stage by stage, against brute force on a small table."""

import random

import pytest
from test_corpus import WORD, crc, encoded, measures_by_hand
from test_dedup import components_by_hand, corpus, cut_of_rows

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in corpus(9)]
    rows += [(None, "no id " + " ".join(f"w{i}" for i in range(80)), "en", "a", 1)]
    text = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    # rows without ids and with shared ids: different texts are different documents
    rows += [(None, text(70), "en", "b", 1), (None, text(90), None, None, 1), (8000, text(60), "en", "a", 1), (8000, text(75), "de", "b", 1)]
    rows += [rows[-1], rows[-3], (8001, rows[-1][1], "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (9, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return str(folder), out


def test_stages(stages):
    _, (raw, good, distinct, cut, mixed, packed) = stages
    for rows in (good, distinct, cut, mixed):
        assert [f for f in rows[0].__fields__] == ["doc_id", "text", "lang", "source", "n_chars"]

    def passes(t):
        n, *_, repeat = measures_by_hand(t)
        return n >= 50 and 100 * repeat <= 50 * n

    assert sorted(map(repr, good)) == sorted(repr(r) for r in raw if passes(r.text))
    own = {(r.doc_id, r.text): k for k, r in enumerate(sorted(good, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text)))}
    found = components_by_hand([(k, t) for (_, t), k in own.items()])
    groups = {k: c for k, (_, c, _) in found.items()}
    stay = [(r.doc_id, r.text) for r in distinct]
    assert len(stay) == len(set(stay)) == len({groups[own[x]] for x in stay}) == len(set(groups.values()))
    ids = [d for d, _ in own]
    alone = {(d, t) for d, t in own if d is not None and ids.count(d) == 1}
    assert {x for x in stay if x in alone} >= {x for x in alone if found[own[x]][2] and all(y in alone for y in own if groups[own[y]] == groups[own[x]])}
    assert sorted(d for d, _ in stay if d == 8000) == [8000, 8000] and sum(d is None for d, _ in stay) == 3
    by_hand = [x for x in cut_of_rows(stay) if x[1] == 0 or WORD.search(x[2])]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in cut) == sorted((d, t) for d, _, t in by_hand)
    assert all(r.n_chars == len(r.text) for r in cut)
    words = {}
    for r in cut:
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text))
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in cut} and None in {r.doc_id for r in mixed}
    for s, n in words.items():
        assert sum(len(WORD.findall(r.text)) for r in mixed if r.source == s) <= 2 * n
    texts = {}
    for r in mixed:
        texts.setdefault(r.doc_id, set()).add(tuple(encoded(r.text)))
    assert sum(r.length for r in packed) == sum(len(encoded(r.text)) for r in mixed)
    assert all(any(r.ids_crc32 == crc(t[r.start : r.start + r.length]) for t in texts[r.doc_id]) for r in packed)


def test_run(spark, stages):
    folder, out = stages
    assert corpus_pipeline.run(spark, folder).count() == len(out[-1])


def test_clashing_columns(spark, stages):
    """Columns named like those that stages make: the same rows, and the columns come through."""
    from pyspark.sql import functions as F

    folder, _ = stages
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["_id", "_row", "_copy", "_copies", "_kept", "_taken", "_n", "_shared", "bin", "doc", "key", "size", "n_removed", "n_bytes", "kept", "component_id", "taken", "copies", "base_failed", "row", "anchor", "ranges", "_0", "carried 0"]
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = stage(spark, docs, folder), stage(spark, wide, folder)
        assert more.columns == plain.columns + names
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, more.select(*plain.columns).collect())), name
        assert more.select(*names).distinct().count() <= 1
    assert sorted(map(repr, corpus_pipeline.pack(spark, docs, folder).collect())) == sorted(map(repr, corpus_pipeline.pack(spark, wide, folder).collect()))
