"""The filter audit against plain loops, and its odd cases."""

import itertools

from talkweave.llm import audit, queries

LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, LONG, "en"), (2, LONG, "de"), (2, LONG, "de"), (2, "other text", "de"), (3, None, "en"), (4, "", None), (5, "", ""), (None, LONG, "en"), (None, None, None),
    (6, "A B " * 200, "fr"), (7, "# " * 10, "fr"), (8, LONG + " $", "en"), (0, "late smallest", "en"), (9, "late smallest", "en"), (-5, "late smallest", "fr"), (10, "x" * 200_000, "en"), (10, "é É Ü" * 300, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (9, 1, None), (None, 1, 1), (99, 1, 1), (4, None, 1)]


def tables(spark, docs=DOCS, labels=LABELS):
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], "doc_id long, text string, lang string, part int, mask int, n int")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def by_hand(docs, labels):
    def fails(i, t):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        first = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": first}

    each = [(lang or "", fails(i, t or ""), any(j == i and i is not None and q == 1 for j, q, _ in labels), any(j == i and i is not None and x == 1 for j, _, x in labels)) for i, t, lang in docs]
    out = set()
    for part in {e[0] for e in each}:
        mine = [e for e in each if e[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for e in mine:
                if hit := [k for k in order if e[1][k]]:
                    shapley[hit[0]] += 1
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [e for e in left if e[1][k]]
                left = [e for e in left if not e[1][k]]
                failing = sum(e[1][k] for e in mine)
                out.add((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(e[1][k] and sum(e[1].values()) == 1 for e in mine), sum(e[2] for e in gone), sum(e[3] for e in gone), shapley[k]))
    return out


def test_against_loops(spark):
    got = audit.interactions(*tables(spark)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == by_hand(DOCS, LABELS)


def test_many_copies_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD_BYTES", 2000)
    docs = [(i, "hot text" if i % 3 else f"text {i % 40}", "en" if i % 2 else None) for i in range(500)]
    rows = spark.sparkContext.parallelize([(i, lang or "", t) for i, t, lang in docs], 7)
    got = audit.routed(rows, audit.FILTERS, 5).collect()
    least = {}
    for i, t, _ in docs:
        least[t] = min(least.get(t, i), i)
    assert sorted((i, m >> 4) for i, _, m, _ in got) == sorted((i, int(i > least[t])) for i, t, _ in docs) and all(n == 1 for *_, n in got)


def test_equal_hashes_stay_apart(spark, monkeypatch):
    class Same:
        @staticmethod
        def xxh3_64_intdigest(_):
            return 7

    monkeypatch.setattr(audit, "xxhash", Same)
    chains = {}
    sent = [s for i, t in [(3, "a"), (1, "a"), (2, "b"), (4, "b"), (1, "a")] for s in audit.met(chains, 7, t, i, (("p", 1),), lambda: 0, 16)]
    assert sent == [(None, 3, (("p", 1),), 16), (None, 4, (("p", 1),), 16)] and chains == {7: [["a", 1, {"p": 2}, 0], ["b", 2, {"p": 1}, 0]]}


def test_empty(spark):
    d, l = tables(spark)
    assert audit.interactions(d.where("false"), l).count() == 0
    got = {tuple(r) for r in audit.interactions(d, l.where("false")).collect()}
    assert got == by_hand(DOCS, [])
    assert queries.QUERIES["op11_filter_audit"](spark, "/root/testdata/sf0.001").count() == 600 * 4
