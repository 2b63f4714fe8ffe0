"""How filters of documents overlap: what each one removes in every order, and what is lost of good and toxic ones.

Every document gets a mask, one bit a filter that it fails. Most filters look at its text alone; the last one, DUPLICATE, fails a
text that a document with a smaller id has too, whatever other filters say of that one. It is decided on an RDD routed by fingerprint: a record
goes to the partition that the xxhash of its text names and meets its equals there in the order of the hash. A hash's chain
holds each distinct text in full with the smallest id so far, so different texts under one hash stay apart; whoever
isn't the smallest is passed on as failing. The same is done before the shuffle for as many texts as
HELD_BYTES hold, so a text with copies in a third of all rows is sent once or a few times per
input partition, and its copies travel as ids, spread evenly. Sorting spills, and chains end with their hash: memory is bounded by HELD_BYTES, not by groups.

Masks become counts by combineByKey: one vector of counts per part and input partition, merged by part. Orders, steps and
Shapley values are sums over that vector alone, so documents are read once for all orders.

Defined results: a null text is empty, a null lang the part ''; a row without doc_id is no copy of any and none is of it; rows that share doc_id
and text are counted each, and neither is the other's copy; several labels of a document count as good (toxic) if any
is; labels of absent documents and extra columns don't matter; an empty table has no parts and so no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import workers

HELD_BYTES = 16 << 20
ROUTE_BYTES = 64 << 20
MAX_ROUTES = 1 << 16
UPPER = bytes(range(65, 91))
MARKED = re.compile(r"[#$%&*|]")


def few_words(text: str) -> bool:
    return len(text.encode("utf-8", "replace").split()) < 200  # bytes split at the six white-space bytes alone


def repeated_words(text: str) -> bool:
    words = text.encode("utf-8", "replace").split()
    return 100 * len(set(words)) < 50 * len(words)


def upper_case(text: str) -> bool:
    data = text.encode("utf-8", "replace")
    return 100 * (len(data) - len(data.translate(None, UPPER))) > 3 * len(text)


def marked(text: str) -> bool:
    return MARKED.search(text) is not None


#: Filters by name: is a text failing? In the order of their bits; DUPLICATE comes after them.
FILTERS: dict[str, Callable[[str], bool]] = {"A": few_words, "B": repeated_words, "C": upper_case, "D": marked}
DUPLICATE = "E"

#: A text's entry in a chain: the text, the smallest doc_id with it, rows of that id by part, and the mask.
Entry = list
#: What travels: a text that is the smallest of its kind so far, or None where a row is decided; doc_id; (part, rows) pairs; mask.
Sent = tuple[str | None, int | None, tuple, int]


def met(chains: dict[int, list[Entry]], at: int, text: str, doc_id: int, parts: Iterable[tuple[str, int]], mask: Callable[[], int], duplicate: int) -> Iterator[Sent]:
    """Put a text into its chain; yields whom that shows not to be the smallest of its text."""
    chain = chains.setdefault(at, [])
    entry = next((e for e in chain if e[0] == text), None)
    if entry is None:
        chain.append([text, doc_id, dict(parts), mask()])
    elif doc_id == entry[1]:
        for part, n in parts:
            entry[2][part] = entry[2].get(part, 0) + n
    elif doc_id > entry[1]:
        yield None, doc_id, tuple(parts), entry[3] | duplicate
    else:
        yield None, entry[1], tuple(entry[2].items()), entry[3] | duplicate
        entry[1], entry[2] = doc_id, dict(parts)


def routed(rows: RDD, filters: dict[str, Callable[[str], bool]], routes: int) -> RDD:
    """(doc_id, part, mask, rows) of (doc_id, part, text): what each row fails, duplicates included."""
    tests = list(filters.values())
    duplicate = 1 << len(tests)

    def mask_of(text: str) -> int:
        return sum(1 << k for k, fails in enumerate(tests) if fails(text))

    def spread(doc_id: int | None) -> int:
        return xxhash.xxh3_64_intdigest(repr(doc_id))

    def before(partition: Iterator[tuple[int | None, str, str]]) -> Iterator[tuple[int, Sent]]:
        workers.drop()
        chains: dict[int, list[Entry]] = {}
        held = 0

        def left() -> Iterator[tuple[int, Sent]]:
            for at, chain in chains.items():
                for text, doc_id, parts, mask in chain:
                    yield at, (text, doc_id, tuple(parts.items()), mask)

        for doc_id, part, text in partition:
            if doc_id is None:
                yield spread(len(text)), (None, None, ((part, 1),), mask_of(text))
                continue
            at = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
            known = len(chains)
            for sent in met(chains, at, text, doc_id, ((part, 1),), lambda t=text: mask_of(t), duplicate):
                yield spread(sent[1]), sent
            if len(chains) > known:
                held += len(text) + 200
            if held > HELD_BYTES:
                yield from left()
                chains.clear()
                held = 0
        yield from left()

    def after(partition: Iterator[tuple[int, Sent]]) -> Iterator[tuple[int | None, str, int, int]]:
        chains: dict[int, list[Entry]] = {}
        for at, (text, doc_id, parts, mask) in partition:
            if at not in chains:
                yield from ended(chains)
                chains.clear()
            if text is None:
                yield from ((doc_id, part, mask, n) for part, n in parts)
            else:
                for _, late, whose, failed in met(chains, at, text, doc_id, parts, lambda m=mask: m, duplicate):
                    yield from ((late, part, failed, n) for part, n in whose)
        yield from ended(chains)

    def ended(chains: dict[int, list[Entry]]) -> Iterator[tuple[int, str, int, int]]:
        for chain in chains.values():
            for _, doc_id, parts, mask in chain:
                yield from ((doc_id, part, mask, n) for part, n in parts.items())

    return rows.mapPartitions(before).repartitionAndSortWithinPartitions(routes, lambda at: at % routes).mapPartitions(after)


def failures(docs: DataFrame, filters: dict[str, Callable[[str], bool]] = FILTERS) -> DataFrame:
    """doc_id, part (its lang), mask (bit k: fails the k-th filter; the bit after those: a duplicate), n (equal rows)."""
    spark = docs.sparkSession
    text, part = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text")).rdd
    size = docs.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0.0
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(size / ROUTE_BYTES), MAX_ROUTES))
    return spark.createDataFrame(routed(rows, filters, routes), "doc_id long, part string, mask int, n long", verifySchema=False)


def count_vectors(failed: DataFrame, labels: DataFrame, filters: int) -> RDD:
    """(part, vector): documents, good ones and toxic ones by mask, three blocks of 2^filters counts."""
    size = 1 << filters
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.max(F.expr("cast(quality = 1 as int)")).alias("good"), F.max(F.expr("cast(toxic = 1 as int)")).alias("toxic"))
    each = failed.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))  # a hot id is one row per part and mask before it meets labels
    told = each.join(known, each["doc_id"] == known["_labelled"], "left").select("part", "mask", "n", F.expr("coalesce(good, 0)"), F.expr("coalesce(toxic, 0)"))

    def add(vector: list[int], row: tuple[int, int, int, int]) -> list[int]:
        mask, n, good, toxic = row
        vector[mask] += n
        vector[size + mask] += n * good
        vector[2 * size + mask] += n * toxic
        return vector

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b, strict=True)]

    return told.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: add([0] * (3 * size), row), add, merge, int(failed.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def steps_of(vector: list[int], names: str) -> Iterator[tuple[str, int, int, int, int, int, int, int, int]]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters."""
    size, orders = 1 << len(names), math.factorial(len(names))
    count, good, toxic = vector[:size], vector[size : 2 * size], vector[2 * size :]
    # of the filters that a document fails, each comes first in an equal share of all orders
    shapley = [sum(count[m] * orders // m.bit_count() for m in range(size) if m >> k & 1) for k in range(len(names))]
    for order in itertools.permutations(range(len(names))):
        earlier = 0
        for step, k in enumerate(order, 1):
            here = [m for m in range(size) if m >> k & 1 and not m & earlier]
            redundant = sum(count[m] for m in range(size) if m >> k & 1 and m & earlier)
            earlier |= 1 << k
            kept = sum(count[m] for m in range(size) if not m & earlier)
            yield "".join(names[j] for j in order), step, kept, sum(count[m] for m in here), redundant, count[1 << k], sum(good[m] for m in here), sum(toxic[m] for m in here), shapley[k]


def interactions(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[str], bool]] = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part and all orders of the filters and DUPLICATE."""
    names = "".join(filters) + DUPLICATE
    vectors = count_vectors(failures(docs, filters), labels, len(names))
    rows = vectors.flatMap(lambda kv: ((kv[0], *step) for step in steps_of(kv[1], names)))
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return docs.sparkSession.createDataFrame(rows, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts), verifySchema=False)
