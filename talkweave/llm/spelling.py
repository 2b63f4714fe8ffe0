"""Spelling variants in the vocabulary of a corpus, by letter-parity masks.

A word's mask has a bit for each letter (rare accented ones share some), set if it has an odd number of them. One inserted or deleted
letter flips one bit, a replaced one two at most, so of three bands of the mask at least one is equal in any two
words that differ by one edit. Words meet under (band, its bits, length): in the group of a length are the words of that length and those of one
more, so lengths fit before anything is compared. A pair that shares several bands counts in the first of them.

Inside a group only words are compared that agree in their first or in their second half, since an edit touches one of them: rows are sorted by either
half, and pairs within a stretch of equal halves remain if their masks differ in two bits at most. Those are verified letter by letter. No
pair is ever a row: a task emits, for each word, how many near ones it saw and the best of them. Groups are cut into blocks of about BLOCK words or
BLOCK_BYTES, and each pair of blocks is a unit of its own, so a hot group (a frequent parity pattern, which grows with the
vocabulary) spreads over the cluster, and no task holds more than two blocks and a batch.

A word's form is its most frequent near word (ties: first in code-point order), if at least RATIO times as frequent. Counts
grow along forms, so chains end; the last word is found by pointer doubling.

Defined results: null texts have no words; a row without doc_id loses no letters; repeated rows count again; extra columns stay aside; an
empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm import rows, storage, workers

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
BLOCK, BLOCK_BYTES = 32768, 4 << 20
SMALL = 48
PAIRS_AT_ONCE = 1 << 20
#: Fixed order: letters of several European languages, frequent ones first, so that the three bands come out alike.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
BAND_BITS = 21
BAND = (1 << BAND_BITS) - 1
#: Band and bit of a code point: nine bits for the letters, twelve for the others.
BIT_OF = {ord(c): 1 << BAND_BITS * (k % 3) + k // 3 for k, c in enumerate(LETTERS)} | {0xC0 + k: 1 << BAND_BITS * (k % 3) + 9 + k // 3 % 12 for k in range(64)}


def parity(word: str) -> int:
    """The mask of a word, 63 bits."""
    mask = 0
    for c in word:
        mask ^= BIT_OF[ord(c)]
    return mask


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the runs of letters of whole texts, with a letter deleted where the checksum of doc_id and run says so."""
    text = F.col("text").cast("string")
    runs = docs.select(F.col("doc_id").cast("long").cast("string").alias("_id"), F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}"), F.lit(0))).alias("_run"))
    lower = runs.select("_id", F.translate("_run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("_run"))
    told = lower.select("_run", F.expr("crc32(cast(concat(_id, ':', _run) as binary))").alias("_h"))
    word = F.expr("if(_h % 31 = 0, concat(substring(_run, 1, cast(_h % char_length(_run) as int)), substring(_run, cast(_h % char_length(_run) as int) + 2)), _run)")
    return told.select(word.alias("word")).where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def masked(words: DataFrame) -> DataFrame:
    """word, n, mask, size (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.drop()
        for batch in batches:
            told = batch.column("word").to_pylist()
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array([parity(w) for w in told], pa.int64()), pa.array([len(w) for w in told], pa.int32())], names=["word", "n", "mask", "size"])

    return words.mapInArrow(run, "word string, n long, mask long, size int")


def first_difference(a: str, b: str) -> int:
    """The length of the longest common prefix, by bisection on slices."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def near(a: str, b: str) -> bool:
    """Do they differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = first_difference(a, b)
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _pairs(masks: np.ndarray, order: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose masks differ in two bits at most, within each stretch of `order` (bounds: where stretches begin, and the end)."""
    m, sizes = masks[order], np.diff(bounds)
    # many small stretches: all pairs (place, later place of the stretch) as index arrays
    places = np.flatnonzero(np.repeat(sizes < SMALL, sizes))
    later = np.repeat(bounds[1:], sizes)[places] - 1 - places
    total = np.cumsum(later)
    at = 0
    while at < len(places):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        n = later[at:to]
        i = np.repeat(places[at:to], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = np.bitwise_count(m[i] ^ m[j]) <= 2
        yield order[i[ok]], order[j[ok]]
        at = to
    # large ones: matrices of a stripe of places and all later ones
    for k in np.flatnonzero(sizes >= SMALL):
        lo, hi = int(bounds[k]), int(bounds[k + 1])
        while lo < hi - 1:
            width = hi - lo - 1
            end = min(lo + max(1, PAIRS_AT_ONCE // width), hi)
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(m[lo:end, None] ^ m[None, lo + 1 : hi]) <= 2), width)
            ok = j >= i
            yield order[lo + i[ok]], order[lo + 1 + j[ok]]
            lo = end


def candidates(masks: np.ndarray, halves: list[np.ndarray], sides: np.ndarray, bounds: np.ndarray, band: np.ndarray, longer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of each unit (bounds: where units begin, and the end) that agree in a half, whose masks differ in two bits at most and
    whose lengths fit. A unit of two blocks (sides 0 and 1) reports pairs across them; pairs that met in an earlier band are left to that."""
    sizes = np.diff(bounds)
    across = np.repeat(np.maximum.reduceat(sides, bounds[:-1]), sizes) > 0
    unit = np.repeat(np.arange(len(sizes)), sizes)
    for h, half in enumerate(halves):
        order = np.lexsort((half, unit))
        new = np.flatnonzero((np.diff(half[order]) != 0) | (np.diff(unit[order]) != 0)) + 1
        for i, j in _pairs(masks, order, np.concatenate([[0], new, [len(order)]])):
            differing = masks[i] ^ masks[j]
            ok = ~(longer[i] & longer[j]) & (~across[i] | (sides[i] != sides[j]))
            if h:
                ok &= halves[0][i] != halves[0][j]
            for k in range(2):
                ok &= (band[i] <= k) | (differing >> np.uint64(BAND_BITS * k) & np.uint64(BAND) != 0)
            yield i[ok], j[ok]


def best_near(units: pa.Table) -> pa.RecordBatch | None:
    """word, seen (near words in these units), best, best_n of rows of whole units, in order of unit and side."""
    key, unit = units.column("key").to_numpy(), units.column("unit").to_numpy()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])
    bounds = np.append(np.flatnonzero(new), len(key))
    masks, size, n = units.column("mask").to_numpy().astype(np.uint64), units.column("size").to_numpy(), units.column("n").to_numpy()
    length = key & (1 << 32) - 1
    words = units.column("word").to_pylist()
    halves = [np.array([hash(w[cut]) for w, cut in zip(words, cuts, strict=True)], np.int64) for cuts in ([slice(0, k // 2) for k in length.tolist()], [slice(-(k // 2), None) for k in length.tolist()])]
    left: list[int] = []
    right: list[int] = []
    for i, j in candidates(masks, halves, units.column("side").to_numpy(), bounds, key >> 60, size > length):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if near(words[a], words[b]):
                left.append(a)
                right.append(b)
    if not left:
        return None
    # each end of a pair sees the other; rows are ranked by count, then code points
    places = sorted({*left, *right}, key=lambda k: (-n[k], words[k]))
    rank = np.zeros(len(key), np.int64)
    rank[places] = np.arange(len(places))
    me, other = np.array(left + right), rank[np.array(right + left)]
    order = np.lexsort((other, me))
    first = np.flatnonzero(np.diff(me[order], prepend=-1))
    seen = np.diff(np.append(first, len(order)))
    best = [places[k] for k in other[order][first].tolist()]
    return pa.record_batch([pa.array([words[k] for k in me[order][first].tolist()], pa.string()), pa.array(seen, pa.int64()), pa.array([words[k] for k in best], pa.string()), pa.array(n[best], pa.int64())], names=["word", "seen", "best", "best_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n: near words of each word that has any. words: word, n, mask, size, read three times."""
    # length below, band and its bits above
    key = "shiftleft(cast({0} as bigint), 60) | shiftleft(shiftright(mask, {1}) & {2}L, 32) | cast({3} as bigint)"
    keys = F.explode(F.expr(f"filter(array({', '.join(f'if({size} >= {MIN_LENGTH}, {key.format(k, BAND_BITS * k, BAND, size)}, null)' for k in range(3) for size in ('size', 'size - 1'))}), k -> k is not null)"))
    met = words.select("word", "n", "mask", "size", keys.alias("key"))
    groups = met.groupBy("key").agg(F.count("*").alias("_m"), F.sum(F.octet_length("word")).alias("_b"))
    groups = storage.staged(groups.select("key", "_m", F.greatest(F.ceil(F.col("_m") / BLOCK), F.ceil(F.col("_b") / BLOCK_BYTES)).cast("int").alias("_blocks")), "spelling-groups")
    cut = groups.where("_blocks > 1").select("key", "_blocks")
    cut = F.broadcast(cut) if cut.count() <= rows.BROADCAST_ROWS else cut
    block = F.expr("cast(pmod(xxhash64(word), coalesce(_blocks, 1)) as int)")
    dealt = met.join(cut, "key", "left").withColumn("_mine", block).withColumn("_other", F.explode(F.expr("sequence(0, coalesce(_blocks, 1) - 1)")))
    unit = F.expr("shiftleft(cast(least(_mine, _other) as bigint), 32) | cast(greatest(_mine, _other) as bigint)")
    sent = dealt.select("word", "n", "mask", "size", "key", unit.alias("unit"), F.expr("cast(_mine > _other as int)").alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.drop()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ends = pa.compute.and_(*(pa.compute.equal(batch.column(c), batch.column(c)[-1]) for c in ("key", "unit"))) if len(batch) else None
            whole = len(batch) - (ends.true_count if len(batch) else 0)  # the last unit may go on in the next batch
            if whole:
                if (out := best_near(pa.Table.from_batches([*held, batch.slice(0, whole)]))) is not None:
                    yield out
                held = []
            if len(batch):
                held.append(batch.slice(whole))
        if held and (out := best_near(pa.Table.from_batches(held))) is not None:
            yield out

    seen = sent.repartition("key", "unit").sortWithinPartitions("key", "unit", "side").mapInArrow(run, "word string, seen long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("_less"), F.col("best")))
    return seen.groupBy("word").agg(F.sum("seen").alias("n_near"), best.alias("_x")).select("word", "n_near", F.col("_x.best").alias("best"), (-F.col("_x._less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (word, form; staged) ends. Each round follows twice as many forms as the one before."""
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ends = storage.staged(ends.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if not ends.where("_moved").limit(1).count():
            return ends.select("word", "root")
        ends = ends.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least MIN_LENGTH code points and MIN_COUNT occurrences."""
    storage.bounded_batches(docs.sparkSession)
    words = storage.staged(masked(vocabulary(docs)), "spelling-words")
    met = storage.staged(near_words(words).join(words.select("word", "n"), "word"), "spelling-near")
    is_form: Column = F.col("best_n") >= RATIO * F.col("n")
    forms = met.where(is_form).select("word", F.col("best").alias("form"))
    told = words.select("word", "n").join(met.select("word", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "word", "left")
    told = told.join(roots(forms), "word", "left")
    return told.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
