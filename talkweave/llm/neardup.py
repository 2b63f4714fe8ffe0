"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct five-word shingles (64-bit hashes). Its signature
is CHUNKS * CHUNK b-bit minhashes (b = 16). Two signatures at a distance (number of unequal
minhashes) of at most DISTANCE = CHUNKS * (ERRORS + 1) - 1 = 21 have, by pigeonhole, a chunk
with at most ERRORS = 1 unequal minhash; so each chunk is filed once for every minhash that
may be wrong, under the four others, and all pairs within that distance meet in
a bucket. A pair at similarity 0.75 agrees in a chunk up to one error with
probability 0.63, so it meets nowhere with probability 0.37^11 = 1.6e-5, whatever its distance.

Every link is confirmed on full sets: 100 * intersection >= 75 * union. Buckets are not
expanded into all pairs:
1. Equal sets become one class (a plain aggregation), so groups of copies never meet.
2. Star rounds: each document is compared with one member of one of its buckets, first the
   smallest, then a random one of another component. Confirmed links merge components.
3. Best-match rounds: each document in a bucket of several components is compared, in one of these buckets, with the
   member of another component whose signature is nearest, within DISTANCE.
4. What then still shares a bucket across components is compared pair by pair inside the bucket, each pair in the first
   bucket it shares, whatever the distance of its signatures. Sets go only to buckets that need them, and
   only links come out, so pairs are never rows. Members of a bucket's largest component (near copies
   of one text may be a third of all documents) only meet those outside it, in blocks.
Rounds 2 and 3 make one candidate a document; they only shorten the exact step 4, which
loses no link between different texts that share a bucket. Joins on a hot bucket or star
centre are plain sort-merge joins that adaptive execution splits.

Defined results: null, empty or white-space texts have an empty set, linked with
nothing; texts of fewer than five words are one shingle; repeated rows share a
class; a row with a null doc_id has null component and is kept; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import bytetext, graph, storage, workers

WORDS = 5
THRESHOLD = 75
CHUNKS, CHUNK, ERRORS = 11, 5, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
STAR_ROUNDS, BEST_ROUNDS = 2, 1
BLOCK = 512
_RNG = np.random.default_rng(7)
FACTORS = _RNG.integers(1, 1 << 62, CHUNKS * CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _RNG.integers(1, 1 << 62, CHUNKS * CHUNK, dtype=np.uint64)
WORD_FACTORS = _RNG.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MAX_ROWS = 1 << 15


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted alike in every text, and the number before each text."""
    data = bytetext.LOWER[data]
    starts, ends, before = bytetext.words(data, offsets)
    h = bytetext.names_of(data, starts, ends)
    n, rows = np.diff(before), bytetext.row_of(before)
    at = np.flatnonzero(rows[WORDS - 1 :] == rows[: len(rows) - WORDS + 1]) if len(h) >= WORDS else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        value += h[at + k] * WORD_FACTORS[k]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    short = np.zeros(len(few), np.uint64)
    for k in range(WORDS - 1):
        has = n[few] > k
        short[has] += h[before[few[has]] + k] * WORD_FACTORS[k]
    value = bytetext.mix(np.concatenate([value, short + n[few].astype(np.uint64)]))
    row = np.concatenate([rows[at], few])
    if len(offsets) > MAX_ROWS:
        raise ValueError("too many texts in a slice")
    key = row.astype(np.uint64) << np.uint64(48) | value >> np.uint64(16)
    order = np.argsort(key)
    if ((np.diff(key[order]) == 0) & (np.diff(value[order]) != 0)).any():  # the low bits decide somewhere
        order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def signatures(value: np.ndarray, before: np.ndarray) -> np.ndarray:
    """16-bit minhashes of every non-empty set, one row each."""
    full = before[:-1][before[:-1] < before[1:]]
    out = np.zeros((len(full), len(FACTORS)), np.uint16)
    for k, factor in enumerate(FACTORS):
        out[:, k] = bytetext.mix(np.minimum.reduceat(value * factor, full)) >> np.uint64(48) if len(full) else 0
    return out


def small_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at in range(0, len(texts), MAX_ROWS - 1):
        for row, end, data, offsets in bytetext.slices(texts.slice(at, MAX_ROWS - 1)):
            yield at + row, at + end, data, offsets


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that name the set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.drop()
        for batch in batches:
            for row, end, data, offsets in small_slices(batch.column("text")):
                value, before = shingles(data, offsets)
                n = np.diff(before)
                full = n > 0
                first = before[:-1][full]
                names, sig = np.zeros((2, len(n)), np.uint64), np.empty(len(n), object)
                if len(first):
                    names[0, full] = np.add.reduceat(value, first)
                    names[1, full] = np.add.reduceat(bytetext.mix(value + np.uint64(1)), first)
                sig[full] = [x.tobytes() for x in signatures(value, before)]
                sig[~full] = b""
                yield pa.record_batch([batch.column("doc_id").slice(row, end - row), pa.array(n, pa.int64()), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    storage.bounded_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of every signature: one for each chunk and each minhash of it that may be wrong."""
    terms = bytetext.mix(sig.astype(np.uint64) + PLACES).reshape(len(sig), CHUNKS, CHUNK)
    which = (np.arange(CHUNKS * CHUNK, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(CHUNKS, CHUNK)
    return bytetext.mix(terms.sum(axis=2, dtype=np.uint64)[:, :, None] - terms + which).reshape(len(sig), -1)


def filed(representatives: DataFrame) -> DataFrame:
    """(key, doc_id) of every bucket that a signature belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = bucket_keys(np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, -1))
                ids = np.repeat(part.column("doc_id").to_numpy(), keys.shape[1])
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "doc_id"])

    return representatives.select("doc_id", "signature").mapInArrow(run, "key long, doc_id long")


def held_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, shingles of the wanted documents, written to the shared folder."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in small_slices(batch.column("text")):
                value, before = shingles(data, offsets)
                raw = value.tobytes()
                blobs = [raw[8 * a : 8 * b] for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                yield pa.record_batch([batch.column("doc_id").slice(row, end - row), pa.array(blobs, pa.binary())], names=["doc_id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id", "left_semi")
    return storage.staged(texts.mapInArrow(sets, "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "near-sets", "lz4")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= threshold * union on full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                inside = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inside >= threshold * (len(x) + len(y) - inside))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    for c in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}")), c)
    return storage.staged(pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "near-links")


def star_pairs(members: DataFrame, salt: int) -> DataFrame:
    """One pair a document: with the leader of one of its buckets, if that is of another component. members: key, doc_id, component."""
    by = F.col("doc_id") if not salt else F.xxhash64(F.lit(salt), "doc_id")
    leaders = members.groupBy("key").agg(F.min(F.struct(by.alias("by"), "doc_id", "component")).alias("leader"))
    found = members.join(leaders, "key").where("component <> leader.component")
    return found.groupBy(F.col("doc_id").alias("b")).agg(F.min(F.struct(F.xxhash64(F.lit(salt), "key"), F.col("leader.doc_id").alias("a"))).alias("x")).select("x.a", "b")


def first_shared_key(sig: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """The key of the first bucket that a signature shares with others, given which of its minhashes each of them equals."""
    wrong = ~equal.reshape(len(equal), CHUNKS, CHUNK)
    errors = wrong.sum(axis=2)
    chunk = (errors <= ERRORS).argmax(axis=1)
    place = wrong[np.arange(len(equal)), chunk].argmax(axis=1)
    return bucket_keys(sig[None])[0][chunk * CHUNK + place]


def in_blocks(members: DataFrame) -> DataFrame:
    """Members of each bucket with their block `own` and the pair of blocks (i, j) they are compared in, so that a task holds two blocks of BLOCK members at a time.

    Pairs inside the bucket's largest component are settled, so blocks are of outsiders (the first ones) or of insiders,
    and a pair of blocks has outsiders in one at least: a bucket of n members, o of them outsiders, makes about 2 * o * n / BLOCK rows.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("most"), (F.sum("size") - F.max("size")).alias("outside"), F.sum("size").alias("all"))
    outside, inside = F.ceil(F.col("outside") / BLOCK), F.ceil((F.col("all") - F.col("outside")) / BLOCK)
    known = members.join(largest, "key").withColumn("out", F.col("component") != F.col("most"))
    own = F.when(F.col("out"), F.pmod(F.xxhash64("doc_id"), outside)).otherwise(outside + F.pmod(F.xxhash64("doc_id"), inside)).cast("int")
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("out"), outside + inside).otherwise(outside) - 1)
    dealt = known.where("outside > 0").withColumn("own", own).withColumn("other", F.explode(others)).drop("most", "outside", "all", "out")
    return dealt.withColumn("i", F.least("own", "other").cast("int")).withColumn("j", F.greatest("own", "other").cast("int"))


def by_group(df: DataFrame, columns: list[str], work: Callable[[tuple, dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run work((key, i, j), columns as lists) on every group of rows, one group at a time."""
    dealt = df.select("key", "i", "j", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in columns}
        last = None
        workers.drop()
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                group = tuple(int(x) for x in ids[:, a])
                if group != last:
                    if last is not None and (out := work(last, held)) is not None:
                        yield out
                    held, last = {c: [] for c in columns}, group
                for c in columns:
                    held[c] += batch.column(c).slice(a, b - a).to_pylist()
        if last is not None and (out := work(last, held)) is not None:
            yield out

    return dealt.mapInArrow(run, schema)


class Bucket:
    """Signatures of a group's members, and who is near whom across components."""

    def __init__(self, group: tuple, held: dict) -> None:
        self.key = np.int64(group[0]).view(np.uint64)
        self.mixed = group[1] != group[2]
        self.ids, self.component, self.own = (np.array(held[c]) for c in ("doc_id", "component", "own"))
        self.sig = np.frombuffer(b"".join(held["signature"]), np.uint16).reshape(len(self.ids), -1)

    def outsiders(self) -> np.ndarray:
        """Members outside the largest component; each pair of two components has one."""
        values, counts = np.unique(self.component, return_counts=True)
        return np.flatnonzero(self.component != values[counts.argmax()])

    def near(self, k: int, least: int = CHUNKS * CHUNK - DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members of other components (and, between two blocks, of the other block) with at least so many minhashes equal to member k's: places, equal minhashes, which are equal."""
        same = self.sig == self.sig[k]
        equal = same.sum(axis=1)
        ok = (equal >= least) & (self.component != self.component[k])
        if self.mixed:
            ok &= self.own != self.own[k]
        at = np.flatnonzero(ok)
        return at, equal[at], same[at]

    def owned(self, k: int) -> np.ndarray:
        """Those of other components whose pair with k belongs to this bucket: the first that both share."""
        at, _, same = self.near(k, 0)
        return at[first_shared_key(self.sig[k], same) == self.key] if len(at) else at


def best_pairs(members: DataFrame, salt: int) -> DataFrame:
    """(a, b): each document asks in one of its buckets for the nearest member of another component. members: key, n, doc_id, component, signature."""
    asked = members.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(F.lit(salt), "key").alias("by"), "key")).alias("x")).select(F.col("doc_id").alias("_doc"), F.col("x.key").alias("_key"))
    asking = members.join(asked, members["doc_id"] == asked["_doc"]).withColumn("ask", F.col("key") == F.col("_key"))

    def work(group: tuple, held: dict) -> pa.RecordBatch | None:
        bucket, out = Bucket(group, held), []
        for k in np.flatnonzero(np.array(held["ask"])):
            at, equal, _ = bucket.near(k)
            if len(at):
                best = int(equal.argmax())
                out.append((int(bucket.ids[k]), int(bucket.ids[at[best]]), int(equal[best])))
        cols = list(zip(*out, strict=True))
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["a", "b", "equal"]) if out else None

    found = by_group(in_blocks(asking), ["doc_id", "component", "own", "signature", "ask"], work, "a long, b long, equal int")
    return found.groupBy("a").agg(F.max(F.struct("equal", "b")).alias("x")).select("a", "x.b")


def links_across(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): confirmed links between different components; of those between a document and a component, one. members: key, n, doc_id, component, signature."""

    def needed(group: tuple, held: dict) -> pa.RecordBatch | None:
        bucket = Bucket(group, held)
        wanted = np.zeros(len(bucket.ids), bool)
        for k in bucket.outsiders():
            at = bucket.owned(k)
            if len(at):
                wanted[at] = wanted[k] = True
        at = np.flatnonzero(wanted)
        if not len(at):
            return None
        same = [np.full(len(at), x, t) for x, t in zip(group, (np.int64, np.int32, np.int32), strict=True)]
        return pa.record_batch([pa.array(x) for x in (*same, bucket.own[at].astype(np.int32), bucket.ids[at], bucket.component[at])] + [pa.array([held["signature"][x] for x in at], pa.binary())], names=["key", "i", "j", "own", "doc_id", "component", "signature"])

    def confirm(group: tuple, held: dict) -> pa.RecordBatch | None:
        bucket = Bucket(group, held)
        sets_ = [np.frombuffer(x, np.uint64) for x in held["shingles"]]
        size = np.array([len(x) for x in sets_])
        out = []
        for k in bucket.outsiders():
            at = bucket.owned(k)
            at = at[100 * np.minimum(size[at], size[k]) >= threshold * np.maximum(size[at], size[k])]
            joined: set[int] = set()
            for other in at:
                if int(bucket.component[other]) in joined:
                    continue
                both = np.sort(np.concatenate([sets_[k], sets_[other]]))
                inside = int((both[1:] == both[:-1]).sum())
                if 100 * inside >= threshold * (size[k] + size[other] - inside):
                    joined.add(int(bucket.component[other]))
                    out.append((int(bucket.ids[k]), int(bucket.ids[other])))
        cols = list(zip(*out, strict=True))
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["a", "b"]) if out else None

    rows = by_group(in_blocks(members), ["doc_id", "component", "own", "signature"], needed, "key long, i int, j int, own int, doc_id long, component long, signature binary")
    full = storage.staged(rows, "near-open").join(sets, "doc_id")
    return storage.staged(by_group(full, ["doc_id", "component", "own", "signature", "shingles"], confirm, "a long, b long"), "near-links")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    sets = storage.staged(signed(docs), "near-signatures")
    classes = sets.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("representative"))
    classes = storage.staged(classes.where("representative is not null"), "near-classes")
    signatures_of = sets.join(classes.select(F.col("representative").alias("doc_id")), "doc_id", "left_semi").where("n_shingles > 0").dropDuplicates(["doc_id"])
    signatures_of = storage.staged(signatures_of.select("doc_id", "signature"), "near-representatives")
    keys = filed(signatures_of)
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = storage.staged(keys.join(counts, "key").withColumn("component", F.col("doc_id")), "near-buckets")
    held = held_sets(docs, members.select("doc_id").distinct())
    links = labels = None

    def merged(found: DataFrame) -> bool:
        """Add links, and keep only members of buckets that still hold different components."""
        nonlocal links, labels, members
        if links is not None and not found.limit(1).count():
            return False
        links = found if links is None else links.union(found)
        labels = graph.components(links)
        told = members.drop("component").join(labels, F.col("doc_id") == F.col("id"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("id")
        told = storage.staged(told, "near-labelled")
        mixed = told.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        members = storage.staged(told.join(mixed, "key", "left_semi").select("key", "n", "doc_id", "component"), "near-open")
        return True

    for salt in range(STAR_ROUNDS):
        merged(confirmed(star_pairs(members, salt), held, threshold))
    for salt in range(BEST_ROUNDS):
        merged(confirmed(best_pairs(members.join(signatures_of, "doc_id"), salt), held, threshold))
    rest = links_across(members.join(signatures_of, "doc_id"), held, threshold)
    if rest.limit(1).count():
        labels = graph.components(links.union(rest))
    of = classes.join(labels, F.col("representative") == F.col("id"), "left")
    of = of.select("set_a", "set_b", "n_shingles", F.coalesce("component", "representative").alias("class_component"))
    out = sets.drop("signature").join(of, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
