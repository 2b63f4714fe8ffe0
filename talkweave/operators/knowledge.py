"""Knowledge base: fingerprints, ingestion and chunking of documents."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.session import materialized, small_batches

MAX_CHARS = 1200
MINHASHES = 128


#: Mersenne prime of the minhashes, and their seed.
PRIME, MINHASH_SEED = (1 << 31) - 1, 128


def minhash_factors(size: int = MINHASHES) -> tuple[np.ndarray, np.ndarray]:
    """a and b of the minhashes: of a token's hash h, minhash k sees (a[k] * h + b[k]) mod PRIME."""
    rng = np.random.default_rng(MINHASH_SEED)
    return rng.integers(1, PRIME, size), rng.integers(0, PRIME, size)


def _by_row(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists in a row, and where each list begins. Lists aren't empty."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate(lists.to_list()).astype(np.int64), np.cumsum(sizes) - sizes


#: Values of lists that are worked on at once.
VALUES_AT_ONCE = 1 << 16


def _slices(lists: pd.Series) -> Iterator[pd.Series]:
    """Lists in order, in slices of about VALUES_AT_ONCE values: a batch of long texts takes no more memory than one of short ones."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // VALUES_AT_ONCE)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(lists)], strict=True):
        if b > a:
            yield lists.iloc[a:b]


def _majority(bits: np.ndarray, begin: np.ndarray, n: np.ndarray) -> list[str]:
    """Hex fingerprints: each bit by majority of a list's rows of bits, ties set."""
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    return [x.tobytes().hex() for x in np.packbits(2 * ones >= n[:, None], axis=1)]


def _blake2b_simhash(text: str | None) -> str:
    words = (text or "").lower().split() or [text or ""]
    raw = b"".join(hashlib.blake2b(w.encode("utf-8", "ignore"), digest_size=8).digest() for w in words)
    ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones >= len(words)).tobytes().hex()


def simhash(docs: DataFrame, key: str, text: str, token_hash: str = "blake2b") -> DataFrame:
    """Key, simhash over lower-case tokens with multiplicity; text of white space only is one token.

    A document's tokens are one row, so its votes are counted in that row, on Arrow batches, and nothing is shuffled. md5 is taken by
    built-in functions, blake2b, which has none, in Python.
    """
    small_batches(docs.sparkSession)
    if token_hash == "blake2b":

        @F.pandas_udf("string")
        def fingerprint(batch: pd.Series) -> pd.Series:
            return batch.map(_blake2b_simhash)

        return docs.select(key, fingerprint(F.col(text).cast("string")).alias("simhash"))
    if token_hash != "md5":
        raise ValueError(f"unknown token hash {token_hash}")

    @F.pandas_udf("string")
    def votes(hashes: pd.Series) -> pd.Series:
        out = []
        for part in _slices(hashes):
            flat, begin = _by_row(part)
            bits = np.unpackbits(flat.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
            out += _majority(bits, begin, np.diff(np.append(begin, len(flat))))
        return pd.Series(out)

    tokens = T.dedup_tokens(F.coalesce(F.col(text), F.lit("")))
    return docs.select(key, votes(F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 16), 16, -10).cast("long"))).alias("simhash"))


def minhash(docs: DataFrame, key: str, text: str, size: int = MINHASHES) -> DataFrame:
    """Key, signature: `size` seeded minima over the distinct tokens (31 bits of md5, then a linear function modulo PRIME each), in the row. Comparable among themselves only."""
    small_batches(docs.sparkSession)
    a, b = minhash_factors(size)

    @F.pandas_udf("array<long>")
    def minima(hashes: pd.Series) -> pd.Series:
        out = []
        for part in _slices(hashes):
            flat, begin = _by_row(part)
            found = np.stack([np.minimum.reduceat((flat * x + y) % PRIME, begin) for x, y in zip(a, b, strict=True)], axis=1)
            out += list(found)
        return pd.Series(out)

    tokens = F.array_distinct(T.dedup_tokens(F.coalesce(F.col(text), F.lit(""))))
    hashed = F.transform(tokens, lambda t: F.shiftright(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), 1) % PRIME)
    return docs.select(key, minima(hashed).alias("signature"))


def jaccard_estimate(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def new_by_hash(rows: DataFrame, existing: DataFrame | None, hash_: str, order: str) -> DataFrame:
    """The first row of each fingerprint, if it isn't known yet."""
    first = rows.groupBy(hash_).agg(F.min_by(F.struct(*rows.columns), order).alias("_first")).select("_first.*")  # folds a hot fingerprint before the shuffle
    return first if existing is None else first.join(existing.select(hash_).distinct(), hash_, "left_anti")


#: Where a text may be cut, best first: paragraphs, lines, sentences, words.
CUTS = ("\n\n", "\n", (". ", "! ", "? ", "。", "！", "？"), " ")


def split_text(text: str, max_chars: int = MAX_CHARS) -> list[str]:
    """Pieces of at most max_chars, cut at the last best boundary that fits, in order; no visible character is lost."""
    out, rest = [], text.strip()
    while len(rest) > max_chars:
        cut = 0
        for marks in CUTS:
            window = rest[: max_chars + 1]
            ends = [window.rfind(m) + (0 if m.isspace() else len(m.rstrip())) for m in ((marks,) if isinstance(marks, str) else marks) if window.rfind(m) > 0]
            cut = max((e for e in ends if 0 < e <= max_chars), default=0)
            if cut >= max_chars // 4:
                break
        cut = cut or max_chars
        piece, rest = rest[:cut].rstrip(), rest[cut:].lstrip()
        if piece:
            out.append(piece)
    return out + [rest] if rest else out


def units(notes: DataFrame, key: str = "note_id", text: str = "body", max_chars: int = MAX_CHARS) -> DataFrame:
    """Key, unit_idx, utype, text. The splitter runs on batches; texts up to max_chars never leave the JVM's row as more than one piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pieces = [split_text(t or "", max_chars) for t in pdf["text"]]
            yield pd.DataFrame([(k, i, p) for k, ps in zip(pdf["key"], pieces, strict=True) for i, p in enumerate(ps)], columns=["key", "unit_idx", "text"])

    small_batches(notes.sparkSession)
    typed = notes.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = notes.schema[key].dataType.simpleString()
    return typed.mapInPandas(run, f"key {kind}, unit_idx int, text string").select(F.col("key").alias(key), "unit_idx", F.lit("semantic").alias("utype"), "text")


def ingest(files: DataFrame, existing: DataFrame | None = None, max_chars: int = MAX_CHARS, lang: str = "ja", token_hash: str = "blake2b") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Notes, units, one row of statistics, and a table of what failed (path, error). files: path, text (null: couldn't be read), error.

    Notes are written once to the checkpoint folder; statistics need their number alone, so units are split only where they are asked for.
    """
    readable = files.where("error is null")
    hashed = simhash(readable.select("path", "text", F.struct("path", "text").alias("file")), "file", "text", token_hash).select("file.*", F.col("simhash").alias("hash"))
    fresh = new_by_hash(hashed, existing, "hash", "path")
    notes = materialized(fresh.select(F.xxhash64("path").alias("note_id"), T.stem(F.col("path")).alias("title"), F.col("text").alias("body"), F.col("path").alias("source"), F.lit(lang).alias("lang"), "hash", F.current_timestamp().alias("created_at")))
    seen = files.agg(F.count("*").alias("discovered"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    stats = seen.crossJoin(notes.agg(F.count("*").alias("created"))).select("discovered", "created", (F.col("discovered") - F.col("failed") - F.col("created")).alias("skipped"), "failed")
    return notes, units(notes, max_chars=max_chars), stats, files.where("error is not null").select("path", "error")


def without_orphans(units_: DataFrame, notes: DataFrame) -> DataFrame:
    """J6, for these two tables: deleting a note deletes its units; a unit whose parent is gone stands alone."""
    kept = units_.join(notes.select(F.col("id").alias("note_id")).distinct(), "note_id", "left_semi")
    parents = kept.select(F.col("id").alias("_parent")).distinct()
    return kept.join(parents, F.col("parent_id") == F.col("_parent"), "left").withColumn("parent_id", F.col("_parent")).drop("_parent")


#: Fixed values: (table, column, table it points to, what becomes of a row whose target is deleted).
FOREIGN_KEYS = (
    ("units", "note_id", "notes", "CASCADE"), ("units", "parent_id", "units", "SET NULL"),
    ("relations", "head_id", "entities", "CASCADE"), ("relations", "tail_id", "entities", "CASCADE"), ("relations", "evidence_unit_id", "units", "SET NULL"),
    ("unit_tags", "unit_id", "units", "CASCADE"), ("unit_tags", "tag_id", "tags", "CASCADE"),
)
PRIMARY_KEYS = {"unit_tags": ("unit_id", "tag_id")}


def deleted_keys(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], foreign_keys: tuple = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """Keys of all rows that go when the doomed ones do, table by table: a fixpoint over the CASCADE keys.

    doomed: keys (columns named as the table's). Semi-naive: a round follows only keys that the round before has added, less those
    known, so each row is found once whatever the depth, and cycles end. Each round's delta is written to the shared folder.
    """
    keys = lambda t: list(PRIMARY_KEYS.get(t, ("id",)))
    gone: dict[str, list[DataFrame]] = {}
    fresh = {t: [df.select(*keys(t)).distinct()] for t, df in doomed.items()}
    while fresh:
        delta = {}
        for t, found in fresh.items():
            new = functools.reduce(DataFrame.union, found).distinct()
            if t in gone:
                new = new.join(functools.reduce(DataFrame.union, gone[t]), keys(t), "left_anti")
            new = materialized(new)
            if new.limit(1).count():
                delta[t] = new
                gone.setdefault(t, []).append(new)
        fresh = {}
        for child, column, parent, action in foreign_keys:
            if action == "CASCADE" and parent in delta:
                target = delta[parent].select(F.col(keys(parent)[0]).alias("_target"))
                hit = tables[child].join(target, F.col(column) == F.col("_target"), "left_semi")
                fresh.setdefault(child, []).append(hit.select(*keys(child)))
    return {t: functools.reduce(DataFrame.union, found) for t, found in gone.items()}


def deleted(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], foreign_keys: tuple = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """All tables after deleting the doomed rows: what hangs on them by CASCADE goes too, what points at any of it by SET NULL points nowhere."""
    gone = deleted_keys(tables, doomed, foreign_keys)
    out = {}
    for t, df in tables.items():
        left = df.join(gone[t], list(PRIMARY_KEYS.get(t, ("id",))), "left_anti") if t in gone else df
        for child, column, parent, action in foreign_keys:
            if child == t and action == "SET NULL" and parent in gone:
                dead = gone[parent].select(F.col(PRIMARY_KEYS.get(parent, ("id",))[0]).alias("_dead"))
                left = left.join(dead, F.col(column) == F.col("_dead"), "left").withColumn(column, F.when(F.col("_dead").isNull(), F.col(column))).drop("_dead")
        out[t] = left.select(*df.columns)
    return out


#: The usual saturation and length parameters of BM25.
BM25_K, BM25_B = 1.2, 0.75


POSTINGS_AT_ONCE, QUERIES_AT_ONCE = 1 << 20, 4096


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k documents with the highest BM25 score for each query: query_id, key, score, rank. queries: query_id, text; a query's terms count once.

    Terms that some query asks for become postings (term, document, weight), written once. Scores add up in units of a block of documents and a
    block of queries, over slices of the postings: no pair of a query and a document is ever a row, and a unit returns k documents for each of its
    queries. A frequent term's postings spread over all blocks of documents.
    """
    tokens = lambda df, *cols, c: df.select(*cols, T.dedup_tokens(F.coalesce(F.col(c), F.lit(""))).alias("_w"))
    asked = materialized(tokens(queries, "query_id", c="text").select("query_id", F.explode("_w").alias("term")).distinct())
    sized = tokens(docs, key, c=text).select(key, F.size("_w").alias("size"), "_w")
    counts = sized.select(key, "size", F.explode("_w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy(key, "size", "term").agg(F.count("*").alias("tf"))
    counts = materialized(counts)
    total = sized.agg(F.count("*").alias("docs"), F.avg("size").alias("mean")).first()
    idf = counts.groupBy("term").agg(F.log(1 + (F.lit(total["docs"]) - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (BM25_K + 1) / (F.col("tf") + BM25_K * (1 - BM25_B + BM25_B * F.col("size") / F.lit(total["mean"])))
    spark = docs.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // POSTINGS_AT_ONCE))
    query_blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    postings = counts.join(idf, "term").select("term", F.col(key).alias("doc"), weight.alias("weight"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"))
    wanted = asked.select("query_id", "term", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("part"))

    def score(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(p) and len(q):
            p = p.sort_values(["term", "doc"], kind="stable")
            terms, begin = np.unique(p["term"].to_numpy(), return_index=True)
            begin = np.append(begin, len(p))
            names, weights = p["doc"].to_numpy(), p["weight"].to_numpy()
            docs_, of = np.unique(names, return_inverse=True)  # in order, so ties go by document
            place = pd.Index(terms).get_indexer(q["term"])
            for query, at in q.assign(at=place)[place >= 0].groupby("query_id", sort=False)["at"]:
                rows = np.concatenate([np.arange(begin[t], begin[t + 1]) for t in at])
                sums = np.bincount(of[rows], weights[rows], minlength=len(docs_))
                best = np.argsort(-np.round(sums, 9), kind="stable")[:k]
                out += [(query, docs_[d], sums[d]) for d in best if sums[d] > 0]
        return pd.DataFrame(out, columns=["query_id", key, "score"])

    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}, score double"
    scored = postings.groupBy("block", "part").cogroup(wanted.groupBy("block", "part")).applyInPandas(score, types)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
