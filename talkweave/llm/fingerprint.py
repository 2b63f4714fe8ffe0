"""Weighted fingerprints of documents by consistent weighted sampling, in DataFrame functions alone.

The terms of a text are its words `[^\\x20\\x09-\\x0D]+`, weighted by how often they occur. Sample i draws, for
a term, r and c from Gamma(2, 1) and b from the unit interval, all functions of the term and i alone. With weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the sample of the text is the pair (term, t) of the least a. Two
texts have equal samples with a probability of their generalised Jaccard similarity, the sum of the least weights over that
of the largest ones, so the share of equal ones among SAMPLES samples estimates it.

r and ln c are quantiles from two tables that are made from the distribution, in CELLS cells to each halving of
the tail that decides (large r, small c), so that texts with millions of terms are told apart as well as short ones.
A sample is one long: ln a in fixed point above, 32 bits that name term and t below. Its minimum is the
sample, so a plain aggregate over exploded terms finds all of them inside generated code.

`with_next` gives every document the text of the next one, by descending doc_id, without a join and with one
shuffle of the texts: keys alone are ranged first and cut into cells of few rows, the driver gets the first and last key of each
cell (MAX_CELLS at most), and a row goes to its cell by binary search; the last row of a cell
goes to the following cell too. Everything later keeps that partitioning.

Defined results: a null text counts as empty; texts without words have an empty signature, at likeness 1 to each other and 0 to
others; a null doc_id comes after all others; documents that share a doc_id follow each other in the order of a hash of their texts;
rows that share doc_id and text are one document, returned as often as it occurs; a document alone is its own next one; extra columns stay aside.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = 64
CELLS = 32
HALVINGS = 40
MAX_CELLS = 1 << 18
CELL_BYTES = 1 << 20
_RNG = random.Random(20250117)
MASKS = [(_RNG.getrandbits(62), _RNG.getrandbits(62)) for _ in range(SAMPLES)]


def quantiles(upper: bool) -> np.ndarray:
    """Gamma(2, 1) at the middles of the cells, which halve the upper or lower tail again and again: by bisection on the tail."""
    tail = 2.0 ** -(np.repeat(np.arange(HALVINGS), CELLS) + 1) * (1 + (np.tile(np.arange(CELLS), HALVINGS) + 0.5) / CELLS)
    lo, hi = np.zeros(len(tail)), np.full(len(tail), 100.0)
    for _ in range(100):
        x = (lo + hi) / 2
        beyond = (1 + x) * np.exp(-x) if upper else -np.expm1(-x) - x * np.exp(-x)
        right = beyond > tail if upper else beyond < tail
        lo, hi = np.where(right, x, lo), np.where(right, hi, x)
    return hi


def _tables(spark: SparkSession) -> tuple[Column, Column]:
    """The tables for r and ln c. As scalar subqueries they are one object for all samples, where literals would be copied into each expression."""
    texts = (",".join(map(repr, t.tolist())) for t in (quantiles(True), np.log(quantiles(False))))
    return tuple(spark.range(1).select(F.split(F.lit(t), ",").cast("array<double>").alias("t")).scalar() for t in texts)


def sample(i: int) -> str:
    """The i-th sample of one row (term, lw: log of its weight), to be minimised; _r and _c are the tables."""
    x, y = (f"xxhash64(term ^ {m}L)" for m in MASKS[i])

    def cell(bits: str, lowest: str, halvings: int) -> str:
        return f"(least(bit_count(({bits} & -{bits}) - 1L), {halvings - 1}) * {CELLS} + cast({lowest} & {CELLS - 1}L as int))"

    r = f"get(_r, {cell(f'shiftrightunsigned({x}, 5)', x, HALVINGS)})"
    c = f"get(_c, {cell(f'(shiftrightunsigned({y}, 5) & {(1 << 27) - 1}L)', y, 27)})"
    b = f"((shiftrightunsigned({y}, 32) + 0.5D) * {2.0**-32!r}D)"
    t = f"floor(lw / {r} + {b})"
    return f"shiftleft(cast(({c} - {r} * ({t} - {b} + 1D)) * 4194304D as bigint), 32) | (shiftrightunsigned({x}, 32) ^ {t})"


def terms(text: str) -> Column:
    """array<long> of the words of a text, as hashes, in order of the hashes."""
    spaced = text
    for c in ("\\t", "\\n", "\\u000B", "\\u000C", "\\r"):
        spaced = f"replace({spaced}, '{c}', ' ')"
    return F.expr(f"sort_array(transform(filter(split({spaced}, ' '), w -> w <> ''), w -> xxhash64(w)))")


def signatures(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and `signature`, array<long> of SAMPLES samples (nulls if there is no word), of each row; keys name a row.

    If texts are partitioned by one of the keys, so is the result, and nothing is shuffled."""
    r, c = _tables(texts.sparkSession)
    sorted_ = texts.select(*keys, terms(text).alias("_s"))
    ends = sorted_.select(*keys, "_s", F.expr("filter(transform(_s, (x, i) -> if(get(_s, i + 1) <=> x, cast(null as int), i)), e -> e is not null)").alias("_e"))
    counted = ends.select(*keys, F.expr("explode_outer(transform(_e, (e, j) -> struct(get(_s, e) as term, e - coalesce(get(_e, j - 1), -1) as n)))").alias("_x"))
    weighed = counted.select(*keys, F.col("_x.term").alias("term"), F.expr("ln(_x.n)").alias("lw"), r.alias("_r"), c.alias("_c"))
    found = weighed.groupBy(*keys).agg(*(F.expr(f"min({sample(i)})").alias(f"_s{i}") for i in range(SAMPLES)))
    return found.select(*keys, F.array(*(F.expr(f"_s{i} & 4294967295L") for i in range(SAMPLES))).alias("signature"))


def likeness(a: str, b: str) -> Column:
    """The share of equal samples of two signatures."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x <=> y, 1, 0)), 0, (s, x) -> s + x) / {SAMPLES}D")


def fingerprint(signature: str) -> Column:
    """A signature as a string: eight hex digits a sample."""
    return F.expr(f"array_join(transform({signature}, x -> lpad(lower(hex(coalesce(x, 0L))), 8, '0')), '')")


def _key() -> Column:
    """Sorts as a string like (doc_id, nulls first, hash of the text)."""
    digits = "lpad(hex({}), 16, '0')"
    own = digits.format("doc_id ^ shiftleft(1L, 63)")
    return F.expr(f"concat(if(doc_id is null, '0', concat('1', {own})), {digits.format('xxhash64(text)')})")


def _bucket(firsts: list[str]) -> Column:
    """The number of the last cell whose first key is not above _key: a binary search in a literal."""
    steps = ", ".join(str(1 << k) for k in range(max(len(firsts) - 1, 1).bit_length() - 1, -1, -1))
    table = f"split('{','.join(firsts)}', ',')"
    return F.expr(f"aggregate(array({steps}), 0, (at, step) -> if(get({table}, at + step) <= _key, at + step, at))")


def with_next(docs: DataFrame) -> DataFrame | None:
    """doc_id, text, n (rows of this document), next_text, by cells: bucket, row (from 0), ghost (a document of another cell, there for its text). None if docs is empty."""
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = named.select(_key().alias("_key"), F.octet_length("text").alias("_bytes"))
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum(F.col("_bytes").cast("double")), F.lit(0.0))).first()
    if not rows:
        return None
    cells = min(MAX_CELLS, max(size / CELL_BYTES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = keys.groupBy("_key").agg(F.count("*").alias("_n")).repartitionByRange("_key").withColumn("_p", F.spark_partition_id())
    placed = ranged.withColumn("_cell", F.floor((F.row_number().over(Window.partitionBy("_p").orderBy("_key")) - 1) / math.ceil(rows / cells)))
    bounds = placed.groupBy("_p", "_cell").agg(F.min("_key").alias("first"), F.max("_key").alias("last"), F.max("_n").alias("n")).orderBy("first").collect()
    if any(b["n"] > 1 for b in bounds):
        named = named.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    else:
        named = named.withColumn("n", F.lit(1).cast("long"))
    lasts = ",".join(b["last"] for b in bounds)
    at = named.withColumn("_key", _key()).withColumn("_at", _bucket([b["first"] for b in bounds]))
    head = F.expr(f"get(split('{lasts}', ','), _at) = _key")
    twice = F.array(F.struct(F.col("_at").alias("bucket"), F.lit(False).alias("ghost")), F.struct(((F.col("_at") + 1) % len(bounds)).alias("bucket"), F.lit(True).alias("ghost")))
    sent = at.select("doc_id", "text", "n", "_key", F.explode(F.when(head, twice).otherwise(F.slice(twice, 1, 1))).alias("_x")).select("doc_id", "text", "n", "_key", "_x.*")
    order = Window.partitionBy("bucket").orderBy(F.desc("ghost"), "_key", "text")
    return sent.select("bucket", (F.row_number().over(order) - 1).alias("row"), "ghost", "doc_id", "n", "text", F.lag("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the next document.
    """
    pairs = with_next(docs)
    if pairs is None:
        none = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("edited_sha256"))
        return none.select("*", F.lit("").alias("fingerprint"), F.lit("").alias("edited_fingerprint"), F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"))
    sized = pairs.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = sized.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(coalesce(next_text, ''), 1, cast(n_chars div 2 as int)))"))
    told = edited.withColumn("edited_sha256", F.sha2("edited", 256))
    both = told.select("bucket", "row", "ghost", "doc_id", "n", "n_chars", "edited_sha256", F.posexplode(F.array("text", "edited")).alias("side", "text"))
    signed = signatures(both, ["bucket", "row", "side", "ghost", "doc_id", "n", "n_chars", "edited_sha256"])
    order = Window.partitionBy("bucket").orderBy("row", "side")
    met = signed.select("*", F.lead("signature").over(order).alias("_edited"), F.lag("signature", 2).over(order).alias("_next")).where("side = 0 and not ghost")
    one = met.select("doc_id", "n", "n_chars", "edited_sha256", fingerprint("signature").alias("fingerprint"), fingerprint("_edited").alias("edited_fingerprint"), likeness("signature", "_edited").alias("near_edited"), likeness("signature", "_next").alias("near_next"))
    return one.withColumn("_copy", F.explode(F.expr("sequence(1L, n)"))).drop("_copy", "n")
