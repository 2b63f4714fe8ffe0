"""Names for rows, where doc_id doesn't name one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names like these that no column in `taken` has, in any case."""
    known = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def with_row_ids(docs: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """docs with a long column (of a fresh name): doc_id where it is not null and no other row has it, else a hash of doc_id and text; and whether all doc_ids are rows' own.

    Rows that share both share the name; so would two others with probability 2^-64.
    """
    own = F.col("doc_id").cast("long")
    ident, n, mark = fresh([*docs.columns, column], "_id", "_n", "_shared")
    shared = docs.select(own.alias(ident)).groupBy(ident).agg(F.count("*").alias(n)).where(f"{n} > 1 or {ident} is null").select(ident)
    some = shared.count()
    if not some:  # texts needn't meet an empty table
        return docs.withColumn(column, own), True
    flagged = shared.withColumn(mark, F.lit(True))
    told = docs.join(F.broadcast(flagged) if some <= BROADCAST_ROWS else flagged, own.eqNullSafe(F.col(ident)), "left")
    name = F.when(F.col(mark), F.xxhash64(F.lit(1), own, F.col("text"))).otherwise(own)
    return told.select(*docs.columns, name.alias(column)), False
