"""Content digests of rows and of whole sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR, MARK = "\x1f", "\x1e"


def row_digest(*cols: str | Column) -> Column:
    """SHA-256 of the columns joined with a unit separator.

    Separators inside values are marked and a null has a mark of its own, so other values never give the same text.
    """
    kept = [F.replace((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(MARK), F.lit(MARK * 2)) for c in cols]
    parts = [F.coalesce(F.replace(v, F.lit(SEPARATOR), F.lit(MARK + SEPARATOR)), F.lit(MARK + "0")) for v in kept]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def fingerprint(*cols: str | Column) -> Column:
    """Sixteen hex characters that change with any input."""
    return F.left(row_digest(*cols), F.lit(16))


def set_digest(digest: str = "_digest") -> Column:
    """Aggregate of row digests that ignores row order: four 48-bit words are summed exactly, so partial sums combine."""
    words = [F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *words), 256)


def corpus_hash(rows: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One digest per key group (or for the whole set) over the chosen columns only."""
    digests = rows.select(*keys, row_digest(*cols).alias("_digest"))
    return digests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), set_digest().alias("digest"))
