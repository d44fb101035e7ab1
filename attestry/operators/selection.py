"""Row selection with an outcome: tags, titles, folds, samples, cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_some(df: DataFrame, what: str) -> DataFrame:
    """Raise when nothing is left; otherwise hand the rows on."""
    if not df.limit(1).count():
        raise LookupError(f"{what}: no rows")
    return df


def tag_slice(df: DataFrame, tags: str, tag: str) -> DataFrame:
    """Rows whose tag array holds the tag; an empty slice is an error."""
    return require_some(df.filter(F.array_contains(tags, tag)), f"tag {tag}")


def title_candidates(catalogue: DataFrame, title: str, query: str) -> DataFrame:
    """Titles holding every word of the query, with the exact-title flag and the outcome of the search."""
    words = [w for w in query.lower().split() if w]
    hits = catalogue
    for w in words:
        hits = hits.filter(F.contains(F.lower(title), F.lit(w)))
    n = hits.agg(F.count(F.lit(1))).scalar()
    outcome = F.when(n == 1, "resolved").otherwise("ambiguous")
    return hits.withColumns({"exact_title": F.lower(title) == query.lower(), "n_hits": n, "outcome": outcome})
