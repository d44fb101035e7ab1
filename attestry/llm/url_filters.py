"""URL allow and block rules: expansions of each url meet the rules in an equi-join on short hash prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import lower_ascii
from attestry.session import written

RULES = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])


def rule_table(like: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table. A path starts and ends with ``/``: only at a ``/`` are urls expanded."""
    for host, path, verdict in rules:
        if not host or not path.startswith("/") or not path.endswith("/") or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {host!r}, {path!r}, {verdict!r}")
    return like.sparkSession.createDataFrame(list(rules), RULES)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", prefix: int = 8) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` to every row of ``pages`` (columns of these names are replaced).

    Each url is expanded into its host suffixes times its path prefixes that end in ``/``. Rules and expansions meet on
    the first ``prefix`` hexadecimal digits of SHA-256; the whole digest must then agree. The longest rule wins, between
    equally long ones the one with the longer host, then block before allow. A url without a rule gets ``otherwise``.

    Null urls and urls without ``://`` have an empty host and path and fit no rule; long urls are taken whole; repeated
    rows stay repeated; an empty table gives an empty result; no rules leave every row to ``otherwise``.
    """
    after = F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")
    rest = F.when(F.contains(F.col(f"`{url}`"), F.lit("://")), after).otherwise(F.lit(""))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # The row travels as one value, so that no column of it can be mistaken for one made here.
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), rest.alias("_rest"))
    base = base.withColumn("host", lower_ascii(F.regexp_extract("_rest", r"^[^/?#]*", 0))).withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(host) + 1)"), r"^[^?#]*", 0))
    base = base.drop("_rest")
    # One row per distinct (host, path): what is judged does not depend on the page.
    places = base.filter("host <> '' and path <> ''").select("host", "path").distinct()
    labels, steps = F.split("host", r"\."), F.split("path", "/")
    # No rule has more labels or steps than these, so longer expansions, whose number has no bound, can meet none.
    deep = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("host"), F.max(F.size(F.split("path", "/")) - 1).alias("path")).head()
    most_labels, most_steps = int(deep.host or 1), int(deep.path or 1)
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most_labels - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size(steps) - 1, F.lit(most_steps))), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))
    wide = places.filter(F.size(steps) > 1).select("host", "path", F.explode(hosts).alias("_h"), paths.alias("_ps"))
    wide = wide.select("host", "path", "_h", F.explode("_ps").alias("_p")).withColumn("_d", F.sha2(F.concat("_h", F.lit("\n"), "_p"), 256))
    table = rules.select(F.col("host").alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_v")).withColumn("_rd", F.sha2(F.concat("_rh", F.lit("\n"), "_rp"), 256))
    met = wide.withColumn("_key", F.substring("_d", 1, prefix)).join(table.withColumn("_key", F.substring("_rd", 1, prefix)), "_key").filter("_d = _rd")
    rank = F.struct((F.length("_rh") + F.length("_rp")).alias("n"), F.length("_rh").alias("h"), F.col("_v").alias("v"), F.concat("_rh", "_rp").alias("rule"))
    best = met.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    # Written, so that Spark can split the join where one place holds many pages.
    best = written(best, "places")
    joined = base.join(best, ["host", "path"], "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in kept], "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.v", F.lit(otherwise)).alias("verdict"))
