"""Checks that report one finding per fault: severity, location, message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.digests import row_digest


class GateError(Exception):
    """A gate stayed closed; ``findings`` holds a bounded preview."""

    def __init__(self, message: str, findings: list) -> None:
        super().__init__(message)
        self.findings = findings


def require_none(findings: DataFrame, what: str, preview: int = 20) -> None:
    """Raise when a findings table has any row."""
    rows = findings.limit(preview).collect()
    if rows:
        raise GateError(f"{what}: {rows[0].asDict()}", rows)


def finding(severity: str, location: Column, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(severity).alias("severity"), location.alias("location"), message.alias("message"))


def unfold(df: DataFrame, checks: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """Explode an array of nullable findings; rows without a finding disappear."""
    found = df.select(*keep, F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("f"))
    return found.select(*keep, "f.severity", "f.location", "f.message")


def validate_records(df: DataFrame, key: str, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """``rules`` are (cell path, condition that must hold, message); a null condition counts as broken."""
    checks = [
        F.when(~F.coalesce(ok, F.lit(False)), finding("major", F.concat(F.col(key).cast("string"), F.lit(f".{path}")), message))
        for path, ok, message in rules
    ]
    return unfold(df, checks)


def path_fault(path: Column, is_link: Column | None = None, size: Column | None = None, max_size: int | None = None) -> Column:
    """Why a member path must not be unpacked, or null."""
    fault = F.when(path.startswith("/"), "absolute path").when(path.rlike(r"(^|/)\.\.(/|$)"), "escapes its folder")
    if is_link is not None:
        fault = fault.when(is_link, "link")
    if size is not None and max_size is not None:
        fault = fault.when(size > max_size, f"size over {max_size}")
    return fault


def safe_members(members: DataFrame, archive: str, position: str, max_size: int, max_members: int, parts: int | None = None) -> DataFrame:
    """Keep or reject each archive member; past the cap of accepted members the rest is rejected."""
    from attestry.operators.ordering import running

    fault = path_fault(F.col("name"), F.col("is_link"), F.col("size"), max_size)
    judged = members.withColumn("fault", fault).withColumn("_ok", F.col("fault").isNull().cast("long"))
    counted = running(judged, [archive], [position], {"_accepted": "_ok"}, number="_rn", parts=parts)
    over = F.when(F.col("fault").isNull() & (F.col("_accepted") > max_members), F.lit("too many members"))
    return counted.withColumn("reason", F.coalesce("fault", over)).drop("fault", "_ok", "_accepted", "_rn")


def diff_manifest(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Listed rows ``(path, size, sha256)`` against the actual listing with ``is_link``: one finding per fault."""
    a = actual.select("path", F.col("size").alias("a_size"), F.col("sha256").alias("a_sha"), "is_link")
    l = listed.select("path", F.col("size").alias("l_size"), F.col("sha256").alias("l_sha"))
    both = l.join(a, "path", "full_outer")
    path, present = F.col("path"), F.col("a_sha").isNotNull()
    unsafe = path_fault(path, F.coalesce("is_link", F.lit(False)))
    fault = (
        F.when(unsafe.isNotNull(), unsafe)
        .when(F.col("l_sha").isNull(), "not in the manifest")
        .when(~present, "missing file")
        .when(F.col("l_size") != F.col("a_size"), "size differs")
        .when(F.col("l_sha") != F.col("a_sha"), "hash differs")
    )
    direct = unfold(both.withColumn("fault", fault), [F.when(F.col("fault").isNotNull(), finding("major", path, F.col("fault")))])
    alias = listed.groupBy(F.lower("path").alias("location")).agg(F.countDistinct("path").alias("n")).filter("n > 1")
    alias = alias.select(F.lit("major").alias("severity"), "location", F.lit("paths collide by case").alias("message"))
    return direct.unionByName(alias)


def verify_seal(files: DataFrame, seal: DataFrame, mandatory: Sequence[str]) -> DataFrame:
    """``(run, path, sha256)`` now and at sealing: changed, extra, gone, and runs whose seal lacks a mandatory file."""
    both = seal.select("run", "path", F.col("sha256").alias("sealed")).join(files.select("run", "path", F.col("sha256").alias("now")), ["run", "path"], "full_outer")
    message = (
        F.when(F.col("sealed").isNull(), "file is not in the seal")
        .when(F.col("now").isNull(), "sealed file is gone")
        .when(F.col("sealed") != F.col("now"), "changed after the seal")
    )
    direct = both.select("run", F.col("path").alias("location"), message.alias("message")).filter("message is not null")
    has = seal.groupBy("run").agg(*[F.max((F.col("path") == m).cast("int")).alias(f"m{i}") for i, m in enumerate(mandatory)])
    absent = F.array(*[F.when(F.col(f"m{i}") == 0, F.lit(m)) for i, m in enumerate(mandatory)])
    lacking = has.select("run", F.explode(F.filter(absent, lambda x: x.isNotNull())).alias("name"))
    lacking = lacking.select("run", F.lit("seal").alias("location"), F.concat(F.lit("seal lacks "), "name").alias("message"))
    return direct.unionByName(lacking).withColumn("severity", F.lit("major"))


def diff_snapshots(old: DataFrame, new: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """changed / added / removed by content digest; columns outside ``content`` never count as drift."""
    a = old.select(key, row_digest(*content).alias("_old"))
    b = new.select(key, row_digest(*content).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def resolve_evidence(evidence: DataFrame, registry: DataFrame, sources: DataFrame, prefix: str) -> DataFrame:
    """Per evidence row ``(claim, item, registry, statistic, source)`` the finding that stops it, or null when it resolves.

    ``registry`` has ``(id, statistic)`` rows, ``sources`` has ``path`` rows.
    """
    reg = registry.select(F.col("id").alias("registry"), "statistic", F.lit(1).alias("_reg")).distinct()
    src = sources.select(F.col("path").alias("source"), F.lit(1).alias("_src")).distinct()
    # Rows that name no entry or no source would all meet in one task; they get keys of their own, which nothing answers.
    alone = lambda c: F.coalesce(F.col(c), F.concat(F.lit("\0"), F.xxhash64("claim", "item").cast("string")))
    asked = evidence.withColumns({"_entry": alone("registry"), "_path": alone("source")})
    joined = asked.join(reg.withColumnRenamed("registry", "_entry"), ["_entry", "statistic"], "left").join(src.withColumnRenamed("source", "_path"), "_path", "left")
    outside = ~F.col("source").startswith(prefix) | path_fault(F.substring("source", 2, 10**6)).isNotNull()
    message = (
        F.when(F.col("registry").isNotNull() & F.col("_reg").isNull(), F.concat(F.lit("no registry statistic "), "registry", F.lit("/"), F.coalesce("statistic", F.lit("?"))))
        .when(F.col("registry").isNull() & F.col("source").isNull(), F.lit("neither registry nor source"))
        .when(F.col("source").isNotNull() & outside, F.concat(F.lit("outside the sources: "), "source"))
        .when(F.col("source").isNotNull() & F.col("_src").isNull(), F.concat(F.lit("no such source: "), "source"))
    )
    return joined.select("claim", "item", message.alias("message"))


def resolve_macros(uses: DataFrame, registry: DataFrame, statistics: Sequence[str]) -> DataFrame:
    """Uses ``(location, id, statistic)`` against registry ``(id, class)``: unknown entry, unknown statistic, exploratory warning."""
    joined = uses.join(registry.select("id", F.col("class").alias("_class")), "id", "left")
    severity = F.when(F.col("_class").isNull() | ~F.col("statistic").isin(*statistics), "major").when(F.col("_class") == "exploratory", "warning")
    message = (
        F.when(F.col("_class").isNull(), F.concat(F.lit("unknown registry entry "), "id"))
        .when(~F.col("statistic").isin(*statistics), F.concat(F.lit("unknown statistic "), "statistic"))
        .otherwise(F.concat(F.lit("exploratory result "), "id"))
    )
    return joined.select(severity.alias("severity"), "location", message.alias("message")).filter("severity is not null")


def resolve_citations(cites: DataFrame, bib: DataFrame, sources: DataFrame, literature: DataFrame) -> DataFrame:
    """Citation ``(location, key)`` against bibliography, saved sources and hand-verified literature.

    ``bib`` has ``(key, paper, version)`` (paper null for books), ``sources`` ``(paper, saved_version, route)``,
    ``literature`` ``(key)``. Sound citations give no row.
    """
    b = bib.select("key", "paper", "version", F.lit(1).alias("_bib"))
    lit = literature.select("key", F.lit(1).alias("_lit")).distinct()
    joined = cites.join(b, "key", "left").join(sources.select("paper", "saved_version", "route"), "paper", "left").join(lit, "key", "left")
    wrong_version = F.col("version").isNotNull() & (F.col("version") != F.col("saved_version"))
    message = (
        F.when(F.col("_bib").isNull(), "key is not in the bibliography")
        .when(F.col("paper").isNull() & F.col("_lit").isNull(), "not verified in the literature")
        .when(F.col("paper").isNotNull() & F.col("saved_version").isNull(), "paper is not saved")
        .when(wrong_version, F.concat(F.lit("cites v"), F.col("version").cast("string"), F.lit(", saved is v"), F.col("saved_version").cast("string")))
        .when(F.col("route") == "pdf", "saved through the pdf route")
    )
    rows = joined.select("key", "location", message.alias("message")).filter("message is not null")
    return rows.withColumn("severity", F.when(F.col("message") == "saved through the pdf route", "warning").otherwise("major"))


def figures_check(refs: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """References ``(location, path)`` must be listed at that exact path, exist, and hash as listed."""
    m = manifest.select("path", F.col("sha256").alias("_listed"), F.lit(1).alias("_m"))
    f = files.select("path", F.col("sha256").alias("_now"))
    message = (
        F.when(F.col("_m").isNull(), "figure is not in the manifest")
        .when(F.col("_now").isNull(), "figure file is missing")
        .when(F.col("_listed").isNotNull() & (F.col("_listed") != F.col("_now")), "figure changed after its script ran")
    )
    joined = refs.join(m, "path", "left").join(f, "path", "left")
    return joined.select("location", "path", message.alias("message")).filter("message is not null").withColumn("severity", F.lit("major"))
