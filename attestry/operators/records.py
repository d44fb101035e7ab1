"""Ledger state: dispositions, gates, decisions, claims, identifiers, versions and asset choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.ordering import carried_all, running
from attestry.session import written


def disposition_state(findings: DataFrame, log: DataFrame, resolvable: DataFrame) -> DataFrame:
    """Last disposition per finding and whether it closes it.

    ``findings(review, finding, severity)``, ``log(finding, disposition, ref, at, seq)``, ``resolvable(disposition, ref,
    finding)`` lists references that exist for that kind of disposition; one that names a finding resolves only that one,
    a null finding resolves any. A finding without a resolving disposition is open.
    """
    last = log.groupBy("finding").agg(F.max(F.struct("at", "seq", "disposition", "ref")).alias("l")).select("finding", "l.disposition", "l.ref")
    general = resolvable.filter("finding is null").select("disposition", "ref", F.lit(1).alias("_any")).distinct()
    named = resolvable.filter("finding is not null").select("disposition", "ref", "finding", F.lit(1).alias("_own")).distinct()
    joined = findings.join(last, "finding", "left").join(general, ["disposition", "ref"], "left").join(named, ["disposition", "ref", "finding"], "left")
    state = F.when(F.col("disposition").isNull(), "open").when(F.coalesce("_any", "_own").isNull(), "unresolved").otherwise("closed")
    return joined.select("review", "finding", "severity", "disposition", state.alias("state"))


def owner_decisions(decisions: DataFrame, owner: str) -> DataFrame:
    """Resolvable references of kind ``human``: decisions taken by the owner that name the finding."""
    return decisions.filter(F.col("decided_by") == owner).select(F.lit("human").alias("disposition"), F.col("id").alias("ref"), "finding")


def closing() -> Column:
    """Runs that may close a finding: completed, sealed tests (``status``, ``sealed``, ``class``); a null is none of these."""
    return F.coalesce((F.col("status") == "completed") & F.col("sealed") & (F.col("class") == "test"), F.lit(False))


def closes_after(reviews: DataFrame, runs: DataFrame, key: str, parts: int | None = None, closes: Column | None = None) -> DataFrame:
    """First run strictly after each review with the same key; both carry ``at`` in whole units of time and an ``id``.

    With ``closes``, a condition on runs, all runs are judged and a column ``closed_by`` gives the first one that holds it.
    Both sides are laid on one reversed time line and the latest run passed is carried along, so no pair is formed.
    """
    run = F.struct(F.col("at"), F.col("id"))
    nothing = F.lit(None).cast(runs.select(run.alias("r")).schema["r"].dataType)
    told = {"_run": run} | ({"_closing": F.when(closes, run)} if closes is not None else {})
    r = reviews.select(key, (-F.col("at")).alias("_t"), F.lit(0).alias("_k"), F.col("id").alias("_i"), *[nothing.alias(n) for n in told])
    s = runs.select(key, (-F.col("at")).alias("_t"), F.lit(1).alias("_k"), (-F.col("id")).alias("_i"), *[c.alias(n) for n, c in told.items()])
    filled = carried_all(r.unionByName(s), [key], ["_t", "_k", "_i"], {f"{n}_hit": n for n in told}, parts)
    return filled.filter("_k = 0").select(key, F.col("_i").alias("review"), F.col("_run_hit.id").alias("run"), *([F.col("_closing_hit.id").alias("closed_by")] if closes is not None else []))


def gate(bindings: DataFrame, current: DataFrame, key: str, open_majors: DataFrame) -> DataFrame:
    """Open only when the bound hash still holds and no major is open; otherwise the reason."""
    majors = open_majors.groupBy(key).agg(F.count(F.lit(1)).alias("_majors"))
    j = bindings.select(key, F.col("sha256").alias("_bound")).join(current.select(key, F.col("sha256").alias("_now")), key, "left").join(majors, key, "left")
    reason = (
        F.when(F.col("_now").isNull(), "bound content is gone")
        .when(~F.col("_bound").eqNullSafe(F.col("_now")), "content changed since the review")
        .when(F.coalesce("_majors", F.lit(0)) > 0, "open major findings")
        .otherwise("ok")
    )
    return j.select(key, reason.alias("reason")).withColumn("open", F.col("reason") == "ok")


def supersede_chain(decisions: DataFrame) -> DataFrame:
    """``(id, supersedes)`` to root and depth by pointer doubling: a chain of length n takes log2(n) joins.

    Missing parents and cycles come out as ``status``. Each round is written to the shared folder to cut its lineage.
    """
    decisions = written(decisions.select("id", "supersedes"), "decisions")
    ids = decisions.select(F.col("id").alias("_pid"))
    # Decisions that supersede nothing stay out of the join, which would send all of them to one task.
    asking = decisions.filter("supersedes is not null").join(ids, F.col("supersedes") == F.col("_pid"), "left")
    linked = asking.unionByName(decisions.filter("supersedes is null").withColumn("_pid", F.lit(None).cast(decisions.schema["id"].dataType)))
    broken = F.col("supersedes").isNotNull() & F.col("_pid").isNull()
    state = written(
        linked.select("id", F.col("_pid").alias("up"), F.when(F.col("_pid").isNull(), F.col("id")).otherwise(F.col("_pid")).alias("root"), F.col("_pid").isNotNull().cast("long").alias("depth"), broken.alias("broken")),
        "chain",
    )
    # A row that has reached its root is final. It leaves the rounds, whose joins would send all rows without ``up`` to one task.
    rounds = max(1, state.count()).bit_length()
    final = [state.filter("up is null")]
    state = state.filter("up is not null")
    for _ in range(rounds):
        if state.isEmpty():
            break
        ahead = reduce(DataFrame.unionByName, [state, *final])
        step = ahead.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("broken").alias("_broken"))
        state = written(
            state.join(step, "up").select(
                "id",
                F.col("_up").alias("up"),
                F.col("_root").alias("root"),
                (F.col("depth") + F.col("_depth")).alias("depth"),
                F.col("_broken").alias("broken"),
            ),
            "chain",
        )
        final.append(state.filter("up is null"))
        state = state.filter("up is not null")
    state = reduce(DataFrame.unionByName, [state, *final])
    status = F.when(F.col("up").isNotNull(), "cycle").when(F.col("broken"), "missing parent").otherwise("ok")
    return state.select("id", "root", "depth", status.alias("status"))


def decision_summary(decisions: DataFrame) -> DataFrame:
    """Per decider and overall: decided, recommendation followed, open, share asked. ``(asked, recommendation, chosen, decided_by)``."""
    followed = F.count_if(F.col("chosen") == F.col("recommendation"))
    return decisions.rollup("decided_by").agg(
        F.grouping("decided_by").alias("overall"),
        F.count("chosen").alias("n"),
        followed.alias("recommended_chosen"),
        F.count_if(F.col("chosen").isNull()).alias("n_open"),
        F.avg(F.col("asked").cast("double")).alias("asked_ratio"),
    )


def open_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.filter("chosen is null").select("id")


def dissent_list(decisions: DataFrame) -> DataFrame:
    """Decisions taken against the recommendation, with the recorded dissent."""
    return decisions.filter("chosen <> recommendation").select("id", "decided_by", "dissent")


def by_status(claims: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Every claim under its status with the status size; a status without claims keeps one row with a null id.

    Long form on purpose: one status may hold a third of all claims, so no list is collected.
    """
    listed = claims.filter(F.col("claim_status").isin(*statuses))
    # One entry per listed status: the sizes are a single value, and no join meets a status with most of the claims.
    sizes = listed.groupBy("claim_status").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("claim_status", "n")))).scalar()
    full = listed.select("claim_status", F.try_element_at(sizes, F.col("claim_status")).alias("n"), "id")
    known = claims.sparkSession.createDataFrame([(s,) for s in statuses], "claim_status string")
    empty = known.withColumn("n", F.coalesce(F.try_element_at(sizes, F.col("claim_status")), F.lit(0).cast("long"))).filter("n = 0")
    return full.unionByName(empty.withColumn("id", F.lit(None).cast(claims.schema["id"].dataType)))


def zero_filled(df: DataFrame, col: str, values: Sequence[str], what: str) -> DataFrame:
    """Counts per listed value, zero where absent."""
    known = df.sparkSession.createDataFrame([(v,) for v in values], "item string")
    counts = df.groupBy(F.col(col).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    joined = known.join(counts, "item", "left")
    return joined.select(F.concat(F.lit(f"{what}:"), "item").alias("item"), F.coalesce("n", F.lit(0)).alias("n"))


def open_by_review(findings: DataFrame) -> DataFrame:
    """Open majors and minors of every review, zero where it has none."""
    still = lambda s: F.count_if((F.col("state") != "closed") & (F.col("severity") == s))
    return findings.groupBy("review").agg(still("major").alias("open_majors"), still("minor").alias("open_minors"))


def project_status(findings: DataFrame, dispositions: DataFrame, runs: DataFrame, registry: DataFrame, kinds: Sequence[str], gates: DataFrame | None = None) -> DataFrame:
    """Dashboard rows ``(item, n)``: phase, open findings by severity and majors by review, dispositions zero-filled, sealed runs, registry size, gates.

    The phase is ``design`` before any run is sealed, ``review`` while a major is open, and ``build`` after that; its row
    says 1, those of the other phases 0.
    """
    out = zero_filled(findings.filter("state <> 'closed'"), "severity", ["major", "minor"], "open")
    out = out.unionByName(zero_filled(dispositions, "disposition", kinds, "disposition"))
    out = out.unionByName(runs.agg(F.count_if("sealed").alias("n")).select(F.lit("runs sealed").alias("item"), "n"))
    out = out.unionByName(registry.agg(F.count(F.lit(1)).alias("n")).select(F.lit("registry entries").alias("item"), "n"))
    majors = open_by_review(findings)
    out = out.unionByName(majors.select(F.concat(F.lit("open majors of "), F.col("review").cast("string")).alias("item"), F.col("open_majors").alias("n")))
    sealed = runs.agg(F.count_if("sealed").alias("s")).scalar()
    some = majors.agg(F.sum("open_majors").alias("m"))
    phase = F.when(sealed == 0, "design").when(F.coalesce("m", F.lit(0)) > 0, "review").otherwise("build")
    each = F.explode(F.array(*[F.lit(p) for p in ("design", "review", "build")]))
    out = out.unionByName(some.select(phase.alias("now"), each.alias("p")).select(F.concat(F.lit("phase:"), "p").alias("item"), (F.col("now") == F.col("p")).cast("long").alias("n")))
    if gates is not None:
        out = out.unionByName(gates.agg(F.count_if("open").alias("n")).select(F.lit("gates open").alias("item"), "n"))
    return out


def recall_report(expected: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recall and counts per lane and repetition; a lane without results stays as a failed row.

    ``matches`` has ``detected`` (0/1 per seeded defect), ``major``, ``cost`` and ``seconds``.
    """
    got = matches.groupBy(*keys).agg(
        F.avg(F.col("detected").cast("double")).alias("recall"),
        F.count_if(F.col("major")).alias("n_major"),
        F.count_if(F.col("detected") == 0).alias("unmatched"),
        F.sum("cost").alias("cost"),
        F.sum("seconds").alias("seconds"),
    )
    return expected.select(*keys).distinct().join(got, list(keys), "left").withColumn("failed", F.col("recall").isNull())


def allocate_ids(new: DataFrame, existing: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Numbers past the highest existing ``id``; gaps are never refilled."""
    top = existing.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return running(new, [], order, number="_rn", parts=parts).withColumn("new_id", top + F.col("_rn")).drop("_rn")


def latest_binding(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The latest record per key, combined before the shuffle."""
    held = [*order, *[c for c in cols if c not in order]]
    return df.groupBy(key).agg(F.max(F.struct(*held)).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in cols])


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The same n rows for the same seed: smallest digests first."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    return df.orderBy(digest).limit(n)


def carry_forward(old: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """A rebuilt record keeps the earlier hand edit where it has none of its own."""
    return new.join(old.select(key, F.col(col).alias("_kept")), key, "left").withColumn(col, F.coalesce(col, "_kept")).drop("_kept")


def upsert_decision(saved: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Status per incoming record ``(key, version, fingerprint, forced, pinned)`` against the saved copy.

    ``pinned`` means the version was asked for by name, so a newer one replaces the saved copy.
    """
    s = saved.select(key, F.col("version").alias("_v"), F.col("fingerprint").alias("_f"))
    status = (
        F.when(F.col("_v").isNull() | F.col("forced"), "saved")
        .when((F.col("version") == F.col("_v")) & (F.col("fingerprint") == F.col("_f")), "up-to-date")
        .when((F.col("version") > F.col("_v")) & ~F.col("pinned"), "new-version-available")
        .otherwise("saved")
    )
    return incoming.join(s, key, "left").withColumn("status", status).drop("_v", "_f")


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def match_original(figures: DataFrame, files: DataFrame) -> DataFrame:
    """``figures(id, path)`` to a file: exact path, else same stem, else a basename that is unique, else null."""
    f = files.select("path").distinct()
    exact = f.select("path", F.col("path").alias("_exact"))
    by_stem = f.groupBy(stem(F.col("path")).alias("_stem")).agg(F.min("path").alias("_same"))
    by_base = f.groupBy(basename(stem(F.col("path"))).alias("_base")).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_only"))
    j = figures.withColumns({"_stem": stem(F.col("path")), "_base": basename(stem(F.col("path")))})
    j = j.join(exact, "path", "left").join(by_stem, "_stem", "left").join(by_base.filter("_n = 1"), "_base", "left")
    return j.select("id", F.coalesce("_exact", "_same", "_only").alias("original"))


# Order of preference of an asset's origin.
ASSET_ORDER = ["rendered", "remote", "svg-fallback", "inline-svg"]


def choose_asset(figures: DataFrame, candidates: DataFrame) -> DataFrame:
    """First usable candidate ``(id, status, path, is_image)`` per figure in order of preference, else missing with a note."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ASSET_ORDER]), F.col("status"))
    best = candidates.groupBy("id").agg(
        F.min(F.when(F.col("is_image"), F.struct(rank.alias("rank"), F.col("path").alias("path"), F.col("status").alias("status")))).alias("b"),
        F.count_if(~F.col("is_image")).alias("rejected"),
    )
    j = figures.join(best, "id", "left")
    note = F.when(F.col("b").isNull() & (F.col("rejected") > 0), "not an image")
    return j.select("id", "local", F.coalesce("b.status", F.lit("missing")).alias("status"), F.col("b.path").alias("path"), note.alias("note"))


def path_mapping(chosen: DataFrame) -> DataFrame:
    """Old to new path where the chosen asset is stored elsewhere than planned."""
    return chosen.filter("path is not null and path <> local").select(F.col("local").alias("old"), F.col("path").alias("new"))


def match_defects(findings: DataFrame, defects: Sequence[Mapping], review: str, order: str) -> DataFrame:
    """``findings(review, order, id, location, text)`` to the seeded defect each one detects, or null.

    Findings are taken in order; each claims the first free defect whose location pattern and keyword both occur. The
    defect list is a fixed rule table, so it becomes one expression and no join. A finding can only claim a defect if
    fewer than len(defects) earlier findings share its candidate set, which bounds what the greedy pass sees per review.
    """
    names = [d["id"] for d in defects]

    def hits(d: Mapping) -> Column:
        any_of = lambda col, words: F.coalesce(F.greatest(*[F.contains(F.lower(col), F.lit(w.lower())) for w in [*words, words[0]]]), F.lit(False))
        return F.when(any_of("location", d["location_patterns"]) & any_of("text", d["keywords"]), d["id"])

    marked = findings.withColumn("_set", F.array_compact(F.array(*[hits(d) for d in defects])))
    w = Window.partitionBy(review, "_set").orderBy(order)
    able = marked.filter(F.size("_set") > 0).select(review, order, "id", "_set").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= len(names))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for row in pdf.sort_values(order).itertuples(index=False):
            free = next((d for d in row.candidates if d not in taken), None)
            if free is not None:
                taken.add(free)
                out.append((getattr(row, review), row.id, free))
        return pd.DataFrame(out, columns=[review, "id", "defect"])

    kinds = {f.name: f.dataType.simpleString() for f in findings.schema.fields}
    schema = f"{review} {kinds[review]}, id {kinds['id']}, defect string"
    claimed = able.drop("_rn").withColumnRenamed("_set", "candidates").groupBy(review).applyInPandas(greedy, schema)
    return findings.select(review, "id").join(claimed, [review, "id"], "left")
