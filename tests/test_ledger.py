"""Registry, seals, snapshots, dispositions, defects."""

from pyspark.sql import functions as F
import pytest

from attestry.operators import findings, records, registry, selection


def obs(spark, rows):
    return spark.createDataFrame(rows, "run string, condition string, seed int, metric string, value string")


def test_registry_is_exact_for_29_digit_values_and_skips_non_finite(spark):
    o = obs(spark, [("r1", "a", 1, "m", "10000000000000000000000000000"), ("r1", "a", 2, "m", "10000000000000000000000000001"), ("r1", "b", 1, "m", "nan"), ("r1", "b", 2, "m", "0.5")])
    runs = spark.createDataFrame([("r1", "exploratory")], "run string, class string")
    metrics = spark.createDataFrame([("m", "ratio", "maximize")], "metric string, unit string, direction string")
    e = {r.id: r for r in registry.rebuild_registry(o, runs, metrics).collect()}
    assert abs(e["r1/a/m"]["std"] - 0.70710678) < 1e-8 and e["r1/b/m"]["n"] == 1 and e["r1/a/m"]["unit"] == "ratio"


def test_sanity_warnings_are_numeric(spark):
    o = obs(spark, [("r", "base", 1, "acc", "0.5"), ("r", "base", 2, "acc", "0.50"), ("r", "new", 1, "acc", "0.50"), ("r", "new", 99, "acc", "0.5"), ("r", "new", 1, "extra", "nan")])
    declared = spark.createDataFrame([("r", "base"), ("r", "new"), ("r", "ghost")], "run string, condition string")
    w = registry.sanity_warnings(o, declared, spark.createDataFrame([("acc",)], "metric string"), spark.createDataFrame([("r", 1), ("r", 2)], "run string, seed int"), 3)
    kinds = {r.kind for r in w.collect()}
    assert {"identical-means", "too-few-seeds", "missing-metric-def", "non-finite", "missing-condition", "unexpected-seeds"} == kinds
    with pytest.raises(findings.GateError):
        findings.require_none(w, "registry")


@pytest.mark.parametrize("case, message", [("ok", None), ("hash", "hash differs"), ("size", "size differs"), ("missing", "missing file"), ("extra", "not in the manifest"), ("../x", "escapes its folder"), ("/x", "absolute path"), ("link", "link")])
def test_manifest_faults(spark, case, message):
    listed = [("a", 1, "h")] + ([("b", 2, "g")] if case != "extra" else []) + ([(case, 1, "z")] if case in ("../x", "/x") else [])
    actual = [("a", 1, "h", False)] + ([("b", 3 if case == "size" else 2, "q" if case == "hash" else "g", case == "link")] if case != "missing" else [])
    l, a = spark.createDataFrame(listed, "path string, size int, sha256 string"), spark.createDataFrame(actual, "path string, size int, sha256 string, is_link boolean")
    assert [r.message for r in findings.diff_manifest(l, a).collect()] == ([message] if message else [])


def test_manifest_aliases(spark):
    rows = [("Output.log", 1, "a"), ("output.log", 1, "b")]
    out = findings.diff_manifest(spark.createDataFrame(rows, "path string, size int, sha256 string"), spark.createDataFrame([r + (False,) for r in rows], "path string, size int, sha256 string, is_link boolean"))
    assert ["collide" in r.message for r in out.collect()] == [True]


def test_supersede_chain_finds_cycles_and_missing_parents(spark):
    d = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6)], "id long, supersedes long")
    got = {r.id: (r.root, r.depth, r.status) for r in records.supersede_chain(d).collect()}
    assert got[4] == (1, 3, "ok") and got[1] == (1, 0, "ok") and got[5][2] == "missing parent" and got[6][2] == got[7][2] == "cycle"


def test_decisions_and_original_lookup(spark):
    d = spark.createDataFrame([("D1", True, "A", "B", "human"), ("D2", False, "A", "A", "agent"), ("D3", True, "A", None, None)], "id string, asked boolean, recommendation string, chosen string, decided_by string")
    s = {(r.decided_by, r.overall): r for r in records.decision_summary(d).collect()}
    assert s[("human", 0)].recommended_chosen == 0 and s[("agent", 0)].recommended_chosen == 1 and abs(s[(None, 1)].asked_ratio - 2 / 3) < 1e-9 and s[(None, 1)].n_open == 1
    files = spark.createDataFrame([(p,) for p in ["old/plot.pdf", "new/plot.png", "only/one.pdf", "a/dup.pdf", "b/dup.pdf"]], "path string")
    figs = spark.createDataFrame([(1, "new/plot.png"), (2, "old/plot.svg"), (3, "one.svg"), (4, "dup.svg")], "id int, path string")
    assert {r.id: r.original for r in records.match_original(figs, files).collect()} == {1: "new/plot.png", 2: "old/plot.pdf", 3: "only/one.pdf", 4: None}


def test_match_defects_equals_the_sequential_rule(spark):
    import random

    rng = random.Random(3)
    defects = [{"id": f"X{i}", "location_patterns": [f"L{i}", f"L{(i + 1) % 4}"], "keywords": [f"w{i}", f"w{(i * 2) % 5}"]} for i in range(4)]
    rows = [(f"r{rng.randrange(3)}", i, i, f"l{rng.randrange(5)}", f"w{rng.randrange(6)} w{rng.randrange(6)}") for i in range(200)]
    got = {r.id: r.defect for r in records.match_defects(spark.createDataFrame(rows, "review string, id long, seq long, location string, text string"), defects, "review", "seq").collect()}
    taken, want = set(), {}
    for review, i, _, loc, text in rows:
        hit = next((d["id"] for d in defects if (review, d["id"]) not in taken and any(p.lower() in loc for p in d["location_patterns"]) and any(k in text for k in d["keywords"])), None)
        want[i] = hit
        if hit:
            taken.add((review, hit))
    assert got == want


def test_members_past_the_cap_and_empty_slices(spark):
    m = spark.createDataFrame([("a", i, f"f{i}", False, 1) for i in range(5)] + [("a", 9, "../e", False, 1), ("a", 10, "big", False, 5000)], "archive string, pos int, name string, is_link boolean, size int")
    got = {r.name: r.reason for r in findings.safe_members(m, "archive", "pos", 1024, 3).collect()}
    assert sum(v is None for v in got.values()) == 3 and got["f3"] == got["f4"] == "too many members" and got["../e"] == "escapes its folder" and "size" in got["big"]
    with pytest.raises(LookupError):
        selection.tag_slice(spark.createDataFrame([(["x"],)], "tags array<string>"), "tags", "y")
