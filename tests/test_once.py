"""Work that is done once, in shares: what a row costs, what a round carries, where rows without a key go."""

import random
import re

from pyspark.sql import functions as F

from attestry.functions import latex, pages, text
from attestry.operators import coverage, findings, records, similarity, survival
from attestry.session import written


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_supersede_chain_carries_only_open_rows(spark, monkeypatch):
    rows = [(i, i - 1 if i % 20 else None) for i in range(40)] + [(i, None) for i in range(100, 150)] + [(200, 999), (300, 301), (301, 300)]
    kept = []
    monkeypatch.setattr(records, "written", lambda df, purpose: kept.append((purpose, df.count())) or written(df, purpose))
    got = {r.id: (r.root, r.depth, r.status) for r in records.supersede_chain(spark.createDataFrame(rows, "id long, supersedes long")).collect()}
    assert len(got) == 93 and got[39] == (20, 19, "ok") and got[120] == (120, 0, "ok") and got[200][2] == "missing parent" and got[300][2] == got[301][2] == "cycle"
    rounds = [n for purpose, n in kept if purpose == "chain"]
    assert rounds[0] == 93 and rounds[1] == 40 and rounds == sorted(rounds, reverse=True) and rounds[-1] == 2


def test_evidence_without_a_name_is_spread(spark):
    evidence = spark.range(2000).select(F.col("id").alias("claim"), F.lit(1).alias("item"), *[F.lit(None).cast("string").alias(c) for c in ("registry", "statistic", "source")])
    some = spark.createDataFrame([(9000, 1, "r1", "mean", None), (9001, 1, None, None, "/s/a.md"), (9002, 1, "r2", "mean", "/s/b.md")], evidence.schema)
    reg, src = spark.createDataFrame([("r1", "mean")], "id string, statistic string"), spark.createDataFrame([("/s/a.md",)], "path string")
    set_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in set_}
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        rows = findings.resolve_evidence(evidence.unionByName(some), reg, src, "/s/").withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    said = {r.claim: r.message for r in rows}
    assert len(rows) == 2003 and said[9000] is None and said[9001] is None and said[9002] == "no registry statistic r2/mean" and said[5] == "neither registry nor source"
    at = [r["at"] for r in rows]
    assert max(map(at.count, set(at))) < 1000


def test_blocks_evaluate_each_pattern_once(spark):
    df = spark.createDataFrame([(1, "<title>t</title><nav>x</nav><p>a <b>b</b></p><p> </p><a href='u'>l</a>")], "id int, html string")
    blocks = pages.page_blocks(df, "id", "html")
    assert [(r.kind, r.text) for r in blocks.orderBy("ord").collect()] == [("title", "t"), ("paragraph", "a b"), ("link", "l")]
    assert plan(blocks).count("<!DOCTYPE") == 1 and plan(blocks).count("&copy;") == 1


def test_cite_keys_evaluate_each_pattern_once(spark):
    keys = latex.cite_keys(spark.createDataFrame([("f", "cite\n\\cite{a,\n b\t}% \\cite{c}\n x \\citep[x]{d}{ }")], "file string, tex string"), "tex", "file")
    assert sorted(tuple(r) for r in keys.collect()) == [("f", 2, "a"), ("f", 2, "b"), ("f", 4, "d")]
    assert plan(keys).count("regexp_replace") == 2


def test_leakage_report_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)
    best = spark.createDataFrame([(float(i) / 8,) for i in range(9)], "s double").rdd.map(lambda r: seen.add(1) or r).toDF("similarity double")
    r = similarity.leakage_report(best).head()
    assert (r.n, r["mean"], r.exact, r.median) == (9, 0.5, 1, 0.5) and seen.value == 9


def test_number_presence_reads_each_side_once(spark):
    src = spark.createDataFrame([("d", "12 and 7.5% with $x+1$ and $y$")], "doc string, text string")
    bad = spark.createDataFrame([("d", "12 and $y$")], "doc string, text string")
    lost = coverage.number_presence(src, bad, "doc", "text")
    # A digit of an equation is a number of its text as well.
    assert {(r.kind, r.token) for r in lost.collect()} == {("number", "7.5%"), ("number", "1"), ("equation", "x+1")}
    assert plan(lost).count("LogicalRDD") == 2
    rng = random.Random(3)
    texts = ["12%34 a12%34 1%2%3", *["".join(rng.choice("12%%.,a_ \n") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_extract_all("t", F.lit(text.NUMBER_ONCE), F.lit(1))).collect()
    assert [r[0] for r in found] == [[m.group(2) for m in re.finditer(text.NUMBER, t)] for t in texts]


def test_version_match_reads_its_rules_once_in_even_shares(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, [f"rule {i} one.", "same", "same", f"the old wording of a long rule {i}"], ["same", f"Rule {i} one", f"the new wording of a long rule {i}", "same"]) for i in range(40)]
    df = spark.createDataFrame(rows, "f int, o array<string>, n array<string>").rdd.map(lambda r: seen.add(1) or r).toDF("f int, o array<string>, n array<string>")
    got = survival.version_match(df, ["f"], "o", "n")
    assert sorted(tuple(r)[1:4] for r in got.filter("f = 3").collect()) == [(0, 1, "normalised"), (1, 0, "exact"), (2, 3, "exact"), (3, 2, "similar")]
    assert got.count() == 160 and seen.value == 40
