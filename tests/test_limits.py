"""Inputs that once gave wrong answers or ended a job."""

import math

import pytest
from pyspark.sql import functions as F

from attestry.functions import pages, refs, text
from attestry.operators import digests, records
from attestry.operators.statistics import chi_square_tail
from attestry.session import shared_folder


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).head()[0]


def test_long_texts_end_no_executor(spark):
    lines = "---\n" + "key: 1.5\n" * 50_000
    assert one(spark, lines, text.extract_numbers) == ["1.5"]
    assert one(spark, lines + "---\n7.5 rest", text.extract_numbers) == ["7.5"]
    assert one(spark, "1" + ",1" * 50_000, text.extract_numbers) == ["1" + ",1" * 50_000]


@pytest.mark.parametrize(
    "reply, found",
    [
        ('a {"a":{"b":{"c":{"d":{}}}}} z', '{"a":{"b":{"c":{"d":{}}}}}'), ('{"a":"}", "k":1}', '{"a":"}", "k":1}'), ('{"a":"\\\\"}{", "k":1}!', '{"a":"\\\\"}'), ("no object", None), ("{open", None), (None, None), ("", None),
        ("{" * 3000 + "}" * 3000, "{" * 3000 + "}" * 3000),
    ],
)
def test_first_json_of_any_depth(spark, reply, found):
    assert one(spark, reply, text.first_json) == found


def test_reply_without_json_failed(spark):
    status = lambda c: text.reply_status(c, "k long", "k")
    assert [one(spark, r, status) for r in ("I read it.", "I cannot help with that", '{"k": 1}', '{"z": 1}', None)] == ["failed", "refused", "ok", "invalid", "failed"]


def test_huge_version_is_no_version(spark):
    assert one(spark, "2211.09876v99999999999", refs.canonical_ref).version is None


def test_six_heading_levels(spark):
    blocks = spark.createDataFrame([(1, i, "heading", f"h{i}", f"t{i}") for i in range(1, 7)] + [(1, 7, "paragraph", "p", "x"), (1, 8, "heading", "h4", "u"), (1, 9, "paragraph", "p", "y")], "doc int, ord int, kind string, tag string, text string")
    got = {r.ord: r.section for r in pages.section_path(blocks, "doc").collect()}
    assert got[7] == "t1 / t2 / t3 / t4 / t5 / t6" and got[9] == "t1 / t2 / t3 / u"


@pytest.mark.parametrize("x, df, p", [(0.0, 4, 1.0), (3.0, 4, math.exp(-1.5) * 2.5), (100.0, 4, math.exp(-50) * 51), (800.0, 4, 0.0), (5000.0, 4, 0.0), (4.0, 1, math.erfc(math.sqrt(2.0))), (900.0, 1000, 0.9895), (1100.0, 1000, 0.0147)])
def test_chi_square_tail(spark, x, df, p):
    got = spark.range(1).select(chi_square_tail(F.lit(x), F.lit(df))).head()[0]
    assert abs(got - p) < (1e-9 if df < 10 else 2e-3)


def test_decision_closes_only_the_finding_it_names(spark):
    findings = spark.createDataFrame([("r", "F1", "major"), ("r", "F2", "major"), ("r", "F3", "minor")], "review string, finding string, severity string")
    log = spark.createDataFrame([("F1", "human", "D1", 1, 1), ("F2", "human", "D1", 1, 1), ("F3", "test", "T", 1, 1)], "finding string, disposition string, ref string, at int, seq int")
    known = spark.createDataFrame([("human", "D1", "F2"), ("test", "T", None)], "disposition string, ref string, finding string")
    assert {r.finding: r.state for r in records.disposition_state(findings, log, known).collect()} == {"F1": "unresolved", "F2": "closed", "F3": "closed"}


def test_claims_under_their_status(spark):
    claims = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "other")], "id string, claim_status string")
    got = {(r.claim_status, r.n, r.id) for r in records.by_status(claims, ["x", "y"]).collect()}
    assert got == {("x", 2, "a"), ("x", 2, "b"), ("y", 0, None)}


def test_digest_tells_null_from_empty_and_keeps_separators_apart(spark):
    rows = [(None, "a"), ("", "a"), ("a", None), ("a\x1fb", "c"), ("a", "b\x1fc"), ("\x1e0", "a")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(digests.row_digest("a", "b")).collect()]
    assert len(set(got)) == len(rows)


def test_unset_shared_folder_is_refused_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:1"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        shared_folder(Session, "x")
    Context.master = "local[2]"
    assert shared_folder(Session, "x").startswith("/tmp/spark-")
