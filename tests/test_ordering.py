"""Ordering helpers against pandas, with one key and one value holding a large share of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestry.operators import ordering as o


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 20, n))
    value = np.where(rng.random(n) < 0.35, 7, rng.integers(0, 50, n))
    pdf = pd.DataFrame({"key": key, "value": value, "id": rng.permutation(n)})
    return pdf, spark.createDataFrame(pdf)


def test_running_equals_a_plain_window(hot):
    pdf, df = hot
    got = o.running(df, ["key"], ["value", "id"], {"cum": "value"}, size="n", lows={"low": "id"}, highs={"high": "id"}, parts=8).toPandas().sort_values(["key", "value", "id"])
    want = pdf.sort_values(["key", "value", "id"])
    g = want.groupby("key")
    assert got["rn"].tolist() == (g.cumcount() + 1).tolist()
    assert got["cum"].tolist() == g["value"].cumsum().tolist()
    assert got["low"].tolist() == g["id"].cummin().tolist() and got["high"].tolist() == g["id"].cummax().tolist()
    assert got["n"].tolist() == g["id"].transform("size").tolist()


def test_a_heavy_value_is_cut_by_the_next_column(hot):
    _, df = hot
    sizes = o.with_spans(df, ["value", "id"], 8).groupBy("_span").count().toPandas()["count"]
    assert sizes.max() < 3000 / 3


@pytest.mark.parametrize("ahead", [False, True])
def test_shifted_equals_lag_and_lead(hot, ahead):
    pdf, df = hot
    got = o.shifted(df, ["key"], ["value", "id"], {"other": "id"}, ahead=ahead, parts=8).toPandas().sort_values(["key", "value", "id"])
    want = pdf.sort_values(["key", "value", "id"]).groupby("key")["id"].shift(-1 if ahead else 1)
    assert [None if pd.isna(x) else int(x) for x in got["other"]] == [None if pd.isna(x) else int(x) for x in want]


def test_carried_keeps_the_last_known_value(hot):
    pdf, df = hot
    d = df.withColumn("mark", F.when(F.col("id") % 9 == 0, F.col("id")))
    got = o.carried(d, ["key"], ["value", "id"], "mark", "last", parts=8).toPandas().sort_values(["key", "value", "id"])
    p = pdf.sort_values(["key", "value", "id"])
    want = p["id"].where(p["id"] % 9 == 0).groupby(p["key"]).ffill()
    assert [None if pd.isna(x) else int(x) for x in got["last"]] == [None if pd.isna(x) else int(x) for x in want]


def test_quantiles_and_ranks_are_exact(hot):
    pdf, df = hot
    got = o.exact_quantiles(df, ["key"], "value", {"p50": 0.5, "p95": 0.95}, parts=8).toPandas().set_index("key").sort_index()
    want = pdf.groupby("key")["value"].quantile([0.5, 0.95]).unstack()
    assert np.allclose(got["p50"], want[0.5]) and np.allclose(got["p95"], want[0.95])
    r = o.value_ranks(df, ["key"], "value", parts=8).toPandas()
    ranks = pdf.assign(r=pdf.groupby("key")["value"].rank()).groupby(["key", "value"])["r"].first()
    assert all(abs(ranks[(a, b)] - x) < 1e-9 for a, b, x in zip(r["key"], r["value"], r["avg_rank"]))
