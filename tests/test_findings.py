"""Cases that a review found: each failed before its change."""

import datetime as dt
import math
import random
import time

from pyspark.sql import functions as F

from attestry.operators import agentlogs, evaluation, records, similarity
from attestry.streaming import jobs


def test_spread_over_a_request_of_zero_is_infinite(spark):
    per = spark.createDataFrame([("a", 0.0), ("a", 3.0), ("b", 0.0), ("c", 2.0), ("c", 4.0)], "task string, total double")
    got = {r.task: r for r in agentlogs.spread_ratio(per, "task", "total").collect()}
    assert got["a"].within == math.inf and math.isnan(got["b"].within) and got["c"].within == 2.0
    assert got["c"].across == math.inf


def test_a_number_written_twice_is_one_claim(spark):
    texts = spark.createDataFrame([(1, "We spent 106203.00 on account 106203, a share of 25% of all.")], "k int, t string")
    assert sorted((r.place, r.claimed) for r in evaluation.claims_of(texts, ["k"], F.col("t")).collect()) == [(0, 106203.0), (1, 0.25)]


def test_no_effect_is_exactly_no_effect(spark):
    rows = [(1, "b", x) for x in (0.1, 0.2, 0.3)] + [(1, "u", x) for x in (0.2, 0.2, 0.2)] + [(1, "c", 0.1), (2, "b", 0.0), (2, "u", 0.5), (2, "c", 0.25)]
    df = spark.createDataFrame(rows, "k int, c string, v double")
    got = {r.k: r for r in evaluation.effect_retention(df, ["k"], "c", "b", "c", "u", F.col("v").cast("decimal(18,6)")).collect()}
    assert got[1].retention is None and got[1].base == 0.6 / 3
    assert got[2].retention == 0.5


def test_closing_run_is_found_among_all_runs(spark):
    reviews = spark.createDataFrame([("k", 1, 10), ("k", 2, 20)], "key string, id long, at long")
    runs = spark.createDataFrame([("k", 7, 15, "failed", True, "test"), ("k", 8, 16, "completed", True, "test"), ("k", 9, 30, "completed", None, "test")], "key string, id long, at long, status string, sealed boolean, class string")
    got = {r.review: (r.run, r.closed_by) for r in records.closes_after(reviews, runs, "key", parts=3, closes=records.closing()).collect()}
    assert got == {1: (7, 8), 2: (9, None)}


def _folder_of_events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")


def test_curve_has_no_equal_rows(spark, folder):
    from attestry.plans import load

    n = 1_200_000  # all but one in the run's first millionth, each a share of less than a millionth
    at = F.when(F.col("id") == n - 1, 10_000_000_000_000).otherwise(F.col("id"))
    one = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_micros(at).cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.col("id") + 1, F.lit("}")).alias("props"))
    one.write.parquet(f"{folder}/events.parquet")
    curve = load().queries["handshake_curve"](spark, folder)
    assert 0 < curve.count() == curve.distinct().count() < n


def test_week_begins_at_the_nearest_second(spark, folder):
    from attestry.plans import load

    week = dt.datetime(2024, 1, 4)
    half = dt.timedelta(milliseconds=400)
    _folder_of_events(spark, folder, [(1, week - half, 1, "view", 1.0, "{}"), (2, week + half, 2, "view", 3.0, "{}"), (3, week - 2 * half, 3, "view", 5.0, "{}")])
    assert {r.week: r.n for r in load().queries["stream_weekly_drift"](spark, folder).collect()} == {week: 2, week - dt.timedelta(days=7): 1}


def test_tail_of_a_large_window_is_exact(spark, folder):
    many = spark.range(60_000).select(F.lit("k").alias("k"), F.timestamp_seconds(1_704_067_200 + F.col("id") % 1000).alias("ts"), F.pmod(F.col("id") * 7919, F.lit(60_000)).cast("double").alias("v"))
    last = spark.range(1).select(F.lit("z").alias("k"), F.timestamp_seconds(F.lit(1_704_067_200 + 864_000)).alias("ts"), F.lit(0.0).alias("v"))
    many.union(last).coalesce(1).write.parquet(f"{folder}/in")
    s = jobs.moving_rate(jobs.read_stream(spark, f"{folder}/in", many), "k", "ts", F.col("v") > 50, "v", "1 day", "1 day")
    assert [(r.n, r.p95) for r in jobs.drain(s, "moving").filter("k = 'k'").collect()] == [(60_000, 56_999.0)]


def test_front_keeps_rows_that_nulls_make_incomparable(spark):
    rows = [("a", 1.0, 1.0, 1.0), ("a", 2.0, 1.0, 0.5), ("a", None, 9.0, 9.0), (None, 0.0, 9.0, 9.0), ("a", 3.0, None, 0.0), ("a", 1.0, 0.5, 2.0), ("a", 1.0, 0.5, 2.0)]
    got = evaluation.pareto_front(spark.createDataFrame(rows, "g string, r double, l double, c double"), "g", "r", "l", "c").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows[1:]))


def test_many_small_groups_have_their_fronts_in_time(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("g"), F.col("id").cast("double").alias("r"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("l"), F.lit(1.0).alias("c"))
    start = time.time()
    assert evaluation.pareto_front(rows, "g", "r", "l", "c").count() > 20_000
    assert time.time() - start < 30


def test_keys_share_states_and_stay_apart(spark, folder):
    day = 86_400
    batches = [[(None, 1, 0, 1), ("a", None, 10, 2), ("a", 2, 20, 3)], [(None, 1, 3_000, 4), ("a", None, 3_700, 5), ("a", 2, 3_620, 6)], [("z", 9, 9 * day, 7)], [("z", 9, 12 * day, 8)]]
    schema = "s string, k long, sec long, v long"
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("sec"))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    like = spark.read.parquet(f"{folder}/in")
    stream = jobs.read_stream(spark, f"{folder}/in", like, per_batch=1).select("s", "k", "ts", "v")
    got = jobs.drain(jobs.ttl_dedup(stream, ["s", "k"], "ts", "v", 3_600_000_000, lots=1), "ttl").collect()
    assert sorted((r.v, r.s, r.k) for r in got) == [(1, None, 1), (2, "a", None), (3, "a", 2), (5, "a", None), (7, "z", 9)]


def test_style_of_long_texts_costs_no_square(spark):
    rows = spark.range(16).select((F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") < 8, "p").otherwise("q").alias("p"), F.repeat(F.when(F.col("id") % 2 == 0, "häb 𝄞 ").otherwise("xy zw "), 60_000).alias("t"))
    start = time.time()
    got = similarity.style_auc(rows, "t", "y", "p", folds=2, features=1 << 10, steps=2).collect()
    assert all(r.auc == 1.0 for r in got) and time.time() - start < 60


def test_toxicity_learns_from_all_labelled_rows(spark):
    from attestry.llm import toxicity

    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 50).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 8 == 0).cast("int").alias("toxic"))
    assert toxicity.fit(docs, labels)[2] == 1 / 8


def test_means_of_doubles_are_those_of_the_sql(spark, folder):
    import duckdb

    from attestry.plans import load

    rng = random.Random(5)
    rows = [("F", i % 40, "ANR"[i // 40 % 3], rng.randrange(11) / 100) for i in range(40 * 3 * 160)]  # means of 160 end in the seventh place
    spark.createDataFrame(rows, "l_linestatus string, l_suppkey long, l_returnflag string, l_discount double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    name = "effect_retention"
    got = [(r.l_linestatus, r.l_suppkey, r.base, r.compressed, r.upper, r.retention) for r in load().queries[name](spark, folder).collect()]
    assert sorted(got) == sorted(db.sql(load().check_sql[name]).fetchall())


def test_grams_are_counted_in_lots_of_words(spark):
    import pyarrow as pa

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.random() < 0.5, None if i % 9 == 0 else [rng.choice("xyz") for _ in range(rng.randrange(12))]) for i in range(200)] + [("a", True, ["x"] * 90)]
    batch = pa.record_batch([pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["w"])
    lots = list(similarity._lots(iter([batch, batch.slice(0, 0)]), 40))
    sizes = [sum(len(w or []) for w in lot.column("w").to_pylist()) for lot in lots]
    assert [w for lot in lots for w in lot.column("w").to_pylist()] == [r[2] for r in rows] and sorted(sizes)[-2] <= 40 and sizes[-1] == 90
    marked = spark.createDataFrame(rows, "g string, _bg boolean, w array<string>").coalesce(1)
    whole, cut = ({tuple(r) for r in similarity.frequent_grams(marked, "g", 3, 5, lot=n).collect()} for n in (1 << 20, 40))
    assert whole == cut and whole


def test_style_is_read_in_small_groups_of_rows(spark, monkeypatch):
    import pyarrow.parquet as pq

    rng, files = random.Random(2), []
    rows = [("".join(rng.choice("abcdefghij ") for _ in range(4_000)), i % 2, f"p{i % 7}") for i in range(1_200)]
    kept = similarity.written
    monkeypatch.setattr(similarity, "written", lambda *a, **b: (lambda df: files.extend(df.inputFiles()) or df)(kept(*a, **b)))
    similarity.style_auc(spark.createDataFrame(rows, "t string, y int, p string"), "t", "y", "p", folds=2, steps=1).collect()
    held = [m.row_group(i).num_rows for f in files for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
    assert sum(held) == 1_200 and max(held) <= 150


def test_copies_of_constraints_do_not_pass_the_driver(spark):
    items = spark.range(4_000).select((F.col("id") % 2).alias("topic"), "id", F.lit(10).cast("long").alias("len"))
    for every in (1_000, 3):
        cons = items.filter(F.col("id") % every == 0).select("id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("scope"))
        out = agentlogs.decompose(items, cons, "topic", "id", "len", 60, parts=64)
        got = out.groupBy("replicated").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("topic", "chunk", "id").alias("d")).collect()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        n = cons.count() // 2
        # Two topics of 400 chunks; a constraint is not copied to the chunk that holds it.
        assert {r.replicated: (r.n, r.d) for r in got} == {False: (4_000, 4_000), True: (n * 799, n * 799)}


def test_rounds_of_stitch_write_no_vector_per_wish(spark, monkeypatch):
    seen, kept = {}, similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name, *a, **b: seen.setdefault(name, []).append(df.columns) or kept(df, name, *a, **b))
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 20) for i in range(40)]
    got = similarity.stitch(spark.createDataFrame(rows, "id long, v array<double>, len long"), "id", "v", "len", target=100, k=3).collect()
    assert sorted(r.id for r in got) == list(range(40)) and sum(r.used for r in got) == 800
    assert all(c == ["chain", "id"] for c in seen["wishes"]) and all("z" not in c for c in seen["turn"])
