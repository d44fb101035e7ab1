"""Methods without a SQL twin, against brute force on small inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from attestry.operators import agentlogs, evaluation, retrieval, similarity, statistics, survival
from attestry.session import written
from attestry.streaming import jobs


def jac(a, b, n=3):
    g = lambda t: {" ".join(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
    x, y = g(a), g(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def texts(n=120, seed=5):
    """A third are copies or near copies of one text, the rest share a boilerplate line."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    crowd = [word() for _ in range(40)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            t = list(crowd)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(40)] = word()
        else:
            t = [word() for _ in range(rng.randrange(3, 40))] + "released under the common licence".split()
        out.append((i, " ".join(t)))
    return out


def test_near_copies_equal_brute_force(spark):
    rows = texts()
    got = {r.id: r.near_copy for r in similarity.near_copies(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    want = {i: any(jac(t, u) > 0.7 for j, u in rows if j < i) for i, t in rows}
    assert got == want and sum(want.values()) > 20


def test_diverse_select_equals_the_sequential_rule(spark):
    rows = texts(40, 9)
    got = [r.id for r in similarity.diverse_select(spark.createDataFrame(rows, "id long, text string"), "id", "text", F.length("text"), 6).orderBy("turn").collect()]
    lo, hi = min(len(t) for _, t in rows), max(len(t) for _, t in rows)
    fit = {i: (len(t) - lo) / (hi - lo) for i, t in rows}
    text, chosen = dict(rows), []
    while len(chosen) < 6:
        score = lambda i: fit[i] if not chosen else round(fit[i] * 0.5 + 0.5 * min(1 - jac(text[i], text[c]) for c in chosen), 9)
        chosen.append(min((i for i in text if i not in chosen), key=lambda i: (-score(i), i)))
    assert got == chosen


def test_neighbour_join_with_a_crowd_of_copies(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    v[::3] = v[0]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    got = {}
    for r in retrieval.neighbour_join(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 4, pivots=8, block=32).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    for i in range(300):
        want = sorted((j for j in range(300) if j != i), key=lambda j: (-sim[i, j], j))[:4]
        assert [n for _, n in sorted(got[i])] == want


def test_version_match_takes_best_pairs_once(spark):
    old = ["Always run the tests.", "Use tabs.", "Keep lines short and simple", "Drop this rule entirely", "same", "same"]
    new = ["use **tabs**", "Always run the tests.", "Keep lines short and very simple", "same", "A wholly different sentence"]
    got = survival.version_match(spark.createDataFrame([(1, old, new)], "f int, o array<string>, n array<string>"), ["f"], "o", "n").collect()
    assert {(r.old_at, r.new_at, r.stage) for r in got} == {(0, 1, "exact"), (4, 3, "exact"), (1, 0, "normalised"), (2, 2, "similar"), (3, None, "death"), (5, None, "death"), (None, 4, "birth")}


def test_pareto_front_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(a), int(b), int(c)) for g, a, b, c in np.column_stack([rng.integers(0, 2, 300), rng.integers(0, 9, (300, 3))])]
    df = spark.createDataFrame(rows, "g int, r int, l int, c int").repartition(6)
    beaten = lambda x: any(y[0] == x[0] and y[1] > x[1] and y[2] <= x[2] and y[3] <= x[3] and (y[2] < x[2] or y[3] < x[3]) for y in rows)
    assert sorted(map(tuple, evaluation.pareto_front(df, "g", "r", "l", "c").collect())) == sorted(x for x in rows if not beaten(x))


def stitched(rows, target, k, overshoot=1.25, width=None):
    """The rounds of ``stitch``, one item after the other."""
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v is not None and any(v)}
    size = {i: n or 0 for i, _, n in rows}
    cos = lambda a, b: round(float(a @ b / np.linalg.norm(a)), 9)
    near = lambda c, pool: sorted((x for x in pool), key=lambda x: (-cos(c, unit[x]), x))[:k]
    graph = {i: near(unit[i], [x for x in unit if x != i]) for i in unit}
    left, out = set(size), []
    cut = lambda i, total: int(min(size[i], max(0, int(overshoot * target) - total)))
    while left:
        seeds = sorted(left)[: width or max(1, -(-sum(size[i] for i in left) // target))]
        left -= set(seeds)
        out += [(i, 1, i, cut(i, 0)) for i in seeds]
        chains = {i: [1, size[i], unit.get(i), set(graph.get(i, ())) & left] for i in seeds}
        while True:
            chains = {c: x for c, x in chains.items() if x[1] < target and x[2] is not None}
            ask = {c: max(x[3], key=lambda i, x=x: (cos(x[2], unit[i]), -i)) for c, x in chains.items() if x[3]}
            empty = [c for c, x in chains.items() if not x[3]]
            won = {i: min(c for c in ask if ask[c] == i) for i in ask.values()}
            left -= set(won)
            for i, c in won.items():
                place, total, mean, wish = chains[c]
                out.append((c, place + 1, i, cut(i, total)))
                chains[c] = [place + 1, total + size[i], mean + unit[i], wish | set(graph[i])]
            for c in chains:
                chains[c][3] &= left
            for c in empty:
                chains[c][3] |= set(near(chains[c][2], left & set(unit)))
            if not chains or not ask and not any(chains[c][3] for c in empty):
                break
    return sorted(out)


def test_stitch_equals_its_rounds_one_by_one(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 5))
    rows = [(i, (centres[i % 4] + 0.4 * rng.normal(size=5)).tolist(), int(rng.integers(1, 60))) for i in range(90)]
    rows[7], rows[11], rows[20] = (7, None, 30), (11, [0.0] * 5, 500), (20, rows[4][1], None)
    schema = "id long, v array<double>, len long"
    for target, k, width, some in ((150, 4, None, rows), (60, 20, 1, rows[:9])):
        got = similarity.stitch(spark.createDataFrame(some, schema).repartition(3), "id", "v", "len", target=target, k=k, width=width).collect()
        assert sorted(tuple(r) for r in got) == stitched(some, target, k, width=width)
    assert similarity.stitch(spark.createDataFrame([], schema), "id", "v", "len", target=10).count() == 0


def test_split_topics_leaves_fit(spark):
    rng = np.random.default_rng(7)
    v = np.vstack([rng.normal(size=(80, 4)), np.tile([1.0, 2, 3, 4], (40, 1))])
    leaves = similarity.split_topics(spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>"), "id", "v", 15)
    e = similarity.examined_share(leaves).head()
    # The 40 equal vectors are one class and stay together; all other leaves fit.
    sizes = leaves.groupBy("topic", "leaf").count().collect()
    assert e["items"] == 120 and e.largest == 40 and sorted(r["count"] for r in sizes)[-2] <= 15
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    assert {(r.id, r.topic) for r in similarity.split_topics(none, "id", "v", 1).collect()} == {(1, -1), (2, -1), (3, 0)}
    assert similarity.split_topics(none.limit(0), "id", "v", 5).count() == 0


def test_split_topics_ends_small_leaves_inside_a_task(spark, monkeypatch):
    rng = np.random.default_rng(11)
    v = np.vstack([rng.normal(size=(150, 4)), rng.normal(size=(3, 4)).repeat(9, axis=0), np.eye(1, 4), -np.eye(1, 4)])
    rows, schema = [(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>"
    steps = []
    monkeypatch.setattr(similarity, "written", lambda df, purpose: steps.append(purpose) or written(df, purpose))
    split = lambda **how: sorted(tuple(r) for r in similarity.split_topics(spark.createDataFrame(rows, schema), "id", "v", 15, **how).collect())
    whole = split()
    assert len(steps) <= 5  # the table, its classes, one look at the sizes, the leaves
    assert whole == split(inside=60)
    assert steps.count("lean") > 0


def test_streams_in_several_batches(spark, folder):
    rows = [(1, "2024-01-01 00:00:00", 5), (1, "2024-01-01 00:10:00", 6), (1, "2024-01-01 09:00:00", 7), (2, "2024-01-01 01:00:00", 8), (2, "2024-01-09 00:00:00", 9)]
    df = spark.createDataFrame(rows, "u int, ts string, v int").withColumn("ts", F.to_timestamp("ts"))
    for i in range(5):
        df.filter(F.col("v") == 5 + i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.read_stream(spark, f"{folder}/in", df, per_batch=1)
    got = {(r.u, r.events) for r in jobs.drain(jobs.idle_sessions(stream, "u", "ts", "1 hour"), "s").collect()}
    assert got == {(1, 2), (1, 1), (2, 1)}
    band = spark.createDataFrame([(2, 0.0, 8.5)], "u int, low double, high double")
    weeks = jobs.drain_updates(jobs.weekly_drift(stream, "u", "ts", "v", band, lateness="30 days"), "w", ["u", "week"]).collect()
    assert sorted((r.u, r.n, r.alert) for r in weeks) == [(1, 3, False), (2, 1, False), (2, 1, True)]


def test_late_rows_are_counted_beside_the_result(spark, folder):
    rows = [(1, "2024-01-01 00:00:00", 5), (1, "2024-02-01 00:00:00", 6), (1, "2024-02-02 00:00:00", 7), (1, "2024-01-02 00:00:00", 8)]
    df = spark.createDataFrame(rows, "u int, ts string, v int").withColumn("ts", F.to_timestamp("ts"))
    for i in range(5, 9):
        df.filter(F.col("v") == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.read_stream(spark, f"{folder}/in", df, per_batch=1)
    band = spark.createDataFrame([(1, None, None)], "u int, low double, high double")
    weeks, told = jobs.drain_counted(jobs.weekly_drift(stream, "u", "ts", "v", band, lateness="1 hour"), "w", ["u", "week"])
    assert sum(r.n for r in weeks.collect()) == 3 and not any(r.alert for r in weeks.collect())
    counts = told.collect()
    assert sum(r.late for r in counts) == 1 and sum(r.rows for r in counts) == 4


def test_ingest_sees_earlier_batches(spark, folder):
    schema = "doc long, version int, fingerprint string, forced boolean, pinned boolean"
    for i, row in enumerate([(1, 1, "a", False, False), (1, 1, "a", False, False), (1, 2, "b", False, False), (1, 2, "b", False, True)]):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{folder}/{i}/part")
        import time

        time.sleep(1.1)
    like = spark.createDataFrame([], schema)
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    none = spark.createDataFrame([], "doc long, version int, fingerprint string")
    got = sorted(r.status for r in jobs.ingest(stream, lambda: none, "doc", "ing").collect())
    assert got == ["new-version-available", "saved", "saved", "up-to-date"]


def test_style_auc_tells_two_hands_apart(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["abra", "cadabra", "alakazam"] if i % 2 else ["lorem", "ipsum", "dolor"]) for _ in range(20)), i % 2, f"p{i % 12}") for i in range(60)]
    got = similarity.style_auc(spark.createDataFrame(rows, "id int, t string, y int, p string"), "t", "y", "p", folds=2, features=1 << 10, steps=4).collect()
    assert got and all(r.auc > 0.99 for r in got)


def test_repeats_inside_the_ttl_are_suppressed(spark, folder):
    rows = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:10:00", 2), ("b", "2024-01-01 00:20:00", 3), ("z", "2024-01-01 09:00:00", 4), ("a", "2024-01-01 09:30:00", 5), ("a", "2024-01-01 10:30:00", 6), ("z", "2024-01-01 10:00:01", 7), ("y", "2024-01-03 00:00:00", 8), ("y", "2024-01-03 00:01:00", 9)]
    df = spark.createDataFrame(rows, "k string, ts string, v int").withColumn("ts", F.to_timestamp("ts"))
    for i in range(1, 10):
        df.filter(F.col("v") == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.read_stream(spark, f"{folder}/in", df, per_batch=2)
    got = sorted(r.v for r in jobs.drain(jobs.ttl_dedup(stream.select("k", "ts", "v"), ["k"], "ts", "v", 3_600_000_000), "ttl").collect())
    batch = agentlogs.ttl_hits(df.withColumn("at", F.unix_micros("ts")), "k", "at", "v", 3_600_000_000, parts=2)
    # One day of lateness behind the last call: the calls of the third of January still wait.
    want = sorted(r.v for r in batch.filter("not hit and ts < timestamp'2024-01-02 00:01:00'").collect())
    assert got == want == [1, 3, 4, 5, 7]


def test_leaf_recall_counts_neighbours_in_the_own_leaf(spark):
    near = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 1)], "id long, neighbour long")
    leaves = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 1)], "id long, topic int, leaf long")
    assert similarity.leaf_recall(near, leaves, "id").head().recall == 0.5


def test_as_of_close_is_strictly_after(spark):
    from attestry.operators import records

    reviews = spark.createDataFrame([("k", 1, 10), ("k", 2, 20), ("j", 3, 5)], "key string, id long, at long")
    runs = spark.createDataFrame([("k", 7, 10), ("k", 8, 15), ("k", 9, 15), ("j", 6, 5)], "key string, id long, at long")
    got = {r.review: r.run for r in records.closes_after(reviews, runs, "key", parts=3).collect()}
    assert got == {1: 8, 2: None, 3: None}


def test_registry_grows_by_turn_and_ends_with_its_session(spark, folder):
    own = jobs.with_timers(spark)
    hour = lambda h, m=0: 1_700_000_000 + 3600 * h + 60 * m
    batches = [
        [("a", hour(0), 1, "user", "keep x"), ("a", hour(0, 4), 2, "user", "keep y"), ("a", hour(0, 2), 2, "assistant", "keep z"), ("b", hour(0, 1), 1, "user", "hello")],
        [("a", hour(0, 9), 3, "user", "keep x"), ("a", hour(0, 3), 2, "user", "keep w"), ("b", hour(0, 5), 2, "user", "keep x"), ("b", hour(0, 6), 3, "user", None)],  # late but inside the watermark
        [("a", hour(1), 4, "user", "keep x")],  # a new session of the same name
        [("z", hour(30), 1, "user", "keep last")],
        [("z", hour(60), 1, "user", "hello")],
    ]
    schema = "s string, sec long, turn long, role string, text string"
    for rows in batches:
        own.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("sec")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    like = own.createDataFrame([], schema).withColumn("at", F.timestamp_seconds("sec"))
    stream = jobs.constraint_registry(jobs.read_stream(own, f"{folder}/in", like, per_batch=1), "s", "at", "turn", "text", F.col("text").startswith("keep"), idle="30 minutes")
    out, q = f"{folder}/out", None
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.s, r.turn, r.number, r.text) for r in own.read.parquet(out).collect())
    assert got == [("a", 1, 1, "keep x"), ("a", 2, 2, "keep w"), ("a", 2, 3, "keep y"), ("a", 4, 1, "keep x"), ("b", 2, 1, "keep x"), ("z", 1, 1, "keep last")]
    # Of all sessions only the last one still has a turn that waits; registries and times of the others are gone.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    assert q.recentProgress and spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_draws_keep_every_stratum_at_its_size(spark):
    rows = [(s, f"{s}{i}", i % 3, 4) for s, n in (("a", 60), ("b", 1), (None, 7)) for i in range(n)] + [("a", None, 1, 1)]
    df = spark.createDataFrame(rows, "s string, c string, top long, n long")
    got = statistics.resampled(df, "c", 30, "seed", ["s"], parts=3).collect()
    size = {}
    for r in got:
        size[r._stratum, r.draw] = size.get((r._stratum, r.draw), 0) + r.weight
    assert len(size) == 90 and set(size.values()) == {60, 1, 7}
    assert {(r._stratum, r.c, r.draw, r.weight) for r in got} == {(r._stratum, r.c, r.draw, r.weight) for r in statistics.resampled(df.repartition(5), "c", 30, "seed", ["s"], parts=1).collect()}
    told = {r.statistic: r for r in statistics.resampled_ratios(df, "c", {"x": ("top", "n"), "y": ("n", "n")}, 50, "k", ["s"], pairs=[("y", "x")]).collect()}
    assert told["y"].low == told["y"].high == 1.0 and told["x"].low < told["x"].median < told["x"].high
    assert abs(told["y - x"].median - 1 + told["x"].median) < 1e-9 and told["y - x"].excludes_zero


def test_frequent_grams_are_whole_whatever_the_filter_lets_through(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.random() < 0.3, [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(0, 30))]) for _ in range(300)] + [("a", True, None)]
    want = {}
    for g, back, w in rows:
        for n in (1, 2, 3):
            for i in range(len(w or []) - n + 1):
                y, b = want.get((g, " ".join(w[i : i + n])), (0, 0))
                want[g, " ".join(w[i : i + n])] = (y + 1, b + back)
    total = {}
    for (_, gram), (y, _) in want.items():
        total[gram] = total.get(gram, 0) + y
    often = {k: v for k, v in want.items() if total[k[1]] >= 5}
    marked = spark.createDataFrame(rows, "g string, _bg boolean, w array<string>")
    for log_bits in (27, 7):
        got = {(r.g, r.gram): (r.y, r.b) for r in similarity.frequent_grams(marked, "g", 3, 5, log_bits).collect()}
        assert got.items() <= want.items() and often.items() <= got.items()
        assert log_bits < 27 or len(got) < len(want) / 4


def _shuffled_rows(spark, df):
    """Rows that the stages of one run of ``df`` hand to a shuffle."""
    store, g = spark._jsc.sc().statusStore(), spark._sc._gateway
    stages = lambda: store.stageList(spark._jvm.java.util.ArrayList(), False, False, g.new_array(g.jvm.double, 0), spark._jvm.java.util.ArrayList())
    written = lambda: sum(s.shuffleWriteRecords() for s in (stages().apply(i) for i in range(stages().size())))
    before = written()
    df.write.format("noop").mode("overwrite").save()
    return written() - before


def test_decompose_shuffles_no_copies(spark):
    items = spark.range(1600).select((F.col("id") % 2).alias("topic"), "id", F.lit(10).cast("long").alias("len"))
    cons = items.filter("id % 4 < 2").select("id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("scope")).unionByName(spark.sql("select 9999L as id, 1L as scope"))
    out = agentlogs.decompose(items, cons, "topic", "id", "len", 60)
    got = [(r.topic, r.chunk, r.id, r.replicated) for r in out.collect()]
    own = {(r.id % 2, i): (r.id // 2 * 10) // 50 for r in items.collect() for i in [r.id]}
    want = {(t, c, i, False) for (t, i), c in own.items()} | {(t, c, i, True) for i in [*(i for i in range(1600) if i % 4 < 2), *[9999]] for t in ([0, 1] if i < 9999 else [1]) for c in range(160) if own.get((t, i)) != c}
    assert len(got) == len(want) and set(got) == want
    # No table is small enough to be sent whole, as at size.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffled_rows(spark, agentlogs.decompose(items, cons, "topic", "id", "len", 60)) < len(got) / 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bm25_equals_brute_force_whatever_the_lots(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randrange(n)))
    docs = [(f"d{i:03d}", words(30)) for i in range(150)] + [(f"e{i:03d}", "w1 w2 w3 w4") for i in range(150)] + [("f", None)]
    asks = [(i, words(12)) for i in range(40)]
    barred = {(q, d) for q, _ in asks for d, _ in docs if rng.random() < 0.05}
    split = {d: (t or "").split() for d, t in docs}
    held, avg = [w for d, w in split.items() if d != "f"], sum(map(len, split.values())) / 300
    n, want = 301, set()
    df = {}
    for w in held:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    for q, t in asks:
        of = lambda w: sum(np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for x in set(t.split()) if x in w)
        scored = sorted((-round(float(of(w)), 6), d) for d, w in split.items() if set(w) & set(t.split()) and (q, d) not in barred)
        want |= {(q, d, r + 1) for r, (_, d) in enumerate(scored[:7])}
    frames = spark.createDataFrame(asks, "query long, text string"), spark.createDataFrame(docs, "doc string, text string")
    for sizes in ({}, {"deal": 20, "ask": 9}):
        out = retrieval.bm25(*frames, 7, without=spark.createDataFrame(list(barred), "query long, doc string"), **sizes)
        assert {(r.query, r.doc, r["rank"]) for r in out.collect()} == want
    assert _shuffled_rows(spark, out) < 12_000


def test_near_copies_hand_grams_of_one_document_on_but_once(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(400)] + texts()[:40]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "id long, text string")
    store, g = spark._jsc.sc().statusStore(), spark._sc._gateway
    stages = lambda: store.stageList(spark._jvm.java.util.ArrayList(), False, False, g.new_array(g.jvm.double, 0), spark._jvm.java.util.ArrayList())
    handed = lambda: sum(s.shuffleWriteRecords() for s in (stages().apply(i) for i in range(stages().size())))
    before = handed()
    got = {r.id: r.near_copy for r in similarity.near_copies(docs, "id", "text").collect()}
    grams = sum(max(0, len(t.split()) - 2) for _, t in rows)
    assert handed() - before < 1.6 * grams
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    near = lambda a, b: bool(a and b) and len(a & b) / len(a | b) > 0.7
    assert got == {i: any(near(s, sets[j]) for j in range(i)) for i, s in sets.items()} and any(got.values())
