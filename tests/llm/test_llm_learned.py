"""Vectors, mixing, toxicity, pieces, connected components and the pipeline."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import common, mixing, pieces, toxicity, vector_dedup
from attestry.llm.queries import PIECE_MODEL

needs_model = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no piece model here")


def test_components_chains_stars_and_nothing(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2003, 2001), (2002, 2003), (None, 5), (7000, 7000), (2003, 2001)]
    rnd.shuffle(edges)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)} | {2001: 2001, 2002: 2001, 2003: 2001}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- vectors


def vectors(seed=0, n=500):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    near = np.concatenate([base[i] + 0.05 * rng.standard_normal((rng.integers(1, 6), 16)) for i in range(0, n, 5)])
    hot = base[1] + 0.03 * rng.standard_normal((300, 16))
    return np.concatenate([base, near, hot, np.repeat(base[2:3], 40, 0)]).astype(np.float32)


def degrees(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    return links


@pytest.mark.parametrize("options", [{}, {"max_leaf": 32, "block": 40}, {"max_leaf": 16, "block": 64, "sample_rows": 60, "trees": 16}])
def test_vectors_recall_and_no_false_link(spark, options):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash"))
    out = {r.vec_id: r for r in vector_dedup.near_vectors(df, **options).collect()}
    links = degrees(x)
    want = links.sum(1)
    got = np.array([out[i].n_links for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
    if not options:
        comp = list(range(len(x)))
        for i in range(len(x)):
            for j in np.flatnonzero(links[i]):
                a, b = comp[i], comp[j]
                if a != b:
                    comp = [min(a, b) if c in (a, b) else c for c in comp]
        assert [out[i].component_id for i in range(len(x))] == comp
    assert all(out[i].kept == (i == out[i].component_id) for i in out)


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [3.0, 0.0]), (1, [1.0, 0.0]), (10, [1e38, 0.0])]
    out = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: r for r in out}
    assert by[1].n_links == by[2].n_links == by[None].n_links == by[10].n_links == 4
    assert by[2].component_id == by[10].component_id == by[None].component_id == 1 and not by[2].kept and by[1].kept
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (3, 4, 5, 6, 7, 8, 9))
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- mixing


def targets_brute(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        share = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: 2.0 * sizes[s] if s in capped else share * weight[s] for s in names}


@pytest.mark.parametrize("block", [1000, 20])
def test_mixing_targets_totals_and_reruns(spark, block):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 5, 20, 80, 200])), rnd.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(700)]
    rows += [(1000, None, "a"), (1001, "", "only"), (None, "x y", "b"), (5, "one two", "b"), (5, "one two", "b"), (1002, "w " * 100_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    out = mixing.mix(docs, block=block).collect()
    again = mixing.mix(docs.repartition(3), block=block).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken, most = targets_brute(sizes), {}, {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, most[s]), s
    # About as many texts as the chances ask for, within what the open ones can move.
    chosen = [r for r in out if r.source == "a" and r.size]
    ratio = want["a"] / sizes["a"]
    assert abs(sum(r.copies for r in chosen) - ratio * len(chosen)) <= 4


def test_mixing_flight_keeps_both_sums():
    rng = np.random.default_rng(0)
    size, chance = rng.integers(1, 500, 300).astype(float), np.full(300, 0.37)
    p = mixing.flight(size, chance, 1)
    assert ((p > 0) & (p < 1)).sum() <= 2 and abs(p.sum() - chance.sum()) < 1e-6 and abs((p * size).sum() - (chance * size).sum()) < 1e-4


def test_mixed_repeats_rows_and_empty(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a") for i in range(40)] + [(100 + i, "v " * 10, "b") for i in range(40)], "doc_id long, text string, source string")
    told = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and counts == {d: c for d, c in told.items() if c}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


# --- toxicity


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(rnd.randint(3, 8))) for _ in range(500)]
    bad = ["stupid", "idiot", "worthless"]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(vocab) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            w[rnd.randrange(40)] = rnd.choice(bad)
        rows.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_held_out_and_disguises(spark, toxic_corpus):
    docs, labels, truth = toxic_corpus
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = toxicity.fit(docs, labels.filter(~held))
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), model).withColumn("held", held).collect()
    mine = [r for r in out if r.held]
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in mine) >= 0.97 * len(mine)
    rows = [(1, "you are st0op1d"), (2, "so stuuuupid now"), (3, "an 1d10t indeed"), (4, "s t u p i d one"), (5, "w.o.r.t.h.l.e.s.s"), (6, None), (7, ""), (8, "a1" * 40_000), (9, "$tup!d"), (10, "x " * 50_000 + "idiot")]
    by = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(by[i] >= 0.7 for i in (2, 3, 4, 5, 9, 10)), by
    assert all(by[i] < 0.1 for i in (6, 7, 8)), by


@pytest.fixture(scope="module")
def english_model(spark):
    rnd = random.Random(12)
    vocab = "the of and to in is it was for on that with this idea good thing will letter people house water small little made over our out day they have from one had word but not what all were when your can said there use each which she how their a a a an as at be by he if we i i you so up do no go me my".split()
    rows = [(i, " ".join([rnd.choice(vocab) for _ in range(60)] + ([rnd.choice(["stupid", "idiot", "worthless"])] if i % 6 == 0 else []))) for i in range(900)]
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(900)], "doc_id long, toxic int"))


def scores(spark, model, texts):
    out = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    return {texts[r.doc_id]: r.score for r in out}


def test_toxicity_spaces_in_the_lattice(spark, english_model):
    bad = ["you i d i o t!", "what a s t u p i d idea", "s t u p 1 d", "you are s\tt\tu\tp\ti\td", "i\nd\ni\no\nt", "an  i  d  i  o  t", "stuupid", "he is a i d i o t, so we go", "$ t u p ! d", "st up id", "w-o r t h l e s s", "s t u p i d i d i o t", "so ss tt uu pp ii dd"]
    by = scores(spark, english_model, bad)
    assert all(v >= 0.7 for v in by.values()), by
    fine = ["it is a good idea", "i am at it as he is so", "a b c d e f g", "1 2 3 4 5 a 6 7", "will all little people letter", "x " * 50_000, "- - - - a"]
    by = scores(spark, english_model, fine)
    assert all(v < 0.1 for v in by.values()), by


def test_toxicity_tokens_of_any_length(spark, english_model):
    rest = "the,people,in,this,house,have,water,from,over,there,and,they,will,not,go,out,"
    bad = ["stu" + "u" * 100 + "pid", "i.d.i.o.t." * 10, rest + "1d10t," + rest, (rest + "stup1d").replace(",", "/"), "这个人" * 30 + "。s.t.u.p.i.d。" + "很好" * 20, "w0rthl3ss," * 5_000]
    by = scores(spark, english_model, bad)
    assert all(v >= 0.7 for v in by.values()), [(k[:40], v) for k, v in by.items()]
    fine = [rest * 10, "/".join(["people.house", "w4ter"] * 50), "这个人" * 100 + "1", "a1" * 100_000, "x" * 100_000]
    by = scores(spark, english_model, fine)
    assert all(v < 0.1 for v in by.values()), [(k[:40], v) for k, v in by.items()]


def test_toxicity_without_labels_and_empty(spark, toxic_corpus):
    docs, labels, _ = toxic_corpus
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs.limit(3), none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
    nulls = spark.createDataFrame([(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, nulls)[1] == {}


# --- pieces


def segmentations(p, c):
    out = []

    def walk(i, score, ids):
        if i == len(c):
            out.append((score, tuple(ids)))
            return
        for j in range(i + 1, len(c) + 1):
            known = p.table.get(c[i:j].replace(pieces.BLANK, "\0").replace(" ", pieces.BLANK))
            if known:
                walk(j, score + known[1], [*ids, known[0]])
        if c[i].replace(pieces.BLANK, "\0").replace(" ", pieces.BLANK) not in p.table:
            walk(i + 1, score + p.unknown, ids + [p.bytes_[b] for b in c[i].encode()])

    walk(0, 0, [])
    return sorted(out, key=lambda x: -x[0])


@needs_model
def test_pieces_n_best_brute():
    p = pieces.Pieces.load(PIECE_MODEL)
    for c in [" hello", " thing,", "  ab▁c", "日🦄x", " the\t", " naïve."]:
        want = segmentations(p, c)
        for n in (1, 2, 6):
            got = pieces.n_best(p, c, n)
            assert [s for s, _ in got] == [s for s, _ in want[:n]] and set(got) <= set(want) and len(set(got)) == len(got)


@needs_model
def test_pieces_text_level_n_best():
    from array import array

    p = pieces.Pieces.load(PIECE_MODEL)
    for text in ("ab cd, e\nf", "on the"):
        want = segmentations(p, " " + text)
        for n in (1, 2, 3, 5):
            ids, best, scores, every = pieces.Encoder(p, n).encode(text)
            assert pieces.Encoder(p, n, all_ids=False).encode(text)[:3] == (ids, best, scores)
            found = [tuple(array("i", i)) for i in every]
            assert scores == [s for s, _ in want[:n]] and best == want[0][0]
            assert len(set(found)) == len(found) and set(zip(scores, found)) <= set(want) and found[0] == tuple(array("i", ids))


def test_pieces_with_real_scores():
    p = pieces.Pieces({"a": (1, -1.25), "b": (2, -0.5), "ab": (3, -1.8), "▁": (4, -0.1), "▁a": (5, -1.3)}, list(range(10, 266)), [], -20.5)
    for c in (" ab", " abba", "aab", " azb"):
        for n in (1, 3, 7):
            got, want = pieces.n_best(p, c, n), segmentations(p, c)
            assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]]) and {i for _, i in got} <= {i for _, i in want} and len(got) == min(n, len(want))


@needs_model
def test_pieces_round_trip_and_edges(spark):
    values = [(1, "Hello  world \n\n tabs\tand ▁ blanks "), (2, ""), (3, None), (4, "🦄é你好\x00"), (5, "a" * 20_000), (6, "  "), (1, "again"), (None, "null key"), (7, "word " * 20_000)]
    docs = spark.createDataFrame(values, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    found = pieces.encode(docs, PIECE_MODEL, n=3, all_ids=True)
    out = pieces.decode(found.withColumn("text", F.lit("old")), PIECE_MODEL).collect()
    assert len(out) == len(values)
    want = {}
    for d, t in values:
        want.setdefault(d, set()).add(t)
    for r in out:
        assert r.text in want[r.doc_id]
        if r.ids is None:
            assert r.doc_id == 3 and r.decoded is None and r.score is None and r.n_best is None
        else:
            assert r.decoded and r.n_pieces == len(r.ids) and r.n_best[0] == r.ids and len(r.n_best) == len(r.scores)
            assert r.scores == sorted(r.scores, reverse=True) and r.score == r.scores[0]
    # Every one of the n best gives the same text back.
    others = pieces.decode(found.select("doc_id", F.explode("n_best").alias("ids")), PIECE_MODEL, out="again").collect()
    assert all(r.again in want[r.doc_id] for r in others) and len(others) > len(values)
    assert pieces.encode(docs.limit(0), PIECE_MODEL).count() == 0
    odd = spark.createDataFrame([([],), (None,), ([5, None],), ([99_999_999],), ([-1],)], "ids array<int>")
    assert [r.text for r in pieces.decode(odd, PIECE_MODEL).collect()] == ["", None, None, None, None]


@needs_model
def test_pieces_query_reads_every_segmentation(spark, tmp_path):
    from attestry.llm.queries import QUERIES

    docs = spark.createDataFrame([(1, "Hello wörld, again"), (2, "🦄 on the\nroad"), (3, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = pieces.encode(docs, PIECE_MODEL, all_ids=True)
    want = {r.doc_id: (r.margin, r.a, r.b) for r in found.select("doc_id", (F.get("scores", F.lit(0)) - F.get("scores", F.lit(1))).alias("margin"), F.xxhash64("ids").alias("a"), F.xxhash64(F.get("n_best", F.lit(1))).alias("b")).collect()}
    assert want[1][1] != want[1][2] and want[2][1] != want[2][2]
    assert {r.doc_id: (r.margin, r.ids_hash, r.second_hash) for r in QUERIES["op8_sentencepiece"](spark, str(tmp_path)).collect()} == want


# --- the pipeline


@needs_model
def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnrst"]
    line = lambda: " ".join(rnd.choice(vocab) for _ in range(12))
    passage = [line() for _ in range(5)]
    rows = []
    for i in range(240):
        body = [line() for _ in range(6)] + (passage if i % 10 == 0 else [])
        if i % 8 == 3:
            body[0] += " worthless stupid"
        rows.append((i, "\n".join(body), "en", f"s{i % 4}", 0))
    rows += [(500, rows[1][1].replace("\n", " "), "en", "s1", 0), (501, rows[1][1].replace("\n", " "), "en", "s1", 0), (502, None, None, None, None), (503, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 3)) for i in range(240)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        now = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        seen[name] = now
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen) and all(d.columns == docs.columns for d in list(seen.values())[:-1])
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert kept == {d for d, *_ in rows if d >= 500 or d % 8 != 3}
    cut = {r.doc_id: r.text for r in seen["line dedup"].collect()}
    assert sum(passage[2] in (t or "") for t in cut.values()) == 1 and set(cut) == kept
    assert {1, 500} & {r.doc_id for r in seen["n-gram Jaccard join"].collect()} == {1} and 501 not in {r.doc_id for r in seen["n-gram Jaccard join"].collect()}
    assert seen["pieces"].filter("decoded = false").count() == 0 and seen["pieces"].count() == seen["mixing"].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["pieces"].count()


@needs_model
def test_last_stage_returns_every_segmentation(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "Hello wörld, again"), (2, ""), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in corpus_pipeline.in_pieces(spark, docs, str(tmp_path)).collect()}
    assert out[3].n_best is None and all(len(out[i].n_best) == len(out[i].scores) and out[i].n_best[0] == out[i].ids for i in (1, 2))
    assert len(out[1].n_best) == 2 and out[1].n_best[0] != out[1].n_best[1]
