"""Lexical search, nearest neighbours and tokenizer alignment against brute force, and their edge cases."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from attestry.llm import alignment, lexical_search, nearest


def words(text):
    fold = lambda c: c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c.isalnum() else " "
    return "".join(map(fold, text or "")).split(" ")


def ranked(docs, items, k):
    """All scores of the contract's formula, the plain way."""
    bags = [(key, Counter(w for w in words(text) if w)) for key, text in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_all = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        found = []
        for (key, bag), n in zip(bags, sizes):
            m = 50 + (50 * n * n_docs) // n_all if n_all else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 20 * m)) for w in {w for w in words(text) if w} & bag.keys())
            if score > 0:
                found.append((-score, key is None, key))
        out += [(item, r, key, -score) for r, (score, _, key) in enumerate(sorted(found)[:k], 1)]
    return out


def test_lexical_search_equals_all_scores(spark):
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    crowd = " ".join(word() for _ in range(30))
    docs = [(i, crowd if i % 3 == 0 else " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    docs += [(401, None), (402, ""), (403, " .,\t"), (None, "W1 w2-w3 É"), (7, docs[7][1]), (404, "w9 " * 30_000 + "é É ½"), (405, "É w5")]
    items = [(i, " ".join(word() for _ in range(8))) for i in range(12)] + [(20, None), (21, "  "), (22, "unknown"), (23, "é É"), (24, crowd), (24, crowd), (None, "w1 W1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "text as key", "1 as n", "2 as terms", "3 as score").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as q", "8 as rank")
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))
    for options in ({"rows_each": 64, "leaf": 8}, {"block_terms": 20, "entries_each": 300, "leaf": 4}):
        got = lexical_search.rank_documents(d, q, k=10, **options)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert order(tuple(r) for r in got.collect()) == order(ranked(docs, items, 10))


def test_lexical_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.rank_documents(none, one).count() == 0
    docs = one.withColumnRenamed("item_id", "doc_id")
    assert lexical_search.rank_documents(docs, one.limit(0)).count() == 0
    # One document holds each of its terms everywhere, so their weight is 0 (log of 4 / 3 is not: it counts).
    assert [r.score for r in lexical_search.rank_documents(docs, one).collect()] == [2 * 287 * (10**9 // (1000 + 20 * 100))]


def test_ball_trees_bound_every_row_and_leave_leaves_closed():
    rng = np.random.default_rng(2)
    groups = [rng.choice(500, 12, False) for _ in range(40)]
    found = [np.sort(rng.choice(groups[i % 40], 9, False)) for i in range(1600)]
    values = [rng.integers(1, 2**35, 9) for _ in found]
    rows = lexical_search.Rows(np.arange(0, 9 * 1601, 9), np.concatenate(found), np.concatenate(values))
    rows = rows.ordered(lexical_search.leaf_order(rows, 500, 16))
    tree = lexical_search.Tree(rows, 500, 16)
    queries = lexical_search.Queries([np.sort(rng.choice(500, 6, False)) for _ in range(20)] + [np.sort(g) for g in groups[:5]])
    dense = np.zeros((1600, 500), np.int64)
    dense[np.repeat(np.arange(1600), 9), rows.terms] = rows.values
    scores = np.stack([dense[:, q].sum(1) for q in queries.of], 1)
    bounds = tree.bounds(queries)
    for at, (lo, hi, left) in enumerate(tree.nodes):
        assert (bounds[at] >= scores[lo:hi].max(0)).all()
        if not left:
            assert all((tree.scored(at, q) == scores[lo:hi, i]).all() for i, q in enumerate(queries.of))
    best = [[] for _ in queries.of]
    opened = tree.search(queries, list(range(1600)), best, 5, np.ones(25, np.int64))
    assert opened < 0.5 * 25 * sum(1 for n in tree.nodes if not n[2])
    assert all([-b[0] for b in best[i]] == [s for s in sorted(scores[:, i])[::-1][:5] if s > 0] for i in range(25))


# --- tokenizer alignment


A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def aligned(texts):
    """Groups and links token by token, counts over all pairs of occurrences."""
    import sentencepiece
    from tokenizers import Tokenizer

    signs = {c: b for c, b in alignment.byte_alphabet().items()}
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    out, links = [], []
    for text in texts:
        if not text:
            out.append((0, 0, 0, "")), links.append([])
            continue
        left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if not b"".join(x for _, x in left) == b"".join(x for _, x in right) == b" " + text.encode():
            out.append((0, 0, 0, "")), links.append([])
            continue
        place = lambda side: [(i, sum(len(x) for _, x in side[:k]), sum(len(x) for _, x in side[: k + 1])) for k, (i, _) in enumerate(side)]
        left, right = place(left), place(right)
        both = sorted({e for *_, e in left} & {e for *_, e in right})
        groups = [(",".join(str(i) for i, _, e in left if lo < e <= hi), ",".join(str(i) for i, _, e in right if lo < e <= hi)) for lo, hi in zip([0, *both], both)]
        links.append([(i, j) for i, s, e in left for j, t, f in right if s < f and t < e])
        out.append((len(left), len(right), len(groups), ";".join("|".join(g) for g in groups)))
    count = Counter(p for own in links for p in own)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [(*o[:3], len(own), sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), o[3]) for o, own in zip(out, links)], count


def test_alignment_equals_all_token_pairs(spark):
    rng = random.Random(4)
    base = ["the stupidity of anticonstitutionalism", "ünïcödé — naïve façade", "<|endoftext|> and <s> </s> <unk>", "日本語のテキスト 👩‍👩‍👧 x", "  two  spaces\n\n\tand tabs ", "a", " ", "1234567890.55", "un▁der", "l'État s'est-il 'll 've"]
    values = [(i, " ".join(rng.sample(base, rng.randrange(1, 4)))) for i in range(60)] + [(60, None), (61, ""), (62, "x" * 3000), (None, "a"), (7, "a"), (7, "a")]
    want, count = aligned([t for _, t in values])
    docs = spark.createDataFrame(values, "doc_id long, text string").selectExpr("*", "1 as n_a", "2 as spill", "'k' as key", "3 as part").repartition(3)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    for options in ({}, {"records": 300, "chars": 200, "fan": 2, "radix": 4, "most_bytes": 5_000}):
        texts, pairs = alignment.align(docs, A, B, **options)
        assert texts.columns == names
        assert sorted(map(repr, texts.collect())) == sorted(repr(type(texts.head())(*names)(k, *w)) for (k, _), w in zip(values, want))
        top = {j: max(n for (_, k), n in count.items() if k == j) for _, j in count}
        assert sorted((r.a_id, r.b_id, r.n, r.best) for r in pairs.collect()) == sorted((i, j, n, n == top[j]) for (i, j), n in count.items())
    hashed = {r.doc_id: r.groups for r in alignment.align(docs, A, B, digest=True)[0].filter("doc_id < 10").collect()}
    assert hashed[3] == hashlib.sha256(want[3][-1].encode()).hexdigest()


def test_alignment_of_an_empty_table(spark):
    texts, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert texts.count() == 0 and pairs.count() == 0


def test_runs_merge_across_blocks():
    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(0, 200_000, n)) for n in (1, 60_000, 90_000, 5)]
    counts = [rng.integers(1, 9, len(k)) for k in keys]
    got = [np.concatenate(x) for x in zip(*alignment.merged([alignment.packed(k, c) for k, c in zip(keys, counts)]))]
    want = Counter()
    for k, c in zip(keys, counts):
        want.update(dict(zip(k.tolist(), c.tolist())))
    assert dict(zip(got[0].tolist(), got[1].tolist())) == want and (np.diff(got[0]) > 0).all()


# --- nearest neighbours


def nearest_rows(rows, queries, k):
    """All inner products, the plain way; a query leaves one row equal to it out."""
    good = [(i, v) for i, v in rows if v and any(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in queries:
        if (i, v) not in good:
            continue
        rest = list(good)
        rest.remove((i, v))
        scored = sorted((-float(np.dot(v, w)), j is None, j) for j, w in rest if len(w) == len(v))
        out += [(i, r, j, round(-s, 9)) for r, (s, _, j) in enumerate(scored[:k], 1)]
    return out


def test_nearest_equals_all_products_where_nothing_may_be_missed(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 12)]) for i in range(300)]
    rows = [(i, rows[0][1] if i % 4 == 0 else v) for i, v in rows]
    rows += [(300, None), (301, []), (302, [0.0] * 12), (303, [1.0, None] + [0.5] * 10), (304, [float("nan")] + [1.0] * 11), (305, [float("inf")] + [1.0] * 11)]
    rows += [(306, [1.0, 2.0, 3.0]), (307, [2.0, 2.0, 3.0]), (40, rows[0][1]), (41, rows[41][1]), (None, rows[41][1]), (308, [1e-3 * x for x in rows[5][1]]), (309, [1e3 * x for x in rows[6][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as key", "2 as v", "3 as q", "4 as list", "5 as rank").repartition(4)
    queries = [(i, v) for i, v in rows if i is not None and i % 20 == 0 or i in (306, 309)]
    for options in ({}, {"list_rows": 40, "chunk_rows": 16, "block": 4, "columns": 5, "first_lists": 1}):
        got = nearest.search(df, df.filter("vec_id % 20 = 0 or vec_id in (306, 309)"), k=7, misses=0.0, risk=50.0, **options)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))
        assert order((*tuple(r)[:3], round(r.score, 9)) for r in got.collect()) == order(nearest_rows(rows, queries, 7))


def test_nearest_recall_and_empty_tables(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 6000)] + 0.7 * rng.standard_normal((6000, 32))
    x[::3] = centres[0] + 0.02 * rng.standard_normal((2000, 32))  # a third of all rows stands close together
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(df, df.filter("vec_id % 50 = 0"), list_rows=64).collect()
    want = nearest_rows(rows, rows[::50], 20)
    assert len(got) == len(want)
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    assert nearest.search(df.limit(0), df).count() == nearest.search(df, df.limit(0)).count() == 0


def test_scan_abandons_most_pairs_early():
    rng = np.random.default_rng(8)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    x[:20] = q + 0.1 * rng.standard_normal((20, 64))
    cut = lambda m: [m[:, c : c + 16] for c in range(0, 64, 16)]
    at_q, at_x, done = nearest.scan(cut(x), (x**2).sum(1), cut(q), (q**2).sum(1), np.full(20, 40.0), 1.3)
    assert {(i, i) for i in range(20)} <= set(zip(at_q.tolist(), at_x.tolist()))
    assert len(at_q) < 200 and done < 0.7 * 20 * 2000 * 64
