"""Similarity queries over documents, benchmark items, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions.text import squash
from attestry.operators import retrieval as rt
from attestry.operators import similarity as sim
from attestry.plans.catalogue import query
from attestry.plans.retrieval import tokens_sql
from attestry.plans.text import q, squash_sql
from attestry.session import written



@query("exact_dedup", "M78", f"select sha256({squash_sql('text')}) as digest, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def _(t):
    return sim.exact_dedup(t.documents, "doc_id", squash(F.col("text")))


def _tok(table: str, key: str) -> str:
    return f"select {key}, text, {tokens_sql('text')} as w from {table}"


def _long(table: str, key: str, n: int) -> str:
    return f"select distinct {key}, unnest(list_transform(range(1, greatest(0, len(w) - {n - 1}) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) as gram from ({_tok(table, key)})"


@query("ngram_overlap", "M72", f"""
with a as ({_long('documents', 'doc_id', 10)}), b as ({_long('benchmark', 'item_id', 10)})
select doc_id, item_id, count(*) as shared from a join b using (gram) group by all
union all select doc_id, null::bigint, 0 from documents where contains(text, 'token =')""")
def _(t):
    return sim.shared_with_seeds(t.documents, "doc_id", t.benchmark, "item_id", 10, F.col("text").contains("token ="))


BEST_SQL = f"""a as ({_long('documents', 'doc_id', 5)}), b as ({_long('benchmark', 'item_id', 5)}), n as (select item_id, count(*) as n from b group by 1),
h as (select doc_id, item_id, count(*) as c from a join b using (gram) group by all), m as (select doc_id, max(c / n) as s from h join n using (item_id) group by 1),
best as (select doc_id, round(coalesce(s, 0), 9) as similarity from documents left join m using (doc_id))"""


@query("decontaminate", "M71", f"with {BEST_SQL} select doc_id, round(similarity, 6) as similarity from best")
def _(t):
    return sim.decontaminate(t.documents, "doc_id", t.benchmark, "item_id", 5)


@query("leakage_report", "M71", f"""
with {BEST_SQL} select count(*) as n, round(avg(similarity), 6) as mean, count(*) filter (similarity >= 1) as exact, {', '.join(f'round(avg((similarity > {c})::int), 6) as above_{int(c * 100)}' for c in sim.LEVELS)},
round(median(similarity), 6) as median from best""")
def _(t):
    return sim.leakage_report(sim.decontaminate(t.documents, "doc_id", t.benchmark, "item_id", 5))


COSINE_SQL = """u as (select vec_id, label, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
best as (select a.vec_id, max(round(list_dot_product(a.e, b.e) / (a.n * b.n), 9)) as similarity from u a, u b where a.label <> 0 and b.label = 0 group by 1)"""


def _leaked_vectors(t):
    """Vectors of label 0 stand for the benchmark, all others for the training set."""
    return sim.decontaminate_vectors(t.embeddings.filter("label <> 0"), "vec_id", "embedding", t.embeddings.filter("label = 0"), "embedding")


@query("decontaminate_vectors", "M71", f"with {COSINE_SQL} select vec_id, round(similarity, 6) as similarity from best")
def _(t):
    return _leaked_vectors(t)


@query("leakage_report_vectors", "M71", f"""
with {COSINE_SQL} select count(*) as n, round(avg(similarity), 6) as mean, count(*) filter (similarity >= 1) as exact, {', '.join(f'round(avg((similarity > {c})::int), 6) as above_{int(c * 100)}' for c in sim.LEVELS)},
round(median(similarity), 6) as median from best""")
def _(t):
    return sim.leakage_report(_leaked_vectors(t))


@query("near_duplicates", "M73", f"""
with g as ({_long('documents', 'doc_id', 3)}), n as (select doc_id, count(*) as n from g group by 1),
c as (select a.doc_id, b.doc_id as other, count(*) as c from g a join g b on a.gram = b.gram and b.doc_id < a.doc_id group by all),
hit as (select distinct c.doc_id from c join n x on x.doc_id = c.doc_id join n y on y.doc_id = c.other where c / (x.n + y.n - c) > 0.7)
select doc_id, (doc_id in (select doc_id from hit))::int::bigint as near_copy from documents""")
def _(t):
    return sim.near_copies(t.documents, "doc_id", "text")


@query("diverse_select", "M74")
def _(t):
    return sim.diverse_select(t.benchmark, "item_id", "text", F.length("text"), 5)


WORDS_SQL = "list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda w: w <> '')"
DIST_SQL = f"""w as (select lang, source in ('src0', 'src1', 'src2', 'src3') as bg, {WORDS_SQL} as w from documents),
e as ({' union all '.join(f"select lang, bg, unnest(list_transform(range(1, greatest(0, len(w) - {n - 1}) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) as gram from w" for n in (1, 2, 3))}),
c as (select lang, gram, count(*) as y, count(*) filter (bg) as b from e group by all), pool as (select gram, sum(y) as a, sum(b) as back from c group by 1 having sum(y) >= 10),
k as (select c.lang, c.gram, c.y, pool.a, pool.back from c join pool using (gram)), tot as (select lang, sum(y) as n from k group by 1), st as (select sum(a)::double as sa, sum(back)::double as sb from pool),
z as (select lang, gram, y::bigint as y, round((ln((y + a/sa*1000) / (n + 1000 - y - a/sa*1000)) - ln((back + a/sa*1000) / (sb + 1000 - back - a/sa*1000))) / sqrt(1/(y + a/sa*1000) + 1/(back + a/sa*1000)), 9) as z from k join tot using (lang), st),
top as (select *, row_number() over (partition by lang order by z desc, gram) as rank from z qualify rank <= 40)"""


@query("distinctive_ngrams", "M75", f"with {DIST_SQL} select lang, gram, y, round(z, 6) as z, rank from top")
def _(t):
    return sim.distinctive_ngrams(t.documents, "lang", "text", F.col("source").isin("src0", "src1", "src2", "src3"))


@query("ngram_list_overlap", "M75", f"""
with {DIST_SQL}, o as (select x.lang as a, y.lang as b, count(*) as common from top x join top y on x.gram = y.gram and x.lang < y.lang group by all)
select a, b, common, round(common / ((select count(*) from top where lang = a) + (select count(*) from top where lang = b) - common), 6) as jaccard from o""")
def _(t):
    return sim.list_overlap(sim.distinctive_ngrams(t.documents, "lang", "text", F.col("source").isin("src0", "src1", "src2", "src3")), "lang")


@query("style_auc", "M76")
def _(t):
    return sim.style_auc(t.documents.join(t.labels, "doc_id"), "text", "quality", "source")


FAMILIES = {"secret": "(?i)token|password", "insult": "(?i)idiot|clown|stupid", "licence": "(?i)license|copyright"}


@query("keyword_candidates", "M77", f"""
with d as (select text, not contains(text, '%%%') as ok from documents)
select 'all' as step, count(*) as n from d union all select 'without spam', count(*) from d where ok
union all select 'candidates', count(*) from d where ok and ({' or '.join(f'regexp_matches(text, {q(p)})' for p in FAMILIES.values())})
{' '.join(f"union all select 'family:{n}', count(*) from d where ok and regexp_matches(text, {q(p)})" for n, p in FAMILIES.items())}""")
def _(t):
    return sim.keyword_candidates(t.documents, "text", F.col("text").contains("%%%"), FAMILIES)


@query("stitch", "M80")
def _(t):
    """All conversations and all vectors; what has no vector is a chain of its own, what has no conversation adds no length."""
    sizes = t.conversations.groupBy("conv_id").agg(F.sum(F.length("text")).alias("len"))
    items = sizes.join(t.embeddings, F.col("conv_id") == F.col("vec_id"), "full_outer").select(F.coalesce("conv_id", "vec_id").alias("conv_id"), "embedding", "len")
    return sim.stitch(items, "conv_id", "embedding", "len", target=8000)


@query("split_topics", "M117")
def _(t):
    return sim.split_topics(t.embeddings, "vec_id", "embedding", 40)


@query("topic_search_cost", "M117")
def _(t):
    """Share of items examined when a search stays in one leaf, and the share of true neighbours it still finds."""
    leaves = sim.split_topics(t.embeddings, "vec_id", "embedding", 40)
    near = rt.neighbour_join(t.embeddings, "vec_id", "embedding", 5)
    recall = sim.leaf_recall(near, leaves, "vec_id").select(F.struct("pairs", "recall")).scalar()
    return sim.examined_share(leaves).select("leaves", "largest", "items", "examined", recall["pairs"].alias("pairs"), recall["recall"].alias("recall"))


@query("topic_leaves", "M117", """
with n as (select count(*) as n, count(distinct embedding) as classes from embeddings) select n as items, 0::bigint as twice, 0::bigint as too_large, 1::bigint as bisected from n""")
def _(t):
    """What must hold of the leaves: every item in one, none larger than 40 unless its vectors are equal, no leaf inside another."""
    leaves = sim.split_topics(t.embeddings, "vec_id", "embedding", 40)
    leaves = written(leaves, "leaves")
    # Classes are told apart by digest: a vector itself would travel with every row.
    classes = t.embeddings.select("vec_id", F.sha2(F.to_json(F.struct("embedding")), 256).alias("class"))
    sizes = written(leaves.join(classes, "vec_id").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("class").alias("classes")), "sizes")
    upper = sizes.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("leaf") - 1), lambda i: F.substring(F.col("leaf"), F.lit(1), i))).alias("leaf"))
    inside = sizes.join(upper.distinct(), "leaf").agg(F.count(F.lit(1))).scalar()
    large = sizes.agg(F.count_if((F.col("n") > 40) & (F.col("classes") > 1))).scalar()
    return leaves.agg(F.count(F.lit(1)).alias("items"), (F.count(F.lit(1)) - F.countDistinct("vec_id")).alias("twice"), large.alias("too_large"), (inside == 0).alias("bisected"))
