"""Retrieval queries: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import retrieval as rt
from attestry.plans.catalogue import Tables, query

TOKEN_PATTERN = r"""[\s.,;:!?|()\[\]{}"''%*#$&<>/=-]+"""


def tokens_sql(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '{TOKEN_PATTERN}'), lambda w: w <> '')"


def bm25_sql(k: int, where: str = "true") -> str:
    return f"""words as (select doc_id as doc, {tokens_sql('text')} as w from documents where {where}),
asked as (select distinct item_id as query, unnest({tokens_sql('text')}) as t from benchmark),
posts as (select doc, len(w) as n, unnest(w) as t from words), tf as (select doc, n, t, count(*) as tf from posts where t in (select t from asked) group by all),
st as (select count(*) as nd, avg(len(w)) as avgl from words), df as (select t, count(*) as df from tf group by 1),
scored as (select query, doc, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avgl))), 9) as score from tf join asked using (t) join df using (t), st group by all),
ranked as (select *, row_number() over (partition by query order by score desc, doc) as rank from scored qualify rank <= {k})"""


def _asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query"), "text")


def _docs(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("doc"), "text", "lang", "source", "n_chars")


ENGLISH = "lang = 'en'"


@query("bm25", "M69", f"with {bm25_sql(10, ENGLISH)} select query, doc, round(score, 6) as score, rank from ranked")
def _(t):
    return rt.bm25(_asked(t), _docs(t), 10, F.col("lang") == "en")


PINNED = "pinned as (select item_id as query, doc_id as doc from (select item_id, 'src' || (item_id % 20) as scope from benchmark) b join documents d on d.source = b.scope where contains(d.text, 'token'))"


def _pinned(t: Tables) -> DataFrame:
    scope = t.benchmark.select(F.col("item_id").alias("query"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    rules = t.documents.filter(F.col("text").contains("token")).select(F.col("doc_id").alias("doc"), "source")
    return scope.join(rules, "source").select("query", "doc")


@query("retrieve_pinned", "M56", f"""
with {bm25_sql(1000000)}, {PINNED}, n as (select query, count(*) as n from pinned group by 1),
o as (select query, doc, row_number() over (partition by query order by score desc, doc) as rn from ranked anti join pinned using (query, doc))
select query, doc, 1::bigint as pinned from pinned union all select query, doc, 0 from o left join n using (query) where rn <= 20 - coalesce(n, 0)""")
def _(t):
    pinned = _pinned(t)
    return rt.retrieve_pinned(rt.bm25(_asked(t), _docs(t), 20, without=pinned), pinned, 20)


@query("recall_at_k", "M57", f"""
with {bm25_sql(50)}, {PINNED}, p as (select query, {', '.join(f'avg((coalesce(rank, 999999) <= {k})::int) as r{k}' for k in (5, 10, 20, 50))} from pinned left join ranked using (query, doc) group by 1)
{' union all '.join(f'select {k}::bigint as k, round(avg(r{k}), 6) as recall from p' for k in (5, 10, 20, 50))}""")
def _(t):
    return rt.recall_at_k(rt.bm25(_asked(t), _docs(t), 50), _pinned(t), [5, 10, 20, 50])


CENTROID_SQL = """u as (select vec_id, label, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
dims as (select label, dim, avg(x) as m from (select label, unnest(e) / n as x, generate_subscripts(e, 1) as dim from u) group by all),
cent as (select label, list(m order by dim) as c from dims group by 1), cn as (select label, c, sqrt(list_dot_product(c, c)) as cl from cent)"""


@query("dense_topk", "M70", f"""
with {CENTROID_SQL}, s as (select cn.label, vec_id as neighbour, round(list_dot_product(e, c) / (n * cl), 9) as similarity from u, cn)
select label::bigint as label, neighbour, round(similarity, 6) as similarity, row_number() over (partition by label order by similarity desc, neighbour) as rank from s qualify rank <= 5""")
def _(t):
    c = rt.centroids(t.embeddings, "label", "embedding")
    return rt.dense_topk(c, "label", "centroid", t.embeddings, "vec_id", "embedding", 5)


@query("prototype_class", "M70", f"""
with {CENTROID_SQL}, s as (select vec_id, cn.label, round(list_dot_product(e, c) / (n * cl), 9) as s from u, cn),
b as (select vec_id, arg_max(label, row(s, -label)) as predicted, max(s) as s from s group by 1)
select vec_id, predicted::bigint as predicted, round(s, 6) as confidence, case when s >= 0.55 then 'sure' when s >= 0.4 then 'unsure' else 'hard' end as lane from b""")
def _(t):
    return rt.prototype_class(t.embeddings, "vec_id", "embedding", rt.centroids(t.embeddings, "label", "embedding"), "label")


@query("neighbour_join", "M15", """
with u as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
s as (select a.vec_id, b.vec_id as neighbour, round(list_dot_product(a.e, b.e) / (a.n * b.n), 9) as similarity from u a join u b on a.vec_id <> b.vec_id)
select vec_id, neighbour, round(similarity, 6) as similarity, row_number() over (partition by vec_id order by similarity desc, neighbour) as rank from s qualify rank <= 5""")
def _(t):
    return rt.neighbour_join(t.embeddings, "vec_id", "embedding", 5)
