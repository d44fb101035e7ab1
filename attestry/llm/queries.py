"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import alignment, jaccard_join, lexical_search, licenses, line_dedup, mixing, nearest, pieces, private_data, quality, toxicity, url_filters, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# The rules of the contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

OP6_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM cut),
urls AS (SELECT page_id, host, regexp_extract(tail, '^[^?#]*') AS path FROM parts),
judged AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM urls)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged"""


@query("op6_url_filters", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filters.judge(pages, url_filters.rule_table(pages, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


@query("op9_license_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents")).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(3)) == 1
    model = toxicity.fit(docs, labels.filter(~held(F.col("doc_id"))))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_mixing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP7_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
told AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS said FROM lines),
w AS (SELECT doc_id, i AS p, lead(i) OVER o AS q, lead(i, 2) OVER o AS r, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM told WHERE said WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT a, b, c, min(struct_pack(d := doc_id, p := p)) AS first FROM w WHERE r IS NOT NULL GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest([p, q, r]) AS i FROM w JOIN f USING (a, b, c) WHERE r IS NOT NULL AND struct_pack(d := doc_id, p := p) > first),
left_ AS (SELECT t.doc_id, string_agg(line, chr(10) ORDER BY i) AS text, bool_or(said) AS said FROM told t ANTI JOIN gone g USING (doc_id, i) GROUP BY t.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n_removed, 0) AS n_removed,
  md5(CASE WHEN n_removed IS NULL THEN coalesce(d.text, '') WHEN said THEN l.text ELSE '' END) AS text_md5
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN left_ l USING (doc_id)"""


@query("op7_line_dedup", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    cut = line_dedup.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
classes AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
t AS (SELECT id, len(s) AS n, unnest(s) AS g FROM classes),
common AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (na + nb - k)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)
, walk AS (SELECT id AS a, id AS b FROM classes UNION SELECT walk.a, both_.b FROM walk JOIN both_ ON walk.b = both_.a),
low AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(low.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN classes ON list_sort(s.s) = classes.s LEFT JOIN low ON classes.id = low.a"""


@query("op5_ngram_jaccard_join", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.link(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")



_OP3_RATES = [("symbol_rate", 50, False), ("dup_line_rate", 750, False), ("repeat_rate", 750, False), ("mean_length", 30, True)]
OP3_SQL = r"""
WITH words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS i FROM documents),
wins AS (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM wins WHERE c IS NOT NULL),
again AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(length(w) - length(regexp_replace(w, '[#*$%&|<>]', '', 'g'))) AS n_symbols FROM words GROUP BY doc_id),
base AS (SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(n_symbols, 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 10000 // greatest(word_chars, 1) AS symbol_rate, n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_line_rate, n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS mean_length FROM base),
v AS (SELECT lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'mean_length']) AS measure, unnest([symbol_rate, dup_line_rate, repeat_rate, mean_length]) AS x FROM m WHERE NOT base_failed),
e AS (SELECT *, CASE WHEN x < 64 THEN x ELSE (x // pow(2, length(bin(x)) - 6)::BIGINT) * pow(2, length(bin(x)) - 6)::BIGINT END AS low FROM v),
q1 AS (SELECT lang, source, measure, count(*) AS n, quantile_disc(low, 0.25) AS q25, quantile_disc(low, 0.5) AS q50 FROM e GROUP BY ALL),
q2 AS (SELECT lang, measure, count(*) AS n, quantile_disc(low, 0.25) AS q25, quantile_disc(low, 0.5) AS q50 FROM e GROUP BY ALL),
q3 AS (SELECT measure, quantile_disc(low, 0.25) AS q25, quantile_disc(low, 0.5) AS q50 FROM e GROUP BY ALL),
q AS (SELECT q1.lang, q1.source, measure, CASE WHEN q1.n >= 100 THEN q1.q25 WHEN q2.n >= 100 THEN q2.q25 ELSE q3.q25 END AS q25, CASE WHEN q1.n >= 100 THEN q1.q50 WHEN q2.n >= 100 THEN q2.q50 ELSE q3.q50 END AS q50
  FROM q1 JOIN q2 USING (measure) JOIN q3 USING (measure) WHERE q1.lang IS NOT DISTINCT FROM q2.lang),
t AS (SELECT lang, source, """ + ", ".join(f"max(CASE WHEN measure = '{m}' THEN q50 + 6 * greatest(q50 - q25, {k}) END) AS {m}_hi, max(CASE WHEN measure = '{m}' THEN q50 - 6 * greatest(q50 - q25, {k}) END) AS {m}_lo" for m, k, _ in _OP3_RATES) + r""" FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(""" + " OR ".join(f"{m} > {m}_hi" + (f" OR {m} < {m}_lo" if low else "") for m, _, low in _OP3_RATES) + r""", false) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).drop("failed")


@query("op1_embedding_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, folder, "embeddings"))


@query("op4_private_data")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    told = private_data.find_private(table(spark, folder, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in private_data.KINDS]
    own = F.size("more").cast("long").alias("n_more")
    return told.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"), own)


# Where the public tokenizers lie; their place is a parameter of the operator.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


@query("op8_sentencepiece")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.encode(table(spark, folder, "documents"), PIECE_MODEL, all_ids=True)
    margin = (F.get("scores", F.lit(0)) - F.get("scores", F.lit(1))).alias("margin")
    return found.select("doc_id", "n_pieces", "score", margin, F.xxhash64("ids").alias("ids_hash"), F.xxhash64(F.get("n_best", F.lit(1))).alias("second_hash"), "decoded")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, docs),
x AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS x FROM tf JOIN n USING (doc_id) JOIN w USING (term), s),
z AS (SELECT item_id, doc_id, sum(x)::BIGINT AS score FROM q JOIN x USING (term) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM z WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""


@query("op11_lexical_search", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_nearest_neighbours")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest.search(vectors, vectors.filter("vec_id % 20 = 0"))


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    texts, _ = alignment.align(table(spark, folder, "documents"), BYTE_MODEL, PIECE_MODEL, digest=True)
    return texts.withColumnRenamed("groups", "groups_sha256")
