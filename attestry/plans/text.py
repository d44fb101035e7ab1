"""Text, number, reference and page queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import latex, pages, refs, text
from attestry.operators import coverage, findings
from attestry.plans.catalogue import Tables, query
from attestry.session import written


def q(pattern: str) -> str:
    """A pattern as SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def squash_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def normalize_sql(c: str) -> str:
    c = f"regexp_replace({c}, {q(text.IMAGE)}, '', 'g')"
    c = f"regexp_replace({c}, {q(text.LINK)}, '\\1', 'g')"
    c = f"regexp_replace({c}, {q(text.SUBSCRIPT)}, '\\1', 'g')"
    c = f"translate({c}, '{text.SCRIPT_DIGITS}', '{text.PLAIN_DIGITS}')"
    c = f"regexp_replace({c}, {q(text.INVISIBLE)}, '', 'g')"
    c = f"regexp_replace({c}, {q(text.MARKUP)}, '', 'g')"
    return squash_sql(f"replace({c}, chr(160), ' ')")


@query("normalize_text", "A24", f"select doc_id, {normalize_sql('text')} as norm from documents")
def _(t):
    return t.documents.select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query("squash_whitespace", "A25", f"select conv_id, turn, {squash_sql('text')} as text from conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", text.squash(F.col("text")).alias("text"))


@query("sanitize_label", "A26", r"""
select conv_id, turn, translate(regexp_replace(regexp_replace('[' || turn || '] ' || text || chr(10), '^\s+|\s+$', '', 'g'), '[\r\n]+', '\\n', 'g'), '[]', '()') as label from conversations""")
def _(t):
    raw = F.concat(F.lit("["), "turn", F.lit("] "), "text", F.lit("\n"))
    return t.conversations.select("conv_id", "turn", text.sanitize_label(raw).alias("label"))


def redact_sql(c: str) -> str:
    c = f"regexp_replace({c}, {q(text.SECRET_PAIR)}, '\\1{text.REDACTED}', 'g')"
    c = f"regexp_replace({c}, {q(text.SECRET_ARGUMENT)}, '\\1{text.REDACTED}', 'g')"
    return f"regexp_replace({c}, {q(text.URL_CREDENTIALS)}, '\\1{text.REDACTED}@', 'g')"


@query("redact_secrets", "A27", f"select doc_id, {redact_sql('text')} as text from documents")
def _(t):
    return t.documents.select("doc_id", text.redact_secrets(F.col("text")).alias("text"))


def numbers_sql(c: str) -> str:
    for p in (text.FRONTMATTER, text.REFERENCES, text.TABLE_ROW):
        c = f"regexp_replace({c}, {q(p)}, '', 'g')"
    return f"list_distinct(list_filter(regexp_extract_all({c}, {q(text.NUMBER)}, 2), lambda x: not regexp_matches(x, {q(text.YEAR)})))"


@query("extract_numbers", "A28", f"select doc_id, unnest({numbers_sql('text')}) as number from documents")
def _(t):
    return t.documents.select("doc_id", F.explode(text.extract_numbers(F.col("text"))).alias("number"))


# A line of running text with an equation per order line; both engines build it from the same columns.
EQ_SQL = "'cost $' || l_quantity::int || 'x + ' || l_linenumber || '$ then $$' || l_returnflag || ' = ' || l_suppkey || '$$ end'"


def _equation_text():
    return F.concat(F.lit("cost $"), F.col("l_quantity").cast("int"), F.lit("x + "), "l_linenumber", F.lit("$ then $$"), "l_returnflag", F.lit(" = "), "l_suppkey", F.lit("$$ end"))


@query("extract_equations", "A29", f"""
select l_orderkey, l_partkey, l_suppkey, unnest(list_transform(regexp_extract_all({EQ_SQL}, {q(text.EQUATION)}, 1), lambda x: {squash_sql("replace(x, '$', '')")})) as equation from lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.explode(text.extract_equations(_equation_text())).alias("equation"))




def _tex_lines(t: Tables) -> DataFrame:
    """One LaTeX line per order line, kept as its own file so that no order is gathered into one value."""
    line = F.concat(
        F.lit("Row "), "l_returnflag", "l_linenumber", F.lit(" & "), F.col("l_quantity").cast("int"), F.lit(".5 & \\result{r"), "l_suppkey",
        F.lit("/m/acc}{mean}{2} and x_"), "l_linenumber", F.lit(" \n\\cite{k"), "l_partkey", F.lit(",\n m"), "l_suppkey", F.lit("} % note "), "l_partkey",
    )
    return t.lineitem.select(F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)")).alias("file"), line.alias("tex"))


FILE_SQL = "concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice::decimal(18,2)) as file"


@query("bare_numbers", "A30", f"select {FILE_SQL}, 1::bigint as line, l_quantity::int || '.5' as number from lineitem")
def _(t):
    return latex.bare_numbers(_tex_lines(t), "tex", "file")


@query("material_gaps", "A30", """
select doc_id, i::bigint as line from (select doc_id, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) as i
  from (select doc_id, replace(replace(text, ' de ', ' [MATERIAL GAP] '), ' and ', ' [material gap] ') as t from documents)) where contains(l, '[MATERIAL GAP]')""")
def _(t):
    text = F.replace(F.replace("text", F.lit(" de "), F.lit(" [MATERIAL GAP] ")), F.lit(" and "), F.lit(" [material gap] "))
    return latex.material_gaps(t.documents.select("doc_id", text.alias("text")), "text", "doc_id")


@query("cite_keys", "A33", f"select {FILE_SQL}, 2::bigint as line, unnest(['k' || l_partkey, 'm' || l_suppkey]) as key from lineitem")
def _(t):
    return latex.cite_keys(_tex_lines(t), "tex", "file")


def _bib(t: Tables) -> DataFrame:
    pid = F.concat(F.lit("24"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    by_type = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("  eprint = {"), pid, F.lit("},\n  archivePrefix = {arXiv},\n")))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("  journal = {arXiv preprint arXiv:"), pid, F.lit("v3},\n")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("  url = {https://arxiv.org/abs/"), pid, F.lit("v1},\n")))
        .otherwise(F.lit('  publisher = "A (house)",\n'))
    )
    return t.part.select("p_partkey", F.concat(F.lit("% refs\n@Article{p"), "p_partkey", F.lit(",\n  title = {"), "p_name", F.lit("},\n"), by_type, F.lit("  year = 2024\n}\n")).alias("bib"))


@query("parse_reference_fields", "A32", """
with f as (select p_partkey, 'p' || p_partkey as key, 'article' as type, '24' || lpad(p_size::varchar, 2, '0') || '.' || lpad(p_partkey::varchar, 5, '0') as pid, * exclude (p_partkey) from part)
select p_partkey, key, type, 'title' as field, p_name as value from f
union all select p_partkey, key, type, 'year', '2024' from f
union all select p_partkey, key, type, 'eprint', pid from f where p_type = 'ECONOMY'
union all select p_partkey, key, type, 'archiveprefix', 'arXiv' from f where p_type = 'ECONOMY'
union all select p_partkey, key, type, 'journal', 'arXiv preprint arXiv:' || pid || 'v3' from f where p_type = 'SMALL'
union all select p_partkey, key, type, 'url', 'https://arxiv.org/abs/' || pid || 'v1' from f where p_type = 'LARGE'
union all select p_partkey, key, type, 'publisher', 'A (house)' from f where p_type not in ('ECONOMY', 'SMALL', 'LARGE')""")
def _(t):
    return latex.reference_fields(_bib(t), "bib", "p_partkey")


@query("reference_papers", "A32", """
select p_partkey, 'p' || p_partkey as key, '24' || lpad(p_size::varchar, 2, '0') || '.' || lpad(p_partkey::varchar, 5, '0') as paper,
  case p_type when 'SMALL' then 3 when 'LARGE' then 1 end::bigint as version from part where p_type in ('ECONOMY', 'SMALL', 'LARGE')""")
def _(t):
    return latex.reference_papers(latex.reference_fields(_bib(t), "bib", "p_partkey"), "p_partkey")


def _replies(t: Tables) -> DataFrame:
    reply = (
        F.when(F.col("event_type") == "error", F.lit("I can't help with this."))
        .when(F.col("event_type") == "signup", F.when(F.col("value") > 50, "I read it.").otherwise(""))
        .when(F.col("event_type") == "view", F.concat(F.lit('Sure:\n```json\n{"s": "}{\\"}", "d": {"a": {"b": {"c": {}}}}, "k": '), F.get_json_object("props", "$.k"), F.lit('}\n```\nor {"k": 1}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"z": {"y": {"x": '), "props", F.lit("}}}")))
        .otherwise(F.col("props"))
    )
    return t.events.select("event_id", reply.alias("reply"))


@query("first_json", "A34", """
select event_id, case when event_type in ('view', 'purchase') then json_extract(props, '$.k')::bigint end as k,
  case event_type when 'error' then 'refused' when 'signup' then 'failed' when 'click' then 'invalid' else 'ok' end as status from events""")
def _(t):
    found = F.from_json(text.first_json(F.col("reply")), "k long")["k"]
    return _replies(t).select("event_id", found.alias("k"), text.reply_status(F.col("reply"), "k long", "k").alias("status"))


def sentence_sql(c: str) -> str:
    first = f"regexp_extract({c}, {q(text.FIRST_SENTENCE)}, 1)"
    s = squash_sql(f"case when {first} = '' then {c} else {first} end")
    return f"case when length({s}) > 220 then rtrim(left({s}, 219)) || '…' else {s} end"


@query("short_description", "A18", f"select doc_id, {sentence_sql('text')} as description from documents")
def _(t):
    return t.documents.select("doc_id", text.short_description(F.col("text")).alias("description"))


REF_SQL = """case o_orderpriority when '1-URGENT' then 'https://arxiv.org/pdf/24' || lpad((o_custkey % 12 + 1)::varchar, 2, '0') || '.' || lpad(o_orderkey::varchar, 5, '0') || 'v2.pdf'
  when '2-HIGH' then 'arXiv:24' || lpad((o_custkey % 12 + 1)::varchar, 2, '0') || '.' || lpad(o_orderkey::varchar, 5, '0')
  when '3-MEDIUM' then '  https://arxiv.org/abs/hep-th/' || lpad(o_orderkey::varchar, 7, '0') || 'v1?context=cs '
  when '4-NOT SPECIFIED' then 'https://openreview.net/forum?id=' || o_orderkey else ' Order ' || o_orderstatus end"""


def _refs() -> object:
    month = F.lpad((F.col("o_custkey") % 12 + 1).cast("string"), 2, "0")
    num = F.lpad(F.col("o_orderkey").cast("string"), 5, "0")
    p = F.col("o_orderpriority")
    return (
        F.when(p == "1-URGENT", F.concat(F.lit("https://arxiv.org/pdf/24"), month, F.lit("."), num, F.lit("v2.pdf")))
        .when(p == "2-HIGH", F.concat(F.lit("arXiv:24"), month, F.lit("."), num))
        .when(p == "3-MEDIUM", F.concat(F.lit("  https://arxiv.org/abs/hep-th/"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit("v1?context=cs ")))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("https://openreview.net/forum?id="), "o_orderkey"))
        .otherwise(F.concat(F.lit(" Order "), "o_orderstatus"))
    )


@query("canonical_ref", "A11", f"""
with r as (select *, {REF_SQL} as ref from orders),
p as (select o_orderkey, o_orderpriority, case o_orderpriority when '3-MEDIUM' then 'hep-th/' || lpad(o_orderkey::varchar, 7, '0')
  when '1-URGENT' then '24' || lpad((o_custkey % 12 + 1)::varchar, 2, '0') || '.' || lpad(o_orderkey::varchar, 5, '0')
  when '2-HIGH' then '24' || lpad((o_custkey % 12 + 1)::varchar, 2, '0') || '.' || lpad(o_orderkey::varchar, 5, '0') end as id, ref from r)
select o_orderkey, case when id is null then 'title' else 'id' end as kind, id,
  case o_orderpriority when '1-URGENT' then 2 when '3-MEDIUM' then 1 end::bigint as version, case when id is null then trim(ref) end as query from p""")
def _(t):
    return t.orders.select("o_orderkey", refs.canonical_ref(_refs()).alias("r")).select("o_orderkey", "r.*")


@query("safe_key", "A12", "select page_id, replace(url, '/', '_') as key from pages")
def _(t):
    return t.pages.select("page_id", refs.safe_key(F.col("url")).alias("key"))


@query("pin_version", "A13", """
select o_orderkey, coalesce(case when o_orderstatus = 'F' then 9 end, case o_orderpriority when '1-URGENT' then 2 when '3-MEDIUM' then 1 end, 5)::bigint as version from orders""")
def _(t):
    argument = F.when(F.col("o_orderstatus") == "F", 9)
    return t.orders.select("o_orderkey", refs.pin_version(argument, _refs(), F.lit(5)).alias("version"))


HOSTS = ["ththre.example.com", "therin.example.net", "thther.example.org"]


@query("allowed_host", "A14", f"""
select page_id, (regexp_extract(url, '^(https)://([^/:?#]+)', 1) = 'https' and regexp_extract(url, '^https?://([^/:?#]+)', 1) in ({', '.join(map(q, HOSTS))}))::int::bigint as allowed from pages""")
def _(t):
    return t.pages.select("page_id", refs.allowed_host(F.col("url"), HOSTS).alias("allowed"))


@query("sniff_type", "A19", """
select page_id, case when url like 'https://m.%' then 'png' when url like 'http://%' then 'svg' when url like '%.html' then 'pdf' when url like '%#top' then 'jpeg' end as type from pages""")
def _(t):
    url = F.col("url")
    magic = (
        F.when(url.startswith("https://m."), F.unhex(F.lit("89504E470D0A1A0A")))
        .when(url.startswith("http://"), F.encode(F.lit('<?xml version="1.0"?><svg xmlns="s">'), "UTF-8"))
        .when(url.endswith(".html"), F.encode(F.lit("%PDF-1.7 "), "UTF-8"))
        .when(url.endswith("#top"), F.unhex(F.lit("FFD8FFE0")))
        .otherwise(F.unhex(F.lit("")))
    )
    content = F.concat(magic, F.encode(F.col("html"), "UTF-8"))
    return t.pages.select("page_id", refs.sniff_type(content).alias("type"))


@query("safe_members", "A20", """
with m as (select source as archive, doc_id, case when lang = 'es' then '../' else '' end || case when lang = 'de' then '/' else '' end || doc_id || '.tex' as name,
    text like '%|%' as is_link, n_chars as size from documents),
f as (select *, case when name like '/%' then 'absolute path' when name like '../%' then 'escapes its folder' when is_link then 'link' when size > 5000 then 'size over 5000' end as fault from m)
select archive, doc_id, name, coalesce(fault, case when sum((fault is null)::int) over (partition by archive order by doc_id) > 10 then 'too many members' end) as reason from f""")
def _(t):
    name = F.concat(F.when(F.col("lang") == "es", "../").otherwise(""), F.when(F.col("lang") == "de", "/").otherwise(""), "doc_id", F.lit(".tex"))
    m = t.documents.select(F.col("source").alias("archive"), "doc_id", name.alias("name"), F.col("text").contains("|").alias("is_link"), F.col("n_chars").alias("size"))
    return findings.safe_members(m, "archive", "doc_id", max_size=5000, max_members=10).select("archive", "doc_id", "name", "reason")


@query("slug_ok", "A22", f"""
select p_partkey, regexp_matches(p_brand, {q(refs.SLUG)})::int::bigint as brand_ok, regexp_matches(replace(p_name, ' ', '-'), {q(refs.SLUG)})::int::bigint as name_ok from part""")
def _(t):
    return t.part.select("p_partkey", refs.slug_ok(F.col("p_brand")).alias("brand_ok"), refs.slug_ok(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name_ok"))


@query("tag_slice", "A23", "select doc_id from documents where lang = 'fr' or source = 'fr'")
def _(t):
    from attestry.operators.selection import tag_slice

    return tag_slice(t.documents.withColumn("tags", F.array("lang", "source")), "tags", "fr").select("doc_id")


@query("title_candidates", "A15", """
with hits as (select p_partkey, p_name from part where contains(lower(p_name), 'red') and contains(lower(p_name), 'widget'))
select p_partkey, p_name as title, (lower(p_name) = 'red widget')::int::bigint as exact_title, (select count(*) from hits) as n_hits,
  case when (select count(*) from hits) = 1 then 'resolved' else 'ambiguous' end as outcome from hits""")
def _(t):
    from attestry.operators.selection import title_candidates

    return title_candidates(t.part.select("p_partkey", F.col("p_name").alias("title")), "title", "red widget")


def blocks_sql(extra: str = "") -> str:
    h = f"regexp_replace(html, {q(pages.HIDDEN)}, ' ', 'g')"
    split = f"string_split(regexp_replace({h}, {q(pages.BLOCK_TAG)}, chr(1) || '\\1\\2' || chr(2) || '\\3' || chr(3), 'g'), chr(1))"
    links = f"list_transform(regexp_extract_all({h}, {q('(' + pages.LINK + ')')}, 1), lambda a: 'a' || chr(2) || chr(3) || a)"
    plain = "regexp_replace(body, '<[^>]*>', '', 'g')"
    for entity, char in pages.ENTITIES:
        plain = f"replace({plain}, '{entity}', {q(char)})"
    return f"""pieces as (select page_id, unnest(list_concat({split}, {links})) as piece, generate_subscripts(list_concat({split}, {links}), 1) - 1 as ord from pages),
parts as (select page_id, ord::bigint as ord, lower(regexp_extract(piece, '^([^\x02]*)\x02', 1)) as tag, regexp_extract(piece, '(?s)\x03(.*)$', 1) as body from pieces),
blocks as (select page_id, ord, tag, case when tag = 'a' then 'link' when tag = 'p' then 'paragraph' when regexp_matches(tag, '^h[1-6]$') then 'heading' when tag = 'li' then 'item'
   when tag = 'title' then 'title' end as kind, {squash_sql(plain)} as text from parts)"""


BLOCKS_SQL = blocks_sql() + ", shown as (select * from blocks where kind is not null and text <> '')"


def _blocks(t: Tables) -> DataFrame:
    return pages.page_blocks(t.pages, "page_id", "html")


@query("extract_page_blocks", "A03", f"with {BLOCKS_SQL} select * from shown")
def _(t):
    return _blocks(t)


@query("construct_counts", "A50", f"""
with {BLOCKS_SQL} select page_id, count(*) filter (kind = 'paragraph') as n_paragraph, count(*) filter (kind = 'heading') as n_heading,
  count(*) filter (kind = 'item') as n_item, count(*) filter (kind = 'title') as n_title from shown group by 1""")
def _(t):
    return pages.construct_counts(_blocks(t), "page_id", ["paragraph", "heading", "item", "title"])


@query("section_path", "A52", f"""
with {BLOCKS_SQL}, heads as (select page_id, ord as at, substr(tag, 2)::int as level, text as head, lead(ord) over (partition by page_id, substr(tag, 2) order by ord) as next from shown where kind = 'heading'),
up as (select s.page_id, s.ord, h.level, h.head from shown s join heads h on h.page_id = s.page_id and h.at <= s.ord and (h.next is null or h.next > s.ord)
  where not exists (select 1 from heads x where x.page_id = s.page_id and x.level < h.level and x.at > h.at and x.at <= s.ord))
select s.page_id, s.ord, coalesce(string_agg(head, ' / ' order by level), '') as section from shown s left join up using (page_id, ord) group by s.page_id, s.ord""")
def _(t):
    return pages.section_path(_blocks(t), "page_id").select("page_id", "ord", "section")


@query("adjacent_pairs", "A54", f"""
with {BLOCKS_SQL}, w as (select *, lag(text) over (partition by page_id order by ord) as before, lead(text) over (partition by page_id order by ord) as after from shown)
select page_id, ord, text, before, after from w where kind = 'heading'""")
def _(t):
    return pages.adjacent_text(_blocks(t), "page_id", "heading")


@query("extract_tables", "A04", """
with o as (select o_orderkey, o_orderstatus as s, o_orderpriority as p, o_custkey::varchar as c from orders)
select o_orderkey, 0::bigint as "table", r::bigint as row, k::bigint as col, v as text from (
  select o_orderkey, 0 as r, 0 as k, 'state' as v from o union all select o_orderkey, 0, 1, 'fact' from o union all select o_orderkey, 0, 2, 'fact' from o
  union all select o_orderkey, 1, 0, s from o union all select o_orderkey, 2, 0, s from o
  union all select o_orderkey, 1, 1, p from o union all select o_orderkey, 1, 2, 'a & b' from o
  union all select o_orderkey, 2, 1, c from o union all select o_orderkey, 2, 2, c from o)""")
def _(t):
    html = F.concat(
        F.lit("<div><table class='x'><tr><th>state</th><th colspan=\"2\"><b>fact</b></th></tr><tr><td rowspan=\"2\">"), "o_orderstatus", F.lit("</td><td>"), "o_orderpriority",
        F.lit("</td><td>a &amp; b</td></tr>\n<tr><td colspan=2>"), "o_custkey", F.lit("</td></tr></table></div>"),
    )
    return pages.page_tables(t.orders.select("o_orderkey", html.alias("html")), "o_orderkey", "html")


COVER_SQL = f"""{BLOCKS_SQL}, body as (select page_id, {normalize_sql("string_agg(text, ' ' order by ord)")} as body from shown where kind <> 'link' and not (kind = 'paragraph' and text like '%,%' and length(text) < 60) group by 1),
found as (select page_id, ord, kind, text, coalesce(contains(body, {normalize_sql('text')}), false) as found from shown left join body using (page_id) where {normalize_sql('text')} <> '')"""


def _found(t: Tables) -> DataFrame:
    """Blocks against the text a conversion would give that loses links and short paragraphs with a comma.

    The converted text is built per page inside one row, from the page's own markup.
    """
    blocks = written(_blocks(t), "blocks")
    lost = (F.col("kind") == "link") | ((F.col("kind") == "paragraph") & F.col("text").contains(",") & (F.length("text") < 60))
    kept = blocks.filter(~lost)
    body = kept.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), " ").alias("body"))
    return coverage.located(blocks, body, "page_id", "body")


@query("coverage_missing", "A35", f"with {COVER_SQL} select page_id, ord, kind, left(text, 80) as preview from found where not found")
def _(t):
    return coverage.missing_blocks(_found(t), "page_id")


@query("coverage_check", "A35", f"""
with {COVER_SQL} select page_id, count(*) as total, count(*) filter (found) as matched, round(avg(found::int), 6) as coverage, (bool_and(found))::int::bigint as passed from found group by 1""")
def _(t):
    return coverage.coverage_report(_found(t), "page_id")


@query("count_reconcile", "A36", f"""
with {BLOCKS_SQL}, a as (select page_id, count(*) as n from shown where kind = 'paragraph' group by 1),
b as (select page_id, len(regexp_extract_all(html, '<p>')) as n from pages where url like 'https%')
select page_id, a.n as n_a, b.n as n_b, case when a.n is null or b.n is null then 'unchecked' when a.n = b.n then 'ok' else 'warning' end as status from a full join b using (page_id)""")
def _(t):
    a = _blocks(t).filter("kind = 'paragraph'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    b = t.pages.filter(F.col("url").startswith("https")).select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<p>)"), F.lit(1))).alias("n"))
    return coverage.count_reconcile(a, b, "page_id")


@query("number_presence", "A37", f"""
with src as (select doc_id, text from documents), der as (select doc_id, left(text, (n_chars // 2)::int) as text from documents),
a as (select doc_id, 'number' as kind, unnest({numbers_sql('text')}) as token from src
  union all select distinct doc_id, 'equation', {normalize_sql('e')} from (select doc_id, unnest(list_transform(regexp_extract_all(text, {q(text.EQUATION)}, 1), lambda x: {squash_sql("replace(x, '$', '')")})) as e from src)),
b as (select doc_id, 'number' as kind, unnest({numbers_sql('text')}) as token from der
  union all select distinct doc_id, 'equation', {normalize_sql('e')} from (select doc_id, unnest(list_transform(regexp_extract_all(text, {q(text.EQUATION)}, 1), lambda x: {squash_sql("replace(x, '$', '')")})) as e from der))
select * from a anti join b using (doc_id, kind, token)""")
def _(t):
    half = F.expr("left(text, cast(n_chars div 2 as int))")
    return coverage.number_presence(t.documents, t.documents.select("doc_id", half.alias("text")), "doc_id", "text")
