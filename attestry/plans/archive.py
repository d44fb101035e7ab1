"""Source, sink and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators.ordering import running
from attestry.plans.catalogue import query
from attestry.plans.text import sentence_sql
from attestry.session import shared_folder
from attestry.sources import files, reports


@query("read_documents", "A01", """
select doc_id, case when lang <> 'es' then 'Paper' end as type, case when lang <> 'es' then 'On ' || source end as title,
  case when lang <> 'es' then doc_id::varchar end as arxiv_id, case when lang <> 'es' then '7' end as arxiv_version, sha256(text) as body from documents""")
def _(t):
    head = F.concat(F.lit("---\ntype: Paper\ntitle: 'On "), "source", F.lit("'\narxiv:\n  id: '"), "doc_id", F.lit("'\n  version: 7\n---\n\n"))
    raw = t.documents.select("doc_id", F.when(F.col("lang") == "es", F.col("text")).otherwise(F.concat(head, "text")).alias("value"))
    return files.parse_documents(raw, "value", ["type", "title", "arxiv.id", "arxiv.version"], ["doc_id"]).withColumn("body", F.sha2("body", 256))


ATOM_SQL = """
select {key}'24' || lpad((p_size % 12 + 1)::varchar, 2, '0') || '.' || lpad(p_partkey::varchar, 5, '0') as id, p_size::bigint as version, p_name || ' study' as title,
  'A' || p_partkey || ';B ' || p_brand as authors, '2024-01-01T00:00:00Z' as published, 'cs.CL;' || p_type as categories, 'cs.CL' as primary_category, 'about ' || p_name as summary from part"""


@query("read_atom", "A02", ATOM_SQL.format(key="p_partkey, "))
def _(t):
    e = files.entries_from_text(_entries(t), "xml", ["p_partkey"])
    return _shown(e, "p_partkey")


def _entries(t):
    pid = F.concat(F.lit("24"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    xml = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), pid, F.lit("v"), "p_size", F.lit("</id><title>"), "p_name", F.lit("\n  study</title><published>2024-01-01T00:00:00Z</published><summary>about\n "), "p_name",
        F.lit("</summary><author><name>A"), "p_partkey", F.lit("</name></author><author><name>B "), "p_brand", F.lit('</name></author><category term="cs.CL"/><category term="'), "p_type", F.lit('"/></entry>'),
    )
    return t.part.select("p_partkey", xml.alias("xml"))


def _shown(e, *keep):
    return e.select(*keep, "id", "version", "title", F.array_join("authors", ";").alias("authors"), "published", F.array_join("categories", ";").alias("categories"), "primary_category", "summary")


@query("read_atom_files", "A02", ATOM_SQL.format(key=""))
def _(t):
    """The same entries written as feeds and scanned as files, each of which holds many."""
    path = shared_folder(t.spark, "feeds")
    lots = F.pmod(F.xxhash64("p_partkey"), F.lit(max(1, -(-t.part.count() // 500)))).alias("lot")
    feeds = _entries(t).groupBy(lots).agg(F.concat(F.lit("<feed>"), F.concat_ws("\n", F.collect_list("xml")), F.lit("</feed>")).alias("value"))
    feeds.write.partitionBy("lot").text(path)
    return _shown(files.read_atom(t.spark, path))


@query("read_results", "A05", """
select o_orderkey as run, unnest(['a', 'a', 'b']) as condition, unnest([1, 1, 2])::bigint as seed, unnest(['cust', 'status', 'cust']) as metric,
  unnest([o_custkey::varchar, o_orderstatus, (o_custkey + 1)::varchar]) as value from orders""")
def _(t):
    obs = lambda c, s, m: F.struct(F.lit(c).alias("condition"), F.lit(s).alias("seed"), m.alias("metrics"))
    cust = F.col("o_custkey")
    one = F.create_map(F.lit("cust"), cust.cast("string"), F.lit("status"), F.col("o_orderstatus"))
    two = F.create_map(F.lit("cust"), (cust + 1).cast("string"))
    doc = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.array(obs("a", 1, one), obs("b", 2, two)).alias("observations")))
    return files.facts_from_text(t.orders.select(F.col("o_orderkey").alias("run"), doc.alias("doc")), "doc", "run")


@query("read_ledger", "A06", """
select o_orderkey as id, 'hypothesis' as kind, o_orderpriority as title, case o_orderstatus when 'F' then 'supported' when 'O' then 'candidate' else 'dropped' end as claim_status,
  '/papers/sources/' || o_custkey || '.md' as source from orders""")
def _(t):
    status = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "candidate").otherwise("dropped")
    ev = F.array(F.struct(F.concat(F.lit("/papers/sources/"), "o_custkey", F.lit(".md")).alias("source")))
    doc = F.to_json(F.struct(F.lit("hypothesis").alias("kind"), F.col("o_orderpriority").alias("title"), status.alias("claim_status"), ev.alias("evidence")))
    r = files.records_from_text(t.orders.select(F.col("o_orderkey").alias("id"), doc.alias("doc")), "doc", "claim", ["id"])
    return r.select("id", "kind", "title", "claim_status", F.col("evidence")[0]["source"].alias("source"))


@query("hash_files", "A07", "select doc_id, octet_length(encode(text))::bigint as size, sha256(text) as sha256 from documents")
def _(t):
    return files.hash_text(t.documents, "text", "doc_id")


NOTES_SQL = f"""docs as (select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id)),
lines as (
  select * from (values (0, '', '', '# Index of Papers'), (1, '', '', ''),
    (2, '', '', '<!-- Generated by `write_index` from frontmatter. Edits here are overwritten; edit the papers instead. -->'),
    (3, '', '', ''), (4, '', '', '# Notes'), (5, '', '', ''), (8, '', '', ''), (9, '', '', '# Sources'), (10, '', '', '')) v(section, published, title, line)
  union all select 6, '', 'Note ' || doc_id, '* [Note ' || doc_id || '](' || doc_id || '.md) (' || case quality when 1 then 'human-reviewed' else 'machine-confirmed' end || '; draft) - ' || {sentence_sql('text')}
    from docs where quality is not null
  union all select 11, '2024-0' || (1 + doc_id % 9), 'Paper ' || doc_id, '* [Paper ' || doc_id || '](sources/' || doc_id || '.md) (arXiv:' || doc_id || 'v1; 2024-0' || (1 + doc_id % 9) || '; '
    || case when toxic = 0 then 'machine-confirmed' else 'unverified' end || case when lang = 'de' then '; route:pdf' else '' end || ') - ' || {sentence_sql('text')} from docs)"""


def _index(t):
    d = t.documents.join(t.labels, "doc_id", "left").withColumns({"id": F.col("doc_id").cast("string"), "description": F.col("text")})
    notes = d.filter("quality is not null").withColumns({"title": F.concat(F.lit("Note "), "id"), "status": F.lit("draft"), "verified_by": F.when(F.col("quality") == 1, "human:r").otherwise("process:c")})
    sources = d.withColumns({"title": F.concat(F.lit("Paper "), "id"), "version": F.lit("1"), "published": F.concat(F.lit("2024-0"), (1 + F.col("doc_id") % 9).cast("string")), "route": F.when(F.col("lang") == "de", "pdf").otherwise("html"), "verified_by": F.when(F.col("toxic") == 0, "process:c")})
    return reports.index_lines(notes, sources)


@query("write_index", "A08", f"with {NOTES_SQL} select row_number() over (order by section, published desc, title desc) as nr, line from lines")
def _(t):
    """Write the report to the shared folder and read it back with each line's place."""
    path = shared_folder(t.spark, "index")
    reports.write_index(_index(t), path)
    back = t.spark.read.text(path).select(F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    # Part numbers follow report order; inside a part the reading order does.
    part = F.regexp_extract("f", r"part-([0-9]+)", 1).cast("int").alias("part")
    return running(back.select("line", "at", part), [], ["part", "at"], number="nr").select("nr", "line")


@query("ordered_index", "A53", "select doc_id, n_chars, lang from documents order by n_chars desc, lang desc, doc_id desc")
def _(t):
    return reports.ordered_index(t.documents.select("doc_id", "n_chars", "lang"), "n_chars", "lang", "doc_id")


@query("review_status", "A17", """
select doc_id, case when quality = 1 then 'human-reviewed' when quality = 0 then 'machine-confirmed' else 'unverified' end || case when lang = 'de' then '; route:pdf' else '' end as status
from documents left join labels using (doc_id)""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    by = F.when(F.col("quality") == 1, "human:r").when(F.col("quality") == 0, "process:c")
    return d.select("doc_id", reports.review_status(by, F.when(F.col("lang") == "de", "pdf").otherwise("html")).alias("status"))


@query("publish", "A09", """
select doc_id, source, case when source in ('src1', 'src2') then sha256(text || '!') else sha256(text) end as body from documents where source not in ('src1', 'src2') or lang <> 'fr'""")
def _(t):
    """Publish every source once, then a new version of two of them; the others stay as they were."""
    table = shared_folder(t.spark, "published")
    first = t.documents.select("doc_id", F.sha2("text", 256).alias("body"), "source")
    reports.publish(first, table, "source")
    second = t.documents.filter("source in ('src1', 'src2') and lang <> 'fr'").select("doc_id", F.sha2(F.concat("text", F.lit("!")), 256).alias("body"), "source")
    reports.publish(second, table, "source")
    return reports.read_published(t.spark, table, first.schema, "source")


REPORT_SQL = """r as (select c_custkey as id, coalesce(case o when 'F' then 'saved' when 'O' then 'up-to-date' when 'P' then 'failed' end, 'failed') as status
  from customer left join (select o_custkey, min(o_orderstatus) as o from orders where o_orderpriority = '1-URGENT' group by 1) on o_custkey = c_custkey)"""


def _report(t):
    got = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderstatus").alias("o"))
    outcomes = got.select("id", F.when(F.col("o") == "F", "saved").when(F.col("o") == "O", "up-to-date").otherwise("failed").alias("status"))
    return reports.batch_report(t.customer.select(F.col("c_custkey").alias("id")), outcomes, "id")


@query("batch_report", "A10", f"with {REPORT_SQL} select id, status, (status = 'failed')::int::bigint as exit from r")
def _(t):
    return _report(t)


@query("batch_status_counts", "A10", f"""
with {REPORT_SQL} select count(*) filter (status = 'saved') as saved, count(*) filter (status = 'up-to-date') as up_to_date, count(*) filter (status = 'failed') as failed from r""")
def _(t):
    return reports.status_counts(_report(t), ["saved", "up-to-date", "failed"])


@query("fill_stats", "A51", """
select user_id, count(*) filter (event_type in ('click', 'view')) as "count", count(*) filter (event_type = 'error') as failed, count(*) filter (event_type in ('signup', 'purchase')) as skipped,
  round(sum(value::decimal(18,2))::double, 6) as cost from events group by 1""")
def _(t):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type").isin("click", "view"), "described").otherwise("skipped")
    return reports.fill_stats(t.events.select("user_id", outcome.alias("outcome"), F.col("value").cast("decimal(18,2)").alias("cost")), ["user_id"])


@query("read_event_log", "M01", """
select event_id, row_number() over (order by ts, event_id) as seq, case when length(payload) > 40 then left(payload, 40) || '…' else payload end as payload,
  case when length(payload) > 40 then 'sha256:' || sha256(payload) end as pointer
from (select *, event_type || repeat(props, case when event_type = 'error' then 5 else 1 end) as payload from events)""")
def _(t):
    payload = F.concat("event_type", F.when(F.col("event_type") == "error", F.repeat("props", 5)).otherwise(F.col("props")))
    log = files.event_log(t.events.select("event_id", "ts", payload.alias("payload")), ["ts", "event_id"], "payload", 40)
    return log.select("event_id", "seq", "payload", "pointer")


@query("resolve_payloads", "M01", """
with p as (select *, event_type || repeat(props, case when event_type = 'error' then 5 else 1 end) as payload from events)
select event_id, sha256(payload) as body, (select count(distinct payload) from p where length(payload) > 40) as stored from p""")
def _(t):
    """The log with its payloads beside it in two appends, resolved again; equal payloads are stored once."""
    payload = F.concat("event_type", F.when(F.col("event_type") == "error", F.repeat("props", 5)).otherwise(F.col("props")))
    events = t.events.select("event_id", "ts", "user_id", payload.alias("payload"))
    log, path = files.event_log(events, ["ts", "event_id"], "payload", 40), shared_folder(t.spark, "payloads")
    held = lambda: t.spark.read.schema("pointer string, payload string").parquet(path)
    files.payload_store(events.filter("user_id < 500"), "payload", 40).write.parquet(path)
    files.payload_store(events, "payload", 40, held()).write.mode("append").parquet(path)
    stored = held().agg(F.count(F.lit(1))).scalar()
    return files.resolve(log, held(), "payload").select("event_id", F.sha2("payload", 256).alias("body"), stored.alias("stored"))
