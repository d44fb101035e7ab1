"""Ledger queries: registry, seals, snapshots, evidence, reviews, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import digests, findings, records, registry
from attestry.operators.ordering import as_number, shifted, span_count
from attestry.plans.catalogue import Tables, query


def lines_as_observations(t: Tables) -> DataFrame:
    """Seed-level facts: run = return flag, condition = line status, seed = line number."""
    li = t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    per_seed = li.groupBy(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("condition"), F.col("l_linenumber").alias("seed")).agg(
        F.avg("l_quantity").cast("decimal(18,4)").cast("string").alias("quantity"),
        F.max("l_discount").cast("decimal(18,4)").cast("string").alias("top_discount"),
        F.when(F.min("l_tax") == 0, "nan").otherwise("1").alias("tax_floor"),
    )
    return per_seed.unpivot(["run", "condition", "seed"], ["quantity", "top_discount", "tax_floor"], "metric", "value")


LINES_SQL = """
per_seed as (
  select l_returnflag as run, l_linestatus as condition, l_linenumber as seed,
         cast(cast(avg(l_quantity) as decimal(18,4)) as varchar) as quantity,
         cast(cast(max(l_discount) as decimal(18,4)) as varchar) as top_discount,
         case when min(l_tax) = 0 then 'nan' else '1' end as tax_floor
  from lineitem group by all),
obs as (
  select run, condition, seed, 'quantity' as metric, quantity as value from per_seed
  union all select run, condition, seed, 'top_discount', top_discount from per_seed
  union all select run, condition, seed, 'tax_floor', tax_floor from per_seed),
nums as (select *, case when value = 'nan' then null else cast(value as decimal(38,9)) end as x from obs)
"""


def _runs(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_returnflag").alias("run")).distinct().withColumn("class", F.when(F.col("run") == "A", "confirmatory").otherwise("exploratory"))


def _metrics(t: Tables) -> DataFrame:
    rows = [("quantity", "items", "maximize"), ("top_discount", "ratio", "minimize")]
    return t.spark.createDataFrame(rows, "metric string, unit string, direction string")


@query("rebuild_registry", "L05", f"""
with {LINES_SQL}
select run || '/' || condition || '/' || metric as id, count(x) as n, round(avg(x::double), 6) as mean,
       round(stddev_samp(x::double), 6) as std, round(min(x)::double, 6) as min, round(max(x)::double, 6) as max,
       case metric when 'quantity' then 'items' when 'top_discount' then 'ratio' end as unit,
       case run when 'A' then 'confirmatory' else 'exploratory' end as class,
       case metric when 'quantity' then 'maximize' when 'top_discount' then 'minimize' end as direction
from nums group by run, condition, metric""")
def _(t):
    return registry.rebuild_registry(lines_as_observations(t), _runs(t), _metrics(t))


@query("registry_values", "L05", f"with {LINES_SQL} select run || '/' || condition || '/' || metric as id, seed::bigint as seed, value from obs")
def _(t):
    return registry.registry_values(lines_as_observations(t))


@query("sanity_warnings", "L07", f"""
with {LINES_SQL},
per_entry as (
  select run, condition, metric, string_agg(seed || '=' || coalesce(x::varchar, ''), ',' order by seed) as vals,
         cast(sum(x) as double) / count(x) as mean, count(x) as n, count(distinct seed) as seeds
  from nums group by all)
select distinct 'identical-values-across-conditions' as kind, run || '/' || metric as location from
  (select run, metric, vals from per_entry where n > 0 group by all having count(distinct condition) > 1)
union all select distinct 'identical-means', run || '/' || metric from
  (select run, metric, round(mean, 9) m from per_entry where n > 0 group by all having count(distinct condition) > 1)
union all select 'too-few-seeds', run || '/' || condition || '/' || metric from per_entry where seeds < 8
union all select distinct 'missing-metric-def', run || '/' || metric from obs where metric = 'tax_floor'
union all select distinct 'non-finite', run || '/' || condition || '/' || metric from nums where x is null
union all select distinct 'missing-condition', run || '/' || o_orderstatus
  from (select distinct run from obs), (select distinct o_orderstatus from orders)
  where (run, o_orderstatus) not in (select run, condition from obs)
union all select distinct 'unexpected-seeds', run || '/' || condition || '/' || seed from obs where seed > 6""")
def _(t):
    obs = lines_as_observations(t)
    runs = _runs(t).select("run")
    # The declared conditions of a run are the few order statuses, listed once per run.
    statuses = t.orders.groupBy().agg(F.collect_set("o_orderstatus").alias("s")).scalar()
    declared = runs.select("run", F.explode(statuses).alias("condition"))
    seeds = runs.select("run", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("seed"))
    return registry.sanity_warnings(obs, declared, _metrics(t), seeds, min_seeds=8)


ORDER_RUNS_SQL = """
runs as (select o_orderkey as run, case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'completed' end as status,
                o_orderpriority <> '5-LOW' as sealed from orders),
tampered as (select distinct l_orderkey as run from lineitem where l_discount = 0.1)"""


@query("exclude_runs", "L06", f"""
with {ORDER_RUNS_SQL}
select run, case when status <> 'completed' then 'status is ' || status when not sealed then 'no seal'
                 else 'seal does not match the files' end as reason
from runs where status <> 'completed' or not sealed or run in (select run from tampered)""")
def _(t):
    runs = t.orders.select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "O", "failed").otherwise("completed").alias("status"), (F.col("o_orderpriority") != "5-LOW").alias("sealed"))
    broken = t.lineitem.filter("l_discount = 0.1D").select(F.col("l_orderkey").alias("run"))
    return registry.exclude_runs(runs, broken)




@query("validate_records", "A21", """
select 'major' as severity, c_custkey || '.c_acctbal' as location, 'must not be negative' as message from customer where not coalesce(c_acctbal >= 0, false)
union all select 'major', c_custkey || '.c_name', 'wrong form' from customer where not coalesce(regexp_matches(c_name, '^Customer#[0-9]{9}$'), false)
union all select 'major', c_custkey || '.c_mktsegment', 'unknown segment' from customer where c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') or c_mktsegment is null
union all select 'major', c_custkey || '.c_nationkey', 'unknown nation' from customer where not coalesce(c_nationkey < 20, false)""")
def _(t):
    rules = [
        ("c_acctbal", F.col("c_acctbal") >= 0, "must not be negative"),
        ("c_name", F.col("c_name").rlike("^Customer#[0-9]{9}$"), "wrong form"),
        ("c_mktsegment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "unknown segment"),
        ("c_nationkey", F.col("c_nationkey") < 20, "unknown nation"),
    ]
    return findings.validate_records(t.customer, "c_custkey", rules)


@query("fingerprint_documents", "A16", """
select doc_id, left(sha256(text || chr(31) || lang || chr(31) || source || chr(31) || n_chars), 16) as fingerprint from documents""")
def _(t):
    return t.documents.select("doc_id", digests.fingerprint("text", "lang", "source", "n_chars").alias("fingerprint"))


def _set_sql(source: str, cols: list[str], keys: list[str]) -> str:
    joined = " || chr(31) || ".join(f"coalesce({c}::varchar, '')" for c in cols)
    words = " || ',' || ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::ubigint)::varchar" for i in range(4))
    key = ", ".join(keys)
    head = f"{key}, " if keys else ""
    tail = f" group by {key}" if keys else ""
    return f"select {head}count(*) as n_rows, sha256(count(*)::varchar || ',' || {words}) as digest from (select {head}sha256({joined}) as h from {source}){tail}"


@query("corpus_hash_documents", "L11", _set_sql("documents", ["doc_id", "text", "lang"], ["source"]))
def _(t):
    return digests.corpus_hash(t.documents, ["doc_id", "text", "lang"], ["source"])


@query("corpus_hash_orders", "L11", _set_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], []))
def _(t):
    return digests.corpus_hash(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


MANIFEST_SQL = """
listed as (
  select source || '/' || doc_id as path, length(text) as size, sha256(text) as sha from documents
  union all select '../' || n_name, n_nationkey, 'x' from nation
  union all select '/' || s_name, s_suppkey, 'x' from supplier
  union all select 'region/' || r_name, r_regionkey, 'x' from region
  union all select 'region/' || lower(r_name), r_regionkey, 'x' from region),
actual as (
  select source || '/' || doc_id as path,
         case when lang = 'fr' then length(replace(text, chr(10), ' ')) else length(text) end
           + case when lang = 'es' then 1 else 0 end as size,
         sha256(replace(text, chr(10), ' ')) as sha, lang = 'en' and text like '%|%' as is_link
  from documents where lang <> 'de'
  union all select 'bench/' || item_id, length(text), sha256(text), false from benchmark
  union all select 'region/' || r_name, r_regionkey, 'x', false from region
  union all select 'region/' || lower(r_name), r_regionkey, 'x', false from region)"""


@query("diff_manifest", "A41,A20", f"""
with {MANIFEST_SQL}, faults as (
  select path as location, case when path like '/%' then 'absolute path' when path like '../%' then 'escapes its folder'
    when coalesce(is_link, false) then 'link' when l.sha is null then 'not in the manifest' when a.sha is null then 'missing file'
    when l.size <> a.size then 'size differs' when l.sha <> a.sha then 'hash differs' end as message
  from listed l full join actual a using (path))
select 'major' as severity, location, message from faults where message is not null
union all select 'major', lower(path), 'paths collide by case' from listed group by lower(path) having count(distinct path) > 1""")
def _(t):
    doc = t.documents
    path = F.concat_ws("/", "source", "doc_id").alias("path")
    flat = F.replace("text", F.lit("\n"), F.lit(" "))

    def fixed(df, p, size):
        return df.select(p.alias("path"), F.col(size).cast("int").alias("size"), F.lit("x").alias("sha256"))

    regions = fixed(t.region, F.concat(F.lit("region/"), "r_name"), "r_regionkey").unionByName(fixed(t.region, F.concat(F.lit("region/"), F.lower("r_name")), "r_regionkey"))
    listed = (
        doc.select(path, F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
        .unionByName(fixed(t.nation, F.concat(F.lit("../"), "n_name"), "n_nationkey"))
        .unionByName(fixed(t.supplier, F.concat(F.lit("/"), "s_name"), "s_suppkey"))
        .unionByName(regions)
    )
    size = F.length("text") + F.when(F.col("lang") == "es", 1).otherwise(0)
    actual = (
        doc.filter("lang <> 'de'")
        .select(path, size.alias("size"), F.sha2(flat, 256).alias("sha256"), ((F.col("lang") == "en") & F.col("text").contains("|")).alias("is_link"))
        .unionByName(t.benchmark.select(F.concat(F.lit("bench/"), "item_id").alias("path"), F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"), F.lit(False).alias("is_link")))
        .unionByName(regions.withColumn("is_link", F.lit(False)))
    )
    return findings.diff_manifest(listed, actual)


@query("verify_seal", "A42", """
with seal as (select source as run, lang || '.txt' as path, min(sha256(text)) as sha from documents where lang <> 'es' group by all),
now as (select source as run, lang || '.txt' as path, case when lang = 'de' then max(sha256(text)) else min(sha256(text)) end as sha
        from documents where lang <> 'fr' or source < 'src5' group by source, lang)
select 'major' as severity, run, path as location,
  case when s.sha is null then 'file is not in the seal' when n.sha is null then 'sealed file is gone' else 'changed after the seal' end as message
from seal s full join now n using (run, path) where s.sha is distinct from n.sha
union all select 'major', run, 'seal', 'seal lacks it.txt' from seal group by run having max((path = 'it.txt')::int) = 0
union all select 'major', run, 'seal', 'seal lacks en.txt' from seal group by run having max((path = 'en.txt')::int) = 0""")
def _(t):
    docs = t.documents.withColumn("sha", F.sha2("text", 256))
    cols = [F.col("source").alias("run"), F.concat("lang", F.lit(".txt")).alias("path")]
    seal = docs.filter("lang <> 'es'").groupBy(*cols).agg(F.min("sha").alias("sha256"))
    now = docs.filter("lang <> 'fr' or source < 'src5'").groupBy(*cols).agg(F.min("sha").alias("lo"), F.max("sha").alias("hi"))
    now = now.select("run", "path", F.when(F.col("path") == "de.txt", F.col("hi")).otherwise(F.col("lo")).alias("sha256"))
    return findings.verify_seal(now, seal, ["it.txt", "en.txt"])


@query("diff_snapshots", "A43", """
with new as (
  select o_orderkey, o_custkey, case when o_orderpriority = '1-URGENT' then o_custkey + 1 else o_custkey end as cust, o_orderdate
  from orders where o_orderstatus <> 'P'
  union all select -l_orderkey - 1, l_partkey, l_partkey, min(l_shipdate) from lineitem where l_linenumber = 7 group by 1, 2, 3)
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey,
  case when o.o_orderkey is null then 'added' when n.o_orderkey is null then 'removed' else 'changed' end as change
from orders o full join (select o_orderkey, min(cust) as cust, min(o_orderdate) as o_orderdate from new group by 1) n using (o_orderkey)
where o.o_orderkey is null or n.o_orderkey is null or o.o_custkey <> n.cust""")
def _(t):
    old = t.orders.select("o_orderkey", F.col("o_custkey").alias("cust"), "o_orderdate", "o_orderstatus")
    kept = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("cust"), "o_orderdate", F.lit("F").alias("o_orderstatus"))
    added = t.lineitem.filter("l_linenumber = 7").groupBy((-F.col("l_orderkey") - 1).alias("o_orderkey")).agg(F.min("l_partkey").alias("cust"), F.min("l_shipdate").alias("o_orderdate"), F.lit("F").alias("o_orderstatus"))
    return findings.diff_snapshots(old, kept.unionByName(added), "o_orderkey", ["cust", "o_orderdate"])


EVIDENCE_SQL = """
evidence as (
  select distinct l_orderkey as claim, l_linenumber as item,
    case l_returnflag when 'A' then 'r' || l_suppkey end as registry,
    case l_returnflag when 'A' then case l_linestatus when 'O' then 'mean' else 'median' end end as statistic,
    case l_returnflag when 'N' then '/papers/sources/' || l_partkey || '.md'
      when 'R' then case l_linestatus when 'O' then '/papers/' || l_partkey || '.md' else '/papers/sources/../' || l_partkey || '.md' end end as source
  from lineitem),
judged as (
  select claim, item, case
    when registry is not null and not exists (select 1 from supplier where 'r' || s_suppkey = registry and s_acctbal > 0 and statistic = 'mean')
      then 'no registry statistic ' || registry || '/' || coalesce(statistic, '?')
    when source is not null and (not starts_with(source, '/papers/sources/') or source like '%/../%') then 'outside the sources: ' || source
    when source is not null and not exists (select 1 from part where '/papers/sources/' || p_partkey || '.md' = source and p_size <= 40) then 'no such source: ' || source
    end as message from evidence)"""


def _evidence(t: Tables) -> DataFrame:
    li = t.lineitem
    flag = F.col("l_returnflag")
    is_open = F.col("l_linestatus") == "O"
    # A kind of evidence and the number it names: equal rows are dropped while they are short, and after they are spread, so
    # that no scan task holds all of its split.
    entry = flag == "A"
    named = F.when(entry, F.col("l_suppkey")).when(flag.isin("N", "R"), F.col("l_partkey"))
    kind = F.when(entry & is_open, 1).when(entry, 2).when(named.isNull(), F.lit(None)).when(flag == "N", 3).when(is_open, 4).otherwise(5)
    short = li.select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("item"), kind.alias("kind"), named.alias("named"))
    kind, path = F.col("kind"), F.concat("named", F.lit(".md"))
    evidence = short.repartition(span_count(short, None), "claim").distinct().select(
        "claim",
        "item",
        F.when(kind <= 2, F.concat(F.lit("r"), "named")).alias("registry"),
        F.when(kind == 1, "mean").when(kind == 2, "median").alias("statistic"),
        F.when(kind == 3, F.concat(F.lit("/papers/sources/"), path)).when(kind == 4, F.concat(F.lit("/papers/"), path)).when(kind == 5, F.concat(F.lit("/papers/sources/../"), path)).alias("source"),
    )
    reg = t.supplier.filter("s_acctbal > 0").select(F.concat(F.lit("r"), "s_suppkey").alias("id"), F.lit("mean").alias("statistic"))
    sources = t.part.filter("p_size <= 40").select(F.concat(F.lit("/papers/sources/"), "p_partkey", F.lit(".md")).alias("path"))
    return findings.resolve_evidence(evidence, reg, sources, "/papers/sources/")


@query("resolve_evidence", "A39", f"with {EVIDENCE_SQL} select claim, item::bigint as item, message from judged where message is not null")
def _(t):
    return _evidence(t).filter("message is not null")


@query("supported_claims", "A39", f"with {EVIDENCE_SQL} select claim, count(*) as items from judged group by claim having count(message) = 0")
def _(t):
    return _evidence(t).groupBy("claim").agg(F.count(F.lit(1)).alias("items"), F.count("message").alias("bad")).filter("bad = 0").drop("bad")


@query("resolve_macros", "A40", """
with uses as (select distinct l_orderkey || ':' || l_linenumber as location, 'r' || l_suppkey as id,
    case l_returnflag when 'A' then 'mean' when 'N' then 'std' else 'median' end as statistic from lineitem)
select case when s_suppkey is null or statistic = 'median' then 'major' else 'warning' end as severity, location,
  case when s_suppkey is null then 'unknown registry entry ' || id when statistic = 'median' then 'unknown statistic median'
    else 'exploratory result ' || id end as message
from uses left join (select * from supplier where s_acctbal > 0) s on id = 'r' || s_suppkey
where s_suppkey is null or statistic = 'median' or s_nationkey >= 10""")
def _(t):
    statistic = F.when(F.col("l_returnflag") == "A", "mean").when(F.col("l_returnflag") == "N", "std").otherwise("median")
    uses = t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("location"), F.concat(F.lit("r"), "l_suppkey").alias("id"), statistic.alias("statistic")).distinct()
    reg = t.supplier.filter("s_acctbal > 0").select(F.concat(F.lit("r"), "s_suppkey").alias("id"), F.when(F.col("s_nationkey") >= 10, "exploratory").otherwise("confirmatory").alias("class"))
    return findings.resolve_macros(uses, reg, ["n", "mean", "std", "min", "max"])


@query("resolve_citations", "A38", """
with cites as (select distinct l_orderkey || ':' || l_linenumber as location, l_orderkey as key from lineitem),
bib as (select o_orderkey as key, case when o_orderpriority = '5-LOW' then null else o_custkey end as paper,
  case when o_orderpriority = '1-URGENT' then 2 end as version from orders where o_orderstatus <> 'P'),
saved as (select c_custkey as paper, case when c_acctbal > 5000 then 2 else 1 end as saved_version,
  case when c_mktsegment = 'BUILDING' then 'pdf' else 'html' end as route from customer where c_nationkey < 20),
judged as (select key, location, case
    when b.key is null then 'key is not in the bibliography'
    when b.paper is null and not exists (select 1 from labels where doc_id = c.key and quality = 1) then 'not verified in the literature'
    when b.paper is not null and saved_version is null then 'paper is not saved'
    when version <> saved_version then 'cites v' || version || ', saved is v' || saved_version
    when route = 'pdf' then 'saved through the pdf route' end as message
  from cites c left join bib b using (key) left join saved using (paper))
select key, location, message, case when message = 'saved through the pdf route' then 'warning' else 'major' end as severity
from judged where message is not null""")
def _(t):
    cites = t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("location"), F.col("l_orderkey").alias("key")).distinct()
    bib = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("paper"), F.when(F.col("o_orderpriority") == "1-URGENT", 2).alias("version"))
    saved = t.customer.filter("c_nationkey < 20").select(F.col("c_custkey").alias("paper"), F.when(F.col("c_acctbal") > 5000, 2).otherwise(1).alias("saved_version"), F.when(F.col("c_mktsegment") == "BUILDING", "pdf").otherwise("html").alias("route"))
    literature = t.labels.filter("quality = 1").select(F.col("doc_id").alias("key"))
    return findings.resolve_citations(cites, bib, saved, literature)


@query("figures_check", "A47", """
with refs as (select source || ':' || doc_id as location, lang || '/' || doc_id as path from documents),
m as (select lang || '/' || doc_id as path, sha256(text) as sha from documents join labels using (doc_id)),
f as (select lang || '/' || doc_id as path, case when toxic = 1 then sha256(text || '!') else sha256(text) end as sha from documents join labels using (doc_id) where quality = 1)
select 'major' as severity, location, path, case when m.sha is null then 'figure is not in the manifest' when f.sha is null then 'figure file is missing'
  else 'figure changed after its script ran' end as message
from refs left join m using (path) left join f using (path) where m.sha is null or f.sha is null or m.sha <> f.sha""")
def _(t):
    docs = t.documents.join(t.labels, "doc_id")
    path = F.concat_ws("/", "lang", "doc_id").alias("path")
    refs = t.documents.select(F.concat_ws(":", "source", "doc_id").alias("location"), path)
    manifest = docs.select(path, F.sha2("text", 256).alias("sha256"))
    files = docs.filter("quality = 1").select(path, F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return findings.figures_check(refs, manifest, files)


DISPOSITION_SQL = """
last as (select l_orderkey as finding, arg_max(row(disposition, ref), row(l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as l
  from (select *, case l_returnflag when 'A' then 'accept' when 'N' then 'reject' else 'test' end as disposition,
          case l_returnflag when 'A' then l_partkey else l_suppkey end as ref from lineitem) group by 1),
states as (select o_custkey as review, o_orderkey as finding, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'major' else 'minor' end as severity,
    l[1] as disposition,
    case when l is null then 'open'
      when l[1] = 'accept' and l[2] in (select p_partkey from part where p_size > 10) then 'closed'
      when l[1] = 'reject' and l[2] in (select s_suppkey from supplier where s_acctbal > 0) then 'closed'
      when l[1] = 'test' and exists (select 1 from lineitem x where x.l_suppkey = l[2] and x.l_orderkey + x.l_linenumber % 2 = o_orderkey) then 'closed'
      else 'unresolved' end as state
  from orders left join last on finding = o_orderkey)"""


def _states(t: Tables) -> DataFrame:
    f = t.orders.select(F.col("o_custkey").alias("review"), F.col("o_orderkey").alias("finding"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "major").otherwise("minor").alias("severity"))
    flag = F.col("l_returnflag")
    log = t.lineitem.select(
        F.col("l_orderkey").alias("finding"),
        F.when(flag == "A", "accept").when(flag == "N", "reject").otherwise("test").alias("disposition"),
        F.when(flag == "A", F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("ref"),
        F.col("l_shipdate").alias("at"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    good = (
        t.part.filter("p_size > 10").select(F.lit("accept").alias("disposition"), F.col("p_partkey").alias("ref"), F.lit(None).cast("long").alias("finding"))
        .unionByName(t.supplier.filter("s_acctbal > 0").select(F.lit("reject").alias("disposition"), F.col("s_suppkey").alias("ref"), F.lit(None).cast("long").alias("finding")))
        .unionByName(t.lineitem.select(F.lit("test").alias("disposition"), F.col("l_suppkey").alias("ref"), (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("finding")))
    )
    return records.disposition_state(f, log, good)


@query("disposition_state", "L01", f"with {DISPOSITION_SQL} select * from states")
def _(t):
    return _states(t)


@query("closes_after", "L02", """
with e as (select event_id, user_id, ts from events where event_type = 'error'),
p as (select event_id, user_id, ts, value >= 20 and event_id % 7 <> 0 and event_id % 5 <> 0 as closes from events where event_type = 'purchase')
select e.user_id, e.event_id as review, arg_min(p.event_id, row(p.ts, p.event_id)) as run, arg_min(p.event_id, row(p.ts, p.event_id)) filter (p.closes) as closed_by
from e left join p on p.user_id = e.user_id and p.ts > e.ts group by 1, 2""")
def _(t):
    ev = t.events
    ev = ev.select("user_id", F.col("event_id").alias("id"), "event_type", "value", as_number(ev, "ts").cast("long").alias("at"))
    status = F.when(F.col("value") >= 20, "completed").otherwise("failed")
    runs = ev.filter("event_type = 'purchase'").withColumns({"status": status, "sealed": F.col("id") % 7 != 0, "class": F.when(F.col("id") % 5 == 0, "sweep").otherwise("test")})
    return records.closes_after(ev.filter("event_type = 'error'"), runs, "user_id", closes=records.closing())


@query("review_gate", "L03", """
with now as (select doc_id, sha256(replace(text, chr(10), ' ')) as h from documents where lang <> 'de')
select d.doc_id, case when now.h is null then 'bound content is gone' when now.h <> sha256(d.text) then 'content changed since the review'
  when l.toxic = 1 then 'open major findings' else 'ok' end as reason,
  (now.h is not null and now.h = sha256(d.text) and coalesce(l.toxic, 0) = 0)::int::bigint as open
from documents d left join now using (doc_id) left join labels l using (doc_id)""")
def _(t):
    bindings = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    current = t.documents.filter("lang <> 'de'").select("doc_id", F.sha2(F.replace("text", F.lit("\n"), F.lit(" ")), 256).alias("sha256"))
    return records.gate(bindings, current, "doc_id", t.labels.filter("toxic = 1"))


@query("supersede_chain", "L04", """
with o as (select o_orderkey as id, lag(o_orderkey) over w as supersedes, first_value(o_orderkey) over w as root,
             row_number() over w - 1 as depth from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select id, root, depth::bigint as depth, 'ok' as status from o""")
def _(t):
    linked = shifted(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"], {"supersedes": "o_orderkey"})
    return records.supersede_chain(linked.select(F.col("o_orderkey").alias("id"), "supersedes"))


DECISIONS_SQL = """d as (select o_orderkey as id, o_orderpriority in ('1-URGENT', '2-HIGH') as asked, 'F' as recommendation,
  case when o_orderstatus <> 'P' then o_orderstatus end as chosen, case when o_orderstatus <> 'P' then c_mktsegment end as decided_by,
  o_orderpriority as dissent from orders join customer on c_custkey = o_custkey)"""


def _decisions(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") != "P"
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("asked"),
        F.lit("F").alias("recommendation"),
        F.when(done, F.col("o_orderstatus")).alias("chosen"),
        F.when(done, F.col("c_mktsegment")).alias("decided_by"),
        F.col("o_orderpriority").alias("dissent"),
    )


@query("decision_summary", "L08", f"""
with {DECISIONS_SQL}
select decided_by, grouping(decided_by)::bigint as overall, count(chosen) as n, count(*) filter (chosen = recommendation) as recommended_chosen,
  count(*) filter (chosen is null) as n_open, round(avg(asked::int), 6) as asked_ratio from d group by rollup(decided_by)""")
def _(t):
    return records.decision_summary(_decisions(t))


@query("open_decisions", "L08", f"with {DECISIONS_SQL} select id from d where chosen is null")
def _(t):
    return records.open_decisions(_decisions(t))


@query("dissent_list", "L08", f"with {DECISIONS_SQL} select id, decided_by, dissent from d where chosen <> recommendation")
def _(t):
    return records.dissent_list(_decisions(t))


@query("claims_by_status", "L09", """
select s as claim_status, (select count(*) from orders where o_orderstatus = s) as n, o_orderkey as id
from (values ('F'), ('O'), ('P'), ('dropped')) v(s) left join orders on o_orderstatus = s""")
def _(t):
    return records.by_status(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("claim_status")), ["F", "O", "P", "dropped"])


@query("project_status", "L10", f"""
with {DISPOSITION_SQL}
select 'open:' || s as item, (select count(*) from states where severity = s and state <> 'closed') as n from (values ('major'), ('minor')) v(s)
union all select 'disposition:' || k, (select count(*) from states where disposition = k) from (values ('accept'), ('reject'), ('test'), ('human')) v(k)
union all select 'runs sealed', (select count(*) from orders where o_orderpriority <> '5-LOW')
union all select 'registry entries', (select count(*) from supplier)
union all select 'open majors of ' || review, count(*) filter (severity = 'major' and state <> 'closed') from states group by review
union all select 'phase:' || p, (p = case when (select count(*) from orders where o_orderpriority <> '5-LOW') = 0 then 'design' when (select count(*) from states where severity = 'major' and state <> 'closed') > 0 then 'review' else 'build' end)::int::bigint from (values ('design'), ('review'), ('build')) v(p)
union all select 'gates open', (select count(*) from labels where toxic = 0)""")
def _(t):
    states = _states(t)
    runs = t.orders.select((F.col("o_orderpriority") != "5-LOW").alias("sealed"))
    gates = t.labels.select((F.col("toxic") == 0).alias("open"))
    return records.project_status(states, states, runs, t.supplier, ["accept", "reject", "test", "human"], gates)


@query("recall_report", "L12", """
with m as (select lang, source, toxic, quality, n_chars from documents join labels using (doc_id)),
g as (select lang, source, avg(toxic) as recall, count(*) filter (quality = 0) as n_major, count(*) filter (toxic = 0) as unmatched,
  sum(n_chars)::bigint as cost, sum(n_chars * 2)::bigint as seconds from m group by all)
select lang, source, round(recall, 6) as recall, n_major, unmatched, cost, seconds, (recall is null)::int::bigint as failed
from (select distinct lang, source from documents) left join g using (lang, source)""")
def _(t):
    m = t.documents.join(t.labels, "doc_id").select("lang", "source", F.col("toxic").alias("detected"), (F.col("quality") == 0).alias("major"), F.col("n_chars").alias("cost"), (F.col("n_chars") * 2).alias("seconds"))
    return records.recall_report(t.documents, m, ["lang", "source"])


@query("allocate_ids", "L13", """
select o_orderkey, (select max(o_orderkey) from orders) + row_number() over (order by o_orderdate, o_orderkey) as new_id
from orders where o_orderstatus = 'P'""")
def _(t):
    new = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    return records.allocate_ids(new, t.orders.select(F.col("o_orderkey").alias("id")), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("latest_binding", "L14", """
select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def _(t):
    return records.latest_binding(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("seeded_sample", "L15", "select o_orderkey, o_custkey from orders where o_orderstatus <> 'P' order by sha256('viva:' || o_orderkey) limit 25")
def _(t):
    return records.seeded_sample(t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey"), "o_orderkey", 25, "viva")


@query("carry_forward", "A46", "select d.doc_id, case when l.quality = 1 then l.toxic + 10 else p.toxic end::bigint as toxic from documents d left join labels l on l.doc_id = d.doc_id and quality = 1 left join labels p on p.doc_id = d.doc_id")
def _(t):
    fresh = t.labels.filter("quality = 1").select("doc_id", (F.col("toxic") + 10).alias("toxic"))
    new = t.documents.select("doc_id").join(fresh, "doc_id", "left")
    return records.carry_forward(t.labels, new, "doc_id", "toxic")


@query("upsert_decision", "A48", """
with inc as (select doc_id, 1 + (lang = 'fr')::int as version, left(sha256(replace(text, chr(10), ' ')), 16) as f, source = 'src3' as forced, source = 'src4' as pinned from documents)
select i.doc_id, i.version::bigint as version, case when l.doc_id is null or forced then 'saved'
  when i.version = 1 + l.toxic and i.f = left(sha256(d.text), 16) then 'up-to-date'
  when i.version > 1 + l.toxic and not pinned then 'new-version-available' else 'saved' end as status
from inc i join documents d using (doc_id) left join labels l using (doc_id)""")
def _(t):
    saved = t.documents.join(t.labels, "doc_id").select("doc_id", (1 + F.col("toxic")).alias("version"), digests.fingerprint("text").alias("fingerprint"))
    incoming = t.documents.select("doc_id", F.when(F.col("lang") == "fr", 2).otherwise(1).alias("version"), digests.fingerprint(F.replace("text", F.lit("\n"), F.lit(" "))).alias("fingerprint"), (F.col("source") == "src3").alias("forced"), (F.col("source") == "src4").alias("pinned"))
    return records.upsert_decision(saved, incoming, "doc_id").select("doc_id", "version", "status")


FILES_SQL = """files as (
  select distinct case when c_acctbal > 5000 then c_mktsegment || '/' || c_name || '.pdf' when c_acctbal < 0 then c_mktsegment || '/' || c_name || '.svg'
    else 'n' || c_nationkey || '/' || c_name || '.pdf' end as path from customer where c_nationkey < 22
  union select 'alt/' || c_name || '.png' from customer where c_nationkey < 5)"""


@query("match_original", "A44", f"""
with {FILES_SQL}, figs as (select c_custkey as id, c_mktsegment || '/' || c_name || '.svg' as path from customer),
f as (select path, regexp_replace(path, '\\.[^./]*$', '') as stem, regexp_extract(regexp_replace(path, '\\.[^./]*$', ''), '([^/]*)$', 1) as base from files)
select id, coalesce((select path from files where files.path = figs.path),
  (select min(f.path) from f where f.stem = regexp_replace(figs.path, '\\.[^./]*$', '')),
  (select case when count(*) = 1 then min(f.path) end from f where f.base = regexp_extract(regexp_replace(figs.path, '\\.[^./]*$', ''), '([^/]*)$', 1))) as original
from figs""")
def _(t):
    c = t.customer
    figures = c.select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit("/"), "c_name", F.lit(".svg")).alias("path"))
    path = (
        F.when(F.col("c_acctbal") > 5000, F.concat("c_mktsegment", F.lit("/"), "c_name", F.lit(".pdf")))
        .when(F.col("c_acctbal") < 0, F.concat("c_mktsegment", F.lit("/"), "c_name", F.lit(".svg")))
        .otherwise(F.concat(F.lit("n"), "c_nationkey", F.lit("/"), "c_name", F.lit(".pdf")))
    )
    files = c.filter("c_nationkey < 22").select(path.alias("path")).union(c.filter("c_nationkey < 5").select(F.concat(F.lit("alt/"), "c_name", F.lit(".png"))))
    return records.match_original(figures, files)


CANDS_SQL = """c as (
  select page_id as id, 'remote' as status, url as path, url like 'https%' as is_image from pages
  union all select page_id, 'svg-fallback', url || '.svg', true from pages where url like '%utm_source%'
  union all select page_id, 'rendered', 'images/' || page_id || '.png', true from pages where url like '%#top')"""


def _chosen(t: Tables) -> DataFrame:
    p = t.pages.select(F.col("page_id").alias("id"), "url")
    cands = (
        p.select("id", F.lit("remote").alias("status"), F.col("url").alias("path"), F.col("url").startswith("https").alias("is_image"))
        .unionByName(p.filter(F.col("url").contains("utm_source")).select("id", F.lit("svg-fallback").alias("status"), F.concat("url", F.lit(".svg")).alias("path"), F.lit(True).alias("is_image")))
        .unionByName(p.filter(F.col("url").endswith("#top")).select("id", F.lit("rendered").alias("status"), F.concat(F.lit("images/"), "id", F.lit(".png")).alias("path"), F.lit(True).alias("is_image")))
    )
    return records.choose_asset(p.select("id", F.concat(F.lit("images/"), "id", F.lit(".png")).alias("local")), cands)


CHOSEN_SQL = f"""{CANDS_SQL}, best as (select id, arg_min(row(status, path), case status when 'rendered' then 1 when 'remote' then 2 else 3 end) filter (is_image) as b,
  count(*) filter (not is_image) as rejected from c group by id),
chosen as (select page_id as id, 'images/' || page_id || '.png' as local, coalesce(b[1], 'missing') as status, b[2] as path,
  case when b is null and rejected > 0 then 'not an image' end as note from pages left join best on id = page_id)"""


@query("choose_asset", "A45", f"with {CHOSEN_SQL} select * from chosen")
def _(t):
    return _chosen(t)


@query("asset_path_mapping", "A45", f"with {CHOSEN_SQL} select local as old, path as new from chosen where path <> local")
def _(t):
    return records.path_mapping(_chosen(t))


# Seeded defects: fixed rule values.
DEFECTS = [
    {"id": "insult", "location_patterns": ["en/"], "keywords": ["idiot", "clown", "loser"]},
    {"id": "secret", "location_patterns": ["src1", "src2"], "keywords": ["key", "token", "password"]},
    {"id": "licence", "location_patterns": ["fr/", "de/"], "keywords": ["license", "copyright"]},
    {"id": "table", "location_patterns": ["src"], "keywords": [" | "]},
    {"id": "french", "location_patterns": ["es/"], "keywords": ["le "]},
]


@query("match_defects", "A49")
def _(t):
    f = t.documents.select(F.col("source").alias("review"), F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.concat_ws("/", "lang", "source").alias("location"), "text")
    return records.match_defects(f, DEFECTS, "review", "seq")


@query("format_stat", "A31", "select l_orderkey, l_linenumber::bigint as l_linenumber, l_suppkey, cast(cast(round(cast(l_extendedprice as decimal(18,4)), 1) as decimal(18,1)) as varchar) as shown from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", registry.format_stat(F.col("l_extendedprice"), 1).alias("shown"))
