"""Readers: documents with frontmatter, Atom feeds, results, ledgers, file listings, event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.refs import ref_id, ref_version
from attestry.functions.text import squash
from attestry.operators.ordering import running
from attestry.operators.registry import read_results_facts

HEAD = r"(?s)^---\n(.*?)\n---\n\n?(.*)$"


def parse_documents(df: DataFrame, content: str, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Frontmatter fields and body of whole-file texts; without frontmatter the fields are null and the body is everything.

    A field is ``name`` for a top-level key or ``outer.inner`` for a key one level down, in block or in flow style.
    """
    head = F.regexp_extract(content, HEAD, 1)
    has_head = F.col(content).rlike(r"(?s)^---\n.*?\n---\n")

    def value(field: str) -> Column:
        outer, _, inner = field.partition(".")
        if inner:
            block = F.regexp_extract("_head", rf"(?m)^{outer}:[ \t]*\{{[^}}\n]*\b{inner}:[ \t]*([^,}}\n]*)", 1)
            nested = F.regexp_extract("_head", rf"(?m)^{outer}:[ \t]*\n(?:[ \t]+[^\n]*\n)*?[ \t]+{inner}:[ \t]*([^\n]*)", 1)
            found = F.when(block != "", block).otherwise(nested)
        else:
            found = F.regexp_extract("_head", rf"(?m)^{outer}:[ \t]*([^\n]*)", 1)
        clean = F.regexp_replace(found, r"^['\"]|['\"]\s*$", "")
        return F.when(clean != "", clean).alias(field.replace(".", "_"))

    parsed = df.select(*keep, F.when(has_head, head).alias("_head"), F.when(has_head, F.regexp_extract(content, HEAD, 2)).otherwise(F.col(content)).alias("body"))
    return parsed.select(*keep, *[value(f) for f in fields], "body")


def read_documents(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return parse_documents(raw, "value", fields, ["path"])


ENTRY = """id string, title string, published string, updated string, summary string, comment string, doi string,
author array<struct<name:string>>, category array<struct<_term:string>>, primary_category struct<_term:string>"""


def atom_entries(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Entry records to one row each: id and version split, white space squashed, authors and categories as arrays in order."""
    return df.select(
        *keep,
        ref_id(F.col("id")).alias("id"),
        ref_version(F.col("id")).alias("version"),
        squash(F.col("title")).alias("title"),
        F.transform("author", lambda a: squash(a["name"])).alias("authors"),
        "published",
        "updated",
        F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.coalesce(F.col("primary_category._term"), F.get(F.col("category._term"), 0)).alias("primary_category"),
        squash(F.col("comment")).alias("comment"),
        "doi",
        squash(F.col("summary")).alias("summary"),
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").schema(ENTRY).option("rowTag", "entry").option("ignoreNamespace", True).load(path)
    return atom_entries(raw)


def entries_from_text(df: DataFrame, xml: str, keep: Sequence[str]) -> DataFrame:
    """The same entry records out of a text column that holds one entry each."""
    parsed = df.select(*keep, F.from_xml(F.col(xml), ENTRY, {"rowTag": "entry", "ignoreNamespace": "true"}).alias("e"))
    return atom_entries(parsed.select(*keep, "e.*"), keep)


RESULTS = """schema_version int, metric_def map<string,struct<description:string,unit:string,direction:string>>,
conditions map<string,struct<config_sha256:string>>, observations array<struct<condition:string,seed:int,metrics:map<string,string>>>"""


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results files (one JSON document each, in a folder named after the run) to fact rows."""
    raw = spark.read.schema(RESULTS).option("multiLine", True).json(path)
    named = raw.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return read_results_facts(named)


def facts_from_text(df: DataFrame, json: str, run: str) -> DataFrame:
    return read_results_facts(df.select(F.col(run).alias("run"), F.from_json(json, RESULTS).alias("r")).select("run", "r.*"))


# Record shapes of the ledger, one per kind.
LEDGER = {
    "claim": "kind string, by string, title string, description string, claim_status string, prereg string, evidence array<struct<registry:string,statistic:string,source:string,locator:string>>",
    "decision": "title string, asked boolean, options array<struct<label:string,fails_when:string,evidence:array<string>,evidence_gap:string>>, recommendation string, chosen string, decided_by string, dissent string, supersedes string",
    "review": "scope string, lane string, verdict string, findings array<struct<id:string,severity:string,location:string,observation:string>>",
    "run": "name string, status string, class string, started string, ended string, expected_seeds array<int>, prereg string, child_exit int",
}


def read_ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Ledger records of one kind, one JSON document per file; the id is the file name."""
    raw = spark.read.schema(LEDGER[kind]).option("multiLine", True).json(path)
    return raw.withColumn("id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def records_from_text(df: DataFrame, json: str, kind: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.from_json(json, LEDGER[kind]).alias("r")).select(*keep, "r.*")


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder with size and SHA-256; paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rel = F.regexp_replace("path", f"^.*?{path.rstrip('/').lstrip('/')}/", "")
    return raw.select(rel.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def hash_text(df: DataFrame, text: str, *keep: str) -> DataFrame:
    raw = F.encode(F.col(text), "UTF-8")
    return df.select(*keep, F.octet_length(text).alias("size"), F.sha2(raw, 256).alias("sha256"))


def event_log(events: DataFrame, order: Sequence[str], payload: str, limit: int, parts: int | None = None) -> DataFrame:
    """Append-only log rows with a gapless ``seq``; a payload over the limit becomes a preview and a pointer."""
    long = F.length(payload) > limit
    pointer = F.when(long, F.concat(F.lit("sha256:"), F.sha2(payload, 256)))
    numbered = running(events, [], order, number="seq", parts=parts)
    return numbered.withColumns({"pointer": pointer, payload: F.when(long, F.concat(F.left(payload, F.lit(limit)), F.lit("…"))).otherwise(F.col(payload))})


def payload_store(events: DataFrame, payload: str, limit: int, known: DataFrame | None = None) -> DataFrame:
    """``pointer, payload`` of every payload over the limit, each text once; those that ``known`` (an earlier store) holds are left out.

    The rows can be appended to the earlier store: its content gives each row its name.
    """
    long = events.filter(F.length(payload) > limit).select(F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("pointer"), F.col(payload).alias("payload"))
    fresh = long if known is None else long.join(known.select("pointer"), "pointer", "left_anti")
    return fresh.groupBy("pointer").agg(F.first("payload").alias("payload"))


def resolve(log: DataFrame, store: DataFrame, payload: str) -> DataFrame:
    """The log with whole payloads: a pointer gives what the store holds under it, null where it holds nothing."""
    held = store.select("pointer", F.col("payload").alias("_whole"))
    whole = F.when(F.col("pointer").isNotNull(), F.col("_whole")).otherwise(F.col(payload))
    return log.join(held, "pointer", "left").withColumn(payload, whole).select(*log.columns)
