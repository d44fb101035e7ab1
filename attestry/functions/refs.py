"""Column functions over references, keys, paths and raw bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAPER_ID = r"[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}"
REF = rf"^(?:(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/|arXiv:)?({PAPER_ID})(?:v([0-9]+))?(?:\.pdf)?(?:[?#].*)?$"


def ref_id(col: Column) -> Column:
    found = F.regexp_extract(F.trim(col), REF, 1)
    return F.when(found != "", found)


def ref_version(col: Column) -> Column:
    found = F.regexp_extract(F.trim(col), REF, 2)
    return F.when(found != "", found.try_cast("int"))


def canonical_ref(col: Column) -> Column:
    """Struct of kind (id, title or error), id, version and query."""
    text = F.trim(col)
    pid = ref_id(col)
    kind = F.when(text == "", "error").when(pid.isNotNull(), "id").otherwise("title")
    return F.struct(kind.alias("kind"), pid.alias("id"), ref_version(col).alias("version"), F.when(kind == "title", text).alias("query"))


def safe_key(col: Column) -> Column:
    return F.replace(col, F.lit("/"), F.lit("_"))


def pin_version(argument: Column, ref: Column, latest: Column) -> Column:
    """An explicit version wins, then the one in the reference, then the latest."""
    return F.coalesce(argument, ref_version(ref), latest)


def allowed_host(url: Column, hosts: list[str]) -> Column:
    """Only https and only these exact hosts."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts), F.lit(False))


SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"


def slug_ok(col: Column) -> Column:
    return col.rlike(SLUG)


def sniff_type(content: Column) -> Column:
    """File type by leading bytes, or null."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.substring(content, 1, 512).cast("string")
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("25504446"), "pdf")
        .when(text.rlike(r"^\s*(<\?xml[^>]*>\s*)?<svg[\s>]"), "svg")
    )
