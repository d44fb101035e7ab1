"""Blocks and tables out of HTML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.text import bind, evaluated, squash
from attestry.session import spread

HIDDEN = r"(?is)<(script|style|nav)\b.*?</(?:script|style|nav)>|<!--.*?-->|<!DOCTYPE[^>]*>"
FOOTNOTE = r"(?is)(<span class=\"ltx_note ltx_role_footnote[^>]*>.*?</span></span></span>)"
NOTE_MARK = r"(?is)<sup class=\"ltx_note_mark\">.*?</sup>|<span class=\"ltx_tag ltx_tag_note\">.*?</span>"
BLOCK_TAG = r"(?i)<(/?)(p|h[1-6]|li|td|th|figcaption|caption|title|pre|tr|table|thead|tbody|article|section|div|ul|ol|footer|header|body|head|html|figure|span class=\"[^\"]*ltx_td)\b([^>]*)>"
OPEN, NAMED, BODY = "\x01", "\x02", "\x03"
INLINE_TAG = r"<[^>]*>"
LINK = r"(?is)<a\b([^>]*)>(.*?)</a>"

# Entities that occur in running text; ampersand last so that nothing is unescaped twice.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def plain_text(col: Column) -> Column:
    col = F.regexp_replace(col, INLINE_TAG, "")
    for entity, char in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return squash(col)


def _kind(tag: Column, attrs: Column) -> Column:
    return (
        F.when(attrs.contains("ltx_bibitem"), "bibitem")
        .when(attrs.contains("ltx_listing"), "listing")
        .when(tag.isin("p"), "paragraph")
        .when(tag.rlike("^h[1-6]$"), "heading")
        .when(tag == "li", "item")
        .when(tag.isin("td", "th") | tag.startswith("span"), "cell")
        .when(tag.isin("figcaption", "caption"), "caption")
        .when(tag == "title", "title")
        .when(tag == "pre", "listing")
    )


def page_blocks(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """``(doc, ord, kind, tag, text)`` in document order; scripts, styles and navigation dropped, wrappers without own text too.

    A block runs from its tag to the next block tag, so an unclosed paragraph ends where the next one starts.
    """
    # What the page shows is a column of its own: three expressions below read it.
    pages = spread(pages.select(doc, html)).select(doc, F.regexp_replace(html, HIDDEN, " ").alias("_shown"))
    shown = F.col("_shown")
    notes = F.transform(F.regexp_extract_all(shown, F.lit(FOOTNOTE), F.lit(1)), lambda n: F.concat(F.lit(f"footnote{NAMED}{BODY}"), F.regexp_replace(n, NOTE_MARK, "")))
    links = F.transform(
        F.regexp_extract_all(shown, F.lit(f"({LINK})"), F.lit(1)), lambda a: F.concat(F.lit(f"a{NAMED}{BODY}"), a)
    )
    body = F.regexp_replace(shown, FOOTNOTE, "")
    pieces = F.split(F.regexp_replace(body, BLOCK_TAG, f"{OPEN}$1$2{NAMED}$3{BODY}"), OPEN)
    rows = pages.select(doc, F.posexplode(F.concat(pieces, notes, links)).alias("ord", "piece"))
    tag = F.lower(F.regexp_extract("piece", f"^([^{NAMED}]*){NAMED}", 1))
    attrs = F.regexp_extract("piece", f"(?s){NAMED}([^{BODY}]*){BODY}", 1)
    kind = F.when(F.col("tag") == "footnote", "footnote").when(F.col("tag") == "a", "link").otherwise(_kind(F.col("tag"), F.col("_attrs")))
    parted = evaluated(rows, [doc, "ord", "piece"], tag=tag, _attrs=attrs)
    kinds = evaluated(parted, [doc, "ord", "tag", "piece"], kind=kind).filter("kind is not null")
    text = plain_text(F.regexp_extract("piece", f"(?s){BODY}(.*)$", 1))
    return evaluated(kinds, [doc, "ord", "kind", "tag"], text=text).filter("text <> ''")


def construct_counts(blocks: DataFrame, doc: str, kinds: list[str]) -> DataFrame:
    """Count per kind and document; the kinds are listed, so no extra pass finds them."""
    return blocks.groupBy(doc).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def section_path(blocks: DataFrame, doc: str, levels: int = 6) -> DataFrame:
    """Carry the heading outline to every block. Bounded by one document, which came from one row."""
    order = Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("kind") == "heading", F.substring("tag", 2, 1).cast("int"))
    out = blocks.withColumn("_level", level)
    for n in range(1, levels + 1):
        opened = F.when(F.col("_level") == n, F.col("text")).when(F.col("_level") < n, F.lit(""))
        out = out.withColumn(f"_h{n}", F.last(opened, ignorenulls=True).over(order))
    heads = F.filter(F.array(*[F.col(f"_h{n}") for n in range(1, levels + 1)]), lambda h: h.isNotNull() & (h != ""))
    return out.select(*blocks.columns, F.array_join(heads, " / ").alias("section"))


def adjacent_text(blocks: DataFrame, doc: str, kind: str) -> DataFrame:
    """Blocks of a kind with the text right before and after as context. Bounded by one document."""
    order = Window.partitionBy(doc).orderBy("ord")
    near = blocks.withColumns({"before": F.lag("text").over(order), "after": F.lead("text").over(order)})
    return near.filter(F.col("kind") == kind).select(doc, "ord", "text", "before", "after")


TABLE = r"(?is)(<table\b.*?</table>)"
ROW = r"(?is)(<tr\b.*?</tr>)"
CELL = r"(?is)(<t[dh]\b[^>]*>.*?</t[dh]>)"
def page_tables(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """``(doc, table, row, col, text)`` with row and column spans filled."""

    def span(cell: Column, name: str) -> Column:
        digits = F.regexp_extract(cell, rf"(?i)^<t[dh]\b[^>]*{name}=\"?([0-9]+)", 1)
        return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(1))

    def cells(row: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(row, F.lit(CELL), F.lit(1)),
            lambda c: F.struct(plain_text(c).alias("text"), span(c, "rowspan").alias("down"), span(c, "colspan").alias("across")),
        )

    found = pages.select(doc, F.posexplode(F.regexp_extract_all(html, F.lit(TABLE), F.lit(1))).alias("table", "t"))
    slots = lambda r: F.flatten(F.transform(cells(r), lambda c: F.array_repeat(F.struct(c["text"].alias("text"), c["down"].alias("down")), c["across"])))
    rows = F.transform(F.regexp_extract_all("t", F.lit(ROW), F.lit(1)), slots)
    grid = found.select(doc, "table", F.explode(lay_out(rows)).alias("c"))
    return grid.select(doc, "table", F.explode(F.sequence(F.col("c.row"), F.col("c.row") + F.col("c.down") - 1)).alias("row"), "c.col", "c.text")


def lay_out(rows: Column) -> Column:
    """Places of all cells of one table as ``(row, col, text, down)``.

    One fold over the rows carries, per column, how many further rows a cell from above still covers; the cells of a row
    take the free columns from left to right.
    """
    start = F.struct(F.lit(0).alias("row"), F.array().cast("array<int>").alias("held"), F.array().cast("array<struct<row:int,col:int,text:string,down:int>>").alias("out"))

    def add(acc: Column, line: Column) -> Column:
        held = acc["held"]
        columns = F.sequence(F.lit(0), F.size(held) + F.size(line))
        free = F.filter(columns, lambda c: F.coalesce(F.get(held, c), F.lit(0)) == 0)

        def put(free: Column) -> Column:
            return F.transform(line, lambda s, i: F.struct(acc["row"].alias("row"), F.get(free, i).alias("col"), s["text"].alias("text"), s["down"].alias("down")))

        def after(placed: Column) -> Column:
            downs = F.map_from_arrays(F.transform(placed, lambda p: p["col"]), F.transform(placed, lambda p: p["down"]))
            left = bind(downs, lambda d: F.transform(columns, lambda c: F.greatest(F.coalesce(F.try_element_at(d, c), F.get(held, c), F.lit(0)) - 1, F.lit(0))))
            return F.struct((acc["row"] + 1).alias("row"), left.alias("held"), F.concat(acc["out"], placed).alias("out"))

        return bind(bind(free, put), after)

    return F.aggregate(rows, start, add, lambda acc: acc["out"])
