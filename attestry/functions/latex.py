"""Column functions over LaTeX source and flat bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.refs import PAPER_ID
from attestry.functions.text import evaluated

# What may hold digits without stating a result: comments, result macros, references, layout arguments.
MASKS = [
    r"(?:^|[^\\])%.*$",
    r"\\result\{[^{}]*\}\{[^{}]*\}\{[^{}]*\}",
    r"\\nonresult\{[^{}]*\}\{(?:[^{}]|\{[^{}]*\})*\}",
    r"\\includegraphics(?:\[[^\]]*\])?\{[^{}]*\}",
    r"\\(?:ref|eqref|autoref|cref|label|input|bibliography|vspace|hspace|[A-Za-z]*cite[A-Za-z]*)\*?\s*(?:\[[^\]]*\])*\{[^{}]*\}",
    r"\\begin\{[^{}]*\}(?:\{[^{}]*\})?",
    r"\\cmidrule(?:\([^)]*\))?\{[^{}]*\}",
    r"\\multicolumn\{[^{}]*\}\{[^{}]*\}",
    r"\\multirow\{[^{}]*\}\{[^{}]*\}",
    r"\\(?:parbox|textcolor)\{[^{}]*\}",
    r"[0-9]+(?:st|nd|rd|th)\b",
    r"[A-Za-z][A-Za-z0-9]*[-_]?[A-Za-z]*[0-9]+[A-Za-z0-9]*",
]
BARE = r"([0-9]+(?:\.[0-9]+)?(?:[A-Za-z]+|%)?)"


def masked_line(line: Column) -> Column:
    for mask in MASKS:
        line = F.regexp_replace(line, mask, " ")
    return line


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line with its number from 1."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("_at", "line_text")).select(*keep, (F.col("_at") + 1).alias("line"), "line_text")


def bare_numbers(df: DataFrame, text: str, file: str) -> DataFrame:
    """Numbers written directly into rendered text: ``(file, line, number)``."""
    found = F.regexp_extract_all(masked_line(F.col("line_text")), F.lit(BARE), F.lit(1))
    return lines(df, text, file).select(file, "line", F.explode(found).alias("number"))


def material_gaps(df: DataFrame, text: str, file: str) -> DataFrame:
    return lines(df, text, file).filter(F.col("line_text").contains("[MATERIAL GAP]")).select(file, "line")


CITE_COMMAND = r"\\([A-Za-z]*cite[A-Za-z]*\*?)"
CITE_GROUPS = r"^[A-Za-z]*cite[A-Za-z]*\*?\s*((?:\[[^\]]*\]\s*)*(?:\{[^{}]*\}\s*)+)"
CITE_GROUP = r"\{([^{}]*)\}"
MARK = "\x01"


def cite_keys(df: DataFrame, text: str, file: str) -> DataFrame:
    """Every cited key with the line its command starts on: lists, several groups, stars and line breaks included."""
    pieces = F.split(F.regexp_replace(F.regexp_replace(text, r"(?m)(^|[^\\])%.*$", "$1"), CITE_COMMAND, MARK + "$1"), MARK)
    df = df.select(file, pieces.alias("_pieces"))
    pieces = F.col("_pieces")
    breaks = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    # Running line number in front of each piece, as one fold over the breaks.
    starts = F.aggregate(breaks, F.array(F.lit(1)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    zipped = F.filter(F.arrays_zip(pieces.alias("piece"), starts.alias("line")), lambda z: z["piece"].rlike("^[A-Za-z]*cite"))
    cited = df.select(file, F.explode(zipped).alias("z")).select(file, F.col("z.line").alias("line"), F.regexp_extract("z.piece", CITE_GROUPS, 1).alias("groups"))
    groups = cited.select(file, "line", F.explode(F.regexp_extract_all("groups", F.lit(CITE_GROUP), F.lit(1))).alias("g"))
    keys = groups.select(file, "line", F.explode(F.split("g", ",")).alias("key"))
    return evaluated(keys, [file, "line"], key=F.btrim("key", F.lit(" \t\n\x0b\f\r"))).filter("key <> ''")


ENTRY = r"@([A-Za-z]+)\s*[{(]\s*([^,\s{}()]+)\s*,"
FIELD = r"([A-Za-z]+)\s*=\s*(?:\{([^{}]*)\}|\"([^\"]*)\"|([0-9]+))"
ARXIV = rf"(?:arxiv\.org/(?:abs|pdf|html)/|arXiv:)?({PAPER_ID})(?:v([0-9]+))?"
# Fields that may name the paper, in order of trust.
ID_FIELDS = ["eprint", "journal", "url", "note"]


def reference_fields(df: DataFrame, text: str, file: str) -> DataFrame:
    """Flat bibliography entries as rows ``(file, key, type, field, value)``; nested braces are out of scope."""
    pieces = F.split(F.regexp_replace(text, ENTRY, MARK + "$1\x02$2\x03"), MARK)
    entry = df.select(file, F.explode(F.filter(pieces, lambda p: p.contains("\x03"))).alias("e"))
    entry = entry.select(
        file,
        F.lower(F.regexp_extract("e", "^([A-Za-z]+)\x02", 1)).alias("type"),
        F.regexp_extract("e", "\x02([^\x03]*)\x03", 1).alias("key"),
        F.explode(F.regexp_extract_all("e", F.lit(f"({FIELD})"), F.lit(1))).alias("f"),
    )
    value = F.concat(*[F.regexp_extract("f", FIELD, i) for i in (2, 3, 4)])
    return entry.select(file, "key", "type", F.lower(F.regexp_extract("f", FIELD, 1)).alias("field"), value.alias("value"))


def reference_papers(fields: DataFrame, file: str) -> DataFrame:
    """Paper id and version per entry from whichever identifying field holds one."""
    named = fields.filter(F.col("field").isin(*ID_FIELDS))
    trust = F.array_position(F.array(*[F.lit(f) for f in ID_FIELDS]), F.col("field"))
    hit = F.regexp_extract("value", ARXIV, 1)
    ranked = named.filter(hit != "").select(file, "key", F.struct(trust.alias("t"), hit.alias("paper"), F.regexp_extract("value", ARXIV, 2).alias("v")).alias("h"))
    best = ranked.groupBy(file, "key").agg(F.min("h").alias("h"))
    return best.select(file, "key", "h.paper", F.when(F.col("h.v") != "", F.col("h.v").cast("int")).alias("version"))
