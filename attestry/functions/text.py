"""Column functions over text. Patterns avoid lookaround so that other regex engines read them the same way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squash(col: Column) -> Column:
    """Every run of white space, newlines included, becomes one blank."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


# Superscript and subscript digits, the unicode minus, and what they stand for.
SCRIPT_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉−"
PLAIN_DIGITS = "01234567890123456789-"
# Function application, invisible times, invisible separator, invisible plus, zero-width space.
INVISIBLE = "[\u2061\u2062\u2063\u2064\u200b]"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[([^\]]*)\]\([^)]*\)"
SUBSCRIPT = r"_\(([^()]*)\)"
MARKUP = r"[\\*$^{}]"


def normalize(col: Column) -> Column:
    """Text equal up to serialisation noise: escapes, emphasis, scripts, images, link targets, blanks, minus signs."""
    col = F.regexp_replace(col, IMAGE, "")
    col = F.regexp_replace(col, LINK, "$1")
    col = F.regexp_replace(col, SUBSCRIPT, "$1")
    col = F.translate(col, SCRIPT_DIGITS, PLAIN_DIGITS)
    col = F.regexp_replace(col, INVISIBLE, "")
    col = F.regexp_replace(col, MARKUP, "")
    return squash(F.regexp_replace(col, "\u00a0", " "))


def sanitize_label(col: Column) -> Column:
    """One-line label: line breaks as a written-out backslash n, brackets as parentheses."""
    col = F.regexp_replace(col, r"^\s+|\s+$", "")
    return F.translate(F.regexp_replace(col, r"[\r\n]+", r"\\n"), "[]", "()")


REDACTED = "[REDACTED]"
SECRET_PAIR = r"(?i)((?:api[-_]?key|token|password|passwd|secret)[\"']?\s*[=:]\s*)[^\s,;]+"
SECRET_ARGUMENT = r"(?i)(--(?:api[-_]?key|token|password|secret)\s+)\S+"
URL_CREDENTIALS = r"(://)[^/\s:@]+:[^/\s@]+@"


def redact_secrets(col: Column) -> Column:
    """Replace the value of key=value secrets, of secret arguments and of credentials inside URLs."""
    col = F.regexp_replace(col, SECRET_PAIR, f"$1{REDACTED}")
    col = F.regexp_replace(col, SECRET_ARGUMENT, f"$1{REDACTED}")
    return F.regexp_replace(col, URL_CREDENTIALS, f"$1{REDACTED}@")


FRONTMATTER = r"^---\n(?:[^\n]*\n)*?---\n"
TABLE_ROW = r"(?m)^[ \t]*\|.*$"
REFERENCES = r"(?s)(^|\n)#+ References.*$"
NUMBER = r"(^|[^A-Za-z0-9_.])([0-9]+(?:[.,][0-9]+)*%?)"
# The same for Spark, without the sign in front: it looks for a digit first, which most signs are not, and then behind it. A
# percent sign that ends the number before is taken. What has been taken is never given back, so a long list of numbers
# needs no depth.
NUMBER_ONCE = r"(?=[0-9])(?<![A-Za-z0-9_.])(?!\G(?<=%))([0-9]+(?:[.,][0-9]+)*+%?)"
YEAR = r"^(19|20)[0-9][0-9]$"


def without_frontmatter(col: Column) -> Column:
    """The text after a metadata block at its start; without a closing line the text stays as it is."""
    end = F.locate("\n---\n", col, 4)
    return F.when(col.startswith("---\n") & (end > 0), col.substr(end + 5, F.length(col))).otherwise(col)


def extract_numbers(col: Column) -> Column:
    """Distinct numbers of the running text; years, table rows, metadata and the reference list do not count."""
    col = without_frontmatter(col)
    for region in (REFERENCES, TABLE_ROW):
        col = F.regexp_replace(col, region, "")
    found = F.regexp_extract_all(col, F.lit(NUMBER_ONCE), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike(YEAR)))


EQUATION = r"(\$\$[^$]+\$\$|\$[^$\n]+\$)"


def extract_equations(col: Column) -> Column:
    """Inline and display math spans with their dollar signs removed and blanks squashed."""
    return F.transform(F.regexp_extract_all(col, F.lit(EQUATION), F.lit(1)), lambda x: squash(F.regexp_replace(x, r"\$", "")))


FIRST_SENTENCE = r"(?s)^\s*(.*?[.!?])(\s.*)?$"


def short_description(col: Column, limit: int = 220) -> Column:
    """First sentence, cut so that the ellipsis still fits the limit."""
    first = F.regexp_extract(col, FIRST_SENTENCE, 1)
    text = squash(F.when(first == "", col).otherwise(first))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…"))).otherwise(text)


REFUSAL = r"(?i)\b(can't|cannot|can not|unable to) (help|assist)"


def first_json(col: Column) -> Column:
    """The JSON object that the first brace of a plain or fenced reply opens, of any depth, or null.

    One pass over the signs keeps the depth, and knows strings and escapes; it ends at the brace that closes the first.
    """
    rest = F.when(F.contains(col, F.lit("{")), col.substr(F.locate("{", col), F.length(col)))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("text"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        inside, at = s["text"], s["at"] + 1
        depth = s["depth"] + F.when(inside, 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        closed = (s["end"] == 0) & ~inside & (c == "}") & (depth == 0)
        quoted = F.when((c == '"') & ~s["escaped"], ~inside).otherwise(inside)
        return F.struct(at.alias("at"), depth.alias("depth"), quoted.alias("text"), (inside & (c == "\\") & ~s["escaped"]).alias("escaped"), F.when(closed, at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(rest, ""), start, step, lambda s: s["end"])
    return F.when(end > 0, F.substring(rest, F.lit(1), end))


def reply_status(col: Column, schema: str, required: str) -> Column:
    """ok / invalid / refused / failed for a reply that should hold one JSON object with a required field."""
    found = first_json(col)
    parsed = F.from_json(found, schema)
    return (
        F.when(col.isNull() | (F.trim(col) == ""), "failed")
        .when(found.isNull() & col.rlike(REFUSAL), "refused")
        .when(found.isNull(), "failed")
        .when(parsed[required].isNull(), "invalid")
        .otherwise("ok")
    )


# Fixed-precedence typing of a sentence; the word families are fixed values, most specific first.
ITEM_TYPES = [
    ("constraint", r"(?i)\b(must|never|always|do not|don't|required|forbidden|only if)\b"),
    ("procedural", r"(?i)\b(first|then|next|step|run|install|click|to do this)\b"),
    ("episodic", r"(?i)\b(yesterday|last week|ago|earlier|previously|on monday)\b"),
    ("preference", r"(?i)\b(prefer|like|favorite|rather|enjoy)\b"),
]


def item_type(col: Column, families: list[tuple[str, str]] = ITEM_TYPES, otherwise: str = "belief") -> Column:
    """The first family whose pattern occurs decides the type."""
    out = F.when(F.lit(False), "")
    for name, pattern in families:
        out = out.when(col.rlike(pattern), name)
    return out.otherwise(otherwise)


def tokens(col: Column) -> Column:
    """Lower-case words: maximal runs of characters that are not white space or punctuation."""
    return F.filter(F.split(F.lower(col), r"[\s.,;:!?|()\[\]{}\"'%*#$&<>/=-]+"), lambda w: w != "")


def bind(value: Column, use) -> Column:
    """Evaluate a value once and use it several times; inside a lambda an outer expression would run again per element."""
    return F.get(F.transform(F.array(value), use), 0)


def evaluated(df: DataFrame, keep: Sequence[str], **cols: Column) -> DataFrame:
    """``keep`` and new columns, evaluated once per row: a filter on them cannot be moved in front, where it would repeat them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def grams(words: Column, n: int) -> Column:
    """Runs of n neighbouring words joined by blanks; empty when the text is shorter."""

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")), F.array().cast("array<string>"))

    return bind(words, runs)
