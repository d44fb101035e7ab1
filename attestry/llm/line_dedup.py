"""Line dedup by overlapping three-line windows: later occurrences of a window go, covered positions merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import SPACE, bound
from attestry.session import written

WIDTH = 3


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` freed of repeated passages, plus ``n_lines`` and ``n_removed``.

    Lines are what stands between ``\\n``. Lines without a word neither form windows nor part them. A window is three
    consecutive lines, compared exactly by two 64-bit hashes. Its first occurrence, by (key, hash of the text, position),
    stays; the lines under all later ones, in the same text too, are removed once however many windows cover them. Every
    line keeps at least one occurrence: its earliest is only under windows that nothing precedes. A text of which only
    wordless lines are left becomes empty. Columns named ``n_lines`` or ``n_removed`` are replaced.

    A null text stays null with 0 lines, an empty one has 1; texts with fewer than three lines with words stay; null keys
    come first; rows equal in key and text are one text and get the same result; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    named = {"key": F.col(f"`{key}`").alias("_key"), "digest": F.xxhash64(F.col(f"`{text}`")).alias("_digest")}
    lines = F.split(F.col(f"`{text}`"), "\n")
    told = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.length(F.trim(F.translate(s["x"], SPACE, " " * len(SPACE)))) > 0)
    said = docs.filter(F.col(f"`{text}`").contains("\n")).select(named["key"], named["digest"], told.alias("_told")).filter(F.size("_told") >= WIDTH)

    def window(at):
        a, b, c = (F.element_at(F.col("_told"), at + j) for j in range(WIDTH))
        return F.struct(
            F.xxhash64(a["x"], b["x"], c["x"]).alias("h1"), F.xxhash64(F.lit(1), a["x"], b["x"], c["x"]).alias("h2"),
            a["i"].alias("p"), (b["i"] - a["i"]).alias("q"), (c["i"] - a["i"]).alias("r"),
        )

    starts = F.sequence(F.lit(1), F.size("_told") - (WIDTH - 1))
    windows = written(said.select("_key", "_digest", F.explode(F.transform(starts, window)).alias("w")).select("_key", "_digest", "w.*").distinct(), "windows")
    place = F.struct("_key", "_digest", "p")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(written(firsts, "windows"), ["h1", "h2"]).filter(place > F.col("first"))
    covered = later.select("_key", "_digest", F.explode(F.array(F.col("p"), F.col("p") + F.col("q"), F.col("p") + F.col("r"))).alias("at"))
    gone = written(covered.groupBy("_key", "_digest").agg(F.collect_set("at").alias("_gone")), "covered")

    # The row travels as one value, so that no column of it can be mistaken for one made here.
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), named["key"].alias("_k"), named["digest"].alias("_d"))
    value = F.col("_row")[text]
    lines = F.split(value, "\n")
    # A merge join whatever the sizes: the same plan, and the same share of shuffle, at every scale.
    joined = left.join(gone.hint("merge"), F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_d") == F.col("_digest")), "left")
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone"))
    cut = bound(lines, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    told = lambda x: F.length(F.trim(F.translate(x, SPACE, " " * len(SPACE)))) > 0
    now = F.when(F.col("_gone").isNull(), value).otherwise(bound(cut, lambda x: F.when(told(x), x).otherwise(F.lit(""))))
    out = [now.alias(c) if c == text else F.col("_row")[c].alias(c) for c in names]
    return joined.select(*out, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
