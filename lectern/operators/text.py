"""Line, page and chapter operators over DataFrames of texts. Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Marks the start of a chapter; texts that hold it already are not expected.
MARK = "\x01"
# Fixed value: the two forms of an English chapter heading.
EN_HEADING = (
    r"(?mdU)^((?:CHAPTER\s+(?:[A-Z]+|\d+)(?:\s+[A-Z]+)*(?:\s*[\-–—:]\s*.*)?|Chapter\s+\d+\s*[\-–—:]\s*.*))\s*$"
)


def nonblank_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): stripped lines that are not blank, numbered from 1. Null texts have none."""
    return df.select(key, F.posexplode(X.lines(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def find_lines(df: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    """The non-blank lines that contain a literal."""
    return nonblank_lines(df, key, text).where(F.contains("line", F.lit(literal)))


def fix_chapter_numbers(df: DataFrame, page: list[str], order: str, line: str) -> DataFrame:
    """Within a page: a line of digits before a line that is 第章 but for spaces becomes one line 第N章."""
    w = Window.partitionBy(*page).orderBy(order)
    broken = lambda c: X.trim(F.regexp_replace(c, " ", "")) == "第章"
    number = X.trim(F.col(line))
    is_number = number.rlike(r"\A\p{Nd}+\z")
    out = df.withColumn("_next", F.lead(line).over(w)).withColumn("_prev", F.lag(line).over(w))
    first = is_number & F.coalesce(broken(F.col("_next")), F.lit(False))
    second = broken(F.col(line)) & F.coalesce(X.trim(F.col("_prev")).rlike(r"\A\p{Nd}+\z"), F.lit(False))
    out = out.where(~F.coalesce(second, F.lit(False)))
    return out.withColumn(line, F.when(first, F.concat(F.lit("第"), number, F.lit("章"))).otherwise(F.col(line))).drop("_next", "_prev")


def split_chapters_en(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chapter_no, text): slices from one heading to the next, numbered by occurrence; what stands before the first
    goes. A heading's white space crosses lines, so an upper-case subtitle or a following heading is part of it."""
    parts = F.split(F.regexp_replace(F.col(text), EN_HEADING, MARK + "$0"), MARK)
    out = df.select(key, F.posexplode(parts).alias("chapter_no", "text")).where("chapter_no > 0")
    return out.withColumn("text", X.join_initials(F.regexp_replace("text", r"\A\n+", "")))


def split_chapters_zh(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, text): chapters by the digits of their headings (as strings; of two with one number the later one
    stays) and, as part 'title', what stands before the first heading."""
    rows = df.select(key, F.posexplode(X.lines_with_ends(F.col(text))).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    number = X.heading_number(F.col("line"))
    rows = rows.withColumn("g", F.sum(number.isNotNull().cast("int")).over(w)).withColumn("number", number)
    parts = rows.groupBy(key, "g").agg(
        F.coalesce(F.max("number"), F.lit("title")).alias("part"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "").alias("text"),
    )
    last = Window.partitionBy(key, "part").orderBy(F.desc("g"))
    return parts.withColumn("r", F.row_number().over(last)).where("r = 1").select(key, "part", "text")


def reflow(lines: Column) -> Column:
    """The re-flowed text of an array of lines. Everything through the first heading block (heading and up to two lines
    of at most 30 characters) is kept; later heading blocks likewise; lines go on in the next until an end mark; blank
    lines become empty ones, but for one that cuts a later heading block short, which stays as it is. In time linear in
    the text: lines are classified (b blank, h and H short and long headings, s and t short and long others), heading
    blocks are found by an expression over the classes, and each line then depends on the one before only."""
    bare = lambda x: F.length(X.trim(x))
    kind = lambda x: (
        F.when(bare(x) == 0, "b").when(X.is_heading(x), F.when(bare(x) <= X.SUBTITLE_LENGTH, "h").otherwise("H")).when(bare(x) <= X.SUBTITLE_LENGTH, "s").otherwise("t")
    )
    classes = F.array_join(F.transform(lines, kind), "")
    head = F.regexp_extract(classes, r"^[^hH]*[hH][hs]{0,2}", 0)
    blocks = F.regexp_extract_all(F.regexp_replace(classes, r"^[^hH]*[hH][hs]{0,2}", ""), F.lit(r"[hH](?:[hs][hs]|[hs]?b|[hs]?)|[^hH]"), F.lit(0))
    # k: kept as it is; b: an empty line; s, t: running text
    body = F.array_join(F.transform(blocks, lambda x: F.when(x.rlike("^[hH]"), F.regexp_replace(x, ".", "k")).otherwise(x)), "")
    kinds = F.split(F.concat(F.regexp_replace(head, ".", "k"), body), "(?!^)")

    def put(v: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            text = lambda k: F.get(v["kinds"], k).isin("s", "t")
            goes_on = text(i) & F.coalesce(text(i - 1) & X.should_merge(F.get(v["lines"], i - 1)), F.lit(False))
            shown = F.when(F.get(v["kinds"], i) == "b", F.lit("")).otherwise(line)
            return F.when((i == 0) | goes_on, shown).otherwise(F.concat(F.lit("\n"), shown))

        return F.array_join(F.transform(v["lines"], one), "")

    return X.let(put, lines=lines, kinds=kinds)
