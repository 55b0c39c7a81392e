"""One consistent form for texts that look the same, and the rows that turn out to be one text.

Characters are folded first (width, composition, radicals, kinds of space, invisible ones). Look-alike letters of
other scripts are then repaired token by token: the dominant script of a mixed token is determined, the letters of the
others are replaced, and the replacement stands only if the repaired token occurs in the corpus by itself. A token of one
script is left alone wherever its text is written in that script.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import key, keyed, spread
from lectern.llm.forms import LOOKALIKES, fold
from lectern.tables import materialise

TOKEN = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\p{Nd}]+")
BACK = {("CYRILLIC" if "Ѐ" <= k <= "ԯ" else "GREEK", v): k for k, v in LOOKALIKES.items()}


@lru_cache(100_000)
def script(c: str) -> str:
    """LATIN, GREEK or CYRILLIC of a letter, else ''."""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "").split(" ")[0]
    return name if name in ("LATIN", "GREEK", "CYRILLIC") else ""


def repairs(token: str, at_home: frozenset[str] = frozenset()) -> list[str]:
    """What a mixed token may be meant to be: in its dominant script, then in Latin; none for a token of one script.

    A token without a Latin letter counts as mixed with what is around it if each of its letters looks Latin and its
    scripts are not ``at_home`` in its text. Which of the candidates is taken, if any, is for the vocabulary to say.
    """
    counts = {"LATIN": 0, "CYRILLIC": 0, "GREEK": 0}
    for c in token:
        if script(c):
            counts[script(c)] += 1
    used = [s for s, n in counts.items() if n]
    if not used or used == ["LATIN"] or len(used) == 1 and used[0] in at_home:
        return []
    dominant = max(used, key=lambda s: (counts[s], s == "LATIN")) if "LATIN" in used else "LATIN"
    found = []
    for target in dict.fromkeys((dominant, "LATIN")):
        out = "".join(c if script(c) in ("", target) else LOOKALIKES.get(c, "\0") if target == "LATIN" else BACK.get((target, LOOKALIKES.get(c, c)), "\0") for c in token)
        if "\0" not in out:
            found.append(unicodedata.normalize("NFC", out))
    return found


def scripts_of(tokens: list[str]) -> frozenset[str]:
    """Scripts but Latin that a text is written in: a token of that script alone has a letter that looks like no Latin one."""
    out = set()
    for t in tokens:
        if not t.isascii():
            used = {script(c) for c in t} - {""}
            if len(used) == 1 and used != {"LATIN"} and any(script(c) and c not in LOOKALIKES for c in t):
                out |= used
    return frozenset(out)


def look(text: str) -> tuple[str, list[dict], list[str]]:
    """The folded text, its tokens to be repaired with what they would become, and its tokens of one script."""
    folded = fold(text)
    suspects, words = {}, set()
    tokens = TOKEN.findall(folded)
    at_home = scripts_of(tokens)
    for t in tokens:
        found = repairs(t, at_home)
        if found:
            suspects[t] = found
        else:
            words.add(t)
    return folded, [{"token": a, "fixed": b, "rank": i} for a, x in suspects.items() for i, b in enumerate(x)], sorted(words)


def consistent_forms(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text, form): each distinct pair of id and text once, with the text in its consistent form.

    Null texts are left out; an empty text has an empty form. The vocabulary is counted over all rows, so a look-alike
    token is repaired wherever its plain form stands in any text. Line breaks, marks, digits and the number of spaces
    are kept. Further columns are not read; an empty table gives none.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [look(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "text": batch["text"], "form": [f[0] for f in found], "suspects": [f[1] for f in found], "words": [f[2] for f in found]})

    rows = spread(df.select(key(df, id_col, "id"), F.col(text).alias("text")).where("text is not null").distinct())
    seen = materialise(rows.mapInPandas(run, "id string, text string, form string, suspects array<struct<token:string,fixed:string,rank:int>>, words array<string>"), "forms")
    asked = seen.where("size(suspects) > 0").select(F.inline("suspects")).distinct()
    words = seen.select(F.explode("words").alias("fixed")).distinct()
    known = asked.join(words, "fixed", "left_semi").groupBy("token").agg(F.min_by("fixed", "rank").alias("fixed"))
    dirty = seen.where("size(suspects) > 0").select(F.xxhash64("id", "text").alias("row"), "id", "text", "form", "suspects")
    fixes = dirty.select("row", "id", F.explode(F.array_distinct("suspects.token")).alias("token")).join(known, "token").groupBy("row", "id").agg(F.collect_list(F.struct("token", "fixed")).alias("fixes"))

    @F.pandas_udf("string")
    def mend(form: pd.Series, fixes: pd.Series) -> pd.Series:
        def one(f, x):
            if x is None or not len(x):
                return f
            table = {d["token"]: d["fixed"] for d in x}
            return TOKEN.sub(lambda m: table.get(m[0], m[0]), f)

        return pd.Series([one(f, x) for f, x in zip(form, fixes)])

    mended = dirty.join(fixes.drop("id"), "row", "left").select("id", "text", mend("form", "fixes").alias("form"))
    out = seen.where("size(suspects) = 0").select("id", "text", "form").unionByName(mended)
    return keyed(out.withColumnRenamed("text", text), df, id_col, "id")


#: Different strings of one form that are held against each other in one task.
BLOCK = 1000


def text_classes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, class, raw, variants, rows): one row per id and text, null and empty texts left out. ``class`` is the same for
    texts of one consistent form, ``raw`` for equal strings; ``variants`` says how many different strings it has, ``rows`` how many rows."""
    forms = consistent_forms(df.where(F.length(text) > 0), id_col, text).where(F.col(id_col).isNotNull())
    rows = materialise(forms.select(F.col(id_col).alias("id"), F.md5(text).alias("raw"), F.md5("form").alias("class")), "classes")
    raw = rows.groupBy("class", "raw").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(raw.groupBy("class").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("rows")), "class").select(F.col("id").alias(id_col), "class", "raw", "variants", "rows")


def same_texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts differ as strings but have one consistent form.

    Null and empty texts pair with nothing, equal strings not with each other. The different strings of one form are
    paired first and rows are joined to them afterwards, so copies of one string never meet. Strings of a form that has
    many are dealt out into blocks, and blocks are paired, so no task meets more than BLOCK by BLOCK of them.
    """
    rows = text_classes(df, id_col, text).where("variants > 1").withColumnRenamed(id_col, "id")
    strings = rows.select("class", "raw", F.expr(f"cast((variants + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks")).distinct()
    strings = strings.withColumn("block", F.expr("cast(pmod(xxhash64(raw), blocks) as int)"))
    left = strings.select("class", F.col("raw").alias("raw_a"), F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"))
    right = strings.select("class", F.col("raw").alias("raw_b"), F.explode(F.expr("sequence(0, block)")).alias("i"), F.col("block").alias("j"))
    pairs = left.join(right, ["class", "i", "j"]).where("i < j or raw_a < raw_b").select("class", "raw_a", "raw_b")
    a, b = (rows.select("class", F.col("raw").alias(f"raw_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    out = pairs.join(a, ["class", "raw_a"]).join(b, ["class", "raw_b"]).where("id_a <> id_b")
    return out.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
