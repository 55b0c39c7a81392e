"""Noise in text from scanned pages: margin lines, divided words, misread characters; and the text without it.

Lines are classified by traits of the pairs they make with their neighbours, the titles of the book and how often a line
recurs in it. Words that the clean texts do not know look up candidates through an inverted join of positional q-grams;
ideographs in unknown company look up candidates through the join of one-gap trigrams. Boosted trees, trained on clean
words and windows that were corrupted on purpose, rank the candidates; the best one above one half is the correction.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.boost import Boost
from lectern.llm.common import spread
from lectern.llm.forms import LOOKALIKES, fold, is_han
from lectern.llm.furniture import HEADER, NUMBER, TEXT, Page, kinds_of, running, splits, train
from lectern.tables import materialise

#: Rows of clean text and of clean words and windows that the models are trained on.
SAMPLE_TEXTS, SAMPLE_WORDS, SAMPLE_WINDOWS = 600, 2000, 6000
#: Candidates of those words and windows that a model is trained on.
SAMPLE_LESSONS = 60_000
#: A place in a text is its paragraph's number times this, and the place in the paragraph.
PARAGRAPH = 1 << 32
#: Rows of one key that a task joins; those of a more frequent one are dealt out.
HEAVY = 10_000
# What recognition is known to confuse (printed, read).
CONFUSED = (
    "m:rn rn:m d:cl cl:d w:vv vv:w u:ii n:ri ri:n in:m m:in h:b b:h h:li li:h e:c c:e t:f f:t o:0 l:1 i:1 s:5 g:9 i:! l:! b:6 z:2 "
    "a:o o:a l:i i:l n:u u:n y:v v:y 0:O 1:l 5:S 8:B 0:o 1:I ti:h r:n ni:m nn:m k:lc g:q q:g"
).split()
PAIRS = frozenset(tuple(x.split(":")) for x in CONFUSED)
WORD = re.compile(r"[^\W_](?:[\w'’!|-]*[^\W_])?|(?<=\s)![a-z][\w'’!-]*")


def words(text: str) -> list[tuple[int, str]]:
    """Places and words of other scripts than Han; a hyphen in a word divides it."""
    out = []
    for m in WORD.finditer(text):
        at = m.start()
        for part in re.split(r"([\-’']|[㐀-鿿豈-﫿]+)", m[0]):
            if part and any(c.isalnum() for c in part) and not is_han(part[0]):
                out.append((at, part))
            at += len(part)
    return out


def normal(word: str) -> str:
    return "".join(LOOKALIKES.get(c, c) for c in word).lower()


def windows(text: str) -> Iterator[tuple[int, str]]:
    """Place and company of each ideograph: two characters before, itself, two after; ^ and $ stand beyond the ends."""
    t = "^^" + text + "$$"
    for i, c in enumerate(text):
        if is_han(c):
            yield i, t[i : i + 5]


def doubles(text: str, lines: list[int]) -> Iterator[tuple[int, str, str, str, int]]:
    """(place, ideograph, characters before and after the pair, pairs of the stretch) of each doubled ideograph.

    ``lines``: the line of each character. A stretch goes on in its line, over other characters, until an ideograph
    stands an odd number of times; four times are two pairs."""
    groups = []
    for m in re.finditer(r"([㐀-鿿豈-﫿])\1*", text):
        at, end = m.span()
        if end - at > 2:  # a doubled line may end with what the next begins with
            for k in range(at + 1, end):
                if lines[k] != lines[k - 1]:
                    groups.append((at, k))
                    at = k
        groups.append((at, end))
    stretch: list[int] = []
    last = None
    for at, end in [*groups, (len(text), len(text) + 1)]:
        even, broken = (end - at) % 2 == 0, at < len(text) and lines[at] != last
        if stretch and (broken or not even):
            for k in stretch:
                yield k, text[k], text[k - 1] if k else "^", text[k + 2] if k + 2 < len(text) else "$", len(stretch)
            stretch = []
        if even:
            stretch += range(at, end, 2)
        last = lines[min(end, len(text)) - 1] if text else None


def parts(read: str, true: str) -> list[tuple[str, str]]:
    """Stretches in which two words differ, as (printed, read), widened to known confusions."""
    i, k, most = 0, 0, min(len(read), len(true))
    while i < most and read[i] == true[i]:
        i += 1
    while k < most - i and read[-1 - k] == true[-1 - k]:
        k += 1
    whole = (true[i : len(true) - k], read[i : len(read) - k])
    if max(map(len, whole)) <= 2 or whole in PAIRS:
        out = [whole]
    elif len(whole[0]) == len(whole[1]):
        out = [(a, b) for a, b in zip(*whole) if a != b]
    else:
        out = [(true[j1:j2], read[i1:i2]) for tag, i1, i2, j1, j2 in SequenceMatcher(None, read, true, False).get_opcodes() if tag != "equal"]
    if len(out) == 1 and out[0] not in PAIRS:  # part of a confusion may agree: ri for n, cl for d ...
        for a in (0, 1):
            for b in (0, 1):
                wide = (true[max(0, i - a) : len(true) - max(0, k - b)], read[max(0, i - a) : len(read) - max(0, k - b)])
                if wide in PAIRS:
                    return [wide]
    return out


def grams(word: Column, size: int) -> Column:
    """Positional q-grams of a padded word, counted from its start and from its end."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    n = F.length(padded) - F.lit(size)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.array(F.concat(F.lit(f"{size}<"), i.cast("string"), F.lit(" "), padded.substr(i + 1, F.lit(size))), F.concat(F.lit(f"{size}>"), (n - i).cast("string"), F.lit(" "), padded.substr(i + 1, F.lit(size)))))
    return F.flatten(each)


def dealt_join(left: DataFrame, right: DataFrame, on: str, each: str, many: int) -> DataFrame:
    """``left`` and ``right`` joined by a column. Rows of ``right`` under a key that has more than HEAVY of them are dealt
    out by the column ``each``, and the rows of ``left`` that meet them are repeated, so no task holds all of a key."""
    parts = right.groupBy(on).agg(F.count(F.lit(1)).alias("parts")).where(f"parts > {HEAVY}").select(on, F.expr(f"cast((parts + {HEAVY - 1}) div {HEAVY} as int)").alias("parts"))
    left = left.join(parts, on, "left").withColumn("part", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")
    right = right.join(parts, on, "left").withColumn("part", F.expr(f"cast(pmod(xxhash64({each}), coalesce(parts, 1)) as int)")).drop("parts")
    return left.repartition(many, on, "part").join(right.repartition(many, on, "part"), [on, "part"]).drop("part")


def word_candidates(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, label, true, n): for each asked word the words of the vocabulary that share enough q-grams with it.
    Words of up to five letters are looked up by pairs, longer ones by triples."""
    short = F.length("word") <= 5
    left = asked.where(F.length("word") > 1).select("word", "label", "own", F.explode(F.when(short, grams(F.col("word"), 2)).otherwise(grams(F.col("word"), 3))).alias("gram"))
    can = F.length("meant") <= 7
    right = vocabulary.where(F.length("meant") > 1).select("meant", "n", F.explode(F.when(can, F.concat(grams(F.col("meant"), 2), grams(F.col("meant"), 3))).otherwise(grams(F.col("meant"), 3))).alias("gram"))
    spark = asked.sparkSession
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # few bytes, much work
    met = dealt_join(left, right, "gram", "meant", many).where("meant <> own and meant <> word and abs(length(meant) - length(word)) <= 2")
    near = F.when(F.length("word") <= 5, 2).when(F.length("word") <= 8, 3).otherwise(4)
    shared = met.repartition(many, "word").groupBy("word", "label", "own", "meant").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"))
    return shared.where((F.col("shared") >= F.greatest(F.lit(2), F.ceil(F.length("word") / 3))) & (F.levenshtein("word", "meant") <= near))


def word_traits(word: str, true: str, n: float, shared: float, odd: float, support: float) -> list[float]:
    """``odd``: occurrences in clean words of the rarest trigram of the word; ``support``: words that differ the same way."""
    p = parts(word, true)
    known = sum(x in PAIRS for x in p)
    return [
        len(p), sum(len(a) for a, _ in p), sum(len(b) for _, b in p), known, float(known == len(p)), float(any(not c.isalpha() for _, b in p for c in b)),
        np.log1p(n), shared / (2 * len(word)), len(word), np.log1p(odd), np.log1p(support), float(any(c.isdigit() for c in true)),
    ]


def corrupt(r: random.Random, word: str) -> str:
    """The word with one or two confusions."""
    for _ in range(2 if r.random() < 0.15 else 1):
        at = [(i, a, b) for a, b in PAIRS for i in range(len(word)) if word.startswith(a, i)]
        if at:
            i, a, b = r.choice(sorted(at))
            word = word[:i] + b + word[i + len(a) :]
    return word


def varied(r: random.Random, word: str, letters: str) -> str:
    """The word with one or two letters changed, lost or put in at random, as other words differ from it."""
    for _ in range(r.choice([1, 1, 2])):
        k = r.randrange(len(word))
        word = r.choice([word[:k] + r.choice(letters) + word[k + 1 :], word[:k] + word[k + 1 :], word[:k] + r.choice(letters) + word[k:]])
        if len(word) < 2:
            break
    return word


class Scans:
    """The noise of scanned texts, found by the help of clean ones.

    ``rows``: (field string, id bigint, book, scan boolean, text string); ``titles``: (book, title string), some rows
    per book or none. Null and empty texts have no noise; repeated rows count once; tables may be empty.
    """

    def __init__(self, rows: DataFrame, titles: DataFrame) -> None:
        self.rows = spread(rows.where("length(text) > 0 and id is not null").distinct())
        self.clean = self.rows.where("not coalesce(scan, false)").select("field", "book", "text")
        self.titles = titles.where("length(title) > 0").groupBy("book").agg(F.sort_array(F.collect_set("title")).alias("titles"))
        self.pages = self._pages()
        self.counts = self._counts()

    def _pages(self) -> DataFrame:
        """Scanned texts with the kinds of their lines, words and windows of the text."""
        clean = self.clean.join(self.titles, "book", "left").select("text", F.xxhash64("text").alias("h"), "field", "titles")
        sample = [(x.text, max((t for t in x.titles or [] if any(map(is_han, t)) == any(map(is_han, x.text[:40]))), key=len, default="")) for x in clean.orderBy("h", "text").limit(SAMPLE_TEXTS).collect()]
        known = [t for _, t in sample if t] or ["THE OLD HOUSE BY THE RIVER"]
        model = self.rows.sparkSession.sparkContext.broadcast(train(sample, known))

        key = F.lower(F.regexp_replace(F.regexp_replace("line", r"(?i)\b(ch\.|chapter)\s*\S+\s*$|^\s*chapter\s+\S+|第\s*\S{1,4}\s*章", ""), r"[^\p{L}]", ""))
        scans = self.rows.where("scan")
        seen = scans.select("field", F.coalesce(F.col("book").cast("string"), F.lit("")).alias("book"), "id", F.explode(F.split("text", "\n")).alias("line")).select("field", "book", "id", key.alias("key")).where("length(key) > 0")
        seen = seen.distinct()
        often = seen.groupBy("field", "book", "key").agg(F.count(F.lit(1)).alias("n"))
        anywhere = often.groupBy("field", "key").agg(F.sum("n").alias("all")).where("all > 1")
        met = seen.join(often.join(anywhere, ["field", "key"]), ["field", "book", "key"])
        repeats = met.groupBy("field", "id").agg(F.collect_list(F.struct("key", "n", "all")).alias("repeats"))
        ready = scans.join(self.titles, "book", "left").join(repeats, ["field", "id"], "left").select("field", "id", "text", "titles", "repeats")

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                pages = [
                    Page(text, list(titles) if titles is not None else [], {x["key"]: (x["n"], x["all"]) for x in repeats} if repeats is not None else {})
                    for text, titles, repeats in zip(batch["text"], batch["titles"], batch["repeats"])
                ]
                kinds = [k for at in range(0, len(pages), 1000) for k in kinds_of(pages[at : at + 1000], model.value)]
                yield pd.DataFrame({"field": batch["field"], "id": batch["id"], "text": batch["text"], "kinds": kinds})

        return materialise(ready.mapInPandas(read, "field string, id bigint, text string, kinds array<int>"), "pages")

    def _counts(self) -> DataFrame:
        """(what, item, n): words and n-grams of the clean texts; words stand for themselves, n-grams have 1 to 3
        characters. Compounds are counted whole, too ('-')."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found: Counter = Counter()
                for text in batch["text"]:
                    for part in re.split(r"\n\s*\n", text):
                        lines = [fold(x).strip() for x in part.split("\n")]
                        flat = lines[0]
                        for x in lines[1:]:
                            flat += ("" if flat[-1:] == "-" or not flat or not x or not (flat[-1].isascii() and flat[-1].isalnum() or flat[-1] in ".,;:!?”") or not (x[0].isascii() or x[0].isalpha() and not is_han(x[0])) or x[0] == "-" else " ") + x
                        found.update(("w", normal(w)) for _, w in words(flat))
                        found.update(("c", normal(m)) for m in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)+", flat))
                        for _, w in windows(flat):
                            found.update((("1", w[2]), ("2", w[1:3]), ("2", w[2:4]) if not is_han(w[3]) else ("0", ""), ("3", w[1:4]), ("3", w[:3]) if not is_han(w[1]) else ("0", ""), ("3", w[2:]) if not is_han(w[3]) else ("0", "")))
                yield pd.DataFrame([(*k, n) for k, n in found.items() if k[0] != "0"], columns=["what", "item", "n"])

        out = self.clean.mapInPandas(count, "what string, item string, n bigint").groupBy("what", "item").agg(F.sum("n").alias("n"))
        return materialise(out, "counts")

    def counted(self, what: str, item: str, n: str) -> DataFrame:
        return self.counts.where(F.col("what") == what).select(F.col("item").alias(item), F.col("n").alias(n))

    def hyphens(self) -> DataFrame:
        """(field, id, line, next, word): lines at whose end a word is divided by a sign that is not its own, decided
        from what the clean texts know of the joined word, of the compound and of either part."""

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for field, key, text, kinds in batch.itertuples(index=False):
                    found += [(field, key, a, b, normal(left), sign, normal(right)) for a, b, left, sign, right in splits(Page(text, [], {}), list(kinds))]
                yield pd.DataFrame(found, columns=["field", "id", "line", "next", "a", "sign", "b"])

        found = self.pages.select("field", "id", "text", "kinds").mapInPandas(cut, "field string, id bigint, line int, next int, a string, sign string, b string")
        found = found.withColumn("last", F.element_at(F.split("a", "-"), -1)).withColumn("word", F.concat("last", F.split("b", "-")[0])).withColumn("pair", F.concat("a", F.lit("-"), F.regexp_extract("b", r"^[\p{L}-]*", 0)))
        asked = found.select("last", "b", "word", "pair").distinct()
        for what, item, n in (("w", "word", "n_word"), ("c", "pair", "n_pair"), ("w", "last", "n_last"), ("w", "b", "n_b")):
            asked = asked.join(self.counted(what, item, n), item, "left")
        traits = ["n_word", "n_pair", "n_last", "n_b"]
        model = self._joins()

        @F.pandas_udf("boolean")
        def divided(sign: pd.Series, n: pd.DataFrame) -> pd.Series:
            soft = ~sign.isin(["-", "‑"]).to_numpy()  # no compound is written with such a sign
            x = np.column_stack([np.log1p(n.fillna(0).to_numpy(float)), soft])
            return pd.Series(model.predict(x) > 0.5)

        decided = found.join(asked, ["last", "b", "word", "pair"]).where(divided("sign", F.struct(*traits)))
        return decided.select("field", "id", "line", "next", "word")

    def _joins(self) -> Boost:
        """Whether a sign at a line's end divides a word: trained on words cut anywhere and compounds cut at their own
        hyphen, with the counts that the clean texts have of them; a part of either is made unknown."""
        r = random.Random(11)
        pick = lambda what: [(x.item, x.n) for x in self.counts.where(F.col("what") == what).where("length(item) > 3").orderBy(F.xxhash64("item"), "item").limit(SAMPLE_WORDS).collect()]
        some = pick("w")
        known, x, y = dict(some), [], []
        seen = {x.item: x.n for x in self.counts.where("what = 'w'").where(F.col("item").isin(sorted({p for w, _ in pick("c") for p in w.split("-")}))).collect()}
        count = lambda w: np.log1p(known.get(w, seen.get(w, 0)))
        for w, n in some:
            if w.isalpha():
                k = r.randrange(2, len(w) - 1)
                x.append([np.log1p(n) if r.random() < 0.85 else 0, 0, count(w[:k]), count(w[k:]), r.random() < 0.4])
                y.append(1)
        for w, n in pick("c"):
            a, _, b = w.rpartition("-")
            for _ in range(8):
                full, left, right = r.random() < 0.85, count(a.split("-")[-1]), count(b)
                x.append([0, np.log1p(n) if full else 0, left, right, 0])
                y.append(0)
        return Boost(rounds=40).fit(np.array(x, float).reshape(len(x), 5), np.array(y))

    def _walked(self, joined: DataFrame, emit, schema: str, places: DataFrame | None = None) -> DataFrame:
        """``emit(paragraphs)`` over each page's running text, with field, id in front of what it yields. Given ``places``
        (field, id, at), it is ``emit(paragraphs, set of the page's places)``."""
        marks = joined.groupBy("field", "id").agg(F.collect_list("line").alias("joined"))
        ready = self.pages.join(marks, ["field", "id"], "left")
        if places is not None:
            ready = ready.join(places.groupBy("field", "id").agg(F.collect_list("at").alias("places")), ["field", "id"], "left")
        ready = ready.select("field", "id", "text", "kinds", "joined", *(["places"] if places is not None else []))

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [c.split(" ")[0] for c in schema.split(", ")]
            for batch in batches:
                found = []
                for field, key, text, kinds, lines, *more in batch.itertuples(index=False):
                    page = Page(text, [], {})
                    more = [set(x) if x is not None else set() for x in more]
                    found += [(field, key, *x) for x in emit(running(page, list(kinds), set(lines) if lines is not None else set()), *more)]
                yield pd.DataFrame(found, columns=["field", "id", *names])

        return ready.mapInPandas(walk, f"field string, id bigint, {schema}")

    def misread_words(self, joined: DataFrame) -> DataFrame:
        """(field, id, word, true, lines): words read wrongly with their correction and, letter by letter, their lines."""

        def emit(paragraphs):
            for p in paragraphs:
                for at, w in words("".join(c for c, _ in p)):
                    if len(w) > 1:
                        yield normal(w), [n for _, n in p[at : at + len(w)]]

        found = self._walked(joined, emit, "word string, lines array<int>")
        known = self.counted("w", "word", "known")
        unknown = materialise(found.join(known, "word", "left_anti").where(F.expr(r"not word rlike '^[0-9]+$'")), "unknown")
        asked = unknown.select("word").distinct()
        return unknown.join(self._rank_words(asked), "word")

    def _rank_words(self, unknown: DataFrame) -> DataFrame:
        """(word, true) for the unknown words that are a misread known one."""
        spark = unknown.sparkSession
        vocabulary = self.counted("w", "meant", "n").where(F.expr(r"meant rlike '^\\p{L}+$|^[0-9]*\\p{L}[0-9]*$'"))
        r = random.Random(5)
        own = vocabulary.where("length(meant) > 2").orderBy(F.xxhash64("meant"), "meant").limit(SAMPLE_WORDS).collect()
        made, letters = [], "".join(sorted({c for x in own for c in x.meant if c.isalpha()}))
        for x in own:
            made.append((x.meant, 0, x.meant))  # a word that is right, as if the clean texts did not know it
            w = varied(r, x.meant, letters)
            if not any(c in PAIRS for c in parts(w, x.meant)):
                made.append((w, 0, ""))  # another word, whatever it resembles
            for _ in range(2):
                w = corrupt(r, x.meant)
                if w != x.meant:
                    made.append((w, 1, x.meant))
        figures = self.counts.where("what = 'w'").where(F.expr("item rlike '^[0-9]{2,}$'")).orderBy(F.xxhash64("item"), "item").limit(SAMPLE_WORDS // 4).collect()
        for x in figures:
            w = list(x.item)
            for k in r.sample(range(len(w)), r.choice([1, 1, 2])):
                w[k] = r.choice({"0": "o", "1": "li!", "5": "s", "8": "b"}.get(w[k], w[k]))
            if "".join(w) != x.item and any(c.isdigit() for c in w):
                made.append(("".join(w), 1, x.item))
        lesson = spark.createDataFrame(made or [("", 0, "")], "word string, label int, source string")
        # of a corrupted word the source is the answer; of a right word all candidates are wrong
        asked = unknown.select("word", F.lit(-1).alias("label"), F.lit("").alias("own"), F.lit("").alias("source")).unionByName(
            lesson.join(self.counted("w", "word", "n"), "word", "left").where("label = 0 and source <> '' or n is null").select("word", "label", F.when(F.col("label") == 0, F.col("source")).otherwise("").alias("own"), "source")
        )
        distinct = asked.select("word", "label", "own").distinct()
        met = word_candidates(distinct, vocabulary)
        # a number among letters that look like digits is a candidate as well, known to the clean texts or not
        number = F.expr(r"word rlike '^[0-9oli!sb]{2,}$' and word rlike '[0-9]' and not word rlike '^[0-9]+$'")
        plain = distinct.where(number).withColumn("meant", F.translate("word", "oli!sb", "011158")).where("meant <> own")
        met = met.unionByName(plain.select("word", "label", "own", "meant", (2 * F.length("word")).cast("bigint").alias("shared"), F.lit(1).cast("bigint").alias("n")))
        thirds = vocabulary.select(F.col("n").alias("m"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("meant")), lambda i: F.concat(F.lit("^"), "meant", F.lit("$")).substr(i, F.lit(3))))).alias("third")).groupBy("third").agg(F.count(F.lit(1)).alias("m"))
        odd = asked.select("word", "own").distinct().select("word", "own", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word"))), lambda i: F.concat(F.lit("^"), "word", F.lit("$")).substr(i, F.lit(3))))).alias("third"))
        odd = odd.join(thirds, "third", "left").groupBy("word", "own").agg((F.min(F.coalesce("m", F.lit(0))) - F.when(F.col("own") == F.col("word"), 1).otherwise(0)).alias("odd"))

        @F.pandas_udf("string")
        def change(word: pd.Series, true: pd.Series) -> pd.Series:
            out = []
            for w, t in zip(word, true):
                p = parts(w, t)
                out.append("|".join(f"{a}>{b}" for a, b in p))
            return pd.Series(out, dtype=object)

        met = materialise(met.withColumn("change", change("word", "meant")).join(odd, ["word", "own"]), "candidates")
        support = met.where("instr(change, '|') = 0").groupBy("change").agg(F.countDistinct(F.when(F.col("label") != 0, F.col("word"))).alias("support"))
        met = met.join(support, "change", "left").fillna(0, ["support"])
        lessons = met.where("label >= 0").join(lesson.select("word", "label", "source").distinct(), ["word", "label"]).select("word", "meant", "n", "shared", "odd", "support", F.expr("cast(label = 1 and meant = source as int)").alias("y"))
        lessons = lessons.orderBy(F.xxhash64("word", "meant"), "word", "meant").limit(SAMPLE_LESSONS).toArrow().to_pandas()
        traits = lambda d: np.array([word_traits(*v) for v in zip(d["word"], d["meant"], d["n"], d["shared"], d["odd"], d["support"])], float).reshape(len(d), 12)
        model = Boost(rounds=80).fit(traits(lessons), lessons["y"].to_numpy(float))

        @F.pandas_udf("double")
        def rate(word: pd.Series, true: pd.Series, n: pd.Series, shared: pd.Series, odd: pd.Series, support: pd.Series) -> pd.Series:
            x = traits(pd.DataFrame({"word": word, "meant": true, "n": n, "shared": shared, "odd": odd, "support": support}))
            return pd.Series(model.predict(x))

        rated = met.where("label = -1").withColumn("rate", rate("word", "meant", "n", "shared", "odd", "support"))
        return rated.groupBy("word").agg(F.max_by("meant", F.struct("rate", "n", "meant")).alias("meant"), F.max("rate").alias("rate")).where("rate > 0.5").select("word", "meant")

    def misread_signs(self, joined: DataFrame) -> DataFrame:
        """(field, id, at, read, true, line): ideographs read wrongly (true: the right one) or doubled (true: ''). All
        others are judged in the company that they have when the doubled ones are undoubled, those among them."""

        def pairs(paragraphs):
            for k, p in enumerate(paragraphs):
                for at, c, before, after, run in doubles("".join(c for c, _ in p), [n for _, n in p]):
                    yield k * PARAGRAPH + at, c + c, before + c + after, before + c + c, c + c + after, run, p[at][1]

        # no text doubles three ideographs on end by itself; fewer do it where the clean texts know the undoubled company better
        found = self._walked(joined, pairs, "at bigint, read string, once string, before string, after string, run int, line int")
        for name in ("once", "before", "after"):
            found = found.join(self.counted("3", name, f"n_{name}"), name, "left")
        twice = found.where("run >= 3 or coalesce(n_once, 0) > greatest(coalesce(n_before, 0), coalesce(n_after, 0))")
        twice = materialise(twice.select("field", "id", "at", "read", F.lit("").alias("meant"), "line"), "doubles")

        def company(paragraphs, noise):
            for k, p in enumerate(paragraphs):
                left = [i for i in range(len(p)) if k * PARAGRAPH + i - 1 not in noise]
                for at, w in windows("".join(p[i][0] for i in left)):
                    place = k * PARAGRAPH + left[at]
                    yield place, w[2] * (2 if place in noise else 1), w, p[left[at]][1]

        found = self._walked(joined, company, "at bigint, read string, window string, line int", twice)
        mid = F.substring("window", 2, 3)
        alone = found.withColumn("mid", mid).join(self.counted("3", "mid", "n"), "mid", "left_anti")
        alone = materialise(alone.select("field", "id", "at", "read", "window", "line"), "signs")
        fixed = self._rank_signs(alone.groupBy("window").agg(F.count(F.lit(1)).alias("seen")))
        wrong = materialise(alone.join(fixed, "window").select("field", "id", "at", "read", "meant", "line"), "wrong")
        return wrong.unionByName(twice.join(wrong.select("field", "id", "at"), ["field", "id", "at"], "left_anti"))

    def _rank_signs(self, unknown: DataFrame) -> DataFrame:
        """(window, true) for the windows whose middle is a misread ideograph."""
        spark = unknown.sparkSession
        thirds = self.counted("3", "third", "n").where("length(third) = 3")
        r = random.Random(9)
        ones = [x.item for x in self.counts.where("what = '1'").orderBy(F.xxhash64("item"), "item").limit(SAMPLE_WORDS).collect()]

        def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"window": sorted({w for t in batch["text"] for p in re.split(r"\n\s*\n", t) for _, w in windows("".join(fold(x).strip() for x in p.split("\n")))})}, dtype=object)

        some = materialise(self.clean.orderBy(F.xxhash64("text"), "text").limit(4 * SAMPLE_TEXTS).select("text").mapInPandas(sample, "window string").distinct(), "windows")
        pick = lambda df, n: [x.window for x in df.orderBy(F.xxhash64("window"), "window").limit(n).collect()]
        # right windows that the clean texts know from one place only are what an unknown right window looks like; they
        # are many to one among unknown windows, and so they are here
        single = some.withColumn("third", F.substring("window", 2, 3)).join(thirds.where("n = 1"), "third", "left_semi")
        made = [(w, 0, w[2]) for w in pick(single, SAMPLE_WINDOWS)]
        for w in pick(some, SAMPLE_WINDOWS // 6):
            c = r.choice(ones) if ones and r.random() < 0.6 else chr(r.randrange(0x4E00, 0x9FA5))  # known or new to the clean texts
            if c != w[2]:
                made.append((w[:2] + c + w[3:], 1, w[2]))
        lesson = spark.createDataFrame(made or [("", 0, "")], "window string, label int, source string").distinct()
        asked = unknown.select("window", F.lit(-1).alias("label"), F.lit("").alias("source"), "seen").unionByName(lesson.withColumn("seen", F.lit(1).cast("bigint")))
        ch = lambda c, i, n=1: F.col(c).substr(i, n)
        gap = asked.withColumn("gap", F.concat(ch("window", 2), ch("window", 4)))
        side = thirds.select(F.concat(ch("third", 1), ch("third", 3)).alias("gap"), ch("third", 2).alias("meant"), F.col("n").alias("n_mid"))
        many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        met = dealt_join(gap, side, "gap", "meant", many).where("meant <> substring(window, 3, 1)").drop("gap")
        own = lambda col, taken: F.greatest(F.coalesce(col, F.lit(0)) - F.when(F.col("label") == 0, taken).otherwise(0), F.lit(0))
        for name, key in (
            ("n_left", F.concat(ch("window", 1, 2), "meant")), ("n_right", F.concat("meant", ch("window", 4, 2))),
            ("o_left", ch("window", 1, 3)), ("o_mid", ch("window", 2, 3)), ("o_right", ch("window", 3, 3)),
        ):
            met = met.withColumn("key", key).join(thirds.select(F.col("third").alias("key"), F.col("n").alias(name)), "key", "left").drop("key")
        for name, key in (("n_a", F.concat(ch("window", 2), "meant")), ("o_a", ch("window", 2, 2)), ("o_b", ch("window", 3, 2))):
            met = met.withColumn("key", key).join(self.counted("2", "key", name), "key", "left").drop("key")
        for name, key in (("n_one", F.col("meant")), ("o_one", ch("window", 3))):
            met = met.withColumn("key", key).join(self.counted("1", "key", name), "key", "left").drop("key")
        # a right window is judged as if the clean texts lacked its one occurrence
        names = ["n_mid", "n_left", "n_right", "n_a", "n_one", "o_left", "o_mid", "o_right", "o_a", "o_b", "o_one"]
        met = met.select("window", "label", "source", "meant", "seen", *[(own(F.col(c), 1) if c[0] == "o" else F.coalesce(F.col(c), F.lit(0))).alias(c) for c in names]).where("o_mid = 0 and n_one > 0")
        met = materialise(met, "signs")

        def traits(d: pd.DataFrame) -> np.ndarray:
            x = np.log1p(d[names].to_numpy(float).reshape(len(d), len(names)))
            return np.column_stack([x, (x[:, :3] > 0).sum(1), (x[:, 5:8] > 0).sum(1), x[:, 3] - x[:, 8]])

        lessons = met.where("label >= 0").select(*names, F.expr("cast(label = 1 and meant = source as int)").alias("y"), F.xxhash64("window", "meant").alias("h"), "window", "meant")
        lessons = lessons.orderBy("h", "window", "meant").limit(SAMPLE_LESSONS).drop("h", "window", "meant").toArrow().to_pandas()
        model = Boost(rounds=80).fit(traits(lessons), lessons["y"].to_numpy(float))

        @F.pandas_udf("double")
        def rate(d: pd.DataFrame) -> pd.Series:
            return pd.Series(model.predict(traits(d)))

        rated = met.where("label = -1").withColumn("rate", rate(F.struct(*names)))
        best = F.struct("rate", "n_mid", "meant")
        # the candidates' probabilities add up: a sign can be wrong for sure while its correction is in doubt
        found = rated.groupBy("window", "seen").agg(F.max_by(F.struct("meant", "n_mid", "n_one"), best).alias("x"), F.sum("rate").alias("rate")).select("window", "seen", "x.*", "rate").where("rate > 0.5")
        # one misreading befalls a sign wherever it stands: what comes up again and again in one company only, though the
        # sign has many, is another word
        found = found.withColumn("mid", ch("window", 2, 3)).withColumn("read", ch("window", 3))
        per = found.groupBy("read", "meant", "mid").agg(F.sum("seen").alias("here"), F.first("n_mid").alias("n_mid"), F.first("n_one").alias("n_one"))
        every = per.groupBy("read", "meant").agg(F.sum("here").alias("everywhere"))
        other = per.join(every, ["read", "meant"]).withColumn("share", F.least(F.lit(1.0), F.col("n_mid") / F.col("n_one")))
        other = other.where("here >= 6 and here / everywhere > share + 4 * sqrt(share * (1 - share) / everywhere)").select("read", "meant", "mid")
        found = found.join(other, ["read", "meant", "mid"], "left_anti").select("window", "read", "meant")
        # a sign that the clean texts lack and that was found misread time and again is so everywhere
        signs = unknown.withColumn("read", ch("window", 3)).join(self.counted("1", "read", "n"), "read", "left_anti")
        share = signs.groupBy("read").agg(F.count(F.lit(1)).alias("all")).join(found.groupBy("read").agg(F.count(F.lit(1)).alias("bad"), F.mode("meant").alias("meant")), "read")
        strange = signs.join(share.where("bad >= 3 and bad >= 0.15 * all").select("read", "meant"), "read").select("window", "meant")
        return found.select("window", "meant").unionByName(strange.join(found, "window", "left_anti"))

    def found(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Divided words, misread words and misread ideographs, each written out once."""
        if not hasattr(self, "_found"):
            joined = materialise(self.hyphens(), "hyphens")
            self._found = joined, materialise(self.misread_words(joined), "misread"), materialise(self.misread_signs(joined), "misread")
        return self._found

    def repaired(self) -> DataFrame:
        """(field, id, text): the scanned texts as continuous paragraphs, parted by blank lines, without margin lines
        and dividing signs and with misread characters put right. Page breaks inside a sentence leave no trace."""
        joined, bad_words, bad_signs = self.found()
        marks = joined.groupBy("field", "id").agg(F.collect_list("line").alias("joined"))
        fixes = bad_words.groupBy("field", "id").agg(F.collect_set(F.struct("word", "meant")).alias("fixes"))
        signs = bad_signs.groupBy("field", "id").agg(F.sort_array(F.collect_set(F.struct("at", "read", "meant")), asc=False).alias("signs"))
        ready = self.pages
        for x in (marks, fixes, signs):
            ready = ready.join(x, ["field", "id"], "left")

        def mend(word: str, table: dict[str, str]) -> str:
            new = table.get(normal(word))
            return word if new is None else new.upper() if word.isupper() and len(word) > 1 else new[:1].upper() + new[1:] if word[:1].isupper() else new

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = []
                for r in batch.itertuples(index=False):
                    paragraphs = ["".join(c for c, _ in p) for p in running(Page(r.text, [], {}), list(r.kinds), set(r.joined) if r.joined is not None else set())]
                    for x in r.signs if r.signs is not None else ():
                        k, at = divmod(x["at"], PARAGRAPH)
                        new = x["meant"] or x["read"][0]
                        paragraphs[k] = paragraphs[k][:at] + new + paragraphs[k][at + len(x["read"]) :]
                    table = {x["word"]: x["meant"] for x in r.fixes} if r.fixes is not None else {}
                    for k, p in enumerate(paragraphs):
                        for at, w in reversed(words(p)) if table else ():
                            p = p[:at] + mend(w, table) + p[at + len(w) :]
                        paragraphs[k] = p
                    texts.append("\n\n".join(paragraphs))
                yield pd.DataFrame({"field": batch["field"], "id": batch["id"], "text": texts})

        return ready.select("field", "id", "text", "kinds", "joined", "fixes", "signs").mapInPandas(run, "field string, id bigint, text string")

    def noise(self) -> DataFrame:
        """(field, id, line_no, kind): kinds header, page_no, hyphen and misread, each line and kind once."""
        margin = self.pages.select("field", "id", F.posexplode("kinds").alias("line", "k")).where(f"k <> {TEXT}")
        margin = margin.select("field", "id", "line", F.expr(f"case k when {HEADER} then 'header' when {NUMBER} then 'page_no' end").alias("kind"))
        joined, bad_words, bad_signs = self.found()

        @F.pandas_udf("array<int>")
        def wrong(word: pd.Series, true: pd.Series, lines: pd.Series) -> pd.Series:
            out = []
            for w, t, at in zip(word, true, lines):
                hit = set()
                for tag, i1, i2, _, _ in SequenceMatcher(None, w, t, False).get_opcodes():
                    if tag != "equal":
                        hit.update(int(x) for x in at[max(0, i1 - (i1 == i2)) : max(i2, i1 + 1)])
                out.append(sorted(hit))
            return pd.Series(out)

        found = bad_words.select("field", "id", F.explode(wrong("word", "meant", "lines")).alias("line"))
        signs = bad_signs.select("field", "id", "line")
        misread = found.unionByName(signs).withColumn("kind", F.lit("misread"))
        hyphen = joined.select("field", "id", "line", F.lit("hyphen").alias("kind"))
        out = margin.unionByName(hyphen).unionByName(misread).distinct()
        return out.select("field", "id", (F.col("line") + 1).cast("bigint").alias("line_no"), "kind")
