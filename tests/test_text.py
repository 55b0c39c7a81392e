import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import text as T


def column(spark, rows, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, x {kind}")
    return [r[0] for r in df.select(expr.alias("y"), "i").orderBy("i").collect()]


HAN = "[一-鿿㐀-䶿豈-﫿]"


def undouble(line):
    """Sequential model."""
    if len(line) <= 1 or re.fullmatch(r"第\d+章", line.strip()):
        return line
    pairs = [(line[i], line[i + 1]) for i in range(0, len(line) - 1, 2)]
    total = [p for p in pairs if re.match(HAN, p[0]) or re.match(HAN, p[1])]
    twice = [p for p in pairs if p[0] == p[1] and re.match(HAN, p[0])]
    if not total or len(twice) / len(total) < 0.6:
        return line
    return re.sub(f"({HAN})\\1", r"\1", line)


def test_undouble(spark):
    r = random.Random(1)
    rows = ["", "哈", "哈哈利利", " 哈哈利利", "第11章", "哈哈利利波波特a", "aabb", "哈哈x利", "第第11章章"]
    rows += ["".join(r.choice("哈利波1a ") * r.choice([1, 2, 2, 2, 3]) for _ in range(r.randrange(1, 9))) for _ in range(400)]
    assert column(spark, rows, X.undouble(F.col("x"))) == [undouble(x) for x in rows]
    by_hand = {"哈哈利利": "哈利", "哈哈哈": "哈哈", "哈哈a哈": "哈哈a哈", "天天好": "天好", "好天天": "好天天", "第第11章章": "第11章", "哈": "哈", "ab": "ab"}
    assert column(spark, list(by_hand), X.undouble(F.col("x"))) == list(by_hand.values())


@pytest.mark.parametrize("what", ["undouble", "chunks", "reflow"])
def test_time_grows_with_the_text(spark, what):
    """Four times the text takes about four times as long, not sixteen."""
    part = {"undouble": "哈哈利波", "chunks": "one word ", "reflow": "第一章\n短\n\n他走了\n很远的路。\n"}[what]
    expr = {"undouble": X.undouble(F.col("x")), "chunks": F.size(X.token_chunks(X.english_tokens(F.col("x")))), "reflow": T.reflow(F.split("x", "\n"))}[what]

    def took(n):
        df = spark.createDataFrame([(part * n,)] * 8, "x string").repartition(8).select(F.hash(expr)).cache()
        began = time.time()
        df.count()
        df.unpersist()
        return time.time() - began

    took(100)
    assert took(40_000) < 8 * max(took(10_000), 0.3)


def reflow(lines):
    """Sequential model of the re-flowing rules."""
    head = lambda s: re.match("第[一二三四五六七八九十百千0-9]+章", s.strip())
    goes_on = lambda s: bool(s.strip()) and s.rstrip()[-1] not in "。！？，、；：…—?!.,;:」』）)]>”"
    out, i = [], 0
    for k, s in enumerate(lines):
        if head(s):
            i = k + 1
            while i < len(lines) and i < k + 3 and 0 < len(lines[i].strip()) <= 30:
                i += 1
            out = lines[:i]
            break
    buf, left = "", 0
    for s in lines[i:]:
        bare = s.strip()
        if left and not bare:
            out, buf, left = out + ([buf] if buf else []) + [s], "", 0
        elif left and len(bare) <= 30:
            out, left = out + [s], left - 1
        elif head(s):
            out, buf, left = out + ([buf] if buf else []) + [s], "", 2
        elif not bare:
            out, buf, left = out + ([buf] if buf else []) + [""], "", 0
        elif not buf or goes_on(buf):
            buf, left = buf + s, 0
        else:
            out, buf, left = out + [buf], s, 0
    return "\n".join(out + ([buf] if buf else []))


def test_reflow(spark):
    r = random.Random(2)
    parts = ["第1章", "第十章 春天", " ", "", "  \t", "他走了。", "他走", "短", "长" * 30, "长" * 31, "长" * 31 + "，", "x, y", "abc", "第二章" + "长" * 31]
    rows = [[r.choice(parts) for _ in range(r.randrange(0, 12))] for _ in range(600)]
    assert column(spark, rows, T.reflow(F.col("x")), "array<string>") == [reflow(x) for x in rows]


def test_lines_and_trim(spark):
    rows = ["a\r\n\r\n b\rc\n　\n\x1cd\x1f", "", " \n", None]
    assert column(spark, rows, X.lines(F.col("x"))) == [["a", "b", "c", "d"], [], [], None]
    assert column(spark, ["a\r\nb\x0bc d", "", "x\n\ny"], X.lines_with_ends(F.col("x"))) == [["a\r\n", "b\x0b", "c ", "d"], [], ["x\n", "\n", "y"]]


@pytest.mark.parametrize("n,starts", [(0, []), (1, [0]), (249, [0]), (250, [0]), (251, [0, 250]), (300, [0, 250]), (301, [0, 250]), (501, [0, 250, 500])])
def test_token_chunks(spark, n, starts):
    got = column(spark, [[str(i) for i in range(n)]], X.token_chunks(F.col("x")), "array<string>")[0]
    assert [int(c[0]) for c in got] == starts and all(len(c) <= 300 for c in got)


def test_overlap_is_refused():
    with pytest.raises(ValueError):
        X.token_chunks(None, 50, 50)


def test_tokens(spark):
    assert column(spark, ["He said 3.5, ok?"], X.english_tokens(F.col("x"))) == [["He", "said", "3.5", ",", "ok", "?"]]
    assert column(spark, ["信 a1!"], X.chinese_tokens(F.col("x"))) == [["信", " ", "a1", "!"]]
    assert column(spark, ["信 a1!"], X.mixed_tokens(F.col("x"))) == [["信", "a1", "信", "a1"]]


def test_breaks_initials_and_headings(spark):
    assert column(spark, ["一 　\n 二\n三a\n四\n\n五"], X.join_ideograph_breaks(F.col("x"))) == ["一二三a\n四五"]
    assert column(spark, ["M r. A\nH arry\n\nI am\nA\nb", "a b", "A  B"], X.join_initials(F.col("x"))) == ["Mr. A\nHarry\n\nIam\nA\nb", "ab", "A  B"]
    assert column(spark, ["第 12 章 x", "第十章", " 第3章", "x第3章"], X.heading_number(F.col("x"))) == ["12", None, "3", None]
    assert column(spark, ["a,", "a", " ", "a” ", "a“"], X.should_merge(F.col("x"))) == [False, True, False, False, True]


def test_chapters_en(spark):
    text = "front\nCHAPTER ONE\nTHE BOY\n\nM r. D\nChapter 2 - Two\nx\nChapter 3\nCHAPTER 4\nCHAPTER FIVE: five\nend"
    got = T.split_chapters_en(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id int, text string"), "id", "text").orderBy("chapter_no").collect()
    assert [(r.id, r.chapter_no, r.text) for r in got] == [(1, 1, "CHAPTER ONE\nTHE BOY\n\nMr. D\n"), (1, 2, "Chapter 2 - Two\nx\nChapter 3\n"), (1, 3, "CHAPTER 4\nCHAPTER FIVE: five\nend")]


def test_chapters_zh(spark):
    text = "书名\n第1章 甲\na\r\n第2章\nb\n第 1 章\nc"
    got = {(r.id, r.part): r.text for r in T.split_chapters_zh(spark.createDataFrame([(1, text), (2, "x"), (3, "")], "id int, text string"), "id", "text").collect()}
    assert got == {(1, "title"): "书名\n", (1, "1"): "第 1 章\nc", (1, "2"): "第2章\nb\n", (2, "title"): "x"}


def test_chapter_numbers(spark):
    rows = [(1, i, s) for i, s in enumerate(["12", "第  章", "x", "3", "4", "第章", "第章"])] + [(2, 0, "5"), (3, 0, "第章")]
    got = T.fix_chapter_numbers(spark.createDataFrame(rows, "page int, n int, line string"), ["page"], "n", "line").orderBy("page", "n").collect()
    assert [(r.page, r.line) for r in got] == [(1, "第12章"), (1, "x"), (1, "3"), (1, "第4章"), (1, "第章"), (2, "5"), (3, "第章")]


def test_treebank_tokens(spark):
    want = {
        'He said, "I don\'t know... it\'s 3.5%."': "He said , `` I do n't know ... it 's 3.5 % . ''", "They'll cannot go--(now)!": "They 'll can not go -- ( now ) !",
        "Mr. Cole’s hat. It fell.": "Mr. Cole 's hat. It fell .", "'Tis gonna rain": "'T is gon na rain", "": "", " \n": "",
    }
    got = column(spark, list(want), F.array_join(X.treebank_tokens(F.col("x")), " "))
    assert got == list(want.values())
