from lectern.llm.forms import fold
from lectern.llm import lookalikes
from lectern.llm.lookalikes import consistent_forms, repairs, same_texts, scripts_of, text_classes


def test_fold():
    assert fold("Ｌüｃke　No.45９。｡") == "Lücke No.459。。"
    assert fold("é​﻿­") == "é"
    assert fold("⾊⻔雷\U000e0100︀") == "色门雷"
    assert fold("a\nb  c①…½") == "a\nb  c①…½"


def test_repairs():
    assert repairs("Hyacinth") == [] and repairs("42") == []
    assert repairs("Hуacinth") == ["Hyacinth"]
    assert repairs("С3") == ["C3"] and repairs("Χaνο")[-1] == "Xavo"
    assert repairs("жук") == []


def test_pairs(spark):
    rows = [
        (1, "他们搜查了C3室，找到Maxime。"), (2, "他们搜查了С3室，找到Maxime。"), (3, "他们搜查了Ｃ3室，找到M​axime。"), (3, "他们搜查了Ｃ3室，找到M​axime。"),
        (4, "他们搜查了C3室，找到Maxime。"), (5, "他们搜查了C4室，找到Maxime。"), (6, "他们搜查了C3室，\n找到Maxime。"), (7, None), (8, ""), (9, "​"), (10, "‌"),
        (11, "Dvоřin"), (12, "Dvořin"), (13, "Qхqzj"), (14, "Qxqzj2"), (15, "a b"), (16, "a b"), (17, "a  b"), (None, "a b"),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "pair_id bigint, zh string, form string").drop("form")
    got = sorted(map(tuple, same_texts(df, "pair_id", "zh").collect()))
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (9, 10), (11, 12), (15, 16)]
    forms = {r.pair_id: r.form for r in consistent_forms(df, "pair_id", "zh").collect()}
    assert forms[2] == forms[1] and forms[13] == "Qхqzj" and 7 not in forms and forms[8] == ""
    assert same_texts(df.limit(0), "pair_id", "zh").count() == 0


def test_many_copies(spark):
    rows = [(i, "同一行") for i in range(3000)] + [(9000, "同​一行"), (9001, "同‍一行")]
    got = same_texts(spark.createDataFrame(rows, "pair_id bigint, zh string"), "pair_id", "zh")
    assert got.count() == 6001


def test_a_text_in_another_script_stays(spark):
    assert scripts_of(["сор", "жук"]) == {"CYRILLIC"} and scripts_of(["сор", "cop", "42"]) == frozenset() and scripts_of(["лoм"]) == frozenset()
    rows = [(1, "в углу лежал сор, а рядом жук"), (2, "the cop had a dog and a сор"), (3, "the сop had a dog and a cop"), (4, "他是сор"), (5, "в углу лежал cор, а рядом жук")]
    forms = {r.i: r.t for r in consistent_forms(spark.createDataFrame(rows, "i int, t string"), "i", "t").select("i", "t", "form").drop("t").withColumnRenamed("form", "t").collect()}
    assert forms[1] == rows[0][1] and forms[2] == "the cop had a dog and a cop" == forms[3] and forms[4] == "他是cop"
    assert forms[5] == forms[1]  # mixed: two of three letters are Cyrillic, and the corpus knows that word


def test_blocks_of_variants(spark, monkeypatch):
    marks = ["​", "‌", "‍", "⁠"]
    rows = [(i, "同" + "".join(marks[i // 4**k % 4] for k in range(4)) + "一行") for i in range(60)] + [(100, rows_of := "别的"), (101, rows_of)]
    df = spark.createDataFrame(rows, "i int, t string")
    want = sorted(map(tuple, same_texts(df, "i", "t").collect()))
    assert want == [(a, b) for a in range(60) for b in range(a + 1, 60)]
    monkeypatch.setattr(lookalikes, "BLOCK", 7)
    assert sorted(map(tuple, same_texts(df, "i", "t").collect())) == want
    classes = {r.i: (r["class"], r.variants, r.rows) for r in text_classes(df, "i", "t").collect()}
    assert len({c for c, _, _ in classes.values()}) == 2 and classes[0][1:] == (60, 60) and classes[100][1:] == (1, 2)
