import random

import numpy as np
import pytest

from lectern.llm.boost import Boost
from lectern.llm.scans import Scans, doubles, parts, words

NAMES = "Tomar Bessel Anwick Corliss Merrow Hadley Quimby Fenwick Oswald Perrin".split()
THINGS = "lantern garden kettle harbour blanket mirror ladder picture hammer carpet".split()
DEEDS = "carried the {} into the old chapel|found a small {} under the stairs|wondered why the {} was never returned|followed the road and dropped the {} before evening|remembered the half-finished {} in the station".split("|")
HAN_THINGS = "灯笼 花园 水壶 港口 毯子 镜子 梯子 照片 锤子 地毯".split()
HAN_DEEDS = "把{}搬进了旧的教堂。|在楼梯下面发现了一个小小的{}。|想知道为什么{}一直没有还回来。|沿着那条路走，天黑之前丢掉了{}。|还记得车站里那个没有做完的{}。".split("|")
HAN_NAMES = "托马尔 贝塞尔 安维克 科利斯 梅罗".split()


def clean(r, han):
    n = r.randrange(3, 7)
    if han:
        return "".join(r.choice(HAN_NAMES) + r.choice(HAN_DEEDS).format(r.choice(HAN_THINGS)) for _ in range(n))
    return " ".join(f"{r.choice(NAMES)} {r.choice(DEEDS).format(r.choice(THINGS))}." for _ in range(n))


@pytest.fixture(scope="module")
def scans(spark):
    r = random.Random(2)
    rows = [(f, i, i % 4, False, clean(r, f == "zh")) for f in ("target", "zh") for i in range(250)]
    rows += [
        ("target", 1001, 1, True, "Tomar carried the kettle into the old cha-\n\nTHE SILENT RIVER    17\n- 17 -\npel. Bessel found a small lantem under the\nstairs. Merrow remembered the half-\nfinished hammer in the station."),
        ("target", 1002, 1, True, "THE SILENT RIVER\nHadley wondered why the rnirror was never returned. On the door there was only this:\n318\nPerrin found a small gar¬\nden under the stairs.\n[44]"),
        ("target", 1003, 2, True, "Quimby found a small picture under the stairs."),
        ("zh", 1001, 1, True, "托马尔把水壸搬进了旧的教堂。贝塞尔\n第9页\n【寂静的河】\n在楼楼梯梯下下面面发发现现了\n一个小小的镜子。"),
        ("zh", 1004, 1, True, None), ("zh", 1005, 1, True, ""), ("zh", None, 1, True, "x"), ("zh", 1006, None, None, "\n \n"),
    ]
    df = spark.createDataFrame(rows + rows[-9:-5], "field string, id long, book int, scan boolean, text string")
    titles = spark.createDataFrame([(1, "THE SILENT RIVER"), (1, "寂静的河"), (2, None)], "book int, title string")
    return Scans(df, titles)


def test_noise(scans):
    got = {tuple(r) for r in scans.noise().collect()}
    want = {
        ("target", 1001, 1, "hyphen"), ("target", 1001, 3, "header"), ("target", 1001, 4, "page_no"), ("target", 1001, 5, "misread"),
        ("target", 1002, 1, "header"), ("target", 1002, 2, "misread"), ("target", 1002, 4 + 0, "hyphen"), ("target", 1002, 6, "page_no"),
        ("zh", 1001, 1, "misread"), ("zh", 1001, 2, "page_no"), ("zh", 1001, 3, "header"), ("zh", 1001, 4, "misread"),
    }
    assert got == want, (got - want, want - got)


def test_repaired(scans):
    text = {(r.field, r.id): r.text for r in scans.repaired().collect()}
    assert text["target", 1001] == "Tomar carried the kettle into the old chapel. Bessel found a small lantern under the stairs. Merrow remembered the half-finished hammer in the station."
    assert text["target", 1002] == "Hadley wondered why the mirror was never returned. On the door there was only this: 318 Perrin found a small garden under the stairs."
    assert text["zh", 1001] == "托马尔把水壶搬进了旧的教堂。贝塞尔在楼梯下面发现了一个小小的镜子。"


@pytest.fixture(scope="module")
def slow(spark):
    """Clean texts with a reduplication, scans with misread ideographs beside it."""
    r = random.Random(3)
    rows = [("zh", i, 1, False, clean(r, True) + f"{r.choice(HAN_NAMES)}看着{r.choice(HAN_THINGS)}慢慢走进了教堂。") for i in range(250)]
    rows += [("zh", 250, 1, False, "贝塞尔走了了吗？")]
    rows += [
        ("zh", 1001, 1, True, "贝塞尔看着水壸慢慢走进了教堂。"),
        ("zh", 1003, 1, True, "贝塞尔走走了了吗吗。把把锤锤子子慢慢慢慢\n慢慢走走进进。"),
        ("zh", 1004, 1, True, "梅罗看着梯子慢慢走进进了教堂。"),
        ("zh", 1002, 1, True, "托马尔把水壶搬进了旧的教堂。\n想想知知道道为为什什么么水水壸壸一一直直没没有有还还回回来来。"),
    ]
    return Scans(spark.createDataFrame(rows, "field string, id long, book int, scan boolean, text string"), spark.createDataFrame([], "book int, title string"))


def test_misread_beside_doubles(slow):
    assert ("zh", 1001, 1, "misread") in {tuple(r) for r in slow.noise().collect()}
    text = {r.id: r.text for r in slow.repaired().collect()}
    assert text[1001] == "贝塞尔看着水壶慢慢走进了教堂。"
    assert text[1002] == "托马尔把水壶搬进了旧的教堂。想知道为什么水壶一直没有还回来。"


def test_doubles(slow):
    text = {r.id: r.text for r in slow.repaired().collect()}
    assert text[1003] == "贝塞尔走了吗。把锤子慢慢慢走进。"  # 了了 occurs in a clean text
    assert text[1004] == "梅罗看着梯子慢慢走进了教堂。"
    line = "看看。看看看看地地a图图。人人山"
    assert [(at, n) for at, _, _, _, n in doubles(line, [0] * 3 + [1] * (len(line) - 3))] == [(0, 1), (3, 5), (5, 5), (7, 5), (10, 5), (13, 5)]
    assert not list(doubles("", [])) and not list(doubles("看了了了。", [0] * 5))


def test_empty_tables(spark):
    none = Scans(spark.createDataFrame([], "field string, id long, book int, scan boolean, text string"), spark.createDataFrame([], "book int, title string"))
    assert none.noise().count() == 0 and none.repaired().count() == 0


def test_parts_and_words():
    assert parts("lantem", "lantern") == [("rn", "m")] and parts("harboiir", "harbour") == [("u", "ii")]
    assert parts("alreacly", "already") == [("d", "cl")] and parts("hurriecltowarcls", "hurriedtowards") != []
    assert [w for _, w in words("Don't 第3章Old-time even!ng 9A")] == ["Don", "t", "3", "Old", "time", "even!ng", "9A"]


def test_boost():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6))
    y = (x[:, 0] > 0) & (x[:, 1] > 0.3)
    m = Boost().fit(x[:2000], y[:2000])
    assert ((m.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert Boost().fit(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((3, 2))).shape == (3,)


def test_a_frequent_key_is_dealt_out(spark, monkeypatch):
    from lectern.llm import scans

    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", f"w{i}") for i in range(90)] + [("b", "v")], "k string, meant string")
    want = sorted(map(tuple, left.join(right, "k").select("k", "x", "meant").collect()))
    monkeypatch.setattr(scans, "HEAVY", 10)
    assert sorted(map(tuple, scans.dealt_join(left, right, "k", "meant", 8).select("k", "x", "meant").collect())) == want and len(want) == 91


def test_page_numbers_of_any_length():
    from lectern.llm.furniture import NUMERIC

    assert all(NUMERIC.match(x) for x in ("12", "- 1204 -", "103456", "xiv", "[ MCMXC ]", "第12页", "l2O"))
    assert not any(NUMERIC.match(x) for x in ("", "-", "vim", "civil", "the 12", "12 men"))
