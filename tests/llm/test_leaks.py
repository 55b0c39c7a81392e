import random

import numpy as np

from lectern.llm.forms import skeleton
from lectern.llm.leaks import bitmap, find_leaks, hashes, marked, myers, units

ITEM = "The tidal quarry at Wexley was built in 1838 by surveyors who underestimated salinity by 389 percent, once the zinc had doubled."
HAN = "根据一九七三年的报告翁布雷一带的侵蚀使地质学家在每座拦河坝上花费约一百克朗然后离开"
STATED = "The art of the quiet river is to cross the old stone bridge slowly."


def plain(pattern, text):
    """The whole table of edit distances, its last row."""
    prev = list(range(len(pattern) + 1))
    out = [prev[-1]]
    for c in text:
        row = [prev[0] + 1]
        for i, p in enumerate(pattern):
            row.append(min(prev[i] + (p != c), prev[i + 1] + 1, row[i] + 1))
        prev = row
        out.append(row[-1])
    return out


def test_myers_against_the_plain_table():
    r = random.Random(3)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randrange(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randrange(0, 60)))
        assert myers(p, t) == plain(p, t)


def test_marked():
    codes, parted = marked("Ab-c​d ①é")
    assert "".join(map(chr, codes)) == skeleton("Ab-c​d ①é") == "abcd1é"
    assert np.flatnonzero(parted).tolist() == [0, 2, 4, 6]


def test_hashes_of_any_part_are_those_of_the_whole(spark):
    codes = np.array([ord(c) for c in ITEM], np.uint32)
    for size, whole in hashes(codes, [3, 12, 24]):
        assert len(whole) == len(ITEM) - size + 1 and all(next(hashes(codes[k : k + size], [size]))[1][0] == whole[k] for k in range(len(whole)))
        assert len(set(whole.tolist())) == len({ITEM[k : k + size] for k in range(len(whole))}) and len(next(hashes(codes[: size - 1], [size]))[1]) == 0
    bits, seen = bitmap(spark.createDataFrame([(int(x),) for x in whole[:40].view(np.int64)], "hash bigint"))
    place = whole >> np.uint64(64 - bits)
    on = seen[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8)) & 1
    assert on[:40].all() and on.sum() < 45


def brute(docs, items, words, letters, budget):
    """item by item, window by window, between every two borders of a document"""
    out = {}
    for d, t in docs:
        codes, parted = marked(t or "")
        s = "".join(map(chr, codes))
        for i, it in items:
            u = units(it or "")
            single = bool(u) and all(len(x) == 1 for x in u)
            n = letters if single else words
            for k in range(len(u) - n + 1):
                w = "".join(u[k : k + n])
                for a in range(len(s)):
                    if single or parted[a]:
                        for b, x in enumerate(plain(w, s[a : a + len(w) + budget])):
                            if x <= budget and (single or parted[a + b]):
                                out[d, i] = min(x, out.get((d, i), x))
    return out


def test_rows(spark):
    w = ITEM.split()
    docs = [
        (1, None), (2, ""), (3, " \n "), (4, ITEM), (5, "x " + " ".join(w[3:15]) + " y"), (6, " ".join(w[3:14]) + " end"),
        (7, " ".join(w[2:16]).upper().replace("A", "А").replace(" ", "\n> ")), (8, " ".join(w[3:15]).replace("surveyors", "surveyars")),
        (9, "甲" + HAN[3:28] + "乙"), (10, HAN[3:26] + "完"), (11, " ".join(w[:11] + ["one", "two"] + w[11:])),
        # within words: no passage
        (13, "The p" + STATED[4:64] + "head stands."), (14, "Say: the " + STATED[4:].replace(" ", " - ")), (4, ITEM),
        (12, ("lorem ipsum " * 20_000) + ITEM),
    ]
    items = [(1, ITEM), (2, HAN), (3, None), (4, "too short"), (1, ITEM), (5, STATED)]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()
    assert {(r[0], r[1]) for r in got if r[2] == 0} == {(4, 1), (5, 1), (7, 1), (9, 2), (12, 1), (14, 5)}
    assert len(got) == len({r[:2] for r in got}) and {tuple(r[:2]): r[2] for r in got} == brute(docs[:-1], items, 12, 24, 1) | {(12, 1): 0}
    assert find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_near_copies(spark):
    """One letter of each stretch of twelve words is changed, left out or put in: all are found, none at distance 0."""
    r = random.Random(9)
    said = ["".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    items = [(k, " ".join(said[k * 14 : k * 14 + 14])) for k in range(200)]
    docs = []
    for k, t in items:
        words = t.split()
        for at in (5, 11):  # both windows of twelve that hold word 5 or 11 and those that do not
            j = r.randrange(len(words[at]))
            words[at] = words[at][:j] + r.choice(["z", "", "z" + words[at][j]]) + words[at][j + 1 :]
        docs.append((k, "before it " + " ".join(words[:13]) + " and after"))
    d, i = spark.createDataFrame(docs, "d bigint, t string"), spark.createDataFrame(items, "i bigint, t string")
    found = {(x.d, x.i): x.distance for x in find_leaks(d, "d", "t", i, "i", "t").collect()}
    one = {k for k, t in docs if brute([(k, t)], [items[k]], 12, 24, 1)}
    assert {k for k, _ in found} == one and all(a == b for a, b in found) and set(found.values()) <= {1}
    two = find_leaks(d, "d", "t", i, "i", "t", budget=2).collect()
    assert len(two) / len(docs) >= 0.9


def test_blocks_of_characters(spark, monkeypatch):
    """A text is hashed block by block; passages across blocks are found, with pieces of any length."""
    from lectern.llm import leaks

    codes = "".join(map(chr, marked(ITEM)[0]))
    asked = spark.createDataFrame([(int(next(hashes(np.array([ord(c) for c in codes[at : at + n]], np.uint32), [n]))[1].view(np.int64)[0]),) for n in (6, 24) for at in (0, 5, 40)], "hash bigint")
    bits, seen = bitmap(asked)
    whole = set(leaks.scan(ITEM, [6, 24], bits, seen, 10))
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 7)
    assert set(leaks.scan(ITEM, [6, 24], bits, seen, 10)) == whole and len(whole) >= 6 and not list(leaks.scan(ITEM, [], bits, seen, 10))
