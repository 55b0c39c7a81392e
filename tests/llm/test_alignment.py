import inspect
import random
import tracemalloc

import numpy as np

from lectern.llm import alignment
from lectern.llm.alignment import Pair, Side, Table, align, lines, number, pack
from lectern.tables import materialise


def corpus(n, r):
    """Pairs of invented texts with known links: lines are left out, joined, split and moved."""
    words = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.choice([2, 3]))) for _ in range(160)]
    han = ["".join(chr(r.randrange(0x4E00, 0x6E00)) for _ in range(2)) for _ in range(160)]
    rows, truth = [], set()
    for k in range(n):
        a, b = [], []
        for _ in range(r.randrange(8, 16)):
            pick = [r.randrange(160) for _ in range(r.randrange(5, 9))]
            a.append([pick])
            if r.random() < 0.9:
                b.append([pick])
            if r.random() < 0.1:
                b.append([[r.randrange(160) for _ in range(6)]])
        for side in (a, b):
            for _ in range(2):
                i = r.randrange(len(side) - 1)
                if len(side[i]) == len(side[i + 1]) == 1 and (side is a or not any(len(x) > 1 for x in a)):
                    side[i : i + 2] = [side[i] + side[i + 1]]
        i = r.randrange(len(b))
        b.insert(r.randrange(len(b)), b.pop(i))
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                if any(p is q for p in x for q in y):
                    truth.add((k, i, j))
        rows.append((k, "\n \n".join(", ".join(" ".join(words[w] for w in p) for p in x) + "." for x in a) + "\n", "\n".join("，".join("".join(han[w] for w in p) for p in y) + "。" for y in b)))
    return rows, truth


def test_links_of_known_texts(spark):
    rows, truth = corpus(150, random.Random(4))
    df = spark.createDataFrame(rows + rows[:5], "id long, en string, zh string")
    got = {(r.id, r.first_no, r.second_no) for r in align(df, "id", "en", "zh").collect()}
    hit = len(got & truth)
    assert hit / len(got) > 0.95 and hit / len(truth) > 0.95, (hit, len(got), len(truth))


def test_odd_rows(spark):
    rows = [(1, None, "甲。", 1), (2, "", "甲。", 1), (3, "One.", None, 1), (4, " \n", "\n", 1), (5, "Bell 715 rang.", "铃715响了。", 1), (5, "Bell 715 rang.", "铃715响了。", 1), (6, "...\n?!", "。", 1), (7, "x " * 4000, "甲乙" * 3000, 1)]
    df = spark.createDataFrame(rows, "id long, en string, zh string, score int")
    out = align(df, "id", "en", "zh").collect()
    assert len(out) == len({tuple(r)[:3] for r in out}) and {r.id for r in out} <= {5, 7}
    assert align(df.limit(0), "id", "en", "zh").count() == 0


def test_lines():
    assert lines("a\n\n ​\n b ") == ["a", " b "] and lines(None) == []


def test_a_large_table_is_joined_and_gives_the_same_links(spark):
    df = spark.createDataFrame(corpus(60, random.Random(8))[0], "id long, en string, zh string")
    broadcast, joined = (set(map(tuple, align(df, "id", "en", "zh", entries=n).select("id", "first_no", "second_no").collect())) for n in (10**9, 0))
    assert len(broadcast) > 400 and broadcast == joined


def learnt(rows, blocks, monkeypatch):
    """Links after three rounds over texts cut into blocks of so many lines."""
    monkeypatch.setattr(alignment, "LINES", blocks)
    packed = [(pack(a), pack(b)) for _, a, b in rows]
    table = None
    masses = []
    for _ in range(3):
        count = {}
        for a, b in packed:
            for first, second, i, j, x, y in Pair(Side(*a), Side(*b)).expected(table):
                for k in zip(first[i].tolist(), second[j].tolist(), x.tolist(), y.tolist()):
                    old = count.setdefault(k[:2], [0.0, 0.0])
                    old[0] += k[2]
                    old[1] += k[3]
        masses.append(sum(x for x, _ in count.values()))
        of = [{}, {}]
        for (a, b), (x, y) in count.items():
            for k, t in enumerate((a, b)):
                old = of[k].setdefault(t, [0.0, 0.0])
                old[0] += x
                old[1] += y
        total = [sum(v[k] for v in count.values()) for k in (0, 1)]
        a, b = (np.array(x) for x in zip(*count))
        there = np.array([x / of[0][a][0] / (of[1][b][0] / total[0]) for (a, b), (x, _) in count.items()])
        back = np.array([y / of[1][b][1] / (of[0][a][1] / total[1]) for (a, b), (_, y) in count.items()])
        table = Table(a, b, there, back)
    return masses, [(k, i, j) for k, (a, b) in enumerate(packed) for i, j, _ in Pair(Side(*a), Side(*b)).links(table, 0.85, 0.25)]


def test_blocks_change_nothing(monkeypatch):
    rows, _ = corpus(25, random.Random(6))
    whole, few = learnt(rows, 1500, monkeypatch), learnt(rows, 4, monkeypatch)
    assert np.allclose(whole[0], few[0], rtol=1e-4) and whole[1] == few[1] and len(whole[1]) > 150
    monkeypatch.setattr(alignment, "PART", 5)  # lines with more tokens than a part of the table
    assert learnt(rows, 4, monkeypatch)[1] == whole[1]


def test_every_link_of_equals_is_kept():
    pair = Pair(Side(*pack("one two three")), Side(*pack("\n".join(["甲乙丙"] * 40))))
    (_, _, w, _), = pair.weights(None)
    assert (w > 0).all() and abs(w.sum() - 1) < 1e-3  # forty links of 0.025 each
    long = Pair(Side(*pack(" ".join("".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(500)))), Side(*pack("".join(map(chr, range(0x4E00, 0x4E00 + 250))))))
    assert all(len(x) > 0.9 * len(a) * len(b) for a, b, x, *_ in long.expected(None))  # 0.002 each
    assert inspect.signature(align).parameters["rounds"].default == 4


def test_tables():
    a, b, c, d = (number(x) for x in "abcd")
    t = Table(np.array([a, a, b]), np.array([c, d, d]), np.array([1.0, 2, 3]), np.array([4.0, 5, 6]))
    ids = np.array(sorted([a, b, number("new")])), np.array(sorted([d, c, number("none")]))
    there, back = t.part(*ids)
    want = {(a, c): (1, 4), (a, d): (2, 5), (b, d): (3, 6)}
    for i, x in enumerate(ids[0].tolist()):
        for j, y in enumerate(ids[1].tolist()):
            assert (there[i, j], back[i, j]) == want.get((x, y), (0, 0))
    assert (t.part(*ids)[0] == there).all() and number("a") != number("b")
    found, kept = pack("Room 715 of Anna")[0], pack("Room 715 of Anna")[2]
    assert len(found) == 4 + 4 + 4 and (kept & 1).sum() == 1 and len(kept) == 3


def test_a_table_reaches_the_workers_without_the_driver(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda _: 1 / 0)
    rows = materialise(spark.createDataFrame([(1, 5, 1.0, 4.0), (1, 6, 2.0, 5.0), (2, 6, 3.0, 6.0)], "a long, b long, there float, back float"), "table")
    tables = alignment.Tables(rows, 3)
    there, back = tables.held.value.part(np.array([1, 2, 3]), np.array([4, 5, 6]))
    assert there.tolist() == [[0, 1, 2], [0, 0, 3], [0, 0, 0]] and back.tolist() == [[0, 4, 5], [0, 0, 6], [0, 0, 0]]
    tables.drop()


def test_rows_of_few_and_of_many_entries(tmp_path):
    r = np.random.default_rng(3)
    full = np.where(r.random((40, 900)) < (1 / np.arange(1, 41))[:, None] ** 2, r.random((40, 900)), 0).astype(np.float32)
    i, j = np.nonzero(full)
    made = Table(i * 7 - 99, j * 3 - 50, full[i, j], -full[i, j])
    assert (made.mapped >= 0).any() and (made.mapped < 0).any()
    made.save(str(tmp_path / "t"))
    for t in (made, Table.load(str(tmp_path / "t"))):
        for _ in range(20):
            x, y = np.sort(r.choice(np.arange(-3, 43), 25, False)), np.sort(r.choice(np.arange(-9, 909), 300, False))
            want = np.where(((x >= 0) & (x < 40))[:, None] & ((y >= 0) & (y < 900)), full[np.clip(x, 0, 39)][:, np.clip(y, 0, 899)], 0)
            there, back = t.part(x * 7 - 99, y * 3 - 50)
            assert (there == want).all() and (back == -want).all()


def test_sums_take_little_room():
    r, voc, n = np.random.default_rng(5), np.arange(1000), 400_000
    sums, want = alignment.Sums(voc, voc), np.zeros((2, 1000, 1000))
    tracemalloc.start()
    for _ in range(4):
        i, j, x = r.integers(0, 1000, n), r.integers(0, 1000, n), r.random(n).astype(np.float32)
        sums.add(voc, voc, i, j, x, 2 * x)
        np.add.at(want, (slice(None), i, j), [x, 2 * x])
    del i, j, x
    tracemalloc.reset_peak()
    sums.fold()
    most = tracemalloc.get_traced_memory()[1] / (4 * n) - want.nbytes / (4 * n)
    tracemalloc.stop()
    code, x, y = sums.parts[0]
    assert (np.diff(code) > 0).all() and np.allclose(want[0].ravel()[code], x, rtol=1e-5) and np.allclose(want.sum(), x.sum() + y.sum(), rtol=1e-5)
    assert most < 38, most
