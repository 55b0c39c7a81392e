import math
from collections import Counter

import pytest

from lectern.operators.search import Bm25Index, chunks


def scores(docs, query):
    """The Okapi form, sequentially."""
    n = len(docs)
    df = Counter(t for d in docs for t in set(d))
    avg = sum(map(len, docs)) / n
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in query) for d in docs]


@pytest.mark.parametrize("query", [["a", "b", "a"], ["zz"], []])
def test_scores_and_order(spark, query):
    docs = ["a b c", "a a d", "e f", "b b b a", "c", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(9, None), (10, "")], "id int, text string")
    got = Bm25Index(chunks(df, "id", "text", "english"), pooled=True).search(query, 6).orderBy("rank").collect()
    want = scores([d.split() for d in docs], query)
    order = sorted(range(len(docs)), key=lambda i: (-round(want[i], 9), i))
    assert [r.corpus for r in got] == order and all(abs(r.score - want[r.corpus]) < 1e-9 for r in got)
    assert all(r.text.endswith("...") for r in got)


def test_one_corpus_each(spark):
    df = spark.createDataFrame([(1, "a b " * 200), (2, "c")], "id int, text string")
    got = Bm25Index(chunks(df, "id", "text", "english")).search(["a", "c"]).collect()
    assert sorted((r.corpus, r.chunk_id) for r in got) == [(1, 0), (1, 1), (2, 0)]
    assert [r.score < 0 for r in got if r.corpus == 2] == [True]  # a single chunk scores below zero for what it holds


def test_a_table_of_queries(spark):
    """Each query by the tokenizer of the text it is held against; scores are those of ready terms."""
    docs = [(1, "the bridge is old and the station was closed to us"), (2, "桥旧了 station 信号好"), (3, "bridge bridge"), (4, None)]
    index = Bm25Index(chunks(spark.createDataFrame(docs, "id int, text string"), "id", "text"), pooled=True)
    asked = spark.createDataFrame([("q", "Bridge bridge station"), ("q", "Bridge bridge station"), ("z", "信号"), ("n", None), ("e", "")], "k string, q string")
    got = {}
    for r in index.ask(asked, "k", "q", 2).collect():
        got.setdefault(r.k, {})[r.corpus] = r.score
    assert got.keys() == {"q", "z"} and got["z"].keys() == {2} and len(got["q"]) == 2
    english, chinese = ({r.corpus: r.score for r in index.search(t, 4).collect()} for t in (["Bridge", "bridge", "station"], ["Bridge", " ", "bridge", " ", "station"]))
    assert all(abs(v - {1: english, 2: chinese}[k][k]) < 1e-9 for k, v in got["q"].items() if k != 3)
    plan = index.search(["bridge"])._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "PushedFilters: [In(term, [bridge])]" in plan.replace("EqualTo(term,bridge)", "In(term, [bridge])").replace("IsNotNull(term), ", "")
    index.drop()


def test_counted(spark):
    from pyspark.sql import functions as F

    from lectern.operators.search import counted

    rows = [["b", "a", "b", "c", "b"], [], ["x"], None]
    got = [r[1] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t array<string>").select("i", counted(F.col("t"))).orderBy("i").collect()]
    assert [sorted(map(tuple, x or [])) for x in got] == [sorted(Counter(x or []).items()) for x in rows]
