import json

from pyspark.sql import functions as F

from lectern.operators import align as A


def test_reference_window(spark):
    lines = [str(i) for i in range(200)]
    df = spark.createDataFrame([(lines, c) for c in (1, 2, 4)] + [([], 1)], "ls array<string>, c int")
    got = [r[0] for r in df.select(A.reference_window(F.col("ls"), F.col("c"), F.lit(4), 50)).collect()]
    for text, c in zip(got, (1, 2, 4)):
        at = 200 * c // 4
        assert text.split("\n") == lines[max(0, at - 50) : at + 51]
    assert got[3] == ""


def test_pending_title_and_verdicts(spark):
    chunks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "book int, f string")
    done = spark.createDataFrame([(1, "a", "x"), (1, "a", "y")], "book int, f string, t string")
    assert sorted(map(tuple, A.pending(chunks, done, ["book", "f"]).collect())) == [(1, "b"), (2, "a")]
    df = spark.createDataFrame([("c", "t", 1), ("c", "t", 11), ("c", None, 1)], "c string, t string, n int")
    assert [r[0] for r in df.select(A.with_title(F.col("c"), F.col("t"), F.col("n"))).collect()] == ["t\n\nc", "c", "c"]
    df = spark.createDataFrame([("True",), ("tRUE",), ("False",), (None,)], "d string")
    assert [r[0] for r in df.select(A.accepted(F.col("d"))).collect()] == [True, True, False, False]
    assert df.select(A.accepted(F.lit(True))).first()[0] is True


def test_replies(spark):
    rows = ['{"think": "a", "target": "b"}', "x {think: 'a', 'target': \"b\",} y", '{"target": "b', "none", "} {", None, '{"target": "b"} and {"target": "c"}', '{"target": "b\nc"}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, raw string")
    got = [r.y and r.y.target for r in df.select("i", A.parse_reply(F.col("raw")).alias("y")).orderBy("i").collect()]
    assert got[0] == got[1] == "b" and got[3:7] == [None, None, None, None] and got[7] == "b\nc"
    assert json.loads(A.mend_json('{"a": [1, 2,], b: True, // c\n "d": \'it\\\'s\'')) == {"a": [1, 2], "b": True, "d": "it's"}
    assert A.mend_json("{]") is None and A.mend_json("[1]") is None


def test_span_alignment():
    ref = "The road was long. Nobody came that night, said the miller's wife, and she closed the door. Then it rained."
    assert A.align_span("nobody came that night said the miller's wife and she closed the door", ref) == "Nobody came that night, said the miller's wife, and she closed the door."
    assert A.align_span("nobody cane that night the wife and she closed a door", ref) == "Nobody came that night, said the miller's wife, and she closed the door."
    assert A.align_span("zzz", ref) == "" and A.align_span("", ref) == "" and A.align_span("a", "") == ""
    assert A.coverage("a b c", "a b c") == 1 and A.coverage("", "a") == 0 and abs(A.coverage("a b", "a c") - 0.5) < 1e-9


def test_local_span_against_plain_table():
    import random

    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(1, 12))] for _ in range(2))
        found = A.local_span(a, b)
        best = plain(a, b)
        assert (found is None) == (best == 0)
        if found:
            assert round(found[2] * 2 * len(a)) == best and 0 <= found[0] <= found[1] < len(b)
            assert plain(a, b[found[0] : found[1] + 1]) == best


def test_pipeline_and_dead_letters(spark):
    ref = "One two three four. Five six seven eight nine ten. Eleven twelve."
    rows = [(1, "five six seven eight nine ten", ref), (2, "five apple seven pear nine plum", ref), (3, None, ref)]
    kept, rejected, failed = A.align_and_verify(spark.createDataFrame(rows, "k int, source string, reference string"))
    assert [(r.k, r.target) for r in kept.collect()] == [(1, "Five six seven eight nine ten.")]
    assert [r.k for r in rejected.collect()] == [2] and [(r.k, r.error[:10]) for r in failed.collect()] == [(3, "ValueError")]


def test_prompts_and_replies(spark):
    df = spark.createDataFrame([(1, 'say "x"\n}'), (2, None)], "k int, source string")
    got = [r[0] for r in df.orderBy("k").select(A.prompt("Do:", source=F.col("source"))).collect()]
    assert got[0].startswith("Do:\n{") and json.loads(got[0][4:]) == {"source": 'say "x"\n}'} and json.loads(got[1][4:]) == {"source": None}
    df = df.withColumn("reply", A.parse_reply(F.lit('{"k": "9", "source": "?", "zh": "z", "more": 1}'), "k string, source string, zh string"))
    assert [tuple(r) for r in A.merge_reply(df, "reply", ["k", "source"]).orderBy("k").collect()] == [(1, 'say "x"\n}', "z"), (2, None, "z")]


def test_models_are_built_once_per_worker_and_called_in_batches(spark, tmp_path):
    place = str(tmp_path)

    class Model:
        def __init__(self):
            import os
            import uuid

            open(f"{place}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def __call__(self, rows):
            if len(rows) > 1 and any(r["i"] == 7 for r in rows):
                raise RuntimeError("the whole batch fails")
            return [ValueError("odd") if r["i"] == 7 else {"n": str(len(rows))} for r in rows]

    df = spark.range(160).selectExpr("cast(id as int) as i").repartition(40)
    got = {r.i: r for r in A.run_model(df, Model, "n", size=3).collect()}
    import os

    built = [x.split("-")[0] for x in os.listdir(place)]
    assert len(built) == len(set(built)) < 40  # one of each process, however many tasks it ran
    assert len(got) == 160 and got[7].error == "ValueError: odd" and all(r.error is None for k, r in got.items() if k != 7)
    assert max(int(r.n) for r in got.values() if r.n) == 3


def test_loose_json():
    loose = {
        '{a: .5, b: +1, c: 0x1F, d: 5., e: -2.5e3}': {"a": 0.5, "b": 1, "c": 31, "d": 5.0, "e": -2500.0},
        "{/* x */ a: some words here, b: [1, two, 'three',], // y\n c: None}": {"a": "some words here", "b": [1, "two", "three"], "c": None},
        "{a: Infinity}": {"a": float("inf")}, '{"a": "x\\\ny"}': {"a": "xy"}, "{a: 'it\\'s \"b\"'}": {"a": 'it\'s "b"'}, "{a: {b: [1, 2": {"a": {"b": [1, 2]}}, "{": {},
    }
    assert [json.loads(A.mend_json(x)) for x in loose] == list(loose.values())
    assert [A.mend_json(x) for x in ("{a b}", "{]", "", "[1]", "{a: 1} {b: 2}", "{:")] == [None] * 6


def test_chinese_chapters(spark):
    """The whole chapter goes to the model, the title page with the first piece; trusted fields win; what fails is kept."""

    class Fake:
        def __call__(self, prompts, temperature, top_p, max_new_tokens):
            assert (temperature, top_p, max_new_tokens) == (0.1, 0.8, 2048)
            if len(prompts) > 1:
                raise RuntimeError("one at a time")
            p = prompts[0]
            assert p.startswith("[system]\n") and p.endswith("[assistant]\n") and "甲\n乙" in p
            if "boom" in p:
                raise RuntimeError("out of memory")
            return ["sorry" if "none" in p else '{"zh": null}' if "void" in p else '{"zh": "题\\n\\n甲 \\n 乙"}' if "题" in p else 'Yes: {"zh": "甲\\n乙。", "en": "?", "chunk_file": 9}.']

    rows = [(1, 1, "1", "chunk_1.wav", "one"), (2, 1, "1", "chunk_11.wav", 'say "two"'), (3, 1, "1", "chunk_3.wav", "none"), (4, 1, "1", "chunk_4.wav", "boom"), (5, 2, "1", "chunk_5.wav", "five"), (6, 1, "1", "chunk_6.wav", "void"), (7, 1, "1", "chunk_7.wav", None)]
    chunks = spark.createDataFrame(rows, "k int, book int, chapter string, chunk_file string, en string")
    chapters = spark.createDataFrame([(1, "1", "甲\n乙。")], "book int, chapter string, zh string")
    titles = spark.createDataFrame([(1, "题")], "book int, title string")
    aligned, failed = A.align_chinese(A.with_chapters(chunks, chapters, ["book", "chapter"], "zh", titles), lambda: A.Chat(Fake()), ["k"])
    assert sorted(map(tuple, aligned.collect())) == [(1, "chunk_1.wav", "one", "题甲乙"), (2, "chunk_11.wav", 'say "two"', "甲乙。"), (7, "chunk_7.wav", None, "甲乙。")]
    assert sorted(map(tuple, failed.collect())) == [(3, "chunk_3.wav", "no JSON object"), (4, "chunk_4.wav", "RuntimeError: out of memory"), (5, "chunk_5.wav", "no chapter"), (6, "chunk_6.wav", "no zh")]
