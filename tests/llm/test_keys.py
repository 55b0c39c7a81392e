"""Keys go through Python exactly: whole numbers beyond 2^53 beside nulls, and strings."""

import pytest

from lectern.llm import alignment, encode, leaks, lookalikes, pages, sentences
from lectern.llm.encode import BYTE_BPE_50K

BIG = 2**60 + 1


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_keys(spark, kind):
    rows = [(BIG, "A bell rang. The dog ran.", "钟响了。"), (None, "x y", None), (None, None, "丙"), (3, "", "丁")]
    df = spark.createDataFrame(rows, "id bigint, t string, z string").coalesce(1)
    df = df.withColumn("id", df.id.cast(kind))
    big = BIG if kind == "bigint" else str(BIG)
    items = spark.createDataFrame([(BIG, "a bell rang the")], "i bigint, t string")
    outs = [
        pages.label_pages(df, "id", "t"), sentences.split_sentences(df, "id", "t"), lookalikes.consistent_forms(df, "id", "t"),
        leaks.find_leaks(df, "id", "t", items, "i", "t", words=3),
    ]
    try:
        open(BYTE_BPE_50K).close()
        outs.append(encode.encode(df, "id", "t"))
    except OSError:
        pass
    for out in outs:
        assert dict(out.dtypes)["id"] == kind
        assert big in {r.id for r in out.collect()}
    assert {r.i for r in outs[3].collect()} == {BIG}
    assert dict(alignment.align(df, "id", "t", "z").dtypes)["id"] == kind
