import os
import random

import pytest

from lectern.llm.encode import BYTE_BPE_50K, LONGEST_BUCKET, Encoder, encode

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE_50K), reason="no tokenizer file")

TEXTS = ["", " ", "Hello, world's  end.\n\n\tIt costs 12.50!", "<|endoftext|> is text", "第1章 绿色的蜡烛\nŚliwan在售票厅", "aaaa" * 700, "文" * 900, "क्या तनुरी ने चिट्ठी पढ़ी?", "é​﻿ x y", "🙂" * 300]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE_50K)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_against_the_library():
    r = random.Random(1)
    alphabet = "abcdefgh ehinorst \n.,'0123456789éß中文字的了çः‍🙂"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.choice([3, 20, 200]))) for _ in range(400)]
    texts += ["".join(r.choice("etaoinshr") for _ in range(n)) for n in (LONGEST_BUCKET - 1, LONGEST_BUCKET, LONGEST_BUCKET + 1, 3000)]
    assert [x.tolist() for x in Encoder(BYTE_BPE_50K).encode(texts)] == reference(texts)


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "two words", None), (3, "two words", None)]
    out = sorted((r.doc_id, list(r.ids)) for r in encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text").collect())
    want = reference(["two words"])[0]
    assert out == [(1, []), (2, []), (3, want), (3, want)]
    assert encode(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_merges_out_of_order(tmp_path):
    """A pair that ranks before the merge which makes its part: long pieces go the leftmost way, too."""
    import json

    from lectern.llm.encode import byte_letters

    vocab = {c: i for i, c in enumerate([*byte_letters(), "ab", "abc", "ba", "cab"])}
    merges = [["ab", "c"], ["b", "a"], ["a", "b"], ["c", "ab"]]
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    e = Encoder(str(path))
    assert not e.ordered and Encoder(BYTE_BPE_50K).ordered
    r = random.Random(2)

    def plain(text):
        out = list(text)
        while True:
            at = [(merges.index([x, y]), k) for k, (x, y) in enumerate(zip(out, out[1:])) if [x, y] in merges]
            if not at:
                return [vocab[x] for x in out]
            k = min(at)[1]
            out[k : k + 2] = [out[k] + out[k + 1]]

    texts = ["".join(r.choice("abc") for _ in range(n)) for n in (5, 40, LONGEST_BUCKET + 40)]
    assert [x.tolist() for x in e.encode(texts)] == [plain(t) for t in texts]
