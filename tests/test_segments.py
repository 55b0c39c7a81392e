import random

import pytest

from lectern.operators import segments as G
from lectern.operators.models import cut_audio, frames, transcribe


@pytest.fixture(scope="module")
def audios():
    r = random.Random(3)
    return {k: "".join("x" if r.random() < r.choice([0.2, 0.5, 0.8]) else "." for _ in range(r.randrange(1, 60))) for k in range(150)}


def pieces_of(spark, audios, needed):
    """Cuts and pieces of audios drawn as x (speech) and . (silence), a frame each."""
    df = spark.createDataFrame([(k, i, c == "x") for k, a in audios.items() for i, c in enumerate(a)], "id int, f int, s boolean")
    totals = spark.createDataFrame([(k, len(a) * 30 + k % 30) for k, a in audios.items()], "id int, total bigint")
    cuts = G.silence_cuts(df, "id", "f", "s", needed)
    return cuts, G.cut_intervals(cuts, "id", totals, "total")


@pytest.mark.parametrize(
    "drawn,needed,cuts",
    [
        ("xxxx", 2, []), ("x..x", 2, [3]), ("x.x.", 2, []), ("....", 2, [2, 4]), (".....", 2, [2, 4]), ("..x...x", 3, [6]), (".", 1, [1]), ("x", 1, []),
        ("......x..", 3, [3, 6]), ("x.", 1, [2]),
    ],
)
def test_cuts(spark, drawn, needed, cuts):
    got, _ = pieces_of(spark, {1: drawn}, needed)
    assert sorted(r.cut_frame for r in got.collect()) == cuts


def test_cuts_follow_a_full_silence(spark, audios):
    """Before each cut stand just so many silent frames, and no cut is missing: what is left between has none."""
    got: dict = {}
    for r in pieces_of(spark, audios, 3)[0].collect():
        got.setdefault(r.id, []).append(r.cut_frame)
    for k, a in audios.items():
        at = [0, *sorted(got.get(k, [])), len(a)]
        assert all(a[c - 3 : c] == "..." for c in at[1:-1])
        assert all("..." not in a[x : y - 1] for x, y in zip(at, at[1:-1])) and "..." not in a[at[-2] :]


@pytest.mark.parametrize("least", [60, 100, 300, 5000])
def test_merged_pieces(spark, audios, least):
    """They cover the audio without a gap, end only where pieces ended, are long enough but for one alone, and could not
    be more: one starts wherever a long enough piece follows a long enough stretch."""
    _, segs = pieces_of(spark, audios, 3)
    before: dict = {}
    after: dict = {}
    for out, df in ((before, segs), (after, G.merge_short(segs, "id", least))):
        for r in df.collect():
            out.setdefault(r.id, []).append((r.seg_no, r.start_ms, r.end_ms))
    assert before.keys() == after.keys() == audios.keys()
    for k, rows in after.items():
        old, new = sorted(before[k]), sorted(rows)
        for part in (old, new):
            assert [n for n, _, _ in part] == list(range(1, len(part) + 1))
            assert part[0][1] == 0 and part[-1][2] == len(audios[k]) * 30 + k % 30 and all(x[2] == y[1] for x, y in zip(part, part[1:]))
        ends = {e for _, _, e in old}
        assert all(e in ends for _, _, e in new)
        assert len(new) == 1 or all(e - s >= least for _, s, e in new)
        starts = {s for _, s, _ in new}
        assert all((s in starts) == (s == 0 or e - s >= least and s >= least) for _, s, e in old)


def test_merging_by_hand(spark):
    def merged(*lengths):
        ends = [sum(lengths[: i + 1]) for i in range(len(lengths))]
        df = spark.createDataFrame([(1, i + 1, e - n, e) for i, (n, e) in enumerate(zip(lengths, ends))], "id int, seg_no int, start_ms bigint, end_ms bigint")
        return [r.end_ms - r.start_ms for r in G.merge_short(df, "id", 10).orderBy("seg_no").collect()]

    assert merged(3) == [3] and merged(10, 10) == [10, 10] and merged(10, 9) == [19] and merged(9, 10) == [19]
    assert merged(1, 2, 3) == [6] and merged(4, 4, 4, 12) == [12, 12] and merged(12, 1, 1, 12, 9) == [14, 21] and merged(5, 5, 5, 20, 20) == [15, 20, 20]


def test_frames_needed():
    assert G.frames_needed() == 34
    with pytest.raises(ValueError):
        G.frames_needed(1000, 25)


def test_audio(spark):
    loud, quiet = b"\x00\x40" * 480, b"\x00\x00" * 480
    df = spark.createDataFrame([(1, bytearray(loud + quiet * 2 + b"\x01")), (2, None)], "id int, pcm binary")
    assert [(r.frame_no, r.is_speech) for r in frames(df, "id", "pcm").orderBy("frame_no").collect()] == [(0, True), (1, False), (2, False)]
    segs = spark.createDataFrame([(1, 1, 0, 30), (1, 2, 30, 90)], "id int, seg_no int, start_ms bigint, end_ms bigint")
    assert [(r.seg_no, len(r.pcm)) for r in cut_audio(df, "id", "pcm", segs).orderBy("seg_no").collect()] == [(1, 960), (2, 1920)]

    class Fake:
        def one(self, raw):
            if raw is None:
                raise ValueError("no audio")
            return {"text": "hi", "language": "en", "segments": [{"id": 0, "start": 0.0, "end": 1.0, "text": "hi", "words": []}]}

    got = {r.id: r for r in transcribe(df, "id", "pcm", Fake).collect()}
    assert got[1].text == "hi" and got[1].error is None and got[2].error == "ValueError: no audio"
