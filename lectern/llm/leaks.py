"""Test items that stand in documents, whole or in part.

An item is a row of overlapping windows of ``words`` words (``letters`` characters where it is written in ideographs),
compared by skeleton: letters, ideographs and digits without case, spacing, punctuation and look-alikes. A window may
be missed by up to ``budget`` edits. It is split into budget + 1 pieces, of which one must then stand unchanged in the
document (pigeonhole). The documents are read once: the hash of each stretch of characters is looked up in a bitmap of
the hashes that pieces begin with, whose size is bounded, and what passes is joined with the pieces. Each hit is verified
by Myers' bit-parallel distance of the window to the text around the hit, begun and ended at word borders.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import key, keyed, spread
from lectern.llm.forms import invisible, is_han, skeleton
from lectern.tables import materialise

#: Lengths of the stretches that are hashed; a piece goes by the longest that it can fill.
STRETCHES = (24, 12, 6, 3, 1)
#: The bitmap has 1024 bits for each distinct hash, up to 2 ** MOST_BITS (64 MB); a fuller one lets more pass to the join.
MOST_BITS = 29
#: Characters that are hashed at a time.
BLOCK_CHARS = 1 << 21
BORDER = "\x00"
_BASE = 0x9E3779B97F4A7C15 | 1


class _Marked(dict):
    """What a character leaves: its skeleton, BORDER for what parts words, or nothing."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = skeleton(c) or (BORDER if unicodedata.category(c)[0] in "ZPSC" and not invisible(c) else "")
        self[code] = out
        return out


_MARKED = _Marked()


def marked(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text's skeleton, and for each place before, between and after them whether words part there."""
    codes = np.frombuffer(unicodedata.normalize("NFC", text).translate(_MARKED).encode("utf-32-le", "surrogatepass"), np.uint32)
    on = codes != 0
    parted = np.zeros(int(on.sum()) + 1, bool)
    parted[np.append(0, np.cumsum(on))[:-1][~on]] = True
    parted[[0, -1]] = True
    return codes[on], parted


def units(text: str) -> list[str]:
    """The words of an item as skeletons; its single characters if most of it is ideographs."""
    s = skeleton(text)
    if sum(map(is_han, s)) * 2 > len(s):
        return list(s)
    return [w for w in map(skeleton, text.split()) if w]


def windows(text: str, words: int, letters: int) -> tuple[bool, list[list[str]]]:
    """Whether an item is taken by words, and each stretch of ``words`` words (or ``letters`` characters) of it."""
    parts = units(text)
    single = bool(parts) and all(len(p) == 1 for p in parts) and sum(map(is_han, parts)) * 2 > len(parts)
    n = letters if single else words
    return not single, [parts[i : i + n] for i in range(len(parts) - n + 1)]


def pieces(window: list[str], budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of a window with their offsets, cut between units, as even as can be."""
    n, out, at = len(window), [], 0
    for k in range(budget + 1):
        piece = "".join(window[n * k // (budget + 1) : n * (k + 1) // (budget + 1)])
        if piece:
            out.append((at, piece))
        at += len(piece)
    return out


def myers(pattern: str, text: str) -> list[int]:
    """Edit distance of ``pattern`` to each beginning of ``text``, the empty one first."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    out = [m]
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full  # the match begins where the text does
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        out.append(score)
    return out


def distance(window: str, text: str, parted: str, at: int, budget: int) -> int:
    """Least distance of the window to a part of ``text`` that begins about ``at``; begin and end must be places that
    ``parted`` marks with 1. ``budget`` + 1 if it is more than the budget."""
    best = budget + 1
    for begin in sorted(range(max(0, at - budget), min(len(text), at + budget) + 1), key=lambda x: abs(x - at)):
        if parted[begin] == "1":
            found = myers(window, text[begin : begin + len(window) + budget])
            for n in range(max(0, len(window) - budget), len(found)):
                if found[n] < best and parted[begin + n] == "1":
                    best = found[n]
        if best == 0:
            break
    return best


def stretch(length: int) -> int:
    return next(g for g in STRETCHES if g <= length)


def hashes(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of some STRETCHES, a hash of each stretch of so many code points: a polynomial, its bits mixed. Those of
    longer stretches are put together from those of shorter ones."""
    with np.errstate(over="ignore"):
        h, length = codes.astype(np.uint64), 1
        for size in STRETCHES[::-1]:
            step, power = length, np.uint64(pow(_BASE, length, 1 << 64))
            whole = h
            while length < size:
                whole = whole[: max(0, len(whole) - step)] * power + h[length : length + max(0, len(whole) - step)]
                length += step
            h = whole
            if size in sizes:
                out = h
                for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
                    out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
                yield size, out ^ (out >> np.uint64(33)) ^ np.uint64(size)
            if size == max(sizes):
                return


def bitmap(asked: DataFrame) -> tuple[int, np.ndarray]:
    """Bits (their number as a power of two, and the bytes) that are set for the distinct values of ``hash``."""
    n = asked.count()
    bits = min(MOST_BITS, max(16, (1024 * n).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    rows = asked.select(F.shiftrightunsigned(place, 16).alias("chunk"), place.bitwiseAND(0xFFFF).alias("bit"))
    chunks = rows.groupBy("chunk").agg(F.collect_set("bit").alias("bits")).toArrow()  # at most 2 ** (bits - 16) rows
    out = np.zeros(1 << bits, bool)
    for chunk, places in zip(chunks["chunk"].to_pylist(), chunks["bits"]):
        out[(chunk << 16) + places.values.to_numpy()] = True
    return bits, np.packbits(out)


def scan(text: str, sizes: list[int], bits: int, seen: np.ndarray, reach: int) -> Iterator[tuple[int, str, str, int]]:
    """(hash, text around, borders there, place in it) of each stretch whose hash the bitmap has, like ones once."""
    codes, parted = marked(text)
    found, marks = set(), None
    for start in range(0, len(codes) if sizes else 0, BLOCK_CHARS):
        for size, h in hashes(codes[start : start + BLOCK_CHARS + max(sizes) - 1], sizes):
            h = h[:BLOCK_CHARS]
            place = h >> np.uint64(64 - bits)
            hit = np.flatnonzero(seen[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8)) & 1)
            if len(hit) and marks is None:
                marks = (parted + np.uint8(48)).tobytes().decode()
            for at, value in zip((hit + start).tolist(), h[hit].view(np.int64).tolist()):
                a, b = max(0, at - reach), min(len(codes), at + reach)
                row = (value, codes[a:b].tobytes().decode("utf-32-le", "surrogatepass"), marks[a : b + 1], at - a)
                if row not in found:
                    found.add(row)
                    yield row


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 12, letters: int = 24, budget: int = 1) -> DataFrame:
    """(doc_id, item_id, distance): documents that hold a window of an item within ``budget`` edits.

    ``distance`` is the least over the item's windows. Windows of words begin and end where words of the document do;
    hyphens and other marks part words as spaces do. Null, empty and blank texts hold nothing; items that are null or
    shorter than a window are held by nothing. A document appears once per item it holds, however often it does and
    however often its row is repeated. An empty table gives none; further columns are not read. The documents are passed
    once, however many items there are; what goes to every executor is a bitmap of at most 64 MB.
    """
    spark = docs.sparkSession
    item_kind = items.schema[item_id].dataType.simpleString()
    wanted = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).where("item is not null and length(t) > 0").distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, t in zip(batch["item"], batch["t"]):
                by_word, all_windows = windows(t, words, letters)
                for w in all_windows:
                    whole = "".join(w)
                    for offset, piece in pieces(w, budget):
                        size = stretch(len(piece))
                        first = np.frombuffer(piece[:size].encode("utf-32-le", "surrogatepass"), np.uint32)
                        rows.append((next(hashes(first, [size]))[1].view(np.int64)[0], size, item, whole, offset, len(piece), by_word))
            yield pd.DataFrame(rows, columns=["hash", "size", "item", "window", "offset", "length", "by_word"])

    asked = materialise(wanted.mapInPandas(cut, f"hash bigint, size int, item {item_kind}, window string, offset int, length int, by_word boolean").distinct(), "pieces")
    sizes = sorted(r[0] for r in asked.select("size").distinct().collect())  # at most four
    reach = (asked.agg(F.max(F.length("window"))).first()[0] or 0) + 2 * budget
    held = spark.sparkContext.broadcast(bitmap(asked.select("hash").distinct()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                rows += [(doc, *x) for x in scan(t, sizes, bits, seen, reach)]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc", "hash", "around", "parted", "at"])

    rows = spread(docs.select(key(docs, doc_id, "doc"), F.col(text).alias("text")).where("length(text) > 0"))
    hits = rows.mapInArrow(look, "doc string, hash bigint, around string, parted string, at int").join(asked.drop("size"), "hash")
    # the piece itself must stand there
    hits = hits.where("substring(around, at + 1, length) = substring(window, offset + 1, length)").drop("hash", "length")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best: dict[tuple, int] = {}
            for doc, around, parted, at, item, window, offset, by_word in batch.itertuples(index=False):
                least = best.get((doc, item), budget + 1)
                if least:
                    d = distance(window, around, parted if by_word else "1" * len(parted), at - offset, budget)
                    if d < least:
                        best[doc, item] = d
            yield pd.DataFrame([(*k, d) for k, d in best.items()], columns=["doc", "item", "distance"])

    hits = hits.select("doc", "around", "parted", "at", "item", "window", "offset", "by_word")
    out = hits.mapInPandas(verify, f"doc string, item {item_kind}, distance int").groupBy("doc", "item").agg(F.min("distance").alias("distance"))
    return keyed(out.withColumnRenamed("item", item_id), docs, doc_id, "doc")
