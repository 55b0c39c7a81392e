"""Byte-level BPE ids of whole texts.

Texts are cut into pieces by the tokenizer's pattern; the distinct new pieces of an Arrow batch are put into buckets of
like byte length, each bucket a padded matrix of token ids. In each round every row merges the leftmost pair of least
rank: its place is an argmin, the row loses one cell by compaction, and only the two pairs beside the merge are looked
up again, in an open-addressed hash table of pairs. Rows without a mergeable pair leave the matrix.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import key, keyed, spread

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern by which byte-level tokenizers of this family cut texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
#: Pieces of more bytes go row by row, all places of the least rank at a time, if the tokenizer's merges allow it.
LONGEST_BUCKET = 512
#: Cells of a matrix, and pieces a worker remembers; both bound memory only.
CELLS, REMEMBERED = 1 << 20, 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """(left, right) -> rank and merged id, by multiplicative hashing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.merged = np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        key = (left.astype(np.int64) << 32) | right
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = key[won], rank[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + (self.keys[slot[todo]] != -1)) & (size - 1)
        self.mask = size - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or of an empty cell (rank NONE) where there is no such pair."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(key)
        while True:
            there = self.keys[slot]
            on = (there != key) & (there != -1)
            if not on.any():
                return slot
            slot[on] = (slot[on] + 1) & self.mask


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte[b] = vocab[letter]
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        ids = lambda tokens: np.array([vocab[t] for t in tokens], np.int32)
        left, right, merged = ids(a for a, _ in merges), ids(b for _, b in merges), ids(a + b for a, b in merges)
        rank = np.arange(len(merges), dtype=np.int32)
        self.pairs = PairTable(left, right, rank, merged)
        # whether each pair ranks behind all merges that make one of its parts: only then may all places of a rank merge at once
        made = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(made, merged, rank)
        self.ordered = bool((made[left] < rank).all() and (made[right] < rank).all())
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, np.ndarray] = {}

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        """Rank of each cell with its right neighbour; NONE in the last column and beside padding (-1)."""
        out = np.full(ids.shape, NONE, np.int32)
        if ids.shape[1] > 1:
            left, right = ids[:, :-1], ids[:, 1:]
            out[:, :-1] = np.where(right >= 0, self.pairs.rank[self.pairs.slots(left.ravel(), right.ravel())].reshape(left.shape), NONE)
        return out

    def matrix(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of byte strings of like length."""
        width = max(map(len, rows))
        ids = np.full((len(rows), width), -1, np.int32)
        for i, r in enumerate(rows):
            ids[i, : len(r)] = self.byte[np.frombuffer(r, np.uint8)]
        rank, out, who = self.ranks(ids), [None] * len(rows), np.arange(len(rows))
        while len(who):
            at = rank.argmin(1)
            line = np.arange(len(who))
            live = rank[line, at] != NONE
            if not live.all():
                for i in np.flatnonzero(~live):
                    out[who[i]] = ids[i][ids[i] >= 0]
                ids, rank, who, at = ids[live], rank[live], who[live], at[live]
                if not len(who):
                    break
                line = np.arange(len(who))
            ids[line, at] = self.pairs.merged[self.pairs.slots(ids[line, at], ids[line, at + 1])]
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            shape = (len(who), ids.shape[1] - 1)
            # the merged cell keeps its place: its rank is found anew, as is that of the cell to its left
            ids, rank = ids[keep].reshape(shape), rank[keep].reshape(shape)
            for place in (at, at - 1):
                ok = (place >= 0) & (place + 1 < shape[1])
                right = ids[line[ok], place[ok] + 1]
                found = self.pairs.rank[self.pairs.slots(ids[line[ok], place[ok]], right)]
                rank[line[ok], place[ok]] = np.where(right >= 0, found, NONE)
            end = at + 1 >= shape[1]
            rank[line[end], at[end]] = NONE
        return out

    def long(self, row: bytes) -> np.ndarray:
        """Ids of one long piece. All places of the least rank merge in one round, from the left and without overlap;
        that gives the same ids, since a pair with a new token always ranks behind the pair that made the token."""
        ids = self.byte[np.frombuffer(row, np.uint8)]
        while len(ids) > 1:
            slots = self.pairs.slots(ids[:-1], ids[1:])
            rank = self.pairs.rank[slots]
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            if (at[1:] == at[:-1] + 1).any():  # runs such as aaaa: every second place of a run
                start = np.ones(len(at), bool)
                start[1:] = at[1:] != at[:-1] + 1
                run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = self.pairs.merged[slots[at[0]]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [self.cut(t) if t else [] for t in texts]
        new = {p for pieces in cut for p in pieces if p not in self.known}
        by: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) > LONGEST_BUCKET and self.ordered:
                self.known[p] = self.long(raw)
            else:
                by.setdefault(len(raw) if len(raw) < 8 else 1 << (2 * len(raw) - 1).bit_length() >> 1, []).append((p, raw))
        for width, rows in by.items():
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                for (p, _), ids in zip(rows[i : i + step], self.matrix([r for _, r in rows[i : i + step]])):
                    self.known[p] = ids
        empty = np.zeros(0, np.int32)
        return [np.concatenate([self.known[p] for p in pieces]) if pieces else empty for pieces in cut]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, id_col: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(id, ids): the ids of every text, without special tokens.

    Null and empty texts both have the empty list. Strings that name special tokens are ordinary text. Repeated rows
    give repeated rows; further columns are not read; an empty table gives none. ``path`` names a tokenizer file that
    every executor can read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "ids": encoder(path).encode([t if isinstance(t, str) else None for t in batch["text"]])})

    rows = spread(df.select(key(df, id_col, "id"), F.col(text).alias("text")))
    return keyed(rows.mapInPandas(run, "id string, ids array<int>"), df, id_col, "id")
