"""Which lines of two languages render each other.

Translation tables in both directions are estimated by expectation-maximization over all pairs of texts: tasks sum
expected counts of (token, token) pairs under soft line links, Spark adds them up and normalises, and small entries go.
A token is known by a 64-bit hash of its own, so no two share counts. A table of bounded size is held whole; beyond that
each block of texts is joined with the entries its own tokens need. Lines are then linked competitively: the best links
of a pair of texts are accepted greedily, wherever they stand; a line that is linked already takes a further partner only
if that explains words of it that are not explained yet.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import key, keyed, spread
from lectern.llm.forms import fold, is_han
from lectern.tables import discard, materialise, mounted

#: Share of the background in the probability of a token, and the least probability that a table keeps.
BACKGROUND, LEAST = 0.15, 2e-4
#: Least expected count of an entry, in either direction.
COUNT = 0.01
#: From the second round on a soft link counts if it has at least this share of the strongest link of either of its lines.
LINK = 0.05
#: Least expected count of a token pair in two texts.
ADDED = 1e-3
#: Entries of a table that is held whole at most (about 24 bytes each); a larger one is joined block by block.
ENTRIES = 8_000_000
#: A row of a table has a bitmap if at least one in so many of its places is filled.
FULL = 64
#: Tokens of the texts of one such block.
BLOCK_TOKENS = 4_000_000
#: Lines and tokens of either language that are held against each other at a time, and tokens of a part of a table.
LINES, TOKENS, PART = 256, 8192, 4096
#: Sums that a task holds before it adds them up.
PENDING = 4_000_000
#: Salt by which the entries of one token are dealt out, for tokens that stand in every line.
SALT = 8
WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*")


@lru_cache(500_000)
def number(token: str) -> int:
    """The token's hash, signed."""
    x = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


@lru_cache(100_000)
def ideograph(c: str) -> int | None:
    return number("1" + c) if is_han(c) else None


@lru_cache(100_000)
def word(w: str) -> tuple[list[int], list[int]]:
    """What ``tokens`` says of a word without ideographs."""
    low = w.lower()
    found = [number(low)]
    if w[0].isdigit():
        return found, [number("#" + re.sub(r"\D", "", w)) | 1]
    if not w[0].isupper():
        return found, []
    padded = f"^{low}$"
    return found + [number("3" + padded[i : i + 3]) for i in range(len(padded) - 2)], [number(low) & ~1]


def tokens(line: str) -> tuple[list[int], list[int]]:
    """Numbers of a folded line's tokens, and of the strings that a translation keeps (odd: numerals; even: names).

    Words are taken in lower case; a capitalised word, being perhaps a name that is spelt out in the other script, adds
    its trigrams. Ideographs are taken singly."""
    found, kept = [], set()
    for w in WORD.findall(line):
        han = [] if w.isascii() else [x for x in map(ideograph, w) if x is not None]
        if han:
            found += han
            if len(han) < len(w):
                kept.update(number(x.lower()) & ~1 for x in re.findall(r"[A-Za-zÀ-ɏ]+", w))
        else:
            a, b = word(w)
            found += a
            kept.update(b)
    return found, sorted(kept)


def lines(text: str | None) -> list[str]:
    """The lines that show something."""
    return [x for x in (text or "").split("\n") if any(not c.isspace() for c in fold(x))]


def pack(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's tokens line after line, their number in each line, and the same of its kept strings."""
    both = [tokens(x) for x in fold(text or "").split("\n") if x.strip()]
    flat = lambda k: np.array([c for x in both for c in x[k]], np.int64)
    size = lambda k: np.array([len(x[k]) for x in both], np.int32)
    return flat(0), size(0), flat(1), size(1)


class Table:
    """p(second | first) / p(second) and p(first | second) / p(first) of token pairs, sorted by the first."""

    def __init__(self, first: np.ndarray, second: np.ndarray, there: np.ndarray, back: np.ndarray) -> None:
        order = np.lexsort((second, first))
        self.first, begin = np.unique(first[order], return_index=True)
        self.at = np.append(begin, len(first))
        self.second, column = np.unique(second[order], return_inverse=True)
        self.column = column.astype(np.int32)
        self.values = np.stack([there[order], back[order]], 1).astype(np.float32)
        # rows of which much is filled have a bitmap; the rank of a bit is the place of its entry
        size = np.diff(self.at)
        rows = np.flatnonzero(size * FULL > len(self.second))
        self.mapped = np.full(len(self.first), -1, np.int64)
        self.mapped[rows] = np.arange(len(rows))
        self.bits = np.zeros((len(rows), -(-len(self.second) // 64) * 8), np.uint8)
        for k in range(0, len(rows), 256):
            some = rows[k : k + 256]
            filled = np.zeros((len(some), self.bits.shape[1] * 8), bool)
            filled[np.repeat(np.arange(len(some)), size[some]), self.column[_ranges(self.at[some], size[some])]] = True
            self.bits[k : k + 256] = np.packbits(filled, 1, "little")
        n = np.bitwise_count(self.bits.view("<u8"))
        self.rank = (np.cumsum(n, 1, np.int64) - n + self.at[rows, None]).astype(np.int32 if len(first) < 1 << 31 else np.int64)
        self.place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None}

    def save(self, folder: str) -> None:
        os.mkdir(folder)
        for name, x in self.__getstate__().items():
            if x is not None:
                np.save(f"{folder}/{name}.npy", x)

    @classmethod
    def load(cls, folder: str) -> Table:
        """A saved table. Its large arrays are mapped, so the processes of a machine share them."""
        out = cls.__new__(cls)
        out.place = None
        for x in os.scandir(folder):
            setattr(out, x.name[:-4], np.asarray(np.load(x.path, mmap_mode="r" if x.stat().st_size > 1 << 16 else None)))
        return out

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of some tokens (distinct) with some others: their places in the matrix of both, row by row, and both values."""
        if not (len(self.first) and len(first) and len(second)):
            return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)
        row = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        col = np.minimum(np.searchsorted(self.second, second), len(self.second) - 1)
        has_row, has_col = np.flatnonzero(self.first[row] == first), np.flatnonzero(self.second[col] == second)
        row, col = row[has_row], col[has_col]
        at = self.mapped[row]
        on = at >= 0
        at, line = at[on], has_row[on]
        hit = np.flatnonzero(self.bits[at].take(col >> 3, 1) & (1 << (col & 7)).astype(np.uint8) != 0)
        i = hit // max(1, len(col))
        j = hit - i * len(col)
        # where the words of the found bits are, and the bits before them
        cell = (at * self.rank.shape[1]).take(i)
        cell += (col >> 6).take(j)
        before = self.bits.view("<u8").ravel().take(cell)
        before &= ((np.uint64(1) << (col & 63).astype(np.uint64)) - np.uint64(1)).take(j)
        each = self.rank.ravel().take(cell)
        each += np.bitwise_count(before)
        flat = hit if len(line) == len(first) and len(col) == len(second) else (line * len(second)).take(i) + has_col.take(j)
        if not on.all():
            has_row, row = has_row[~on], row[~on]
            size = self.at[row + 1] - self.at[row]
            rest = _ranges(self.at[row], size)
            if self.place is None:
                self.place = np.full(len(self.second), -1, np.int32)
            self.place[col] = has_col
            j = self.place[self.column[rest]]
            self.place[col] = -1
            flat = np.append(flat, (np.repeat(has_row, size) * len(second) + j)[j >= 0])
            each = np.append(each, rest[j >= 0])
        found = self.values.view(np.int64).ravel().take(each).view(np.float32)
        return flat, found[::2], found[1::2]

    def part(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of some tokens (distinct) with some others, as dense matrices."""
        return _dense((len(first), len(second)), *self.find(first, second))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one after the other."""
    return np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


def _dense(shape: tuple[int, int], at: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    out = tuple(np.zeros(shape, np.float32) for _ in values)
    for x, v in zip(out, values):
        x.ravel()[at] = v
    return out


class Block:
    """Some lines of a text: the counts of their tokens."""

    def __init__(self, rows: slice, line: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.rows, self.size = rows, size
        self.ids, place = np.unique(ids, return_inverse=True)
        self.counts = np.bincount(line * len(self.ids) + place, minlength=len(size) * len(self.ids)).reshape(len(size), -1).astype(np.float32)
        self.shares = self.counts / size[:, None]


class Side:
    """A text as packed by ``pack``."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, kept: np.ndarray, kept_sizes: np.ndarray) -> None:
        self.n = len(sizes)
        self.ids, self.at = ids, np.append(0, np.cumsum(sizes))
        self.size = np.maximum(sizes, 1).astype(np.float32)
        self.kept, self.kept_line = kept, np.repeat(np.arange(self.n), kept_sizes)
        self.numerals = np.bincount(self.kept_line[(kept & 1) == 1], minlength=self.n).astype(np.float32)
        self.blocks, start = [], 0
        while start < self.n:
            stop = min(start + LINES, max(start + 1, int(np.searchsorted(self.at, self.at[start] + TOKENS, "right")) - 1), self.n)
            line = np.repeat(np.arange(stop - start), sizes[start:stop])
            self.blocks.append(Block(slice(start, stop), line, ids[self.at[start] : self.at[stop]], self.size[start:stop]))
            start = stop


class Pair:
    """Two texts. All that is said of their lines is the same however they are cut into blocks."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        self.at = [(x, y) for x in a.blocks for y in b.blocks]
        common, i, j = np.intersect1d(np.unique(a.kept), np.unique(b.kept), return_indices=True)
        self.shared = [(np.searchsorted(common, s.kept), s) for s in (a, b)] if len(common) else None
        self.common = common
        self.whole: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def find(self, table: Table, x: Block, y: Block, u: slice, v: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.at) > 1 or max(len(x.ids), len(y.ids)) > PART:
            return table.find(x.ids[u], y.ids[v])
        if self.whole is None:
            self.whole = table.find(x.ids, y.ids)
        return self.whole

    def kept(self, x: Block, y: Block) -> np.ndarray:
        """How far the kept strings of two lines agree: +1 for each shared one, -1/2 for each numeral that is not."""
        out = np.zeros((len(x.size), len(y.size)), np.float32)
        both = np.zeros_like(out)
        if self.shared:
            m = []
            for (place, s), block in zip(self.shared, (x, y)):
                place = np.minimum(place, len(self.common) - 1)
                on = (self.common[place] == s.kept) & (s.kept_line >= block.rows.start) & (s.kept_line < block.rows.stop)
                m.append(np.zeros((len(block.size), len(self.common)), np.float32))
                m[-1][s.kept_line[on] - block.rows.start, place[on]] = 1
            numeral = (self.common & 1).astype(np.float32)
            out, both = m[0] @ m[1].T, (m[0] * numeral) @ m[1].T
        return out - 0.5 * np.minimum(self.a.numerals[x.rows, None] - both, self.b.numerals[None, y.rows] - both)

    def scores(self, table: Table, x: Block, y: Block) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Log likelihood ratios of each second line given each first one, and the other way; with them, for each line
        and token of the other side, the ratio of the token's probability to its share, and the logarithm."""
        q1, q2 = np.zeros((len(x.size), len(y.ids)), np.float32), np.zeros((len(y.size), len(x.ids)), np.float32)
        for u, v in _parts(x, y):
            there, back = _dense((len(x.ids[u]), len(y.ids[v])), *self.find(table, x, y, u, v))
            q1[:, v] += x.shares[:, u] @ there
            q2[:, u] += y.shares[:, v] @ back.T
        r1, r2 = np.log((1 - BACKGROUND) * q1 + BACKGROUND), np.log((1 - BACKGROUND) * q2 + BACKGROUND)
        return r1 @ y.counts.T, x.counts @ r2.T, (q1, q2, r1, r2)

    def odds(self, table: Table | None, x: Block, y: Block) -> tuple[np.ndarray, tuple]:
        """Of each link between two blocks. Without a table they come from place, length and kept strings."""
        if table is None:
            i, j = np.arange(x.rows.start, x.rows.stop), np.arange(y.rows.start, y.rows.stop)
            apart = np.abs(i[:, None] / self.a.n - j[None] / self.b.n)
            longer = np.abs(np.log(x.size[:, None] / self.a.size.mean() * self.b.size.mean() / y.size[None]))
            return 2.0 * self.kept(x, y) - 25 * apart - 3 * longer, ()
        s1, s2, more = self.scores(table, x, y)
        return s1 + s2 + 2.0 * self.kept(x, y), more

    def weights(self, table: Table | None) -> Iterator[tuple[Block, Block, np.ndarray, tuple]]:
        """Soft links block by block: the product of a link's shares among those of its first and of its second line."""
        top = [np.full(s.n, -np.inf) for s in (self.a, self.b)]
        total = [np.zeros(s.n) for s in (self.a, self.b)]
        seen = []
        for x, y in self.at:
            odds, more = self.odds(table, x, y)
            for k, rows in ((0, x.rows), (1, y.rows)):
                new = np.maximum(top[k][rows], odds.max(1 - k))
                total[k][rows] = total[k][rows] * np.exp(top[k][rows] - new) + np.exp(odds - (new[:, None] if k == 0 else new[None])).sum(1 - k)
                top[k][rows] = new
            if len(self.at) == 1:
                seen.append((odds, more))
        for x, y in self.at:
            odds, more = seen.pop() if seen else self.odds(table, x, y)
            one, two = odds - top[0][x.rows, None], odds - top[1][None, y.rows]
            w = np.exp(one) / total[0][x.rows, None] * np.exp(two) / total[1][None, y.rows]
            if table is not None:
                w = np.where((one > np.log(LINK)) & (two > np.log(LINK)), w, 0)
            yield x, y, w.astype(np.float32), more

    def expected(self, table: Table | None) -> Iterator[tuple[np.ndarray, ...]]:
        """Tokens of either side, and for some pairs of them (by place) the expected counts in either direction under the
        soft links. Counts below ADDED go, once those of all blocks are added up."""
        if len(self.at) == 1 and max(map(len, (self.at[0][0].ids, self.at[0][1].ids))) <= PART:
            yield from self._expected(table, ADDED)
            return
        sums = Sums(np.unique(self.a.ids), np.unique(self.b.ids))
        for part in self._expected(table, ADDED / 1000):
            sums.add(*part)
        if sums.n:
            sums.fold()
            code, x, y = sums.parts[0]
            on = (x > ADDED) | (y > ADDED)
            yield sums.first, sums.second, *np.divmod(code[on], len(sums.second)), x[on], y[on]

    def _expected(self, table: Table | None, least: float) -> Iterator[tuple[np.ndarray, ...]]:
        for x, y, w, more in self.weights(table):
            if table is None:
                one, two = w @ y.counts, w.T @ x.counts
            else:
                one, two = (w @ y.counts) / np.maximum(more[0], 1e-9), (w.T @ x.counts) / np.maximum(more[1], 1e-9)
            for u, v in _parts(x, y):
                there, back = (x.shares[:, u].T @ one[:, v]).ravel(), (two[:, u].T @ y.shares[:, v]).ravel()
                if table is None:
                    at = np.flatnonzero((there > least) | (back > least))
                    there, back = there[at], back[at]
                else:
                    at, p, q = self.find(table, x, y, u, v)
                    there, back = p * there[at], q * back[at]
                    on = np.flatnonzero((there > least) | (back > least))
                    at, there, back = at[on], there[on], back[on]
                i = at // max(1, len(y.ids[v]))
                yield x.ids[u], y.ids[v], i, at - i * len(y.ids[v]), there, back

    def explained(self, table: Table, one: int, other: int, side: int) -> np.ndarray:
        """How far each token of line ``one`` (of side ``side``) is explained by line ``other`` of the other side."""
        s, t = (self.a, self.b) if side == 0 else (self.b, self.a)
        mine, rest = (x.ids[x.at[k] : x.at[k + 1]] for x, k in ((s, one), (t, other)))
        ids, n = np.unique(rest, return_counts=True)
        mine, place = np.unique(mine, return_inverse=True)
        q = n @ table.part(ids, mine)[0] if side else table.part(mine, ids)[1] @ n
        return np.log((1 - BACKGROUND) * q / max(1, len(rest)) + BACKGROUND)[place]

    def links(self, table: Table, least: float, gain: float) -> list[tuple[int, int, float]]:
        """Competitive linking. A candidate is a pair of lines of which one is explained by the other, token for token
        at least ``least`` on average. Candidates are taken best first; a line that has a partner takes another only if
        it thereby gains ``gain`` per token of its own, and if the new partner has none."""
        at, found, seen = [], [], ()
        for x, y in self.at:
            s1, s2, more = self.scores(table, x, y)
            kept = self.kept(x, y)
            mean1 = s1 / y.size[None] + kept / np.sqrt(y.size[None])
            mean2 = s2 / x.size[:, None] + kept / np.sqrt(x.size[:, None])
            part = np.maximum(mean1, mean2)
            i, j = np.nonzero(part > least)
            at.append(np.stack([i + x.rows.start, j + y.rows.start], 1))
            found.append(mean1[i, j] + mean2[i, j])
            if len(self.at) == 1:
                seen = more[2:]
        if not at:
            return []
        at, found = np.concatenate(at), np.concatenate(found)
        of: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        sides, out = (self.a, self.b), []

        def told(side: int, one: int, other: int) -> np.ndarray:
            if not seen:
                return self.explained(table, one, other, side)
            block, r = (self.at[0][side], seen[1 - side][other])
            return r[np.searchsorted(block.ids, sides[side].ids[sides[side].at[one] : sides[side].at[one + 1]])]

        def wins(side: int, one: int, new: int) -> bool:
            """Whether ``new`` explains tokens of a line that its partners so far do not."""
            if one not in of[side]:
                return True
            before = np.max([told(side, one, x) for x in of[side][one]], 0)
            return float(np.maximum(told(side, one, new) - before, 0).sum()) / float(sides[side].size[one]) > gain

        for k in np.lexsort((at[:, 1], at[:, 0], -found)):
            i, j = int(at[k, 0]), int(at[k, 1])
            if not (i in of[0] and j in of[1]) and wins(0, i, j) and wins(1, j, i):
                of[0].setdefault(i, []).append(j)
                of[1].setdefault(j, []).append(i)
                out.append((i, j, float(found[k])))
        return out


def _parts(x: Block, y: Block) -> Iterator[tuple[slice, slice]]:
    for u in range(0, len(x.ids), PART):
        for v in range(0, len(y.ids), PART):
            yield slice(u, u + PART), slice(v, v + PART)


SIDES = ("", "_size", "_kept", "_kept_size")
SEEN = "id string, " + ", ".join(f"{s}{c} array<{'int' if 'size' in c else 'bigint'}>" for s in "ab" for c in SIDES)
ENTRY = "a bigint, salt int, b array<bigint>, there array<float>, back array<float>"


def _read(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[str, Pair]]:
    """The pairs of some rows of SEEN, empty sides left out."""
    if isinstance(rows, pa.Table):
        rows = rows.combine_chunks().to_batches()
    for batch in rows if isinstance(rows, list) else [rows]:
        lists = {n: (batch.column(n).values.to_numpy(zero_copy_only=False), batch.column(n).offsets.to_numpy()) for n in batch.schema.names if n not in ("id", "block")}
        ids = batch.column("id").to_pylist()
        for k, i in enumerate(ids):
            sides = [[v[o[k] : o[k + 1]] for v, o in (lists[s + c] for c in SIDES)] for s in "ab"]
            if all(len(s[1]) for s in sides):
                yield i, Pair(Side(*sides[0]), Side(*sides[1]))


class Sums:
    """Expected counts of token pairs of given vocabularies, added up whenever many have come together."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second = first, second
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n, self.limit = 0, PENDING

    def add(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Counts x and y of the pairs a[i], b[j]; a and b are tokens in order."""
        code = np.searchsorted(self.first, a)[i] * len(self.second) + np.searchsorted(self.second, b)[j]
        self.parts.append((code, x, y))
        self.n += len(code)
        if self.n > self.limit:
            self.fold()
            self.limit = max(PENDING, 2 * self.n)

    def fold(self) -> None:
        code, x, y = (np.concatenate(p) for p in zip(*self.parts))
        self.parts.clear()
        code, order = _sorted(code, len(self.first) * len(self.second))
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        self.parts = [(code[new], np.add.reduceat(x[order], new), np.add.reduceat(y[order], new))]
        self.n = len(new)

    def entries(self) -> pa.RecordBatch:
        """Rows of ENTRY: the counts of a first token dealt out by the second."""
        if self.n:
            self.fold()
        code, x, y = self.parts[0] if self.n else (np.zeros(0, t) for t in (np.int64, np.float32, np.float32))
        i, j = np.divmod(code, max(1, len(self.second)))
        b = self.second[j]
        key, order = _sorted(i * SALT + b % SALT, len(self.first) * SALT)
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        i, salt = np.divmod(key[new], SALT)
        offsets = pa.array(np.append(new, len(key)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(self.first[i]), pa.array(salt.astype(np.int32)), *[pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in (b, x, y)]], ["a", "salt", "b", "there", "back"])


def _sorted(code: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``top`` in order, and their order (equal ones as they came). They may be overwritten."""
    bits = len(code).bit_length()
    if int(top).bit_length() + bits < 63:  # sorting numbers is faster than finding their order
        code <<= bits
        code |= np.arange(len(code))
        code.sort()
        order = code & ((1 << bits) - 1)
        code >>= bits
        return code, order
    order = np.argsort(code, kind="stable")
    return code[order], order


@lru_cache(1)
def _load(folder: str) -> Table:
    return Table.load(folder)


class Saved:
    """A table saved in a folder that all executors mount."""

    def __init__(self, rows: DataFrame, folder: str) -> None:
        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                got, to = pq.read_table(folder), f"{folder}/_table-{uuid.uuid4().hex}"  # another one if the task is tried again
                Table(*(got[c].to_numpy() for c in ("a", "b", "there", "back"))).save(to)
                yield pa.RecordBatch.from_pylist([{"place": to}])

        self.folder = rows.sparkSession.range(0, 1, 1, 1).mapInArrow(build, "place string").first()[0]

    @property
    def value(self) -> Table:
        return _load(self.folder)

    def destroy(self) -> None:
        """It goes with the rows."""


class Tables:
    """A table as rows (a, b, there, back). With at most ``entries`` of them each worker holds it whole: it is mapped from
    the shared folder or, if that is not mounted, broadcast."""

    def __init__(self, rows: DataFrame, entries: int) -> None:
        self.rows, self.held = rows, None
        if rows.count() <= entries:
            folder = mounted(rows)
            if folder:
                self.held = Saved(rows, folder)
            else:
                got = rows.toArrow()
                self.held = rows.sparkSession.sparkContext.broadcast(Table(*(got[c].to_numpy() for c in ("a", "b", "there", "back"))))

    def drop(self) -> None:
        if self.held is not None:
            self.held.destroy()
        discard(self.rows)


def over(seen: DataFrame, tables: Tables | None, work: Callable[[pa.RecordBatch | pa.Table, Table | None], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` over all rows of ``seen`` with the table: a whole one, or for each block of rows what its tokens need."""
    if tables is None or tables.held is not None:
        held = tables.held if tables else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield work(batch, held.value if held is not None else None)

        return seen.mapInArrow(run, schema)
    size = seen.agg(F.sum(F.size("a") + F.size("b"))).first()[0] or 0
    seen = seen.withColumn("block", F.pmod(F.xxhash64("id", "a", "b"), F.lit(1 + size // BLOCK_TOKENS)))
    need = [seen.select("block", F.explode(F.array_distinct(c)).alias(c)).distinct() for c in "ab"]
    rows = tables.rows.join(need[0], "a").join(need[1], ["block", "b"])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([work(left, Table(*(right[c].to_numpy() for c in ("a", "b", "there", "back"))))])

    return seen.groupBy("block").cogroup(rows.select(F.col("block").alias("at"), "a", "b", "there", "back").groupBy("at")).applyInArrow(block, schema)


def _expect(rows: pa.RecordBatch | pa.Table, table: Table | None) -> pa.RecordBatch:
    whole = rows.combine_chunks() if isinstance(rows, pa.Table) else pa.Table.from_batches([rows])
    sums = Sums(*(np.unique(pc.list_flatten(whole[s]).to_numpy()) for s in "ab"))
    for _, pair in _read(rows):
        for part in pair.expected(table):
            sums.add(*part)
    return sums.entries()


def estimate(seen: DataFrame, rounds: int, entries: int = ENTRIES) -> Tables:
    """The table after ``rounds`` of expectation-maximization over all rows."""
    tables = None
    for _ in range(rounds):
        found = over(seen, tables, _expect, ENTRY).repartition("a", "salt").select("a", "salt", F.inline(F.arrays_zip("b", "there", "back")))
        counts = materialise(found.groupBy("a", "salt", "b").agg(F.sum("there").cast("float").alias("there"), F.sum("back").cast("float").alias("back")).drop("salt"), "counts")
        of_a = counts.groupBy("a").agg(F.sum("there").alias("all_a"), F.sum("back").alias("n_a"))
        of_b = counts.groupBy("b").agg(F.sum("back").alias("all_b"), F.sum("there").alias("n_b"))
        n_there, n_back = counts.agg(F.sum("there"), F.sum("back")).first()
        share = lambda n, total: (F.col(n) + 1e-3) / F.lit(float(total or 1.0))
        p = counts.where((F.col("there") > COUNT) | (F.col("back") > COUNT)).join(of_a, "a").join(of_b, "b").withColumn("there", F.col("there") / F.greatest("all_a", F.lit(1e-9))).withColumn("back", F.col("back") / F.greatest("all_b", F.lit(1e-9)))
        kept = p.where((F.col("there") > LEAST) | (F.col("back") > LEAST))
        kept = kept.select("a", "b", (F.col("there") / share("n_b", n_there)).cast("float").alias("there"), (F.col("back") / share("n_a", n_back)).cast("float").alias("back"))
        before, tables = tables, Tables(materialise(kept, "table"), entries)
        discard(counts)
        if before is not None:
            before.drop()
    return tables


def align(df: DataFrame, id_col: str, first: str, second: str, rounds: int = 4, least: float = 0.85, gain: float = 0.25, entries: int = ENTRIES) -> DataFrame:
    """(id, first_no, second_no, score): the linked lines of each pair of texts, numbered from 1 without blank lines.

    Null and empty sides give no row, nor do lines without a counterpart; a line that renders several gives one row for
    each. Repeated rows count once, rows of one id with different texts one by one. Further columns are not read; an
    empty table gives none. Pairs are learnt from and linked whole; time grows with the product of the lines of a pair,
    memory with a block of them. ``entries`` says how large a table is held whole; the links are the same either way.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column("id")]
            for name in "ab":
                packed = [pack(t) for t in batch.column(name).to_pylist()]
                for k in range(4):
                    offsets = np.append(0, np.cumsum([len(x[k]) for x in packed])).astype(np.int32)
                    flat = np.concatenate([x[k] for x in packed]) if packed else np.zeros(0, np.int32 if k % 2 else np.int64)
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(out, ["id", *(s + c for s in "ab" for c in SIDES)])

    rows = spread(df.select(key(df, id_col, "id"), F.col(first).alias("a"), F.col(second).alias("b")).where("length(a) > 0 and length(b) > 0").distinct(), 1)  # each task sends a table of counts
    seen = materialise(rows.mapInArrow(read, SEEN), "lines")
    tables = estimate(seen, rounds, entries)

    def link(batch: pa.RecordBatch | pa.Table, table: Table | None) -> pa.RecordBatch:
        found = [(k, i + 1, j + 1, s) for k, pair in _read(batch) for i, j, s in pair.links(table, least, gain)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kind) for c, kind in enumerate(kinds)], ["id", "first_no", "second_no", "score"])

    return keyed(over(seen, tables, link, "id string, first_no bigint, second_no bigint, score double"), df, id_col, "id")
