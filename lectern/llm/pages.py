"""Pages of keywords, links and tags rather than prose.

A page is a sequence of units: its lines, long ones cut at spaces. A hidden Markov model with the states prose, link
list, tag list and menu sees of each unit a few discrete traits (share of addresses, list separators, repetition,
sentence ends, function words ...). Its start is a table of plausible values; expectation-maximization over all pages
refines it, each step summing a fixed number of expected counts. A page is flagged if more than half of its visible
characters stand in units whose likeliest state is not prose.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import key, keyed, spread
from lectern.llm.forms import fold
from lectern.tables import materialise

STATES = ("prose", "links", "tags", "menu")
UNIT = 300
#: Frequent function words, which lists of keywords lack.
WORDS = frozenset(
    """the a an of and to in on was that it is for with had by at from his her he she they but not as be this which who if or when
    der die das und ist nicht ein eine den dem von zu mit auf im hat am el la los las de que y en un una con del por se no es
    le les des et du une dans ने का की के में से है को और था थी पर कि यह""".split()
)
PARTICLE = re.compile("[的了在是和着把也不没那这有一个就都与被从到里]")
#: With a scheme, a path, or as names that dots join without a space; the last name is of two letters or more.
ADDRESS = re.compile(r"(?:[hH][tT]{2}[pP][sS]?://|[wW]{3}\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*|(?<![\w.@-])(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+(?:[a-z]{2,}|[A-Z]{2,}|xn--[a-z0-9-]+)(?![\w.-])(?::\d+)?")
DOTTED = re.compile(r"[^\W_]\.[^\W\d_]{2}")
HAN = re.compile("[\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003fffd]+")
MARKUP = re.compile(r"<a\s|</a>|href=|\]\(|\[url", re.I)
TAG = re.compile(r"(?:^|\s)(?:#\w|tags?:)", re.I)
SPLIT = re.compile(r"[,;|/、，；•»→#]|\s[-–·]\s")
END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?:\s|$)|[。！？]|।")
PRICE = re.compile(r"(?:^|[\s|$€£¥])\d+[.,]\d\d(?:$|[\s|$€£¥])")
TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")

# Traits of a unit: name and, for each state, the first guess of the probability of each value.
TRAITS = {
    "address": ((0.97, 0.02, 0.01), (0.05, 0.25, 0.70), (0.95, 0.03, 0.02), (0.90, 0.07, 0.03)),
    "markup": ((0.995, 0.005), (0.6, 0.4), (0.99, 0.01), (0.97, 0.03)),
    "tagged": ((0.99, 0.009, 0.001), (0.97, 0.02, 0.01), (0.60, 0.10, 0.30), (0.97, 0.02, 0.01)),
    "listed": ((0.960, 0.035, 0.005), (0.90, 0.07, 0.03), (0.30, 0.15, 0.55), (0.15, 0.60, 0.25)),
    "repeats": ((0.30, 0.66, 0.035, 0.005), (0.50, 0.30, 0.15, 0.05), (0.25, 0.08, 0.17, 0.50), (0.60, 0.30, 0.07, 0.03)),
    "ends": ((0.35, 0.65), (0.93, 0.07), (0.97, 0.03), (0.90, 0.10)),
    "price": ((0.995, 0.005), (0.98, 0.02), (0.90, 0.10), (0.50, 0.50)),
    "function": ((0.2, 0.8), (0.90, 0.10), (0.95, 0.05), (0.93, 0.07)),
}
SIZES = [len(v[0]) for v in TRAITS.values()]
START = np.array([0.70, 0.10, 0.12, 0.08])
STAY = 0.88
#: What the first guess is worth in fitting: so many units of each state, and so much of its expected units; most rounds,
#: and the change at which fitting ends. The share is what keeps the states apart: with units alone, however many, the tag
#: state takes in unpunctuated speech on a corpus that is large enough.
UNITS, WEIGHT, ROUNDS, TOLERANCE = 200.0, 0.5, 6, 0.02


def units(text: str) -> list[str]:
    """Lines that show something, long ones in parts of about UNIT characters."""
    out = []
    for line in re.split("[\n\r\x0b\x0c\x85\u2028\u2029]+", fold(text)):
        line = line.strip()
        while len(line) > UNIT * 4 // 3:
            at = line.rfind(" ", UNIT // 2, UNIT) + 1 or UNIT
            out.append(line[:at].strip())
            line = line[at:].strip()
        if line:
            out.append(line)
    return out


def traits(unit: str) -> list[int]:
    """The value of each trait, in the order of TRAITS."""
    seen = visible(unit) or 1
    linked = "/" in unit or "." in unit and DOTTED.search(unit) is not None
    addresses = sum(map(len, ADDRESS.findall(unit))) / seen if linked else 0.0
    rest = ADDRESS.sub(" ", unit) if linked else unit
    tokens = TOKEN.findall(rest)
    ends = END.search(rest) is not None
    letters = "".join(tokens).casefold()
    chinese = not letters.isascii() and len(HAN.sub("", letters)) * 2 < len(letters)
    tagged = len(TAG.findall(unit)) / max(1, len(tokens)) if "#" in unit or "tag" in unit.lower() else 0.0
    listed = 0
    if not ends:
        segments = [x for x in map(str.strip, SPLIT.split(rest)) if x]
        if len(segments) >= 3:
            size = sum(len(x) / 2.5 if chinese else len(x.split()) for x in segments) / len(segments)
            listed = 0 if size > 3.5 else 1 if len(segments) < 6 else 2
    n = 3 if chinese else 5
    if len(letters) < (24 if chinese else 40):
        repeats = 0
    else:
        grams = len(letters) - n + 1
        distinct = len({letters[i : i + n] for i in range(grams)}) / grams
        repeats = 1 if distinct >= 0.75 else 2 if distinct >= 0.5 else 3
    if chinese:
        function = len(PARTICLE.findall(letters)) >= 0.05 * len(letters)
    else:
        function = bool(tokens) and sum(t.casefold() in WORDS for t in tokens) >= 0.12 * len(tokens)
    return [
        0 if not addresses else 1 if addresses < 0.25 else 2,
        int(("<" in unit or "](" in unit or "[" in unit) and MARKUP.search(unit) is not None),
        0 if not tagged else 1 if tagged < 0.3 else 2,
        listed,
        repeats,
        int(ends),
        int(PRICE.search(unit) is not None),
        int(function),
    ]


def visible(unit: str) -> int:
    return sum(map(len, unit.split()))


def codes(text: str) -> tuple[list[int], list[int]]:
    """A mixed-radix code of the traits of each unit, and its visible characters."""
    code, shown = [], []
    for u in units(text):
        c = 0
        for value, size in zip(traits(u), SIZES):
            c = c * size + value
        code.append(c)
        shown.append(visible(u))
    return code, shown


class Model:
    """Log probabilities: ``start`` (states), ``move`` (states, states), ``emit`` (states, codes)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, traits_of: list[np.ndarray]) -> None:
        self.start, self.move, self.traits = start, move, traits_of
        table = np.zeros((len(STATES), 1))
        for t in traits_of:
            table = (table[:, :, None] + np.log(t)[:, None, :]).reshape(len(STATES), -1)
        self.emit = table

    @classmethod
    def first(cls) -> Model:
        k = len(STATES)
        move = np.full((k, k), (1 - STAY) / (k - 1))
        np.fill_diagonal(move, STAY)
        return cls(START, move, [np.array(v) for v in TRAITS.values()])

    def _padded(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(r) for r in rows])
        x = np.zeros((len(rows), lengths.max()), np.int64)
        for i, r in enumerate(rows):
            x[i, : len(r)] = r
        return x, lengths

    def posterior(self, rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Per row the probabilities (units, states), and the expected moves summed over all rows."""
        x, lengths = self._padded(rows)
        n, width = x.shape
        k = len(STATES)
        e = np.exp(self.emit[:, x].transpose(1, 2, 0) - self.emit[:, x].max(0)[:, :, None])
        a, b = np.zeros((n, width, k)), np.ones((n, width, k))
        a[:, 0] = self.start * e[:, 0]
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for t in range(1, width):
            step = (a[:, t - 1] @ self.move) * e[:, t]
            a[:, t] = step / step.sum(1, keepdims=True)
        for t in range(width - 2, -1, -1):
            step = (b[:, t + 1] * e[:, t + 1]) @ self.move.T
            step /= step.sum(1, keepdims=True)
            b[:, t] = np.where((t + 1 < lengths)[:, None], step, 1.0)
        g = a * b
        g /= g.sum(2, keepdims=True)
        moves = np.zeros((k, k))
        for t in range(width - 1):
            on = t + 1 < lengths
            if on.any():
                pair = a[on, t, :, None] * self.move * (b[on, t + 1] * e[on, t + 1])[:, None, :]
                moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        return [g[i, : lengths[i]] for i in range(n)], moves

    def best(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest sequence of states of each row (Viterbi)."""
        x, lengths = self._padded(rows)
        n, width = x.shape
        move = np.log(self.move)
        score = np.log(self.start) + self.emit[:, x[:, 0]].T
        back = np.zeros((n, width, len(STATES)), np.int8)
        back[:, 0] = np.arange(len(STATES))
        for t in range(1, width):
            paths = score[:, :, None] + move
            came = paths.argmax(1)
            new = np.take_along_axis(paths, came[:, None, :], 1)[:, 0] + self.emit[:, x[:, t]].T
            on = (t < lengths)[:, None]
            back[:, t] = np.where(on, came, np.arange(len(STATES)))
            score = np.where(on, new, score)
        state = score.argmax(1)
        out = np.zeros((n, width), np.int8)
        for t in range(width - 1, -1, -1):
            out[:, t] = state
            state = back[np.arange(n), t, state]
        return [out[i, : lengths[i]] for i in range(n)]


def _by_length(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of like length, so that padding stays small."""
    size = batch["codes"].map(len)
    batch = batch[size > 0]
    for _, part in batch.groupby(np.ceil(np.log2(size[size > 0])).astype(int), sort=False):
        step = max(1, 200_000 // int(part["codes"].map(len).max()))
        for i in range(0, len(part), step):
            yield part.iloc[i : i + step]


def _radix() -> list[np.ndarray]:
    """For each trait the value that each code has."""
    c, out = np.arange(math.prod(SIZES)), []
    for size in reversed(SIZES):
        out.append(c % size)
        c //= size
    return out[::-1]


def fit(rows: DataFrame, rounds: int = ROUNDS, weight: float = WEIGHT) -> Model:
    """Expectation-maximization over all rows (codes array<int>), starting from the first guess, which counts as
    UNITS and ``weight`` times the expected number of units of each state (pages, for the start): few pages stay near it,
    many move the table by two thirds, alike at every size. Each round gathers one row of expected counts per state and
    code, a number fixed by the traits; fitting ends when no probability moves by more than TOLERANCE, or after ``rounds``."""
    first = model = Model.first()
    k, values = len(STATES), _radix()
    for _ in range(rounds):

        def expect(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            emit, moves = np.zeros((k, math.prod(SIZES))), np.zeros((k + 1, k))  # the last row: the start
            for batch in batches:
                for part in _by_length(batch):
                    g, m = model.posterior(part["codes"].tolist())
                    moves[:k] += m
                    moves[k] += sum(x[0] for x in g)
                    np.add.at(emit.T, np.concatenate(part["codes"].tolist()), np.concatenate(g))
            s, c = np.nonzero(emit)
            yield pd.DataFrame({"state": s, "code": c, "n": emit[s, c]})
            yield pd.DataFrame({"state": np.repeat(np.arange(k + 1), k), "code": -1 - np.tile(np.arange(k), k + 1), "n": moves.ravel()})

        counts = rows.select("codes").mapInPandas(expect, "state int, code int, n double").groupBy("state", "code").agg(F.sum("n").alias("n")).collect()
        emit, moves = np.zeros((k, math.prod(SIZES))), np.zeros((k + 1, k))
        for r in counts:
            if r.code < 0:
                moves[r.state, -1 - r.code] += r.n
            else:
                emit[r.state, r.code] += r.n
        share = lambda x, prior: _normal(x + (UNITS + weight * x.sum(1, keepdims=True)) * prior)
        rated = []
        for prior, value in zip(first.traits, values):
            x = np.zeros(prior.shape)
            for v in range(prior.shape[1]):
                x[:, v] = emit[:, value == v].sum(1)
            rated.append(share(x, prior))
        before, model = model, Model(share(moves[k:], first.start[None])[0], share(moves[:k], first.move), rated)
        if max(np.abs(a - b).max() for a, b in zip([before.move, *before.traits], [model.move, *model.traits])) <= TOLERANCE:
            break
    return model


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(1, keepdims=True)


def label_pages(df: DataFrame, id_col: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """(id, visible, nonprose, links, tags, menu): the visible characters of each text and how many of them stand in
    units of each kind but prose; ``nonprose`` is their share (0 where nothing is visible).

    Null, empty and blank texts have 0 visible characters. Repeated rows give repeated rows, an empty table none;
    further columns are not read. Whole texts are labelled, and the model is fitted to all of them.
    """
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [codes(t) if isinstance(t, str) else ([], []) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "codes": [b[0] for b in both], "visible": [b[1] for b in both]})

    rows = spread(df.select(key(df, id_col, "id"), F.col(text).alias("text")))
    seen = materialise(rows.mapInPandas(extract, "id string, codes array<int>, visible array<int>"), "pages")
    model = fit(seen, rounds)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            empty = batch[batch["codes"].map(len) == 0]
            yield pd.DataFrame({"id": empty["id"], "visible": 0, "nonprose": 0.0, "links": 0, "tags": 0, "menu": 0})
            for part in _by_length(batch):
                state = model.best(part["codes"].tolist())
                sums = np.array([np.bincount(s, weights=v, minlength=len(STATES)) for s, v in zip(state, part["visible"])])
                total = sums.sum(1)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "visible": total, "nonprose": 1 - sums[:, 0] / np.maximum(total, 1), "links": sums[:, 1], "tags": sums[:, 2], "menu": sums[:, 3]})

    out = seen.mapInPandas(label, "id string, visible bigint, nonprose double, links bigint, tags bigint, menu bigint")
    return keyed(out, df, id_col, "id")
