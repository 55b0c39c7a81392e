"""Margin lines and divided words of scanned pages: traits of neighbouring lines, and the classifiers over them."""

from __future__ import annotations

import random
import re

import numpy as np

from lectern.llm.boost import Boost
from lectern.llm.forms import LOOKALIKES, fold, is_han, skeleton

TEXT, HEADER, NUMBER = 0, 1, 2
#: A line that is a number and ornament: digits, perhaps misread as letters, or a Roman numeral.
ROMAN = "(?=[ivxlcdm])m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
NUMERIC = re.compile(rf"^(?:page|p\.|pp\.|seite|pág\.|第)?\s*[-–—~·•*\[(|<]*\s*(?:第\s*)?(?:[\dOolI]+|{ROMAN})(?:\s*/\s*\d+)?\s*(?:页)?(?:\s*共\s*[\dOolI]+\s*页)?\s*[-–—~·•*\])|>]*$", re.I)
CHAPTER = re.compile(r"^chapter\s+\w+\b|\b(?:ch\.|chapter)\s*\w+\s*$|(?:^|[\s·|])第\s*\S{1,4}\s*章(?:$|[\s·|])", re.I)
SIGN = re.compile(r"(\S*[^\W\d_])([-‐‑­¬])[ \t]*$")
FINAL = ".!?。！？…”’」』\"')）"


def title_key(line: str) -> str:
    """What identifies a title: letters without digits, chapter words and case."""
    line = re.sub(r"\b(?:ch\.|chapter)\s*\S+\s*$|^chapter\s+\w+|第\s*\S{1,4}\s*章", "", line.strip(), flags=re.I)
    return re.sub(r"\d", "", skeleton(line))


def alike(a: str, b: str) -> float:
    """Share of common pairs of characters (Dice), or of equal places where the lengths are equal, if that is more."""
    if not a or not b or not 0.6 < len(a) / len(b) < 1.7:
        return 0.0
    places = sum(map(str.__eq__, a, b)) / len(a) if len(a) == len(b) else 0.0
    x, y = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return max(places, 2 * len(x & y) / max(1, len(x) + len(y)))


class Page:
    """Raw lines of one text with what is known of its book."""

    def __init__(self, text: str, titles: list[str], repeats: dict[str, tuple[int, int]]) -> None:
        self.raw = text.split("\n")
        self.lines = [fold(x.replace("­", "¬")).strip() for x in self.raw]
        self.titles = [title_key(t) for t in titles if t]
        self.repeats = repeats
        self.numeric = [bool(x and NUMERIC.match("".join(LOOKALIKES.get(c, c) for c in x))) for x in self.lines]
        self.sizes = [len(x) for x in self.lines if x]
        self.typical = float(np.median(self.sizes)) if self.sizes else 1.0

    def near(self, i: int, step: int) -> int:
        i += step
        while 0 <= i < len(self.lines) and not self.lines[i]:
            i += step
        return i if 0 <= i < len(self.lines) else -1

    def traits(self, i: int) -> list[float]:
        """Of the line and the pairs it makes with its neighbours."""
        s = self.lines[i]
        key = title_key(s)
        before, after = self.near(i, -1), self.near(i, 1)
        p, n = (self.lines[k] if k >= 0 else "" for k in (before, after))
        letters = [c for c in s if c.isalpha()]
        words = re.findall(r"[^\W\d_]+", s)
        spaced = sum(len(w) == 1 for w in words) / max(1, len(words)) if len(words) > 3 else 0.0
        same = max([alike(key, t) for t in self.titles], default=0.0)
        return [
            len(letters),
            float(self.numeric[i]),
            float(s.isdigit()),
            same,
            *np.log1p(self.repeats.get(key, (0, 0))),
            float(bool(CHAPTER.search(s))),
            float(s[-1:] in FINAL),
            sum(c.isupper() for c in letters) / max(1, len(letters)),
            sum(w[0].isupper() for w in words) / max(1, len(words)),
            spaced,
            len(s) / max(1.0, self.typical),
            float(p[-1:] in ":："),
            float(p[-1:] in FINAL) if p else 2.0,
            float(bool(SIGN.search(p))),
            float(n[:1].islower() or n[:1] in ",;，。"),
            float(before >= 0 and self.numeric[before]),
            float(after >= 0 and self.numeric[after]),
            float(before < 0),
            float(after < 0),
            float(s[:1] in "【[《" and s[-1:] in "】]》"),
            float(bool(re.match(r"^\d+\s|.*\s\d+$", s))),
            float(any(map(is_han, s))),
        ]


def kinds_of(pages: list[Page], model: tuple[Boost, Boost]) -> list[list[int]]:
    """TEXT, HEADER or NUMBER of each line of each page; blank lines count as text."""
    shown = [(p, i) for p in pages for i, s in enumerate(p.lines) if s]
    out = {id(p): [TEXT] * len(p.lines) for p in pages}
    if shown:
        x = np.array([p.traits(i) for p, i in shown])
        number, header = (m.predict(x) > 0.5 for m in model)
        for k, (p, i) in enumerate(shown):
            if p.numeric[i]:
                out[id(p)][i] = NUMBER if number[k] else TEXT
            elif header[k]:
                out[id(p)][i] = HEADER
    return [out[id(p)] for p in pages]


def ornaments(r: random.Random, han: bool) -> str:
    n = str(r.randrange(1, 520))
    if r.random() < 0.05:
        n = n.replace("1", "l").replace("0", "O")
    forms = ["{}", "第{}页", "第 {} 页 共 512 页", "· {} ·", "－{}－"] if han else ["{}", "[{}]", "Page {}", "{} / 512", "~ {} ~", "- {} -", "p. {}"]
    return r.choice(forms).format(n)


def heads(r: random.Random, title: str, han: bool) -> str:
    """A running head: title, chapter and number in some order, now and then with a letter misread."""
    n, c = str(r.randrange(1, 520)), r.randrange(1, 40)
    chapter = f"第{c}章" if han else r.choice([f"CHAPTER {c}", f"Chapter {c}", f"ch. {c}"])
    if r.random() < 0.15:
        return chapter
    t = title if han else r.choice([title.title(), title.upper()])
    if r.random() < 0.4 and t:
        k = r.randrange(len(t))
        t = t[:k] + r.choice("旳倍赂般囤" if han else "ecl1iibhCF5") + t[k + 1 :]
    if han and r.random() < 0.3:
        t = r.choice(["【{}】", "《{}》", "[{}]"]).format(t)
    elif not han and r.random() < 0.2:
        t = " ".join(t)
    more = r.choice([[], [], [n], [chapter], [chapter, n]])
    out = [t, *more]
    r.shuffle(out)
    return r.choice(["　", " · ", "  ", " | "] if han else ["    ", " · ", ", ", " | ", " - "]).join(out)


def wrap(r: random.Random, text: str, han: bool) -> list[str]:
    """Lines of a page, broken anywhere between characters or at spaces."""
    width, out = r.randrange(18, 40) if han else r.randrange(34, 64), []
    for part in text.split("\n"):
        part = part.strip()
        while len(part) > width:
            at = width if han else part.rfind(" ", 1, width + 1)
            at = at if at > 0 else width
            out.append(part[:at].strip())
            part = part[at:].strip()
        if part:
            out.append(part)
    return out


def train(sample: list[tuple[str, str]], titles: list[str], seed: int = 7) -> tuple[Boost, Boost]:
    """Classifiers for numbers and headers, from clean texts (text, title of its book) set as pages with margin lines
    put in at known places, beside numbers that belong to the text."""
    r = random.Random(seed)
    rows, kinds = [], []
    for text, title in sample:
        han = sum(map(is_han, text[:60])) > 15
        page = [(x, TEXT) for x in wrap(r, fold(text), han)]
        if not page:
            continue
        if r.random() < 0.3:  # a number of the text, on a line of its own after a colon
            at = r.randrange(len(page) + 1)
            words = text.split()
            lead = "".join(r.choice(text) for _ in range(r.randrange(4, 14))).strip() + "：" if han else " ".join(r.choice(words) for _ in range(r.randrange(3, 9))) + ":"
            page[at:at] = [(lead, TEXT), (str(r.randrange(2, 999)), TEXT)]
        title = title or r.choice(titles)
        margin = [(ornaments(r, han), NUMBER)] if r.random() < 0.8 else []
        if r.random() < 0.7:
            margin.insert(r.randrange(len(margin) + 1), (heads(r, title, han), HEADER))
        if r.random() < 0.3:
            margin.insert(r.randrange(len(margin) + 1), ("", TEXT))
        at = r.choice([0, len(page), r.randrange(len(page) + 1), r.randrange(len(page) + 1)])
        if 0 < at < len(page) and page[at - 1][0][-1:] in ":：":
            at -= 1
        page[at:at] = margin
        known = r.random()
        often = lambda *n: (lambda a, b: (a, max(a, b)))(r.choice([1, *n]), r.choice([2, *n]))
        repeats = {title_key(x): often(2, 3, 5, 9, 40) for x, k in margin if k == HEADER} if known < 0.65 else {}
        for x, k in page:  # lines of the text may recur in a book as well
            if k == TEXT and x and (x[-1] in ":：" and r.random() < 0.7 or r.random() < 0.08):
                repeats[title_key(x)] = often(1, 2, 3, 6, 20)
        p = Page("\n".join(x for x, _ in page), [title] if known > 0.2 else [], repeats)
        for i, (x, k) in enumerate(page):
            if x:
                rows.append(p.traits(i))
                kinds.append((k, p.numeric[i]))
    x, k = np.array(rows), np.array([a for a, _ in kinds])
    numeric = np.array([b for _, b in kinds], bool)
    if not len(x):
        return Boost().fit(np.zeros((0, 1)), np.zeros(0)), Boost().fit(np.zeros((0, 1)), np.zeros(0))
    return Boost().fit(x[numeric], k[numeric] == NUMBER), Boost().fit(x[~numeric], k[~numeric] == HEADER)


def splits(page: Page, kinds: list[int]) -> list[tuple[int, int, str, str, str]]:
    """Places where a line of text ends with a dividing sign: (line, next line of text, left part, sign, right part)."""
    out = []
    text = [i for i, s in enumerate(page.lines) if s and kinds[i] == TEXT]
    for a, b in zip(text, text[1:]):
        m = SIGN.search(page.lines[a])
        n = re.match(r"[^\W_](?:[\w!'’-]*[^\W_])?", page.lines[b])
        if m and n:
            left = re.search(r"[\w!'’-]+$", m[1])
            out.append((a, b, left[0], m[2], n[0]))
    return out


def running(page: Page, kinds: list[int], joined: set[int]) -> list[list[tuple[str, int]]]:
    """Paragraphs of the text as (character, line), without margin lines and dividing signs. ``joined``: lines at whose
    end a word is divided. A blank line beside a margin line is a page break, else it ends a paragraph."""
    out: list[list[tuple[str, int]]] = [[]]
    gap = margin = False
    last = -1
    for i, s in enumerate(page.lines):
        if not s:
            gap = True
            continue
        if kinds[i] != TEXT:
            margin = True
            continue
        cur = out[-1]
        if cur:
            end = cur[-1][0]
            if gap and not (margin and end not in FINAL):
                out.append([])
            elif last in joined:
                while cur and not (cur[-1][0].isalnum()):
                    cur.pop()
            elif not (is_han(end) or is_han(s[0]) or end in "，。！？；：、“”「」（）·—…" or s[0] in "，。！？；：、“”「」（）·—…") and not (SIGN.search(page.lines[last]) and last not in joined) and s[0] != "-":
                cur.append((" ", i))
        out[-1].extend((c, i) for c in s)
        gap, margin, last = False, False, i
    return [p for p in out if p]

