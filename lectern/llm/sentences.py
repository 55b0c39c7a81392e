"""Sentence ends of texts in several languages and scripts.

A pushdown automaton reads the marks of a text: openers of quotations and brackets are pushed, their closers popped, and
final marks count only when no quotation or bracket is open. The levels of lists lie on the same stack: what an item opens
and does not close is popped where the next item begins, what was open before the list stays, and items are sentences apart. A quotation that closes with a final mark inside ends the sentence
unless a reporting clause or the rest of its sentence follows. Full stops are held against a trie of abbreviations,
initials, decimals, ordinals and list numbers. Texts without final marks are cut where their layout cuts them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import key, keyed, spread
from lectern.llm.forms import LOOKALIKES, fold_char, is_han

# Abbreviations before a name or word, before a number, and those that may also end a sentence.
TITLES = "mr mrs ms messrs dr prof capt col gen lt sgt rev hon st mt ft mme mlle sr sra srta dra don ud uds hr fr herr e.g i.e cf vs viz z.b d.h u.a ca bzw evtl डॉ प्रो श्री"
NUMBERED = "no nos nr vol vols p pp pg ch chap fig sec art bd abb kap s pág págs núm vol cap"
EITHER = "etc a.m p.m am pm bros co inc ltd corp jr usw dept ave rd blvd ph.d u.s u.k a.d b.c ac dc"
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jänner"
SPOKEN = "said asked cried answered replied shouted whispered called muttered added exclaimed continued repeated sagte rief fragte antwortete gritó dijo preguntó respondió"
HAN_SPOKEN = re.compile(r"(?:说|道|问|喊|叫|答|嚷|吼|叹|笑|念)(?:道|着)?$")
HINDI_SPOKEN = re.compile(r"कहा|पूछा|बोल|चिल्ला|पुकार|उत्तर|जवाब")
_GAP = r"(?:[^\S\n]|\x00)*(?:[^\S\n]|\n)(?:[^\S\n]|\x00)*"  # white space with one line end at most
LATIN_SPOKEN = re.compile(rf"(?:[^\W\d_][\w.'’\x00-]*{_GAP}){{1,4}}(?:" + "|".join("\x00*".join(w) for w in SPOKEN.split()) + r")\b")
#: What ends a reporting clause, a blank line at the latest.
HAN_CLAUSE = re.compile(r"[，。！？；：“「『,!?;:”」\"]|\n[^\S\n]*\n")
HINDI_CLAUSE = re.compile(r"[।.?!“]|\n[^\S\n]*\n|\Z")
WORD, INITIAL = re.compile(r"\w+"), re.compile(r"[^\W\d_]\x00*\.")
#: The start of a list item: its line end (or the text's start), indent, number or bullet.
ITEM = re.compile(r"(?:\A|\n)([^\S\n]*)(?:(\d{1,3})[.)、．](?=[ \x00]|[\u3400-\u9fff])|([-•*·–])(?=[ \x00]))")

CLOSERS = {"“": "”", "‘": "’", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "{": "}", '"': '"'}
CLOSING = set("”’»›」』)]】》〉}\"")
FINAL = set(".!?…。।॥")
MARK = re.compile("[" + re.escape("".join({*CLOSERS, *CLOSING, *FINAL})) + "\n]|(?<=[^\\s\x00])[ \x00]* [ \x00]* ")
#: A run of at least two spaces between characters that show.
WIDE = re.compile(r"(?<=[^\s\x00])([ \x00]* [ \x00]* [ \x00]*)(?=[^\s\x00])")
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


class Trie:
    """Abbreviations read backwards from their final dot."""

    def __init__(self, **kinds: str) -> None:
        self.root: dict = {}
        for kind, words in kinds.items():
            for w in words.split():
                node = self.root
                for c in reversed(w):
                    node = node.setdefault(c, {})
                node.setdefault("", set()).add(kind)

    def kinds(self, text: str, dot: int) -> set[str]:
        """Kinds of the abbreviation that ends just before ``dot``, as a whole word."""
        node, i = self.root, dot - 1
        while i >= 0:
            c = text[i].lower()
            if c == HIDDEN:
                i -= 1
                continue
            if c not in node:
                break
            node = node[c]
            i -= 1
        return node.get("", set()) if i < 0 or not (text[i].isalnum() or text[i] == ".") or is_han(text[i]) else set()


ABBREVIATIONS = Trie(title=TITLES, number=NUMBERED, either=EITHER)
#: Stands for an invisible character in the folded text, which has the length of the raw one.
HIDDEN = "\x00"


class _Chars(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        f = "\n" if c in "\n\r\x0b\x0c\x85\u2028\u2029" else " " if c == "\t" else fold_char(c)
        f = LOOKALIKES.get(f[:1], f[:1]) if f else HIDDEN
        self[code] = f
        return f


_CHARS = _Chars()


class Text:
    def __init__(self, raw: str) -> None:
        self.text = text = raw.replace("\r\n", " \n").translate(_CHARS)  # of the same length
        self.blank = {m.start(): m.end() for m in BLANK.finditer(text)}
        self.blanks = list(self.blank)
        self.items = self._items()
        self.marks = [m.span() for m in MARK.finditer(text)]
        self.closer = self._matched()
        self.closed = set(self.closer.values())

    def _items(self) -> dict[int, int]:
        """Line end before each list item -> depth of its list. Numbers must follow on each other from 1, a bullet must
        come twice, at one indent; deeper lists may lie between."""
        out: dict[int, int] = {}
        levels: list[list] = []  # indent, bullet or '', last number, place of the first item
        for m in ITEM.finditer(self.text):
            indent, bullet, n = len(m[1].replace(HIDDEN, "")), m[3] or "", int(m[2] or 0)
            while levels and levels[-1][0] > indent:
                levels.pop()
            top = levels[-1] if levels and levels[-1][0] == indent else None
            if top and top[1] == bullet and (bullet or n == top[2] + 1):
                out.setdefault(top[3], len(levels))
                out[m.start()] = len(levels)
                top[2] = n
            elif bullet or n == 1:
                if top:
                    levels.pop()
                levels.append([indent, bullet, n, m.start()])
        return out

    def _matched(self) -> dict[int, int]:
        """Place of each opener that is closed within its paragraph and list item -> place of its closer."""
        out: dict[int, int] = {}
        stack: list[int] = []  # places of openers; -depth for a level of a list
        awaited: Counter = Counter()  # how many openers on the stack each closer would close

        def pop() -> int:
            k = stack.pop()
            if k >= 0:
                awaited.subtract(CLOSERS[self.text[k]])
            return k

        for i, _ in self.marks:
            c = self.text[i]
            if i in self.blank:
                stack.clear()
                awaited.clear()
            elif i in self.items:
                depth = self.items[i]
                at = next((n for n in range(len(stack) - 1, -1, -1) if stack[n] < 0), -1)
                if at >= 0 and -stack[at] >= depth:  # the item before ends, and lists within it
                    while stack and stack[-1] != -depth and (stack[-1] >= 0 or -stack[-1] > depth):
                        pop()
                if not stack or stack[-1] != -depth:
                    stack.append(-depth)
            elif c == "’" and not (stack and stack[-1] >= 0 and self.text[stack[-1]] == "‘"):
                continue
            elif awaited[c] > 0:
                while stack[-1] < 0 or c not in CLOSERS[self.text[stack[-1]]]:
                    pop()
                out[pop()] = i
            elif c in CLOSERS:
                stack.append(i)
                awaited.update(CLOSERS[c])
        return out

    def shown(self, i: int, step: int = 1) -> int:
        """The next place from ``i`` on that shows something; -1 or the length if there is none."""
        while 0 <= i < len(self.text) and (self.text[i] == HIDDEN or self.text[i].isspace()):
            i += step
        return i

    def at_break(self, i: int) -> bool:
        """Nothing, or only a blank line, follows before the next character that shows."""
        j = self.shown(i)
        k = bisect_left(self.blanks, i)
        return j >= len(self.text) or k < len(self.blanks) and self.blanks[k] < j

    def stop(self, first: int, after: int) -> bool:
        """Whether the run of marks [first, after), at no depth, ends a sentence."""
        t = self.text
        run = t[first:after].replace(HIDDEN, "")
        nxt = self.shown(after)
        if self.at_break(after):
            return True
        c = t[nxt]
        if c in ",;:，；：、" or c in CLOSING and c != '"':
            return False
        if "。" in run or "।" in run or "॥" in run:
            return True
        if "!" in run or "?" in run:
            return not c.islower()
        if run != ".":  # an ellipsis
            return not (c.islower() or is_han(c) or c.isdigit())
        before = self.shown(first - 1, -1)
        b = t[before] if before >= 0 else " "
        touching = nxt == after
        if c.islower() or touching and (c.isalnum() and not is_han(c) or c in "/@-_"):
            return False
        start = first
        while start > 0 and (t[start - 1].isalnum() or t[start - 1] == HIDDEN) and not is_han(t[start - 1]):
            start -= 1
        word = t[start:first].replace(HIDDEN, "")
        if b.isdigit():
            line = start - 1
            while line >= 0 and t[line] in (" ", HIDDEN):
                line -= 1
            if (line < 0 or t[line] == "\n") and word.isdigit():
                return False  # a list number
            return not (word.isdigit() and (m := WORD.match(t, nxt)) and m[0].lower() in MONTHS.split())
        kinds = ABBREVIATIONS.kinds(t, first)
        if "either" in kinds:
            return c.isupper() or c in CLOSERS
        if "title" in kinds or "number" in kinds and (c.isdigit() or c in "IVXLC"):
            return False
        if len(word) == 1 and word.isalpha() and not is_han(word):  # an initial, or a part of z. B.
            return not (word.isupper() or INITIAL.match(t, nxt))
        return True

    def ends_after_quote(self, start: int, opened: int, closed: int) -> bool:
        """Whether a sentence from ``start`` ends with the span (opened, closed) whose text closes with a final mark."""
        t = self.text
        if self.at_break(closed + 1):
            return True
        nxt = self.shown(closed + 1)
        c = t[nxt]
        if c in ",;:，；：、—" or c in FINAL or c.islower() or c in CLOSING and c != '"':
            return False
        before = self.shown(opened - 1, -1)
        if before >= start:
            if t[opened] in "([{":
                return False
            return t[before] in "：:，,、" if is_han(c) or is_han(t[before]) else True
        m = HAN_CLAUSE.search(t, nxt)
        clause = t[nxt : m.start() if m else len(t)]
        if any(map(is_han, clause)):
            return not (m and m[0] not in "：:“「『\"" and HAN_SPOKEN.search(re.sub(r"[\s\x00]", "", clause)))
        if "ऀ" <= c <= "ॿ":
            return not HINDI_SPOKEN.search(t[nxt : HINDI_CLAUSE.search(t, nxt).start()].replace(HIDDEN, ""))
        return not LATIN_SPOKEN.match(t, nxt)

    def ends(self) -> list[int]:
        """Ends by marks; where the layout separates sentences, by marks and layout."""
        out, plain = self._run({})
        last = self.shown(len(self.text) - 1, -1)
        while last >= 0 and (self.text[last] in CLOSING or self.text[last] == HIDDEN or self.text[last].isspace()):
            last -= 1
        wide = {m.start(1): m.end() for m in WIDE.finditer(self.text)}
        lines = {m.start(): m.end() for m in re.finditer("\n", self.text)}
        if plain and last >= 0 and self.text[last] in FINAL and not (wide and is_han(self.text[last - 1])):
            return out
        return self._run(wide or lines)[0] if wide or lines else out

    def _run(self, breaks: dict[int, int]) -> tuple[list[int], bool]:
        """The ends, and whether a final mark outside quotations set one. ``breaks``: what separates besides marks."""
        out: list[int] = []
        t, opened, start, k = self.text, -1, self.shown(0), 0
        stack: list[int] = []
        plain = False

        def emit(at: int) -> None:
            nonlocal start
            last = self.shown(at - 1, -1)
            if last >= start:
                out.append(last + 1)
            start = self.shown(at)

        while k < len(self.marks):
            i, _ = self.marks[k]
            k += 1
            c = t[i]
            if i in self.blank or not stack and (i in breaks or i in self.items):
                stack.clear()
                emit(i)
            elif stack and i == self.closer[stack[-1]]:
                opened = stack.pop()
                if not stack:
                    inner = i - 1
                    while inner > opened and (t[inner] == HIDDEN or t[inner].isspace() or t[inner] in CLOSING):
                        inner -= 1
                    if t[inner] in FINAL and self.ends_after_quote(start, opened, i):
                        emit(i + 1)
            elif i in self.closer:
                stack.append(i)
            elif not stack and c in FINAL:
                end = i + 1
                while end < len(t) and (t[end] in FINAL or t[end] == HIDDEN):
                    end += 1
                while end > i + 1 and t[end - 1] == HIDDEN:
                    end -= 1
                while k < len(self.marks) and self.marks[k][0] < end:
                    k += 1
                if self.stop(i, end):
                    plain = True
                    while end < len(t) and (t[end] in CLOSING and t[end] != '"' and end not in self.closed or t[end] == HIDDEN):
                        end += 1
                    emit(end)
        emit(len(t))
        return out, plain


def sentence_ends(text: str | None) -> list[int]:
    """For each sentence the number of code points up to its last visible character. Null, empty and blank: none."""
    return Text(text).ends() if text else []


def split_sentences(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, sent_no, end_pos): the sentences of each text, numbered from 1.

    Null, empty and blank texts have none. Repeated rows give repeated rows, an empty table none; further columns are
    not read. A text is read whole, in time about linear in its length.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, n, e) for i, t in zip(batch["id"], batch["text"]) for n, e in enumerate(sentence_ends(t), 1)]
            yield pd.DataFrame(found, columns=["id", "sent_no", "end_pos"])

    rows = spread(df.select(key(df, id_col, "id"), F.col(text).alias("text")).where("length(text) > 0"))
    return keyed(rows.mapInPandas(run, "id string, sent_no bigint, end_pos bigint"), df, id_col, "id")
