"""Characters that look the same: folding of single characters, and skeletons for comparing."""

from __future__ import annotations

import unicodedata

# Radicals of the supplement that stand for ideographs (Unicode's equivalent unified ideographs).
RADICALS = {
    "⺁": "厂", "⺅": "亻", "⺆": "冂", "⺈": "刀", "⺉": "刂", "⺊": "卜", "⺍": "小", "⺒": "巳", "⺓": "幺", "⺔": "彑",
    "⺖": "忄", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺞": "歺", "⺠": "民", "⺡": "氵", "⺢": "氺",
    "⺣": "灬", "⺤": "爫", "⺦": "丬", "⺧": "牛", "⺨": "犭", "⺪": "疋", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糹",
    "⺰": "纟", "⺲": "罒", "⺶": "羊", "⺹": "耂", "⺺": "肀", "⺼": "肉", "⺽": "臼", "⺾": "艹", "⻁": "虎", "⻂": "衤",
    "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶",
    "⻎": "辶", "⻏": "邑", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青",
    "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨",
    "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯",
    "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀", "⻳": "龟",
}
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ё": "Ë", "Ї": "Ï",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ё": "ë", "ї": "ï",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
}


def is_han(c: str) -> bool:
    return "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\U00020000" <= c <= "\U0003fffd" or c == "\u3007"


def invisible(c: str) -> bool:
    """Format characters, variation selectors and fillers, which show nothing."""
    return unicodedata.category(c) == "Cf" or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef" or c in "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"


def fold_char(c: str) -> str:
    """One form for what differs in width, kind of space, radical or compatibility ideograph only; '' for the invisible."""
    if invisible(c):
        return ""
    if c in RADICALS:
        return RADICALS[c]
    if unicodedata.category(c) == "Zs":
        return " "
    how = unicodedata.decomposition(c)
    if how and (how[0] != "<" or how.startswith(("<wide>", "<narrow>")) or "\u2f00" <= c <= "\u2fd5" or "\ufb00" <= c <= "\ufb06"):
        return unicodedata.normalize("NFKC", c)
    return c


class _Memo(dict):
    def __init__(self, fold) -> None:
        super().__init__()
        self.fold = fold

    def __missing__(self, code: int) -> str:
        out = self[code] = self.fold(chr(code))
        return out


_FOLD = _Memo(fold_char)


def fold(text: str) -> str:
    """``text`` with every character folded, composed. Line breaks and the number of spaces stay."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_FOLD))


def _skeleton_char(c: str) -> str:
    c = unicodedata.normalize("NFKC", fold_char(c))
    c = "".join(LOOKALIKES.get(x, x) for x in c).casefold()
    return "".join(x for x in c if x.isalnum())


_SKELETON = _Memo(_skeleton_char)


def skeleton(text: str) -> str:
    """Letters, ideographs and digits only, without case, look-alike scripts mapped to Latin."""
    return unicodedata.normalize("NFC", text).translate(_SKELETON)
