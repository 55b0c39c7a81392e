"""Text functions as Column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and the text layer of most languages see it, with the four information separators.
SPACE = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same without what ends a line.
BLANK = r"\t \x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
# Blocks of ideographs, marks that end a line of running text, numerals of headings.
IDEOGRAPHS = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{f900}-\x{faff}"
END_MARKS = "。！？，、；：…—?!.,;:」』）)]>”"
HEADING_NUMERALS = "一二三四五六七八九十百千0-9"
SUBTITLE_LENGTH = 30

ENGLISH_TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}_]+(?:[-.,][\p{{L}}\p{{N}}_]+)*|[^{SPACE}\p{{L}}\p{{M}}\p{{N}}_]"
CHINESE_TOKEN = rf"[{IDEOGRAPHS}]|[\p{{IsLatin}}\p{{IsCyrillic}}\p{{IsGreek}}\p{{IsDevanagari}}\p{{N}}_]+|[{SPACE}]|[^{SPACE}]"
ENGLISH_WORDS = ("the", "and", "of", "to", "in", "was", "that", "a", "for", "with", "had", "is")


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` over a struct of values that are computed once. Inside a lambda over an array an outer expression is
    computed for every element; a field of this struct is not."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), body), 1)


def trim(text: Column) -> Column:
    """Without white space at either end, Unicode white space and information separators included."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def lines(text: Column) -> Column:
    """The array of stripped lines that are not blank, split at CR LF, CR or LF."""
    return F.filter(F.transform(F.split(text, "\r\n|\r|\n"), trim), lambda x: F.length(x) > 0)


def lines_with_ends(text: Column) -> Column:
    """Lines with their terminators kept, split at every terminator that text processing knows; '' gives none."""
    return F.filter(F.split(text, r"(?<=\r\n|[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]|\r(?!\n))"), lambda x: F.length(x) > 0)


def english_tokens(text: Column) -> Column:
    """Words and single marks, case kept: an approximation of Penn Treebank tokens by one expression."""
    return F.regexp_extract_all(text, F.lit(ENGLISH_TOKEN), F.lit(0))


def chinese_tokens(text: Column) -> Column:
    """Single ideographs, words of other scripts, and every space and mark: a stand-in for a dictionary segmenter."""
    return F.regexp_extract_all(text, F.lit(CHINESE_TOKEN), F.lit(0))


def mixed_tokens(text: Column) -> Column:
    """All Chinese tokens, then all English ones, of which those without a letter or digit go; Latin words come twice."""
    both = F.concat(chinese_tokens(text), english_tokens(text))
    return F.transform(F.filter(both, lambda t: t.rlike(r"[\p{L}\p{N}_]")), trim)


#: The steps of the published Penn Treebank script, in its order: what is found, and what stands for it.
TREEBANK = (
    (r'^"', "`` "), (r'([ (\[{<])"', "$1 `` "), (r"\.\.\.", " ... "), (r"([,;:@#$%&])", " $1 "), (r"([^.])(\.)([\])}>\"']*)[ \t]*(\n|$)", "$1 $2$3 $4"),
    (r"([?!])", " $1 "), (r"([\]\[(){}<>])", " $1 "), (r"--", " -- "), (r"^|$", " "), (r'"', " '' "), (r"([^'])' ", "$1 ' "), (r"'([sSmMdD]) ", " '$1 "),
    (r"'(ll|LL|re|RE|ve|VE) ", " '$1 "), (r"(n't|N'T) ", " $1 "), (r" ([Cc])annot ", " $1an not "), (r" ([Gg])onna ", " $1on na "), (r" ([Gg])otta ", " $1ot ta "),
    (r" ([Ll])emme ", " $1em me "), (r" ([Ww])anna ", " $1an na "), (r" '([Tt])is ", " '$1 is "), (r" '([Tt])was ", " '$1 was "),
)


def treebank_tokens(text: Column) -> Column:
    """Tokens of the Penn Treebank: contractions apart (do n't), quotes told open from closed, a full stop apart at a
    line's end only. Typographic apostrophes count as plain ones."""
    out = F.regexp_replace(text, "’", "'")
    for found, put in TREEBANK:
        out = F.regexp_replace(out, found, put)
    return F.filter(F.split(out, rf"[{SPACE}]+"), lambda t: t != "")


TOKENIZERS = {"english": english_tokens, "chinese": chinese_tokens, "mixed": mixed_tokens}
#: Further ones, by name only; no language is routed to them.
MORE = {"treebank": treebank_tokens}


def detect_language(text: Column) -> Column:
    """zh, en or unknown: zh if over three tenths of the letters are ideographs, else en if at least one word in
    twelve is a common English one. Deterministic; null and empty texts are unknown."""
    han = F.length(text) - F.length(F.regexp_replace(text, f"[{IDEOGRAPHS}]", ""))
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}", ""))
    words = F.filter(F.split(F.lower(text), " "), lambda w: F.length(w) > 0)
    common = F.size(F.filter(words, lambda w: w.isin(*ENGLISH_WORDS)))
    return F.when(F.coalesce(letters, F.lit(0)) == 0, "unknown").when(han * 10 > letters * 3, "zh").when(common * 12 >= F.size(words), "en").otherwise("unknown")


def tokenizer_of(language: Column) -> Column:
    """Name of the tokenizer for a language: en, zh and its variants, anything else mixed."""
    low = F.lower(F.coalesce(language, F.lit("")))
    return F.when(low == "en", "english").when(low.startswith("zh"), "chinese").otherwise("mixed")


def tokens(text: Column, tokenizer: str | Column) -> Column:
    """Tokens by a named tokenizer, or by the one that a column names."""
    if isinstance(tokenizer, str):
        return (TOKENIZERS | MORE)[tokenizer](text)
    return F.when(tokenizer == "english", english_tokens(text)).when(tokenizer == "chinese", chinese_tokens(text)).otherwise(mixed_tokens(text))


def token_chunks(toks: Column, size: int = 300, overlap: int = 50) -> Column:
    """Overlapping stretches of tokens; a start every ``size - overlap`` tokens, so the last may lie inside the one
    before. No tokens, no chunks. An overlap that is not smaller than the size never ends and is refused."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")

    def cut(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(x["toks"]) - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(F.size(x["toks"]) > 0, F.transform(starts, lambda s: F.slice(x["toks"], s + 1, size))).otherwise(F.expr("array()").cast("array<array<string>>"))

    return let(cut, toks=toks)


def snippet(text: Column, n: int = 300) -> Column:
    """The first ``n`` characters; the dots always follow."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def undouble(line: Column, threshold: float = 0.60) -> Column:
    """A line whose ideographs are doubled, undoubled. Pairs are taken at places 0, 2, 4 ...; of those with an ideograph
    at least ``threshold`` must be one ideograph twice. Headings of the form 第N章 and single characters stay."""
    pairs = F.regexp_extract_all(line, F.lit("(?s).."), F.lit(0))
    total = F.size(F.filter(pairs, lambda p: p.rlike(f"[{IDEOGRAPHS}]")))
    double = F.size(F.filter(pairs, lambda p: p.rlike(rf"([{IDEOGRAPHS}])\1")))
    doubled = (F.length(line) > 1) & ~trim(line).rlike(r"\A第\p{Nd}+章\z") & (total > 0) & (double / total >= threshold)
    return F.when(doubled, F.regexp_replace(line, f"([{IDEOGRAPHS}])\\1", "$1")).otherwise(line)


def should_merge(line: Column) -> Column:
    """Whether a line of running text goes on in the next: it is not blank and its last visible character is no end
    mark (commas count as such)."""
    return (F.length(trim(line)) > 0) & ~trim(line).rlike("[" + "".join("\\" + c if c in "[]^-" else c for c in END_MARKS) + r"]\z")


def is_heading(line: Column) -> Column:
    """A chapter heading for re-flowing: 第, numerals, 章 at the start of the stripped line."""
    return trim(line).rlike(rf"\A第[{HEADING_NUMERALS}]+章")


def heading_number(line: Column) -> Column:
    """The digits of a heading for splitting, as a string; null if the stripped line is none."""
    found = F.regexp_extract(trim(line), rf"\A第[{SPACE}]*(\p{{Nd}}+)[{SPACE}]*章", 1)
    return F.when(found != "", found)


def join_initials(text: Column) -> Column:
    """Glue a lone letter at a line's start to the lower-case word after it (a drop cap); real words are glued, too."""
    return F.regexp_replace(text, rf"(?<=\A|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}])([A-Za-z])[{BLANK}]+([a-z])", "$1$2")


def join_ideograph_breaks(text: Column) -> Column:
    """Delete line feeds, with the white space around them, between two unified ideographs."""
    return F.regexp_replace(text, rf"(?<=[\x{{4e00}}-\x{{9fff}}])[{SPACE}]*\n[{SPACE}]*(?=[\x{{4e00}}-\x{{9fff}}])", "")


def json_span(raw: Column) -> Column:
    """From the first brace to the last one; null if there is no such span."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def chunk_number(file: Column) -> Column:
    """The number in chunk_N; null if there is none."""
    found = F.regexp_extract(file, r"chunk_(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def output_name(file: Column, suffix: str) -> Column:
    """chunk_N.wav or chunk_N.json -> chunk_N{suffix}.json."""
    return F.regexp_replace(file, r"\.(wav|json)\z", f"{suffix}.json")
