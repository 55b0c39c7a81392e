"""Queries over texts, lines, tokens and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import pipelines, search
from lectern.operators import text as T
from lectern.tables import table

TERMS = ["signal", "station", "bridge", "the", "station"]


def nonblank_lines(spark: SparkSession, root: str) -> DataFrame:
    return T.nonblank_lines(table(spark, root, "documents"), "doc_id", "text")


def find_lines(spark: SparkSession, root: str) -> DataFrame:
    return T.find_lines(table(spark, root, "documents"), "doc_id", "text", "signal")


def word_tokens(spark: SparkSession, root: str) -> DataFrame:
    toks = X.english_tokens(F.col("text"))
    return table(spark, root, "documents").select("doc_id", F.posexplode(toks).alias("pos", "token"))


def treebank_tokens(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pairs_en").where("source is not null").select("pair_id", F.array_join(X.treebank_tokens(F.col("source")), "|").alias("tokens")).distinct()


def mixed_tokens(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pairs_zh").where("zh is not null").select("pair_id", F.array_join(X.mixed_tokens(F.col("zh")), "|").alias("tokens")).distinct()


def language_route(spark: SparkSession, root: str) -> DataFrame:
    found = table(spark, root, "documents").select("doc_id", X.detect_language(F.col("text")).alias("language"))
    return found.withColumn("tokenizer", X.tokenizer_of(F.col("language")))


def language_labels(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").groupBy("lang", X.tokenizer_of(F.col("lang")).alias("tokenizer")).agg(F.count(F.lit(1)).alias("n"))


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return search.chunks(table(spark, root, "documents"), "doc_id", "text", "english")


def token_chunks(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root).select(F.col("corpus").alias("doc_id"), "chunk_id", F.size("tokens").alias("n_tokens"), X.snippet(F.col("text")).alias("snippet"))


def term_statistics(spark: SparkSession, root: str) -> DataFrame:
    index = search.Bm25Index(_chunks(spark, root), pooled=True)
    return index.idf.select("term", F.round("idf", 6).alias("idf"))


def bm25_topk_pooled(spark: SparkSession, root: str) -> DataFrame:
    top = search.Bm25Index(_chunks(spark, root), pooled=True).search(TERMS)
    return top.select("rank", F.col("corpus").alias("doc_id"), "chunk_id", F.round("score", 6).alias("score"), "text")


def bm25_topk_per_doc(spark: SparkSession, root: str) -> DataFrame:
    top = search.Bm25Index(_chunks(spark, root)).search(TERMS)
    return top.select(F.col("corpus").alias("doc_id"), "rank", "chunk_id", F.round("score", 6).alias("score"))


def bm25_topk_routed(spark: SparkSession, root: str) -> DataFrame:
    """Each text with the tokenizer of its language, chunks tokenized again after joining; a table of queries."""
    index = search.Bm25Index(search.chunks(table(spark, root, "documents"), "doc_id", "text"), pooled=True)
    asked = spark.createDataFrame([(1, "信号 station"), (2, "The bridge, the Station!"), (3, None)], "query_id int, query string")
    return index.ask(asked, "query_id", "query", 20).select("query_id", "rank", F.col("corpus").alias("doc_id"), "chunk_id", F.round("score", 6).alias("score"))


def heading_flags(spark: SparkSession, root: str) -> DataFrame:
    line = F.col("line")
    rows = T.nonblank_lines(table(spark, root, "documents"), "doc_id", "text")
    return rows.select("doc_id", "line_no", X.is_heading(line).alias("heading"), X.heading_number(line).alias("number"), X.should_merge(line).alias("goes_on"))


def cjk_pair_dedupe(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "pairs_zh").select("pair_id", "zh").distinct().select("pair_id", F.posexplode(F.split("zh", "\n")).alias("line_no", "raw"))
    return rows.select("pair_id", "line_no", X.undouble(F.col("raw")).alias("line")).where("line <> ''")


def cjk_join_breaks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pairs_zh").where("zh is not null").select("pair_id", X.join_ideograph_breaks(F.col("zh")).alias("zh")).distinct()


def leading_letters(spark: SparkSession, root: str) -> DataFrame:
    spaced = F.regexp_replace("target", r"(?m)^([A-Z])([a-z])", "$1 $2")  # as a drop cap leaves it
    return table(spark, root, "pairs_en").where("target is not null").select("pair_id", X.join_initials(spaced).alias("target")).distinct()


def chapter_number_fix(spark: SparkSession, root: str) -> DataFrame:
    broken = F.regexp_replace("text", "第([0-9]+)章", "$1\n第  章")
    rows = table(spark, root, "documents").select("doc_id", F.posexplode(F.split(broken, "\n")).alias("line_no", "line"))
    return T.fix_chapter_numbers(rows, ["doc_id"], "line_no", "line")


def split_chapters_en(spark: SparkSession, root: str) -> DataFrame:
    return T.split_chapters_en(table(spark, root, "documents"), "doc_id", "text")


def split_chapters_zh(spark: SparkSession, root: str) -> DataFrame:
    return T.split_chapters_zh(table(spark, root, "documents"), "doc_id", "text")


def reflow_lines(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").where("text is not null").select("doc_id", T.reflow(F.split("text", "\n")).alias("text"))


def ingest_chinese_books(spark: SparkSession, root: str) -> DataFrame:
    """The Chinese texts of a book as its pages, each a chapter of its own."""
    rows = table(spark, root, "pairs_zh").where("zh is not null").select("book", F.col("pair_id").alias("page_no"), "zh").distinct()
    heading = F.concat(F.lit("第"), F.col("page_no").cast("string"), F.lit("章\n"), F.col("zh"))
    rows = rows.select("book", "page_no", F.posexplode(F.split(heading, "\n")).alias("line_no", "line"))
    return pipelines.ingest_chinese_book(rows, "book")


QUERIES = {
    f.__name__: f
    for f in (
        nonblank_lines, find_lines, word_tokens, treebank_tokens, mixed_tokens, language_route, language_labels, token_chunks, term_statistics, bm25_topk_pooled, bm25_topk_per_doc,
        bm25_topk_routed, heading_flags, cjk_pair_dedupe, cjk_join_breaks, leading_letters, chapter_number_fix, split_chapters_en, split_chapters_zh, reflow_lines, ingest_chinese_books,
    )
}


# What the library's expressions say, said anew for the SQL.
_SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
_BLANK = r"\t\x1f\p{Zs}"
_IDEO = r"㐀-䶿一-鿿豈-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2ceaf}"
_EN = r"[\p{L}\p{M}\p{N}_]+(?:[-.,][\p{L}\p{N}_]+)*|[^\t-\r\x1c-\x1f\x85\p{Z}\p{L}\p{M}\p{N}_]"
_ZH = r"[" + _IDEO + r"]|[\p{Latin}\p{Cyrillic}\p{Greek}\p{Devanagari}\p{N}_]+|[\t-\r\x1c-\x1f\x85\p{Z}]|[^\t-\r\x1c-\x1f\x85\p{Z}]"
_MARKS = "。！？，、；：…—?!.,;:」』）)\\]>”"
_COMMON = "('the', 'and', 'of', 'to', 'in', 'was', 'that', 'a', 'for', 'with', 'had', 'is')"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{_SPACE}]+|[{_SPACE}]+\z', '', 'g')"


_LINES = rf"list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: {_trim('x')}), lambda x: length(x) > 0)"
_NONBLANK = f"lines as (select doc_id, cast(unnest(generate_series(1, len(ls))) as int) as line_no, unnest(ls) as line from (select doc_id, {_LINES} as ls from documents where text is not null))"
_TOKENS = f"toks as (select doc_id, regexp_extract_all(text, '{_EN}') as t from documents where text is not null)"
_CHUNKS = f"""{_TOKENS}, starts as (select doc_id, t, unnest(generate_series(0, len(t) - 1, 250)) as s from toks where len(t) > 0),
chunks as (select doc_id, cast(s // 250 as int) as chunk_id, array_to_string(t[s + 1:s + 300], ' ') as text, regexp_extract_all(array_to_string(t[s + 1:s + 300], ' '), '{_EN}') as t from starts)"""
_TERMS = "terms as (select * from (values ('signal', 1), ('station', 2), ('bridge', 1), ('the', 1)) as v(term, times))"


def _bm25(scope: str) -> str:
    return f"""{_CHUNKS}, {_TERMS}, sized as (select {scope} as scope, doc_id, chunk_id, len(t) as dl, text from chunks),
totals as (select scope, count(*) as n, avg(dl) as avgdl from sized group by scope),
tf as (select {scope} as scope, doc_id, chunk_id, term, count(*) as tf from (select doc_id, chunk_id, unnest(t) as term from chunks) group by all),
df as (select scope, term, count(*) as df from tf group by all),
raw as (select df.scope, term, ln(n - df + 0.5) - ln(df + 0.5) as raw from df join totals using (scope)),
idf as (select scope, term, case when raw < 0 then 0.25 * (select avg(raw) from raw b where b.scope = raw.scope) else raw end as idf from raw),
score as (select sized.scope, sized.doc_id, sized.chunk_id, sized.text, coalesce(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 0) as score
 from sized join totals using (scope) left join (tf join terms using (term) join idf using (scope, term)) on tf.doc_id = sized.doc_id and tf.chunk_id = sized.chunk_id
 group by all),
ranked as (select *, cast(row_number() over (partition by scope order by round(score, 9) desc, doc_id, chunk_id) as int) as rank from score)"""


_TERMINATORS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
_INITIALS = rf"regexp_replace(%s, '(\A|[{_TERMINATORS}])([A-Za-z])[{_BLANK}]+([a-z])', '\1\2\3', 'g')"
_S = f"[{_SPACE}]"
_EN_HEADING = rf"(?m)^((?:CHAPTER{_S}+(?:[A-Z]+|\p{{Nd}}+)(?:{_S}+[A-Z]+)*(?:{_S}*[\-–—:]{_S}*.*)?|Chapter{_S}+\p{{Nd}}+{_S}*[\-–—:]{_S}*.*)){_S}*$"

_MIXED = rf"list_transform(list_filter(list_concat(regexp_extract_all(%s, '{_ZH}'), regexp_extract_all(%s, '{_EN}')), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}_]')), lambda x: {_trim('x')})"
_BY_LANGUAGE = f"case language when 'en' then regexp_extract_all(%s, '{_EN}') when 'zh' then regexp_extract_all(%s, '{_ZH}') else {_MIXED} end"
_LANGUAGE = rf"""m as (select doc_id, text, length(text) - length(regexp_replace(text, '[{_IDEO}]', '', 'g')) as han, length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) as letters,
list_filter(string_split(lower(text), ' '), lambda x: length(x) > 0) as w from documents),
l as (select doc_id, text, case when coalesce(letters, 0) = 0 then 'unknown' when han * 10 > letters * 3 then 'zh' when len(list_filter(w, lambda x: x in {_COMMON})) * 12 >= len(w) then 'en' else 'unknown' end as language from m)"""

def _treebank() -> str:
    """The script's steps as nested replacements."""
    q = "'"
    x = f"replace(source, '’', {q * 4})"
    for found, put in (
        (r'^"', "`` "), (r'([ (\[{<])"', r"\1 `` "), (r"[.]{3}", " ... "), (r"[,;:@#$%&]", r" \0 "), (r"""([^.])[.]([\])}>"']*)[ \t]*(\n|$)""", r"\1 .\2 \3"), (r"[?!]", r" \0 "),
        (r"[\]\[(){}<>]", r" \0 "), ("--", " -- "), (r"^|$", " "), ('"', " '' "), (r"([^'])' ", r"\1 ' "), (r"'([smd]|[SMD]) ", r" '\1 "), (r"'(ll|re|ve|LL|RE|VE) ", r" '\1 "), (r"(n't|N'T) ", r" \1 "),
        (" ([Cc])annot ", r" \1an not "), (" ([Gg])onna ", r" \1on na "), (" ([Gg])otta ", r" \1ot ta "), (" ([Ll])emme ", r" \1em me "), (" ([Ww])anna ", r" \1an na "), (" '([Tt])is ", r" '\1 is "), (" '([Tt])was ", r" '\1 was "),
    ):
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, found.replace(q, q * 2), put.replace(q, q * 2))
    return rf"select distinct pair_id, array_to_string(list_filter(string_split_regex({x}, '[{_SPACE}]+'), lambda t: t <> ''), '|') as tokens from pairs_en where source is not null"


SQL = {
    "nonblank_lines": f"with {_NONBLANK} select doc_id, line_no, line from lines",
    "find_lines": f"with {_NONBLANK} select doc_id, line_no, line from lines where contains(line, 'signal')",
    "word_tokens": f"with {_TOKENS} select doc_id, cast(unnest(generate_series(0, len(t) - 1)) as int) as pos, unnest(t) as token from toks",
    "treebank_tokens": _treebank(),
    "mixed_tokens": f"select distinct pair_id, array_to_string({_MIXED.replace('%s', 'zh')}, '|') as tokens from pairs_zh where zh is not null",
    "language_route": f"with {_LANGUAGE} select doc_id, language, case language when 'en' then 'english' when 'zh' then 'chinese' else 'mixed' end as tokenizer from l",
    "language_labels": "select lang, case when lower(lang) = 'en' then 'english' when lower(lang) like 'zh%' then 'chinese' else 'mixed' end as tokenizer, count(*) as n from documents group by all",
    "token_chunks": f"with {_CHUNKS} select doc_id, chunk_id, cast(len(t) as int) as n_tokens, left(text, 300) || '...' as snippet from chunks",
    "term_statistics": f"with {_bm25('0')} select term, round(idf, 6) as idf from idf",
    "bm25_topk_pooled": f"with {_bm25('0')} select rank, doc_id, chunk_id, round(score, 6) as score, left(text, 300) || '...' as text from ranked where rank <= 5",
    "bm25_topk_per_doc": f"with {_bm25('doc_id')} select doc_id, rank, chunk_id, round(score, 6) as score from ranked where rank <= 5",
    "bm25_topk_routed": f"""with {_LANGUAGE}, toks as (select doc_id, language, {_BY_LANGUAGE.replace("%s", "text")} as t from l where text is not null),
starts as (select *, unnest(generate_series(0, len(t) - 1, 250)) as s from toks where len(t) > 0),
joined as (select doc_id, language, cast(s // 250 as int) as chunk_id, array_to_string(t[s + 1:s + 300], ' ') as text from starts),
chunks as (select *, {_BY_LANGUAGE.replace("%s", "text")} as t from joined),
asked as (select * from (values (1, 'en', '信号', 1), (1, 'en', 'station', 1), (1, 'zh', '信', 1), (1, 'zh', '号', 1), (1, 'zh', ' ', 1), (1, 'zh', 'station', 1),
 (1, 'unknown', '信', 1), (1, 'unknown', '号', 1), (1, 'unknown', '信号', 1), (1, 'unknown', 'station', 2),
 (2, 'en', 'The', 1), (2, 'en', 'bridge', 1), (2, 'en', ',', 1), (2, 'en', 'the', 1), (2, 'en', 'Station', 1), (2, 'en', '!', 1),
 (2, 'zh', 'The', 1), (2, 'zh', ' ', 3), (2, 'zh', 'bridge', 1), (2, 'zh', ',', 1), (2, 'zh', 'the', 1), (2, 'zh', 'Station', 1), (2, 'zh', '!', 1),
 (2, 'unknown', 'The', 2), (2, 'unknown', 'bridge', 2), (2, 'unknown', 'the', 2), (2, 'unknown', 'Station', 2)) as v(query_id, language, term, times)),
total as (select count(*) as n, avg(len(t)) as avgdl from chunks),
tf as (select doc_id, language, chunk_id, len(t) as dl, term, count(*) as tf from (select *, unnest(t) as term from chunks) group by all),
raw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf, total group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
score as (select query_id, doc_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from tf join asked using (language, term) join idf using (term), total group by all),
ranked as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, doc_id, chunk_id) as int) as rank from score)
select query_id, rank, doc_id, chunk_id, round(score, 6) as score from ranked where rank <= 20""",
    # line by line, as a sequential program would do it
    "reflow_lines": rf"""with t as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
k as (select doc_id, list_transform(ls, lambda x: struct_pack(line := x, bare := {_trim('x')})) as ls from t),
m as (select doc_id, list_transform(ls, lambda x: struct_pack("out" := x.line, sub := 0, "last" := '', kind := case when x.bare = '' then 'blank'
 when regexp_matches(x.bare, '\A第[一二三四五六七八九十百千0-9]+章') then case when length(x.bare) <= 30 then 'short heading' else 'heading' end when length(x.bare) <= 30 then 'short' else 'text' end)) as ls from k),
f as (select doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: x.kind like '%heading'), true), 0) as f from m),
h as (select doc_id, ls, case when f = 0 then 0 when f < len(ls) and ls[f + 1].kind like 'short%' then case when f + 1 < len(ls) and ls[f + 2].kind like 'short%' then f + 2 else f + 1 end else f end as head from f),
r as (select doc_id, list_reduce(ls[head + 1:], lambda s, x: case
 when s.sub > 0 and x.kind = 'blank' then struct_pack("out" := s."out" || chr(10) || x."out", sub := 0, "last" := '', kind := '')
 when s.sub > 0 and x.kind like 'short%' then struct_pack("out" := s."out" || chr(10) || x."out", sub := s.sub - 1, "last" := '', kind := '')
 when x.kind like '%heading' then struct_pack("out" := s."out" || chr(10) || x."out", sub := 2, "last" := '', kind := '')
 when x.kind = 'blank' then struct_pack("out" := s."out" || chr(10), sub := 0, "last" := '', kind := '')
 when s."last" <> '' and not regexp_matches({_trim('s."last"')}, '[{_MARKS}]\z') then struct_pack("out" := s."out" || x."out", sub := 0, "last" := x."out", kind := '')
 else struct_pack("out" := s."out" || chr(10) || x."out", sub := 0, "last" := x."out", kind := '') end,
 struct_pack("out" := array_to_string(list_transform(ls[1:head], lambda x: chr(10) || x."out"), ''), sub := 0, "last" := '', kind := ''))."out" as text from h)
select doc_id, substr(text, 2) as text from r""",
    "heading_flags": rf"with {_NONBLANK} select doc_id, line_no, regexp_matches(line, '\A第[一二三四五六七八九十百千0-9]+章') as heading, nullif(regexp_extract(line, '\A第{_S}*(\p{{Nd}}+){_S}*章', 1), '') as number, not regexp_matches(line, '[{_MARKS}]\z') as goes_on from lines",
    "cjk_pair_dedupe": rf"""with r as (select distinct pair_id, zh from pairs_zh where zh is not null),
l as (select pair_id, cast(unnest(generate_series(0, len(string_split(zh, chr(10))) - 1)) as int) as line_no, unnest(string_split(zh, chr(10))) as raw from r),
p as (select *, list_transform(generate_series(1, greatest(length(raw) - 1, 1), 2), lambda i: substring(raw, i, 2)) as pairs from l),
q as (select *, len(list_filter(pairs, lambda x: regexp_matches(x, '[{_IDEO}]'))) as total, len(list_filter(pairs, lambda x: length(x) = 2 and x[1] = x[2] and regexp_matches(x[1], '[{_IDEO}]'))) as twice from p)
select pair_id, line_no, case when length(raw) > 1 and total > 0 and twice / total >= 0.6 and not regexp_matches({_trim('raw')}, '\A第\p{{Nd}}+章\z')
 then replace(list_reduce(list_transform(generate_series(1, length(raw)), lambda i: raw[i]), lambda a, b: case when right(a, 1) = b and regexp_matches(b, '[{_IDEO}]') then a || chr(1) else a || b end), chr(1), '') else raw end as line
from q where raw <> ''""",
    "cjk_join_breaks": rf"""select distinct pair_id, regexp_replace(regexp_replace(zh, '([\x{{4e00}}-\x{{9fff}}]){_S}*\n{_S}*([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g'), '([\x{{4e00}}-\x{{9fff}}]){_S}*\n{_S}*([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g') as zh from pairs_zh where zh is not null""",
    "leading_letters": "select distinct pair_id, " + _INITIALS % r"regexp_replace(target, '(?m)^([A-Z])([a-z])', '\1 \2', 'g')" + " as target from pairs_en where target is not null",
    "chapter_number_fix": rf"""with t as (select doc_id, string_split(regexp_replace(text, '第([0-9]+)章', '\1' || chr(10) || '第  章', 'g'), chr(10)) as ls from documents where text is not null),
l as (select doc_id, cast(unnest(generate_series(0, len(ls) - 1)) as int) as line_no, unnest(ls) as line from t),
m as (select *, {_trim('line')} as bare, {_trim("replace(line, ' ', '')")} = '第章' as broken from l),
w as (select *, coalesce(lead(broken) over (partition by doc_id order by line_no), false) as next, coalesce(regexp_matches(lag(bare) over (partition by doc_id order by line_no), '\A\p{{Nd}}+\z'), false) as before from m)
select doc_id, line_no, case when regexp_matches(bare, '\A\p{{Nd}}+\z') and next then '第' || bare || '章' else line end as line from w where not (broken and before)""",
    "split_chapters_en": rf"""with p as (select doc_id, string_split(regexp_replace(text, '{_EN_HEADING}', chr(1) || '\0', 'g'), chr(1)) as ps from documents where text is not null),
e as (select doc_id, cast(unnest(generate_series(0, len(ps) - 1)) as int) as chapter_no, unnest(ps) as text from p)
select doc_id, chapter_no, {_INITIALS % "regexp_replace(text, '^\\n+', '')"} as text from e where chapter_no > 0""",
    "split_chapters_zh": rf"""with t as (select doc_id, regexp_extract_all(text, '(?s)[^{_TERMINATORS}]*(?:\r\n|[{_TERMINATORS}])|[^{_TERMINATORS}]+') as ls from documents where text <> ''),
l as (select doc_id, unnest(generate_series(1, len(ls))) as n, unnest(ls) as line from t),
h as (select *, nullif(regexp_extract({_trim('line')}, '\A第{_S}*(\p{{Nd}}+){_S}*章', 1), '') as number from l),
g as (select *, count(number) over (partition by doc_id order by n) as g from h),
c as (select doc_id, g, coalesce(max(number), 'title') as part, string_agg(line, '' order by n) as text from g group by doc_id, g)
select doc_id, part, text from c qualify row_number() over (partition by doc_id, part order by g desc) = 1""",
}
