"""Queries over transcripts, segments and aligned pairs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import align as A
from lectern.operators import segments as G
from lectern.tables import table

NEEDED, FRAME_MS, MIN_MS, OFFSET = 2, 30, 300, 50


def _frames(spark: SparkSession, root: str) -> DataFrame:
    """Events of a user as frames, views being silence."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, root, "events").select("user_id", (F.row_number().over(w) - 1).alias("frame_no"), (F.col("event_type") != "view").alias("is_speech"))


def silence_cuts(spark: SparkSession, root: str) -> DataFrame:
    return G.silence_cuts(_frames(spark, root), "user_id", "frame_no", "is_speech", NEEDED)


def segment_intervals(spark: SparkSession, root: str) -> DataFrame:
    frames = _frames(spark, root)
    totals = frames.groupBy("user_id").agg((F.count(F.lit(1)) * FRAME_MS + 17).alias("total_ms"))
    return G.cut_intervals(G.silence_cuts(frames, "user_id", "frame_no", "is_speech", NEEDED), "user_id", totals, "total_ms", FRAME_MS)


def merge_short_segments(spark: SparkSession, root: str) -> DataFrame:
    return G.merge_short(segment_intervals(spark, root), "user_id", MIN_MS)


def transcript_segments(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "transcripts").select("audio_id", F.inline(A.transcript_segments(F.col("segments"))))
    return rows.distinct()


def transcript_pack(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "segments").select("audio_id", "id", "start", "end", "text").distinct()
    return A.pack_transcripts(rows, ["audio_id"], ["id", "start", "end"], "text").select("audio_id", "text", F.size("segments").alias("n"))


def chunk_names(spark: SparkSession, root: str) -> DataFrame:
    file = F.col("chunk_file")
    return table(spark, root, "transcripts").select("chunk_file").distinct().select("chunk_file", X.chunk_number(file).alias("chunk_no"), X.output_name(file, "_aligned").alias("output"))


def pending_items(spark: SparkSession, root: str) -> DataFrame:
    keys = ["book", "chapter", "chunk_file"]
    return A.pending(table(spark, root, "transcripts").select(*keys).distinct(), table(spark, root, "pairs_en").where("target <> ''"), keys)


def verified_only(spark: SparkSession, root: str) -> DataFrame:
    decided = table(spark, root, "pairs_en").withColumn("decision", F.expr("case when source is null then null when target is null or target = '' then 'False' when origin = 'scan' then 'TRUE' else 'True' end"))
    return decided.where(A.accepted(F.col("decision"))).select("pair_id", "chunk_file", "decision").distinct()


def reference_window(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "transcripts").select("book", F.col("chapter").cast("string").alias("chapter"), X.chunk_number(F.col("chunk_file")).alias("chunk_no")).distinct()
    counts = chunks.groupBy("book", "chapter").agg(F.countDistinct("chunk_no").alias("n_chunks"))
    texts = table(spark, root, "chapter_pairs").where("en is not null").select("chapter_pair_id", "book", "chapter", X.lines(F.col("en")).alias("ls")).distinct()
    rows = texts.join(counts, ["book", "chapter"]).join(chunks, ["book", "chapter"])
    return rows.select("chapter_pair_id", "chunk_no", A.reference_window(F.col("ls"), F.col("chunk_no"), F.col("n_chunks"), OFFSET).alias("reference"))


def title_prefix(spark: SparkSession, root: str) -> DataFrame:
    titles = table(spark, root, "front_matter").select("book", F.col("text").alias("title"))
    rows = table(spark, root, "transcripts").select("book", "chapter", "chunk_file", "text").distinct().join(titles, "book", "left")
    return rows.select("book", "chapter", "chunk_file", A.with_title(F.col("text"), F.col("title"), X.chunk_number(F.col("chunk_file"))).alias("text"))


def extract_json(spark: SparkSession, root: str) -> DataFrame:
    raw = F.concat(F.lit("Sure, here it is:\n"), F.col("props"), F.lit("\nDone."))
    span = X.json_span(F.when(F.col("event_type") == "view", F.lit("no object")).otherwise(raw))
    return table(spark, root, "events").select("event_id", span.alias("span"), F.get_json_object(span, "$.k").cast("bigint").alias("k"))


def _passages(spark: SparkSession, root: str) -> DataFrame:
    """Pairs with the window of their chapter, the chapter being its targets of that language in order."""
    rows = table(spark, root, "pairs_en").select("pair_id", "book", "chapter", F.coalesce("lang", F.lit("")).alias("lang"), "chunk_file", "source", "target").distinct()
    rows = rows.withColumn("chunk_no", X.chunk_number(F.col("chunk_file")))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.length("target") > 0, F.struct("chunk_no", "pair_id", "target")))), lambda x: x["target"])
    chapters = rows.groupBy("book", "chapter", "lang").agg(F.flatten(F.transform(ordered, X.lines)).alias("ls"), F.countDistinct("chunk_no").alias("n_chunks"))
    joined = rows.join(chapters, ["book", "chapter", "lang"])
    return joined.select("pair_id", "source", F.col("target").alias("written"), A.reference_window(F.col("ls"), F.col("chunk_no"), F.col("n_chunks")).alias("reference"))


def align_spans(spark: SparkSession, root: str) -> DataFrame:
    return A.run_model(_passages(spark, root), A.SpanAligner, "target").select("pair_id", "target", "error")


def verify_spans(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "pairs_en").select("pair_id", "source", "target").distinct()
    return A.run_model(rows, A.Verifier, "decision").select("pair_id", "decision", "error")


def align_pipeline(spark: SparkSession, root: str) -> DataFrame:
    """Align, verify and gate; what is rejected or failed is told apart."""
    kept, rejected, failed = A.align_and_verify(_passages(spark, root).drop("written"))
    out = kept.select("pair_id", F.lit("accepted").alias("state")).unionByName(rejected.select("pair_id", F.lit("rejected").alias("state")))
    return out.unionByName(failed.select("pair_id", F.lit("failed").alias("state")))


def parse_replies(spark: SparkSession, root: str) -> DataFrame:
    """Loosely written model replies around the events' values."""
    raw = F.expr("case event_id % 4 when 0 then concat('{\\'think\\': \\'t\\', target: \"', value, '\",}') when 1 then concat('x {\"think\": \"t\", \"target\": \"', value, '\"') when 2 then 'none' else concat('{\"think\": \"t\", \"target\": \"', value, '\"} y') end")
    found = A.parse_reply(raw)
    return table(spark, root, "events").select("event_id", found["think"].alias("think"), found["target"].alias("target"))


def pair_json(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "pairs_en").select("pair_id", "chunk_file", "source", "target").distinct()
    return rows.select("pair_id", A.to_object(chunk_file=F.col("chunk_file"), source=F.col("source"), target=F.col("target")).alias("pair"))


def prompts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "pairs_en").select("pair_id", "source", "target").distinct()
    return rows.select("pair_id", A.prompt("Say whether the target renders the source.", source=F.col("source"), target=F.col("target")).alias("prompt"))


def chinese_replies(spark: SparkSession, root: str) -> DataFrame:
    """Replies that carry wrong names and source texts around the Chinese text: the input's own are kept."""
    rows = table(spark, root, "pairs_zh").select("pair_id", "chunk_file", "en", "zh").distinct()
    raw = F.concat(F.lit("Here:\n"), A.to_object(chunk_file=F.lit("chunk_0.wav"), en=F.lit("?"), zh=F.col("zh")), F.lit("\nEnd."))
    rows = rows.select("pair_id", "chunk_file", "en", A.parse_reply(raw, "chunk_file string, en string, zh string", repair=False).alias("reply"))
    merged = A.merge_reply(rows, "reply", ["chunk_file", "en"])
    return merged.withColumn("zh", X.join_ideograph_breaks(F.col("zh")))


class Copyist:
    """In place of a model: answers with the first lines of the Chinese text it is given, and with other names; it fails
    where the transcript asks a question."""

    def __call__(self, prompts: list[str], temperature: float, top_p: float, max_new_tokens: int) -> list[str]:
        out = []
        for p in prompts:
            text, _, piece = p.split("Chinese text:\n\n", 1)[1].partition("\n\nPiece of the recording:\n\n")
            reply = json.dumps({"chunk_file": "?", "en": "?", "zh": "\n".join(text.split("\n")[:3])}, ensure_ascii=False)
            out.append("I cannot say." if "?" in piece else f"Here it is:\n{reply}\nDone.")
        return out


def chinese_alignment(spark: SparkSession, root: str) -> DataFrame:
    """Each English piece with its whole Chinese chapter and, first pieces, the title page; failures told apart."""
    chunks = table(spark, root, "pairs_zh").select("pair_id", "book", "chapter", "chunk_file", "en").distinct()
    chapters = table(spark, root, "chapter_pairs").where("zh is not null and chapter is not null").groupBy("book", "chapter").agg(F.min("zh").alias("zh"))
    titles = table(spark, root, "front_matter").select("book", F.col("text").alias("title"))
    aligned, failed = A.align_chinese(A.with_chapters(chunks, chapters, ["book", "chapter"], "zh", titles), lambda: A.Chat(Copyist()), ["pair_id"])
    none = F.lit(None).cast("string")
    return aligned.select("pair_id", "chunk_file", "en", "zh", none.alias("error")).unionByName(failed.select("pair_id", "chunk_file", none.alias("en"), none.alias("zh"), "error"))


QUERIES = {
    f.__name__: f
    for f in (
        silence_cuts, segment_intervals, merge_short_segments, transcript_segments, transcript_pack, chunk_names, pending_items, verified_only, reference_window,
        title_prefix, extract_json, align_spans, verify_spans, align_pipeline, parse_replies, pair_json, prompts, chinese_replies, chinese_alignment,
    )
}

_FRAMES = "frames as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as f, event_type <> 'view' as s from events)"
_CUTS = f"""{_FRAMES}, islands as (select *, count(*) filter (where s) over (partition by user_id order by f) as island from frames),
runs as (select *, row_number() over (partition by user_id, island order by f) as r from islands where not s),
cuts as (select user_id, cast(f + 1 as int) as cut_frame from runs where r % {NEEDED} = 0)"""
_SEGMENTS = f"""{_CUTS}, totals as (select user_id, count(*) * {FRAME_MS} + 17 as total from frames group by user_id),
starts as (select user_id, total, 0 as a from totals union all select user_id, total, cut_frame * {FRAME_MS} from cuts join totals using (user_id)),
spans as (select user_id, least(a, total) as start_ms, least(coalesce(lead(a) over (partition by user_id order by a), total), total) as end_ms from starts),
segs as (select user_id, cast(row_number() over (partition by user_id order by start_ms) as int) as seg_no, start_ms, end_ms from spans where end_ms > start_ms)"""
_LINES = rf"list_filter(list_transform(string_split_regex(en, '\r\n|\r|\n'), lambda x: regexp_replace(x, '\A[\t-\r\x1c-\x1f\x85\p{{Z}}]+|[\t-\r\x1c-\x1f\x85\p{{Z}}]+\z', '', 'g')), lambda x: length(x) > 0)"

_BROKEN = r"([\x{4e00}-\x{9fff}])[\t-\r\x1c-\x1f\x85\p{Z}]*\n[\t-\r\x1c-\x1f\x85\p{Z}]*([\x{4e00}-\x{9fff}])"

SQL = {
    "chinese_alignment": rf"""with c as (select distinct pair_id, book, chapter, chunk_file, en from pairs_zh),
t as (select book, chapter, min(zh) as zh from chapter_pairs where zh is not null and chapter is not null group by all),
r as (select c.*, case when regexp_extract(chunk_file, 'chunk_(\d+)', 1) = '1' and f.text is not null then f.text || chr(10) || chr(10) || t.zh else t.zh end as reference from c left join t using (book, chapter) left join front_matter f on f.book = c.book),
s as (select *, array_to_string(string_split(reference, chr(10))[1:3], chr(10)) as ls, case when reference is null then 'no chapter' when contains(coalesce(en, '') || chunk_file, '?') then 'no JSON object' end as error from r)
select pair_id, chunk_file, case when error is null then en end as en, case when error is null then regexp_replace(regexp_replace(ls, '{_BROKEN}', '\1\2', 'g'), '{_BROKEN}', '\1\2', 'g') end as zh, error from s""",
    "silence_cuts": f"with {_CUTS} select user_id, cut_frame from cuts",
    "segment_intervals": f"with {_SEGMENTS} select user_id, seg_no, start_ms, end_ms from segs",
    # piece by piece, as a sequential program would do it
    "merge_short_segments": f"""with recursive {_SEGMENTS}, n as (select user_id, max(seg_no) as n from segs group by user_id),
walk as (select user_id, seg_no, 1 as out_no, start_ms, end_ms, start_ms as a, end_ms as b from segs where seg_no = 1
 union all select s.user_id, s.seg_no, case when w.b - w.a >= {MIN_MS} and s.end_ms - s.start_ms >= {MIN_MS} then w.out_no + 1 else w.out_no end, s.start_ms, s.end_ms,
 case when w.b - w.a >= {MIN_MS} and s.end_ms - s.start_ms >= {MIN_MS} then s.start_ms else w.a end, s.end_ms from walk w join segs s on s.user_id = w.user_id and s.seg_no = w.seg_no + 1)
select user_id, cast(out_no as bigint) as seg_no, min(a) as start_ms, max(b) as end_ms from walk group by all""",
    "transcript_segments": """select distinct audio_id, s.id as id, s."start" as "start", s."end" as "end", coalesce(s.text, '') as text from (select audio_id, unnest(segments) as s from transcripts)""",
    "transcript_pack": """select audio_id, string_agg(coalesce(text, ''), '' order by id nulls first, "start" nulls first, "end" nulls first, text nulls first) as text, cast(count(*) as int) as n
from (select distinct audio_id, id, "start", "end", text from segments) group by audio_id""",
    "chunk_names": r"select distinct chunk_file, cast(regexp_extract(chunk_file, 'chunk_(\d+)', 1) as int) as chunk_no, regexp_replace(chunk_file, '\.(wav|json)$', '_aligned.json') as output from transcripts",
    "pending_items": "select distinct book, chapter, chunk_file from transcripts t where not exists (select 1 from pairs_en p where p.target <> '' and p.book = t.book and p.chapter = t.chapter and p.chunk_file = t.chunk_file)",
    "verified_only": "select distinct pair_id, chunk_file, case when origin = 'scan' then 'TRUE' else 'True' end as decision from pairs_en where source is not null and target <> ''",
    "reference_window": rf"""with c as (select distinct book, cast(chapter as varchar) as chapter, cast(regexp_extract(chunk_file, 'chunk_(\d+)', 1) as int) as chunk_no from transcripts),
n as (select book, chapter, count(distinct chunk_no) as n from c group by all),
t as (select distinct chapter_pair_id, book, chapter, {_LINES} as ls from chapter_pairs where en is not null),
p as (select chapter_pair_id, chunk_no, ls, cast(floor(len(ls) * chunk_no / n) as int) as k from t join n using (book, chapter) join c using (book, chapter))
select chapter_pair_id, chunk_no, array_to_string(ls[greatest(0, k - {OFFSET}) + 1:k + {OFFSET} + 1], chr(10)) as reference from p""",
    "title_prefix": r"""select distinct t.book, t.chapter, t.chunk_file, case when regexp_extract(chunk_file, 'chunk_(\d+)', 1) = '1' and f.text is not null then f.text || chr(10) || chr(10) || t.text else t.text end as text
from transcripts t left join front_matter f using (book)""",
    "extract_json": """select event_id, case when event_type <> 'view' then props end as span, case when event_type <> 'view' then cast(json_extract_string(props, '$.k') as bigint) end as k from events""",
    "parse_replies": "select event_id, case when event_id % 4 in (0, 3) then 't' end as think, case when event_id % 4 in (0, 3) then cast(value as varchar) end as target from events",
    "pair_json": "select distinct pair_id, to_json({'chunk_file': chunk_file, 'source': source, 'target': target})::varchar as pair from pairs_en",
    "prompts": "select distinct pair_id, 'Say whether the target renders the source.' || chr(10) || to_json({'source': source, 'target': target})::varchar as prompt from pairs_en",
    "chinese_replies": rf"""select distinct pair_id, chunk_file, en, regexp_replace(regexp_replace(zh, '([\x{{4e00}}-\x{{9fff}}])[\t-\r\x1c-\x1f\x85\p{{Z}}]*\n[\t-\r\x1c-\x1f\x85\p{{Z}}]*([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g'), '([\x{{4e00}}-\x{{9fff}}])[\t-\r\x1c-\x1f\x85\p{{Z}}]*\n[\t-\r\x1c-\x1f\x85\p{{Z}}]*([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g') as zh from pairs_zh""",
}
