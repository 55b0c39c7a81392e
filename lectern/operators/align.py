"""Aligning transcripts with book text: candidate windows, span alignment, verification, gates and bookkeeping."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import text as X
from lectern.tables import materialise


def reference_window(lines: Column, chunk_no: Column, n_chunks: Column, offset: int = 50) -> Column:
    """The lines around the place that a chunk has in proportion, joined by line feeds: ``offset`` either way. Numbers
    from 1 are taken as they are, so the window lies one chunk ahead."""
    at = F.floor(F.size(lines) * chunk_no / n_chunks).cast("int")
    start = F.greatest(F.lit(0), at - offset)
    return F.array_join(F.slice(lines, start + 1, F.greatest(at + offset + 1 - start, F.lit(0))), "\n")


def pending(chunks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks without an output yet."""
    return chunks.join(done.select(*keys).distinct(), keys, "left_anti")


def accepted(decision: Column) -> Column:
    """Whether a verdict says true, as a string in any case or a boolean."""
    return F.coalesce(F.lower(decision.cast("string")) == "true", F.lit(False))


def with_title(chapter: Column, title: Column, chunk_no: Column) -> Column:
    """The title before the chapter, for the first chunk only and where there is one."""
    return F.when((chunk_no == 1) & title.isNotNull(), F.concat(title, F.lit("\n\n"), chapter)).otherwise(chapter)


def transcript_segments(segments: Column) -> Column:
    """id, start, end and text of each recognised segment; a missing text is empty, missing segments are none."""
    kept = F.transform(segments, lambda s: F.struct(s["id"].alias("id"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["text"], F.lit("")).alias("text")))
    return F.coalesce(kept, F.array().cast("array<struct<id:bigint,start:double,end:double,text:string>>"))


def pack_transcripts(rows: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """(keys, text, segments): segments of a chunk in order, and their texts joined."""
    packed = F.array_sort(F.collect_list(F.struct(*order, text)))
    out = rows.groupBy(*keys).agg(packed.alias("segments"))
    return out.select(*keys, F.array_join(F.transform("segments", lambda s: F.coalesce(s[text], F.lit(""))), "").alias("text"), "segments")


def parse_reply(raw: Column, schema: str = "think string, target string", repair: bool = True) -> Column:
    """A model's reply as a struct; null where it holds no object or, strictly, anything that is not one object."""
    span = X.json_span(raw)
    return F.from_json(strict_json(span if not repair else lenient_json(span)), schema)


def prompt(instruction: str, **fields: Column) -> Column:
    """An instruction and, below it, the fields as one JSON object, so that no text can break out of its place."""
    return F.concat(F.lit(instruction + "\n"), to_object(**fields))


def to_object(**fields: Column) -> Column:
    """The fields as a JSON object, characters as they are, nulls written out."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def merge_reply(df: DataFrame, reply: str, trusted: list[str]) -> DataFrame:
    """The fields of a reply (a struct column) beside the rows' own columns, of which the trusted ones win over what the
    model wrote under their names; a reply that is null leaves its fields null."""
    fields = [f.name for f in df.schema[reply].dataType.fields if f.name not in trusted]
    return df.select(*[c for c in df.columns if c != reply and c not in fields], *[F.col(reply)[f].alias(f) for f in fields])


_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity|NaN)(?=\s*(?:[,}\]\n]|/[/*]|$))")
_BARE = re.compile(r"[^,}\]\n]+")
_WORDS = {"True": "true", "False": "false", "None": "null", "true": "true", "false": "false", "null": "null"}


def _number(text: str) -> str:
    """A number as strict JSON writes it."""
    sign, body = ("-" if text[0] == "-" else ""), text.lstrip("+-")
    if body[:2].lower() == "0x":
        return sign + str(int(body, 16))
    if body in ("Infinity", "NaN"):
        return sign + body
    whole, point, fraction, power = re.fullmatch(r"(\d*)(\.?)(\d*)((?:[eE].*)?)", body).groups()
    return sign + str(int(whole or 0)) + (f".{fraction or 0}" if point else "") + power


def mend_json(raw: str | None) -> str | None:
    """Strict JSON of one object written loosely: single quotes, bare keys and values, trailing commas, comments of either
    kind, hexadecimal and signed numbers, points without digits on a side, missing ends. Null for null and for what cannot
    be mended."""
    if raw is None:
        return None
    out, stack, i = [], [], 0
    while i < len(raw):
        c = raw[i]
        if c in "\"'":
            k = i + 1
            body = ""
            while k < len(raw) and raw[k] != c:
                if raw[k] == "\\" and k + 1 < len(raw):
                    body += raw[k + 1] if raw[k + 1] == "'" else "" if raw[k + 1] == "\n" else raw[k : k + 2]
                    k += 1
                else:
                    body += {'"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(raw[k], raw[k])
                k += 1
            out.append(f'"{body}"')
            i = k + 1
        elif raw.startswith(("//", "/*"), i):
            end = "\n" if raw[i + 1] == "/" else "*/"
            at = raw.find(end, i + 2)
            i = len(raw) if at < 0 else at if end == "\n" else at + 2
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
            i += 1
        elif c in "}]":
            while out and out[-1].isspace():
                out.pop()
            if out and out[-1] == ",":
                out.pop()
            if not stack or stack.pop() != c:
                return None
            out.append(c)
            i += 1
            if not stack and raw[i:].strip():
                return None
        elif c in ",:" or c.isspace():
            out.append(c)
            i += 1
        elif stack and stack[-1] == "}" and next((x for x in reversed(out) if not x.isspace()), "") in ("{", ","):
            word = re.match(r"[^\s:,{}\[\]\"']+", raw[i:])[0]  # a key
            out.append(json.dumps(word, ensure_ascii=False))
            i += len(word)
        else:
            number = _NUMBER.match(raw, i)
            value = number[0] if number else re.split(r"\s*(?:/[/*]|$)", _BARE.match(raw, i)[0], maxsplit=1)[0]
            out.append(_number(value) if number else _WORDS.get(value, json.dumps(value, ensure_ascii=False)))
            i += max(1, len(value))
    while out and (out[-1].isspace() or out[-1] == ","):
        out.pop()
    text = "".join(out) + "".join(reversed(stack))
    try:
        return text if isinstance(json.loads(text), dict) else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def lenient_json(raw: pd.Series) -> pd.Series:
    return raw.map(mend_json, na_action="ignore").astype(object)


@F.pandas_udf(StringType())
def strict_json(raw: pd.Series) -> pd.Series:
    """The text itself if it is exactly one JSON object, else null."""

    def one(t: str) -> str | None:
        try:
            return t if isinstance(json.loads(t), dict) else None
        except ValueError:
            return None

    return raw.map(one, na_action="ignore").astype(object)


def norm(token: str) -> str:
    return re.sub(r"\W", "", token).lower()


def local_span(source: list[str], reference: list[str], match: int = 2, gap: int = 1) -> tuple[int, int, float] | None:
    """Best local alignment of two token lists: first and last aligned place in the reference, and its score. The rows of
    the table are computed whole; gaps along a row come from a running maximum."""
    if not source or not reference:
        return None
    ref = np.array(reference, object)
    n = len(ref)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    steps = gap * np.arange(n + 1)
    for s in source:
        diag = score[:-1] + np.where(ref == s, match, -1)
        row, from_ = np.zeros(n + 1, np.int64), np.arange(n + 1)
        up = score - gap
        row[1:], from_[1:] = np.where(diag >= up[1:], diag, up[1:]), np.where(diag >= up[1:], start[:-1], start[1:])
        shifted = row + steps
        at = np.maximum.accumulate(np.where(shifted == np.maximum.accumulate(shifted), np.arange(n + 1), 0))
        left = shifted[at] - steps
        from_ = np.where(left > row, from_[at], from_)
        row = np.maximum(row, left)
        from_ = np.where(row <= 0, np.arange(n + 1), from_)
        row = np.maximum(row, 0)
        score, start = row, from_
        k = int(row.argmax())
        if row[k] > best[2]:
            best = (int(from_[k]), k, int(row[k]))
    return None if best[2] == 0 else (best[0], best[1] - 1, best[2] / (match * len(source)))


def align_span(source: str, reference: str) -> str:
    """The stretch of the reference, as it is written there, that the source's words fit best; '' if none do."""
    pieces = [(m.start(), m.end(), norm(m[0])) for m in re.finditer(r"\S+", reference)]
    found = local_span([t for t in map(norm, source.split()) if t], [p[2] for p in pieces])
    return reference[pieces[found[0]][0] : pieces[found[1]][1]] if found else ""


def coverage(source: str, target: str) -> float:
    """Share of the words of both sides that a common subsequence of words holds."""
    a, b = ([t for t in map(norm, s.split()) if t] for s in (source, target))
    if not a or not b:
        return 0.0
    row = np.zeros(len(b) + 1, np.int64)
    other = np.array(b, object)
    for t in a:
        hit = row.copy()
        hit[1:] = np.maximum(row[1:], row[:-1] + (other == t))
        row = np.maximum.accumulate(hit)
    return 2 * int(row[-1]) / (len(a) + len(b))


class Adapter(Protocol):
    """A model behind a batch call: for each row its outputs by name, or the exception with which it failed."""

    def __call__(self, rows: list[dict]) -> list[dict | Exception]: ...


class RowByRow:
    """A batch call for a model that takes one row at a time."""

    def __call__(self, rows: list[dict]) -> list[dict | Exception]:
        out: list[dict | Exception] = []
        for row in rows:
            try:
                out.append(self.one(row))
            except Exception as e:  # noqa: BLE001 - any failure of a model is a dead letter
                out.append(e)
        return out


class SpanAligner(RowByRow):
    """Stand-in for a language model that copies the passage of a reference which a source renders."""

    def one(self, row: dict) -> dict:
        if row["source"] is None or row["reference"] is None:
            raise ValueError("source or reference is missing")
        return {"target": align_span(row["source"], row["reference"])}


class Verifier(RowByRow):
    """Stand-in for a model's verdict: the two texts share at least ``least`` of their words in order."""

    def __init__(self, least: float = 0.9) -> None:
        self.least = least

    def one(self, row: dict) -> dict:
        if row["source"] is None or row["target"] is None:
            raise ValueError("source or target is missing")
        return {"decision": str(coverage(row["source"], row["target"]) >= self.least)}


#: Models of this Python worker, the latest last; a worker that is used again for another task finds them.
_BUILT: dict[str, object] = {}


def built(name: str, make, keep: int = 2):
    """The model that ``make()`` builds, once per Python worker and ``name``; the ``keep`` models used last stay."""
    if name not in _BUILT:
        while len(_BUILT) >= keep:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = make()
    else:
        _BUILT[name] = _BUILT.pop(name)
    return _BUILT[name]


def run_model(df: DataFrame, make, outputs: str, size: int = 64) -> DataFrame:
    """``df`` with a model's outputs (strings) and ``error``, null where the row went well. ``make()`` builds the model,
    once per Python worker; it is called with batches of at most ``size`` rows. A row that fails keeps the others going; if
    the call itself fails, its rows are tried one by one."""
    names = outputs.replace(" ", "").split(",")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` string" for n in names), "error string"])
    token = uuid.uuid4().hex

    def call(model, rows: list[dict]) -> list[dict | Exception]:
        try:
            out = list(model(rows))
            if len(out) != len(rows):
                raise ValueError("the model gave another number of results")
            return out
        except Exception as e:  # noqa: BLE001
            return [e] if len(rows) == 1 else [x for row in rows for x in call(model, [row])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = built(token, make)
        for batch in batches:
            rows = batch.to_dict("records")
            found = [x for at in range(0, len(rows), size) for x in call(model, rows[at : at + size])]
            wrong = [isinstance(x, Exception) for x in found]
            got = {n: [None if bad else x.get(n) for x, bad in zip(found, wrong)] for n in names}
            yield batch.assign(**got, error=[f"{type(x).__name__}: {x}" if bad else None for x, bad in zip(found, wrong)])

    return df.mapInPandas(run, schema)


def dead_letters(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that went well, and (keys, error) of those that did not."""
    return df.where("error is null").drop("error"), df.where("error is not null").select(*keys, "error")


def align_and_verify(chunks: DataFrame, least: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted, rejected and failed rows of chunks with ``source`` and ``reference``. Each model runs once per row: its
    output is written before it is told apart."""
    aligned = materialise(run_model(chunks, SpanAligner, "target"), "aligned")
    fine, failed = dead_letters(aligned, [c for c in chunks.columns if c not in ("source", "reference")])
    judged = materialise(run_model(fine, lambda: Verifier(least), "decision").drop("error"), "judged")
    return judged.where(accepted(F.col("decision"))), judged.where(~accepted(F.col("decision"))), failed


#: How replies are drawn, for aligning and for verifying.
ALIGNING = {"temperature": 0.1, "top_p": 0.8, "max_new_tokens": 2048, "thinking": False}
VERIFYING = ALIGNING | {"max_new_tokens": 1024}
COPY_CHINESE = (
    "You are given a Chinese text and one piece of an English recording with its transcript. Find the stretch of the Chinese text that "
    "the transcript renders. Copy it exactly as it is written; do not translate, shorten or add anything. "
    'Answer with one JSON object: {"chunk_file": ..., "en": ..., "zh": ...}.'
)


def messages(system: str, user: Column) -> Column:
    """A conversation to be answered: what the system is told, and what the user says."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def plain_template(conversation: list[dict], thinking: bool) -> str:
    """Roles and contents one below the other, ending where the answer begins. A model brings its own template."""
    return "".join(f"[{m['role']}]\n{m['content']}\n" for m in conversation) + "[assistant]\n"


class Chat:
    """A text generator ``generate(prompts, temperature, top_p, max_new_tokens) -> replies`` as a batch call over rows with
    ``messages``; ``template(messages, thinking)`` renders a conversation as a prompt."""

    def __init__(self, generate, template=plain_template, parameters: dict = ALIGNING) -> None:
        self.generate, self.template, self.parameters = generate, template, dict(parameters)
        self.thinking = self.parameters.pop("thinking", False)

    def __call__(self, rows: list[dict]) -> list[dict | Exception]:
        prompts = [self.template([{k: m[k] for k in ("role", "content")} for m in r["messages"]], self.thinking) for r in rows]
        return [{"reply": x} for x in self.generate(prompts, **self.parameters)]


def with_chapters(chunks: DataFrame, chapters: DataFrame, on: list[str], text: str, titles: DataFrame | None = None) -> DataFrame:
    """``chunks`` (with ``chunk_file``) and, as ``reference``, the whole text of their chapter, before it in the first
    chunk the title page of its book (``titles``: book, title). A chunk without a chapter has none (null)."""
    out = chunks.join(chapters.select(*on, F.col(text).alias("reference")), on, "left")
    if titles is not None:
        out = out.join(titles.select("book", F.col("title").alias("_title")), "book", "left")
        out = out.withColumn("reference", with_title(F.col("reference"), F.col("_title"), X.chunk_number(F.col("chunk_file")))).drop("_title")
    return out


def align_chinese(chunks: DataFrame, make, keys: list[str], system: str = COPY_CHINESE) -> tuple[DataFrame, DataFrame]:
    """Aligned (keys, chunk_file, en, zh) and failed rows (keys, chunk_file, error) of chunks with ``chunk_file``, ``en``
    and ``reference``, the Chinese chapter. The model ``make()`` builds (see ``Chat``) gets both texts; of its reply the
    JSON object is read strictly, file name and English text are the input's own, and line breaks between ideographs go.
    A model that fails, a reply without an object or without ``zh``, and a row without a chapter are failures."""
    user = F.concat(F.lit("Chinese text:\n\n"), F.col("reference"), F.lit("\n\nPiece of the recording:\n\n"), to_object(chunk_file=F.col("chunk_file"), en=F.col("en")), F.lit("\n\nGive the JSON object only."))
    asked = chunks.select(*keys, "chunk_file", "en", F.when(F.col("reference").isNotNull(), messages(system, user)).alias("messages"))
    answered = run_model(asked.where("messages is not null"), make, "reply").drop("messages")
    answered = answered.withColumn("found", parse_reply(F.col("reply"), "chunk_file string, en string, zh string", repair=False))
    answered = materialise(answered.withColumn("error", F.expr("coalesce(error, case when found is null then 'no JSON object' when found.zh is null then 'no zh' end)")), "answered")
    fine, failed = dead_letters(answered, [*keys, "chunk_file"])
    aligned = merge_reply(fine, "found", ["chunk_file", "en"]).select(*keys, "chunk_file", "en", X.join_ideograph_breaks(F.col("zh")).alias("zh"))
    lost = asked.where("messages is null").select(*keys, "chunk_file", F.lit("no chapter").alias("error"))
    return aligned, failed.unionByName(lost)
