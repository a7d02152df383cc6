"""Readers of conversations: plain transcripts, chat exports, mail and subtitles, as DataFrames of turns.

Inputs are DataFrames with ``path`` and ``content``; outputs have path, conversation, turn_no, speaker, text, occurred_at.
"""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value

TURNS = "path string, conversation int, turn_no int, speaker string, text string, occurred_at string"
WHATSAPP = r"^\[?(\d{1,4}[./-]\d{1,2}[./-]\d{1,4}),? (\d{1,2}:\d{2}(?::\d{2})?(?:[   ]?[APap]\.?[Mm]\.?)?)\]?(?: -)? ?(?:([^:\n]{1,80}): )?(.*)$"
SUBTITLE_TIME = r"^\s*(?:\d+:)?\d{1,2}:\d{2}[.,]\d{3}\s+-->"


def chat_format(head: Column) -> Column:
    """Which chat export a file is, from its first characters."""
    return (
        F.when(head.contains('"text_entities"') | (head.contains('"messages"') & head.contains('"date_unixtime"')), "telegram").when(head.contains('"guild"') | (head.contains('"channel"') & head.contains('"author"')), "discord")
        .when(head.rlike(r'"ts"\s*:\s*"\d+\.\d+"'), "slack").when(head.rlike("(?m)" + WHATSAPP), "whatsapp").when(head.rlike(r"(?m)^WEBVTT|" + SUBTITLE_TIME), "subtitle").when(head.rlike(r"(?m)^From .+ \d{4}$|(?mi)^(?:message-id|received|from): "), "mail").otherwise("text")
    )


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+\z", ""), r"\r\n|\r|\n")).alias("pos", "line"))


def _folded(lines: DataFrame, head: Column) -> DataFrame:
    """Lines with ``msg``: how many heads have been seen up to each, so that continuations share their head's number."""
    return lines.withColumn("is_head", head.cast("int")).withColumn("msg", F.sum("is_head").over(W.partitionBy("path").orderBy("pos")))


def whatsapp(files: DataFrame) -> DataFrame:
    """Messages of chat texts; lines without a stamp continue the message before, system lines are dropped with theirs."""
    part = lambda i: F.regexp_extract("line", WHATSAPP, i)
    marked = _folded(_lines(files), F.col("line").rlike(WHATSAPP)).where("msg > 0")
    head = marked.where("is_head = 1").select("path", "msg", part(1).alias("d"), part(2).alias("t"), part(3).alias("speaker"), part(4).alias("first"))
    rest = marked.where("is_head = 0").groupBy("path", "msg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("more"))
    joined = head.join(rest, ["path", "msg"], "left").where("speaker <> ''")
    n = F.row_number().over(W.partitionBy("path").orderBy("msg"))
    return joined.select("path", F.lit(0).alias("conversation"), n.alias("turn_no"), "speaker", F.concat_ws("\n", F.col("first"), F.col("more")).alias("text"), F.concat_ws(", ", "d", "t").alias("occurred_at"))


def speaker_lines(files: DataFrame) -> DataFrame:
    """``Name: text`` blocks; lines without a name continue the block."""
    pattern = r"^([^\W\d_][^:\n]{0,40}): ?(.*)$"
    marked = _folded(_lines(files), F.col("line").rlike(pattern)).where("msg > 0")
    said = F.when(F.col("is_head") == 1, F.regexp_extract("line", pattern, 2)).otherwise(F.col("line"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("l")))), lambda x: x["l"]), "\n")
    who = F.max(F.when(F.col("is_head") == 1, F.regexp_extract("line", pattern, 1)))
    return marked.groupBy("path", "msg").agg(who.alias("speaker"), F.trim(texts).alias("text")).select("path", F.lit(0).alias("conversation"), F.col("msg").cast("int").alias("turn_no"), "speaker", "text", F.lit(None).cast("string").alias("occurred_at"))


_TELEGRAM = "messages array<struct<id:long, type:string, `from`:string, date:string, date_unixtime:string, text_entities:array<struct<text:string>>>>"
_DISCORD = "messages array<struct<id:string, type:string, timestamp:string, content:string, author:struct<name:string, nickname:string>>>"
_SLACK = "array<struct<type:string, subtype:string, user:string, text:string, ts:string>>"


def _numbered(exploded: DataFrame) -> DataFrame:
    return exploded.withColumn("turn_no", F.row_number().over(W.partitionBy("path").orderBy("pos"))).select("path", F.lit(0).alias("conversation"), "turn_no", "speaker", "text", "occurred_at")


def telegram(files: DataFrame) -> DataFrame:
    m = files.select("path", F.posexplode(F.from_json("content", _TELEGRAM)["messages"]).alias("pos", "m")).where("m.type = 'message'")
    stamp = F.date_format(F.timestamp_seconds(F.col("m.date_unixtime").try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.array_join(F.transform("m.text_entities", lambda e: e["text"]), "")
    return _numbered(m.select("path", "pos", F.col("m.from").alias("speaker"), text.alias("text"), F.coalesce(stamp, F.col("m.date")).alias("occurred_at")).where("text <> ''"))


def discord(files: DataFrame) -> DataFrame:
    m = files.select("path", F.posexplode(F.from_json("content", _DISCORD)["messages"]).alias("pos", "m")).where("m.type IN ('Default', 'Reply')")
    return _numbered(m.select("path", "pos", F.coalesce(F.nullif("m.author.nickname", F.lit("")), "m.author.name").alias("speaker"), F.col("m.content").alias("text"), F.col("m.timestamp").alias("occurred_at")).where("text <> ''"))


def slack(files: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Messages without a subtype; ``users`` (id, name) turns ids and mentions into names."""
    m = files.select("path", F.posexplode(F.from_json("content", _SLACK)).alias("pos", "m")).where("m.type = 'message' AND m.subtype IS NULL AND m.text <> ''")
    stamp = F.date_format(F.timestamp_seconds(F.col("m.ts").try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    plain = F.regexp_replace(F.regexp_replace("m.text", r"<(https?://[^|>]+)\|([^>]+)>", "$2"), r"<(https?://[^>]+)>", "$1")
    rows = m.select("path", "pos", F.col("m.user").alias("user"), plain.alias("text"), stamp.alias("occurred_at"))
    if users is None:
        return _numbered(rows.withColumnRenamed("user", "speaker"))
    named = rows.join(users.select(F.col("id").alias("__i"), F.col("name").alias("__n")), rows["user"] == F.col("__i"), "left")
    said = named.select("path", "pos", F.coalesce("__n", "user").alias("speaker"), "text", "occurred_at")
    marks = said.select("path", "pos", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"<@([A-Z0-9]+)>"), F.lit(1)))).alias("__i")).join(users.select(F.col("id").alias("__i"), "name"), "__i")
    maps = marks.groupBy("path", "pos").agg(F.collect_list(F.struct("__i", "name")).alias("__m"))
    joined = said.join(maps, ["path", "pos"], "left")
    spelt = F.aggregate(F.coalesce("__m", F.array()), F.col("text"), lambda t, x: F.replace(t, F.concat(F.lit("<@"), x["__i"], F.lit(">")), F.concat(F.lit("@"), x["name"])))
    return _numbered(joined.withColumn("text", spelt))


def subtitles(files: DataFrame) -> DataFrame:
    """Cues of srt and vtt files; a cue that repeats the one kept before it is dropped; cue times are no dates."""
    marked = _folded(_lines(files), F.col("line").rlike(SUBTITLE_TIME)).where("msg > 0 AND is_head = 0 AND line <> '' AND NOT line RLIKE '^\\\\d+$'")
    joined = marked.groupBy("path", "msg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("raw"))
    speaker = F.nullif(F.regexp_extract("raw", r"<v ([^>]+)>", 1), F.lit(""))
    text = F.trim(F.regexp_replace("raw", r"<[^>]*>", ""))
    cues = joined.select("path", "msg", speaker.alias("speaker"), text.alias("text")).where("text <> ''")
    fresh = cues.withColumn("last", F.lag("text").over(W.partitionBy("path").orderBy("msg"))).where("last IS NULL OR last <> text")
    return fresh.select("path", F.lit(0).alias("conversation"), F.row_number().over(W.partitionBy("path").orderBy("msg")).alias("turn_no"), "speaker", "text", F.lit(None).cast("string").alias("occurred_at"))


_QUOTED = re.compile(r"(?m)^(?:>.*|On .{0,200} wrote:)\n?")


def _mails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            raw = (content or "").replace("\r\n", "\n")
            pieces = re.split(r"(?m)^From \S+ .*\d{4}$\n", raw) if raw.startswith("From ") else [raw]
            threads: dict[str, int] = {}
            turns: dict[int, int] = {}
            for piece in filter(str.strip, pieces):
                m = email.message_from_string(re.sub(r"(?m)^>(>*From )", r"\1", piece), policy=email.policy.default)
                own = (m["Message-ID"] or "").strip()
                root = ((m["References"] or "").split() or [(m["In-Reply-To"] or "").strip() or own])[0]
                body = m.get_body(preferencelist=("plain", "html"))
                text = _QUOTED.sub("", body.get_content() if body else "").strip()
                k = threads.setdefault(root, len(threads))
                turns[k] = turns.get(k, 0) + 1
                subject = m["Subject"]
                rows.append((path, k, turns[k], str(m["From"] or ""), f"Subject: {subject}\n\n{text}" if subject and turns[k] == 1 else text, str(m["Date"] or "") or None))
        yield pd.DataFrame(rows, columns=["path", "conversation", "turn_no", "speaker", "text", "occurred_at"])


def mails(files: DataFrame) -> DataFrame:
    """Mails of eml and mbox files, one conversation per thread root in order of appearance, quotes cut."""
    return files.select("path", "content").mapInPandas(_mails, TURNS)


by_value(__name__)
