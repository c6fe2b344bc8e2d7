"""Multi-party chat formatting by perspective rotation, with DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the
assistant, the others as named users and system turns as they are; the mask
marks the assistant's words.  A dialogue is one row for each participant.  After
SPAN turns a further row (``chunk``) goes on where the one before ends: their
texts, laid end to end in order of the chunk, are the whole dialogue, and no row
has more turns.  The turns of long dialogues are numbered by a sort in ranges, so
none is one task.

Rendered text: ``<|role name=speaker|>`` line break, content, ``<|end|>`` line
break for each turn.  ``<|`` in a content is written ``< |`` so that no content
opens a turn; in a name ``% < > |`` and line breaks are written ``%25 %3C %3E %7C
%0A %0D``, so different speakers always have different names.

Defined cases: a null or blank role is the speaker "unknown"; a null text is
empty; a null turn sorts before all others; equal turn numbers are ordered by
speaker and content; repeated rows are one turn; a conversation with system turns
alone has no perspective; a row without a conv_id is a dialogue of its own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Turns of one row.
SPAN = 1024
#: What a name may not hold as it is.
ESCAPES = {"%": "%25", "<": "%3C", ">": "%3E", "|": "%7C", "\n": "%0A", "\r": "%0D"}


def turns(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, chunk, turn, speaker, is_system, content of the turns that have a conv_id; short dialogues may repeat a turn."""
    speaker = F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit("unknown"))
    content = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), (F.lower(speaker) == "system").alias("is_system"), content.alias("content"))
    known = rows.where("conv_id IS NOT NULL")
    long = known.groupBy("conv_id").count().where(F.col("count") > span).select("conv_id")
    short = known.join(long, "conv_id", "left_anti").withColumn("chunk", F.lit(0).cast("long"))
    apart = rows.where("conv_id IS NULL").distinct().withColumn("chunk", F.lit(None).cast("long"))
    return short.unionByName(_chunked(known.join(long, "conv_id", "left_semi").distinct(), span)).unionByName(apart)


def _chunked(rows: DataFrame, span: int) -> DataFrame:
    """Turns of long dialogues with the number of their row of ``span`` turns."""
    placed = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "speaker", "content").withColumn("at", F.monotonically_increasing_id())
    placed = shared.stored(placed, "turns-sorted").withColumn("part", F.shiftright("at", 33))
    spans = placed.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift"))
    return placed.join(spans, ["conv_id", "part"]).withColumn("chunk", F.floor((F.col("at") + F.col("shift")) / span)).select(*rows.columns, "chunk")


def _named(speaker: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(ESCAPES[x])), ESCAPES, speaker)


def rotate(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, perspective, chunk, messages (turn, role, name, content, mask), text, spans of the mask in code points."""
    said = turns(conversations, span)
    # text moves once, to the span it belongs to; speakers are joined afterwards
    message = F.struct("turn", "speaker", "is_system", "content")
    known = said.where("conv_id IS NOT NULL")
    spans = known.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_set(message)).alias("said"))
    people = known.where("NOT is_system").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    rows = spans.join(people, "conv_id").select("conv_id", "chunk", "said", "perspective")
    apart = said.where("conv_id IS NULL AND NOT is_system")
    rows = rows.unionByName(apart.select("conv_id", F.lit(0).cast("long").alias("chunk"), F.array(message).alias("said"), F.col("speaker").alias("perspective")))
    own = lambda m: ~m.is_system & (m.speaker == F.col("perspective"))
    role = lambda m: F.when(m.is_system, "system").when(own(m), "assistant").otherwise("user")
    name = lambda m: F.when(~m.is_system & ~own(m), _named(m.speaker))
    rows = rows.withColumn("messages", F.transform("said", lambda m: F.struct(m.turn.alias("turn"), role(m).alias("role"), name(m).alias("name"), m.content.alias("content"), own(m).cast("int").alias("mask"))))
    head = lambda m: F.concat(F.lit("<|"), m.role, F.when(m["name"].isNull(), "").otherwise(F.concat(F.lit(" name="), m["name"])), F.lit("|>\n"))
    tail = "<|end|>\n"
    text = F.array_join(F.transform("messages", lambda m: F.concat(head(m), m.content, F.lit(tail))), "")
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def step(done: Column, m: Column) -> Column:
        start = done.at + F.length(head(m))
        stop = start + F.length(m.content)
        more = F.array_append(done.found, F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct((stop + len(tail)).alias("at"), F.when(m.mask == 1, more).otherwise(done.found).alias("found"))

    spans_of = F.aggregate("messages", nothing, step, lambda done: done.found)
    return rows.select("conv_id", "perspective", "chunk", "messages", text.alias("text"), spans_of.alias("spans"))
