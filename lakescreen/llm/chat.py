"""Chat formatting with a grammar round trip, in DataFrame functions only.

The grammar of a rendered conversation is

    conversation := turn*            turn := "<s>" role "\n" text "</s>" "\n"

``render`` writes the turns, ``parse`` reads them back with the same grammar: it splits at the end mark, takes the role up
to the first line break, and rejects a turn in which a control string is left. A backslash stands before a character that
is taken as it is. The first rendering copies all texts. Where the turns that are read back differ from the source, the
conflicting turns are escaped (backslashes doubled, a backslash after the first character of each control string); if a
difference were left, all turns would be escaped. What is returned is read from the rendering, never from the source.

Defined cases: a null text or role is empty; rows are ordered by turn (nulls first), then role, then text, so ties and
repeated rows keep a fixed order and are all kept; rows with a null conv_id form one conversation of their own; an empty
table gives no rows; other columns of the input are not read. One conversation is one rendered string, so its turns meet
in one row by the nature of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOT, EOT = "<s>", "</s>"
#: Strings that a tokenizer of this template's family reads as control tokens.
CONTROL = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Backslashes doubled, then a backslash put into each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conflicts(text: Column) -> Column:
    """Whether text, copied as it is, would be read back otherwise."""
    found = F.contains(text, F.lit("\\"))
    for mark in CONTROL:
        found = found | F.contains(text, F.lit(mark))
    return found


def render(turns: Column, level: int) -> Column:
    """level 0 copies texts, 1 escapes those that conflict, 2 escapes all."""

    def one(t: Column) -> Column:
        text = t["text"] if level == 0 else escape(t["text"]) if level == 2 else F.when(conflicts(t["text"]), escape(t["text"])).otherwise(t["text"])
        role = t["role"] if level == 0 else escape_role(t["role"])
        return F.concat(F.lit(BOT), role, F.lit("\n"), text, F.lit(EOT + "\n"))

    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """The turns of a rendering, with the span of each text in it (code points, end exclusive); null where the grammar fails."""
    head = r"(?s)^<s>((?:[^\\\n]++|\\.)*+)\n"
    parts = F.split(rendered, "</s>\n", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def step(acc: Column, part: Column) -> Column:
        opening = F.regexp_substr(part, F.lit(head))
        body = F.substring(part, F.length(opening) + 1, F.length(part))
        bad = opening.isNull()
        for mark in CONTROL:
            bad = bad | F.contains(body, F.lit(mark)) | F.contains(F.substring(opening, F.lit(4), F.length(opening)), F.lit(mark))
        start = acc["at"] + F.length(opening)
        turn = F.struct(
            unescape(F.regexp_extract(part, head, 1)).alias("role"),
            unescape(body).alias("text"),
            start.cast("long").alias("start"),
            (start + F.length(body)).cast("long").alias("end"),
        )
        return F.struct(
            (acc["at"] + F.length(part) + len(EOT) + 1).cast("long").alias("at"),
            (acc["ok"] & ~bad).alias("ok"),
            F.concat(acc["turns"], F.when(bad, F.expr("cast(array() as array<struct<role:string,text:string,start:bigint,end:bigint>>)")).otherwise(F.array(turn))).alias("turns"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok"), F.expr("cast(array() as array<struct<role:string,text:string,start:bigint,end:bigint>>)").alias("turns"))
    return F.aggregate(turns, zero, step, lambda acc: F.when(acc["ok"] & (F.element_at(parts, -1) == ""), acc["turns"]))


def plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chat(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, level (0 to 2), turns as read back, loss_spans into formatted."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("source"))
    out = grouped.select("conv_id", plain(F.col("source")).alias("source"))
    out = out.withColumn("formatted", render(F.col("source"), 0)).withColumn("turns", parse(F.col("formatted"))).withColumn("level", F.lit(0))
    for level in (1, 2):
        # what was read back is compared in an aggregate of its own, so that each rendering is parsed once
        same = F.coalesce(plain(F.col("turns")) == F.col("source"), F.lit(False))
        out = out.withColumn("same", same)
        out = out.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(render(F.col("source"), level)))
        out = out.withColumn("turns", F.when(F.col("same"), F.col("turns")).otherwise(parse(F.col("formatted"))))
        out = out.withColumn("level", F.when(F.col("same"), F.col("level")).otherwise(F.lit(level)))
    whole = F.coalesce(plain(F.col("turns")) == F.col("source"), F.lit(False))
    out = out.withColumn("turns", F.when(whole, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation is not read back as it was"))))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return out.select("conv_id", "formatted", "level", "turns", spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, cut from the rendering and unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
