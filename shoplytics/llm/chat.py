"""Chat formatting with Spark expressions only.

A conversation's rows are collected as turn structs, sorted, and rendered with a
template; adjacent turns of one role share one marked block:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

Control strings inside a text are escaped: ``<`` + n backslashes + ``|`` gets one
backslash more, so no text holds ``<|`` and the reverse is unique.  In a role,
``%`` and line breaks become ``%25`` and ``%0A`` as well.

The result keeps the text in segments with a loss flag: the loss mask covers the
escaped text of every ``assistant`` turn and no marker.

Defined cases: null text or role is empty; null turn sorts first; rows of one
(conversation, turn) sort by role, then text, and all stay; rows with a null
conversation id form one conversation with a null id; an empty table gives no
rows; extra columns are ignored.  A formatted conversation is one value, so it
must fit in a row (2 GB in Spark); conversations are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplytics.llm.common import pick

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to one row per conversation: conv_id,
    segments array<struct<text, loss>>, formatted (the segments' texts joined)."""
    turns = (pick(rows, "conv_id", "turn", "role", "text")
             .withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
             .groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")))

    def render(t: Column, i: Column) -> Column:
        opens = ~t["role"].eqNullSafe(F.get("turns", i - 1)["role"])
        closes = ~t["role"].eqNullSafe(F.get("turns", i + 1)["role"])
        head = F.when(opens, F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(SEP)
        tail = F.when(closes, F.lit(END)).otherwise("")
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")),
                       F.struct(tail.alias("text"), F.lit(False).alias("loss")))

    segments = turns.select("conv_id", F.flatten(F.transform("turns", render)).alias("segments"))
    return segments.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` array<struct<role, text>>, parsed back from ``formatted``."""
    cut = formatted.withColumn(
        "_heads", F.transform(
            F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda b, i: i > 0),
            lambda b: F.struct(F.substring_index(b, "\n", 1).alias("role"), b.alias("block"))))
    parts = cut.withColumn(
        "turns", F.flatten(F.transform("_heads", lambda h: F.transform(
            F.split(_content(h), r"<\|im_sep\|>", -1),
            lambda p: F.struct(unescape_role(h["role"]).alias("role"), unescape(p).alias("text"))))))
    return parts.drop("_heads")


def _content(head: Column) -> Column:
    """The block without its role line and its end marker."""
    before = F.length(head["role"]) + 1
    return F.substr(head["block"], before + 1, F.length(head["block"]) - before - len(END))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted text and the loss mask say."""
    read = read_turns(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    out = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("_said"),
                      loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("_said", 256).alias("turns_sha256"),
                      F.length("_loss").cast("long").alias("loss_chars"),
                      F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
