"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that speaker as assistant and
all others as named users.  A rendered dialogue is a run of segments, one a message,
with the character offsets of each and of what is trained on; the segments of one
perspective, joined in order, are its text.  As no task ever holds a dialogue, its
length has no bound.

Offsets come from lengths alone: texts stay where they are until the offsets are
known, and each message's text is shuffled once, however many perspectives show it.
Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .prefix import prefix_sums

#: Marks of a rendered message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """The text with a backslash more inside whatever begins like a mark, so no text
    ends its own turn or begins another; taking one backslash away restores it."""
    return F.regexp_replace(text, r"<(\\*)\|im_", r"<\\$1|im_")


def shown_name(speaker: Column) -> Column:
    """A speaker in a header: marks escaped, control characters as a space."""
    return F.regexp_replace(escaped(speaker), r"[\x00-\x1F]+", " ")


def rotate(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """A row for each message of each perspective: ``conv``, ``perspective``,
    ``position`` (from 0), ``turn``, ``role`` (assistant, user or system), ``name``
    (null but for users), ``segment``, ``char_start``, ``char_end``, ``mask_start`` and
    ``mask_end`` (what is trained on: the assistant's text and its closing mark; null
    elsewhere).  Offsets count characters from the start of the rendered dialogue.

    Speakers named in ``narrators`` are no participants: they keep role system in
    every perspective.  A null speaker is the participant ''.  A null text is
    rendered as empty.  Marks in texts and speakers are escaped (``escaped``), and a
    speaker's line breaks are a space in the header; ``name`` and ``perspective`` keep
    the speaker as it is.  Messages stand by turn (nulls first), then speaker, then the
    text's MD5, and repeated rows stay.  Null conversations are one conversation.  A
    dialogue of narrators alone has no perspective and gives no rows, like an empty
    table.  Other columns, whatever their names, play no part.
    """
    scratch = Scratch(messages.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit("")).alias("speaker"), F.md5(body.cast("binary")).alias("tid"), body.alias("text"))
    # What offsets need of a message; its text is found again by a digest of all of its columns.
    key = F.md5(F.to_json(F.struct("conv", "turn", "speaker", "tid"), {"ignoreNullFields": "false"}))
    rows = rows.withColumn("mid", key)
    lengths = scratch.cut(rows.select("conv", "turn", "speaker", "tid", "mid", F.length(escaped(F.col("text"))).cast("long").alias("body")))
    narrates = F.col("speaker").isin(*narrators) if narrators else F.lit(False)
    who = lengths.where(~narrates).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = lengths.join(who, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(narrates, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), shown_name(F.col("speaker")))).otherwise(F.lit("")), F.lit("\n"))
    seen = seen.withColumn("role", role).withColumn("head", F.length(head).cast("long")).withColumn("chars", F.col("head") + F.col("body") + len(CLOSE))
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("tid")]
    placed = prefix_sums(seen, ["conv", "perspective"], order, ["chars"], scratch)
    # Equal messages of a conversation have one text: repeats are one row of this side.
    texts = rows.groupBy("mid").agg(F.min("text").alias("text"))
    trained = F.col("role") == "assistant"
    end = F.col("chars_before") + F.col("chars")
    return placed.drop("tid").join(texts, "mid").select(
        F.col("conv").alias(conv),
        "perspective",
        F.col("row_before").alias("position"),
        F.col("turn").alias(turn),
        "role",
        F.when(F.col("role") == "user", F.col("speaker")).alias("name"),
        F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("segment"),
        F.col("chars_before").alias("char_start"),
        end.alias("char_end"),
        F.when(trained, F.col("chars_before") + F.col("head")).alias("mask_start"),
        F.when(trained, end - 1).alias("mask_end"),
    )
