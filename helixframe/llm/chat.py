r"""Chat formatting by event-sourced reconstruction (operator 10). DataFrame functions only.

Method. The input is a log of events (conv_id, seq, message, kind, role, text). It is partitioned by conversation and
ordered by sequence, then folded:

- ``message`` and ``edit`` set a message's text and role, ``regenerate`` sets them and discards the later messages that
  are there, ``delete`` removes the message, ``delta`` appends to the message or, where there is none, begins one;
- an event's place is its sequence number; ties go by message, kind, role and text.

What is left of a message depends on its last setting or removing event and on the deltas after it. So an aggregation by
(conversation, message) takes that event and gathers the deltas; a running maximum over a conversation's messages says when one
before was last regenerated, which removes what a message had then; and the deltas after both are joined to the text.
Then the messages of a conversation are ordered and rendered. A conversation's text is one output value, so its own
messages do meet in one row; nothing else does.

Template: ``### `` role ``:`` newline text ``</turn>`` newline, for each message. In texts and roles ``\`` is written ``\\``,
``</turn>`` is ``\e`` and ``### `` is ``\h``; in roles a colon is ``\c`` as well. Marks then occur only where the
template puts them, so a formatted conversation is cut at ``</turn>`` newline and unescaped without loss. The loss mask is a
list of (start, length) spans, in code points of the formatted text, one for each assistant text.

Defined results: a null text or role counts as empty; null conversation ids make one conversation; null sequence numbers
come first; repeated rows make a message each in a table of turns; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

HEAD, TAIL = "### ", "</turn>"
SETS = ("message", "edit", "regenerate")


def escaped(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(TAIL), F.lit("\\e")), F.lit(HEAD), F.lit("\\h"))
    return F.replace(c, F.lit(":"), F.lit("\\c")) if role else c


def unescaped(c: Column) -> Column:
    def part(x: Column) -> Column:
        return F.replace(F.replace(F.replace(x, F.lit("\\e"), F.lit(TAIL)), F.lit("\\h"), F.lit(HEAD)), F.lit("\\c"), F.lit(":"))

    # pairs of backslashes are taken off first, from the left
    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the final messages of event logs."""
    e = events.select(
        "conv_id", F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("seq"), F.col("message").cast("long").alias("message"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    place = F.struct("seq", "kind", "role", "text")
    one = e.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("kind").isin(*SETS, "delete"), place)).alias("base"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", place))).alias("deltas"),
    )
    # at one sequence number, events of earlier messages come first: what a message has from the cut on is after it
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.coalesce("cut", F.lit(-(1 << 63)))
    one = one.withColumn("cut", F.max("again").over(before)).select(
        "conv_id", "message", F.when((F.col("base.seq") >= cut) & (F.col("base.kind") != "delete"), F.col("base")).alias("set"),
        F.filter("deltas", lambda d: (F.col("base").isNull() | (d > F.col("base"))) & (d["seq"] >= cut)).alias("later"),
    )
    return one.where("set is not null or size(later) > 0").select(
        "conv_id", "message", F.coalesce("set.role", F.col("later")[0]["role"]).alias("role"), F.concat(F.coalesce("set.text", F.lit("")), F.array_join(F.transform("later", lambda d: d["text"]), "")).alias("text")
    )


def as_events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of turns as a log of message events; rows that tie on the turn go by role, then text."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t.select("conv_id", F.row_number().over(order).alias("seq"), F.row_number().over(order).alias("message"), F.lit("message").alias("kind"), "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the formatted conversation and the spans of the loss mask."""
    m = messages.select("conv_id", F.struct(F.col("message"), F.concat(F.lit(HEAD), escaped(F.col("role"), role=True), F.lit(":\n")).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("mask")).alias("m"))
    c = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    formatted = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(TAIL + "\n"))), "")
    sizes = "transform(m, x -> struct(cast(length(x.head) as long) as h, cast(length(x.body) as long) as b, x.mask as mask))"
    spans = f"""aggregate({sizes}, struct(cast(0 as long) as at, cast(array() as array<struct<start:bigint,length:bigint>>) as spans),
        (s, x) -> struct(s.at + x.h + x.b + {len(TAIL) + 1} as at, if(x.mask, concat(s.spans, array(struct(s.at + x.h as start, x.b as length))), s.spans) as spans), s -> s.spans)"""
    return c.select("conv_id", formatted.alias("formatted"), F.expr(spans).alias("loss"))


def parse(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted conversation."""
    pieces = F.split(formatted, "</turn>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        p = F.substr(p, F.lit(len(HEAD) + 1))
        at = F.instr(p, ":\n")
        return F.struct(unescaped(F.substr(p, F.lit(1), at - 1)).alias("role"), unescaped(F.substr(p, at + 2)).alias("text"))

    return F.transform(pieces, turn)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = stash(render(fold(as_events(turns.unionByName(own)))), "chat")
    got = back.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "").alias("under"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2(F.encode("under", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars"
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '### ', '\h'), ':', '\c'))
              + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '### ', '\h')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
