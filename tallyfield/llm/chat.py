"""Chat formatting from event logs.

A conversation is a log of events: ``open`` starts a message, ``delta`` appends to it, ``regenerate``
empties it, ``edit`` replaces it, ``delete`` takes it away. Events of a message are sorted by sequence
and folded into its final text; messages are rendered with marks around every turn. Inside texts and
roles the escape character and the brackets of the marks are escaped, so reading back is exact. The
loss mask is a list of code point spans over the rendered text.

Everything is column expressions. A conversation is one row of the result, so its size is bounded by
what a row may hold; nothing larger than one conversation meets in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, SEAL, CLOSE = "<turn ", ">\n", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))  # the escape character first


def escaped(c: Column) -> Column:
    """Text without brackets; every backslash begins an escape."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def unescaped(c: Column) -> Column:
    """Inverse of :func:`escaped`."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), c)


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, role, text): final messages from (conv_id, turn, nth, seq, kind, role, text).

    A message is (turn, nth) of a conversation. Its text is that of its last open, edit or regenerate
    and all later deltas; null texts are empty; the role is the last one given. A message whose last
    such event is ``delete`` is left out. Events of equal sequence go by kind and text.
    """
    e = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    per = events.groupBy("conv_id", "turn", "nth").agg(F.sort_array(F.collect_list(e)).alias("log"))
    reset = F.array_max(
        F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(-1)))
    )
    per = per.withColumn("reset", reset)
    live = F.filter("log", lambda x, i: i >= F.col("reset"))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    text = F.array_join(F.transform(live, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "")
    gone = F.coalesce(F.get("log", F.col("reset"))["kind"] == "delete", F.lit(False))
    return per.where(~gone).select(
        "conv_id", "turn", "nth", F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"), text.alias("text")
    )


def rendered(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) from messages in order of turn and nth.

    ``loss_spans`` holds (start, size) of each text of the role to learn, in code points.
    """
    body = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), escaped(F.coalesce("role", F.lit(""))), F.lit(SEAL))
    m = messages.select("conv_id", "turn", "nth", (F.col("role") == learn).alias("learn"), head.alias("head"), body.alias("body"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("turn", "nth").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head")
    m = m.withColumn("start", at)
    span = F.when(F.col("learn"), F.struct("start", F.length("body").cast("long").alias("size")))
    return m.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "nth", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    ).select("conv_id", F.array_join("pieces.piece", "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, learn) of every turn of rendered conversations.

    Turns are found by the marks alone and tested against the spans by their place in the text.
    """
    parts = F.split("formatted", CLOSE)
    turns = formatted.select("conv_id", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("pos", "part"))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("part").cast("long") + len(CLOSE)).over(before), F.lit(0))
    role = F.substring_index(F.substr("part", F.lit(len(OPEN) + 1)), SEAL, 1)
    turns = turns.select("conv_id", "pos", "part", role.alias("role"), (at + len(OPEN) + len(SEAL) + F.length(role)).alias("start"))
    body = F.substr("part", F.length("role") + (len(OPEN) + len(SEAL) + 1))
    turns = turns.select("conv_id", "pos", "role", "start", body.alias("body"))
    spans = formatted.select(F.col("conv_id").alias("c"), F.explode("loss_spans").alias("s")).select("c", "s.start", "s.size")
    on = turns["conv_id"].eqNullSafe(spans["c"]) & (turns["start"] == spans["start"]) & (F.length("body") == spans["size"])
    return turns.join(spans, on, "left").select(
        "conv_id", "pos", unescaped(F.col("role")).alias("role"), unescaped(F.col("body")).alias("text"), F.col("size").isNotNull()
    ).toDF("conv_id", "pos", "role", "text", "learn")


def log_of(rows: DataFrame) -> DataFrame:
    """A log whose fold is ``rows`` (conv_id, turn, role, text), with streaming, edits and retries.

    Rows of equal conversation and turn are messages of their own, in order of role and text.
    """
    text = F.coalesce("text", F.lit(""))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", text))
    r = rows.select("conv_id", "turn", "role", text.alias("t"), nth.alias("nth"))
    half = (F.length("t") / 2).cast("int")
    first, rest = F.substr("t", F.lit(1), half), F.substr("t", half + 1)

    def event(seq: int, kind: str, x: Column, role: Column | None = None) -> Column:
        given = F.lit(None).cast("string") if role is None else role
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), x.alias("text"), given.alias("role"))

    none, who = F.lit(""), F.col("role")
    retried = F.array(event(0, "open", none, who), event(1, "delta", rest), event(2, "regenerate", none), event(3, "delta", first), event(4, "delta", rest))
    edited = F.array(event(0, "open", none, who), event(1, "delta", first), event(2, "edit", F.col("t")))
    log = F.when(F.col("role") == "assistant", retried).otherwise(edited)
    return r.select("conv_id", "turn", "nth", F.explode(log).alias("e")).select("conv_id", "turn", "nth", "e.*")


def digests(turns: DataFrame, formatted: DataFrame) -> DataFrame:
    """Counts and checksums of what was read back, per conversation."""
    t = F.sort_array(F.collect_list(F.struct("pos", "role", "text", "learn")))
    per = turns.groupBy("conv_id").agg(t.alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("t", lambda x: x["learn"]), lambda x: x["text"]), "")
    per = per.select(F.col("conv_id").alias("c"), F.size("t").cast("long").alias("n_turns"), said.alias("said"), learnt.alias("learnt"))
    chars = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))
    return chars.join(per, chars["conv_id"].eqNullSafe(per["c"])).select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )
