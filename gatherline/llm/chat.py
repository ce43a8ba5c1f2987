"""Chat formatting: conversations folded from their event logs, rendered with marked turns, and read back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks, and all strings that chat templates take for control.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    """Backslashes doubled and one put behind the first character of each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescaped(text: Column) -> Column:
    """The inverse: of a backslash and the character behind it, the character stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def folded(events: DataFrame) -> DataFrame:
    """Messages ``(conv_id, turn, part, role, text)`` from a log ``(conv_id, seq, turn, kind, role, text)``.

    Kinds, in order of ``seq`` inside a conversation: ``message`` adds a whole message at its turn; ``delta`` appends
    to the turn's latest message; ``edit`` replaces all that the turn had; ``regenerate`` does so too and drops what
    later turns had before it. Events of one ``seq`` and turn follow by role and text. Null text counts as empty and
    a null role as that of the turn's earlier events, else empty; null turns come first; null conv_ids are one
    conversation. ``seq`` is of any type that has an order. Texts of any length are folded whole. Windows go over
    single turns; only turn totals are ordered within a conversation.
    """
    log = events.select("conv_id", "seq", "turn", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    per_turn = Window.partitionBy("conv_id", "turn")
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    cuts = log.groupBy("conv_id", "turn").agg(again.alias("seq")).withColumn("seq", F.max("seq").over(earlier)).where("seq IS NOT NULL")
    # cuts travel to their turns as rows of the log, so texts move once
    log = log.unionByName(cuts.withColumns({"kind": F.lit("cut"), "role": F.lit(None).cast("string"), "text": F.lit("")}))
    last = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("seq"))).over(per_turn)
    log = log.withColumns({"reset": last("edit", "regenerate"), "cut": last("cut")})
    log = log.where("kind IS DISTINCT FROM 'cut' AND (cut IS NULL OR seq > cut) AND (reset IS NULL OR seq >= reset)")
    in_order = per_turn.orderBy(F.col("seq").asc_nulls_first(), F.col("role").asc_nulls_first(), "text").rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumn("part", F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(in_order)).withColumn("at", F.count("*").over(in_order))
    each = F.array_sort(F.collect_list(F.struct("at", "role", "text")))
    out = log.groupBy("conv_id", "turn", "part").agg(each.alias("e"))
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull())
    return out.select("conv_id", "turn", "part", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform("e", lambda x: x["text"]), "").alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """A row a conversation: ``conv_id, formatted, turns``; ``turns`` has ``(role, start, length, loss)`` of each text.

    ``start`` and ``length`` are code points of ``formatted``, where texts stand escaped; ``loss`` marks assistants.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    m = messages.select("conv_id", "turn", "part", "role", F.concat(F.lit(START), escaped(F.col("role")), F.lit(MIDDLE)).alias("head"), escaped(F.col("text")).alias("body"))
    m = m.withColumn("before", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(order), F.lit(0)).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "part", "before", "role", "head", "body")), lambda a, b: F.when(a["before"] < b["before"], -1).when(a["before"] > b["before"], 1).otherwise(0))
    out = m.groupBy("conv_id").agg(rows.alias("r"))
    formatted = F.array_join(F.transform("r", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    turns = F.transform("r", lambda x: F.struct(x["role"].alias("role"), (x["before"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"), (x["role"] == "assistant").alias("loss")))
    return out.select("conv_id", formatted.alias("formatted"), turns.alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, messages, learned, formatted_chars`` from the output alone: roles and texts by the marks, and the texts under the mask."""
    cut = F.split("formatted", re.escape(END), -1)
    parts = F.slice(cut, 1, F.size(cut) - 1)
    out = formatted.select("conv_id", "turns", parts.alias("parts"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    halves = lambda p: F.split(p, re.escape(MIDDLE), 2)
    message = F.transform("parts", lambda p: F.struct(unescaped(F.substr(F.get(halves(p), F.lit(0)), F.lit(len(START) + 1))).alias("role"), unescaped(F.get(halves(p), F.lit(1))).alias("text")))
    # a part begins where the turn before it ended; the mask's place is taken relative to that
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("turns", i - 1)["start"] + F.get("turns", i - 1)["length"] + len(END))
    under = F.transform("parts", lambda p, i: F.when(F.get("turns", i)["loss"], F.substr(p, F.get("turns", i)["start"] - begin(i) + 1, F.get("turns", i)["length"])))
    learned = F.transform(F.filter(under, lambda x: x.isNotNull()), unescaped)
    return out.select("conv_id", message.alias("messages"), learned.alias("learned"), "formatted_chars")


def format_conversations(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns`` of every conversation in an event log; an empty log gives no rows."""
    return rendered(folded(events))


def digests(formatted: DataFrame) -> DataFrame:
    out = read_back(formatted)
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return out.select("conv_id", F.size("messages").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole messages ``(conv_id, turn, role, text)`` as an event log, in order of turn."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")


def as_streamed(conversations: DataFrame) -> DataFrame:
    """The same table as the log of chats that were streamed, which folds to the same messages as ``as_events``.

    The first row of a turn, by role and text, was a draft of an eighth of its text, then its first half took the
    draft's place (``regenerate`` for assistants, ``edit`` for others) and a ``delta`` brought the rest; before an
    assistant's regeneration the next turn had a message that it drops. Further rows of a turn are messages of a half
    and a delta. Positions in the log are structs of turn, row and step, so no conversation is numbered as a whole.
    """
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.coalesce(role, F.lit("")), text))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", text.alias("text")).withColumn("nth", nth)
    half = F.ceil(F.length("text") / 2).cast("int")
    first, assistant = F.col("nth") == 1, F.col("role").eqNullSafe(F.lit("assistant"))
    stale = first & assistant & (F.col("turn") < (1 << 63) - 1)

    def event(step: int, kind: Column, text: Column, when: Column | None = None, turn: Column | None = None) -> Column:
        seq = F.struct(F.col("turn").alias("turn"), F.col("nth").alias("nth"), F.lit(step).alias("step"))
        made = F.struct(seq.alias("seq"), (F.col("turn") if turn is None else turn).alias("turn"), kind.alias("kind"), role.alias("role"), text.alias("text"))
        return made if when is None else F.when(when, made)

    log = F.array(
        event(0, F.lit("message"), F.substr("text", F.lit(1), F.floor(F.length("text") / 8).cast("int")), first),
        event(1, F.lit("message"), F.lit("dropped"), stale, F.when(stale, F.col("turn") + 1)),
        event(2, F.when(~first, "message").when(assistant, "regenerate").otherwise("edit"), F.substr("text", F.lit(1), half)),
        event(3, F.lit("delta"), F.substr("text", half + 1)),
    )
    return rows.select("conv_id", F.explode(F.array_compact(log)).alias("e")).select("conv_id", "e.*")


def _escaped_sql(text: str) -> str:
    text = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
    return text


ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
texts AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learned,
         sum({len(START + MIDDLE + END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")}))::BIGINT AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM texts
"""
