"""Chat formatting: fold a log of conversation events into messages, then render them with a template whose text can be read back.

DataFrame functions only. An event has conv_id, msg (any orderable message key), seq, kind and text, and the opening event the role:

- open: the message begins, its role is known, text is its first text
- delta: text is appended
- edit: text replaces all that the message held
- regenerate: the message starts over from text

Events of a message are folded by seq. Defined results: a null text counts as empty, a null role as the empty role; events with the same seq are
taken in the order open, regenerate, edit, delta, then by text; equal rows are each applied. A message without an opening event has the empty
role. Messages of a conversation stand by their first seq, then by msg. A null conv_id is a conversation of its own. Further columns are
ignored. An empty table gives an empty result.

The messages are built by (conv_id, msg), before whole conversations come together, so that a long log is folded in many tasks; only the
rendered text of one conversation is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import table

BEGIN, ROLE_END, END = "<s>", "[/ROLE]", "</s>"
RANK = {"open": 0, "regenerate": 1, "edit": 2, "delta": 3}
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    """No control string of the template can occur in the result, as it holds neither < nor [."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, seq (of its first event), role, text, n_events."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in RANK.items()], F.lit(3))
    e = events.select("conv_id", "msg", "seq", rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("seq", "rank", "text")))
    g = e.groupBy("conv_id", "msg").agg(
        parts.alias("parts"),
        F.max(F.when(F.col("rank").between(1, 2), F.struct("seq", "rank", "text"))).alias("reset"),
        F.min(F.when(F.col("rank") == 0, F.struct("seq", "role"))).alias("first"),
        F.min("seq").alias("seq"),
        F.count("*").alias("n_events"),
    )
    # what was before the last edit or regeneration is gone; equal resets give the same text once
    later = F.filter("parts", lambda p: F.col("reset").isNull() | (p > F.col("reset")))
    text = F.concat(F.coalesce(F.col("reset.text"), F.lit("")), F.array_join(F.transform(later, lambda p: p["text"]), ""))
    return g.select("conv_id", "msg", "seq", F.coalesce("first.role", F.lit("")).alias("role"), text.alias("text"), "n_events")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans, the code points [start, end) of formatted that bear loss."""
    piece = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(ROLE_END), escape(F.col("text")), F.lit(END))
    lead = len(BEGIN) + len(ROLE_END)
    m = messages.select(
        "conv_id",
        F.struct("seq", "msg", piece.alias("piece"), (F.col("role") == loss_role).alias("loss"), (F.char_length(escape(F.col("role"))) + lead).alias("head")).alias("m"),
    )
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    walk = F.aggregate(
        "ms",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["piece"])).alias("at"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), (acc["at"] + F.char_length(x["piece"]) - len(END)).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return g.select("conv_id", F.array_join(F.transform("ms", lambda x: x["piece"]), "").alias("formatted"), walk.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation, unescaped."""
    chunks = F.filter(F.split(formatted, END), lambda x: x != "")
    return F.transform(
        chunks,
        lambda x: F.struct(
            unescape(F.element_at(F.split(F.substr(x, F.lit(len(BEGIN) + 1)), r"\[/ROLE\]", 2), 1)).alias("role"),
            unescape(F.element_at(F.split(F.substr(x, F.lit(len(BEGIN) + 1)), r"\[/ROLE\]", 2), 2)).alias("text"),
        ),
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """What bears loss, read from a rendered conversation by its spans alone: unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


#: What a logged turn goes through, by its role: (kind, part of the text). Parts: nothing, the first, second or last third, or what is given up later.
STEPS = {
    "assistant": (("open", "none"), ("delta", "draft"), ("regenerate", "none"), ("delta", "first"), ("delta", "second"), ("delta", "last")),
    "other": (("open", "draft"), ("edit", "first"), ("delta", "second"), ("delta", "last")),
}


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A finished conversation table (conv_id, turn, role, text) as the log that an application would have written.

    An assistant's message streams a draft, is regenerated and streams its text in three deltas; another's is sent as a draft, then edited, and its text
    comes in an edit and two deltas. A draft is the text's last two thirds. Rows of equal conv_id and turn are messages of their own, by role, then text.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("msg", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    third = F.ceil(F.char_length("text") / 3).cast("int")
    t = t.withColumns({"first": F.substr("text", F.lit(1), third), "second": F.substr("text", third + 1, third), "last": F.substr("text", third * 2 + 1)})
    part = {"none": F.lit(""), "draft": F.concat("second", "last"), "first": F.col("first"), "second": F.col("second"), "last": F.col("last")}
    steps = {k: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), part[x].alias("text")) for i, (kind, x) in enumerate(v)]) for k, v in STEPS.items()}
    t = t.select("conv_id", "msg", "role", F.explode(F.when(F.col("role") == "assistant", steps["assistant"]).otherwise(steps["other"])).alias("e"))
    return t.select("conv_id", "msg", (F.col("msg") * 8 + F.col("e.i")).alias("seq"), "e.kind", "role", "e.text")


def digests(rendered: DataFrame) -> DataFrame:
    """render()'s rows as op10 returns them: turns are read back from formatted, what bears loss is cut from it by loss_spans."""
    r = rendered.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(render(fold_events(events_of_turns(c.unionByName(probe)))))


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), e AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS er,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS et FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(er) + length(et) + {len(BEGIN) + len(ROLE_END) + len(END)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op10_chat_format": op10_chat_format}
ORACLES = {"op10_chat_format": ORACLE}
