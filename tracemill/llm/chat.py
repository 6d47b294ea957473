"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor turns each part of a message into text: a text part into its escaped text, an image, audio or document part
into a placeholder numbered by its place, with the number of tokens that it stands for; its reference and tokens are
recorded beside the output. No text can hold what looks like a placeholder or a mark of the template: all begin with "<".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed strings of the template. All begin with "<", which no escaped text holds.
TURN, BODY, LOSS, LOSS_END, END = "<|turn|>", "<|body|>", "<|loss|>", "<|/loss|>", "<|end|>"
#: Escapes, in the order in which they are applied.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))
PART = "struct<type:string,text:string,ref:string,tokens:long>"


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def text_part(text: Column) -> Column:
    """The content of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens")))


def placeholder(kind: Column, place: Column, tokens: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(escape(kind), F.lit("|"), F.lit("%7C")), F.lit(" "), place, F.lit(" "), tokens, F.lit("|>"))


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, n_turns, media_tokens.

    messages: conv_id, turn, role, parts (array of PART); other columns are ignored. Turns are ordered by turn, rows of
    one turn by role and text. loss_spans is an array of (start, end) in code points of formatted, over the bodies of
    loss_role. attachments is an array of (turn, place, type, ref, tokens) in order, media_tokens the sum of their tokens. A
    part is of type text, image, audio or document; one of another type is kept like these, with its type escaped, so it
    can't add to the template; a null type is text. A null role is empty, null parts or a null text are
    empty text, a null conv_id is a conversation of its own; repeated rows are repeated turns; no rows give no rows.
    """
    role = F.coalesce("role", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain")
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    rows = messages.select("conv_id", "turn", "role", parts.alias("parts"))
    rows = rows.withColumn("plain", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    rows = rows.withColumn("n", F.row_number().over(order) - 1)
    body = F.array_join(F.transform("parts", lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p["type"], F.concat_ws(".", F.col("n"), i), F.coalesce(p["tokens"], F.lit(0)).cast("string")))), "")
    head = F.concat(F.lit(TURN), escape(role), F.lit(BODY))
    is_loss = role == loss_role
    rows = rows.withColumn("body", body).withColumn("head", F.when(is_loss, F.concat(head, F.lit(LOSS))).otherwise(head))
    rows = rows.withColumn("piece", F.concat("head", "body", F.when(is_loss, F.lit(LOSS_END + END)).otherwise(F.lit(END))))
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.length("head")
    media = F.filter(F.transform("parts", lambda p, i: F.struct(F.col("n").cast("long").alias("turn"), i.cast("long").alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"))), lambda a: F.coalesce(a["type"], F.lit("text")) != "text")
    rows = rows.select("conv_id", F.struct("n", "piece", F.when(is_loss, F.struct(start.alias("start"), (start + F.length("body")).alias("end"))).alias("span"), media.alias("media")).alias("t"))
    turns = F.array_sort(F.collect_list("t"))
    chats = rows.groupBy("conv_id").agg(turns.alias("t"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda t: t["media"])).alias("attachments"),
        F.size("t").cast("long").alias("n_turns"),
    ).withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text, loss, parts).

    text is unescaped, with placeholders where they stand; parts is an array of (placeholder, text), one of them null, in
    which a placeholder and a text of the same characters are told apart.
    """
    quoted = lambda s: s.replace("|", r"\|")
    pieces = F.slice(F.split(formatted, quoted(TURN)), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        halves = F.split(F.replace(F.replace(piece, F.lit(END), F.lit("")), F.lit(LOSS_END), F.lit("")), quoted(BODY))
        loss = F.startswith(halves[1], F.lit(LOSS))
        body = F.replace(halves[1], F.lit(LOSS), F.lit(""))
        mark = lambda x: F.concat(F.substring_index(x, "|>", 1), F.lit("|>"))
        none = F.lit(None).cast("string")
        of_text = lambda x: F.struct(none.alias("placeholder"), unescape(x).alias("text"))
        split = lambda x: F.when(F.startswith(x, F.lit("<|")), F.array(F.struct(mark(x).alias("placeholder"), none.alias("text")), of_text(F.substr(x, F.length(mark(x)) + 1)))).otherwise(F.array(of_text(x)))
        parts = F.filter(F.flatten(F.transform(F.split(body, r"(?=<\|)"), split)), lambda x: x["placeholder"].isNotNull() | (x["text"] != ""))
        return F.struct(unescape(halves[0]).alias("role"), unescape(body).alias("text"), loss.alias("loss"), parts.alias("parts"))

    return F.transform(pieces, turn)


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the output."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = format_chats(table.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked.alias("masked"))
    loss = F.array_join("masked", "")
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B')) + length(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B'))
      + length('<|turn|><|body|><|end|>') + CASE WHEN role = 'assistant' THEN length('<|loss|><|/loss|>') ELSE 0 END) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
