"""Streamed responses and transcripts as content blocks: reassembly, rebuilding without thinking, and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "struct<type:string,text:string,id:string,name:string,input:string>"


def reconstruct(sse: Column) -> Column:
    """STRUCT<blocks, output_tokens> of a server-sent event stream: deltas joined by block index.

    A tool's input stays the text that came, whether or not it is valid JSON; output_tokens is the largest count told;
    lines that are no JSON are passed over; null is an empty stream.
    """
    data = F.transform(F.filter(F.split(F.coalesce(sse, F.lit("")), "\n"), lambda s: s.startswith("data:")), lambda s: F.try_parse_json(F.trim(F.substring(s, 6, 1 << 30))))
    events = F.filter(data, lambda v: v.isNotNull())
    get = lambda v, k, t="string": F.try_variant_get(v, f"$.{k}", t)
    starts = F.filter(events, lambda v: get(v, "type") == "content_block_start")

    def block(s: Column) -> Column:
        mine = F.filter(events, lambda v: (get(v, "type") == "content_block_delta") & (get(v, "index", "int") == get(s, "index", "int")))
        joined = lambda key: F.array_join(F.transform(mine, lambda v: F.coalesce(get(v, f"delta.{key}"), F.lit(""))), "")
        kind = get(s, "content_block.type")
        return F.struct(
            kind.alias("type"), F.when(kind == "text", F.concat(F.coalesce(get(s, "content_block.text"), F.lit("")), joined("text"))).when(kind == "thinking", joined("thinking")).alias("text"),
            get(s, "content_block.id").alias("id"), get(s, "content_block.name").alias("name"), F.when(kind == "tool_use", joined("partial_json")).alias("input"))

    told = F.transform(events, lambda v: F.coalesce(get(v, "usage.output_tokens", "long"), get(v, "message.usage.output_tokens", "long")))
    return F.struct(F.transform(starts, block).alias("blocks"), F.coalesce(F.array_max(told), F.lit(0)).alias("output_tokens"))


def failure_note(name: Column, kind: Column, strikes: Column) -> Column:
    """At most three lines that tell the next model what went wrong."""
    return F.array(F.concat(F.lit("A previous attempt stopped: "), name), F.concat(F.lit("Kind: "), kind), F.concat(F.lit("Strikes: "), F.coalesce(strikes, F.lit(1)).cast("string")))


def rebuild(messages: Column, note: Column) -> Column:
    """array<struct<role,blocks>> without thinking blocks, without messages that this empties, and with the note first."""
    kept = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.filter(m["blocks"], lambda b: ~b["type"].isin("thinking", "redacted_thinking")).alias("blocks")))
    full = F.filter(kept, lambda m: F.size(m["blocks"]) > 0)
    first = F.struct(F.lit("text").alias("type"), F.array_join(F.slice(note, 1, 3), "\n").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("tool_use_id"))
    return F.concat(F.array(F.struct(F.lit("user").alias("role"), F.array(first).alias("blocks"))), full)


def rebuilt_problem(messages: Column) -> Column:
    """The first reason why a rebuilt transcript is invalid, or null: empty, a wrong role, thinking left, or a result without its call."""
    all_blocks = F.flatten(F.transform(messages, lambda m: m["blocks"]))
    calls = F.transform(F.filter(all_blocks, lambda b: b["type"] == "tool_use"), lambda b: b["id"])
    answers = F.transform(F.filter(all_blocks, lambda b: b["type"] == "tool_result"), lambda b: b["tool_use_id"])
    return (
        F.when(F.size(messages) == 0, "empty").when(messages[0]["role"] != "user", "does not start with the user")
        .when(F.exists(messages, lambda m: ~m["role"].isin("user", "assistant")), "unknown role").when(F.exists(messages, lambda m: F.size(m["blocks"]) == 0), "empty message")
        .when(F.exists(all_blocks, lambda b: b["type"].isin("thinking", "redacted_thinking")), "thinking left").when(F.size(F.array_except(answers, calls)) > 0, "result without its call"))
