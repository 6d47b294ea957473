"""Requests on the wire: what each is for, whose session it belongs to, and what it costs to serve locally.

body is the request's JSON as a string; null or invalid JSON, or anything but an object, is an unparseable body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDECAR_TOKENS, SIDECAR_MESSAGES, PREWARM_TOKENS = 8192, 2, 2
COMPACTION = ("summarizing conversations", "summarize this conversation")
LOCAL_BYTES = 49_152


def _variant(body: Column) -> Column:
    return F.try_parse_json(body)


def is_object(body: Column) -> Column:
    return F.coalesce(F.schema_of_variant(_variant(body)).startswith("OBJECT"), F.lit(False))


def _messages(body: Column) -> Column:
    return F.coalesce(F.try_variant_get(_variant(body), "$.messages", "array<variant>"), F.array().cast("array<variant>"))


def system_head(body: Column, n: int = 200) -> Column:
    """The first n characters of the system prompt, a string or a list of blocks joined by spaces."""
    v = _variant(body)
    blocks = F.array_join(F.transform(F.try_variant_get(v, "$.system", "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))), " ")
    is_list = F.schema_of_variant(F.try_variant_get(v, "$.system", "variant")).startswith("ARRAY")
    return F.substring(F.coalesce(F.when(is_list, blocks), F.try_variant_get(v, "$.system", "string"), F.lit("")), 1, n)


def last_has_tool_result(body: Column) -> Column:
    last = F.try_element_at(_messages(body), F.lit(-1))
    blocks = F.try_variant_get(last, "$.content", "array<variant>")
    return F.coalesce(F.exists(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_result", F.lit(False))), F.lit(False))


def discriminate(path: Column, body: Column) -> Column:
    """One of seven labels; in doubt a user turn, the safe mistake."""
    v = _variant(body)
    limit = F.coalesce(F.try_variant_get(v, "$.max_tokens", "long"), F.lit(0))
    tools = F.coalesce(F.size(F.try_variant_get(v, "$.tools", "array<variant>")), F.lit(0))
    head = F.lower(system_head(body))
    compacting = F.contains(head, F.lit(COMPACTION[0])) | F.contains(head, F.lit(COMPACTION[1]))
    return (
        F.when(F.contains(path, F.lit("/count_tokens")), "passthrough:count_tokens")
        .when(~path.startswith("/v1/messages"), "passthrough:non_api")
        .when(~is_object(body), "user_turn")
        .when(limit <= PREWARM_TOKENS, "utility:prewarm")
        .when((F.greatest(tools, F.lit(0)) == 0) & (limit <= SIDECAR_TOKENS) & (F.size(_messages(body)) <= SIDECAR_MESSAGES), "utility:sidecar")
        .when(compacting, "utility:compaction")
        .when(last_has_tool_result(body), "continuation")
        .otherwise("user_turn")
    )


def session_key(body: Column) -> Column:
    """metadata.user_id is JSON in a string; anything unexpected gives null."""
    return F.get_json_object(F.get_json_object(body, "$.metadata.user_id"), "$.session_id")


def fallback_session(body: Column) -> Column:
    return F.concat(F.lit("anon:"), F.substring(F.sha1(F.substring(body, 1, 500).cast("binary")), 1, 16))


def entrypoint(body: Column) -> Column:
    head = system_head(body, 120)
    return F.when(F.contains(head, F.lit("cc_entrypoint=cli")), "cli").when(F.contains(head, F.lit("cc_entrypoint=sdk")), "sdk").otherwise("unknown")


def fits_local(body: Column) -> Column:
    """By bytes, not characters; the bound belongs to what fits."""
    return F.octet_length(body) <= LOCAL_BYTES


def rewrites_to_local(label: Column, body: Column) -> Column:
    return label.isin("utility:sidecar", "utility:compaction") & fits_local(body)


def _content_text(m: Column) -> Column:
    """A message's characters: its text blocks and its tool results' text."""
    blocks = F.try_variant_get(m, "$.content", "array<variant>")
    one = lambda b: F.length(F.coalesce(F.try_variant_get(b, "$.text", "string"), F.try_variant_get(b, "$.content", "string"), F.lit("")))
    return F.coalesce(F.aggregate(F.transform(blocks, one), F.lit(0), lambda s, x: s + x), F.length(F.try_variant_get(m, "$.content", "string")), F.lit(0))


def context_tokens(body: Column) -> Column:
    """Characters of the system prompt and all messages, in fours, rounded down."""
    system = F.length(system_head(body, 1 << 30))
    return F.floor((system + F.aggregate(F.transform(_messages(body), _content_text), F.lit(0), lambda s, x: s + x)) / 4)


def last_user_text(body: Column) -> Column:
    """The text of the last user message that has some."""
    def text(m: Column) -> Column:
        blocks = F.try_variant_get(m, "$.content", "array<variant>")
        joined = F.array_join(F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.try_variant_get(b, "$.text", "string")), "\n")
        return F.coalesce(joined, F.try_variant_get(m, "$.content", "string"), F.lit(""))

    said = F.filter(F.transform(F.filter(_messages(body), lambda m: F.try_variant_get(m, "$.role", "string") == "user"), text), lambda t: t != "")
    return F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit(""))


def previous_interrupted(body: Column) -> Column:
    """Whether one of the last three messages tells of an interruption by the user."""
    return F.exists(F.slice(_messages(body), F.greatest(F.size(_messages(body)) - 2, F.lit(1)), 3), lambda m: F.contains(F.to_json(m), F.lit("[Request interrupted by user")))


def wrong_openers(captures: DataFrame, simulated: DataFrame) -> DataFrame:
    """session_id and label of the simulator's sessions whose first conversational request is no user turn.

    captures: session_id, seq, label; simulated: session_id.
    """
    first = captures.where(F.col("label").isin("user_turn", "continuation")).groupBy("session_id").agg(F.min_by("label", "seq").alias("label"))
    return first.join(simulated.select("session_id").distinct(), "session_id", "left_semi").where("label <> 'user_turn'")
