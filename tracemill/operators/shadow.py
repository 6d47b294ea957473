"""Offline twins of live decisions: what a cascade would have done, and what a rewrite would have risked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import stats as S
from tracemill.functions import text as T
from tracemill.operators import tripwires as TW
from tracemill.operators import wire as W
from tracemill.operators.graph import first_k


def post_call(turns: DataFrame, hits: DataFrame, medians: Column, least_by_tokens: Column) -> DataFrame:
    """One row: cascaded turns, fired ones, by pin and rate, and those over twice the median of tokens.

    turns: turn, session_id, source_path, cascade, pinned, output_tokens; hits: turn, ordinal, name. A turn counts once,
    for its first hit; a fired turn of a pinned session is blocked instead of escalated.
    """
    first = TW.first_hit(hits).select("turn", "name")
    t = turns.join(first, "turn", "left").withColumn("over", F.coalesce(least_by_tokens > 2 * medians, F.lit(False)))
    fired = F.col("cascade") & F.col("name").isNotNull()
    a = t.agg(F.count("*").alias("turns"), F.count_if("cascade").alias("cascaded"), F.count_if(fired).alias("fired"), F.count_if(fired & F.col("pinned")).alias("blocked"), F.count_if(F.col("cascade") & F.col("over") & F.col("name").isNull()).alias("more_by_budget"))
    return a.withColumn("rate", S.ratio(F.col("fired"), F.col("cascaded")))


def fired_by(hits: DataFrame) -> DataFrame:
    """name, kind, turns: first hits by trip-wire."""
    from tracemill.operators.outcomes import TYPE_OF

    kind = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in TYPE_OF.items() for x in kv]), lambda k, v: k == F.col("name"))), F.lit(0))
    return TW.first_hit(hits).groupBy("name").agg(F.count("*").alias("turns")).withColumn("kind", kind)


def hook(captures: DataFrame) -> DataFrame:
    """label, requests, rewritten, unsafe: what a rewrite of utility calls to the local rung touches."""
    c = captures.withColumn("label", W.discriminate(F.col("path"), F.col("body")))
    to_local = F.coalesce(W.rewrites_to_local(F.col("label"), F.col("body")), F.lit(False))
    risky = F.col("label").rlike("^(user_turn|continuation|passthrough)")
    return c.withColumn("r", to_local).groupBy("label").agg(F.count("*").alias("requests"), F.count_if("r").alias("rewritten"), F.count_if(F.col("r") & risky).alias("unsafe"))


def classifier(turns: DataFrame) -> DataFrame:
    """One row: hard rates of what the verdict sends to the frontier and of what it keeps, and their difference, over the turns that the expressions leave open.

    turns: text, intent_score, needs_frontier, hard.
    """
    u = turns.where(T.regex_uncertain(T.verb_class(F.col("text")), F.col("intent_score")))
    up, h = F.coalesce(F.col("needs_frontier"), F.lit(False)), F.col("hard").cast("double")
    a = u.agg(F.count("*").alias("uncertain"), F.count_if(up).alias("frontier"), F.avg(F.when(up, h)).alias("frontier_hard"), F.avg(F.when(~up, h)).alias("local_hard"))
    return a.withColumn("separation", F.col("frontier_hard") - F.col("local_hard"))


def spend(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("usd"))


def backfill_stats(decisions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """source, decisions, embedded, excluded: a decision without an embedding was kept out for privacy."""
    d = decisions.join(embeddings.select("route_id", F.lit(True).alias("e")), "route_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("decisions"), F.count_if(F.col("e").isNotNull()).alias("embedded"), F.count_if(F.col("e").isNull()).alias("excluded"))


def avoided_spend(captures: DataFrame, prices: list[tuple[str, float, float]]) -> DataFrame:
    """model, calls, usd: what locally served calls would have cost. captures: routed_to_local, local_fallback, body, response."""
    from tracemill.operators.reports import price

    served = captures.where("routed_to_local IS NOT NULL AND local_fallback IS NULL")
    b, r = F.try_parse_json(F.coalesce("body", F.lit("{}"))), F.try_parse_json(F.coalesce("response", F.lit("{}")))
    s = served.where(b.isNotNull() & r.isNotNull()).withColumn("model", F.coalesce(F.try_variant_get(b, "$.model", "string"), F.lit("?")))
    tokens = lambda k: F.coalesce(F.try_variant_get(r, f"$.usage.{k}", "long"), F.lit(0))
    usd = tokens("input_tokens") / 1e6 * price(F.col("model"), "in", prices) + tokens("output_tokens") / 1e6 * price(F.col("model"), "out", prices)
    return s.withColumn("usd", usd).groupBy("model").agg(F.count("*").alias("calls"), F.sum("usd").alias("usd")).orderBy(F.desc("calls"), "model")


def freeze(captures: DataFrame, most: int = 4) -> DataFrame:
    """The first captures of each label in their scrubbed shape, without those whose label the scrubbing changes. captures: seq, path, body."""
    v = F.try_parse_json("body")
    get = lambda k, t="string": F.try_variant_get(v, f"$.{k}", t)
    roles = F.transform(F.coalesce(get("messages", "array<variant>"), F.array().cast("array<variant>")), lambda m: F.struct(F.try_variant_get(m, "$.role", "string").alias("role"), F.when(F.try_variant_get(m, "$.content[0].type", "string").isNotNull(), F.transform(F.try_variant_get(m, "$.content", "array<variant>"), lambda b: F.struct(F.try_variant_get(b, "$.type", "string").alias("type")))).alias("content")))
    scrubbed = F.when(v.isNotNull() & W.is_object(F.col("body")), F.to_json(F.struct(get("max_tokens", "int").alias("max_tokens"), F.transform(get("tools", "array<variant>"), lambda t: F.struct(F.lit("x").alias("name"))).alias("tools"), W.system_head(F.col("body")).alias("system"), roles.alias("messages"))))
    c = captures.withColumns({"label": W.discriminate(F.col("path"), F.col("body")), "scrubbed": scrubbed})
    same = c.where(F.col("label") == W.discriminate(F.col("path"), F.col("scrubbed")))
    return first_k(same.select("seq", "path", "label", "scrubbed"), "label", ["seq"], most)


def index_captures(captures: DataFrame) -> DataFrame:
    """session_id, tool_uses, errors, subagents: counted as substrings of each session's bodies. captures: session_id, body."""
    n = lambda s: F.sum(F.regexp_count("body", F.lit(s)))
    return captures.where("session_id IS NOT NULL").groupBy("session_id").agg(n('"tool_use"').alias("tool_uses"), n('"is_error": ?true').alias("errors"), n("isSidechain").alias("subagents"))


def enrich(turns: DataFrame, index: DataFrame) -> DataFrame:
    """turns with the counts of their session's captures; 0 where there is none."""
    names = ("tool_uses", "errors", "subagents")
    return turns.join(index, "session_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def bench_items(items: DataFrame, required: list[str], most: int | None = None) -> DataFrame:
    """Items that have every required field, and the first of them where a limit is asked for."""
    full = items
    for c in required:
        full = full.where(F.col(c).isNotNull())
    return full if most is None else full.limit(most)


def forward_filled(records: DataFrame, column: str) -> DataFrame:
    w = Window.partitionBy("source_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn(column, F.last(column, ignorenulls=True).over(w))
