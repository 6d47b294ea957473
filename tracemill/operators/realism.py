"""The realism battery: 28 metrics of a stream of turns, their bands, and the comparison of two streams.

Turns: session_id, idx, text, is_user, source_kind, n_continuations, n_assistant_msgs, n_tool_uses, input_tokens,
cache_read_tokens, n_error_results, edit_tripwire, interrupted, secret_shaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import stats as S
from tracemill.functions import text as T

#: Metric, low, high, gate.
BANDS = [
    ("surface::wc_p50", 8, 12, "P0-1"), ("surface::wc_p90", 58, 86, "P0-1"), ("surface::pct_lt5_words", 18, 32, "P0-1"), ("surface::pct_no_terminal_punct", 55, 75, "P0-1"),
    ("surface::pct_all_lowercase", 20, 32, "P0-1"), ("surface::pct_txt_speak", 16, 26, "P0-1"), ("surface::pct_inline_path", 8, 20, "P0-1"), ("surface::pct_fenced_code", 0, 1, "P0-1"),
    ("surface::pct_emoji", 0, 1, "P0-1"), ("behavioral::pct_terse_le3", 14, 24, "P0-2"), ("behavioral::pct_questions", 28, 42, "P0-2"), ("behavioral::pct_disfluency", 10, 17, "P0-2"),
    ("behavioral::interrupt_rate", 1.5, 4.0, "P0-2"), ("behavioral::median_consec_jaccard", 0.0, 0.10, "P0-2"), ("behavioral::session_len_p50", 18, 30, "P0-2"), ("behavioral::session_len_p90", 100, 250, "P0-2"),
    ("behavioral::continuations_mean", 2, 4, "P0-2"), ("structural::pct_subagent", 50, 100, "P1-7"), ("structural::pct_ctx_over_32k", 25, 100, "P1-6"), ("structural::pct_ctx_over_100k", 15, 100, "P1-6"),
    ("structural::pct_sessions_secret_shaped", 0.05, 100, "P1-8"), ("failure::pct_ge1_error", 7, 11, "P0-3"), ("failure::pct_ge2_error", 1.5, 3.5, "P0-3"), ("failure::edit_tripwire_rate", 2, 100, "P0-3"),
]
JOINT = [("joint::pct_lowercase_given_long", 8.0, 8.0), ("joint::pct_long_lowercase_verbless", 5.0, 5.0)]
TVD_MOST, DEVIATION_MOST = 0.15, 12.0


def users(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("is_user") & (T.strip(T.text_of("text")) != ""))


def surface(turns: DataFrame) -> DataFrame:
    """One row: word counts and the shares of the surface and behavioural predicates, in percent."""
    t, n = F.col("text"), F.count("*")
    u = users(turns).withColumn("wc", T.word_count(t).cast("double"))
    share = lambda c: S.percent(F.count_if(c), n)
    return u.agg(
        *[S.percentile_linear(F.col("wc"), p).alias(f"surface::wc_p{p}") for p in (10, 50, 90, 99)],
        share(F.col("wc") < 5).alias("surface::pct_lt5_words"), share(T.no_terminal_punct(t)).alias("surface::pct_no_terminal_punct"), share(T.all_lowercase(t)).alias("surface::pct_all_lowercase"),
        share(T.is_txt_speak(t)).alias("surface::pct_txt_speak"), share(T.has_path(t)).alias("surface::pct_inline_path"), share(T.has_fence(t)).alias("surface::pct_fenced_code"), share(T.has_emoji(t)).alias("surface::pct_emoji"),
        share(F.col("wc") <= 3).alias("behavioral::pct_terse_le3"), share(T.is_question(t)).alias("behavioral::pct_questions"), share(T.has_disfluency(t)).alias("behavioral::pct_disfluency"),
        share(F.coalesce(F.col("interrupted"), F.lit(False))).alias("behavioral::interrupt_rate"), F.avg("n_continuations").alias("behavioral::continuations_mean"),
        S.percent(F.count_if((F.col("wc") >= 50) & T.all_lowercase(t)), F.count_if(F.col("wc") >= 50)).alias("joint::pct_lowercase_given_long"),
        share((F.col("wc") >= 50) & T.all_lowercase(t) & T.is_verbless(t)).alias("joint::pct_long_lowercase_verbless"),
    )


def consecutive_jaccard(turns: DataFrame) -> DataFrame:
    """session_id, idx, jaccard: a user turn's content words against those of the one before it in the session."""
    w = Window.partitionBy("session_id").orderBy("idx")
    u = users(turns).select("session_id", "idx", T.content_words(F.col("text")).alias("w")).withColumn("before", F.lag("w").over(w))
    return u.where("before IS NOT NULL").select("session_id", "idx", S.jaccard(F.col("before"), F.col("w")).alias("jaccard"))


def sessions(turns: DataFrame) -> DataFrame:
    lengths = users(turns).groupBy("session_id").agg(F.count("*").cast("double").alias("n"))
    a = lengths.agg(S.percentile_linear(F.col("n"), 50).alias("behavioral::session_len_p50"), S.percentile_linear(F.col("n"), 90).alias("behavioral::session_len_p90"))
    return a.crossJoin(consecutive_jaccard(turns).agg(S.percentile_linear(F.col("jaccard"), 50).alias("behavioral::median_consec_jaccard")))  # two single rows


def structure(turns: DataFrame) -> DataFrame:
    """Shares of subagents, large contexts, secret sessions, and failures of turns that use tools."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    has_context = (z("n_assistant_msgs") > 0) | (z("cache_read_tokens") != 0) | (z("input_tokens") != 0)
    per_message = (z("cache_read_tokens") + z("input_tokens")) / F.greatest(z("n_assistant_msgs"), F.lit(1))
    tools = z("n_tool_uses") > 0
    return turns.agg(
        S.percent(F.count_if(F.col("source_kind") == "subagent"), F.count("*")).alias("structural::pct_subagent"),
        *[S.percent(F.count_if(has_context & (per_message > k * 1000)), F.count_if(has_context)).alias(f"structural::pct_ctx_over_{k}k") for k in (32, 100)],
        S.percent(F.countDistinct(F.when(F.col("secret_shaped"), F.col("session_id"))), F.countDistinct("session_id")).alias("structural::pct_sessions_secret_shaped"),
        *[S.percent(F.count_if(tools & (z("n_error_results") >= k)), F.count_if(tools)).alias(f"failure::pct_ge{k}_error") for k in (1, 2)],
        S.percent(F.count_if(tools & F.coalesce(F.col("edit_tripwire"), F.lit(False))), F.count_if(tools)).alias("failure::edit_tripwire_rate"),
    )


def battery(turns: DataFrame) -> DataFrame:
    """metric, value: one row per metric."""
    wide = surface(turns).crossJoin(sessions(turns)).crossJoin(structure(turns))  # single rows
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in wide.columns)
    return wide.select(F.expr(f"stack({len(wide.columns)}, {pairs}) AS (metric, value)"))


def archetypes(turns: DataFrame) -> DataFrame:
    """archetype, share, wc_median: all seven, 0 and null for those that don't occur."""
    u = users(turns).select(T.archetype(F.col("text")).alias("archetype"), T.word_count(F.col("text")).cast("double").alias("wc"))
    found = u.groupBy("archetype").agg(F.count("*").alias("n"), F.median("wc").alias("wc_median"))
    names = turns.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, T.ARCHETYPES))).alias("archetype"))
    both = names.join(F.broadcast(found), "archetype", "left")
    return both.select("archetype", S.ratio(F.coalesce("n", F.lit(0)), F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy())).alias("share"), "wc_median")


def verdict(value: Column, low: Column, high: Column) -> Column:
    """Bounds belong to the band and may be missing; no value is no data."""
    return F.when(value.isNull(), "NO DATA").when((value < low) | (value > high), "FAIL").otherwise("PASS")


def scorecard(corpus: DataFrame, other: DataFrame) -> DataFrame:
    """metric, corpus, sim, low, high, gate, verdict: 24 fixed bands, 2 that follow the corpus, 2 over archetypes."""
    spark = corpus.sparkSession
    c, s = battery(corpus).withColumnRenamed("value", "corpus"), battery(other).withColumnRenamed("value", "sim")
    bands = spark.createDataFrame([(m, float(a), float(b), g) for m, a, b, g in BANDS], "metric string, low double, high double, gate string")
    margins = spark.createDataFrame([(m, a, b) for m, a, b in JOINT], "metric string, margin double, least double")
    both = c.join(s, "metric")
    fixed = both.join(F.broadcast(bands), "metric").select("metric", "corpus", "sim", "low", "high", "gate")
    joint = both.join(F.broadcast(margins), "metric").select("metric", "corpus", "sim", F.lit(0.0).alias("low"), F.greatest("least", F.coalesce("corpus", F.lit(0.0)) + F.col("margin")).alias("high"), F.lit("P0-1/2").alias("gate"))
    a, b = archetypes(corpus), archetypes(other)
    pair = a.select("archetype", F.col("share").alias("p"), F.col("wc_median").alias("x")).join(b.select("archetype", F.col("share").alias("q"), F.col("wc_median").alias("y")), "archetype", "full_outer")
    z = lambda k: F.coalesce(k, F.lit(0.0))
    two = pair.agg((0.5 * F.sum(F.abs(z("p") - z("q")))).alias("t"), F.max(F.abs(F.col("x") - F.col("y"))).alias("d")).select(F.expr(f"stack(2, 'joint::archetype_mix_tvd', 0D, t, 0D, {TVD_MOST}D, 'P0-1/2', 'joint::wc_median_dev_by_archetype', 0D, d, 0D, {DEVIATION_MOST}D, 'P0-1/2') AS (metric, corpus, sim, low, high, gate)"))
    rows = fixed.unionByName(joint).unionByName(two)
    return rows.withColumn("verdict", verdict(F.col("sim"), F.col("low"), F.col("high")))


def gate(scored: DataFrame) -> DataFrame:
    """passed: whether all rows of the first priority pass."""
    return scored.where(F.col("gate").startswith("P0")).agg(F.bool_and(F.col("verdict") == "PASS").alias("passed"))
