"""Failure detectors over the ordered actions of a turn, as running sums and window functions.

Results (tool results): turn, ordinal, is_error, content, tool_name, path. Calls: turn, ordinal, call (a canonical
hash), malformed. All windows are per turn, so no turn's state reaches another.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values.
EDIT_MARKER = "String to replace not found in file"
INTERRUPT = "[Request interrupted by user"
SCHEMA_MARKERS = ("input validation error", "does not match the required schema", "invalid tool name")
READ_TOOLS = ("read", "read_file", "readfile", "view", "view_file", "cat", "open_file")
EDIT_TOOLS = ("edit", "multiedit", "write", "str_replace", "str_replace_editor", "str_replace_based_edit_tool", "apply_patch", "create_file", "notebookedit")
STRIKES, LOOP_REPEATS, LOOP_WINDOW, STUCK = 2, 3, 6, 6
NEXT_RUNG = {"local": "cheap-cloud", "local-code": "cheap-cloud", "local-small": "cheap-cloud", "cheap-cloud": "frontier", "cheap_cloud": "frontier"}


def _so_far(turn: str = "turn", order: str = "ordinal"):
    return Window.partitionBy(turn).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def canonical_call(name: Column, args_json: Column) -> Column:
    """sha1 of the name and the arguments, without slashes at the end of a string and with single spaces.

    args_json has sorted keys (JSON text of a struct or map made for it; ``sorted_json`` for nested input).
    """
    tidy = F.regexp_replace(F.regexp_replace(args_json, r'/+"', '"'), r"\s+", " ")
    return F.sha1(F.concat(name, F.lit(":"), tidy).cast("binary"))


@F.pandas_udf(StringType())
def sorted_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys at every depth, which built-in functions cannot do; null for what is not JSON."""
    import json

    def one(x: str | None) -> str | None:
        try:
            return json.dumps(json.loads(x), sort_keys=True)
        except (TypeError, ValueError):
            return None

    # a batch has many texts more than once
    return text.map({x: one(x) for x in text.unique()}.get)


def loops(calls: DataFrame, repeats: int = LOOP_REPEATS, window: int = LOOP_WINDOW, by: tuple[str, ...] = ("turn",)) -> DataFrame:
    """Calls that are the same as ``repeats`` of the last ``window`` of their turn, the columns ``by``, themselves included."""
    last = F.collect_list("call").over(Window.partitionBy(*by).orderBy("ordinal").rowsBetween(1 - window, 0))
    return calls.withColumn("reps", F.size(F.filter(last, lambda c: c == F.col("call")))).where(F.col("reps") >= repeats)


def edit_failures(results: DataFrame) -> DataFrame:
    """Results at which the count of failed edits, errors that carry the marker, reaches the strikes."""
    hit = F.col("is_error") & F.contains(F.col("content"), F.lit(EDIT_MARKER))
    return results.withColumn("strikes", F.sum(hit.cast("int")).over(_so_far())).where(hit & (F.col("strikes") >= STRIKES))


def schema_errors(events: DataFrame) -> DataFrame:
    """Malformed calls, and results that reject a call's schema, from the second on. A failed edit is not one."""
    rejected = reduce(lambda a, b: a | b, [F.contains(F.lower("content"), F.lit(m)) for m in SCHEMA_MARKERS])
    hit = F.coalesce(F.col("malformed"), F.lit(False)) | F.coalesce(F.col("is_error") & rejected & ~F.contains(F.col("content"), F.lit(EDIT_MARKER)), F.lit(False))
    return events.withColumn("strikes", F.sum(hit.cast("int")).over(_so_far())).where(hit & (F.col("strikes") >= STRIKES))


def progress(results: DataFrame) -> DataFrame:
    """results with progressed and stuck, the number of results without progress up to here.

    Progress is a path not read before, a successful edit, or an output not seen before; an error never is.
    """
    fine = ~F.coalesce(F.col("is_error"), F.lit(False))
    tool = F.lower(F.coalesce("tool_name", F.lit("")))
    reads = fine & tool.isin(*READ_TOOLS) & F.col("path").isNotNull()
    first = lambda key, which: F.row_number().over(Window.partitionBy("turn", key, which).orderBy("ordinal")) == 1
    r = results.withColumns({"_reads": reads, "_fine": fine, "_h": F.sha1(F.coalesce("content", F.lit("")).cast("binary"))})
    r = r.withColumns({"_new_path": F.col("_reads") & first("path", "_reads"), "_new_output": F.col("_fine") & first("_h", "_fine")})
    r = r.withColumn("progressed", F.col("_new_path") | F.col("_new_output") | (F.col("_fine") & tool.isin(*EDIT_TOOLS)))
    r = r.withColumn("_island", F.sum(F.col("progressed").cast("int")).over(_so_far()))
    stuck = F.sum((~F.col("progressed")).cast("int")).over(Window.partitionBy("turn", "_island").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("stuck", stuck).drop("_reads", "_fine", "_h", "_new_path", "_new_output", "_island")


def over_budget(responses: DataFrame, max_tokens: int | None = None, max_seconds: float | None = None) -> DataFrame:
    """Responses at which the turn's tokens, or else its time, are over a bound; none without bounds."""
    r = responses.withColumns({"tokens": F.sum(F.greatest(F.coalesce("output_tokens", F.lit(0)), F.lit(0))).over(_so_far()), "seconds": F.max("elapsed_s").over(_so_far())})
    by_tokens = F.lit(False) if max_tokens is None else F.col("tokens") > max_tokens
    by_time = F.lit(False) if max_seconds is None else F.coalesce(F.col("seconds") > max_seconds, F.lit(False))
    return r.withColumn("reason", F.when(by_tokens, "tokens").when(by_time, "wall_clock")).where("reason IS NOT NULL")


def interrupts(said: DataFrame) -> DataFrame:
    """Messages of the user, of which one text begins with the note of an interruption; the first is a hit already.

    said: turn, ordinal, texts (array<string>; a null is no text).
    """
    return said.where(F.exists("texts", lambda t: F.coalesce(t.startswith(INTERRUPT), F.lit(False))))


def first_hit(hits: DataFrame) -> DataFrame:
    """The first hit of each turn; later ones change nothing. hits: turn, ordinal, name."""
    return hits.groupBy("turn").agg(F.min_by("name", F.struct("ordinal", "name")).alias("name"), F.min("ordinal").alias("ordinal"))


def escalation(hit: DataFrame) -> DataFrame:
    """hit with target and kind: a pinned turn goes to the user, others up the ladder; at the top there is nowhere to go."""
    from tracemill.operators.outcomes import TYPE_OF

    pick = lambda table, key: F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), lambda k, v: k == F.col(key))), F.lit(0))
    return hit.withColumn("kind", pick(TYPE_OF, "name")).withColumn("target", F.when(F.col("pinned"), "user").otherwise(pick(NEXT_RUNG, "rung")))


def circuit(outcomes: DataFrame, cooldown_s: float = 30.0) -> DataFrame:
    """outcomes (rung, ts, ok) with open: whether a failure less than cooldown_s ago, with no success since, keeps it shut."""
    w = Window.partitionBy("rung").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    failed, worked = F.max(F.when(~F.col("ok"), F.col("ts"))).over(w), F.max(F.when(F.col("ok"), F.col("ts"))).over(w)
    return outcomes.withColumn("open", F.coalesce((failed > F.coalesce(worked, F.lit(float("-inf")))) & (F.col("ts") - failed < cooldown_s), F.lit(False)))


def episode_boundary(turns: DataFrame, order: list[str]) -> DataFrame:
    """turns with score and boundary: three of clean, completion phrase, change of verb, and other files.

    turns: session_id, instruction_text, verb_class, clean.
    """
    from tracemill.functions.text import EPISODE_COMPLETION, file_references, matches

    w = Window.partitionBy("session_id").orderBy(*order)
    t = turns.withColumn("_files", file_references(F.col("instruction_text")))
    files = F.lag("_files").over(w)
    signals = [
        F.coalesce(F.lag("clean").over(w), F.lit(False)), matches(F.coalesce("instruction_text", F.lit("")), EPISODE_COMPLETION),
        F.coalesce(F.lag("verb_class").over(w) != F.col("verb_class"), F.lit(False)) & ~F.col("verb_class").isin("", "unknown"),
        F.coalesce((F.size("_files") > 0) & (F.size(files) > 0) & ~F.arrays_overlap("_files", files), F.lit(False)),
    ]
    score = reduce(lambda a, b: a + b, [s.cast("int") for s in signals])
    return t.withColumn("score", score).withColumn("boundary", F.col("score") >= 3).drop("_files")


def evidence_so_far(results: DataFrame, hits: DataFrame) -> DataFrame:
    """results with what is known of the turn by then: errors, strikes (failed edits), and fired, the first hit's name once it is there.

    results: turn, ordinal, is_error, content; hits: turn, ordinal, name.
    """
    error = F.coalesce(F.col("is_error"), F.lit(False))
    failed = error & F.contains(F.coalesce("content", F.lit("")), F.lit(EDIT_MARKER))
    first = first_hit(hits).select("turn", F.col("name").alias("_name"), F.col("ordinal").alias("_at"))
    r = results.withColumns({"errors": F.sum(error.cast("int")).over(_so_far()), "strikes": F.sum(failed.cast("int")).over(_so_far())})
    return r.join(first, "turn", "left").withColumn("fired", F.when(F.col("_at") <= F.col("ordinal"), F.col("_name"))).drop("_name", "_at")


def idle_sessions(touches: DataFrame, now: Column, ttl_s: float = 14_400.0) -> DataFrame:
    """Sessions whose last touch is ttl_s or more ago: reported, never evicted."""
    return touches.groupBy("session_id").agg(F.max("ts").alias("last")).where(now - F.col("last") >= ttl_s)
