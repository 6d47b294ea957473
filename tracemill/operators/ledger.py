"""The append-only ledger: events are the truth, outcomes a view of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rank of each status; no status but these is accepted.
RANK = {"pending": 0, "closed_turn": 1, "closed_final": 2}
VERIFIED_CAUSES = ("harness_dialect", "task_capability", "user_abort", "infrastructure", "verifier_error", "unknown")


def _rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in RANK.items():
        out = F.when(status == name, n).otherwise(out)
    return out


def record_decisions(known: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose route_id is not known yet, the first of each by ts: what an idempotent append adds."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("route_id").orderBy("ts"))).where("_n = 1").drop("_n")
    return first.join(known.select("route_id"), "route_id", "left_anti")


def accepted_events(events: DataFrame, routes: DataFrame) -> DataFrame:
    """events with accepted: unknown statuses and routes, steps backward, and what follows a final one are not.

    events: event_id, route_id, seq (order of arrival), status. An event id that was accepted before is a repetition.
    A rejected event never raises a route's rank, so the highest rank of all earlier events decides; a rejected event
    also leaves no id behind.
    """
    return once(fitting(events, routes)).drop("twice")


def fitting(events: DataFrame, routes: DataFrame) -> DataFrame:
    """events with fits: whether accepted_events() would accept each, but for its repetitions."""
    known = routes.select("route_id").distinct().withColumn("_stand", F.lit("pending"))
    return fitting_after(events.join(known, "route_id", "left"), "_stand").drop("_stand")


def fitting_after(events: DataFrame, stand: str) -> DataFrame:
    """fitting() of events with the status that their route has before them, null for an unknown route. Only dealt by route."""
    rank = F.when(F.col(stand).isNotNull(), _rank(F.col("status")))
    earlier = F.max("_rank").over(Window.partitionBy("route_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    before = F.greatest(earlier, _rank(F.col(stand)))
    return events.withColumn("_rank", rank).withColumn("fits", F.coalesce((F.col("_rank") >= before) & (before < 2), F.lit(False))).drop("_rank")


def once(events: DataFrame) -> DataFrame:
    """fitting() events with accepted, which of an id only one is, and twice: whether one of the id is. Dealt by id."""
    same = Window.partitionBy("event_id").orderBy("seq")
    again = F.count_if("fits").over(same.rowsBetween(Window.unboundedPreceding, -1))
    e = events.withColumn("accepted", F.col("fits") & (F.coalesce(again, F.lit(0)) == 0))
    return e.withColumn("twice", F.col("event_id").isNotNull() & F.bool_or("accepted").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("fits")


def fold(events: DataFrame, routes: DataFrame, values: list[str], unique: bool = False) -> DataFrame:
    """The outcome of every route: the last accepted event's status and values; pending where there is none.

    Where no two events have one id (unique), events are dealt by route only.
    """
    accepted = fitting(events, routes).where("fits") if unique else accepted_events(events, routes).where("accepted")
    last = accepted.groupBy("route_id").agg(F.max_by(F.struct("status", *values), "seq").alias("e"))
    out = routes.select("route_id").distinct().join(last, "route_id", "left")
    return out.select("route_id", F.coalesce("e.status", F.lit("pending")).alias("status"), *[F.col(f"e.{v}").alias(v) for v in values])


def verification_errors(v: DataFrame) -> DataFrame:
    """v with reasons: why a verification can't be attached (an empty array: it can)."""
    out_of = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.col(c).between(0, 1), F.lit(False))
    reasons = F.array(
        F.when(F.col("success").isNull(), "success_missing"), F.when(F.col("success") & F.col("cause").isNotNull(), "success_with_cause"),
        F.when(F.col("cause").isNotNull() & ~F.col("cause").isin(*VERIFIED_CAUSES), "unknown_cause"), F.when(out_of("quality"), "quality_range"), F.when(out_of("confidence"), "confidence_range"),
    )
    return v.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))


def attach_verifications(outcomes: DataFrame, v: DataFrame) -> DataFrame:
    """Outcomes with the last valid verification of each; a final outcome takes one as well."""
    valid = verification_errors(v).where(F.size("reasons") == 0)
    last = valid.groupBy("route_id").agg(F.max_by(F.struct("success", "cause", "quality", "confidence"), F.struct("verified_at", "seq")).alias("v"))
    return outcomes.join(last, "route_id", "left").select(outcomes["*"], F.col("v.success").alias("verified_success"), F.col("v.cause").alias("verification_cause"), F.col("v.quality").alias("quality"), F.col("v.confidence").alias("confidence"))


def latest_open(outcomes: DataFrame) -> DataFrame:
    """Of each session the open outcome with the highest turn_index, then ts: the one that the next turn finalizes."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_index"), F.desc("ts"), F.desc("route_id"))
    return outcomes.where("status <> 'closed_final'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def finalize(outcomes: DataFrame, next_turns: DataFrame) -> DataFrame:
    """Outcomes after each session's next turn: its latest open one is final, with retry, interrupt, and a cause if it had none.

    next_turns: session_id, prev_interrupted, prev_retried.
    """
    open_now = latest_open(outcomes).select("route_id", F.lit(True).alias("_open"))
    both = outcomes.join(open_now, "route_id", "left").join(next_turns, "session_id", "left")
    hit = F.col("_open").isNotNull() & F.col("prev_interrupted").isNotNull()
    return both.withColumns({
        "status": F.when(hit, "closed_final").otherwise(F.col("status")), "user_retried": F.when(hit, F.col("prev_retried")).otherwise(F.col("user_retried")),
        "interrupted": F.when(hit, F.col("interrupted") | F.col("prev_interrupted")).otherwise(F.col("interrupted")),
        "failure_cause": F.when(hit & F.col("prev_interrupted"), F.coalesce("failure_cause", F.lit("user_abort"))).otherwise(F.col("failure_cause")),
    }).select(*outcomes.columns)


def append_evidence_once(known: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): a known key with the same content is skipped, with other content a conflict."""
    digest = lambda df: df.withColumn("_h", F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))), 256))
    n, k = digest(new), digest(known).select(key, F.col("_h").alias("_k"))
    return n.join(k, key, "left_anti").drop("_h"), n.join(k, key).where("_h <> _k").drop("_h", "_k")


def route_id(session: Column, turn_index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", session.cast("string"), turn_index.cast("string")), 256), 1, 32)


def epoch_of_iso(value: Column) -> Column:
    """Seconds since 1970 of an ISO time, UTC where it names no zone; 0 for anything else."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(value)) / 1e6, F.lit(0.0))
