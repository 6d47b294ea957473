"""The circuit breaker of each rung: closed, open for a time after failures, then half-open for one trial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.scans import Running, running

#: Failures that open a circuit, and seconds until a trial.
THRESHOLD, COOLDOWN_S = 1, 30.0


def normal_rung(rung: Column) -> Column:
    name = F.replace(F.coalesce(rung, F.lit("")), F.lit("-"), F.lit("_"))
    return F.when(name.isin("local", "local_code", "local_small"), "local").otherwise(name)


def breaker(events: DataFrame, threshold: int = THRESHOLD, cooldown_s: float = COOLDOWN_S) -> DataFrame:
    """events with failures (in a row), retry_after (seconds; 0 unless open) and state, as they are after each event.

    events: rung, at (seconds), seq (unique, order of events of one time), kind: success, failure, or anything else, a
    request that asks for the rung's state. A success closes the circuit. The threshold-th failure in a row opens it, and
    each further one opens it again, until cooldown_s after it. A request from then on finds it half-open: it may go, and so
    may others until the trial's success or failure is known. A null rung is one of its own.

    As a fold it would be one task's a rung, and there are few rungs. It needs no fold: the failures in a row are those
    since the last success, and whether a trial began depends on the latest request since the last failure.
    """
    threshold = max(1, threshold)
    rung = normal_rung(F.col("rung"))
    ok, bad = F.coalesce(F.col("kind") == "success", F.lit(False)), F.coalesce(F.col("kind") == "failure", F.lit(False))
    e = events.withColumns({"b_rung": rung, "b_ok": ok.cast("long"), "b_bad": bad.cast("long"), "b_failed": F.when(bad, F.col("at").cast("double"))})
    e = running(e, "b_rung", ["at", "seq"], {"b_run": Running("sum", "b_ok")}).drop("nth")
    e = e.withColumn("b_key", F.concat_ws("/", "b_rung", "b_run"))
    e = running(e, "b_key", ["at", "seq"], {"failures": Running("sum", "b_bad"), "b_last": Running("last", "b_failed")}).drop("nth")
    e = e.withColumns({"b_key": F.concat_ws("/", "b_key", "failures"), "b_asked": F.when(~ok & ~bad, F.col("at").cast("double"))})
    e = running(e, "b_key", ["at", "seq"], {"b_request": Running("max", "b_asked")}).drop("nth")
    until = F.col("b_last") + max(0.0, cooldown_s)
    tripped = F.col("failures") >= threshold
    trial = F.coalesce(F.col("b_request") >= until, F.lit(False))
    state = F.when(~tripped, "closed").when(trial, "half_open").otherwise("open")
    return e.select(*events.columns, "failures", F.when(tripped & ~trial, until).otherwise(F.lit(0.0)).alias("retry_after"), state.alias("state"))
