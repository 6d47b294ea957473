"""The policy and the outcome labels against plain Python on every combination of their inputs."""

import itertools
import random

from pyspark.sql import functions as F

from tracemill.operators import outcomes as O
from tracemill.operators import policy as P


def expected(ctx, pinned, escalated, route, terse, interrupted, score):
    if pinned:
        return ("local", "gate:pin_context_conflict") if ctx > 26214.4 else ("local", "gate:privacy")
    if ctx > 26214.4:
        return ("cheap_cloud" if ctx <= 160_000 else "frontier", "gate:feasibility")
    if escalated:
        return (route if route != "local" else "frontier", "gate:hysteresis")
    if terse:
        return (route, "continuation")
    if interrupted:
        return ("frontier", "heuristic:retry_signal")
    if score < 0.35:
        return ("local", "heuristic")
    if score > 0.70:
        return ("frontier", "heuristic")
    return ("local", "middle_default")


def test_route_truth_table(spark):
    cases = list(itertools.product([0, 26214, 26215, 160_000, 160_001], [True, False], [True, False], ["local", "cheap_cloud"], [True, False], [True, False], [0.34, 0.35, 0.70, 0.71]))
    df = spark.createDataFrame(cases, "context_tokens long, pinned boolean, escalated boolean, route string, terse boolean, interrupted boolean, score double")
    f = {c: F.col(c) for c in df.columns}
    for r in df.withColumn("r", P.route(f)).collect():
        assert (r.r.rung, r.r.layer) == expected(*r[:7]), r


def test_classifier_only_for_the_middle(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, False), (0.5, None), (0.2, True)], "score double, v boolean")
    f = {"context_tokens": F.lit(0), "pinned": F.lit(False), "escalated": F.lit(False), "route": F.lit("local"), "terse": F.lit(False), "interrupted": F.lit(False), "score": F.col("score")}
    got = [(r.r.rung, r.r.layer) for r in df.withColumn("r", P.route(f, verdict=F.col("v"))).collect()]
    assert got == [("frontier", "classifier"), ("local", "classifier"), ("local", "middle_default"), ("local", "heuristic")]


def hard(signal, escalated, retried, proxy, verified, rung, cause):
    if verified is False and (cause or "") in ("", "task_capability"):
        return True
    if verified is True and (rung or "").replace("_", "-") in O.CHEAPER:
        return False
    return bool(signal) if signal is not None else bool(escalated) or bool(retried) or bool(proxy)


def test_effective_label_truth_table(spark):
    three = [True, False, None]
    cases = list(itertools.product(three, three, [None], three, three, ["local", "cheap_cloud", "frontier", None], [None, "", "task_capability", "infrastructure"]))
    df = spark.createDataFrame(cases, "signal boolean, escalated boolean, retried boolean, proxy boolean, verified boolean, rung string, cause string")
    out = df.withColumn("h", O.effective_hard(*[F.col(c) for c in df.columns])).collect()
    assert all(r.h == hard(*r[:7]) for r in out)


def test_hysteresis_stays_up_until_a_boundary(spark):
    rows = [(1, 0, "local", True, False), (1, 1, "local", False, False), (1, 2, "local", False, False), (1, 3, "local", False, True), (2, 0, "frontier", False, False)]
    df = spark.createDataFrame(rows, "session_id long, turn_index int, rung string, fired boolean, boundary boolean")
    got = {(r.session_id, r.turn_index): (r.replayed_rung, r.escalated) for r in P.replay_with_hysteresis(df).collect()}
    assert got == {(1, 0): ("local", True), (1, 1): ("cheap_cloud", True), (1, 2): ("cheap_cloud", True), (1, 3): ("local", False), (2, 0): ("frontier", False)}


def test_hysteresis_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.choice(["local", "cheap_cloud", "frontier", "odd"]), rng.choice([True, False, False, None]), rng.choice([True, False, False, False, None])) for s in range(20) for i in range(40)]
    want = {}
    for s in range(20):
        up, at = False, "local"
        for _, i, rung, fired, boundary in [r for r in rows if r[0] == s]:
            if boundary:
                up, at = False, "local"
            now = (at if at != "local" else "frontier") if up else rung
            if fired:
                up, at = True, P.LADDER.get(now, "frontier")
            want[s, i] = (now, up)
    df = spark.createDataFrame(rows, "session_id long, turn_index int, rung string, fired boolean, boundary boolean")
    assert {(r.session_id, r.turn_index): (r.replayed_rung, r.escalated) for r in P.replay_with_hysteresis(df).collect()} == want


def test_trajectory_populations(spark):
    df = spark.createDataFrame([(1, 0, 2, 0, True, True), (1, 1, 5, 1, False, False), (1, 2, 0, 0, False, True)], "s int, i int, n_error_results int, n_edit_failures int, interrupted boolean, eligible boolean")
    a = [r.recent_errors for r in P.trajectory(df, "s", ["i"]).orderBy("i").collect()]
    b = [r.recent_errors for r in P.trajectory(df, "s", ["i"], F.col("eligible")).orderBy("i").collect()]
    c = [r.recent_errors for r in P.trajectory(df, "s", ["i"], leak=True).orderBy("i").collect()]
    assert (a, b, c) == ([0, 2, 5], [0, None, 2], [2, 5, 0])
