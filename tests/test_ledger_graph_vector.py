import random
import struct

from pyspark.sql import functions as F

from tracemill.operators import graph as GR
from tracemill.operators import ledger as L
from tracemill.operators import vector as V

RANK = {"pending": 0, "closed_turn": 1, "closed_final": 2}


def simulate(events, routes):
    state, ids = {r: ("pending", None, 0) for r in routes}, set()
    for eid, route, _, status, v in events:
        if eid in ids or route not in state or status not in RANK:
            continue
        if RANK[status] >= state[route][2] and state[route][2] < 2:
            state[route] = (status, v, RANK[status])
            ids.add(eid)
    return {r: s[:2] for r, s in state.items()}


def test_fold_equals_a_simulation_of_random_sequences(spark):
    rng = random.Random(3)
    routes = list(range(40))
    events = [(i, rng.choice([*routes, 99]), i, rng.choice([*RANK, "odd"]), rng.random()) for i in range(600)]
    got = L.fold(spark.createDataFrame(events, "event_id long, route_id long, seq long, status string, v double"), spark.createDataFrame([(r,) for r in routes], "route_id long"), ["v"])
    assert {r.route_id: (r.status, r.v) for r in got.collect()} == simulate(events, routes)


def test_recording_twice_changes_nothing(spark):
    new = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 1.0)], "route_id long, ts double")
    first = L.record_decisions(new.limit(0), new)
    assert sorted(map(tuple, first.collect())) == [(1, 5.0), (2, 1.0)]
    assert L.record_decisions(first, new).count() == 0


def test_verification_reasons_and_last_valid_wins(spark):
    v = spark.createDataFrame([(1, True, None, 0.5, 0.9, 1.0, 1), (1, False, "task_capability", None, None, 2.0, 2), (1, True, "task_capability", None, None, 3.0, 3), (1, True, None, 1.5, None, 4.0, 4)], "route_id long, success boolean, cause string, quality double, confidence double, verified_at double, seq long")
    assert [r.reasons for r in L.verification_errors(v).orderBy("seq").collect()] == [[], [], ["success_with_cause"], ["quality_range"]]
    out = L.attach_verifications(spark.createDataFrame([(1, "closed_final"), (2, "pending")], "route_id long, status string"), v)
    assert {r.route_id: r.verified_success for r in out.collect()} == {1: False, 2: None}


def test_finalize_the_newest_open_row_only(spark):
    o = spark.createDataFrame([(1, 7, 0, 1.0, "closed_turn", None, False, None), (2, 7, 1, 2.0, "closed_turn", None, False, None), (3, 7, 2, 3.0, "closed_final", None, False, None)], "route_id long, session_id long, turn_index int, ts double, status string, user_retried boolean, interrupted boolean, failure_cause string")
    nxt = spark.createDataFrame([(7, True, True)], "session_id long, prev_interrupted boolean, prev_retried boolean")
    got = {r.route_id: (r.status, r.failure_cause) for r in L.finalize(o, nxt).collect()}
    assert got == {1: ("closed_turn", None), 2: ("closed_final", "user_abort"), 3: ("closed_final", None)}


def test_evidence_conflicts(spark):
    known = spark.createDataFrame([("a", 1)], "id string, x int")
    new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    add, bad = L.append_evidence_once(known, new, "id")
    assert [r.id for r in add.collect()] == ["b"] and bad.count() == 0
    assert L.append_evidence_once(known, spark.createDataFrame([("a", 2)], "id string, x int"), "id")[1].count() == 1
    r = spark.range(1).select(L.epoch_of_iso(F.lit("1970-01-01T00:00:01Z")), L.epoch_of_iso(F.lit("x"))).first()
    assert tuple(r) == (1.0, 0.0)


def test_k_hop_with_a_cycle_and_ancestry(spark):
    e = spark.createDataFrame([(1, 1, 2, "a"), (2, 2, 3, "a"), (3, 3, 1, "a"), (4, 3, 4, "b"), (5, 9, 9, "a")], "id long, src long, dst long, kind string")
    one = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.distance) for r in GR.k_hop(e, one, 3, "out").collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {(r.id, r.distance) for r in GR.k_hop(e, one, 1, "both").collect()} == {(1, 0), (2, 1), (3, 1)}
    assert {(r.depth, r.id) for r in GR.ancestry(e, one).collect()} == {(0, 1), (1, 2), (2, 3)}
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id long")
    loop = GR.neighbors(nodes, e, spark.createDataFrame([(9,)], "id long"), "both").collect()
    assert len(loop) == 2  # a loop is seen from both of its ends
    assert {r.id for r in GR.neighbors(nodes, e, spark.createDataFrame([(3,)], "id long"), "out", ["b"]).collect()} == {4}


def test_projection_of_open_and_closed_rows(spark):
    rows = [(1, 10, "local", "heuristic", ["r1", "r2"], "closed_turn", True, "loop"), (2, 10, "local", "gate:privacy", [], "closed_final", False, None), (3, 11, "frontier", "heuristic", [], "pending", True, "loop"), (4, 11, "local", "middle_default", None, None, None, None)]
    df = spark.createDataFrame(rows, "route_id long, session_id long, rung string, layer string, fired_rules array<string>, status string, escalated boolean, tripwire_name string")
    nodes, edges = GR.project(df)
    got = {(r.what, r.kind): r.n for r in GR.counts(nodes, edges).collect()}
    assert got == {("node", "turn"): 4, ("node", "session"): 2, ("node", "rung"): 3, ("node", "rule"): 5, ("node", "tripwire"): 1, ("edge", "in_session"): 4, ("edge", "routed_to"): 4, ("edge", "fired"): 5, ("edge", "escalated_to"): 1, ("edge", "tripped"): 1}
    up = GR.upsert_nodes(spark.createDataFrame([("a", "k", "old")], "kind string, key string, props string"), spark.createDataFrame([("a", "k", "new", 1), ("a", "k", None, 2)], "kind string, key string, props string, seq long"))
    assert up.first().props == "new"


def seeded(spark, near, target_source="organic"):
    rows = [(i, [1.0, 0.0, 0.0, 0.0], s, float(i), h) for i, (s, h) in enumerate(near)]
    rows.append((99, [1.0, 0.0, 0.0, 0.0], target_source, 50.0, False))
    rows.append((98, [1.0, 0.0, 0.0, 0.0], "organic", 90.0, True))
    return spark.createDataFrame(rows, "route_id long, vec array<float>, source string, ts double, hard boolean")


def vote(df):
    v = V.votes(V.nearest(V.earlier_pairs(df), df)).where("target = 99").collect()
    return v[0] if v else None


def test_votes_abstain_and_keep_the_firewall(spark):
    assert vote(seeded(spark, [("organic", True)] * 4)) is None
    assert vote(seeded(spark, [("organic", True)] * 6)).verdict == "frontier"
    assert vote(seeded(spark, [("organic", False)] * 6)).verdict == "local"
    v = vote(seeded(spark, [("simulator", True)] * 12 + [("organic", False)] * 6))
    assert v.neighbors == 6 and v.verdict == "local"  # the filter comes before the cap
    assert vote(seeded(spark, [("simulator", True)] * 6, "simulator")).verdict == "frontier"


def test_cosine_and_blobs(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.70710678) < 1e-6 and got[1:] == [None, None]
    blobs = spark.createDataFrame([(1, 2, bytearray(struct.pack("<2f", 1.5, -2))), (2, 3, bytearray(b"1234")), (3, 0, bytearray(b""))], "route_id long, dim int, blob binary")
    assert [(r.route_id, r.vec) for r in V.decode_blob(blobs).collect()] == [(1, [1.5, -2.0])]
