import json
from datetime import datetime

from pyspark.sql import functions as F

from tracemill.operators import governance as G
from tracemill.operators import realism as R
from tracemill.operators import reports as RP
from tracemill.streaming import sessions as ST

GOOD = {"verb_class": "fix", "verb_score": 0.5, "broad_scope": False, "narrow_scope": True, "context_tokens": 10, "turn_index": 0, "recent_errors": 0, "recent_edit_failures": 0, "prev_turn_interrupted": False}


def test_feature_contract(spark):
    cases = [GOOD, GOOD | {"rung": "local"}, GOOD | {"novel": 1}, {k: v for k, v in GOOD.items() if k != "turn_index"}, GOOD | {"turn_index": True}, GOOD | {"verb_score": 1.5}, GOOD | {"verb_class": "odd"}, GOOD | {"extra": {}}]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases] + [("nope",)], "p string")
    got = [r[0] for r in df.select(G.feature_reasons(F.col("p"))).collect()]
    assert got == [[], ["forbidden: rung"], ["unknown: novel"], ["missing: turn_index"], ["bad: turn_index"], ["bad: verb_score"], ["bad: verb_class"], [], ["not json"]] or got[-1][0] == "not json"
    assert got[:8] == [[], ["forbidden: rung"], ["unknown: novel"], ["missing: turn_index"], ["bad: turn_index"], ["bad: verb_score"], ["bad: verb_class"], []]
    r = spark.createDataFrame([(json.dumps(GOOD | {"privacy_pinned": True}),)], "p string").select(G.eligibility_reasons(F.lit("simulator"), F.lit("middle_default"), F.col("p"))).first()[0]
    assert r == ["ineligible source", "gate active: privacy_pinned"]
    t = spark.createDataFrame([('{"called": false, "resolver": "none"}', None), ('{"called": true, "abstained": false}', "hard"), ('{"called": true, "abstained": false}', None), ("{}", "hard")], "t string, tier string")
    assert [x[0] for x in t.select(G.provenance_complete(F.col("t"), F.col("tier"))).collect()] == [True, True, False, False]


def test_pairs_splits_and_audit(spark):
    base = ("t", "repo", "c", "v", "f")
    rows = [(1, "x", "local", *base, 1.0), (1, "y", "frontier", *base, 2.0), (2, "x", "local", *base, 1.0), (3, "x", "local", *base, 1.0), (3, "x", "frontier", "t", "repo", "other", "v", "f", 9.0)]
    df = spark.createDataFrame(rows, "pair_id int, candidate string, rung string, task_id string, repository string, base_commit string, verifier string, feature_sha256 string, at double")
    got = {r.pair_id: r.reasons for r in G.pair_problems(df).collect()}
    assert got == {1: [], 2: ["no frontier"], 3: ["repeated candidate", "differs: base_commit"]}
    s = {r.pair_id: r.split for r in G.split(df, F.lit(5.0), []).collect()}
    assert s == {1: "train", 2: "train", 3: "straddle"}
    assert {r.split for r in G.split(df, F.lit(5.0), ["repo"]).collect()} == {"repository"}
    reviews = spark.createDataFrame([("a", True, 1.0), ("a", False, 2.0), ("zz", True, 1.0), ("b", False, 1.0)], "evidence_id string, agrees boolean, reviewed_at double")
    audit = G.label_audit(reviews, spark.createDataFrame([("a", "s"), ("b", "s")], "evidence_id string, stratum string")).collect()
    assert [(r.reviews, r.agreed, r.passes) for r in audit] == [(2, 1, False)]


def test_gates_chain_and_verification(spark):
    c = spark.createDataFrame([(0, 0, 0, True, 1, 0)], "invalid int, usable int, complete int, audit_passes boolean, pairs int, organic_pairs int")
    assert [r.status for r in G.gates(c).collect()] == ["pass", "blocked", "not_evaluated", "pass", "pass", "blocked", "blocked"]
    import hashlib

    prev, rows = None, []
    for i, p in enumerate(["a", "b", "c"]):
        h = hashlib.sha256(f"{prev or ''}\n{p}".encode()).hexdigest()
        rows.append((i, p, p, prev, h))
        prev = h
    schema = "seq int, snapshot_id string, payload string, previous_sha256 string, entry_sha256 string"
    assert G.chain_problems(spark.createDataFrame(rows, schema)).count() == 0
    rows[1] = (1, "b", "B", rows[1][3], rows[1][4])
    assert [(r.seq, r.reasons) for r in G.chain_problems(spark.createDataFrame(rows, schema)).collect()] == [(1, ["content differs"])]
    checks = spark.createDataFrame([("x", "a", "pass", "pass", 0), ("x", "b", "fail", "pass", 0), ("y", "a", "pass", "fail", 0), ("z", "a", "timeout", None, 0)], "candidate string, name string, status string, baseline string, violations int")
    got = {r.candidate: (r.outcome, r.cause, r.regressions, r.improvements) for r in G.verification(checks).collect()}
    assert got == {"x": ("fail", "task_capability", ["b"], []), "y": ("pass", None, [], ["a"]), "z": ("unknown", "infrastructure", [], [])}
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert G.dataset_sha256(a) == G.dataset_sha256(a.orderBy(F.desc("k"))) != G.dataset_sha256(a.withColumn("v", F.lit("z")))


def test_a_stream_with_right_marginals_fails_jointly(spark):
    def turns(texts):
        return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "session_id long, idx long, text string").withColumns({"is_user": F.lit(True), "interrupted": F.lit(False), "n_continuations": F.lit(1), "source_kind": F.lit("main"), "n_assistant_msgs": F.lit(1), "n_tool_uses": F.lit(0), "input_tokens": F.lit(1), "cache_read_tokens": F.lit(0), "n_error_results": F.lit(0), "edit_tripwire": F.lit(False), "secret_shaped": F.lit(False)})

    corpus = turns(["Please fix the parser."] * 8 + ["word " * 60 + "Stop."] * 2)
    odd = turns(["Please fix the parser."] * 8 + ["blue stone " * 30] * 2)
    got = {r.metric: r.verdict for r in R.scorecard(corpus, odd).collect()}
    assert len(got) == 28 and got["joint::pct_lowercase_given_long"] == "FAIL" and got["joint::archetype_mix_tvd"] == "PASS"
    assert got["failure::pct_ge1_error"] == "NO DATA"
    assert R.gate(R.scorecard(corpus, odd)).first().passed is False


def test_vote_ties_go_to_the_first_seen_and_samples_are_exact(spark):
    p = spark.createDataFrame([("i", 0, "hard"), ("i", 1, "trivial"), ("j", 0, None)], "item string, idx int, tier string")
    assert [tuple(r)[:2] for r in RP.majority_vote(p).collect()] == [("i", "hard")]
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 3, "rare").otherwise("common"))
    s = RP.stratified_sample(df, "c", "id", 50)
    assert {r.c: r["count"] for r in s.groupBy("c").count().collect()} == {"rare": 1, "common": 49}
    assert s.select("id").exceptAll(RP.stratified_sample(df.repartition(7), "c", "id", 50).select("id")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, datetime(2024, 1, 1, 0, i), "k", "cheap_cloud" if i % 4 == 0 else "local", i % 5 == 0, i == 7, i % 6 == 0) for i in range(30)]
    df = spark.createDataFrame(rows, ST.EVENT)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ST.session_state(ST.event_stream(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, ST.session_state_batch(df).collect())) and len(got) == 30


def test_stream_drops_repeated_events(spark, tmp_path):
    rows = [(i // 2, 1, datetime(2024, 1, 1), "k", "local", False, False, False) for i in range(10)]
    spark.createDataFrame(rows, ST.EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ST.once(ST.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 5


def test_history_appends_once(spark):
    import pytest

    schema = "seq long, snapshot_id string, payload string, previous_sha256 string, entry_sha256 string"
    report = lambda s, p: spark.createDataFrame([(s, p)], "snapshot_id string, payload string")
    first = G.next_entries(spark.createDataFrame([], schema), report("a", "x"))
    assert [(r.seq, r.previous_sha256) for r in first.collect()] == [(0, None)]
    history = spark.createDataFrame(first.select("seq", "snapshot_id", "payload", "previous_sha256", "entry_sha256").collect(), schema)
    second = G.next_entries(history, report("b", "y")).first()
    assert (second.seq, second.previous_sha256) == (1, history.first().entry_sha256)
    assert G.next_entries(history, report("a", "x")).count() == 0
    with pytest.raises(Exception, match="different evidence"):
        G.next_entries(history, report("a", "z")).collect()


def test_taxonomy_rows(spark):
    rows = [(1, "D-FND-001", "d", "Accepted", "D1 Code", "e"), (2, "D-FND-003", "d", "Accepted", "D1 Code", "e"), (3, "D-FND-001", "d", "Gone", "D1 Code", ""), (4, "X-1", "d", "Accepted", "D1 Code", "e"), (5, "D-ZZZ-001", None, "Accepted", None, "e"), (6, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "line int, id string, decision string, state string, maturity string, evidence string")
    got = {r.line: r.reasons for r in G.taxonomy_problems(df, "D").collect()}
    assert got == {2: ["number does not follow"], 3: ["repeated id", "unknown state", "empty cell", "number does not follow"], 4: ["malformed id"], 5: ["unknown bucket", "unknown maturity", "empty cell"], 6: ["malformed id"]}


def test_a_payload_is_parsed_once(spark):
    odd = [None, "", "null", "[]", '{"verb_class": null}', '{"verb_score": 2, "context_tokens": 1.5, "privacy_pinned": true}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(odd)], "i int, p string")
    got = df.select("i", G.eligibility_reasons(F.lit("organic"), F.lit("classifier"), F.col("p")).alias("r"))
    rows = [r.r for r in got.orderBy("i").collect()]
    missing = lambda *but: "missing: " + ",".join(sorted({f[0] for f in G.FEATURES} - set(but)))
    assert rows[:4] == [["not json"], ["not json"], [missing()], [missing()]]
    assert rows[4:] == [[missing("verb_class"), "bad: verb_class"], ["gate active: privacy_pinned", missing("verb_score", "context_tokens"), "bad: verb_score", "bad: context_tokens"]]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
