import json

from pyspark.sql import functions as F

from tracemill.operators import manifests as MF
from tracemill.operators import shadow
from tracemill.sources import transcripts as SRC

FEATURES = json.dumps({"verb_class": "fix", "verb_score": 0.5, "broad_scope": False, "narrow_scope": True, "context_tokens": 10, "turn_index": 0, "recent_errors": 0, "recent_edit_failures": 0, "prev_turn_interrupted": False})
GOOD = {c: "x" for c in MF.REQUIRED} | {"source": "organic", "repository_sha256": "a" * 64, "verification_plan_sha256": "b" * 64, "snapshot_commit": "c" * 40, "decided_at": 1.0, "cost_estimate": 0.0, "latency_ms": 5.0, "quality_score": None, "verifier_confidence": 1.0, "features": FEATURES}
SCHEMA = ", ".join(f"{k} {'double' if k in ('decided_at', 'cost_estimate', 'latency_ms', 'quality_score', 'verifier_confidence') else 'string'}" for k in GOOD)


def test_evidence_reasons(spark):
    rows = [GOOD, GOOD | {"source": "simulator"}, GOOD | {"snapshot_commit": "zz"}, GOOD | {"latency_ms": -1.0}, GOOD | {"quality_score": 1.5}, GOOD | {"model": " "}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    assert [r.reasons for r in MF.evidence_reasons(df).collect()] == [[], ["source not permitted"], ["no commit"], ["not a count: latency_ms"], ["out of range: quality_score"], ["blank: model"]]
    r = spark.range(1).select(*[MF.cause_clean(F.lit(s).cast("boolean"), F.lit(c).cast("string"), F.lit(0.95), F.lit("organic")) for s, c in ((True, None), (False, "task_capability"), (False, "infrastructure"), (None, None))]).first()
    assert tuple(r) == (True, True, False, False)


def test_artefacts_and_forms():
    report = {k: 1 for k in MF.SNAPSHOT_FIELDS}
    contract, base = {"v": 1}, {"score": 40.5}
    report |= {"score_contract": {"sha256": MF.canonical_sha256(contract)}, "baseline": {"sha256": MF.canonical_sha256(base)}}
    report["snapshot_id"] = MF.snapshot_id(report)
    assert MF.cross_check(report, contract, base) == []
    assert MF.cross_check(report | {"counts": 2}, contract, base) == ["snapshot id differs"]
    assert MF.baseline_reasons({"contract_sha256": "h", "score": 40.5}, 40.52, "h") == []
    assert MF.baseline_reasons({"contract_sha256": "x", "score": 41.0}, 40.52, "h") == ["another contract", "score does not follow from the profile"]
    form = {"primary id": "D-1", "secondary ids": "none", "decision effect": "Implements", "maturity transition": "D0 -> D1", "evidence produced": "x", "non-goals": "y"}
    assert MF.change_form_reasons(form, {"D-1"}) == []
    assert MF.change_form_reasons({"secondary ids": "D-9"}, {"D-1"}) == ["primary id unknown", "secondary id unknown: D-9", "effect unknown", "transition malformed", "evidence produced missing", "non-goals missing"]
    assert MF.manifest_reasons({"a_sha256": "no"}, ("b",)) == ["missing: b", "no hash: a_sha256"]


def test_run_ledgers_and_scans(spark):
    lines = spark.createDataFrame([('{"session_id": "a", "prompt": "p"}',), ('{"session_ids": ["b", "c"], "turns": [{"session_id": "d", "prompt": "q"}, {"text": "r"}]}',), ("bad",)], "line string")
    assert {r.session_id for r in SRC.run_sessions(lines).collect()} == {"a", "b", "c", "d"}
    assert sorted(r.text for r in SRC.run_turns(lines).collect()) == ["p", "q", "r"]
    scan = spark.createDataFrame([('{"would_have_pinned": [["s1", {"first_hit_turn_index": 3}], "s2"]}',)], "value string")
    assert {(r.session_id, r.first_hit) for r in SRC.secret_sessions(scan).collect()} == {("s1", 3), ("s2", None)}
    table = spark.createDataFrame([("| D-01 | a | b | c | d |",), ("|---|---|---|---|---|",), ("text",)], "value string")
    assert [(r.number, r.cells[1]) for r in SRC.decision_table(table).collect()] == [(1, "a")]


def test_sinks_and_strict_reads(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, {"Read": 2}, ["m"])], "i int, tools map<string,int>, models array<string>")
    SRC.write_turns(df, str(tmp_path / "p"))
    SRC.write_turns(df, str(tmp_path / "c"), csv=True)
    assert spark.read.parquet(str(tmp_path / "p")).first().tools == {"Read": 2}
    assert spark.read.option("header", True).option("escape", '"').option("quote", '"').csv(str(tmp_path / "c")).count() == 1
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n[2]\n')
    with pytest.raises(Exception):  # noqa: B017
        SRC.strict_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_captures_and_enrichment(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"method": "POST", "path": "/v1/messages", "status": 200, "latency_ms": 4, "request_body": {"max_tokens": 1}}))
    (tmp_path / "2.json").write_text("{broken")
    (tmp_path / "3.json").write_text(json.dumps({"path": "/v1/messages", "status": 500, "request_body": "not json"}))
    got = {r.status: r.body for r in SRC.captures(spark, str(tmp_path)).collect()}
    assert json.loads(got[200]) == {"max_tokens": 1} and got[500] is None
    assert SRC.captures(spark, str(tmp_path), last=1).first().status == 500
    c = spark.createDataFrame([("s", '"tool_use" "tool_use" "is_error": true'), (None, '"tool_use"')], "session_id string, body string")
    out = shadow.enrich(spark.createDataFrame([("s",), ("t",)], "session_id string"), shadow.index_captures(c))
    assert {(r.session_id, r.tool_uses, r.errors) for r in out.collect()} == {("s", 2, 1), ("t", 0, 0)}
