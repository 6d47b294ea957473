import json
import random

from pyspark.sql import functions as F

from tracemill.operators import tripwires as TW
from tracemill.operators import turns as TU
from tracemill.operators import wire as W
from tracemill.operators import wire_blocks as B
from tracemill.sources import transcripts as SRC


def write(tmp_path, name, records):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return p


def user(uuid, text=None, prompt=None, results=None, **more):
    content = text if results is None else [{"type": "tool_result", "tool_use_id": "t", "is_error": e, "content": c} for e, c in results]
    return {"type": "user", "uuid": uuid, "promptId": prompt, "sessionId": "s", "message": {"content": content}} | more


def assistant(uuid, parent, mid, tools=0, out=5, **more):
    blocks = [{"type": "text", "text": "x"}] + [{"type": "tool_use", "id": f"{uuid}{i}", "name": "Read", "input": {"a": i}} for i in range(tools)]
    return {"type": "assistant", "uuid": uuid, "parentUuid": parent, "message": {"id": mid, "model": "m", "usage": {"input_tokens": 3, "output_tokens": out}, "content": blocks}} | more


def test_assembly_of_one_file(spark, tmp_path):
    write(tmp_path, "proj/s.jsonl", [
        user("u1", "fix it", "p1"), assistant("a1", "u1", "m1", 1), assistant("a2", "a1", "m1", 1), user("u2", prompt="p1", results=[(True, TW.EDIT_MARKER), (False, "ok")], parentUuid="a2"),
        {"type": "attachment", "uuid": "x1", "parentUuid": "u2"}, assistant("a3", "x1", "m2", 0, 7), "{broken", "[1, 2]", user("u3", "go on", "p2"), assistant("a4", "a3", "m3"), assistant("a5", "nowhere", "m4"),
        {"type": "system", "subtype": "turn_duration", "uuid": "d1", "parentUuid": "a4", "durationMs": 40.0}, {"type": "novel"}, {"uuid": "q"}])
    parsed = SRC.parse(SRC.files(spark, str(tmp_path)))
    stats = {r["type"]: (r.records, r.unknown) for r in SRC.parse_stats(parsed).collect()}
    assert stats["<bad>"] == (1, False) and stats["<not_object>"] == (1, False) and stats["novel"] == (1, True) and stats["<missing>"][0] == 1
    rows = TU.roll_up(TU.with_turns(TU.first_seen(parsed.where("status = 'ok'")))).orderBy("turn").collect()
    assert [(r.instruction_text, r.label) for r in rows] == [("fix it", "user_turn"), ("go on", "user_turn")]
    a, b = rows
    assert (a.n_continuations, a.n_error_results, a.n_edit_failures, a.n_tool_uses, a.parallel_tool_use_msgs) == (1, 1, 1, 2, 1)
    # m1 repeats its usage; a4 hangs on the first turn's chain; a5's chain is broken, so it belongs to the last opener
    assert (a.n_assistant_msgs, a.output_tokens, b.n_assistant_msgs, b.output_tokens) == (3, 17, 1, 5)
    assert a.tools_used == {"Read": 2} and a.models == ["m"] and a.duration_ms == 40


def test_opener_rule_equals_a_simulation(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for f in range(30):
        seen, current, of_prompt = set(), None, {}
        for i in range(25):
            p, res = rng.choice([None, "a", "b"]), rng.random() < 0.5
            rows.append((f"f{f}", i, 0, "user", f"{f}-{i}", None, "s", p, None, [("tool_result" if res else "text", "x", None, None, None, None, False, "")]))
            if res and (p is None or p in seen):
                turn = of_prompt.get(p, current) if p else current
            else:
                turn = current = i
                if p:
                    of_prompt[p] = i
            if p and not (res and p in seen):
                seen.add(p)
            expected[f"f{f}", i] = turn
    df = spark.createDataFrame(rows, f"source_path string, line_no int, mtime long, type string, uuid string, parent_uuid string, session_id string, prompt_id string, ts string, blocks array<{SRC.BLOCK}>")
    got = {(r.source_path, r.line_no): r.turn.line_no if r.turn else None for r in TU.with_turns(df).collect()}
    assert got == expected


def test_first_file_wins_and_null_uuids_stay(spark):
    df = spark.createDataFrame([("a", 0, 2, "u"), ("b", 0, 1, "u"), ("a", 1, 2, None), ("b", 1, 1, None)], "source_path string, line_no int, mtime long, uuid string")
    assert sorted((r.source_path, r.line_no) for r in TU.first_seen(df).collect()) == [("a", 1), ("b", 0), ("b", 1)]


def test_loops_budgets_and_first_hit(spark):
    calls = spark.createDataFrame([(1, i, c) for i, c in enumerate("abacadaea")] + [(2, i, c) for i, c in enumerate("abcabc")], "turn int, ordinal int, call string")
    assert {(r.turn, r.ordinal) for r in TW.loops(calls).collect()} == {(1, 4), (1, 6), (1, 8)}
    r = spark.createDataFrame([(1, 0, 60, 1.0), (1, 1, 41, 2.0), (1, 2, 0, 100.0), (2, 0, 10, 95.0)], "turn int, ordinal int, output_tokens int, elapsed_s double")
    assert TW.over_budget(r).count() == 0
    assert {(x.turn, x.ordinal, x.reason) for x in TW.over_budget(r, 100, 90.0).collect()} == {(1, 1, "tokens"), (1, 2, "tokens"), (2, 0, "wall_clock")}
    hits = spark.createDataFrame([(1, 4, "loop"), (1, 2, "edit_apply"), (2, 1, "user_interrupt")], "turn int, ordinal int, name string")
    first = TW.first_hit(hits).withColumn("pinned", F.col("turn") == 2).withColumn("rung", F.lit("local"))
    assert {(x.turn, x.name, x.kind, x.target) for x in TW.escalation(first).collect()} == {(1, "edit_apply", "dialect", "cheap-cloud"), (2, "user_interrupt", "quality", "user")}


def test_edit_marker_needs_an_error_and_schema_errors(spark):
    df = spark.createDataFrame([(1, 0, False, TW.EDIT_MARKER, None), (1, 1, True, TW.EDIT_MARKER, None), (1, 2, True, TW.EDIT_MARKER, None), (2, 0, True, "Input validation error", None), (2, 1, None, None, True)], "turn int, ordinal int, is_error boolean, content string, malformed boolean")
    assert [(r.turn, r.ordinal) for r in TW.edit_failures(df).collect()] == [(1, 2)]
    assert [(r.turn, r.ordinal) for r in TW.schema_errors(df).collect()] == [(2, 1)]


def progress_by_hand(results):
    paths, outputs, stuck, out = set(), set(), 0, []
    for _, _, err, content, tool, path in results:
        ok = False
        if not err:
            if tool in TW.READ_TOOLS and path is not None:
                ok |= path not in paths
                paths.add(path)
            ok |= tool in TW.EDIT_TOOLS or content not in outputs
            outputs.add(content)
        stuck = 0 if ok else stuck + 1
        out.append(stuck)
    return out


def test_no_progress_equals_a_simulation(spark):
    rng = random.Random(11)
    rows = [(1, i, rng.random() < 0.4, rng.choice("ab"), rng.choice(["read", "edit", "bash"] if rng.random() < 0.2 else ["read", "bash"]), rng.choice(["p", "q", None])) for i in range(200)]
    got = TW.progress(spark.createDataFrame(rows, "turn int, ordinal int, is_error boolean, content string, tool_name string, path string")).orderBy("ordinal").collect()
    assert [r.stuck for r in got] == progress_by_hand(rows)


def test_canonical_calls(spark):
    df = spark.createDataFrame([('{"p": "/a/b/",  "q": {"z": 1, "a": 2}}',), ('{"q": {"a": 2, "z": 1}, "p": "/a/b"}',)], "j string")
    got = [r[0] for r in df.select(TW.canonical_call(F.lit("Read"), TW.sorted_json("j"))).collect()]
    assert got[0] == got[1]


def test_circuit_and_episodes(spark):
    o = spark.createDataFrame([("r", 0.0, False), ("r", 10.0, True), ("r", 20.0, False), ("r", 55.0, True)], "rung string, ts double, ok boolean")
    assert [r.open for r in TW.circuit(o).orderBy("ts").collect()] == [False, True, False, False]
    t = spark.createDataFrame([("s", 0, "fix a.py", "fix", True), ("s", 1, "great, next: b.py", "write", True), ("s", 2, "b.py again", "write", False)], "session_id string, i int, instruction_text string, verb_class string, clean boolean")
    assert [(r.score, r.boundary) for r in TW.episode_boundary(t, ["i"]).orderBy("i").collect()] == [(0, False), (4, True), (1, False)]


BODIES = [
    ("/v1/messages/count_tokens", "{}", "passthrough:count_tokens"), ("/health", None, "passthrough:non_api"), ("/v1/messages", None, "user_turn"), ("/v1/messages", "[1]", "user_turn"), ("/v1/messages", '{"messages": []}', "utility:prewarm"),
    ("/v1/messages", '{"max_tokens": 64, "messages": [{"role": "user", "content": "x"}]}', "utility:sidecar"), ("/v1/messages", '{"max_tokens": 9000, "system": "Summarize this conversation", "messages": []}', "utility:compaction"),
    ("/v1/messages", '{"max_tokens": 9000, "system": [{"type": "text", "text": "You are summarizing conversations"}], "messages": []}', "utility:compaction"),
    ("/v1/messages", '{"max_tokens": 9000, "tools": [{"name": "a"}], "messages": [{"role": "user", "content": [{"type": "tool_result", "content": "x"}]}]}', "continuation"), ("/v1/messages", '{"max_tokens": 9000, "messages": [{"role": "user", "content": "x"}]}', "user_turn"),
]


def test_discriminator(spark):
    df = spark.createDataFrame(BODIES, "path string, body string, label string")
    for r in df.withColumn("got", W.discriminate(F.col("path"), F.col("body"))).collect():
        assert r.got == r.label, r


def test_wire_details(spark):
    body = '{"system": "cc_entrypoint=cli", "metadata": {"user_id": "{\\"session_id\\": \\"abc\\"}"}, "messages": [{"role": "user", "content": "hello"}, {"role": "user", "content": [{"type": "text", "text": "[Request interrupted by user]"}]}]}'
    r = spark.createDataFrame([(body,)], "b string").select(W.session_key(F.col("b")), W.entrypoint(F.col("b")), W.context_tokens(F.col("b")), W.last_user_text(F.col("b")), W.previous_interrupted(F.col("b"))).first()
    assert tuple(r) == ("abc", "cli", (17 + 5 + 29) // 4, "[Request interrupted by user]", True)


def test_sse_and_rebuilding(spark):
    sse = "\n".join(["data: " + json.dumps(x) for x in (
        {"type": "message_start", "message": {"usage": {"output_tokens": 1}}}, {"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}}, {"type": "content_block_delta", "index": 0, "delta": {"text": "he"}},
        {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "t", "name": "Read"}}, {"type": "content_block_delta", "index": 1, "delta": {"partial_json": "{\"a\": "}}, {"type": "content_block_delta", "index": 0, "delta": {"text": "y"}}, {"type": "message_delta", "usage": {"output_tokens": 9}})] + ["data: [DONE]", "junk"])
    m = spark.createDataFrame([(sse,), (None,)], "s string").select(B.reconstruct(F.col("s")).alias("m")).collect()
    assert [(b["type"], b.text, b.name, b.input) for b in m[0].m.blocks] == [("text", "hey", None, None), ("tool_use", None, "Read", '{"a": ')]
    assert m[0].m.output_tokens == 9 and m[1].m.blocks == []
    schema = "messages array<struct<role:string,blocks:array<struct<type:string,text:string,id:string,tool_use_id:string>>>>"
    df = spark.createDataFrame([([("user", [("text", "a", None, None)]), ("assistant", [("thinking", "b", None, None)]), ("assistant", [("tool_use", None, "t", None)]), ("user", [("tool_result", "c", None, "t")])],), ([("user", [("tool_result", "c", None, "x")])],)], schema)
    out = df.select(B.rebuild(F.col("messages"), B.failure_note(F.lit("loop"), F.lit("difficulty"), F.lit(3))).alias("r")).select("r", B.rebuilt_problem(F.col("r")).alias("p")).collect()
    assert [len(r.r) for r in out] == [4, 2] and [r.p for r in out] == [None, "result without its call"]


def parsings(df):
    """How often the plan of df parses JSON."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


def test_a_record_is_read_in_one_pass(spark):
    lines = ["", "null", "[]", "{}", '{"type": 5, "message": {"content": "hey", "usage": {"input_tokens": "7", "output_tokens": 2.9}}}', '{"type": "user", "isMeta": "true", "origin": 1, "message": {"content": [{"type": "text", "text": 5}, 7, {"text": "no"}, {"type": "tool_use", "input": null, "content": [1]}]}}']
    parsed = SRC.parse(spark.createDataFrame([(i, x, "f") for i, x in enumerate(lines)], "i int, line string, file_session string"))
    rows = parsed.orderBy("i").collect()
    assert [(r.status, r.type) for r in rows] == [("bad", "<missing>"), ("not_object", "<missing>"), ("not_object", "<missing>"), ("ok", "<missing>"), ("ok", "5"), ("ok", "user")]
    assert (rows[4].input_tokens, rows[4].output_tokens, [b.text for b in rows[4].blocks]) == (7, 2, ["hey"])
    assert (rows[5].is_meta, rows[5].origin_kind, [(b.type, b.text, b.input, b.content) for b in rows[5].blocks]) == (True, None, [("text", "5", None, None), ("tool_use", None, "null", "[1]")])
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") < 10 and "schemaOfVariant" not in plan


def test_files_that_loop_are_found_in_one_pass_by_file(spark, monkeypatch):
    from tracemill.plans import traffic as X

    # one part would need no exchange by a key
    monkeypatch.setattr(X, "PART_BYTES", 8 << 10)
    found = X.looping(spark, "/root/testdata/sf0.001")
    # parsed once, and dealt by order, by file, by file and prompt after the calls' Python, and what loops by file
    assert parsings(found) == 1
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    calls = spark.createDataFrame([("f", "p", i, c) for i, c in enumerate("aabaccc")] + [("f", "q", 9, "a"), ("g", "p", 1, "a")], "file string, prompt string, ordinal int, call string")
    assert sorted((r.file, r.prompt, r.ordinal) for r in TW.loops(calls, by=("file", "prompt")).collect()) == [("f", "p", 3), ("f", "p", 6)]


def test_turns_are_dealt_into_parts_of_a_size(spark, tmp_path, monkeypatch):
    from tracemill.plans import shared
    from tracemill.plans import traffic as X

    monkeypatch.setattr(X, "PART_BYTES", 8 << 10)
    monkeypatch.setattr(shared, "folder", lambda spark, name: f"file://{tmp_path}/{name}")
    sf = "/root/testdata/sf0.001"
    n = X._parts(spark, sf)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert X.turns(spark, sf).count() > 0
    for made in ("traffic/records", "turns/rows", "traffic/turns"):
        assert len(list((tmp_path / made).glob("part-*"))) == n
