"""Queries over transcript lines, captures and run ledgers made of the supplied tables, through the readers themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.operators import reports as RP
from tracemill.operators import shadow as SH
from tracemill.operators import turns as TU
from tracemill.operators import vector as V
from tracemill.operators import wire as W
from tracemill.plans import model as M
from tracemill.plans import sql as Q
from tracemill.plans import traffic as X
from tracemill.queries import query
from tracemill.sources import transcripts as SRC


# --- transcripts -----------------------------------------------------------------------------------------------------
@query(f"""WITH {X.ITEMS}, x AS (SELECT CASE k WHEN 'open' THEN 'user' WHEN 'result' THEN 'user' ELSE k END AS type, o FROM k UNION ALL SELECT CASE k WHEN 'open' THEN 'user' WHEN 'result' THEN 'user' ELSE k END, o FROM k WHERE o % 7 = 0
UNION ALL SELECT CASE n WHEN 1 THEN '<bad>' WHEN 2 THEN '<not_object>' ELSE 'novel' END, o FROM k WHERE o % 11 = 0) SELECT type, count(*) AS records, type = 'novel' AS unknown FROM x GROUP BY 1""")
def transcript_record_types(spark, d):
    return SRC.parse_stats(SRC.parse(X.lines(spark, d)))


_ROW = "label, instruction_text, project, agent_id, workflow_id, version, git_branch, source_kind, interrupted, tool_rejected, has_thinking, final_stop_reason, duration_ms, message_count".split(", ")
_COUNTS = "n_continuations, n_assistant_msgs, n_tool_uses, parallel_tool_use_msgs, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, n_error_results, n_edit_failures".split(", ")


@query(f"WITH {X.TURNS} SELECT o, t AS line_no, {', '.join(_ROW)}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTS)}, reads, tasks, array_to_string(models, ',') AS models, length(instruction_text) AS instruction_chars FROM tt")
def transcript_turns(spark, d):
    tool = lambda name: F.coalesce(F.try_element_at("tools_used", F.lit(name)), F.lit(0)).alias
    return X.turns(spark, d).select("o", F.col("turn.line_no").cast("long").alias("line_no"), *_ROW, *[F.col(c).cast("long").alias(c) for c in _COUNTS], tool("Read")("reads"), tool("Task")("tasks"), F.array_join("models", ",").alias("models"), "instruction_chars")


@query(f"WITH {X.TURNS} SELECT label, count(*) AS turns, CAST(sum(n_continuations) AS BIGINT) AS continuations FROM tt GROUP BY label")
def transcript_label_counts(spark, d):
    return RP.label_counts(X.turns(spark, d))


_FLAGS = {"interrupted": "interrupted", "tool_rejected": "tool_rejected", "has_thinking": "has_thinking", "had_errors": "n_error_results > 0", "edit_failed": "n_edit_failures > 0", "edit_tripwire": "n_edit_failures >= 2", "parallel_tool_use": "parallel_tool_use_msgs > 0", "synthetic_model": "list_contains(models, '<synthetic>')"}


@query(f"WITH {X.TURNS} SELECT label, " + ", ".join(f"count(*) FILTER (WHERE {v}) AS {k}" for k, v in _FLAGS.items()) + " FROM tt GROUP BY label")
def transcript_flags(spark, d):
    return X.turns(spark, d).groupBy("label").agg(*[F.count_if(c).alias(k) for k, c in TU.flags().items()])


@query(f"WITH {X.TURNS}, c AS (SELECT o, t, cache_read_tokens + input_tokens AS c, greatest(n_assistant_msgs, 1) AS m FROM tt) SELECT o, t AS line_no, CAST(c // m AS BIGINT) AS whole, CAST(c // m AS BIGINT) AS safe, round(CAST(c AS DOUBLE) / m, 9) AS exact FROM c")
def transcript_context(spark, d):
    c = {"whole": TU.context_per_message("int"), "safe": TU.context_per_message("null_safe"), "exact": F.round(TU.context_per_message("float"), 9)}
    return X.turns(spark, d).select("o", F.col("turn.line_no").cast("long").alias("line_no"), *[v.alias(k) for k, v in c.items()])


@query(f"""WITH {X.TURNS}, i AS (SELECT *, CASE WHEN instruction_text LIKE 'what%' THEN 'explain' WHEN instruction_text LIKE 'fix%' THEN 'fix' ELSE 'other' END AS intent FROM tt)
SELECT intent, count(*) AS turns, CAST(median(n_continuations) AS DOUBLE) AS median_continuations, CAST(median(output_tokens) AS DOUBLE) AS median_output FROM i GROUP BY intent""")
def transcript_intents(spark, d):
    i = RP.intent_medians(X.turns(spark, d))
    return i.withColumns({c: F.col(c).cast("double") for c in ("median_continuations", "median_output")})


@query(f"""WITH {X.TURNS}, m AS (SELECT *, list_filter(models, lambda x: x <> '<synthetic>')[1] AS model FROM tt), e AS (SELECT *, CASE WHEN model LIKE 'alpha%' THEN 5e0 ELSE 1e0 END AS pin, CASE WHEN model LIKE 'alpha%' THEN 25e0 ELSE 5e0 END AS pout FROM m WHERE model IS NOT NULL)
SELECT model, count(*) AS turns, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens,
  round(sum(input_tokens / 1e6 * pin + cache_read_tokens / 1e6 * pin * 0.1e0 + cache_creation_tokens / 1e6 * pin * 1.25e0 + output_tokens / 1e6 * pout), 6) AS usd FROM e GROUP BY model""")
def transcript_economics(spark, d):
    return RP.economics(X.turns(spark, d), X.PRICES).withColumn("usd", F.round("usd", 6))


#: Files that loop: f has the prompt of every record, fl a row for each file and copy.
_LOOPS = """f AS (SELECT *, last_value(CASE WHEN k = 'open' THEN 'p' || o || '-' || n WHEN k = 'result' THEN CASE p % 4 WHEN 0 THEN 'p' || o || '-1' WHEN 2 THEN 'q' || o WHEN 3 THEN 'p' || o || '-' || last_open END END IGNORE NULLS) OVER (PARTITION BY o ORDER BY n) AS prompt FROM an),
uses AS (SELECT o, prompt, n, i, CASE i WHEN 0 THEN 'Read' ELSE CASE WHEN u % 11 = 0 THEN 'Task' ELSE 'Edit' END END || (p % 2) AS call FROM f, (SELECT unnest([0, 1]) AS i) WHERE calls > i),
wi AS (SELECT *, list(call) OVER (PARTITION BY o, prompt ORDER BY n, i ROWS 5 PRECEDING) AS l, first_value(n) OVER (PARTITION BY o, prompt ORDER BY n, i) AS first_n FROM uses),
hi AS (SELECT o, prompt, first_n, count(*) AS loopy_calls FROM wi WHERE len(list_filter(l, lambda x: x = call)) >= 3 GROUP BY 1, 2, 3),
fl AS (SELECT h.*, c.copy FROM (SELECT * FROM hi QUALIFY row_number() OVER (PARTITION BY o ORDER BY first_n) = 1) h, (SELECT unnest([0, 1]) AS copy) c WHERE copy = 0 OR o % 7 = 0)"""


@query(f"WITH {X.RECORDS}, {_LOOPS} SELECT o, copy, prompt, loopy_calls FROM fl")
def transcript_loops(spark, d):
    """Files in which a call comes three times within six, with the first such prompt."""
    path = F.col("source_path")
    return X.looping(spark, d).select(F.regexp_extract(path, r"/s(\d+)", 1).cast("long").alias("o"), F.contains(path, F.lit(".again")).cast("int").alias("copy"), "prompt", "loopy_calls")


@query(f"""WITH {X.TURNS}, {_LOOPS}, s AS (SELECT *, lag(interrupted) OVER (PARTITION BY o ORDER BY t) AS prev, source_kind = 'main' AND label = 'user_turn' AS usr, 1 + (tasks > 0)::INT AS x, len(list_filter(models, lambda m: m <> '<synthetic>')) AS real FROM tt),
a AS (SELECT count(*) FILTER (WHERE usr AND n_continuations >= 5 AND final_stop_reason = 'end_turn' AND n_tool_uses > reads) AS s2, count(*) FILTER (WHERE n_edit_failures >= 1) AS s3, count(*) FILTER (WHERE prev AND label = 'user_turn') AS s6,
  count(*) FILTER (WHERE usr AND instruction_text = 'what does this do?' AND CAST(cache_read_tokens + input_tokens AS DOUBLE) / greatest(n_assistant_msgs, 1) > 50000) AS s8, count(*) FILTER (WHERE usr AND instruction_text LIKE 'refactor%') AS s10, count(*) FILTER (WHERE parallel_tool_use_msgs > 0) AS s12,
  count(*) FILTER (WHERE source_kind = 'main' AND tasks > 0) AS s13, count(*) FILTER (WHERE label = 'utility:compaction') AS s14, count(*) FILTER (WHERE real > 1) AS s15b, count(*) FILTER (WHERE label = 'user_turn' AND instruction_text LIKE 'that%') AS s15a FROM s),
r AS (SELECT unnest(['S2', 'S3', 'S6', 'S8', 'S10', 'S12', 'S13', 'S14', 'S15b', 'S15a', 'S9', 'S4']) AS scenario, unnest([s2, s3, s6, s8, s10, s12, s13, s14, s15b, s15a, (SELECT count(DISTINCT o) FROM tt WHERE o % 10 = 0), (SELECT count(*) FROM fl)]) AS matches FROM a)
SELECT scenario, matches, CASE WHEN scenario = 'S15b' THEN CASE WHEN matches > 0 THEN 'INVARIANT BROKEN' ELSE 'invariant holds' END WHEN matches >= 3 THEN 'confirmed' WHEN matches > 0 THEN 'thin' ELSE 'absent' END AS status FROM r
UNION ALL SELECT unnest(['S1', 'S5', 'S7', 'S11']), NULL, 'verdict only'""")
def transcript_scenarios(spark, d):
    t, looping = X.turns_and_looping(spark, d)
    t = t.withColumn("line", F.col("turn.line_no"))
    return RP.scenarios(t, ["line"], t.where("o % 10 = 0").select("session_id").distinct(), looping)


@query(f"""WITH {X.RECORDS}, f AS (SELECT o, n, last_value(CASE WHEN k = 'open' THEN 'p' || o || '-' || n WHEN k = 'result' THEN CASE p % 4 WHEN 0 THEN 'p' || o || '-1' WHEN 2 THEN 'q' || o WHEN 3 THEN 'p' || o || '-' || last_open END END IGNORE NULLS) OVER (PARTITION BY o ORDER BY n) AS prompt FROM an),
m AS (SELECT ['odd', 'even'][1 + (o % 2 = 0)::INT] AS scenario, 'p' || o || '-' || n AS prompt, o, n FROM k WHERE k = 'open' AND p % 10 = 0), w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY o, prompt) <= 5)
SELECT scenario, prompt, count(*) AS records FROM f JOIN w USING (prompt) GROUP BY 1, 2""")
def transcript_traces(spark, d):
    records = SRC.parse(X.lines(spark, d)).where("status = 'ok' AND mtime = 0 AND type <> 'novel'")
    m = X.items(spark, d).where("k = 'open' AND l_partkey % 10 = 0").select(F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd").alias("scenario"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("prompt"), F.col("l_orderkey").alias("ts"))
    return SRC.traces(records, m).groupBy("scenario", "prompt").agg(F.count("*").alias("records"))


# --- captures --------------------------------------------------------------------------------------------------------
@query("""WITH c AS (SELECT conv_id, turn, text, turn % 4 AS v FROM conversations) SELECT conv_id, turn, CAST((CASE WHEN v = 3 THEN 0 ELSE 4 END + CASE v WHEN 3 THEN 0 ELSE length(text) END + CASE v WHEN 1 THEN 3 WHEN 2 THEN 28 ELSE 0 END) // 4 AS BIGINT) AS tokens,
CASE WHEN v = 2 THEN '[Request interrupted by user' WHEN v = 3 THEN '' ELSE text END AS last_text, coalesce(v = 2 OR (v <> 3 AND contains(text, '[Request interrupted by user')), false) AS interrupted FROM c""")
def request_details(spark, d):
    """Requests of every turn: its text alone, with a tool's result after it, with an interruption, or no object at all."""
    t, v = F.col("text"), F.col("turn") % 4
    said = F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), t.alias("text"), F.lit(None).cast("string").alias("content"))).alias("content"))
    more = lambda kind, text, content: F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit(kind).alias("type"), F.lit(text).cast("string").alias("text"), F.lit(content).cast("string").alias("content"))).alias("content"))
    messages = F.when(v == 1, F.array(said, more("tool_result", None, "abc"))).when(v == 2, F.array(said, more("text", "[Request interrupted by user", None))).otherwise(F.array(said))
    body = F.when(v == 3, "[1]").otherwise(F.to_json(F.struct(F.lit("four").alias("system"), messages.alias("messages"))))
    b = F.col("body")
    c = M.table(spark, d, "conversations").withColumn("body", body)
    return c.select("conv_id", "turn", W.context_tokens(b).alias("tokens"), W.last_user_text(b).alias("last_text"), F.coalesce(W.previous_interrupted(b), F.lit(False)).alias("interrupted"))


@query(f"WITH {Q.DISCRIMINATED}, s AS (SELECT 's' || (i % 7) AS session_id, arg_min(label, seq) AS label FROM dc WHERE NOT broken AND label IN ('user_turn', 'continuation') GROUP BY 1) SELECT session_id, label FROM s WHERE session_id IN ('s1', 's2', 's4') AND label <> 'user_turn'")
def simulator_openers(spark, d):
    c = M.captures(spark, d).withColumns({"label": W.discriminate(F.col("path"), F.col("body")), "session_id": W.session_key(F.col("body"))})
    runs = spark.createDataFrame([('{"session_id": "s1"}',), ('{"turns": [{"session_id": "s2"}, {"session_id": "s4"}]}',)], "line string")
    return W.wrong_openers(c, SRC.run_sessions(runs))


@query("""WITH x AS (SELECT 's' || (page_id % 7) AS session_id, html FROM pages), i AS (SELECT session_id, sum((length(html) - length(replace(html, '<p>', ''))) // 3) AS tool_uses, count(*) * 2 AS errors, 0 AS subagents FROM x GROUP BY 1),
t AS (SELECT DISTINCT 's' || (conv_id % 12) AS session_id FROM conversations) SELECT session_id, CAST(coalesce(tool_uses, 0) AS BIGINT) AS tool_uses, CAST(coalesce(errors, 0) AS BIGINT) AS errors, CAST(coalesce(subagents, 0) AS BIGINT) AS subagents FROM t LEFT JOIN i USING (session_id)""")
def capture_index(spark, d):
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    pages = M.table(spark, d, "pages").select(s(F.col("page_id") % 7).alias("session_id"), F.concat(F.replace("html", F.lit("<p>"), F.lit('"tool_use"')), F.lit('"is_error":true "is_error": true "is_error": false')).alias("body"))
    t = M.table(spark, d, "conversations").select(s(F.col("conv_id") % 12).alias("session_id")).distinct()
    return SH.enrich(t, SH.index_captures(pages)).select("session_id", "tool_uses", "errors", "subagents")


# --- run ledgers, scans, tables --------------------------------------------------------------------------------------
def _runs(spark, d):
    """A run ledger's lines: single shots (with a prompt under one of two keys), lists of sessions, and episodes."""
    c = M.table(spark, d, "conversations").where("text IS NOT NULL")
    s = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    key, v = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(s.alias("session_id"), F.col("text").alias("prompt")))).otherwise(F.to_json(F.struct(s.alias("session_id"), F.col("text").alias("message")))), F.col("turn") % 4
    episode = F.to_json(F.struct(s.alias("session_id"), F.array(F.struct(F.col("text").alias("instruction"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("text")), F.struct(F.lit(None).cast("string").alias("instruction"), F.concat(s, F.lit("b")).alias("session_id"), F.col("text"))).alias("turns")))
    return c.select(F.when(v == 3, episode).when(v == 2, F.to_json(F.struct(F.array(F.concat(s, F.lit("c"))).alias("session_ids")))).otherwise(key).alias("line"))


@query("SELECT DISTINCT session_id FROM (SELECT 's' || conv_id AS session_id FROM conversations WHERE turn % 4 <> 2 AND text IS NOT NULL UNION ALL SELECT 's' || conv_id || 'b' FROM conversations WHERE turn % 4 = 3 AND text IS NOT NULL UNION ALL SELECT 's' || conv_id || 'c' FROM conversations WHERE turn % 4 = 2 AND text IS NOT NULL) AS x")
def run_ledger_sessions(spark, d):
    return SRC.run_sessions(_runs(spark, d))


@query("""SELECT session_id, idx, text, count(*) AS n FROM (SELECT 's' || conv_id AS session_id, 0 AS idx, text FROM conversations WHERE turn % 4 < 2 AND text IS NOT NULL UNION ALL SELECT 's' || conv_id, 0, text FROM conversations WHERE turn % 4 = 3 AND text IS NOT NULL
UNION ALL SELECT 's' || conv_id || 'b', 1, text FROM conversations WHERE turn % 4 = 3 AND text IS NOT NULL) AS x GROUP BY 1, 2, 3""")
def run_ledger_turns(spark, d):
    return SRC.run_turns(_runs(spark, d)).groupBy("session_id", "idx", "text").agg(F.count("*").alias("n"))


@query("SELECT 's' || conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN CAST(min(turn) AS INTEGER) END AS first_hit FROM conversations GROUP BY conv_id")
def secret_scan_sessions(spark, d):
    c = M.table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("t"))
    s = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    pair = F.concat(F.lit('["'), s, F.lit('", {"first_hit_turn_index": '), F.col("t").cast("string"), F.lit("}]"))
    return SRC.secret_sessions(c.select(F.concat(F.lit('{"would_have_pinned": ['), F.when(F.col("conv_id") % 2 == 0, pair).otherwise(F.concat(F.lit('"'), s, F.lit('"'))), F.lit("]}")).alias("value")))


@query("SELECT round(sum(l_extendedprice * l_discount), 4) AS usd FROM lineitem")
def simulator_spend(spark, d):
    return SH.spend(M.table(spark, d, "lineitem").select((F.col("l_extendedprice") * F.col("l_discount")).alias("cost_usd"))).select(F.round("usd", 4).alias("usd"))


@query("SELECT CAST(p_partkey AS INTEGER) AS number, 'D-' || p_partkey AS id, p_brand AS brand, p_type AS type FROM part")
def decision_rows(spark, d):
    p = M.table(spark, d, "part")
    row = F.concat(F.lit("| D-"), F.col("p_partkey").cast("string"), F.lit(" | "), "p_brand", F.lit(" |"), "p_type", F.lit("| x | y |"))
    lines = p.select(row.alias("value")).unionByName(p.select(F.lit("|---|---|---|---|---|").alias("value"))).unionByName(p.select("p_type").toDF("value"))
    return SRC.decision_table(lines).select("number", F.col("cells")[0].alias("id"), F.col("cells")[1].alias("brand"), F.col("cells")[2].alias("type"))


# --- embeddings ------------------------------------------------------------------------------------------------------
@query("SELECT vec_id AS route_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings WHERE vec_id % 5 NOT IN (1, 2)")
def decoded_blobs(spark, d):
    """The vectors as little-endian bytes and back; every fifth blob is too short, every fifth has no dimension."""
    @F.pandas_udf("binary")
    def as_bytes(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    e = M.table(spark, d, "embeddings").select(F.col("vec_id").alias("route_id"), F.size("embedding").alias("size"), as_bytes("embedding").alias("b"))
    k = F.col("route_id") % 5
    rows = e.select("route_id", F.when(k == 1, F.col("b").substr(1, 7)).otherwise(F.col("b")).alias("blob"), F.when(k == 2, 0).otherwise(F.col("size")).alias("dim"))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return V.decode_blob(rows).select("route_id", "dim", F.round(total, 5).alias("total"))


@query(f"WITH {Q.VECTORS} SELECT route_id, 'search_document: ' || CAST(route_id AS VARCHAR) AS stored, 'search_query: ' || CAST(route_id AS VARCHAR) AS asked FROM v")
def embedding_texts(spark, d):
    t = F.col("route_id").cast("string")
    return M.vectors(spark, d).select("route_id", T.for_embedding(t).alias("stored"), T.for_embedding(t, query=True).alias("asked"))
