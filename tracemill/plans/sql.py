"""The model's tables and expressions as SQL for an independent engine: common table expressions for the oracles."""

from __future__ import annotations

from tracemill.functions import text as T
from tracemill.plans.model import PROMPTS


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(xs) -> str:
    return "[" + ", ".join(map(quote, dict.fromkeys(xs))) + "]"


def rx(pattern: str, c: str) -> str:
    return f"regexp_matches({c}, {quote('(?i)' + pattern)})"


def cases(c: str, classes: list[tuple], default: str) -> str:
    """The first class whose pattern matches the stripped text."""
    s = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return "CASE " + " ".join(f"WHEN {rx(x[-1], s)} THEN {quote(x[0]) if isinstance(x[0], str) else repr(float(x[0])) + 'e0'}" for x in classes) + f" ELSE {default} END"


PROMPT_ROWS = ", ".join(f"(-1, {i}, {quote(t)})" for i, t in enumerate(PROMPTS))
PROMPT = f"p AS (SELECT conv_id AS session_id, turn AS idx, text FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES {PROMPT_ROWS}) AS v(session_id, idx, text))"
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
TOKENS = f"list_transform({WORDS}, lambda w: lower(trim(w, '.,!?:;()[]\"''')))"
WC = f"len({WORDS})"
LOWER = "(regexp_matches(text, '\\p{L}') AND text = lower(text))"
NO_PUNCT = "(regexp_replace(text, '\\s+$', '') <> '' AND right(regexp_replace(text, '\\s+$', ''), 1) NOT IN ('.', '!', '?', '…'))"
QUESTION = f"(contains(text, '?') OR coalesce(list_contains({strings(T.QUESTION_WORDS)}, {TOKENS}[1]), false))"
PATH = "(regexp_matches(text, '(/Users/|/home/|~/|[A-Za-z]:\\\\)') OR regexp_matches(text, '(/[\\w.\\-]+){2,}'))"
DISFLUENT = f"list_has_any({TOKENS}, {strings(T.DISFLUENCY)})"
TXT = f"(list_has_any({TOKENS}, {strings(T.TXT_SPEAK + T.NO_APOSTROPHE)}) OR regexp_matches(lower(text), '" + "|".join(f"{c}{{3,}}" for c in "abcdefghijklmnopqrstuvwxyz") + "') OR contains(text, '!!') OR contains(text, '??'))"
VERBLESS = f"NOT list_has_any({TOKENS}, {strings(T.VERBS)})"
APPROVES = f"list_has_any({TOKENS}, {strings(T.APPROVAL)})"
ARCHETYPE = f"""CASE WHEN {DISFLUENT} AND {WC} >= 8 THEN 'disfluent-runon' WHEN {WC} >= 50 THEN 'long-plan-paste' WHEN {PATH} THEN 'path-paste'
  WHEN {WC} <= 3 AND (list_has_any({TOKENS}, {strings(T.POLL)}) OR {QUESTION}) THEN 'terse-poll' WHEN {WC} <= 3 AND {APPROVES} THEN 'approval-nudge' WHEN {WC} <= 3 THEN 'terse-poll'
  WHEN {WC} <= 6 AND {APPROVES} AND NOT {QUESTION} THEN 'approval-nudge' WHEN {QUESTION} THEN 'question' ELSE 'coding-ask' END"""
CONTENT = f"list_distinct(list_filter({TOKENS}, lambda t: length(t) > 1 AND NOT list_contains({strings(T.STOP_WORDS)}, t)))"
USERS = f"u AS (SELECT *, {WC} AS wc FROM p WHERE regexp_replace(text, '\\s', '', 'g') <> '')"

RECORDS = "r AS (SELECT conv_id AS session_id, turn AS ordinal, role AS type, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations)"
TURNS = (
    RECORDS
    + """, t0 AS (SELECT session_id, turn_no, coalesce(max(text) FILTER (WHERE type = 'user'), '') AS instruction_text, count(*) FILTER (WHERE type = 'assistant') AS n_continuations,
  coalesce(sum(length(text) // 4) FILTER (WHERE type = 'user'), 0) AS input_tokens, coalesce(sum(length(text) // 4) FILTER (WHERE type = 'assistant'), 0) AS output_tokens, count(*) AS n_records FROM r GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN turn_no = 0 OR regexp_replace(instruction_text, '\\s', '', 'g') = '' THEN 'utility' ELSE 'user_turn' END AS label FROM t0)"""
)
DECISIONS = """d0 AS (SELECT event_id AS route_id, user_id AS session_id, ts, event_type, value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) * 400 AS context_tokens,
  CASE event_type WHEN 'click' THEN 10e-2 WHEN 'view' THEN 20e-2 WHEN 'purchase' THEN 45e-2 WHEN 'error' THEN 55e-2 ELSE 85e-2 END AS base,
  CASE event_type WHEN 'click' THEN 'trivial' WHEN 'view' THEN 'explain' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'fix' ELSE 'hard' END AS verb_class, user_id % 10 = 0 AS pinned,
  coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS recent_errors,
  coalesce(lag(event_type = 'signup' AND value > 200) OVER w, false) AS interrupted, row_number() OVER w - 1 AS turn_index FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d1 AS (SELECT *, greatest(0e0, least(1e0, base + CASE WHEN context_tokens > 20000 THEN 10e-2 ELSE 0e0 END)) AS intent FROM d0),
d2 AS (SELECT *, greatest(0e0, least(1e0, intent + 0e0 + CASE WHEN recent_errors >= 3 THEN 10e-2 ELSE 0e0 END + CASE WHEN interrupted THEN 30e-2 ELSE 0e0 END)) AS heuristic FROM d1),
d AS (SELECT *, CASE WHEN pinned AND context_tokens > 26214.4 THEN 'gate:pin_context_conflict' WHEN pinned THEN 'gate:privacy' WHEN context_tokens > 26214.4 THEN 'gate:feasibility'
    WHEN interrupted THEN 'heuristic:retry_signal' WHEN heuristic < 35e-2 OR heuristic > 70e-2 THEN 'heuristic' ELSE 'middle_default' END AS layer,
  CASE WHEN pinned THEN 'local' WHEN context_tokens > 26214.4 THEN 'cheap_cloud' WHEN interrupted OR heuristic > 70e-2 THEN 'frontier' ELSE 'local' END AS rung FROM d2)"""
OUTCOMES = """o0 AS (SELECT event_id AS route_id, user_id AS session_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_results, event_type = 'signup' AND value > 200 AS was_interrupted,
  CAST(floor(value / 20) AS INTEGER) AS continuation_count, CASE WHEN event_type = 'purchase' THEN true WHEN event_type = 'error' AND value > 150 THEN false END AS verified_success,
  CASE WHEN event_type = 'signup' THEN 'loop' WHEN event_type = 'error' AND value > 250 THEN 'edit_apply' END AS tripwire_name FROM events),
o AS (SELECT *, CASE tripwire_name WHEN 'loop' THEN 'difficulty' WHEN 'edit_apply' THEN 'dialect' END AS tripwire_type, error_results >= 1 OR was_interrupted OR continuation_count >= 10 AS proxy_hard,
  continuation_count >= 10 OR coalesce(tripwire_name = 'loop', false) AS signal, tripwire_name IS NOT NULL AND session_id % 3 = 0 AS escalated FROM o0)"""
JUDGED = (
    DECISIONS + ", " + OUTCOMES
    + """, j AS (SELECT d.*, o.* EXCLUDE (route_id, session_id), CASE WHEN NOT verified_success THEN true WHEN verified_success AND rung IN ('local', 'cheap_cloud') THEN false ELSE signal END AS hard FROM d JOIN o USING (route_id))"""
)
VECTORS = JUDGED + """, v AS (SELECT vec_id AS route_id, embedding AS vec, CASE WHEN label % 4 = 0 THEN 'simulator' ELSE 'organic' END AS source, epoch_us(ts) / 1e6 AS ts, hard FROM embeddings JOIN j ON vec_id = route_id)"""
PAIRS = VECTORS + """, pr AS (SELECT * FROM (SELECT a.route_id AS target, b.route_id AS neighbor, list_cosine_similarity(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])) AS sim, a.source AS t_source, b.source AS source, a.ts AS t_ts, b.ts AS ts, a.hard AS t_hard, b.hard AS hard
  FROM v a JOIN v b ON b.ts < a.ts) AS x WHERE sim >= {floor} AND NOT (t_source = 'organic' AND source = 'simulator')),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sim DESC, neighbor) AS rank FROM pr) AS y WHERE rank <= 12)"""
CAPTURES = """cp AS (SELECT page_id AS seq, CASE WHEN page_id % 13 = 0 THEN '/v1/messages/count_tokens' WHEN page_id % 17 = 0 THEN '/health' ELSE '/v1/messages' END AS path, page_id AS i,
  [1, 64, 4096, 32000][page_id % 4 + 1] AS max_tokens, page_id % 3 = 0 AS has_tools, page_id % 2 = 0 AS tail, page_id % 19 = 0 AS broken, CASE WHEN page_id % 23 = 0 THEN 500 ELSE 200 END AS status,
  length(html) % 997 AS latency_ms, page_id % 2 = 1 AS routed, page_id % 6 = 1 AS fell FROM pages)"""
DISCRIMINATED = CAPTURES + """, dc AS (SELECT *, CASE WHEN contains(path, '/count_tokens') THEN 'passthrough:count_tokens' WHEN path = '/health' THEN 'passthrough:non_api' WHEN broken THEN 'user_turn' WHEN max_tokens <= 2 THEN 'utility:prewarm'
  WHEN NOT has_tools AND max_tokens <= 8192 AND (CASE WHEN tail THEN 3 ELSE 1 END) <= 2 THEN 'utility:sidecar' WHEN i % 11 = 5 THEN 'utility:compaction' WHEN tail THEN 'continuation' ELSE 'user_turn' END AS label,
  CASE WHEN broken THEN 'unknown' WHEN i % 11 = 5 THEN 'unknown' WHEN i % 5 = 0 THEN 'cli' WHEN i % 5 = 1 THEN 'sdk' ELSE 'unknown' END AS entrypoint FROM cp)"""
