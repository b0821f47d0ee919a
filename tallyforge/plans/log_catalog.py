"""Queries over logs: the events table written as log lines and read back, with SQL on the table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators import message_log as m, thread_log as t
from tallyforge.sources.adapters import read

STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their line in their user's file; the first three lines of every fourth file were read before."""
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    stamp = F.when(F.col("event_id") % 13 != 0, F.date_format("ts", STAMP))
    return read(spark, sf_dir, "events").select("*", line.cast("bigint").alias("line"), k.alias("k"), stamp.alias("timestamp"), F.when(F.col("user_id") % 4 == 0, 3).otherwise(0).cast("bigint").alias("after"))


def _every(n: int, value):
    return F.when(F.col("event_id") % n == 0, value)


def message_lines(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """Message logs: clicks and purchases are calls, views are finished turns, signups are users' messages, errors are cut lines; ``also`` names columns of events to go with them."""
    rows = _numbered(spark, sf_dir)
    e, k = F.col("event_id"), F.col("k")
    uuid = F.concat(F.lit("e"), e)
    text = F.concat(F.lit('[{"type":"thinking"},{"type":"text","text":"A'), e, F.lit('"},{"type":"tool_use","name":"Bash","input":{"k":'), k, F.lit('}},{"type":"text","text":"B"}]'))
    said = F.when(e % 2 == 0, F.concat(F.lit('"Hello '), k, F.lit('"'))).otherwise(F.concat(F.lit('[{"type":"image"},{"type":"text","text":"<command-name>'), k, F.lit('"}]')))
    counts = F.struct((k * 10).alias("input_tokens"), (k * 3).alias("output_tokens"), (e % 50).alias("cache_creation_input_tokens"), _every(2, k * 7).alias("cache_read_input_tokens"), F.struct((k % 2).alias("web_search_requests")).alias("server_tool_use"))
    call = F.struct(_every(5, F.lit(None)).otherwise(F.concat(F.lit("m"), k % 4)).alias("id"), F.col("event_type").alias("model"), F.lit("assistant").alias("role"), _every(3, "end_turn").alias("stop_reason"), counts.alias("usage"))
    with_content = lambda message, content: F.concat(F.regexp_replace(F.to_json(message), r"\}$", ""), F.lit(',"content":'), content, F.lit("}"))
    head = F.struct(uuid.alias("uuid"), "timestamp")
    event = lambda head, message: F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"message":'), message, F.lit("}"))
    user_head = F.struct(F.lit("user").alias("type"), *(head[c].alias(c) for c in ("uuid", "timestamp")), F.concat(F.lit(" /work/p"), F.col("user_id") % 6, F.lit(" ")).alias("cwd"), _every(4, F.concat(F.lit("Sum "), e)).alias("summary"), _every(9, F.concat(F.lit("Title "), e)).alias("customTitle"))
    value = (
        F.when(F.col("event_type").isin("click", "purchase"), event(F.struct(F.lit("assistant").alias("type"), *(head[c].alias(c) for c in ("uuid", "timestamp"))), with_content(call, text)))
        .when(F.col("event_type") == "view", F.to_json(F.struct(F.lit("system").alias("type"), F.lit("turn_duration").alias("subtype"), uuid.alias("uuid"), "timestamp", F.floor(F.col("value") * 1000).alias("durationMs"))))
        .when(F.col("event_type") == "signup", event(user_head, with_content(F.struct(F.lit("user").alias("role")), said)))
        .otherwise('{"type":"assistant",')
    )
    return rows.select(F.concat(F.lit("/p/x/s"), "user_id", F.lit(".jsonl")).alias("path"), "after", "line", value.alias("value"), *also)


def thread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread logs: clicks and purchases are totals, views are single counts, signups tell the model, errors the thread or a takeover."""
    rows = _numbered(spark, sf_dir)
    e, k, u = F.col("event_id"), F.col("k"), F.col("user_id")
    count = F.struct((k * 10 + e % 97).alias("input_tokens"), (k * 7).alias("cached_input_tokens"), (k * 3).alias("output_tokens"))
    model = F.concat(F.lit("Vendor/GPT-"), k % 3, F.lit("-20240101"))
    token = lambda info: F.struct(F.lit("token_count").alias("type"), info.alias("info"))
    event = lambda kind, payload: F.to_json(F.struct(F.lit(kind).alias("type"), "timestamp", payload.alias("payload")))
    value = (
        F.when(F.col("event_type") == "click", event("event_msg", token(F.struct(count.alias("total_token_usage")))))
        .when(F.col("event_type") == "purchase", event("event_msg", token(F.struct(count.alias("total_token_usage"), _every(7, model).alias("model")))))
        .when(F.col("event_type") == "view", event("event_msg", token(F.struct(count.alias("last_token_usage")))))
        .when(F.col("event_type") == "signup", event("turn_context", F.struct(model.alias("model"))))
        .when(e % 6 == 0, event("event_msg", F.struct(F.lit("thread_settings_applied").alias("type"))))
        .otherwise(event("session_meta", F.struct(F.concat(F.lit("th"), u).alias("id"), F.concat(F.lit("/work/q"), u % 3).alias("cwd"), F.when(u % 5 == 0, "x").alias("forked_from_id"))))
    )
    return rows.select(F.concat(F.lit("/t/rollout-"), "user_id", F.lit(".jsonl")).alias("path"), "after", "line", value.alias("value"))


LINES = """WITH ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 CASE WHEN event_id % 13 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS stamp, CASE WHEN user_id % 4 = 0 THEN 3 ELSE 0 END AS after FROM events)"""
CALLS = f"""{LINES}, c AS (SELECT *, 'e' || event_id AS uuid, CASE WHEN event_id % 5 = 0 THEN 'e' || event_id ELSE 'm' || (k % 4) END AS mid, CASE WHEN event_id % 3 = 0 THEN 'end_turn' ELSE '' END AS stop,
 k * 10 AS input, k * 3 AS output, event_id % 50 AS cache_creation, CASE WHEN event_id % 2 = 0 THEN k * 7 ELSE 0 END AS cache_read FROM ev WHERE event_type IN ('click', 'purchase') AND line > after)"""
THREADS = f"""{LINES}, own AS (SELECT user_id, min(line) FILTER (event_type = 'error' AND event_id % 6 <> 0) AS meta, min(line) FILTER (event_type = 'error' AND event_id % 6 = 0) AS over FROM ev GROUP BY user_id),
 x AS (SELECT ev.*, own.meta IS NOT NULL AND user_id % 5 = 0 AS fork, own.meta, own.over, k * 10 + event_id % 97 AS ti, k * 7 AS tc, k * 3 AS t_o, event_type IN ('click', 'purchase') AS total,
  CASE WHEN event_type = 'signup' OR (event_type = 'purchase' AND event_id % 7 = 0) THEN 'gpt-' || (k % 3) END AS told FROM ev JOIN own USING (user_id)),
 y AS (SELECT *, last_value(told IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known, first_value(told IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first,
  last_value(CASE WHEN total THEN ti END IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi, last_value(CASE WHEN total THEN tc END IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc,
  last_value(CASE WHEN total THEN t_o END IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po FROM x WINDOW p AS (PARTITION BY user_id ORDER BY line)),
 z AS (SELECT *, CASE WHEN total THEN greatest(ti - coalesce(pi, 0), 0) ELSE ti END AS i, CASE WHEN total THEN greatest(tc - coalesce(pc, 0), 0) ELSE tc END AS c, CASE WHEN total THEN greatest(t_o - coalesce(po, 0), 0) ELSE t_o END AS o FROM y WHERE total OR event_type = 'view'),
 n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY line) AS idx FROM z WHERE i > 0 OR o > 0)"""
THREAD_ROW = """SELECT 'codex:thread-v1:' || CASE WHEN meta IS NULL THEN 'unknown' ELSE 'th' || user_id END || ':' || idx AS uuid, coalesce(stamp, 'now') AS timestamp, coalesce(known, first, 'unknown') AS model, 'codex' AS source,
 CASE WHEN fork THEN '' WHEN meta IS NULL THEN 'rollout-' || user_id ELSE 'th' || user_id END AS session_id, i - least(c, i) AS input, o AS output, CAST(0 AS BIGINT) AS cache_creation, least(c, i) AS cache_read FROM n WHERE (NOT fork OR over IS NULL OR line >= over)"""

#: Name: (query, SQL).
CATALOG = {
    "N1_skipped": (lambda s, d: m.skipped(m.parsed(message_lines(s, d))), f"{LINES} SELECT '/p/x/s' || user_id || '.jsonl' AS path, count(*) AS skipped FROM ev WHERE event_type = 'error' AND line > after GROUP BY user_id"),
    "N2_turns": (lambda s, d: m.turns(m.parsed(message_lines(s, d)), "now"), f"{LINES} SELECT 'e' || event_id AS uuid, coalesce(stamp, 'now') AS timestamp, 's' || user_id AS session_id, CAST(floor(value * 1000) AS BIGINT) AS duration_ms FROM ev WHERE event_type = 'view' AND line > after"),
    "N3_usage": (
        lambda s, d: m.usage(m.parsed(message_lines(s, d)), "now"),
        f"""{CALLS} SELECT uuid, coalesce(stamp, 'now') AS timestamp, event_type AS model, 'claude' AS source, 's' || user_id AS session_id, input, output, cache_creation, cache_read, k % 2 AS web_search, CAST(0 AS BIGINT) AS web_fetch, stop AS stop_reason, '' AS service_tier, CAST(0 AS BIGINT) AS iterations
         FROM c WHERE input + output + cache_creation + cache_read > 0 QUALIFY row_number() OVER (PARTITION BY user_id, mid ORDER BY stop <> '' DESC, output DESC, line) = 1""",
    ),
    "N4_sessions": (
        lambda s, d: m.sessions(m.parsed(message_lines(s, d))),
        f"""{LINES}, g AS (SELECT user_id, arg_min(coalesce(stamp, ''), line) AS started_at, coalesce(arg_max(stamp, line) FILTER (stamp IS NOT NULL), '') AS last_active_at, count(*) FILTER (event_type = 'signup') AS signups,
          arg_max('Title ' || event_id, line) FILTER (event_type = 'signup' AND event_id % 9 = 0) AS given, arg_max('Sum ' || event_id, line) FILTER (event_type = 'signup' AND event_id % 4 = 0) AS summary, arg_min('Hello ' || k, line) FILTER (event_type = 'signup' AND event_id % 2 = 0) AS said
          FROM ev WHERE event_type <> 'error' GROUP BY user_id)
         SELECT 's' || user_id AS id, 'claude' AS source, CASE WHEN signups > 0 THEN '/work/p' || (user_id % 6) ELSE '' END AS project_dir, coalesce(given, summary, said, CASE WHEN signups > 0 THEN 'p' || (user_id % 6) ELSE '' END) AS title_orig, started_at, last_active_at, '' AS agent_type, '' AS parent_session_id FROM g""",
    ),
    "N7_messages": (
        lambda s, d: m.messages(m.parsed(message_lines(s, d))).select("uuid", "session_id", "ts", "role", F.coalesce("model", F.lit("-")).alias("model"), F.coalesce("name", F.lit("-")).alias("name"), "content"),
        f"""{LINES}, n AS (SELECT *, 'e' || event_id AS uuid, 's' || user_id AS session_id, coalesce(stamp, '') AS ts2 FROM ev WHERE line > after)
         SELECT uuid, session_id, ts2 AS ts, 'user' AS role, '-' AS model, '-' AS name, CASE WHEN event_id % 2 = 0 THEN 'Hello ' || k ELSE '<command-name>' || k END AS content FROM n WHERE event_type = 'signup'
         UNION ALL SELECT uuid, session_id, ts2, 'assistant', event_type, '-', 'A' || event_id || chr(10) || 'B' FROM n WHERE event_type IN ('click', 'purchase')
         UNION ALL SELECT uuid || '#tool2', session_id, ts2, 'tool', '-', 'Bash', '{{"k":' || k || '}}' FROM n WHERE event_type IN ('click', 'purchase')""",
    ),
    "N9_thread_usage": (lambda s, d: t.usage(t.parsed(thread_lines(s, d)), "now"), f"{THREADS} {THREAD_ROW} AND line > after"),
    "N12_corrections": (lambda s, d: t.corrections(t.parsed(thread_lines(s, d)), "now"), f"{THREADS} {THREAD_ROW} AND line <= after AND known IS NULL AND first IS NOT NULL"),
    "N14_threads": (
        lambda s, d: t.sessions(t.parsed(thread_lines(s, d))),
        f"""{THREADS} SELECT CASE WHEN any_value(meta) IS NULL THEN 'rollout-' || user_id ELSE 'th' || user_id END AS id, 'codex' AS source, CASE WHEN any_value(meta) IS NULL THEN '' ELSE '/work/q' || (user_id % 3) END AS project_dir,
         CASE WHEN any_value(meta) IS NULL THEN '' ELSE 'q' || (user_id % 3) END AS title_orig, arg_min(coalesce(stamp, ''), line) AS started_at, coalesce(arg_max(stamp, line) FILTER (stamp IS NOT NULL), '') AS last_active_at, '' AS agent_type, '' AS parent_session_id
         FROM x WHERE NOT fork AND NOT (event_type = 'error' AND event_id % 6 = 0) GROUP BY user_id""",
    ),
}
