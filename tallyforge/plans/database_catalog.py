"""Queries over a store of sessions and over logs of session updates, made from the events table, with SQL on the table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import chat_log, database_log as d
from tallyforge.plans.log_catalog import LINES, _numbered
from tallyforge.sources.adapters import read

EPOCH = 1_700_000_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.lit(EPOCH) + F.col("event_id") * 1007).cast("bigint").alias("t"),
        F.concat(F.lit("m"), "event_id").alias("id"), F.concat(F.lit("o"), "user_id").alias("session_id"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user; every third has a blank title."""
    u = F.col("user_id")
    spans = _events(spark, sf_dir).groupBy("user_id").agg(F.min("t").alias("time_created"), (F.min("t") + 5).alias("time_updated"))
    return spans.select(F.concat(F.lit("o"), u).alias("id"), F.when(u % 3 == 0, " ").otherwise(F.concat(F.lit(" Title "), u)).alias("title"), F.concat(F.lit("/work/p"), u % 6).alias("directory"), "time_created", "time_updated")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases are answers, some unfinished; views users' messages, signups answers without tokens, errors broken or of no role."""
    e, k, t = F.col("event_id"), F.col("k"), F.col("t")
    cache = F.struct(F.when(e % 2 == 0, k * 7).alias("read"), (e % 50).alias("write"))
    tokens = F.struct((k * 10).alias("input"), (k * 3).alias("output"), (e % 5).alias("reasoning"), cache.alias("cache"))
    time = F.struct(F.when(e % 13 != 0, t).alias("created"), F.when(e % 997 != 0, t + 1).alias("completed"))
    answer = F.struct(F.lit("assistant").alias("role"), F.when(e % 19 != 0, F.concat(F.lit("M"), k % 3)).alias("modelID"), time.alias("time"), tokens.alias("tokens"))
    data = (
        F.when(F.col("event_type").isin("click", "purchase"), F.to_json(answer))
        .when(F.col("event_type") == "view", '{"role":"user"}')
        .when(F.col("event_type") == "signup", '{"role":"assistant","modelID":""}')
        .when(e % 2 == 0, '{"role":"assistant"')
        .otherwise('{"role":"guest"}')
    )
    return _events(spark, sf_dir).select("id", "session_id", t.alias("time_created"), (t + e % 3).alias("time_updated"), data.alias("data"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each event, blank for some; a tool before it for every third, and a step that says nothing."""
    e, k, t = F.col("event_id"), F.col("k"), F.col("t")
    text = F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("Say "), k))
    kind = lambda n, time, name, **values: F.struct(F.lit(n).alias("n"), (t + time).alias("time_created"), F.to_json(F.struct(F.lit(name).alias("type"), *(v.alias(c) for c, v in values.items()))).alias("data"))
    each = F.array(kind("a", 2, "text", text=text), kind("b", 1, "tool", tool=F.when(e % 3 == 0, "Bash").otherwise("")), kind("c", 0, "step"))
    rows = _events(spark, sf_dir).select("session_id", F.col("id").alias("message_id"), F.explode(each).alias("p"))
    return rows.select(F.concat("p.n", "message_id").alias("id"), "message_id", "session_id", "p.time_created", "p.data")


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users divisible by 4 were read to their end, those of the next to their start."""
    own = _events(spark, sf_dir).groupBy("user_id", "session_id").agg(F.min("t").alias("first"), F.max(F.col("t") + 2).alias("last"))
    return own.filter("user_id % 4 < 2").select("session_id", F.when(F.col("user_id") % 4 == 0, F.greatest(F.col("last"), F.col("first") + 5)).otherwise(F.col("first")).alias("watermark"))


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.due(sessions(spark, sf_dir), messages(spark, sf_dir), cursors(spark, sf_dir))


def _new_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.of_sessions(messages(spark, sf_dir), _due(spark, sf_dir))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary file for each user but those divisible by 7."""
    u = F.col("user_id")
    info = F.struct(F.when(u % 5 == 0, "").otherwise(F.concat(F.lit("g"), u)).alias("id"), F.concat(F.lit("/work/p"), u % 6).alias("cwd"))
    created = (F.lit(EPOCH) / 1000 + u).cast("bigint")
    value = F.to_json(F.struct(info.alias("info"), F.when(u % 3 == 0, F.concat(F.lit(" Made "), u)).alias("generated_title"), F.when(u % 3 == 1, F.concat(F.lit("Sum "), u)).otherwise(" ").alias("session_summary"), F.when(u % 2 == 0, created * 1000 + 1).otherwise(created).alias("created_at"), F.when(u % 4 == 0, "soon").otherwise("2024-01-02T03:04:05.5+02:00").alias("updated_at")))
    return read(spark, sf_dir, "events").select("user_id").distinct().filter("user_id % 7 <> 0").select(F.concat(F.lit("/g/enc/h"), u, F.lit("/summary.json")).alias("path"), value.alias("value"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are users' texts, clicks answers in blocks, purchases tools, signups reasoning, errors broken lines."""
    e, k = F.col("event_id"), F.col("k")
    line = lambda kind, content, **more: F.to_json(F.struct(F.lit(kind).alias("type"), content.alias("content"), (F.lit(EPOCH) + e * 1000).alias("timestamp"), *(F.lit(v).alias(c) for c, v in more.items())))
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    value = (
        F.when(F.col("event_type") == "view", line("user", F.when(e % 2 == 0, F.concat(F.lit(" [Ask "), k)).otherwise(" ")))
        .when(F.col("event_type") == "click", line("assistant", F.array(block("text", F.concat(F.lit("A"), k)), block("image", F.lit("no")), block("text", F.lit("B")))))
        .when(F.col("event_type") == "purchase", line("tool", F.concat(F.lit("Ran "), k), tool_name="Bash"))
        .when(F.col("event_type") == "signup", line("reasoning", F.lit("hm")))
        .otherwise('{"type":"user",')
    )
    return _numbered(spark, sf_dir).select(F.concat(F.lit("/g/enc/h"), "user_id", F.lit("/chat_history.jsonl")).alias("path"), "after", "line", value.alias("value"))


def _iso(ms: str) -> str:
    return f"strftime(make_timestamp(CAST({ms} AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


EVENTS = f"""WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, {EPOCH} + event_id * 1007 AS t, 'o' || user_id AS session_id FROM events),
 own AS (SELECT user_id, min(t) AS first, greatest(min(t) + 5, max(t + event_id % 3)) AS watermark FROM ev GROUP BY user_id),
 due AS (SELECT * FROM own WHERE user_id % 4 <> 0), new AS (SELECT ev.* FROM ev JOIN due USING (user_id))"""
GIVEN = lambda c: f"coalesce({c}, '-') AS {c}"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("model", "name")})


#: Name: (query, SQL).
CATALOG = {
    "G6_watermarks": (
        lambda s, p: d.advanced(_due(s, p), messages(s, p)),
        f"{EVENTS} SELECT 'o' || user_id AS session_id, watermark FROM due WHERE user_id NOT IN (SELECT user_id FROM ev WHERE event_type IN ('click', 'purchase') AND event_id % 997 = 0)",
    ),
    "N22_database_usage": (
        lambda s, p: d.usage(_new_messages(s, p), "now"),
        f"""{EVENTS} SELECT 'opencode:' || session_id || ':m' || event_id AS uuid, CASE WHEN event_id % 13 = 0 THEN 'now' ELSE replace(strftime(make_timestamp(t * 1000), '%Y-%m-%dT%H:%M:%S.%g'), '.000', '') || '+00:00' END AS timestamp,
         CASE WHEN event_id % 19 = 0 THEN 'unknown' ELSE 'M' || (k % 3) END AS model, 'opencode' AS source, session_id, k * 10 AS input, k * 3 + event_id % 5 AS output, event_id % 50 AS cache_creation, CASE WHEN event_id % 2 = 0 THEN k * 7 ELSE 0 END AS cache_read
         FROM new WHERE event_type IN ('click', 'purchase') AND event_id % 997 <> 0 AND (k > 0 OR event_id % 50 > 0)""",
    ),
    "N23_database_messages": (
        lambda s, p: _shown(d.messages(_new_messages(s, p), parts(s, p))),
        f"""{EVENTS}, x AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'Bash' END AS name, CASE WHEN k % 10 <> 0 THEN 'Say ' || k END AS said, CASE WHEN event_type IN ('click', 'purchase') AND event_id % 19 <> 0 THEN 'M' || (k % 3) END AS model FROM new WHERE event_type <> 'error')
         SELECT 'm' || event_id AS uuid, session_id, {_iso("t")} AS ts, CASE event_type WHEN 'view' THEN 'user' ELSE 'assistant' END AS role, {GIVEN("model")}, {GIVEN("name")}, concat_ws(chr(10), name, said) AS content FROM x WHERE name IS NOT NULL OR said IS NOT NULL""",
    ),
    "N24_database_sessions": (
        lambda s, p: d.sessions(d.of_sessions(sessions(s, p), _due(s, p), "id")),
        f"""{EVENTS} SELECT 'o' || user_id AS id, 'opencode' AS source, '/work/p' || (user_id % 6) AS project_dir, CASE WHEN user_id % 3 = 0 THEN 'p' || (user_id % 6) ELSE 'Title ' || user_id END AS title_orig,
         {_iso("first")} AS started_at, {_iso("first + 5")} AS last_active_at, '' AS agent_type, '' AS parent_session_id FROM due""",
    ),
    "N20_update_sessions": (
        lambda s, p: chat_log.update_sessions(summaries(s, p), history(s, p)),
        f"""{LINES}, g AS (SELECT user_id, user_id % 7 = 0 AS bare, arg_min('[Ask ' || k, line) FILTER (event_type = 'view' AND event_id % 2 = 0) AS said FROM ev GROUP BY user_id)
         SELECT CASE WHEN bare OR user_id % 5 = 0 THEN 'h' ELSE 'g' END || user_id AS id, 'grok' AS source, CASE WHEN bare THEN '' ELSE '/work/p' || (user_id % 6) END AS project_dir,
         CASE WHEN bare THEN '' WHEN user_id % 3 = 0 THEN 'Made ' || user_id WHEN user_id % 3 = 1 THEN 'Sum ' || user_id ELSE coalesce(said, '') END AS title_orig, CASE WHEN bare THEN '' ELSE {_iso(f"{EPOCH} + user_id * 1000")} END AS started_at,
         CASE WHEN bare OR user_id % 4 = 0 THEN '' ELSE '2024-01-02T01:04:05.500Z' END AS last_active_at, '' AS agent_type, '' AS parent_session_id FROM g""",
    ),
    "N21_update_messages": (
        lambda s, p: _shown(chat_log.update_messages(history(s, p))),
        f"""{LINES} SELECT 'grok:msg:h' || user_id || ':line' || line AS uuid, 'h' || user_id AS session_id, {_iso(f"{EPOCH} + event_id * 1000")} AS ts, CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' ELSE 'tool' END AS role, '-' AS model,
         CASE event_type WHEN 'purchase' THEN 'Bash' ELSE '-' END AS name, CASE event_type WHEN 'view' THEN '[Ask ' || k WHEN 'click' THEN 'A' || k || chr(10) || 'B' ELSE 'Ran ' || k END AS content
         FROM ev WHERE line > after AND (event_type IN ('click', 'purchase') OR event_type = 'view' AND event_id % 2 = 0)""",
    ),
}
