"""A query over the collection of a home: the events table as logs of four sources, collected twice while they grow, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import collection, landing, pricing
from tallyforge.plans import log_catalog as logs, stream_catalog as streams
from tallyforge.sources import ranges, scratch
from tallyforge.sources.adapters import read

#: Sessions whose files go before the second pass, by the user that they are made of.
GONE = {4: ".claude/projects/x/s4.jsonl", 3: ".grok/sessions/c/k3"}


def _user(path: str = "path"):
    return F.regexp_extract(path, r"(\d+)\.jsonl$", 1).cast("bigint")


def _events(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    rows = read(spark, sf_dir, "events").join(streams.step_of(spark, sf_dir), "event_id")
    return rows.filter(F.col("user_id") % 4 == rest).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def _named(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.withColumn("path", F.concat(F.lit(prefix), F.substring_index("path", "/", -1)))


def _chats(events: DataFrame, upto: int) -> DataFrame:
    """One object for each user, of all events up to a step; views are users' messages, others answers."""
    e, k = F.col("event_id"), F.col("k")
    tokens = F.struct((k * 4).alias("input"), k.alias("output"), (k * F.when(e % 3 == 0, 9).otherwise(2)).alias("cached"), (e % 4).alias("thoughts"))
    message = F.struct(F.concat(F.lit("m"), e).alias("id"), F.when(F.col("event_type") == "view", "user").otherwise("gemini").alias("type"), F.date_format("ts", logs.STAMP).alias("timestamp"), F.col("event_type").alias("model"), F.concat(F.lit("text "), e).alias("content"), tokens.alias("tokens"))
    own = events.filter(F.col("step") <= upto).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(e, message.alias("m")))).alias("all"))
    value = F.to_json(F.struct(F.concat(F.lit("c"), "user_id").alias("sessionId"), F.transform("all", lambda x: x["m"]).alias("messages")))
    return own.select(F.concat(F.lit(".gemini/tmp/h"), "user_id", F.lit("/chats/session-1.json")).alias("path"), F.lit(0).cast("bigint").alias("line"), F.lit(0).alias("step"), value.alias("value"))


def _updates(events: DataFrame) -> DataFrame:
    """Clicks and purchases are turns of one or two models, views users' texts; every second user has a summary."""
    e, k = F.col("event_id"), F.col("k")
    folder = F.concat(F.lit(".grok/sessions/c/k"), "user_id")
    n = F.struct((k * 10).alias("inputTokens"), k.alias("outputTokens"), (k * 3).alias("cachedReadTokens"))
    models = F.when(e % 2 == 0, F.create_map(F.lit("one"), n, F.lit("two"), n)).otherwise(F.create_map(F.lit("one"), n))
    update = F.struct(F.lit("turn_completed").alias("sessionUpdate"), F.when(e % 3 != 0, F.concat(F.lit("p"), e)).alias("prompt_id"), F.struct(models.alias("modelUsage")).alias("usage"))
    turn = F.to_json(F.struct(F.date_format("ts", logs.STAMP).alias("timestamp"), F.lit("_x.ai/session/update").alias("method"), F.struct(update.alias("update")).alias("params")))
    text = F.to_json(F.struct(F.lit("user").alias("type"), F.concat(F.lit("text "), e).alias("content")))
    row = lambda df, name, value: df.select(F.concat(folder, F.lit(f"/{name}")).alias("path"), e.alias("line"), "step", value.alias("value"))
    summary = F.to_json(F.struct(F.struct(F.concat(F.lit("k"), "user_id").alias("id"), F.concat(F.lit("/work/k"), "user_id").alias("cwd")).alias("info")))
    whole = events.filter("user_id % 8 = 3").groupBy("user_id").agg(F.min("step").alias("step")).select(F.concat(folder, F.lit("/summary.json")).alias("path"), F.lit(0).cast("bigint").alias("line"), "step", summary.alias("value"))
    return row(events.filter("event_type IN ('click', 'purchase')"), "updates.jsonl", turn).unionByName(row(events.filter("event_type = 'view'"), "chat_history.jsonl", text)).unionByName(whole)


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds after two passes: calls, turns, sessions and messages by session."""
    top = scratch.folder(spark)
    home, tables = f"{top}/home", landing.store(spark, f"{top}/store")
    logged = _named(streams.message_files(spark, sf_dir).filter(_user() % 4 == 0), ".claude/projects/x/")
    logged = logged.unionByName(_named(streams.thread_files(spark, sf_dir).filter(_user() % 4 == 1), ".codex/sessions/2024/01/")).unionByName(_updates(_events(spark, sf_dir, 3))).persist()
    chats = _events(spark, sf_dir, 2).persist()
    system, place = ranges.located(home)
    for upto in (1, 2):
        streams.grown(logged, home, upto)
        streams.grown(_chats(chats, upto), home, 0)
        if upto == 2:
            for path in GONE.values():
                info = system.get_file_info(f"{place}/{path}")
                if info.type.name == "Directory":
                    system.delete_dir(info.path)
                elif info.is_file:
                    system.delete_file(info.path)
        collection.collect(tables, home, pricing.seed(spark), "dev", "now")
    logged.unpersist()
    chats.unpersist()
    state = tables.state()
    calls = tables.read("usage", state).groupBy("source", F.col("session_id").alias("key"), F.col("model").alias("text")).agg(F.count("*").alias("n"), F.sum(F.col("input") + F.col("output") + F.col("cache_creation") + F.col("cache_read")).alias("m"))
    none = F.lit("")
    turns = tables.read("turns", state).groupBy(F.col("session_id").alias("key")).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("m")).select(none.alias("source"), "key", none.alias("text"), "n", "m")
    sessions = tables.read("sessions", state).select("source", F.col("id").alias("key"), F.concat_ws("|", "title_orig", "project_dir").alias("text"), F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("m"))
    messages = tables.read("messages", state).groupBy(F.col("session_id").alias("key"), F.col("role").alias("text")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("m")).select(none.alias("source"), "key", "text", "n", "m")
    kinds = {"calls": calls, "turns": turns, "session": sessions, "messages": messages}
    out = None
    for kind, rows in kinds.items():
        own = rows.withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


_SUM = "CAST(sum(input + output + cache_creation + cache_read) AS BIGINT)"
_SQL = f"""{streams._THREADS.replace("WITH ev AS", f"WITH {streams._CALLS[5:]}, st AS (SELECT event_id, {streams._STEP} AS step FROM events), te AS").replace("FROM ev GROUP BY user_id)", "FROM te GROUP BY user_id)").replace("SELECT ev.*", "SELECT te.*").replace("FROM ev JOIN own", "FROM te JOIN own").replace("FROM ev s WHERE", "FROM te s WHERE")},
 claude AS (SELECT c.* FROM c JOIN st USING (event_id) WHERE user_id % 4 = 0 AND NOT (user_id = 4 AND step = 2) AND input + output + cache_creation + cache_read > 0 QUALIFY row_number() OVER (PARTITION BY user_id, mid, step = 2 ORDER BY stop <> '' DESC, output DESC, line) = 1),
 codex AS (SELECT *, CASE WHEN known IS NOT NULL THEN known WHEN first IS NULL THEN 'unknown' WHEN named_step = 2 AND step <= 1 AND user_id % 5 = 0 AND over IS NOT NULL AND event_id < over THEN 'unknown' ELSE first END AS m
  FROM n WHERE user_id % 4 = 1 AND (user_id % 5 <> 0 OR over IS NULL OR event_id >= over OR (step <= 1 AND over_step = 2))),
 gemini AS (SELECT *, least(k * 4, k * CASE WHEN event_id % 3 = 0 THEN 9 ELSE 2 END) AS cached FROM ev WHERE user_id % 4 = 2),
 grok AS (SELECT *, unnest(CASE WHEN event_id % 2 = 0 THEN ['one', 'two'] ELSE ['one'] END) AS m FROM ev JOIN st USING (event_id) WHERE user_id % 4 = 3 AND NOT (user_id = 3 AND step = 2) AND event_type IN ('click', 'purchase')),
 told AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS signups, arg_max('Title ' || event_id, line) FILTER (event_type = 'signup' AND event_id % 9 = 0) AS given, arg_max('Sum ' || event_id, line) FILTER (event_type = 'signup' AND event_id % 4 = 0) AS summary, arg_min('Hello ' || k, line) FILTER (event_type = 'signup' AND event_id % 2 = 0) AS said FROM ev WHERE event_type <> 'error' AND user_id % 4 = 0 GROUP BY user_id),
 views AS (SELECT user_id, arg_min('text ' || event_id, event_id) FILTER (event_type = 'view') AS said, count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS seen FROM ev WHERE user_id % 4 >= 2 GROUP BY user_id)
SELECT 'calls' AS kind, 'claude' AS source, 's' || user_id AS key, event_type AS text, count(*) AS n, {_SUM} AS m FROM claude GROUP BY ALL
UNION ALL SELECT 'calls', 'codex', CASE WHEN user_id % 5 = 0 THEN '' ELSE 'th' || user_id END AS key, m AS text, count(*), CAST(sum(i + o) AS BIGINT) FROM codex GROUP BY 3, 4
UNION ALL SELECT 'calls', 'gemini', 'c' || user_id AS key, event_type AS text, count(*), CAST(sum(k * 4 + k + event_id % 4) AS BIGINT) FROM gemini WHERE event_type <> 'view' AND (k > 0 OR event_id % 4 > 0) GROUP BY 3, 4
UNION ALL SELECT 'calls', 'grok', 'k' || user_id AS key, m AS text, count(*), CAST(sum(k * 11) AS BIGINT) FROM grok WHERE k > 0 GROUP BY 3, 4
UNION ALL SELECT 'turns', '', 's' || user_id AS key, '', count(*), CAST(sum(floor(value * 1000)) AS BIGINT) FROM ev JOIN st USING (event_id) WHERE event_type = 'view' AND user_id % 4 = 0 AND NOT (user_id = 4 AND step = 2) GROUP BY 3
UNION ALL SELECT 'session', 'claude', 's' || user_id, coalesce(given, summary, said, CASE WHEN signups > 0 THEN 'p' || (user_id % 6) ELSE '' END) || '|' || CASE WHEN signups > 0 THEN '/work/p' || (user_id % 6) ELSE '' END, 1, 0 FROM told WHERE user_id <> 4
UNION ALL SELECT DISTINCT 'session', 'codex', 'th' || user_id, 'q' || (user_id % 3) || '|/work/q' || (user_id % 3), 1, 0 FROM ev WHERE user_id % 4 = 1 AND user_id % 5 <> 0
UNION ALL SELECT 'session', 'gemini', 'c' || user_id, coalesce(said, '') || '|', 1, 0 FROM views WHERE user_id % 4 = 2
UNION ALL SELECT 'session', 'grok', 'k' || user_id, CASE WHEN user_id % 8 = 3 THEN coalesce(said, '') || '|/work/k' || user_id ELSE '|' END, 1, 0 FROM views WHERE user_id % 4 = 3 AND user_id <> 3 AND (user_id % 8 = 3 OR said IS NOT NULL)
UNION ALL SELECT 'messages', '', key, role, count(*), CAST(sum(length(content)) AS BIGINT) FROM (
 SELECT 's' || user_id AS key, 'user' AS role, CASE WHEN event_id % 2 = 0 THEN 'Hello ' || k ELSE '<command-name>' || k END AS content FROM ev WHERE event_type = 'signup' AND user_id % 4 = 0 AND user_id <> 4
 UNION ALL SELECT 's' || user_id, 'assistant', 'A' || event_id || chr(10) || 'B' FROM ev WHERE event_type IN ('click', 'purchase') AND user_id % 4 = 0 AND user_id <> 4
 UNION ALL SELECT 's' || user_id, 'tool', '{{"k":' || k || '}}' FROM ev WHERE event_type IN ('click', 'purchase') AND user_id % 4 = 0 AND user_id <> 4
 UNION ALL SELECT 'c' || user_id, CASE WHEN event_type = 'view' THEN 'user' ELSE 'assistant' END, 'text ' || event_id FROM ev WHERE user_id % 4 = 2
 UNION ALL SELECT 'k' || user_id, 'user', 'text ' || event_id FROM ev WHERE user_id % 4 = 3 AND user_id <> 3 AND event_type = 'view') GROUP BY key, role"""

#: Name: (query, SQL).
CATALOG = {"S1_collected": (collected, _SQL)}
