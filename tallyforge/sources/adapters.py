"""The usage model as views over the star-schema test tables, in DataFrame form and as SQL for an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each API call."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("event_id")).alias("uuid"),
        "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("event_type").alias("model"),
        F.element_at(F.array(*map(F.lit, ("claude", "codex", "gemini", "grok", "opencode"))), (F.col("event_id") % 5 + 1).cast("int")).alias("source"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("s"), F.col("user_id"))).alias("session_id"),
        F.concat(F.lit("d"), F.col("user_id") % 3).alias("device_id"),
        (k * 10).alias("input"),
        (k * 3).alias("output"),
        (F.col("event_id") % 50).alias("cache_creation"),
        (k * 7).alias("cache_read"),
        (F.floor(F.col("value") * 10000).cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(5,4)")).alias("cost"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each turn."""
    return read(spark, sf_dir, "events").filter("event_type = 'view'").select(
        F.concat(F.lit("e"), F.col("event_id")).alias("uuid"),
        "ts",
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("s"), F.col("user_id"))).alias("session_id"),
        F.concat(F.lit("d"), F.col("user_id") % 3).alias("device_id"),
        F.floor(F.col("value") * 1000).alias("duration_ms"),
    )


#: Project folders by user_id modulo 6; two are worktrees, one is empty.
PROJECT_DIRS = ["/work/alpha", "/work/alpha/.claude/worktrees/x1", "/work/beta", "", "C:\\proj\\gamma", "C:\\proj\\gamma\\.claude\\worktrees\\w\\sub"]


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each session; users divisible by 7 have usage without a session."""
    u = F.col("user_id")
    spans = read(spark, sf_dir, "events").filter(u % 7 != 0).groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_active_at"))
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return spans.join(names, "user_id", "left").select(
        F.concat(F.lit("s"), u).alias("id"),
        F.concat(F.lit("d"), u % 3).alias("device_id"),
        F.element_at(F.array(*map(F.lit, PROJECT_DIRS)), (u % 6 + 1).cast("int")).alias("project_dir"),
        F.when(u % 10 == 0, "").otherwise(F.coalesce("name", F.lit(""))).alias("title"),
        F.element_at(F.array(*map(F.lit, ("claude", "codex", "gemini"))), (u % 3 + 1).cast("int")).alias("source"),
        (u % 5 == 0).alias("favorited"),
        (u % 13 == 0).alias("excluded"),
        F.when(u % 4 == 0, "").otherwise(F.concat(F.lit("g"), u % 4)).alias("local_group"),
        F.when(u % 9 == 0, F.concat(F.lit("s"), u - 3)).otherwise("").alias("parent_session_id"),
        "started_at",
        "last_active_at",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each transcript message; every third comes from two devices, and even assistant turns use a tool before."""
    base = read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("s"), F.col("conv_id")).alias("session_id"),
        F.concat(F.lit("d"), F.col("conv_id") % 3).alias("device_id"),
        F.concat_ws("-", "conv_id", "turn").alias("uuid"),
        "role",
        (F.col("turn") * 2 + 1).alias("ts"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    tools = base.filter("role = 'assistant' AND ts % 4 = 3").withColumns({"uuid": F.concat("uuid", F.lit("#tool0")), "role": F.lit("tool"), "ts": F.col("ts") - F.when(F.col("session_id").endswith("1"), 1).otherwise(-1), "content": F.lit('{"path":"x"}')})
    own = base.union(tools)
    return own.union(own.filter("ts % 3 = 0").withColumn("device_id", F.lit("d9")))


_SESSION = "CASE WHEN event_id % 11 = 0 THEN '' ELSE 's' || user_id END"
_DIRS = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(PROJECT_DIRS))

#: The same views as common table expressions for DuckDB.
SQL = {
    "usage": f"""SELECT 'e' || event_id AS uuid, ts, strftime(ts, '%Y-%m-%d') AS day, event_type AS model,
        CASE event_id % 5 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'gemini' WHEN 3 THEN 'grok' ELSE 'opencode' END AS source,
        {_SESSION} AS session_id, 'd' || (user_id % 3) AS device_id,
        CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS input, CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 AS output,
        event_id % 50 AS cache_creation, CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 AS cache_read,
        CAST(CAST(floor(value * 10000) AS BIGINT) AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS cost FROM events""",
    "turns": f"""SELECT 'e' || event_id AS uuid, ts, {_SESSION} AS session_id, 'd' || (user_id % 3) AS device_id,
        CAST(floor(value * 1000) AS BIGINT) AS duration_ms FROM events WHERE event_type = 'view'""",
    "sessions": f"""SELECT 's' || u.user_id AS id, 'd' || (u.user_id % 3) AS device_id, CASE u.user_id % 6 {_DIRS} END AS project_dir,
        CASE WHEN u.user_id % 10 = 0 THEN '' ELSE coalesce(c_name, '') END AS title,
        CASE u.user_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'gemini' END AS source,
        u.user_id % 5 = 0 AS favorited, u.user_id % 13 = 0 AS excluded,
        CASE WHEN u.user_id % 4 = 0 THEN '' ELSE 'g' || (u.user_id % 4) END AS local_group,
        CASE WHEN u.user_id % 9 = 0 THEN 's' || (u.user_id - 3) ELSE '' END AS parent_session_id, started_at, last_active_at
        FROM (SELECT user_id, min(ts) AS started_at, max(ts) AS last_active_at FROM events WHERE user_id % 7 <> 0 GROUP BY user_id) u
        LEFT JOIN customer ON c_custkey = u.user_id""",
    "messages": """SELECT * FROM (SELECT * FROM base UNION ALL SELECT session_id, device_id, uuid || '#tool0', 'tool', ts - CASE WHEN session_id LIKE '%1' THEN 1 ELSE -1 END, '{"path":"x"}' FROM base WHERE role = 'assistant' AND ts % 4 = 3)
        UNION ALL SELECT session_id, 'd9', uuid, role, ts, content FROM (SELECT * FROM base UNION ALL SELECT session_id, device_id, uuid || '#tool0', 'tool', ts - CASE WHEN session_id LIKE '%1' THEN 1 ELSE -1 END, '{"path":"x"}' FROM base WHERE role = 'assistant' AND ts % 4 = 3) WHERE ts % 3 = 0""",
    "base": """SELECT 's' || conv_id AS session_id, 'd' || (conv_id % 3) AS device_id, conv_id || '-' || turn AS uuid, role,
        turn * 2 + 1 AS ts, coalesce(text, '') AS content FROM conversations""",
}


def with_sql(names: str) -> str:
    """The views of the given names as common table expressions."""
    wanted = [n for name in names.split() for n in (("base", name) if name == "messages" else (name,))]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted)
