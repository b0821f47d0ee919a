"""Queries over derived views, store writes and further logs, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import chat_log, derived as v, message_log as m, pricing, store, usage as u
from tallyforge.operators.usage import SessionFilter
from tallyforge.plans import log_catalog as logs
from tallyforge.sources import adapters as a

TOTAL = "input + output + cache_creation + cache_read"
#: A click's cost in units of 1e-10 USD, in whole numbers.
COST = "(input * 300 + output * 1500 + cache_creation * 375 + cache_read * 30) * 100"


def _sql(names: str, body: str) -> str:
    return a.with_sql(names) + "\n" + body


def _chats(s, d):
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    tokens = F.struct((k * 4).alias("input"), k.alias("output"), (k * F.when(e % 3 == 0, 9).otherwise(2)).alias("cached"), (e % 4).alias("thoughts"))
    message = F.struct(F.concat(F.lit("m"), e).alias("id"), F.when(F.col("event_type") == "view", "user").otherwise("gemini").alias("type"), F.col("event_type").alias("model"), F.concat(F.lit("text "), e).alias("content"), tokens.alias("tokens"))
    rows = a.read(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(e, message.alias("m")))).alias("all"))
    value = F.to_json(F.struct(F.concat(F.lit("c"), "user_id").alias("sessionId"), F.transform("all", lambda x: x["m"]).alias("messages")))
    return chat_log.chats(rows.select(F.concat(F.lit("/tmp/h"), "user_id", F.lit("/chats/session-1.json")).alias("path"), value.alias("value")))


def _stored(s, d):
    return a.usage(s, d).filter("cache_creation % 2 = 0")


def _unpaid(s, d):
    return a.usage(s, d).withColumn("cost", F.when(F.col("cache_creation") % 3 == 0, F.lit(0)).otherwise(F.col("cost")).cast("decimal(38,16)"))


#: Name: (query, SQL).
CATALOG = {
    "C2_window_change": (lambda s, d: v.window_change(u.by(a.usage(s, d), "day")), _sql("usage", f"SELECT round((max_by(t, day) - min_by(t, day)) / min_by(t, day), 6) AS change, round(sum(t) / count(*), 6) AS daily_avg FROM (SELECT day, CAST(sum({TOTAL}) AS DOUBLE) AS t FROM usage GROUP BY day)")),
    "C3_day_so_far": (
        lambda s, d: v.day_so_far(u.by(a.usage(s, d), u.hour_of("UTC")), "2024-01-20", 12),
        _sql("usage", f"SELECT round((t - y) / y, 6) AS change, round(t / 13, 6) AS hourly_avg FROM (SELECT CAST(sum({TOTAL}) FILTER (day = '2024-01-20') AS DOUBLE) AS t, CAST(sum({TOTAL}) FILTER (day = '2024-01-19') AS DOUBLE) AS y FROM usage WHERE hour(ts) <= 12)"),
    ),
    "C17_groups": (lambda s, d: v.by_group(a.sessions(s, d), s.sql("SELECT * FROM VALUES ('g1'), ('g2') AS t(id)")).groupBy("shown_in").agg(F.count("*").alias("n")), _sql("sessions", "SELECT CASE WHEN local_group IN ('g1', 'g2') THEN local_group ELSE '' END AS shown_in, count(*) AS n FROM sessions GROUP BY 1")),
    "C18_spans": (
        lambda s, d: a.sessions(s, d).select("id", v.span_parts(F.col("started_at").cast("timestamp"), F.col("last_active_at").cast("timestamp")).alias("p")).select("id", "p.*"),
        _sql("sessions", "SELECT id, x // 86400 AS days, x % 86400 // 3600 AS hours, x % 3600 // 60 AS minutes FROM (SELECT id, CAST(floor(epoch(last_active_at)) - floor(epoch(started_at)) AS BIGINT) AS x FROM sessions)"),
    ),
    "C19_models_used": (lambda s, d: v.models_used(a.usage(s, d)).select("session_id", "device_id", F.array_join("models", ">").alias("models")), _sql("usage", "SELECT session_id, device_id, string_agg(model, '>' ORDER BY ts, uuid) AS models FROM (SELECT session_id, device_id, model, ts, uuid FROM usage QUALIFY row_number() OVER (PARTITION BY session_id, device_id, model ORDER BY ts, uuid) = 1) GROUP BY ALL")),
    "J14_latest": (
        lambda s, d: u.latest(a.read(s, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("updated_at"), "event_id"), ["user_id"], "updated_at", "event_id"),
        "SELECT user_id, strftime(ts, '%Y-%m-%d') AS updated_at, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id) = 1",
    ),
    "J17_presence": (
        lambda s, d: store.presence_mismatches(a.sessions(s, d).filter("local_group = 'g1'"), a.sessions(s, d).filter("favorited")),
        _sql("sessions", "SELECT id, device_id, CASE WHEN favorited THEN 'write' ELSE 'remove' END AS todo FROM sessions WHERE (local_group = 'g1') <> favorited"),
    ),
    "N17_chats": (
        lambda s, d: chat_log.chat_usage(_chats(s, d), "now"),
        """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
         SELECT 'gemini:c' || user_id || ':m' || event_id AS uuid, 'now' AS timestamp, event_type AS model, 'gemini' AS source, 'c' || user_id AS session_id, k * 4 - least(k * 4, k * CASE WHEN event_id % 3 = 0 THEN 9 ELSE 2 END) AS input, k + event_id % 4 AS output, CAST(0 AS BIGINT) AS cache_creation, least(k * 4, k * CASE WHEN event_id % 3 = 0 THEN 9 ELSE 2 END) AS cache_read
         FROM e WHERE event_type <> 'view' AND (k > 0 OR event_id % 4 > 0)""",
    ),
    "U1_landed": (lambda s, d: store.landed(_stored(s, d), a.usage(s, d).union(a.usage(s, d)), store.USAGE_KEY).select("uuid", "device_id", "day"), _sql("usage", "SELECT uuid, device_id, day FROM usage WHERE cache_creation % 2 = 1")),
    "U2_dirty_days": (lambda s, d: store.dirty_days(store.landed(_stored(s, d), a.usage(s, d), store.USAGE_KEY)), _sql("usage", "SELECT DISTINCT device_id, day FROM usage WHERE cache_creation % 2 = 1")),
    "U10_deleted": (lambda s, d: store.soft_deleted(a.sessions(s, d), a.sessions(s, d).filter("local_group = 'g2'")).select("id", "excluded", "favorited"), _sql("sessions", "SELECT id, excluded OR local_group = 'g2' AS excluded, favorited AND local_group <> 'g2' AS favorited FROM sessions")),
    "U13_rebilled": (
        lambda s, d: store.with_rebills(_unpaid(s, d), pricing.seed(s))[0].groupBy("day").agg(pricing.units(F.sum("cost")).alias("cost_units")),
        _sql("usage", f"SELECT day, CAST(sum(CASE WHEN cache_creation % 3 <> 0 AND cost > 0 THEN CAST(cost * 10000 AS BIGINT) * 1000000 WHEN model = 'click' THEN {COST} ELSE 0 END) AS BIGINT) AS cost_units FROM usage GROUP BY day"),
    ),
    "U14_discovered": (
        lambda s, d: store.discovered(s.sql("SELECT 'd0' AS device_id, 'Mine' AS display_name, true AS is_self, '2024' AS first_seen"), a.usage(s, d).withColumn("timestamp", F.date_format("ts", logs.STAMP))),
        _sql("usage", "SELECT 'd0' AS device_id, 'Mine' AS display_name, true AS is_self, '2024' AS first_seen UNION ALL SELECT device_id, '', false, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) FROM usage WHERE device_id <> 'd0' GROUP BY device_id"),
    ),
    "E1_recorded": (
        lambda s, d: store.recorded(m.usage(m.parsed(logs.message_lines(s, d)), "now"), pricing.seed(s), "dev").groupBy("device_id", "day", "model_key").agg(F.count("*").alias("n"), pricing.units(F.sum("cost")).alias("cost_units")),
        f"""{logs.CALLS} SELECT 'dev' AS device_id, coalesce(substring(stamp, 1, 10), '0000-00-00') AS day, event_type AS model_key, count(*) AS n, CAST(sum(CASE WHEN event_type = 'click' THEN {COST} ELSE 0 END) AS BIGINT) AS cost_units
         FROM (SELECT * FROM c WHERE {TOTAL} > 0 QUALIFY row_number() OVER (PARTITION BY user_id, mid ORDER BY stop <> '' DESC, output DESC, line) = 1) GROUP BY ALL""",
    ),
}
