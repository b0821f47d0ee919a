"""The catalogue of queries over the usage model, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import expr
from tallyforge.functions.expr import UNKNOWN_PROJECT
from tallyforge.operators import pricing, usage as u
from tallyforge.operators.usage import SessionFilter, UsageFilter
from tallyforge.plans import collect_catalog, database_catalog, exchange_catalog, log_catalog, stats_catalog, store_catalog, stream_catalog, view_catalog
from tallyforge.sources import adapters as a

WINDOW = UsageFilter(since="2024-01-05T00:00:00", until="2024-01-20T12:00:00")
ALPHA = UsageFilter(project="/work/alpha")
#: Shorthand of the SQL: token sums, derived columns, a project's folder, the total of a row.
SUMS = """count(*) AS requests, CAST(coalesce(sum(input), 0) AS BIGINT) AS input, CAST(coalesce(sum(output), 0) AS BIGINT) AS output,
 CAST(coalesce(sum(cache_creation), 0) AS BIGINT) AS cache_creation, CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS cache_read,
 round(CAST(coalesce(sum(cost), 0) AS DOUBLE), 6) AS cost, CAST(coalesce(sum(input + output + cache_creation + cache_read), 0) AS BIGINT) AS total,
 CASE WHEN coalesce(sum(input + cache_creation + cache_read), 0) = 0 THEN 0.0 ELSE round(CAST(sum(cache_read) AS DOUBLE) / CAST(sum(input + cache_creation + cache_read) AS DOUBLE), 6) END AS hit_rate"""
TOTAL = "input + output + cache_creation + cache_read"
PID = r"regexp_replace(project_dir, '(?s)\A(.*?)[/\\]\.claude[/\\]worktrees(?:[/\\].*)?\z', '\1')"
IN_WINDOW = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"
SEARCH = "customer#00000001"


def _filtered(f: UsageFilter):
    return lambda s, d: u.where_usage(a.usage(s, d), a.sessions(s, d), f)


def _sessions(f: SessionFilter):
    return lambda s, d: u.where_sessions(a.sessions(s, d), a.usage(s, d), a.messages(s, d), f)


PLAIN, IN_ALPHA, LOOSE = _filtered(WINDOW), _filtered(ALPHA), _filtered(UsageFilter(project=UNKNOWN_PROJECT))
NO_FILTER = SessionFilter()


def _conversation(s, d):
    return u.conversation(a.messages(s, d)).select("session_id", "uuid", "turn", F.coalesce("belongs_to", F.lit("")).alias("belongs_to"))


def _headline(s, d):
    days = u.by(PLAIN(s, d), "day").select("day", "requests")
    return days.agg(F.sum("requests").alias("requests"), F.round(F.sum("requests") / u.window_days(WINDOW), 6).alias("per_day"), F.max_by("day", F.struct("requests", -F.datediff(F.col("day").cast("date"), F.lit("2024-01-01").cast("date")))).alias("peak"))


def _device_share(s, d):
    per = u.by(a.usage(s, d), "device_id").select("device_id", "total")
    return per.agg(F.count("*").alias("devices"), F.max_by("device_id", F.struct("total", "device_id")).alias("leader"), F.round(F.max("total") / F.sum("total"), 6).alias("share"))


#: Stop reasons of the test view, by event_id modulo 10.
REASONS = ["End_Turn", "tool_use", "MAX_TOKENS", "context_window_exceeded", "limit_exceeded", "refusal", "api_error", "my_tool_use_error", "stop", ""]


def _tones(s, d):
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("event_id") % 10 + 1).cast("int"))
    return a.read(s, d, "events").groupBy(F.coalesce(expr.stop_tone(reason), F.lit("none")).alias("tone")).agg(F.count("*").alias("n"))


def _keys(s, d):
    raw = F.concat(F.lit("Vendor/"), F.col("p_brand"), F.lit("-"), F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, "-20240131").when(F.col("p_partkey") % 3 == 0, "-2024-01-31").otherwise(" [beta]"))
    return a.read(s, d, "part").select("p_partkey", expr.model_key(raw).alias("model_key"))


def _snippets(s, d):
    return u.search_snippets(a.messages(s, d), "the")


def _page(rows, order, size=50, start=20):
    return rows.orderBy(*order).offset(start).limit(u.page_limit(size))


def _listed(f):
    return lambda s, d: u.session_list(_sessions(f)(s, d), a.usage(s, d))


LISTED = f"""SELECT c.id, c.device_id, c.title, {PID} AS project, c.last_active_at, CAST(coalesce(g.requests, 0) AS BIGINT) AS requests,
 CAST(coalesce(g.tokens, 0) AS BIGINT) AS tokens, round(CAST(coalesce(g.cost, 0) AS DOUBLE), 6) AS cost
 FROM c LEFT JOIN (SELECT session_id, device_id, count(*) AS requests, sum({TOTAL}) AS tokens, sum(cost) AS cost FROM usage GROUP BY ALL) g
 ON g.session_id = c.id AND g.device_id = c.device_id"""


def _chosen(condition: str) -> str:
    return f", c AS (SELECT * FROM sessions WHERE NOT excluded AND {condition})"


def _sql(names: str, body: str, extra: str = "") -> str:
    return a.with_sql(names) + extra + "\n" + body


HIT = f"(contains(lower(title), '{SEARCH}') OR contains(lower(project_dir), '{SEARCH}') OR id IN (SELECT session_id FROM messages WHERE contains(lower(content), '{SEARCH}')))"
SEMI = f"WHERE EXISTS (SELECT 1 FROM sessions s WHERE s.id = usage.session_id AND s.device_id = usage.device_id AND {PID} = '/work/alpha')"
ANTI = "WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.id = usage.session_id AND s.device_id = usage.device_id)"

#: Name: (query, SQL).
CATALOG = {
    "A1_stats": (lambda s, d: u.stats(PLAIN(s, d)), _sql("usage", f"SELECT {SUMS} FROM usage WHERE {IN_WINDOW}")),
    "A1_all": (lambda s, d: u.stats(a.usage(s, d)), _sql("usage", f"SELECT {SUMS} FROM usage")),
    "A4_all": (lambda s, d: u.by(a.usage(s, d), "model"), _sql("usage", f"SELECT model, {SUMS} FROM usage GROUP BY model")),
    "A10_all": (lambda s, d: a.usage(s, d).agg(F.count("*").alias("n")), _sql("usage", "SELECT count(*) AS n FROM usage")),
    "P5_worktrees": (lambda s, d: _listed(SessionFilter(search="  WORKTREES "))(s, d), _sql("usage sessions messages", LISTED, _chosen("(contains(lower(title), 'worktrees') OR contains(lower(project_dir), 'worktrees') OR id IN (SELECT session_id FROM messages WHERE contains(lower(content), 'worktrees')))"))),
    "P2_project": (lambda s, d: u.stats(IN_ALPHA(s, d)), _sql("usage sessions", f"SELECT {SUMS} FROM usage {SEMI}")),
    "J7_unknown_project": (lambda s, d: u.stats(LOOSE(s, d)), _sql("usage sessions", f"SELECT {SUMS} FROM usage {ANTI}")),
    "A2_turns": (
        lambda s, d: u.turn_stats(a.turns(s, d)),
        _sql("turns", """SELECT count(*) AS turns, coalesce(round(avg(duration_ms), 6), 0.0) AS avg_ms, count(*) FILTER (duration_ms < 10000) AS under_10s,
         count(*) FILTER (duration_ms >= 10000 AND duration_ms < 30000) AS under_30s, count(*) FILTER (duration_ms >= 30000 AND duration_ms < 60000) AS under_60s,
         count(*) FILTER (duration_ms >= 60000) AS from_60s, CAST(quantile_disc(duration_ms, 0.95) AS BIGINT) AS p95_ms FROM turns"""),
    ),
    "A4_models": (lambda s, d: u.by(PLAIN(s, d), "model"), _sql("usage", f"SELECT model, {SUMS} FROM usage WHERE {IN_WINDOW} GROUP BY model")),
    "A5_trend_day": (lambda s, d: u.by(a.usage(s, d), "day"), _sql("usage", f"SELECT day, {SUMS} FROM usage GROUP BY day")),
    "A6_trend_hour": (
        lambda s, d: u.by(a.usage(s, d), u.hour_of("Asia/Kolkata")),
        _sql("usage", f"SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H') AS bucket, {SUMS} FROM usage GROUP BY 1"),
    ),
    "A7_project_usage": (
        lambda s, d: u.project_usage(a.usage(s, d), a.sessions(s, d)),
        _sql("usage sessions", f"""SELECT CASE WHEN coalesce(pid, '') = '' THEN '{UNKNOWN_PROJECT}' ELSE pid END AS project, {SUMS},
         count(DISTINCT CASE WHEN sid IS NOT NULL THEN sid || '|' || dev END) AS sessions, max(ts) AS last_ts
         FROM usage LEFT JOIN (SELECT id AS sid, device_id AS dev, {PID} AS pid FROM sessions) ON session_id = sid AND device_id = dev GROUP BY 1"""),
    ),
    "A8_session_usage": (
        lambda s, d: u.session_usage(a.usage(s, d), a.sessions(s, d), a.turns(s, d)),
        _sql("usage sessions turns", f"""SELECT g.*, coalesce(nullif(title, ''), g.session_id) AS title, CAST(coalesce(t.turns, 0) AS BIGINT) AS turns
         FROM (SELECT session_id, device_id, {SUMS}, max(ts) AS last_ts FROM usage GROUP BY session_id, device_id) g
         JOIN sessions s ON s.id = g.session_id AND s.device_id = g.device_id
         LEFT JOIN (SELECT session_id, device_id, count(*) AS turns FROM turns GROUP BY ALL) t ON t.session_id = g.session_id AND t.device_id = g.device_id"""),
    ),
    "A9_devices": (lambda s, d: u.by(a.usage(s, d), "device_id"), _sql("usage", f"SELECT device_id, {SUMS} FROM usage GROUP BY device_id")),
    "A10_count": (lambda s, d: PLAIN(s, d).agg(F.count("*").alias("n")), _sql("usage", f"SELECT count(*) AS n FROM usage WHERE {IN_WINDOW}")),
    "A15_sources": (lambda s, d: u.facet(PLAIN(s, d), "source"), _sql("usage", f"SELECT DISTINCT source AS value FROM usage WHERE source <> '' AND {IN_WINDOW}")),
    "A16_projects": (
        lambda s, d: u.projects(a.sessions(s, d), a.usage(s, d), a.messages(s, d), UsageFilter()),
        _sql("usage sessions", f"SELECT DISTINCT {PID} AS value FROM sessions WHERE NOT excluded AND {PID} <> '' UNION ALL SELECT '{UNKNOWN_PROJECT}' WHERE EXISTS (SELECT 1 FROM usage {ANTI})"),
    ),
    "A17_first_seen": (
        lambda s, d: u.first_seen(a.usage(s, d), a.sessions(s, d).filter("NOT excluded AND favorited").select("device_id").distinct().filter("device_id <> 'd1'")),
        _sql("usage sessions", "SELECT device_id, min(ts) AS first_ts FROM usage WHERE device_id NOT IN (SELECT device_id FROM sessions WHERE NOT excluded AND favorited AND device_id <> 'd1') GROUP BY 1"),
    ),
    "A19_changes": (lambda s, d: a.usage(s, d).groupBy("day", "device_id").agg(F.count("*").alias("n")), _sql("usage", "SELECT day, device_id, count(*) AS n FROM usage GROUP BY ALL")),
    "W2_log_page": (lambda s, d: _page(PLAIN(s, d).select("uuid", "device_id", "ts", "model"), [F.desc("ts"), "uuid", "device_id"]), _sql("usage", f"SELECT uuid, device_id, ts, model FROM usage WHERE {IN_WINDOW} ORDER BY ts DESC, uuid, device_id LIMIT 50 OFFSET 20")),
    "W3_session_page": (lambda s, d: _page(_listed(NO_FILTER)(s, d), [F.desc("last_active_at"), "id", "device_id"], 30, 10), _sql("usage sessions", LISTED + " ORDER BY last_active_at DESC, id, device_id LIMIT 30 OFFSET 10", _chosen("true"))),
    "W4_session": (lambda s, d: _listed(NO_FILTER)(s, d).filter("id = 's5' AND device_id = 'd2'"), _sql("usage sessions", f"SELECT * FROM ({LISTED}) WHERE id = 's5' AND device_id = 'd2'", _chosen("true"))),
    "P3_favorited": (lambda s, d: _listed(SessionFilter(favorited=True, group=""))(s, d), _sql("usage sessions", LISTED, _chosen("favorited AND local_group = ''"))),
    "P4_model_used": (lambda s, d: _listed(SessionFilter(model="click"))(s, d), _sql("usage sessions", LISTED, _chosen("EXISTS (SELECT 1 FROM usage x WHERE x.model = 'click' AND x.session_id = sessions.id AND x.device_id = sessions.device_id)"))),
    "P5_search": (lambda s, d: _listed(SessionFilter(search=SEARCH))(s, d), _sql("usage sessions messages", LISTED, _chosen(HIT))),
    "C1_filled_hours": (
        lambda s, d: u.filled_hours(u.by(PLAIN(s, d), u.hour_of("UTC")).select("bucket", "requests", "total"), "2024-01-20"),
        _sql("usage", f"""SELECT '2024-01-20T' || lpad(CAST(h AS VARCHAR), 2, '0') AS bucket, CAST(coalesce(requests, 0) AS BIGINT) AS requests, CAST(coalesce(total, 0) AS BIGINT) AS total
         FROM range(24) r(h) LEFT JOIN (SELECT hour(ts) AS k, count(*) AS requests, sum({TOTAL}) AS total FROM usage WHERE {IN_WINDOW} AND day = '2024-01-20' GROUP BY 1) ON k = h"""),
    ),
    "C5_top_models": (
        lambda s, d: u.top_models(u.by(a.usage(s, d), "model"), 3),
        _sql("usage", f"""SELECT CASE WHEN rank <= 3 THEN model ELSE '(rest)' END AS model, count(*) AS models, CAST(sum(total) AS BIGINT) AS total, round(sum(cost), 6) AS cost
         FROM (SELECT *, row_number() OVER (ORDER BY total DESC, model) AS rank FROM (SELECT model, {SUMS} FROM usage GROUP BY model)) GROUP BY 1"""),
    ),
    "C8_device_share": (_device_share, _sql("usage", f"SELECT count(*) AS devices, arg_max(device_id, total) AS leader, round(max(total) / sum(total), 6) AS share FROM (SELECT device_id, CAST(sum({TOTAL}) AS DOUBLE) AS total FROM usage GROUP BY 1)")),
    "C9_headline": (
        _headline,
        _sql("usage", f"""SELECT CAST(sum(n) AS BIGINT) AS requests, round(sum(n) / 16.0, 6) AS per_day, (SELECT day FROM (SELECT day, count(*) AS n FROM usage WHERE {IN_WINDOW} GROUP BY 1) ORDER BY n DESC, day LIMIT 1) AS peak
         FROM (SELECT day, count(*) AS n FROM usage WHERE {IN_WINDOW} GROUP BY 1)"""),
    ),
    "C12_tones": (
        _tones,
        """WITH r AS (SELECT lower(list_extract(['End_Turn', 'tool_use', 'MAX_TOKENS', 'context_window_exceeded', 'limit_exceeded', 'refusal', 'api_error', 'my_tool_use_error', 'stop', ''], CAST(event_id % 10 + 1 AS INTEGER))) AS r FROM events)
         SELECT CASE WHEN r = 'end_turn' THEN 'success' WHEN r = 'tool_use' THEN 'tool' WHEN r IN ('max_tokens', 'context_window', 'exceeded') THEN 'warn' WHEN r IN ('refusal', 'error') THEN 'error'
          WHEN r LIKE '%end\\_turn%' ESCAPE '\\' THEN 'success' WHEN r LIKE '%tool\\_use%' ESCAPE '\\' THEN 'tool' WHEN r LIKE '%max\\_tokens%' ESCAPE '\\' THEN 'warn' WHEN r LIKE '%context\\_window%' ESCAPE '\\' THEN 'warn' WHEN r LIKE '%exceeded%' THEN 'warn'
          WHEN r LIKE '%refusal%' THEN 'error' WHEN r LIKE '%error%' THEN 'error' ELSE 'none' END AS tone, count(*) AS n FROM r GROUP BY 1""",
    ),
    "C21_conversation": (
        _conversation,
        _sql("messages", """SELECT session_id, uuid, turn, CASE WHEN role = 'tool' THEN coalesce(
           last_value(CASE WHEN role = 'assistant' THEN uuid END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(CASE WHEN role = 'assistant' THEN uuid END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '') ELSE '' END AS belongs_to
         FROM (SELECT *, CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY session_id, device_id ORDER BY ts, uuid), 0) AS BIGINT) AS turn FROM messages)
         WINDOW w AS (PARTITION BY session_id, device_id, turn ORDER BY ts, uuid)"""),
    ),
    "C23_snippets": (
        _snippets,
        _sql("messages", """SELECT session_id, uuid, CAST(place AS INTEGER) AS place, CASE WHEN greatest(place - 28, 1) > 1 THEN '…' ELSE '' END
         || substring(content, greatest(place - 28, 1), least(place + 30, length(content)) - greatest(place - 28, 1) + 1) || CASE WHEN least(place + 30, length(content)) < length(content) THEN '…' ELSE '' END AS snippet
         FROM (SELECT *, strpos(lower(content), 'the') AS place FROM messages) WHERE place > 0"""),
    ),
    "J13_transcript": (lambda s, d: u.transcript(a.messages(s, d), "d1").select("session_id", "uuid", "device_id"), _sql("messages", "SELECT session_id, uuid, device_id FROM messages QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY device_id <> 'd1', device_id) = 1")),
    "J16_nested": (
        lambda s, d: u.nested(_sessions(NO_FILTER)(s, d)),
        _sql("sessions", "SELECT c.id, c.device_id, coalesce(p.id, '') AS parent FROM c LEFT JOIN c p ON p.id = c.parent_session_id AND p.device_id = c.device_id", _chosen("true")),
    ),
    "E3_model_keys": (
        _keys,
        """SELECT p_partkey, lower(p_brand) || '-' || p_size AS model_key FROM part""",
    ),
    "E4_priced": (
        lambda s, d: pricing.priced(a.usage(s, d).withColumn("model", F.concat("model", F.lit("-pro-20240101"))), pricing.seed(s)).groupBy("model_key").agg(F.count("*").alias("n"), pricing.units(F.sum("cost")).alias("cost_units")),
        _sql("usage", """SELECT model || '-pro' AS model_key, count(*) AS n, CAST(coalesce(sum(CASE model WHEN 'click' THEN input * 300 + output * 1500 + cache_creation * 375 + cache_read * 30 WHEN 'view' THEN input * 100 + output * 400 + cache_creation * 125 + cache_read * 10 ELSE 0 END), 0) AS BIGINT) * 100 AS cost_units FROM usage GROUP BY 1"""),
    ),
}


def _all() -> dict:
    return CATALOG | log_catalog.CATALOG | database_catalog.CATALOG | view_catalog.CATALOG | stats_catalog.CATALOG | exchange_catalog.CATALOG | collect_catalog.CATALOG | store_catalog.CATALOG | stream_catalog.CATALOG


def queries() -> dict:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
