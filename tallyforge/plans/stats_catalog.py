"""Queries over sessions with their models, sets of sessions, projects and days, with SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.functions.expr import TOKENS
from tallyforge.operators import derived, session_stats as st, usage as u
from tallyforge.operators.usage import SessionFilter
from tallyforge.sources import adapters as a

TOTAL = "input + output + cache_creation + cache_read"
PID = r"regexp_replace(project_dir, '(?s)\A(.*?)[/\\]\.claude[/\\]worktrees(?:[/\\].*)?\z', '\1')"
HIT = "CASE WHEN input + cache_creation + cache_read = 0 THEN 0.0 ELSE round(CAST(cache_read AS DOUBLE) / CAST(input + cache_creation + cache_read AS DOUBLE), 6) END"
_ANTI = "NOT EXISTS (SELECT 1 FROM sessions s WHERE s.id = usage.session_id AND s.device_id = usage.device_id)"


def _units(cost: str = "cost"):
    """A cost in ten-thousandths, which is exact for the test view's costs."""
    return (F.col(cost) * 10000).cast("bigint").alias("cost_units")


def _stats(s, d, f: SessionFilter = SessionFilter()) -> DataFrame:
    usage, messages = a.usage(s, d), a.messages(s, d)
    return st.session_stats(u.where_sessions(a.sessions(s, d), usage, messages, f), usage, messages)


def _models(*fields: str):
    each = lambda m: F.concat_ws(":", *(m[f].cast("string") for f in fields))
    return F.array_join(F.transform("models", each), ">").alias("models")


def _section_rows(s, d) -> DataFrame:
    """Usage by session with what the session's row adds; a session with a parent is a sub-agent's."""
    own = a.sessions(s, d).select(F.col("id").alias("session_id"), "device_id", F.when(F.col("parent_session_id") != "", "Explore").otherwise("").alias("agent_type"), "started_at", "last_active_at")
    return u.session_usage(a.usage(s, d), a.sessions(s, d), a.turns(s, d)).join(own, ["session_id", "device_id"])


def _project_stats(f: SessionFilter):
    def run(s, d):
        rows = st.project_stats(a.sessions(s, d), a.usage(s, d), a.messages(s, d), f)
        return rows.select("project", "sessions", "requests", *TOKENS, "total", "hit_rate", _units(), F.date_format("last_active_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_active_at"))

    return run


def _project_sql(chosen: str, loose: str) -> str:
    own = f"SELECT project, count(*) AS sessions, sum(requests) AS requests, {', '.join(f'sum({c}) AS {c}' for c in TOKENS)}, sum(cost) AS cost, max(last_active_at) AS last_active_at FROM s GROUP BY project"
    rest = f"SELECT '__unknown__', 0, count(*), {', '.join(f'coalesce(sum({c}), 0)' for c in TOKENS)}, coalesce(sum(cost), 0), max(ts) FROM usage WHERE {_ANTI} AND {loose} HAVING count(*) > 0"
    return _with_stats(chosen, f"SELECT project, CAST(sessions AS BIGINT) AS sessions, CAST(requests AS BIGINT) AS requests, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in TOKENS)}, CAST({TOTAL} AS BIGINT) AS total, {HIT} AS hit_rate, CAST(cost * 10000 AS BIGINT) AS cost_units, strftime(last_active_at, '%Y-%m-%d %H:%M:%S.%f') AS last_active_at FROM ({own} UNION ALL {rest})")


def _with_stats(chosen: str, body: str) -> str:
    """Sessions of a condition with their usage (s) and usage by session and model (pm)."""
    return f"""{a.with_sql("usage sessions messages")},
 pm AS (SELECT session_id, device_id, model, count(*) AS requests, {", ".join(f"sum({c}) AS {c}" for c in TOKENS)}, sum(cost) AS cost FROM usage GROUP BY ALL),
 g AS (SELECT session_id, device_id, sum(requests) AS requests, {", ".join(f"sum({c}) AS {c}" for c in TOKENS)}, sum(cost) AS cost, string_agg(model || ':' || CAST({TOTAL} AS BIGINT), '>' ORDER BY {TOTAL} DESC, model) AS models FROM pm GROUP BY ALL),
 s AS (SELECT id, sessions.device_id, {PID} AS project, started_at, last_active_at, CAST(coalesce(requests, 0) AS BIGINT) AS requests, coalesce(n, 0) AS messages, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in TOKENS)}, coalesce(cost, 0) AS cost, coalesce(models, '') AS models
  FROM sessions LEFT JOIN g ON g.session_id = id AND g.device_id = sessions.device_id LEFT JOIN (SELECT session_id, device_id, count(*) AS n FROM messages GROUP BY ALL) m ON m.session_id = id AND m.device_id = sessions.device_id
  WHERE NOT excluded AND {chosen})
{body}"""


def _set(s, d):
    return st.session_set(_stats(s, d)).select("sessions", "requests", "messages", *TOKENS, "hit_rate", _units(), "total_span_ms", *(F.col("span_bins")[k].alias(f"bin{k}") for k in range(4)), _models("model", "tokens", "sessions"), "last_active_at")


def _groups(s, d):
    rows = a.usage(s, d).select("uuid", "device_id", "ts")
    return st.day_groups(rows, st.local_day("Asia/Kolkata"), -F.unix_micros(F.col("ts").cast("timestamp")), F.col("uuid"), F.col("device_id"))


#: Local days around both changes of New York's clock in 2024, and by how many days the events are moved to fall on them.
DAYS = [(66, d) for d in ("2024-03-09", "2024-03-10", "2024-03-11")] + [(300, d) for d in ("2024-11-02", "2024-11-03", "2024-11-04")]
#: Their bounds in UTC, for the SQL.
_BOUNDS = ["2024-03-09 05:00", "2024-03-10 05:00", "2024-03-11 04:00", "2024-03-12 04:00"], ["2024-11-02 04:00", "2024-11-03 04:00", "2024-11-04 05:00", "2024-11-05 05:00"]


def _local_days(s, d):
    rows = a.usage(s, d).select("ts")
    out = None
    for shift, day in DAYS:
        since, until = dates.day_bounds(day, day, "America/New_York")
        moved = F.col("ts") + F.make_dt_interval(F.lit(shift))
        inside = moved.between(*(F.lit(x.rstrip("Z")).cast("timestamp_ntz") for x in (since, until)))
        hours = round((datetime.fromisoformat(until) - datetime.fromisoformat(since)).total_seconds() / 3600)
        row = rows.agg(F.count_if(inside).alias("n")).select(F.lit(day).alias("day"), F.lit(hours).alias("hours"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _local_sql() -> str:
    parts = []
    for bounds, shift in zip(_BOUNDS, (66, 300)):
        for k, (x, y) in enumerate(zip(bounds, bounds[1:])):
            day = [day for sh, day in DAYS if sh == shift][k]
            parts.append(f"SELECT '{day}' AS day, CAST(date_diff('hour', TIMESTAMP '{x}', TIMESTAMP '{y}') AS INTEGER) AS hours, count(*) FILTER (ts + INTERVAL {shift} DAY >= TIMESTAMP '{x}' AND ts + INTERVAL {shift} DAY <= TIMESTAMP '{y}' - INTERVAL 1 MILLISECOND) AS n FROM events")
    return " UNION ALL ".join(parts)


def _presets(s, d):
    """Calls within presets, for a clock on the evening of 20 January in New York, when it is the 21st in UTC."""
    now = datetime(2024, 1, 21, 3, 0, tzinfo=timezone.utc)
    rows, out = a.usage(s, d).select("ts"), None
    for preset in ("today", "7d", "30d", "all", "custom"):
        first, last = dates.effective_days(preset, "" if preset == "all" else "2024-01-08", "" if preset == "all" else "2024-01-09", now, "America/New_York")
        since, until = dates.day_bounds(first, last, "America/New_York")
        kept = rows
        for bound, sign in ((since, "ge"), (until, "le")):
            if bound:
                edge = F.lit(bound.rstrip("Z")).cast("timestamp_ntz")
                kept = kept.filter(F.col("ts") >= edge if sign == "ge" else F.col("ts") <= edge)
        row = kept.agg(F.count("*").alias("n")).select(F.lit(preset).alias("preset"), F.lit(dates.window_days(first, last)).cast("int").alias("days"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _summaries(s, d):
    """Tool calls of many shapes, made of parts: the summary and the call itself."""
    p, name, brand = F.col("p_partkey"), F.to_json(F.struct("p_name")), F.to_json(F.struct("p_brand"))
    value = lambda j: F.regexp_extract(j, r":(.*)\}$", 1)
    n, b, size = value(name), value(brand), F.col("p_size").cast("string")
    shapes = [
        F.concat(F.lit('{"label":'), b, F.lit(',"url":'), n, F.lit("}")),
        F.concat(F.lit('{"n":{"label":'), n, F.lit('},"label":'), size, F.lit(',"z":'), b, F.lit("}")),
        F.concat(F.lit('{"a\\"b":'), n, F.lit(',"c":'), b, F.lit("}")),
        F.concat(F.lit(' {"n":'), size, F.lit(',"list":["x"],"none":null,"flag":true} ')),
        F.concat(F.lit('{"path":["'), size, F.lit('"],"description":'), n, F.lit("}")),
        F.concat(F.lit('["'), size, F.lit('",'), n, F.lit("]")),
        F.concat(F.repeat(F.lit("x"), (p % 120).cast("int")), F.lit("\nmore")),
        F.concat(F.lit('{"command":'), n, F.lit(',"file_path":"'), F.repeat(F.lit("é"), (p % 130).cast("int")), F.lit('\\nrest"}')),
    ]
    text = F.element_at(F.array(*shapes), (p % len(shapes) + 1).cast("int"))
    rows = a.read(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition("p_partkey")  # a file of few row groups is few tasks
    return rows.select("p_partkey", text.alias("content")).select("p_partkey", "content", derived.tool_summary(F.col("content")).alias("summary"))


_KEYS = ", ".join(f"'{k}'" for k in derived.SUMMARY_KEYS)
_SUMMARY_SQL = f"""WITH v AS (SELECT p_partkey, p_brand, to_json(p_name)::VARCHAR AS n, to_json(p_brand)::VARCHAR AS b, p_size::VARCHAR AS z FROM part),
 t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '{{"label":' || b || ',"url":' || n || '}}' WHEN 1 THEN '{{"n":{{"label":' || n || '}},"label":' || z || ',"z":' || b || '}}' WHEN 2 THEN '{{"a\\"b":' || n || ',"c":' || b || '}}'
  WHEN 3 THEN ' {{"n":' || z || ',"list":["x"],"none":null,"flag":true}} ' WHEN 4 THEN '{{"path":["' || z || '"],"description":' || n || '}}' WHEN 5 THEN '["' || z || '",' || n || ']' WHEN 6 THEN repeat('x', p_partkey % 120) || chr(10) || 'more'
  ELSE '{{"command":' || n || ',"file_path":"' || repeat('é', p_partkey % 130) || '\\nrest"}}' END AS content FROM v),
 j AS (SELECT *, json_valid(trim(content)) AS ok, CASE WHEN json_valid(trim(content)) THEN trim(content)::JSON END AS j FROM t),
 e AS (SELECT p_partkey, je.key, json_extract_string(je.value, '$') AS value, je.rowid AS place, je.type FROM j, json_each(j.j) je),
 h AS (SELECT p_partkey, arg_min(value, coalesce(list_position([{_KEYS}], key), 100 + place)) AS hit FROM e WHERE type = 'VARCHAR' GROUP BY 1),
 l AS (SELECT j.p_partkey, content, string_split(CASE WHEN NOT ok THEN trim(content) ELSE coalesce(hit, '') END, chr(10))[1] AS line FROM j LEFT JOIN h USING (p_partkey))
SELECT p_partkey, content, CASE WHEN length(line) > 96 THEN substring(line, 1, 95) || '…' ELSE line END AS summary FROM l"""

_RANKED = rf"""{a.with_sql("usage sessions")}, p AS (SELECT coalesce(nullif(pid, ''), '__unknown__') AS project, CAST(sum({TOTAL}) AS BIGINT) AS total, count(*) AS requests, count(DISTINCT sid || '|' || dev) AS sessions, sum(cost) AS cost
  FROM usage LEFT JOIN (SELECT id AS sid, device_id AS dev, {PID} AS pid FROM sessions) ON session_id = sid AND device_id = dev GROUP BY 1),
 r AS (SELECT *, CASE WHEN project <> '__unknown__' THEN row_number() OVER (PARTITION BY project = '__unknown__' ORDER BY total DESC, project) END AS rank FROM p)
SELECT CAST(CASE WHEN rank IS NOT NULL THEN least(rank, 3) END AS INTEGER) AS place, CASE WHEN rank >= 3 THEN '(rest)' ELSE project END AS project, count(*) AS projects, CAST(sum(total) AS BIGINT) AS total, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(round(sum(cost) * 10000) AS BIGINT) AS cost_units,
 round(CAST(sum(total) AS DOUBLE) / CAST((SELECT sum(total) FROM p) AS DOUBLE), 6) AS share, (SELECT count(*) FROM r WHERE rank IS NOT NULL) AS known, CASE WHEN (SELECT count(*) FROM r WHERE rank IS NOT NULL) >= 3 THEN round(CAST((SELECT sum(total) FROM r WHERE rank <= 3) AS DOUBLE) / CAST((SELECT sum(total) FROM p) AS DOUBLE), 6) END AS top3_share
FROM r GROUP BY 1, 2"""

_SECTION = f"""{a.with_sql("usage sessions turns")},
 x AS (SELECT g.*, s.parent_session_id, s.title, coalesce(t.turns, 0) AS turns, epoch_us(s.last_active_at) // 1000 - epoch_us(s.started_at) // 1000 AS span FROM (SELECT session_id, device_id, CAST(sum({TOTAL}) AS BIGINT) AS tokens FROM usage GROUP BY ALL) g
  JOIN sessions s ON s.id = g.session_id AND s.device_id = g.device_id LEFT JOIN (SELECT session_id, device_id, count(*) AS turns FROM turns GROUP BY ALL) t ON t.session_id = g.session_id AND t.device_id = g.device_id)"""

#: Name: (query, SQL).
CATALOG = {
    "A11_project_stats": (_project_stats(SessionFilter()), _project_sql("true", "true")),
    "A11_filtered": (
        _project_stats(SessionFilter(since="2024-01-10T00:00:00", model="click", project="/work/alpha", favorited=False)),
        _project_sql(f"last_active_at >= TIMESTAMP '2024-01-10' AND NOT favorited AND {PID} = '/work/alpha' AND EXISTS (SELECT 1 FROM usage x WHERE x.model = 'click' AND x.session_id = id AND x.device_id = sessions.device_id)", "ts >= TIMESTAMP '2024-01-10' AND model = 'click'"),
    ),
    "A12_session_stats": (
        lambda s, d: _stats(s, d).select("id", "device_id", "project", "requests", "messages", *TOKENS, "hit_rate", _units(), _models("model", "tokens")),
        _with_stats("true", f"SELECT id, device_id, project, requests, messages, {', '.join(TOKENS)}, {HIT} AS hit_rate, CAST(cost * 10000 AS BIGINT) AS cost_units, models FROM s"),
    ),
    "A12_session_models": (
        lambda s, d: _stats(s, d).select("id", "device_id", "messages", F.explode_outer("models").alias("m")).select("id", "device_id", F.coalesce("m.model", F.lit("")).alias("model"), F.coalesce("m.tokens", F.lit(0)).alias("tokens"), "messages"),
        _with_stats("true", f"SELECT id, s.device_id, coalesce(model, '') AS model, CAST(coalesce({'+'.join(f'pm.{c}' for c in TOKENS)}, 0) AS BIGINT) AS tokens, messages FROM s LEFT JOIN pm ON pm.session_id = id AND pm.device_id = s.device_id"),
    ),
    "A13_group_counts": (
        lambda s, d: st.group_counts(a.sessions(s, d).filter("NOT excluded"), "local_group").filter("group_id IS NOT NULL").withColumnRenamed("group_id", "local_group"),
        a.with_sql("sessions") + " SELECT local_group, count(*) AS n FROM sessions WHERE NOT excluded GROUP BY 1",
    ),
    "A13_tracks": (
        lambda s, d: st.group_counts(a.sessions(s, d).filter("NOT excluded"), "local_group").withColumn("track", F.lit("local")).unionByName(st.group_counts(a.sessions(s, d).filter("NOT excluded").withColumn("synced_group", F.when(F.col("favorited"), F.concat(F.lit("y"), "local_group")).otherwise("")), "synced_group").withColumn("track", F.lit("synced"))),
        a.with_sql("sessions") + ", c AS (SELECT *, CASE WHEN favorited THEN 'y' || local_group ELSE '' END AS synced_group FROM sessions WHERE NOT excluded) SELECT local_group AS group_id, count(*) AS n, 'local' AS track FROM c GROUP BY 1 UNION ALL SELECT synced_group, count(*), 'synced' FROM c GROUP BY 1 UNION ALL SELECT NULL, count(*), 'local' FROM c UNION ALL SELECT NULL, count(*), 'synced' FROM c",
    ),
    "C6_ranking": (lambda s, d: st.project_ranking(u.project_usage(a.usage(s, d), a.sessions(s, d)), 2).select("place", "project", "projects", "total", "requests", "sessions", F.round(F.col("cost") * 10000).cast("bigint").alias("cost_units"), "share", "known", "top3_share"), _RANKED),
    "C7_sections": (
        lambda s, d: st.session_section(_section_rows(s, d)).select("*", *(F.col("turn_bins")[k].alias(f"bin{k}") for k in range(4))).drop("turn_bins"),
        f"""{_SECTION} SELECT count(*) AS sessions, count(*) FILTER (parent_session_id <> '') AS subagents, round(avg(CASE WHEN parent_session_id <> '' THEN 1.0 ELSE 0.0 END), 6) AS subagent_share, max(CASE WHEN span > 0 THEN span END) AS longest_ms, round(CAST(sum(turns) AS DOUBLE) / count(*), 6) AS avg_turns,
         CAST(greatest(sum(tokens), 1) AS BIGINT) AS total, count(*) FILTER (turns <= 3) AS bin0, count(*) FILTER (turns BETWEEN 4 AND 8) AS bin1, count(*) FILTER (turns BETWEEN 9 AND 16) AS bin2, count(*) FILTER (turns > 16) AS bin3 FROM x""",
    ),
    "C7_top": (
        lambda s, d: st.top_sessions(_section_rows(s, d), 8),
        f"{_SECTION} SELECT session_id, device_id, coalesce(nullif(title, ''), session_id) AS title, tokens, round(CAST(tokens AS DOUBLE) / CAST((SELECT greatest(sum(tokens), 1) FROM x) AS DOUBLE), 6) AS share FROM x ORDER BY tokens DESC, session_id, device_id LIMIT 8",
    ),
    "C11_day_groups": (
        lambda s, d: _groups(s, d)[0],
        a.with_sql("usage") + """, r AS (SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY ts DESC, uuid, device_id) AS rn FROM usage),
         g AS (SELECT *, CASE WHEN lag(day) OVER (ORDER BY rn) = day THEN 0 ELSE 1 END AS new FROM r), o AS (SELECT *, sum(new) OVER (ORDER BY rn) AS ordinal FROM g)
        SELECT CAST(ordinal AS BIGINT) AS ordinal, day, count(*) AS n FROM o GROUP BY 1, 2""",
    ),
    "C11_rows": (
        lambda s, d: _groups(s, d)[1].select("uuid", "device_id", "ordinal"),
        a.with_sql("usage") + " SELECT uuid, device_id, CAST(dense_rank() OVER (ORDER BY strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') DESC) AS BIGINT) AS ordinal FROM usage",
    ),
    "C13_notable": (
        lambda s, d: a.usage(s, d).select("uuid", st.notable(F.col("cost") / 100).alias("notable")),
        a.with_sql("usage") + " SELECT uuid, cost >= 100 AS notable FROM usage",
    ),
    "C14_per_turn": (
        lambda s, d: _section_rows(s, d).select("session_id", "device_id", st.per_turn(F.col("requests"), F.col("turns")).alias("per_turn")),
        f"""{_SECTION} SELECT x.session_id, x.device_id, CASE WHEN turns > 0 THEN round(CAST(n AS DOUBLE) / turns, 6) END AS per_turn FROM x JOIN (SELECT session_id, device_id, count(*) AS n FROM usage GROUP BY ALL) c ON c.session_id = x.session_id AND c.device_id = x.device_id""",
    ),
    "C15_session_set": (
        _set,
        _with_stats("true", f"""SELECT count(*) AS sessions, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(messages) AS BIGINT) AS messages, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKENS)},
         round(CAST(sum(cache_read) AS DOUBLE) / CAST(sum(input + cache_creation + cache_read) AS DOUBLE), 6) AS hit_rate, CAST(sum(cost) * 10000 AS BIGINT) AS cost_units, CAST(sum(span) AS BIGINT) AS total_span_ms,
         count(*) FILTER (span < 900000) AS bin0, count(*) FILTER (span >= 900000 AND span < 3600000) AS bin1, count(*) FILTER (span >= 3600000 AND span < 10800000) AS bin2, count(*) FILTER (span >= 10800000) AS bin3,
         (SELECT string_agg(model || ':' || tokens || ':' || n, '>' ORDER BY tokens DESC, model) FROM (SELECT pm.model, CAST(sum({'+'.join(f'pm.{c}' for c in TOKENS)}) AS BIGINT) AS tokens, count(*) AS n FROM pm JOIN s ON s.id = pm.session_id AND s.device_id = pm.device_id GROUP BY 1)) AS models, max(last_active_at) AS last_active_at
         FROM (SELECT *, nullif(epoch_us(last_active_at) // 1000 - epoch_us(started_at) // 1000, 0) AS span FROM s)"""),
    ),
    "C15_models": (
        lambda s, d: st.session_set(_stats(s, d)).select(F.explode("models").alias("m")).select("m.*"),
        _with_stats("true", f"SELECT model, CAST(sum({'+'.join(f'pm.{c}' for c in TOKENS)}) AS BIGINT) AS tokens, count(*) AS sessions FROM pm JOIN s ON s.id = pm.session_id AND s.device_id = pm.device_id GROUP BY 1"),
    ),
    "C16_nodes": (
        lambda s, d: st.node_rows(_stats(s, d)).select("project", "id", "device_id", "node_sessions", "node_tokens", "node_newest"),
        _with_stats("true", f"SELECT project, id, device_id, count(*) OVER w AS node_sessions, CAST(sum({TOTAL}) OVER w AS BIGINT) AS node_tokens, max(last_active_at) OVER w AS node_newest FROM s WINDOW w AS (PARTITION BY project)"),
    ),
    "C22_summaries": (_summaries, _SUMMARY_SQL),
    "P7_presets": (
        _presets,
        """SELECT preset, CAST(days AS INTEGER) AS days, (SELECT count(*) FROM events WHERE (a IS NULL OR ts >= a) AND (b IS NULL OR ts <= b - INTERVAL 1 MILLISECOND)) AS n FROM (VALUES ('today', 1, TIMESTAMP '2024-01-20 05:00', TIMESTAMP '2024-01-21 05:00'), ('7d', 7, TIMESTAMP '2024-01-14 05:00', TIMESTAMP '2024-01-21 05:00'),
         ('30d', 30, TIMESTAMP '2023-12-22 05:00', TIMESTAMP '2024-01-21 05:00'), ('all', NULL, NULL, NULL), ('custom', 2, TIMESTAMP '2024-01-08 05:00', TIMESTAMP '2024-01-10 05:00')) AS t(preset, days, a, b)""",
    ),
    "P8_local_days": (_local_days, _local_sql()),
}
