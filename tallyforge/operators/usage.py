"""Filters, joins and aggregations over usage, turns, sessions and messages."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expr import TOKENS, UNKNOWN_PROJECT, ascii_lower, hit_rate, project_identity, total_tokens

SESSION_KEY = ["session_id", "device_id"]


@dataclass(frozen=True)
class UsageFilter:
    """Bounds are inclusive; None and '' mean no constraint."""

    since: str | None = None
    until: str | None = None
    model: str | None = None
    source: str | None = None
    device: str | None = None
    project: str | None = None

    def without(self, name: str) -> UsageFilter:
        return replace(self, **{name: None})


@dataclass(frozen=True)
class SessionFilter:
    """As UsageFilter, but group '' means sessions without a group."""

    since: str | None = None
    until: str | None = None
    model: str | None = None
    source: str | None = None
    device: str | None = None
    project: str | None = None
    favorited: bool | None = None
    group: str | None = None
    search: str | None = None


def window_days(f: UsageFilter) -> int:
    """The days from the first to the last of a filter's bounds, both counted; 1 where a bound is missing."""
    if not f.since or not f.until:
        return 1
    return max(1, (date.fromisoformat(f.until[:10]) - date.fromisoformat(f.since[:10])).days + 1)


def page_limit(n: int) -> int:
    return min(max(n, 1), 1000)


def _session_keys(sessions: DataFrame) -> DataFrame:
    return sessions.withColumnRenamed("id", "session_id")


def where_usage(rows: DataFrame, sessions: DataFrame, f: UsageFilter) -> DataFrame:
    """Rows that a filter leaves; by project through a semi join, or an anti join for usage without a session."""
    for c, v in (("model", f.model), ("source", f.source), ("device_id", f.device)):
        if v:
            if c not in rows.columns:
                raise ValueError(f"rows have no column {c} to filter by")
            rows = rows.filter(F.col(c) == v)
    if f.since:
        rows = rows.filter(F.col("ts") >= F.lit(f.since).cast("timestamp_ntz"))
        rows = rows.filter(F.col("day") >= f.since[:10]) if "day" in rows.columns else rows
    if f.until:
        rows = rows.filter(F.col("ts") <= F.lit(f.until).cast("timestamp_ntz"))
        rows = rows.filter(F.col("day") <= f.until[:10]) if "day" in rows.columns else rows
    keys = _session_keys(sessions)
    if f.project == UNKNOWN_PROJECT:
        rows = rows.join(keys.select(*SESSION_KEY), SESSION_KEY, "left_anti")
    elif f.project:
        rows = rows.join(keys.filter(project_identity("project_dir") == f.project).select(*SESSION_KEY), SESSION_KEY, "left_semi")
    return rows


def where_sessions(sessions: DataFrame, usage: DataFrame, messages: DataFrame, f: SessionFilter) -> DataFrame:
    """Sessions that aren't excluded and that a filter leaves; a search looks at title, folder and all messages."""
    rows = sessions.filter(~F.col("excluded"))
    for c, v in (("source", f.source), ("device_id", f.device)):
        rows = rows.filter(F.col(c) == v) if v else rows
    if f.favorited is not None:
        rows = rows.filter(F.col("favorited") == f.favorited)
    if f.group is not None:
        rows = rows.filter(F.col("local_group") == f.group)
    if f.project is not None and f.project != "":
        rows = rows.filter(project_identity("project_dir") == ("" if f.project == UNKNOWN_PROJECT else f.project))
    if f.since:
        rows = rows.filter(F.col("last_active_at") >= F.lit(f.since).cast("timestamp_ntz"))
    if f.until:
        rows = rows.filter(F.col("last_active_at") <= F.lit(f.until).cast("timestamp_ntz"))
    if f.model:
        used = usage.filter(F.col("model") == f.model).select(F.col("session_id").alias("id"), "device_id")
        rows = rows.join(used, ["id", "device_id"], "left_semi")
    if f.search and f.search.strip():
        needle = ascii_lower(F.lit(f.search.strip()))
        hits = messages.filter(ascii_lower("content").contains(needle)).select(F.col("session_id").alias("id")).distinct().withColumn("hit", F.lit(True))
        named = ascii_lower("title").contains(needle) | ascii_lower("project_dir").contains(needle)
        rows = rows.join(hits, "id", "left").filter(named | F.col("hit")).drop("hit")
    return rows


def token_sums() -> list:
    return [F.count("*").alias("requests"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS), F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost")]


def with_rates(df: DataFrame) -> DataFrame:
    out = df.withColumn("total", total_tokens()).withColumn("hit_rate", hit_rate(F.col("cache_read"), F.col("input"), F.col("cache_creation")))
    return out.withColumn("cost", F.round("cost", 6))


def stats(usage: DataFrame) -> DataFrame:
    return with_rates(usage.agg(*token_sums()))


def turn_stats(turns: DataFrame) -> DataFrame:
    """Count, mean, four bins and the 95th percentile (an element, not an interpolation) of turn durations."""
    d = F.col("duration_ms")
    bins = [("under_10s", d < 10_000), ("under_30s", (d >= 10_000) & (d < 30_000)), ("under_60s", (d >= 30_000) & (d < 60_000)), ("from_60s", d >= 60_000)]
    return turns.agg(
        F.count("*").alias("turns"), F.coalesce(F.round(F.avg("duration_ms"), 6), F.lit(0.0)).alias("avg_ms"),
        *(F.count_if(c).alias(n) for n, c in bins),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").cast("bigint").alias("p95_ms"),
    )


def by(usage: DataFrame, *keys) -> DataFrame:
    return with_rates(usage.groupBy(*keys).agg(*token_sums()))


def hour_of(tz: str):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), tz)
    return F.date_format(local, "yyyy-MM-dd'T'HH").alias("bucket")


def facet(usage: DataFrame, column: str) -> DataFrame:
    return usage.filter(F.col(column) != "").select(F.col(column).alias("value")).distinct()


def project_usage(usage: DataFrame, sessions: DataFrame) -> DataFrame:
    """Usage by project; calls without a session or with an empty folder are one bucket."""
    known = _session_keys(sessions).select(*SESSION_KEY, project_identity("project_dir").alias("pid"))
    joined = usage.join(known.withColumn("has", F.lit(True)), SESSION_KEY, "left")
    pid = F.when(F.coalesce("pid", F.lit("")) == "", UNKNOWN_PROJECT).otherwise(F.col("pid"))
    sums = joined.groupBy(pid.alias("project")).agg(*token_sums(), F.count_distinct(F.when(F.col("has"), F.struct(*SESSION_KEY))).alias("sessions"), F.max("ts").alias("last_ts"))
    return with_rates(sums)


def session_usage(usage: DataFrame, sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Usage by session, with a title and the number of turns."""
    sums = usage.groupBy(*SESSION_KEY).agg(*token_sums(), F.max("ts").alias("last_ts"))
    counts = turns.groupBy(*SESSION_KEY).agg(F.count("*").alias("turns"))
    named = _session_keys(sessions).select(*SESSION_KEY, F.coalesce(F.nullif("title", F.lit("")), "session_id").alias("title"))
    return with_rates(sums.join(named, SESSION_KEY).join(counts, SESSION_KEY, "left").withColumn("turns", F.coalesce("turns", F.lit(0))))


def session_list(chosen: DataFrame, usage: DataFrame) -> DataFrame:
    """Sessions with their usage, summed before the join."""
    sums = usage.groupBy(F.col("session_id").alias("id"), "device_id").agg(F.count("*").alias("requests"), F.sum(total_tokens()).alias("tokens"), F.sum("cost").alias("cost"))
    joined = chosen.join(sums, ["id", "device_id"], "left")
    return joined.select("id", "device_id", "title", project_identity("project_dir").alias("project"), "last_active_at", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "tokens")), F.round(F.coalesce("cost", F.lit(0)).cast("double"), 6).alias("cost"))


def projects(sessions: DataFrame, usage: DataFrame, messages: DataFrame, f: UsageFilter) -> DataFrame:
    """The projects of sessions that aren't excluded, and the unknown one if any usage has no session."""
    listed = where_sessions(sessions, usage, messages, SessionFilter(f.since, f.until, f.model, f.source, f.device))
    known = listed.select(project_identity("project_dir").alias("value")).filter("value <> ''").distinct()
    loose = where_usage(usage, sessions, replace(f, project=UNKNOWN_PROJECT)).limit(1).select(F.lit(UNKNOWN_PROJECT).alias("value"))
    return known.union(loose)


def first_seen(usage: DataFrame, devices: DataFrame) -> DataFrame:
    """The earliest call of each device that isn't registered."""
    return usage.join(devices.select("device_id"), "device_id", "left_anti").groupBy("device_id").agg(F.min("ts").alias("first_ts"))


def top_models(per_model: DataFrame, n: int) -> DataFrame:
    """The n models with the most tokens, and the rest as one row."""
    order = Window.orderBy(F.desc("total"), "model")  # one row for each model: few
    rank = F.row_number().over(order)
    name = F.when(F.col("rank") <= n, F.col("model")).otherwise("(rest)")
    return per_model.withColumn("rank", rank).groupBy(name.alias("model")).agg(F.count("*").alias("models"), F.sum("total").alias("total"), F.round(F.sum("cost"), 6).alias("cost"))


def filled_hours(per_hour: DataFrame, day: str, last_hour: int = 23) -> DataFrame:
    """All hours of a day up to ``last_hour``, with zeros where nothing happened; nothing if the day has no row."""
    own = per_hour.filter(F.col("bucket").startswith(day))
    hours = own.agg(F.count("*").alias("n")).filter("n > 0").select(F.explode(F.sequence(F.lit(0), F.lit(last_hour))).alias("h"))
    buckets = hours.select(F.concat(F.lit(day + "T"), F.lpad(F.col("h").cast("string"), 2, "0")).alias("bucket"))
    return buckets.join(own, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "total")))


def transcript(messages: DataFrame, own_device: str) -> DataFrame:
    """Messages of all devices, each uuid once: the own device's copy, else that of the first device."""
    order = Window.partitionBy("uuid").orderBy((F.col("device_id") != own_device), "device_id")
    return messages.withColumn("copy", F.row_number().over(order)).filter("copy = 1").drop("copy")


def conversation(messages: DataFrame) -> DataFrame:
    """Turn ordinals (0 before the first user message) and the assistant message that a tool message belongs to."""
    session = Window.partitionBy("session_id", "device_id").orderBy("ts", "uuid")
    numbered = messages.withColumn("turn", F.coalesce(F.sum(F.when(F.col("role") == "user", 1)).over(session), F.lit(0)))
    turn = Window.partitionBy("session_id", "device_id", "turn").orderBy("ts", "uuid")
    answer = F.when(F.col("role") == "assistant", F.col("uuid"))
    before = F.last(answer, ignorenulls=True).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(answer, ignorenulls=True).over(turn.rowsBetween(0, Window.unboundedFollowing))
    return numbered.withColumn("belongs_to", F.when(F.col("role") == "tool", F.coalesce(before, after)))


def search_snippets(messages: DataFrame, needle: str, around: int = 28) -> DataFrame:
    """Where a text first occurs in each message, and what stands around it; a blank text occurs nowhere."""
    needle = needle.strip()
    if not needle:
        messages = messages.filter(F.lit(False))
    at = F.instr(F.lower("content"), needle.lower())
    found = messages.withColumn("at", at).filter("at > 0")
    first = F.greatest(F.col("at") - around, F.lit(1))
    last = F.least(F.col("at") + len(needle) - 1 + around, F.char_length("content"))
    middle = F.substring("content", first, last - first + 1)
    snippet = F.concat(F.when(first > 1, "…").otherwise(""), middle, F.when(last < F.char_length("content"), "…").otherwise(""))
    return found.select("session_id", "uuid", F.col("at").alias("place"), snippet.alias("snippet"))


def nested(sessions: DataFrame) -> DataFrame:
    """Sessions with the parent that is itself listed; others are roots."""
    parents = sessions.select(F.col("id").alias("parent_session_id"), "device_id", F.col("id").alias("parent"))
    return sessions.join(parents, ["parent_session_id", "device_id"], "left").select("id", "device_id", F.coalesce("parent", F.lit("")).alias("parent"))


def latest(rows: DataFrame, keys: list[str], stamp: str, seen: str) -> DataFrame:
    """The newest row of each key; of equally new ones the one seen first (the least of column ``seen``)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(stamp), -F.col(seen))).alias("r"))
    return best.select(*keys, "r.*")
