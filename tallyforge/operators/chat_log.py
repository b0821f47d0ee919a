"""Logs that are one object for each chat, and logs of session updates with usage by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.expr import TITLE_LIMIT, fresh_input, iso_millis, truncated
from tallyforge.operators.thread_log import _trimmed

CHAT = """sessionId string, startTime string, lastUpdated string, messages array<struct<id: string, type: string, timestamp: string, model: string, content: string,
 toolCalls: array<struct<name: string>>, tokens: struct<input: bigint, output: bigint, cached: bigint, thoughts: bigint>>>"""
UPDATE = """timestamp string, method string, params struct<update: struct<sessionUpdate: string, prompt_id: string,
 usage: struct<inputTokens: bigint, outputTokens: bigint, cachedReadTokens: bigint, modelUsage: map<string, struct<inputTokens: bigint, outputTokens: bigint, cachedReadTokens: bigint>>>>>"""


def chats(files: DataFrame) -> DataFrame:
    """The chats of files (path, value); files that aren't an object are left out."""
    rows = files.select("path", F.from_json("value", CHAT).alias("c")).filter("c IS NOT NULL AND (c.sessionId IS NOT NULL OR c.messages IS NOT NULL)")
    return rows.select("path", F.coalesce("c.sessionId", F.lit("unknown")).alias("session_id"), F.coalesce("c.startTime", F.lit("")).alias("started_at"), F.coalesce("c.lastUpdated", F.lit("")).alias("last_active_at"), "c.messages")


def _texts(content: Column) -> Column:
    parts = F.filter(F.transform(F.from_json(content, "array<struct<text: string>>"), lambda p: p["text"]), lambda t: t.isNotNull())
    return F.when(F.ltrim(content).startswith("["), parts).when(content.isNotNull(), F.array(content))


def chat_usage(chats: DataFrame, collected_at: str = "") -> DataFrame:
    """One row for each answer that used tokens; thoughts count as output, what was cached isn't fresh input."""
    each = chats.select("session_id", F.explode("messages").alias("m")).filter("m.type = 'gemini' AND m.tokens IS NOT NULL")
    n = lambda c: F.coalesce(F.col(f"m.tokens.{c}"), F.lit(0))
    fresh, cached = fresh_input(n("input"), n("cached"))
    rows = each.select(F.concat_ws(":", F.lit("gemini"), "session_id", F.coalesce("m.id", F.lit("unknown"))).alias("uuid"), F.coalesce("m.timestamp", F.lit(collected_at)).alias("timestamp"), F.coalesce("m.model", F.lit("unknown")).alias("model"), F.lit("gemini").alias("source"), "session_id", fresh.alias("input"), (n("output") + n("thoughts")).alias("output"), F.lit(0).cast("bigint").alias("cache_creation"), cached.alias("cache_read"))
    return rows.filter("input > 0 OR output > 0 OR cache_read > 0")


def chat_sessions(chats: DataFrame, roots: DataFrame) -> DataFrame:
    """One row for each chat; roots has the project of each folder (folder, project_dir). The title is the first user text."""
    said = F.filter(F.transform(F.filter("messages", lambda m: m["type"] == "user"), lambda m: _trimmed(F.try_element_at(_texts(m["content"]), F.lit(1)))), lambda t: t != "")
    rows = chats.withColumn("folder", F.regexp_extract("path", r"^(.*)[/\\]chats[/\\][^/\\]*$", 1)).join(roots.select("folder", "project_dir"), "folder", "left")
    title = truncated(F.coalesce(F.try_element_at(said, F.lit(1)), F.lit("")), TITLE_LIMIT)
    return rows.select(F.col("session_id").alias("id"), F.lit("gemini").alias("source"), F.coalesce(_trimmed(F.col("project_dir")), F.lit("")).alias("project_dir"), title.alias("title_orig"), "started_at", "last_active_at", F.lit("").alias("agent_type"), F.lit("").alias("parent_session_id"))


def chat_messages(chats: DataFrame) -> DataFrame:
    """Transcript messages with an id and a text."""
    each = chats.select("session_id", F.explode("messages").alias("m")).filter("m.type IN ('user', 'gemini') AND m.id <> ''")
    is_user = F.col("m.type") == "user"
    rows = each.select(F.col("m.id").alias("uuid"), "session_id", F.coalesce("m.timestamp", F.lit("")).alias("ts"), F.when(is_user, "user").otherwise("assistant").alias("role"), F.when(~is_user, F.col("m.model")).alias("model"), F.try_element_at("m.toolCalls", F.lit(1))["name"].alias("name"), truncated(F.array_join(_texts(F.col("m.content")), "\n")).alias("content"))
    return rows.filter("content <> ''")


def update_usage(lines: DataFrame) -> DataFrame:
    """One row for each model of a completed turn, or one of an unknown model where a turn tells none."""
    rows = lines.select("path", "after", "line", F.from_json("value", UPDATE).alias("e")).filter("line > after AND e.method = '_x.ai/session/update' AND e.timestamp IS NOT NULL AND e.params.update.usage IS NOT NULL")
    u = F.col("e.params.update")
    rows = rows.filter(u["sessionUpdate"].isNull() | (u["sessionUpdate"] == "turn_completed"))
    whole = F.create_map(F.lit("unknown"), F.struct(u["usage"]["inputTokens"], u["usage"]["outputTokens"], u["usage"]["cachedReadTokens"]))
    models = F.when(F.coalesce(F.size(u["usage"]["modelUsage"]), F.lit(0)) > 0, u["usage"]["modelUsage"]).otherwise(whole)
    session = F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]+$", 1)
    each = rows.select(session.alias("session_id"), F.col("e.timestamp").alias("timestamp"), F.coalesce(F.nullif(u["prompt_id"], F.lit("")), F.concat(F.lit("line"), "line")).alias("turn"), F.explode(models).alias("model", "n"))
    n = lambda c: F.coalesce(F.col(f"n.{c}"), F.lit(0))
    fresh, cached = fresh_input(n("inputTokens"), n("cachedReadTokens"))
    out = each.select(F.concat_ws(":", F.lit("grok:turn"), "session_id", "turn", "model").alias("uuid"), "timestamp", "model", F.lit("grok").alias("source"), "session_id", fresh.alias("input"), n("outputTokens").alias("output"), F.lit(0).cast("bigint").alias("cache_creation"), cached.alias("cache_read"))
    return out.filter("input > 0 OR output > 0 OR cache_read > 0")


SUMMARY = "info struct<id: string, cwd: string>, generated_title string, session_summary string, created_at string, last_active_at string, updated_at string"
HISTORY = "type string, content string, name string, tool_name string, timestamp string, ts string"
FOLDER, FOLDER_NAME = r"^(.*)[/\\][^/\\]+$", r"([^/\\]+)[/\\][^/\\]+$"


def _instant(told: Column) -> Column:
    """Seconds or (beyond 1e11) milliseconds since 1970, or a time with its offset, as a UTC time; empty if it is none."""
    n = F.when(told.rlike(r"\A-?[0-9]{1,18}\z"), told.cast("bigint"))
    whole = F.when(n > 100_000_000_000, F.floor(n / 1000)).otherwise(n).cast("bigint")
    stamp = F.when(told.rlike(r"\A\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z"), F.unix_millis(F.try_to_timestamp(F.upper(told))))
    return F.coalesce(iso_millis(F.coalesce(whole * 1000, stamp)), F.lit(""))


def _history(lines: DataFrame) -> DataFrame:
    """Lines of transcripts with ``said``, the text of their content (a text, or a list of blocks), trimmed."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.content", "variant"))
    texts = F.filter(F.from_json("e.content", "array<struct<type: string, text: string>>"), lambda b: (b["type"] == "text") & b["text"].isNotNull())
    said = F.when(kind == "STRING", F.col("e.content")).when(kind.startswith("ARRAY"), F.array_join(F.transform(texts, lambda b: b["text"]), "\n"))
    rows = lines.select("path", "after", "line", "value", F.from_json("value", HISTORY).alias("e"))
    return rows.select("path", "after", "line", "e", _trimmed(F.coalesce(said, F.lit(""))).alias("said"))


def update_sessions(summaries: DataFrame, history: DataFrame) -> DataFrame:
    """One row for each summary file (path, value); history has the lines of the transcripts beside them.

    The title is the one generated, else the summary's, else the first text of a user. A folder with a transcript but
    without a summary is a session that tells its name alone.
    """
    said = _history(history).filter("e.type = 'user' AND said <> ''").groupBy(F.regexp_extract("path", FOLDER, 1).alias("folder")).agg(F.min_by("said", "line").alias("said"))
    told = summaries.select(F.regexp_extract("path", FOLDER, 1).alias("folder"), F.regexp_extract("path", FOLDER_NAME, 1).alias("name"), F.from_json("value", SUMMARY).alias("s"))
    filled = lambda c: F.nullif(_trimmed(F.col(c)), F.lit(""))
    title = truncated(F.coalesce(filled("s.generated_title"), filled("s.session_summary"), "said", F.lit("")), TITLE_LIMIT)
    full = told.join(said, "folder", "left").select(F.coalesce(F.nullif("s.info.id", F.lit("")), "name").alias("id"), F.coalesce("s.info.cwd", F.lit("")).alias("project_dir"), title.alias("title_orig"), _instant(F.col("s.created_at")).alias("started_at"), _instant(F.coalesce("s.last_active_at", "s.updated_at")).alias("last_active_at"))
    empty = F.lit("")
    bare = history.select(F.regexp_extract("path", FOLDER, 1).alias("folder"), F.regexp_extract("path", FOLDER_NAME, 1).alias("id")).distinct().join(told.select("folder"), "folder", "left_anti")
    both = full.unionByName(bare.select("id", empty.alias("project_dir"), empty.alias("title_orig"), empty.alias("started_at"), empty.alias("last_active_at")))
    return both.select("id", F.lit("grok").alias("source"), "project_dir", "title_orig", "started_at", "last_active_at", empty.alias("agent_type"), empty.alias("parent_session_id"))


def update_messages(lines: DataFrame) -> DataFrame:
    """Transcript messages with a text; a message is known by its line."""
    rows = _history(lines).filter("line > after AND said <> '' AND e.type IN ('user', 'assistant', 'tool', 'system')")
    session = F.regexp_extract("path", FOLDER_NAME, 1)
    name = F.when(F.col("e.type") == "tool", F.coalesce("e.name", "e.tool_name"))
    return rows.select(F.concat(F.lit("grok:msg:"), session, F.lit(":line"), F.col("line")).alias("uuid"), session.alias("session_id"), _instant(F.coalesce("e.timestamp", "e.ts")).alias("ts"), F.col("e.type").alias("role"), F.lit(None).cast("string").alias("model"), name.alias("name"), truncated(F.col("said")).alias("content"))
