"""Usage, sessions and transcripts from a store of sessions, messages and parts of messages.

Tables: sessions (id, title, directory, time_created, time_updated), messages (id, session_id, time_created,
time_updated, data) and parts (id, message_id, session_id, time_created, data); times are milliseconds, data is JSON.
A session is read again when it or one of its messages is newer than its cursor (session_id, watermark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.expr import basename, iso_millis, truncated
from tallyforge.operators.thread_log import _trimmed

SOURCE = "opencode"
SESSIONS = "id string, title string, directory string, time_created bigint, time_updated bigint"
MESSAGES = "id string, session_id string, time_created bigint, time_updated bigint, data string"
PARTS = "id string, message_id string, session_id string, time_created bigint, data string"
MESSAGE = """role string, modelID string, time struct<created: bigint>,
 tokens struct<input: bigint, output: bigint, reasoning: bigint, cache: struct<read: bigint, write: bigint>>"""
PART = "type string, text string, tool string"


def watermarks(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, watermark): when a session or its newest message was written."""
    newest = messages.groupBy("session_id").agg(F.max("time_updated").alias("newest"))
    own = sessions.select(F.col("id").alias("session_id"), "time_updated")
    return own.join(newest, "session_id", "left").select("session_id", F.greatest("time_updated", "newest").alias("watermark"))


def due(sessions: DataFrame, messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """(session_id, watermark) of the sessions that have moved past their cursor."""
    read_to = cursors.select("session_id", F.col("watermark").alias("read_to"))
    moved = watermarks(sessions, messages).join(read_to, "session_id", "left")
    return moved.filter(F.col("watermark") > F.coalesce("read_to", F.lit(0))).drop("read_to")


def of_sessions(rows: DataFrame, wanted: DataFrame, column: str = "session_id") -> DataFrame:
    """The rows of the sessions wanted."""
    return rows.join(wanted.select(F.col("session_id").alias(column)), column, "left_semi")


def _answers(messages: DataFrame) -> DataFrame:
    """Assistants' messages that tell tokens, and whether they are finished."""
    has = lambda path, key: F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object("data", path)), key), F.lit(False))
    rows = messages.select("id", "session_id", F.from_json("data", MESSAGE).alias("m"), has("$", "tokens").alias("told"), has("$.time", "completed").alias("finished"))
    return rows.filter("m.role = 'assistant' AND told")


def advanced(wanted: DataFrame, messages: DataFrame) -> DataFrame:
    """The cursors after the sessions wanted were read; one with an unfinished answer stays where it was, to be read again."""
    return wanted.join(_answers(messages).filter("NOT finished"), "session_id", "left_anti")


def usage(messages: DataFrame, collected_at: str = "") -> DataFrame:
    """One row for each finished answer that used tokens; reasoning counts as output."""
    n = lambda c: F.greatest(F.coalesce(F.col(f"m.tokens.{c}"), F.lit(0)), F.lit(0))
    created = F.col("m.time.created")
    stamp = F.concat(F.regexp_replace(F.regexp_replace(iso_millis(created), "Z$", ""), r"\.000$", ""), F.lit("+00:00"))
    rows = _answers(messages).filter("finished").select(
        F.concat_ws(":", F.lit(SOURCE), "session_id", "id").alias("uuid"), F.when(created > 0, stamp).otherwise(F.lit(collected_at)).alias("timestamp"),
        F.coalesce("m.modelID", F.lit("unknown")).alias("model"), F.lit(SOURCE).alias("source"), "session_id",
        n("input").alias("input"), (n("output") + n("reasoning")).alias("output"), n("cache.write").alias("cache_creation"), n("cache.read").alias("cache_read"),
    )
    return rows.filter("input + output + cache_creation + cache_read > 0")


def sessions(rows: DataFrame) -> DataFrame:
    """One row for each session; without a title it has its folder's name."""
    title = F.coalesce(F.nullif(_trimmed(F.col("title")), F.lit("")), basename(F.coalesce("directory", F.lit(""))))
    return rows.select(
        "id", F.lit(SOURCE).alias("source"), F.coalesce("directory", F.lit("")).alias("project_dir"), title.alias("title_orig"), iso_millis(F.col("time_created")).alias("started_at"),
        iso_millis(F.col("time_updated")).alias("last_active_at"), F.lit("").alias("agent_type"), F.lit("").alias("parent_session_id"),
    )


def _piece(part: Column) -> Column:
    """What a part adds to its message: a text that isn't blank, or the name of a tool."""
    text = F.when((part["type"] == "text") & (_trimmed(part["text"]) != ""), part["text"])
    return F.coalesce(text, F.when((part["type"] == "tool") & (part["tool"] != ""), part["tool"]))


def messages(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Transcript messages: the parts of each message in the order of their time; messages that say nothing are left out."""
    part = parts.select("session_id", "message_id", "time_created", "id", F.from_json("data", PART).alias("p"))
    piece = part.select("session_id", F.col("message_id").alias("id"), F.struct("time_created", F.col("id").alias("part"), _piece(F.col("p")).alias("piece"), F.when(F.col("p.type") == "tool", F.nullif("p.tool", F.lit(""))).alias("tool")).alias("s"))
    told = piece.filter("s.piece IS NOT NULL").groupBy("session_id", "id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    content = F.array_join(F.transform("s", lambda s: s["piece"]), "\n")
    name = F.try_element_at(F.filter(F.transform("s", lambda s: s["tool"]), lambda t: t.isNotNull()), F.lit(1))
    own = rows.select("session_id", "id", "time_created", F.from_json("data", MESSAGE).alias("m")).filter("m.role IN ('user', 'assistant', 'tool')")
    return own.join(told, ["session_id", "id"]).select(F.col("id").alias("uuid"), "session_id", iso_millis(F.col("time_created")).alias("ts"), "m.role", F.nullif("m.modelID", F.lit("")).alias("model"), name.alias("name"), truncated(content).alias("content"))
