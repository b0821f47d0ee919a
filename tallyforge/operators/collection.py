"""Collection of a user's logs: each source's files that are due are read and folded, and all lands in one commit, cursors too.

A source is a function from its listing and its due files to what they tell. Calls, turns and messages come from what is
new, sessions from whole files, and a session whose file went goes, unless none of the source's files can be seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import chat_log, database_log, landing, message_log, thread_log
from tallyforge.operators.landing import Found
from tallyforge.sources import databases, discovery, scratch
from tallyforge.sources.discovery import LINES, SOURCES, WHOLE, Shape, Source
from tallyforge.sources.tables import State, Tables

#: Files beside the logs that describe sub-agents and projects, and where the store of sessions lies.
SIDECARS = Source("sidecars", (Shape(".claude/projects", ("*.meta.json",)),))
ROOT = ".project_root"
STORE = ".local/share/opencode/opencode.db"
_NO_LINES = "path string, after bigint, line bigint, value string"


@dataclass
class Due:
    """What a source reads: the home, all of its files, those that are due, and the lines of those that are read by lines."""

    spark: SparkSession
    home: str
    files: DataFrame
    due: DataFrame
    lines: DataFrame
    collected_at: str


def _messages(read: Due) -> Found:
    agents = discovery.listing(read.spark, read.home, SIDECARS)
    own = agents.join(read.due.select(F.regexp_replace("path", r"\.jsonl$", ".meta.json").alias("path")), "path", "left_semi")
    told = discovery.read_whole(own).select("path", F.from_json("value", "description string, agentType string").alias("d")).select("path", "d.*")
    events = message_log.parsed(read.lines)
    return Found(usage=message_log.usage(events, read.collected_at), turns=message_log.turns(events, read.collected_at), sessions=message_log.sessions(events, told), messages=message_log.messages(events))


def _threads(read: Due) -> Found:
    events = thread_log.parsed(read.lines)
    return Found(usage=thread_log.usage(events, read.collected_at), corrections=thread_log.corrections(events, read.collected_at), sessions=thread_log.sessions(events), messages=thread_log.messages(events))


def _chats(read: Due) -> Found:
    chats = chat_log.chats(discovery.read_whole(read.due))
    folders = read.due.select(F.regexp_extract("path", r"^(.*)/chats/[^/]*$", 1).alias("folder")).distinct()
    roots = discovery.heads(folders.select(F.concat("folder", F.lit(f"/{ROOT}")).alias("path"))).select(F.regexp_extract("path", chat_log.FOLDER, 1).alias("folder"), F.col("head").alias("project_dir"))
    return Found(usage=chat_log.chat_usage(chats, read.collected_at), sessions=chat_log.chat_sessions(chats, roots), messages=chat_log.chat_messages(chats))


def _updates(read: Due) -> Found:
    """Of three files of a session: calls from updates, messages from the history; a due file of either kind has its folder's session told anew."""
    named = lambda df, name: df.filter(F.substring_index("path", "/", -1) == name)
    folder = F.regexp_extract("path", chat_log.FOLDER, 1)
    touched = read.due.select(folder.alias("folder")).distinct()
    beside = lambda name: named(read.files, name).withColumn("folder", folder).join(touched, "folder", "left_semi").drop("folder")
    history = discovery.read_lines(beside("chat_history.jsonl").withColumn("read_to", F.lit(0).cast("bigint")))[0]
    sessions = chat_log.update_sessions(discovery.read_whole(beside("summary.json")), history)
    return Found(usage=chat_log.update_usage(named(read.lines, "updates.jsonl")), sessions=sessions, messages=chat_log.update_messages(named(read.lines, "chat_history.jsonl")))


#: What is done with the due files of each source.
FOLDS: dict[str, Callable[[Due], Found]] = {"claude": _messages, "codex": _threads, "gemini": _chats, "grok": _updates}


def found(spark: SparkSession, home: str, source: Source, progress: DataFrame, collected_at: str) -> Found:
    """What is new of a source below a home, with its cursors and the sessions that are there.

    Listing and lines are stored once, so that a file that grows meanwhile tells every fold the same.
    """
    files = discovery.listing(spark, home, source)
    due = scratch.stored(discovery.due(files, progress))
    by_lines = due.filter(F.col("gate") == LINES)
    lines, cursors = discovery.read_lines(by_lines)
    whole = due.filter(F.col("gate") == WHOLE).select(discovery.path_key("path").alias("path_key"), "modified", F.lit(0).cast("bigint").alias("line"))
    out = FOLDS[source.name](Due(spark, home, files, due, lines, collected_at))
    out.progress = cursors.unionByName(whole)
    out.seen = scratch.stored(discovery.seen_ids(files, source).select(F.lit(source.name).alias("source"), "id"))
    return out


def found_in_store(spark: SparkSession, path: str, progress: DataFrame, collected_at: str) -> Found:
    """What is new in the store of sessions of a database file; its cursors are kept by session, as milliseconds."""
    kept = progress.filter(F.col("path_key").startswith("opencode:")).select(F.substring("path_key", 10, 1 << 30).alias("session_id"), F.col("line").alias("watermark"))
    read = lambda name, schema: databases.table(spark, path, name, schema)
    sessions, messages, parts = read("session", database_log.SESSIONS), read("message", database_log.MESSAGES), read("part", database_log.PARTS)
    wanted = scratch.stored(database_log.due(sessions, messages, kept))
    own = scratch.stored(database_log.of_sessions(messages, wanted))
    rows = database_log.of_sessions(sessions, wanted, "id")
    cursors = database_log.advanced(wanted, own).select(F.concat(F.lit("opencode:"), "session_id").alias("path_key"), F.lit(None).cast("timestamp").alias("modified"), F.col("watermark").alias("line"))
    return Found(usage=database_log.usage(own, collected_at), sessions=database_log.sessions(rows), messages=database_log.messages(own, database_log.of_sessions(parts, wanted)), progress=cursors)


def together(parts: list[Found]) -> Found:
    """What several sources tell, as one."""
    out = Found()
    for field in fields(Found):
        rows = [r for p in parts if (r := getattr(p, field.name)) is not None]
        if rows:
            setattr(out, field.name, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows))
    return out


def collect(tables: Tables, home: str, rates: DataFrame, device_id: str, collected_at: str, sources: dict[str, Source] = SOURCES) -> State:
    """Collects all sources of a home in one commit; where one fails, nothing lands and the cursors stay where they were."""
    spark, progress = tables.spark, tables.read("progress")
    parts = [found(spark, home, source, progress, collected_at) for source in sources.values()]
    system, path = discovery.ranges.located(f"{home.rstrip('/')}/{STORE}")
    if system.get_file_info(path).is_file:
        parts.append(found_in_store(spark, path, progress, collected_at))
    return landing.land(tables, together(parts), rates, device_id, collected_at)


def ordered(rows: DataFrame) -> DataFrame:
    """Calls by (timestamp, uuid), messages by (ts, uuid), sessions by (last_active_at, id): the order in which results are given."""
    for key in (("timestamp", "uuid"), ("ts", "uuid"), ("last_active_at", "id")):
        if set(key) <= set(rows.columns):
            return rows.orderBy(*key)
    raise ValueError("rows are no calls, messages or sessions")
