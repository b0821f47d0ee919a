"""Logs of threads with cumulative token counters: calls as differences, models carried forward, replays of forked threads.

All functions take ``parsed(lines)``. Order-dependent rules are window functions over one file's lines; a file is
one thread, whose lines a task sorts and may spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expr import TITLE_LIMIT, basename, fresh_input, model_key, truncated
from tallyforge.sources.logs import stem

SOURCE = "codex"
COUNTERS = "struct<input_tokens: bigint, cached_input_tokens: bigint, cache_read_input_tokens: bigint, output_tokens: bigint>"
EVENT = f"""type string, timestamp string, payload struct<type: string, id: string, thread_id: string, threadId: string, session_id: string, sessionId: string,
 forked_from_id: string, cwd: string, source: string, model: string, role: string, content: string, name: string, arguments: string, call_id: string,
 info: struct<model: string, model_name: string, total_token_usage: {COUNTERS}, last_token_usage: {COUNTERS}>>"""
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: How an editor's wrapper starts, and the last of its headings with what follows it in the line or after.
WRAPPED = "# Context from my IDE setup:"
REQUEST = r"(?is)\A.*\n[ \t]*#+[ \t]*my request for codex[ \t]*(?:[:：—-][ \t:：—-]*([^\n]*))?(?:\n(.*))?\z"
#: Starts of user texts that are no request.
NO_REQUEST = ("# AGENTS.md", "<environment_context>")
INPUT_LIMIT = 1024
KNOWN = ("session_meta", "turn_context", "event_msg", "response_item")


def _identity() -> tuple[Column, Column, Column, Column]:
    """Of an event: whether it tells its thread, the thread's id, whether it is forked, whether it takes over."""
    p = lambda name: F.col(f"payload.{name}")
    thread = F.coalesce(p("id"), p("thread_id"), p("threadId"), p("session_id"), p("sessionId"))
    session = F.coalesce(p("session_id"), p("sessionId"))
    fork = (F.coalesce(p("forked_from_id"), F.lit("")) != "") | F.get_json_object(p("source"), "$.subagent").isNotNull() | F.coalesce(session != thread, F.lit(False))
    takeover = F.col("type").startswith("inter_agent_communication") | ((F.col("type") == "event_msg") & (p("type") == "thread_settings_applied"))
    return (F.col("type") == "session_meta") & thread.isNotNull(), thread, fork, takeover


def _counters() -> tuple[Column, Column, Column]:
    """Of an event: the model that it tells, its total counters and its single ones, as far as it has any."""
    info = F.col("payload.info")
    is_count = (F.col("type") == "event_msg") & (F.col("payload.type") == "token_count") & info.isNotNull()
    told = F.when(F.col("type") == "turn_context", F.coalesce(F.col("payload.model"), info["model"])).when(is_count, F.coalesce(info["model"], info["model_name"], F.col("payload.model")))
    counters = lambda c: F.when(is_count & c.isNotNull(), F.struct(F.coalesce(c["input_tokens"], F.lit(0)).alias("i"), F.coalesce(c["cached_input_tokens"], c["cache_read_input_tokens"], F.lit(0)).alias("c"), F.coalesce(c["output_tokens"], F.lit(0)).alias("o")))
    return model_key(told), counters(info["total_token_usage"]), counters(info["last_token_usage"])


def steps(lines: DataFrame) -> DataFrame:
    """What each line tells on its own, for folds that hold a thread's state: identity, takeover, model, counters."""
    events = lines.withColumn("e", F.from_json("value", EVENT)).select(*lines.columns, "e.*").filter("type IS NOT NULL")
    meta, thread, fork, takeover = _identity()
    told, total, single = _counters()
    rows = events.select(*(c for c in lines.columns if c != "value"), F.coalesce(meta, F.lit(False)).alias("meta"), thread.alias("thread"), fork.alias("fork"), F.coalesce(takeover, F.lit(False)).alias("takeover"), told.alias("told"), total.isNotNull().alias("total"), F.coalesce(total, single).alias("n"), F.col("timestamp").alias("stamp"))
    counts = [F.coalesce(F.col(f"n.{k}"), F.lit(0)).alias(k) for k in "ico"]
    return rows.select(*(c for c in rows.columns if c != "n"), F.col("n").isNotNull().alias("counted"), *counts).filter("meta OR takeover OR told IS NOT NULL OR counted")


def parsed(lines: DataFrame) -> DataFrame:
    """Events of the known types and those that mark a takeover, with what the whole file tells about its thread.

    thread_id and is_fork come from the first session_meta with an id; boundary is the line where a forked thread
    starts on its own; a thread that isn't forked has none. told, total and single are a line's model and counters:
    folds that need no more shuffle and sort these alone, once, in the order of the lines.
    """
    rows = lines.select("path", "after", "line", F.from_json("value", EVENT).alias("e")).select("path", "after", "line", "e.*").filter("type IS NOT NULL")
    meta, thread, fork, takeover = _identity()
    meta = F.when(meta, F.col("line"))
    file = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told, total, single = _counters()
    rows = rows.withColumns({"told": told, "total": total, "single": single, "_meta": meta, "_thread": thread, "_fork": fork, "_over": F.when(takeover, F.col("line"))})
    rows = rows.withColumns({"thread_id": F.min_by("_thread", "_meta").over(file), "is_fork": F.coalesce(F.min_by("_fork", "_meta").over(file), F.lit(False)), "boundary": F.min("_over").over(file)})
    return rows.withColumn("boundary", F.when(F.col("is_fork"), F.col("boundary"))).drop("_meta", "_thread", "_fork", "_over")


def session_id(path: Column, thread_id: Column) -> Column:
    """The thread's id, else a UUID at the end of the file's name, else the name."""
    name = stem(path)
    return F.coalesce(F.nullif(thread_id, F.lit("")), F.nullif(F.regexp_extract(name, f"({UUID})$", 1), F.lit("")), name)


def _calls(events: DataFrame, collected_at: str) -> DataFrame:
    """Calls of all lines, with the model that is known at their line and the first that the file tells."""
    rows = events.select("path", "after", "line", "timestamp", "told", "total", "single", "thread_id", "is_fork", "boundary")
    ordered = Window.partitionBy("path").orderBy("line")
    before, upto, whole = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"known": F.last("told", True).over(upto), "first": F.first("told", True).over(whole), "prev": F.last("total", True).over(before)})
    step = lambda k: F.when(F.col("total").isNull(), F.col("single")[k]).otherwise(F.greatest(F.col("total")[k] - F.coalesce(F.col("prev")[k], F.lit(0)), F.lit(0)))
    rows = rows.filter("total IS NOT NULL OR single IS NOT NULL").withColumns({k: step(k) for k in "ico"})
    rows = rows.filter("i > 0 OR o > 0")  # what was cached is part of the input
    rows = rows.withColumn("event_index", F.row_number().over(ordered)).filter("boundary IS NULL OR line >= boundary")
    fresh, cached = fresh_input(F.col("i"), F.col("c"))
    return rows.select(
        "line", "after", "known", "first",
        F.concat_ws(":", F.lit("codex:thread-v1"), F.coalesce("thread_id", F.lit("unknown")), F.col("event_index")).alias("uuid"),
        F.coalesce("timestamp", F.lit(collected_at)).alias("timestamp"), F.coalesce("known", "first", F.lit("unknown")).alias("model"), F.lit(SOURCE).alias("source"),
        F.when(F.col("is_fork"), "").otherwise(session_id(F.col("path"), F.col("thread_id"))).alias("session_id"),
        fresh.alias("input"), F.col("o").alias("output"), F.lit(0).cast("bigint").alias("cache_creation"), cached.alias("cache_read"),
    )


def usage(events: DataFrame, collected_at: str = "") -> DataFrame:
    """One row for each call after the cursor: what the counters rose by since the last total, where that isn't nothing."""
    return _calls(events, collected_at).filter("line > after").drop("line", "after", "known", "first")


def corrections(events: DataFrame, collected_at: str = "") -> DataFrame:
    """Calls from before the cursor whose model wasn't known at their line and is now."""
    return _calls(events, collected_at).filter("line <= after AND known IS NULL AND first IS NOT NULL").drop("line", "after", "known", "first")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _text(content: Column) -> Column:
    """The texts of a content (a text, or a list of items with texts), joined by line breaks."""
    items = F.from_json(content, "array<struct<text: string, input_text: string, output_text: string>>")
    texts = F.transform(items, lambda i: F.coalesce(i["text"], i["input_text"], i["output_text"]))
    return F.when(F.ltrim(content).startswith("["), F.array_join(F.filter(texts, lambda t: F.trim(t) != ""), "\n")).otherwise(content)


def title_candidate(text: Column) -> Column:
    """What of a user's text can be a title: an editor's wrapper gives what its last request heading asks; instructions give nothing."""
    body = F.replace(_trimmed(text), F.lit("\r\n"), F.lit("\n"))
    asked = F.coalesce(*(F.nullif(_trimmed(F.regexp_extract(body, REQUEST, k)), F.lit("")) for k in (1, 2)))
    no_request = body.startswith(NO_REQUEST[0]) | body.startswith(NO_REQUEST[1]) | (body == "")
    return F.when(body.startswith(WRAPPED), asked).when(~no_request, body)


def sessions(events: DataFrame) -> DataFrame:
    """One row for each thread that isn't forked."""
    said = F.when((F.col("type") == "response_item") & (F.col("payload.type") == "message") & (F.col("payload.role") == "user"), title_candidate(_text(F.col("payload.content"))))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line")))
    stamp = F.nullif("timestamp", F.lit(""))
    cwd = F.when(F.col("type") == "session_meta", F.nullif("payload.cwd", F.lit("")))
    read = events.filter(F.col("type").isin(*KNOWN) & ~F.col("is_fork") & ((F.col("type") != "event_msg") | (F.col("payload.type") == "token_count")))
    told = read.groupBy("path", "thread_id").agg(F.coalesce(F.min_by("timestamp", "line"), F.lit("")).alias("started_at"), F.coalesce(F.max_by(stamp, F.when(stamp.isNotNull(), F.col("line"))), F.lit("")).alias("last_active_at"), F.coalesce(first(cwd), F.lit("")).alias("project_dir"), first(said).alias("said"))
    return told.select(session_id(F.col("path"), F.col("thread_id")).alias("id"), F.lit(SOURCE).alias("source"), "project_dir", truncated(F.coalesce("said", basename(F.col("project_dir"))), TITLE_LIMIT).alias("title_orig"), "started_at", "last_active_at", F.lit("").alias("agent_type"), F.lit("").alias("parent_session_id"))


def messages(events: DataFrame) -> DataFrame:
    """Transcript messages of threads that aren't forked: users' and assistants' texts and function calls."""
    rows = events.filter("type = 'response_item' AND line > after AND NOT is_fork AND (payload.type = 'function_call' OR (payload.type = 'message' AND payload.role IN ('user', 'assistant')))")
    is_call = F.col("payload.type") == "function_call"
    content = F.when(is_call, truncated(F.coalesce("payload.arguments", F.lit("")), INPUT_LIMIT)).otherwise(truncated(_text(F.col("payload.content"))))
    out = rows.select(F.coalesce(F.nullif("payload.id", F.lit("")), F.concat(session_id(F.col("path"), F.col("thread_id")), F.lit(":L"), F.col("line"))).alias("uuid"), session_id(F.col("path"), F.col("thread_id")).alias("session_id"), F.coalesce("timestamp", F.lit("")).alias("ts"), F.when(is_call, "tool").otherwise(F.col("payload.role")).alias("role"), F.when(is_call, F.coalesce("payload.name", F.lit("tool"))).alias("name"), content.alias("content"))
    return out.filter("role = 'tool' OR content <> ''")


def identity_of_head(head: Column) -> Column:
    """The thread's id that the first whole lines of a file tell, null if none does."""
    meta = "struct<type: string, payload: struct<id: string, thread_id: string, threadId: string, session_id: string, sessionId: string>>"
    told = F.transform(F.split(head, "\n"), lambda line: F.from_json(line, meta))
    ids = F.transform(F.filter(told, lambda e: e["type"] == "session_meta"), lambda e: F.coalesce(*(e["payload"][n] for n in ("id", "thread_id", "threadId", "session_id", "sessionId"))))
    return F.try_element_at(F.filter(ids, lambda i: i.isNotNull()), F.lit(1))
