"""Queries over files that come and go: gated reading, heads, and the exchange of two devices' stores with a third, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import exchange, landing, pricing, thread_log
from tallyforge.operators.landing import Found
from tallyforge.operators.pricing import units
from tallyforge.plans import log_catalog as logs, stream_catalog as streams
from tallyforge.sources import adapters as a, discovery, scratch

A, B, C = "00000000000a", "00000000000b", "00000000000c"
_NO_CURSORS = "path_key string, modified timestamp, line bigint"


def _home(spark: SparkSession, rows: DataFrame, upto: int, home: str) -> None:
    streams.grown(rows.withColumn("path", F.concat(F.lit(".codex/sessions/2024/01/"), F.substring_index("path", "/", -1))), home, upto)


def due_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of thread logs that were read before, when those of even users were written again since with more lines."""
    home, source = scratch.folder(spark), discovery.SOURCES["codex"]
    rows = streams.thread_files(spark, sf_dir).persist()
    _home(spark, rows, 1, home)
    first = discovery.due(discovery.listing(spark, home, source), spark.createDataFrame([], _NO_CURSORS))
    cursors = scratch.stored(discovery.read_lines(first)[1])
    _home(spark, rows.filter(F.regexp_extract("path", r"(\d+)\.jsonl", 1).cast("bigint") % 2 == 0), 2, home)
    rows.unpersist()
    due = scratch.stored(discovery.due(discovery.listing(spark, home, source), cursors))
    lines, now = discovery.read_lines(due)
    new = lines.filter("line > after").groupBy("path").agg(F.count("*").alias("new_lines"))
    own = due.join(new, "path", "left").withColumn("path_key", discovery.path_key("path")).join(now.select("path_key", "line"), "path_key")
    return own.select(F.substring_index("path", "/", -1).alias("file"), F.col("read_to").alias("read_before"), F.coalesce("new_lines", F.lit(0)).alias("new_lines"), F.col("line").alias("read_now"))


def due_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of the same second reading, folded over whole files and given after the cursors alone."""
    home, source = scratch.folder(spark), discovery.SOURCES["codex"]
    rows = streams.thread_files(spark, sf_dir).persist()
    _home(spark, rows, 1, home)
    first = discovery.due(discovery.listing(spark, home, source), spark.createDataFrame([], _NO_CURSORS))
    cursors = scratch.stored(discovery.read_lines(first)[1])
    _home(spark, rows.filter(F.regexp_extract("path", r"(\d+)\.jsonl", 1).cast("bigint") % 2 == 0), 2, home)
    rows.unpersist()
    lines = discovery.read_lines(discovery.due(discovery.listing(spark, home, source), cursors))[0]
    return thread_log.usage(thread_log.parsed(lines), "now").select("uuid", "model", "session_id", *streams.landing_tokens())


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that the heads of thread logs tell."""
    home = scratch.folder(spark)
    _home(spark, streams.thread_files(spark, sf_dir), 2, home)
    return discovery.seen_ids(discovery.listing(spark, home, discovery.SOURCES["codex"]), discovery.SOURCES["codex"])


def _calls(spark, sf_dir):
    return a.usage(spark, sf_dir).select("uuid", F.date_format("ts", logs.STAMP).alias("timestamp"), "model", "source", "session_id", *streams.landing_tokens(), F.col("device_id").alias("from_device"))


def _sessions(spark, sf_dir):
    stamp = lambda c: F.date_format(c, logs.STAMP).alias(c)
    return a.sessions(spark, sf_dir).select("id", F.col("device_id").alias("from_device"), "source", "project_dir", F.col("title").alias("title_orig"), stamp("started_at"), stamp("last_active_at"), F.lit("").alias("agent_type"), "parent_session_id", "favorited")


def _messages(spark, sf_dir):
    return a.messages(spark, sf_dir).filter("device_id <> 'd9'").select("session_id", F.col("device_id").alias("from_device"), "uuid", "role", F.lpad(F.col("ts").cast("string"), 8, "0").alias("ts"), F.lit("").alias("model"), F.lit("").alias("name"), "content")


def _landed(spark, sf_dir, root: str, device: str, own) -> landing.Tables:
    """A device's store with the calls, sessions and messages of some devices of the test view; favourites are set."""
    tables = landing.store(spark, root)
    chosen = lambda df: df.filter(own(F.col("from_device"))).drop("from_device")
    sessions = chosen(_sessions(spark, sf_dir))
    landing.land(tables, Found(usage=chosen(_calls(spark, sf_dir)), sessions=sessions.drop("favorited"), messages=chosen(_messages(spark, sf_dir))), pricing.seed(spark), device)
    favorites = sessions.filter("favorited").select("id", F.lit(True).alias("hit"))
    tables.changed(lambda base: landing.Changes(replace={"sessions": tables.read("sessions", base).join(favorites, "id", "left").withColumn("favorited", F.coalesce("hit", "favorited")).drop("hit")}))
    return tables


def exchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a third device has of two others' stores, and the marks that these have left, after each has pushed and the third has pulled twice.

    Between the pulls the first device drops favourites: sessions of users divisible by 10 are none any more.
    """
    top = scratch.folder(spark)
    folder = f"{top}/shared"
    own = {A: lambda c: c == "d0", B: lambda c: c != "d0"}
    stores = {device: _landed(spark, sf_dir, f"{top}/{device}", device, chosen) for device, chosen in own.items()}
    third = landing.store(spark, f"{top}/{C}")
    for device, tables in stores.items():
        exchange.push(tables, folder, device)
    exchange.pull(third, folder, C)
    first = stores[A]
    dropped = F.col("id").endswith("0")

    def drop(base):
        sessions = first.read("sessions", base)
        marks = sessions.filter(dropped & F.col("favorited")).select("device_id", F.col("id").alias("session_id"))
        return landing.Changes(replace={"sessions": sessions.withColumn("favorited", F.col("favorited") & ~dropped), "dirty_sessions": first.read("dirty_sessions", base).unionByName(marks).distinct()})

    first.changed(drop)
    exchange.push(first, folder, A)
    state = exchange.pull(third, folder, C)
    calls = third.read("usage", state).groupBy("device_id", F.col("day").alias("key")).agg(F.count("*").alias("n"), units(F.sum("cost")).alias("units"))
    sessions = third.read("sessions", state).select("device_id", F.col("id").alias("key"), F.col("favorited").cast("bigint").alias("n"), F.length("title_orig").cast("bigint").alias("units"))
    messages = third.read("messages", state).groupBy("device_id", F.col("session_id").alias("key")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("units"))
    out = calls.withColumn("kind", F.lit("calls")).unionByName(sessions.withColumn("kind", F.lit("session"))).unionByName(messages.withColumn("kind", F.lit("messages")))
    for tables in stores.values():
        for name in ("dirty_days", "dirty_sessions"):
            key = "day" if name == "dirty_days" else "session_id"
            out = out.unionByName(tables.read(name).select("device_id", F.col(key).alias("key"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("units"), F.lit(name).alias("kind")))
    return out


_FILES = f"WITH ev AS (SELECT *, {streams._STEP} AS step FROM events), f AS (SELECT user_id, count(*) FILTER (step <= 1) AS early, count(*) AS every, min(step) AS started FROM ev WHERE user_id % 2 = 0 GROUP BY user_id)"
_DEVICE = f"CASE device_id WHEN 'd0' THEN '{A}' ELSE '{B}' END"
_PRICE = "CASE model WHEN 'click' THEN input * 300 + output * 1500 + cache_creation * 375 + cache_read * 30 ELSE 0 END"

#: Name: (query, SQL). A file's first line says who it is, so it has one line more than events.
CATALOG = {
    "G1_due_lines": (
        due_lines,
        f"{_FILES} SELECT 'rollout-' || user_id || '.jsonl' AS file, CASE WHEN started <= 1 THEN early + 1 ELSE 0 END AS read_before, every - early + CASE WHEN started <= 1 THEN 0 ELSE 1 END AS new_lines, every + 1 AS read_now FROM f",
    ),
    "G2_due_calls": (
        due_calls,
        f"""{streams._THREADS}, own_start AS (SELECT user_id, min(step) AS started FROM ev GROUP BY user_id)
         SELECT 'codex:thread-v1:th' || user_id || ':' || idx AS uuid, coalesce(known, first, 'unknown') AS model, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'th' || user_id END AS session_id, i - least(c, i) AS input, o AS output, CAST(0 AS BIGINT) AS cache_creation, least(c, i) AS cache_read
         FROM n JOIN own_start USING (user_id) WHERE user_id % 2 = 0 AND (step = 2 OR started > 1) AND (user_id % 5 <> 0 OR over IS NULL OR event_id >= over)""",
    ),
    "G10_seen": (seen, "SELECT DISTINCT 'th' || user_id AS id FROM events"),
    "K7_exchanged": (
        exchanged,
        a.with_sql("usage sessions messages") + f""", fav AS (SELECT id, device_id, title, id LIKE '%0' AND device_id = 'd0' AS dropped FROM sessions WHERE favorited),
         said AS (SELECT DISTINCT session_id, device_id FROM messages WHERE device_id <> 'd9')
        SELECT {_DEVICE} AS device_id, day AS key, count(*) AS n, CAST(sum({_PRICE}) AS BIGINT) * 100 AS units, 'calls' AS kind FROM usage GROUP BY ALL
        UNION ALL SELECT CASE fav.device_id WHEN 'd0' THEN '{A}' ELSE '{B}' END, id, CASE WHEN dropped THEN 0 ELSE 1 END, length(title), 'session' FROM fav JOIN said ON said.session_id = id AND said.device_id = fav.device_id
        UNION ALL SELECT CASE m.device_id WHEN 'd0' THEN '{A}' ELSE '{B}' END, m.session_id, count(*), CAST(sum(length(content)) AS BIGINT), 'messages' FROM messages m JOIN fav ON fav.id = m.session_id AND fav.device_id = m.device_id AND NOT dropped GROUP BY ALL""",
    ),
}
