"""Queries over writes to the store: upserts, what users set, deletions, prices, devices and ordered lists, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators import snapshots, store
from tallyforge.plans.log_catalog import STAMP
from tallyforge.sources import adapters as a

def _n():
    """The user that a session is made of."""
    return F.substring("id", 2, 20).cast("bigint")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as stored; every fourth user has given a title."""
    stamp = lambda c: F.date_format(c, STAMP).alias(c)
    return a.sessions(spark, sf_dir).select(
        "id", "device_id", "source", "project_dir", F.col("title").alias("title_orig"), stamp("started_at"), stamp("last_active_at"), F.lit("").alias("agent_type"), "parent_session_id",
        F.when(_n() % 4 == 0, F.concat(F.lit("Mine "), "id")).otherwise("").alias("custom_title"), "favorited", F.lit("").alias("synced_group_id"), F.col("local_group").alias("local_group_id"), "excluded",
    )


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as collected again: even users', with other titles, as favourites."""
    return _sessions(spark, sf_dir).filter(_n() % 2 == 0).withColumns({"title_orig": F.concat(F.lit("New "), "id"), "favorited": F.lit(True), "synced_group_id": F.lit("y")})


def _upserted(with_favorites: bool):
    def run(s, d):
        out = store.upserted_sessions(_sessions(s, d).filter(_n() % 3 != 0), _collected(s, d), with_favorites)
        return out.select("id", "device_id", "title_orig", "custom_title", "favorited", "synced_group_id", "local_group_id")

    return run


def _set_by_users(s, d):
    own = _sessions(s, d)
    setting = lambda rows, column, value, at: rows.select("id", "device_id", F.lit(column).alias("column"), value.alias("value"), F.lit(at).alias("updated_at"))
    even, third = own.filter(_n() % 2 == 0), own.filter(_n() % 3 == 0)
    overlay = setting(even, "custom_title", F.concat(F.lit("First "), "id"), "1").unionByName(setting(even, "custom_title", F.concat(F.lit("Then "), "id"), "2")).unionByName(setting(third, "favorited", F.lit("true"), "1"))
    return store.user_columns(own, overlay).select("id", "device_id", "custom_title", "favorited", "local_group_id")


def _messages(s, d):
    return a.messages(s, d).select("session_id", "device_id", "uuid")


def _counted(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions, with whether they are favourites, and messages by session, as rows of two kinds."""
    held = sessions.select(F.lit("session").alias("kind"), "id", "device_id", F.col("favorited").cast("bigint").alias("n"))
    return held.unionByName(messages.groupBy(F.col("session_id").alias("id"), "device_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("messages")))


def _reconciled(s, d):
    own = _sessions(s, d)
    return _counted(*store.reconciled(own, _messages(s, d), own.filter(_n() % 2 == 0), "claude", "d0"))


def _unfavorited(s, d):
    own = _sessions(s, d)
    return _counted(*store.unfavorited(own, _messages(s, d), own.filter(_n() % 5 == 0)))


def _repriced(s, d):
    part = a.read(s, d, "part").select(F.col("p_brand").alias("model_key"), F.col("p_size").cast("bigint").alias("input_rate"))
    rates = part.groupBy("model_key").agg(F.max("input_rate").alias("input_rate"))
    return store.repriced(rates, part.filter("input_rate BETWEEN 20 AND 25"), part.filter("model_key LIKE '%1' AND input_rate = 3"))


def _customers(s, d):
    return a.read(s, d, "customer").select(F.lpad(F.hex("c_custkey"), 12, "0").alias("device_id"), "c_custkey", "c_name", "c_mktsegment")


def _backed(s, d):
    devices = _customers(s, d).select("device_id", (F.col("c_custkey") % 100 == 0).alias("is_self"))
    return store.backed(devices, a.read(s, d, "orders").filter("o_orderstatus = 'P'").select(F.lpad(F.hex("o_custkey"), 12, "0").alias("device_id")))


def _names(s, d):
    own = _customers(s, d)
    aliases = own.filter("c_custkey % 4 = 0").select("device_id", F.when(F.col("c_custkey") % 8 == 0, "  ").otherwise(F.col("c_name")).alias("display_name"))
    return store.device_names(own, aliases, own.filter("c_custkey % 3 = 0").select("device_id", F.col("c_mktsegment").alias("display_name")))


def _transcript(s, d):
    """Messages with their place in their session's order, by time and id."""
    place = F.row_number().over(Window.partitionBy("session_id", "device_id").orderBy("ts", "uuid"))
    return a.messages(s, d).select("session_id", "device_id", "uuid", place.alias("place"))


_SESSIONS = a.with_sql("sessions messages") + """, own AS (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM sessions)"""


def _upsert_sql(favorited: str, group: str) -> str:
    return f"""{_SESSIONS}, old AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'Mine ' || id ELSE '' END AS custom FROM own WHERE n % 3 <> 0), new AS (SELECT * FROM own WHERE n % 2 = 0)
SELECT coalesce(new.id, old.id) AS id, coalesce(new.device_id, old.device_id) AS device_id, CASE WHEN new.id IS NOT NULL THEN 'New ' || new.id ELSE old.title END AS title_orig, coalesce(old.custom, '') AS custom_title, {favorited} AS favorited, {group} AS synced_group_id, coalesce(old.local_group, '') AS local_group_id
FROM old FULL JOIN new ON old.id = new.id AND old.device_id = new.device_id"""


def _kinds(gone_session: str, favorited: str, gone_message: str) -> str:
    return f"""{_SESSIONS} SELECT 'session' AS kind, id, device_id, CAST({favorited} AS BIGINT) AS n FROM own WHERE NOT ({gone_session})
UNION ALL SELECT 'messages', session_id, device_id, count(*) FROM messages m WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.id = m.session_id AND own.device_id = m.device_id AND {gone_message}) GROUP BY ALL"""


_ID = "lpad(upper(to_hex(c_custkey)), 12, '0')"

#: Name: (query, SQL).
CATALOG = {
    "U6_upserted": (_upserted(False), _upsert_sql("coalesce(old.favorited, false)", "''")),
    "U7_imported": (_upserted(True), _upsert_sql("new.id IS NOT NULL OR coalesce(old.favorited, false)", "CASE WHEN new.id IS NOT NULL THEN 'y' ELSE '' END")),
    "U8_set_by_users": (_set_by_users, f"{_SESSIONS} SELECT id, device_id, CASE WHEN n % 2 = 0 THEN 'Then ' || id ELSE '' END AS custom_title, favorited OR n % 3 = 0 AS favorited, local_group AS local_group_id FROM own"),
    "U9_reconciled": (_reconciled, _kinds("source = 'claude' AND device_id = 'd0' AND n % 2 = 1", "favorited", "source = 'claude' AND own.device_id = 'd0' AND n % 2 = 1")),
    "U11_unfavorited": (_unfavorited, _kinds("false", "favorited AND n % 5 <> 0", "n % 5 = 0")),
    "U12_repriced": (
        _repriced,
        """WITH r AS (SELECT p_brand AS model_key, CAST(coalesce(min(p_size) FILTER (p_size BETWEEN 20 AND 25), max(p_size)) AS BIGINT) AS input_rate, bool_or(p_size = 3) AS three FROM part GROUP BY 1)
        SELECT model_key, input_rate FROM r WHERE NOT (model_key LIKE '%1' AND three)""",
    ),
    "U15_backed": (_backed, f"SELECT {_ID} AS device_id, c_custkey % 100 = 0 AS is_self FROM customer WHERE c_custkey % 100 = 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "J15_names": (_names, f"SELECT {_ID} AS device_id, CASE WHEN c_custkey % 8 = 4 THEN c_name WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'Device-' || substr({_ID}, 1, 6) END AS name FROM customer"),
    "A18_peers": (lambda s, d: snapshots.peers(_sessions(s, d), "d1"), f"{_SESSIONS} SELECT DISTINCT device_id FROM own WHERE favorited AND device_id <> 'd1'"),
    "J17_vanished": (lambda s, d: snapshots.vanished(_sessions(s, d), _sessions(s, d).filter(_n() % 10 == 0), "d1"), f"{_SESSIONS} SELECT id, device_id FROM own WHERE favorited AND device_id <> 'd1' AND n % 10 <> 0"),
    "W5_transcript": (_transcript, f"{_SESSIONS} SELECT session_id, device_id, uuid, CAST(row_number() OVER (PARTITION BY session_id, device_id ORDER BY ts, uuid) AS INTEGER) AS place FROM messages"),
}
