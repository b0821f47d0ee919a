"""Exchange between devices through a shared folder: what a device writes of its store, and what it takes of others'.

Each device writes below its own id alone: calls and turns by day, snapshots of favourite sessions, its name, its groups
of sessions. Taking is by key, so it can be done again at any time; a device's own files are never taken back.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import landing, snapshots, store
from tallyforge.operators.store import SESSION_KEY, USAGE_KEY
from tallyforge.sources import discovery, scratch
from tallyforge.sources.tables import Changes, State, Tables

#: A document's version that we understand.
VERSION = 1
DEVICE_ID = "^[0-9a-f]{12}$"
NAME = "device_id string, display_name string, first_seen string"
GROUP = "id string, name string, updated_at string, position bigint"
LAST = (1 << 63) - 1


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _there(spark: SparkSession, name: str) -> bool:
    fs, path = _path(spark, name)
    return fs.exists(path)


def push(tables: Tables, folder: str, device_id: str) -> State:
    """Writes the marked days and sessions of a device as of now, then clears the marks of those that didn't change meanwhile.

    Sessions that are no favourites lose their snapshot. A day or session that got rows after they were counted keeps
    its mark for the next time.
    """
    state = tables.state()
    days, marked = (scratch.stored(t.filter(F.col("device_id") == device_id)) for t in landing.exported(tables, state))
    for name in ("usage", "turns"):
        store.export_days(tables.read(name, state), days.select("device_id", "day"), f"{folder}/{name}")
    sessions = tables.read("sessions", state)
    keys = marked.select(F.col("session_id").alias("id"), "device_id")
    chosen = scratch.stored(sessions.filter("favorited").join(keys, SESSION_KEY, "left_semi"))
    snapshots.write(chosen, tables.read("messages", state), f"{folder}/sessions")
    favorites = chosen.select(F.col("id").alias("session_id"), "device_id")
    removed = marked.select("device_id", "session_id").join(favorites, ["device_id", "session_id"], "left_anti")
    snapshots.remove(removed, f"{folder}/sessions")
    return landing.clear_marks(tables, days, marked.join(favorites, ["device_id", "session_id"], "left_semi"), removed)


def pull(tables: Tables, folder: str, self_device: str) -> State:
    """Takes, in one commit, calls and turns that aren't stored, other devices' sessions with their messages, and their favourites that went."""
    spark = tables.spark

    def artifacts(name: str) -> DataFrame:
        if not _there(spark, f"{folder}/{name}"):
            return spark.createDataFrame([], landing.SCHEMAS[name])
        return store.read_artifacts(spark, f"{folder}/{name}", landing.SCHEMAS[name]).filter(F.col("uuid").isNotNull())

    there = _there(spark, f"{folder}/sessions")

    def work(base: State) -> Changes:
        changes = Changes(add={name: store.landed(tables.read(name, base), artifacts(name), USAGE_KEY) for name in ("usage", "turns")})
        sessions, messages = tables.read("sessions", base), tables.read("messages", base)
        if there:
            found, said = snapshots.read(spark, f"{folder}/sessions", self_device)
            new = found
        else:
            new, said = sessions.limit(0), messages.limit(0)
        gone = scratch.stored(snapshots.vanished(sessions, new, self_device))
        left, kept = store.unfavorited(store.upserted_sessions(sessions, new, with_favorites=True), messages, gone)
        changes.replace["sessions"] = left
        if gone.isEmpty():
            changes.add["messages"] = store.landed(messages, said, landing.MESSAGE_KEY)
        else:
            changes.replace["messages"] = kept.unionByName(store.landed(kept, said, landing.MESSAGE_KEY))
        return changes

    return tables.changed(work)


def write_name(spark: SparkSession, folder: str, device_id: str, display_name: str, first_seen: str) -> bool:
    """Writes a device's name if it isn't written so already; whether it was written."""
    fs, path = _path(spark, f"{folder}/config/devices_{device_id}.json")
    text = json.dumps({"device_id": device_id, "display_name": display_name, "first_seen": first_seen}, indent=2) + "\n"
    if fs.exists(path) and spark.read.text(path.toString(), wholetext=True).first()[0] == text:
        return False
    out = fs.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _documents(spark: SparkSession, folder: str, shapes: tuple[discovery.Shape, ...], schema: str) -> DataFrame:
    """(path, d) of the JSON documents of some shapes; those that can't be read are left out."""
    files = discovery.listing(spark, folder, discovery.Source("documents", shapes))
    return discovery.read_whole(files).select("path", F.from_json("value", schema).alias("d")).filter("d IS NOT NULL")


def names(spark: SparkSession, folder: str) -> DataFrame:
    """(device_id, display_name, first_seen) of all devices: files of both layouts, of two with one id that of the flat layout."""
    shapes = (discovery.Shape("config", ("devices_*.json",), 1), discovery.Shape("config/devices", ("*.json",), 1))
    read = _documents(spark, folder, shapes, NAME)
    own = F.regexp_extract("path", r"(?:/devices_|/)([^/]*)\.json$", 1)
    flat = F.substring_index("path", "/", -1).startswith("devices_")
    rows = read.filter(own.rlike(DEVICE_ID) & F.col("d.device_id").isNotNull()).select("d.*", flat.alias("flat"), "path")
    best = rows.groupBy("device_id").agg(F.max_by(F.struct("display_name", "first_seen"), F.struct("flat", "path")).alias("r"))
    return best.select("device_id", "r.*")


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of sessions of all devices: of one id the newest, of equally new ones the first device's; in the users' order (``place``)."""
    read = _documents(spark, folder, (discovery.Shape("data", ("groups.json",), 2),), f"v bigint, groups array<struct<{', '.join(f.replace(' ', ':') for f in GROUP.split(', ')) }>>")
    rows = read.filter(F.coalesce("d.v", F.lit(VERSION)) <= VERSION).select(F.element_at(F.split("path", "/"), -2).alias("device_id"), F.explode("d.groups").alias("g"))
    known = rows.filter(F.col("device_id").rlike(DEVICE_ID)).select("device_id", "g.*")
    newest = known.groupBy("id").agg(F.max("updated_at").alias("updated_at"))
    first = known.join(newest, ["id", "updated_at"]).groupBy("id", "updated_at").agg(F.min_by(F.struct("name", F.coalesce("position", F.lit(LAST)).alias("position"), "device_id"), "device_id").alias("r"))
    return first.select("id", "updated_at", "r.*")
