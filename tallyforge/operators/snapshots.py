"""Snapshots of sessions: files of tagged lines, the session first and then its messages, exchanged between devices.

A file is one session of one device. Lines say what they are; a file whose version is newer than ours is left out
whole, as is one without a session line. Lines that can't be read are left out alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.store import SESSION_KEY
from tallyforge.sources import discovery, ranges, scratch

VERSION = 1
#: Fields of a session's line and of a message's; those in brackets of the second list may be absent.
SESSION = ("id", "source", "project_dir", "title_orig", "started_at", "last_active_at", "agent_type", "parent_session_id", "favorited", "synced_group_id")
MESSAGE, OPTIONAL = ("session_id", "uuid", "role", "ts", "content"), ("model", "name", "agent_type", "parent_session_id")
LINE = """type string, v bigint, id string, source string, project_dir string, title_orig string, started_at string, last_active_at string, agent_type string, parent_session_id string,
 favorited boolean, synced_group_id string, session_id string, uuid string, role string, ts string, model string, name string, content string"""
#: A device's id in a path: a folder of its own, plain or as a partition.
DEVICE = r"/(?:device_id=)?([0-9a-f]{12})/"
#: A snapshot's name in its session's folder, and the characters that such a folder's name has in hexadecimal, as partitions' folders do.
NAME = "snapshot.txt"
_ESCAPED = {c: f"%{c:02X}" for c in (*range(1, 32), *map(ord, "\"#%'*/:=?\\{[]^"), 127)}


def lines(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(device_id, id, place, ts, uuid, value) of the snapshot lines of sessions; ``place``, ``ts`` and ``uuid`` order them."""
    null = F.lit(None).cast("string")
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.lit(VERSION).alias("v"), *SESSION))
    first = sessions.select(*SESSION_KEY[::-1], F.lit(0).alias("place"), null.alias("ts"), null.alias("uuid"), head.alias("value"))
    body = F.to_json(F.struct(F.lit("message").alias("type"), *MESSAGE[:4], F.nullif("model", F.lit("")).alias("model"), F.nullif("name", F.lit("")).alias("name"), "content"))
    own = messages.join(sessions.select(F.col("id").alias("session_id"), "device_id"), ["session_id", "device_id"], "left_semi")
    rest = own.select("device_id", F.col("session_id").alias("id"), F.lit(1).alias("place"), "ts", "uuid", body.alias("value"))
    return first.unionByName(rest)


def _own(device_id: str, session_id: str) -> str:
    """The folder of a session's snapshot, below that of all."""
    return "/".join(f"{k}={(v or '__HIVE_DEFAULT_PARTITION__').translate(_ESCAPED)}" for k, v in (("device_id", device_id), ("id", session_id)))


def write(sessions: DataFrame, messages: DataFrame, folder: str) -> None:
    """Writes the snapshots of sessions in place of older ones of theirs; others stay. The same rows give the same files.

    Tasks write the files and put them in place one by one, so the driver has none to move; a task that runs again changes nothing.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        system, top = ranges.located(folder)
        key, out, done, held = None, None, 0, bytearray()

        def closed():
            if out is not None:
                out.write(bytes(held))
                held.clear()
                out.close()
                system.move(temporary, f"{own}/{NAME}")
                for info in system.get_file_info(fs.FileSelector(own)):
                    if info.base_name != NAME and info.extension == "txt":  # written before snapshots had one name
                        system.delete_file(info.path)

        for batch in batches:
            for *now, value in zip(*(batch.column(c).to_pylist() for c in ("device_id", "id", "value"))):
                if now != key:
                    closed()
                    key, own = now, f"{top}/{_own(*now)}"
                    system.create_dir(own)
                    temporary = f"{own}/{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                    done += 1
                held += value.encode() + b"\n"
                if len(held) > ranges.BLOCK:
                    out.write(bytes(held))
                    held.clear()
        closed()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    key = ["device_id", "id"]
    n = int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines(sessions, messages).repartition(n, *key).sortWithinPartitions(*key, "place", "ts", "uuid")
    rows.select(*key, "value").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def remove(keys: DataFrame, folder: str) -> None:
    """Removes the snapshots of sessions (device_id, session_id), by tasks; those that have none are passed over."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, top = ranges.located(folder)
        for batch in batches:
            own = [f"{top}/{_own(*key)}" for key in zip(*(batch.column(c).to_pylist() for c in ("device_id", "session_id")))]
            there = [info.path for info in system.get_file_info(own) if info.type == fs.FileType.Directory]
            for path in there:
                try:
                    system.delete_dir(path)
                except FileNotFoundError:  # the same task, run twice, was faster
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([len(there)], pa.int64())], ["n"])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys.select("device_id", "session_id").repartition(n, "session_id").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def _fits(fields: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for name in fields:
        out = out & (F.lit(True) if name in OPTIONAL else F.col(name).isNotNull())
    return out


def read(spark: SparkSession, folder: str, self_device: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of all other devices' snapshots below a folder."""
    shape = discovery.Source("snapshots", (discovery.Shape(folder.rstrip("/").rsplit("/", 1)[1], ("*.jsonl", "*.txt")),))
    files = discovery.listing(spark, folder.rstrip("/").rsplit("/", 1)[0], shape).withColumn("device_id", F.regexp_extract("path", DEVICE, 1))
    files = files.filter((F.col("device_id") != "") & (F.col("device_id") != self_device)).withColumn("read_to", F.lit(0).cast("bigint"))
    read_lines, _ = discovery.read_lines(files.select("path", "modified", "length", "read_to"))
    rows = read_lines.select("path", "line", F.regexp_extract("path", DEVICE, 1).alias("device_id"), F.from_json("value", LINE).alias("e")).select("path", "line", "device_id", "e.*")
    is_session = (F.col("type") == "session") & F.col("v").isNotNull() & _fits(SESSION)
    heads = rows.filter(is_session)
    last = scratch.stored(heads.groupBy("path").agg(F.max("v").alias("v"), F.max_by(F.struct("device_id", *SESSION), "line").alias("s")).filter(F.col("v") <= VERSION))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    sessions = last.select("s.*").select("device_id", *(empty(c) if c in OPTIONAL else F.col(c) for c in SESSION))
    said = rows.filter((F.col("type") == "message") & _fits(MESSAGE)).join(last.select("path"), "path", "left_semi")
    return sessions, said.select("device_id", *MESSAGE[:4], empty("model"), empty("name"), "content")


def vanished(favorites: DataFrame, present: DataFrame, self_device: str) -> DataFrame:
    """(id, device_id) of other devices' favourites that have no snapshot any more."""
    others = favorites.filter(F.col("favorited") & (F.col("device_id") != self_device)).select(*SESSION_KEY)
    return others.join(present.select(*SESSION_KEY), SESSION_KEY, "left_anti")


def peers(sessions: DataFrame, self_device: str) -> DataFrame:
    """The other devices that have a favourite."""
    return sessions.filter(F.col("favorited") & (F.col("device_id") != self_device)).select("device_id").distinct()
