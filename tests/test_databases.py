"""SQLite files as tables, and the sessions read from them."""

import json
import os
import sqlite3

import pytest

from tallyforge.operators import database_log as d
from tallyforge.sources import databases


def store(path, n):
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("CREATE TABLE message (id TEXT PRIMARY KEY, session_id TEXT, time_created INTEGER, time_updated INTEGER, data TEXT)")
    con.executemany("INSERT INTO message VALUES (?, ?, ?, ?, ?)", [(f"{path.stem}{i}", path.stem, i, i, None if i % 5 == 0 else json.dumps({"role": "user", "n": i})) for i in range(n)])
    con.commit()
    return con


def test_tables_of_many_files_are_read_in_ranges(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    held = [store(tmp_path / "a.db", 25), store(tmp_path / "deep" / "b.db", 7)]  # open: their rows are in write-ahead logs
    sqlite3.connect(tmp_path / "empty.db").close()
    df = databases.table(spark, str(tmp_path), "message", d.MESSAGES, rows="10")
    assert df.rdd.getNumPartitions() == 4
    rows = {r.id: (r.session_id, r.time_created, r.data is None) for r in df.collect()}
    assert rows == {f"{s}{i}": (s, i, i % 5 == 0) for s, n in (("a", 25), ("b", 7)) for i in range(n)}
    for con in held:
        con.close()


def test_ranges_follow_rows_and_not_ids(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "far.db")
    con.execute("CREATE TABLE t (n INTEGER PRIMARY KEY)")
    con.executemany("INSERT INTO t VALUES (?)", [(-5,), (1,), (2,), (300_000_000_000,)])
    con.commit()
    con.close()
    df = databases.table(spark, str(tmp_path), "t", "n bigint", rows="3")
    assert df.rdd.getNumPartitions() == 2 and sorted(r.n for r in df.collect()) == [-5, 1, 2, 300_000_000_000]


def test_tables_without_row_ids_are_read(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "w.db")
    con.execute("CREATE TABLE t (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
    con.execute("INSERT INTO t VALUES ('a', 1)")
    con.commit()
    con.close()
    assert [tuple(r) for r in databases.table(spark, str(tmp_path), "t", "k string, n bigint").collect()] == [("a", 1)]


def test_what_cannot_be_read_raises(spark, tmp_path):
    (tmp_path / "c.db").write_bytes(b"no database" * 100)
    with pytest.raises(Exception, match="not a database"):
        databases.table(spark, str(tmp_path), "t", "n bigint").count()
    con = sqlite3.connect(tmp_path / "d.sqlite")
    con.execute("CREATE TABLE t (k TEXT)")
    con.execute("INSERT INTO t VALUES ('a')")
    con.commit()
    con.close()
    with pytest.raises(Exception, match="nope"):
        databases.table(spark, str(tmp_path), "t", "nope bigint", pattern="*.sqlite").count()
    with pytest.raises(Exception, match="locked"):
        locked = sqlite3.connect(tmp_path / "d.sqlite", isolation_level=None)
        locked.execute("PRAGMA locking_mode = EXCLUSIVE")
        locked.execute("BEGIN EXCLUSIVE")
        databases.table(spark, str(tmp_path), "t", "k string", pattern="*.sqlite").count()


def test_missing_folders_and_tables_have_no_rows(spark, tmp_path):
    store(tmp_path / "a.db", 3).close()
    assert databases.table(spark, str(tmp_path / "none"), "message", d.MESSAGES).count() == 0
    assert databases.table(spark, str(tmp_path), "part", d.PARTS).count() == 0


def test_a_write_ahead_log_counts_as_the_database(tmp_path):
    path = tmp_path / "a.db"
    path.write_bytes(b"")
    os.utime(path, ns=(1, 1000))
    assert databases.modified(str(path)) == 1000
    (tmp_path / "a.db-wal").write_bytes(b"")
    os.utime(tmp_path / "a.db-wal", ns=(1, 2000))
    assert databases.modified(str(path)) == 2000


def test_unfinished_answers_hold_the_cursor_and_count_later(spark):
    sessions = spark.createDataFrame([("s", "", "/w/proj/", 1, 10), ("q", "", "", 1, 10)], d.SESSIONS)
    told = {"role": "assistant", "tokens": {"input": 5, "output": -3, "reasoning": 2.5, "cache": None}, "time": {"created": 1500, "completed": None}}
    open_answer = {"role": "assistant", "tokens": {"input": 1}, "time": {"created": 1}}
    messages = spark.createDataFrame([("a", "s", 1, 99, json.dumps(told)), ("b", "s", 2, 2, json.dumps(open_answer)), ("c", "q", 1, 1, "{bad"), ("d", "q", 1, 1, None)], d.MESSAGES)
    cursors = spark.createDataFrame([("s", 50), ("q", 9)], "session_id string, watermark bigint")
    due = d.due(sessions, messages, cursors)
    assert {tuple(r) for r in due.collect()} == {("s", 99), ("q", 10)}
    assert [tuple(r) for r in d.advanced(due, messages).collect()] == [("q", 10)]
    assert [(r.uuid, r.timestamp, r.model, r.input, r.output) for r in d.usage(messages).collect()] == [("opencode:s:a", "1970-01-01T00:00:01.500+00:00", "unknown", 5, 0)]
    assert {(r.id, r.title_orig) for r in d.sessions(sessions).collect()} == {("s", "proj"), ("q", "")}
