"""Folder shapes, the gate by metadata, cursors over several passes, heads."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import discovery, logs

NONE = "path_key string, modified timestamp, line bigint"


def put(home, name, text, age=0):
    path = home / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    stamp = time.time() - age
    os.utime(path, (stamp, stamp))


def names(df, home):
    return sorted((r["path"].split(f"{home}/")[1], r["gate"]) for r in df.collect())


def test_each_source_finds_its_own_files(spark, tmp_path):
    for name in (
        ".claude/projects/p/a.jsonl", ".claude/projects/p/s/subagents/agent-1.jsonl", ".claude/projects/p/notes.txt", ".claude/other/x.jsonl",
        ".codex/sessions/2024/01/02/r.jsonl", ".codex/sessions/2024/01/02/deep/r.jsonl", ".codex/archived_sessions/a.jsonl", ".codex/archived_sessions/sub/a.jsonl",
        ".gemini/tmp/h/chats/session-1.json", ".gemini/tmp/h/chats/other.json", ".gemini/tmp/h/session-2.json", ".gemini/tmp/h/.project_root",
        ".grok/sessions/c/s1/summary.json", ".grok/sessions/c/s1/updates.jsonl", ".grok/archived_sessions/s2/chat_history.jsonl", ".grok/sessions/c/s1/else.jsonl",
    ):
        put(tmp_path, name, "{}\n")
    found = {n: names(discovery.listing(spark, str(tmp_path), s), tmp_path) for n, s in discovery.SOURCES.items()}
    assert found == {
        "claude": [(".claude/projects/p/a.jsonl", "lines"), (".claude/projects/p/s/subagents/agent-1.jsonl", "lines")],
        "codex": [(".codex/archived_sessions/a.jsonl", "lines"), (".codex/sessions/2024/01/02/r.jsonl", "lines")],
        "gemini": [(".gemini/tmp/h/chats/session-1.json", "whole")],
        "grok": [(".grok/archived_sessions/s2/chat_history.jsonl", "lines"), (".grok/sessions/c/s1/summary.json", "whole"), (".grok/sessions/c/s1/updates.jsonl", "lines")],
    }
    assert all(not names(discovery.listing(spark, str(tmp_path / "nobody"), s), tmp_path) for s in discovery.SOURCES.values())


def test_the_gate_reads_no_content(spark, tmp_path):
    put(tmp_path, ".claude/projects/a.jsonl", "1\n")
    due = discovery.due(discovery.listing(spark, str(tmp_path), discovery.SOURCES["claude"]), spark.createDataFrame([], NONE))
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile" in plan
    assert all("content" not in line.split("ReadSchema:")[1] for line in plan.splitlines() if "ReadSchema:" in line)


@pytest.mark.parametrize("step", [2, 5, 1 << 20])
def test_passes_read_what_is_new(spark, tmp_path, step):
    source = discovery.SOURCES["claude"]
    cursors = spark.createDataFrame([], NONE)

    def turn():
        nonlocal cursors
        files = discovery.due(discovery.listing(spark, str(tmp_path), source), cursors)
        lines, now = discovery.read_lines(files, step)
        got = sorted((r["path"].rsplit("/", 1)[1], r["after"], r["line"], r["value"]) for r in lines.collect())
        cursors = spark.createDataFrame(logs.merged(cursors, now).collect(), NONE)
        return got

    put(tmp_path, ".claude/projects/A.jsonl", "one\n\n two\r\nhal", age=50)
    put(tmp_path, ".claude/projects/b.jsonl", b"x\xffy\n", age=50)
    put(tmp_path, ".claude/projects/empty.jsonl", "", age=50)
    assert turn() == [("A.jsonl", 0, 1, "one"), ("A.jsonl", 0, 3, "two"), ("A.jsonl", 0, 4, "hal"), ("b.jsonl", 0, 1, "x�y")]
    assert {r["path_key"].rsplit("/", 1)[1]: r["line"] for r in cursors.collect()} == {"a.jsonl": 3, "b.jsonl": 1}  # Spark lists no empty files
    assert turn() == []
    put(tmp_path, ".claude/projects/A.jsonl", "one\n\n two\r\nhalf\nmore\n", age=20)
    assert [g for g in turn() if g[2] > g[1]] == [("A.jsonl", 3, 4, "half"), ("A.jsonl", 3, 5, "more")]
    put(tmp_path, ".claude/projects/A.jsonl", "new\n", age=10)  # cut: it has fewer lines than were read
    put(tmp_path, ".claude/projects/b.jsonl", "x\n", age=90)  # older than when it was read
    assert turn() == [("A.jsonl", 0, 1, "new")]


def test_ranges_give_what_whole_files_give(spark, tmp_path):
    for k in range(6):
        put(tmp_path, f".claude/projects/f{k}.jsonl", "\n".join(f"line {i} é" * (i % 4) for i in range(k * 7)) + ("\n" if k % 2 else ""))
    cursors = spark.createDataFrame([(logs_key, None, line) for logs_key, line in ((f"file:{tmp_path}/.claude/projects/f3.jsonl".lower(), 4),)], NONE)
    files = discovery.due(discovery.listing(spark, str(tmp_path), discovery.SOURCES["claude"]), cursors)
    mine, now = discovery.read_lines(files, 9)
    whole = logs.changed(logs.files(spark, f"{tmp_path}/.claude/projects"), cursors)
    key = lambda df: sorted((r["path"].rsplit("/", 1)[1], r["after"], r["line"], r["value"]) for r in df.collect())
    assert key(mine) == key(logs.lines(whole)) and key(mine)
    ends = lambda df: sorted((r["path_key"].rsplit("/", 1)[1], r["line"]) for r in df.collect())
    assert ends(now) == ends(logs.advanced(whole))


def test_heads_and_ids(spark, tmp_path):
    big = '{"type":"session_meta","payload":{"id":"thread-9"}}\n' + "x" * 200_000
    put(tmp_path, ".codex/sessions/a.jsonl", big)
    put(tmp_path, ".codex/sessions/rollout-2024-00000000-1111-2222-3333-444444444444.jsonl", '{"type":"event_msg"}\n')
    put(tmp_path, ".codex/sessions/plain.jsonl", b'\xff{"type":"session_meta","payload":{"id":"lost"}}\n')
    source = discovery.SOURCES["codex"]
    files = discovery.listing(spark, str(tmp_path), source)
    sizes = {r["path"].rsplit("/", 1)[1]: len(r["head"]) for r in discovery.heads(files).collect()}
    assert sizes["a.jsonl"] == discovery.HEAD and sizes["plain.jsonl"] == 0
    assert {r["id"] for r in discovery.seen_ids(files, source).collect()} == {"thread-9", "00000000-1111-2222-3333-444444444444", "plain"}
    put(tmp_path, ".gemini/tmp/h/chats/session-1.json", '{"sessionId":"g1","messages":[]}')
    put(tmp_path, ".gemini/tmp/h/chats/session-2.json", "broken")
    put(tmp_path, ".grok/sessions/c/s1/summary.json", "{}")
    put(tmp_path, ".grok/sessions/c/s1/updates.jsonl", "{}")
    put(tmp_path, ".claude/projects/p/u1.jsonl", "{}")
    ids = {n: {r["id"] for r in discovery.seen_ids(discovery.listing(spark, str(tmp_path), s), s).collect()} for n, s in discovery.SOURCES.items() if n != "codex"}
    assert ids == {"gemini": {"g1", "session-2"}, "grok": {"s1"}, "claude": {"u1"}}


def test_whole_files(spark, tmp_path):
    put(tmp_path, ".gemini/tmp/h/chats/session-1.json", b'{"a":"\xff"}')
    files = discovery.listing(spark, str(tmp_path), discovery.SOURCES["gemini"])
    assert [r["value"] for r in discovery.read_whole(files).collect()] == ['{"a":"�"}']
    assert files.select(F.max("length")).first()[0] == 9


def test_listing_and_lines_are_read_once(spark, tmp_path):
    folder = tmp_path / ".codex" / "sessions"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text("one\ntwo\nhal")
    files = discovery.listing(spark, str(tmp_path), discovery.SOURCES["codex"])
    lines, cursors = discovery.read_lines(files.withColumn("read_to", F.lit(0).cast("bigint")))
    (folder / "a.jsonl").unlink()
    assert files.count() == 1
    assert sorted((r["line"], r["value"]) for r in lines.collect()) == [(1, "one"), (2, "two"), (3, "hal")]
    assert [r["line"] for r in cursors.collect()] == [2]
