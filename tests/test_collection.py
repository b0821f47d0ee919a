"""A home with logs of all sources, collected in passes: what lands, what is corrected, what goes."""

from __future__ import annotations

import json
import os
import sqlite3
import time

import pytest

from tallyforge.operators import collection, landing, pricing

DEV = "0123456789ab"


def put(home, name, *lines, age=0, end="\n"):
    path = home / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + end)
    stamp = time.time() - age
    os.utime(path, (stamp, stamp))


def said(uuid, text, mid, out=1, kind="assistant", **more):
    usage = {"usage": {"input_tokens": 5, "output_tokens": out}, "model": "click", "id": mid} if kind == "assistant" else {}
    return {"type": kind, "uuid": uuid, "timestamp": "2024-01-02T10:00:00Z", "cwd": "/work/p", "message": {"role": kind, "content": text, **usage}, **more}


def count(i, o):
    return {"type": "event_msg", "timestamp": "2024-01-03T00:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "output_tokens": o}}}}


def update(prompt, **models):
    return {"timestamp": "2024-01-04T00:00:00Z", "method": "_x.ai/session/update", "params": {"update": {"sessionUpdate": "turn_completed", "prompt_id": prompt, "usage": {"modelUsage": {m: {"inputTokens": n, "outputTokens": 1} for m, n in models.items()}}}}}


def filled(home):
    put(home, ".claude/projects/p/u1.jsonl", said("a0", "Do it", "", kind="user"), said("a1", "Done", "m1"), {"type": "system", "subtype": "turn_duration", "uuid": "t1", "timestamp": "2024-01-02T11:00:00Z", "durationMs": 900}, age=60)
    put(home, ".claude/projects/p/u1/subagents/agent-7.jsonl", said("b1", "Found", "m2"), age=60)
    put(home, ".claude/projects/p/u1/subagents/agent-7.meta.json", {"description": "Look around", "agentType": "Explore"}, age=60)
    put(home, ".codex/sessions/2024/01/02/r.jsonl", {"type": "session_meta", "payload": {"id": "th1", "cwd": "/work/q"}}, {"type": "response_item", "timestamp": "2024-01-03T00:00:00Z", "payload": {"type": "message", "role": "user", "content": "Ask"}}, count(10, 1), count(30, 2), age=60)
    put(home, ".gemini/tmp/h/chats/session-1.json", {"sessionId": "g1", "startTime": "1", "lastUpdated": "2", "messages": [{"id": "x", "type": "user", "content": "Hi"}, {"id": "y", "type": "gemini", "timestamp": "2024-01-05T00:00:00Z", "model": "gem", "content": "Yes", "tokens": {"input": 9, "output": 2, "cached": 4, "thoughts": 1}}]}, age=60)
    put(home, ".gemini/tmp/h/.project_root", "/work/gem", age=60)
    put(home, ".grok/sessions/c/s1/updates.jsonl", update("p1", k1=4, k2=6), age=60)
    put(home, ".grok/sessions/c/s1/summary.json", {"info": {"id": "s1", "cwd": "/work/k"}, "created_at": 1704067200}, age=60)
    put(home, ".grok/sessions/c/s1/chat_history.jsonl", {"type": "user", "content": "Tell me", "timestamp": 1704067201}, age=60)
    put(home, ".grok/sessions/c/s2/chat_history.jsonl", {"type": "user", "content": "No summary"}, age=60)
    path = home / collection.STORE
    path.parent.mkdir(parents=True)
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE session (id TEXT, title TEXT, directory TEXT, time_created INTEGER, time_updated INTEGER)")
    con.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, time_updated INTEGER, data TEXT)")
    con.execute("CREATE TABLE part (id TEXT, message_id TEXT, session_id TEXT, time_created INTEGER, data TEXT)")
    con.execute("INSERT INTO session VALUES ('o1', 'Title', '/work/o', 1000, 2000)")
    con.execute("INSERT INTO message VALUES ('om', 'o1', 1000, 2000, ?)", (json.dumps({"role": "assistant", "modelID": "om1", "time": {"created": 1000, "completed": 1500}, "tokens": {"input": 3, "output": 2, "reasoning": 1, "cache": {"read": 1, "write": 0}}}),))
    con.execute("INSERT INTO part VALUES ('op', 'om', 'o1', 1200, ?)", (json.dumps({"type": "text", "text": "Answer"}),))
    con.commit()
    con.close()


def test_a_home_is_collected_in_passes(spark, tmp_path):
    home = tmp_path / "home"
    filled(home)
    tables = landing.store(spark, str(tmp_path / "store"))
    run = lambda: collection.collect(tables, str(home), pricing.seed(spark), DEV, "2024-02-01T00:00:00Z")
    run()
    calls = lambda: sorted((r["source"], r["uuid"], r["model"], r["session_id"], r["input"], r["output"], r["cache_read"]) for r in tables.read("usage").collect())
    first = [
        ("claude", "a1", "click", "u1", 5, 1, 0), ("claude", "b1", "click", "agent-7", 5, 1, 0), ("codex", "codex:thread-v1:th1:1", "unknown", "th1", 10, 1, 0), ("codex", "codex:thread-v1:th1:2", "unknown", "th1", 20, 1, 0),
        ("gemini", "gemini:g1:y", "gem", "g1", 5, 3, 4), ("grok", "grok:turn:s1:p1:k1", "k1", "s1", 4, 1, 0), ("grok", "grok:turn:s1:p1:k2", "k2", "s1", 6, 1, 0), ("opencode", "opencode:o1:om", "om1", "o1", 3, 3, 1),
    ]
    assert calls() == first
    sessions = lambda: {(r["source"], r["id"]): (r["title_orig"], r["project_dir"], r["agent_type"], r["parent_session_id"]) for r in tables.read("sessions").collect()}
    assert sessions() == {
        ("claude", "u1"): ("Do it", "/work/p", "", ""), ("claude", "agent-7"): ("Look around", "/work/p", "Explore", "u1"), ("codex", "th1"): ("Ask", "/work/q", "", ""), ("gemini", "g1"): ("Hi", "/work/gem", "", ""),
        ("grok", "s1"): ("Tell me", "/work/k", "", ""), ("grok", "s2"): ("", "", "", ""), ("opencode", "o1"): ("Title", "/work/o", "", ""),
    }
    texts = lambda: sorted((r["session_id"], r["role"], r["content"]) for r in tables.read("messages").collect())
    assert texts() == [("agent-7", "assistant", "Found"), ("g1", "assistant", "Yes"), ("g1", "user", "Hi"), ("o1", "assistant", "Answer"), ("s1", "user", "Tell me"), ("s2", "user", "No summary"), ("th1", "user", "Ask"), ("u1", "assistant", "Done"), ("u1", "user", "Do it")]
    assert [tuple(r) for r in tables.read("turns").select("uuid", "session_id", "duration_ms").collect()] == [("t1", "u1", 900)]
    number = tables.state().number
    run()  # nothing is due: nothing changes but the numbers of commits
    assert calls() == first and len(texts()) == 9 and tables.state().number > number

    put(home, ".codex/sessions/2024/01/02/r.jsonl", *(home / ".codex/sessions/2024/01/02/r.jsonl").read_text().splitlines(), {"type": "turn_context", "payload": {"model": "gpt-9"}}, count(50, 5), age=20)
    put(home, ".grok/sessions/c/s1/updates.jsonl", update("p1", k1=4, k2=6), update("p2", k1=7), age=20)
    (home / ".grok/sessions/c/s2/chat_history.jsonl").unlink()
    (home / ".claude/projects/p/u1/subagents/agent-7.jsonl").unlink()
    run()
    assert [c[1:3] + c[4:] for c in calls() if c[0] == "codex"] == [("codex:thread-v1:th1:1", "gpt-9", 10, 1, 0), ("codex:thread-v1:th1:2", "gpt-9", 20, 1, 0), ("codex:thread-v1:th1:3", "gpt-9", 20, 3, 0)]
    assert ("grok", "grok:turn:s1:p2:k1", "k1", "s1", 7, 1, 0) in calls() and len(calls()) == 10  # calls stay
    assert ("grok", "s2") not in sessions() and ("claude", "agent-7") not in sessions() and ("grok", "s1") in sessions() and ("opencode", "o1") in sessions()
    assert not {"agent-7", "s2"} & {t[0] for t in texts()} and len(texts()) == 7
    os.rename(home / ".claude", home / "hidden")  # a folder that can't be seen doesn't make its sessions go
    run()
    assert ("claude", "u1") in sessions()


def test_a_source_that_fails_lands_nothing(spark, tmp_path, monkeypatch):
    home = tmp_path / "home"
    filled(home)
    tables = landing.store(spark, str(tmp_path / "store"))
    good = collection.FOLDS["codex"]
    monkeypatch.setitem(collection.FOLDS, "codex", lambda read: (_ for _ in ()).throw(ValueError("bad")))
    run = lambda: collection.collect(tables, str(home), pricing.seed(spark), DEV, "2024-02-01T00:00:00Z")
    with pytest.raises(ValueError):
        run()
    assert tables.state().number == 0
    monkeypatch.setitem(collection.FOLDS, "codex", good)
    run()
    assert {r["source"] for r in tables.read("usage").collect()} == {"claude", "codex", "gemini", "grok", "opencode"} and tables.read("usage").count() == 8


def test_order_of_results(spark):
    rows = spark.createDataFrame([("b", "2"), ("a", "2"), ("c", "1")], "uuid string, timestamp string")
    assert [r["uuid"] for r in collection.ordered(rows).collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        collection.ordered(rows.select("uuid"))
