"""Log files, the store's writes and the collecting stream."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import message_log as m
from tallyforge.operators import store, thread_log as t
from tallyforge.operators.pricing import RATES
from tallyforge.sources import logs


def call(uuid, mid, output, reason=None, ts="2024-01-02T03:04:05Z", **more):
    usage = {"input_tokens": 1, "output_tokens": output, "iterations": [{"a": 1}, {}]}
    return json.dumps({"type": "assistant", "uuid": uuid, "timestamp": ts, "message": {"id": mid, "role": "assistant", "model": "m", "stop_reason": reason, "usage": usage, "content": "said"}} | more)


def lines_of(spark, *texts, after=0):
    return spark.createDataFrame([(f"/p/s{i}.jsonl", after, k + 1, v) for i, text in enumerate(texts) for k, v in enumerate(text) if v.strip()], "path string, after bigint, line bigint, value string")


def test_message_ids_keep_the_finished_and_larger_event(spark):
    log = [call("a", "1", 9), call("b", "1", 2, "end_turn"), call("c", "1", 5, "end_turn"), call("d", "1", 5, "tool_use"), call("e", "2", 3), call("f", "2", 3), "{bad", call("g", "3", 0) .replace('"input_tokens": 1', '"input_tokens": 0')]
    events = m.parsed(lines_of(spark, log))
    assert {(r.uuid, r.output, r.iterations) for r in m.usage(events).collect()} == {("c", 5, 2), ("e", 3, 2)}
    assert [r.skipped for r in m.skipped(events).collect()] == [1]


def test_sub_agents_take_their_description_and_parent(spark):
    path = "/p/parent-id/subagents/agent-7.jsonl"
    lines = spark.createDataFrame([(path, 0, 1, call("a", "1", 1))], "path string, after bigint, line bigint, value string")
    side = spark.createDataFrame([(path.replace(".jsonl", ".meta.json"), " Look around ", "Explore")], "path string, description string, agentType string")
    row = m.sessions(m.parsed(lines), side).collect()[0]
    assert (row.id, row.title_orig, row.agent_type, row.parent_session_id) == ("agent-7", "Look around", "Explore", "parent-id")
    bare = m.sessions(m.parsed(lines)).collect()[0]
    assert (bare.title_orig, bare.agent_type) == ("", "agent")


def test_content_text_that_looks_like_a_list_stays_text(spark):
    log = [json.dumps({"type": "user", "uuid": "u", "message": {"role": "user", "content": '[{"type":"text","text":"x"}]'}}), json.dumps({"type": "user", "uuid": "v", "message": {"role": "user", "content": []}})]
    assert [r.content for r in m.messages(m.parsed(lines_of(spark, log))).collect()] == ['[{"type":"text","text":"x"}]']


def token(total=None, last=None, **info):
    counts = {k: {"input_tokens": v[0], "cached_input_tokens": v[1], "output_tokens": v[2]} for k, v in (("total_token_usage", total), ("last_token_usage", last)) if v}
    return json.dumps({"type": "event_msg", "timestamp": "t", "payload": {"type": "token_count", "info": counts | info}})


def test_threads_difference_totals_and_carry_models(spark):
    log = [json.dumps({"type": "session_meta", "payload": {"id": "th", "cwd": "/w/proj"}}), token((10, 4, 1)), token((10, 4, 1)), token((7, 1, 0)), json.dumps({"type": "turn_context", "payload": {"model": "V/GPT-5"}}), token((12, 9, 3)), token(last=(5, 9, 1)), token((13, 9, 3), model="other")]
    rows = {r.uuid: tuple(r)[2:3] + (r.input, r.cache_read, r.output) for r in t.usage(t.parsed(lines_of(spark, log))).select("uuid", "timestamp", "model", "input", "cache_read", "output").collect()}
    assert rows == {"codex:thread-v1:th:1": ("gpt-5", 6, 4, 1), "codex:thread-v1:th:2": ("gpt-5", 0, 5, 3), "codex:thread-v1:th:3": ("gpt-5", 0, 5, 1), "codex:thread-v1:th:4": ("other", 1, 0, 0)}
    late = t.parsed(lines_of(spark, log, after=3))
    assert [(r.uuid, r.model) for r in t.corrections(late).collect()] == [("codex:thread-v1:th:1", "gpt-5")]
    assert t.sessions(t.parsed(lines_of(spark, log))).collect()[0].title_orig == "proj"


def test_forked_threads_leave_out_what_they_replay(spark):
    log = [json.dumps({"type": "session_meta", "payload": {"id": "a", "session_id": "b"}}), token((10, 0, 1)), json.dumps({"type": "event_msg", "payload": {"type": "thread_settings_applied"}}), token((15, 0, 2)), json.dumps({"type": "response_item", "payload": {"type": "message", "role": "user", "content": "hi"}})]
    events = t.parsed(lines_of(spark, log))
    assert [(r.uuid, r.input, r.session_id) for r in t.usage(events).collect()] == [("codex:thread-v1:a:2", 5, "")]
    assert t.sessions(events).count() == t.messages(events).count() == 0


def test_titles_come_from_the_last_request_heading(spark):
    wrapped = "# Context from my IDE setup:\n## Open tabs\n## My request for Codex: old\n### my request for codex\n\n do this \n and that"
    cases = [(wrapped, "do this \n and that"), (wrapped + "\n## My request for Codex — now", "now"), ("# Context from my IDE setup:\nx", None), ("# AGENTS.md", None), ("<environment_context>x", None), (" plain ", "plain"), ("", None)]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    got = {r.i: r.t for r in rows.select("i", t.title_candidate(F.col("x")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_files_are_read_from_their_cursors(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    one, two = tmp_path / "deep" / "er" / "One.jsonl", tmp_path / "two.jsonl"
    one.write_bytes(b"a\nb\n\nc\xff")
    two.write_text("x\n")
    (tmp_path / "no.txt").write_text("no\n")
    none = spark.createDataFrame([], logs.CURSORS)
    found = logs.changed(logs.files(spark, str(tmp_path)), none)
    assert sorted((r.line, r.value) for r in logs.lines(found).collect()) == [(1, "a"), (1, "x"), (2, "b"), (4, "c�")]
    cursors = spark.createDataFrame(logs.advanced(found).collect(), logs.CURSORS)
    assert sorted(r.line for r in cursors.collect()) == [1, 3]
    assert logs.changed(logs.files(spark, str(tmp_path)), cursors).count() == 0
    older = cursors.withColumn("modified", F.lit("2000-01-01").cast("timestamp"))
    again = {r.path.rsplit("/", 1)[-1]: r.after for r in logs.changed(logs.files(spark, str(tmp_path)), older.withColumn("line", F.when(F.col("line") == 1, 9).otherwise(F.col("line")))).collect()}
    assert again == {"One.jsonl": 3, "two.jsonl": 0}  # two.jsonl was cut
    assert logs.files(spark, str(tmp_path / "missing")).count() == 0


STORED = "uuid string, device_id string, day string, model string, model_key string, cost decimal(10,4), input bigint"


def test_usage_lands_once_and_only_unknown_models_are_corrected(spark):
    have = spark.createDataFrame([("a", "d", "1", "unknown", "", Decimal(0), 1), ("b", "d", "1", "m", "m", Decimal(0), 1)], STORED)
    new = spark.createDataFrame([(*r, "x", "x", Decimal(0), 1) for r in (("a", "d", "2"), ("a", "e", "2"), ("c", "d", "3"), ("c", "d", "3"))], STORED)
    got = store.landed(have, new, store.USAGE_KEY)
    assert sorted((r.uuid, r.device_id) for r in got.collect()) == [("a", "e"), ("c", "d")]
    assert sorted(tuple(r) for r in store.dirty_days(got).collect()) == [("d", "3"), ("e", "2")]
    fixed = store.corrected(have, spark.createDataFrame([("a", "d", "y", "y", 2.0), ("b", "d", "y", "y", 2.0)], "uuid string, device_id string, model string, model_key string, cost double"))
    assert sorted((r.uuid, r.model, float(r.cost)) for r in fixed.collect()) == [("a", "y", 2.0), ("b", "m", 0.0)]


def test_marks_are_cleared_only_if_nothing_came_since(spark):
    dirty = spark.createDataFrame([("d", "1"), ("d", "2")], "device_id string, day string")
    exported = spark.createDataFrame([("d", "1", 1), ("d", "2", 1)], "device_id string, day string, n bigint")
    now = spark.createDataFrame([("d", "1"), ("d", "2"), ("d", "2")], "device_id string, day string")
    assert [tuple(r) for r in store.cleared(dirty, exported, now, ["device_id", "day"]).collect()] == [("d", "2")]


SESSIONS = "id string, device_id string, source string, project_dir string, title_orig string, started_at string, last_active_at string, agent_type string, parent_session_id string, custom_title string, favorited boolean, synced_group_id string, local_group_id string, excluded boolean"


def session(i, title="t", favorited=False, custom="", excluded=False):
    return (i, "d", "s", "/p", title, "", "", "", "", custom, favorited, "", "", excluded)


def test_sessions_keep_what_users_set(spark):
    have = spark.createDataFrame([session("1", favorited=True, custom="mine"), session("2"), session("3")], SESSIONS)
    new = spark.createDataFrame([session("1", "new"), session("4", "four", True)], SESSIONS)
    got = {r.id: r for r in store.upserted_sessions(have, new).collect()}
    assert (got["1"].title_orig, got["1"].custom_title, got["1"].favorited) == ("new", "mine", True) and got["4"].favorited is False and len(got) == 4
    pulled = {r.id: r.favorited for r in store.upserted_sessions(have, new, True).collect()}
    assert pulled == {"1": False, "2": False, "3": False, "4": True}
    overlay = spark.createDataFrame([("2", "d", "custom_title", "old", 1), ("2", "d", "custom_title", "newest", 2), ("3", "d", "favorited", "true", 1)], "id string, device_id string, column string, value string, updated_at int")
    seen = {r.id: (r.custom_title, r.favorited) for r in store.user_columns(have, overlay).collect()}
    assert seen == {"1": ("mine", True), "2": ("newest", False), "3": ("", True)}
    messages = spark.createDataFrame([("1", "d", "x"), ("2", "d", "y")], "session_id string, device_id string, uuid string")
    ids = lambda *x: spark.createDataFrame([(i, "d") for i in x], "id string, device_id string")
    left, said = store.reconciled(have, messages, ids("1"), "s", "d")
    assert [r.id for r in left.collect()] == ["1"] and [r.uuid for r in said.collect()] == ["x"]
    assert store.reconciled(have, messages, ids(), "s", "d")[0].count() == 3
    gone = {r.id: (r.excluded, r.favorited) for r in store.soft_deleted(have, ids("1")).collect()}
    assert gone == {"1": (True, False), "2": (False, False), "3": (False, False)}
    plain, rest = store.unfavorited(have, messages, ids("1"))
    assert not any(r.favorited for r in plain.collect()) and [r.uuid for r in rest.collect()] == ["y"]
    todo = {r.id: r.todo for r in store.presence_mismatches(ids("1", "2"), ids("2", "3")).collect()}
    assert todo == {"1": "remove", "3": "write"}


def test_rebills_touch_only_rows_without_a_cost(spark):
    rates = spark.createDataFrame([("m", 1.0, 1.0, 0.0, 0.0)], "model_key string, a double, b double, c double, d double").select("model_key", *(F.col(c).cast("decimal(16,10)").alias(n) for c, n in zip("abcd", ("input_rate", "output_rate", "cache_creation_rate", "cache_read_rate"))))
    rows = spark.createDataFrame([("a", "d", "1", "m", 0.0), ("b", "d", "2", "m", 5.0), ("c", "d", "3", "none", 0.0)], "uuid string, device_id string, day string, model string, cost double").withColumns({c: F.lit(1_000_000).cast("bigint") for c in ("input", "output", "cache_creation", "cache_read")})
    got, days = store.with_rebills(rows, rates)
    assert {r.uuid: r.cost for r in got.collect()} == {"a": 1 + 1 + 1.25 + 0.1, "b": 5.0, "c": 0.0}
    assert [tuple(r) for r in days.collect()] == [("d", "1")]


def test_devices(spark):
    devices = spark.createDataFrame([("a", "", True, "0"), ("b", "", False, "0")], "device_id string, display_name string, is_self boolean, first_seen string")
    used = spark.createDataFrame([("b", "1"), ("cccccccc", "3"), ("cccccccc", "2")], "device_id string, timestamp string")
    found = store.discovered(devices, used)
    assert {r.device_id: r.first_seen for r in found.collect()} == {"a": "0", "b": "0", "cccccccc": "2"}
    names = lambda *x: spark.createDataFrame(list(x), "device_id string, display_name string")
    assert {r.device_id: r.name for r in store.device_names(found, names(("a", "Mine"), ("b", " ")), names(("a", "x"), ("b", "Synced"))).collect()} == {"a": "Mine", "b": "Synced", "cccccccc": "Device-cccccc"}
    assert sorted(r.device_id for r in store.backed(found, names(("cccccccc", ""))).collect()) == ["a", "cccccccc"]


def test_days_are_exported_in_order_and_emptied_ones_go(spark, tmp_path):
    path = str(tmp_path / "out")
    device = "0123456789ab"
    rows = spark.createDataFrame([("b", device, "2024-01-01", 1.5), ("a", device, "2024-01-01", 2.5), ("c", device, "2024-01-02", 3.0)], "uuid string, device_id string, day string, cost double")
    store.export_days(rows, store.dirty_days(rows), path)
    (file,) = (tmp_path / "out" / f"device_id={device}" / "day=2024-01-01").glob("*.json")
    assert [json.loads(x)["uuid"] for x in file.read_text().splitlines()] == ["a", "b"]
    file.with_name("other.json").write_text("\n{broken\n")
    read = store.read_artifacts(spark, path, "uuid string, cost double, device_id string, day string")
    assert sorted((r.uuid, r.cost) for r in read.collect()) == [("a", 2.5), ("b", 1.5), ("c", 3.0)]
    store.export_days(rows.filter("day <> '2024-01-02'"), spark.createDataFrame([(device, "2024-01-02")], "device_id string, day string"), path)
    assert not (tmp_path / "out" / f"device_id={device}" / "day=2024-01-02").exists()
    assert (tmp_path / "out" / f"device_id={device}" / "day=2024-01-01").exists()


def test_prices(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"model_key": "x", "input_per_million": "1.5"}]')
    (tmp_path / "b.json").write_text('{"models": [{"model_key": "y", "input_per_million": 2, "output_per_million": "bad"}, {"model_key": ""}]}')
    docs = store.price_documents(spark, str(tmp_path))
    assert sorted((r.model_key, float(r.input_rate), float(r.output_rate)) for r in docs.collect()) == [("x", 1.5, 0.0), ("y", 2.0, 0.0)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "sheet.json").write_text('{"sample_spec": {"input_cost_per_token": 1}, "p/z": {"input_cost_per_token": 3e-06, "cache_read_input_token_cost": 3e-07}, "free": {"input_cost_per_token": 0}}')
    sheet = store.price_sheet(spark, str(tmp_path / "s"))
    assert [(r.model_key, float(r.input_rate), float(r.cache_read_rate)) for r in sheet.collect()] == [("p/z", 3.0, 0.3)]
    merged = store.repriced(docs, sheet, docs.filter("model_key = 'y'"))
    assert sorted(r.model_key for r in merged.collect()) == ["p/z", "x"]


def test_session_updates_give_a_row_for_each_model(spark):
    from tallyforge.operators import chat_log

    def update(kind="turn_completed", prompt="p", **usage):
        return json.dumps({"timestamp": "t", "method": "_x.ai/session/update", "params": {"update": {"sessionUpdate": kind, "prompt_id": prompt, "usage": usage}}})

    log = [update(modelUsage={"b": {"inputTokens": 5, "cachedReadTokens": 9, "outputTokens": 1}, "a": {"inputTokens": 0}}), update(prompt="", inputTokens=3), update("other", inputTokens=3), "{}"]
    rows = chat_log.update_usage(lines_of(spark, log).withColumn("path", F.lit("/s/sess/updates.jsonl"))).collect()
    assert sorted((r.uuid, r.input, r.cache_read, r.output) for r in rows) == [("grok:turn:sess:line2:unknown", 3, 0, 0), ("grok:turn:sess:p:b", 0, 5, 1)]


def test_chats_take_their_project_and_first_text(spark):
    from tallyforge.operators import chat_log

    chat = {"sessionId": "c", "startTime": "1", "lastUpdated": "2", "messages": [{"type": "info", "content": "no"}, {"type": "user", "id": "u", "content": [{"text": " hi "}, {"text": "you"}]}, {"type": "gemini", "id": "g", "content": "", "model": "m"}]}
    files = spark.createDataFrame([("/tmp/h/chats/session-1.json", json.dumps(chat)), ("/tmp/h/chats/session-2.json", "bad")], "path string, value string")
    chats = chat_log.chats(files)
    row = chat_log.chat_sessions(chats, spark.createDataFrame([("/tmp/h", "/work ")], "folder string, project_dir string")).collect()
    assert [(r.id, r.project_dir, r.title_orig) for r in row] == [("c", "/work", "hi")]
    assert [(r.uuid, r.role, r.content) for r in chat_log.chat_messages(chats).collect()] == [("u", "user", " hi \nyou")]
