"""Snapshots, artifacts and registries between devices: round trips, versions, layouts, favourites that go."""

from __future__ import annotations

import json

from tallyforge.operators import exchange, landing, pricing, snapshots

ONE, TWO = "aaaaaaaaaaaa", "bbbbbbbbbbbb"
SESSION = {"type": "session", "v": 1, "id": "s1", "source": "claude", "project_dir": "/p", "title_orig": "T", "started_at": "1", "last_active_at": "2", "favorited": True, "synced_group_id": "g"}
MESSAGE = {"type": "message", "session_id": "s1", "uuid": "m1", "role": "user", "ts": "1", "content": "hi\nthere"}


def put(root, name, *lines):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_snapshots_are_read_by_type_and_version(spark, tmp_path):
    put(tmp_path, f"data/{TWO}/sessions/s1.jsonl", SESSION, MESSAGE, "", "{broken", {**MESSAGE, "uuid": "m2", "model": "x", "extra": 1}, {"type": "other"}, {"type": "message", "uuid": "half"})
    put(tmp_path, f"data/{TWO}/sessions/new.jsonl", {**SESSION, "id": "new", "v": 2}, {**MESSAGE, "session_id": "new"})
    put(tmp_path, f"data/{TWO}/sessions/none.jsonl", {**MESSAGE, "session_id": "none"})
    put(tmp_path, f"data/{TWO}/sessions/late.jsonl", {**MESSAGE, "session_id": "late", "uuid": "m9"}, {**SESSION, "id": "late", "agent_type": "Explore", "parent_session_id": "s1"})
    put(tmp_path, f"data/{TWO}/sessions/mixed.jsonl", {**SESSION, "id": "mixed"}, {**SESSION, "id": "mixed", "v": 7})
    put(tmp_path, f"data/{ONE}/sessions/own.jsonl", {**SESSION, "id": "own"})
    put(tmp_path, "data/not-a-device/sessions/x.jsonl", {**SESSION, "id": "x"})
    sessions, messages = snapshots.read(spark, str(tmp_path / "data"), ONE)
    got = {r["id"]: r for r in sessions.collect()}
    assert sorted(got) == ["late", "s1"] and got["s1"]["device_id"] == TWO and got["s1"]["agent_type"] == "" and got["late"]["parent_session_id"] == "s1"
    assert sorted((r["session_id"], r["uuid"], r["model"], r["content"]) for r in messages.collect()) == [("late", "m9", "", "hi\nthere"), ("s1", "m1", "", "hi\nthere"), ("s1", "m2", "x", "hi\nthere")]


CALL = "uuid string, timestamp string, model string, source string, session_id string, input bigint, output bigint, cache_creation bigint, cache_read bigint"
TEXT = "session_id string, uuid string, role string, ts string, model string, name string, content string"


def filled(spark, tmp_path, device, sessions=("s1", "s2")):
    tables = landing.store(spark, str(tmp_path / device))
    calls = spark.createDataFrame([(f"{device[0]}{k}", f"2024-01-0{k + 1}T10:00:00Z", "click", "claude", "s1", 10, 1, 0, 0) for k in range(3)], CALL)
    texts = spark.createDataFrame([(s, f"{device[0]}{s}{k}", "user", f"{9 - k}", "", "", f"text {k}\nof {s}") for s in sessions for k in range(3)], TEXT)
    rows = spark.createDataFrame([(s, "claude", "/p", f"Title {s}", "1", "2", "", "") for s in sessions], "id string, source string, project_dir string, title_orig string, started_at string, last_active_at string, agent_type string, parent_session_id string")
    landing.land(tables, landing.Found(usage=calls, messages=texts, sessions=rows), pricing.seed(spark), device)
    return tables


def favored(tables, *ids):
    def work(base):
        from pyspark.sql import functions as F

        sessions = tables.read("sessions", base)
        marks = sessions.select("device_id", F.col("id").alias("session_id"))
        return landing.Changes(replace={"sessions": sessions.withColumn("favorited", F.col("id").isin(*ids)), "dirty_sessions": marks})

    tables.changed(work)


def test_devices_exchange_their_stores(spark, tmp_path):
    folder = str(tmp_path / "shared")
    one, two = filled(spark, tmp_path, ONE), filled(spark, tmp_path, TWO)
    favored(one, "s1")
    exchange.push(one, folder, ONE)
    assert one.read("dirty_days").count() == 0 and one.read("dirty_sessions").count() == 0
    state = exchange.pull(two, folder, TWO)
    assert two.read("usage", state).count() == 6 and two.read("dirty_days", state).count() == 3  # what was pulled is marked by nobody
    rows = {(r["id"], r["device_id"]): r for r in two.read("sessions").collect()}
    assert sorted(rows) == [("s1", ONE), ("s1", TWO), ("s2", TWO)] and rows[("s1", ONE)]["favorited"] and rows[("s1", ONE)]["title_orig"] == "Title s1"
    assert sorted(r["uuid"] for r in two.read("messages").filter(f"device_id = '{ONE}'").collect()) == ["as10", "as11", "as12"]
    costs = lambda t: sorted((r["uuid"], r["cost"]) for r in t.read("usage").filter(f"device_id = '{ONE}'").collect())
    assert costs(one) == costs(two)
    # the same again changes nothing, and what a user set stays
    def retitle(base):
        from pyspark.sql import functions as F

        return landing.Changes(replace={"sessions": two.read("sessions", base).withColumn("custom_title", F.lit("Mine"))})

    two.changed(retitle)
    exchange.pull(two, folder, TWO)
    assert two.read("usage").count() == 6 and two.read("messages").count() == 9 and {r["custom_title"] for r in two.read("sessions").collect()} == {"Mine"}
    # a favourite that goes takes its snapshot and, at the other device, its messages
    favored(one)
    exchange.push(one, folder, ONE)
    assert not list((tmp_path / "shared" / "sessions").rglob("*.txt"))
    exchange.pull(two, folder, TWO)
    assert not any(r["favorited"] for r in two.read("sessions").collect()) and two.read("messages").filter(f"device_id = '{ONE}'").count() == 0
    assert sorted((r["id"], r["device_id"]) for r in two.read("sessions").collect()) == [("s1", ONE), ("s1", TWO), ("s2", TWO)]


def test_snapshot_files_are_the_same_each_time(spark, tmp_path):
    tables = filled(spark, tmp_path, ONE)
    text = []
    for turn in range(2):
        folder = tmp_path / f"out{turn}"
        snapshots.write(tables.read("sessions"), tables.read("messages").repartition(3), str(folder))
        files = sorted(folder.rglob("*.txt"))
        assert len(files) == 2
        text.append([f.read_text() for f in files])
    assert text[0] == text[1]
    lines = [json.loads(x) for x in text[0][0].splitlines()]
    assert [x["type"] for x in lines] == ["session", "message", "message", "message"] and [x["ts"] for x in lines[1:]] == ["7", "8", "9"] and lines[0]["v"] == 1


def test_only_vanished_favourites_of_others_go(spark):
    rows = spark.createDataFrame([("a", ONE, True), ("b", ONE, True), ("c", ONE, False), ("d", TWO, True)], "id string, device_id string, favorited boolean")
    assert [tuple(r) for r in snapshots.vanished(rows, rows.filter("id = 'a'"), TWO).collect()] == [("b", ONE)]
    assert [r["device_id"] for r in snapshots.peers(rows, TWO).collect()] == [ONE]


def test_names_of_both_layouts(spark, tmp_path):
    assert exchange.write_name(spark, str(tmp_path), ONE, "Desk", "2024")
    assert not exchange.write_name(spark, str(tmp_path), ONE, "Desk", "2024")
    assert exchange.write_name(spark, str(tmp_path), ONE, "New desk", "2024")
    put(tmp_path, f"config/devices/{ONE}.json", {"device_id": ONE, "display_name": "Old", "first_seen": "2020"})
    put(tmp_path, f"config/devices/{TWO}.json", {"device_id": TWO, "display_name": "Two", "first_seen": "2021"})
    put(tmp_path, "config/devices/short.json", {"device_id": "short", "display_name": "No", "first_seen": "2021"})
    put(tmp_path, "config/devices_cccccccccccc.json", "broken")
    assert sorted(tuple(r) for r in exchange.names(spark, str(tmp_path)).collect()) == [(ONE, "New desk", "2024"), (TWO, "Two", "2021")]
    assert exchange.names(spark, str(tmp_path / "none")).collect() == []


def test_groups_of_all_devices(spark, tmp_path):
    group = lambda i, name, at, **more: {"id": i, "name": name, "updated_at": at, **more}
    put(tmp_path, f"data/{ONE}/groups.json", {"groups": [group("g1", "first", "2", position=3), group("g2", "old", "1"), group("g3", "tie", "5", position=1)]})
    put(tmp_path, f"data/{TWO}/groups.json", {"v": 1, "groups": [group("g2", "new", "2"), group("g3", "other", "5", position=2)]})
    put(tmp_path, "data/cccccccccccc/groups.json", {"v": 9, "groups": [group("g1", "later", "9")]})
    put(tmp_path, "data/dddddddddddd/groups.json", "broken")
    rows = exchange.groups(spark, str(tmp_path)).orderBy("position", "name", "id").collect()
    assert [(r["id"], r["name"]) for r in rows] == [("g3", "tie"), ("g1", "first"), ("g2", "new")]


def test_snapshots_of_sessions_of_any_name_go_and_older_files_are_replaced(spark, tmp_path):
    folder, ids = str(tmp_path / "shared"), ("a:b/c=%1", "d e", "f.g", "h%2")
    one, two = filled(spark, tmp_path, ONE, ids), filled(spark, tmp_path, TWO, ())
    put(tmp_path, f"shared/sessions/device_id={ONE}/id=f.g/part-0.c000.txt", {**SESSION, "id": "f.g"}, {**MESSAGE, "session_id": "f.g", "uuid": "old"})
    favored(one, *ids)
    exchange.push(one, folder, ONE)
    written = sorted(p.relative_to(tmp_path / "shared" / "sessions" / f"device_id={ONE}").as_posix() for p in (tmp_path / "shared" / "sessions").rglob("*") if p.is_file())
    assert written == ["id=a%3Ab%2Fc%3D%251/snapshot.txt", "id=d e/snapshot.txt", "id=f.g/snapshot.txt", "id=h%252/snapshot.txt"]
    exchange.pull(two, folder, TWO)
    assert sorted((r["session_id"], r["uuid"]) for r in two.read("messages").collect()) == sorted((s, f"a{s}{k}") for s in ids for k in range(3))
    favored(one, "d e")
    exchange.push(one, folder, ONE)
    assert [p.parent.name for p in (tmp_path / "shared" / "sessions").rglob("*.txt")] == ["id=d e"]
    exchange.pull(two, folder, TWO)
    assert sorted((r["id"], r["favorited"]) for r in two.read("sessions").collect()) == [(s, s == "d e") for s in sorted(ids)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calls_are_not_shuffled_by_model(spark):
    calls = spark.createDataFrame([("u", "2024-01-01T10:00:00Z", "click", "claude", "s1", 10, 1, 0, 0)], CALL)
    assert "SortMergeJoin" not in plan_of(pricing.priced(calls, pricing.seed(spark)))


def test_stored_rows_are_left_out_before_one_of_each_key_is_chosen(spark):
    from tallyforge.operators import store

    new = spark.createDataFrame([("a", ONE, 2), ("a", ONE, 1), ("b", ONE, 3), ("b", TWO, 4), ("c", ONE, None), ("c", ONE, 5)], "uuid string, device_id string, v bigint")
    stored = spark.createDataFrame([("b", ONE)], "uuid string, device_id string")
    got = store.landed(stored, new, store.USAGE_KEY)
    plan = plan_of(got)
    assert plan.index("Aggregate") < plan.index("LeftAnti") and plan.count("Exchange hashpartitioning") <= 2
    assert sorted(tuple(r) for r in got.collect()) == sorted([("a", ONE, 1), ("b", TWO, 4), ("c", ONE, None)], key=lambda r: r[:2])
