"""Session statistics against plain Python, runs of days over ranges, tool summaries, local days."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.operators import derived, session_stats as st


def test_day_groups_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("ab")) for k in range(300)] + [(k, "a") for k in range(300, 900)]
    df = spark.createDataFrame(rows, "k bigint, d string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        groups, placed = st.day_groups(df, F.col("d"), -F.col("k"))
        wanted = [(d, len(list(g))) for d, g in groupby(sorted(rows, reverse=True), lambda r: r[1])]
        assert [(r["day"], r["n"]) for r in groups.orderBy("ordinal").collect()] == wanted
        by = [r["ordinal"] for r in placed.orderBy(F.desc("k")).collect()]
        assert by == [i + 1 for i, (_, n) in enumerate(wanted) for _ in range(n)] and placed.columns == ["k", "d", "ordinal"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert st.day_groups(df.limit(0), F.col("d"), F.col("k"))[0].collect() == []


USAGE = "session_id string, device_id string, model string, input bigint, output bigint, cache_creation bigint, cache_read bigint, cost decimal(10,4)"


def test_session_stats_and_sets(spark):
    t = datetime(2024, 1, 1)
    sessions = spark.createDataFrame(
        [("a", "d", "/p/.claude/worktrees/x", t, t + timedelta(minutes=15)), ("b", "d", "/p", t, t), ("c", "d", "", t, t + timedelta(hours=3)), ("a", "e", "/q", t, t + timedelta(minutes=1))],
        "id string, device_id string, project_dir string, started_at timestamp_ntz, last_active_at timestamp_ntz",
    )
    one = lambda s, d, m, n: (s, d, m, n, 1, 2, 3, None)
    usage = spark.createDataFrame([one("a", "d", "x", 5), one("a", "d", "y", 50), one("a", "d", "x", 6), one("a", "e", "x", 1), ("c", "d", "", 0, 0, 0, 0, None), one("gone", "d", "x", 9)], USAGE)
    messages = spark.createDataFrame([("a", "d"), ("a", "d"), ("b", "d"), ("zz", "d")], "session_id string, device_id string")
    stats = st.session_stats(sessions, usage, messages)
    got = {(r["id"], r["device_id"]): r for r in stats.collect()}
    a = got[("a", "d")]
    assert (a["project"], a["requests"], a["messages"], a["input"]) == ("/p", 3, 2, 61) and [tuple(m) for m in a["models"]] == [("y", 56), ("x", 23)]
    assert got[("b", "d")]["models"] == [] and got[("b", "d")]["messages"] == 1 and got[("c", "d")]["models"] == [] and got[("c", "d")]["requests"] == 1
    row = st.session_set(stats).first()
    assert (row["sessions"], row["requests"], row["messages"], row["input"], row["total_span_ms"]) == (4, 5, 3, 62, (15 + 180 + 1) * 60_000)
    assert list(row["span_bins"]) == [1, 1, 0, 1] and [tuple(m) for m in row["models"]] == [("y", 56, 1), ("x", 30, 2)]
    assert row["hit_rate"] == round(12 / (62 + 8 + 12), 6) and row["last_active_at"] == t + timedelta(hours=3)
    empty = st.session_set(stats.limit(0)).first()
    assert (empty["sessions"], empty["hit_rate"], empty["total_span_ms"], empty["last_active_at"], list(empty["span_bins"]), empty["models"]) == (0, None, None, None, [0, 0, 0, 0], [])
    nodes = {r["project"]: (r["sessions"], r["tokens"]) for r in st.project_nodes(stats).collect()}
    assert nodes == {"/p": (2, 79), "/q": (1, 7), "": (1, 0)}


def test_session_section_bins(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(f"s{n}", "d", "t", "x" if n == 0 else "", t, t + timedelta(milliseconds=n), n, 0, 0, 0, 10) for n in (0, 3, 4, 8, 9, 16, 17)], "session_id string, device_id string, title string, agent_type string, started_at timestamp_ntz, last_active_at timestamp_ntz, turns bigint, input bigint, output bigint, cache_creation bigint, cache_read bigint")
    row = st.session_section(rows).first()
    assert list(row["turn_bins"]) == [2, 2, 2, 1] and row["longest_ms"] == 17 and row["subagents"] == 1 and row["total"] == 70 and row["avg_turns"] == round(57 / 7, 6)
    none = st.session_section(rows.limit(0)).first()
    assert (none["sessions"], none["subagent_share"], none["longest_ms"], none["avg_turns"], none["total"]) == (0, None, None, None, 1)
    assert [(r["session_id"], r["share"]) for r in st.top_sessions(rows, 2).collect()] == [("s0", round(1 / 7, 6)), ("s16", round(1 / 7, 6))]


def test_ranking(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "project string, total bigint, requests bigint, sessions bigint, cost double")
    got = {r["project"]: r for r in st.project_ranking(rows(("a", 5, 1, 1, 1.0), ("b", 9, 1, 1, 0.5), ("c", 1, 2, 3, 0.25), ("__unknown__", 100, 7, 0, 0.0), ("d", 2, 1, 1, 0.25)), 2).collect()}
    assert {p: r["place"] for p, r in got.items()} == {"b": 1, "a": 2, "(rest)": 3, "__unknown__": None}
    assert (got["(rest)"]["projects"], got["(rest)"]["total"], got["(rest)"]["cost"]) == (2, 3, 0.5) and got["a"]["top3_share"] == round(16 / 117, 6) and got["a"]["known"] == 4
    few = st.project_ranking(rows(("a", 0, 1, 1, 0.0), ("b", 0, 1, 1, 0.0)), 5).collect()
    assert {r["top3_share"] for r in few} == {None} and {r["share"] for r in few} == {0.0}


@pytest.mark.parametrize(
    ("content", "summary"),
    [
        ('{"file_path":"src/a.ts","content":"x"}', "src/a.ts"), ('{"content":"x","command":"ls","path":"p"}', "ls"), ('{"n":{"label":"x"},"label":5,"z":"hi"}', "hi"), ('{"a":"x","a":"y"}', "y"),
        ('{"a\\"b":"q"}', "q"), ('{"b":"x","1":"y"}', "y"), ('{"10":"ten","9":"nine","a":"z"}', "nine"), ("{}", ""), ("", ""), ("  \n ", ""), ('{"n":1,"o":{"path":"no"}}', ""), ('["x","y"]', "x"), ("[1,2]", ""), ("[]", ""),
        ("plain text\nsecond", "plain text"), ('"text"', '"text"'), ("null", "null"), ("12", "12"), ('{"path":null,"url":7,"query":"q"}', "q"), ('{"a":"one\\ntwo"}', "one"), ("{broken", "{broken"), (' {"path":" p "} ', " p "),
        ("x" * 97, "x" * 95 + "…"), ("x" * 96, "x" * 96), ('{"path":"' + "é" * 200 + '"}', "é" * 95 + "…"), ('{"path":""}', ""), ('{"path":"","url":"u"}', "u"), ('{"a.b":"dot","$":"d"}', "dot"),
    ],
)
def test_tool_summaries(spark, content, summary):
    if content == '{"path":"","url":"u"}':  # the first of the names that is a text counts, whichever comes first in the call
        summary = "u"
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(derived.tool_summary(F.col("c"))).first()[0] == summary


def test_local_days():
    now = datetime(2024, 3, 10, 3, 0, tzinfo=timezone.utc)
    assert dates.preset_days("today", now, "America/New_York") == ("2024-03-09", "2024-03-09")
    assert dates.preset_days("7d", now, "UTC") == ("2024-03-04", "2024-03-10") and dates.preset_days("30d", now, "UTC")[0] == "2024-02-10"
    assert dates.preset_days("all", now, "UTC") == ("", "") and dates.effective_days("custom", "a", "b", now, "UTC") == ("a", "b") and dates.effective_days("7d", "a", "b", now, "UTC") == ("2024-03-04", "2024-03-10")
    assert dates.day_bounds("2024-03-10", "2024-03-10", "America/New_York") == ("2024-03-10T05:00:00.000Z", "2024-03-11T03:59:59.999Z")
    assert dates.day_bounds("2024-11-03", "2024-11-03", "America/New_York") == ("2024-11-03T04:00:00.000Z", "2024-11-04T04:59:59.999Z")
    assert dates.day_bounds("2024-01-20", "", "Asia/Shanghai") == ("2024-01-19T16:00:00.000Z", None)
    assert dates.day_bounds("2018-11-04", "2018-11-04", "America/Sao_Paulo")[0] == "2018-11-04T03:00:00.000Z"  # midnight is skipped there
    assert dates.window_days("2024-03-01", "2024-03-10") == 10 and dates.window_days("", "2024-03-10") is None


def test_notable_and_per_turn(spark):
    df = spark.createDataFrame([(1.0, 6, 4), (0.99, 6, 0), (None, 6, 3)], "cost double, r bigint, t bigint")
    assert [tuple(r) for r in df.select(st.notable(F.col("cost")), st.per_turn(F.col("r"), F.col("t"))).collect()] == [(True, 1.5), (False, None), (False, 2.0)]


def test_a_summary_parses_a_call_once(spark):
    df = spark.range(3).select(F.concat(F.lit('{"a":"'), "id", F.lit('"}')).alias("c")).select(derived.tool_summary(F.col("c")).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= 2
    assert [r["x"] for r in df.collect()] == ["0", "1", "2"]
