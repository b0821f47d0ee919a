"""Sessions with their models, sets of sessions, projects and days: what the views of sessions are made of.

Usage is summed before it is joined. Lists that grow with the data are rows, not arrays: arrays hold models or bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expr import TOKENS, UNKNOWN_PROJECT, hit_rate, project_identity, total_tokens
from tallyforge.operators.usage import SessionFilter, UsageFilter, where_sessions, where_usage
from tallyforge.sources import scratch

#: Upper ends of the bins of turns (the first holds 0 as well) and of minutes; the last bin has none.
TURN_BINS, SPAN_BINS = (3, 8, 16), (15, 60, 180)
#: Fixed value: a cost from which on it is notable, in USD.
NOTABLE_COST = 1
_KEY = ["id", "device_id"]


def _sums() -> list[Column]:
    return [F.sum("requests").alias("requests"), *(F.sum(c).alias(c) for c in TOKENS), F.sum("cost").alias("cost")]


def _rate() -> Column:
    return hit_rate(F.col("cache_read"), F.col("input"), F.col("cache_creation"))


def session_stats(chosen: DataFrame, usage: DataFrame, messages: DataFrame) -> DataFrame:
    """chosen with the project for project_dir, requests, tokens, cost, hit rate, messages and models (model, tokens; most tokens first)."""
    own = usage.withColumnRenamed("session_id", "id")
    per_model = own.groupBy(*_KEY, "model").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in TOKENS), F.sum("cost").alias("cost"))
    models = F.collect_list(F.struct((-total_tokens()).alias("o"), "model"))
    sums = per_model.groupBy(*_KEY).agg(*_sums(), F.transform(F.array_sort(models), lambda m: F.struct(m["model"].alias("model"), (-m["o"]).alias("tokens"))).alias("models"))
    counts = messages.withColumnRenamed("session_id", "id").groupBy(*_KEY).agg(F.count("*").alias("messages"))
    joined = chosen.withColumn("project", project_identity("project_dir")).drop("project_dir").join(sums, _KEY, "left").join(counts, _KEY, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("requests", "messages", *TOKENS, "cost")}
    kept = F.filter("models", lambda m: (m["model"] != "") | (m["tokens"] != 0))
    none = F.array().cast("array<struct<model:string,tokens:bigint>>")
    return joined.withColumns({**zero, "models": F.coalesce(kept, none)}).withColumn("hit_rate", _rate())


def _span(start: str = "started_at", end: str = "last_active_at") -> Column:
    """Milliseconds of a session; null unless there are some."""
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    span = millis(end) - millis(start)
    return F.when(span > 0, span)


def _bins(value: Column, ends: tuple[int, ...], inclusive: bool) -> Column:
    """How many values lie in each bin, as an array; nulls lie in none."""
    below = [value <= e if inclusive else value < e for e in ends]
    conditions = [below[0], *(~a & b for a, b in zip(below, below[1:])), ~below[-1]]
    return F.array(*(F.count_if(c) for c in conditions))


def session_set(stats: DataFrame) -> DataFrame:
    """One row about a set of sessions (of ``session_stats``): sums, pooled hit rate, models with tokens and sessions, bins of minutes, total span, last activity.

    A session's own values go with the first of its models, so that one pass over the sessions gives all. The hit
    rate is null where nothing could be cached, the span where no session has one.
    """
    rows = stats.select("*", F.posexplode_outer("models").alias("place", "m")).withColumn("own", F.coalesce(F.col("place"), F.lit(0)) == 0)
    own = lambda c: F.when(F.col("own"), c)
    minutes = own(_span()) / 60_000
    per_model = rows.groupBy("m.model").agg(
        F.count_if("own").alias("sessions"), *(F.sum(own(F.col(c))).alias(c) for c in ("requests", "messages", *TOKENS, "cost")), F.sum(own(_span())).alias("span"),
        _bins(minutes, SPAN_BINS, False).alias("bins"), F.max(own(F.col("last_active_at"))).alias("last_active_at"), F.sum("m.tokens").alias("tokens"), F.count("*").alias("users"),
    )
    used = F.collect_list(F.when(F.col("model").isNotNull(), F.struct((-F.col("tokens")).alias("o"), "model", F.col("users").alias("sessions"))))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = per_model.agg(
        *(total(c) for c in ("sessions", "requests", "messages", *TOKENS, "cost")), F.sum("span").alias("total_span_ms"), F.max("last_active_at").alias("last_active_at"),
        F.array(*(F.coalesce(F.sum(F.col("bins")[k]), F.lit(0)) for k in range(len(SPAN_BINS) + 1))).alias("span_bins"),
        F.transform(F.array_sort(used), lambda m: F.struct(m["model"].alias("model"), (-m["o"]).alias("tokens"), m["sessions"].alias("sessions"))).alias("models"),
    )
    pool = F.col("input") + F.col("cache_creation") + F.col("cache_read")
    return out.withColumn("hit_rate", F.when(pool > 0, _rate()))


def session_section(rows: DataFrame) -> DataFrame:
    """One row about sessions with usage (agent_type, started_at, last_active_at, turns, tokens): counts, shares, longest span, average and bins of turns, all tokens (1 at least)."""
    agents = F.count_if(F.coalesce("agent_type", F.lit("")) != "")
    n = F.count("*")
    return rows.agg(
        n.alias("sessions"), agents.alias("subagents"), F.round(F.when(n > 0, agents / n), 6).alias("subagent_share"), F.max(_span()).alias("longest_ms"),
        F.round(F.when(n > 0, F.sum("turns") / n), 6).alias("avg_turns"), _bins(F.col("turns"), TURN_BINS, True).alias("turn_bins"), F.greatest(F.coalesce(F.sum(total_tokens()), F.lit(0)), F.lit(1)).alias("total"),
    )


def top_sessions(rows: DataFrame, n: int) -> DataFrame:
    """The n sessions with most tokens, with their share of all."""
    every = rows.agg(F.greatest(F.coalesce(F.sum(total_tokens()), F.lit(0)), F.lit(1))).scalar()
    top = rows.select("session_id", "device_id", "title", total_tokens().alias("tokens")).orderBy(F.desc("tokens"), "session_id", "device_id").limit(n)
    return top.withColumn("share", F.round(F.col("tokens") / every, 6))


def project_nodes(stats: DataFrame) -> DataFrame:
    """A row for each project: sessions, tokens and last activity."""
    return stats.groupBy("project").agg(F.count("*").alias("sessions"), F.sum(total_tokens()).alias("tokens"), F.max("last_active_at").alias("newest"))


def node_rows(stats: DataFrame) -> DataFrame:
    """Sessions with their project's row, for an order by newest project and, within it, newest session."""
    nodes = project_nodes(stats).select("project", F.col("sessions").alias("node_sessions"), F.col("tokens").alias("node_tokens"), F.col("newest").alias("node_newest"))
    return stats.join(nodes, "project")


def project_ranking(per_project: DataFrame, n: int) -> DataFrame:
    """The n known projects with most tokens (place 1 to n), the other known ones as one row (n + 1), the unknown one (no place), each with its share of all tokens.

    known: how many are known; top3_share: the share of the first three, null if fewer are known.
    """
    is_known = F.col("project") != UNKNOWN_PROJECT
    first = lambda k: per_project.filter(is_known).orderBy(F.desc("total"), "project").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("total"), "project"))  # n rows
    placed = first(n).select("project", place.alias("place"))
    spot = F.coalesce("place", F.when(is_known, n + 1))
    rows = per_project.join(placed, "project", "left").withColumn("spot", spot)
    name = F.when(F.col("spot") == n + 1, "(rest)").otherwise(F.col("project"))
    sums = rows.groupBy(F.col("spot").alias("place"), name.alias("project")).agg(F.count("*").alias("projects"), *(F.sum(c).alias(c) for c in ("total", "requests", "sessions", "cost")))
    every = per_project.agg(F.greatest(F.coalesce(F.sum("total"), F.lit(0)), F.lit(1))).scalar()
    known = per_project.filter(is_known).agg(F.count("*")).scalar()
    three = first(3).agg(F.sum("total")).scalar()
    return sums.withColumns({"share": F.round(F.col("total") / every, 6), "known": known}).withColumn("top3_share", F.when(F.col("known") >= 3, F.round(three / every, 6)))


def project_stats(sessions: DataFrame, usage: DataFrame, messages: DataFrame, f: SessionFilter) -> DataFrame:
    """Sessions by project, those without usage too, and a row for usage without any session; order: newest first, then by project.

    The filter decides which sessions count, with all their usage. Usage without a session has no favourites, groups or
    texts, so a filter by these leaves its row out; a filter by project doesn't, and its time, device, source and model
    apply to the calls themselves. Usage of a session that is left out belongs to a session: it isn't in that row.
    """
    chosen = session_stats(where_sessions(sessions, usage, messages, f), usage, messages)
    count = lambda rows, n, last: [n.alias("sessions"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*TOKENS, "cost")), F.max(last).alias("last_active_at")]
    known = chosen.groupBy("project").agg(*count(chosen, F.count("*"), "last_active_at"), F.sum("requests").alias("requests"))
    asked = f.favorited is True or f.group is not None or bool(f.search and f.search.strip())
    if not asked:
        loose = where_usage(usage, sessions, UsageFilter(f.since, f.until, f.model, f.source, f.device, UNKNOWN_PROJECT))
        row = loose.agg(*count(loose, F.lit(0).cast("bigint"), "ts"), F.count("*").alias("requests")).filter("requests > 0").withColumn("project", F.lit(UNKNOWN_PROJECT))
        known = known.unionByName(row)
    return known.withColumns({"total": total_tokens(), "hit_rate": _rate()})


def group_counts(chosen: DataFrame, track: str) -> DataFrame:
    """Sessions of each group of a track (a column of group ids) and of all: group_id is null for all."""
    per = chosen.groupBy(F.col(track).alias("group_id")).agg(F.count("*").alias("n"))
    return per.unionByName(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("group_id", F.lit(None).cast("string")))


def local_day(tz: str, stamp: str = "ts") -> Column:
    return F.date_format(F.from_utc_timestamp(F.col(stamp).cast("timestamp"), tz), "yyyy-MM-dd")


def day_groups(rows: DataFrame, day: Column, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(groups, rows): consecutive rows of one day in an order over the whole list, and the rows with their group.

    The list is sorted in ranges. In a range each row that has another day than the one before starts a run; runs, of
    which there are few more than days and ranges, are then joined where one goes on in the next range. Groups have
    ordinal (from 1), day and n.
    """
    keys = [f"_o{k}" for k in range(len(order))]
    plain = rows.withColumns({"_day": day, **{k: o for k, o in zip(keys, order)}})
    ranged = plain.repartitionByRange(*(F.col(k) for k in keys)).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*keys)
    before = F.lag("_day").over(own)
    marked = ranged.withColumn("_new", (F.row_number().over(own) == 1) | ~before.eqNullSafe(F.col("_day")))
    marked = marked.withColumn("_run", F.sum(F.col("_new").cast("bigint")).over(own))
    marked = scratch.stored(marked)  # the ranges are sampled anew each time they are worked out
    runs = marked.groupBy("_part", "_run").agg(F.first("_day").alias("_day"), F.count("*").alias("n"), F.min(F.struct(*keys)).alias("_first"))
    few = Window.orderBy("_first")  # a row for each run
    starts = (F.row_number().over(few) == 1) | ~F.lag("_day").over(few).eqNullSafe(F.col("_day"))
    numbered = runs.withColumn("ordinal", F.sum(starts.cast("bigint")).over(few))
    groups = numbered.groupBy("ordinal").agg(F.first("_day").alias("day"), F.sum("n").alias("n"))
    placed = marked.join(numbered.select("_part", "_run", "ordinal"), ["_part", "_run"]).drop("_part", "_run", "_new", "_day", *keys)
    return groups, placed


def notable(cost: Column) -> Column:
    return F.coalesce(cost >= NOTABLE_COST, F.lit(False))


def per_turn(requests: Column, turns: Column) -> Column:
    """Requests for each turn; null without turns."""
    return F.when(turns > 0, F.round(requests / turns, 6))
