"""Views derived from aggregates: comparisons of windows, rankings, buckets and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Argument names that sum up a tool call, in the order in which they are tried; longest summary.
SUMMARY_KEYS = ("file_path", "notebook_path", "url", "pattern", "query", "command", "path", "prompt", "description")
SUMMARY_LIMIT = 96


def window_change(per_day: DataFrame) -> DataFrame:
    """Change from the first to the last day that has a point (null for fewer than two or a first of 0), and the average of these days."""
    row = per_day.agg(F.count("*").alias("days"), F.min_by("total", "day").alias("first"), F.max_by("total", "day").alias("last"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    change = F.when((F.col("days") >= 2) & (F.col("first") > 0), (F.col("last") - F.col("first")) / F.col("first"))
    return row.select(F.round(change, 6).alias("change"), F.round(F.when(F.col("days") > 0, F.col("total") / F.col("days")).otherwise(0.0), 6).alias("daily_avg"))


def day_so_far(per_hour: DataFrame, day: str, hour: int) -> DataFrame:
    """A day's tokens up to an hour against the same hours of the day before (null if that has none), and the average hour."""
    upto = F.substring("bucket", 12, 2).cast("int") <= hour
    own = F.substring("bucket", 1, 10)
    before = F.date_format(F.date_sub(F.lit(day).cast("date"), 1), "yyyy-MM-dd")
    sums = per_hour.agg(*(F.coalesce(F.sum(F.when(upto & (own == d), F.col("total"))), F.lit(0)).alias(n) for n, d in (("today", F.lit(day)), ("yesterday", before))))
    return sums.select(F.round(F.when(F.col("yesterday") > 0, (F.col("today") - F.col("yesterday")) / F.col("yesterday")), 6).alias("change"), F.round(F.col("today") / (hour + 1), 6).alias("hourly_avg"))


def by_group(sessions: DataFrame, known: DataFrame, column: str = "local_group") -> DataFrame:
    """Sessions with the group they are shown in: '' for none and for a group that isn't known any more."""
    groups = known.select(F.col("id").alias(column), F.lit(True).alias("there"))
    return sessions.join(F.broadcast(groups), column, "left").withColumn("shown_in", F.when(F.col("there"), F.col(column)).otherwise(""))


def span_parts(start: Column, end: Column) -> Column:
    """Days, hours and minutes between two timestamps; zeros if the end isn't later."""
    seconds = F.greatest(F.unix_timestamp(end) - F.unix_timestamp(start), F.lit(0))
    whole = lambda x: F.floor(x).cast("bigint")
    return F.struct(whole(seconds / 86400).alias("days"), whole(seconds % 86400 / 3600).alias("hours"), whole(seconds % 3600 / 60).alias("minutes"))


def models_used(usage: DataFrame) -> DataFrame:
    """The models of each session in the order of their first use."""
    first = usage.groupBy("session_id", "device_id", "model").agg(F.min(F.struct("ts", "uuid")).alias("first"))
    return first.groupBy("session_id", "device_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "model"))), lambda x: x["model"]).alias("models"))


def tool_summary(content: Column) -> Column:
    """One line about a tool call: the first of the usual arguments that is a text, else the first text, else the first line of what isn't an object or list.

    Of a list it is the first text. Of arguments of one name the last counts, in the place of the first; names that are whole numbers come first, in
    their order. White space around the whole goes.
    """
    trimmed = F.regexp_replace(content, r"(?U)\A[\s\uFEFF]+|[\s\uFEFF]+\z", "")
    line = _bound(trimmed, lambda text: _bound(F.schema_of_variant(F.try_parse_json(text)), lambda kind: _told(text, kind)))
    return _bound(F.substring_index(line, "\n", 1), lambda x: F.when(F.char_length(x) > SUMMARY_LIMIT, F.concat(F.substring(x, 1, SUMMARY_LIMIT - 1), F.lit("…"))).otherwise(x))


def _bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """What ``made`` makes of a value that is worked out once for a row, however often it is used."""
    return F.transform(F.array(value), made)[0]


def _told(text: Column, kind: Column) -> Column:
    """What a tool call of a kind tells, before it is cut."""
    is_list, braced = kind.startswith("ARRAY"), text.startswith("{") & text.endswith("}")
    items = F.filter(F.from_json(F.when(is_list, text), "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    first_item = F.coalesce(F.try_variant_get(F.try_element_at(items, F.lit(1)), "$", "string"), F.lit(""))

    def of_object(entries: Column) -> Column:
        is_object = kind.startswith("OBJECT") | (kind.isNull() & entries.isNotNull())  # a variant takes no name twice
        return F.when(is_object, _bound(_said(entries), _first)).when(is_list, first_item).otherwise(text)

    return _bound(F.map_entries(F.from_json(F.when(braced, text), "map<string, variant>")), of_object)


def _said(entries: Column) -> Column:
    """The texts (name, v) among an object's arguments, in the order in which they are tried."""
    last = lambda name: F.element_at(F.filter(entries, lambda e: e["key"] == name), -1)["value"]
    number = lambda name: F.when(name.rlike(r"\A(?:0|[1-9][0-9]{0,9})\z"), name.try_cast("bigint"))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    places = F.transform(names, lambda name, place: F.struct(F.coalesce(number(name), F.lit(1 << 40)).alias("n"), place.alias("p"), name.alias("name")))
    texts = F.filter(F.transform(F.array_sort(places), lambda x: F.struct(x["name"].alias("name"), last(x["name"]).alias("v"))), lambda x: F.schema_of_variant(x["v"]) == "STRING")
    return F.transform(texts, lambda x: F.struct(x["name"].alias("name"), F.try_variant_get(x["v"], "$", "string").alias("v")))


def _first(said: Column) -> Column:
    called = lambda key: F.try_element_at(F.filter(said, lambda x: x["name"] == key), F.lit(1))["v"]
    return F.coalesce(*map(called, SUMMARY_KEYS), F.try_element_at(said, F.lit(1))["v"], F.lit(""))
