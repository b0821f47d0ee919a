"""Writes as set operations: what lands, what is corrected, what is deleted, what changed, what is exported.

Functions take the stored and the new rows and return new tables or changes; the caller writes them. Every join
is by key; nothing is collected. Lists that a caller gives (ids, devices) are small DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.expr import utc_day
from tallyforge.operators.pricing import priced, rebilled

USAGE_KEY, SESSION_KEY = ["uuid", "device_id"], ["id", "device_id"]
SYSTEM = ("source", "project_dir", "title_orig", "started_at", "last_active_at", "agent_type", "parent_session_id")
USER = {"custom_title": "", "favorited": False, "synced_group_id": "", "local_group_id": "", "excluded": False}


def once(rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """One row of each key: the first by ``order``, or by the other columns."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg((F.min(F.struct(*rest)) if order is None else F.min_by(F.struct(*rest), order)).alias("r"))
    return best.select(*keys, "r.*").select(*rows.columns)


def landed(stored: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The new rows that aren't stored yet; stored rows are never replaced.

    New rows are shuffled once, for the join and for the choice of one row of each key; rows that are stored aren't sorted for that choice.
    Stored keys are never broadcast: their files are far smaller than they are in memory.
    """
    left = new.repartition(*keys).join(stored.select(*keys).hint("merge"), keys, "left_anti")
    return once(left, keys, order).select(*new.columns)


def recorded(calls: DataFrame, rates: DataFrame, device_id: str) -> DataFrame:
    """Calls as rows of the store: with device, UTC day, pricing key and cost."""
    return priced(calls.withColumns({"device_id": F.lit(device_id), "day": utc_day(F.col("timestamp"))}), rates)


def corrected(stored: DataFrame, corrections: DataFrame, columns: tuple[str, ...] = ("model", "model_key", "cost")) -> DataFrame:
    """The stored rows with model and price of their corrections, where their model is unknown; no other row changes."""
    new = once(corrections.select(*USAGE_KEY, *columns), USAGE_KEY).select(*USAGE_KEY, *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = stored.join(new, USAGE_KEY, "left")
    due = (F.col("model") == "unknown") & F.col("new_model").isNotNull()
    changed = {c: F.when(due, F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.select(*USAGE_KEY, *(changed.get(c, F.col(c)).alias(c) for c in stored.columns if c not in USAGE_KEY)).select(*stored.columns)


def dirty_days(rows: DataFrame) -> DataFrame:
    """The days of each device that rows touch."""
    return rows.select("device_id", "day").distinct()


def dirty_sessions(rows: DataFrame) -> DataFrame:
    return rows.select("device_id", "session_id").distinct()


def cleared(dirty: DataFrame, exported: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """What stays dirty: marks whose rows aren't as many now as were exported (keys and n)."""
    same = exported.join(current.groupBy(*keys).agg(F.count("*").alias("now")), keys, "left").filter(F.col("n") == F.coalesce("now", F.lit(0)))
    return dirty.join(same.select(*keys), keys, "left_anti")


def upserted_sessions(stored: DataFrame, new: DataFrame, with_favorites: bool = False) -> DataFrame:
    """Sessions with the system's columns refreshed and the user's kept; with_favorites takes favourites and synced groups as well."""
    refreshed = [*SYSTEM, *(("favorited", "synced_group_id") if with_favorites else ())]
    columns = [*SYSTEM, *USER]
    side = once(new, SESSION_KEY).select(*SESSION_KEY, *(F.col(c).alias(f"new_{c}") for c in refreshed))
    joined = stored.select(*SESSION_KEY, *columns).join(side, SESSION_KEY, "full_outer")
    value = {c: F.coalesce(*([f"new_{c}"] if c in refreshed else []), c, *([F.lit(USER[c])] if c in USER else [])) for c in columns}
    return joined.select(*SESSION_KEY, *(value[c].alias(c) for c in columns))


def user_columns(sessions: DataFrame, overlay: DataFrame) -> DataFrame:
    """Sessions with what users set: overlay has id, device_id, column, value and updated_at; the newest setting of a column counts."""
    newest = overlay.groupBy(*SESSION_KEY).pivot("column", list(USER)).agg(F.max_by("value", "updated_at")).toDF(*SESSION_KEY, *(f"set_{c}" for c in USER))
    kinds = dict(sessions.dtypes)
    joined = sessions.join(newest, SESSION_KEY, "left")
    return joined.select(*(F.coalesce(F.col(f"set_{c}").cast(kinds[c]), c).alias(c) if c in USER else F.col(c) for c in sessions.columns))


def reconciled(sessions: DataFrame, messages: DataFrame, seen: DataFrame, source: str, device_id: str) -> tuple[DataFrame, DataFrame]:
    """Sessions of a source and device, and their messages, without those that weren't seen; nothing goes if nothing was seen."""
    gone = sessions.filter((F.col("source") == source) & (F.col("device_id") == device_id)).select(*SESSION_KEY).join(seen.select("id"), "id", "left_anti").withColumn("any", F.lit(1)).join(seen.limit(1).select(F.lit(1).alias("any")), "any", "left_semi").drop("any")
    left = messages.join(gone.withColumnRenamed("id", "session_id"), ["session_id", "device_id"], "left_anti")
    return sessions.join(gone, SESSION_KEY, "left_anti").select(*sessions.columns), left.select(*messages.columns)


def soft_deleted(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """Sessions with those of the given keys excluded and no longer favourites."""
    joined = sessions.join(keys.select(*SESSION_KEY).distinct().withColumn("hit", F.lit(True)), SESSION_KEY, "left")
    hit = F.coalesce("hit", F.lit(False))
    return joined.withColumns({"excluded": F.col("excluded") | hit, "favorited": F.col("favorited") & ~hit}).select(*sessions.columns)


def unfavorited(sessions: DataFrame, messages: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions with those of the given keys no longer favourites, and messages without theirs."""
    own = keys.select(*SESSION_KEY).distinct()
    joined = sessions.join(own.withColumn("hit", F.lit(True)), SESSION_KEY, "left").withColumn("favorited", F.col("favorited") & F.col("hit").isNull())
    return joined.select(*sessions.columns), messages.join(own.withColumnRenamed("id", "session_id"), ["session_id", "device_id"], "left_anti").select(*messages.columns)


def repriced(rates: DataFrame, new: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rates with new ones in place of old ones and without deleted ones."""
    return rates.join(new.select("model_key"), "model_key", "left_anti").unionByName(once(new, ["model_key"])).join(deleted.select("model_key"), "model_key", "left_anti").select(*rates.columns)


def with_rebills(stored: DataFrame, rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the store with costs of calls that had none and have one now, the days that this touches)."""
    new = rebilled(stored, rates).select(*USAGE_KEY, "day", F.col("cost").alias("new_cost"))
    kind = dict(stored.dtypes)["cost"]
    joined = stored.join(new.drop("day"), USAGE_KEY, "left").withColumn("cost", F.coalesce(F.col("new_cost").cast(kind), "cost"))
    return joined.select(*stored.columns), dirty_days(new)


def discovered(devices: DataFrame, usage: DataFrame) -> DataFrame:
    """Devices with those added that have usage and aren't registered, first seen at their earliest call."""
    found = usage.join(devices.select("device_id"), "device_id", "left_anti").groupBy("device_id").agg(F.min("timestamp").alias("first_seen"))
    return devices.unionByName(found.select("device_id", F.lit("").alias("display_name"), F.lit(False).alias("is_self"), "first_seen"))


def device_names(devices: DataFrame, aliases: DataFrame, synced: DataFrame) -> DataFrame:
    """Each device's name: its alias, else its synced name, else one of the first six characters of its id."""
    side = lambda df, name: df.select("device_id", F.nullif(F.trim("display_name"), F.lit("")).alias(name))
    joined = devices.select("device_id").join(side(aliases, "alias"), "device_id", "left").join(side(synced, "synced"), "device_id", "left")
    return joined.select("device_id", F.coalesce("alias", "synced", F.concat(F.lit("Device-"), F.substring("device_id", 1, 6))).alias("name"))


def backed(devices: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Devices without the others that no artifact backs any more."""
    return devices.filter("is_self").unionByName(devices.filter("NOT is_self").join(artifacts.select("device_id").distinct(), "device_id", "left_semi").select(*devices.columns))


def presence_mismatches(on_disk: DataFrame, favorites: DataFrame) -> DataFrame:
    """Sessions that have a snapshot and are no favourites, or the other way round."""
    both = on_disk.select(*SESSION_KEY, F.lit(True).alias("file")).join(favorites.select(*SESSION_KEY, F.lit(True).alias("favorite")), SESSION_KEY, "full_outer")
    return both.select(*SESSION_KEY, F.when(F.col("favorite").isNull(), "remove").when(F.col("file").isNull(), "write").alias("todo")).filter("todo IS NOT NULL")


def export_days(usage: DataFrame, days: DataFrame, path: str) -> None:
    """Writes the rows of the given days as JSON lines, one folder for each device and day, in uuid order; other days stay.

    A day that has no rows any more loses its folder's files: it is written empty.
    """
    rows = usage.join(days, ["device_id", "day"], "left_semi").withColumns({c: F.col(c).cast("string") for c, k in usage.dtypes if k.startswith("decimal")})
    empty = days.join(usage.select("device_id", "day").distinct(), ["device_id", "day"], "left_anti")
    sorted_rows = rows.repartition("device_id", "day").sortWithinPartitions("device_id", "day", "uuid")
    sorted_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("device_id", "day").json(path)
    spark = usage.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in empty.toLocalIterator():  # folders of emptied days: as many as days that lost all rows
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"device_id={r['device_id']}/day={r['day']}"), True)


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Exported rows of all devices; blank and malformed lines are skipped; device ids are 12 hexadecimal digits."""
    found = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return found.filter(F.col("device_id").rlike("^[0-9a-f]{12}$"))


def price_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rates of documents that are a list of models or hold one under ``models``."""
    entry = "struct<model_key: string, input_per_million: string, output_per_million: string, cache_creation_per_million: string, cache_read_per_million: string>"
    text = spark.read.text(path, wholetext=True)
    models = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{entry}>")).otherwise(F.from_json("value", f"struct<models: array<{entry}>>")["models"])
    each = text.select(F.explode(models).alias("m")).select("m.*").filter("model_key <> ''")
    return each.select("model_key", *(F.coalesce(F.col(f"{c}_per_million").try_cast("decimal(16,10)"), F.lit(0).cast("decimal(16,10)")).alias(f"{c}_rate") for c in ("input", "output", "cache_creation", "cache_read")))


def price_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rates of a sheet keyed by model with costs per token; samples and models without a positive input cost are skipped."""
    costs = "struct<input_cost_per_token: double, output_cost_per_token: double, cache_creation_input_token_cost: double, cache_read_input_token_cost: double>"
    each = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {costs}>")).alias("model", "c"))
    rate = lambda name: F.round(F.coalesce(F.col(f"c.{name}"), F.lit(0.0)) * 1e6, 10).cast("decimal(16,10)")
    kept = each.filter(~F.col("model").contains("sample") & (F.col("c.input_cost_per_token") > 0))
    return kept.select(F.col("model").alias("model_key"), rate("input_cost_per_token").alias("input_rate"), rate("output_cost_per_token").alias("output_rate"), rate("cache_creation_input_token_cost").alias("cache_creation_rate"), rate("cache_read_input_token_cost").alias("cache_read_rate"))
