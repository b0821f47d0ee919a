"""Which log files there are, which of them are due, and their lines, read by tasks; nothing is read of the others.

Listings hold metadata alone. A source says where its files lie (folders, names, depth) and how each is gated: by the
lines read before, or read whole whenever it is newer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.sources import ranges, scratch
from tallyforge.sources.logs import lossy, path_key, stem

#: Bytes of a file's head.
HEAD = 64 << 10
LINES, WHOLE = "lines", "whole"
_LINE = "path string, first bigint, k bigint, ended boolean, value string"
_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@dataclass(frozen=True)
class Shape:
    """A folder below a home, the names of its files (patterns with ``*``), their depth below it (1: in it), their own folder's name."""

    root: str
    names: tuple[str, ...]
    depth: int | None = None
    parent: str | None = None


@dataclass(frozen=True)
class Source:
    """A kind of logs: its shapes, the names of files that are read whole, and where a session's id is: stem, head or folder."""

    name: str
    shapes: tuple[Shape, ...]
    whole: tuple[str, ...] = ()
    session: str = "stem"


#: Where the tools keep their logs below a user's home.
SOURCES = {
    s.name: s
    for s in (
        Source("claude", (Shape(".claude/projects", ("*.jsonl",)),)),
        Source("codex", (Shape(".codex/sessions", ("*.jsonl",), 4), Shape(".codex/archived_sessions", ("*.jsonl",), 1)), session="head"),
        Source("gemini", (Shape(".gemini/tmp", ("session-*.json",), 3, "chats"),), whole=("*.json",), session="head"),
        Source("grok", tuple(Shape(f".grok/{d}", ("summary.json", "chat_history.jsonl", "updates.jsonl"), 9) for d in ("sessions", "archived_sessions")), whole=("summary.json",), session="folder"),
    )
}


def _like(names: tuple[str, ...]) -> Column:
    """Whether a file's name is one of some patterns."""
    name = F.substring_index("path", "/", -1)
    pattern = "|".join(n.replace(".", r"\.").replace("*", ".*") for n in names)
    return name.rlike(rf"\A(?:{pattern})\z") if names else F.lit(False)


def _found(spark: SparkSession, root: str) -> DataFrame:
    """The files below a folder; Spark lists its folders in a few tasks, not in one for each folder."""
    own = spark.conf.get(_LISTERS)
    spark.conf.set(_LISTERS, str(min(int(own), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    finally:
        spark.conf.set(_LISTERS, own)


def listing(spark: SparkSession, home: str, source: Source) -> DataFrame:
    """(path, modified, length, gate) of a source's files below a home, as of now; folders that aren't there have none.

    It is stored, so that all that is made of it goes by one listing.
    """
    out = spark.createDataFrame([], "path string, modified timestamp, length bigint")
    for shape in source.shapes:
        root = f"{home.rstrip('/')}/{shape.root}"
        try:
            found = _found(spark, root)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        below = F.substring_index("path", f"{shape.root}/", -1)
        own = found.select("path", F.col("modificationTime").alias("modified"), "length").filter(_like(shape.names))
        if shape.depth is not None:
            own = own.filter(F.size(F.split(below, "/")) <= shape.depth)
        if shape.parent:
            own = own.filter(F.element_at(F.split("path", "/"), -2) == shape.parent)
        out = out.unionByName(own)
    return scratch.stored(out.coalesce(spark.sparkContext.defaultParallelism).withColumn("gate", F.when(_like(source.whole), WHOLE).otherwise(LINES)))


def due(found: DataFrame, cursors: DataFrame) -> DataFrame:
    """The files of a listing that are new or newer than their cursor (path_key, modified, line), with ``read_to``."""
    known = cursors.select("path_key", F.col("modified").alias("read_at"), F.col("line").alias("read_to"))
    keyed = found.withColumn("path_key", path_key("path")).join(known, "path_key", "left")
    return keyed.filter(F.col("read_at").isNull() | (F.col("modified") > F.col("read_at"))).select(*found.columns, F.coalesce("read_to", F.lit(0)).cast("bigint").alias("read_to"))


def _lines(batches):
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("k", pa.int64()), ("ended", pa.bool_()), ("value", pa.string())])
    for batch in batches:
        for path, first, last, length in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "last", "length"))):
            system, own = ranges.located(path)
            rows, held = [], 0
            for k, (at, line) in enumerate(ranges.lines(system, own, first, last, with_rest=last == length)):
                rows.append((path, first, k, at + len(line) < last, line.decode("utf-8", "replace")))
                held += len(line)
                if held > ranges.BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_lines(files: DataFrame, step: int = ranges.RANGE) -> tuple[DataFrame, DataFrame]:
    """Lines (path, after, line, value) of files (path, modified, length, read_to), and their cursors after that.

    A last line without a line break is read and not passed. A file with fewer lines than were read before was cut: it
    is read again from its start. Blank lines count and aren't given. Files are read once, into a table that both
    results are made of, with as many parts as shuffles have.
    """
    spark = files.sparkSession
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step).cast("bigint"))
    cut = files.filter("length > 0").select("path", "length", F.explode(starts).alias("first")).withColumn("last", F.least(F.col("first") + step, F.col("length")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = scratch.stored(cut.repartition(n, "path", "first").mapInArrow(_lines, _LINE))
    sizes = scratch.stored(read.groupBy("path", "first").agg(F.count("*").alias("n"), F.count_if("ended").alias("whole")))
    order = Window.partitionBy("path").orderBy("first")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("path")
    placed = sizes.withColumns({"before": before, "lines": F.sum("n").over(whole), "passed": F.sum("whole").over(whole)})
    after = F.when(F.col("lines") < F.col("read_to"), 0).otherwise(F.col("read_to")).cast("bigint")
    placed = placed.join(files.select("path", "read_to"), "path").select("path", "first", "before", after.alias("after"))
    value = F.trim(F.regexp_replace("value", r"\A\s+|\s+\z", ""))
    lines = read.join(placed, ["path", "first"]).select("path", "after", (F.col("before") + F.col("k") + 1).alias("line"), value.alias("value")).filter("value <> ''")
    counts = sizes.groupBy("path").agg(F.sum("whole").alias("passed"))
    cursors = files.join(counts, "path", "left").select(path_key("path").alias("path_key"), "modified", F.coalesce("passed", F.lit(0)).cast("bigint").alias("line"))
    return lines, cursors


def read_whole(files: DataFrame) -> DataFrame:
    """(path, value) of files that hold one object each; broken UTF-8 is replaced."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                system, own = ranges.located(path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([ranges.head(system, own, length)], pa.binary())], ["path", "content"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "length").repartition(n, "path").mapInArrow(run, "path string, content binary").select("path", lossy(F.col("content")).alias("value"))


def heads(files: DataFrame, most: int = HEAD) -> DataFrame:
    """(path, head) of files: their first bytes as text; nothing more of a file is read. A head that isn't UTF-8 is empty, a file that isn't there has none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    found.append((path, ranges.head(*ranges.located(path), most)))
                except FileNotFoundError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([h for _, h in found], pa.binary())], ["path", "content"])

    read = files.select("path").mapInArrow(run, "path string, content binary")
    return read.select("path", F.when(F.is_valid_utf8(F.col("content")), F.col("content").cast("string")).otherwise("").alias("head"))


def seen_ids(files: DataFrame, source: Source) -> DataFrame:
    """The distinct session ids (id) of a listing's files: from their names, their folders, or what their heads tell."""
    if source.session == "folder":
        return files.select(F.element_at(F.split("path", "/"), -2).alias("id")).distinct()
    if source.session == "stem":
        return files.select(stem(F.col("path")).alias("id")).distinct()
    read = heads(files)
    if source.whole:
        told = F.get_json_object("head", "$.sessionId")
        return read.select(F.coalesce(told, stem(F.col("path"))).alias("id")).distinct()
    from tallyforge.operators.thread_log import identity_of_head, session_id

    return read.select(session_id(F.col("path"), identity_of_head(F.col("head"))).alias("id")).distinct()
