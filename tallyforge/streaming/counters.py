"""Cumulative token counters as a stateful stream: calls of threads as they are appended, and models that come late.

Each file of a thread has its state: who it is, the last totals, the models told so far and the number of calls. Calls
whose model isn't known yet are landed as unknown and kept; when a model is told they come again, as corrections. The
result is that of reading the files in batches that end where the stream's do, however they are split.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyforge.functions.expr import fresh_input
from tallyforge.operators import thread_log

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
THREAD = "seen boolean, id string, fork boolean, takeover bigint, first string, known string, i bigint, c bigint, o bigint, calls bigint"
UNNAMED = "line bigint, call bigint, stamp string, i bigint, c bigint, o bigint"
CALLS = "path string, correction boolean, thread string, fork boolean, call bigint, stamp string, model string, i bigint, c bigint, o bigint"
STEP = ("line", "meta", "thread", "fork", "takeover", "told", "total", "stamp", "counted", "i", "c", "o")
MADE = [f.split(" ")[0] for f in CALLS.split(", ")]
_NEW = (False, None, False, None, None, None, 0, 0, 0, 0)


def _there(value) -> bool:
    """Whether a value of a frame is neither None nor NaN."""
    return value is not None and value == value


class Threads(StatefulProcessor):
    """Folds the steps of a file, in the order of their lines; threads have few steps in a batch, so they are plain values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.thread = handle.getValueState("thread", THREAD)
        self.unnamed = handle.getListState("unnamed", UNNAMED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        steps = sorted((r for part in rows for r in zip(*(part[c].tolist() for c in STEP))), key=lambda r: r[0])
        seen, thread, fork, takeover, first, known, *totals, calls = self.thread.get() or _NEW
        named = None
        for line, meta, own_thread, own_fork, takes_over, told, *_ in steps:
            if meta and not seen:
                seen, thread, fork = True, own_thread, own_fork is True
            if takes_over and takeover is None:
                takeover = line
            if named is None and _there(told):
                named = told
        learned = first is None and named is not None
        first = named if learned else first
        starts = takeover if fork and takeover is not None else -1

        out, unnamed = [], []
        for line, _, _, _, _, told, total, stamp, counted, *now in steps:
            known = told if _there(told) else known
            if not counted:
                continue
            if total:
                now, totals = [max(n - t, 0) for n, t in zip(now, totals)], now
            i, c, o = now
            if i > 0 or o > 0:
                calls += 1
                if line >= starts:
                    stamp = stamp if _there(stamp) else None
                    out.append((key[0], False, thread, fork, calls, stamp, known if known is not None else first, i, c, o))
                    unnamed.append((line, calls, stamp, i, c, o))
        if first is None:
            if unnamed:
                self.unnamed.appendList(unnamed)
        elif learned and self.unnamed.exists():
            out += [(key[0], True, thread, fork, call, stamp, first, *n) for line, call, stamp, *n in self.unnamed.get() if line >= starts]
            self.unnamed.clear()
        self.thread.update((seen, thread, fork, takeover, first, known, *totals, calls))
        if out:
            yield pd.DataFrame(out, columns=MADE)

    def close(self) -> None:
        pass


def calls(lines: DataFrame) -> DataFrame:
    """The calls of a stream of appended lines (path, generation, at, value), with ``correction``.

    Bytes stand for lines: they order a file's lines as well. A file that was cut is a new thread, whose calls have
    the keys of the old one's.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own = lines.select("path", "generation", F.col("at").alias("line"), "value")
    folded = thread_log.steps(own).groupBy("path", "generation").transformWithStateInPandas(Threads(), CALLS, "Append", "None")
    fresh, cached = fresh_input(F.col("i"), F.col("c"))
    return folded.select(
        "correction", F.concat_ws(":", F.lit("codex:thread-v1"), F.coalesce("thread", F.lit("unknown")), F.col("call")).alias("uuid"), F.col("stamp").alias("timestamp"),
        F.coalesce("model", F.lit("unknown")).alias("model"), F.lit(thread_log.SOURCE).alias("source"), F.when(F.col("fork"), "").otherwise(thread_log.session_id(F.col("path"), F.col("thread"))).alias("session_id"),
        fresh.alias("input"), F.col("o").alias("output"), F.lit(0).cast("bigint").alias("cache_creation"), cached.alias("cache_read"),
    )
