"""What the operators share: reading tables, writing intermediate tables, rolling hashes over words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: White space between words: space and \t \n \v \f \r.
SPACES = " \t\n\v\f\r"
#: Whether Spark removes shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_U = np.uint64
_Q, _Q2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine, a temporary one where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors.

    The shuffles that made it are of no use afterwards; Spark is told to remove their files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discarded(*tables: DataFrame | None) -> None:
    """Removes tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        if table is not None:
            jvm = table.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(table.written_to)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """name, lengthened until it is none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]), dtype=_U) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_WORDS, _WORDS2 = _Powers(_Q), _Powers(_Q2)


def word_digests(raw: bytes) -> np.ndarray:
    """The XXH3-128 digest of each word of a text, as two 64-bit columns; words are maximal runs without white space."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw.split())), _U).reshape(-1, 2)


def window_hashes(words: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, given a digest of each (one for each start; none if there are too few)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = (_WORDS2 if second else _WORDS).get(len(words))
    total = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up, out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n])


def pieces(batch, column: str = "text", most: int = 1 << 20):
    """Slices of an Arrow batch that hold about ``most`` bytes of ``column`` or else one row, so that a task's memory is bounded."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
