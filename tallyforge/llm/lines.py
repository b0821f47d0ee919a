"""Line dedup with two Bloom filters.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. The first pass
sets the bits of each key once for each task that meets it; bits set a second time form the twice-seen filter.
Both filters are dealt over tasks by slices; only the twice-seen one is kept, and its size has a fixed bound
(MOST_BITS). Only keys that it holds are suspected and shuffled: one row for each task and key, with the
smallest document that has it there, since the task's other documents already know that they come later.
The exact keys decide, and the smallest document keeps its lines. A filter too small for its input suspects
more lines, but the result stays the same.

Null and empty texts are one empty line. Keys shorter than ``least`` code points stay. Rows with the same
doc_id are one document's. A null doc_id counts as larger than any other. Other columns are kept by
``deduplicated`` and ignored by ``digests``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACES, free_name, pieces, written

#: Bits of a filter for each byte-estimated line, its bounds, bits of a slice, bits set for a key.
MOST_BITS, LEAST_BITS, SLICE, HASHES = 1 << 28, 1 << 20, 1 << 16, 2
#: Keys that a task holds before it hands them on.
HELD_KEYS = 400_000
LAST = (1 << 63) - 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def keys_of(text: str | None, least: int) -> list[bytes]:
    """The keys of a text's lines, in UTF-8; too short ones are empty."""
    space = SPACES.encode()
    keys = [k.strip(space) for k in (text or "").encode().translate(_LOWER).split(b"\n")]
    return [k if len(k) >= 4 * least or (len(k) >= least and len(k.decode()) >= least) else b"" for k in keys]


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """The bits of each key: an array with HASHES columns."""
    import xxhash

    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    return np.column_stack([(h & np.uint64(0xFFFFFFFF)) % np.uint64(bits), (h >> np.uint64(32)) % np.uint64(bits)]).astype(np.int64)


def twice_seen(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The twice-seen filter, as packed bits."""
    slices = bits // SLICE

    def seen(batches):
        import pyarrow as pa

        def handed(own: dict[bytes, int], twice: set[bytes]):
            at = np.unique(places(list(own), bits))
            again = np.unique(places(list(twice), bits)) if twice else np.zeros(0, np.int64)
            for name, x in ((1, at), (2, again)):
                for part in np.split(x, np.flatnonzero(np.diff(x // SLICE)) + 1) if len(x) else ():
                    yield pa.RecordBatch.from_arrays([pa.array([part[0] // SLICE], pa.int64()), pa.array([name], pa.int32()), pa.array([(part % SLICE).astype("<u2").tobytes()], pa.binary())], ["slice", "times", "bits"])

        own, twice = {}, set()
        for batch in batches:
            for part in pieces(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for k in keys_of(text, least):
                        if k and own.setdefault(k, doc) != doc:
                            twice.add(k)
                if len(own) > HELD_KEYS:
                    yield from handed(own, twice)
                    own, twice = {}, set()
        if own:
            yield from handed(own, twice)

    def merged(table):
        import pyarrow as pa

        once, twice = np.zeros(SLICE, bool), np.zeros(SLICE, bool)
        for times, raw in zip(table.column("times").to_pylist(), table.column("bits").to_pylist(), strict=True):
            at = np.frombuffer(raw, "<u2")
            if times == 2:
                twice[at] = True
            else:
                twice[at[once[at]]] = True
                once[at] = True
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    found = docs.select("doc_id", "text").mapInArrow(seen, "slice bigint, times int, bits binary").groupBy("slice").applyInArrow(merged, "slice bigint, bits binary")
    out = np.zeros((slices, SLICE // 8), np.uint8)
    for row in found.toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def later_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, keys): the 64-bit hashes of the keys whose lines a document loses."""
    lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * lines):
        bits *= 2
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, least, bits))

    def suspects(batches):
        import pyarrow as pa
        import xxhash

        def handed(own: dict[bytes, int], later: dict[int, list[bytes]]):
            keys = list(own)
            yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in keys], pa.int64()), pa.array(keys, pa.binary()), pa.array([None] * len(keys), pa.list_(pa.int64()))], names)
            if later:
                hashes = [np.unique(np.array([xxhash.xxh3_64_intdigest(k) for k in ks], np.uint64)).view(np.int64) for ks in later.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(later), pa.int64()), pa.nulls(len(later), pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names)

        names, filter_bits = ["doc_id", "key", "keys"], shared.value
        own: dict[bytes, int] = {}
        later: dict[int, list[bytes]] = {}
        for batch in batches:
            for part in pieces(batch):
                docs_of = [LAST if d is None else d for d in part.column("doc_id").to_pylist()]
                keys = [keys_of(t, least) for t in part.column("text").to_pylist()]
                distinct = list({k for ks in keys for k in ks if k})
                if distinct:
                    at = places(distinct, bits)
                    held = ((filter_bits[at >> 3] >> (at & 7)) & 1).all(1)
                    suspected = {k for k, h in zip(distinct, held.tolist(), strict=True) if h}
                    for doc, ks in zip(docs_of, keys, strict=True):
                        for k in suspected.intersection(ks):
                            first = own.setdefault(k, doc)
                            if doc > first:
                                later.setdefault(doc, []).append(k)
                            elif doc < first:
                                later.setdefault(first, []).append(k)
                                own[k] = doc
                if len(own) > HELD_KEYS or len(later) > HELD_KEYS:
                    yield from handed(own, later)
                    own, later = {}, {}
        if own:
            yield from handed(own, later)

    found = written(docs.select("doc_id", "text").mapInArrow(suspects, "doc_id bigint, key binary, keys array<bigint>"))
    shared.unpersist()
    rows = found.filter("key is not null").select("key", "doc_id")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("key", "first")

    def hashed(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            h = np.array([xxhash.xxh3_64_intdigest(k) for k in batch.column("key").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(h, pa.int64())], ["doc_id", "key"])

    across = rows.join(first, "key").filter("doc_id > first").select("doc_id", "key").mapInArrow(hashed, "doc_id bigint, key bigint")
    inside = found.filter("keys is not null").select("doc_id", F.explode("keys").alias("key"))
    return across.union(inside).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def without_later_lines(docs: DataFrame, least: int, columns: list[str], finish, schema: str) -> DataFrame:
    """Applies ``finish(columns of a piece, kept lines of each row, lines before)`` to all documents."""
    key, gone_keys = free_name(columns, "dedup_id"), free_name(columns, "dedup_keys")
    marked = docs.withColumn(key, F.coalesce("doc_id", F.lit(LAST)))
    joined = marked.join(later_lines(docs, least).select(F.col("doc_id").alias(key), F.col("keys").alias(gone_keys)), key, "left")

    def run(batches):
        import xxhash

        for batch in batches:
            for part in pieces(batch):
                kept, before = [], []
                for text, lost in zip(part.column("text").to_pylist(), part.column(gone_keys).to_pylist(), strict=True):
                    own = (text or "").split("\n")
                    before.append(len(own))
                    if lost:
                        gone = set(lost)
                        signed = lambda k: (h := xxhash.xxh3_64_intdigest(k)) - (h >> 63 << 64)
                        own = [x for x, k in zip(own, keys_of(text, least), strict=True) if not (k and signed(k) in gone)]
                    kept.append(own)
                yield finish(part, kept, before)

    return joined.select(*columns, gone_keys).mapInArrow(run, schema)


def digests(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""

    def finish(part, kept, before):
        import pyarrow as pa

        sha = [hashlib.sha256("\n".join(k).encode()).hexdigest() for k in kept]
        dropped = [b - len(k) for b, k in zip(before, kept, strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(before, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return without_later_lines(docs.select("doc_id", "text"), least, ["doc_id", "text"], finish, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, least: int = 10) -> DataFrame:
    """The documents with their kept lines as text; texts that lose nothing stay as they are, null ones too."""
    columns = docs.columns

    def finish(part, kept, before):
        import pyarrow as pa

        texts = [t if len(k) == b else "\n".join(k) for t, k, b in zip(part.column("text").to_pylist(), kept, before, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns], columns)

    kinds = dict(docs.dtypes)
    return without_later_lines(docs, least, columns, finish, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def sql(least: int = 10) -> str:
    trim = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), k AS (
  SELECT *, translate(trim(line, {trim}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {least} GROUP BY key HAVING min(doc_id) < max(doc_id)
), d AS (
  SELECT k.doc_id, k.n, k.line, f.first IS NOT NULL AND k.doc_id > f.first AS dropped FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN dropped THEN NULL ELSE line END, chr(10) ORDER BY n), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
