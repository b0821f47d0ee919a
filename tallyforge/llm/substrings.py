"""Substring dedup by fixed-block anchors.

Every run of ``size`` words holds an aligned block of half as many words, whichever document it is in. So:

1. Non-overlapping blocks of each document are the index; every rolling window of a block's length probes
   it. Both travel as 32-bit hashes, dealt to classes by other bits of the hash and packed, and a task sends
   each hash once, whatever number of its documents have it. Hashes that meet again are anchors.
2. Each hit is extended to both sides: a document's runs of ``size`` words that hold an anchor go to classes
   where the smallest document of each run is found, again once for a task. Runs that follow one another make
   up the maximal exact repeats, and the words that they cover in a later document go.

Anchors are a filter (a false one costs a check). What decides is 128 bits for each run, made of two
independent 64-bit halves of each word's XXH3-128 digest. No pair of documents is formed, so a passage or a
copy that a third of all documents share is one row for each task and class. Classes follow the bytes of text
that come in, and a task takes its classes one after the other, so its memory doesn't grow with the input.

Null and empty texts have no words. Rows are judged one by one; those with the same doc_id never remove words
from each other. A null doc_id counts as larger than any other. Texts of any length are read whole. Other
columns are kept by ``deduplicated``, whatever their names, and ignored by ``digests``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import free_name, mix, partitions, pieces, window_hashes, word_digests, written

SIZE = 50
LAST = (1 << 63) - 1
#: Bytes of text for each class and for each partition of classes.
CLASS_BYTES, PART_BYTES = 128 << 20, 1 << 30
#: Bytes of text whose windows a task gathers before it sends them, and the most it does where classes are many.
GATHERED, MOST_GATHERED = 12 << 20, 64 << 20
#: Found places that a task holds before it hands them on.
HELD = 1 << 22
_U = np.uint64
_ANCHORS = "own int, kind int, blocks int, hashes binary, keys binary, ids binary, counts binary"
_RUNS = "own int, kind int, h binary, g binary, at binary, keys binary, ids binary, counts binary"
_FOUND = "own int, keys binary, ids binary, counts binary, found binary"


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(partitions, classes) for the text of docs."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-total // PART_BYTES))
    return parts, max(parts, -(-total // CLASS_BYTES))


def gathered_bytes(classes: int) -> int:
    return min(MOST_GATHERED, max(GATHERED, 80 * classes))


def class_of(h: np.ndarray, classes: int) -> np.ndarray:
    return ((h >> _U(32)) % _U(classes)).astype(np.int64)


def bucket_of(key: np.ndarray, own_id: np.ndarray, classes: int) -> np.ndarray:
    """The class where a document's findings gather; copies of a text are in different ones."""
    return (mix(key.astype(_U) ^ mix(own_id.astype(_U))) % _U(classes)).astype(np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value of sorted columns starts."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _batch(schema: str, rows: list[tuple]):
    """An Arrow batch of the given schema."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _by_class(sent: DataFrame, parts: int, run, schema: str) -> DataFrame:
    """Applies ``run(iterator of (class, rows))`` to partitions; a partition has its classes one after the other."""

    def each(batches):
        def classes() -> Iterator[tuple[int, list[dict]]]:
            own, rows = None, []
            for batch in batches:
                for row in batch.to_pylist():
                    if row["own"] != own and rows:
                        yield own, rows
                        rows = []
                    own = row["own"]
                    rows.append(row)
            if rows:
                yield own, rows

        yield from run(classes())

    return sent.repartitionById(parts, F.col("own") % parts).sortWithinPartitions("own").mapInArrow(each, schema)


class _Found:
    """Places found for documents, handed on packed by the document's class."""

    def __init__(self, kind: str, classes: int):
        self.kind, self.classes, self.held, self.rows = kind, classes, 0, []

    def add(self, key: np.ndarray, own_id: np.ndarray, value: np.ndarray):
        if len(key):
            self.rows.append((key, own_id, value))
            self.held += len(key)
        if self.held > HELD:
            yield from self.flush()

    def flush(self):
        if self.rows:
            key, own_id, value = (np.concatenate(c) for c in zip(*self.rows, strict=True))
            self.held, self.rows = 0, []
            own = bucket_of(key, own_id, self.classes)
            order = np.lexsort((own_id, key, own))
            key, own_id, own, value = key[order], own_id[order], own[order], value[order].astype(self.kind)
            doc = _starts(own, key, own_id)
            count = np.diff(np.append(doc, len(key)))
            first = _starts(own[doc])
            ends = np.append(first[1:], len(doc))
            yield _batch(_FOUND, [(int(own[doc[a]]), key[doc[a:b]].tobytes(), own_id[doc[a:b]].tobytes(), count[a:b].astype("<u4").tobytes(), value[doc[a] : doc[b] if b < len(doc) else len(value)].tobytes()) for a, b in zip(first.tolist(), ends.tolist(), strict=True)])


def _gathered(found: DataFrame, kind: str, name: str, parts: int) -> DataFrame:
    """(sub_key, sub_id, name): all places of each document as one packed array."""

    def run(classes):
        import pyarrow as pa

        for _, rows in classes:
            counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
            key, own_id = (np.repeat(np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]), counts) for c in ("keys", "ids"))
            value = np.concatenate([np.frombuffer(r["found"], kind) for r in rows])
            order = np.lexsort((own_id, key))
            key, own_id, value = key[order], own_id[order], value[order]
            start = _starts(key, own_id)
            for k in range(0, len(start), 4096):
                own = start[k : k + 4096]
                end = start[k + 4096] if k + 4096 < len(start) else len(order)
                parts_of = np.split(value[own[0] : end], own[1:] - own[0])
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(own_id[own]), pa.array([np.unique(x).tobytes() for x in parts_of], pa.binary())], ["sub_key", "sub_id", name])

    return _by_class(found, parts, run, f"sub_key bigint, sub_id bigint, {name} binary")


def _per_document(key: np.ndarray, own_id: np.ndarray, value: np.ndarray, classes: int):
    """(class, key, id, values) of each document."""
    order = np.lexsort((own_id, key))
    start = _starts(key[order], own_id[order])
    own = bucket_of(key[order][start], own_id[order][start], classes).tolist()
    for c, at in zip(own, np.split(order, start[1:]) if len(order) else (), strict=True):
        yield c, key[at[0]], own_id[at[0]], np.unique(value[at])


def _anchor_rows(docs: list[tuple[int, int, np.ndarray, np.ndarray]], classes: int) -> Iterator[tuple]:
    """Rows for the classes, and (kind 1) anchors known at once: hashes that several of these documents have. docs: key, id, hashes, whether a block."""
    keys, ids = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
    h, block = (np.concatenate([d[i] for d in docs]) for i in (2, 3))
    doc = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
    low = (class_of(h, classes) << 32) | (h & _U(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(low, kind="stable")
    low, doc, block = low[order], doc[order], block[order]
    first = _starts(low)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(low))))
    several = np.logical_or.reduceat(doc != doc[first][group], first)
    is_block = np.logical_or.reduceat(block, first)
    known = several[group]
    for own, key, own_id, found in _per_document(keys[doc[known]], ids[doc[known]], low[known], classes):
        yield own, 1, 0, found.astype("<i8").tobytes(), key.tobytes(), own_id.tobytes(), None
    owner, low = doc[first], low[first]
    ends = np.searchsorted(low >> 32, np.arange(classes + 1))
    for c in np.flatnonzero(np.diff(ends)):
        a, b = ends[c], ends[c + 1]
        at = a + np.lexsort((owner[a:b], ~is_block[a:b]))  # blocks first, each kind by document
        start = _starts(owner[at], is_block[at])
        count = np.diff(np.append(start, b - a)).astype("<u4")
        own = owner[at][start]
        yield int(c), 0, int(is_block[a:b].sum()), (low[at] & 0xFFFFFFFF).astype("<u4").tobytes(), keys[own].tobytes(), ids[own].tobytes(), count.tobytes()


def anchors(docs: DataFrame, size: int, parts: int, classes: int) -> DataFrame:
    """(sub_key, sub_id, anchors): the hashes (class and 32 bits, packed in arrays) of each document's windows that may repeat elsewhere."""
    block, most = size // 2, gathered_bytes(classes)

    def send(batches):
        members, held = [], 0
        for batch in batches:
            for part in pieces(batch):
                for row in part.to_pylist():
                    h = window_hashes(word_digests((row["text"] or "").encode())[:, 0], block)
                    if len(h):
                        members.append((row["sub_key"], row["sub_id"], h, np.arange(len(h)) % block == 0))
                        held += len(row["text"])
                    if held > most:
                        yield _batch(_ANCHORS, list(_anchor_rows(members, classes)))
                        members, held = [], 0
        if members:
            yield _batch(_ANCHORS, list(_anchor_rows(members, classes)))

    def meet(each):
        found = _Found("<i8", classes)
        for own, rows in each:
            for r in rows:
                if r["kind"] == 1:
                    values = np.frombuffer(r["hashes"], "<i8")
                    yield from found.add(*(np.repeat(np.frombuffer(r[c], "<i8"), len(values)) for c in ("keys", "ids")), values)
            rows = [r for r in rows if r["kind"] == 0]
            if not rows:
                continue
            hashes = [np.frombuffer(r["hashes"], "<u4") for r in rows]
            index = np.unique(np.concatenate([h[: r["blocks"]] for h, r in zip(hashes, rows, strict=True)]))
            if not len(index):
                continue
            h = np.concatenate(hashes)
            at = np.minimum(np.searchsorted(index, h), len(index) - 1)
            hit = index[at] == h
            times = np.bincount(at[hit], minlength=len(index))
            hit[hit] = times[at[hit]] > 1
            counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
            key, own_id = (np.repeat(np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]), counts)[hit] for c in ("keys", "ids"))
            yield from found.add(key, own_id, (np.int64(own) << 32) | h[hit].astype(np.int64))
        yield from found.flush()

    sent = docs.select("sub_key", "sub_id", "text").mapInArrow(send, _ANCHORS)
    return _gathered(_by_class(sent, parts, meet, _FOUND), "<i8", "anchors", parts)


def runs_around(hashes: np.ndarray, found: np.ndarray, size: int, classes: int, n_words: int) -> np.ndarray:
    """The starts of runs of ``size`` words that hold an anchor: each hit extended to both sides."""
    block, low = size // 2, (class_of(hashes, classes) << 32) | (hashes & _U(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(found[np.minimum(np.searchsorted(found, low), len(found) - 1)] == low) if len(found) else np.zeros(0, int)
    runs = np.zeros(max(0, n_words - size + 1) + 1, np.int64)
    if len(runs) == 1 or not len(at):
        return np.zeros(0, np.int64)
    np.add.at(runs, np.clip(at - (size - block), 0, len(runs) - 1), 1)
    np.add.at(runs, np.clip(at + 1, 0, len(runs) - 1), -1)
    return np.flatnonzero(np.cumsum(runs)[:-1] > 0)


def _run_rows(members: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], classes: int) -> Iterator[tuple]:
    """Rows for the classes, and (kind 1) runs already known to be later. members: key, id, places, two hashes."""
    keys, ids = (np.array([m[i] for m in members], np.int64) for i in (0, 1))
    doc = np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
    at, h, g = (np.concatenate([m[k] for m in members]) for k in (2, 3, 4))
    order = np.lexsort((at, doc, ids[doc], g, h))
    doc, at, h, g = doc[order], at[order], h[order], g[order]
    first = _starts(h, g)
    least = np.repeat(ids[doc[first]], np.diff(np.append(first, len(h))))
    later = ids[doc] > least
    for own, key, own_id, found in _per_document(keys[doc[later]], ids[doc[later]], at[later], classes):
        yield own, 1, None, None, found.astype("<u4").tobytes(), key.tobytes(), own_id.tobytes(), None
    doc, at, h, g = doc[~later], at[~later], h[~later], g[~later]
    own = class_of(h, classes)
    order = np.lexsort((at, doc, own))
    own, doc, at, h, g = own[order], doc[order], at[order], h[order], g[order]
    ends = np.searchsorted(own, np.arange(classes + 1))
    for c in np.flatnonzero(np.diff(ends)):
        a, b = ends[c], ends[c + 1]
        start = _starts(doc[a:b])
        count = np.diff(np.append(start, b - a)).astype("<u4")
        d = doc[a:b][start]
        yield int(c), 0, h[a:b].tobytes(), g[a:b].tobytes(), at[a:b].astype("<u4").tobytes(), keys[d].tobytes(), ids[d].tobytes(), count.tobytes()


def repeats(docs: DataFrame, size: int) -> DataFrame:
    """(sub_key, sub_id, starts): where runs of words start that a smaller doc_id has too."""
    parts, classes = sizes(docs)
    block, most = size // 2, gathered_bytes(classes)
    found = docs.join(written(anchors(docs, size, parts, classes)), ["sub_key", "sub_id"]).select("sub_key", "sub_id", "text", "anchors")

    def send(batches):
        members, held = [], 0
        for batch in batches:
            for part in pieces(batch):
                for row in part.to_pylist():
                    words = word_digests((row["text"] or "").encode())
                    at = runs_around(window_hashes(words[:, 0], block), np.frombuffer(row["anchors"], "<i8"), size, classes, len(words))
                    if len(at):
                        members.append((row["sub_key"], row["sub_id"], at, window_hashes(words[:, 0], size)[at], window_hashes(words[:, 1], size, True)[at]))
                        held += 8 * len(at)
                    if held > most:
                        yield _batch(_RUNS, list(_run_rows(members, classes)))
                        members, held = [], 0
        if members:
            yield _batch(_RUNS, list(_run_rows(members, classes)))

    def meet(each):
        later = _Found("<u4", classes)
        for _, rows in each:
            for r in rows:
                if r["kind"] == 1:
                    values = np.frombuffer(r["at"], "<u4")
                    yield from later.add(*(np.repeat(np.frombuffer(r[c], "<i8"), len(values)) for c in ("keys", "ids")), values)
            rows = [r for r in rows if r["kind"] == 0]
            if rows:
                h, g, at, counts = (np.concatenate([np.frombuffer(r[n], k) for r in rows]) for n, k in (("h", "<u8"), ("g", "<u8"), ("at", "<u4"), ("counts", "<u4")))
                key, own_id = (np.repeat(np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]), counts) for c in ("keys", "ids"))
                order = np.lexsort((own_id, g, h))
                h, g, at, key, own_id = h[order], g[order], at[order], key[order], own_id[order]
                first = _starts(h, g)
                more = own_id > np.repeat(own_id[first], np.diff(np.append(first, len(h))))
                yield from later.add(key[more], own_id[more], at[more])
        yield from later.flush()

    sent = found.mapInArrow(send, _RUNS)
    return _gathered(_by_class(sent, parts, meet, _FOUND), "<u4", "starts", parts)


def _covered(starts: bytes, n_words: int, size: int) -> np.ndarray:
    """Whether each word lies in a run that starts at one of the given places."""
    marks = np.zeros(n_words + 1, np.int64)
    at = np.frombuffer(starts, "<u4").astype(np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + size, -1)
    return np.cumsum(marks)[:-1] > 0


def _with_starts(docs: DataFrame, size: int) -> tuple[DataFrame, str]:
    """docs with one more column, the starts of their repeats, and its name; rows that are equal in doc_id and text share them."""
    names = [free_name(docs.columns, c) for c in ("sub_key", "sub_id", "sub_starts")]
    identity = [F.xxhash64("text"), F.coalesce("doc_id", F.lit(LAST))]
    keyed = docs.select("text", *(c.alias(n) for c, n in zip(identity, ("sub_key", "sub_id"), strict=True)))
    starts = written(repeats(keyed, size)).toDF(*names)
    return docs.withColumns(dict(zip(names[:2], identity, strict=True))).join(starts, names[:2], "left"), names[2]


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    joined, column = _with_starts(docs.select("doc_id", "text"), size)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                n, removed, sha = [], [], []
                for text, starts in zip(part.column("text").to_pylist(), part.column(column).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    n.append(len(words))
                    gone = _covered(starts, len(words), size) if starts else None
                    removed.append(int(gone.sum()) if starts else 0)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if starts else words
                    sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.select("doc_id", "text", column).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents without the words that repeat; texts that lose nothing stay as they are."""
    columns, kinds = docs.columns, dict(docs.dtypes)
    joined, column = _with_starts(docs, size)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text").to_pylist()
                for i, starts in enumerate(part.column(column).to_pylist()):
                    if starts:
                        words = (texts[i] or "").encode().split()
                        gone = _covered(starts, len(words), size).tolist()
                        texts[i] = b" ".join([w for w, g in zip(words, gone, strict=True) if not g]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns], columns)

    return joined.select(*columns, column).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
