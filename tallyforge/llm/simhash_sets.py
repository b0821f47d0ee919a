"""SimHash near-dedup down to a Jaccard similarity of shingle sets: many short fingerprints, ball hashing, exact check.

One 64-bit fingerprint within three bits finds next to none of the pairs at a similarity of 0.8, whose bits
differ at a rate of 0.15. A sketch here has TABLES fingerprints of 32 bits; in each, values within one bit are
emitted, so that ends at two or fewer differing bits meet. A pair at 0.8 meets in one of 20 tables with
probability 0.92, at 0.85 with 0.99 (calculated). Colliding pairs are screened by 64 further bits, then by the
whole sketch: pairs it puts far above the wanted similarity link, those far below don't, and those between are
decided by their shingle sets.

A value belongs to the class of its lowest bits, so a fingerprint reaches only its own class and those one of
these bits away. Copies cost nothing (sketches are distinct), and within a batch one fingerprint of each value
is dealt for all that are near it: a value that a third of all rows share is a few rows in its class.

These stars alone would miss pairs whose ends both meet an unlike third text. So when they are linked, all
fingerprints meet once more, and each pair that collides, passes the screen and isn't linked yet is compared.
Only pairs that are linked already are left out, so a group of near copies doesn't grow with its square.

The bits of short texts differ more often than the similarity tells, so pairs whose smaller set has at most
SHORT shingles don't depend on fingerprints: of sets of n, two at a similarity of s or more share one of the
n - ceil(s n) + 1 shingles that come first in any one order. Rare shingles come first; texts that share one of
these and aren't linked yet are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import mix, pieces, window_hashes, word_digests, written
from tallyforge.llm.graph import components
from tallyforge.llm.simhash import LOWER, survivors

TABLES = 20
#: Bits of a sketch: the tables' and 64 that screen; differing bits of these at which a colliding pair goes.
BITS, SCREEN = TABLES * 32 + 64, 24
#: Fewest bits that name a class of a table, and fingerprints for each class before there are more.
CLASS_BITS, PER_CLASS = 6, 1 << 15
#: Rows of a class beyond which it is split in blocks that meet in pairs, and pairs compared at once.
CLASS_ROWS, AT_ONCE = 1 << 20, 1 << 20
#: Shingles up to which a set's partners are found exactly, and shared shingles for each class of them.
SHORT, PER_PART = 64, 1 << 17
#: Standard deviations between the expected distance and the distances that are taken as certain.
SIGMAS = 4
LAST = (1 << 63) - 1
WORDS = [f"s{k}" for k in range(BITS // 64)]
_U = np.uint64


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles (A-Z lower-cased; fewer words: the whole sequence)."""
    words = word_digests((text or "").encode().translate(LOWER))[:, 0]
    return np.unique(window_hashes(words, min(shingle, max(1, len(words)))))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """BITS / 64 words of SimHash bits, each of its own hash of the shingles; zero if there are none."""
    out = np.zeros(len(WORDS), _U)
    for k in range(len(WORDS)):
        counts = np.zeros(64, np.int64)
        for first in range(0, len(hashes), 1 << 15):
            h = mix(hashes[first : first + (1 << 15)] + _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view(_U)[0]
    return out


def limits(similarity: float) -> tuple[int, int]:
    """Differing bits of sketches up to which pairs are surely similar enough, and up to which they may be."""
    rate = math.acos(2 * similarity / (1 + similarity)) / math.pi
    spread = SIGMAS * math.sqrt(BITS * rate * (1 - rate))
    return int(BITS * rate - spread), int(BITS * rate + spread) + 1


def stars(value: np.ndarray, node: np.ndarray, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of nodes under equal values, and the positions of the nodes a that others are paired with.

    The first node of a value is paired with all that the screen puts near it; the rest are treated anew, so
    that no node is hidden by a stranger under its value.
    """
    at = np.lexsort((node, value))
    a, b, heads = [], [], []
    while len(at):
        v = value[at]
        new = np.concatenate([np.ones(1, bool), v[1:] != v[:-1]])
        head = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        near = np.bitwise_count(screen[at] ^ screen[head]) <= SCREEN
        a.append(node[head[near & ~new]])
        b.append(node[at[near & ~new]])
        heads.append(at[new])
        at = at[~near]
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(a, np.int64), join(b, np.int64), join(heads, np.int64)


def meetings(value: np.ndarray, root: np.ndarray, screen: np.ndarray):
    """Positions (a, b), about AT_ONCE at a time, of all rows under equal values that have different roots, as far as they pass the screen."""
    at = np.lexsort((root, value))
    value, root, screen = value[at], root[at], screen[at]
    place = np.arange(len(at))
    new = np.concatenate([np.ones(1, bool), value[1:] != value[:-1]])[: len(at)]
    fresh = new | np.concatenate([np.ones(1, bool), root[1:] != root[:-1]])[: len(at)]
    ends = lambda starts: np.append(np.flatnonzero(starts)[1:], len(at))[np.cumsum(starts) - 1]
    first, last = ends(fresh), ends(new)
    open_ = np.flatnonzero(last > first)
    place, first, partners = place[open_], first[open_], (last - first)[open_]
    before = np.cumsum(partners) - partners
    start = 0
    while start < len(place):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + AT_ONCE)))
        n = partners[start:stop]
        a = np.repeat(place[start:stop], n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:stop], n)
        near = np.bitwise_count(screen[a] ^ screen[b]) <= SCREEN
        yield at[a[near]], at[b[near]]
        start = stop


def apart(value: np.ndarray, node: np.ndarray, root: np.ndarray, screen: np.ndarray) -> np.ndarray:
    """All pairs (a, b) of nodes, a below b, under equal values that have different roots and pass the screen."""
    out = [np.unique(np.sort(np.column_stack([node[a], node[b]]), axis=1), axis=0) for a, b in meetings(value, root, screen)]
    return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=0)


def sketches(docs: DataFrame, shingle: int, few: int) -> DataFrame:
    """doc_id, row_key (of the text), the words of the sketch of each document, and its shingles if it has 1 to ``few``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                rows, short = np.zeros((part.num_rows, len(WORDS)), _U), []
                for i, text in enumerate(part.column("text").to_pylist()):
                    hashes = shingle_set(text, shingle)
                    rows[i] = sketch(hashes)
                    short.append(hashes.view(np.int64) if 0 < len(hashes) <= few else None)
                words = [pa.array(np.ascontiguousarray(column)) for column in rows.view(np.int64).T]
                columns = [part.column("doc_id"), part.column("row_key"), *words, pa.array(short, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", *WORDS, "few"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    return keyed.mapInArrow(run, "doc_id bigint, row_key bigint, " + ", ".join(f"{w} bigint" for w in WORDS) + ", few array<bigint>")


def class_bits(number: int) -> int:
    bits = CLASS_BITS
    while number > PER_CLASS << bits:
        bits += 1
    return bits


def classes_of(v: np.ndarray, bits: int) -> np.ndarray:
    """The classes that values are sent to, one row for the own class and each class one bit away."""
    return np.stack([v & np.uint32((1 << bits) - 1) ^ np.uint32(m) for m in [0] + [1 << i for i in range(bits)]]).astype(np.int64)


def ball(rows: np.ndarray, own: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The values that a class's rows meet under, and the rows under them."""
    mask = np.uint32((1 << bits) - 1)
    home, guest = rows[rows["v"] & mask == own], rows[rows["v"] & mask != own]
    values = [home["v"]] + [home["v"] ^ np.uint32(1 << i) for i in range(bits, 32)] + [guest["v"] & ~mask | np.uint32(own)]
    return np.concatenate(values), [home] * (33 - bits) + [guest]


def colliding(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that meet under a value of a table and pass the screen; each value pairs by stars."""
    bits = class_bits(nodes.count())
    row = np.dtype([("v", "<u4"), ("node", "<i8"), ("screen", "<u8")])

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            words = np.column_stack([batch.column(w).to_numpy(zero_copy_only=False) for w in WORDS]).view(_U)
            for t in range(TABLES):
                v = (words[:, t // 2] >> _U(32 * (t % 2))).astype(np.uint32)
                a, b, heads = stars(v, node, words[:, -1])
                rows = np.empty(len(heads), row)
                rows["v"], rows["node"], rows["screen"] = v[heads], node[heads], words[heads, -1]
                own = classes_of(rows["v"], bits).ravel()
                order = np.argsort(own, kind="stable")
                rows, own = np.tile(rows, bits + 1)[order], own[order]
                found, first = np.unique(own, return_index=True)
                parts = np.split(rows, first[1:]) if len(found) else []
                pairs = np.array_split(np.column_stack([a, b]), max(1, len(found)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((found + (t << bits)).astype(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([p.tobytes() for p in pairs[: len(found)]], pa.binary())],
                    ["own", "rows", "pairs"],
                )

    def meet(table):
        import pyarrow as pa

        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), row)
        pairs = np.frombuffer(b"".join(table.column("pairs").to_pylist()), np.int64).reshape(-1, 2)
        values, under = ball(rows, table.column("own")[0].as_py() & (1 << bits) - 1, bits)
        nodes, screens = (np.concatenate([r[c] for r in under]) for c in ("node", "screen"))
        a, b, _ = stars(values, nodes, screens)
        pairs = np.concatenate([pairs, np.column_stack([a, b])])
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])})

    return nodes.select("node", *WORDS).mapInArrow(deal, "own bigint, rows binary, pairs binary").groupBy("own").applyInArrow(meet, "a bigint, b bigint").distinct()


def _in_classes(nodes: DataFrame, names: list[str], meet, schema: str) -> DataFrame:
    """What ``meet`` makes of the rows of each class of a table: rows (v, node, root, the words named), own class, table, bits.

    Classes beyond CLASS_ROWS are split in blocks, each pair of which meets.
    """
    bits = class_bits(nodes.count())
    row = np.dtype([("v", "<u4"), ("node", "<i8"), ("root", "<i8"), ("words", "<u8", (len(names),))])

    def values_of(batch):
        for t in range(TABLES):
            word = batch.column(WORDS[t // 2]).to_numpy(zero_copy_only=False).view(_U)
            yield t, (word >> _U(32 * (t % 2))).astype(np.uint32)

    def sizes(batches):
        import pyarrow as pa

        total = np.zeros(TABLES << bits, np.int64)
        for batch in batches:
            for t, v in values_of(batch):
                total[t << bits : (t + 1) << bits] += np.bincount(classes_of(v, bits).ravel(), minlength=1 << bits)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["own", "n"])

    split = nodes.select(*WORDS).mapInArrow(sizes, "own bigint, n bigint").groupBy("own").agg(F.sum("n").alias("n")).filter(F.col("n") > CLASS_ROWS)
    blocks = {r["own"]: -(-r["n"] // CLASS_ROWS) for r in split.collect()}

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            rows = np.empty(batch.num_rows, row)
            rows["node"], rows["root"] = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root"))
            for k, name in enumerate(names):
                rows["words"][:, k] = batch.column(name).to_numpy(zero_copy_only=False).view(_U)
            for t, v in values_of(batch):
                rows["v"] = v
                own = classes_of(v, bits).ravel()
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                out = []
                for c, at in zip((found + (t << bits)).tolist(), np.split(order % max(1, len(rows)), first[1:]), strict=False):
                    part, n = rows[at], blocks.get(c, 1)
                    sub = (mix(part["node"].view(_U) if n > 1 else np.zeros(len(part), _U)) % _U(n)).astype(int)
                    out += [(c, min(i, j), max(i, j), part[sub == i].tobytes()) for i in range(n) for j in range(n)]
                columns = list(zip(*[o for o in out if o[3]], strict=True)) or [()] * 4
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["own", "i", "j", "rows"])

    def run(table):
        own = table.column("own")[0].as_py()
        return meet(np.frombuffer(b"".join(table.column("rows").to_pylist()), row), own & (1 << bits) - 1, own >> bits, bits)

    dealt = nodes.select("node", "root", *WORDS).mapInArrow(deal, "own bigint, i int, j int, rows binary")
    return dealt.groupBy("own", "i", "j").applyInArrow(run, schema)


def _met(rows: np.ndarray, own: int, bits: int):
    """Positions (a, b) of a class's rows that meet under a value, pass the screen (the last word) and have different roots."""
    placed = np.empty(len(rows), [("v", "<u4"), ("at", "<i8")])
    placed["v"], placed["at"] = rows["v"], np.arange(len(rows))
    values, under = ball(placed, own, bits)
    at = np.concatenate([r["at"] for r in under])
    for a, b in meetings(values, rows["root"][at], rows["words"][:, -1][at]):
        yield at[a], at[b]


def partnered(nodes: DataFrame) -> DataFrame:
    """The nodes that meet another of a different root under a value of a table and pass the screen with it."""

    def meet(rows, own, t, bits):
        import pyarrow as pa

        found = np.zeros(len(rows), bool)
        for a, b in _met(rows, own, bits):
            found[a] = found[b] = True
        return pa.table({"node": np.unique(rows["node"][found])})

    return _in_classes(nodes, WORDS[-1:], meet, "node bigint").distinct()


def unlinked(nodes: DataFrame, most: int = BITS) -> DataFrame:
    """All pairs (a, b) of nodes that meet under a value of a table, pass the screen and have different roots.

    Pairs whose sketches differ in more than ``most`` bits are left out. Nodes without a partner, nearly all, are found
    first, from screens alone; the others meet again with their whole sketches, which tell in which table and
    class a pair meets first: only there it is made.
    """

    def meet(rows, own, t, bits):
        import pyarrow as pa

        mask = np.uint32((1 << bits) - 1)
        out = [np.zeros((0, 2), np.int64)]
        for a, b in _met(rows, own, bits):
            va, vb = rows["v"][a], rows["v"][b]
            # Values with two or fewer differing bits meet under these two; with none, under the value itself.
            low = (va ^ vb) & (~(va ^ vb) + np.uint32(1))
            here = np.minimum((va ^ low) & mask, (vb ^ low) & mask) == own
            a, b = a[here], b[here]
            differ = rows["words"][a] ^ rows["words"][b]
            apart_in = np.bitwise_count(differ[:, :-1].copy().view("<u4"))
            first = np.argmax(apart_in <= 2, axis=1) == t
            close = apart_in.sum(axis=1, dtype=np.int64) + np.bitwise_count(differ[:, -1]) <= most
            pairs = np.column_stack([rows["node"][a], rows["node"][b]])[first & close]
            out.append(np.unique(np.sort(pairs, axis=1), axis=0))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])})

    nodes = written(nodes.select("node", "root", *WORDS))
    some = written(nodes.join(written(partnered(nodes)), "node").select("node", "root", *WORDS))
    # Blocks of a split class may make a pair more than once.
    return _in_classes(some, WORDS, meet, "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node and shingle hashes of documents that have a node."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                sets = [shingle_set(t, shingle).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, hashes array<bigint>")


def first_shingles(n, similarity: float):
    """How many shingles of a set of n come first: similar sets share one of them."""
    return n - F.ceil(n * F.lit(similarity) - F.lit(1e-9)) + 1


def _short(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, hash) of the first shingles, rare ones first, of each of the sets (node, few)."""
    each = written(sets.select("node", F.size("few").alias("n"), F.explode("few").alias("hash")))
    shared = each.groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1")
    # Shingles of one text come first and are shared with none: only their number counts.
    known = each.join(shared, "hash").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "hash"))).alias("s"))
    left = first_shingles(F.col("n"), similarity) - (F.col("n") - F.size("s"))
    return written(known.withColumn("left", left.cast("int")).filter("left > 0").select("node", F.explode(F.slice("s", F.lit(1), F.col("left"))["hash"]).alias("hash")))


def sharing(first: DataFrame, named: DataFrame) -> DataFrame:
    """All pairs (a, b) of nodes with a common hash and different roots."""
    rows = first.join(named.select("node", "root"), "node")
    parts = -(-first.count() // PER_PART)

    def meet(table):
        import pyarrow as pa

        value, node, root = (table.column(c).to_numpy() for c in ("hash", "node", "root"))
        pairs = apart(value, node, root, np.zeros(len(node), _U))
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(max(64, parts))))
    return dealt.groupBy("part").applyInArrow(meet, "a bigint, b bigint").distinct()


def _sets_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node and shingle hashes of the ends of pairs."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "of.*"), "node")
    texts = docs.select("text", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("row_key")).join(asked, ["id", "row_key"]).dropDuplicates(["node"])
    return written(_sets(texts, shingle))


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, ra, rb) whose sets (node, hashes) are similar enough, exactly."""
    both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.filter(common >= F.lit(similarity) * (F.size("ha") + F.size("hb") - common)).select("a", "b", "ra", "rb")


def _between(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (a, b, …) whose ends aren't linked already, with their roots ra and rb."""
    ra, rb = (named.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    return pairs.join(ra, "a").join(rb, "b").filter("ra <> rb")


def _renamed(named: DataFrame, links: DataFrame) -> DataFrame:
    """named (node, low, root) with the roots joined that links (ra, rb) connect."""
    further = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).toDF("root", "next")
    return written(named.join(further, "root", "left").select("node", "low", F.coalesce("next", "root").alias("root")))


def _keyed_links(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    sure, most = limits(similarity)
    sketched = written(sketches(docs, shingle, int(SHORT / similarity + 1e-9)))
    one_of = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "row_key")).alias("of")
    nodes = sketched.groupBy(*WORDS).agg(F.min("doc_id").alias("low"), one_of, F.min("few").alias("few"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    ends = nodes.select("node", F.array(*WORDS).alias("s"))
    distance = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(len(WORDS))), F.lit(0))
    named = nodes.select("node", "low", F.col("node").alias("root"))
    # Stars link large groups first; what they leave apart meets in all pairs.
    for meeting in (colliding, lambda nodes: unlinked(nodes, most)):
        met = meeting(named.join(nodes.select("node", *WORDS), "node"))
        pairs = met.join(ends.toDF("a", "sa"), "a").join(ends.toDF("b", "sb"), "b")
        pairs = written(_between(pairs.select("a", "b", distance.alias("distance")).filter(F.col("distance") <= most), named))
        named = _renamed(named, pairs.filter(F.col("distance") <= sure))
        # Pairs that the sketch can't decide and whose ends aren't linked already.
        unsure = written(_between(pairs.filter(F.col("distance") > sure).select("a", "b"), named))
        if not unsure.isEmpty():
            named = _renamed(named, _near(unsure, _sets_of(unsure, nodes, docs, shingle), similarity))
    short = nodes.filter("few IS NOT NULL").select("node", "few")
    few = written(_between(sharing(_short(short, similarity), named), named))
    if not few.isEmpty():
        named = _renamed(named, _near(few, short, similarity))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = nodes.select("node", *WORDS).join(named.join(least, "root").select("node", "component_id"), "node")
    return sketched.select("doc_id", "row_key", *WORDS).join(ids, WORDS).select("doc_id", "component_id", "row_key")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of word shingles, those with the smallest doc_id.

    All columns of docs stay. Texts without words (null, empty) are copies of each other. Rows are judged one by
    one: of two texts under one doc_id, one may go and the other stay. A null doc_id counts as largest; in a
    group where all are null, all rows stay, as do repeated rows of the smallest doc_id.
    """
    return survivors(docs, _keyed_links(docs, shingle, similarity))
