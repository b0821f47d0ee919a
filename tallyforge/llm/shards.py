"""Sharding by a hierarchical weighted hash tree: a row descends regions, racks and shards by weighted hash draws.

At each level every child draws an exponential number from the key and the child's place, divided by its weight, and
the smallest wins, so that a child gets rows in proportion to its weight. A child's draw depends on nothing but itself:
where weights change, rows move only into or out of the subtrees whose weights do. A shard that is added as a region of
its own therefore takes rows only into itself. All is column expressions.

A null key draws like an empty one. Rows of one key share a shard. A null text has no bytes. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import free_name, written

#: Weights of shards by rack and region; shards are numbered in this order.
Tree = list[list[list[float]]]
SHARDS, RACKS, OF_RACK = 40, 2, 5
#: Bytes of a row besides its text.
OVERHEAD = 16
LAW = "key"


def balanced(count: int, racks: int = RACKS, of_rack: int = OF_RACK) -> Tree:
    """A tree of equal shards, filled rack by rack and region by region."""
    full = [1.0] * of_rack
    each = [full] * (count // of_rack) + ([[1.0] * (count % of_rack)] if count % of_rack else [])
    return [each[k : k + racks] for k in range(0, len(each), racks)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return [*tree, [[weight]]]


def draw(key: Column, level: str, *place: Column) -> Column:
    """An exponential number with mean 1, from a key and a place in the tree: -ln of 52 bits of an MD5 sum."""
    name = F.concat_ws("/", key, F.lit(level), *(p.cast("string") for p in place))
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52)))


def _chosen(key: Column, level: str, place: list[Column], weights: list[Column]) -> Column:
    """The number of the child whose draw divided by its weight is smallest; children without a weight take no part."""
    part = [F.when(w > 0, F.struct((draw(key, level, *place, F.lit(k)) / w).alias("d"), F.lit(k).alias("k"))) for k, w in enumerate(weights)]
    return (F.least(*part) if len(part) > 1 else part[0])["k"]


def _table(values: list, *place: Column) -> Column:
    """The entry of a nested list at a place; null where there is none."""
    nested = lambda v: F.array(*map(nested, v)) if isinstance(v, list) else F.lit(v)
    return reduce(lambda c, p: F.try_element_at(c, p + 1), place, nested(values))


def shard(rows: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """rows with the number of their shard as a further column."""
    region, rack, keyed = (free_name([*rows.columns, name], c) for c in ("region", "rack", "key"))
    at = [F.col(region), F.col(rack)]
    below = [[sum(w) for w in racks] for racks in tree]
    first, numbers = 0, []
    for racks in tree:
        numbers.append([])
        for w in racks:
            numbers[-1].append(first)
            first += len(w)
    out = rows.withColumn(keyed, F.coalesce(key.cast("string"), F.lit("")))
    k = F.col(keyed)
    out = out.withColumn(region, _chosen(k, "region", [], [F.lit(sum(w)) for w in below]))
    out = out.withColumn(rack, _chosen(k, "rack", at[:1], [_table([[*w, *[0.0] * 99][c] for w in below], at[0]) for c in range(max(map(len, tree)))]))
    widest = max(len(w) for racks in tree for w in racks)
    own = _chosen(k, "shard", at, [_table([[[*w, *[0.0] * 999][c] for w in racks] for racks in tree], *at) for c in range(widest)])
    return out.withColumn(name, (_table(numbers, *at) + own).cast("int")).drop(region, rack, keyed)


def manifest(docs: DataFrame, tree: Tree, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of each row.

    Slots count the rows of a shard in the order of id, size and CRC. The rows, without texts, are sorted over all
    machines and written in that order; a row's slot is what its shard holds in earlier files and earlier in its own.
    Equal rows are told apart by where they were written first, so that no run of equal ones lands in one task.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    placed = written(shard(shard(rows, F.col("id"), tree, "shard"), F.col("id"), grown(tree), "grown_shard"))
    order = ["shard", "id", "size", "crc"]
    ordered = written(placed.withColumns({"file": F.xxhash64("_metadata.file_path"), "row": F.col("_metadata.row_index")}).sort(*order, "file", "row"))
    ordered = ordered.select(*order, "grown_shard", F.struct(*order[1:], "file", "row").alias("place"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("at"))
    runs = ordered.groupBy("shard", "part").agg(F.min("place").alias("first"), F.min("at").alias("start"), F.count("*").alias("n"))
    earlier = F.sum("n").over(_by("shard").orderBy("first").rowsBetween(_by().unboundedPreceding, -1))
    runs = runs.select("shard", "part", (F.coalesce(earlier, F.lit(0)) - F.col("start")).alias("base"))
    return ordered.join(runs, ["shard", "part"]).select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"), "grown_shard",
    )


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns) if columns else Window


def write(docs: DataFrame, tree: Tree, path: str, id_column: str = "doc_id", tasks_of_shard: int = 1) -> None:
    """Writes the rows as Parquet, one folder for each shard; several tasks may share a shard, told apart by the row's hash."""
    name = free_name(docs.columns, "shard")
    out = shard(docs, F.col(id_column), tree, name)
    part = F.pmod(F.xxhash64(*(F.col(c) for c in docs.columns)), F.lit(tasks_of_shard))
    out.repartition(name, part).write.partitionBy(name).parquet(path)


def sql() -> str:
    """The same rows by joining every row with every child; CRCs by nibbles of the text's bytes."""
    nibbles = []
    for v in range(16):
        for _ in range(4):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        nibbles.append(v)
    tree = grown(balanced(SHARDS))
    leaves = [(r, k, c, w) for r, racks in enumerate(tree) for k, rack in enumerate(racks) for c, w in enumerate(rack)]
    listed = ", ".join(f"({n}, {r}, {k}, {c}, {w})" for n, (r, k, c, w) in enumerate(leaves))
    u = lambda *place: f"-ln((('0x' || substr(md5(concat_ws('/', key, {', '.join(place)})), 1, 13))::BIGINT + 0.5) / {1 << 52})"

    def descent(count: int, name: str) -> str:
        return f"""
{name}_leaf AS (SELECT * FROM leaf WHERE n < {count}),
{name}_region AS (SELECT key, arg_min(r, {u("'region'", 'r')} / w) AS r FROM keys, (SELECT r, sum(w)::DOUBLE AS w FROM {name}_leaf GROUP BY r) GROUP BY key),
{name}_rack AS (SELECT key, any_value(r) AS r, arg_min(k, {u("'rack'", 'r', 'k')} / w) AS k FROM {name}_region JOIN (SELECT r, k, sum(w)::DOUBLE AS w FROM {name}_leaf GROUP BY r, k) USING (r) GROUP BY key),
{name} AS (SELECT key, arg_min(n, {u("'shard'", 'r', 'k', 'c')} / w)::INT AS s FROM {name}_rack JOIN {name}_leaf USING (r, k) GROUP BY key)"""

    return f"""
WITH leaf(n, r, k, c, w) AS (VALUES {listed}),
docs AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(text, '') AS text FROM documents),
keys AS (SELECT DISTINCT key FROM docs), {descent(SHARDS, "now")}, {descent(SHARDS + 1, "later")},
q AS (SELECT *, list_transform(string_split(hex(encode(text)), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS q FROM docs),
crc AS (SELECT doc_id, key, (octet_length(encode(text)) + {OVERHEAD})::BIGINT AS size, CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(q), 2), lambda i: [q[i + 1]::BIGINT, q[i]::BIGINT]))), lambda a, b: xor(a >> 4, {nibbles}[1 + (xor(a, b) & 15)])), 4294967295) END AS text_crc32 FROM q)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, now.s AS shard, row_number() OVER (PARTITION BY now.s ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, later.s AS grown_shard
FROM crc JOIN now USING (key) JOIN later USING (key)"""
