"""The shard tree: draws by plain Python, where rows move, slots without gaps, no Python in the plan."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import shards

SCHEMA = "doc_id bigint, text string, shard string, key string, region int, size string, part int"


def plainly(key, tree):
    def least(level, place, weights):
        def value(k):
            h = hashlib.md5("/".join([key, level, *map(str, place), str(k)]).encode()).hexdigest()
            return -math.log((int(h[:13], 16) + 0.5) / 2**52) / weights[k]

        return min((k for k in range(len(weights)) if weights[k] > 0), key=lambda k: (value(k), k))

    r = least("region", [], [sum(map(sum, racks)) for racks in tree])
    k = least("rack", [r], [sum(w) for w in tree[r]])
    c = least("shard", [r, k], tree[r][k])
    return sum(len(w) for racks in tree[:r] for w in racks) + sum(map(len, tree[r][:k])) + c


def rows():
    plain = [(i, f"text {i} é") for i in range(1500)]
    return [*plain, *((2000 + i, "the same text") for i in range(700)), (5, "text 5 é"), (5, "text 5 é"), (5, "other"), (None, "no id"), (None, None), (-7, ""), (9000, None), (9001, "字" * 50_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "k", 1, "z", 2) for i, t in rows()], SCHEMA).repartition(5)


def assigned(docs, tree):
    return [(r["doc_id"], r["_s"]) for r in shards.shard(docs, F.col("doc_id"), tree, "_s").collect()]


UNEVEN = [[[1.0, 2.0, 0.0], [0.5]], [[4.0]], [[1.0], [1.0], [3.0, 1.0]]]


@pytest.mark.parametrize("tree", [shards.balanced(40), shards.balanced(1), shards.balanced(13), UNEVEN, shards.grown(shards.grown(UNEVEN))])
def test_rows_go_where_plain_python_sends_them(docs, tree):
    got = assigned(docs, tree)
    assert sorted(map(repr, got)) == sorted(repr((i, plainly("" if i is None else str(i), tree))) for i, _ in rows())


def test_columns_stay(docs):
    out = shards.shard(docs, F.col("doc_id"), shards.balanced(40), "_s")
    assert out.columns == [*docs.columns, "_s"]
    assert {r["shard"] + r["key"] for r in out.select("shard", "key").distinct().collect()} == {"sk"}


@pytest.mark.parametrize("count", [1, 2, 39, 40])
def test_one_more_shard_takes_rows_only_into_itself(docs, count):
    tree = shards.balanced(count)
    for _ in range(3):
        more = shards.grown(tree)
        n = sum(len(w) for racks in tree for w in racks)
        moved = {(a, b) for (_, a), (_, b) in zip(sorted(map(repr_key, assigned(docs, tree))), sorted(map(repr_key, assigned(docs, more)))) if a != b}
        assert moved and {b for _, b in moved} == {n}
        tree = more


def repr_key(pair):
    return (repr(pair[0]), pair[1])


def test_changed_weights_move_rows_into_their_subtree_alone(spark):
    ids = spark.range(6000)
    tree = [[[1.0, 1.0], [1.0, 1.0]], [[1.0, 1.0], [1.0, 1.0]]]
    more = [[[1.0, 1.0], [1.0, 3.0]], [[1.0, 1.0], [1.0, 1.0]]]
    both = shards.shard(shards.shard(ids, F.col("id"), tree, "a"), F.col("id"), more, "b")
    moved = Counter((r["a"], r["b"]) for r in both.filter("a <> b").collect())
    assert all(b < 4 for _, b in moved)  # into the region whose weight rose
    assert all(b in (2, 3) for a, b in moved if a < 4)  # within it, into the rack whose weight rose
    assert all(b == 3 for a, b in moved if a in (2, 3))  # within that, into the shard whose weight rose
    counts = Counter(r["b"] for r in both.collect())
    assert abs(counts[3] - 6000 * 0.3) < 200 and abs(counts[0] - 600) < 120


def test_manifest(docs):
    out = shards.manifest(docs, shards.balanced(40))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    assert len(got) == len(rows())
    own = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == own
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
        assert r["law"] == "key" and r["shard"] == plainly("" if r["doc_id"] is None else str(r["doc_id"]), shards.balanced(40))
        assert r["grown_shard"] in (r["shard"], 40)
    for each in by.values():
        each.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in each] == list(range(len(each)))
        order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in each]
        assert order == sorted(order)


def test_manifest_of_a_repeated_row_in_many_files(spark):
    df = spark.range(4000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("same").alias("text")).repartition(8)
    got = sorted(r["slot"] for r in shards.manifest(df, shards.balanced(40)).collect())
    assert got == list(range(4000))


def test_empty_and_plan(spark, docs):
    assert shards.manifest(docs.limit(0), shards.balanced(40)).collect() == []
    plan = shards.shard(docs, F.col("doc_id"), shards.balanced(40), "_s")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_written_shards(spark, docs, tmp_path):
    shards.write(docs, shards.balanced(6), str(tmp_path / "out"), tasks_of_shard=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows())
    wanted = sorted(repr((i, plainly("" if i is None else str(i), shards.balanced(6)))) for i, _ in rows())
    assert sorted(repr((r["doc_id"], r["shard_"])) for r in back.select("doc_id", "shard_").collect()) == wanted


def test_sql_agrees(docs):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows() if len(r[1] or "") < 1000])
    small = docs.filter("text IS NULL OR length(text) < 1000")
    assert sorted(map(repr, con.execute(shards.sql()).fetchall())) == sorted(repr(tuple(r)) for r in shards.manifest(small, shards.balanced(40)).collect())
