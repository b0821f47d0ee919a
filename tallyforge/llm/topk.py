"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers; a term is a dimension. Queries and candidates are dealt into blocks of bounded size
and each pair of blocks meets in one group: for each term, the queries that have it scatter their weight
times the term's postings into dense score arrays. Each group selects its k best by partition, and the
blocks' winners are merged by score and id.

Vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part.
Missing components of shorter vectors count as 0. Every row that is a query is asked, and all other rows are its
candidates, those with its id too: of the k + 1 best of all rows the first that has the query's id and its score with
itself is taken away, or else the last. Equal queries are scored once and answered as often as they occur.
Scores are 64-bit integers: components beyond 2^63 / scale count as that, and sums beyond it wrap. Other columns
are ignored. Candidates are sent once for each QUERY_BLOCK queries, so with fewer queries than that each is sent once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import partitions

#: Rows of a block of queries and of a block of candidates; queries scored together.
QUERY_BLOCK, CANDIDATE_BLOCK, TOGETHER = 32768, 8192, 64


_FOUND = ("query_id", "qa", "qb", "times", "own", "vec_id", "score")


def accumulated(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all queries (rows) and candidates (columns), one term after the other."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        rows, posting = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        if len(rows) == len(queries) and len(posting) == len(candidates):
            scores += queries[:, term, None] * candidates[None, :, term]
        elif len(rows) and len(posting):
            scores[np.ix_(rows, posting)] += queries[rows, term, None] * candidates[None, posting, term]
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, the first of equal ones first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _matrix(table) -> np.ndarray:
    """Rows of an Arrow column of lists, scaled to integers; shorter rows end in zeros."""
    lists = table.column("embedding").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def searched(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row that ``is_query`` holds for."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = vectors.filter(F.coalesce(valid, F.lit(False))).select("vec_id", whole.alias("embedding"))
    which = [F.xxhash64("embedding", F.lit(seed)).alias(n) for n, seed in (("qa", 1), ("qb", 2))]  # tells queries of one id apart
    queries = rows.filter(is_query).groupBy("vec_id", "embedding").agg(F.count("*").alias("times")).select("*", *which)
    n_queries, n_rows = queries.count(), rows.count()
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    blocks = max(min(partitions(vectors.sparkSession), -(-n_rows // 256)), -(-n_rows // CANDIDATE_BLOCK), 1)
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("q", spread(query_blocks, 1)).withColumn("c", every(blocks))
    right = rows.withColumn("c", spread(blocks, 2)).withColumn("q", every(query_blocks))

    def score(asked, offered):
        import pyarrow as pa

        if not asked.num_rows or not offered.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in _FOUND})
        offered = offered.sort_by("vec_id")
        ids = offered.column("vec_id").to_numpy()
        keys = [asked.column(n).to_numpy() for n in ("vec_id", "qa", "qb", "times")]
        candidates, wanted = _matrix(offered), _matrix(asked)
        own = (wanted * wanted).sum(axis=1)
        out = []
        for first in range(0, len(wanted), TOGETHER):
            for i, scores in enumerate(accumulated(wanted[first : first + TOGETHER], candidates), first):
                at = best(scores, k + 1)
                out.append((*(np.full(len(at), key[i]) for key in keys), np.full(len(at), own[i]), ids[at], scores[at]))
        return pa.table({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(_FOUND)})

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(score, ", ".join(f"{n} bigint" for n in _FOUND))
    query = Window.partitionBy("query_id", "qa", "qb")
    order = query.orderBy(F.desc("score"), "vec_id")
    best_rows = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))).over(query)
    others = best_rows.withColumn("itself", F.coalesce(itself, F.lit(k + 1))).filter("place <> itself")
    ranked = others.withColumn("rank", F.col("place") - (F.col("place") > F.col("itself")).cast("int"))
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("time")).drop("time")


def sql(k: int = 10, scale: int = 1024) -> str:
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i <> c.i WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}
"""
