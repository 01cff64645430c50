"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights. Queries and candidates are
dealt into blocks of bounded size, and each pair of blocks is one task's
group: the candidate block becomes postings (per dimension the candidates
with a non-zero weight there), and each query dimension scatters its weight
times the postings into dense score arrays. A partition selection keeps the
best k per query and block, and a window over those few merges the blocks.
Every query meets every candidate; nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import col

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192
#: Terms that are accumulated at a time where their postings are full.
TERMS = 16


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are
    null or hold null or non-finite components."""
    v = vector.cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(v.isNotNull() & ~F.exists(v, bad), whole)


def postings(rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per dimension: the rows with a non-zero weight, and their weights. A
    list of a quarter of the rows or more holds all rows, zeros included."""
    dims = max((len(r) for r in rows), default=0)
    dense = np.zeros((dims, len(rows)), dtype=np.int64)
    for k, r in enumerate(rows):
        dense[: len(r), k] = r
    found = [np.flatnonzero(d) for d in dense]
    every = np.arange(len(rows))
    found = [every if 4 * len(ids) >= len(rows) else ids for ids in found]
    return [(ids, d[ids]) for ids, d in zip(found, dense)]


def accumulate(query: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores (queries x n), term by term; terms whose postings hold every
    row are added several at a time. Where all sums provably fit, the
    arrays are of floats, which hold such integers exactly."""
    m = min(query.shape[1], len(terms))
    most = sum(float(abs(query[:, t]).max()) * float(abs(w).max()) if len(w) else 0.0 for t, (_, w) in zip(range(m), terms))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    scores = np.zeros((len(query), n), dtype=kind)
    query = query.astype(kind)
    used = [t for t in range(m) if len(terms[t][0]) and query[:, t].any()]
    full = [t for t in used if len(terms[t][0]) == n]
    for at in range(0, len(full), TERMS):
        some = full[at : at + TERMS]
        scores += query[:, some] @ np.stack([terms[t][1] for t in some]).astype(kind)
    for t in used:
        ids, weights = terms[t]
        if len(ids) < n:
            scores[:, ids] += query[:, t, None] * weights.astype(kind)[None, :]
    return scores.astype(np.int64)


def best(scores: np.ndarray, own: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of scores the columns of its k best by (score desc,
    column asc), leaving out those marked in ``own``."""
    for s, out in zip(scores, own):
        idx = np.flatnonzero(~out) if out.any() else np.arange(len(s))
        s = s[idx]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > least)
            pick = np.concatenate((above, np.flatnonzero(s == least)[: k - len(above)]))
        else:
            pick = np.arange(len(s))
        yield idx[pick[np.lexsort((pick, -s[pick].astype(np.int64)))]]


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
          k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` best of
    all candidate rows by integer inner product of floor(scale * x).

    Queries: rows whose id is divisible by ``every``. Candidates: every row
    with an id other than the query's. Ties go to the smaller id. Vectors
    that are null or hold null or non-finite components take no part, nor do
    rows without an id. Vectors of different length meet on the dimensions
    they share. Rows that repeat id and vector count once; rows with one id
    and different vectors are candidates each, and queries each (their ranks
    are listed under the same query_id). Components must be below 2**63 /
    scale and scores must fit in a long. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = vectors.select(col(id_col).cast("long").alias("id"), quantised(col(vector_col), scale).alias("q"))
    rows = rows.where("id is not null and q is not null").distinct()
    rows = common.held(rows.withColumn("key", F.xxhash64("q")))
    asked = rows.where(F.col("id") % every == 0)
    n, m = rows.count(), asked.count()
    nc, nq = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    cut = lambda parts: F.pmod(F.xxhash64("id", "q"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    pairs = rows.withColumn("c", cut(nc)).withColumn("b", each(nq)).withColumn("asks", F.lit(0)).union(
        asked.withColumn("b", cut(nq)).withColumn("c", each(nc)).select("id", "q", "key", "c", "b", F.lit(1).alias("asks"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.whole_groups(batches, ["c", "b"]):
            cuts = common.starts_of(table, ["c", "b"]).tolist() + [table.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                part = table.slice(a, z - a)
                asks = part.column("asks").to_numpy() == 1
                ids, keys = part.column("id").to_numpy(), part.column("key").to_numpy()
                vecs = [np.array(v, dtype=np.int64) for v in part.column("q").to_pylist()]
                cand, query = np.flatnonzero(~asks), np.flatnonzero(asks)
                if not len(cand) or not len(query):
                    continue
                terms = postings([vecs[i] for i in cand])
                wide = max(len(vecs[i]) for i in query)
                dense = np.zeros((len(query), wide), dtype=np.int64)
                for x, i in enumerate(query):
                    dense[x, : len(vecs[i])] = vecs[i]
                for at in range(0, len(query), 64):
                    these = query[at : at + 64]
                    scores = accumulate(dense[at : at + 64], terms, len(cand))
                    own = ids[these][:, None] == ids[cand][None, :]
                    for i, s, pick in zip(these, scores, best(scores, own, k)):
                        yield pa.record_batch(
                            [pa.array(np.full(len(pick), ids[i])), pa.array(np.full(len(pick), keys[i])),
                             pa.array(ids[cand[pick]]), pa.array(s[pick].astype(np.int64))],
                            names=["query_id", "key", "vec_id", "score"],
                        )

    dealt = common.sorted_groups(pairs, ["c", "b"], ["asks", "id"])
    found = dealt.mapInArrow(run, "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


#: The same result in DuckDB SQL, for k = 20, every = 20, scale = 64.
SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(64.0::DOUBLE * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, a.q, b.vec_id,
         coalesce(list_sum([a.q[i] * b.q[i] FOR i IN range(1, least(len(a.q), len(b.q)) + 1)]), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
