"""Embedding near-dedup: Euclidean p-stable hashing.

A normalised vector v has in each table ``k`` values floor((a.v + b) / w)
with Gaussian a and b uniform in [0, w). Vectors that agree on all k values of
some table share a bucket, and every pair that shares one is checked by its
exact cosine in double precision.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so the chance p(c) that one
value agrees is known, and with it the two parameters: k grows with the
logarithm of the number of vectors, so that unrelated ones share few
buckets; the number of tables is then set for ``recall`` at the threshold
(pairs above it are found more often still).

Equal vectors are one class first. A pair is counted only in the first table
that it shares, so counts are right whatever number of tables finds it;
buckets of very many vectors are compared in tiles on many tasks, and a tile
gives counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import col

WIDTH = 2.0
RECALL = 0.97
SEED = 7
TILE = 2048
#: Unrelated vectors that share a bucket, about. It and the next change the
#: work, not the links that are found in the tables.
STRANGERS = 256
MAX_TABLES = 400


def agree(distance: float, width: float) -> float:
    """Chance that two points at ``distance`` share one quantised projection."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, threshold: float, width: float, recall: float) -> tuple[int, int]:
    """(values per table, tables) for ``n`` vectors."""
    near, far = agree(math.sqrt(2 - 2 * threshold), width), agree(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n / STRANGERS, 2)) / -math.log(far)))
    while (tables := math.ceil(math.log(1 - recall) / math.log(1 - near**k))) > MAX_TABLES:
        k -= 1
    return k, tables


def signatures(x: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """32-bit hash of each row's k values in each table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = rng.standard_normal((x.shape[1], tables * k))
    b = rng.uniform(0, width, tables * k)
    odd = rng.integers(0, 2**63, tables * k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(x), tables), dtype=np.uint32)
    for at in range(0, len(x), 256):
        cells = np.floor((x[at : at + 256] @ a + b) / width).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (cells * odd).reshape(len(cells), tables, k)
            h = np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(29)), axis=2) * np.uint64(0x9E3779B97F4A7C15)
        out[at : at + 256] = (h >> np.uint64(32)).astype(np.uint32)
    return out


KEYS = ["table", "key", "_lo", "_hi"]


def _rows(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def links(classes: DataFrame, n: int, dims: int, threshold: float, width: float, recall: float,
          seed: int) -> DataFrame:
    """Of distinct vectors (id, v, copies) of length ``dims``: rows (id,
    other, found): ``found`` copies of vectors linked to id in one tile, and
    an edge to another class (null if it has none of its own to give)."""
    k, tables = parameters(n, threshold, width, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 1024):
            x = _rows(b.column(1), dims)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            own = signatures(x, k, tables, width, seed)
            yield pa.record_batch(
                [pa.array(np.repeat(b.column(0).to_numpy(), tables)),
                 pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))),
                 pa.array(own.reshape(-1).astype(np.int64))],
                names=["id", "table", "key"],
            )

    buckets = classes.select("id", "v").mapInArrow(sign, "id long, table int, key long")
    dealt = common.tiles(buckets, ["table", "key"], "id", TILE).join(classes, "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, KEYS):
            cuts = common.starts_of(t, KEYS).tolist() + [t.num_rows]
            x = _rows(t.column("v"), dims)
            norm = np.linalg.norm(x, axis=1)
            own = signatures(x / norm[:, None], k, tables, width, seed)
            ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
            side, number = t.column("_side").to_numpy(), t.column("table").to_numpy()
            lo, hi = t.column("_lo").to_numpy(), t.column("_hi").to_numpy()
            found, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
            for a, z in zip(cuts, cuts[1:]):
                for i0 in range(a, z, 512):
                    i = np.arange(i0, min(z, i0 + 512))
                    j = np.arange(i0, z)
                    near = (x[i] @ x[j].T) / (norm[i][:, None] * norm[j][None, :]) >= threshold
                    near &= i[:, None] < j[None, :]
                    if lo[a] < hi[a]:
                        near &= side[i][:, None] != side[j][None, :]
                    p, q = np.nonzero(near)
                    if not len(p):
                        continue
                    p, q = i[p], j[q]
                    if number[a]:  # only in the first table that the pair shares
                        for at in range(0, len(p), 1 << 16):
                            part = slice(at, at + (1 << 16))
                            seen = (own[p[part], : number[a]] == own[q[part], : number[a]]).any(axis=1)
                            p[part] = np.where(seen, -1, p[part])
                        p, q = p[p >= 0], q[p >= 0]
                    np.add.at(found, p, copies[q])
                    np.add.at(found, q, copies[p])
                    parent = common.union(parent, p, q)
            has = np.flatnonzero(found)
            if len(has):
                root = ids[parent[has]]
                yield pa.record_batch(
                    [pa.array(ids[has]), pa.array(root, mask=root == ids[has]), pa.array(found[has])],
                    names=["id", "other", "found"],
                )

    return common.sorted_groups(dealt, KEYS).mapInArrow(verify, "id long, other long, found long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     threshold: float = 0.9, width: float = WIDTH, recall: float = RECALL,
                     seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked
    directly, by cosine >= ``threshold``), component_id (smallest vec_id
    reachable, itself included), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. Vectors of different length do not link. Rows that
    repeat a vector, or a whole row, count as so many vectors, each linked
    to the others. Rows without vec_id count as links; if no row of a
    component has one, component_id is null and kept is false. Other columns
    are not read; an empty table gives an empty result.
    """
    kind = "float" if dict(vectors.dtypes).get(vector_col) == "array<float>" else "double"
    v = col(vector_col).cast(f"array<{kind}>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    own = vectors.select(col(id_col).cast("long").alias("vec_id"), F.when(usable, F.transform(v, lambda x: (x + F.lit(0.0)).cast(kind))).alias("v"))
    classes = own.where("v is not null").groupBy("v").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("smallest"))
    classes = common.held(classes.withColumn("id", F.monotonically_increasing_id()))
    edges = None
    for r in classes.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy("dims").collect():
        same = classes.where(F.size("v") == r["dims"]).select("id", "v", "copies")
        part = links(same, r["n"], r["dims"], threshold, width, recall, seed)
        edges = part if edges is None else edges.union(part)
    alone = own.where("v is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if edges is None:
        found = alone
    else:
        edges = common.held(edges)
        comps = common.connected_components(edges.select(F.col("id").alias("a"), F.col("other").alias("b")))
        counts = edges.groupBy("id").agg(F.sum("found").alias("found"))
        rooted = classes.join(counts, "id", "left").join(comps, "id", "left").select(
            "v", "smallest", F.coalesce("component", "id").alias("root"),
            (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"))
        first = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
        named = rooted.join(first, "root").select("v", "n_links", "component_id")
        found = own.join(named, "v").select("vec_id", "n_links", "component_id").union(alone)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return found.withColumn("kept", kept)
