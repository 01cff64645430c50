"""Helpers shared by the operators: row-batch iteration, splitting of hot
groups into bounded tiles, and connected components of an edge table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbscope.session import ensure_checkpoint_dir


def col(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of a few rows, so that Python objects of
    only so many (possibly very long) texts exist at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that
    later reads survive lost executors without recomputing it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def tiles(df: DataFrame, keys: list[str], item: str, size: int, weight: str | None = None,
          heavy: int = 1 << 22) -> DataFrame:
    """Rows dealt out so that all pairs of a group meet, in bounded tiles.

    Groups (equal ``keys``) of one row go. A group of up to ``size`` rows is
    one tile (_lo = _hi = 0). A larger one is cut by a hash of ``item`` into
    chunks of about ``size`` rows, and each pair of chunks _lo <= _hi is a
    tile: a row with _side = 0 is of chunk _lo, one with _side = 1 of chunk
    _hi. In a tile with _lo < _hi only pairs across the two sides count.
    With a ``weight`` column, chunks have at most about ``heavy`` of it.
    """
    total = F.sum(weight) if weight else F.lit(0)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), total.alias("_w")).where("_n > 1")
    parts = F.ceil(F.least(F.col("_n"), F.greatest(F.col("_n") / F.lit(size), F.col("_w") / F.lit(heavy)))).cast("int")
    return (
        df.join(counts, keys)
        .withColumn("_parts", parts)
        .withColumn("_chunk", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_lo", F.least("_chunk", "_other"))
        .withColumn("_hi", F.greatest("_chunk", "_other"))
        .withColumn("_side", (F.col("_chunk") != F.col("_lo")).cast("int"))
        .drop("_n", "_w", "_parts", "_chunk", "_other")
    )


#: Rows of a small side up to which it is broadcast: some tens of MB.
SMALL_ROWS = 200_000


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (held, so that counting it is cheap):
    by broadcast if it has at most ``SMALL_ROWS`` rows, by shuffle beyond."""
    return big.join(F.broadcast(small) if small.count() <= SMALL_ROWS else small, keys, how)


#: Rows of a table of hot keys up to which it is broadcast.
HOT_KEYS = 20_000


def hot_tiles(df: DataFrame, keys: list[str], item: str, size: int) -> DataFrame:
    """Like ``tiles`` for many small groups: only the keys of more than
    ``size`` rows are counted out and joined, and rows without a partner
    stay. ``df`` is read twice and should be cheap to make."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
    hot = held(hot.withColumn("_parts", F.ceil(F.col("_n") / F.lit(size)).cast("int")).drop("_n"))
    n = hot.count()
    zero = F.lit(0)
    if not n:
        return df.withColumns({"_lo": zero, "_hi": zero, "_side": zero})
    hot = F.broadcast(hot) if n <= HOT_KEYS else hot
    parts = F.coalesce("_parts", F.lit(1))
    return (
        df.join(hot, keys, "left")
        .withColumn("_chunk", F.pmod(F.xxhash64(item), parts).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("_lo", F.least("_chunk", "_other"))
        .withColumn("_hi", F.greatest("_chunk", "_other"))
        .withColumn("_side", (F.col("_chunk") != F.col("_lo")).cast("int"))
        .drop("_parts", "_chunk", "_other")
    )


def sorted_groups(df: DataFrame, keys: list[str], extra: list[str] = ()) -> DataFrame:
    """Rows of a group in one partition, next to each other."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *extra)


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group of integer ``keys`` begins."""
    n = table.num_rows
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1) -> Iterator[pa.Table]:
    """Tables of complete groups from batches of sorted rows, of at least
    ``rows`` rows each but for the last."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(starts_of(table, keys)[-1])
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut).combine_chunks()
        held, size = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``parent`` (root of each item, smallest index of its set) after the
    sets of i[k] and j[k] are joined for every k."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): smallest id reachable over ``edges`` (a, b) of longs.

    Only ids that have an edge to another id appear. Alternating large-star
    and small-star rounds on the edge table: each hooks neighbours to the
    smallest one seen, until every id points at the smallest of its
    component (logarithmic in practice). Each round is checkpointed.
    """
    e = held(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        mark = tuple(
            e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        )
        if mark == before or not mark[0]:
            break
        before = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = held(
            large.join(least, "u")
            .select(
                F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                F.col("m").alias("v"),
            )
            .where("u <> v").distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    least = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return least.withColumnRenamed("u", "id").union(roots)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new folder below the shared checkpoint
    folder, and read again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
