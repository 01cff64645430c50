"""Distributed global ranks (no un-partitioned window over the data).

A plain ``row_number().over(Window.orderBy(...))`` moves every row into one
task. Instead:

1. ``orderBy`` range-partitions and sorts the rows across the cluster;
2. each row records its partition id and in-partition position
   (``spark_partition_id``, ``monotonically_increasing_id``), and the result
   is checkpointed to ``spark.checkpoint.dir`` so these ids are stable even
   if executors are lost and stages recompute;
3. per-partition counts (one row per partition, a size bounded by the
   partition count) become prefix offsets, which are broadcast and added.

``average_pct_ranks`` applies the same scheme to several columns at once
(one long table sorted by column, value and id) and returns the
average-tie percentile rank ``(rank_min + rank_max) / 2 / n`` computed as
``(2 * less + count + 1) / (2 * n)`` from exact integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbscope.session import ensure_checkpoint_dir

_ALL_BEFORE = (Window.unboundedPreceding, -1)


def _positioned(df: DataFrame, order: list[Column]) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order).withColumns({
        "_pid": F.spark_partition_id(),
        "_mid": F.monotonically_increasing_id(),
    })
    return ordered.checkpoint(eager=True)


def ordinal_rank(df: DataFrame, order: list[Column], out_col: str = "rank") -> DataFrame:
    """1..n row number over a total order (add a unique tiebreak column)."""
    pos = _positioned(df, order)
    counts = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(*_ALL_BEFORE)),
                   F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (pos.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, F.col("_off") + local + 1)
            .drop("_pid", "_mid", "_off"))


def average_pct_ranks(df: DataFrame, columns: dict[str, str], id_col: str = "hex_id") -> DataFrame:
    """Add ``out = pct_rank(src)`` for each ``{out: src}``; NULLs stay NULL.

    Ranks are taken over all non-null values of each column (pandas
    ``rank(pct=True)`` semantics with average ties). ``id_col`` must be
    unique.

    Rows are sorted by (column, value, id), so a value that a large share of
    the rows has lies in several partitions. Each partition counts its own
    values; the rank of a value joins back on the partition id as well, so
    no join key holds more rows than one partition does.
    """
    cells = F.array(*[F.struct(F.lit(out).alias("feature"), F.col(src).cast("double").alias("value"))
                      for out, src in columns.items()])
    long = df.select(F.col(id_col).alias("_id"), F.explode(cells).alias("kv")).select("_id", "kv.*")
    pos = _positioned(long.filter(F.col("value").isNotNull()),
                      [F.col("feature"), F.col("value"), F.col("_id")]).drop("_mid")
    counts = pos.groupBy("_pid", "feature", "value").agg(F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy("_pid", "feature").orderBy("value").rowsBetween(*_ALL_BEFORE)
    counts = counts.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    totals = counts.groupBy("feature", "_pid").agg(F.sum("_c").alias("_t"))
    across = Window.partitionBy("feature").orderBy("_pid")
    offsets = totals.select(
        "feature", "_pid",
        F.coalesce(F.sum("_t").over(across.rowsBetween(*_ALL_BEFORE)), F.lit(0)).alias("_off"),
        F.sum("_t").over(Window.partitionBy("feature")).alias("_n"))
    # One row per partition and value; a value's rows are a few, its partitions.
    placed = counts.join(F.broadcast(offsets), ["feature", "_pid"])
    same = Window.partitionBy("feature", "value")
    less = F.min(F.col("_off") + F.col("_in")).over(same)
    ties = F.sum("_c").over(same)
    pct = (less * 2 + ties + 1).cast("double") / (F.col("_n") * 2).cast("double")
    lookup = placed.select("_pid", "feature", "value", pct.alias("pct"))
    ranked = pos.join(lookup, ["_pid", "feature", "value"]).groupBy("_id").agg(*[
        F.max(F.when(F.col("feature") == name, F.col("pct"))).alias(name) for name in columns])
    return df.join(ranked, F.col(id_col) == F.col("_id"), "left").drop("_id")
