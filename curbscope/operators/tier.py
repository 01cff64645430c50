"""Priority tiers: KMeans on standardised cell features.

* features (nulls -> 0): severity_weighted_count, junction_fraction,
  busy_hour_fraction, persistence_ratio, growth_rate;
* ``k_eff = min(k, #cells)``; ``k_eff < 2`` -> every cell "Critical"
  (``cluster`` NULL);
* ``operators.kmeans`` with ``n_init`` k-means++ restarts, all of them in one
  aggregation per iteration; the fit of the lowest cost wins;
* clusters ordered by mean CIS (desc; ties by cluster id) are labelled
  Critical, High, Medium, Low (any further cluster -> Low).

KMeans runs on the cell table (one row per cell), never on records. Its sums
are exact, so tiers do not depend on partitions, on
``spark.sql.shuffle.partitions`` or on the cluster. Labels cannot match
other KMeans implementations bit for bit (different random draws).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbscope.operators import kmeans
from curbscope.schema import TIER_FEATURES, TIER_ORDER
from curbscope.session import ensure_checkpoint_dir


def label_clusters(df: DataFrame, cluster_col: str = "cluster",
                   score_col: str = "congestion_impact_score") -> DataFrame:
    """(cluster, mean_cis, cluster_rank, tier): at most k rows."""
    means = df.groupBy(cluster_col).agg(F.avg(score_col).alias("mean_cis"))
    rank = F.row_number().over(Window.orderBy(F.col("mean_cis").desc(), F.col(cluster_col)))
    labels = F.array(*[F.lit(t) for t in TIER_ORDER])
    return (means.withColumn("cluster_rank", rank)
            .withColumn("tier", F.element_at(labels, F.least(F.col("cluster_rank"),
                                                              F.lit(len(TIER_ORDER))))))


def apply_labels(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    labels = label_clusters(df, cluster_col).select(cluster_col, "tier")
    # at most k rows: a proven broadcast bound
    return df.join(F.broadcast(labels), cluster_col, "left")


def tier_hotspots(hotspots: DataFrame, k: int = 4, seed: int = 42, n_init: int = 10,
                  max_iter: int = 300) -> DataFrame:
    """``hotspots`` with the columns cluster and tier."""
    ensure_checkpoint_dir(hotspots.sparkSession)
    found = kmeans.fit(hotspots, "hex_id", TIER_FEATURES, k, n_init, seed, max_iter)
    if found is None:
        return (hotspots.withColumn("cluster", F.lit(None).cast("int"))
                .withColumn("tier", F.lit(TIER_ORDER[0])))
    return apply_labels(hotspots.join(found.assigned, "hex_id"))


def tier_invariants(tiered: DataFrame, k: int = 4, slack: float = 0.01) -> DataFrame:
    """One row of facts that any right tiering of ``tiered`` has: all cells
    have a tier, there are at most ``k`` clusters, tiers follow the clusters'
    mean scores, and no cell's standardised features are nearer (by more than
    ``slack``, the fit's tolerance) to another cluster's mean than to its
    own. The cluster means are at most ``k`` rows."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in TIER_FEATURES}
    spread = tiered.agg(*[F.stddev_samp(v).alias(c) for c, v in x.items()]).first()
    z = [(v / F.lit(spread[c])).alias(c) if spread[c] else F.lit(0.0).alias(c) for c, v in x.items()]
    cells = tiered.select("hex_id", "cluster", "tier", "congestion_impact_score", *z)
    means = cells.groupBy("cluster", "tier").agg(
        *[F.avg(c).alias(c) for c in TIER_FEATURES], F.avg("congestion_impact_score").alias("cis")).collect()
    order = [m["tier"] for m in sorted(means, key=lambda m: -m["cis"])]
    ordered = all(TIER_ORDER.index(a) <= TIER_ORDER.index(b) for a, b in zip(order, order[1:]))

    def far(m) -> Column:
        return sum(((F.col(c) - F.lit(m[c])) ** 2 for c in TIER_FEATURES), F.lit(0.0))

    own, least = F.lit(0.0), F.lit(0.0)
    if means and means[0]["cluster"] is not None:
        own = F.coalesce(*[F.when(F.col("cluster") == m["cluster"], far(m)) for m in means])
        least = F.least(*[far(m) for m in means], F.lit(float("inf")))
    return cells.agg(
        F.count(F.lit(1)).alias("cells"), F.count("tier").alias("with_tier"),
        F.lit(len(means) <= k).alias("few_clusters"), F.lit(ordered).alias("ordered"),
        F.coalesce(F.every(own <= least + slack), F.lit(True)).alias("nearest"))


def threshold_tiers(df: DataFrame, score_col: str = "congestion_impact_score") -> DataFrame:
    """Deterministic stand-in tier (CIS >= 75 Critical, >= 50 High, >= 25
    Medium, else Low) so operators that consume a tier stay checkable
    against a SQL oracle; ``cluster`` is the tier's index."""
    s = F.col(score_col)
    tier: Column = (F.when(s >= 75, F.lit("Critical")).when(s >= 50, F.lit("High"))
                    .when(s >= 25, F.lit("Medium")).otherwise(F.lit("Low")))
    idx = (F.when(s >= 75, 0).when(s >= 50, 1).when(s >= 25, 2).otherwise(3))
    return df.withColumn("cluster", idx.cast("int")).withColumn("tier", tier)
