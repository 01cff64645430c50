"""Composite Congestion Impact Score, what-if re-scoring and movers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbscope.operators.ranks import average_pct_ranks, ordinal_rank
from curbscope.schema import CIS_WEIGHTS

SCORE_SOURCES = {
    "score_severity": "severity_weighted_count",
    "score_junction": "junction_fraction",
    "score_busy_hour": "busy_hour_fraction",
    "score_persistence": "persistence_ratio",
}


def percentile_scores(features: DataFrame) -> DataFrame:
    """Average-tie percentile rank (0, 1] of the four score features."""
    return average_pct_ranks(features, SCORE_SOURCES)


def weighted_score(ws: float, wj: float, wb: float, wp: float) -> Column:
    """``(ws*s_sev + wj*s_jct + wb*s_busy + wp*s_pers) * 100``, left to right."""
    lit = F.lit
    return (lit(float(ws)) * F.col("score_severity")
            + lit(float(wj)) * F.col("score_junction")
            + lit(float(wb)) * F.col("score_busy_hour")
            + lit(float(wp)) * F.col("score_persistence")) * lit(100.0)


def cis_column() -> Column:
    w = CIS_WEIGHTS
    return weighted_score(w["severity"], w["junction"], w["busy_hour"], w["persistence"])


def score_hotspots(features: DataFrame) -> DataFrame:
    return percentile_scores(features).withColumn("congestion_impact_score", cis_column())


def cis_order() -> list[Column]:
    return [F.col("congestion_impact_score").desc(), F.col("hex_id").asc()]


def normalise_weights(w_sev: float, w_jct: float, w_bh: float, w_per: float):
    total = w_sev + w_jct + w_bh + w_per
    if total == 0:
        raise ValueError("All weights are 0 - set at least one weight > 0.")
    return w_sev / total, w_jct / total, w_bh / total, w_per / total


def whatif_ranks(hotspots: DataFrame, w_sev: float = 40, w_jct: float = 20,
                 w_bh: float = 20, w_per: float = 20) -> DataFrame:
    """Re-score from the stored percentile ranks (no re-aggregation) and
    rank twice: ``original_rank`` by CIS, ``new_rank`` by what-if score
    (ties keep the original order); ``rank_change = original - new``.
    Output: the ranking columns plus the ranks and both scores."""
    ws, wj, wb, wp = normalise_weights(w_sev, w_jct, w_bh, w_per)
    # Only the ranking columns travel through the two sorts and checkpoints.
    cols = ["hex_id", "dominant_station", "tier", "congestion_impact_score", *SCORE_SOURCES]
    base = ordinal_rank(hotspots.select(*cols), cis_order(), "original_rank")
    base = base.withColumn("whatif_cis", weighted_score(ws, wj, wb, wp))
    ranked = ordinal_rank(base, [F.col("whatif_cis").desc(), F.col("original_rank").asc()],
                          "new_rank")
    return ranked.withColumn("rank_change", F.col("original_rank") - F.col("new_rank"))


def whatif_first(hotspots: DataFrame, w_sev: float, w_jct: float, w_bh: float, w_per: float,
                 top: int = 25) -> DataFrame:
    """``whatif_top`` without ranking all cells: a top-k by score picks the
    ``top`` rows (ties in CIS order), and one aggregate counts for each of
    them the cells ahead of it by CIS, which is its original rank. The
    ``top`` rows are fetched when the plan is built."""
    ws, wj, wb, wp = normalise_weights(w_sev, w_jct, w_bh, w_per)
    cols = ["hex_id", "dominant_station", "tier", "congestion_impact_score"]
    base = hotspots.select(*cols, weighted_score(ws, wj, wb, wp).alias("whatif_cis"))
    picked = base.orderBy(F.col("whatif_cis").desc(), *cis_order()).limit(top)
    rows = [(i + 1, *r) for i, r in enumerate(picked.collect())]

    def ahead(cell: str, score: float) -> str:
        text = cell.replace("\\", "\\\\").replace("'", "\\'")
        own = f"double('{float(score)!r}')"
        return (f"count_if(congestion_impact_score > {own} or "
                f"(congestion_impact_score = {own} and hex_id < '{text}'))")

    counts = hotspots.agg(F.expr(f"array({', '.join(ahead(r[1], r[4]) for r in rows)})").alias("ahead"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    first = hotspots.sparkSession.createDataFrame(rows, f"new_rank long, {kinds}")
    first = first.withColumn("original_rank", F.get(counts.scalar(), (F.col("new_rank") - 1).cast("int")) + 1)
    return whatif_top(first.withColumn("rank_change", F.col("original_rank") - F.col("new_rank")), top)


def whatif_top(ranked: DataFrame, top: int = 25) -> DataFrame:
    return (ranked.filter(F.col("new_rank") <= top)
            .select("new_rank", "hex_id", "dominant_station", "tier",
                    "congestion_impact_score", "whatif_cis", "original_rank", "rank_change"))


def whatif_movers(ranked: DataFrame, min_change: int = 5, limit: int = 6) -> DataFrame:
    """First ``limit`` cells in what-if order whose rank moved by more than
    ``min_change`` places."""
    return (ranked.filter(F.abs(F.col("rank_change")) > min_change)
            .orderBy("new_rank").limit(limit)
            .select("new_rank", "hex_id", "dominant_station", "tier",
                    "congestion_impact_score", "whatif_cis", "rank_change",
                    F.when(F.col("rank_change") > 0, F.lit("rose")).otherwise(F.lit("fell"))
                    .alias("direction"),
                    F.abs(F.col("rank_change")).alias("positions")))
