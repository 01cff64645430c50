"""KMeans tiers, cluster labels and what-if re-ranking."""

import pytest
from pyspark.sql import functions as F

from curbscope.operators.score import whatif_movers, whatif_ranks, whatif_top
from curbscope.operators.tier import label_clusters, tier_hotspots

COLS = ("hex_id string, severity_weighted_count double, junction_fraction double, "
        "busy_hour_fraction double, persistence_ratio double, growth_rate double, "
        "congestion_impact_score double")


def cells(n, constant=False):
    return [(f"h{i}", float(i * 10 + 1), 0.5 if constant else i / n, (i % 3) / 3, 1.0 / (i + 1),
             0.0, float(100 - i * 7)) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9])
def test_tiers_by_cell_count(spark, n):
    df = spark.createDataFrame(cells(n), COLS)
    out = tier_hotspots(df, k=4, n_init=2).collect()
    assert len(out) == n
    tiers = {r.tier for r in out}
    if n == 1:
        assert tiers == {"Critical"} and out[0].cluster is None
    else:
        assert tiers <= {"Critical", "High", "Medium", "Low"} and "Critical" in tiers
        assert len({r.cluster for r in out}) <= min(n, 4)
    by_tier = {}
    for r in out:
        by_tier.setdefault(r.tier, []).append(r.congestion_impact_score)
    order = [t for t in ["Critical", "High", "Medium", "Low"] if t in by_tier]
    means = [sum(by_tier[t]) / len(by_tier[t]) for t in order]
    assert means == sorted(means, reverse=True)


def test_constant_feature(spark):
    df = spark.createDataFrame(cells(6, constant=True), COLS)
    assert len(tier_hotspots(df, k=3, n_init=2).collect()) == 6


def test_label_clusters(spark):
    df = spark.createDataFrame([(0, 10.0), (0, 20.0), (1, 90.0), (2, 50.0), (3, 5.0), (4, 1.0)],
                               "cluster int, congestion_impact_score double")
    got = {r.cluster: r.tier for r in label_clusters(df).collect()}
    assert got == {1: "Critical", 2: "High", 0: "Medium", 3: "Low", 4: "Low"}


SCORES = ("hex_id string, dominant_station string, tier string, score_severity double, "
          "score_junction double, score_busy_hour double, score_persistence double, "
          "congestion_impact_score double")


def scored(spark):
    rows = []
    for i in range(40):
        s = [((i * 7) % 40 + 1) / 40, ((i * 11) % 40 + 1) / 40, ((i * 13) % 40 + 1) / 40,
             ((i * 17) % 40 + 1) / 40]
        cis = (0.40 * s[0] + 0.20 * s[1] + 0.20 * s[2] + 0.20 * s[3]) * 100
        rows.append((f"h{i:02d}", f"PS-{i % 4}", "Low", *s, cis))
    return spark.createDataFrame(rows, SCORES)


def test_whatif_defaults_change_nothing(spark):
    r = whatif_ranks(scored(spark))
    assert r.filter(F.col("rank_change") != 0).count() == 0
    assert r.filter(F.col("whatif_cis") != F.col("congestion_impact_score")).count() == 0


def test_whatif_single_weight(spark):
    r = whatif_ranks(scored(spark), 0, 100, 0, 0).collect()
    for x in r:
        assert x.whatif_cis == pytest.approx(100 * x.score_junction)
    top = whatif_top(whatif_ranks(scored(spark), 0, 100, 0, 0), 25).collect()
    assert len(top) == 25 and sorted(t.new_rank for t in top) == list(range(1, 26))
    movers = whatif_movers(whatif_ranks(scored(spark), 0, 100, 0, 0)).collect()
    assert len(movers) <= 6 and all(abs(m.rank_change) > 5 for m in movers)
    assert [m.new_rank for m in movers] == sorted(m.new_rank for m in movers)


def test_whatif_all_zero_is_rejected(spark):
    with pytest.raises(ValueError):
        whatif_ranks(scored(spark), 0, 0, 0, 0)


def drawn_cells(spark, n, seed=3):
    import random

    rng = random.Random(seed)
    rows = [(f"c{i:04d}", rng.gauss(100 * (i % 5), 30.0), rng.random() * (i % 3), rng.random(), None if i % 11 == 0 else rng.random() ** 3,
             rng.gauss(0, 1) * 10 ** rng.randrange(-3, 4), rng.random() * 100) for i in range(n)]
    return spark.createDataFrame(rows, COLS)


def test_tiers_do_not_follow_the_layout(spark):
    cells_ = drawn_cells(spark, 400)
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in (1, 4, 50):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            laid = cells_.repartition(parts, F.rand(parts))
            found.append(sorted((r.hex_id, r.cluster, r.tier) for r in tier_hotspots(laid, n_init=4).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert found[0] == found[1] == found[2] and len(found[0]) == 400


def test_fit_against_lloyd_by_hand(spark):
    """The same draws and centres, iterated row by row with exact sums."""
    import hashlib
    import math

    from curbscope.operators import kmeans

    names = ["a", "b"]
    rows = [(f"r{i}", float((i * 37) % 50), float((i * 17) % 23) if i % 7 else None) for i in range(60)] + [("s", 0.0, 0.0), ("t", 0.0, 0.0)]
    got = kmeans.fit(spark.createDataFrame(rows, "id string, a double, b double"), "id", names, k=3, restarts=4, seed=5)
    unit = lambda v: round(v * kmeans.SCALE)
    raw = {r[0]: [unit(v or 0.0) for v in r[1:]] for r in rows}
    n, z = len(raw), {i: [] for i in raw}
    for d in range(2):
        s, s2 = sum(v[d] for v in raw.values()), sum(v[d] ** 2 for v in raw.values())
        mean, dev = s / n, math.sqrt(n * s2 - s * s) / n
        for i, v in raw.items():
            z[i].append(unit((v[d] - mean) / dev))
    gap = lambda v, c: sum((x - y) * (x - y) for x, y in zip(v, c))
    fits = []
    for run in range(4):
        draw = lambda i, step: (int(hashlib.md5(f"{i}:{run + 5}:{step}".encode()).hexdigest()[:13], 16) + 1) / 2 ** 52  # noqa: B023, E731
        centres = [list(map(float, z[min(z, key=lambda i: (draw(i, 0), i))]))]
        for step in (1, 2):
            near = {i: min(gap(v, c) for c in centres) for i, v in z.items()}
            key = lambda i: (-math.log(draw(i, step)) / near[i] if near[i] else math.inf, i)  # noqa: B023, E731
            centres.append(list(map(float, z[min(z, key=key)])))
        while True:
            own = {i: min(range(3), key=lambda c: (gap(v, centres[c]), c)) for i, v in z.items()}
            new = [[sum(z[i][d] for i in own if own[i] == c) / sum(own[i] == c for i in own) for d in range(2)] for c in range(3)]
            if sum(gap(a, b) for a, b in zip(new, centres)) <= 1e-4 * kmeans.SCALE ** 2:
                break
            centres = new
        fits.append((sum(round(gap(z[i], centres[own[i]]) / kmeans.COST_UNIT) for i in own), run, own, centres))
    best = min(fits, key=lambda f: f[:2])
    assert (got.cost, got.restart, got.centres) == (best[0], best[1], best[3])
    assert {r.id: r.cluster for r in got.assigned.collect()} == best[2]


def test_fit_of_equal_rows_and_of_few_rows(spark):
    from curbscope.operators import kmeans

    same = spark.createDataFrame([(str(i), 1.0) for i in range(5)], "id string, a double")
    assert {r.cluster for r in kmeans.fit(same, "id", ["a"], k=3, restarts=2).assigned.collect()} == {0}
    assert kmeans.fit(same.limit(1), "id", ["a"], k=3) is None and kmeans.fit(same.limit(0), "id", ["a"], k=3) is None


def test_an_iteration_is_one_aggregation_of_all_restarts(spark):
    from curbscope.operators import kmeans

    rows = drawn_cells(spark, 300)
    spark.sparkContext.setJobGroup("kmeans", "count jobs")
    found = kmeans.fit(rows, "hex_id", ["junction_fraction", "growth_rate"], k=4, restarts=10)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("kmeans")
    spark.sparkContext.setJobGroup("", "")
    # A pass is at most two jobs (shuffle stages of one adaptive plan).
    assert found.iterations > 2 and len(jobs) <= 2 * (1 + 4 + found.iterations) + 4


def test_invariants_of_right_and_wrong_tiers(spark):
    from curbscope.operators.tier import tier_hotspots, tier_invariants
    from curbscope.schema import TIER_FEATURES

    rows = [(f"h{i}", float(25 * (i % 4) + i % 3), *[float((i % 4) * 10 + (i * j) % 2) for j in range(len(TIER_FEATURES))]) for i in range(40)]
    df = spark.createDataFrame(rows, "hex_id string, congestion_impact_score double, " + ", ".join(f"{c} double" for c in TIER_FEATURES))
    good = tier_hotspots(df, n_init=3)
    assert tuple(tier_invariants(good).first()) == (40, 40, True, True, True)
    moved = good.withColumn("cluster", F.when(F.col("hex_id") == "h0", (F.col("cluster") + 1) % 4).otherwise(F.col("cluster")))
    assert not tier_invariants(moved.withColumn("tier", F.col("cluster").cast("string")).withColumn("tier", F.lit("Low"))).first().nearest
    one = tier_hotspots(df.limit(1))
    assert tuple(tier_invariants(one).first()) == (1, 1, True, True, True)


def test_first_rows_by_counting_equal_the_full_ranking(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from curbscope.operators.score import whatif_first
    from tests.test_plans import plan_of

    cells_ = scored(spark)
    cells_ = cells_.unionByName(cells_.withColumn("hex_id", F.concat(F.lit("z"), "hex_id")))   # ties in every score
    few = cells_.where("hex_id < 'h09'")
    for rows_, top, weights in ((cells_, 25, (40, 20, 20, 20)), (cells_, 10, (0, 100, 0, 0)), (few, 25, (10, 40, 30, 20))):
        ranked = whatif_top(whatif_ranks(rows_, *weights), top)
        found = whatif_first(rows_, *weights, top=top)
        assert found.columns == ranked.columns
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ranked.collect()))
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: pytest.fail("a rank was checkpointed"))
    plan = plan_of(whatif_first(cells_, 10, 40, 30, 20))
    assert "rangepartitioning" not in plan and "Subquery" in plan
    assert whatif_first(cells_.limit(0), 10, 40, 30, 20).count() == 0
