"""Budgeted patrol: closed form equals the greedy row scan."""

import random

import pytest
from pyspark.sql import functions as F

from curbscope.operators.patrol import patrol_by_station, patrol_schedule, patrol_summary

SCHEMA = ("hex_id string, dominant_station string, tier string, "
          "congestion_impact_score double, capacity_loss_pct double, daily_delay_cost_inr long")


def greedy(cells, budget):
    """Direct scan: by CIS desc (ties hex_id), Critical costs 2, others 1."""
    ranked = sorted(cells, key=lambda c: (-c[3], c[0]))
    out, remaining = [], budget
    for c in ranked:
        if remaining <= 0:
            break
        cost = 2 if c[2] == "Critical" else 1
        if remaining >= cost:
            out.append(c[0])
            remaining -= cost
    return out


def cell(h, tier, cis, st="PS-1"):
    return (h, st, tier, float(cis), 10.0, 100)


CASES = {
    "budget0": ([cell("a", "High", 90)], 0),
    "budget1_critical_first": ([cell("a", "Critical", 90), cell("b", "Low", 80)], 1),
    "odd_budget": ([cell(c, "Critical", 90 - i) for i, c in enumerate("abcd")], 5),
    "one_left_critical_next": ([cell("a", "Critical", 90), cell("b", "High", 85),
                                cell("c", "Critical", 80), cell("d", "Critical", 70),
                                cell("e", "Low", 60), cell("f", "Low", 50)], 4),
    "all_critical": ([cell(c, "Critical", 50) for c in "abc"], 4),
    "budget_gt_pool": ([cell("a", "High", 10), cell("b", "Critical", 20)], 40),
    "equal_cis": ([cell(c, "Medium", 42.0) for c in "edcba"], 3),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_patrol_cases(spark, name):
    cells, budget = CASES[name]
    df = spark.createDataFrame(cells, SCHEMA)
    sched = patrol_schedule(df, n_officers=1, shift_hours=budget).orderBy("priority").collect()
    assert [r.hex_id for r in sched] == greedy(cells, budget)
    assert [r.priority for r in sched] == list(range(1, len(sched) + 1))
    assert sum(r.hours for r in sched) <= budget


@pytest.mark.parametrize("budget", [1, 2, 5, 8, 13])
def test_random_pools_by_station(spark, budget):
    rnd = random.Random(budget)
    cells, expected = [], {}
    for case in range(60):
        st = f"S{case:03d}"
        pool = [(f"{st}-{i}", st, rnd.choice(["Critical", "High", "Medium", "Low"]),
                 float(rnd.randint(0, 6)), 1.0, 1) for i in range(rnd.randint(0, 14))]
        cells += pool
        expected[st] = greedy(pool, budget)
    df = spark.createDataFrame(cells, SCHEMA)
    got = {}
    for r in patrol_by_station(df, 1, budget).orderBy("station", "priority").collect():
        got.setdefault(r.station, []).append(r.hex_id)
    assert got == {k: v for k, v in expected.items() if v}


def test_summary(spark):
    cells = [cell("a", "Critical", 90), cell("b", "High", 50), cell("c", "Low", 10)]
    df = spark.createDataFrame(cells, SCHEMA)
    s = patrol_summary(patrol_schedule(df, 1, 3), df, 1, 3).first()
    assert s.assigned == 2 and s.total_cis == 140.0 and s.daily_cost_prevented == 200
    assert s.random_cis == pytest.approx(50.0 * 3)
    assert s.pct_better == pytest.approx((140 - 150) / 150 * 100)


def test_pool_follows_station_filter(spark):
    cells = [cell("a", "Critical", 90, "PS-1"), cell("b", "Low", 80, "PS-1"),
             cell("c", "High", 70, "PS-2"), cell("d", "Medium", 60, "PS-1")]
    df = spark.createDataFrame(cells, SCHEMA)
    # no station filter: every cell, the tier filter does not apply
    allp = patrol_schedule(df, 1, 10, stations=None, tiers=["Low"]).collect()
    assert sorted(r.hex_id for r in allp) == ["a", "b", "c", "d"]
    # station filter: the filtered view, tier filter included
    view = patrol_schedule(df, 1, 10, stations=["PS-1"], tiers=["Critical", "Medium"]).collect()
    assert sorted(r.hex_id for r in view) == ["a", "d"]
    assert patrol_schedule(df, 1, 10, stations=["PS-1"], tiers=[]).count() == 0
