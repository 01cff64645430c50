"""KMeans whose result does not depend on how the rows are laid out.

All restarts run together: one aggregation per iteration assigns every row
to the nearest centre of every restart still moving and sums up the new
centres (``restarts x k`` rows come back, whatever the input). Only exact
integer sums are used -- features and standardised features are integers in
units of 2**-20 -- so neither the number of partitions nor the order of rows
changes a bit of any centre, and SQL can replay the fit.

Initial centres follow k-means++: the first one is the row with the smallest
hash of (id, restart), each further one the row with the smallest
``-ln(u) / d2``, u its hash in (0, 1] and d2 the squared distance to the
nearest centre so far, which draws rows with odds d2. Hashes are MD5 of
"id:restart:step", so a draw does not depend on the layout either.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features are kept in units of 1 / SCALE.
SCALE = float(1 << 20)

#: Rows of a task, if the input has not more partitions than that gives.
TASK_ROWS = 50_000

#: Distances add up to the cost in whole units.
COST_UNIT = SCALE


@dataclass
class Fit:
    assigned: DataFrame      # (id, cluster int)
    centres: list[list[float]]   # of the best restart, in units of 1 / SCALE
    restart: int
    cost: int
    iterations: int


def units(c: Column) -> Column:
    return F.rint(c * F.lit(SCALE)).cast("long")


def standardised(rows: DataFrame, features: list[str], spread: dict[str, tuple[float, float]]) -> DataFrame:
    """Each feature (in units) less its mean, over its deviation, in units
    again; 0 where all rows are equal."""
    out = {}
    for f in features:
        mean, dev = spread[f]
        z = units((F.col(f).cast("double") - F.lit(mean)) / F.lit(dev)) if dev else F.lit(0).cast("long")
        out[f] = z
    return rows.withColumns(out)


def spreads(rows: DataFrame, features: list[str]) -> tuple[int, dict[str, tuple[float, float]]]:
    """Number of rows, and (mean, population deviation) of integer features
    from exact sums."""
    big = [F.col(f).cast("decimal(19,0)") for f in features]
    row = rows.agg(F.count(F.lit(1)), *[F.sum(b) for b in big], *[F.sum(b * b) for b in big]).first()
    n, m = row[0], len(features)
    out = {}
    for i, f in enumerate(features):
        s, s2 = int(row[1 + i] or 0), int(row[1 + m + i] or 0)
        out[f] = (float(s) / float(n), math.sqrt(float(n * s2 - s * s)) / float(n)) if n else (0.0, 0.0)
    return n, out


# A pass is one SQL text over a view of the rows: one call to the driver's JVM
# instead of one for each of some hundred terms.
def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _draw(row_id: str, seed: int, step: int) -> str:
    """A number in (0, 1] from the row, the restart and the step."""
    text = f"concat_ws(':', cast({_quoted(row_id)} as string), cast(restart + {seed} as string), '{step}')"
    return (f"cast(cast(conv(substring(md5(cast({text} as binary)), 1, 13), 16, 10) as bigint) + 1 as double)"
            f" / {float(1 << 52)!r}D")


def _by_restart(view: str, centres: list[list[list[float]]], restarts: list[int]) -> str:
    """Every row once for each restart: its place (slot) and number. The
    centres of all of them are one array constant (_c)."""
    flat = ",".join(repr(float(x)) for r in restarts for c in centres[r] for x in c)
    places = ", ".join(f"struct({i} as slot, {r} as restart)" for i, r in enumerate(restarts))
    return f"(select *, inline(array({places})), cast(split('{flat}', ',') as array<double>) as _c from {view})"


def _distance(features: list[str], k: int, j: int) -> str:
    """Squared distance of a row to centre ``j`` of its restart's ``k``."""
    m = len(features)
    gaps = [f"(cast({_quoted(f)} as double) - get(_c, slot * {k * m} + {j * m + d}))" for d, f in enumerate(features)]
    return " + ".join(f"{g} * {g}" for g in gaps)


def _least(terms: list[str]) -> str:
    return f"least({', '.join(terms)})" if len(terms) > 1 else terms[0]


def _assigned(view: str, features: list[str], centres, restarts: list[int], k: int) -> str:
    """Rows by restart with the number of the nearest centre, the lowest
    first (cluster), and its squared distance (_least)."""
    names = [f"_d{j}" for j in range(k)]
    gaps = ", ".join(f"{_distance(features, k, j)} as {n}" for j, n in enumerate(names))
    which = " ".join(f"when _least = {n} then {j}" for j, n in enumerate(names))
    return (f"(select *, case {which} else 0 end as cluster from (select *, {_least(names)} as _least from "
            f"(select *, {gaps} from {_by_restart(view, centres, restarts)})))")


def _sums(view: str, features: list[str], centres, restarts: list[int], k: int) -> str:
    """Rows, exact sums and cost of each cluster of each restart."""
    totals = ", ".join(f"sum({_quoted(f)}) as {_quoted(f)}" for f in features)
    return (f"select restart, cluster, count(1) as n, {totals}, sum(cast(rint(_least / {COST_UNIT!r}D) as bigint)) as cost "
            f"from {_assigned(view, features, centres, restarts, k)} group by restart, cluster")


def kmeans_pp(rows: DataFrame, view: str, row_id: str, features: list[str], k: int, restarts: int,
              seed: int) -> list[list[list[float]]]:
    """Initial centres of every restart: one aggregation per centre."""
    centres: list[list[list[float]]] = [[] for _ in range(restarts)]
    columns = ", ".join(map(_quoted, features))
    for step in range(k):
        key, source = _draw(row_id, seed, step), _by_restart(view, centres, list(range(restarts)))
        if step:
            near = _least([f"({_distance(features, step, j)})" for j in range(step)])
            source = f"(select *, {near} as _near from {source})"
            key = f"case when _near > 0 then -ln({key}) / _near else double('inf') end"
        for r in rows.sparkSession.sql(f"select restart, min(struct({key} as _key, {_quoted(row_id)} as _id, {columns})) as best "
                                       f"from {source} group by restart").collect():
            centres[r.restart].append([float(r.best[f]) for f in features])
    return centres


def fit(df: DataFrame, row_id: str, features: list[str], k: int, restarts: int = 10, seed: int = 42,
        max_iter: int = 300, tol: float = 1e-4) -> Fit | None:
    """The restart of least cost (ties: the lowest number); ``None`` for
    fewer than two rows or clusters.

    A restart ends with the first iteration that would move its centres by a
    summed squared distance of at most ``tol`` (of standardised features), or
    with ``max_iter``; it keeps the centres its last cost belongs to.
    ``row_id`` must be unique. Features are standardised; a null counts as 0.
    A cluster that loses all its rows keeps its centre. Rows at equal
    distance go to the lower cluster number.
    """
    spark = df.sparkSession
    raw = df.select(row_id, *[units(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in features]).persist()
    rows, view = None, f"kmeans_{uuid.uuid4().hex}"
    try:
        n, spread = spreads(raw, features)
        k = min(k, n)
        if k < 2:
            return None
        # Few rows in many tasks cost more to start than to read.
        rows = standardised(raw, features, spread).coalesce(-(-n // TASK_ROWS)).persist()
        rows.createTempView(view)
        centres = kmeans_pp(rows, view, row_id, features, k, restarts, seed)
        costs = dict.fromkeys(range(restarts), 0)
        moving, turns = list(range(restarts)), 0
        while moving:
            turns += 1
            found: dict[int, list] = {r: [] for r in moving}
            for x in spark.sql(_sums(view, features, centres, moving, k)).collect():
                found[x.restart].append(x)
            still = []
            for r, sums in found.items():
                costs[r] = sum(x.cost for x in sums)
                new = {x.cluster: [float(x[f]) / float(x.n) for f in features] for x in sums}
                shift = sum((a - b) * (a - b) for c in sorted(new) for a, b in zip(new[c], centres[r][c]))
                if shift > tol * SCALE * SCALE and turns < max_iter:
                    still.append(r)
                    for c, place in new.items():
                        centres[r][c] = place
            moving = still
        best = min(range(restarts), key=lambda r: (costs[r], r))
        assigned = spark.sql(f"select {_quoted(row_id)}, cluster from {_assigned(view, features, centres, [best], k)}")
        return Fit(assigned.checkpoint(eager=True), centres[best], best, costs[best], turns)
    finally:
        if rows is not None:
            spark.catalog.dropTempView(view)
            rows.unpersist()
        raw.unpersist()
