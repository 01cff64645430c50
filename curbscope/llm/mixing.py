"""Mixing sources to target weights: Pareto order sampling, in DataFrame
expressions only.

Every source has a target number of words. A document first gets its whole
copies for certain; the rest of the target is drawn from fractional parts.
A document with fractional part p gets the rank (u / (1 - u)) / (p / (1 - p))
with u uniform in (0, 1) from a hash of the document: random odds divided by
inclusion odds. Documents of a source are taken in that order until their
words come closest to the rest of the target, so the sample's size is fixed
in words.

The cut of each source is found from sums per source and rank bucket, then
inside the one bucket that the cut falls into. No source is sorted as a whole
and no text is shuffled: the decision on a row only needs its source's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import col

#: Weights of the sources by code point of their names, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: Rank buckets of a source.
BUCKETS = 4096
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009..U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a hash of the seed, doc_id and text."""
    joined = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    bits = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS,
            max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The weights' shares of all words, where a target stops at ``max_copies``
    times its source's size and the excess is shared by weight among the
    others until none is above. Solved in one pass: sources by size / weight;
    a source is full if the level that the remaining ones would reach
    without it is above its own. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("reach", F.col("left") / F.sum("w").over(after))
    s = s.withColumn("full", F.col("reach") * F.col("w") > F.col("cap"))
    s = s.withColumn("common", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "reach").alias("x"))).over(everything)["reach"])
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("common") * F.col("w"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
                max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies): one row per row of
    ``docs``, ``row`` a struct of all its columns, ``copies`` the times that
    the mix holds it (0 to ``max_copies``).

    Null texts have size 0; documents of size 0 count like others in the
    draw. Rows without a source are a source of their own, the last. Rows
    that repeat doc_id and text have the same rank and are taken together.
    A source without words has target 0 and no copies. An empty table gives
    an empty result. The same rows give the same copies on every run, in any
    layout.
    """
    text = col(text_col).cast("string")
    base = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"),
        col(id_col).cast("long").alias("doc_id"), col(source_col).cast("string").alias("source"),
        n_words(text).alias("size"), uniform(col(id_col), text, seed).alias("u"),
    )
    drawn = common.held(base.select("source", "size", "u"))
    goal = targets(drawn.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = (
        goal.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    goal = common.held(goal)

    def ranked(rows: DataFrame) -> DataFrame:
        odds = F.col("u") / (F.lit(1.0) - F.col("u"))
        q = F.when(F.col("p") > 0, odds / (F.col("p") / (F.lit(1.0) - F.col("p"))))
        # The sources' table is counted and goes to the rows, whose texts stay
        # where they are; only beyond ``common.SMALL_ROWS`` sources rows move.
        own = goal.withColumnRenamed("source", "_source")
        own = F.broadcast(own) if goal.count() <= common.SMALL_ROWS else own
        joined = rows.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return joined.withColumn("q", q)

    bucket = F.floor(F.col("q") / (F.col("q") + 1) * BUCKETS)
    parts = ranked(drawn).where("q is not null").withColumn("bucket", bucket)
    sums = parts.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sums.withColumn("upto", F.sum("words").over(run))
    # The bucket in which the running sum passes the rest; if none does, the last.
    cut = upto.groupBy("source").agg(
        F.coalesce(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("below")))),
            F.max(F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"))),
        ).alias("c")
    ).select(F.col("source").alias("_s"), F.col("c.bucket").alias("_b"), F.col("c.below").alias("below"))
    inside = (
        parts.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        .groupBy("source", "rest", "below", "q").agg(F.sum("size").alias("words"))
    )
    run = Window.partitionBy("source").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("below") + F.sum("words").over(run))
    nearer = (F.col("upto") <= F.col("rest")) | (
        F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("words"))
    )
    last = inside.groupBy("source").agg(F.max(F.when(nearer, F.col("q"))).alias("last"), F.min("q").alias("q0"))
    # No rank inside the bucket is near enough: all ranks below the bucket's first.
    last = last.select(F.col("source").alias("_s"), "last", "q0")
    goal = goal.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    goal = common.held(goal)
    taken = (F.col("q") <= F.col("last")) | (F.col("last").isNull() & (F.col("q") < F.col("q0")))
    copies = F.col("whole") + F.coalesce(taken.cast("long"), F.lit(0))
    return ranked(base).select("row", "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken
    (words that the mix takes of it, repeats counted)."""
    rows = with_copies(docs, **options)
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken."""
    rows = with_copies(docs, **options).where("copies > 0")
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: The same plan in DuckDB SQL, for the default options.
SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w,
         (source_size * 3)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s
), r AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
           / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM w
), t AS (
  SELECT source, source_size,
         coalesce(CASE WHEN reach * w > cap THEN cap
              ELSE w * first(reach ORDER BY reach * w > cap, cap / w, reach) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END, 0.0::DOUBLE) AS target
  FROM r
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0.0 END AS whole,
         CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0.0 END AS p FROM t
), q AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
         CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS q
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT source, rest, q, words, sum(words) OVER (PARTITION BY source ORDER BY q) AS upto
  FROM (SELECT source, rest, q, sum(size) AS words FROM q WHERE q IS NOT NULL GROUP BY ALL)
), l AS (
  SELECT source, max(q) AS last FROM c WHERE upto <= rest OR upto - rest < rest - (upto - words) GROUP BY source
)
SELECT doc_id, size, source_size, target,
       ((whole::BIGINT + CASE WHEN q.q <= l.last THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM q LEFT JOIN l ON q.source IS NOT DISTINCT FROM l.source
"""
