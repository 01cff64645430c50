"""curbscope: parking-enforcement hotspot analytics as Spark DataFrame jobs.

Every operator is a pure function ``f(df, ...) -> DataFrame`` built from
``pyspark.sql.functions`` expressions, aggregations, joins and windows, so
Catalyst plans it and the same code runs on ``local[*]`` or a cluster.

Sub-packages:

* ``sources``   -- record scans (CSV / Parquet / derived from the driver
  ``events`` table) and sinks.
* ``functions`` -- column-expression builders (tag parsing, severity, time
  parts, hexagonal binning, rounding, action text).
* ``operators`` -- table operators (cleaning, the per-cell rollup, busy
  hours, features, trends, ranks, scores, tiers, impact, patrol, views).
* ``plans``     -- the end-to-end hotspot build and the registered queries.
* ``streaming`` -- incremental ingest of new record files into the cell
  rollup with Structured Streaming.
"""

from curbscope.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
