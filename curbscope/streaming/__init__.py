"""Incremental ingest with Structured Streaming.

The reference has no streaming operators. What this package adds is an
ingestion mode for the same batch operators: new record files are cleaned,
binned and rolled up per micro-batch (``foreachBatch``), and because the
cell rollup is additive (counts and sums), partial rollups of any number of
batches combine by one more ``groupBy(...).sum``. Building the hotspot
table from the combined rollup never rescans history.
"""

from curbscope.streaming.ingest import combined_rollup, start_rollup_stream

__all__ = ["start_rollup_stream", "combined_rollup"]
