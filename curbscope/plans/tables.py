"""Written tables that keep their partitioning.

A checkpoint forgets how its rows were dealt out, so every later aggregate
or join by the same key shuffles them again. A bucketed table keeps it:
rows are written once by the hash of the key, and scans of it join and
aggregate by that key without an exchange. Like checkpoints, the files lie
in the shared folder, so a lost executor never sends a job back behind them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from curbscope.session import ensure_checkpoint_dir


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` written in ``buckets`` files (the session's shuffle partitions
    by default) by the hash of ``key``, and read back with that partitioning.

    The table is known to the catalog only while it is read in; its files
    stay in the checkpoint folder.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"curbscope_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bucketed-{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")   # an external table: its files stay
    return out
