"""Cache of built hotspot tables that notices new, changed and deleted files.

A source folder is cached by (application, path, format, resolution). What
is kept is the rollup of every file (rows carry their file and its version,
written to the shared folder) and a manifest: each file's size and time of
change. A request lists the folder: files that the manifest does not know in
this version are read, cleaned and rolled up, all other files are not opened.
The rollup of the folder is the sum over its present files, and the build of
(path, format, resolution, k) on top of it is remade only if the manifest
changed. Without a change the same build is returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbscope.operators.clean import add_hex_id, clean_violations
from curbscope.operators.rollup import cell_rollup, merged
from curbscope.plans.build import HotspotBuild, build_from_rollup
from curbscope.plans.tables import bucketed
from curbscope.session import ensure_checkpoint_dir
from curbscope.sources.violations import read_violations

VERSION = ["file", "version"]


@dataclass
class Source:
    """What is kept of one folder."""

    known: dict[str, str] = field(default_factory=dict)    # file -> version
    parts: DataFrame | None = None       # rollup rows by file and version
    rollup: DataFrame | None = None      # their sum over the known files
    builds: dict[int, HotspotBuild] = field(default_factory=dict)
    last_read: list[str] = field(default_factory=list)     # files opened by the last request
    pieces: int = 0                      # requests that added to ``parts``


#: After so many additions the rollup rows are written as one table again,
#: without those of files that are gone.
COMPACT = 16

_SOURCES: dict[tuple, Source] = {}


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """File -> version (time of change and size) of a folder, from the
    listing alone."""
    files = spark.read.format("binaryFile").load(path).select(
        "path", F.concat_ws("-", F.unix_micros("modificationTime"), "length").alias("version"))
    return {r.path: r.version for r in files.collect()}


def _rolled(spark: SparkSession, files: list[str], fmt: str, resolution: int) -> DataFrame:
    """Rollup rows of some files, by file."""
    raw = read_violations(spark, files, fmt=fmt, file_col="file")
    hexed = add_hex_id(clean_violations(raw, keep=["file"]), resolution)
    return cell_rollup(hexed, more=["file"])


def source(spark: SparkSession, path: str, fmt: str = "csv", resolution: int = 9) -> Source:
    """The folder's entry, brought up to date: ``last_read`` are the files
    that had to be opened."""
    own = _SOURCES.setdefault((spark.sparkContext.applicationId, path, fmt, int(resolution)), Source())
    now = manifest(spark, path)
    fresh = sorted(f for f, v in now.items() if own.known.get(f) != v)
    own.last_read = fresh
    if now == own.known:
        return own
    ensure_checkpoint_dir(spark)
    if fresh:
        versions = spark.createDataFrame([(f, now[f]) for f in fresh], "file string, version string")
        rows = _rolled(spark, fresh, fmt, resolution).join(versions, "file").checkpoint(eager=True)
        own.parts, own.pieces = rows if own.parts is None else own.parts.unionByName(rows), own.pieces + 1
    if own.parts is not None:
        kept = own.parts.join(spark.createDataFrame(sorted(now.items()), "file string, version string"), VERSION, "left_semi")
        if own.pieces > COMPACT:
            own.parts = kept = kept.checkpoint(eager=True)
            own.pieces = 1
        own.rollup = bucketed(merged(kept), "hex_id")
    for built in own.builds.values():
        built.hotspots.unpersist()
    own.known, own.builds = now, {}
    return own


def cached_build(spark: SparkSession, path: str, fmt: str = "csv", resolution: int = 9,
                 k_tiers: int = 4) -> HotspotBuild:
    own = source(spark, path, fmt, resolution)
    if own.rollup is None:
        raise FileNotFoundError(f"{path} holds no files")
    if int(k_tiers) not in own.builds:
        built = build_from_rollup(own.rollup, k_tiers=k_tiers)
        built.hotspots = built.hotspots.persist()
        own.builds[int(k_tiers)] = built
    return own.builds[int(k_tiers)]


def clear() -> None:
    for own in _SOURCES.values():
        for built in own.builds.values():
            built.hotspots.unpersist()
    _SOURCES.clear()
