"""Scans of raw violation records (CSV or Parquet) and the row-limit scan.

The CSV reader uses an explicit schema (no inference pass over the data),
checks the header for the 10 required columns and fails clearly when one is
missing, projects exactly those columns (so Parquet scans prune the rest)
and maps the usual missing-value spellings of text columns to NULL.
Unparseable numbers become NULL (PERMISSIVE mode) and are dropped later by
the null filter.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbscope.functions.text import normalize_missing
from curbscope.schema import RAW_COLUMNS, RAW_SCHEMA, TEXT_NULL_COLUMNS


class MissingColumnsError(ValueError):
    pass


def _check_columns(present: list[str], path: str) -> None:
    missing = [c for c in RAW_COLUMNS if c not in present]
    if missing:
        raise MissingColumnsError(f"{path}: missing required columns {missing}")


def _project(df: DataFrame, more: list[Column] = ()) -> DataFrame:
    cols = list(more)
    for field in RAW_SCHEMA.fields:
        c = F.col(field.name).cast(field.dataType)
        if field.name in TEXT_NULL_COLUMNS:
            c = normalize_missing(c)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def _files(df: DataFrame) -> list[str]:
    """Files of a scan in the order of their paths."""
    return sorted(unquote(f) for f in df.inputFiles())


def _same(path: str) -> str:
    """One spelling of a file's path: listings write file:/// where a scan's
    metadata write file:/."""
    return re.sub("^([^:/]+):/+", r"\1:/", unquote(path))


def headers(spark: SparkSession, paths: list[str]) -> dict[tuple, list[str]]:
    """The different headers of the CSV files of some paths, each with its
    files in order.

    One query, however many files there are: the files are read as text, of
    the lines of first blocks the first of each file is taken, and files are
    grouped by it. (Spark prunes no blocks by this condition, so the text
    passes the scan once, unparsed; ``same_header`` reads spare it.) A file
    without a line has no header and is left out.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), "value").where("start = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "place").alias("line"))
    found = first.groupBy("line").agg(F.collect_list("file").alias("files")).collect()
    out: dict[tuple, list[str]] = {}
    for r in found:
        header = tuple(next(csv.reader([r.line.removeprefix("\ufeff").rstrip("\r")]), ()))
        out.setdefault(header, []).extend(unquote(f) for f in r.files)
    return {h: sorted(own) for h, own in sorted(out.items(), key=lambda x: min(x[1]))}


def _one_header(spark: SparkSession, path: str) -> tuple:
    return tuple(spark.read.option("header", True).option("escape", '"').csv(path).columns)


def first_files(scan: Callable[[list[str]], DataFrame], files: list[str], nrows: int) -> list[str]:
    """The first files that hold ``nrows`` rows together (all, if fewer).

    Files are counted in order, one job for 1, 2, 4, ... of them, until there
    are enough, so what is read follows ``nrows`` and not the folder.
    """
    done, rows, step = 0, 0, 1
    while done < len(files):
        some = files[done:done + step]
        counts = {_same(r.file): r["count"] for r in
                  scan(some).groupBy(F.col("_metadata.file_path").alias("file")).count().collect()}
        for f in some:
            done += 1
            rows += counts.get(_same(f), 0)
            if rows >= nrows:
                return files[:done]
        step *= 2
    return files


def header_schema(header: list[str]) -> T.StructType:
    """Typed schema over every column of a header, by name."""
    typed = {f.name: f.dataType for f in RAW_SCHEMA.fields}
    return T.StructType([T.StructField(c, typed.get(c, T.StringType())) for c in header])


def read_violations_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False,
                        nrows: int | None = None, same_header: bool = False,
                        file_col: str | None = None) -> DataFrame:
    """Read header CSV files (a path or some) holding (at least) the 10 raw
    columns; ``file_col`` names a first column for each row's file.

    Columns are bound by name in every file: one job reads the headers, and
    files of one header are one typed scan (no type inference pass, extra
    columns are pruned). ``same_header=True`` reads one header only and saves
    that job; a file with another header is then an error, never a wrong
    binding. ``multi_line=True`` is only needed when quoted
    fields contain line breaks; it stops Spark from splitting a large file
    across tasks, so it is off by default. ``nrows`` keeps the first rows in
    file order and reads only the first files, as many as hold them.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = _files(spark.read.schema("x string").csv(paths))
    some = files
    if nrows is not None:
        plain = (spark.read.schema("x string").option("header", True).option("multiLine", bool(multi_line))
                 .option("escape", '"'))
        some = first_files(lambda own: plain.csv(own), files, nrows)
    if same_header or len(files) <= 1:
        groups = {_one_header(spark, some[0] if some else path): some if len(some) < len(files) else paths}
    else:
        groups = headers(spark, some if len(some) < len(files) else paths)
        if len(groups) == 1 and len(some) == len(files):
            groups = dict.fromkeys(groups, paths)
    if not groups:
        _check_columns([], str(path))
    for header, own in groups.items():
        _check_columns(list(header), own[0])
    scans = [
        (spark.read.schema(header_schema(list(header)))
         .option("header", True)
         .option("enforceSchema", False)
         .option("mode", "PERMISSIVE")
         .option("multiLine", bool(multi_line))
         .option("escape", '"')
         .csv(own))
        for header, own in groups.items()
    ]
    return _scan(scans, nrows, file_col)


def read_violations_parquet(spark: SparkSession, path: str | list[str], nrows: int | None = None,
                            file_col: str | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    _check_columns(df.columns, str(path))
    if nrows is not None and isinstance(path, str):
        files = _files(df)
        inside = spark.read.schema(df.schema).option("basePath", path)
        some = first_files(lambda own: inside.parquet(*own), files, nrows) if len(files) > 1 else files
        df = inside.parquet(*some) if len(some) < len(files) else df
    return _scan([df], nrows, file_col)


def _scan(scans: list[DataFrame], nrows: int | None, file_col: str | None = None) -> DataFrame:
    place = [] if nrows is None else _place()
    if file_col:
        place = [F.col("_metadata.file_path").alias(file_col), *place]
    parts = [_project(df, place) for df in scans]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out if nrows is None else first_rows(out, nrows, [file_col] if file_col else [])


def _place() -> list[Column]:
    """Where a scanned row stands: its file, the split's start in it and a
    number that rises within the split."""
    return [F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_mid")]


def first_rows(placed: DataFrame, nrows: int, more: list[str] = ()) -> DataFrame:
    """First ``nrows`` rows in file order (files by path, rows as they stand
    in them) of a scan with the ``_place`` columns. Splits are counted, a
    running sum over the splits (one row each) gives where each one starts,
    and rows are kept by their number: no sort and no single-task limit."""
    splits = placed.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = splits.filter(F.col("_before") < nrows).drop("_n")
    number = F.col("_before") + F.col("_mid") - F.col("_first")
    return (placed.join(wanted, ["_file", "_start"]).filter(number < nrows)
            .select(*more, *RAW_COLUMNS))


def read_violations(spark: SparkSession, path: str | list[str], fmt: str = "csv",
                    nrows: int | None = None, order_by=None, file_col: str | None = None) -> DataFrame:
    """Scan raw records of a path or of some; ``nrows`` keeps the first *n* raw rows before any
    cleaning, in file order, or by ``order_by`` if it is given."""
    in_order = nrows if order_by is None else None
    if fmt == "csv":
        df = read_violations_csv(spark, path, nrows=in_order, file_col=file_col)
    else:
        df = read_violations_parquet(spark, path, nrows=in_order, file_col=file_col)
    return df if order_by is None else limit_rows(df, nrows, order_by)


def limit_rows(df: DataFrame, nrows: int | None, order_by) -> DataFrame:
    """First ``nrows`` rows by ``order_by`` (a column name or Column)."""
    return df if nrows is None else df.orderBy(order_by).limit(int(nrows))
