"""SimHash near-dedup: pigeonhole blocks.

Fingerprints of whole texts are split into blocks. Two fingerprints that
differ in at most ``max_bits`` bits agree on at least (blocks - max_bits)
whole blocks, so every such pair shares at least one *combination* of that
many blocks. Fingerprints are joined on those combinations and every pair
that meets is checked by its Hamming distance: no link is lost and none is
wrong, whichever number of blocks is used. Inside a key the same rule is
applied once more to the bits outside it, so large keys need few checks.

Equal fingerprints are one class before anything is joined, so groups of
copies never meet in pairs; a block shared by very many different
fingerprints is compared in tiles of bounded size on many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import col

BITS = 64
SEED = 42
TILE = 8192


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> int:
    """64-bit SimHash of the ``shingle``-word shingles of a text.

    A-Z are lower-cased, words are runs of characters other than space and
    U+0009..U+000D; fewer words than ``shingle`` make one shingle; no word
    (or null): 0. Bit i is set if it is set in over half of the shingles'
    XXH64 values (repeats included).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate(([0], ends[: n - 1])).tolist()
    last = (ends[-n:] - 1).tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        part = slice(at, at + (1 << 14))
        h = np.fromiter(
            (digest(joined[a:b], seed) for a, b in zip(first[part], last[part])), dtype=np.uint64
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def signed(fp: int) -> int:
    return fp - (1 << 64) if fp >= 1 << 63 else fp


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's 64 bits as a signed
    long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            fps = [signed(fingerprint(t, shingle, seed)) for t in b.column(2).to_pylist()]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(fps, pa.int64())],
                names=["doc_id", "text_hash", "fp"],
            )

    text = col(text_col).cast("string")
    chosen = docs.select(
        col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )
    return chosen.mapInArrow(run, "doc_id long, text_hash long, fp long")


def block_masks(n: int, max_bits: int, per_key: int = 4096) -> list[int]:
    """Bit masks whose values are the join keys: each combination of blocks.

    The number of blocks is the smallest at which ``n`` evenly spread
    fingerprints have at most ``per_key`` to a key. It changes the work, not
    the links: with any number of blocks over ``max_bits`` all are found.
    """
    blocks = max_bits + 1
    while n > per_key * 2 ** ((blocks - max_bits) * (BITS // blocks)) and blocks < max_bits + 5:
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - max_bits)]


def keyed(fps: DataFrame, masks: list[int], fp: str = "fp") -> DataFrame:
    """A row for each mask: (..., table, key)."""
    rows = [
        F.struct(F.lit(t).alias("table"), F.col(fp).bitwiseAND(F.lit(signed(m))).alias("key"))
        for t, m in enumerate(masks)
    ]
    return fps.withColumn("_k", F.explode(F.array(*rows))).select("*", "_k.table", "_k.key").drop("_k")


KEYS = ["table", "key", "_lo", "_hi"]
#: Rows that are compared in one go, about, and a factor that mixes bits.
ROWS = 1 << 17
ODD = np.uint64(0x9E3779B97F4A7C15)


def inner_masks(masks: list[int], max_bits: int) -> np.ndarray:
    """For each table the bits outside its key, cut into max_bits + 1 parts:
    a close pair of the table agrees on one of them, too."""
    out = []
    for m in masks:
        rest = [b for b in range(BITS) if not m >> b & 1]
        cuts = [len(rest) * i // (max_bits + 1) for i in range(max_bits + 2)]
        out.append([sum(1 << b for b in rest[x:y]) for x, y in zip(cuts, cuts[1:])])
    return np.array(out, dtype=np.uint64)


def close_pairs(table: pa.Table, fp: np.ndarray, max_bits: int, inner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs within ``max_bits`` in the groups of
    ``table``, a bounded number at a time; a pair can come several times.
    Only rows of a group that agree on one more part are compared."""
    n = table.num_rows
    starts = common.starts_of(table, KEYS)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    number, side = table.column("table").to_numpy(), table.column("_side").to_numpy()
    across = table.column("_lo").to_numpy() < table.column("_hi").to_numpy()
    for part in range(max_bits + 1):
        value = fp & inner[number, part]
        with np.errstate(over="ignore"):
            mixed = (value ^ (group.astype(np.uint64) * ODD)) * ODD
        order = np.argsort(mixed)
        v = mixed[order]
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
        k, step = np.arange(n), 0
        while True:
            step += 1
            k = k[k + step < end[k]]
            if not len(k):
                break
            i, j = order[k], order[k + step]
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            ok &= (group[i] == group[j]) & (~across[i] | (side[i] != side[j]))
            if ok.any():
                yield i[ok], j[ok]


def hamming_edges(fps: DataFrame, n: int, max_bits: int) -> DataFrame:
    """Edges (a, b) among ``n`` distinct ``fp`` that connect exactly the
    pairs within ``max_bits`` bits: each tile gives a spanning forest of its
    links, never all its pairs."""

    masks = block_masks(n, max_bits)
    inner = inner_masks(masks, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.whole_groups(batches, KEYS, ROWS):
            own = table.column("fp").to_numpy()
            fp, parent = own.view(np.uint64), np.arange(table.num_rows)
            for i, j in close_pairs(table, fp, max_bits, inner):
                parent = common.union(parent, i, j)
            linked = np.flatnonzero(parent != np.arange(len(parent)))
            if len(linked):
                yield pa.record_batch(
                    [pa.array(own[linked]), pa.array(own[parent[linked]])], names=["a", "b"]
                )

    dealt = common.hot_tiles(keyed(fps.select("fp"), masks), ["table", "key"], "fp", TILE)
    return common.sorted_groups(dealt, KEYS).mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, seed: int) -> DataFrame:
    """(doc_id, text_hash, fp, first): first is the smallest (no doc_id,
    doc_id, text_hash) of the row's component."""
    fps = common.held(fingerprints(docs, id_col, text_col, shingle, seed))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = common.held(fps.groupBy("fp").agg(F.min(row).alias("smallest")))
    edges = hamming_edges(classes, classes.count(), max_bits)
    linked = common.connected_components(edges)
    rooted = classes.join(linked, classes.fp == linked.id, "left").select(
        "fp", "smallest", F.coalesce("component", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("first"))
    return fps.join(rooted.join(smallest, "root").select("fp", "first"), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 4, max_bits: int = 4, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex
    digits), component_id (smallest doc_id reachable by links of at most
    ``max_bits`` differing bits, itself included).

    Null, empty and blank texts have fingerprint zero, which links like any
    other. A row without doc_id keeps its row; a component in which no row
    has a doc_id gets a null component_id. Repeated rows give repeated rows.
    Other columns of ``docs``, whatever their names, are not read. An empty
    table gives an empty result.
    """
    return _grouped(docs, id_col, text_col, shingle, max_bits, seed).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = 4, max_bits: int = 4, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, of which one per group stays: that
    of the smallest doc_id (rows without one last, then by a hash of the
    text). Rows that repeat both doc_id and text are one document, of which
    one row stays. Columns keep their names and order."""
    groups = _grouped(docs, id_col, text_col, shingle, max_bits, seed)
    first = groups.select("first").distinct().select(
        F.coalesce("first.doc_id", F.lit(0)).alias("_a"), F.col("first.no_id").alias("_b"),
        F.col("first.text_hash").alias("_c"))
    own = docs.select(
        F.coalesce(col(id_col).cast("long"), F.lit(0)).alias("_a"),
        col(id_col).cast("long").isNull().alias("_b"),
        F.xxhash64(col(text_col).cast("string")).alias("_c"),
        F.struct(*[col(x) for x in docs.columns]).alias("_row"),
    )
    kept = own.join(first, ["_a", "_b", "_c"]).dropDuplicates(["_a", "_b", "_c"])
    return kept.select("_row.*")
