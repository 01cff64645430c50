"""Benchmark decontamination with an FM-index per shard of documents.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower
case. Every ``window`` consecutive words of an item are a phrase (an item of
fewer words, but not none, is one phrase). Each task cuts its documents into
shards of about ``SHARD_BYTES`` of text, builds the shard's FM-index over
words, finds all phrases by backward search, locates their occurrences by
sampled suffix positions and merges the occurrences of each document into
removal spans. Documents are never shuffled.

The phrases are the stated query set. They are brought to the tasks in
blocks of at most about ``BLOCK`` (phrase, item) pairs; with more than one
block the documents are held with a row number, each block is a pass over
them, and the passes' spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, held, stored
from .fm_index import MOST, FMIndex
from .words import by_bytes, word_lists

#: Text of a shard.
SHARD_BYTES = 6 << 20

#: (phrase, item) pairs that are broadcast at a time: about 100 MB.
BLOCK = 1_000_000

PHRASES = "phrase string, item long"


def phrases(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, item): the phrases of each item, their words joined by a
    blank, once for each item id. An item of no words or null text has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SHARD_BYTES):
            words, starts = word_lists(batch.column("text"))
            words, ids = words.to_pylist(), batch.column("item").to_pylist()
            out, owner = [], []
            for i, a, b in zip(ids, starts[:-1].tolist(), starts[1:].tolist()):
                for at in range(a, max(b - window, a) + 1 if b > a else a):
                    out.append(" ".join(words[at: min(at + window, b)]))
                    owner.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(owner, pa.int64())], ["phrase", "item"])

    rows = items.select(col(id_col).cast("long").alias("item"), col(text_col).alias("text"))
    return rows.mapInArrow(cut, PHRASES).distinct()


class Phrases:
    """A block of phrases: numbers of their words, their lengths, their items."""

    def __init__(self, table: pa.Table):
        coded = table.column("phrase").combine_chunks().dictionary_encode()
        texts = coded.dictionary.cast(pa.large_string())
        words, starts = word_lists(texts)
        words = words.dictionary_encode()
        self.words = words.dictionary
        self.lengths = np.diff(starts)
        self.table = np.full((len(texts), int(self.lengths.max(initial=1))), -1, dtype=np.int64)
        inside = np.arange(self.table.shape[1]) < self.lengths[:, None]
        self.table[inside] = words.indices.to_numpy()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        known = table.column("item").combine_chunks().is_valid().to_numpy(zero_copy_only=False)[order]
        item = table.column("item").combine_chunks().fill_null(0).to_numpy()[order]
        self.items = item[known]
        self.first = np.searchsorted(code[order][known], np.arange(len(texts) + 1))

    def items_of(self, phrase: np.ndarray) -> np.ndarray:
        """The different item ids of some phrases, ascending."""
        return np.unique(np.concatenate([self.items[self.first[p]: self.first[p + 1]] for p in phrase]))


def _pieces(starts: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """Runs of texts that fit one index, as (starts of the texts, and the
    end): a longer text is cut into pieces that overlap, so that each phrase
    lies in one of them."""
    room, begin = MOST, 0
    texts = len(starts) - 1
    while begin < texts:
        size = starts[begin + 1:] - starts[begin] + np.arange(1, texts - begin + 1)
        end = begin + int(np.searchsorted(size, room, side="right"))
        if end > begin:
            yield starts[begin: end + 1]
            begin = end
            continue
        at = int(starts[begin])
        while True:
            stop = min(at + room - 1, int(starts[begin + 1]))
            yield np.array([at, stop])
            if stop == starts[begin + 1]:
                break
            at = stop - longest + 1
        begin += 1


def hits(words: pa.Array, starts: np.ndarray, block: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word position) of all occurrences in the texts."""
    found_p, found_at = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    longest = block.table.shape[1]
    for own in _pieces(starts, longest):
        a, b = int(own[0]), int(own[-1])
        if a == b:
            continue
        coded = words.slice(a, b - a).dictionary_encode()
        index = FMIndex(coded.indices.to_numpy().astype(np.int64), own - a, len(coded.dictionary))
        local = pc.fill_null(pc.index_in(block.words, value_set=coded.dictionary), -1).to_numpy().astype(np.int64)
        table = np.where(block.table >= 0, local[block.table], -1)
        phrase, at = index.locate(*index.search(table, block.lengths))
        found_p.append(phrase)
        found_at.append(at + a)
    return np.concatenate(found_p), np.concatenate(found_at)


def _pass(docs: DataFrame, keys: list[str], block: Phrases) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kept = T.StructType([docs.schema[k] for k in keys])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += ", n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<long>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in by_bytes(batches, "text", SHARD_BYTES):
            words, starts = word_lists(batch.column("text"))
            n = batch.num_rows
            phrase, at = hits(words, starts, block) if len(block.table) else (np.zeros(0, int), np.zeros(0, int))
            doc = np.searchsorted(starts, at, side="right") - 1
            # Spans: where the number of phrases over a word leaves or meets zero.
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + block.lengths[phrase], -1)
            hit = np.cumsum(edge)[:-1] > 0
            begin = np.zeros(len(words), dtype=bool)
            begin[starts[:-1][starts[:-1] < len(words)]] = True
            before = np.concatenate(([False], hit[:-1])) & ~begin
            last = np.concatenate((begin[1:], [True])) if len(words) else begin
            after = np.concatenate((hit[1:], [False])) & ~last
            lo, hi = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
            own = np.searchsorted(starts, lo, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(lo - starts[own]), pa.array(hi - starts[own])], fields=list(span))
            totals = np.concatenate(([0], np.cumsum(hit)))
            pairs = np.unique(doc * max(len(block.table), 1) + phrase)
            pair_doc, pair_phrase = np.divmod(pairs, max(len(block.table), 1))
            cut = np.searchsorted(pair_doc, np.arange(n + 1))
            items, ends = [], [0]
            for k in range(n):
                if cut[k] < cut[k + 1]:
                    items.append(block.items_of(pair_phrase[cut[k]: cut[k + 1]]))
                ends.append(ends[-1] + (len(items[-1]) if cut[k] < cut[k + 1] else 0))
            flat = np.concatenate(items) if items else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k) for k in range(len(keys))),
                pa.array(np.diff(starts)), pa.array(totals[starts[1:]] - totals[starts[:-1]]),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), spans),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
            ], names=[*keys, "n_words", "n_hit", "spans", "items"])

    return docs.select(*[col(k) for k in keys], "text").mapInArrow(search, schema)


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), joined)).otherwise(F.concat(done, F.array(s)))

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(F.array_sort(spans), empty, lambda d, s: F.when(F.size(d) == 0, F.array(s)).otherwise(add(d, s)))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, doc_col: str = "doc_id",
                  text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text",
                  block: int = BLOCK) -> DataFrame:
    """One row per document: its id (``doc_id``), n_words, n_hit (words inside
    any phrase's occurrence), spans (these words as merged [start, end) word
    ranges, ascending) and items (ids of the items with an occurring phrase,
    ascending).

    A null text, like one without words, has 0 words and no hits. Equal
    documents and repeated doc_ids (null too) each give a row. Items of equal
    text all count; rows that repeat an item id count once; an item without
    an id hits words but is not listed. Long texts are read whole, in
    overlapping pieces. Empty tables give empty or hit-free results. Further
    columns are ignored whatever their names.
    """
    rows = docs.select(col(doc_col).alias("doc_id"), col(text_col).alias("text"))
    found = held(phrases(items, window, id_col, item_text_col))
    blocks = max(1, -(-found.count() // block))
    if blocks == 1:
        return _pass(rows, ["doc_id"], Phrases(found.toArrow()))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    out = None
    for k in range(blocks):
        own = found.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)) == k)
        part = _pass(rows, ["row", "doc_id"], Phrases(own.toArrow()))
        out = part if out is None else out.unionByName(part)
    merged = out.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of a contamination table."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans")


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL for ``digests`` of the ``documents`` and ``benchmark`` tables,
#: without the spans. Every word sequence of a phrase's length is compared.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
), x AS (
  SELECT r, s, list(word) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten
  FROM (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS s FROM d)
), g AS (
  SELECT r, s, k, array_to_string(list_slice(ten, 1, k), ' ') AS phrase
  FROM x, (SELECT DISTINCT k FROM p) WHERE len(ten) >= k
), f AS (
  SELECT g.r, g.s, g.k, p.item_id FROM g JOIN p ON g.k = p.k AND g.phrase = p.phrase
), h AS (
  SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS pos FROM f) GROUP BY r
), i AS (
  SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM f WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
