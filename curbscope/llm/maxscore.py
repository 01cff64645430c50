"""Ranked lexical search by pair-bound MaxScore.

Terms are runs of letters, digits and non-ASCII characters, A-Z in lower
case. A document's score for an item is the sum over the item's terms of
``w * (1e9 * tf div (1000 * tf + 20 * m))`` with the term's weight w and the
document's length factor m, all integers.

1. ``term_vectors``: one pass over the documents counts the queries' terms in
   each whole text; the counts are written down.
2. Number of documents, their length and document frequencies are summed over
   them; weights follow.
3. The counts are read again in shards of about ``SHARD_POSTINGS`` postings.
   Each shard's index is computed before its queries: a list of (document,
   impact) and the largest impact for every term, and for every pair of terms
   that are neighbours by weight in some query the list of the documents that
   hold both, with the largest joint impact.
4. ``search_shard``: bounds of the lightest i terms combine single maxima and
   joint maxima of disjoint neighbours by dynamic programming, so they are
   at most the sum of the single maxima. Terms whose bound stays below the
   k-th best score so far make no candidates; where only documents with the
   next two terms together can reach it, their intersection list makes them
   instead of the longer term list. Lighter terms are looked up for
   candidates that can still enter. Every task carries its best k of each
   query from shard to shard; the tasks' rows are ranked at the end.

The items are the stated query set and go to the tasks in blocks of at most
about ``BLOCK`` (item, term) pairs, each a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, held, stored
from .words import by_bytes, word_lists

#: (item, term) pairs that are broadcast at a time: about 50 MB.
BLOCK = 500_000

#: Postings and documents of a shard.
SHARD_POSTINGS, SHARD_DOCS = 1 << 18, 1 << 15

#: Text that is cut into words at a time.
SLICE_BYTES = 6 << 20


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(q, item_id, terms): the different terms of each item row, numbered."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            words, starts = word_lists(batch.column("text"))
            words = words.to_pylist()
            found = [sorted(set(words[a:b])) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("q"), batch.column("item_id"), pa.array(found, pa.list_(pa.string()))], ["q", "item_id", "terms"])

    rows = items.select(col(id_col).alias("item_id"), col(text_col).alias("text"))
    rows = rows.withColumn("q", F.monotonically_increasing_id())
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.select("q", "item_id", "text").mapInArrow(cut, f"q long, item_id {kind}, terms array<string>")


class Queries:
    """A block of queries: the vocabulary, and each query's term numbers."""

    def __init__(self, table: pa.Table):
        terms = table.column("terms").combine_chunks()
        coded = terms.flatten().cast(pa.large_string()).dictionary_encode()
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy())))
        numbers = coded.indices.to_numpy().astype(np.int64)
        self.words = coded.dictionary
        self.q = table.column("q").to_numpy()
        self.terms = [numbers[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def weighed(self, weight: np.ndarray) -> Queries:
        """Terms in ascending weight, and the pairs of neighbours."""
        self.weight = weight
        self.terms = [t[np.lexsort((t, weight[t]))] for t in self.terms]
        size = max(len(weight), 1)
        keys = [t[:-1] * size + t[1:] for t in self.terms]
        self.pairs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
        self.pair_of = [np.searchsorted(self.pairs, x) for x in keys]
        self.a, self.b = np.divmod(self.pairs, size)
        return self


def term_vectors(docs: DataFrame, queries: Queries, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: the number of
    its terms with repeats, and the queries' terms in it with their counts."""
    words = docs.sparkSession.sparkContext.broadcast(queries.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            found, starts = word_lists(batch.column("text"))
            coded = found.dictionary_encode()
            number = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy().astype(np.int64)
            term = number[coded.indices.to_numpy()] if len(found) else np.zeros(0, dtype=np.int64)
            n = np.diff(starts)
            doc = np.repeat(np.arange(len(n)), n)
            size = max(len(known), 1)
            pairs, tf = np.unique((doc * size + term)[term >= 0], return_counts=True)
            own, term = np.divmod(pairs, size)
            ends = np.searchsorted(own, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (term.astype(np.int32), tf.astype(np.int64))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    rows = docs.select(col(doc_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of ``size`` terms, counted batch by batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            held_terms = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(held_terms, pa.int32()), pa.array(df[held_terms], pa.int64())], ["term", "df"])

    rows = vectors.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = rows.toArrow()   # at most one row a term of the block
    df = np.zeros(size, dtype=np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return df


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * docs + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Impacts of postings; ``n`` is the length of each one's document."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        m = np.array([50 + 50 * int(x) * docs // length for x in n], dtype=np.int64)
    else:
        m = 50 + 50 * n * docs // max(length, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Shard:
    """Lists of a shard: term t's postings are ``docs[at[t]:at[t+1]]`` (row
    numbers in the shard, ascending) and ``impact``; those of pair p likewise
    with the sum of both impacts; ``top`` and ``joint_top`` are the largest."""

    def __init__(self, queries: Queries, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int):
        keep = impact > 0
        row, term, impact = row[keep], term[keep], impact[keep]
        order = np.lexsort((row, term))
        row, impact = row[order].astype(np.int32), impact[order]
        at = np.searchsorted(term[order], np.arange(len(queries.weight) + 1))
        here = np.zeros(rows, dtype=np.int64)
        both_docs, both = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        sizes, last = np.zeros(len(queries.pairs), dtype=np.int64), -1
        for p, (a, b) in enumerate(zip(queries.a.tolist(), queries.b.tolist())):
            if at[a] == at[a + 1] or at[b] == at[b + 1]:
                continue
            if a != last:   # pairs come sorted by their first term
                if last >= 0:
                    here[row[at[last]: at[last + 1]]] = 0
                here[row[at[a]: at[a + 1]]] = impact[at[a]: at[a + 1]]
                last = a
            own = row[at[b]: at[b + 1]]
            other = here[own]
            met = np.flatnonzero(other)
            if len(met):
                both_docs.append(own[met])
                both.append(other[met] + impact[at[b]: at[b + 1]][met])
                sizes[p] = len(met)
        self.rows, self.at, self.docs, self.impact = rows, at, row, impact
        self.pair_at = np.concatenate(([0], np.cumsum(sizes)))
        self.pair_docs, self.joint = np.concatenate(both_docs), np.concatenate(both)
        self.top, self.joint_top = _tops(at, impact), _tops(self.pair_at, self.joint)


def _tops(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    top = np.zeros(len(at) - 1, dtype=np.int64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        top[full] = np.maximum.reduceat(values, at[full])
    return top


def bounds(top: np.ndarray, joint: np.ndarray | None) -> list[int]:
    """Upper bounds of what the first 0, 1, 2, ... terms add to any document:
    single maxima, or for two neighbours their joint maximum (or the larger
    single one, for documents that hold one of them)."""
    out = [0]
    for i, u in enumerate(top.tolist()):
        b = out[-1] + u
        if i and joint is not None:
            b = min(b, out[-2] + max(int(joint[i - 1]), int(top[i - 1]), u))
        out.append(b)
    return out


def search_shard(shard: Shard, terms: np.ndarray, pair: np.ndarray, k: int, least: int,
                 touched: list[int] | None = None, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of all rows of the shard with a score above 0 that can
    be among the best ``k`` when k others have ``least`` or more; ties with
    ``least`` are kept. ``touched`` counts postings read."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    top = shard.top[terms]
    bound = bounds(top, shard.joint_top[pair] if with_pairs else None)
    floor = max(least, 1)
    if bound[-1] < floor:
        return none
    first = int(np.searchsorted(np.array(bound), floor)) - 1   # bound[first] < floor <= bound[first + 1]
    score = np.zeros(shard.rows, dtype=np.int64)

    def postings(t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = shard.at[t], shard.at[t + 1]
        return shard.docs[a:b], shard.impact[a:b]

    def note(n: int) -> None:
        if touched is not None:
            touched[0] += n

    alone = first == 0 or not with_pairs or bound[first - 1] + int(top[first]) >= floor
    for t in terms[first + (0 if alone else 1):]:
        docs, impact = postings(t)
        score[docs] += impact
        note(len(docs))
    rest = first if alone else first + 1
    if alone:
        rows = np.flatnonzero(score)
    else:   # of the rows without a heavier term only those with both of these
        p = pair[first - 1]
        docs = shard.pair_docs[shard.pair_at[p]: shard.pair_at[p + 1]]
        note(len(docs))
        wanted = score > 0
        wanted[docs] = True
        rows = np.flatnonzero(wanted)
    own = score[rows]
    for i in range(rest, 0, -1):
        if len(own) >= k:
            floor = max(floor, int(np.partition(own, len(own) - k)[len(own) - k]))
        live = own + bound[i] >= floor
        rows, own = rows[live], own[live]
        if not len(rows):
            return none
        docs, impact = postings(terms[i - 1])
        if not len(docs):
            continue
        if 8 * len(rows) < len(docs):
            at = np.minimum(np.searchsorted(docs, rows), len(docs) - 1)
            own = own + np.where(docs[at] == rows, impact[at], 0)
            note(len(rows))
        else:
            line = np.zeros(shard.rows, dtype=np.int64)
            line[docs] = impact
            own = own + line[rows]
            note(len(docs))
    live = own >= floor
    return rows[live], own[live]


def _best(score: np.ndarray, known: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k by (score descending, documents without id first,
    id ascending)."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((doc[some], known[some], -score[some]))[:k]]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Term vectors in runs of about ``SHARD_POSTINGS`` postings and at most
    ``SHARD_DOCS`` documents, whatever the size of the batches."""
    parts, size, rows = [], 0, 0
    for batch in batches:
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())))
        start = 0
        while start < batch.num_rows:   # as many rows as there is room for, one at least
            end = int(np.searchsorted(ends, ends[start] + SHARD_POSTINGS - size, side="right")) - 1
            end = max(min(end, batch.num_rows, start + SHARD_DOCS - rows), start + (0 if parts else 1))
            if end > start:
                parts.append(batch.slice(start, end - start))
                size, rows = size + int(ends[end] - ends[start]), rows + end - start
            if end < batch.num_rows:
                yield pa.Table.from_batches(parts)
                parts, size, rows = [], 0, 0
            start = end
    if parts:
        yield pa.Table.from_batches(parts)


def search(vectors: DataFrame, queries, k: int, docs: int, length: int) -> DataFrame:
    """(q, doc_id, score): each task's best k rows of every query. ``queries``
    is a broadcast of weighed ``Queries``; ``docs`` documents have ``length``
    terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for table in _shards(batches):
            table = table.combine_chunks()
            terms = table.column("terms").combine_chunks()
            row = np.repeat(np.arange(table.num_rows), pc.list_value_length(terms).to_numpy())
            term = terms.flatten().to_numpy().astype(np.int64)
            tf = table.column("tfs").combine_chunks().flatten().to_numpy()
            n = table.column("n").to_numpy()
            shard = Shard(own, row, term, impacts(own.weight[term], tf, n[row], docs, length), table.num_rows)
            column = table.column("doc_id").combine_chunks()
            ids, known = column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            for x, (asked, pair) in enumerate(zip(own.terms, own.pair_of)):
                had = best.get(x)
                least = int(had[0][-1]) if had is not None and len(had[0]) == k else 0
                rows, score = search_shard(shard, asked, pair, k, least)
                if not len(rows):
                    continue
                found = score, known[rows], ids[rows]
                if had is not None:
                    found = tuple(np.concatenate(y) for y in zip(had, found))
                pick = _best(*found, k)
                best[x] = tuple(y[pick] for y in found)
        for x, (score, known, ids) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), own.q[x])), pa.array(ids, mask=~known), pa.array(score)], ["q", "doc_id", "score"])

    return vectors.mapInArrow(run, "q long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, doc_col: str = "doc_id", text_col: str = "text",
           id_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item row its ``k``
    highest-scoring documents with a score above 0 (all, if fewer), rank 1
    the highest, equal scores by ascending doc_id (documents without an id
    first).

    Every document row counts for itself, equal ones and repeated ids too; so
    does every item row (rows of one item_id are ranked each). A null text,
    or one without terms, is no document and an item without results. Texts
    are read whole. Empty tables give an empty result. Further columns are
    not read.
    """
    asked = held(query_terms(items, id_col, item_text_col))
    shared = docs.sparkSession.sparkContext
    blocks = max(1, -(-int(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block))
    out = None
    for part in range(blocks):
        own = Queries(asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == part).select("q", "terms").toArrow())
        vectors = stored(term_vectors(docs, own, doc_col, text_col))
        total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        own = shared.broadcast(own.weighed(weights(frequencies(vectors, len(own.words)), total[0])))
        found = search(vectors, own, k, *total)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    rows = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL for ``ranked`` of the ``documents`` and ``benchmark`` tables.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS t
  FROM documents
), s AS (
  SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0
), q AS (
  SELECT DISTINCT r, item_id, term FROM (
    SELECT row_number() OVER () AS r, item_id,
           unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
    FROM benchmark)
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * max(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM p, s GROUP BY term
), x AS (
  SELECT q.r, q.item_id, p.doc_id, p.r AS doc,
         CAST(sum(w * (1000000000 * tf // (1000 * tf + 20 * (100 - 50 + 50 * n * docs // length)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL
), o AS (
  SELECT item_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id ASC NULLS FIRST) AS rank, doc_id, score
  FROM x WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
"""
