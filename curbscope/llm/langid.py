"""Language ID: word-first backoff.

Every known word adds its log frequency in each language. An unknown word
falls back to its character 5-grams (with a mark at either end); if none of
them is known, to its 4-grams, and so on down to single characters. The
language with the highest sum wins; its score is its share after a softmax
over the languages.

The model is fitted on a bounded sample of labelled rows (about
``sample_rows`` documents, shared evenly among the languages, chosen by a
hash) and holds at most ``max_words`` words and ``max_grams`` n-grams, the
most frequent ones, so what is broadcast does not grow with the data.
Predictions use the whole text and nothing else.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import col

SAMPLE_ROWS = 16_000
MAX_WORDS = 80_000
MAX_GRAMS = 80_000
LONGEST_GRAM = 5
#: Added to every count.
SMOOTHING = 0.5
#: Unknown words whose scores a worker keeps.
CACHE = 200_000
#: A word: a run of letters, lower-cased.
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Per-language log frequencies of words and n-grams.

    ``tables``: {0: word counts, n: n-gram counts}, each {item: [count per
    language]}.
    """

    def __init__(self, languages: list[str], tables: dict[int, dict[str, list[float]]]):
        self.languages = languages
        self.logs = {n: self.frequencies(t) for n, t in tables.items()}
        self.unknown: dict[str, list[float]] = {}

    def frequencies(self, table: dict[str, list[float]]) -> dict[str, list[float]]:
        sums = [sum(c) for c in zip(*table.values())] or [0.0] * len(self.languages)
        base = [math.log(s + SMOOTHING * (len(table) + 1)) for s in sums]
        return {w: [math.log(c + SMOOTHING) - b for c, b in zip(cs, base)] for w, cs in table.items()}

    def backoff(self, word: str) -> list[float]:
        """Mean log frequency of the word's longest known n-grams; nothing
        known: no evidence."""
        for n in range(LONGEST_GRAM, 0, -1):
            table = self.logs.get(n, {})
            known = [v for v in map(table.get, grams(word, n)) if v is not None]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * len(self.languages)

    def word(self, word: str) -> list[float]:
        found = self.logs[0].get(word) or self.unknown.get(word)
        if found is None:
            if len(self.unknown) >= CACHE:
                self.unknown.clear()
            found = self.backoff(word)
            if len(word) <= 64:
                self.unknown[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); ("und", 0.0) for texts without a letter or a
        model without languages."""
        counts = Counter(words(text))
        # Words can hold other numerals (a fraction, a circled digit) alone.
        if not self.languages or not any(any(map(str.isalpha, w)) for w in counts):
            return "und", 0.0
        sums = [0.0] * len(self.languages)
        known, word = self.logs[0].get, self.word
        for w, n in counts.items():
            sums = [s + n * v for s, v in zip(sums, known(w) or word(w))]
        most = max(sums)
        return self.languages[sums.index(most)], 1.0 / sum(math.exp(s - most) for s in sums)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """True where crc32(doc_id as text) mod ``parts`` is ``part``; rows
    without doc_id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          sample_rows: int = SAMPLE_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """The model of the labelled rows of ``docs``. Rows without text or
    language are left out."""
    chosen = docs.select(
        col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"),
        ((F.xxhash64(col(id_col), F.lit("langid")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0).alias("u"),
    ).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {0: {}})
    share = sample_rows / len(languages)
    take = F.lit(False)
    for name, n in sizes.items():
        take = take | ((F.col("lang") == name) & (F.col("u") < share / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield pa.record_batch(
                    [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())],
                    names=["lang", "word", "n"],
                )

        for b in common.slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = held.setdefault(lang, Counter())
                size -= len(c)
                c.update(words(text))
                size += len(c)
                if size > 300_000:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    counted = chosen.where(take).select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    counted = common.held(counted.groupBy("word", "lang").agg(F.sum("n").alias("n")))
    place = {name: k for k, name in enumerate(languages)}

    def most_frequent(df: DataFrame, keys: list[str], limit: int) -> list:
        """Rows (key..., {lang: n}) of the most frequent keys that occur more
        than once."""
        by = df.groupBy(*keys).agg(
            F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("each"))
        return by.where("total > 1").orderBy(F.col("total").desc(), *keys).limit(limit).collect()

    def counts(each) -> list[float]:
        row = [0.0] * len(languages)
        for x in each:
            row[place[x["lang"]]] += float(x["n"])
        return row

    tables: dict[int, dict[str, list[float]]] = {n: {} for n in range(LONGEST_GRAM + 1)}
    for r in most_frequent(counted, ["word"], max_words):
        tables[0][r["word"]] = counts(r["each"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in common.slices(batches, 4096):
            for word, lang, c in zip(*(x.to_pylist() for x in b.columns)):
                for size in range(1, LONGEST_GRAM + 1):
                    for g in grams(word, size):
                        held[lang, size, g] += c
            if len(held) > 300_000:
                yield from out(held)
                held = Counter()
        yield from out(held)

    def out(held: Counter) -> Iterator[pa.RecordBatch]:
        if held:
            langs, sizes_, texts = zip(*held)
            yield pa.record_batch(
                [pa.array(langs, pa.string()), pa.array(sizes_, pa.int32()), pa.array(texts, pa.string()), pa.array(list(held.values()), pa.int64())],
                names=["lang", "size", "gram", "n"],
            )

    cut_up = counted.select("word", "lang", "n").mapInArrow(cut, "lang string, size int, gram string, n long")
    cut_up = cut_up.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    for r in most_frequent(cut_up, ["size", "gram"], max_grams):
        tables[r["size"]][r["gram"]] = counts(r["each"])
    return Model(languages, tables)


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score): ``row`` a struct of the columns ``carry``
    (all, if not given)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = docs.columns if carry is None else carry
    own = docs.select(F.struct(*[col(c) for c in carry]).alias("row"), col(text_col).cast("string").alias("text"))
    within = text_col in carry and dict(docs.dtypes)[text_col] == "string"
    if within:
        own = own.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in common.slices(batches):
            texts = b.column(0).field(text_col) if within else b.column(1)
            found = [m.predict(t) for t in texts.to_pylist()]
            yield pa.record_batch(
                [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    schema = own.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return own.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from the rows whose crc32(doc_id as text) mod 4 is not 2 and whose
    language is not null; predicts all rows from their text alone. ``und``
    with score 0 where the text is null or has no letter, or where nothing
    can be learned. Repeated rows give repeated rows; rows without doc_id are
    predicted, not learned from. Other columns are not read; an empty table
    gives an empty result.
    """
    key = col(id_col)
    model = train(docs.where(key.isNotNull() & ~held_out(key)), text_col, lang_col, id_col, **limits)
    own = docs.select(key.alias("doc_id"), col(text_col).cast("string").alias("text"))
    found = predict(own, model, carry=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   **limits) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language: those
    predicted ``und`` go (null texts and texts without a letter). A row
    without a language gets the predicted one; other rows keep theirs.

    Where no row has a language to learn from, every text with a letter
    stays, its language null. Repeated rows stay repeated; an empty table
    gives an empty result."""
    key = col(id_col)
    model = train(docs.where(key.isNotNull() & ~held_out(key)), text_col, lang_col, id_col, **limits)
    if not model.languages:
        return docs.where(col(text_col).cast("string").rlike(r"\p{L}"))
    found = predict(docs, model, text_col).where("lang_pred <> 'und'")
    own = lambda c: F.col("row").getField(c)
    kind = dict(docs.dtypes)[lang_col]
    return found.select(*[
        (F.coalesce(own(c), F.col("lang_pred").cast(kind)) if c == lang_col else own(c)).alias(c) for c in docs.columns])
