"""Registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, conv_trie, ctw, decontam, embed_dedup, html_crf, langid, line_dedup, maxscore, mixing, simhash, topk, toxicity

#: The vocabulary of the tokenizing query.
VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, count_cols=("n_lines", "n_removed"), min_words=1, grams=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.lm_scores(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op11_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return decontam.digests(found).drop("spans")


def op12_conv_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.conversation_trie(
        table(spark, sf_dir, "conversations"), base=conv_trie.hundred, share=conv_trie.drawn_share, most=5)


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_langid, op2_embed_dedup, op3_bpe, op4_topk, op5_simhash,
        op6_line_dedup, op7_toxicity, op8_ctw, op9_html, op10_mixing,
        op11_decontam, op12_conv_trie, op13_maxscore,
    )
}

SQL: dict[str, str] = {"op4_topk": topk.SQL, "op10_mixing": mixing.SQL, "op11_decontam": decontam.SQL,
                       "op12_conv_trie": conv_trie.SQL,
                       "op13_maxscore": maxscore.SQL}
