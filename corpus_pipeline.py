"""From raw documents to token ids: every stage calls one operator of tidymer.llm.

Each stage works on all that its predecessor kept and returns the columns of documents; the last returns token ids.
``run`` writes each stage's rows to the shared folder and reads them again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidymer.llm import byte_bpe, lang_id, mixing, simhash, toxicity
from tidymer.llm.shared import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among them, doesn't predict as toxic."""
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=True)


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in a language that could be learnt; the others (``und``) go."""
    return lang_id.predict(docs, lang_id.fit(docs), keep=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: chains of links of an exact Jaccard similarity of 0.8 or more of five-word shingle sets."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the bytes that they decode to."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: (name, function of (spark, docs, sf_dir)).
STAGES = [("toxicity", without_toxic), ("language", in_known_language), ("near_duplicates", one_of_each), ("mixing", mixed), ("byte_bpe", encoded)]

#: SQL cannot express the stages (compression, learnt models, recursion on bits); tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
