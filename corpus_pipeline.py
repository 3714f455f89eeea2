"""A training corpus from raw documents, in five stages; each reads what the one before has kept and written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflow.llm import language, lines, packing, personal, simhash
from cityflow.llm.common import settle, table, unused
from cityflow.session import pin


def _with_size(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language, by bars from held-out documents; null texts and texts without
    letters go."""
    known = language.learn(docs)
    return language.keep_known(docs, known, language.least_scores(docs, known))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood before, here or elsewhere; one that held nothing else goes."""
    n_lines, gone = unused(docs, "n_lines", "gone")
    cut = lines.drop_repeats(docs, added=(n_lines, gone), short=True)
    left = cut.where((F.size(gone) == 0) | (F.trim(F.regexp_replace("text", r"\s", " ")) != ""))
    return _with_size(left.drop(n_lines, gone))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_first(docs, words=5, similarity=0.8)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _with_size(personal.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("lines", first_lines),
    ("copies", first_copies),
    ("personal", without_personal_data),
    ("packing", packed),
]

# No stage can be said in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(pin(spark), sf_dir)
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
