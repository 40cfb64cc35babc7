"""A corpus pipeline of five of the training-data operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents. run() applies all of them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, ppm, resemble, toxicity, unigram
from seqloom.llm.common import table
from seqloom.sources.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; it learns from all labelled documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.with_scores(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


#: Bits a byte that letters at random need and texts of a learned language don't, and bits that any text
#: may need besides. Of 70,000 texts here, shouts, tables and keys among them, none needs 7 bits a byte;
#: words of random letters need 9.2 and more, random characters 13, other scripts 18. A key in a short text
#: costs some 300 bits.
NOISE, SPARE = 9.0, 256.0


def language_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: those without a letter (und), and those that the
    best language's model codes no shorter than letters at random. A missing lang is no reason."""
    found = ppm.with_languages(docs.select(*COLUMNS), ppm.train(docs, F.lit(True)))
    most = NOISE + SPARE / F.greatest(F.octet_length("text"), F.lit(1))
    return found.where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("bits") <= most)).select(*COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more) stays:
    the one with the smallest id."""
    return resemble.deduplicated(docs.select(*COLUMNS))


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, whole or nearly so, go."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and what they decode to."""
    return unigram.encoded(docs)


STAGES = [("toxicity", toxic_out), ("language", language_out), ("near_dedup", near_copies_out), ("decontamination", leaks_out), ("pieces", pieces)]

#: SQL can't express the models' stages; tests/llm compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name=name)
    return docs
