"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, decontaminate, extract, hmm, lexical, licenses, mih, packing, ppm, sharding, simhash, toxicity, unigram
from .common import crc_mod, table


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ppm.train(docs, crc_mod("doc_id", 5) != 0)
    out = ppm.identified(docs, model)
    return out.withColumn("held_out", crc_mod("doc_id", 5) == 0).select("doc_id", "held_out", "lang_pred", "score", "bits")


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = hmm.scored(docs, crc_mod("doc_id", 7) != 2)
    return out.withColumn("held_out", crc_mod("doc_id", 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def op6_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    out = toxicity.scored(docs, model, threshold=0.3)
    return out.withColumn("held_out", crc_mod("doc_id", 4) == 2).select("doc_id", "held_out", "score", "predicted")


def op7_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=24)


def op8_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encoded(table(spark, sf_dir, "documents"))


def op9_qgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.clustered(table(spark, sf_dir, "embeddings"))


def op12_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op13_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_best_fit": op1_best_fit, "op2_ppm": op2_ppm, "op3_hmm": op3_hmm, "op4_mih": op4_mih, "op5_line_blocks": op5_line_blocks, "op6_nb_ngrams": op6_nb_ngrams, "op7_bytes": op7_bytes, "op8_unigram": op8_unigram, "op9_qgram": op9_qgram, "op10_simhash": op10_simhash, "op11_ball_tree": op11_ball_tree, "op12_diagonal_voting": op12_diagonal_voting, "op13_bit_sliced": op13_bit_sliced}
ORACLE = {"op7_bytes": sharding.ORACLE_SQL, "op11_ball_tree": balltree.ORACLE_SQL, "op12_diagonal_voting": licenses.ORACLE_SQL, "op13_bit_sliced": lexical.ORACLE_SQL}
