"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import linededup, negatives, rules, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    found = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(found)


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import idfiles

    return idfiles.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import wacz

    return wacz.round_trip(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import crf

    return crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secretscan

    return secretscan.digests(table(spark, sf_dir, "documents"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import turns

    return turns.repaired_damage(table(spark, sf_dir, "conversations"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_leaks": op1_leaks,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_rules": op6_rules,
    "op7_lm": op7_lm,
    "op8_urls": op8_urls,
    "op9_secrets": op9_secrets,
    "op10_id_files": op10_id_files,
    "op11_turns": op11_turns,
    "op12_lines": op12_lines,
    "op13_negatives": op13_negatives,
}
ORACLES: dict[str, str] = {"op6_rules": rules.ORACLE, "op8_urls": urlfilter.oracle(), "op12_lines": linededup.ORACLE, "op13_negatives": negatives.ORACLE}
