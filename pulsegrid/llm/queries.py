"""The thin queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import cdc_dedup, html_main, iblt, lsa_decontam, lyndon_runs, pii_boost, quality_fm, rake_mix, secret_worklist, simhash_cover, token_align, token_automaton, warc_revisit
from pulsegrid.llm.shared import table


def op1_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.find_pii(table(spark, sf_dir, "documents"))


def op4_lsa_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa_decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_worklist.find_secrets(table(spark, sf_dir, "documents"))


def op7_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisit.resolve(warc_revisit.captures(table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.withColumn("headers", F.array_join(entries, ";"))


def op8_rake_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rake_mix.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("__probability", 6).alias("probability"), F.col("__sampled").alias("sampled"))


def op9_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op10_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_cover.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_cover.hex16("fp").alias("fingerprint"), "component_id")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_automaton.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon_runs.periodic_runs(table(spark, sf_dir, "documents"), loops=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_main": op1_html_main,
        "op2_quality_fm": op2_quality_fm,
        "op3_pii_boost": op3_pii_boost,
        "op4_lsa_decontam": op4_lsa_decontam,
        "op5_cdc_dedup": op5_cdc_dedup,
        "op6_secret_worklist": op6_secret_worklist,
        "op7_warc_revisit": op7_warc_revisit,
        "op8_rake_mix": op8_rake_mix,
        "op9_iblt": op9_iblt,
        "op10_simhash_cover": op10_simhash_cover,
        "op11_token_align": op11_token_align,
        "op12_token_automaton": op12_token_automaton,
        "op13_lyndon_runs": op13_lyndon_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc_revisit": warc_revisit.SQL,
        "op8_rake_mix": rake_mix.sql(),
        "op9_iblt": iblt.sql(),
    }
