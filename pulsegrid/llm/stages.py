"""The stages of the corpus pipeline: each takes the documents that the one before it kept, and gives those that it keeps.

Every stage takes any rows: other columns than its own, whatever their names, stay as they are, a null text counts as empty, texts of any length
are read whole, rows of one doc_id or without one are rows like others, and an empty table gives an empty one. What repeated rows
and ties give is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import lsa_decontam, quality_fm, rake_mix, secret_worklist, simhash_cover
from pulsegrid.llm.shared import drop, free, park, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold go; equal texts have equal scores, so that repeated rows stay or go
    together."""
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    score = free("quality_score", docs.columns)
    return quality_fm.scores(docs, machine, docs.columns, score).where(F.col(f"`{score}`") >= quality_fm.THRESHOLD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id: of texts that share 0.8 of
    their five-word shingles. Null doc_ids come last; of a doc_id's different texts the one with the least digest stays, of equal rows one."""
    return simhash_cover.one_of_each(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows together; texts without words hold none."""
    return lsa_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones too, are replaced by a mark; every document stays, repeated rows each, and a null text is null."""
    return secret_worklist.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens fit the target shares of sources, languages and topics, with each document's probability; repeated rows are
    drawn or not as rake_mix.mix says."""
    name = rake_mix.Names.of(docs)
    out = {old: free(new, docs.columns) for old, new in ((name.topic, "topic"), (name.tokens, "n_tokens"), (name.probability, "probability"))}
    return rake_mix.mix(docs).where(F.col(name.sampled)).drop(name.sampled).withColumnsRenamed(out)


def run(spark: SparkSession, sf_dir: str, stages) -> DataFrame:
    """Applies stages, (name, function) each, to the table documents; every result is written as Parquet and read by the next."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in stages:
        docs, new = park(stage(spark, docs, sf_dir), name)
        if path:
            drop(spark, path)
        path = new
    return docs
