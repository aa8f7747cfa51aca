"""File sources: JSON lines with an explicit schema, WHOIS text, message envelopes, probe directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.operators.frames import ensure
from pulsegrid.schemas import CORRUPT, with_corrupt


def json_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, texts of malformed lines). Compressed files and empty ones are fine; a gzip file is one task."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", with_corrupt(schema), options).alias("r"))
    return raw.where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT), raw.select(f"r.{CORRUPT}").where(F.col(CORRUPT).isNotNull())


def json_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the schema that Spark infers from them; a column `_corrupt_record` has the text of malformed ones, whose other
    columns are null, and is there without any too."""
    return ensure(spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path), **{CORRUPT: "string"})


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def whois(lines: DataFrame, column: str = "value") -> DataFrame:
    """asn, name, country from `ASN | CC | registry | date | name` lines; others are skipped, an empty name becomes AS<n>."""
    p = F.transform(F.split(F.col(column), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.col(column).contains("|")).select(p.alias("p")).where(F.size("p") >= 5)
    rows = rows.select(F.expr("try_cast(p[0] AS int)").alias("asn"), F.col("p")[4].alias("name"), F.col("p")[1].alias("country")).where("asn IS NOT NULL")
    return rows.select("asn", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("AS"), F.col("asn").cast("string"))).alias("name"), "country")


def socket_messages(lines: DataFrame, schema: StructType, event: str, column: str = "value") -> DataFrame:
    """Payloads of two-element array messages ["event", payload]; other events and malformed ones are left out."""
    parts = F.from_json(F.col(column), "array<string>")
    found = lines.select(parts.alias("m")).where((F.size("m") == 2) & (F.col("m")[0] == event))
    return found.select(F.from_json(F.col("m")[1], schema).alias("data")).select("data.*")


def probe_map(directory: DataFrame, order: Column) -> DataFrame:
    """prb_id, country_code, asn of probes with an ASN; of several entries the last by `order`."""
    known = directory.where(F.coalesce("asn_v4", F.lit(0)) != 0)
    last = known.groupBy(F.col("id").alias("prb_id")).agg(F.max_by(F.struct("country_code", F.col("asn_v4").alias("asn")), order).alias("r"))
    return last.select("prb_id", "r.country_code", "r.asn")


def probe_entries(entries: DataFrame) -> DataFrame:
    """prb_id, country_code, asn of a stored probe map: columns prb_id and value, the JSON text of an object, or, as older maps
    have it, of a string that is the country alone."""
    legacy = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]
    entry = F.from_json("value", "country_code string, asn int")
    old = F.ltrim("value").startswith('"')
    return entries.select("prb_id", F.when(old, legacy).otherwise(entry["country_code"]).alias("country_code"), F.when(~old, entry["asn"]).alias("asn"))


def unwrap_series(raw: DataFrame, column: str = "data") -> DataFrame:
    """Rows of an answer that is a list of lists of series."""
    return raw.select(F.explode(F.flatten(column)).alias("s")).select("s.*")
