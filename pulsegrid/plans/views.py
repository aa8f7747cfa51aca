"""The generic test tables seen as measurements, signals and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """The events, or a stream of them, with the columns that the other views are made of."""
    rows = table(spark, sf_dir, "events") if source is None else source
    return rows.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts_utc"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("C"), (F.col("user_id") % 5).cast("string")).alias("country_code"),
        (F.lit(64512) + F.col("user_id") % 30).cast("int").alias("asn"),
        (F.col("event_id") % 13).cast("int").alias("msm_id"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where k is 17 nothing was sent, so that the loss isn't known, though there's a latency."""
    k = F.col("k")
    rcvd = F.when(k < 2, 0).when(k < 6, 1).when(k < 15, 2).otherwise(3)
    rows = events(spark, sf_dir).where(F.col("event_type").isin("signup", "error"))
    rows = rows.withColumns({"sent": F.when(k == 17, 0).otherwise(3), "rcvd": rcvd, "rtt_avg_ms": F.when(rcvd > 0, F.col("value"))})
    return rows.select(
        "event_id", "ts_utc", "country_code", "asn", "msm_id", C.pii_hash(F.col("user_id")).alias("probe_id_hash"), "rtt_avg_ms", "sent", "rcvd", C.packet_loss(F.col("sent"), F.col("rcvd")).alias("packet_loss"), C.icmp_filtered(F.col("sent"), F.col("rcvd"), F.col("rtt_avg_ms")).alias("icmp_filtered")
    )


def signals(spark: SparkSession, sf_dir: str, gaps: bool = False, source: DataFrame | None = None) -> DataFrame:
    """With gaps, values are null where k is a multiple of 20. The native step of bgp is finer than its step."""
    name = F.when(F.col("event_type") == "click", "bgp").when(F.col("event_type") == "view", "merit-nt").otherwise("ping-slash24")
    rows = events(spark, sf_dir, source).where(F.col("event_type").isin("click", "view", "purchase")).withColumn("datasource", name)
    value = F.when(F.col("k") % 20 != 0, F.col("value")) if gaps else F.col("value")
    step = F.when(F.col("datasource") == "ping-slash24", 600).otherwise(300)
    return rows.select("event_id", F.unix_timestamp("ts_utc").alias("ts"), "ts_utc", F.col("country_code").alias("entity_code"), "datasource", value.alias("value"), step.alias("step"), F.when(F.col("datasource") == "bgp", 60).otherwise(step).alias("nativeStep"), value.isNull().alias("collection_gap"))


def asn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select((F.lit(64512) + F.col("n_nationkey")).cast("int").alias("asn"), F.col("n_name").alias("name"))


# The same in DuckDB's SQL, as parts of a WITH clause.
EV = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'C' || CAST(user_id % 5 AS VARCHAR) AS country_code,
  CAST(64512 + user_id % 30 AS INT) AS asn, CAST(event_id % 13 AS INT) AS msm_id FROM events)"""
MEAS = """meas AS (SELECT event_id, ts AS ts_utc, date_trunc('hour', ts) AS time_window, country_code, asn, msm_id, user_id AS probe, k,
  CASE WHEN k < 2 THEN NULL ELSE value END AS rtt_avg_ms,
  CASE WHEN k <> 17 THEN 1.0::DOUBLE - (CASE WHEN k < 2 THEN 0 WHEN k < 6 THEN 1 WHEN k < 15 THEN 2 ELSE 3 END)::DOUBLE / 3.0::DOUBLE END AS packet_loss, k < 2 AS icmp_filtered
  FROM ev WHERE event_type IN ('signup', 'error'))"""
SIG = """sig AS (SELECT event_id, ts AS ts_utc, CAST(floor(epoch(ts)) AS BIGINT) AS s, country_code, value, CASE WHEN k % 20 = 0 THEN NULL ELSE value END AS gap_value,
  CASE event_type WHEN 'click' THEN 'bgp' WHEN 'view' THEN 'merit-nt' ELSE 'ping-slash24' END AS datasource, CASE event_type WHEN 'purchase' THEN 600 ELSE 300 END AS step
  FROM ev WHERE event_type IN ('click', 'view', 'purchase'))"""
BASE = """base AS (SELECT time_window, country_code, asn, quantile_disc(rtt_avg_ms, 0.1) AS rtt_p10_ms, quantile_disc(rtt_avg_ms, 0.5) AS rtt_median_ms, quantile_disc(rtt_avg_ms, 0.9) AS rtt_p90_ms,
  quantile_disc(packet_loss, 0.5) AS loss_median_pct, quantile_disc(packet_loss, 0.95) AS loss_p95_pct, CAST(count(*) AS INT) AS total_measurements,
  CAST(count(DISTINCT probe) AS INT) AS probe_count, CAST(count(DISTINCT msm_id) AS INT) AS root_server_count, CAST(sum(icmp_filtered::INT) AS INT) AS icmp_filtered_count
  FROM meas WHERE rtt_avg_ms > 0 AND packet_loss IS NOT NULL GROUP BY ALL)"""


def buckets_sql(value: str = "value", name: str = "buckets") -> str:
    return f"""{name} AS (SELECT make_timestamp((s // step) * step * 1000000) AS time_bucket, country_code, datasource, avg({value}) AS signal_value, min({value}) AS signal_min, max({value}) AS signal_max,
  CAST(count(*) AS INT) AS sample_count, bool_or({value} IS NULL) AS collection_gap, CAST(step AS INT) AS step_seconds FROM sig GROUP BY time_bucket, country_code, datasource, step)"""


CHANGES = """hr AS (SELECT date_trunc('hour', time_bucket) AS time_window, country_code, datasource, avg(signal_value) AS a FROM buckets GROUP BY ALL),
bl AS (SELECT *, avg(a) OVER (PARTITION BY country_code, datasource ORDER BY CAST(epoch(time_window) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS b FROM hr),
pc AS (SELECT time_window, country_code, avg(CASE WHEN datasource = 'bgp' AND b > 0 THEN (a - b) / b END) AS bgp_pct_change, avg(CASE WHEN datasource = 'merit-nt' AND b > 0 THEN (a - b) / b END) AS merit_pct_change,
  avg(CASE WHEN datasource = 'ping-slash24' AND b > 0 THEN (a - b) / b END) AS ping_pct_change FROM bl GROUP BY ALL)"""
EVIDENCE = """rc AS (SELECT time_window, country_code, quantile_disc(loss_p95_pct, 0.95) AS ripe_loss_p95, quantile_disc(rtt_p90_ms, 0.9) AS ripe_rtt_p90_ms, CAST(sum(probe_count) AS INT) AS ripe_probe_count,
  CAST(count(DISTINCT asn) FILTER (loss_p95_pct > 0.10::DOUBLE) AS INT) AS ripe_asn_affected FROM base GROUP BY ALL)"""
EVIDENCE_RAW = """rc AS (SELECT time_window, country_code, quantile_disc(packet_loss, 0.95) AS ripe_loss_p95, quantile_disc(rtt_avg_ms, 0.9) AS ripe_rtt_p90_ms, CAST(count(DISTINCT probe) AS INT) AS ripe_probe_count,
  CAST(count(DISTINCT asn) FILTER (packet_loss > 0.10::DOUBLE) AS INT) AS ripe_asn_affected FROM meas WHERE rtt_avg_ms > 0 AND packet_loss IS NOT NULL GROUP BY ALL)"""
SCORE = """(CASE WHEN ripe_loss_p95 > 0.20::DOUBLE THEN 1.0 WHEN ripe_loss_p95 > 0.10::DOUBLE THEN 0.5 ELSE 0.0 END)::DOUBLE * 0.35::DOUBLE
  + (CASE WHEN bgp_pct_change < -0.05::DOUBLE THEN 1 ELSE 0 END)::DOUBLE * 0.35::DOUBLE + (CASE WHEN merit_pct_change < -0.10::DOUBLE THEN 1 ELSE 0 END)::DOUBLE * 0.20::DOUBLE
  + (CASE WHEN ping_pct_change < -0.10::DOUBLE THEN 1 ELSE 0 END)::DOUBLE * 0.10::DOUBLE"""
LABEL = """CASE WHEN confidence_score >= 0.70::DOUBLE THEN 'hard_outage' WHEN confidence_score >= 0.45::DOUBLE THEN 'degraded' WHEN confidence_score >= 0.20::DOUBLE THEN 'possible' ELSE 'noise' END"""
OUTAGES = f"""outages AS (SELECT time_window AS detected_at, country_code, ripe_loss_p95, ripe_rtt_p90_ms, ripe_probe_count, ripe_asn_affected, bgp_pct_change, merit_pct_change, ping_pct_change, confidence_score, {LABEL} AS severity
  FROM (SELECT *, {SCORE} AS confidence_score FROM rc JOIN pc USING (time_window, country_code)) WHERE confidence_score >= 0.20::DOUBLE)"""
NAMES = "asn_names AS (SELECT CAST(64512 + n_nationkey AS INT) AS asn, n_name AS name FROM nation)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def outages_sql(evidence: str = EVIDENCE) -> str:
    return with_(EV, MEAS, SIG, BASE, buckets_sql(), evidence, CHANGES, OUTAGES)
