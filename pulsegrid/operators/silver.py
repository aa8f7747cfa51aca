"""Raw records to typed, clean rows. Each transform takes a batch or a stream and ends with an explicit select."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators.frames import ensure, first_of_each

LINEAGE = ["kafka_topic", "kafka_partition", "kafka_offset", "kafka_ts"]


def entity_type() -> Column:
    return F.upper(F.coalesce("entity.type", "entityType"))


def entity_code() -> Column:
    return F.upper(F.coalesce("entity.code", "entityCode"))


def _variants(df: DataFrame) -> DataFrame:
    """df with every spelling of the variant fields, absent ones null."""
    return ensure(df, entity="struct<type: string, code: string, name: string>", entityType="string", entityCode="string", time="bigint", **{"from": "bigint"}, until="bigint", historyValue="double", historicalValue="double", score="double", overallScore="double", alerts="string")


def _lineage(df: DataFrame) -> list[str]:
    return [c for c in LINEAGE if c in df.columns]


def on_day(df: DataFrame, day: dt.date, column: str = "ts_utc") -> DataFrame:
    """Rows from the start of the day to before the next."""
    return df.where((F.col(column) >= F.lit(day).cast("timestamp")) & (F.col(column) < F.lit(day + dt.timedelta(days=1)).cast("timestamp")))


def between_epochs(df: DataFrame, first: int, last: int, column: str = "ts_utc") -> DataFrame:
    """Rows of the closed range of whole seconds [first, last]."""
    return df.where(F.unix_timestamp(column).between(first, last))


def pings(raw: DataFrame) -> DataFrame:
    """Ping results: hashed probe, means from the scalars or else the packets, loss, and day; personal columns go."""
    raw = ensure(raw, asn="int", country_code="string", err="string", af="int", step="int", dup="int", mver="string", type="string")
    packets = raw.withColumns({"__rtts": C.rtts(F.col("result")), "ts_utc": F.timestamp_seconds("timestamp"), "sent": F.col("sent").cast("double"), "rcvd": F.col("rcvd").cast("double")})
    avg, low, high = (F.col(c).cast("double") for c in ("avg", "min", "max"))
    return packets.where("prb_id IS NOT NULL AND timestamp IS NOT NULL").select(
        "msm_id",
        C.pii_hash(F.col("prb_id")).alias("probe_id_hash"),
        F.upper("country_code").alias("country_code"),
        "asn",
        "ts_utc",
        "timestamp",
        "fw",
        C.firmware_generation(F.col("fw")).alias("fw_gen"),
        "mver",
        "af",
        "proto",
        "dst_name",
        "step",
        F.coalesce(avg, C.array_mean(F.col("__rtts"))).alias("rtt_avg_ms"),
        F.coalesce(low, F.array_min("__rtts")).alias("rtt_min_ms"),
        F.coalesce(high, F.array_max("__rtts")).alias("rtt_max_ms"),
        F.col("sent").alias("pkt_sent"),
        F.col("rcvd").alias("pkt_rcvd"),
        F.col("dup").alias("pkt_dup"),
        C.packet_loss(F.col("sent"), F.col("rcvd")).alias("packet_loss"),
        C.icmp_filtered(F.col("sent"), F.col("rcvd"), avg).alias("icmp_filtered"),
        F.size("result").alias("pkt_result_count"),
        F.col("err").isNotNull().alias("has_error"),
        *_lineage(raw),
        *(c.alias(k) for k, c in C.day_parts(F.col("ts_utc")).items()),
    )


def alerts(raw: DataFrame) -> DataFrame:
    raw = _variants(raw)
    since = F.timestamp_seconds(F.coalesce("time", "from"))
    history = F.coalesce("historyValue", "historicalValue").cast("double")
    return raw.select(
        since.alias("ts_from"),
        F.timestamp_seconds("until").alias("ts_until"),
        entity_type().alias("entity_type"),
        entity_code().alias("entity_code"),
        F.lower("datasource").alias("datasource"),
        F.col("value").cast("double").alias("alert_value"),
        history.alias("historical_value"),
        C.deviation_pct(F.col("value"), history).alias("deviation_pct"),
        "condition",
        "level",
        "method",
        *_lineage(raw),
        *(c.alias(k) for k, c in C.day_parts(since).items()),
    ).where("entity_code IS NOT NULL AND ts_from IS NOT NULL")


def events(raw: DataFrame) -> DataFrame:
    """Outage events; `alerts`, a JSON text, tells which sources fired."""
    raw = _variants(raw)
    start = F.coalesce("from", "time")
    since = F.timestamp_seconds(start)
    fired = {f"{name}_fired": datasource for name, datasource in (("bgp", "bgp"), ("ping", "ping-slash24"), ("ucsd", "ucsd-nt"), ("merit_nt", "merit-nt"))}
    parsed = raw.withColumn("__sources", F.from_json("alerts", "array<struct<datasource: string, level: string>>")["datasource"])
    flags = {k: F.coalesce(F.array_contains("__sources", v), F.lit(False)) for k, v in fired.items()}
    return parsed.select(
        entity_type().alias("entity_type"),
        entity_code().alias("entity_code"),
        F.col("entity.name").alias("entity_name"),
        since.alias("ts_from"),
        F.timestamp_seconds("until").alias("ts_until"),
        (F.col("until") - start).alias("duration_sec"),
        F.round((F.col("until") - start) / 60, 1).alias("duration_minutes"),
        F.coalesce("score", "overallScore").cast("double").alias("score"),
        "datasource",
        "method",
        *(c.alias(k) for k, c in flags.items()),
        sum((c.cast("int") for c in flags.values()), F.lit(0)).alias("datasource_count"),
        *_lineage(raw),
        *(c.alias(k) for k, c in C.day_parts(since).items()),
    ).where("entity_code IS NOT NULL AND ts_from IS NOT NULL")


def signals(raw: DataFrame) -> DataFrame:
    ts = F.timestamp_seconds("ts")
    return raw.where("entityCode IS NOT NULL AND ts IS NOT NULL").select(
        "ts",
        ts.alias("ts_utc"),
        F.upper("entityType").alias("entity_type"),
        F.upper("entityCode").alias("entity_code"),
        F.lower("datasource").alias("datasource"),
        F.col("value").cast("double").alias("value"),
        "step",
        "nativeStep",
        F.col("value").isNull().alias("collection_gap"),
        *_lineage(raw),
        *(c.alias(k) for k, c in C.day_parts(ts).items()),
    )


#: What makes a row of each kind unique.
DEDUP = {
    "pings": ["msm_id", "probe_id_hash", "timestamp"],
    "alerts": ["entity_type", "entity_code", "datasource", "ts_from"],
    "events": ["entity_code", "ts_from", "ts_until"],
    "signals": ["entity_type", "entity_code", "datasource", "ts"],
}


def dedup(df: DataFrame, kind: str) -> DataFrame:
    return first_of_each(df, *DEDUP[kind])


def expand_series(series: DataFrame, default_step: int = 60) -> DataFrame:
    """Compact signals (from, step, values) to a row for each value; null values stay, empty arrays give none."""
    step = F.coalesce("step", F.lit(default_step))
    return series.select("entityType", "entityCode", "datasource", F.col("from").alias("__from"), step.alias("step"), F.coalesce("nativeStep", step).alias("nativeStep"), F.posexplode("values").alias("__i", "value")).select(
        "entityType", "entityCode", "datasource", (F.col("__from") + F.col("__i") * F.col("step")).alias("ts"), "value", "step", "nativeStep"
    )


def enrich(raw: DataFrame, probes: DataFrame, key: str = "prb_id") -> DataFrame:
    """Measurements of known probes, with country and ASN. Spark broadcasts the map where it's small."""
    known = probes.select(F.col("prb_id").alias(key), F.col("country_code").alias("__country"), F.col("asn").alias("__asn"))
    return raw.drop("country_code", "asn").join(known, key).withColumnsRenamed({"__country": "country_code", "__asn": "asn"})
