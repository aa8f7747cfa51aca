"""Schemas of raw, refined and aggregated tables. The raw ones hold old and new names of a field side by side."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES: dict[str, DataType] = {"int": IntegerType(), "bigint": LongType(), "string": StringType(), "double": DoubleType(), "binary": BinaryType(), "timestamp": TimestampType()}


def _struct(columns: str, **nested: DataType) -> StructType:
    """A schema from "name type, ..."; a type that isn't a simple one is given by its column's name. Needs no session."""
    pairs = (c.split() for c in columns.split(","))
    return StructType([StructField(n, nested[n] if n in nested else _TYPES[t]) for n, t in pairs])


PING = _struct(
    "fw int, mver string, af int, msm_id int, msm_name string, type string, prb_id int, timestamp bigint, proto string, dst_name string, dst_addr string, src_addr string, from string, "
    "step int, ttl int, size int, lts int, sent int, rcvd int, dup int, min double, max double, avg double, result array, err string, country_code string, asn int",
    result=ArrayType(_struct("rtt double, dup int, ttl int")),
)
_ENTITY = _struct("type string, code string, name string")
ALERT = _struct("entity struct, entityType string, entityCode string, datasource string, time bigint, from bigint, until bigint, value double, historyValue double, historicalValue double, condition string, level string, method string", entity=_ENTITY)
EVENT = _struct("entity struct, entityType string, entityCode string, datasource string, time bigint, from bigint, until bigint, score double, overallScore double, method string, id string, alerts string", entity=_ENTITY)
SIGNAL = _struct("entityType string, entityCode string, datasource string, ts bigint, value double, step int, nativeStep int")
SERIES = _struct("entityType string, entityCode string, datasource string, from bigint, until bigint, step int, nativeStep int, values array", values=ArrayType(DoubleType()))
PROBE = _struct("id int, asn_v4 int, country_code string")
ENVELOPE = _struct("key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp")

CORRUPT = "_corrupt_record"


def with_corrupt(schema: StructType) -> StructType:
    """The schema with a column that takes the text of malformed lines."""
    return StructType([*schema.fields]).add(CORRUPT, "string")


#: Keys of the aggregated tables.
KEYS = {
    "baselines": ["time_window", "country_code", "asn"],
    "signals": ["country_code", "datasource", "time_bucket"],
    "outages": ["detected_at", "country_code"],
    "asn_names": ["asn"],
    "coverage": ["coverage_date", "country_code", "source"],
}
