"""Structured Streaming: the batch transforms over streams, and micro-batch handlers that keep aggregated tables."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pulsegrid.operators import gold, silver, tables, versions
from pulsegrid.schemas import KEYS

SILVER_TRIGGER, GOLD_TRIGGER = "2 minutes", "5 minutes"
#: Hours of signal that the outage handler reads before a batch's first hour.
LOOKBACK_HOURS = 24


def files(spark: SparkSession, path: str, schema: StructType | None = None, most: int = 4) -> DataFrame | None:
    """A stream of a Parquet table's new files; without a schema that of the files there, or None where there are none."""
    if schema is None:
        try:
            schema = spark.read.parquet(path).schema
        except AnalysisException:
            return None
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(path)


def payload(envelope: DataFrame, schema: StructType) -> DataFrame:
    """The JSON values of a message stream as columns, with where each came from."""
    data = F.from_json(F.col("value").cast("string"), schema)
    return envelope.select(F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_ts"), data.alias("data")).select("kafka_topic", "kafka_partition", "kafka_offset", "kafka_ts", "data.*")


def messages(rows: DataFrame, topic: str) -> DataFrame:
    """Rows as what a message sink takes: JSON values, for one topic, which `payload` reads back."""
    return rows.select(F.lit(topic).alias("topic"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).cast("binary").alias("value"))


#: Transform and event-time column of each kind of record.
KINDS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {"pings": (silver.pings, "ts_utc"), "alerts": (silver.alerts, "ts_from"), "events": (silver.events, "ts_from"), "signals": (silver.signals, "ts_utc")}


def refined(raw: DataFrame, kind: str, late: str | None = None, now: Column | None = None) -> DataFrame:
    """The stream of refined rows. Every message counts; polls that overlap give copies.

    With `late` (such as "1 hour") copies that arrive within that time of each other are dropped by silver.DEDUP, in a state store that
    forgets what arrived twice as long ago. What had waited for longer than that before it was read, or came with no time of
    arrival, isn't compared with the store, where its copy may be forgotten, nor lost: it stays, with True in column `late`, and readers
    drop copies by silver.dedup. now: the clock, by default that of the batch.
    """
    transform, _ = KINDS[kind]
    out = transform(raw)
    if late is None:
        return out
    span = F.expr(f"INTERVAL {late}")
    behind = F.coalesce(F.col("kafka_ts") < (F.current_timestamp() if now is None else now) - span, F.lit(True))
    number, unit = late.split()
    kept = out.where(~behind).withWatermark("kafka_ts", f"{2 * int(number)} {unit}").dropDuplicatesWithinWatermark(silver.DEDUP[kind])
    return kept.withColumn("late", F.lit(False)).unionByName(out.where(behind).withColumn("late", F.lit(True)))


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def append(df: DataFrame, path: str, checkpoint: str, name: str, every: str | None = SILVER_TRIGGER, by: Iterable[str] = tables.DAY) -> StreamingQuery:
    """Appends to a partitioned table; every=None takes what is there and ends."""
    w = df.writeStream.queryName(name).outputMode("append").format("parquet").partitionBy(*by).option("path", path).option("checkpointLocation", checkpoint)
    return _trigger(w, every).start()


def each_batch(df: DataFrame, handlers: Iterable[Callable[[DataFrame, int], None]], checkpoint: str, name: str, every: str | None = GOLD_TRIGGER) -> StreamingQuery:
    """Runs the handlers on every micro-batch in turn."""
    handlers = list(handlers)

    def run(batch: DataFrame, i: int) -> None:
        for h in handlers:
            h(batch, i)

    return _trigger(df.writeStream.queryName(name).foreachBatch(run).option("checkpointLocation", checkpoint), every).start()


def _touched(batch: DataFrame, time: str) -> DataFrame:
    """The hours that a batch has rows of."""
    return batch.select(F.date_trunc("hour", time).alias("__hour")).distinct()


def _again(batch: DataFrame, silver_path: str) -> DataFrame | None:
    """All refined rows of the hours that a batch touches; only the partitions of the batch's days are read."""
    rows = tables.read(batch.sparkSession, silver_path)
    span = batch.agg(F.to_date(F.min("ts_utc")).alias("low"), F.to_date(F.max("ts_utc")).alias("high")).first()
    if rows is None or span.low is None:
        return None
    rows = rows.where(tables.day_range(span.low, span.high + dt.timedelta(days=1)))
    hours = _touched(batch, "ts_utc")
    return rows.join(hours, F.date_trunc("hour", rows["ts_utc"]) == hours["__hour"], "left_semi")


def _writer(batch: DataFrame, name: str) -> str:
    """A name for the ledger of a versioned table: a stream's id lives as long as its checkpoint, and so do its batches' numbers."""
    return f"{name}:{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}"


def baseline_handler(sketch_path: str, gold_path: str) -> Callable[[DataFrame, int], None]:
    """Adds a batch to the sketches of its hours, and writes the baselines that these stand for. Rows of earlier batches aren't read
    again. A batch that runs twice is added once; the baselines, from what the sketches are, may be written again."""

    def run(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        tables.upsert(gold.baseline_sketches(batch), sketch_path, KEYS["baselines"], day="time_window", batch=(_writer(batch, "sketches"), i), combine=gold.merge_sketches)
        days = [versions.day(r[0]) for r in batch.select(F.to_date("ts_utc")).distinct().collect()]  # a row for each day
        sketches, hours = versions.read(spark, sketch_path, days=days), _touched(batch, "ts_utc")
        tables.upsert(gold.from_sketches(sketches.join(hours, sketches["time_window"] == hours["__hour"], "left_semi")), gold_path, KEYS["baselines"], day="time_window")

    return run


def signal_handler(silver_path: str, gold_path: str) -> Callable[[DataFrame, int], None]:
    """Buckets of touched hours, again from all refined rows, each of which counts; the step of a bucket that is there already
    stays."""

    def run(batch: DataFrame, _: int) -> None:
        rows = _again(batch, silver_path)
        if rows is not None:
            tables.upsert(gold.signal_buckets(rows), gold_path, KEYS["signals"], day="time_bucket", keep=["step_seconds"])

    return run


def outage_handler(base_path: str, buckets_path: str, gold_path: str) -> Callable[[DataFrame, int], None]:
    """Scores the hours that a batch touches, from the aggregated tables, with a whole trailing window before each."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        base, buckets = tables.read(spark, base_path), tables.read(spark, buckets_path)
        span = batch.agg(F.date_trunc("hour", F.min("ts_utc")).alias("low"), F.date_trunc("hour", F.max("ts_utc")).alias("high"), F.to_date(F.min("ts_utc")).alias("first"), F.to_date(F.max("ts_utc")).alias("last")).first()
        if base is None or buckets is None or span.low is None:
            return
        until = F.lit(span.high) + F.expr("INTERVAL 1 HOUR")
        days = (F.col("__day") >= F.lit(span.first - dt.timedelta(days=1))) & (F.col("__day") <= F.lit(span.last))  # partitions
        buckets = buckets.where(days & (F.col("time_bucket") >= F.lit(span.low) - F.expr(f"INTERVAL {LOOKBACK_HOURS} HOURS")) & (F.col("time_bucket") < until))
        base = base.where(days & (F.col("time_window") >= F.lit(span.low)) & (F.col("time_window") < until))
        hours = _touched(batch, "ts_utc")
        found = gold.outages(gold.loss_evidence_batch(base), gold.signal_changes(buckets))
        tables.upsert(found.join(hours, found["detected_at"] == hours["__hour"], "left_semi"), gold_path, KEYS["outages"], day="detected_at")

    return run


def raw_sink(path: str, time: str = "timestamp", servers: str | None = None, topic: str | None = None) -> Callable[[DataFrame, int], None]:
    """Writes each batch as compressed JSON lines by event day, and to a message topic first where servers are given. Batches
    without rows write nothing; time is a column of epoch seconds.

    Files are written beside the table and then get names of their writer and batch: one that runs again, whatever it had written
    before, leaves its rows once. (A topic may get messages twice.)
    """

    def run(batch: DataFrame, i: int) -> None:
        if batch.isEmpty():
            return
        if servers:
            messages(batch, topic).write.format("kafka").option("kafka.bootstrap.servers", servers).save()
        day = F.timestamp_seconds(time)
        rows = batch.select(F.to_json(F.struct("*")).alias("value"), F.date_format(day, "yyyy").alias("year"), F.date_format(day, "MM").alias("month"), F.date_format(day, "dd").alias("day"))
        tag = f"{hashlib.sha256(_writer(batch, path).encode()).hexdigest()[:12]}-{i:010d}-"
        stage = f"{path.rstrip('/')}/_batch-{tag}files"  # readers pass over names of this kind
        rows.hint("rebalance", *tables.DAY).write.mode("overwrite").option("compression", "gzip").partitionBy(*tables.DAY).text(stage)
        tables.adopt(batch.sparkSession, stage, path, tag, len(tables.DAY))

    return run


def start_all(spark: SparkSession, starts: dict[str, Callable[[], StreamingQuery | None]]) -> dict[str, StreamingQuery]:
    """Starts independent queries; one whose source isn't there yet is left out, the others run."""
    out = {}
    for name, start in starts.items():
        query = start()
        if query is not None:
            out[name] = query
    return out


def stop_all(queries: dict[str, StreamingQuery]) -> None:
    for q in queries.values():
        if q.isActive:
            q.stop()


def reset(spark: SparkSession, checkpoint: str, *outputs: str) -> None:
    """Forgets what a stopped query has read: removes its checkpoint and the lists of committed files in its output folders, so
    that tables which a batch job has rewritten are read as they are. Sketches that the query has added to go with tables.remove."""
    tables.remove(spark, checkpoint)
    for path in outputs:
        tables.remove(spark, f"{path.rstrip('/')}/_spark_metadata")
