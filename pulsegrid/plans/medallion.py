"""Whole jobs over a folder of raw, refined and aggregated tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import gold, silver, tables, versions
from pulsegrid.schemas import ALERT, EVENT, KEYS, PING, SIGNAL, with_corrupt
from pulsegrid.sources.files import CORRUPT
from pulsegrid.streaming import jobs

#: Raw schema, transform and event-time column of each kind.
KINDS = {"pings": (PING, silver.pings, "ts_utc"), "signals": (SIGNAL, silver.signals, "ts_utc"), "alerts": (ALERT, silver.alerts, "ts_from"), "events": (EVENT, silver.events, "ts_from")}
GOLD = ("baselines", "signals", "outages", "coverage")
#: Copies of polls that overlap come within this time.
POLLED = "1 hour"


@dataclass
class Layout:
    """Paths: raw lines in bronze/<kind>/year=/month=/day=, refined rows in silver/<kind>, aggregates in gold/<name>."""

    root: str

    def bronze(self, kind: str) -> str:
        return f"{self.root}/bronze/{kind}"

    def silver(self, kind: str) -> str:
        return f"{self.root}/silver/{kind}"

    def gold(self, name: str) -> str:
        return f"{self.root}/gold/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"


def bronze(spark: SparkSession, at: Layout, kind: str, since: dt.date | None, until: dt.date | None) -> DataFrame | None:
    """Raw rows of files of the days [since, until] (a file's day is that of its arrival, so the day after is read too),
    malformed lines left out; None where there are none."""
    if not tables.exists(spark, at.bronze(kind)):
        return None
    schema = KINDS[kind][0]
    lines = spark.read.text(at.bronze(kind))
    if since is not None and until is not None:
        lines = lines.where(tables.day_range(since, until + dt.timedelta(days=1)))
    row = F.from_json("value", with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.where(F.trim("value") != "").select(row.alias("r"))
    return rows.where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)


def refine(spark: SparkSession, at: Layout, kind: str, since: dt.date | None = None, until: dt.date | None = None) -> bool:
    """Raw to refined rows of the event days [since, until), replaced whole; without a range all days. False without raw rows.

    All days are one job. Rows of other days in the files are left to their own days' runs.
    """
    raw = bronze(spark, at, kind, since, until)
    if raw is None:
        return False
    _, transform, time = KINDS[kind]
    rows = transform(raw)
    if since is not None and until is not None:
        rows = rows.where((F.col(time) >= F.lit(since).cast("timestamp")) & (F.col(time) < F.lit(until).cast("timestamp")))
    tables.overwrite(silver.dedup(rows, kind), at.silver(kind))
    return True


def _refined(spark: SparkSession, at: Layout, kind: str, since, until) -> DataFrame | None:
    where = tables.day_range(since, until) if since is not None and until is not None else None
    return tables.read(spark, at.silver(kind), where=where) if tables.exists(spark, at.silver(kind)) else None


def aggregate(spark: SparkSession, at: Layout, names=GOLD, since: dt.date | None = None, until: dt.date | None = None, retract: bool = False) -> dict[str, int]:
    """Builds aggregates of [since, until), or of all days; gives the number of rows of each.

    retract: outages of the range that are no longer found go, instead of staying as they were. Sketches of baselines are
    replaced; streams add to them, so that a stream over the same refined rows should have read them all before.
    """
    done: dict[str, int] = {}
    pings, signals = (_refined(spark, at, k, since, until) for k in ("pings", "signals"))
    if "baselines" in names and pings is not None:
        tables.upsert(gold.baseline_sketches(pings), at.gold("sketches"), KEYS["baselines"], day="time_window")
        within = [versions.day(r[0]) for r in pings.select(F.to_date("ts_utc")).distinct().collect()]  # a row for each day
        done["baselines"] = tables.upsert(gold.from_sketches(versions.read(spark, at.gold("sketches"), days=within)), at.gold("baselines"), KEYS["baselines"], day="time_window")
    if "signals" in names and signals is not None:
        done["signals"] = tables.upsert(gold.signal_buckets(signals), at.gold("signals"), KEYS["signals"], day="time_bucket", keep=["step_seconds"])
    if "outages" in names and tables.exists(spark, at.gold("baselines")) and tables.exists(spark, at.gold("signals")):
        base, buckets = tables.read(spark, at.gold("baselines")), tables.read(spark, at.gold("signals"))
        low, high = (None if d is None else dt.datetime(d.year, d.month, d.day) for d in (since, until))
        if since is not None:
            base, buckets = base.where(F.col("__day") >= F.lit(since)), buckets.where(F.col("__day") >= F.lit(since - dt.timedelta(days=1)))
        found = gold.outage_events(base, buckets, low, high)
        done["outages"] = tables.upsert(found, at.gold("outages"), KEYS["outages"], day="detected_at", retract=F.lit(True) if retract else None, span=(since, until))
    if "coverage" in names and pings is not None and signals is not None:
        done["coverage"] = tables.upsert(gold.coverage(pings, signals), at.gold("coverage"), KEYS["coverage"], day="coverage_date")
    return done


def reports(spark: SparkSession, at: Layout) -> dict[str, DataFrame]:
    """Quality reports of what refined tables there are."""
    out = {}
    alerts, events, signals = (_refined(spark, at, k, None, None) for k in ("alerts", "events", "signals"))
    if alerts is not None:
        out["alerts"] = gold.alert_report(alerts)
    if events is not None:
        out["events"] = gold.event_report(events)
    if signals is not None:
        out["signals"] = gold.signal_report(gold.trailing_nulls(gold.z_scores(signals)))
        out["steps"] = gold.step_census(signals)
    return out


def stream_gold(spark: SparkSession, at: Layout, every: str | None = jobs.GOLD_TRIGGER) -> dict:
    """Streams over refined pings and signals that keep the aggregates; a table that isn't there yet is left out."""

    def start(kind: str, handlers):
        df = jobs.files(spark, at.silver(kind))
        return None if df is None else jobs.each_batch(df, handlers, at.checkpoint(f"gold_{kind}"), f"gold_{kind}", every)

    pings = [jobs.baseline_handler(at.gold("sketches"), at.gold("baselines")), jobs.outage_handler(at.gold("baselines"), at.gold("signals"), at.gold("outages"))]
    return jobs.start_all(spark, {"signals": lambda: start("signals", [jobs.signal_handler(at.silver("signals"), at.gold("signals"))]), "pings": lambda: start("pings", pings)})


def stream_silver(spark: SparkSession, at: Layout, servers: str, topics: dict[str, str], every: str | None = jobs.SILVER_TRIGGER) -> dict:
    """A stream for each kind's topic into the refined tables. Pings are pushed, so that each is a reading of its own; the other kinds
    are polled by ranges that overlap, whose copies go in the stream."""
    from pulsegrid.sources.network import kafka

    def start(kind: str, topic: str):
        rows = jobs.refined(jobs.payload(kafka(spark, servers, topic), KINDS[kind][0]), kind, late=None if kind == "pings" else POLLED)
        return jobs.append(rows, at.silver(kind), at.checkpoint(f"silver_{kind}"), f"silver_{kind}", every)

    return jobs.start_all(spark, {k: lambda k=k, t=t: start(k, t) for k, t in topics.items()})
