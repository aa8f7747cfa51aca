"""The queries that a dashboard asks of the aggregated tables. Time ranges are half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators.frames import matched, running
from pulsegrid.operators.workspace import folder

LEAST = 3
OUTAGE_LABELS = ("hard_outage", "degraded")


def between(column: str, since, until) -> Column:
    return (F.col(column) >= F.lit(since)) & (F.col(column) < F.lit(until))


def countries(base: DataFrame) -> DataFrame:
    return base.select("country_code").distinct().orderBy("country_code")


def asns(base: DataFrame) -> DataFrame:
    return base.select("asn").where("asn IS NOT NULL").distinct().orderBy("asn")


def named(base: DataFrame, names: DataFrame) -> DataFrame:
    """base with `provider`: the ASN's name, or its number where it has none."""
    return base.join(names.select("asn", F.col("name").alias("__name")), "asn", "left").withColumn("provider", C.name_or_number(F.col("__name"), F.col("asn"))).drop("__name")


def usable(base: DataFrame, since, until, country: str | None = None) -> DataFrame:
    out = base.where(between("time_window", since, until) & (F.col("rtt_median_ms") > 0) & (F.col("total_measurements") >= LEAST))
    return out if country is None else out.where(F.col("country_code") == country)


def outage_list(outages: DataFrame, country: str, since, until) -> DataFrame:
    return outages.where((F.col("country_code") == country) & between("detected_at", since, until)).orderBy(F.desc("detected_at"))


def baseline_series(base: DataFrame, names: DataFrame, country: str, since, until) -> DataFrame:
    return named(usable(base, since, until, country), names).orderBy("time_window", "asn")


def signal_series(buckets: DataFrame, country: str, since, until) -> DataFrame:
    """The native-step series; tables of an older form call the time `time_window` and lack gaps and steps."""
    if "time_bucket" not in buckets.columns:
        buckets = buckets.withColumnRenamed("time_window", "time_bucket")
    found = buckets.where((F.col("country_code") == country) & between("time_bucket", since, until))
    keep = [c for c in ("time_bucket", "datasource", "signal_value", "sample_count", "collection_gap", "step_seconds") if c in found.columns]
    return found.select(*keep).orderBy("time_bucket", "datasource")


def country_summary(base: DataFrame, outages: DataFrame, since, until, fanout: bool = False) -> DataFrame:
    """A row for each country. Outages are counted before the join, so that measurements aren't multiplied by them; with
    fanout they are, as in a plain join."""
    rows = base.where(between("time_window", since, until) & (F.col("rtt_median_ms") > 0))
    bad = outages.where(between("detected_at", since, until) & F.col("severity").isin(*OUTAGE_LABELS))
    events = bad.groupBy("country_code").agg(F.count_distinct("detected_at").alias("outage_hours"), F.max(F.struct(C.severity_ordinal(F.col("severity")).alias("rank"), "severity")).alias("worst"), F.count("*").alias("times"))
    stats = rows.groupBy("country_code").agg(
        C.half_up(F.avg("rtt_median_ms"), 2).alias("avg_rtt"), C.half_up(F.max("rtt_p90_ms"), 2).alias("max_p90"), C.half_up(F.avg("loss_median_pct") * 100, 3).alias("avg_loss"), F.count_distinct("asn").alias("providers"), F.sum("total_measurements").alias("total")
    )
    times = F.greatest(F.coalesce("times", F.lit(1)), F.lit(1)) if fanout else F.lit(1)
    out = stats.join(events, "country_code", "left").select("country_code", "avg_rtt", "max_p90", "avg_loss", "providers", (F.col("total") * times).cast("long").alias("total"), F.coalesce("outage_hours", F.lit(0)).alias("outage_hours"), F.col("worst.severity").alias("worst_severity"))
    return out.orderBy(F.desc_nulls_first("outage_hours"), F.desc_nulls_first("avg_loss"), "country_code")


def provider_consistency(base: DataFrame, names: DataFrame, since, until, country: str | None = None) -> DataFrame:
    found = named(usable(base, since, until, country), names).groupBy("asn", "provider").agg(
        C.half_up(F.avg("rtt_median_ms"), 2).alias("avg_rtt"),
        C.half_up(F.stddev("rtt_median_ms"), 2).alias("std_rtt"),
        C.half_up(F.avg("loss_median_pct") * 100, 3).alias("avg_loss"),
        C.half_up(F.max("loss_p95_pct") * 100, 3).alias("max_loss"),
        F.sum("total_measurements").alias("total"),
        F.sum("probe_count").alias("probes"),
        F.count("*").alias("n_hours"),
    )
    return found.where(F.col("n_hours") >= LEAST).orderBy("avg_rtt", "asn")


def top_providers(consistency: DataFrame, n: int = 10) -> DataFrame:
    return consistency.orderBy("avg_rtt", "asn").limit(n)


def medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, name: the exact median of each group's values, null where there's none.

    A median function holds a group's values in one buffer. Here approximate percentiles a little under and over the middle, which are
    bounded in memory, tell where it lies; rows below are counted, and only what lies between, a thousandth of the rows, is
    counted by value and put in order, over all groups at once and by ranges.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__x"))
    near = F.percentile_approx("__x", F.lit([0.4995, 0.5005]), F.lit(10_000))
    path = folder(df.sparkSession, "bounds")
    rows.groupBy(*by).agg(near.alias("__near"), F.count("__x").alias("__n")).write.parquet(path)
    bounds = df.sparkSession.read.parquet(path)  # of known size, so that rows needn't be dealt by group, which few groups would make large
    both = matched(rows.where("__x IS NOT NULL"), bounds, by) if by else rows.where("__x IS NOT NULL").join(bounds, F.lit(True))
    low, high = F.element_at("__near", 1), F.element_at("__near", 2)
    found = both.where(F.col("__x") <= high).groupBy(*by, F.when(F.col("__x") >= low, F.col("__x")).alias("__x")).agg(F.count("*").alias("__times"), F.first("__n").alias("__n"))
    placed = running(found, [*by, F.col("__x").asc_nulls_first()], "__at", "__times")
    start = placed.groupBy(*by).agg(F.min("__at").alias("__start"))
    placed = matched(placed, start, by) if by else placed.join(start, F.lit(True))
    first, n = F.col("__at") - F.col("__start"), F.col("__n")
    at = lambda rank: F.max(F.when((first <= rank) & (rank < first + F.col("__times")), F.col("__x")))
    middle = placed.groupBy(*by).agg(((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias(name))
    return matched(bounds.select(*by), middle, by) if by else middle


def heatmap(base: DataFrame) -> DataFrame:
    """Exact median by day and hour of day."""
    return medians(base.select(F.to_date("time_window").alias("day"), F.hour("time_window").alias("hour"), "rtt_median_ms"), ["day", "hour"], "rtt_median_ms", "rtt")


def hourly_overlay(base: DataFrame) -> DataFrame:
    return base.groupBy("time_window").agg(F.avg("rtt_median_ms").alias("avg_rtt"), F.avg("loss_median_pct").alias("avg_loss"))


def country_medians(base: DataFrame, *countries: str) -> DataFrame:
    rows = base.where(F.col("country_code").isin(*countries)) if countries else base
    return medians(rows, ["time_window", "country_code"], "rtt_median_ms", "rtt")


def kpis(base: DataFrame, outages: DataFrame) -> DataFrame:
    """One row: median latency, mean loss in percent, providers, measurements, outages."""
    middle = medians(base, [], "rtt_median_ms", "median_rtt").withColumn("k", F.lit(0))
    a = base.agg((F.avg("loss_median_pct") * 100).alias("loss_pct"), F.count_distinct("asn").alias("providers"), F.sum("total_measurements").alias("measurements")).withColumn("k", F.lit(0))
    b = outages.agg(F.count("*").alias("outages")).withColumn("k", F.lit(0))
    return middle.join(a, "k").join(b, "k").drop("k")


def recent_tail(base: DataFrame, n: int = 24) -> DataFrame:
    """Over the last n rows (not hours)."""
    tail = base.orderBy(F.desc("time_window"), "country_code", "asn").limit(n)
    return tail.agg(F.median("rtt_median_ms").alias("median_rtt"), F.avg("loss_median_pct").alias("avg_loss"), F.count("*").alias("n"))


def normalized(buckets: DataFrame, *series: str) -> DataFrame:
    """Values as a percentage of their series' maximum; series without a positive one are left out.

    The maxima are aggregated and joined, since a series may be long.
    """
    top = buckets.groupBy(*series).agg(F.max("signal_value").alias("top")).where("top > 0")
    return buckets.join(top, list(series)).withColumn("pct_of_max", F.col("signal_value") / F.col("top") * 100).drop("top")


def severity_counts(outages: DataFrame) -> DataFrame:
    return outages.groupBy("country_code").agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("hard_outage", "degraded", "possible")))


def severity_bars(summary: DataFrame) -> DataFrame:
    """Label, ordinal and bar length for each country of the summary."""
    label = F.coalesce("worst_severity", F.lit("none"))
    return summary.select("country_code", label.alias("label"), C.severity_ordinal(label).alias("ordinal"), F.least(F.col("outage_hours") + 1, F.lit(100)).alias("bar"))


def ranked(summary: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """country_code, value and rank by a column, ties by code; only ranks up to n where it's given. Rows are counted by ranges of the
    order, not in one window."""
    rows = summary.select("country_code", F.col(by).alias("value"))
    out = running(rows, [F.desc_nulls_last("value"), F.col("country_code")], "__before").select("country_code", "value", (F.col("__before") + 1).cast("int").alias("rank"))
    return out if n is None else out.where(F.col("rank") <= n)
