"""Aggregates over refined rows: hourly baselines, signal buckets, the outage model, coverage, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators.frames import matched, running

HOUR = 3600
#: Window of the signal baseline: the 24 hours before, the hour itself left out.
TRAILING = 24 * HOUR
#: Size of the sketches of percentiles: exact up to so many values of an hour, beyond that off by a rank in some 1,000. A group's
#: buffer has that many values from the start, which many small groups pay for.
SKETCH = 4096


def _known(pings: DataFrame, include_total_loss: bool) -> tuple[DataFrame, Column]:
    """Rows with a known loss, and their latency. Without include_total_loss rows without a positive mean latency, lost pings among
    them, are left out; with it they count for loss and numbers, and only the latencies leave them out."""
    known = pings.where("country_code IS NOT NULL AND asn IS NOT NULL AND packet_loss IS NOT NULL")
    rtt: Column = F.col("rtt_avg_ms")
    return (known, F.when(rtt > 0, rtt)) if include_total_loss else (known.where(rtt > 0), rtt)


def baselines(pings: DataFrame, include_total_loss: bool = False) -> DataFrame:
    """Hourly percentiles of latency and loss for each country and ASN.

    Distinct probes and measurements are gathered as sets, which an hour of an ASN has few of: counting two columns' distinct
    values would triple the rows and build percentiles for every one of those values first. Where hours have many, and for longer
    spans, see `id_bitmaps`.
    """
    known, rtt = _known(pings, include_total_loss)
    return known.groupBy(F.date_trunc("hour", "ts_utc").alias("time_window"), "country_code", "asn").agg(
        C.percentile(rtt, 0.1).alias("rtt_p10_ms"),
        C.percentile(rtt, 0.5).alias("rtt_median_ms"),
        C.percentile(rtt, 0.9).alias("rtt_p90_ms"),
        C.percentile("packet_loss", 0.5).alias("loss_median_pct"),
        C.percentile("packet_loss", 0.95).alias("loss_p95_pct"),
        F.count("*").cast("int").alias("total_measurements"),
        F.size(F.collect_set(F.unhex("probe_id_hash"))).alias("probe_count"),
        F.size(F.collect_set("msm_id")).alias("root_server_count"),
        F.sum(F.col("icmp_filtered").cast("int")).cast("int").alias("icmp_filtered_count"),
    )


def baseline_sketches(pings: DataFrame, include_total_loss: bool = False) -> DataFrame:
    """What the baselines of an hour, country and ASN are made of, in a form that `merge_sketches` can add to: quantile sketches of
    latency and loss, numbers, and the sets of probes and measurements."""
    known, rtt = _known(pings, include_total_loss)
    return known.groupBy(F.date_trunc("hour", "ts_utc").alias("time_window"), "country_code", "asn").agg(
        F.kll_sketch_agg_double(rtt, SKETCH).alias("rtt"),
        F.kll_sketch_agg_double("packet_loss", SKETCH).alias("loss"),
        F.count("*").alias("n"),
        F.collect_set(F.unhex("probe_id_hash")).alias("probes"),
        F.collect_set("msm_id").alias("servers"),
        F.sum(F.col("icmp_filtered").cast("long")).alias("filtered"),
    )


def merge_sketches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables of sketches as one; each has an hour, country and ASN once, so a group here has two rows at most."""
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    keys = [c for c in new.columns if c not in ("rtt", "loss", "n", "probes", "servers", "filtered")]
    both = old.unionByName(new).groupBy(*keys).agg(F.kll_merge_agg_double("rtt", SKETCH).alias("rtt"), F.kll_merge_agg_double("loss", SKETCH).alias("loss"), F.sum("n").alias("n"), union("probes"), union("servers"), F.sum("filtered").alias("filtered"))
    return both.select(*new.columns)


def from_sketches(sketches: DataFrame) -> DataFrame:
    """The baselines that sketches stand for."""
    at = lambda c, p: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(p)))
    return sketches.select(
        "time_window",
        "country_code",
        "asn",
        at("rtt", 0.1).alias("rtt_p10_ms"),
        at("rtt", 0.5).alias("rtt_median_ms"),
        at("rtt", 0.9).alias("rtt_p90_ms"),
        at("loss", 0.5).alias("loss_median_pct"),
        at("loss", 0.95).alias("loss_p95_pct"),
        F.col("n").cast("int").alias("total_measurements"),
        F.size("probes").alias("probe_count"),
        F.size("servers").alias("root_server_count"),
        F.col("filtered").cast("int").alias("icmp_filtered_count"),
    )


def id_bitmaps(rows: DataFrame, by: list[Column | str], id: str) -> DataFrame:
    """by, bucket, bitmap: which ids, numbered in order, a group has. A buffer is 4 KB whatever a group holds; `counted` gives
    exact numbers of distinct ids, of these groups or of any that they add up to. Null ids are none."""
    ids = running(rows.select(F.col(id).alias("__id")).where("__id IS NOT NULL").distinct(), [F.col("__id")], "__number")
    number = rows.select(*by, F.col(id).alias("__id")).join(ids, "__id")
    keys = [c for c in number.columns if c not in ("__id", "__number")]
    return number.groupBy(*keys, F.bitmap_bucket_number("__number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__number")).alias("bitmap"))


def counted(bitmaps: DataFrame, by: list[Column | str], name: str) -> DataFrame:
    """by, name: exact numbers of distinct ids, from bitmaps of these groups or of parts of them."""
    whole = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return whole.groupBy(*(c for c in whole.columns if c not in ("bucket", "bitmap"))).agg(F.sum(F.bitmap_count("bitmap")).alias(name))


def signal_buckets(signals: DataFrame, compat: bool = False) -> DataFrame:
    """Means of a signal over its steps; of several steps in a bucket the finest counts.

    A bucket with any gap, or without a value at all, is a gap. Rows without a positive step have no bucket.
    """
    epoch, step = F.unix_timestamp("ts_utc"), F.col("step")
    at = C.step_bucket_compat(epoch, step) if compat else C.step_bucket(epoch, step)
    found = (
        signals.where("entity_code IS NOT NULL AND step > 0")
        .groupBy(at.alias("time_bucket"), F.col("entity_code").alias("country_code"), "datasource", F.col("step").alias("step_seconds"))
        .agg(F.avg("value").alias("signal_value"), F.min("value").alias("signal_min"), F.max("value").alias("signal_max"), F.count("*").cast("int").alias("sample_count"), F.bool_or("collection_gap").alias("gap"))
    )
    rest = ["signal_value", "signal_min", "signal_max", "sample_count", "gap"]
    finest = found.groupBy("time_bucket", "country_code", "datasource").agg(F.min(F.struct("step_seconds", *rest)).alias("r"))
    return finest.select("time_bucket", "country_code", "datasource", "r.signal_value", "r.signal_min", "r.signal_max", "r.sample_count", (F.coalesce("r.gap", F.lit(False)) | F.col("r.signal_value").isNull()).alias("collection_gap"), "r.step_seconds")


def loss_evidence_batch(base: DataFrame, limit: float = C.LOSS_DEGRADED) -> DataFrame:
    """Country-hours from ASN-hours: percentiles over ASNs, and how many ASNs lost more than `limit`.

    One aggregation: affected ASNs are counted as a condition instead of by a join.
    """
    return base.groupBy("time_window", "country_code").agg(
        C.percentile("loss_p95_pct", 0.95).alias("ripe_loss_p95"),
        C.percentile("rtt_p90_ms", 0.9).alias("ripe_rtt_p90_ms"),
        F.sum("probe_count").cast("int").alias("ripe_probe_count"),
        F.count_distinct(F.when(F.col("loss_p95_pct") > limit, F.col("asn"))).cast("int").alias("ripe_asn_affected"),
    )


def loss_evidence_raw(pings: DataFrame, limit: float = C.LOSS_DEGRADED) -> DataFrame:
    """The same columns from single measurements, as the streaming job computes them."""
    known = pings.where("country_code IS NOT NULL AND asn IS NOT NULL AND rtt_avg_ms > 0 AND packet_loss IS NOT NULL")
    return known.groupBy(F.date_trunc("hour", "ts_utc").alias("time_window"), "country_code").agg(
        C.percentile("packet_loss", 0.95).alias("ripe_loss_p95"),
        C.percentile("rtt_avg_ms", 0.9).alias("ripe_rtt_p90_ms"),
        F.count_distinct("probe_id_hash").cast("int").alias("ripe_probe_count"),
        F.count_distinct(F.when(F.col("packet_loss") > limit, F.col("asn"))).cast("int").alias("ripe_asn_affected"),
    )


def signal_changes(buckets: DataFrame) -> DataFrame:
    """Hourly change of each datasource against its trailing mean, a column each."""
    hourly = buckets.groupBy(F.date_trunc("hour", "time_bucket").alias("time_window"), "country_code", "datasource").agg(F.avg("signal_value").alias("value"))
    w = Window.partitionBy("country_code", "datasource").orderBy(F.col("time_window").cast("long")).rangeBetween(-TRAILING, -1)
    change = hourly.withColumn("pct", C.pct_change(F.col("value"), F.avg("value").over(w)))
    of = lambda name: F.avg(F.when(F.col("datasource") == name, F.col("pct")))
    return change.groupBy("time_window", "country_code").agg(of("bgp").alias("bgp_pct_change"), of("merit-nt").alias("merit_pct_change"), of("ping-slash24").alias("ping_pct_change"))


def outages(evidence: DataFrame, changes: DataFrame) -> DataFrame:
    """Scored country-hours that both sources know, noise left out."""
    both = evidence.join(changes, ["time_window", "country_code"]).withColumn("confidence_score", C.confidence(F.col("ripe_loss_p95"), F.col("bgp_pct_change"), F.col("merit_pct_change"), F.col("ping_pct_change")))
    scored = both.withColumn("severity", C.severity(F.col("confidence_score"))).where("severity != 'noise'")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return scored.select(F.col("time_window").alias("detected_at"), "country_code", "ripe_loss_p95", "ripe_rtt_p90_ms", count("ripe_probe_count"), count("ripe_asn_affected"), "bgp_pct_change", "merit_pct_change", "ping_pct_change", "confidence_score", "severity")


def outage_events(base: DataFrame, buckets: DataFrame, since=None, until=None) -> DataFrame:
    """The outage model over baselines and signal buckets. With since or until, the signal is read from 24 hours before, so
    that the first hours have a whole window, and only hours within [since, until) are returned."""
    if since is not None:
        base = base.where(F.col("time_window") >= F.lit(since))
        buckets = buckets.where(F.col("time_bucket") >= F.lit(since) - F.expr("INTERVAL 24 HOURS"))
    if until is not None:
        base, buckets = base.where(F.col("time_window") < F.lit(until)), buckets.where(F.col("time_bucket") < F.lit(until))
    return outages(loss_evidence_batch(base), signal_changes(buckets))


def coverage(pings: DataFrame, signals: DataFrame) -> DataFrame:
    """Rows, distinct probes or datasources, and distinct ASNs by day, country and source."""
    by = lambda ts, code: [F.to_date(ts).alias("coverage_date"), F.col(code).alias("country_code")]
    a = pings.where("country_code IS NOT NULL").groupBy(*by("ts_utc", "country_code")).agg(F.count("*").cast("int").alias("measurement_count"), F.count_distinct("probe_id_hash").cast("int").alias("probe_count"), F.count_distinct("asn").cast("int").alias("asn_count")).withColumn("source", F.lit("ripe"))
    b = signals.where("entity_code IS NOT NULL").groupBy(*by("ts_utc", "entity_code")).agg(F.count("*").cast("int").alias("measurement_count"), F.count_distinct("datasource").cast("int").alias("probe_count")).withColumns({"asn_count": F.lit(None).cast("int"), "source": F.lit("ioda")})
    return a.unionByName(b).select("coverage_date", "country_code", "source", "measurement_count", "probe_count", "asn_count")


def rollup_hourly(buckets: DataFrame) -> DataFrame:
    """Hourly signals; the mean is that of the buckets' means, not weighted."""
    return buckets.groupBy(F.date_trunc("hour", "time_bucket").alias("hour"), "country_code", "datasource").agg(
        F.avg("signal_value").alias("signal_avg"), F.min("signal_min").alias("signal_min"), F.max("signal_max").alias("signal_max"), F.sum("sample_count").alias("sample_count"), F.bool_or("collection_gap").alias("any_gap")
    )


def rollup_daily(base: DataFrame) -> DataFrame:
    return base.groupBy(F.date_trunc("day", "time_window").alias("day"), "country_code", "asn").agg(
        F.avg("rtt_median_ms").alias("rtt_median_ms"), F.max("rtt_p90_ms").alias("rtt_p90_ms"), F.avg("loss_median_pct").alias("loss_median_pct"), F.max("loss_p95_pct").alias("loss_p95_pct"), F.sum("total_measurements").alias("total_measurements"), F.max("probe_count").alias("peak_probe_count")
    )


def z_scores(signals: DataFrame, days: int = 7) -> DataFrame:
    """Each value against mean and sample deviation of the days before it, [ts - days, ts).

    A sliding frame would sum some thousand rows again for every row, and a long series would be one task. Statistics depend
    on a series and a time alone, so rows are first summed by these. Moments are then taken by hour: whole hours from a small
    table, the hour at either end by running sums within it. What's in the oldest hour from ts - days on is its total less what
    comes before, which a probe at that time finds out.

    Sums are of decimals of twelve places, so they are exact and don't depend on order; squares are of values centred by their
    series' mean, so that they don't cancel. A value that no such decimal holds (not finite, or from 1e16 on) makes the
    statistics of its windows null. Every row stays, whatever is null in it: keys are compared null-safely, and rows without a
    time are each other's window, as in a frame over nulls.
    """
    key, hours = ["entity_code", "datasource"], days * 24
    exact = F.col("value").try_cast("decimal(28,12)")
    centre = signals.groupBy(*key).agg(F.avg(exact).cast("double").alias("__c"))
    points = (
        matched(signals.select(*key, "ts", "value"), centre, key)
        .groupBy(*key, "ts")
        .agg(F.first("__c").alias("c"), F.count("value").alias("n"), F.count(exact).alias("k"), F.sum(exact).alias("s"), F.sum((F.col("value") - F.col("__c")) * (F.col("value") - F.col("__c"))).alias("q"))
    )
    sums = ["n", "k", "s", "q"]
    hour = lambda c: F.floor(c / HOUR)
    w = Window.partitionBy(*key).orderBy("__h")
    hourly = points.groupBy(*key, hour(F.col("ts")).alias("__h")).agg(*(F.sum(c).alias(c) for c in sums))
    whole = hourly.select(*key, "__h", *(F.sum(c).over(w.rangeBetween(1 - hours, -1)).alias(f"__all_{c}") for c in sums), *(F.sum(c).over(w.rangeBetween(-hours, -hours)).alias(f"__edge_{c}") for c in sums))
    here = F.struct(F.col("ts").alias("at"), F.lit(True).alias("own"), *(F.col(c) for c in sums))
    past = F.struct((F.col("ts") - hours * HOUR).alias("at"), F.lit(False).alias("own"), *(F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c in sums))
    spread = points.select(*key, "ts", "c", F.explode(F.array(here, past)).alias("e")).select(*key, "ts", "c", "e.*")
    before = Window.partitionBy(*key, hour(F.col("at"))).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    run = spread.select(*key, "ts", "c", "own", *(F.sum(c).over(before).alias(c) for c in sums))
    of = lambda own, c: F.max(F.when(F.col("own") == own, F.col(c)))
    ends = run.groupBy(*key, "ts").agg(F.first("c").alias("c"), *(of(True, c).alias(f"__own_{c}") for c in sums), *(of(False, c).alias(f"__past_{c}") for c in sums))
    both = matched(ends.withColumn("__h", hour(F.col("ts"))), whole, [*key, "__h"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    timed = lambda c: zero(f"__all_{c}") + zero(f"__own_{c}") + zero(f"__edge_{c}") - zero(f"__past_{c}")
    total = both.select(*key, "ts", "c", *(F.when(F.col("ts").isNull(), zero(f"__all_{c}")).otherwise(timed(c)).alias(c) for c in sums))
    n = F.col("n")
    mean = F.when((n > 0) & (F.col("k") == n), F.col("s").cast("double") / n)
    off = mean - F.col("c")
    spare = F.col("q") - n * off * off
    std = F.when((n > 1) & mean.isNotNull(), F.when(spare > F.col("q") * 1e-13, F.sqrt(spare / (n - 1))).otherwise(0.0))
    found = matched(signals, total.select(*key, "ts", mean.alias("rolling_mean"), std.alias("rolling_std")), [*key, "ts"])
    return found.withColumn("z_score", C.z_score(F.col("value"), F.col("rolling_mean"), F.col("rolling_std")))


def trailing_nulls(signals: DataFrame, rows: int = 5, tie: str | None = None) -> DataFrame:
    """Gaps that no value follows within so many rows of their series, rows in order of ts (nulls first) and `tie`.

    A series of years isn't one task: rows are numbered within a day of their series, and what follows a day's end is found in
    a table that holds the first rows of each day. A day with rows adds one at least, so as many days as rows are enough.
    """
    key, order = ["entity_code", "datasource"], ["ts", *([tie] if tie else [])]
    day = F.floor(F.col("ts") / (24 * HOUR))
    known = F.col("value").isNotNull()
    w = Window.partitionBy(*key, "__day").orderBy(*order)
    here = signals.withColumn("__day", day).withColumns({"__i": F.row_number().over(w), "__ahead": F.collect_list(known).over(w.rowsBetween(1, rows))})
    heads = here.where(F.col("__i") <= rows).groupBy(*key, "__day").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", known.alias("known")))), lambda x: x["known"]).alias("head"))
    series = Window.partitionBy(*key).orderBy("__day")
    later = heads.select(*key, "__day", F.flatten(F.collect_list("head").over(series.rowsBetween(1, rows))).alias("__later"))
    seen = F.concat("__ahead", F.slice(F.coalesce("__later", F.array().cast("array<boolean>")), F.lit(1), F.lit(rows) - F.size("__ahead")))
    gap = F.col("value").isNull()
    found = matched(here, later, [*key, "__day"]).withColumns({"is_gap": gap, "is_trailing_null": gap & ~F.exists(seen, lambda x: x)})
    return found.drop("__day", "__i", "__ahead", "__later")


def step_census(signals: DataFrame) -> DataFrame:
    return signals.groupBy("datasource", "step").agg(F.count("*").alias("n"), F.count_if(F.col("step") != F.col("nativeStep")).alias("n_mismatch"))


def alert_report(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("datasource", "level").agg(F.count("*").alias("n"), (F.count_if(F.col("alert_value").isNull()) * 100.0 / F.count("*")).alias("null_pct"))


def event_report(events: DataFrame) -> DataFrame:
    flags = ["bgp_fired", "ping_fired", "ucsd_fired", "merit_nt_fired"]
    return events.groupBy("datasource_count").agg(F.count("*").alias("n"), F.min("duration_minutes").alias("min_minutes"), F.max("duration_minutes").alias("max_minutes"), F.avg("duration_minutes").alias("avg_minutes"), *(F.count_if(f).alias(f"n_{f}") for f in flags))


def signal_report(scored: DataFrame) -> DataFrame:
    """Of z_scores and trailing_nulls together."""
    return scored.groupBy("datasource").agg(
        F.count("*").alias("n"), F.count_if("is_gap").alias("n_gaps"), F.avg("value").alias("avg_value"), F.min("z_score").alias("min_z"), F.max("z_score").alias("max_z"), (F.count_if("is_gap") - F.count_if("is_trailing_null")).alias("n_inner_gaps")
    )


def baseline_diagnostic(pings: DataFrame) -> DataFrame:
    """Percentiles and counts of all rows; hours without a positive median go after aggregation."""
    found = pings.groupBy(F.date_trunc("hour", "ts_utc").alias("time_window"), "country_code").agg(C.percentile("rtt_avg_ms", 0.5).alias("rtt_median_ms"), C.percentile("packet_loss", 0.95).alias("loss_p95_pct"), F.count("*").alias("n"))
    return found.where("rtt_median_ms > 0")
