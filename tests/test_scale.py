"""What must hold beyond one buffer or one batch: sketches that merge, medians and sums by ranges, bitmaps, buffers, sinks that are interrupted."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import gold, serving, tables
from pulsegrid.operators.frames import running
from pulsegrid.operators.workspace import folder
from pulsegrid.streaming import buffer, jobs

PINGS = "ts_utc timestamp, country_code string, asn int, rtt_avg_ms double, packet_loss double, probe_id_hash string, msm_id int, icmp_filtered boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pings(spark, n, seed, spread=1):
    rng = random.Random(seed)
    return [(dt.datetime(2024, 1, 1, rng.randrange(3)), "DE", rng.randrange(spread), rng.choice([None, -1.0, rng.random() * 100, float(rng.randrange(5))]), rng.choice([None, 0.0, 1 / 3, 1.0]), f"{rng.randrange(9):064x}", rng.randrange(4), rng.choice([None, True, False])) for _ in range(n)]


@pytest.mark.parametrize("total", [False, True])
def test_merged_sketches_equal_baselines_of_small_hours(spark, total):
    parts = [pings(spark, 400, seed, 4) for seed in range(3)]
    merged = None
    for part in parts:
        new = gold.baseline_sketches(spark.createDataFrame(part, PINGS), total)
        merged = new if merged is None else gold.merge_sketches(merged, new)
    got = gold.from_sketches(merged)
    want = gold.baselines(spark.createDataFrame([r for p in parts for r in p], PINGS), total)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_rank_error_of_merged_sketches(spark):
    n = 4 * gold.SKETCH
    rows = spark.range(2 * n).select(F.lit(dt.datetime(2024, 1, 1)).alias("ts_utc"), F.lit("DE").alias("country_code"), F.lit(1).alias("asn"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + 1).cast("double").alias("rtt_avg_ms"), F.lit(0.5).alias("packet_loss"), F.lit("00").alias("probe_id_hash"), F.lit(1).alias("msm_id"), F.lit(False).alias("icmp_filtered"))
    a, b = (gold.baseline_sketches(rows.where(F.col("rtt_avg_ms") % 2 == i)) for i in (0, 1))
    got = gold.from_sketches(gold.merge_sketches(a, b)).first()
    assert got.total_measurements == 2 * n and got.loss_median_pct == 0.5
    for p, value in ((0.1, got.rtt_p10_ms), (0.5, got.rtt_median_ms), (0.9, got.rtt_p90_ms)):
        assert abs(rows.where(F.col("rtt_avg_ms") <= value).count() / (2 * n) - p) < 0.002


def test_exact_medians(spark):
    rng = random.Random(3)
    groups = {"one": [5.0], "two": [1.0, 2.0], "same": [7.0] * 500, "none": [None] * 3, None: [3.0, None, 4.0, 9.0], "hot": [rng.choice([2.0, 2.0, rng.gauss(0, 1e9), 1e-300, None, -0.5]) for _ in range(30_001)]}
    rows = [(k, v) for k, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    want = {k: statistics.median(x) if (x := [v for v in values if v is not None]) else None for k, values in groups.items()}
    found = serving.medians(df, ["g"], "v", "m")
    assert {r.g: r.m for r in found.collect()} == want
    assert serving.medians(df, [], "v", "m").first().m == statistics.median([v for _, v in rows if v is not None])
    assert serving.medians(df.limit(0), [], "v", "m").first().m is None and serving.medians(df.limit(0), ["g"], "v", "m").count() == 0
    assert "percentile(" not in plan(found) and "SinglePartition" not in plan(found)


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 2, 2, rng.randrange(1000)]), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "v int, id int, n int").repartition(5)
    found = running(df, [F.desc_nulls_last("v"), "id"], "before", "n")
    want, total = {}, 0
    for v, i, n in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])):
        want[i] = total
        total += n
    assert {r.id: r.before for r in found.collect()} == want and "SinglePartition" not in plan(found)
    assert running(df.limit(0), ["v"], "before").count() == 0


def test_bitmaps_of_many_ids(spark):
    rows = spark.range(100_000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("user"), (F.col("id") % 70_001).cast("string")).alias("user"), F.timestamp_seconds(F.col("id") * 10).alias("t"))
    rows = rows.unionByName(spark.createDataFrame([(9, None, dt.datetime(2024, 1, 1))], rows.schema))
    hours = gold.id_bitmaps(rows, ["g", F.date_trunc("hour", "t").alias("hour")], "user")
    days = gold.counted(hours, ["g", F.date_trunc("day", "hour").alias("day")], "n")
    want = rows.where("user IS NOT NULL").groupBy("g", F.date_trunc("day", "t").alias("day")).agg(F.count_distinct("user").alias("n"))
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, want.collect()))
    assert gold.counted(hours, [], "n").first().n == 70_001


def test_listed_partitions_read_no_data(spark):
    path = folder(spark, "t")
    days = [("2023", "12", "31"), ("2024", "01", "09"), ("2024", "01", "10"), ("2024", "02", "01")]
    spark.createDataFrame([(1, *d) for d in days], "v int, year string, month string, day string").write.partitionBy(*tables.DAY).parquet(path)
    found = tables.listed(spark, path, before=dt.date(2024, 1, 10))
    assert [tuple(r) for r in found.collect()] == days[:2] and "FileScan" not in plan(found)
    assert [tuple(r) for r in tables.listed(spark, path).collect()] == days
    assert [r.year for r in tables.listed(spark, path, by=["year"]).collect()] == ["2023", "2024"]
    assert tables.listed(spark, "/tmp/no/such/table").count() == 0


class State:
    def __init__(self):
        self.value, self.items = None, []

    exists = lambda self: self.value is not None
    update = lambda self, v: setattr(self, "value", v)
    appendList = lambda self, v: self.items.extend(v)

    def clear(self):
        self.items = []

    def get(self):
        return self.items if self.value is None else self.value


class Handle:
    def __init__(self):
        self.rows, self.about, self.timers, self.now = State(), State(), set(), 1000

    getListState = lambda self, *_: self.rows
    getValueState = lambda self, *_: self.about
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)
    getCurrentProcessingTimeInMs = lambda self: self.now
    getExpiryTimeInMs = lambda self: self.now


def test_buffers_leave_by_size_or_age():
    import pandas as pd

    h, b = Handle(), buffer.Buffer(3, 2)
    b.init(h)
    put = lambda *parts: [(f.flush[0], f.reason[0], f.body.tolist()) for f in b.handleInputRows(("k",), iter(pd.DataFrame({"body": list(p)}) for p in parts), h)]
    assert put("ab") == [] and h.timers == {3000}
    h.now = 1500
    assert put("cd", "e") == [(0, "full", ["a", "b", "c"])] and h.timers == {3500}  # d and e began to wait now
    h.now = 3500
    age = lambda: [(f.flush[0], f.reason[0], f.body.tolist()) for f in b.handleExpiredTimer(("k",), h, h)]
    assert age() == [(1, "age", ["d", "e"])] and age() == []
    h.timers = set()
    assert put("abcdefg") == [(2, "full", ["a", "b", "c"]), (3, "full", ["d", "e", "f"])] and h.timers == {5500}
    assert put("hi") == [(4, "full", ["g", "h", "i"])] and not h.timers and h.rows.items == []
    assert put("") == [] and not h.timers


def test_a_sink_that_dies_while_it_moves_files(spark, monkeypatch):
    path, rows = folder(spark, "raw"), spark.createDataFrame([(i, 1704067200 + i * 40_000) for i in range(20)], "v int, ts long")
    sink, moved = jobs.raw_sink(path, time="ts"), []
    real = tables._path

    def dies(s, p):
        if "/year=" in p and p.endswith(".gz"):
            moved.append(p)
            if len(moved) == 4:
                raise OSError("gone")
        return real(s, p)

    with monkeypatch.context() as m:
        m.setattr(tables, "_path", dies)
        with pytest.raises(OSError):
            sink(rows, 7)
    assert 0 < spark.read.text(path).count() < 20
    for _ in range(2):
        sink(rows.repartition(3), 7)
        assert sorted(r.value for r in spark.read.text(path).collect()) == sorted(f'{{"v":{i},"ts":{1704067200 + i * 40_000}}}' for i in range(20))
    sink(rows, 8)
    assert spark.read.text(path).count() == 40


def test_medians_of_few_groups_dont_deal_rows_by_group(spark, monkeypatch):
    """Once all rows of a group were sorted by one task."""
    rows = spark.range(100_001).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    plans, add = [], running
    monkeypatch.setattr(serving, "running", lambda df, *more: plans.append(plan(df)) or add(df, *more))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        got = {r.g: r.m for r in serving.medians(rows, ["g"], "v", "m").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {0: 50_000.0, 1: 50_000.0}
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
