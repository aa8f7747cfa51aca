import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.__main__ import parse
from pulsegrid.operators import tables
from pulsegrid.operators.workspace import folder
from pulsegrid.plans import medallion
from pulsegrid.streaming import jobs

DAY0 = 1704067200


def raw(spark, at, days=3):
    """Pings and signals of several days; a file's rows reach an hour into the next day, and some lines are twice there."""
    rng = random.Random(7)
    pings, signals = [], []
    for i in range(days * 600):
        t = DAY0 + rng.randrange(days * 86400)
        pings.append((i % 5, i % 40, t, 5000, 3, rng.randrange(4), 20.0 + rng.random(), "de", 64512 + i % 3))
    for d in range(days * 24 * 12):
        for ds in ("bgp", "merit-nt", "ping-slash24"):
            signals.append(("country", "de", ds, DAY0 + d * 300, 100.0 if rng.random() < 0.7 else 40.0, 300, 300))
    p = spark.createDataFrame(pings + pings[:50], "msm_id int, prb_id int, timestamp long, fw int, sent int, rcvd int, avg double, country_code string, asn int")
    s = spark.createDataFrame(signals, "entityType string, entityCode string, datasource string, ts long, value double, step int, nativeStep int")
    jobs.raw_sink(at.bronze("pings"))(p, 0)
    jobs.raw_sink(at.bronze("signals"), time="ts")(s, 0)
    bad = spark.createDataFrame([("{broken", "2024", "01", "02")], "value string, year string, month string, day string")
    bad.write.mode("append").partitionBy(*tables.DAY).text(at.bronze("pings"))


def rows(spark, at, name):
    df = tables.read(spark, at.gold(name)).drop("__day")
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_days_one_by_one_equal_all_at_once_and_the_stream(spark):
    a, b, c = (medallion.Layout(folder(spark, "root")) for _ in range(3))
    raw(spark, a)
    b_raw = {k: a.bronze(k) for k in ("pings", "signals")}
    b.bronze = c.bronze = b_raw.get
    for kind in ("pings", "signals"):
        assert medallion.refine(spark, a, kind)
        medallion.refine(spark, c, kind)
    assert not medallion.refine(spark, a, "alerts", dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    counts = medallion.aggregate(spark, a)
    assert set(counts) == set(medallion.GOLD) and all(counts.values())
    for d in (1, 2, 3):
        day, after = dt.date(2024, 1, d), dt.date(2024, 1, d + 1)
        for kind in ("pings", "signals"):
            medallion.refine(spark, b, kind, day, after)
        medallion.aggregate(spark, b, since=day, until=after)
    for name in medallion.GOLD:
        assert rows(spark, a, name) == rows(spark, b, name), name
    started = medallion.stream_gold(spark, c, every=None)
    for q in started.values():
        q.awaitTermination()
    for name in ("baselines", "signals"):
        assert rows(spark, a, name) == rows(spark, c, name), name
    assert set(medallion.reports(spark, a)) == {"signals", "steps"}
    assert tables.partitions(tables.read(spark, a.silver("pings"))).count() == 3


def test_retraction(spark):
    at = medallion.Layout(folder(spark, "root"))
    raw(spark, at, days=1)
    for kind in ("pings", "signals"):
        medallion.refine(spark, at, kind)
    medallion.aggregate(spark, at)
    n = tables.read(spark, at.gold("outages")).count()
    stale = tables.read(spark, at.gold("outages")).drop("__day").limit(1).withColumn("country_code", F.lit("ZZ"))
    tables.upsert(stale, at.gold("outages"), ["detected_at", "country_code"], day="detected_at")
    medallion.aggregate(spark, at)
    assert tables.read(spark, at.gold("outages")).count() == n + 1
    medallion.aggregate(spark, at, ["outages"], retract=True)
    assert tables.read(spark, at.gold("outages")).count() == n


@pytest.mark.parametrize("args", [["--end", "2024-01-02"], ["--start", "2024-01-02", "--end", "2024-01-02"], ["--start", "2024-01-01", "--end", "2025-01-01"]])
def test_bad_ranges(args):
    with pytest.raises(SystemExit):
        parse(["aggregate", "--root", "x", *args], today=dt.date(2024, 6, 1))


def test_ranges():
    o = parse(["refine", "--root", "x", "--start", "2024-01-01"], today=dt.date(2024, 6, 1))
    assert (o.start, o.end) == (dt.date(2024, 1, 1), dt.date(2024, 6, 1))
