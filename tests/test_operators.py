import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators import gold, serving, silver, tables, versions
from pulsegrid.operators.frames import ensure, first_of_each
from pulsegrid.operators.workspace import folder
from pulsegrid.schemas import ALERT, EVENT, PING, SIGNAL
from pulsegrid.sources import files

NOON = 1704110400


def ping(**more):
    row = dict.fromkeys(PING.names) | {"prb_id": 1, "msm_id": 1, "timestamp": NOON, "sent": 3, "rcvd": 3, "avg": 10.0, "country_code": "de", "asn": 1, "fw": 5000}
    return tuple((row | more)[n] for n in PING.names)


def one(spark, *pings):
    return silver.pings(spark.createDataFrame(list(pings), PING)).collect()


def test_loss_and_icmp(spark):
    got = one(spark, ping(), ping(rcvd=1), ping(rcvd=0, avg=None), ping(rcvd=0, avg=-1.0), ping(sent=0), ping(sent=None), ping(rcvd=None), ping(sent=3, rcvd=5))
    assert [r.packet_loss for r in got] == pytest.approx([0.0, 1 - 1 / 3, 1.0, 1.0, None, None, 1.0, 0.0])
    assert [r.icmp_filtered for r in got] == [False, False, True, False, False, False, False, False]


def test_packets_stand_in_for_missing_scalars(spark):
    packets = [(1.0, None, None), (None, 1, None), (3.0, None, None)]
    got = one(spark, ping(avg=None, result=packets), ping(avg=5.0, result=packets), ping(avg=None, result=[]), ping(avg=None, result=None))
    assert [r.rtt_avg_ms for r in got] == [2.0, 5.0, None, None]
    assert [(r.rtt_min_ms, r.rtt_max_ms) for r in got[:1]] == [(1.0, 3.0)]
    assert [r.pkt_result_count for r in got] == [3, 3, 0, None]


def test_personal_columns_go_and_firmware(spark):
    got = one(spark, ping(fw=4999), ping(fw=5000), ping(fw=None), ping(prb_id=None), ping(timestamp=None))
    assert [r.fw_gen for r in got] == ["v4", "v5", "v4"]
    assert not {"prb_id", "from", "src_addr", "dst_addr"} & set(got[0].asDict())
    assert got[0].country_code == "DE" and len(got[0].probe_id_hash) == 64 and (got[0].year, got[0].month, got[0].day) == ("2024", "01", "01")


def test_day_anchor(spark):
    midnight = 1704067200
    rows = silver.pings(spark.createDataFrame([ping(timestamp=t) for t in (midnight - 1, midnight, midnight + 86399, midnight + 86400)], PING))
    assert sorted(r.timestamp for r in silver.on_day(rows, dt.date(2024, 1, 1)).collect()) == [midnight, midnight + 86399]


def test_score_lattice(spark):
    cases = list(itertools.product((0.0, 0.10, 0.15, 0.20, 0.3, None), (-0.05, -0.06, None), (-0.1, -0.2), (-0.1, -0.2)))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, loss double, bgp double, merit double, ping double")
    got = {r.i: r for r in df.select("i", C.confidence(F.col("loss"), F.col("bgp"), F.col("merit"), F.col("ping")).alias("s"), C.severity(C.confidence(F.col("loss"), F.col("bgp"), F.col("merit"), F.col("ping"))).alias("l")).collect()}
    for i, (loss, bgp, merit, p) in enumerate(cases):
        r = 0.0 if loss is None or loss <= 0.1 else 0.5 if loss <= 0.2 else 1.0
        want = r * 0.35 + (bgp is not None and bgp < -0.05) * 0.35 + (merit < -0.1) * 0.2 + (p < -0.1) * 0.1
        assert got[i].s == want
        assert got[i].l == ("hard_outage" if want >= 0.7 else "degraded" if want >= 0.45 else "possible" if want >= 0.2 else "noise")
    assert 0.35 + 0.10 < 0.45


def test_bucket_property(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-(10**9), 2 * 10**9), rng.choice([60, 300, 600])) for _ in range(200)]
    got = spark.createDataFrame(rows, "t long, s int").select("t", "s", F.unix_timestamp(C.step_bucket(F.col("t"), F.col("s"))).alias("b"), F.unix_timestamp(C.step_bucket_compat(F.col("t"), F.col("s"))).alias("c")).collect()
    assert all(r.b <= r.t < r.b + r.s and r.b % r.s == 0 for r in got)
    assert all(r.c in (r.t, r.t - 1, r.t + 1) for r in got)


def signal(code, ts, value, step=300, ds="bgp"):
    return ("country", code, ds, ts, value, step, step)


def test_signal_buckets(spark):
    rows = [signal("de", NOON, 1.0), signal("de", NOON + 60, None), signal("fr", NOON, None), signal("es", NOON + 299, 3.0), signal("es", NOON, 9.0, step=600), signal(None, NOON, 1.0)]
    got = {r.country_code: r for r in gold.signal_buckets(silver.signals(spark.createDataFrame(rows, SIGNAL))).collect()}
    assert set(got) == {"DE", "FR", "ES"}
    assert (got["DE"].signal_value, got["DE"].sample_count, got["DE"].collection_gap) == (1.0, 2, True)
    assert got["FR"].collection_gap and got["FR"].signal_value is None
    assert (got["ES"].step_seconds, got["ES"].signal_value, got["ES"].collection_gap) == (300, 3.0, False)


def test_trailing_window_leaves_out_the_hour_and_long_gaps(spark):
    rows = [signal("de", NOON + h * 3600, v) for h, v in ((0, 100.0), (1, 90.0), (25, 50.0), (60, 1.0))]
    got = [r.bgp_pct_change for r in gold.signal_changes(gold.signal_buckets(silver.signals(spark.createDataFrame(rows, SIGNAL)))).orderBy("time_window").collect()]
    assert got == pytest.approx([None, -0.1, (50 - 90) / 90, None])


def test_zero_and_negative_baselines(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, -1.0), (5.0, None), (None, 2.0), (1.0, 2.0)], "v double, b double")
    assert [r[0] for r in df.select(C.pct_change(F.col("v"), F.col("b"))).collect()] == [None, None, None, None, -0.5]
    assert [r[0] for r in df.select(C.deviation_pct(F.col("v"), F.col("b"))).collect()] == [None, 600.0, None, None, 50.0]
    assert [r[0] for r in df.select(C.z_score(F.col("v"), F.lit(1.0), F.col("b"))).collect()] == [None, None, None, None, 0.0]


def test_z_scores_equal_a_sliding_frame(spark):
    import statistics

    rng = random.Random(3)
    rows = [("DE", ds, rng.randrange(-(10**5), 15 * 86400) if ds == "x" else i * 7200, None if rng.random() < 0.1 else 5.0 if ds == "flat" else rng.gauss(1000, 1)) for ds in ("x", "y", "flat") for i in range(150)]
    rows += rows[:20]
    got = gold.z_scores(spark.createDataFrame(rows, "entity_code string, datasource string, ts long, value double")).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = [v for _, ds, t, v in rows if ds == r.datasource and r.ts - 7 * 86400 <= t < r.ts and v is not None]
        assert r.rolling_mean == (pytest.approx(statistics.fmean(seen)) if seen else None)
        assert r.rolling_std == (pytest.approx(statistics.stdev(seen), rel=1e-6, abs=1e-9) if len(seen) > 1 else None)
        assert (r.z_score is None) == (r.value is None or len(seen) < 2 or r.datasource == "flat")


def test_z_scores_keep_rows_with_nulls_and_round_ties(spark):
    day = 86400
    rows = [("DE", "x", 0, 47.84), ("DE", "x", 1, 47.85), ("DE", "x", 1, 47.85), ("DE", "x", 2, 47.845), (None, "x", 5, 1.0), (None, "x", 6, 2.0), (None, "x", 7, 4.0), ("DE", None, 5, 1.0), ("DE", "x", None, 3.0), ("DE", "x", None, 5.0), (None, None, None, None), ("DE", "inf", 0, float("inf")), ("DE", "inf", 1, 1.0), ("DE", "inf", 8 * day, 1.0), ("DE", "inf", 8 * day + 1, 1.0)]
    got = gold.z_scores(spark.createDataFrame(rows, "entity_code string, datasource string, ts long, value double")).collect()
    assert len(got) == len(rows)
    at = {(r.entity_code, r.datasource, r.ts): r for r in got}
    assert at["DE", "x", 2].rolling_mean == (47.84 + 47.85 + 47.85) / 3 and at["DE", "x", 1].rolling_mean == 47.84
    assert (at[None, "x", 7].rolling_mean, at[None, "x", 7].z_score) == (1.5, round(2.5 / 0.5**0.5, 4))
    assert at["DE", None, 5].rolling_mean is None and at[None, None, None].rolling_mean is None
    assert at["DE", "x", None].rolling_mean == 4.0  # rows without a time are each other's window
    assert at["DE", "inf", 1].rolling_mean is None and at["DE", "inf", 8 * day + 1].rolling_mean == 1.0


def test_trailing_nulls_equal_a_window_over_the_series(spark):
    from pyspark.sql import Window

    rng = random.Random(5)
    rows = [(i, rng.choice(["DE", "FR", None]), "bgp", rng.choice([None, rng.randrange(30) * 40_000, rng.randrange(9)]), None if rng.random() < 0.8 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, entity_code string, datasource string, ts long, value double")
    w = Window.partitionBy("entity_code", "datasource").orderBy("ts", "id").rowsBetween(1, 5)
    want = {r.id: r.t for r in df.select("id", (F.col("value").isNull() & (F.count("value").over(w) == 0)).alias("t")).collect()}
    got = {r.id: r.is_trailing_null for r in gold.trailing_nulls(df, tie="id").collect()}
    assert got == want and any(got.values()) and not all(got.values())


def test_trailing_nulls(spark):
    values = [1.0, None, 2.0] + [None] * 6
    got = gold.trailing_nulls(spark.createDataFrame([("DE", "bgp", i, v) for i, v in enumerate(values)], "entity_code string, datasource string, ts long, value double")).orderBy("ts").collect()
    assert [r.is_trailing_null for r in got] == [False, False, False] + [True] * 6
    assert [r.is_gap for r in got] == [v is None for v in values]


def test_alert_variants(spark):
    def alert(**m):
        row = dict.fromkeys(ALERT.names) | {"datasource": "BGP", "value": 8.0} | m
        return tuple(row[n] for n in ALERT.names)

    rows = [alert(entity=("country", "de", "x"), time=NOON, historyValue=10.0), alert(entityType="country", entityCode="fr", **{"from": NOON}, historicalValue=10.0), alert(entity=("country", "es", "x"), entityCode="zz", time=NOON, **{"from": 1}), alert(time=NOON), alert(entityCode="it")]
    got = {r.entity_code: r for r in silver.alerts(spark.createDataFrame(rows, ALERT)).collect()}
    assert set(got) == {"DE", "FR", "ES"} and got["DE"].deviation_pct == got["FR"].deviation_pct == 20.0
    assert got["ES"].ts_from == got["DE"].ts_from and got["ES"].historical_value is None and got["DE"].datasource == "bgp"


def test_event_flags(spark):
    def event(i, alerts):
        row = dict.fromkeys(EVENT.names) | {"entityCode": f"c{i}", "from": NOON, "until": NOON + 90, "alerts": alerts}
        return tuple(row[n] for n in EVENT.names)

    texts = ['[{"datasource":"bgp"},{"datasource":"merit-nt","level":"x"}]', '[{"datasource":"other"}]', "bad", None]
    got = silver.events(spark.createDataFrame([event(i, t) for i, t in enumerate(texts)], EVENT)).orderBy("entity_code").collect()
    assert [(r.bgp_fired, r.merit_nt_fired, r.datasource_count) for r in got] == [(True, True, 2), (False, False, 0), (False, False, 0), (False, False, 0)]
    assert got[0].duration_sec == 90 and float(got[0].duration_minutes) == 1.5


def test_dedup_is_deterministic_and_idempotent(spark):
    rows = [(i % 7, i % 3, v) for i in range(100) for v in (None, i, -i)]
    df = spark.createDataFrame(rows, "a int, b int, v int")
    once = first_of_each(df, "a", "b")
    assert once.count() == 21
    assert sorted(map(str, once.collect())) == sorted(map(str, first_of_each(df.orderBy(F.rand(1)).unionByName(once), "a", "b").collect()))


def test_ensure(spark):
    assert ensure(spark.range(1), id="int", x="double").dtypes == [("id", "bigint"), ("x", "double")]


def test_percentiles_are_ordered_and_total_loss_is_optional(spark):
    rng = random.Random(2)
    rows = [ping(prb_id=i, avg=rng.choice([None, -1.0, rng.random() * 100]), rcvd=rng.randrange(4)) for i in range(300)]
    rows = silver.pings(spark.createDataFrame(rows, PING))
    a, b = gold.baselines(rows).first(), gold.baselines(rows, include_total_loss=True).first()
    assert a.rtt_p10_ms <= a.rtt_median_ms <= a.rtt_p90_ms and 0 <= a.loss_median_pct <= a.loss_p95_pct <= 1
    assert (b.rtt_p10_ms, b.rtt_p90_ms) == (a.rtt_p10_ms, a.rtt_p90_ms) and b.total_measurements == 300 > a.total_measurements
    assert a.icmp_filtered_count == 0 < b.icmp_filtered_count


def test_rows_without_a_known_loss_are_left_out(spark):
    rows = silver.pings(spark.createDataFrame([ping(), ping(sent=0), ping(sent=None, asn=2)], PING))
    assert [(r.asn, r.total_measurements) for r in gold.baselines(rows).collect()] == [(1, 1)]
    assert [r.total_measurements for r in gold.baselines(rows, include_total_loss=True).collect()] == [1]
    assert gold.loss_evidence_raw(rows).first().ripe_probe_count == 1


def test_buckets_are_of_the_step_not_the_native_one(spark):
    rows = [("country", "de", "bgp", NOON + t, 1.0, 900, 300) for t in (0, 300, 600)] + [("country", "de", "bgp", NOON, 1.0, None, 300), ("country", "de", "bgp", NOON, 1.0, 0, 300)]
    got = gold.signal_buckets(silver.signals(spark.createDataFrame(rows, SIGNAL))).collect()
    assert [(r.step_seconds, r.sample_count) for r in got] == [(900, 3)]


def test_refresh_empties_days(spark):
    path = folder(spark, "t")
    rows = spark.createDataFrame([(dt.datetime(2024, 1, d, 5), "A", 1, 10.0, 20.0, 0.1, 0.2, 30, 2) for d in (1, 2, 3)], "time_window timestamp, country_code string, asn int, rtt_median_ms double, rtt_p90_ms double, loss_median_pct double, loss_p95_pct double, total_measurements int, probe_count int")
    tables.refresh(rows, path, gold.rollup_daily, "time_window", dt.date(2024, 1, 1), dt.date(2024, 1, 5))
    tables.refresh(rows.where("day(time_window) != 2"), path, gold.rollup_daily, "time_window", dt.date(2024, 1, 2), dt.date(2024, 1, 4))
    assert sorted(r.day.day for r in tables.read(spark, path).collect()) == [1, 3]


def test_ranks(spark):
    df = spark.createDataFrame([("a", 3), ("b", None), ("c", 5), ("d", 3), ("e", None)], "country_code string, v int")
    assert [(r.country_code, r["rank"]) for r in serving.ranked(df, "v").orderBy("rank").collect()] == [("c", 1), ("a", 2), ("d", 3), ("b", 4), ("e", 5)]
    assert serving.ranked(df, "v", 2).count() == 2


def test_upsert_touches_only_its_days(spark):
    path = folder(spark, "t")
    ts = lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "t timestamp, k string, v int"
    assert tables.upsert(spark.createDataFrame([(ts(1, 1), "a", 1), (ts(2, 1), "a", 2), (ts(2, 1), None, 5)], schema), path, ["t", "k"], day="t") == 3
    before = versions.current(spark, path).days
    new = spark.createDataFrame([(ts(2, 1), "a", 3), (ts(2, 2), "b", 4), (ts(2, 1), None, 6)], schema)
    for _ in range(2):
        tables.upsert(new, path, ["t", "k"], day="t")
    got = sorted(((r.t.day, r.t.hour, r.k or "", r.v) for r in tables.read(spark, path).collect()))
    assert got == [(1, 1, "a", 1), (2, 1, "", 6), (2, 1, "a", 3), (2, 2, "b", 4)]
    after = versions.current(spark, path).days
    assert after["2024-01-01"] == before["2024-01-01"] and after["2024-01-02"] != before["2024-01-02"]


def test_retraction_empties_days(spark):
    path = folder(spark, "t")
    rows = [(dt.datetime(2024, 1, d, 1), k, d) for d in (1, 2, 3) for k in "ab"]
    df = spark.createDataFrame(rows, "t timestamp, k string, v int")
    tables.upsert(df, path, ["t", "k"], day="t")
    tables.upsert(df.where("v = 1 AND k = 'a'"), path, ["t", "k"], day="t", retract=F.lit(True), span=(dt.date(2024, 1, 1), dt.date(2024, 1, 3)))
    assert sorted((r.t.day, r.k) for r in tables.read(spark, path).collect()) == [(1, "a"), (3, "a"), (3, "b")]
    tables.upsert(df.limit(0), path, ["t", "k"], day="t", retract=F.col("k") == "a", span=(None, None))
    assert sorted((r.t.day, r.k) for r in tables.read(spark, path).collect()) == [(3, "b")]


def test_missing_table(spark):
    assert tables.read(spark, "/tmp/there/is/no/such/path") is None


def test_days_and_partitions(spark):
    assert [r.path for r in tables.days(spark, dt.date(2023, 12, 31), dt.date(2024, 1, 2)).collect()] == ["year=2023/month=12/day=31", "year=2024/month=01/day=01"]
    assert tables.days(spark, dt.date(2024, 1, 2), dt.date(2024, 1, 2)).count() == 0
    df = spark.createDataFrame([("2024", "01", "09"), ("2023", "12", "31"), ("2024", "01", "10")], "year string, month string, day string")
    assert [r.day for r in tables.partitions(df, before=dt.date(2024, 1, 10)).collect()] == ["31", "09"]


def test_summary_fan_out(spark):
    t = dt.datetime(2024, 1, 1, 5)
    base = spark.createDataFrame([(t, "A", 1, 10.0, 20.0, 0.1, 30)], "time_window timestamp, country_code string, asn int, rtt_median_ms double, rtt_p90_ms double, loss_median_pct double, total_measurements int")
    bad = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "A", s) for h, s in ((1, "degraded"), (2, "hard_outage"), (3, "degraded"), (4, "possible"))], "detected_at timestamp, country_code string, severity string")
    since, until = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    assert serving.country_summary(base, bad, since, until).first().total == 30
    r = serving.country_summary(base, bad, since, until, fanout=True).first()
    assert (r.total, r.outage_hours, r.worst_severity) == (90, 3, "hard_outage")


def test_expand_and_regroup(spark):
    rows = [("country", "DE", "bgp", 1000, 2000, None, 60, [1.0, None, 3.0]), ("country", "FR", "bgp", 0, 1, 10, None, [])]
    got = silver.expand_series(spark.createDataFrame(rows, "entityType string, entityCode string, datasource string, `from` bigint, until bigint, step int, nativeStep int, values array<double>")).orderBy("ts").collect()
    assert [(r.ts, r.value, r.step, r.nativeStep) for r in got] == [(1000, 1.0, 60, 60), (1060, None, 60, 60), (1120, 3.0, 60, 60)]


def test_whois_and_messages(spark):
    lines = spark.createDataFrame([("Bulk mode",), ("1 | DE | r | d | Name, DE",), ("2|FR|r|d|",), ("x | DE | r | d | n",), ("3 | short",), (None,)], "value string")
    assert sorted(files.whois(lines).collect()) == [(1, "Name, DE", "DE"), (2, "AS2", "FR")]
    got = files.socket_messages(spark.createDataFrame([('["atlas_result",{"msm_id":7}]',), ('["other",{"msm_id":8}]',), ("junk",), ("[]",)], "value string"), PING, "atlas_result")
    assert [r.msm_id for r in got.collect()] == [7]


def test_json_lines_with_an_empty_file(spark, tmp_path):
    import gzip

    (tmp_path / "a.json.gz").write_bytes(gzip.compress(b'{"ts": 5, "entityCode": "DE"}\n{"ts": bad\n'))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b""))
    good, bad = files.json_lines(spark, str(tmp_path), SIGNAL)
    assert [r.ts for r in good.collect()] == [5] and bad.count() == 1


def test_probe_map_last_wins(spark):
    rows = [(1, 10, "A", 1), (1, 20, "B", 2), (2, None, "C", 1), (3, 0, "D", 1)]
    got = files.probe_map(spark.createDataFrame(rows, "id int, asn_v4 int, country_code string, n int"), F.col("n")).collect()
    assert got == [(1, "B", 20)]
