import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import queries, warc_revisit as op

SCHEMA = "record_id long, kind string, url string, time long, etag string, last_modified string, headers map<string,string>"


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://WWW.Example.com:80#x", "http://example.com/"),
        ("https://u:p@Example.com.:443/A?b=2&a=1&utm_source=x&ref=y", "https://example.com/A?a=1&b=2"),
        ("http://example.com:8080/?", "http://example.com:8080/"),
        ("not a url", "not a url"),
        (None, ""),
        ("http://example.com/a?x&x", "http://example.com/a?x&x"),
    ],
)
def test_canonical(spark, url, want):
    assert spark.range(1).select(op.canonical(F.lit(url).cast("string")).alias("c")).first().c == want


def test_as_of_join_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        url = "http://hot.example/" if rng.random() < 0.5 else f"http://h{rng.randrange(40)}.example/{rng.randrange(5)}"
        rows.append((i, rng.choice(["response", "revisit", "revisit"]), url, rng.choice([None, rng.randrange(50), rng.randrange(10**6)]), rng.choice([None, "a", "W/a", "b"]), rng.choice([None, "m", "n"]), rng.choice([None, {"Date": str(i), "Server": "s", "ETag": None}])))
    got = {r.record_id: r for r in op.resolve(spark.createDataFrame(rows, SCHEMA).withColumn("slice", F.lit(1))).collect()}
    when = lambda r: (-(2**62) if r[3] is None else r[3], r[0])
    assert set(got) == {r[0] for r in rows if r[1] == "revisit"}
    for r in rows:
        if r[1] != "revisit":
            continue
        before = [x for x in rows if x[1] == "response" and x[2] == r[2] and when(x) < when(r)]
        last = max(before, key=when, default=None)
        mine = got[r[0]]
        assert mine.refers_to == (last[0] if last else None)
        if not last:
            want = "missing"
        elif r[4] and last[4]:
            want = "resolved" if r[4].removeprefix("W/") == last[4].removeprefix("W/") else "changed"
        elif r[5] and last[5]:
            want = "resolved" if r[5] == last[5] else "changed"
        else:
            want = "unchecked"
        assert mine.status == want
        permitted = {"date": r[6]["Date"]} if r[6] else {}
        old = {k.lower(): v for k, v in (last[6] or {}).items()} if want == "resolved" else {}
        assert mine.headers == old | permitted
    assert {r.status for r in got.values()} == {"missing", "resolved", "changed", "unchecked"}


def test_slices_are_of_equal_size(spark):
    """Of a URL with a null time, a burst and a far one."""
    rows = [(i, "response" if i % 3 else "revisit", "u", -(2**62) if i == 0 else 77 if i < 6000 else i if i < 9999 else 2**60) for i in range(10_000)]
    df = spark.createDataFrame(rows, "record_id long, kind string, canonical_url string, time long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = op.slices(["canonical_url"], df).groupBy("slice").agg(F.count("*").alias("n"), F.min(F.struct("time", "record_id")).alias("low"), F.max(F.struct("time", "record_id")).alias("high")).orderBy("slice").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 4 and max(r.n for r in got) < 4000 and sum(r.n for r in got) == 10_000
    assert all(a.high < b.low for a, b in zip(got, got[1:]))


def test_many_records_of_one_url_over_slices(spark):
    rows = [(i, "response" if i % 500 == 3 else "revisit", "http://a.b/", None if i < 2 else 9 if i < 5000 else i, "x", None, None) for i in range(10_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.record_id: r.refers_to for r in op.resolve(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: None if i < 3 else (i - 3) // 500 * 500 + 3 for i in range(10_000) if i % 500 != 3}


def test_repeats_and_empty(spark):
    rows = [(1, "response", "http://a.b/", 5, "x", None, None), (1, "response", "http://a.b/", 5, "x", None, None), (2, "revisit", "http://a.b", 6, "x", None, None), (2, "revisit", "http://a.b", 6, "x", None, None), (3, "revisit", None, None, None, None, None)]
    got = sorted((r.record_id, r.status, r.refers_to) for r in op.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(2, "resolved", 1), (2, "resolved", 1), (3, "missing", None)]
    assert op.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_warc_revisit(spark, sf).toPandas().sort_values("record_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(queries.oracle_sql()["op7_warc_revisit"]).df().sort_values("record_id").reset_index(drop=True)
    assert len(got) == len(want) and set(got.columns) == set(want.columns)
    for c in got.columns:
        assert (got[c].fillna("-").astype(str).str.replace(".0", "") == want[c].fillna("-").astype(str).str.replace(".0", "")).all(), c
    assert got["status"].nunique() >= 1
