import http.server
import json
import os
import subprocess
import sys
import threading
import urllib.parse
import urllib.request
from pathlib import Path

import pytest

from pulsegrid.operators.workspace import folder
from pulsegrid.plans import catalogue, loopback
from pulsegrid.sources import files, network
from pulsegrid.streaming import jobs


@pytest.fixture
def server():
    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            total = [{"n": q.get("from", 0) + i} for i in range(25 if "from" not in q else 12)]
            body = {"error": "no"} if "broken" in self.path else {"data": total[q["page"] * q["limit"] : (q["page"] + 1) * q["limit"]]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_paged_rest(spark, server):
    spark.dataSource.register(network.PagedRest)
    got = spark.read.format("paged_rest").option("url", server).option("page_size", 10).load().collect()
    assert sorted(json.loads(r.value)["n"] for r in got) == list(range(25))
    df = spark.read.format("paged_rest").option("url", server).option("page_size", 5).options(since=1000, until=1250, chunk=100).load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted(json.loads(r.value)["n"] for r in df.collect()) == sorted(b + i for b in (1000, 1100, 1200) for i in range(12))
    assert df.where("error IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="the server answered"):
        spark.read.format("paged_rest").option("url", f"{server}/broken").load().collect()


def test_chunks(spark):
    assert [tuple(r) for r in network.history_chunks(spark, 0, 10000).collect()] == [(0, 7200), (7200, 10000)]
    assert network.history_chunks(spark, 5, 5).count() == 0


def test_an_operator_without_a_shared_folder_fails_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folder(Session, "x")


def test_probe_entries_of_both_forms(spark):
    rows = [(1, '{"country_code": "DE", "asn": 5}'), (2, '"FR"'), (3, '{"country_code": "ES"}'), (4, "junk"), (5, None)]
    got = files.probe_entries(spark.createDataFrame(rows, "prb_id int, value string")).orderBy("prb_id").collect()
    assert [tuple(r)[1:] for r in got] == [("DE", 5), ("FR", None), ("ES", None), (None, None), (None, None)]


def test_a_stream_without_a_source_is_left_out(spark):
    assert jobs.files(spark, "/tmp/there/is/no/such/path") is None
    assert jobs.start_all(spark, {"a": lambda: None}) == {}
    jobs.stop_all({})


def test_a_database_gives_texts_and_nulls_as_they_were(spark):
    rows = [(1, 'a "b", c', 0.1), (2, "", 1 / 3), (3, None, None), (4, " two\nlines ", -1e-300), (5, "é,\\", 1e300), (None, "x", 0.0)]
    df = spark.createDataFrame(rows, "id long, t string, d double").repartition(3)
    with loopback.database(spark, {"things": df}, "CREATE TABLE things (id BIGINT, t VARCHAR(99), d DOUBLE)") as url:
        got = network.jdbc(spark, url, "things", "ID", 1, 5, 3).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)
    with loopback.database(spark, {"made": df.drop("t")}) as url:
        assert network.jdbc(spark, url, "made").count() == len(rows)
    with loopback.database(spark, {"nothing": df.limit(0)}) as url:
        assert network.jdbc(spark, url, "nothing").count() == 0


def test_parts_of_a_database_table_have_each_row_once(spark, tmp_path):
    spark.dataSource.register(network.Database)
    connect = {"database": f"{tmp_path}/db", "timeout": 60}
    network.statements("sqlite3", connect, "CREATE TABLE t (id INTEGER, name TEXT, x REAL)", "INSERT INTO t VALUES (-5, 'a', 0.5), (NULL, 'none', NULL), (0, NULL, 1), (7, 'é', 2), (99, 'z', 3)")
    options = {"module": "sqlite3", "connect": json.dumps(connect)}
    want = sorted([(-5, "a", 0.5), (None, "none", None), (0, None, 1.0), (7, "é", 2.0), (99, "z", 3.0)], key=repr)
    for more in ({}, {"column": "id", "low": 0, "high": 10, "parts": 4, "batch": 1}, {"column": "id", "low": 3, "high": 3, "parts": 4}):
        got = spark.read.schema("id long, name string, x double").format("database").options(**options, table="t", **more).load()
        assert sorted(map(tuple, got.collect()), key=repr) == want
    some = spark.read.schema("name string").format("database").options(**options, table="(SELECT name FROM t WHERE x > 1) AS u").load()
    assert sorted(r.name for r in some.collect()) == ["z", "é"]
    with pytest.raises(Exception, match="no such table"):
        spark.read.schema("id long").format("database").options(**options, table="absent").load().collect()


def test_jdbc_queries_where_executors_are_processes_of_their_own(tmp_path):
    """All addresses are this machine's loopback, whatever its name resolves to; a machine on which no such cluster comes up can't
    tell anything of the queries."""
    code = f"""
from pyspark.sql import SparkSession
conf = {{"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": "file://{tmp_path}", "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
    "spark.driver.memory": "700m", "spark.executor.memory": "700m", "spark.sql.shuffle.partitions": "2", "spark.sql.warehouse.dir": "{tmp_path}/warehouse"}}
spark = SparkSession.builder.master("local-cluster[2,1,700]").config(map=conf).getOrCreate()
pids = spark.range(0, 64, 1, 8).mapInPandas(lambda it: (d.assign(id=__import__("os").getppid()) for d in it), "id long").distinct().count()
print("STARTED", pids)
from pulsegrid.plans import catalogue
print("ROWS", *(catalogue.QUERIES[q](spark, "/root/testdata/sf0.001").count() for q in ("q_jdbc_scan", "q_jdbc_lookback", "q_database_scan", "q_database_lookback")))
spark.stop()
"""
    root = str(Path(__file__).resolve().parents[1])
    env = os.environ | {"PYTHONPATH": root, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_HOSTNAME": "127.0.0.1"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    if "STARTED" not in ran.stdout:
        pytest.skip(f"no cluster of processes comes up on this machine:\n{ran.stderr}")
    assert int(ran.stdout.split("STARTED")[1].split()[0]) >= 2, ran.stdout  # workers of more than one process
    assert "ROWS" in ran.stdout, ran.stderr
    scan, window, *same = map(int, ran.stdout.split("ROWS")[1].split()[:4])
    assert scan == 1500 and window > 0 and same == [scan, window]


def test_whois_asks_for_every_number_of_a_table(spark):
    """q_whois_fetch once sent the numbers of the 25 nations instead of 250."""
    got = catalogue.QUERIES["q_whois_fetch"](spark, "/root/testdata/sf0.01").collect()
    keys = {r[0] for r in spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select("c_custkey").collect()} | set(range(250))
    assert sorted(r.asn for r in got) == sorted(64512 + k for k in keys)
    assert all(r.name == (f"AS{r.asn}" if (r.asn - 64512) % 7 == 0 else f"Net {r.asn}") for r in got)
    connections = []
    with loopback.whois(lambda n: connections.append(n) or str(n)) as port:
        numbers = spark.createDataFrame([(n,) for n in [5, None, 7, 7, *range(100, 125)]], "n long").coalesce(1)
        lines = network.whois(numbers, "127.0.0.1", port, batch=10).collect()
    assert sum("|" in r.value for r in lines) == 28 and sum(r.value.startswith("Bulk mode") for r in lines) == 3


def test_pages_of_ranges_and_pages_that_begin_after_the_last_record(spark, tmp_path):
    """Pages once were all one task's, and each was looked for among all before it."""
    connect = {"database": f"{tmp_path}/db", "timeout": 60}
    keys = [*range(-5, 40), 41, 1000, 10**15, 10**15 + 7]
    network.statements("sqlite3", connect, "CREATE TABLE keys (n INTEGER PRIMARY KEY, odd INTEGER)", f"INSERT INTO keys VALUES {', '.join(f'({n}, {n % 2})' for n in keys)}")
    edges = catalogue._edges(spark.createDataFrame([(n,) for n in keys], "n long"))
    assert edges == f"-5,{10**15 + 8}" and catalogue._edges(spark.range(0).withColumnRenamed("id", "n")) == "0,0"
    wide = [int(x) for x in catalogue._edges(spark.range(10**12, 10**12 + 35_000 * 10**6, 10**6).withColumnRenamed("id", "n")).split(",")]
    assert len(wide) == 5 and all(5000 <= (b - a) / 10**6 <= 15_000 for a, b in zip(wide, wide[1:])) and (wide[0], wide[-1]) == (10**12, 10**12 + 34_999 * 10**6 + 1)
    with loopback.rest(connect, "keys") as url:
        for path, more in (("pages", {}), ("next", {"rows_name": "results", "next_name": "next"})):
            for size in (1, 7, 100):
                df = catalogue._rest(spark, f"{url}/{path}", page_size=size, edges=f"-5,0,20,41,1000,{10**15 + 8}", **more)
                assert df.rdd.getNumPartitions() == 5
                assert sorted(json.loads(r.value)["n"] for r in df.collect()) == keys
        with urllib.request.urlopen(f"{url}/next?limit=3&from=2&until=9") as r:
            body = json.load(r)
        assert [x["n"] for x in body["results"]] == [2, 3, 4] and urllib.parse.parse_qs(urllib.parse.urlparse(body["next"]).query) == {"limit": ["3"], "from": ["5"], "until": ["9"]}
