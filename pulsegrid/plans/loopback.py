"""Small servers on this machine that the catalogue's queries of network sources read from, and a database for JDBC."""

from __future__ import annotations

import json
import shutil
import socketserver
import sqlite3
import tempfile
import threading
import urllib.parse
import zipfile
from collections.abc import Iterator
from contextlib import closing, contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.operators import tables
from pulsegrid.operators.workspace import folder
from pulsegrid.sources import network


class _Lines(socketserver.ThreadingTCPServer):
    request_queue_size = 128  # tasks connect at once


class _Api(ThreadingHTTPServer):
    request_queue_size = 128


@contextmanager
def _serving(server) -> Iterator[str]:
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield server
    finally:
        server.shutdown()
        server.server_close()


@contextmanager
def rest(database: dict, table: str, broken_from: int | None = None) -> Iterator[str]:
    """The URL of an API over a table (n, odd) of an SQLite database: /pages gives {"data": a page's records in order of n}, of n from
    `from` to before `until` where these are sent; /next the same as {"results": ..., "next": URL}, whose pages begin after the last record
    of the one before, so that none is looked for among all before it. A range that starts at broken_from is answered by an error. A
    request holds a page."""

    class Handler(BaseHTTPRequestHandler):
        wbufsize = 1 << 16  # an answer's head and body go together

        def do_GET(self):
            at = urllib.parse.urlparse(self.path)
            q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(at.query).items()}
            if broken_from is not None and q.get("from") == broken_from:
                body = {"error": "this range is broken"}
            else:
                with closing(sqlite3.connect(**database)) as found:
                    sql = f"SELECT n, odd FROM {table} WHERE n >= ? AND n < ? ORDER BY n LIMIT ? OFFSET ?"
                    page = found.execute(sql, (q.get("from", 0), q.get("until", 2**62), q["limit"] + 1, q.get("page", 0) * q["limit"])).fetchall()
                rows = [{"n": n, "odd": bool(odd)} for n, odd in page[: q["limit"]]]
                rest = {"from": rows[-1]["n"] + 1} | {k: q[k] for k in ("until",) if k in q} if rows else {}
                more = f"http://127.0.0.1:{self.server.server_port}/next?{urllib.parse.urlencode({'limit': q['limit']} | rest)}"
                body = {"results": rows, "next": more if len(page) > len(rows) else None} if at.path == "/next" else {"data": rows}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    with _serving(_Api(("127.0.0.1", 0), Handler)) as s:
        yield f"http://127.0.0.1:{s.server_port}"


@contextmanager
def whois(name) -> Iterator[int]:
    """The port of a bulk WHOIS server; name gives an ASN's name."""

    class Handler(socketserver.StreamRequestHandler):
        wbufsize = 1 << 16

        def handle(self):
            self.wfile.write(b"Bulk mode; answers follow\r\n")
            for line in map(bytes.decode, self.rfile):
                if line.strip() == "end":
                    return
                if line.startswith("AS"):
                    self.wfile.write(f"{line[2:].strip()} | C1 | registry | 2001-01-01 | {name(int(line[2:]))}\n".encode())

    with _serving(_Lines(("127.0.0.1", 0), Handler)) as s:
        yield s.server_address[1]


@contextmanager
def feed(database: dict, table: str, line) -> Iterator[int]:
    """The port of a TCP server that sends line(n) of each n in a table of an SQLite database to whoever connects, and then waits."""
    done = threading.Event()

    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            with closing(sqlite3.connect(**database)) as found:
                for (n,) in found.execute(f"SELECT n FROM {table} ORDER BY n"):
                    self.wfile.write(f"{line(n)}\n".encode())
            done.wait(600)

    server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler)
    server.daemon_threads = True
    with _serving(server) as s:
        try:
            yield s.server_address[1]
        finally:
            done.set()


@contextmanager
def database(spark: SparkSession, rows: dict[str, DataFrame], *statements: str) -> Iterator[str]:
    """The JDBC URL of a database with these tables, for readers on all machines. Only one process at a time may have a database
    of Derby's open for writing, and one in memory is seen by its own process alone: so the driver fills it and shuts it down, and an
    archive of it in the shared folder, which must be a mounted one, is what all processes read. Statements run before."""
    own, shared = tempfile.mkdtemp(prefix="pulsegrid-"), folder(spark, "database")
    url = f"jdbc:derby:{own}/db"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared}/db.jar")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        raise ValueError("the database needs a spark.checkpoint.dir that all machines have mounted")
    try:
        network.execute(spark, f"{url};create=true", *statements)
        for table, df in rows.items():
            network.upload(df, url, table, f"{shared}/{table}")
        network.shut(spark, url)
        with zipfile.ZipFile(f"{own}/db.jar", "w", zipfile.ZIP_STORED) as z:  # pages are read by their offset
            for f in sorted(Path(own, "db").rglob("*")):
                z.write(f, f.relative_to(own))
        files.copyFromLocalFile(True, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{own}/db.jar"), where)
        shutil.rmtree(own)
        archived = f"jdbc:derby:jar:({where.toUri().getPath()})db"
        yield archived
        network.shut(spark, archived)
    finally:
        shutil.rmtree(own, ignore_errors=True)
        tables.remove(spark, shared)
