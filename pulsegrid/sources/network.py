"""Sources that need a network: Kafka, sockets, JDBC, databases with a Python driver, paginated REST, chunked history, bulk WHOIS.
Kafka's library may be absent; nothing is loaded before use."""

from __future__ import annotations

import datetime as dt
import importlib
import json
import socket
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def kafka(spark: SparkSession, servers: str, topic: str, most: int = 50_000) -> DataFrame:
    """A stream of one topic, from now on, of so many offsets a batch at most."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").option("maxOffsetsPerTrigger", most).option("failOnDataLoss", "false").load()


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low=None, high=None, parts: int = 8, **properties: str) -> DataFrame:
    """A table, or a subquery `(SELECT ...) AS t`; with a partition column read in so many parts at once."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if column is not None:
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def lookback(table: str, columns: list[str], time: str, since: dt.datetime, until: dt.datetime, hours: int = 25) -> str:
    """For jdbc(): a subquery of the rows from so many hours before since up to until, which the database filters."""
    at = lambda t: t.strftime("%Y-%m-%d %H:%M:%S")
    return f"(SELECT {', '.join(columns)} FROM {table} WHERE {time} >= TIMESTAMP('{at(since - dt.timedelta(hours=hours))}') AND {time} <= TIMESTAMP('{at(until)}')) window_rows"


def execute(spark: SparkSession, url: str, *statements: str) -> None:
    """Runs statements in a database that Spark has a driver of, each committed by itself."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        for s in statements:
            connection.createStatement().execute(s)
    finally:
        connection.close()


def upload(df: DataFrame, url: str, table: str, path: str) -> None:
    """Appends rows, columns in the table's order, to a table of an embedded Derby that only the driver may have open, and makes the
    table where there's none. Executors write text files below path, a mounted folder that all machines share, and the database takes in
    one after the other. Where executors reach the database, df.write.jdbc() does it in parallel."""
    jvm = df.sparkSession.sparkContext._jvm
    jdbc = jvm.org.apache.spark.sql.execution.datasources.jdbc
    zone = jvm.java.util.TimeZone.getDefault().getID()  # the one by which JDBC reads timestamps
    df.write.option("timeZone", zone).csv(path, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    where = jvm.org.apache.hadoop.fs.Path(path)
    parts = where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        options = jdbc.JdbcOptionsInWrite(url, table, jvm.PythonUtils.toScalaMap({}))
        if not jdbc.JdbcUtils.tableExists(connection, options):
            jdbc.JdbcUtils.createTable(connection, table, df._jdf.schema(), False, options)
        take = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
        for f in parts:
            if f.getPath().getName().startswith("part-") and f.getLen():
                take.setString(1, table.upper())
                take.setString(2, f.getPath().toUri().getPath())
                take.execute()
    finally:
        connection.close()


def shut(spark: SparkSession, url: str) -> None:
    """Closes an embedded database that this process has open."""
    try:
        spark.sparkContext._jvm.java.sql.DriverManager.getConnection(f"{url};shutdown=true")
    except Py4JJavaError as e:  # it answers by an error, with this state where it's done
        if e.java_exception.getSQLState() != "08006":
            raise


def lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of the lines that a TCP server sends, column value; what has been read can't be read again, so it is for
    feeds that are lossy anyhow."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def history_chunks(spark: SparkSession, since: int, until: int, width: int = 7200) -> DataFrame:
    """from, until of each chunk of [since, until), the last one cut: one row, so one request, each."""
    if since >= until:
        return spark.createDataFrame([], "`from` bigint, until bigint")
    return spark.range(since, until, width).select(F.col("id").alias("from"), F.least(F.col("id") + width, F.lit(until)).alias("until"))


class _Span(InputPartition):
    def __init__(self, since: int | None, until: int | None):
        self.since, self.until = since, until


class PagedRest(DataSource):
    """spark.read.format("paged_rest"): pages of a JSON API, each record a JSON text in column value; error is null.

    Options: url; page_size (100); size_name, page_name (limit, page); rows_name (data: the field that holds a page's records);
    since, until, chunk (epoch seconds: a partition for each chunk, sent as from and until), or edges, comma-separated numbers: a partition
    from each to the next, the last left out; params, other parameters as a query string
    such as maxPoints=1440; timeout. Pages are read until one is empty or short. With next_name, a page names the next one's URL
    in that field instead, and page numbers aren't sent. {"error": ...} raises, so that Spark retries the task; with
    on_error=report a chunk that fails is left out and gives one row, without a value, whose error tells its range and why.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        if "edges" in self.o:
            edges = [int(x) for x in self.o["edges"].split(",")]
            return [_Span(a, b) for a, b in zip(edges, edges[1:])]
        if "since" not in self.o:
            return [_Span(None, None)]
        since, until, width = int(self.o["since"]), int(self.o["until"]), int(self.o.get("chunk", 7200))
        return [_Span(a, min(a + width, until)) for a in range(since, until, width)]

    def read(self, partition: _Span) -> Iterator[tuple[str | None, str | None]]:
        if self.o.get("on_error") != "report":
            yield from self._rows(partition)
            return
        try:
            found = list(self._rows(partition))  # a chunk is kept whole or not at all
        except Exception as e:
            found = [(None, f"{partition.since}-{partition.until}: {e}")]
        yield from found

    def _rows(self, partition: _Span) -> Iterator[tuple[str, None]]:
        following, rows_name = self.o.get("next_name"), self.o.get("rows_name", "data")
        size, page = int(self.o.get("page_size", 100)), 0
        query = dict(urllib.parse.parse_qsl(self.o.get("params", ""))) | {self.o.get("size_name", "limit"): size}
        if partition.since is not None:
            query |= {"from": partition.since, "until": partition.until}
        url = f"{self.o['url']}?{urllib.parse.urlencode(query)}"
        while url:
            at = url if following else f"{url}&{urllib.parse.urlencode({self.o.get('page_name', 'page'): page})}"
            with urllib.request.urlopen(at, timeout=float(self.o.get("timeout", 30))) as r:
                body = json.load(r)
            if isinstance(body, dict) and body.get("error"):
                raise RuntimeError(f"the server answered: {body['error']}")
            rows = body[rows_name] if isinstance(body, dict) else body
            for x in rows or ():
                yield json.dumps(x, separators=(",", ":")), None
            if following:
                url = body.get(following)
            elif not rows or len(rows) < size:
                return
            page += 1


def _connect(options: dict[str, str]):
    return importlib.import_module(options["module"]).connect(**json.loads(options.get("connect", "{}")))


def statements(module: str, connect: dict, *sql: str) -> None:
    """Runs statements in a database with a Python driver, each committed by itself."""
    with_ = _connect({"module": module, "connect": json.dumps(connect)})
    try:
        for s in sql:
            with_.cursor().execute(s)
            with_.commit()
    finally:
        with_.close()


class Database(DataSource):
    """spark.read.schema(...).format("database") and df.write.format("database"): a database with a driver of Python's DB-API, which
    the tasks, not the driver, connect to.

    Options: module, the driver's; connect, its arguments as JSON. Reading: table, or a subquery `(SELECT ...) AS t` that the database
    filters, with columns of the schema's names; column, low, high and parts for as many ranges of a number, each a task's (first and last
    are open, nulls are in the first); batch (10,000 rows at a time). Writing: statement, with a mark for each column, run for batches of
    rows, one transaction a task. A task may run twice, so the statement should replace rows by key.
    """

    @classmethod
    def name(cls) -> str:
        return "database"

    def reader(self, schema) -> DataSourceReader:
        return _DatabaseReader(dict(self.options), schema)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _DatabaseWriter(dict(self.options))


class _DatabaseReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.o, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        if "column" not in self.o:
            return [_Span(None, None)]
        low, high, parts = int(self.o["low"]), int(self.o["high"]), int(self.o.get("parts", 8))
        edges = sorted({low + (high - low) * i // parts for i in range(1, parts)})
        return [_Span(a, b) for a, b in zip([None, *edges], [*edges, None])]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        column, a, b = self.o.get("column"), partition.since, partition.until
        parts = [*([f"{column} >= {a}"] if a is not None else []), *([f"{column} < {b}"] if b is not None else [])]
        where = f" WHERE {' AND '.join(parts)}" if parts else ""
        if parts and a is None:
            where += f" OR {column} IS NULL"
        connection, arrow = _connect(self.o), to_arrow_schema(self.schema)
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT {', '.join(self.schema.names)} FROM {self.o['table']}{where}")
            while rows := cursor.fetchmany(int(self.o.get("batch", 10_000))):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        finally:
            connection.close()


@dataclass
class _Written(WriterCommitMessage):
    rows: int


class _DatabaseWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def write(self, iterator) -> _Written:
        connection, n = _connect(self.o), 0
        try:
            cursor, rows = connection.cursor(), (tuple(r) for r in iterator)
            while some := list(islice(rows, int(self.o.get("batch", 3000)))):
                cursor.executemany(self.o["statement"], some)
                n += len(some)
            connection.commit()
        finally:
            connection.close()
        return _Written(n)


class BulkWhois(DataSource):
    """spark.read.format("bulk_whois"): the lines that a WHOIS server answers to a list of numbers, column value.

    Options: host, port (43), asns (comma-separated), batch (1000: numbers a connection, each a partition), timeout.
    """

    @classmethod
    def name(cls) -> str:
        return "bulk_whois"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _WhoisReader(dict(self.options))


class _Numbers(InputPartition):
    def __init__(self, asns: list[int]):
        self.asns = asns


class _WhoisReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        asns, width = [int(a) for a in self.o["asns"].split(",") if a.strip()], int(self.o.get("batch", 1000))
        return [_Numbers(asns[i : i + width]) for i in range(0, len(asns), width)] or [_Numbers([])]

    def read(self, partition: _Numbers) -> Iterator[tuple[str]]:
        for line in _asked(self.o["host"], int(self.o.get("port", 43)), partition.asns, float(self.o.get("timeout", 60))):
            yield (line,)


def _asked(host: str, port: int, asns: list[int], timeout: float) -> Iterator[str]:
    """The lines of the answer to so many numbers, over one connection."""
    if not asns:
        return
    with socket.create_connection((host, port), timeout=timeout) as s:
        s.sendall(("begin\nverbose\n" + "".join(f"AS{a}\n" for a in asns) + "end\n").encode())
        with s.makefile(encoding="utf-8", errors="replace") as answer:
            for line in answer:
                yield line.rstrip("\r\n")


def whois(numbers: DataFrame, host: str, port: int = 43, batch: int = 1000, timeout: float = 60) -> DataFrame:
    """The lines that a WHOIS server answers to the numbers of a table's first column, asked by the tasks that have them, so many a
    connection: column value. Nulls aren't asked for; a number that is there twice is asked for twice."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asns = (a for b in it for a in b.column(0).to_pylist() if a is not None)
        while some := list(islice(asns, batch)):
            yield pa.RecordBatch.from_arrays([pa.array(_asked(host, port, some, timeout), pa.string())], ["value"])

    return numbers.select(numbers.columns[0]).mapInArrow(run, "value string")
