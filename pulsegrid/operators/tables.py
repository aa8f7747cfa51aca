"""Partitioned Parquet tables: scans with pruning, overwrites of single partitions, keyed upserts, incremental roll-ups.

Tables of `upsert` are versioned (see versions.py); `read`, `count` and `exists` take both kinds.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.operators import versions

DAY = ["year", "month", "day"]


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return versions.current(spark, path) is not None if versions.versioned(spark, path) else fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def read(spark: SparkSession, path: str, schema: StructType | None = None, where: Column | None = None) -> DataFrame | None:
    """The table, pruned by a predicate on partition columns; None where there's no such path or no version yet."""
    try:
        df = versions.read(spark, path) if versions.versioned(spark, path) else (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "Unable to infer schema")):
            return None
        raise
    return df if where is None or df is None else df.where(where)


def day_range(since: dt.date, until: dt.date) -> Column:
    """Predicate for partitions of [since, until), whatever type their columns are read with."""
    number = F.col("year").cast("int") * 10000 + F.col("month").cast("int") * 100 + F.col("day").cast("int")
    return (number >= int(since.strftime("%Y%m%d"))) & (number < int(until.strftime("%Y%m%d")))


def days(spark: SparkSession, since: dt.date, until: dt.date) -> DataFrame:
    """day, path of each day of [since, until)."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(since), F.lit(until - dt.timedelta(days=1)), F.expr("INTERVAL 1 DAY"))).alias("day")) if since < until else spark.range(0).select(F.lit(since).alias("day"))
    return one.select("day", F.date_format(F.col("day").cast("timestamp"), "'year='yyyy'/month='MM'/day='dd").alias("path"))


def partitions(df: DataFrame, before: dt.date | None = None, by: list[str] | None = None) -> DataFrame:
    """The partitions that there are, in order; of partitions by day, those from `before` on left out."""
    by = DAY if by is None else by
    out = df.select(*by).distinct()
    if before is not None:
        out = out.where(day_range(dt.date(1, 1, 1), before))
    return out.orderBy(*(F.col(c).cast("int") for c in by))


def listed(spark: SparkSession, path: str, by: list[str] | None = None, before: dt.date | None = None) -> DataFrame:
    """`partitions` of a table from the names of its folders: nothing of its data is read, and folders of days from `before` on
    aren't looked into. One row for each partition."""
    by = DAY if by is None else by
    last = None if before is None else [before.year, before.month, before.day][: len(by)]
    found: list[list[str]] = [[]]
    for i, name in enumerate(by):
        deeper = []
        for values in found:
            where, fs = _path(spark, "/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in zip(by, values))]))
            here = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []
            deeper += [[*values, v] for v in (n.removeprefix(f"{name}=") for n in here if n.startswith(f"{name}="))]
        found = [v for v in deeper if last is None or [int(x) for x in v] <= last[: i + 1]]
    found = [v for v in found if last is None or [int(x) for x in v] < last]
    out = spark.createDataFrame(found, StructType.fromDDL(", ".join(f"`{c}` string" for c in by)))
    return out.orderBy(*(F.col(c).cast("int") for c in by))


def count(spark: SparkSession, path: str) -> int:
    """Rows of a table, none where there's no table."""
    df = read(spark, path)
    return 0 if df is None else df.count()


def overwrite(df: DataFrame, path: str, by: list[str] | None = None, cluster: list[str] | None = None) -> None:
    """Replaces the partitions that df has, no others. Rows are dealt by partition, and by `cluster` within, so that files are
    few; Spark splits what's too large."""
    by = DAY if by is None else by
    rows = df.hint("rebalance", *by, *(cluster or [])) if by else df
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge(old: DataFrame | None, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """new over old by keys: old rows without a match stay; columns in `keep` hold on to the old value where there's one.

    Keys are compared null-safely. Rows of new must be unique by key.
    """
    if old is None:
        return new
    a, b = old.alias("a"), new.alias("b")
    rest = a.join(b, _all(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys), "left_anti").select(*new.columns)
    if not keep:
        return rest.unionByName(new)
    held = a.select(*(F.col(f"a.{k}").alias(f"__{k}") for k in keys), F.lit(True).alias("__had"), *(F.col(f"a.{c}").alias(f"__old_{c}") for c in keep))
    both = new.join(held, _all(new[k].eqNullSafe(held[f"__{k}"]) for k in keys), "left")
    return rest.unionByName(both.select(*(F.when(F.col("__had"), F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns)))


def _all(parts) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def adopt(spark: SparkSession, stage: str, path: str, tag: str, depth: int) -> None:
    """Moves the files of a staged table, so many partition columns deep, into the partitions of another, under names that begin with
    tag; files of an earlier attempt, which have the same, go first. The names are listed in the driver: a batch has few files."""
    where, fs = _path(spark, stage)
    where = fs.makeQualified(where)
    folders = [where]
    for _ in range(depth):
        folders = [s.getPath() for f in folders for s in fs.listStatus(f) if s.isDirectory()]
    for f in folders:
        target, _ = _path(spark, f"{path.rstrip('/')}/{where.toUri().relativize(f.toUri()).getPath()}")
        fs.mkdirs(target)
        for s in fs.listStatus(target):
            if s.getPath().getName().startswith(tag):
                fs.delete(s.getPath(), False)
        for s in fs.listStatus(f):
            name = s.getPath().getName()
            if not name.startswith((".", "_")) and not fs.rename(s.getPath(), _path(spark, f"{target.toString()}/{tag}{name}")[0]):
                raise OSError(f"{s.getPath()} can't be moved to {target}")
    fs.delete(where, True)


def upsert(
    new: DataFrame, path: str, keys: list[str], day: str | None = None, keep: list[str] = (), retract: Column | None = None, span: tuple[dt.date | None, dt.date | None] | None = None, batch: tuple[str, int] | None = None, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None
) -> int:
    """Merges new into the versioned table at path; gives the number of rows of new.

    The table is partitioned by `__day`, the date of column `day`: only days that new touches are read and written again, into a
    folder of their own, and one new version makes them count. A crash at any time leaves the version before. Writers may run at
    once: one that finds others' days changed keeps them, and merges anew where they are its own. retract: old rows of
    the touched days that this holds for go unless new has them; with span, days of [since, until) count as touched too (None:
    no bound). batch: a writer's name and this batch's number; one that the table has seen adds nothing. combine(old, new) merges
    instead of keys and keep.
    """
    spark, root = new.sparkSession, path.rstrip("/")
    if batch is not None and (seen := versions.current(spark, root)) is not None and seen.seen(batch):
        return 0
    stage = f"{root}.staging-{uuid.uuid4().hex}"
    rows = new.withColumn("__day", F.to_date(day) if day else F.lit(None).cast("date"))
    rows.write.parquet(stage)
    try:
        fresh = spark.read.schema(rows.schema).parquet(stage)
        counts = fresh.groupBy("__day").agg(F.count("*")).collect()  # a row for each day
        touched = {r[0] for r in counts}
        while not _merged(spark, root, fresh, touched, combine or (lambda old, rows: merge(old, rows, keys, list(keep))), retract, span, batch):
            pass
    finally:
        remove(spark, stage)
    return sum(r[1] for r in counts)


def _merged(spark: SparkSession, root: str, fresh: DataFrame, touched: set[dt.date | None], combine, retract: Column | None, span, batch) -> bool:
    """One attempt of upsert; False if another writer has changed the same days meanwhile."""
    base = versions.current(spark, root)
    if base is not None and base.seen(batch):
        return True
    days = {versions.day(d) for d in touched}
    if base is not None and retract is not None and span is not None:
        low, high = (None if d is None else d.isoformat() for d in span)
        days |= {d for d in base.days if d != versions.NONE and (low is None or d >= low) and (high is None or d < high)}
    out = fresh
    if base is not None and days & set(base.days):
        old = versions.read(spark, root, base, days)
        out = combine((old if retract is None else old.where(~F.coalesce(retract, F.lit(False)))).select(*fresh.columns), fresh)
    name, written = versions.write(out, root)
    while not versions.publish(spark, root, versions.replaced(base, days, name, written, fresh.schema.json(), batch)):
        other = versions.current(spark, root)
        if other.seen(batch) or retract is not None or versions.changed(other.days, {} if base is None else base.days) & days:
            versions.drop(spark, root, name)
            return other.seen(batch)
        base = other
    return True


def refresh(source: DataFrame, path: str, build, time: str, since: dt.date, until: dt.date) -> None:
    """Recomputes the roll-up `build(rows)` for the days of [since, until) and replaces just those; a day that has no rows any
    more goes.

    build's result must have `time` again as its own day or hour column under the name that build gives it first.
    """
    rows = source.where((F.col(time) >= F.lit(since).cast("timestamp")) & (F.col(time) < F.lit(until).cast("timestamp")))
    out = build(rows)
    overwrite(out.withColumn("__day", F.to_date(out.columns[0])), path, by=["__day"])
    left = {r[0] for r in out.select(F.to_date(out.columns[0])).distinct().toLocalIterator()}  # a row for each day of the range
    for i in range((until - since).days):
        if since + dt.timedelta(days=i) not in left:
            remove(source.sparkSession, f"{path.rstrip('/')}/__day={since + dt.timedelta(days=i)}")
