"""Small helpers on DataFrames."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.workspace import folder


def ensure(df: DataFrame, **columns: str) -> DataFrame:
    """df with the named columns; those that it lacks are null, of the type given."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def first_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row of each key, always the same: the one that is least over all other columns, nulls first.

    A struct's minimum is combined before the shuffle, unlike a window's row numbers.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ordered = all(t != "map" and not t.startswith("map<") for _, t in df.dtypes)
    if not ordered:
        w = Window.partitionBy(*keys).orderBy(F.to_json(F.struct(*rest)))
        return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def matched(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of `more`, null where it has no such keys; null equals null. Keys are unique in `more`."""
    b = more.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(b[f"__on_{k}"])
    return df.join(b, on, "left").drop(*(f"__on_{k}" for k in keys))


def running(df: DataFrame, order: list[Column | str], name: str, of: Column | str | None = None) -> DataFrame:
    """df with the sum of `of` (without it, the number of rows) over all rows before each in an order over the whole table.

    Rows are dealt out by ranges of the order, written once, summed by range, and the ranges' sums, one number for each task of
    that shuffle, are added up in the driver. No task has more than its range; rows that are equal in all of `order` can't be
    parted, so it should name a key last.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, "ordered")
    df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    one = F.lit(1) if of is None else F.col(of) if isinstance(of, str) else of
    sums = {r["__range"]: r.n for r in rows.groupBy("__range").agg(F.sum(one).cast("long").alias("n")).collect()}
    last = max(sums, default=0)
    before = list(accumulate((sums.get(i, 0) for i in range(last)), initial=0))
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(one).over(w), F.lit(0)).cast("long") + F.element_at(F.lit(before).cast("array<long>"), F.col("__range") + 1)).drop("__range")


def naive(df: DataFrame) -> DataFrame:
    """Timestamps as UTC wall-clock time without a zone."""
    return df.withColumns({c: F.col(f"`{c}`").cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(f"`{c}`", places) for c, t in df.dtypes if t == "double"})
