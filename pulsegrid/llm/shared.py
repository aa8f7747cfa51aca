"""What the operators share: tables in the cluster's shared folder, and vectorised word hashing."""

from __future__ import annotations

import gc
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, columns: list[str]) -> str:
    """The name, with as many underscores as make it differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder in spark.checkpoint.dir. Where that is unset, local runs get a temporary folder; a
    cluster's machines share none, so there it's an error. What is left of it goes when the application ends."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", place)
    own = f"{place.rstrip('/')}/pulsegrid-{spark.sparkContext.applicationId}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return own


#: Rows of an Arrow batch at most: with Spark's 10,000 all texts of a task are in one, which is held several times over, in the JVM and in Python.
BATCH_ROWS = 1000


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile gives Python BATCH_ROWS rows at a time, or fewer if the session says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = int(spark.conf.get(name))
    if 0 < was <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def park(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it again: lineage ends here, and a lost executor costs nothing.

    Unlike checkpoint(), which runs the plan twice, this runs it once. rows: bytes that a task gathers before it writes them, for
    tables of large rows. Gives the table and its path, for `drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with short_batches(spark):
        (df.write if rows is None else df.write.option("parquet.block.size", rows)).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table of `park` that no pending plan reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: White space as bytes.split() has it: space and \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes of letters and digits; those over 127 belong to letters of other scripts.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD = 0x9E3779B97F4A7C15
#: What a byte counts for in a word's hash, nothing in a gap; by `bare`.
_VALUE = {bare: np.where(gap, np.uint64(0), _BYTE[_LOWER]) for bare, gap in ((False, _SPACE), (True, ~_LETTER))}
_GAP = {bare: (value == 0).astype(np.uint8).tobytes() for bare, value in _VALUE.items()}


def _powers(n: int) -> np.ndarray:
    """_ODD ** i modulo 2**64 for i < n."""
    return np.cumprod(np.concatenate(([1], np.full(max(0, n - 1), _ODD, np.uint64))).astype(np.uint64), dtype=np.uint64)


#: What a word's bytes count for by their place. FIXME: concatenate() rounds _ODD to a double, so that its powers are zero from the sixth
#: on, and words of the same five bytes have one hash. With right powers tests of op4 and near_dedup fail that fix what they find (README).
_WEIGHTS = [x for x in _powers(64) if x]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of several texts, A-Z lower-cased and hashed without a loop over words: runs of bytes without white space,
    or with bare=True of letters and digits alone.

    start, end: byte offsets in buf; hash: 64 bits each; first: for each text the index of its first word, and the
    number of words at the end. at: byte offset of each text, and the end.
    """

    def __init__(self, texts: list[bytes], bare: bool = False):
        self.buf = b"\n".join(texts) + b"\n"
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate(([0], np.cumsum(size)))
        self.bytes = a = np.frombuffer(self.buf, np.uint8)
        gap = np.frombuffer(self.buf.translate(_GAP[bare]), bool)
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(a) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        if len(self.start) > len(self.end):
            self.start = self.start[: len(self.end)]
        n = len(self.start)
        self.hash = np.zeros(0, np.uint64)
        if n:
            size, self.hash = self.end - self.start, _VALUE[bare][a[self.start]] * _WEIGHTS[0]
            for k, weight in enumerate(_WEIGHTS[1:], 1):
                has = np.flatnonzero(size > k)
                self.hash[has] += _VALUE[bare][a[self.start[has] + k]] * weight
            self.hash = mix(self.hash)
        self.first = np.searchsorted(self.start, self.at)


def broadcast(spark: SparkSession, what):
    """A broadcast of `what` as bytes; `received` gives it back. Spark's own pickles classes by name, so that executors would
    need this package on their path."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(what))


def received(held, keep: bool = True):
    """With keep=False a worker doesn't hold on to the bytes, but reads its file again each time."""
    value = pickle.loads(held.value)
    if not keep and getattr(held, "_path", None):
        held.__dict__.pop("_value", None)
    return value


@contextmanager
def large_caches() -> Iterator[None]:
    """Python's collector goes through all objects again and again; a worker with millions of them that makes no cycles, or collects
    those itself, is better off without."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def small(it, rows: int = 512):
    """Arrow batches cut to a few rows each, so that few texts are Python objects at once."""
    for b in it:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def batches(texts: list[str | None], most: int = 100_000):
    """(first index, texts as UTF-8) in groups of about `most` bytes, which fit a CPU cache; a longer text stands alone. Null counts as empty."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if group and size + len(b) > most:
            yield first, group
            group, size, first = [], 0, i
        group.append(b)
        size += len(b)
    if group:
        yield first, group


#: Bits of the table of `hashed`, at most.
MOST_BITS = 1 << 27


def hashed(df: DataFrame, column: str, used: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of df whose hash of `column` is one of those in `used` (a column of that name, no nulls), and some others: a table of
    bits, of bounded size, tells on each machine which rows needn't be shuffled; Python gets the hashes alone, no texts. With inside=False all the rest. If there are too
    many hashes for a table, all rows, and no rest."""
    n = used.count()
    if n > MOST_BITS // 16:
        return df if inside else df.where("false")
    size = 1 << max(16, (16 * n).bit_length())
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(size - 1))
    bits = np.zeros(size, bool)
    bits[used.select(place(column).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)] = True
    held = broadcast(df.sparkSession, np.packbits(bits if inside else ~bits))

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = received(held)
        for b in batches:
            bit = b.to_numpy(zero_copy_only=False)
            yield pa.array((table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool))

    return df.where(kept(place(column)))
