"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text with features x is sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pair sum costs time
linear in the number of features, by the identity sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 -
sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import Words, batches, drop, free, hashed, park, shared_dir, small

BUCKETS = 1 << 16
RANK = 8
#: Full-batch rounds of the fit, each a pass over all labelled rows.
ROUNDS = 60
#: Up to so many labelled rows each round takes all of them. More are dealt into shares of about as many, MOST_SHARES at most, that the
#: rounds take in turn: every row counts in equally many rounds.
SHARE_ROWS, MOST_SHARES = 6000, 12
#: Labelled rows of a task of a round, and how many such tasks a round has at most: the driver gets a gradient of each.
TASK_ROWS, MOST_TASKS = 3000, 16
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _SPACE, _PUNCTUATION, _SYMBOL, _HIGH = range(7)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[128:] = _HIGH
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LOWER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = _PUNCTUATION
N_DENSE = 16


def features(texts: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse words and dense statistics of several texts: first (offsets into the next two), bucket, value, dense.

    A word's value is 1 + log(times), over the norm of all. n_chars is the table's metadata, NaN where it has none.
    """
    w = Words(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(w.first))
    keys, times = np.unique((doc.astype(np.int64) << 16) | (w.hash >> np.uint64(48)).astype(np.int64), return_counts=True)
    bucket, of = (keys & (BUCKETS - 1)).astype(np.int32), keys >> 16
    value = 1 + np.log(times)
    value /= np.sqrt(np.bincount(of, value * value, n))[of]
    first = np.searchsorted(of, np.arange(n + 1))

    kinds = _CLASS[w.bytes]
    counts = np.stack([np.add.reduceat((kinds == k).astype(np.int64), w.at[:-1]) for k in range(7)], axis=1).astype(float)
    counts[:, _SPACE] -= 1  # the separator
    size = np.maximum(1, counts.sum(axis=1))
    words = np.diff(w.first).astype(float)
    distinct = np.diff(first).astype(float)
    lines = np.add.reduceat((w.bytes == 10).astype(np.int64), w.at[:-1]).astype(float)
    length = w.end - w.start
    per_word = np.bincount(doc, length, n) / np.maximum(1, words)
    short = np.bincount(doc, length <= 3, n) / np.maximum(1, words)
    bare = np.bincount(doc, (kinds[w.start] >= _PUNCTUATION) & (kinds[w.start] != _HIGH), n) / np.maximum(1, words)
    odd = np.bincount(doc, kinds[np.maximum(w.end - 1, 0)] == _SYMBOL, n) / np.maximum(1, words)
    shares = counts / size[:, None]
    known = np.where(np.isfinite(n_chars), n_chars, size)
    dense = np.column_stack([shares, np.log1p(size), np.log1p(np.maximum(0, known)), np.log1p(words), distinct / np.maximum(1, words), lines / np.maximum(1, words) * 10, per_word, short, bare, odd])
    return first, bucket, value.astype(np.float32), dense


@dataclass
class Machine:
    """w, v: weights and factors of the buckets, then of the dense features; mean, scale: how those are standardised."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -4, 4) / 4

    def score(self, first: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(first, bucket, value, self.standard(dense))[0], -30, 30)))

    def margin(self, first: np.ndarray, bucket: np.ndarray, value: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the sigmoid, and each text's sum_i v_i x_i."""
        v_words, v_dense = self.v[:BUCKETS], self.v[BUCKETS:]
        part = v_words[bucket] * value[:, None]
        total = _sums(part, first) + x @ v_dense
        square = _sums(part * part, first) + (x * x) @ (v_dense * v_dense)
        linear = _sums((self.w[bucket] * value)[:, None], first)[:, 0] + x @ self.w[BUCKETS:]
        return self.bias + linear + 0.5 * (total * total - square).sum(axis=1), total


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows[first[i]:first[i + 1]]; zero where that is empty."""
    out = np.zeros((len(first) - 1, rows.shape[1]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(rows, first[full], axis=0, dtype=float)
    return out


def gradient(m: Machine, first: np.ndarray, bucket: np.ndarray, value: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over rows of the logistic loss's gradient: the buckets that occur; for these and then the standardised dense features a row
    each of the weight's and the factors'; the bias's."""
    used, small = np.unique(bucket, return_inverse=True)
    of = np.repeat(np.arange(len(y)), np.diff(first))
    z, total = m.margin(first, bucket, value, x)
    g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
    row = g[of] * value
    weight = np.bincount(small, row * value, len(used))
    out = np.empty((len(used) + N_DENSE, 1 + RANK))
    out[: len(used), 0] = np.bincount(small, row, len(used))
    for f in range(RANK):
        out[: len(used), 1 + f] = np.bincount(small, row * total[of, f], len(used)) - weight * m.v[used, f]
    out[len(used) :, 0] = g @ x
    out[len(used) :, 1:] = (x * g[:, None]).T @ total - (x * x * g[:, None]).sum(axis=0)[:, None] * m.v[BUCKETS:]
    return used, out, g.sum()


class Adam:
    """The machine's next state from the mean gradient, with a little weight decay; moments of fixed size."""

    def __init__(self, m: Machine):
        self.m, self.t = m, 0
        self.moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (m.w, m.v)]
        self.bias_moments = [0.0, 0.0]

    def step(self, gw: np.ndarray, gv: np.ndarray, bias: float) -> None:
        m, self.t = self.m, self.t + 1
        one, two = 1 - 0.9**self.t, 1 - 0.999**self.t
        for theta, grad, (a, b) in zip((m.w, m.v), (gw, gv), self.moments):
            grad += 1e-5 * theta
            a += 0.1 * (grad - a)
            b += 0.001 * (grad * grad - b)
            theta -= 0.05 * (a / one) / (np.sqrt(b / two) + 1e-8)
        c = self.bias_moments
        c[0] += 0.1 * (bias - c[0])
        c[1] += 0.001 * (bias**2 - c[1])
        m.bias -= 0.05 * (c[0] / one) / (np.sqrt(c[1] / two) + 1e-8)


def _stored(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, bucket, value, dense and y of rows of binary columns bucket, value, dense, and y."""
    bucket, value, dense = ([np.frombuffer(x, kind) for x in b.column(k).to_pylist()] for k, kind in enumerate((np.int32, np.float32, float)))
    first = np.concatenate(([0], np.cumsum([len(x) for x in bucket]))).astype(np.int64)
    return first, np.concatenate(bucket), np.concatenate(value), np.array(dense).reshape(-1, N_DENSE), (b.column(3).to_numpy() > 0).astype(float)


def _moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows: how many, how many of label 1, means and squared deviations of the dense features."""
    n, ones, mean, square = 0, 0.0, np.zeros(N_DENSE), np.zeros(N_DENSE)
    for b in small(it):
        *_, dense, y = _stored(b)
        n, mean, square = _pooled(n, mean, square, len(y), dense.mean(axis=0), dense.var(axis=0) * len(y))
        ones += y.sum()
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([ones]), pa.array([mean.tobytes()]), pa.array([square.tobytes()])], ["n", "ones", "mean", "square"])


def _pooled(n: int, mean: np.ndarray, square: np.ndarray, k: int, other_mean: np.ndarray, other_square: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    if k == 0:
        return n, mean, square
    d = other_mean - mean
    return n + k, mean + d * (k / (n + k)), square + other_square + d * d * (n * k / (n + k))


def fit(rows: DataFrame, shares: int, rounds: int = ROUNDS) -> Machine:
    """Logistic loss over all rows (bucket, value, dense: binary; y; share), Adam. Each round is a job over all rows of a share, whose
    tasks send sums of their rows' gradients, of bounded size whatever the rows; the same stored rows give the same machine."""
    spark, columns = rows.sparkSession, ["bucket", "value", "dense", "y"]
    n, ones, mean, square = 0, 0.0, np.zeros(N_DENSE), np.zeros(N_DENSE)
    for r in rows.select(*columns).mapInArrow(_moments, "n long, ones double, mean binary, square binary").where("n > 0").toLocalIterator():
        n, mean, square = _pooled(n, mean, square, r.n, np.frombuffer(r.mean), np.frombuffer(r.square))
        ones += r.ones
    if n == 0:
        return Machine(0.0, np.zeros(BUCKETS + N_DENSE), np.zeros((BUCKETS + N_DENSE, RANK)), np.zeros(N_DENSE), np.ones(N_DENSE))
    share = float(np.clip(ones / n, 0.01, 0.99))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(BUCKETS + N_DENSE), np.random.default_rng(7).normal(0, 0.05, (BUCKETS + N_DENSE, RANK)), mean, np.sqrt(square / n) + 1e-6)
    adam = Adam(m)
    for t in range(rounds):
        held = spark.sparkContext.broadcast((m.bias, m.w, m.v, m.mean, m.scale))

        def part(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m, out, n, bias = Machine(*held.value), np.zeros((BUCKETS + N_DENSE, 1 + RANK)), 0, 0.0
            for b in small(it):
                first, bucket, value, dense, y = _stored(b)
                used, sums, g = gradient(m, first, bucket, value, m.standard(dense), y)
                out[used] += sums[: len(used)]
                out[BUCKETS:] += sums[len(used) :]
                n, bias = n + len(y), bias + g
            some = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([float(bias)]), pa.array([some.astype(np.int32).tobytes()]), pa.array([out[some].astype(np.float32).tobytes()])], ["n", "bias", "at", "sums"])

        total, n, bias = np.zeros((BUCKETS + N_DENSE, 1 + RANK)), 0, 0.0
        for r in rows.where(F.col("share") == t % shares).select(*columns).mapInArrow(part, "n long, bias double, at binary, sums binary").collect():  # a row for each of a few tasks
            total[np.frombuffer(r.at, np.int32)] += np.frombuffer(r.sums, np.float32).reshape(-1, 1 + RANK)
            n, bias = n + r.n, bias + r.bias
        held.destroy()
        if n:
            total /= n
            adam.step(total[:, 0].copy(), total[:, 1:].copy(), bias / n)
    return m


def _meta(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _plain(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fits on all labelled rows that aren't held out.

    Rows without a doc_id, text or quality aren't used; of several labels of a document the higher counts, of several rows of a document
    one. No usable row at all gives a machine that scores every text 0.5.
    """
    truth = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    truth, truth_path = park(truth, "labels")
    n = truth.count()
    shares, tasks = min(MOST_SHARES, max(1, n // SHARE_ROWS)), min(MOST_TASKS, max(1, n // TASK_ROWS))
    usable = _plain(docs).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    def sparse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            for k, texts in batches(b.column(1).to_pylist()):
                first, bucket, value, dense = features(texts, _meta(b, 2)[k : k + len(texts)])
                cut = [slice(first[i], first[i + 1]) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[k : k + len(texts)], pa.array([bucket[c].tobytes() for c in cut], pa.binary()), pa.array([value[c].tobytes() for c in cut], pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary())],
                    ["doc_id", "bucket", "value", "dense"],
                )

    # Of texts without a label few are looked at, and none is shuffled: only features are.
    each = hashed(usable, "doc_id", truth.select("doc_id")).mapInArrow(sparse, "doc_id long, bucket binary, value binary, dense binary").join(truth, "doc_id")
    one = each.groupBy("doc_id").agg(F.min(F.struct("dense", "bucket", "value", "y")).alias("r")).select("doc_id", "r.*")
    path = f"{shared_dir(docs.sparkSession)}/fit-{uuid.uuid4().hex}"
    dealt = one.withColumns({"share": F.pmod(F.xxhash64("doc_id"), F.lit(shares)).cast("int"), "task": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(tasks))})
    dealt.repartition(tasks, "task").sortWithinPartitions("share", "doc_id").drop("task").write.partitionBy("share").parquet(path)
    drop(docs.sparkSession, truth_path)
    stored = docs.sparkSession.read.schema("doc_id long, dense binary, bucket binary, value binary, y double, share int").parquet(path)
    machine = fit(stored, shares)
    drop(docs.sparkSession, path)
    return machine


def scores(docs: DataFrame, machine: Machine, keep: list[str], name: str = "quality_score") -> DataFrame:
    """The columns `keep` of docs and the score (0 to 1), under a name that isn't among them, of every whole text; null and empty texts are scored by their
    statistics alone. One pass, nothing shuffled; the machine has a fixed size."""
    fields = {f.name: f for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    held = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v.astype(np.float32), machine.mean, machine.scale))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*held.value)
        for b in small(it):
            got, n = np.zeros(b.num_rows), _meta(b, b.num_columns - 1)
            for k, texts in batches(b.column(b.num_columns - 2).to_pylist()):
                got[k : k + len(texts)] = m.score(*features(texts, n[k : k + len(texts)]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(got)], [*keep, name])

    own = [F.col("text").alias(free("__text", keep)), n_chars.alias(free("__n", keep))]
    return docs.select(*(F.col(f"`{c}`") for c in keep), *own).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Repeated rows are scored alike; a null doc_id isn't held out; ties at the threshold count as 1; an empty table gives an
    empty one; other columns, lang and source among them, are not looked at.
    """
    found = scores(_plain(docs), train(docs, labels), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
