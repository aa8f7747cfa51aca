"""Substring dedup by content-defined chunking.

A gear hash rolls over each text's UTF-8 bytes, and a chunk ends where the hash is less than at any place within NEAR bytes
on either side. Such ends depend on the 32 + 2 * NEAR bytes around them and on nothing else, not even on where the chunk
before has ended, so that an insertion moves no more than the chunks around it and lengths vary little. Chunks are counted
by digest over the corpus; runs of neighbouring chunks that other documents have too are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import free, park

#: A chunk has more than NEAR bytes (a power of two), twice as many on average, and MOST at most (but for the rest of a character).
NEAR, MOST = 16, 256
#: A run is reported whose passage has about so many words. It is longer than the run: the chunks at both ends aren't repeated
#: as they reach out of it, which costs LOST characters on average, or as many words as the run has in so many characters.
MIN_WORDS, LOST = 38, 64

_GEAR = np.random.default_rng(20240601).integers(0, 2**32, 256, dtype=np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear(a: np.ndarray) -> np.ndarray:
    """At each byte the hash sum(gear[a[i - j]] << j for j < 32) modulo 2**32, by doubling the window five times."""
    h = _GEAR[a]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def cuts(raw: bytes) -> np.ndarray:
    """Where chunks end, the text's end included; always between characters."""
    a = np.frombuffer(raw, np.uint8)
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    starts = (a & 0xC0) != 0x80
    top = np.iinfo(np.uint32).max
    h = np.full(n + 2 * NEAR, top)
    h[NEAR:-NEAR] = gear(a)
    h[NEAR : n + NEAR - 1][~starts[1:]] = top
    low, k = h, 1  # low[i]: least of k values from i on
    while k < NEAR:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    own, before, after = h[NEAR:-NEAR], low[:n], low[NEAR + 1 : NEAR + 1 + n]
    out = np.flatnonzero((own < before) & (own < after)) + 1
    out = np.concatenate(([0], out[(out > NEAR) & (out < n)], [n]))
    wide = np.flatnonzero(np.diff(out) > 4 * NEAR)
    if len(wide):
        # A short text over and over has no place that is less than all others near it, but it has some that equal the least.
        level = np.flatnonzero((own <= before) & (own <= after) & (own < top)) + 1
        more = []
        for i in wide.tolist():
            at, end = int(out[i]), int(out[i + 1])
            for e in [*level[np.searchsorted(level, at + 1) : np.searchsorted(level, end)].tolist(), end]:
                while e - at > MOST:
                    at += MOST
                    while at < end and not starts[at]:
                        at += 1
                    more.append(min(at, end))
                if e - at >= 2 * NEAR and e < end:
                    more.append(e)
                    at = e
        out = np.unique(np.concatenate((out, np.array(more, np.int64))))
    return out[1:]


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """digest, start and length in code points, number of words that begin, of each chunk of a whole text."""
    raw = (text or "").encode()
    ends = cuts(raw)
    if not len(ends):
        return (np.zeros(0, np.int64),) * 4
    a = np.frombuffer(raw, np.uint8)
    edge = np.concatenate(([0], ends))
    point = np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))
    gap = _SPACE[a]
    begins = ~gap
    begins[1:] &= gap[:-1]
    word = np.concatenate(([0], np.cumsum(begins)))
    digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(edge[:-1].tolist(), ends.tolist())), np.uint64, len(ends))
    return digest.view(np.int64), point[edge[:-1]], np.diff(point[edge]), np.diff(word[edge])


def _doc() -> F.Column:
    """A number for each document: its doc_id; for a row without one a number of its text, below all doc_ids of any use."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)) + F.xxhash64("text").bitwiseAND(F.lit(2**61 - 1)))


#: What is below this is no doc_id.
_NO_ID = -(2**63) + 2**61


def chunk_rows(docs: DataFrame) -> DataFrame:
    """digest, doc, version, at of every chunk; version is a hash of the whole text, `at` packs start (28 bits), length and words
    (10 each)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first in range(0, b.num_rows, 500):
                parts = []
                rows = (b.column(k)[first : first + 500].to_pylist() for k in range(3))
                for doc, version, text in zip(*rows):
                    digest, start, length, words = chunks(text)
                    parts.append((digest, np.full(len(digest), doc), np.full(len(digest), version), start << 20 | length << 10 | words))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)], ["digest", "doc", "version", "at"])

    return docs.select(_doc().alias("doc"), F.xxhash64("text").alias("version"), "text").mapInArrow(run, "digest long, doc long, version long, at long")


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, version, start, end (code points), n_words, first_doc of every run of chunks that other documents have too.

    first_doc: the smallest doc that has one of the run's chunks. Chunks are summed by digest before they are shuffled; the
    join that brings the counts back has only repeated digests on its small side, and Spark splits a digest that is too
    frequent for a task.
    """
    rows, _ = park(chunk_rows(docs), "chunks")
    seen = rows.groupBy("digest").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    seen, _ = park(seen.where("first_doc < last_doc").select("digest", "first_doc"), "repeated")
    hit = rows.join(seen, "digest").select(
        "doc",
        "version",
        F.shiftright("at", 20).alias("start"),
        F.shiftright("at", 10).bitwiseAND(F.lit(1023)).alias("length"),
        F.col("at").bitwiseAND(F.lit(1023)).alias("words"),
        "first_doc",
    )
    w = Window.partitionBy("doc", "version").orderBy("start")
    reached = F.max(F.col("start") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    again = F.coalesce(F.lag("start").over(w) == F.col("start"), F.lit(False))  # a repeated row's chunk
    isle = hit.withColumns({"fresh": F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)), "words": F.when(again, 0).otherwise(F.col("words"))})
    isle = isle.withColumn("isle", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = isle.groupBy("doc", "version", "isle").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.sum("words").alias("n_words"), F.min("first_doc").alias("first_doc"))
    chars = F.col("end") - F.col("start")
    return found.where(F.col("n_words") * (chars + LOST) >= min_words * chars).drop("isle")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_runs, n_chars, spans, first_doc_ids of every document with a passage that another document has too.

    spans: start:end in code points, joined by commas in order; first_doc_ids: for each span the smallest doc_id that has
    part of it, which may be this one. Rows of one doc_id are versions of one document, a result each: what only they share is
    no repeat. Rows without a doc_id are documents of their own, which come before all others and are null in first_doc_ids.
    Null and empty texts have no chunks. Repeated rows count once. An empty table gives an empty one. Other columns are not
    looked at.
    """
    found = runs(docs, min_words).groupBy("doc", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_doc"))).alias("r"))
    known = lambda c: F.when(c >= F.lit(_NO_ID), c)
    return found.select(
        known(F.col("doc")).alias("doc_id"),
        F.size("r").cast("long").alias("n_runs"),
        F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_chars"),
        F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        F.transform("r", lambda x: known(x["first_doc"])).alias("first_doc_ids"),
    )


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs; of each repeated passage only the occurrence in the smallest doc_id keeps its text."""
    later = runs(docs, min_words).where("first_doc < doc").groupBy("doc", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    at, names = docs.columns.index("text"), docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = []
            for t, gone in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                keep, last = [], 0
                for span in gone or ():
                    keep.append(t[last : span["start"]])
                    last = span["end"]
                text.append("".join(keep) + t[last:] if gone else t)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(text, pa.string()), *b.columns[at + 1 : -1]], names)

    doc, number, cut = (free(n, docs.columns) for n in ("__doc", "__version", "__cut"))
    keyed = docs.withColumns({doc: _doc(), number: F.xxhash64("text")})
    joined = keyed.join(later.withColumnsRenamed({"doc": doc, "version": number, "__cut": cut}), [doc, number], "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), cut).mapInArrow(run, docs.schema)
