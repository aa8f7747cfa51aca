"""SimHash near-duplicates: fingerprints meet at the words of a covering code.

The code is the product of the perfect Hamming code on bits 1 to 63 and of both values of bit 0. Its covering radius is
one: every 64-bit value lies within one bit of a code word. If two fingerprints differ in two bits or fewer, some value
lies within one bit of both, and the code word next to that value lies within 1 + 1 bits of both. So it's enough to
replicate each fingerprint to the anchors within the covering radius plus half the threshold on either side (33 anchors
at most), instead of the radius plus all of it on one side (some 680), with the same guarantee. Fingerprints at an
anchor are distinct and within two bits of it, so no anchor ever has more than 2,081, whatever the data: no hot bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import Words, batches, drop, free, hashed, mix, park, small

THRESHOLD = 2
SHINGLE = 3
#: Fingerprints of a task when they are replicated: each is spread to 33 rows, so that the size of what is read tells little.
TASK_ROWS = 20_000
#: Bands of MinHashes for likeness by Jaccard: two texts of likeness 0.8 share none of 32 bands of 5 in 3 of a million cases.
BANDS, BAND = 32, 5
#: Bytes of shingles' hashes of a key that a task compares.
KEY_BYTES = 16 << 20


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeated ones too; one of fewer words is a single shingle, one of none has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(line, 42)], np.uint64)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    begins = [0] + [x + 1 for x in ends[: n - 1]]
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :])), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text; null counts as empty, and empty texts give zero."""
    return _majority(shingles(text, shingle))


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def digest() -> F.Column:
    """128 bits that stand for a text: of 10^11 texts no two are likely to share them. Null counts as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, digest (of the text), fp (the 64 bits as a signed long) of every row; one pass, nothing shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["doc_id", "digest", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest().alias("digest")).mapInArrow(run, "doc_id long, digest binary, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """For each value the XOR of the numbers (1 to 63) of its set bits: zero for a word of the Hamming code."""
    s = np.zeros(len(x), np.int64)
    for k in range(6):
        mask = np.uint64(sum(1 << i for i in range(1, 64) if i >> k & 1))
        s |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << k
    return s


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, code word) for every code word within two bits.

    With syndrome s, the word next to x is x with bit s flipped; the words at two bits are x with bits i and i^s flipped,
    and, over the free bit 0, the next word with bit 0 flipped. A value that is itself a code word has, within two bits,
    only itself and its twin over bit 0.
    """
    s = _syndrome(fp)
    one = np.uint64(1)
    home = np.where(s == 0, fp, fp ^ (one << s.astype(np.uint64)))
    index, word = [np.arange(len(fp))] * 2, [home, home ^ one]
    off = np.flatnonzero(s)
    for i in range(1, 64):
        j = s[off] ^ i
        use = off[(j > i) & (j != 0)]
        j = (s[use] ^ i).astype(np.uint64)
        index.append(use)
        word.append(fp[use] ^ (one << np.uint64(i)) ^ (one << j))
    return np.concatenate(index), np.concatenate(word)


def _spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        fp = b.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(fp), 20_000):
            part = fp[k : k + 20_000]
            i, word = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(part[i].view(np.int64))], ["anchor", "fp"])


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor's fingerprints (2,081 at most), a spanning forest of the links among them."""
    for b in it:
        left, right = [], []
        for row in b.column(0):
            x = np.unique(np.asarray(row.values).view(np.uint64))
            if len(x) < 2:
                continue
            todo = np.ones(len(x), bool)
            while todo.any():  # breadth first: each fingerprint is reached once
                front = np.array([np.flatnonzero(todo)[0]])
                todo[front] = False
                while len(front):
                    rest = np.flatnonzero(todo)
                    near = np.bitwise_count(x[rest][:, None] ^ x[front][None, :]) <= THRESHOLD
                    hit = near.any(axis=1)
                    left.append(x[front][near[hit].argmax(axis=1)])
                    right.append(x[rest[hit]])
                    front = rest[hit]
                    todo[front] = False
        a = np.concatenate([np.zeros(0, np.uint64), *left]).view(np.int64)
        c = np.concatenate([np.zeros(0, np.uint64), *right]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all within two bits of each other: of the links at an anchor
    it has a spanning forest, so their number is bounded by the replicas, not by the square of a group. Fingerprints are dealt out
    by turns before they are replicated: dealt by their value, as they lie after distinct(), Spark would leave them where they are."""
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(fps.count() / TASK_ROWS))
    spread = fps.select("fp").distinct().repartition(tasks).mapInArrow(_spread, "anchor long, fp long")
    met = spread.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select("fps").mapInArrow(_compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) for every node of an edge.

    Min-label propagation with pointer jumping. Each round's labels are a written table, so the plan stays short; rounds
    grow with the logarithm of a component's diameter.
    """
    spark = edges.sparkSession
    both, kept = park(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    now, path = park(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    while True:
        seen = both.join(now.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        hop = now.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new, new_path = park(hop.join(jump, "root", "left").select("node", F.least("root", "over").alias("root"), (F.least("root", "over") != F.col("was")).alias("moved")), "roots")
        more = new.where("moved").limit(1).count()
        drop(spark, path)
        now, path = new.drop("moved"), new_path
        if not more:
            drop(spark, kept)
            return now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, digest (of the text), fp, root (the component's smallest fingerprint), component_id for every row of docs.

    component_id is the smallest doc_id that the row's fingerprint reaches over links of at most two bits. Null and empty
    texts have fingerprint zero and link like any other; a null doc_id never names a component unless it stands alone;
    repeated rows stay; an empty table gives an empty one. Other columns are not looked at.
    """
    fps, _ = park(fingerprints(docs, shingle), "fingerprints")
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    root = components(links(fps))
    named = low.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    top = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of, _ = park(named.join(top, "root").select("fp", "root", "component_id"), "components")
    return fps.join(of, "fp").select("doc_id", "digest", "fp", "root", "component_id")


_FACTOR = np.random.default_rng(20240817).integers(0, 2**31, BANDS * BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def grams(texts: list[str | None], shingle: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles, like `shingles`, but of hashes of words instead of XXH64, so that there's no loop
    over words."""
    for _, group in batches(texts):
        w = Words(group)
        fold = lambda h, n, k: reduce(lambda a, i: a * np.uint64(0x9E3779B97F4A7C15) + h[i : i + k], range(n), np.zeros(k, np.uint64))
        every = mix(fold(w.hash, shingle, max(0, len(w.hash) - shingle + 1)))
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            yield every[a : b - shingle + 1] if b - a >= shingle else mix(fold(w.hash[a:b], b - a, 1)) if b > a else every[:0]


def _bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of MinHashes, as signed longs."""
    low, high = np.full(BANDS * BAND, 2**32 - 1, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 512):
        low = np.minimum(low, (high[i : i + 512, None] * _FACTOR).min(axis=0))
    rows = mix(low.astype(np.uint64)).reshape(BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def bands(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, digest (of the text), keys of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            keys = [_bands(h) for h in grams(b.column(1).to_pylist(), shingle)]
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists], ["doc_id", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest().alias("digest")).mapInArrow(run, "doc_id long, digest binary, keys array<long>")


def _texts(docs: DataFrame, used: DataFrame) -> DataFrame:
    """id, text of the different texts whose ids and digests (id, digest) are used."""
    every = hashed(docs.select(digest().alias("digest"), "text"), "digest", used.select("digest"))
    return every.join(used, "digest").groupBy("id").agg(F.first("text").alias("text"))


def _alike(pairs: DataFrame, docs: DataFrame, ids: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of texts' ids (ids: id, digest), those whose shingles have a Jaccard likeness of `similarity` at least; counted
    over all shingles. The text of b is joined first, so that a text that is in many pairs as a isn't shuffled for each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it, 64):
            keep, held = [], None
            new = [a != b for a, b in zip(b.column(0).to_pylist(), [None, *b.column(0).to_pylist()])]  # a text on the left may stand in many rows
            lefts = grams([t for t, n in zip(b.column(2).to_pylist(), new) if n], shingle)
            for n, other in zip(new, grams(b.column(3).to_pylist(), shingle)):
                held = np.unique(next(lefts)) if n else held
                other = np.unique(other)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(both >= similarity * (len(held) + len(other) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    used = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(ids, "id")
    texts, texts_path = park(_texts(docs, used), "texts")
    right = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "right"}), "b")
    found, _ = park(right.join(texts.withColumnsRenamed({"id": "a", "text": "left"}), "a").select("a", "b", "left", "right").mapInArrow(run, "a long, b long"), "alike")
    drop(docs.sparkSession, texts_path)
    return found


def _within(open_: DataFrame, docs: DataFrame, ids: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of the texts of each key (key, id, root, outside), links (a, b) of those outside to texts of other roots, by the exact
    likeness of all shingles: one for each root that a text is alike to. Each key's sets of shingles meet once, so there's
    no row for a pair; a key with more than KEY_BYTES of them is cut into parts, each pair of which is a task's."""

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it, 64):
            own = [np.unique(g).view(np.int64) for g in grams(b.column(1).to_pylist(), shingle)]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))], ["id", "own"])

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        id_, root, outside, part = (t.column(c).to_numpy() for c in ("id", "root", "outside", "part"))
        own = [x for c in t.column("own").chunks for x in (c.offsets.to_numpy(), c.values.to_numpy())]
        flat, size = np.concatenate([np.zeros(0, np.int64), *(v[o[0] : o[-1]] for o, v in zip(own[::2], own[1::2]))]), np.concatenate([np.zeros(0, np.int64), *(np.diff(o) for o in own[::2])])
        end = np.cumsum(size)
        _, place = np.unique(flat, return_inverse=True)
        mark, total = np.zeros(int(place.max(initial=-1)) + 1, np.int64), np.zeros(len(place) + 1, np.int64)
        two, left, right = part.min() != part.max(), [], []
        for i in np.flatnonzero(outside):
            other = root != root[i]
            if two:
                other &= part != part[i]
            if not other.any():
                continue
            at = place[end[i] - size[i] : end[i]]
            mark[at] = 1
            np.cumsum(mark[place], out=total[1:])
            mark[at] = 0
            both = total[end] - total[end - size]
            hit = np.flatnonzero(other & (both >= similarity * (size[i] + size - both)))
            hit = hit[np.unique(root[hit], return_index=True)[1]]
            left.append(np.full(len(hit), id_[i]))
            right.append(id_[hit])
        return pa.table({"a": np.concatenate([np.zeros(0, np.int64), *left]), "b": np.concatenate([np.zeros(0, np.int64), *right])})

    used = open_.select("id").distinct().join(ids, "id")
    found, path = park(_texts(docs, used).mapInArrow(sets, "id long, own array<long>"), "sets")
    cut = open_.join(found.select("id", F.size("own").alias("size")), "id").groupBy("key").agg(F.ceil(F.sum("size") * 8 / KEY_BYTES).cast("int").alias("parts")).where("parts > 1")
    each = open_.join(cut, "key", "left").select("key", "id", "root", "outside", F.greatest(F.lit(1), F.coalesce("parts", F.lit(1))).alias("parts"))
    each = each.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = each.select("key", "id", "root", "outside", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).join(found, "id")
    late, _ = park(met.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "late")
    drop(docs.sparkSession, path)
    return late


def like_duplicates(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, digest, root (one id for a component) for every row of docs; texts are linked when the exact Jaccard likeness of
    their shingles is `similarity` or more.

    The links of the fingerprints' covering code are candidates, as are texts that share a band of MinHashes: at a likeness of
    0.8 SimHashes differ by 10 of 64 bits on average, and no covering code of that radius is of use. Near copies have a
    hub, the text that they are copies of. So each text is first compared with one hub, of those texts that meet most others in its
    bands' keys the one that meets most; then, where they aren't one component yet, with the hubs of its other keys. Where that leaves
    a key more than one component, all texts outside its largest are compared with all of other components, within a task. So
    any two texts that share a key and are alike end in one component. Keys that have the same texts, as the several bands that two
    texts share mostly do, are taken as one.

    Null and empty texts are one text without shingles, which is like itself alone; repeated rows and rows of one doc_id, with or without
    a number, are each given the root of their text; ties between hubs go to the greater id; an empty table gives an empty one;
    other columns are not looked at. Different texts are numbered, so that links, keys and roots hold 8 bytes a text.
    """
    spark = docs.sparkSession
    rows, _ = park(bands(docs, shingle), "bands")
    first = rows.groupBy("digest").agg(F.first("keys").alias("keys"))
    ids, _ = park(first.select(F.monotonically_increasing_id().alias("id"), "digest", "keys"), "ids")
    of = ids.select("id", "digest")
    prints, prints_path = park(fingerprints(docs).groupBy("digest").agg(F.first("fp").alias("fp")).join(of, "digest").select("id", "fp"), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    same = prints.join(least, "fp").where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    ends = [least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_")) for x in ("a", "b")]
    close = links(prints).join(ends[0], "a").join(ends[1], "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    each = ids.select("id", F.explode("keys").alias("key"))
    met = each.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.bit_xor(F.xxhash64("id")).alias("who")).where("n > 1")
    twice, twice_path = park(met.groupBy("n", "low", "who").agg(F.min("key").alias("key")).select("key", "n"), "twice")  # of keys with the same texts one
    shared, shared_path = park(hashed(each, "key", twice.select("key")).join(twice, "key"), "shared")
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    hub = shared.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("hub"))
    stars, stars_path = park(shared.join(hub, "key").where("id != hub.id").groupBy("id", "hub").agg(F.lit(1).alias("one")).select("id", "hub"), "stars")
    best = stars.groupBy("id").agg(F.max("hub")["id"].alias("hub"))
    pairs, pairs_path = park(same.union(close).union(best.select(F.col("hub").alias("a"), F.col("id").alias("b"))).distinct(), "pairs")
    edges = _alike(pairs, docs, of, shingle, similarity)
    root = _rooted(of, edges)
    to = root.withColumnsRenamed({"id": "b", "root": "to"})
    apart = stars.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).join(to, "b").join(root.withColumnRenamed("id", "a"), "a").where("root != to").select("a", "b")
    apart, apart_path = park(apart.join(pairs, ["a", "b"], "left_anti"), "apart")
    if not apart.isEmpty():
        root = _linked(root, _alike(apart, docs, of, shingle, similarity))
    named, named_path = park(shared.join(root, "id").select("key", "id", "root"), "named")
    count = named.groupBy("key", "root").count().groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("count", "root"))["root"].alias("top")).where("roots > 1")
    open_, open_path = park(named.join(count, "key").select("key", "id", "root", (F.col("root") != F.col("top")).alias("outside")), "open")
    for path in (prints_path, twice_path, shared_path, stars_path, pairs_path, apart_path, named_path):
        drop(spark, path)
    late = _within(open_, docs, of, shingle, similarity)
    drop(spark, open_path)
    if not late.isEmpty():
        root = _linked(root, late)
    return rows.select("doc_id", "digest").join(of.join(root, "id"), "digest").select("doc_id", "digest", "root")


def _rooted(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root for all ids: of a text that no edge has, itself."""
    root, _ = park(components(edges), "roots")
    return ids.select("id").join(root.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _linked(root: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root once more edges between ids are there: only the roots that they join are gone through again."""
    end = lambda x: root.select(F.col("id").alias(x), F.col("root").alias(f"{x}_"))
    between = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")).where("a != b")
    over = components(between).select(F.col("node").alias("root"), F.col("root").alias("over"))
    found, _ = park(root.join(over, "root", "left").select("id", F.coalesce("over", "root").alias("root")), "roots")
    return found


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of docs, all columns, one of each component: the smallest doc_id's (null last), of its texts the one with the
    least digest, of equal rows (null counts as empty) one. Components are those of near_duplicates, or with a similarity of like_duplicates."""
    found, path = park(near_duplicates(docs, shingle) if similarity is None else like_duplicates(docs, shingle, similarity), "near")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("kept"))
    kept, _ = park(kept, "kept")  # read again, so that Spark can split a root that has too many rows for a task
    rows = found.join(kept, "root")
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("digest") == F.col("kept.digest"))
    gone = rows.where(~is_kept).select(F.col("doc_id").alias("__doc_id"), F.col("digest").alias("__digest")).distinct()
    twice = rows.where(is_kept).groupBy("doc_id", "digest").count().where("count > 1").select(F.col("doc_id").alias("__doc_id"), F.col("digest").alias("__digest"))
    twice, _ = park(twice, "twice")
    gone, _ = park(gone, "gone")
    drop(docs.sparkSession, path)
    same = lambda d, other: d["doc_id"].cast("long").eqNullSafe(other["__doc_id"]) & (F.unhex(F.md5(F.coalesce(d["text"], F.lit("")).cast("binary"))) == other["__digest"])
    key = free("key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), digest()))
    named = gone.union(twice).select(F.xxhash64("__doc_id", "__digest").alias(key))
    some, rest = (hashed(keyed, key, named, inside).drop(key) for inside in (True, False))  # most rows aren't shuffled
    left = some.join(gone, same(some, gone), "left_anti")
    once = left.join(twice, same(left, twice), "left_anti")
    mark = free("digest", docs.columns)
    first = left.join(twice, same(left, twice), "left_semi").withColumn(mark, digest()).dropDuplicates(["doc_id", mark]).drop(mark)
    return rest.union(once).union(first)


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
