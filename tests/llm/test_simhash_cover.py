import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import simhash_cover as op
from pulsegrid.llm.shared import BATCH_ROWS, hashed, park


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_agrees_with_definition():
    for t in (None, "", " \n\t", "One", "two Words", "a b c", "A b\x0bc d  e É é", "x " * 500, "  a b c d"):
        assert op.fingerprint(t) == plain_fingerprint(t), t


def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for i in range(0, 300, 3):
        bits = rng.choice(64, 2, replace=False)
        fp[i + 1] = fp[i] ^ np.uint64(1 << int(bits[0]))
        fp[i + 2] = fp[i] ^ np.uint64(1 << int(bits[0])) ^ np.uint64(1 << int(bits[1]))
    index, word = op.anchors(fp)
    assert (op._syndrome(word) == 0).all()
    assert (np.bitwise_count(word ^ fp[index]) <= 2).all()
    at = {}
    for i, w in zip(index, word):
        at.setdefault(int(w), set()).add(int(i))
    met = {(i, j) for group in at.values() for i in group for j in group if i < j}
    for i in range(300):
        for j in range(i + 1, 300):
            if int(fp[i] ^ fp[j]).bit_count() <= 2:
                assert (i, j) in met


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    words = ["w%d" % i for i in range(60)]
    rows, doc = [], 0
    for _ in range(12):
        base = list(rng.choice(words, 500))
        for k in range(8):
            text = list(base)
            for _ in range(k % 3):
                text[rng.integers(500)] = str(rng.choice(words))
            rows.append((doc, " ".join(text)))
            doc += 1
    rows += [(doc, ""), (doc + 1, None), (doc + 2, "\n"), (5, rows[5][1]), (None, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.near_duplicates(df.selectExpr("*", "1 as fp", "2 as component_id")).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps)
    low = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    want = sorted((d if d is not None else -1, f, low.get(r)) for (d, _), f, r in zip(rows, fps, root))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id) for r in got) == want
    assert len({c for *_, c in want}) < 0.8 * len(rows)


def test_a_long_chain_is_one_component(spark):
    fp, chain = 0, []
    for i in range(64):
        chain.append(fp - 2**64 if fp >= 2**63 else fp)
        fp ^= 1 << i
    fps = spark.createDataFrame([(f,) for f in chain], "fp long")
    roots = op.components(op.links(fps)).collect()
    assert len(roots) == 64 and {r.root for r in roots} == {min(chain)}


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_grams_are_equal_where_shingles_are():
    rng = random.Random(31)
    texts = [None, "", " ", "one", "One", "a b c d", "a b c d e", "a  b\tc D e f"] + [" ".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    texts.append(" ".join("xyz"[i % 3] for i in range(90_000)))
    own, exact = {}, {}
    for t, got in zip(texts, op.grams(texts, 5)):
        want = op.shingles(t, 5)
        assert len(got) == len(want)
        for g, w in zip(got.tolist(), want.tolist()):
            assert own.setdefault(w, g) == g and exact.setdefault(g, w) == w


def family(rng, n, edits):
    """Copies of a text of 200 words, each with words of its own at some places; the text itself isn't among them."""
    base, out = [f"w{i}" for i in range(200)], []
    for k in range(n):
        text = list(base)
        for i in rng.sample(range(200), edits(k)):
            text[i] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def components_of(texts, similarity=0.8):
    own = [set(op.shingles(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(own[i] & own[j])
            if find(i) != find(j) and both >= similarity * (len(own[i]) + len(own[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(sorted(i for i in range(len(texts)) if find(i) == r) for r in {find(i) for i in range(len(texts))})


def groups(rows):
    found = {}
    for r in rows:
        found.setdefault(r.root, []).append(r.doc_id)
    return sorted(map(sorted, found.values()))


def test_a_family_of_near_copies_makes_no_row_for_each_pair(spark, monkeypatch):
    rng = random.Random(41)
    texts = family(rng, 240, lambda k: 1 + k % 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, alike = [], op._alike
    monkeypatch.setattr(op, "_alike", lambda pairs, *more: seen.append(pairs.count()) or alike(pairs, *more))
    want = components_of(texts)
    assert groups(op.like_duplicates(docs, 5, 0.8).collect()) == want and 1 < len(want) < 200
    assert sum(seen) < 10 * len(texts)
    monkeypatch.setattr(op, "KEY_BYTES", 40_000)  # keys of several parts
    assert groups(op.like_duplicates(docs, 5, 0.8).collect()) == want


def test_texts_outside_their_keys_largest_component_are_found(spark, monkeypatch):
    """With a hub that few are alike to, all links come from the comparison within a task."""
    rng = random.Random(43)
    texts = family(rng, 60, lambda k: 2 + k % 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(op, "_alike", lambda pairs, *more: pairs.where("false"))
    for size in (op.KEY_BYTES, 20_000):
        monkeypatch.setattr(op, "KEY_BYTES", size)
        open_ = docs.select(op.F.lit(1).alias("key"), op.F.col("doc_id").alias("id"), op.F.col("doc_id").alias("root"), op.F.lit(True).alias("outside"))
        ids = docs.select(op.F.col("doc_id").alias("id"), op.digest().alias("digest"))
        found = {(r.a, r.b) for r in op._within(open_, docs, ids, 5, 0.8).collect()}
        digest = list(range(60))
        own = [set(op.shingles(t, 5).tolist()) for t in texts]
        want = {(digest[i], digest[j]) for i in range(60) for j in range(60) if i != j and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])}
        assert found == want and len(want) > 20


def test_links_of_the_covering_code_are_candidates(spark, monkeypatch):
    """Copies with a word changed in 2,000 are linked where no two texts share a band of MinHashes."""
    rng = random.Random(42)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(2000)]
        for _ in range(4):
            text = list(base)
            text[rng.randrange(2000)] = "changed"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r.root for r in op.near_duplicates(docs).collect()}
    monkeypatch.setattr(op, "bands", lambda d, shingle: d.select("doc_id", op.digest().alias("digest"), op.F.array(op.F.col("doc_id")).alias("keys")))
    want = sorted(sorted(d for d in near if near[d] == r) for r in set(near.values()))
    assert groups(op.like_duplicates(docs, 5, 0.8).collect()) == want and len(want) < 18


def test_texts_are_told_apart_by_their_digests(spark):
    """Texts are told apart by 128 bits; of rows of one doc_id each text counts."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, None), (1, ""), (None, "g h i j k l"), (None, "g h i j k l"), (2, "g h i j k l m")]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, id int, digest int")
    got = op.like_duplicates(docs, 5, 0.8).collect()
    assert len(got) == 7 and len({bytes(r.digest) for r in got}) == 4 and all(len(r.digest) == 16 for r in got)
    kept = [tuple(r)[:2] for r in op.one_of_each(docs, 5, 0.8).collect()]
    assert sorted((d or 0, t or "") for d, t in kept) == [(0, "g h i j k l"), (1, ""), (1, "a b c d e f"), (2, "g h i j k l m")]


def test_very_many_rows_of_one_doc_id(spark):
    rng = random.Random(44)
    texts = family(rng, 40, lambda k: 1)
    rows = [(7, texts[i % 40]) for i in range(10_000)] + [(3, texts[5]), (9, "something else that stands alone")]
    kept = op.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 0.8).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, texts[5]), (9, "something else that stands alone")]


def test_all_alike_texts_of_a_table_are_linked(spark):
    """By brute force over an inverted index of whole texts' shingles, those in over 150 texts left aside, on sf0.1."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    first = {}
    for d, t in rows:
        first.setdefault(t or "", d)
    own = [np.unique(g) for g in op.grams(list(first), 5)]
    flat, who = np.concatenate(own), np.repeat(np.arange(len(own)), [len(o) for o in own])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    edge = np.flatnonzero(np.diff(flat, prepend=flat[0] - np.uint64(1)) != 0)
    size = np.diff(np.append(edge, len(flat)))
    pairs = set()
    for at, n in zip(edge[(size > 1) & (size <= 150)], size[(size > 1) & (size <= 150)]):
        met = who[at : at + n].tolist()
        pairs |= {(a, b) for i, a in enumerate(met) for b in met[i + 1 :]}
    alike = []
    for a, b in pairs:
        if min(len(own[a]), len(own[b])) >= 0.8 * max(len(own[a]), len(own[b])):
            both = len(np.intersect1d(own[a], own[b], assume_unique=True))
            if both >= 0.8 * (len(own[a]) + len(own[b]) - both):
                alike.append((a, b))
    root = {r.doc_id: r.root for r in op.like_duplicates(docs, 5, 0.8).collect()}
    ids = list(first.values())
    assert len(alike) >= 40 and all(root[ids[a]] == root[ids[b]] for a, b in alike)
    assert len(set(root.values())) == 9245


def test_tasks_give_python_few_texts_at_once(spark):
    """Batches of 10,000 texts took too much of an executor's memory; what only drops rows by a table of bits gives none at all."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)

    def count(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    df = spark.range(0, 5000, 1, 1)
    rows = park(df.mapInArrow(count, "n long"), "rows")[0].agg(F.max("n"), F.sum("n")).first()
    assert rows[0] <= BATCH_ROWS and rows[1] == 5000 and spark.conf.get(name) == was
    docs = df.withColumn("text", F.lit("text"))
    for inside, at_least in ((True, 7), (False, 4900)):
        some = hashed(docs, "id", spark.range(7), inside)
        assert some.columns == docs.columns and at_least <= some.count() <= 5000 - (7 if not inside else 4900)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
