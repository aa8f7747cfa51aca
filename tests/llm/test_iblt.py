import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from pulsegrid.llm import iblt as op
from pulsegrid.llm import queries


def digest(p):
    return int(hashlib.md5(p.encode()).hexdigest()[:15], 16)


def test_peeling_finds_every_difference(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        shared = [rng.getrandbits(60) for _ in range(rng.randrange(0, 40))]
        a = shared + [rng.getrandbits(60) for _ in range(rng.randrange(0, 30) if i % 50 else 900)]
        b = shared + [rng.getrandbits(60) for _ in range(rng.randrange(0, 30))]
        rows.append((i, i % 2, a, b, float(len(set(a) ^ set(b)))))
    got = {(r.row, r.pair): r.n for r in op.differing(spark.createDataFrame(rows, "row long, pair int, a array<long>, b array<long>, expected double")).collect()}
    assert all(got.get((i, p), 0) == len(set(a) ^ set(b)) for i, p, a, b, _ in rows)


def test_fingerprints_that_do_not_peel_are_sketched_larger(spark):
    rng = random.Random(2)
    digests = lambda n: [rng.getrandbits(60) for _ in range(n)]
    rows = []
    for i in range(200):
        own, more = digests(12), digests(i // 20)
        rows.append((i, own, own + more, digests(i // 2)))
    df = spark.createDataFrame(rows, "row long, own array<long>, new array<long>, other array<long>")
    got = {r.row: r for r in op.compare(df).collect()}
    for i, own, new, other in rows:
        r = got[i]
        assert (r.own_size, r.new_size, r.other_size) == (len(own), len(new), len(other))
        assert r.edited in (None, len(new) - 12) if i >= 20 else r.edited is None and r.edited_expected is None
        assert r.next in (None, 12 + len(other))
    assert sum(got[i].edited is not None for i in range(20, 80)) > 50 and all(got[i].next is None for i in range(10, 200))
    near = [got[i].next_expected / (12 + i // 2) for i in range(100, 200)]
    assert 0.5 < sorted(near)[50] < 1.5
    pairs = [(i, 0, own, other, 1.0) for i, own, _, other in rows]  # expected far too few: doubled until they peel
    assert {r.row: r.n for r in op.differing(spark.createDataFrame(pairs, "row long, pair int, a array<long>, b array<long>, expected double")).collect()} == {i: 12 + len(other) for i, _, _, other in rows}


def test_many_rows_of_one_id_and_of_none(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(7, f"a{rng.randrange(4000)}\nb{i % 3}") for i in range(9000)] + [(None, f"n{i % 5000}") for i in range(10_000)] + [(7, "equal\nrows")] * 9000 + [(8, "after"), (6, "before"), (5000, "far"), (-3, "below")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = op.with_next(df)
    assert got.count() == len(rows)
    order = sorted(((d, t) for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = sorted((str(d), t, order[(k + 1) % len(order)][1]) for k, (d, t) in enumerate(order))
    found = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((str(r.doc_id), r.text, r.next) for r in found) == want


def test_next_lower_in_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "AT_ONCE", 3)
    rng = random.Random(3)
    ids = sorted({rng.randrange(-(2**40), 2**40) for _ in range(40)} | set(range(5000, 5040)) | {-(2**63)})
    got = {r.id: r.lower for r in op.next_lower(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == dict(zip(ids, [None, *ids[:-1]]))


def plain(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (d, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        sets = [{digest(p) for p in x.split("\n") if p} for x in (t, e, n)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), *near))
    return sorted(out)


def test_rows_equal_brute_force(spark):
    rng = random.Random(4)
    lines = ["line %d é😀" % i for i in range(50)]
    rows = [(rng.randrange(5000), "\n".join(rng.choices(lines, k=rng.randrange(0, 30)))) for _ in range(250)]
    rows += [(1, None), (2, ""), (3, "\n\n"), (None, "alone"), (None, "a\nb"), rows[0], rows[0], (7, "x\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as next", "3 as block")
    got = op.fingerprints(df).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == plain(rows)
    same = {}
    for (d, t) in rows:
        same.setdefault(frozenset(p for p in (t or "").split("\n") if p), set())
    assert len({r.fingerprint for r in got}) == len(same)
    assert all(len(r.fingerprint.split(".")) == op.CELLS for r in got)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_iblt(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op9_iblt"]).df().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert (got[c] == want[c]).all() if got[c].dtype != float else (abs(got[c] - want[c]) < 1e-12).all(), c


def test_empty_and_single(spark):
    df = spark.createDataFrame([(5, "abcd\nx")], "doc_id long, text string")
    r = op.fingerprints(df).first()
    assert r.near_next == 1.0 and r.n_chars == 6 and r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert op.fingerprints(df.limit(0)).count() == 0
    