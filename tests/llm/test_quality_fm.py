import numpy as np
import pytest

from pulsegrid.llm import quality_fm as op
from pulsegrid.llm.shared import Words
from tests.conftest import TESTDATA


def test_words_agree_with_split():
    texts = [b"", b"One two\tone", "é Ü ONE".encode(), b"  x\x0by  ", b"\n", b"last"]
    w = Words(texts)
    got = [[w.buf[a:b].lower() for a, b in zip(w.start[f:t], w.end[f:t])] for f, t in zip(w.first, w.first[1:])]
    assert got == [t.lower().split() for t in texts]
    flat = [x for g in got for x in g]
    assert len(set(w.hash.tolist())) == len(set(flat))
    assert len({(x, int(h)) for x, h in zip(flat, w.hash)}) == len(set(flat))


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    m = op.Machine(0.1, rng.normal(size=op.BUCKETS + op.N_DENSE), rng.normal(size=(op.BUCKETS + op.N_DENSE, op.RANK)), np.zeros(op.N_DENSE), np.ones(op.N_DENSE))
    first, bucket, value, dense = op.features([b"a b c a", b"", b"one two three"], np.array([7, np.nan, 13]))
    x = m.standard(dense)
    got, _ = m.margin(first, bucket, value, x)
    for i in range(3):
        all_i = np.concatenate([bucket[first[i] : first[i + 1]], np.arange(op.BUCKETS, op.BUCKETS + op.N_DENSE)])
        all_x = np.concatenate([value[first[i] : first[i + 1]], x[i]])
        want = m.bias + m.w[all_i] @ all_x
        for a in range(len(all_i)):
            for b in range(a):
                want += m.v[all_i[a]] @ m.v[all_i[b]] * all_x[a] * all_x[b]
        assert got[i] == pytest.approx(want, rel=1e-5)


def test_held_out_accuracy_and_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = op.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    truth = got.merge(labels.toPandas(), on="doc_id")
    test = truth[truth["held_out"]]
    good, bad = test[test["quality"] == 1]["score"], test[test["quality"] == 0]["score"]
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.9
    again = op.classify(docs.withColumns({"lang": op.F.lit("xx"), "source": op.F.lit("yy")}), labels).toPandas()
    both = got.merge(again, on="doc_id")
    assert np.allclose(both["score_x"], both["score_y"], atol=1e-9)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "", 0), (2, None, None), (None, "some text", 9), (1, "", 0), (3, "x" * 300_000, 300_000)], "doc_id long, text string, n_chars long")
    labels = spark.read.parquet(f"{TESTDATA}/labels.parquet")
    got = op.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert op.classify(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in op.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_many_rows_of_one_id_are_one_in_the_fit(spark):
    """Of 10,000 rows of a labelled document, and as many without an id, one and none."""
    rows = [(4, f"text {i}", 6) for i in range(10_000)] + [(None, f"none {i}", 6) for i in range(10_000)] + [(i, "good words here" if i % 2 else "bad bad", 9) for i in range(1000, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in [4, *range(1000, 1100)]] * 2, "doc_id long, quality int")
    once = docs.groupBy("doc_id").agg(op.F.min("text").alias("text"), op.F.first("n_chars").alias("n_chars"))
    a, b = op.train(docs, labels), op.train(docs, labels)
    assert (a.w == b.w).all() and len(op.scores(once, a, ["doc_id"]).collect()) == 102


def test_every_labelled_row_is_fitted_on(spark, monkeypatch):
    """More labelled rows than a round takes: none is left out, and shares of them, taken in turn, tell the same."""
    rows = [(i, f"{'good' if i % 2 else 'bad'}{i % 7 < 5} w{i % 11}", None) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9000)], "doc_id long, quality int")
    seen = []
    fit = op.fit
    monkeypatch.setattr(op, "fit", lambda rows, *more: seen.append((rows.count(), rows.select("doc_id").distinct().count())) or fit(rows, *more))
    learnt = labels.where(~op.held_out()).count()
    machine = op.train(docs, labels)
    assert seen == [(learnt, learnt)] and learnt > 6000
    monkeypatch.setattr(op, "SHARE_ROWS", 2000)
    monkeypatch.setattr(op, "TASK_ROWS", 1500)
    in_shares = op.train(docs, labels)
    assert seen[1] == seen[0]
    for m in (machine, in_shares):
        found = op.scores(docs, m, ["doc_id"]).collect()
        assert all((r.quality_score > 0.5) == bool(r.doc_id % 2) for r in found)
