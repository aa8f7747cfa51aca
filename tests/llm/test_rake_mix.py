import itertools

import duckdb
import pytest

from pulsegrid.llm import queries, rake_mix as op


def water(weight, most, goal):
    """One factor, found by bisection, so that the cut weights add up to goal."""
    if goal <= 0:
        return [0.0] * len(weight)
    if sum(m for w, m in zip(weight, most) if w > 0) <= goal:
        return [m if w > 0 else 0.0 for w, m in zip(weight, most)]
    low, high = 0.0, 1e12
    for _ in range(400):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w * mid, m) for w, m in zip(weight, most)) < goal else (low, mid)
    return [min(w * high, m) for w, m in zip(weight, most)]


def plain_rake(cells, shares, fraction, rounds):
    total, stock = sum(cells.values()), [{} for _ in range(3)]
    for c, t in cells.items():
        for k in range(3):
            stock[k][c[k]] = stock[k].get(c[k], 0) + t
    known = [[v for v in s if shares[k].get(v, 0) > 0 and s[v] > 0] for k, s in enumerate(stock)]
    goal = min(total * fraction, *(sum(stock[k][v] for v in vs) for k, vs in enumerate(known)))
    targets = [dict(zip(vs, water([shares[k][v] for v in vs], [stock[k][v] for v in vs], goal))) for k, vs in enumerate(known)]
    weight = {c: t * fraction for c, t in cells.items()}
    for _ in range(rounds):
        for k in range(3):
            for v in stock[k]:
                own = [c for c in cells if c[k] == v]
                weight.update(zip(own, water([weight[c] for c in own], [cells[c] for c in own], targets[k].get(v, 0.0))))
    return weight, targets


@pytest.mark.parametrize("shares", [[{"a": 0.2, "b": 0.3, "c": 0.5}, {"x": 0.6, "y": 0.4}, {"p": 0.5, "q": 0.5}], [{"a": 90, "b": 5, "c": 5}, {"x": 1, "y": 1}, {"p": 1, "q": 9}], [{"a": 1, "b": 1, "none": 7}, {"x": 1, "y": 0}, {"p": 1, "q": 1}]])
def test_rake_equals_plain_loop(spark, shares):
    cells = {c: 100 + 37 * i % 501 for i, c in enumerate(itertools.product("abc", "xy", "pq"))} | {("d", "x", "p"): 0}
    df = spark.createDataFrame([(*c, t) for c, t in cells.items()], "source string, lang string, topic string, tokens long")
    targets = {d: spark.createDataFrame([(v, float(x)) for v, x in s.items()], "value string, share double") for d, s in zip(op.DIMS, shares)}
    want, goals = plain_rake(cells, shares, 0.4, 30)
    fitted = op.rake(df, targets, fraction=0.4)
    got = {(r.source, r.lang, r.topic): r.weight for r in fitted.collect()}
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(want[c], rel=1e-6, abs=1e-6) for c in want)
    assert all(w <= cells[c] for c, w in got.items())
    for r in op.marginals(fitted).collect():
        assert r.target == pytest.approx(goals[op.DIMS.index(r.dimension)].get(r.value, 0.0), rel=1e-9)


def test_targets_beyond_stock_are_shared_out(spark):
    cells = [("a", "x", "p", 10), ("b", "x", "p", 1000), ("c", "x", "p", 1000)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    fitted = op.rake(df, {"source": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "value string, share double")}, fraction=0.5)
    assert {r.source: round(r.weight, 6) for r in fitted.collect()} == {"a": 10.0, "b": 597.0, "c": 398.0}


def test_the_query_meets_its_targets(spark):
    """Of all marginals, from the query's own rows: expected tokens against targets that are computed here."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_rake_mix(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang"), "doc_id").toPandas()
    total = rows.n_tokens.sum()
    rows["weight"] = rows.n_tokens * rows.probability
    assert rows.weight.sum() == pytest.approx(total * op.FRACTION, rel=1e-3)
    for d in op.DIMS:
        stock = rows.groupby(d).n_tokens.sum()
        want = dict(zip(stock.index, water([x**op.TEMPER for x in stock], list(stock), total * op.FRACTION)))
        got = rows.groupby(d).weight.sum()
        for v in want:
            assert got[v] == pytest.approx(want[v], rel=0.01), (d, v)
        drawn = rows[rows.sampled].groupby(d).n_tokens.sum()
        assert all(drawn[v] == pytest.approx(want[v], rel=0.15) for v in want)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_rake_mix(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op8_rake_mix"]).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()


def test_odd_rows(spark):
    rows = [(1, None, None, None, 9), (2, "", "s", "en", 9), (3, "a b\tc", "s", "en", 9), (3, "a b\tc", "s", "en", 9), (None, "x | y", "s", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic long")
    got = op.mix(df).collect()
    assert len(got) == 5
    by = {(r["doc_id"], r["__topic"]): r for r in got}
    assert by[(3, "line")]["__tokens"] == 3 and by[(2, "line")]["__tokens"] == 0 and by[(None, "table")]["__tokens"] == 3
    assert all(0 <= r["__probability"] <= 1 for r in got) and all(r["topic"] == 9 for r in got)
    assert op.mix(df.limit(0)).count() == 0
