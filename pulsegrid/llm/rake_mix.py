"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Documents are summed to cells (source, language, topic). Targets are clipped to what there is, the rest shared out anew among
the other values. Raking then fits the cells' token weights to each dimension's targets in turn: cells of a value are scaled
by one factor, those that would pass the tokens that they have stay at these, and the factor is the one with which the
value's cells then add up to its target. Rounds go on until all marginals fit. A cell's weight over its tokens is the
probability to sample its documents with.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import drop, free, park

FRACTION = 0.5
#: Targets, where none are given: a value's share of the tokens to this power, over the sum of these.
TEMPER = 0.5
#: At most, in blocks of BLOCK, each a written table so that plans stay short; fewer where all marginals fit to TOLERANCE.
ROUNDS, BLOCK = 30, 5
#: Of a marginal's distance from its target, as a share of all tokens to sample.
TOLERANCE = 1e-8
#: Up to so many cells are one partition, of which groups need no exchange; more are dealt anew for each dimension.
AT_ONCE = 100_000
DIMS = ("source", "lang", "topic")


def topic() -> Column:
    """A text's genre, in place of a topic column: the first of these rules that holds."""
    t = F.coalesce("text", F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains("###") | t.contains("$$$") | t.contains("%%%"), "symbols")
        .when(t.contains("!!"), "shouting")
        .when(t.contains("@"), "contacts")
        .when(t.contains("\n"), "paragraphs")
        .otherwise("line")
    )


def n_tokens() -> Column:
    """Words of the whole text, null counting as empty."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw() -> Column:
    """A number from 0 to 1 that depends on doc_id alone (null: as the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def fill(rows: DataFrame, by: list[str], weight: str, most: str, goal: str, order: list[str]) -> DataFrame:
    """rows with `weight` scaled by one factor within each group, and cut at `most`, so that they add up to `goal`; where even
    all of `most` doesn't, weights are at most. Rows without weight keep none. order: columns that tell a group's rows apart.

    Rows are cells of a summary, few beside the documents, so that a group is an array: in the order in which they would be cut,
    rows are cut as long as the factor (goal - what the cut ones have) / (weight of the others) would cut the next one too.
    """
    rest = [*order, *(c for c in rows.columns if c not in (*by, *order))]
    soon = f"CASE WHEN {weight} > 0 THEN {most} / {weight} ELSE DOUBLE('Infinity') END"
    groups = rows.groupBy(*by).agg(F.expr(f"array_sort(collect_list(named_struct('__soon', {soon}, {', '.join(f"'{c}', {c}" for c in rest)}))) AS __rows"), F.expr(f"max({goal}) AS __goal"))
    factor = f"""aggregate(__rows, named_struct('cut', DOUBLE(0), 'others', aggregate(__rows, DOUBLE(0), (a, x) -> a + x.{weight}), 'factor', CAST(NULL AS DOUBLE)),
      (s, x) -> CASE WHEN s.factor IS NOT NULL OR x.{weight} <= 0 THEN s
        WHEN (__goal - s.cut) / s.others <= x.__soon THEN named_struct('cut', s.cut, 'others', s.others, 'factor', (__goal - s.cut) / s.others)
        ELSE named_struct('cut', s.cut + x.{most}, 'others', s.others - x.{weight}, 'factor', CAST(NULL AS DOUBLE)) END, s -> s.factor)"""
    new = f"CASE WHEN __row.{weight} > 0 THEN least(coalesce(__row.{weight} * __factor, __row.{most}), __row.{most}) ELSE DOUBLE(0) END"
    found = groups.selectExpr(*by, f"{factor} AS __factor", "explode(__rows) AS __row")
    return found.selectExpr(*by, *(f"{new} AS {c}" if c == weight else f"__row.{c} AS {c}" for c in rest))


def goals(cells: DataFrame, targets: dict[str, DataFrame] | None, fraction: float) -> dict[str, DataFrame]:
    """For each dimension value, target_<dimension>: tokens to sample, in proportion to the shares but no more than there are.

    All dimensions have the same total: `fraction` of the tokens, or what the values with a share have, where that's less.
    """
    shares = {}
    for d in DIMS:
        have = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("have")).where("have > 0")
        if targets and d in targets:
            share = have.join(targets[d].select(F.col("value").alias(d), F.col("share").cast("double").alias("share")), d).where("share > 0")
        else:
            share = have.withColumn("share", F.pow("have", F.lit(TEMPER)))
        shares[d] = share.withColumn("__all", F.lit(0))
    least = cells.agg((F.sum("tokens") * F.lit(fraction)).alias("goal"))
    for d in shares if targets else ():
        least = least.unionByName(shares[d].agg(F.sum("have").alias("goal")))
    goal = least.agg(F.min(F.coalesce("goal", F.lit(0.0)))).first()[0]
    return {d: fill(share.withColumn("goal", F.lit(float(goal))), ["__all"], "share", "have", "goal", [d]).select(d, F.col("share").alias(f"target_{d}")) for d, share in shares.items()}


def marginals(fitted: DataFrame) -> DataFrame:
    """dimension, value, target, weight, tokens of what rake gives: how near each marginal is to its target. Targets that no
    weights meet at once, as when a topic that is to be taken whole lies in a source that isn't, show here."""
    one = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"target_{d}").alias("target"))
    rows = fitted.select("weight", "tokens", F.explode(F.array(*map(one, DIMS))).alias("m"))
    return rows.groupBy("m.dimension", "m.value").agg(F.max("m.target").alias("target"), F.sum("weight").alias("weight"), F.sum("tokens").alias("tokens"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with `weight`, tokens to sample of each cell, and its targets.

    targets: for each dimension value, share; values without a target row get none. Without targets, tempered shares. Targets
    that no weights meet at once are met as nearly as the last round gives; see marginals.
    """
    now = cells.withColumns({"weight": F.col("tokens") * F.lit(fraction), "most": F.col("tokens").cast("double")})
    for d, target in goals(cells, targets, fraction).items():
        now = now.join(target, d, "left").withColumn(f"target_{d}", F.coalesce(f"target_{d}", F.lit(0.0)))
    now, path = park(now, "cells")
    spark, done = now.sparkSession, 0
    few = now.count() <= AT_ONCE
    while done < rounds:
        now = now.coalesce(1) if few else now
        for _ in range(min(BLOCK, rounds - done)):
            for d in DIMS:
                now = fill(now, [d], "weight", "most", f"target_{d}", [x for x in DIMS if x != d])
        now, new = park(now, "cells")
        drop(spark, path)
        path, done = new, done + BLOCK
        off = marginals(now).agg(F.max(F.abs(F.col("weight") - F.col("target"))).alias("off"), F.sum(F.when(F.col("dimension") == DIMS[0], F.col("target"))).alias("all")).first()
        if off["off"] is None or off["off"] <= TOLERANCE * off["all"]:
            break
    return now.drop("most")


class Names(NamedTuple):
    """Names of the columns that mix adds."""

    topic: str
    tokens: str
    probability: str
    sampled: str

    @classmethod
    def of(cls, docs: DataFrame) -> Names:
        return cls(*(free(n, docs.columns) for n in ("__topic", "__tokens", "__probability", "__sampled")))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, rounds: int = ROUNDS) -> DataFrame:
    """docs with the columns of Names.of(docs): genre, words, probability, and whether the row is in the sample.

    Null source and lang count as the empty value; null and empty texts have no tokens and go with their cell's probability,
    which is `fraction` where the whole cell has no token; rows of one doc_id are drawn alike; repeated rows and ties need no
    rule; an empty table gives an empty one. Columns of docs are left alone, whatever their names.
    """
    name = Names.of(docs)
    key = {"source": free("__source", docs.columns), "lang": free("__lang", docs.columns), "topic": name.topic}
    seen = docs.withColumns({key["source"]: F.coalesce(F.col("source").cast("string"), F.lit("")), key["lang"]: F.coalesce(F.col("lang").cast("string"), F.lit("")), name.topic: topic(), name.tokens: n_tokens()})
    cells, path = park(seen.groupBy(*(F.col(key[d]).alias(d) for d in DIMS)).agg(F.sum(name.tokens).alias("tokens")), "marginals")
    fitted = rake(cells, targets, fraction, rounds)
    chance = fitted.select(*(F.col(d).alias(key[d]) for d in DIMS), F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(fraction)).alias(name.probability))
    drop(docs.sparkSession, path)
    found = seen.join(chance, list(key.values())).withColumn(name.sampled, draw() < F.col(name.probability))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), name.topic, name.tokens, name.probability, name.sampled)


def sql(fraction: float = FRACTION, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, over the table documents."""

    def fill_(source: str, by: str, weight: str, most: str, goal: str, order: str, keep: str) -> str:
        part = f"PARTITION BY {by} " if by else ""
        down = ", ".join(f"{c.strip()} DESC" for c in order.split(","))
        return f"""(SELECT {keep}, CASE WHEN {weight} > 0 THEN least(coalesce({weight} * f, {most}), {most}) ELSE 0 END AS {weight} FROM (
  SELECT *, max(CASE WHEN k <= r THEN k END) OVER ({part}) AS f FROM (
    SELECT *, CASE WHEN r IS NOT NULL THEN ({goal} - coalesce(sum(CASE WHEN r IS NOT NULL THEN {most} END) OVER ({part}ORDER BY r ASC NULLS LAST, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum({weight}) OVER ({part}ORDER BY r DESC NULLS FIRST, {down} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS k
    FROM (SELECT *, CASE WHEN {weight} > 0 THEN {most} / {weight} END AS r FROM {source}))))"""

    steps, columns = [], "source, lang, topic, tokens, most, t_source, t_lang, t_topic"
    for k in range(rounds):
        inner = f"c{k}"
        for j, d in enumerate(DIMS):
            steps.append(f"c{k}_{j} AS MATERIALIZED (SELECT * FROM {fill_(inner, d, 'weight', 'most', f't_{d}', ', '.join(x for x in DIMS if x != d), columns)})")
            inner = f"c{k}_{j}"
        steps.append(f"c{k + 1} AS (SELECT * FROM {inner})")
    ends = [*range(BLOCK, rounds, BLOCK), rounds]
    summed = lambda c: " UNION ALL ".join(f"SELECT abs(sum(weight) - max(t_{d})) AS off, 0.0 AS goal FROM {c} GROUP BY {d}" for d in DIMS) + f" UNION ALL SELECT 0, sum(t) FROM (SELECT max(t_{DIMS[0]}) AS t FROM {c} GROUP BY {DIMS[0]})"
    steps += [f"near{k} AS MATERIALIZED (SELECT max(off) <= {TOLERANCE} * max(goal) AS near FROM ({summed(f'c{k}')}))" for k in ends[:-1]]
    chosen = " UNION ALL ".join(f"SELECT * FROM c{k} WHERE " + " AND ".join([*(f"NOT (SELECT near FROM near{j})" for j in ends if j < k), *([f"(SELECT near FROM near{k})"] if k < rounds else [])]) for k in ends)
    shares = ",\n".join(f"s_{d} AS (SELECT {d}, sum(tokens)::DOUBLE AS have, pow(sum(tokens)::DOUBLE, {TEMPER}) AS share, (SELECT total FROM total) * {fraction}::DOUBLE AS goal FROM cells GROUP BY {d} HAVING sum(tokens) > 0)" for d in DIMS)
    target = lambda d: fill_(f"s_{d}", "", "share", "have", "goal", d, d)
    return f"""
WITH seen AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
    CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '###') OR contains(text, '$$$') OR contains(text, '%%%') THEN 'symbols'
      WHEN contains(text, '!!') THEN 'shouting' WHEN contains(text, '@') THEN 'contacts' WHEN contains(text, chr(10)) THEN 'paragraphs' ELSE 'line' END AS topic
  FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM seen GROUP BY ALL),
total AS (SELECT sum(tokens)::DOUBLE AS total FROM cells),
{shares},
c0 AS MATERIALIZED (
  SELECT source, lang, topic, tokens, tokens::DOUBLE AS most, coalesce(a.share, 0) AS t_source, coalesce(b.share, 0) AS t_lang, coalesce(c.share, 0) AS t_topic, tokens * {fraction}::DOUBLE AS weight
  FROM cells LEFT JOIN {target("source")} a USING (source) LEFT JOIN {target("lang")} b USING (lang) LEFT JOIN {target("topic")} c USING (topic)),
{", ".join(steps)}
SELECT doc_id, s.topic, s.tokens::BIGINT AS n_tokens, round(p, 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < p AS sampled
FROM seen s JOIN (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE {fraction} END AS p FROM ({chosen})) f
  ON s.source = f.source AND s.lang = f.lang AND s.topic = f.topic
"""
