"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame operations only.

A sketch has three tables of four cells; a digest goes to one cell of each, which keeps the number of digests, the XOR of
them and the XOR of their checks. Sketches of two versions subtract cell by cell: what both have cancels out. A cell that
then holds one digest gives it away; taking that out of its other cells lays more bare, and so on (peeling) until the cells
are empty and all differing digests are known. The published fingerprints are compared in this way. Where cells are left
over, both versions are sketched anew, with as many cells as the failed sketches let expect, and eight times as many each
time that this fails again.

Sketching and peeling are done in rows (document, cell), partitioned by document once: every round is a Generate and an
aggregation by document and cell, which that partitioning serves, so that rounds need no exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import drop, park

#: Cells of each of the three tables of the sketch that is published.
WIDTH = 4
CELLS = 3 * WIDTH
#: Rounds of peeling, a table each.
ROUNDS = 6
#: Cells of a larger sketch for each difference to expect, in each table, and by how much it grows where it doesn't peel.
SPARE, GROW = 4, 8
#: Rows of a task when sketching: each is spread to dozens of rows, so that the size of what is read tells little.
TASK_ROWS = 20_000
#: doc_ids that share all bits but the last ten follow each other in one window.
BLOCK = 10
#: A block with more rows than this (of repeated or null doc_ids) is cut by doc_id and the first bits of the text's hash.
CROWD = 8 << BLOCK
#: Blocks are themselves put in order in one window up to this number, and else in blocks of blocks.
AT_ONCE = 10_000

#: Multipliers of the three positions and of the check, modulo the prime 2**31 - 1. Fixed values.
PRIME = 2147483647
FACTORS = ((48271, 69621), (39373, 742938285), (1226874159, 62089911))
CHECK = (630360016, 950706376)


def _hash(d: str, factors: tuple[int, int]) -> str:
    return f"(({d} % {PRIME}L * {factors[0]}L + shiftright({d}, 31) * {factors[1]}L) % {PRIME}L)"


def _check(d: str) -> str:
    return _hash(d, CHECK)


def _place(d: str, j: int) -> str:
    """A digest's cell in table j of so many cells as column width says, numbered through."""
    return f"(width * {j} + {_hash(d, FACTORS[j])} % width)"


def digests(text: Column) -> Column:
    """60-bit digests of the text's distinct paragraphs (lines that aren't empty); null counts as empty."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")
    return F.array_distinct(F.transform(lines, lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("long")))


def _sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, cell, n, key, check of the cells of sketches that hold something; rows: by, width, n (1 or -1), key."""
    places = ", ".join(_place("key", j) for j in range(3))
    spread = rows.selectExpr(*by, f"explode(array({places})) AS cell", "n", "key", f"{_check('key')} AS check")
    return _total(spread, [*by, "cell"])


def _total(rows: DataFrame, by: list[str]) -> DataFrame:
    cells = rows.groupBy(*by).agg(F.expr("sum(n) AS n"), F.expr("bit_xor(key) AS key"), F.expr("bit_xor(check) AS check"))
    return cells.where("n != 0 OR key != 0 OR check != 0")


def _peel(cells: DataFrame) -> DataFrame:
    """row, pair, width, cell, n, key, check of what is left of subtracted sketches after so many rounds; cell -1 has the
    number of digests found."""
    now = cells
    row = lambda cell, n, key, check: f"named_struct('cell', {cell}, 'n', {n}, 'key', {key}, 'check', {check})"
    for k in range(ROUNDS):
        t = k % 3
        # In one table a digest lies in one cell alone, so that none is taken out twice.
        pure = f"cell >= width * {t} AND cell < width * {t + 1} AND abs(n) = 1 AND {_check('key')} = check AND {_place('key', t)} = cell"
        others = ", ".join(row(_place("key", j), "-n", "key", "check") for j in range(3) if j != t)
        spread = now.selectExpr("row", "pair", "width", f"explode(CASE WHEN {pure} THEN array({others}, {row('-1L', '1L', '0L', '0L')}) ELSE array({row('cell', 'n', 'key', 'check')}) END) AS c")
        now = _total(spread.selectExpr("row", "pair", "width", "c.cell", "c.n", "c.key", "c.check"), ["row", "pair", "width", "cell"])
    return now


def _outcome(peeled: DataFrame) -> DataFrame:
    """row, pair, n: digests found, null where cells are left over."""
    return peeled.groupBy("row", "pair").agg(F.sum(F.when(F.col("cell") < 0, F.col("n"))).alias("some"), F.max("cell").alias("left")).select("row", "pair", F.when(F.col("left") < 0, F.col("some")).alias("n"))


def published(cells: Column) -> Column:
    """A sketch as text, from a map of its cells that hold something: count:xor:check of every cell, in hex, joined by dots. Equal
    sets give equal sketches."""
    one = lambda c: F.concat_ws(":", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["check"]))
    all_ = F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))
    return F.lower(F.array_join(F.transform(all_, lambda j: F.when(F.map_contains_key(cells, j), one(F.try_element_at(cells, j))).otherwise(F.lit("0:0:0"))), "."))


def next_lower(ids: DataFrame) -> DataFrame:
    """ids (one column, id, distinct) with `lower`: the next smaller id, null for the smallest."""
    if ids.limit(AT_ONCE + 1).count() <= AT_ONCE:
        return ids.withColumn("lower", F.lead("id").over(Window.orderBy(F.desc("id"))))
    blocks = ids.groupBy(F.shiftright("id", BLOCK).alias("block")).agg(F.max("id").alias("head"))
    blocks, _ = park(blocks, "blocks")
    below = next_lower(blocks.select(F.col("block").alias("id"))).withColumnsRenamed({"id": "block", "lower": "lower_block"})
    heads = below.join(blocks.withColumnsRenamed({"block": "lower_block"}), "lower_block").select("block", F.col("head").alias("below"))
    within = ids.withColumn("block", F.shiftright("id", BLOCK)).withColumn("lower", F.lead("id").over(Window.partitionBy("block").orderBy(F.desc("id"))))
    return within.join(heads, "block", "left").select("id", F.coalesce("lower", "below").alias("lower"))


def _after(firsts: DataFrame) -> DataFrame:
    """firsts (block, slot) with to_block, to_slot: the part of the order that comes next, the first after the last."""
    order = Window.partitionBy("block").orderBy("slot")
    parts, _ = park(firsts.select("block", "slot", F.lead("slot").over(order).alias("next_slot")), "parts")
    heads = parts.groupBy("block").agg(F.min("slot").alias("head"))
    lower, _ = park(next_lower(heads.select(F.col("block").alias("id"))), "order")
    top = lower.agg(F.max("id")).first()[0]
    to = lower.select(F.col("id").alias("block"), F.coalesce("lower", F.lit(top)).alias("lower")).join(heads.select(F.col("block").alias("lower"), "head"), "lower")
    same = F.col("next_slot").isNotNull()
    return parts.join(to, "block").select("block", "slot", F.when(same, F.col("block")).otherwise(F.col("lower")).alias("to_block"), F.when(same, F.col("next_slot")).otherwise(F.col("head")).alias("to_slot"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs, null texts as empty, with the next document's text: in order of descending doc_id (null last),
    rows of one doc_id by the MD5 of their text; the first follows the last.

    Texts are shuffled once, by blocks of doc_ids; a block's last row gets the head of the next block, from the same shuffle.
    Blocks with more rows than doc_ids could account for are cut finer, and equal rows in them are counted before they are
    shuffled, so that no number of rows of one doc_id, or without one, is a single task.
    """
    id_ = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("block", F.shiftright(id_, BLOCK))
    blocks, _ = park(rows.groupBy("block").count(), "blocks")
    crowded = blocks.where(F.col("count") > CROWD).select("block", F.lit(True).alias("crowded"))
    crowds = not crowded.isEmpty()
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    if crowds:
        cut = ((1 << BLOCK) - 1 - id_.bitwiseAND(F.lit((1 << BLOCK) - 1))) * 4096 + F.conv(F.substring("digest", 1, 3), 16, 10).cast("long")
        rows = rows.join(crowded, "block", "left").withColumn("slot", F.when(F.col("crowded"), cut).otherwise(F.lit(0)))
        many = rows.where("crowded").groupBy("block", "slot", "doc_id", "digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        rows = rows.where("crowded IS NULL").withColumn("copies", F.lit(1).cast("long")).drop("crowded").unionByName(many)
        firsts = rows.select("block", "slot").distinct()
    else:
        rows = rows.withColumns({"slot": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
        firsts = blocks.select("block", F.lit(0).cast("long").alias("slot"))
    w = Window.partitionBy("block", "slot").orderBy(F.desc(id_), "digest")
    placed = rows.withColumns({"next": F.lead("text").over(w), "place": F.row_number().over(w)})
    to = _after(firsts)
    heads = placed.where("place = 1").select(F.col("block").alias("to_block"), F.col("slot").alias("to_slot"), F.col("text").alias("head"))
    heads = to.join(heads, ["to_block", "to_slot"]).select("block", "slot", "head")
    found = placed.join(heads, ["block", "slot"]).select("doc_id", "text", F.coalesce("next", "head").alias("next"), "copies")
    if not crowds:
        return found.drop("copies")
    each = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("i"))
    return each.select("doc_id", "text", F.when(F.col("i") == F.col("copies"), F.col("next")).otherwise(F.col("text")).alias("next"))


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first so many (or all) of other."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / TASK_ROWS))


def compare(sets: DataFrame) -> DataFrame:
    """row, fingerprint, edited_fingerprint, own_size, new_size, other_size, and for the edited text and the next one the
    number of paragraphs that differ by the fingerprints (edited, next; null where they don't peel) and the number to expect
    then. sets: row, own, new, other, arrays of digests."""
    version = lambda k, c: F.struct(F.lit(k).alias("version"), F.col(c).alias("digests"))
    rows = sets.repartition(_tasks(sets), "row").select("row", F.explode(F.array(version(0, "own"), version(1, "new"), version(2, "other"))).alias("v")).select("row", "v.version", F.explode("v.digests").alias("key"))
    cells = _sketches(rows.select("row", "version", F.lit(WIDTH).cast("long").alias("width"), F.lit(1).cast("long").alias("n"), "key"), ["row", "version"])
    # Every document's own cells by version, and subtracted by pair: the own ones take part in both.
    entry = lambda k: F.map_from_entries(F.collect_list(F.when(F.col("version") == k, F.struct("cell", F.struct("n", "key", "check")))))
    size = lambda k: F.coalesce(F.sum(F.when((F.col("version") == k) & (F.col("cell") < WIDTH), F.col("n"))), F.lit(0))
    texts = cells.groupBy("row").agg(published(entry(0)).alias("fingerprint"), published(entry(1)).alias("edited_fingerprint"), size(0).alias("own_size"), size(1).alias("new_size"), size(2).alias("other_size"))
    pairs = F.when(F.col("version") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("version") - 1))
    signed = cells.select("row", F.explode(pairs).alias("pair"), "cell", F.when(F.col("version") == 0, F.col("n")).otherwise(-F.col("n")).alias("n"), "key", "check")
    less = _total(signed, ["row", "pair", "cell"]).withColumn("width", F.lit(WIDTH).cast("long"))
    found = _outcome(_peel(less.select("row", "pair", "width", "cell", "n", "key", "check")))
    # A table's counts squared are, on average, 3/4 of the differences and a quarter of the square of their sum.
    first = F.col("cell") < WIDTH
    seen = less.groupBy("row", "pair").agg((F.sum(F.col("n") * F.col("n")) / 3).alias("square"), F.coalesce(F.sum(F.when(first, F.col("n"))), F.lit(0)).alias("more"))
    expected = F.greatest(F.abs("more").cast("double"), (F.col("square") - F.col("more") * F.col("more") / 4) / 0.75, F.lit(8.0))
    both = found.join(seen.select("row", "pair", expected.alias("expected")), ["row", "pair"])
    of = lambda k, c: F.max(F.when(F.col("pair") == k, F.col(c)))
    wide = both.groupBy("row").agg(of(0, "n").alias("edited"), of(1, "n").alias("next"), of(0, "expected").alias("edited_expected"), of(1, "expected").alias("next_expected"))
    return texts.join(wide, "row", "left")


def differing(pairs: DataFrame) -> DataFrame:
    """row, pair, n: how many digests differ between the sets a and b of each (row, pair); rows of equal sets may be missing.

    pairs: row, pair, a, b, the sets as arrays of digests, and expected, about how many differ. Only cells that hold something
    are rows, so that wide sketches cost no more than narrow ones: they have at least 3 * SPARE cells for each, and GROW times
    as many every time that they don't peel.
    """
    out, todo = None, pairs
    while True:
        width = F.greatest(F.lit(8), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("expected") * SPARE)))).cast("long")
        signed = lambda c, s: F.transform(c, lambda d: F.struct(d.alias("key"), F.lit(s).cast("long").alias("n")))
        each = todo.repartition(_tasks(todo), "row").select("row", "pair", width.alias("width"), F.explode(F.concat(signed(F.col("a"), 1), signed(F.col("b"), -1))).alias("e"))
        tried, _ = park(_outcome(_peel(_sketches(each.select("row", "pair", "width", "e.n", "e.key"), ["row", "pair", "width"]))), "peeled")
        good = tried.where("n IS NOT NULL")
        out = good if out is None else out.unionByName(good)
        failed = tried.where("n IS NULL")
        if failed.isEmpty():
            return out
        todo = todo.join(failed.select("row", "pair"), ["row", "pair"], "left_semi").withColumn("expected", F.col("expected") * GROW)


def likeness(a: Column, b: Column, n: Column) -> Column:
    """Shared digests over all, from the sizes of both sets and the number that differ; two empty sets are alike."""
    both = (a + b).cast("double")
    return F.when(both == 0, 1.0).otherwise((both - n) / (both + n))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    near_* are the shared paragraphs over all, from the numbers of paragraphs that fingerprints hold and of those in which the
    two differ. Null texts count as empty; an only document is its own next; ties and repeated rows: see with_next; an empty
    table gives an empty one; other columns are not looked at.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    new = edited(F.col("text"), F.col("next"))
    texts = with_next(docs).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(new.cast("binary"), 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"),
        digests(new).alias("new"),
        digests(F.col("next")).alias("other"),
    )
    base, base_path = park(texts, "paragraphs")
    found, _ = park(base.select("row", "doc_id", "n_chars", "edited_sha256").join(compare(base.select("row", "own", "new", "other")), "row", "left"), "compared")
    missing = lambda c: F.col(c).isNull() & F.col(f"{c}_expected").isNotNull()
    todo = found.where(missing("edited") | missing("next"))
    if not todo.isEmpty():
        pair = lambda k, c, b: F.when(missing(c), F.struct(F.lit(k).alias("pair"), F.col(b).alias("b"), F.col(f"{c}_expected").alias("expected")))
        arrays = base.select("row", "own", "new", "other").join(todo.select("row", "edited", "next", "edited_expected", "next_expected"), "row")
        pairs = arrays.select("row", F.col("own").alias("a"), F.explode(F.array_compact(F.array(pair(0, "edited", "new"), pair(1, "next", "other")))).alias("p")).select("row", "p.pair", "a", "p.b", "p.expected")
        pairs, pairs_path = park(pairs, "pairs")
        late = differing(pairs).groupBy("row").agg(*(F.max(F.when(F.col("pair") == k, F.col("n"))).alias(f"{c}_late") for k, c in enumerate(("edited", "next"))))
        late, _ = park(late, "late")
        drop(docs.sparkSession, pairs_path)
        found = found.join(late, "row", "left").withColumns({c: F.coalesce(c, f"{c}_late") for c in ("edited", "next")})
    drop(docs.sparkSession, base_path)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    none = F.lit(".".join(["0:0:0"] * CELLS))
    near = lambda other, n: likeness(zero("own_size"), zero(other), zero(n))
    return found.select("doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", none).alias("fingerprint"), F.coalesce("edited_fingerprint", none).alias("edited_fingerprint"), near("new_size", "edited").alias("near_edited"), near("other_size", "next").alias("near_next"))


def sql() -> str:
    """The same in DuckDB's SQL, over the table documents; sets of digests are compared directly there."""
    h = lambda d, f: f"(({d} % {PRIME}) * {f[0]} + ({d} >> 31) * {f[1]}) % {PRIME}"
    digest = lambda t: f"list_distinct(list_transform(list_filter(string_split({t}, chr(10)), lambda p: p <> ''), lambda p: ('0x' || substr(md5(p), 1, 15))::BIGINT))"

    def cell(c: str, j: int) -> str:
        own = f"list_filter({c}, lambda x: {h('x', FACTORS[j])} % {WIDTH} = i)"
        fold = lambda x: f"lower(to_hex(list_reduce(list_prepend(0::BIGINT, {x}), lambda a, b: xor(a, b))))"
        checks = f"list_transform({own}, lambda x: {h('x', CHECK)})"
        return f"list_transform(range({WIDTH}), lambda i: len({own}) || ':' || {fold(own)} || ':' || {fold(checks)})"

    sketch_ = lambda c: f"array_to_string(list_concat(list_concat({cell(c, 0)}, {cell(c, 1)}), {cell(c, 2)}), '.')"
    near = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next FROM d
  WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, md5(text))),
e AS (SELECT doc_id, text, next, substr(text, 1, length(text) - length(text) // 2) || substr(next, 1, length(text) // 2) AS new FROM n),
p AS (SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(new) AS edited_sha256, {digest("text")} AS own, {digest("new")} AS new, {digest("next")} AS other FROM e)
SELECT doc_id, n_chars, edited_sha256, {sketch_("own")} AS fingerprint, {sketch_("new")} AS edited_fingerprint, {near("own", "new")} AS near_edited, {near("own", "other")} AS near_next
FROM p
"""
