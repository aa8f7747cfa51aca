import random

import numpy as np

from pulsegrid.llm import cdc_dedup as op


def test_gear_equals_its_definition():
    a = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    got = op.gear(a)
    for i in range(300):
        assert int(got[i]) == sum(int(op._GEAR[a[i - j]]) << j for j in range(min(32, i + 1))) % 2**32


def test_chunks_cover_the_text():
    rng = random.Random(2)
    for text in ("", "a", "é" * 5000, "ab" * 4000, "word " * 999, "".join(rng.choice("abc déf\n€😀") for _ in range(9000))):
        digest, start, length, words = op.chunks(text)
        assert length.sum() == len(text) and words.sum() == len(text.split())
        assert (start[1:] == (start + length)[:-1]).all()
        size = [len(text[s : s + n].encode()) for s, n in zip(start, length)]
        assert all(x <= op.MOST + 3 for x in size)


def test_cuts_equal_their_definition():
    rng = random.Random(9)
    raw = "".join(rng.choice("abc déf\n€😀") for _ in range(3000)).encode()
    h = op.gear(np.frombuffer(raw, np.uint8)).tolist()
    free = [i for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]
    want = [i + 1 for i in free if op.NEAR <= i < len(raw) - 1 and all(h[i] < h[j] for j in free if j != i and abs(i - j) <= op.NEAR)]
    assert op.cuts(raw).tolist() == want + [len(raw)] and max(np.diff([0, *want, len(raw)])) <= op.MOST


def test_an_insertion_moves_few_chunks():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    before = set(op.chunks(text)[0].tolist())
    after = op.chunks("new" + text[:9000] + "inserted" + text[9000:])[0].tolist()
    assert sum(d not in before for d in after) <= 12


def test_a_word_over_and_over(spark):
    rng = random.Random(6)
    rows = [(d, words(rng, rng.randrange(20, 60)) + " " + "again " * 60 + words(rng, 50)) for d in range(20)] + [(99, words(rng, 200))]
    got = {r.doc_id for r in op.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(20))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_repeated_passages(spark):
    rng = random.Random(4)
    passage, short = words(rng, 55), words(rng, 8)
    rows, have = [], set()
    for d in range(300):
        parts = [words(rng, rng.randrange(0, 300)), words(rng, rng.randrange(1, 200))]
        if d % 10 == 0:
            parts.insert(1, passage)
            have.add(d)
        if d % 10 == 5:
            parts.insert(1, short)
        rows.append((d, " ".join(parts)))
    rows += [(1000, rows[3][1]), (1001, None), (1002, ""), (1003, "same"), (1004, "same")]
    rows += [(7, rows[7][1]), (8, rows[8][1] + " more"), (None, words(rng, 100)), (None, passage)]
    have |= {3, 1000, None}
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as start")
    got = {r.doc_id: r for r in op.repeated_passages(df).collect()}
    assert set(got) == have
    assert got[1000].spans == f"0:{len(rows[3][1])}" and got[1000].first_doc_ids == [3]
    text = dict(rows[:300])
    for d in have - {3, 1000, None}:
        for span in got[d].spans.split(","):
            a, b = map(int, span.split(":"))
            assert text[d][a:b] in passage and b - a >= 0.35 * len(passage)
    kept = {}
    for r in op.without_repeats(df).collect():
        kept.setdefault(r.doc_id, []).append(r.text)
    assert kept[1000] == [""] and kept[3] == [rows[3][1]] and kept[1001] == [None]
    assert len(kept[20][0]) < len(text[20]) and kept[11] == [text[11]] and sorted(map(len, kept[8])) == [len(text[8]), len(text[8]) + 5]
    assert op.repeated_passages(df.limit(0)).count() == 0


def test_passages_of_short_words(spark):
    """51 words of one to three letters, in texts of such words."""
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = []
    for k in range(60):
        passage = say(51)
        rows += [(2 * k + i, f"{say(rng.randrange(20, 200))} {passage} {say(rng.randrange(20, 200))}") for i in range(2)]
    rows += [(1000 + k, say(300)) for k in range(200)]
    got = {r.doc_id for r in op.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert max(got) < 1000 and len(got) >= 0.75 * 120


def test_many_rows_of_one_id_and_of_none(spark):
    """Versions of one document share no repeat among them; rows without an id are documents of their own."""
    rng = random.Random(10)
    passage, other = words(rng, 60), words(rng, 60)
    rows = [(7, f"{words(rng, 30)} {passage} {words(rng, 30)}") for _ in range(3000)] + [(None, f"{words(rng, 30)} {other if k % 2 else words(rng, 60)} {words(rng, 30)}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = op.repeated_passages(df).collect()
    assert len(got) == 1500 and all(r.doc_id is None and r.first_doc_ids == [None] * r.n_runs for r in got)
    kept = [r.text for r in op.without_repeats(df).collect()]
    assert len(kept) == 6000 and sum(other in t for t in kept) == 1


def shared_runs(texts, n):
    """The texts that share n words in a row with another, by brute force over all windows."""
    first, found = {}, set()
    for i, t in enumerate(texts):
        own = (t or "").split()
        for k in range(len(own) - n + 1):
            j = first.setdefault(tuple(map(id_of, own[k : k + n])), i)
            if j != i:
                found |= {i, j}
    return found


_IDS = {}


def id_of(word):
    return _IDS.setdefault(word, len(_IDS))


def test_the_query_finds_all_that_brute_force_finds(spark):
    """Documents that share 51 words in a row are all found; what else is reported shares 20 at least, but for few."""
    from pulsegrid.llm.queries import op5_cdc_dedup

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids, texts = zip(*docs)
    got = {r.doc_id for r in op5_cdc_dedup(spark, sf).collect()}
    want = {ids[i] for i in shared_runs(texts, 51)}
    assert len(want) > 100 and want <= got
    less = {ids[i] for i in shared_runs(texts, 20)}
    assert len(got - less) <= 0.02 * len(got)
