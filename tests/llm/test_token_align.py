import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import token_align as op

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return op.Vocabularies(A, B)


def by_offsets(both, text):
    """Ids, groups and links of a text from byte offsets, or nothing."""
    if not text:
        return [], [], [], []
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(both.bytes_a[i] for i in a) != raw or b"".join(both.bytes_b[i] for i in b) != raw:
        return [], [], [], []

    def spans(ids, sizes):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(sizes[i]), i))
            at += len(sizes[i])
        return out

    one, two = spans(a, both.bytes_a), spans(b, both.bytes_b)
    ends = sorted({e for _, e, _ in one} & {e for _, e, _ in two})
    groups, low, i, j = [], 0, 0, 0
    for e in ends:
        own, other = [], []
        while i < len(one) and one[i][1] <= e:
            own.append(str(one[i][2]))
            i += 1
        while j < len(two) and two[j][1] <= e:
            other.append(str(two[j][2]))
            j += 1
        groups.append(",".join(own) + "|" + ",".join(other))
    links, low = [], 0
    for s, e, x in one:
        while low < len(two) and two[low][1] <= s:
            low += 1
        k = low
        while k < len(two) and two[k][0] < e:
            links.append((x, two[k][2]))
            k += 1
    return a, b, groups, links


def expected(both, rows):
    found = [(d, by_offsets(both, t)) for d, t in rows]
    counts = Counter(x for _, (_, _, _, links) in found for x in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return counts, most, [
        (d, len(a), len(b), len(g), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, (a, b, g, links) in found
    ]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab '\n1é中▁<|>ndoftex"), st.builds(lambda w, k: w * k, st.text(max_size=5), st.integers(1, 20))))
def test_groups_and_links_equal_offsets(both, text):
    machine = op.Transducer(both.bytes_a, both.bytes_b)
    ((x, y),) = both.encode([text])
    assert b"".join(both.bytes_a[i] for i in x) == b" " + text.encode()
    got = machine.align(x, y)
    a, b, groups, links = by_offsets(both, text)
    assert (got or ([], []))[0] == groups and [(n >> op._BITS, n % 2**op._BITS) for n in (got or ([], []))[1]] == links


def test_sides_that_differ_or_end_early():
    machine = op.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"x"], transitions=1)
    assert machine.align([0, 1], [0, 1]) == (["0,1|0,1"], [0, 1, 1 << op._BITS | 1])
    assert machine.align([2], [0, 1]) == (["2|0,1"], [2 << op._BITS, 2 << op._BITS | 1])
    assert machine.align([0, 1], [0]) is None and machine.align([0], [0, 1]) is None and machine.align([0], [2]) is None
    assert machine.align([2], [0, 1, 2]) is None and machine.align([], []) == ([], []) and machine.align([], [1]) is None


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text("ab 'sé1.\u00a0\n▁-"), st.text(" aéß€中\u0301\t9!"), st.text()))
def test_words_of_a_text_have_the_tokens_of_the_whole(both, text):
    a, b = both.encode([text])[0] if text else ([], [])
    words = both.encode(op._GAP.split(text)) if text else []
    assert [i for x, _ in words for i in x] == a and [i for _, y in words for i in y] == b


def test_no_character_beside_a_gap_is_white_space(both):
    seen = [chr(c) for c in range(33, 0x250) if op._GAP.search(f"a {chr(c)}") and op._GAP.search(f"{chr(c)} a")]
    assert len(seen) > 500 and not any(c.isspace() for c in seen)
    for c in seen:
        for text in (f"a {c}", f"{c} a", f"{c} {c}", f"1 {c} ."):
            words = both.encode(op._GAP.split(text))
            assert both.encode([text])[0] == ([i for x, _ in words for i in x], [i for _, y in words for i in y])


def test_tokenizers_of_another_kind_are_refused():
    with pytest.raises(ValueError):
        op.Vocabularies(public_tokenizers.path("word_bpe_49k.json"), B)


def test_words_are_kept_and_forgotten(both, monkeypatch):
    monkeypatch.setattr(op, "WORDS", 3)
    monkeypatch.setattr(op, "AT_ONCE", 5)
    aligner = op.Aligner(both)
    for text in ("one two three four five", "one ▁ two", "", None, "five " * 50 + "x" * 99, "one two three four five"):
        ((one, two, n, listed, links),) = aligner.texts([text])
        a, b, groups, own = by_offsets(both, text)
        assert (one, two, n, listed) == (len(a), len(b), len(groups), ";".join(groups))
        assert [(k >> op._BITS, k % 2**op._BITS) for k in links.tolist()] == own
        assert len(aligner.known) <= 9


def test_the_query_equals_brute_force(spark, both):
    from pulsegrid.llm.queries import op11_token_align

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts, most, want = expected(both, rows)
    assert sorted(tuple(r) for r in op11_token_align(spark, sf).collect()) == sorted(want)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(tuple(r) for r in op.align(docs.repartition(3), A, B, block=3000).collect()) == sorted(want)
    got = {(r.a, r.b): (r["count"], r.best) for r in op.links(docs, A, B, block=50_000).collect()}
    assert got == {x: (n, n == most[x[1]]) for x, n in counts.items()}


def test_odd_rows(spark, both):
    rows = [(1, None), (1, None), (2, ""), (None, " "), (3, "a ▁ b"), (4, "<|endoftext|><s>\x00"), (4, "<|endoftext|><s>\x00"), (5, "long words " * 30_000), (6, "x" * 150_000)]
    docs = spark.createDataFrame([(*r, "g", 7) for r in rows], "doc_id long, text string, groups string, block int")
    *_, want = expected(both, rows)
    got = op.align(docs, A, B, groups=True)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=str) == sorted(want, key=str)
    assert {hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in got.collect()} == {x[7] for x in want}
    assert op.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
