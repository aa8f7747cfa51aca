import random
import string

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import token_automaton as op

MODEL = public_tokenizers.path("piece_bpe_32k.model")
library = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def machine():
    return op.Machine(MODEL)


def want(text):
    return len(library.encode(text or "", num_threads=1))


@settings(max_examples=800, deadline=None)
@given(st.one_of(st.text(), st.text(" ab\n▁é中"), st.text("aeinrst "), st.text("0123456789.,- "), st.builds(lambda w, k: w * k, st.text(max_size=4), st.integers(1, 40))))
def test_counts_equal_the_library(machine, text):
    assert machine.count(text) == want(text)
    assert machine.count(text, 3) == want(text)


def test_every_prefix_and_every_piece(machine):
    text = "The  quick\tbrown fox, jumped (over) 12345.67 straße naïve ▁▁ 中文字 \U0001f600 <unk> <s> <0x41> internationalisation" + " " * 19 + "a"
    assert all(machine.count(text[:k]) == want(text[:k]) for k in range(len(text) + 1))
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000, 7)]
    assert all(machine.count(p) == want(p) for p in pieces)


def test_tokens_that_follow_each_other(machine):
    rng = random.Random(3)
    pieces = [p for p in machine.score if machine.merges(p) is not None]
    for _ in range(4000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        parts = list(a + b)
        while True:
            scores = [machine.score.get(x + y, -1e99) for x, y in zip(parts, parts[1:])]
            if not scores or max(scores) == -1e99:
                break
            i = scores.index(max(scores))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert machine.follows(a, b) == (parts == [a, b])


def test_chunks_without_a_gap_and_few_states():
    rng = random.Random(5)
    small = op.Machine(MODEL, states=300)
    for text in ("a" * 5000, "ab" * 3000, " " * 4000, "".join(rng.choice(string.ascii_letters) for _ in range(6000)), "\n\t" * 900, "ﬁ中é" * 800, "ha" * 2000 + " " + "=" * 3000):
        assert small.count(text, 97) == want(text)


def test_prefixes_are_counts_of_chunks(machine):
    text = "one two  three four\nfive sixteen " * 40
    got = machine.prefixes(text, 50)
    s = " " + text
    assert len(got) == -(-len(s) // 50) and got[-1] == want(text)
    assert all(n == want(s[1 : 50 * (k + 1)]) for k, n in enumerate(got))


def test_maps_compose_from_any_state(machine):
    text = "▁und▁aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa▁the▁end"
    maps = [op.Leaf(machine, text[k : k + 5], set()) for k in range(0, len(text), 5)]
    for entry in (machine.FRESH, machine.run(machine.FRESH, "▁s")[0], machine.run(machine.FRESH, "aaa")[0]):
        ends = [machine.run(entry, text[: 5 * (k + 1)]) for k in range(len(maps))]
        assert [m(entry) for m in op.scan(maps)] == ends


def test_the_query_equals_the_library(spark):
    from pulsegrid.llm.queries import op12_token_automaton

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op12_token_automaton(spark, sf).collect())
    assert got == sorted((d, len((t or "").encode()), want(t), want(t) > 4096) for d, t in docs)


def test_odd_rows(spark):
    rows = [(1, None, 0), (1, None, 0), (2, "", 0), (None, " ", 0), (4, "x" * 200_000 + " é" * 5000, 0), (5, "<s>▁</s>\x00\n", 0)]
    got = sorted((tuple(r) for r in op.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), MODEL).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), want(t), want(t) > 4096) for d, t, _ in rows), key=str)
    assert op.count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_models_of_another_kind_are_refused():
    with pytest.raises(Exception):
        op.Machine(public_tokenizers.path("byte_bpe_50k.json"))
