import hashlib
import random
import re
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import lyndon_runs as op


def brute(words, least=6, exponent=4):
    """Every period by itself: stretches where words p apart are equal, kept if no smaller period spans them."""
    found, n = {}, len(words)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if length >= max(least, exponent * p) and not any(a <= i and i + length <= a + b for a, b in found):
                found[i, length] = p
            i = j
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda x: (x[0], x[2]))


def edges_by_suffixes(s):
    n = len(s)
    out, match = [n] * n, [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if s[j:] < s[i:]:
                out[i] = j
                while j + match[i] < n and s[i + match[i]] == s[j + match[i]]:
                    match[i] += 1
                break
    back = [0] * n
    for i, j in enumerate(out):
        while j < n and back[i] < i and s[i - back[i] - 1] == s[j - back[i] - 1]:
            back[i] += 1
    return out, match, back


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 1), max_size=40), st.lists(st.integers(0, 2), max_size=30), st.builds(lambda w, k, t: (w * k)[: len(w) * k - t], st.lists(st.integers(0, 1), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 3))))
def test_edges_and_runs_equal_their_definitions(s):
    following, match = op.edges(s)
    assert (following, match, op.before(s, following)) == edges_by_suffixes(s)
    for least, exponent in ((6, 4), (2, 2), (1, 3)):
        assert [tuple(x) for x in op.runs(s, least, exponent)] == brute(s, least, exponent)


def test_all_short_words_over_two_symbols():
    for n in range(1, 13):
        for k in range(2**n):
            s = [k >> i & 1 for i in range(n)]
            following, match = op.edges(s)
            assert (following, match, op.before(s, following)) == edges_by_suffixes(s)


class Counted(int):
    """An int that counts comparisons."""

    n = 0

    def __eq__(self, other):
        Counted.n += 1
        return int(self) == int(other)

    def __lt__(self, other):
        Counted.n += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


def test_comparisons_grow_with_the_words():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    rng = random.Random(1)
    nested = [0]
    while len(nested) < 20_000:
        nested = nested + [rng.randrange(3)] + nested
    for s in (fib[-1], [0] * 20_000, [0, 1] * 10_000, [0] * 10_000 + [1] + [0] * 10_000, nested, [rng.randrange(2) for _ in range(20_000)], list(range(20_000)), list(range(20_000, 0, -1))):
        own = [Counted(x) for x in s]
        Counted.n = 0
        following, _ = op.edges(own)
        op.before(own, following)
        assert Counted.n <= 7 * len(s)


def test_ties_and_odd_words():
    assert op.runs([]) == [] and op.runs(["a"] * 5) == []
    assert op.runs(["a"] * 6) == [(0, 6, 1)]
    two = ["x", *"abcabcabcabc", "y", *"dddddddd", "z", *"eeeeeeee"]
    found = op.runs(two)
    assert found == [(1, 12, 3), (14, 8, 1), (23, 8, 1)] and op.strongest(found) == (14, 8, 1)
    assert op.collapsed(two, found) == ["x", *"abc", "y", "d", "z", "e"]
    assert op.runs([str(i) for i in range(2000)] * 4) == [(0, 8000, 2000)]


def words_of(text, doc_id):
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = words_of(text, doc_id)
    found = brute(words)
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *own, hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in found).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_the_query_equals_brute_force(spark):
    from pulsegrid.llm.queries import op13_lyndon_runs

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {d: t for d, t in docs if len(t or "") < 6000}
    got = [tuple(r) for r in op13_lyndon_runs(spark, sf).collect()]
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got) > 20
    assert sorted(r for r in got if r[0] in short) == sorted(expected(d, t) for d, t in short.items())


def test_odd_rows(spark):
    rows = [(1, None, 0), (1, None, 0), (2, "", 0), (3, " \n\t ", 0), (None, "a a a a a a a", 0), (5, "no break " * 9 + "x" * 300_000, 0), (6, "ab " * 40_000, 0)]
    got = op.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, n_runs int"), text=True).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == 7 and all(tuple(r)[1:] == (0, None, None, None, None, nothing, nothing, "") for r in got if r.doc_id in (1, 2, 3))
    one = {r.doc_id: r for r in got}
    assert tuple(one[None])[1:6] == (1, 0, 7, 1, 7000) and one[None].collapsed == "a"
    assert tuple(one[5])[1:6] == (1, 0, 9, 1, 9000) and len(one[5].collapsed) == 300_009
    assert tuple(one[6])[1:6] == (1, 0, 40_000, 1, 40_000_000)
    assert op.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
