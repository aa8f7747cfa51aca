"""Alignment of two tokenizers' tokens by a transducer over dangling suffixes.

Both tokenizers cut the same bytes. Read side by side, one of them is ahead by some bytes at any time: the dangling suffix of
its last token. The state is which side leads and these bytes; the next token of the other side leads to the next state, and
whatever comes before doesn't matter, so transitions are kept by state and token. A group ends where nothing dangles. Each token that
is taken overlaps the last one of the other side, and no other pairs overlap: these are the links.

Where a space stands between two visible characters both tokenizers cut, so that nothing dangles there: texts are taken apart
into such words, and what the transducer makes of a word is kept for the next time that it occurs.

How often two ids are linked is counted over the corpus. Documents are kept in blocks with one list of their links' ids, so that what
is joined with the counts is a block's list, not each document's.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm.shared import large_caches, park, small

#: Code points of text in a block; a longer text is one by itself.
BLOCK = 2_000_000
#: Bytes of blocks that a task holds before it writes them.
ROWS = 16 << 20
#: Code points that are given to the tokenizers at once; a longer word is by itself.
AT_ONCE = 200_000
#: Transitions, and words of up to WORD characters, that a worker keeps; beyond that it starts anew.
TRANSITIONS, WORDS, WORD = 300_000, 500_000, 40
#: Bits of a link's number that are the B id's.
_BITS = 24
#: Here both tokenizers cut: the space begins a token of either. Printable ASCII and Latin letters, of which none is white space.
_GAP = re.compile("(?<=[!-~\u00a1-\u024f]) (?=[!-~\u00a1-\u024f])")
_VISIBLE = frozenset(map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x250))))


def byte_level() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: printable ones stand for themselves, others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabularies:
    """Both tokenizers, and every token's bytes. A has a token for each byte and changes none, so that its tokens always have a text's
    bytes; if B's are the same they are the text's too."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        known, kind = byte_level(), json.loads(self.a.to_str())
        if kind["normalizer"] or kind["pre_tokenizer"].get("type") != "ByteLevel" or kind["pre_tokenizer"].get("add_prefix_space") or not set(known) <= set(kind["model"]["vocab"]):
            raise ValueError("A isn't a byte-level tokenizer that gives every text back as it is")
        self.bytes_a = {i: bytes(known[c] for c in t) if all(c in known for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.size_a = {i: len(x) for i, x in self.bytes_a.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """For each text, a space before it, the ids of both. For A texts that begin and end with a visible character are put into one,
        which it takes apart again where the spaces are, and that is cut by the tokens' bytes: each text by itself costs more."""
        whole = [t[:1] in _VISIBLE and t[-1:] in _VISIBLE for t in texts]
        together = " " + " ".join(t for t, w in zip(texts, whole) if w)
        one, *alone = self.a.encode_batch_fast([together, *(" " + t for t, w in zip(texts, whole) if not w)], add_special_tokens=False)
        ids, at, rest, first = one.ids, 0, iter(alone), []
        for t, w in zip(texts, whole):
            if not w:
                first.append(next(rest).ids)
                continue
            since, left = at, len(t.encode()) + 1
            while left > 0:
                left -= self.size_a[ids[at]]
                at += 1
            first.append(ids[since:at])
        return list(zip(first, self.b.encode(texts, num_threads=1)))


class Dangling(dict):
    """A state: whether A leads, and by which bytes. Transitions by the next token: of A where nothing dangles, else of the side
    that doesn't lead; None where the bytes differ."""

    __slots__ = ("a_leads", "rest", "transducer")

    def __init__(self, transducer: Transducer, a_leads: bool, rest: bytes):
        self.transducer, self.a_leads, self.rest = transducer, a_leads, rest

    def __missing__(self, token: int) -> Dangling | None:
        found = self[token] = self.transducer.step(self, token)
        return found


class Transducer:
    def __init__(self, bytes_a, bytes_b, transitions: int = TRANSITIONS):
        self.bytes_a, self.bytes_b, self.most = bytes_a, bytes_b, transitions
        self.clear()

    def clear(self) -> None:
        self.nothing, self.states, self.made = Dangling(self, False, b""), {}, 0

    def step(self, state: Dangling, token: int) -> Dangling | None:
        self.made += 1
        rest, new = state.rest, (self.bytes_b if state.a_leads else self.bytes_a)[token]
        if rest == new:
            return self.nothing
        if rest.startswith(new):
            key = state.a_leads, rest[len(new) :]
        elif new.startswith(rest):
            key = not state.a_leads, new[len(rest) :]
        else:
            return None
        if key not in self.states:
            self.states[key] = Dangling(self, *key)
        return self.states[key]

    def align(self, first: list[int], second: list[int]) -> tuple[list[str], list[int]] | None:
        """The groups as text and the links as numbers (a << _BITS | b), or None if the two don't have the same bytes."""
        if self.made > self.most:
            self.clear()
        groups, links, nothing, i, j = [], [], self.nothing, 0, 0
        try:
            while i < len(first):
                a, b, since, from_ = first[i], second[j], i, j
                i, j = i + 1, j + 1
                state = nothing[a][b]
                links.append(a << _BITS | b)
                if state is nothing:
                    groups.append(f"{a}|{b}")
                    continue
                while state is not nothing:
                    if state is None:
                        return None
                    if state.a_leads:
                        b = second[j]
                        j += 1
                        state = state[b]
                    else:
                        a = first[i]
                        i += 1
                        state = state[a]
                    links.append(a << _BITS | b)
                groups.append(f"{','.join(map(str, first[since:i]))}|{','.join(map(str, second[from_:j]))}")
        except IndexError:  # one side ends while bytes of the other dangle
            return None
        return (groups, links) if j == len(second) else None


class Aligner:
    """Words by what they are made of: (number of A's tokens, groups as text, links as bytes), or None where the bytes differ.

    A group of so many tokens has one link less, so the number of B's follows from these.
    """

    def __init__(self, both: Vocabularies):
        self.both, self.transducer, self.known = both, Transducer(both.bytes_a, both.bytes_b), {}

    def word(self, first: list[int], second: list[int]) -> tuple[int, str, bytes] | None:
        found = self.transducer.align(first, second)
        return found and (len(first), ";".join(found[0]), array("q", found[1]).tobytes())

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """For each text its numbers of A's tokens, B's tokens and groups, the groups as text, and the links; nothing where it's empty
        or the bytes of a word differ."""
        if len(self.known) > WORDS:
            self.known = {}
        known, words = self.known, [_GAP.split(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(words)).difference(known))
        group, size = [], 0
        for i, w in enumerate(new):
            group.append(w)
            size += len(w)
            if size >= AT_ONCE or i + 1 == len(new):
                known.update((x, self.word(*both)) for x, both in zip(group, self.both.encode(group)))
                group, size = [], 0
        for own in words:
            found = list(map(known.__getitem__, own))
            if not found or None in found:
                yield 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            numbers, listed, links = zip(*found)
            first, joined, own = sum(numbers), ";".join(listed), np.frombuffer(b"".join(links), np.int64)
            groups = joined.count(";") + 1
            yield first, len(own) - first + groups, groups, joined, own
        for w in new:
            if len(w) > WORD:
                del known[w]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, all lowest ones first, which compresses well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string()), ("groups", pa.string()), ("gaps", pa.binary()), ("times", pa.binary())])


def _blocks(docs: DataFrame, a: str, b: str, groups: bool, block: int) -> DataFrame:
    """Rows of documents that stand together: block, docs, and the different links of all (pairs) with how often they occur (n).

    A document's links are places in `pairs`, as gaps, and how often each occurs.
    """

    def pack(number: int, rows: list[tuple], links: list[np.ndarray]) -> pa.RecordBatch:
        found, where = np.unique(np.concatenate(links), return_inverse=True)
        n = np.zeros(len(found), np.int64)
        out, at = [], 0
        for row, own in zip(rows, links):
            place, times = np.unique(where[at : at + len(own)], return_counts=True)
            at += len(own)
            n[place] += times
            out.append(dict(zip(_DOC.names, (*row, _planes(np.diff(place, prepend=0)), _planes(times)))))
        columns = [pa.array([number], pa.int64()), pa.array([out], pa.list_(_DOC)), pa.array([found], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["block", "docs", "pairs", "n"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Vocabularies(a, b))
        number, rows, links, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in small(it, 64):
            texts = batch.column(1).to_pylist()
            with large_caches():
                aligned = list(aligner.texts(texts))
            for doc_id, text, (one, two, n, listed, own) in zip(batch.column(0).to_pylist(), texts, aligned):
                rows.append((doc_id, one, two, n, len(own), hashlib.sha256(listed.encode()).hexdigest() if listed else "", listed if groups else None))
                links.append(own)
                size += len(text or "")
                if size >= block:
                    yield pack(number, rows, links)
                    number, rows, links, size = number + 1, [], [], 0
        if rows:
            yield pack(number, rows, links)

    schema = "block long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, sha: string, groups: string, gaps: binary, times: binary>>, pairs array<long>, n array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _counts(blocks: DataFrame) -> DataFrame:
    """pair, count, best: whether no A id has more links with the pair's B id. An id has at most as many partners as the other
    vocabulary has ids, which bounds the window's groups."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).select("x.pairs", "x.n")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(2**_BITS - 1)))
    return counts.withColumn("best", F.col("count") == most)


def links(docs: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """a, b, count, best: how often the ids of the two vocabularies are linked over all rows of docs."""
    found = _counts(park(_blocks(docs, a, b, False, block), "aligned", ROWS)[0])
    return found.select(F.shiftright("pair", _BITS).alias("a"), F.col("pair").bitwiseAND(2**_BITS - 1).alias("b"), "count", "best")


def align(docs: DataFrame, a: str, b: str, groups: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs, and with groups=True the groups.

    a: a byte-level tokenizer's json file, b: a piece model with a space before the text and byte fallback; paths on every machine. Null
    and empty texts, and those that a tokenizer doesn't give back (with U+2581 in them), have no tokens: zeros, an empty digest and
    no links for the counts. Repeated rows each count. Of counts that tie all are best; strings of special tokens are ordinary
    text; an empty table gives an empty one; other columns are not looked at.

    Texts are read and aligned once and kept in blocks of BLOCK characters; only lists of different links are joined with counts.
    Memory is bounded by the block, the longest text and the words that a worker keeps.
    """
    blocks, _ = park(_blocks(docs, a, b, groups, block), "aligned", ROWS)
    each = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    rated = each.join(_counts(blocks), "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("rated"))
    rated = rated.select("block", F.col("rated.count").alias("counts"), F.col("rated.best").alias("bests"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if groups else "")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it, 1):
            counts, bests = (np.array(batch.column(k)[0].as_py() or [], t) for k, t in ((1, np.int64), (2, bool)))
            rows = []
            for d in batch.column(0)[0].as_py():
                at, times = np.cumsum(_numbers(d["gaps"])), _numbers(d["times"])
                rows.append((d["doc_id"], d["n_a"], d["n_b"], d["n_groups"], d["n_links"], int(times[bests[at]].sum()), int((times * counts[at]).sum()), d["sha"], *([d["groups"]] if groups else [])))
            types = [pa.int64()] * 7 + [pa.string()] * (2 if groups else 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in schema.split(", ")])

    return blocks.select("block", "docs").join(rated, "block", "left").select("docs", "counts", "bests").mapInArrow(run, schema)
