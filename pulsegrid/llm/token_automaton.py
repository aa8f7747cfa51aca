"""Token counts by a finite-state transducer that is compiled from a piece vocabulary.

The transducer reads characters; each transition carries by how much the number of tokens of what has been read changes. Two
properties of byte-pair merges (best score first, leftmost of equals) make it finite: a prefix that ends where a token ends
has the tokens that the whole text has there, and tokens that stand side by side pairwise do so in a row. So the last token of a prefix
is the one that may follow the last token of the shorter prefix before it, and a state need only hold, for every end of
what has been read that begins some piece, which token stands before that end and how many tokens less it has.

States are compiled on demand, and so are transitions by whole words, which compose those of their characters: no piece has a
space after another character, so that every word but a chunk's first begins in the same state. A text is cut into chunks; a chunk's map takes a state to the state at its end and the
change of the count, and maps compose, so that they can be made before it's known in which state a chunk begins: from the
states that the characters before it allow. A prefix scan composes them.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import large_caches, small

LIMIT = 4096
#: Code points of a chunk.
CHUNK = 4096
#: States, and as many words, that a worker keeps; beyond that it compiles anew.
STATES = 200_000
#: Characters of words that are kept.
WORD = 24
_SPACE = "▁"
_WORDS = re.compile(f"[^{_SPACE}]+|{_SPACE}+[^{_SPACE}]*")

#: What a state knows: (an end of what was read that begins a piece, the token before that end or None if nothing depends
#: on it, the change of the count up to there), longest first.
Chain = tuple[tuple[str, str | None, int], ...]


class State(dict):
    """Transitions by character: (next state, change of the count)."""

    __slots__ = ("chain", "machine")

    def __init__(self, machine: Machine, chain: Chain):
        self.machine, self.chain = machine, chain

    def __missing__(self, ch: str) -> tuple[State, int]:
        found = self[ch] = self.machine.step(self.chain, ch)
        return found


class Machine:
    FRESH: Chain = (("", None, 0),)

    def __init__(self, model: str, states: int = STATES):
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = [i for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.score = {library.id_to_piece(i): library.get_score(i) for i in ids}
        self.starts = {p[:k] for p in self.score for k in range(len(p))}
        self.pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.longest = max(map(len, self.score))
        self.most, self.states, self.words, self.made = states, {}, {}, {}
        for probe in ("a", "  two  spaces ", "ﬁ Å\n\t́ <s> ▁", "\U0001f600\U000e0001 the end."):
            if len(library.encode(probe, num_threads=1)) != self.count(probe):
                raise ValueError("the model isn't a plain one: merges by score, byte fallback, a space before the text, nothing normalised")
        if any(p[1] == _SPACE != p[0] for p in self.pairs):
            raise ValueError("a piece of the model has a space after another character")

    def merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """What makes the piece of its characters: (score, first part, last part) before each merge; None if merges end elsewhere."""
        if piece not in self.made:
            parts, done = list(piece), []
            while len(parts) > 1:
                scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
                best = max((s for s in scores if s is not None), default=None)
                if best is None:
                    break
                i = scores.index(best)
                done.append((best, parts[0], parts[-1]))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.made[piece] = done if len(parts) == 1 else None
        return self.made[piece]

    def follows(self, left: str | None, right: str) -> bool:
        """Whether the two tokens stay as they are side by side: no merge across comes first while both are made."""
        if left is None:
            return True
        a, b = self.merges(left), self.merges(right)
        i = j = 0
        while True:
            x = a[i][2] if i < len(a) else left
            y = b[j][1] if j < len(b) else right
            across = self.score.get(x + y)
            own, other = (a[i][0] if i < len(a) else None), (b[j][0] if j < len(b) else None)
            if across is not None and (own is None or across > own) and (other is None or across >= other):
                return False
            if own is None and other is None:
                return True
            if other is None or (own is not None and own >= other):
                i += 1
            else:
                j += 1

    def state(self, chain: Chain) -> State:
        found = self.states.get(chain)
        if found is None:
            found = self.states[chain] = State(self, chain)
        return found

    def step(self, chain: Chain, ch: str) -> tuple[State, int]:
        if ch not in self.score:
            return self.state(self.FRESH), len(ch.encode())
        for end, before, less in chain:
            token = end + ch
            if token in self.score and self.merges(token) is not None and self.follows(before, token):
                change = less + 1
                break
        longer = []
        for end, before, less in chain:
            if end + ch in self.starts:
                if not end and before is not None and before[-1] + ch not in self.pairs:
                    before = None
                longer.append((end + ch, before, less - change))
        return self.state((*longer, ("", token, 0))), change

    def walk(self, state: State, text: str) -> tuple[State, int]:
        n = 0
        for ch in text:
            state, change = state[ch]
            n += change
        return state, n

    def run(self, chain: Chain, text: str) -> tuple[Chain, int]:
        """The state after the text, and the change of the count."""
        if len(self.states) > self.most:
            self.states, self.words = {}, {}
            gc.collect()  # states refer to each other
        elif len(self.words) > self.most:
            self.words = {}
        fresh, words = self.state(self.FRESH), _WORDS.findall(text)
        state, n = self.walk(self.state(chain), words[0] if words else "")
        for word in words[1:]:
            found = self.words.get(word)
            if found is None:
                found = self.walk(fresh, word)
                if len(word) <= WORD:
                    self.words[word] = found
            state, change = found
            n += change
        return state.chain, n

    def entries(self, before: str) -> set[Chain]:
        """States that the characters before a chunk allow: the only one, where no piece reaches over one of them."""
        for k in range(len(before) - 1, 0, -1):
            if before[k - 1 : k + 1] not in self.pairs:
                return {self.run(self.FRESH, before[k:])[0]}
        return {self.run(self.FRESH, before[k:])[0] for k in range(len(before))}

    def prefixes(self, text: str | None, chunk: int = CHUNK) -> list[int]:
        """The number of tokens up to the end of each chunk of the text; of an empty one, none."""
        if not text:
            return []
        s = _SPACE + text.replace(" ", _SPACE)
        maps = [Leaf(self, s[at : at + chunk], self.entries(s[max(0, at - 2 * self.longest) : at]) if at else {self.FRESH}) for at in range(0, len(s), chunk)]
        return [m(self.FRESH)[1] for m in scan(maps)]

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        return self.prefixes(text, chunk)[-1] if text else 0


class Leaf:
    """A chunk's map, made for the states given; one that's missing among these is added when it's asked for."""

    def __init__(self, machine: Machine, text: str, entries: set[Chain]):
        self.machine, self.text = machine, text
        self.known = {e: machine.run(e, text) for e in entries}

    def __call__(self, entry: Chain) -> tuple[Chain, int]:
        if entry not in self.known:
            self.known[entry] = self.machine.run(entry, self.text)
        return self.known[entry]


class Both:
    """The map of two neighbours, from all states that the left one has."""

    def __init__(self, left: Leaf | Both, right: Leaf | Both):
        self.left, self.right, self.known = left, right, {}
        for e in list(left.known):
            self(e)

    def __call__(self, entry: Chain) -> tuple[Chain, int]:
        if entry not in self.known:
            middle, n = self.left(entry)
            end, m = self.right(middle)
            self.known[entry] = end, n + m
        return self.known[entry]


def scan(maps: list) -> list:
    """The maps of all prefixes: neighbours are paired, the half as many pairs scanned, and the odd places filled in."""
    if len(maps) < 2:
        return maps
    above = scan([Both(a, b) for a, b in zip(maps[::2], maps[1::2])])
    return [m if not i else above[i // 2] if i % 2 else Both(above[i // 2 - 1], m) for i, m in enumerate(maps)]


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs, as the library counts with the model's file (its path on
    every machine), without begin and end.

    Null and empty texts have no bytes and no tokens; repeated rows are each counted; strings of special tokens are ordinary text, as the
    library has them; an empty table gives an empty one; other columns are not looked at. One pass over whole texts,
    nothing shuffled; a worker's memory is bounded by STATES and its longest text.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(model)
        for b in small(it):
            with large_caches():
                n = [machine.count(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
