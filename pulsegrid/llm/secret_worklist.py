"""Secret scans with a decoding worklist.

Each text is scanned as it stands. Then a worklist unwraps what is encoded in it: percent and Unicode escapes, base64 and
compressed data, one layer at a time and each layer's own encoded parts again, until nothing new turns up. A layer that
equals one of those it came from is not followed (cycle). Every layer is scanned, and what it holds is mapped back to the
characters of the original text that encode it.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import math
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import small

KINDS = ("assign", "access", "hex")
#: For those who set a limit, against bombs of compression or of escapes: a document's layers have so many characters in all at
#: most. A layer that passes it is left where it is, `truncated` tells, and `unread` has its place; all others are gone through,
#: small ones first. What is compressed more often than MAX_DEEP times is left too. Without a limit nothing is left: large layers
#: stream through in pieces, of any number.
MAX_INFLATED = 64 << 20
#: What is inflated is held in pieces of so many bytes, which overlap.
PIECE, OVERLAP, MAX_DEEP = 1 << 20, 1 << 16, 64

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_STEMS = ("passw", "secret", "token", "api")

#: A percent sign that is itself escaped, however often, is undone at once.
_URL = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, of which the last may be short; a line's end may be written as in a string of JSON.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r?\n|\\r\\n|\\n)[ \t]*+[A-Za-z0-9+/_-]{16,}+)*(?:\r?\n|\\r\\n|\\n)[ \t]*+[A-Za-z0-9+/_-]++={0,2}")
_LINE_END = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*")
_BOUNDARY = re.compile(r"[/_+-]")
#: What compressed data begins with: gzip, zlib, bzip2, xz, zstd.
_STARTS = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
_BYTE = re.compile(r"(?:%(?:25)*|\\x)([0-9A-Fa-f]{2})|([!-$&-~])")


def _escaped(byte: int) -> str:
    plain = f"|{re.escape(chr(byte))}" if chr(byte).isalnum() or chr(byte) in "(/^" else ""
    return rf"(?:(?:%(?:25)*|\\x)(?i:{byte:02x}){plain})"


#: Compressed bytes of which those that aren't plain characters are escaped.
_PACKED = re.compile(rf"({'|'.join(''.join(map(_escaped, x)) for x in _STARTS)})(?:(?:%(?:25)*|\\x)[0-9A-Fa-f]{{2}}|[!-$&-~])*")


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base spans (kind, start, end), leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """Decoded text whose character i stands for the characters start[i]:end[i] of the document."""

    __slots__ = ("text", "start", "end", "above")

    def __init__(self, text: str, start, end, above: frozenset):
        self.text, self.start, self.end, self.above = text, start, end, above

    def place(self, a: int, b: int) -> tuple[int, int]:
        return min(self.start[a:b]), max(self.end[a:b])


class _Shift:
    """The document itself: character i stands for i:i + by."""

    def __init__(self, by: int):
        self.by = by

    def __getitem__(self, k):
        return range(k.start + self.by, k.stop + self.by) if isinstance(k, slice) else k + self.by


class _Same:
    """Characters that all stand for the same place."""

    def __init__(self, at: int):
        self.at = at

    def __getitem__(self, k):
        return (self.at,) * (k.stop - k.start) if isinstance(k, slice) else self.at


def _bytes(chars: str) -> bytes:
    body = chars.replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _magic(head: bytes) -> bool:
    """Whether compressed data begins so. Without the library that its kind needs this fails, since what it holds would go unread."""
    return _decompressor(head) is not None


def _begins(head: bytes) -> bool:
    """Whether a readable text may begin with these bytes, of which the last character may be cut off."""
    try:
        return _readable(head.decode())
    except UnicodeDecodeError as e:
        return e.start >= 12 and _readable(head[: e.start].decode())


def _readable(text: str) -> bool:
    odd = sum(1 for c in text if not (c.isprintable() or c in "\t\r\n"))
    return bool(text) and odd * 20 <= len(text)


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _members(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """What the blocks hold, compressed by gzip, zlib, bzip2, xz or zstd, all members in turn, in pieces of PIECE bytes at most
    (zstd: of a block's). Damage ends it."""
    try:
        d, rest = None, b""
        for block in blocks:
            rest += block
            while rest and (d is not None or len(rest) >= 8):  # no member is shorter
                if d is None and (d := _decompressor(rest)) is None:
                    return
                if isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                    out, rest = d.decompress(rest, PIECE), b""
                    while out:
                        yield out
                        out = b"" if d.eof or d.needs_input else d.decompress(b"", PIECE)
                elif hasattr(d, "unconsumed_tail"):
                    out = d.decompress(rest, PIECE)
                    while out:
                        yield out
                        out = b"" if d.eof else d.decompress(d.unconsumed_tail, PIECE)
                    rest = b""
                else:
                    yield d.decompress(rest)
                    rest = b""
                if d.eof:
                    rest, d = d.unused_data, None
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, RuntimeError):
        return
    except Exception as e:  # zstandard's own error class, where that library is installed
        if type(e).__name__ == "ZstdError":
            return
        raise


def _inflate(raw: bytes, limited: bool = True) -> Iterator[bytes | None] | None:
    """The pieces of what raw holds, once everything that is compressed more than once is undone; where it's limited, a single None
    if that goes on beyond MAX_DEEP. None if it isn't compressed."""
    pieces, deep = iter((raw,)), 0
    while True:
        head = next(pieces, b"")
        while len(head) < 8 and (more := next(pieces, b"")):
            head += more
        pieces = chain((head,), pieces)
        if not _magic(head):
            return (p for p in pieces if p) if deep else None
        if deep and deep % MAX_DEEP == 0:
            if limited:
                return iter((None,))
            pieces = iter((b"".join(pieces),))  # so that iterators aren't nested any deeper
        pieces, deep = _members(pieces), deep + 1


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    """The pieces as texts that overlap; ends at the first that isn't readable."""
    decoder, kept = codecs.getincrementaldecoder("utf-8")(), ""
    for p in pieces:
        try:
            t = decoder.decode(p)
        except UnicodeDecodeError:
            return
        if t and not _readable(t):
            return
        kept += t
        if len(kept) >= PIECE:
            yield kept
            kept = kept[-OVERLAP:]
    if kept:
        yield kept


def _escapes(layer: Layer, pattern: re.Pattern, decode) -> Iterator[Layer]:
    """A layer for each line that has escapes; other characters of the line stay as they are, as a secret may be escaped in part."""
    done = 0
    for hit in pattern.finditer(layer.text):
        if hit.start() < done:
            continue
        a = layer.text.rfind("\n", done, hit.start()) + 1 or done
        b = layer.text.find("\n", hit.end())
        done = b = len(layer.text) if b < 0 else b
        chars, start, end, at = [], [], [], a
        for m in pattern.finditer(layer.text, a, b):
            if m.start() < at:
                continue
            _as_it_is(layer, at, m.start(), chars, start, end)
            for piece, i, j in decode(layer.text, m.start(), b):
                s, e = layer.place(i, j)
                chars.append(piece)
                start.append(s)
                end.append(e)
                at = j
        _as_it_is(layer, at, b, chars, start, end)
        yield Layer("".join(chars), start, end, layer.above)


def _as_it_is(layer: Layer, a: int, b: int, chars: list, start: list, end: list) -> None:
    chars.append(layer.text[a:b])
    start.extend(layer.start[a:b])
    end.extend(layer.end[a:b])


def _url(text: str, a: int, b: int) -> Iterator[tuple[str, int, int]]:
    """The characters of the run of escapes at a, each with the escapes that it stands for."""
    raw, ends = bytearray(), [a]
    while m := _URL.match(text, ends[-1], b):
        raw.append(int(m[1], 16))
        ends.append(m.end())
    k = 0
    while k < len(raw):  # a character of several bytes stands for all its escapes
        n = next((n for n in (1, 2, 3, 4) if _utf8(bytes(raw[k : k + n]))), 0)
        yield (raw[k : k + n].decode() if n else "\ufffd"), ends[k], ends[k + (n or 1)]
        k += n or 1


def _utf8(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def _unicode(text: str, a: int, b: int) -> Iterator[tuple[str, int, int]]:
    """The character of the escape at a, or of the two escapes of a surrogate pair."""
    m = _ESCAPE.match(text, a, b)
    code, j = _code(m), m.end()
    if 0xD800 <= code < 0xDC00 and (n := _ESCAPE.match(text, j, b)) and 0xDC00 <= (low := _code(n)) < 0xE000:
        code, j = 0x10000 + ((code - 0xD800) << 10) + (low - 0xDC00), n.end()
    yield (chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"), a, j


def _code(m: re.Match) -> int:
    return int(m[6]) if m[6] else int(next(x for x in m.groups()[:5] if x), 16)


class Scan:
    """Base and added spans of one text; layers: how many were unwrapped; truncated: whether max_inflated (None: no limit) left some
    out; unread: the spans that encode those."""

    def __init__(self, text: str, max_inflated: int | None = MAX_INFLATED):
        self.base = scan(text)
        self.limited = max_inflated is not None
        self.left, self.layers, self.truncated = max_inflated if self.limited else math.inf, 0, False
        self.bytes = self.left  # to inflate; equal pieces of a bomb are one layer, but each takes time
        self.unread: set[tuple[str, int, int]] = set()
        self.later: deque[Iterator[Layer]] = deque()
        self.added: set[tuple[str, int, int]] = set()
        seen: set[tuple[bytes, int, int]] = set()
        work = deque([Layer(text, _Shift(0), _Shift(1), frozenset((_digest(text),)))])
        while work or self.later:
            if not work and (first := next(self.later[0], None)) is None:
                self.later.popleft()
                continue
            for layer in self.unwrap(work.popleft()) if work else (first,):
                own = _digest(layer.text)
                if not layer.text or own in layer.above:
                    continue
                where = layer.place(0, len(layer.text))
                if (own, *where) in seen:
                    continue
                seen.add((own, *where))
                if len(layer.text) > self.left:
                    self.leave(*where)
                    continue
                self.layers += 1
                self.left -= len(layer.text)
                layer.above |= {own}
                self.added |= {(kind, *layer.place(a, b)) for kind, a, b in scan(layer.text)}
                work.append(layer)
        self.added -= set(self.base)

    def leave(self, a: int, b: int) -> None:
        self.truncated = True
        self.unread.add(("unread", a, b))

    def unwrap(self, layer: Layer) -> Iterator[Layer]:
        if "%" in layer.text:
            yield from _escapes(layer, _URL, _url)
        if "%" in layer.text or "\\x" in layer.text:
            for m in _PACKED.finditer(layer.text):
                if "%" in m[0] or "\\x" in m[0]:
                    raw = bytes(int(x[1], 16) if x[1] else ord(x[2]) for x in _BYTE.finditer(m[0]))
                    if (pieces := _inflate(raw, self.limited)) is not None:
                        yield from self.inflated(layer, pieces, *layer.place(m.start(), m.end()))
        if "\\" in layer.text or "&#" in layer.text:
            yield from _escapes(layer, _ESCAPE, _unicode)
        for m in _BASE64.finditer(layer.text):
            yield from self.run(layer, m[0].rstrip("="), range(m.start(), m.end()))
        for m in _WRAPPED.finditer(layer.text):
            lines, at = [], m.start()
            for gap in chain(_LINE_END.finditer(layer.text, m.start(), m.end()), (None,)):
                lines.append(range(at, gap.start() if gap else m.end()))
                at = gap.end() if gap else at
            for n in (len(lines), len(lines) - 1):  # the last line may be a word after the base64
                if n > 1 and not (n < len(lines) and layer.text[m.end() - 1] == "="):
                    pos = [i for line in lines[:n] for i in line]
                    yield from self.run(layer, "".join(layer.text[i] for i in pos).rstrip("="), pos)

    def run(self, layer: Layer, chars: str, pos) -> Iterator[Layer]:
        """What a run of base64 holds; if nothing, what its parts after an inner / - _ or + hold. chars[i] is at pos[i]."""
        if (found := self.decoded(layer, chars, pos, 0)) is not None:
            yield from found[0]
            return
        done = 0
        for m in _BOUNDARY.finditer(chars):
            if m.end() < done or len(chars) - m.end() < 16:
                continue
            if (found := self.decoded(layer, chars, pos, m.end(), part=True)) is not None:
                yield from found[0]
                done = found[1]

    def decoded(self, layer: Layer, chars: str, pos, at: int, part: bool = False) -> tuple[Iterator[Layer], int] | None:
        """The layers of the base64 from `at` on, and its end. With part, the text may end before the run does."""
        raw = _bytes(chars[at : at + 64])
        if _magic(raw):
            raw = _bytes(chars[at:])
            if (pieces := _inflate(raw, self.limited)) is not None:
                a, b = layer.place(pos[at], pos[-1] + 1)
                return self.inflated(layer, pieces, a, b), len(chars)
        if part and not _begins(raw):
            return None
        raw = _bytes(chars[at:])
        try:
            t = raw.decode()
        except UnicodeDecodeError as e:
            t = raw[: e.start].decode() if part and e.start >= 12 else ""
        if not _readable(t):
            return None
        start, end, k = [], [], 0
        for c in t:  # byte k comes from the characters of its group of four
            n = len(c.encode())
            s, e = layer.place(pos[at + k // 3 * 4], pos[min(at + (k + n - 1) // 3 * 4 + 4, len(pos)) - 1] + 1)
            start.append(s)
            end.append(e)
            k += n
        return iter((Layer("".join(t), start, end, layer.above),)), at + -(-k // 3) * 4

    def inflated(self, layer: Layer, pieces: Iterator[bytes], a: int, b: int) -> Iterator[Layer]:
        """The layer of the first piece of what was compressed; those of the others come later."""
        layers = (Layer(t, _Same(a), _Same(b), layer.above) for t in _texts(self.within(pieces, a, b)))
        for first in islice(layers, 1):
            yield first
            self.later.append(layers)

    def within(self, pieces: Iterator[bytes | None], a: int, b: int) -> Iterator[bytes]:
        for p in pieces:
            if p is None or len(p) > min(self.left, self.bytes):
                self.leave(a, b)
                return
            self.bytes -= len(p)
            yield p

    def spans(self) -> list[tuple[str, int, int]]:
        return order(set(self.base) | self.added)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def order(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, max_inflated: int | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans, n_layers, truncated of every row of docs.

    Null and empty texts have no spans; repeated rows are each scanned; an empty table gives an empty one; other columns are
    not looked at. One pass, nothing shuffled. Every layer is read, however large; with max_inflated (such as MAX_INFLATED) those
    beyond it are left, which `truncated` tells.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, truncated boolean"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            found = [Scan(t.as_py() or "", max_inflated) for t in b.column(1)]
            counts = [pa.array([sum(s[0] == k for s in f.base) for f in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(order(f.base)).encode()).hexdigest() for f in found], pa.string())
            rest = [pa.array([joined(f.spans()) for f in found], pa.string()), pa.array([f.layers for f in found], pa.int64()), pa.array([f.truncated for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, *rest], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "truncated"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted(text: str, mark: str = "[SECRET]", max_inflated: int | None = None) -> str:
    """The text with every span, base or added, replaced, and with what was too large to unwrap; overlapping spans become one mark."""
    out, at = [], 0
    found = Scan(text, max_inflated)
    for _, a, b in sorted({*found.spans(), *found.unread}, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, secrets in `text` replaced by a mark; `n_chars`, if there, follows the text."""
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            text = pa.array([t if t is None else redacted(t) for t in b.column(at).to_pylist()], pa.string())
            yield b.set_column(at, b.schema.field(at), text)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out
