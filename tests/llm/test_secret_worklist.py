import base64
import bz2
import gzip
import hashlib
import lzma
import re
import zlib
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import secret_worklist as op


def plain_scan(text):
    out = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


PIECES = st.sampled_from(["password", "PassWd", "toKen", "api_key", "apikey", "secret", " ", "=", ":", '"', "'", "abc12345", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJKLMNOP", "é", "ſecret", "K", ".", "-", "\n"])


@given(st.lists(PIECES, max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    assert sorted(op.scan(text)) == plain_scan(text)


SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


def b64(raw):
    return base64.b64encode(raw).decode()


def test_every_wrapping_is_undone_and_mapped():
    wraps = {
        "url": "".join("%%%02X" % b for b in SECRET.encode()),
        "unicode": "".join("\\u%04x" % ord(c) for c in SECRET),
        "hexescape": "".join("\\x%02x" % ord(c) for c in SECRET),
        "entity": "".join("&#%d;" % ord(c) for c in SECRET),
        "base64": b64(SECRET.encode()),
        "urlsafe": base64.urlsafe_b64encode(("???>>>" + SECRET).encode()).decode(),
        "gzip": b64(gzip.compress(SECRET.encode())),
        "zlib": b64(zlib.compress(SECRET.encode())),
        "bz2": b64(bz2.compress(SECRET.encode())),
        "xz": b64(lzma.compress(SECRET.encode())),
        "twice": b64(b64(SECRET.encode()).encode()),
        "gzip in gzip": b64(gzip.compress(gzip.compress(SECRET.encode()))),
        "deep": "".join("%%%02x" % b for b in b64(gzip.compress(b64(SECRET.encode()).encode())).encode()),
    }
    for name, wrapped in wraps.items():
        text = f"é before {wrapped} after"
        found = op.Scan(text)
        assert not [s for s in found.base if s[0] == "assign"], name
        kinds = {k for k, a, b in found.added if 9 <= a < b <= 9 + len(wrapped)}
        assert {"assign", "hex"} <= kinds, name


def test_mapping_is_exact_for_escapes():
    text = "x password%3Dhunter2hunter2 y"
    assert op.Scan(text).added == {("assign", 2, 27)}
    text = "a \\u0070assword=hunter2hunter2!"
    assert op.Scan(text).added == {("assign", 2, len(text) - 1)}


def test_escapes_of_escapes():
    text = "x password%252525253Dhunter2hunter2 %25C3%25A9 y"
    assert op.Scan(text).added == {("assign", 2, 35)}


def test_cycles_and_bombs_end():
    assert op.Scan("%25" * 2000).layers >= 1
    bomb = b64(gzip.compress(b"a" * 5_000_000))
    found = op.Scan(bomb, max_inflated=100_000)
    assert found.truncated and found.layers <= 1
    assert op.Scan("%zz \\u12 &#; ====" * 10).added == set()
    assert op.Scan("%" + "25" * 50_000 + "41").layers == 1
    deep = op.Scan("\\u005c" + "u005c" * 2_000, max_inflated=300_000)
    assert deep.truncated and deep.spans() == []
    clean = "the quick brown fox jumps internationalizations " * 50
    assert op.Scan(clean).spans() == []


def test_query_form(spark):
    rows = [(1, None), (2, ""), (3, SECRET), (3, SECRET), (None, "x " + b64(SECRET.encode())), (4, "é" * 100_000 + SECRET)]
    got = {(r.doc_id, r.n_assign, r.n_hex, r.spans): r for r in op.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as spans")).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[(1, 0, 0, "")].base_sha256 == empty and got[(2, 0, 0, "")].base_sha256 == empty
    assert got[(3, 1, 1, "assign:0:49,hex:9:49")].base_sha256 == hashlib.sha256(b"assign:0:49,hex:9:49").hexdigest()
    assert (4, 1, 1, "assign:100000:100049,hex:100009:100049") in got
    assert [r.n_layers for r in got.values() if r.doc_id is None] == [1]
    assert op.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redaction(spark):
    rows = [(1, f"a {SECRET} b", 0), (2, None, None), (3, "clean", 5)]
    got = {r.doc_id: r for r in op.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got[1].text == 'a [SECRET]" b' and got[1].n_chars == 13
    assert got[2].text is None and got[3].text == "clean" and got[3].n_chars == 5


def test_secrets_escaped_in_part():
    for text in (r'"password": "\u0068\u0075nter2hunter2"', "secret = %68unter2hunter2", r"\u0070assword = hunter2hunter2", r"a\nb &#112;assword%20= hunter2%68unter2"):
        found = op.Scan("é first line\n" + text + "\nlast")
        at = text.index("hunter2%68") if "%20" in text else 0
        assert not [s for s in found.base if s[0] == "assign"]
        assert any(k == "assign" and 13 <= a <= 13 + max(5, at) and b >= 13 + len(text.rstrip('"')) for k, a, b in found.added), text
        assert "unter2" not in op.redacted("first\n" + text)


def test_base64_wrapped_prefixed_and_of_several_members():
    body = "nothing here " * 9 + SECRET + " and on " * 9
    wrap = lambda s, n: "\n".join(s[i : i + n] for i in range(0, len(s), n))
    packed = b64(gzip.compress(bytes(range(32, 127)) * 3 + body.encode()))
    forms = {
        "lines of 64": wrap(b64(body.encode()), 64),
        "lines of 76": base64.encodebytes(body.encode()).decode(),
        "lines in JSON": wrap(b64(body.encode()), 64).replace("\n", "\\n"),
        "gzip in lines": wrap(packed, 64),
        "bz2 in lines, a word after": wrap(b64(bz2.compress(body.encode())).rstrip("="), 64) + "\nafter",
        "path": "a/" + b64(SECRET.encode()),
        "name": "cfg_" + b64(SECRET.encode()),
        "name, zlib": "x-cfg_" + b64(zlib.compress(SECRET.encode())),
        "both sides": "a/" + b64((SECRET + " ").encode()) + "/other/path",
        "members": b64(gzip.compress(b"plain") + gzip.compress(SECRET.encode())),
        "members, bz2": b64(bz2.compress(b"plain") + bz2.compress(b"text ") + bz2.compress(SECRET.encode())),
        "members, xz": b64(lzma.compress(b"plain") + lzma.compress(SECRET.encode())),
    }
    for name, form in forms.items():
        found = op.Scan(f"é before {form} after")
        assert {"assign", "hex"} <= {k for k, a, b in found.added if 9 <= a < b <= 9 + len(form)}, name


def test_compressed_bytes_escaped():
    every = lambda raw, mark: "".join(f"{mark}{x:02x}" for x in raw)
    body = SECRET.encode()
    forms = [every(gzip.compress(body), "%"), every(zlib.compress(body), "%25"), quote(zlib.compress(body, 9)), quote(bz2.compress(body)), every(lzma.compress(body), "\\x"), quote(gzip.compress(b64(gzip.compress(body)).encode())), quote(quote(zlib.compress(body)))]
    for form in forms:
        found = op.Scan(f"q=1&é={form} after")
        assert {"assign", "hex"} <= {k for k, a, b in found.added if 6 <= a < b <= 6 + len(form)}, form
    for clean in ("x%9C and x%DA", "100%1f%8b", "BZh%20is no archive", "x^2 + 5% x^3"):
        assert not op.Scan(clean).added


def test_large_layers_hide_nothing():
    blob, other = b64(gzip.compress(b"a " * 2_000_000)), b64(SECRET.encode())
    found = op.Scan(f"{blob} {other}", max_inflated=1_000_000)
    assert found.truncated and {"assign", "hex"} == {k for k, a, b in found.added if a > len(blob)}
    assert op.redacted(f"x {blob} {other} y", max_inflated=1_000_000) == "x [SECRET] [SECRET] y"
    late = b64(gzip.compress(b"a " * 2_000_000 + SECRET.encode() + b" b" * 2_000_000))
    assert {"assign", "hex"} == {k for k, *_ in op.Scan(late).added}
    several = op.Scan(f"{blob} {late} {other}", max_inflated=3_000_000)  # both large ones pass it
    assert several.truncated and {"assign", "hex"} <= {k for k, a, b in several.added if a > len(blob) + len(late)}
    deep = SECRET.encode()
    for _ in range(op.MAX_DEEP + 1):
        deep = zlib.compress(deep)
    assert op.Scan(b64(deep)).truncated and op.redacted("x " + b64(deep)).rstrip("=") == "x [SECRET]"


def test_without_a_limit_nothing_is_left(spark):
    """Layers beyond MAX_INFLATED, and data compressed more often than MAX_DEEP, are read too."""
    large = b"a " * (op.MAX_INFLATED // 2) + SECRET.encode() + b" b" * 1000
    blob = b64(gzip.compress(large))
    assert op.Scan(blob).truncated
    found = op.Scan(blob, None)
    assert not found.truncated and {"assign", "hex"} == {k for k, *_ in found.added}
    deep = SECRET.encode()
    for _ in range(3 * op.MAX_DEEP + 1):
        deep = zlib.compress(deep)
    assert not op.Scan(b64(deep), None).truncated and {"assign", "hex"} == {k for k, *_ in op.Scan(b64(deep), None).added}
    got = op.find_secrets(spark.createDataFrame([(1, f"x {blob}")], "doc_id long, text string")).first()
    assert not got.truncated and "assign:2:" in got.spans


def test_data_that_a_missing_library_would_read_is_no_clean_text(monkeypatch):
    """Without zstandard a document that holds zstd data fails, instead of passing as one without secrets; others need no such library."""
    import base64
    import sys

    monkeypatch.setitem(sys.modules, "zstandard", None)
    packed = base64.b64encode(b"\x28\xb5\x2f\xfd" + bytes(40)).decode()
    for run in (op.Scan, op.redacted):
        with pytest.raises(ImportError):
            run(f"see {packed} here")
    assert op.Scan("password = hunter2hunter2").base == [("assign", 0, 25)]
