import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import subprocess
import sys
import urllib.parse
import zlib
from pathlib import Path

import pytest

from mixweave.llm import secret_worklist as S

SECRET = 'password="hunter2secret"'


def brute(text):
    """The three kinds read off a text by the stated patterns alone."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(out)]


B64 = lambda b: base64.b64encode(b if isinstance(b, bytes) else b.encode()).decode()
LAYERS = {
    "url": urllib.parse.quote(SECRET, safe=""), "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET), "hexescape": "".join(f"\\x{ord(c):02x}" for c in SECRET), "entities": "".join(f"&#{ord(c)};" for c in SECRET),
    "base64": B64(SECRET), "gzip": B64(gzip.compress(SECRET.encode())), "zlib": B64(zlib.compress(SECRET.encode())), "bz2": B64(bz2.compress(SECRET.encode())),
    "base64 in url": urllib.parse.quote(urllib.parse.quote(B64(SECRET + "=="), safe=""), safe=""), "three base64": B64(B64(B64(SECRET))), "url in gzip": B64(gzip.compress(urllib.parse.quote(SECRET, safe="").encode())),
}


@pytest.mark.parametrize("name", LAYERS)
def test_layers_are_unwrapped_and_mapped_back(name):
    text = f"é 😀 before {LAYERS[name]} after"
    base, spans = S.all_spans(text)
    assert set(base) <= set(spans) and [s for s in spans if s[0] == "assign"]
    for _, a, b in spans:
        start = text.index(LAYERS[name])
        assert start <= a < b <= start + len(LAYERS[name])
    assert "hunter2" not in S.redact_text(text, spans) and LAYERS[name] not in S.redact_text(text, spans)


MORE = "".join(f"{i}. filler {i * 7919}\n" for i in range(60)) + SECRET
WRAP = lambda s, n=64: "\n".join(s[i : i + n] for i in range(0, len(s), n))
MISSED = {
    "gzip in url": urllib.parse.quote(gzip.compress(MORE.encode(), mtime=0), safe=""), "zlib in url": "".join(f"%{b:02x}" for b in zlib.compress(MORE.encode())), "bz2 in escapes": "".join(f"\\x{b:02x}" for b in bz2.compress(MORE.encode())),
    "gzip as a literal": repr(gzip.compress(MORE.encode(), mtime=0))[2:-1], "no utf-8": B64(b"\xff\xfe " + SECRET.encode()), "no utf-8 in gzip": B64(gzip.compress(b"\xff " + SECRET.encode())),
    "gzip in lines": WRAP(B64(gzip.compress(MORE.encode(), mtime=0))), "secret across lines": WRAP(B64("x" * 40 + SECRET + "y" * 9)), "indented lines": WRAP(B64("x" * 40 + SECRET)).replace("\n", "\r\n  "),
    "pem": "-----BEGIN CERTIFICATE-----\n" + WRAP(B64("x" * 40 + SECRET + "y" * 7)) + "\n-----END CERTIFICATE-----", "after a path": "/api/v1/" + B64(SECRET), "after a dash": "key-" + B64(SECRET), "gzip after a path": "/d/" + B64(gzip.compress(SECRET.encode())),
}


@pytest.mark.parametrize("name", MISSED)
def test_layers_that_were_missed(name):
    text = f"é 😀 before {MISSED[name]} after"
    _, spans = S.all_spans(text)
    start = text.index(MISSED[name])
    found = [s for s in spans if s[0] == "assign"]
    assert found and all(start <= a < b <= start + len(MISSED[name]) for _, a, b in found)


@pytest.mark.parametrize("lead", ["x/", "key_", "key-", "a/b/"])
def test_base64_behind_a_separator(lead):
    for n in range(3):
        text = f"see {lead}{B64(SECRET + 'z' * n)} there"
        assert any(k == "assign" and a >= 4 for k, a, _ in S.all_spans(text)[1])


def nested(data, depth):
    for _ in range(depth):
        data = gzip.compress(data)
    return data


FILLER = [b"lorem ipsum dolor, ", b"0123456789abcdeg", b"line of words\n", bytes(range(256))]
WITHIN = {
    "plain": SECRET.encode(), "base64": B64(SECRET).encode(), "gzip": gzip.compress(SECRET.encode()), "gzip in base64": B64(bz2.compress(SECRET.encode())).encode(), "url": urllib.parse.quote(SECRET, safe="").encode(), "deep": nested(SECRET.encode(), 120),
    "long base64": b"~" + B64("x" * 3000 + SECRET + "y" * 200_000).encode() + b"~", "long gzip": gzip.compress(random.Random(0).randbytes(150_000) + SECRET.encode()), "long gzip in lines": WRAP(B64(gzip.compress(random.Random(0).randbytes(50_000) + SECRET.encode()))).encode(),
}


@pytest.mark.parametrize("name", WITHIN)
@pytest.mark.parametrize("filler", range(4))
def test_contents_are_read_in_windows(name, filler, monkeypatch):
    monkeypatch.setattr(S, "WINDOW", 4096)
    monkeypatch.setattr(S, "LONGEST", 16384)
    monkeypatch.setattr(S, "OVERLAP", 1024)
    for before, packs in ((0, (gzip.compress,)), (517, (bz2.compress, lzma.compress)), (9000, (zlib.compress,))):
        content = FILLER[filler] * (before // len(FILLER[filler])) + b" " + WITHIN[name] + b" " + FILLER[filler] * 300
        for pack in packs:
            assert "assign" in S.packed_kinds(pack(content)), (before, pack)


def test_damaged_and_cut_blobs_are_left_alone():
    blob = gzip.compress(MORE.encode())
    assert S.packed_kinds(blob[:-9]) in ({"assign"}, set()) and S.all_spans("a " + B64(blob[:-9]) + " b")[1] == []
    assert list(S.blob_ends(b"xx" + blob + b"yy")) == [(2, 2 + len(blob))] and list(S.blob_ends(blob[:-1])) == [(0, None)]
    assert [e for _, e in S.blob_ends(blob + blob)] == [2 * len(blob)] and list(S.blob_ends(b"x\x9c" + b"\xff" * 50)) == []


def test_a_blob_is_read_once_however_often_it_occurs(monkeypatch):
    read, inner = [], gzip.compress(b"xyz" * 100, mtime=0)
    monkeypatch.setattr(S, "_read", lambda *a, f=S._read: read.append(1) or f(*a))
    assert S.packed_kinds(gzip.compress(b"~".join([inner + b"q"] * 50))) == set() and len(read) == 2


SIZE = """
import base64, resource, sys, zlib
sys.path.insert(0, {root!r})
from mixweave.llm.secret_worklist import all_spans
z, parts = zlib.compressobj(9), []
for _ in range(200):
    parts.append(z.compress(b"0 " * (1 << 19)))
parts += [z.compress({secret!r}), z.compress(b"a" * (20 << 20)), z.flush()]
token = base64.b64encode(b"".join(parts)).decode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert [s for s in all_spans("x " + token + " y")[1] if s[0] == "assign"] == [("assign", 2, 2 + len(token) - token.count("="))], all_spans("x " + token + " y")
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_blob_of_200_mb_needs_little_memory():
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", SIZE.format(root=root, secret=b" " + SECRET.encode() + b" ")], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 500


def test_url_and_unicode_spans_are_exact():
    text = "xx p%61ssword=abcdef yy"
    assert S.all_spans(text) == ([], [("assign", 3, 20)])
    assert S.all_spans("a \\u0041KIA" + "B" * 16 + " z")[1] == [("access", 2, 2 + 6 + 19)]


@pytest.mark.parametrize("text", ["", "plain words only", "secret:token :abcdefgh", "password=abc token=abcdef", "AKIA" * 6, "AKIA" + "A" * 15, "f" * 23, "f" * 24 + "g", "API_KEY = 'a.b/c+d=e-f_g'", "ſecret=abcdef", "%%% %zz &#x; \\u12", "token=a%2", "apikey:" + "0" * 40])
def test_base_spans_equal_the_patterns(text):
    base, spans = S.all_spans(text)
    assert base == brute(text) and set(base) <= set(spans)


def test_cycles_and_long_texts_end():
    assert S.all_spans("%25" * 20000)[1] == []
    assert S.all_spans("%2525252525" * 50 + "\\u005cu005cu0041")[1] == []
    words = "lorem ipsum dolor " * 30000
    assert S.all_spans(words + SECRET)[1] == [("assign", len(words), len(words) + 23)]


def test_query_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r["doc_id"]: r for r in S.secrets_query(docs).collect()}
    found = 0
    for r in docs.collect():
        want = brute(r["text"] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        got = out[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got["n_assign"], got["n_access"], got["n_hex"]] == [sum(k == x for k, _, _ in want) for x in S.KINDS]
        assert set(joined.split(",")) <= set(got["spans"].split(","))
        found += len(want)
    assert found


def test_edges(docs_of, edges):
    docs = docs_of([*edges, (9, SECRET, "a"), (9, SECRET, "a")], extra=True)
    out = S.scan_secrets(docs, redact=True)
    rows = out.collect()
    assert len(rows) == len(edges) + 2 and set(docs.columns) == set(out.columns)
    assert [r["text"] for r in rows if r["doc_id"] == 9] == [S.REDACTED + '"'] * 2 and [r["text"] for r in rows if r["doc_id"] == 2] == [None]
    assert S.secrets_query(docs.limit(0)).count() == 0
