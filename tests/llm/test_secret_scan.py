import base64
import bz2
import gzip
import lzma
import random
import re
import zlib
from hashlib import sha256
from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm.secret_scan import KINDS, PIECE_BYTES, all_spans, base_spans, scan_secrets

SECRET = 'token = "abcdefghijkl1234"'


def literal(text):
    """The base patterns as they are stated: match greedily, then drop what is too short."""
    found = []
    for kind, pattern, ok in (
        (0, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "apikey", "passwd", "=", ":", " ", '"', "AKIA", "ABCDEFGHIJ01", "0123456789abcdef", "zz", "é🔐", "\n", "ſecret", "%41"]), max_size=30).map("".join))
def test_base_matches_the_stated_patterns(text):
    assert base_spans(text) == literal(text)
    base, spans, _ = all_spans(text)
    assert set(base) <= set(spans) and spans == sorted(spans)


def test_layers_map_to_the_document():
    coded = base64.b64encode(SECRET.encode()).decode()
    for wrapped in (coded, quote(SECRET, safe=""), "".join(f"\\u{ord(c):04x}" for c in SECRET), base64.b64encode(gzip.compress(SECRET.encode())).decode(), base64.b64encode(coded.encode()).decode(), quote(base64.b64encode(quote(SECRET).encode()).decode(), safe="")):
        text = "é before " + wrapped + " after"
        base, spans, layers = all_spans(text)
        assert layers >= 1 and not base
        kinds = {k for s, k, e in spans if s >= 9 and e <= 9 + len(wrapped)}
        assert 0 in kinds


def test_offsets_inside_base64():
    plain = "0123456789 " + SECRET + " end"
    coded = base64.b64encode(plain.encode()).decode()
    (start, kind, end), = [s for s in all_spans(coded)[1] if s[1] == 0]
    assert start == 11 // 3 * 4 + 11 % 3 and end <= len(coded) and end - start < len(coded)


def test_cycles_end():
    text = quote(quote(quote("%25" * 50)))
    assert all_spans(text)[2] < 20


def b64(data, wrap=0):
    out = base64.b64encode(data).decode()
    return "\n".join(out[i : i + wrap] for i in range(0, len(out), wrap)) if wrap else out


ENCODERS = {
    "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "entity": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "base64": lambda t: b64(t.encode()),
    "lines": lambda t: b64(("filler words here and there. " * 4 + t).encode(), 76),
    "utf16": lambda t: b64(t.encode("utf-16-le")),
    "gzip": lambda t: b64(gzip.compress(t.encode())),
    "gzip lines": lambda t: b64(gzip.compress(random.Random(1).randbytes(90) + b" " + t.encode()), 64),
    "members": lambda t: b64(gzip.compress(b"first member ") + gzip.compress(t.encode())),
    "zlib twice": lambda t: b64(zlib.compress(zlib.compress(t.encode()))),
    "bz2 in gzip": lambda t: b64(gzip.compress(bz2.compress(t.encode()))),
    "xz": lambda t: b64(lzma.compress(t.encode())),
    "damaged text": lambda t: b64(b"\xff\x00 " + t.encode("latin-1")),
    "octal": lambda t: "".join(f"\\{b:03o}" for b in t.encode("latin-1")),
    "escaped gzip": lambda t: repr(gzip.compress(t.encode(), mtime=0)),
    "quoted gzip": lambda t: "q=" + quote(gzip.compress(t.encode(), mtime=0)) + "&x=1",
    "hex escapes": lambda t: "".join(f"\\x{b:02x}" for b in zlib.compress(t.encode())),
    "text after a stream": lambda t: b64(gzip.compress(gzip.compress(b"nothing here") + b" " + t.encode())),
    "glued": lambda t: "id/" + b64(gzip.compress(t.encode())),
}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(sorted(ENCODERS)), min_size=1, max_size=3), st.sampled_from([(0, SECRET), (1, "AKIA" + "Q" * 16), (2, "0123456789abcdef" * 2)]))
def test_round_trip_of_nested_encodings(names, secret):
    kind, text = secret
    for name in names:
        text = ENCODERS[name](text)
    base, spans, layers = all_spans("é before " + text + " after")
    assert layers and any(k == kind and s >= 9 and e <= 9 + len(text) for s, k, e in spans)


def test_what_comes_before_the_damage_is_scanned():
    cut = gzip.compress(SECRET.encode() + b" " + random.Random(2).randbytes(40_000))[:30_000]
    assert 0 in [s[1] for s in all_spans(b64(cut))[1]]


def test_whole_layer_is_scanned():
    filler = b"word after word " * (2 * PIECE_BYTES // 16)
    for data in (gzip.compress(filler + SECRET.encode()), gzip.compress(gzip.compress(filler + SECRET.encode())), gzip.compress(b"x" * 9_000_000 + b" " + SECRET.encode())):
        assert 0 in [s[1] for s in all_spans("x " + b64(data) + " y")[1]]
    spaced = filler[: PIECE_BYTES - 9] + b"token" + b" " * 30_000 + b"=" + b" " * 30_000 + b"abcdefghijkl1234"
    assert 0 in [s[1] for s in all_spans(b64(gzip.compress(spaced)))[1]]


def test_streams_that_begin_alike_are_no_cycle():
    rng = random.Random(3)
    same = b64(rng.randbytes(900_000)).encode()  # 1.2 MB in both layers
    inner = gzip.compress(same + b" " + SECRET.encode())
    assert 0 in [s[1] for s in all_spans(b64(gzip.compress(same + b" " + base64.b64encode(inner))))[1]]
    long = b"x y " * 50_000
    for data in (gzip.compress(long + gzip.compress(long + SECRET.encode())), gzip.compress(gzip.compress(long) + gzip.compress(long + SECRET.encode()))):
        all_spans(b64(data))  # ends


def test_an_archive_of_itself_ends(monkeypatch):
    from scriptorium.llm import secret_scan

    # a stand-in for a long archive that unfolds to itself
    a = b"\x1f\x8b\x08" + b"same again " * 20_000
    monkeypatch.setattr(secret_scan, "inflated", lambda chunks: iter([a, b""]))
    assert secret_scan.hidden_kinds(lambda: iter([a]), frozenset()) == (set(), 1)


def test_archives_that_hold_themselves_end(monkeypatch):
    from scriptorium.llm import secret_scan

    # stand-ins for archives that unfold to each other, in two steps
    a, b = b"\x1f\x8b\x08 first", b"\x1f\x8b\x08 second"
    monkeypatch.setattr(secret_scan, "inflated", lambda chunks: iter([b if next(iter(chunks)) == a else a]))
    assert secret_scan.hidden_kinds(iter([a]), frozenset([hash(a)])) == (set(), 1)


def test_long_runs_take_linear_time():
    text = "A" * 400_000 + " " + "b" * 400_000 + "\n" + SECRET
    assert len(all_spans(text)[0]) >= 1


def test_table(spark):
    rows = [(1, "x " + SECRET, "a"), (2, None, "b"), (3, "", None), (None, SECRET, ""), (1, "x " + SECRET, "a"), (5, "a" * 200_000 + " " + SECRET, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(scan_secrets(df).collect(), key=lambda r: str(r))
    assert len(got) == 6
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        want = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in literal(text))
        assert r.base_sha256 == sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in literal(text)) for x in range(3))
    assert scan_secrets(df.limit(0)).collect() == []
