"""Secret scan with a recursive decoding worklist.

The text is layer 0.  From each layer, URL escapes, Unicode escapes, base64
runs and compressed bytes are unwrapped into further layers until nothing new
appears.  A layer that equals one of its ancestors ends that branch (a cycle,
as a self-reproducing archive makes), and a layer with the same content from
the same place is visited once.  Compressed layers are unfolded as streams, so
their length is not bounded and memory is that of a piece.  Every layer is scanned, and what it holds is
mapped back to code points of the document.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: Fixed patterns of the query's contract; the limits on lengths follow a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGNED = 12

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\([0-3][0-7]{2})")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 in lines, as mail and key files have it.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE_END = re.compile(r"[\r\n \t]+")
#: Decoded bytes without any of these hold neither a match nor a further layer.
PROMISING = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{16}|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uUx0-3]|&#|\x1f\x8b|BZh|\xfd7z|\x78[\x01\x5e\x9c\xda]|(?:\x00[ -~]){4}|(?:[ -~]\x00){4}")

#: How compressed streams begin in URL and backslash escapes.
ESCAPED_STREAM = re.compile(r"(?i:%1f%8b%08|%78%9c|x%9c|x%da|%fd7zxz%00|BZh[1-9]1AY%26SY)|(?i:\\x1f\\x8b)(?:(?i:\\x08)|\\b)|\\0?37\\213(?:\\0?10|\\b)|(?:x|\\x78)(?:\\x9c|\\xda)|\\xfd7zXZ\\x00|\\3757zXZ\\0")
#: Where they end: at the quote that stands before them too, else at a space or a quote.
ESCAPED_END = {"'": re.compile(r"(?:[^'\\\n]|\\.)*"), '"': re.compile(r'(?:[^"\\\n]|\\.)*'), "": re.compile(r"""[^\s"'<>]*""")}
_WHOLE_ESCAPES = re.compile(rb"(?:\\x[0-9A-Fa-f]{2}|\\[^x]|[^\\])*")
#: Bytes by which streams are told apart before they are compared as wholes.
HEAD_BYTES = 1 << 16
#: Bytes of an unfolded layer that are looked at together.
PIECE_BYTES = 8 << 20
#: Bytes that two pieces have in common.  A match needs fewer: runs of spaces are one space there.
OVERLAP_BYTES = 4096
SPACES = re.compile(rb" {2,}")
#: What a run of base64 or of escapes consists of: a piece never ends in one.
RUN_BYTES = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b"+/_-=%\\\r\n"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted.

    The patterns for access and hex carry their limit: a run that is too short
    holds no later start of a long enough one.
    """
    out = []
    if "=" in text or ":" in text:
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


class Layer:
    """A decoded text with the document's span of each of its characters."""

    __slots__ = ("text", "starts", "ends", "ancestors", "kinds")

    def __init__(self, text: str | None, starts, ends, ancestors: frozenset):
        self.text, self.starts, self.ends, self.ancestors = text, starts, ends, ancestors
        self.kinds: set[int] = set()


def _replaced(layer: Layer, matches: list, decode) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The layer with each match replaced by decode(match): a list of (text, offset, end) in the match."""
    parts, starts, ends, at = [], [], [], 0
    changed = False
    for m in matches:
        pieces = decode(m)
        if pieces is None:
            continue
        changed = True
        parts.append(layer.text[at : m.start()])
        starts.append(layer.starts[at : m.start()])
        ends.append(layer.ends[at : m.start()])
        for piece, a, b in pieces:
            parts.append(piece)
            starts.append(np.full(len(piece), layer.starts[m.start() + a]))
            ends.append(np.full(len(piece), layer.ends[m.start() + b - 1]))
        at = m.end()
    if not changed:
        return None
    parts.append(layer.text[at:])
    starts.append(layer.starts[at:])
    ends.append(layer.ends[at:])
    return "".join(parts), np.concatenate(starts), np.concatenate(ends)


def _url_pieces(m: re.Match) -> list[tuple[str, int, int]]:
    raw = bytes.fromhex(m.group().replace("%", ""))
    out, at = [], 0
    while at < len(raw):
        width = 1 if raw[at] < 0x80 else 2 if 0xC0 <= raw[at] < 0xE0 else 3 if 0xE0 <= raw[at] < 0xF0 else 4 if raw[at] >= 0xF0 else 1
        try:
            piece = raw[at : at + width].decode("utf-8")
        except UnicodeDecodeError:
            piece, width = raw[at : at + 1].decode("latin-1"), 1
        out.append((piece, 3 * at, 3 * (at + width)))
        at += width
    return out


def _unicode_pieces(m: re.Match) -> list[tuple[str, int, int]] | None:
    digits = next(i for i in range(1, 8) if m.group(i) is not None)
    code = int(m.group(digits), {6: 10, 7: 8}.get(digits, 16))
    return [(chr(code), 0, m.end() - m.start())] if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _decompressor(head: bytes):
    """A new decompressor for bytes that begin like a compressed stream."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What a compressed stream unfolds to, member after member, in chunks of a megabyte at most.

    Damaged and cut streams give what comes before the damage.
    """
    d, left = None, b""
    for chunk in chunks:
        left += chunk
        while left:
            if d is None and len(left) < 6:
                break  # the next member's beginning may go on in the next chunk
            if d is None and (d := _decompressor(left)) is None:
                return
            try:
                if isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                    out, left = d.decompress(left, 1 << 20), b""
                    while out or not (d.needs_input or d.eof):
                        yield out
                        out = b"" if d.eof else d.decompress(b"", 1 << 20)
                else:
                    out = d.decompress(left, 1 << 20)
                    left = d.unconsumed_tail
                    yield out
                    while not d.eof and len(out) == 1 << 20 and not left:  # what the decompressor still holds
                        out = d.decompress(b"", 1 << 20)
                        yield out
            except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
                return
            if d.eof:
                left, d = d.unused_data or left, None


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The stream in overlapping pieces, none of which ends inside a run; a piece is as long as its longest run at least."""
    held, size = [], 0
    for chunk in chunks:
        chunk = SPACES.sub(b" ", chunk)
        held.append(chunk)
        size += len(chunk)
        if size >= PIECE_BYTES and len(chunk.rstrip(RUN_BYTES)):
            whole = b"".join(held)
            end = len(whole.rstrip(RUN_BYTES))
            yield whole[:end]
            held = [whole[max(0, end - OVERLAP_BYTES) :]]
            size = len(held[0])
    yield b"".join(held)


def _texts_of(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, offset, step) of readings of bytes that may hold something: each character is ``step`` bytes, 0 for UTF-8.

    Bytes that are no UTF-8 are read as Latin-1, and every other byte of what looks like UTF-16.
    """
    if not PROMISING.search(data):
        return
    try:
        yield data.decode("utf-8"), 0, 0
    except UnicodeDecodeError:
        yield data.decode("latin-1"), 0, 1
    if data.count(0) * 4 > len(data):
        for i in (0, 1):
            yield data[i::2].decode("latin-1"), i, 2


class _Unfolded:
    """What a compressed stream unfolds to, as often as it is opened, and its identity: the whole of it, length and hash."""

    def __init__(self, source: Callable[[], Iterator[bytes]]):
        self.open = lambda: inflated(source())
        self.head, self.short = b"", True
        for chunk in self.open():
            self.head += chunk
            if len(self.head) > HEAD_BYTES:
                self.short = False
                break
        self._identity: tuple[int, bytes] | None = None

    def identity(self) -> tuple[int, bytes]:
        if self._identity is None:
            size, digest = 0, sha256()
            for chunk in self.open():
                size += len(chunk)
                digest.update(chunk)
            self._identity = size, digest.digest()
        return self._identity

    def same(self, other: _Unfolded) -> bool:
        return not self.short and not other.short and self.head[:HEAD_BYTES] == other.head[:HEAD_BYTES] and self.identity() == other.identity()


def hidden_kinds(chunks: Iterator[bytes] | Callable[[], Iterator[bytes]], ancestors: frozenset, above: tuple[_Unfolded, ...] = ()) -> tuple[set[int], int]:
    """(kinds of secrets, number of layers) in a compressed stream and all that is nested in it.

    The stream is unfolded piece by piece, however long it is, and opened anew
    for each reading: bytes that begin as a stream are unfolded further and
    read as a text too.  What equals an ancestor as a whole ends the branch: an
    archive that reproduces itself, in one step or in several.
    """
    given = chunks if callable(chunks) else list(chunks)
    layer = _Unfolded(given if callable(given) else lambda: iter(given))
    # a short stream is wholly in its head; long ones that begin alike are compared
    mark = hash(layer.head)
    if not layer.head or layer.short and mark in ancestors or any(map(layer.same, above)):
        return set(), 0
    inner = ancestors | {mark} if layer.short else ancestors
    kinds, layers = set(), 1
    if _decompressor(layer.head) is not None:
        kinds, nested = hidden_kinds(layer.open, inner, (*above, layer))
        layers += nested
    for piece in _pieces(layer.open()):
        for text, _, _ in _texts_of(piece):
            kinds.update(k for _, k, _ in base_spans(text))
            for inside in unwrapped_layers(text, inner):
                layers += 1
                kinds.update(inside.kinds if inside.text is None else (k for _, k, _ in base_spans(inside.text)))
    return kinds, layers


def _escaped_streams(text: str) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, start, end) of compressed streams that are written with URL or backslash escapes, hexadecimal or octal."""
    if "%" not in text and "\\" not in text:
        return
    at = 0
    while m := ESCAPED_STREAM.search(text, at):
        before = text[m.start() - 1 : m.start()]
        at = ESCAPED_END[before if before in ESCAPED_END else ""].match(text, m.start()).end()
        raw = text[m.start() : at].encode("latin-1", "replace")
        try:
            yield unquote_to_bytes(raw) if "%" in m.group() else codecs.escape_decode(raw)[0], m.start(), at
        except ValueError:  # a broken escape: what stands before it
            yield codecs.escape_decode(_WHOLE_ESCAPES.match(raw).group())[0], m.start(), at


def _base64_bytes(run: str, phase: int) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")[phase:]
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return b""


def _stream_starts(data: bytes) -> list[int]:
    """Where compressed streams may begin: a zlib header is too short to be looked for but at the start."""
    starts = {m.start() for m in re.finditer(rb"\x1f\x8b\x08|BZh[1-9]1AY|\xfd7zXZ\x00", data)}
    return sorted(starts | ({0} if _decompressor(data) is not None else set()))


def _runs(text: str) -> Iterator[tuple[str, int, int, np.ndarray | None]]:
    """(run, start, end, places) of base64; places are the characters' in the text where line ends were taken out."""
    for m in BASE64_RUN.finditer(text):
        yield m.group(), m.start(), m.end(), None
    if "\n" in text:
        for m in BASE64_LINES.finditer(text):
            run = LINE_END.sub("", m.group())
            places = np.ones(m.end() - m.start(), bool)
            for gap in LINE_END.finditer(m.group()):
                places[gap.start() : gap.end()] = False
            yield run, m.start(), m.end(), m.start() + np.flatnonzero(places)


def unwrapped_layers(text: str, ancestors: frozenset = frozenset()) -> Iterator[Layer]:
    """Each decoded layer of ``text``; one without a text stands for a compressed stream and has the kinds found in it."""
    plain = Layer(text, None, None, ancestors | {hash(text)})
    work, seen = [plain], set()

    def ready(layer: Layer) -> Layer:
        if layer.starts is None:
            layer.starts, layer.ends = np.arange(len(text)), np.arange(1, len(text) + 1)
        return layer

    def push(new_text: str, starts, ends, parent: Layer):
        mark = (hash(new_text), int(starts[0]) if len(starts) else -1, int(ends[-1]) if len(ends) else -1)
        if new_text and mark[0] not in parent.ancestors and mark not in seen:
            seen.add(mark)
            child = Layer(new_text, starts, ends, parent.ancestors | {mark[0]})
            work.append(child)
            return child
        return None

    def hidden(data: bytes, a: int, b: int, layer: Layer):
        """The layer of a compressed stream that the characters from a to b stand for."""
        mark = hash(data)  # that of the same characters as a text, which is another reading
        if mark in layer.ancestors or ("stream", mark, a, b) in seen:
            return None
        seen.add(("stream", mark, a, b))
        kinds, n = hidden_kinds(lambda: iter([data]), layer.ancestors | {mark})
        if not n:
            return None
        ready(layer)
        child = Layer(None, layer.starts[a : a + 1], layer.ends[b - 1 : b], layer.ancestors)
        child.kinds = kinds
        return child

    while work:
        layer = work.pop()
        for pattern, pieces, sign in ((URL_RUN, _url_pieces, "%"), (UNICODE_ESCAPE, _unicode_pieces, None)):
            if (sign is None and "\\" not in layer.text and "&#" not in layer.text) or (sign and sign not in layer.text):
                continue
            matches = list(pattern.finditer(layer.text))
            if matches and (new := _replaced(ready(layer), matches, pieces)) and (child := push(*new, layer)):
                yield child
        for data, a, b in _escaped_streams(layer.text):
            if (child := hidden(data, a, b, layer)) is not None:
                yield child
        for run, a, b, places in _runs(layer.text):
            for phase in range(4):
                data = _base64_bytes(run, phase)
                for start in _stream_starts(data):
                    if (child := hidden(data[start:], a, b, layer)) is not None:
                        yield child
                for decoded, offset, step in _texts_of(data):
                    ready(layer)
                    if step:
                        byte = offset + step * np.arange(len(decoded))
                        last = byte + step - 1
                    elif decoded.isascii():
                        byte = last = np.arange(len(decoded))
                    else:
                        last = np.cumsum([len(c.encode()) for c in decoded]) - 1
                        byte = np.concatenate([[0], last[:-1] + 1])
                    # the characters of the run that hold a byte's first and last bits
                    first_char = np.minimum(phase + byte // 3 * 4 + byte % 3, len(run) - 1)
                    last_char = np.minimum(phase + last // 3 * 4 + last % 3 + 1, len(run) - 1)
                    if places is None:
                        first_char, last_char = a + first_char, a + last_char
                    else:
                        first_char, last_char = places[first_char], places[last_char]
                    if child := push(decoded, layer.starts[first_char], layer.ends[last_char], layer):
                        yield child


def all_spans(text: str) -> tuple[list, list, int]:
    """(base spans, all spans, number of decoded layers)."""
    base = base_spans(text)
    spans, layers = set(base), 0
    for layer in unwrapped_layers(text):
        layers += 1
        if layer.text is None:
            spans.update((int(layer.starts[0]), kind, int(layer.ends[0])) for kind in layer.kinds)
        else:
            spans.update((int(layer.starts[s]), kind, int(layer.ends[e - 1])) for s, kind, e in base_spans(layer.text))
    return base, sorted(spans), layers


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("layers", pa.int64())])


def _scan(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            base, spans, layers = all_spans(text.as_py() or "")
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((doc_id, *counts, sha256(spans_text(base).encode()).hexdigest(), spans_text(spans), layers))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts and hash of the base spans, all spans, layers.

    Offsets are code points, ends exclusive.  A null text is empty and an empty
    text has no spans.  Null identifiers and repeated rows are scanned like any
    other.  A secret in a compressed layer has the span of the run that holds the
    layer.  An empty table gives an empty result.  Columns other than the two are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, _OUT)
