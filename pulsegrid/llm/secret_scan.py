"""Secrets in whole texts, also under layers of encoding.

A worklist holds layers. Each layer is scanned, then its URL escapes and Unicode escapes are replaced in new
layers, until none is new. Every character of a layer knows which span of the text it came from, so that a
finding in any layer is a span of the text. Base64 runs, also those broken into lines, and compressed data
are contents of bytes of which every finding is the span that was decoded: they have a worklist of their own
at each place, in which contents met before end cycles, and are read piece by piece, whatever they unpack to.
"""

from __future__ import annotations

import binascii
import bz2
import gzip
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import with_columns_from_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|&#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: The shortest base64 of a finding: 12 bytes.
_LONG = 16
#: Bytes of a decoded content that are looked at at a time, and that are read at once to unpack them,
#: and from which zlib data are told.
PIECE, READ, TRIED = 4_000_000, 65_536, 4096
_SPACES = re.compile(rb"\x20+")
#: Breaks in base64: of lines, with what indents the next one, also as they are written in strings.
_BREAK = re.compile(r"(?<=[A-Za-z0-9+/_-])(?:\r?\n[\x20\t]*|(?:\\r)?\\n)(?=[A-Za-z0-9+/_-])")
_BREAK_B = re.compile(_BREAK.pattern.encode())
_BROKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:\r?\n[\x20\t]*|(?:\\r)?\\n)[A-Za-z0-9+/_-]++)++={0,2}")
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{16}")
_RUN16 = re.compile(_LONG_RUN.pattern.encode())
_OTHER = re.compile(rb"[^A-Za-z0-9+/_-]+")
_TAIL = re.compile(rb"[\\rn\x20\t\r\n]*\Z")
_PLAIN = bytes.maketrans(b"-_", b"+/")
#: Findings in as many characters as they need.
_SHORT = (
    re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""", re.I),
    re.compile(rb"AKIA[A-Z0-9]{16}"),
    re.compile(rb"[0-9a-f]{24}"),
)
_EDGE, _LONGEST = 64, 16
#: Escapes of single bytes, and those of strings, in which a backslash may stand for itself.
_URL1 = re.compile(r"%([0-9A-Fa-f]{2})")
_SIGN = re.compile(_ESCAPE.pattern + r"""|\\([nrtabfv0\\'"])""")
_URL_B, _ESCAPE_B, _SIGN_B = (re.compile(p.pattern.encode()) for p in (_URL1, _ESCAPE, _SIGN))
_IN_BYTES = {_URL1: _URL_B, _SIGN: _SIGN_B}
_SIGNS = dict(zip((bytes([c]) for c in b"nrtabfv0\\'\""), (bytes([c]) for c in b"\n\r\t\a\b\f\v\0\\'\""), strict=True))
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd", re.S)
_MAGIC_STARTS = (b"\x1f\x8b\x08", b"\x78", b"BZh", b"\xfd7zXZ", b"\x28\xb5\x2f\xfd")
_WORD_END = re.compile(r"""[\s"'<>]|\Z""")
_LINE_END = {q: re.compile(rf"(?<!\\)(?:\\\\)*+{q}|[\r\n]|\Z") for q in ("'", '"')} | {"": re.compile(r"[\r\n]|\Z")}

#: Pieces of bytes, anew at each call.
Content = Callable[[], Iterator[bytes]]
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans by start, then kind as listed, in code points."""
    out: list[tuple[int, int, int]] = []
    low = text.encode("utf-8", "replace").lower()
    if b"pass" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if any(len(w) >= 24 for w in text.split()):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


class Layer:
    """A text, with the span of the whole text that each of its characters stands for (None: itself)."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text, self.start, self.end = text, start, end

    def span(self, s: int, e: int) -> tuple[int, int]:
        return (s, e) if self.start is None else (min(self.start[s:e]), max(self.end[s:e]))

    def replaced(self, matches: list[tuple[int, int, str]]) -> Layer:
        """The layer with each match replaced by its decoded text."""
        out, start, end, at = [], [], [], 0

        def keep(a: int, b: int) -> None:
            out.append(self.text[a:b])
            start.extend(range(a, b) if self.start is None else self.start[a:b])
            end.extend(range(a + 1, b + 1) if self.end is None else self.end[a:b])

        for s, e, text in matches:
            keep(at, s)
            a, b = self.span(s, e)
            out.append(text)
            start.extend([a] * len(text))
            end.extend([b] * len(text))
            at = e
        keep(at, len(self.text))
        return Layer("".join(out), start, end)


class _File(io.RawIOBase):
    """A content as a file to read from."""

    def __init__(self, content: Content):
        self._pieces, self._rest = content(), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self._rest:
            piece = next(self._pieces, None)
            if piece is None:
                return 0
            self._rest = piece
        n = min(len(into), len(self._rest))
        into[:n], self._rest = self._rest[:n], self._rest[n:]
        return n


def _inflated(file: io.BufferedReader) -> Iterator[bytes]:
    """All zlib streams that follow one another."""
    rest = b""
    while rest := rest or file.read1(READ):
        one = zlib.decompressobj()
        while not one.eof:
            if not (rest := rest or file.read1(READ)):
                yield one.flush()
                return
            yield one.decompress(rest, PIECE)
            rest = one.unused_data if one.eof else one.unconsumed_tail


def _read(file) -> Iterator[bytes]:
    while piece := file.read1(PIECE):
        yield piece


def unpacked(content: Content) -> Iterator[bytes]:
    """What the gzip, zlib, bzip2, xz or zstandard data that a content begins with hold, every member of them,
    as far as they can be read; nothing for other contents."""
    file = io.BufferedReader(_File(content), READ)
    head = file.peek(6)
    try:
        if head[:2] == b"\x1f\x8b":
            yield from _read(gzip.GzipFile(fileobj=file))
        elif head[:1] == b"\x78":
            yield from _inflated(file)
        elif head[:3] == b"BZh":
            yield from _read(bz2.BZ2File(file))
        elif head[:6] == b"\xfd7zXZ\x00":
            yield from _read(lzma.LZMAFile(file))
        elif head[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True) as reader:
                while piece := reader.read(PIECE):
                    yield piece
    except (zlib.error, gzip.BadGzipFile, OSError, EOFError, lzma.LZMAError, ValueError):
        return
    except Exception as e:  # zstandard's own error class
        if type(e).__name__ != "ZstdError":
            raise


def _from(content: Content, at: int) -> Iterator[bytes]:
    """A content from a byte of it on."""
    for piece in content():
        if at < len(piece):
            yield piece[at:]
        at = max(0, at - len(piece))


def _decoded(body: bytes) -> bytes:
    """What base64 without breaks holds; a last character that stands for no byte is left out."""
    body = body.rstrip(b"=").translate(_PLAIN)
    body = body[: len(body) - (len(body) % 4 == 1)]
    return binascii.a2b_base64(body + b"=" * (-len(body) % 4))


def _byte_of(m: re.Match) -> bytes:
    """The byte of an escape, or the UTF-8 of a character beyond those of one byte."""
    which = m.lastindex
    if m.re is _SIGN_B and which == 6:
        return _SIGNS[m[6]]
    n = int(m[which], 10 if m.re is not _URL_B and which == 5 else 16)
    return bytes([n]) if n < 256 else chr(n).encode("utf-8", "replace") if n < 0x110000 else b"?"


def _changed(content: Content, pattern: re.Pattern, marks: bytes) -> Iterator[bytes]:
    """A content with its escapes replaced; what may be the beginning of one waits for the next piece."""
    rest = b""
    for piece in content():
        whole = rest + piece
        at = max(0, len(whole) - _LONGEST)
        cut = min((k for c in marks if (k := whole.find(c, at)) >= 0), default=len(whole))
        before = len(whole[:cut]) - len(whole[:cut].rstrip(b"\\"))
        cut -= before if before < _LONGEST else before % 2
        yield pattern.sub(_byte_of, whole[:cut])
        rest = whole[cut:]
    yield pattern.sub(_byte_of, rest)


def _runs(content: Content, skip: int | None) -> Iterator[bytes]:
    """What the base64 runs of a content hold, each on a line of its own: the runs as they stand (``skip``
    None), or with the breaks in them taken out, from the character ``skip`` on. They may span pieces."""
    rest, run, going = b"", b"", False
    for piece in chain(content(), (None,)):
        whole = rest + (b"\0" if piece is None else piece)
        cut = len(whole) if piece is None else max(0, len(whole) - len(_TAIL.search(whole, max(0, len(whole) - 256))[0]) - 1)
        rest, text = whole[cut:], whole[:cut]
        for k, part in enumerate(_OTHER.sub(b"\n", text if skip is None else _BREAK_B.sub(b"", text)).split(b"\n")):
            if k:
                if going or len(run) >= _LONG:
                    yield _decoded(run if going else run[skip or 0 :]) + b"\n"
                run, going = b"", False
            run += part
        if len(run) > PIECE:
            run, going = run if going else run[skip or 0 :], True
            whole = len(run) // 4 * 4
            yield _decoded(run[:whole])
            run = run[whole:]


def _opens(whole: bytes, at: int) -> bool:
    """Whether data that look compressed begin like it; two bytes say little, so zlib's are tried."""
    if at and whole[at] == 0x78:
        one, head = zlib.decompressobj(), whole[at : at + TRIED]
        try:
            one.decompress(head)
        except zlib.error:
            return False
        return one.eof or len(head) == TRIED or len(whole) >= PIECE
    return True


def _looked(content: Content) -> tuple[bytes, set[str], list[Content]]:
    """(digest, kinds found, contents one step below) of a content, read piece by piece: ends of pieces are
    looked at again with the next one, runs of spaces in them as one space."""
    digest, found, below, tail, at = hashlib.blake2b(digest_size=16), set(), [], b"", 0
    close = b""
    percent = plus = escape = sign = run = broken = False
    for piece in content():
        digest.update(piece)
        whole = tail + piece
        close = _SPACES.sub(b" ", close + piece) if b"  " in piece or close[-1:] == b" " else close + piece
        low = close.lower()
        hints = (any(w in low for w in (b"pass", b"secret", b"token", b"api")), b"AKIA" in close, True)
        found |= {k for k, p, hint in zip(KINDS, _SHORT, hints, strict=True) if hint and p.search(close)}
        percent = percent or b"%" in whole and _URL_B.search(whole) is not None
        plus = plus or b"+" in piece
        if b"\\" in whole or b"&#" in whole:
            escape = escape or _ESCAPE_B.search(whole) is not None
            sign = sign or _SIGN_B.search(whole) is not None
        run = run or _RUN16.search(whole) is not None
        broken = broken or (b"\n" in whole or b"\\n" in whole) and _BREAK_B.search(whole) is not None
        first = at - len(tail)
        for m in _MAGIC.finditer(whole) if any(w in whole for w in _MAGIC_STARTS) else ():
            if m.end() > len(tail) and _opens(whole, m.start()):
                below.append(partial(unpacked, partial(_from, content, first + m.start())))
        at += len(piece)
        tail, close = whole[-_EDGE:], close[-_EDGE:]
    if percent:
        below.append(partial(_changed, content, _URL_B, b"%"))
        if plus:
            below.append(partial(_changed, lambda: (p.replace(b"+", b" ") for p in content()), _URL_B, b"%"))
    if escape:
        below.append(partial(_changed, content, _ESCAPE_B, b"\\&"))
    if sign:
        below.append(partial(_changed, content, _SIGN_B, b"\\&"))
    if run:
        below.append(partial(_runs, content, None))
    if broken:
        below += [partial(_runs, content, skip) for skip in range(4)]
    return digest.digest(), found, below


def kinds_inside(raw: bytes, known: dict[bytes, frozenset[str]]) -> frozenset[str]:
    """The kinds of secret in bytes and in all layers below them. Contents met again on the way end cycles;
    ``known`` keeps what is in bytes that stand at several places."""
    if (got := known.get(raw)) is None:
        found, seen, work = set(), set(), [partial(iter, (raw,))]
        while work and len(found) < len(KINDS):
            digest, here, below = _looked(work.pop())
            if digest not in seen:
                seen.add(digest)
                found |= here
                work += below
        got = known[raw] = frozenset(found)
    return got


def _as_bytes(text: str, pattern: re.Pattern) -> tuple[bytes, list[int]]:
    """A text with its escapes replaced by bytes, and for each byte where it comes from."""
    out, at, last = [], [], 0

    def keep(a: int, b: int) -> None:
        for k in range(a, b):
            raw = text[k].encode("utf-8", "replace")
            out.append(raw)
            at.extend([k] * len(raw))

    for m in pattern.finditer(text):
        keep(last, m.start())
        raw = _byte_of(_IN_BYTES[pattern].fullmatch(m[0].encode()))
        out.append(raw)
        at.extend([m.start()] * len(raw))
        last = m.end()
    keep(last, len(text))
    return b"".join(out), at


def _packed(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of compressed data under URL or other escapes: up to the end of their word for the
    former, of their line or quotes for the latter."""
    for pattern in (_URL1, _SIGN):
        if pattern.search(text):
            raw, at = _as_bytes(text, pattern)
            for m in _MAGIC.finditer(raw):
                s = at[m.start()]
                quote = text[s - 1] if s and text[s - 1] in "'\"" else ""
                e = (_WORD_END if pattern is _URL1 else _LINE_END[quote]).search(text, s).start()
                if pattern.search(text, s, e):
                    end = bisect_left(at, e)
                    yield s, e, raw[m.start() : end]
                    if pattern is _URL1 and b"+" in raw[m.start() : end]:
                        word = text[s:e].replace("+", " ")
                        yield s, e, _as_bytes(word, pattern)[0]


def placed(layer: Layer, known: dict[bytes, frozenset[str]]) -> Iterator[Span]:
    """Findings below the base64 runs and the compressed data of a layer, as spans of the whole text."""
    text = layer.text
    found = [(m.start(), m.end(), _decoded(m[0].encode())) for m in _BASE64.finditer(text)] if _LONG_RUN.search(text) else []
    for m in _BROKEN.finditer(text):
        flat = 0
        phases: set[int] = set()
        line = m.start()
        body = _BREAK.sub("", m[0]).encode()
        if len(body) < _LONG:
            continue
        # data may begin in any line: those that leave the same remainder of four read alike from the first of them on
        for b in [*_BREAK.finditer(m[0]), None]:
            if b is not None and flat % 4 not in phases:
                phases.add(flat % 4)
                found.append((line, m.end(), _decoded(body[flat:])))
            if b is not None:
                flat += m.start() + b.start() - line
                line = m.start() + b.end()
    found += _packed(text)
    for s, e, raw in found:
        for kind in kinds_inside(raw, known):
            yield (kind, *layer.span(s, e))


def _escape(m: re.Match) -> str:
    n = int(m[1] or m[2] or m[3] or m[4] or "0", 16) if not m[5] else int(m[5])
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\N{REPLACEMENT CHARACTER}"


def unwrap(layer: Layer) -> list[Layer]:
    """The layers of the whole text one step below."""
    text, out = layer.text, []
    if "%" in text:
        found = [(m.start(), m.end(), bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")) for m in _URL.finditer(text)]
        out += [layer.replaced(found)] if found else []
    if "\\" in text or "&#" in text:
        found = [(m.start(), m.end(), _escape(m)) for m in _ESCAPE.finditer(text)]
        # a pair of surrogates stands for one character
        out += [layer.replaced(found)] if found else []
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind as listed, then end."""
    base = base_spans(text)
    found = set(base)
    known: dict[bytes, frozenset[str]] = {}
    work, seen = [Layer(text)], {text}
    while work:
        layer = work.pop()
        found.update(placed(layer, known))
        # these layers hold the whole text each, so that equal ones stand for the same places
        for below in unwrap(layer):
            if below.text in seen:
                continue
            seen.add(below.text)
            for kind, s, e in base_spans(below.text):
                found.add((kind, *below.span(s, e)))
            work.append(below)
    return base, sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``found``, arrays of (kind, start, end) in code points, end exclusive.

    ``found`` also holds secrets in decoded layers, as the span that was decoded. Null and empty texts have
    none; very long ones are read whole; repeated rows each get their spans; an empty table gives no rows;
    columns named base or found are replaced."""

    def make(batches):
        for batch in batches:
            base, found = [], []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                b, f = all_spans(t) if t else ([], [])
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in b])
                found.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in f])
            yield batch, [pa.array(base, _ARROW), pa.array(found, _ARROW)]

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return with_columns_from_batches(docs, make, [T.StructField("base", T.ArrayType(span)), T.StructField("found", T.ArrayType(span))])


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = find_secrets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    counts = [_count("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("found").alias("spans"))
