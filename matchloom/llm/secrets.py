"""Secret scans with a recursive decoding worklist.

A text is scanned as it stands; then it is unwrapped, and each layer goes on the worklist, to be scanned and unwrapped again
until nothing new turns up. A layer is the text with its escapes decoded (URL escapes, Unicode escapes and character references
at once; a chain such as %252525… in one step), or a stretch of base64 (either alphabet, padded or not, on one line or
wrapped, at any place in a run of its characters) or of hex digits (either case, on one line or wrapped, from either digit), of
which gzip and zlib data is unpacked, every gzip member, and unpacked again where what comes out is compressed. A layer that was
seen at the same place before isn't entered again, which ends cycles. Bytes that aren't UTF-8 or UTF-16 count as Latin-1.

Each character of a layer has the span of the text that it comes from, in two arrays, through base64 and hex digits as well; only
what was unpacked has one span for all. So each layer's findings are mapped to spans of the text. What a finding of the same
kind covers already isn't a finding of its own.

Time is bounded for hostile texts as well: an escape or a chain of like ones is decoded in one step; levels of unlike ones are
each scanned up to ROUNDS and beyond these for SCANNED characters a text in all (every level there can be in a text of 1,000
characters), what is deeper still is decoded in one pass; findings are compared by sorting. Unpacked data is scanned in
overlapping chunks that keep runs of base64 and hex digits up to MAX_UNPACKED whole; a stretch that unpacks to more than that
is reported as a span of kind ``bomb`` beside what is found in it. Compressed data inside compressed data is unpacked up to that
size in all, since each level may multiply it.

Defined cases: a null or empty text has no findings; any length is scanned whole; repeated rows each get their row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import html as references
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, patterns, the group whose length counts and its least length.
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: More kinds that the method adds.
EXTRA = {
    "key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
}
KINDS = (*BASE, *EXTRA, "bomb")
#: Unpacked bytes of a stretch beyond which it is called a bomb.
MAX_UNPACKED = 64 << 20
#: Unpacked bytes scanned at once, and those of the chunk before that are scanned again; more where a run isn't over.
CHUNK, OVERLAP = 1 << 20, 1 << 16
_RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n\t "
#: Levels of escapes that are each scanned in any case, and characters of a text's levels below that are; the ones below these
#: are decoded in one pass and scanned once.
ROUNDS, SCANNED = 32, 500_000
_FLAGS = {"assign": re.I | re.A}
_PATTERNS = {k: (re.compile(p, _FLAGS.get(k, 0)), g, n) for k, (p, g, n) in (BASE | EXTRA).items()}
# A run of 32 hex digits at least, found without stopping at each shorter one.
_PATTERNS["hex"] = (re.compile(r"[0-9a-f]{32,}"), 0, 32)
_KEYWORDS = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.I | re.A)
_HEX = "[0-9A-Fa-f]"
# Runs of URL escapes, single Unicode escapes (pairs of surrogates count as one) and references; what escapes the first
# character of an escape again and again is part of it.
_ESCAPE = re.compile(
    rf"(?P<url>(?:%(?:25)*{_HEX}{{2}})+)"
    rf"|(?P<unicode>\\(?:u00+5[cC]|x5[cC]|U0000005[cC])*(?:u[dD][89abAB]{_HEX}{{2}}\\u[dD][c-fC-F]{_HEX}{{2}}|u{_HEX}{{4}}|U{_HEX}{{8}}|x{_HEX}{{2}}))"
    r"|(?P<reference>&(?:(?:amp|#0*38|#[xX]0*26);)*(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)"
)
_CHAIN = re.compile(rf"%(?:25)*({_HEX}{{2}})")
_ENDS = re.compile(_ESCAPE.pattern + r"\Z")
# Whole runs of either alphabet, with the lines that follow without a blank between; a shorter run may end the line before.
_RUNS = re.compile(r"(?:[A-Za-z0-9+/_-]++\r?\n[ \t]*+)?[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
# As many hex digits as 14 bytes have at least, and the lines beside them.
_HEX_RUNS = re.compile(rf"(?:{_HEX}++\r?\n[ \t]*+)?{_HEX}{{28,}}+(?:\r?\n[ \t]*+{_HEX}++)*+")
_BREAK = re.compile(r"\r?\n[ \t]*")
# A byte behind an escape, or a character that stands for itself among such.
_ESCAPED_BYTE = (
    rf"%(?:25)*({_HEX}{{2}})|\\(?:(?:u00+5[cC]|x5[cC]|U0000005[cC])*(?:x|u00|U000000)({_HEX}{{2}})|([abfnrtv0\\'\"/]))"
    rf"|&(?:(?:amp|#0*38|#[xX]0*26);)*\#(?:0*([0-9]{{1,3}})|[xX]0*({_HEX}{{1,2}}));"
)
_HEAD, _BYTE = re.compile(r"x\^|" + _ESCAPED_BYTE), re.compile(_ESCAPED_BYTE + r"|([\x00-\xff])", re.S)
_SHORT = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0"))

Finding = tuple[str, int, int]
Arrays = tuple[np.ndarray, np.ndarray]


class Map:
    """The span that a layer comes from, and of each of its characters the start and end, worked out when asked for; without
    these all come from the whole span."""

    def __init__(self, place: tuple[int, int], make: Callable[[], Arrays | None] | None = None):
        self.place, self._make = place, make

    @cached_property
    def arrays(self) -> Arrays | None:
        return self._make() if self._make else None


#: A layer, its span in the one above, and what works out its characters' spans there; bytes are compressed data.
Layer = tuple[str | bytes, tuple[int, int], Callable[[], Arrays] | None]


def findings(text: str, kinds=tuple(_PATTERNS)) -> list[tuple[str, int, int]]:
    out = []
    for k in kinds:
        if k == "assign" and not _KEYWORDS.search(text) or k == "access" and "AKIA" not in text:
            continue
        p, group, least = _PATTERNS[k]
        out += [(k, *m.span()) for m in p.finditer(text) if len(m[group]) >= least]
    return out


def _texts(data: bytes) -> list[tuple[str, bool, str]]:
    """Bytes as texts, whether each looks like one, nearly without control characters but white space, and its encoding: UTF-8
    or else Latin-1, and where every other byte is mostly zero UTF-16, too."""
    out = []
    even, odd = data[::2].count(0), data[1::2].count(0)
    if 4 * max(even, odd) > len(data) and min(even, odd) < max(even, odd):
        wide = data.decode("utf-16-be" if even > odd else "utf-16-le", errors="replace")
        out.append((wide, _clear(wide), "utf-16"))
    try:
        plain = data.decode()
        out.append((plain, _clear(plain), "utf-8"))
    except UnicodeDecodeError:
        out.append((data.decode("latin-1"), False, "latin-1"))
    return out


def _origins(lines: list[tuple[int, int]], bits: int, text: str, encoding: str, size: int) -> Arrays:
    """For each character of a text out of digits of so many bits, start and end of the digits that it comes from."""
    at = np.concatenate([np.arange(s, e) for s, e in lines])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if encoding == "latin-1" or encoding == "utf-8" and len(code) == size:
        width = np.ones(len(code), np.int64)
    elif encoding == "utf-8":
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    else:
        width = 2 + 2 * (code > 0xFFFF).astype(np.int64)
    last = np.minimum(np.cumsum(width), size)
    first = np.minimum(np.cumsum(width) - width, size - 1)
    return at[8 * first // bits], at[(8 * last - 1) // bits] + 1


def _clear(s: str) -> bool:
    return 10 * len(re.findall(r"[\x00-\x08\x0E-\x1F\x7F\ufffd]", s)) <= len(s)


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0


def _unpack(data: bytes) -> Iterator[bytes]:
    """Chunks of gzip or zlib data, all its members; what is broken off or damaged ends it."""
    while _packed(data):
        z, rest = zlib.decompressobj(47), data
        while not z.eof:
            try:
                out = z.decompress(rest, CHUNK)
            except zlib.error:
                return
            if not out and not z.unconsumed_tail and not z.eof:
                return
            yield out
            rest = z.unconsumed_tail
        data = z.unused_data


def _unpacked(data: bytes) -> Iterator[str | None]:
    """Texts of compressed data, put together to CHUNK bytes and each with the end of the one before, and of compressed data that
    comes out of it; None for a bomb."""
    seen: set[bytes] = set()
    spent = 0  # bytes out of the levels below the first
    while (key := xxhash.xxh3_128_digest(data)) not in seen:
        inner: list[bytes] = []
        held, head, size, over = bytearray(), b"", 0, False
        full = CHUNK + OVERLAP
        for part in _unpack(data):
            head += part[: 3 - len(head)]
            size += len(part)
            if size <= MAX_UNPACKED and (len(head) < 3 or _packed(head)):
                inner.append(part)
            held += part
            if len(held) >= full:
                run = len(held) - len(held.rstrip(_RUN_BYTES))
                if 2 * run > len(held) and len(held) < MAX_UNPACKED:
                    full = 2 * len(held)
                else:
                    yield from (t for t, *_ in _texts(bytes(held)))
                    del held[: -max(OVERLAP, run if 2 * run <= len(held) else 0)]
                    full = max(CHUNK + OVERLAP, 2 * len(held))
            over = bool(seen) and spent + size > MAX_UNPACKED
            if over:
                break
        if held:
            yield from (t for t, *_ in _texts(bytes(held)))
        if size > MAX_UNPACKED or over:
            yield None
        if over or not _packed(head):
            return
        spent += size if seen else 0
        seen.add(key)
        data = b"".join(inner)


def _one(kind: str, m: re.Match) -> tuple[str, list[tuple[int, int, int, int]]]:
    """What an escape stands for, and (characters, start, step, width) of where these come from."""
    s, (start, end) = m[0], m.span()
    if kind == "unicode":
        code = s[1:].replace("\\", "")
        code = re.sub(r"^(?:u00+5[cC]|x5[cC]|U0000005[cC])*(?=[uxU])", "", code)
        parts = [int(x[1:], 16) for x in re.findall(r"[uxU][0-9A-Fa-f]+", code)]
        n = 0x10000 + (parts[0] - 0xD800 << 10) + parts[1] - 0xDC00 if len(parts) == 2 else parts[0]
        return (s, [(len(s), start, 1, 1)]) if n > 0x10FFFF or 0xD800 <= n < 0xE000 else (chr(n), [(1, start, 0, end - start)])
    if kind == "reference":
        out = references.unescape("&" + re.sub(r"^&(?:(?:amp|#0*38|#[xX]0*26);)*", "", s))
        return out, [(len(out), start, 0, end - start)]
    if "%25" not in s:
        raw = bytes.fromhex(s.replace("%", ""))
        if raw.isascii():
            return raw.decode(), [(len(raw), start, 3, 3)]
        at = np.arange(start, end + 1, 3)
    else:
        links = list(_CHAIN.finditer(s))
        raw, at = bytes(int(x[1], 16) for x in links), np.array([*(start + x.start() for x in links), end])
    out, pieces, i = raw.decode(errors="replace"), [], 0
    for c in out:
        n = len(c.encode()) if c != "\ufffd" else 1
        j = min(i + n, len(raw))
        pieces.append((1, int(at[min(i, len(raw) - 1)]), 0, int(at[j] - at[min(i, len(raw) - 1)])))
        i = j
    return out, pieces


def _unescaped(text: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text with all its escapes decoded one level down, and for each character the start and end of what it comes from."""
    if "%" not in text and "\\" not in text and "&" not in text:
        return None
    parts: list[str] = []
    runs: list[tuple[int, int, int, int]] = []
    at = 0
    for m in _ESCAPE.finditer(text):
        if m.start() > at:
            parts.append(text[at : m.start()])
            runs.append((m.start() - at, at, 1, 1))
        got, pieces = _one(m.lastgroup, m)
        parts.append(got)
        runs += pieces
        at = m.end()
    if not at:
        return None
    parts.append(text[at:])
    runs.append((len(text) - at, at, 1, 1))
    out = "".join(parts)
    return None if out == text else (out, *_spread(runs))


def _spread(runs: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    n, start, step, width = np.array(runs, np.int64).T
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(start, n) + place * np.repeat(step, n)
    return first, first + np.repeat(width, n)


def _byte(m: re.Match) -> int:
    k = m.lastindex
    if k in (1, 2, 5):
        return int(m[k], 16)
    if k == 4:
        return min(int(m[k]), 256)
    return _SHORT.get(m[k], ord(m[k])) if k == 3 else ord(m[k])


def _heads(text: str) -> Iterator[int]:
    """Where two bytes stand, at least one of them escaped, that compressed data may begin with; or both as they are, as x^ may."""
    end, before, place = -1, 0, 0
    for m in _HEAD.finditer(text):
        if m[0] == "x^":
            yield m.start()
            continue
        b = _byte(m)
        if m.start() == end:
            first, at = before, place
        else:
            at = m.start() - 1
            first = ord(text[at]) if at >= max(end, 0) else 256
        if max(first, b) < 256 and _packed(bytes((first, b, 0))):
            yield at
        end, before, place = m.end(), b, m.start()
        after = text[end : end + 1]
        if b < 256 and after and after not in "%\\&" and ord(after) < 256 and _packed(bytes((b, ord(after), 0))):
            yield m.start()


def _compressed_at(text: str, start: int, plus: bool) -> tuple[bytes, int] | None:
    """Compressed data that begins there behind escapes, and its end; None if it is none. In some URLs a plus is a blank."""
    z, data, ends, at, step = zlib.decompressobj(47), bytearray(), [], start, 64
    while True:
        chunk = bytearray()
        while len(chunk) < step and (m := _BYTE.match(text, at)) and (b := _byte(m)) < 256:
            chunk.append(32 if plus and m[0] == "+" else b)
            at = m.end()
            ends.append(at)
        data += chunk
        rest = bytes(chunk)
        try:
            while rest and not z.eof:
                z.decompress(rest, CHUNK)
                rest = z.unconsumed_tail
        except zlib.error:
            return None
        if z.eof:
            n = len(data) - len(z.unused_data)
            del data[n:], ends[n:]
            at = ends[-1]
            # Another member may follow.
            if not _packed(bytes(x for x in map(_byte, _BYTE.finditer(text[at : at + 64])) if x < 256)[:3]):
                return bytes(data), at
            z = zlib.decompressobj(47)
            continue
        if not chunk:
            return bytes(data), at
        step = min(2 * step, 1 << 16)


def _escaped_data(text: str) -> Iterator[Layer]:
    """Compressed data whose bytes stand in URL or Unicode escapes or in references, with its span."""
    if "%" not in text and "\\" not in text and "&" not in text:
        return
    reach = 0
    for start in _heads(text):
        if start < reach:
            continue
        got = _compressed_at(text, start, False) or _compressed_at(text, start, True)
        if got:
            reach = got[1]
            yield got[0], (start, reach), None


def _settled(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """As _unescaped, but all levels down, in one pass: each escape is decoded as soon as it is complete, and what it stands for
    may complete another with what stands before it."""
    out: list[str] = []
    first: list[int] = []
    last: list[int] = []
    ends = set("0123456789abcdefABCDEF;")
    for i, c in enumerate(text):
        out.append(c)
        first.append(i)
        last.append(i + 1)
        while out and out[-1] in ends:
            tail = "".join(out[-40:])
            m = _ENDS.search(tail)
            got = m and _one(m.lastgroup, m)[0]
            if not m or got == m[0]:
                break
            k = len(out) - (len(tail) - m.start())
            a, b = first[k], last[-1]
            del out[k:], first[k:], last[k:]
            out += got
            first += [a] * len(got)
            last += [b] * len(got)
    return "".join(out), np.array(first, np.int64), np.array(last, np.int64)


def _decoded(text: str, lines: list[tuple[int, int]]) -> tuple[bytes, list[tuple[str, Callable[[], Arrays]]], bool] | None:
    """Lines of base64 of either alphabet as bytes, as texts with what works out their characters' places, and whether one looks
    like a text; None if nothing can be made of it."""
    raw = "".join(text[s:e] for s, e in lines).rstrip("=").replace("-", "+").replace("_", "/")
    # 16 characters are 12 bytes; no finding has fewer than 14.
    if len(raw) < 16 or len(raw) % 4 == 1:
        return None
    try:
        data = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except binascii.Error:
        return None
    texts = _texts(data)
    return data, [(t, partial(_origins, lines, 6, t, c, len(data))) for t, _, c in texts], any(good for _, good, _ in texts)


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    cuts = [(start, start), *(m.span() for m in _BREAK.finditer(text, start, end)), (end, end)]
    return [(a[1], b[0]) for a, b in zip(cuts, cuts[1:])]


def _hex_digits(text: str, start: int, end: int) -> Iterator[Layer]:
    """Layers of a match of _HEX_RUNS: its lines together and each alone, from the first digit, or from the second as well if that
    gives no text."""
    lines = _lines(text, start, end)
    whole = False  # the lines together are a text
    for some in ([lines] if len(lines) > 1 else []) + [[x] for x in lines]:
        for shift in (0, 1):
            part = [(some[0][0] + shift, some[0][1]), *some[1:]]
            raw = "".join(text[s:e] for s, e in part)
            data = bytes.fromhex(raw[: len(raw) // 2 * 2])
            if len(data) < 12:
                continue
            place = (part[0][0], part[-1][1])
            if _packed(data):
                yield data, place, None
            texts = _texts(data)
            for below, good, encoding in texts:
                if findings(below) or not whole and (_RUNS.search(below) or _unescaped(below)):
                    yield below, place, partial(_origins, part, 4, below, encoding, len(data))
            if any(good for _, good, _ in texts):
                whole = whole or len(some) > 1
                break


def _encoded(text: str, start: int, end: int) -> Iterator[Layer]:
    """Layers of a match of _RUNS. A last line without padding and with a blank behind it may be a word
    of the text: it is left out at first, and taken along where nothing is found without it or more with it."""
    breaks = [m.start() for m in _BREAK.finditer(text, start, end)]
    if not breaks or text[end - 1] == "=" or text[end : end + 1] not in (" ", "\t"):
        yield from _blocks(text, start, end)
        return
    without = list(_blocks(text, start, breaks[-1]))
    yield from without
    most = max((_worth(below) for below, *_ in without), default=-1)
    for below, at, make in _blocks(text, start, end):
        if at[1] == end and _worth(below) > most:
            yield below, at, make


def _worth(layer: str | bytes) -> float:
    """Findings of a text; of compressed data whether it is all there."""
    if isinstance(layer, str):
        return len(findings(layer))
    z, rest = zlib.decompressobj(47), layer
    try:
        while not z.eof and rest:
            z.decompress(rest, CHUNK)
            rest = z.unconsumed_tail
    except zlib.error:
        return 0
    return math.inf if z.eof else 0


def _blocks(text: str, start: int, end: int) -> Iterator[Layer]:
    """Layers of the lines of a stretch: blocks of lines of one length with a shorter last one (the first line
    may have begun before the run), then lines alone, then parts of lines that are no text as a whole."""
    lines = _lines(text, start, end)
    size = [e - s for s, e in lines]
    plain: set[int] = set()  # lines that a block's text holds whole
    i = 0
    while i + 1 < len(lines):
        j = i + 1
        while j < len(lines) and size[j] == size[i + 1]:
            j += 1
        ends = [j + 1] if j < len(lines) and size[j] < size[i + 1] else []
        ends += [j] + ([i + 2] if size[i] > size[i + 1] and j > i + 2 else [])
        for k in ends:
            got = _decoded(text, lines[i:k])
            if got and (got[2] or _packed(got[0])):
                for below, make in got[1] + [(got[0], None)] * _packed(got[0]):
                    yield below, (lines[i][0], lines[k - 1][1]), make
                if got[2] and not any(n % 4 for n in size[i : k - 1]):
                    plain.update(range(i, k))
                i = k
                break
        else:
            i = i + 1 if size[i] != size[i + 1] else j
    for k, (s, e) in enumerate(lines):
        if k in plain:
            continue
        got = _decoded(text, [(s, e)])
        if got:
            for below, make in got[1] + [(got[0], None)] * _packed(got[0]):
                yield below, (s, e), make
        if not got or not got[2]:
            yield from _parts(text, s, e)


def _parts(text: str, s: int, e: int) -> Iterator[Layer]:
    """Layers inside a line that is no text as a whole: base64 may begin at any of four places in its groups, and the two alphabets
    may end one another."""
    spans = {(s, e)} | {m.span() for m in re.compile(r"[A-Za-z0-9+/]{16,}+={0,2}").finditer(text, s, e)} | {m.span() for m in re.compile(r"[A-Za-z0-9_-]{16,}+={0,2}").finditer(text, s, e)}
    for a, b in sorted(spans):
        for shift in range(4):
            if shift == 0 and (a, b) == (s, e):
                continue
            n = len(text[a + shift : b].rstrip("="))
            # A last character over is one of what follows.
            got = _decoded(text, [(a + shift, a + shift + n - (n % 4 == 1))])
            if got and _packed(got[0]):
                yield got[0], (a + shift, b), None
            if got:
                for below, make in got[1]:
                    if got[2] or findings(below):
                        yield below, (a + shift, b), make


def _outermost(text_level: set[Finding], below: set[Finding]) -> set[Finding]:
    """All findings of the text itself, and those of layers that no other of their kind covers."""
    out = set(text_level)
    for kind in {k for k, *_ in below}:
        reach = -1
        rows = sorted({(s, -e) for f, s, e in text_level | below if f == kind})
        for s, e in rows:
            if -e > reach:
                out.add((kind, s, -e))
                reach = -e
    return out


def _span(to: Map | None, s: int, e: int) -> tuple[int, int]:
    if to is None:
        return s, e
    if to.arrays is None:
        return to.place
    return int(to.arrays[0][s:e].min()), int(to.arrays[1][s:e].max())


def _through(to: Map | None, make: Callable[[], Arrays]) -> Arrays | None:
    """Spans in the text of what has spans in a layer."""
    if to is None:
        return make()
    if to.arrays is None:
        return None
    first, last = make()
    return to.arrays[0][first], to.arrays[1][np.maximum(last, 1) - 1]


def _below(layer: str, to: Map | None, depth: int, left: list[int]) -> Iterator[tuple[str | None, Map, int]]:
    """The layers one step down, each with its map to the text; None after those of a bomb. `left` has the characters that may
    still be scanned below ROUNDS."""
    if depth >= ROUNDS:
        left[0] -= len(layer)
    got = _unescaped(layer) if depth < ROUNDS or left[0] >= 0 else _settled(layer)
    if got and got[0] != layer:
        out, first, last = got
        where = Map((0, len(layer)) if to is None else to.place, partial(_through, to, lambda: (first, last)))
        where.arrays  # here and now, lest a chain of escapes is followed up at once  # noqa: B018
        yield out, where, depth + 1
    for runs, split in ((_RUNS, _encoded), (_HEX_RUNS, _hex_digits)):
        for m in runs.finditer(layer):
            for found, at, make in split(layer, *m.span()):
                where = _span(to, *at)
                if isinstance(found, str):
                    yield found, Map(where, partial(_through, to, make)), 0
                else:
                    for below in _unpacked(found):
                        yield below, Map(where), 0
    for found, at, _ in _escaped_data(layer):
        where = _span(to, *at)
        for below in _unpacked(found):
            yield below, Map(where), 0


def scan_text(text: str | None) -> tuple[list[Finding], list[Finding]]:
    """Base findings, and all findings, of a text, as (kind, start, end) in its code points."""
    text = text or ""
    base = findings(text, tuple(BASE))
    top, below = {*base, *findings(text, tuple(EXTRA))}, set()
    left = [SCANNED]
    work = [_below(text, None, 0, left)]
    seen: set[tuple] = set()
    while work:
        step = next(work[-1], None)
        if step is None:
            work.pop()
            continue
        layer, to, depth = step
        if layer is None:
            below.add(("bomb", *to.place))
            continue
        key = (xxhash.xxh3_128_digest(layer.encode("utf-8", "surrogatepass")), to.place)
        if key in seen:
            continue
        seen.add(key)
        below |= {(k, *_span(to, s, e)) for k, s, e in findings(layer)}
        work.append(_below(layer, to, depth, left))
    order = {k: i for i, k in enumerate(KINDS)}
    found = _outermost(top, below)
    return sorted(base, key=lambda x: (x[1], order[x[0]])), sorted(found, key=lambda x: (x[1], order[x[0]], x[2]))


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """A row per document: id, base and spans, each an array of (kind, start, end)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = lambda found: [{"kind": k, "start": s, "end": e} for k, s, e in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan_text(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([rows(g[k]) for g in got], item) for k in (0, 1))], ["id", "base", "spans"])

    kind = slim.schema["id"].dataType.simpleString()
    spans = "array<struct<kind string, start long, end long>>"
    return slim.mapInArrow(run, f"id {kind}, base {spans}, spans {spans}")
