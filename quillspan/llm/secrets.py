"""Operator 7, secret scans with a recursive decoding worklist.

Each text is a work item. A layer is scanned by the base patterns, then searched for encoded parts:
URL escapes, Unicode escapes, base64 and hexadecimal runs (whose bytes may be gzip, zlib or bzip2
streams). Every part that decodes becomes a new work item; within one part, equal content is taken once
(which ends cycles), and what a part holds is kept for its equals, which are reported at their own
places. Escapes keep a map from each decoded character to the characters that it came from; the
characters of a base64, hexadecimal or compressed part all map to the whole part. A base64 run may be
wrapped over lines and may begin or end with foreign characters, as after "key/": it is decoded at all
four alignments, and the part is what reads as one, out to the next / - _ or + and of the lines that hold
what was found. What is found in a layer is reported in the outermost text's code points.

Escapes are undone layer by layer, and from the fifth on all at once, so that long chains of them take
time linear in the text. Bytes are read as ASCII, UTF-8, Latin-1 or UTF-16.

Streams are looked for anywhere in a part's bytes and unwrapped again while they hold streams. No size
is cut: what swells beyond `MOST_GROWTH` goes to a temporary file and is scanned in pieces that end where
no pattern can match, and the text is marked `swollen`.

Defined results: null is the empty text and has no spans; repeated rows are scanned alike; overlapping
spans of different kinds all stay; a decoded span that equals a base span of its kind is reported once.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import mmap
import re
import tempfile
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import cached_property, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, only

#: Fixed by the contract: kinds in their order, patterns, least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#x?[0-9A-Fa-f]{1,6};)+")
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 runs with only line breaks between them, and such a run's lines.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Where a foreign start or end may meet a run.
MARK = re.compile(r"[/_+-]")
PLAIN = str.maketrans("-_", "+/")
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){12,}(?![0-9A-Fa-f])")
HINT = re.compile(r"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]{2}|&#x?[0-9A-Fa-f]{1,6};|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][\r\n]{1,2}[ \t]*[A-Za-z0-9+/_-]")
#: Starts of gzip, zlib and bzip2 streams, and what may stand between two members.
STREAM = re.compile(rb"\x1f\x8b\x08|x[\x01^\x9c\xda]|BZh[1-9]")
PADDING = re.compile(rb"\0*")
#: The shortest secret has 14 characters.
PRINTED = re.compile(rb"[\t\n\r -~]{14,}")
TEXT = re.compile(rb"(?:[\t\n\r -~]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})++")
#: What stands in no pattern, so that a text may be parted there.
APART = re.compile(rb"[^A-Za-z0-9+/_.=%\\&#;:\"' \t\r\n-]")
CHUNK = 1 << 16
MOST_GROWTH = 1 << 24

#: UTF-16 text without characters beyond Latin-1.
WIDE = re.compile(rb"(?:[\t\n\r -~]\0){14,}|(?:\0[\t\n\r -~]){14,}")
#: An escape that ends here, and what ends one.
TAIL = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});)\Z")
LAST = set("0123456789abcdefABCDEF;")
#: Layers of escapes that are scanned one by one.
LAYERS = 4

Span = tuple[int, int, int]  # start, index of kind, end
Map = tuple[np.ndarray, np.ndarray]  # for each character where it comes from
Layer = tuple[str, np.ndarray, np.ndarray]
Content = str | bytes | mmap.mmap
Where = tuple[int, int] | Callable[[], list[tuple[int, int]]]


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _escapes(text: str) -> Layer | None:
    """The text with one layer of URL and Unicode escapes undone, and for each character its source range."""
    out: list[str] = []
    starts: list[np.ndarray | list[int]] = []
    ends: list[np.ndarray | list[int]] = []
    end = 0

    def plain(a: int, b: int) -> None:
        if a < b:
            out.append(text[a:b])
            starts.append(np.arange(a, b))
            ends.append(np.arange(a + 1, b + 1))

    for m in sorted([*PERCENT.finditer(text), *ESCAPE.finditer(text)], key=lambda m: m.start()):
        plain(end, m.start())
        x, y = [], []
        if m[0][0] == "%":
            data = bytes.fromhex(m[0].replace("%", ""))
            try:
                decoded = data.decode()
            except UnicodeDecodeError:
                decoded = data.decode("latin-1")
            at = m.start()
            exact = len(decoded.encode()) == len(data)
            for c in decoded:
                x.append(at)
                at += 3 * (len(c.encode()) if exact else 1)
                y.append(at)
            out.append(decoded)
        else:
            for e in ONE_ESCAPE.finditer(m[0]):
                code = int(e[4]) if e[4] else int(e[1] or e[2] or e[3], 16)
                out.append(chr(code) if code < 0x110000 else e[0][0])
                x.append(m.start() + e.start())
                y.append(m.start() + e.end())
        starts.append(x)
        ends.append(y)
        end = m.end()
    if not end:
        return None
    plain(end, len(text))
    return "".join(out), np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)


def _all_escapes(text: str) -> Layer | None:
    """The same with all layers undone at once: what an escape gives is met with what stands before it, so time is linear."""
    if not HINT.search(text):
        return None
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    some = False
    for i, c in enumerate(text):
        begin, end = i, i + 1
        while c:
            out.append(c)
            starts.append(begin)
            ends.append(end)
            if c not in LAST:
                break
            m = TAIL.search("".join(out[-10:]))
            if not m:
                break
            code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
            begin, some = starts[-len(m[0])], True
            del out[-len(m[0]) :], starts[-len(m[0]) :], ends[-len(m[0]) :]
            c = chr(code) if code < 0x110000 else "?"
    return ("".join(out), np.array(starts, np.int64), np.array(ends, np.int64)) if some else None


def views(text: str) -> Iterator[tuple[str, Map | None]]:
    """The text and what its escapes give: the outer LAYERS one by one, then all that are left at once."""
    yield text, None
    where = None
    for n in range(LAYERS + 1):
        got = _escapes(text) if n < LAYERS else _all_escapes(text)
        if not got:
            return
        text, a, b = got
        where = (a, b) if where is None else (where[0][a], where[1][b - 1])
        yield text, where


def _stream(data: bytes | mmap.mmap, at: int, sink) -> int | None:
    """Writes what the stream at a place holds and returns its end, or None if it is cut or damaged."""
    view = memoryview(data)
    machine = bz2.BZ2Decompressor() if data[at : at + 1] == b"B" else zlib.decompressobj(47)
    feed = b""
    while not machine.eof:
        wants = not feed and getattr(machine, "needs_input", True)
        if wants:
            feed = bytes(view[at : at + CHUNK])
            at += len(feed)
        over = wants and not feed
        try:
            got = machine.decompress(feed, CHUNK)
        except (zlib.error, OSError, EOFError, ValueError):
            return None
        feed = getattr(machine, "unconsumed_tail", b"")
        sink.write(got)
        if over and not got:
            return None
    return at - len(machine.unused_data)


def _streams(data: bytes | mmap.mmap, swollen: list[bool]) -> Iterator[tuple[int, int, bytes | mmap.mmap]]:
    """Start, end and content of each compressed stream in data; members that follow each other are one stream."""
    at = 0
    while m := STREAM.search(data, at):
        start = end = m.start()
        with tempfile.SpooledTemporaryFile(MOST_GROWTH) as sink:
            while m and (after := _stream(data, end, sink)) is not None:
                end, tail = after, PADDING.match(data, after).end()
                m = STREAM.match(data, tail)
                if m and m[0][:1] == data[start : start + 1]:
                    end = tail
                else:
                    m = None
            at = max(end, start + 1) if m is None else end + 1
            if size := sink.tell():
                if size > MOST_GROWTH:
                    swollen[0] = True
                    sink.rollover()
                    sink.flush()
                    out = mmap.mmap(sink.fileno(), size, access=mmap.ACCESS_READ)
                else:
                    sink.seek(0)
                    out = sink.read()
                yield start, len(data) if m else end, out


def _readable(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    odd = sum(c < 32 and c not in (9, 10, 13) or c == 127 for c in data)
    return odd * 20 <= len(data)


def _texts(data: bytes | mmap.mmap) -> Iterator[str]:
    """The stretches of data that patterns can match, all of which are ASCII; long ones in pieces that part no match."""
    for m in PRINTED.finditer(data):
        a, end = m.span()
        while end - a > MOST_GROWTH:
            cut = APART.search(data, a + MOST_GROWTH, end)
            b = cut.start() if cut else end
            yield data[a:b].decode("ascii")
            a = b
        yield data[a:end].decode("ascii")
    for m in WIDE.finditer(data):
        yield m[0].replace(b"\0", b"").decode("ascii")


class Run:
    """A base64 run, maybe over several lines, that is between two places of a text."""

    def __init__(self, text: str, a: int, b: int):
        self.lines = [m.span() for m in LINE.finditer(text, a, b)]
        self.first = [0, *accumulate(y - x for x, y in self.lines[:-1])]
        self.body = "".join(text[x:y] for x, y in self.lines).rstrip("=")

    @cached_property
    def marks(self) -> list[int]:
        return [m.start() for m in MARK.finditer(self.body)]

    def line(self, i: int) -> int:
        return bisect_right(self.first, i) - 1

    def place(self, i: int) -> int:
        return self.lines[k := self.line(i)][0] + i - self.first[k]

    def chars(self, shift: int, a: int, b: int) -> tuple[int, int]:
        """The run's characters that bytes a to b come from."""
        return shift + a // 3 * 4 + a % 3, min(shift + (b - 1) // 3 * 4 + (b - 1) % 3 + 2, len(self.body))

    def bounds(self, shift: int, a: int, b: int, size: int) -> tuple[int, int]:
        """Where bytes a to b come from, up to the next boundaries; lines do not count."""
        x, y = self.chars(shift, a, b)
        k = bisect_left(self.marks, x)
        low = self.place(self.marks[k - 1] + 1) if k and (a or shift) else self.lines[0][0]
        k = bisect_left(self.marks, y)
        high = self.place(self.marks[k]) if k < len(self.marks) and size - b > 2 else self.lines[-1][1]
        return low, high

    def range(self, shift: int, a: int, b: int, low: int, high: int) -> tuple[int, int]:
        """The lines that bytes a to b come from, between bounds."""
        x, y = self.chars(shift, a, b)
        return max(low, self.lines[self.line(x)][0]), min(high, self.lines[self.line(y - 1)][1])

    def ranges(self, shift: int, a: int, b: int, low: int, high: int) -> list[tuple[int, int]]:
        return [self.range(shift, i, i + 1, low, high) for i in range(a, b)]

    def parts(self, swollen: list[bool]) -> Iterator[tuple[Content, Where]]:
        """What the run holds at each of the four alignments, as a foreign start may shift it."""
        for shift in range(4):
            body = self.body[shift : len(self.body) - ((len(self.body) - shift) % 4 == 1)]
            data = base64.b64decode(body.translate(PLAIN) + "=" * (-len(body) % 4))
            if PRINTED.search(data):
                for t in [(0, len(data))] if not shift and _readable(data) else [m.span() for m in TEXT.finditer(data)]:
                    for m in PRINTED.finditer(data, *t):
                        bounds = self.bounds(shift, *t, len(data))
                        if len(self.lines) == 1:
                            yield m[0], bounds
                        else:
                            yield m[0].decode("ascii"), partial(self.ranges, shift, *m.span(), *bounds)
            for m in WIDE.finditer(data):
                yield m[0], self.range(shift, *m.span(), *self.bounds(shift, *m.span(), len(data)))
            if STREAM.search(data):
                for a, b, held in _streams(data, swollen):
                    yield held, self.range(shift, a, b, *self.bounds(shift, a, b, len(data)))


def _parts(text: str, swollen: list[bool]) -> Iterator[tuple[Content, Where]]:
    """What base64 and hexadecimal runs hold, each with its place, or for a text over several lines with a call for each character's."""
    end = 0
    wrapped = [m.span() for m in WRAPPED.finditer(text) if m.end() - m.start() >= 20] if "\n" in text or "\r" in text else []
    for a, b in [*wrapped, (len(text), len(text))]:
        for m in BASE64.finditer(text, end, a):
            yield from Run(text, *m.span()).parts(swollen)
        if a < b:
            yield from Run(text, a, b).parts(swollen)
        end = b
    for m in HEX_BYTES.finditer(text):
        yield bytes.fromhex(m[0]), m.span()


def _digest(item: Content) -> bytes:
    return hashlib.blake2b(item.encode("utf-8", "surrogatepass") if isinstance(item, str) else item, digest_size=16).digest()


def _inner(item: Content, kinds: set[int], swollen: list[bool]) -> Iterator[Content]:
    """What a text's escapes and parts, or a part's bytes, hold; adds the kinds of the texts to `kinds`."""
    if isinstance(item, str):
        for text, _ in views(item):
            kinds |= {kind for _, kind, _ in base_spans(text)}
            for held, _ in _parts(text, swollen):
                yield held
        return
    yield from _texts(item)
    for _, _, data in _streams(item, swollen):
        yield data


def _kinds(part: Content, known: dict[bytes, set[int]], swollen: list[bool]) -> set[int]:
    """The kinds of all that a part holds in any layer; `known` has what equal parts gave."""
    first = _digest(part)
    if first not in known:
        kinds, seen, work = set(), set(), [iter([part])]
        while work and len(kinds) < len(KINDS):
            item = next(work[-1], None)
            if item is None:
                work.pop()
                continue
            digest = (isinstance(item, str), _digest(item))
            if digest not in seen:
                seen.add(digest)
                work.append(_inner(item, kinds, swollen))
        known[first] = kinds
    return known[first]


def scan(text: str | None) -> tuple[list[Span], list[Span], bool]:
    """Base spans, all spans, and whether a stream swelled beyond MOST_GROWTH; both lists sorted by start, kind, end."""
    if not text:
        return [], [], False
    base = sorted(base_spans(text))
    if not HINT.search(text):
        return base, base, False
    found = set(base)
    known: dict[bytes, set[int]] = {}
    swollen = [False]
    work: deque[tuple[str, Map | None]] = deque([(text, None)])
    while work:
        item, outside = work.popleft()
        for layer, where in views(item):
            if where is None:
                where = outside
            elif outside is not None:
                where = outside[0][where[0]], outside[1][where[1] - 1]

            def outer(a: int, b: int, where=where) -> tuple[int, int]:
                return (a, b) if where is None else (int(where[0][a]), int(where[1][b - 1]))

            if where is not None:
                for a, kind, b in base_spans(layer):
                    x, y = outer(a, b)
                    found.add((x, kind, y))
            for held, at in _parts(layer, swollen):
                if callable(at):
                    places = [outer(a, b) for a, b in at()]
                    work.append((held, (np.array([a for a, _ in places]), np.array([b for _, b in places]))))
                else:
                    x, y = outer(*at)
                    found |= {(x, kind, y) for kind in _kinds(held, known, swollen)}
    return base, sorted(found), swollen[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans, swollen) with base and spans as arrays of (start, kind, end)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(t.as_py()) for t in batch.column("text")]
            rows = [[[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in x[i]] for x in got] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows[0], span), pa.array(rows[1], span), pa.array([x[2] for x in got])], ["doc_id", "base", "spans", "swollen"])

    kind = "array<struct<start:long,kind:string,end:long>>"
    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}, swollen boolean")


def masked(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every found span, and what overlaps it, replaced by one mark."""
    if not text:
        return text
    out, end = [], 0
    spans = sorted((a, b) for a, _, b in scan(text)[1])
    i = 0
    while i < len(spans):
        a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[end:a], mark]
        end = b
        i += 1
    return "".join([*out, text[end:]])


def mask_docs(docs: DataFrame) -> DataFrame:
    """docs with `text` masked; all other columns stay as they are."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([masked(t.as_py()) for t in columns[place]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return mapped(docs, run)


def joined_column(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
