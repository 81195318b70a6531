"""Media columns: signature sniffing and carving.

A media column is a struct of a declared type and bytes.  Aho-Corasick finds all magic
numbers in one pass; for each place a validator of the format walks the structure and
gives the length, or refuses.  What begins at offset 0 corrects the declared type; valid
objects further on are carved, unless they lie inside one that was carved already.

The query stores each text as samples in a container: a WAV file of 8-bit samples, or a
PNG of 8-bit grey values, by a digit of the payload's CRC.  The bytes are written to a
table, read back, sniffed, and decoded by what was sniffed; the features come from that.

No signature is refused for the work of others.  Still time is linear in the bytes, but for gzip.  End marks
(PDF, ZIP) are found by the same pass and looked up.  Walks over a structure (chunks, boxes, pages, blocks) that meet
go on alike: where one has failed no other goes on, and walks that succeed lie apart.  A RIFF's walk also depends on its
end: long ones jump there.  Sums of long PNG chunks come from sums of the bytes before.
A gzip member must be inflated to be told, from each of its signatures: bytes made of very many false ones that each inflate
far take time by their square.  UTF-8 text can't hold a gzip signature.

Cases: null texts are empty; the empty text has a payload of 576 filler bytes; bytes of
no known format keep their declared type and carve nothing from offset 0; null bytes are
empty bytes; truncated or lying structures are refused; equal texts get equal values.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import bounded_batches, documents, worker_cache, written

UNIT = 576
FILLER = b"\xff"
TAIL = 32
RATE = 16_000
WIDTH = 24

#: Format, media type, magic bytes, and their offset in the object.
SIGNATURES = [
    ("png", "image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("gif", "image/gif", b"GIF87a", 0),
    ("gif", "image/gif", b"GIF89a", 0),
    ("jpeg", "image/jpeg", b"\xff\xd8\xff", 0),
    ("bmp", "image/bmp", b"BM", 0),
    ("wav", "audio/wav", b"WAVE", 8),
    ("webp", "image/webp", b"WEBPVP8", 8),
    ("pdf", "application/pdf", b"%PDF-", 0),
    ("zip", "application/zip", b"PK\x03\x04", 0),
    ("gzip", "application/gzip", b"\x1f\x8b\x08", 0),
    ("flac", "audio/flac", b"fLaC", 0),
    ("ogg", "audio/ogg", b"OggS", 0),
    ("mp4", "video/mp4", b"ftyp", 4),
]
#: Marks that a validator looks for beyond an object's begin.
MARKS = {"pdf-end": b"%%EOF", "pdf-table": b"startxref", "zip-end": b"PK\x05\x06"}

#: A byte 255 that is neither data of a JPEG scan (0 behind it) nor a restart in it.
JPEG_MARK = re.compile(rb"\xff(?=[^\x00\xd0-\xd7])")

#: Chunks of a RIFF that are walked one by one before jumps are made.
PLAIN_CHUNKS = 64
#: PNG chunks up to so many bytes are summed as they are; for longer ones there is a sum of all before every SUM_STEP bytes.
PLAIN_SUM, SUM_STEP = 1 << 16, 1 << 12

_BACK = [len(magic) + offset - 1 for _, _, magic, offset in SIGNATURES]
_PDF = [kind for kind, *_ in SIGNATURES].index("pdf")
TYPES = {kind: media for kind, media, _, _ in SIGNATURES}


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    length: int


class Scan:
    """The bytes with the places of marks and signatures, and what validators keep for later ones."""

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[str, list[int]] = {name: [] for name in MARKS}
        self.pdf_begins: list[int] = []
        codes = array("q")
        for last, value in machine().iter(data.decode("latin-1")):
            if isinstance(value, str):
                self.places[value].append(last + 1 - len(MARKS[value]))
            else:
                start = last - _BACK[value]
                if start >= 0:
                    codes.append(start << 8 | value)
                    if value == _PDF:
                        self.pdf_begins.append(start)
        #: Places and signatures, by place.
        self.hits = np.sort(np.frombuffer(codes, dtype=np.int64)) if codes else np.empty(0, np.int64)
        self._failed: dict[str, bytearray] = {}
        self._jpeg_marks: array | None = None
        self._zip_ends: dict[int, int] | None = None
        self._sums: array | None = None
        self._zeros: array | None = None
        self._chunks: Chunks | None = None

    def failed(self, kind: str) -> bytearray:
        """Of each place bits for the states in which a walk of this format came there and failed."""
        if kind not in self._failed:
            self._failed[kind] = bytearray(len(self.data) + 1)
        return self._failed[kind]

    def chunks(self) -> Chunks:
        if self._chunks is None:
            self._chunks = Chunks(self.data)
        return self._chunks

    def zip_end(self, at: int) -> int | None:
        """The end of the nearest archive whose end record leads back to ``at``."""
        if self._zip_ends is None:
            self._zip_ends, d = {}, self.data
            for end in self.places["zip-end"]:
                if end + 22 <= len(d):
                    size, offset, note = struct.unpack_from("<IIH", d, end + 12)
                    if end + 22 + note <= len(d):
                        self._zip_ends.setdefault(end - size - offset, end + 22 + note)
        return self._zip_ends.get(at)

    def zero(self, at: int) -> int:
        """The first byte 0 at or beyond ``at``; where there is none, the end of the bytes."""
        d = self.data
        if self._zeros is None:
            self._zeros = array("q", (p for p in range(0, len(d), SUM_STEP) if d.find(0, p, p + SUM_STEP) >= 0))
        found = d.find(0, at, at - at % SUM_STEP + SUM_STEP)
        if found < 0:
            i = bisect_right(self._zeros, at)
            found = d.find(0, self._zeros[i]) if i < len(self._zeros) else len(d)
        return found

    def crc(self, begin: int, end: int) -> int:
        """CRC-32 of a range, in a time that doesn't depend on its length."""
        d = memoryview(self.data)
        if end - begin <= PLAIN_SUM:
            return zlib.crc32(d[begin:end])
        if self._sums is None:
            self._sums = array("L", [0])
            for p in range(0, len(d), SUM_STEP):
                self._sums.append(zlib.crc32(d[p : p + SUM_STEP], self._sums[-1]))
        before, all_of_it = (zlib.crc32(d[p - p % SUM_STEP : p], self._sums[p // SUM_STEP]) for p in (begin, end))
        return all_of_it ^ crc_times(before, crc_zeros(end - begin))

    def jpeg_mark(self, at: int) -> int:
        """The first marker at or beyond ``at`` that ends a scan's data; where there is none, the end of the bytes."""
        if self._jpeg_marks is None:
            self._jpeg_marks = array("q", (m.start() for m in JPEG_MARK.finditer(self.data)))
        i = bisect_left(self._jpeg_marks, at)
        return self._jpeg_marks[i] if i < len(self._jpeg_marks) else len(self.data)

    def found(self, kind: str, at: int) -> int | None:
        """The length of the valid object at ``at``."""
        return VALIDATORS[kind](self, at)


def crc_times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; the highest bit is x to the 0."""
    out = 0
    while a:
        if a >> 31:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@cache
def _crc_power(digit: int, place: int) -> int:
    """x to the 8 * digit * 256 ** place."""
    if digit > 1:
        half = _crc_power(digit // 2, place)
        return crc_times(crc_times(half, half), _crc_power(digit % 2, place))
    if not digit:
        return 1 << 31
    if not place:
        return 1 << 23
    half = _crc_power(128, place - 1)
    return crc_times(half, half)


def crc_zeros(n: int) -> int:
    """What a CRC-32 is multiplied by when ``n`` bytes follow."""
    out, place = 1 << 31, 0
    while n:
        if n & 255:
            out = crc_times(out, _crc_power(n & 255, place))
        n, place = n >> 8, place + 1
    return out


class Chunks:
    """RIFF chunks: each leads to the next one, whatever the form they are in.

    A chunk has its place among all that are known, the next chunk, and one far on (-1: none), so that of a chain
    of any length the last chunk before an end is found in steps that grow as the logarithm (skew-binary jumps).
    """

    def __init__(self, data: bytes):
        self.data = data
        self.number: dict[int, int] = {}
        #: By number: place, next, far, how many follow, and the first of this and those that follow that is "fmt " or "data" (its place, or -1).
        self.place, self.next, self.far, self.follow, self.form, self.body = (array("q") for _ in range(6))

    def at(self, p: int) -> int:
        """The number of the chunk at ``p``, or -1."""
        path, d = [], self.data
        while p + 8 <= len(d) and p not in self.number:
            path.append(p)
            n = struct.unpack_from("<I", d, p + 4)[0]
            p += 8 + n + (n & 1)
        last = self.number.get(p, -1)
        for p in reversed(path):
            far, kind = last, d[p : p + 4]
            if last >= 0:
                one = self.far[last]
                two = self.far[one] if one >= 0 else -1
                if two >= 0 and self.follow[last] - self.follow[one] == self.follow[one] - self.follow[two]:
                    far = two
            for column, value in (
                (self.place, p),
                (self.next, last),
                (self.far, far),
                (self.follow, self.follow[last] + 1 if last >= 0 else 0),
                (self.form, p if kind == b"fmt " else self.form[last] if last >= 0 else -1),
                (self.body, p if kind == b"data" else self.body[last] if last >= 0 else -1),
            ):
                column.append(value)
            last = self.number[p] = len(self.place) - 1
        return last

    def last_before(self, i: int, end: int) -> int:
        """Of the chunk ``i``, whose head ends at ``end`` at the latest, and those that follow the last one of which this holds."""
        while True:
            for j in (self.far[i], self.next[i]):
                if j >= 0 and self.place[j] + 8 <= end:
                    i = j
                    break
            else:
                return i


def _png(s: Scan, at: int) -> int | None:
    """As in ``_jpeg``, no walk goes on where one has failed."""
    d, p, first, path = s.data, at + 8, True, []
    failed = s.failed("png")
    while p + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or first != (kind == b"IHDR") or not kind.isalpha() or (not first and failed[p]):
            break
        if not first:
            path.append(p)
        if s.crc(p + 4, p + 8 + n) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            break
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    for p in path:
        failed[p] = 1
    return None


def _gif(s: Scan, at: int) -> int | None:
    d = s.data
    if at + 13 > len(d):
        return None
    flags = d[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    # States: 1 between blocks, 2 among a block's parts; once there was an image 4 and 8.
    failed, path, inside, image = s.failed("gif"), [], False, False
    while p < len(d):
        bit = 1 << inside + 2 * image
        if failed[p] & bit:
            break
        path.append(p << 4 | bit)
        if inside:
            inside = d[p] > 0
            p += d[p] + 1
        elif d[p] == 0x3B:
            if image:
                return p + 1 - at
            break
        elif d[p] == 0x21:
            p, inside = p + 2, True
        elif d[p] == 0x2C and p + 11 <= len(d):
            p, inside, image = p + 10 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 128 else 0) + 1, True, True
        else:
            break
    for code in path:
        failed[code >> 4] |= code & 15
    return None


def _jpeg(s: Scan, at: int) -> int | None:
    """Walks that meet go on alike: where one has failed no other goes on, so all of them take time in proportion to the bytes."""
    d, p, frame, end, path = s.data, at + 2, False, 0, []
    # Of each place the walks that failed from there: 1 without a frame header before it, 2 with one.
    failed = s.failed("jpeg")
    while p + 4 <= len(d) and d[p] == 0xFF:
        bit = 1 + frame
        if failed[p] & bit:
            break
        path.append((p, bit))
        mark = d[p + 1]
        if mark == 0xD9:
            end = p + 2 if frame else 0
            break
        if mark < 0xC0 or mark == 0xFF:
            break
        n = struct.unpack_from(">H", d, p + 2)[0]
        if n < 2:
            break
        frame |= mark in (0xC0, 0xC1, 0xC2)
        p += 2 + n
        if mark == 0xDA:
            p = s.jpeg_mark(p)
    else:
        end = p + 2 if frame and d[p : p + 2] == b"\xff\xd9" else 0
    if end:
        return end - at
    for p, bit in path:
        failed[p] |= bit
    return None


def _bmp(s: Scan, at: int) -> int | None:
    d = s.data
    if at + 26 > len(d):
        return None
    size, zero, pixels, header = struct.unpack_from("<IIII", d, at + 2)
    ok = zero == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= pixels <= size <= len(d) - at
    return size if ok else None


def _riff(s: Scan, at: int, form: bytes, needs: tuple[bytes, ...]) -> int | None:
    d = s.data
    if d[at : at + 4] != b"RIFF" or d[at + 8 : at + 12] != form:
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d):
        return None
    p, seen = at + 12, set()
    for _ in range(PLAIN_CHUNKS):
        if p + 8 > end:
            return end - at if all(x in seen for x in needs) else None
        kind, n = struct.unpack_from("<4sI", d, p)
        if p + 8 + n > end:
            return None
        seen.add(kind)
        p += 8 + n + (n & 1)
    if p + 8 <= end:
        chunks = s.chunks()
        first = chunks.at(p)
        last = chunks.last_before(first, end)
        p = chunks.place[last]
        if p + 8 + struct.unpack_from("<I", d, p + 4)[0] > end:
            return None
        seen |= {kind for kind, column in ((b"fmt ", chunks.form), (b"data", chunks.body)) if 0 <= column[first] <= p}
    return end - at if all(x in seen for x in needs) else None


def _wav(s: Scan, at: int) -> int | None:
    return _riff(s, at, b"WAVE", (b"fmt ", b"data"))


def _webp(s: Scan, at: int) -> int | None:
    return _riff(s, at, b"WEBP", ())


def _pdf(s: Scan, at: int) -> int | None:
    # A file that was changed has an end mark for each version: the last one before another file begins is its end.
    begins, ends, tables = s.pdf_begins, s.places["pdf-end"], s.places["pdf-table"]
    after = bisect_right(begins, at)
    stop = begins[after] if after < len(begins) else len(s.data)
    last = bisect_left(ends, stop) - 1
    if last < 0 or ends[last] < at:
        # A file that holds another one ends behind it.
        last = len(ends) - 1
        if last < 0 or ends[last] < at:
            return None
    table = bisect_left(tables, ends[last]) - 1
    return ends[last] + 5 - at if table >= 0 and tables[table] > at else None


def _zip(s: Scan, at: int) -> int | None:
    end = s.zip_end(at)
    return end - at if end else None


def _gzip(s: Scan, at: int) -> int | None:
    d, p = s.data, at + 10
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return None
    # The head is read here, for its names may be as long as the bytes: an extra field, two names, its sum.
    flags = d[at + 3]
    if flags & 4:
        p += 2 + int.from_bytes(d[p : p + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            p = s.zero(p) + 1
    if flags & 2:
        if p + 2 > len(d) or s.crc(at, p) & 0xFFFF != struct.unpack_from("<H", d, p)[0]:
            return None
        p += 2
    engine, total, check = zlib.decompressobj(-15), 0, 0
    try:
        while not engine.eof and p < len(d):
            tail = d[p : p + 4096]
            while tail and not engine.eof:
                out = engine.decompress(tail, 1 << 16)
                total, check, tail = total + len(out), zlib.crc32(out, check), engine.unconsumed_tail
            p += 4096
    except zlib.error:
        return None
    end = min(p, len(d)) - len(engine.unused_data)
    good = engine.eof and end + 8 <= len(d) and struct.unpack_from("<II", d, end) == (check, total & 0xFFFFFFFF)
    return end + 8 - at if good else None


def _flac(s: Scan, at: int) -> int | None:
    d, p, first, path = s.data, at + 4, True, []
    failed = s.failed("flac")
    while p + 4 <= len(d):
        head, n = d[p], int.from_bytes(d[p + 1 : p + 4], "big")
        if first and (head & 127 or n != 34) or not first and failed[p]:
            break
        if not first:
            path.append(p)
        p, first = p + 4 + n, False
        if head & 128:
            # Frames carry no length: the stream runs to the end of the bytes.
            if p + 2 <= len(d) and d[p] == 0xFF and d[p + 1] & 0xFC == 0xF8:
                return len(d) - at
            break
    for p in path:
        failed[p] = 1
    return None


def _ogg(s: Scan, at: int) -> int | None:
    d, p, path = s.data, at, []
    failed = s.failed("ogg")
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d) and d[p + 4] == 0:
        path.append(p)
        n = d[p + 26]
        size = 27 + n + sum(d[p + 27 : p + 27 + n])
        if failed[p] or p + size > len(d):
            for q in path:
                failed[q] = 1
            return None
        last = d[p + 5] & 4
        p += size
        if last:
            break
    return p - at if path else None


def _mp4(s: Scan, at: int) -> int | None:
    d, p, film, end, path, beyond = s.data, at, False, at, [], []
    # Of each place: 1 if neither it nor what follows is a moov box, 2 if none is a box that a file may end with.
    failed = s.failed("mp4")
    while p + 8 <= len(d):
        if p > at and failed[p] & (2 if film else 3):
            break
        n, kind = struct.unpack_from(">I4s", d, p)
        head = 8
        if n == 1 and p + 16 <= len(d):
            # The size follows in 64 bits.
            n, head = struct.unpack_from(">Q", d, p + 8)[0], 16
        elif n == 0:
            # The box runs to the end of the bytes.
            n = len(d) - p
        # Boxes of other kinds are passed by their size; what isn't a box at all ends the file.
        if n < head or p + n > len(d) or not all(c in _BOX_LETTERS for c in kind) or (p > at and kind == b"ftyp"):
            break
        film |= kind == b"moov"
        path.append(p)
        beyond.append(p)
        p += n
        if kind in _BOXES:
            end = p
            beyond.clear()
    for q in beyond if film else path:
        if q > at:
            failed[q] |= 2 if film else 1
    return end - at if film else None


#: Boxes that a file may end with.
_BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"meta", b"uuid", b"styp", b"sidx")
_BOX_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 -_\xa9")

VALIDATORS: dict[str, Callable[[Scan, int], int | None]] = {
    "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "wav": _wav, "webp": _webp, "pdf": _pdf,
    "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg, "mp4": _mp4,
}

def machine() -> ahocorasick.Automaton:
    cache = worker_cache("media")
    if "magic" not in cache:
        made = ahocorasick.Automaton()
        for i, (_, _, magic, _) in enumerate(SIGNATURES):
            made.add_word(magic.decode("latin-1"), i)
        for name, mark in MARKS.items():
            made.add_word(mark.decode("latin-1"), name)
        made.make_automaton()
        cache["magic"] = made
    return cache["magic"]


def sniff(data: bytes | None) -> list[Found]:
    """The valid objects in ``data``, by offset; none begins inside another, but for those inside what begins at 0."""
    scan = Scan(data or b"")
    out: list[Found] = []
    end = 0
    for code in scan.hits:
        start, i = int(code) >> 8, int(code) & 255
        if start < end and start > 0:
            continue
        kind = SIGNATURES[i][0]
        length = scan.found(kind, start)
        if length:
            if start == 0 and out:
                continue
            out.append(Found(kind, start, length))
            end = start + length if start else 0
    return out


def corrected(declared: str | None, found: list[Found]) -> str | None:
    return TYPES[found[0].kind] if found and found[0].start == 0 else declared


def to_wav(payload: bytes) -> bytes:
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    chunk = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(form) + len(chunk)) + b"WAVE" + form + chunk


def from_wav(media: bytes) -> bytes:
    p = 12
    while p + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, p)
        if kind == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    p, parts, width = 8, [], 0
    while p + 12 <= len(media):
        n, kind = struct.unpack_from(">I4s", media, p)
        if kind == b"IHDR":
            width, _, depth, colour = struct.unpack_from(">IIBB", media, p + 8)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit grey is read")
        elif kind == b"IDAT":
            parts.append(media[p + 8 : p + 8 + n])
        p += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes()


READERS = {"wav": from_wav, "png": from_png}


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return len(data), data + FILLER * (size - len(data))


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """doc_id, n_bytes, declared and media of every row, written to the shared folder and read back."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for value in batch.column(1):
                n, payload = payload_of(value.as_py())
                sizes.append(n)
                media.append(to_png(payload) if zlib.crc32(payload) % 10 == 0 else to_wav(payload))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array([declared] * len(sizes), pa.string()), pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "declared", "media"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return written(docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, declared string, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and what the stored bytes tell: type, payload, carved objects, features."""
    bounded_batches(media.sparkSession)
    names = ["doc_id", "n_bytes", "media_type", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for declared, value in zip(batch.column("declared").to_pylist(), batch.column("media"), strict=True):
                data = value.as_py() or b""
                found = sniff(data)
                kind = corrected(declared, found)
                reader = READERS.get(found[0].kind) if found and found[0].start == 0 else None
                payload = reader(data[: found[0].length]) if reader else data
                samples = np.frombuffer(payload, np.uint8)
                carved = [f for f in found if f.start]
                said = f"type={kind};declared={declared};mean={samples.mean() if len(samples) else 0:.6f};std={samples.std() if len(samples) else 0:.6f};carved=" + ",".join(
                    f"{f.kind}@{f.start}+{f.length}" for f in carved
                )
                rows.append((kind, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), said))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names)

    kind = media.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, media_type string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, schema)


def carve(media: DataFrame, key: str, declared: str, data: str) -> DataFrame:
    """One row for each object found: key, media_type, start, length, bytes."""
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = value.as_py() or b""
                found = sniff(body)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k] * len(found), batch.column(0).type),
                        pa.array([TYPES[f.kind] for f in found], pa.string()),
                        pa.array([f.start for f in found], pa.int64()),
                        pa.array([f.length for f in found], pa.int64()),
                        pa.array([body[f.start : f.start + f.length] for f in found], pa.binary()),
                    ],
                    ["key", "media_type", "start", "length", "bytes"],
                )

    kind = media.select(key).schema[0].dataType.simpleString()
    return media.select(F.col(key).alias("key"), F.col(data).alias("data")).mapInArrow(run, f"key {kind}, media_type string, start bigint, length bigint, bytes binary")


def op7_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(documents(spark, sf_dir)))


QUERIES = {"op7_media_sniffing": op7_media_sniffing}
ORACLE_SQL: dict[str, str] = {}
