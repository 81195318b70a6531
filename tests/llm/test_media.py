import hashlib
import io
import random
import struct
import time
import wave
import zipfile
import zlib

import pytest

from cellarium.llm import media as M

SCHEMA = "doc_id long, text string, media string, n_bytes int"
GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0?\0\x12\xff\0\x34\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + struct.pack("<iiHHIIiiII", 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
PDF = b"%PDF-1.4\n1 0 obj<<>>endobj\nstartxref\n9\n%%EOF"
GZIP = zlib.compressobj(9, zlib.DEFLATED, 31)
GZIP = GZIP.compress(b"hello" * 99) + GZIP.flush()
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 1) + struct.pack(">I4s", 8, b"moov")
OGG = b"OggS\0\4" + bytes(20) + b"\1\3abc"
FLAC = b"fLaC" + b"\x80\0\0\x22" + bytes(34) + b"\xff\xf8" + bytes(9)
PNG = M.to_png(bytes(range(256)) * 9)
WAV = M.to_wav(b"\x80" * 33)


def zipped():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "text" * 20)
    return b.getvalue()


OBJECTS = {"png": PNG, "gif": GIF, "jpeg": JPEG, "bmp": BMP, "wav": WAV, "pdf": PDF, "zip": zipped(), "gzip": GZIP, "mp4": MP4, "ogg": OGG, "flac": FLAC}


@pytest.mark.parametrize("kind", OBJECTS)
def test_types_and_lengths(kind):
    data = OBJECTS[kind]
    assert M.sniff(data)[0] == M.Found(kind, 0, len(data))
    assert M.corrected("text/plain", M.sniff(data)) == M.TYPES[kind]
    if kind != "flac":  # runs to the end of the bytes
        assert M.sniff(data + b"tail")[0] == M.Found(kind, 0, len(data))
        assert M.Found(kind, 5, len(data)) in M.sniff(b"head " + data + b" tail")


@pytest.mark.parametrize("kind", OBJECTS)
def test_truncated_objects_are_refused(kind):
    data = OBJECTS[kind]
    for n in {len(data) - 1, len(data) // 2, 5}:
        if kind != "flac" or n < 48:
            assert all(f.start or f.kind != kind for f in M.sniff(data[:n]))


def test_lying_structures_are_refused():
    broken = bytearray(PNG)
    broken[40] ^= 1
    assert M.sniff(bytes(broken)) == []
    assert M.sniff(b"RIFF\xff\xff\xff\x7fWAVEfmt ") == []
    assert M.sniff(b"\xff\xd8\xff" * 400) == M.sniff(b"GIF89a" * 400) == M.sniff(b"%PDF-" * 400) == M.sniff(None) == []


def test_common_forms():
    junk = b"RIFF" + struct.pack("<I", len(WAV) - 8 + 12) + b"WAVEJUNK" + struct.pack("<I", 4) + b"\0\0\0\0" + WAV[12:]
    assert M.sniff(junk) == [M.Found("wav", 0, len(junk))]
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    wide = struct.pack(">I4sQ", 1, b"mdat", 20) + b"data"
    for film in (box(b"ftyp", b"isom\0\0\0\1") + box(b"wide", b"") + box(b"moov", b"xy"), box(b"ftyp", b"isom") + wide + box(b"moov", b""), box(b"ftyp", b"isom") + box(b"moov", b"") + struct.pack(">I4s", 0, b"mdat") + b"to the end"):
        assert M.sniff(film) == [M.Found("mp4", 0, len(film))]
    two = zipped() + b"between" + zipped()
    assert M.sniff(b"." + two) == [M.Found("zip", 1, len(zipped())), M.Found("zip", 1 + len(zipped()) + 7, len(zipped()))]
    assert M.sniff(b"." + PDF + b"between" + PDF) == [M.Found("pdf", 1, len(PDF)), M.Found("pdf", 1 + len(PDF) + 7, len(PDF))]
    changed = PDF + b"\n2 0 obj<<>>endobj\nstartxref\n50\n%%EOF"
    assert M.sniff(b"." + changed) == [M.Found("pdf", 1, len(changed))]


HOSTILE = {
    **{f"{kind}-{magic[:4]!r}": bytes(offset) + magic for kind, _, magic, offset in M.SIGNATURES},
    "riff": b"RIFF\xff\xff\0\0WAVE",
    "png-chunks": b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + bytes(17) + b"\0\0\0\0abcd" + bytes(4),
    "zip-ends": b"PK\x03\x04PK\x05\x06",
    "pdf-ends": b"%PDF-%%EOF",
    "gzip": b"\x1f\x8b\x08\0\0\0\0\0\0\0\0\x04\0\xfb\xff" + bytes(4),
    "mp4": struct.pack(">I4s", 8, b"ftyp") + struct.pack(">I4s", 8, b"free"),
    "gif": b"GIF89a\x01\0\x01\0\0\0\0!\xf9\x01",
    "jpeg": b"\xff\xd8\xff\xc0\0\x04\0\0\xff\xda\0\x02",
    "ogg": b"OggS\0\0" + bytes(20) + b"\0",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_work_grows_with_the_bytes_alone(name):
    """Signatures without end: twice the bytes take about twice the time, and a real object behind them is found."""
    took = []
    for n in (400_000, 800_000, 1_600_000):
        data = HOSTILE[name] * (n // len(HOSTILE[name]))
        began = time.process_time()
        M.sniff(data)
        took.append(time.process_time() - began)
    assert took[2] < 12 * max(took[0], 0.05) and took[2] < 20
    found = M.sniff(b"." + HOSTILE[name] * 50 + b"\0" * 40 + PNG)
    assert any(f.kind == "png" for f in found) or found[0].start + found[0].length > 1000


def false_ones(kind, n):
    """``n`` signatures, from each of which a walk goes to the same ``n`` steps and fails behind them."""

    def jumps(unit, steps):
        return b"".join(unit(n - i - 1) for i in range(n)) + steps

    if kind == "png":
        return jumps(lambda left: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 16 * left, b"IHDR"), b"\0" * 4 + b"\0\0\0\0abcd\0\0\0\0" * n)
    if kind == "gif":
        return (b"GIF89a" + bytes(7) + b"!\xf9\x0f") * n
    if kind in ("wav", "webp"):
        form = {"wav": b"WAVEJUNK", "webp": b"WEBPVP8 "}[kind]
        return jumps(lambda left: struct.pack("<4sI8sI", b"RIFF", 20 * left + 12 + 8 * n + 20, form, 20 * left), b"JUNK\0\0\0\0" * n + b"JUNK\x64\0\0\0" + bytes(100))
    if kind == "zip":
        return b"PK\x03\x04" * n + (b"PK\x05\x06" + bytes(8) + b"\x01\0\0\0" + bytes(6)) * n
    if kind == "gzip":
        return jumps(lambda left: b"\x1f\x8b\x08" + bytes(8) + struct.pack("<HH", 15 * left % 65536, 65535 - 15 * left % 65536), b"\0\0\0\xff\xff" * n + b"\xff")
    if kind == "flac":
        return jumps(lambda left: b"fLaC\0\0\0\x22" + bytes(34) + b"\x01" + (46 * left).to_bytes(3, "big"), b"\x01\0\0\0" * n + b"\x80\0\0\0ab")
    if kind == "ogg":
        return (b"OggS\0\0" + bytes(21)) * 2 * n + b"OggS\0\0" + bytes(20) + b"\xff" * 256
    if kind == "mp4":
        return jumps(lambda left: struct.pack(">I4sI4s", 8, b"ftyp", 16 * left + 8, b"wide"), struct.pack(">I4s", 8, b"wide") * n + b"\0\0\0\0")
    raise KeyError(kind)


WEBP = b"RIFF" + struct.pack("<I", 14) + b"WEBPVP8 \2\0\0\0ab"
BEHIND = {"png": PNG, "gif": GIF, "wav": WAV, "webp": WEBP, "zip": zipped(), "gzip": GZIP, "flac": FLAC, "ogg": OGG, "mp4": MP4}


@pytest.mark.parametrize("kind", BEHIND)
def test_an_object_behind_false_ones_that_share_their_way(kind):
    """None is refused for the work of those before it, and that work doesn't grow by the square."""
    false = false_ones(kind, 3000) + bytes(70)
    assert M.sniff(false + BEHIND[kind]) == [M.Found(kind, len(false), len(BEHIND[kind]))]
    if kind != "gzip":
        data = false_ones(kind, 40_000)
        began = time.process_time()
        assert M.sniff(data) == []
        assert time.process_time() - began < 10


def test_gzip_heads():
    body = GZIP[10:]
    for flags, more in ((4, b"\3\0abc"), (8, b"name\0"), (24, b"name" * 3000 + b"\0note\0"), (1, b"")):
        head = b"\x1f\x8b\x08" + bytes([flags]) + bytes(6) + more
        summed = head[:3] + bytes([flags | 2]) + head[4:]
        for one in (head, summed + struct.pack("<H", zlib.crc32(summed) & 0xFFFF)):
            assert M.sniff(b"." + one + body + b"tail") == [M.Found("gzip", 1, len(one + body))]
        assert M.sniff(summed + b"ab" + body) == M.sniff(head + body[:-1]) == M.sniff(head + body[:-8] + bytes(8)) == []


def test_sums_of_ranges(monkeypatch):
    monkeypatch.setattr(M, "PLAIN_SUM", 8)
    monkeypatch.setattr(M, "SUM_STEP", 16)
    rng = random.Random(8)
    for n in (0, 9, 64, 1000, 100_000):
        data = rng.randbytes(n)
        s = M.Scan(data)
        for _ in range(40):
            a, b = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
            assert s.crc(a, b) == zlib.crc32(data[a:b])


def test_long_riff_forms():
    """Beyond the chunks that are walked one by one: fmt and data at either end, none, and an end inside a chunk."""
    one = lambda kind, body=b"": kind + struct.pack("<I", len(body)) + body
    junk = one(b"JUNK") * 500
    for chunks, good in ((one(b"fmt ") + junk + one(b"data"), True), (junk + one(b"data") + one(b"fmt "), True), (one(b"data") + junk, False), (junk, False)):
        for cut in (0, 4):
            body = b"WAVE" + chunks + one(b"JUNK", b"12345678" if cut else b"")
            data = b"RIFF" + struct.pack("<I", len(body) - cut) + body + one(b"fmt ") + one(b"data")
            assert M.sniff(data) == ([M.Found("wav", 0, 8 + len(body))] if good and not cut else [])


def plain_jpeg(d, at):
    """The JPEG at ``at``, walked alone, or None."""
    p, frame = at + 2, False
    while d[p : p + 1] == b"\xff" and len(d) - p >= 4:
        if d[p + 1] == 0xD9:
            break
        n = d[p + 2] * 256 + d[p + 3]
        if d[p + 1] < 0xC0 or d[p + 1] == 0xFF or n < 2:
            return None
        frame = frame or d[p + 1] in (0xC0, 0xC1, 0xC2)
        scan = d[p + 1] == 0xDA
        p += 2 + n
        while scan and p + 1 < len(d) and (d[p] != 0xFF or d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7):
            p += 1
    return p + 2 - at if frame and d[p : p + 2] == b"\xff\xd9" else None


def test_jpeg_like_walks_of_their_own():
    rng = random.Random(5)
    parts = [b"\xff\xd8\xff\xc0\0\x04\0\0", b"\xff\xda\0\x02", b"\xff\xd8", b"\xff\xd9", b"\xff\0", b"\xff\xd3", b"\xff", b"\xff\xe0\0\x08", b"\xff\xc2\0\x02", b"ab"]
    seen = 0
    for _ in range(400):
        data = b"".join(rng.choices(parts, k=rng.randrange(60)))
        s = M.Scan(data)
        starts = [i for i in range(len(data)) if data[i : i + 3] == b"\xff\xd8\xff"]
        want = [plain_jpeg(data, i) for i in starts]
        assert [s.found("jpeg", i) for i in starts] == want
        seen += sum(w is not None for w in want)
    assert seen > 100


def test_a_jpeg_behind_a_million_false_ones():
    """No walk of before is in its way, however many there were."""
    real = b"\xff\xd8\xff\xc0\0\x04\0\0\xff\xda\0\x02abc\xff\xd9"
    false = (b"\xff\xd8\xff\xe0\0\x02" * 1_000_000) + b"\0" * 70_000
    assert M.sniff(false + real) == [M.Found("jpeg", len(false), len(real))]


def test_carving():
    body = b"x" * 7 + GIF + b"--" + PNG + b"--" + zipped() + b"end"
    found = M.sniff(M.to_wav(body))
    assert [(f.kind, f.start) for f in found] == [("wav", 0), ("gif", 51), ("png", 51 + len(GIF) + 2), ("zip", 51 + len(GIF) + len(PNG) + 4)]
    # What lies inside a carved object is not carved again.
    inside = M.to_wav(GIF)
    assert [f.kind for f in M.sniff(b"abc" + inside + b"z")] == ["wav"]


def test_containers_are_standard():
    payload = bytes(random.Random(1).randbytes(1152))
    with wave.open(io.BytesIO(M.to_wav(payload))) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.readframes(9999)) == (1, 1, payload)
    assert M.from_wav(M.to_wav(payload)) == M.from_png(M.to_png(payload)) == payload


def test_query_columns(spark):
    texts = [None, "", "x", "é" * 288, "y" * 577, "RIFF WAVEfmt GIF89a %PDF- PK\x03\x04 BM", "long " * 50000, "same", "same", *[f"text {i}" for i in range(40)]]
    df = spark.createDataFrame([(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)
    out = M.features(M.store(df)).collect()
    assert len(out) == len(texts)
    by = {(i if i != 3 else None): t for i, t in enumerate(texts)}
    kinds = set()
    for r in out:
        raw = (by[r.doc_id] or "").encode()
        payload = raw + b"\xff" * ((max(1, -(-len(raw) // 576)) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        kinds.add(r.media_type)
    assert kinds == {"audio/wav", "image/png"}
    same = [tuple(r)[1:] for r in out if r.doc_id in (7, 8)]
    assert same[0] == same[1]
    assert M.features(M.store(df.limit(0))).count() == 0


def test_carved_rows(spark):
    df = spark.createDataFrame([(1, "text/plain", bytearray(b"abc" + PNG + b"def")), (2, "image/png", None), (3, "image/png", bytearray(GIF))], "id int, kind string, body binary")
    out = M.carve(df, "id", "kind", "body").collect()
    assert sorted((r.key, r.media_type, r.start, bytes(r.bytes)) for r in out) == [(1, "image/png", 3, PNG), (3, "image/gif", 0, GIF)]
