"""Media columns by signature sniffing.

A payload of bytes is kept without loss as a media file: 8-bit mono WAV or AU samples,
an 8-bit grey BMP or a binary PGM image. Reading starts from nothing but the bytes: an
Aho-Corasick automaton finds the magic numbers of the known formats, format validators
confirm structure and lengths at each place, the type that fits the whole corrects the
declared one, and valid media inside another file's payload is carved out. Validators know the
usual sample widths and depths; a payload is the samples' bytes as they stand.

Defined cases: null text counts as empty; a payload is padded with bytes 255 to a
positive multiple of ``unit``; equal texts give equal files; bytes that no validator
accepts have type null; ids may be null or repeat; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, small_batches, store

KINDS = ("wav", "au", "pgm", "bmp")
#: Rows of images are this long; a multiple of 4 keeps BMP rows unpadded.
WIDTH = 24

# Magic bytes and where they stand in their format.
MAGICS = {b"RIFF": ("wav", 0), b".snd": ("au", 0), b"P5\n": ("pgm", 0), b"P5 ": ("pgm", 0), b"P5\t": ("pgm", 0), b"P5\r": ("pgm", 0), b"P5#": ("pgm", 0), b"BM": ("bmp", 0), b"\x89PNG\r\n\x1a\n": ("png", 0), b"GIF87a": ("gif", 0), b"GIF89a": ("gif", 0), b"\xff\xd8\xff": ("jpeg", 0)}


# Bytes a sample of the codes of AU files (mu-law, linear of 8 to 32 bits, float, double, A-law).
AU_WIDTHS = {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 4, 7: 8, 27: 1}

#: Numbers of a PGM header, parted by white space and comments; one white space ends it.
PGM = re.compile(rb"P5" + 3 * rb"(?:[ \t\r\n]|#[^\r\n]{0,200}[\r\n])+([0-9]{1,9})" + rb"[ \t\r\n]")


def encode(kind: str, payload: bytes) -> bytes:
    """The payload as the samples or pixels of a file of this kind."""
    n = len(payload)
    if kind == "wav":
        odd = n & 1
        return b"RIFF" + struct.pack("<I", 36 + n + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * odd
    if kind == "au":
        return b".snd" + struct.pack(">5I", 24, n, 2, 8000, 1) + payload
    if n % WIDTH:
        raise ValueError(f"an image's payload must be a multiple of {WIDTH} bytes")
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (WIDTH, n // WIDTH) + payload
    if kind == "bmp":
        palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
        at = 14 + 40 + len(palette)
        return b"BM" + struct.pack("<IHHI", at + n, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, WIDTH, -(n // WIDTH), 1, 8, 0, n, 2835, 2835, 256, 0) + palette + payload
    raise ValueError(kind)


@dataclass(frozen=True)
class Found:
    """A confirmed file: its type, place, the place of its payload, and its size in samples or pixels."""

    kind: str
    start: int
    end: int
    data_start: int
    data_end: int
    shape: str


def _wav(b: bytes, at: int) -> Found | None:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    chunk, form = at + 12, None
    while chunk + 8 <= min(end, len(b)):
        name, size = b[chunk : chunk + 4], struct.unpack_from("<I", b, chunk + 4)[0]
        if chunk + 8 + size > min(end, len(b)):
            return None
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", b, chunk + 8)
        elif name == b"data" and form:
            code, channels, rate, per_second, frame, bits = form
            usual = (code in (1, 0xFFFE) and bits in (8, 16, 24, 32)) or (code == 3 and bits in (32, 64)) or (code in (6, 7) and bits == 8)
            ok = usual and channels > 0 and rate > 0 and frame == channels * bits // 8 and per_second == rate * frame and size % frame == 0 and end <= len(b)
            return Found("wav", at, end, chunk + 8, chunk + 8 + size, f"{size // frame}@{rate}") if ok else None
        chunk += 8 + size + (size & 1)
    return None


def _au(b: bytes, at: int) -> Found | None:
    if len(b) < at + 24:
        return None
    head, size, code, rate, channels = struct.unpack_from(">5I", b, at + 4)
    frame = AU_WIDTHS.get(code, 0) * channels
    size = len(b) - at - head if size == 0xFFFFFFFF else size  # a stream's length isn't stated
    ok = head >= 24 and frame and 1 <= channels <= 8 and 0 < rate <= 768_000 and 0 <= size <= len(b) - at - head and size % frame == 0
    return Found("au", at, at + head + size, at + head, at + head + size, f"{size // frame}@{rate}") if ok else None


def _pgm(b: bytes, at: int) -> Found | None:
    head = PGM.match(b, at)
    if not head:
        return None
    w, h, top = (int(x) for x in head.groups())
    size = w * h * (1 if top < 256 else 2)
    data = head.end()
    return Found("pgm", at, data + size, data, data + size, f"{w}x{h}") if size and 0 < top < 65_536 and data + size <= len(b) else None


def _bmp(b: bytes, at: int) -> Found | None:
    if len(b) < at + 54:
        return None
    size, r1, r2, data, info, w, h, planes, depth, packed = struct.unpack_from("<IHHIIiiHHI", b, at + 2)
    rows = (w * depth + 31) // 32 * 4 * abs(h) if w > 0 else 0
    plain = (packed == 0 and depth in (1, 4, 8, 16, 24, 32)) or (packed == 3 and depth in (16, 32))
    ok = not r1 and not r2 and info >= 40 and planes == 1 and plain and rows > 0 and data >= 14 + info and data + rows <= size and at + size <= len(b)
    return Found("bmp", at, at + size, at + data, at + data + rows, f"{w}x{abs(h)}") if ok else None


def _png(b: bytes, at: int) -> Found | None:
    chunk, first = at + 8, None
    while chunk + 12 <= len(b):
        size = struct.unpack_from(">I", b, chunk)[0]
        if chunk + 12 + size > len(b) or zlib.crc32(b[chunk + 4 : chunk + 8 + size]) != struct.unpack_from(">I", b, chunk + 8 + size)[0]:
            return None
        name = b[chunk + 4 : chunk + 8]
        if first is None:
            if name != b"IHDR" or size != 13:
                return None
            first = struct.unpack_from(">II", b, chunk + 8)
        chunk += 12 + size
        if name == b"IEND":
            return Found("png", at, chunk, at, chunk, f"{first[0]}x{first[1]}")
    return None


def _gif(b: bytes, at: int) -> Found | None:
    if len(b) < at + 13:
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return Found("gif", at, p + 1, at, p + 1, f"{w}x{h}") if w and h else None
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 10 + (3 << ((local & 7) + 1) if local & 128 else 0) + 1)
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> Found | None:
    p, shape = at + 2, ""
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, size = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if size < 2 or p + 2 + size > len(b):
            return None
        if 0xC0 <= mark <= 0xC2 and size >= 8:
            h, w = struct.unpack_from(">HH", b, p + 5)
            shape = f"{w}x{h}"
        p += 2 + size
        if mark == 0xDA:
            end = b.find(b"\xff\xd9", p)
            return Found("jpeg", at, end + 2, at, end + 2, shape) if end >= 0 and shape else None
    return None


VALID = {"wav": _wav, "au": _au, "pgm": _pgm, "bmp": _bmp, "png": _png, "gif": _gif, "jpeg": _jpeg}


class Sniffer:
    """The automaton over all magic bytes, built once a task."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, (kind, shift) in MAGICS.items():
            self.automaton.add_word(magic.decode("latin-1"), (kind, shift + len(magic) - 1))
        self.automaton.make_automaton()

    def places(self, data: bytes) -> list[tuple[int, str]]:
        """Where a file might start, in order."""
        return [(end - back, kind) for end, (kind, back) in self.automaton.iter(data.decode("latin-1"))]

    def sniff(self, data: bytes) -> tuple[Found | None, list[Found]]:
        """The file that the bytes are, if any, and the files carved out of it (or of loose bytes), left to right."""
        whole, carved, free = None, [], 0
        for at, kind in sorted(self.places(data)):
            if at < free or (found := VALID[kind](data, at)) is None:
                continue
            if at == 0 and found.end == len(data):
                whole = found
                continue
            carved.append(found)
            free = found.end
        return whole, carved


def padded(text: bytes, unit: int = 576, fill: int = 255) -> bytes:
    size = max(1, -(-len(text) // unit)) * unit
    return text + bytes([fill]) * (size - len(text))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576) -> DataFrame:
    """doc_id, n_bytes, media and a declared type. The kind follows from the payload; the declared type is only a hint and may be wrong."""
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            n, media, declared = [], [], []
            for text in as_bytes(batch.column(1)):
                payload = padded(text, unit)
                code = zlib.crc32(payload)
                n.append(len(text))
                media.append(encode(KINDS[code % 4], payload))
                declared.append(KINDS[code // 4 % 4])
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(declared, pa.string())], ["doc_id", "n_bytes", "media", "declared"])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(write, f"doc_id {id_type}, n_bytes long, media binary, declared string")


def read_media(media: DataFrame) -> DataFrame:
    """Sniffs every file of ``to_media`` and reads its payload back: type, payload digests and features."""
    small_batches(media.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in slices(batches, 256):
            rows = []
            for data, declared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = data or b""
                whole, carved = sniffer.sniff(data)
                payload = data[whole.data_start : whole.data_end] if whole else b""
                kind = whole.kind if whole else None
                samples = np.frombuffer(payload, np.uint8)
                total, peak = int(samples.sum(dtype=np.int64)), int(samples.max(initial=0))
                feature = f"{kind or 'unknown'};{whole.shape if whole else ''};sum={total};peak={peak};carved={len(carved)}"
                rows.append((kind, kind != declared, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, [f"{x.kind}:{x.start}:{x.end}" for x in carved]))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
            names = ["doc_id", "n_bytes", "kind", "corrected", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "carved"]
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    id_type = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "n_bytes", "media", "declared").mapInArrow(read, f"doc_id {id_type}, n_bytes long, kind string, corrected boolean, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, carved array<string>")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576) -> DataFrame:
    """Stores every text as a media file in the shared folder, reads the files back and describes them."""
    return read_media(store(to_media(docs, id_col, text_col, unit), "media"))
