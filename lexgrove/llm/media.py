"""Media columns: storing bytes in media files, and sniffing what a file really is.

`store` wraps a payload of 8-bit samples losslessly in one of four formats.
`sniff` finds every magic number of the known formats in one Aho-Corasick pass over
the bytes, and each format's validator walks the structure behind it and confirms its
length; a file's type is the valid medium that begins at its first byte, whatever its
declared type says, and valid media that begin elsewhere are carved as embedded.
`samples` reads the payload back.  What a validator must look for in the rest of a file
(end records, marks, chains of blocks) is found once for the file, so that work grows
with its bytes and not with its magic numbers times its bytes.

A null or empty file is `unknown` without embedded media.  Bytes that no validator
confirms are no medium, even behind a right magic number.  Spans are offsets and
lengths in bytes; an embedded medium inside another embedded one is not reported again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache, cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from . import textkernel as K
from .columns import every, numbered_names, small_batches, texts_of

UNIT = 64
RATE = 8000

# Magic numbers of the formats.
MAGIC = {
    b"RIFF": "wav",
    b"BM": "bmp",
    b"\x89PNG\r\n\x1a\n": "png",
    b".snd": "au",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"\xff\xd8\xff": "jpeg",
    b"PK\x03\x04": "zip",
    b"%PDF-": "pdf",
}
STORED = ("wav", "bmp", "png", "au")


def padded(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of UNIT."""
    return text + b"\0" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def store(payload: bytes, kind: str) -> bytes:
    """A wav (8-bit mono), bmp or png (8-bit grey, UNIT wide) or au (8-bit linear) file of the payload."""
    n = len(payload)
    if kind == "wav":
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload
    if kind == "au":
        return b".snd" + struct.pack(">IIIII", 24, n, 2, RATE, 1) + payload
    rows = n // UNIT
    if kind == "bmp":
        head = 14 + 40 + 1024
        palette = (np.arange(256, dtype=np.uint32) * 0x010101).astype("<u4").tobytes()
        return b"BM" + struct.pack("<IHHI", head + n, 0, 0, head) + struct.pack("<IiiHHIIiiII", 40, UNIT, -rows, 1, 8, 0, n, 2835, 2835, 256, 0) + palette + payload
    lines = np.zeros((rows, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


#: Bytes of a stretch of a file that has a sum of its own.
STRETCH = 4096
#: The CRC polynomial, bits reversed.
_POLY = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
        if not vector:
            break
    return out


@cache
def _zeros(power: int) -> list[int]:
    """What 2**power zero bytes do to a CRC register, as a matrix over bits."""
    if power == 0:
        one = [_POLY] + [1 << n for n in range(31)]  # a zero bit
        for _ in range(3):
            one = [_times(one, row) for row in one]
        return one
    half = _zeros(power - 1)
    return [_times(half, row) for row in half]


def _joined(first: int, whole: int, size: int) -> int:
    """The CRC of the last size bytes of what has the sum whole, if what is before them has the sum first."""
    for power in range(size.bit_length()):
        if size >> power & 1:
            first = _times(_zeros(power), first)
    return whole ^ first


class Chunks:
    """Chains of RIFF chunks; each place is walked once, and jumps find a chain's last chunk before an end."""

    def __init__(self, data: bytes, odd: int):
        self.data, self.odd = data, odd
        #: place -> (next place, a place further on, chunks to the chain's end, first fmt and first data from here on)
        self.held: dict[int, tuple[int, int, int, int, int]] = {}

    def _walk(self, p: int) -> None:
        b, path, far = self.data, [], len(self.data) + 1
        while p + 8 <= len(b) and p not in self.held:
            path.append(p)
            p += 8 + struct.unpack_from("<I", b, p + 4)[0]
            p += (p - self.odd) % 2
        none = (far, far, 0, far, far)
        for q in reversed(path):
            name = b[q : q + 4]
            _, jump, deep, form, sound = self.held.get(p, none)
            there = self.held.get(jump, none)
            # a jump twice as long where the last two were equally long
            further = there[1] if deep - there[2] == there[2] - self.held.get(there[1], none)[2] and deep else p
            self.held[q] = (p, further, deep + 1, q if name == b"fmt " else form, q if name == b"data" else sound)
            p = q

    def last(self, p: int, most: int) -> tuple[int, bool, bool] | None:
        """(the last chunk at or before a place of the chain from p, whether a fmt and a data chunk come up to it)."""
        if p > most or p + 8 > len(self.data):
            return None
        self._walk(p)
        _, _, _, form, sound = self.held[p]
        while True:
            after, jump, _, _, _ = self.held[p]
            if jump <= most and jump in self.held:
                p = jump
            elif after <= most and after in self.held:
                p = after
            else:
                return p, form <= p, sound <= p


class File:
    """A file's bytes, with what validators find out once for all magic numbers in it."""

    def __init__(self, data: bytes):
        self.data = data
        self._ends: dict[int, tuple[int, bool]] = {}
        self._blocks: dict[int, int] = {}
        self._riffs: dict[int, Chunks] = {}
        self._pngs: dict[int, tuple[int, bool]] = {}
        self._sums = [0]

    @cached_property
    def zips(self) -> dict[int, int]:
        """Where archives begin and how long they are: an end record tells where its archive begins."""
        b, out = self.data, {}
        end = b.find(b"PK\x05\x06")
        while 0 <= end <= len(b) - 22:
            size, start, note = struct.unpack_from("<IIH", b, end + 12)
            at = end - size - start
            if at >= 0 and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
                out.setdefault(at, end + 22 + note - at)
            end = b.find(b"PK\x05\x06", end + 1)
        return out

    def places(self, mark: bytes) -> list[int]:
        if mark not in self.__dict__:
            out, at = [], self.data.find(mark)
            while at >= 0:
                out.append(at)
                at = self.data.find(mark, at + 1)
            self.__dict__[mark] = out
        return self.__dict__[mark]

    def after(self, mark: bytes, at: int) -> int:
        """The first place of a mark from a place on, or -1."""
        held = self.places(mark)
        n = bisect_left(held, at)
        return held[n] if n < len(held) else -1

    def before(self, mark: bytes, at: int) -> int:
        """The last place of a mark before a place, or -1."""
        held = self.places(mark)
        n = bisect_left(held, at)
        return held[n - 1] if n else -1

    def riff(self, odd: int) -> Chunks:
        """The chunks of files that begin at even or odd places (pad bytes differ)."""
        if odd not in self._riffs:
            self._riffs[odd] = Chunks(self.data, odd)
        return self._riffs[odd]

    def crc(self, a: int, b: int) -> int:
        """CRC-32 of the bytes from a to b, from sums kept for whole stretches."""
        if b - a <= 2 * STRETCH:
            return zlib.crc32(memoryview(self.data)[a:b])
        return _joined(self._crc_to(a), self._crc_to(b), b - a)

    def _crc_to(self, p: int) -> int:
        n = p // STRETCH
        while len(self._sums) <= n:
            k = len(self._sums)
            self._sums.append(zlib.crc32(memoryview(self.data)[(k - 1) * STRETCH : k * STRETCH], self._sums[-1]))
        return zlib.crc32(memoryview(self.data)[n * STRETCH : p], self._sums[n])

    def png_body(self, p: int) -> tuple[int, bool]:
        """(behind the IEND of the chunks that begin at p, whether an IDAT is among them); -1 where they do not hold."""
        b, path, found = self.data, [], (-1, False)
        while p + 12 <= len(b):
            if p in self._pngs:
                found = self._pngs[p]
                break
            n, name = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
            path.append((p, n, name))
            p += 12 + n
            if p > len(b) or name == b"IHDR":
                break
            if name == b"IEND":
                found = (p, False)
                break
        for q, n, name in reversed(path):  # sums only where the structure holds
            whole = found[0] >= 0 and self.crc(q + 4, q + 8 + n) == struct.unpack_from(">I", b, q + 8 + n)[0]
            found = (found[0], found[1] or name == b"IDAT") if whole else (-1, False)
            self._pngs[q] = found
        return found

    def gif_blocks(self, p: int) -> int:
        """Behind the sub-blocks that begin at p; each place is walked once for the file."""
        b, path = self.data, []
        while p < len(b) and b[p] and p not in self._blocks:
            path.append(p)
            p += 1 + b[p]
        end = self._blocks.get(p, p + 1)
        self._blocks.update(dict.fromkeys(path, end))
        return end

    def gif_body(self, p: int) -> tuple[int, bool]:
        """(behind the trailer of the blocks that begin at p, whether an image is among them); -1 if there is none."""
        b, path, found = self.data, [], (-1, False)
        while p < len(b):
            if p in self._ends:
                found = self._ends[p]
                break
            if b[p] == 0x3B:
                found = (p + 1, False)
                break
            path.append((p, b[p] == 0x2C))
            if b[p] == 0x21:
                p = self.gif_blocks(p + 2)
            elif b[p] == 0x2C and p + 10 <= len(b):
                local = b[p + 9]
                p = self.gif_blocks(p + 10 + (3 << ((local & 7) + 1) if local & 128 else 0) + 1)
            else:
                break
        for at, image in reversed(path):
            found = (found[0], found[1] or image)
            self._ends[at] = found
        return found


def _wav(file: File, at: int) -> int | None:
    b = file.data
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    last = file.riff(at & 1).last(at + 12, end - 8) if end <= len(b) else None
    if last is None:
        return None
    p, form, sound = last
    ends = p + 8 + struct.unpack_from("<I", b, p + 4)[0]
    # a pad byte follows an odd chunk, but not the one that ends the file
    return end - at if end in (ends, ends + (ends - at) % 2) and form and sound else None


def _au(file: File, at: int) -> int | None:
    b = file.data
    if len(b) < at + 24:
        return None
    head, size, coding, rate, channels = struct.unpack_from(">5I", b, at + 4)
    fits = 24 <= head <= 1 << 16 and 1 <= coding <= 27 and rate and 1 <= channels <= 255 and at + head + size <= len(b)
    return head + size if fits else None


#: Sizes of bitmap headers that begin alike.
BMP_HEADERS = (40, 52, 56, 108, 124)


def _bmp(file: File, at: int) -> int | None:
    b = file.data
    if len(b) < at + 54:
        return None
    size, _, _, start, head, width, height, planes, depth, packing, pixels = struct.unpack_from("<IHHIIiiHHII", b, at + 2)
    if head not in BMP_HEADERS or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or packing not in (0, 3) or width <= 0 or not height:
        return None
    line = (width * depth + 31) // 32 * 4
    return size if start >= 14 + head and start + line * abs(height) <= size and at + size <= len(b) and pixels in (0, line * abs(height)) else None


def _png(file: File, at: int) -> int | None:
    b, p = file.data, at + 8
    if b[p : p + 8] != b"\0\0\0\x0dIHDR" or len(b) < p + 25 or file.crc(p + 4, p + 21) != struct.unpack_from(">I", b, p + 21)[0]:
        return None
    end, image = file.png_body(p + 25)
    return end - at if end > 0 and image else None


def _gif(file: File, at: int) -> int | None:
    b = file.data
    if len(b) < at + 13:
        return None
    flags = b[at + 10]
    end, image = file.gif_body(at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
    return end - at if end > 0 and image else None


def _jpeg(file: File, at: int) -> int | None:
    b, p, frame = file.data, at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        if not 0xC0 <= kind <= 0xFE or kind in (0xD8, 0xD9):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if kind == 0xDA:
            while frame:
                p = b.find(b"\xff", p)
                if p < 0 or p + 2 > len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return None


def _zip(file: File, at: int) -> int | None:
    return file.zips.get(at)


def _pdf(file: File, at: int) -> int | None:
    """Up to the last end mark before the next file's head: files that grow, or begin with an index, have several."""
    begin, following = file.after(b"startxref", at), file.after(b"%PDF-", at + 5)
    end = file.before(b"%%EOF", following if following >= 0 else len(file.data))
    return end + 5 - at if 0 <= begin < end and file.data[at + 5 : at + 8].replace(b".", b"0").isdigit() else None


VALIDATORS: dict[str, Callable[[File, int], int | None]] = {"wav": _wav, "bmp": _bmp, "png": _png, "au": _au, "gif": _gif, "jpeg": _jpeg, "zip": _zip, "pdf": _pdf}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def sniff(data: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """(type, length, embedded media as (type, offset, length)) of a file's bytes."""
    kind, length, embedded, past = "unknown", 0, [], 0
    file = File(data)
    hits = sorted({(end - size + 1, name) for end, (name, size) in _automaton().iter(data.decode("latin-1"))})
    for at, name in hits:
        if at < past:
            continue
        n = VALIDATORS[name](file, at)
        if n is None:
            continue
        if at == 0:
            kind, length = name, n
        else:
            embedded.append((name, at, n))
            past = at + n
    return kind, length, embedded


def samples(data: bytes, kind: str) -> bytes | None:
    """The 8-bit samples of a valid file that has one channel of them, row by row; None of any other."""
    reader = {"wav": _wav_samples, "au": _au_samples, "bmp": _bmp_samples, "png": _png_samples}.get(kind)
    return reader(data) if reader else None


#: The wav coding that tells its own further on.
EXTENSIBLE = 0xFFFE


def _wav_samples(data: bytes) -> bytes | None:
    p, form = 12, None
    while p + 8 <= len(data):
        name, n = data[p : p + 4], struct.unpack_from("<I", data, p + 4)[0]
        if name == b"fmt " and n >= 16:
            coding, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", data, p + 8)
            if coding == EXTENSIBLE and n >= 40:  # the coding is in the identifier
                coding = struct.unpack_from("<H", data, p + 32)[0]
            form = coding, channels, bits
        elif name == b"data":
            return data[p + 8 : p + 8 + n] if form == (1, 1, 8) else None
        p += 8 + n + n % 2
    return None


def _au_samples(data: bytes) -> bytes | None:
    head, size, coding, _, channels = struct.unpack_from(">5I", data, 4)
    return data[head : head + size] if (coding, channels) == (2, 1) else None


def _bmp_samples(data: bytes) -> bytes | None:
    start, width, height, depth, packing = *struct.unpack_from("<I", data, 10), *struct.unpack_from("<ii", data, 18), *struct.unpack_from("<HI", data, 28)
    if depth != 8 or packing:
        return None
    line = (width + 3) // 4 * 4
    lines = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, :width]
    return (lines if height < 0 else lines[::-1]).tobytes()


def _png_samples(data: bytes) -> bytes | None:
    width, rows, depth, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
    if depth != 8 or colour or interlaced or not width or not rows:
        return None
    p, packed = 8, []
    while data[p + 4 : p + 8] != b"IEND":
        n = struct.unpack_from(">I", data, p)[0]
        if data[p + 4 : p + 8] == b"IDAT":
            packed.append(data[p + 8 : p + 8 + n])
        p += 12 + n
    size = rows * (width + 1)
    if size > 1100 * sum(map(len, packed)) + 64:  # more than deflate can hold
        return None
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), size)
    except zlib.error:
        return None
    return _unfiltered(np.frombuffer(raw, np.uint8).reshape(rows, width + 1)) if len(raw) == size else None


def _unfiltered(lines: np.ndarray) -> bytes | None:
    """PNG rows of one byte a sample, each with its filter's number first; None for an unknown filter."""
    kinds = lines[:, 0]
    if not kinds.any():
        return lines[:, 1:].tobytes()
    out = np.zeros((len(lines) + 1, lines.shape[1]), np.uint8)  # a row and a column of zeros before
    for y, (kind, row) in enumerate(zip(kinds.tolist(), lines[:, 1:]), 1):
        above = out[y - 1]
        if kind == 0:
            out[y, 1:] = row
        elif kind == 1:
            out[y, 1:] = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            out[y, 1:] = row + above[1:]
        elif kind in (3, 4):
            left, corner, line = 0, 0, []
            for x, up in zip(row.tolist(), above[1:].tolist()):
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    away = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = left if away[0] <= away[1] and away[0] <= away[2] else up if away[1] <= away[2] else corner
                left, corner = (x + guess) & 255, up
                line.append(left)
            out[y, 1:] = line
        else:
            return None
    return out[1:, 1:].tobytes()


def _store(batches: Iterator[pa.RecordBatch], at: int, skip: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, at):
            out = []
            for text in part.column(at).to_pylist():
                raw = (text or "").encode()
                check = zlib.crc32(raw)
                # the declared type is wrong for a quarter of the texts
                kind = STORED[check % 4]
                declared = STORED[check // 4 % 4] if check // 16 % 3 == 0 else kind
                out.append((len(raw), declared, store(padded(raw), kind)))
            n, declared, media = zip(*out)
            yield pa.RecordBatch.from_arrays([*part.columns[skip:], pa.array(n, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], [*part.schema.names[skip:], "n_bytes", "declared", "media"])


def stored(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, with n_bytes, a declared type (not always right) and the media file of each whole text."""
    rows, schema, at, skip = texts_of(docs, keep)
    return rows.mapInArrow(partial(_store, at=at, skip=skip), StructType(list(schema)).add("n_bytes", "long").add("declared", "string").add("media", "binary")).toDF(*keep, "n_bytes", "declared", "media")


SEEN = "kind string, media_length long, corrected boolean, embedded array<struct<kind:string,offset:bigint,length:bigint>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, mean double, spread double, peak int"


def _seen(data: bytes, declared: str | None) -> tuple:
    kind, length, embedded = sniff(data)
    payload = samples(data, kind)
    values = np.frombuffer(payload or b"", np.uint8)
    seen = np.bincount(values, minlength=256)
    total = max(1, len(values))
    mean = float(seen @ np.arange(256)) / total
    spread = float(np.sqrt(max(0.0, seen @ np.arange(256) ** 2 / total - mean * mean)))
    told = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]))
    measured = (None,) * 3 if payload is None else (mean, spread, int(values.max(initial=0)))
    spans = [dict(zip(("kind", "offset", "length"), x)) for x in embedded]
    return (kind, length, kind != declared, spans, *told, len(data), hashlib.sha256(data).hexdigest(), *measured)


def _inspect(batches: Iterator[pa.RecordBatch], kinds: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, 0):
            out = [_seen(data or b"", declared) for data, declared in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], *(pa.array(list(c), k) for c, (_, k) in zip(zip(*out), kinds))], [*part.schema.names[2:], *(name for name, _ in kinds)])


def inspected(media: DataFrame) -> DataFrame:
    """All columns but the media bytes, with what sniffing and reading the file back shows.

    payload_bytes and what follows from the samples is null where a file has no single
    channel of 8-bit samples.
    """
    rest = [c for c in media.columns if c != "media"]
    rows = numbered_names(small_batches(media).select(F.col("media").cast("binary"), F.col("declared").cast("string"), *every(rest)))
    new = StructType.fromDDL(SEEN)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in new]
    return rows.mapInArrow(partial(_inspect, kinds=kinds), StructType(rows.schema.fields[2:] + new.fields)).toDF(*rest, *new.names)
