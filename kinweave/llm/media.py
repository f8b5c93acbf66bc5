"""Media columns: AVI files of motion JPEG.

Frames are written as JPEGs of the lossless process (SOF3, 8-bit gray, predictor 1), so samples come back exactly. The Huffman table gives difference class s a code of 9 - s bits; with its s further bits every
sample takes 9 bits, and whole frames are coded and decoded by array operations. Frames of others are decoded bit by bit: lossless ones with any table and predictor, and baseline (DCT) ones of any
sampling and restart interval, of which the first component (the luminance) is returned. Tables that a frame leaves out are those of the frame before it, or the standard's.

Files are read through their RIFF structure: header list, stream headers, movie list (with its `rec ` lists) and the idx1 index (without an index the movie list is walked). Of several streams the
first video stream is read. Shots are cut where the histogram difference of two frames is far
above its neighbourhood's: over the mean by some standard deviations of the window around it, and over a floor. Clips are the frames between cuts, with times.

Defined results: null and empty texts give one frame of filler; equal texts give equal files and features; a file of one frame is one clip; a file with no frame has no clip. read_avi and the
decoders raise ValueError for what is broken; read() and clips() then give the row with an error text and nulls, or no clip, and go on; so with a null file.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import map_batches

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
BITS = 9


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


#: Codes by length: one each of 1 to 9 bits, for classes 8 to 0.
_TABLE = bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
_HEAD = b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(0xC4, _TABLE) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
_TAIL = b"\xff\xd9"


@lru_cache(1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits (511, 9) of each difference from -255 on, and the difference of each 9-bit code."""
    bits, back = np.zeros((511, BITS), np.uint8), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1  # 8 - s ones and a zero
        code = prefix << s | (d if d > 0 else d + (1 << s) - 1 if d < 0 else 0)
        bits[d + 255] = [code >> (BITS - 1 - k) & 1 for k in range(BITS)]
        back[code] = d
    return bits, back


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """Lossless JPEGs of (n, SIDE, SIDE) uint8 samples."""
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    bits = _codes()[0][d.reshape(-1) + 255]
    raw = np.packbits(bits.reshape(len(x), -1), axis=1).tobytes()
    size = FRAME * BITS // 8
    return [_HEAD + raw[i * size : (i + 1) * size].replace(b"\xff", b"\xff\x00") + _TAIL for i in range(len(x))]


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray] | np.ndarray:
    """(height, width) samples of each frame."""
    if jpegs and all(j.startswith(_HEAD) for j in jpegs):
        raw = b"".join([j[len(_HEAD) : -2].replace(b"\xff\x00", b"\xff") for j in jpegs])
        if len(raw) != len(jpegs) * FRAME * BITS // 8:
            raise ValueError("a frame's data is cut short")
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS)
        code = (bits[:, 0].astype(np.uint16) << 8) | np.packbits(bits[:, 1:], axis=1)[:, 0]
        d = _codes()[1][code].reshape(-1, SIDE, SIDE).copy()
        d[:, 0, 0] += 128
        d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
        return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8)
    tables = Tables()
    return [decode_frame(j, tables) for j in jpegs]


#: Fixed values of the JPEG standard: the Huffman tables that a motion-JPEG frame uses if it brings none, each as its codes' counts by length and its symbols.
_STANDARD = {
    0x00: ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: (
        "00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d",
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a "
        "53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 "
        "c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
    0x11: (
        "00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77",
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a "
        "53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 "
        "c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
}


def _codebook(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Symbols by (length, code); codes count up from length to length."""
    if len(symbols) < sum(counts):
        raise ValueError("a table is cut short")
    code, k, table = 0, 0, {}
    for length, c in enumerate(counts, 1):
        for _ in range(c):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _standard() -> dict[int, dict[tuple[int, int], int]]:
    return {which: _codebook(bytes.fromhex(counts), bytes.fromhex(symbols)) for which, (counts, symbols) in _STANDARD.items()}


@dataclass
class Tables:
    """Huffman tables, by class (0 DC or lossless, 1 AC) and number, quantisation tables by number, and the restart interval."""

    codes: dict[int, dict[tuple[int, int], int]] = field(default_factory=_standard)
    steps: dict[int, np.ndarray] = field(default_factory=dict)
    restart: int = 0


class _Bits:
    """The bits of a scan, stuffed bytes taken out, restart interval by restart interval."""

    def __init__(self, data: bytes):
        self.parts, at, begin = [], 0, 0
        while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
            if 0xD0 <= data[at + 1] <= 0xD7:
                self.parts.append(data[begin:at])
                begin = at + 2
            elif data[at + 1] == 0xD9:
                data = data[:at]
                break
            at += 2
        self.parts.append(data[begin:])
        self.next()

    def next(self) -> None:
        """Go to the next interval."""
        if not self.parts:
            raise ValueError("a frame's data is cut short")
        part = self.parts.pop(0).replace(b"\xff\x00", b"\xff")
        self.left = len(part) * 8
        self.bits = bin(int.from_bytes(b"\x01" + part, "big"))[3:]
        self.at = 0

    def take(self, k: int) -> int:
        self.at += k
        if self.at > self.left:
            raise ValueError("a frame's data is cut short")
        return int(self.bits[self.at - k : self.at], 2) if k else 0

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code, length = self.take(1), 1
        while (length, code) not in table:
            code, length = code << 1 | self.take(1), length + 1
            if length > 16:
                raise ValueError("no such code")
        return table[length, code]

    def signed(self, s: int) -> int:
        v = self.take(s) if 0 < s < 16 else 0
        return 32768 if s == 16 else v if not s or v >> (s - 1) else v - (1 << s) + 1


#: Places of coefficients in the order in which they are coded: along the diagonals of the 8 x 8 block, their directions alternating.
_ZIGZAG = [y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]
_COSINES = np.array([[(0.5 if u else 0.5 / 2**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def _segments(jpeg: bytes, tables: Tables) -> tuple[int, bytes, bytes, bytes]:
    """Marker and body of the frame header, body of the scan header, and the scan's data; tables on the way are taken in."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, kind, frame = 2, 0, b""
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 255:
            raise ValueError("broken JPEG markers")
        if jpeg[at + 1] == 255:  # a fill byte
            at += 1
            continue
        marker, n = jpeg[at + 1], struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC4:
            while len(body) >= 17:
                end = 17 + sum(body[1:17])
                tables.codes[body[0]], body = _codebook(body[1:17], body[17:end]), body[end:]
        elif marker == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                if len(body) <= size:
                    raise ValueError("a table is cut short")
                steps = np.zeros(64)
                steps[_ZIGZAG] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8)
                tables.steps[which], body = steps, body[1 + size :]
        elif marker == 0xDD:
            tables.restart = struct.unpack(">H", body[:2])[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            kind, frame = marker, body
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("neither of the baseline nor of the lossless process")
        elif marker == 0xDA:
            break
    if len(frame) < 6:
        raise ValueError("no frame header")
    return kind, frame, body, jpeg[at:]


def decode_frame(jpeg: bytes, tables: Tables | None = None) -> np.ndarray:
    """Samples of a JPEG: of a lossless one of one component with any table and predictor 1 to 7, or of the first component of a baseline one."""
    tables = tables or Tables()
    kind, frame, scan, data = _segments(jpeg, tables)
    try:
        return _lossless(frame, scan, data, tables) if kind == 0xC3 else _baseline(frame, scan, data, tables)
    except (KeyError, IndexError, struct.error) as e:
        raise ValueError("a header or a table is missing") from e


def _lossless(frame: bytes, scan: bytes, data: bytes, tables: Tables) -> np.ndarray:
    depth, height, width, parts = struct.unpack(">BHHB", frame[:6])
    if parts != 1:
        raise ValueError("more than one component")
    table, predictor, shift = tables.codes[scan[2] >> 4], scan[3], scan[5] & 15
    if not 1 <= predictor <= 7:
        raise ValueError("no such predictor")
    bits, out = _Bits(data), np.zeros((height, width), np.int32)
    for y in range(height):
        for x in range(width):
            a, b, c = (int(out[y, x - 1]) if x else 0), (int(out[y - 1, x]) if y else 0), (int(out[y - 1, x - 1]) if x and y else 0)
            p = 1 << (depth - shift - 1) if not x and not y else a if not y else b if not x else {1: a, 2: b, 3: c, 4: a + b - c, 5: a + (b - c >> 1), 6: b + (a - c >> 1), 7: a + b >> 1}[predictor]
            out[y, x] = (p + bits.signed(bits.symbol(table))) & 0xFFFF
    return (out << shift).astype(np.uint8)


def _baseline(frame: bytes, scan: bytes, data: bytes, tables: Tables) -> np.ndarray:
    depth, height, width, n = struct.unpack(">BHHB", frame[:6])
    if depth != 8 or not height or not width:
        raise ValueError("not of 8 bits, or empty")
    parts = {frame[6 + 3 * k]: (frame[7 + 3 * k] >> 4, frame[7 + 3 * k] & 15, frame[8 + 3 * k]) for k in range(n)}
    chosen = [(scan[1 + 2 * k], scan[2 + 2 * k]) for k in range(scan[0])]
    if scan[0] == 1:  # not interleaved: a unit is one block of the component
        parts = {i: (1, 1, q) for i, (_, _, q) in parts.items() if i == chosen[0][0]}
    across, down = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    first, (h0, v0, q0) = chosen[0][0], parts[chosen[0][0]]
    blocks = np.zeros((rows * v0, columns * h0, 64))
    bits, before = _Bits(data), dict.fromkeys(parts, 0)
    for unit in range(rows * columns):
        if tables.restart and unit and unit % tables.restart == 0:
            bits.next()
            before = dict.fromkeys(parts, 0)
        for i, which in chosen:
            h, v, _ = parts[i]
            dc, ac = tables.codes[which >> 4], tables.codes[16 | (which & 15)]
            for k in range(h * v):
                before[i] += bits.signed(bits.symbol(dc))
                block = blocks[unit // columns * v + k // h, unit % columns * h + k % h] if i == first else np.zeros(64)
                block[0], at = before[i], 1
                while at < 64:
                    symbol = bits.symbol(ac)
                    run, size = symbol >> 4, symbol & 15
                    if not size and run < 15:
                        break
                    at += run
                    if size:
                        block[_ZIGZAG[at]] = bits.signed(size)
                    at += 1
    blocks *= tables.steps[q0]
    pixels = np.einsum("yu,rcuv,xv->ryc" + "x", _COSINES, blocks.reshape(rows * v0, columns * h0, 8, 8), _COSINES)
    out = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).reshape(rows * v0 * 8, columns * h0 * 8)
    return out[: -(-height * v0 // down), : -(-width * h0 // across)]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: np.ndarray, fps: int = FPS) -> bytes:
    jpegs = encode_frames(frames)
    largest, n = max(map(len, jpegs), default=0), len(jpegs)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    movie, index, at = [b"movi"], [], 4
    for j in jpegs:
        c = _chunk(b"00dc", j)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        movie.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def _lists(media: bytes, at: int, stop: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Kind, list kind (for lists), begin and end of the body of each chunk between at and stop."""
    while at + 8 <= stop:
        kind, n = struct.unpack("<4sI", media[at : at + 8])
        is_list = kind in (b"LIST", b"RIFF")
        yield kind, media[at + 8 : at + 12] if is_list else b"", at + (12 if is_list else 8), min(at + 8 + n, stop)
        at += 8 + n + (n & 1)


def read_avi(media: bytes) -> tuple[list[bytes], float]:
    """The first video stream's JPEGs and the frames per second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie = index = stream = None
    fps, seen = float(FPS), 0
    for kind, name, a, b in _lists(media, 12, min(len(media), 8 + struct.unpack("<I", media[4:8])[0])):
        if name == b"hdrl":
            for _, inner, c, d in _lists(media, a, b):
                if inner == b"strl":
                    for k, _, e, f in _lists(media, c, d):
                        if k == b"strh" and stream is None and media[e : e + 4] == b"vids" and f - e >= 28:
                            scale, rate = struct.unpack("<II", media[e + 20 : e + 28])
                            stream, fps = seen, rate / scale if scale else fps
                    seen += 1
        elif name == b"movi":
            movie = movie or (a - 4, b)
        elif kind == b"idx1":
            index = media[a:b]
    if movie is None:
        raise ValueError("no movie list")
    if stream is None:
        raise ValueError("no video stream")
    own = (b"%02ddc" % stream, b"%02ddb" % stream)
    if index:
        entries = [e for e in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if e[0] in own]
        base = movie[0] if entries and media[movie[0] + entries[0][2] :][:4] == entries[0][0] else 0  # offsets from the list or from the file's begin
        for _, _, offset, n in entries:
            if base + offset + 8 + n > len(media):
                raise ValueError("the index points beyond the file")
        return [media[base + offset + 8 : base + offset + 8 + n] for _, _, offset, n in entries], fps
    out, todo = [], [(movie[0] + 4, movie[1])]
    while todo:
        for kind, name, a, b in _lists(media, *todo.pop(0)):
            if name == b"rec ":
                todo.append((a, b))
            elif kind in own:
                out.append(media[a:b])
    return out, fps


def differences(frames: list[np.ndarray] | np.ndarray, bins: int = 64) -> np.ndarray:
    """Half the L1 distance of the normalised histograms of each frame and the one before; 0 for the first."""
    n = len(frames)
    if not n:
        return np.zeros(0)
    shift = 8 - bins.bit_length() + 1
    if isinstance(frames, np.ndarray):
        level = frames.reshape(n, -1) >> shift
        flat = level.astype(np.int64) + np.arange(n)[:, None] * bins
        h = np.bincount(flat.ravel(), minlength=n * bins).reshape(n, bins)
        return np.concatenate(([0.0], np.abs(np.diff(h, axis=0)).sum(1) / (2 * level.shape[1])))
    h = np.stack([np.bincount(f.ravel() >> shift, minlength=bins) / max(1, f.size) for f in frames])
    return np.concatenate(([0.0], np.abs(np.diff(h, axis=0)).sum(1) / 2))


def cuts(d: np.ndarray, reach: int = 8, factor: float = 2.0, floor: float = 0.2) -> np.ndarray:
    """First frames of shots: 0, and those whose difference passes mean + factor * deviation of the window of reach frames to either side, and the floor."""
    n = len(d)
    if n < 2:
        return np.arange(n)
    one, two = np.concatenate(([0.0], np.cumsum(d[1:]))), np.concatenate(([0.0], np.cumsum(d[1:] ** 2)))
    t = np.arange(1, n)
    a, b = np.maximum(t - 1 - reach, 0), np.minimum(t + reach, n - 1)
    mean = (one[b] - one[a]) / (b - a)
    deviation = np.sqrt(np.maximum((two[b] - two[a]) / (b - a) - mean**2, 0))
    return np.concatenate(([0], t[(d[1:] > mean + factor * deviation + 1e-12) & (d[1:] >= floor)]))


def payload(text: bytes | None) -> bytes:
    """text, filled with bytes 255 up to a positive multiple of a frame's samples."""
    raw = text or b""
    return raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


def store(docs: DataFrame, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The columns keep, n_bytes (of the text) and media (an AVI file that holds the text's payload)."""
    kept = docs.select(*keep, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text_col).cast("binary").alias("__kw_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = [write_avi(np.frombuffer(payload(t), np.uint8).reshape(-1, SIDE, SIDE)) for t in batch.column(len(keep) + 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    return map_batches(kept, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["media binary"]), run)


def clips_of(media: bytes) -> list[tuple[int, int, int, float, float, float]]:
    """(clip, first frame, end frame, start seconds, end seconds, difference at its cut) of a file."""
    jpegs, fps = read_avi(media)
    return _clips(differences(decode_frames(jpegs)), fps)


def _clips(d: np.ndarray, fps: float) -> list[tuple[int, int, int, float, float, float]]:
    first = cuts(d)
    return [(i, int(a), int(b), a / fps, b / fps, float(d[a])) for i, (a, b) in enumerate(zip(first, np.append(first[1:], len(d)), strict=True))]


_CLIP = "struct<clip: int, first_frame: int, end_frame: int, start_s: double, end_s: double, difference: double>"
_CLIP_TYPE = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("difference", pa.float64())])
_NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "error"]


def _judged(m: bytes | None) -> tuple:
    if m is None:
        return (*[None] * 7, "no file")
    try:
        jpegs, fps = read_avi(m)
        frames = decode_frames(jpegs)
    except ValueError as e:
        return (None, None, None, len(m), hashlib.sha256(m).hexdigest(), None, None, str(e))
    raw = frames.tobytes() if isinstance(frames, np.ndarray) else b"".join([f.tobytes() for f in frames])
    d = differences(frames)
    mean = float(np.frombuffer(raw, np.uint8).mean()) if raw else 0.0
    feature = f"frames={len(d)};cuts={','.join(map(str, cuts(d).tolist()))};peak={d.max(initial=0):.6f};mean={mean:.6f}"
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, [dict(zip((f.name for f in _CLIP_TYPE), c, strict=True)) for c in _clips(d, fps)], None


def read(rows: DataFrame, *, media_col: str = "media", keep: list[str]) -> DataFrame:
    """Of each row's file: keep, payload_bytes, payload_sha256 and tail_crc32 (of the samples read back), media_bytes, media_sha256, feature (frames, cuts and the largest difference), clips (timed) and error (null if
    the file could be read)."""
    kept = rows.select(*keep, F.col(media_col).alias("__kw_media"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_judged(m.as_py()) for m in batch.column(len(keep))]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_CLIP_TYPE), pa.string()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], [*keep, *_NAMES])

    types = ["bigint", "string", "bigint", "bigint", "string", "string", f"array<{_CLIP}>", "string"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"{n} {t}" for n, t in zip(_NAMES, types, strict=True)])
    return map_batches(kept, schema, run)


def clips(rows: DataFrame, *, media_col: str = "media", keep: list[str]) -> DataFrame:
    """One row per clip of each row's file (none for a null or broken one): keep, clip, first_frame, end_frame, start_s, end_s, difference."""
    found = read(rows, media_col=media_col, keep=keep).select(*keep, F.explode("clips").alias("__kw_clip"))
    return found.select(*keep, "__kw_clip.*")
