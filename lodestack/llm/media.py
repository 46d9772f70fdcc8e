"""AVI motion-JPEG: RIFF index parsing, baseline JPEG decoding of intra frames, and shot detection.

Frames of motion JPEG are independent, and so are the restart intervals within one, so decoding runs side by side: each
interval is a lane, and one step of the Huffman decoder advances every lane of a group of equal geometry by one symbol.
Frames are decoded in slices of a bounded number of pixels, of which only histograms are kept, so memory doesn't grow with
the length of a film.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- RIFF ----------------------------------------------------------------------------------------------------------


class Frames(Sequence):
    """The bytes of each video frame (empty for a dropped one), cut out of the file when they are asked for."""

    def __init__(self, raw: bytes, spans: list[tuple[int, int]]):
        self.raw, self.spans = raw, spans

    def __len__(self):
        return len(self.spans)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self.raw[s:e] for s, e in self.spans[i]]
        s, e = self.spans[i]
        return self.raw[s:e]

    def __eq__(self, other):
        return len(self) == len(other) and all(a == b for a, b in zip(self, other))

    __hash__ = None


class Video(NamedTuple):
    """Frame time in microseconds, size, and the frames."""

    frame_us: float
    width: int
    height: int
    frames: Sequence[bytes]
    indexed: bool


def _chunks(b: bytes, at: int, end: int):
    """(id, list type or b"", start of the data, end) of the chunks in a span; stops at a damaged one."""
    while at + 8 <= end:
        cid, n = b[at : at + 4], int.from_bytes(b[at + 4 : at + 8], "little")
        stop = min(at + 8 + n, end)
        if cid in (b"RIFF", b"LIST"):
            yield cid, b[at + 8 : at + 12], at + 12, stop
        else:
            yield cid, b"", at + 8, stop
        at += 8 + n + (n & 1)


def parse_avi(b: bytes | None) -> Video | None:
    """The first motion-JPEG stream of an AVI file; None if there is none.

    Frames come from the OpenDML indexes (indx, ix##) if the stream has sound ones. Else the first movi list is read by
    idx1, which covers no other, and later ones chunk by chunk, as is the first where idx1 is missing or points
    outside the file.
    """
    if not b or b[:4] != b"RIFF" or b[8:12] != b"AVI ":
        return None
    us, scale, rate, width, height, stream, n_streams = 0, 0, 0, 0, 0, None, 0
    movi: list[tuple[int, int]] = []
    idx1 = supers = None
    for cid, kind, s, e in _chunks(b, 0, len(b)):
        if cid != b"RIFF" or kind not in (b"AVI ", b"AVIX"):
            continue
        for c, k, s2, e2 in _chunks(b, s, e):
            if k == b"hdrl":
                for c3, k3, s3, e3 in _chunks(b, s2, e2):
                    if c3 == b"avih" and e3 - s3 >= 40:
                        us, width, height = *struct.unpack_from("<I", b, s3), *struct.unpack_from("<II", b, s3 + 32)
                    elif k3 == b"strl":
                        mine = False
                        for c4, _, s4, e4 in _chunks(b, s3, e3):
                            if c4 == b"strh" and e4 - s4 >= 28:
                                mine = stream is None and b[s4 : s4 + 4] == b"vids" and b[s4 + 4 : s4 + 8].upper() in (b"MJPG", b"AVRN", b"JPEG", b"\0\0\0\0")
                                if mine:
                                    stream = n_streams
                                    scale, rate = struct.unpack_from("<II", b, s4 + 20)
                            elif c4 == b"indx" and mine:
                                supers = _super_index(b, s4, e4)
                        n_streams += 1
            elif k == b"movi":
                movi.append((s2, e2))
            elif c == b"idx1" and idx1 is None:
                idx1 = (s2, e2)
    if stream is None or not movi:
        return None
    ids = {b"%02ddc" % stream, b"%02ddb" % stream}
    sound = lambda spans: spans and all(0 <= s <= e <= len(b) for s, e in spans)
    frames, rest = (supers, []) if sound(supers) else (_idx1(b, *idx1, movi[0][0], ids) if idx1 else None, movi[1:])
    indexed = bool(sound(frames))
    if not indexed:
        frames, rest = [], movi
    for s, e in rest:
        for c, k, s2, e2 in _chunks(b, s, e):
            for c3, _, s3, e3 in _chunks(b, s2, e2) if k == b"rec " else ((c, k, s2, e2),):
                if c3 in ids:
                    frames.append((s3, e3))
    return Video(1e6 * scale / rate if scale and rate else float(us or 40_000), width, height, Frames(b, frames), indexed)


def _idx1(b: bytes, s: int, e: int, movi: int, ids: set[bytes]):
    rows = np.frombuffer(b[s : e - (e - s) % 16], "<u4").reshape(-1, 4)
    rows = rows[np.isin(rows[:, 0], [int.from_bytes(x, "little") for x in ids])].astype(np.int64)
    if not len(rows):
        return None
    # offsets count from the list type of movi, or from the start of the file
    for base in (movi - 4, 0):
        if all(b[base + o : base + o + 4] in ids for o in rows[:3, 2]):
            return [(int(base + o + 8), int(base + o + 8 + n)) for o, n in rows[:, 2:]]
    return None


def _super_index(b: bytes, s: int, e: int):
    if e - s < 24:
        return None
    longs, _, kind, n = struct.unpack_from("<HBBI", b, s)
    if kind == 1:  # an index of chunks, at once
        return _standard_index(b, s, e)
    out = []
    for i in range(n if longs == 4 else 0):
        at = s + 24 + 16 * i
        if at + 16 > e:
            return None
        off, _, _ = struct.unpack_from("<QII", b, at)
        if off + 8 > len(b):
            return None
        size = int.from_bytes(b[off + 4 : off + 8], "little")
        got = _standard_index(b, off + 8, min(off + 8 + size, len(b)))
        if got is None:
            return None
        out += got
    return out or None


def _standard_index(b: bytes, s: int, e: int):
    if e - s < 24:
        return None
    longs, _, kind, n, _, base = struct.unpack_from("<HBBI4sQ", b, s)
    if kind != 1 or longs != 2 or s + 24 + 8 * n > e:
        return None
    rows = np.frombuffer(b[s + 24 : s + 24 + 8 * n], "<u4").reshape(-1, 2).astype(np.int64)
    return [(int(base + o), int(base + o + (k & 0x7FFFFFFF))) for o, k in rows]


def write_avi(frames: list[bytes], width: int, height: int, fps: int = 25, index: bool = True) -> bytes:
    """A motion-JPEG AVI file with an idx1 index (or none)."""
    body, idx = [], []
    at = 4
    for f in frames:
        idx.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        body.append(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1))
        at += len(body[-1])

    def chunk(cid: bytes, data: bytes) -> bytes:
        return cid + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)

    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10 if index else 0, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    out = b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(body)) + (chunk(b"idx1", b"".join(idx)) if index else b"")
    return chunk(b"RIFF", out)


# ---- JPEG ----------------------------------------------------------------------------------------------------------

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
LUMA_Q = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
_DC_LUMA = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
_DC_CHROMA = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC_LUMA = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
    bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
)
_AC_CHROMA = (
    bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
    bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"),
)
#: Motion JPEG may leave the Huffman tables out; these are then meant.
STANDARD = {(0, 0): _DC_LUMA, (0, 1): _DC_CHROMA, (1, 0): _AC_LUMA, (1, 1): _AC_CHROMA}
_C = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])

#: Pixels of a block from its coefficients in zigzag order.
_PIXELS = np.einsum("ky,lx->klyx", _C, _C).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _codes(table: tuple[bytes, bytes]) -> list[tuple[int, int, int]]:
    """(symbol, code, length)."""
    out, code, k = [], 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out.append((table[1][k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


#: Marks a value that doesn't lie within the 16 bits of a lookup.
_LONG = -(1 << 15)


def _lookup(table: tuple[bytes, bytes], dc: bool) -> np.ndarray:
    """By the next 16 bits: value << 16 | zeros before it << 8 | bits of code and value; 0 for what is no code.

    127 zeros end a block; the value is 0 where there is none and _LONG where it isn't within the 16 bits. Beside it, the
    bits of the value.
    """
    t = np.zeros((2, 1 << 16), np.int32)
    for symbol, code, length in _codes(table):
        run, size = (0, symbol) if dc else (symbol >> 4, symbol & 15)
        if dc and size > 11:
            continue
        if not dc and not size:
            run = 15 if run == 15 else 127
        own = np.arange(code << (16 - length), (code + 1) << (16 - length))
        if length + size > 16:
            v = np.full(len(own), _LONG)
        else:
            v = (own >> (16 - length - size)) & ((1 << size) - 1)
            v = np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)
        t[0, own], t[1, own] = v << 16 | run << 8 | length + size, size
    return t


_LOOKUPS: dict[tuple, np.ndarray] = {}


def _tables(pairs: tuple) -> np.ndarray:
    """The lookups of (dc, ac) tables, end to end."""
    if pairs not in _LOOKUPS:
        if len(_LOOKUPS) > 32:
            _LOOKUPS.clear()
        _LOOKUPS[pairs] = np.concatenate([_lookup(t, not k) for x in pairs for k, t in enumerate(x)], axis=1)
    return _LOOKUPS[pairs]


class Header(NamedTuple):
    width: int
    height: int
    components: tuple[tuple[int, int, tuple[int, ...], tuple[bytes, bytes], tuple[bytes, bytes]], ...]  # h, v, quantisation, dc, ac
    restart: int


def parse_jpeg(b: bytes) -> tuple[Header, bytes] | None:
    """Header and entropy-coded bytes of a baseline frame in one scan; None for anything else."""
    if b[:2] != b"\xff\xd8":
        return None
    at, quant, huff, frame, restart = 2, {}, dict(STANDARD), None, 0
    try:
        while at < len(b):
            if b[at] != 0xFF:
                return None
            m = b[at + 1]
            if m == 0xFF:
                at += 1
                continue
            n = int.from_bytes(b[at + 2 : at + 4], "big")
            d, at = b[at + 4 : at + 2 + n], at + 2 + n
            if m == 0xDB:
                while d:
                    wide, k = d[0] >> 4, d[0] & 15
                    quant[k] = tuple(np.frombuffer(d[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1").tolist())
                    d = d[1 + 64 * (1 + wide) :]
            elif m == 0xC4:
                while d:
                    total = sum(d[1:17])
                    huff[d[0] >> 4, d[0] & 15] = (bytes(d[1:17]), bytes(d[17 : 17 + total]))
                    d = d[17 + total :]
            elif m in (0xC0, 0xC1):
                if d[0] != 8:
                    return None
                h, w = struct.unpack(">HH", d[1:5])
                frame = (w, h, [(d[6 + 3 * i], d[7 + 3 * i] >> 4, d[7 + 3 * i] & 15, d[8 + 3 * i]) for i in range(d[5])])
            elif 0xC2 <= m <= 0xCF and m != 0xC8 and m != 0xCC:
                return None
            elif m == 0xDD:
                restart = int.from_bytes(d[:2], "big")
            elif m == 0xDA:
                if frame is None or d[0] != len(frame[2]):
                    return None
                picks = {d[1 + 2 * i]: d[2 + 2 * i] for i in range(d[0])}
                comps = tuple((h, v, quant[q], huff[0, picks[c] >> 4], huff[1, picks[c] & 15]) for c, h, v, q in frame[2])
                if not frame[0] or not frame[1] or any(len(c[2]) != 64 or not 1 <= c[0] <= 4 or not 1 <= c[1] <= 4 for c in comps):
                    return None
                if len(comps) == 1:
                    comps = ((1, 1, *comps[0][2:]),)
                return Header(frame[0], frame[1], comps, restart), b[at:]
            elif m == 0xD9:
                return None
    except (KeyError, IndexError, struct.error):
        return None
    return None


def _segments(scan: bytes) -> list[bytes]:
    """Restart intervals without stuffed zeros and markers."""
    end = scan.find(b"\xff\xd9")
    if end >= 0 and scan.count(b"\xff", 0, end) == scan.count(b"\xff\x00", 0, end):  # one interval
        return [scan[:end].replace(b"\xff\x00", b"\xff")]
    a = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero((a[:-1] == 255) & (a[1:] != 0)) if len(a) > 1 else np.zeros(0, int)
    out, start = [], 0
    for i in ff.tolist():
        if i < start or a[i + 1] == 255:
            continue
        out.append(scan[start:i].replace(b"\xff\x00", b"\xff"))
        start = i + 2
        if not 0xD0 <= a[i + 1] <= 0xD7:
            return out
    out.append(scan[start:].replace(b"\xff\x00", b"\xff"))
    return out


def _decode_lanes(data: list[bytes], plan: list[int], table: np.ndarray, mcus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (lane, block, 64) in zigzag order, and which lanes are sound.

    ``plan`` has the component of each block of an MCU, ``table`` the lookups of all components, ``mcus`` the number of
    MCUs of each lane. Every lane goes at its own pace, one symbol a step.
    """
    n, most, per = len(data), int(mcus.max()), len(plan)
    size = np.array([len(d) for d in data])
    raw = b"".join(d + b"\xff\xff\xff\xff" for d in data) + b"\xff" * 8
    words = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,)).astype(np.uint64)  # the 64 bits from each byte on
    p = (np.cumsum(size + 4) - size - 4) * 8
    last = p + 8 * size
    out = np.zeros(n * most * per * 64, np.int16)
    ok = np.ones(n, bool)
    dc = np.array(plan, np.int64) * (2 << 16)
    lane = np.arange(n)
    block, todo = np.zeros(n, np.int64), mcus * per
    o, at = lane * (most * per * 64), np.zeros(n, np.int64)
    base = np.full(n, dc[0])  # of the table of the symbol that comes next
    while len(lane):
        w = words[p >> 3] << (p & 7).astype(np.uint64)
        code = base + (w >> np.uint64(48)).astype(np.int64)
        e = table[0][code]
        v, bits = e >> 16, e & 255
        put = at + ((e >> 8) & 127)
        far = np.flatnonzero(v == _LONG)
        if len(far):
            s = table[1][code[far]]
            x = (w[far] >> (64 - bits[far]).astype(np.uint64)).astype(np.int64) & ((1 << s) - 1)
            v[far] = np.where(x < (1 << (s - 1)), x - (1 << s) + 1, x)
        out[o + np.minimum(put, 63)] = v  # a symbol without a value writes 0 where nothing is yet
        p += bits
        bad = (bits == 0) | (p > last) | (v != 0) & (put > 63)
        base = np.where(at == 0, base + (1 << 16), base)
        at = put + 1
        ended = np.flatnonzero(at > 63)
        if len(ended):
            block[ended] += 1
            o[ended] += 64
            at[ended] = 0
            base[ended] = dc[block[ended] % per]
        gone = bad.copy()
        gone[ended] |= block[ended] >= todo[ended]
        if gone.any():
            ok[lane[bad]] = False
            stay = ~gone
            lane, p, last, block, todo, o, at, base = (x[stay] for x in (lane, p, last, block, todo, o, at, base))
    out = out.reshape(n, most, per, 64)
    for c in set(plan):  # DC values are differences within a component
        k = [i for i, x in enumerate(plan) if x == c]
        d = out[:, :, k, 0].reshape(n, -1)
        out[:, :, k, 0] = np.cumsum(d, axis=1, dtype=np.int16).reshape(n, most, len(k))
    return out.reshape(n, most * per, 64), ok


#: Pixels decoded at a time, unless a single frame has more.
PIXELS_AT_ONCE = 1 << 22


def decode_planes(frames: Sequence[bytes], only_luma: bool = False, pixels: int = PIXELS_AT_ONCE) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(numbers of frames, planes of them all as uint8: frame, row, column), a bounded number of pixels at a time.

    Planes are luma, then chroma at its own resolution. Frames that can't be decoded don't occur.
    """
    groups: dict[Header, list[tuple[int, list[bytes]]]] = {}
    held, head, header = 0, b"", None
    for i, f in enumerate(frames):
        if not f:
            continue
        if header is None or not f.startswith(head):  # frames of one film mostly have one header
            got = parse_jpeg(f)
            if not got:
                continue
            header, head = got[0], f[: len(f) - len(got[1])]
        groups.setdefault(header, []).append((i, _segments(f[len(head) :])))
        held += header.width * header.height
        if held >= pixels:
            for h, members in groups.items():
                yield from _decode_group(h, members, only_luma)
            groups, held = {}, 0
    for h, members in groups.items():
        yield from _decode_group(h, members, only_luma)


def _decode_group(h: Header, members: list[tuple[int, list[bytes]]], only_luma: bool) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    hm, vm = max(c[0] for c in h.components), max(c[1] for c in h.components)
    across, down = -(-h.width // (8 * hm)), -(-h.height // (8 * vm))
    total = across * down
    each = h.restart or total
    cuts = np.minimum(each, total - np.arange(0, total, each))
    plan = [c for c, x in enumerate(h.components) for _ in range(x[0] * x[1])]
    members = [(i, s) for i, s in members if len(s) >= len(cuts)]
    if not members:
        return
    lanes = [d for _, s in members for d in s[: len(cuts)]]
    coef, ok = _decode_lanes(lanes, plan, _tables(tuple((x[3], x[4]) for x in h.components)), np.tile(cuts, len(members)))
    good = ok.reshape(len(members), -1).all(1)
    per = len(plan)
    coef = coef.reshape(len(members), len(cuts) * each * per, 64)[good, : total * per].reshape(-1, total, per, 64)
    n, first, planes = len(coef), 0, []
    for hc, vc, q, _, _ in h.components[: 1 if only_luma else None]:
        z = coef[:, :, first : first + hc * vc].reshape(-1, 64).astype(np.float32)
        first += hc * vc
        px = z @ (_PIXELS * np.array(q, np.float32)[:, None])
        px += 128.5
        px = np.clip(px, 0, 255, out=px).astype(np.uint8).reshape(n, down, across, vc, hc, 8, 8)
        px = px.transpose(0, 1, 3, 5, 2, 4, 6).reshape(n, down * vc * 8, across * hc * 8)
        planes.append(px[:, : -(-h.height * vc // vm), : -(-h.width * hc // hm)])
    yield [i for (i, _), g in zip(members, good) if g], planes


def decode_frames(frames: Sequence[bytes]) -> list[list[np.ndarray] | None]:
    """Planes of each frame; None for a frame that can't be decoded."""
    out: list[list[np.ndarray] | None] = [None] * len(frames)
    for numbers, planes in decode_planes(frames):
        for k, i in enumerate(numbers):
            out[i] = [p[k] for p in planes]
    return out


def encode_frames(images: np.ndarray, quality: int = 75, tables: bool = False) -> list[bytes]:
    """Baseline grey JPEG of each image (frame, height, width); sides are filled up to eights by the last pixels."""
    n, height, width = images.shape
    x = np.pad(images, ((0, 0), (0, -height % 8), (0, -width % 8)), "edge").astype(np.float32) - 128
    rows, cols = x.shape[1] // 8, x.shape[2] // 8
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    q = np.clip((LUMA_Q * scale + 50) // 100, 1, 255)
    z = np.rint(x.reshape(n, rows, 8, cols, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 64) @ (_PIXELS / q[ZIGZAG, None]).T.astype(np.float32)).astype(np.int32)
    per = rows * cols
    dc = z[:, 0].reshape(n, per)
    z[:, 0] = np.diff(dc, axis=1, prepend=0).ravel()
    codes = {k: np.zeros((256, 2), np.int64) for k in ("dc", "ac")}
    for k, t in (("dc", _DC_LUMA), ("ac", _AC_LUMA)):
        for symbol, code, length in _codes(t):
            codes[k][symbol] = code, length
    bits = lambda v: np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)
    blk, k = np.nonzero(z[:, 1:])
    k = k + 1
    v = z[blk, k].astype(np.int64)
    new = np.concatenate(([True], blk[1:] != blk[:-1])) if len(blk) else np.zeros(0, bool)
    run = k - np.where(new, 0, np.concatenate(([0], k[:-1]))) - 1 if len(blk) else k
    s = bits(v)
    sym = (run % 16) << 4 | s
    ac_code, ac_len = codes["ac"][sym].T
    ac_val = ac_code << s | np.where(v < 0, v + (1 << s) - 1, v)
    zrl = np.repeat(np.arange(len(blk)), run // 16)
    d = z[:, 0].astype(np.int64)
    ds = bits(d)
    dc_code, dc_len = codes["dc"][ds].T
    dc_val = dc_code << ds | np.where(d < 0, d + (1 << ds) - 1, d)
    tail = np.zeros(len(z), np.int64)
    np.maximum.at(tail, blk, k)
    eob = np.flatnonzero(tail < 63)
    b = np.concatenate((np.arange(len(z)), blk, blk[zrl], eob))
    order = np.concatenate((np.zeros(len(z), np.int64), 2 * k, 2 * k[zrl] - 1, np.full(len(eob), 200)))
    val = np.concatenate((dc_val, ac_val, np.full(len(zrl), codes["ac"][0xF0, 0]), np.full(len(eob), codes["ac"][0, 0])))
    length = np.concatenate((dc_len + ds, ac_len + s, np.full(len(zrl), codes["ac"][0xF0, 1]), np.full(len(eob), codes["ac"][0, 1])))
    at = np.argsort(b * 256 + order, kind="stable")
    val, length = val[at], length[at]
    frame = b[at] // per
    total = np.bincount(frame, length, n).astype(np.int64)
    room = -(-total // 8) * 8
    start = np.cumsum(length) - length + (np.cumsum(room - total) - (room - total))[frame]
    # codes of at most 27 bits at their places in words of 32, of which each touches two at most
    words = np.zeros(int(room.sum()) // 32 + 2, np.int64)
    wide = val << (64 - length - (start & 31) - 1)
    np.add.at(words, start >> 5, wide >> 31)
    np.add.at(words, (start >> 5) + 1, (wide & 0x7FFFFFFF) << 1)
    raw = bytearray(words.astype(">u4").tobytes())
    ends = np.cumsum(room // 8)
    for e, free in zip(ends.tolist(), (room - total).tolist()):
        if free:
            raw[e - 1] |= (1 << free) - 1  # ones fill up the last byte
    raw = bytes(raw)
    dht = b"".join(b"\xff\xc4" + struct.pack(">HB", 3 + 16 + len(t[1]), i) + t[0] + t[1] for i, t in ((0, _DC_LUMA), (16, _AC_LUMA))) if tables else b""
    head = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes(q[ZIGZAG].astype(np.uint8)) + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00" + dht + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    return [head + raw[e - r : e].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for e, r in zip(ends.tolist(), (room // 8).tolist())]


# ---- shots ---------------------------------------------------------------------------------------------------------

BINS = 32
RADIUS = 12
FACTOR = 4.0
LEAST = 0.15


def histograms(frames: Sequence[bytes], pixels: int = PIXELS_AT_ONCE) -> np.ndarray:
    """Share of luma in each bin, by frame; NaN for a frame that can't be decoded."""
    h = np.full((len(frames), BINS), np.nan)
    for numbers, (luma, *_) in decode_planes(frames, True, pixels):
        if not numbers:
            continue
        n, size = len(numbers), luma[0].size
        key = (luma >> 3).reshape(n, size) + np.arange(0, n * BINS, BINS, dtype=np.int32)[:, None]
        h[numbers] = np.bincount(key.ravel(), minlength=n * BINS).reshape(n, BINS) / size
    return h


def carried(h: np.ndarray) -> np.ndarray:
    """Histograms where a frame that couldn't be decoded repeats the one before (the first: the next)."""
    good = ~np.isnan(h[:, 0])
    if not good.any():
        return np.zeros_like(h)
    at = np.maximum.accumulate(np.where(good, np.arange(len(h)), -1))
    at[at < 0] = np.flatnonzero(good)[0]
    return h[at]


def cuts(h: np.ndarray, radius: int = RADIUS, factor: float = FACTOR, least: float = LEAST) -> np.ndarray:
    """First frames of new shots.

    The difference of neighbouring histograms (half the L1 distance) marks a cut where it is at least ``least``, and
    exceeds the median of the differences within ``radius`` frames by ``factor`` times their median absolute deviation
    from it, neither of which a few cuts can lift much.
    """
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    at = np.flatnonzero(d >= least)
    if not len(at):
        return at
    near = np.pad(d, radius, constant_values=np.nan)[at[:, None] + np.delete(np.arange(2 * radius + 1), radius)]
    mid = _row_medians(near)
    spread = _row_medians(np.abs(near - mid[:, None]))
    return at[d[at] > mid + factor * spread] + 1


def _row_medians(x: np.ndarray) -> np.ndarray:
    """Of each row without its NaNs; 0 if nothing else is in it."""
    if not x.shape[1]:
        return np.zeros(len(x))
    n = np.count_nonzero(~np.isnan(x), axis=1)
    x, r = np.sort(x, axis=1), np.arange(len(x))  # NaNs come last
    return np.where(n > 0, (x[r, np.maximum(n - 1, 0) // 2] + x[r, np.minimum(n // 2, x.shape[1] - 1)]) / 2, 0.0)


CLIP_SCHEMA = "clip int, first_frame int, last_frame int, start_ms double, end_ms double, n_undecoded int, width int, height int"


def detect_clips(media: DataFrame, *, id_col: str = "media_id", media_col: str = "media", radius: int = RADIUS, factor: float = FACTOR, least: float = LEAST) -> DataFrame:
    """One row a shot: media_id, clip (from 0), first_frame, last_frame, start_ms, end_ms, n_undecoded, width, height.

    Every frame of every file is decoded. Null or empty media, files that are no AVI, have no motion-JPEG stream or no
    frames have no rows. A damaged frame counts as undecoded and looks like the one before. Memory is that of the file and
    of one slice of frames, however long the film. Equal differences are cuts or not alike. Null ids and repeated rows are
    handled each. Other columns are ignored whatever their names; an empty table gives an empty result.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows, at = clips_of(b.column(1), radius, factor, least)
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.int32()] * 3
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["media_id", *(x.split()[0] for x in CLIP_SCHEMA.split(", "))])

    d = media.select(F.col(id_col).alias("media_id"), F.col(media_col).alias("media"))
    return d.mapInArrow(run, f"media_id {kind}, {CLIP_SCHEMA}")


#: Frames of several files whose bytes are decoded side by side; one long file goes in slices of pixels.
FRAMES_AT_ONCE = 4_000


def clips_of(column, radius: int = RADIUS, factor: float = FACTOR, least: float = LEAST, pixels: int = PIXELS_AT_ONCE) -> tuple[list[tuple], list[int]]:
    rows, at = [], []
    pending: list[tuple[int, Video]] = []

    def flush():
        k, all_h = 0, histograms(_Chain([v.frames for _, v in pending]), pixels)
        for i, v in pending:
            h = all_h[k : k + len(v.frames)]
            k += len(v.frames)
            lost = np.concatenate(([0], np.cumsum(np.isnan(h[:, 0])))).tolist()
            edges = [0, *cuts(carried(h), radius, factor, least).tolist(), len(h)]
            for c, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
                rows.append((c, s, e - 1, round(s * v.frame_us / 1000, 3), round(e * v.frame_us / 1000, 3), lost[e] - lost[s], v.width, v.height))
                at.append(i)
        pending.clear()

    for i, raw in enumerate(column):
        v = parse_avi(raw.as_py())
        if v and v.frames:
            pending.append((i, v))
            if sum(len(x.frames) for _, x in pending) >= FRAMES_AT_ONCE:
                flush()
    flush()
    return rows, at


class _Chain(Sequence):
    """The frames of several files, one after another."""

    def __init__(self, parts: list[Sequence[bytes]]):
        self.parts = parts

    def __len__(self):
        return sum(map(len, self.parts))

    def __iter__(self):
        for p in self.parts:
            yield from p

    def __getitem__(self, i):
        for p in self.parts:
            if i < len(p):
                return p[i]
            i -= len(p)
        raise IndexError


# ---- media from text, for tables that hold none --------------------------------------------------------------------

SIDE = 32


def render_turns(conv: list[list[str]]) -> list[bytes]:
    """One AVI file a conversation: each turn is a shot of 3 to 8 frames, a drifting pattern drawn from its text."""
    import hashlib

    x, y = np.meshgrid(np.arange(SIDE, dtype=np.int16), np.arange(SIDE, dtype=np.int16))
    shots, counts = [], []
    for turns in conv:
        k = 0
        level = 0
        for t in turns:
            d = hashlib.blake2b((t or "").encode(), digest_size=8).digest()
            level = (level + 64 + d[0] % 64) % 192
            n = 3 + len(t or "") % 6
            shots.append((n, level, d[1] % 5 + 1, d[2] % 5 + 1))
            k += n
        counts.append(k)
    if not shots:
        return [write_avi([], SIDE, SIDE) for _ in conv]
    n, level, across, down = np.array(shots, np.int16).T
    f = (np.arange(n.sum(dtype=np.int64)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)).astype(np.int16)
    level, across, down = (np.repeat(v, n) for v in (level, across, down))
    px = across[:, None] * x[0] + (across * f)[:, None]
    px = (down[:, None] * y[:, 0])[:, :, None] + px[:, None]
    px >>= 2
    px %= 48
    px += level[:, None, None]
    frames = encode_frames(px.astype(np.uint8))
    out, at = [], 0
    for k in counts:
        out.append(write_avi(frames[at : at + k], SIDE, SIDE))
        at += k
    return out


def render_conversations(conversations: DataFrame, buckets: int | None = None) -> DataFrame:
    """(media_id, media): a motion-JPEG file of every conversation, for tests and for tables without media."""
    from . import common as C

    c = conversations.select("conv_id", "turn", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = buckets or C.parts(C.measured(c)[1], 4 << 20)
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select(F.col("conv_id").alias("media_id"), F.col("t.text").alias("turns"))

    def run(batches):
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            yield pa.record_batch([b.column(0), pa.array(render_turns(b.column(1).to_pylist()), pa.binary())], names=["media_id", "media"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return c.repartition(n, "media_id").mapInArrow(run, f"media_id {kind}, media binary")
