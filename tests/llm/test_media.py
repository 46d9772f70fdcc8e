"""AVI and JPEG: round trips, damaged files, shots against planted cuts."""

import struct

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import media as M


def images(n=5, h=21, w=37, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return np.array([(x * (k + 1) + y * 2) % 200 + rng.integers(0, 20, (h, w)) for k in range(n)]).astype(np.uint8)


def reference_decode(raw):
    """One frame, symbol by symbol, in plain Python."""
    head, scan = M.parse_jpeg(raw)
    data = b"".join(M._segments(scan))
    bits = "".join(f"{b:08b}" for b in data) + "1" * 64
    dc, ac = ({(c, n): s for s, c, n in M._codes(t)} for t in head.components[0][3:5])
    q = np.array(head.components[0][2])
    at, pred, blocks = 0, 0, []

    def symbol(table):
        nonlocal at
        for n in range(1, 17):
            s = table.get((int(bits[at : at + n], 2), n))
            if s is not None:
                at += n
                return s
        raise ValueError

    def value(n):
        nonlocal at
        v = int(bits[at : at + n], 2) if n else 0
        at += n
        return v - (1 << n) + 1 if n and v < 1 << (n - 1) else v

    across, down = -(-head.width // 8), -(-head.height // 8)
    for _ in range(across * down):
        z = np.zeros(64)
        pred += value(symbol(dc))
        z[0], k = pred, 1
        while k < 64:
            s = symbol(ac)
            if s == 0:
                break
            k += 16 if s == 0xF0 else s >> 4
            if s != 0xF0:
                z[k] = value(s & 15)
                k += 1
        nat = np.zeros(64)
        nat[M.ZIGZAG] = z * q
        blocks.append(np.clip(np.rint(M._C.T @ nat.reshape(8, 8) @ M._C + 128), 0, 255))
    out = np.array(blocks).reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
    return out[: head.height, : head.width]


@pytest.mark.parametrize("quality", [30, 75, 95])
@pytest.mark.parametrize("tables", [False, True])
def test_jpeg_against_plain_decoder(quality, tables):
    x = images()
    frames = M.encode_frames(x, quality, tables)
    for f, got, want in zip(frames, M.decode_frames(frames), x):
        assert np.abs(got[0].astype(int) - reference_decode(f)).max() <= 1
        assert np.abs(got[0].astype(int) - want).mean() < 12


def test_restart_intervals_and_colour():
    """A 4:2:0 frame put together from grey scans: 4 luma blocks and two chroma blocks an MCU, one MCU a restart interval."""
    def block_bits(dc):
        n = int(abs(dc)).bit_length()
        code = {s: (c, k) for s, c, k in M._codes(M._DC_LUMA)}[n]
        v = dc if dc >= 0 else dc + (1 << n) - 1
        eob = {s: (c, k) for s, c, k in M._codes(M._AC_LUMA)}[0]
        return f"{code[0]:0{code[1]}b}" + (f"{v:0{n}b}" if n else "") + f"{eob[0]:0{eob[1]}b}"

    def mcu(y, cb, cr):
        bits = block_bits(y) + block_bits(0) * 3 + block_bits(cb) + block_bits(cr)
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    q = bytes([8] * 64)
    head = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + q + b"\xff\xdd\0\4\0\1" + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 16, 32, 3) + b"\1\x22\0\2\x11\0\3\x11\0" + b"\xff\xda" + struct.pack(">HB", 12, 3) + b"\1\0\2\0\3\0\0\x3f\0"
    raw = head + mcu(10, -5, 7) + b"\xff\xd0" + mcu(-20, 0, 3) + b"\xff\xd9"
    y, cb, cr = M.decode_frames([raw])[0]
    assert y.shape == (16, 32) and cb.shape == cr.shape == (8, 16)
    assert (y[:, :16] == 138).all() and (y[:, 16:] == 108).all() and (cb[:, :8] == 123).all() and (cr[:, 8:] == 131).all()


def test_damaged_frames():
    good = M.encode_frames(images(2))
    cut = good[0][: len(good[0]) // 2]
    progressive = good[0].replace(b"\xff\xc0", b"\xff\xc2")
    got = M.decode_frames([good[0], b"", b"junk", cut, progressive, good[1], good[0][:30]])
    assert [g is not None for g in got] == [True, False, False, False, False, True, False]


@pytest.mark.parametrize("index", [True, False])
def test_avi_round_trip(index):
    frames = M.encode_frames(images(7))
    v = M.parse_avi(M.write_avi(frames, 37, 21, 10, index))
    assert v.frames == frames and (v.width, v.height, v.frame_us, v.indexed) == (37, 21, 100_000, index)
    for bad in (None, b"", b"RIFF", b"RIFF\0\0\0\0WAVE", M.write_avi([], 8, 8)[:100]):
        assert M.parse_avi(bad) is None
    raw = bytearray(M.write_avi(frames, 37, 21))
    at = raw.rfind(b"idx1")
    struct.pack_into("<I", raw, at + 8 + 12, 1 << 30)
    assert M.parse_avi(bytes(raw)).frames == frames  # the index points outside, the chunks are walked


def test_open_dml_index():
    frames = M.encode_frames(images(4))
    raw = M.write_avi(frames, 37, 21, index=False)
    at, offs = 0, []
    for f in frames:
        at = raw.index(b"00dc", at)
        offs.append((at + 8, len(f)))
        at += 8
    std = struct.pack("<HBBI4sQI", 2, 0, 1, 4, b"00dc", 0, 0) + b"".join(struct.pack("<II", *o) for o in offs)
    base = len(raw)
    ix = b"ix00" + struct.pack("<I", len(std)) + std
    sup = struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"00dc") + struct.pack("<QII", base, len(ix), 4)
    both = raw + ix
    spans = M._super_index(both, len(both), len(both) + len(sup)) if False else M._super_index(both + sup, len(both), len(both) + len(sup))
    assert [both[s:e] for s, e in spans] == frames


def brute_cuts(h, radius, factor, least):
    d = [sum(abs(a - b) for a, b in zip(x, y)) / 2 for x, y in zip(h[:-1], h[1:])]
    out = []
    for i, v in enumerate(d):
        near = d[max(0, i - radius) : i] + d[i + 1 : i + radius + 1]
        mid = float(np.median(near)) if near else 0.0
        spread = float(np.median([abs(x - mid) for x in near])) if near else 0.0
        if v >= least and v > mid + factor * spread:
            out.append(i + 1)
    return out


def test_cuts_against_brute_force():
    rng = np.random.default_rng(3)
    h = rng.dirichlet(np.ones(32) * 5, 60)
    h[20:] = rng.dirichlet(np.ones(32) * 0.3, 40)
    for radius in (0, 1, 5, M.RADIUS, 80):
        assert M.cuts(h, radius).tolist() == brute_cuts(h.tolist(), radius, M.FACTOR, M.LEAST)
    assert M.cuts(np.zeros((0, 32))).tolist() == M.cuts(np.zeros((1, 32))).tolist() == []


def test_clips(spark):
    conv = [["one", "two", "three"], ["only"], []]
    av = M.render_turns(conv)
    rows = [(1, av[0], "x"), (None, av[1], "x"), (3, None, "x"), (4, b"", "x"), (5, b"no avi", "x"), (6, av[2], "x"), (1, av[0], "x")]
    d = spark.createDataFrame(rows, "media_id long, media binary, clip string")
    got = sorted((r["media_id"] or 0, r["clip"], r["first_frame"], r["last_frame"]) for r in M.detect_clips(d).collect())
    n = [3 + len(t) % 6 for t in conv[0]]
    one = [(1, k, sum(n[:k]), sum(n[: k + 1]) - 1) for k in range(3)]
    assert got == sorted([(0, 0, 0, 3 + 4 % 6 - 1)] + one * 2)
    assert M.detect_clips(d.limit(0)).count() == 0


def test_query_finds_every_turn(spark, sf_dir):
    from lodestack.llm.queries import QUERIES

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want, k = [], {}
    for r in c:
        n, (clip, at) = 3 + len(r["text"] or "") % 6, k.get(r["conv_id"], (0, 0))
        want.append((r["conv_id"], clip, at, at + n - 1))
        k[r["conv_id"]] = (clip + 1, at + n)
    got = [(r["media_id"], r["clip"], r["first_frame"], r["last_frame"]) for r in QUERIES["op1_avi_clips"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_long_codes_and_values():
    """Sharp images at high quality have values beyond the 16 bits of a lookup."""
    x = (np.random.default_rng(4).integers(0, 2, (3, 24, 40)) * 255).astype(np.uint8)
    frames = M.encode_frames(x, 98)
    for f, got, want in zip(frames, M.decode_frames(frames), x):
        assert np.abs(got[0].astype(int) - reference_decode(f)).max() <= 1 and np.abs(got[0].astype(int) - want).mean() < 4


def test_slices_of_a_long_film():
    """Memory is bounded by the slice, not by the film, and slices change nothing."""
    import tracemalloc

    x = images(40, 64, 64)
    frames = M.encode_frames(x) * 30
    raw = pa.array([M.write_avi([*frames, b"junk"], 64, 64)], pa.binary())
    whole = M.clips_of(raw, pixels=1 << 30)
    tracemalloc.start()
    small = M.clips_of(raw, pixels=1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert small == whole and whole[0][-1][2] == 1200 and whole[0][-1][5] == 1
    assert peak < 24 << 20  # 1200 frames of 64 x 64 have 5 million pixels, of 20 bytes each while they are decoded


def test_later_segments_without_open_dml_index():
    """idx1 covers the first RIFF only; frames of an AVIX segment are walked."""
    frames = M.encode_frames(images(5))
    body = b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in frames[3:])
    movi = b"LIST" + struct.pack("<I", 4 + len(body)) + b"movi" + body
    avix = b"RIFF" + struct.pack("<I", 4 + len(movi)) + b"AVIX" + movi
    v = M.parse_avi(M.write_avi(frames[:3], 37, 21) + avix)
    assert v.frames == frames and v.indexed


def test_mixed_geometry_in_one_batch():
    a, b = M.encode_frames(images(2, 16, 16)), M.encode_frames(images(3, 40, 24), 50)
    rows, at = M.clips_of(pa.array([M.write_avi(a, 16, 16), M.write_avi(b + [b"junk"], 24, 40)], pa.binary()))
    assert [(r[6], r[7]) for r in rows][0] == (16, 16) and sum(r[5] for r in rows) == 1 and set(at) == {0, 1}
