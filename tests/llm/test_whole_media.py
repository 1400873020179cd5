"""FLAC: the general reader against the vectorised one, fitted predictors, and a stream of another make written by hand."""

import numpy as np
import pytest


def payloads():
    rng = np.random.default_rng(2)
    t = np.arange(192 * 6)
    tone = (128 + 90 * np.sin(t * 1.9) + 20 * np.sin(t / 9)).astype(np.uint8)
    return [tone, rng.integers(0, 256, 192 * 2, dtype=np.uint8), np.full(192, 7, np.uint8), np.frombuffer(b"the quick brown fox " * 96, np.uint8), np.array([0, 255] * 96, np.uint8)]


def test_both_readers():
    from pageloom.llm import flac as M

    data = payloads()
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    files = M.encode_payloads(np.concatenate(data), bounds)
    back, at = M.decode_files(files)
    for d, (blob, offsets), a, b in zip(data, files, at[:-1], at[1:]):
        assert (back[a:b] == d).all()
        assert (M.read_stream(blob)[:, 0] + 128 == d).all()
        assert (M.read_stream(blob[: offsets[0]] + blob[offsets[-2] :])[:, 0] + 128 == d[-192:]).all()
    # a tone takes fitted predictors: subframe codes of 32 and more
    blob, offsets = files[0]
    assert sum(blob[o + 6] >> 1 >= 32 for o in offsets[:-1]) >= 4


@pytest.mark.parametrize("place", [-1, -9, 5])
def test_broken_frames_raise(place):
    from pageloom.llm import flac as M

    (blob, offsets), = M.encode_payloads(payloads()[0], np.array([0, 192 * 6]))
    broken = bytearray(blob)
    broken[place if place < 0 else offsets[0] + place] ^= 8
    for read in (M.read_stream, lambda b: M.decode_files([(b, offsets)])):
        with pytest.raises((ValueError, KeyError)):
            read(bytes(broken))


def test_stream_of_another_make():
    """16-bit stereo as left and side, a block of 16 samples of which both subframes have two Rice partitions, one with an escape, and wasted bits."""
    from pageloom.llm import flac as M

    left = np.array([4, 8, 12, 20, 16, 8, 0, -4, -8, -4, 0, 4, 8, 12, 12, 8]) * 100
    right = left - np.array([2, 4, 2, 0, -2, 0, 2, 4, 6, 4, 2, 0, 0, 2, 4, 2])
    bits = ""

    def put(value, n):
        nonlocal bits
        bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def fixed(values, size, k, wasted, escape):
        values = [v >> wasted for v in values]
        put(9 << 1 | bool(wasted), 8)  # order 1
        if wasted:
            put(1, wasted)
        put(values[0], size - wasted)
        put(0, 2), put(1, 4)
        rest = [b - a for a, b in zip(values, values[1:])]
        for part, some in enumerate((rest[:7], rest[7:])):
            if part == escape:
                put(15, 4), put(14, 5)
                for r in some:
                    put(r, 14)
                continue
            put(k, 4)
            for r in some:
                folded = 2 * r if r >= 0 else -2 * r - 1
                put(1, (folded >> k) + 1), put(folded, k)

    put(0xFFF8, 16), put(6, 4), put(0, 4), put(8, 4), put(4, 3), put(0, 1), put(0, 8), put(15, 8)
    crc8 = lambda raw: __import__("functools").reduce(lambda c, b: int(M.CRC8[c ^ b]), raw, 0)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    put(crc8(raw), 8)
    fixed(left.tolist(), 16, 6, 2, 1)
    fixed((left - right).tolist(), 17, 1, 0, None)
    bits += "0" * (-len(bits) % 8)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    raw += int(M.crc16(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")
    info = bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 16).to_bytes(8, "big") + bytes(16)
    got = M.read_stream(b"fLaC\x80\x00\x00\x22" + info + raw)
    assert got.tolist() == np.stack([left, right], axis=1).tolist()
