"""Operator 7. Media columns: lossless FLAC over byte payloads.

Encoder and decoder work on all frames of a block at once: a frame is 192 mono
8-bit samples. The encoder takes, for each frame, the fixed linear predictor (order 0
to 4) with the smallest residuals, or a fitted one with quantised coefficients where its
residuals save more bits than its coefficients take, and the best of three Rice parameters,
or stores the frame verbatim where that is smaller. The
decoder walks the residuals of all frames in step, undoes the predictor, checks the
CRC-8 of each header and the CRC-16 of each frame, and yields PCM blocks together
with the byte offset of each frame, so that any sample range can be read alone.
A file is the stream marker, STREAMINFO (with the MD5 of the samples), a SEEKTABLE
and the frames. ``read_stream`` reads FLAC streams in general, one sample after another.

Defined cases: null and empty texts give one frame of padding; rows are
independent, so repeated rows and null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm import textkit as tk
from pageloom.llm.bpe import ragged_index
from pageloom.runtime import ship

FRAME = 192
RATE = 8000
#: A seek point for every so many frames.
SEEK_EVERY = 64
ORDERS = 5
PARAMS = 9
#: Fitted predictors: order, bits of a coefficient, and how far predictions are shifted down.
FITTED, COEFFICIENT_BITS, SHIFT = 8, 10, 7
#: Fixed predictors: coefficients of the last samples, nearest first, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte spans, one byte of all spans at a time."""
    crc = np.zeros(len(starts), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, left = starts[order], np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
    for k, n in enumerate(left.tolist()):
        c = crc[:n]
        crc[:n] = (c << 8 & 0xFFFF) ^ CRC16[c >> 8 ^ data[starts[:n] + k]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _frame_headers(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Header bytes (rows of up to 11) and their sizes: 192-sample blocks, rate from STREAMINFO, mono, 8 bit."""
    n = len(number)
    rows, size = np.zeros((n, 11), dtype=np.int64), np.full(n, 5)
    rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = 0xFF, 0xF8, 0x10, 0x02
    coded = [(number < 1 << 7, 1), (number < 1 << 11, 2), (number < 1 << 16, 3), (number < 1 << 21, 4), (number < 1 << 26, 5), (number < 1 << 31, 6)]
    length = np.select([c for c, _ in coded], [k for _, k in coded])
    for k in np.unique(length).tolist():
        at = np.flatnonzero(length == k)
        v = number[at]
        if k == 1:
            rows[at, 4] = v
        else:
            rows[at, 4] = (0xFF << (8 - k) & 0xFF) | v >> 6 * (k - 1)
            for j in range(1, k):
                rows[at, 4 + j] = 0x80 | v >> 6 * (k - 1 - j) & 0x3F
        size[at] = 4 + k
        crc = np.zeros(len(at), dtype=np.int64)
        for j in range(4 + k):
            crc = CRC8[crc ^ rows[at, j]]
        rows[at, 4 + k] = crc
    return rows, size + 1


def _bits_to_bytes(values: np.ndarray, zeros: np.ndarray, width: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (``zeros`` zero bits, then the ``width`` low bits of a value) of each row, rows padded to bytes."""
    total = zeros + width
    ends = np.cumsum(total)
    row_bits = np.concatenate([[0], ends])[bounds]
    size = (np.diff(row_bits) + 7) // 8
    row_start = np.concatenate([[0], np.cumsum(size)])
    shift = row_start[:-1] * 8 - row_bits[:-1]
    at = ends - width + np.repeat(shift, np.diff(bounds))
    out = np.zeros(row_start[-1] + 8, dtype=np.int64)
    # a value of up to 16 bits touches three bytes
    word = values << (24 - width - (at & 7))
    for k in range(3):
        part = word >> (16 - 8 * k) & 0xFF
        out += np.bincount((at >> 3) + k, weights=part, minlength=len(out))[: len(out)].astype(np.int64)
    return out[:-8].astype(np.uint8), row_start


def _residuals(pcm: np.ndarray) -> list[np.ndarray]:
    """Folded residuals (0, -1, 1, -2, ... to 0, 1, 2, 3, ...) of every fixed predictor."""
    diff, out = pcm.astype(np.int32), []
    for _ in range(ORDERS):
        out.append((diff << 1) ^ (diff >> 31))
        diff = diff[:, 1:] - diff[:, :-1]
    return out


def _fitted(pcm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (n, FITTED), nearest sample first, by Levinson-Durbin on windowed autocorrelations, and the residuals (n, FRAME - FITTED)."""
    x = pcm.astype(np.float64) * np.hanning(FRAME + 2)[1:-1]
    auto = np.stack([(x[:, : FRAME - k] * x[:, k:]).sum(axis=1) for k in range(FITTED + 1)], axis=1)
    error = auto[:, 0] * (1 + 1e-9) + 1e-6
    a = np.zeros((len(pcm), FITTED))
    for m in range(FITTED):
        reflect = (auto[:, m + 1] - (a[:, :m] * auto[:, m:0:-1]).sum(axis=1)) / error
        a[:, :m] -= reflect[:, None] * a[:, :m][:, ::-1]
        a[:, m] = reflect
        error = np.maximum(error * (1 - reflect**2), 1e-6)
    most = (1 << (COEFFICIENT_BITS - 1)) - 1
    c = np.clip(np.rint(a * (1 << SHIFT)), -most, most).astype(np.int32)
    wide = pcm.astype(np.int32)
    guess = sum(c[:, j, None] * wide[:, FITTED - 1 - j : FRAME - 1 - j] for j in range(FITTED))
    return c, wide[:, FITTED:] - (guess >> SHIFT)


def encode_frames(pcm: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames (n, 192) of signed samples to their bytes, one after another, and their bounds."""
    n = len(pcm)
    residuals = _residuals(pcm)
    total = np.stack([r.sum(axis=1, dtype=np.int64) for r in residuals])
    chosen = total.argmin(axis=0)
    coefficients, rest = _fitted(pcm)
    folded = (rest << 1) ^ (rest >> 31)
    sums = folded.sum(axis=1, dtype=np.int64)
    # bits of a frame, about: a residual takes what its mean needs; coefficients and their warm-up are paid for
    need = lambda t, count, order: count * np.log2(1 + t / count) + 8 * order
    fixed = np.choose(chosen, [need(total[o], FRAME - o, o) for o in range(ORDERS)])
    chosen = np.where(need(sums, FRAME - FITTED, FITTED) + FITTED * COEFFICIENT_BITS + 9 < fixed, ORDERS, chosen)
    residuals.append(folded)
    total = np.concatenate([total, sums[None]])
    bodies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each kind: frames, bytes, bounds

    def pack(rows: np.ndarray, zeros: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
        bodies.append((rows, *_bits_to_bytes(value.ravel(), zeros.ravel(), width.ravel(), np.arange(len(rows) + 1) * value.shape[1])))

    verbatim = np.zeros(n, dtype=bool)
    for kind in range(ORDERS + 1):
        rows = np.flatnonzero(chosen == kind)
        if not len(rows):
            continue
        order, extra = (FITTED, FITTED + 1) if kind == ORDERS else (kind, 0)
        extra_bits = FITTED * COEFFICIENT_BITS + 9 if extra else 0
        folded, count = residuals[kind][rows].astype(np.int64), FRAME - order
        # near the best parameter the cost is flat: three around the mean's are tried
        guess = np.clip(np.log2(np.maximum(1, total[kind, rows] / count)).astype(np.int64), 1, PARAMS - 2)
        tries = guess + np.arange(-1, 2)[:, None]
        bits = np.stack([8 * order + extra_bits + 18 + count * (k + 1) + (folded >> k[:, None]).sum(axis=1) for k in tries])
        k = tries[bits.argmin(axis=0), np.arange(len(rows))][:, None]
        verbatim[rows] = bits.min(axis=0) >= 8 * FRAME + 8
        keep = ~verbatim[rows]
        rows, folded, k = rows[keep], folded[keep], k[keep]
        if not len(rows):
            continue
        at = 1 + order + extra
        zeros = np.zeros((len(rows), at + 1 + count), dtype=np.int64)
        value, width = zeros.copy(), np.full_like(zeros, 8)
        value[:, 0] = (31 + order if extra else 8 + order) << 1
        value[:, 1 : 1 + order] = pcm[rows, :order].astype(np.int64) & 0xFF
        if extra:  # precision less 1 in four bits, shift in five, coefficients
            value[:, 1 + order], width[:, 1 + order] = (COEFFICIENT_BITS - 1) << 5 | SHIFT, 9
            value[:, 2 + order : at], width[:, 2 + order : at] = coefficients[rows].astype(np.int64) & ((1 << COEFFICIENT_BITS) - 1), COEFFICIENT_BITS
        value[:, at] = k[:, 0]  # Rice coding, one partition, 4-bit parameter: ten bits
        width[:, at] = 10
        zeros[:, at + 1 :] = folded >> k
        value[:, at + 1 :] = (1 << k) | (folded & ((1 << k) - 1))
        width[:, at + 1 :] = k + 1
        pack(rows, zeros, value, width)
    rows = np.flatnonzero(verbatim)
    if len(rows):
        data = np.concatenate([np.full((len(rows), 1), 0x02, dtype=np.uint8), pcm[rows].view(np.uint8)], axis=1)
        bodies.append((rows, data.ravel(), np.arange(len(rows) + 1) * (FRAME + 1)))
    head, head_size = _frame_headers(number)
    body_size = np.zeros(n, dtype=np.int64)
    for rows, _, at in bodies:
        body_size[rows] = np.diff(at)
    size = head_size + body_size + 2
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(bounds[-1], dtype=np.uint8)
    out[ragged_index(bounds[:-1], head_size)] = head[np.arange(11)[None, :] < head_size[:, None]]
    for rows, body, _ in bodies:
        out[ragged_index((bounds[:-1] + head_size)[rows], body_size[rows])] = body
    crc = crc16(out, bounds[:-1], size - 2)
    out[bounds[1:] - 2], out[bounds[1:] - 1] = crc >> 8, crc & 0xFF
    return out, bounds


def decode_frames(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bytes of frames to signed samples (n, 192); raises where a checksum or header is wrong."""
    n = len(bounds) - 1
    starts, ends = bounds[:-1], bounds[1:]
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    if not ((padded[starts] == 0xFF) & (padded[starts + 1] == 0xF8) & (padded[starts + 2] == 0x10) & (padded[starts + 3] == 0x02)).all():
        raise ValueError("not a frame of 192 mono 8-bit samples")
    lead = padded[starts + 4]
    length = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    head = 5 + length
    crc = np.zeros(n, dtype=np.int64)
    for j in range(int(head.max()) - 1):
        crc = np.where(j < head - 1, CRC8[crc ^ padded[starts + j]], crc)
    if (crc != padded[starts + head - 1]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    if (crc16(padded, starts, ends - starts - 2) != padded[ends - 2].astype(np.int64) << 8 | padded[ends - 1]).any():
        raise ValueError("a frame's CRC-16 is wrong")
    kind = padded[starts + head].astype(np.int64)
    code = kind >> 1
    fixed, fitted = (code >= 8) & (code < 8 + ORDERS), code >= 32
    order = np.select([fixed, fitted], [code - 8, code - 31], -1)
    if ((kind & 1).astype(bool) | ~(fixed | fitted | (code <= 1))).any():
        raise ValueError("unknown subframe")
    pcm = np.zeros((n, FRAME), dtype=np.int64)
    # the next eight bytes at every place, as one number
    word = np.zeros(len(padded) - 8, dtype=np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : len(padded) - 8 + k]
    plain, constant = np.flatnonzero(code == 1), np.flatnonzero(code == 0)
    pcm[plain] = padded[starts[plain, None] + head[plain, None] + 1 + np.arange(FRAME)].astype(np.int8)
    pcm[constant] = padded[starts[constant, None] + head[constant, None] + 1].astype(np.int8)

    def bits(at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Numbers of up to 32 bits at bit places."""
        return ((word[at >> 3] << (at & 7).astype(np.uint64)) >> np.asarray(64 - size, dtype=np.uint64)).astype(np.int64)

    for p, lpc in sorted(set(zip(order[order >= 0].tolist(), fitted[order >= 0].tolist()))):
        at = np.flatnonzero((order == p) & (fitted == lpc))
        first = starts[at] + head[at] + 1
        for j in range(p):
            pcm[at, j] = padded[first + j].astype(np.int8)
        bit = (first + p) * 8
        shift = np.zeros(len(at), dtype=np.int64)
        weights: list = list(FIXED[p]) if not lpc else []
        if lpc:
            size, shift = bits(bit, 4) + 1, bits(bit + 4, 5)
            bit = bit + 9
            for _ in range(p):
                c = bits(bit, size)
                weights.append(np.where(c >> (size - 1) & 1, c - (1 << size), c))
                bit = bit + size
        if (bits(bit, 6) != 0).any():
            raise ValueError("frames of this decoder have one Rice partition of 4-bit parameter; see read_stream")
        k = bits(bit + 6, 4)
        bit = bit + 10
        folded = np.empty((FRAME - p, len(at)), dtype=np.int64)
        mask, k1 = (1 << k) - 1, k + 1
        for j in range(FRAME - p):
            window = word[bit >> 3] << (bit & 7).astype(np.uint64)
            # leading zeros: the exponent of the top 53 bits as a float; 57 bits are always there
            zeros = 53 - np.frexp((window >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
            long = np.flatnonzero(np.maximum(zeros + k1, zeros + 5) > 57)
            for q in long.tolist():
                b = int(bit[q])
                while not padded[b >> 3] >> (7 - (b & 7)) & 1:
                    b += 1
                zeros[q] = b - int(bit[q])
            bit = bit + zeros
            if len(long):
                window = word[bit >> 3] << (bit & 7).astype(np.uint64)
                low = (window >> (63 - k).astype(np.uint64)).astype(np.int64) & mask
            else:
                low = (window >> (63 - zeros - k).astype(np.uint64)).astype(np.int64) & mask
            folded[j] = zeros << k | low
            bit = bit + k1
        residual = (folded >> 1) ^ -(folded & 1)
        samples = np.empty((FRAME, len(at)), dtype=np.int64)
        samples[:p] = pcm[at, :p].T
        for j in range(p, FRAME):
            value = np.zeros(len(at), dtype=np.int64)
            for q, c in enumerate(weights):
                value += c * samples[j - 1 - q]
            samples[j] = residual[j - p] + (value >> shift)
        pcm[at] = samples.T
    if pcm.min(initial=0) < -128 or pcm.max(initial=0) > 127:
        raise ValueError("a sample is out of range")
    return pcm.astype(np.int8)


def _stream_head(samples: int, sizes: np.ndarray, offsets: np.ndarray, md5: bytes) -> bytes:
    info = FRAME.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + md5
    points = np.arange(0, len(sizes), SEEK_EVERY)
    table = b"".join(int(p * FRAME).to_bytes(8, "big") + int(offsets[p]).to_bytes(8, "big") + FRAME.to_bytes(2, "big") for p in points.tolist())
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table


def read_head(blob: bytes) -> tuple[int, int, bytes]:
    """Of a file: where its frames begin, its number of samples, the MD5 of the samples."""
    if blob[:4] != b"fLaC":
        raise ValueError("no FLAC stream marker")
    at, samples, md5 = 4, 0, b""
    while True:
        kind, size = blob[at], int.from_bytes(blob[at + 1 : at + 4], "big")
        if kind & 0x7F == 0:
            samples, md5 = int.from_bytes(blob[at + 14 : at + 22], "big") & ((1 << 36) - 1), blob[at + 22 : at + 38]
        at += 4 + size
        if kind & 0x80:
            return at, samples, md5


def encode_payloads(payload: np.ndarray, bounds: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """Payloads (their sizes multiples of 192), concatenated, to whole files and the byte offsets of their frames."""
    frames = np.diff(bounds) // FRAME
    first = np.concatenate([[0], np.cumsum(frames)])
    number = np.arange(first[-1]) - np.repeat(first[:-1], frames)
    # unsigned bytes are centred, as FLAC samples are signed
    signed = (payload.astype(np.int16) - 128).astype(np.int8)
    data, at = encode_frames(signed.reshape(-1, FRAME), number)
    blob, raw = data.tobytes(), signed.tobytes()
    out = []
    for i in range(len(frames)):
        offsets = at[first[i] : first[i + 1] + 1]
        head = _stream_head(int(bounds[i + 1] - bounds[i]), np.diff(offsets), offsets - offsets[0], hashlib.md5(raw[bounds[i] : bounds[i + 1]]).digest())
        out.append((head + blob[offsets[0] : offsets[-1]], offsets - offsets[0] + len(head)))
    return out


def decode_files(files: list[tuple[bytes, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Whole files with the offsets of their frames to payloads (concatenated) and their bounds; sizes and MD5 are checked."""
    data, starts, at, frames = [], [], 0, []
    for blob, offsets in files:
        data.append(np.frombuffer(blob, dtype=np.uint8)[offsets[0] :])
        starts.append(offsets[:-1] - offsets[0] + at)
        at += len(data[-1])
        frames.append(len(offsets) - 1)
    pcm = decode_frames(np.concatenate(data), np.append(np.concatenate(starts), at))
    bounds = np.concatenate([[0], np.cumsum(frames)]) * FRAME
    raw = pcm.tobytes()
    for i, (blob, offsets) in enumerate(files):
        begin, samples, md5 = read_head(blob)
        if begin != offsets[0] or samples != bounds[i + 1] - bounds[i] or hashlib.md5(raw[bounds[i] : bounds[i + 1]]).digest() != md5:
            raise ValueError("stream information does not match the samples")
    return (pcm.astype(np.int16) + 128).astype(np.uint8).ravel(), bounds


def padded_payloads(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offs)
    full = np.maximum(1, -(-size // FRAME)) * FRAME
    bounds = np.concatenate([[0], np.cumsum(full)])
    out = np.full(bounds[-1], 32, dtype=np.uint8)
    out[ragged_index(bounds[:-1], size)] = data
    return out, bounds


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, media (a FLAC file), frame_offsets, payload (as read back), feature.

    The feature is min, max, mean and mean absolute step of the samples read back, as "min|max|sum|steps" in integers.
    """
    ship(docs.sparkSession)

    @tk.releasing
    def rows(batches):
        for batch, data, offs in tk.slices(batches, text_col, tk.BLOCK_BYTES):
            payload, bounds = padded_payloads(data, offs)
            files = encode_payloads(payload, bounds)
            back, at = decode_files(files)
            step = np.zeros(len(back), dtype=np.int64)
            step[1:] = np.abs(np.diff(back.astype(np.int16)))
            step[at[:-1]] = 0
            low, high = np.minimum.reduceat(back, at[:-1]), np.maximum.reduceat(back, at[:-1])
            total, steps = np.add.reduceat(back, at[:-1], dtype=np.int64), np.add.reduceat(step, at[:-1])
            feature = [f"{a}|{b}|{c}|{d}" for a, b, c, d in zip(low.tolist(), high.tolist(), total.tolist(), steps.tolist())]
            whole = back.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()),
                    pa.array(np.diff(offs)),
                    pa.array([f for f, _ in files], pa.binary()),
                    pa.array([o for _, o in files], pa.list_(pa.int64())),
                    pa.array([whole[at[i] : at[i + 1]] for i in range(len(files))], pa.binary()),
                    pa.array(feature),
                ],
                ["doc_id", "n_bytes", "media", "frame_offsets", "payload", "feature"],
            )

    return docs.select(id_col, text_col).mapInArrow(rows, "doc_id long, n_bytes long, media binary, frame_offsets array<long>, payload binary, feature string")


def read_samples(blob: bytes, frame_offsets, start: int, count: int) -> bytes:
    """Samples start to start + count of a file, decoding only the frames that hold them."""
    first, last = start // FRAME, min(-(-(start + count) // FRAME), len(frame_offsets) - 1)
    if first >= last:
        return b""
    offsets = np.asarray(frame_offsets[first : last + 1], dtype=np.int64)
    pcm = decode_frames(np.frombuffer(blob, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])
    return (pcm.astype(np.int16) + 128).astype(np.uint8).tobytes()[start - first * FRAME : start - first * FRAME + count]


def read_stream(blob: bytes) -> np.ndarray:
    """A FLAC stream in general to samples (n, channels): any block size, 4 to 32 bits, constant, verbatim, fixed and fitted
    subframes, Rice partitions of both kinds with escapes, wasted bits, and stereo differences. One sample after another,
    for files of other encoders; header and frame checksums are verified."""
    if blob[:4] != b"fLaC":
        raise ValueError("no FLAC stream marker")
    at, channels, depth = 4, 1, 8
    while True:
        kind, size = blob[at], int.from_bytes(blob[at + 1 : at + 4], "big")
        if not kind & 0x7F:
            packed = int.from_bytes(blob[at + 14 : at + 22], "big")
            channels, depth = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1
        at += 4 + size
        if kind & 0x80:
            break
    place = at * 8

    def take(n: int) -> int:
        nonlocal place
        low = place >> 3
        value = int.from_bytes(blob[low : (place + n + 7) >> 3], "big") >> (-(place + n) & 7)
        place += n
        return value & ((1 << n) - 1)

    def signed(n: int) -> int:
        value = take(n) if n else 0
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary() -> int:
        n = 0
        while not take(1):
            n += 1
        return n

    def check(table: np.ndarray, width: int, low: int, high: int) -> int:
        crc = 0
        for b in blob[low:high]:
            crc = int(table[(crc >> (width - 8)) ^ b]) ^ (crc << 8 & ((1 << width) - 1))
        return crc

    def residual(count: int, order: int) -> list[int]:
        width, parts, out = (4, 5)[take(2)], 1 << take(4), []
        for part in range(parts):
            k, many = take(width), count // parts - (order if not part else 0)
            if k == (1 << width) - 1:
                raw = take(5)
                out += [signed(raw) for _ in range(many)]
                continue
            for _ in range(many):
                folded = unary() << k | (take(k) if k else 0)
                out.append((folded >> 1) ^ -(folded & 1))
        return out

    def subframe(count: int, size: int) -> list[int]:
        take(1)
        code, wasted = take(6), 0
        if take(1):
            wasted = unary() + 1
        size -= wasted
        if code == 0:
            out = [signed(size)] * count
        elif code == 1:
            out = [signed(size) for _ in range(count)]
        elif 8 <= code <= 12 or code >= 32:
            order = code - 8 if code < 32 else code - 31
            out, weights, shift = [signed(size) for _ in range(order)], list(FIXED[order]) if code < 32 else [], 0
            if code >= 32:
                bits, shift = take(4) + 1, signed(5)
                weights = [signed(bits) for _ in range(order)]
            for r in residual(count, order):
                out.append(r + (sum(w * out[-1 - q] for q, w in enumerate(weights)) >> shift))
        else:
            raise ValueError("unknown subframe")
        return [v << wasted for v in out]

    blocks = []
    while place >> 3 < len(blob):
        begin = place >> 3
        if take(14) != 0x3FFE:
            raise ValueError("no frame begins here")
        take(2)
        block, rate, layout, bits = take(4), take(4), take(4), take(3)
        take(1)
        lead = 8 - (take(8) ^ 0xFF).bit_length()
        for _ in range(lead - 1):
            take(8)
        count = take(8) + 1 if block == 6 else take(16) + 1 if block == 7 else 192 if block == 1 else 576 << (block - 2) if block < 6 else 256 << (block - 8)
        take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        if check(CRC8, 8, begin, place >> 3) != take(8):
            raise ValueError("a frame header's CRC-8 is wrong")
        size = {0: depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bits]
        wide = {8: 1, 9: 0, 10: 1}.get(layout)
        planes = [subframe(count, size + (wide == c)) for c in range(layout + 1 if layout < 8 else 2)]
        if layout == 8:
            planes[1] = [a - b for a, b in zip(*planes)]
        elif layout == 9:
            planes[0] = [a + b for a, b in zip(*planes)]
        elif layout == 10:
            middle = [m << 1 | s & 1 for m, s in zip(*planes)]
            planes = [[(m + s) >> 1 for m, s in zip(middle, planes[1])], [(m - s) >> 1 for m, s in zip(middle, planes[1])]]
        place += -place & 7
        if check(CRC16, 16, begin, place >> 3) != take(16):
            raise ValueError("a frame's CRC-16 is wrong")
        blocks.append(np.array(planes, dtype=np.int64).T)
    return np.concatenate(blocks) if blocks else np.zeros((0, channels), dtype=np.int64)
