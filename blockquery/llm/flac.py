"""FLAC streams: an encoder for 8-bit mono samples, and a decoder that checks every frame.

The encoder chooses a constant, verbatim, fixed-predictor or linear-predictor subframe for each frame and one Rice
partition: on the corpora here several partitions make streams no smaller. The decoder reads all of these, Rice residuals
of both kinds with any partition order and escapes, wasted bits, one to eight channels with stereo decorrelation, and
verifies header CRC-8, frame CRC-16 and the stream's MD5. Frames in the common form (mono, 8 bits, one Rice partition) are
decoded together: residual codes of all frames advance in step, a numpy operation for each sample index instead of each
sample. Anything else goes through a plain decoder for one frame; tests hold the two against each other. Both ways go by
groups of frames of `TOGETHER` bytes, of one stream or of many, so a long stream needs no more than itself and its samples.
Streams that are cut off, damaged or use reserved codes raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np

BLOCK = 4096
RATE = 8000
#: Samples, or bytes of frames, that are coded together: what a task holds beside the stream itself is some hundred times this.
TOGETHER = 1 << 20
#: Order and precision of linear predictors; shorter frames than LINEAR_FROM take a fixed one.
ORDER, PRECISION, LINEAR_FROM = 8, 11, 256
#: Points that a seek table can hold: its length has 24 bits. Frames beyond them are found from its last point.
MOST_POINTS = ((1 << 24) - 1) // 18
_NEAR = 4200  # frame bytes covered by the CRC-16 table


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for v in range(256):
        v <<= bits - 8
        for _ in range(8):
            v = (v << 1) ^ (poly if v & top else 0)
        out.append(v & mask)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC16_AT: np.ndarray | None = None


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ b]
    return c


def crc16_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of adjoining slices of data. The checksum is linear: each byte adds a term given by its distance from the end."""
    global _CRC16_AT
    if _CRC16_AT is None:
        table, rows = np.array(_CRC16, np.uint16), [np.array(_CRC16, np.uint16)]
        for _ in range(_NEAR - 1):
            v = rows[-1]
            rows.append((v << np.uint16(8)) ^ table[v >> np.uint16(8)])
        _CRC16_AT = np.array(rows)
    if int(lengths.max(initial=0)) > _NEAR:
        return np.array([crc16(data[s : s + n].tobytes()) for s, n in zip(starts, lengths)], np.uint16)
    from_end = np.repeat(starts + lengths - 1, lengths) - np.arange(starts[0], starts[0] + int(lengths.sum()))
    return np.bitwise_xor.reduceat(_CRC16_AT.reshape(-1)[from_end * 256 + data[starts[0] : starts[0] + len(from_end)]], starts - starts[0])


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    out = []
    lead = 0x3F
    while n > lead:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~lead << 1) & 0xFF | n, *reversed(out)])


_HEADERS: dict[tuple[int, int], bytes] = {}


def _frame_header(number: int, n: int) -> bytes:
    found = _HEADERS.get((number, n))
    if found is None:
        code = 12 if n == BLOCK else 7
        head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _utf8_number(number) + (b"" if code == 12 else struct.pack(">H", n - 1))
        found = head + bytes([crc8(head)])
        if len(_HEADERS) < 50_000:
            _HEADERS[number, n] = found
    return found


def _zigzag(r: np.ndarray) -> np.ndarray:
    return ((r << 1) ^ (r >> 31)).astype(np.int32)


def _fixed_residuals(x: np.ndarray, fs: np.ndarray, fn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order (0 to 2) of each frame's best fixed predictor, and the residuals."""
    d1 = np.diff(x, prepend=0)
    d1[fs] = 0
    d2 = np.diff(d1, prepend=0)
    d2[fs] = 0
    d2[fs + 1] = 0  # a frame's first samples are warm-up and cost nothing
    residual = np.stack([x, d1, d2])
    order = np.argmin(np.stack([np.add.reduceat(np.abs(r), fs) for r in residual]), axis=0)
    return order, residual[np.repeat(order, fn), np.arange(len(x))]


def _linear_predictors(x: np.ndarray, fs: np.ndarray, fn: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames x order) and shifts, by autocorrelation and Levinson-Durbin over all frames at once."""
    position = np.arange(len(x)) - np.repeat(fs, fn)
    wave = x.astype(np.float64)
    r = np.zeros((len(fs), order + 1))
    for k in range(order + 1):
        product = np.zeros(len(x))
        product[k:] = wave[k:] * wave[: len(x) - k]
        product[position < k] = 0.0
        r[:, k] = np.add.reduceat(product, fs)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a, left = np.zeros((len(fs), order)), r[:, 0].copy()
    for i in range(order):
        reflection = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / left
        a[:, :i] -= reflection[:, None] * a[:, :i][:, ::-1]
        a[:, i] = reflection
        left *= np.maximum(1 - reflection * reflection, 1e-9)
    top = np.floor(np.log2(np.maximum(np.abs(a).max(axis=1), 1e-9))).astype(np.int64) + 1
    shift = np.clip(PRECISION - 1 - top, 0, 15)
    most = (1 << PRECISION - 1) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int32), shift


def _linear_residuals(x: np.ndarray, fn: np.ndarray, q: np.ndarray, shift: np.ndarray) -> np.ndarray:
    predicted, order = np.zeros(len(x), np.int32), q.shape[1]
    for j in range(order):
        predicted[j + 1 :] += np.repeat(q[:, j], fn)[j + 1 :] * x[: len(x) - j - 1]
    return x - (predicted >> np.repeat(shift, fn))


def _bit_rows(values: np.ndarray, width: int) -> np.ndarray:
    """The low bits of each value, highest first: one row of bits for each row of values."""
    bits = values[..., None] >> np.arange(width - 1, -1, -1) & 1
    return bits.reshape(len(values), -1).astype(np.uint8)


def _encode_frames(x: np.ndarray, numbers: list[int], fn: np.ndarray) -> list[bytes]:
    """Whole frames, checksums included, of adjoining runs of signed 8-bit samples."""
    fs = np.cumsum(fn) - fn
    constant = np.maximum.reduceat(x, fs) == np.minimum.reduceat(x, fs)
    linear = (fn >= LINEAR_FROM) & ~constant
    order, lead, residual = np.zeros(len(fn), np.int64), np.full(len(fn), 10), np.zeros(len(x), np.int32)
    of_linear = np.repeat(linear, fn)
    if not linear.all():
        n = fn[~linear]
        order[~linear], residual[~of_linear] = _fixed_residuals(x[~of_linear], np.cumsum(n) - n, n)
    if linear.any():
        n, own = fn[linear], x[of_linear]
        q, shift = _linear_predictors(own, np.cumsum(n) - n, n, ORDER)
        residual[of_linear] = _linear_residuals(own, n, q, shift)
        order[linear], lead[linear] = ORDER, 9 + ORDER * PRECISION + 10
    u = _zigzag(residual)
    coded = np.arange(len(x)) - np.repeat(fs, fn) >= np.repeat(order, fn)
    u[~coded] = 0
    mean = np.add.reduceat(u, fs) / fn
    guess = np.clip(np.floor(np.log2(mean + 1e-9)).astype(np.int64), 0, 13)
    best, k = None, None
    for delta in (-1, 0, 1):
        now = np.clip(guess + delta, 0, 14)
        bits = np.add.reduceat(u >> np.repeat(now, fn), fs) + (fn - order) * (now + 1)
        if best is None:
            best, k = bits, now
        else:
            k, best = np.where(bits < best, now, k), np.minimum(bits, best)
    rice = ~constant & (best + lead + 8 * order < 8 * fn)
    # all Rice codes, each frame from a byte boundary
    size = np.where(rice, (lead + best + 7) // 8, 0)
    at = np.cumsum(size) - size
    use = coded & np.repeat(rice, fn)
    uu, kk = u[use], np.repeat(k, fn)[use].astype(np.int32)
    length = (uu >> kk) + 1 + kk
    ends = np.cumsum(length, dtype=np.int64)
    counts = np.where(rice, fn - order, 0)
    before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
    # where each code's low bits end
    last = ends + np.repeat(8 * at + lead - before, counts)
    bits = np.zeros(8 * int(size.sum()), np.uint8)
    bits[last - kk - 1] = 1
    for j in range(int(kk.max(initial=0))):
        wide = kk > j
        if wide.all():
            bits[last - 1 - j] = uu >> j & 1
        else:
            bits[(last - 1 - j)[wide]] = uu[wide] >> j & 1
    for j in range(4):  # the parameter; coding method and partition order are 0
        bits[(8 * at + lead - 1 - j)[rice]] = k[rice] >> j & 1
    used = (linear & rice)[linear]
    if used.any():
        head = np.concatenate([_bit_rows(np.full((int(used.sum()), 1), PRECISION - 1), 4), _bit_rows(shift[used][:, None], 5), _bit_rows(q[used], PRECISION)], axis=1)
        bits[8 * at[linear & rice][:, None] + np.arange(head.shape[1])] = head
    packed = np.packbits(bits).tobytes()
    samples, signed = (x & 0xFF).astype(np.uint8).tobytes(), (linear & rice).tolist()
    frames = []
    for f, (number, n, s, o, a, m, r, c) in enumerate(zip(numbers, fn.tolist(), fs.tolist(), order.tolist(), at.tolist(), size.tolist(), rice.tolist(), constant.tolist())):
        if r:
            kind = (31 + o if signed[f] else 8 + o) << 1
            body = bytes([kind]) + samples[s : s + o] + packed[a : a + m]
        elif c:
            body = b"\0" + samples[s : s + 1]
        else:
            body = b"\2" + samples[s : s + n]
        frames.append(_frame_header(number, n) + body)
    lengths = np.array([len(b) for b in frames], np.int64)
    sums = crc16_many(np.frombuffer(b"".join(frames), np.uint8), np.cumsum(lengths) - lengths, lengths).astype(">u2").tobytes()
    return [b + sums[2 * i : 2 * i + 2] for i, b in enumerate(frames)]


def encode_many(payloads: list[bytes], rate: int = RATE) -> list[bytes]:
    """Each payload, at least 16 bytes of unsigned 8-bit samples, as a mono stream. One of several frames has a complete seek table."""
    per_doc = [_blocks(len(p)) for p in payloads]
    made: list[list[bytes]] = [[] for _ in payloads]
    group: list[tuple[int, int, int, int]] = []  # (payload, number, start, length)
    held = 0

    def flush() -> None:
        x = np.concatenate([np.frombuffer(payloads[i], np.uint8, n, s) for i, _, s, n in group]).astype(np.int32) - 128
        for (i, *_), frame in zip(group, _encode_frames(x, [g[1] for g in group], np.array([g[3] for g in group], np.int64))):
            made[i].append(frame)

    for i, blocks in enumerate(per_doc):
        start = 0
        for number, n in enumerate(blocks):
            group.append((i, number, start, n))
            start, held = start + n, held + n
            if held >= TOGETHER:
                flush()
                group, held = [], 0
    if group:
        flush()
    out = []
    for payload, blocks, own in zip(payloads, per_doc, made):
        sizes, md5 = [len(b) for b in own], hashlib.md5()
        for s in range(0, len(payload), TOGETHER):
            md5.update(np.bitwise_xor(np.frombuffer(payload, np.uint8, min(TOGETHER, len(payload) - s), s), 0x80))
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (rate << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5.digest()
        points, offset, sample = [], 0, 0
        for n, b in zip(blocks, sizes) if len(blocks) > 1 else ():
            points.append(struct.pack(">QQH", sample, offset, n))
            sample, offset = sample + n, offset + b
        tables = [points[i : i + MOST_POINTS] for i in range(0, len(points), MOST_POINTS)][:1]  # a block has 24 bits of length
        metadata = [(0, info), *((3, b"".join(t)) for t in tables)]
        heads = [bytes([kind | (0x80 if i + 1 == len(metadata) else 0)]) + len(body).to_bytes(3, "big") + body for i, (kind, body) in enumerate(metadata)]
        out.append(b"fLaC" + b"".join(heads) + b"".join(own))
    return out


def _blocks(n: int) -> list[int]:
    """Block lengths; a last block under 16 samples, which the format forbids, is avoided by sharing."""
    full, rest = divmod(n, BLOCK)
    if not rest:
        return [BLOCK] * full
    if rest >= 16 or not full:
        return [BLOCK] * full + [rest]
    return [BLOCK] * (full - 1) + [BLOCK - 16, rest + 16]


@dataclass
class Info:
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    points: list[tuple[int, int, int]]
    start: int  # of the first frame
    block: int


def parse_metadata(media: bytes) -> Info:
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points = 4, None, []
    while True:
        if len(media) < at + 4:
            raise ValueError("metadata are cut off")
        head, n = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + n]
        if len(body) < n:
            raise ValueError("metadata are cut off")
        if head & 0x7F == 0:
            if n < 34:
                raise ValueError("stream information is cut off")
            packed = int.from_bytes(body[10:18], "big")
            info = Info(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34], [], 0, struct.unpack(">H", body[2:4])[0])
        elif head & 0x7F == 3:
            points = [p for p in struct.iter_unpack(">QQH", body[: n // 18 * 18]) if p[0] != (1 << 64) - 1]
        at += 4 + n
        if head & 0x80:
            break
    if info is None:
        raise ValueError("no stream information")
    info.points, info.start = points, at
    return info


class _Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("the frame is cut off")
        v = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n) & (1 << n) - 1
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        q = 0
        while not self.take(1):
            q += 1
        return q


_BLOCK_CODES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
_BIT_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _header(media: bytes, at: int, info: Info) -> tuple[int, int, int, int, bytes]:
    """Block length, channel code, bits and end of a frame's header, and the header; checks its CRC-8."""
    if len(media) < at + 7:
        raise ValueError("the frame is cut off")
    if media[at] != 0xFF or media[at + 1] & 0xFE != 0xF8:
        raise ValueError("a frame does not begin with the sync code")
    lead = media[at + 4]
    if 0x80 <= lead < 0xC0 or lead == 0xFF:
        raise ValueError("a malformed frame number")
    number = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    end, code, rate = at + 4 + number, media[at + 2] >> 4, media[at + 2] & 15
    if len(media) < end + 3:
        raise ValueError("the frame is cut off")
    if code == 6:
        n, end = media[end] + 1, end + 1
    elif code == 7:
        n, end = int.from_bytes(media[end : end + 2], "big") + 1, end + 2
    elif code in _BLOCK_CODES:
        n = _BLOCK_CODES[code]
    else:
        raise ValueError("a reserved block length")
    if rate == 15 or media[at + 3] >> 4 > 10 or media[at + 3] >> 1 & 7 == 3:
        raise ValueError("a reserved sample rate, channel layout or sample size")
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    head = media[at : end + 1]
    if len(media) <= end:
        raise ValueError("the frame is cut off")
    return n, media[at + 3] >> 4, _BIT_CODES.get(media[at + 3] >> 1 & 7, info.bits), end + 1, head


def decode_frame(media: bytes, at: int, info: Info) -> tuple[np.ndarray, int]:
    """Samples (channels x n) of the frame at a byte offset and the offset of the next; checks both checksums."""
    n, code, bits, end, head = _header(media, at, info)
    if crc8(head[:-1]) != head[-1]:
        raise ValueError("a frame header does not match its checksum")
    reader, channels = _Bits(media, 8 * end), info.channels if code < 8 else 2
    if code < 8:
        channels = code + 1
    side = {8: 1, 9: 0, 10: 1}.get(code)
    parts = [_subframe(reader, n, bits + (c == side)) for c in range(channels)]
    a = np.array(parts, np.int64)
    if code == 8:
        a[1] = a[0] - a[1]
    elif code == 9:
        a[0] = a[0] + a[1]
    elif code == 10:
        mid = a[0] << 1 | a[1] & 1
        a = np.stack([(mid + a[1]) >> 1, (mid - a[1]) >> 1])
    stop = (reader.at + 7) >> 3
    if crc16(media[at:stop]) != int.from_bytes(media[stop : stop + 2], "big") or len(media) < stop + 2:
        raise ValueError("a frame does not match its checksum")
    return a, stop + 2


def _subframe(r: _Bits, n: int, bits: int) -> list[int]:
    r.take(1)
    kind, wasted = r.take(6), 0
    if r.take(1):
        wasted = r.unary() + 1
        bits -= wasted
    if kind == 0:
        out = [r.signed(bits)] * n
    elif kind == 1:
        out = [r.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12:
        order = kind - 8
        out = [r.signed(bits) for _ in range(order)]
        coefficients, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0
        _predict(out, _residual(r, n, order), coefficients, shift)
    elif kind >= 32:
        order = kind - 31
        out = [r.signed(bits) for _ in range(order)]
        precision, shift = r.take(4) + 1, r.signed(5)
        if precision == 16 or shift < 0:
            raise ValueError("a reserved predictor")
        coefficients = [r.signed(precision) for _ in range(order)]
        _predict(out, _residual(r, n, order), coefficients, shift)
    else:
        raise ValueError("a reserved subframe")
    return [v << wasted for v in out] if wasted else out


def _predict(out: list[int], residual: list[int], coefficients: list[int], shift: int) -> None:
    for e in residual:
        out.append(e + (sum(c * out[-1 - j] for j, c in enumerate(coefficients)) >> shift))


def _residual(r: _Bits, n: int, order: int) -> list[int]:
    method = r.take(2)
    if method > 1:
        raise ValueError("a reserved residual coding")
    wide, parts, out = 4 + method, 1 << r.take(4), []
    if n % parts or n // parts < order:
        raise ValueError("partitions do not fit the block")
    for p in range(parts):
        count = n // parts - (order if p == 0 else 0)
        k = r.take(wide)
        if k == (1 << wide) - 1:
            raw = r.take(5)
            out += [r.signed(raw) for _ in range(count)]
        else:
            for _ in range(count):
                u = r.unary() << k
                u |= r.take(k)
                out.append(u >> 1 ^ -(u & 1))
    return out


def _check_md5(info: Info, pcm: bytes) -> None:
    if info.md5 != bytes(16) and hashlib.md5(pcm).digest() != info.md5:
        raise ValueError("the samples do not match the stream's MD5")


def decode_plain(media: bytes) -> tuple[Info, list[tuple[int, np.ndarray]]]:
    """All frames in order, as (sample offset, channels x n)."""
    info, out, sample = parse_metadata(media), [], 0
    at = info.start
    while at < len(media) and (not info.samples or sample < info.samples):
        block, at = decode_frame(media, at, info)
        out.append((sample, block))
        sample += block.shape[1]
    if info.samples and sample != info.samples:
        raise ValueError("the stream has fewer samples than it says")
    width = (info.bits + 7) // 8
    pcm = np.concatenate([b for _, b in out], axis=1).T.reshape(-1).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() if out else b""
    _check_md5(info, pcm)
    return info, out


def seek(media: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The frame that holds a sample, reached through the seek table: (its first sample, channels x n)."""
    info = parse_metadata(media)
    first, offset, _ = max((p for p in info.points if p[0] <= sample), default=(0, 0, 0))
    at = info.start + offset
    while at < len(media):
        block, at = decode_frame(media, at, info)
        if first <= sample < first + block.shape[1]:
            return first, block
        first += block.shape[1]
    raise ValueError("no such sample")


_KNOWN_HEADS: dict[bytes, bool] = {}


def _head_ok(head: bytes) -> bool:
    ok = _KNOWN_HEADS.get(head)
    if ok is None:
        ok = crc8(head[:-1]) == head[-1]
        if len(_KNOWN_HEADS) < 50_000:
            _KNOWN_HEADS[head] = ok
    return ok


def decode_many(medias: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its blocks as (sample offset, PCM bytes). Mono 8-bit samples come as unsigned bytes, others as little-endian frames."""
    out: list[list[tuple[int, bytes]]] = []
    group: list[tuple[int, int, int, int, tuple | None]] = []  # (stream, block, start, stop, what _rice_start says)
    held, simple = 0, []

    def flush() -> None:
        data = np.frombuffer(b"".join(medias[i][a:b] for i, _, a, b, _ in group) + bytes(8), np.uint8)
        n = np.array([b - a for _, _, a, b, _ in group], np.int64)
        begin = np.cumsum(n) - n
        if crc16_many(data, begin, n).any():  # the checksum of a frame with its own checksum is 0
            raise ValueError("a frame does not match its checksum")
        jobs = [(i, j, 8 * (int(at) - a) + found[1], found) for (i, j, a, _, found), at in zip(group, begin) if found]
        order, _, k, first, lpc, samples = zip(*(f for *_, f in jobs)) if jobs else ((),) * 6
        for (i, j, *_), pcm in zip(jobs, _lockstep(data, [s for _, _, s, _ in jobs], k, order, samples, first, lpc)):
            out[i][j] = (out[i][j][0], pcm)

    for i, media in enumerate(medias):
        info = parse_metadata(media)
        points = info.points or ([(0, 0, info.samples)] if info.samples <= info.block else [])
        if info.channels != 1 or info.bits != 8 or not points or sum(p[2] for p in points) != info.samples:
            out.append([(s, _pcm(b, info)) for s, b in decode_plain(media)[1]])
            continue
        simple.append((i, info))
        own: list[tuple[int, bytes]] = []
        out.append(own)
        ends = [info.start + p[1] for p in points[1:]] + [len(media)]
        for j, ((sample, offset, promised), stop) in enumerate(zip(points, ends)):
            at = info.start + offset
            n, code, bits, end, head = _header(media, at, info)
            if not _head_ok(head):
                raise ValueError("a frame header does not match its checksum")
            if n != promised or not end < stop <= len(media):
                raise ValueError("the seek table does not match the frames")
            kind, found = media[end], None
            if code == 0 and bits == 8 and kind == 0:
                own.append((sample, bytes([media[end + 1] ^ 0x80]) * n))
            elif code == 0 and bits == 8 and kind == 2:
                if stop - end - 3 != n:
                    raise ValueError("the frame is cut off")
                own.append((sample, (np.frombuffer(media, np.uint8, n, end + 1) ^ 0x80).tobytes()))
            else:
                if code == 0 and bits == 8 and not kind & 1 and (16 <= kind <= 24 or kind >= 64):
                    found = _rice_start(media[:stop], end, kind >> 1)
                if found:
                    found = (*found, n)
                    own.append((sample, b""))
                else:
                    own.append((sample, _pcm(decode_frame(media, at, info)[0], info)))
            group.append((i, j, at, stop, found))
            held += stop - at
            if held >= TOGETHER:
                flush()
                group, held = [], 0
    if group:
        flush()
    for i, info in simple:
        if info.md5 != bytes(16):
            md5 = hashlib.md5()
            for _, pcm in out[i]:
                md5.update(np.bitwise_xor(np.frombuffer(pcm, np.uint8), 0x80))
            if md5.digest() != info.md5:
                raise ValueError("the samples do not match the stream's MD5")
    return out


def _pcm(block: np.ndarray, info: Info) -> bytes:
    if info.channels == 1 and info.bits == 8:
        return (block[0] + 128).astype(np.uint8).tobytes()
    return block.T.reshape(-1).astype("<i8").view(np.uint8).reshape(-1, 8)[:, : (info.bits + 7) // 8].tobytes()


def _rice_start(media: bytes, end: int, kind: int) -> tuple | None:
    """Order, bit at which the codes begin, parameter, warm-up and predictor, if the residual is one plain Rice partition."""
    order = kind - 8 if kind < 32 else kind - 31
    if len(media) < end + 4 + order:
        raise ValueError("the frame is cut off")
    first = [b - 256 if b > 127 else b for b in media[end + 1 : end + 1 + order]]
    if kind < 32:  # byte-aligned
        v = media[end + 1 + order] << 8 | media[end + 2 + order]
        return None if v >> 10 or (v >> 6 & 15) == 15 else (order, 8 * (end + 1 + order) + 10, v >> 6 & 15, first, None)
    r = _Bits(media, 8 * (end + 1 + order))
    precision, shift = r.take(4) + 1, r.signed(5)
    if precision == 16 or shift < 0:
        return None
    lpc = ([r.signed(precision) for _ in range(order)], shift)
    if r.take(6) or (k := r.take(4)) == 15:
        return None
    return order, r.at, k, first, lpc


def _lockstep(data: np.ndarray, start: list[int], k: list[int], order: list[int], n: list[int], warm: list[list[int]], lpcs: list) -> list[bytes]:
    """PCM of frames of 8-bit samples whose codes begin at the bits `start`, a numpy operation for each place of a sample."""
    if not start:
        return []
    start, k, order, n = (np.array(v, np.int64) for v in (start, k, order, n))
    count = n - order
    rank = np.argsort(-count, kind="stable")
    most = int(count.max())
    ones = np.flatnonzero(np.unpackbits(data)).astype(np.int32)
    following = np.repeat(ones, np.diff(ones, prepend=np.int32(-1)))  # the next 1 at or after each bit
    at, kk = start[rank], k[rank]
    active = np.searchsorted(-count[rank], -np.arange(most), side="left")
    begins, places = np.zeros((most, len(start)), np.int32), np.zeros((most, len(start)), np.int32)
    try:
        for i in range(most):
            a = active[i]
            p = at[:a]
            one = following[p]
            begins[i, :a] = p
            places[i, :a] = one
            np.add(one, kk[:a] + 1, out=p)
    except IndexError:
        raise ValueError("the frame is cut off") from None
    low = places + 1
    byte, shift = low >> 3, low & 7
    word = data[byte].astype(np.int32) << 16 | data[byte + 1].astype(np.int32) << 8 | data[byte + 2]
    k32 = kk.astype(np.int32)
    u = (places - begins) << k32 | (word >> (24 - shift - k32)) & ((1 << k32) - 1)
    residual = u >> 1 ^ -(u & 1)  # places x frames, in rank order
    out: list[bytes] = [b""] * len(start)
    orders, linear = order[rank], np.array([lpcs[i] is not None for i in rank])
    for o in np.unique(orders[~linear]):
        rows = np.flatnonzero(~linear & (orders == o))
        first = np.array([warm[rank[i]] for i in rows], np.int32).reshape(len(rows), int(o))
        full = residual[:, rows].T
        for level in range(int(o) - 1, -1, -1):
            lead = np.diff(first[:, : level + 1], n=level, axis=1)[:, :1] if level else first[:, :1]
            full = np.cumsum(np.concatenate([lead, full], axis=1), axis=1)
        for row, i in zip((full + 128).astype(np.uint8), rows):
            out[rank[i]] = row[: n[rank[i]]].tobytes()
    rows = np.flatnonzero(linear)
    if len(rows):
        # predictors of lower order get leading zeros, so that all frames step together
        top = int(orders[rows].max())
        c, full = np.zeros((top, len(rows)), np.int64), np.zeros((top + most, len(rows)), np.int64)
        for j, i in enumerate(rows):
            o = int(orders[i])
            c[top - o :, j], full[top - o : top, j] = lpcs[rank[i]][0][::-1], warm[rank[i]]
        shift = np.array([lpcs[rank[i]][1] for i in rows], np.int64)
        steps = np.searchsorted(-count[rank[rows]], -np.arange(most), side="left")
        e = residual[:, rows]
        for i in range(int(count[rank[rows]].max())):
            a = steps[i]
            np.add(np.einsum("ij,ij->j", full[i : i + top, :a], c[:, :a]) >> shift[:a], e[i, :a], out=full[top + i, :a])
        for row, i in zip((full + 128).astype(np.uint8).T, rows):
            o = int(orders[i])
            out[rank[i]] = row[top - o : top - o + n[rank[i]]].tobytes()
    return out
