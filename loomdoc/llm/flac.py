"""FLAC in numpy: many frames side by side, sample after sample.

Decoding reads Rice residuals and linear predictors of all frames of a batch in step: a step reads one code of each
frame, so that the Python loop runs over a frame's samples and not over all of them. Frames whose residual is
partitioned or escaped go one by one. The checksums of every frame's header (CRC-8) and body (CRC-16) are verified, and
the MD5 of the samples that the stream carries.

One channel of 4 to 24 bits is read; what is written has 8 bits, blocks of 1024 samples, and a seek point every 4 blocks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

BLOCK = 1024
SEEK = 4  # blocks from one seek point to the next
CHUNK = 4096  # frames that are coded side by side
PRECISION, SHIFT = 10, 8  # of the linear predictor's coefficients that are written


def _table(polynomial: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ polynomial if c >> (bits - 1) & 1 else c << 1
        out[i] = c & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
# leading zeros of a 16-bit number
_ZEROS = np.array([16, *[16 - i.bit_length() for i in range(1, 1 << 16)]], np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans of the bytes; a step takes the next byte of each."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order].astype(np.int64), lengths[order]
    c = np.zeros(len(order), np.int64)
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    for i, n in enumerate(active.tolist()):
        c[:n] = (c[:n] << 8 & 0xFFFF) ^ CRC16[(c[:n] >> 8) ^ data[at[:n] + i]]
    out = np.empty_like(c)
    out[order] = c
    return out


@lru_cache(maxsize=1 << 14)
def _header(number: int, n: int) -> bytes:
    """A frame's header: fixed block size, one channel, 8 bits."""
    if number < 0x80:
        coded = bytes([number])
    else:
        more = 1
        while number >> (6 * more) >= 1 << (6 - more):
            more += 1
        coded = bytes([(0xFF00 >> more + 1 & 0xFF) | number >> 6 * more, *[0x80 | number >> 6 * i & 0x3F for i in range(more - 1, -1, -1)]])
    head = bytes([0xFF, 0xF8, (10 if n == BLOCK else 7) << 4, 1 << 1]) + coded + (b"" if n == BLOCK else struct.pack(">H", n - 1))
    return head + bytes([crc8(head)])


def _predictions(x: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Order, whether coefficients are written, coefficients, residual: fixed predictors of order 0 to 2, a linear one of 2."""
    none = np.zeros((len(x), 2), np.int32)
    yield 0, False, none, x
    first = np.diff(x, axis=1, prepend=0)
    yield 1, False, none, first
    yield 2, False, none, np.diff(first, axis=1, prepend=0)
    f = x.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", f[:, k:], f[:, : BLOCK - k]).astype(np.float64) for k in range(3))
    r0 = r0 * (1 + 1e-9) + 1
    det = r0 * r0 - r1 * r1
    c = np.stack([(r1 * r0 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det], 1)
    c = np.clip(np.rint(c * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)
    guess = np.zeros_like(x)
    guess[:, 2:] = (c[:, :1] * x[:, 1:-1] + c[:, 1:] * x[:, :-2]) >> SHIFT
    yield 2, True, c, x - guess


def _frames(x: np.ndarray, n: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of the rows of x (zero beyond n samples)."""
    place = np.arange(BLOCK)
    bits = np.full(len(x), np.iinfo(np.int64).max)
    order, linear = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    coefficients, rice = np.zeros((len(x), 2), np.int32), np.zeros(len(x), np.int64)
    u = np.zeros(x.shape, np.int32)
    for o, lin, c, residual in _predictions(x, n):
        zig = (residual << 1) ^ (residual >> 31)
        zig[:, :o] = 0
        zig[place[None, :] >= n[:, None]] = 0
        mean = zig.sum(axis=1) / np.maximum(1, n - o)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))), 0, 14).astype(np.int64)
        cost = (zig >> k[:, None].astype(np.int32)).sum(axis=1, dtype=np.int64) + (n - o) * (k + 1) + 8 * o + lin * (9 + PRECISION * o)
        better = cost < bits
        bits[better], order[better], linear[better], coefficients[better], rice[better], u[better] = cost[better], o, lin, c[better], k[better], zig[better]
    verbatim = bits >= 8 * n  # no predictor saves a bit
    order[verbatim], linear[verbatim] = 0, False
    heads = [_header(int(i), int(m)) for i, m in zip(numbers, n, strict=True)]
    head = np.array([len(h) for h in heads])
    sub = np.where(verbatim, 8 + 8 * n, 8 + 10 + bits)  # type, residual's method, partition order and parameter
    size = head + (sub + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(8 * int(start[-1]), np.uint8)

    def put(at: np.ndarray, value: np.ndarray | int, width: int) -> None:
        for j in range(width):
            out[at + j] = value >> (width - 1 - j) & 1

    at = 8 * (start[:-1] + head)
    put(at, np.where(linear, 0b1000000 | (order - 1) << 1, np.where(verbatim, 0b0000010, 0b0010000 | order << 1)), 8)
    at = at + 8
    for i in np.flatnonzero(verbatim):
        out[at[i] : at[i] + 8 * n[i]] = np.unpackbits(x[i, : n[i]].astype(np.uint8))
    for o in (1, 2):
        put(at[order >= o], x[order >= o, o - 1] & 0xFF, 8)
        at = at + 8 * (order >= o)
    where = at[linear]
    put(where, PRECISION - 1, 4)
    put(where + 4, SHIFT, 5)
    for j in range(2):
        put(where + 9 + PRECISION * j, coefficients[linear, j] & ((1 << PRECISION) - 1), PRECISION)
    at = at + linear * (9 + 2 * PRECISION)
    put(at[~verbatim] + 6, rice[~verbatim], 4)
    at = at + 10
    here = (place[None, :] >= order[:, None]) & (place[None, :] < n[:, None]) & ~verbatim[:, None]
    quotient = u >> rice[:, None].astype(np.int32)
    width = np.where(here, quotient + 1 + rice[:, None], 0)
    ones = (at[:, None] + np.cumsum(width, axis=1) - width + quotient)[here]
    out[ones] = 1
    k_of, value = np.broadcast_to(rice[:, None], u.shape)[here], u[here]
    for j in range(1, int(rice.max(initial=0)) + 1):
        some = k_of >= j
        out[ones[some] + j] = value[some] >> (k_of[some] - j) & 1
    packed = np.packbits(out)
    for s, h in zip(start[:-1].tolist(), heads, strict=True):
        packed[s : s + len(h)] = np.frombuffer(h, np.uint8)
    check = crc16(packed, start[:-1], size - 2)
    packed[start[1:] - 2], packed[start[1:] - 1] = check >> 8, check & 0xFF
    data = packed.tobytes()
    return [data[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def encode(samples: list[np.ndarray], table: bytes = b"") -> list[bytes]:
    """A stream for each array of 8-bit samples; `table` goes into an application block."""
    counts = [max(1, -(-len(s) // BLOCK)) if len(s) else 0 for s in samples]
    frames: list[bytes] = []
    todo = [(s, i) for s, c in zip(samples, counts, strict=True) for i in range(c)]
    for first in range(0, len(todo), CHUNK):
        part = todo[first : first + CHUNK]
        x = np.zeros((len(part), BLOCK), np.int32)
        n = np.zeros(len(part), np.int64)
        for row, (s, i) in enumerate(part):
            piece = s[i * BLOCK : (i + 1) * BLOCK]
            x[row, : len(piece)], n[row] = piece, len(piece)
        frames += _frames(x, n, np.array([i for _, i in part]))
    out, at = [], 0
    for s, c in zip(samples, counts, strict=True):
        own = frames[at : at + c]
        at += c
        sizes = [len(f) for f in own]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), min(BLOCK, len(s) - i * BLOCK)) for i in range(0, c, SEEK))
        rate, total = 8000, len(s)
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big") + (rate << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + hashlib.md5(s.astype(np.int8).tobytes()).digest()
        blocks = [(0, info), (3, points), *([(2, b"loom" + table)] if table else [])]
        meta = b"".join(bytes([kind | (0x80 if i == len(blocks) - 1 else 0)]) + len(b).to_bytes(3, "big") + b for i, (kind, b) in enumerate(blocks))
        out.append(b"fLaC" + meta + b"".join(own))
    return out


@dataclass
class Stream:
    """What the metadata blocks of a stream say, and where its frames begin."""

    data: bytes
    bits: int
    block: int
    total: int
    md5: bytes
    points: list[tuple[int, int]]
    table: bytes
    first: int
    skip: set[int] = field(default_factory=set)  # where a frame's header stands by chance within a frame

    @classmethod
    def open(cls, data: bytes) -> Stream:
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, info, points, table = 4, False, None, [], b""
        while not last:
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            last, at = bool(kind & 0x80), at + 4 + size
            if kind & 0x7F == 0:
                packed = int.from_bytes(body[10:18], "big")
                info = (int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big"), (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34])
            elif kind & 0x7F == 3:
                points = [(s, o) for s, o, _ in struct.iter_unpack(">QQH", body) if s != (1 << 64) - 1]
            elif kind & 0x7F == 2 and body[:4] == b"loom":
                table = body[4:]
        if info is None or info[2] != 1 or not 4 <= info[3] <= 24:
            raise ValueError("one channel of 4 to 24 bits is read")
        return cls(data, info[3], info[1], info[4], info[5], points, table, at)

    def frames(self, at: int | None = None, number: int = 0, limit: int | None = None) -> Iterator[tuple[int, int, int, int]]:
        """Begin, begin of the body, end and samples of each frame from byte `at`; a frame ends where the next header with the next number begins."""
        data, at = self.data, self.first if at is None else at
        found = 0
        while at < len(data) and (limit is None or found < limit):
            body, n = self._head(at, number)
            end = data.find(b"\xff\xf8", body)
            while end >= 0 and (end in self.skip or self._head(end, number + 1, check=False) is None):
                end = data.find(b"\xff\xf8", end + 1)
            end = len(data) if end < 0 else end
            yield at, body, end, n
            at, number, found = end, number + 1, found + 1

    def _head(self, at: int, number: int, check: bool = True) -> tuple[int, int] | None:
        data, bad = self.data, None
        try:
            coded = data[at + 4]
            more = 0 if coded < 0x80 else 7 - (coded ^ 0xFF).bit_length()
            value = coded if coded < 0x80 else coded & (0x3F >> more)
            for i in range(more):
                value = value << 6 | data[at + 5 + i] & 0x3F
            end = at + 5 + more
            code = data[at + 2] >> 4
            n = 192 if code == 1 else 576 << code - 2 if 2 <= code <= 5 else 256 << code - 8 if code >= 8 else 0
            if code in (6, 7):
                n = int.from_bytes(data[end : end + code - 5], "big") + 1
                end += code - 5
            end += {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
            if data[at] != 0xFF or data[at + 1] != 0xF8 or not n or value != number or crc8(data[at:end]) != data[end]:
                bad = f"wrong frame header at byte {at}"
        except IndexError:
            bad = f"cut frame header at byte {at}"
        if bad:
            if check:
                raise ValueError(bad)
            return None
        return end + 1, n


class BadFrame(ValueError):
    """A frame whose checksum is wrong."""

    def __init__(self, stream: Stream, begin: int, end: int):
        super().__init__(f"wrong checksum of the frame at byte {begin}")
        self.stream, self.end = stream, end


def decode(streams: list[Stream], tries: int = 4) -> list[np.ndarray]:
    """The samples of each stream (signed); ValueError where a checksum is wrong.

    A header may stand within a frame by chance, with the right number and checksum; the frame that it ends has a wrong
    checksum then, and is read again past it.
    """
    for _ in range(tries):
        try:
            return _decode_all(streams)
        except BadFrame as bad:
            if bad.end == len(bad.stream.data):
                raise
            bad.stream.skip.add(bad.end)
    return _decode_all(streams)


def _decode_all(streams: list[Stream]) -> list[np.ndarray]:
    todo = [(k, *f) for k, s in enumerate(streams) for f in s.frames()]
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    for first in range(0, len(todo), CHUNK):
        chunk = todo[first : first + CHUNK]
        for (k, *_), samples in zip(chunk, _decode([(streams[k], *f) for k, *f in chunk]), strict=True):
            parts[k].append(samples)
    out = []
    for s, p in zip(streams, parts, strict=True):
        samples = np.concatenate(p) if p else np.zeros(0, np.int32)
        if len(samples) != s.total or (s.bits == 8 and s.md5 != bytes(16) and hashlib.md5(samples.astype(np.int8).tobytes()).digest() != s.md5):
            raise ValueError("the samples are not those of the stream's MD5")
        out.append(samples)
    return out


def read_samples(stream: Stream, start: int, count: int) -> np.ndarray:
    """Samples from `start` on, decoded from the nearest seek point before."""
    start, stop = max(0, start), min(start + count, stream.total)
    if start >= stop:
        return np.zeros(0, np.int32)
    sample, offset = max(((s, o) for s, o in stream.points if s <= start), default=(0, 0))
    number = sample // stream.block
    frames = list(stream.frames(stream.first + offset, number, -(-(stop - sample) // stream.block)))
    samples = np.concatenate(_decode([(stream, *f) for f in frames]))
    return samples[start - sample : stop - sample]


def _decode(frames: list[tuple[Stream, int, int, int, int]]) -> list[np.ndarray]:
    """The samples of the frames (stream, begin, body, end, samples)."""
    size = np.array([f[3] - f[1] for f in frames], np.int64)
    body = np.array([f[2] - f[1] for f in frames], np.int64)
    n = np.array([f[4] for f in frames], np.int64)
    width = np.array([f[0].bits for f in frames], np.int64)
    data = np.frombuffer(b"".join([f[0].data[f[1] : f[3]] for f in frames]) + bytes(16), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    wrong = np.flatnonzero(crc16(data, start, size - 2) != (data[start + size - 2].astype(np.int64) << 8 | data[start + size - 1]))
    if len(wrong):
        bad = frames[wrong[0]]
        raise BadFrame(bad[0], bad[1], bad[3])
    # the 64 bits from each byte on
    words = np.zeros(len(data) - 8, np.uint64)
    for j in range(8):
        words |= data[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)

    def peek(at: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        """The next bits (up to 57) as a number."""
        bits = np.asarray(bits, np.int64)
        window = words[at >> 3] << (at & 7).astype(np.uint64)
        return np.where(bits > 0, window >> (64 - np.maximum(bits, 1)).astype(np.uint64), 0).astype(np.int64)

    def signed(value: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        return np.where(value >> (np.asarray(bits) - 1) & 1, value - (np.int64(1) << np.asarray(bits)), value)

    at = 8 * (start + body)
    kind, wasted = peek(at, 8) >> 1 & 63, peek(at, 8) & 1
    at = at + 8
    for i in np.flatnonzero(wasted):  # unary: how many low bits are always 0
        w = 1
        while not peek(at[i : i + 1], 1)[0]:
            at[i] += 1
            w += 1
        at[i] += 1
        wasted[i] = w
    width = width - wasted
    linear = kind >= 32
    order = np.where(linear, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise ValueError("reserved subframe type")
    most = int(n.max())
    x = np.zeros((most, len(frames)), np.int64)  # a row per sample, so that a step is contiguous
    for j in range(int(order.max())):
        some = order > j
        x[j, some] = signed(peek(at[some], width[some]), width[some])
        at[some] += width[some]
    coefficients, shift = np.zeros((32, len(frames)), np.int64), np.zeros(len(frames), np.int64)
    precision = np.where(linear, peek(at, 4) + 1, 0)
    shift[linear] = signed(peek(at[linear] + 4, 5), 5)
    at[linear] += 9
    for j in range(int(order[linear].max(initial=0))):
        some = linear & (order > j)
        coefficients[j, some] = signed(peek(at[some], precision[some]), precision[some])
        at[some] += precision[some]
    constant, verbatim = kind == 0, kind == 1
    x[:, constant] = signed(peek(at[constant], width[constant]), width[constant])
    for i in np.flatnonzero(verbatim):
        x[: n[i], i] = signed(peek(at[i] + width[i] * np.arange(n[i]), width[i]), width[i])
    coded = ~constant & ~verbatim
    method, partition = peek(at, 2), peek(at + 2, 4)
    wide = np.where(method == 1, 5, 4)
    rice = peek(at + 6, wide)
    plain = coded & (partition == 0) & (rice < (1 << wide) - 1)
    for i in np.flatnonzero(coded & ~plain):
        x[order[i] : n[i], i] = _partitions(peek, int(at[i]) + 6, int(n[i]), int(order[i]), int(partition[i]), int(wide[i]))
    lanes = np.flatnonzero(plain)
    lanes = lanes[np.argsort(-(n - order)[lanes], kind="stable")]
    _residuals(words, x, lanes, (at + 6 + wide)[lanes], rice[lanes], order[lanes], (n - order)[lanes])
    _restore(x, n, order, linear, coefficients, shift, coded)
    x <<= wasted
    return [x[: n[i], i].astype(np.int32) for i in range(len(frames))]


def _residuals(words: np.ndarray, x: np.ndarray, lanes: np.ndarray, at: np.ndarray, rice: np.ndarray, order: np.ndarray, count: np.ndarray) -> None:
    """One Rice code of each lane a step, into the lane's rows from its order on. Lanes are in falling order of count."""
    found = np.zeros((int(count[0]) if len(count) else 0, len(lanes)), np.int64)
    down, none = (63 - rice).astype(np.uint64), rice == 0
    for step, m in enumerate(np.searchsorted(-count, -np.arange(1, len(found) + 1), "right").tolist()):
        here = at[:m]
        window = words[here >> 3] << (here & 7).astype(np.uint64)
        q = _ZEROS[(window >> np.uint64(48)).astype(np.int64)]
        long = np.flatnonzero(q == 16)
        if len(long):
            for i in long.tolist():  # a quotient of 16 or more
                p = int(here[i]) + 16
                while not (z := int(words[p >> 3]) << (p & 7) & (1 << 64) - 1) >> 48:
                    p += 16
                q[i] = p - int(here[i]) + int(_ZEROS[z >> 48])
            here = here + np.maximum(q - 16, 0)
            window = words[here >> 3] << (here & 7).astype(np.uint64)
        low = (window << (np.minimum(q, 16) + 1).astype(np.uint64)) >> np.uint64(1) >> down[:m]
        u = (q << rice[:m]) | np.where(none[:m], 0, low.astype(np.int64))
        found[step, :m] = (u >> 1) ^ -(u & 1)
        at[:m] = here + np.minimum(q, 16) + 1 + rice[:m]
    for o in np.unique(order):
        some = np.flatnonzero(order == o)
        rows = len(x) - o
        x[o:, lanes[some]] = found[:rows, some] if len(found) >= rows else np.concatenate([found[:, some], np.zeros((rows - len(found), len(some)), np.int64)])


def _partitions(peek, at: int, n: int, order: int, partition: int, wide: int) -> np.ndarray:
    """Residuals of one frame in partitions, each with a parameter or escaped to plain numbers."""
    out: list[int] = []
    read = lambda p, bits: int(peek(np.array([p]), bits)[0])
    for k in range(1 << partition):
        count = (n >> partition) - (order if k == 0 else 0)
        rice = read(at, wide)
        at += wide
        if rice == (1 << wide) - 1:
            bits = read(at, 5)
            at += 5
            for _ in range(count):
                v = read(at, bits)
                out.append(v - (1 << bits) if bits and v >> (bits - 1) else v)
                at += bits
            continue
        for _ in range(count):
            q = 0
            while not read(at, 1):
                at, q = at + 1, q + 1
            u = q << rice | read(at + 1, rice)
            at += 1 + rice
            out.append(u >> 1 ^ -(u & 1))
    return np.array(out, np.int64)


def _restore(x: np.ndarray, n: np.ndarray, order: np.ndarray, linear: np.ndarray, coefficients: np.ndarray, shift: np.ndarray, coded: np.ndarray) -> None:
    """Samples from residuals, in place. Rows beyond a frame's samples are of no use."""
    for o in range(1, 5):  # fixed predictors: sums of sums, beginning with the differences of the first samples
        lanes = np.flatnonzero(coded & ~linear & (order == o))
        if len(lanes):
            part = x[:, lanes]
            heads = [part[:o]]
            for _ in range(o - 1):
                heads.append(np.diff(heads[-1], axis=0))
            part = part[o:]
            for level in range(o - 1, -1, -1):
                part = heads[level][-1] + np.cumsum(part, axis=0)
            x[o:, lanes] = part
    lanes = np.flatnonzero(coded & linear)
    if len(lanes):
        part, c, s = np.ascontiguousarray(x[:, lanes]), coefficients[:, lanes], shift[lanes]
        top = int(order[lanes].max())
        least = order[lanes]
        for t in range(1, int(n[lanes].max())):
            guess = np.zeros(len(lanes), np.int64)
            for j in range(min(top, t)):
                guess += c[j] * part[t - 1 - j]
            part[t] += np.where(t >= least, guess >> s, 0)
        x[:, lanes] = part
