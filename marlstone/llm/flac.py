"""Media columns: lossless FLAC streams held in a binary column.

``encode`` writes mono streams of 8-bit samples in frames of 4,096 samples (constant, verbatim, fixed or linear predictor
with Rice residuals, whichever is least). ``decode_many`` reads any stream of up to 32-bit samples and 8 channels: constant,
verbatim, fixed and linear predictors, both Rice codings with escapes, stereo decorrelation; it verifies the header's
CRC-8, the frame's CRC-16 and the stream's MD5, and yields a PCM block for each frame with its sample offset.

Rice codes are read without a loop over bits: the places of all one-bits are found at once, each is linked to the one
that would end the next code, and the chain from the first is followed in strides by composing that link with itself.
Linear predictors are undone for many frames at once, one sample of each a step.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, LINEAR_ORDER = 4096, 4
PAD_TO, TAIL = 192, 16
#: A byte less this, modulo 256, is its sample: it brings small letters near zero.
SHIFT = 108


class FlacError(ValueError):
    pass


def _table(poly: int, width: int) -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        t = np.where(t & (1 << (width - 1)), (t << 1) ^ poly, t << 1) & ((1 << width) - 1)
    return t


_CRC8, _CRC16 = _table(0x07, 8).tolist(), _table(0x8005, 16)
_SPAN = 512


def _places() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-16 of a byte by how many bytes follow it in a span, and of a CRC's two bytes moved on by a span."""
    rows = [_CRC16]
    for _ in range(_SPAN - 1):
        last = rows[-1]
        rows.append(((last << 8) & 0xFFFF) ^ _CRC16[last >> 8])
    at = np.array(rows, np.uint16)
    return at[::-1].copy(), at[_SPAN - 1], at[_SPAN - 2]


_AT, _HIGH, _LOW = _places()
_FLAT, _ROWS, _HIGH, _LOW = _AT.reshape(-1), np.arange(_SPAN, dtype=np.intp) * 256, _HIGH.tolist(), _LOW.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    """CRC-16 (0x8005, from zero): the spans' own sums at once, then carried over from span to span."""
    b = np.frombuffer(data, np.uint8)
    if len(b) % _SPAN:
        b = np.concatenate((np.zeros(_SPAN - len(b) % _SPAN, np.uint8), b))  # leading zeros change nothing
    own = np.bitwise_xor.reduce(_FLAT.take(b.reshape(-1, _SPAN) + _ROWS), axis=1)
    c = 0
    for x in own.tolist():
        c = _HIGH[c >> 8] ^ _LOW[c & 255] ^ x
    return c


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (5 * k + 6 if k < 6 else 36))
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | (n >> (6 * more))] + [0x80 | (n >> (6 * k)) & 0x3F for k in range(more - 1, -1, -1)])


def _rice(u: np.ndarray, k: int, head: int, skip: int) -> np.ndarray:
    """Bytes of the ``skip`` bits of ``head``, then the Rice codes with parameter k of the unsigned ``u``, then zeros.

    A code's one and remainder reach into three bytes at most, and codes share no bit, so bytes are sums.
    """
    last = np.cumsum((u >> k) + (1 + k), dtype=np.intp) + (skip - 1)  # each code's last bit
    n = (int(last[-1]) >> 3) + 1 if len(u) else (skip + 7) >> 3
    out = np.zeros(n + 2)
    if len(u):
        at = (last >> 3) + 2
        v = ((u & ((1 << k) - 1)) | (1 << k)).astype(np.int32) << (7 - (last & 7))
        for j in range(3 if k > 0 else 1):
            out += np.bincount(at - j, (v >> (8 * j)) & 255, n + 2)
    out = out[2:].astype(np.uint8)
    first = (skip + 7) >> 3
    out[:first] |= np.frombuffer((head << (8 * first - skip)).to_bytes(first, "big"), np.uint8)
    return out


def _best_rice(u: np.ndarray) -> tuple[int, int]:
    """(bits, parameter) of the shortest coding of ``u`` as one partition, of the parameters about its mean, 0 to 14."""
    if not len(u):
        return 0, 0
    guess = max(0, int(int(u.sum(dtype=np.int64)) // len(u) + 1).bit_length() - 1)
    return min((len(u) * (1 + k) + int((u >> k).sum(dtype=np.int64)), k) for k in range(max(0, guess - 1), min(14, guess + 1) + 1))


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> (8 * r.itemsize - 1))


def predictor(x: np.ndarray, order: int = LINEAR_ORDER, precision: int = 8, shift: int = 6) -> tuple | None:
    """(coefficients, precision, shift) of the linear predictor of least squared error of ``x``; None where there is none."""
    if len(x) <= 4 * order:
        return None
    y = x.astype(np.float64)
    r = [float(y[k:] @ y[: len(y) - k]) for k in range(order + 1)]
    a, error = [], r[0]
    for i in range(order):  # Levinson's recursion
        if error <= 0:
            return None
        k = (r[i + 1] - sum(c * r[i - j] for j, c in enumerate(a))) / error
        a = [c - k * a[i - 1 - j] for j, c in enumerate(a)] + [k]
        error *= 1 - k * k
    most = (1 << (precision - 1)) - 1
    coef = tuple(max(-most, min(most, round(c * (1 << shift)))) for c in a)
    return (coef, precision, shift) if any(coef) else None


def _predicted(x: np.ndarray, linear: tuple) -> np.ndarray:
    """What the linear predictor leaves of ``x``."""
    coef, _, shift = linear
    y, order = x.astype(np.int32), len(coef)
    sums = coef[0] * y[order - 1 : -1]
    for i, c in enumerate(coef[1:], 1):
        sums += c * y[order - 1 - i : len(y) - 1 - i]
    return y[order:] - (sums >> shift)


def _frame(x: np.ndarray, number: int, linear: tuple | None = None) -> bytes:
    """One mono frame of 8-bit samples: constant, plain, or by the fixed or linear predictor that is shortest. ``linear``:
    (coefficients, precision, shift) forces a linear predictor."""
    forced = bool(linear) and len(x) > len(linear[0])
    linear = linear if forced else None
    n = len(x)
    head = b"\xff\xf8" + bytes([0x70 if n != BLOCK else 0xC0, 0x02]) + _utf8_number(number)
    head += (n - 1).to_bytes(2, "big") if n != BLOCK else b""
    head += bytes([crc8(head)])
    if linear is None and (x == x[0]).all():
        body = bytes([0, int(x[0]) & 255])
    else:
        order, k, r, extra, skip = -1, 0, x, 0, 0
        if linear is None:
            d = [x]
            while len(d) < min(5, n):
                d.append(d[-1][1:] - d[-1][:-1])
            o = min(range(len(d)), key=lambda o: int(np.abs(d[o][4:]).sum(dtype=np.int64)) if n > 4 else o)
            size, k = _best_rice(_zigzag(d[o]))
            size += 8 * o + 10
            if size < 8 * n:
                order, r = o, d[o]
            guess = predictor(x)
            if guess:
                rest = _predicted(x, guess)
                bits, own = _best_rice(_zigzag(rest))
                if bits + len(guess[0]) * (8 + guess[1]) + 19 < min(size, 8 * n):
                    linear, r, k = guess, rest, own
        if linear is not None:
            coef, precision, shift = linear
            order = len(coef)
            if forced:
                r = _predicted(x, linear)
                k = _best_rice(_zigzag(r))[1]
            extra, skip = ((precision - 1) << 5) | shift, 9
            for c in coef:
                extra, skip = (extra << precision) | (c & ((1 << precision) - 1)), skip + precision
        if order < 0:
            body = bytes([2]) + x.astype(np.int8).tobytes()
        else:
            kind = (0b001000 | order if linear is None else 0b100000 | (order - 1)) << 1
            front = int.from_bytes(bytes([kind]) + x[:order].astype(np.int8).tobytes(), "big")
            body = _rice(_zigzag(r), k, (((front << skip) | extra) << 10) | k, 8 + 8 * order + skip + 10).tobytes()
    out = head + body
    return out + crc16(out).to_bytes(2, "big")


def encode(payload: bytes, rate: int = 8000, linear: tuple | None = None) -> bytes:
    """``payload`` as signed 8-bit samples (each byte less SHIFT, modulo 256) in a FLAC stream; any length, zero included."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - np.int16(SHIFT)
    x[x > 127] -= 256
    frames = [_frame(x[at : at + BLOCK], i, linear) for i, at in enumerate(range(0, len(x), BLOCK))]
    sizes = [len(f) for f in frames] or [0]
    packed = (rate << 44) | (0 << 41) | (7 << 36) | len(x)
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big")
    info += hashlib.md5(x.astype(np.int8).tobytes()).digest()
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


class _Reader:
    """Bits of a stream from a byte on; single fields are read from the bytes, runs of codes in bulk."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, width: int) -> int:
        if not width:
            return 0
        first, last = self.at >> 3, (self.at + width + 7) >> 3
        if last > len(self.data):
            raise FlacError("the stream ends within a frame")
        value = int.from_bytes(self.data[first:last], "big") >> ((last << 3) - self.at - width)
        self.at += width
        return value & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        v = self.take(width)
        return v - (1 << width) if width and v >> (width - 1) else v

    def plain(self, n: int, width: int) -> np.ndarray:
        """``n`` signed numbers of ``width`` bits each."""
        if not width or not n:
            return np.zeros(n, np.int64)
        first, last = self.at >> 3, (self.at + n * width + 7) >> 3
        if last > len(self.data):
            raise FlacError("the stream ends within a frame")
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, last - first, first))[self.at & 7 :][: n * width]
        self.at += n * width
        v = bits.reshape(n, width).astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        return np.where(v >> (width - 1), v - (1 << width), v)

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n

    def rice(self, n: int, k: int) -> np.ndarray:
        """``n`` Rice codes with parameter k, as signed residuals."""
        if not n:
            return np.zeros(0, np.int64)
        span = n * (k + 4) + 64
        while True:
            first = self.at >> 3
            last = min(len(self.data), (self.at + span + 7) >> 3)
            raw = np.frombuffer(self.data, np.uint8, last - first, first)
            bits = np.unpackbits(raw)[self.at & 7 :]
            stops = self._stops(bits, n, k)
            if stops is not None:
                break
            if last == len(self.data):
                raise FlacError("the stream ends within a residual")
            span *= 2
        wide = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.int32)
        three = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        u = stops.copy()
        u[1:] -= stops[:-1] + (1 + k)
        if k:
            u <<= k
            for done in range(0, k, 16):  # up to 16 bits lie in three bytes
                width = min(16, k - done)
                at = stops + (1 + done + (self.at & 7))
                u |= ((three.take(at >> 3) >> (24 - width - (at & 7))) & ((1 << width) - 1)) << (k - done - width)
        self.at += int(stops[-1]) + 1 + k
        return (u >> 1) ^ -(u & 1)

    @staticmethod
    def _stops(bits: np.ndarray, n: int, k: int) -> np.ndarray | None:
        """Places of the one-bits that end the unary parts of ``n`` codes; None if the bits don't reach."""
        ones = np.flatnonzero(bits.view(np.bool_))
        if not len(ones):
            return None
        end = len(ones)
        rank = np.empty(len(bits) + k + 2, np.intp)  # one-bits before a place
        rank[0] = 0
        np.cumsum(bits, dtype=np.intp, out=rank[1 : len(bits) + 1])
        rank[len(bits) + 1 :] = end
        link = np.append(rank.take(ones + (1 + k)), end)  # from one code's end to the next one's
        stride, jump = 1, link
        while stride * stride < n and stride < 32:
            jump, stride = jump.take(jump), stride * 2
        heads, at, view = [], 0, memoryview(jump)
        for _ in range(-(-n // stride)):
            heads.append(at)
            at = view[at]
        found = np.empty((stride, len(heads)), np.intp)
        found[0] = heads
        for j in range(1, stride):
            link.take(found[j - 1], out=found[j], mode="clip")
        found = found.T
        found = found.reshape(-1)[:n]
        if found[-1] >= end or int(ones[found[-1]]) + 1 + k > len(bits):
            return None
        return ones[found]


def _residual(r: _Reader, n: int, order: int) -> np.ndarray:
    method = r.take(2)
    if method > 1:
        raise FlacError("unknown residual coding")
    width, escape = (4, 15) if method == 0 else (5, 31)
    parts = r.take(4)
    each = n >> parts
    if each << parts != n or each < order:
        raise FlacError("bad partition order")
    out = []
    for i in range(1 << parts):
        m, k = each - (order if i == 0 else 0), r.take(width)
        out.append(r.plain(m, r.take(5)) if k == escape else r.rice(m, k))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _synthesise(later: list[tuple]) -> None:
    """Fills the samples of linear subframes (out, coefficients, shift, residual, wasted bits), whose warm-up stands in
    ``out``: one step of all subframes of one order at a time, the longest first."""
    by_order: dict[int, list[tuple]] = {}
    for x in later:
        by_order.setdefault(len(x[1]), []).append(x)
    for order, group in by_order.items():
        group.sort(key=lambda x: -len(x[0]))
        n = [len(x[0]) for x in group]
        coef = np.array([x[1] for x in group], np.int64).T.copy()
        shift = np.array([x[2] for x in group], np.int64)
        y = np.zeros((n[0], len(group)), np.int64)
        for i, (out, _, _, rest, _) in enumerate(group):
            y[:order, i], y[order : len(out), i] = out[:order], rest
        left = len(group)
        for t in range(order, n[0]):
            while n[left - 1] <= t:
                left -= 1
            sums = coef[0, :left] * y[t - 1, :left]
            for k in range(1, order):
                sums += coef[k, :left] * y[t - 1 - k, :left]
            sums >>= shift[:left]
            y[t, :left] += sums
        for i, (out, _, _, _, wasted) in enumerate(group):
            out[:] = y[: len(out), i] << wasted


def _subframe(r: _Reader, n: int, width: int, later: list[tuple]) -> np.ndarray:
    """The samples of a subframe; those of a linear one are its warm-up until ``later`` is synthesised."""
    if r.take(1):
        raise FlacError("bad subframe")
    kind = r.take(6)
    wasted = r.unary() + 1 if r.take(1) else 0
    width -= wasted
    if kind == 0:
        x = np.full(n, r.signed(width), np.int64)
    elif kind == 1:
        x = r.plain(n, width)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = r.plain(order, width)
        x = _residual(r, n, order)
        # undone by running sums, each started from the warm-up's differences of its order
        for o in range(order - 1, -1, -1):
            seeds = np.diff(warm, n=o)[:1] if o else warm[:1]
            x = np.cumsum(np.concatenate((seeds, x)))
    elif kind >= 32:
        order = kind - 31
        warm = r.plain(order, width)
        precision = r.take(4) + 1
        shift = r.signed(5)
        if precision == 16 or shift < 0:
            raise FlacError("bad predictor")
        coef = [r.signed(precision) for _ in range(order)]
        x = np.zeros(n, np.int64)
        x[:order] = warm
        later.append((x, coef, shift, _residual(r, n, order), wasted))
        return x
    else:
        raise FlacError("reserved subframe")
    return x << wasted


def stream_info(data: bytes) -> dict:
    """Sample rate, channels, bits, samples, MD5 and the first frame's byte of a stream."""
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(data):
            raise FlacError("the stream ends in its metadata")
        last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            b = data[at + 4 : at + 4 + size]
            packed = int.from_bytes(b[10:18], "big")
            info = {"rate": packed >> 44, "channels": ((packed >> 41) & 7) + 1, "bits": ((packed >> 36) & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": b[18:34], "block": int.from_bytes(b[0:2], "big")}
        at += 4 + size
    if info is None:
        raise FlacError("no stream information")
    return info | {"first": at}


_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _frames(data: bytes, info: dict, later: list[tuple]) -> Iterator[tuple[int, int, int, list[np.ndarray], bool]]:
    """(frame number, sample offset, channel code, subframes, whether it is the last) of a stream; checksums are verified."""
    at, offset, number = info["first"], 0, 0
    while at < len(data):
        h = data[at : at + 16]
        if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8:
            raise FlacError(f"no frame at byte {at}")
        block, rate, channels, bits = h[2] >> 4, h[2] & 15, h[3] >> 4, (h[3] >> 1) & 7
        more = 0 if h[4] < 0x80 else 8 - (h[4] ^ 0xFF).bit_length() - 1
        end = 5 + more
        if block == 6:
            n, end = h[end] + 1, end + 1
        elif block == 7:
            n, end = int.from_bytes(h[end : end + 2], "big") + 1, end + 2
        elif block == 0:
            raise FlacError("reserved block size")
        else:
            n = 192 if block == 1 else 576 << (block - 2) if block < 6 else 256 << (block - 8)
        end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if crc8(h[:end]) != h[end]:
            raise FlacError(f"frame {number}: its header's checksum is wrong")
        width = _BITS.get(bits, info["bits"])
        r = _Reader(data, at + end + 1)
        if channels > 10:
            raise FlacError("reserved channels")
        widths = [width] * (channels + 1) if channels < 8 else [width + (channels == 9), width + (channels in (8, 10))]
        x = [_subframe(r, n, w, later) for w in widths]
        stop = (r.at + 7) >> 3
        if stop + 2 > len(data) or crc16(data[at:stop]) != int.from_bytes(data[stop : stop + 2], "big"):
            raise FlacError(f"frame {number}: its checksum is wrong")
        at = stop + 2
        yield number, offset, channels, x, at >= len(data)
        offset, number = offset + n, number + 1
    if info["samples"] and offset != info["samples"]:
        raise FlacError("samples are missing")


def _channels(code: int, x: list[np.ndarray]) -> np.ndarray:
    if code == 8:  # left and side
        x = [x[0], x[0] - x[1]]
    elif code == 9:  # side and right
        x = [x[0] + x[1], x[1]]
    elif code == 10:  # mid and side
        mid = (x[0] << 1) | (x[1] & 1)
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    return x[0][None] if len(x) == 1 else np.stack(x)


def decode_many(streams, hold: int = 512) -> Iterator[tuple]:
    """(tag, info, frame number, sample offset, samples as channels x n) for each frame of ``streams``, pairs of a tag and a
    stream, in order; raises FlacError where a checksum fails. ``hold`` frames are in memory at a time."""
    held, later = [], []

    def done() -> Iterator[tuple]:
        _synthesise(later)
        for tag, info, md5, number, offset, code, x, is_last in held:
            pcm = _channels(code, x)
            md5.update(_interleaved(pcm, -(-info["bits"] // 8)))
            if is_last and any(info["md5"]) and md5.digest() != info["md5"]:
                raise FlacError("the MD5 of the samples is wrong")
            yield tag, info, number, offset, pcm
        held.clear()
        later.clear()

    for tag, data in streams:
        info, md5 = stream_info(data), hashlib.md5()
        for number, offset, code, x, is_last in _frames(data, info, later):
            held.append((tag, info, md5, number, offset, code, x, is_last))
            if len(held) == hold:
                yield from done()
    yield from done()


def decode_frames(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(frame number, sample offset, samples as channels x n) for each frame; raises FlacError where a checksum fails."""
    for _, _, number, offset, pcm in decode_many([(None, data)]):
        yield number, offset, pcm


def _interleaved(pcm: np.ndarray, size: int) -> bytes:
    flat = pcm.T.reshape(-1)
    if size == 1:
        return flat.astype(np.int8).tobytes()
    return flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per frame of each stream: key, block, sample_offset, n_samples, channels, rate, bits, pcm (little-endian,
    interleaved), and the columns ``keep`` of its row. Seek by sample_offset. Null streams give no rows; a damaged stream
    raises FlacError. Rows of equal keys are read each by itself; a stream's blocks stand together, in order."""
    names = ["key", "block", "sample_offset", "n_samples", "channels", "rate", "bits", "pcm", *keep]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[b.schema.field(i).type for i in range(2, 2 + len(keep))]]
            rows, held = [], 0
            own = list(zip(*[b.column(i).to_pylist() for i in (0, *range(2, 2 + len(keep)))], strict=True))
            for row, info, number, offset, pcm in decode_many((r, d.as_py()) for r, d in zip(own, b.column(1), strict=True) if d.is_valid):
                rows.append((row[0], number, offset, pcm.shape[1], pcm.shape[0], info["rate"], info["bits"], _interleaved(pcm, -(-info["bits"] // 8)), *row[1:]))
                held += len(rows[-1][7])
                if held > 2 << 20:
                    yield _batch(rows, kinds, names)
                    rows, held = [], 0
            yield _batch(rows, kinds, names)

    kinds = {f.name: f.dataType.simpleString() for f in media.schema}
    more = "".join(f", {c} {kinds[c]}" for c in keep)
    out = media.select(F.col(key).alias("key"), F.col(column).alias("media"), *keep).mapInArrow(
        read, f"key {kinds[key]}, block int, sample_offset long, n_samples int, channels int, rate int, bits int, pcm binary{more}"
    )
    return out.withColumnRenamed("key", key)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """``rows`` by their exact values: ids never pass through floating point."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload): UTF-8, then bytes 32 up to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % PAD_TO if raw else PAD_TO)


def feature(pcm: np.ndarray) -> str:
    """Peak, mean energy, zero crossings of the signal about its mean, and frames' loudest and quietest energy."""
    x = pcm.astype(np.int64)
    d = x - int(x.sum()) // len(x)
    crossings = int(np.count_nonzero(np.signbit(d[1:]) != np.signbit(d[:-1])))
    return f"peak={int(np.abs(x).max())};energy={int((x * x).sum()) // len(x)};crossings={crossings};low={int(x.min())};high={int(x.max())}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of ``docs`` (doc_id, text) as a FLAC stream of its padded bytes.

    Null texts are stored as empty ones; any doc_id, null ones too, goes through as it is; repeated rows each come back.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [padded(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in pairs], pa.int64()), pa.array([encode(p) for _, p in pairs], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(write, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of the streams whose
    ``blocks`` (of ``pcm_blocks``, with the columns n_bytes, media_bytes and media_sha256) are put together by sample offset.

    The blocks come straight from ``pcm_blocks``, so a stream's stand together; a gap in their offsets is an error. One row
    per stream: null texts were stored as empty ones (192 blanks), repeated rows each have theirs, equal texts equal values.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parts, own, at, kinds = [], [], None, 0, None

        def close() -> None:
            pcm = np.frombuffer(b"".join(parts), np.int8)
            payload = (pcm.astype(np.int16) + SHIFT).astype(np.uint8).tobytes()
            out.append((own[0], own[1], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), own[2], own[3], feature(pcm)))

        for b in batches:
            kinds = [b.schema.field(0).type, *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2, pa.string(), pa.string()]
            for doc, n, size, sha, offset, samples, pcm in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if offset == 0 and own is not None:
                    close()
                if offset == 0:
                    parts, own, at = [], (doc, n, size, sha), 0
                if offset != at:
                    raise FlacError(f"samples {at} to {offset} are missing")
                parts.append(pcm)
                at += samples
            yield _batch(out, kinds, names)
            out.clear()
        if own is not None:
            close()
            yield _batch(out, kinds, names)

    kind = blocks.schema["doc_id"].dataType.simpleString()
    rows = blocks.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "sample_offset", "n_samples", "pcm")
    return rows.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def features(media: DataFrame) -> DataFrame:
    """``digests`` of the streams of ``media`` (doc_id, n_bytes, media), read through their PCM blocks."""
    known = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return digests(pcm_blocks(known, keep=("n_bytes", "media_bytes", "media_sha256")))


def op9_media(spark, sf_dir: str) -> DataFrame:
    return features(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
