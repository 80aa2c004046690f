"""Progressive JPEG media columns.

A payload of n * 64 bytes is stored without loss in the coefficients of a progressive JPEG, 64 bytes to
a block in zigzag order, six blocks (four luma, two chroma) to a unit of 16 x 16 pixels; units are
filled up with zeros.  The quantisation table is all ones, so a coefficient is what was put in: the first
of a block is byte - 128, the others are byte if byte >= 128 else byte - 255, the values of eight bits
in JPEG's sense.  The scans are
  1. the first coefficients, shifted by one bit, as differences (interleaved),
  2. for each component the bands 1-31 and 32-63, shifted by one bit,
  3. the first coefficients' last bit (interleaved),
  4. for each component the last bit of coefficients 1-63.
The Huffman codes are such that a code and its extra bits together always fill eight bits (scans 1
and 2), so that numpy reads and writes whole scans at once.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays.
It reads any such file of one or three components with 8-bit samples; scans of the layout above take
the fast way, all others go symbol by symbol.  Then it dequantises, inverse-transforms in numpy,
upsamples chroma and gives a full-resolution RGB tensor.

Null and empty texts are 64 zero bytes.  Texts of any length are stored whole: beyond 4,095 units the
picture gets wider.  Equal texts have equal bytes, hashes and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcodes as tc

UNIT = 64
MOST_UNITS = 4_095  #: units of 16 pixels in one direction


def _zigzag() -> np.ndarray:
    """Place in the block, row by row, of the k-th coefficient."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()
_BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: (64 coefficients in zigzag order) @ _KERNEL = 64 samples
_KERNEL = np.kron(_BASIS, _BASIS)[ZIGZAG].astype(np.float32)

# A difference of category s takes a code of 8 - s bits (7 - s ones and a zero) and s more bits.
_DIFF = np.zeros(255, dtype=np.uint8)
_UNDIFF = np.zeros(256, dtype=np.int16)
for _d in range(-127, 128):
    _s = abs(_d).bit_length()
    _code = (((1 << 7 - _s) - 1) << 1 << _s) | (_d if _d >= 0 else _d + (1 << _s) - 1)
    _DIFF[_d + 127] = _code
    _UNDIFF[_code] = _d

_DC_TABLE = bytes([1] * 8 + [0] * 8) + bytes(range(7, -1, -1))
_AC_FIRST = bytes([1] + [0] * 15) + b"\x07"
_AC_LAST = bytes([1] + [0] * 15) + b"\x00"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(comps: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(comps)]) + b"".join(bytes([c, t]) for c, t in comps) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _bits(bits: np.ndarray) -> bytes:
    """Bits to bytes, the last one filled up with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, dtype=np.uint8)])).tobytes()


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload, whose length is a positive multiple of 64."""
    units = -(-len(payload) // (6 * UNIT))
    wide = -(-units // MOST_UNITS)
    tall = -(-units // wide)
    data = np.zeros(wide * tall * 6 * UNIT, dtype=np.uint8)
    data[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    mcu = data.reshape(tall, wide, 6, UNIT)
    dc = mcu[..., 0].astype(np.int16) - 128
    planes = [mcu[:, :, :4].reshape(tall, wide, 2, 2, UNIT).transpose(0, 2, 1, 3, 4).reshape(-1, UNIT), mcu[:, :, 4].reshape(-1, UNIT), mcu[:, :, 5].reshape(-1, UNIT)]
    first = (dc >> 1).reshape(-1, 6)
    diff = np.empty_like(first)
    luma = first[:, :4].ravel()
    diff[:, :4] = np.diff(luma, prepend=np.int16(0)).reshape(-1, 4)
    diff[:, 4:] = np.diff(first[:, 4:], axis=0, prepend=np.zeros((1, 2), np.int16))
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * tall, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xC4, b"\x00" + _DC_TABLE) + _segment(0xC4, b"\x10" + _AC_FIRST))
    every = [(1, 0), (2, 0), (3, 0)]
    out.append(_scan(every, 0, 0, 0, 1, _DIFF[diff.ravel() + 127].tobytes()))
    for lo, hi in ((1, 31), (32, 63)):
        for c, plane in enumerate(planes):
            out.append(_scan([(c + 1, 0)], lo, hi, 0, 1, (plane[:, lo : hi + 1] >> 1).tobytes()))
    out.append(_scan(every, 0, 0, 1, 0, _bits((dc & 1).astype(np.uint8).ravel())))
    out.append(_segment(0xC4, b"\x10" + _AC_LAST))
    for c, plane in enumerate(planes):
        bits = (plane & 1) ^ (plane < 128)
        bits[:, 0] = 0  # the code of the band's end
        out.append(_scan([(c + 1, 0)], 1, 63, 1, 0, np.packbits(bits, axis=1).tobytes()))
    return b"".join([*out, b"\xff\xd9"])


class Picture:
    """The coefficient arrays of a progressive JPEG, filled scan by scan."""

    def __init__(self, jpeg: bytes):
        self.comment, self.quant, self.tables = b"", {}, {}
        at = 2
        while True:
            marker = jpeg[at + 1]
            if marker == 0xD9:
                return
            size = struct.unpack_from(">H", jpeg, at + 2)[0]
            body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
                self.h, self.v = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
                self.tall, self.wide = -(-self.height // (8 * self.v)), -(-self.width // (8 * self.h))
                self.coefs = {c: np.zeros((self.tall * p[1], self.wide * p[0], 64), dtype=np.int16) for c, p in self.parts.items()}
            elif marker == 0xDA:
                end = at
                while True:
                    end = jpeg.index(b"\xff", end)
                    if jpeg[end + 1] != 0:
                        break
                    end += 2
                self._scan(body, jpeg[at:end].replace(b"\xff\x00", b"\xff"))
                at = end

    def _blocks(self, comps: list[int]) -> list[tuple[int, int, int]]:
        """(component, block row, block column) in the order of a scan."""
        if len(comps) == 1:
            c = comps[0]
            h, v, _ = self.parts[c]
            rows, cols = -(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8)
            return [(c, y, x) for y in range(rows) for x in range(cols)]
        return [(c, my * self.parts[c][1] + y, mx * self.parts[c][0] + x) for my in range(self.tall) for mx in range(self.wide) for c in comps for y in range(self.parts[c][1]) for x in range(self.parts[c][0])]

    def _scan(self, head: bytes, data: bytes) -> None:
        comps = [head[1 + 2 * i] for i in range(head[0])]
        ids = {head[1 + 2 * i]: head[2 + 2 * i] for i in range(head[0])}
        first, last, approx = head[-3:]
        high, low = approx >> 4, approx & 15
        raw = np.frombuffer(data, dtype=np.uint8)
        ours = list(self.parts.values()) == [(2, 2, 0), (1, 1, 0), (1, 1, 0)] and self.height % 16 == self.width % 16 == 0
        if ours and first == 0 and len(comps) == 3 and (high or self.tables.get(0) == _DC_TABLE and not any(t >> 4 for t in ids.values())):
            units = self.tall * self.wide
            if high:
                bits = np.unpackbits(raw)[: 6 * units].reshape(units, 6).astype(np.int16) << low
                self._put(comps, bits, add=True)
            else:
                diff = _UNDIFF[raw].reshape(units, 6)
                value = np.empty_like(diff)
                value[:, :4] = np.cumsum(diff[:, :4].ravel()).reshape(-1, 4)
                value[:, 4:] = np.cumsum(diff[:, 4:], axis=0)
                self._put(comps, value << low, add=False)
        elif ours and first and not high and self.tables.get(0x10) == _AC_FIRST and not ids[comps[0]] & 15:
            coef = self.coefs[comps[0]]
            x = raw.reshape(*coef.shape[:2], last - first + 1).astype(np.int16)
            coef[..., first : last + 1] = np.where(x >= 64, x, x - 127) << low
        elif ours and first == 1 and last == 63 and high and self.tables.get(0x10) == _AC_LAST and (self.coefs[comps[0]][..., 1:] != 0).all():
            coef = self.coefs[comps[0]]
            bits = np.unpackbits(raw).reshape(*coef.shape[:2], 64)[..., 1:].astype(np.int16) << low
            coef[..., 1:] += np.where(coef[..., 1:] > 0, bits, -bits)
        else:
            self._symbols(comps, ids, first, last, high, low, raw)

    def _put(self, comps: list[int], values: np.ndarray, add: bool) -> None:
        """First coefficients, (units, 6), to their blocks."""
        grid = values.reshape(self.tall, self.wide, 6)
        luma = grid[..., :4].reshape(self.tall, self.wide, 2, 2).transpose(0, 2, 1, 3).reshape(2 * self.tall, 2 * self.wide)
        for c, v in zip(comps, (luma, grid[..., 4], grid[..., 5]), strict=True):
            self.coefs[c][..., 0] = self.coefs[c][..., 0] | v if add else v

    def _symbols(self, comps, ids, first, last, high, low, raw) -> None:
        """Any scan, symbol by symbol."""
        bits = iter(np.unpackbits(raw).tolist())

        def take(n: int) -> int:
            out = 0
            for _ in range(n):
                out = out << 1 | next(bits)
            return out

        def codes(table: bytes) -> dict[tuple[int, int], int]:
            out, code, k = {}, 0, 16
            for length in range(1, 17):
                for _ in range(table[length - 1]):
                    out[length, code] = table[k]
                    code, k = code + 1, k + 1
                code <<= 1
            return out

        def symbol(known) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | next(bits)
                if (length, code) in known:
                    return known[length, code]
            raise ValueError("no such Huffman code")

        def extend(s: int) -> int:
            x = take(s)
            return x if not s or x >> s - 1 else x - (1 << s) + 1

        before, skip = dict.fromkeys(comps, 0), 0
        known = {c: codes(self.tables[(0x10 if first else 0) | (ids[c] & 15 if first else ids[c] >> 4)]) for c in comps if first or not high}
        for c, y, x in self._blocks(comps):
            block = self.coefs[c][y, x]
            if first == 0:
                if high:
                    block[0] |= next(bits) << low
                else:
                    before[c] += extend(symbol(known[c]))
                    block[0] = before[c] << low
                continue
            k = first
            if not skip:
                while k <= last:
                    s = symbol(known[c])
                    run, size = s >> 4, s & 15
                    if not size and run < 15:
                        skip = (1 << run) + take(run)
                        break
                    value = 0
                    if size:
                        value = (1 << low if next(bits) else -1 << low) if high else extend(size) << low
                    while k <= last:
                        if high and block[k]:
                            self._refine(block, k, next(bits), low)
                        elif run:
                            run -= 1
                        else:
                            block[k] = value
                            k += 1
                            break
                        k += 1
            if skip:
                if high:
                    for j in range(k, last + 1):
                        if block[j]:
                            self._refine(block, j, next(bits), low)
                skip -= 1

    @staticmethod
    def _refine(block, k: int, bit: int, low: int) -> None:
        if bit:
            block[k] += (1 if block[k] > 0 else -1) << low

    def payload(self) -> bytes:
        """The bytes that encode() put in."""
        y, cb, cr = (self.coefs[c] for c in self.parts)
        mcu = np.empty((self.tall, self.wide, 6, UNIT), dtype=np.int16)
        mcu[:, :, :4] = y.reshape(self.tall, 2, self.wide, 2, UNIT).transpose(0, 2, 1, 3, 4).reshape(self.tall, self.wide, 4, UNIT)
        mcu[:, :, 4], mcu[:, :, 5] = cb, cr
        out = np.where(mcu > 0, mcu, mcu + 255)
        out[..., 0] = mcu[..., 0] + 128
        return out.astype(np.uint8).tobytes()[: int(self.comment.split()[1])]

    def rgb(self) -> np.ndarray:
        """(height, width, 3) of 8-bit samples."""
        planes = []
        for c, (h, v, q) in self.parts.items():
            coef = self.coefs[c]
            rows, cols = coef.shape[:2]
            samples = (coef.reshape(-1, 64) * self.quant[q]).astype(np.float32) @ _KERNEL
            plane = samples.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            planes.append(np.repeat(np.repeat(plane, self.v // v, axis=0), self.h // h, axis=1)[: self.height, : self.width])
        if len(planes) == 1:
            planes = [planes[0], np.zeros_like(planes[0]), np.zeros_like(planes[0])]
        y, cb, cr = planes
        y = y + np.float32(128.5)
        out = np.empty((self.height, self.width, 3), dtype=np.uint8)
        out[..., 0] = np.clip(y + np.float32(1.402) * cr, 0, 255)
        out[..., 1] = np.clip(y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, 0, 255)
        out[..., 2] = np.clip(y + np.float32(1.772) * cb, 0, 255)
        return out


def feature(rgb: np.ndarray) -> str:
    """Size, and the mean of each channel over the whole picture to three places."""
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (rgb.shape[0] * rgb.shape[1])
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ",".join(f"{m:.3f}" for m in means)


def media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the JPEG of each text."""

    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "text", 1 << 20):
                data, at = tc.column_bytes(part.column("text"))
                made = [encode(padded(data[at[i] : at[i + 1]].tobytes())) for i in range(part.num_rows)]
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(at)), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tensors(stored: DataFrame) -> DataFrame:
    """The rows of media() with payload (read back), height, width and rgb, the full-resolution tensor's bytes."""

    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "media", 1 << 20):
                pictures = [Picture(m) for m in part.column("media").to_pylist()]
                yield pa.record_batch(
                    [*part.columns, pa.array([p.payload() for p in pictures], pa.binary()), pa.array([p.height for p in pictures], pa.int32()), pa.array([p.width for p in pictures], pa.int32()), pa.array([p.rgb().tobytes() for p in pictures], pa.binary())],
                    names=[*part.schema.names, "payload", "height", "width", "rgb"],
                )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary")


def media_digest(stored: DataFrame) -> DataFrame:
    """The digests of payload, stored form and tensor of the rows of media(), all from the stored bytes.

    One picture is decoded at a time, and its tensor goes before the next."""

    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "media", 1 << 20):
                rows = []
                for i in range(part.num_rows):
                    jpeg = part.column("media")[i].as_py()
                    p = Picture(jpeg)
                    back = p.payload()
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(jpeg), hashlib.sha256(jpeg).hexdigest(), feature(p.rgb())))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
