"""Media columns: progressive JPEG, encoded and decoded by numpy over whole batches of images.

A payload's bytes become the quantised coefficients of a three-component 4:2:0 image (quantiser 1), so storing and reading
them back is lossless.  Scans use spectral selection (DC, AC 1-5, AC 6-63) and successive approximation (DC and AC 1-5 in two
steps).  With restart intervals every interval is a lane: a step decodes one symbol of all lanes of a scan at once, by a table
over 16 bits, and the scans accumulate in coefficient arrays.  Pixels come from an inverse transform with a whole-number
basis (exact in any order of summation), chroma repeated to full resolution, as an RGB tensor.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.common import arrow_limits, pick

#: Payload unit, coefficients of an MCU (4 Y, Cb, Cr blocks), the byte that becomes coefficient 0, MCUs in a row at most.
UNIT, MCU, CENTRE, WIDEST = 576, 384, 110, 4095
#: Payload bytes, blocks and lanes worked on together; bounds memory for very long texts.
GROUP, BLOCKS, LANES = 1_000_000, 2_048, 4_096
#: (first, last, high, low) of the scans, each over every component.
SCRIPT = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 0), (0, 0, 1, 0), (1, 5, 1, 0))


def zigzag() -> np.ndarray:
    """Row-major place of each zigzag index."""
    cells = [(u, v) for u in range(8) for v in range(8)]
    cells.sort(key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([u * 8 + v for u, v in cells])


ZIGZAG = zigzag()


def huffman(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(DHT body, symbol -> (code, length)) of a canonical code."""
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, before = {}, 0, 0
    for s in ordered:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s] = (code, before)
        code += 1
    counts = [sum(n == i for n in lengths.values()) for i in range(1, 17)]
    return bytes(counts) + bytes(ordered), codes


DC_BODY, DC_CODES = huffman(dict.fromkeys(range(12), 4))
_SHORT = [0, *range(1, 9)]  # end of block and run 0 with sizes 1-8
AC_BODY, AC_CODES = huffman({s: 4 if s in _SHORT else 9 for s in [0, 240, *(r << 4 | n for r in range(16) for n in range(1, 11))]})
_AC_CODE, _AC_LEN = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
for _s, (_c, _n) in AC_CODES.items():
    _AC_CODE[_s], _AC_LEN[_s] = _c, _n
_SIZE = np.array([int(x).bit_length() for x in range(4096)], dtype=np.int64)


@lru_cache(maxsize=64)
def decode_table(body: bytes) -> np.ndarray:
    """Code length << 8 | symbol for each 16 bits that begin with a code."""
    table, code, at = np.zeros(1 << 16, dtype=np.uint32), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


@lru_cache(maxsize=4096)
def payload_blocks(wide: int, high: int) -> np.ndarray:
    """For a grid of MCUs, the component-major raster place of each block in MCU order."""
    y, x = np.divmod(np.arange(wide * high), wide)
    luma = [(2 * y + r) * 2 * wide + 2 * x + c for r in (0, 1) for c in (0, 1)]
    n = 4 * wide * high
    return np.stack([*luma, n + y * wide + x, n + wide * high + y * wide + x], axis=1).reshape(-1)


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its payload): UTF-8, then bytes 255 up to a positive multiple of UNIT; null as the empty text."""
    raw = text.encode() if text else b""
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


# ---- writing


def _pack(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes per row): the bits of each row (at most 24 in a cell), each row filled with ones to whole bytes."""
    total = lengths.sum(axis=1)
    fill = -total % 8
    values = np.concatenate((values, ((1 << fill) - 1)[:, None]), axis=1)
    lengths = np.concatenate((lengths, fill[:, None]), axis=1)
    sizes = (total + fill) // 8
    starts = np.cumsum(sizes) - sizes
    on = lengths > 0
    bits = (np.cumsum(lengths, axis=1) - lengths + 8 * starts[:, None])[on]
    word = values[on] << (32 - bits % 8 - lengths[on])
    at, n = bits >> 3, int(sizes.sum()) + 4
    out = np.zeros(n)
    for j in range(4):
        out += np.bincount(at + j, weights=(word >> (24 - 8 * j)) & 255, minlength=n)
    return out[: n - 4].astype(np.uint8), sizes


def _scan_bits(v: np.ndarray, first: int, last: int, high: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of the cells of each block, from its coefficients in zigzag order, one block an interval."""
    n, band = len(v), range(first, last + 1)
    if last == 0:
        if high:
            return (v[:, :1] >> low & 1).astype(np.int64), np.ones((n, 1), dtype=np.int64)
        x = (v[:, 0] >> low).astype(np.int64)
        size = _SIZE[np.abs(x)]
        codes = np.array([DC_CODES[s][0] for s in range(12)])
        bits = np.where(x < 0, x + (1 << size) - 1, x)
        return (codes[size] << size | bits)[:, None], (4 + size)[:, None]
    mag = np.abs(v[:, first : last + 1]).astype(np.int64) >> low
    negative = v[:, first : last + 1] < 0
    run = np.zeros(n, dtype=np.int64)
    width = len(band)
    if not high:
        values, lengths = np.zeros((n, width + 1), dtype=np.int64), np.zeros((n, width + 1), dtype=np.int64)
        set_ = mag > 0
        final = np.where(set_.any(axis=1), width - 1 - np.argmax(set_[:, ::-1], axis=1), -1)
        size = _SIZE[mag]
        bits = np.where(negative, (1 << size) - 1 - mag, mag)
        for k in range(width):
            on = set_[:, k]
            symbol = run << 4 | size[:, k]
            values[:, k] = np.where(on, _AC_CODE[symbol & 255] << size[:, k] | bits[:, k], 0)
            lengths[:, k] = np.where(on, _AC_LEN[symbol & 255] + size[:, k], 0)
            run = np.where(on, 0, run + 1)
            skip = (run == 16) & (k < final)
            if skip.any():
                values[skip, k], lengths[skip, k] = AC_CODES[240]
                run[skip] = 0
        end = final < width - 1
        values[end, width], lengths[end, width] = AC_CODES[0]
        return values, lengths
    # refinement: each new coefficient's code and sign, then a bit for each older one passed on the way
    values, lengths = np.zeros((n, 2 * width + 2), dtype=np.int64), np.zeros((n, 2 * width + 2), dtype=np.int64)
    held, count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for k in range(width):
        old, new = mag[:, k] > 1, mag[:, k] == 1
        held, count = np.where(old, held << 1 | mag[:, k] & 1, held), count + old
        symbol = run << 4 | 1
        values[:, 2 * k] = np.where(new, _AC_CODE[symbol] << 1 | ~negative[:, k], 0)
        lengths[:, 2 * k] = np.where(new, _AC_LEN[symbol] + 1, 0)
        values[:, 2 * k + 1], lengths[:, 2 * k + 1] = np.where(new, held, 0), np.where(new, count, 0)
        held, count = np.where(new, 0, held), np.where(new, 0, count)
        run = np.where(new, 0, run + (mag[:, k] == 0))
    end = mag[:, width - 1] != 1
    values[end, 2 * width], lengths[end, 2 * width] = AC_CODES[0]
    values[:, 2 * width + 1], lengths[:, 2 * width + 1] = np.where(end, held, 0), np.where(end, count, 0)
    return values, lengths


def _entropy(v: np.ndarray, spec: tuple[int, int, int, int], within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each block in them): stuffed, a restart marker after each block; within: a block's number in its image."""
    parts, sizes = [], []
    for at in range(0, len(v), BLOCKS):
        data, size = _pack(*_scan_bits(v[at : at + BLOCKS], *spec))
        parts.append(data)
        sizes.append(size)
    data, size = np.concatenate(parts), np.concatenate(sizes)
    full = data == 255
    ends = np.cumsum(size)
    stuffed = np.concatenate(([0], np.cumsum(full)))
    out = np.zeros(len(data) + int(stuffed[-1]) + 2 * len(v), dtype=np.uint8)
    out[np.arange(len(data)) + stuffed[:-1] + 2 * np.repeat(np.arange(len(v)), size)] = data
    stops = ends + stuffed[ends] + 2 * np.arange(1, len(v) + 1)
    out[stops - 2], out[stops - 1] = 255, 0xD0 + within % 8
    return out, stops


def _segment(code: int, body: bytes) -> bytes:
    return bytes((255, code)) + struct.pack(">H", len(body) + 2) + body


def encode_images(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG of each payload; its length is kept in the comment."""
    grids, coefficients = [], []
    for p in payloads:
        mcus = -(-len(p) // MCU)
        wide = min(WIDEST, max(1, round(mcus**0.5)))
        high = -(-mcus // wide)
        flat = np.zeros(wide * high * MCU, dtype=np.int16)
        flat[: len(p)] = np.frombuffer(p, dtype=np.uint8).astype(np.int16) - CENTRE
        flat[flat > 127] -= 256
        raster = np.empty((wide * high * 6, 64), dtype=np.int16)
        raster[payload_blocks(wide, high)] = flat.reshape(-1, 64)
        grids.append((wide, high))
        coefficients.append(raster)
    streams: list[list[bytes]] = [[] for _ in payloads]
    for spec in SCRIPT:
        for c in range(3):
            own = [x[s] for x, (w, h) in zip(coefficients, grids, strict=True) for s in [(slice(0, 4 * w * h), slice(4 * w * h, 5 * w * h), slice(5 * w * h, 6 * w * h))[c]]]
            counts = [len(x) for x in own]
            data, stops = _entropy(np.concatenate(own), spec, np.concatenate([np.arange(n) for n in counts]))
            raw, at, block = data.tobytes(), 0, 0
            head = _segment(0xDA, bytes((1, c + 1, 0, spec[0], spec[1], spec[2] << 4 | spec[3])))
            for stream, n in zip(streams, counts, strict=True):
                block += n
                stream.append(head + raw[at : int(stops[block - 1]) - 2])
                at = int(stops[block - 1])
    out = []
    for p, (wide, high), stream in zip(payloads, grids, streams, strict=True):
        head = [b"\xff\xd8", _segment(0xFE, f"payload={len(p)}".encode()), _segment(0xDB, b"\0" + b"\1" * 64)]
        head.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))))
        head += [_segment(0xC4, b"\0" + DC_BODY), _segment(0xC4, b"\x10" + AC_BODY), _segment(0xDD, b"\0\1")]
        out.append(b"".join([*head, *stream, b"\xff\xd9"]))
    return out


# ---- reading


class Image:
    """What the headers of one image say, and its scans."""

    def __init__(self) -> None:
        self.comment, self.quant, self.scans, self.parts = b"", {}, [], []

    def frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.h, self.v = max(p[1] for p in parts), max(p[2] for p in parts)
        self.wide, self.high = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        at = 0
        for name, h, v, q in parts:
            self.parts.append({"name": name, "h": h, "v": v, "q": q, "at": at, "cols": self.wide * h, "rows": self.high * v})
            at += self.wide * h * self.high * v
        self.blocks = at

    def order(self, which: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        return scan_order(self.width, self.height, self.h, self.v, tuple((p["h"], p["v"], p["at"], p["cols"]) for p in self.parts), which)


@lru_cache(maxsize=4096)
def scan_order(width: int, height: int, h: int, v: int, parts: tuple[tuple[int, int, int, int], ...], which: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(block places, place of the component in the scan, blocks of an MCU) in the order of a scan of these components.

    parts: sampling factors, first block and blocks in a row of each component.
    """
    wide, high = -(-width // (8 * h)), -(-height // (8 * v))
    if len(which) == 1:
        ph, pv, at, row = parts[which[0]]
        cols, rows = -(-(-(-width * ph // h)) // 8), -(-(-(-height * pv // v)) // 8)
        places = (at + np.arange(rows)[:, None] * row + np.arange(cols)).reshape(-1)
        return places, np.zeros(len(places), dtype=np.int64), 1
    y, x = np.divmod(np.arange(wide * high), wide)
    places, kinds = [], []
    for i, c in enumerate(which):
        ph, pv, at, row = parts[c]
        for r in range(pv):
            for col in range(ph):
                places.append(at + (y * pv + r) * row + x * ph + col)
                kinds.append(i)
    return np.stack(places, axis=1).reshape(-1), np.tile(np.array(kinds), len(y)), len(kinds)


def parse(data: bytes, offset: int, marks: np.ndarray) -> Image:
    """Headers of the image at the start of data; marks: places of markers other than restarts in the batch, offset: data's place there."""
    image, at, tables, restart = Image(), 2, {}, 0
    while data[at + 1] != 0xD9:
        code, size = data[at + 1], data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xFE:
            image.comment = body
        elif code == 0xDD:
            restart = body[0] << 8 | body[1]
        elif code == 0xDB:
            while body:
                deep = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * deep], dtype=">u2" if deep else np.uint8).astype(np.int64)
                body = body[65 + 64 * deep :]
        elif code == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif code == 0xC2:
            image.frame(body)
        elif 0xC0 <= code <= 0xCF:
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif code == 0xDA:
            n = body[0]
            names = [p["name"] for p in image.parts]
            which = [names.index(body[1 + 2 * i]) for i in range(n)]
            first, last, steps = body[1 + 2 * n : 4 + 2 * n]
            kind = [tables.get(body[2 + 2 * i] >> 4 if last == 0 else 16 | body[2 + 2 * i] & 15, b"") for i in range(n)]
            stop = int(marks[np.searchsorted(marks, offset + at)]) - offset
            image.scans.append((tuple(which), tuple(kind), (first, last, steps >> 4, steps & 15), restart, at, stop))
            at = stop
    return image


class Lanes:
    """Restart intervals of one kind of scan, decoded side by side."""

    def __init__(self, words: np.ndarray, bit: np.ndarray, seq: np.ndarray, stop: np.ndarray, order: np.ndarray, kind: np.ndarray) -> None:
        self.words, self.bit, self.seq, self.stop, self.order, self.kind = words, bit, seq, stop, order, kind

    def peek(self, lanes: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        bit = self.bit[lanes]
        window = (self.words[bit >> 3].astype(np.int64) << (bit & 7)) & 0xFFFFFFFF
        return window >> (32 - n)

    def take(self, lanes: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        got = self.peek(lanes, n)
        self.bit[lanes] += n
        return got

    def symbol(self, lanes: np.ndarray, tables: np.ndarray, kind: np.ndarray | int = 0) -> np.ndarray:
        got = tables[kind << 16 | self.peek(lanes, 16)].astype(np.int64)
        self.bit[lanes] += got >> 8
        return got & 255

    def signed(self, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        bits = self.take(lanes, size)
        return np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)

    def dc(self, out: np.ndarray, tables: np.ndarray, low: int) -> None:
        last = np.zeros((len(self.seq), 4), dtype=np.int64)
        lanes = np.flatnonzero(self.seq < self.stop)
        while len(lanes):
            kind = self.kind[self.seq[lanes]]
            last[lanes, kind] += self.signed(lanes, self.symbol(lanes, tables, kind))
            out[self.order[self.seq[lanes]], 0] = last[lanes, kind] << low
            self.seq[lanes] += 1
            lanes = lanes[self.seq[lanes] < self.stop[lanes]]

    def dc_more(self, out: np.ndarray, low: int) -> None:
        lanes = np.flatnonzero(self.seq < self.stop)
        while len(lanes):
            out[self.order[self.seq[lanes]], 0] |= (self.take(lanes, 1) << low).astype(out.dtype)
            self.seq[lanes] += 1
            lanes = lanes[self.seq[lanes] < self.stop[lanes]]

    def ac(self, out: np.ndarray, tables: np.ndarray, first: int, last: int, low: int) -> None:
        place = np.full(len(self.seq), first, dtype=np.int64)
        lanes = np.flatnonzero(self.seq < self.stop)
        while len(lanes):
            symbol = self.symbol(lanes, tables)
            run, size = symbol >> 4, symbol & 15
            none = size == 0
            k = place[lanes] + run
            got = self.signed(lanes, size)
            some = ~none
            out[self.order[self.seq[lanes[some]]], k[some]] = got[some] << low
            k += 1
            if none.any():
                ended = none & (run < 15)
                at = lanes[ended]
                self.seq[at] += (1 << run[ended]) + self.take(at, run[ended])
                k[ended] = first
            over = k > last
            self.seq[lanes] += over
            place[lanes] = np.where(over, first, k)
            lanes = lanes[self.seq[lanes] < self.stop[lanes]]

    def ac_more(self, out: np.ndarray, tables: np.ndarray, first: int, last: int, low: int) -> None:
        n, bit = len(self.seq), 1 << low
        place, run, new, left = np.full(n, first, dtype=np.int64), np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        lanes = np.flatnonzero(self.seq < self.stop)
        while len(lanes):
            ask = lanes[(run[lanes] < 0) & (left[lanes] == 0)]
            if len(ask):
                symbol = self.symbol(ask, tables)
                zeros, size = symbol >> 4, symbol & 15
                ended = (size == 0) & (zeros < 15)
                left[ask[ended]] = (1 << zeros[ended]) + self.take(ask[ended], zeros[ended])
                go = ask[~ended]
                run[go] = zeros[~ended]
                sign = size[~ended] > 0
                new[go] = 0
                new[go[sign]] = np.where(self.take(go[sign], 1) > 0, bit, -bit)
            block, k = self.order[self.seq[lanes]], place[lanes]
            value = out[block, k]
            old = value != 0
            passed = lanes[old]
            if len(passed):
                more = self.take(passed, 1) > 0
                here = value[old]
                out[block[old], k[old]] = here + np.where(more & (np.abs(here) & bit == 0), np.sign(here) * bit, 0).astype(out.dtype)
            fresh = ~old & (left[lanes] == 0)
            put = fresh & (run[lanes] == 0)
            out[block[put], k[put]] = new[lanes[put]]
            run[lanes[fresh]] -= 1
            place[lanes] += 1
            over = lanes[place[lanes] > last]
            place[over] = first
            run[over] = -1
            self.seq[over] += 1
            left[over] = np.maximum(left[over] - 1, 0)
            lanes = lanes[self.seq[lanes] < self.stop[lanes]]


def decode_images(media: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """(headers, coefficients in zigzag order by block) of each image; scans of one kind run together over all images."""
    whole = np.frombuffer(b"".join(media) + b"\0" * 8, dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, media)])
    mark = np.flatnonzero((whole[:-1] == 255) & (whole[1:] != 0) & (whole[1:] != 255))
    restart = (whole[mark + 1] & 0xF8) == 0xD0
    marks, restarts = mark[~restart], mark[restart]
    kept = np.ones(len(whole), dtype=bool)
    kept[1:] = ~((whole[1:] == 0) & (whole[:-1] == 255))
    place = np.cumsum(kept) - 1
    plain = np.concatenate((whole[kept], np.zeros(4, dtype=np.uint8))).astype(np.uint32)
    words = plain[:-3] << 24 | plain[1:-2] << 16 | plain[2:-1] << 8 | plain[3:]
    images = [parse(x, int(at), marks) for x, at in zip(media, offsets, strict=False)]
    base = np.cumsum([0, *(x.blocks for x in images)])
    out = np.zeros((int(base[-1]), 64), dtype=np.int32)
    for step in range(max((len(x.scans) for x in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, x in enumerate(images):
            if step < len(x.scans):
                groups.setdefault(x.scans[step][1:3], []).append(i)
        for (kinds, (first, last, high, low)), members in groups.items():
            bits, seqs, stops, orders, comps, filled = [], [], [], [], [], 0
            for i in members:
                which, _, _, every, start, stop = images[i].scans[step]
                places, comp, per = images[i].order(which)
                a, b = np.searchsorted(restarts, (start + offsets[i], stop + offsets[i]))
                starts = np.concatenate(([start + offsets[i]], restarts[a:b] + 2))
                size = every * per or len(places)
                seq = np.arange(len(starts)) * size
                bits.append(place[starts] * 8)
                seqs.append(filled + seq)
                stops.append(filled + np.minimum(seq + size, len(places)))
                orders.append(places + base[i])
                comps.append(comp)
                filled += len(places)
            bit, seq, stop = np.concatenate(bits), np.concatenate(seqs), np.concatenate(stops)
            order, kind = np.concatenate(orders), np.concatenate(comps)
            tables = np.concatenate([decode_table(x) for x in kinds]) if high == 0 or last else None
            for at in range(0, len(bit), LANES):
                part = slice(at, at + LANES)
                lanes = Lanes(words, bit[part], seq[part], stop[part], order, kind)
                if last == 0 and high == 0:
                    lanes.dc(out, tables, low)
                elif last == 0:
                    lanes.dc_more(out, low)
                elif high == 0:
                    lanes.ac(out, tables, first, last, low)
                else:
                    lanes.ac_more(out, tables, first, last, low)
    return [(x, out[base[i] : base[i + 1]]) for i, x in enumerate(images)]


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """Inverse transform of coefficients in zigzag order, times 2048, in whole numbers."""
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, 0.5**0.5, 1.0)[:, None] / 2
    return np.rint(2048 * np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG])


def tensor(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The image as height x width x 3 bytes (RGB, or its grey value three times)."""
    planes = []
    for p in image.parts:
        own = coefficients[p["at"] : p["at"] + p["rows"] * p["cols"]] * image.quant[p["q"]]
        kind = np.float32 if np.abs(own).max(initial=0) <= 128 else np.float64  # both exact: sums stay under 2**24 and 2**53
        pixels = (own.astype(kind) @ basis().astype(kind)).astype(np.int64)
        pixels = np.clip((pixels + 1024 >> 11) + 128, 0, 255).astype(np.int32)
        plane = pixels.reshape(p["rows"], p["cols"], 8, 8).swapaxes(1, 2).reshape(8 * p["rows"], 8 * p["cols"])
        plane = plane.repeat(image.v // p["v"], axis=0).repeat(image.h // p["h"], axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) < 3:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0] * 65536 + 32768, planes[1] - 128, planes[2] - 128
    rgb = np.stack((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb), axis=2) >> 16
    return np.clip(rgb, 0, 255).astype(np.uint8)


def read_payload(image: Image, coefficients: np.ndarray) -> bytes:
    """The payload that encode_images() stored."""
    size = int(image.comment.partition(b"=")[2])
    flat = coefficients[payload_blocks(image.wide, image.high)].reshape(-1)[:size]
    return ((flat + CENTRE) & 255).astype(np.uint8).tobytes()


def _groups(sizes: list[int]) -> Iterator[slice]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > GROUP:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def with_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a progressive JPEG.  Null and empty texts are one unit of bytes 255."""
    arrow_limits(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            lengths = [len(x) if x is not None else 0 for x in texts.cast(pa.binary()).to_pylist()]
            for part in _groups(lengths):
                some = [padded(x) for x in texts[part].to_pylist()]
                columns = [batch.column("doc_id")[part], pa.array([x[0] for x in some], pa.int64()), pa.array(encode_images([x[1] for x in some]), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    return pick(docs, doc_id, text).mapInArrow(of, "doc_id long, n_bytes long, media binary")


def with_tensors(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb): full-resolution tensors of the media column; a null medium has a null tensor."""
    arrow_limits(media.sparkSession)
    names = ["doc_id", "height", "width", "rgb"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("media").to_pylist()
            for part in _groups([len(x or b"") for x in held]):
                known = [x for x in held[part] if x is not None]
                made = iter([tensor(*x) for x in decode_images(known)])
                got = [next(made) if x is not None else None for x in held[part]]
                columns = [[x.shape[0] if x is not None else None for x in got], [x.shape[1] if x is not None else None for x in got], [x.tobytes() if x is not None else None for x in got]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], *(pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True))], names=names)

    return media.select("doc_id", "media").mapInArrow(of, "doc_id long, height int, width int, rgb binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of DIGEST: everything after n_bytes comes from the media column that with_media() made.

    feature: height x width, the means of red, green and blue, and the crc32 of the RGB tensor.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, sizes = batch.column("media").to_pylist(), batch.column("n_bytes").to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for part in _groups([len(x) for x in held]):
                for raw, (image, coefficients) in zip(held[part], decode_images(held[part]), strict=True):
                    payload, rgb = read_payload(image, coefficients), tensor(image, coefficients)
                    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (rgb.size // 3)
                    feature = f"{rgb.shape[0]}x{rgb.shape[1]} {means[0]:.3f} {means[1]:.3f} {means[2]:.3f} {zlib.crc32(rgb.tobytes()):08x}"
                    row = (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), sha256(raw).hexdigest(), feature)
                    for into, x in zip(out, row, strict=True):
                        into.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGEST.split(", ")])

    return with_media(docs, doc_id, text).mapInArrow(of, DIGEST)
