"""Progressive JPEG: scans to coefficients, coefficients to RGB, and a writer.

``decode`` accumulates every scan of a progressive file (spectral selection and
successive approximation, DC and AC, first passes and refinements, restarts)
into coefficient arrays, one block a row. ``to_rgb`` inverse-transforms them in
numpy, upsamples subsampled components and converts to RGB at full resolution.

Huffman tables are those of the file. For a first AC scan numpy looks up, at every
bit, how far the next symbol would lie if one began there; a walk along these steps
finds the true symbols, and their values, runs and ends of bands become places of
coefficients by prefix sums. A refinement is walked symbol by symbol, its correction
bits are gathered at once. Scans of many files are read together. (A scan whose table
has a single code has every field at a known bit and is read without a walk.) ``encode_many``
writes any coefficients, with tables made for them, two spectral bands and successive approximation.
"""

from __future__ import annotations

import heapq
import itertools
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

#: The zigzag order of an 8x8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
NATURAL = np.argsort(ZIGZAG)
#: Bytes of entropy-coded data (or fields of it) that are looked at together.
CHUNK = 1 << 13
#: Bits of each coefficient's size.
SIZE = np.frexp(np.arange(1024.0))[1].astype(np.uint8)
#: Inverse transform scaled to whole numbers, so that sums are exact in double precision and equal on every machine.
SCALE = 1 << 12
BASIS = np.array([[np.rint(SCALE * (np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)) for u in range(8)] for x in range(8)])
#: From a block's coefficients (zigzag order) to its samples.
INVERSE = np.kron(BASIS, BASIS).T[ZIGZAG] / (SCALE * SCALE)


@dataclass
class Component:
    key: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks that scans of this component alone have
    down: int = 0
    wide: int = 0  # blocks in whole MCUs
    high: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))  # zigzag order


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]  # zigzag order
    comment: bytes = b""


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.only = (next(n for n, c in enumerate(counts, 1) if c), symbols[0]) if len(symbols) == 1 else None

    @cached_property
    def look(self) -> list[int]:
        """For each 16 bits that may come next: the code's length and symbol (length << 8 | symbol), or -1."""
        out = np.full(1 << 16, -1, np.int32)
        code = k = 0
        for length in range(1, 17):
            for _ in range(self.counts[length - 1]):
                out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | self.symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        return out.tolist()


    @cached_property
    def short(self) -> tuple[int, np.ndarray]:
        """(longest code's bits, for each value of so many bits that may come next what ``look`` has)."""
        length = np.repeat(np.arange(1, 17), list(self.counts))
        most = int(length[-1]) if len(length) else 1
        out = np.full(1 << most, -1, np.int64)
        known = np.repeat(length << 8 | np.frombuffer(self.symbols, np.uint8, len(length)), 1 << (most - length))
        if len(known) > len(out):
            raise ValueError("too many Huffman codes")
        out[: len(known)] = known
        return most, out


class Bits:
    """Bits of a run of entropy-coded bytes, the stuffed zeros gone; ones follow the end."""

    def __init__(self, raw: bytes):
        raw = raw.replace(b"\xff\x00", b"\xff")
        self.end = 8 * len(raw) + 4096
        self.raw = raw + b"\xff" * 520
        self.at = 0

    def bit(self) -> int:
        at = self.at
        self.at = at + 1
        return self.raw[at >> 3] >> (7 - (at & 7)) & 1

    def bits(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return int.from_bytes(self.raw[at >> 3 : (at >> 3) + 4], "big") >> (32 - (at & 7) - n) & ((1 << n) - 1)

    def symbol(self, table: Huffman) -> int:
        at = self.at
        if at > self.end:
            raise ValueError("entropy-coded data end too early")
        got = table.look[int.from_bytes(self.raw[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7)) & 0xFFFF]
        if got < 0:
            raise ValueError("no such Huffman code")
        self.at = at + (got >> 8)
        return got & 255

    def signed(self, size: int) -> int:
        if not size:
            return 0
        v = self.bits(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _runs(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded runs between restart markers from ``at``, and where the next marker is."""
    runs, start = [], at
    while True:
        at = data.index(b"\xff", at)
        nxt = data[at + 1]
        if nxt == 0:
            at += 2
        elif 0xD0 <= nxt <= 0xD7:
            runs.append(data[start:at])
            at = start = at + 2
        elif nxt == 0xFF:
            at += 1
        else:
            return [*runs, data[start:at]], at


def _fields(raw: bytes, n: int, width: int, skip: int) -> np.ndarray:
    """n fields of ``width`` bits with the first ``skip`` bits of each left out, as bits."""
    bits = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8), count=n * width)
    return bits.reshape(n, width)[:, skip:]


def _number(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as unsigned numbers."""
    out = np.zeros(len(bits), np.int32)
    for k in range(bits.shape[1]):
        out = out << 1 | bits[:, k]
    return out


def _regular(part: Component, start: int, end: int, high: int, low: int, table: Huffman, raw: bytes) -> bool:
    """Read an AC scan of one code in one go; False if its layout isn't regular."""
    length, symbol = table.only
    run, size = symbol >> 4, symbol & 15
    blocks, span = part.blocks.reshape(part.high, part.wide, 64)[: part.down, : part.across], end - start + 1
    n = part.down * part.across
    if not high and run == 0 and size:
        # Every coefficient of the band is coded, with the same size.
        if length + size == 8:  # a field is a byte
            value = np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8, n * span).astype(np.int32) & ((1 << size) - 1)
        else:
            value = _number(_fields(raw, n * span, length + size, length))
        value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
        blocks[..., start : end + 1] = (value << low).reshape(part.down, part.across, span)
        return True
    if high and symbol == 0 and (blocks[..., start : end + 1] != 0).all():
        # Each block is an end of band, then one correction bit for every coefficient.
        bits = _fields(raw, n, length + span, length).astype(np.int32).reshape(part.down, part.across, span)
        band = blocks[..., start : end + 1]
        blocks[..., start : end + 1] = band + np.sign(band) * (bits << low)
        return True
    return False


@dataclass
class Pass:
    """A run of a scan of one band (blocks x coefficients) and the array that it is read into."""

    band: np.ndarray
    low: int
    data: bytes  # without stuffed zeros
    table: Huffman


def _symbols(raw: np.ndarray, start: list[int], size: list[int], which: np.ndarray, look: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(the bits at which symbols begin, run after run; how many each run has); ``which`` is the row of ``look`` for each byte of ``raw``."""
    run, extra = look >> 4 & 15, look & 15
    step = np.where(look < 0, 255, (look >> 8) + np.where(extra > 0, extra, np.where(run < 15, run, 0))).astype(np.uint8).reshape(-1)
    steps = np.empty((len(raw) - 2, 8), np.uint8)
    for a in range(0, len(steps), CHUNK):
        x, base = raw[a : a + CHUNK + 2].astype(np.int64), which[a : a + CHUNK][: len(steps) - a] << most
        x = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        for k in range(8):
            window = x >> 24 - most - k
            window &= (1 << most) - 1
            window |= base
            steps[a : a + CHUNK, k] = step.take(window)
    steps = steps.tobytes()
    own, count, jump = bytearray(), [], []
    add, at = own.append, 0
    for a, n in zip(start, size):
        end = 8 * (a + n)
        jump.append(8 * a - at)
        count.append(len(own))
        at = 8 * a
        while at < end:
            n = steps[at]
            add(n)
            at += n
    begin, taken = np.array(count), np.frombuffer(own, np.uint8)
    count = np.diff(begin, append=len(own))
    if not count.all():
        raise ValueError("entropy-coded data end too early")
    step = np.zeros(len(own), np.int64)
    step[1:] = taken[:-1]
    step[begin] += jump
    return np.cumsum(step, out=step), count


def _first_passes(jobs: list[Pass]) -> None:
    """Read first passes, of any number of files, together."""
    tables = list({id(j.table): j.table for j in jobs}.values())
    row = {id(t): k for k, t in enumerate(tables)}
    most = max(t.short[0] for t in tables)
    look = np.stack([np.repeat(t.short[1], 1 << (most - t.short[0])) for t in tables])
    pad = b"\xff" * 64
    raw = np.frombuffer(b"".join([x for j in jobs for x in (j.data, pad)]), np.uint8)
    size = [len(j.data) for j in jobs]
    own = np.array([row[id(j.table)] for j in jobs])
    start = (np.cumsum(size) - size + len(pad) * np.arange(len(jobs))).tolist()
    at, count = _symbols(raw, start, size, np.repeat(own, np.array(size) + len(pad)), look, most)
    begin, final = np.cumsum(count) - count, np.cumsum(count) - 1
    # Bits from each symbol on, 57 at least.
    x = raw.astype(np.uint64)
    x = x[:-1] << 8 | x[1:]
    x = x[:-2] << 16 | x[2:]
    x = x[:-4] << 32 | x[4:]
    bits = x[at >> 3] << (at & 7).view(np.uint64)
    got = look.reshape(-1)[(bits >> (64 - most)).view(np.int64) + np.repeat(own << most, count)]
    wrong = got < 0
    symbol = got & 255
    run, extra = symbol >> 4, symbol & 15
    ends = symbol < 0xF0
    ends &= extra == 0
    if bad := wrong.any():
        run[wrong], extra[wrong], ends[wrong] = 15, 0, False
    last = np.flatnonzero(ends)
    bits <<= (got >> 8).view(np.uint64)
    # How many coefficients a symbol passes: a run and one, or sixteen; an end of band those that are left in the block it is met in,
    # and as many blocks more as it says.
    step = run + 1
    step[last] = 0
    spans, sizes = np.array([j.band.shape[1] for j in jobs]), np.array([j.band.size for j in jobs])
    offset = np.cumsum(sizes) - sizes
    upto = np.cumsum(step)
    of = np.searchsorted(final, last)
    fresh, behind = np.diff(of, prepend=-1) > 0, upto[last]
    ahead = behind - np.where(fresh, (upto[begin] - step[begin])[of], np.concatenate([[0], behind])[:-1])
    more = (bits[last] >> (64 - run[last]).view(np.uint64)).view(np.int64)
    closed = np.cumsum(ahead // spans[of] + (1 << run[last]) + more)
    into = np.concatenate([[0], closed])[np.searchsorted(of, np.arange(len(jobs)))]
    place = offset[of] + (closed - into[of]) * spans[of]
    step[last] = place - np.where(fresh, offset[of], np.concatenate([[0], place])[:-1]) - ahead
    after = np.cumsum(step)
    after += np.repeat(offset - after[begin] + step[begin], count)
    limit = offset + sizes
    if (after[final] < limit).any():
        raise ValueError("entropy-coded data end too early")
    before = after - step
    real = before < np.repeat(limit, count)
    if bad and (wrong & real).any():
        raise ValueError("no such Huffman code")
    real &= extra > 0
    coded = np.flatnonzero(real)
    place, extra = after[coded] - 1, extra[coded]
    value = (bits[coded] >> (64 - extra).view(np.uint64)).view(np.int64)
    far = coded[step[coded] > 1]
    of = np.searchsorted(final, far)
    if ((after[far] - 1 - offset[of]) // spans[of] != (before[far] - offset[of]) // spans[of]).any():
        raise ValueError("a run beyond its block")
    flat = np.zeros(int(sizes.sum()), np.int32)
    flat[place] = value - np.where(value >> (extra - 1), 0, (1 << extra) - 1)
    for j, a, n in zip(jobs, offset.tolist(), sizes.tolist()):
        j.band[...] = (flat[a : a + n] << j.low).reshape(j.band.shape)


def _refinements(jobs: list[Pass]) -> None:
    """Read refinements, of any number of files: symbols one by one, correction bits at once."""
    flat = np.concatenate([j.band.reshape(-1) for j in jobs])
    known = flat != 0
    missing = np.flatnonzero(~known)
    zeros, pad = missing.tolist(), b"\xff" * 520
    raw = b"".join([x for j in jobs for x in (j.data, pad)])
    new, value, start, count = [], [], [], []
    base = byte = 0
    for j in jobs:
        n, span = j.band.shape
        # Zeros before each block.
        before = np.searchsorted(missing, np.arange(base, base + (n + 1) * span, span)).tolist()
        most, look = j.table.short
        look, mask, one = look.tolist(), (1 << most) - 1, 1 << j.low
        at, end = 8 * byte, 8 * (byte + len(j.data) + 512)
        # A coefficient, the zeros before it, its block and where that ends.
        k, z, block, edge = base, before[0], 0, base + span
        while block < n:
            if at > end:
                raise ValueError("entropy-coded data end too early")
            left = 40 - (at & 7)
            bits = int.from_bytes(raw[at >> 3 : (at >> 3) + 5], "big")
            got = look[bits >> (left - most) & mask]
            if got < 0:
                raise ValueError("no such Huffman code")
            at += got >> 8
            left -= got >> 8
            run, size = got >> 4 & 15, got & 15
            if not size and run < 15:
                at += run
                block = min(block + (1 << run) + (bits >> (left - run) & ((1 << run) - 1)), n)
                to, passed = base + block * span, before[block]
                edge = to + span
            else:
                passed = z + run
                to = zeros[passed]
                if to >= edge:
                    raise ValueError("a run beyond its block")
                if size:
                    at += 1
                    value.append(one if bits >> (left - 1) & 1 else -one)
                    new.append(to)
                to, passed = to + 1, passed + 1
                if to == edge:
                    block, edge = block + 1, edge + span
            start.append(at)
            count.append(to - k - passed + z)
            at += count[-1]
            k, z = to, passed
        if at > end:
            raise ValueError("entropy-coded data end too early")
        base, byte = base + n * span, byte + len(j.data) + len(pad)
    # Other bits and correction bits take turns.
    turns = np.zeros((len(start), 2), np.int64)
    turns[:, 1], turns[:, 0] = count, start
    turns[1:, 0] -= np.add(start, count)[:-1]
    taken = np.repeat(np.tile([False, True], len(turns)), turns.ravel())
    grown = np.flatnonzero(known)[np.unpackbits(np.frombuffer(raw, np.uint8), count=len(taken))[taken].view(bool)]
    sizes = [j.band.size for j in jobs]
    low, was = np.repeat(np.array([j.low for j in jobs], np.int32), sizes)[grown], flat[grown]
    flat[grown] = was + np.where(was < 0, -1 << low, 1 << low)
    flat[new] = value
    for j, a, n in zip(jobs, (np.cumsum(sizes) - sizes).tolist(), sizes):
        j.band[...] = flat[a : a + n].reshape(j.band.shape)


def _band(part: Component, start: int, end: int) -> np.ndarray:
    """A component's coefficients in the order of scans of it alone (blocks x coefficients): a view where no block is left out."""
    return part.blocks.reshape(part.high, part.wide, 64)[: part.down, : part.across, start : end + 1].reshape(-1, end - start + 1)


def _set_band(part: Component, start: int, end: int, band: np.ndarray) -> None:
    if not np.may_share_memory(band, part.blocks):
        part.blocks.reshape(part.high, part.wide, 64)[: part.down, : part.across, start : end + 1] = band.reshape(part.down, part.across, -1)


def _scan(parts: list[tuple[Component, Huffman | None, Huffman | None]], across: int, down: int, start: int, end: int, high: int, low: int, interval: int, runs: list[bytes]) -> None:
    if start:
        part, _, table = parts[0]
        if not (len(runs) == 1 and table.only and _regular(part, start, end, high, low, table, runs[0])):
            per = interval or part.across * part.down
            band = _band(part, start, end)
            for r, raw in enumerate(runs):
                (_refinements if high else _first_passes)([Pass(band[r * per : (r + 1) * per], low, raw.replace(b"\xff\x00", b"\xff"), table)])
            _set_band(part, start, end, band)
        return
    alone = len(parts) == 1
    n = parts[0][0].across * parts[0][0].down if alone else across * down
    if not start and len(runs) == 1 and (high or all(dc.only and dc.only[1] == 0 for _, dc, _ in parts)):
        # Bits that are raw, or differences that are all zero: one field a block.
        each = [(p, k) for p, _, _ in parts for k in range(1 if alone else p.h * p.v)]
        width = [1 if high else dc.only[0] for _, dc, _ in parts]
        if not high:
            return
        bits = _fields(runs[0], n, len(each), 0).astype(np.int32)
        if not bits.any():
            return
        for at, (p, k) in enumerate(each):
            if alone:
                p.blocks.reshape(p.high, p.wide, 64)[: p.down, : p.across, 0] |= bits[:, 0].reshape(p.down, p.across) << low
            else:
                p.blocks.reshape(down, p.v, across, p.h, 64)[:, k // p.h, :, k % p.h, 0] |= bits[:, at].reshape(down, across) << low
        return
    per = interval or n
    for r, raw in enumerate(runs):
        bits = Bits(raw)
        last = {p.key: 0 for p, _, _ in parts}
        for m in range(r * per, min(n, (r + 1) * per)):
            for p, dc, _ in parts:
                if alone:
                    places = [m // p.across * p.wide + m % p.across]
                else:
                    y, x = divmod(m, across)
                    places = [(y * p.v + j) * p.wide + x * p.h + i for j in range(p.v) for i in range(p.h)]
                for place in places:
                    block = p.blocks[place]
                    if high:
                        block[0] |= bits.bit() << low
                    else:
                        last[p.key] += bits.signed(bits.symbol(dc))
                        block[0] = last[p.key] << low


def decode(data: bytes) -> Image:
    """All coefficients of a progressive JPEG file; raises ValueError for another kind of file."""
    return decode_many([data])[0]


def decode_many(files: list[bytes]) -> list[Image]:
    """``decode`` of each file; first AC passes of all files without restarts are read together, and so are their refinements."""
    parsed = [_parsed(data) for data in files]
    # The first passes of a file's bands don't depend on each other; its other scans are read in order.
    first, later = [], []
    for _, scans in parsed:
        later.append([])
        for scan in scans:
            (first if _together(scan) and not scan[5] else later[-1]).append(scan)
    _read_together(first, _first_passes)
    for turn in itertools.zip_longest(*later):
        some = [scan for scan in turn if scan]
        _read_together([scan for scan in some if _together(scan)], _refinements)
        for scan in some:
            if not _together(scan):
                _scan(*scan)
    return [image for image, _ in parsed]


def _together(scan: tuple) -> bool:
    """Whether a scan is an AC scan of one run, with more than one code."""
    return scan[3] and len(scan[8]) == 1 and not scan[0][0][2].only


def _read_together(scans: list[tuple], read: Callable[[list[Pass]], None]) -> None:
    jobs = [Pass(_band(parts[0][0], start, end), low, runs[0].replace(b"\xff\x00", b"\xff"), parts[0][2]) for parts, _, _, start, end, _, low, _, runs in scans]
    if jobs:
        read(jobs)
    for (parts, _, _, start, end, *_), job in zip(scans, jobs):
        _set_band(parts[0][0], start, end, job.band)


def _parsed(data: bytes) -> tuple[Image, list[tuple]]:
    """A file's frame and tables, and what ``_scan`` takes for each of its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, interval, comment = 2, 0, b""
    tables: dict[int, np.ndarray] = {}
    dc: dict[int, Huffman] = {}
    ac: dict[int, Huffman] = {}
    image: Image | None = None
    scans: list[tuple] = []
    across = down = 0
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                tables[key] = np.frombuffer(body[1 : n + 1], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[n + 1 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError("samples of other than 8 bits")
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            most_h, most_v = max(p.h for p in parts), max(p.v for p in parts)
            across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for p in parts:
                p.across, p.down = -(-(-(-width * p.h // most_h)) // 8), -(-(-(-height * p.v // most_v)) // 8)
                p.wide, p.high = across * p.h, down * p.v
                p.blocks = np.zeros((p.wide * p.high, 64), np.int32)
            image = Image(width, height, parts, tables, comment)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise ValueError("not a progressive Huffman-coded file")
        elif marker == 0xDA:
            n = body[0]
            parts = [(next(p for p in image.components if p.key == body[1 + 2 * k]), dc.get(body[2 + 2 * k] >> 4), ac.get(body[2 + 2 * k] & 15)) for k in range(n)]
            start, end, approx = body[1 + 2 * n : 4 + 2 * n]
            if any((ac_ if start else dc_ or approx >> 4) is None for _, dc_, ac_ in parts):
                raise ValueError("a scan without its Huffman table")
            runs, at = _runs(data, at)
            scans.append((parts, across, down, start, end, approx >> 4, approx & 15, interval, runs))
    if image is None:
        raise ValueError("a file without a frame")
    return image, scans


def samples(image: Image, part: Component) -> np.ndarray:
    """A component's samples, inverse-transformed, as 8-bit rows of whole blocks."""
    out = (part.blocks * image.tables[part.table]).astype(np.float64) @ INVERSE
    out += 128.5
    rows = np.clip(out, 0, 255, out=out).astype(np.uint8).view(np.uint64)  # a block's rows, eight samples each
    return rows.reshape(part.high, part.wide, 8).transpose(0, 2, 1).copy().view(np.uint8).reshape(part.high * 8, part.wide * 8)


def to_rgb(image: Image) -> np.ndarray:
    """Full-resolution RGB, height x width x 3, uint8; one component gives grey."""
    most_h, most_v = max(p.h for p in image.components), max(p.v for p in image.components)
    full = lambda x, p: x.repeat(most_h // p.h, 1).repeat(most_v // p.v, 0)[: image.height, : image.width]
    planes = [samples(image, p) for p in image.components[:3]]
    if len(planes) == 1:
        return np.repeat(full(planes[0], image.components[0])[..., None], 3, axis=2)
    first, blue, red = image.components[:3]
    y, cb, cr = (p.astype(np.int32) for p in planes)
    y = full(y.astype(np.int16), first)
    if (blue.h, blue.v) != (red.h, red.v):
        cb, cr, blue, red = full(cb, blue), full(cr, red), None, None
    cb, cr = cb - 128, cr - 128
    rgb = np.empty((image.height, image.width, 3), np.uint8)
    # What the chroma adds to whole numbers of y is rounded before it is spread.
    for k, value in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        value = (value + 32768 >> 16).astype(np.int16)
        value = y + (full(value, red) if red else value)
        rgb[..., k] = np.clip(value, 0, 255, out=value)
    return rgb


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _entropy(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: padded with ones, a zero stuffed after each 255."""
    bits = np.concatenate([bits.ravel(), np.ones(-bits.size % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def huffman(times: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(segment body without its class, code and length of each symbol) of an optimal table; no code is all ones."""
    used = np.flatnonzero(times).tolist()
    weight = {k: int(times[k]) for k in used}
    while True:
        heap = [(0, 256, 256), *((weight[k], k, k) for k in used)]
        heapq.heapify(heap)
        above, node = {}, 256
        while len(heap) > 1:
            a, node = heapq.heappop(heap), node + 1
            b = heap[0]
            above[a[2]] = above[b[2]] = node
            heapq.heapreplace(heap, (a[0] + b[0], a[1] if a[1] < b[1] else b[1], node))
        length = {node: 0}
        for k in reversed(above):
            length[k] = length[above[k]] + 1
        if max(length.values()) <= 16:
            break
        weight = {k: (w + 1) // 2 for k, w in weight.items()}
    code, codes, lengths, last = 0, np.zeros(256, np.int64), np.zeros(256, np.int64), 0
    order = sorted(used, key=lambda k: (length[k], k))
    for k in order:
        code <<= length[k] - last
        codes[k], lengths[k], last = code, length[k], length[k]
        code += 1
    return bytes(np.bincount(lengths[order], minlength=17)[1:].astype(np.uint8)) + bytes(order), codes, lengths


@dataclass
class Tokens:
    """Symbols of passes, in order, with their extra bits; correction bits and the symbols that they follow."""

    symbol: np.ndarray
    more: np.ndarray
    width: np.ndarray
    job: np.ndarray  # the pass of each symbol
    fix: np.ndarray
    follows: np.ndarray


def _tokens(passes: list[tuple[np.ndarray, int]], refine: bool) -> Tokens:
    """The symbols of first passes or of refinements (band of blocks x coefficients, low bit)."""
    count, spans = np.array([b.shape[0] for b, _ in passes]), np.array([b.shape[1] for b, _ in passes])
    length = count * spans
    flat = np.concatenate([b.reshape(-1) for b, _ in passes])
    size_of = np.abs(flat) >> np.repeat(np.array([low for _, low in passes], flat.dtype), length)
    zero, coded = size_of == 0, size_of == 1 if refine else size_of > 0
    span = np.repeat(spans, count)
    edge = np.concatenate([[0], np.cumsum(span)])
    upto = np.concatenate([[0], np.cumsum(zero, dtype=np.int32)])
    place = np.flatnonzero(coded)
    number = np.add.reduceat(coded, edge[:-1], dtype=np.int64)
    first, some = np.cumsum(number) - number, np.flatnonzero(number)
    base = upto[place]
    base[1:] = base[:-1]
    base[first[some]] = upto[edge[some]]
    run = upto[place] - base
    far = np.flatnonzero(run > 15)
    times = run[far] >> 4
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    skips = np.flatnonzero(zero)[np.repeat(base[far], times) + 16 * nth + 15] if len(far) else far
    extra = size_of[place].astype(np.int32)
    size = SIZE[extra]
    extra = np.where(flat[place] > 0, extra, (1 << size.astype(np.int32)) - 1 - extra)
    # Ends of bands: a block's, and those of the blocks after it that hold nothing new.
    last = np.full(len(span), -1)
    last[some] = place[first[some] + number[some] - 1] - edge[some]
    ends = last < span - 1
    begins = ends & ~((last < 0) & np.concatenate([[False], ends[:-1]]))
    begins[np.cumsum(count) - count] |= ends[np.cumsum(count) - count]
    since = np.maximum.accumulate(np.where(begins, np.arange(len(span)), 0))
    begins |= ends & ((np.arange(len(span)) - since) % 32767 == 0)
    begin = np.flatnonzero(begins)
    times = np.add.reduceat(ends.astype(np.int64), begin) if len(begin) else begin
    grade = np.frexp(times.astype(float))[1].astype(np.int64) - 1
    # Symbols are in the order of the last coefficient that each passes; no two have the same.
    until = edge[begin + times] - 1
    closes = coded
    closes[skips] = closes[until] = True
    rank = np.cumsum(closes, dtype=np.int32)
    n = int(rank[-1])
    symbol, more, width = np.empty(n, np.uint8), np.zeros(n, np.int32), np.zeros(n, np.uint8)
    to = rank[place] - 1
    symbol[to], more[to], width[to] = run << 4 & 0xF0 | size, extra, size
    symbol[rank[skips] - 1] = 0xF0
    to = rank[until] - 1
    symbol[to], more[to], width[to] = grade << 4, times - (1 << grade), grade
    fix = np.flatnonzero(size_of > 1) if refine else far[:0]
    job = np.repeat(np.arange(len(passes)), np.diff(rank[np.cumsum(length) - 1], prepend=0))
    return Tokens(symbol, more, width, job, size_of[fix] & 1, rank[fix] - closes[fix])


def _coded(t: Tokens, code: np.ndarray, length: np.ndarray, passes: int) -> list[bytes]:
    """The entropy-coded bytes of each pass, from the code of each symbol."""
    n, of = len(t.symbol), t.job[t.follows]
    fixes, symbols = np.bincount(of, minlength=passes), np.bincount(t.job, minlength=passes)
    length = length + t.width
    pad = -(np.bincount(t.job, weights=length, minlength=passes).astype(np.int64) + fixes) % 8
    value, size = np.zeros(n + len(of) + passes, np.uint64), np.ones(n + len(of) + passes, np.int64)
    at = np.arange(n) + t.job
    if len(of):
        each = np.bincount(t.follows, minlength=n)
        at += np.cumsum(each) - each
        value[t.follows + 1 + np.arange(len(of)) + of] = t.fix
    value[at], size[at] = code << t.width | t.more, length
    end = np.cumsum(symbols + fixes + 1) - 1
    value[end], size[end] = (1 << pad) - 1, pad
    # Numbers of bits are put together in words of 64; what doesn't fit in one goes on in the next.
    upto = np.cumsum(size)
    word, left = (upto - size) >> 6, 64 - size - ((upto - size) & 63)
    over = np.flatnonzero(left < 0)
    high = value << np.maximum(left, 0).view(np.uint64)
    high[over] = value[over] >> (-left[over]).view(np.uint64)
    begin = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[begin]] = np.bitwise_or.reduceat(high, begin)
    words[word[over] + 1] |= value[over] << (64 + left[over]).view(np.uint64)
    data = words.astype(">u8").tobytes()
    to = (upto[end] // 8).tolist()
    return [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip([0, *to], to)]


def encode_many(images: list[tuple[list[np.ndarray], int, int, bytes]], sampling: list[tuple[int, int]], split: int = 5) -> list[bytes]:
    """A progressive file, quantised by 1, of each image (planes, width, height, comment).

    Planes: each component's blocks in rows of whole MCUs (rows, blocks
    across, 64), zigzag order, DC 0, every AC coefficient below 1024. Scans: DC and its
    refinement; of the first component two spectral bands (1 to ``split``, the rest)
    without their last bit, and one refinement that brings it; of each other one band.
    A file's first passes share one optimal Huffman table, the refinement has its own.
    """
    firsts, refinements = [(0, 1, split, 0, 1), (0, split + 1, 63, 0, 1), *((k, 1, 63, 0, 0) for k in range(1, len(sampling)))], [(0, 1, 63, 1, 0)]
    tables, coded = [], []
    for passes in (firsts, refinements):
        n = len(passes) * len(images)
        t = _tokens([(planes[k].reshape(-1, 64)[:, a : b + 1], low) for planes, *_ in images for k, a, b, _, low in passes], passes is refinements)
        which = t.job // len(passes) << 8 | t.symbol
        tables.append([huffman(x) for x in np.bincount(which, minlength=256 * len(images)).reshape(-1, 256)])
        code, length = (np.concatenate([x[k] for x in tables[-1]])[which] for k in (1, 2))
        coded.append(iter(_coded(t, code, length, n)))
    dc = bytes([1] + [0] * 15) + b"\0"
    files = []
    for f, (planes, width, height, comment) in enumerate(images):
        out = [b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, b"\0" + b"\1" * 64)]
        frame = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
        out += [_segment(0xC2, frame), _segment(0xC4, b"\x00" + dc + b"\x10" + tables[0][f][0] + b"\x11" + tables[1][f][0])]
        scan = lambda keys, table, a, b, approx, data: out.extend([_segment(0xDA, bytes([len(keys), *(x for k in keys for x in (k + 1, table)), a, b, approx])), data])  # noqa: B023,E731
        zeros = _entropy(np.zeros(sum(p.shape[0] * p.shape[1] for p in planes), np.uint8))
        scan(range(len(planes)), 0, 0, 0, 0x01, zeros)
        scan(range(len(planes)), 0, 0, 0, 0x10, zeros)
        for k, a, b, high, low in firsts + refinements:
            scan([k], high, a, b, high << 4 | low, next(coded[high]))
        files.append(b"".join([*out, b"\xff\xd9"]))
    return files
