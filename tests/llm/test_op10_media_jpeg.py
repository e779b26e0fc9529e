"""Progressive JPEG: lossless round trips, and the decoder against an independent general encoder."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from tests.llm.helpers import DOCS, docs, write

from talweg.llm import jpeg
from talweg.llm import op10_media_jpeg as M


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 40000])
def test_pack_unpack(n, monkeypatch):
    raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    data = M.payload(raw)
    assert len(data) % 576 == 0 and data and data.startswith(raw)
    image = jpeg.decode(M.pack(data))
    assert M.unpack(image) == data
    if n <= 5000:  # the general, bitwise path reads the same
        monkeypatch.setattr(jpeg, "_regular", lambda *a: False)
        slow = jpeg.decode(M.pack(data))
        assert all((a.blocks == b.blocks).all() for a, b in zip(image.components, slow.components))


class Writer:
    """A bit writer with a Huffman table of 8-bit codes for all symbols: independent of the module's encoder."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - k) & 1 for k in range(n)]

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(np.packbits(np.array(bits, np.uint8)).tolist()).replace(b"\xff", b"\xff\x00")


def general_file(coefs, width, height, sampling, across, down, restart=0):
    """DC in two passes, AC in bands with successive approximation, end-of-band runs and restarts."""
    symbols = [s for s in range(256) if s & 15 <= 10][:200]
    counts = [0] * 16
    counts[7], counts[8] = 0, len(symbols)  # nine-bit codes
    table = bytes(counts) + bytes(symbols)
    code = {s: k for k, s in enumerate(symbols)}
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    out = [b"\xff\xd8", seg(0xDB, b"\0" + bytes(range(1, 65)))]
    out.append(seg(0xC2, struct.pack(">BHHB", 8, height, width, len(coefs)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))))
    out += [seg(0xC4, b"\x00" + table), seg(0xC4, b"\x10" + table)]
    if restart:
        out.append(seg(0xDD, struct.pack(">H", restart)))

    def scan(keys, a, b, high, low, units, one):
        runs, w = [], Writer()
        state = {"last": dict.fromkeys(keys, 0)}
        for m in range(units):
            if restart and m and m % restart == 0:
                runs.append(w.done())
                w, state = Writer(), {"last": dict.fromkeys(keys, 0)}
            one(w, state, m)
        runs.append(w.done())
        body = bytes([len(keys), *(x for k in keys for x in (k + 1, 0)), a, b, high << 4 | low])
        out.append(seg(0xDA, body) + b"".join(r + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(runs) else b"") for k, r in enumerate(runs)))

    def number(w, v, size):
        w.put(v if v >= 0 else v + (1 << size) - 1, size)

    def dc(high, low):
        def one(w, state, m):
            y, x = divmod(m, across)
            for k, (h, v) in enumerate(sampling):
                for j in range(v):
                    for i in range(h):
                        value = int(coefs[k][y * v + j, x * h + i, 0])
                        if high:
                            w.put(value >> low & 1, 1)
                        else:
                            d = (value >> low) - state["last"][k]
                            state["last"][k] += d
                            size = abs(d).bit_length()
                            w.put(code[size], 9)
                            number(w, d, size)
        scan(list(range(len(coefs))), 0, 0, high, low, across * down, one)

    def ac_first(k, a, b, low):
        ny, nx = coefs[k].shape[0], coefs[k].shape[1]

        def one(w, state, m):
            block = coefs[k][m // nx, m % nx]
            run = 0
            z = [int(np.sign(c)) * (abs(int(c)) >> low) for c in block]
            last = max([p for p in range(a, b + 1) if z[p]], default=a - 1)
            for p in range(a, last + 1):
                if not z[p]:
                    run += 1
                    continue
                while run > 15:
                    w.put(code[0xF0], 9)
                    run -= 16
                size = abs(z[p]).bit_length()
                w.put(code[run << 4 | size], 9)
                number(w, z[p], size)
                run = 0
            if last < b:
                w.put(code[0], 9)
        scan([k], a, b, 0, low, nx * ny, one)

    def ac_refine(k, a, b, low):
        ny, nx = coefs[k].shape[0], coefs[k].shape[1]

        def one(w, state, m):
            block = [int(c) for c in coefs[k][m // nx, m % nx]]
            size = [abs(c) >> low for c in block]
            new = [p for p in range(a, b + 1) if size[p] == 1]
            p, run, pending = a, 0, []
            last_new = new[-1] if new else a - 1
            while p <= last_new:
                if size[p] == 0:
                    run += 1
                    if run == 16:
                        w.put(code[0xF0], 9)
                        for bit in pending:
                            w.put(bit, 1)
                        run, pending = 0, []
                elif size[p] > 1:
                    pending.append(size[p] & 1)
                else:
                    w.put(code[run << 4 | 1], 9)
                    w.put(1 if block[p] > 0 else 0, 1)
                    for bit in pending:
                        w.put(bit, 1)
                    run, pending = 0, []
                p += 1
            if p <= b:
                w.put(code[0], 9)
                for bit in pending:
                    w.put(bit, 1)
                for q in range(p, b + 1):
                    if size[q] > 1:
                        w.put(size[q] & 1, 1)
        scan([k], a, b, low + 1, low, nx * ny, one)

    dc(0, 1)
    for k in range(len(coefs)):
        ac_first(k, 1, 5, 2)
        ac_first(k, 6, 63, 2)
        ac_refine(k, 1, 63, 1)
    dc(1, 0)
    for k in range(len(coefs)):
        ac_refine(k, 1, 63, 0)
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("restart", [0, 3])
def test_decoder_reads_general_progressive_files(restart):
    rng = np.random.default_rng(5)
    across, down, sampling = 3, 2, [(2, 2), (1, 1), (1, 1)]
    coefs = []
    for h, v in sampling:
        c = rng.integers(-40, 41, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < 0.25)
        c[..., 0] = rng.integers(-200, 200, c.shape[:2])
        coefs.append(c)
    image = jpeg.decode(general_file(coefs, 48, 32, sampling, across, down, restart))
    for part, c in zip(image.components, coefs):
        assert (part.blocks.reshape(part.high, part.wide, 64) == c).all()
    # The inverse transform against the defining double sum.
    part = image.components[1]
    got = jpeg.samples(image, part)
    q = image.tables[0]
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = part.blocks[0] * q
    f = block.reshape(8, 8)
    scale = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    for y in range(8):
        for x in range(8):
            s = sum(scale(u) * scale(v) * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
            assert abs(int(got[y, x]) - np.clip(s + 128, 0, 255)) <= 1.5
    rgb = jpeg.to_rgb(image)
    assert rgb.shape == (32, 48, 3)
    yy, cb, cr = (jpeg.samples(image, p).astype(float) for p in image.components)
    want = yy + 1.402 * (np.repeat(np.repeat(cr, 2, 0), 2, 1) - 128)
    assert np.abs(rgb[..., 0] - np.clip(want, 0, 255)).max() <= 1.5


def test_query_and_edge_cases(spark, tmp_path):
    texts = ["", None, "naïve café", "x" * 576, "y" * 577, "z" * 30000, "naïve café"]
    path = write(spark, docs(texts), DOCS, tmp_path, "documents")
    got = {r.doc_id: r for r in M.op10_media_jpeg(spark, path).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(M.pack(data)), hashlib.sha256(M.pack(data)).hexdigest())
    assert got[2][1:] == got[6][1:] and got[0][1:] == got[1][1:]
    assert M.digest(M.store(spark.createDataFrame([], DOCS), str(tmp_path / "none"))).count() == 0


def test_tensors_of_a_media_column(spark):
    good = M.pack(M.payload(b"picture"))
    rows = [(1, good, "k"), (2, None, "k"), (3, b"no picture", None), (4, good[:60], "k")]
    got = {r.doc_id: r for r in M.tensors(spark.createDataFrame(rows, "doc_id long, media binary, rgb2 string"), "media", ["doc_id", "rgb2"]).collect()}
    rgb = jpeg.to_rgb(jpeg.decode(good))
    assert (got[1].height, got[1].width) == rgb.shape[:2] and bytes(got[1].rgb) == rgb.tobytes()
    assert got[2].rgb is None and got[3].rgb is None and got[4].rgb is None


def ac_tables(data):
    """Symbols in each AC Huffman table of a file with one DHT segment."""
    at = data.index(b"\xff\xc4")
    (size,) = struct.unpack_from(">H", data, at + 2)
    body, out = data[at + 4 : at + 2 + size], []
    while body:
        n = sum(body[1:17])
        out += [n] * (body[0] >> 4)
        body = body[17 + n :]
    return out


def test_stored_files_have_huffman_tables_of_their_own_and_the_query_reads_them_generally(spark, tmp_path, monkeypatch):
    text = "Real tables: über 20 symbols, \x7f\x01\x02 Ünïcödé 日本語 сообщение. " * 30
    data = M.pack(M.payload(text.encode()))
    assert min(ac_tables(data)) > 1 and max(ac_tables(data)) > 8
    monkeypatch.setattr(jpeg, "_regular", lambda *a: False)
    image = jpeg.decode(data)
    assert M.unpack(image) == M.payload(text.encode())
    # The tensor column is the decoded file, and the feature is the tensor's.
    texts = [text, "", None, "y" * 577, text]
    got = {r.doc_id: r for r in M.op10_media_jpeg(spark, write(spark, docs(texts), DOCS, tmp_path, "documents")).collect()}
    for i, t in enumerate(texts):
        rgb = jpeg.to_rgb(jpeg.decode(M.pack(M.payload((t or "").encode()))))
        assert (got[i].height, got[i].width) == rgb.shape[:2] and bytes(got[i].rgb) == rgb.tobytes() and got[i].feature == M.feature(rgb)


def test_any_coefficients_come_back_one_file_or_many():
    rng = np.random.default_rng(3)
    images, sampling = [], [(2, 2), (1, 1), (1, 1)]
    for across, down, dense, most in ((1, 1, 0.0, 1), (3, 2, 0.02, 1), (4, 3, 0.3, 3), (2, 5, 1.0, 1023), (5, 1, 0.1, 40), (100, 90, 0.0, 1), (96, 90, 0.0005, 2)):
        planes = []
        for h, v in sampling:
            c = rng.integers(-most, most + 1, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < dense)
            c[..., 0] = 0
            planes.append(c)
        images.append((planes, 16 * across, 16 * down, b""))
    files = jpeg.encode_many(images, sampling)
    assert files == [jpeg.encode_many([image], sampling)[0] for image in images]
    for (planes, *_), image in zip(images, jpeg.decode_many(files)):
        assert all((p.blocks.reshape(c.shape) == c).all() for p, c in zip(image.components, planes))
    # What is cut short is an error, not fewer coefficients.
    for file in files[1:5]:
        for scan in [k for k in range(len(file) - 1) if file[k : k + 2] == b"\xff\xda"][2:]:
            nxt = file.find(b"\xff\xda", scan + 2)
            nxt = len(file) - 2 if nxt < 0 else nxt
            with pytest.raises((ValueError, IndexError)):
                jpeg.decode(file[: scan + 10] + file[nxt:])


def test_scans_of_many_files_are_read_together_as_one_by_one(monkeypatch):
    rng, sampling, files = np.random.default_rng(8), [(2, 2), (1, 1), (1, 1)], []
    for across, down, restart, dense in ((3, 2, 0, 0.25), (1, 1, 0, 0.02), (2, 2, 3, 0.25), (2, 1, 0, 0.7)):
        coefs = []
        for h, v in sampling:
            c = rng.integers(-40, 41, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < dense)
            c[..., 0] = rng.integers(-200, 200, c.shape[:2])
            coefs.append(c)
        files += [general_file(coefs, 16 * across, 16 * down, sampling, across, down, restart), M.pack(M.payload(rng.integers(0, 256, 900 * across).astype(np.uint8).tobytes()))]
    alone = [jpeg.decode(file) for file in files]
    calls, read = [], jpeg._refinements
    monkeypatch.setattr(jpeg, "_refinements", lambda jobs: (calls.append(len(jobs)), read(jobs)))
    for a, b in zip(alone, jpeg.decode_many(files)):
        assert all((x.blocks == y.blocks).all() for x, y in zip(a.components, b.components))
    # Six refinements of each general file without restarts, one of each stored file: a file's own follow each other, those of different files don't.
    several = [n for n in calls if n > 1]
    assert sum(calls) - calls.count(1) >= 18 and len(several) <= 7


@pytest.mark.parametrize("sampling", [[(2, 2), (1, 1), (1, 1)], [(2, 2), (2, 1), (1, 2)], [(1, 1), (1, 1), (1, 1)], [(1, 1)]])
def test_rgb_is_the_defining_sums_rounded_once(sampling):
    rng, parts = np.random.default_rng(2), []
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    for k, (h, v) in enumerate(sampling):
        blocks = rng.integers(-300, 301, (6 * h * v, 64)).astype(np.int32)
        blocks[:, 12:] = 0
        parts.append(jpeg.Component(k + 1, h, v, 0, 3 * h, 2 * v, 3 * h, 2 * v, blocks))
    image = jpeg.Image(24 * most_h - 3, 16 * most_v - 5, parts, {0: np.arange(1, 65)})
    planes = []
    for p in parts:
        freq = np.zeros((len(p.blocks), 64), object)
        freq[:, jpeg.ZIGZAG] = p.blocks * np.arange(1, 65)
        basis = jpeg.BASIS.astype(int).astype(object)
        out = np.array([(basis @ f.reshape(8, 8) @ basis.T + (jpeg.SCALE**2 * 257) // 2) // jpeg.SCALE**2 for f in freq]).astype(int)
        assert ((jpeg.samples(image, p) == 255).any() and (jpeg.samples(image, p) == 0).any())
        whole = np.clip(out, 0, 255).reshape(p.high, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * p.high, 8 * p.wide)
        assert (jpeg.samples(image, p) == whole).all()
        planes.append(whole.repeat(most_v // p.v, 0).repeat(most_h // p.h, 1)[: image.height, : image.width])
    rgb = jpeg.to_rgb(image)
    if len(planes) == 1:
        assert (rgb == planes[0][..., None]).all()
        return
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    want = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], 2) + 32768 >> 16
    assert (rgb == np.clip(want, 0, 255)).all()
    n = image.height * image.width
    assert M.feature(rgb).split(":")[1] == ",".join(str(int(rgb[..., k].sum(dtype=int)) * 1000 // n) for k in range(3))
