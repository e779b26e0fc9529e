"""Lines of a PDF's pages, as they stand: text is placed by the page's own matrices, and what shares a height is a line.

A small reader for what office programs write: plain or deflated streams, object
streams, literal and hexadecimal strings, fonts with a ToUnicode map. Encrypted
files and scanned pages have no lines.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Points of height within which text is one line, and of width beyond which words are apart, in sizes of the font.
SAME_LINE, APART = 2.0, 1.2


def _stream(body: bytes) -> bytes:
    found = STREAM.search(body)
    if not found:
        return b""
    return zlib.decompressobj().decompress(found[1]) if b"/FlateDecode" in body[: found.start()] else found[1]


def _objects(data: bytes) -> dict[int, bytes]:
    out = {int(n): body for n, body in OBJECT.findall(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            packed = _stream(body)
            first, n = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"First", b"N"))
            head = list(map(int, packed[:first].split()))
            for k in range(n):
                end = head[2 * k + 3] if k + 1 < n else len(packed) - first
                out.setdefault(head[2 * k], packed[first + head[2 * k + 1] : first + end])
    return out


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """Page objects in reading order: down the tree from the catalogue."""

    def below(n: int, seen: frozenset) -> list[bytes]:
        body = objects.get(n, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids and n not in seen:
            return [p for k in REFERENCE.findall(kids[1]) for p in below(int(k), seen | {n})]
        return [body] if re.search(rb"/Type\s*/Page\b", body) else []

    root = next((re.search(rb"/Pages\s+(\d+)", b) for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), None)
    return below(int(root[1]), frozenset()) if root else []


def _cmap(text: bytes) -> dict[int, str]:
    """Codes to characters of a ToUnicode map."""
    say = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
        out |= {int(a, 16): say(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
        for lo, hi, start in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out |= {c: chr(ord(say(start)[-1]) + c - int(lo, 16)) for c in range(int(lo, 16), int(hi, 16) + 1)}
    return out


def _fonts(page: bytes, objects: dict[int, bytes]) -> dict[bytes, dict[int, str]]:
    held = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page)
    where = objects.get(int(held[1]), b"") if held else page
    listed = re.search(rb"/Font\s+(\d+)\s+\d+\s+R", where)
    where = objects.get(int(listed[1]), b"") if listed else where
    out = {}
    for name, n in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", where):
        to = re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(n), b""))
        if to:
            out[name] = _cmap(_stream(objects[int(to[1])]))
    return out


def _said(token: bytes, codes: dict[int, str] | None) -> str:
    if token.startswith(b"<"):
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode().ljust(2, "0"))
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if codes is None:
        return raw.decode("cp1252", "replace")
    wide = 2 if max(codes, default=0) > 255 or token.startswith(b"<") else 1
    return "".join(codes.get(int.from_bytes(raw[i : i + wide], "big"), "") for i in range(0, len(raw), wide))


def _placed(content: bytes, fonts: dict[bytes, dict[int, str]]) -> list[tuple[float, float, float, str]]:
    """(x, y, size, text) of what a page shows."""
    out, stack, codes, size, leading = [], [], None, 1.0, 0.0
    x = y = x0 = y0 = 0.0
    texts: list[str] = []
    for t in TOKEN.findall(content):
        if t[:1] in b"(<":
            texts.append(_said(t, codes))
        elif t[:1] == b"/" or t in b"[]" or t[:1].isdigit() or t[:1] in b"+-.":
            stack.append(t)
        else:
            numbers = [float(n) for n in stack if n[:1].isdigit() or n[:1] in b"+-."]
            if t == b"Tf":
                codes, size = fonts.get(next((s[1:] for s in stack if s[:1] == b"/"), b"")), numbers[-1]
            elif t == b"BT":
                x = y = x0 = y0 = 0.0
            elif t == b"Tm" and len(numbers) >= 6:
                x = x0 = numbers[-2]
                y = y0 = numbers[-1]
            elif t in (b"Td", b"TD") and len(numbers) >= 2:
                x0, y0 = x0 + numbers[-2], y0 + numbers[-1]
                x, y = x0, y0
                leading = -numbers[-1] if t == b"TD" else leading
            elif t == b"TL":
                leading = numbers[-1]
            elif t in (b"T*", b"'", b'"'):
                y0 -= leading
                x, y = x0, y0
            if t in (b"Tj", b"TJ", b"'", b'"') and texts:
                said = "".join(texts)
                out.append((x, y, size, said))
                x += size * len(said) * 0.5
            stack, texts = [], []
    return out


def page_lines(data: bytes) -> list[list[str]]:
    """Each page's lines from the top, what stands apart on a line parted by a space."""
    objects = _objects(data)
    out = []
    for page in _pages(objects):
        held = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        content = b"\n".join(_stream(objects.get(int(n), b"")) for n in REFERENCE.findall(held[1])) if held else b""
        lines: list[list[tuple[float, float, str]]] = []
        height = None
        for x, y, size, said in sorted(_placed(content, _fonts(page, objects)), key=lambda p: -p[1]):
            if height is None or height - y > SAME_LINE:
                lines.append([])
                height = y
            lines[-1].append((x, size, said))
        out.append([])
        for line in lines:
            text, end = "", None
            for x, size, said in sorted(line):
                text += (" " if end is not None and x - end > (APART - 1) * size else "") + said
                end = x + size * len(said) * 0.5
            out[-1].append(text)
    return out
