"""Text of PDF files by the standard library: pages of simple fonts, and where each page ends.

It reads classic files (objects, FlateDecode and plain streams, object streams) and the text operators Tj, TJ, ' and ".
Glyphs are taken by the font's ToUnicode map where there is one, else as Windows-1252.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: An unpacked stream may be no larger than this.
MOST_BYTES = 64 << 20
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/%]*|[+-]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)


class UnreadablePdf(ValueError):
    pass


class NoTextLayer(UnreadablePdf):
    pass


def _stream(body: bytes) -> bytes | None:
    found = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not found:
        return None
    head, data = body[: found.start()], found[1]
    if b"/FlateDecode" in head:
        unpack = zlib.decompressobj()
        try:
            data = unpack.decompress(data, MOST_BYTES)
        except zlib.error as error:
            raise UnreadablePdf("a stream is damaged") from error
        if unpack.unconsumed_tail:
            raise UnreadablePdf("a stream is too large")
    elif b"/Filter" in head:
        return b""
    return data


def _objects(data: bytes) -> dict[int, bytes]:
    """Objects by number; those of later updates replace earlier ones."""
    out = {int(m[1]): m[2] for m in re.finditer(rb"(?:^|\s)(\d+)\s+\d+\s+obj\b(.*?)endobj", data, re.S)}
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm", body):
            inner, n, first = _stream(body) or b"", re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
            if n and first:
                pairs = list(map(int, inner[: int(first[1])].split()))[: 2 * int(n[1])]
                starts = [int(first[1]) + at for at in pairs[1::2]] + [len(inner)]
                out |= {number: inner[a:b] for number, a, b in zip(pairs[::2], starts, starts[1:], strict=False)}
    return out


def _references(value: bytes) -> list[int]:
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", value)]


def _entry(body: bytes, key: bytes) -> bytes:
    """What follows a key: an array, a dictionary, references or a word."""
    found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|<<.*?>>|\d+\s+\d+\s+R|/?[^\s/<>\[\]]+)", body, re.S)
    return found[1] if found else b""


def _pages(objects: dict[int, bytes]) -> list[int]:
    """Numbers of pages in order, down the tree from the catalog."""
    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)]
    todo = [r for n in roots for r in _references(_entry(objects[n], b"Pages"))]
    out, seen = [], set()
    while todo:
        number = todo.pop(0)
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        if re.search(rb"/Type\s*/Page\b", body):
            out.append(number)
        else:
            todo[:0] = _references(_entry(body, b"Kids"))
    return out


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    decode = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {bytes.fromhex(a.decode()): decode(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, last = int(a, 16), int(b, 16)
            for k in range(first, min(last, first + 65535) + 1):
                out[k.to_bytes(len(a) // 2, "big")] = chr(int(c, 16) + k - first)
    return out


def _raw(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    unescape = lambda m: bytes([int(m[1], 8) & 255]) if m[1] else ESCAPES.get(m[2], b"" if m[2] in b"\r\n" else m[2])
    return re.sub(rb"\\(?:([0-7]{1,3})|(\r\n|.))", unescape, token[1:-1], flags=re.S)


def _shown(token: bytes, glyphs: dict[bytes, str]) -> str:
    raw = _raw(token)
    if not glyphs:
        return raw.decode("cp1252", "replace")
    width = max(map(len, glyphs))
    return "".join(glyphs.get(raw[k : k + width], "") for k in range(0, len(raw), width))


def _page_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """Lines of a page: a move to another height begins one."""
    lines, operands, glyphs = [""], [], {}
    for m in TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[+-]?\d*\.?\d+", token):
            operands.append(token)
            continue
        strings = [t for t in operands if t[:1] in b"(<"]
        if token == b"Tf":
            glyphs = fonts.get(next((t[1:] for t in operands if t[:1] == b"/"), b""), {})
        elif token in (b"T*", b"'", b'"') or (token in (b"Td", b"TD", b"Tm") and operands and float(operands[-1] if operands[-1][:1] not in b"(<[]/" else 0)):
            if lines[-1]:
                lines.append("")
        if token in (b"Tj", b"TJ", b"'", b'"'):
            for t in operands if token == b"TJ" else strings:
                if t[:1] in b"(<":
                    lines[-1] += _shown(t, glyphs)
                elif t[:1] not in b"[]/" and float(t) < -200 and not lines[-1].endswith(" "):
                    lines[-1] += " "  # a gap as wide as a space
        operands = []
    return "\n".join(line.rstrip() for line in lines).strip("\n")


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page. Encrypted files and files without any text are errors."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise UnreadablePdf("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise UnreadablePdf("the file is encrypted")
    objects = _objects(data)
    out = []
    for number in _pages(objects):
        body, seen, resources = objects[number], set(), b""
        holder = number
        while not resources and holder in objects and holder not in seen:  # resources are inherited
            seen.add(holder)
            found = re.search(rb"/Resources\s*(\d+)\s+\d+\s+R", objects[holder])
            resources = objects.get(int(found[1]), b"") if found else objects[holder] if b"/Resources" in objects[holder] else b""
            holder = next(iter(_references(_entry(objects[holder], b"Parent"))), -1)
        named = re.search(rb"/Font\s*(?:(\d+)\s+\d+\s+R|<<(.*?)>>)", resources, re.S)
        listed = (objects.get(int(named[1]), b"") if named[1] else named[2]) if named else b""
        fonts = {}
        for name, ref in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", listed):
            to_unicode = _references(_entry(objects.get(int(ref), b""), b"ToUnicode"))
            fonts[name] = _unicode_map(_stream(objects.get(to_unicode[0], b"")) or b"") if to_unicode else {}
        contents = [_stream(objects.get(r, b"")) or b"" for r in _references(_entry(body, b"Contents"))]
        out.append(_page_text(b"\n".join(contents), fonts))
    if not any(p.strip() for p in out):
        raise NoTextLayer("no page has text")
    return out


def joined_pages(pages: list[str]) -> tuple[str, list[int]]:
    """One text, and the offset at which each page ends; pages are parted by a line end."""
    ends, at = [], 0
    for k, page in enumerate(pages):
        at += len(page) + (k > 0)
        ends.append(at)
    return "\n".join(pages), ends


_READ = pa.struct([("text", pa.string()), ("page_ends", pa.list_(pa.int32())), ("reason", pa.string())])


@F.arrow_udf(from_arrow_type(_READ))
def pdf_text(content: pa.Array) -> pa.Array:
    """``text, page_ends, reason`` of files; the reason says why one has no text."""
    out = []
    for data in content.to_pylist():
        try:
            text, ends = joined_pages(pdf_pages(data or b""))
            out.append({"text": text, "page_ends": ends, "reason": None})
        except UnreadablePdf as error:
            out.append({"text": None, "page_ends": None, "reason": str(error)})
    return pa.array(out, _READ)
