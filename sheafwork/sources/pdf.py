"""A reader for a subset of PDF: plain and Flate streams, simple fonts with one byte a character or a ToUnicode map.

Object streams, other filters and ciphers are outside it: a protected file gives the code encrypted-document, and one without
readable text no-text-layer.
"""

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfProblem(Exception):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def unescape(m: re.Match) -> bytes:
        x = m.group(1)
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", unescape, token[1:-1], flags=re.S)


def _cmap(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out |= {k: chr(int(c, 16) + k - int(a, 16)) for k in range(int(a, 16), int(b, 16) + 1)}
    return out


def page_runs(content: bytes, fonts: dict[bytes, dict[int, str]], height: float) -> list[tuple[float, float, str]]:
    """(x, y from the top, text) of each shown string."""
    runs, stack = [], []
    x = y = line_x = line_y = leading = 0.0
    font: dict[int, str] | None = None

    def show(raw: bytes) -> None:
        if font:
            wide = max(font) > 255
            codes = [int.from_bytes(raw[i : i + 2]) for i in range(0, len(raw), 2)] if wide else list(raw)
            text = "".join(font.get(c, "") for c in codes)
        else:
            text = raw.decode("cp1252", "replace")
        if text.strip():
            runs.append((x, height - y, text))

    for token in _TOKEN.findall(content):
        if token[:1] in b"(</[]+-.0123456789":
            stack.append(token)
            continue
        numbers = [float(t) for t in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
        if token == b"BT":
            x = y = line_x = line_y = 0.0
        elif token in (b"Td", b"TD") and len(numbers) >= 2:
            line_x, line_y = line_x + numbers[-2], line_y + numbers[-1]
            x, y = line_x, line_y
            leading = -numbers[-1] if token == b"TD" else leading
        elif token == b"Tm" and len(numbers) >= 6:
            x, y = line_x, line_y = numbers[-2], numbers[-1]
        elif token == b"TL" and numbers:
            leading = numbers[-1]
        elif token == b"T*":
            line_y -= leading
            x, y = line_x, line_y
        elif token == b"Tf" and stack:
            font = next((fonts.get(t[1:]) for t in stack if t[:1] == b"/"), None)
        elif token in (b"Tj", b"'", b'"') and stack:
            if token != b"Tj":
                line_y -= leading
                x, y = line_x, line_y
            show(_string(stack[-1]))
        elif token == b"TJ":
            show(b"".join(_string(t) for t in stack if t[:1] in b"(<"))
        stack = []
    return runs


def read_pdf(data: bytes) -> dict:
    if not data.startswith(b"%PDF"):
        raise PdfProblem("extraction-failed")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise PdfProblem("encrypted-document")
    objects = {int(n): body for n, _, body in _OBJECT.findall(data)}

    def stream(body: bytes) -> bytes:
        m = _STREAM.search(body)
        raw = m.group(1) if m else b""
        if b"/FlateDecode" in body:
            return zlib.decompressobj().decompress(raw)
        return raw if b"/Filter" not in body else b""

    refs = lambda name, body: [int(r) for block in re.findall(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) for r in re.findall(rb"(\d+)\s+\d+\s+R", block)]
    maps: dict[int, dict[int, str]] = {n: _cmap(stream(objects[t[0]])) for n, b in objects.items() if b"/Font" in b and (t := refs(b"ToUnicode", b)) and t[0] in objects}
    pages = [b for b in objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    lines, names = [], set()
    for number, page in enumerate(pages):
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", page + data)
        height = float(box.group(4)) if box else 792.0
        width = float(box.group(3)) if box else 612.0
        own = page
        for r in refs(b"Resources", page):
            own += objects.get(r, b"")
        for r in refs(b"Font", own):
            own += objects.get(r, b"")
        named = {n: int(r) for n, r in re.findall(rb"/([A-Za-z0-9]+)\s+(\d+)\s+\d+\s+R", own)}
        fonts = {n: maps[r] for n, r in named.items() if r in maps}
        names |= {m.decode() for r in named.values() for m in re.findall(rb"/BaseFont\s*/([^\s/<>]+)", objects.get(r, b""))}
        content = b"\n".join(stream(objects[r]) for r in refs(b"Contents", page) if r in objects)
        rows: list[list[tuple[float, float, str]]] = []
        for run in sorted(page_runs(content, fonts, height), key=lambda r: (r[1], r[0])):
            if rows and abs(rows[-1][0][1] - run[1]) <= 0.006 * height:
                rows[-1].append(run)
            else:
                rows.append([run])
        for row in rows:
            row.sort()
            text = row[0][2]
            for before, run in zip(row, row[1:]):
                far = run[0] - before[0] - len(before[2]) * 0.008 * width
                text += ("\t" if far > 0.035 * width else " " if not text.endswith(" ") else "") + run[2]
            lines.append((number, row[0][1] / height, text))
    steps = sorted(b[1] - a[1] for a, b in zip(lines, lines[1:]) if a[0] == b[0] and b[1] > a[1])
    median = steps[len(steps) // 2] if steps else 0.0
    out = []
    for k, (number, y, text) in enumerate(lines):
        if k and (lines[k - 1][0] != number or y - lines[k - 1][1] > 1.6 * median):
            out.append("")
        out.append(text)
    links = sorted({m.decode("latin-1") for m in re.findall(rb"/URI\s*\(([^)]*)\)", data)})
    row = {"plain_text": "\n".join(out).strip(), "page_count": len(pages), "table_count": sum(t.count("\t") >= 2 for _, _, t in lines), "fonts": sorted(names), "links": links}
    return row if row["plain_text"] else row | {"error": "no-text-layer"}
