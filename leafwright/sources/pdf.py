"""Text layers of PDF files, read through Spark's binaryFile source.

A small reader in plain Python: objects, object streams, Flate streams, the page
tree, text operators, fonts' encodings and ToUnicode maps, and tables within
ruled lines. What it cannot read (encryption, other filters, no page tree, codes
whose letters nothing tells) becomes a row's error, never a wrong text. Only the
pages asked for are decoded.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
REF = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

#: Glyph names of printable ASCII that are no letters, in order of their codes, and of signs beyond it.
ASCII_NAMES = (
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine"
    " colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde"
).split()
SIGNS = {
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "guillemotleft": "«", "guillemotright": "»",
    "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "section": "§", "paragraph": "¶", "degree": "°", "Euro": "€", "sterling": "£", "yen": "¥",
    "cent": "¢", "copyright": "©", "registered": "®", "trademark": "™", "plusminus": "±", "multiply": "×", "divide": "÷", "minus": "−", "periodcentered": "·", "mu": "µ", "germandbls": "ß",
    "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı", "exclamdown": "¡", "questiondown": "¿", "nbspace": " ",
    "ff": "\ufb00", "fi": "\ufb01", "fl": "\ufb02", "ffi": "\ufb03", "ffl": "\ufb04",
}
ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "dieresis": "\u0308", "ring": "\u030a", "caron": "\u030c", "cedilla": "\u0327"}
#: Codes of the standard encoding that are not ASCII's, and its commonest signs.
STANDARD = {39: "’", 96: "‘", 161: "¡", 170: "“", 174: "\ufb01", 175: "\ufb02", 177: "–", 183: "•", 186: "”", 188: "…", 208: "—"}
CODECS = {b"WinAnsiEncoding": "cp1252", b"MacRomanEncoding": "mac_roman"}


class PdfError(ValueError):
    pass


@lru_cache(maxsize=4096)
def glyph(name: str) -> str | None:
    """The letter that a glyph's name tells, or None."""
    name = name.split(".", 1)[0]
    if name in SIGNS:
        return SIGNS[name]
    if name in ASCII_NAMES:
        return [chr(c) for c in range(32, 127) if not chr(c).isalpha()][ASCII_NAMES.index(name)]
    if re.fullmatch("[A-Za-z]", name):
        return name
    if m := re.fullmatch("uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace") if m[1] else chr(int(m[2], 16)) if int(m[2], 16) < 0x110000 else None
    if (m := re.fullmatch("([A-Za-z])(.+)", name)) and m[2] in ACCENTS:
        return unicodedata.normalize("NFC", m[1] + ACCENTS[m[2]])
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if name[:1].isupper() else 'SMALL'} LETTER {name.upper().replace('LAMBDA', 'LAMDA')}")
    except KeyError:
        return None


@lru_cache(maxsize=8)
def code_page(name: bytes) -> dict[int, str]:
    """Code -> letter of a named encoding; the standard one if the name is none of those known."""
    if name in CODECS:
        return {c: t for c in range(32, 256) if (t := bytes([c]).decode(CODECS[name], "ignore"))}
    return {c: chr(c) for c in range(32, 127)} | STANDARD


class Pdf:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise PdfError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise PdfError("encrypted")
        self.objects = {int(m[1]): m[3] for m in OBJECT.finditer(data)}
        for body in [b for b in self.objects.values() if b"/ObjStm" in b]:
            head = body.split(b"stream", 1)[0]
            inner, n, first = self.stream(body), int(re.search(rb"/N\s+(\d+)", head)[1]), int(re.search(rb"/First\s+(\d+)", head)[1])
            numbers = list(map(int, inner[:first].split()))
            starts = numbers[1::2][:n]
            for number, a, b in zip(numbers[0::2], starts, [*starts[1:], len(inner) - first]):
                self.objects.setdefault(number, inner[first + a : first + b])

    def stream(self, body: bytes) -> bytes:
        m = STREAM.search(body)
        if not m:
            return b""
        head = body[: m.start()]
        if b"/Filter" not in head:
            return m[1]
        if b"/FlateDecode" not in head or re.search(rb"/(LZW|ASCII85|ASCIIHex|DCT|JBIG2|JPX|CCITTFax|RunLength)", head):
            raise PdfError("unsupported stream filter")
        return zlib.decompressobj().decompress(m[1])

    def _refs(self, body: bytes, key: bytes) -> list[int]:
        m = re.search(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(r) for r in REF.findall(m[1])] if m else []

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page body, resources' body) in page order."""
        catalog = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), None)
        roots = self._refs(catalog, rb"/Pages") if catalog else []
        if not roots:
            raise PdfError("no page tree")
        found, todo, seen = [], [(roots[0], b"")], set()
        while todo:
            number, inherited = todo.pop()
            body = self.objects.get(number, b"")
            if number in seen:
                continue
            seen.add(number)
            own = self._resources(body) or inherited
            if re.search(rb"/Kids", body):
                todo += [(k, own) for k in reversed(self._refs(body, rb"/Kids"))]
            elif re.search(rb"/Type\s*/Page\b", body):
                found.append((body, own))
        return found

    def _resources(self, body: bytes) -> bytes:
        refs = self._refs(body, rb"/Resources")
        if refs:
            return self.objects.get(refs[0], b"")
        at = body.find(b"/Resources")
        return body[at:] if at >= 0 else b""

    def _fonts(self, resources: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Font name -> (bytes of a code, code map)."""
        m = re.search(rb"/Font\s*(<<.*?>>|\d+\s+\d+\s+R)", resources, re.S)
        if not m:
            return {}
        body = m[1] if m[1].startswith(b"<<") else self.objects.get(int(REF.match(m[1])[1]), b"")
        out: dict[bytes, tuple[int, dict[int, str]]] = {}
        for name, ref in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", body):
            font = self.objects.get(int(ref), b"")
            wide = 2 if b"/Type0" in font else 1
            maps = self._refs(font, rb"/ToUnicode")
            table = self._cmap(self.stream(self.objects.get(maps[0], b""))) if maps else {}
            out[name] = (wide, table if wide == 2 else self._encoding(font) | table)
        return out

    def _encoding(self, font: bytes) -> dict[int, str]:
        """Code map of a font of single bytes: its named encoding and the differences from it, as far as glyph names tell letters."""
        m = re.search(rb"/Encoding\s*(/\w+|\d+\s+\d+\s+R|<<.*?>>)", font, re.S)
        body = m[1] if m else b""
        if ref := REF.fullmatch(body):
            body = self.objects.get(int(ref[1]), b"")
        base = re.search(rb"/(WinAnsiEncoding|MacRomanEncoding|StandardEncoding)\b", body)
        if re.search(rb"/BaseFont\s*/(\w{6}\+)?(Symbol|ZapfDingbats)", font) and not base:
            table: dict[int, str] = {}
        else:
            table = dict(code_page(base[1] if base else b""))
        given = re.search(rb"/Differences\s*\[(.*?)\]", body, re.S)
        at = 0
        for item in re.findall(rb"\d+(?=[\s/\]]|$)|/[^\s/\[\]]+", given[1]) if given else []:
            if item[:1] != b"/":
                at = int(item)
                continue
            letter = glyph(item[1:].decode("latin-1"))
            if letter is None:
                table.pop(at, None)
            else:
                table[at] = letter
            at += 1
        return table

    @staticmethod
    @lru_cache(maxsize=64)
    def _cmap(data: bytes) -> dict[int, str]:
        table: dict[int, str] = {}
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            table |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*\[([^\]]*)\]", part):
                table |= {int(a, 16) + k: text(x) for k, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", c)[: int(b, 16) - int(a, 16) + 1])}
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                start = text(c)
                table |= {k: start[:-1] + chr(ord(start[-1]) + k - int(a, 16)) for k in range(int(a, 16), int(b, 16) + 1)}
        return table

    def steps(self, page: tuple[bytes, bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
        """(operator, operands) of a page's content."""
        content = b"\n".join(self.stream(self.objects.get(r, b"")) for r in self._refs(page[0], rb"/Contents"))
        held: list[bytes] = []
        for m in TOKEN.finditer(content):
            token = m[0]
            if token[:1].isalpha() or token in (b"'", b'"'):
                yield token, held
                held = []
            else:
                held.append(token)

    @staticmethod
    def shown(operator: bytes, operands: list[bytes], font: tuple[int, dict[int, str]] | None) -> str:
        """The text of a showing operator; a code without a known letter is an error."""
        wide, table = font or (1, code_page(b""))
        out: list[str] = []
        for t in operands:
            if t[:1] == b"<":
                digits = re.sub(rb"\s", b"", t[1:-1]).decode()
                raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
            elif t[:1] == b"(":
                raw = re.sub(rb"\\([0-7]{1,3}|.|\n)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], m[1].strip(b"\n")), t[1:-1], flags=re.S)
            else:
                if operator == b"TJ" and re.fullmatch(rb"-\d+\.?\d*", t) and float(t) < -200:
                    out.append(" ")
                continue
            try:
                out.append("".join(map(table.__getitem__, raw if wide == 1 else struct.unpack(f">{len(raw) // 2}H", raw))))
                continue
            except (KeyError, struct.error):  # codes without a letter, or half a code
                pass
            for k in range(0, len(raw), wide):
                code = int.from_bytes(raw[k : k + wide], "big")
                letter = table.get(code, " " if wide == 1 and code < 32 else None)
                if letter is None:
                    raise PdfError(f"no letter is known for code {code} of a font")
                out.append(letter)
        return "".join(out)

    def text(self, page: tuple[bytes, bytes]) -> str:
        fonts, font = self._fonts(page[1]), None
        out: list[str] = []
        for op, args in self.steps(page):
            if op in (b"Tj", b"'", b'"', b"TJ"):
                out.append(("\n" if op in (b"'", b'"') else "") + self.shown(op, args, font))
            elif op == b"Tf" and len(args) > 1:
                font = fonts.get(args[-2][1:])
            elif op in (b"Td", b"TD") and len(args) > 1:
                out.append("\n" if float(args[-1]) else " ")
            elif op in (b"T*", b"ET", b"Tm"):
                out.append("\n")
        return re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+", " ", "".join(out))).strip()

    def tables(self, page: tuple[bytes, bytes]) -> list[list[list[str]]]:
        """Tables within ruled lines, rows of cells from the top; a text is in the cell in which it starts, a cell without a text is empty."""
        fonts, font = self._fonts(page[1]), None
        words: list[tuple[float, float, str]] = []
        across: list[tuple[float, float, float]] = []  # (y, x0, x1)
        down: list[tuple[float, float, float]] = []  # (x, y0, y1)
        unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        saved, matrix, line, leading, pen = [], unit, unit, 0.0, (0.0, 0.0)

        def under(m, n):
            return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])

        def rule(x0, y0, x1, y1):
            (_, _, _, _, a, b), (_, _, _, _, c, d) = under((1, 0, 0, 1, x0, y0), matrix), under((1, 0, 0, 1, x1, y1), matrix)
            if abs(b - d) < 2 <= abs(a - c):
                across.append(((b + d) / 2, min(a, c), max(a, c)))
            elif abs(a - c) < 2 <= abs(b - d):
                down.append(((a + c) / 2, min(b, d), max(b, d)))

        for op, args in self.steps(page):
            if op in (b"Tj", b"'", b'"', b"TJ"):
                if op in (b"'", b'"'):
                    line = under((1, 0, 0, 1, 0, -leading), line)
                at = under(line, matrix)
                words.append((at[4], at[5], self.shown(op, args, font)))
            elif op == b"Tf" and len(args) > 1:
                font = fonts.get(args[-2][1:])
            elif op == b"BT":
                line = unit
            elif op == b"T*":
                line = under((1, 0, 0, 1, 0, -leading), line)
            elif op == b"q":
                saved.append(matrix)
            elif op == b"Q" and saved:
                matrix = saved.pop()
            else:
                n = [float(a) for a in args if re.fullmatch(rb"[-+]?(\d+\.?\d*|\.\d+)", a)]
                if op == b"TL" and n:
                    leading = n[-1]
                elif op in (b"Td", b"TD") and len(n) > 1:
                    leading = -n[-1] if op == b"TD" else leading
                    line = under((1, 0, 0, 1, n[-2], n[-1]), line)
                elif op == b"Tm" and len(n) == 6:
                    line = tuple(n)
                elif op == b"cm" and len(n) == 6:
                    matrix = under(tuple(n), matrix)
                elif op == b"m" and len(n) > 1:
                    pen = (n[-2], n[-1])
                elif op == b"l" and len(n) > 1:
                    rule(*pen, n[-2], n[-1])
                    pen = (n[-2], n[-1])
                elif op == b"re" and len(n) == 4:
                    x, y, w, h = n
                    if min(abs(w), abs(h)) < 2:
                        rule(x, y, x + (w if abs(w) >= 2 else 0), y + (h if abs(h) >= 2 else 0))
                    else:
                        for edge in ((x, y, x + w, y), (x, y + h, x + w, y + h), (x, y, x, y + h), (x + w, y, x + w, y + h)):
                            rule(*edge)
        return grids(across, down, words)


def _distinct(values: Iterable[float], near: float) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > near:
            out.append(v)
    return out


def grids(across: list[tuple[float, float, float]], down: list[tuple[float, float, float]], words: list[tuple[float, float, str]], near: float = 3.0) -> list[list[list[str]]]:
    """Tables of two cells at least, top first, from lines across (y, x0, x1) and down (x, y0, y1) that touch, and texts at (x, y)."""
    down = sorted(set(down))
    across, lefts = sorted(set(across)), [d[0] for d in down]
    owner = list(range(len(across) + len(down)))

    def root(k: int) -> int:
        while owner[k] != k:
            owner[k] = k = owner[owner[k]]
        return k

    for k, (y, x0, x1) in enumerate(across):
        for j in range(bisect_left(lefts, x0 - near), bisect_right(lefts, x1 + near)):
            if down[j][1] - near <= y <= down[j][2] + near:
                owner[root(k)] = root(len(across) + j)
    groups: dict[int, tuple[list[float], list[float]]] = {}
    for k in range(len(owner)):
        xs, ys = groups.setdefault(root(k), ([], []))
        (ys if k < len(across) else xs).append((across[k] if k < len(across) else down[k - len(across)])[0])
    found = []
    for xs, ys in groups.values():
        xs, ys = _distinct(xs, near), _distinct(ys, near)
        wide, high = len(xs) - 1, len(ys) - 1
        if wide < 1 or high < 1 or wide * high < 2:
            continue
        cells: list[list[list[tuple[float, str]]]] = [[[] for _ in range(wide)] for _ in range(high)]
        for x, y, t in words:
            i, j = bisect_right(xs, x + 0.01) - 1, bisect_right(ys, y + 0.01) - 1
            if 0 <= i < wide and 0 <= j < high:
                cells[high - 1 - j][i].append((y, t))
        found.append((-ys[-1], xs[0], [[_joined(c) for c in row] for row in cells]))
    return [t for _, _, t in sorted(found, key=lambda f: f[:2])]


def _joined(parts: list[tuple[float, str]]) -> str:
    """Texts of a cell: those at one height follow each other, others are lines."""
    lines: list[str] = []
    last = None
    for y, t in sorted(parts, key=lambda p: -p[0]):
        if last is not None and abs(last - y) < 2:
            lines[-1] += t
        else:
            lines.append(t)
        last = y
    return "\n".join(lines).strip()


def read_pages(data: bytes, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, str | None, str | None, list | None]]:
    """(page number from 1, text, error, tables) of the pages wanted, or of all."""
    try:
        pdf = Pdf(data)
        pages = pdf.pages()
    except (PdfError, zlib.error, TypeError, ValueError) as e:
        yield None, None, f"{type(e).__name__}: {e}", None
        return
    chosen = set(wanted) if wanted is not None else None
    for number, page in enumerate(pages, 1):
        if chosen is None or number in chosen:
            try:
                yield number, pdf.text(page), None, pdf.tables(page)
            except (PdfError, zlib.error, ValueError) as e:
                yield number, None, f"{type(e).__name__}: {e}", None


def pages_of(files: DataFrame, pages: Iterable[int] | None = None) -> DataFrame:
    """(path, stem, length, page_no, text, error, tables) of PDF files (path, length, content): a row for each page wanted, or one with an error for a file that cannot be read."""
    wanted = None if pages is None else sorted(set(pages))
    kind = pa.list_(pa.list_(pa.list_(pa.string())))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, length = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                rows = list(read_pages(batch.column(2)[k].as_buffer().to_pybytes(), wanted))
                n, t, e, g = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), pa.array([length] * len(rows), pa.int64()), pa.array(n, pa.int32()), pa.array(t, pa.string()), pa.array(e, pa.string()), pa.array(g, kind)],
                    ["path", "length", "page_no", "text", "error", "tables"],
                )

    got = files.select("path", "length", "content").mapInArrow(run, "path string, length long, page_no int, text string, error string, tables array<array<array<string>>>")
    return got.select("path", F.regexp_extract("path", r"([^/\\]*?)(\.[^./\\]*)?$", 1).alias("stem"), "length", "page_no", "text", "error", "tables")


def pdf_pages(spark: SparkSession, path: str, pages: Iterable[int] | None = None, glob: str = "*.pdf") -> DataFrame:
    """``pages_of`` the files at ``path``."""
    return pages_of(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path), pages)
