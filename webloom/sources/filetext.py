"""Text of document files with the standard library: office formats that are zipped XML, binary ones (legacy), and PDFs (object streams, fonts' tables of characters)."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.frames import safe
from webloom.functions.urls import DOCUMENT_EXT
from webloom.sources import legacy

#: Characters kept of a text, and characters a page of a PDF has at least if it isn't a scan.
CAP, LEAST_PER_PAGE = 500_000, 20
RESULT = "status string, text string, n_pages int, needs_ocr boolean, error string"


def _texts(xml: str, paragraph: str, text: str) -> str:
    """One line for each paragraph element, of the contents of its text elements; tabs and breaks count as white space."""
    out = []
    for part in re.findall(rf"(?s)<{paragraph}(?:\s[^>]*)?(?<!/)>.*?</{paragraph}>", xml):
        part = re.sub(r"<\w+:(?:tab|br|cr)\b[^>]*/>", f"<{text}> </{text}>", part)
        out.append(unescape("".join(re.findall(rf"(?s)<{text}(?:\s[^>]*)?>(.*?)</{text}>", part))))
    return "\n".join(out)


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def read_docx(z: zipfile.ZipFile) -> tuple[str, int]:
    pages = re.search(r"<Pages>(\d+)</Pages>", z.read("docProps/app.xml").decode("utf-8", "replace")) if "docProps/app.xml" in z.namelist() else None
    return _texts(z.read("word/document.xml").decode("utf-8", "replace"), "w:p", "w:t"), int(pages[1]) if pages else 1


def read_pptx(z: zipfile.ZipFile) -> tuple[str, int]:
    slides = _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")
    return "\n".join(_texts(z.read(n).decode("utf-8", "replace"), "a:p", "a:t") for n in slides), len(slides)


def read_xlsx(z: zipfile.ZipFile) -> tuple[str, int]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = [unescape("".join(re.findall(r"(?s)<t(?:\s[^>]*)?>(.*?)</t>", si))) for si in re.findall(r"(?s)<si>(.*?)</si>", z.read("xl/sharedStrings.xml").decode("utf-8", "replace"))]
    sheets, lines = _numbered(z.namelist(), r"xl/worksheets/sheet(\d+)\.xml"), []
    for n in sheets:
        for row in re.findall(r"(?s)<row\b.*?</row>", z.read(n).decode("utf-8", "replace")):
            cells = []
            for attrs, body in re.findall(r"(?s)<c\b([^>]*)>(.*?)</c>", row):
                value = re.search(r"(?s)<v>(.*?)</v>", body)
                inline = "".join(re.findall(r"(?s)<t(?:\s[^>]*)?>(.*?)</t>", body))
                if 't="s"' in attrs and value and int(value[1]) < len(shared):
                    cells.append(shared[int(value[1])])
                elif inline or value:
                    cells.append(unescape(inline or value[1]))
            lines.append("\t".join(cells))
    return "\n".join(lines), len(sheets)


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _unescaped(raw: bytes) -> bytes:
    """Bytes of a string between brackets."""

    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else _ESCAPES.get(x, b"" if x in (b"\n", b"\r") else x)

    return re.sub(rb"\\([0-7]{1,3}|.|\n)", one, raw, flags=re.S)


_OBJECT = re.compile(rb"(?s)\b(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b")
_REF = rb"(\d+)\s+\d+\s+R"
#: Tokens of a content stream: a font with its size, a string, a string in hexadecimal, an array of both, a new line, the end of a text.
_SHOWN = re.compile(
    rb"(?s)/([^\s/\[\]<>()]+)\s+[-\d.]+\s+Tf|(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))|<([0-9A-Fa-f\s]+)>|(\[)|(\])|(-?\d+(?:\.\d+)?)(?=[\s(<\]])|(\bT[dD*m]|'|\")|(\bET\b)"
)
#: Thousandths of an em that two strings of an array are apart from which a blank lies between.
_GAP = 200


def _number(of: bytes, name: bytes, default: int = 0) -> int:
    m = re.search(rb"/" + name + rb"\s+(\d+)", of)
    return int(m[1]) if m else default


def _stream(body: bytes) -> bytes:
    """Content of a stream object; what is damaged at its end is left out. b'' for other objects and other filters."""
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return b""
    head, raw = body[: m.start()], body[m.end() : body.rfind(b"endstream")]
    if b"FlateDecode" not in head:
        return b"" if b"/Filter" in head else raw
    try:
        raw = zlib.decompressobj().decompress(raw)
    except zlib.error:
        return b""
    if _number(head, b"Predictor", 1) < 10:
        return raw
    width, out, above = _number(head, b"Columns", 1), bytearray(), None
    above = bytearray(width)
    for at in range(0, len(raw) - width, width + 1):  # rows that tell what was subtracted: nothing, or the row above
        row = bytearray(raw[at + 1 : at + 1 + width])
        if raw[at] == 2:
            row = bytearray((x + y) & 255 for x, y in zip(row, above))
        elif raw[at] == 1:
            for k in range(1, width):
                row[k] = (row[k] + row[k - 1]) & 255
        out += row
        above = row
    return bytes(out)


def _objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, those packed into object streams too."""
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            packed, first = _stream(body), _number(body, b"First")
            pairs = [int(x) for x in packed[:first].split()[: 2 * _number(body, b"N")]]
            ends = [*pairs[3::2], len(packed) - first]
            for number, start, end in zip(pairs[::2], pairs[1::2], ends):
                found.setdefault(number, packed[first + start : first + end])
    return found


def _characters(cmap: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, text of each code) of a font's table of characters."""
    chars = {}
    text = lambda h: bytes.fromhex(h.decode() + "0" * (len(h) % 2)).decode("utf-16-be", "replace")
    wide = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    for block in re.findall(rb"(?s)beginbfchar(.*?)endbfchar", cmap):
        chars |= {int(c, 16): text(t) for c, t in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"(?s)beginbfrange(.*?)endbfrange", cmap):
        for low, high, one, many in re.findall(rb"(?s)<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block):
            codes = range(int(low, 16), min(int(high, 16), int(low, 16) + 65_535) + 1)
            if one:
                start = text(one)
                chars |= {c: start[:-1] + chr(ord(start[-1]) + k) for k, c in enumerate(codes) if start}
            else:
                chars |= dict(zip(codes, map(text, re.findall(rb"<([0-9A-Fa-f]+)>", many))))
    return (len(wide[1]) // 2 if wide else 2), chars


def _fonts(page: bytes, objects: dict[int, bytes]) -> dict[bytes, tuple[int, dict[int, str]]]:
    """Tables of characters of the fonts a page names, in its own resources or those of the nodes above it."""
    at, fonts = page, {}
    for _ in range(8):
        named = re.search(rb"(?s)/Resources\s*(?:" + _REF + rb"|(<<.*))", at)
        inside = (objects.get(int(named[1]), b"") if named[1] else named[2]) if named else b""
        listed = re.search(rb"(?s)/Font\s*(?:" + _REF + rb"|<<(.*?)>>)", inside)
        if listed:
            for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+" + _REF, objects.get(int(listed[1]), b"") if listed[1] else listed[2]):
                table = re.search(rb"/ToUnicode\s+" + _REF, objects.get(int(number), b""))
                if table and int(table[1]) in objects:
                    fonts.setdefault(name, _characters(_stream(objects[int(table[1])])))
        above = re.search(rb"/Parent\s+" + _REF, at)
        if not above or int(above[1]) not in objects:
            break
        at = objects[int(above[1])]
    return fonts


def _shown(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """Text of a content stream, its strings read by the table of their font, else as Western text."""
    out, font, listed = [], None, False

    def read(raw: bytes) -> str:
        if font is None:
            return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
        width, chars = font
        return "".join(chars.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width))

    for block in re.findall(rb"(?s)\bBT\b(.*?\bET\b)", content):
        for name, literal, hexed, opened, closed, gap, line, end in _SHOWN.findall(block):
            if name:
                font = fonts.get(name)
            elif literal:
                out.append(read(_unescaped(literal[1:-1])))
            elif hexed:
                digits = re.sub(rb"\s", b"", hexed).decode()
                out.append(read(bytes.fromhex(digits + "0" * (len(digits) % 2))))
            elif opened or closed:
                listed = bool(opened)
            elif gap:
                out.append(" " if listed and float(gap) < -_GAP else "")
            elif line or end:
                out.append("\n")
    return "".join(out)


def read_pdf(data: bytes) -> tuple[str, int]:
    """(text, pages): the pages' content streams in the order of their objects; where no page is found, all streams."""
    objects = _objects(data)
    pages = [b for b in objects.values() if re.search(rb"/Type\s*/Page(?![a-zA-Z])", b)]
    parts = []
    for page in pages:
        named = re.search(rb"(?s)/Contents\s*(?:" + _REF + rb"|\[(.*?)\])", page)
        numbers = [int(named[1])] if named and named[1] else [int(n) for n in re.findall(_REF, named[2])] if named else []
        parts.append(_shown(b"\n".join(_stream(objects.get(n, b"")) for n in numbers), _fonts(page, objects)))
    if not "".join(parts).strip():
        parts = [_shown(_stream(m[0]), {}) for m in re.finditer(rb"(?s)<<(?:(?!endobj).){0,400}?>>\s*stream\r?\n.*?endstream", data)]
    return "\n".join(parts), max(1, len(pages), len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data)))


def tidy(text: str) -> str:
    """White space within lines as one blank, no blank lines."""
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def extract_text(data: bytes | None, ext: str | None) -> dict:
    """status (ok, unsupported, error), text, n_pages, needs_ocr, error of a file; never raises."""
    none = {"text": "", "n_pages": None, "needs_ocr": False, "error": ""}
    ext = (ext or "").lower()
    if ext not in DOCUMENT_EXT:
        return none | {"status": "unsupported"}
    if not data:
        return none | {"status": "error", "error": "empty file"}
    try:
        if ext == "pdf":
            if not data.startswith(b"%PDF"):
                raise ValueError("no PDF")
            text, pages = read_pdf(bytes(data))
        elif ext in ("doc", "xls", "ppt"):
            text, pages = {"doc": legacy.read_doc, "xls": legacy.read_xls, "ppt": legacy.read_ppt}[ext](bytes(data))
        else:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                text, pages = {"docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx}[ext](z)
    except Exception as e:  # any damage of a file is a result
        return none | {"status": "error", "error": f"{type(e).__name__}: {e}"[:200]}
    text = tidy(text)[:CAP]
    scan = ext == "pdf" and len(text) < LEAST_PER_PAGE * pages
    return {"status": "ok", "text": "" if scan else text, "n_pages": pages, "needs_ocr": scan, "error": ""}


def extract_files(files: DataFrame, key: str) -> DataFrame:
    """key and the extraction of every file (columns ext, content)."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [extract_text(c, e) for c, e in zip(b["content"], b["ext"])]
            out = pd.DataFrame(found, columns=["status", "text", "n_pages", "needs_ocr", "error"])
            out["n_pages"] = out["n_pages"].astype("Int32")
            out.insert(0, key, b["k"].to_numpy())
            yield out

    return files.select(F.col(key).alias("k"), "ext", "content").mapInPandas(safe(run), f"{key} {kind}, {RESULT}")


def extraction_job(catalogue: DataFrame, stored: DataFrame) -> DataFrame:
    """The catalogue after a run: pending files with a SHA-1 take their extraction; those whose file is missing become errors.

    catalogue: url, ext, status, sha1; stored: sha1, content.
    """
    pending = catalogue.where((F.col("status") == "pending") & (F.coalesce("sha1", F.lit("")) != ""))
    found = pending.join(stored.dropDuplicates(["sha1"]), "sha1", "left")
    done = extract_files(found.where(F.col("content").isNotNull()), "url")
    lost = found.where(F.col("content").isNull()).select("url", F.lit("error").alias("status"), F.lit("").alias("text"), F.lit(None).cast("int").alias("n_pages"), F.lit(False).alias("needs_ocr"), F.lit("file is missing").alias("error"))
    rest = catalogue.join(pending.select("url"), "url", "left_anti").select("url", "status", F.lit("").alias("text"), F.lit(None).cast("int").alias("n_pages"), F.lit(False).alias("needs_ocr"), F.lit("").alias("error"))
    return done.unionByName(lost).unionByName(rest)
