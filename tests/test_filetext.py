import io
import struct
import zipfile
import zlib

import pytest

from webloom.sources import filetext as T


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


DOCX = zipped(word__document_xml='<w:document><w:p><w:r><w:t>Thông  báo</w:t></w:r><w:tab/><w:r><w:t xml:space="preserve"> A &amp; B</w:t></w:r></w:p><w:p/><w:p><w:t>Hai</w:t></w:p></w:document>', docProps__app_xml="<Pages>3</Pages>")
XLSX = zipped(xl__sharedStrings_xml="<sst><si><t>Tên</t></si><si><r><t>Đi</t></r><r><t>ểm</t></r></si></sst>", xl__worksheets__sheet1_xml='<row r="1"><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>9.5</v></c><c t="inlineStr"><is><t>x</t></is></c></row>')
PPTX = zipped(ppt__slides__slide2_xml="<a:p><a:t>hai</a:t></a:p>", ppt__slides__slide10_xml="<a:p><a:t>mười</a:t></a:p>", ppt__slides__slide1_xml="<a:p><a:t>một</a:t></a:p>")


def pdf(text, pages=1):
    body = zlib.compress(b"BT /F1 12 Tf (" + text + b") Tj 0 -14 Td [(More ) -20 (text)] TJ ET") if text else b""
    return b"%PDF-1.4\n" + b"<< /Type /Page >>\n" * pages + b"<< /Type /Pages >> << /Length 9 /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\n"


@pytest.mark.parametrize("data,ext,text,pages", [(DOCX, "docx", "Thông báo A & B\nHai", 3), (XLSX, "xlsx", "Tên Điểm\n9.5 x", 1), (PPTX, "pptx", "một\nhai\nmười", 3), (pdf(rb"Report \(final\) of May 2026"), "PDF", "Report (final) of May 2026\nMore text", 1)])
def test_formats(data, ext, text, pages):
    r = T.extract_text(data, ext)
    assert (r["status"], r["text"], r["n_pages"], r["needs_ocr"]) == ("ok", text, pages, False)


def test_scans_damage_and_other_formats():
    assert T.extract_text(pdf(b""), "pdf")["needs_ocr"] and T.extract_text(pdf(b"Short", 9), "pdf")["text"] == ""
    assert T.extract_text(DOCX[:50], "docx")["status"] == "error" and T.extract_text(b"", "pdf")["status"] == "error" and T.extract_text(b"x", "pdf")["status"] == "error"
    assert {T.extract_text(b"x", e)["status"] for e in ("zip", "", None)} == {"unsupported"} and {T.extract_text(b"x", e)["status"] for e in ("doc", "xls", "ppt")} == {"error"}


def test_job(spark):
    catalogue = spark.createDataFrame([("u1", "docx", "pending", "s1"), ("u2", "pdf", "pending", "s2"), ("u3", "pdf", "ok", "s3"), ("u4", "pdf", "pending", None)], "url string, ext string, status string, sha1 string")
    stored = spark.createDataFrame([("s1", bytearray(DOCX)), ("s1", bytearray(DOCX))], "sha1 string, content binary")
    out = {r["url"]: (r["status"], r["n_pages"]) for r in T.extraction_job(catalogue, stored).collect()}
    assert out == {"u1": ("ok", 3), "u2": ("error", None), "u3": ("ok", None), "u4": ("pending", None)}


def packed_pdf() -> bytes:
    """A page whose objects lie in an object stream and whose font has codes of its own."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <1ECD> endbfchar 1 beginbfrange <0003> <0005> <0063> endbfrange 1 beginbfrange <0006> <0007> [<00620031> <1ED5>] endbfrange"
    content = b"BT /F1 12 Tf 1 0 0 1 10 10 Tm [<00010002> 30 <0003> -400 <0006>] TJ T* (\\000\\007) Tj ET"
    stream = lambda n, body: b"%d 0 obj <</Filter /FlateDecode /Length 1>> stream\n%s\nendstream endobj\n" % (n, zlib.compress(body))
    inner = [b"<</Type /Pages /Kids [2 0 R] /Count 1 /Resources <</Font <</F1 5 0 R>>>>>>", b"<</Type /Page /Parent 1 0 R /Contents 6 0 R>>", b"<</Type /Font /ToUnicode 7 0 R>>"]
    heads, at = [], 0
    for n, body in zip((1, 2, 5), inner):
        heads.append(b"%d %d" % (n, at))
        at += len(body) + 1
    head = b" ".join(heads) + b" "
    objects = b"9 0 obj <</Type /ObjStm /N 3 /First %d /Filter /FlateDecode>> stream\n%s\nendstream endobj\n" % (len(head), zlib.compress(head + b" ".join(inner)))
    return b"%PDF-1.5\n" + stream(6, content) + stream(7, cmap) + objects + b"%%EOF"


def test_packed_pdf_with_font_tables():
    text, pages = T.read_pdf(packed_pdf())
    assert T.tidy(text) == "Học b1\nổ" and pages == 1
    for cut in range(20, len(packed_pdf()), 37):
        assert T.extract_text(packed_pdf()[:cut], "pdf")["status"] == "ok"


def compound(parts: dict[str, bytes], small: bool = False) -> bytes:
    """A compound file of some streams, in sectors of 512 bytes; small ones in the root's stream if wanted."""
    pad = lambda raw, n: raw + b"\0" * (-len(raw) % n)
    body, table, entries = b"", [], []
    end, free = 0xFFFFFFFE, 0xFFFFFFFF

    def put(raw: bytes) -> int:
        nonlocal body
        start, raw = len(table), pad(raw, 512)
        n = len(raw) // 512
        table.extend([*range(start + 1, start + n), end])
        body += raw
        return start

    def entry(name: str, kind: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le")
        return pad(raw, 64)[:64].ljust(64, b"\0") + struct.pack("<HB", len(raw) + 2, kind) + b"\0" * 49 + struct.pack("<II", start, size) + b"\0" * 4

    minis, mini_table = b"", []
    for name, raw in parts.items():
        if small:
            start, n = len(mini_table), -(-len(raw) // 64)
            mini_table += [*range(start + 1, start + n), end]
            minis += pad(raw, 64)
            entries.append(entry(name, 2, start, len(raw)))
        else:
            raw = raw.ljust(4096, b"\0")
            entries.append(entry(name, 2, put(raw), len(raw)))
    root = put(minis) if small else end
    minifat = put(struct.pack(f"<{len(mini_table)}I", *mini_table).ljust(512, b"\xff")) if small else end
    directory = put(b"".join([entry("Root Entry", 5, root, len(minis)), *entries]))
    fat = len(table)
    table.append(0xFFFFFFFD)
    body += struct.pack(f"<{len(table)}I", *table).ljust(512, b"\xff")
    assert len(table) <= 128
    head = T.legacy.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, directory, 0, 4096, minifat, int(small), end, 0, fat)
    return (head + struct.pack("<I", free) * 108).ljust(512, b"\xff")[:512] + body


def test_binary_documents():
    wide, narrow = "Thông báo\r", "Hai \x13 HYPERLINK x \x14link\x15 end\r"
    main = bytearray(2048)
    main[11] = 2
    struct.pack_into("<II", main, 0x1A2, 0, 3 + 5 + 4 * 3 + 16)
    main[1024 : 1024 + 2 * len(wide)] = wide.encode("utf-16-le")
    main[1536 : 1536 + len(narrow)] = narrow.encode("cp1252")
    pieces = struct.pack("<III", 0, len(wide), len(wide) + len(narrow)) + struct.pack("<HIH", 0, 1024, 0) + struct.pack("<HIH", 0, 1536 * 2 | 0x40000000, 0)
    clx = b"\x01\0\0" + b"\x02" + struct.pack("<I", len(pieces)) + pieces
    for small in (False, True):
        r = T.extract_text(compound({"WordDocument": bytes(main), "1Table": clx}, small), "doc")
        assert (r["status"], r["text"]) == ("ok", "Thông báo\nHai link end")


def test_binary_workbooks():
    record = lambda kind, raw: struct.pack("<HH", kind, len(raw)) + raw
    first, second = "Tên lớp", "abc"
    sst = struct.pack("<II", 2, 2) + struct.pack("<HB", len(first), 1) + first.encode("utf-16-le")[:6]
    rest = b"\x01" + first.encode("utf-16-le")[6:] + struct.pack("<HB", len(second), 0) + second.encode()
    book = record(0x809, b"\0" * 8) + record(0x85, b"\0" * 8) + record(0xFC, sst) + record(0x3C, rest) + record(0x0A, b"") + record(0x809, b"\0" * 8)
    book += record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 0, 9.5))
    book += record(0x27E, struct.pack("<HHHI", 1, 1, 0, (7 << 2) | 2)) + record(0xBD, struct.pack("<HH", 2, 0) + struct.pack("<HI", 0, (125 << 2) | 3) + struct.pack("<HI", 0, (3 << 2) | 2) + struct.pack("<H", 1)) + record(0x0A, b"")
    r = T.extract_text(compound({"Workbook": book}), "xls")
    assert (r["status"], r["text"], r["n_pages"]) == ("ok", "Tên lớp abc\n9.5 7\n1.25 3", 1)


def test_binary_slides():
    atom = lambda kind, raw, version=0: struct.pack("<HHI", version, kind, len(raw)) + raw
    slide = lambda raw: atom(0x3EE, atom(0xF00D, raw, 15), 15)
    deck = slide(atom(0xFA0, "Một\rhai".encode("utf-16-le"))) + slide(atom(0xFA8, b"three")) + atom(0xFBA, b"x\0")
    whole = compound({"PowerPoint Document": deck})
    r = T.extract_text(whole, "ppt")
    assert (r["status"], r["text"], r["n_pages"]) == ("ok", "Một\nhai\nthree", 2)
    for cut in range(0, len(whole), 331):
        assert T.extract_text(whole[:cut], "ppt")["status"] in ("ok", "error")
