"""Text of the binary office formats (doc, xls, ppt): streams of compound files, read with the standard library.

Only what holds text is looked at. Damaged files raise, or give what could be read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

# Signature of a compound file, ends of its chains, and the records of the formats that hold text.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
LAST = 0xFFFFFFFA
SST, CONTINUE, LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, SHEET, BOF = 0xFC, 0x3C, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x85, 0x809
TEXT_WIDE, TEXT_BYTES, SLIDE = 0xFA0, 0xFA8, 0x3EE


def streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name."""
    if data[:8] != SIGNATURE:
        raise ValueError("no compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, cutoff, mini_table, lists = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60, 68))
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    parts = numbers(data[76:512])
    seen = set()
    while lists < LAST and lists not in seen:  # tables of a large file are listed in further sectors
        seen.add(lists)
        more = numbers(sector(lists))
        parts, lists = parts + more[:-1], more[-1] if more else LAST
    table = [x for p in parts if p < LAST for x in numbers(sector(p))]

    def chain(start: int, links: list[int], piece) -> bytes:
        out, met = [], set()
        while start < LAST and start < len(links) and start not in met:
            met.add(start)
            out.append(piece(start))
            start = links[start]
        return b"".join(out)

    entries = chain(directory, table, sector)
    found: dict[str, bytes] = {}
    root, mini = b"", numbers(chain(mini_table, table, sector)) if mini_table < LAST else []
    for at in range(0, len(entries) - 127, 128):
        named, kind = struct.unpack_from("<HB", entries, at + 64)
        start, length = struct.unpack_from("<II", entries, at + 116)
        name = entries[at : at + max(0, named - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            root = chain(start, table, sector)
        elif kind == 2:
            whole = chain(start, table, sector) if length >= cutoff else chain(start, mini, lambda n: root[n * small : (n + 1) * small])
            found[name] = whole[:length]
    return found


def read_doc(data: bytes) -> tuple[str, int]:
    """Text of a document by its table of pieces."""
    parts = streams(data)
    main = parts["WordDocument"]
    table = parts["1Table" if main[11] & 2 else "0Table"]
    at, length = struct.unpack_from("<II", main, 0x1A2)
    clx = table[at : at + length]
    while clx[:1] == b"\x01":
        clx = clx[3 + struct.unpack_from("<H", clx, 1)[0] :]
    if clx[:1] != b"\x02":
        raise ValueError("no table of pieces")
    n = (struct.unpack_from("<I", clx, 1)[0] - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", clx, 5)
    out = []
    for k in range(n):
        place, count = struct.unpack_from("<I", clx, 5 + 4 * (n + 1) + 8 * k + 2)[0], ends[k + 1] - ends[k]
        if place & 0x40000000:
            place = (place & 0x3FFFFFFF) // 2
            out.append(main[place : place + count].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * count].decode("utf-16-le", "replace"))
    text = re.sub("\x13[^\x14\x15]*\x14?|\x15", "", "".join(out))  # instructions of fields
    return text.translate({13: "\n", 11: "\n", 12: "\n", 7: "\t", 1: "", 2: "", 5: "", 8: ""}), 1


def _records(book: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(type, parts) of the records of a workbook; a record's continuations are its further parts."""
    at, held = 0, None
    while at + 4 <= len(book):
        kind, length = struct.unpack_from("<HH", book, at)
        body = book[at + 4 : at + 4 + length]
        at += 4 + length
        if kind == CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body]) if kind or length else None
        if held is None:
            return
    if held:
        yield held


def _shared(parts: list[bytes]) -> list[str]:
    """Shared strings; a string may go on in the next part, which begins with its width anew."""
    total, at, part, out = struct.unpack_from("<I", parts[0], 4)[0], 8, 0, []
    while len(out) < total and part < len(parts):
        if at >= len(parts[part]):
            part, at = part + 1, 0
            continue
        count, flags = struct.unpack_from("<HB", parts[part], at)
        at += 3
        runs = extra = 0
        if flags & 8:
            runs, at = struct.unpack_from("<H", parts[part], at)[0], at + 2
        if flags & 4:
            extra, at = struct.unpack_from("<I", parts[part], at)[0], at + 4
        text, wide = "", flags & 1
        while count and part < len(parts):
            room = min(count, (len(parts[part]) - at) // (1 + wide))
            raw = parts[part][at : at + room * (1 + wide)]
            text += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            at, count = at + len(raw), count - room
            if count:
                part, at = part + 1, 1
                wide = parts[part][0] & 1 if part < len(parts) and parts[part] else 0
        out.append(text)
        rest = 4 * runs + extra
        while part < len(parts) and rest > len(parts[part]) - at:
            rest, part, at = rest - (len(parts[part]) - at), part + 1, 0
        at += rest
    return out


def _rk(raw: int) -> float:
    value = float(struct.unpack("<i", struct.pack("<I", raw))[0] >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def read_xls(data: bytes) -> tuple[str, int]:
    """Cells of all sheets, a line for each row."""
    parts = streams(data)
    book = parts.get("Workbook") or parts["Book"]
    strings: list[str] = []
    rows: dict[tuple[int, int], dict[int, str]] = {}
    sheet = sheets = 0
    shown = lambda x: f"{x:.15g}"
    for kind, bodies in _records(book):
        b = bodies[0]
        if kind == BOF:
            sheet += 1
        elif kind == SHEET:
            sheets += 1
        elif kind == SST:
            strings = _shared(bodies)
        elif kind in (LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA) and len(b) >= 10:
            row, column = struct.unpack_from("<HH", b)
            line = rows.setdefault((sheet, row), {})
            if kind == LABELSST:
                n = struct.unpack_from("<I", b, 6)[0]
                line[column] = strings[n] if n < len(strings) else ""
            elif kind == LABEL:
                n, wide = struct.unpack_from("<HB", b, 6)
                line[column] = b[9 : 9 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
            elif kind == NUMBER or (kind == FORMULA and len(b) >= 14 and b[12:14] != b"\xff\xff"):
                line[column] = shown(struct.unpack_from("<d", b, 6)[0]) if len(b) >= 14 else ""
            elif kind == RK:
                line[column] = shown(_rk(struct.unpack_from("<I", b, 6)[0]))
            elif kind == MULRK:
                for k in range((len(b) - 6) // 6):
                    line[column + k] = shown(_rk(struct.unpack_from("<I", b, 6 + 6 * k)[0]))
    return "\n".join("\t".join(rows[r][c] for c in sorted(rows[r])) for r in sorted(rows)), max(sheets, 1)


def read_ppt(data: bytes) -> tuple[str, int]:
    """Texts of all slides in the order of the file."""
    stream = streams(data)["PowerPoint Document"]
    out, slides, todo = [], 0, [(0, len(stream))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            version, kind, length = struct.unpack_from("<HHI", stream, at)
            begin, stop = at + 8, min(at + 8 + length, end)
            slides += kind == SLIDE
            if version & 15 == 15:
                todo.append((stop, end))
                at, end = begin, stop
                continue
            if kind == TEXT_WIDE:
                out.append(stream[begin:stop].decode("utf-16-le", "replace"))
            elif kind == TEXT_BYTES:
                out.append(stream[begin:stop].decode("latin-1"))
            at = stop if kind or length else end
    return "\n".join(x.replace("\r", "\n").replace("\x0b", "\n") for x in out), max(slides, 1)
