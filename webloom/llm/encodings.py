"""Garbled text from wrong character encodings (problem 2).

Adjacent character pairs are counted over a whole reference collection; a pair's mutual information says how improbable it
is. Maximum-scoring segments of improbable pairs are isolated, and only inside them are the mappings tested that may have
garbled the text: bytes of UTF-8 read in a one-byte code page (once or twice), and legacy Vietnamese code pages read as
Western ones. A mapping is accepted if it makes its segment probable.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.frames import safe
from webloom.plans.session import spread

# Vietnamese letters in the order of the alphabet, and the characters that TCVN3 puts at their codes.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđĂÂÊÔƠƯĐ"
TCVN3 = "µ¸¶·¹¨»¾¼½Æ©ÇÊÈÉËÌÐÎÏÑªÒÕÓÔÖ×ÝØÜÞßãáâä«åèæçé¬êíëìîïóñòô­õøö÷ùúýûüþ®¡¢£¤¥¦§"
# The characters that VNI puts after a vowel, and the marks they stand for; and its letters of their own.
VNI_MARKS = dict(zip("ùøûõïâáàåãäêéèúüë", ["́", "̀", "̉", "̃", "̣", "̂", "̂́", "̂̀", "̂̉", "̂̃", "̣̂", "̆", "̆́", "̆̀", "̆̉", "̆̃", "̣̆"]))
VNI_LETTERS = dict(zip("ñôöíìæóòîÑÔÖÍÌÆÓÒÎ", "đơưíìỉĩịỵĐƠƯÍÌỈĨỊỴ"))
#: One-byte code pages in which bytes of UTF-8 may have been read.
PAGES = ("cp1252", "latin-1", "cp1258", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")

#: Classes of characters: these ranges one by one, everything else together.
RANGES = ((0x0000, 0x0250), (0x0300, 0x0370), (0x0370, 0x0460), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x20A0, 0x20D0), (0x2100, 0x2150), (0x2190, 0x2200), (0x2300, 0x2320), (0x2500, 0x25A0))
OTHER = sum(b - a for a, b in RANGES)
CLASSES = OTHER + 1
LOST = 0xFFFD
#: A pair counts as improbable from this mutual information downwards; scores are cut at CUT; a pair of two ASCII characters, or with
#: one, keeps a segment together at a small cost.
IMPROBABLE, CUT, GAP = -1.0, 6.0, -0.4
#: Score from which a segment is looked into, and the share of it that a mapping may leave.
SEGMENT, REST = 3.0, 0.4
#: The same for bytes that are valid UTF-8: chance hardly makes such sequences, so the letters that come out may be rare ones.
VALID, VALID_REST = 2.0, 0.8
#: A question mark before a small letter of its own word, or at a word's beginning, stands for a character that an encoding couldn't hold; not in URLs.
REPLACED = re.compile(r"[^\W\d_]\?+[^\W\d_A-ZÀ-Þ]|^\?+[^\W\d_]")
URL_LIKE = re.compile(r"[/=]")
#: Ends of a run's words. A non-breaking space is none: it may be a byte of a garbled letter.
EDGE = re.compile(r"[ \t\r\n\f\v<>&;\"|]")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.int32)
    at = 0
    for a, b in RANGES:
        table[a:b] = np.arange(at, at + b - a)
        at += b - a
    return table


def classes(text: str) -> np.ndarray:
    return class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


MARKED = re.compile("\\w[\u0300-\u036f]+")


def _ordered(m: re.Match) -> str:
    parts = unicodedata.normalize("NFD", m[0])
    return unicodedata.normalize("NFC", parts[0] + "".join(sorted(parts[1:], key=lambda c: c not in "\u031b\u0302\u0306")))


def compose(text: str) -> str:
    """Composed form, with marks that change a letter before marks of tone."""
    text = unicodedata.normalize("NFC", text)
    return MARKED.sub(_ordered, text) if MARKED.search(text) else text


def count_pairs(df: DataFrame, texts: list[str]) -> DataFrame:
    """pair, n: how often each pair of character classes occurs in a collection; at most CLASSES squared rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = np.zeros(CLASSES * CLASSES, np.int64), [], 0
        for b in batches:
            for t in b["t"]:
                c = classes(t)
                if len(c) > 1:
                    pairs = c[:-1].astype(np.int64) * CLASSES + c[1:]
                    held.append(pairs)
                    size += len(pairs)
                    if size > 2_000_000:
                        total += np.bincount(np.concatenate(held), minlength=len(total))
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at, "n": total[at]})

    rows = spread(df.select(*texts)).select(F.explode(F.array(*texts)).alias("t")).where(F.length("t") > 1)
    return rows.mapInPandas(safe(run), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def improbability(counted: pd.DataFrame) -> np.ndarray:
    """Score of every pair of classes: positive where the pair is improbable, negative where it is usual."""
    n = np.zeros((CLASSES, CLASSES), np.float64)
    n.ravel()[counted["pair"].to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
    first, second, total = n.sum(1), n.sum(0), max(n.sum(), 1.0)
    pmi = np.log((n + 0.02) * total / ((first[:, None] + 1) * (second[None, :] + 1)))
    rare = (first < 5)[:, None] | (second < 5)[None, :]
    pmi[rare] = -4.0
    score = np.clip(IMPROBABLE - pmi, -CUT, CUT)
    ascii_ = np.arange(CLASSES) < 128
    mark, small = ord("?"), np.concatenate([np.arange(ord("a"), ord("z") + 1), np.arange(ord("A"), ord("Z") + 1)])
    marked = np.maximum(score[mark, small], 0)
    score[np.ix_(ascii_, ascii_)] = GAP
    score[mark, small] = marked
    score[(n > 0.0002 * np.minimum(first[:, None], second[None, :])) & (score > 0)] = GAP
    lost = class_table()[LOST]
    score[lost, :] = np.maximum(score[lost, :], 0)
    return score.astype(np.float32)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence, in linear time (Ruzzo and Tompa)."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[list] = []  # begin, end, sum before, sum after
    for i in at.tolist():
        b, e, left, right = i, i + 1, sums[i], sums[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append([b, e, left, right])
                break
            b, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, float(right - left)) for b, e, left, right in stack]


def mass(text: str, score: np.ndarray) -> float:
    """Sum of the improbable pairs of a text."""
    if len(text) < 2:
        return 0.0
    x = pair_scores(text, score)
    return float(x[x > 0].sum())


@lru_cache(maxsize=16)
def bytes_of(page: str) -> dict[str, int]:
    """Character -> byte of a code page; bytes that it leaves undefined stay control characters."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    return out


@lru_cache(maxsize=16)
def _sequences(page: str) -> re.Pattern:
    """Valid sequences of UTF-8, in the characters of a code page."""
    chars = {b: c for c, b in bytes_of(page).items()}
    among = lambda low, high: "[" + "".join(re.escape(chars[b]) for b in range(low, high + 1) if b in chars) + "]"
    tail = among(0x80, 0xBF)
    # The well-formed sequences of the encoding, by first byte, second byte and number of bytes.
    forms = [(0xC2, 0xDF, 0x80, 0xBF, 2), (0xE0, 0xE0, 0xA0, 0xBF, 3), (0xE1, 0xEC, 0x80, 0xBF, 3), (0xED, 0xED, 0x80, 0x9F, 3), (0xEE, 0xEF, 0x80, 0xBF, 3), (0xF0, 0xF0, 0x90, 0xBF, 4), (0xF1, 0xF3, 0x80, 0xBF, 4), (0xF4, 0xF4, 0x80, 0x8F, 4)]
    return re.compile("|".join(f"{among(a, b)}{among(c, d)}{tail}{{{n - 2}}}" for a, b, c, d, n in forms))


def _utf8(text: str, page: str) -> str:
    """Text whose sequences of the code page's characters are read as UTF-8 wherever they are valid."""
    table = bytes_of(page)
    return _sequences(page).sub(lambda m: bytes(map(table.__getitem__, m[0])).decode(), text)


_TCVN3 = str.maketrans(TCVN3, VIETNAMESE)
_CP1258 = {ord(c): bytes([b]).decode("cp1258", "replace") for c, b in bytes_of("cp1252").items() if bytes([b]).decode("cp1258", "replace") != "\ufffd"}
_VNI = re.compile("([aeouyôöAEOUYÔÖ])([" + "".join(VNI_MARKS) + "".join(VNI_MARKS).upper() + "])")


def _vni(text: str) -> str:
    def letter(m: re.Match) -> str:
        return unicodedata.normalize("NFC", VNI_LETTERS.get(m[1], m[1]) + VNI_MARKS[m[2].lower()])

    marked = _VNI.sub(lambda m: "" + letter(m) + "", text)
    parts = re.split("|", marked)
    return "".join(p if i % 2 else "".join(VNI_LETTERS.get(c, c) for c in p) for i, p in enumerate(parts))


LEGACY = {
    "tcvn3": lambda t: t.translate(_TCVN3),
    "tcvn3_as_cp1252": lambda t: "".join(chr(bytes_of("cp1252").get(c, ord(c))) for c in t).translate(_TCVN3),
    "vni": _vni,
    "cp1258_as_cp1252": lambda t: compose(t.translate(_CP1258)),
    "cp1252_as_latin1": lambda t: re.sub("[\x80-\x9f]+", lambda m: m[0].encode("latin-1").decode("cp1252", "replace"), t),
}


def inverse(text: str, score: np.ndarray) -> tuple[str, str] | None:
    """(restored text, name of the mapping) of a garbled run; None if no mapping makes it probable."""
    before = mass(f" {text} ", score)
    best: tuple[float, str, str] | None = None
    valid: tuple[float, str, str] | None = None
    for page in PAGES:
        once = _utf8(text, page)
        if once == text:
            continue
        twice = _utf8(once, page)
        for name, made in ((f"utf-8 as {page}", once), (f"utf-8 as {page}, twice", twice)):
            if made != (text if name.endswith("twice") else ""):
                after = mass(f" {compose(made)} ", score)
                if best is None or after < best[0]:
                    best = (after, made, name)
                    valid = best if (classes(made) != OTHER).all() and made.isprintable() else valid
    for name, f in LEGACY.items():
        made = f(text)
        if made != text:
            after = mass(f" {made} ", score)
            if best is None or after < best[0] - 0.5:
                best = (after, made, name)
    if best and best[0] <= REST * before and before - best[0] >= SEGMENT:
        return compose(best[1]), best[2]
    if valid and valid[0] <= VALID_REST * before and before - valid[0] >= VALID:
        return compose(valid[1]), valid[2]
    return None


def pair_scores(text: str, score: np.ndarray) -> np.ndarray:
    """Score of every pair of neighbours in a text."""
    c = classes(text)
    return score.ravel().take(c[:-1] * np.int32(CLASSES) + c[1:])


def segments(line: str, scores: np.ndarray, least: float = SEGMENT) -> list[tuple[int, int]]:
    """Places (from, to) of a line's improbable runs, widened to whole words; scores are those of its pairs between line feeds."""
    found: list[list[int]] = []
    for b, e, total in maximal_segments(scores):
        if total < least:
            continue
        b, e = max(0, b - 1), min(len(line), e)  # pair i is characters i - 1 and i of the line
        while b > 0 and not EDGE.match(line[b - 1]):
            b -= 1
        while e < len(line) and not EDGE.match(line[e]):
            e += 1
        if found and b <= found[-1][1]:
            found[-1][1] = max(e, found[-1][1])
        else:
            found.append([b, e])
    return [(b, e) for b, e in found]


def improbable_lines(text: str, score: np.ndarray) -> Iterator[tuple[int, str, np.ndarray]]:
    """(number, line, scores of its pairs) of the lines that can hold a segment worth looking into, or a replacement character."""
    scores = pair_scores(f"\n{text}\n", score)
    lines = text.split("\n")
    starts = np.cumsum([0, *(len(x) + 1 for x in lines)])
    total = np.add.reduceat(np.maximum(scores, 0), starts[:-1])
    for k in np.flatnonzero(total >= SEGMENT) if "\ufffd" not in text else range(len(lines)):
        line = lines[k]
        if (total[k] >= SEGMENT or "\ufffd" in line) and (not line.isascii() or "?" in line):
            yield int(k), line, scores[starts[k] : starts[k + 1]]


def replaced(run: str) -> bool:
    """Whether an improbable run holds question marks in place of letters."""
    return "?" in run and any(REPLACED.search(w) and not URL_LIKE.search(w) for w in run.split())


def is_garbled(text: str | None, score: np.ndarray) -> bool:
    """Whether repair would find anything wrong."""
    if not text or (text.isascii() and "?" not in text):
        return False
    if "\ufffd" in text:
        return True
    return any(replaced(line[b:e]) or inverse(line[b:e], score) for _, line, x in improbable_lines(compose(text), score) for b, e in segments(line, x))


def mapping(name: str) -> Callable[[str], str]:
    """The mapping of a name that inverse gave."""
    if name in LEGACY:
        return LEGACY[name]
    page = name.removeprefix("utf-8 as ").removesuffix(", twice")
    return (lambda t: _utf8(_utf8(t, page), page)) if name.endswith("twice") else (lambda t: _utf8(t, page))


def spliced(line: str, span: tuple[int, int], made: dict[tuple[int, int], str]) -> str:
    """The part of a line in a span, with new texts for the runs in it."""
    pieces, last = [], span[0]
    for (b, e), new in sorted(made.items()):
        pieces += [line[last:b], new]
        last = e
    return "".join(pieces) + line[last : span[1]]


def repair(text: str | None, score: np.ndarray) -> tuple[str | None, list[str]]:
    """(text with its garbled runs restored, what was wrong with it); an empty list for text that is as written.

    A mapping changes improbable runs, and what stands between two runs of one mapping; where one-byte readings of UTF-8 are proven in a
    line, its other valid sequences too. Runs too short to prove one by themselves take the
    mapping that another run of their line proved, if it makes them more probable. Replacement characters, and question marks inside words, are named
    'lost': what stood there can't be restored.
    """
    if not text or (text.isascii() and "?" not in text):
        return text, []
    text, wrong = compose(text), []
    lines = text.split("\n")
    for k, line, x in improbable_lines(text, score):
        if "\ufffd" in line:
            wrong.append("lost")
        made: dict[tuple[int, int], str] = {}
        proven: dict[str, list[tuple[int, int]]] = {}
        for run in segments(line, x):
            found = inverse(line[slice(*run)], score)
            if found:
                made[run] = found[0]
                proven.setdefault(found[1], []).append(run)
            elif replaced(line[slice(*run)]):
                wrong.append("lost")
        for name in proven:
            for run in segments(line, x, 0.0):
                if not any(run[0] < e and b < run[1] for b, e in made):
                    before = line[slice(*run)]
                    after = compose(mapping(name)(before))
                    if after != before and mass(f" {after} ", score) < mass(f" {before} ", score):
                        made[run] = after
                        proven[name].append(run)
        for name, runs in proven.items():  # what stands between two runs of one mapping went through it as well
            hull = min(b for b, _ in runs), max(e for _, e in runs)
            inner = {run: new for run, new in made.items() if hull[0] <= run[0] and run[1] <= hull[1]}
            if len(runs) > 1 and len(inner) == len(runs):
                whole = compose(mapping(name)(line[slice(*hull)]))
                if mass(whole, score) <= mass(spliced(line, hull, inner), score):
                    made = {run: new for run, new in made.items() if run not in inner} | {hull: whole}
        if proven:
            fixed = spliced(line, (0, len(line)), made)
            for name in proven:
                if name not in LEGACY:  # further valid sequences of a proven mapping: chance hardly makes them
                    more = compose(mapping(name)(fixed))
                    fixed = more if mass(more, score) <= mass(fixed, score) else fixed
            lines[k] = fixed
            wrong += proven
    return "\n".join(lines), list(dict.fromkeys(wrong))


def decode_page(html_b64: str | None, encoding: str | None) -> str | None:
    """A page's text by its declared encoding, UTF-8 if that is null or unknown; bytes it can't read become U+FFFD. None without a body."""
    if html_b64 is None:
        return None
    try:
        raw = base64.b64decode("".join(html_b64.split()) if "\n" in html_b64 else html_b64, validate=True)
    except (binascii.Error, ValueError):
        return None
    try:
        codec = codecs.lookup((encoding or "utf-8").strip() or "utf-8").name
        if codec in ("base64", "bz2", "hex", "quopri", "rot13", "uu", "zlib", "idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape"):
            codec = "utf-8"
    except (LookupError, ValueError):
        codec = "utf-8"
    return raw.decode(codec, "replace")


def model(df: DataFrame, texts: list[str]) -> np.ndarray:
    """Scores of character pairs from a whole reference collection; their size doesn't depend on it."""
    return improbability(count_pairs(df, texts).toPandas())


def garbled_texts(df: DataFrame, key: str, text: str, score: np.ndarray) -> DataFrame:
    """key, restored, causes of every row whose text isn't what was written; null and empty texts aren't cases."""
    kind = dict(df.dtypes)[key]
    held = df.sparkSession.sparkContext.broadcast(score)  # CLASSES squared numbers, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *repair(t, held.value)) for k, t in zip(b["k"], b["t"])]
            yield pd.DataFrame([x for x in out if x[2]], columns=[key, "restored", "causes"])

    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).where(F.col("t").rlike("[^\\x00-\\x7f]|\\?[A-Za-z]"))
    return rows.mapInPandas(safe(run), f"{key} {kind}, restored string, causes array<string>")


def garbled_pages(df: DataFrame, key: str, score: np.ndarray) -> DataFrame:
    """key, restored, causes of every page with a body that its declared encoding doesn't read as it was written.

    Pages without a body (null, or no base64) aren't cases.
    """
    kind = dict(df.dtypes)[key]
    held = df.sparkSession.sparkContext.broadcast(score)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *repair(decode_page(h, e), held.value)) for k, h, e in zip(b["k"], b["html_b64"], b["encoding"])]
            yield pd.DataFrame([x for x in out if x[2]], columns=[key, "restored", "causes"])

    rows = spread(df.select(F.col(key).alias("k"), "html_b64", "encoding")).where(F.length("html_b64") > 0)
    return rows.mapInPandas(safe(run), f"{key} {kind}, restored string, causes array<string>")
