"""All readings of a written moment, without Spark: the value, its site's clock and its site's locale go in, candidates come out."""

from __future__ import annotations

import calendar
import re
import unicodedata
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Abbreviations of zones and their offsets in minutes, each with one meaning in common use.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ict": 420, "wib": 420, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
    "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

# Names of months, English, French and their usual short forms.
MONTHS = {
    name: i + 1
    for i, names in enumerate(
        "january jan janvier janv|february feb février fevrier févr fév|march mar mars|april apr avril avr|may mai|june jun juin|july jul juillet juil"
        "|august aug août aout|september sep sept septembre|october oct octobre|november nov novembre|december dec décembre decembre déc".split("|")
    )
    for name in names.split()
}

# Languages and regions whose dates put the month first, or the year.
MONTH_FIRST = {"en-US", "en-PH", "en-BZ"}
YEAR_FIRST = {"ja", "zh", "ko", "hu", "lt", "mn"}

WEEKDAY = (
    r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche"
    r"|thứ (?:hai|ba|tư|năm|sáu|bảy|[2-7])|chủ nhật)\.?,?\s*"
)
CLOCK = (
    r"(?P<h>\d{1,2})\s?(?::|h|giờ|時)\s?(?P<mi>\d{2})(?:\s?(?:phút|分))?(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?|(?P<s2>\d{2})秒)?"
    r"(?:\s?(?P<ap>[ap]\.?\s?m\.?|sa|ch)(?![a-z]))?"
)
ZONE = r"\s?\(?(?P<z>(?:gmt|utc)?\s?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})\)?"
BETWEEN = r"(?:t|\s*[,–-]?\s*(?:at|à|lúc|vào)?\s+|\s*,\s*|\s*-\s*)"
NAME = "|".join(sorted(MONTHS, key=len, reverse=True))
DATES = {
    "ymd": r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})",
    "cjk": r"(?P<y>\d{4})\s?年\s?(?P<m>\d{1,2})\s?月\s?(?P<d>\d{1,2})\s?日",
    "num": r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4}|\d{2})",
    "vi": r"(?:ngày\s)?(?P<d>\d{1,2})\stháng\s(?P<m>\d{1,2}),?\snăm\s(?P<y>\d{4})",
    "dmon": rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th|er)?[\s-](?P<mon>{NAME})\.?,?[\s-](?P<y>\d{{4}})",
    "mond": rf"(?P<mon>{NAME})\.?\s(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s(?P<y>\d{{4}})",
}
PATTERNS = [
    (kind, re.compile(form))
    for kind, date in DATES.items()
    for form in (rf"(?:{WEEKDAY})?{date}(?:{BETWEEN}?{CLOCK}(?:{ZONE})?)?", rf"{CLOCK}{BETWEEN}?{date}")
]
COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:t?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:[.,](?P<f>\d+))?(?:{ZONE})?)?")
EPOCH = {10: 1_000_000, 13: 1_000, 16: 1, 19: 0}
US = timedelta(microseconds=1)
ZERO = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Years that a publication can carry.
FIRST_YEAR, LAST_YEAR = 1900, 2199
#: Cost of reading a date against the field order of its site.
AGAINST_LOCALE = 1e6


def offset_minutes(text: str) -> int | None:
    text = text.replace(" ", "")
    if text in ZONES:
        return ZONES[text]
    if m := re.fullmatch(r"(?:gmt|utc)?([+-])(\d{1,2})(?::?(\d{2}))?", text):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return None if minutes > 14 * 60 or int(m[3] or 0) > 59 else (minutes if m[1] == "+" else -minutes)
    return None


def orders(locale: str | None) -> list[str]:
    """Field orders of a date with separators, the one of the site's locale first."""
    if locale in MONTH_FIRST:
        return ["mdy", "dmy"]
    return ["dmy", "mdy"] if not locale or locale.split("-")[0] not in YEAR_FIRST else ["ymd2", "dmy", "mdy"]


def utc_us(y: int, mo: int, d: int, h: int, mi: int, s: int, us: int, offset: int | None, zone: ZoneInfo | None) -> int | None:
    """Microseconds since 1970 UTC; None if the fields name no moment or the zone isn't known.

    A local time shown twice means its first showing, a skipped one has the offset before the skip (PEP 495, fold 0).
    """
    if not FIRST_YEAR <= y <= LAST_YEAR or not 1 <= mo <= 12 or not 1 <= d <= calendar.monthrange(y, mo)[1] or mi > 59 or s > 59:
        return None
    if h > 23 and (h, mi, s, us) != (24, 0, 0, 0):
        return None
    if offset is None and zone is None:
        return None
    local = datetime(y, mo, d, h % 24, mi, s, us) + timedelta(days=h // 24)
    local = local.replace(tzinfo=zone if offset is None else timezone(timedelta(minutes=offset)))
    return (local.astimezone(timezone.utc) - ZERO) // US


@lru_cache(maxsize=256)
def clock(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=100_000)
def interpretations(value: str | None, tz: str | None, locale: str | None) -> tuple[tuple[str, int, float], ...]:
    """Every valid reading as (format, microseconds since 1970 UTC, cost); empty if there is none.

    A field order against the site's locale costs AGAINST_LOCALE, more than any path can save by it; it doesn't stand in
    for an order of the locale that names no moment. Where no locale is known, all orders cost nothing.
    null, blank, senseless and impossible values give an empty tuple.
    """
    if value is None:
        return ()
    text = " ".join(unicodedata.normalize("NFKC", value).lower().split())
    if text.isascii() and text.isdigit() and len(text) in EPOCH:
        scale = EPOCH[len(text)]
        us = int(text) * scale if scale else int(text) // 1000
        return (("epoch", us, 0.0),) if us < 7_258_118_400_000_000 else ()
    zone, found = clock(tz), []
    candidates = [("compact", m)] if (m := COMPACT.fullmatch(text)) else [(k, m) for k, p in PATTERNS if (m := p.fullmatch(text))]
    for kind, m in candidates:
        g = m.groupdict()
        offset = None
        if g.get("z"):
            offset = offset_minutes(g["z"])
            if offset is None:
                continue
        h, mi, s = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or g.get("s2") or 0)
        if ap := (g.get("ap") or "")[:1]:
            if not 1 <= h <= 12:
                continue
            h = h % 12 + (12 if ap in "pc" else 0)
        us = int(((g.get("f") or "") + "000000")[:6])
        if kind == "num":
            y = int(g["y"]) if len(g["y"]) == 4 else 2000 + int(g["y"])
            a, b = int(g["a"]), int(g["b"])
            days = []
            for order in orders(locale):
                if order == "ymd2":
                    if len(g["y"]) == 2:
                        days.append((order, 2000 + a, b, int(g["y"])))
                else:
                    days.append((order, y, *((b, a) if order == "dmy" else (a, b))))
        else:
            days = [(kind, int(g["y"]), MONTHS[g["mon"]] if g.get("mon") else int(g["m"]), int(g["d"]))]
        form = ("" if g.get("h") is None else ":" if g.get("s") is None else "::") + ("" if not g.get("z") else "z")
        for k, (order, y, mo, d) in enumerate(days):
            at = utc_us(y, mo, d, h, mi, s, us, offset, zone)
            if at is None and k == 0 and locale:
                break
            if at is not None and at not in {u for _, u, _ in found}:
                found.append((order + form, at, AGAINST_LOCALE if k and locale else 0.0))
    return tuple(found)
