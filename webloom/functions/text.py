"""Text, hash and date functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)[\s\x1c-\x1f]+"
TOKEN = r"[\p{L}\p{M}\p{N}_]+"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Every character of one code unit whose canonical decomposition is one such base letter with marks, and that letter."""
    plain, bases = ["đ", "Đ"], ["d", "D"]
    for code in range(0xA0, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or (parts := unicodedata.normalize("NFD", ch)) == ch:
            continue
        base = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and ord(base[0]) < 0x10000:
            plain.append(ch)
            bases.append(base[0])
    return "".join(plain), "".join(bases)


def fold(text: Column) -> Column:
    """Without accents; đ becomes d. Characters that decompose into several letters stay."""
    return F.regexp_replace(F.translate(text, *_folding()), r"\p{Mn}", "")


@lru_cache(maxsize=1)
def folding_table() -> dict[int, int]:
    return str.maketrans(*_folding())


def without_marks(text: str) -> str:
    return "".join(c for c in text if unicodedata.category(c) != "Mn")


def fold_python(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")


def clean_space(text: Column) -> Column:
    """Runs of white space of any script as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def tail(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.substring(text, -n, n))


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != ""))


def tokens(text: Column) -> Column:
    """Words of letters, marks, digits and underscores in lower case, in order; [] for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})")), F.array().cast("array<string>"))


def sha1_key(*parts: Column) -> Column:
    """SHA-1 of the parts joined by |."""
    return F.sha1(F.concat_ws("|", *parts))


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of the SHA-1 of a block's text: white space cleaned, lower case, digits as one 0."""
    return F.substring(F.sha1(F.regexp_replace(F.lower(clean_space(text)), r"(?U)\d+", "0")), 1, 16)


def date_num(date: Column) -> Column:
    """yyyymmdd of a YYYY-MM-DD date; 0 if it is short, no number or out of range (31 February is let through)."""
    part = lambda a, n: F.try_to_number(F.when(F.substring(date, a, n).rlike(rf"^\d{{{n}}}$"), F.substring(date, a, n)), F.lit("9" * n)).cast("bigint")
    y, m, d = part(1, 4), part(6, 2), part(9, 2)
    ok = (F.length(date) >= 10) & y.between(1900, 2200) & m.between(1, 12) & d.between(1, 31)
    return F.coalesce(F.when(ok, y * 10000 + m * 100 + d), F.lit(0).cast("bigint"))


def _valid(y: Column, m: Column, d: Column) -> Column:
    made = F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    return F.when(F.try_to_date(made, "yyyy-MM-dd").isNotNull(), made).otherwise("")


def normalize_date(text: Column) -> Column:
    """YYYY-MM-DD of a text that begins so, else of its first day/month/year; '' if there is none or it isn't a real day."""
    iso, vn = r"^\s*(\d{4})-(\d{2})-(\d{2})", r"(?<!\d)(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})(?!\d)"
    g = lambda p, k: F.regexp_extract(text, p, k)
    return F.coalesce(F.when(text.rlike(iso), _valid(g(iso, 1), g(iso, 2), g(iso, 3))).when(text.rlike(vn), _valid(g(vn, 3), g(vn, 2), g(vn, 1))), F.lit(""))


def parse_date_vn(text: Column) -> Column:
    """YYYY-MM-DD of the first day/month/year, '' if there is none or it isn't a real day."""
    vn = r"(?<!\d)(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})(?!\d)"
    g = lambda k: F.regexp_extract(text, vn, k)
    return F.coalesce(F.when(text.rlike(vn), _valid(g(3), g(2), g(1))), F.lit(""))


def is_valid_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def date_or_empty(text: Column) -> Column:
    """The first ten characters if they are a real day, else ''."""
    first = F.substring(text, 1, 10)
    return F.when(is_valid_date(first), first).otherwise("")


def vn_datetime(text: Column) -> Column:
    """ISO date and time of dd/mm/yyyy [hh:mm], null if there is none."""
    p = r"(\d{1,2})/(\d{1,2})/(\d{4})(?:\D{1,3}(\d{1,2}):(\d{2}))?"
    g = lambda k: F.regexp_extract(text, p, k)
    day = _valid(g(3), g(2), g(1))
    hour = F.when(g(4) != "", F.concat(F.lit("T"), F.lpad(g(4), 2, "0"), F.lit(":"), g(5), F.lit(":00"))).otherwise("")
    return F.when(text.rlike(p) & (day != ""), F.concat(day, hour))


def suspect_encoding(text: Column) -> Column:
    """A weak sign of a wrong encoding: 200 characters or more, many of Latin-1's upper half, hardly any Vietnamese letter."""
    n = F.length(text)
    latin = n - F.length(F.regexp_replace(text, "[¡-ÿ]", ""))
    vietnamese = n - F.length(F.regexp_replace(text, "[ăđơưĂĐƠƯẠ-ỹ]", ""))
    return F.coalesce((n >= 200) & (latin > 0.04 * n) & (vietnamese < 0.005 * n), F.lit(False))


def page_type(url: Column) -> Column:
    """What the kind of page is worth: numbered listings least, articles most."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(u == "", 1.0).when(u.contains("/page-") | u.contains("/page/"), 0.5).when(u.endswith(".html") | u.endswith(".htm"), 1.0).when(u.endswith("/"), 0.7).otherwise(0.9)
    )


def length_factor(chars: Column) -> Column:
    return 0.75 + 0.25 * F.least(F.lit(1.0), chars / 1200.0)


def recency_factor(date: Column, year: int) -> Column:
    """Newer is worth a little more; unknown or senseless years are worth 1."""
    y = F.when(F.substring(date, 1, 4).rlike(r"^\d{4}$"), F.substring(date, 1, 4)).cast("int")
    return F.when(y.between(1990, year + 1), 0.92 + 0.16 * F.exp(-F.greatest(F.lit(0), F.lit(year) - y) / 3.0)).otherwise(1.0)


def base_score(url: Column, chars: Column, date: Column, year: int) -> Column:
    return page_type(url) * length_factor(chars) * recency_factor(date, year)
