"""Visually identical text with different characters, brought to one consistent form (problem 1).

A text that holds only plain characters is its own form and never leaves the JVM. For the others: invisible characters
go, unusual spaces and compatibility forms become the usual ones, each token's characters are intersected by script (a
character may belong to several), tokens left without a common script and tokens wholly made of look-alikes take the
spelling of one script, and accents are put in the canonical order and composed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.frames import safe
from webloom.plans.session import spread

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏѵкёїАВЕКМНОРСТУХІЈЅҺԚԜЁЇ", "aeopcyxijshdqwlvkëïABEKMHOPCTYXIJSHQWËÏ"))
GREEK = dict(zip("οανιρυκγχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavipukyxABEZHIKMNOPTYX"))
ARMENIAN = dict(zip("ցհյոօսզաքՕՍՏԼ", "ghjnouqwfOUSL"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiAJEWMHYGZbRWSVSLCPKdB"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
COPTIC = dict(zip("ⲟⲞⲣⲢⲥⲤⲎⲒⲔⲘⲚⲦⲨⲬ", "oOpPcCHIKMNTYX"))
TO_LATIN = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE, **LISU, **COPTIC}
FROM_LATIN = {name: {v: k for k, v in table.items()} for name, table in (("Cyrillic", CYRILLIC), ("Greek", GREEK), ("Armenian", ARMENIAN), ("Cherokee", CHEROKEE), ("Coptic", COPTIC), ("Lisu", LISU))}
# Latin letters that stand for the Vietnamese letter D with stroke, and Latin look-alikes of usual letters.
STROKED_D = {"Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ"}
LATIN_FORMS = {"ɑ": "a", "ɡ": "g", "ı": "i", "ſ": "s"}

SPACES = re.compile("[   -     　\x0b\x0c\x85]")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f]")
#: Invisible characters without a use next to others, gone before the neighbours of the rest are looked at.
NEVER_USED = re.compile("[\u00ad\u034f\u115f\u1160\u17b4\u17b5\u180e\u200b\u2060-\u2065\u206a-\u206f\u3164\ufeff\uffa0\ufff9-\ufffb\x00-\x08\x0e-\x1f\x7f]")
COMPAT = re.compile("[！-～￠-￮ﬀ-ﬆ\U0001d400-\U0001d7ffⒶ-ⓩ℀℁ℊ-ℕℙ-ℝℤℨ-ℸKÅⅠ-ⅿĲĳǇ-ǌǱ-ǳ]")
MARKS = re.compile("[^\\W\\d_][̀-ͯ]+")
TOKEN = re.compile("(?:[^\\W_]|[̀-ͯ])+")
#: Letters of scripts with look-alikes of Latin ones: Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu.
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ԰-֏Ꭰ-\u13ffⲀ-⳿ꓐ-꓿]")
VIETNAMESE = re.compile("[Ạ-ỹăđơưĂĐƠƯ]")
#: Marks of quality (they change the letter) come before marks of tone.
QUALITY = "̛̂̆"

#: Texts of these characters alone are in the consistent form: nothing among them reads as nothing or as another.
PLAIN = (
    "\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u00cf\\u00d1-\\u00ef\\u00f1-\\u0130\\u0134-\\u017e\\u01a0\\u01a1\\u01af\\u01b0\\u1ea0-\\u1ef9"
    "\\u2010-\\u2027\\u2030-\\u205e\\u2070-\\u20bf\\u2190-\\u2328\\u232b-\\u23ff\\u2500-\\u27bf"
)
SUSPECT = f"[^{PLAIN}]"
_SUSPECT = re.compile(SUSPECT)


@lru_cache(maxsize=4096)
def scripts(ch: str) -> frozenset[str]:
    """Scripts a character may belong to; empty for what any script uses (digits, marks)."""
    if not ch.isalpha():
        return frozenset()
    word = unicodedata.name(ch, "").split(" ")[0].split("-")[0]
    if word in ("LATIN", "CYRILLIC", "GREEK"):
        return frozenset([word.title()])
    if word in ("CJK", "HIRAGANA", "KATAKANA"):
        return frozenset(["Japanese", "Chinese"] if word == "CJK" else ["Japanese"])
    return frozenset([word.title()])


def resolved(token: str) -> frozenset[str] | None:
    """The scripts all characters of a token share; None if any will do, empty if it is mixed."""
    common: frozenset[str] | None = None
    for ch in token:
        own = scripts(ch)
        if own:
            common = own if common is None else common & own
    return common


def _joins(text: str, at: int) -> bool:
    """Whether the invisible character at a place has a use there: in an emoji sequence, or in a script that needs it."""
    ch = text[at]
    before = text[at - 1] if at else ""
    after = text[at + 1] if at + 1 < len(text) else ""
    pictured = lambda c: bool(c) and (unicodedata.category(c) in ("So", "Sk") or ord(c) >= 0x1F000 or c == "️")
    if ch == "‍" and pictured(before) and pictured(after):
        return True
    if "︀" <= ch <= "️":
        return pictured(before) or (before.isdigit() and after == "⃣")
    if ch in "‌‍":
        return before.isalpha() and after.isalpha() and not scripts(before) & {"Latin", "Cyrillic", "Greek"}
    if ch in "‎‏؜" or "‪" <= ch <= "‮" or "⁦" <= ch <= "⁩":
        return unicodedata.bidirectional(before or " ") in ("R", "AL") or unicodedata.bidirectional(after or " ") in ("R", "AL")
    return "\U000e0020" <= ch <= "\U000e007f" and (pictured(before) or "\U000e0020" <= before <= "\U000e007f")


def _consistent(token: str, own_script_near: bool) -> str:
    """A token in the spelling of one script."""
    common = resolved(token)
    letters = [c for c in token if scripts(c)]
    foreign = [c for c in letters if not scripts(c) & {"Latin"}]
    if common is not None and not common:  # mixed
        latin = [c for c in letters if scripts(c) & {"Latin"}]
        if all(c in TO_LATIN for c in foreign):
            return "".join(TO_LATIN.get(c, c) for c in token)
        for script, back in FROM_LATIN.items():
            if len(foreign) > max(2, len(latin)) and all(scripts(c) & {script} for c in foreign) and all(c in back for c in latin):
                return "".join(back.get(c, c) for c in token)
        return token
    if not foreign or not all(c in TO_LATIN for c in foreign) or own_script_near:
        return token
    if len(letters) == 1 and scripts(letters[0]) & {"Greek"} and letters[0].islower() and letters[0] != "ο":
        return token  # a symbol of science
    return "".join(TO_LATIN.get(c, c) for c in token)


def _compose(found: re.Match) -> str:
    """One letter with its marks, those of quality first, composed where a composed form exists."""
    parts = unicodedata.normalize("NFD", found[0])
    base, marks = parts[0], parts[1:]
    marks = "".join(dict.fromkeys(marks))
    return unicodedata.normalize("NFC", base + "".join(sorted(marks, key=lambda m: m not in QUALITY)))


def _by_script(text: str) -> str:
    """A text with every token of another script in the spelling that its scripts and its neighbours call for."""
    tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    genuine = [bool((r := resolved(t)) and not r & {"Latin"} and any(scripts(c) and c not in TO_LATIN for c in t) and len(t) > 1) for _, _, t in tokens]
    native = sum(1 for c in text if "Latin" in scripts(c)) < sum(1 for c in text if FOREIGN.match(c))
    parts, last = [], 0
    for i, (a, b, t) in enumerate(tokens):
        if FOREIGN.search(t):
            near = native or any(genuine[j] for j in range(max(0, i - 2), min(len(tokens), i + 3)) if j != i)
            parts += [text[last:a], _consistent(t, near)]
            last = b
    return "".join(parts) + text[last:]


def normalize(text: str | None) -> str | None:
    """The consistent form of a text: null stays null, '' stays ''. It is its own consistent form."""
    if not text or not _SUSPECT.search(text):
        return text
    if INVISIBLE.search(text):
        text = NEVER_USED.sub("", text)
        text = INVISIBLE.sub(lambda m: m[0] if _joins(m.string, m.start()) else "", text)
    text = SPACES.sub(" ", text)
    text = COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    while FOREIGN.search(text):  # a token that changed may be the context of another; each round leaves fewer foreign tokens or none changes
        before = text
        text = _by_script(text)
        if text == before:
            break
    text = unicodedata.normalize("NFC", MARKS.sub(_compose, unicodedata.normalize("NFC", text)))
    for form, usual in LATIN_FORMS.items():
        if form in text:
            text = text.replace(form, usual)
    if VIETNAMESE.search(text):
        for form, usual in STROKED_D.items():
            text = text.replace(form, usual)
    return text


def suspect(text: Column) -> Column:
    """True where a text holds a character outside the plain ones; null or empty texts don't."""
    return F.coalesce(text.rlike(SUSPECT), F.lit(False))


def normalize_columns(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, text, changed: each field's text in its consistent form, one row per row and field.

    Null texts give a null text and changed = false; empty texts stay empty. Texts are whole, of any length. Repeated rows
    and ties are kept as they come; an empty table gives an empty result; other columns don't matter.
    """
    both = spread(df.select(key, *fields)).select(F.col(key).alias("_key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x"))
    both = both.select("_key", "x.field", "x.text").withColumn("_odd", suspect(F.col("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = [normalize(t) for t in b["text"]]
            b["changed"] = [n != t for n, t in zip(new, b["text"])]
            b["text"] = new
            yield b[["_key", "field", "text", "changed"]]

    kind = dict(df.dtypes)[key]
    odd = both.where("_odd").select("_key", "field", "text").mapInPandas(safe(run), f"_key {kind}, field string, text string, changed boolean")
    plain = both.where(~F.col("_odd")).select("_key", "field", "text", F.lit(False).alias("changed"))
    return plain.unionByName(odd).withColumnRenamed("_key", key)


def find_lookalikes(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field of every text that holds a character which reads as nothing or as another, usual one."""
    return normalize_columns(df, key, fields).where("changed").select(key, "field")
