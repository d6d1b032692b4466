"""Evaluation texts inside training text (problem 8).

Every text is canonicalised to a template: words in lower case without accents, where numbers, names and units are
replaced by typed placeholders. Windows of consecutive template words are hashed and joined; at each joint window the
words behind the placeholders are compared: equal everywhere means the passage itself, a one-to-one renaming means the
same question with other parameters. Windows of hardly anything but placeholders agree everywhere and tell nothing: they
count only word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from webloom.functions.frames import safe
from webloom.plans.session import materialize, spread

WINDOW = 15
#: Up to so many window hashes of the test items travel to the workers, which then send on only windows they hold.
PROBE_BOUND = 2_000_000
WORD = re.compile("(?:[^\\W_]|[̀-ͯ])+")
# Units of measure in English, French and Vietnamese, folded.
UNITS = frozenset(
    "s ms min h hour hours minute minutes second seconds day days week weeks month months year years m cm mm km kg g mg l ml pa kpa mpa bar v kv a ma w kw mw j kj hz khz mhz"
    " percent degree degrees digits samples heures jours semaines mois annees gio phut giay ngay tuan thang nam mau".split()
)
#: Words of its own that a window needs for its template to be compared; with fewer the words themselves are.
LEAST_WORDS = 3
NUMBER, UNIT, NAME = "\x01n", "\x01u", "\x01a"


def fold(word: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    return flat.replace("đ", "d").replace("Đ", "d")


def words(text: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", text)) if text else []


def written(texts: list[str | None]) -> tuple[set[str], set[str]]:
    """Folded words that texts write with a capital inside a sentence, and in lower case."""
    inside, lower = set(), set()
    for t in texts:
        for m in WORD.finditer(t or ""):
            if m[0][0].islower():
                lower.add(fold(m[0]))
            elif not m[0].isupper() and (t or "")[: m.start()].rstrip()[-1:] not in ("", ".", "!", "?", ":", "”", "“", "\n"):
                inside.add(fold(m[0]))
    return inside, lower


def names_of(texts: list[str | None]) -> frozenset[str]:
    """Folded words that the test items write with a capital inside a sentence and never in lower case."""
    inside, lower = written(texts)
    return frozenset(inside - lower)


def learn_names(items: DataFrame, text: str) -> frozenset[str]:
    """names_of all items, by one aggregation of their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            inside, lower = written(list(b["t"]))
            yield pd.DataFrame([(w, w in lower) for w in inside | lower], columns=["word", "low"])

    seen = items.select(F.col(text).alias("t")).where(F.length("t") > 0).mapInPandas(safe(run), "word string, low boolean")
    found = seen.groupBy("word").agg(F.max("low").alias("low")).where(~F.col("low")).select("word")
    return frozenset(row["word"] for row in found.toLocalIterator())


def placeholder(folded: str, names: frozenset[str]) -> str:
    if any(c.isdigit() for c in folded):
        return NUMBER
    if folded in UNITS:
        return UNIT
    return NAME if folded in names else folded


class Codes(dict):
    """word -> (template code, folded word if a placeholder hides it, code of the folded word)."""

    def __init__(self, names: frozenset[str]):
        super().__init__()
        self.names = names

    def __missing__(self, word: str) -> tuple[int, str | None, int]:
        if len(self) > 500_000:
            self.clear()
        folded = fold(word)
        shown = placeholder(folded, self.names)
        made = self[word] = (xxh3_64_intdigest(shown.encode()), None if shown == folded else folded, xxh3_64_intdigest(folded.encode()))
        return made


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive codes."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += codes[k : len(codes) - n + 1 + k]
    total ^= total >> np.uint64(29)
    return total


def template_windows(df: DataFrame, key: str, text: str, names: frozenset[str], n: int, probe: np.ndarray | None) -> DataFrame:
    """key, hash, slots: each window of n template words with the words its placeholders hide, in order; with probe, only hashes in it.

    Null and empty texts and texts of fewer than n words give no window. Texts are whole, of any length.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(names)
        for b in batches:
            keys, hashes, slots = [], [], []
            for k, t in zip(b["k"], b["t"]):
                found = [codes[w] for w in words(t)]
                if len(found) < n:
                    continue
                win = window_hashes(np.fromiter((c for c, _, _ in found), np.uint64, len(found)), n)
                hidden = np.cumsum(np.fromiter((s is not None for _, s, _ in found), np.int64, len(found)))
                bare = n - (hidden[n - 1 :] - np.concatenate([[0], hidden[:-n]])) < LEAST_WORDS
                if bare.any():
                    win = np.where(bare, ~window_hashes(np.fromiter((w for _, _, w in found), np.uint64, len(found)), n), win)
                if probe is None:
                    at = np.arange(len(win))
                else:
                    where = np.searchsorted(probe, win)
                    where[where == len(probe)] = 0
                    at = np.flatnonzero(probe[where] == win)
                for i in at:
                    keys.append(k)
                    hashes.append(int(win[i].astype(np.int64)))
                    slots.append([s for _, s, _ in found[i : i + n] if s is not None])
            yield pd.DataFrame({key: keys, "hash": pd.array(hashes, dtype="int64"), "slots": slots})

    source = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    return spread(source).mapInPandas(safe(run), f"{key} {kind}, hash bigint, slots array<string>")


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", n: int = WINDOW) -> DataFrame:
    """doc_key, item_key, windows, exact, renamed: how many windows of a document and an item agree, and how many of them word by word
    or after a one-to-one renaming of numbers, names and units. Windows of fewer than LEAST_WORDS words beside placeholders agree only
    word by word.

    Documents and items with null, empty or shorter texts take no part. Repeated rows of one key count as one text
    each; ties don't arise. Empty tables give an empty result.
    """
    names = learn_names(items, text)
    own = materialize(template_windows(items, item_key, text, names, n, None).withColumnRenamed("slots", "item_slots"))
    probe = None
    if own.count() <= PROBE_BOUND:
        found = own.select("hash").distinct().toPandas()["hash"].to_numpy().astype(np.int64).view(np.uint64)
        probe = np.sort(found)
        if not len(probe):
            kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
            return docs.sparkSession.createDataFrame([], f"{doc_key} {kinds[0]}, {item_key} {kinds[1]}, windows bigint, exact bigint, renamed bigint")
    theirs = template_windows(docs, doc_key, text, names, n, probe).dropDuplicates([doc_key, "hash", "slots"])
    both = theirs.join(own.dropDuplicates([item_key, "hash", "item_slots"]), "hash")
    same = F.col("slots") == F.col("item_slots")
    pairs = F.arrays_zip(F.col("slots").alias("d"), F.col("item_slots").alias("i"))
    distinct = F.size(F.array_distinct(pairs))
    renamed = ~same & (distinct == F.size(F.array_distinct("slots"))) & (distinct == F.size(F.array_distinct("item_slots")))
    return both.groupBy(doc_key, item_key).agg(
        F.count(F.lit(1)).alias("windows"), F.sum(same.cast("bigint")).alias("exact"), F.sum(renamed.cast("bigint")).alias("renamed")
    )
