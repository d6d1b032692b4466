"""Keyword-stuffed and link-list pages (problem 9).

A suffix automaton over a page's words gives the repeated maximal substrings with their numbers of occurrences. A word is
worn when a maximal substring of two words or more that covers it occurs often for the page's length. Pieces of a page
(sentences and lines) that are mostly worn words, or that are tags or links without any clause, count as spam; a page is
a case when more than half of its characters lie in such pieces. Pages that an exact bound, taken for a whole batch at once,
shows to hold no such piece get shares of 0 without an automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.frames import safe
from webloom.plans.session import spread

WORD = re.compile(r"[^\W_]+")
ANCHOR, CLOSED = re.compile(r"<a\s[^<>]*>", re.I), re.compile("</a>", re.I)
LINK = re.compile(r"\[[^\[\]\n]*\]\(https?://[^)\s]*\)|(?:https?://|www\.)\S+", re.I)
TAG = re.compile(r"[#@][^\W_][\w-]*|\[[^\]\d\n][^\]\n]{0,60}\](?!\()|\bSKU[ _-]?\d+|\b[A-Z]{2,4}-?\d{5,}\b")
PIECE = re.compile(r"[^\n]+?(?:[.!?…]+[\"”’)]*(?=\s+[^\W\d_“\"«(])|(?=\n)|$)")
RECORD = re.compile(r"\b\d{1,2}[:h]\d{2}\b|\b\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}\b")
WORD_OR_END = re.compile(r"[^\W_]+|[.!?…\n]")
ENDS = frozenset(".!?…\n")
SPACES = re.compile(r"\s+")
SPECIAL = re.compile(r"://|[#@\[]|SKU|www\.")
#: A maximal substring is worn when it occurs at least this often, and once in so many words of the page: in a piece
#: without the structure of a clause, and in one with it.
LEAST_BARE, BARE_ONE_IN = 3, 120
LEAST_CLAUSE, CLAUSE_ONE_IN = 4, 45
#: A single word is worn, in a piece without a clause, when it occurs so often, and once in so many words of the page.
LEAST_WORD, WORD_ONE_IN = 3, 30
#: Shares of worn words in a piece, with and without the structure of a clause.
WORN_CLAUSE, WORN_BARE = 0.8, 0.5
#: Numbers and codes that hardly return tell something; a piece with one in so many words is a record.
TOLD_ONE_IN = 15
SHARE = 0.5
#: Where so large a share of the characters in pieces without a clause is stuffed, the other such pieces are of the same kind.
SAME_KIND = 0.35
#: So many words of a batch are screened at once; pages of more words than an automaton should hold are measured by their pairs,
#: which cover exactly the same places.
SCREENED, AUTOMATON_WORDS = 400_000, 200_000


@lru_cache(maxsize=2)
def kinds(pattern: re.Pattern) -> np.ndarray:
    """Of every code point, whether a pattern of single characters or their runs takes it."""
    every = "".join(map(chr, range(0xD800))) + "\ue000" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    table = np.zeros(0x110000, bool)
    for m in pattern.finditer(every):
        table[m.start() : m.end()] = True
    table[0xD800:0xE000] = False
    return table


class SuffixAutomaton:
    """Suffix automaton of a sequence of ints: states are sets of substrings with the same ends."""

    def __init__(self, seq: list[int]):
        self.link, self.length, nxt = [-1], [0], [{}]
        count, self.ends = [0], []
        last = 0
        for c in seq:
            cur = len(self.length)
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            nxt.append({})
            count.append(1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = nxt[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.length)
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    nxt.append(dict(nxt[q]))
                    count.append(0)
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur
            self.ends.append(cur)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                count[self.link[s]] += count[s]
        self.count = count

    def covered(self, least: int, shortest: int) -> np.ndarray:
        """Which places lie in a repeated maximal substring of at least that many occurrences and that length."""
        # longest[s]: length of the longest suffix of state s's strings that occurs often enough
        longest = [0] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            longest[s] = self.length[s] if self.count[s] >= least else longest[self.link[s]]
        marks = np.zeros(len(self.ends) + 1, np.int64)
        for i, s in enumerate(self.ends):
            n = longest[s]
            if n >= shortest:
                marks[i + 1 - n] += 1
                marks[i + 1] -= 1
        return np.cumsum(marks[:-1]) > 0


def covered_by_pairs(codes: np.ndarray, leasts: tuple[int, ...]) -> list[np.ndarray]:
    """For each least, which places lie in a pair of neighbours that occurs at least that often.

    A longer substring occurs no more often than any pair in it, and a pair is a substring of two: these are exactly the places that
    SuffixAutomaton(codes).covered(least, 2) gives, without the automaton.
    """
    if len(codes) < 2:
        return [np.zeros(len(codes), bool) for _ in leasts]
    pairs = codes[:-1] * np.int64(codes.max() + 1) + codes[1:]
    _, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    times = counts[inverse]
    return [np.append(times >= n, False) | np.insert(times >= n, 0, False) for n in leasts]


def occurrences(keys: np.ndarray) -> np.ndarray:
    """Of every key, how often it stands in the array."""
    codes, _ = pd.factorize(keys)
    return np.bincount(codes)[codes] if len(keys) else np.empty(0, np.int64)


def between(old: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Places whose neighbours on both sides are old; same: whether a place and the next lie in one text."""
    out = np.zeros(len(old), bool)
    if len(old) > 2:
        out[1:-1] = old[:-2] & old[2:] & same[:-1] & same[1:]
    return out


def screen(texts: list[str | None]) -> np.ndarray:
    """Whether each text may hold links, tags or stuffed pieces. Where it says no, all shares are 0: an exact bound.

    Pieces are joined from stretches between end marks, and a piece is stuffed only where the least share of its characters is worn,
    common or between two such words; so where no stretch has that share, no piece has it, and none is taken for its kind.
    """
    flags = np.zeros(len(texts), bool)
    ids: dict[str, int] = {}
    at, codes, ends = [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        found = WORD_OR_END.findall(t)
        if SPECIAL.search(t):
            flags[i] = any(w not in ENDS for w in found)
            continue
        at.append((i, len(found)))
        codes += [ids.setdefault(w, len(ids)) for w in map(str.lower, found)]
    if not codes:
        return flags
    every = np.array(codes, np.int64)
    mark = np.zeros(len(ids), bool)
    digit = np.zeros(len(ids), bool)
    size = np.zeros(len(ids), np.float64)
    for w, k in ids.items():
        mark[k], size[k] = w in ENDS, len(w)
        digit[k] = not w.isalpha() and any(map(str.isdigit, w))
    doc = np.repeat([i for i, _ in at], [n for _, n in at])
    stops = mark[every]
    stretch = np.cumsum(stops | np.concatenate([[True], doc[1:] != doc[:-1]]))
    word, doc, stretch = every[~stops], doc[~stops], stretch[~stops]
    if not len(word):
        return flags
    n = np.bincount(doc, minlength=len(texts))[doc]
    times = occurrences(doc * len(ids) + word)
    same = doc[1:] == doc[:-1]
    pair = np.zeros(len(word), np.int64)  # occurrences of the pair that begins at a place
    if same.any():
        pair[:-1][same] = occurrences(((doc[:-1] * len(ids) + word[:-1]) * len(ids) + word[1:])[same]) if len(texts) * len(ids) ** 2 < 2**62 else _pair_times(doc, word, same)
    worn = pair >= np.maximum(LEAST_BARE, n // BARE_ONE_IN)
    worn[1:] |= worn[:-1] & same
    old = worn | ((times >= np.maximum(LEAST_WORD, n // WORD_ONE_IN)) & ~digit[word])
    old |= between(old, same)
    chars = size[word] * ~digit[word]
    whole, part = np.bincount(stretch, chars), np.bincount(stretch, chars * old)
    full = (part >= min(WORN_BARE, WORN_CLAUSE) * whole) & (whole > 0)
    flags[np.unique(doc[full[stretch]])] = True
    return flags


def _pair_times(doc: np.ndarray, word: np.ndarray, same: np.ndarray) -> np.ndarray:
    """occurrences of pairs where document and two words don't fit into one number."""
    first, _ = pd.factorize(word[:-1][same] * (int(word.max()) + 1) + word[1:][same])
    return occurrences(doc[:-1][same] * (int(first.max()) + 1) + first)


def worn_places(codes: np.ndarray, leasts: tuple[int, ...]) -> list[np.ndarray]:
    """For each least, which words lie in a repeated maximal substring of two words or more that occurs at least so often."""
    if len(codes) > AUTOMATON_WORDS:
        return covered_by_pairs(codes, leasts)
    automaton = SuffixAutomaton(codes.tolist())
    return [automaton.covered(n, 2) for n in leasts]


def anchors(text: str) -> Iterator[tuple[int, int]]:
    """Places of <a ...>...</a>, each up to the first end tag after it."""
    closed = [m.end() for m in CLOSED.finditer(text)]
    k, last = 0, 0
    for m in ANCHOR.finditer(text) if closed else ():
        if m.start() < last:
            continue
        while k < len(closed) and closed[k] <= m.end():
            k += 1
        if k == len(closed):
            return
        last = closed[k]
        yield m.start(), last


def measure(text: str | None) -> dict:
    """Shares of characters in links, tags and stuffed pieces; their union is what decides. Null or empty texts: all 0."""
    zero = {"spam_share": 0.0, "link_share": 0.0, "tag_share": 0.0, "stuffed_share": 0.0}
    tokens = WORD.findall(text) if text else []
    if not tokens:
        return zero
    ids: dict[str, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in map(str.lower, tokens)], np.int64)
    times = np.bincount(codes)[codes]
    special = SPECIAL.search(text) is not None
    digits = np.fromiter((not w.isalpha() and any(map(str.isdigit, w)) for w in ids), bool, len(ids))[codes]
    worn, strict = worn_places(codes, (max(LEAST_BARE, len(tokens) // BARE_ONE_IN), max(LEAST_CLAUSE, len(tokens) // CLAUSE_ONE_IN)))
    common = (times >= max(LEAST_WORD, len(tokens) // WORD_ONE_IN)) & ~digits
    one = np.ones(len(codes) - 1, bool)
    olds = [(old, between(old, one)) for old in (worn | common, strict)]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.diff(np.concatenate([[False], kinds(WORD)[points], [False]]).astype(np.int8))
    starts = np.flatnonzero(edges == 1)
    lengths = (np.flatnonzero(edges == -1) - starts).astype(np.float64)
    size = len(text)
    links, tags = np.zeros(size, bool), np.zeros(size, bool)
    if special:
        for a, b in anchors(text):
            links[a:b] = True
        for m in LINK.finditer(text):
            links[m.start() : m.end()] = True
        for m in TAG.finditer(text):
            tags[m.start() : m.end()] = True
        tags &= ~links
    stuffed = np.zeros(size, bool)
    free = ~(links | tags)[starts]
    spans = np.array([m.span() for m in PIECE.finditer(text)], np.int64).reshape(-1, 2)
    words_at = np.searchsorted(starts, spans)
    spans, words_at = spans[words_at[:, 0] < words_at[:, 1]], words_at[words_at[:, 0] < words_at[:, 1]]
    n = len(spans)
    first, last = words_at[:, 0], words_at[:, 1] - 1
    piece = np.repeat(np.arange(n), last - first + 1)  # every word lies in one piece
    plain = free & ~digits
    words = np.bincount(piece, plain, n)
    told = np.bincount(piece, free & digits & (times <= 2), n)
    texts = [text[a:b].strip() for a, b in spans.tolist()]
    for k in np.flatnonzero(np.bincount(piece, digits, n)):
        told[k] += len(RECORD.findall(texts[k]))
    clause = np.fromiter((p[:1].isupper() or p[:1] in "“\"«([" or p[:1].isdigit() for p in texts), bool, n)
    clause &= np.fromiter((p[-1:] in ".!?…”\"»’):;" for p in texts), bool, n) & (words >= 5)
    left = np.ones(n, bool)
    if special:
        of = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[spans], axis=1).ravel()
        linked, tagged = of(links), of(tags)
        listed = (linked > 0) & (words <= 8) & (told <= (linked < spans[:, 1] - spans[:, 0])) & ~clause
        named = ~listed & (tagged > 0) & (words <= 3)
        left = ~listed & ~named
        for a, b in spans[listed]:
            links[a:b] = True
        for a, b in spans[named]:
            tags[a:b] |= ~links[a:b]
    inside = np.ones(len(codes), bool)  # a word between two worn ones of its own piece
    inside[first] = inside[last] = False
    old = np.where(clause[piece], olds[1][0] | (olds[1][1] & inside), olds[0][0] | (olds[0][1] & inside))
    whole = np.bincount(piece, lengths * plain, n)
    share = np.bincount(piece, lengths * (plain & old), n) / np.maximum(whole, 1)
    open_ = left & (words > 0) & (told * TOLD_ONE_IN < words)
    worn_out = open_ & (share >= np.where(clause, WORN_CLAUSE, WORN_BARE))
    bare, sizes = open_ & ~clause, spans[:, 1] - spans[:, 0]
    if sizes[bare & worn_out].sum() >= SAME_KIND * max(sizes[bare].sum(), 1):
        worn_out = worn_out | bare
    for a, b in spans[worn_out]:
        stuffed[a:b] = True
    letters = ~kinds(SPACES)[points]
    total = letters.sum()
    part = lambda mask: float((mask & letters).sum() / total)
    return {"spam_share": part(links | tags | stuffed), "link_share": part(links), "tag_share": part(tags & ~links), "stuffed_share": part(stuffed & ~links & ~tags)}


def measured(texts: list[str | None]) -> Iterator[dict]:
    """measure of each text, screened in bounded groups."""
    group, size = [], 0
    for k, t in enumerate(texts):
        group.append(t)
        size += len(t) // 4 if t else 0
        if size > SCREENED or k == len(texts) - 1:
            for text, flag in zip(group, screen(group)):
                yield measure(text if flag else None)
            group, size = [], 0


def measure_pages(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and the four shares for every row.

    Null, empty and blank texts have shares of 0, and so have texts without words. Texts are whole, of any length.
    Repeated rows are measured each; an empty table gives an empty result.
    """
    kind = dict(df.dtypes)[key]
    shares = ["spam_share", "link_share", "tag_share", "stuffed_share"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(list(measured(list(b["t"]))), columns=shares)
            out.insert(0, key, b["k"].to_numpy())
            yield out

    return spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInPandas(safe(run), f"{key} {kind}, " + ", ".join(f"{s} double" for s in shares))


def find_spam(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key of the pages of which more than half the characters are repeated keywords, link lists or tags."""
    return measure_pages(df, key, text).where(F.col("spam_share") > SHARE).select(key)
