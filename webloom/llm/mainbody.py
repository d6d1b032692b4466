"""Page boilerplate and main content (problem 6).

Site style trees: the pages of a host are merged into one tree whose nodes are presentations (the path of block elements
with their classes; for captured text, the way a line begins) with the contents found there. A node's importance is the
entropy of what it holds over the pages: menus, footers and notices say the same everywhere, comments and cookie bars begin
the same everywhere, body text hardly ever does. Branches of low importance are removed from every page, with what HTML
itself marks as apart from the text (headings, captions, links on their own, hidden parts).
"""

from __future__ import annotations

import html as entities
import marshal
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from webloom.functions.frames import safe
from webloom.functions.hosts import row_host, url_host
from webloom.llm import encodings
from webloom.llm.lookalike import normalize
from webloom.plans.session import materialize, spread

# ---------------------------------------------------------------- pages

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
# Elements that don't break a text, elements without content, and elements whose content isn't text of the page's body.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav header footer aside button form select option figure figcaption caption head h1 h2 h3 h4 h5 h6 menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_ITSELF = frozenset("li p td th tr dt dd option".split())
BOUNDS_ITEMS = frozenset("ul ol table dl select div section article main".split())
ATTRIBUTE = re.compile(r"(class|id|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
DATE = re.compile(r"^\W*(?:\d{1,4}[-/.]\d{1,2}[-/.]\d{2,4})(?:\W+\d{1,2}[:h]\d{2}(?::\d{2})?)?\W*$")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[^\W_]+")

#: Pages of a style node from which its entropy is trusted, and bits of the entropy of its beginnings below which it is unimportant.
LEAST_PAGES, LEAST_BITS, NODE_SHARE = 8, 2.2, 0.01
#: A text on so many pages of a host, and on that share of them, is boilerplate; so is one on so many pages, and that share, of all hosts.
SAME_PAGES, SAME_SHARE = 5, 0.05
ALL_PAGES, ALL_SHARE = 6, 0.005


#: So many entries of style trees, or line beginnings, are held by every worker; beyond it they are joined.
HELD = 1_000_000


class Piece(NamedTuple):
    """A text between block tags; chain: its elements' style nodes from the root down, ids: their numbers on the page."""

    text: str
    chain: tuple[int, ...]
    ids: tuple[int, ...]
    inline: str | None
    linked: int
    apart: bool
    heading: bool
    hidden: bool
    button: bool


def parse(source: str) -> tuple[list[tuple], str]:
    """Pieces of text between block tags in document order, as plain tuples, and the page's title. Broken markup never fails.

    A style node is the path of elements with their classes down to a piece's own; its number is hashed along that path, so that
    equal paths of all pages are one node.
    """
    stack: list[tuple[str, str, int, bool, bool, int]] = []  # tag, style, number; apart and hidden so far; style node
    inline: list[str] = []
    pieces: list[tuple] = []
    held: list[tuple[str, str | None]] = []
    title, number = "", 0

    def flush() -> None:
        text = "".join(t for t, _ in held)
        if "&" in text:
            text = entities.unescape(text)
        text = SPACE.sub(" ", text).strip()
        if text:
            marks = {m for t, m in held if t.strip()}
            linked = sum(len(t.strip()) for t, m in held if m == "a")
            top = stack[-1] if stack else ("", "", 0, False, False, 0)
            pieces.append(
                (
                    text, tuple(s[5] for s in stack), tuple(s[2] for s in stack), marks.pop() if len(marks) == 1 else None, linked,
                    top[3], top[0] in HEADINGS, top[4], top[1].startswith("button"),
                )
            )
        held.clear()

    for m in TOKEN.finditer(encodings.compose(source)):
        tag = m[3]
        if tag is None:
            raw = m[0]
            if m[1]:
                if m[1].lower() == "title" and not title:
                    title = SPACE.sub(" ", entities.unescape(re.sub(r"<[^>]*>", "", raw))).strip()
            elif raw[0] != "<" or raw == "<":
                held.append((raw, ("a" if "a" in inline else inline[0]) if inline else None))
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag in VOID:
                continue
            if m[2]:
                if tag in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(tag) :]
            else:
                inline.append(tag)
            continue
        flush()
        inline.clear()
        if tag in VOID:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_ITSELF:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag or (tag == "tr" and stack[k][0] in ("td", "th")) or (tag in ("td", "th") and stack[k][0] in ("td", "th")):
                    del stack[k:]
                    if tag != "tr" or not stack or stack[-1][0] != "tr":
                        break
                elif stack[k][0] in BOUNDS_ITEMS or stack[k][0] == "tr":
                    break
        elif stack and stack[-1][0] == "p":
            stack.pop()
        number += 1
        style, hidden = tag, False
        if m[4].strip():
            for name, a, b, c in ATTRIBUTE.findall(m[4]):
                value = a or b or c
                name = name.lower()
                if name == "class" and value:
                    style += "." + ".".join(sorted(value.split()))
                elif name == "id" and value:
                    style += "#" + DIGITS.sub("0", value) if len(value) > 4 else "#" + value
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    hidden = True
        _, _, _, apart, unseen, above = stack[-1] if stack else ("", "", 0, False, False, 0)
        node = xxh3_64_intdigest(style, above) >> 1  # within 63 bits
        stack.append((tag, style, number, apart or tag in APART, unseen or hidden, node))
    flush()
    return pieces, title


def form(text: str) -> str:
    return DIGITS.sub("0", text.lower())


def text_id(text: str) -> int:
    return xxh3_64_intdigest(form(text)) >> 1


def beginning(text: str) -> int:
    return xxh3_64_intdigest(" ".join(DIGITS.sub("0", w) for w in text.lower().split(None, 2)[:2])) >> 1


def _array(lists: list[list[int]]) -> pd.Series:
    return pd.Series([np.array(x, np.int64) for x in lists], dtype=object)


def parsed_pages(df: DataFrame, key: str, url: str, score: np.ndarray, wanted: Column | None = None) -> DataFrame:
    """k, url, host, wanted and the parsed page of the rows whose declared encoding gives what was written: decoded and parsed once.

    pieces: title and pieces, marshalled. texts: numbers of its distinct texts. nodes, starts: its distinct pairs of a style node and a
    beginning of what stands there. children, parents: its style nodes and those above them. Pages that are null or empty, and
    those read wrongly, are left out.
    """
    kind = dict(df.dtypes)[key]
    held = df.sparkSession.sparkContext.broadcast(score)
    names = ["texts", "nodes", "starts", "children", "parents"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep, blobs, found = [], [], {n: [] for n in names}
            for html, encoding in zip(b["html_b64"], b["encoding"]):
                page = encodings.decode_page(html, encoding)
                keep.append(bool(page) and not encodings.is_garbled(page, held.value))
                if not keep[-1]:
                    continue
                pieces, title = parse(page)
                blobs.append(marshal.dumps((title, pieces)))
                found["texts"].append(list({text_id(t) for t in {p[0] for p in pieces}}))
                pairs = {(p.chain[-1], beginning(p.text)) for p in map(Piece._make, pieces) if p.chain and not p.apart and not p.hidden and p.linked * 2 < len(p.text)}
                found["nodes"].append([n for n, _ in pairs])
                found["starts"].append([s for _, s in pairs])
                above = {c: a for p in pieces for a, c in zip((0, *p[1]), p[1])}
                found["children"].append(list(above))
                found["parents"].append(list(above.values()))
            rows = b.loc[keep, ["k", "url", "host", "wanted"]].reset_index(drop=True)
            yield rows.assign(pieces=pd.Series(blobs, dtype=object), **{n: _array(x) for n, x in found.items()})

    rows = spread(df.select(F.col(key).alias("k"), F.col(url).alias("url"), url_host(F.col(url)).alias("host"), (F.lit(True) if wanted is None else wanted).alias("wanted"), "html_b64", "encoding"))
    arrays = ", ".join(f"{n} array<bigint>" for n in names)
    return rows.where(F.length("html_b64") > 0).mapInPandas(safe(run), f"k {kind}, url string, host string, wanted boolean, pieces binary, {arrays}")


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, nodes) of all hosts' merged trees that decide anything; every URL of a host counts once.

    texts: host, id of the texts (with their digits blurred) that stand on enough of a host's pages. nodes: host, id, leaf, low of
    the style nodes on enough of them. A leaf's importance is the entropy of the beginnings of what it holds; a branch's is composed
    of those below it, each by its pages, and it is low only if nothing below it is important. Host '' is all hosts together.
    Thresholds are shares of a host's pages, so a host has at most 1 / share times as many entries as a page holds.
    """
    first = pages.groupBy("url").agg(F.min("k").alias("k")).select("k")
    counted = pages.drop("pieces", "wanted", "url").join(first, "k", "left_semi")
    scoped = lambda *columns: counted.select(F.explode(F.array_distinct(F.array("host", F.lit("")))).alias("host"), *columns)
    own = counted.groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(own.where("host <> ''").unionByName(own.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).select(F.lit("").alias("host"), "size")))
    least = F.when(F.col("host") == "", F.greatest(F.lit(float(ALL_PAGES)), F.col("size") * ALL_SHARE)).otherwise(F.greatest(F.lit(float(SAME_PAGES)), F.col("size") * SAME_SHARE))
    texts = scoped("texts").select("host", F.explode("texts").alias("id")).groupBy("host", "id").agg(F.count(F.lit(1)).alias("n")).join(sizes, "host").where(F.col("n") >= least).select("host", "id")

    enough = F.col("pages") >= F.greatest(F.lit(float(LEAST_PAGES)), F.col("size") * NODE_SHARE)
    held = scoped("nodes", "starts").select("host", F.explode(F.arrays_zip("nodes", "starts")).alias("x")).select("host", F.col("x.nodes").alias("id"), F.col("x.starts").alias("start"))
    n = F.col("n").cast("double")
    leaves = held.groupBy("host", "id", "start").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "id").agg(F.sum("n").alias("pages"), F.sum(n * F.log2(n)).alias("nlogn")).join(sizes, "host").where(enough)
    leaves = leaves.select("host", "id", F.col("pages").cast("double").alias("pages"), (F.log2("pages") - F.col("nlogn") / F.col("pages")).alias("bits"))
    edges = scoped("children", "parents").select("host", F.explode(F.arrays_zip("children", "parents")).alias("x")).groupBy("host", F.col("x.children").alias("id")).agg(F.count(F.lit(1)).alias("pages"), F.max("x.parents").alias("parent"))
    edges = edges.join(sizes, "host").where(enough).select("host", "id", "parent")
    return texts, leaves.groupBy("host").cogroup(edges.groupBy("host")).applyInPandas(composed, "host string, id bigint, leaf boolean, low boolean")


def composed(leaves: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Leaves of one host's tree with whether they are unimportant, and its branches by the importance composed of the leaves below them."""
    above = dict(zip(edges["id"], edges["parent"]))
    rows = [(i, True, bits < LEAST_BITS) for i, bits in zip(leaves["id"], leaves["bits"])]
    branches: dict[int, list[float]] = {}
    for i, pages, bits in zip(leaves["id"], leaves["pages"], leaves["bits"]):
        at = above.get(i, 0)
        while at:
            b = branches.setdefault(at, [0.0, 0.0, 0.0])
            b[0], b[1], b[2] = b[0] + pages, b[1] + pages * bits, max(b[2], bits)
            at = above.get(at, 0)
    rows += [(i, False, total / pages < LEAST_BITS and most < LEAST_BITS) for i, (pages, total, most) in branches.items()]
    host = leaves["host"].iloc[0] if len(leaves) else ""
    return pd.DataFrame([(host, *r) for r in rows], columns=["host", "id", "leaf", "low"])


class Tree:
    """What is known of merged pages: by host, texts that are boilerplate, and whether leaves and branches are unimportant."""

    def __init__(self, same: dict[str, set[int]], leaves: dict[str, dict[int, bool]], branches: dict[str, dict[int, bool]]):
        self.same, self.leaves, self.branches = same, leaves, branches

    def has(self, host: str, text: str) -> bool:
        i = text_id(text)
        return i in self.same.get(host, ()) or i in self.same.get("", ())

    def unimportant(self, host: str, chain: tuple[int, ...]) -> bool:
        """By the leaf in the host's own tree, else by the nearest branch above it there, else by the leaf in the tree of all hosts."""
        own = self.leaves.get(host, {}).get(chain[-1]) if chain else None
        if own is None:
            branches = self.branches.get(host, {})
            own = next((branches[n] for n in reversed(chain) if n in branches), None)
            own = own or self.leaves.get("", {}).get(chain[-1] if chain else 0, False)
        return own


def main_pieces(pieces: list[tuple], title: str, host: str, tree: Tree) -> list[str]:
    """Main body of a page: pieces of important nodes."""
    pieces = [Piece._make(p) for p in pieces]
    heads = {p.text for p in pieces if p.heading}
    titled: set[int] = set()
    plain_title = title.lower()
    for p in pieces:  # branches on the way to the page's own title are never dropped as a whole
        if (p.heading or p.inline) and len(p.text) > 3 and p.text.lower()[:40] in plain_title:
            titled.update(p.ids[:-1] if p.heading else p.ids)
    dropped: set[int] = set()
    for p in pieces:
        parents = p.ids[:-1]
        if len(parents) > 2 and parents[-1] not in titled and (p.button or (p.heading and tree.has(host, p.text))):
            dropped.add(parents[-1])
    kept = []
    for p in pieces:
        text = p.text
        if p.apart or p.hidden or p.heading or p.linked * 2 >= len(text) or text in heads:
            continue
        if p.inline and (p.inline in ("time", "i", "b", "strong", "em", "small", "span") and (len(text) < 100 or text.lower()[:40] in plain_title)):
            continue
        if DATE.match(text) or (len(text) > 3 and text.lower()[:60] in plain_title):
            continue
        if dropped.intersection(p.ids) or tree.has(host, text) or tree.unimportant(host, p.chain):
            continue
        kept.append(unicodedata.normalize("NFC", text))
    return list(dict.fromkeys(kept))


def page_main_body(df: DataFrame, key: str, url: str, score: np.ndarray, wanted: Column | None = None) -> DataFrame:
    """key, piece_no, text: the main body of the wanted pages (columns html_b64, encoding), piece by piece; all pages grow the trees.

    Pages that are null or empty, or that their declared encoding reads wrongly, have no pieces, nor have pages without text. Repeated
    rows are taken each; their URL counts once in the tree of its host. Texts are whole, of any length. Empty tables give
    an empty result.
    """
    kind = dict(df.dtypes)[key]
    pages = materialize(parsed_pages(df, key, url, score, wanted))
    texts, nodes = (materialize(x) for x in style_tree(pages))
    rows = pages.where("wanted").select("k", "host", "pieces")
    shape = f"{key} {kind}, piece_no bigint, text string"

    def grown(some_texts: DataFrame, some_nodes: DataFrame) -> Tree:
        same: dict[str, set[int]] = {}
        known: tuple[dict, dict] = ({}, {})
        for r in some_texts.toLocalIterator():
            same.setdefault(r["host"], set()).add(r["id"])
        for r in some_nodes.toLocalIterator():
            known[not r["leaf"]].setdefault(r["host"], {})[r["id"]] = r["low"]
        return Tree(same, *known)

    def cut(b: pd.DataFrame, trees: Iterable[Tree]) -> pd.DataFrame:
        out = []
        for k, h, blob, tree in zip(b["k"], b["host"], b["pieces"], trees):
            title, pieces = marshal.loads(blob)
            out += [(k, i, t) for i, t in enumerate(main_pieces(pieces, title, h, tree))]
        return pd.DataFrame(out, columns=[key, "piece_no", "text"])

    if texts.count() + nodes.count() <= HELD:
        held = df.sparkSession.sparkContext.broadcast(grown(texts, nodes))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield cut(b, repeat(held.value))

        return rows.mapInPandas(safe(run), shape)

    # too many hosts for every worker to hold all trees: each page comes with its host's tree, workers hold the common one
    shared = df.sparkSession.sparkContext.broadcast(grown(texts.where("host = ''"), nodes.where("host = ''")))
    ids = lambda c: F.collect_set(F.when(c, F.col("id")))
    own = texts.where("host <> ''").groupBy("host").agg(F.collect_set("id").alias("same"))
    leaf, low = F.col("leaf"), F.col("low")
    lows = nodes.where("host <> ''").groupBy("host").agg(ids(leaf & low).alias("ll"), ids(leaf & ~low).alias("lh"), ids(~leaf & low).alias("bl"), ids(~leaf & ~low).alias("bh"))
    joined = rows.join(own, "host", "left").join(lows, "host", "left")

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_list = lambda x: [] if x is None else list(x)
        for b in batches:
            trees, known = [], {}
            for h, s, ll, lh, bl, bh in zip(b["host"], b["same"], b["ll"], b["lh"], b["bl"], b["bh"]):
                if h not in known:
                    of = lambda yes, no: dict.fromkeys(as_list(yes), True) | dict.fromkeys(as_list(no), False)
                    all_ = shared.value
                    known[h] = Tree({h: set(as_list(s)), "": all_.same.get("", set())}, {"": all_.leaves.get("", {}), h: of(ll, lh)}, {h: of(bl, bh)})
                trees.append(known[h])
            yield cut(b, trees)

    return joined.mapInPandas(safe(run_joined), shape)


# ---------------------------------------------------------------- captured text

SENTENCE = re.compile(r"[.!?…][\"”’)]*\s+")
#: A beginning that never stands inside a paragraph is boilerplate of its host from this share of rows on (and so many of them), or
#: if it mostly stands outside of the body; seldom ones are left alone.
LINE_SHARE, LINE_ROWS, SELDOM, OUTSIDE = 0.08, 6, 3, 0.25
#: Share of a beginning's occurrences inside paragraphs from which it is body text.
INNER = 0.02


def line_start(sentence: str) -> int:
    return xxh3_64_intdigest(DIGITS.sub("0", " ".join(sentence.split(None, 3)[:3]).lower())) - (1 << 63)


def line_label(line: str) -> int | None:
    """Node of what a line without end punctuation stands under: its words before an early colon, else its first two; None without a word."""
    head, colon, _ = line.partition(":")
    found = WORDS.findall(head.lower())
    found = found if colon and len(found) <= 4 else WORDS.findall(line.lower())[:2]
    return xxh3_64_intdigest("\x1e" + " ".join(DIGITS.sub("0", w) for w in found)) - (1 << 63) if found else None


def sentences(line: str) -> list[str]:
    """Sentences of a line; what closes a quotation after an end mark goes with the blank."""
    out, last = [], 0
    for m in SENTENCE.finditer(line):
        out.append(line[last : m.start() + 1])
        last = m.end()
    out.append(line[last:])
    return [s for s in out if s]


def split_lines(text: str) -> list[tuple[str, list[str]]]:
    """Lines with their sentences; blank lines have none."""
    out = []
    for raw in normalize(text).split("\n"):
        line = " ".join(raw.split())
        out.append((line, sentences(line) if line else []))
    return out


def prose(line: str) -> bool:
    return line[-1:] in ".!?…”\"" or line[-2:] in (".»", "!»", "?»")


def bare(line: str, sentences: list[str]) -> bool:
    """A single sentence or phrase without end punctuation."""
    return len(sentences) == 1 and not prose(line)


def full_paragraphs(lines: list[tuple[str, list[str]]]) -> list[int]:
    return [i for i, (line, s) in enumerate(lines) if len(s) > 1 and len(line) > 120]


COUNTS = ("lead", "inner", "inside", "bare")


def parsed_texts(rows: DataFrame, kind: str) -> DataFrame:
    """k, host, text_id, body and two lists of every text (columns k, host, t, title, text_id), read once.

    Nodes (start, lead, inner, inside, bare): how often a beginning leads a line of the text, stands inside one, leads a line between
    paragraphs, and leads one without end punctuation. Lines (no, first, label, between) that don't repeat the title: number at
    line feeds, beginning, label, and whether it stands between full paragraphs; only lines that are a single sentence or phrase
    without end punctuation have a label, others have 0.
    """

    def read(text: str, title: str | None) -> tuple:
        heading = " ".join(normalize(title).split()).lower() if title else ""
        lines = split_lines(text)
        full = full_paragraphs(lines)
        first, last = (full[0], full[-1]) if full else (len(lines), -1)
        tree: dict[int, list[int]] = {}
        shown = []
        for i, (line, parts) in enumerate(lines):
            if not parts:
                continue
            start = line_start(parts[0])
            node = tree.setdefault(start, [0, 0, 0, 0])
            node[0] += 1
            node[2] += first <= i <= last
            label = None
            alone = bare(line, parts)
            if alone:
                node[3] += 1
                if (label := line_label(line)) is not None:
                    tree.setdefault(label, [0, 0, 0, 0])[3] += 1
            for s in parts[1:]:
                tree.setdefault(line_start(s), [0, 0, 0, 0])[1] += 1
            if line.lower() == heading:
                continue
            if not alone:
                shown.append((i, start, 0, False))
            elif label is not None and not DATE.match(line):
                shown.append((i, start, label, first < i < last))
        # copies of an article are one text, whatever their hosts put around it
        body = xxh3_64_intdigest("\n".join(lines[i][0] for i in full) or text) - (1 << 63)
        return body, tree, shown

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [read(t, h) for t, h in zip(b["t"], b["title"])]
            out = b[["k", "host", "text_id"]].assign(body=pd.array([f[0] for f in found], "int64"), start=_array([list(f[1]) for f in found]))
            for i, c in enumerate(COUNTS):
                out[c] = _array([[v[i] for v in f[1].values()] for f in found])
            for i, c in enumerate(("no", "first", "label")):
                out[c] = _array([[x[i] for x in f[2]] for f in found])
            out["between"] = pd.Series([np.array([x[3] for x in f[2]], bool) for f in found], dtype=object)
            yield out

    arrays = ", ".join(f"{c} array<bigint>" for c in ("start", *COUNTS, "no", "first", "label"))
    return rows.mapInPandas(safe(run), f"k {kind}, host string, text_id bigint, body bigint, {arrays}, between array<boolean>")


def line_tree(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, frequent). nodes: start, lead, inner, inside, bare, bodies of all texts merged, with the number of texts that hold each.
    frequent: start, host of those that lead lines in a large share of a host's texts (at most 1 / share times as many a host
    as a text has lines)."""
    grown = texts.select("host", "body", F.explode(F.arrays_zip("start", *COUNTS)).alias("x")).select("host", "body", "x.*")
    # parted by beginning once: what follows needs no other shuffle of it
    grown = grown.repartition("start").groupBy("start", "host", "body").agg(*[F.max(c).alias(c) for c in COUNTS])
    grown = grown.withColumn("texts", F.count_if(F.col("lead") > 0).over(Window.partitionBy("start", "host")))
    sizes = materialize(texts.groupBy("host").agg(F.countDistinct("text_id").alias("size")))
    merged = grown.join(F.broadcast(sizes) if sizes.count() <= HELD else sizes, "host")
    often = (F.col("texts") >= LINE_ROWS) & (F.col("texts") >= LINE_SHARE * F.col("size"))
    merged = materialize(merged.select("start", "host", "body", *COUNTS, often.alias("often")))
    once = merged.groupBy("start", "body").agg(*[F.max(c).alias(c) for c in COUNTS])
    nodes = once.groupBy("start").agg(*[F.sum(c).alias(c) for c in COUNTS], F.count(F.lit(1)).alias("bodies"))
    return nodes, merged.where("often").select("start", "host").distinct()


def text_main_body(df: DataFrame, key: str, text: str, title: str, host: str, url: str) -> DataFrame:
    """key, line_no: the lines of every text that are main body.

    Lines of sentences are body unless their beginning is noise. A single one without end punctuation is body if its beginning
    stands inside paragraphs, as often as it leads such lines and as its label does, or if it stands between paragraphs and not
    under a label that several texts use.

    Null, empty and blank texts have none. Rows without any host form the host ''. Texts are whole, of any length. Repeated
    rows are taken each, but count once in the tree. Empty tables give an empty result.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), row_host(F.col(host), F.col(url)).alias("host"), F.col(text).alias("t"), F.col(title).alias("title"), F.xxhash64(F.col(text)).alias("text_id"))
    texts = materialize(parsed_texts(spread(rows.where(F.length("t") > 0)), kind))
    seldom_inside = (F.col("inner") < INNER * F.col("lead")) & (F.col("lead") >= SELDOM)
    noise = seldom_inside & (F.col("inside") < OUTSIDE * F.col("lead"))
    known = (F.col("bare") > 0) & (F.col("inner") >= F.col("bare")) & (F.col("inner") >= INNER * F.col("lead"))
    label = (F.col("lead") == 0) & (F.col("bare") > 0) & (F.col("bodies") >= SELDOM)
    what = F.when(noise, "noise").when(known, "known").when(label, "label")
    times = F.when(what == "known", F.col("inner")).otherwise(F.col("bodies"))
    nodes, frequent = line_tree(texts)
    # noise of some hosts only, where elsewhere the same beginning may lead lines of a body
    frequent = materialize(frequent.join(nodes.where(seldom_inside).select("start"), "start"))
    nodes = materialize(nodes.select("start", what.alias("what"), times.alias("times")).where(F.col("what").isNotNull()))
    sized = F.broadcast if nodes.count() + frequent.count() <= HELD else (lambda x: x)
    hosted = sized(frequent.select(F.col("start").alias("first"), "host"))
    begins = sized(nodes.where("what <> 'label'").select(F.col("start").alias("first"), F.col("what").alias("how"), F.col("times").alias("known")))
    labels = sized(nodes.where("what = 'label'").select(F.col("start").alias("label"), F.col("times").alias("labels")))
    lines = texts.select("k", "host", F.explode(F.arrays_zip("no", "first", "label", "between")).alias("x")).select("k", "host", "x.*")
    lines = lines.join(hosted, ["host", "first"], "left_anti").join(begins, "first", "left").where(F.coalesce(F.col("how") != "noise", F.lit(True))).join(labels, "label", "left")
    times = F.when(F.col("how") == "known", F.col("known")).otherwise(0)
    body = (F.col("label") == 0) | (F.col("between") & F.col("labels").isNull()) | (times >= F.greatest(F.lit(1), F.coalesce("labels", F.lit(0))))
    return lines.where(body).select(F.col("k").alias(key), F.col("no").alias("line_no"))
