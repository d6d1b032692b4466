"""Pages as flat trees: nodes in document order with the place where their subtree ends, so that a subtree is a slice.

No Spark here. Broken markup never fails: missing end tags are implied, stray ones are skipped, html, head and body are
always there.
"""

from __future__ import annotations

import hashlib
import json
import re
from html import unescape
from itertools import islice

from webloom.functions.urls import DOCUMENT_EXT, IMAGE_EXT, python_norm

# Sets of tags with their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
CLEANED = frozenset("script style noscript iframe form svg button input select nav footer aside template".split())
CANDIDATES = frozenset("div section article main td table tbody tr body form".split())
LEAF_BLOCKS = frozenset("p li td th div dt dd address h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
SILENT = frozenset("script style template rt rp".split())
KEPT = frozenset("p br h1 h2 h3 h4 h5 h6 ul ol li blockquote figure figcaption table thead tbody tr th td strong b em i u sub sup img a div span section article".split())
DROPPED = frozenset("script style form iframe noscript svg button input select nav footer header".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# End tags that an opening tag implies, and where the search for them ends.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",)}
# Weights of class and id names, punctuation, and the parameters of the score and the descent.
BONUS = re.compile("content|article|post|entry|detail|bodytext|main|news-body|noi-?dung", re.I)
PENALTY = re.compile("nav|menu|footer|header|sidebar|comment|share|related|breadcrumb|banner|widget|social|advert|popup|modal|pagination|tag", re.I)
PUNCTUATION = re.compile("[.,;:?!…]")
ALPHA, BETA, GAMMA, DELTA = 2.0, 30.0, 1.0, 0.65
# Lines of authors and sources, authors that are none, and forms of dates.
AUTHOR_LINE = re.compile(r"^(?:Tác giả|Người viết|Tin,? ?ảnh|Bài,? ?ảnh|Tin,? ?bài|Bài viết|Ảnh)\s*[:：]\s*(.{2,80})$", re.I)
SOURCE_LINE = re.compile(r"^(?:Nguồn\s*[:：]\s*(.{2,120})|Theo\s+(.{2,80}))$", re.I)
NO_AUTHOR = frozenset(("admin", "administrator", "webmaster", "super user", "superuser"))
DATED = re.compile("date|time|posted|meta")
DATE_VN = re.compile(r"(?<!\d)(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})(?!\d)")
DATE_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})")
# Folders whose images belong to the template; lengths of stored titles, texts and previews.
TEMPLATE_FOLDERS = ("/themes/", "/templates/", "/assets/")
TITLE_CAP, TEXT_CAP, HTML_CAP = 500, 200_000, 40_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def clean(text: str) -> str:
    return " ".join(text.split())


class Page:
    """Flat tree: tags ('#' for text), attributes or text, parents, ends of subtrees, and what is still alive."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.data: list = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.alive: list[bool] = []

    def add(self, tag: str, data, parent: int) -> int:
        self.tag.append(tag)
        self.data.append(data)
        self.parent.append(parent)
        self.end.append(len(self.tag))
        self.alive.append(True)
        return len(self.tag) - 1

    def inside(self, i: int):
        """Living elements below a node, in document order."""
        return (k for k in range(i + 1, self.end[i]) if self.alive[k] and self.tag[k] != "#")

    def children(self, i: int):
        k = i + 1
        while k < self.end[i]:
            if self.alive[k]:
                yield k
            k = self.end[k]

    def remove(self, i: int) -> None:
        self.alive[i : self.end[i]] = [False] * (self.end[i] - i)

    def attr(self, i: int, name: str) -> str:
        return self.data[i].get(name, "")

    def classes(self, i: int) -> list[str]:
        return self.attr(i, "class").split()

    def first(self, i: int, tag: str) -> int | None:
        return next((k for k in self.inside(i) if self.tag[k] == tag), None)

    def by_attr(self, i: int, name: str, value: str) -> int | None:
        return next((k for k in self.inside(i) if self.data[k].get(name) == value), None)

    def ancestors(self, i: int):
        i = self.parent[i]
        while i >= 0:
            yield i
            i = self.parent[i]

    def fragments(self, i: int):
        """Living texts below a node, but for those in silent elements below it."""
        k, end = i + 1, self.end[i]
        while k < end:
            if not self.alive[k] or self.tag[k] in SILENT:
                k = self.end[k]
                continue
            if self.tag[k] == "#":
                yield self.data[k]
            k += 1

    def text(self, i: int, between: str = " ", strip: bool = False) -> str:
        parts = self.fragments(i)
        if strip:
            parts = (p for p in (x.strip() for x in parts) if p)
        return between.join(parts)

    @property
    def body(self) -> int:
        return self.first(0, "body") or 0


def parse(source: str) -> Page:
    page = Page()
    root = page.add("#root", {}, -1)
    stack = [page.add("html", {}, root)]
    stack = [root, *stack]
    head = body = None

    def close_to(depth: int) -> None:
        for i in stack[depth:]:
            page.end[i] = len(page.tag)
        del stack[depth:]

    def into_body() -> None:
        nonlocal body
        if body is None:
            close_to(2)
            body = page.add("body", {}, 1)
            stack.append(body)
        elif len(stack) < 3:
            stack.append(body)

    at, size = 0, len(source)
    while at < size:
        m = TOKEN.match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] == "<" and m[0] != "<":
                continue
            if body is None and not m[0].strip():
                continue
            into_body()
            page.add("#", unescape(m[0]) if "&" in m[0] else m[0], stack[-1])
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            for d in range(len(stack) - 1, 2, -1):
                if page.tag[stack[d]] == tag:
                    close_to(d)
                    break
            if tag == "head" and body is None:
                close_to(2)
            continue
        attrs = {}
        if m[3].strip():
            for n, a, b, c in ATTRIBUTE.findall(m[3]):
                v = a or b or c
                attrs.setdefault(n.lower(), unescape(v) if "&" in v else v)
        if tag == "html":
            page.data[1].update(attrs)
            continue
        if tag == "head":
            if head is None and body is None:
                head = page.add("head", attrs, 1)
                stack.append(head)
            continue
        if tag == "body":
            fresh = body is None
            into_body()
            if fresh:
                page.data[body].update(attrs)
            continue
        if body is None and tag in HEAD_ONLY:
            if head is None:
                head = page.add("head", {}, 1)
                stack.append(head)
        else:
            into_body()
        if tag in CLOSES_P:
            for d in range(len(stack) - 1, 2, -1):
                if page.tag[stack[d]] == "p":
                    close_to(d)
                    break
                if page.tag[stack[d]] in ("td", "th", "table", "div", "li"):
                    break
        if tag in IMPLIED:
            lowest = None
            for d in range(len(stack) - 1, 2, -1):
                if page.tag[stack[d]] in SCOPE[tag]:
                    break
                if page.tag[stack[d]] in IMPLIED[tag]:
                    lowest = d
            if lowest is not None:
                close_to(lowest)
        if tag == "tr" and page.tag[stack[-1]] == "table":
            stack.append(page.add("tbody", {}, stack[-1]))
        i = page.add(tag, attrs, stack[-1])
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            raw = source[at : stop.start() if stop else size]
            at = stop.end() if stop else size
            if raw:
                page.add("#", unescape(raw) if tag in ("title", "textarea") else raw, i)
            page.end[i] = len(page.tag)
            continue
        stack.append(i)
    into_body()
    close_to(0)
    return page


def tidy(page: Page) -> None:
    """Removes what holds no content: certain tags and hidden elements."""
    for i in range(2, len(page.tag)):
        if page.alive[i] and page.tag[i] != "#":
            d = page.data[i]
            if page.tag[i] in CLEANED or "hidden" in d or "display:none" in d.get("style", "").replace(" ", "").lower():
                page.remove(i)


def css_path(page: Page, i: int) -> str:
    parts = []
    for k in [i, *page.ancestors(i)]:
        if page.tag[k] == "#root":
            continue
        own, classes = page.attr(k, "id"), page.classes(k)
        parts.append(page.tag[k] + (f"#{own}" if own else "." + ".".join(classes) if classes else ""))
    return " > ".join(reversed(parts))


def label(page: Page, i: int) -> str:
    own, classes = page.attr(i, "id"), page.classes(i)
    return page.tag[i] + (f"#{own}" if own else f".{classes[0]}" if classes else "")


def measure(page: Page) -> list[list[int]]:
    """Of every node: characters, characters of text directly in links, real paragraphs, punctuation marks; with all below."""
    total = [[0, 0, 0, 0] for _ in page.tag]
    for i in range(len(page.tag) - 1, 0, -1):
        if not page.alive[i]:
            continue
        own, up = total[i], page.parent[i]
        if page.tag[i] == "#":
            text = clean(page.data[i])
            if not text:
                continue
            n = len(text)
            own = [n, n if page.tag[up] == "a" else 0, 0, len(PUNCTUATION.findall(text))]
        elif page.tag[i] == "p" and own[0] >= 25 and own[3] >= 1:
            own[2] += 1
        if up >= 0:
            above = total[up]
            for k in range(4):
                above[k] += own[k]
    return total


def score(stats: list[int]) -> float:
    chars, linked, paragraphs, marks = stats
    return (chars - linked) * (1 - linked / max(chars, 1)) ** ALPHA + BETA * paragraphs + GAMMA * marks


def weight(page: Page, i: int) -> float:
    names = " ".join(page.classes(i)) + " " + page.attr(i, "id")
    return 1.3 if BONUS.search(names) else 0.3 if PENALTY.search(names) else 1.0


def char_count(page: Page, i: int) -> int:
    return sum(len(clean(page.data[k])) for k in range(i + 1, page.end[i]) if page.alive[k] and page.tag[k] == "#" and page.tag[page.parent[k]] not in ("script", "style", "noscript", "template"))


def fingerprint(text: str) -> str:
    return hashlib.sha1(re.sub(r"\d+", "0", clean(text).lower()).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def leaf_blocks(page: Page):
    """(node, text) of block elements without block elements below, with a text of two characters or more."""
    above: set[int] = set()  # nodes with a block somewhere below
    blocks = []
    for i in range(len(page.tag) - 1, 0, -1):
        if not page.alive[i]:
            continue
        block = page.tag[i] in LEAF_BLOCKS
        if block and i not in above:
            blocks.append(i)
        if block or i in above:
            above.add(page.parent[i])
    for i in reversed(blocks):
        if page.tag[i] != "#":
            text = clean(page.text(i))
            if len(text) >= 2:
                yield i, text


def page_fingerprints(page: Page) -> list[str]:
    return list(dict.fromkeys(fingerprint(t) for _, t in leaf_blocks(page)))


def remove_template(page: Page, known: frozenset[str]) -> int:
    gone = [i for i, t in leaf_blocks(page) if fingerprint(t) in known] if known else []
    for i in gone:
        page.remove(i)
    return len(gone)


def find_block(page: Page, known: frozenset[str] = frozenset(), selector: str | None = None, trace: dict | None = None) -> tuple[int, float, str]:
    """(node, score, method) of the content block: clean, remove the template, then descend while one child holds most of the score."""
    trace = {} if trace is None else trace
    tidy(page)
    body = page.body
    trace["after_clean"] = char_count(page, body)
    trace["template_blocks"] = remove_template(page, known)
    trace["after_template"] = char_count(page, body)
    trace["steps"] = steps = []
    if selector:
        named = next((i for i in page.inside(0) if selector.lstrip(".") in page.classes(i)), None)
        if named is not None and page.text(named, "", True):
            return named, 0.0, "selector"
    stats = measure(page)
    if not stats[body][0]:
        return body, 0.0, "fallback"
    node = body
    while options := [c for c in page.children(node) if page.tag[c] in CANDIDATES]:
        valued = [(score(stats[c]) * weight(page, c), c) for c in options]
        best, winner = max(valued, key=lambda x: x[0])
        stop = best < DELTA * score(stats[node])
        ranked = sorted(valued, key=lambda x: -x[0])[:6]
        steps.append(
            {"parent": label(page, node), "parent_score": round(score(stats[node]), 1), "threshold": round(DELTA * score(stats[node]), 1), "stop": stop, "rest": max(0, len(options) - 6),
             "candidates": [{"label": label(page, c), "chars": stats[c][0], "link_chars": stats[c][1], "paragraphs": stats[c][2], "weight": weight(page, c), "score": round(v, 1), "winner": c == winner} for v, c in ranked]}
        )
        if stop:
            break
        node = winner
    return node, score(stats[node]), "heuristic"


# ---------------------------------------------------------------- fields


def json_ld(page: Page) -> list[dict]:
    """Objects of all JSON-LD scripts; lists and graphs are taken from their ends."""
    found = []
    for i in page.inside(0):
        if page.tag[i] != "script" or page.attr(i, "type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(page.data[k] for k in range(i + 1, page.end[i])))
        except ValueError:
            continue
        todo = list(data) if isinstance(data, list) else [data]
        while todo:
            d = todo.pop()
            if isinstance(d, dict):
                found.append(d)
                if isinstance(d.get("@graph"), list):
                    todo += d["@graph"]
    return found


def from_ld(ld: list[dict], key: str):
    return next((d[key] for d in ld if d.get(key)), None)


def microdata(page: Page, name: str) -> str:
    i = page.by_attr(0, "itemprop", name)
    return "" if i is None else clean(page.attr(i, "content") or page.text(i, " ", True))


def meta(page: Page, attr: str, value: str) -> str:
    i = next((k for k in page.inside(0) if page.tag[k] == "meta" and page.data[k].get(attr) == value), None)
    return "" if i is None else clean(page.attr(i, "content"))


def cut_suffix(title: str) -> str:
    """A title without the name of its site: what follows the last separator, if it is short and enough is left."""
    for sep in (" | ", " - ", " – ", " — "):
        front, found, back = title.rpartition(sep)
        if found and len(back) <= 40 and len(front) >= 10:
            return front.strip()
    return title


def iso_date(y: int, m: int, d: int) -> str:
    from datetime import date

    try:
        return date(y, m, d).isoformat()
    except ValueError:
        return ""


def date_of(text: str) -> str:
    text = text.strip()
    if m := DATE_ISO.match(text):
        return iso_date(int(m[1]), int(m[2]), int(m[3]))
    return iso_date(int(m[3]), int(m[2]), int(m[1])) if (m := DATE_VN.search(text)) else ""


def title_of(page: Page, ld: list[dict], block: int) -> tuple[str, str]:
    headline = from_ld(ld, "headline")
    for value, source in ((microdata(page, "headline"), "headline"), (meta(page, "property", "og:title"), "og:title"), (clean(headline) if isinstance(headline, str) else "", "json-ld")):
        if value:
            return value, source
    near = [block, *page.ancestors(block)][:4]
    h1 = next((h for n in near if (h := page.first(n, "h1")) is not None), None)
    h1 = page.first(0, "h1") if h1 is None else h1
    if h1 is not None and (text := clean(page.text(h1))):
        return text, "h1"
    t = page.first(0, "title")
    if t is not None and (text := clean(page.text(t, ""))):
        return cut_suffix(text), "title"
    return "", ""


def date_published(page: Page, ld: list[dict], block: int) -> tuple[str, str]:
    stated = from_ld(ld, "datePublished")
    for value, source in ((microdata(page, "datePublished"), "datePublished"), (meta(page, "property", "article:published_time"), "article:published_time"), (stated if isinstance(stated, str) else "", "json-ld")):
        if day := date_of(value):
            return day, source
    timed = next((i for i in page.inside(0) if page.tag[i] == "time" and "datetime" in page.data[i]), None)
    if timed is not None and (day := date_of(page.attr(timed, "datetime"))):
        return day, "time"
    named = list(islice((i for i in page.inside(0) if (c := page.data[i].get("class")) and DATED.search(c)), 6))
    whole = clean(page.text(block))
    for text in [*(clean(page.text(i)) for i in named), whole[:300], whole[-200:]]:
        if DATE_VN.search(text) and (day := date_of(text)):
            return day, "regex"
    return "", ""


def author_meta(page: Page, ld: list[dict]) -> tuple[str, str]:
    real = lambda v: bool(v) and v.lower() not in NO_AUTHOR
    i = page.by_attr(0, "itemprop", "author")
    if i is not None:
        named = page.by_attr(i, "itemprop", "name")
        named = i if named is None else named
        if real(v := clean(page.attr(named, "content") or page.text(named, " ", True))):
            return v, "microdata"
    if real(v := meta(page, "name", "author")):
        return v, "meta"
    v = from_ld(ld, "author")
    v = v[0] if isinstance(v, list) and v else v
    v = v.get("name") if isinstance(v, dict) else v
    return (clean(v), "json-ld") if isinstance(v, str) and real(clean(v)) else ("", "")


def cut_credits(page: Page, block: int) -> tuple[tuple[str, str], str]:
    """(author with source, cited source) of the last short lines of the block; the lines are cut out of it."""
    author, cited = ("", ""), ""
    blocks, short = ("p", "div", "li"), ("p", "div", "li", "span", "strong", "em", "b", "i")
    lines = [i for i in page.inside(block) if page.tag[i] in short and not any(page.tag[k] in blocks for k in page.inside(i)) and 2 <= len(clean(page.text(i))) <= 130]
    for i in lines[::-1][:8]:
        if not page.alive[i]:
            continue
        text, top = clean(page.text(i)), i
        while page.tag[top] not in blocks and page.tag[page.parent[top]] in blocks and clean(page.text(page.parent[top])) == text:
            top = page.parent[top]
        if (m := AUTHOR_LINE.search(text)) and not author[0]:
            author = (clean(m[1]), "text-line")
            page.remove(top)
        elif (m := SOURCE_LINE.search(text)) and not cited:
            cited = clean(m[1] or m[2])
            page.remove(top)
    return author, cited


# ---------------------------------------------------------------- links


def join(base: str, link: str) -> str:
    return python_norm(link.strip(), base) or "" if link and link.strip() else ""


def path_in(url: str) -> str:
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "", url).partition("#")[0].partition("?")[0]


def dest_kind(url: str, home: str) -> str:
    """external, document, image or page; the home domain and its subdomains are the family."""
    m = re.match(r"https?://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)(?:\?([^#]*))?", url)
    host, path, query = (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")
    if host != home and not host.endswith("." + home):
        return "external"
    name = path.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return "document" if ext in DOCUMENT_EXT or "download=1" in query else "image" if ext in IMAGE_EXT else "page"


def raw_edges(page: Page, base: str) -> list[tuple[int | None, str, str, str, bool]]:
    """(element, target, type, text, template image?) of links, then images, then og:image; before anything is removed."""
    own, found = join(base, base), []
    for i in page.inside(0):
        if page.tag[i] == "a" and "href" in page.data[i]:
            dst = join(base, page.attr(i, "href"))
            if dst and dst != own:
                img = page.first(i, "img")
                text = clean(page.text(i, " ", True)) or clean(page.attr(i, "title") or page.attr(i, "aria-label")) or (clean(page.attr(img, "alt")) if img is not None else "")
                found.append((i, dst, "href", text, False))
    for i in page.inside(0):
        if page.tag[i] == "img" and (dst := join(base, page.attr(i, "src") or page.attr(i, "data-src"))):
            text = clean(page.attr(i, "alt") or page.attr(i, "title"))
            figure = next((k for k in page.ancestors(i) if page.tag[k] == "figure"), None)
            caption = page.first(figure, "figcaption") if figure is not None and not text else None
            text = text or (clean(page.text(caption, " ", True)) if caption is not None else "")
            small = any((v := page.attr(i, k).strip().rstrip("px")).isdigit() and int(v) <= 16 for k in ("width", "height"))
            found.append((i, dst, "embed", text, small or any(s in path_in(dst) for s in TEMPLATE_FOLDERS)))
    for i in page.inside(0):
        if page.tag[i] == "meta" and page.data[i].get("property") == "og:image" and (dst := join(base, page.attr(i, "content"))):
            found.append((None, dst, "embed", "", False))
    return found


def split_edges(page: Page, edges: list, block: int, home: str) -> tuple[list[dict], list[dict]]:
    """(edges of the content, edges of the template), one for each target, type and text, with counts."""
    sides: tuple[dict, dict] = ({}, {})
    for i, dst, kind, text, template in edges:
        within = i is None or block < i < page.end[block]
        side = sides[0 if within and not template else 1]
        side.setdefault((dst, kind, text), {"dst": dst, "type": kind, "text": text, "dst_kind": dest_kind(dst, home), "count": 0})["count"] += 1
    return list(sides[0].values()), list(sides[1].values())


def clean_html(page: Page, node: int, base: str) -> str:
    """HTML of a node for a preview: kept tags without their attributes but for links and images, other tags unwrapped."""
    out: list[str] = []
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def quoted(k: str, v: str) -> str:
        v = esc(v)
        return f"{k}='{v}'" if '"' in v and "'" not in v else f'{k}="{v.replace(chr(34), "&quot;")}"'

    todo: list[int | str] = [node]  # nodes to write and end tags, the next one last: nesting may be of any depth
    while todo:
        i = todo.pop()
        if isinstance(i, str):
            out.append(i)
            continue
        tag = page.tag[i]
        if tag == "#":
            s = page.data[i]
            out.append(esc(s) if s.strip(" \n\t\f\r") else "\n" if "\n" in s else " ")
            continue
        if tag in DROPPED:
            continue
        shown = tag in KEPT
        if shown:
            opened = f"<{tag}"
            if tag == "img":
                src = join(base, page.attr(i, "src"))
                if not src:
                    continue
                opened += (f" {quoted('alt', page.attr(i, 'alt'))}" if "alt" in page.data[i] else "") + f' loading="lazy" {quoted("src", src)}'
            elif tag == "a":
                href = join(base, page.attr(i, "href"))
                shown = bool(href)
                opened += f' {quoted("href", href)} rel="noopener" target="_blank"'
            if shown:
                out.append(opened + ("/>" if tag in ("br", "img") else ">"))
        if shown and tag not in ("br", "img"):
            todo.append(f"</{tag}>")
        todo += list(page.children(i))[::-1]
    return "".join(out)[:HTML_CAP]


def extract(source: str | None, url: str, known: frozenset[str] = frozenset(), home: str = "", selector: str | None = None, trace: dict | None = None) -> dict | None:
    """All fields of a page; None if it has neither a title nor a text.

    Links, JSON-LD, section and author names are read before anything is removed; then the block is chosen, its credit
    lines are cut, and its text is taken.
    """
    if not source:
        return None
    page = parse(source)
    trace = {} if trace is None else trace
    trace["parsed"] = char_count(page, page.body)
    edges, ld = raw_edges(page, url), json_ld(page)
    section, named = meta(page, "property", "article:section"), author_meta(page, ld)
    node, value, method = find_block(page, known, selector, trace)
    path = css_path(page, node)
    title, title_src = title_of(page, ld, node)
    day, day_src = date_published(page, ld, node)
    line, cited = cut_credits(page, node)
    author, author_src = named if named[0] else line
    text = page.text(node, "\n", True)
    trace["block"] = char_count(page, node)
    if not title and not text:
        return None
    content, nav = split_edges(page, edges, node, home)
    return {
        "title": title[:TITLE_CAP], "title_src": title_src, "published_at": day, "published_at_src": day_src, "author": author, "author_src": author_src, "cited_source": cited,
        "section": section, "text": text[:TEXT_CAP], "html": clean_html(page, node, url), "word_count": len(text.split()), "block_path": path, "block_score": round(value, 2),
        "block_method": method, "content_edges": content, "nav_edges": nav,
    }
