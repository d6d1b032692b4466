"""Flat rows of the article export and the cards of listing pages, read from parsed pages. No Spark here."""

from __future__ import annotations

import re
from datetime import datetime
from urllib.parse import urljoin, urlsplit

from webloom.functions import dom

# Classes of an article's body, lead and old date line, and of a listing's column, cards and notes.
BODY, LEAD, DATE_LINE = "bodytext", "hometext", "h5"
COLUMN, CARD, NOTE = "news_column", "panel-body", "text-muted"
# The author's line, views of a card, dates, attachments.
AUTHOR = "Tác giả:"
VIEWS = re.compile(r"Đã xem:\s*([\d.,]+)")
DAY = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})(?:\D{1,3}(\d{1,2}):(\d{2}))?")
ATTACHED = re.compile(r"\.(pdf|docx?|xlsx?|pptx?|zip)$", re.I)
SUMMARY = 300
#: Columns of the export: the 17 of an article, those of the CSV among them with a card's views.
FIELDS = ("id", "url", "lang", "title", "section", "breadcrumb", "author", "published_at", "modified_at", "summary", "content", "word_count", "thumbnail", "images", "attachments", "crawled_at", "source")
CSV = ("id", "url", "lang", "title", "section", "author", "published_at", "modified_at", "summary", "word_count", "views", "thumbnail", "crawled_at")


def moment(text: str) -> str | None:
    """ISO date and time of day/month/year with an optional time; None if there is none."""
    m = DAY.search(text)
    if not m:
        return None
    d, mo, y, h, mi = (int(x or 0) for x in m.groups())
    try:
        return datetime(y, mo, d, h, mi).isoformat()
    except ValueError:
        return None


def of_class(page: dom.Page, within: int, name: str) -> list[int]:
    return [i for i in page.inside(within) if name in page.classes(i)]


def shown(page: dom.Page, i: int | None) -> str:
    return "" if i is None else dom.clean(page.text(i, " ", True))


def article_id(url: str) -> str:
    m = re.search(r"-(\d+)\.html$", urlsplit(url).path)
    return m[1] if m else url


def article(source: str, url: str, home: str, crawled_at: str | None = None) -> dict:
    """The 17 fields of an article. An author's line is cut out of the body; where there is no lead the body's beginning is the summary."""
    page, base = dom.parse(source), f"https://{home}/"
    bodies = of_class(page, 0, BODY)
    body = bodies[0] if bodies else None
    author = dom.microdata(page, "author")
    for p in [i for i in page.inside(body) if page.tag[i] == "p"] if body is not None else ():
        line = page.text(p, "", True)
        if page.alive[p] and line.startswith(AUTHOR):
            author = author or line[len(AUTHOR) :].strip()
            page.remove(p)
    text = shown(page, body)
    items = [k for i in page.inside(0) if page.attr(i, "itemprop") == "itemListElement" for k in page.inside(i) if page.attr(k, "itemprop") == "name"]
    crumbs = [shown(page, k) for k in dict.fromkeys(items)]
    leads, dated = of_class(page, 0, LEAD), [i for i in of_class(page, 0, DATE_LINE) if page.tag[i] == "span"]
    heading = page.first(0, "h1")
    inside = [] if body is None else list(page.inside(body))
    lead = shown(page, leads[0]) if leads else ""
    return {
        "id": article_id(url), "url": url, "lang": "en" if "/en/" in url else "vi", "title": dom.microdata(page, "headline") or dom.meta(page, "property", "og:title") or shown(page, heading),
        "section": dom.meta(page, "property", "article:section") or (crumbs[-1] if crumbs else None), "breadcrumb": crumbs, "author": author or None,
        "published_at": dom.microdata(page, "datePublished") or (moment(shown(page, dated[0])) if dated else None), "modified_at": dom.microdata(page, "dateModified") or None,
        "summary": lead or (text[:SUMMARY] + "…" if len(text) > SUMMARY else text), "content": text, "word_count": len(text.split()),
        "thumbnail": dom.microdata(page, "image") or dom.meta(page, "property", "og:image") or None,
        "images": [urljoin(base, s) for i in inside if page.tag[i] == "img" and (s := page.attr(i, "src"))],
        "attachments": [urljoin(base, h) for i in inside if page.tag[i] == "a" and ATTACHED.search(h := page.attr(i, "href"))],
        "crawled_at": crawled_at, "source": home,
    }


def cards(source: str, base: str) -> list[dict]:
    """url, title, date, views, thumbnail of a listing's cards, each URL once; items of lists where a page has no cards."""
    page = dom.parse(source)
    boxes = [c for column in of_class(page, 0, COLUMN) for c in of_class(page, column, CARD)]
    boxes = list(dict.fromkeys(boxes)) or [i for i in page.inside(0) if page.tag[i] == "li"]
    found: dict[str, dict] = {}
    for box in boxes:
        links = [i for i in page.inside(box) if page.tag[i] == "a" and page.attr(i, "href")]
        headed = [i for i in links if any(page.tag[k] == "h2" for k in page.ancestors(i) if k > box)]
        named = headed or [i for i in links if page.attr(i, "href").endswith(".html")] or (links if page.tag[box] == "li" else [])
        if not named:
            continue
        url = dom.join(base, page.attr(named[0], "href"))
        notes = " ".join(shown(page, i) for i in of_class(page, box, NOTE)) or (shown(page, box) if page.tag[box] == "li" else "")
        views, img = VIEWS.search(notes), page.first(box, "img")
        src = page.attr(img, "src") if img is not None else ""
        if url and url not in found:
            found[url] = {
                "url": url, "title": page.attr(named[0], "title") or shown(page, named[0]), "date": moment(notes), "views": int(re.sub(r"\D", "", views[1]) or 0) if views else None,
                "thumbnail": urljoin(base, src) if src else None,
            }
    return list(found.values())
