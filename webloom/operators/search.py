"""Ranked full-text search.

A query is parsed to a tree. Only the postings of the tree's own terms are read from the index and gathered per document; over
these rows the tree is compiled to two columns, whether a document matches and what it scores. Document frequencies come
from the dictionary.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions.frames import safe
from webloom.functions.simhash import simhash
from webloom.functions.text import fold_python
from webloom.functions.urls import canonical_order
from webloom.operators.index import Index, chosen, list_documents
from webloom.plans.session import materialize

# Boosts of the fields in the two rankings and of phrases.
ACCENTED = {"title": 3.0, "section": 1.5, "text": 1.0}
FOLDED = {"title_kd": 2.0, "text_kd": 0.7}
PLAIN = {"title_kd": 1.0, "text_kd": 1.0}
PHRASES = (("title", 0, 4.0), ("text", 2, 2.0), ("title_kd", 0, 2.0))
BIGRAMS = (("title", 2.0), ("text", 0.8), ("title_kd", 1.0))
RELAX = 0.5


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    """A word, a phrase, or a pattern of words, in one field or in those of the ranking.

    kind: word; prefix (word*); wild (with ? and * inside); fuzzy (within edits of the word); range (from words[0] to words[1], open
    where a word is *, its ends belonging to it as bounds say).
    """

    words: tuple[str, ...]
    field: str | None = None
    slop: int = 0
    boost: float = 1.0
    kind: str = "word"
    edits: int = 0
    bounds: str = "[]"

    def singles(self) -> list[Term]:
        """The terms that postings are read for: the words of a phrase, or the pattern itself."""
        if self.kind != "word":
            return [replace(self, field=None, boost=1.0)]
        return [Term((w,)) for w in self.words]

    def meets(self, term: Column) -> Column:
        """Whether a term of the dictionary is meant."""
        w = self.words[0]
        if self.kind == "prefix":
            return term.startswith(w)
        if self.kind == "wild":
            head = re.split("[?*]", w)[0]
            pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in w)
            return term.startswith(head) & term.rlike(f"(?s)^{pattern}$")
        if self.kind == "fuzzy":
            return F.levenshtein(term, F.lit(w)) <= self.edits
        if self.kind == "range":
            low, high = self.words
            ok = F.lit(True)
            if low != "*":
                ok = (term >= low) if self.bounds[0] == "[" else (term > low)
            if high != "*":
                ok = ok & ((term <= high) if self.bounds[1] == "]" else (term < high))
            return ok
        return term == w


@dataclass(frozen=True)
class Clause:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    boost: float = 1.0


LEXEME = re.compile(r'\s*(?:(AND|OR|NOT)\b|(&&|\|\|)|([+!()-])|((?:[A-Za-z_]\w*):)|"([^"]*)"(?:~(\d+))?|([\[{]\s*\S+\s+TO\s+[^\s\]}]+\s*[\]}])|([^\s()":]+))')
RANGE = re.compile(r"([\[{])\s*(\S+)\s+TO\s+([^\s\]}]+)\s*([\]}])")
FUZZY = re.compile(r"^(.+?)~(\d(?:\.\d+)?)?$")


def parse_query(text: str, default_and: bool = True) -> Clause:
    """Tree of a query: AND, OR, NOT, +, -, phrases with slop, fields, groups, boosts, prefixes, wildcards, fuzzy words and ranges.

    Bad syntax raises, and so does a pattern that begins with a wildcard.
    """
    items, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEXEME.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unreadable at {at}: {text[at:]!r}")
        items.append(m)
        at = m.end()
    pos = 0

    def boost() -> float:
        nonlocal pos
        if pos < len(items) and items[pos][8] and items[pos][8].startswith("^"):
            try:
                value = float(items[pos][8][1:])
            except ValueError:
                raise QuerySyntaxError("a boost is a number") from None
            pos += 1
            return value
        return 1.0

    def primary(named: str | None):
        nonlocal pos
        if pos >= len(items):
            raise QuerySyntaxError("the query ends too early")
        m = items[pos]
        pos += 1
        if m[4]:
            return primary(m[4][:-1])
        if m[3] == "(":
            inner = group(named)
            if pos >= len(items) or items[pos][3] != ")":
                raise QuerySyntaxError("a bracket isn't closed")
            pos += 1
            return replace(inner, boost=boost())
        if m[5] is not None:
            words = tuple(w.lower() for w in re.findall(r"\w+", m[5]))
            return Term(words, named, int(m[6] or 0), boost()) if words else Clause()
        if m[7]:
            low, first, last, high = RANGE.fullmatch(m[7]).groups()
            return Term((first.strip('"').lower(), last.strip('"').lower()), named, 0, boost(), "range", bounds=low + high)
        if m[8]:
            raw, power = m[8], 1.0
            if "^" in raw:
                raw, _, p = raw.partition("^")
                try:
                    power = float(p)
                except ValueError:
                    raise QuerySyntaxError("a boost is a number") from None
            if raw[:1] in ("*", "?"):
                raise QuerySyntaxError("a pattern can't begin with a wildcard")
            if fuzzy := FUZZY.match(raw):
                words, edits = re.findall(r"\w+", fuzzy[1]), 2 if fuzzy[2] is None else float(fuzzy[2])
                if not words:
                    return Clause()
                # a share below one is a least similarity, as in the old syntax
                edits = min(2, int(edits) if edits >= 1 else int((1 - edits) * len(words[0])))
                return Term((words[0].lower(),), named, 0, power, "fuzzy", edits)
            if "?" in raw or "*" in raw[:-1]:
                kept = re.sub(r"[^\w?*]", "", raw).lower()
                return Term((kept,), named, 0, power, "wild")
            words = tuple(w.lower() for w in re.findall(r"\w+", raw))
            return Term(words, named, 0, power, "prefix" if raw.endswith("*") else "word") if words else Clause()
        raise QuerySyntaxError(f"unexpected {m[0].strip()!r}")

    def group(named: str | None) -> Clause:
        nonlocal pos
        must, should, must_not, joined = [], [], [], None
        plain = []
        while pos < len(items) and items[pos][3] != ")":
            m = items[pos]
            if m[1] in ("AND", "OR") or m[2]:
                joined = "AND" if (m[1] == "AND" or m[2] == "&&") else "OR"
                pos += 1
                if not plain and not must and not must_not:
                    raise QuerySyntaxError("an operator needs something before it")
                if pos >= len(items):
                    raise QuerySyntaxError("an operator needs something after it")
                continue
            sign = ""
            if m[1] == "NOT" or m[3] in ("+", "-", "!"):
                sign = "+" if m[3] == "+" else "-"
                pos += 1
            node = primary(named)
            if node == Clause():
                continue
            if sign == "-":
                must_not.append(node)
            elif sign == "+":
                must.append(node)
            else:
                if joined == "OR" and plain:
                    plain[-1][1] = "OR"
                plain.append([node, joined if joined else ("AND" if default_and else "OR")])
            joined = None
        for node, how in plain:
            (must if how == "AND" else should).append(node)
        return Clause(tuple(must), tuple(should), tuple(must_not))

    tree = group(None)
    if pos < len(items):
        raise QuerySyntaxError("a bracket too many")
    return tree


def phrase_count(places: list[Column], slop: int) -> Column:
    """How often a phrase stands in a document, by the positions of its words: the first word, and each other one where it belongs,
    within the slop."""
    first, *rest = places

    def near(at: Column, low: Column) -> Column:
        return F.exists(at, lambda q: (q >= low) & (q <= low + 2 * slop))

    def follows(p: Column) -> Column:
        ok = F.lit(True)
        for k, at in enumerate(rest, 1):
            if slop == 0:
                ok = ok & F.array_contains(at, p + k)
            else:
                ok = ok & near(at, F.greatest(p + k - slop, F.lit(0)))
        return ok

    return F.size(F.filter(first, follows))


def idf(n_docs: int, df: int) -> float:
    return 1.0 + math.log((n_docs + 1) / (df + 1))


@dataclass(frozen=True)
class SearchParams:
    """A request. ranking: tfidf or enhanced; dates are YYYY-MM-DD; year is the year that ages are counted from."""

    q: str
    ranking: str = "enhanced"
    host: str | None = None
    kind: str | None = None
    ftype: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    sort: str = "score"
    from_: int = 0
    size: int = 10
    year: int = 2026

    def check(self) -> SearchParams:
        if not self.q or not self.q.strip():
            raise ValueError("q is needed")
        if self.ranking not in ("tfidf", "enhanced") or self.sort not in ("score", "date"):
            raise ValueError("unknown ranking or sort")
        if self.from_ < 0 or not 1 <= self.size <= 50:
            raise ValueError("from is 0 or more, size 1 to 50")
        return self

    @property
    def window(self) -> int:
        return min(1000, max(5 * (self.from_ + self.size), 50))


    @property
    def filters(self) -> bool:
        return bool(self.host or self.kind or self.ftype or self.date_from or self.date_to)


def filtered(docs: DataFrame, p: SearchParams) -> DataFrame:
    """Filters never score; unknown dates (0) fall out of any date range."""
    if p.host:
        docs = docs.where(F.col("host") == p.host)
    if p.kind:
        docs = docs.where(F.col("kind") == p.kind)
    if p.ftype:
        docs = docs.where(F.col("ftype").isin([x.strip().lower() for x in p.ftype.split(",") if x.strip()]))
    if p.date_from or p.date_to:
        low = int(p.date_from.replace("-", "")) if p.date_from else 1
        high = int(p.date_to.replace("-", "")) if p.date_to else 99_999_999
        docs = docs.where(F.col("date_num").between(max(low, 1), high))
    return docs


def words_of(node) -> list[str]:
    """Words of a query, and beginnings of words; patterns have none."""
    if isinstance(node, Term):
        return list(node.words) if node.kind in ("word", "prefix") else []
    return [w for part in (node.must, node.should) for x in part for w in words_of(x)]


def _folded(node):
    if isinstance(node, Term):
        name = {"title": "title_kd", "text": "text_kd"}.get(node.field, node.field)
        return replace(node, words=tuple(fold_python(w) for w in node.words), field=name)
    return Clause(tuple(map(_folded, node.must)), tuple(map(_folded, node.should)), tuple(map(_folded, node.must_not)), node.boost)


def _relaxed(node, share: float):
    """(node, least): of all leaves of a clause at least a share is needed."""
    leaves = [x for x in (*node.must, *node.should)]
    return Clause((), tuple(leaves), node.must_not, node.boost), max(1, -(-int(len(leaves) * share * 1000) // 1000))


class Scorer:
    """Compiles trees over a query's rows (gather): one row a document with the occurrences of each term read.

    Without a plan it only notes the leaves it meets, in seen.
    """

    def __init__(self, fields: set[str], plan: Plan | None = None, n_docs: int = 0, df: dict | None = None):
        self.fields, self.plan, self.n_docs, self.df, self.seen = fields, plan, n_docs, df or {}, []

    def leaf(self, name: str, term: Term, boost: float) -> tuple[Column, Column]:
        if self.plan is None:
            self.seen.append((name, term))
            return F.lit(True), F.lit(0.0)
        parts = [(name, t) for t in term.singles()]
        if len(parts) == 1:
            count = F.coalesce(F.col(f"t{self.plan.at[parts[0]]}"), F.lit(0))
        else:
            count = phrase_count([F.col(f"p{self.plan.at[p]}") for p in parts], term.slop)
        weight = sum(idf(self.n_docs, self.df.get(p, 0)) for p in parts)
        score = F.lit(boost * weight) * F.sqrt(count) / F.sqrt(F.greatest(F.col(f"n_{name}"), F.lit(1)))
        return count > 0, F.when(count > 0, score).otherwise(0.0)

    def term(self, t: Term, boosts: dict[str, float]) -> tuple[Column, Column]:
        names = {t.field: 1.0} if t.field in self.fields else boosts
        parts = [self.leaf(n, t, b * t.boost) for n, b in names.items()]
        return reduce(lambda a, b: a | b, [m for m, _ in parts]), reduce(lambda a, b: a + b, [s for _, s in parts])

    def clause(self, c, boosts: dict[str, float], least: int | None = None) -> tuple[Column, Column]:
        if isinstance(c, Term):
            return self.term(c, boosts)
        must, should, bad = ([self.clause(x, boosts) for x in part] for part in (c.must, c.should, c.must_not))
        match = F.lit(True)
        for m, _ in must:
            match = match & m
        if should and (not must or least is not None):
            hits = reduce(lambda a, b: a + b, [m.cast("int") for m, _ in should])
            match = match & (hits >= (least or 1))
        for m, _ in bad:
            match = match & ~m
        if not must and not should:
            match = F.lit(False)
        score = reduce(lambda a, b: a + b, [s for _, s in (*must, *should)], F.lit(0.0))
        return match, score * c.boost

    def whole(self, tree: Clause, ranking: str, relax: bool) -> tuple[Column, Column]:
        folded = _folded(tree)
        one = lambda t: (_relaxed(t, RELAX) if relax else (t, None))
        if ranking == "tfidf":
            t, least = one(folded)
            return self.clause(t, PLAIN, least)
        (t, least), (f, least_f) = one(tree), one(folded)
        m1, s1 = self.clause(t, ACCENTED, least)
        m2, s2 = self.clause(f, FOLDED, least_f)
        match, score = m1 | m2, F.when(m1, s1).otherwise(0.0) + F.when(m2, s2).otherwise(0.0)
        words = words_of(tree)
        extra = []
        if len(words) >= 2:
            for name, slop, boost in PHRASES:
                own = [fold_python(w) for w in words] if name.endswith("_kd") else words
                extra.append(self.leaf(name, Term(tuple(own), slop=slop), boost)[1])
        if len(words) >= 3:
            for name, boost in BIGRAMS:
                own = [fold_python(w) for w in words] if name.endswith("_kd") else words
                extra += [self.leaf(name, Term((a, b)), boost)[1] for a, b in zip(own, own[1:])]
        return match, reduce(lambda a, b: a + b, extra, score)


class Plan:
    """Which postings a query reads: its single terms by number, and those whose positions a phrase needs."""

    def __init__(self, seen: list[tuple[str, Term]]):
        self.at: dict[tuple[str, Term], int] = {}
        self.placed: set[int] = set()
        for name, term in seen:
            parts = [self.at.setdefault((name, t), len(self.at)) for t in term.singles()]
            self.placed.update(parts if len(parts) > 1 else ())


def gather(index: Index, plan: Plan) -> DataFrame:
    """id, t<i> (occurrences of term i, null if none), p<i> (its positions, for phrases) and n_<field> of every document with any term of
    the plan. Words are read from their buckets alone; patterns test the terms of all buckets.
    """
    own = [(i, name, t, (F.col("field") == name) & t.meets(F.col("term"))) for (name, t), i in plan.at.items()]
    read = reduce(lambda a, b: a | b, [c & (F.col("b") == index.bucket(name, t.words[0])) if t.kind == "word" else c for _, name, t, c in own], F.lit(False))
    columns = [F.sum(F.when(c, F.col("tf"))).alias(f"t{i}") for i, _, _, c in own]
    columns += [F.flatten(F.collect_list(F.when(c, F.col("positions")))).alias(f"p{i}") for i, _, _, c in own if i in plan.placed]
    columns += [F.max(F.when(F.col("field") == f, F.col("size"))).alias(f"n_{f}") for f in dict.fromkeys(name for _, name, _, _ in own)]
    return index.postings.where(read).groupBy("id").agg(*columns)


def frequencies(index: Index, plan: Plan, rows: DataFrame) -> dict[tuple[str, Term], int]:
    """In how many documents each term of a plan stands: words by the dictionary, patterns by the query's rows."""
    words = {(name, t.words[0]): (name, t) for name, t in plan.at if t.kind == "word"}
    found = {}
    if words:
        wanted = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("term").isin([w for g, w in words if g == f]) for f in sorted({f for f, _ in words})])
        found = {words[r["field"], r["term"]]: r["doc_freq"] for r in index.terms.where(wanted).collect()}  # as many rows as the query has words
    patterns = [(key, i) for key, i in plan.at.items() if key[1].kind != "word"]
    if patterns:
        row = rows.agg(*[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for _, i in patterns]).first()
        found |= {key: row[f"d{i}"] for key, i in patterns}
    return found


def matching(index: Index, tree: Clause, boosts: dict[str, float]) -> DataFrame:
    """id of the documents that a tree matches in the fields of boosts."""
    dry = Scorer(set(boosts))
    dry.clause(tree, boosts)
    plan = Plan(dry.seen)
    return gather(index, plan).where(Scorer(set(boosts), plan).clause(tree, boosts)[0]).select("id")


def compiled(index: Index, p: SearchParams) -> Callable[[bool], DataFrame]:
    """found(relax): id, score of the documents within the filters that hold all terms of the query, or at least half of them."""
    p.check()
    tree = parse_query(p.q)
    names = {"title_kd", "text_kd"} if p.ranking == "tfidf" else {"title", "section", "text", "title_kd", "text_kd"}
    dry = Scorer(names)
    dry.whole(tree, p.ranking, False)
    plan = Plan(dry.seen)
    rows = gather(index, plan)
    scorer = Scorer(names, plan, index.size, frequencies(index, plan, rows))
    within = rows.join(filtered(index.docs, p).select("id"), "id", "left_semi") if p.filters else rows

    def found(relax: bool) -> DataFrame:
        match, score = scorer.whole(tree, p.ranking, relax)
        return within.where(match).select("id", score.alias("score"))

    return found


def hits(index: Index, p: SearchParams) -> DataFrame:
    """id, score of the matching documents: all terms first; only if nothing matches within the filters, at least half of them."""
    found = compiled(index, p)
    strict = found(False)
    return found(True) if strict.isEmpty() else strict


SHOWN = ("id", "url", "host", "kind", "ftype", "date", "date_num", "chars")


def ranked(index: Index, p: SearchParams) -> DataFrame:
    """The window of best hits; with the enhanced ranking their score is multiplied by what the document is worth by itself."""
    docs = index.docs.select(*SHOWN)
    if p.sort == "date":
        return hits(index, p).join(docs, "id").orderBy(F.col("date_num").desc(), "url", "id").limit(p.window)
    # only hits as good as the window's last one meet the documents, where URLs break ties
    found, scores, relax = compiled(index, p), [], True
    for relax in (False, True):
        scores = found(relax).select("score").orderBy(F.col("score").desc()).limit(p.window).collect()  # 1000 numbers at most
        if scores:
            break
    best = found(relax).where(F.col("score") >= (scores[-1]["score"] if scores else math.inf))
    top = best.join(docs, "id").orderBy(F.col("score").desc(), "url", "id").limit(p.window)
    if p.ranking == "enhanced":
        top = top.withColumn("score", F.col("score") * T.base_score(F.col("url"), F.col("chars"), F.col("date"), p.year))
    return top.orderBy(F.col("score").desc(), "url", "id")


def merge_duplicates(window: DataFrame, rank: list[str], sig: str = "sig") -> DataFrame:
    """Greedy merge of near-duplicates in rank order over a bounded window (a search's, at most 5000 rows).

    A row within three bits of a kept one is merged into it; the more canonical URL of both represents them, while place, score
    and compared signature stay those of the kept row. duplicates lists the merged URLs.
    """
    shape = "rank int, id bigint, url string, score double, duplicates array<string>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank, kind="stable")
        kept: list[list] = []
        for r in pdf.itertuples():
            s = int(getattr(r, sig) or 0)
            for k in kept:
                if s and k[4] and bin((s ^ k[4]) & 0xFFFFFFFFFFFFFFFF).count("1") <= 3:
                    better = canonical_order(r.url) < canonical_order(k[1])
                    k[3].append(k[1] if better else r.url)
                    if better:
                        k[0], k[1] = r.id, r.url
                    break
            else:
                kept.append([r.id, r.url, float(r.score), [], s])
        return pd.DataFrame([(i, *k[:4]) for i, k in enumerate(kept)], columns=["rank", "id", "url", "score", "duplicates"])

    return window.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: run(pdf), shape)


def snippets(rows: DataFrame, q: str, width: int = 160) -> DataFrame:
    """id, snippet: up to three passages around the query's words, marked; accented or folded matching, whichever marks more."""
    wanted = set(words_of(parse_query(q)))
    plain = {fold_python(w) for w in wanted}
    word = re.compile(r"\w+")

    def passages(text: str, exact: bool) -> list[str]:
        spans = [m.span() for m in word.finditer(text) if (m[0].lower() in wanted if exact else fold_python(m[0].lower()) in plain)]
        out, used = [], set()
        windows = sorted(((sum(a <= s < a + width for s, _ in spans), -a) for a in {max(0, s - width // 4) for s, _ in spans}), reverse=True)
        for _, start in windows:
            a, b = -start, min(len(text), -start + width)
            if any(abs(a - u) < width for u in used):
                continue
            used.add(a)
            piece, last = "", a
            for s, e in spans:
                if a <= s and e <= b:
                    piece += text[last:s] + f"<mark>{text[s:e]}</mark>"
                    last = e
            out.append(piece + text[last:b])
            if len(out) == 2:
                break
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for title, text in zip(b["title"], b["text"]):
                parts: list[str] = []
                for t in (title or "", text or ""):
                    if len(parts) < 3:
                        exact, loose = passages(t, True), passages(t, False)
                        parts += exact if sum(x.count("<mark>") for x in exact) >= sum(x.count("<mark>") for x in loose) else loose
                made.append(" … ".join(parts[:3]) if parts else (text or "")[:220] + ("…" if len(text or "") > 220 else ""))
            yield pd.DataFrame({"id": b["id"], "snippet": made})

    return rows.select("id", "title", "text").mapInPandas(safe(run), "id bigint, snippet string")


@dataclass(frozen=True)
class Result:
    """total: hits, less the duplicates seen in the window (an upper bound beyond it). page: rank, id, url, score, duplicates."""

    total: int
    page: DataFrame


def paged(index: Index, window: DataFrame, order: list[Column], total: int, from_: int, size: int) -> Result:
    """A page of a window of at most 5000 rows (id, url, score), near-duplicates merged; a window's texts alone get signatures."""
    window = materialize(window.select("id", "url", "score", F.row_number().over(Window.orderBy(*order)).alias("place")))
    ids = [r["id"] for r in window.select("id").collect()]
    sigs = index.docs.where(F.col("id").isin(ids)).select("id", simhash(F.col("title"), F.col("text")).alias("sig")) if ids else None
    signed = window.join(sigs, "id", "left") if ids else window.withColumn("sig", F.lit(0).cast("bigint"))
    merged = materialize(merge_duplicates(signed, ["place"]))
    kept = merged.count()
    return Result(max(total - (len(ids) - kept), kept), merged.where((F.col("rank") >= from_) & (F.col("rank") < from_ + size)))


def search(index: Index, p: SearchParams) -> Result:
    """A page of results with near-duplicates merged and snippets: rank, id, url, score, duplicates, snippet."""
    window = ranked(index, p)
    order = [F.col("date_num").desc(), F.col("url"), F.col("id")] if p.sort == "date" else [F.col("score").desc(), F.col("url"), F.col("id")]
    # without filters all hits are counted; date and score order see the same ones
    found = paged(index, window, order, hits(index, p).count(), p.from_, p.size)
    ids = [r["id"] for r in found.page.select("id").collect()]  # 50 at most
    shown = index.docs.where(F.col("id").isin(ids)) if ids else index.docs.limit(0)
    return Result(found.total, found.page.join(snippets(shown, p.q), "id", "left").select("rank", "id", "url", "score", "duplicates", "snippet"))


def list_page(index: Index, host: str | None = None, kind: str | None = None, by_url: bool = False, from_: int = 0, size: int = 100) -> Result:
    """A page of all documents, newest first or by URL, near-duplicates merged; total counts them before merging."""
    window = list_documents(index, host, kind, by_url, from_, size).withColumn("score", F.lit(0.0))
    order = [F.col("url"), F.col("id")] if by_url else [F.col("date_num").desc(), F.col("url"), F.col("id")]
    found = paged(index, window, order, 0, from_, size)
    return Result(chosen(index, host, kind).count(), found.page)
