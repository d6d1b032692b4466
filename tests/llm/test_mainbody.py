import base64
import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from webloom.llm import encodings
from webloom.llm import mainbody as M

SCORE = np.full((encodings.CLASSES, encodings.CLASSES), -1, np.float32)


def stored(spark, rows):
    """Records of pages given as text."""
    return spark.createDataFrame([(i, u, None if h is None else base64.b64encode(h.encode()).decode(), "utf-8") for i, u, h in rows], "rec_id bigint, url string, html_b64 string, encoding string")


rng = random.Random(2)
WORDS = "alpha beta gamma delta school course teacher student report garden river city winter summer music paper energy water light stone".split()


def sentence():
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 12))).capitalize() + "."


def page(i, layout):
    title, body = f"Story {i} of {rng.choice(WORDS)} and {rng.choice(WORDS)}", [" ".join(sentence() for _ in range(2)) for _ in range(3)]
    menu = "".join(f"<li><a href=/m{k}>Menu {k}</a></li>" for k in range(6))
    related = "".join(f"<li><a href=/r{i}{k}>{sentence()}</a></li>" for k in range(3))
    if layout:
        html = f"<html><head><title>{title} | Site</title></head><body><div class=menu><ul>{menu}</div><div class=main><h1>{title}</h1><span class=date>01/02/2024</span><p>{body[0]}</p><p>{body[1]} <p>{body[2]}</p><figure><figcaption>{sentence()}</figcaption></figure><p class=by><strong>Author: Someone</strong></p><div style='display:none'><p>{sentence()}</p></div></div><div class=side><h3>About us</h3><p>{sentence()}</p></div><div class=foot><p>Address 12{i}, phone 34{i}</p></div><div id=c><p>Reader {i}: {sentence()}</p></div>"
    else:
        html = f"<title>{title}</title><table><tr><td>{menu}<tr><td><b>{title}</b><tr><td>{'<br><br>'.join(body)}<tr><td><h3>More</h3><ul>{related}</ul><p>Address 12{i}, phone 34{i}</p></table>"
    return title, body, html


def test_pages(spark):
    made = [page(i, i % 2) for i in range(80)]
    rows = [(i, f"https://www.h.example/{i}.html", h) for i, (_, _, h) in enumerate(made)] + [(900, "https://h.example/1.html", made[1][2]), (901, "https://h.example/x", None), (902, None, ""), (903, "https://h.example/y", "<p>&lt;")]
    df = stored(spark, rows).withColumn("host", F.lit("clash")).withColumn("k", F.lit(0)).withColumn("pieces", F.lit("x"))
    got = {}
    for r in M.page_main_body(df, "rec_id", "url", SCORE).collect():
        got.setdefault(r["rec_id"], {})[r["piece_no"]] = r["text"]
    right = sum([got[i][k] for k in sorted(got[i])] == [" ".join(b.split()) for b in body] for i, (_, body, _) in enumerate(made))
    assert right >= 78
    assert got[900] == got[1] and 901 not in got and 902 not in got
    assert M.page_main_body(df.limit(0), "rec_id", "url", SCORE).count() == 0
    some = M.page_main_body(df, "rec_id", "url", SCORE, F.col("rec_id") < 10)
    assert {r["rec_id"]: r["piece_no"] for r in some.collect()}.keys() == {i for i in range(10)}
    assert {(r["rec_id"], r["piece_no"], r["text"]) for r in some.collect()} == {(i, n, t) for i in range(10) for n, t in got[i].items()}


def test_both_ways_of_holding_the_trees_agree(spark, monkeypatch):
    rows = [(i, f"https://h{i % 2}.example/{i}.html", page(i, i % 2)[2]) for i in range(60)]
    df = stored(spark, rows)
    a = sorted(map(tuple, M.page_main_body(df, "rec_id", "url", SCORE).collect()))
    monkeypatch.setattr(M, "HELD", 0)
    assert a == sorted(map(tuple, M.page_main_body(df, "rec_id", "url", SCORE).collect()))


def test_branches_are_as_important_as_what_is_below_them():
    leaves = pd.DataFrame({"host": "h", "id": [11, 12, 21], "pages": [30.0, 30.0, 30.0], "bits": [0.5, 1.0, 6.0]})
    edges = pd.DataFrame({"host": "h", "id": [1, 10, 11, 12, 20, 21], "parent": [0, 1, 10, 10, 1, 20]})
    got = {(r.id, r.leaf): r.low for r in M.composed(leaves, edges).itertuples()}
    assert got == {(11, True): True, (12, True): True, (21, True): False, (10, False): True, (20, False): False, (1, False): False}
    tree = M.Tree({}, {"h": {11: True, 21: False}}, {"h": {10: True, 20: False, 1: False}})
    assert tree.unimportant("h", (1, 10, 99)) and not tree.unimportant("h", (1, 20, 99)) and not tree.unimportant("x", (1, 10, 99))
    assert M.composed(leaves.iloc[:0], edges.iloc[:0]).empty


def test_deep_nesting_is_read_in_time():
    begun = time.time()
    pieces, _ = M.parse("<div>" * 20_000 + "text")
    assert len(pieces) == 1 and time.time() - begun < 5


def test_lines(spark, monkeypatch):
    starts = [f"{a} {b} {c}".capitalize() for a in ("the", "a", "each") for b in WORDS[:8] for c in WORDS[:3]]
    told = lambda: f"{rng.choice(starts)} {' '.join(rng.choice(WORDS) for _ in range(15))}."
    rows, truth = [], set()
    for i in range(150):
        lines = ["Home | News | Contact", "This page uses small files, press OK if you agree.", *[f"{told()} {told()}" for _ in range(4)], told(), "Tags: a, b", f"Read by {i} people so far today."]
        truth |= {(i, n) for n in range(2, 7)}
        rows.append((i, "t", "h.example", None, "\n".join(lines)))
    rows += [(900, None, None, None, None), (901, None, None, None, ""), (902, None, None, None, "\n\n"), (903, "Only title.", "x", None, "Only title.")]
    df = spark.createDataFrame(rows, "row_id bigint, title string, host string, url string, content string").withColumn("line_no", F.lit(7)).withColumn("start", F.lit(1))
    get = lambda: {tuple(r) for r in M.text_main_body(df, "row_id", "content", "title", "host", "url").collect()}
    found = get()
    assert found == truth
    monkeypatch.setattr(M, "HELD", 0)
    assert get() == found


def told_rows(n):
    starts = [f"{a} {b} {c}".capitalize() for a in ("the", "a", "each") for b in WORDS[:8] for c in WORDS[:3]]
    told = lambda: f"{rng.choice(starts)} {' '.join(rng.choice(WORDS) for _ in range(15))}."
    return starts, told, [["Home | News | Contact", *[f"{told()} {told()}" for _ in range(4)], f"Read more: {told()[:-1]}", f"{told()} {told()}", f"- {told()[:-1]}", f"Reader {i}: When is it? ({told()[:20]})"] for i in range(n)]


def bodies(spark, rows):
    df = spark.createDataFrame([(i, "t", h, None, "\n".join(x)) for i, (h, x) in enumerate(rows)], "row_id bigint, title string, host string, url string, content string")
    found = {}
    for r in M.text_main_body(df, "row_id", "content", "title", "host", "url").collect():
        found.setdefault(r["row_id"], set()).add(r["line_no"])
    return found


def test_lines_without_end_punctuation(spark, monkeypatch):
    starts, told, rows = told_rows(150)
    p = lambda: f"{told()} {told()}"
    cut = ["Home | News | Contact", p(), f"{starts[5]} {' '.join(WORDS)}", "Umbrellas and old boots for the visit:", "- umbrellas of any kind;", "- boots (old ones)", f"{p()} And so {' '.join(WORDS)}", f"{told()} And so {' '.join(WORDS)}"]
    rows = [("h.example", x) for x in [*rows, cut]]
    got = bodies(spark, rows)
    assert got[150] == {1, 2, 3, 4, 5, 6, 7}
    assert all(got[i] == {1, 2, 3, 4, 6} for i in range(150))  # menus, labels, related items and comments stay out
    monkeypatch.setattr(M, "HELD", 0)
    assert bodies(spark, rows) == got


def test_copies_count_once(spark):
    _, told, rows = told_rows(150)
    odd = lambda w: f"{w} nobody expected {' '.join(WORDS[:12])}. {told()}"
    article = [odd("Zebras"), f"{told()} {told()}", "Quietly the herd left.", f"{told()} {told()}", odd("Yaks")]
    alone = [odd("Walruses")]
    copies = [(f"h{i}.example", ["Menu", *article, "Call us"]) for i in range(4)] + [("h.example", article)] * 8 + [("h.example", alone)] * 8
    got = bodies(spark, [*(("h.example", x) for x in rows), *copies])
    assert all(got[i] == {1, 2, 3, 4, 5} for i in range(150, 154))
    assert all(got[i] == {0, 1, 2, 3, 4} for i in range(154, 162)) and all(got[i] == {0} for i in range(162, 170))


def test_noise_of_one_host_stays_there(spark):
    _, told, rows = told_rows(150)
    p = lambda: f"{told()} {told()}"
    led = [[p(), f"Visitors today only {told()} {told()}", p()] for _ in range(10)]  # a body line between paragraphs
    here = [["Menu", f"Visitors today only {i}. Come again {i}.", *[p() for _ in range(3)]] for i in range(20)]
    got = bodies(spark, [*(("h.example", x) for x in [*rows, *led]), *(("b.example", x) for x in here)])
    assert all(1 in got[150 + i] for i in range(10)) and all(1 not in got[160 + i] for i in range(20))


def test_broken_markup_never_fails():
    for html in ("", "<", "<p", "<div><p>a<div>b</p></div>c", "<script>x", "<!-- x", "</div></div>a", "<td>a<td>b", "<a href='x>y</a>", "<p>" * 3000 + "x", "a\x00b<br>c"):
        pieces, _ = M.parse(html)
        assert all(p[0] for p in pieces)
    assert [p[0] for p in M.parse("<p>a &amp; <b>b</b><br>c</p><ul><li>d<li>e</ul>")[0]] == ["a & b", "c", "d", "e"]
