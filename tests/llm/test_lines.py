import collections
import random

from pyspark.sql import functions as F

from webloom.llm import lines as L


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        host = rng.choice(["hot.example"] * 6 + ["b.example", "c.example"])
        own = [f"Paragraph {rng.choice('abcdefgh')} about {rng.choice('xyz')} number {rng.randint(1, 40)} of {rng.randint(1, 5)}." for _ in range(3)]
        shared = [f"Copyright {i}  {host}", "Share  THIS page", "share this page"][: rng.randint(0, 3)]
        rows.append((i, host, f"https://{host}/{i}", "\n".join(rng.sample(own + shared, len(own + shared))) + ("\r\n" if i % 3 else "")))
    return rows


def brute(rows, least_rows=6, share=0.1):
    size, holders, occurrences = collections.Counter(), collections.defaultdict(set), []
    for i, h, _, t in rows:
        if t:
            size[h] += 1
            for no, raw in enumerate(t.split("\n")):
                form = L.canonical(raw)
                if form:
                    holders[h, form].add(i)
                    occurrences.append((i, no, h, form))
    return {(i, no) for i, no, h, f in occurrences if len(holders[h, f]) >= least_rows and len(holders[h, f]) >= round(share * size[h], 6)}


SCHEMA = "row_id bigint, host string, url string, content string"


def test_equals_brute_force(spark):
    rows = corpus(300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r["id"], r["line_no"]) for r in L.repeated_lines(df, "row_id", "content", "host", "url").collect()}
    assert got == brute(rows) and len(got) > 50


def test_joined_leaves_give_the_same(spark, monkeypatch):
    rows = corpus(120, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(L, "HELD", 0)
    assert {(r["id"], r["line_no"]) for r in L.repeated_lines(df, "row_id", "content", "host", "url").collect()} == brute(rows)


def test_partial_trees_of_any_size_merge_to_the_same(spark):
    rows = corpus(120, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    source = L.with_source(df, "row_id", "content", "host", "url")
    whole = {tuple(r) for r in L.grow_trees(source.coalesce(1)).collect()}
    assert whole == {tuple(r) for r in L.grow_trees(source.repartition(7)).collect()}


def test_templates_have_wildcards_and_removal_keeps_the_rest(spark):
    rows = [(i, "h", None, f"Posted by user{i} on the site wall\nText {chr(97 + i % 26)}{i} only here\nfixed tail") for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit(1)).withColumn("id", F.lit(9))
    found = {r["template"]: r["docs"] for r in L.templates(df, "row_id", "content", "host", "url").collect()}
    assert found == {"posted by user0 on the site wall": 12, "fixed tail": 12, "text <*> only here": 12}
    cleaned = {r["row_id"]: r["content"] for r in L.remove_lines(df, "row_id", "content", "host", "url").collect()}
    assert cleaned[3] == "Text d3 only here"


def test_templates_keep_the_tokens_that_enough_lines_hold(spark):
    rows = [(i, "h", None, f"report of {name} by {who}{i % 3 or ''} today") for i, (name, who) in enumerate([("alpha", "ann"), ("beta", "bob")] * 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["template"]: r["docs"] for r in L.templates(df, "row_id", "content", "host", "url").collect()}
    assert found == {"report of alpha by <*> today": 8, "report of beta by <*> today": 8}
    assert L.repeated_lines(df, "row_id", "content", "host", "url").count() == 0
    marks = spark.createDataFrame([(i, "h", None, "a <*> b") for i in range(7)], SCHEMA)
    assert L.repeated_lines(marks, "row_id", "content", "host", "url").count() == 7


def test_edges(spark):
    rows = [(i, None, "https://www.H.example/x", "same\n\n \nsame") for i in range(6)] + [(6, "H.EXAMPLE", "https://h.example/", None), (7, "", None, ""), (None, None, None, "same"), (9, "h.example", None, "word " * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = [(r["id"], r["line_no"]) for r in L.repeated_lines(df, "row_id", "content", "host", "url").collect()]
    assert sorted(out) == [(i, n) for i in range(6) for n in (0, 3)]
    assert L.repeated_lines(df.limit(0), "row_id", "content", "host", "url").count() == 0
    assert L.remove_lines(df, "row_id", "content", "host", "url").count() == len(rows)
