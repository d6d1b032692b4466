import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.llm import spam as S

PROSE = "The committee met on Monday and decided to publish the new rules. Students who miss the deadline should write to the office before the end of May. A short report about the river project will follow in autumn, and two teachers explained the main results."
LIST = "Timetable\nMon 9:00 | hydraulics | room A5\nTue 10:30 | data science | room B4\nWed 11:00 | hydraulics | room C1\nThu 9:00 | wind energy | room A5\nFri 16:00 | data science | room B4\nSat 8:00 | hydraulics | room D7"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(2, 3), st.integers(1, 3))
def test_automaton_covers_what_brute_force_does(seq, least, shortest):
    n, marked = len(seq), [False] * len(seq)
    for i in range(n):
        for j in range(i + shortest, n + 1):
            if sum(seq[a : a + j - i] == seq[i:j] for a in range(n - (j - i) + 1)) >= least:
                marked[i:j] = [True] * (j - i)
    assert S.SuffixAutomaton(seq).covered(least, shortest).tolist() == marked


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.integers(2, 4))
def test_pairs_cover_what_the_automaton_does(seq, least):
    import numpy as np

    a, b = S.covered_by_pairs(np.array(seq), (least, least + 1))
    automaton = S.SuffixAutomaton(seq)
    assert a.tolist() == automaton.covered(least, 2).tolist() and b.tolist() == automaton.covered(least + 1, 2).tolist()


def test_shuffled_keywords_are_stuffed():
    rng = random.Random(3)
    keys = [f"{a}{b}" for a in ("lap", "tick", "tut", "ess", "vis") for b in ("top", "et", "or", "ay", "it")]
    words = []
    for _ in range(12):  # each word twelve times, hardly any pair three times
        rng.shuffle(keys)
        words += keys
    assert S.measure(", ".join(words))["stuffed_share"] == 1.0
    assert 0.3 < S.measure(", ".join(words[:60]) + "\n" + PROSE)["stuffed_share"]


def test_kinds_of_spam():
    rng = random.Random(1)
    keys = ["cheap laptop", "bus ticket", "essay help", "math tutor"]
    ends = ["online", "near me", "best price", "trusted"]
    stuffed = ", ".join(f"{rng.choice(keys)} {rng.choice(ends)}" for _ in range(60))
    lines = "\n".join(f"{rng.choice(keys)} {rng.choice(ends)} {rng.choice(ends)}" for _ in range(50))
    sentences = " ".join(f"{rng.choice(keys)} {rng.choice(ends)} is {rng.choice(keys)} {rng.choice(ends)} and {rng.choice(keys)} {rng.choice(ends)}." for _ in range(30))
    links = "\n".join(f"{rng.choice(keys)} - https://shop{rng.randint(1, 999)}.invalid/{rng.choice(keys).replace(' ', '-')}{i}" for i in range(12))
    anchors = " ".join(f'<a href="http://go{i}.invalid/?q={i}">{rng.choice(keys)}</a>' for i in range(12))
    tags = " ".join(rng.choice([f"#{k.replace(' ', '_')}", f"[{k}]", f"SKU{rng.randint(1000, 99999)}"]) for k in keys * 8)
    for text in (stuffed, lines, sentences, links, anchors, tags, PROSE[:60] + "\n" + stuffed):
        assert S.measure(text)["spam_share"] > 0.5, text[:80]


def test_what_is_no_spam():
    refs = PROSE + "\n" + "\n".join(f"[{i}] Report about the river project part {i}. the School of Energy, {2000 + i}. https://doi.invalid/10.{i}/77{i}" for i in range(4))
    for text in (None, "", "  \n", PROSE, LIST, refs, PROSE + "\nTags: energy, river, school", "word", "?!", "Q: When is the deadline?\nA: On Friday.\nQ: Where is the room?\nA: Next to the library."):
        assert S.measure(text)["spam_share"] <= 0.5, text


def test_table(spark):
    rows = [(1, "buy now, " * 60), (1, "buy now, " * 60), (2, None), (3, ""), (4, PROSE), (None, "buy now | " * 60), (5, "buy now, " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spam_share", F.lit("x")).withColumn("t", F.lit(1))
    assert sorted(r["doc_id"] or 0 for r in S.find_spam(df, "doc_id").collect()) == [0, 1, 1, 5]
    assert S.measure_pages(df, "doc_id").count() == 7 and S.find_spam(df.limit(0), "doc_id").count() == 0


def test_the_screen_never_hides_a_share():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["12", "mortgage", "cheap"]
    texts = ["", None, "...", "a" * 5, "mortgage " + " mortgage ".join(f"{a}{b}q" for a in "abcdefghij" for b in "klmnopqrst")]
    for _ in range(300):
        words = rng.choices(vocabulary, [1] * 42 + [rng.randint(1, 60)], k=rng.randint(1, 120))
        texts.append("".join(w + rng.choice([" "] * 9 + [". ", "\n", ", ", " #t "]) for w in words))
    assert list(S.measured(texts)) == [S.measure(t) for t in texts]
    assert S.measure(texts[4])["spam_share"] == 1.0


def test_long_pages_are_measured_by_pairs(monkeypatch):
    text = "buy cheap shoes here now " * 60 + "A quiet sentence about the river. " * 2
    one = S.measure(text)
    monkeypatch.setattr(S, "AUTOMATON_WORDS", 10)
    assert S.measure(text) == one and one["stuffed_share"] > 0.8


def test_unclosed_links_take_linear_time():
    begun = time.time()
    for text in ("<a href=x>" * 60_000, "[" * 300_000, "<a " * 100_000, "<a href=x>y</a>" * 20_000):
        S.measure(text)
    assert time.time() - begun < 20
