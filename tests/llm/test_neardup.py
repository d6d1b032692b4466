import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from webloom.llm import neardup as N


def texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows, out = [], 0
    for size in (3, 5, 9, 14, 25, 40, 80, 150, 400):
        for _ in range(6):
            base = [rng.choice(words) + str(rng.randint(0, 30)) for _ in range(size)]
            for edits in (0, 0, 1, 2, max(1, size // 25), max(1, size // 12)):
                copy = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.choice([0, 1])] = [f"new{rng.randint(0, 9)}"]
                rows.append((out, " ".join(copy)))
                out += 1
    return rows


def brute(rows, words, threshold):
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(words)])) for i, t in rows if t}
    sets = {i: s for i, s in sets.items() if s}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def test_pairs_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "row_id bigint, content string").repartition(4)
    for words, threshold in ((3, 0.7), (5, 0.8)):
        got = [(r["a"], r["b"]) for r in N.duplicate_pairs(df, "row_id", "content", words, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, words, threshold)


def test_low_thresholds_equal_brute_force(spark):
    rows = texts(3)
    df = spark.createDataFrame(rows, "row_id bigint, content string").repartition(4)
    for threshold in (0.6, 0.4):
        got = {(r["a"], r["b"]) for r in N.duplicate_pairs(df, "row_id", "content", 3, threshold).collect()}
        assert got == brute(rows, 3, threshold)


def test_hot_lists_are_joined_in_blocks(spark, monkeypatch):
    rows = texts(4)
    df = spark.createDataFrame(rows, "row_id bigint, content string").repartition(4)
    monkeypatch.setattr(N, "BLOCK", 2)
    assert {(r["a"], r["b"]) for r in N.duplicate_pairs(df, "row_id", "content", 3, 0.7).collect()} == brute(rows, 3, 0.7)


def test_sets_of_neighbouring_sizes_share_keys():
    rng = random.Random(2)
    for small, large in ((39, 50), (55, 78), (79, 100), (90, 120)):
        values = np.array(sorted(rng.sample(range(2**40), large)), np.uint64)
        some = np.array(sorted(rng.sample(list(values), small)), np.uint64)
        a, b = N.run_keys(values[: N.K], large, 0.7), N.run_keys(some[: N.K], small, 0.7)
        assert len(set(a) & set(b)) >= N.SHARED


def test_keys_miss_hardly_any_pair():
    rng = random.Random(1)
    for threshold in (0.8, 0.7, 0.55, 0.3):
        groups = N.key_groups(threshold)
        run, share = groups[2][:2]
        assert N.miss_chance(threshold, run, share) < N.MISS
        trials = [[rng.random() < threshold for _ in range(N.K)] for _ in range(400)]
        needed = N.SHARED if run > N.SHARED else 1
        missed = sum(sum(all(t[i : i + run]) and rng.random() < share for i in range(N.K - run + 1)) < needed for t in trials)
        assert missed <= 3


def test_classes_keep_copies_apart_from_links(spark):
    rows = [(i, "one two three four five six") for i in range(200)] + [(900, "one two three four five six seven"), (901, None), (902, ""), (903, "short"), (None, "one two three four five six")]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("rep", F.lit(1)).withColumn("n", F.lit("x"))
    links, members = N.near_duplicates(df, "id", "t", 3, 0.7)
    assert [(r["a"], r["b"]) for r in links.collect()] == [(0, 900)]
    assert {r["id"]: r["rep"] for r in members.collect()} == {**{i: 0 for i in range(200)}, 900: 900}
    assert N.duplicate_pairs(df.limit(0), "id", "t").count() == 0


def test_sketches():
    cache = N.WordHashes()
    a, b = (N.shingle_set(" ".join(f"x{i}" for i in r), 3, cache) for r in (range(0, 500), range(100, 600)))
    assert abs(N.estimate(N.pack_sketch(a), N.pack_sketch(b)) - N.jaccard(a, b)) < 0.2
    small = N.shingle_set("a b c d e f", 3, cache)
    assert N.estimate(N.pack_sketch(small), N.pack_sketch(small)) == 1.0 and len(N.unpack_sketch(N.pack_sketch(a))) == N.K
