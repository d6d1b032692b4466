"""Near-duplicate records with small edits (problem 5).

Every text becomes the set of its word shingles under one hash function; rows with equal sets form a class with one
representative. The bottom-k sketch of a set holds its k smallest hashes. Inverted lists are kept for short runs of
neighbouring retained values: two sets share such a run wherever neighbours in the sketch of their union lie in both, so
the lists of runs are nearly as complete as those of single values but far shorter. Lists carry a fingerprint of each set,
so that most pairs fall where they are made; lists of very many sets are joined block by block. Pairs from the lists pass a
filter by the similarity estimated from the sketch of their union; exact Jaccard similarity over the whole sets verifies
what is left.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from webloom.functions.frames import safe
from webloom.plans.session import materialize, spread

WORD = re.compile(r"[^\W_]+")
#: Size of a sketch, and bytes kept of a retained value (its leading ones).
K, BYTES = 80, 5
#: Chance of a miss, at the threshold, that the choice of keys may have where neighbours in the sketch of a union are independent.
MISS = 0.0005
#: Sets of so many shingles or fewer lie in their sketch whole and have shorter runs.
SMALL = 40
#: Members of a list from which it is joined block by block, and keyed rows that a task of the join holds.
BLOCK, ROWS_A_TASK = 2000, 400_000
#: Bits of the fingerprint of a set: one for each bin of its hashes, from the smallest in the bin.
BITS = 128
#: Standard deviations that the filters by estimated similarity leave as a margin: the sketch of the union, and the fingerprint.
MARGIN, PRINT_MARGIN = 4.5, 3.8
#: Lists of runs of three or more that two sets must share; shorter runs count double.
SHARED = 2


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        made = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return made


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of so many consecutive words (runs of letters and digits, in lower case)."""
    tokens = WORD.findall(text.lower()) if text else []
    if len(tokens) < words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    total = np.zeros(len(h) - words + 1, np.uint64)
    for i in range(words):
        total = mix(total + h[i : len(h) - words + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(total)


def pack_sketch(s: np.ndarray) -> bytes:
    """The leading bytes of the smallest K values, in their order."""
    return s[:K].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpack_sketch(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // BYTES, 8), np.uint8)
    wide[:, 8 - BYTES :] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return wide.view(">u8").ravel().astype(np.uint64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """One bit of the smallest hash in each bin; bins without any hash give 0."""
    m = np.sort(mix(s + np.uint64(0x51ED270B)))
    bins, first = np.unique(m >> np.uint64(57), return_index=True)
    bits = np.zeros(BITS, np.uint8)
    bits[bins.astype(np.int64)] = (m[first] & np.uint64(1)).astype(np.uint8)
    a, b = np.packbits(bits).view(">i8")
    return int(a), int(b)


def _sketches(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """id, n, set_hash, f1, f2, sketch of every row with at least one shingle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["t"]):
                s = shingle_set(t, words, cache)
                if len(s):
                    out.append((i, len(s), xxh3_64_intdigest(s.tobytes()) - (1 << 63), *fingerprint(s), pack_sketch(s)))
            yield pd.DataFrame(out, columns=["id", "n", "set_hash", "f1", "f2", "sketch"])

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull() & (F.length("t") > 0))
    return spread(rows).mapInPandas(safe(run), "id bigint, n bigint, set_hash bigint, f1 bigint, f2 bigint, sketch binary")


def miss_chance(p: float, run: int, kept: float, size: int = K) -> float:
    """Chance that of so many independent neighbours, each shared with probability p, too few runs are shared whose keys are kept."""
    needed = SHARED if run > SHARED else 1
    state = np.zeros((needed, run + 1))  # chance by what was found and the length of the shared stretch so far
    state[0, 0] = 1.0
    for _ in range(size):
        new = np.zeros_like(state)
        new[:, 0] = state.sum(axis=1) * (1 - p)
        new[:, 1:] = state[:, :-1] * p
        new[:, run] += state[:, run] * p
        hit = new[:, run] * kept
        new[:, run] -= hit
        new[1:, run] += hit[:-1]
        state = new
    return float(state.sum())


@lru_cache(maxsize=64)
def key_groups(threshold: float) -> tuple[tuple[int, float, float, float], ...]:
    """(length of the runs, share of their keys that is kept, least and greatest set they are for): the longest runs and the smallest share
    that keep the chance of a miss below MISS. Below 0.5 single values are keys, so that sets in their sketches whole are
    never missed."""
    long, share = next(((r, s) for r, s in ((3, 0.5), (3, 1.0), (2, 0.5), (2, 1.0), (1, 0.5)) if miss_chance(threshold, r, s) < MISS), (1, 1.0))
    # wherever more than half of a union is shared, two neighbours are
    return ((2 if threshold > 0.5 else 1, 1.0, 0, SMALL), (min(long, 2 + (threshold >= 0.7)) if threshold > 0.5 else 1, 1.0, SMALL, K), (long, share, K, math.inf))


def run_keys(s: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Keys of the lists that a set of n shingles with the retained values s stands in; sets that one of another size group may
    resemble are keyed with that group too."""
    own = [np.empty(0, np.uint64)]
    for g, (run, share, least, most) in enumerate(key_groups(threshold)):
        if least * threshold < n <= most / threshold and len(s) >= run:
            x = s[: len(s) - run + 1]
            for j in range(1, run):
                x = mix(x) + s[j : len(s) - run + 1 + j]
            x = mix(x + np.uint64(8 * g + run))
            x = x if share == 1 else x[x < np.uint64(int(share * 2**64))]
            own += [x + np.uint64(copy) for copy in range(1 if run > SHARED else SHARED)]
    return np.concatenate(own).view(np.int64)


def _keys(reps: DataFrame, threshold: float) -> DataFrame:
    """key, id, n, f1, f2: the lists of every sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [run_keys(unpack_sketch(raw), n, threshold) for n, raw in zip(b["n"], b["sketch"])]
            rows = np.repeat(np.arange(len(b)), [len(k) for k in keys])
            yield b[["id", "n", "f1", "f2"]].iloc[rows].assign(key=np.concatenate(keys) if keys else np.empty(0, np.int64))

    return reps.select("id", "n", "f1", "f2", "sketch").mapInPandas(safe(run), "id bigint, n int, f1 bigint, f2 bigint, key bigint")


def _listed_pairs(lists: DataFrame, near: Callable[[str, str], Column], block: int) -> DataFrame:
    """a, b (a < b) of the sets that share lists enough and are near; lists are parted by key already."""
    side = lambda df, x: df.select("key", *[F.col(c).alias(f"{c}{x}") for c in ("id", "n", "f1", "f2")])
    sized = lists.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1")
    short = sized.where(F.col("size") <= block)
    pairs = side(short, "a").join(side(short, "b"), "key").where(F.col("ida") < F.col("idb"))
    pairs = pairs.where(near("a", "b")).select(F.col("ida").alias("a"), F.col("idb").alias("b"))
    # a hot list's members are cut into blocks, and each pair of blocks is a group of its own
    hot = sized.where(F.col("size") > block).withColumn("of", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    left = hot.select("key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("of") - 1)).alias("j"), *[F.col(c).alias(f"{c}a") for c in ("id", "n", "f1", "f2")])
    right = hot.select("key", F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), *[F.col(c).alias(f"{c}b") for c in ("id", "n", "f1", "f2")])
    blocks = left.join(right, ["key", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("ida") < F.col("idb"))).where(near("a", "b"))
    pairs = pairs.unionByName(blocks.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists")).where(F.col("lists") >= SHARED).select("a", "b")


def estimate(a: bytes, b: bytes) -> float:
    """Similarity of two sets estimated from the sketch of their union; exact where both lie in their sketches whole."""
    x, y = unpack_sketch(a), unpack_sketch(b)
    union = np.union1d(x, y)
    if len(x) == K or len(y) == K:
        union = union[:K]
    both = np.intersect1d(x, y)
    return float(np.searchsorted(both, union[-1], side="right") / len(union))


def jaccard(u: np.ndarray, v: np.ndarray) -> float:
    both = len(np.intersect1d(u, v, assume_unique=True))
    return both / (len(u) + len(v) - both)


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links, members).

    links: a, b, similarity for every pair of class representatives (a < b) whose shingle sets reach the threshold.
    members: id, rep for every row with at least one shingle; rows of one class have equal shingle sets, and the class's
    representative is its smallest id. Thresholds lie in (0, 1]. Rows with null ids, null or empty texts or texts of fewer words are in neither.
    Any threshold in (0, 1] will do. Texts are whole. Repeated rows of one id count once. Empty tables give empty results; other columns don't matter.
    """
    rows = materialize(_sketches(df, key, text, words))
    classes = materialize(rows.groupBy("set_hash").agg(F.min("id").alias("rep")))
    members = materialize(rows.select("id", "set_hash").dropDuplicates(["id"]).join(classes, "set_hash").select("id", "rep"))
    others = members.where("id != rep").select("id")
    reps = rows.join(others, "id", "left_anti")

    p = (1 + threshold) / 2
    most = BITS * (1 - p) + PRINT_MARGIN * (BITS * p * (1 - p)) ** 0.5

    def near(x: str, y: str) -> Column:
        n, m = F.col(f"n{x}"), F.col(f"n{y}")
        apart = F.bit_count(F.col(f"f1{x}").bitwiseXOR(F.col(f"f1{y}"))) + F.bit_count(F.col(f"f2{x}").bitwiseXOR(F.col(f"f2{y}")))
        return (n >= threshold * m) & (m >= threshold * n) & (apart <= most)

    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * K // (2 * ROWS_A_TASK)))
    pairs = materialize(_listed_pairs(_keys(reps, threshold).repartition(tasks, "key"), near, BLOCK))

    least = threshold - MARGIN * (threshold * (1 - threshold) / K) ** 0.5

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep = [estimate(u, v) >= least for u, v in zip(x["sa"], x["sb"])]
            yield x.loc[keep, ["a", "b"]]

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = rows.select("id", "sketch").join(wanted, "id", "left_semi")
    candidates = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    candidates = materialize(candidates.mapInPandas(safe(filtered), "a bigint, b bigint").distinct())

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for x in batches:
            x["similarity"] = [jaccard(shingle_set(u, words, cache), shingle_set(v, words, cache)) for u, v in zip(x["ta"], x["tb"])]
            yield x.loc[x["similarity"] >= threshold, ["a", "b", "similarity"]]

    ends = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).join(ends, "id", "left_semi").dropDuplicates(["id"])
    full = candidates.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return full.mapInPandas(safe(verified), "a bigint, b bigint, similarity double"), members


def duplicate_pairs(df: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """a, b for every pair of rows (a < b) whose shingle sets reach the threshold: links and classes written out."""
    links, members = near_duplicates(df, key, text, words, threshold)
    one, two = members.select(F.col("rep").alias("x"), F.col("id").alias("a")), members.select(F.col("rep").alias("y"), F.col("id").alias("b"))
    inside = one.join(two, F.col("x") == F.col("y")).where("a < b").select("a", "b")
    across = links.select(F.col("a").alias("x"), F.col("b").alias("y")).join(one, "x").join(two, "y")
    return inside.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
