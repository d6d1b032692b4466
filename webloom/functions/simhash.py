"""SimHash of texts by FNV-1a over shingles of three folded words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from webloom.functions.text import fold_python
from webloom.plans.session import materialize

# Parameters of FNV-1a with 64 bits.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
SHINGLE, LEAST = 3, 100
CLOSE = 3


def fnv1a(texts: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of many byte strings at once, one byte position after another."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.full(len(texts), OFFSET, np.uint64)
    if not len(texts):
        return h
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(-sizes, kind="stable")
    left = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), side="right")
    for k, n in enumerate(left):
        rows = order[:n]
        h[rows] = (h[rows] ^ flat[starts[rows] + k].astype(np.uint64)) * np.uint64(PRIME)
    return h


def shingles(text: str) -> list[bytes]:
    """Runs of three words; a run whose first word is empty (before a leading separator) is left out."""
    words = re.split(r"[^a-z0-9]+", fold_python(text).lower())
    while words and not words[-1]:
        words.pop()
    return [" ".join(words[i : i + SHINGLE]).encode() for i in range(len(words) - SHINGLE + 1) if words[i]]


def signature(hashes: np.ndarray) -> int:
    """Bit set where more hashes have it than not; as a signed 64-bit number."""
    ones = ((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0).astype(np.int64)
    bits = np.flatnonzero(2 * ones > len(hashes))
    value = sum(1 << int(b) for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


@F.pandas_udf(LongType())
def simhash(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """simhash(title, body): the signature, 0 for texts of fewer than 100 shingles and for null."""
    for titles, bodies in batches:
        parts = [shingles(f"{t or ''} {b or ''}") for t, b in zip(titles, bodies)]
        parts = [p if len(p) >= LEAST else [] for p in parts]
        hashes = fnv1a([s for p in parts for s in p])
        ends = np.cumsum([len(p) for p in parts])
        yield pd.Series([signature(hashes[e - len(p) : e]) if p else 0 for p, e in zip(parts, ends)], dtype="int64")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def same_article(a: Column, b: Column) -> Column:
    return (a != 0) & (b != 0) & (distance(a, b) <= CLOSE)


#: First bit and width of the blocks a signature is cut into, and how many of them two signatures within CLOSE bits have in common.
BLOCKS, SAME_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)), 3


def near_pairs(df: DataFrame, key: str, sig: str) -> DataFrame:
    """key_a, key_b, bits (key_a < key_b) of all texts within three bits.

    Three bits spoil at most three of six blocks, so two such signatures agree in three: lists are keyed by every choice of three
    blocks, 31 to 33 bits, and hold next to nothing but what is near. Rows with equal signatures form one class: pairs are made
    between classes and lead to their smallest keys; keys of one class are joined to its smallest. 0 and null never match.
    """
    own = materialize(df.select(F.col(key).alias("k"), F.col(sig).alias("s"))).where(F.coalesce("s", F.lit(0)) != 0)
    classes = own.groupBy("s").agg(F.min("k").alias("rep"))
    masks = [sum(((1 << w) - 1) << at for at, w in some) for some in combinations(BLOCKS, SAME_BLOCKS)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("s").bitwiseAND(F.lit(m).cast("bigint")).alias("v")) for i, m in enumerate(signed)]))
    lists = classes.select("rep", "s", table.alias("b"))
    a, b = lists.toDF("ka", "sa", "b"), lists.toDF("kb", "sb", "b")
    pairs = a.join(b, "b").where((F.col("ka") < F.col("kb")) & (distance(F.col("sa"), F.col("sb")) <= CLOSE))
    between = pairs.select(F.col("ka").alias("key_a"), F.col("kb").alias("key_b"), distance(F.col("sa"), F.col("sb")).cast("int").alias("bits")).distinct()
    within = own.join(classes, "s").where("k != rep").select(F.col("rep").alias("key_a"), F.col("k").alias("key_b"), F.lit(0).alias("bits"))
    return between.unionByName(within)
