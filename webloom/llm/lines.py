"""Lines repeated across one site's documents (problem 4).

Lines are parsed into templates by trees of fixed depth: host, number of tokens, first tokens. Every partition grows trees of its
own lines; trees are merged leaf by leaf, adding the numbers of documents. A leaf covers every document of each of its lines,
so only leaves that enough documents reach are looked into: there the tokens that enough lines hold at a place are kept,
and all others are wildcard slots. Lines with equal templates are one template, and those that cover enough documents are
repeated. A line that is itself repeated has no slot: it is its own template, which is counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from webloom.functions.frames import safe
from webloom.functions.hosts import row_host
from webloom.plans.session import materialize, spread

#: First tokens of a line that lead to its leaf.
DEPTH = 3
#: A line is repeated if it is found in at least so many rows of its host, and in at least that share of them.
LEAST_ROWS, LEAST_SHARE = 6, 0.1
DIGITS = re.compile(r"\d+")
SLOT = "<*>"
#: A partial tree is sent on when it holds so many leaves, so that a worker's memory stays bounded.
LEAVES_HELD = 200_000
#: So many leaves that reach their threshold are held by every worker; beyond it they are joined.
HELD = 1_000_000


def canonical(line: str) -> str:
    """The form in which lines are compared: trimmed, white space as one blank, lower case, runs of digits as one 0."""
    return DIGITS.sub("0", " ".join(line.split()).lower())


def leaf_of(form: str) -> tuple[int, tuple[str, ...], list[str]]:
    """Number of tokens, tokens that lead to the leaf (those with digits take the wildcard branch), all tokens."""
    tokens = form.split(" ")
    return len(tokens), tuple(SLOT if "0" in t else t for t in tokens[:DEPTH]), tokens


def leaf_id(host: str, length: int, path: tuple[str, ...]) -> int:
    return xxh3_64_intdigest("\x1f".join((host, str(length), *path))) - (1 << 63)


def line_id(host: str, form: str) -> int:
    return xxh3_64_intdigest(f"{host}\x1f{form}") - (1 << 63)


def with_source(df: DataFrame, key: str, text: str, host: str, url: str) -> DataFrame:
    """id, host, t of the rows with text; the host as the project defines it."""
    return spread(df.select(F.col(key).alias("id"), row_host(F.col(host), F.col(url)).alias("host"), F.col(text).alias("t"))).where(F.length("t") > 0)


def grow_trees(rows: DataFrame) -> DataFrame:
    """host, leaf, docs: the leaves of all trees, merged; docs is the number of rows with a line in the leaf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree: dict = {}

        def out() -> pd.DataFrame:
            keys = list(tree)
            frame = pd.DataFrame(
                {"host": [k[0] for k in keys], "leaf": pd.array([leaf_id(*k) for k in keys], "int64"), "docs": pd.array([tree[k][0] for k in keys], "int64")}
            )
            tree.clear()
            return frame

        for b in batches:
            for host, text in zip(b["host"], b["t"]):
                seen = set()
                for form in set(map(canonical, text.split("\n"))):
                    if form:
                        length, path, _ = leaf_of(form)
                        seen.add((host, length, path))
                for k in seen:
                    if k in tree:
                        tree[k][0] += 1
                    else:
                        tree[k] = [1]
            if len(tree) > LEAVES_HELD:
                yield out()
        yield out()

    leaves = rows.select("host", "t").mapInPandas(safe(run), "host string, leaf bigint, docs bigint")
    return leaves.groupBy("host", "leaf").agg(F.sum("docs").alias("docs"))


def thresholds(rows: DataFrame, least_rows: int, least_share: float) -> DataFrame:
    """host, rows, least: how many rows with text each host has, and how many of them a repeated line is found in."""
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("rows")).withColumn("least", F.greatest(F.lit(float(least_rows)), F.round(F.col("rows") * F.lit(least_share), 6)))


def fitted(rows: DataFrame, kind: str, least: DataFrame) -> DataFrame:
    """id, host, line_no, line, template, constants, whole, least of every line in a leaf that enough rows of its host reach: its template,
    how many of its tokens are no slots, and whether all are; line identifies its compared form within the host."""
    # at most 1 / least_share times a row's leaves reach the threshold at a host, however many rows it has
    full = materialize(grow_trees(rows).join(least, "host").where("docs >= least").select("leaf", "least"))

    def explode(leaves: frozenset[int] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, hosts, numbers, found, lines, words = [], [], [], [], [], []
                for i, h, t in zip(b["id"], b["host"], b["t"]):
                    for no, raw in enumerate(t.split("\n")):
                        form = canonical(raw)
                        if not form:
                            continue
                        length, path, tokens = leaf_of(form)
                        leaf = leaf_id(h, length, path)
                        if leaves is None or leaf in leaves:
                            ids.append(i)
                            hosts.append(h)
                            numbers.append(no)
                            found.append(leaf)
                            lines.append(line_id(h, form))
                            words.append(tokens)
                yield pd.DataFrame({"id": ids, "host": hosts, "line_no": pd.array(numbers, "int64"), "leaf": pd.array(found, "int64"), "line": pd.array(lines, "int64"), "tokens": words})

        return run

    shape = f"id {kind}, host string, line_no bigint, leaf bigint, line bigint, tokens array<string>"
    if full.count() <= HELD:
        lines = rows.mapInPandas(safe(explode(frozenset(r[0] for r in full.select("leaf").toLocalIterator()))), shape)
    else:
        lines = rows.mapInPandas(safe(explode(None)), shape).join(full, "leaf", "left_semi")
    lines = materialize(lines)
    # tokens that enough lines of a leaf hold at a place; a repeated line's tokens all do
    placed = lines.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("n"))
    kept = placed.join(full, "leaf").where("n >= least").groupBy("leaf").agg(F.collect_set(F.xxhash64("at", "token")).alias("kept"), F.max("least").alias("least"))
    kept = materialize(kept)
    lines = lines.join(F.broadcast(kept) if kept.count() <= HELD // 10 else kept, "leaf", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<bigint>")))
    constant = F.transform("tokens", lambda t, i: F.array_contains("kept", F.xxhash64(i, t)))
    shown = F.array_join(F.zip_with("tokens", constant, lambda t, c: F.when(c, t).otherwise(F.lit(SLOT))), " ")
    return lines.select("id", "host", "line_no", "line", shown.alias("template"), F.size(F.filter(constant, lambda c: c)).alias("constants"), F.forall(constant, lambda c: c).alias("whole"), "least")


def templates(df: DataFrame, key: str, text: str, host: str, url: str, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, template, docs: the templates that cover enough of their host's rows, with wildcards where their lines differ.

    Templates of slots alone are none. Defined for nulls, empty texts and empty tables as repeated_lines is.
    """
    rows = with_source(df, key, text, host, url)
    lines = fitted(rows, dict(df.dtypes)[key], thresholds(rows, least_rows, least_share)).where("constants > 0")
    return lines.select("host", "template", "id", "least").distinct().groupBy("host", "template").agg(F.count(F.lit(1)).alias("docs"), F.max("least").alias("least")).where("docs >= least").drop("least")


def remove_lines(df: DataFrame, key: str, text: str, host: str, url: str, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """key, text of every row: the text without its repeated lines; null texts stay null, a text of nothing else becomes ''."""
    found = repeated_lines(df, key, text, host, url, least_rows, least_share).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    numbered = F.transform(F.split("t", "\n"), lambda x, i: F.struct(x.alias("x"), i.cast("bigint").alias("i")))
    kept = F.array_join(F.transform(F.filter(numbered, lambda p: ~F.array_contains("gone", p["i"])), lambda p: p["x"]), "\n")
    joined = rows.join(found, rows["k"] == found["id"], "left")
    return joined.select(F.col("k").alias(key), F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias(text))


def repeated_lines(df: DataFrame, key: str, text: str, host: str, url: str, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """id, host, line_no, line: every occurrence of a repeated line; line identifies its compared form within the host.

    Rows with null or empty texts have no lines and don't count for their host's rows; lines that are empty or blank are
    never repeated. Rows without any host form the host ''. A row counts once for a line it holds several times, and each
    of these is an occurrence. Lines and texts may be of any length. Repeated rows count each. Empty tables give an empty
    result.
    """
    rows = with_source(df, key, text, host, url)
    lines = materialize(fitted(rows, dict(df.dtypes)[key], thresholds(rows, least_rows, least_share)).where("whole"))
    counted = lines.select("id", "host", "line", "least").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))
    return lines.join(counted.where("n >= least").select("host", "line"), ["host", "line"], "left_semi").select("id", "host", "line_no", "line")
