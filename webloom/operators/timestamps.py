"""Mixed timestamp formats and zones, as one moment in UTC.

Every value gets the array of its valid interpretations; a shortest path (Viterbi) over each source's records, in the
order they were received, picks one of each array: it pays for every switch of format, for every jump back in time and,
far more, for reading a date against the field order of its site's locale.
A source may hold any share of the rows: its records are cut into ranges, each range is reduced on its own to the costs
between the readings of its first and its last record, the short chain of ranges is solved, and then each range is
traced back between the ends it was given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.frames import safe
from webloom.functions.hosts import row_host
from webloom.functions.moments import interpretations
from webloom.plans.session import materialize, spread

#: Cost of a record in another format than the one before.
SWITCH = 1.0
#: Cost of a jump back in time: per natural logarithm of (1 + days back).
BACK = 1.0
DAY = 86_400_000_000
#: Rows that a range has on average, whatever the data's size: what one task holds.
ROWS_A_RANGE = 50_000


def step_cost(fmt_a: str, at_a: int, fmt_b: str, at_b: int) -> float:
    """What it costs to read a record as (fmt_b, at_b) after (fmt_a, at_a)."""
    return SWITCH * (fmt_a != fmt_b) + (BACK * math.log1p((at_a - at_b) / DAY) if at_b < at_a else 0.0)


def _advance(cost: list[float], fmts_a, at_a, fmts_b, at_b, own_b) -> tuple[list[float], list[int]]:
    """Cheapest costs of the next record's readings, and where each comes from; ties take the first."""
    best, back = [], []
    for fb, ub, ob in zip(fmts_b, at_b, own_b):
        options = [c + step_cost(fa, ua, fb, ub) + ob for c, fa, ua in zip(cost, fmts_a, at_a)]
        k = min(range(len(options)), key=options.__getitem__)
        best.append(options[k])
        back.append(k)
    return best, back


def _range_costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a range: the readings of its ends and the cheapest cost from each of the first to each of the last."""
    pdf = pdf.sort_values(["received_us", "row_id"], kind="stable")
    fmts, ats, own = pdf["fmts"].tolist(), pdf["ats"].tolist(), pdf["own"].tolist()
    matrix = []
    for start in range(len(fmts[0])):
        cost = [float(own[0][k]) if k == start else math.inf for k in range(len(fmts[0]))]
        for i in range(1, len(fmts)):
            if len(fmts[i - 1]) == 1 and len(fmts[i]) == 1:
                cost = [cost[0] + step_cost(fmts[i - 1][0], ats[i - 1][0], fmts[i][0], ats[i][0]) + own[i][0]]
            else:
                cost, _ = _advance(cost, fmts[i - 1], ats[i - 1], fmts[i], ats[i], own[i])
        matrix.append([float(c) for c in cost])
    return pd.DataFrame(
        {
            "source": [pdf["source"].iloc[0]], "part": [pdf["part"].iloc[0]], "begins_us": [pdf["received_us"].iloc[0]], "begins_id": [pdf["row_id"].iloc[0]],
            "fmts_a": [list(fmts[0])], "ats_a": [[int(x) for x in ats[0]]], "fmts_b": [list(fmts[-1])], "ats_b": [[int(x) for x in ats[-1]]], "costs": [matrix],
        }
    )


def _choose_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each range of a source, the readings its path begins and ends with."""
    pdf = pdf.sort_values(["begins_us", "begins_id"], kind="stable").reset_index(drop=True)
    rows = pdf.to_dict("records")
    trail, cost = [], None
    for r in rows:
        if cost is None:
            at_start, come = [0.0] * len(r["fmts_a"]), [0] * len(r["fmts_a"])
        else:
            p = rows[len(trail) - 1]
            at_start, come = _advance(cost, p["fmts_b"], p["ats_b"], r["fmts_a"], r["ats_a"], [0.0] * len(r["fmts_a"]))
        cost, starts = [], []
        for e in range(len(r["fmts_b"])):
            options = [at_start[s] + r["costs"][s][e] for s in range(len(at_start))]
            k = min(range(len(options)), key=options.__getitem__)
            cost.append(options[k])
            starts.append(k)
        trail.append((come, starts))
    end = min(range(len(cost)), key=cost.__getitem__)
    chosen = []
    for come, starts in reversed(trail):
        start = starts[end]
        chosen.append((start, end))
        end = come[start]
    pdf = pdf[["source", "part"]].copy()
    pdf["first_k"], pdf["last_k"] = [s for s, _ in reversed(chosen)], [e for _, e in reversed(chosen)]
    return pdf


def _trace(pdf: pd.DataFrame) -> pd.DataFrame:
    """The chosen reading of each record of a range, its ends being given."""
    pdf = pdf.sort_values(["received_us", "row_id"], kind="stable")
    fmts, ats, own = pdf["fmts"].tolist(), pdf["ats"].tolist(), pdf["own"].tolist()
    first, last = int(pdf["first_k"].iloc[0]), int(pdf["last_k"].iloc[0])
    cost, backs = [0.0 if k == first else math.inf for k in range(len(fmts[0]))], []
    for i in range(1, len(fmts)):
        cost, back = _advance(cost, fmts[i - 1], ats[i - 1], fmts[i], ats[i], own[i])
        backs.append(back)
    picks = [last] * len(fmts)
    for i in range(len(fmts) - 1, 0, -1):
        picks[i - 1] = backs[i - 1][picks[i]]
    if len(fmts) == 1:
        picks = [first]
    return pd.DataFrame({"row_id": pdf["row_id"], "utc_us": [int(a[k]) for a, k in zip(ats, picks)], "format": [f[k] for f, k in zip(fmts, picks)]})


def readings(corpus: DataFrame, sites: DataFrame) -> DataFrame:
    """source, row_id, received_us and the arrays fmts, ats, own (format, moment, cost) of all valid interpretations; rows without any are left out."""
    clock = sites.select(F.col("host").alias("source"), "tz", "locale").dropDuplicates(["source"])
    rows = corpus.select(
        "row_id", row_host(F.col("host"), F.col("url")).alias("source"), F.coalesce(F.unix_micros("received_at"), F.lit(-(2**62))).alias("received_us"), "published_at"
    ).where(F.length(F.trim("published_at")) > 3)
    rows = rows.join(clock, "source", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [interpretations(v, t or None, lo or None) for v, t, lo in zip(b["published_at"], b["tz"], b["locale"])]
            keep = [bool(f) for f in found]
            out = b.loc[keep, ["source", "row_id", "received_us"]].copy()
            out["fmts"] = [[k for k, _, _ in f] for f in found if f]
            out["ats"] = [[u for _, u, _ in f] for f in found if f]
            out["own"] = [[c for _, _, c in f] for f in found if f]
            yield out

    return spread(rows).mapInPandas(safe(read), "source string, row_id bigint, received_us bigint, fmts array<string>, ats array<bigint>, own array<double>")


def normalize_timestamps(corpus: DataFrame, sites: DataFrame) -> DataFrame:
    """row_id, utc_us, format: one row per corpus row whose published_at names a real moment.

    Null, blank, senseless and impossible values give no row. A row without a usable host belongs to the source '';
    without a known site it has no clock, so only values with a zone name a moment there. Null received_at comes first
    in a source's order; ties are ordered by row_id. Repeated rows are kept; an empty table gives an empty result.
    """
    read = materialize(readings(corpus, sites))  # choosing the ranges looks at it twice
    parts = max(1, -(-read.count() // ROWS_A_RANGE))
    ranged = materialize(read.repartitionByRange(parts, "source", "received_us", "row_id").withColumn("part", F.spark_partition_id()))
    ends = "source string, part int, begins_us bigint, begins_id bigint, fmts_a array<string>, ats_a array<bigint>, fmts_b array<string>, ats_b array<bigint>, costs array<array<double>>"
    solved = ranged.groupBy("source", "part").applyInPandas(_range_costs, ends)
    picked = solved.groupBy("source").applyInPandas(_choose_ends, "source string, part int, first_k int, last_k int")
    return ranged.join(picked, ["source", "part"]).groupBy("source", "part").applyInPandas(_trace, "row_id bigint, utc_us bigint, format string")
