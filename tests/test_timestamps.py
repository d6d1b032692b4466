"""Readings of timestamps against Python, and the chosen path against all paths."""

import itertools
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from webloom.functions.moments import interpretations
from webloom.operators import timestamps as TS

HCM, PARIS, NY = "Asia/Ho_Chi_Minh", "Europe/Paris", "America/New_York"


def us(*fields, tz="UTC", fold=0):
    return int(datetime(*fields, tzinfo=ZoneInfo(tz), fold=fold).astimezone(timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    "value,tz,locale,expected",
    [
        ("03/10/2019", HCM, "vi-VN", us(2019, 10, 3, tz=HCM)), ("03/10/2019", NY, "en-US", us(2019, 3, 10, tz=NY)), ("02.10.25, 07h24", PARIS, "fr-FR", us(2025, 10, 2, 7, 24, tz=PARIS)),
        ("3/12/2023 8:41 AM", NY, "en-US", us(2023, 3, 12, 8, 41, tz=NY)), ("27/3/2024 12:26 SA", HCM, "vi-VN", us(2024, 3, 27, 0, 26, tz=HCM)), ("1/1/2024 12:08 CH", HCM, "vi-VN", us(2024, 1, 1, 12, 8, tz=HCM)),
        ("October 17, 2020 at 8:27 p.m.", NY, "en-US", us(2020, 10, 17, 20, 27, tz=NY)), ("27 décembre 2023 à 00h36", PARIS, "fr-FR", us(2023, 12, 27, 0, 36, tz=PARIS)),
        ("16:57 ngày 14 tháng 4 năm 2024", HCM, "vi-VN", us(2024, 4, 14, 16, 57, tz=HCM)), ("2016年9月20日 16時59分", "Asia/Tokyo", "ja-JP", us(2016, 9, 20, 16, 59, tz="Asia/Tokyo")),
        ("Chủ Nhật, 03/08/2025 - 17:51", HCM, "vi-VN", us(2025, 8, 3, 17, 51, tz=HCM)), ("1720000000", HCM, "vi-VN", 1720000000_000000), ("1720000000123", None, None, 1720000000_123000),
        ("2024-08-20T07:55:29.282992046+07:00", NY, "en-US", us(2024, 8, 20, 0, 55, 29, 282992)), ("2025-07-18 02:02:04 EDT", HCM, "vi-VN", us(2025, 7, 18, 6, 2, 4)), ("2019-01-05 17:02 (GMT+7)", NY, "en-US", us(2019, 1, 5, 10, 2)),
        ("20160913T100519Z", HCM, "vi-VN", us(2016, 9, 13, 10, 5, 19)), ("20250218", HCM, "vi-VN", us(2025, 2, 18, tz=HCM)), ("Wed, 19 Dec 2018 20:09:32 GMT", HCM, "vi-VN", us(2018, 12, 19, 20, 9, 32)),
        # shown twice: the first showing; skipped: the offset before the skip
        ("2023-11-05 01:30", NY, "en-US", us(2023, 11, 5, 5, 30)), ("2023-03-12 02:30", NY, "en-US", us(2023, 3, 12, 7, 30)),
    ],
)
def test_values(value, tz, locale, expected):
    found = interpretations(value, tz, locale)
    assert found and min(found, key=lambda f: f[2])[1] == expected


@pytest.mark.parametrize("value", [None, "", " ", "--", "n/a", "soon", "hôm qua", "0000-00-00", "31/02/2024", "2023-13-40", "2023-02-30 10:00", "10:61 01/01/2020", "x" * 10_000])
def test_no_moment(value):
    assert interpretations(value, HCM, "vi-VN") == ()


def test_orders_of_an_unknown_locale_are_both_read():
    assert {f[0][:3] for f in interpretations("03/04/2020", HCM, None)} == {"dmy", "mdy"}


def rows(n, source="s"):
    return [(i, source, f"https://{source}/{i}", t) for i, t in enumerate(n)]


def brute(values):
    """The cheapest path over all products of readings."""
    readings = [interpretations(v, "UTC", None) for v in values]
    best = min(itertools.product(*readings), key=lambda path: sum(f[2] for f in path) + sum(TS.step_cost(a[0], a[1], b[0], b[1]) for a, b in zip(path, path[1:])))
    return sum(f[2] for f in best) + sum(TS.step_cost(a[0], a[1], b[0], b[1]) for a, b in zip(best, best[1:])), [f[1] for f in best]


def test_path_equals_brute_force(spark):
    values = ["25/01/2020", "03/02/2020", "04/02/2020", "2020-02-05", "06/07/2020", "02/13/2020", "03/04/2020", "05/04/2020"]
    df = spark.createDataFrame([(*r, None) for r in rows(values)], "row_id bigint, host string, url string, published_at string, x int")
    df = df.withColumn("received_at", F.timestamp_micros(F.col("row_id") * 1_000_000))
    sites = spark.createDataFrame([("s", "UTC", None)], "host string, tz string, locale string")
    spark.conf.set("spark.sql.shuffle.partitions", "3")  # the source's records fall into several ranges
    got = [r["utc_us"] for r in TS.normalize_timestamps(df, sites).orderBy("row_id").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    cost, path = brute(values)
    readings = [{f[1]: f for f in interpretations(v, "UTC", None)} for v in values]
    chosen = [r[u] for r, u in zip(readings, got)]
    assert sum(f[2] for f in chosen) + sum(TS.step_cost(a[0], a[1], b[0], b[1]) for a, b in zip(chosen, chosen[1:])) == pytest.approx(cost)
    assert got == path


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    schema = "row_id bigint, host string, url string, published_at string, received_at timestamp, source string, part int, tz string, format string"
    t = datetime(2024, 1, 1)
    data = [
        (1, None, None, None, None, "x", 1, "q", "f"), (2, None, "https://www.S.example/a", "01/02/2024", None, None, None, None, None), (2, "s.example", None, "01/02/2024", t, None, None, None, None),
        (3, "S.EXAMPLE", "https://s.example/", "01/02/2024", t, None, None, None, None), (4, "unknown", None, "2024-01-01T00:00:00Z", t, None, None, None, None), (5, "unknown", None, "2024-01-01", t, None, None, None, None),
    ]
    sites = spark.createDataFrame([("s.example", HCM, "vi-VN", 1), ("s.example", HCM, "vi-VN", 1), (None, None, None, None)], "host string, tz string, locale string, source int")
    out = TS.normalize_timestamps(spark.createDataFrame(data, schema), sites).orderBy("row_id").collect()
    assert [r["row_id"] for r in out] == [2, 2, 3, 4]
    assert {r["utc_us"] for r in out[:3]} == {us(2024, 2, 1, tz=HCM)}
    assert TS.normalize_timestamps(spark.createDataFrame([], schema), sites).count() == 0
