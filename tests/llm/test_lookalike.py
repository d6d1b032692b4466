import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import lookalike as L


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Кết quả", "Kết quả"), ("phòng А5", "phòng A5"), ("re​mote­ s﻿ens⁠ing", "remote sensing"), ("ｓｅｎｓ，", "sens,"), ("a b　c d", "a b c d"),
        ("ố só̂", "ố số"), ("Ðổi Ɖông", "Đổi Đông"), ("ﬁrst Oﬃce", "first Office"), ("oνεr tοο", "oνεr too"),
        ("Универcитет", "Университет"), ("саса is here", "caca is here"),
    ],
)
def test_forms(text, expected):
    assert L.normalize(text) == expected


@pytest.mark.parametrize(
    "text",
    [None, "", " ", "Университет Лесоград", "α and β, Δt, 47 Ω, kΩ, m², CO₂", "“q” – ’", "\U0001f469‍\U0001f393", "Trường Đại học", "❤️ ok", "שלום‏!"],
)
def test_what_is_no_case(text):
    assert L.normalize(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abаоον​ ̣́̂eêếＡ 1\nБαÐđ"), max_size=30))
def test_normal_form_is_its_own(text):
    once = L.normalize(text)
    assert L.normalize(once) == once


@given(st.text(alphabet="aếé đư", max_size=20))
def test_equal_looking_texts_become_equal(text):
    assert L.normalize(unicodedata.normalize("NFD", text)) == L.normalize(text) == text


def test_plain_texts_are_unchanged_as_the_filter_assumes():
    for code in range(0x20, 0x2800):
        if not L._SUSPECT.search(chr(code)):
            assert L.normalize(f"x{chr(code)}y аб") .startswith(f"x{chr(code)}y"), hex(code)


def test_table(spark):
    rows = [(1, "А", None, "k"), (1, "А", None, "k"), (2, None, "", "f"), (None, "x", "a​b" + "word " * 200_000, None)]
    df = spark.createDataFrame(rows, "row_id bigint, title string, content string, text string")
    df = df.withColumn("field", df.text).withColumn("changed", df.text).withColumn("_key", df.text)
    out = L.normalize_columns(df, "row_id", ["title", "content"]).collect()
    assert len(out) == 8 and sum(r["changed"] for r in out) == 1  # a lone letter stays in a text without Latin ones; repeated rows are kept
    assert L.find_lookalikes(df.limit(0), "row_id", ["title", "content"]).count() == 0


def test_scripts_beyond_greek_and_cyrillic():
    from webloom.llm import lookalike as L

    assert [L.normalize(t) for t in ("օranցe", "Ꭺpple", "ꓐank", "Հայաստան", "ꓡꓲꓢꓴ: ꓐꓯꓽ", "Հայաuտան")] == ["orange", "Apple", "Bank", "Հայաստան", "ꓡꓲꓢꓴ: ꓐꓯꓽ", "Հայաստան"]


def test_forms_are_stable():
    import random

    from webloom.llm import lookalike as L

    rng = random.Random(3)
    letters = "aopcxАрасхоαονօցᎪꓐⲟ жщ"
    for _ in range(3000):
        once = L.normalize("".join(rng.choice(letters) for _ in range(rng.randint(1, 25))))
        assert L.normalize(once) == once
