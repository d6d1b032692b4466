import base64
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import encodings as E

VI = "Trường Đại học tổ chức hội thảo về khoa học dữ liệu dành cho sinh viên năm nhất tại giảng đường chính vào sáng thứ hai tuần tới."
FR = "L'école présente un modèle développé avec des élèves ingénieurs, près de la médiathèque; la procédure a été révisée à l'été."
EN = "The committee’s notice – posted on Monday – explains the “new” rules for students."


@pytest.fixture(scope="module")
def score(spark):
    df = spark.createDataFrame([(VI,), (FR,), (EN,), (None,), ("",)] * 40, "t string")
    return E.model(df, ["t"])


def tcvn3(text):
    back = dict(zip(E.VIETNAMESE, E.TCVN3))
    return "".join(back.get(c, back.get(c.lower(), c)) for c in unicodedata.normalize("NFC", text))


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1258"])
@pytest.mark.parametrize("text", [VI, FR, EN])
def test_utf8_read_in_a_code_page(score, page, text):
    table = {b: c for c, b in E.bytes_of(page).items()}
    garbled = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    restored, causes = E.repair(f"{text}\n{garbled}", score)
    assert causes and restored == f"{text}\n{text}"


def test_twice(score):
    table = {b: c for c, b in E.bytes_of("cp1252").items()}
    read = lambda t: "".join(chr(b) if b < 128 else table[b] for b in t.encode())
    assert E.repair(read(read(VI)), score)[0] == VI


def test_legacy_vietnamese(score):
    lower = VI.lower()
    assert E.repair(tcvn3(lower), score) == (lower, ["tcvn3"])
    decomposed = "".join(c if c in "ăâđêôơưĂÂĐÊÔƠƯ" else unicodedata.normalize("NFD", c) if len(unicodedata.normalize("NFD", c)) == 2 else unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)[0] + next(m for m in unicodedata.normalize("NFD", c)[1:] if m in "̛̂̆")) + next((m for m in unicodedata.normalize("NFD", c)[1:] if m not in "̛̂̆"), "") if len(unicodedata.normalize("NFD", c)) == 3 else c for c in VI)
    as_western = decomposed.encode("cp1258").decode("cp1252")
    restored, causes = E.repair(as_western, score)
    assert causes and restored == VI


@pytest.mark.parametrize("text", [None, "", "plain ascii", VI, FR, EN, unicodedata.normalize("NFD", VI), "Résumé et café naïf", "Der Prüfungsausschuss prüft Anträge", "SÃO LAMBERTO, AÇÃO SOCIAL"])
def test_what_is_no_case(score, text):
    assert E.repair(text, score)[1] == []


def test_lost_characters_and_is_garbled_agree(score):
    for text in (VI, "b�n", FR.encode().decode("cp1252"), "x" * 100_000):
        assert bool(E.repair(text, score)[1]) == E.is_garbled(text, score)


def test_question_marks_for_letters(score):
    ascii_only = VI.encode("ascii", "replace").decode()
    assert E.repair(f"{VI}\n{ascii_only}", score)[1] == ["lost"] and E.repair(ascii_only, score)[1] == ["lost"] and E.is_garbled(ascii_only, score)
    for text in ("Khi nào ạ? (Đổi lịch)", "Why? Because.", "see https://a.b/c?d=e&f=g", '<a href="/x?page=2">é</a>', "Vraiment ?\nOui."):
        assert E.repair(text, score)[1] == [] and not E.is_garbled(text, score)


def test_maximal_segments_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = rng.integers(-3, 4, 12).astype(float)

        def brute(lo, hi):
            best = max(((x[a:b].sum(), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
            if best[0] <= 0:
                return []
            return [*brute(lo, best[2]), best[0], *brute(best[3], hi)]

        assert sorted(s for _, _, s in E.maximal_segments(x)) == sorted(brute(0, 12))


def test_tables(spark, score):
    page = lambda t, enc: base64.b64encode(t.encode(enc)).decode()
    rows = [
        (1, page(VI, "utf-8"), "utf-8"), (2, page(VI, "utf-8"), "ISO-8859-1"), (3, page(VI, "utf-8"), "x-unknown"), (4, page(VI, "utf-8"), None), (5, None, "utf-8"), (6, "", None), (7, "no base64!", ""),
        (8, page(FR, "cp1252"), "windows-1252"), (9, page(FR, "cp1252"), "utf-8"), (10, page("ascii", "ascii"), "ISO-8859-1"), (None, page(VI, "utf-8"), "latin-1"),
    ]
    df = spark.createDataFrame(rows, "rec_id bigint, html_b64 string, encoding string").withColumn("k", F.lit(1)).withColumn("restored", F.lit("x"))
    assert sorted([r["rec_id"] or 0 for r in E.garbled_pages(df, "rec_id", score).collect()]) == [0, 2, 9]
    assert E.garbled_pages(df.limit(0), "rec_id", score).count() == 0
    texts = spark.createDataFrame([(1, VI), (2, VI.encode().decode("latin-1")), (2, VI.encode().decode("latin-1")), (3, None), (4, "")], "file_id bigint, text string").withColumn("t", F.lit("x"))
    out = E.garbled_texts(texts, "file_id", "text", score).collect()
    assert [r["file_id"] for r in out] == [2, 2] and {r["restored"] for r in out} == {VI}
