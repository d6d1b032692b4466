from pyspark.sql import functions as F

from webloom.llm import leakage as L

ITEM = "Suppose a test furnace marked 523 in Grauheim shows the flow rate once the load is halved equal to 569 and works for 12 hours without any pause at all."
OTHER = "Cho bồn chứa hình trụ số 482 gắn hai cảm biến lệch pha có lưu lượng đo ở mép ngoài bằng 287 và đạt cực đại rồi hạ dần."


def brute(docs, items, n=L.WINDOW):
    win = lambda t: {tuple(w[k : k + n]) for w in [[L.fold(x) for x in L.words(t)]] for k in range(len(w) - n + 1)}
    inside = {i: win(t) for i, t in items if t}
    return {(d, i) for d, t in docs if t for i, w in inside.items() if win(t) & w}


def test_equals_brute_force_and_knows_renamed_questions(spark):
    docs = [
        (1, f"Before it. {ITEM.upper()} After."), (2, " ".join(ITEM.split()[3:18])), (3, " ".join(ITEM.split()[3:17])), (4, ITEM.replace("523", "77").replace("569", "1").replace("12", "9")),
        (5, OTHER.lower().replace("ồ", "o").replace("đ", "d") + " x"), (6, None), (7, ""), (8, "filler " * 200_000 + OTHER), (9, ITEM.replace(" ", ",\n  ")), (10, "nothing here"), (1, f"Before it. {ITEM.upper()} After."),
        (11, ITEM.replace("569", "523")),
    ]
    items = [(9001, ITEM), (9002, OTHER), (9003, None), (9004, ""), (9005, "too short"), (9001, ITEM)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("hash", F.lit(1)).withColumn("slots", F.lit("x")).withColumn("item_id", F.lit(5))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("hash", F.lit("q"))
    out = {(r["doc_id"], r["item_id"]): r for r in L.find_leaks(d, i, "doc_id", "item_id").collect()}
    assert {k for k, r in out.items() if r["exact"]} == brute(docs, items)
    renamed = out[4, 9001]
    assert renamed["exact"] == 0 and renamed["renamed"] == renamed["windows"] > 0
    assert L.find_leaks(d.limit(0), i, "doc_id", "item_id").count() == 0 and L.find_leaks(d, i.limit(0), "doc_id", "item_id").count() == 0


def test_without_a_probe_the_result_is_the_same(spark, monkeypatch):
    docs, items = [(1, "x " + ITEM), (2, OTHER)], [(9001, ITEM), (9002, OTHER)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    a = sorted(map(tuple, L.find_leaks(d, i, "doc_id", "item_id").collect()))
    monkeypatch.setattr(L, "PROBE_BOUND", 0)
    assert a == sorted(map(tuple, L.find_leaks(d, i, "doc_id", "item_id").collect()))


def test_names_are_learnt_from_any_number_of_items(spark):
    told = "when the bus came late again {} asked the driver for a new ticket and then {} walked home in the rain"
    few = spark.createDataFrame([(-1, told.format("Anna", "Bela")), (-2, "so we met Clara and Dora there")], "item_id bigint, text string")
    many = spark.range(100_001).select(F.col("id").alias("item_id"), F.lit("filler words").alias("text"))
    docs = spark.createDataFrame([(1, told.format("Clara", "Dora"))], "doc_id bigint, text string")
    a, b = (sorted(map(tuple, L.find_leaks(docs, items, "doc_id", "item_id").collect())) for items in (few, few.unionByName(many)))
    assert a == b and a[0][4] > 0


def test_windows_of_placeholders_agree_word_by_word_only(spark):
    numbers = lambda k: " ".join(str(k + i) for i in range(30))
    docs = spark.createDataFrame([(1, numbers(100)), (2, numbers(500)), (3, "x " + numbers(103))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, numbers(100))], "item_id bigint, text string")
    out = {r["doc_id"]: (r["windows"], r["exact"], r["renamed"]) for r in L.find_leaks(docs, items, "doc_id", "item_id").collect()}
    assert out == {1: (16, 16, 0), 3: (13, 13, 0)}
