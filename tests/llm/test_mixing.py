from argentum.llm import mixing

TARGETS = "source string, target_weight double, max_repeats int"
DOCUMENTS = "doc_id bigint, source string, text string"


def test_shares_and_repeats(spark):
    rows = [(i, "a", f"picture {i} of the harbour " * (i % 7 + 1)) for i in range(300)] + [(1000 + i, "b", f"a note on walk {i}") for i in range(40)]
    rows += [(2000 + i, "b", f"a note  on\r\nwalk {i}") for i in range(40)] + [(3000, "c", "never drawn"), (3001, None, "no source"), (3002, "a", None), (3003, "a", "")]
    documents = spark.createDataFrame(rows, DOCUMENTS)
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 3), ("c", 0.0, 1)], TARGETS)
    drawn = mixing.draw(documents, targets).cache()
    most = {r["source"]: r for r in mixing.shares(drawn, targets).collect()}
    assert abs(most["a"]["share"] - 0.7) < 0.01 and abs(most["b"]["share"] - 0.3) < 0.01 and most["c"]["tokens"] == 0
    assert most["a"]["most"] == 1 and most["b"]["most"] == 3 and most["b"]["texts"] == 40  # other line ends are no other text
    assert drawn.count() == drawn.select("doc_id").distinct().count()


def test_large_enough_for_the_scarcest(spark):
    assert mixing.quotas({"a": 1000, "b": 30, "d": 0}, {"a": 0.5, "b": 0.25, "c": 0.1, "d": 0.1}, {"a": 1, "b": 2, "c": 1, "d": 1}) == {"a": 120.0, "b": 60.0}


def test_empty(spark):
    assert mixing.draw(spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)).count() == 0
