from argentum.llm import packing
from argentum.llm.queries import queries


def held(found):
    out = {}
    for times, content in found:
        for s, k in content.items():
            out[s] = out.get(s, 0) + times * k
    return out


def test_many_small_documents_fill_a_container():
    assert packing.fillings(1900, {1: 5000})[0] == [(1,) * 1900]
    counts = {1: 5000, 3: 4000, 700: 9, 1500: 4}
    found, ended = packing.pack(counts, 2048)
    assert ended == "bound" and held(found) == counts
    assert sum(k for k, _ in found) == -(-sum(s * n for s, n in counts.items()) // 2048)


def test_search_tells_how_it_ended():
    # No two of these fit together, so best fit can't be improved and nothing is left out.
    assert packing.pack({60: 5}, 100) == ([(5, {60: 1})], "exhausted")
    assert packing.pack({}, 100) == ([], "bound")
    hard = {s: 3 for s in range(26, 50)}
    found, ended = packing.pack(hard, 100, nodes=3)
    assert held(found) == hard and ended in ("nodes", "bound")


def test_every_document_is_placed(spark):
    texts = [None, "", "a", "one two three " * 50] + [f"note {i}" for i in range(100)]
    documents = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    limits = spark.createDataFrame([("small", "pack", 64, 0), ("other", "split", 8, 2)], "limit_name string, purpose string, capacity_tokens int, overlap_tokens int")
    rows = packing.fill_all(documents, limits).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    full = {}
    for r in rows:
        if r["container"] is not None:
            full[r["container"]] = full.get(r["container"], 0) + r["tokens"]
    told = packing.use(documents, limits).collect()[0]
    assert max(full.values()) <= 64 and told["containers"] == len(full) and told["tokens"] == sum(full.values()) and told["least"] <= len(full)
    assert {"p6_filled", "p6_use"} <= set(queries())
