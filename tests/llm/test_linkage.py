from pyspark.sql import functions as F

from argentum.llm import linkage

MEDIA = "media_id bigint, source_id string, dir bigint, text string, num smallint, written bigint, clock bigint, lat double, lon double, content bigint, listed array<bigint>"
SIDECAR = "sidecar_id bigint, source_id string, dir bigint, text string, num smallint, taken bigint, lat double, lon double, path bigint"


def medium(i, source="s", folder=1, name="img 1", time=None, clock=None):
    return (i, source, folder, name, 0, time, clock, None, None, None, [])


def side(i, source="s", folder=1, name="img 1", time=None):
    return (i, source, folder, name, 0, time, None, None, i)


def nodes(spark, media, sidecars):
    t = F.col("text")
    src = F.when(F.col("source_id").isNotNull(), F.xxhash64("source_id"))
    m = spark.createDataFrame(media, MEDIA).withColumns({"src": src, "name": linkage._hash_of(t), "letters": linkage._letters_of(t), "begin": linkage._begin_of(t)})
    names = {x + y: f(t) for x in ("own", "titled") for y, f in (("", linkage._hash_of), ("_letters", linkage._letters_of), ("_begin", linkage._begin_of))}
    return m, spark.createDataFrame(sidecars, SIDECAR).withColumns({"src": src} | names)


def found(spark, media, sidecars, total=None):
    m, s = nodes(spark, media, sidecars)
    return {(r["media_id"], r["sidecar_id"]) for r in linkage.edges(m, s, total or len(sidecars)).collect() if r["score"] >= linkage.ENOUGH}


def test_pair_whose_blocks_are_all_large(spark):
    # The name, the second and the folder of sidecar 0 are those of 20 more each.
    sidecars = [side(0, time=800_000)]
    sidecars += [side(100 + i, folder=500 + i, time=1_000_000 + 9000 * i) for i in range(20)]
    sidecars += [side(200 + i, folder=600 + i, name=f"other {i}", time=800_000) for i in range(20)]
    sidecars += [side(300 + i, folder=1, name=f"third {i}", time=5_000_000 + 9000 * i) for i in range(20)]
    assert (1, 0) in found(spark, [medium(1, time=800_001)], sidecars)


def test_unknown_source_in_another_folder(spark):
    sidecars = [side(0, source="t", folder=7, time=800_000), side(1, source=None, folder=8, name="img 2", time=900_000), *(side(100 + i, name=f"other {i}", time=9000 * i) for i in range(50))]
    assert {(1, 0), (2, 1)} <= found(spark, [medium(1, source=None, time=800_001), medium(2, source="u", name="img 2", time=900_002)], sidecars)


def test_links_between_folders_carry_an_edge(spark):
    # Edges from folder 1 to folder 2 that nothing else decides: the more of them are links, the more the weak one weighs.
    edge = "media_id bigint, sidecar_id bigint, score double, apart boolean, m_dir bigint, s_dir bigint, other_name boolean"
    strong = [(i, 100 + i, 6.0, True, 1, 2, False) for i in range(9)]
    weighed = {r["media_id"]: r["weight"] for r in linkage.propagate(spark.createDataFrame([*strong, (50, 150, 3.6, True, 1, 2, False), (60, 160, 3.6, True, 1, 3, False)], edge)).collect()}
    assert weighed[50] >= linkage.ENOUGH and weighed[60] < linkage.ENOUGH


def test_unknown_number_meets_every_number(spark):
    media = [(7, "s", 1, "img 1", 9, 800_001, None, None, None, None, [])]
    sidecars = [(0, "s", 1, "img 1", None, 800_000, None, None, 0), *(side(100 + i, name=f"other {i}", time=9000 * i) for i in range(50))]
    assert (7, 0) in found(spark, media, sidecars)
