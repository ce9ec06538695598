from argentum.llm import truncation

SIDECAR = "sidecar_id bigint, source_id string, title string, sidecar_name string"
MEDIA = "media_id bigint, source_id string, file_name string"
WORDS = ["harbour", "lantern", "museum", "kitten", "valley", "gallery", "windmill", "concert", "campfire", "riverbank"]


def flagged(spark, files, titles=()):
    media = spark.createDataFrame([(i, "s", f) for i, f in enumerate(files)], MEDIA)
    sidecar = spark.createDataFrame([(10_000 + i, "s", t, None) for i, t in enumerate(titles)], SIDECAR)
    names = dict(enumerate(files)) | {10_000 + i: t for i, t in enumerate(titles)}
    return {names[r["rec_id"]] for r in truncation.truncated(sidecar, media).filter("cut").collect()}


def complete(times):
    """Names of all lengths that end in each word."""
    return [f"{'a' * (k * 5 % 31 + 1)} {i} {w}.jpg" for i, w in enumerate(WORDS) for k in range(times)]


def test_each_value_for_itself(spark):
    # Most values without extension have an unknown end; the one whose end is known stays complete.
    torn = ["summer harb", "one two lante", "trip to the muse", "x kitt", "our long way to the vall"]
    assert flagged(spark, [*complete(8), *torn, "my harbour"]) == set(torn)


def test_more_data_make_no_torn_end_known(spark):
    # With ten times the data a torn end has more than KNOWN kept extensions, but as many values without.
    seldom = [f"{'b' * k} harb.jpg" for k in range(1, 40, 7)]
    torn = [f"{'c' * k} harb" for k in range(2, 60, 9)]
    assert set(torn) <= flagged(spark, [*complete(20), *seldom, *torn])
