from datetime import datetime

import pytest
from pyspark.sql import functions as F

from argentum import queries
from argentum.operators import changefeed, matching, timestamps
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
QUICK = ("p4_found", "p4_batches", "name_parts", "name_keys", "epoch_parse", "filename_dates", "state_latest", "dedup_canonical", "archive_resume", "run_summary", "unique_outputs", "album_copies", "work_roots", "path_overlap", "mover_stable")


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    ours, theirs, columns = oracle.compare(spark, oracle.connect(FOLDER), name, queries.queries()[name], queries.oracle_sql()[name], FOLDER)
    assert ours == theirs, columns


def test_all_queries_have_sql_but_those_of_timestamps():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"p3_found", "p3_outcomes"}


# media name, its sidecars (name, title) and what comes of it.
CASES = {
    "IMG_0001.jpg": ([("IMG_0001.jpg.json", None)], ("matched", "exact-name", 1200)),
    "IMG_0002(1).jpg": ([("IMG_0002.jpg(1).json", None)], ("matched", "normalized-name", 900)),
    "IMG_0003-edited.jpg": ([("IMG_0003.jpg.json", "IMG_0003.jpg")], ("matched", "normalized-name", 1000)),
    "IMG_0004(1).jpg": ([("IMG_0004.jpg.supplemental-metadata(1).json", "IMG_0004.jpg")], ("matched", "normalized-name", 1300)),
    "IMG_0005.jpg": ([("s.json", "IMG_0005.JPG")], ("matched", "json-title", 1100)),
    "IMG_0006.jpg": ([("a.json", "IMG_0006.jpg"), ("b.json", "IMG_0006.jpg")], ("ambiguous", None, 1100)),
    "IMG_0007.jpg": ([], ("unmatched", None, 0)),
}


def test_ladder(spark):
    media = spark.createDataFrame([(i, "s", str(i), n) for i, n in enumerate(CASES)], "media_id bigint, source_id string, rel_dir string, file_name string")
    rows = [(100 * i + k, "local", "s", str(i), a, b, k) for i, (s, _) in enumerate(CASES.values()) for k, (a, b) in enumerate(s)]
    sidecar = spark.createDataFrame(rows, "sidecar_id bigint, origin string, source_id string, rel_dir string, sidecar_name string, title string, seq bigint")
    found = {r["media_id"]: (r["status"], r["strategy"], r["score"]) for r in matching.best(media, matching.scored(media, sidecar)).collect()}
    assert found == {i: want for i, (_, want) in enumerate(CASES.values())}


def test_feed_is_reopened_and_compacted(spark, tmp_path):
    schema = "zip_fingerprint string, writer string, seq bigint, start_time timestamp, change_op string, status string"
    row = lambda k, seq, op="update", status="success": (k, "w", seq, datetime(2024, 1, 1), op, status)
    batches = [[row("A|1", 1), row("b", 1), row(None, 1), row("", 1)], [row("a|1", 3), row("a|1", 3), row("b", 2, "delete")], [row("a|1", 2), row("b", 0), row("c", 1)]]
    path = f"file://{tmp_path}/feed"
    for rows in batches:
        changefeed.manifest([spark.createDataFrame(rows, schema)], path)
    table = changefeed.ImageTable(spark, F.lower(F.trim("zip_fingerprint")), changefeed.MANIFEST_ORDER, path)
    want = {("a|1", 3, "update"), ("b", 2, "delete"), ("c", 1, "update")}
    got = lambda: {(r["_key"], r["seq"], r["change_op"]) for r in table.last().collect()}
    assert table.version == 3 and got() == want
    table.compact()
    assert got() == want and table.last().count() == 3


def test_wall_clock_times(spark):
    rows = [(1, "s", "2000-10-10 12:00:00"), (2, "l", "1895-04-03 05:06:00"), (3, "g", "03/04/2021 05:06 PM"), (4, "l", "2021-03-28 01:30:00"), (5, "l", "2021-10-31 01:30:00"), (6, "l", None), (7, None, "2021-01-01 00:00:00Z")]
    texts = spark.createDataFrame(rows, "id int, source_id string, text string")
    exports = spark.createDataFrame([("s", "en-US", "America/Boa_Vista"), ("l", "en-GB", "Europe/London"), ("g", "en-GB", "UTC")], "source_id string, export_locale string, home_zone string")
    found = {r["id"]: (r["how"], r["utc_us"]) for r in timestamps.stamp(texts, exports, timestamps.home_spans(exports)).collect()}
    assert found[1] == ("zone", 971190000000000) and found[2][0] == "zone" and found[3][1] == 1617469560000000
    assert found[4][0] == "nonexistent" and found[5][0] == "ambiguous" and found[6][0] == "unreadable" and found[7] == ("offset", 1609459200000000)
