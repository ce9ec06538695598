"""The queries of the core, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.functions import dates, metadata, names, paths
from argentum.operators import changefeed, matching, pairs, records, report, storage, timestamps
from argentum.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]

#: The order of lines in the logs of the test tables.
LOG = ["record_id"]
MANIFEST_LOG = ["received_at", "change_id"]
#: Seconds since 1970 at which queries on suspicious dates take place.
NOW = 1_700_000_000


def _tables(spark: SparkSession, folder: str, *wanted: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in wanted]


# Problems 3 and 4.


def _instants(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.instants(*_tables(spark, folder, "sidecar", "embedded_meta", "suspicious_date", "export_source"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _instants(spark, folder).filter("utc_us is not null").select("rec_id", "utc_us")


def p3_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _instants(spark, folder).groupBy("kind", "how").agg(F.count(F.lit(1)).alias("records"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.entries([table(spark, folder, "manifest_change")]).select("zip_fingerprint", "writer", "seq")


def p4_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The current entries with their state; times as microseconds."""
    micros = {c: F.unix_micros(c) for c in ("start_time", "end_time")}
    return changefeed.entries([table(spark, folder, "manifest_change")]).withColumns(micros)


def p4_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The same from three batches in the order of arrival, so that later ones supersede rows of earlier files."""
    return changefeed.entries(changefeed.by_arrival(table(spark, folder, "manifest_change"), 3)).select("zip_fingerprint", "writer", "seq")


# Names.


def media_classify(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "media").select("media_id", names.kind(F.col("file_name")).alias("kind"))


def media_counts(spark: SparkSession, folder: str) -> DataFrame:
    media, sidecar = _tables(spark, folder, "media", "sidecar")
    a = media.agg(F.count_if(names.kind(F.col("file_name")).isNotNull()).alias("media"))
    b = sidecar.agg(F.count_if(F.lower(names.extension(F.col("sidecar_name"))) == ".json").alias("sidecars"), F.count_if(paths.is_sidecar(F.col("sidecar_name"))).alias("indexable"))
    return a.crossJoin(b)  # one row each


def year_folders(spark: SparkSession, folder: str) -> DataFrame:
    top = paths.top_level(F.col("rel_path"))
    return table(spark, folder, "media").select("media_id", top.alias("top"), paths.is_year_folder(top).alias("is_year"), paths.folder_year(top).alias("year"))


def name_parts(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("file_name")
    return table(spark, folder, "media").select("media_id", names.extension(n).alias("ext"), names.semantic_extension(n).alias("semantic"), names.media_stem(n).alias("stem"))


def _all_names(spark: SparkSession, folder: str) -> DataFrame:
    media, sidecar = _tables(spark, folder, "media", "sidecar")
    return media.select(F.col("file_name").alias("name")).unionByName(sidecar.select(F.col("sidecar_name").alias("name"))).unionByName(sidecar.select(F.col("title").alias("name"))).filter("name is not null").distinct()


def name_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of all names as hexadecimal digits, as a cut may end within a character."""
    return names.with_name_keys(_all_names(spark, folder), "name", "keys").select("name", F.explode("keys").alias("k")).select("name", F.hex(F.col("k").cast("binary")).alias("key"))


def partner_keys(spark: SparkSession, folder: str) -> DataFrame:
    keyed = names.with_name_keys(_all_names(spark, folder), "name", "keys")
    return keyed.select("name", F.explode(names.partner_keys(F.col("keys"))).alias("k")).select("name", F.hex(F.col("k").cast("binary")).alias("key"))


def supplement_names(spark: SparkSession, folder: str) -> DataFrame:
    return names.with_supplement_names(table(spark, folder, "sidecar"), "sidecar_name", "means").select("sidecar_id", F.explode("means").alias("media_name"))


def shared_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes that a sidecar's title and own name share."""
    rows = table(spark, folder, "sidecar").filter("title is not null and sidecar_name is not null")
    return rows.select("sidecar_id", names.common_prefix(F.col("title"), F.col("sidecar_name")).cast("bigint").alias("bytes"))


# Matching.


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return matching.scored(*_tables(spark, folder, "media", "sidecar"))


def match_scored(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder)


def _tier(score: str) -> Query:
    return lambda spark, folder: _scored(spark, folder).filter(score).select("media_id", "sidecar_id", "score")


def match_best(spark: SparkSession, folder: str) -> DataFrame:
    return matching.best(table(spark, folder, "media"), _scored(spark, folder))


def match_ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    return matching.ambiguous(_scored(spark, folder))


def match_strategies(spark: SparkSession, folder: str) -> DataFrame:
    return match_best(spark, folder).groupBy("status", "strategy").agg(F.count(F.lit(1)).alias("media"))


def sidecar_union(spark: SparkSession, folder: str) -> DataFrame:
    return matching.merged(*_tables(spark, folder, "media", "sidecar"))


def partner_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return matching.partners(table(spark, folder, "media"))


def match_media(spark: SparkSession, folder: str) -> DataFrame:
    return matching.match(*_tables(spark, folder, "media", "sidecar"))


# Dates and metadata.


def epoch_parse(spark: SparkSession, folder: str) -> DataFrame:
    taken, created = F.col("photo_taken_timestamp"), F.col("creation_timestamp")
    return table(spark, folder, "sidecar").select("sidecar_id", dates.epoch_seconds(taken).alias("taken"), dates.epoch_seconds(created).alias("created"), dates.best_seconds(taken, created).alias("best"))


def embedded_times(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embedded_meta").select("embedded_id", dates.flexible_us(F.col("capture_text"), F.col("utc_offset")).alias("us"))


def embedded_select(spark: SparkSession, folder: str) -> DataFrame:
    """The first tag that is a time; the tags of a row are its capture time under its source, and a plain CreateDate."""
    tags = F.map_concat(F.when(F.col("capture_source").isNotNull() & (F.col("capture_source") != "CreateDate"), F.create_map("capture_source", "capture_text")).otherwise(F.create_map().cast("map<string,string>")), F.create_map(F.lit("CreateDate"), F.col("capture_text")))
    rows = table(spark, folder, "embedded_meta").withColumn("t", dates.embedded_time(tags, F.col("utc_offset"), names.kind(F.col("rel_path")).eqNullSafe("video")))
    return rows.select("embedded_id", F.col("t.source").alias("source"), F.col("t.us").alias("us"))


def filename_dates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "media").select("media_id", dates.name_date(F.col("file_name")).cast("string").alias("day"))


def offset_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embedded_meta").withColumn("seconds", dates.fixed_offset(F.col("utc_offset")).cast("int"))
    return rows.select("embedded_id", "seconds", dates.offset_text(F.col("seconds")).alias("text"))


def best_geo(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sidecar").withColumn("g", _geo())
    return rows.select("sidecar_id", "g.lat", "g.lon", "g.alt", metadata.has_geo(F.col("g.lat"), F.col("g.lon")).alias("placed"))


def _geo() -> Column:
    return metadata.best_geo(*(F.col(c) for c in ("geo_latitude", "geo_longitude", "geo_altitude", "exif_latitude", "exif_longitude")), F.lit(0.0))


def known(spark: SparkSession, folder: str) -> DataFrame:
    """Everything known of each medium: its sidecar (matched or from its partner) and the first readable embedded row of its path."""
    media, sidecar, embedded = _tables(spark, folder, "media", "sidecar", "embedded_meta")
    matched = matching.match(media, sidecar).select("media_id", "status", "sidecar_id")
    said = sidecar.select("sidecar_id", dates.epoch_seconds(F.col("photo_taken_timestamp")).alias("taken"), dates.best_seconds(F.col("photo_taken_timestamp"), F.col("creation_timestamp")).alias("s"), _geo().alias("geo"), "title", "description")
    us = dates.flexible_us(F.col("capture_text"), F.col("utc_offset"))
    row = F.struct("embedded_id", us.alias("us"), "capture_source", "utc_offset", F.col("title").alias("etitle"), F.col("description").alias("edesc"), F.coalesce("lat", F.lit(0.0)).alias("elat"), F.coalesce("lon", F.lit(0.0)).alias("elon"))
    first = embedded.filter("is_readable").groupBy(F.coalesce("source_id", F.lit("")).alias("src"), "rel_path").agg(F.min_by(row, "embedded_id").alias("e")).select("src", "rel_path", "e.*")
    files = media.select("media_id", "source_id", F.coalesce("source_id", F.lit("")).alias("src"), "rel_path", "rel_dir", "file_name", paths.top_level(F.col("rel_path")).alias("top"), F.unix_micros("mtime").alias("written"))
    return cut(files.join(first, ["src", "rel_path"], "left").join(matched, "media_id").join(said, "sidecar_id", "left").drop("src"), "known")


def _sides() -> list[Column]:
    return [F.col(c) for c in ("s", "us", "geo", "elat", "elon", "title", "etitle", "description", "edesc")]


def _folder_dates(rows: DataFrame) -> DataFrame:
    date = dates.folder_date(F.col("taken"), F.col("us"), F.col("capture_source"), dates.name_date(F.col("file_name")), paths.folder_year(F.col("top")), F.col("written"))
    return rows.withColumn("d", date)


def folder_dates(spark: SparkSession, folder: str) -> DataFrame:
    return _folder_dates(known(spark, folder)).select("media_id", F.col("d.us").alias("us"), F.col("d.source").alias("source"), F.col("d.month_known").alias("month_known"))


def output_dirs(spark: SparkSession, folder: str) -> DataFrame:
    """The output folder of each medium by date, and as it lay."""
    rows = _folder_dates(known(spark, folder)).withColumn("at", F.timestamp_micros(F.col("d.us")))
    args = (F.col("rel_dir"), paths.is_year_folder(F.col("top")), F.col("at"), F.col("d.month_known"))
    return rows.select("media_id", paths.output_folder(*args).alias("by_date"), paths.output_folder(*args, by_date=False).alias("as_is"))


def output_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names corrected by signature and brand; the test tables have neither, so both follow from the size."""
    n = F.col("size_bytes") % 7
    signature = F.when(n == 0, ".jpg").when(n == 1, ".png").when(n == 2, ".heic")
    brand = F.when(F.col("size_bytes") % 2 == 0, "Apple QuickTime (.MOV/QT)")
    return table(spark, folder, "media").select("media_id", paths.corrected_name(F.col("file_name"), signature, brand).alias("name"))


def field_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = known(spark, folder).filter("sidecar_id is not null and embedded_id is not null")
    return rows.select("media_id", F.explode(metadata.conflicts(*_sides())).alias("c")).select("media_id", "c.field", "c.json_value", "c.embedded_value")


def policy_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """How many fields each policy writes."""
    rows = known(spark, folder).filter("sidecar_id is not null")
    each = F.array(*(F.struct(F.lit(p).alias("policy"), metadata.merge(p, *_sides()).alias("w")) for p in metadata.POLICIES))
    flat = rows.select(F.explode(each).alias("x")).select("x.policy", "x.w.*")
    return flat.groupBy("policy").agg(*(F.count_if(c).alias(c) for c in ("write_time", "write_gps", "write_title", "write_description")))


def policy_merge(spark: SparkSession, folder: str) -> DataFrame:
    return known(spark, folder).filter("sidecar_id is not null").select("media_id", metadata.merge("merge", *_sides()).alias("w")).select("media_id", "w.*")


def suspicious_dates(spark: SparkSession, folder: str) -> DataFrame:
    rows = known(spark, folder)
    placed = metadata.has_geo(F.col("geo.lat"), F.col("geo.lon"))
    reasons = metadata.suspicious(F.col("s"), F.col("us"), F.col("embedded_id").isNotNull(), placed, F.col("utc_offset"), NOW)
    return rows.select("media_id", "s", "us", F.array_join(reasons, "; ").alias("reason")).filter("reason <> ''").select("media_id", "reason")


def verify_findings(spark: SparkSession, folder: str) -> DataFrame:
    """What the files would lack if all of their sidecars had been written to them."""
    rows = known(spark, folder).filter("sidecar_id is not null and embedded_id is not null")
    placed = metadata.has_geo(F.col("geo.lat"), F.col("geo.lon"))
    found = metadata.problems(F.col("s"), placed, F.col("geo"), F.col("title"), F.col("description"), F.col("us"), F.col("elat"), F.col("elon"), F.col("etitle"), F.col("edesc"))
    return rows.select("media_id", F.array_join(found, "; ").alias("problems")).filter("problems <> ''")


def capture_offsets(spark: SparkSession, folder: str) -> DataFrame:
    rows = known(spark, folder).filter("sidecar_id is not null")
    seconds = dates.capture_offset(F.col("geo.lat"), F.col("geo.lon"), F.col("utc_offset")).cast("int")
    return rows.select("media_id", seconds.alias("seconds"), dates.offset_text(seconds).alias("text"))


def xmp_packets(spark: SparkSession, folder: str) -> DataFrame:
    rows = known(spark, folder).filter("sidecar_id is not null")
    offset = dates.capture_offset(F.col("geo.lat"), F.col("geo.lon"), F.col("utc_offset")).cast("int")
    local = F.concat(F.regexp_replace(dates.rfc3339(F.col("s") + offset), r"Z\z", ""), dates.offset_text(offset))
    packet = metadata.xmp_packet(metadata.merge("prefer-json", *_sides()), local, F.col("title"), F.col("description"), F.col("geo"))
    return rows.select("media_id", F.sha2(packet, 256).alias("packet"))


def write_arguments(spark: SparkSession, folder: str) -> DataFrame:
    rows = known(spark, folder).filter("sidecar_id is not null")
    offset = dates.capture_offset(F.col("geo.lat"), F.col("geo.lon"), F.col("utc_offset")).cast("int")
    args = metadata.write_arguments(metadata.merge("merge", *_sides()), names.kind(F.col("file_name")).eqNullSafe("video"), F.col("s"), offset, F.col("geo"))
    return rows.select("media_id", F.explode(args).alias("argument"))


# Records.


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


def state_latest(spark: SparkSession, folder: str) -> DataFrame:
    return records.state(table(spark, folder, "process_record"), LOG).select("state_key", "record_id", "status")


def state_first_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    return records.canonical(table(spark, folder, "process_record"), LOG).select("source_hash", "record_id", "output_path")


def _planned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The later batches as planned rows, and the history."""
    rows = table(spark, folder, "process_record").withColumn("state_key", records.state_key(F.col("source_id"), F.col("source_rel_path")))
    return rows.filter("batch_no > 0"), rows.filter("batch_no = 0").drop("state_key")


def resume_skip(spark: SparkSession, folder: str) -> DataFrame:
    planned, history = _planned(spark, folder)
    return records.resumable(planned, records.state(history, LOG)).select("record_id", "resumed")


def dedup_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Later records that repeat a content, with the output that holds it; year folders come first, then paths."""
    planned, history = _planned(spark, folder)
    order = [records.is_timeline(F.col("source_rel_path")).desc(), F.col("source_rel_path"), F.col("record_id")]
    return records.duplicates(planned, records.canonical(history, LOG), order).filter("duplicate_of is not null").select("record_id", "duplicate_of")


def dedup_bytes(spark: SparkSession, folder: str) -> DataFrame:
    planned, history = _planned(spark, folder)
    order = [records.is_timeline(F.col("source_rel_path")).desc(), F.col("source_rel_path"), F.col("record_id")]
    found = records.duplicates(planned, records.canonical(history, LOG), order).filter("duplicate_of is not null")
    return found.agg(F.count(F.lit(1)).alias("duplicates"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("bytes")).withColumn("text", metadata.human_bytes(F.col("bytes")))


def plan_order(spark: SparkSession, folder: str) -> DataFrame:
    """How many media precede each folder in the order in which plans are processed: year folders first, then by path."""
    rows = table(spark, folder, "media").groupBy(paths.is_year_folder(paths.top_level(F.col("rel_path"))).alias("is_year")).agg(F.count(F.lit(1)).alias("media"), F.min("rel_path").alias("first_path"), F.max("rel_path").alias("last_path"))
    return rows


def unique_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Output paths of later records that no other record and no path of the history has."""
    planned, history = _planned(spark, folder)
    rows = planned.filter("output_path is not null").select("record_id", "output_path")
    taken = history.filter("output_path is not null").select("output_path")
    return names.unique_names(rows, "output_path", ["record_id"], taken, "target").select("record_id", "target")


def album_copies(spark: SparkSession, folder: str) -> DataFrame:
    return records.album_copies(records.state(table(spark, folder, "process_record"), LOG)).select("record_id", "removable")


def album_summary(spark: SparkSession, folder: str) -> DataFrame:
    return records.album_summary(records.state(table(spark, folder, "process_record"), LOG))


def album_folders(spark: SparkSession, folder: str) -> DataFrame:
    return records.emptied_folders(records.album_copies(records.state(table(spark, folder, "process_record"), LOG)))


def _paired(spark: SparkSession, folder: str) -> DataFrame:
    """The state with the partner that a photo of its name would have."""
    state = records.state(table(spark, folder, "process_record"), LOG)
    return state.withColumn("partner_rel_path", F.when(F.col("source_rel_path").rlike(r"(?i)\.(?:jpg|jpeg|heic)\z"), F.regexp_replace("source_rel_path", r"\.[^.]*\z", ".mp4")))


def motion_pairs_state(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.from_state(_paired(spark, folder)).select("key", "still_path", "video_path")


def motion_pairs_ranked(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.state(table(spark, folder, "process_record"), LOG).filter("output_path is not null")
    return pairs.by_rank(rows, "output_path").select("key", "still_path", "video_path")


def _log(rows: DataFrame) -> DataFrame:
    n = F.char_length("key") % 5
    return rows.select("key", F.when(n == 0, "merged").when(n == 1, "failed").when(n == 2, "timed-out").when(n == 3, "missing-video").alias("status"), F.lit(1).alias("seq")).filter("status is not null")


def motion_candidates(spark: SparkSession, folder: str) -> DataFrame:
    current = _paired(spark, folder)
    return pairs.candidates(current, current.filter("output_path is not null"), "output_path").select("key")


def motion_resume(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of ranked pairs after a log whose statuses follow from the length of the key."""
    rows = cut(motion_pairs_ranked(spark, folder), "pairs")
    return pairs.resume(rows, _log(rows), ["seq"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("pairs"))


def manifest_status(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest_change").groupBy(F.col("status").alias("old"), changefeed.status_now(F.col("status")).alias("now")).agg(F.count(F.lit(1)).alias("rows"))


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return records.archives(table(spark, folder, "manifest_change"), MANIFEST_LOG)


def archive_resume(spark: SparkSession, folder: str) -> DataFrame:
    return _archives(spark, folder).select("zip_fingerprint", "status", "skip", "legacy", "interrupted")


def archive_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _archives(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("archives"), F.count_if("legacy").alias("legacy"))


def archive_interrupt(spark: SparkSession, folder: str) -> DataFrame:
    return records.mark_interrupted(_archives(spark, folder), F.timestamp_seconds(F.lit(NOW))).select("zip_fingerprint", "status", F.unix_micros("end_time").alias("end_us"), "error_text")


def skip_list(spark: SparkSession, folder: str) -> DataFrame:
    """Archives that a list of names leaves: here the names of those that failed, in upper case, and a blank."""
    latest = _archives(spark, folder)
    skipped = latest.filter("status = 'failed'").select(F.upper("zip_name").alias("n")).unionByName(spark.createDataFrame([(" ",)], "n string"))
    return records.not_listed(latest, skipped).select("zip_fingerprint")


# Reports.


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return report.summary(table(spark, folder, "process_record"))


def run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return report.summary(table(spark, folder, "process_record"), ["source_id"])


def report_table(spark: SparkSession, folder: str) -> DataFrame:
    return report.table(run_summary(spark, folder))


def review_rows(spark: SparkSession, folder: str) -> DataFrame:
    return report.review_rows(table(spark, folder, "process_record"))


def archive_review(spark: SparkSession, folder: str) -> DataFrame:
    return report.archive_status(report.summary(table(spark, folder, "process_record"), ["batch_no"])).select("batch_no", "needs_review", "clean", "status")


def suspicious_report(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "suspicious_date").select("source_path", "output_path", "json_timestamp", "embedded_timestamp", "reason")


# Archives, drives, downloads.


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """Each medium as an entry of the archive of its source."""
    return table(spark, folder, "media").select(F.coalesce("source_id", F.lit("none")).alias("archive"), F.concat(F.lit("Takeout/Google Photos/"), "rel_path").alias("entry_name"), F.lit(False).alias("is_dir"), F.col("size_bytes").alias("uncompressed_size"))


def zip_stats(spark: SparkSession, folder: str) -> DataFrame:
    return storage.archive_stats(_entries(spark, folder))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return _archives(spark, folder).select("zip_fingerprint", F.col("zip_size").alias("size_bytes"), (F.col("zip_size") * 2 - 900_000_000).alias("uncompressed_bytes"), F.lit(10).alias("media_files"))


def preflight(spark: SparkSession, folder: str) -> DataFrame:
    return storage.preflight(_sized(spark, folder))


ROOTS = [(1, "D:/work", 26_000_000_000, "HDD", True), (2, "E:/work", 27_500_000_000, "SSD", True), (3, "F:/work", 27_900_000_000, "SSD", True), (4, "G:/work", 99_000_000_000, "unknown", True), (5, "H:/work", 99_000_000_000, "SSD", False)]
ROOT_COLUMNS = "ord int, path string, free_bytes bigint, kind string, usable boolean"


def work_roots(spark: SparkSession, folder: str) -> DataFrame:
    need = storage.required_bytes(F.col("size_bytes"), F.col("uncompressed_bytes"))
    needs = _sized(spark, folder).select("zip_fingerprint", need.alias("required_bytes"))
    return storage.choose_root(needs, spark.createDataFrame(ROOTS, ROOT_COLUMNS)).select("zip_fingerprint", "required_bytes", "path")


DRIVES = [("C:/", "C:", "System", 90, "NVMe SSD"), ("B:/", "b:", "Old", 80, "WD Hard Disk"), ("D:/", "D:", " backup b ", 70, "Solid State Device"), ("E:/", "E:", None, 60, "USB")]
DRIVE_COLUMNS = "root string, letter string, label string, free_bytes bigint, model string"


def drive_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of four drives, the output drive, and whether only HDDs are left."""
    drives = spark.createDataFrame(DRIVES, DRIVE_COLUMNS).withColumn("kind", storage.drive_kind(F.col("model")))
    roots = storage.with_kind(spark.createDataFrame([(r[0], r[1]) for r in ROOTS], "ord int, path string"), drives)
    chosen = storage.output_drive(drives)
    return roots.crossJoin(chosen).crossJoin(storage.only_hdd(roots))  # one row each


FOLDERS = [("source", "/data/in"), ("work", "/data/in/work"), ("output", "/data/out"), ("staging", "/DATA/OUT"), ("other", "/data/inner"), ("root", "/")]


def path_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return storage.overlapping(spark.createDataFrame(FOLDERS, "role string, path string"))


def entry_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "media").select("media_id", paths.safe_entry(F.col("rel_path")).alias("e"), paths.below_root(F.concat(F.lit("Takeout/Google Photos/"), "rel_path")).alias("below"))
    return rows.select("media_id", F.col("e.path").alias("path"), F.col("e.reason").alias("reason"), "below")


def archive_names(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("zip_path")
    return table(spark, folder, "manifest_change").select("change_id", paths.is_archive(p).alias("archive"), paths.is_export_archive(p).alias("export"), paths.is_unfinished(p).alias("unfinished"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat_ws("|", F.lower(F.translate("zip_path", "\\", "/")), F.col("zip_size").cast("string"), (F.unix_micros("zip_modified") * 1000).cast("string"))
    return table(spark, folder, "manifest_change").filter("zip_path is not null and zip_size is not null and zip_modified is not null").select("change_id", key.alias("fingerprint"))


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "process_record").select("record_id", metadata.human_bytes(F.col("source_size")).alias("text"))


def problems_joined(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "process_record").select("record_id", metadata.add_problem(F.col("error_text"), F.nullif(F.col("match_status"), F.lit("matched"))).alias("text"))


def xml_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2(metadata.escape_xml(F.col("text")), 256).alias("escaped"))


def download_throttle(spark: SparkSession, folder: str) -> DataFrame:
    """Events as downloads whose state follows from the event's type."""
    kind = F.char_length("event_type") % 3
    rows = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.when(kind == 0, "interrupted").otherwise("in_progress").alias("state"), (kind == 1).alias("paused"), (F.col("value") > 50).alias("can_resume"), F.col("ts").alias("start_time"))
    return storage.throttle(rows)


def _sightings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("observed_at"), F.char_length("event_type").cast("bigint").alias("size"), F.lit(True).alias("unlocked"), F.lit(True).alias("readable"))


def mover_stable(spark: SparkSession, folder: str) -> DataFrame:
    return storage.stable_files(_sightings(spark, folder)).select("path", "size", F.unix_micros(F.col("since").cast("timestamp")).alias("since"), F.unix_micros(F.col("until").cast("timestamp")).alias("until"))


def mover_targets(spark: SparkSession, folder: str) -> DataFrame:
    drives = spark.createDataFrame([(d[0], d[3] * 1_000_000_000) for d in DRIVES], "root string, free_bytes bigint")
    files = _archives(spark, folder).select(F.col("zip_fingerprint").alias("path"), (F.col("zip_size") * 150).alias("size"))
    return storage.move_target(files, drives)


QUERIES: tuple[Query, ...] = (
    *(p3_found, p3_outcomes, p4_found, p4_entries, p4_batches),
    *(media_classify, media_counts, year_folders, name_parts, name_keys, partner_keys, supplement_names, shared_prefix),
    *(match_scored, match_best, match_ambiguous, match_strategies, sidecar_union, partner_pairs, match_media),
    *(epoch_parse, embedded_times, embedded_select, filename_dates, offset_texts, best_geo, folder_dates, output_dirs, output_names),
    *(field_conflicts, policy_matrix, policy_merge, suspicious_dates, verify_findings, capture_offsets, xmp_packets, write_arguments),
    *(content_hash, state_latest, state_first_by_hash, resume_skip, dedup_canonical, dedup_bytes, plan_order, unique_outputs),
    *(album_copies, album_summary, album_folders, motion_pairs_state, motion_pairs_ranked, motion_candidates, motion_resume),
    *(manifest_status, archive_resume, archive_outcomes, archive_interrupt, skip_list),
    *(run_summary, run_summaries, report_table, review_rows, archive_review, suspicious_report),
    *(zip_stats, preflight, work_roots, drive_choice, path_overlap, entry_names, archive_names, fingerprints, sizes, problems_joined, xml_escape),
    *(download_throttle, mover_stable, mover_targets),
)
TIERS = {"match_exact": "score = 1200", "match_supplement": "score = 1300", "match_title": "score = 1100", "match_keys": "score in (900, 1000)", "match_prefix": "score between 720 and 899"}


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES} | {name: _tier(score) for name, score in TIERS.items()}


def oracle_sql() -> dict[str, str]:
    from argentum import oracles

    return oracles.all_queries()
