"""Scanning folders of media and sidecars, and reading sidecar files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.functions.names import kind
from argentum.functions.paths import OWN, is_sidecar, is_year_folder, skipped_folder, top_level

#: What a sidecar file holds.
PAYLOAD = (
    "title string, description string, "
    "creationTime struct<timestamp: string, formatted: string>, photoTakenTime struct<timestamp: string, formatted: string>, "
    "geoData struct<latitude: double, longitude: double, altitude: double>, geoDataExif struct<latitude: double, longitude: double, altitude: double>"
)
#: Bytes of a file's beginning by which its kind is told.
HEADER = 32


def _relative(root: str) -> Column:
    """The decoded path below the root."""
    plain = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), r"^[a-z0-9]+:/+", "/")
    return F.substring(path, len("/" + plain.strip("/") + "/") + 1, 1 << 20)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path, size_bytes, mtime of all files below a folder but those in folders of our own; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    rows = found.withColumn("rel_path", _relative(root))
    folder = F.regexp_extract("rel_path", r"^(.*)/", 1)
    return rows.filter(~skipped_folder(folder, OWN)).select("path", "rel_path", "size_bytes", "mtime")


def scan(spark: SparkSession, root: str, albums: bool = True) -> DataFrame:
    """path, rel_path, rel_dir, top_level_dir, file_name, kind, is_year_folder, size_bytes, mtime of media and sidecars.

    kind: image, video or sidecar. Without albums only what lies in year
    folders is kept, sidecars as well as media.
    """
    name = F.regexp_extract("rel_path", r"([^/]*)\z", 1)
    what = F.coalesce(kind(name), F.when(F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1)) == ".json", "sidecar"))
    rows = listing(spark, root).withColumns({"file_name": name, "kind": what, "rel_dir": F.regexp_extract("rel_path", r"^(.*)/", 1), "top_level_dir": top_level(F.col("rel_path"))}).filter("kind is not null")
    rows = rows.withColumn("is_year_folder", is_year_folder(F.col("top_level_dir")))
    return (rows if albums else rows.filter("is_year_folder")).select("path", "rel_path", "rel_dir", "top_level_dir", "file_name", "kind", "is_year_folder", "size_bytes", "mtime")


def counts(scanned: DataFrame) -> DataFrame:
    """media and sidecars of a scan, in one row."""
    return scanned.agg(F.count_if(F.col("kind") != "sidecar").alias("media"), F.count_if(F.col("kind") == "sidecar").alias("sidecars"))


def payload(body: Column) -> Column:
    """The payload of a sidecar text; null where it is no JSON object or a field has another type.

    `{}` gives a payload whose fields are all null. Numbers are no texts.
    """
    variant = F.try_parse_json(body)
    kind_at = lambda path: F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    texts = ("$.title", "$.description", "$.creationTime.timestamp", "$.creationTime.formatted", "$.photoTakenTime.timestamp", "$.photoTakenTime.formatted")
    fits = F.schema_of_variant(variant).startswith("OBJECT")
    for path in texts:
        fits = fits & F.coalesce(kind_at(path).isin("STRING", "VOID"), F.lit(True))
    return F.when(fits, F.from_json(body, PAYLOAD))


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_dir, sidecar_name, meta of the sidecar files of a folder; meta is null where a file can't be read as one."""
    files = scan(spark, root).filter("kind = 'sidecar'").filter(is_sidecar(F.col("file_name"))).select("path", "rel_dir", F.col("file_name").alias("sidecar_name"))
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(root).select(F.regexp_replace("_metadata.file_path", r"^file:/+", "file:/").alias("path"), payload(F.col("value")).alias("meta"))
    return files.withColumn("path", F.regexp_replace("path", r"^file:/+", "file:/")).join(texts, "path", "left")


def headers(spark: SparkSession, root: str) -> DataFrame:
    """path, header of images: the bytes by which signature() tells what they are."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png,heic,JPG,JPEG,PNG,HEIC}").load(root)
    return found.select("path", F.substring("content", 1, HEADER).alias("header"))
