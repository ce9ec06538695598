"""ZIP archives as a Spark data source: one partition an archive, only its directory or the sidecars in it are read.

    spark.dataSource.register(ZipEntries)
    spark.read.format("zip_entries").load("/exports")

Option `content`: with `sidecars` the text of JSON entries of at most
`max_bytes` is read too. Archives are files of the folder (or a list divided
by `;`) that every executor can reach.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from argentum.functions.paths import OWN, ROOT, SYSTEM, UNFINISHED, below_root, is_sidecar, safe_entry
from argentum.session import ship

SCHEMA = "archive string, archive_bytes bigint, mtime_ns bigint, entry_name string, is_dir boolean, is_symlink boolean, uncompressed_size bigint, body string, problem string"
#: Bytes of a sidecar that is read at most.
MAX_SIDECAR = 8 << 20


def archives(roots: str) -> list[tuple[str, bool]]:
    """Paths of archives below folders, and of archives that are named themselves (true); in order of their lower-case paths."""
    found = []
    for root in (r.strip() for r in roots.split(";")):
        root = root.removeprefix("file://")
        if not root:
            continue
        if os.path.isfile(root):
            if os.path.splitext(root)[1].lower() == ".zip":
                found.append((root, True))
            continue
        if not os.path.isdir(root):
            raise FileNotFoundError(root)
        for folder, folders, names in os.walk(root):
            folders[:] = [d for d in folders if d.strip().lower() not in SYSTEM]
            for name in names:
                low = name.lower()
                if os.path.splitext(low)[1] == ".zip" and "takeout" in low and not low.endswith(UNFINISHED):
                    found.append((os.path.join(folder, name), False))
    return sorted(found, key=lambda x: x[0].lower())


class _Archive(InputPartition):
    def __init__(self, path: str, named: bool) -> None:
        self.path, self.named = path, named


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = options["path"]
        self.sidecars = options.get("content") == "sidecars"
        self.most = int(options.get("max_bytes", MAX_SIDECAR))

    def partitions(self) -> list[InputPartition]:
        return [_Archive(*a) for a in archives(self.roots)]

    def read(self, partition: _Archive | None) -> Iterator[tuple]:
        if partition is None:
            return
        size, mtime = os.path.getsize(partition.path), os.stat(partition.path).st_mtime_ns
        try:
            with zipfile.ZipFile(partition.path) as file:
                for e in file.infolist():
                    body = problem = None
                    if self.sidecars and not e.is_dir() and e.filename.lower().endswith(".json"):
                        if e.file_size > self.most:
                            problem = "too large"
                        else:
                            try:
                                body = file.read(e).decode("utf-8", "replace")
                            except Exception as x:  # noqa: BLE001 - a broken entry stays, without its text
                                problem = type(x).__name__
                    yield (partition.path, size, mtime, e.filename, e.is_dir(), (e.external_attr >> 28) == 0xA, e.file_size, body, problem)
        except zipfile.BadZipFile:
            if partition.named:
                raise
            yield (partition.path, size, mtime, None, None, None, None, None, "unreadable")


class ZipEntries(DataSource):
    """Entries of ZIP archives."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def entries(spark: SparkSession, roots: str, sidecars: bool = False, max_bytes: int = MAX_SIDECAR) -> DataFrame:
    """The entries of all archives below the roots; an unreadable archive of a folder is one row with a problem, one that is named raises."""
    ship(spark)
    spark.dataSource.register(ZipEntries)
    reader = spark.read.format("zip_entries").option("max_bytes", max_bytes)
    return (reader.option("content", "sidecars") if sidecars else reader).load(roots)


def sidecar_index(spark: SparkSession, roots: str, max_bytes: int = MAX_SIDECAR) -> DataFrame:
    """archive, rel_dir, sidecar_name, display_path, meta, problem of the sidecars in all archives, below the photo root.

    Entries with unsafe names are left out; a text that is no sidecar stays, with a null meta.
    """
    from argentum.sources.folders import payload

    rows = entries(spark, roots, True, max_bytes).filter("entry_name is not null and not is_dir")
    rows = rows.withColumn("rel", below_root(safe_entry(F.col("entry_name"))["path"])).filter("rel is not null").filter(is_sidecar(F.col("rel")))
    return rows.select("archive", F.regexp_extract("rel", r"^(.*)/", 1).alias("rel_dir"), F.regexp_extract("rel", r"([^/]*)\z", 1).alias("sidecar_name"), F.concat("archive", F.lit("!"), "entry_name").alias("display_path"), payload(F.col("body")).alias("meta"), "problem")


def photo_root(entries: DataFrame) -> DataFrame:
    """root, ok: the one folder of the entries that is the photo root; ok is false where there is none or several."""
    path = safe_entry(F.col("entry_name"))["path"]
    at = F.regexp_extract(path, rf"(?i)^((?:.*?/)?{ROOT})(?:/|\z)", 1)
    return entries.select(F.nullif(at, F.lit("")).alias("r")).filter("r is not null").distinct().agg(F.min("r").alias("root"), (F.count(F.lit(1)) == 1).alias("ok"))


__all__ = ["OWN", "ZipEntries", "archives", "entries", "photo_root", "sidecar_index"]
