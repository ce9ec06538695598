"""Reports and plans. Nothing here touches media: what a run would do to files is a table of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.functions.metadata import human_bytes
from argentum.operators import report


def csv(rows: DataFrame, path: str) -> None:
    """A CSV with a header line in every part; quotes are doubled."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def suspicious_csv(findings: DataFrame, path: str) -> None:
    csv(findings.select("source_path", "output_path", "json_timestamp", "embedded_timestamp", "reason"), path)


def review_csv(records: DataFrame, path: str) -> None:
    csv(report.review_rows(records), path)


def json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def text(summed: DataFrame) -> DataFrame:
    """The lines of a report in their order."""
    return report.table(summed).select("line", F.format_string("%s: %s", "label", "value").alias("text"))


def run_report(records: DataFrame, folder: str, stamp: str, **counts: int) -> None:
    """summary-<stamp> and latest, as JSON and as text."""
    summed = report.summary(records, **counts)
    lines = text(summed).orderBy("line").select("text")
    for name in (f"summary-{stamp}", "latest"):
        json(summed, f"{folder}/{name}.json")
        lines.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.txt")


def preflight_text(rollup: DataFrame) -> DataFrame:
    """The line of a preflight report."""
    return rollup.select(F.format_string("%d archives, %s in all, %d media, largest %s, work space %s", "archives", human_bytes(F.col("total_bytes")), "media_files", human_bytes(F.col("largest_bytes")), human_bytes(F.col("required_bytes"))).alias("text"))


def commit_plan(records: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """phase, from_path, to_path, action of staged records: first the files with their packets, then the duplicates.

    there: path and hash of targets that exist. An equal one needs no action,
    another one is a conflict.
    """
    staged = F.coalesce("staged_path", F.lit("")) != ""
    second = F.coalesce("duplicate_of", F.lit("")) != ""
    files = records.filter(staged & ~second).select(F.lit(1).alias("phase"), F.col("staged_path").alias("from_path"), F.col("output_path").alias("to_path"), "source_hash", "used_xmp_sidecar")
    packets = files.filter("used_xmp_sidecar").select("phase", F.concat("from_path", F.lit(".xmp")).alias("from_path"), F.concat("to_path", F.lit(".xmp")).alias("to_path"), F.lit(None).cast("string").alias("source_hash"))
    links = records.filter(second & (F.coalesce("output_path", F.lit("")) != "")).select(F.lit(2).alias("phase"), F.col("duplicate_of").alias("from_path"), F.col("output_path").alias("to_path"), "source_hash")
    plan = files.drop("used_xmp_sidecar").unionByName(packets).unionByName(links)
    if there is None:
        return plan.select("phase", "from_path", "to_path", F.lit("move").alias("action"))
    joined = plan.join(there.select(F.col("path").alias("to_path"), F.col("hash").alias("__h")), "to_path", "left")
    action: Column = F.when(F.col("__h").isNull(), "move").when(F.col("__h") == F.col("source_hash"), "none").otherwise("conflict")
    return joined.select("phase", "from_path", "to_path", action.alias("action"))
