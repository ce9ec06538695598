"""Append-only logs: one JSON object a line, lines in the order in which they were written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = (
    "sourceId string, sourcePath string, sourceRelPath string, sourceHash string, sourceSize bigint, sidecarPath string, partnerPath string, partnerRelPath string, "
    "outputPath string, stagedPath string, matchStatus string, matchStrategy string, matchCandidates array<string>, usedPartnerSidecar boolean, status string, duplicateOf string, "
    "folderDateSource string, folderYear int, folderMonth int, metadataWritten boolean, metadataVerified boolean, usedXMPSidecar boolean, "
    "conflicts array<struct<field: string, jsonValue: string, embeddedValue: string>>, error string, updatedAt timestamp"
)
MANIFEST = (
    "workflowVersion int, zipName string, zipPath string, zipSize bigint, zipModified timestamp, zipFingerprint string, sourceDrive string, status string, "
    "startTime timestamp, endTime timestamp, reportPath string, workRoot string, extractedRoot string, googlePhotosRoot string, stagingRoot string, outputFolder string, error string"
)
MOTION = "key string, status string, sourceStillPath string, sourceVideoPath string, outputPath string, error string, duration bigint, updatedAt timestamp"
#: Which field a line of a log must have.
NEEDS = {STATE: "sourceRelPath", MANIFEST: "zipFingerprint", MOTION: "key"}


def snake(name: str) -> str:
    out = "".join("_" + c.lower() if c.isupper() and i and not name[i - 1].isupper() else c.lower() for i, c in enumerate(name))
    return {"error": "error_text", "used_xmpsidecar": "used_xmp_sidecar"}.get(out, out)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """seq, line of a log: seq orders the lines by file, block and place in the block."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return read.select(F.struct("f", "b", "i").alias("seq"), F.col("value").alias("line"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The good lines of a log as columns in snake case, with seq. Lines that are no object, have a wrong type or lack the needed field are left out; see bad()."""
    need = NEEDS[schema]
    parsed = _parsed(spark, path, schema).filter(_good(need))
    names = [f.split(" ", 1)[0] for f in _fields(schema)]
    return parsed.select("seq", *(F.col(f"r.{n}").alias(snake(n)) for n in names))


def bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """seq, line of the lines that read() leaves out; blank ones don't count."""
    return _parsed(spark, path, schema).filter(~_good(NEEDS[schema])).filter(F.trim("line") != "").select("seq", "line")


def _fields(schema: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return [f"{f.name} {f.dataType.simpleString()}" for f in _parse_datatype_string(schema)]


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    whole = f"{schema}, _corrupt string"
    return lines(spark, path).withColumn("r", F.from_json("line", whole, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))


def _good(need: str) -> Column:
    return F.coalesce(F.col("r").isNotNull() & F.col("r._corrupt").isNull() & (F.col(f"r.{need}") != ""), F.lit(False))


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a log. A job's files appear when it commits, all of them or none."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)
