"""Summaries of a run: counters, what needs review, the rows of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.functions.metadata import human_bytes
from argentum.operators.records import successful

# Strategies that are no fallback, the text of a failed verification.
CLEAN = ("exact-name", "json-title")
UNVERIFIED = "verification failed"
#: Columns of a record that a log may lack, with what their absence means.
ABSENT = {"metadata_written": "false", "used_xmp_sidecar": "false", "metadata_verified": "false", "conflicts": "0", "used_partner_sidecar": "match_strategy <=> 'partner-sidecar'", "source_size": "0"}
COUNTERS = ("total_media", "json_sidecars_found", "matched", "matched_cleanly", "matched_with_fallback", "unmatched", "ambiguous", "output_media", "metadata_written", "xmp_sidecars_written", "metadata_verified", "metadata_verification_failures", "duplicates_linked", "duplicates_copied", "duplicates_reused", "resumed", "existing_skipped", "conflicts_found", "partner_sidecar_used", "approx_dedup_bytes_saved", "suspicious_dates", "errors")


def is_fallback(strategy: Column) -> Column:
    return ~F.coalesce(strategy.isin(*CLEAN), F.lit(False))


def complete(records: DataFrame) -> DataFrame:
    """Records with all columns that the summary needs; conflicts as their number."""
    rows = records
    for c, value in ABSENT.items():
        if c not in records.columns:
            rows = rows.withColumn(c, F.expr(value))
        elif c == "conflicts":
            rows = rows.withColumn(c, F.greatest(F.size(F.col(c)), F.lit(0)))
        elif value == "false":
            rows = rows.withColumn(c, F.coalesce(c, F.lit(False)))
    return rows.withColumns({"error_text": F.coalesce("error_text", F.lit("")), "output_path": F.coalesce("output_path", F.lit("")), "source_size": F.coalesce("source_size", F.lit(0))})


def summary(records: DataFrame, by: list[str] | None = None, sidecars: int = 0, suspicious: int = 0, more_errors: int = 0) -> DataFrame:
    """The 22 counters of a run in one row, or a row for each value of `by`.

    No records give one row of zeros (none with `by`). The three counts that
    don't come from records are given.
    """
    s, m = F.col("status"), F.col("match_status")
    matched = m == "matched"
    linked = s.isin("hard-linked", "symlinked")
    failed = F.coalesce(s == "error", F.lit(False))
    count = lambda c: F.count_if(c)
    found = {
        "total_media": F.count(F.lit(1)),
        "json_sidecars_found": F.lit(sidecars).cast("bigint"),
        "matched": count(matched),
        "matched_cleanly": count(matched & ~is_fallback(F.col("match_strategy"))),
        "matched_with_fallback": count(matched & is_fallback(F.col("match_strategy"))),
        "unmatched": count(m == "unmatched"),
        "ambiguous": count(m == "ambiguous"),
        "output_media": count((F.col("output_path") != "") & successful(s) & (s != "dry-run")),
        "metadata_written": count(F.col("metadata_written")),
        "xmp_sidecars_written": count(F.col("metadata_written") & F.col("used_xmp_sidecar")),
        "metadata_verified": count(F.col("metadata_verified")),
        "metadata_verification_failures": count(F.col("error_text").contains(UNVERIFIED)),
        "duplicates_linked": count(linked),
        "duplicates_copied": count(s == "duplicate-copied"),
        "duplicates_reused": count(linked | (s == "duplicate-copied")),
        "resumed": count(s == "skipped-resume"),
        "existing_skipped": count(s == "skipped-existing"),
        "conflicts_found": F.coalesce(F.sum(F.col("conflicts").cast("bigint")), F.lit(0)),
        "partner_sidecar_used": count(F.col("used_partner_sidecar")),
        "approx_dedup_bytes_saved": F.coalesce(F.sum(F.when(linked, F.col("source_size"))), F.lit(0)).cast("bigint"),
        "suspicious_dates": F.lit(suspicious).cast("bigint"),
        "errors": count(failed | (F.col("error_text") != "")) + F.lit(more_errors),
    }
    return complete(records).groupBy(*(by or [])).agg(*(found[c].alias(c) for c in COUNTERS))


def table(summed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Label and value of the lines that a report shows, in their order."""
    shown = lambda c: F.col(c).cast("string")
    # The labels of a report.
    lines = [
        ("Input media found", shown("total_media")),
        ("JSON sidecars found", shown("json_sidecars_found")),
        ("Matched cleanly", shown("matched_cleanly")),
        ("Matched with fallback", shown("matched_with_fallback")),
        ("Unmatched", shown("unmatched")),
        ("Ambiguous", shown("ambiguous")),
        ("Output media count", shown("output_media")),
        ("Metadata written", shown("metadata_written")),
        ("XMP sidecars written", shown("xmp_sidecars_written")),
        ("Metadata verified", shown("metadata_verified")),
        ("Verification failures", shown("metadata_verification_failures")),
        ("Duplicates removed", (F.col("duplicates_linked") + F.col("duplicates_copied")).cast("string")),
        ("Space saved (dedupe)", human_bytes(F.col("approx_dedup_bytes_saved"))),
        ("Suspicious dates", shown("suspicious_dates")),
        ("Errors", shown("errors")),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("line"), F.lit(a).alias("label"), b.alias("value")) for i, (a, b) in enumerate(lines, 1)))
    return summed.select(*(keys or []), F.explode(rows).alias("r")).select(*(keys or []), "r.*")


def needs_review(records: DataFrame) -> DataFrame:
    """The records to look at: not matched, with an error or with conflicts."""
    rows = complete(records)
    return rows.filter(~F.col("match_status").eqNullSafe("matched") | (F.col("error_text") != "") | (F.col("conflicts") > 0))


def review_rows(records: DataFrame) -> DataFrame:
    """The columns of the review report; arrays joined with `|`, what a log lacks is empty or 0."""
    have = set(records.columns)
    rows = needs_review(records.withColumn("__fields", F.array_join(F.transform("conflicts", lambda c: c["field"]), "|")) if "conflicts" in have else records)
    text = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")).alias(c)
    number = lambda c: (F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)).cast("int").alias(c)
    joined = (F.coalesce(F.array_join("match_candidates", "|"), F.lit("")) if "match_candidates" in have else F.lit("")).alias("match_candidates")
    fields = (F.coalesce("__fields", F.lit("")) if "conflicts" in have else F.lit("")).alias("conflicts")
    return rows.select(text("source_rel_path"), text("match_status"), text("match_strategy"), text("status"), text("folder_date_source"), number("folder_year"), number("folder_month"), text("output_path"), text("sidecar_path"), text("partner_rel_path"), joined, fields, F.col("error_text").alias("error"))


def archive_status(summed: DataFrame) -> DataFrame:
    """Adds `needs_review`, `status` (completed or completed_with_review) and `clean` (whether a source could go; nothing is deleted)."""
    flags = ("unmatched", "ambiguous", "errors", "suspicious_dates", "conflicts_found", "metadata_verification_failures")
    review = F.lit(False)
    for c in flags:
        review = review | (F.col(c) > 0)
    clean = (F.col("unmatched") == 0) & (F.col("ambiguous") == 0) & (F.col("errors") == 0)
    return summed.withColumns({"needs_review": review, "clean": clean, "status": F.when(review, "completed_with_review").otherwise("completed")})
