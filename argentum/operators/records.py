"""Folding append-only logs into state: latest and first records, resuming, duplicates, archives.

Logs are tables with a column that orders their lines. Where two lines are
equal in it the further order columns decide, so that results don't depend on
how rows are laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions.folders import YEAR_FOLDER
from argentum.functions.paths import top_level
from argentum.operators.changefeed import status_now

# Statuses of records that count as done, of archives that are done and that are under way, the version of the workflow.
SUCCESSFUL = ("skipped-resume", "skipped-existing", "dry-run", "copied", "copied-with-metadata", "copied-without-metadata", "hard-linked", "symlinked", "duplicate-copied")
DONE, ACTIVE = ("completed", "completed_with_review"), ("pending", "extracting", "processing")
WORKFLOW = 2
INTERRUPTED = "previous run ended before this ZIP finished"


def successful(status: Column) -> Column:
    return F.coalesce(status.isin(*SUCCESSFUL), F.lit(False))


def state_key(source: Column, path: Column) -> Column:
    """What a record is known by: its path, and its source where it has one."""
    return F.when(F.coalesce(source, F.lit("")) == "", path).otherwise(F.concat(source, F.lit("|"), path))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. Rows whose keys are null or empty are left out."""
    known = rows
    for k in keys:
        known = known.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    last = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return known.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r")


def first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Rows whose keys are null or empty are left out."""
    known = rows
    for k in keys:
        known = known.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return known.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_first() for c in order)))).filter("__r = 1").drop("__r")


def state(records: DataFrame, order: list[str]) -> DataFrame:
    """The latest record of each state key; adds state_key. Records without a path are left out."""
    keyed = records.filter(F.coalesce("source_rel_path", F.lit("")) != "").withColumn("state_key", state_key(F.col("source_id"), F.col("source_rel_path")))
    return latest(keyed, ["state_key"], order)


def canonical(records: DataFrame, order: list[str]) -> DataFrame:
    """The first successful record of each content hash; later records never replace it."""
    known = records.filter(successful(F.col("status")) & (F.coalesce("source_rel_path", F.lit("")) != ""))
    return first(known, ["source_hash"], order)


def resumable(planned: DataFrame, done: DataFrame) -> DataFrame:
    """The planned rows with `resumed`: whether their key's latest record was successful, has the same output (without case) and the output exists.

    planned: state_key, output_path. done: state(); with a column
    output_exists where that is known, else outputs count as existing.
    """
    there = F.coalesce("output_exists", F.lit(True)) if "output_exists" in done.columns else F.lit(True)
    known = done.filter(successful(F.col("status")) & there).select("state_key", F.lower("output_path").alias("__done"))
    return planned.join(known, "state_key", "left").withColumn("resumed", F.coalesce(F.lower("output_path") == F.col("__done"), F.lit(False))).drop("__done")


def duplicates(planned: DataFrame, known: DataFrame, order: list[Column]) -> DataFrame:
    """The planned rows with duplicate_of: the output of the first record of their content, if that is another output.

    Records of `known` (canonical()) come before all planned rows, these in
    their order. Null and empty hashes are no duplicates.
    """
    hashed = planned.filter(F.coalesce("source_hash", F.lit("")) != "")
    rank = Window.partitionBy("source_hash").orderBy(*order)
    firsts = hashed.withColumn("__r", F.row_number().over(rank)).filter("__r = 1").select("source_hash", F.col("output_path").alias("__new"))
    old = known.select("source_hash", F.col("output_path").alias("__old"))
    origin = firsts.join(old, "source_hash", "left").select("source_hash", F.coalesce("__old", "__new").alias("__of"))
    joined = planned.join(origin, "source_hash", "left")
    other = F.lower("__of") != F.lower("output_path")
    return joined.withColumn("duplicate_of", F.when(other, F.col("__of"))).drop("__of")


def is_timeline(path: Column) -> Column:
    """Whether a record's path begins with a year folder."""
    return F.coalesce(top_level(path).rlike(YEAR_FOLDER), F.lit(False))


def album_copies(current: DataFrame) -> DataFrame:
    """Records of albums whose content a timeline record has too; these may go, and the rest is what only albums have.

    current: state(). Adds `removable`. Records without success, hash or output don't take part.
    """
    kept = current.filter(successful(F.col("status")) & (F.coalesce("source_hash", F.lit("")) != "") & (F.coalesce("output_path", F.lit("")) != ""))
    timeline = kept.filter(is_timeline(F.col("source_rel_path"))).select("source_hash").distinct().withColumn("removable", F.lit(True))
    return kept.filter(~is_timeline(F.col("source_rel_path"))).join(timeline, "source_hash", "left").withColumn("removable", F.coalesce("removable", F.lit(False)))


def album_summary(current: DataFrame, size: str = "source_size") -> DataFrame:
    """One row: timeline_hashes, album_files_scanned, duplicate_files_removed, bytes_matched."""
    kept = current.filter(successful(F.col("status")) & (F.coalesce("source_hash", F.lit("")) != "") & (F.coalesce("output_path", F.lit("")) != "") & is_timeline(F.col("source_rel_path")))
    hashes = kept.agg(F.count_distinct("source_hash").alias("timeline_hashes"))
    gone = F.col("removable")
    albums = album_copies(current).agg(F.count(F.lit(1)).alias("album_files_scanned"), F.count_if(gone).alias("duplicate_files_removed"), F.coalesce(F.sum(F.when(gone, F.col(size))), F.lit(0)).alias("bytes_matched"))
    return hashes.crossJoin(albums)  # one row each


def emptied_folders(copies: DataFrame) -> DataFrame:
    """depth, folder of albums that lose all of their files, the longest paths first."""
    folder = F.regexp_replace(F.translate("output_path", "\\", "/"), r"/[^/]*\z", "")
    return copies.groupBy(folder.alias("folder")).agg(F.bool_and("removable").alias("empty")).filter("empty").select(F.char_length("folder").alias("depth"), "folder").orderBy(F.desc("depth"), "folder")


def archives(entries: DataFrame, order: list[str]) -> DataFrame:
    """The latest manifest entry of each fingerprint, its status in today's words, with `skip`, `legacy` and `interrupted`.

    skip: done by this version of the workflow; legacy: done by another one;
    interrupted: under way when the last run ended.
    """
    last = latest(entries.withColumn("status", status_now(F.col("status"))), ["zip_fingerprint"], order)
    done, current = F.coalesce(F.col("status").isin(*DONE), F.lit(False)), F.coalesce(F.col("workflow_version") == WORKFLOW, F.lit(False))
    return last.withColumns({"skip": done & current, "legacy": done & ~current, "interrupted": F.coalesce(F.col("status").isin(*ACTIVE), F.lit(False))})


def mark_interrupted(current: DataFrame, at: Column) -> DataFrame:
    """The log rows to append for archives that were under way: status interrupted, ended at `at`, with the reason."""
    return current.filter("interrupted").withColumns({"status": F.lit("interrupted"), "end_time": at, "error_text": F.lit(INTERRUPTED)}).drop("skip", "legacy", "interrupted")


def not_listed(archives: DataFrame, names: DataFrame, path: str = "zip_path", name: str = "zip_name") -> DataFrame:
    """Archives that no skipped name means, by file name or by path, without case; blank names mean nothing."""
    from argentum.functions.names import strip
    from argentum.functions.paths import clean

    skipped = names.select(strip(F.col(names.columns[0])).alias("s")).filter("s <> ''").select(F.lower(F.element_at(F.split(clean(F.col("s")), "/"), -1)).alias("__base"), F.lower(clean(F.col("s"))).alias("__path"))
    by_name = archives.join(skipped.select("__base").distinct(), F.lower(F.col(name)) == F.col("__base"), "left_anti")
    return by_name.join(skipped.select("__path").distinct(), F.lower(clean(F.col(path))) == F.col("__path"), "left_anti")
