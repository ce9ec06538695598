"""Pairs of a still and its motion video, from the state and from where files lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions.names import kind, media_stem
from argentum.functions.paths import clean, slashes
from argentum.operators.records import state_key

# What came of a pair.
MERGED, ALREADY, FAILED, TIMED_OUT, EARLIER = "merged", "already-merged", "failed", "timed-out", "skipped-previous-failure"


def path_key(still: Column, video: Column) -> Column:
    return F.lower(F.concat(clean(still), F.lit("|"), clean(video)))


def _expected(own: str, other: str, rel: str, source: str) -> Column:
    """Where a file lies: its output, else beside the other one's output, else its source."""
    folder = F.regexp_replace(slashes(F.col(other)), r"/?[^/]*\z", "")
    name = F.regexp_extract(slashes(F.col(rel)), r"([^/]*)\z", 1)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return F.when(~blank(own), F.col(own)).when(~blank(other), F.concat(folder, F.lit("/"), name)).otherwise(F.col(source))


def from_state(current: DataFrame) -> DataFrame:
    """key, still_path, video_path of records that name a partner of the other kind; each pair of paths once.

    current: state() with partner_rel_path.
    """
    side = lambda p: current.select(*(F.col(c).alias(f"{p}{c}") for c in ("state_key", "source_id", "source_path", "source_rel_path", "output_path")), *([F.col("partner_rel_path")] if p == "a_" else []))
    a = side("a_").filter(F.coalesce("partner_rel_path", F.lit("")) != "").withColumn("b_state_key", state_key(F.col("a_source_id"), F.col("partner_rel_path")))
    both = a.join(side("b_"), "b_state_key")
    video = lambda c: F.coalesce(kind(F.col(c)) == "video", F.lit(False))
    both = both.filter(video("a_source_rel_path") != video("b_source_rel_path"))
    swap = video("a_source_rel_path")
    both = both.withColumns({"a_path": _expected("a_output_path", "b_output_path", "a_source_rel_path", "a_source_path"), "b_path": _expected("b_output_path", "a_output_path", "b_source_rel_path", "b_source_path")})
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    found = both.select(pick("a_path", "b_path").alias("still_path"), pick("b_path", "a_path").alias("video_path"), F.coalesce(pick("a_source_id", "b_source_id"), F.lit("")).alias("s"), pick("a_source_rel_path", "b_source_rel_path").alias("sr"), pick("b_source_rel_path", "a_source_rel_path").alias("vr"))
    found = found.withColumns({"path_key": path_key(F.col("still_path"), F.col("video_path")), "key": F.concat(F.lit("state|"), F.lower(F.concat_ws("|", "s", "sr", "vr")))})
    return found.groupBy("path_key").agg(F.min(F.struct("key", "still_path", "video_path")).alias("p")).select("path_key", "p.key", "p.still_path", "p.video_path")


def by_rank(files: DataFrame, path: str) -> DataFrame:
    """key, still_path, video_path: of one folder and stem the first still with the first video, the second with the second and so on, by path."""
    rows = files.select(F.col(path).alias("path"), kind(F.col(path)).alias("kind")).filter("kind is not null").distinct()
    rows = rows.withColumns({"dir": F.lower(F.regexp_replace(clean(F.col("path")), r"/?[^/]*\z", "")), "stem": media_stem(F.regexp_extract(slashes(F.col("path")), r"([^/]*)\z", 1))}).filter("stem <> ''")
    # Only stems of both kinds can make pairs; others need no ranks.
    mixed = rows.groupBy("dir", "stem").agg(F.count_if(F.col("kind") == "image").alias("i"), F.count_if(F.col("kind") == "video").alias("v")).filter("i > 0 and v > 0").select("dir", "stem")
    ranked = rows.join(mixed, ["dir", "stem"], "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("dir", "stem", "kind").orderBy("path")))
    still = ranked.filter("kind = 'image'").select("dir", "stem", "rank", F.col("path").alias("still_path"))
    video = ranked.filter("kind = 'video'").select("dir", "stem", "rank", F.col("path").alias("video_path"))
    both = still.join(video, ["dir", "stem", "rank"])
    return both.withColumn("path_key", path_key(F.col("still_path"), F.col("video_path"))).select("path_key", F.concat(F.lit("path|"), F.col("path_key")).alias("key"), "still_path", "video_path")


def candidates(current: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Pairs of the state, and of where files lie those that the state hasn't."""
    known = from_state(current)
    more = by_rank(files, path).join(known.select("path_key"), "path_key", "left_anti")
    return known.unionByName(more)


def resume(pairs: DataFrame, log: DataFrame, order: list[str], retry_failed: bool = False) -> DataFrame:
    """The pairs with `outcome`: already merged, skipped after an earlier failure, or null where the merge is to be run."""
    from argentum.operators.records import latest

    last = latest(log, ["key"], order).select("key", F.col("status").alias("__s"))
    failed = F.col("__s").isin(FAILED, TIMED_OUT) & ~F.lit(retry_failed)
    return pairs.join(last, "key", "left").withColumn("outcome", F.when(F.col("__s").isin(MERGED, ALREADY), ALREADY).when(failed, EARLIER)).drop("__s")


def outcomes(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count(F.lit(1)).alias("items"))
