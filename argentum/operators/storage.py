"""Archives, drives, work folders and downloads: sizes, choices and what overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions.names import kind, strip
from argentum.functions.paths import overlap, safe_entry

# The margin of a work folder, of a move, and the downloads that run at once.
MARGIN, SPARE, RUNNING = 25 << 30, 20 << 30, 5


def archive_stats(entries: DataFrame) -> DataFrame:
    """archive, uncompressed_bytes, media_files: folders and unsafe names count for nothing."""
    files = entries.filter(~F.coalesce("is_dir", F.lit(False)))
    media = kind(safe_entry(F.col("entry_name"))["path"]).isNotNull()
    return files.groupBy("archive").agg(F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("uncompressed_bytes"), F.count_if(media).alias("media_files"))


def required_bytes(size: Column, uncompressed: Column, margin: int = MARGIN) -> Column:
    """Bytes that a work folder needs for an archive."""
    return F.greatest(F.coalesce(size, F.lit(0)), F.coalesce(uncompressed, F.lit(0))) + F.lit(margin if margin > 0 else MARGIN)


def preflight(archives: DataFrame, margin: int = MARGIN) -> DataFrame:
    """archives, total_bytes, media_files, largest_bytes, required_bytes in one row; zeros where there are none."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    need = required_bytes(F.col("size_bytes"), F.col("uncompressed_bytes"), margin)
    return archives.agg(F.count(F.lit(1)).alias("archives"), zero(F.sum("size_bytes")).alias("total_bytes"), zero(F.sum("media_files")).alias("media_files"), zero(F.max("size_bytes")).alias("largest_bytes"), zero(F.max(need)).alias("required_bytes"))


def drive_kind(*texts: Column) -> Column:
    """SSD, HDD or unknown, by words in the texts that describe a drive."""
    said = F.lower(F.concat_ws(" ", *texts))
    return F.when(said.contains("ssd") | said.contains("solid state"), "SSD").when(said.contains("hdd") | said.contains("hard disk"), "HDD").otherwise("unknown")


def rank(kind: Column) -> Column:
    return F.when(kind == "SSD", 2).when(kind.isNull() | kind.isin("unknown", ""), 1).otherwise(0)


def with_kind(roots: DataFrame, drives: DataFrame) -> DataFrame:
    """Work folders with the kind of the drive that their path begins with; unknown where none is listed."""
    letter = F.upper(F.regexp_extract("path", r"^([A-Za-z]:)", 1))
    known = drives.select(F.upper(strip(F.col("letter"))).alias("__l"), F.col("kind").alias("__k")).filter("__l <> ''").groupBy("__l").agg(F.min("__k").alias("__k"))
    return roots.withColumn("__l", letter).join(known, "__l", "left").withColumn("kind", F.coalesce("__k", F.lit("unknown"))).drop("__l", "__k")


def choose_root(needs: DataFrame, roots: DataFrame) -> DataFrame:
    """The needs (column required_bytes) with ord, path of the best folder that has room: kind, then free bytes, then order of the list.

    Each need takes the first of a short list in that order. The folders are
    ranked once; a need takes the lowest rank among the folders with at least
    its bytes free, found in an array of the few ranks that matter: those with
    more room than all that rank before them. Its size is the number of
    folders at most. Folders that aren't usable or have an error don't count.
    """
    usable = roots.filter(F.coalesce("usable", F.lit(True)) & F.col("error").isNull()) if "error" in roots.columns else roots.filter(F.coalesce("usable", F.lit(True)))
    best = F.array_sort(F.collect_list(F.struct((-rank(F.col("kind"))).alias("r"), (-F.col("free_bytes")).alias("f"), F.col("ord").alias("ord"), F.col("path").alias("path"), F.col("free_bytes").alias("free"))))
    ordered = usable.agg(best.alias("__roots"))  # one row
    fits = F.filter("__roots", lambda x: x["free"] >= F.col("required_bytes"))
    return needs.crossJoin(F.broadcast(ordered)).withColumn("__b", F.try_element_at(fits, F.lit(1))).withColumns({"ord": F.col("__b.ord"), "path": F.col("__b.path")}).drop("__b", "__roots")


def only_hdd(roots: DataFrame) -> DataFrame:
    """only_hdd: whether there are work folders and all lie on HDDs."""
    return roots.agg(F.coalesce(F.bool_and(F.col("kind") == "HDD"), F.lit(False)).alias("only_hdd"))


def output_drive(drives: DataFrame, label: str = "Backup B", letter: str = "B:") -> DataFrame:
    """status and root of the output drive: the one with the label, else the one with the letter; `several` of either is an error."""
    by = lambda c, v: F.lower(strip(F.col(c))) == v.lower()
    one = drives.agg(F.count_if(by("label", label)).alias("n"), F.min(F.when(by("label", label), F.col("root"))).alias("a"), F.count_if(by("letter", letter)).alias("m"), F.min(F.when(by("letter", letter), F.col("root"))).alias("b"))
    status = F.when(F.col("n") > 1, "several").when(F.col("n") == 1, "label").when(F.col("m") > 1, "several").when(F.col("m") == 1, "letter").otherwise("none")
    return one.select(status.alias("status"), F.when(F.col("n") == 1, F.col("a")).when((F.col("n") == 0) & (F.col("m") == 1), F.col("b")).alias("root"))


def overlapping(roots: DataFrame) -> DataFrame:
    """first, second: roles and paths of configured folders that are equal or lie in one another.

    roots (role, path) are the few folders of a configuration. A folder can
    only overlap with itself and its ancestors, so each path meets the
    ancestors of the others by equality.
    """
    from argentum.functions.paths import clean

    rows = roots.filter("path is not null").select("role", "path", F.lower(clean(F.col("path"))).alias("c"))
    parts = F.split("c", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when((n == 1) & (F.element_at(parts, 1) == ""), "/").otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    each = rows.select("role", "path", F.explode(F.array_distinct(above)).alias("c"))
    a, b = rows.select(F.col("role").alias("role_a"), F.col("path").alias("path_a"), "c"), each.select(F.col("role").alias("role_b"), F.col("path").alias("path_b"), "c")
    met = a.join(b, "c").filter("role_a <> role_b").filter(overlap(F.col("path_a"), F.col("path_b")))
    order = F.struct("role_a", "path_a") < F.struct("role_b", "path_b")
    flip = lambda x, y: F.when(order, F.col(x)).otherwise(F.col(y))
    return met.select(flip("role_a", "role_b").alias("first_role"), flip("path_a", "path_b").alias("first_path"), flip("role_b", "role_a").alias("second_role"), flip("path_b", "path_a").alias("second_path")).distinct()


def throttle(downloads: DataFrame, limit: int = RUNNING) -> DataFrame:
    """id and action of downloads: the oldest `limit` that run stay, later ones pause; free places go to interrupted ones that can resume, then to paused ones, the oldest first.

    The two groups that are picked have `limit` rows at most, so all that is
    sorted in full are these.
    """
    running = (F.col("state") == "in_progress") & ~F.coalesce("paused", F.lit(False))
    waiting = F.when((F.col("state") == "interrupted") & F.coalesce("can_resume", F.lit(False)), 1).when((F.col("state") == "in_progress") & F.coalesce("paused", F.lit(False)), 2)
    rows = downloads.withColumn("__w", F.when(running, 0).otherwise(waiting)).filter("__w is not null")
    order = ["start_time", "id"]
    kept = rows.filter("__w = 0").orderBy(*order).limit(limit).select("id", F.lit(True).alias("__kept"))
    busy = rows.agg(F.least(F.count_if(F.col("__w") == 0), F.lit(limit)).alias("__busy"))
    first = rows.filter("__w > 0").orderBy("__w", *order).limit(limit)
    queue = first.withColumn("__q", F.row_number().over(Window.orderBy("__w", *order))).select("id", "__q")
    both = rows.join(F.broadcast(kept), "id", "left").join(F.broadcast(queue), "id", "left").crossJoin(F.broadcast(busy))  # one row
    action = F.when(F.col("__kept"), "keep").when(F.col("__w") == 0, "pause").when(F.col("__q") <= F.lit(limit) - F.col("__busy"), "resume").otherwise("wait")
    return both.select("id", action.alias("action"))


def stable_files(seen: DataFrame, seconds: int = 120) -> DataFrame:
    """path, size, since, until of files whose size hasn't changed for at least `seconds`, up to their last sighting, unlocked and readable.

    Sightings of a path fall into islands of equal size; the last island
    decides. Equal sightings count once.
    """
    rows = seen.select("path", "observed_at", "size", F.coalesce("unlocked", F.lit(True)).alias("unlocked"), F.coalesce("readable", F.lit(True)).alias("readable")).filter("path is not null and observed_at is not null").distinct()
    last = rows.groupBy("path").agg(F.max(F.struct("observed_at", "size", "unlocked", "readable")).alias("l")).select("path", F.col("l.observed_at").alias("until"), F.col("l.size").alias("now"), F.col("l.unlocked").alias("u"), F.col("l.readable").alias("r"))
    # The island of the last size begins after the last sighting of any other size.
    joined = rows.join(last, "path")
    other = joined.groupBy("path", "until", "now", "u", "r").agg(F.max(F.when(~F.col("size").eqNullSafe(F.col("now")), F.col("observed_at"))).alias("broke"))
    began = joined.select("path", "observed_at", "size").join(other, "path").filter(F.col("size").eqNullSafe(F.col("now")) & (F.col("broke").isNull() | (F.col("observed_at") > F.col("broke")))).groupBy("path", "until", "now", "u", "r").agg(F.min("observed_at").alias("since"))
    return began.filter(F.col("u") & F.col("r") & (F.col("now") > 0) & (F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp")) >= seconds * 1_000_000)).select("path", F.col("now").alias("size"), "since", "until")


def move_target(files: DataFrame, drives: DataFrame, spare: int = SPARE) -> DataFrame:
    """path, size, root: the drive with the most free bytes that has room for the file and `spare`; null where none has."""
    most = drives.agg(F.max(F.struct(F.col("free_bytes").alias("free"), F.col("root").alias("root"))).alias("m"))  # one row
    return files.crossJoin(F.broadcast(most)).select("path", "size", F.when(F.col("m.free") >= F.col("size") + spare, F.col("m.root")).alias("root"))
