"""Text cut off by field limits.

A value that ends in a complete file extension or needs none ends in a
*terminal*; the lengths of a column's values are counted for each source, in
characters and in bytes, of the values without a terminal and of the stems
before a kept extension. A field limit shows as a spike: a length that many
more values have than the lengths around it. Values at a spike without
terminal punctuation are flagged.

Cuts in mid-transfer have no common length. They are found by their ends: a
piece of an extension, a mark of omission, a torn character, or an end that
complete names of the corpus don't have, or have too seldom beside the values
without extension that end so. A sidecar's own name serves as the
exact check where it goes on after the title's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions.text import fold
from argentum.session import cut

# Extensions of media files.
EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "gif", "webp", "tif", "tiff", "bmp", "dng", "raw", "mp4", "mov", "m4v", "avi", "mkv", "3gp", "mts", "mpg", "mpeg", "wmv", "webm")

#: Characters that the name of a sidecar keeps of the name it belongs to.
NAME_LIMIT = 46
#: A spike has at least LEAST different values, and TIMES as many as the lengths within AROUND have on average.
LEAST, TIMES, AROUND = 4, 4.0, 6
#: Share of values with an unknown end from which the spike of a kept extension is a limit.
TORN = 0.4
#: An end is known if at least KNOWN complete values have it, and of the values without extension off the spikes one only or at most RATE times as many.
KNOWN, RATE = 3, 1 / 16
UNITS = ("chars", "bytes")

_whole = "|".join(EXTENSIONS)
_pieces = "|".join(sorted({e[:k] for e in EXTENSIONS for k in range(1, len(e))} - set(EXTENSIONS)))
EXTENSION = rf"(?i)\.(?:{_whole})$"
PIECE = rf"(?i)\.(?:{_pieces})?$"
MARK = r"(?:\.\.\.|…|�)$"
SHORT = r"^[^~]{1,8}~\d+(?:\.\w{1,3})?$"
#: A number or an edit mark that stands after a whole name.
SUFFIX = r"(?:\(\d+\)|-(?:edited|bearbeitet|editado|modifi[eé]\x{301}?|編集済み))$"
#: What follows a name in the name of its sidecar: a piece of the supplement's word, a number, .json.
_word = "supplemental-metadata"
SUPPLEMENT = r"(?i)(?:\.(?:" + "|".join(_word[:k] for k in range(len(_word), 1, -1)) + r"))?(?:\(\d+\))?\.json$"


def values(sidecar: DataFrame, media: DataFrame) -> DataFrame:
    """rec_id, field_name, source_id, value, beside of all values that aren't null; beside is the sidecar's own name."""
    titles = sidecar.select(F.col("sidecar_id").alias("rec_id"), F.lit("title").alias("field_name"), "source_id", F.col("title").alias("value"), F.col("sidecar_name").alias("beside"))
    files = media.select(F.col("media_id").alias("rec_id"), F.lit("file_name").alias("field_name"), "source_id", F.col("file_name").alias("value"), F.lit(None).cast("string").alias("beside"))
    return titles.unionByName(files).filter("value is not null")


def last_end(value: Column) -> Column:
    """The end of a name by which complete ones are known: its last word, or the shapes of its last two parts if the last has digits."""
    parts = F.split(fold(value), " ")
    last, before = F.element_at(parts, -1), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    shape = lambda x: F.regexp_replace(x, r"\d", "9")
    return F.when(last.rlike(r"\d"), F.concat(shape(before), F.lit(" "), shape(last))).otherwise(last)


def features(rows: DataFrame) -> DataFrame:
    """rec_id, field_name, source_id, form, chars, bytes, end, key, sign, on of each value.

    form: `stem` (a complete extension is kept), `suffix` (so, after a number
    or an edit mark) or `open`. chars and bytes: the length of the stem. sign:
    whether the end itself shows the loss. on: whether the sidecar's own name
    goes on after it (true), ends with it (false) or says nothing (null). key:
    a hash of source and value.
    """
    v = F.col("value")
    stem = F.regexp_replace(v, EXTENSION, "")
    form = F.when(~v.rlike(EXTENSION), "open").when(stem.rlike(SUFFIX), "suffix").otherwise("stem")
    sign = v.rlike(SHORT) | v.rlike(MARK) | v.rlike(PIECE)
    own = F.regexp_replace(F.regexp_replace(F.col("beside"), SUPPLEMENT, ""), EXTENSION, "")
    here, there = F.regexp_replace(fold(v), " ", ""), F.regexp_replace(fold(own), " ", "")
    on = F.when((form == "open") & (here != "") & there.startswith(here), F.when(F.length(there) > F.length(here), True).when(F.char_length(own) < NAME_LIMIT, False))
    return rows.select("rec_id", "field_name", "source_id", form.alias("form"), F.char_length(stem).alias("chars"), F.octet_length(stem).alias("bytes"), last_end(stem).alias("end"), F.xxhash64("source_id", "value").alias("key"), sign.alias("sign"), on.alias("on"))


def spikes(measured: DataFrame) -> DataFrame:
    """source_id, field_name, form, unit, length, values, expected: the spikes of the length histograms.

    Different values are counted, as a rescanned file repeats its name. Names
    that end in numbers are left out: cameras give them fixed lengths.
    expected: the average count of the lengths within AROUND, the spike left
    out. A histogram has a row for each length that occurs, so its size
    doesn't grow with the data. Null sources are a source of their own.
    """
    words = measured.filter(F.col("form").isin("open", "stem") & ~F.col("end").rlike(r"\d"))
    both = words.select("source_id", "field_name", "form", "chars", "bytes", "key").distinct().select("source_id", "field_name", "form", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS))).alias("m"))
    counts = both.groupBy("source_id", "field_name", "form", "m.unit", "m.length").agg(F.count(F.lit(1)).alias("values"))
    around = Window.partitionBy("source_id", "field_name", "form", "unit").orderBy("length").rangeBetween(-AROUND, AROUND)
    expected = (F.sum("values").over(around) - F.col("values")) / (2 * AROUND)
    return counts.withColumn("expected", expected).filter((F.col("values") >= LEAST) & (F.col("values") >= TIMES * F.greatest(F.col("expected"), F.lit(0.5))))


def at_limit(rows: DataFrame, limits: DataFrame, name: str) -> DataFrame:
    """Adds whether a value has the length of a spike of its source, or of any source where its own is null."""
    for unit in UNITS:
        known = limits.filter((F.col("unit") == unit) & F.col("source_id").isNotNull()).select("source_id", "field_name", "form", F.col("length").alias(unit))
        anywhere = known.drop("source_id").distinct().withColumn(f"any_{unit}", F.lit(True))
        rows = rows.join(known.withColumn(f"at_{unit}", F.lit(True)), ["source_id", "field_name", "form", unit], "left").join(anywhere, ["field_name", "form", unit], "left")
    hit = F.coalesce(*(F.col(f"at_{u}") for u in UNITS), F.lit(False)) | (F.col("source_id").isNull() & F.coalesce(*(F.col(f"any_{u}") for u in UNITS), F.lit(False)))
    return rows.withColumn(name, hit).drop(*(f"{a}_{u}" for a in ("at", "any") for u in UNITS))


def truncated(sidecar: DataFrame, media: DataFrame) -> DataFrame:
    """rec_id, field_name, source_id, cut, why of every value that isn't null.

    why: `sign` (a mark, a piece of an extension, a torn character), `spike`,
    `goes on` (in the sidecar's own name), `unknown end`; null where cut is
    false. Empty values are complete. A value with a null source is held
    against the spikes of all sources. A source without a limit has no spike;
    a value at a spike counts as complete where a title of the same source
    names it with the same extension, or the sidecar's own name ends with it.
    Repeated rows are judged alike; extra columns are ignored; empty tables
    give no rows.
    """
    rows = cut(features(values(sidecar, media)), "names")
    limits = cut(spikes(rows), "spikes").select("source_id", "field_name", "form", "unit", "length").distinct()
    rows = at_limit(rows, limits, "maybe")
    complete = (F.col("form") == "stem") & ~F.col("maybe") & ~F.col("sign") & F.col("source_id").isNotNull()
    loose = (F.col("form") == "open") & ~F.col("maybe") & ~F.col("sign") & F.col("on").isNull()
    tallied = rows.filter(complete | loose).groupBy("end").agg(F.count_if(complete).alias("n"), F.count_if(loose).alias("o"))
    ends = cut(tallied.filter((F.col("n") >= KNOWN) & (F.col("o") <= F.greatest(F.lit(1.0), F.col("n") * RATE))).select("end", F.lit(True).alias("known")), "ends")
    # A kept extension shows a limit only where the values before it are torn.
    torn = rows.filter((F.col("form") == "stem") & F.col("maybe")).join(ends, "end", "left").groupBy("source_id", "field_name", "form", *UNITS).agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("k"))
    each = torn.select("source_id", "field_name", "form", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS))).alias("m"), "n", "k")
    sure = each.groupBy("source_id", "field_name", "form", "m.unit", "m.length").agg((1 - F.sum("k") / F.sum("n")).alias("torn")).filter(F.col("torn") >= TORN).drop("torn")
    limits = limits.filter("form = 'open'").unionByName(limits.join(sure, ["source_id", "field_name", "form", "unit", "length"], "left_semi"))
    rows = at_limit(rows, limits, "spike")
    named = rows.filter((F.col("field_name") == "title") & (F.col("form") == "stem")).select("key", F.lit(True).alias("whole")).distinct()
    doubtful = rows.filter((F.col("form") == "open") | F.col("spike"))
    judged = doubtful.join(ends, "end", "left").join(named, "key", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "whole": F.coalesce("whole", F.lit(False))})
    why = (
        F.when(F.col("end") == "", F.lit(None))
        .when(F.col("sign"), "sign")
        .when(F.col("on"), "goes on")
        .when(F.col("spike") & (F.col("form") == "open") & F.coalesce(F.col("on"), F.lit(True)), "spike")
        .when(F.col("spike") & (F.col("form") == "stem") & ~F.col("whole") & (F.col("source_id").isNotNull() | ~F.col("known")), "spike")
        .when((F.col("form") == "open") & ~F.col("spike") & F.col("on").isNull() & ~F.col("known"), "unknown end")
    )
    sure = rows.filter((F.col("form") != "open") & ~F.col("spike")).select("rec_id", "field_name", "source_id", F.when(F.col("sign"), "sign").alias("why"))
    everything = judged.select("rec_id", "field_name", "source_id", why.alias("why")).unionByName(sure)
    return everything.select("rec_id", "field_name", "source_id", F.col("why").isNotNull().alias("cut"), "why")


def report(sidecar: DataFrame, media: DataFrame) -> DataFrame:
    """How often each source truncates: source_id, field_name, records, cut, share."""
    counted = truncated(sidecar, media).groupBy("source_id", "field_name").agg(F.count(F.lit(1)).alias("records"), F.count_if("cut").alias("cut"))
    return counted.withColumn("share", F.col("cut") / F.col("records"))
