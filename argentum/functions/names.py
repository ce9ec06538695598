"""Names of media files and sidecars: extensions, stems and the keys by which they meet.

Lengths and cuts are in bytes. The functions that take a DataFrame add one
column; what they need on the way are columns of their own, so that each step
is evaluated once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The extensions of media, and the white space that is trimmed.
IMAGES = (".jpg", ".jpeg", ".png", ".heic")
VIDEOS = (".3gp", ".avi", ".m4v", ".mkv", ".mov", ".mp4")
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# A number before the extension, one after it, one after a dash, and the name of a supplement.
BEFORE = r"^([^\n]*)\((\d+)\)(\.[^.]+)\z"
AFTER = r"^([^\n]*)(\.[^.]+)\((\d+)\)\z"
DASH = r"^([^\n]*)-(\d+)\z"
MEANT = r"(\.[^.]+)\(\d+\)\z|(\.[^./]*)\z"
SUPPLEMENT = r"(?i)^([^\n]*)\.supplemental-metadata(?:\((\d+)\))?\.json\z"
EDITED = "-edited"
#: Bytes at which exports cut names.
LIMIT = 46
#: Bytes that two names must share at their beginnings.
PREFIX = 20


def strip(text: Column) -> Column:
    """Text without white space around it."""
    return F.btrim(text, F.lit(SPACES))


def extension(name: Column) -> Column:
    """From the last dot of the last component on; empty if it has none."""
    return F.regexp_extract(name, r"(\.[^./]*)\z", 1)


def without(name: Column, end: Column) -> Column:
    """A name without an end that it is known to have; counted in bytes, as a cut name may hold half a character."""
    return F.when(end == "", name).otherwise(head_bytes(name, F.octet_length(name) - F.octet_length(end)))


def strip_json(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.json\z", "")


def head_bytes(text: Column, count: Column | int) -> Column:
    """The first bytes of a text, even where they end within a character."""
    return F.substring(text.cast("binary"), 1, count if isinstance(count, Column) else F.lit(count)).cast("string")


def kind(name: Column) -> Column:
    """image, video or null."""
    ext = F.lower(extension(name))
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*VIDEOS), "video")


def semantic_extension(name: Column) -> Column:
    """The extension that a name means: that before a number at its end, else its own; in lower case, without `.json`."""
    n = F.lower(strip(strip_json(name)))
    return F.concat(F.regexp_extract(n, MEANT, 1), F.regexp_extract(n, MEANT, 2))  # one of them is empty


def media_stem(name: Column) -> Column:
    """The name in lower case without its extension, with a number that stands after the extension."""
    n = F.lower(strip(name))
    return F.when(n.rlike(AFTER), F.regexp_replace(n, AFTER, "$1($3)")).otherwise(without(n, extension(n)))


def with_supplement_names(rows: DataFrame, name: str, out: str) -> DataFrame:
    """Adds the media names, in lower case, that a supplement's name stands for; an empty array for other names."""
    m, e = F.col("__m"), F.col("__e")
    rows = rows.withColumn("__n", F.lower(strip(F.col(name))))
    rows = rows.withColumns({"__m": F.regexp_extract("__n", SUPPLEMENT, 1), "__k": F.regexp_extract("__n", SUPPLEMENT, 2), "__is": F.coalesce(F.col("__n").rlike(SUPPLEMENT), F.lit(False))})
    rows = rows.withColumns({"__e": extension(m), "__k": F.concat(F.lit("("), "__k", F.lit(")"))})
    found = F.when(F.col("__k") == "()", F.array(m)).when(e == "", F.array(F.concat(m, "__k"))).otherwise(F.array(F.concat(without(m, e), "__k", e), F.concat(m, "__k")))
    return rows.withColumn(out, F.when(F.col("__is"), found).otherwise(F.array().cast("array<string>"))).drop("__n", "__m", "__k", "__is", "__e")


def _unique(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))


def _cut(text: Column, count: int) -> Column:
    """The first bytes of a text without a space at their end."""
    return F.rtrim(head_bytes(text, count))


def with_name_keys(rows: DataFrame, name: str, keys: str) -> DataFrame:
    """Adds the keys of a name: itself, its stem, and both without edit mark, number after a dash or number in brackets, and cut at LIMIT bytes.

    A null or empty name has no keys.
    """
    n, e, s = F.col("__n"), F.col("__e"), F.col("__s")
    rows = rows.withColumn("__n", F.lower(strip(strip_json(F.col(name)))))
    rows = rows.withColumn("__e", extension(n)).withColumn("__s", without(n, e))
    before = F.substring_index(s, EDITED, 1)
    unedited = F.concat(before, F.substring(s, F.char_length(before) + len(EDITED) + 1, F.char_length(s)))
    undashed = F.regexp_extract(s, DASH, 1)
    rows = rows.withColumns({"__u": F.when(s.contains(EDITED), unedited), "__d": F.when(s.rlike(DASH), undashed)})
    u, d = F.col("__u"), F.col("__d")
    number = F.when(n.rlike(BEFORE), F.array(F.regexp_replace(n, BEFORE, "$1$3"), F.regexp_replace(n, BEFORE, "$1$3($2)")))
    later = F.when(n.rlike(AFTER), F.array(F.regexp_replace(n, AFTER, "$1($3)$2"), F.regexp_replace(n, AFTER, "$1$2")))
    long = F.when(F.octet_length(n) > LIMIT, F.array(_cut(n, LIMIT), F.when((e != "") & (F.octet_length(s) > LIMIT), F.concat(head_bytes(s, LIMIT), e))))
    none = F.array().cast("array<string>")
    short = F.concat(F.array(n, s, F.concat(u, e), u, F.concat(d, e), d), F.coalesce(number, none), F.coalesce(later, none))
    rows = rows.withColumn("__f", short).withColumn("__f", F.concat(_unique(F.col("__f")), F.coalesce(long, none)))
    return rows.withColumn(keys, F.when(n != "", F.array_distinct(F.array_compact("__f"))).otherwise(none)).drop("__f").drop("__n", "__e", "__s", "__u", "__d")


def partner_keys(keys: Column) -> Column:
    """The keys by which an image and a video meet: name keys without their extension, each also with a number that stood after it."""
    each = F.transform(
        keys,
        lambda k: F.when(k.rlike(AFTER), F.array(F.regexp_extract(k, AFTER, 1), F.regexp_replace(k, AFTER, "$1($3)"))).otherwise(F.array(F.trim(without(k, extension(k))))),
    )
    return F.array_distinct(F.filter(F.flatten(each), lambda x: x != ""))


def common_prefix(a: Column, b: Column) -> Column:
    """How many bytes two texts share at their beginnings."""
    x, y = F.hex(a.cast("binary")), F.hex(b.cast("binary"))
    most = F.least(F.octet_length(a), F.octet_length(b))
    at = lambda t, i: F.substring(t, 2 * i - 1, F.lit(2))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), most), lambda i: at(x, i) == at(y, i)), False)
    return F.when(most == 0, 0).when(differs == 0, most).otherwise((differs - 1).cast("int"))


def unique_names(rows: DataFrame, path: str, order: list[str], taken: DataFrame, out: str) -> DataFrame:
    """Adds a path that no other row and no taken path has: `name (2).ext`, `name (3).ext` and so on for all but the first of equal paths.

    Paths are compared without case. taken: a column of the same name with
    paths that are in use; numbers that these have are skipped. The rows of
    equal paths are numbered in order; nulls stay null. Numbers of one path
    are free in every other group unless a name already ends in one; such
    names count as taken.
    """
    from pyspark.sql import Window

    key = F.lower(F.col(path))
    numbered = r"^(.*) \((\d+)\)(\.[^./]*)?\z"
    used = taken.select(F.col(path).alias("__p")).unionByName(rows.select(F.col(path).alias("__p"))).filter("__p is not null").select(F.lower("__p").alias("__p")).distinct()
    spent = used.filter(F.col("__p").rlike(numbered)).select(F.regexp_replace("__p", numbered, "$1$3").alias("__k"), F.regexp_extract("__p", numbered, 2).try_cast("bigint").alias("__no")).filter("__no >= 2").groupBy("__k").agg(F.array_sort(F.collect_set("__no")).alias("__used"))
    here = taken.select(F.lower(F.col(path)).alias("__k")).distinct().withColumn("__there", F.lit(1))
    ranked = rows.withColumn("__k", key).withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy(*order)))
    ranked = ranked.join(here, "__k", "left").join(spent, "__k", "left")
    wanted = F.col("__r") + F.coalesce("__there", F.lit(0))
    # The wanted-th free number: one more for each used number that is not above it.
    number = F.aggregate(F.coalesce("__used", F.array().cast("array<bigint>")), wanted.cast("bigint"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    ext = extension(F.col(path))
    fresh = F.concat(without(F.col(path), ext), F.lit(" ("), number.cast("string"), F.lit(")"), ext)
    return ranked.withColumn(out, F.when(wanted == 1, F.col(path)).when(F.col(path).isNotNull(), fresh)).drop("__k", "__r", "__there", "__used")
