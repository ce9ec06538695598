"""Dates of captures: epoch texts, embedded times, dates in file names and the cascade that picks one.

Instants are whole numbers, seconds or microseconds since 1970 in UTC, as
epoch texts may lie far outside of what a timestamp holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from argentum.functions.names import strip

# A date in a file name, and the two shapes of an embedded time.
IN_NAME = r"([12][0-9]{3})[-_.]?([01][0-9])[-_.]?([0-3][0-9])"
COLONS = r"^(\d{4}):(\d{2}):(\d{2}) (\d{1,2}):(\d{2}):(\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})?\z"
RFC3339 = r"^(\d{4})-(\d{2})-(\d{2})T(\d{1,2}):(\d{2}):(\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"
NUMERIC_OFFSET = r"^[+-]\d{2}:\d{2}\z"
# Which tags give an embedded capture time, in the order in which photos and videos try them.
PHOTO_TAGS = ("DateTimeOriginal", "CreateDate", "XMP:CreateDate", "Photoshop:DateCreated", "CreationDate", "QuickTime:CreateDate", "TrackCreateDate", "MediaCreateDate")
VIDEO_TAGS = ("DateTimeOriginal", "CreationDate", "CreateDate", "XMP:CreateDate", "Photoshop:DateCreated", "QuickTime:CreateDate", "TrackCreateDate", "MediaCreateDate")
# Other names under which readers report a tag.
OTHER_NAMES = {"DateTimeOriginal": "EXIF:DateTimeOriginal", "CreateDate": "EXIF:CreateDate", "XMP:CreateDate": "XMP-xmp:CreateDate", "Photoshop:DateCreated": "DateCreated", "CreationDate": "Keys:CreationDate"}


def epoch_seconds(text: Column) -> Column:
    """The seconds of an epoch text; null where it is no whole number."""
    number = strip(text)
    return F.when(number.rlike(r"^[+-]?\d+\z"), number.try_cast("bigint"))


def best_seconds(taken: Column, created: Column) -> Column:
    """The time of capture, else that of creation."""
    return F.coalesce(epoch_seconds(taken), epoch_seconds(created))


def flexible_us(text: Column, fallback: Column) -> Column:
    """Microseconds of an embedded time: with its own offset, else the fallback offset, else as UTC. Null where it is none."""
    t = strip(text)
    own = F.regexp_extract(t, COLONS, 8)
    zone = F.when(own != "", own).when(fallback.rlike(NUMERIC_OFFSET), fallback).otherwise("Z")
    plain = F.when(t.rlike(COLONS), F.concat(F.regexp_replace(t, COLONS, "$1-$2-$3 $4:$5:$6$7"), zone)).when(t.rlike(RFC3339), F.regexp_replace(t, RFC3339, "$1-$2-$3 $4:$5:$6$7$8"))
    return F.unix_micros(plain.try_cast("timestamp"))


def embedded_time(tags: Column, fallback: Column, is_video: Column) -> Column:
    """source and us of the first tag in order that is a time; tags: a map of texts."""
    other = F.create_map(*(F.lit(x) for pair in OTHER_NAMES.items() for x in pair))
    own = lambda n: F.nullif(strip(F.try_element_at(tags, n)), F.lit(""))
    value = lambda tag: F.coalesce(own(tag), own(F.try_element_at(other, tag)))
    order = F.when(is_video, F.array(*(F.lit(t) for t in VIDEO_TAGS))).otherwise(F.array(*(F.lit(t) for t in PHOTO_TAGS)))
    found = F.transform(order, lambda tag: F.struct(tag.alias("source"), flexible_us(value(tag), fallback).alias("us")))
    return F.try_element_at(F.filter(found, lambda x: x["us"].isNotNull()), F.lit(1))


def name_date(name: Column) -> Column:
    """The first date in a file name that exists and has no digit before or after it.

    Matches don't overlap: one that is refused has used up its text.
    """
    marked = F.regexp_replace(strip(name), IN_NAME, "\x01$1-$2-$3\x02")
    found = F.regexp_extract_all(marked, F.lit("(?<![0-9\x02])\x01([^\x02]+)\x02(?![0-9\x01])"), F.lit(1))
    return F.try_element_at(F.filter(F.transform(found, lambda d: d.try_cast("date")), lambda d: d.isNotNull()), F.lit(1))


def folder_date(taken_s: Column, embedded_us: Column, embedded_source: Column, named: Column, year: Column, written_us: Column) -> Column:
    """us, source, month_known of the date that decides an output folder.

    In order: the sidecar's capture time, the embedded time, a date in the
    file name unless it contradicts the year folder, the year folder, the time
    of the file.
    """
    noon = lambda d: F.unix_date(d).cast("bigint") * 86_400_000_000 + 43_200_000_000
    choice = lambda us, source, known: F.struct(us.alias("us"), source.alias("source"), F.lit(known).alias("month_known"))
    source = F.concat(F.lit("embedded"), F.when(F.coalesce(embedded_source, F.lit("")) != "", F.concat(F.lit(":"), embedded_source)).otherwise(""))
    # Beyond the years that a timestamp holds a second count gives no folder.
    in_range = taken_s.between(-62_135_596_800, 253_402_300_799)
    return (
        F.when(in_range, choice(taken_s * 1_000_000, F.lit("google-sidecar-photoTakenTime"), True))
        .when(embedded_us.isNotNull(), choice(embedded_us, source, True))
        .when(named.isNotNull() & (year.isNull() | (F.year(named) == year)), choice(noon(named), F.lit("filename-date"), True))
        .when(year.isNotNull(), choice(noon(F.make_date(year, F.lit(1), F.lit(1))), F.lit("google-timeline-folder-year"), False))
        .when(written_us.isNotNull(), choice(written_us, F.lit("file-modified"), True))
    )


def fixed_offset(offset: Column) -> Column:
    """Seconds of an offset text of six characters; any other is UTC, digits that are none count as 0."""
    part = lambda at: F.coalesce(F.substring(offset, at, 2).try_cast("int"), F.lit(0))
    size = part(2) * 3600 + part(5) * 60
    return F.when(F.octet_length(offset) == 6, F.when(offset.startswith("-"), -size).otherwise(size)).otherwise(0)


def offset_text(seconds: Column) -> Column:
    s = F.abs(seconds).cast("int")
    return F.format_string("%s%02d:%02d", F.when(seconds < 0, "-").otherwise("+"), (s / 3600).cast("int"), (s % 3600 / 60).cast("int"))


def capture_offset(lat: Column, lon: Column, offset: Column, known: Column | None = None) -> Column:
    """Seconds that the wall clock of a capture is ahead of UTC.

    With a place: `known`, the offset that a zone table has for it, else the
    hours of its longitude. Without one: the embedded offset, else UTC.
    """
    by_longitude = F.round(lon / 15).cast("int") * 3600
    placed = F.coalesce((lat != 0) | (lon != 0), F.lit(False))
    return F.when(placed, by_longitude if known is None else F.coalesce(known, by_longitude)).when(F.coalesce(offset, F.lit("")) != "", fixed_offset(offset)).otherwise(0)


def rfc3339(seconds: Column) -> Column:
    """An instant as yyyy-MM-ddTHH:mm:ssZ; null beyond the year 9999."""
    return F.when(seconds.between(-62_135_596_800, 253_402_300_799), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
