"""Normalising timestamps of many formats, precisions and zones to UTC.

A text is parsed into wall-clock microseconds and a zone: an offset, an
abbreviation, an IANA name or nothing. Where the offset is known the instant
follows directly. Else the wall-clock time is joined as of the zone's offset
intervals. The intervals are exploded into (zone, year) buckets; a bucket
holds the few intervals that touch its year, so the join is an equi-join that
gives one row for each record and no shuffle. Two matching intervals mean
that the time is ambiguous, none that it doesn't exist, one gives the offset.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.functions.text import unaccent, whole
from argentum.session import ship

FIRST_YEAR, LAST_YEAR = 1800, 2199

# The beginnings of month names in English, German, French, Spanish, Italian, Portuguese and Dutch, without marks.
MONTHS = {
    1: ("jan", "ene", "gen"),
    2: ("feb", "fev"),
    3: ("mar", "maa", "mrt"),
    4: ("apr", "abr", "avr"),
    5: ("may", "mai", "mag", "mei"),
    6: ("jun", "juin", "giu"),
    7: ("jul", "juil", "lug"),
    8: ("aug", "ago", "aou"),
    9: ("sep", "set"),
    10: ("oct", "okt", "ott", "out"),
    11: ("nov",),
    12: ("dec", "dez", "dic"),
}

TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(?:([AaPp]\.?[Mm]\.?)(?!\p{L}))?\s*(.*)$"
YEAR_FIRST = r"^(\d{4})[-:/.](\d{1,2})[-:/.](\d{1,2})(?:[T,]|\s)\s*" + TIME
COMPACT = r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?\s*([^\d].*)?$"
NUMBERS = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:,|\s)\s*" + TIME
DAY_NAME = r"^(?:\p{L}+\.?,\s*)?(\d{1,2})\.?\s+(?:de\s+)?(\p{L}+)\.?,?\s+(?:de\s+)?(\d{4})(?:,|\s)\s*" + TIME
NAME_DAY = r"^(?:\p{L}+\.?,\s*)?(\p{L}+)\.?\s+(\d{1,2}),?\s+(\d{4})(?:,|\s)\s*" + TIME
NUMBER = r"^[-+]?\d+(?:\.\d+)?$"


def tidy(text: Column) -> Column:
    """One kind of space and minus, no white space or quotes around."""
    spaced = F.regexp_replace(F.translate(text, "−", "-"), r"[\s\p{Z}]+", " ")
    return F.when(text.rlike(r"^\d+\z"), text).otherwise(F.regexp_replace(spaced, r'^[ "\']+|[ "\']+$', ""))


def epoch(text: Column) -> Column:
    """Microseconds of a bare number that counts from 1970 in the unit its size implies; null for anything else."""
    # Whole numbers of up to 18 digits need no decimals.
    whole = F.when(text.rlike(r"^[-+]?\d{1,18}\z"), text.try_cast("bigint"))
    least = F.abs(whole)
    quick = F.when(least >= 10**14, whole).when(least >= 10**11, whole * 1000).otherwise(whole * 1_000_000)
    value = F.when(text.rlike(NUMBER), text.try_cast("decimal(38,9)"))
    size = F.abs(value)
    unit = F.when(size >= 10**17, F.lit("0.001")).when(size >= 10**14, F.lit("1")).when(size >= 10**11, F.lit("1000")).otherwise(F.lit("1000000")).cast("decimal(10,3)")
    return F.when(least < 10**17, quick).otherwise(F.floor(F.try_multiply(value, unit)).try_cast("bigint"))


def offset_seconds(zone: Column) -> Column:
    """Seconds of an offset text: Z, UTC, GMT, +hh, +hhmm, +hh:mm, with or without UTC or GMT before it."""
    number = r"^(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?$"
    hour, minute = whole(F.regexp_extract(zone, number, 2)), F.coalesce(whole(F.regexp_extract(zone, number, 3)), F.lit(0))
    seconds = F.when(F.regexp_extract(zone, number, 1) == "-", -1).otherwise(1) * (hour * 3600 + minute * 60)
    return F.when(F.upper(zone).isin("Z", "UTC", "GMT", "UT"), 0).when(zone.rlike(number) & (hour <= 14) & (minute < 60), seconds)


def parse(rows: DataFrame, digits_are_calendar: bool = False) -> DataFrame:
    """Replaces columns text and export_locale by epoch_us, local_us and zone; all null where the text is no time.

    All-numeric dates that don't begin with the year have the month first in
    en-US, else the day. digits_are_calendar: a bare number
    is yyyyMMddHHmm[ss], no count from 1970. The steps are columns of their
    own, so that each is evaluated once a row.
    """
    x, p = F.col("_x"), F.col("_p")
    kept = [c for c in rows.columns if c not in ("text", "export_locale")]
    rows = rows.withColumn("_x", tidy(F.col("text")))
    rows = rows.withColumn(
        "_p",
        F.split(
            F.when(x.rlike(YEAR_FIRST), F.regexp_replace(x, YEAR_FIRST, "$1|$2|$3|$4|$5|$6|$7|$8|$9"))
            .when(x.rlike(NUMBER) & ~F.lit(digits_are_calendar), None)
            .when(x.rlike(COMPACT), F.regexp_replace(x, COMPACT, "$1|$2|$3|$4|$5|$6|$7||$8"))
            .when(x.rlike(NUMBERS), F.regexp_replace(x, NUMBERS, "$3|#$1|$2|$4|$5|$6|$7|$8|$9"))
            .when(x.rlike(DAY_NAME), F.regexp_replace(x, DAY_NAME, "$3|$2|$1|$4|$5|$6|$7|$8|$9"))
            .when(x.rlike(NAME_DAY), F.regexp_replace(x, NAME_DAY, "$3|$1|$2|$4|$5|$6|$7|$8|$9")),
            r"\|",
        ),
    )
    rows = rows.withColumns({"_half": F.upper(F.substring(p[7], 1, 1)), "_name": F.when(p[1].rlike(r"^\p{L}"), F.lower(unaccent(p[1])))})
    month_first = F.col("export_locale").eqNullSafe("en-US")
    first, second = F.substring(p[1], 2, 2), p[2]
    named = F.coalesce(*(F.when(F.substring("_name", 1, len(b)) == b, F.lit(str(m))) for m, begins in MONTHS.items() for b in sorted(begins, key=len, reverse=True)))
    month = F.when(p[1].startswith("#"), F.when(month_first, first).otherwise(second)).when(F.col("_name").isNull(), p[1]).otherwise(named)
    day = F.when(p[1].startswith("#"), F.when(month_first, second).otherwise(first)).otherwise(p[2])
    hour12 = whole(p[3])
    hour = F.when(F.col("_half") == "", hour12).when(hour12.between(1, 12), hour12 % 12 + F.when(F.col("_half") == "P", 12).otherwise(0))
    rows = rows.withColumns(
        {
            "_date": F.unix_date(F.concat(p[0], F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")),
            "_hour": hour,
            "_minute": whole(p[4]),
            "_second": F.coalesce(whole(p[5]), F.lit(0)),
            "_micro": F.coalesce(F.substring(F.rpad(p[6], 6, "0"), 1, 6).try_cast("int"), F.lit(0)),
        }
    )
    good = F.col("_date").isNotNull() & p[0].between("1800", "2199") & F.col("_hour").between(0, 23) & F.col("_minute").between(0, 59) & F.col("_second").between(0, 59)
    local = F.when(good, (F.col("_date").cast("bigint") * 86_400 + F.col("_hour") * 3600 + F.col("_minute") * 60 + F.col("_second")) * 1_000_000 + F.col("_micro"))
    rows = rows.withColumn("local_us", local)
    count = F.lit(None).cast("bigint") if digits_are_calendar else epoch(x)
    return rows.select(*kept, count.alias("epoch_us"), "local_us", F.when(F.col("local_us").isNotNull(), p[8]).alias("zone"))


def moments(name: str) -> list[int]:
    """The UTC seconds at which the tables of a zone list a change, in order; an unknown name raises."""
    import importlib.resources
    import struct
    import zoneinfo
    from pathlib import Path

    zoneinfo.ZoneInfo(name)  # refuses names that lead out of the folders
    found = next((path for root in zoneinfo.TZPATH if (path := Path(root, name)).is_file()), None)
    raw = found.read_bytes() if found else importlib.resources.files("tzdata.zoneinfo").joinpath(name).read_bytes()

    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", raw[at + 20 : at + 44])

    utc, std, leap, times, types, chars = counts(0)
    if raw[4:5] < b"2":
        return list(struct.unpack(f">{times}l", raw[44 : 44 + 4 * times]))
    second = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc
    times = counts(second)[3]
    return list(struct.unpack(f">{times}q", raw[second + 44 : second + 44 + 8 * times]))


def offsets(name: str) -> list[tuple[int, int, int, str]]:
    """from, to (UTC seconds), offset in seconds and abbreviation of each stretch of a zone from FIRST_YEAR to LAST_YEAR.

    Changes that the tables list are taken from there. After the last of them
    a yearly rule holds, whose two changes lie weeks apart: a scan by
    fortnights finds them.
    """
    from zoneinfo import ZoneInfo

    zone, base = ZoneInfo(name), datetime(1970, 1, 1, tzinfo=timezone.utc)
    # Two days more at both ends, as local years begin and end at other moments.
    first, last = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - base).total_seconds()) + d * 86_400 for y, d in ((FIRST_YEAR, -2), (LAST_YEAR + 1, 2)))

    def state(second: int) -> tuple[int, str]:
        there = (base + timedelta(seconds=second)).astimezone(zone)
        return int(there.utcoffset().total_seconds()), there.tzname()

    listed = [m for m in moments(name) if first < m < last]
    began, now, known = first, state(first), []
    for at in listed:
        if state(at) != now:
            known.append((began, at, *now))
            began, now = at, state(at)
    at, step = max([first, *listed]), 14 * 86_400
    while at < last:
        after = min(at + step, last)
        if state(after) != now:
            low, high = at, after
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if state(middle) == now else (low, middle)
            known.append((began, high, *now))
            began, now, after = high, state(high), high
        at = after
    return [*known, (began, last, *now)]


def intervals(zones: DataFrame) -> DataFrame:
    """zone, year, spans: for each zone name the offset intervals whose wall-clock time touches the year.

    spans: array of (from_us, to_us, offset_s, abbr), in wall-clock time. A
    name that is no IANA zone gives no rows. There are at most 600 zones and
    400 years, each with a few intervals, whatever the data: about 20 MB.
    """

    @F.udf("array<struct<year: int, from_us: bigint, to_us: bigint, offset_s: int, abbr: string>>")
    def years(name: str) -> list[tuple]:
        """The intervals of one zone; called once for each of the few zones, so rows may come one at a time."""
        try:
            known = offsets(name)
        except Exception:  # noqa: BLE001 - not a zone
            return []
        rows = []
        for start, end, offset, abbr in known:
            a, b = start + offset, end + offset
            first, last = (datetime(1970, 1, 1) + timedelta(seconds=a)).year, (datetime(1970, 1, 1) + timedelta(seconds=b - 1)).year
            rows += [(year, a * 1_000_000, b * 1_000_000, offset, abbr) for year in range(first, last + 1)]
        return rows

    ship(zones.sparkSession)
    flat = zones.filter("zone is not null").distinct().select("zone", F.explode(years("zone")).alias("x")).select("zone", "x.*")
    return flat.groupBy("zone", "year").agg(F.collect_list(F.struct("from_us", "to_us", "offset_s", "abbr")).alias("spans"))


def resolve(parsed: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds utc_us and how to rows with columns epoch_us, local_us, zone and home_zone.

    how: `number`, `offset` (in the text), `zone` (one matching interval),
    `ambiguous` (two), `nonexistent` (none), `unknown zone` or `unreadable`.
    utc_us is null for the last four. A zone text that is no offset is an IANA
    name if it has a slash, else an abbreviation of the home zone. A null
    home zone is unknown.
    """
    iana = F.col("zone").contains("/")
    bare = F.coalesce(F.col("zone"), F.lit("")) == ""
    abbr = F.when(~bare & ~iana & F.col("offset_s").isNull(), F.col("zone"))
    year = F.year(F.date_from_unix_date((F.col("local_us") / 86_400_000_000).cast("bigint").cast("int")))
    rows = parsed.withColumn("offset_s", offset_seconds(F.col("zone")))
    rows = rows.withColumn("at_zone", F.when(F.col("offset_s").isNull() & F.col("local_us").isNotNull(), F.when(iana, F.col("zone")).otherwise(F.col("home_zone")))).withColumn("at_year", year).withColumn("abbr", abbr)
    # A null-safe equality, though no zone or year of spans is null: Spark would follow the keys of a plain one down through all
    # steps of parse, in search of partitions, and write out each step wherever it is used, which takes a gigabyte of the driver's heap.
    known = spans.select(F.col("zone").alias("of_zone"), F.col("year").alias("of_year"), "spans")
    joined = rows.join(F.broadcast(known), F.col("at_zone").eqNullSafe(F.col("of_zone")) & F.col("at_year").eqNullSafe(F.col("of_year")), "left")
    # An abbreviation names one of the offsets of the year, in whatever season; in its own season the interval decides.
    holding = F.filter("spans", lambda s: (s["from_us"] <= F.col("local_us")) & (F.col("local_us") < s["to_us"]) & (F.col("abbr").isNull() | (s["abbr"] == F.col("abbr"))))
    of_abbr = F.array_distinct(F.transform(F.filter("spans", lambda s: s["abbr"] == F.col("abbr")), lambda s: s["offset_s"]))
    joined = joined.withColumn("holding", F.transform(holding, lambda s: s["offset_s"]))
    joined = joined.withColumn("offsets", F.when(F.col("abbr").isNull() | (F.size("holding") > 0), F.col("holding")).otherwise(of_abbr))
    count = F.size("offsets")
    how = (
        F.when(F.col("epoch_us").isNotNull(), "number")
        .when(F.col("local_us").isNull(), "unreadable")
        .when(F.col("offset_s").isNotNull(), "offset")
        .when(F.col("spans").isNull(), "unknown zone")
        .when(count == 1, "zone")
        .when(count > 1, "ambiguous")
        .when(F.col("abbr").isNotNull(), "unknown zone")
        .otherwise("nonexistent")
    )
    found = F.when(F.col("how") == "number", F.col("epoch_us")).when(F.col("how") == "offset", F.col("local_us") - F.col("offset_s").cast("bigint") * 1_000_000).when(F.col("how") == "zone", F.col("local_us") - F.col("offsets")[0].cast("bigint") * 1_000_000)
    return joined.withColumn("how", how).withColumn("utc_us", found.cast("bigint")).drop("spans", "holding", "offsets", "at_zone", "at_year", "of_zone", "of_year", "abbr", "offset_s")


def stamp(rows: DataFrame, exports: DataFrame, spans: DataFrame, digits_are_calendar: bool = False) -> DataFrame:
    """Replaces column text, and beside (an offset given apart from it), by how and utc_us; needs source_id, keeps other columns."""
    homes = exports.select("source_id", "export_locale", "home_zone")
    read = parse(rows.join(homes, "source_id", "left"), digits_are_calendar)
    if "beside" in rows.columns:
        read = read.withColumn("zone", F.when(F.col("zone") != "", F.col("zone")).otherwise(tidy(F.col("beside")))).drop("beside")
    return resolve(read, spans).drop("epoch_us", "local_us", "zone", "home_zone")


def taken_text() -> Column:
    """The time text of a sidecar row: the timestamp if it is a number, else the formatted text."""
    number = tidy(F.col("photo_taken_timestamp"))
    return F.when(number.rlike(NUMBER), number).otherwise(F.col("photo_taken_formatted"))


def home_spans(exports: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """The intervals of the home zones, and of the zones named in column zone of named."""
    zones = exports.select(F.col("home_zone").alias("zone"))
    return intervals(zones.union(named) if named is not None else zones)


def instants(sidecar: DataFrame, embedded: DataFrame, suspicious: DataFrame, exports: DataFrame) -> DataFrame:
    """rec_id, kind, source_id, how, utc_us of every record of the three tables.

    Null, empty and impossible texts are `unreadable`; a record whose export
    is missing has no home zone and is resolved only with an offset in its
    text. Repeated rows stay; extra columns are ignored; empty tables give
    no rows.
    """
    named = suspicious.select(F.regexp_extract(tidy(F.col("embedded_timestamp")), r" (\p{L}+/[\p{L}_/+-]+)$", 1).alias("zone")).filter("zone <> ''")
    spans = home_spans(exports, named)
    one = sidecar.select(F.col("sidecar_id").alias("rec_id"), F.lit("sidecar").alias("kind"), "source_id", taken_text().alias("text"))
    three = suspicious.select(F.col("finding_id").alias("rec_id"), F.lit("suspicious_date").alias("kind"), "source_id", F.col("embedded_timestamp").alias("text"))
    two = embedded.select(F.col("embedded_id").alias("rec_id"), F.lit("embedded_meta").alias("kind"), "source_id", F.col("capture_text").alias("text"), F.col("utc_offset").alias("beside"))
    columns = ["rec_id", "kind", "source_id", "how", "utc_us"]
    return stamp(one.unionByName(three), exports, spans).select(columns).unionByName(stamp(two, exports, spans, digits_are_calendar=True).select(columns))
