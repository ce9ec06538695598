"""What a sidecar and the metadata in a file say: geo, conflicts, the policy of a merge, findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from argentum.functions.dates import rfc3339
from argentum.functions.names import strip

# Seconds and degrees within which two values agree, reasons and problems as reports show them.
SECONDS, DEGREES, DAY = 2, 1e-4, 86_400
MISSING = "missing JSON timestamp"
EARLY = "timestamp before 2000"
FUTURE = "timestamp in the future"
FAR = "JSON timestamp differs from embedded timestamp by more than 24h"
GUESSED = "timezone guessed as UTC because no GPS/offset existed"
YEAR_2000 = 946_684_800
POLICIES = ("prefer-json", "prefer-embedded", "merge")


def text(value: Column) -> Column:
    """A text without white space around it; null is empty."""
    return F.coalesce(strip(value), F.lit(""))


def first_text(*values: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*(F.nullif(text(v), F.lit("")) for v in values), F.lit(""))


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def has_geo(lat: Column, lon: Column) -> Column:
    return (zero(lat) != 0) | (zero(lon) != 0)


def best_geo(lat: Column, lon: Column, alt: Column, exif_lat: Column, exif_lon: Column, exif_alt: Column) -> Column:
    """lat, lon, alt of the sidecar's own place unless all three are 0, else of its Exif place."""
    own = (zero(lat) != 0) | (zero(lon) != 0) | (zero(alt) != 0)
    pick = lambda a, b: F.when(own, zero(a)).otherwise(zero(b))
    return F.struct(pick(lat, exif_lat).alias("lat"), pick(lon, exif_lon).alias("lon"), pick(alt, exif_alt).alias("alt"))


def _reasons(*reasons: Column) -> Column:
    return F.array_compact(F.array(*reasons))


def suspicious(seconds: Column, embedded_us: Column, readable: Column, placed: Column, offset: Column, now: int) -> Column:
    """Why a date is suspicious: an array of reasons in their fixed order, empty where none holds. now: seconds."""
    far = F.abs(embedded_us / 1_000_000 - seconds) > DAY
    found = _reasons(
        F.when(seconds < YEAR_2000, EARLY),
        F.when(seconds > now, FUTURE),
        F.when(readable & far, FAR),
        F.when(readable & ~placed & (text(offset) == ""), GUESSED),
    )
    return F.when(seconds.isNull(), F.array(F.lit(MISSING))).otherwise(found)


def place_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f,%.6f", zero(lat), zero(lon))


def conflicts(seconds: Column, embedded_us: Column, geo: Column, lat: Column, lon: Column, title: Column, other_title: Column, description: Column, other_description: Column) -> Column:
    """An array of (field, json_value, embedded_value) for the fields in which sidecar and file disagree."""
    entry = lambda field, a, b: F.struct(F.lit(field).alias("field"), a.alias("json_value"), b.alias("embedded_value"))
    away = has_geo(geo["lat"], geo["lon"]) & has_geo(lat, lon) & ((F.abs(geo["lat"] - zero(lat)) > DEGREES) | (F.abs(geo["lon"] - zero(lon)) > DEGREES))
    differ = lambda a, b: (text(a) != "") & (text(b) != "") & (text(a) != text(b))
    return _reasons(
        F.when(F.abs(embedded_us / 1_000_000 - seconds) > SECONDS, entry("capture-time", rfc3339(seconds), rfc3339(F.floor(embedded_us / 1_000_000)))),
        F.when(away, entry("gps", place_text(geo["lat"], geo["lon"]), place_text(lat, lon))),
        F.when(differ(title, other_title), entry("title", text(title), text(other_title))),
        F.when(differ(description, other_description), entry("description", text(description), text(other_description))),
    )


def merge(policy: str, seconds: Column, embedded_us: Column, geo: Column, lat: Column, lon: Column, title: Column, other_title: Column, description: Column, other_description: Column) -> Column:
    """Which fields a merge writes: struct of write_time, write_gps, write_title, write_description."""
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r} is none of {', '.join(POLICIES)}")
    time, gps, named, told = seconds.isNotNull(), has_geo(geo["lat"], geo["lon"]), text(title) != "", text(description) != ""
    if policy == "prefer-embedded":
        time, gps = time & embedded_us.isNull(), gps & ~has_geo(lat, lon)
    if policy != "prefer-json":
        named, told = named & (text(other_title) == ""), told & (text(other_description) == "")
    return F.struct(time.alias("write_time"), gps.alias("write_gps"), named.alias("write_title"), told.alias("write_description"))


def problems(expected_s: Column, expect_gps: Column, geo: Column, title: Column, description: Column, actual_us: Column, lat: Column, lon: Column, actual_title: Column, actual_description: Column) -> Column:
    """What a file lacks of what was written to it: an array of problems; null and empty expectations ask for nothing."""
    late = F.abs(actual_us / 1_000_000 - expected_s) > SECONDS
    found = has_geo(lat, lon)
    return _reasons(
        F.when(expected_s.isNotNull() & actual_us.isNull(), "capture time missing after write").when(late, F.concat(F.lit("capture time mismatch (got "), rfc3339(F.floor(actual_us / 1_000_000)), F.lit(")"))),
        F.when(expect_gps & ~found, "GPS coordinates missing after write"),
        F.when(expect_gps & found & (F.abs(zero(lat) - geo["lat"]) > DEGREES), "latitude mismatch"),
        F.when(expect_gps & found & (F.abs(zero(lon) - geo["lon"]) > DEGREES), "longitude mismatch"),
        F.when((text(title) != "") & (text(actual_title) != text(title)), "title mismatch"),
        F.when((text(description) != "") & (text(actual_description) != text(description)), "description mismatch"),
    )


def add_problem(current: Column, more: Column) -> Column:
    """Error texts joined by `; `, without empty ones."""
    return F.concat_ws("; ", F.nullif(current, F.lit("")), F.nullif(more, F.lit("")))


def escape_xml(value: Column) -> Column:
    out = value
    for a, b in (("&", "&amp;"), ('"', "&#34;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xmp_packet(write: Column, local: Column, title: Column, description: Column, geo: Column) -> Column:
    """The XMP packet of what is written; local: the capture time as text with its offset."""
    line = lambda name, value: F.concat(F.lit(f"      <{name}>"), value, F.lit(f"</{name}>\n"))
    alt = lambda name, value: F.concat(F.lit(f'      <{name}><rdf:Alt><rdf:li xml:lang="x-default">'), escape_xml(value), F.lit(f"</rdf:li></rdf:Alt></{name}>\n"))
    part = lambda flag, *items: F.when(flag, F.concat(*items)).otherwise("")
    # The frame of a packet and its namespaces.
    head = (
        '<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?>\n'
        '<x:xmpmeta xmlns:x="adobe:ns:meta/">\n'
        '  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
        '    <rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:exif="http://ns.adobe.com/exif/1.0/">\n'
    )
    tail = '    </rdf:Description>\n  </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>\n'
    number = lambda x, form: F.format_string(form, x)
    return F.concat(
        F.lit(head),
        part(write["write_time"] & local.isNotNull(), line("xmp:CreateDate", escape_xml(local)), line("xmp:ModifyDate", escape_xml(local))),
        part(write["write_title"], alt("dc:title", text(title))),
        part(write["write_description"], alt("dc:description", text(description))),
        part(write["write_gps"], line("exif:GPSLatitude", number(geo["lat"], "%.7f")), line("exif:GPSLongitude", number(geo["lon"], "%.7f")), line("exif:GPSAltitude", number(geo["alt"], "%.2f"))),
        F.lit(tail),
    )


def write_arguments(write: Column, is_video: Column, seconds: Column, offset: Column, geo: Column) -> Column:
    """The tag assignments that would write time and place, as texts; nothing is run. offset: seconds."""
    from argentum.functions.dates import offset_text

    in_range = seconds.between(-62_135_596_800, 253_402_300_799)
    shown = lambda s: F.when(in_range, F.date_format(F.timestamp_seconds(s), "yyyy:MM:dd HH:mm:ss"))
    zone = offset_text(offset)
    local, utc = shown(seconds + offset), shown(seconds)
    with_zone = F.concat(local, zone)
    tags = lambda pairs: F.array(*(F.concat(F.lit(f"-{tag}="), value) for tag, value in pairs))
    # The tags that photos and videos take.
    video_time = tags([("Keys:CreationDate", with_zone), *((t, utc) for t in ("QuickTime:CreateDate", "QuickTime:ModifyDate", "TrackCreateDate", "TrackModifyDate", "MediaCreateDate", "MediaModifyDate")), ("FileCreateDate", with_zone), ("FileModifyDate", with_zone)])
    photo_time = tags([("AllDates", local), ("OffsetTime", zone), ("OffsetTimeOriginal", zone), ("OffsetTimeDigitized", zone), ("FileCreateDate", with_zone), ("FileModifyDate", with_zone)])
    number = lambda x, form: F.format_string(form, x)
    xmp = [("XMP-exif:GPSLatitude", number(geo["lat"], "%.7f")), ("XMP-exif:GPSLongitude", number(geo["lon"], "%.7f")), ("XMP-exif:GPSAltitude", number(geo["alt"], "%.2f"))]
    photo_gps = tags([("GPSLatitude", number(F.abs(geo["lat"]), "%.7f")), ("GPSLatitudeRef", F.when(geo["lat"] < 0, "S").otherwise("N")), ("GPSLongitude", number(F.abs(geo["lon"]), "%.7f")), ("GPSLongitudeRef", F.when(geo["lon"] < 0, "W").otherwise("E")), ("GPSAltitude", number(geo["alt"], "%.2f")), *xmp])
    none = F.array().cast("array<string>")
    time = F.when(write["write_time"], F.when(is_video, video_time).otherwise(photo_time)).otherwise(none)
    place = F.when(write["write_gps"], F.when(is_video, tags(xmp)).otherwise(photo_gps)).otherwise(none)
    return F.concat(time, place)


def human_bytes(size: Column) -> Column:
    """A size as 0 B, 12 B, 1.5 KB up to PB."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    out = F.format_string("%d B", size)
    for k in range(1, len(units)):
        out = F.when(size >= 1024**k, F.format_string(f"%.1f {units[k]}", size / float(1024**k))).otherwise(out)
    return F.when(size > 0, out).otherwise("0 B")
