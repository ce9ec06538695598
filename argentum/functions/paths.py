"""Paths: folders, layout of the output, safe names and containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from argentum.functions.folders import YEAR_FOLDER
from argentum.functions.names import extension, strip, without

# Names of months and of devices, characters that no file name may have, brands of HEIC files, endings of unfinished downloads, folders that no scan enters.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DEVICES = r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|\z)"
FORBIDDEN = r'[\x{0}-\x{1F}<>:"|?*]'
UNFINISHED = (".crdownload", ".part", ".tmp", ".fdmdownload", ".moving")
SYSTEM = ("$recycle.bin", "system volume information", "$winreagent", ".spotlight-v100", ".trashes")
OWN = (".gtf", "logs")
ROOT = "google photos"
HEIC = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs")


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def top_level(path: Column) -> Column:
    """The first folder of a relative path, or the file itself if it lies in none."""
    return F.element_at(F.split(F.regexp_replace(slashes(path), r"^/+|/+\z", ""), "/"), 1)


def is_year_folder(name: Column) -> Column:
    return F.coalesce(name.rlike(YEAR_FOLDER), F.lit(False))


def folder_year(name: Column) -> Column:
    """The year of a year folder, else null."""
    n = strip(name)
    return F.when(is_year_folder(n), F.right(n, F.lit(4)).try_cast("int"))


def clean(path: Column) -> Column:
    """A path with `/` only, without empty and `.` parts and with `..` resolved; the empty path is `.`."""
    parts = F.filter(F.split(slashes(path), "/"), lambda p: (p != "") & (p != "."))
    rooted = slashes(path).startswith("/")
    up = lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).when((p == "..") & rooted, done).otherwise(F.concat(done, F.array(p)))
    # try_element_at is null for an empty array.
    solved = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(F.size(done) == 0, F.when((p == "..") & rooted, done).otherwise(F.array(p))).otherwise(up(done, p)))
    joined = F.array_join(solved, "/")
    plain = ~path.rlike(r"^\z|(?:^|/)\.{1,2}(?:/|\z)|//|.(?:/\z)|\\")
    return F.when(plain, path).when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def dir_key(folder: Column) -> Column:
    """A folder in the form by which local and global sidecars meet."""
    c = F.lower(clean(strip(folder)))
    return F.when(c == ".", "").otherwise(c)


def within(parent: Column, child: Column) -> Column:
    """Whether a clean path is another one or lies in it."""
    return (child == parent) | F.startswith(child, F.when(parent == "/", parent).otherwise(F.concat(parent, F.lit("/"))))


def overlap(a: Column, b: Column) -> Column:
    """Whether two paths are equal without case, or one lies in the other."""
    a, b = clean(a), clean(b)
    return (F.lower(a) == F.lower(b)) | within(a, b) | within(b, a)


def safe_entry(name: Column) -> Column:
    """reason and path of an archive entry's name: path is null where reason tells why the name is unsafe.

    Characters that Windows forbids become `_`, device names get one before
    them, spaces and dots at the end of a part are dropped. An empty name has
    the empty path.
    """
    path = slashes(name)
    raw = F.split(path, "/")
    bad = F.exists(raw, lambda p: strip(p).isin(".", ".."))
    part = lambda p: F.regexp_replace(F.regexp_replace(p, r"[ .]+\z", ""), FORBIDDEN, "_")
    named = lambda p: F.when(p == "", "_").when(p.rlike(DEVICES), F.concat(F.lit("_"), p)).otherwise(p)
    parts = F.transform(F.filter(raw, lambda p: p != ""), lambda p: named(part(p)))
    reason = F.when(strip(path) == "", None).when(path.startswith("/"), "absolute").when(path.rlike(r"^[A-Za-z]:"), "drive").when(bad, "traversal")
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), F.when(strip(path) == "", "").otherwise(F.array_join(parts, "/"))).alias("path"))


def below_root(path: Column) -> Column:
    """What follows the first component that is the photo root; null where there is none or nothing follows."""
    parts = F.split(clean(path), "/")
    at = F.array_position(F.transform(parts, lambda p: F.lower(p)), ROOT)
    return F.when((at > 0) & (at < F.size(parts)), F.array_join(F.slice(parts, at.cast("int") + 1, F.size(parts)), "/"))


def is_archive(path: Column) -> Column:
    """Whether a path is that of a complete archive."""
    return F.lower(extension(slashes(path))) == ".zip"


def is_export_archive(path: Column) -> Column:
    return is_archive(path) & F.lower(F.substring_index(slashes(path), "/", -1)).contains("takeout")


def is_unfinished(path: Column) -> Column:
    return F.lower(extension(slashes(path))).isin(*UNFINISHED)


def skipped_folder(path: Column, names: tuple[str, ...] = SYSTEM) -> Column:
    """Whether a folder of the path is one that no scan enters."""
    return F.exists(F.split(slashes(path), "/"), lambda p: F.lower(strip(p)).isin(*names))


def is_sidecar(name: Column) -> Column:
    """Whether an entry is a sidecar."""
    return (F.lower(extension(name)) == ".json") & (F.lower(F.substring_index(slashes(name), "/", -1)) != "user-generated-memory-titles.json")


def month_folder(month: Column) -> Column:
    """`3 - March`; a number that is no month stays a number."""
    name = F.when(month.between(1, 12), F.element_at(F.array(*(F.lit(m) for m in MONTHS)), month))
    return F.when(name.isNotNull(), F.concat(month.cast("string"), F.lit(" - "), name)).otherwise(month.cast("string"))


def output_folder(rel_dir: Column, is_year: Column, date: Column, month_known: Column, flatten: bool = False, by_date: bool = True) -> Column:
    """The folder of an output file below the root: empty if flat, Albums/.. for albums, the year folder or the date's folders."""
    if flatten:
        return F.lit("")
    own = F.coalesce(rel_dir, F.lit(""))
    album = F.when(own == "", "Albums").otherwise(F.concat(F.lit("Albums/"), own))
    dated = F.concat(F.lit("Photos from "), F.lpad(F.year(date).cast("string"), 4, "0"), F.lit("/"), F.when(month_known, month_folder(F.month(date))).otherwise("Unknown month"))
    return F.when(~is_year, album).otherwise(dated if by_date else own)


def corrected_name(name: Column, signature: Column, brand: Column, restore_mov: bool = True) -> Column:
    """A file name whose extension fits its content.

    signature: the extension that the first bytes mean, or null. An image of
    another kind takes it; .jpg and .jpeg are one kind. With restore_mov an
    .mp4 of the brand `Apple QuickTime` becomes a .mov, in the same case.
    """
    ext = F.lower(extension(name))
    alike = (ext == signature) | (ext.isin(".jpg", ".jpeg") & signature.isin(".jpg", ".jpeg"))
    image = F.when(ext.isin(".jpg", ".jpeg", ".png", ".heic") & signature.isNotNull() & ~alike, F.concat(without(name, ext), signature)).otherwise(name)
    if not restore_mov:
        return image
    movie = F.concat(without(name, ext), F.when(extension(name) == ".MP4", ".MOV").otherwise(".mov"))
    return F.when((ext == ".mp4") & F.startswith(F.coalesce(brand, F.lit("")), F.lit("Apple QuickTime")), movie).otherwise(image)


def signature(header: Column) -> Column:
    """The extension that a file's first bytes mean: .jpg, .png, .heic or null."""
    text = F.hex(header)
    brand = F.lower(F.substring(header, 9, 4).cast("string"))
    return (
        F.when(text.startswith("FFD8FF"), ".jpg")
        .when(text.startswith("89504E470D0A1A0A"), ".png")
        .when((F.substring(text, 9, 8) == "66747970") & brand.isin(*HEIC), ".heic")
    )

