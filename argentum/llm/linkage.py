"""Matching media and sidecar rows without a common identifier.

A collective linkage on the graph whose nodes are media and sidecars:

1. Candidates share rare attributes: a name (as letters in any order and digits
   in order, so that swapped letters don't count), the beginning of a long
   name, a time of capture, a place, a path that media.match_candidates
   lists. An edge weighs the sum of its shared attributes, each by its
   reliability and by how rare it is among the sidecars: ln(N/df) / ln(N).
2. Meta-blocking prunes the graph. A block with more than sqrt(N) sidecars is
   opened through finer ones only: what its attribute shares together with a
   name, a time or a folder, and where that is large too, with two of them.
   Its attribute then counts as one that is shared but not rare. Then each node
   keeps the edges near its best one.
3. Similarity is propagated. The neighbours of an edge are the links between
   the folders of its ends; the larger their share of the links of the
   medium's folder, the more an edge between different folders weighs. All
   edges are weighed again by the links of the round before, until no edge
   changes by STABLE or more.
4. What describes a medium describes its copies: links spread over media with
   one content or one folder and name, and over sidecars with one time and
   name, again and again until none is added.

Only ids and hashed keys are shuffled for blocking; a node's attributes meet
its edges once. Exact copies of a node's attributes are one node until step 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.functions.folders import YEAR_PREFIXES
from argentum.functions.text import fold, unaccent, whole
from argentum.llm.truncation import EXTENSION, SUPPLEMENT
from argentum.operators import timestamps
from argentum.plans.skew import salted_join
from argentum.session import cut, drop

# Reliability of shared attributes and of conflicts; an edge of ENOUGH or more is a link.
NAME, PREFIX, TIME, PLACE, CANDIDATE = 6.0, 5.0, 6.0, 4.5, 2.0
SAME_FOLDER, OTHER_FOLDER, OTHER_NAME, OTHER_TIME, OTHER_CLOCK = 1.5, -1.5, -3.0, -6.0, -1.0
ENOUGH, MARGIN, SPREAD = 4.5, 4.0, 0.95
#: What an edge between two folders gains at most if all links of the medium's folder lead to the sidecar's; changes below STABLE end the propagation, as do ROUNDS.
GAIN, STABLE, ROUNDS = 1.5, 0.05, 10
#: Letters of the beginning of a long name; seconds by which a file is written after its capture, by which a camera's clock is early; seconds of a wrong hour.
BEGIN, LATE, EARLY, HOUR = 28, 5, 60, 3600
#: Seconds of the time blocks of files and of camera clocks.
FILE_BLOCK, CLOCK_BLOCK = 8, 64
#: Files written from this long before the export to this long after it tell nothing of the capture.
EXPORT_DAYS = 3
#: Keys of the rows without a source up to which they are broadcast to sift the keys of all rows; beyond that all keys are shuffled.
SIFTED = 2_000_000

# Kinds of keys: names, beginnings, times of files and of clocks, places, listed paths; FINER ones bring edges and add nothing to their weight.
BY_NAME, BY_BEGIN, BY_FILE, BY_CLOCK, BY_PLACE, BY_LIST, FINER = range(7)
ANY = -1

# Marks of edited copies, without accents.
EDITED = r"(?i)-(?:edited|bearbeitet|editado|modifie|編集済み)"
NUMBER = r"\((\d+)\)$"
MEANINGLESS = r"^(?:metadata|)$"
_years = "|".join(sorted({f"{p.strip().lower()}" for p in YEAR_PREFIXES}))


def folder(path: Column) -> Column:
    """A folder in one form; year folders of all languages are one."""
    plain = F.lower(F.regexp_replace(path, r"[\\/\s]+", " "))
    return F.xxhash64(F.when(plain.rlike(rf"^(?:{_years}) \d{{4}} ?$"), F.regexp_extract(plain, r"(\d{4})", 1)).otherwise(fold(path)))


def letters(name: Column) -> Column:
    """A folded name as its letters in order of the alphabet and its digits in their own order."""
    return F.concat_ws("|", F.array_join(F.sort_array(F.split(F.regexp_replace(name, r"[\d ]+", ""), "")), ""), F.regexp_replace(name, r"\D+", ""))


def media_nodes(media: DataFrame, embedded: DataFrame, exports: DataFrame, spans: DataFrame) -> DataFrame:
    """What linkage knows of each media row: hashes of its source, folder and name, its number, times and place."""
    path = lambda: F.xxhash64("source_id", F.lower(unaccent(F.translate("rel_path", "\\", "/"))))
    seen = timestamps.stamp(embedded.filter("is_readable is null or is_readable").select(path().alias("path"), "source_id", F.col("capture_text").alias("text"), F.col("utc_offset").alias("beside"), "lat", "lon"), exports, spans, digits_are_calendar=True)
    seen = cut(seen, "stamped").groupBy("path").agg(F.min(F.floor(F.col("utc_us") / 1_000_000)).alias("clock"), F.max("lat").alias("lat"), F.max_by("lon", "lat").alias("lon"))
    exported = exports.select("source_id", F.unix_timestamp("exported_at").alias("exported"))
    stem = F.regexp_replace(F.regexp_replace("file_name", EXTENSION, ""), r"\.\w{0,4}$", "")
    listed = F.transform(F.coalesce("match_candidates", F.array().cast("array<string>")), lambda p: F.xxhash64(fold(F.regexp_replace(p, r"[\\/][^\\/]*$", "")), fold(F.regexp_replace(F.regexp_replace(p, r"^.*[\\/]", ""), r"(?i)\.json$", ""))))
    rows = media.select("media_id", "source_id", path().alias("path"), folder(F.col("rel_dir")).alias("dir"), stem.alias("stem"), F.unix_timestamp("mtime").alias("written"), F.when(F.col("content_hash") != "", F.xxhash64("content_hash")).alias("content"), F.sort_array(F.array_distinct(listed)).alias("listed"))
    rows = rows.withColumn("stem", unaccent(F.col("stem")))
    rows = rows.withColumns({"edited": F.col("stem").rlike(EDITED), "stem": F.regexp_replace("stem", EDITED, "")})
    rows = rows.withColumns({"num": F.coalesce(whole(F.regexp_extract("stem", NUMBER, 1)), F.lit(0)), "name": F.regexp_replace("stem", NUMBER, "")})
    rows = rows.withColumn("name", fold(F.col("name")))
    rows = rows.withColumns({"letters": _letters_of(F.col("name")), "begin": _begin_of(F.col("name")), "name": _hash_of(F.col("name"))})
    rows = rows.join(F.broadcast(exported), "source_id", "left").join(seen, "path", "left")
    tells = F.col("exported").isNull() | ~(F.col("written") - F.col("exported")).between(-86_400 * EXPORT_DAYS, 86_400 * EXPORT_DAYS)
    return rows.select("media_id", _source(), "dir", "name", "letters", "begin", F.col("num").cast("short").alias("num"), F.when(tells & ~F.col("edited"), F.col("written")).alias("written"), "clock", "lat", "lon", "content", "listed")


def _source() -> Column:
    return F.when(F.col("source_id").isNotNull(), F.xxhash64("source_id")).alias("src")


def _hash_of(name: Column) -> Column:
    return F.when(name != "", F.xxhash64(name))


def _letters_of(name: Column) -> Column:
    return F.when(name != "", F.xxhash64(letters(name)))


def _begin_of(name: Column) -> Column:
    return F.when(F.char_length(name) >= BEGIN, F.xxhash64(F.substring(name, 1, BEGIN)))


def sidecar_nodes(sidecar: DataFrame, exports: DataFrame, spans: DataFrame) -> DataFrame:
    """What linkage knows of each sidecar row. It has up to two names, its title and its own; num is null where nothing tells its number."""
    rows = sidecar.select("sidecar_id", "source_id", folder(F.col("rel_dir")).alias("dir"), "rel_dir", "title", "sidecar_name", timestamps.taken_text().alias("text"), F.col("geo_latitude").alias("lat"), F.col("geo_longitude").alias("lon"))
    # The times are read apart from the names, so that each stage compiles to methods that the JVM optimises.
    rows = cut(timestamps.stamp(rows, exports, spans), "stamped")
    base = lambda c: F.regexp_replace(F.regexp_replace(c, EXTENSION, ""), r"\.\w{0,4}$", "")
    rows = rows.withColumns({"own": base(F.regexp_replace("sidecar_name", SUPPLEMENT, "")), "titled": base(F.col("title"))})
    rows = rows.withColumns({"own": unaccent(F.col("own")), "titled": unaccent(F.col("titled"))})
    number = lambda c: whole(F.regexp_extract(c, NUMBER, 1))
    after = whole(F.regexp_extract("sidecar_name", r"(?i)\((\d+)\)\.json$", 1))
    rows = rows.withColumns({"own_num": number(F.col("own")), "title_num": number(F.col("titled")), "own": F.regexp_replace("own", NUMBER, ""), "titled": F.regexp_replace("titled", NUMBER, "")})
    rows = rows.withColumns({"own": fold(F.col("own")), "titled": fold(F.col("titled")), "path": F.regexp_replace("sidecar_name", r"(?i)\.json$", "")})
    meant = F.col("sidecar_name").isNotNull() & ~F.col("own").rlike(MEANINGLESS)
    rows = rows.withColumns({"num": F.coalesce("title_num", F.when(meant, F.coalesce(after, "own_num", F.lit(0)))).cast("short"), "own": F.when(meant, F.col("own"))})
    rows = rows.withColumns({x + y: f(F.col(x)) for x in ("own", "titled") for y, f in (("", _hash_of), ("_letters", _letters_of), ("_begin", _begin_of))})
    placed = (F.col("lat") != 0) | (F.col("lon") != 0)
    # Times before 1970 are those of clocks that were never set.
    path = F.xxhash64(fold(F.col("rel_dir")), fold(F.col("path")))
    return rows.select("sidecar_id", _source(), "dir", "own", "titled", "own_letters", "titled_letters", "own_begin", "titled_begin", "num", F.floor(F.when(F.col("utc_us") > 0, F.col("utc_us")) / 1_000_000).alias("taken"), F.when(placed, F.col("lat")).alias("lat"), F.when(placed, F.col("lon")).alias("lon"), path.alias("path"))


def _cell(lat: Column, lon: Column) -> Column:
    """The cell of a hundredth of a degree that a place lies in."""
    return F.when(lat.isNotNull() & lon.isNotNull() & ((lat != 0) | (lon != 0)), F.xxhash64(F.floor(lat * 100).cast("int"), F.floor(lon * 100).cast("int")))


def _cells(lat: Column, lon: Column, near: float) -> list[Column]:
    """The cells that a place lies in or within `near` of; equal ones repeat."""
    return [_cell(lat + a, lon + b) for a in (-near, near) for b in (-near, near)]


def _in(scope: Column, kind: int, *of: Column) -> Column:
    """A key, whose last three bits are its kind; null where one of its parts is (xxhash64 alone would skip nulls)."""
    known = scope.isNotNull()
    for x in of:
        known = known & x.isNotNull()
    return F.when(known, F.xxhash64(scope, F.lit(kind), *of).bitwiseAND(F.lit(-8)).bitwiseOR(F.lit(kind)))


def _kind() -> Column:
    return F.col("key").bitwiseAND(F.lit(7)).cast("byte").alias("kind")


def _explode(nodes: DataFrame, id_: str, keys: list[Column]) -> DataFrame:
    """id, key: the different keys of the nodes."""
    return nodes.select(id_, F.explode(F.array_distinct(F.array(*keys))).alias("key")).filter("key is not null")


def _shifts(time: Column, least: int, most: int, width: int) -> list[Column]:
    """The blocks that time + least to time + most fall into, at most two as width is not below their distance less one block."""
    return [F.floor((time + x) / width) for x in range(least, most, width)] + [F.floor((time + most) / width)]


def media_keys(nodes: DataFrame) -> DataFrame:
    """Keys within a source, and listed paths."""
    src, everywhere = F.col("src"), F.lit(0)
    keys = [_in(src, BY_NAME, F.col("letters"), F.col("num")), _in(src, BY_NAME, F.col("letters"), F.lit(ANY)), _in(src, BY_BEGIN, F.col("begin"))]
    keys += [_in(src, BY_FILE, F.floor(F.col("written") / FILE_BLOCK)), _in(src, BY_CLOCK, F.floor(F.col("clock") / CLOCK_BLOCK)), _in(src, BY_PLACE, _cell(F.col("lat"), F.col("lon")))]
    return _explode(nodes, "media_id", keys).unionByName(nodes.select("media_id", F.explode("listed").alias("p")).select("media_id", _in(everywhere, BY_LIST, F.col("p")).alias("key")))


def sidecar_keys(nodes: DataFrame) -> DataFrame:
    """The same of sidecars, each with all blocks that a medium of it may lie in. A sidecar without a known number meets media of all numbers."""
    src, everywhere, taken = F.col("src"), F.lit(0), F.col("taken")
    number = F.coalesce(F.col("num"), F.lit(ANY))
    keys = [_in(src, BY_NAME, F.col(c), number) for c in ("titled_letters", "own_letters")] + [_in(src, BY_BEGIN, F.col(c)) for c in ("titled_begin", "own_begin")]
    keys += [_in(src, BY_FILE, x) for x in _shifts(taken, -LATE, LATE, FILE_BLOCK)] + [_in(src, BY_CLOCK, x) for x in _shifts(taken, -EARLY, LATE, CLOCK_BLOCK)]
    nameless = F.when(F.coalesce("titled", "own").isNull(), taken)  # a wrong hour is evidence where no name speaks
    keys += [_in(src, BY_FILE, x) for h in (-HOUR, HOUR) for x in _shifts(nameless + h, -LATE, LATE, FILE_BLOCK)]
    keys += [_in(src, BY_PLACE, c) for c in _cells(F.col("lat"), F.col("lon"), 0.001)] + [_in(everywhere, BY_LIST, F.col("path"))]
    return _explode(nodes, "sidecar_id", keys)


def unknown_media_keys(nodes: DataFrame, scope: str, all_blocks: bool) -> DataFrame:
    """Keys without a source, for pairs one of whose sides has none: name with number; folder or place with time.

    all_blocks: whether these rows get the keys of all blocks around them, and
    the other side that of its own block. That is the side without sources,
    which has few rows.
    """
    at, lat, lon = F.lit(scope), F.col("lat"), F.col("lon")
    when = [(BY_FILE, x) for x in (_shifts(F.col("written"), -LATE, LATE, FILE_BLOCK) if all_blocks else [F.floor(F.col("written") / FILE_BLOCK)])]
    when += [(BY_CLOCK, x) for x in (_shifts(F.col("clock"), -LATE, EARLY, CLOCK_BLOCK) if all_blocks else [F.floor(F.col("clock") / CLOCK_BLOCK)])]
    return _unknown(nodes, "media_id", [_in(at, BY_NAME, F.col("letters"), F.col("num")), _in(at, BY_NAME, F.col("letters"), F.lit(ANY))], at, when, _cells(lat, lon, 0.001) if all_blocks else [_cell(lat, lon)])


def unknown_sidecar_keys(nodes: DataFrame, scope: str, all_blocks: bool) -> DataFrame:
    at, taken, lat, lon = F.lit(scope), F.col("taken"), F.col("lat"), F.col("lon")
    number = F.coalesce(F.col("num"), F.lit(ANY))
    when = [(BY_FILE, x) for x in (_shifts(taken, -LATE, LATE, FILE_BLOCK) if all_blocks else [F.floor(taken / FILE_BLOCK)])]
    when += [(BY_CLOCK, x) for x in (_shifts(taken, -EARLY, LATE, CLOCK_BLOCK) if all_blocks else [F.floor(taken / CLOCK_BLOCK)])]
    return _unknown(nodes, "sidecar_id", [_in(at, BY_NAME, F.col(c), number) for c in ("titled_letters", "own_letters")], at, when, _cells(lat, lon, 0.001) if all_blocks else [_cell(lat, lon)])


def _unknown(nodes: DataFrame, id_: str, names: list[Column], at: Column, when: list[tuple[int, Column]], cells: list[Column]) -> DataFrame:
    return _explode(nodes, id_, names + [_in(at, kind, x, F.col("dir")) for kind, x in when] + [_in(at, BY_PLACE, x, F.lit(kind), c) for kind, x in when for c in cells])


def sifted(rows: DataFrame, few: DataFrame) -> DataFrame:
    """The rows whose keys `few` rows have too, where these are few enough to be sent to all; else all rows, which lose nothing but time."""
    if few.count() > SIFTED:
        return rows
    return rows.join(F.broadcast(few.select("key").distinct()), "key", "left_semi")


def finer(keys: DataFrame, nodes: DataFrame, id_: str, seconds: list[Column], names: list[Column], level: int) -> DataFrame:
    """The keys of the finer blocks of large ones: with one more attribute (level 1), or with two (level 2).

    An attribute that the block's key holds already adds nothing. whole:
    whether the finer key has a name, a time and a folder or place; such
    blocks are opened whatever their size.
    """
    kind = F.col("kind")
    none = F.array().cast("array<bigint>")
    lacks = lambda of, x: F.when(kind.isin(*of), none).otherwise(x)
    hashes = lambda what, x: F.transform(F.array_compact(F.array_distinct(F.array(*x))), lambda i: F.xxhash64(F.lit(what), i))
    a, b, c = lacks((BY_FILE, BY_CLOCK), hashes("second", seconds)), lacks((BY_NAME,), hashes("name", names)), hashes("folder", [F.col("dir")])
    product = lambda x, y: F.flatten(F.transform(x, lambda i: F.transform(y, lambda j: F.xxhash64(i, j))))
    more = F.concat(a, b, c) if level == 1 else F.concat(product(a, b), product(a, c), product(b, c))
    found = keys.select(id_, "key", _kind()).join(nodes, id_).select(id_, "kind", F.col("key").alias("of"), F.explode(more).alias("more"))
    return found.select(id_, F.xxhash64("of", "more").alias("key"), (F.lit(level == 2) | kind.isin(BY_LIST)).alias("whole")).distinct()


def candidates(media: DataFrame, sidecars: DataFrame, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """media_id, sidecar_id, kind, df of each pair of each open block, and what was written for it."""
    cap = max(4, int(total**0.5))
    loose_m, loose_s = media.filter("src is null"), sidecars.filter("src is null")
    um, us = cut(unknown_media_keys(loose_m, "m", True), "unknown"), cut(unknown_sidecar_keys(loose_s, "s", True), "unknown")
    a = media_keys(media).unionByName(um).unionByName(sifted(unknown_media_keys(media, "s", False), us))
    b = cut(sidecar_keys(sidecars).unionByName(us).unionByName(sifted(unknown_sidecar_keys(sidecars, "m", False), um)), "keys")
    counts = b.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    large = cut(counts.filter(F.col("df") > cap), "large")  # at most the number of keys / sqrt(N) rows
    made = [um, us, b, large]
    kept = b.join(F.broadcast(large.select("key")), "key", "left_anti")
    opened = kept.join(kept.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("df")), "key")
    shared = a.join(opened.select("key", "sidecar_id", "df"), "key").select("media_id", "sidecar_id", _kind(), "df")
    if not large.isEmpty():
        closed = F.broadcast(large.select("key"))
        la, lb = cut(a.join(closed, "key"), "large-media"), cut(b.join(closed, "key"), "large-sidecars")
        times = [F.floor(F.col("written") / FILE_BLOCK), F.floor(F.col("clock") / CLOCK_BLOCK) + (1 << 40)]
        taken = F.col("taken")
        spans = [*_shifts(taken, -LATE, LATE, FILE_BLOCK), *(x + (1 << 40) for x in _shifts(taken, -EARLY, LATE, CLOCK_BLOCK))]
        sides = lambda level: (finer(la, media, "media_id", times, [F.col("letters")], level), finer(lb, sidecars, "sidecar_id", spans, [F.col("titled_letters"), F.col("own_letters")], level))
        bring = lambda x, y: x.join(y, "key").select("media_id", "sidecar_id", F.lit(FINER).cast("byte").alias("kind"), F.lit(total).cast("int").alias("df"))
        a1, b1 = sides(1)
        b1 = cut(b1, "finer")
        sizes = cut(b1.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("w")).filter(F.col("n") > cap), "sizes")
        made += [la, lb, b1, sizes]
        closed1 = F.broadcast(sizes.filter(~F.col("w")).select("key"))
        shared = shared.unionByName(bring(a1.drop("whole"), b1.drop("whole").join(closed1, "key", "left_anti")))
        if not sizes.filter(~F.col("w")).isEmpty():
            a2, b2 = sides(2)
            shared = shared.unionByName(bring(a2.drop("whole"), b2.drop("whole")))
    return shared, made


def edges(media: DataFrame, sidecars: DataFrame, total: int) -> DataFrame:
    """media_id, sidecar_id, score, apart, m_dir, s_dir, other_name of every candidate edge that no rule forbids and that propagation can make a link.

    apart: whether the ends lie in different folders.
    """
    total = max(total, 2)
    shared, made = candidates(media, sidecars, total)
    df = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("df")))
    pairs = shared.repartition("media_id").groupBy("media_id", "sidecar_id").agg(df(BY_NAME).alias("d_name"), df(BY_BEGIN).alias("d_begin"), df(BY_FILE, BY_CLOCK).alias("d_time"), df(BY_PLACE).alias("d_place"), df(BY_LIST).alias("d_list"))
    mine = media.select("media_id", "src", F.col("dir").alias("m_dir"), "name", "num", "written", "clock")
    yours = sidecars.select("sidecar_id", F.col("src").alias("s_src"), F.col("dir").alias("s_dir"), "titled", "own", F.col("num").alias("s_num"), "taken")
    rare = lambda d: F.log(F.lit(float(total)) / F.col(d)) / F.log(F.lit(float(total)))
    both = pairs.join(mine, "media_id").join(yours, "sidecar_id")
    # Pairs of different sources, which only listed paths bring.
    both = both.filter("src is null or s_src is null or src = s_src")
    late, off = F.col("written") - F.col("taken"), F.col("clock") - F.col("taken")
    on_time = late.between(-LATE, LATE) | F.abs(F.abs(late) - HOUR).between(-LATE, LATE)
    on_clock = off.between(-EARLY, LATE)
    agree = F.coalesce(on_time, F.lit(False)) | F.coalesce(on_clock, F.lit(False))
    named, s_named = F.col("name").isNotNull(), F.coalesce("titled", "own").isNotNull()
    equal = F.coalesce(F.col("name") == F.col("titled"), F.lit(False)) | F.coalesce(F.col("name") == F.col("own"), F.lit(False))
    both = both.withColumns({"agree": agree, "by_name": F.coalesce(F.greatest(NAME * rare("d_name"), PREFIX * rare("d_begin")), F.when(equal, NAME / 2), F.lit(0.0)), "apart": F.col("m_dir") != F.col("s_dir")})
    other_name = (F.col("by_name") == 0) & named & s_named
    score = (
        F.col("by_name")
        + F.when(F.col("agree"), F.coalesce(TIME * rare("d_time"), F.lit(TIME / 2))).otherwise(0.0)
        + F.coalesce(PLACE * rare("d_place"), F.lit(0.0))
        + F.coalesce(CANDIDATE * rare("d_list"), F.lit(0.0))
        + F.when(F.col("apart"), OTHER_FOLDER).otherwise(SAME_FOLDER)
        + F.when(other_name, OTHER_NAME).otherwise(0.0)
        + F.when(~F.col("agree") & F.coalesce(~on_time, F.lit(False)), OTHER_TIME).otherwise(0.0)
        + F.when(~F.col("agree") & F.coalesce(~on_clock, F.lit(False)), OTHER_CLOCK).otherwise(0.0)
    )
    # A name that was cut has lost its number.
    lost = F.col("d_begin").isNotNull() & F.col("d_name").isNull() & (F.col("num") == 0) & (F.col("agree") | F.col("d_list").isNotNull())
    fits = F.when(F.col("s_num").isNotNull(), (F.col("num") == F.col("s_num")) | lost).otherwise((F.col("num") == 0) | F.col("agree"))
    scored = both.filter(fits).select("media_id", "sidecar_id", score.alias("score"), "apart", "m_dir", "s_dir", other_name.alias("other_name"))
    out = cut(scored.filter(F.col("score") >= F.when(F.col("apart"), ENOUGH - GAIN).otherwise(ENOUGH)), "edges")
    drop(*made)
    return out


def propagate(scored: DataFrame) -> DataFrame:
    """The edges with the weight that their neighbours give them, once that is stable.

    support: of the links of the medium's folder in the round before, the share
    that leads to the sidecar's folder, the edge itself left out. A folder of
    few links supports less: a link more than there are is taken as leading
    elsewhere.
    """
    now = scored.withColumn("weight", F.col("score"))
    for _ in range(ROUNDS):
        links = prune(now).select("media_id", "sidecar_id", "m_dir", "s_dir")
        between = links.groupBy("m_dir", "s_dir").agg(F.count(F.lit(1)).alias("l"))
        total = between.groupBy("m_dir").agg(F.sum("l").alias("t"))
        # Only folder pairs that differ can change an edge.
        support = between.filter("m_dir <> s_dir").join(total, "m_dir")
        own = (F.col("apart") & (F.col("weight") >= ENOUGH)).cast("int")
        gain = F.when(F.col("apart"), GAIN * F.greatest(F.col("l") - own, F.lit(0)) / (F.col("t") - own + 1))
        after = now.join(support, ["m_dir", "s_dir"], "left").withColumn("next", F.col("score") + F.coalesce(gain, F.lit(0.0)))
        after = cut(after.select("media_id", "sidecar_id", "score", "apart", "m_dir", "s_dir", "other_name", F.col("next").alias("weight"), F.abs(F.col("next") - F.col("weight")).alias("change")), "weighed")
        drop(now)
        now = after
        if after.filter(F.col("change") >= STABLE).isEmpty():
            break
    return now


def prune(weighed: DataFrame) -> DataFrame:
    """Keeps the links that lie within MARGIN of the best of both ends; where the names differ, the best of both ends only."""
    good = weighed.filter(F.col("weight") >= ENOUGH)
    of_media = good.groupBy("media_id").agg(F.max("weight").alias("best_m"))
    of_sidecar = good.groupBy("sidecar_id").agg(F.max("weight").alias("best_s"))
    both = good.join(of_media, "media_id").join(of_sidecar, "sidecar_id")
    strict = (F.col("weight") >= F.col("best_m") - 0.1) & (F.col("weight") >= F.col("best_s") - 0.1)
    return both.filter(F.when(F.col("other_name"), strict).otherwise(F.col("weight") >= F.col("best_m") - MARGIN)).drop("best_m", "best_s")


def spread(links: DataFrame, media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Links that neighbours have: SPREAD of the best score between the neighbours of both ends.

    Neighbours are given as class keys, so a class of n media and m sidecars
    costs n + m rows for each of its links; classes of one don't take part.
    The keys: media by content, and by source, folder, name and number;
    sidecars by source, time and name. Media of one class have one number, so
    no link crosses it.
    """
    m_key = F.explode(F.array_compact(F.array(F.when(F.col("content").isNotNull(), F.xxhash64("content", "num")), F.when(F.col("src").isNotNull() & F.col("name").isNotNull(), F.xxhash64("src", "dir", "name", "num")))))
    s_key = F.when(F.col("taken").isNotNull() & F.coalesce("own", "titled").isNotNull(), F.xxhash64("src", "taken", F.coalesce("own", "titled"), F.coalesce("num", F.lit(0))))

    def shared(rows: DataFrame, key: str) -> DataFrame:
        """Rows of classes of two or more."""
        rows = rows.filter(F.col(key).isNotNull())
        return cut(rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), key), "classes")

    members, twins = shared(media.select("media_id", m_key.alias("m_key")), "m_key"), shared(sidecars.select("sidecar_id", s_key.alias("s_key")), "s_key")
    fresh, kept = links, []
    while True:
        by_class = fresh.join(members, "media_id").groupBy("m_key", "sidecar_id").agg((F.max("score") * SPREAD).alias("score"))
        more = by_class.join(members, "m_key").select("media_id", "sidecar_id", "score")
        by_twin = fresh.join(twins, "sidecar_id").groupBy("media_id", "s_key").agg((F.max("score") * SPREAD).alias("score"))
        other = by_twin.join(twins, "s_key").select("media_id", "sidecar_id", "score")
        # Only what the last round added can add more.
        fresh = cut(more.unionByName(other).filter(F.col("score") >= ENOUGH).groupBy("media_id", "sidecar_id").agg(F.max("score").alias("score")).join(links, ["media_id", "sidecar_id"], "left_anti"), "added")
        kept.append(fresh)
        if fresh.isEmpty():
            return links
        links = links.unionByName(fresh)


def link(media: DataFrame, sidecar: DataFrame, embedded: DataFrame, exports: DataFrame) -> DataFrame:
    """media_id, sidecar_id, confidence of every pair that describes one capture.

    Null names, times, places and candidates bring no evidence. A null source
    fits any. Repeated rows are linked alike. Extra columns are ignored; empty
    tables give no rows.
    """
    spans = cut(timestamps.home_spans(exports), "spans")
    m = cut(media_nodes(media, embedded, exports, spans), "media")
    s = cut(sidecar_nodes(sidecar, exports, spans), "sidecars")
    alike = [c for c in m.columns if c not in ("media_id", "content")]
    same = [c for c in s.columns if c != "sidecar_id"]
    # The features of a node as one hash: copies are rows of one hash.
    mh = m.select("media_id", _all(alike).alias("features"))
    sh = s.select("sidecar_id", _all(same).alias("features"))
    m_first = cut(mh.groupBy("features").agg(F.min("media_id").alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    s_first = cut(sh.groupBy("features").agg(F.min("sidecar_id").alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    rep = cut(m.join(m_first.select(F.col("first").alias("media_id")), "media_id", "left_semi"), "nodes")
    reps = cut(s.join(s_first.select(F.col("first").alias("sidecar_id")), "sidecar_id", "left_semi"), "nodes")
    scored = edges(rep, reps, reps.count())
    weighed = propagate(scored)
    links = cut(prune(weighed).select("media_id", "sidecar_id", F.col("weight").alias("score")), "links")
    drop(scored, weighed, rep, reps)
    # Copies take the links of the first of them, first those of sidecars, then those of media.
    others = salted_join(sh, s_first.filter("copies > 1"), ["features"], "copies", s.count()).filter("sidecar_id <> first").select("sidecar_id", "first")
    links = links.unionByName(others.join(links.withColumnRenamed("sidecar_id", "first"), "first").select("media_id", "sidecar_id", "score"))
    copies = salted_join(mh, m_first.filter("copies > 1"), ["features"], "copies", m.count()).filter("media_id <> first").select("media_id", "first")
    everything = spread(cut(links.unionByName(copies.join(links.withColumnRenamed("media_id", "first"), "first").select("media_id", "sidecar_id", "score")), "links"), m, s)
    compatible = everything.join(m.select("media_id", F.col("src").alias("a")), "media_id").join(s.select("sidecar_id", F.col("src").alias("b")), "sidecar_id").filter("a is null or b is null or a = b")
    return compatible.select("media_id", "sidecar_id", (1 / (1 + F.exp(ENOUGH - 2 - F.col("score")))).alias("confidence"))


def _all(columns: list[str]) -> Column:
    """A hash of columns in which nulls count too."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))
