"""Matching media to sidecars by a ladder of rules, and media to their partners.

Media and sidecars meet within a scope: the folder of one source, or, for
sidecars of the global index, the folder of that name in any source. A rule
fires where two keys are equal, so each is an equi-join: all keys of both
sides go through one join on (scope, rule, key). For a pair the first rule of
the ladder counts, for a medium the pair with the highest score; equal scores
make it ambiguous.

Functions take the media columns media_id, source_id, rel_dir, file_name and
the sidecar columns sidecar_id, origin, source_id, rel_dir, sidecar_name,
title, seq; further columns are ignored. A null source is a source of its own,
a null folder is the root, null names match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions.names import LIMIT, PREFIX, common_prefix, extension, head_bytes, kind, media_stem, partner_keys, semantic_extension, strip, strip_json, with_name_keys, with_supplement_names, without
from argentum.functions.paths import dir_key
from argentum.session import cut, drop

# The scores of the rules, in the order in which they are tried.
EXACT, SUPPLEMENT, TITLE, TITLE_KEY, NAME_KEY, BY_PREFIX = 1200, 1300, 1100, 1000, 900, 700
LADDER = (EXACT, SUPPLEMENT, TITLE, TITLE_KEY, NAME_KEY)


def bundle(source: Column, folder: Column) -> Column:
    """The scope of a folder of one source."""
    return F.concat(F.lit("local|"), F.coalesce(source, F.lit("")), F.lit("|"), F.coalesce(folder, F.lit("")))


def index_scope(folder: Column) -> Column:
    """The scope of a folder in the index over all sources."""
    return F.concat(F.lit("global|"), dir_key(F.coalesce(folder, F.lit(""))))


def _row(rule: str, key: Column, what: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), key.alias("key"), F.coalesce(what, F.lit("")).alias("what"))


def _each(rule: str, keys: Column, what: Column) -> Column:
    return F.transform(keys, lambda k: _row(rule, k, what))


def _exploded(rows: DataFrame, *keys: Column) -> DataFrame:
    exploded = rows.withColumn("k", F.explode(F.flatten(F.array(*keys)))).select("*", "k.rule", "k.key", "k.what").drop("k")
    return exploded.filter("key is not null and key <> ''")


def media_rows(media: DataFrame) -> DataFrame:
    """media_id, scope, rule, key, what (the extension where it counts) of each medium in both of its scopes."""
    rows = with_name_keys(media.filter("file_name is not null").select("media_id", "source_id", "rel_dir", "file_name"), "file_name", "keys")
    low = F.lower("file_name")
    scopes = F.array(bundle(F.col("source_id"), F.col("rel_dir")), index_scope(F.col("rel_dir")))
    rows = rows.withColumns({"low": low, "ext": semantic_extension(low), "scopes": scopes}).select("media_id", "low", "ext", "keys", "scopes")
    low, ext = F.col("low"), F.col("ext")
    none = F.lit("")
    begun = F.when((F.octet_length(low) >= PREFIX) & (ext != ""), head_bytes(low, PREFIX))
    keyed = _exploded(rows, F.array(_row("exact", F.concat(low, F.lit(".json")), none), _row("supplement", low, none), _row("title", low, none), _row("prefix", begun, ext)), _each("key", F.col("keys"), ext))
    return keyed.select("media_id", F.explode("scopes").alias("scope"), "rule", "key", "what")


def first_global(sidecar: DataFrame) -> DataFrame:
    """The sidecars, of the global ones only the first of each folder and name (without case) by seq, then id."""
    ranked = sidecar.filter("origin = 'global'").withColumn("_r", F.row_number().over(Window.partitionBy(dir_key(F.coalesce("rel_dir", F.lit(""))), F.lower("sidecar_name")).orderBy("seq", "sidecar_id")))
    return sidecar.filter("origin is null or origin <> 'global'").unionByName(ranked.filter("_r = 1").drop("_r"))


def merged(media: DataFrame, sidecar: DataFrame) -> DataFrame:
    """source_id, rel_dir, sidecar_id: the sidecars among which the media of a folder choose.

    Those of the folder, and those of the index whose folder has its name and
    whose own name, without case, no sidecar of the folder has.
    """
    folders = media.select(F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("rel_dir", F.lit("")).alias("rel_dir")).distinct().withColumns({"own": bundle(F.col("source_id"), F.col("rel_dir")), "any": index_scope(F.col("rel_dir"))})
    known = first_global(sidecar.filter("sidecar_name is not null").select("sidecar_id", "origin", "source_id", "rel_dir", "sidecar_name", "seq")).select("sidecar_id", (F.col("origin") == "global").alias("g"), bundle(F.col("source_id"), F.col("rel_dir")).alias("own"), index_scope(F.col("rel_dir")).alias("any"), F.lower("sidecar_name").alias("name"))
    local = known.filter(~F.coalesce("g", F.lit(False)))
    here = folders.join(local.drop("any", "g"), "own")
    more = folders.join(known.filter("g").drop("own", "g"), "any").join(local.select("own", "name").distinct(), ["own", "name"], "left_anti")
    return here.select("source_id", "rel_dir", "sidecar_id").unionByName(more.select("source_id", "rel_dir", "sidecar_id"))


def title_text() -> Column:
    return F.coalesce(strip(F.col("title")), F.lit(""))


def sidecar_rows(sidecar: DataFrame) -> DataFrame:
    """sidecar_id, scope, rule, key, what, kind (title or name) of each sidecar in its scope."""
    rows = sidecar.filter("sidecar_name is not null").select("sidecar_id", "origin", "source_id", "rel_dir", F.col("sidecar_name").alias("name"), title_text().alias("title"), "seq", "sidecar_name")
    rows = first_global(rows)
    rows = with_supplement_names(with_name_keys(with_name_keys(rows, "title", "title_keys"), "name", "name_keys"), "name", "means")
    text = F.when(F.col("title") != "", F.col("title")).otherwise(without(F.col("name"), extension(F.col("name"))))
    rows = rows.withColumns({"low": F.lower("name"), "titled": F.lower("title"), "title_ext": semantic_extension(F.col("title")), "name_ext": semantic_extension(F.col("name")), "begin": F.lower(strip_json(text)), "begin_ext": F.lower(extension(text)), "scope": F.when(F.col("origin") == "global", index_scope(F.col("rel_dir"))).otherwise(bundle(F.col("source_id"), F.col("rel_dir")))})
    none = F.lit("")
    begun = F.when((F.octet_length("begin") >= PREFIX) & (F.col("begin_ext") != ""), head_bytes(F.col("begin"), PREFIX))
    keyed = _exploded(
        rows,
        F.array(_row("exact", F.col("low"), none), _row("title", F.col("titled"), none), _row("prefix", begun, F.col("begin_ext"))),
        _each("supplement", F.col("means"), none),
        _each("key", F.col("title_keys"), F.concat(F.lit("title"), F.col("title_ext"))),
        _each("key", F.col("name_keys"), F.concat(F.lit("name"), F.col("name_ext"))),
    )
    is_title = (F.col("rule") == "key") & F.col("what").startswith("title")
    what = F.when(F.col("rule") == "key", F.when(is_title, F.substring("what", 6, 300)).otherwise(F.substring("what", 5, 300))).otherwise(F.col("what"))
    return keyed.select("sidecar_id", "scope", "rule", "key", what.alias("what"), is_title.alias("of_title"))


def scored(media: DataFrame, sidecar: DataFrame) -> DataFrame:
    """media_id, sidecar_id, score, exact, titled, keyed of each pair for which a rule fires.

    exact, titled, keyed: whether the names, title and name, or any keys are
    equal, which decides the name of the strategy. A global sidecar is left
    out where the medium's own folder has one of that name.
    """
    a, b = media_rows(media), sidecar_rows(sidecar)
    met = a.join(b.withColumnRenamed("what", "with"), ["scope", "rule", "key"])
    rule, same = F.col("rule"), F.col("what") == F.col("with")
    step = F.when(rule == "exact", 0).when(rule == "supplement", 1).when(rule == "title", 2).when((rule == "key") & same & F.col("of_title"), 3).when((rule == "key") & same, 4).when((rule == "prefix") & same, 5).otherwise(6)
    pairs = met.groupBy("media_id", "sidecar_id").agg(F.min(step).alias("step"), F.bool_or(rule == "exact").alias("exact"), F.bool_or(rule == "title").alias("titled"), F.bool_or(rule == "key").alias("keyed"))
    pairs = pairs.filter("step < 6")
    files = media.select("media_id", F.lower("file_name").alias("_low"), bundle(F.col("source_id"), F.col("rel_dir")).alias("_scope"))
    text = F.when(title_text() != "", title_text()).otherwise(without(F.col("sidecar_name"), extension(F.col("sidecar_name"))))
    said = sidecar.select("sidecar_id", "origin", F.lower("sidecar_name").alias("_name"), text.alias("_text"))
    both = pairs.join(files, "media_id").join(said, "sidecar_id")
    long = (F.octet_length("_text") >= LIMIT) | (F.octet_length("_low") >= LIMIT)
    shared = F.when(F.col("step") == 5, common_prefix(F.lower(strip_json(F.col("_text"))), F.col("_low")))
    score = F.when(F.col("step") < 5, F.element_at(F.array(*(F.lit(s) for s in LADDER)), F.col("step") + 1)).when(long & (shared >= PREFIX), BY_PREFIX + shared)
    both = both.withColumn("score", score.cast("int")).filter("score is not null")
    # Names that a folder has itself hide the global ones.
    own = sidecar.filter("origin is null or origin <> 'global'").select(bundle(F.col("source_id"), F.col("rel_dir")).alias("_scope"), F.lower("sidecar_name").alias("_name")).distinct()
    globals_ = both.filter("origin = 'global'").join(own, ["_scope", "_name"], "left_anti")
    kept = both.filter("origin is null or origin <> 'global'").select(globals_.columns).unionByName(globals_)
    return kept.select("media_id", "sidecar_id", "score", "exact", "titled", "keyed")


def best(media: DataFrame, pairs: DataFrame) -> DataFrame:
    """media_id, status, strategy, score, sidecar_id, candidates of every medium.

    status: matched, ambiguous (several sidecars share the highest score) or
    unmatched. sidecar_id is null unless matched; candidates counts the
    sidecars of the highest score.
    """
    by_score = pairs.groupBy("media_id", "score").agg(F.count(F.lit(1)).alias("candidates"), F.min("sidecar_id").alias("sidecar_id"), F.bool_or("exact").alias("exact"), F.bool_or("titled").alias("titled"), F.bool_or("keyed").alias("keyed"))
    top = by_score.groupBy("media_id").agg(F.max_by(F.struct("score", "candidates", "sidecar_id", "exact", "titled", "keyed"), "score").alias("t")).select("media_id", "t.*")
    one = F.col("candidates") == 1
    strategy = F.when(one, F.when(F.col("exact"), "exact-name").when(F.col("titled"), "json-title").when(F.col("keyed"), "normalized-name").otherwise("prefix"))
    status = F.when(F.col("candidates").isNull(), "unmatched").when(one, "matched").otherwise("ambiguous")
    return media.select("media_id").join(top, "media_id", "left").select("media_id", status.alias("status"), strategy.alias("strategy"), F.coalesce("score", F.lit(0)).alias("score"), F.when(one, F.col("sidecar_id")).alias("sidecar_id"), F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"))


def ambiguous(pairs: DataFrame) -> DataFrame:
    """media_id, sidecar_id, score: the sidecars among which an ambiguous medium can't choose."""
    counts = pairs.groupBy("media_id", "score").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("media_id").agg(F.max(F.struct("score", "n")).alias("t")).select("media_id", "t.score", "t.n").filter("n > 1").drop("n")
    return pairs.join(top, ["media_id", "score"]).select("media_id", "sidecar_id", "score")


def partners(media: DataFrame) -> DataFrame:
    """media_id, partner_id of media that have one: an image for a video, a video for an image, of the same folder.

    The only opposite file of the same stem, else the only one with which any
    partner key is shared. Buckets hold counts and the smallest and largest
    id, never pairs, so that a large one costs no more than its rows. Files
    that are neither image nor video have no partner.
    """
    rows = media.select("media_id", bundle(F.col("source_id"), F.col("rel_dir")).alias("scope"), "file_name", kind(F.col("file_name")).alias("kind")).filter("kind is not null")
    rows = with_name_keys(rows, "file_name", "keys").withColumns({"stem": media_stem(F.col("file_name")), "opposite": F.when(F.col("kind") == "video", "image").otherwise("video")})
    rows = rows.select("media_id", "scope", "kind", "opposite", "stem", partner_keys(F.col("keys")).alias("keys"))
    stems = rows.filter("stem <> ''").groupBy("scope", "stem", F.col("kind").alias("opposite")).agg(F.count(F.lit(1)).alias("n"), F.min("media_id").alias("by_stem")).filter("n = 1").drop("n")
    each = rows.select("media_id", "scope", "kind", "opposite", F.explode("keys").alias("key"))
    buckets = each.groupBy("scope", "key", F.col("kind").alias("opposite")).agg(F.min("media_id").alias("least"), F.max("media_id").alias("most"))
    by_key = each.join(buckets, ["scope", "key", "opposite"]).groupBy("media_id").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least = most").select("media_id", F.col("least").alias("by_key"))
    found = rows.select("media_id", "scope", "stem", "opposite").join(stems, ["scope", "stem", "opposite"], "left").join(by_key, "media_id", "left")
    return found.select("media_id", F.coalesce("by_stem", "by_key").alias("partner_id")).filter("partner_id is not null")


def inherit(matches: DataFrame, partner: DataFrame, media: DataFrame) -> DataFrame:
    """The matches, with media that aren't matched taking the sidecar of their partner; adds partner_id.

    One pass in the order of file names: a medium sees what its partner took
    if that comes before it. Each round settles the media whose partner was
    settled in the round before; a chain goes on only to later names, so the
    rounds end.
    """
    names = media.select("media_id", F.struct(F.coalesce("file_name", F.lit("")).alias("n"), F.col("media_id").alias("i")).alias("at"))
    now = matches.join(partner, "media_id", "left").join(names, "media_id").withColumn("round", F.when(F.col("status") == "matched", 0))
    hop, kept = 0, None
    while True:
        known = now.filter(F.col("round") == hop).select(F.col("media_id").alias("partner_id"), F.col("sidecar_id").alias("s"), F.col("score").alias("sc"), F.col("at").alias("before"))
        free = F.col("round").isNull() & F.col("s").isNotNull() & ((F.lit(hop) == 0) | (F.col("before") < F.col("at")))
        step = now.join(known, "partner_id", "left").withColumn("free", free)
        taken = {"status": F.lit("matched"), "strategy": F.lit("partner-sidecar"), "score": F.col("sc"), "sidecar_id": F.col("s"), "candidates": F.lit(1).cast("bigint"), "round": F.lit(hop + 1)}
        after = cut(step.select("media_id", "partner_id", "at", *(F.when(F.col("free"), v).otherwise(F.col(c)).alias(c) for c, v in taken.items())), "matches")
        drop(*([kept] if kept is not None else []))
        now, kept, hop = after, after, hop + 1
        if now.filter(F.col("round") == hop).isEmpty():
            return now.drop("at", "round")


def match(media: DataFrame, sidecar: DataFrame) -> DataFrame:
    """media_id, status, strategy, score, sidecar_id, candidates, partner_id of every medium."""
    return inherit(cut(best(media, scored(media, sidecar)), "best"), cut(partners(media), "partners"), media)
