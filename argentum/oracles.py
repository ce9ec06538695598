"""The queries of the core as SQL on the same tables, written apart from the operators: plain loops over folders instead of keyed joins."""

from __future__ import annotations

from argentum.functions.folders import YEAR_FOLDER
from argentum.operators.changefeed import OLD_STATUS
from argentum.operators.records import SUCCESSFUL

WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def ext(x: str) -> str:
    return rf"regexp_extract({x}, '(\.[^./]*)$', 1)"


def no_ext(x: str) -> str:
    return f"left({x}, length({x}) - length({ext(x)}))"


def no_json(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)\.json$', '')"


def kind(x: str) -> str:
    return f"case when lower({ext(x)}) in ('.jpg','.jpeg','.png','.heic') then 'image' when lower({ext(x)}) in ('.3gp','.avi','.m4v','.mkv','.mov','.mp4') then 'video' end"


AFTER = r"'^([^\n]*)(\.[^.]+)\((\d+)\)$'"
BEFORE = r"'^([^\n]*)\((\d+)\)(\.[^.]+)$'"
SUPPLEMENT = r"'(?i)^([^\n]*)\.supplemental-metadata(?:\((\d+)\))?\.json$'"
PAIR = "[0-9A-F]{2}"
NO_DOT = "(?:[013-9A-F][0-9A-F]|2[0-9A-DF])"
NO_DOT_SLASH = "(?:[013-9A-F][0-9A-F]|2[0-9A-D])"
HEX_AFTER = f"'^((?:{PAIR})*)(2E{NO_DOT}+)28((?:3[0-9])+)29$'"


def semantic(x: str) -> str:
    n = f"lower({strip(no_json(x))})"
    return f"case when regexp_matches({n}, {AFTER}) then regexp_extract({n}, {AFTER}, 2) else {ext(n)} end"


def stem(x: str) -> str:
    n = f"lower({strip(x)})"
    return rf"case when regexp_matches({n}, {AFTER}) then regexp_replace({n}, {AFTER}, '\1(\3)') else {no_ext(n)} end"


def top(x: str) -> str:
    return rf"string_split(regexp_replace(replace({x}, '\', '/'), '^/+|/+$', '', 'g'), '/')[1]"


def is_year(x: str) -> str:
    return f"coalesce(regexp_matches({x}, {quote(YEAR_FOLDER)}), false)"


def clean(x: str) -> str:
    parts = rf"[p for p in string_split(replace({x}, '\', '/'), '/') if p <> '' and p <> '.']"
    return f"(case when starts_with({x}, '/') then '/' else '' end || coalesce(array_to_string({parts}, '/'), ''))"


def keys(x: str) -> str:
    """The keys of a name as a list of the hexadecimal digits of their bytes."""
    return f"""(select list_distinct([k for k in [regexp_replace(k, '(?:20|09|0A|0D)+$', '') for k in
        list_concat([hex(encode(n)), hex(encode(s))],
          case when contains(s, '-edited') then [hex(encode(regexp_replace(s, '-edited', '') || e)), hex(encode(regexp_replace(s, '-edited', '')))] else [] end,
          case when regexp_matches(s, '^([^\\n]*)-(\\d+)$') then [hex(encode(regexp_extract(s, '^([^\\n]*)-(\\d+)$', 1) || e)), hex(encode(regexp_extract(s, '^([^\\n]*)-(\\d+)$', 1)))] else [] end,
          case when regexp_matches(n, {BEFORE}) then [hex(encode(regexp_replace(n, {BEFORE}, '\\1\\3'))), hex(encode(regexp_replace(n, {BEFORE}, '\\1\\3(\\2)')))] else [] end,
          case when regexp_matches(n, {AFTER}) then [hex(encode(regexp_replace(n, {AFTER}, '\\1(\\3)\\2'))), hex(encode(regexp_replace(n, {AFTER}, '\\1\\2')))] else [] end,
          case when strlen(n) > 46 then [substr(hex(encode(n)), 1, 92)] else [] end,
          case when strlen(n) > 46 and e <> '' and strlen(s) > 46 then [substr(hex(encode(s)), 1, 92) || hex(encode(e))] else [] end)] if k <> '' and n <> ''])
      from (select n, {ext('n')} as e, {no_ext('n')} as s from (select lower({strip(no_json(f"coalesce({x}, '')"))}) as n)))"""


def partner_list(k: str) -> str:
    """Partner keys of a list of keys, in hexadecimal digits."""
    drop = f"regexp_replace(k, '^((?:{PAIR})*?)(2E{NO_DOT_SLASH}*)$', '\\1')"
    each = f"case when regexp_matches(k, {HEX_AFTER}) then [regexp_extract(k, {HEX_AFTER}, 1), regexp_replace(k, {HEX_AFTER}, '\\1') || '28' || regexp_extract(k, {HEX_AFTER}, 3) || '29'] else [{drop}] end"
    return f"list_distinct([x for x in [regexp_replace(x, '^(?:20)+|(?:20)+$', '', 'g') for x in flatten([{each} for k in {k}])] if x <> ''])"


def supplement_list(x: str) -> str:
    m, o = f"regexp_extract({strip(x)}, {SUPPLEMENT}, 1)", f"regexp_extract({strip(x)}, {SUPPLEMENT}, 2)"
    return f"(case when not regexp_matches({strip(x)}, {SUPPLEMENT}) then [] when {o} = '' then [lower({m})] when {ext(m)} = '' then [lower({m} || '(' || {o} || ')')] else [lower({no_ext(m)} || '(' || {o} || ')' || {ext(m)}), lower({m} || '(' || {o} || ')')] end)"


MEDIA = f"""m as materialized (select media_id, coalesce(source_id, '') as src, coalesce(rel_dir, '') as dir, lower({clean("coalesce(rel_dir, '')")}) as dk, file_name,
    lower(file_name) as low, {semantic('lower(file_name)')} as ext, {keys('file_name')} as ks, {kind('file_name')} as kind, {stem('file_name')} as stem from media)"""
SIDECARS = f"""s0 as materialized (select sidecar_id, coalesce(origin, '') as origin, coalesce(source_id, '') as src, coalesce(rel_dir, '') as dir, lower({clean("coalesce(rel_dir, '')")}) as dk, sidecar_name as name,
      coalesce({strip('title')}, '') as title, seq, row_number() over (partition by origin, lower({clean("coalesce(rel_dir, '')")}), lower(sidecar_name) order by seq, sidecar_id) as nth from sidecar where sidecar_name is not null),
  s1 as (select * from s0 where origin <> 'global' or nth = 1),
  s as materialized (select *, {keys('title')} as tk, {keys('name')} as nk, {semantic('title')} as tx, {semantic('name')} as nx, {supplement_list('name')} as su,
      case when title <> '' then title else {no_ext('name')} end as txt from s1)"""
CANDIDATES = """c as (select m.media_id, s.sidecar_id from m join s on s.origin <> 'global' and m.src = s.src and m.dir = s.dir
    union all select m.media_id, s.sidecar_id from m join s on s.origin = 'global' and m.dk = s.dk
      where not exists (select 1 from s as l where l.origin <> 'global' and l.src = m.src and l.dir = m.dir and lower(l.name) = lower(s.name)))"""


def lcp(a: str, b: str) -> str:
    return f"coalesce(list_position([substr(hex(encode({a})), 2 * i - 1, 2) = substr(hex(encode({b})), 2 * i - 1, 2) for i in range(1, least(strlen({a}), strlen({b})) + 1)], false) - 1, least(strlen({a}), strlen({b})))"


SCORED = f"""{MEDIA}, {SIDECARS}, {CANDIDATES},
  p as materialized (select media_id, sidecar_id, score, exact, titled, keyed from (select m.media_id, s.sidecar_id,
      case when lower(s.name) = m.low || '.json' then 1200
           when list_contains(s.su, m.low) then 1300
           when s.title <> '' and lower(s.title) = m.low then 1100
           when s.tx = m.ext and list_has_any(m.ks, s.tk) then 1000
           when s.nx = m.ext and list_has_any(m.ks, s.nk) then 900
           when m.ext <> '' and m.ext = lower({ext('s.txt')}) and (strlen(s.txt) >= 46 or strlen(m.low) >= 46) and {lcp(f'lower({no_json("s.txt")})', 'm.low')} >= 20
             then 700 + {lcp(f'lower({no_json("s.txt")})', 'm.low')} else 0 end as score,
      lower(s.name) = m.low || '.json' as exact, s.title <> '' and lower(s.title) = m.low as titled, list_has_any(m.ks, s.tk) or list_has_any(m.ks, s.nk) as keyed
    from c join m using (media_id) join s using (sidecar_id)) where score > 0)"""
BEST = """top as (select media_id, max(score) as score from p group by media_id),
  ties as (select p.* from p join top using (media_id, score)),
  b as materialized (select m.media_id, case when count(t.sidecar_id) = 0 then 'unmatched' when count(t.sidecar_id) = 1 then 'matched' else 'ambiguous' end as status,
      case when count(t.sidecar_id) = 1 then case when any_value(t.exact) then 'exact-name' when any_value(t.titled) then 'json-title' when any_value(t.keyed) then 'normalized-name' else 'prefix' end end as strategy,
      cast(coalesce(max(t.score), 0) as integer) as score, case when count(t.sidecar_id) = 1 then min(t.sidecar_id) end as sidecar_id, count(t.sidecar_id) as candidates
    from m left join ties t on t.media_id = m.media_id group by m.media_id)"""
PARTNERS = f"""mp as materialized (select media_id, src, dir, kind, stem, {partner_list('ks')} as pk from m where kind is not null),
  by_stem as (select a.media_id, min(o.media_id) as partner_id from mp a join mp o on a.src = o.src and a.dir = o.dir and a.kind <> o.kind and a.stem = o.stem where a.stem <> '' group by a.media_id having count(*) = 1),
  by_key as (select a.media_id, min(o.media_id) as partner_id from mp a join mp o on a.src = o.src and a.dir = o.dir and a.kind <> o.kind and list_has_any(a.pk, o.pk) group by a.media_id having count(*) = 1),
  w as materialized (select mp.media_id, coalesce(by_stem.partner_id, by_key.partner_id) as partner_id from mp left join by_stem using (media_id) left join by_key using (media_id) where coalesce(by_stem.partner_id, by_key.partner_id) is not null)"""
# What a medium takes from its partner, and what goes on from there to media with later names.
INHERITED = """taken as materialized (with recursive r as (
      select b.media_id, q.sidecar_id, q.score, m.file_name from b join w using (media_id) join b q on q.media_id = w.partner_id and q.status = 'matched' join m on m.media_id = b.media_id where b.status <> 'matched'
      union select b.media_id, r.sidecar_id, r.score, m.file_name from r join w on w.partner_id = r.media_id join b on b.media_id = w.media_id and b.status <> 'matched' join m on m.media_id = b.media_id
        where (coalesce(r.file_name, ''), r.media_id) < (coalesce(m.file_name, ''), m.media_id)) select * from r),
  x as materialized (select b.media_id, case when t.media_id is null then b.status else 'matched' end as status, case when t.media_id is null then b.strategy else 'partner-sidecar' end as strategy,
      coalesce(t.score, b.score) as score, coalesce(t.sidecar_id, b.sidecar_id) as sidecar_id, case when t.media_id is null then b.candidates else 1 end as candidates, w.partner_id
    from b left join w using (media_id) left join taken t on t.media_id = b.media_id)"""

ZULU = r"'^(\d{4}):(\d{2}):(\d{2}) (\d{1,2}):(\d{2}):(\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})?$'"
RFC = r"'^(\d{4})-(\d{2})-(\d{2})T(\d{1,2}):(\d{2}):(\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})$'"


def flexible(x: str, fallback: str) -> str:
    t = strip(x)
    zone = rf"case when regexp_extract({t}, {ZULU}, 8) <> '' then regexp_extract({t}, {ZULU}, 8) when regexp_matches({fallback}, '^[+-]\d\d:\d\d$') then {fallback} else 'Z' end"
    plain = rf"case when regexp_matches({t}, {ZULU}) then regexp_replace({t}, {ZULU}, '\1-\2-\3 \4:\5:\6\7') || {zone} when regexp_matches({t}, {RFC}) then regexp_replace({t}, {RFC}, '\1-\2-\3 \4:\5:\6\7\8') end"
    return f"epoch_us(try_cast({plain} as timestamptz))"


def seconds(x: str) -> str:
    return rf"case when regexp_matches({strip(x)}, '^[+-]?\d+$') then try_cast({strip(x)} as bigint) end"


BEST_S = f"coalesce({seconds('photo_taken_timestamp')}, {seconds('creation_timestamp')})"
GEO = "(coalesce(geo_latitude, 0) <> 0 or coalesce(geo_longitude, 0) <> 0 or coalesce(geo_altitude, 0) <> 0)"
LAT = f"case when {GEO} then coalesce(geo_latitude, 0) else coalesce(exif_latitude, 0) end"
LON = f"case when {GEO} then coalesce(geo_longitude, 0) else coalesce(exif_longitude, 0) end"
ALT = f"case when {GEO} then coalesce(geo_altitude, 0) else 0 end"
# One readable embedded row of each path, and everything known of each medium.
EMBEDDED = f"""e as materialized (select coalesce(source_id, '') as src, rel_path, arg_min(embedded_id, embedded_id) as embedded_id from embedded_meta where is_readable group by all),
  em as materialized (select e.src, e.rel_path, t.embedded_id, {flexible('capture_text', 'utc_offset')} as us, capture_source, utc_offset, title as etitle, description as edesc, coalesce(lat, 0) as elat, coalesce(lon, 0) as elon from e join embedded_meta t using (embedded_id))"""
KNOWN = f"""{SCORED}, {BEST}, {PARTNERS}, {INHERITED}, {EMBEDDED},
  k as materialized (select media.media_id, media.source_id, media.rel_path, media.rel_dir, media.file_name, {top('media.rel_path')} as top, epoch_us(media.mtime) as written, x.status, x.sidecar_id,
      {seconds('sc.photo_taken_timestamp')} as taken, {BEST_S.replace('photo_taken_timestamp', 'sc.photo_taken_timestamp').replace('creation_timestamp', 'sc.creation_timestamp')} as s,
      {LAT} as glat, {LON} as glon, {ALT} as galt, sc.title, sc.description, em.embedded_id, em.us, em.capture_source, em.utc_offset, em.etitle, em.edesc, em.elat, em.elon
    from media join x using (media_id) left join sidecar sc on sc.sidecar_id = x.sidecar_id left join em on em.src = coalesce(media.source_id, '') and em.rel_path = media.rel_path)"""


def name_date(x: str) -> str:
    """The first date of a name, told apart by what lies between the matches."""
    marked = rf"regexp_replace({strip(x)}, '([12][0-9]{{3}})[-_.]?([01][0-9])[-_.]?([0-3][0-9])', chr(1) || '\1-\2-\3' || chr(2), 'g')"
    return rf"""(select [d for d in [case when not regexp_matches(replace(q[i - 1], chr(2), ''), '[0-9]$') and not regexp_matches(split_part(q[i], chr(2), 2), '^[0-9]') and not (split_part(q[i], chr(2), 2) = '' and i < len(q))
        then try_cast(split_part(q[i], chr(2), 1) as date) end for i in range(2, len(q) + 1)] if d is not null][1] from (select string_split({marked}, chr(1)) as q))"""


DONE = "(" + ", ".join(quote(s) for s in SUCCESSFUL) + ")"
STATUS = "case status " + " ".join(f"when {quote(a)} then {quote(b)}" for a, b in OLD_STATUS.items()) + " else status end"
STATE = "st as (select * from (select *, case when coalesce(source_id, '') = '' then source_rel_path else source_id || '|' || source_rel_path end as state_key from process_record where coalesce(source_rel_path, '') <> '') qualify row_number() over (partition by state_key order by record_id desc) = 1)"
TIMELINE = f"{is_year(top('source_rel_path'))}"
MANIFEST = f"mf as (select *, {STATUS} as now from manifest_change where coalesce(zip_fingerprint, '') <> '' qualify row_number() over (partition by zip_fingerprint order by received_at desc nulls last, change_id desc) = 1)"
COUNTERS = f"""count(*) as total_media, cast(0 as bigint) as json_sidecars_found, count(*) filter (match_status = 'matched') as matched,
  count(*) filter (match_status = 'matched' and coalesce(match_strategy in ('exact-name', 'json-title'), false)) as matched_cleanly,
  count(*) filter (match_status = 'matched' and not coalesce(match_strategy in ('exact-name', 'json-title'), false)) as matched_with_fallback,
  count(*) filter (match_status = 'unmatched') as unmatched, count(*) filter (match_status = 'ambiguous') as ambiguous,
  count(*) filter (coalesce(output_path, '') <> '' and status in {DONE} and status <> 'dry-run') as output_media,
  cast(0 as bigint) as metadata_written, cast(0 as bigint) as xmp_sidecars_written, cast(0 as bigint) as metadata_verified,
  count(*) filter (contains(coalesce(error_text, ''), 'verification failed')) as metadata_verification_failures,
  count(*) filter (status in ('hard-linked', 'symlinked')) as duplicates_linked, count(*) filter (status = 'duplicate-copied') as duplicates_copied,
  count(*) filter (status in ('hard-linked', 'symlinked', 'duplicate-copied')) as duplicates_reused,
  count(*) filter (status = 'skipped-resume') as resumed, count(*) filter (status = 'skipped-existing') as existing_skipped, cast(0 as bigint) as conflicts_found,
  count(*) filter (match_strategy = 'partner-sidecar') as partner_sidecar_used,
  cast(coalesce(sum(case when status in ('hard-linked', 'symlinked') then source_size end), 0) as bigint) as approx_dedup_bytes_saved, cast(0 as bigint) as suspicious_dates,
  count(*) filter (status = 'error' or coalesce(error_text, '') <> '') as errors"""


def human(x: str) -> str:
    units = ["KB", "MB", "GB", "TB", "PB"]
    steps = " ".join(f"when {x} >= {1024 ** k} then printf('%.1f {units[k - 1]}', {x} / {float(1024 ** k)})" for k in range(5, 0, -1))
    return f"case when {x} is null or {x} <= 0 then '0 B' {steps} else {x}::varchar || ' B' end"


def fixed(x: str) -> str:
    return f"(case when strlen({x}) = 6 then case when starts_with({x}, '-') then -1 else 1 end * (coalesce(try_cast(substr({x}, 2, 2) as integer), 0) * 3600 + coalesce(try_cast(substr({x}, 5, 2) as integer), 0) * 60) else 0 end)"


def offset_text(x: str) -> str:
    return f"(case when {x} < 0 then '-' else '+' end || lpad((abs({x}) // 3600)::varchar, 2, '0') || ':' || lpad((abs({x}) % 3600 // 60)::varchar, 2, '0'))"


CAPTURE_OFFSET = f"cast(case when glat <> 0 or glon <> 0 then round(glon / 15) * 3600 when coalesce(utc_offset, '') <> '' then {fixed('utc_offset')} else 0 end as integer)"


def txt(x: str) -> str:
    return f"coalesce({strip(x)}, '')"


WRITES = {
    "prefer-json": ("s is not null", "(glat <> 0 or glon <> 0)", f"{txt('title')} <> ''", f"{txt('description')} <> ''"),
    "prefer-embedded": ("s is not null and us is null", "(glat <> 0 or glon <> 0) and not (coalesce(elat, 0) <> 0 or coalesce(elon, 0) <> 0)", f"{txt('title')} <> '' and {txt('etitle')} = ''", f"{txt('description')} <> '' and {txt('edesc')} = ''"),
    "merge": ("s is not null", "(glat <> 0 or glon <> 0)", f"{txt('title')} <> '' and {txt('etitle')} = ''", f"{txt('description')} <> '' and {txt('edesc')} = ''"),
}
IN_RANGE = "between -62135596800 and 253402300799"


def values(rows: list[tuple], columns: str, name: str) -> str:
    """Rows as a table expression."""
    lit = lambda v: "null" if v is None else quote(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    cols = ", ".join(c.split()[0] for c in columns.split(", "))
    return f"{name}({cols}) as (values {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)})"


def matching_sql() -> dict[str, str]:
    scored = f"with {SCORED} select media_id, sidecar_id, cast(score as integer) as score, exact, titled, keyed from p"
    tiers = {"match_exact": "score = 1200", "match_supplement": "score = 1300", "match_title": "score = 1100", "match_keys": "score in (900, 1000)", "match_prefix": "score between 720 and 899"}
    return {
        "match_scored": scored,
        **{k: f"with {SCORED} select media_id, sidecar_id, cast(score as integer) as score from p where {v}" for k, v in tiers.items()},
        "match_best": f"with {SCORED}, {BEST} select media_id, status, strategy, score, sidecar_id, candidates from b",
        "match_ambiguous": f"with {SCORED}, {BEST} select media_id, t.sidecar_id, cast(t.score as integer) as score from ties t join b using (media_id) where b.status = 'ambiguous'",
        "match_strategies": f"with {SCORED}, {BEST} select status, strategy, count(*) as media from b group by all",
        "sidecar_union": f"with {MEDIA}, {SIDECARS}, {CANDIDATES} select distinct m.src as source_id, m.dir as rel_dir, sidecar_id from c join m using (media_id)",
        "partner_pairs": f"with {MEDIA}, {PARTNERS} select media_id, partner_id from w",
        "match_media": f"with {SCORED}, {BEST}, {PARTNERS}, {INHERITED} select media_id, status, strategy, cast(score as integer) as score, sidecar_id, candidates, partner_id from x",
    }


def name_sql() -> dict[str, str]:
    names = "n as (select file_name as name from media where file_name is not null union select sidecar_name from sidecar where sidecar_name is not null union select title from sidecar where title is not null)"
    return {
        "media_classify": f"select media_id, {kind('file_name')} as kind from media",
        "media_counts": f"select (select count(*) from media where {kind('file_name')} is not null) as media, count(*) filter (lower({ext('sidecar_name')}) = '.json') as sidecars, count(*) filter (lower({ext('sidecar_name')}) = '.json' and lower(sidecar_name) <> 'user-generated-memory-titles.json') as indexable from sidecar",
        "year_folders": f"select media_id, top, {is_year('top')} as is_year, case when {is_year(strip('top'))} then cast(right({strip('top')}, 4) as integer) end as year from (select media_id, {top('rel_path')} as top from media)",
        "name_parts": f"select media_id, {ext('file_name')} as ext, {semantic('file_name')} as semantic, {stem('file_name')} as stem from media",
        "name_keys": f"with {names} select name, unnest({keys('name')}) as key from n",
        "partner_keys": f"with {names}, k as (select name, {keys('name')} as ks from n) select name, unnest({partner_list('ks')}) as key from k",
        "supplement_names": f"select sidecar_id, unnest({supplement_list('sidecar_name')}) as media_name from sidecar where sidecar_name is not null",
        "shared_prefix": f"select sidecar_id, cast({lcp('title', 'sidecar_name')} as bigint) as bytes from sidecar where title is not null and sidecar_name is not null",
    }


def date_sql() -> dict[str, str]:
    year = f"case when {is_year(strip('top'))} then cast(right({strip('top')}, 4) as integer) end"
    noon = "epoch_us(cast({} as timestamp)) + 43200000000"
    source = "'embedded' || case when coalesce(capture_source, '') <> '' then ':' || capture_source else '' end"
    dated = f"""{KNOWN}, n as (select *, {name_date('file_name')} as named, {year} as fy, taken {IN_RANGE} as has_taken from k),
      d as (select *, case when has_taken then 1 when us is not null then 2 when named is not null and (fy is null or year(named) = fy) then 3 when fy is not null then 4 when written is not null then 5 end as rule from n),
      f as (select *, case rule when 1 then taken * 1000000 when 2 then us when 3 then {noon.format('named')} when 4 then {noon.format("make_date(fy, 1, 1)")} when 5 then written end as fus,
        case rule when 1 then 'google-sidecar-photoTakenTime' when 2 then {source} when 3 then 'filename-date' when 4 then 'google-timeline-folder-year' when 5 then 'file-modified' end as fsource, case when rule is not null then rule <> 4 end as month_known from d)"""
    months = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
    at = "make_timestamp(fus)"
    album = "case when coalesce(rel_dir, '') = '' then 'Albums' else 'Albums/' || rel_dir end"
    has_e = "(elat <> 0 or elon <> 0)"
    gps_text = "printf('%.6f,%.6f', {}, {})"
    iso = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
    shown = lambda s: f"case when {s} {IN_RANGE} then {iso.format(s)} end"
    emb_s = "cast(floor(us / 1000000) as bigint)"
    both = "from k where sidecar_id is not null and embedded_id is not null"
    conflicts = f"""select media_id, 'capture-time' as field, {shown('s')} as json_value, {shown(emb_s)} as embedded_value {both} and abs(us / 1000000 - s) > 2
      union all select media_id, 'gps', {gps_text.format('glat', 'glon')}, {gps_text.format('elat', 'elon')} {both} and (glat <> 0 or glon <> 0) and {has_e} and (abs(glat - elat) > 0.0001 or abs(glon - elon) > 0.0001)
      union all select media_id, 'title', {txt('title')}, {txt('etitle')} {both} and {txt('title')} <> '' and {txt('etitle')} <> '' and {txt('title')} <> {txt('etitle')}
      union all select media_id, 'description', {txt('description')}, {txt('edesc')} {both} and {txt('description')} <> '' and {txt('edesc')} <> '' and {txt('description')} <> {txt('edesc')}"""
    policies = " union all ".join(f"select {quote(p)} as policy, count(*) filter ({a}) as write_time, count(*) filter ({b}) as write_gps, count(*) filter ({c}) as write_title, count(*) filter ({d}) as write_description from k where sidecar_id is not null" for p, (a, b, c, d) in WRITES.items())
    t, g, n, d = WRITES["merge"]
    reasons = f"""array_to_string([x for x in case when s is null then ['missing JSON timestamp'] else [case when s < 946684800 then 'timestamp before 2000' end, case when s > 1700000000 then 'timestamp in the future' end,
      case when abs(us / 1000000 - s) > 86400 then 'JSON timestamp differs from embedded timestamp by more than 24h' end,
      case when embedded_id is not null and not (coalesce(glat, 0) <> 0 or coalesce(glon, 0) <> 0) and {txt('utc_offset')} = '' then 'timezone guessed as UTC because no GPS/offset existed' end] end if x is not null], '; ')"""
    placed = "(glat <> 0 or glon <> 0)"
    problems = f"""array_to_string([x for x in [case when s is not null and us is null then 'capture time missing after write' when abs(us / 1000000 - s) > 2 then 'capture time mismatch (got ' || ({shown(emb_s)}) || ')' end,
      case when {placed} and not {has_e} then 'GPS coordinates missing after write' end, case when {placed} and {has_e} and abs(elat - glat) > 0.0001 then 'latitude mismatch' end, case when {placed} and {has_e} and abs(elon - glon) > 0.0001 then 'longitude mismatch' end,
      case when {txt('title')} <> '' and {txt('title')} <> {txt('etitle')} then 'title mismatch' end, case when {txt('description')} <> '' and {txt('description')} <> {txt('edesc')} then 'description mismatch' end] if x is not null], '; ')"""
    esc = lambda x: f"replace(replace(replace(replace(replace(replace(replace(replace({x}, '&', '&amp;'), '\"', '&#34;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), chr(9), '&#x9;'), chr(10), '&#xA;'), chr(13), '&#xD;')"
    pj = WRITES["prefer-json"]
    local = f"(case when s + o {IN_RANGE} then strftime(make_timestamp((s + o) * 1000000), '%Y-%m-%dT%H:%M:%S') || {offset_text('o')} end)"
    head = quote('<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n    <rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:exif="http://ns.adobe.com/exif/1.0/">\n')
    tail = quote('    </rdf:Description>\n  </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>\n')
    line = lambda tag, x: f"'      <{tag}>' || {x} || '</{tag}>' || chr(10)"
    alt = lambda tag, x: f"'      <{tag}><rdf:Alt><rdf:li xml:lang=\"x-default\">' || {x} || '</rdf:li></rdf:Alt></{tag}>' || chr(10)"
    number = lambda x, k: f"printf('%.{k}f', {x})"
    packet = f"""{head} || case when {pj[0]} and {local} is not null then {line('xmp:CreateDate', esc(local))} || {line('xmp:ModifyDate', esc(local))} else '' end
      || case when {pj[2]} then {alt('dc:title', esc(txt('title')))} else '' end || case when {pj[3]} then {alt('dc:description', esc(txt('description')))} else '' end
      || case when {pj[1]} then {line('exif:GPSLatitude', number('glat', 7))} || {line('exif:GPSLongitude', number('glon', 7))} || {line('exif:GPSAltitude', number('galt', 2))} else '' end || {tail}"""
    tz = offset_text("o")
    stamp = lambda s: f"(case when s {IN_RANGE} then strftime(make_timestamp(({s}) * 1000000), '%Y:%m:%d %H:%M:%S') end)"
    loc, utc = stamp("s + o"), stamp("s")
    tags = lambda pairs: "[" + ", ".join(f"'-{a}=' || {b}" for a, b in pairs) + "]"
    xmp = [("XMP-exif:GPSLatitude", number("glat", 7)), ("XMP-exif:GPSLongitude", number("glon", 7)), ("XMP-exif:GPSAltitude", number("galt", 2))]
    video = tags([("Keys:CreationDate", f"{loc} || {tz}"), *((x, utc) for x in ("QuickTime:CreateDate", "QuickTime:ModifyDate", "TrackCreateDate", "TrackModifyDate", "MediaCreateDate", "MediaModifyDate")), ("FileCreateDate", f"{loc} || {tz}"), ("FileModifyDate", f"{loc} || {tz}")])
    photo = tags([("AllDates", loc), ("OffsetTime", tz), ("OffsetTimeOriginal", tz), ("OffsetTimeDigitized", tz), ("FileCreateDate", f"{loc} || {tz}"), ("FileModifyDate", f"{loc} || {tz}")])
    gps = tags([("GPSLatitude", number("abs(glat)", 7)), ("GPSLatitudeRef", "case when glat < 0 then 'S' else 'N' end"), ("GPSLongitude", number("abs(glon)", 7)), ("GPSLongitudeRef", "case when glon < 0 then 'W' else 'E' end"), ("GPSAltitude", number("galt", 2)), *xmp])
    is_video = f"coalesce({kind('file_name')} = 'video', false)"
    select_us = flexible("capture_text", "utc_offset")
    return {
        "epoch_parse": f"select sidecar_id, {seconds('photo_taken_timestamp')} as taken, {seconds('creation_timestamp')} as created, {BEST_S} as best from sidecar",
        "embedded_times": f"select embedded_id, {select_us} as us from embedded_meta",
        # The only other tag is CreateDate with the same text, so the first tag of the order that is one of the two.
        "embedded_select": f"""select embedded_id, case when us is null then null when capture_source = 'DateTimeOriginal' then 'DateTimeOriginal' when capture_source = 'CreationDate' and video then 'CreationDate' else 'CreateDate' end as source, us
          from (select embedded_id, capture_source, coalesce({kind('rel_path')} = 'video', false) as video, {select_us} as us from embedded_meta)""",
        "filename_dates": f"select media_id, cast({name_date('file_name')} as varchar) as day from media",
        "offset_texts": f"select embedded_id, cast(coalesce({fixed('utc_offset')}, 0) as integer) as seconds, {offset_text(f'coalesce({fixed("utc_offset")}, 0)')} as text from embedded_meta",
        "best_geo": f"select sidecar_id, {LAT} as lat, {LON} as lon, {ALT} as alt, {LAT} <> 0 or {LON} <> 0 as placed from sidecar",
        "folder_dates": f"with {dated} select media_id, fus as us, fsource as source, month_known from f",
        "output_dirs": f"""with {dated} select media_id, case when not {is_year('top')} then {album} else 'Photos from ' || lpad(year({at})::varchar, 4, '0') || '/' || case when month_known then month({at})::varchar || ' - ' || {months}[month({at})] else 'Unknown month' end end as by_date,
          case when not {is_year('top')} then {album} else coalesce(rel_dir, '') end as as_is from f""",
        "output_names": f"""select media_id, case when x in ('.jpg', '.jpeg', '.png', '.heic') and sig is not null and not (x = sig or (x in ('.jpg', '.jpeg') and sig = '.jpg')) then {no_ext('file_name')} || sig
            when x = '.mp4' and size_bytes % 2 = 0 then {no_ext('file_name')} || case when {ext('file_name')} = '.MP4' then '.MOV' else '.mov' end else file_name end as name
          from (select media_id, file_name, size_bytes, lower({ext('file_name')}) as x, case size_bytes % 7 when 0 then '.jpg' when 1 then '.png' when 2 then '.heic' end as sig from media)""",
        "field_conflicts": f"with {KNOWN} {conflicts}",
        "policy_matrix": f"with {KNOWN} {policies}",
        "policy_merge": f"with {KNOWN} select media_id, {t} as write_time, {g} as write_gps, {n} as write_title, {d} as write_description from k where sidecar_id is not null",
        "suspicious_dates": f"with {KNOWN} select * from (select media_id, {reasons} as reason from k) where reason <> ''",
        "verify_findings": f"with {KNOWN} select * from (select media_id, {problems} as problems {both}) where problems <> ''",
        "capture_offsets": f"with {KNOWN} select media_id, o as seconds, {offset_text('o')} as text from (select media_id, {CAPTURE_OFFSET} as o from k where sidecar_id is not null)",
        "xmp_packets": f"with {KNOWN} select media_id, sha256({packet}) as packet from (select *, {CAPTURE_OFFSET} as o from k where sidecar_id is not null)",
        "write_arguments": f"with {KNOWN} select media_id, unnest(list_concat(case when not ({t}) then [] when {is_video} then {video} else {photo} end, case when not ({g}) then [] when {is_video} then {tags(xmp)} else {gps} end)) as argument from (select *, {CAPTURE_OFFSET} as o from k where sidecar_id is not null)",
    }


def record_sql() -> dict[str, str]:
    planned = f"""hist as (select * from process_record where batch_no = 0), plan as (select *, case when coalesce(source_id, '') = '' then source_rel_path else source_id || '|' || source_rel_path end as state_key from process_record where batch_no > 0),
      known as (select * from hist where status in {DONE} and coalesce(source_hash, '') <> '' and coalesce(source_rel_path, '') <> '' qualify row_number() over (partition by source_hash order by record_id) = 1),
      firsts as (select * from plan where coalesce(source_hash, '') <> '' qualify row_number() over (partition by source_hash order by {TIMELINE} desc, source_rel_path nulls first, record_id) = 1),
      dup as (select plan.record_id, plan.source_size, coalesce(known.output_path, firsts.output_path) as duplicate_of from plan join firsts on firsts.source_hash = plan.source_hash left join known on known.source_hash = plan.source_hash
        where lower(coalesce(known.output_path, firsts.output_path)) <> lower(plan.output_path))"""
    album = f"{STATE}, ok as (select * from st where status in {DONE} and coalesce(source_hash, '') <> '' and coalesce(output_path, '') <> ''), al as (select record_id, output_path, source_size, source_hash in (select source_hash from ok where {TIMELINE}) as removable from ok where not {TIMELINE})"
    base = r"regexp_extract(replace({0}, '\', '/'), '([^/]*)$', 1)"
    folder = r"regexp_replace(replace({0}, '\', '/'), '/?[^/]*$', '')"
    pkey = lambda a, b: f"lower({clean(a)} || '|' || {clean(b)})"
    state_pairs = rf"""{STATE}, pa as (select *, case when regexp_matches(source_rel_path, '(?i)\.(?:jpg|jpeg|heic)$') then regexp_replace(source_rel_path, '\.[^.]*$', '.mp4') end as pr from st),
      sp as (select a.source_id, a.source_rel_path as ar, b.source_rel_path as br, case when coalesce(a.output_path, '') <> '' then a.output_path when coalesce(b.output_path, '') <> '' then {folder.format('b.output_path')} || '/' || {base.format('a.source_rel_path')} else a.source_path end as still_path,
          case when coalesce(b.output_path, '') <> '' then b.output_path when coalesce(a.output_path, '') <> '' then {folder.format('a.output_path')} || '/' || {base.format('b.source_rel_path')} else b.source_path end as video_path
        from pa a join pa b on b.state_key = case when coalesce(a.source_id, '') = '' then a.pr else a.source_id || '|' || a.pr end where coalesce({kind('b.source_rel_path')} = 'video', false)),
      sq as (select 'state|' || lower(coalesce(source_id, '') || '|' || ar || '|' || br) as key, still_path, video_path, {pkey('still_path', 'video_path')} as path_key from sp qualify row_number() over (partition by {pkey('still_path', 'video_path')} order by 'state|' || lower(coalesce(source_id, '') || '|' || ar || '|' || br), still_path, video_path) = 1)"""
    ranked = rf"""fp as (select distinct output_path as path from st where output_path is not null),
      fk as (select path, {kind('path')} as kind, lower(regexp_replace({clean('path')}, '/?[^/]*$', '')) as dir, {stem(base.format('path'))} as stem from fp),
      fr as (select *, row_number() over (partition by dir, stem, kind order by path) as rk from fk where kind is not null and stem <> ''),
      rp as (select 'path|' || {pkey('a.path', 'b.path')} as key, a.path as still_path, b.path as video_path, {pkey('a.path', 'b.path')} as path_key from fr a join fr b on a.dir = b.dir and a.stem = b.stem and a.rk = b.rk where a.kind = 'image' and b.kind = 'video')"""
    flags = "now in ('completed', 'completed_with_review')"
    numbered = r"'^(.*) \((\d+)\)(\.[^./]*)?$'"
    unique = rf"""pl as (select record_id, output_path, lower(output_path) as k, row_number() over (partition by lower(output_path) order by record_id) as r from process_record where batch_no > 0 and output_path is not null),
      tk as (select distinct lower(output_path) as k from process_record where batch_no = 0 and output_path is not null), us as (select k from pl union select k from tk),
      un as (select regexp_replace(k, {numbered}, '\1\3') as k, list(cast(regexp_extract(k, {numbered}, 2) as bigint)) as used from us where regexp_matches(k, {numbered}) group by 1),
      wn as (select pl.*, r + case when tk.k is null then 0 else 1 end as w, coalesce(used, []) as used from pl left join tk using (k) left join un using (k))"""
    free = "[n for n in range(2, w + len(used) + 2) if not list_contains(used, n)][w - 1]"
    return {
        "content_hash": "select doc_id, sha256(text) as hash from documents",
        "state_latest": f"with {STATE} select state_key, record_id, status from st",
        "state_first_by_hash": f"select source_hash, record_id, output_path from process_record where status in {DONE} and coalesce(source_hash, '') <> '' and coalesce(source_rel_path, '') <> '' qualify row_number() over (partition by source_hash order by record_id) = 1",
        "resume_skip": f"with {STATE.replace('from process_record where', 'from process_record where batch_no = 0 and')}, {planned} select plan.record_id, coalesce(lower(plan.output_path) = lower(st.output_path), false) as resumed from plan left join st on st.state_key = plan.state_key and st.status in {DONE}",
        "dedup_canonical": f"with {planned} select record_id, duplicate_of from dup",
        "dedup_bytes": f"with {planned} select count(*) as duplicates, cast(coalesce(sum(source_size), 0) as bigint) as bytes, {human('cast(coalesce(sum(source_size), 0) as bigint)')} as text from dup",
        "plan_order": f"select {is_year(top('rel_path'))} as is_year, count(*) as media, min(rel_path) as first_path, max(rel_path) as last_path from media group by 1",
        "unique_outputs": f"with {unique} select record_id, case when w = 1 then output_path else {no_ext('output_path')} || ' (' || {free}::varchar || ')' || {ext('output_path')} end as target from wn",
        "album_copies": f"with {album} select record_id, removable from al",
        "album_summary": f"with {album} select (select count(distinct source_hash) from ok where {TIMELINE}) as timeline_hashes, count(*) as album_files_scanned, count(*) filter (removable) as duplicate_files_removed, cast(coalesce(sum(source_size) filter (removable), 0) as bigint) as bytes_matched from al",
        "album_folders": rf"with {album}, fo as (select regexp_replace(replace(output_path, '\', '/'), '/[^/]*$', '') as folder, bool_and(removable) as gone from al group by 1) select cast(length(folder) as integer) as depth, folder from fo where gone",
        "motion_pairs_state": f"with {state_pairs} select key, still_path, video_path from sq",
        "motion_pairs_ranked": f"with {STATE}, {ranked} select key, still_path, video_path from rp",
        "motion_candidates": f"with {state_pairs}, {ranked} select key from sq union all select key from rp where path_key not in (select path_key from sq)",
        "motion_resume": f"with {STATE}, {ranked} select case length(key) % 5 when 0 then 'already-merged' when 1 then 'skipped-previous-failure' when 2 then 'skipped-previous-failure' end as outcome, count(*) as pairs from rp group by 1",
        "manifest_status": f"select status as old, {STATUS} as now, count(*) as rows from manifest_change group by all",
        "archive_resume": f"with {MANIFEST} select zip_fingerprint, now as status, coalesce({flags}, false) and coalesce(workflow_version = 2, false) as skip, coalesce({flags}, false) and not coalesce(workflow_version = 2, false) as legacy, coalesce(now in ('pending', 'extracting', 'processing'), false) as interrupted from mf",
        "archive_outcomes": f"with {MANIFEST} select now as status, count(*) as archives, count(*) filter ({flags} and not coalesce(workflow_version = 2, false)) as legacy from mf group by 1",
        "archive_interrupt": f"with {MANIFEST} select zip_fingerprint, 'interrupted' as status, cast(1700000000000000 as bigint) as end_us, 'previous run ended before this ZIP finished' as error_text from mf where now in ('pending', 'extracting', 'processing')",
        "skip_list": f"with {MANIFEST} select zip_fingerprint from mf where lower(zip_name) is null or lower(zip_name) not in (select lower(zip_name) from mf where now = 'failed' and zip_name is not null)",
        "run_summary": f"select {COUNTERS} from process_record",
        "run_summaries": f"select source_id, {COUNTERS} from process_record group by source_id",
        "report_table": f"with r as (select {COUNTERS} from process_record) " + " union all ".join(f"select cast({i} as integer) as line, {quote(a)} as label, {b} as value from r" for i, (a, b) in enumerate(REPORT, 1)),
        "review_rows": """select coalesce(source_rel_path, '') as source_rel_path, coalesce(match_status, '') as match_status, coalesce(match_strategy, '') as match_strategy, coalesce(status, '') as status, coalesce(folder_date_source, '') as folder_date_source,
          cast(0 as integer) as folder_year, cast(0 as integer) as folder_month, coalesce(output_path, '') as output_path, '' as sidecar_path, '' as partner_rel_path, '' as match_candidates, '' as conflicts, coalesce(error_text, '') as error
          from process_record where match_status is distinct from 'matched' or coalesce(error_text, '') <> ''""",
        "archive_review": f"with r as (select batch_no, {COUNTERS} from process_record group by 1) select batch_no, unmatched + ambiguous + errors + metadata_verification_failures > 0 as needs_review, unmatched + ambiguous + errors = 0 as clean, case when unmatched + ambiguous + errors + metadata_verification_failures > 0 then 'completed_with_review' else 'completed' end as status from r",
        "suspicious_report": "select source_path, output_path, json_timestamp, embedded_timestamp, reason from suspicious_date",
    }


REPORT = [
    *((a, f"{b}::varchar") for a, b in (("Input media found", "total_media"), ("JSON sidecars found", "json_sidecars_found"), ("Matched cleanly", "matched_cleanly"), ("Matched with fallback", "matched_with_fallback"), ("Unmatched", "unmatched"), ("Ambiguous", "ambiguous"), ("Output media count", "output_media"), ("Metadata written", "metadata_written"), ("XMP sidecars written", "xmp_sidecars_written"), ("Metadata verified", "metadata_verified"), ("Verification failures", "metadata_verification_failures"), ("Duplicates removed", "(duplicates_linked + duplicates_copied)"))),
    ("Space saved (dedupe)", human("approx_dedup_bytes_saved")),
    ("Suspicious dates", "suspicious_dates::varchar"),
    ("Errors", "errors::varchar"),
]


def storage_sql() -> dict[str, str]:
    from argentum import queries as q

    sized = f"{MANIFEST}, z as (select zip_fingerprint, zip_size as size_bytes, zip_size * 2 - 900000000 as uncompressed_bytes, 10 as media_files, greatest(coalesce(zip_size, 0), coalesce(zip_size * 2 - 900000000, 0)) + 26843545600 as need from mf)"
    roots = values(q.ROOTS, q.ROOT_COLUMNS, "ro")
    drives = values(q.DRIVES, q.DRIVE_COLUMNS, "dr")
    drive_kind = "case when contains(lower(model), 'ssd') or contains(lower(model), 'solid state') then 'SSD' when contains(lower(model), 'hdd') or contains(lower(model), 'hard disk') then 'HDD' else 'unknown' end"
    folders = values(q.FOLDERS, "role string, path string", "fo")
    covers = "(lower(a.path) = lower(b.path) or starts_with(a.path, case when b.path = '/' then '/' else b.path || '/' end) or starts_with(b.path, case when a.path = '/' then '/' else a.path || '/' end))"
    parts = r"string_split(replace(rel_path, '\', '/'), '/')"
    unsafe = rf"case when {strip('rel_path')} = '' then null when starts_with(replace(rel_path, '\', '/'), '/') then 'absolute' when regexp_matches(rel_path, '^[A-Za-z]:') then 'drive' when len([x for x in {parts} if {strip('x')} in ('.', '..')]) > 0 then 'traversal' end"
    safe = rf"""array_to_string([case when y = '' then '_' when regexp_matches(y, '(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)') then '_' || y else y end for y in
        [regexp_replace(regexp_replace(x, '[ .]+$', ''), '[\x01-\x1F<>:"|?*]', '_', 'g') for x in {parts} if x <> '']], '/')"""
    base = r"lower(regexp_extract(replace(zip_path, '\', '/'), '([^/]*)$', 1))"
    zext = ext(base)
    dl = "dl as (select event_id as id, case when length(event_type) % 3 = 0 then 'interrupted' else 'in_progress' end as state, length(event_type) % 3 = 1 as paused, value > 50 as can_resume, ts from events), gr as (select id, ts, case when state = 'in_progress' and not paused then 0 when state = 'interrupted' and can_resume then 1 when state = 'in_progress' and paused then 2 end as w from dl), rk as (select *, row_number() over (partition by w order by ts, id) as r, row_number() over (partition by w > 0 order by w, ts, id) as qn from gr where w is not null)"
    seen = "se as (select distinct user_id::varchar as path, ts, cast(length(event_type) as bigint) as size from events), la as (select path, max(ts) as until, arg_max(size, (ts, size)) as now from se group by 1), br as (select la.*, (select max(ts) from se where se.path = la.path and se.size <> la.now) as broke from la), be as (select br.path, now, until, min(se.ts) as since from br join se on se.path = br.path and se.size = br.now and (broke is null or se.ts > broke) group by all)"
    return {
        "zip_stats": f"select coalesce(source_id, 'none') as archive, cast(coalesce(sum(size_bytes), 0) as bigint) as uncompressed_bytes, count(*) filter ({kind('file_name')} is not null and {strip('rel_path')} <> '') as media_files from media group by 1",
        "preflight": f"with {sized} select count(*) as archives, cast(coalesce(sum(size_bytes), 0) as bigint) as total_bytes, cast(coalesce(sum(media_files), 0) as bigint) as media_files, coalesce(max(size_bytes), 0) as largest_bytes, coalesce(max(need), 0) as required_bytes from z",
        "work_roots": f"with {sized}, {roots}, ra as (select *, case kind when 'SSD' then 2 when 'unknown' then 1 else 0 end as rank from ro where usable) select zip_fingerprint, need as required_bytes, (select path from ra where free_bytes >= need order by rank desc, free_bytes desc, ord limit 1) as path from z",
        "drive_choice": rf"""with {drives}, {roots}, dk as (select *, {drive_kind} as kind from dr), rk as (select ro.ord, ro.path, coalesce(dk.kind, 'unknown') as kind from ro left join dk on upper(trim(dk.letter)) = upper(regexp_extract(ro.path, '^([A-Za-z]:)', 1)))
          select ord, path, kind, 'label' as status, (select root from dk where lower(trim(label)) = 'backup b') as root, (select bool_and(kind = 'HDD') from rk) as only_hdd from rk""",
        "path_overlap": f"with {folders} select a.role as first_role, a.path as first_path, b.role as second_role, b.path as second_path from fo a join fo b on (a.role, a.path) < (b.role, b.path) where {covers}",
        "entry_names": f"select media_id, reason, case when reason is null then {safe} end as path, {clean('rel_path')} as below from (select *, {unsafe} as reason from media)",
        "archive_names": f"select change_id, {zext} = '.zip' as archive, {zext} = '.zip' and contains({base}, 'takeout') as export, {zext} in ('.crdownload', '.part', '.tmp', '.fdmdownload', '.moving') as unfinished from manifest_change",
        "fingerprints": r"select change_id, lower(replace(zip_path, '\', '/')) || '|' || zip_size || '|' || epoch_us(zip_modified) * 1000 as fingerprint from manifest_change where zip_path is not null and zip_size is not null and zip_modified is not null",
        "sizes": f"select record_id, {human('source_size')} as text from process_record",
        "problems_joined": "select record_id, concat_ws('; ', nullif(error_text, ''), nullif(nullif(match_status, 'matched'), '')) as text from process_record",
        "xml_escape": "select doc_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '\"', '&#34;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), chr(9), '&#x9;'), chr(10), '&#xA;'), chr(13), '&#xD;')) as escaped from documents",
        "download_throttle": f"with {dl}, bu as (select least(count(*), 5) as n from gr where w = 0) select id, case when w = 0 and r <= 5 then 'keep' when w = 0 then 'pause' when qn <= 5 - n then 'resume' else 'wait' end as action from rk, bu",
        "mover_stable": f"with {seen} select path, now as size, epoch_us(since) as since, epoch_us(until) as until from be where now > 0 and epoch_us(until) - epoch_us(since) >= 120000000",
        "mover_targets": f"with {MANIFEST} select zip_fingerprint as path, zip_size * 150 as size, case when 90000000000 >= zip_size * 150 + 21474836480 then 'C:/' end as root from mf",
    }


def feed_sql() -> dict[str, str]:
    last = """(select *, lower(trim(zip_fingerprint)) as f from manifest_change where trim(coalesce(zip_fingerprint, '')) <> '' qualify row_number() over (partition by lower(trim(zip_fingerprint)) order by start_time desc nulls last, seq desc nulls last, writer desc nulls last) = 1)"""
    found = f"select f as zip_fingerprint, writer, seq from {last} where change_op is distinct from 'delete'"
    return {"p4_found": found, "p4_batches": found, "p4_entries": f"select f as zip_fingerprint, writer, seq, {STATUS} as status, epoch_us(start_time) as start_time, epoch_us(end_time) as end_time from {last} where change_op is distinct from 'delete'"}


def all_queries() -> dict[str, str]:
    return feed_sql() | name_sql() | matching_sql() | date_sql() | record_sql() | storage_sql()
