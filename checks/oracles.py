"""DuckDB SQL for the registered queries.

Written from the rules, not from the operators: plain joins on regular
expressions, windows and CASE lists over the same tables.
"""

from __future__ import annotations

from checks.queries import (
    CHOSEN_FACETS,
    FACET_QUERIES,
    MAX_JOBS,
    OVERRIDE,
    TOP,
)
from checks.standins import DEMO, DOCS_PER_PAGE, SITE
from rolecast.sources import presets

ORACLES: dict[str, str] = {}

SEP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}\-/]+"
BUCKETS = ("core", "nice", "neg")


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fold(expr: str) -> str:
    return f"replace(lower({expr}), 'ß', 'ss')"


def key(expr: str) -> str:
    return f"trim(regexp_replace(replace({fold(expr)}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


# --- ranking --------------------------------------------------------------------


def _escape(term: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)


def _pattern(term: str, literal: bool | str) -> str:
    if literal == "strict":  # a blank asks for separators or brackets, a slash and a closing bracket
        body = _escape(term).replace("\\-", SEP.replace("\\-/", "\\-/")).replace(" ", SEP.replace("\\-/", "\\[\\-/").replace("]+", "]+/\\]+"))
    elif literal:
        body = _escape(term)
    else:
        parts = term.replace("-", " ").replace("/", " ").split()
        body = SEP.join(map(_escape, parts))
    return r"(?:^|[^\p{L}\p{N}_])" + body + r"(?:$|[^\p{L}\p{N}_])"


def scored(profiles: dict, literal: bool | str = False, text: str = "text", raw_length: bool = False) -> str:
    """CTEs ending in ``scored``: doc_id, profile, raw, core, nice, neg."""
    tests, knobs = [], []
    for name, spec in profiles.items():
        boost, cap, divisor = spec[3:]
        knobs.append(f"({quote(name)}, {cap}::DOUBLE, {divisor}::DOUBLE)")
        for bucket, weights in zip(BUCKETS, spec):
            for i, (term, weight) in enumerate(weights.items()):
                value = weight * boost
                # one branch per term: a constant pattern is compiled once
                pattern = quote(_pattern(term, literal))
                in_title = "false" if bucket == "neg" else f"regexp_matches(t, {pattern})"
                tests.append(
                    f"SELECT doc_id, {quote(name)} AS profile, '{bucket}' AS bucket, {i} AS ord, {weight}::DOUBLE AS weight, "
                    f"{value!r}::DOUBLE AS boosted, {quote(f'{term}({weight:+.1f})')} AS label, "
                    f"{quote(f'{term}({value:+.1f})')} AS title_label, {in_title} AS in_title "
                    f"FROM docs WHERE regexp_matches(t || chr(10) || b, {pattern})"
                )
    length = f"length({text})" if raw_length else f"length({fold(text)})"
    lists = ",\n".join(
        f"coalesce(string_agg(shown, '; ' ORDER BY both_scope, ord) FILTER (bucket = '{b}'), '') AS {b}" for b in BUCKETS
    )
    return f"""
docs AS MATERIALIZED (SELECT doc_id, {fold("split_part(text, chr(10), 1)")} AS t, {fold(text)} AS b, {length} AS n FROM documents),
knobs(profile, cap, divisor) AS (VALUES {", ".join(knobs)}),
found AS ({" UNION ALL ".join(tests)}),
scopes AS (SELECT doc_id, profile, bucket, ord, 1 AS both_scope, weight AS value, label AS shown FROM found
           UNION ALL
           SELECT doc_id, profile, bucket, ord, 0, boosted, title_label FROM found WHERE in_title),
sums AS (SELECT doc_id, profile, sum(value) AS s, {lists} FROM scopes GROUP BY ALL),
scored AS (SELECT doc_id, profile, coalesce(s, 0) + least(n / divisor, cap) AS raw,
                  coalesce(core, '') AS core, coalesce(nice, '') AS nice, coalesce(neg, '') AS neg
           FROM docs CROSS JOIN knobs LEFT JOIN sums USING (doc_id, profile))"""


def one(name: str) -> dict:
    return {name: DEMO[name]}


ORACLES["rank_topk"] = f"""
WITH {scored(one("demo"))}
SELECT doc_id, split_part(text, chr(10), 1) AS title, round(raw, 3) AS score,
       'profile=''demo'' title=''' || left(split_part(text, chr(10), 1), 80) || ''' url=''{SITE}/job/Doc_JR' || doc_id || '''' AS notes
FROM scored JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT {TOP}"""

ORACLES["rank_multi_profile_topk"] = f"""
WITH {scored(DEMO)},
placed AS (SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY round(raw, 3) DESC, doc_id)::INT AS rank,
                  doc_id, round(raw, 3) AS score FROM scored)
SELECT * FROM placed WHERE rank <= {TOP}"""

ORACLES["rank_hits"] = f"WITH {scored(DEMO)} SELECT doc_id, profile, round(raw, 3) AS score, core, nice, neg FROM scored"
ORACLES["rank_joined_profiles"] = ORACLES["rank_hits"]
ORACLES["rank_joined_repeats"] = f"""
WITH {scored(DEMO)} SELECT doc_id, profile, round(raw, 3) AS score, core, neg FROM scored CROSS JOIN (VALUES (1), (2)) twice(n)"""
ORACLES["rank_strict"] = f"WITH {scored(DEMO, 'strict')} SELECT doc_id, profile, round(raw, 3) AS score, core, nice FROM scored"

_PRESETS = {
    n: presets.PRESETS[n]
    for n in (presets.DEFAULT_PROFILE, presets.PROPERTY_PROFILE)
}
ORACLES["rank_preset_profiles"] = f"WITH {scored(_PRESETS)} SELECT doc_id, profile, round(raw, 3) AS score FROM scored"


def _overridden(always_nice: bool) -> dict:
    changed = {}
    for name, spec in DEMO.items():
        tables = [dict(t) for t in spec[:3]]
        for term, weight in OVERRIDE.items():
            term = term.lower()
            home = next((t for t in tables if term in t), tables[1 if always_nice or weight >= 0 else 2])
            home[term] = weight
        changed[name] = (*tables, *spec[3:])
    return changed


ORACLES["rank_with_override"] = (
    f"WITH {scored(_overridden(False))} SELECT doc_id, profile, round(raw, 3) AS score, nice, neg FROM scored"
)
ORACLES["rank_legacy"] = (
    f"WITH {scored(_overridden(True), True, chr(40) + 'CASE WHEN doc_id % 10 > 0 THEN text ELSE chr(78) || chr(111) || chr(110) || chr(101) END)', True)} "
    "SELECT doc_id, profile, round(raw, 6) AS score, nice FROM scored"
)

ORACLES["rank_benchmark_profiles"] = rf"""
WITH items AS (SELECT 'item ' || item_id AS profile, unnest(list_distinct(regexp_extract_all({fold("text")}, '[\p{{L}}\p{{N}}_]+'))) AS word FROM benchmark),
docs AS (SELECT doc_id, {fold("split_part(text, chr(10), 1)")} AS t, {fold("text")} AS b FROM documents),
words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t || chr(10) || b, '[\p{{L}}\p{{N}}_]+'))) AS word FROM docs),
title_words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'))) AS word FROM docs),
sums AS (SELECT doc_id, profile, sum(value) AS s FROM (
            SELECT doc_id, profile, 1.0::DOUBLE AS value FROM words JOIN items USING (word)
            UNION ALL SELECT doc_id, profile, 1.5::DOUBLE FROM title_words JOIN items USING (word)) GROUP BY ALL),
everything AS (SELECT doc_id, profile, round(coalesce(s, 0) + least(length(b) / 900.0::DOUBLE, 1.0::DOUBLE), 3) AS score
               FROM docs CROSS JOIN (SELECT 'item ' || item_id AS profile FROM benchmark) LEFT JOIN sums USING (doc_id, profile)),
placed AS (SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM everything)
SELECT * FROM placed WHERE rank <= 5"""

ORACLES["rank_pruned_profiles"] = ORACLES["rank_benchmark_profiles"]

_SPACED = (
    r"' ' || regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x85\p{{Z}}\-/]+', ' ' || chr(1) || ' ', 'g'), "
    r"'[\s\x1c-\x1f\x85\p{{Z}}\-/]+', ' ', 'g') || ' '"
)
ORACLES["rank_customer_profiles"] = rf"""
WITH docs AS (SELECT doc_id, {fold("split_part(text, chr(10), 1)")} AS t, {fold("text")} AS b FROM documents),
spaced AS (SELECT doc_id, {_SPACED.format("t")} AS t, {_SPACED.format("t || chr(10) || b")} AS b FROM docs),
words AS (SELECT doc_id AS id, string_split_regex(b, '[^\p{{L}}\p{{N}}_]+') AS w FROM docs),
kinds AS (SELECT c_custkey AS c, coalesce(w[c_custkey % 13 + 1], '') AS first, coalesce(w[c_custkey % 13 + 2], '') AS second, coalesce(w[4], '') AS fourth
          FROM customer JOIN words ON id = c_custkey % 150),
terms AS (SELECT 'customer ' || c AS profile, 'core' AS bucket, trim(first || ' ' || second) AS term, 2.0::DOUBLE AS weight FROM kinds
          UNION ALL SELECT 'customer ' || c, 'nice', first, 0.25 FROM kinds UNION ALL SELECT 'customer ' || c, 'neg', fourth, -0.5 FROM kinds),
found AS (SELECT doc_id, term, contains(t, ' ' || term || ' ') AS in_title FROM spaced
          JOIN (SELECT DISTINCT term FROM terms WHERE term <> '') ON contains(b, ' ' || term || ' ')),
sums AS (SELECT profile, doc_id, sum(weight + if(in_title AND bucket <> 'neg', 1.25 * weight, 0)) AS s,
                coalesce(max(CASE WHEN bucket = 'core' THEN if(in_title, term || '(+2.5); ', '') || term || '(+2.0)' END), '') AS core,
                coalesce(max(CASE WHEN bucket = 'neg' THEN term || '(-0.5)' END), '') AS neg
         FROM terms JOIN found USING (term) GROUP BY ALL),
everything AS (SELECT profile, doc_id, coalesce(core, '') AS core, coalesce(neg, '') AS neg,
                      round(coalesce(s, 0) + least(length(b) / (800.0::DOUBLE + c % 3 * 100), 1.0::DOUBLE), 3) AS score
               FROM docs CROSS JOIN (SELECT 'customer ' || c AS profile, c FROM kinds) LEFT JOIN sums USING (profile, doc_id)),
placed AS (SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score, core, neg FROM everything)
SELECT * FROM placed WHERE rank <= 3"""

ORACLES["length_bonus"] = (
    f"SELECT doc_id, round(least(length({fold('text')}) / 900.0::DOUBLE, 1.25::DOUBLE), 3) AS bonus FROM documents"
)

ORACLES["profile_json"] = f"""
WITH entries AS (
    SELECT 'part ' || p_partkey AS profile, 'core' AS bucket, {fold("'a ' || p_name")} AS term, p_size + 1.0::DOUBLE AS weight FROM part
    UNION ALL SELECT 'part ' || p_partkey, 'nice', {fold("p_type")}, 1.5::DOUBLE FROM part)
SELECT profile, bucket, term, weight, 1.5::DOUBLE AS title_boost, 1.25::DOUBLE AS length_cap, 900.0::DOUBLE AS length_divisor FROM entries"""
ORACLES["profile_errors"] = """
SELECT o_orderkey::VARCHAR AS path,
       CASE o_orderkey % 4 WHEN 0 THEN 'nice contains a non-numeric weight for ' || o_orderstatus
            WHEN 1 THEN 'core_plus must be an object mapping terms to weights' ELSE 'profile must be an object' END AS error
FROM orders WHERE o_orderkey % 4 < 3"""

ORACLES["profile_from_texts"] = """
SELECT c_name AS profile, 'core' AS bucket, lower(c_mktsegment) || ' = ' || round(c_acctbal / 100, 0)::INT AS weights FROM customer
UNION ALL SELECT c_name, 'nice', 'same = 2.5' || chr(10) || 'other = ' || c_nationkey FROM customer"""

ORACLES["preset_choice"] = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '{presets.PROPERTY_PROFILE}' ELSE '{presets.DEFAULT_PROFILE}' END AS preset
FROM orders"""


# --- text -----------------------------------------------------------------------


def unescaped(expr: str) -> str:
    for name, char in (("&quot;", "'\"'"), ("&middot;", "'·'"), ("&copy;", "'©'"), ("&amp;", "'&'")):
        expr = f"replace({expr}, '{name}', {char})"
    return expr


def tidy(expr: str) -> str:
    out = f"replace(replace(replace({unescaped(expr)}, 'â' || chr(128) || '¢', '-'), '•', '-'), chr(160), ' ')"
    for pattern, new in (
        (r"\s*/\s*", "/"),
        (r"[ \t\r\f\v]+", " "),
        (r"\n\s*\n+", r"\n"),
        (r" *\n *", r"\n"),
    ):
        out = f"regexp_replace({out}, '{pattern}', {quote(new) if new != chr(92) + 'n' else 'chr(10)'}, 'g')"
    return f"trim({out}, ' ' || chr(10))"


_MARKUP = (
    r"""(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|"""
    r"""</?[a-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[a-z/!?][^>]*>|[^<]+|<"""
)


def html_text(expr: str) -> str:
    tokens = f"regexp_extract_all({unescaped(expr)}, '{_MARKUP}')"
    piece = (
        "CASE WHEN x[1] <> '<' THEN " + unescaped("x") + " "
        r"WHEN regexp_matches(x, '(?i)^<(script|style)\b') THEN regexp_replace(regexp_replace(x, '(?is)^<(script|style)\b[^>]*>', ''), '(?i)</(script|style)\s*>$', '') "
        r"WHEN regexp_matches(x, '(?i)^<li[\s/>]') THEN chr(10) || '- ' "
        r"WHEN regexp_matches(x, '(?i)^</?(p|div|br|li|ul|ol|section|h[1-4]|tr)[\s/>]') THEN chr(10) "
        "WHEN regexp_matches(x, '^<[a-zA-Z/!?]') THEN '' ELSE x END"
    )
    return tidy(f"array_to_string(list_transform({tokens}, lambda x: {piece}), '')")


ORACLES["html_to_text"] = f"SELECT page_id, {html_text('html')} AS text FROM pages"
ORACLES["normalize_text"] = f"""
SELECT doc_id, md5({tidy("('•  a / b  ' || text || ' &amp; end ')")}) AS digest FROM documents"""
ORACLES["clean_description"] = rf"""
WITH t AS (SELECT page_id, {html_text('html')} AS x FROM pages),
started AS (SELECT page_id, CASE
    WHEN regexp_matches(x, '(?i)\bthat the\b') THEN regexp_replace(x, '(?is)^.*?\bthat the\b:?\s*', '')
    WHEN regexp_matches(x, '(?i)\bof the\b') THEN regexp_replace(x, '(?is)^.*?\bof the\b:?\s*', '') ELSE x END AS x FROM t)
SELECT page_id, {tidy(r"regexp_replace(x, '(?is)(\bby the\b|\bexample\.com\b).*$', '')")} AS description FROM started"""
ORACLES["legacy_digest"] = rf"""
WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bof the\b') THEN regexp_replace(text, '(?is)^.*?\bof the\b\s*', '') END AS x FROM documents),
c AS (SELECT doc_id, trim(regexp_replace(x, '(?is)(\band the\b|\bde la\b).*$', ''), ' ' || chr(10)) AS x FROM t)
SELECT doc_id, trim(regexp_replace(regexp_replace(replace({unescaped('x')}, '•', '-'), '\s*/\s*', '/', 'g'), '\s+', ' ', 'g')) AS digest FROM c"""
ORACLES["split_overviews"] = r"""
WITH marked AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)(of\s*the\b)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents),
kept AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(p, ' ' || chr(10) || chr(13) || chr(9))), lambda p: p <> '') AS parts FROM marked)
SELECT doc_id, unnest(range(len(parts)))::INT AS chunk_no, unnest(parts) AS chunk FROM kept"""
ORACLES["match_key"] = f"SELECT doc_id, {key('text')} AS key FROM documents"
ORACLES["folded_text"] = f"SELECT doc_id, md5({fold('text')}) AS digest, length({fold('text')}) AS length FROM documents"
ORACLES["term_patterns"] = f"""
SELECT doc_id, regexp_matches({fold('text')}, {quote(_pattern('of the', False))}) AS loose,
       regexp_matches({fold('text')}, {quote(_pattern('of the', True))}) AS literal FROM documents"""
ORACLES["term_lists"] = """
SELECT p_partkey, unnest([0, 1, 2])::INT AS ord, unnest([p_name, p_type, p_brand]) AS term FROM part"""
ORACLES["weight_lines"] = """
SELECT p_partkey, 1::INT AS line, p_name AS term, p_size::DOUBLE AS weight, NULL::VARCHAR AS error FROM part
UNION ALL SELECT p_partkey, 3, lower(p_brand), NULL, 'must look like term = weight' FROM part
UNION ALL SELECT p_partkey, 4, '', NULL, 'has an empty term' FROM part
UNION ALL SELECT p_partkey, 5, 'x', NULL, 'has a non-numeric weight' FROM part"""
ORACLES["weight_arguments"] = """
WITH a AS (SELECT CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ', x = ' || p_size || 'd'
                       WHEN 2 THEN ' ' || p_name || ',y = 1_' || p_size || 'e-1 ' WHEN 3 THEN p_name || '=0x1p3'
                       WHEN 4 THEN ' =' || p_size ELSE p_name || '=' || p_size END AS argument,
                  CASE p_partkey % 6 WHEN 1 THEN p_name || ', x' WHEN 2 THEN p_name || ',y' WHEN 4 THEN '' ELSE p_name END AS term,
                  CASE p_partkey % 6 WHEN 2 THEN ('1' || p_size || 'e-1')::DOUBLE WHEN 5 THEN p_size::DOUBLE END AS weight,
                  CASE p_partkey % 6 WHEN 0 THEN 'must look like term = weight' WHEN 4 THEN 'has an empty term'
                       WHEN 5 THEN NULL WHEN 2 THEN NULL ELSE 'has a non-numeric weight' END AS error FROM part)
SELECT argument, term, weight, error, count(*) AS n FROM a GROUP BY ALL"""
ORACLES["clamped_numbers"] = """
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 10 ELSE greatest(1, least(500, event_id - 50)) END::INT AS whole,
       greatest(5.0::DOUBLE, least(20.0::DOUBLE, value)) AS fraction FROM events"""
ORACLES["safe_integers"] = """
SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(event_type AS BIGINT) AS bad FROM events"""


# --- addresses ------------------------------------------------------------------

_HOST = r"regexp_extract(url, '^(https?://[^/]+)', 1)"
_TENANT = r"regexp_extract(url, '^https?://([^./]+)', 1)"
_PATH = r"string_split(trim(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'), '/')"
_SITES = f"""
found AS (SELECT page_id, page_id % 7 AS k, url,
    CASE page_id % 7 WHEN 3 THEN 'https://borgwarner.wd5.myworkdayjobs.com' WHEN 6 THEN NULL ELSE {_HOST} END AS base_url,
    CASE page_id % 7 WHEN 1 THEN 't' || page_id WHEN 2 THEN 't' || page_id WHEN 3 THEN 'borgwarner' WHEN 6 THEN NULL ELSE {_TENANT} END AS tenant,
    CASE page_id % 7 WHEN 0 THEN {_PATH}[1] WHEN 3 THEN 'BorgWarner_Careers' WHEN 4 THEN 'de-DE' WHEN 6 THEN NULL ELSE 'Site' || page_id END AS site,
    CASE page_id % 7 WHEN 6 THEN NULL WHEN 5 THEN 'fr-fr' ELSE 'en-US' END AS locale,
    CASE page_id % 7 WHEN 1 THEN '/en-US/recruiting/t' || page_id || '/Site' || page_id END AS public_prefix,
    CASE page_id % 7 WHEN 0 THEN len(string_split(nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '&')) WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS nf
    FROM pages)"""
ORACLES["infer_site"] = f"""
WITH {_SITES} SELECT page_id, base_url, tenant, site, locale, public_prefix, coalesce(nf, 0)::INT AS n_facets, k = 6 AS failed FROM found"""
ORACLES["site_addresses"] = f"""
WITH {_SITES} SELECT page_id, base_url || '/wday/cxs/' || tenant || '/' || site || '/jobs' AS list_url,
    base_url || '/wday/cxs/' || tenant || '/' || site || '/job' AS detail_url,
    base_url || coalesce(public_prefix, '/' || locale || '/' || site) AS referer FROM found WHERE k <> 6"""
ORACLES["query_facets"] = r"""
WITH q AS (SELECT page_id, unnest(string_split(nullif(regexp_extract(url, '\?([^#]*)', 1), ''), '&')) AS pair FROM pages)
SELECT page_id, split_part(pair, '=', 1) AS facet_key, 0::INT AS ord, split_part(pair, '=', 2) AS value FROM q"""
ORACLES["repeated_facets"] = """
SELECT o_orderkey, 0::INT AS key_no, 'a' AS facet_key, o_orderstatus || '|é%zz|' || o_orderstatus AS facet_values FROM orders
UNION ALL SELECT o_orderkey, 1, 'b', o_orderpriority FROM orders"""
ORACLES["assigned_facets"] = """
SELECT o_orderkey, 'status' AS facet_key, 'A|' || o_orderstatus || '|O' AS facet_values FROM orders
UNION ALL SELECT o_orderkey, 'priority', o_orderpriority || '=x' FROM orders"""
ORACLES["public_url"] = """
SELECT page_id, CASE page_id % 4 WHEN 1 THEN url
    WHEN 0 THEN 'https://h.example.com' || CASE WHEN page_id % 3 = 0 THEN '/careers/' ELSE '/en-US/Site' END
    ELSE 'https://h.example.com' || CASE WHEN page_id % 3 = 0 THEN '/careers' ELSE '/en-US/Site' END || '/job/' || page_id END AS public_url
FROM pages"""
ORACLES["req_id"] = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 4 = 2 THEN
                CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 2 THEN '9' ELSE '' END
            WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'JR' WHEN 1 THEN '' ELSE 'A' END || o_orderkey
            ELSE CASE o_orderkey % 4 WHEN 0 THEN 'JR' WHEN 1 THEN '' ELSE 'A' END || o_orderkey END AS req_id,
       CASE WHEN o_orderkey % 3 = 0 THEN '9' WHEN o_orderkey % 3 = 1 OR o_orderkey % 4 = 2 THEN ''
            ELSE CASE o_orderkey % 4 WHEN 0 THEN 'JR' WHEN 1 THEN '' ELSE 'A' END || o_orderkey END AS older_req_id
FROM orders"""


# --- landed pages ---------------------------------------------------------------

_PAGES = f"""
landed AS (SELECT 'https://' || source || '.example.com/Careers' AS source, doc_id // {DOCS_PER_PAGE} + 1 AS page_no, count(*)::INT AS n_items
           FROM documents GROUP BY ALL)"""
ORACLES["page_offsets"] = "SELECT event_id, event_id * 20 AS offset FROM events"
ORACLES["page_cut"] = f"""
WITH {_PAGES}, cuts AS (SELECT source, min(page_no) FILTER (n_items < 3) AS cut FROM landed GROUP BY source)
SELECT source, page_no, n_items FROM landed JOIN cuts USING (source) WHERE page_no <= 8 AND (cut IS NULL OR page_no <= cut)"""
ORACLES["page_cut_offset"] = f"""
WITH {_PAGES}, running AS (SELECT *, sum(n_items) OVER (PARTITION BY source ORDER BY page_no) AS total FROM landed),
cuts AS (SELECT source, min(page_no) FILTER (total >= 25) AS cut FROM running GROUP BY source)
SELECT source, page_no, n_items FROM landed JOIN cuts USING (source) WHERE cut IS NULL OR page_no <= cut"""
ORACLES["page_cut_fixed"] = f"WITH {_PAGES} SELECT source, page_no, n_items FROM landed WHERE page_no <= 5"
ORACLES["unreadable_pages"] = """
SELECT event_type AS source, count(*) FILTER (event_id % 9 = 0) AS bad, count(*) AS pages FROM events GROUP BY event_type"""

# scan order: source ordinal, page, position on the page
_SEQ = f"""
regexp_extract(source, '(\\d+)$', 1)::BIGINT AS source_ord, doc_id // {DOCS_PER_PAGE} + 1 AS page_no,
row_number() OVER (PARTITION BY source, doc_id // {DOCS_PER_PAGE} ORDER BY doc_id) - 1 AS position"""
_TITLE = "split_part(text, chr(10), 1)"
ORACLES["list_postings"] = f"""
SELECT {_SEQ}, 'Careers' AS source, 'JR' || doc_id AS req_id, {_TITLE} AS title,
       CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'in ' || lang END AS location, 'day ' || doc_id AS posted,
       'https://' || source || '.example.com/en-US/Careers/job/Doc_JR' || doc_id AS url,
       CASE WHEN doc_id = 0 THEN '' ELSE doc_id::VARCHAR END AS job_id
FROM documents"""
ORACLES["alternate_postings"] = f"""
WITH every AS (SELECT *, {_SEQ} FROM documents)
SELECT source_ord, page_no, position, 'Netflix' AS source, CASE WHEN doc_id = 0 THEN '' ELSE doc_id::VARCHAR END AS req_id, {_TITLE} AS title,
       lang || ', ' || every.source AS location,
       strftime(make_timestamp((1600000000 + doc_id * 86400) * 1000000), '%Y-%m-%d') AS posted,
       'https://explore.jobs.netflix.net/careers' || CASE WHEN doc_id = 0 THEN '' ELSE '/job/' || doc_id END AS url,
       'Netflix' AS hiring_organization, md5('<p>' || text || '</p>') AS html_digest
FROM every"""

ORACLES["landed_scan"] = f"""
WITH every AS (SELECT *, {_SEQ} FROM documents)
SELECT dense_rank() OVER (ORDER BY source) - 1 AS source_ord, page_no, position, 'JR' || doc_id AS req_id,
       'https://' || source || '.example.com/en-US/Careers/job/Doc_JR' || doc_id AS url FROM every"""
ORACLES["broken_pages"] = f"""
WITH every AS (SELECT *, {_SEQ} FROM documents)
SELECT source_ord, page_no, position, 'Careers' AS source, 'JR' || doc_id AS req_id FROM every WHERE page_no <> 2"""
ORACLES["mixed_sites"] = f"""
WITH every AS (SELECT *, {_SEQ} FROM documents), {_PAGES}
SELECT source_ord, page_no, position, CASE WHEN source = 'src0' THEN 'Netflix' ELSE 'Careers' END AS source,
       CASE WHEN source <> 'src0' THEN 'JR' || doc_id WHEN doc_id = 0 THEN '' ELSE doc_id::VARCHAR END AS req_id, {_TITLE} AS title
FROM every WHERE source <> 'src1'
UNION ALL
SELECT -1, count(*), 0, source, '', 'site is not listed' FROM landed WHERE source = 'https://src1.example.com/Careers' GROUP BY source"""

ORACLES["compact_location"] = """
SELECT conv_id, turn, CASE turn WHEN 0 THEN role WHEN 1 THEN coalesce(nullif(text, ''), role || ', ' || conv_id)
                      ELSE role || ', ' || conv_id END AS location FROM conversations"""
ORACLES["compact_posted"] = """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '' ELSE 'turn ' || turn END AS posted FROM conversations"""
ORACLES["posted_dates"] = """
SELECT event_id, CASE event_id % 6 WHEN 4 THEN '1970-01-01' WHEN 5 THEN 'Posted 3 days ago' ELSE strftime(ts, '%Y-%m-%d') END AS posted FROM events"""
ORACLES["nested_descriptions"] = "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 2 THEN '' ELSE text END AS description FROM conversations"

_LD = r"""
ld AS (SELECT page_id, page_id % 7 = 6 AS bare, html,
       regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(url, '/([a-z]{2})/', 1) AS lang FROM pages)"""
_LD_TITLE = unescaped("title")
ORACLES["json_ld_extract"] = f"""
WITH {_LD} SELECT '{SITE}/job/Doc_JR' || page_id AS url, CASE WHEN bare THEN '' ELSE title END AS ld_title,
       CASE WHEN NOT bare AND page_id % 2 = 0 THEN lang ELSE '' END AS ld_place,
       CASE WHEN NOT bare AND page_id % 3 > 0 THEN 'FULL_TIME' END AS ld_employment_type,
       CASE WHEN NOT bare THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS ld_date_posted,
       CASE WHEN NOT bare THEN 'Org ' || page_id END AS ld_organization,
       CASE WHEN NOT bare THEN md5(html) END AS digest FROM ld"""


# --- hydration, filters, limits ---------------------------------------------------

ORACLES["hydrate_left"] = f"""
WITH {_LD} SELECT doc_id,
       CASE WHEN doc_id % 4 = 0 THEN CASE WHEN bare THEN '' ELSE coalesce(ld.title, '') END ELSE split_part(d.text, chr(10), 1) END AS title,
       CASE WHEN NOT bare AND page_id % 2 = 0 THEN lang_ ELSE '' END AS location,
       CASE WHEN NOT bare AND page_id % 3 > 0 THEN 'FULL_TIME' END AS employment_type,
       CASE WHEN NOT bare THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS date_posted,
       CASE WHEN NOT bare THEN 'Org ' || page_id END AS hiring_organization,
       CASE WHEN NOT bare THEN {html_text('html')} ELSE '' END AS description_text
FROM documents d LEFT JOIN (SELECT page_id, bare, html, title, lang AS lang_ FROM ld) ld ON d.doc_id = ld.page_id"""
ORACLES["hydrate_missing"] = """
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 1 THEN text WHEN doc_id % 3 > 0 THEN coalesce(url, '') ELSE '' END) AS digest
FROM documents LEFT JOIN pages ON doc_id = page_id"""
_MATCH = f"(contains({key(_TITLE)}, 'the that') OR contains({key(_TITLE)}, 'de'))"
ORACLES["filter_then_hydrate"] = f"""
WITH kept AS (SELECT source, doc_id, {_TITLE} AS title,
                     row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE {_MATCH})
SELECT source, doc_id, CASE WHEN kept.title = '' AND page_id % 7 <> 6 THEN regexp_extract(html, '<title>(.*?)</title>', 1) ELSE kept.title END AS title,
       CASE WHEN page_id % 7 <> 6 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS date_posted
FROM kept LEFT JOIN pages ON doc_id = page_id WHERE n <= {MAX_JOBS}"""
ORACLES["hydrate_from_store"] = ORACLES["filter_then_hydrate"]
ORACLES["scan_counts"] = f"""
WITH rows_ AS (SELECT source, doc_id, {_MATCH} AS hit FROM documents),
numbered AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY source ORDER BY doc_id) AS hits FROM rows_),
stops AS (SELECT source, min(doc_id) FILTER (hits >= {MAX_JOBS}) AS stop FROM numbered GROUP BY source)
SELECT source, count(*) FILTER (stop IS NULL OR doc_id <= stop) AS scanned, least(max(hits), {MAX_JOBS}) AS kept
FROM numbered JOIN stops USING (source) GROUP BY source"""
ORACLES["limit_jobs"] = f"""
WITH numbered AS (SELECT source, doc_id AS ingest_seq, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT source, ingest_seq, {MAX_JOBS}::INT AS n FROM numbered WHERE k <= {MAX_JOBS}
UNION ALL SELECT source, ingest_seq, 0 FROM numbered WHERE k <= 1"""
ORACLES["title_filter"] = f"""
SELECT doc_id FROM documents
WHERE contains({key(_TITLE)}, 'the') OR contains({key(_TITLE)}, 'un and de') OR contains({key(_TITLE)}, 'ss')"""
_BLOB = key("trim(CASE WHEN c_custkey % 2 = 0 THEN 'Remote, US ' ELSE '' END || n_name || ' ' || r_name)")
_PLACED = f"""
placed AS (SELECT c_custkey, c_mktsegment, c_name, {_BLOB} AS blob FROM customer
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ORACLES["location_text"] = f"WITH {_PLACED} SELECT c_custkey, blob FROM placed"
ORACLES["location_filter"] = f"""
WITH {_PLACED} SELECT c_custkey FROM placed WHERE contains(blob, 'nation 1') OR contains(blob, 'africa')
   OR regexp_matches(blob, '(^| )(us|usa|u s|u s a|united states|united states of america|america)( |$)')"""
ORACLES["title_and_location_filter"] = f"""
WITH {_PLACED} SELECT c_custkey FROM placed WHERE (contains(blob, 'nation 1') OR contains(blob, 'africa'))
   AND (contains(lower(c_mktsegment || ' and ' || c_name), 'building and customer') OR contains(lower(c_mktsegment), 'house'))"""
ORACLES["free_text_search"] = "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'with')"

ORACLES["indexed_text_search"] = ORACLES["free_text_search"]
ORACLES["indexed_word_search"] = r"""
SELECT doc_id FROM documents WHERE list_has_all(string_split_regex(lower(text), '[\s\x0b\x1c-\x1f\x85\p{Z}]+'), ['with', 'that'])"""
ORACLES["saved_searches"] = f"""
WITH {_PLACED},
asked AS (SELECT s_suppkey, {key("CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(r_name) WHEN 2 THEN 'U.S.' ELSE substring(n_name, 3, 2 + s_suppkey % 5) END")} AS q
          FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey AS search_id, count(*) AS found FROM asked JOIN placed
ON CASE WHEN q IN ('u s', 'america') THEN regexp_matches(blob, '(^| )(us|usa|u s|u s a|united states|united states of america|america)( |$)')
        ELSE contains(blob, q) END AND q <> '' GROUP BY s_suppkey"""


# --- facets ---------------------------------------------------------------------

_TREE = """
counts AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
nodes AS (
    SELECT r_name AS source, n_nationkey, '' AS segment, 'N' || n_nationkey AS value, n_name AS label, sum(n)::INT AS count,
           'Locations > ' || n_name AS path
    FROM counts JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
    UNION ALL
    SELECT r_name, n_nationkey, c_mktsegment, n_name || '/' || c_mktsegment, c_mktsegment, n::INT,
           'Locations > ' || n_name || ' > ' || c_mktsegment
    FROM counts JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
options AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_nationkey, segment) - 1 AS seq,
                   'locationHierarchy1' AS facet_key, value, label, count, path FROM nodes)"""


def found_options(strict: bool, limit: int) -> str:
    asked = ", ".join(f"({i}, {quote(q)})" for i, q in enumerate(FACET_QUERIES))
    bonus = "least(count / 1000.0::DOUBLE, 3.0::DOUBLE)"
    total = f"tier + {bonus}" if strict else f"CASE WHEN tier > 0 THEN tier + {bonus} ELSE 0 END"
    return f"""{_TREE},
asked(query_no, query) AS (VALUES {asked}),
tiers AS (SELECT o.*, query_no, query, {key("label")} AS l, {key("query")} AS q, {key("replace(path, ' > ', ' ')")} AS p,
    CASE WHEN query = 'US' THEN NULL WHEN l = q THEN 100.0 WHEN starts_with(l, q || ' ') OR ends_with(l, ' ' || q) THEN 90.0
         WHEN contains(' ' || l || ' ', ' ' || q || ' ') THEN 80.0 WHEN contains(l, q) THEN 65.0 WHEN contains(p, q) THEN 45.0 ELSE 0.0 END::DOUBLE AS tier
    FROM options o CROSS JOIN asked),
valued AS (SELECT *, round({total}, 3) AS score FROM tiers WHERE tier IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, query ORDER BY score DESC, coalesce(count, 0) DESC, label DESC, seq)::INT AS rank
           FROM valued WHERE score > 0),
best AS (SELECT * FROM placed WHERE rank <= {limit})"""


ORACLES["facet_flatten"] = f"WITH {_TREE} SELECT * FROM options"
ORACLES["facet_scan"] = f"""
WITH {_TREE} SELECT source, count(*) AS options, sum(count)::BIGINT AS postings FROM options GROUP BY source"""
ORACLES["site_kinds"] = """
SELECT CASE WHEN page_id % 4 = 0 THEN 'https://explore.jobs.netflix.net/careers' ELSE url END AS source,
       page_id AS source_ord, page_id % 4 = 0 AS alternate FROM pages"""
ORACLES["facet_search_topk"] = f"WITH {found_options(False, 4)} SELECT source, query, rank, value, score FROM best"
ORACLES["facet_search_strict"] = f"WITH {found_options(True, 3)} SELECT source, query, rank, value, score FROM best"
ORACLES["facet_resolve"] = f"""
WITH {found_options(False, 2)}
SELECT source, facet_key, value, min_by(query_no::BIGINT, (query_no, rank)) AS query_no, min_by(rank::BIGINT, (query_no, rank)) AS place
FROM best GROUP BY ALL"""
ORACLES["facet_resolve_strict"] = ORACLES["facet_resolve"].replace(found_options(False, 2), found_options(True, 2))
ORACLES["facet_unresolved"] = f"""
WITH {found_options(False, 1)}
SELECT s.source, a.query FROM (SELECT DISTINCT source FROM options) s CROSS JOIN asked a
WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.source = s.source AND b.query = a.query)"""
ORACLES["facet_merge"] = """
SELECT c_mktsegment AS source, o_orderpriority AS facet_key, o_orderstatus AS value, min(o_orderkey) AS ord
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
ORACLES["facet_merge_maps"] = """
SELECT o_orderkey, 0::INT AS key_no, 'a' AS facet_key,
       CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE o_orderstatus || '|F' END
       || CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'O' THEN '|O' ELSE '' END AS facet_values FROM orders
UNION ALL SELECT o_orderkey, 1, 'b', 'x' FROM orders
UNION ALL SELECT o_orderkey, 2, 'c', o_orderpriority FROM orders WHERE o_orderkey % 2 = 0"""
ORACLES["applied_facets"] = f"""
SELECT o_orderkey FROM orders WHERE o_orderstatus IN ({", ".join(map(quote, CHOSEN_FACETS["status"]))})
AND o_orderpriority IN ({", ".join(map(quote, CHOSEN_FACETS["priority"]))})
AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ({", ".join(map(quote, CHOSEN_FACETS["returnflag"]))}))"""
ORACLES["location_aliases"] = """
WITH asked AS (SELECT r_name AS query FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
               UNION ALL SELECT c_mktsegment FROM customer),
named AS (SELECT query, query = 'AMERICA' AS country, unnest(CASE WHEN query = 'AMERICA'
              THEN ['us', 'usa', 'u s', 'u s a', 'united states', 'united states of america', 'america'] ELSE [lower(query)] END) AS alias FROM asked)
SELECT query, country, alias, count(*) AS n FROM named GROUP BY ALL"""


# --- output views ----------------------------------------------------------------

_DATE = "CASE WHEN doc_id % 2 = 0 THEN '2024-05-01' ELSE '' END"
ORACLES["export_csv_view"] = f"""
WITH {scored(one("demo"))}
SELECT round(raw, 3) AS score, {_TITLE} AS title, 'JR' || doc_id AS req_id, '' AS location, '' AS posted, {_DATE} AS date_posted,
       source, '{SITE}/job/Doc_JR' || doc_id AS url, core AS core_matches, nice AS nice_matches, neg AS neg_matches,
       left(text, 500) AS description_preview FROM scored JOIN documents USING (doc_id)"""
ORACLES["export_json_view"] = f"""
WITH {scored(one("demo"))}
SELECT doc_id::VARCHAR AS job_id, round(raw, 3) AS score, {_TITLE} AS title, md5(text) AS digest, replace(neg, '; ', '|') AS neg,
       'profile=''demo'' title=''' || left({_TITLE}, 80) || ''' url=''{SITE}/job/Doc_JR' || doc_id || '''' AS notes
FROM scored JOIN documents USING (doc_id)"""


def first_hits(bucket: str, n: int) -> str:
    return f"array_to_string(string_split({bucket}, '; ')[1:{n}], ', ') AS {bucket}"


ORACLES["report_view"] = f"""
WITH {scored(one("demo"))}
SELECT round(raw, 3) AS score, {_TITLE} AS title, 'JR' || doc_id AS req_id, '' AS location, '{SITE}/job/Doc_JR' || doc_id AS url,
       {first_hits("core", 10)}, {first_hits("nice", 10)}, {first_hits("neg", 10)}
FROM scored JOIN documents USING (doc_id) ORDER BY round(raw, 3) DESC, doc_id LIMIT 25"""
ORACLES["card_view"] = f"""
WITH {scored(one("demo"))}
SELECT round(raw, 3) AS score, {_TITLE} AS title, '{SITE}/job/Doc_JR' || doc_id AS url, 'Unknown location' AS location,
       CASE WHEN doc_id % 2 = 0 THEN '2024-05-01' ELSE 'Unknown posted date' END AS posted, 'JR' || doc_id AS req_id,
       {first_hits("core", 10)}, {first_hits("nice", 5)}, {first_hits("neg", 5)}, left(text, 1800) AS description
FROM scored JOIN documents USING (doc_id) ORDER BY round(raw, 3) DESC, doc_id LIMIT 25"""


# --- whole chains ------------------------------------------------------------------


def chain_scored(name: str, changes: dict, source: str, title: str, text: str) -> str:
    """The rank CTEs over other postings: ``source`` replaces the documents table."""
    profile = dict([next((n, s) for n, s in changes.items() if n == name)])
    ctes = scored(profile)
    return ctes.replace("FROM documents)", f"FROM {source})").replace(
        fold("split_part(text, chr(10), 1)"), fold(title)
    ).replace(fold("text"), fold(text))


ORACLES["search_chain"] = f"""
WITH {_PAGES}, cuts AS (SELECT source, min(page_no) FILTER (n_items < 2) AS cut FROM landed GROUP BY source),
scanned AS (SELECT d.*, d.doc_id // {DOCS_PER_PAGE} + 1 AS page_no FROM documents d
            JOIN cuts ON cuts.source = 'https://' || d.source || '.example.com/Careers'
            WHERE d.doc_id // {DOCS_PER_PAGE} + 1 <= least(4, coalesce(cut, 4))),
kept AS (SELECT * FROM scanned QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 9),
postings AS (SELECT doc_id, source, {_TITLE} AS title FROM kept),
{chain_scored("demo", _overridden(False), "postings", "title", "''")}
SELECT 'Careers' AS source, 'JR' || doc_id AS req_id, title, 'https://' || source || '.example.com/en-US/Careers/job/Doc_JR' || doc_id AS url,
       round(raw, 3) AS score FROM scored JOIN postings USING (doc_id)"""
ORACLES["search_chain_facets"] = (
    ORACLES["search_chain"]
    .replace("SELECT * FROM scanned QUALIFY", f"SELECT * FROM scanned WHERE lang IN ('en', 'fr') AND contains(lower({_TITLE}), 'the') QUALIFY")
)
ORACLES["browser_chain"] = f"""
WITH every AS (SELECT doc_id, {_SEQ}, source, {_TITLE} AS title,
                      CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'in ' || lang END AS location FROM documents),
matched AS (SELECT * FROM every WHERE page_no <= 9 AND (contains({key("title")}, 'the') OR contains({key("title")}, 'de'))
            AND (contains(location, 'en') OR contains(location, 'fr'))),
postings AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY source ORDER BY page_no, position) <= 6),
{chain_scored("demo", DEMO, "postings", "title", "''")}
SELECT source_ord, page_no, position, 'JR' || doc_id AS req_id, location, round(raw, 3) AS score
FROM scored JOIN postings USING (doc_id) ORDER BY score DESC, source_ord, page_no, position LIMIT 25"""
ORACLES["browser_chain_facets"] = ORACLES["browser_chain"].replace(
    "(contains(location, 'en') OR contains(location, 'fr'))", "lang IN ('en', 'fr')"
).replace("WITH every AS (SELECT doc_id,", "WITH every AS (SELECT lang, doc_id,")
_CITIES = """
towns AS (SELECT *, 'https://' || source || '.example.com/Careers' AS site, 'c' || (doc_id * 7 % 11 % 5) AS city,
                 count(*) FILTER (lang = 'en') OVER (PARTITION BY source) AS en FROM documents),
cities AS (SELECT site, city, en, count(*) FILTER (en = 0 OR lang = 'en')::INT AS n, count(*)::INT AS landed FROM towns GROUP BY ALL),
narrowed AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, city DESC)::INT AS rank FROM cities WHERE n > 0),
whole AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY landed DESC, city DESC)::INT AS rank FROM cities)"""
_BONUS = "least({} / 1000.0::DOUBLE, 3.0::DOUBLE)"
ORACLES["locations_in_turn"] = f"""
WITH {_CITIES}
SELECT DISTINCT site AS source, 'country en' AS query, 1::INT AS rank, 'locationHierarchy1' AS facet_key, 'en' AS value, 'Country en' AS label,
       en::INT AS count, round(100 + {_BONUS.format("en")}, 3) AS score FROM towns WHERE en > 0
UNION ALL SELECT site, 'city', rank, 'locationHierarchy2', city, 'City ' || city[2:], n, round(90 + {_BONUS.format("n")}, 3) FROM narrowed WHERE rank <= 2"""
ORACLES["locations_unresolved"] = f"""
WITH {_CITIES}
SELECT DISTINCT site AS source, 'nowhere' AS query FROM towns UNION ALL SELECT DISTINCT site, 'country en' FROM towns WHERE en = 0"""
ORACLES["resolve_repeated_pages"] = f"""
WITH {_CITIES}
SELECT DISTINCT site AS source, 'locationHierarchy1' AS facet_key, 'en' AS value, 0::BIGINT AS query_no, 1::BIGINT AS place FROM towns WHERE en > 0
UNION ALL SELECT site, 'locationHierarchy2', city, 1, rank FROM whole WHERE rank <= 3"""
ORACLES["browser_chain_locations"] = (
    ORACLES["browser_chain"]
    .replace("WITH every AS (SELECT doc_id,", f"WITH {_CITIES},\nevery AS (SELECT lang, site, city, doc_id,")
    .replace("AS location FROM documents)", "AS location FROM towns)")
    .replace(
        "(contains(location, 'en') OR contains(location, 'fr'))",
        "lang = 'en' AND (site, city) IN (SELECT (site, city) FROM narrowed WHERE rank = 1 AND en > 0)",
    )
)
ORACLES["browser_counts"] = f"""
WITH every AS (SELECT doc_id, {_SEQ}, source, {_TITLE} AS title, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'in ' || lang END AS location
               FROM documents),
rows_ AS (SELECT *, (contains({key("title")}, 'the') OR contains({key("title")}, 'de')) AND (contains(location, 'en') OR contains(location, 'fr')) AS hit
          FROM every WHERE page_no <= 9),
numbered AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY source_ord ORDER BY doc_id) AS hits FROM rows_),
stops AS (SELECT source_ord, min(doc_id) FILTER (hits >= 6) AS stop FROM numbered GROUP BY source_ord)
SELECT source_ord AS site_ord, count(*) FILTER (stop IS NULL OR doc_id <= stop) AS scanned, least(max(hits), 6) AS kept
FROM numbered JOIN stops USING (source_ord) GROUP BY source_ord"""
ORACLES["older_chain"] = f"""
WITH every AS (SELECT *, {_SEQ} FROM documents),
kept AS (SELECT * FROM every WHERE page_no <= 3 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 11)
SELECT source_ord, page_no, position, {_TITLE} AS title, 'JR' || doc_id AS req_id,
       'https://' || source || '.example.com/en-US/Careers/job/Doc_JR' || doc_id AS url, source || '/x' AS digest FROM kept"""
ORACLES["legacy_records"] = f"""
WITH kept AS (SELECT doc_id, {_TITLE} AS title FROM documents)
SELECT doc_id AS ingest_seq, title, 'JR' || doc_id AS req_id, '' AS location, '' AS posted, '{SITE}/job/Doc_JR' || doc_id AS url,
       CASE WHEN url IS NOT NULL THEN url || '/x' END AS digest
FROM kept LEFT JOIN pages ON doc_id = page_id"""
