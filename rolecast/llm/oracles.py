"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op2_exact_dedup"] = f"""
with hashed as (select doc_id, {FOLDED} as norm from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(norm) as text_sha256
from hashed window same as (partition by norm)
"""

ORACLES["op4_line_dedup"] = """
with split as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
    from documents),
keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
    from split),
often as (
    select line_key, max(doc_id) as last from keyed where length(line_key) >= 20
    group by line_key having count(distinct doc_id) >= 3)
select doc_id, count(*) as n_lines,
       count(*) filter (where last is not null and last <> doc_id) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where last is null or last = doc_id), ''))
           as kept_sha256
from keyed left join often using (line_key) group by doc_id
"""

ORACLES["op12_ranked_search"] = f"""
with term_of as (
    select doc_id, unnest(regexp_extract_all({FOLDED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as term from documents),
asked as (
    select item_id, unnest(regexp_extract_all({FOLDED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as term from benchmark),
tf as (select doc_id, term, count(*) as tf from term_of group by all),
n as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
whole as (select count(*)::bigint as docs, sum(n)::bigint as terms from n),
w as (
    select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w
    from tf, whole group by term),
scored as (
    select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
    from asked join w using (term) join tf using (term) join n using (doc_id), whole group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""

ORACLES["op13_hard_negatives"] = """
with q as (
    select vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
    from q a join q b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
       row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
