"""The registered queries as DuckDB SQL, where SQL can express them: by counting all windows, shingles and pairs."""

from __future__ import annotations

import string

from prismcube.llm import licenses

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
BLANK = r"[\x20\x09-\x0D]+"

#: Vertices' smallest reachable one, over edges link(i, j) both ways.
REACH = "reach as (select i, j as r from link union select reach.i, link.j from reach join link on link.i = reach.r)"

REPEATED_BYTES = """
with doc as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
chunk as (select doc_id, n, c, substring(h, 1024 * c + 1, 1024 + 98) as part
          from (select doc_id, h, length(h) // 2 as n, unnest(range(0, (length(h) // 2 + 511) // 512)) as c from doc)),
byte as (select doc_id, 512 * c + o as i, substring(part, 2 * o + 1, 2) as b, case when 512 * c + o + 50 <= n then substring(part, 2 * o + 1, 100) end as s
         from (select doc_id, n, c, part, unnest(range(0, least(512, n - 512 * c))) as o from chunk)),
first as (select s, min(doc_id) as d from byte where s is not null group by s),
hit as (select doc_id, i, b, coalesce(d < doc_id, false) as repeated from byte left join first using (s)),
gone as (select doc_id, i, b, bool_or(repeated) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from hit),
run as (select doc_id, i, b, gone, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as starts from gone),
own as (select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where starts) as n_spans, string_agg(b, '' order by i) filter (where not gone) as kept from run group by doc_id)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from doc left join own using (doc_id)
"""

REPEATED_WORDS = f"""
with doc as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') as w from documents),
word as (select doc_id, i, w[i] as word, case when i + 49 <= len(w) then array_to_string(list_slice(w, i, i + 49), ' ') end as s
         from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from doc)),
first as (select s, min(doc_id) as d from word where s is not null group by s),
hit as (select doc_id, i, word, coalesce(d < doc_id, false) as repeated from word left join first using (s)),
gone as (select doc_id, i, word, bool_or(repeated) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from hit),
own as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from doc left join own using (doc_id)
"""

NEAR_COPIES = f"""
with recursive doc as (select doc_id, list_filter(string_split_regex({LOWER}, '{BLANK}'), lambda x: x <> '') as w from documents),
shingle as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s
            from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from doc where len(w) > 0)),
size as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (select a.doc_id as i, b.doc_id as j, count(*) as c from shingle a join shingle b using (s) where a.doc_id <> b.doc_id group by all),
link as (select i, j from pair join size a on a.doc_id = i join size b on b.doc_id = j where 100 * c >= 75 * (a.n + b.n - c)),
{REACH},
least as (select i, min(r) as r from reach group by i)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, least(doc_id, coalesce(r, doc_id)) as component_id, doc_id <= coalesce(r, doc_id) as kept
from doc left join size using (doc_id) left join least on i = doc_id
"""

NEAR_VECTORS = f"""
with recursive vec as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
good as (select * from vec where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
link as (select a.vec_id as i, b.vec_id as j from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
         where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
{REACH},
least as (select i, min(r) as r from reach group by i),
degree as (select i, count(*) as n from link group by i)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, least(vec_id, coalesce(r, vec_id)) as component_id, vec_id <= coalesce(r, vec_id) as kept
from vec left join degree on degree.i = vec_id left join least on least.i = vec_id
"""

SQL: dict[str, str] = {
    "op1_suffix_dedup": REPEATED_BYTES,
    "op3_near_dedup": NEAR_COPIES,
    "op4_licenses": licenses.oracle(),
    "op8_word_dedup": REPEATED_WORDS,
    "op9_embed_dedup": NEAR_VECTORS,
}
