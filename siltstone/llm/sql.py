"""SQL counterparts of the llm queries that SQL can express."""

from __future__ import annotations

from siltstone.plans.catalogue import BLANK, fence_lines

#: Chinese and Japanese characters, as in words.CJK.
CJK = r"[々〇\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{3ffff}]"
#: Anything visible that is no letter, digit or underscore.
OTHER = r"[^\s\p{L}\p{N}_\p{Z}\x00-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"
WORDS5 = rf"regexp_extract_all(regexp_replace(regexp_replace(lower(text), '\p{{Nd}}+', '0', 'g'), '({CJK})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
SEQUENCES = f"""(select doc_id, len(w)::int as n_words, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) as g from (select doc_id, coalesce({WORDS5}, []) as w from documents))"""

#: The frequent lines of each source and their occurrences: tables m (all lines that count) and fr (source_id, form, support, documents).
LINES = rf"""t as (select extract_id, extracted_text as text from extract_results where source_id is not null and length(extracted_text) > 0), {fence_lines("t", "extract_id")},
      c as (select extract_id, source_id, document_id, n, regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') as t from k join extract_results using (extract_id) where not inside),
      m as (select *, regexp_replace(regexp_replace(lower(t), '{BLANK}+', ' ', 'g'), '\p{{Nd}}+', '0', 'g') as form from c where length(t) >= 20),
      d as (select source_id, count(distinct document_id) as documents from extract_results where length(extracted_text) > 0 group by 1),
      fr as (select source_id, form, support, documents from (select source_id, form, count(distinct document_id) as support from m group by all) join d using (source_id) where support >= 4 and support / documents >= 0.05)"""
#: The documents with a set of three-word sequences (table n), and their similar pairs (table p).
PAIRS = r"""r as (select document_id, ok, extracted_text from extract_results where document_id is not null qualify row_number() over (partition by document_id order by extracted_at desc nulls last, extract_id desc) = 1),
      w as (select document_id, regexp_extract_all(lower(extracted_text), '[\p{L}\p{N}]+') as w from r where ok and extracted_text is not null),
      g as (select distinct document_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as g from w), n as (select document_id, count(*) as n from g group by 1),
      o as (select a.document_id as a, b.document_id as b, count(*) as c from g a join g b on a.g = b.g and a.document_id < b.document_id group by all),
      p as (select a as document_id_a, b as document_id_b from o join n x on x.document_id = a join n y on y.document_id = b where c / (x.n + y.n - c) >= 0.7)"""



def _discounts(table: str) -> str:
    """The modified Kneser-Ney discounts d1, d2, d3 of each language, of a table of counts c."""
    d = lambda i: f"case when n{i} > 0 and n1 > 0 then greatest(0.0, least({i}.0, {i} - {i + 1} * (n1 / greatest(n1 + 2 * n2, 1)) * n{i + 1} / n{i})) else {0.5 * i} end as d{i}"
    return f"(select lang, {d(1)}, {d(2)}, {d(3)} from (select lang, {', '.join(f'count(*) filter (where c = {i}) as n{i}' for i in (1, 2, 3, 4))} from {table} group by lang))"


def _interpolated(table: str, context: str, rest: str, lower: str) -> str:
    """The probabilities p of the sequences of `table` (lang, <context>, <rest>, c, and the lower order's <lower>), given their context."""
    over = f"over (partition by lang, {context})"
    left = " + ".join(f"d{i} * sum(case when c {'=' if i < 3 else '>='} {i} then 1.0 else 0.0 end) {over}" for i in (1, 2, 3))
    return f"(select lang, {context}, {rest}, (greatest(c - case c when 1 then d1 when 2 then d2 else d3 end, 0.0) + ({left}) * {lower}) / sum(c) {over} as p from {table})"


SQL: dict[str, str] = {
    "p1_found": rf"""with t as (select distinct chunk_id, coalesce(primary_text, text) as x from document_chunks where chunk_id is not null),
      c as (select chunk_id, len(regexp_extract_all(x, '{CJK}')) + len(regexp_extract_all(regexp_replace(x, '{CJK}', ' ', 'g'), '[\p{{L}}\p{{N}}_]+|{OTHER}')) as n from t) select distinct chunk_id from c where n > 400""",
    "p1_rejoined": rf"""with t as (select distinct chunk_id, coalesce(primary_text, text) as x from document_chunks where chunk_id is not null),
      c as (select chunk_id, x, len(regexp_extract_all(x, '{CJK}')) + len(regexp_extract_all(regexp_replace(x, '{CJK}', ' ', 'g'), '[\p{{L}}\p{{N}}_]+|{OTHER}')) as n from t)
      select distinct chunk_id, n as n_tokens, true as within_limit, true as with_overlaps, sha256(x) as text_sha256 from c where n > 400""",
    "p2_found": f"with recursive {LINES} select extract_id, n::int as line_no from m join fr using (source_id, form)",
    "p2_lines": f"""with recursive {LINES} select source_id, min((extract_id, n))[1] as extract_id, min((extract_id, n))[2]::int as line_no, any_value(support)::bigint as support, any_value(documents)::bigint as documents
      from m join fr using (source_id, form) group by source_id, form""",
    "p2_clean": f"""with recursive {LINES}, x as (select extract_id, n from m join fr using (source_id, form)), g as (select extract_id, count(*) as gone from x group by 1),
      j as (select extract_id, coalesce(string_agg(line, chr(10) order by n), '') as text from k anti join x using (extract_id, n) group by 1)
      select e.extract_id, case when gone is null then extracted_text else coalesce(j.text, '') end as extracted_text, coalesce(gone, 0)::int as n_removed from extract_results e left join g using (extract_id) left join j using (extract_id)""",
    "p5_found": """with r as (select * from vector_points where point_id is not null qualify row_number() over (partition by point_id order by created_at desc nulls last) = 1),
      u as (select point_id, vector::double[] as v from r where is_active and len(vector) = 384 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
      s as (select a.point_id as a, b.point_id as b from u a join u b on a.point_id <> b.point_id qualify row_number() over (partition by a.point_id order by round(list_cosine_similarity(a.v, b.v), 9) desc, b.point_id) <= 10)
      select distinct least(a, b) as point_id_a, greatest(a, b) as point_id_b from s""",
    "p7_found": f"with {PAIRS} select document_id_a, document_id_b from p",
    "p7_groups": f"""with recursive {PAIRS}, e as (select document_id_a as a, document_id_b as b from p union all select document_id_b, document_id_a from p),
      reach(a, b) as (select document_id, document_id from r where ok union select reach.a, e.b from reach join e on e.a = reach.b)
      select a as document_id, min(b) as group_id, (select count(*) from e where e.a = reach.a) as links from reach group by a""",
    "p10_shares": f"""select s.doc_id, coalesce(lower(trim(d.lang)), 'und') as lang, n_words, coalesce(len(g), 0)::int as n_sequences, case when len(g) > 0 then (len(g) - len(list_distinct(g))) / len(g) else 0.0 end as repeated_share
      from {SEQUENCES} s join (select doc_id, any_value(lang) as lang from documents group by 1) d using (doc_id)""",
    "p10_perplexity": f"""with d as (select doc_id, coalesce(lower(trim(lang)), 'und') as lang, list_concat(['^', '^'], coalesce({WORDS5}, [])) as w from documents),
      g as materialized (select doc_id, lang, w[i] as u, w[i + 1] as v, w[i + 2] as x from d, unnest(range(1, len(w) - 1)) t(i)),
      c3 as materialized (select lang, u, v, x, count(*) as c from g group by all), c2 as materialized (select lang, v, x, count(*) as c from c3 group by all), c1 as (select lang, x, count(*) as c from c2 group by all),
      p1 as (select lang, x, (c + 1.0::double / (words + 1)) / (total + 1) as p1 from c1 join (select lang, sum(c)::double as total, count(*) as words from c1 group by 1) using (lang)),
      j2 as (select * from c2 join {_discounts("c2")} using (lang) join p1 using (lang, x)), p2 as (select lang, v, x, p as p2 from {_interpolated("j2", "v", "x", "p1")}),
      j3 as (select * from c3 join {_discounts("c3")} using (lang) join p2 using (lang, v, x)), p3 as (select * from {_interpolated("j3", "u, v", "x", "p2")}),
      n as (select doc_id, count(*) as n_words, -avg(ln(p)) as nats from g join p3 using (lang, u, v, x) group by 1),
      b as (select lang, quantile_disc(nats, 0.02) as lo, quantile_disc(nats, 0.98) as hi from d left join n using (doc_id) group by 1)
      select doc_id, lang, coalesce(n_words, 0) as n_words, round(exp(nats), 6) as perplexity, round(exp(lo), 6) as low, round(exp(hi), 6) as high, coalesce(nats < lo or nats > hi, false) as rejected from d left join n using (doc_id) join b using (lang)""",
    "p10_found": f"select doc_id from {SEQUENCES} where len(g) > 0 and 1 - len(list_distinct(g)) / len(g) >= 0.3",
}
