"""DuckDB SQL for the llm queries that SQL can express."""

from __future__ import annotations

from postmill.functions.labels import PREFERRED, REQUIRED

_LISTED = {k: ", ".join(f"'{x}'" for x in v) for k, v in (("yes", REQUIRED), ("no", PREFERRED))}
_VOTES = f"""(select record_id, mention_no, annotator, round(avg(v)) as vote from
 (select record_id, annotator, s.mention_no, case when x in ({_LISTED['yes']}) then 1.0 when x in ({_LISTED['no']}) then 0.0 end as v from
 (select record_id, annotator, s, lower(trim(regexp_replace(s.label, '\\s+', ' ', 'g'))) as x from
 (select record_id, annotator, unnest((list(skills order by submitted_at desc))[1]) as s from annotations_unified group by record_id, annotator)))
 where v is not null group by all having avg(v) != 0.5)"""

ORACLES: dict[str, str] = {
    "p2_agreement": f"""with v as materialized (select * from {_VOTES}), i as (select record_id, mention_no, count(*) as m, sum(vote) as k from v group by all having count(*) >= 2),
 t as (select count(*) as n_items, sum(m)::bigint as n_ratings, sum((m * m - k * k - (m - k) * (m - k)) / (m - 1)) as d, sum(k) as yes from i),
 e as (select n_items, n_ratings, d / n_ratings as o, (n_ratings::double * n_ratings - yes * yes - (n_ratings - yes) * (n_ratings - yes)) / (n_ratings::double * (n_ratings - 1)) as e from t)
 select n_items, n_ratings, round(o, 9) as observed, round(e, 9) as expected, round(1 - o / e, 9) as alpha from e""",
    "p2_labels": f"""select l as label, case when x in ({_LISTED['yes']}) then 'required_skill' when x in ({_LISTED['no']}) then 'preferred_skill' else 'abstained' end as reading, count(*) as n from
 (select coalesce(trim(s.label), '') as l, lower(trim(regexp_replace(s.label, '\\s+', ' ', 'g'))) as x from (select unnest((list(skills order by submitted_at desc))[1]) as s from annotations_unified group by record_id, annotator)) group by all""",
    "p6_listed": """with names as (select lower(trim(name)) as name, min(skill_id) as item from (select skill_id, unnest(list_prepend(canonical, coalesce(variants, []))) as name from skill_reference) group by 1),
 b as materialized (select distinct row_id, item from skills_flat join names on lower(trim(skill_name)) = name where row_id is not null), n as (select count(distinct row_id) as n from skills_flat), c as (select item, count(*) as k from b group by item),
 p as (select x.item as item_a, y.item as item_b, count(*) as n_ab from b x join b y on x.row_id = y.row_id and x.item < y.item group by all)
 select item_a, item_b, n_ab, ca.k as n_a, cb.k as n_b, n, round(n * n_ab / (ca.k::double * cb.k), 9) as lift from p join c ca on ca.item = item_a join c cb on cb.item = item_b, n""",
    "p9_bounds": "select source, true as within from source_weights",
    "p10_bounds": "select 0::bigint as too_long, 0::bigint as other_overlap, 0::bigint as not_in_text, 0::bigint as left_out",
}
