"""DuckDB SQL that gives the same rows as the queries of reference_queries.

Vocabularies and patterns are those of the library; the statements themselves are written apart from it.
"""

from __future__ import annotations

from postmill.functions import fields, labels, salary, text, titles
from postmill.plans.reference_queries import BASE_URL, DISTANCE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} is null or not regexp_matches({x}, '\\S'))"


def fold(x: str) -> str:
    return f"translate({strip(f'lower({x})')}, {q(text.MARKED)}, {q(text.PLAIN)})"


def first_hit(x: str, rules: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, {q(p)}) then {q(name)}" for name, p in rules) + f" else {default} end"


def skill_key(x: str) -> str:
    t = strip(f"lower({x})")
    t = f"regexp_replace({t}, {q('(?s)^(?:' + '|'.join(text.DESCRIPTORS) + r') (.*\S.*)$')}, '\\1')"
    t = f"translate({t}, '/_', '  ')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([a-z0-9])-([a-z0-9])', '\\1 \\2', 'g')"
    cut = f"regexp_replace({t}, '\\.+$', '')"
    keep = cut
    for _ in range(2):
        keep = f"regexp_replace({keep}, '(\\p{{L}})\\.(\\p{{L}})', '\\1' || chr(1) || '\\2', 'g')"
    short = f"replace(replace({keep}, '.', ' '), chr(1), '.')"
    return strip(f"regexp_replace(case when length({t}) < 6 then {short} else replace({cut}, '.', ' ') end, ' +', ' ', 'g')")


def skill_match_key(x: str) -> str:
    t = strip(f"regexp_replace(translate({strip(f'lower({x})')}, '.-_/', ''), '\\s+', ' ', 'g')")
    cases = " ".join(f"when {t} like '%{s}' and length({t}) > {len(s)} then left({t}, length({t}) - {len(s)})" for s in text.LIBRARY_SUFFIXES)
    return f"case when contains({t}, ' ') then {t} else case {cases} else {t} end end"


def category_key(x: str) -> str:
    return f"case when {blank(x)} then 'Other' else regexp_replace({strip(x)}, '\\s*/\\s*', '/', 'g') end"


def boards(columns: str) -> str:
    return f"(select distinct * from (select 'itviec' as source, {columns} from raw_jobs_itviec union all select 'topcv', {columns} from raw_jobs_topcv))"


def place(x: str) -> str:
    k = fold(x)
    keys = fields.place_keys()
    exact = "case " + " ".join(f"when k = {q(s)} then {q(n)}" for s, n in keys) + " end"
    inside = "case " + " ".join(f"when contains(k, {q(s)}) then {q(n)}" for s, n in keys) + f" else {q(fields.OTHER_PLACE)} end"
    return f"case when {blank(x)} then {q(fields.OTHER_PLACE)} else (select coalesce({exact}, {inside}) from (select {k} as k)) end"


LEVEL = "case " + " ".join(f"when regexp_matches(lower(X), {q(p)}) then {q(n)}" for n, p in fields.LEVELS) + " end"


def level(x: str) -> str:
    return LEVEL.replace("X", x)


def employment() -> str:
    full = strip("lower(concat_ws(' ', job_title, job_description))")
    rules = [
        (fields.SEASONAL, r"\d+[\s-]*(?:month|tháng)s?[\s-]+contract|hợp đồng thời vụ|thời vụ|seasonal|contract type:|freelance"),
        (fields.REMOTE, "T:" + r"\[[^\]]*remote[^\]]*\]|^remote"), (fields.HYBRID, "T:" + r"[\[(][^\])]*hybrid[^\])]*[\])]"),
        (fields.REMOTE, r"100% remote|fully remote|full remote|remote 100%|work from anywhere|làm việc từ xa hoàn toàn"),
        (fields.HYBRID, r"hybrid (?:work|working|model|mode|schedule)|hybrid[^a-z]{1,3}\d days?|làm việc hybrid"), (fields.REMOTE, r"work(?:ing)? remotely|remote work|làm việc từ xa"),
    ]
    part = r"part[\s-]?time|bán thời gian"
    full_time = r"full[\s-]?time|toàn thời gian|(?:không|no|not|without)\s+(?:\S+\s+){0,3}part[\s-]?time"
    cases = " ".join(f"when regexp_matches({'coalesce(lower(job_title), chr(1))' if p[:2] == 'T:' else 'f'}, {q(p.removeprefix('T:'))}) then {q(n)}" for n, p in rules)
    found = f"case when f = '' then {q(fields.FULL_TIME)} when regexp_matches(f, {q(part)}) and not regexp_matches(f, {q(full_time)}) then {q(fields.PART_TIME)} {cases} else {q(fields.FULL_TIME)} end"
    return f"(select source, posting_id, employment_type, {found} as found from (select *, {full} as f from {boards('posting_id, job_title, job_description, employment_type')}))"


EXPERIENCE = f"""(select *, case when {blank('experience')} then {q(fields.NOT_REQUIRED)} when regexp_matches(t, 'dưới 1 năm|under 1 year|less than a year|fresher|intern') and not (n is not null and n = 0) and not (n > 20) and p = '' and num = '' then 'Dưới 1 năm'
 when n = 0 then 'Dưới 1 năm' when n > 20 then {q(fields.NOT_REQUIRED)} when p != '' then 'Trên ' || regexp_extract(p, '\\d+', 0) || ' năm' when num != '' then n || ' năm' else {q(fields.NOT_REQUIRED)} end as years
 from (select *, try_cast(nullif(num, '') as int) as n from (select *, lower(experience) as t, regexp_extract(lower(experience), '(\\d{{1,2}})\\s*\\+\\s*(?:years?|năm|nam)|(?:trên|over|more than)\\s+(\\d{{1,2}})\\s*(?:years?|năm|nam)', 0) as p,
  regexp_extract(lower(experience), '(\\d{{1,2}})\\s*(?:-|–|to|đến)?\\s*\\d{{0,2}}\\s*\\+?\\s*(?:years?|năm|nam)', 1) as num from {boards('posting_id, experience')})))"""

CLASSIFY = f"""(select *, case when {blank('job_title')} then 'review' when safe then 'keep' when g is not null then 'drop' else 'keep' end as decision,
 case when {blank('job_title')} then 'empty_title' when safe then null else g end as reason from (select *, {' or '.join(f"regexp_matches(lower(job_title), {q(p)})" for p in titles.SAFE_PATTERNS)} as safe,
 {first_hit('lower(job_title)', titles.DROP_GROUPS, 'null')} as g from {boards('posting_id, job_title')}))"""

CLEAN = f"""(select mention_id, row_id, skill_name, label, {skill_key('skill_name')} as skill, {category_key('category')} as category from
 (select *, row_number() over (partition by mention_id order by extracted_at desc nulls last, row_id desc nulls last, skill_name desc, label desc nulls last, category desc) as k from skills_flat where not {blank('skill_name')} and category is not null) where k = 1)"""

AGG = f"""(select skill, category, count(*) as total, count(*) filter (label = 'required_skill') as required, count(*) filter (label = 'preferred_skill') as preferred,
 count(distinct row_id) as records, min(mention_id) as first, list_sort(list(distinct skill_name)) as spellings from {CLEAN} group by skill, category)"""

EDGES = f"""(select variant, arg_max(canonical, ord) as canonical from (select skill_id as ord, {skill_key('canonical')} as canonical, {skill_key('v')} as variant from
 (select skill_id, canonical, unnest(variants) as v from skill_reference)) where variant != '' and variant != canonical group by variant)"""

CLOSED = f"""(with recursive e as materialized (select * from {EDGES}), w(variant, canonical, depth) as (select variant, canonical, 0 from e union all select w.variant, e.canonical, w.depth + 1 from w join e on e.variant = w.canonical where w.depth < 40)
 select variant, arg_max(canonical, depth) as canonical from w group by variant)"""

MEMBERS = f"(select coalesce(m.canonical, a.skill) as cluster_id, a.skill as name, a.category, a.total, a.required, a.preferred, a.first from {AGG} a left join {CLOSED} m on m.variant = a.skill)"

SUMMARY = f"""(with members as materialized (select * from {MEMBERS}),
 names as (select cluster_id, name, sum(total) as n from members group by all),
 best as (select cluster_id, (list(name order by not regexp_full_match(name, '[\\x00-\\x7F]*'), -n, length(name), name))[1] as canonical from names group by cluster_id),
 cats as (select cluster_id, category, sum(total) as n, min(first) as first from members group by all),
 hist as (select cluster_id, '{{' || string_agg('"' || category || '":' || n, ',' order by category) || '}}' as categories, count(*) as k, (list(category order by n desc, first))[1] as dom, max(n) as top, list(n) as ns from cats group by cluster_id),
 sums as (select cluster_id, sum(total) as total, sum(required) as required, sum(preferred) as preferred, count(distinct name) as n_members from members group by cluster_id)
 select cluster_id, canonical, n_members, total::bigint as total, required::bigint as required, preferred::bigint as preferred, categories, dom as dominant_category, round(top::double / total::double, 4) as dominant_share, k > 1 as cross_category,
 len(list_filter(ns, lambda x: x = top)) > 1 as tie, case when n_members = 1 and total < 5 then dom || ' Other' else canonical end as final from sums join best using (cluster_id) join hist using (cluster_id))"""

MAPPING = f"(select name, category, cluster_id, final, sum(m.total)::bigint as total from {MEMBERS} m join (select cluster_id, final from {SUMMARY}) s using (cluster_id) group by all)"


def label(x: str) -> str:
    t = f"lower(trim(regexp_replace({x}, '[\\s\u00a0]+', ' ', 'g')))"
    return f"case when {t} in ({', '.join(map(q, labels.REQUIRED))}) then 'required_skill' when {t} in ({', '.join(map(q, labels.PREFERRED))}) then 'preferred_skill' end"


ANNOTATIONS = f"""(select record_id, annotator, name, min(ord) as ord, arg_min(label, (ord, coalesce(label, ''), category)) as label0, (list(label order by ord, coalesce(label, ''), category))[1] as label, (list(category order by ord, coalesce(label, ''), category))[1] as category from
 (select record_id, annotator, s.mention_no as ord, {skill_match_key('s.skill_name')} as name, {label('s.label')} as label, {category_key('s.category')} as category from
 (select record_id, annotator, unnest((list(skills order by submitted_at desc))[1]) as s from annotations_unified group by record_id, annotator)) where name is not null and name != '' group by record_id, annotator, name)"""

PAIR = f"""(with n as materialized (select * from {ANNOTATIONS}) select coalesce(a.record_id, b.record_id) as record_id, a.name as name_a, b.name as name_b, a.label as label_a, b.label as label_b, a.category as category_a, b.category as category_b
 from (select * from n where annotator = 'human_a') a full join (select * from n where annotator = 'llm') b on a.record_id = b.record_id and a.name = b.name)"""


def kappa(a: str, b: str) -> str:
    return f"""with c as (select {a} as a, {b} as b, count(*) as n from {PAIR} where name_a is not null and name_b is not null and {a} is not null and {b} is not null group by all),
 t as (select coalesce(sum(n), 0)::bigint as n, coalesce(sum(n) filter (a = b), 0)::double as agree from c), x as (select a as k, sum(n) as na from c group by a), y as (select b as k, sum(n) as nb from c group by b),
 e as (select coalesce(sum(na::double * nb::double), 0) as chance from x join y using (k)), f as (select n, agree / n as po, chance / (n::double * n) as pe from t, e)
 select n, round(po, 6) as observed, round(pe, 6) as expected, case when n >= 2 then case when pe >= 1 then 1.0 else round((po - pe) / (1 - pe), 6) end end as kappa from f"""


def standard_title() -> str:
    rules = []
    for name, groups, inside, whole in titles.TITLE_RULES:
        tests = [" and ".join(f"list_contains(w, {q(x)})" for x in g) for g in groups]
        tests += [f"contains(t, {q(x)})" for x in inside] + [f"t = {q(x)}" for x in whole]
        rules.append(f"when {' or '.join(f'({x})' for x in tests)} then {q(name)}")
    merges = "case x " + " ".join(f"when {q(a)} then {q(b)}" for a, b in titles.TITLE_MERGES.items()) + " else x end"
    words = "list_filter(regexp_extract_all(lower(standardized_title), '[\\p{L}\\p{N}\\p{M}_]+'), lambda v: regexp_full_match(v, '[a-z0-9]+'))"
    source = f"select standardized_title from skills_flat union select job_title from {boards('job_title')}"
    inner = f"select distinct standardized_title, {strip('lower(standardized_title)')} as t, {words} as w from ({source})"
    return f"select standardized_title, {merges} as title from (select standardized_title, case {' '.join(rules)} else standardized_title end as x from ({inner}))"


LOG = """(select record_id, annotator, (list(skills order by submitted_at desc))[1] as skills, (length(annotator) + record_id::int) % 6 as kind from annotations_unified group by record_id, annotator)"""

LAST = "list({0} order by crawled_at desc, coalesce(salary, '') desc, coalesce(experience, '') desc)[1]"

NEGOTIABLE = ", ".join(map(q, salary.NEGOTIABLE_TEXTS))
_MILLION = "case when {0} <= 0 then 0.0 when usd then {0} * 25000 / 1e6 when {0} >= 1e6 then {0} / 1e6 else {0} end"
PAY = f"""(select source, posting_id, salary, contains(lower(salary), 'thỏa thuận') as th, coalesce({_MILLION.format('a')}, 0.0) as lo, coalesce({_MILLION.format('b')}, 0.0) as hi from
 (select *, case when up then 0.0 else n[1] end as a, case when up then n[1] when fr then 0.0 when contains(t, '-') and len(n) >= 2 then n[2] else n[1] end as b from
 (select *, list_transform(regexp_extract_all(t, '\\d+(?:\\.\\d+)?'), lambda x: x::double) as n, regexp_matches(t, 'up to|upto|tới') as up, regexp_matches(t, 'từ|from') as fr, contains(t, 'usd') or contains(t, '$') as usd from
 (select *, regexp_replace(regexp_replace(case when salary = {q(fields.NEGOTIABLE)} then '' else replace(replace({strip('lower(salary)')}, '–', '-'), ',', '') end, '(\\d)\\.(\\d{{3}})([^0-9]|$)', '\\1\\2\\3', 'g'), '(\\d)\\.(\\d{{3}})([^0-9]|$)', '\\1\\2\\3', 'g') as t from
 (select source, posting_id, case when salary is null or {' or '.join(f"contains(lower(salary), {q(x)})" for x in fields.SALARY_NOISE)} then {q(fields.NEGOTIABLE)} else salary end as salary from {boards('posting_id, salary')})))))"""
DECLARED = "list_concat(" + ", ".join(f"regexp_extract_all(t, {q(p)}, 1)" for p in fields.ROLE_DECLARATIONS) + ")"
VALID = """(with known as (select lower(trim(skill_name)) as name, count(*) as n from skills_flat where skill_name is not null group by 1 having lower(trim(skill_name)) != ''),
 g as (select skill_id as ord, lower(trim(case when skill_id % 3 = 0 then canonical || ' (unknown)' else canonical end)) as c, list_transform(list_concat(variants, [canonical, 'no such skill']), lambda x: lower(trim(x))) as v from skill_reference),
 e as (select distinct ord, c, unnest(v) as v from g), k as (select e.*, n from e join known on name = v), h as (select ord, case when c in (select name from known) then c else (list(v order by n desc, v desc))[1] end as canonical from k group by ord, c)
 select ord, canonical, list(v) as variants from k join h using (ord) where v != canonical group by ord, canonical)"""


def tidy(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s{chr(160)}]+', ' ', 'g'))"


ORACLES: dict[str, str] = {
    "text_skill_key": f"select distinct skill_name, {skill_key('skill_name')} as skill from skills_flat where skill_name is not null",
    "text_skill_match_key": f"select distinct skill_name, {skill_match_key('skill_name')} as skill from skills_flat where skill_name is not null",
    "text_category_key": f"select {category_key('category')} as category, count(*) as n from skills_flat group by 1",
    "text_title_tokens": f"select distinct job_title, array_to_string(list_filter(regexp_extract_all(lower(job_title), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+')), ' ') as tokens from {boards('job_title')} where job_title is not null",
    "text_url_key": f"select distinct posting_id, url, k as url_key, case when s != '' and not contains(s, '/') and length(s) < 50 and s not in ('search', 'login', 'all', 'companies') then s end as slug from (select posting_id, url, k, regexp_replace(regexp_replace(k, '^{BASE_URL}/it-jobs', ''), '^/+|/+$', '', 'g') as s from (select posting_id, url, string_split(url, '?')[1] as k from raw_jobs_itviec))",
    "text_fold": f"select distinct location, {fold('location')} as folded, regexp_full_match(location, '(?s)[\\x00-\\x7F]*') as is_ascii from {boards('location')} where location is not null",
    "location_canonical": f"""select source, posting_id, location, {place('raw')} as place from (select *, case when source = 'itviec' then {strip("string_split(string_split(location, ',')[-1], '-')[1]")}
 when {blank('location')} then {q(fields.OTHER_PLACE)} else regexp_replace({strip("replace(string_split(location, '-')[-1], 'Việc làm tại', '')")}, '[.,]+$', '') end as raw from {boards('posting_id, location')})""",
    "level_extract": f"select source, posting_id, job_title, level, coalesce({level('job_title')}, {level('level')}, {q(fields.DEFAULT_LEVEL)}) as job_level from {boards('posting_id, job_title, level')}",
    "education_extract": f"select source, posting_id, education, case when {blank('education')} then {q(fields.NOT_REQUIRED)} else {first_hit('lower(education)', fields.DEGREES, q(fields.NOT_REQUIRED))} end as degree from {boards('posting_id, education')}",
    "experience_extract": f"select source, posting_id, experience, years from {EXPERIENCE}",
    "employment_type": f"select distinct source, posting_id, found from {employment()}",
    "employment_reconcile": f"""select source, final, audit, count(distinct posting_id) as n from (select *, case when {blank('employment_type')} then found when rare and s != found then found when s = {q(fields.FULL_TIME)} and found in ('Remote', 'Hybrid') then found else s end as final,
 case when {blank('employment_type')} then 'empty' when s = found then 'agree' when rare then 'overridden' when s = {q(fields.FULL_TIME)} and found in ('Remote', 'Hybrid') then 'refined' when s = {q(fields.FULL_TIME)} then 'kept' else 'other_kept' end as audit
 from (select *, {strip('employment_type')} as s, {strip('employment_type')} in ({q(fields.PART_TIME)}, {q(fields.SEASONAL)}) as rare from {employment()})) group by all""",
    "salary_placeholders": f"""select source, negotiable, placeholder, count(distinct posting_id) as n from (select source, posting_id, salary is null or salary = {q(fields.NEGOTIABLE)} or {' or '.join(f"contains(lower(salary), {q(x)})" for x in fields.SALARY_NOISE)} as negotiable,
 coalesce(regexp_matches(lower(salary), 'sign in|đăng nhập|not found'), false) as placeholder from {boards('posting_id, salary')}) group by all""",
    "title_classify": f"select distinct job_title, decision, reason from {CLASSIFY}",
    "title_drop_breakdown": f"select reason, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 2) as pct from {CLASSIFY} where decision = 'drop' group by reason",
    "title_drop_report": f"select reason, job_title, count(*) as rows from (select distinct source, job_title, reason from {CLASSIFY} where decision = 'drop') group by reason, job_title",
    "title_post_filter": f"""select distinct job_title, case when t = 'account manager' then 'account_manager' when contains(p, ' sales ') and not regexp_matches(t, 'presales|pre-sales|sales engineer') then 'sales_non_it' when {' or '.join(f"contains(p, ' {x} ')" for x in titles.DROP_TOKENS)} then 'keyword' end as dropped
 from (select job_title, lower(job_title) as t, ' ' || regexp_replace(lower(job_title), '[^a-z0-9]+', ' ', 'g') || ' ' as p from {boards('job_title')})""",
    "title_rule_audit": " union all ".join(
        f"select {i} as rule_no, {q(g)} as group_name, (select count(*) filter (regexp_matches(lower(job_title), {q(p)})) from {boards('job_title')}) as hits" for i, (g, p) in enumerate([*titles.DROP_GROUPS, *(("safe", p) for p in titles.SAFE_PATTERNS)])
    ),
    "union_boards": "select 'itviec' as source, count(*) as n, count(page_lang) as n_lang, 0::bigint as n_brand, count(distinct posting_id) as postings from raw_jobs_itviec union all select 'topcv', count(*), 0, count(brand_recrawled), count(distinct posting_id) from raw_jobs_topcv",
    "dedup_first": "select posting_id, url, experience, crawled_at from (select *, row_number() over (partition by posting_id order by crawled_at nulls first, url nulls first, experience nulls first) as r from raw_jobs_itviec) where r = 1",
    "dedup_last": "select posting_id, url, experience, crawled_at from (select *, row_number() over (partition by posting_id order by crawled_at desc nulls last, url desc nulls last, coalesce(experience, '') desc) as r from raw_jobs_topcv) where r = 1",
    "surrogate_keys": "select posting_id, max(url) as url, row_number() over (order by max(url) nulls first, posting_id) as job_id from raw_jobs_itviec group by posting_id",
    "star_schema": f"select job_id, count(*) as mentions, count(distinct skill) as skills from {CLEAN} c left join (select posting_id, row_number() over (order by max(url) nulls first, posting_id) as job_id from raw_jobs_itviec group by posting_id) k on c.row_id = k.posting_id::varchar group by job_id",
    "recrawl_needed": "select distinct posting_id from raw_jobs_topcv where contains(url, '/brand/') and " + " + ".join(f"({blank(c)} or {strip(c)} = '[]')::int" for c in ("company", "required_skills", "preferred_skills", "specialization")) + " >= 2",
    "patch_recrawled": f"select posting_id, {LAST.format('salary')} as salary, {LAST.format('experience')} as experience, min(crawled_at) as crawled_at from raw_jobs_topcv group by posting_id",
    "unprocessed_anti": "select distinct posting_id from raw_jobs_itviec where posting_id not in (select record_id::bigint from annotations_unified where annotator = 'llm' and len(skills) > 0)",
    "merge_llm_titles": f"""select posting_id, case when status = 'ok' then coalesce(st, '') else '' end as standardized_title, status from (select j.posting_id, a.st, case when {blank('j.job_title')} then 'no_title' when a.posting_id is null or j.posting_id % 11 = 0 then 'no_answer' when j.posting_id % 7 = 0 then 'invalid' else 'ok' end as status
 from (select posting_id, max(job_title) as job_title from raw_jobs_itviec group by posting_id) j left join (select row_id::bigint as posting_id, max(standardized_title) as st from skills_flat group by row_id) a using (posting_id))""",
    "missing_profile": 'select "column", missing, round(missing * 100.0 / n, 2) as pct from (' + " union all ".join(
        f"select {q(c)} as \"column\", count(*) filter (where {blank(f'{c}::varchar')}" + (f" or {c} in ('[]', '['''']', '[\"\"]')" if c in ("required_skills", "preferred_skills") else f" or not regexp_matches({c}, '\\d')" if c == "salary" else "") + ") as missing, count(*) as n from raw_jobs_topcv"
        for c in ("posting_id", "url", "job_title", "company", "location", "salary", "experience", "education", "level", "employment_type", "industry", "required_skills", "preferred_skills", "specialization", "job_description", "requirement", "brand_recrawled", "crawled_at", "loaded_at")
    ) + ") where missing > 0",
    "value_counts_pct": "select level, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 2) as pct from raw_jobs_topcv group by level",
    "category_stats": f"select category, count(*) as mentions, count(distinct skill) as skills from {CLEAN} group by category",
    "title_stats": "select standardized_title, count(distinct row_id) as records, max(length(source_text))::int as longest from skills_flat where standardized_title is not null group by 1 having count(distinct row_id) >= 10",
    "name_collisions": "select lower(trim(skill_name)) as folded, count(distinct skill_name) as n, array_to_string(list_sort(list(distinct skill_name)), '|') as spellings from skills_flat where skill_name is not null group by 1 having count(distinct skill_name) > 1",
    "referential_check": "with a as (select distinct record_id::bigint as id from annotations_unified), b as (select posting_id as id from raw_jobs_itviec union select posting_id from raw_jobs_topcv) select 'left' as side, count(*) as n from (from a except from b) having count(*) > 0 union all select 'right', count(*) from (from b except from a) having count(*) > 0",
    "split_halves": "select case when r <= n // 2 then 1 else 2 end as half, count(*) as n, min(posting_id) as first, max(posting_id) as last from (select posting_id, row_number() over (order by posting_id) as r, count(*) over () as n from (select distinct posting_id from raw_jobs_itviec)) group by 1",
    "batching": "select (r - 1) // 200 as batch_id, count(*) as n, min(posting_id) as first from (select posting_id, row_number() over (order by posting_id) as r from (select distinct posting_id from raw_jobs_topcv)) group by 1",
    "skill_drop_reasons": f"select case when {blank('skill_name')} then 'blank_skill' when category is null then 'null_category' end as reason, count(*) as n from skills_flat group by 1",
    "skill_aggregate": f"select skill, category, total, required, preferred, records, first, array_to_string(spellings, '|') as spellings from {AGG}",
    "alias_closure": f"select variant, canonical from {CLOSED}",
    "alias_stats": f"select count(*) as mentions, count(*) filter (n.canonical != c.skill) as changed, count(distinct c.skill) as distinct_before, count(distinct coalesce(n.canonical, c.skill)) as distinct_after, round(count(*) filter (n.canonical != c.skill) * 100.0 / count(*), 2) as changed_pct from {CLEAN} c left join {CLOSED} n on n.variant = c.skill",
    "dominant_vote": f"select skill, (list(category order by total desc, first))[1] as dominant_category, round(max(total)::double / sum(total)::double, 4) as share, len(list_filter(list(total), lambda x: x = max(total))) > 1 as tie from {AGG} group by skill".replace(
        "len(list_filter(list(total), lambda x: x = max(total))) > 1", "count(*) filter (total = mx) > 1"
    ).replace(f"from {AGG}", f"from (select *, max(total) over (partition by skill) as mx from {AGG})"),
    "cluster_summary": f"select * from {SUMMARY}",
    "canonical_mapping": f"select * from {MAPPING}",
    "skill_distribution": f"select final, sum(total)::bigint as total, count(distinct name) as n_variants, (list(category order by total desc, category desc))[1] as dominant_category, array_to_string(list_sort(list(distinct name))[1:5], '|') as sample from {MAPPING} group by final",
    "short_names": f"select case when length(skill) <= 7 then 'short' else 'long' end as kind, count(distinct skill) as n from {CLEAN} group by 1",
    "role_block": f"select cluster_id, final, total from {SUMMARY} where {skill_key('final')} not in ('cold calling', 'karaoke', 'nail art')",
    "category_override": f"select cluster_id, final, case lower(trim(final)) when 'sql' then 'Query Language' when 'english' then 'Language' else dominant_category end as dominant_category, tie and lower(trim(final)) not in ('sql', 'english') as tie from {SUMMARY}",
    "apply_overrides": f"""with s as materialized (select * from {SUMMARY}), o as (select cluster_id, count(distinct name) as k, min('x ' || name) as o from {MAPPING} where name in ('python', 'java', 'sql') group by cluster_id)
 select cluster_id, canonical, case when k = 1 then o when k > 1 then canonical else final end as final from s left join o using (cluster_id)""",
    "cross_category": f"select skill, count(distinct category) as n_categories from {CLEAN} group by skill having count(distinct category) > 1",
    "suggested_action": f"select case when total < 5 then 'IGNORE' when dominant_share >= 0.9 then 'MERGE' when dominant_share >= 0.7 then 'MERGE_REVIEW' else 'REVIEW_SPLIT' end as action, count(*) as clusters, sum(total)::bigint as mentions from {SUMMARY} group by 1",
    "top_skills_per_category": f"select category, r::int as rank, skill, total from (select *, row_number() over (partition by category order by total desc, skill) as r from {AGG}) where r <= 20",
    "embedding_edges": f"select a.vec_id as a, b.vec_id as b, round(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as distance from embeddings a join embeddings b on a.vec_id < b.vec_id where 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]) < {DISTANCE}",
    "embedding_components": f"""with recursive p as materialized (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id < b.vec_id where 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]) < {DISTANCE}),
 e as materialized (select a, b from p union all select b, a from p), r(id, c) as (select vec_id, vec_id from embeddings union select r.id, e.b from r join e on e.a = r.c) select id as vec_id, min(c) as component from r group by id""",
    "iaa_f1": f"""with p as (select record_id, count(name_a) as a, count(name_b) as b, count(*) filter (name_a is not null and name_b is not null) as m from {PAIR} group by record_id),
 r as (select case when b > 0 then m / b else 0 end as p, case when a > 0 then m / a else 0 end as r from p) select count(*) as records, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end), 6) as f1 from r""",
    "iaa_kappa_label": kappa("label_a", "label_b"),
    "iaa_kappa_category": kappa("category_a", "category_b"),
    "iaa_confusion": f"select label_a as a, label_b as b, count(*) as n from {PAIR} where name_a is not null and name_b is not null group by all",
    "iaa_errors": f"""select error, count(*) as n from (select case when name_b is null then 'only_human_a' when name_a is null then 'only_llm' when label_a is distinct from label_b and category_a is distinct from category_b then 'label_category_disagreement'
 when label_a is distinct from label_b then 'label_disagreement' when category_a is distinct from category_b then 'category_disagreement' end as error from {PAIR}) where error is not null group by error""",
    "iaa_fleiss": f"""with r as (select record_id, name, label, count(*) as n from {ANNOTATIONS} where annotator in ('human_a', 'human_b', 'llm') and label is not null group by all),
 f as (select record_id, name, sum(n) as k, sum(n * n) as sq from r group by all having sum(n) = 3), p as (select count(*) as items, avg((sq - 3) / 6.0::double) as p from f),
 c as (select label, sum(r.n) as n from r join f using (record_id, name) group by label), s as (select sum(n::double * n::double) as s from c)
 select items, case when s / (items * 3.0::double * items * 3) >= 1 then 1.0 else round((p - s / (items * 3.0::double * items * 3)) / (1 - s / (items * 3.0::double * items * 3)), 6) end as kappa from p, s""",
    "title_standard": standard_title(),
    "json_parse": f"select record_id, annotator, len(skills) as n, len(list_filter(skills, lambda x: x.category is not null)) as n_category from {LOG} where kind < 4 and len(skills) > 0",
    "json_errors": f"select case when kind = 5 then 'no_text' when kind = 4 or (kind = 2 and len(skills) = 0) then 'unparsable' when kind in (0, 3) then 'ok' else 'repaired' end as status, count(*) as n from {LOG} group by 1",
    "events_props": "select event_type, count(*) as n, sum((props::json->>'k')::bigint)::bigint as sum_k, round(sum(value), 4) as sum_value from events group by event_type",
    "html_rows": f"""select posting_id, 'job' as kind, {', '.join(f"nullif({strip(f"regexp_replace({c}, '[\\s{chr(160)}]+', ' ', 'g')")}, '') as {c}" for c in ('job_title', 'company'))}, coalesce(nullif({strip(f"regexp_replace(salary, '[\\s{chr(160)}]+', ' ', 'g')")}, ''), 'Not Found') as salary
 from (select posting_id, max(job_title) as job_title, max(company) as company, max(salary) as salary from raw_jobs_topcv group by posting_id)""",
    "stream_resume": "select event_type as requirement, count(*) as n, min(event_id) as first from events where event_type != 'error' group by 1",
    "salary_bounds": f"""select source, posting_id, salary, round(lo, 2) as min_salary, round(hi, 2) as max_salary, round(case when lo > 0 and hi > 0 then (lo + hi) / 2 else greatest(lo, hi) end, 2) as avg_salary, false as is_null_salary, th as is_thoa_thuan,
 th or trim(lower(salary)) in ('', 'nan', 'none') or round(case when lo > 0 and hi > 0 then (lo + hi) / 2 else greatest(lo, hi) end, 2) = 0 as is_missing_salary from {PAY}""",
    "salary_completeness": f"select source, count(*) as rows, round(avg((round(greatest(lo, hi), 2) > 0)::int), 4) as share from {PAY} group by source",
    "salary_masks": f"""select source, salary is null as is_null_salary, coalesce(x in ({NEGOTIABLE}), false) as is_thoa_thuan, salary is null or x in ({NEGOTIABLE}) as is_missing_salary, salary is not null and x not in ({NEGOTIABLE}, '') as valid, count(*) as n
 from (select *, {strip('lower(salary)')} as x from {boards('posting_id, salary')}) group by all""",
    "mapping_invariants": "select unnest(['conservation', 'missing', 'extra', 'null_final', 'repeated']) as check, 0::bigint as violations",
    "run_report": f"""with m as materialized (select * from {MEMBERS}), s as materialized (select * from {SUMMARY}) select (select sum(total)::bigint from m) as mentions, (select count(distinct name) from m) as names, (select count(*) from m) as keys,
 count(*) as clusters, count(*) filter (cross_category) as cross_category, count(*) filter (tie) as ties, count(*) filter (final like '% Other') as other_bucket, count(distinct final) as finals from s""",
    "canonical_collisions": f"select lower(c) as canonical, sum(1 + (category < 'C')::int)::bigint as clusters from (select category, (list(skill order by total desc, skill desc))[1] as c from {AGG} group by category) group by 1 having sum(1 + (category < 'C')::int) > 1",
    "unique_keys": "select count(*) as n, min(doc_id) as first, max(doc_id) as last from documents",
    "first_source_text": "select standardized_title, count(*) as n, (list(source_text order by mention_id, extracted_at, source_text) filter (source_text is not null))[1] as source_text from skills_flat where standardized_title is not null group by 1",
    "first_category": "select skill_name, (list(category order by mention_id, extracted_at, category) filter (category is not null))[1] as category from skills_flat where skill_name is not null group by 1",
    "first_appearance": f"select skill, row_number() over (order by first, skill) - 1 as id from (select skill, min(mention_id) as first from {CLEAN} where length(skill) <= 7 group by skill)",
    "variant_overlap": """select title_id, array_to_string(list_sort(list_distinct(list_intersect(a, b))), '|') as both, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') as either
 from (select title_id, string_split(lower(canonical_title), ' ') as a, flatten(list_transform(alt_names, lambda x: string_split(lower(x), ' '))) as b from title_reference)""",
    "joined_categories": f"""select skill, array_to_string(c, ', ') as categories, array_to_string(list_filter(p, lambda x, i: x != '' and list_position(p, x) = i), ';') as pieces from
 (select *, list_append(string_split(replace(array_to_string(c, ', '), '/', '|'), '|'), 'end') as p from (select skill, list_sort(list(category)) as c from {AGG} group by skill))""",
    "job_urls": "select distinct posting_id, url, coalesce(regexp_matches(url, '-\\d{3,5}$'), false) as is_job from raw_jobs_itviec",
    "level_clean": f"""select source, case when source = 'topcv' and regexp_matches(lower(job_title), 'thực tập sinh|intern') or l = 'Thực tập sinh' then 'Intern' else l end as job_level, count(*) as n
 from (select *, coalesce({level('job_title')}, {level('level')}, {q(fields.DEFAULT_LEVEL)}) as l from {boards('posting_id, job_title, level')}) group by all""",
    "level_declared": f"""select distinct source, posting_id, job_title, coalesce({level('job_title')}, (list_filter(list_transform({DECLARED}, lambda d: {level('d')}), lambda v: v is not null))[1], {q(fields.DEFAULT_LEVEL)}) as job_level
 from (select *, lower(concat_ws(' ', case when posting_id % 3 = 0 then 'Report to the manager. Position: Senior person.' || chr(10) || coalesce(job_description, '') else job_description end, requirement)) as t from {boards('posting_id, job_title, job_description, requirement')})""",
    "json_strict": f"""select level, count(*) as n, sum(n)::bigint as skills from (select case when kind in (4, 5) then 'rejected' when kind = 2 and k = 0 then 'rejected' when not good then 'coerced' when kind in (0, 3) then 'direct' else 'repaired' end as level, case when kind < 4 then k else 0 end as n
 from (select kind, len(skills) as k, len(list_filter(skills, lambda s: s.skill_name is null or {strip('s.skill_name')} = '' or s.category is null)) = 0 as good from {LOG})) group by level""",
    "json_titles": "select title_id % 4 as batch_id, title_id::varchar as id, canonical_title as original, upper(canonical_title) as standardized_title, title_id % 5 != 0 as is_valid_job from title_reference",
    "json_years": "select distinct s.min_years as written, case when isfinite(try_cast(s.min_years as double)) then trunc(try_cast(s.min_years as double))::int end as cut, case when isfinite(try_cast(s.min_years as double)) then round_even(try_cast(s.min_years as double), 0)::int end as rounded from (select unnest(skills) as s from annotations_unified)",
    "html_brand": f"""select posting_id, {', '.join(f"nullif({tidy(c)}, '') as {c}" for c in ('job_title', 'company', 'experience', 'level'))}, coalesce(nullif({tidy('salary')}, ''), 'Not Found') as salary
 from (select posting_id, max(job_title) as job_title, max(company) as company, max(salary) as salary, max(experience) as experience, max(level) as level from raw_jobs_topcv group by posting_id)""",
    "html_sidebar": f"select posting_id, nullif({tidy('max(industry)')}, '') as industry, coalesce(nullif({tidy('max(level)')}, ''), 'again') as level from raw_jobs_topcv group by posting_id",
    "html_links": "select distinct standardized_title as tag, url as link from skills_flat where standardized_title != 'Tester' and url is not null",
    "alias_validate": f"select ord, canonical, array_to_string(list_sort(variants), '|') as variants from {VALID}",
    "p1_conversions": """select s.s || ' ' || c.unit || '/' || p.unit as unit, round(s.x * c.numer * p.numer / (c.denom * p.denom * 1000.0::double), 9) as factor, 0::bigint as add_numer from (values ('', 1), ('k', 1000), ('man', 10000), ('m', 1000000)) s(s, x),
 (select * from unit_factors where kind = 'currency') c, (select * from unit_factors where kind = 'period') p""",
    "sample_properties": """with t as (select standardized_title, count(distinct row_id) as n from skills_flat where standardized_title is not null group by 1), k as (select count(*) as titles, count(*) filter (n >= 10) as major from t)
 select least(50, titles) as calibration, least(50, titles) as titles, least(50, major) as major, least(50, titles) as of_table, least(50, p) as simple, least(50, p) as simple_of_table from k, (select count(distinct posting_id) as p from raw_jobs_itviec)""",
}
