"""SQL that finds the pN_found rows by comparing everything, where the tables are small enough for that."""

from __future__ import annotations


def _words(x: str) -> str:
    """The words of a text; composed form stands for the compatible one, which differs on no text of the tables."""
    return rf"regexp_extract_all(lower(nfc_normalize({x})), '[\p{{L}}\p{{N}}]+')"


P1_FOUND = f"""
with t as (
    select 'candidates' as collection, example_id as id, array_to_string(assistant_response.method, ' ') as x from candidates
    union select 'packets', blind_id, candidate_response from packets where candidate_response is not null
),
w as (select collection, id, {_words('x')} as w from t),
d as (select *, len(w) as n, row_number() over () as k from w where len(w) >= 50),
b as (select k, u.word as word, count(*) as c from d, unnest(w) as u(word) group by 1, 2),
s as (select a.k as i, b.k as j, cast(sum(least(a.c, b.c)) as bigint) as s from b a join b on a.word = b.word and a.k < b.k group by 1, 2),
p as (select x.collection, x.id as a, y.id as b from s join d x on x.k = i join d y on y.k = j where x.collection = y.collection and x.id != y.id and s >= 0.7 * (x.n + y.n - s) - 1e-9)
select distinct collection, least(a, b) as id_a, greatest(a, b) as id_b from p
"""

P3_FOUND = f"""
with t as (select distinct example_id as id, user_prompt as x from candidates where lower(trim(split)) = 'train' and user_prompt is not null),
e as (
    select distinct 'validation' as f, example_id as id, user_prompt as x from candidates where lower(trim(split)) = 'validation' and user_prompt is not null
    union select 'existing_prompt', case_id, existing_prompt from contamination_calibration where existing_prompt is not null
    union select 'candidate_prompt', case_id, candidate_prompt from contamination_calibration where candidate_prompt is not null
),
tw as (select id, {_words('x')} as w, row_number() over () as k from t),
ew as (select f, id, {_words('x')} as w, row_number() over () as k from e),
tb as (select k, u.word as word, count(*) as c from tw, unnest(w) as u(word) group by 1, 2),
eb as (select k, u.word as word, count(*) as c from ew, unnest(w) as u(word) group by 1, 2),
s as (select a.k as i, b.k as j, cast(sum(least(a.c, b.c)) as bigint) as s from eb a join tb b using (word) group by 1, 2)
select distinct f as eval_field, ew.id as eval_id, tw.id as train_example_id
from s join ew on ew.k = i join tw on tw.k = j where s >= 0.75 * (len(ew.w) + len(tw.w) - s) - 1e-9
"""

P3_REPORT = f"""
with t as (select distinct example_id as id, user_prompt as x from candidates where lower(trim(split)) = 'train' and user_prompt is not null),
r as (
    select distinct 'validation' as f, example_id as id, user_prompt as x, provenance.authoring_batch_id as source from candidates where lower(trim(split)) = 'validation'
    union select 'existing_prompt', case_id, existing_prompt, case_type from contamination_calibration
    union select 'candidate_prompt', case_id, candidate_prompt, case_type from contamination_calibration
),
e as (select distinct f, id, x from r where x is not null),
tw as (select id, {_words('x')} as w, row_number() over () as k from t),
ew as (select f, id, {_words('x')} as w, row_number() over () as k from e),
tb as (select k, u.word as word, count(*) as c from tw, unnest(w) as u(word) group by 1, 2),
eb as (select k, u.word as word, count(*) as c from ew, unnest(w) as u(word) group by 1, 2),
s as (select a.k as i, b.k as j, cast(sum(least(a.c, b.c)) as bigint) as s from eb a join tb b using (word) group by 1, 2),
m as (select f, ew.id as id, tw.id as train, max(s / len(ew.w)) as covered from s join ew on ew.k = i join tw on tw.k = j where s >= 0.75 * (len(ew.w) + len(tw.w) - s) - 1e-9 group by 1, 2, 3),
p as (select f, id, count(*) as pairs, max(covered) as most from m group by 1, 2),
a as (select distinct f, id, source from r where id is not null)
select f as field, source, count(*) as records, count(pairs) as overlapping, cast(coalesce(sum(pairs), 0) as bigint) as pairs, round(avg(most), 6) as coverage from a left join p using (f, id) group by 1, 2
"""

P4_FOUND = r"""
with recursive m as (
    select distinct slot_id, example_id, case when r[1] = 'scenario' then r[2:] else r end as r
    from (select slot_id, example_id, regexp_extract_all(lower(scenario_id), '[\p{L}\p{N}]+') as r from production_matrix) where slot_id is not null
),
l as (
    select slot_id, 'e' || example_id as x from m where example_id is not null
    union select slot_id, 's' || array_to_string(r, '-') from m where len(r) > 0
),
n as (select distinct a.slot_id as u, b.slot_id as v from l a join l b using (x)),
c as (select u, v from n union select c.u, n.v from c join n on c.v = n.u),
g as (select u as slot_id, min(v) as root, count(*) as size from c group by 1),
k as (select root, min(array_to_string(r, '-')) filter (where len(r) > 0) as scenario from g join m using (slot_id) group by 1)
select slot_id, 'scenario-' || scenario as scenario_key from g join k using (root) where size > 1
"""
