"""SQL that computes principal components of a long matrix, to check the queries with."""

from __future__ import annotations

SQUARINGS = 30  # the matrix is raised to the power 2^30, which leaves the leading component


def component_sql(components: int, cells: str = "expr") -> str:
    """CTEs over ``cells``: e1, e2, ... hold (v, l), a unit vector over the features in order of
    id with a positive largest loading, and its share of the variance in percent; ``pz`` holds
    each sample's z-scored log2 values in the same order. Needs ``with recursive``."""
    parts = [f"""plog as (select sample_id, feature_id, log2(value + 1) as x from {cells}),
pst as (select feature_id, avg(x) as mu, coalesce(nullif(stddev_pop(x), 0), 1) as sd from plog group by 1),
pzl as (select sample_id, feature_id, (x - mu) / sd as z from plog join pst using (feature_id)),
pz as (select sample_id, list(z order by feature_id) as z from pzl group by 1),
pcc as (select a.feature_id as i, b.feature_id as j, avg(a.z * b.z) as c from pzl a join pzl b
  on a.sample_id = b.sample_id group by 1, 2),
c1 as (select list(r order by i) as m from (select i, list(c order by j) as r from pcc group by 1)),
ptr as (select sum(c) as total from pcc where i = j)"""]
    for k in range(1, components + 1):
        parts.append(f"""q{k} as (select 0 as i, m from c{k}
  union all select i + 1, list_transform(w, lambda r: list_transform(r, lambda x: x / t)) from (
    select i, w, list_sum(list_transform(range(1, len(w) + 1), lambda a: w[a][a])) as t from (
      select i, list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s))) as w
      from q{k} where i < {SQUARINGS}))),
g{k} as (select m[list_position(d, list_max(d))] as r from (
  select m, list_transform(range(1, len(m) + 1), lambda a: m[a][a]) as d from q{k} where i = {SQUARINGS})),
u{k} as (select list_transform(r, lambda x: x / n) as v from (select r, sqrt(list_dot_product(r, r)) as n from g{k})),
w{k} as (select v, sign(v[list_position(h, list_max(h))]) as s from (
  select v, list_transform(v, lambda x: round(abs(x), 9)) as h from u{k})),
f{k} as (select list_transform(v, lambda x: x * s) as v,
  list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) as l from w{k}, c{k}),
e{k} as (select v, 100 * l / total as l from f{k}, ptr),
c{k + 1} as (select list_transform(range(1, len(m) + 1), lambda a:
  list_transform(range(1, len(m) + 1), lambda b: m[a][b] - l * v[a] * v[b])) as m from c{k}, f{k})""")
    return ",\n".join(parts)
