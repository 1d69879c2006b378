"""Sampling, splitting and mixing queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import sampling as S
from kiln.plans.catalog import query
from kiln.plans.views import duck_strip, table

_RANK = """r as (select doc_id, source,
  row_number() over (order by md5('42|' || cast(doc_id as varchar)), doc_id) as rk,
  count(*) over () as n from documents)"""
_RANK_BY = """r as (select doc_id, source,
  row_number() over (partition by source order by md5('42|' || cast(doc_id as varchar)), doc_id) as rk,
  count(*) over (partition by source) as n from documents)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source")


def _split_sql(rt, rv, rank=_RANK):
    return f"""with {rank}
select doc_id, source, case when rk <= floor(n * {rt}::double) then 'train'
  when rk <= floor(n * {rt}::double) + floor(n * {rv}::double) then 'val' else 'test' end as split from r"""


@query("M01_split_exact", _split_sql(0.9, 0.05))
def m01(spark, sf):
    return S.split_exact(_docs(spark, sf), "doc_id", 0.9, 0.05, seed=42)


@query("M02_split_exact_80_10", _split_sql(0.8, 0.1))
def m02(spark, sf):
    return S.split_exact(_docs(spark, sf), "doc_id", 0.8, 0.1, seed=42)


@query("M03_subset_exact", f"""with {_RANK}
select doc_id, source from r where rk <= greatest(1, floor(n * 0.05::double))""")
def m03(spark, sf):
    return S.subset_exact(_docs(spark, sf), "doc_id", 0.05, seed=42)


@query("M04_subset_per_dataset", f"""with {_RANK_BY}
select doc_id, source from r where rk <= greatest(1, floor(n * 0.05::double))""")
def m04(spark, sf):
    return S.subset_per_dataset(_docs(spark, sf), "doc_id", "source", 0.05, seed=42)


_MERGE = f"""s as ({_split_sql(0.9, 0.05, _RANK_BY)}),
i as (select source, case when min(doc_id) % 4 = 0 then 'failed' else 'completed' end as status from documents group by source),
m as (select s.*, case when split = 'train' then '/data/' || source || '/images/' || doc_id || '.png' else './images/' || doc_id || '.png' end as url
      from s join i using (source) where status = 'completed' and split in ('train', 'val'))"""


def _merged(spark, sf):
    s = S.split_exact(_docs(spark, sf), "doc_id", 0.9, 0.05, seed=42, by=["source"])
    url = F.concat(F.lit("./images/"), F.col("doc_id").cast("string"), F.lit(".png"))
    records = s.withColumn("image_info", F.array(F.struct(url.alias("image_url"), F.lit(0).alias("matched_text_index"))))
    index = _docs(spark, sf).groupBy("source").agg(
        F.when(F.min("doc_id") % 4 == 0, "failed").otherwise("completed").alias("status"),
        F.concat(F.lit("/data/"), F.first("source")).alias("source_dir"))
    return S.merge_completed(records, index, "source")


@query("M05_merge_datasets", f"""with {_MERGE}
select doc_id, source, split, url from m""")
def m05(spark, sf):
    return _merged(spark, sf).select("doc_id", "source", "split", F.col("image_info")[0]["image_url"].alias("url"))


@query("M05_merge_counts", f"""with {_MERGE}
select source, count(*) filter (where split = 'train')::bigint as train_count, count(*) filter (where split = 'val')::bigint as val_count
from m group by source""")
def m05_counts(spark, sf):
    return S.merge_counts(_merged(spark, sf), "source")


_DSETS = "d as (select source as dataset, count(*) as n from documents group by source)"


def _datasets(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


@query("M06_equal_ratios", f"""with {_DSETS},
o as (select dataset, row_number() over (order by dataset) as i, count(*) over () as k from d)
select dataset, case when i < k then 1.0 / k
  else 1.0 - coalesce(list_reduce(list_transform(range(k - 1), lambda j: 1.0 / k), lambda a, b: a + b), 0.0) end as ratio
from o""")
def m06(spark, sf):
    v = S.dataset_vector(_datasets(spark, sf))
    z = F.arrays_zip(F.col("names").alias("dataset"), S.equal_ratios_col(F.size("names")).alias("ratio"))
    return v.select(F.explode(z).alias("z")).select("z.dataset", "z.ratio")


@query("M07_proportional_ratios", f"""with {_DSETS},
o as (select dataset, n, row_number() over (order by dataset) as i, count(*) over () as k,
             sum(n) over () as tot from d),
l as (select list(n::double / tot order by dataset) as p from o)
select dataset, case when i < k then n::double / tot
  else 1.0 - coalesce(list_reduce(list_slice(p, 1, k - 1), lambda a, b: a + b), 0.0) end as ratio
from o, l""")
def m07(spark, sf):
    v = S.dataset_vector(_datasets(spark, sf))
    z = F.arrays_zip(F.col("names").alias("dataset"), S.proportional_ratios_col(F.col("counts")).alias("ratio"))
    return v.select(F.explode(z).alias("z")).select("z.dataset", "z.ratio")


_EQ = """d as (select source as dataset from documents group by source),
v as (select list(dataset order by dataset) as names, count(*)::int as k from d),
e as (select names, k, list_transform(range(k), lambda j: case when j < k - 1 then 1.0 / k
        else 1.0 - coalesce(list_reduce(list_transform(range(k - 1), lambda q: 1.0 / k), lambda a, b: a + b), 0.0) end) as eq from v)"""


def _sweep_sql():
    rows = []
    for top, grid in ((2, S.SWEEP_TOP2), (3, S.SWEEP_TOP3)):
        for g in grid:
            rows.append(f"({top}, [{', '.join(repr(float(x)) for x in g)}]::double[])")
    return f"""with d as (select source as dataset from documents group by source),
v as (select list(dataset order by dataset) as names, count(*) as k from d),
g as (select * from (values {', '.join(rows)}) t(top, c)),
f as (select top, list_concat(c[1:len(c) - 1], [1.0 - list_reduce(c[1:len(c) - 1], lambda a, b: a + b)]) as c from g),
x as (select 'ratio-b3-top' || top || '-' || array_to_string(list_transform(c, lambda r: cast(floor(r * 100) as bigint)), '-') as id,
             'sweep_top' || top as kind, names[1:top] as nm, c from f, v where k >= top)
select id, kind, unnest(range(len(c))) as pos, unnest(nm) as dataset, unnest(c) as ratio from x"""


@query("M08_leave_one_out", f"""with {_EQ},
x as (select names, k, eq, unnest(range(k)) as i from e),
r as (select names, k, i, list_filter(eq, lambda val, idx: idx - 1 <> i) as rem from x),
t as (select *, list_reduce(rem, lambda a, b: a + b) as tot from r),
n as (select *, list_transform(rem, lambda val: val / tot) as ren0 from t),
f as (select *, list_concat(ren0[1:len(ren0) - 1],
        [1.0 - coalesce(case when len(ren0) > 1 then list_reduce(ren0[1:len(ren0) - 1], lambda a, b: a + b) end, 0.0)]) as ren from n),
fl as (select names, i, list_concat(ren[1:i], [0.0], ren[i + 1:]) as ratios from f)
select names[i + 1] as excluded, unnest(names) as dataset, unnest(ratios) as ratio from fl""")
def m08(spark, sf):
    v = S.dataset_vector(_datasets(spark, sf))
    loo = v.select("names", F.explode(S.leave_one_out_col(S.equal_ratios_col(F.size("names")))).alias("l"))
    return (loo.select(F.element_at("names", F.col("l.excluded_idx") + 1).alias("excluded"),
                       F.explode(F.arrays_zip(F.col("names").alias("dataset"), F.col("l.ratios").alias("ratio"))).alias("z"))
               .select("excluded", "z.dataset", "z.ratio"))


@query("M10_saturation", f"""with {_RANK},
f as (select unnest([0.25, 0.5, 0.75, 1.0]::double[]) as fraction)
select doc_id, source, fraction from r, f where rk <= floor(n * fraction)""")
def m10(spark, sf):
    return S.saturation(_docs(spark, sf), "doc_id")


@query("M11_mix_by_ratio", """with d as (select source, count(*) as n from documents group by source),
q0 as (select source, n, row_number() over (order by source) as i, count(*) over () as k,
              (select count(*) from documents) // 2 as total from d),
q1 as (select *, floor(total::double * (1.0 / k))::bigint as qq from q0),
q as (select source, n, case when i < k then qq
        else total - coalesce(sum(qq) over (order by source rows between unbounded preceding and 1 preceding), 0) end as quota from q1),
r as (select doc_id, source,
  row_number() over (partition by source order by md5('42|' || cast(doc_id as varchar)), doc_id) as rk from documents),
x as (select r.doc_id, r.source, r.rk, q.n, q.quota,
             unnest(range(0, greatest(ceil(q.quota / q.n), 1)::bigint)) as copy
      from r join q on r.source = q.source where q.quota > 0)
select doc_id, source, copy from x where rk + copy * n <= quota""")
def m11(spark, sf):
    docs = _docs(spark, sf)
    ratios = (S.dataset_vector(_datasets(spark, sf))
              .select(F.explode(F.arrays_zip(F.col("names").alias("source"),
                                              S.equal_ratios_col(F.size("names")).alias("ratio"))).alias("z"))
              .select("z.source", "z.ratio"))
    total = docs.agg(F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("total"))
    return S.mix_by_ratio(docs, "doc_id", "source", ratios, total, seed=42).select("doc_id", "source", "copy")


def _experiments_sql():
    sweep = (_sweep_sql().split("\nselect id, kind,")[0].replace("with d as", "d2 as", 1).replace("from d)", "from d2)")
             .replace("\nx as (select 'ratio-b3", "\nsx as (select 'ratio-b3"))
    return f"""with {_EQ},
x as (select names, k, eq, unnest(range(k)) as i from e),
r as (select names, k, i, list_filter(eq, lambda val, idx: idx - 1 <> i) as rem from x),
t as (select *, list_reduce(rem, lambda a, b: a + b) as tot from r),
n as (select *, list_transform(rem, lambda val: val / tot) as ren0 from t),
f0 as (select *, list_concat(ren0[1:len(ren0) - 1],
        [1.0 - coalesce(case when len(ren0) > 1 then list_reduce(ren0[1:len(ren0) - 1], lambda a, b: a + b) end, 0.0)]) as ren from n),
fl as (select names, i, list_concat(ren[1:i], [0.0], ren[i + 1:]) as ratios from f0),
loo as (select 'ratio-b2-no-' || names[i + 1] as id, list_filter(list_zip(names, ratios), lambda z: z[2] > 0) as z from fl),
{sweep.replace("v as (", "v2 as (").replace("from f, v where", "from f, v2 where").replace("from d2)", "from d2)")}
select 'ratio-b1-baseline' as id, 'baseline' as kind, unnest(range(k)) as pos, unnest(names) as dataset, unnest(eq) as ratio from e
union all select id, 'leave_one_out', unnest(range(len(z))), unnest(list_transform(z, lambda q: q[1])), unnest(list_transform(z, lambda q: q[2])) from loo
union all select id, kind, unnest(range(len(c))), unnest(nm), unnest(c) from sx"""


@query("M12_ratio_experiments", _experiments_sql())
def m12(spark, sf):
    return S.ratio_experiments(_datasets(spark, sf))


@query("M13_head_subset", f"""select line_no, line from (select doc_id as line_no, text as line from documents)
where line_no <= 100 and {duck_strip('line')} <> ''""")
def m13(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("line"))
    return S.head_subset(lines, 100)


@query("M09_ratio_sweep", _sweep_sql())
def m09(spark, sf):
    return S.ratio_experiments(_datasets(spark, sf)).where(F.col("kind").startswith("sweep"))
