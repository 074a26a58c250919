"""Similarity rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators.linalg import fit
from ..operators.ordering import number, top, top_per_group
from .adapters import EVENT_WINDOWS, VECTORS, event_windows, pca, query, rounded, table, vectors

REF = "ref as (select j, v as rv from alls where is_ref)"
EV1 = EVENT_WINDOWS.replace("alls as (", "alls0 as (") + ", alls as (select window_id, is_ref, j, v1 as v from alls0)"
STD = "st as (select j, avg(v) as m, coalesce(nullif(stddev_samp(v), 0), 1) as sd from alls group by 1)"
RAW_STD = f"{REF}, {STD}, d as (select window_id, sum(power((v - rv) / sd, 2)) as d2 from alls join ref using (j) join st using (j) where not is_ref group by 1)"


@query(f"with {VECTORS}, {RAW_STD} select window_id, round(sqrt(d2), 6) as dist from d")
def rank_raw_std(spark, sf_dir):
    return rounded(R.rank_raw(vectors(spark, sf_dir)), "dist")


@query(f"with {VECTORS}, {REF} select window_id, round(sqrt(sum(power(v - rv, 2))), 6) as dist from alls join ref using (j) where not is_ref group by 1")
def rank_raw(spark, sf_dir):
    return rounded(R.rank_raw(vectors(spark, sf_dir), standardize=False), "dist")


@query(f"with {VECTORS}, mm as (select window_id, avg(v) as m from alls group by 1), dm as (select window_id, is_ref, j, v - m as v from alls join mm using (window_id)), ref as (select j, v as rv from dm where is_ref) select window_id, round(sqrt(sum(power(v - rv, 2))), 6) as dist from dm join ref using (j) where not is_ref group by 1")
def rank_demeaned(spark, sf_dir):
    return rounded(R.rank_demeaned(vectors(spark, sf_dir)), "dist")


NCC = "mm as (select window_id, avg(v) as m from alls group by 1), dm as (select window_id, is_ref, j, v - m as v from alls join mm using (window_id)), ref as (select j, v as rv from dm where is_ref)"


@query(f"with {VECTORS}, {NCC} select window_id, round(sum(v * rv) / (sqrt(sum(v * v)) * sqrt(sum(rv * rv))), 6) + 0.0 as similarity from dm join ref using (j) where not is_ref group by 1")
def rank_ncc(spark, sf_dir):
    return rounded(R.rank_correlation(vectors(spark, sf_dir)), "similarity")


@query(f"""with {EVENT_WINDOWS}, mm as (select window_id, avg(v1) as m1, avg(v2) as m2 from alls group by 1), dm as (select window_id, is_ref, j, v1 - m1 as v1, v2 - m2 as v2 from alls join mm using (window_id)), ref as (select j, v1 as r1, v2 as r2 from dm where is_ref),
    s as (select window_id, case when sqrt(sum(v1 * v1)) * sqrt(sum(r1 * r1)) > 1e-12 then sum(v1 * r1) / (sqrt(sum(v1 * v1)) * sqrt(sum(r1 * r1))) else 0 end as s1, case when sqrt(sum(v2 * v2)) * sqrt(sum(r2 * r2)) > 1e-12 then sum(v2 * r2) / (sqrt(sum(v2 * v2)) * sqrt(sum(r2 * r2))) else 0 end as s2 from dm join ref using (j) where not is_ref group by 1)
    select window_id, round(0.3 * s1 + (1 - 0.3) * s2, 6) + 0.0 as similarity from s""")
def rank_mix_correlation(spark, sf_dir):
    return rounded(R.rank_mix(event_windows(spark, sf_dir), "v1", "v2", 0.3), "similarity")


@query(f"""with {EVENT_WINDOWS}, mm as (select window_id, avg(v1) as m1, avg(v2) as m2 from alls group by 1), dm as (select window_id, is_ref, j, v1 - m1 as v1, v2 - m2 as v2 from alls join mm using (window_id)), ref as (select j, v1 as r1, v2 as r2 from dm where is_ref),
    d as (select window_id, sqrt(sum(power(v1 - r1, 2))) as d1, sqrt(sum(power(v2 - r2, 2))) as d2 from dm join ref using (j) where not is_ref group by 1), s as (select stddev_pop(d1) as s1, stddev_pop(d2) as s2 from d)
    select window_id, round(0.6 * d1 / s1 + (1 - 0.6) * d2 / s2, 6) as dist from d, s""")
def rank_mix_distance(spark, sf_dir):
    return rounded(R.rank_mix(event_windows(spark, sf_dir), "v1", "v2", 0.6, "distance"), "dist")


@query(f"with {VECTORS}, {RAW_STD} select window_id, round(sqrt(d2), 6) as dist from d")
def rank_full_unweighted(spark, sf_dir):
    """All components without weights are a rotation: the plain standardised distance."""
    return rounded(R.rank_components(vectors(spark, sf_dir), mode="uniform"), "dist")


def weighted(weight: str, scale: str = "1", where: str = "true", k: int = 8) -> str:
    """SQL of the distances in k components with weights from wt (pc, w), given as a select list over rs and ld."""
    return f"wt as ({weight}), d as (select window_id, sqrt(sum(w * power((s - rz) / ({scale}), 2))) as dist from sc join rs using (pc) join wt using (pc) where not is_ref and pc <= {k} and {where} group by 1)"


SQUARE = "select pc, rz * rz / sum(rz * rz) over () as w from rs where pc <= 8"


@query(f"with recursive {VECTORS}, {pca(8)}, {weighted(SQUARE)} select window_id, round(dist, 6) as dist, row_number() over (order by round(dist, 9), window_id) as rank from d qualify rank <= 100")
def rank_pca_k(spark, sf_dir):
    """The 100 patches nearest to patch 0 in eight weighted components, a top-k report."""
    return rounded(top(R.rank_components(vectors(spark, sf_dir), k=8), 100, [F.round("dist", 9), "window_id"]), "dist")


@query(f"with recursive {VECTORS}, {pca(8)}, {weighted(SQUARE, 'sqrt(val)')} select window_id, round(dist, 6) as dist from d")
def rank_pca_whitened(spark, sf_dir):
    return rounded(R.rank_components(vectors(spark, sf_dir), k=8, whiten=True), "dist")


@query(f"with recursive {VECTORS}, {pca(64)}, {weighted('select pc, abs(rz) / sum(abs(rz)) over () as w from rs')} select window_id, round(dist, 6) as dist from d")
def rank_pca_abs(spark, sf_dir):
    """Eight components, weights over all."""
    return rounded(R.rank_components(vectors(spark, sf_dir), k=8, mode="abs", over="all"), "dist")


RULES = """rules as (select 'whitened' as rule, pc, (rz * rz / val) / sum(rz * rz / val) over () as w from rs join (select distinct pc, val from ld) using (pc)
    union all select 'inverse', pc, 1 / val from (select distinct pc, val from ld) union all select 'uniform', pc, 1 from (select distinct pc from ld))"""


@query(f"with recursive {VECTORS}, {pca(8)}, {RULES} select window_id, rule, round(sqrt(sum(w * power(s - rz, 2))), 6) as dist from sc join rs using (pc) join rules using (pc) where not is_ref group by 1, 2")
def rank_weight_rules(spark, sf_dir):
    """Ablation of the weights: whitened scores', inverse eigenvalues, none."""
    v, out = vectors(spark, sf_dir), None
    for name, o in (("whitened", {"rule": "whitened"}), ("inverse", {"rule": "inverse"}), ("uniform", {"mode": "uniform"})):
        part = R.rank_components(v, k=8, **o).withColumn("rule", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "dist")


EACH = "".join(f""",
    one{n} as (select window_id, is_ref, j, v{n} as v from alls), {pca(4, str(n), f"one{n}")},
    d{n} as (select window_id, is_ref, sum(rz * rz * power(s - rz, 2)) / sum(rz * rz) as d{n} from sc{n} join rs{n} using (pc) group by 1, 2)""" for n in (1, 2))
BLOCKS = EACH + ",\n    dd as (select d1.window_id, d1.is_ref, d1, d2 from d1 join d2 on d1.window_id = d2.window_id and d1.is_ref = d2.is_ref)"
MEDIANS = "m as (select case when median(d1) > 1e-12 then median(d1) else 1 end as m1, case when median(d2) > 1e-12 then median(d2) else 1 end as m2 from dd)"
#: Both variables' first four scores as one vector of eight.
SIDE = EACH + ",\n    side as (select window_id, is_ref, pc - 1 as j, s as v from sc1 union all select window_id, is_ref, pc + 3, s from sc2)"
KS = [4, 4]


@query(f"with recursive {EVENT_WINDOWS}{BLOCKS}, {MEDIANS} select window_id, round(sqrt(0.5 * d1 / m1 + 0.5 * d2 / m2), 6) as dist from dd, m where not is_ref")
def fusion_sum(spark, sf_dir):
    return rounded(R.fuse("late_sum", event_windows(spark, sf_dir), ["v1", "v2"], KS), "dist")


@query(f"with recursive {EVENT_WINDOWS}{BLOCKS}, {MEDIANS} select window_id, round(sqrt(greatest(d1 / m1, d2 / m2)), 6) as dist from dd, m where not is_ref")
def fusion_max(spark, sf_dir):
    return rounded(R.fuse("late_max", event_windows(spark, sf_dir), ["v1", "v2"], KS), "dist")


@query(f"with recursive {EVENT_WINDOWS}{BLOCKS} select window_id, round(sqrt(0.503 * d1 + (1 - 0.503) * d2), 6) as dist from dd where not is_ref")
def fusion_concat_alpha(spark, sf_dir):
    return rounded(R.fuse("concat_alpha", event_windows(spark, sf_dir), ["v1", "v2"], KS, 0.503), "dist")


@query(f"with recursive {EVENT_WINDOWS}{BLOCKS} select window_id, alpha, round(sqrt(alpha * d1 + (1 - alpha) * d2), 6) as dist from dd, (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as alpha) where not is_ref")
def alpha_sweep(spark, sf_dir):
    d = R.squared_by_variable(event_windows(spark, sf_dir), ["v1", "v2"], KS)
    return rounded(R.sweep_alpha(d, [0.0, 0.25, 0.5, 0.75, 1.0]), "dist")


@query(f"""with recursive {EVENT_WINDOWS}{SIDE}, ss as (select j, avg(v) as m, stddev_samp(v) as s from side group by 1), zz as (select window_id, is_ref, j, (v - m) / s as z from side join ss using (j)), rr as (select j, z as rz from zz where is_ref)
    select window_id, round(sqrt(sum(rz * rz * power(z - rz, 2)) / sum(rz * rz)), 6) as dist from zz join rr using (j) where not is_ref group by 1""")
def fusion_concat_standardized(spark, sf_dir):
    return rounded(R.fuse("concat_standardized", event_windows(spark, sf_dir), ["v1", "v2"], KS), "dist")


@query(f"with recursive {EVENT_WINDOWS}{SIDE}, {pca(5, '', 'side')}, {weighted('select pc, rz * rz / sum(rz * rz) over () as w from rs')} select window_id, round(dist, 6) as dist from d")
def fusion_two_stage(spark, sf_dir):
    """Components of both variables' scores."""
    return rounded(R.fuse("two_stage", event_windows(spark, sf_dir), ["v1", "v2"], KS, 5), "dist")


JOINT = EVENT_WINDOWS + ", both_ as (select window_id, is_ref, j, v1 as v from alls union all select window_id, is_ref, j + 12, v2 from alls)"


@query(f"with recursive {JOINT}, {pca(6, '', 'both_')}, {weighted('select pc, rz * rz / sum(rz * rz) over () as w from rs')} select window_id, round(dist, 6) as dist from d")
def fusion_joint(spark, sf_dir):
    """Components of both variables' features."""
    return rounded(R.fuse("joint", event_windows(spark, sf_dir), ["v1", "v2"], 6), "dist")


@query(f"""with recursive {VECTORS}, {pca(64)}, run as (select window_id, pc, sum(rz * rz * power(s - rz, 2)) over (partition by window_id order by pc) as num, sum(rz * rz) over (partition by window_id order by pc) as den from sc join rs using (pc) where not is_ref)
    select window_id, pc::int as k, round(sqrt(num / den), 6) as dist from run where pc in (1, 2, 4, 8, 16, 32, 64)""")
def k_sweep(spark, sf_dir):
    return rounded(R.sweep_k(vectors(spark, sf_dir), [1, 2, 4, 8, 16, 32, 64]), "dist")


@query(f"with {VECTORS}, {RAW_STD} select window_id, round(sqrt(d2), 6) as dist, row_number() over (order by round(sqrt(d2), 9), window_id) as rank from d qualify rank <= 50")
def topk_windows(spark, sf_dir):
    """A top-k report."""
    return rounded(top(R.rank_raw(vectors(spark, sf_dir)), 50, [F.round("dist", 9), "window_id"]), "dist")


@query(f"with {VECTORS}, {RAW_STD} select window_id, row_number() over (order by round(sqrt(d2), 9), window_id) as rank from d")
def full_ranking(spark, sf_dir):
    """Every window's rank, numbered over ranged partitions."""
    return number(R.rank_raw(vectors(spark, sf_dir)), [], [F.round("dist", 9), "window_id"], "rank").select("window_id", "rank")


@query(f"with {VECTORS}, {RAW_STD}, l as (select window_id, label, row_number() over (partition by label order by round(sqrt(d2), 9), window_id) as rank from d join embeddings on vec_id = window_id) select label, window_id, rank from l where rank <= 5")
def topk_per_group(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("window_id"), "label")
    return top_per_group(R.rank_raw(vectors(spark, sf_dir)).join(labels, "window_id"), ["label"], 5, [F.round("dist", 9), "window_id"]).select("label", "window_id", "rank")


AGREE = f"""with {VECTORS}, {RAW_STD}, {NCC.replace("ref as (", "nref as (")}, a as (select window_id, row_number() over (order by round(sqrt(d2), 9), window_id) as ra from d),
    s as (select window_id, sum(v * rv) / (sqrt(sum(v * v)) * sqrt(sum(rv * rv))) as s from dm join nref using (j) where not is_ref group by 1), b as (select window_id, row_number() over (order by round(-s, 9), window_id) as rb from s), x as (select * from a join b using (window_id))
    select count(*) as n, coalesce(min(case when ra <> rb then least(ra, rb) end) - 1, max(ra)) as prefix, sum(case when ra <= 20 and rb <= 20 then 1 else 0 end)::bigint as overlap_20, sum(case when ra <= 50 and rb <= 50 then 1 else 0 end)::bigint as overlap_50, sum(case when ra <= 100 and rb <= 100 then 1 else 0 end)::bigint as overlap_100, sum(case when ra <= 250 and rb <= 250 then 1 else 0 end)::bigint as overlap_250,
    round(avg(rb), 6) as mean_rank, round(median(rb), 6) as median_rank, max(rb) as max_rank, round(avg(1.0 / rb), 6) as mrr, round(avg(abs(ra - rb)), 6) as rank_mae from x"""


@query(AGREE)
def rank_agreement(spark, sf_dir):
    v = vectors(spark, sf_dir)
    a = number(R.rank_raw(v), [], [F.round("dist", 9), "window_id"], "rank")
    b = number(R.rank_correlation(v), [], [F.round(-F.col("similarity"), 9), "window_id"], "rank")
    return rounded(R.agreement(a, b), "mean_rank", "median_rank", "mrr", "rank_mae")


@query(f"with recursive {VECTORS}, {pca(64)} select pc::int as pc, round(rz * rz, 6) as z_square, round(rz * rz / sum(rz * rz) over (), 6) as weight, round(val / sum(val) over (), 6) as ratio, row_number() over (order by round(rz * rz, 9) desc, pc) as place from rs join (select distinct pc, val from ld) using (pc)")
def weights_table(spark, sf_dir):
    """The reference's squared scores and weights by component, numbered by falling weight."""
    v = vectors(spark, sf_dir)
    m, (ref,) = fit(v), R.reference(v, "x")
    z = m.scores(ref)
    w = R.weights(z, len(z))
    rows = [(k + 1, float(a * a), float(b), float(r)) for k, (a, b, r) in enumerate(zip(z, w, m.ratio))]
    table_ = number(spark.createDataFrame(rows, "pc int, z_square double, weight double, ratio double"), [], [-F.round("z_square", 9), "pc"], "place")
    return rounded(table_, "z_square", "weight", "ratio")


SWAPPED = (0, 5, 17)


def swapped(ref: int) -> str:
    """SQL of the nearest patches with another patch as the reference: names end in its number."""
    source = f"""
    rows{ref} as (select vec_id as window_id, false as is_ref, embedding from embeddings union all select -1, true, embedding from embeddings where vec_id = {ref}),
    alls{ref} as (select window_id, is_ref, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as j from rows{ref}),"""
    tail = "".join(f""",
    n{ref}k{k} as (select {ref} as ref, {k} as k, window_id, dist, row_number() over (order by round(dist, 9), window_id) as rank from (select window_id, sqrt(sum(w * (s - rz) ** 2)) as dist
        from sc{ref} join rs{ref} using (pc) join (select pc, rz * rz / sum(rz * rz) over () as w from rs{ref} where pc <= {k}) using (pc) where not is_ref group by 1) qualify rank <= 20)""" for k in (3, 6))
    return source + pca(6, str(ref), f"alls{ref}") + tail


@query(f"with recursive {','.join(swapped(r) for r in SWAPPED)} select ref, k, window_id, rank, round(dist, 6) as dist from ({' union all '.join(f'select * from n{r}k{k}' for r in SWAPPED for k in (3, 6))})")
def swapped_references(spark, sf_dir):
    """The 20 nearest patches to each of three references, with three and six components, from one scan."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("window_id"), F.col("embedding").cast("array<double>").alias("x"))
    chosen = {r.window_id: r.x for r in rows.where(F.col("window_id").isin(*SWAPPED)).collect()}
    got = R.rank_references(rows, {r: chosen[r] for r in SWAPPED}, [3, 6])
    return rounded(top_per_group(got, ["ref", "k"], 20, [F.round("dist", 9), "window_id"]), "dist")
