"""Recovery of footprints by ranked windows, and the random expectation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recovery as V
from ..operators.joins import interpolate, overlapping
from ..operators.ordering import cut, top
from ..operators.overlay import clear_of
from ..operators.ranking import rank_raw
from ..operators.windows import windows
from .adapters import CELLS, EVENT_WINDOWS, EVENTS, FOOTPRINTS, event_cells, event_windows, footprints, query, rounded, table

TOP, COVER = 40, 0.5
RANKED = EVENT_WINDOWS + f""",
    ref as (select j, v1 as rv from alls where is_ref), st as (select j, coalesce(nullif(stddev_samp(v1), 0), 1) as sd from alls group by 1),
    d as (select window_id, sqrt(sum(power((v1 - rv) / sd, 2))) as dist from alls join ref using (j) join st using (j) where not is_ref group by 1),
    ranked as (select window_id, row_number() over (order by round(dist, 9), window_id) as rank, (window_id // 8 * 2)::int as r0, (window_id % 8 * 3)::int as c0 from d qualify rank <= {TOP}),
    {FOOTPRINTS},
    rcells as (select rank, r0 + a.range as r, c0 + b.range as c from ranked, range(0, 3) a, range(0, 4) b),
    firsts as (select dep_id, dc.r, dc.c, min(area) as area, min(rank) as rank from dep_cells dc join rcells rc on dc.r = rc.r and dc.c = rc.c group by 1, 2, 3),
    gain as (select dep_id, rank, sum(area) as gain from firsts group by 1, 2),
    cov as (select dep_id, rank, sum(gain) over (partition by dep_id order by rank) as covered, sum(gain) over (partition by dep_id order by rank) / dep_area as fraction from gain join dep_area using (dep_id)),
    hits as (select dep_id, min(rank) as first_hit from cov where fraction >= {COVER} - 1e-9 group by 1),
    ranks as (select range as rank from range(1, {TOP} + 1)),
    per_rank as (select rank, sum(gain) as gain, sum(gain / dep_area) as share from gain join dep_area using (dep_id) group by 1),
    curve as (select rank, sum(coalesce(gain, 0)) over (order by rank) as recovered_area, sum(coalesce(gain, 0)) over (order by rank) / (select sum(dep_area) from dep_area) as total_fraction, sum(coalesce(share, 0)) over (order by rank) / (select count(*) from dep_area) as mean_fraction from ranks left join per_rank using (rank))"""


def ranked(spark, sf_dir):
    """The first windows by plain standardised distance of one variable."""
    w = event_windows(spark, sf_dir)
    first = top(rank_raw(w, "v1"), TOP, [F.round("dist", 9), "window_id"])
    return cut(first.select("window_id", "rank", (F.floor(F.col("window_id") / 8) * 2).cast("int").alias("r0"), (F.col("window_id") % 8 * 3).cast("int").alias("c0")))


def parts(spark, sf_dir):
    cells = V.box_cells(footprints(spark), CELLS)
    r = ranked(spark, sf_dir)
    g, a = cut(V.gains(r, cells, 3, 4)), V.areas(cells)
    return r, cells, g, a, V.coverage(g, a)


@query(f"with {RANKED} select window_id, rank, r0, c0 from ranked")
def ranked_windows(spark, sf_dir):
    return ranked(spark, sf_dir)


@query(f"with {EVENT_WINDOWS}, {FOOTPRINTS} select dep_id, r, c, round(area, 6) as area, v1 from dep_cells join cells using (r, c)")
def footprint_cells(spark, sf_dir):
    """The cells of each footprint, how much of them it covers, and the grid's value there."""
    return rounded(V.box_cells(footprints(spark), CELLS).join(event_cells(spark, sf_dir).select("r", "c", "v1"), ["r", "c"]), "area")


@query(f"with {RANKED} select rank, round(recovered_area, 6) as recovered_area, round(total_fraction, 6) as total_fraction, round(mean_fraction, 6) as mean_fraction from curve")
def recovery_curve(spark, sf_dir):
    _, _, g, a, _ = parts(spark, sf_dir)
    return rounded(V.curve(g, a, TOP), "recovered_area", "total_fraction", "mean_fraction")


@query(f"with {RANKED} select dep_id, rank, round(covered, 6) as covered, round(fraction, 6) as fraction from cov")
def footprint_coverage(spark, sf_dir):
    return rounded(parts(spark, sf_dir)[4], "covered", "fraction")


@query(f"with {RANKED} select dep_id, first_hit from hits")
def first_hit_rank(spark, sf_dir):
    return V.first_hits(parts(spark, sf_dir)[4], COVER)


@query(f"with {RANKED}, h as (select first_hit as rank, count(*) as hits, string_agg(dep_id::varchar, ',' order by dep_id::varchar) as deps from hits group by 1) select rank, hits, sum(hits) over (order by rank)::bigint as cumulative_hits, deps from h")
def hit_table(spark, sf_dir):
    return V.hit_table(parts(spark, sf_dir)[4], COVER)


@query(f"with {RANKED}, t as (select distinct rc.rank, dep_id from rcells rc join dep_cells dc on dc.r = rc.r and dc.c = rc.c) select t.rank, t.dep_id, case when h.first_hit is null then 'overlap' else 'hit' end as kind from t left join hits h on h.dep_id = t.dep_id and h.first_hit = t.rank")
def overlap_events(spark, sf_dir):
    r, cells, _, _, cov = parts(spark, sf_dir)
    return V.events(r, cells, cov, 3, 4, COVER)


@query(f"with {RANKED}, p as (select *, lead(total_fraction) over (order by rank) as nxt from curve) select round(sum((total_fraction + nxt) / 2) / {TOP - 1}, 6) as auc_unit, round(sum((total_fraction + nxt) / 2), 6) as auc_ranks, round(sum(mean_fraction) * 250.0 / {TOP}, 6) as auc_sum from p")
def auc_three_ways(spark, sf_dir):
    _, _, g, a, _ = parts(spark, sf_dir)
    return rounded(V.aucs(V.curve(g, a, TOP)), "auc_unit", "auc_ranks", "auc_sum")


@query(f"""with {RANKED}, p as (select *, lead(total_fraction) over (order by rank) as nxt from curve), e as (select round(sum((total_fraction + nxt) / 2) / {TOP - 1}, 6) as auc, round(arg_max(mean_fraction, rank), 6) as end_fraction, round(max(mean_fraction) filter (where rank <= 10), 6) as recovery_at_10, round(max(mean_fraction) filter (where rank <= 25), 6) as recovery_at_25 from p)
    select auc, end_fraction, recovery_at_10, recovery_at_25, count(*) as n_hits, count(distinct first_hit) as n_hit_ranks, min(first_hit) as first_hit, round(avg(first_hit), 6) as mean_hit, round(sum(1.0 / first_hit), 6) as sum_inverse_rank from e, hits group by all""")
def summary_row(spark, sf_dir):
    _, _, g, a, cov = parts(spark, sf_dir)
    one = F.lit("events").alias("run")
    s = V.summary(V.curve(g, a, TOP).select("*", one), V.first_hits(cov, COVER).select("*", one), ["run"], (10, 25)).drop("run")
    return rounded(s, "auc", "end_fraction", "recovery_at_10", "recovery_at_25", "mean_hit", "sum_inverse_rank")


@query(f"with {RANKED}, f as (select r, c, min(rank) as rank from rcells group by 1, 2), n as (select rank, count(*) as n from f group by 1) select rank, sum(coalesce(n, 0)) over (order by rank)::double as union_area from ranks left join n using (rank)")
def union_area_curve(spark, sf_dir):
    return V.union_area(ranked(spark, sf_dir), 3, 4, TOP)


COUNTED = RANKED + """,
    starts as (select distinct window_id, (window_id // 8 * 2)::int as r0, (window_id % 8 * 3)::int as c0 from w), nn as (select count(*) as n from starts),
    cover as (select e.r, e.c, count(s.r0) as m from every_cell e left join starts s on e.r between s.r0 and s.r0 + 2 and e.c between s.c0 and s.c0 + 3 group by 1, 2),
    wsum as (select m, sum(area / dep_area) / (select count(*) from dep_area) as weight from dep_cells join dep_area using (dep_id) join cover using (r, c) group by 1),
    q as (select mm.m, j.range + 1 as rank, case when min(n - mm.m - j.range) over w <= 0 then 0.0 else exp(sum(case when n - mm.m - j.range > 0 then ln((n - mm.m - j.range)::double / (n - j.range)) else 0 end) over w) end as q from (select distinct m from cover) mm, range(0, 40) j, nn window w as (partition by mm.m order by j.range)),
    expected as (select rank, sum((1 - q) * weight) as expected from q join wsum using (m) group by 1),
    earea as (select rank, sum((1 - q) * cells) as expected_area from q join (select m, count(*) as cells from cover group by 1) using (m) group by 1)"""


def counted(spark, sf_dir):
    w = cut(windows(event_cells(spark, sf_dir), EVENTS, ["v1"]).select("window_id", "r0", "c0"))
    cells = V.box_cells(footprints(spark), CELLS)
    grid = event_cells(spark, sf_dir).select("r", "c")
    return V.cover_counts(cells, w, 3, 4, 2, 3), V.cover_counts(grid, w, 3, 4, 2, 3), w.count()


@query(f"with {COUNTED} select m, count(*) as cells from cover group by 1")
def cover_histogram(spark, sf_dir):
    return counted(spark, sf_dir)[1].groupBy("m").agg(F.count(F.lit(1)).alias("cells"))


@query(f"with {COUNTED} select rank, round(expected, 6) as expected from expected")
def null_expected_curve(spark, sf_dir):
    deps, _, n = counted(spark, sf_dir)
    return rounded(V.null_curve(deps, n, TOP), "expected")


@query(f"with {COUNTED} select rank, round(expected_area, 6) as expected_area from earea")
def null_expected_union(spark, sf_dir):
    _, grid, n = counted(spark, sf_dir)
    return rounded(V.null_union(grid, n, TOP), "expected_area")


MATCHED = COUNTED + """,
    f as (select r, c, min(rank) as rank from rcells group by 1, 2), n as (select rank, count(*) as n from f group by 1), ua as (select rank, sum(coalesce(n, 0)) over (order by rank)::double as union_area from ranks left join n using (rank)),
    seg as (select rank::double as ta, expected_area as a, lead(rank) over (order by rank)::double as tb, lead(expected_area) over (order by rank) as b from earea),
    mt as (select u.rank, u.union_area, case when u.union_area <= (select min(expected_area) from earea) then (select min(rank) from earea)::double when u.union_area >= (select max(expected_area) from earea) then (select max(rank) from earea)::double else (select max(ta + (u.union_area - a) / (b - a) * (tb - ta)) from seg where a <= u.union_area and u.union_area < b) end as matched_t from ua u),
    es as (select rank::double as ta, expected as a, lead(expected) over (order by rank) as b from expected),
    mm2 as (select rank, union_area, matched_t, (select max(a + coalesce((matched_t - ta) * (b - a), 0)) from es where ta <= matched_t and matched_t < ta + 1) as expected_at_area from mt)"""


@query(f"with {MATCHED} select rank, round(mean_fraction, 6) as mean_fraction, union_area, round(matched_t, 5) as matched_t, round(expected_at_area, 6) as expected_at_area, round(mean_fraction / expected_at_area, 5) as ratio from curve join mm2 using (rank)")
def equal_area_ratio(spark, sf_dir):
    r, _, g, a, _ = parts(spark, sf_dir)
    deps, grid, n = counted(spark, sf_dir)
    out = V.equal_area(V.curve(g, a, TOP), V.union_area(r, 3, 4, TOP), V.null_curve(deps, n, TOP), V.null_union(grid, n, TOP))
    return rounded(rounded(out, "mean_fraction", "expected_at_area"), "matched_t", "ratio", digits=5)


@query(f"with {RANKED}, t as (select distinct rank from rcells rc join dep_cells dc on dc.r = rc.r and dc.c = rc.c) select window_id, rank from ranked where rank not in (select rank from t)")
def windows_clear_of_footprints(spark, sf_dir):
    r = ranked(spark, sf_dir)
    return clear_of(r, V.box_cells(footprints(spark), CELLS), 3, 4).select("window_id", "rank")


@query(f"with {RANKED} select rank, dep_id, round((least(x1, c0 + 4) - greatest(x0, c0)) * (least(y1, r0 + 3) - greatest(y0, r0)), 6) as shared from ranked, boxes where x0 < c0 + 4 and x1 > c0 and y0 < r0 + 3 and y1 > r0")
def window_footprint_overlap(spark, sf_dir):
    """A range join by tiles."""
    w = ranked(spark, sf_dir).select("rank", F.col("c0").cast("double").alias("x0"), (F.col("c0") + 4.0).alias("x1"), F.col("r0").cast("double").alias("y0"), (F.col("r0") + 3.0).alias("y1"))
    both = overlapping(w, footprints(spark), 5.0)
    return rounded(both.select(F.col("a_rank").alias("rank"), F.col("b_dep_id").alias("dep_id"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("shared")), "shared")


@query("""with p as (select l_quantity::bigint as x, sum(round(l_tax * 100)::bigint)::double as y from lineitem where l_quantity::bigint % 3 = 1 group by 1), q as (select s_suppkey as i, s_suppkey * 1.7 % 60 - 5 as pos from supplier),
    s as (select x, y, lead(x) over (order by x) as nx, lead(y) over (order by x) as ny from p), e as (select min(x) as x0, max(x) as x1, arg_min(y, x) as y0, arg_max(y, x) as y1 from p)
    select i, round(case when pos <= x0 then y0 when pos >= x1 then y1 else (select max(y + (pos - x) / (nx - x) * (ny - y)) from s where x <= pos and pos < nx) end, 6) as v from q, e""")
def interpolation_join(spark, sf_dir):
    """Linear look-up on a curve of sums by quantity, constant beyond the ends."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("x"), F.round(F.col("l_tax") * 100).cast("long").alias("t"))
    p = lines.where(F.col("x") % 3 == 1).groupBy("x").agg(F.sum("t").cast("double").alias("y"))
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") * 1.7 % 60 - 5).cast("double").alias("at"))
    return rounded(interpolate(q, p, "at", "x", "y", "v").select("i", "v"), "v")
