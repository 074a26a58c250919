"""Templates, figures' tables, groups' attributes and restricted pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import figures, linalg
from ..operators import overlay as O
from ..operators.compare import with_best_k
from ..sources.grids import first_of_each
from .adapters import CELLS, DAYS, EVENT_CELLS, HOURS, MONTHS, QUANTITIES, VECTORS, event_cells, pca, query, rounded, table, vectors
from .overlays import FULL, RARE, all_windows, full, rare
from .recoveries import RANKED, ranked


@query(f"with {FULL} select window_id, k from win join full_ on r = least(r0 + 3, 83) and c = least(c0 + 2, 49) where k in ('A', 'N')")
def restricted_pool(spark, sf_dir):
    return O.restricted(all_windows(spark, sf_dir), full(spark, sf_dir), 6, 5, MONTHS, QUANTITIES, ["A", "N"]).select("window_id", "k")


@query(f"with {RANKED} select rank from ranked where abs(r0 - 4) < 3 and abs(c0 - 6) < 4")
def reference_overlap_ranks(spark, sf_dir):
    return O.overlapping_reference(ranked(spark, sf_dir), 4, 6, 3, 4)


@query(f"with {RANKED} select distinct r::int as r, c::int as c from rcells")
def top_union_mask(spark, sf_dir):
    from ..operators.recovery import window_cells

    return window_cells(ranked(spark, sf_dir), 3, 4).distinct()


@query(f"with {RARE}, g as (select distinct a.r, a.c from every_cell a join m b on b.v and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1), o as (select r, c from every_cell except select r, c from g), s as (select distinct a.r, a.c from every_cell a join o on abs(a.r - o.r) <= 1 and abs(a.c - o.c) <= 1) select r, c from every_cell except select r, c from s")
def closed_mask(spark, sf_dir):
    return O.closed(rare(spark, sf_dir).where("v"), 1, DAYS, HOURS)


@query("with b as (select s_suppkey as fid, (s_suppkey % 20)::double as x0, s_suppkey % 20 + 2.7 as x1, (s_suppkey % 27)::double as y0, s_suppkey % 27 + 1.6 as y1 from supplier) select r.range::int as r, c.range::int as c, max(fid) as fid from b, range(0, 30) r, range(0, 24) c where c.range + 0.5 > x0 and c.range + 0.5 < x1 and r.range + 0.5 > y0 and r.range + 0.5 < y1 group by 1, 2")
def burned_polygons(spark, sf_dir):
    """Boxes as polygons, burned by cell centre; the last one wins."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), (F.col("s_suppkey") % 20).cast("double").alias("x0"), (F.col("s_suppkey") % 20 + 2.7).alias("x1"), (F.col("s_suppkey") % 27).cast("double").alias("y0"), (F.col("s_suppkey") % 27 + 1.6).alias("y1"))
    return O.burn(b.select("fid", G.box_rings("x0", "x1", "y0", "y1").alias("rings")), CELLS, DAYS, HOURS, "fid")


@query("select distinct floor(l_discount * 200)::int as r, floor(l_quantity / 3)::int as c from lineitem")
def touched_cells(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 3).alias("x"), (F.col("l_discount") * 200).alias("y"))
    return O.burn_touched(p, CELLS)


@query(f"with {EVENT_CELLS} select -ceil(quantile_cont(abs(v1), 0.98) / 2) * 2 as low, ceil(quantile_cont(abs(v1), 0.98) / 2) * 2 as high from cells")
def display_limits(spark, sf_dir):
    return figures.display_limits(event_cells(spark, sf_dir), "v1", step=2.0)


@query(f"with {EVENT_CELLS} select r, c, v1 from cells where r % 4 = 0 and c % 4 = 0")
def decimated_grid(spark, sf_dir):
    return figures.decimated(event_cells(spark, sf_dir), 4).select("r", "c", "v1")


@query(f"with {VECTORS} select window_id, (j // 8)::int as row, (j % 8)::int as col, round(v, 6) + 0.0 as v from alls where window_id in (0, 20, 40)")
def window_chips(spark, sf_dir):
    ids = spark.createDataFrame([(0,), (20,), (40,)], "window_id long")
    return rounded(figures.chips(vectors(spark, sf_dir), ids, 8), "v")


LEAD = "lead as (select pc, rz from rs order by round(abs(rz), 9) desc, pc limit 1)"


@query(f"with recursive {VECTORS}, {pca(64)}, {LEAD} select window_id, pc::int as pc, round(s, 6) + 0.0 as score, round(lead.rz - sqrt(val), 6) + 0.0 as low, round(lead.rz + sqrt(val), 6) + 0.0 as high from sc join lead using (pc) where not is_ref")
def score_map(spark, sf_dir):
    """Scores on the component on which the reference stands out most, and the limits of the picture."""
    v = vectors(spark, sf_dir)
    out, limits = figures.score_map(v, linalg.fit(v))
    return rounded(out.select("window_id", F.lit(limits["pc"]).alias("pc"), "score", F.lit(limits["low"]).alias("low"), F.lit(limits["high"]).alias("high")), "score", "low", "high")


@query(f"with recursive {VECTORS}, {pca(64)} select pc::int as pc, (j // 8)::int as row, (j % 8)::int as col, round(load, 5) + 0.0 as loading, round(load * load, 5) as energy from ld")
def loading_energy(spark, sf_dir):
    """Loadings and their squares by component and place."""
    t = figures.loadings(spark, linalg.fit(vectors(spark, sf_dir)), 8)
    return rounded(t.withColumn("energy", F.col("loading") * F.col("loading")), "loading", "energy", digits=5)


@query("select c_nationkey as dep_id, c_custkey as id, coalesce(k, 8)::int as k from customer left join (select c_nationkey as n, (count(*) % 9)::int as k from customer group by 1 having count(*) % 9 > 0) on n = c_nationkey")
def best_k_lookup(spark, sf_dir):
    """A setting looked up by footprint, with a default for footprints that have none."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("dep_id"), F.col("c_custkey").alias("id"))
    best = c.groupBy("dep_id").agg((F.count(F.lit(1)) % 9).cast("int").alias("k")).where("k > 0")
    return with_best_k(c, best, 8)


@query("select user_id, event_type, ts, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def distinct_features(spark, sf_dir):
    """The first of repeated features."""
    return first_of_each(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])
