"""Templates, layers, rescored rankings, sweeps and tables of figures, each by the library's own function."""

from __future__ import annotations

from math import cos, radians, sin

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import figures, linalg
from ..operators import overlay as O
from ..operators import ranking as R
from ..operators import recovery as V
from ..operators.ordering import cut, top_per_group
from ..operators.runs import reference_patch
from ..operators.compare import has_any
from ..operators.windows import Shape, circle_mask, circle_template, no_nan, resample, template, windows
from ..sources import grids, sinks
from .adapters import CELLS, DAYS, EVENT_CELLS, HOURS, VECTORS, event_cells, event_windows, pca, query, rounded, table, vectors
from .geometry import NEXT, SPOTS, polygons, spots
from .matrices import EV1
from .overlays import FULL, RARE, all_windows, full, rare
from .adapters import FOOTPRINTS, footprints
from .recoveries import COVER, RANKED, TOP, ranked


def as_rows(spark, patch: np.ndarray):
    """(row, col, v) of a small patch."""
    rows = [(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(patch)]
    return spark.createDataFrame(rows, "row int, col int, v double")


@query(f"with {EVENT_CELLS} select r - 6 as row, c - 9 as col, v1 as v, (power(r - 6 + 0.5 - 2.5, 2) + power(c - 9 + 0.5 - 2.5, 2) <= 6.25 + 1e-9) as inside from cells where r between 6 and 10 and c between 9 and 13")
def template_extract(spark, sf_dir):
    """A rectangular template and its circle mask."""
    patch = template(event_cells(spark, sf_dir), "v1", 6, 11, 9, 14)
    inside = as_rows(spark, circle_mask(5, 5, 2.5).astype(float)).select("row", "col", (F.col("v") > 0).alias("inside"))
    return as_rows(spark, patch).join(inside, ["row", "col"])


ANGLE, SCALE = 30.0, 0.8


@query(f"""with {EVENT_CELLS}, o as (select i.range as row, j.range as col, (i.range - 2) / {SCALE} as dy, (j.range - 3) / {SCALE} as dx from range(0, 5) i, range(0, 7) j),
    p as (select row, col, 12 + dy * {cos(radians(ANGLE))!r} + dx * {sin(radians(ANGLE))!r} as y, 11 - dy * {sin(radians(ANGLE))!r} + dx * {cos(radians(ANGLE))!r} as x from o),
    q as (select row, col, y - floor(y) as fy, x - floor(x) as fx, v1, r - floor(y) as dr, c - floor(x) as dc from p join cells on r - floor(y) in (0, 1) and c - floor(x) in (0, 1))
    select row::int as row, col::int as col, round(sum(v1 * (case when dr = 1 then fy else 1 - fy end) * (case when dc = 1 then fx else 1 - fx end)), 6) + 0.0 as v from q group by 1, 2""")
def template_turned(spark, sf_dir):
    """A 5 x 7 template at (10, 8), turned by 30 degrees and shrunk, read between cell centres."""
    m = 9  # the longer side, enlarged by the scale: only the patch and this margin leave the executors
    patch = template(event_cells(spark, sf_dir), "v1", 10 - m, 15 + m, 8 - m, 15 + m)
    return rounded(as_rows(spark, resample(patch, m, m, 5, 7, ANGLE, SCALE)), "v")


@query(f"with {EVENT_CELLS} select r - 7 as row, c - 14 as col, v2 as v from cells where r between 7 and 9 and c between 14 and 17")
def reference_from_footprint(spark, sf_dir):
    """The 3 x 4 patch about the bounds of a footprint that has two parts."""
    parts = spark.createDataFrame([(14.2, 15.0, 8.1, 9.0), (15.5, 17.9, 7.3, 8.0)], "x0 double, x1 double, y0 double, y1 double")
    patch = reference_patch(event_cells(spark, sf_dir), "v2", parts.select(G.box_rings("x0", "x1", "y0", "y1").alias("rings")), CELLS, 3, 4)
    return as_rows(spark, patch)


@query("""with g as (select event_type as var, (day(ts) - 1)::int as r, hour(ts)::int as c, count(*)::double as v from events group by 1, 2, 3)
    select r, c, max(case when var = 'view' then v end) as "view", max(case when var = 'error' then v end) as error, max(case when var = 'signup' then v end) as signup from g where var in ('view', 'error', 'signup') group by 1, 2""")
def stacked_grids(spark, sf_dir):
    """Grids of three variables side by side; cells of any are kept."""
    e = table(spark, sf_dir, "events")
    grid = lambda k: e.where(F.col("event_type") == k).groupBy((F.dayofmonth("ts") - 1).alias("r"), F.hour("ts").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return grids.stack({k: grid(k) for k in ("view", "error", "signup")})


@query(f"with {EVENT_CELLS} select r, c, case when v1 <> 2 then v1 end as v1, case when v2 <> 2 then v2 end as v2 from cells")
def valid_cells(spark, sf_dir):
    """Cells whose value is the one for no data become null."""
    return no_nan(event_cells(spark, sf_dir), ["v1", "v2"], 2.0)


TRIANGLE = [(2.25, 3.5), (20.75, 8.25), (9.5, 27.75)]


@query(f"""with {EVENT_CELLS}, t(x, y, x2, y2) as (values {", ".join(f"({a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(TRIANGLE, [*TRIANGLE[1:], TRIANGLE[0]]))})
    select r, c, any_value(v1) as v1 from cells, t group by 1, 2 having sum(case when (y > r + 0.5) <> (y2 > r + 0.5) and c + 0.5 < x + (r + 0.5 - y) * (x2 - x) / (y2 - y) then 1 else 0 end) % 2 = 1""")
def crop_to_polygon(spark, sf_dir):
    """Cells whose centres lie in a polygon."""
    return grids.crop_polygon(event_cells(spark, sf_dir), CELLS, [TRIANGLE]).select("r", "c", "v1")


@query(f"with {EVENT_CELLS} select r - 4 as r, c - 6 as c, v1, v2 from cells where r between 4 and 13 and c between 6 and 17")
def crop_to_box(spark, sf_dir):
    """Rows and columns numbered from the crop's own corner."""
    return grids.crop_box(event_cells(spark, sf_dir), 4, 14, 6, 18)


@query(f"""with {EVENT_CELLS}, win as (select (i.range * 11 + k.range)::bigint as window_id, r - i.range * 3 as dr, c - k.range * 2 as dc, v1, v2 from range(0, 9) i, range(0, 10) k, cells where r between i.range * 3 and i.range * 3 + 4 and c between k.range * 2 and k.range * 2 + 4 and power(r - i.range * 3 - 2, 2) + power(c - k.range * 2 - 2, 2) <= 4)
    select window_id, (row_number() over (partition by window_id order by dr, dc) - 1)::int as j, v1, v2 from win qualify count(*) over (partition by window_id) = 13""")
def window_matrix_multi_circle(spark, sf_dir):
    """Two variables in circular windows."""
    w = windows(event_cells(spark, sf_dir), Shape(DAYS, HOURS, 5, 5, 3, 2), ["v1", "v2"], circle_mask(5, 5, 2.0))
    return w.select("window_id", F.posexplode(F.arrays_zip("v1", "v2")).alias("j", "v")).select("window_id", "j", "v.v1", "v.v2")


@query("select l_orderkey as id, l_linenumber as line, least(greatest(floor(l_extendedprice / 500 - 20)::int, 0), 99) as row, least(greatest(ceil(l_quantity * 0.7 - 3)::int, 0), 24) as col from lineitem")
def clamped_cells(spark, sf_dir):
    """Cells of points, held within the grid: rows rounded down, columns up."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") * 0.7 - 3).alias("x"), (F.col("l_extendedprice") / 500 - 20).alias("y"))
    t = G.Affine(e=1.0)
    return p.select("id", "line", G.clamp(G.cell_of(t, "x", "y")[0], 99).alias("row"), G.clamp(G.cell_of(t, "x", "y", "ceil")[1], 24).alias("col"))


@query(f"with {RANKED} select rank, 'POLYGON ((' || c0 || '.0 ' || r0 || '.0, ' || c0 || '.0 ' || (r0 + 3) || '.0, ' || (c0 + 4) || '.0 ' || (r0 + 3) || '.0, ' || (c0 + 4) || '.0 ' || r0 || '.0, ' || c0 || '.0 ' || r0 || '.0))' as wkt from ranked")
def windows_as_wkt(spark, sf_dir):
    """Ranked windows as polygons of a layer."""
    boxed = G.with_box(ranked(spark, sf_dir), CELLS, 3, 4).select("rank", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")])
    return sinks.windows_layer(boxed).select("rank", sinks.wkt().alias("wkt"))


POOL = "pool as (select window_id from ranked join cells on r = r0 + 1 and c = c0 + 2 where v2 < 2)"
AGAIN = f""",
    {POOL}, again as (select window_id, r0, c0, row_number() over (order by rank) as rank from ranked join pool using (window_id)),
    acells as (select rank, r0 + a.range as r, c0 + b.range as c from again, range(0, 3) a, range(0, 4) b),
    afirst as (select dep_id, dc.r, dc.c, min(area) as area, min(rank) as rank from dep_cells dc join acells rc on dc.r = rc.r and dc.c = rc.c group by 1, 2, 3),
    again_gain as (select dep_id, rank, sum(area) as gain from afirst group by 1, 2), aper as (select rank, sum(gain / dep_area) as share from again_gain join dep_area using (dep_id) group by 1)"""


@query(f"with {RANKED}{AGAIN} select rank, round(sum(coalesce(share, 0)) over (order by rank) / (select count(*) from dep_area), 6) as mean_fraction from ranks left join aper using (rank)")
def recovery_in_pool(spark, sf_dir):
    """Recovery by the windows of a restricted pool alone, numbered anew."""
    r = ranked(spark, sf_dir)
    quiet = O.sample_at_center(r, event_cells(spark, sf_dir), 3, 4, DAYS, HOURS, "v2").where("v2 < 2")
    again = cut(V.reranked(r, quiet, TOP))
    cells = V.box_cells(footprints(spark), CELLS)
    return rounded(V.curve(cut(V.gains(again, cells, 3, 4)), V.areas(cells), TOP).select("rank", "mean_fraction"), "mean_fraction")


SECOND = [(1, 8.5, 12.25, 14.0, 17.5), (2, 3.0, 6.0, 22.0, 25.0), (3, 19.25, 22.0, 16.5, 20.0)]


@query("with " + RANKED.replace(FOOTPRINTS.split(" as (values ")[1].split("),\n")[0], ", ".join(f"({d}, {a}::double, {b}::double, {c}::double, {e}::double)" for d, a, b, c, e in SECOND)) + " select rank, round(total_fraction, 6) as total_fraction, round(mean_fraction, 6) as mean_fraction from curve")
def recovery_of_second_set(spark, sf_dir):
    """The same ranking scored against other footprints."""
    cells = V.box_cells(spark.createDataFrame(SECOND, "dep_id int, x0 double, x1 double, y0 double, y1 double"), CELLS)
    curve = V.curve(cut(V.gains(ranked(spark, sf_dir), cells, 3, 4)), V.areas(cells), TOP)
    return rounded(curve.select("rank", "total_fraction", "mean_fraction"), "total_fraction", "mean_fraction")


SWEEP_KS = [1, 2, 4, 8]


@query(f"""with recursive {EV1}, {pca(12)}, {FOOTPRINTS}, run as (select window_id, pc, sum(rz * rz * power(s - rz, 2)) over (partition by window_id order by pc) as num, sum(rz * rz) over (partition by window_id order by pc) as den from sc join rs using (pc) where not is_ref),
    placed as (select pc as k, window_id, row_number() over (partition by pc order by round(sqrt(num / den), 9), window_id) as rank, (window_id // 8 * 2)::int as r0, (window_id % 8 * 3)::int as c0 from run where pc in (1, 2, 4, 8) qualify rank <= {TOP}),
    kc as (select k, rank, r0 + a.range as r, c0 + b.range as c from placed, range(0, 3) a, range(0, 4) b),
    kf as (select k, dep_id, dc.r, dc.c, min(area) as area, min(rank) as rank from dep_cells dc join kc on dc.r = kc.r and dc.c = kc.c group by 1, 2, 3, 4),
    kg as (select k, dep_id, rank, sum(area) as gain from kf group by 1, 2, 3), kv as (select k, dep_id, rank, gain, sum(gain) over (partition by k, dep_id order by rank) / dep_area as fraction from kg join dep_area using (dep_id)),
    kh as (select k, dep_id, min(rank) as hit from kv where fraction >= {COVER} - 1e-9 group by 1, 2)
    select s.k::int as k, round(end_fraction, 6) as end_fraction, coalesce(n_hits, 0) as n_hits from (select k, sum(gain / dep_area) / (select count(*) from dep_area) as end_fraction from kg join dep_area using (dep_id) group by 1) s left join (select k, count(*) as n_hits from kh group by 1) h on s.k = h.k""")
def recovery_by_k(spark, sf_dir):
    """End of the recovery curve and hits for several numbers of components, from one fit."""
    first = top_per_group(R.sweep_k(event_windows(spark, sf_dir), SWEEP_KS, "v1"), ["k"], TOP, [F.round("dist", 9), "window_id"])
    r = first.select("k", "rank", (F.floor(F.col("window_id") / 8) * 2).cast("int").alias("r0"), (F.col("window_id") % 8 * 3).cast("int").alias("c0"))
    return rounded(V.by_k(r, cut(V.box_cells(footprints(spark), CELLS)), 3, 4, TOP, COVER).select("k", "end_fraction", "n_hits"), "end_fraction")


@query(f"with {FULL}, n as (select window_id, k, count(*) as n from win join full_ on r between r0 and r0 + 5 and c between c0 and c0 + 4 group by 1, 2), p as (select *, row_number() over (partition by window_id order by n desc, k) as place, sum(n) over (partition by window_id) as total from n) select window_id, max(case when place = 1 then k end) as mode, round(max(case when place = 1 then n / total end), 6) as share, string_agg(k || ':' || n, ';' order by place) as tally from p group by 1")
def classes_under_windows(spark, sf_dir):
    """The classes of a thematic map under every window."""
    under = V.window_cells(all_windows(spark, sf_dir), 6, 5, "window_id").join(full(spark, sf_dir).select("r", "c", "k"), ["r", "c"])
    return rounded(O.tally(under, ["window_id"], "k"), "share")


@query(f"with recursive {VECTORS}, {pca(3)}, s as (select window_id, is_ref, max(s) filter (where pc = 1) as s1, max(s) filter (where pc = 2) as s2, max(s) filter (where pc = 3) as s3 from sc group by 1, 2) select window_id, a as pc_a, b as pc_b, round(case a when 1 then s1 else s2 end, 6) + 0.0 as z_a, round(case b when 2 then s2 else s3 end, 6) + 0.0 as z_b, window_id between 0 and 4 as is_top, is_ref from s, (values (1, 2), (2, 3)) p(a, b)")
def score_pairs(spark, sf_dir):
    """Scores on pairs of components, with the top windows marked."""
    v = vectors(spark, sf_dir)
    return rounded(figures.score_pairs(v, linalg.fit(v), [(1, 2), (2, 3)], spark.range(5).withColumnRenamed("id", "window_id")), "z_a", "z_b")


@query(f"""with recursive {RARE}, k as (select r, c, (r * 24 + c)::bigint as n from m where v), e as (select a.n as a, b.n as b from k a join k b on abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1),
    g as (select a as node, b as other from e union select g.node, e.b from g join e on g.other = e.a), f as (select r, c, min(other) as grp from g join k on n = node group by 1, 2),
    s as (select grp, count(*) * 4.0 as area, avg(r) as row, avg(c) as col from f group by 1), n as (select grp, case when r % 2 = 0 then 'even' else 'odd' end as kk, count(*) as n from f group by 1, 2),
    p as (select *, row_number() over (partition by grp order by n desc, kk) as place, sum(n) over (partition by grp) as total from n)
    select s.grp as "group", area::double as area, round(row, 6) as row, round(col, 6) as col, max(case when place = 1 then kk end) as mode, round(max(case when place = 1 then n / total end), 6) as share, string_agg(kk || ':' || n, ';' order by place) as tally, max(case when place = 1 then kk end) = 'even' as host from s join p on s.grp = p.grp group by 1, 2, 3, 4""")
def group_attributes(spark, sf_dir):
    """Area, centroid and classes of groups of marked cells."""
    g = O.cell_groups(rare(spark, sf_dir).where("v").select("r", "c"), HOURS)
    k = event_cells(spark, sf_dir).select("r", "c", F.when(F.col("r") % 2 == 0, "even").otherwise("odd").alias("k"))
    return rounded(O.group_attributes(g, k, 4.0, hosts=["even"]), "area", "row", "col", "share")


@query(f"with {FULL}, three as (select *, c < 25 as w from full_), p(a, b, both_, either_) as (select 'v', 'u', sum((v and u)::int), sum((v or u)::int) from three union all select 'v', 'w', sum((v and w)::int), sum((v or w)::int) from three union all select 'u', 'w', sum((u and w)::int), sum((u or w)::int) from three) select a, b, both_::bigint as both, either_::bigint as either, round(both_ / either_, 6) as iou from p")
def map_iou_of_three(spark, sf_dir):
    """Agreement of every pair of three layers."""
    layers = full(spark, sf_dir).withColumn("w", F.col("c") < 25)
    out = None
    for a, b in (("v", "u"), ("v", "w"), ("u", "w")):
        one = O.agreement(layers.select("r", "c", F.col(a).alias("x")), layers.select("r", "c", F.col(b).alias("x")), "x").select(F.lit(a).alias("a"), F.lit(b).alias("b"), "both", "either", "iou")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "iou")


@query("with s as (select s_suppkey as fid, (s_suppkey % 17)::double as ax, (s_suppkey % 23)::double as ay, s_suppkey % 17 + s_acctbal / 700 as bx, s_suppkey % 23 + 2.5 as b_y from supplier), n as (select *, greatest(1, ceil(sqrt(power(bx - ax, 2) + power(b_y - ay, 2)) / 2.0))::int as n from s) select distinct fid, round(ax + (bx - ax) * k / n, 6) + 0.0 as x, round(ay + (b_y - ay) * k / n, 6) + 0.0 as y from (select *, unnest(range(0, n + 1)) as k from n)")
def densified_lines(spark, sf_dir):
    """Points along a line for every supplier, no further apart than two units."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select(k.alias("fid"), F.array(F.array(p(k % 17, k % 23), p(k % 17 + F.col("s_acctbal") / 700, k % 23 + 2.5))).alias("rings"))
    return rounded(grids.densify(lines, 2.0), "x", "y").distinct()


@query("with a as (select (l_quantity - 1)::int as c, (l_linenumber - 1)::int as r, count(*)::double as n from lineitem group by 1, 2) select r * 2 as y0, c as x0, n as total from a")
def grid_on_map(spark, sf_dir):
    """Cells of a grid with two units a row, by the corner they have on the map."""
    t = G.Affine(a=1.0, e=2.0)
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("int").alias("r0"), (F.col("l_quantity") - 1).cast("int").alias("c0")).agg(F.count(F.lit(1)).cast("double").alias("total"))
    return G.with_box(cells, t, 1, 1).select(F.col("y0").cast("int").alias("y0"), F.col("x0").cast("int").alias("x0"), "total")




@query(f"with {NEXT}, {SPOTS}, hit as (select distinct pid from (select id, pid from nx, q group by 1, 2 having sum(case when (y > py) <> (y2 > py) and px < x + (py - y) * (x2 - x) / (y2 - y) then 1 else 0 end) % 2 = 1)) select pid, px as x, py as y from q where pid not in (select pid from hit)")
def points_outside(spark, sf_dir):
    """Points that lie in no polygon."""
    return G.outside(spots(spark, sf_dir), polygons(spark, sf_dir).withColumnRenamed("id", "fid"), 4.0)


@query("select p_partkey as id, p_type in ('SMALL', 'PROMO') as listed, contains(lower(p_name), 'ring') as named, trim(replace(p_name, 'small', ''), ', ') <> '' as present from part")
def features_by_attribute(spark, sf_dir):
    """Membership, substring and presence of attributes."""
    p = table(spark, sf_dir, "part")
    present = F.trim(F.replace(F.col("p_name"), F.lit("small"), F.lit("")), F.lit(", ")) != ""
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").isin("SMALL", "PROMO").alias("listed"), has_any(F.col("p_name"), ["ring"]).alias("named"), present.alias("present"))


@query(f"with {RANKED} select window_id, rank from ranked where window_id <> 18 order by rank limit 12")
def highlighted_windows(spark, sf_dir):
    """The first windows of a picture, a top-k report, without the reference's own."""
    return figures.highlights(ranked(spark, sf_dir), 12, 18)


@query(f"with {RANKED} select r.window_id, rank, label from ranked r join (values (0, 'a'), (9, 'b'), (18, 'c'), (41, 'd'), (100, 'e')) k(window_id, label) on r.window_id = k.window_id")
def known_windows(spark, sf_dir):
    """Known windows and their ranks."""
    known = spark.createDataFrame([(0, "a"), (9, "b"), (18, "c"), (41, "d"), (100, "e")], "window_id long, label string")
    return ranked(spark, sf_dir).select("window_id", "rank").join(known, "window_id")


@query(f"with {RANKED} select rank, round(mean_fraction, 6) as mean_fraction from curve where rank <= 15")
def curve_cut(spark, sf_dir):
    """A recovery curve's first ranks."""
    cells = V.box_cells(footprints(spark), CELLS)
    curve = V.curve(cut(V.gains(ranked(spark, sf_dir), cells, 3, 4)), V.areas(cells), TOP)
    return rounded(V.up_to(curve, 15).select("rank", "mean_fraction"), "mean_fraction")


@query(f"""with {RANKED} select 'r' as axis, x::int as "at" from (select r0 as x from ranked union select r0 + 3 from ranked) union all select 'c', x::int from (select c0 as x from ranked union select c0 + 4 from ranked)""")
def window_breakpoints(spark, sf_dir):
    """Rows and columns at which windows begin or end."""
    return V.breakpoints(ranked(spark, sf_dir), 3, 4)


@query("with g as (select (l_quantity - 1)::int as c, (l_linenumber - 1)::int as r, l_returnflag as unit, count(*) as n from lineitem group by 1, 2, 3) select r, c, case when unit = 'A' then 'old' else 'young' end as era, bool_or(n % 3 = 0) as v from g group by 1, 2, 3")
def era_masks(spark, sf_dir):
    """Masks of units as one mask of each era."""
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("int").alias("r"), (F.col("l_quantity") - 1).cast("int").alias("c"), F.col("l_returnflag").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return O.union_masks(g.select("r", "c", F.when(F.col("unit") == "A", "old").otherwise("young").alias("era"), (F.col("n") % 3 == 0).alias("v")), "era")


@query(f"with {EVENT_CELLS}, p as (select r, c, v1, power(c + 0.5 - 11.3, 2) + power(r + 0.5 - 13.8, 2) <= 2.6 * 2.6 as inside from cells where r between 10 and 16 and c between 8 and 14) select (r - 10)::int as row, (c - 8)::int as col, v1 as v, inside from p")
def circle_template_cells(spark, sf_dir):
    """A patch about a point of the map, and which of its cells lie in the circle."""
    patch, mask, _ = circle_template(event_cells(spark, sf_dir), "v1", CELLS, 11.3, 13.8, 2.6)
    inside = as_rows(spark, mask.astype(float)).select("row", "col", (F.col("v") > 0).alias("inside"))
    return as_rows(spark, patch).join(inside, ["row", "col"])
