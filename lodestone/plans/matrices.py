"""Grids, windows, templates and column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import center_of, with_box
from ..operators import linalg
from ..operators.windows import Shape, circle_mask, window_ids, windows, windows_sql
from .adapters import CELLS, EVENTS, EVENT_CELLS, EVENT_WINDOWS, HOURS, LINES, LINE_CELLS, VECTORS, event_cells, event_windows, line_cells, pca, query, rounded, table, vectors


@query("select (day(ts) - 1)::int as r, hour(ts)::int as c, event_type as var, count(*) as n, round(sum(value), 2) as total from events group by 1, 2, 3")
def grid_from_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.dayofmonth("ts") - 1).alias("r"), F.hour("ts").alias("c"), F.col("event_type").alias("var")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"with {LINE_CELLS} select r, c, n, tax, k from lines")
def grid_from_lineitem(spark, sf_dir):
    return line_cells(spark, sf_dir)


@query(f"with {EVENT_CELLS} select r, c, v1 + v2 as v from cells where r between 5 and 14 and c between 3 and 20 and v1 > 0")
def grid_crop(spark, sf_dir):
    """Crop and validity filter, as ranges on the cells."""
    return event_cells(spark, sf_dir).where((F.col("r") >= 5) & (F.col("r") < 15) & (F.col("c") >= 3) & (F.col("c") < 21) & (F.col("v1") > 0)).select("r", "c", (F.col("v1") + F.col("v2")).alias("v"))


@query(f"with {EVENT_WINDOWS} select window_id, r0, c0, j, v1 as v from w")
def window_matrix_uni(spark, sf_dir):
    return windows(event_cells(spark, sf_dir), EVENTS, ["v1"]).select("window_id", "r0", "c0", F.posexplode("v1").alias("j", "v"))


@query(f"with {EVENT_WINDOWS} select window_id, r0, c0, j, v2 as v from w")
def window_matrix_sql_form(spark, sf_dir):
    """The cell-centric form, with DataFrame functions alone."""
    return windows_sql(event_cells(spark, sf_dir), EVENTS, "v2").select("window_id", "r0", "c0", F.posexplode("v2").alias("j", "v"))


@query("""with g as (select (day(ts) - 1)::int as r, hour(ts)::int as c, round(sum(case when event_type = 'view' then value end), 2) as v1, round(sum(case when event_type = 'error' then value end), 2) as v2 from events group by 1, 2),
    both_ as (select * from g where v1 is not null and v2 is not null),
    win as (select (i.range * 22 + k.range)::bigint as window_id, (r - i.range) * 3 + c - k.range as j, v1, v2 from range(0, 29) i, range(0, 22) k, both_ where r between i.range and i.range + 1 and c between k.range and k.range + 2),
    whole as (select window_id from win group by 1 having count(*) = 6)
    select window_id, j::int as j, v1, v2 from win join whole using (window_id)""")
def window_matrix_multi_mask(spark, sf_dir):
    """Two variables with missing cells: a window is whole only where both are."""
    s = lambda k: F.round(F.sum(F.when(F.col("event_type") == k, F.col("value"))), 2)
    g = table(spark, sf_dir, "events").groupBy((F.dayofmonth("ts") - 1).alias("r"), F.hour("ts").alias("c")).agg(s("view").alias("v1"), s("error").alias("v2"))
    w = windows(g, Shape(30, HOURS, 2, 3), ["v1", "v2"])
    return w.select("window_id", F.posexplode(F.arrays_zip("v1", "v2")).alias("j", "v")).select("window_id", "j", "v.v1", "v.v2")


@query(f"""with {LINE_CELLS}, win as (select (i.range * 23 + k.range)::bigint as window_id, r - i.range * 4 as dr, c - k.range * 2 as dc, n from range(0, 20) i, range(0, 23) k, lines where r between i.range * 4 and i.range * 4 + 6 and c between k.range * 2 and k.range * 2 + 6
        and power(r - i.range * 4 + 0.5 - 3.5, 2) + power(c - k.range * 2 + 0.5 - 3.5, 2) <= 9.0 + 1e-9),
    agg as (select window_id, count(*) as cells, sum(n) as total, sum(n * (dr * 7 + dc)) as moment from win group by 1)
    select window_id, cells, total, moment from agg where cells = 29""")
def window_matrix_circle(spark, sf_dir):
    """Circular windows: cells whose centres lie within three cells of the centre."""
    mask = circle_mask(7, 7, 3.0)
    places = [i for i, m in enumerate(mask.ravel().tolist()) if m]
    w = windows(line_cells(spark, sf_dir), Shape(84, 50, 7, 7, 4, 2), ["n"], mask)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    where = F.array(*[F.lit(float(p)) for p in places])
    return w.select("window_id", F.size("n").cast("long").alias("cells"), total(F.col("n")).alias("total"), total(F.zip_with("n", where, lambda a, b: a * b)).alias("moment"))


@query(f"with {LINE_CELLS} select (i.range * 13 + k.range)::bigint as window_id, (i.range * 3)::int as r0, (k.range * 4)::int as c0, n from range(0, 27) i cross join range(0, 13) k left join lines on r = i.range * 3 and c = k.range * 4")
def window_ids_strided(spark, sf_dir):
    """Ids of the padded grid of windows, with the value of each window's first cell where it has one."""
    first = line_cells(spark, sf_dir).select(F.col("r").alias("r0"), F.col("c").alias("c0"), "n")
    return window_ids(spark, LINES).join(first, ["r0", "c0"], "left").select("window_id", "r0", "c0", "n")


@query(f"""with {LINE_CELLS}, win as (select (i.range * 13 + k.range)::bigint as window_id, count(*) as present, sum(n) as total from range(0, 27) i, range(0, 13) k, lines where r between i.range * 3 and i.range * 3 + 5 and c between k.range * 4 and k.range * 4 + 4 group by 1)
    select window_id, total from win where present = 30""")
def window_totals(spark, sf_dir):
    w = windows(line_cells(spark, sf_dir), LINES, ["n"], band=12)
    return w.select("window_id", F.aggregate("n", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query(f"with {EVENT_CELLS} select (i.range * 8 + k.range)::bigint as window_id, (k.range * 3)::double as x0, (k.range * 3 + 4)::double as x1, (i.range * 2)::double as y0, (i.range * 2 + 3)::double as y1, k.range * 3 + 0.5::double as cx, i.range * 2 + 0.5::double as cy, v1 from range(0, 15) i, range(0, 8) k, cells where r = i.range * 2 and c = k.range * 3")
def pixel_to_map(spark, sf_dir):
    """Boxes and first cells' centres of windows on the map, with the value there."""
    b = with_box(window_ids(spark, EVENTS), CELLS, 3, 4).join(event_cells(spark, sf_dir).select(F.col("r").alias("r0"), F.col("c").alias("c0"), "v1"), ["r0", "c0"])
    cx, cy = center_of(CELLS, "r0", "c0")
    return b.select("window_id", "x0", "x1", "y0", "y1", cx.alias("cx"), cy.alias("cy"), "v1")


@query(f"with {VECTORS} select j::int as j, round(avg(v), 6) + 0.0 as mean, round(stddev_samp(v), 6) as sd_samp, round(stddev_pop(v), 6) as sd_pop from alls group by 1")
def zscore_columns(spark, sf_dir):
    return rounded(linalg.column_moments(vectors(spark, sf_dir)), "mean", "sd_samp", "sd_pop")


@query(f"with {VECTORS}, s as (select j, avg(v) as m, stddev_samp(v) as sd from alls group by 1) select window_id, round(sum((v - m) / sd), 6) + 0.0 as z_sum, round(sum(power((v - m) / sd, 2)), 6) as z_square from alls join s using (j) group by 1")
def standardized_vectors(spark, sf_dir):
    z = linalg.standardized(vectors(spark, sf_dir))
    add = lambda f: F.aggregate(F.transform("x", f), F.lit(0.0), lambda a, v: a + v)
    return rounded(z.select("window_id", add(lambda v: v).alias("z_sum"), add(lambda v: v * v).alias("z_square")), "z_sum", "z_square")


@query(f"""with {VECTORS}, s as (select j, avg(v) as m, stddev_samp(v) as sd, count(*) as n from alls group by 1), z as (select window_id, j, (v - m) / sd as z, n from alls join s using (j))
    select a.j::int as i, b.j::int as j, round(sum(a.z * b.z) / (max(a.n) - 1), 6) + 0.0 as r from z a join z b using (window_id) group by 1, 2""")
def correlation_matrix(spark, sf_dir):
    """From the partial Gram matrices."""
    m = linalg.moments(vectors(spark, sf_dir))
    sd = m.sd(1)
    corr = m.gram / (sd[:, None] * sd[None, :]) / (m.n - 1)
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(corr)], "i int, row array<double>")
    return rounded(rows.select("i", F.posexplode("row").alias("j", "r")), "r")


@query(f"""with recursive {VECTORS}, {pca(64)}, e as (select distinct pc, val from ld), g as (select pc, val, (val - coalesce(lead(val) over (order by pc), 0)) / val as gap from e)
    select pc::int as pc, round(val, 6) as eigval, round(val / sum(val) over (), 6) as ratio, round(gap, 6) as gap, gap < 1e-4 as degenerate from g""")
def eigen_spectrum(spark, sf_dir):
    """Eigenvalues, explained ratios and relative gaps of the embeddings."""
    m = linalg.fit(vectors(spark, sf_dir))
    rows = [(k + 1, float(v), float(r), float(g), bool(g < linalg.DEGENERATE_GAP)) for k, (v, r, g) in enumerate(zip(m.eigvals, m.ratio, m.gaps()))]
    return rounded(spark.createDataFrame(rows, "pc int, eigval double, ratio double, gap double, degenerate boolean"), "eigval", "ratio", "gap")


EV1 = EVENT_WINDOWS.replace("alls as (", "alls0 as (") + ", alls as (select window_id, is_ref, j, v1 as v from alls0)"


@query(f"""with recursive {EV1}, {pca(12)}, part as (select j, pc, rz * load as p from ld join rs using (pc)), built as (select j, pc, sum(p) over (partition by j order by pc) as z from part)
    select pc::int as k, round(sum(power((b.z - zz.z) * sd, 2)), 4) + 0.0 as error from built b join z zz using (j) join st using (j) where zz.is_ref group by 1""")
def reconstruction_error(spark, sf_dir):
    """Squared error of the reference rebuilt from its first k components, for every k."""
    import numpy as np

    v = event_windows(spark, sf_dir)
    m = linalg.fit(v, "v1")
    ref = np.array(v.where("is_ref").first()["v1"])
    z = m.scores(ref)
    rows = [(k, float(((m.rebuild(z, k) - ref) ** 2).sum())) for k in range(1, len(z) + 1)]
    return rounded(spark.createDataFrame(rows, "k int, error double"), "error", digits=4)
