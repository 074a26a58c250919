"""The given tables as grids, vectors and footprints, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Affine
from ..operators.ordering import cut
from ..operators.windows import Shape, windows, with_reference

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that says the same."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums come in another order on every run, so doubles are compared to six digits; a negative zero is zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


# Events as a grid of 30 days by 24 hours: counts of two kinds, 0 where there is none.
DAYS, HOURS = 30, 24
EVENTS = Shape(DAYS, HOURS, 3, 4, 2, 3)
REFERENCE = 18
CELLS = Affine(e=1.0)


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, v1, v2): views and clicks by day and hour."""
    day, hour = F.dayofmonth("ts") - 1, F.hour("ts")
    n = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0))
    seen = table(spark, sf_dir, "events").groupBy(day.alias("r"), hour.alias("c")).agg(n("view").alias("v1"), n("click").alias("v2"))
    every = spark.range(DAYS * HOURS).select(F.floor(F.col("id") / HOURS).cast("int").alias("r"), (F.col("id") % HOURS).cast("int").alias("c"))
    return every.join(seen, ["r", "c"], "left").na.fill(0.0, ["v1", "v2"])


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 3 days by 4 hours, every second day and third hour, with the reference row."""
    return with_reference(cut(windows(event_cells(spark, sf_dir), EVENTS, ["v1", "v2"])), REFERENCE)


EVENT_CELLS = """
    every_cell as (select (d.range)::int as r, (h.range)::int as c from range(0, 30) d, range(0, 24) h),
    seen as (select day(ts) - 1 as r, hour(ts) as c, count(*) filter (where event_type = 'view') as v1, count(*) filter (where event_type = 'click') as v2 from events group by 1, 2),
    cells as (select e.r, e.c, coalesce(s.v1, 0)::double as v1, coalesce(s.v2, 0)::double as v2 from every_cell e left join seen s on e.r = s.r and e.c = s.c)"""
EVENT_WINDOWS = EVENT_CELLS + """,
    win as (select (i.range * 8 + k.range)::bigint as window_id, (i.range * 2)::int as r0, (k.range * 3)::int as c0, ((r - i.range * 2) * 4 + c - k.range * 3)::int as j, v1, v2
        from range(0, 15) i, range(0, 8) k, cells where r between i.range * 2 and i.range * 2 + 2 and c between k.range * 3 and k.range * 3 + 3),
    whole as (select window_id from win group by 1 having count(*) = 12),
    w as (select win.* from win join whole using (window_id)),
    alls as (select window_id, false as is_ref, j, v1, v2 from w union all select -1, true, j, v1, v2 from w where window_id = 18)"""

# Lineitems as a grid of 84 months by 50 quantities.
MONTHS, QUANTITIES = 84, 50
LINES = Shape(MONTHS, QUANTITIES, 6, 5, 3, 4)


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, n, tax, k): rows, sum of taxes in hundredths and most frequent return flag (ties to the first letter)."""
    r = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    by_flag = table(spark, sf_dir, "lineitem").groupBy(r.cast("int").alias("r"), (F.col("l_quantity") - 1).cast("int").alias("c"), F.col("l_returnflag").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"))
    most = F.max(F.struct("n", (-F.ascii("k")).alias("o"), "k"))["k"]
    return by_flag.groupBy("r", "c").agg(F.sum("n").cast("double").alias("n"), F.sum("tax").cast("double").alias("tax"), most.alias("k"))


LINE_CELLS = """
    by_flag as (select ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::int as r, (l_quantity - 1)::int as c, l_returnflag as k, count(*) as n, sum(round(l_tax * 100)::bigint) as tax from lineitem group by 1, 2, 3),
    lines as (select r, c, sum(n)::double as n, sum(tax)::double as tax, (arg_max(k, n * 1000 - ascii(k))) as k from by_flag group by 1, 2)"""

# Embeddings as vectors, with vector 0 as the reference.


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, x, is_ref)."""
    return with_reference(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("window_id"), F.col("embedding").cast("array<double>").alias("x")), 0)


VECTORS = """
    rows_ as (select vec_id as window_id, false as is_ref, embedding from embeddings union all select -1, true, embedding from embeddings where vec_id = 0),
    alls as (select window_id, is_ref, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as j from rows_)"""

#: Footprints on the events grid, in columns (x) and rows (y); fixed values of these examples.
BOXES = [(1, 5.5, 9.25, 4.0, 7.5), (2, 14.0, 18.0, 10.0, 13.0), (3, 2.25, 5.0, 20.5, 24.0), (4, 18.0, 23.0, 1.0, 3.0)]


def footprints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOXES, "dep_id int, x0 double, x1 double, y0 double, y1 double")


FOOTPRINTS = "boxes(dep_id, x0, x1, y0, y1) as (values " + ", ".join(f"({d}, {a}::double, {b}::double, {c}::double, {e}::double)" for d, a, b, c, e in BOXES) + """),
    dep_cells as (select dep_id, r, c, (least(x1, c + 1) - greatest(x0, c)) * (least(y1, r + 1) - greatest(y0, r)) as area from boxes, every_cell where x0 < c + 1 and x1 > c and y0 < r + 1 and y1 > r),
    dep_area as (select dep_id, sum(area) as dep_area from dep_cells group by 1)"""


def pca(k: int, s: str = "", source: str = "alls", steps: int = 34) -> str:
    """SQL of k components of source (window_id, is_ref, j, v), columns standardised; with recursive is needed.

    The correlation matrix is squared again and again, which leaves its leading component; this is taken off, and so on.
    Gives z (standardised values), ld (pc, val, j, load; the largest load by size is positive), sc (scores) and rs (the
    reference's), with the suffix s.
    """
    return f"""
    st{s} as (select j, avg(v) as m, coalesce(nullif(stddev_samp(v), 0), 1) as sd from {source} group by 1),
    z{s} as (select window_id, is_ref, j, (v - m) / sd as z from {source} join st{s} using (j)),
    gram{s} as (select a.j as i, b.j as j, sum(a.z * b.z) / (count(*) - 1) as r from z{s} a join z{s} b on a.window_id = b.window_id and a.is_ref = b.is_ref group by 1, 2),
    cm{s} as (select list(x order by i) as m from (select i, list(r order by j) as x from gram{s} group by 1)),
    it{s} as (select 0 as pc, 0 as step, m, m as b, [0.0::double] as e, 0.0::double as val from cm{s}
        union all select * from (
            with one as (select *, step % {steps + 1} = {steps} as ready from it{s} where pc < {k}),
            sq as (select *, case when ready then b else list_transform(b, lambda x: list_transform(b, lambda y: list_dot_product(x, y))) end as q from one),
            tr as (select *, list_transform(range(1, len(m) + 1), lambda i: q[i][i]) as d from sq),
            co as (select *, case when ready then q[list_position(d, list_max(d))] end as c from tr),
            un as (select *, case when ready then list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) end as u from co),
            sg as (select *, case when ready then list_transform(u, lambda x: x * sign(u[list_position(list_transform(u, lambda y: round(abs(y), 12)), list_max(list_transform(u, lambda y: round(abs(y), 12))))])) end as w from un),
            va as (select *, case when ready then list_dot_product(w, list_transform(m, lambda x: list_dot_product(x, w))) end as l from sg),
            nx as (select *, case when ready then list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * w[i] * w[j])) end as dm from va)
            select case when ready then pc + 1 else pc end, step + 1, case when ready then dm else m end, case when ready then dm else list_transform(q, lambda x: list_transform(x, lambda y: y / list_sum(d))) end, case when ready then w else e end, case when ready then l else val end from nx)),
    ld{s} as (select pc, val, unnest(e) as load, generate_subscripts(e, 1) - 1 as j from (select pc, arg_min(val, step) as val, arg_min(e, step) as e from it{s} where pc > 0 group by 1)),
    sc{s} as (select window_id, is_ref, pc, val, sum(z * load) as s from z{s} join ld{s} using (j) group by 1, 2, 3, 4),
    rs{s} as (select pc, s as rz from sc{s} where is_ref)"""
