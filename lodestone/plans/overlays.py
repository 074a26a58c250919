"""Masks, thematic maps and groups on the lineitem grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlay as O
from ..operators.windows import windows
from .adapters import EVENT_CELLS, LINE_CELLS, LINES, MONTHS, QUANTITIES, event_cells, line_cells, query, rounded, table

FULL = LINE_CELLS + """,
    grid as (select a.range::int as r, b.range::int as c from range(0, 84) a, range(0, 50) b),
    full_ as (select g.r, g.c, coalesce(k = 'R', false) as v, coalesce(k = 'A', false) as u, coalesce(k, '-') as k from grid g left join lines l on g.r = l.r and g.c = l.c),
    win as (select (i.range * 13 + k.range)::bigint as window_id, (i.range * 3)::int as r0, (k.range * 4)::int as c0 from range(0, 27) i, range(0, 12) k where i.range * 3 + 6 <= 84 and k.range * 4 + 5 <= 50),
    cov as (select window_id, r0, c0, sum(v::int) / 30.0 as cover from win join full_ on r between r0 and r0 + 5 and c between c0 and c0 + 4 group by 1, 2, 3)"""


def full(spark, sf_dir):
    """(r, c, v, u, k) of every cell of the grid."""
    grid = spark.range(MONTHS * QUANTITIES).select(F.floor(F.col("id") / QUANTITIES).cast("int").alias("r"), (F.col("id") % QUANTITIES).cast("int").alias("c"))
    j = grid.join(line_cells(spark, sf_dir).select("r", "c", "k"), ["r", "c"], "left")
    return j.select("r", "c", F.coalesce(F.col("k") == "R", F.lit(False)).alias("v"), F.coalesce(F.col("k") == "A", F.lit(False)).alias("u"), F.coalesce("k", F.lit("-")).alias("k"))


def all_windows(spark, sf_dir):
    f = full(spark, sf_dir).select("r", "c", F.lit(1.0).alias("one"))
    return windows(f, LINES, ["one"], band=30).select("window_id", "r0", "c0")


@query(f"with {FULL} select window_id, round(cover, 6) as cover from cov")
def coverage_integral_image(spark, sf_dir):
    m = full(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    return rounded(O.coverage_integral(all_windows(spark, sf_dir), m, 6, 5), "cover")


@query(f"with {FULL} select window_id, round(cover, 6) as cover from cov")
def mask_coverage(spark, sf_dir):
    m = full(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    return rounded(O.coverage_join(all_windows(spark, sf_dir), m, 6, 5), "cover")


@query(f"with {FULL} select count(*) as n, round(avg(cover), 6) as mean_cover, round(avg(cover) / (select avg(v::int) from full_), 6) as ratio, round(avg((cover > 0)::int), 6) as touching from cov")
def enrichment(spark, sf_dir):
    m = full(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    base = m.agg(F.avg("v")).first()[0]
    return rounded(O.enrichment(O.coverage_integral(all_windows(spark, sf_dir), m, 6, 5), base), "mean_cover", "ratio", "touching")


RARE = EVENT_CELLS + ", m as (select r, c, v1 >= (select quantile_cont(v1, 0.97) from cells) as v from cells), near as (select a.r, a.c, min(sqrt(power(a.r - b.r, 2) + power(a.c - b.c, 2))) as distance from m a, m b where b.v group by 1, 2)"


def rare(spark, sf_dir):
    """Cells with the highest counts."""
    c = event_cells(spark, sf_dir)
    limit = c.agg(F.percentile("v1", F.lit(0.97))).first()[0]
    return c.select("r", "c", (F.col("v1") >= limit).alias("v"))


@query(f"with {RARE} select r, c, round(distance, 6) as distance from near")
def nearest_mask_distance(spark, sf_dir):
    return rounded(O.distance_to(rare(spark, sf_dir)), "distance")


@query(f"with {RARE} select count(distance) as n, count(*) - count(distance) as dropped, round(median(distance), 6) as median, round(avg(distance), 6) as mean, round(avg((distance <= 1)::int), 6) as within_1, round(avg((distance <= 3)::int), 6) as within_3 from near")
def distance_summary(spark, sf_dir):
    return rounded(O.distance_summary(O.distance_to(rare(spark, sf_dir)), [1, 3]), "median", "mean", "within_1", "within_3")


@query(f"with {FULL} select window_id, k from win join full_ on r = least(r0 + 3, 83) and c = least(c0 + 2, 49)")
def sample_at_center(spark, sf_dir):
    return O.sample_at_center(all_windows(spark, sf_dir), full(spark, sf_dir), 6, 5, MONTHS, QUANTITIES, "k").select("window_id", "k")


@query(f"with {FULL} select a.r, a.c, bool_or(b.k is not null and b.k <> a.k) as contact from full_ a left join full_ b on abs(a.r - b.r) + abs(a.c - b.c) = 1 group by 1, 2")
def class_contacts(spark, sf_dir):
    return O.contacts(full(spark, sf_dir))


@query("with a as (select o_custkey % 40 as r, o_orderkey % 30 as c, o_orderpriority as k, count(*) as n from orders group by 1, 2, 3), m as (select r, c, k from a qualify row_number() over (partition by r, c order by n desc, k) = 1), b as (select o_custkey % 40 as r, o_orderkey % 30 as c, max(o_orderstatus) as k from orders group by 1, 2) select m.k as a, b.k as b, count(*) as n from m join b on m.r = b.r and m.c = b.c group by 1, 2")
def map_confusion(spark, sf_dir):
    return O.confusion(*order_maps(spark, sf_dir))


def order_maps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("r"), (F.col("o_orderkey") % 30).alias("c"), "o_orderpriority", "o_orderstatus")
    a = O.tally(o, ["r", "c"], "o_orderpriority").select("r", "c", F.col("mode").alias("k"))
    return a, o.groupBy("r", "c").agg(F.max("o_orderstatus").alias("k"))


@query("""with a as (select o_custkey % 40 as r, o_orderkey % 30 as c, o_orderpriority as k, count(*) as n from orders group by 1, 2, 3), m as (select r, c, k from a qualify row_number() over (partition by r, c order by n desc, k) = 1), b as (select o_custkey % 40 as r, o_orderkey % 30 as c, max(o_orderstatus) as k from orders group by 1, 2),
    p as (select m.k as a, b.k as b, count(*) as n from m join b on m.r = b.r and m.c = b.c group by 1, 2), t as (select a, b, n, round(n / sum(n) over (partition by a), 6) as share, row_number() over (partition by a order by n desc, b) as place from p) select * from t where place <= 2""")
def top_confusions(spark, sf_dir):
    return rounded(O.top_confusions(O.confusion(*order_maps(spark, sf_dir))), "share")


@query(f"with {FULL} select sum((v and c < 25)::int)::bigint as both, sum((v or c < 25)::int)::bigint as either, round(sum((v and c < 25)::int) / sum((v or c < 25)::int), 6) as iou, round(sum((v and c < 25)::int) / sum(v::int), 6) as a_captured, round(sum((v and c < 25)::int) / sum((c < 25)::int), 6) as b_captured from full_")
def map_iou(spark, sf_dir):
    f = full(spark, sf_dir)
    return rounded(O.agreement(f, f.withColumn("v", F.col("c") < 25)), "iou", "a_captured", "b_captured")


@query("with n as (select c_nationkey as nation, c_mktsegment as k, count(*) as n from customer group by 1, 2), p as (select *, row_number() over (partition by nation order by n desc, k) as place, sum(n) over (partition by nation) as total from n) select nation, max(case when place = 1 then k end) as mode, round(max(case when place = 1 then n / total end), 6) as share, string_agg(k || ':' || n, ';' order by place) as tally from p group by 1")
def class_tally(spark, sf_dir):
    return rounded(O.tally(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), ["nation"], "c_mktsegment"), "share")


@query("with s as (select r_name as era, n_name as unit, s_acctbal as v from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) select era, unit, grouping(era, unit)::int as level, round(sum(v), 2) as total, round(sum(v) / (select sum(v) from s), 6) as share from s group by rollup (era, unit)")
def class_rollup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    out = O.class_shares(s.select(F.col("r_name").alias("era"), F.col("n_name").alias("unit"), F.col("s_acctbal").alias("v")), "unit", "era", "v")
    return rounded(rounded(out, "total", digits=2), "share").withColumn("level", F.col("level").cast("int"))


def purchase_windows(events):
    """(window_id, r0, c0) of the events' distinct windows on a grid of 40 by 40 places."""
    ids = events.select((F.col("event_id") * 37 % 1600).alias("window_id")).distinct()
    return ids.select("window_id", (F.floor(F.col("window_id") / 40) * 2).cast("int").alias("r0"), (F.col("window_id") % 40 * 3).cast("int").alias("c0"))


@query("""with recursive w as (select window_id, (window_id // 40 * 2)::int as r0, (window_id % 40 * 3)::int as c0 from (select distinct event_id * 37 % 1600 as window_id from events where event_type = 'purchase')),
    e as (select a.window_id as a, b.window_id as b from w a join w b on abs(a.r0 - b.r0) < 3 and abs(a.c0 - b.c0) < 4),
    g as (select a as node, b as other from e union select g.node, e.b from g join e on g.other = e.a)
    select node as window_id, min(other) as "group" from g group by 1""")
def window_components(spark, sf_dir):
    """Groups of overlapping windows, of all purchases."""
    return O.window_groups(purchase_windows(table(spark, sf_dir, "events").where("event_type = 'purchase'")), 3, 4)


@query(f"""with recursive {RARE}, k as (select r, c, (r * 24 + c)::bigint as n from m where v), e as (select a.n as a, b.n as b from k a join k b on abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1),
    g as (select a as node, b as other from e union select g.node, e.b from g join e on g.other = e.a), f as (select node, min(other) as grp from g group by 1) select r, c, grp as "group" from f join k on n = node""")
def mask_components(spark, sf_dir):
    """Connected groups of marked cells."""
    return O.cell_groups(rare(spark, sf_dir).where("v").select("r", "c"), 24)
