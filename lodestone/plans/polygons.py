"""Overlay, repair, dissolving, borders, buffers of polygons, and the cells that lines touch.

The SQL finds areas by slabs: between two neighbouring heights of ends and crossings no edges cross, so that an area there
is a sum of widths between edges in their order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import overlay as O
from ..operators import polygons as P
from ..operators.ordering import shared_place
from ..sources.grids import read_shapefile
from ..sources.maps import read_geopackage, write_map
from .adapters import CELLS, DAYS, HOURS, query, rounded, table
from .geometry import NEXT, polygons
from .overlays import order_maps


#: Step of the grid that coordinates are held to, so that areas agree to four digits.
FINE = 1e-10


def slabs(inside: str) -> str:
    """SQL of (id, area) from edges (id, a, b, x, y, x2, y2); a and b are 1 for edges of either side. inside is said of the
    winding numbers wa and wb."""
    return f"""
    meet as (select p.id, p.y + ((q.x - p.x) * (q.y2 - q.y) - (q.y - p.y) * (q.x2 - q.x)) / ((p.x2 - p.x) * (q.y2 - q.y) - (p.y2 - p.y) * (q.x2 - q.x)) * (p.y2 - p.y) as h, p.y as py, p.y2 as py2, q.y as qy, q.y2 as qy2
        from edges p join edges q on p.id = q.id and abs((p.x2 - p.x) * (q.y2 - q.y) - (p.y2 - p.y) * (q.x2 - q.x)) > 1e-12),
    heights as (select id, h from meet where h between least(py, py2) and greatest(py, py2) and h between least(qy, qy2) and greatest(qy, qy2) union select id, y from edges union select id, y2 from edges),
    slab as (select * from (select id, h as low, lead(h) over (partition by id order by h) as high from heights) where high - low > 1e-11),
    part as (select s.id, low, high, x + ((low + high) / 2 - y) / (y2 - y) * (x2 - x) as mid, (case when y2 > y then 1 else -1 end) * a as a, (case when y2 > y then 1 else -1 end) * b as b
        from slab s join edges e on e.id = s.id and least(y, y2) < (low + high) / 2 and greatest(y, y2) > (low + high) / 2),
    sized as (select id, sum(tall * wide) as area from (select id, high - low as tall, lead(mid) over (partition by id, low order by mid) - mid as wide, sum(a) over w as wa, sum(b) over w as wb from part window w as (partition by id, low order by mid rows between unbounded preceding and current row)) where {inside} group by 1)"""


def slabs_of(edges: str, inside: str) -> str:
    return f"with {NEXT}, edges as ({edges}),{slabs(inside)}"


PAIR = "select id, 1 as a, 0 as b, x, y, x2, y2 from nx union all select id - 1, 0, 1, x, y, x2, y2 from nx"
PAIRED = "select i.id, round(coalesce(area, 0), 4) as area from (select distinct id from edges) i left join sized on sized.id = i.id"


def neighbours(spark, sf_dir, way):
    """Areas of every supplier's polygon combined with the next one's."""
    p = polygons(spark, sf_dir)
    got = P.overlay(p, p.withColumn("id", F.col("id") - 1), way, "id", FINE)
    return rounded(got.select("id", G.area(F.col("rings")).alias("area")), "area", digits=4)


@query(f"{slabs_of(PAIR, 'wa <> 0 or wb <> 0')} {PAIRED}")
def polygon_union(spark, sf_dir):
    return neighbours(spark, sf_dir, "union")


@query(f"{slabs_of(PAIR, 'wa <> 0 and wb <> 0')} {PAIRED}")
def polygon_intersection(spark, sf_dir):
    return neighbours(spark, sf_dir, "intersection")


@query(f"{slabs_of(PAIR, 'wa <> 0 and wb = 0')} {PAIRED}")
def polygon_difference(spark, sf_dir):
    return neighbours(spark, sf_dir, "difference")


STAR = """select id, 1 as a, 0 as b, x, y, x2, y2 from (select p.id, p.x, p.y, q.x as x2, q.y as y2 from pts p join pts q on p.id = q.id and q.i = (p.i + 2) % (5 + p.id % 3) where (5 + p.id % 3) % 2 = 1
    union all select p.id, p.x, p.y, q.x, q.y from pts p join pts q on p.id = q.id and q.i = (p.i + 2) % 6 where p.id % 3 = 1 and p.i % 2 = 0)"""


@query(f"{slabs_of(STAR, 'wa % 2 <> 0')} {PAIRED}")
def polygon_repair(spark, sf_dir):
    """Every second corner of each polygon: stars that cross themselves keep their points and lose their middle."""
    p = polygons(spark, sf_dir)
    ring, n = F.get("rings", F.lit(0)), F.size(F.get("rings", F.lit(0)))
    steps = F.sequence(F.lit(0), F.when(n % 2 == 1, n - 1).otherwise(F.floor(n / 2).cast("int") - 1))
    star = p.select(F.col("id").alias("fid"), F.array(F.transform(steps, lambda i: F.get(ring, 2 * i % n))).alias("rings"))
    got = P.repair(star, snap=FINE)
    return rounded(got.select(F.col("fid").alias("id"), G.area(F.col("rings")).alias("area")), "area", digits=4)


BY_NATION = "select s_nationkey as id, 1 as a, 0 as b, x, y, x2, y2 from nx join supplier on s_suppkey = nx.id"


@query(f"{slabs_of(BY_NATION, 'wa <> 0')} select id as nation, round(area, 4) as area from sized")
def dissolved_overlaps(spark, sf_dir):
    """Area that the polygons of each nation's suppliers cover; overlaps count once."""
    p = polygons(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), "id")
    return rounded(P.dissolve(p, "nation", snap=FINE).select("nation", G.area(F.col("rings")).alias("area")), "area", digits=4)


ORDER_CLASSES = "a as (select o_custkey % 40 as r, o_orderkey % 30 as c, o_orderpriority as k, count(*) as n from orders group by 1, 2, 3), m as (select r, c, k from a qualify row_number() over (partition by r, c order by n desc, k) = 1)"
BESIDE = "beside as (select m.k, o.k as other from m, (values (0, 1), (0, -1), (1, 0), (-1, 0)) s(dr, dc) left join m o on o.r = m.r + s.dr and o.c = m.c + s.dc)"


def unit_squares(spark, sf_dir):
    """Cells of the map of order priorities as squares."""
    cells = order_maps(spark, sf_dir)[0]
    cells = cells.withColumns({"x0": F.col("c"), "x1": F.col("c") + 1, "y0": F.col("r"), "y1": F.col("r") + 1})
    return cells.select("k", G.box_rings("x0", "x1", "y0", "y1").alias("rings"))


def length_of(rings):
    """Length of all rings, closed."""
    n = F.size
    one = lambda r: F.aggregate(F.transform(r, lambda p, i: F.hypot(F.element_at(r, (i + 1) % n(r) + 1)["x"] - p["x"], F.element_at(r, (i + 1) % n(r) + 1)["y"] - p["y"])), F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(F.transform(rings, one), F.lit(0.0), lambda a, v: a + v)


@query(f"with {ORDER_CLASSES}, {BESIDE}, l as (select k, count(*) filter (where other is null or other <> k)::double as border from beside group by 1) select k, count(*)::double as area, any_value(border) as border from m join l using (k) group by 1")
def dissolved_classes(spark, sf_dir):
    """Map units dissolved by class: shared edges drop out, rings are stitched."""
    got = P.dissolve(unit_squares(spark, sf_dir), "k", matched=True)
    return rounded(got.select("k", G.area(F.col("rings")).alias("area"), length_of(F.col("rings")).alias("border")), "area", "border")


@query(f"with {ORDER_CLASSES}, {BESIDE} select k as a, other as b, count(*)::double as length from beside where other is null or other > k group by 1, 2")
def class_boundaries(spark, sf_dir):
    """Length of the border between any two classes, and of the outer border (b is null)."""
    lines = P.boundary_lines(unit_squares(spark, sf_dir), "k")
    return rounded(lines.groupBy("a", "b").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length")), "length")


@query(f"""with {NEXT}, s as (select id, abs(sum(x * y2 - x2 * y)) / 2 as inside, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) as around, 2 * pi() / count(*) as turn, count(*) as n from nx group by 1),
    k as (select *, ceil(turn / (pi() / 16) - 1e-9) as steps from s)
    select id, round(inside + 1.5 * around + n * steps * 1.5 * 1.5 / 2 * sin(turn / steps), 4) as area from k""")
def round_buffer(spark, sf_dir):
    """Polygons grown by 1.5 with round corners; the SQL adds strips and sectors to a convex polygon's area."""
    got = P.buffer(polygons(spark, sf_dir), 1.5, "id", snap=FINE)
    return rounded(got.select("id", G.area(F.col("rings")).alias("area")), "area", digits=4)


@query(f"""with {NEXT}, cell as (select r.range::int as r, c.range::int as c from range(0, 40) r, range(0, 40) c),
    t as (select r, c, (c - x) / (x2 - x) as ta, (c + 1 - x) / (x2 - x) as tb, (r - y) / (y2 - y) as ua, (r + 1 - y) / (y2 - y) as ub from cell join nx on c < greatest(x, x2) and c + 1 > least(x, x2) and r < greatest(y, y2) and r + 1 > least(y, y2))
    select distinct r, c from t where greatest(0, least(ta, tb), least(ua, ub)) < least(1, greatest(ta, tb), greatest(ua, ub))""")
def touched_by_outlines(spark, sf_dir):
    """Cells that any supplier's outline passes through."""
    p = polygons(spark, sf_dir).select(F.lit("Polygon").alias("kind"), "rings")
    return O.burn_lines(p, CELLS, 40, 40)


@query(f"with b as (select s_suppkey as fid, (s_suppkey % 20)::double + 0.2 as x0, s_suppkey % 20 + 2.7 as x1, (s_suppkey % 27)::double + 0.3 as y0, s_suppkey % 27 + 1.6 as y1 from supplier) select distinct r.range::int as r, c.range::int as c from b, range(0, {DAYS}) r, range(0, {HOURS}) c where x0 < c.range + 1 and x1 > c.range and y0 < r.range + 1 and y1 > r.range")
def burned_all_touched(spark, sf_dir):
    """Cells of which any supplier's box holds a part."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), ((F.col("s_suppkey") % 20).cast("double") + 0.2).alias("x0"), (F.col("s_suppkey") % 20 + 2.7).alias("x1"), ((F.col("s_suppkey") % 27).cast("double") + 0.3).alias("y0"), (F.col("s_suppkey") % 27 + 1.6).alias("y1"))
    return O.burn_all_touched(b.select("fid", G.box_rings("x0", "x1", "y0", "y1").alias("rings")), CELLS, DAYS, HOURS)


NAMED = f"with {NEXT}, a as (select id, abs(sum(x * y2 - x2 * y)) / 2 as area, count(*) as corners from nx group by 1) select a.id, s_name as name, round(s_acctbal, 2) as balance, corners::bigint as corners, round(area, 6) as area from a join supplier on s_suppkey = a.id"


def written(spark, sf_dir, kind, read):
    """Every supplier's polygon with its name and balance, written as map files by all tasks and read back from them."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("balance"))
    place = shared_place(spark, kind)
    write_map(polygons(spark, sf_dir).join(s, "id"), place, kind, crs="EPSG:31982")
    props = F.from_json("props", "id long, name string, balance double").alias("p")
    got = read(spark, place).select(props, (F.size(F.get("rings", F.lit(0))) - 1).cast("long").alias("corners"), G.area(F.col("rings")).alias("area"))
    return rounded(rounded(got.select("p.*", "corners", "area"), "area"), "balance", digits=2)


@query(NAMED)
def geopackage_written(spark, sf_dir):
    return written(spark, sf_dir, "gpkg", read_geopackage)


@query(NAMED)
def shapefile_written(spark, sf_dir):
    return written(spark, sf_dir, "shp", read_shapefile)


@query("""with r as (select vec_id, len(embedding) as n, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as e from embeddings),
    w as (select *, greatest(0.05, 1 + e) as radius from r), nx as (select *, coalesce(lead(radius) over o, first(radius) over o) as radius2 from w window o as (partition by vec_id order by i rows between unbounded preceding and unbounded following)),
    a as (select vec_id, any_value(n)::bigint as corners, round(sum(radius * radius2 * sin(2 * pi() / n)) / 2, 6) as area from nx group by 1)
    select vec_id, k.kind, corners, area from a, (values ('gpkg'), ('shp')) k(kind)""")
def vector_outlines_written(spark, sf_dir):
    """Every vector as an outline, its components as distances from a centre; written as map files of both kinds by all
    tasks and read back from them."""
    e, n = F.col("embedding"), F.size("embedding")
    away = lambda v: F.greatest(F.lit(0.05), 1 + v.cast("double"))
    ring = F.transform(e, lambda v, i: F.struct((away(v) * F.cos(2 * F.pi() * i / n)).alias("x"), (away(v) * F.sin(2 * F.pi() * i / n)).alias("y")))
    layer = table(spark, sf_dir, "embeddings").select("vec_id", F.array(ring).alias("rings"))
    out = []
    for kind, read in (("gpkg", read_geopackage), ("shp", read_shapefile)):
        place = shared_place(spark, kind)
        write_map(layer, place, kind)
        key, corners = F.get_json_object("props", "$.vec_id").cast("long").alias("vec_id"), (F.size(F.get("rings", F.lit(0))) - 1).cast("long").alias("corners")
        out.append(read(spark, place).select(key, F.lit(kind).alias("kind"), corners, G.area(F.col("rings")).alias("area")))
    return rounded(out[0].unionByName(out[1]), "area")
