"""Polygons, circles and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.names import component_index, file_token, label_with_unit, parse_case, safe_number
from ..operators.recovery import polygon_cells
from ..sources.sinks import circles_layer
from .adapters import CELLS, query, rounded, table

POLY = """pts as (select s_suppkey as id, k.range as i, 20 + 5 * sin(s_suppkey) + (3 + s_suppkey % 4) * cos(2 * pi() * k.range / (5 + s_suppkey % 3)) as x, 30 + 5 * cos(s_suppkey) + (3 + s_suppkey % 4) * sin(2 * pi() * k.range / (5 + s_suppkey % 3)) as y
    from supplier, range(0, 7) k where k.range < 5 + s_suppkey % 3)"""


def polygons(spark, sf_dir):
    """A regular polygon of five to seven corners for every supplier."""
    n = 5 + F.col("s_suppkey") % 3
    turn = lambda i: 2 * F.pi() * i / n
    size = 3 + F.col("s_suppkey") % 4
    ring = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.struct((20 + 5 * F.sin("s_suppkey") + size * F.cos(turn(i))).alias("x"), (30 + 5 * F.cos("s_suppkey") + size * F.sin(turn(i))).alias("y")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(ring).alias("rings"))


@query(f"with {POLY}, nx as (select *, coalesce(lead(x) over w, first(x) over w) as x2, coalesce(lead(y) over w, first(y) over w) as y2 from pts window w as (partition by id order by i rows between unbounded preceding and unbounded following)) select id, round(abs(sum(x * y2 - x2 * y)) / 2, 6) as area, round(sqrt(abs(sum(x * y2 - x2 * y)) / 2), 6) as size from nx group by 1")
def shoelace_area(spark, sf_dir):
    p = polygons(spark, sf_dir)
    return rounded(p.select("id", G.area(F.col("rings")).alias("area"), G.outline_size(F.col("rings")).alias("size")), "area", "size")


@query("with p as (select l_suppkey as id, l_quantity as x, l_quantity * 0.7 + l_discount * 100 as y from lineitem), g as (select id, covar_pop(x, y) as cxy, var_pop(x) as vx, var_pop(y) as vy from p group by 1) select id, round(((degrees(0.5 * atan2(2 * cxy, vy - vx)) + 180) % 180 + 180) % 180, 4) as azimuth from g")
def long_axis_azimuth(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("x"), (F.col("l_quantity") * 0.7 + F.col("l_discount") * 100).alias("y"))
    return rounded(G.axis_azimuth(p, ["id"]), "azimuth", digits=4)


@query(f"with {POLY} select id, round((min(x) + max(x)) / 2, 6) as cx, round((min(y) + max(y)) / 2, 6) as cy, round(greatest(max(x) - min(x), max(y) - min(y)) / 2, 6) as radius from pts group by 1")
def circle_from_bounds(spark, sf_dir):
    return rounded(polygons(spark, sf_dir).select("id", G.circle_of(F.col("rings")).alias("k")).select("id", "k.*"), "cx", "cy", "radius")


@query("with b as (select s_suppkey as id, (s_suppkey % 7)::double as x0, s_suppkey % 7 + 3.5 as x1, (s_suppkey % 5)::double as y0, s_suppkey % 5 + 2.25 as y1 from supplier) select id, round(greatest(0, least(x1, 6) - greatest(x0, 2)) * greatest(0, least(y1, 5) - greatest(y0, 1)), 6) as inside from b")
def clip_area(spark, sf_dir):
    """Boxes as polygons, clipped by the general kernel."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7).cast("double").alias("x0"), (F.col("s_suppkey") % 7 + 3.5).alias("x1"), (F.col("s_suppkey") % 5).cast("double").alias("y0"), (F.col("s_suppkey") % 5 + 2.25).alias("y1"))
    return rounded(b.select("id", G.clip_area(G.box_rings("x0", "x1", "y0", "y1"), F.lit(2.0), F.lit(6.0), F.lit(1.0), F.lit(5.0)).alias("inside")), "inside")


NEXT = POLY + """, nx as (select *, coalesce(lead(x) over w, first(x) over w) as x2, coalesce(lead(y) over w, first(y) over w) as y2 from pts window w as (partition by id order by i rows between unbounded preceding and unbounded following))"""


@query(f"""with {NEXT}, box as (select id, floor(min(x)) as cx0, ceil(max(x)) as cx1, floor(min(y)) as cy0, ceil(max(y)) as cy1 from pts group by 1),
    slab as (select id, unnest(range(cx0::int, cx1::int)) as c, r from (select *, unnest(range(cy0::int, cy1::int)) as r from box)),
    e as (select s.id, s.r, s.c, x, y, x2, y2, least(greatest(y, r), r + 1) as u, least(greatest(y2, r), r + 1) as v from slab s join nx using (id)),
    -- an edge, cut to the slab of the row, and there at the two sides of the cell
    f as (select *, x + (u - y) * (x2 - x) / (y2 - y) as a, x + (v - y) * (x2 - x) / (y2 - y) as b from e where u <> v),
    t as (select *, case when a = b then [0, 1] else [0, least(greatest((c - a) / (b - a), 0), 1), least(greatest((c + 1 - a) / (b - a), 0), 1), 1] end as cuts from f),
    g as (select id, r, c, a, b, v - u as rise, list_sort(cuts) as k from t),
    h as (select id, r, c, rise * list_sum(list_transform(range(1, len(k)), lambda i: (k[i + 1] - k[i]) * (least(greatest(a + k[i] * (b - a), c), c + 1) + least(greatest(a + k[i + 1] * (b - a), c), c + 1)) / 2)) as part from g)
    select id as dep_id, r::int as r, c::int as c, round(sum(part), 6) as area from h group by 1, 2, 3 having round(sum(part), 6) > 0""")
def polygon_cell_areas(spark, sf_dir):
    """Every polygon's area in each cell of the grid."""
    return rounded(polygon_cells(polygons(spark, sf_dir).withColumnRenamed("id", "dep_id"), CELLS), "area").where("area > 0")


ISLANDS = "b as (select s_suppkey as id, (s_suppkey % 7)::double as x0, (s_suppkey % 5)::double as y0, 6.5 + s_suppkey % 3 as size from supplier)"


def islands(spark, sf_dir):
    """A square with a square hole, and a second square beside it, for every supplier; the outlines run clockwise."""
    k = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 7).cast("double").alias("x0"), (k % 5).cast("double").alias("y0"), (k % 3 + 6.5).alias("size"))

    def square(x, y, size, hole=False):
        corners = [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]
        return F.array(*[F.struct(u.alias("x"), v.alias("y")) for u, v in (corners[::-1] if hole else corners)])

    return b.select("id", F.array(square(F.col("x0"), F.col("y0"), F.col("size")), square(F.col("x0") + 1, F.col("y0") + 1, F.lit(2.0), True), square(F.col("x0") + 20, F.col("y0"), F.lit(3.0))).alias("rings"))


@query(f"""with {ISLANDS}, q as (select id, greatest(0, least(x0 + size, 24) - greatest(x0, 4)) * greatest(0, least(y0 + size, 9) - greatest(y0, 2)) as main, greatest(0, least(x0 + 3, 24) - greatest(x0 + 1, 4)) * greatest(0, least(y0 + 3, 9) - greatest(y0 + 1, 2)) as hole, greatest(0, least(x0 + 23, 24) - greatest(x0 + 20, 4)) * greatest(0, least(y0 + 3, 9) - greatest(y0, 2)) as other from b)
    select id, round(size * size - 4 + 9, 6) as area, round(main - hole + other, 6) as inside from b join q using (id)""")
def island_areas(spark, sf_dir):
    """Polygons of two outlines and a hole: their areas, and those inside a box."""
    p = islands(spark, sf_dir)
    inside = G.clip_area(F.col("rings"), F.lit(4.0), F.lit(24.0), F.lit(2.0), F.lit(9.0))
    return rounded(p.select("id", G.area(F.col("rings")).alias("area"), inside.alias("inside")), "area", "inside")


SPOTS = "q as (select distinct p_size as pid, p_size * 0.6 + 0.013 as px, p_size * 0.4 + 12.017 as py from part)"


def spots(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("pid"), (F.col("p_size") * 0.6 + 0.013).alias("x"), (F.col("p_size") * 0.4 + 12.017).alias("y")).distinct()


@query(f"""with {NEXT}, {SPOTS}, hit as (select id, pid from nx, q group by 1, 2 having sum(case when (y > py) <> (y2 > py) and px < x + (py - y) * (x2 - x) / (y2 - y) then 1 else 0 end) % 2 = 1)
    select pid, coalesce(min(id), -1) as fid, count(id) as n from q left join hit using (pid) group by 1""")
def point_in_polygon(spark, sf_dir):
    """For every point the first of all polygons that hold it, and how many do; candidates by tiles."""
    p, q = polygons(spark, sf_dir).withColumnRenamed("id", "fid"), spots(spark, sf_dir)
    n = G.containing(q, p, 4.0).groupBy("pid").agg(F.count("fid").alias("n"))
    return G.first_containing(q, p, 4.0).join(n, "pid", "left").select("pid", F.coalesce("fid", F.lit(-1)).alias("fid"), F.coalesce("n", F.lit(0)).alias("n"))


GRID = G.Grid()


def forward_sql(g: G.Grid, source: str, x: str, y: str) -> str:
    """SQL of the series of the transverse Mercator projection: source has id, lon, lat in degrees."""
    e = g.ellipsoid.e2**0.5
    terms = lambda f, h, u: " + ".join([u, *(f"({c!r} * {f}({2 * k} * xi) * {h}({2 * k} * eta))" for k, c in enumerate(g.series(G.FORWARD), 1))])
    return f"""{source}_t as (select *, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) as t, radians(lon - ({g.central_meridian})) as lam from {source}),
    {source}_c as (select *, atan2(t, cos(lam)) as xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) as eta from {source}_t),
    {source}_p as (select *, {g.easting} + {g.radius!r} * ({terms("cos", "sinh", "eta")}) as {x}, {g.northing} + {g.radius!r} * ({terms("sin", "cosh", "xi")}) as {y} from {source}_c)"""


def inverse_sql(g: G.Grid, source: str, x: str, y: str) -> str:
    """SQL of the way back; the geodetic latitude comes from fixed-point steps: source has id, x, y."""
    e = g.ellipsoid.e2**0.5
    terms = lambda f, h, u: " - ".join([u, *(f"({c!r} * {f}({2 * k} * xi0) * {h}({2 * k} * eta0))" for k, c in enumerate(g.series(G.INVERSE), 1))])
    return f"""{source}_i as (select *, ({y} - {g.northing}) / {g.radius!r} as xi0, ({x} - {g.easting}) / {g.radius!r} as eta0 from {source}),
    {source}_j as (select *, {terms("sin", "cosh", "xi0")} as xi, {terms("cos", "sinh", "eta0")} as eta from {source}_i),
    {source}_k as (select *, asin(sin(xi) / cosh(eta)) as chi, {g.central_meridian} + degrees(atan2(sinh(eta), cos(xi))) as lon from {source}_j),
    {source}_l as (select *, list_reduce(list_transform(range(0, 13), lambda i: chi), lambda phi, c: asin(tanh(atanh(sin(c)) + {e!r} * atanh({e!r} * sin(phi))))) as phi from {source}_k),
    {source}_q as (select * exclude (xi0, eta0, xi, eta, chi, phi), degrees(phi) as lat from {source}_l)"""


PLACES = "p as (select s_suppkey as id, -54 + (s_suppkey % 60) / 10 as lon, -12 + (s_suppkey % 110) / 10 as lat from supplier)"


def places(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (-54 + F.col("s_suppkey") % 60 / 10).alias("lon"), (-12 + F.col("s_suppkey") % 110 / 10).alias("lat"))


@query(f"with {PLACES}, {forward_sql(GRID, 'p', 'x', 'y')} select id, round(x, 4) as x, round(y, 4) as y from p_p")
def projection_forward(spark, sf_dir):
    """Degrees to the grid."""
    return rounded(places(spark, sf_dir).select("id", G.to_grid(GRID, F.col("lon"), F.col("lat")).alias("p")).select("id", "p.x", "p.y"), "x", "y", digits=4)


@query("with p as (select s_suppkey as id, -54 + (s_suppkey % 60) / 10 as lon, -12 + (s_suppkey % 110) / 10 as lat from supplier) select id, round(lon, 7) + 0.0 as lon, round(lat, 7) + 0.0 as lat from p")
def projection_round_trip(spark, sf_dir):
    """Degrees to the grid and back."""
    g = G.Grid()
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (-54 + F.col("s_suppkey") % 60 / 10).alias("lon"), (-12 + F.col("s_suppkey") % 110 / 10).alias("lat"))
    m = p.select("id", G.to_grid(g, F.col("lon"), F.col("lat")).alias("p"))
    back = m.select("id", G.from_grid(g, F.col("p.x"), F.col("p.y")).alias("q"))
    return rounded(back.select("id", F.col("q.x").alias("lon"), F.col("q.y").alias("lat")), "lon", "lat", digits=7)


OLD = G.Grid(G.GRS67)
GEO = f"""geo as (select *, {G.GRS67.a} / sqrt(1 - {G.GRS67.e2!r} * power(sin(radians(lat)), 2)) as nu from g_q),
    xyz as (select id, nu * cos(radians(lat)) * cos(radians(lon)) + ({G.OLDER_DATUM[0]}) as gx, nu * cos(radians(lat)) * sin(radians(lon)) + ({G.OLDER_DATUM[1]}) as gy, nu * (1 - {G.GRS67.e2!r}) * sin(radians(lat)) + ({G.OLDER_DATUM[2]}) as gz from geo),
    low as (select id, gx, gy, gz, sqrt(gx * gx + gy * gy) as rho from xyz),
    back as (select id, degrees(atan2(gy, gx)) as lon, degrees(list_reduce(list_transform(range(0, 13), lambda i: atan2(gz, rho * (1 - {G.WGS84.e2!r}))), lambda phi, c: atan2(gz + {G.WGS84.e2!r} * {G.WGS84.a} / sqrt(1 - {G.WGS84.e2!r} * power(sin(phi), 2)) * sin(phi), rho))) as lat from low)"""


@query(f"with g as (select s_suppkey as id, 280000 + s_suppkey % 500 * 900.0 as x, 9200000 + s_suppkey % 400 * 1000.0 as y from supplier), {inverse_sql(OLD, 'g', 'x', 'y')}, {GEO}, {forward_sql(GRID, 'back', 'x', 'y')} select id, round(x, 3) as x, round(y, 3) as y from back_p")
def datum_shift(spark, sf_dir):
    """Grid points moved between datums."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (280_000 + F.col("s_suppkey") % 500 * 900.0).alias("x"), (9_200_000 + F.col("s_suppkey") % 400 * 1000.0).alias("y"))
    return rounded(G.shift_datum(p, OLD, GRID), "x", "y", digits=3)


@query("select s_suppkey as id, round(((s_suppkey * 37 % 720 - 100 + 180) % 360 + 360) % 360 - 180, 6) + 0.0 as d from supplier")
def angle_difference(spark, sf_dir):
    return rounded(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), G.signed_difference((F.col("s_suppkey") * 37 % 720).cast("double"), 100.0).alias("d")), "d")


@query("with x as (select p_partkey as id, (p_retailprice - 1000) / 7 as x from part), y as (select id, x, case when x > 0 then power(10, floor(log10(x))) end as p from x) select id, round(case when x <= 0 then 1000 else (select min(n * p) from (values (1), (2), (5), (10)) t(n) where n * p >= x) end, 6)::double as nice from y")
def nice_scale(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), G.nice_length((F.col("p_retailprice") - 1000) / 7).alias("nice")), "nice")


@query("select p_partkey as id, trim(regexp_replace(p_brand || ' (' || p_name || ')', '[^0-9A-Za-z]+', '_', 'g'), '_') as token, try_cast(nullif(regexp_extract('PC' || p_size, '^PC([0-9]+)$', 1), '') as int) - 1 as pc, try_cast(regexp_extract(p_brand, '#(.*)', 1) as double) as number from part")
def name_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), file_token(F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")"))).alias("token"), component_index(F.concat(F.lit("PC"), F.col("p_size").cast("string"))).alias("pc"), safe_number(F.regexp_extract("p_brand", "#(.*)", 1)).alias("number"))


@query("""with v as (select p_partkey as id, case p_partkey % 7 when 0 then 'TMI' when 1 then ' mag ' when 2 then 'rad-eu' when 3 then 'Radiometric U' when 4 then 'u' when 5 then p_name else 'Thorium' end as name from part), k as (select *, replace(replace(upper(trim(name)), ' ', '_'), '-', '_') as key from v)
    select id, case when key in ('TMI', 'MAG') then name || ' (nT)' when key in ('RADIOMETRIC_U', 'RAD_U', 'RAD_EU', 'EU', 'U') then 'eU (ppm)' else name end as label from k""")
def display_labels(spark, sf_dir):
    """Variables' labels with units."""
    some = ["TMI", " mag ", "rad-eu", "Radiometric U", "u"]
    name = F.get(F.array(*map(F.lit, some)), (F.col("p_partkey") % 7).cast("int"))
    name = F.when(F.col("p_partkey") % 7 < 5, name).when(F.col("p_partkey") % 7 == 5, F.col("p_name")).otherwise("Thorium")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label_with_unit(name).alias("label"))


@query("""with f as (select p_partkey as id, 'out/dep=' || p_size || '/method=' || lower(p_type) || '/k=' || p_size || '-' || (p_size + 3) || '/alpha=' || (p_partkey % 10) || 'p' || (p_partkey % 4) as folder from part)
    select id, regexp_extract(folder, 'dep=([0-9]+)', 1)::int as dep_id, regexp_extract(folder, 'method=([^/]+)', 1) as method, regexp_extract(folder, 'k=([0-9]+)-', 1)::int as k1, regexp_extract(folder, 'k=[0-9]+-([0-9]+)', 1)::int as k2, replace(regexp_extract(folder, 'alpha=([^/]+)', 1), 'p', '.')::double as alpha from f""")
def parsed_cases(spark, sf_dir):
    """Settings read back from the names of result folders."""
    n = lambda c: F.col(c).cast("string")
    folder = F.concat(F.lit("out/dep="), n("p_size"), F.lit("/method="), F.lower("p_type"), F.lit("/k="), n("p_size"), F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit("/alpha="), (F.col("p_partkey") % 10).cast("string"), F.lit("p"), (F.col("p_partkey") % 4).cast("string"))
    got = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parse_case(folder).alias("p"))
    return got.select("id", "p.dep_id", "p.method", F.get("p.ks", F.lit(0)).alias("k1"), F.get("p.ks", F.lit(1)).alias("k2"), "p.alpha")


@query("select s_suppkey as id, round(0.5 * 64 * sin(2 * pi() / 64) * 2.5 * 2.5, 6) as area, (s_suppkey % 9) - 2.5 as x0, (s_suppkey % 9) + 2.5 as x1 from supplier")
def circle_layer(spark, sf_dir):
    """Circles about centres as polygons of 64 corners: area and extent."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 9).cast("double").alias("cx"), F.lit(4.0).alias("cy"))
    layer = circles_layer(c, 2.5).select("id", G.area(F.col("rings")).alias("area"), G.bounds(F.col("rings")).alias("b"))
    return rounded(layer.select("id", "area", "b.x0", "b.x1"), "area", "x0", "x1")


@query("with v as (select l_orderkey % 60 as g, l_linenumber as r, l_quantity as c, avg(l_tax + l_discount * 3 + l_extendedprice / 1e6) as v from lineitem group by 1, 2, 3), q as (select g, quantile_cont(v, 0.1) as lo, quantile_cont(v, 0.9) as hi from v group by 1), m as (select g, avg(r) filter (where v <= lo) as rl, avg(c) filter (where v <= lo) as cl, avg(r) filter (where v >= hi) as rh, avg(c) filter (where v >= hi) as ch from v join q using (g) group by 1) select g, round((degrees(atan2(ch - cl, rl - rh)) + 360) % 360, 4) as azimuth from m")
def dipole_azimuth(spark, sf_dir):
    """Direction from the lowest values' centroid to the highest's."""
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 60).alias("g"), F.col("l_linenumber").alias("r"), F.col("l_quantity").alias("c")).agg(F.avg(F.col("l_tax") + F.col("l_discount") * 3 + F.col("l_extendedprice") / 1e6).alias("v"))
    return rounded(G.dipole_azimuth(cells, ["g"]), "azimuth", digits=4)


CORNERS = "g as (select s_suppkey * 3 + j.range as id, 280000 + s_suppkey % 500 * 900.0 + case when j.range = 1 then 900 else 0 end as x, 9200000 + s_suppkey % 400 * 1000.0 + case when j.range = 2 then 700 else 0 end as y from supplier, range(0, 3) j)"


@query(f"""with {CORNERS}, {inverse_sql(OLD, 'g', 'x', 'y')}, {GEO}, {forward_sql(GRID, 'back', 'x', 'y')},
    t as (select id // 3 as id, list(x order by id) as x, list(y order by id) as y from back_p group by 1)
    select id, round(x[1], 3) as x, round(y[1], 3) as y, round(x[2], 3) as x2, round(y[3], 3) as y3 from t""")
def reprojected_layer(spark, sf_dir):
    """Triangles in a zone of the older datum, led through degrees and the geocentric shift to the present zone."""
    x, y = 280_000 + F.col("s_suppkey") % 500 * 900.0, 9_200_000 + F.col("s_suppkey") % 400 * 1000.0
    point = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.array(point(0, 0), point(900, 0), point(0, 700))).alias("rings"))
    moved = G.reproject(p, "EPSG:29192", "EPSG:32722")
    at = lambda i: F.get(F.get("rings", F.lit(0)), F.lit(i))
    return rounded(moved.select("id", at(0)["x"].alias("x"), at(0)["y"].alias("y"), at(1)["x"].alias("x2"), at(2)["y"].alias("y3")), "x", "y", "x2", "y3", digits=3)


@query(f"with {PLACES}, {forward_sql(G.system('EPSG:31982').grid, 'p', 'x', 'y')} select id, round(x, 4) as x, round(y, 4) as y from p_p")
def sirgas_zone(spark, sf_dir):
    """Degrees of one datum to a zone of its own, as a layer of points."""
    p = places(spark, sf_dir).select("id", F.array(F.array(F.struct(F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y")))).alias("rings"))
    first = F.get(F.get("rings", F.lit(0)), F.lit(0))
    return rounded(G.reproject(p, "EPSG:4674", "EPSG:31982").select("id", first["x"].alias("x"), first["y"].alias("y")), "x", "y", digits=4)
