"""Overlay, repair, dissolving and round buffers of polygons, by an arrangement of their edges; only DataFrame functions.

Edges are held to a fine square grid, so that equal points are equal numbers, and are split where they meet, which tiles
find. The winding number beside each piece tells whether it bounds the wanted area; pieces that do are linked at their
ends, and rings are found by pointer doubling. Work on a group follows its number of edges and meetings: windings are
carried along rows of tiles by running sums, and only pieces of one tile are compared with each other. Many polygons of a
group are united by batches of neighbours, of which only the border goes on, so that covered edges don't meet all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import RINGS, bound, bounds, named, signed_area
from .ordering import Rounds, cut, number

#: Groups whose extents are sent to all tasks (some tens of bytes each); those of more groups are joined by a shuffle.
BROADCAST_GROUPS = 500_000
POINT = "struct<x:bigint,y:bigint>"
SEGMENT = ["x1", "y1", "x2", "y2"]
#: Tile borders lie so far below steps of the grid that neither ends of edges nor lines between two ends meet a tile's corner.
OFF_X, OFF_Y = 0.5, 0.5 * (3 - 5**0.5)
#: Distance, in steps of the grid, within which an edge is led through another's end.
NEAR = 0.75
#: Polygons, then borders of batches, that are arranged together where many are united.
BATCH = 16


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def ordered(edges: DataFrame) -> DataFrame:
    """edges turned so that they run to the right, or straight up; the windings wa and wb change their sign with it."""
    back = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    pick = lambda a, b: F.when(back, F.col(a)).otherwise(F.col(b))
    turned = edges.select("gid", pick("x2", "x1").alias("a1"), pick("y2", "y1").alias("b1"), pick("x1", "x2").alias("a2"), pick("y1", "y2").alias("b2"), *[F.when(back, -F.col(w)).otherwise(F.col(w)).alias(w) for w in ("wa", "wb")])
    turned = turned.toDF("gid", *SEGMENT, "wa", "wb").where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    summed = turned.groupBy("gid", *SEGMENT).agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    return summed.where((F.col("wa") != 0) | (F.col("wb") != 0))


def edges_of(parts: DataFrame, snap: float) -> DataFrame:
    """(gid, x1, y1, x2, y2, wa, wb) of polygons (gid, side, rings) in steps of snap; equal edges are one, opposite ones none.

    wa and wb are how often the polygons of side 0 and 1 run along an edge, counted so that outlines run anticlockwise; with
    a column w they are counted as they run, w times.
    """
    sign = F.when(signed_area(F.get(F.col("rings"), F.lit(0))) < 0, -1).otherwise(1).cast("long")
    rings = parts.where(F.size("rings") > 0).select("gid", "side", F.col("w") if "w" in parts.columns else sign.alias("w"), F.explode("rings").alias("ring"))
    held = F.transform("ring", lambda p: point(F.round(p["x"] / snap).cast("long"), F.round(p["y"] / snap).cast("long")))
    rings = rings.select("gid", "side", "w", held.alias("ring"))
    n = F.size("ring")
    edge = F.transform("ring", lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.element_at("ring", (i + 1) % n + 1)["x"].alias("x2"), F.element_at("ring", (i + 1) % n + 1)["y"].alias("y2")))
    rows = rings.where(n > 1).select("gid", "side", "w", F.explode(edge).alias("e")).select("gid", "side", "w", "e.*")
    of = lambda s: F.when(F.col("side") == s, F.col("w")).otherwise(F.lit(0).cast("long"))
    return ordered(rows.select("gid", *SEGMENT, of(0).alias("wa"), of(1).alias("wb")))


def tiled(edges: DataFrame) -> DataFrame:
    """edges with tile: the side of their group's tiles, about as many tiles as edges. Tile borders lie between grid steps."""
    wide = F.greatest(F.max("x2") - F.min("x1"), F.greatest(F.max("y1"), F.max("y2")) - F.least(F.min("y1"), F.min("y2")))
    sizes = cut(edges.groupBy("gid").agg(F.greatest(F.ceil((wide + 1) / F.ceil(F.sqrt(F.count(F.lit(1))))), F.lit(4)).cast("long").alias("tile")))
    return edges.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_GROUPS else sizes, "gid")


def column_of(x: Column) -> Column:
    """Number of the column of tiles of a coordinate; borders lie OFF_X steps below whole multiples of the side."""
    return F.floor((x + OFF_X) / F.col("tile"))


def row_of(y: Column) -> Column:
    return F.floor((y + OFF_Y) / F.col("tile"))


def in_tiles(edges: DataFrame) -> DataFrame:
    """edges (tiled) once for each tile (tx, ty) that they pass through, or may."""
    strips = edges.withColumn("ty", F.explode(F.sequence(row_of(F.least("y1", "y2")), row_of(F.greatest("y1", "y2")))))
    rise = F.col("y2") - F.col("y1")
    at = lambda y: F.col("x1") + F.least(F.greatest((y - F.col("y1")) / F.when(rise != 0, rise), F.lit(0.0)), F.lit(1.0)) * (F.col("x2") - F.col("x1"))
    a, b = at(F.col("ty") * F.col("tile") - 1.5), at((F.col("ty") + 1) * F.col("tile") + 0.5)
    left, right = F.when(rise == 0, F.col("x1")).otherwise(F.least(a, b) - 1), F.when(rise == 0, F.col("x2")).otherwise(F.greatest(a, b) + 1)
    return strips.withColumn("tx", F.explode(F.sequence(column_of(left), column_of(right))))


def near(px: str, py: str, s: str) -> Column:
    """Whether a point lies within NEAR of an edge s, and beside it rather than beyond its ends."""
    x1, y1, dx, dy = F.col(f"{s}x1"), F.col(f"{s}y1"), F.col(f"{s}x2") - F.col(f"{s}x1"), F.col(f"{s}y2") - F.col(f"{s}y1")
    qx, qy = (F.col(px) - x1).cast("double"), (F.col(py) - y1).cast("double")
    square = dx.cast("double") * dx + dy.cast("double") * dy
    along, off = qx * dx + qy * dy, qx * dy - qy * dx
    return (along > 0) & (along < square) & (off * off <= NEAR * NEAR * square)


def split(edges: DataFrame) -> DataFrame:
    """edges cut where they meet others of their group: at crossings, at ends of others, along shared stretches."""
    edges = cut(edges)
    spread = in_tiles(tiled(edges)).select("gid", "tx", "ty", *SEGMENT)
    a, b = (spread.toDF("gid", "tx", "ty", *[f"{s}{c}" for c in SEGMENT]) for s in "ab")
    ends = lambda s: F.struct(*[f"{s}{c}" for c in SEGMENT])
    apart = (F.col("ax2") + 1 < F.col("bx1")) | (F.col("bx2") + 1 < F.col("ax1")) | (F.greatest("ay1", "ay2") + 1 < F.least("by1", "by2")) | (F.greatest("by1", "by2") + 1 < F.least("ay1", "ay2"))
    pairs = a.join(b, ["gid", "tx", "ty"]).where((ends("a") < ends("b")) & ~apart)
    flags = {"b1 on a": near("bx1", "by1", "a"), "b2 on a": near("bx2", "by2", "a"), "a1 on b": near("ax1", "ay1", "b"), "a2 on b": near("ax2", "ay2", "b")}
    pairs = pairs.withColumns(flags)
    dx, dy, ex, ey = (F.col(f"{s}{c}2").cast("double") - F.col(f"{s}{c}1") for s, c in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")))
    qx, qy = F.col("bx1").cast("double") - F.col("ax1"), F.col("by1").cast("double") - F.col("ay1")
    den = dx * ey - dy * ex
    t, u = (qx * ey - qy * ex) / F.when(den != 0, den), (qx * dy - qy * dx) / F.when(den != 0, den)
    met = F.col("b1 on a") | F.col("b2 on a") | F.col("a1 on b") | F.col("a2 on b")
    crossing = F.when(~met & (t > 0) & (t < 1) & (u > 0) & (u < 1), point(F.round(F.col("ax1") + t * dx).cast("long"), F.round(F.col("ay1") + t * dy).cast("long")))
    pairs = pairs.withColumn("crossing", crossing)

    def cuts(s: str, o: str) -> DataFrame:
        found = F.array(F.col("crossing"), *[F.when(F.col(f"{o}{k} on {s}"), point(F.col(f"{o}x{k}"), F.col(f"{o}y{k}"))) for k in (1, 2)])
        return pairs.select("gid", *[F.col(f"{s}{c}").alias(c) for c in SEGMENT], F.explode(F.array_compact(found)).alias("p"))

    none = F.lit(None).cast("long")
    own = edges.select("gid", *SEGMENT, F.explode(F.array(point(F.col("x1"), F.col("y1")), point(F.col("x2"), F.col("y2")))).alias("p"), "wa", "wb")
    every = own.unionByName(cuts("a", "b").unionByName(cuts("b", "a")).withColumns({"wa": none, "wb": none}))
    along = (F.col("p.x") - F.col("x1")).cast("double") * (F.col("x2") - F.col("x1")) + (F.col("p.y") - F.col("y1")).cast("double") * (F.col("y2") - F.col("y1"))
    line = every.groupBy("gid", *SEGMENT).agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), F.col("p.x").alias("x"), F.col("p.y").alias("y")))).alias("line"), F.max("wa").alias("wa"), F.max("wb").alias("wb"))
    pieces = F.transform(F.slice("line", 1, F.size("line") - 1), lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(F.col("line"), i + 1)["x"].alias("x2"), F.get(F.col("line"), i + 1)["y"].alias("y2")))
    return ordered(line.select("gid", "wa", "wb", F.explode(pieces).alias("e")).select("gid", "e.*", "wa", "wb"))


def windings(pieces: DataFrame) -> DataFrame:
    """pieces with la, ra, lb, rb: the winding numbers of both sides to their left and right.

    The winding right of a piece's middle (above it, where it is level) is that at the lower right corner of the middle's
    tile, and what the way there crosses: right to the border, then down. At the corner it is a running sum over the
    crossings of the row of tiles' lower border farther right.
    """
    pieces = cut(tiled(pieces))
    rise = F.col("y2") - F.col("y1")
    up = F.signum(rise.cast("double")).cast("long")
    # Crossings of lower borders, by tile.
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    border = pieces.where(row_of(low) < row_of(high)).withColumn("ty", F.explode(F.sequence(row_of(low) + 1, row_of(high))))
    at = F.col("x1") + (F.col("ty") * F.col("tile") - OFF_Y - F.col("y1")) / rise * (F.col("x2") - F.col("x1"))
    border = border.select("gid", "ty", column_of(at).alias("tx"), (F.col("wa") * up).alias("a"), (F.col("wb") * up).alias("b"))
    middle = pieces.withColumns({"xm": (F.col("x1") + F.col("x2")) / 2, "ym": (F.col("y1") + F.col("y2")) / 2})
    middle = middle.withColumns({"tx": column_of(F.col("xm")), "ty": row_of(F.col("ym"))})
    zero = F.lit(0).cast("long")
    marks = border.unionByName(middle.select("gid", "ty", "tx", zero.alias("a"), zero.alias("b"))).groupBy("gid", "ty", "tx").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    farther = Window.partitionBy("gid", "ty").orderBy(F.desc("tx")).rowsBetween(Window.unboundedPreceding, -1)
    corner = marks.select("gid", "ty", "tx", *[F.coalesce(F.sum(c).over(farther), zero).alias(f"corner {c}") for c in "ab"])
    # The way from the middle to the corner, past the pieces of the tile.
    others = in_tiles(pieces).select("gid", "tx", "ty", *[F.col(c).alias(f"o {c}") for c in (*SEGMENT, "wa", "wb")])
    ox1, oy1, ox2, oy2 = (F.col(f"o {c}") for c in SEGMENT)
    right = (F.col("tx") + 1) * F.col("tile") - OFF_X
    floor = F.col("ty") * F.col("tile") - OFF_Y
    level = F.col("ym")
    spans = ((oy1 <= level) & (oy2 > level)) | ((oy2 <= level) & (oy1 > level))
    over_x = ox1 + (level - oy1) / F.when(oy1 != oy2, oy2 - oy1) * (ox2 - ox1)
    itself = (ox1 == F.col("x1")) & (oy1 == F.col("y1")) & (ox2 == F.col("x2")) & (oy2 == F.col("y2"))
    passed = F.when(spans & ~itself & (over_x > F.col("xm")) & (over_x < right), F.signum((oy2 - oy1).cast("double")).cast("long")).otherwise(zero)
    over_y = oy1 + (right - ox1) / F.when(ox1 != ox2, ox2 - ox1) * (oy2 - oy1)
    fallen = F.when((ox1 < right) & (ox2 > right) & (over_y > floor) & (over_y <= level), F.lit(1).cast("long")).otherwise(zero)
    way = middle.join(others, ["gid", "tx", "ty"], "left").withColumn("k", passed + fallen)
    way = way.groupBy("gid", *SEGMENT, "wa", "wb", "tx", "ty").agg(*[F.sum(F.col("k") * F.coalesce(f"o w{c}", zero)).alias(f"way {c}") for c in "ab"])
    way = way.join(corner, ["gid", "ty", "tx"])
    rising = F.col("y2") > F.col("y1")
    side = {}
    for c in "ab":
        here = F.col(f"corner {c}") + F.coalesce(f"way {c}", zero)
        side[f"l{c}"] = F.when(rising, here + F.col(f"w{c}")).otherwise(here)
        side[f"r{c}"] = F.when(rising, here).otherwise(here - F.col(f"w{c}"))
    return way.withColumns(side).select("gid", *SEGMENT, *side)


def rings_of(edges: DataFrame, snap: float) -> DataFrame:
    """(gid, rings) from directed edges (gid, x1, y1, x2, y2) that have the area on their right: outlines run clockwise.

    At a point where several rings meet, an edge goes on with the next one anticlockwise from where it came, so that the
    area between them stays one and areas that only touch are rings of their own. Pointer doubling finds the smallest edge
    of each ring and every edge's distance to it.
    """
    edges = cut(edges.select("gid", *SEGMENT).withColumn("e", F.monotonically_increasing_id()))
    angle = lambda ax, ay, bx, by: F.atan2((F.col(by) - F.col(ay)).cast("double"), (F.col(bx) - F.col(ax)).cast("double"))
    leaving = edges.select("gid", F.col("x1").alias("x"), F.col("y1").alias("y"), angle("x1", "y1", "x2", "y2").alias("angle"), F.lit(None).cast("long").alias("came"), F.col("e").alias("goes"))
    coming = edges.select("gid", F.col("x2").alias("x"), F.col("y2").alias("y"), angle("x2", "y2", "x1", "y1").alias("angle"), F.col("e").alias("came"), F.lit(None).cast("long").alias("goes"))
    around = Window.partitionBy("gid", "x", "y").orderBy("angle")
    later = F.first("goes", ignorenulls=True).over(around.rowsBetween(1, Window.unboundedFollowing))
    first = F.first("goes", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    links = leaving.unionByName(coming).withColumn("to", F.coalesce(later, first)).where("came is not null and to is not null")
    rounds = Rounds(edges.sparkSession)
    now = rounds.write(links.select(F.col("came").alias("e"), "to", F.col("came").alias("least"), F.lit(0).cast("long").alias("away")))
    reach = 1
    while True:
        ahead = now.select(F.col("e").alias("to"), F.col("to").alias("next"), F.col("least").alias("there"), F.col("away").alias("further"))
        lower = F.col("there") < F.col("least")
        moved = rounds.write(now.join(ahead, "to").select("e", F.col("next").alias("to"), F.least("least", "there").alias("least"), F.when(lower, reach + F.col("further")).otherwise(F.col("away")).alias("away"), lower.alias("changed")))
        now, reach = moved.drop("changed"), 2 * reach
        if not moved.where("changed").limit(1).count():
            break
    line = now.join(edges, "e").groupBy("gid", "least").agg(F.array_sort(F.collect_list(F.struct((-F.col("away")).alias("place"), F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("line"))
    # The smallest edge is 0 away and comes last of the falling distances: any start gives the same ring. Points between two
    # others in a line go.
    n = F.size("line")

    def turns(p: Column, i: Column) -> Column:
        a, b = F.element_at("line", (i + n - 1) % n + 1), F.element_at("line", (i + 1) % n + 1)
        dx, dy = (b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double")
        off = (p["x"] - a["x"]) * dy - (p["y"] - a["y"]) * dx
        return off * off > NEAR * NEAR * (dx * dx + dy * dy)

    rings = line.select("gid", F.transform(F.filter("line", turns), lambda p: F.struct((p["x"] * snap).alias("x"), (p["y"] * snap).alias("y"))).alias("ring")).where(F.size("ring") > 2)
    rings = rings.withColumn("area", signed_area(F.col("ring")))
    return rings.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("area", "ring"))).alias("r")).select("gid", F.transform("r", lambda r: r["ring"]).alias("rings"))


RULES = {"nonzero": lambda w: w != 0, "evenodd": lambda w: w % 2 != 0, "positive": lambda w: w > 0}
WAYS = {"union": lambda a, b: a | b, "intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "either": lambda a, b: a != b, "first": lambda a, b: a}


def bordering(edges: DataFrame, inside) -> DataFrame:
    """Edges in the form of edges_of, wa alone, that bound the area of which inside("l") and inside("r") say whether it lies
    left and right of a piece; pieces of equal sides are left out."""
    sided = windings(split(edges)).withColumns({"on left": inside("l"), "on right": inside("r")}).where(F.col("on left") != F.col("on right"))
    return sided.select("gid", *SEGMENT, F.when(F.col("on left"), 1).otherwise(-1).cast("long").alias("wa"), F.lit(0).cast("long").alias("wb"))


def turned(edges: DataFrame) -> DataFrame:
    """Edges of edges_of, run once, as directed ones that have the area on their right."""
    back = F.col("wa") > 0
    pick = lambda a, b: F.when(back, F.col(a)).otherwise(F.col(b))
    return edges.select("gid", pick("x2", "x1").alias("a1"), pick("y2", "y1").alias("b1"), pick("x1", "x2").alias("a2"), pick("y1", "y2").alias("b2")).toDF("gid", *SEGMENT)


def combined(parts: DataFrame, way: str = "union", rules: tuple[str, str] = ("nonzero", "nonzero"), snap: float = 1e-7) -> DataFrame:
    """(gid, rings) of the area that polygons (gid, side, rings) of sides 0 and 1 give together, by group; every gid has a row.

    way: union, intersection, difference, either (in one but not both) or first (side 0 alone). A side may have many
    polygons, which are united; rules tell for each side which winding numbers lie inside. Coordinates are held to multiples
    of snap, and edges that come within three quarters of it count as meeting. Rings keep to the layer's convention: outlines
    first and clockwise, holes anticlockwise; a group without area has an empty array. Null or empty polygons have no area.
    """
    kept = turned(bordering(edges_of(parts, snap), lambda k: WAYS[way](RULES[rules[0]](F.col(f"{k}a")), RULES[rules[1]](F.col(f"{k}b")))))
    # Rings are read many times by whatever measures them, so they are made once.
    return cut(parts.select("gid").distinct().join(rings_of(kept, snap), "gid", "left").withColumn("rings", F.coalesce("rings", F.array().cast(RINGS))))


def overlay(a: DataFrame, b: DataFrame, way: str, key: str = "fid", snap: float = 1e-7) -> DataFrame:
    """(key, rings): polygons of a and b with equal keys combined; a key of one side alone meets nothing."""
    side = lambda df, k: df.select(F.col(key).alias("gid"), F.lit(k).alias("side"), "rings")
    return combined(side(a, 0).unionByName(side(b, 1)), way, snap=snap).withColumnRenamed("gid", key)


def repair(layer: DataFrame, key: str = "fid", snap: float = 1e-7) -> DataFrame:
    """(key, rings) without crossings: what an odd number of windings encloses stays, so both lobes of a bow tie do."""
    return combined(layer.select(F.col(key).alias("gid"), F.lit(0).alias("side"), "rings"), "first", ("evenodd", "nonzero"), snap).withColumnRenamed("gid", key)


def convex(ring: Column, snap: float) -> Column:
    """Whether a ring without repeated points runs anticlockwise once about a convex area, with corners well above snap."""
    n = F.size(ring)

    def corner(p: Column, i: Column) -> Column:
        a, b = F.element_at(ring, (i + n - 1) % n + 1), F.element_at(ring, (i + 1) % n + 1)
        ways = bound(named(a=a, b=b), lambda k: named(ux=p["x"] - k["a"]["x"], uy=p["y"] - k["a"]["y"], vx=k["b"]["x"] - p["x"], vy=k["b"]["y"] - p["y"]))
        sides = bound(ways, lambda w: named(cross=w["ux"] * w["vy"] - w["uy"] * w["vx"], dot=w["ux"] * w["vx"] + w["uy"] * w["vy"], long=F.greatest(F.hypot(w["ux"], w["uy"]), F.hypot(w["vx"], w["vy"]))))
        # A corner that doesn't stand out to the left counts as turning too far.
        return bound(sides, lambda k: F.when(k["cross"] > 16 * snap * k["long"], F.atan2(k["cross"], k["dot"])).otherwise(4 * F.pi()))

    return F.when(n < 3, False).otherwise(F.aggregate(F.transform(ring, corner), F.lit(0.0), lambda a, v: a + v) < 3 * F.pi())


def sorted_out(layer: DataFrame, snap: float) -> DataFrame:
    """(gid, rings, ring, k) of polygons (gid, rings), each once in its group: ring is the only ring of a polygon that is
    convex, anticlockwise, else null; k is the number of polygons of the group. Polygons are dealt to all tasks."""
    once = layer.select("gid", "rings").distinct()
    ring = once.withColumn("ring", F.when(F.size("rings") == 1, F.get(plain_rings(F.col("rings"), True), F.lit(0))))
    ring = cut(ring.withColumn("ring", F.when(convex(F.col("ring"), snap), F.col("ring"))))
    return ring.join(ring.groupBy("gid").agg(F.count(F.lit(1)).alias("k")), "gid", "left")


def alone() -> Column:
    """Whether a polygon of sorted_out is convex and all that its group has, so that nothing has to be arranged."""
    return F.coalesce((F.col("k") == 1) & F.col("ring").isNotNull(), F.lit(False))


def as_layer(ring: Column, snap: float) -> Column:
    """An anticlockwise ring as the only one of a polygon, clockwise, in steps of snap."""
    return F.array(F.reverse(F.transform(ring, lambda p: named(x=F.round(p["x"] / snap) * snap, y=F.round(p["y"] / snap) * snap))))


def neighbours_numbered(polygons: DataFrame) -> DataFrame:
    """polygons of sorted_out with n, from 0 in each group: by strips of centres, then up, so that near ones are near in number."""
    b = polygons.withColumn("box", bounds(F.col("rings"))).select("gid", "rings", "ring", "k", ((F.col("box.x0") + F.col("box.x1")) / 2).alias("cx"), ((F.col("box.y0") + F.col("box.y1")) / 2).alias("cy"))
    wide = b.groupBy("gid").agg(F.min("cx").alias("low"), F.max("cx").alias("high"))
    strip = F.floor((F.col("cx") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")) * F.ceil(F.sqrt(F.col("k") / BATCH)))
    placed = b.join(wide, "gid").select("gid", "rings", "ring", "k", F.coalesce(strip, F.lit(0)).alias("strip"), "cy")
    return number(placed, ["gid"], ["strip", "cy", F.xxhash64("rings")], "n").select("gid", "rings", "ring", "k", (F.col("n") - 1).alias("n"))


def united(polygons: DataFrame, snap: float) -> DataFrame:
    """Edges, in the form of edges_of, that bound what the polygons of each group (of sorted_out) cover.

    A polygon that isn't convex is freed of its own crossings first. Then batches of BATCH neighbours are arranged, and in
    further rounds the borders of so many batches, until a group is one: what a batch covers meets no other edges. So work
    follows the number of polygons and the length of the borders, not the number of pairs that overlap.
    """
    nonzero = lambda k: F.col(f"{k}a") != 0
    many = polygons.where("k > 1")
    placed = polygons.where("k = 1").select("gid", "rings", "ring", "k", F.lit(0).cast("long").alias("n"))
    if not many.isEmpty():
        placed = placed.unionByName(neighbours_numbered(many))
    placed = cut(placed.select(F.struct(F.col("gid").alias("g"), "n", "k").alias("gid"), F.lit(0).alias("side"), "rings", F.col("ring").isNotNull().alias("plain")))
    rounds = Rounds(polygons.sparkSession)
    edges, other = edges_of(placed.where("plain"), snap), placed.where("not plain")
    if not other.isEmpty():
        edges = edges.unionByName(bordering(edges_of(other, snap), nonzero))
    edges = rounds.write(edges)
    while not (left := edges.where("gid.k > 1")).isEmpty():
        batch = F.struct(F.col("gid.g").alias("g"), F.floor(F.col("gid.n") / BATCH).alias("n"), F.ceil(F.col("gid.k") / BATCH).alias("k"))
        edges = rounds.write(edges.where("gid.k = 1").unionByName(bordering(ordered(left.withColumn("gid", batch)), nonzero)))
    return edges.withColumn("gid", F.col("gid.g"))


def dissolve(layer: DataFrame, key: str, matched: bool = False, snap: float = 1e-7) -> DataFrame:
    """(key, rings): polygons of one key united; overlaps count once.

    matched: the polygons of a key don't overlap and neighbours share whole edges (as map units do); then edges that occur
    in both directions drop out, the others are the outline, and nothing has to be split.
    """
    parts = layer.select(F.col(key).alias("gid"), F.lit(0).alias("side"), "rings")
    if matched:
        return cut(rings_of(turned(edges_of(parts, snap)), snap)).withColumnRenamed("gid", key)
    polygons = sorted_out(parts, snap)
    done = polygons.where(alone()).select("gid", as_layer(F.col("ring"), snap).alias("rings"))
    rest = polygons.where(~alone())
    if not rest.isEmpty():
        found = rest.select("gid").distinct().join(rings_of(turned(united(rest, snap)), snap), "gid", "left")
        done = done.unionByName(found.withColumn("rings", F.coalesce("rings", F.array().cast(RINGS))))
    return cut(done).withColumnRenamed("gid", key)


def boundary_lines(layer: DataFrame, key: str, snap: float = 1e-7) -> DataFrame:
    """(a, b, x1, y1, x2, y2): edges of polygons with the two keys that meet there, a < b; b is null on the outer border.

    For layers whose neighbours share whole edges. An edge inside one key's area is no boundary.
    """
    edges = edges_of(layer.select(F.col(key).alias("gid"), F.lit(0).alias("side"), "rings"), snap)
    met = edges.groupBy(*SEGMENT).agg(F.min("gid").alias("a"), F.max("gid").alias("z"))
    return met.select("a", F.when(F.col("z") != F.col("a"), F.col("z")).alias("b"), *[(F.col(c) * snap).alias(c) for c in SEGMENT])


def offset_rings(rings: Column, distance: float, quadrant: int) -> Column:
    """Closed curves at a distance on the right of rings, with arcs about the corners that stick out there. Loops about the
    corners that don't have negative windings, so the points with positive ones are those within the distance."""

    def around(ring: Column) -> Column:
        n = F.size(ring)

        def corner(p: Column, i: Column) -> Column:
            a, b = F.element_at(ring, (i + n - 1) % n + 1), F.element_at(ring, (i + 1) % n + 1)
            normals = named(before=F.atan2(a["x"] - p["x"], p["y"] - a["y"]), after=F.atan2(p["x"] - b["x"], b["y"] - p["y"]))  # to the right
            return bound(normals, lambda w: bound(F.pmod(w["after"] - w["before"] + F.pi(), 2 * F.pi()) - F.pi(), lambda turn: about(p, w, turn)))

        def about(p: Column, w: Column, turn: Column) -> Column:
            steps = F.greatest(F.lit(1), F.ceil(turn / (F.pi() / (2 * quadrant)) - 1e-9)).cast("int")
            on = lambda v: F.struct((p["x"] + distance * F.cos(v)).alias("x"), (p["y"] + distance * F.sin(v)).alias("y"))
            arc = bound(steps, lambda n: F.transform(F.sequence(F.lit(0), n), lambda k: on(w["before"] + turn * k / n)))
            return F.when(turn >= 0, arc).otherwise(F.array(on(w["before"]), F.struct(p["x"].alias("x"), p["y"].alias("y")), on(w["after"])))

        return F.flatten(F.transform(ring, corner))

    return F.transform(rings, around)


def plain_rings(rings: Column, outward: bool) -> Column:
    """rings without points equal to the one before; outlines anticlockwise (outward) or clockwise."""
    sign = F.signum(signed_area(F.get(rings, F.lit(0)))) * (1 if outward else -1)
    kept = F.transform(rings, lambda r: F.filter(r, lambda p, i: p != F.element_at(r, F.when(i == 0, F.size(r)).otherwise(i))))
    return F.transform(F.filter(kept, lambda r: F.size(r) > 2), lambda r: F.when(sign > 0, r).otherwise(F.reverse(r)))


def buffer(layer: DataFrame, distance: float, key: str = "fid", quadrant: int = 8, snap: float = 1e-7) -> DataFrame:
    """(key, rings) grown by a distance, or shrunk by a negative one, with round corners of quadrant steps a quarter.

    A ring's offset curve winds about what the ring winds about, and once more about each strip beside an edge and each
    sector about a corner. Growing keeps the positive windings of curves outside the rings; shrinking takes away the strips
    and sectors within. Polygons of one key are united first.
    """
    layer = layer.select(F.col(key).alias("gid"), "rings")
    if distance < 0:
        return arranged_buffer(layer, distance, quadrant, snap).withColumnRenamed("gid", key)
    # About a polygon that is convex and alone the curve is convex too: nothing meets, and the curve is the result.
    polygons = sorted_out(layer, snap)
    curve = F.when(alone(), F.get(offset_rings(F.array("ring"), distance, quadrant), F.lit(0)))
    polygons = cut(polygons.withColumn("curve", curve)).withColumn("plain", F.coalesce(convex(F.col("curve"), snap), F.lit(False)))
    done = polygons.where("plain").select("gid", as_layer(F.col("curve"), snap).alias("rings"))
    rest = polygons.where("not plain")
    if not rest.isEmpty():
        done = done.unionByName(arranged_buffer(rest.select("gid", "rings"), distance, quadrant, snap))
    return cut(done).withColumnRenamed("gid", key)


def arranged_buffer(layer: DataFrame, distance: float, quadrant: int, snap: float) -> DataFrame:
    """buffer of polygons (gid, rings) by arranging their curves."""
    layer = dissolve(layer, "gid", snap=snap)
    one = F.lit(1).cast("long")
    rings = plain_rings(F.col("rings"), distance >= 0)
    curve = layer.select("gid", offset_rings(rings, abs(distance), quadrant).alias("rings"), one.alias("w"))
    if distance >= 0:
        return combined(curve.withColumn("side", F.lit(0)), "first", ("positive", "nonzero"), snap)
    solid = layer.select("gid", plain_rings(F.col("rings"), True).alias("rings"), one.alias("w"))
    both = solid.withColumn("side", F.lit(0)).unionByName(solid.withColumn("side", F.lit(1))).unionByName(curve.withColumn("side", F.lit(1)))
    return combined(both, "difference", ("nonzero", "positive"), snap)


def closed_outline(layer: DataFrame, distance: float, key: str = "fid", quadrant: int = 8, snap: float = 1e-7) -> DataFrame:
    """(key, rings): polygons of a key grown and shrunk again, so that gaps narrower than twice the distance close."""
    return buffer(buffer(layer, distance, key, quadrant, snap), -distance, key, quadrant, snap)
