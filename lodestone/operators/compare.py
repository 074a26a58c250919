"""Sweeps and comparisons of finished runs: best parameters, gains, bands, profiles, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """The row of the largest score in each group, ties to the smallest of another column."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), tie))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def sweep_tables(summary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows, the best by area, and the best k alone: the three tables of a sweep."""
    top = best(summary, ["dep_id"], "auc", "k")
    return summary, top, top.select("dep_id", "k")


def gains(scores: DataFrame, base: str) -> DataFrame:
    """scores: (grp, dep_id, score). Long table of each group's gain over the base group, null where either lacks it."""
    b = scores.where(F.col("grp") == base).select("dep_id", F.col("score").alias("base_score"))
    deps, groups = scores.select("dep_id").distinct(), scores.where(F.col("grp") != base).select("grp").distinct()
    # One table of all groups for each footprint: the result itself has a row for every footprint and group.
    lists = groups.agg(F.collect_set("grp").alias("groups"))
    every = deps.join(F.broadcast(lists)).select("dep_id", F.explode("groups").alias("grp"))  # one row of settings
    return every.join(scores, ["grp", "dep_id"], "left").join(b, "dep_id", "left").withColumn("gain", F.col("score") - F.col("base_score"))


def shared(scores: DataFrame, groups: int) -> DataFrame:
    """Footprints that every one of so many groups has."""
    return scores.groupBy("dep_id").agg(F.count_distinct("grp").alias("n")).where(F.col("n") == groups).select("dep_id")


def bands(curves: DataFrame, value: str = "y", group: list[str] | None = None) -> DataFrame:
    """Mean, extremes and 10th to 90th percentile of curves at each rank."""
    p = lambda q: F.percentile(value, F.lit(q))
    return curves.groupBy(*(group or []), "rank").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), p(0.1).alias("p10"), p(0.9).alias("p90"))


def event_counts(events: DataFrame, group: list[str] | None = None) -> DataFrame:
    return events.groupBy(*(group or []), "rank", "kind").agg(F.count(F.lit(1)).alias("n"))


def moving_average(df: DataFrame, group: list[str], order: str, value: str, width: int, name: str = "smooth") -> DataFrame:
    """Centred sums over width values divided by width: beyond the ends the profile counts as 0. width must be odd."""
    if width < 1 or width % 2 == 0:
        raise ValueError("the width must be odd")
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return df.withColumn(name, F.sum(value).over(w) / width)


def profile(cells: DataFrame, group: list[str], center: float, half_width: float, value: str = "v") -> DataFrame:
    """Mean by row of the columns within half_width of the centre column."""
    return cells.where(F.abs(F.col("c") - center) <= half_width).groupBy(*group, "r").agg(F.avg(value).alias("y"))


def normalized_profile(profiles: DataFrame, group: list[str], step: float, center: str = "middle", scale: str = "none", width: int = 1) -> DataFrame:
    """(group, r, distance, y): distance from the middle row or the peak; y less its mean, over its deviation or range
    where asked, then smoothed."""
    w = Window.partitionBy(*group)
    middle = (F.min("r").over(w) + F.max("r").over(w)) / 2 if center == "middle" else F.max_by("r", F.struct("y", -F.col("r"))).over(w)
    size = {"none": F.lit(1.0), "sd": F.stddev_pop("y").over(w), "range": F.max("y").over(w) - F.min("y").over(w)}[scale]
    out = profiles.select(*group, "r", ((F.col("r") - middle) * step).alias("distance"), ((F.col("y") - F.avg("y").over(w)) / F.when(size > 0, size).otherwise(1.0)).alias("y"))
    return moving_average(out, group, "r", "y", width, "y")


def weight_order_agreement(weights: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Spearman correlation of falling weight with the component's number, null for a single one. weights: (pc, w)."""
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("w"), "pc")
    ranked = weights.withColumn("place", F.row_number().over(w))
    rho = F.corr(F.col("place").cast("double"), F.col("pc").cast("double"))
    return ranked.groupBy(*(group or [])).agg(F.when(F.count(F.lit(1)) > 1, rho).alias("spearman"))


def adjacent_pairs(weights: DataFrame) -> DataFrame:
    """(place, pc_a, pc_b): components next to each other by falling weight."""
    order = Window.orderBy(F.desc("w"), "pc")  # one row a component
    p = weights.withColumn("place", F.row_number().over(order).cast("long")).withColumn("pc_b", F.lead("pc").over(order))
    return p.where("pc_b is not null").select("place", F.col("pc").alias("pc_a"), "pc_b")


def classify(df: DataFrame, text: str, vocabulary: dict[str, list[str]], generic: list[str] | None = None, unless: dict[str, list[str]] | None = None, sep: str = ",", key: str = "id") -> DataFrame:
    """(key, label, weight): the class that most of a text's parts belong to.

    A text is cut at sep into parts; empty ones don't count. A part belongs to a class if it holds any of its words, and
    counts once for it: by half if the whole part is a generic term. A part that holds a word of unless[class] doesn't
    count for that class. Ties go to the class named first. Texts without any have a null label and weight 0.
    """
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), sep), lambda p: F.trim(p)), lambda p: p != "")
    holds = lambda p, words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: p.contains(w)) if words else F.lit(False)
    weight = lambda p: F.when(p.isin(*[g.lower() for g in generic or []]), 0.5).otherwise(1.0) if generic else F.lit(1.0)

    def total(label: str) -> Column:
        mine = lambda p: F.when(holds(p, vocabulary[label]) & ~holds(p, (unless or {}).get(label, [])), weight(p)).otherwise(0.0)
        return F.aggregate(F.transform("parts", mine), F.lit(0.0), lambda a, v: a + v)

    scored = df.select(F.col(key), parts.alias("parts")).select(key, *[total(label).alias(f"total {i}") for i, label in enumerate(vocabulary)])
    order = F.array_max(F.array(*[F.struct(F.col(f"`total {i}`").alias("t"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, label in enumerate(vocabulary)]))
    return scored.select(key, F.when(order["t"] > 0, order["label"]).alias("label"), order["t"].alias("weight"))


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words, case aside."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return F.coalesce(out, F.lit(False))


def with_best_k(cases: DataFrame, best: DataFrame, default: int | None = None) -> DataFrame:
    """cases (with dep_id) with the k that best (dep_id, k) has for each footprint, else the default."""
    return cases.join(best.select("dep_id", "k"), "dep_id", "left").withColumn("k", F.coalesce("k", F.lit(default).cast("int")))
