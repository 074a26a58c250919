"""Resampling, permutation and leave-one-out inference on recovery results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import cut, number, quantiles


def alpha_from_single(frame: DataFrame, a: str, b: str) -> DataFrame:
    """One row: alpha = a's mean over the sum of both means, 0.5 where the sum is 0."""
    m, n = F.avg(a), F.avg(b)
    return frame.agg(F.when(m + n > 0, m / (m + n)).otherwise(0.5).alias("alpha"))


def leave_one_out(pairs: DataFrame) -> DataFrame:
    """pairs: (ref, target, a, b) with each variable's coverage of a target by a reference. For every held-out target:
    alpha learned from the other targets of all references that aren't the target, the chosen variable, its coverage.

    Conditional averages by difference of sums, so no pair of targets is made.
    """
    rows = pairs.where("ref <> target")
    by_target = rows.groupBy("target").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("tn"))
    by_ref = rows.groupBy(F.col("ref").alias("target")).agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"), F.count(F.lit(1)).alias("rn"))
    total = rows.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.count(F.lit(1)).alias("sn")).first()
    j = by_target.join(by_ref, "target", "left").na.fill(0, ["ra", "rb", "rn"])
    n = F.lit(total.sn or 0) - F.col("tn") - F.col("rn")
    ma, mb = (F.lit(total.sa or 0.0) - F.col("ta") - F.col("ra")) / n, (F.lit(total.sb or 0.0) - F.col("tb") - F.col("rb")) / n
    j = j.where(n > 0).withColumn("mean_a", ma).withColumn("mean_b", mb)
    alpha = F.when(F.col("mean_a") + F.col("mean_b") > 0, F.col("mean_a") / (F.col("mean_a") + F.col("mean_b"))).otherwise(0.5)
    return j.select("target", "mean_a", "mean_b", alpha.alias("alpha"), F.when(F.col("mean_a") >= F.col("mean_b"), "a").otherwise("b").alias("chosen"), F.when(F.col("mean_a") >= F.col("mean_b"), F.col("ta")).otherwise(F.col("tb")).alias("held_sum"), F.col("tn").alias("held_n"))


def held_out_grid(grid: DataFrame) -> DataFrame:
    """grid: (target, alpha, value). For each target the alpha of largest mean over the other targets (ties: smallest),
    and the target's own value there."""
    total = grid.groupBy("alpha").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    j = grid.join(total, "alpha").withColumn("others", F.when(F.col("n") > 1, (F.col("s") - F.col("value")) / (F.col("n") - 1)))
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.round("others", 12)), "alpha"))
    return j.withColumn("place", place).where("place = 1").select("target", "alpha", "others", F.col("value").alias("held_out"))


def sign_flips(differences: DataFrame, value: str = "d") -> DataFrame:
    """One row: n, the mean difference, and the exact two-sided p of flipping signs in all 2**n ways (n up to 24)."""
    d = differences.agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("d"))  # n numbers
    n = d.select(F.size("d")).first()[0]
    if n > 24:
        raise ValueError(f"{n} differences have too many sign patterns; use bootstrap()")
    signs = differences.sparkSession.range(1 << n).select(F.col("id").alias("bits"))
    total = lambda pick: F.aggregate(F.transform("d", pick), F.lit(0.0), lambda a, v: a + v)
    both = signs.join(F.broadcast(d)).withColumn("flipped", total(lambda v, i: F.when(F.getbit(F.col("bits"), i) == 1, -v).otherwise(v)))  # one row of d
    both = both.withColumn("seen", total(lambda v, i: v))
    return both.agg(F.max(F.size("d")).cast("long").alias("n"), (F.max("seen") / F.greatest(F.max(F.size("d")), F.lit(1))).alias("mean"), F.avg((F.abs("flipped") >= F.abs("seen") - 1e-12).cast("double")).alias("p"))


def percentile_of(values: DataFrame, observed: float, value: str = "v") -> DataFrame:
    """One row: n, the share of values below the observed, and the values' 5th and 95th percentiles."""
    low, high = (F.lit(quantiles(values, [value], q)[0]).cast("double") for q in (0.05, 0.95))
    return values.agg(F.count(value).alias("n"), F.avg((F.col(value) < observed).cast("double")).alias("below"), low.alias("p05"), high.alias("p95"))


#: Keys of draws have so many bits: the first thirteen digits of a digest, which a long and a double hold.
BITS = 52


def key(seed: int, draw: Column, item: Column) -> Column:
    """The place of an item in a draw's random order, a number below 2 ** BITS from the MD5 of "seed:draw:item"; SQL finds
    the same."""
    text = F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), item.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def drawn(items: DataFrame, t: int, n_draws: int, seed: int, item: str = "window_id") -> DataFrame:
    """(draw, item, rank): t of the distinct whole-numbered items for each draw, at random without repetition.

    The items of lowest key are drawn. A limit that leaves a few more than t keeps all others from being ranked; should it
    ever leave fewer, the draws are made without it. Nothing of the items comes to the driver.
    """
    n = items.count()
    share = min(1.0, (t + 8 * t**0.5 + 32) / max(n, 1))
    while True:
        keyed = items.select(item, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_draws - 1).cast("long"))).alias("draw")).withColumn("key", key(seed, F.col("draw"), F.col(item)))
        place = F.row_number().over(Window.partitionBy("draw").orderBy("key", item)).cast("long")
        got = cut(keyed.where(F.col("key") < int(share * (1 << BITS))).withColumn("rank", place).where(F.col("rank") <= t).select("draw", item, "rank"))
        if share == 1.0 or got.count() == n_draws * min(t, n):
            return got
        share = 1.0


def random_recovery(cover: DataFrame, weights: DataFrame, windows: DataFrame, t_max: int, n_draws: int, seed: int) -> DataFrame:
    """(draw, rank, fraction): recovery by windows (window_id) drawn at random. cover has cell and window_id, a row for each
    window over a cell; weights has cell and weight, the cell's share of the mean fraction."""
    picks = drawn(windows.select("window_id"), t_max, n_draws, seed)
    first = cover.join(picks, "window_id").groupBy("draw", "cell").agg(F.min("rank").alias("rank"))
    gained = first.join(weights, "cell").groupBy("draw", "rank").agg(F.sum("weight").alias("gain"))
    every = cover.sparkSession.range(n_draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(t_max).cast("long"))).alias("rank"))
    so_far = Window.partitionBy("draw").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(gained, ["draw", "rank"], "left").select("draw", "rank", F.sum(F.coalesce("gain", F.lit(0.0))).over(so_far).alias("fraction"))


def random_means(values: DataFrame, t: int, n_draws: int, seed: int, value: str = "v") -> DataFrame:
    """(draw, v): mean of a quantity over t windows drawn at random without repetition. values has window_id and the
    quantity; windows without one are drawn too but left out of the mean, which is null where none has one."""
    found = drawn(values.select("window_id"), t, n_draws, seed).join(values, "window_id").groupBy("draw").agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias("v"))
    return values.sparkSession.range(n_draws).select(F.col("id").alias("draw")).join(found, "draw", "left")


def band(drawn: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(rank, low, mean, high) over draws."""
    return drawn.groupBy("rank").agg(F.percentile("fraction", F.lit(low)).alias("low"), F.avg("fraction").alias("mean"), F.percentile("fraction", F.lit(high)).alias("high"))


def permutation_p(drawn: DataFrame, observed: float, value: str = "v") -> DataFrame:
    """One row: (1 + draws at least as large) / (1 + draws)."""
    return drawn.agg(F.count(value).alias("n"), ((1 + F.sum((F.col(value) >= observed).cast("long"))) / (1 + F.count(value))).alias("p"))


def bootstrap(rows: DataFrame, cluster: str, value: str, n_draws: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: mean and percentile interval of the mean, whole clusters drawn with repetition.

    A draw has as many picks as there are clusters; the key of draw and pick names the picked one. Picks are counted by
    cluster and meet its sum and count; one number for each draw is left.
    """
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    numbered = cut(number(sums, [], [cluster], "at").select("at", "s", "n"))
    count = numbered.count()
    if not count:
        raise ValueError("no clusters to draw from")
    picks = numbered.select("at", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    picks = picks.select("draw", (key(seed, F.col("draw"), F.col("at")) % count + 1).alias("at")).groupBy("draw", "at").agg(F.count(F.lit(1)).alias("times"))
    means = picks.join(numbered, "at").groupBy("draw").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n"))).alias("v"))
    whole = numbered.agg((F.sum("s") / F.sum("n")).alias("mean")).first()
    return means.agg(F.lit(whole["mean"]).cast("double").alias("mean"), F.percentile("v", F.lit(low)).alias("low"), F.percentile("v", F.lit(high)).alias("high"))
