"""Sweeps, comparisons and inference; customers stand for footprints, segments for runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import inference as I
from ..operators.ordering import cut, top
from ..operators.windows import Shape, windows
from .adapters import EVENT_CELLS, EVENT_WINDOWS, FOOTPRINTS, event_cells, query, rounded, table

RUNS = "runs as (select c_nationkey as dep_id, c_mktsegment as grp, (c_custkey % 9)::int as k, round(avg(c_acctbal), 3) as auc from customer group by 1, 2, 3)"


def runs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("dep_id"), F.col("c_mktsegment").alias("grp"), (F.col("c_custkey") % 9).cast("int").alias("k")).agg(F.round(F.avg("c_acctbal"), 3).alias("auc"))


def shares(spark, sf_dir):
    """Integer scores, so that sums are exact."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("dep_id"), F.col("c_mktsegment").alias("grp"), (F.col("c_custkey") % 9).cast("int").alias("k")).agg(F.sum(F.round("c_acctbal").cast("long")).cast("double").alias("auc"))


SHARES = "runs as (select c_nationkey as dep_id, c_mktsegment as grp, (c_custkey % 9)::int as k, sum(round(c_acctbal)::bigint)::double as auc from customer group by 1, 2, 3)"


@query(f"with {SHARES} select dep_id, grp, k, auc from runs qualify row_number() over (partition by dep_id, grp order by auc desc, k) = 1")
def best_k_argmax(spark, sf_dir):
    return C.best(shares(spark, sf_dir), ["dep_id", "grp"], "auc", "k")


GAIN = SHARES + ", s as (select dep_id, grp, max(auc) as score from runs group by 1, 2), e as (select d.dep_id, g.grp from (select distinct dep_id from s) d, (select distinct grp from s where grp <> 'BUILDING') g)"


@query(f"with {GAIN} select e.grp, e.dep_id, s.score, b.score as base_score, s.score - b.score as gain from e left join s on s.dep_id = e.dep_id and s.grp = e.grp left join s b on b.dep_id = e.dep_id and b.grp = 'BUILDING'")
def gain_long_table(spark, sf_dir):
    s = shares(spark, sf_dir).groupBy("dep_id", "grp").agg(F.max("auc").alias("score"))
    return C.gains(s, "BUILDING")


@query(f"with {SHARES} select dep_id from runs group by 1 having count(distinct grp) = (select count(distinct grp) from runs)")
def shared_footprints(spark, sf_dir):
    s = shares(spark, sf_dir)
    return C.shared(s, s.select("grp").distinct().count())


@query(f"with {SHARES} select k as rank, count(auc) as n, round(avg(auc), 6) as mean, min(auc) as low, max(auc) as high, round(quantile_cont(auc, 0.1), 6) as p10, round(quantile_cont(auc, 0.9), 6) as p90 from runs group by 1")
def curve_bands(spark, sf_dir):
    return rounded(C.bands(shares(spark, sf_dir).withColumnRenamed("k", "rank"), "auc"), "mean", "p10", "p90")


@query("select (user_id % 50)::bigint as rank, event_type as kind, count(*) as n from events group by 1, 2")
def event_counts(spark, sf_dir):
    return C.event_counts(table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("rank"), F.col("event_type").alias("kind")))


@query(f"""with {EVENT_CELLS}, p as (select r, avg(v1) as y from cells where abs(c - 12) <= 3 group by 1), n as (select r, (r - (min(r) over () + max(r) over ()) / 2.0) * 0.5 as distance, (y - avg(y) over ()) / stddev_pop(y) over () as y from p)
    select r, round(distance, 6) as distance, round(sum(y) over (order by r rows between 2 preceding and 2 following) / 5, 6) + 0.0 as y from n""")
def profile_smooth(spark, sf_dir):
    """Centre-band profile, normalised and smoothed with zeros beyond the ends."""
    p = C.profile(event_cells(spark, sf_dir).withColumn("v", F.col("v1")).withColumn("g", F.lit(0)), ["g"], 12, 3)
    return rounded(C.normalized_profile(p, ["g"], 0.5, scale="sd", width=5).drop("g"), "distance", "y")


VOCABULARY = {"metal": ["bolt", "ring", "spring"], "tool": ["gear", "lever", "widget", "small"], "red": ["red", "promo"], "cold": ["blue", "ice"]}
GENERIC, UNLESS = ["small", "promo"], {"metal": ["red"]}


def counted_sql(label: str) -> str:
    """Parts that hold a word of the class, each once; by half where the whole part is a generic term."""
    holds = lambda words: "(" + " or ".join(f"contains(e, '{w}')" for w in words) + ")" if words else "false"
    return f"list_sum(list_transform(parts, lambda e: case when {holds(VOCABULARY[label])} and not {holds(UNLESS.get(label, []))} then (case when e in ({', '.join(repr(g) for g in GENERIC)}) then 0.5 else 1.0 end) else 0.0 end))::double"


@query(f"""with t as (select p_partkey as id, list_filter(list_transform(string_split(lower(p_name || ',' || p_type || ', ,' || p_name), ','), lambda e: trim(e)), lambda e: e <> '') as parts from part),
    h as (select id, {counted_sql("metal")} as a, {counted_sql("tool")} as b, {counted_sql("red")} as c, {counted_sql("cold")} as d from t)
    select id, case when greatest(a, b, c, d) = 0 then null when a >= greatest(b, c, d) then 'metal' when b >= greatest(c, d) then 'tool' when c >= d then 'red' else 'cold' end as label, greatest(a, b, c, d) as weight from h""")
def keyword_classify(spark, sf_dir):
    """Classes by the parts of a text; a part that names two words of a class counts once."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(",", "p_name", "p_type", F.lit(" "), "p_name").alias("t"))
    return C.classify(p, "t", VOCABULARY, GENERIC, UNLESS)


@query("select doc_id, contains(lower(text), 'license') or contains(lower(text), 'copyright') as hit from documents")
def keyword_predicate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.has_any(F.col("text"), ["License", "copyright"]).alias("hit"))


@query("with p as (select s_nationkey as g, row_number() over (partition by s_nationkey order by s_suppkey) as pc, s_acctbal as w from supplier), q as (select g, pc, row_number() over (partition by g order by w desc, pc) as place from p) select g, case when count(*) > 1 then round(corr(place, pc), 6) + 0.0 end as spearman from q group by 1")
def weight_spearman(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("pc"), F.col("s_acctbal").alias("w"))
    return rounded(C.weight_order_agreement(s, ["g"]), "spearman")


@query("with p as (select n_nationkey as pc, count(*)::double as w from customer join nation on c_nationkey = n_nationkey group by 1), q as (select row_number() over (order by w desc, pc) as place, pc as pc_a, lead(pc) over (order by w desc, pc) as pc_b from p) select * from q where pc_b is not null")
def adjacent_pairs(spark, sf_dir):
    return C.adjacent_pairs(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("pc")).agg(F.count(F.lit(1)).cast("double").alias("w")))


@query("""with p as (select (o_custkey % 6)::int as ref, (o_orderkey % 6)::int as target, sum(round(o_totalprice)::bigint)::double as a, count(*)::double * 150000 as b from orders group by 1, 2), r as (select * from p where ref <> target),
    t as (select t.target, sum(r.a) as sa, sum(r.b) as sb, count(*) as n from (select distinct target from r) t join r on r.target <> t.target and r.ref <> t.target group by 1), m as (select target, sa / n as mean_a, sb / n as mean_b from t), h as (select target, sum(a) as ta, sum(b) as tb, count(*) as tn from r group by 1)
    select target, round(mean_a, 3) as mean_a, round(mean_b, 3) as mean_b, round(mean_a / (mean_a + mean_b), 6) as alpha, case when mean_a >= mean_b then 'a' else 'b' end as chosen, case when mean_a >= mean_b then ta else tb end as held_sum, tn as held_n from m join h using (target)""")
def loo_pairs(spark, sf_dir):
    """Leave one target out, over pairs of reference and target."""
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 6).cast("int").alias("ref"), (F.col("o_orderkey") % 6).cast("int").alias("target")).agg(F.sum(F.round("o_totalprice").cast("long")).cast("double").alias("a"), (F.count(F.lit(1)) * 150000.0).alias("b"))
    return rounded(rounded(I.leave_one_out(o), "mean_a", "mean_b", digits=3), "alpha")


@query("""with g as (select (o_custkey % 7)::int as target, (o_orderkey % 5) / 4.0 as alpha, sum(round(o_totalprice)::bigint)::double as value from orders group by 1, 2), t as (select alpha, sum(value) as s, count(*) as n from g group by 1)
    select target, alpha::double as alpha, round((s - value) / (n - 1), 4) as others, value as held_out from g join t using (alpha) qualify row_number() over (partition by target order by round((s - value) / (n - 1), 9) desc, alpha) = 1""")
def held_out_alpha(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).cast("int").alias("target"), (F.col("o_orderkey") % 5 / 4.0).alias("alpha")).agg(F.sum(F.round("o_totalprice").cast("long")).cast("double").alias("value"))
    return rounded(I.held_out_grid(o), "others", digits=4)


@query("select case when avg(l_discount) + avg(l_tax) > 0 then round(avg(l_discount) / (avg(l_discount) + avg(l_tax)), 6) else 0.5 end as alpha from lineitem")
def alpha_from_single(spark, sf_dir):
    return rounded(I.alpha_from_single(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax"), "alpha")


FLIPS = "d as (select r_regionkey as i, round(sum(s_acctbal)) - 25000 as d from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1), b as (select range as bits from range(0, 32)), f as (select bits, sum(case when (bits >> (rn - 1)::int) & 1 = 1 then -d else d end) as flipped, sum(d) as seen from b, (select d, row_number() over (order by d) as rn from d) group by 1)"


@query(f"with {FLIPS} select 5::bigint as n, round(max(seen) / 5, 6) as mean, round(avg((abs(flipped) >= abs(seen) - 1e-12)::int), 6) as p from f")
def sign_flip_p(spark, sf_dir):
    """Exact permutation of five differences."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(I.sign_flips(s.groupBy("r_regionkey").agg((F.round(F.sum("s_acctbal")) - 25000).alias("d"))), "mean", "p")


@query("select count(l_discount) as n, round(avg((l_discount < 0.043)::int), 6) as below, round(quantile_cont(l_discount, 0.05), 6) as p05, round(quantile_cont(l_discount, 0.95), 6) as p95 from lineitem")
def percentile_of_observed(spark, sf_dir):
    return rounded(I.percentile_of(table(spark, sf_dir, "lineitem"), 0.043, "l_discount"), "below", "p05", "p95")


def keys_sql(source: str, seed: int, draw: str, item: str) -> str:
    """SQL of source with key, the place of an item in a draw's random order."""
    return f"(select *, ('0x' || substr(md5('{seed}:' || {draw} || ':' || {item}), 1, {I.BITS // 4}))::bigint as key from {source})"


BOOT = f"""with s as (select row_number() over (order by c_nationkey) as place, sum(c_acctbal) as s, count(c_acctbal) as n from customer group by c_nationkey),
    k as (select draw, key % (select count(*) from s) + 1 as pick from {keys_sql('(select s.place, d.range as draw from s, range(0, 500) d)', 17, "draw", "place")}),
    m as (select draw, sum(s) / sum(n) as v from k join s on s.place = k.pick group by 1)
    select round((select sum(s) / sum(n) from s), 6) as mean, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from m"""


@query(BOOT)
def bootstrap_interval(spark, sf_dir):
    return rounded(I.bootstrap(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", 500, 17), "mean", "low", "high")


BAND = f"""with {EVENT_WINDOWS}, {FOOTPRINTS},
    cover as (select distinct dep_id, r, c, window_id from dep_cells join whole on r - window_id // 8 * 2 between 0 and 2 and c - window_id % 8 * 3 between 0 and 3),
    weight as (select dep_id, r, c, area / dep_area / (select count(*) from dep_area) as weight from dep_cells join dep_area using (dep_id)),
    pick as (select draw, window_id, row_number() over (partition by draw order by key, window_id) as rank from {keys_sql('(select window_id, d.range as draw from whole, range(0, 200) d)', 23, 'draw', 'window_id')} qualify rank <= 40),
    first as (select draw, dep_id, r, c, min(rank) as rank from cover join pick using (window_id) group by 1, 2, 3, 4),
    gained as (select draw, rank, sum(weight) as gain from first join weight using (dep_id, r, c) group by 1, 2),
    line as (select d.range as draw, k.range as rank, sum(coalesce(gain, 0)) over (partition by d.range order by k.range) as fraction from range(0, 200) d cross join range(1, 41) k left join gained g on g.draw = d.range and g.rank = k.range)
    select rank, round(quantile_cont(fraction, 0.05), 6) as low, round(avg(fraction), 6) as mean, round(quantile_cont(fraction, 0.95), 6) as high from line group by 1"""


@query(BAND)
def random_band(spark, sf_dir):
    """Recovery by random windows: 5th to 95th percentile over seeded draws."""
    from . import recoveries as V

    deps, _, _ = V.counted(spark, sf_dir)
    places = cut(V.windows(V.event_cells(spark, sf_dir), V.EVENTS, ["v1"]).select("window_id", "r0", "c0"))
    cell = F.struct("dep_id", "r", "c").alias("cell")
    cover = V.V.window_cells(places, 3, 4, "window_id").join(deps, ["r", "c"]).select(cell, "window_id")
    totals = deps.groupBy("dep_id").agg(F.sum("area").alias("whole"))
    weights = deps.join(totals, "dep_id").select(cell, (F.col("area") / F.col("whole") / F.lit(totals.count())).alias("weight"))
    return rounded(I.band(I.random_recovery(cover, weights, places, V.TOP, 200, 23)), "low", "mean", "high")


@query(f"with {GAIN}, g as (select e.grp, e.dep_id, s.score - b.score as gain from e left join s on s.dep_id = e.dep_id and s.grp = e.grp left join s b on b.dep_id = e.dep_id and b.grp = 'BUILDING') select grp, dep_id, gain, row_number() over (order by gain desc nulls last, dep_id, grp) as rank from g qualify rank <= 10")
def top_gain(spark, sf_dir):
    """A top-10 report of gains over a base group."""
    s = shares(spark, sf_dir).groupBy("dep_id", "grp").agg(F.max("auc").alias("score"))
    return top(C.gains(s, "BUILDING").select("grp", "dep_id", "gain"), 10, [F.desc_nulls_last("gain"), "dep_id", "grp"])


MISSING = """g as (select (day(ts) - 1)::int as r, hour(ts)::int as c, count(*) filter (where event_type = 'purchase') as v1, count(*) filter (where event_type = 'error') as v2 from events group by 1, 2),
    win as (select (i.range * 22 + k.range)::bigint as window_id, v1, v2 from range(0, 29) i, range(0, 22) k, g where r between i.range and i.range + 1 and c between k.range and k.range + 2),
    one as (select window_id from win where v1 > 0 group by 1 having count(*) = 6), two as (select window_id from win where v2 > 0 group by 1 having count(*) = 6)"""


@query(f"with {MISSING} select window_id from one intersect select window_id from two")
def common_ids(spark, sf_dir):
    """Windows that are whole in both variables: the ids of windows cut of both together."""
    n = lambda k: F.sum(F.when(F.col("event_type") == k, 1.0))
    g = table(spark, sf_dir, "events").groupBy((F.dayofmonth("ts") - 1).alias("r"), F.hour("ts").alias("c")).agg(n("purchase").alias("v1"), n("error").alias("v2"))
    return windows(g, Shape(30, 24, 2, 3), ["v1", "v2"]).select("window_id")


@query(f"with {SHARES}, b as (select dep_id, grp, k, auc from runs qualify row_number() over (partition by dep_id order by auc desc, k, grp) = 1) select dep_id, k from b")
def sweep_best_only(spark, sf_dir):
    """The third table of a sweep: each footprint's best k alone."""
    one = shares(spark, sf_dir).groupBy("dep_id", "k").agg(F.max("auc").alias("auc"))
    return C.sweep_tables(one)[2]


@query("select count(l_tax) as n, (1 + sum((l_tax >= 0.07)::int)) / (1 + count(l_tax))::double as p from lineitem")
def permutation_p(spark, sf_dir):
    """Share of draws at least as large as the observed one."""
    return I.permutation_p(table(spark, sf_dir, "lineitem"), 0.07, "l_tax")
