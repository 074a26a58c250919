"""Host-level quality rules: failures by host, rates shrunk with an empirical beta prior, verdicts joined to documents.

Each document is measured in its own row (no word leaves it); only the narrow measures are shuffled. Only DataFrame
functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: White space of these rules: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Hosts whose rates are sent to all tasks (some tens of bytes each); beyond, a host's documents are dealt to SALTS tasks.
BROADCAST_HOSTS, SALTS = 200_000, 32


@dataclass(frozen=True)
class Rules:
    """Limits of the document rules and of a host's shrunk failure rate."""

    least_words: int = 50
    most_repeat_percent: int = 50
    most_symbol_percent: int = 10
    most_dup_line_percent: int = 30
    most_host_rate: float = 0.6


def strip(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc, host and the measures of each whole text; null counts as a text without words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    rows = rows.select(
        "doc", "host",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.length(strip(x, BLANKS)) > 0).alias("lines"),
        F.length(strip(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(strip(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
    )
    w = F.col("w")
    windows = F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("doc", "host", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"))
    # Windows found again are neighbours in the order by hash; their places, in order, tell how many words they cover.
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("windows")
    by_hash = F.col("sorted")
    again = F.filter(by_hash, lambda x, k: (F.get(by_hash, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(by_hash, k + 1)["h"].eqNullSafe(x["h"])))
    rows = rows.withColumn("places", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("sorted")
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("end"))
    covered = F.aggregate("places", start, lambda a, p: F.struct((a["covered"] + p + 3 - F.greatest(p, a["end"])).alias("covered"), (p + 3).alias("end")), lambda a: a["covered"])
    return rows.withColumn("n_repeat_words", covered).drop("places")


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measure documents and judge them and their hosts; one row per row of docs.

    Columns: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate.
    base_failed: too few words, or more than the allowed share of words in 3-word windows found again. A document fails
    the rules if base_failed or if its share of symbols or of repeated lines is too large. A host's rate of failing
    documents f / n becomes (f + a) / (n + a + b), with a beta prior (a, b) that matches mean and variance between hosts.
    kept: not base_failed, and the host's rate is within the limit. A null host is no host: its documents are judged
    alone (host_rate null). A null text has no words. Null and repeated ids are rows of their own. An empty table gives
    an empty result. Windows are told apart by a 64-bit hash within one document.
    """
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words"))
    rows = measure(docs, id_col, text_col, host_col).withColumn("base_failed", failed)
    wrong = F.col("base_failed") | (100 * F.col("n_symbols") > rules.most_symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > rules.most_dup_line_percent * F.col("n_lines"))
    rows = cut(rows.withColumn("wrong", wrong))
    hosts = rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wrong").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(F.sum("f").alias("f"), F.sum("n").alias("n"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n")).alias("noise"), F.count(F.lit(1)).alias("hosts")).first()
    a, b = beta_prior(prior)
    shrunk = hosts.select("host", ((F.col("f") + a) / (F.col("n") + a + b)).alias("host_rate"))
    if prior.hosts <= BROADCAST_HOSTS:
        out = rows.join(F.broadcast(shrunk), "host", "left")
    else:  # many hosts: no one's documents meet in one task, and those without a host meet nowhere
        salt = F.pmod(F.xxhash64("doc", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
        spread = shrunk.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.where("host is not null").withColumn("salt", salt).join(spread, ["host", "salt"], "left").drop("salt")
        out = out.unionByName(rows.where("host is null").withColumn("host_rate", F.lit(None).cast("double")))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= rules.most_host_rate)
    return out.select(F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")


def beta_prior(p) -> tuple[float, float]:
    """Prior by moments from one row of sums over hosts: what varies between hosts beyond chance sets its strength."""
    if not p.n:
        return 1.0, 1.0
    mean = min(max(p.f / p.n, 1e-6), 1 - 1e-6)
    between = (p.v or 0.0) - mean * (1 - mean) * p.noise
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e4) if between > 1e-9 else 1e4 if p.hosts > 1 else 2.0
    return mean * strength, (1 - mean) * strength
