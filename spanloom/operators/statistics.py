"""Dataset statistics, quality, drift, long tail, learning curves, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def upper_median(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by..., median): sorted[n div 2], by counting: equal values are one row, so no group is ever gathered."""
    n = values.groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy(column)
    r = n.withColumn("__upto", F.sum("__n").over(w)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    return r.where(F.col("__upto") > F.expr("__all div 2")).groupBy(*by).agg(F.min(column).alias("median"))


def shares(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n, share)"""
    n = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def js_divergence(distributions: DataFrame, by: str, value: str, base: str) -> DataFrame:
    """(by, divergence): Jensen-Shannon divergence over ln 2 of each group's shares from those of group `base`."""
    b = distributions.where(F.col(by) == base).select(value, F.col("share").alias("q"))
    groups = distributions.select(by).distinct()
    grid = groups.join(distributions.select(value).distinct())  # groups times labels, both small sets of names
    j = grid.join(distributions.select(by, value, F.col("share").alias("p")), [by, value], "left").join(b, value, "left")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log(p / m) / 2).otherwise(0.0) + F.when(q > 0, q * F.log(q / m) / 2).otherwise(0.0)
    return j.groupBy(by).agg((F.sum(term) / F.log(F.lit(2.0))).alias("divergence"))


def ambiguous_texts(rows: DataFrame, text: str, label: str) -> DataFrame:
    """(text, n_labels, n): texts (without case) of more than one label."""
    return rows.groupBy(F.lower(text).alias("text")).agg(F.count_distinct(label).alias("n_labels"), F.count(F.lit(1)).alias("n")).where("n_labels > 1")


def gini(counts: DataFrame, column: str) -> DataFrame:
    """(gini): from the cumulative counts of equal values, without pairs."""
    g = counts.groupBy(column).agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy(column)  # as many rows as distinct counts
    g = g.withColumn("before", F.sum("m").over(w) - F.col("m"))
    x = F.col(column).cast("double")
    # sum of rank * value over equal values: ranks before + 1 .. before + m
    ranks = F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2
    return g.agg((2 * F.sum(ranks * x) / (F.sum("m") * F.sum(F.col("m") * x)) - (F.sum("m") + 1) / F.sum("m")).alias("gini"))


def count_windows(rows: DataFrame, order: list[str], size: int, windows: int) -> DataFrame:
    """Rows of the last `windows` windows of `size` rows, aligned to the end, as column `window` (0 the oldest).

    Only the last size x windows rows are ordered (each partition keeps its own last ones first), so the numbering
    runs over a set bounded by the parameters. `order` must tell all rows apart."""
    last = rows.orderBy(*[F.col(c).desc() for c in order]).limit(size * windows)
    back = F.row_number().over(Window.orderBy(*[F.col(c).desc() for c in order])) - 1
    return last.withColumn("__back", back).withColumn("window", F.expr(f"{windows - 1} - (__back div {size})").cast("int")).drop("__back")


def kl_from_first(distributions: DataFrame, by: str, value: str) -> DataFrame:
    """(by, kl): Kullback-Leibler divergence of each window's shares from the first window's; a missing share is 1e-10."""
    first = distributions.agg(F.min(by).alias("f"))
    base = distributions.join(first, F.col(by) == F.col("f")).select(value, F.col("share").alias("q"))  # one row
    j = distributions.join(base, value, "left")
    return j.groupBy(by).agg(F.sum(F.col("share") * F.log(F.col("share") / F.coalesce("q", F.lit(1e-10)))).alias("kl"))


def paired_t(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n, mean_difference, t, p_bucket): p is read off two critical values, so it is .10, .03 or .005."""
    d = rows.select((a - b).alias("d"))
    r = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("s"))
    t = F.when(F.col("s") > 0, F.col("mean_difference") / (F.col("s") / F.sqrt("n"))).otherwise(F.lit(0.0))
    low, high = F.when(F.col("n") - 1 >= 30, 1.96).otherwise(2.1), F.when(F.col("n") - 1 >= 30, 2.576).otherwise(2.9)
    return r.select("n", "mean_difference", t.alias("t")).withColumn("p_bucket", F.when(F.abs("t") > high, 0.005).when(F.abs("t") > low, 0.03).otherwise(0.10))


def cohens_d(rows: DataFrame, group: Column, value: Column) -> DataFrame:
    """(d): difference of the means of two groups over the root of their mean sample variance; 0 without any."""
    a, b = F.when(group, value), F.when(~group, value)
    s = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return rows.agg(F.when(s > 0, (F.avg(a) - F.avg(b)) / s).otherwise(F.lit(0.0)).alias("d"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, share: float, seed: int = 1) -> DataFrame:
    """ceil(share n) rows of each stratum, those first in the order of md5(seed:key).

    The cut of a stratum is found on hash prefixes of 3 hex digits first; only its last bucket is ranked."""
    r = rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    r = r.withColumn("__b", F.substring("__h", 1, 3))
    n = r.groupBy(stratum, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(stratum)
    n = n.withColumns({"__upto": F.sum("__c").over(w.orderBy("__b")), "__all": F.sum("__c").over(w)}).withColumn("__want", F.ceil(F.col("__all") * share - 1e-9))
    n = n.withColumn("__left", F.col("__want") - (F.col("__upto") - F.col("__c"))).where("__left > 0")
    j = r.join(n.select(F.col(stratum).alias("__s"), F.col("__b").alias("__k"), "__left"), F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__k")))
    rank = F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__h", key))
    return j.withColumn("__r", rank).where("__r <= __left").drop("__h", "__b", "__s", "__k", "__left", "__r")
