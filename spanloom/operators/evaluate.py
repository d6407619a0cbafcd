"""Evaluation of spans against gold, confusion, calibration, thresholds, and coreference metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def exact_counts(gold: DataFrame, predicted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by..., n_gold, n_predicted, n_correct): equal rows match one to one, so repeats count as often as on both sides."""
    g = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("g"))
    p = predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("p"))
    j = g.join(p, keys, "full_outer").select(*keys, F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    return j.groupBy(*by).agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_predicted"), F.sum(F.least("g", "p")).alias("n_correct"))


def precision_recall(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("n_correct"), F.col("n_predicted")), ratio(F.col("n_correct"), F.col("n_gold"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def calibration_bins(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy) of rows with a confidence in [0, 1]."""
    c = F.col(confidence)
    r = rows.where((c >= 0) & (c <= 1)).withColumn("bin", F.least(F.floor(c * bins), F.lit(bins - 1)))
    return r.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """(ece, mce): the mean (by size) and the largest gap between confidence and accuracy."""
    gap = F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return bins.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def threshold_curve(rows: DataFrame, confidence: str, correct: str, points: int = 20) -> DataFrame:
    """(threshold, n_kept, precision, recall, f1): at thresholds i / points; precision 1 where nothing is kept,
    recall 1 where nothing is right at all. Rows are reduced to their step before the thresholds meet them."""
    c = F.col(confidence)
    steps = rows.where(c.isNotNull()).select(F.least(F.floor(c * points + 1e-9), F.lit(points)).alias("step"), F.col(correct).cast("int").alias("y")).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    spark = rows.sparkSession
    grid = spark.range(points + 1).select(F.col("id").alias("i"))
    j = grid.join(steps, steps["step"] >= grid["i"], "left").groupBy("i").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_kept"), F.coalesce(F.sum("y"), F.lit(0)).alias("kept_right"))
    total = steps.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("right"))
    j = j.join(total)  # one row
    p = F.when(F.col("n_kept") == 0, F.lit(1.0)).otherwise(F.col("kept_right") / F.col("n_kept"))
    r = F.when(F.col("right") == 0, F.lit(1.0)).otherwise(F.col("kept_right") / F.col("right"))
    j = j.select((F.col("i") / points).alias("threshold"), "n_kept", p.alias("precision"), r.alias("recall"))
    return j.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def area_under_curve(curve: DataFrame) -> DataFrame:
    """(auc_pr): by trapezoids over recall."""
    w = Window.partitionBy(F.lit(1)).orderBy("recall", F.col("threshold").desc())  # as many rows as thresholds
    c = curve.withColumn("r0", F.lag("recall").over(w)).withColumn("p0", F.lag("precision").over(w))
    return c.agg(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2).alias("auc_pr"))


# --- coreference: key and response are (doc_id, mention, cluster) ------------------------------------


def _common(key: DataFrame, response: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions in both, with sizes of their full clusters: (doc_id, mention, k, r), key sizes, response sizes."""
    k = key.select("doc_id", "mention", F.col("cluster").alias("k"))
    r = response.select("doc_id", "mention", F.col("cluster").alias("r"))
    return k.join(r, ["doc_id", "mention"]), k.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("nk")), r.groupBy("doc_id", "r").agg(F.count(F.lit(1)).alias("nr"))


def b_cubed(key: DataFrame, response: DataFrame) -> DataFrame:
    """(precision, recall, f1): per common mention the shared part of its clusters, averaged."""
    j, nk, nr = _common(key, response)
    cells = j.groupBy("doc_id", "k", "r").agg(F.count(F.lit(1)).alias("c")).join(nk, ["doc_id", "k"]).join(nr, ["doc_id", "r"])
    a = cells.agg((F.sum(F.col("c") * F.col("c") / F.col("nr")) / F.sum("c")).alias("precision"), (F.sum(F.col("c") * F.col("c") / F.col("nk")) / F.sum("c")).alias("recall"))
    a = a.select(F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
    return a.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def muc(key: DataFrame, response: DataFrame) -> DataFrame:
    """(precision, recall, f1): links kept, over common mentions; clusters of one mention have no links."""
    j, _, _ = _common(key, response)

    def side(a: str, b: str) -> DataFrame:
        x = j.groupBy("doc_id", a).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(b).alias("parts")).where("n > 1")
        return x.agg(ratio(F.coalesce(F.sum(F.col("n") - F.greatest(F.lit(1), F.col("parts"))), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).alias("v"))

    a = side("k", "r").withColumnRenamed("v", "recall").join(side("r", "k").withColumnRenamed("v", "precision"))  # one row each
    return a.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def blanc(key: DataFrame, response: DataFrame) -> DataFrame:
    """(precision, recall, f1): means over coreferent and non-coreferent pairs of common mentions, by counting."""
    j, _, _ = _common(key, response)
    pairs = lambda n: n * (n - 1) / 2
    cells = j.groupBy("doc_id", "k", "r").agg(F.count(F.lit(1)).alias("c"))
    both = cells.agg(F.coalesce(F.sum(pairs(F.col("c"))), F.lit(0.0)).alias("cc"))
    kk = cells.groupBy("doc_id", "k").agg(F.sum("c").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("ck"))
    rr = cells.groupBy("doc_id", "r").agg(F.sum("c").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("cr"))
    nn = cells.groupBy("doc_id").agg(F.sum("c").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("all"))
    a = both.join(kk).join(rr).join(nn)  # one row each
    a = a.withColumn("nc", F.col("all") - F.col("ck") - F.col("cr") + F.col("cc"))
    pc, rc = ratio(F.col("cc"), F.col("cr")), ratio(F.col("cc"), F.col("ck"))
    pn, rn = ratio(F.col("nc"), F.col("all") - F.col("cr")), ratio(F.col("nc"), F.col("all") - F.col("ck"))
    return a.select(((pc + pn) / 2).alias("precision"), ((rc + rn) / 2).alias("recall"), ((f1(pc, rc) + f1(pn, rn)) / 2).alias("f1"))


def lea(key: DataFrame, response: DataFrame) -> DataFrame:
    """(precision, recall, f1): clusters weighted by size, each by the share of its links that the other side keeps;
    a cluster of one is right if the other side has it as one, too."""
    j, nk, nr = _common(key, response)
    cells = j.groupBy("doc_id", "k", "r").agg(F.count(F.lit(1)).alias("c")).join(nk, ["doc_id", "k"]).join(nr, ["doc_id", "r"])
    links = F.col("c") * (F.col("c") - 1) / 2

    def side(n: str, other: str, sizes: DataFrame, cluster: str) -> DataFrame:
        own = F.when(F.col(n) == 1, F.when(F.col(other) == 1, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(links / (F.col(n) * (F.col(n) - 1) / 2))
        got = cells.agg(F.coalesce(F.sum(own * F.col(n)), F.lit(0.0)).alias("a"))
        return got.join(sizes.agg(F.coalesce(F.sum(n), F.lit(0)).alias("b"))).select(ratio(F.col("a"), F.col("b")).alias("v"))

    a = side("nk", "nr", nk, "k").withColumnRenamed("v", "recall").join(side("nr", "nk", nr, "r").withColumnRenamed("v", "precision"))  # one row each
    return a.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def ceaf(key: DataFrame, response: DataFrame, dice: bool = False) -> DataFrame:
    """(precision, recall, f1) by greedy one-to-one alignment of clusters in each document: raw overlap over the numbers of
    mentions, or with `dice` the Dice overlap over the numbers of clusters. Ties go to the first clusters."""
    j, nk, nr = _common(key, response)
    cells = j.groupBy("doc_id", "k", "r").agg(F.count(F.lit(1)).alias("c")).join(nk, ["doc_id", "k"]).join(nr, ["doc_id", "r"])

    alike = 2 * F.col("c") / (F.col("nk") + F.col("nr")) if dice else F.col("c").cast("double")
    best_first = F.sort_array(F.collect_list(F.struct((-alike).alias("s"), "k", "r")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cells in b["cells"]:
                total, ks, rs = 0.0, set(), set()
                for x in cells:
                    if x["k"] not in ks and x["r"] not in rs:
                        total -= x["s"]
                        ks.add(x["k"])
                        rs.add(x["r"])
                out.append(total)
            yield pd.DataFrame({"s": out})

    got = cells.groupBy("doc_id").agg(best_first.alias("cells")).select("cells").mapInPandas(run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    size = (lambda n: F.count(F.lit(1))) if dice else (lambda n: F.sum(n))
    a = got.join(nk.agg(size("nk").alias("nk"))).join(nr.agg(size("nr").alias("nr")))  # one row each
    a = a.select(ratio(F.col("s"), F.col("nr")).alias("precision"), ratio(F.col("s"), F.col("nk")).alias("recall"))
    return a.withColumn("f1", f1(F.col("precision"), F.col("recall")))




# --- further comparisons ---------------------------------------------------------------------------------


def relation_counts(gold: DataFrame, predicted: DataFrame, directed: bool = True) -> DataFrame:
    """(n_gold, n_predicted, n_correct) of relations (doc_id, head_start, head_end, tail_start, tail_end, relation): spans
    equal, relation without case; undirected ones are put in reading order first."""

    def keyed(df: DataFrame) -> DataFrame:
        h, t = F.struct(F.col("head_start").alias("s"), F.col("head_end").alias("e")), F.struct(F.col("tail_start").alias("s"), F.col("tail_end").alias("e"))
        if not directed:
            h, t = F.least(h, t), F.greatest(h, t)
        return df.select("doc_id", h.alias("h"), t.alias("t"), F.lower("relation").alias("relation"))

    return exact_counts(keyed(gold), keyed(predicted), ["doc_id", "h", "t", "relation"], [])


def discontinuous_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(n_gold, n_predicted, n_exact, n_hull) of entities (doc_id, segments array<struct<start,end>>, label): equal segments,
    and equal first and last character."""

    def keyed(df: DataFrame) -> DataFrame:
        s = F.array_sort("segments")
        return df.select("doc_id", s.alias("segments"), "label", F.array_min(F.transform(s, lambda x: x["start"])).alias("low"), F.array_max(F.transform(s, lambda x: x["end"])).alias("high"))

    g, p = keyed(gold), keyed(predicted)
    exact = exact_counts(g, p, ["doc_id", "segments", "label"], [])
    hull = exact_counts(g, p, ["doc_id", "low", "high", "label"], []).select(F.col("n_correct").alias("n_hull"))
    return exact.join(hull).select("n_gold", "n_predicted", F.col("n_correct").alias("n_exact"), "n_hull")  # one row each


def box_iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Of two rectangles (left, top, right, bottom)."""
    side = lambda l1, r1, l2, r2: F.greatest(F.lit(0.0), F.least(r1, r2) - F.greatest(l1, l2))
    common = side(a[0], a[2], b[0], b[2]) * side(a[1], a[3], b[1], b[3])
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def purity(key: DataFrame, response: DataFrame) -> DataFrame:
    """(purity, completeness): the majority's share of response clusters, and of key clusters, weighted by size."""
    j, _, _ = _common(key, response)
    cells = j.groupBy("doc_id", "k", "r").agg(F.count(F.lit(1)).alias("c"))
    side = lambda by, name: cells.groupBy("doc_id", by).agg(F.max("c").alias("m"), F.sum("c").alias("n")).agg(ratio(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias(name))
    return side("r", "purity").join(side("k", "completeness"))  # one row each


def _stratum(n: Column) -> Column:
    return F.when(n == 1, "singleton").when(n <= 10, "short").otherwise("long")


def chain_strata(key: DataFrame) -> DataFrame:
    """(stratum, n_chains, n_mentions): chains of one mention, two to ten, more."""
    n = key.groupBy("doc_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(_stratum(F.col("n")).alias("stratum")).agg(F.count(F.lit(1)).alias("n_chains"), F.sum("n").alias("n_mentions"))


def lea_by_stratum(key: DataFrame, response: DataFrame) -> DataFrame:
    """(stratum, precision, recall, f1): `lea` of chains of one mention, two to ten, more; recall over the key chains of that size,
    precision over the response chains of that size."""
    j, nk, nr = _common(key, response)
    cells = j.groupBy("doc_id", "k", "r").agg(F.count(F.lit(1)).alias("c")).join(nk, ["doc_id", "k"]).join(nr, ["doc_id", "r"])
    links = F.col("c") * (F.col("c") - 1) / 2

    def side(n: str, other: str, sizes: DataFrame, name: str) -> DataFrame:
        own = F.when(F.col(n) == 1, (F.col(other) == 1).cast("double")).otherwise(links / (F.col(n) * (F.col(n) - 1) / 2))
        got = cells.groupBy(_stratum(F.col(n)).alias("stratum")).agg(F.sum(own * F.col(n)).alias("a"))
        return sizes.groupBy(_stratum(F.col(n)).alias("stratum")).agg(F.sum(n).alias("b")).join(got, "stratum", "left").select("stratum", ratio(F.coalesce("a", F.lit(0.0)), F.col("b")).alias(name))

    a = side("nk", "nr", nk, "recall").join(side("nr", "nk", nr, "precision"), "stratum", "full_outer").na.fill(0.0)
    return a.withColumn("f1", f1(F.col("precision"), F.col("recall"))).select("stratum", "precision", "recall", "f1")


def b_cubed_by_document(key: DataFrame, response: DataFrame) -> DataFrame:
    """(n_docs, precision, recall, f1, sd_f1, low, high): `b_cubed` of each document, averaged; f1 from the means, the deviation (of
    all) and the interval of 1.96 standard errors, within [0, 1], from the documents' own."""
    j, nk, nr = _common(key, response)
    cells = j.groupBy("doc_id", "k", "r").agg(F.count(F.lit(1)).alias("c")).join(nk, ["doc_id", "k"]).join(nr, ["doc_id", "r"])
    d = cells.groupBy("doc_id").agg((F.sum(F.col("c") * F.col("c") / F.col("nr")) / F.sum("c")).alias("p"), (F.sum(F.col("c") * F.col("c") / F.col("nk")) / F.sum("c")).alias("r")).withColumn("f", f1(F.col("p"), F.col("r")))
    a = d.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("m"), F.stddev_pop("f").alias("sd_f1"))
    e = 1.96 * F.col("sd_f1") / F.sqrt("n_docs")
    return a.select("n_docs", "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"), "sd_f1", F.greatest(F.lit(0.0), F.col("m") - e).alias("low"), F.least(F.lit(1.0), F.col("m") + e).alias("high"))


def per_document(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(n_docs, mean_f1, sd_f1, low, high): F1 of each document, with an interval of 1.96 standard errors within [0, 1]."""
    d = precision_recall(exact_counts(gold, predicted, keys, ["doc_id"])).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("sd_f1"))
    e = 1.96 * F.col("sd_f1") / F.sqrt("n_docs")
    return d.select("n_docs", "mean_f1", "sd_f1", F.greatest(F.lit(0.0), F.col("mean_f1") - e).alias("low"), F.least(F.lit(1.0), F.col("mean_f1") + e).alias("high"))
