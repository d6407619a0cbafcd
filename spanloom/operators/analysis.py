"""What a set of annotated texts, or of results, is like: difficulty, shift of labels, few examples, learning curves, robustness,
recognition by groups, what to annotate next. Everything is counted in the cluster; names of labels are the only small sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, label_category, word_jaccard
from .matching import scores
from .statistics import js_divergence, shares, upper_median


def dataset_stats(entities: DataFrame, examples: DataFrame) -> DataFrame:
    """One row: examples, entities, types, distinct texts, diversity (distinct over all), entities an example, and the mean,
    standard deviation (of all), least, most and upper median of the words of an entity. Entities are (doc_id, text, label)."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    e = entities.where("text IS NOT NULL").select("label", F.lower("text").alias("t"), words.alias("w"))
    a = e.agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_distinct("label").alias("n_types"), F.count_distinct("t").alias("n_texts"), F.avg("w").alias("mean_words"),
        F.stddev_pop("w").alias("sd_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words"),
    )
    n = examples.agg(F.count(F.lit(1)).alias("n_examples"))
    median = upper_median(e.select(F.lit(0).alias("all"), "w"), "w", ["all"]).select(F.col("median").alias("median_words"))
    r = a.join(n).join(median)  # one row each
    return r.withColumns({"diversity": F.try_divide(F.col("n_texts"), F.col("n_entities")), "entities_per_example": F.try_divide(F.col("n_entities"), F.col("n_examples"))})


def difficulty(stats: DataFrame) -> DataFrame:
    """(score, difficulty) from `dataset_stats`: many types, long entities of uneven length, few repeats and few entities an
    example make a set hard."""
    s = (
        F.when(F.col("n_types") > 10, 0.2).when(F.col("n_types") > 5, 0.1).otherwise(0.0) + F.when(F.col("mean_words") > 3, 0.2).otherwise(0.0) + F.when(F.col("sd_words") > 2, 0.1).otherwise(0.0)
        + F.when(F.col("diversity") > 0.9, 0.2).when(F.col("diversity") < 0.3, -0.1).otherwise(0.0) + F.when(F.col("entities_per_example") < 1, 0.1).otherwise(0.0)
    )
    r = F.round(s, 9)
    return stats.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)).alias("score"), F.when(r < 0.2, "Easy").when(r < 0.4, "Medium").when(r < 0.6, "Hard").otherwise("VeryHard").alias("difficulty"))


def overlap(a: DataFrame, b: DataFrame, column: str, name: str) -> DataFrame:
    """(name): the Jaccard similarity of two sets of values, 0 if both are empty."""
    x = a.select(column).where(F.col(column).isNotNull()).distinct().withColumn("a", F.lit(1))
    y = b.select(column).where(F.col(column).isNotNull()).distinct().withColumn("b", F.lit(1))
    j = x.join(y, column, "full_outer")
    return j.agg(F.coalesce(F.try_divide(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count(F.lit(1))), F.lit(0.0)).alias(name))


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vocabulary, texts, divergence, gap) of two sets of entities (text, label): Jaccard of their words and of their texts, the
    Jensen-Shannon divergence of their labels over ln 2, and 0.4 divergence + 0.3 (1 - vocabulary) + 0.3 (1 - texts)."""
    words = lambda d: d.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where("w <> ''")
    lower = lambda d: d.select(F.lower("text").alias("t"))
    both = a.select(F.lit("a").alias("side"), "label").unionByName(b.select(F.lit("b").alias("side"), "label")).where("label IS NOT NULL")
    js = js_divergence(shares(both, "side", "label"), "side", "label", "a").where("side = 'b'").select("divergence")
    r = overlap(words(a), words(b), "w", "vocabulary").join(overlap(lower(a), lower(b), "t", "texts")).join(js)  # one row each
    return r.withColumn("gap", 0.4 * F.col("divergence") + 0.3 * (1 - F.col("vocabulary")) + 0.3 * (1 - F.col("texts")))


def label_shift(train: DataFrame, test: DataFrame) -> DataFrame:
    """(overlap, familiarity, unseen, difficulty) of labels of test that train knows: the share of equal ones, the mean over labels
    of test of the best likeness to one of train (1 if equal, 0.8 if one holds the other, half if of one category, else the
    Jaccard of trigrams), the sorted unseen ones."""
    a = train.select(F.col("label").alias("x")).where("x IS NOT NULL").distinct()
    b = test.select(F.col("label").alias("y")).where("y IS NOT NULL").distinct()
    j = b.join(F.broadcast(a))  # names of labels, twice
    x, y = F.lower("x"), F.lower("y")
    grams = lambda c: F.array_distinct(char_ngrams(c, 3))
    jaccard = F.try_divide(F.size(F.array_intersect(grams(x), grams(y))), F.size(F.array_union(grams(x), grams(y))))
    kin = F.when(label_category(F.col("x")) == label_category(F.col("y")), F.lit(0.5)).otherwise(F.lit(0.0))
    like = F.when(x == y, F.lit(1.0)).when(F.contains(x, y) | F.contains(y, x), F.lit(0.8)).otherwise(F.greatest(jaccard, kin))
    best = j.groupBy("y").agg(F.max(like).alias("like"), F.max((x == y).cast("int")).alias("known"))
    r = best.agg(F.avg("known").alias("overlap"), F.avg("like").alias("familiarity"), F.sort_array(F.collect_list(F.when(F.col("known") == 0, F.col("y")))).alias("unseen"))
    return r.withColumn("difficulty", F.when((F.col("overlap") > 0.8) | (F.col("familiarity") > 0.85), "low").when((F.col("overlap") > 0.4) | (F.col("familiarity") > 0.5), "medium").otherwise("high"))


def hash_share(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) by md5(seed:key): the same for a key wherever it is."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 4), 16, 10).cast("int") / 65536


def split(rows: DataFrame, key: str, train: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows for training and for validation, by the hash of their key: rows of a key stay together."""
    h = hash_share(F.col(key), seed)
    return rows.where(h < train), rows.where(h >= train)


def tagger_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """(n_gold, n_predicted, n_correct, precision, recall, f1) of a tagger that knows the texts of train (text, label) and gives
    each the label that it has most often there, the first by name of equals."""
    known = train.groupBy(F.lower("text").alias("t"), "label").agg(F.count(F.lit(1)).alias("n")).groupBy("t").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("said"))
    j = test.withColumn("t", F.lower("text")).join(known, "t", "left")
    n = j.agg(F.count(F.lit(1)).alias("n_gold"), F.count("said").alias("n_predicted"), F.count_if(F.col("said") == F.col("label")).alias("n_correct"))
    return n.withColumns(scores(F.col("n_correct"), F.col("n_predicted"), F.col("n_gold")))


def learning_curve(rows: DataFrame, key: str, sizes: list[float], held_out: float = 0.8, seed: int = 0) -> DataFrame:
    """(size, train_size, f1): `tagger_scores` of growing shares of the rows (text, label), on rows of held-out keys."""
    h = rows.withColumn("__h", hash_share(F.col(key), seed))
    test = h.where(F.col("__h") >= held_out)
    out = None
    for size in sizes:
        train = h.where(F.col("__h") < size * held_out)
        one = tagger_scores(train, test).join(train.agg(F.count(F.lit(1)).alias("train_size"))).select(F.lit(size).alias("size"), "train_size", "f1")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def curve_fit(points: DataFrame) -> DataFrame:
    """(f1_per_100, slope, a, r2, c, diminishing_at, saturation) of points (train_size, f1): gain an additional hundred, the least
    squares of f1 on the logarithm of the size, the ceiling min(1, 1.05 of the last), the size from which half as much again
    or more brings under a hundredth, and how much of the first third's gain the last third lacks."""
    w = Window.orderBy("train_size")  # the points of a curve: a handful
    p = points.withColumns({"s0": F.lag("train_size").over(w), "f0": F.lag("f1").over(w), "i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    at = lambda k: F.max(F.when(F.col("i") == k, F.col("f1")))
    x = F.log("train_size")
    r = p.agg(
        F.min_by("f1", "train_size").alias("first"), F.max_by("f1", "train_size").alias("last"), F.min("train_size").alias("low"), F.max("train_size").alias("high"), F.regr_slope("f1", x).alias("slope"),
        F.exp(F.regr_intercept("f1", x)).alias("a"), F.regr_r2("f1", x).alias("r2"), F.min(F.when((F.col("train_size") >= 1.5 * F.col("s0")) & (F.col("f1") - F.col("f0") < 0.01), F.col("s0"))).alias("diminishing_at"),
        at(F.floor(F.col("n") / 3)).alias("third"), at(F.floor(F.col("n") * 2 / 3)).alias("two_thirds"), F.max("n").alias("n"),
    )
    start = F.col("third") - F.col("first")
    saturation = F.when(F.col("n") < 3, 0.0).when(start <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.least((F.col("last") - F.col("two_thirds")) / start, F.lit(1.0)))))
    per_100 = F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.col("high") - F.col("low")) * 100, F.lit(0.0))
    return r.select(per_100.alias("f1_per_100"), "slope", "a", "r2", F.least(F.lit(1.0), F.col("last") * 1.05).alias("c"), F.when(F.col("n") >= 3, F.col("diminishing_at")).alias("diminishing_at"), saturation.alias("saturation"))


def few_shot(rows: DataFrame, ks: list[int], key: str = "pred_id", seed: int = 0) -> DataFrame:
    """(k, label, n_gold, n_predicted, n_correct, precision, recall, f1): rows (text, label) told by the texts of k examples of
    each label (the first by hash); a row may be told by several labels. Examples are distinct texts: at most k a label."""
    r = rows.select(key, F.lower("text").alias("t"), "label").where("t IS NOT NULL AND label IS NOT NULL")
    order = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("t"))), "t")
    examples = r.select("label", "t").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(ks)).select(F.col("label").alias("said"), "t", "n")
    gold = r.groupBy("label").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = r.join(examples, "t")
    out = None
    for k in ks:
        h = hits.where(F.col("n") <= k).groupBy(F.col("said").alias("label")).agg(F.count(F.lit(1)).alias("n_predicted"), F.count_if(F.col("said") == F.col("label")).alias("n_correct"))
        one = gold.join(h, "label", "left").select(F.lit(k).alias("k"), "label", "n_gold", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), F.coalesce("n_correct", F.lit(0)).alias("n_correct"))
        out = one if out is None else out.unionByName(one)
    return out.withColumns(scores(F.col("n_correct"), F.col("n_predicted"), F.col("n_gold")))


def robustness(baseline: DataFrame, spoilt: DataFrame, ways: list[str]) -> DataFrame:
    """(how, precision, recall, f1, change) of what is found (key, t, label) in texts spoilt in several ways, `how`, against what is
    found in the texts themselves: a find counts if its text and label are in the text's own, however often. Every one of the
    ways has a row, also if nothing is found."""
    b = baseline.select("key", "t", "label").distinct().withColumn("in_base", F.lit(1))
    s = spoilt.select("how", "key", "t", "label").distinct()
    n_base = baseline.select("key", "t", "label").distinct().agg(F.count(F.lit(1)).alias("n_gold"))
    hit = s.join(b, ["key", "t", "label"], "left").groupBy("how").agg(F.count(F.lit(1)).alias("n_predicted"), F.count("in_base").alias("n_correct"))
    every = baseline.sparkSession.createDataFrame([(w,) for w in ways], "how string")
    hit = every.join(hit, "how", "left").na.fill(0)
    r = hit.join(n_base).withColumns(scores(F.col("n_correct"), F.col("n_predicted"), F.col("n_gold")))  # one row
    return r.select("how", "precision", "recall", "f1", (F.col("f1") - 1).alias("change"))


def recognition_rates(rows: DataFrame, groups: list[str], recognised: Column) -> DataFrame:
    """(dimension, value, n, rate, gap): the share recognised in each value of each group and of all groups together; gap is the
    largest less the least rate of the dimension."""
    keys = [F.coalesce(F.col(g), F.lit("unknown")).alias(g) for g in groups]
    dimension = [F.struct(F.lit(g).alias("dimension"), F.col(g).alias("value")) for g in groups] + [F.struct(F.lit(" x ".join(groups)).alias("dimension"), F.concat_ws(" x ", *groups).alias("value"))]
    r = rows.select(*keys, recognised.cast("int").alias("y")).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))  # combinations first: the wide part is counted once
    r = r.select("n", "y", F.inline(F.array(*dimension))).groupBy("dimension", "value").agg(F.sum("n").alias("n"), (F.sum("y") / F.sum("n")).alias("rate"))
    w = Window.partitionBy("dimension")
    return r.withColumn("gap", F.max("rate").over(w) - F.min("rate").over(w))


def stereotype_gap(rows: DataFrame) -> DataFrame:
    """(kind, n, accuracy, gap) of cases (kind: pro, anti or neutral; correct): gap is the accuracy of pro less that of anti."""
    r = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
    w = Window.partitionBy(F.lit(1))  # three rows
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("accuracy"))).over(w)
    return r.withColumn("gap", of("pro") - of("anti"))


def outlier_flags(entities: DataFrame, known: DataFrame, n: int = 3, least_coverage: float = 0.5, least_confidence: float = 0.5) -> DataFrame:
    """(key, coverage, flags) of entities (key, text, confidence) that known (text) does not cover: low_coverage of n-grams, unseen
    text with a coverage under 0.8, low confidence, zero-width characters; only entities with a flag.

    Distinct texts are judged, then joined back, so a text of very many rows is judged once."""
    gram = lambda c: F.array_distinct(char_ngrams(F.lower(c), n))
    train = known.where("text IS NOT NULL").select(F.explode(gram(F.col("text"))).alias("g")).distinct().withColumn("hit", F.lit(1))
    seen = known.where("text IS NOT NULL").select(F.lower("text").alias("t")).distinct().withColumn("seen", F.lit(1))
    texts = entities.where("text IS NOT NULL").select("text").distinct()
    grams = texts.select("text", F.explode(gram(F.col("text"))).alias("g")).join(train, "g", "left").groupBy("text").agg((F.count("hit") / F.count(F.lit(1))).alias("coverage"))
    judged = grams.withColumn("t", F.lower("text")).join(seen, "t", "left")
    j = entities.join(judged, "text")
    flags = F.array_compact(F.array(
        F.when(F.col("coverage") < least_coverage, "low_vocab_coverage"), F.when(F.col("seen").isNull() & (F.col("coverage") < 0.8), "unseen_entity"),
        F.when(F.col("confidence") < least_confidence, "low_confidence"), F.when(F.col("text").rlike(r"[\x{200b}\x{200c}\x{200d}\x{feff}]"), "unusual_characters"),
    ))
    return j.select("key", "coverage", F.array_join(flags, ",").alias("flags")).where("flags <> ''")


def frequency_bands(counts: DataFrame, name: str, share: float = 0.2) -> DataFrame:
    """(name, n, band): of values by falling count, the first ceil(share of them) are head, as many last ones tail, the rest mid.
    As many rows as distinct values; ties go by name."""
    w = Window.orderBy(F.col("n").desc(), name)
    c = counts.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    cut = F.ceil(F.col("__n") * share)
    return c.withColumn("band", F.when(F.col("__i") < cut, "head").when(F.col("__i") >= F.col("__n") - cut, "tail").otherwise("mid")).drop("__i", "__n")


def demonstrations(examples: DataFrame, query: str, query_labels: list[str], density: float, k: int, least: float = 0.1) -> DataFrame:
    """(key, score): the k examples (key, text, labels, density) that help most: 0.4 Jaccard of words, 0.4 the share of the query's
    labels that they show (1 if it has none), 0.2 e^(-difference of densities / 5), if that is at least `least`."""
    q = F.lit(query)
    both_empty = (F.trim(q) == "") & (F.trim("text") == "")
    alike = F.when(both_empty, F.lit(1.0)).otherwise(word_jaccard(F.lower("text"), F.lower(q)))
    if query_labels:
        wanted = F.array(*map(F.lit, query_labels))
        shown = F.size(F.array_intersect(F.array_distinct("labels"), wanted)) / len(set(query_labels))
    else:
        shown = F.lit(1.0)
    score = 0.4 * alike + 0.4 * shown + 0.2 * F.exp(-F.abs(F.col("density") - density) / 5)
    return examples.where("text IS NOT NULL").select("key", F.round(score, 9).alias("score")).where(F.col("score") >= least).orderBy(F.col("score").desc(), "key").limit(k)


STRATEGIES = ("uncertainty", "committee", "hybrid", "random")


def to_annotate(candidates: DataFrame, strategy: str, k: int, weight: float = 0.5, seed: int = 42) -> DataFrame:
    """(key, score): the k candidates (key, text, confidence, disagreement) that are worth most: uncertainty is 1 less the
    confidence, committee the disagreement (uncertainty where there is none), hybrid weight of the one and the rest of the
    other, random a hash. Ties go by key; a missing confidence counts as 0."""
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    unsure = 1 - F.coalesce("confidence", F.lit(0.0))
    score = {
        "uncertainty": unsure, "committee": F.coalesce("disagreement", unsure), "hybrid": weight * unsure + (1 - weight) * F.coalesce("disagreement", F.lit(0.0)),
        "random": hash_share(F.concat(F.coalesce("text", F.lit("")), F.lit(":"), F.col("key").cast("string")), seed),
    }[strategy]
    return candidates.select("key", F.round(score, 9).alias("score")).orderBy(F.col("score").desc(), "key").limit(k)


def farthest_points(vectors: DataFrame, k: int, key: str = "key", vector: str = "vector") -> list[int]:
    """k keys, far from each other: the smallest key first, then always the vector whose nearest chosen one is farthest (the
    smallest key of equals). Each step is one pass that returns one row; k chosen vectors travel with the plan."""
    from .vectors import euclidean

    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    chosen = v.orderBy("key").limit(1).collect()
    while chosen and len(chosen) < k:
        points = [F.array(*[F.lit(float(x)) for x in c["vector"]]) for c in chosen]
        near = F.least(*[euclidean(F.col("vector"), p) for p in points]) if len(points) > 1 else euclidean(F.col("vector"), points[0])
        rest = v.where(~F.col("key").isin([c["key"] for c in chosen])).withColumn("d", F.round(near, 9)).orderBy(F.col("d").desc(), "key").limit(1).collect()
        if not rest:
            break
        chosen += rest
    return [c["key"] for c in chosen]


def spread(values: DataFrame, column: str) -> DataFrame:
    """(n, mean, sd, low, high): a metric over seeds or folds with its interval: sample deviation, 2 + 0.1 / sqrt(n) standard errors
    under 30 values, else 1.96."""
    a = values.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("sd"))
    t = F.when(F.col("n") < 30, 2 + 0.1 / F.sqrt("n")).otherwise(1.96) * F.col("sd") / F.sqrt("n")
    return a.select("n", "mean", "sd", (F.col("mean") - t).alias("low"), (F.col("mean") + t).alias("high"))


def ranking(rows: DataFrame) -> DataFrame:
    """(n, accuracy_at_1, mrr, containment, mean_candidates) of cases (gold_rank, n_candidates); rank 0 or null is absent."""
    there = F.coalesce("gold_rank", F.lit(0)) > 0
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold_rank") == 1).cast("int")).alias("accuracy_at_1"), F.avg(F.when(there, 1 / F.col("gold_rank")).otherwise(F.lit(0.0))).alias("mrr"), F.avg(there.cast("int")).alias("containment"), F.avg("n_candidates").alias("mean_candidates"))
