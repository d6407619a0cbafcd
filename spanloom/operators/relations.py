"""Relations between spans of a document, told by words between them, by the kinds of both, and by how near they are.

All three operators start from one bucketed join of spans that lie within a gap, so no document is a single key and no pair
beyond the gap is made. Spans carry `kind`, a canonical label. Overlapping spans have no words between them and no relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S

# --- fixed values: rules, the first that holds decides ---------------------------------------------------
# Relation, confidence, kinds of the head and of the tail (empty: any), words of which one stands between.
RULES: list[tuple[str, float, list[str], list[str], list[str]]] = [
    ("CEO_OF", 0.8, ["PER"], ["ORG"], ["ceo of", "chief executive", "leads", "founded"]),
    ("WORKS_FOR", 0.7, ["PER"], ["ORG"], ["works for", "works at", "employed by", "employee of"]),
    ("FOUNDED", 0.8, ["PER"], ["ORG"], ["founded", "co-founded", "started", "established"]),
    ("LOCATED_IN", 0.6, [], ["LOC"], ["in", "at", "based in", "located in", "headquartered in"]),
    ("BORN_IN", 0.7, [], ["LOC"], ["born in", "native of", "from"]),
    ("PART_OF", 0.7, [], [], ["part of", "member of", "belongs to", "subsidiary of"]),
]
# Words between a pair, in the order in which they are asked for.
PAIR_WORDS: list[tuple[str, list[str]]] = [
    ("FOUNDED", ["founded", "founder"]),
    ("WORKS_FOR", ["works for", "employee", "employed"]),
    ("LOCATED_IN", ["located in", "based in", "in "]),
    ("BORN_IN", ["born in"]),
]
# Relations likely between kinds, with their weight, and words that tell one.
LIKELY: list[tuple[str, str, str, float]] = [
    ("PER", "ORG", "WORKS_FOR", 0.7), ("ORG", "PER", "EMPLOYS", 0.7), ("PER", "LOC", "LIVES_IN", 0.6), ("ORG", "LOC", "HEADQUARTERED_IN", 0.7),
    ("PRODUCT", "ORG", "MADE_BY", 0.8), ("ORG", "PRODUCT", "MAKES", 0.8), ("", "DATE", "OCCURRED_ON", 0.5), ("", "TIME", "OCCURRED_ON", 0.5),
]
TOLD: list[tuple[str, str]] = [
    ("ceo", "CEO_OF"), ("founder", "FOUNDED"), ("founded", "FOUNDED"), ("works at", "WORKS_FOR"), ("works for", "WORKS_FOR"), ("employee", "WORKS_FOR"), ("headquartered", "HEADQUARTERED_IN"), ("based in", "LOCATED_IN"),
    ("located in", "LOCATED_IN"), ("born in", "BORN_IN"), ("lives in", "LIVES_IN"), ("announced", "ANNOUNCED"), ("released", "RELEASED"), ("acquired", "ACQUIRED"), ("bought", "ACQUIRED"), ("merged", "MERGED_WITH"),
]
# ---------------------------------------------------------------------------------------------------------


def _pairs(spans: DataFrame, documents: DataFrame, max_gap: int) -> DataFrame:
    """(doc_id, first, second, their kinds, offsets and confidences, n, between): pairs that do not overlap, the first first."""
    s = S.located(spans).where("start_char < end_char")
    near = S.proximity_pairs(s, max_gap)
    side = lambda name, x: s.select(F.col("pred_id").alias(name), *[F.col(c).alias(f"{x}_{c}") for c in ("kind", "start_char", "end_char", "confidence")])
    j = near.join(side("left", "a"), "left").join(side("right", "b"), "right").where("b_start_char >= a_end_char")
    d = documents.where("text IS NOT NULL").select("doc_id", F.col("text").alias("doc"), F.length("text").alias("n"))
    between = F.lower(F.expr("substring(doc, a_end_char + 1, b_start_char - a_end_char)"))
    return j.join(d, "doc_id").withColumn("between", between).drop("doc").withColumnsRenamed({"left": "first", "right": "second"})


def _holds_one(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def _ordered(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair, as head and tail."""
    ways = F.array(
        *[
            F.struct(F.col(h).alias("head_id"), F.col(t).alias("tail_id"), *[F.col(f"{x}_{c}").alias(f"{name}_{c}") for x, name in ((a, "head"), (b, "tail")) for c in ("kind", "start_char", "end_char", "confidence")])
            for h, t, a, b in (("first", "second", "a", "b"), ("second", "first", "b", "a"))
        ]
    )
    return pairs.select("doc_id", "n", "between", "gap", F.inline(ways))


def relations(spans: DataFrame, documents: DataFrame, max_gap: int = 50) -> DataFrame:
    """(doc_id, head_id, tail_id, relation, confidence): ordered pairs at most max_gap apart of kinds that a rule joins, with one
    of its words between them, whichever stands first."""
    p = _ordered(_pairs(spans, documents, max_gap))
    found = F.lit(None).cast("struct<relation:string,confidence:double>")
    for name, sure, heads, tails, words in reversed(RULES):
        kinds = (F.col("head_kind").isin(heads) if heads else F.lit(True)) & (F.col("tail_kind").isin(tails) if tails else F.lit(True))
        found = F.when(kinds & _holds_one(F.col("between"), words), F.struct(F.lit(name).alias("relation"), F.lit(sure).alias("confidence"))).otherwise(found)
    return p.withColumn("x", found).where("x IS NOT NULL").select("doc_id", "head_id", "tail_id", "x.relation", "x.confidence")


def pair_relations(spans: DataFrame, documents: DataFrame, fallback: str = "RELATED", max_gap: int = 200, first: int = 50) -> DataFrame:
    """(doc_id, head_id, tail_id, relation): each pair of the first spans of a document, at most max_gap apart, in reading order,
    named by the words between them or by the fallback. The bound on spans is what this operator is defined by."""
    w = Window.partitionBy("doc_id").orderBy("start_char", "end_char", "pred_id")
    s = S.located(spans).where("start_char < end_char").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= first).drop("__n")
    p = _pairs(s, documents, max_gap)
    name = F.lit(fallback)
    for relation, words in reversed(PAIR_WORDS):
        name = F.when(_holds_one(F.col("between"), words), F.lit(relation)).otherwise(name)
    return p.select("doc_id", F.col("first").alias("head_id"), F.col("second").alias("tail_id"), name.alias("relation"))


def scored_relations(spans: DataFrame, documents: DataFrame, threshold: float = 0.3, max_gap: int = 300) -> DataFrame:
    """(doc_id, head_id, tail_id, relation, confidence): the surest relation of each ordered pair at most max_gap apart.

    Nearness is 1 less the distance of the middles over the length of the text. A word between a pair tells a relation with
    (0.6 nearness + 0.4) times the mean confidence of both; without one, and with a nearness above 0.3, the likely relation
    of their kinds has nearness times its weight times that mean. A missing confidence counts as 0."""
    p = _ordered(_pairs(spans, documents, max_gap))
    middle = lambda x: (F.col(f"{x}_start_char") + F.col(f"{x}_end_char")) / 2
    near = 1 - F.least(F.lit(1.0), F.abs(middle("head") - middle("tail")) / F.greatest(F.col("n"), F.lit(1)))
    mean = (F.coalesce("head_confidence", F.lit(0.0)) + F.coalesce("tail_confidence", F.lit(0.0))) / 2
    told, likely, weight = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for word, name in reversed(TOLD):
        told = F.when(F.contains("between", F.lit(word)), F.lit(name)).otherwise(told)
    for h, t, name, w in reversed(LIKELY):
        of = (F.col("tail_kind") == t) if not h else (F.col("head_kind") == h) & (F.col("tail_kind") == t)
        likely, weight = F.when(of, F.lit(name)).otherwise(likely), F.when(of, F.lit(w)).otherwise(weight)
    p = p.withColumns({"near": near, "mean": mean, "told": told, "likely": likely, "weight": weight})
    by_word = F.col("told").isNotNull() & ((F.col("near") * 0.6 + 0.4) * F.col("mean") >= threshold)
    p = p.withColumn("relation", F.when(by_word, F.col("told")).when(F.col("near") > 0.3, F.col("likely")))
    p = p.withColumn("confidence", F.when(by_word, (F.col("near") * 0.6 + 0.4) * F.col("mean")).otherwise(F.col("near") * F.col("weight") * F.col("mean")))
    return p.where((F.col("relation").isNotNull()) & (F.col("confidence") >= threshold)).select("doc_id", "head_id", "tail_id", "relation", "confidence")


def same_mention(spans: DataFrame, vectors: DataFrame | None = None, max_distance: int = 500, least_cosine: float = 0.85, key: str = "pred_id") -> DataFrame:
    """(doc_id, left, right): spans of one kind in a document that mean the same: equal texts or one in the other (without
    case) wherever they stand, or, where vectors (key, vector) are given, middles within max_distance and a cosine of at
    least least_cosine. Equal texts stand as one, their first span; left < right by key.

    Texts that hold each other are found by their words: a text of several words holds each of them, so candidates share
    the first word of the shorter; a part of a word is no match."""
    from .vectors import cosine

    s = S.located(spans).where("text IS NOT NULL AND kind IS NOT NULL").withColumn("t", F.lower(F.trim("text")))
    words = F.filter(F.split("t", r"\s+"), lambda w: w != "")
    one = s.groupBy("doc_id", "kind", "t").agg(F.min(key).alias("k")).withColumn("w", words).where(F.size("w") > 0)
    shorter = one.select("doc_id", "kind", F.get("w", F.lit(0)).alias("x"), F.col("k").alias("a"), F.col("t").alias("ta"))
    longer = one.select("doc_id", "kind", F.explode(F.array_distinct("w")).alias("x"), F.col("k").alias("b"), F.col("t").alias("tb"))
    inside = F.contains(F.concat(F.lit(" "), F.array_join(F.split("tb", r"\s+"), " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(F.split("ta", r"\s+"), " "), F.lit(" ")))
    found = shorter.join(longer, ["doc_id", "kind", "x"]).where((F.col("a") != F.col("b")) & inside).select("doc_id", F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"))
    if vectors is not None:
        near = S.proximity_pairs(s, max_distance, key)
        of = lambda name, v: s.select(F.col(key).alias(name), F.col("kind").alias(f"{name}_kind")).join(vectors.select(F.col(key).alias(name), F.col("vector").alias(v)), name)
        j = near.join(of("left", "va"), "left").join(of("right", "vb"), "right").where((F.col("left_kind") == F.col("right_kind")) & (cosine(F.col("va"), F.col("vb")) >= least_cosine))
        found = found.unionByName(j.select("doc_id", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")))
    return found.distinct()
