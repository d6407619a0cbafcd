"""Resolution of mentions to identities: blocked similarity joins, MinHash candidates, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import word_set
from . import graph as G


def equal_classes(records: DataFrame, key: str = "id", text: str = "name", block: str | None = None) -> DataFrame:
    """(member, representative, copies): records of equal text (and block) and the smallest key among them. Null texts are
    in no class. Equal texts may be any share of the rows: they are counted before they are shuffled."""
    by = [F.col(text).alias("t"), (F.col(block) if block else F.lit(0)).alias("g")]
    r = records.where(F.col(text).isNotNull()).select(F.col(key).alias("member"), *by)
    classes = r.groupBy("t", "g").agg(F.min("member").alias("representative"), F.count(F.lit(1)).alias("copies"))
    j = r.join(classes, (r["t"] == classes["t"]) & r["g"].eqNullSafe(classes["g"]))
    return j.select("member", "representative", "copies")


def _representatives(records: DataFrame, key: str, text: str, block: str | None) -> DataFrame:
    """(k, t, g, copies): one row a class of `equal_classes`."""
    r = records.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(block) if block else F.lit(0)).alias("g"))
    return r.groupBy("t", "g").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("copies"))


def jaccard_pairs(records: DataFrame, threshold: float, key: str = "id", text: str = "name", block: str | None = None) -> DataFrame:
    """(left, right, similarity, links): pairs of different texts with word Jaccard of at least the threshold, left < right.
    A text is named by its smallest key; `links` is the number of pairs of records behind a pair (`equal_classes` has who
    they are). Without words there is no pair.

    An exact prefix filter: with words in order of rising frequency, two sets of that similarity share a word among
    the first |x| - ceil(t |x|) + 1 of each, so hot words block nothing. Frequencies are counted over all different texts."""
    one = _representatives(records, key, text, block)
    r = one.select("k", word_set(F.lower(F.col("t"))).alias("w"), "g", "copies").where(F.size("w") > 0)
    words = r.select("k", "g", F.explode("w").alias("x"), F.size("w").alias("n"))
    frequency = words.groupBy("x").agg(F.count(F.lit(1)).alias("f"))
    ranked = words.join(frequency, "x").withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("f", "x")))
    prefix = ranked.where(F.col("p") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("k", "g", "x", "n")
    a, b = (prefix.select("g", "x", F.col("k").alias(s), F.col("n").alias("n" + s)) for s in ("left", "right"))
    pairs = a.join(b, ["g", "x"]).where((F.col("left") < F.col("right")) & (F.least("nleft", "nright") >= threshold * F.greatest("nleft", "nright") - 1e-9)).select("left", "right").distinct()
    sets = r.select("k", "w", "copies")
    j = pairs.join(sets.withColumnsRenamed({"k": "left", "w": "a", "copies": "ca"}), "left").join(sets.withColumnsRenamed({"k": "right", "w": "b", "copies": "cb"}), "right")
    common = F.size(F.array_intersect("a", "b"))
    j = j.withColumn("similarity", common / (F.size("a") + F.size("b") - common)).where(F.col("similarity") >= threshold - 1e-9)
    return j.select("left", "right", "similarity", (F.col("ca") * F.col("cb")).alias("links"))


def minhash_candidates(records: DataFrame, bands: int = 5, rows: int = 3, key: str = "id", text: str = "name") -> DataFrame:
    """(left, right): different texts, each named by its smallest key, that share a band of MinHash values over character
    trigrams, left < right; `equal_classes` has the records of equal text.

    Hashes are the first 15 hex digits of md5(seed:trigram), so that other engines can compute the same."""
    from ..functions.text import char_ngrams

    g = _representatives(records, key, text, None).withColumnRenamed("t", text).select("k", F.array_distinct(char_ngrams(F.lower(F.col(text)), 3)).alias("grams"))
    sign = lambda i: F.array_min(F.transform("grams", lambda x: F.substring(F.md5(F.concat(F.lit(f"{i}:"), x)), 1, 15)))
    band = F.array(*[F.concat_ws("-", F.lit(str(b)), *[sign(b * rows + r) for r in range(rows)]) for b in range(bands)])
    e = g.select("k", F.explode(band).alias("h"))
    a, b = e.withColumnRenamed("k", "left"), e.withColumnRenamed("k", "right")
    return a.join(b, "h").where("left < right").select("left", "right").distinct()


def identities(mentions: DataFrame, pairs: DataFrame, block: str | None = None) -> DataFrame:
    """(identity, n_mentions, canonical_name): clusters of mentions (id, name) joined by pairs of their texts; singletons too."""
    classes = equal_classes(mentions, block=block).select(F.col("member").alias("id"), "representative")
    c = G.components(pairs.select(F.col("left").alias("source"), F.col("right").alias("target")), classes.select(F.col("representative").alias("node")))
    of = classes.join(c.withColumnsRenamed({"node": "representative", "component": "identity"}), "representative").select("id", "identity")
    j = mentions.join(of, "id", "left").withColumn("identity", F.coalesce("identity", "id"))
    return j.groupBy("identity").agg(F.count(F.lit(1)).alias("n_mentions"), F.max_by("name", F.struct(F.length("name"), -F.col("id"))).alias("canonical_name"))


def resolver_pairs(records: DataFrame, threshold: float = 0.7, block: str | None = "kind") -> DataFrame:
    """(left, right, similarity): records (id, name, vector, kind) that mean the same: two with vectors if (cosine + 1) / 2 reaches the
    threshold, others by the word Jaccard of their names; of one kind, or with block=None of any."""
    from .vectors import cosine_pairs

    by_vector = cosine_pairs(records.where("vector IS NOT NULL"), 2 * threshold - 1, "id", "vector", block).select("left", "right", ((F.col("cosine") + 1) / 2).alias("similarity"))
    # A text may stand with a vector here and without one there: each of the two is named by its own smallest key.
    bare, has = F.when(F.col("vector").isNull(), F.col("id")), F.when(F.col("vector").isNotNull(), F.col("id"))
    of = records.where("name IS NOT NULL").groupBy("name", *([block] if block else [])).agg(F.min("id").alias("rep"), F.min(bare).alias("bare"), F.min(has).alias("has"))
    side = lambda x: of.select(F.col("rep").alias(x), F.col("bare").alias(f"{x}_bare"), F.col("has").alias(f"{x}_has"))
    named = jaccard_pairs(records, threshold, block=block).select("left", "right", "similarity").join(side("left"), "left").join(side("right"), "right")
    ends = F.filter(F.array(*[F.struct(F.col(f"left_{a}").alias("a"), F.col(f"right_{b}").alias("b")) for a, b in (("bare", "bare"), ("bare", "has"), ("has", "bare"))]), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    by_name = named.select(F.explode(ends).alias("x"), "similarity").select(F.least("x.a", "x.b").alias("left"), F.greatest("x.a", "x.b").alias("right"), "similarity")
    return by_vector.unionByName(by_name)
