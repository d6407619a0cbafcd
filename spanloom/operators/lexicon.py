"""Names of a list found in texts, and lists of labels with their vectors.

A lexicon is a table (name, label): whatever its size, it is joined. Texts are cut into runs of one to `longest` words that the lexicon's
first words let pass, so what is joined is near what can match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def _key(c):
    """Words in lower case, joined by one blank."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("(?U)" + WORD), F.lit(0)), " ")


def words(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, word, start_char, end_char): runs of letters and digits, by windows over the texts' pieces."""
    d = documents.where("text IS NOT NULL").select("doc_id", F.regexp_extract_all("text", F.lit("(?U)" + WORD), F.lit(0)).alias("w"), F.split("text", "(?U)" + WORD, -1).alias("g"))
    p = d.select("doc_id", F.posexplode(F.filter(F.arrays_zip("w", "g"), lambda x: x["w"].isNotNull())).alias("pos", "x"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    end = F.sum(F.length("x.w") + F.length("x.g")).over(w).cast("int")
    return p.select("doc_id", "pos", F.col("x.w").alias("word"), (end - F.length("x.w")).alias("start_char"), end.alias("end_char"))


def lexicon_entities(documents: DataFrame, lexicon: DataFrame, longest: int = 6) -> DataFrame:
    """(doc_id, start_char, end_char, surface, label): every place where the words of a name of the lexicon (of at most `longest` words)
    stand one after the other, whatever the case and what is between the words; names within names come out, too. Null names
    and names without words are left out; a name of several labels gives a row each."""
    x = lexicon.where("name IS NOT NULL").select(_key(F.col("name")).alias("key"), "label").where("key <> ''").distinct()
    x = x.withColumns({"first": F.substring_index("key", " ", 1), "n": F.size(F.split("key", " "))}).where(F.col("n") <= longest)
    lengths = x.groupBy("first").agg(F.sort_array(F.collect_set("n")).alias("ns"))  # at most `longest` numbers a word
    t = words(documents).withColumn("low", F.lower("word"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, longest - 1)
    t = t.withColumn("run", F.collect_list(F.struct("low", "end_char")).over(w))
    c = t.join(lengths, F.col("low") == F.col("first")).select("doc_id", "start_char", "run", F.explode("ns").alias("n")).where(F.size("run") >= F.col("n"))
    part = F.slice("run", F.lit(1), F.col("n"))
    c = c.select("doc_id", "start_char", F.element_at(part, -1)["end_char"].alias("end_char"), F.array_join(F.transform(part, lambda r: r["low"]), " ").alias("key"))
    found = c.join(x.select("key", "label"), "key")
    d = documents.select("doc_id", "text")
    return found.join(d, "doc_id").select("doc_id", "start_char", "end_char", F.expr("substring(text, start_char + 1, end_char - start_char)").alias("surface"), "label")


class Registry:
    """Labels of entities and relations with what they mean and, if known, a vector."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str, list[float] | None]] = []

    def entity(self, label: str, description: str = "", vector: list[float] | None = None) -> Registry:
        return self._add(label, "entity", description, vector)

    def relation(self, label: str, description: str = "", vector: list[float] | None = None) -> Registry:
        return self._add(label, "relation", description, vector)

    def _add(self, label: str, kind: str, description: str, vector: list[float] | None) -> Registry:
        if any(r[:2] == (label, kind) for r in self.rows):
            raise ValueError(f"{kind} {label} is there")
        self.rows.append((label, kind, description, vector))
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        """(label, kind, description, vector)"""
        return spark.createDataFrame(self.rows, "label string, kind string, description string, vector array<double>")


def nearest_labels(spans: DataFrame, registry: DataFrame, threshold: float = 0.5, kind: str = "entity") -> DataFrame:
    """(key, label, score): spans (key, vector) with the label of a registry whose vector is most alike by cosine, the first by name of
    equals, if it reaches the threshold. A registry is a short list, whose size is checked before it is broadcast."""
    from .vectors import cosine

    r = registry.where((F.col("kind") == kind) & F.col("vector").isNotNull()).select("label", F.col("vector").alias("lv"))
    if r.limit(10_001).count() > 10_000:
        raise ValueError("a registry has at most 10,000 labels")
    j = spans.where("vector IS NOT NULL").join(F.broadcast(r)).select("key", "label", F.round(cosine(F.col("vector"), F.col("lv")), 12).alias("score"))
    best = j.groupBy("key").agg(F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), F.col("label"))).alias("b"))
    return best.select("key", "b.label", "b.score").where(F.col("score") >= threshold)
