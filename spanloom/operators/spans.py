"""Filters, validation and joins over spans (rows of doc_id, start_char, end_char, text, label, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BUCKET = 256  # characters a bucket of the range join


def located(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("start_char").isNotNull() & F.col("end_char").isNotNull())


def query_spans(spans: DataFrame, labels: list[str] | None = None, contains: str | None = None, min_confidence: float | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """All given conditions together: label (any of, without case), part of the text (without case), confidence, range."""
    if labels is not None:
        spans = spans.where(F.lower("label").isin([x.lower() for x in labels]))
    if contains is not None:
        spans = spans.where(F.contains(F.lower("text"), F.lit(contains.lower())))
    if min_confidence is not None:
        spans = spans.where(F.col("confidence") >= min_confidence)
    if start is not None and end is not None:
        spans = spans.where((F.col("start_char") >= start) & (F.col("end_char") <= end))
    return spans


def validation_issues(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """(pred_id, issues): what is wrong with a span, as an array in fixed order; only spans with any."""
    d = documents.select("doc_id", F.col("text").alias("doc"), F.length("text").alias("n"))
    j = located(spans).join(d, "doc_id")
    s, e = F.col("start_char"), F.col("end_char")
    issues = F.array_compact(
        F.array(
            F.when(s >= e, "start_not_before_end"),
            F.when(e > F.col("n"), "end_after_text"),
            F.when((s < e) & (e <= F.col("n")) & (F.expr("substring(doc, start_char + 1, end_char - start_char)") != F.col("text")), "text_differs"),
            F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence_outside"),
            F.when(F.trim("text") == "", "empty_text"),
        )
    )
    return j.select("pred_id", F.array_join(issues, ",").alias("issues")).where("issues <> ''")


def overlaps(a: DataFrame, b: DataFrame) -> Column:
    return (a["start_char"] < b["end_char"]) & (b["start_char"] < a["end_char"])


def overlapping_pairs(spans: DataFrame, key: str = "pred_id") -> DataFrame:
    """(left, right): pairs of one document whose spans overlap, left < right.

    A range join in buckets: a span goes to each bucket of BUCKET characters that it touches, pairs meet in the
    bucket where the later of them starts, so each is found once and a long document is no single key."""
    s = located(spans).where("start_char < end_char").select("doc_id", key, "start_char", "end_char")
    s = s.withColumn("bucket", F.explode(F.sequence(F.expr(f"start_char div {BUCKET}"), F.expr(f"(end_char - 1) div {BUCKET}"))))
    a = s.select("doc_id", "bucket", F.col(key).alias("left"), F.col("start_char").alias("s1"), F.col("end_char").alias("e1"))
    b = s.select("doc_id", "bucket", F.col(key).alias("right"), F.col("start_char").alias("s2"), F.col("end_char").alias("e2"))
    j = a.join(b, ["doc_id", "bucket"]).where((F.col("left") < F.col("right")) & (F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")))
    return j.where(F.expr(f"greatest(s1, s2) div {BUCKET}") == F.col("bucket")).select("doc_id", "left", "right", "s1", "e1", "s2", "e2")


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Of two spans, over the sum of their lengths less the common part; 0 if apart."""
    common = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def hull_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The same over the hull of both."""
    common = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when((common > 0) & (hull > 0), common / hull).otherwise(F.lit(0.0))


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.greatest(s1, s2) - F.least(e1, e2))


def proximity_pairs(spans: DataFrame, max_gap: int, key: str = "pred_id") -> DataFrame:
    """(doc_id, left, right, gap): pairs of a document at most max_gap characters apart, by start then key.

    A span goes to every bucket, of a width that the data do not change, between its start and the last place where a
    partner may start; it meets the spans that start there. Each pair is found once, and a very long span costs buckets,
    not wider ones."""
    s = located(spans).where("start_char <= end_char").select("doc_id", key, "start_char", "end_char")
    width = max(BUCKET, max_gap + 1)
    reach = F.sequence(F.expr(f"start_char div {width}"), F.expr(f"(end_char + {max_gap}) div {width}"))
    a = s.select("doc_id", F.explode(reach).alias("bucket"), F.col(key).alias("left"), F.col("start_char").alias("s1"), F.col("end_char").alias("e1"))
    b = s.select("doc_id", F.expr(f"start_char div {width}").alias("bucket"), F.col(key).alias("right"), F.col("start_char").alias("s2"), F.col("end_char").alias("e2"))
    j = a.join(b, ["doc_id", "bucket"]).where((F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("left") < F.col("right"))))
    return j.withColumn("gap", gap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))).where(F.col("gap") <= max_gap).select("doc_id", "left", "right", "gap")


def valid_at(facts: DataFrame, at: Column, start: str, end: str) -> DataFrame:
    """Rows valid at a time: both bounds inclusive, null is open."""
    return facts.where((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) >= at)))


def document_stats(spans: DataFrame) -> DataFrame:
    """One row a document: counts, located and confident spans, distinct texts, mean confidence (0 without any)."""
    return spans.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_if(F.col("start_char").isNotNull()).alias("n_located"),
        F.count_if(F.col("confidence") >= 0.8).alias("n_confident"),
        F.count_distinct(F.lower("text")).alias("n_texts"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
    )


def nearest_before(spans: DataFrame, of: Column, to: Column, key: str = "pred_id") -> DataFrame:
    """(key, antecedent): for each span of kind `of`, the last span of kind `to` that starts before it, if any.

    One window pass a document instead of a self-join."""
    w = Window.partitionBy("doc_id").orderBy("start_char", "end_char", key).rowsBetween(Window.unboundedPreceding, -1)
    s = located(spans).withColumn("antecedent", F.last(F.when(to, F.col(key)), ignorenulls=True).over(w))
    return s.where(of & F.col("antecedent").isNotNull()).select("doc_id", key, "antecedent")


def outermost(spans: DataFrame, key: str = "pred_id") -> DataFrame:
    """Spans that no other span of the document holds (of equal spans the smallest key stays)."""
    s = located(spans)
    pairs = overlapping_pairs(s, key)
    inner = pairs.select(
        F.when((F.col("s1") <= F.col("s2")) & (F.col("e1") >= F.col("e2")), F.col("right")).when((F.col("s2") <= F.col("s1")) & (F.col("e2") >= F.col("e1")), F.col("left")).alias(key)
    ).where(F.col(key).isNotNull()).distinct()
    return s.join(inner, key, "left_anti")


def latest_versions(spans: DataFrame) -> DataFrame:
    """Of entities ingested again (equal doc_id, model_name, ent_idx) the last ingested; ties go to the larger pred_id."""
    w = Window.partitionBy("doc_id", "model_name", "ent_idx").orderBy(F.col("ingested_at").desc(), F.col("pred_id").desc())
    return spans.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
