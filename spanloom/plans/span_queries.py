"""Queries over patterns, spans and their joins."""

from pyspark.sql import functions as F

from ..functions.text import canonical_label
from ..operators import patterns as P
from ..operators import spans as S
from ..queries import query
from ..session import read_table as t
from ..session import read_texts
from .text_queries import LABEL


def _pattern(name: str, pattern: str, spark_pattern: str | None = None) -> None:
    p = pattern.replace("'", "''")
    sql = f"""WITH d AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '{p}'), lambda x: length(x)) AS g, regexp_extract_all(text, '{p}') AS m FROM documents WHERE text IS NOT NULL),
        x AS (SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM d)
        SELECT doc_id, (list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start_char, m[i] AS surface FROM x"""

    @query(name, sql)
    def run(spark, d, pattern=spark_pattern or pattern):
        return P.pattern_spans(read_texts(spark, d), pattern, unicode=False).select("doc_id", F.col("start_char").cast("long").alias("start_char"), "surface")


# Disjoint from one another and free of dialect differences between Java's regex and RE2.
# The look-behind keeps long encoded runs from being tried at each of their characters; RE2 needs and knows none.
_pattern("extract_emails", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
_pattern("extract_dates_iso", r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_pattern("extract_dates_numeric", r"[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}")
_pattern("extract_percent", r"[0-9]+(?:\.[0-9]+)? ?%")
_pattern("extract_hashtags", r"#[a-z]+")
_pattern("extract_mentions", r"@[a-z]+_?[a-z]+")
_pattern("extract_times", r"\[[0-9]{2}:[0-9]{2}\]")
_pattern("extract_money", r"[0-9]+ (?:million )?crowns")
_pattern("extract_dates_cjk", r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日")
_pattern("extract_phones_intl", r"\+[0-9]{1,3} [0-9]{1,5} [0-9]{3,6}")


@query("pattern_stack")
def pattern_stack(spark, d):
    return P.pattern_stack(read_texts(spark, d))


@query("pattern_stack_counts")
def pattern_stack_counts(spark, d):
    return P.pattern_stack(read_texts(spark, d)).groupBy("label", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query("query_filter_range", "SELECT pred_id, text, label FROM predictions WHERE lower(label) IN ('per', 'person') AND contains(lower(text), 'an') AND confidence >= 0.6 AND start_char >= 100 AND end_char <= 900")
def query_filter_range(spark, d):
    return S.query_spans(t(spark, d, "predictions"), ["PER", "PERSON"], "an", 0.6, 100, 900).select("pred_id", "text", "label")


@query(
    "validation_issues",
    """WITH x AS (SELECT p.*, d.text AS doc, length(d.text) AS n FROM predictions p JOIN documents d ON p.doc_id = d.doc_id WHERE start_char IS NOT NULL AND end_char IS NOT NULL),
       y AS (SELECT pred_id, array_to_string(list_filter([CASE WHEN start_char >= end_char THEN 'start_not_before_end' END, CASE WHEN end_char > n THEN 'end_after_text' END,
       CASE WHEN start_char < end_char AND end_char <= n AND substring(doc, start_char + 1, end_char - start_char) <> text THEN 'text_differs' END,
       CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_outside' END, CASE WHEN trim(text) = '' THEN 'empty_text' END], lambda v: v IS NOT NULL), ',') AS issues FROM x)
       SELECT * FROM y WHERE issues <> ''""",
)
def validation_issues(spark, d):
    return S.validation_issues(t(spark, d, "predictions"), t(spark, d, "documents"))


_LOC = "(SELECT * FROM predictions WHERE start_char IS NOT NULL AND end_char IS NOT NULL)"
_PAIRS = f"SELECT a.doc_id, a.pred_id AS l, b.pred_id AS r, a.start_char AS s1, a.end_char AS e1, b.start_char AS s2, b.end_char AS e2 FROM {_LOC} a JOIN {_LOC} b ON a.doc_id = b.doc_id AND a.pred_id < b.pred_id AND a.start_char < b.end_char AND b.start_char < a.end_char WHERE a.start_char < a.end_char AND b.start_char < b.end_char"


@query(
    "overlap_pairs",
    f"""WITH p AS ({_PAIRS}), q AS (SELECT *, greatest(0, least(e1, e2) - greatest(s1, s2)) AS c FROM p)
        SELECT doc_id, l AS left_id, r AS right_id, round(c / ((e1 - s1) + (e2 - s2) - c)::DOUBLE, 6) AS iou, round(c / (greatest(e1, e2) - least(s1, s2))::DOUBLE, 6) AS hull_iou FROM q""",
)
def overlap_pairs(spark, d):
    c = [F.col(x) for x in ("s1", "e1", "s2", "e2")]
    return S.overlapping_pairs(t(spark, d, "predictions")).select("doc_id", F.col("left").alias("left_id"), F.col("right").alias("right_id"), F.round(S.iou(*c), 6).alias("iou"), F.round(S.hull_iou(*c), 6).alias("hull_iou"))


@query(
    "proximity_pairs",
    f"""SELECT a.doc_id, a.pred_id AS left_id, b.pred_id AS right_id, greatest(0, greatest(a.start_char, b.start_char) - least(a.end_char, b.end_char)) AS gap FROM {_LOC} a JOIN {_LOC} b
        ON a.doc_id = b.doc_id AND (a.start_char < b.start_char OR (a.start_char = b.start_char AND a.pred_id < b.pred_id))
        WHERE greatest(0, greatest(a.start_char, b.start_char) - least(a.end_char, b.end_char)) <= 30""",
)
def proximity_pairs(spark, d):
    return S.proximity_pairs(t(spark, d, "predictions"), 30).withColumnsRenamed({"left": "left_id", "right": "right_id"})


@query("valid_at", "SELECT pred_id FROM predictions WHERE (extracted_at IS NULL OR extracted_at <= TIMESTAMPTZ '2024-09-01 00:00:00+00') AND (ingested_at IS NULL OR ingested_at >= TIMESTAMPTZ '2024-09-01 00:00:00+00')")
def valid_at(spark, d):
    """Entities extracted by a moment and ingested from it on: both bounds inclusive, null is open."""
    return S.valid_at(t(spark, d, "predictions"), F.expr("TIMESTAMP '2024-09-01 00:00:00Z'"), "extracted_at", "ingested_at").select("pred_id")


@query("valid_at_event", "SELECT k.kb_id, e.event_id FROM kb_entities k JOIN (SELECT event_id, ts FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) = 1) e ON k.updated_at IS NULL OR k.updated_at <= e.ts")
def valid_at_event(spark, d):
    """Catalogue entries that were current at the last event."""
    e = t(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    kb = t(spark, d, "kb_entities").withColumns({"from_": F.col("updated_at").cast("timestamp"), "until": F.lit(None).cast("timestamp")}).join(F.broadcast(e))  # one row
    return S.valid_at(kb, F.col("ts"), "from_", "until").select("kb_id", "event_id")


@query(
    "document_stats",
    "SELECT doc_id, count(*) AS n_spans, count(start_char) AS n_located, count(*) FILTER (confidence >= 0.8) AS n_confident, count(DISTINCT lower(text)) AS n_texts, round(coalesce(avg(confidence), 0), 9) AS mean_confidence FROM predictions GROUP BY doc_id",
)
def document_stats(spark, d):
    return S.document_stats(t(spark, d, "predictions")).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(
    "nearest_antecedent",
    f"""WITH l AS (SELECT *, {LABEL} AS kind FROM {_LOC}), x AS (SELECT doc_id, pred_id, kind, last_value(CASE WHEN kind = 'ORG' THEN pred_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start_char, end_char, pred_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent FROM l)
        SELECT doc_id, pred_id, antecedent FROM x WHERE kind = 'PER' AND antecedent IS NOT NULL""",
)
def nearest_antecedent(spark, d):
    """The last organisation before each person, whatever the notation of their labels."""
    p = t(spark, d, "predictions").withColumn("kind", canonical_label(F.col("label")))
    return S.nearest_before(p, F.col("kind") == "PER", F.col("kind") == "ORG")


@query(
    "outermost_spans",
    f"""WITH p AS ({_PAIRS}), i AS (SELECT CASE WHEN s1 <= s2 AND e1 >= e2 THEN r WHEN s2 <= s1 AND e2 >= e1 THEN l END AS pred_id FROM p)
        SELECT pred_id FROM {_LOC} x WHERE pred_id NOT IN (SELECT pred_id FROM i WHERE pred_id IS NOT NULL)""",
)
def outermost_spans(spark, d):
    return S.outermost(t(spark, d, "predictions")).select("pred_id")


@query("latest_versions", "SELECT pred_id FROM predictions QUALIFY row_number() OVER (PARTITION BY doc_id, model_name, ent_idx ORDER BY ingested_at DESC, pred_id DESC) = 1")
def latest_versions(spark, d):
    return S.latest_versions(t(spark, d, "predictions")).select("pred_id")


@query("linked_spans_semi", "SELECT pred_id FROM predictions WHERE text IN (SELECT kb_name FROM kb_entities)")
def linked_spans_semi(spark, d):
    return t(spark, d, "predictions").join(t(spark, d, "kb_entities").select(F.col("kb_name").alias("text")), "text", "left_semi").select("pred_id")


@query("untracked_spans_anti", "SELECT pred_id FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM match_pairs m WHERE m.left_id = p.pred_id OR m.right_id = p.pred_id)")
def untracked_spans_anti(spark, d):
    m = t(spark, d, "match_pairs")
    ends = m.select(F.col("left_id").alias("pred_id")).unionByName(m.select(F.col("right_id").alias("pred_id"))).where("pred_id IS NOT NULL").distinct()
    return t(spark, d, "predictions").join(ends, "pred_id", "left_anti").select("pred_id")


@query("knowledge_base_link", "SELECT p.pred_id, coalesce(k.kb_id, -1) AS kb_id, coalesce(k.entity_type, 'NEW') AS kind FROM predictions p LEFT JOIN (SELECT lower(kb_name) AS n, min(kb_id) AS kb_id, min(entity_type) AS entity_type FROM kb_entities GROUP BY 1) k ON lower(trim(p.text)) = k.n")
def knowledge_base_link(spark, d):
    kb = t(spark, d, "kb_entities").groupBy(F.lower("kb_name").alias("n")).agg(F.min("kb_id").alias("kb_id"), F.min("entity_type").alias("entity_type"))
    p = t(spark, d, "predictions").withColumn("n", F.lower(F.trim("text")))
    return p.join(kb, "n", "left").select("pred_id", F.coalesce("kb_id", F.lit(-1)).alias("kb_id"), F.coalesce("entity_type", F.lit("NEW")).alias("kind"))


@query("entity_summary", "SELECT model_name, label, count(*) AS n, count(DISTINCT doc_id) AS n_docs, round(avg(confidence), 9) AS mean_confidence FROM predictions GROUP BY ALL")
def entity_summary(spark, d):
    return t(spark, d, "predictions").groupBy("model_name", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))
