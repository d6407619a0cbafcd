"""Queries over robustness, few examples, outliers, agreement and discourse."""

from pyspark.sql import functions as F
from pyspark.sql import Window


from ..functions.text import canonical_label, label_category
from ..queries import query
from ..session import read_table as t
from .text_queries import _CAT, LABEL

_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_EMAIL_ONCE = r"(?<![a-zA-Z0-9._%+-])" + _EMAIL
_VARIANTS = {"baseline": "text", "upper": "upper(text)", "lower": "lower(text)", "line_breaks": "replace(text, ' ', chr(10))", "no_punctuation": "regexp_replace(text, '[.,;:!?]', '', 'g')"}


@query("schema_mapping", f"WITH x AS (SELECT label AS raw, {LABEL} AS label, {_CAT} AS category FROM predictions WHERE label IS NOT NULL) SELECT category, count(DISTINCT raw) AS notations, count(DISTINCT label) AS labels, count(*) AS n, round(1 - count(DISTINCT label) / count(DISTINCT raw)::DOUBLE, 9) AS loss FROM x GROUP BY category")
def schema_mapping(spark, d):
    """Notations and labels that each category takes in, and the share of distinctions lost."""
    c = canonical_label(F.col("label"))
    x = t(spark, d, "predictions").where("label IS NOT NULL").select(F.col("label").alias("raw"), c.alias("label"), label_category(c).alias("category"))
    return x.groupBy("category").agg(F.count_distinct("raw").alias("notations"), F.count_distinct("label").alias("labels"), F.count(F.lit(1)).alias("n"), F.round(1 - F.count_distinct("label") / F.count_distinct("raw"), 9).alias("loss"))


@query("outlier_flags", "SELECT count(*) FILTER (regexp_matches(text, '[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]')) AS zero_width, count(*) FILTER (length(text) < 20) AS very_short, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9+/=]{60}')) AS encoded, count(*) FILTER (text = '') AS empty_ FROM documents WHERE text IS NOT NULL")
def outlier_flags(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").where(c.isNotNull()).agg(
        F.count_if(c.rlike(r"[\x{200b}\x{200c}\x{200d}\x{feff}]")).alias("zero_width"), F.count_if(F.length(c) < 20).alias("very_short"), F.count_if(c.rlike("[A-Za-z0-9+/=]{60}")).alias("encoded"), F.count_if(c == "").alias("empty_"),
    )


@query("fleiss_kappa", f"WITH v AS (SELECT doc_id, start_char, end_char, {LABEL} AS label, count(DISTINCT model_name) AS n FROM predictions WHERE start_char IS NOT NULL AND end_char IS NOT NULL AND label IS NOT NULL GROUP BY ALL), s AS (SELECT doc_id, start_char, end_char, sum(n) AS m, sum(n * (n - 1)) AS a FROM v GROUP BY ALL HAVING sum(n) > 1), p AS (SELECT avg(a / (m * (m - 1))::DOUBLE) AS po FROM s), l AS (SELECT label, sum(n) AS n FROM v JOIN s USING (doc_id, start_char, end_char) GROUP BY label), e AS (SELECT sum((n / t) * (n / t)) AS pe FROM l, (SELECT sum(n)::DOUBLE AS t FROM l)) SELECT round(po, 9) AS observed, round(pe, 9) AS expected, round((po - pe) / (1 - pe), 9) AS kappa FROM p, e")
def fleiss_kappa(spark, d):
    """Agreement of models on spans that more than one of them found."""
    k = ["doc_id", "start_char", "end_char"]
    p = t(spark, d, "predictions").where("start_char IS NOT NULL AND end_char IS NOT NULL AND label IS NOT NULL").withColumn("label", canonical_label(F.col("label")))
    v = p.groupBy(*k, "label").agg(F.count_distinct("model_name").alias("n"))
    s = v.groupBy(*k).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("a")).where("m > 1")
    labels = v.join(s.select(*k), k).groupBy("label").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row a label
    expected = labels.select((share * share).alias("q")).agg(F.sum("q").alias("pe"))
    r = s.agg(F.avg(F.col("a") / (F.col("m") * (F.col("m") - 1))).alias("po")).join(expected)  # one row each
    return r.select(F.round("po", 9).alias("observed"), F.round("pe", 9).alias("expected"), F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 9).alias("kappa"))


# Nouns that stand for something said before, by class; words that open a clause.
SHELL_NOUNS = {"problem": "factual", "fact": "factual", "reason": "factual", "result": "factual", "claim": "linguistic", "report": "linguistic", "question": "linguistic", "answer": "linguistic", "decision": "mental", "plan": "mental", "view": "mental", "opinion": "mental", "chance": "modal", "duty": "modal", "meeting": "eventive", "journey": "eventive", "survey": "eventive", "trial": "eventive"}
CLAUSE_MARKERS = "because although while when if unless until since though whereas after before as once whether that which".split()


@query("shell_nouns", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL) SELECT CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHELL_NOUNS.items()) + " END AS class, w AS noun, count(*) AS n FROM w WHERE w IN (" + ", ".join(f"'{k}'" for k in SHELL_NOUNS) + ") GROUP BY ALL")
def shell_nouns(spark, d):
    w = t(spark, d, "documents").where("text IS NOT NULL").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("noun")).where(F.col("noun").isin(list(SHELL_NOUNS)))
    kinds = F.create_map(*[F.lit(x) for kv in SHELL_NOUNS.items() for x in kv])
    return w.groupBy(kinds[F.col("noun")].alias("class"), "noun").agg(F.count(F.lit(1)).alias("n"))


@query("clause_markers", "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL) SELECT w AS marker, count(*) AS n FROM w WHERE w IN (" + ", ".join(f"'{k}'" for k in CLAUSE_MARKERS) + ") GROUP BY w")
def clause_markers(spark, d):
    w = t(spark, d, "documents").where("text IS NOT NULL").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("marker")).where(F.col("marker").isin(CLAUSE_MARKERS))
    return w.groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@query("sentence_counts", "SELECT doc_id, len(regexp_extract_all(text, '[.!?]+[ \\n]')) AS n FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark, d):
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_count("text", F.lit(r"[.!?]+[ \n]")).cast("long").alias("n"))


@query("name_variants", f"SELECT lower(trim(entity_text)) AS name, count(*) AS n, count(DISTINCT entity_text) AS spellings FROM length_examples WHERE entity_text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity_text) > 1 OR count(*) > 2")
def name_variants(spark, d):
    return t(spark, d, "length_examples").where("entity_text IS NOT NULL").groupBy(F.lower(F.trim("entity_text")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_text").alias("spellings")).where("spellings > 1 OR n > 2")
