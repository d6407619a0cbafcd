"""Queries over text functions."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..queries import query
from ..session import read_table as t
from ..session import read_texts

_S, _B = X.SPACE, X.BLANK


def _chr(p: str) -> str:
    return p.replace("'", "''")


def _clean(c: str) -> str:
    c = f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')"
    c = f"regexp_replace({c}, '\\n[{_S}]*', chr(10), 'g')"
    c = f"regexp_replace({c}, '[{_B}]+', ' ', 'g')"
    return f"regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g')"


@query("clean_text", f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents WHERE text IS NOT NULL")
def clean_text(spark, d):
    return read_texts(spark, d).where("text IS NOT NULL").select("doc_id", X.clean_whitespace(F.col("text")).alias("cleaned"))


@query("strip_zero_width", "SELECT doc_id, regexp_replace(text, '[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]', '', 'g') AS stripped FROM documents WHERE text IS NOT NULL")
def strip_zero_width(spark, d):
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.strip_zero_width(F.col("text")).alias("stripped"))


_COUNTS = ", ".join(f"{w} * (length(text) - length(regexp_replace(text, '{p}', '', 'g'))) AS n_{c}" for c, p, w in X.LANGUAGE_CLASSES)
_TOP = "greatest(" + ", ".join(f"n_{c}" for c, _, _ in X.LANGUAGE_CLASSES) + ")"
_CASE = "CASE WHEN " + _TOP + " = 0 THEN 'en' " + " ".join(f"WHEN n_{c} = {_TOP} THEN " + ("CASE WHEN n_ja > 0 THEN 'ja' ELSE 'zh' END" if c == "zh" else f"'{c}'") for c, _, _ in X.LANGUAGE_CLASSES) + " END"


@query("detect_language", f"WITH n AS (SELECT doc_id, {_COUNTS} FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_CASE} AS code FROM n")
def detect_language(spark, d):
    return read_texts(spark, d).where("text IS NOT NULL").select("doc_id", X.language_by_script(F.col("text")).alias("code"))


@query("prepare_metadata", f"SELECT doc_id, octet_length(encode(text)) AS original_length, octet_length(encode({_clean('text')})) AS processed_length FROM documents WHERE text IS NOT NULL")
def prepare_metadata(spark, d):
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.octet_length("text").cast("long").alias("original_length"), F.octet_length(X.clean_whitespace(F.col("text"))).cast("long").alias("processed_length"))


def _list(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({c}, '[{_S}]+'), lambda w: w <> ''))"


def _jaccard(a: str, b: str) -> str:
    x, y = _list(a), _list(b)
    return f"CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::DOUBLE END"


@query(
    "string_similarity",
    f"""SELECT example_id, round(CASE WHEN entity_text = '' AND sentence = '' THEN 1.0 WHEN entity_text = '' OR sentence = '' THEN 0.0 WHEN lower(entity_text) = lower(sentence) THEN 1.0
        WHEN contains(lower(entity_text), lower(sentence)) OR contains(lower(sentence), lower(entity_text)) THEN 0.8 ELSE {_jaccard('lower(entity_text)', 'lower(sentence)')} END, 6) AS main,
        round({_jaccard('entity_text', 'sentence')}, 6) AS by_case FROM length_examples WHERE entity_text IS NOT NULL AND sentence IS NOT NULL""",
)
def string_similarity(spark, d):
    a, b = F.col("entity_text"), F.col("sentence")
    e = t(spark, d, "length_examples").where(a.isNotNull() & b.isNotNull())
    return e.select("example_id", F.round(X.string_similarity(a, b), 6).alias("main"), F.round(X.word_jaccard(a, b), 6).alias("by_case"))


def _sql_map(c: str, m: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + f" ELSE {c} END"


BARE = "upper(regexp_replace(label, '^[BIESbies]-', ''))"
LABEL = _sql_map(BARE, X.LABEL_ALIASES)
_CAT = f"CASE WHEN label IS NULL THEN NULL ELSE coalesce(CASE {LABEL} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.CATEGORIES.items()) + " END, 'Misc') END"


@query("label_normalised", f"SELECT {LABEL} AS label, {_CAT} AS category, count(*) AS n FROM predictions GROUP BY ALL")
def label_normalised(spark, d):
    c = X.canonical_label(F.col("label"))
    return t(spark, d, "predictions").select(c.alias("label"), X.label_category(c).alias("category")).groupBy("label", "category").agg(F.count(F.lit(1)).alias("n"))


_WC = f"len(list_filter(regexp_split_to_array(entity_text, '[{_S}]+'), lambda w: w <> ''))"


@query(
    "length_buckets",
    f"""WITH x AS (SELECT example_id, length(entity_text) AS n, {_WC} AS w FROM length_examples WHERE entity_text IS NOT NULL)
        SELECT example_id, n AS chars, w AS words, CASE WHEN n <= 5 THEN 'VeryShort' WHEN n <= 15 THEN 'Short' WHEN n <= 30 THEN 'Medium' WHEN n <= 50 THEN 'Long' ELSE 'VeryLong' END AS char_bucket,
        CASE WHEN w <= 1 THEN 'SingleWord' WHEN w = 2 THEN 'TwoWords' WHEN w = 3 THEN 'ThreeWords' ELSE 'FourPlusWords' END AS word_bucket FROM x""",
)
def length_buckets(spark, d):
    e = t(spark, d, "length_examples").where("entity_text IS NOT NULL").select("example_id", F.length("entity_text").cast("long").alias("chars"), X.word_count(F.col("entity_text")).cast("long").alias("words"))
    return e.withColumns({"char_bucket": X.char_bucket(F.col("chars")), "word_bucket": X.word_bucket(F.col("words"))})


@query("char_trigrams", "WITH x AS (SELECT unnest(CASE WHEN length(kb_name) < 3 THEN [kb_name] ELSE list_transform(range(1, length(kb_name) - 1), lambda i: substring(kb_name, i, 3)) END) AS gram FROM kb_entities) SELECT gram, count(*) AS n FROM x GROUP BY gram")
def char_trigrams(spark, d):
    return t(spark, d, "kb_entities").select(F.explode(X.char_ngrams(F.col("kb_name"), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


_BEFORE = f"list_filter(regexp_split_to_array(lower(substring(d.text, 1, p.start_char)), '[{_S}]+'), lambda w: w <> '')"
_LIST = lambda ws: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


@query(
    "negation_and_quantifier",
    f"""WITH x AS (SELECT p.pred_id, {_BEFORE} AS w FROM predictions p JOIN documents d ON p.doc_id = d.doc_id WHERE p.start_char > 0 AND d.text IS NOT NULL),
        y AS (SELECT pred_id, len(list_intersect(w[-3:], {_LIST(X.NEGATIONS)})) > 0 AS negated, w[-1] AS l FROM x)
        SELECT negated, CASE WHEN l IN {tuple(X.UNIVERSAL)} THEN 'Universal' WHEN l IN {tuple(X.EXISTENTIAL)} THEN 'Existential' WHEN l IN {tuple(X.NONE)} THEN 'None' WHEN l IN {tuple(X.DEFINITE)} THEN 'Definite' END AS quantifier, count(*) AS n FROM y GROUP BY ALL""",
)
def negation_and_quantifier(spark, d):
    docs = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("doc"))
    p = t(spark, d, "predictions").where("start_char > 0").select("pred_id", "doc_id", "start_char").join(docs, "doc_id")
    p = p.select(X.is_negated(F.col("doc"), F.col("start_char")).alias("negated"), X.quantifier(F.col("doc"), F.col("start_char")).alias("quantifier"))
    return p.groupBy("negated", "quantifier").agg(F.count(F.lit(1)).alias("n"))


@query("byte_offsets", "SELECT p.pred_id, octet_length(encode(substring(d.text, 1, p.start_char))) AS start_byte, octet_length(encode(substring(d.text, 1, p.end_char))) AS end_byte FROM predictions p JOIN documents d ON p.doc_id = d.doc_id WHERE p.start_char IS NOT NULL AND p.end_char IS NOT NULL AND d.text IS NOT NULL")
def byte_offsets(spark, d):
    docs = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("doc"))
    p = t(spark, d, "predictions").where("start_char IS NOT NULL AND end_char IS NOT NULL").select("pred_id", "doc_id", "start_char", "end_char").join(docs, "doc_id")
    return p.select("pred_id", F.expr("CAST(octet_length(substring(doc, 1, start_char)) AS BIGINT)").alias("start_byte"), F.expr("CAST(octet_length(substring(doc, 1, end_char)) AS BIGINT)").alias("end_byte"))


@query(
    "word_stems",
    """WITH w AS (SELECT DISTINCT unnest(string_split(lower(sentence), ' ')) AS w FROM length_examples WHERE sentence IS NOT NULL), a AS (SELECT w FROM w WHERE regexp_full_match(w, '[a-z]+')),
       s AS (SELECT w, CASE WHEN w LIKE '%ation' AND length(w) > 7 THEN substring(w, 1, length(w) - 5) WHEN (w LIKE '%tion' OR w LIKE '%sion') AND length(w) > 6 THEN substring(w, 1, length(w) - 3)
       WHEN w LIKE '%ing' AND length(w) > 5 THEN substring(w, 1, length(w) - 3) WHEN w LIKE '%ed' AND length(w) > 4 THEN substring(w, 1, length(w) - 2)
       WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN substring(w, 1, length(w) - 1) ELSE w END AS s FROM a)
       SELECT w AS word, CASE WHEN length(s) > 2 AND s[-1] = s[-2] THEN substring(s, 1, length(s) - 1) ELSE s END AS stem FROM s""",
)
def word_stems(spark, d):
    w = t(spark, d, "length_examples").where("sentence IS NOT NULL").select(F.explode(F.split(F.lower("sentence"), " ")).alias("word")).distinct()
    return w.where(F.col("word").rlike("^[a-z]+$")).select("word", X.simple_stem(F.col("word")).alias("stem"))


@query("html_to_text", "WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\r?\\n'), lambda l: trim(l, ' ')), lambda l: l <> '') AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(l, chr(10)) AS plain FROM x")
def html_to_text(spark, d):
    """Every text, made a page, comes back with its white space tidied."""
    body = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(a), F.lit(b))
    page = F.concat(F.lit("<html><head><style>p {color: red}</style></head><body><!-- x --><script>if (1) {}</script><p class='a'>"), body, F.lit("</p></body></html>"))
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.html_to_text(page).alias("plain"))
