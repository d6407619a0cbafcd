"""Queries over coreference inside documents, sentences and clauses."""

from pyspark.sql import functions as F

from ..functions.text import SPACE, canonical_label
from ..operators import coreference as C
from ..queries import query
from ..session import read_table as t
from ..session import read_texts
from .text_queries import LABEL

_MENTIONS = "m AS (SELECT doc_id, pred_id AS id, lower(trim(text, ' ')) AS n, label AS l, row_number() OVER (PARTITION BY doc_id ORDER BY start_char, end_char NULLS FIRST, pred_id) AS k FROM predictions WHERE text IS NOT NULL AND label IS NOT NULL AND start_char IS NOT NULL)"
_SAME = "list_filter(r.seen, lambda x: x.l = m.l AND x.n = m.n)[1].c"
_LIKE = "list_min(list_transform(list_filter(r.seen, lambda x: x.l = m.l AND x.n <> '' AND m.n <> '' AND (contains(x.n, m.n) OR contains(m.n, x.n))), lambda x: x.c))"


@query(
    "coreference_clusters",
    f"""WITH RECURSIVE {_MENTIONS}, r AS (SELECT doc_id, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS c, []::STRUCT(n VARCHAR, l VARCHAR, c BIGINT)[] AS seen FROM (SELECT DISTINCT doc_id FROM m)
        UNION ALL SELECT m.doc_id, m.k, m.id, coalesce({_SAME}, {_LIKE}, m.k), CASE WHEN {_SAME} IS NULL THEN list_append(r.seen, {{'n': m.n, 'l': m.l, 'c': coalesce({_LIKE}, m.k)}}) ELSE r.seen END FROM r JOIN m ON m.doc_id = r.doc_id AND m.k = r.k + 1)
        SELECT r.doc_id, r.id AS pred_id, f.id AS cluster FROM r JOIN m f ON f.doc_id = r.doc_id AND f.k = r.c WHERE r.k > 0""",
)
def coreference_clusters(spark, d):
    """No text of predictions is a pronoun, so the SQL has no step for them."""
    return C.resolve(t(spark, d, "predictions"))


@query("equal_name_clusters", f"WITH {_MENTIONS} SELECT doc_id, id AS pred_id, first_value(id) OVER (PARTITION BY doc_id, l, n ORDER BY k) AS cluster FROM m")
def equal_name_clusters(spark, d):
    return C.resolve(t(spark, d, "predictions"), fuzzy=False)


_IN = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_WORD = r"[\p{L}\p{N}_]+"
_NAME = f"regexp_split_to_array(trim(lower(text), ' '), '[ \\t\\n\\x0B\\f\\r]+')[1]"


@query(
    "pronoun_links",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD}')) AS word, unnest(regexp_split_to_array(text, '{_WORD}')[1:len(regexp_extract_all(text, '{_WORD}'))]) AS gap, unnest(range(1, len(regexp_extract_all(text, '{_WORD}')) + 1)) AS i FROM documents WHERE text IS NOT NULL),
        q AS (SELECT doc_id, word, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word))::INT AS pos FROM w), p AS (SELECT doc_id, pos AS start_char, word AS text FROM q WHERE lower(word) IN {_IN(C.SOUGHT)}),
        s AS (SELECT doc_id, end_char, pred_id, {LABEL} AS kind, {_NAME} AS f FROM predictions WHERE start_char IS NOT NULL AND end_char IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL),
        j AS (SELECT p.doc_id, p.start_char, p.text, s.pred_id AS antecedent, row_number() OVER (PARTITION BY p.doc_id, p.start_char ORDER BY s.end_char DESC, s.pred_id DESC) AS r FROM p JOIN s ON s.doc_id = p.doc_id AND s.end_char < p.start_char AND CASE WHEN lower(p.text) IN ('he', 'him', 'his') THEN kind = 'PER' AND f IN {_IN(C.MALE_NAMES)}
            WHEN lower(p.text) IN ('she', 'her', 'hers') THEN kind = 'PER' AND f IN {_IN(C.FEMALE_NAMES)} WHEN lower(p.text) IN ('it', 'its') THEN kind = 'ORG' ELSE kind IN ('PER', 'ORG') END)
        SELECT doc_id, start_char, text, antecedent FROM j WHERE r = 1""",
)
def pronoun_links(spark, d):
    p = t(spark, d, "predictions").where("label IS NOT NULL").withColumn("kind", canonical_label(F.col("label")))
    return C.pronoun_links(p, read_texts(spark, d))


def _cut(pattern: str, keep: str, lead: str) -> str:
    """Pieces between the matches of a pattern that RE2 can say, of which those count that `keep` (over m, the match, and z, what
    follows) lets pass; `lead` is how much of the match belongs to the piece before it."""
    return f"""d AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, text, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM d), e AS (SELECT doc_id, text, m, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS fin FROM u),
        f AS (SELECT doc_id, fin, fin - length(m) + {lead} AS stop FROM (SELECT *, substring(text, fin + 1, 40) AS z FROM e) WHERE {keep}),
        b AS (SELECT doc_id, fin AS start_char, NULL AS stop, 1 AS o FROM f UNION ALL SELECT doc_id, 0, NULL, 1 FROM d), s AS (SELECT doc_id, start_char, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS n FROM b),
        c AS (SELECT doc_id, stop AS end_char, row_number() OVER (PARTITION BY doc_id ORDER BY stop, o) - 1 AS n FROM (SELECT doc_id, stop, 0 AS o FROM f UNION ALL SELECT doc_id, length(text), 1 FROM d))"""


@query("sentence_spans", "WITH " + _cut(f"[.!?]+[\"''”’»]?[{SPACE}]+", "regexp_matches(z, '^[\"''“‘«]?\\p{Lu}')", f"length(regexp_extract(m, '^[^{SPACE}]+'))") + " SELECT doc_id, n AS sentence, start_char, end_char FROM s JOIN c USING (doc_id, n) WHERE start_char < end_char")
def sentence_spans(spark, d):
    return C.sentences(read_texts(spark, d))


_MARKS = "|".join(C.CLAUSE_MARKS)


@query(
    "clause_counts",
    f"""WITH x AS (SELECT doc_id, regexp_replace(text, '[,;.!?][{SPACE}]+', chr(1), 'g') AS t FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, list_filter(string_split(t, chr(1)), lambda p: p <> '') AS ps FROM x)
        SELECT doc_id, len(ps) AS n FROM y WHERE len(ps) > 0""",
)
def clause_counts(spark, d):
    """Clauses of every text, without the cuts before words that open one (a look-ahead that the SQL cannot say)."""
    return C.clauses(read_texts(spark, d), marks=[]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
