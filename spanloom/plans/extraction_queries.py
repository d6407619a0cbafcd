"""Queries over extractors that read texts in order."""

from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..operators import events as V
from ..operators import extractors as X
from ..operators import heuristics as H
from ..operators import models as N
from ..operators import patterns as P
from ..queries import query
from ..session import read_table as t
from ..session import read_texts


def _heuristic_sql() -> str:
    """The same by windows over tokens: runs are the islands of tied tokens from the first that may begin one."""
    sp, mark = SPACE, r"[^\p{L}\p{N}]"
    low, tail = "lower(word)", lambda c: f"regexp_replace({c}, '{mark}+$', '')"
    names = lambda ws: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"
    bare = f"regexp_replace({tail(low)}, '^{mark}+', '')"
    rank = f"""least(CASE n WHEN 1 THEN 15 WHEN 2 THEN 11 ELSE 13 END, CASE WHEN n = 1 AND {tail('w1')} IN {names(H.PRONOUNS)} THEN 1 WHEN n = 1 AND {tail('w1')} IN {names(H.OFFICES)} THEN 2 ELSE 15 END,
        CASE WHEN n = 1 AND k = 1 THEN 14 ELSE 15 END, CASE WHEN {tail('wl')} IN {names(H.COMPANY_ENDINGS)} THEN 3 ELSE 15 END,
        CASE WHEN {tail('w1')} IN {names(H.COMPANIES)} OR joined IN {names(H.COMPANIES)} THEN 4 WHEN {tail('w1')} IN {names(H.PLACES)} OR joined IN {names(H.PLACES)} THEN 5 WHEN {tail('w1')} IN {names(H.GIVEN_NAMES)} OR joined IN {names(H.GIVEN_NAMES)} THEN 6 ELSE 15 END,
        CASE WHEN rtrim(before, '.') IN {names(H.TITLES)} THEN 7 ELSE 15 END, CASE WHEN before IN {names(H.PLACE_WORDS)} THEN 9 ELSE 15 END, CASE WHEN n >= 2 AND rtrim(w1, '.') IN {names(H.TITLES)} THEN 8 ELSE 15 END,
        CASE WHEN n = 2 AND w1 IN {names(H.PLACE_PREFIXES)} THEN 10 ELSE 15 END, CASE WHEN n >= 3 AND w2 = 'of' THEN 12 ELSE 15 END)"""
    cjk = "|".join(sorted(H.COMPANIES_CJK + H.PLACES_CJK, key=lambda w: (-len(w), w)))
    rows = " ".join(f"WHEN {r} THEN {{'rule': '{name}', 'label': '{label}', 'confidence': {sure}}}" for r, name, label, sure in H.EVIDENCE)
    return f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^{sp}]+') AS w, regexp_split_to_array(text, '[^{sp}]+') AS g FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(g[1:len(w)]) AS gap FROM d),
        s AS MATERIALIZED (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS pos, length(regexp_extract(word, '^{mark}*')) AS lead, regexp_matches(word, '^{mark}*\\p{{Lu}}') AS up, {low} AS low, {bare} AS bare FROM u),
        f AS (SELECT *, up AND bare NOT IN {names(H.SENTENCE_STARTERS)} AS begins, i > 1 AND (up OR (low IN ('of', 'the') AND coalesce(lead(up) OVER o, false))) AND (right(lag(word) OVER o, 1) NOT IN (')', ']', '}}', '.', '!', '?') OR low IN {names(H.COMPANY_ENDINGS)} OR bare IN {names(H.COMPANY_ENDINGS)}) AS tied FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        c AS (SELECT *, sum((NOT tied)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS chain FROM f),
        r AS (SELECT doc_id, min(i) FILTER (begins) AS k, max(i) AS last FROM c GROUP BY doc_id, chain HAVING count(*) FILTER (begins) > 0),
        x AS (SELECT r.doc_id, CASE WHEN rtrim(p.low, '.') IN {names(H.TITLES)} THEN r.k - 1 ELSE r.k END AS k, r.last FROM r LEFT JOIN s p ON p.doc_id = r.doc_id AND p.i = r.k - 1),
        y AS MATERIALIZED (SELECT x.doc_id, x.k, b.low AS before, (a.pos + a.lead)::BIGINT AS start_char, {tail('substring(d.text, (a.pos + a.lead + 1)::BIGINT, (z.pos + length(z.word) - a.pos - a.lead)::BIGINT)')} AS surface
            FROM x JOIN s a ON a.doc_id = x.doc_id AND a.i = x.k JOIN s z ON z.doc_id = x.doc_id AND z.i = x.last JOIN d ON d.doc_id = x.doc_id LEFT JOIN s b ON b.doc_id = x.doc_id AND b.i = x.k - 1),
        q AS (SELECT *, list_transform(regexp_extract_all(surface, '[^{sp}]+'), lambda v: lower(v)) AS ws FROM y WHERE surface <> ''),
        e AS MATERIALIZED (SELECT *, len(ws) AS n, ws[1] AS w1, ws[2] AS w2, ws[-1] AS wl, array_to_string(ws, ' ') AS joined FROM q), m AS MATERIALIZED (SELECT *, {rank} AS rank FROM e), v AS (SELECT *, CASE rank {rows} END AS z FROM m),
        h AS (SELECT doc_id, regexp_extract_all(text, '{cjk}') AS w, regexp_split_to_array(text, '{cjk}') AS g FROM documents WHERE text IS NOT NULL),
        j AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(g[1:len(w)]) AS gap FROM h),
        l AS (SELECT doc_id, word, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word))::BIGINT AS pos FROM j)
        SELECT doc_id, start_char, start_char + length(surface) AS end_char, surface, z.label AS label, z.rule AS rule, z.confidence::DOUBLE AS confidence FROM v WHERE z.label <> '' AND z.confidence >= {H.THRESHOLD}
        UNION ALL SELECT doc_id, pos, pos + length(word), word, CASE WHEN word IN {names(H.COMPANIES_CJK)} THEN 'ORG' ELSE 'LOC' END, 'listed', 0.9 FROM l"""


@query("heuristic_entities", _heuristic_sql())
def heuristic_entities(spark, d):
    return X.heuristic_entities(read_texts(spark, d))


@query("rule_entities")
def rule_entities(spark, d):
    return X.rule_entities(read_texts(spark, d))


@query("stacked_entities")
def stacked_entities(spark, d):
    return X.stacked_entities(read_texts(spark, d))


@query("stacked_entities_longest")
def stacked_entities_longest(spark, d):
    return X.stacked_entities(read_texts(spark, d), "longest")


@query("document_events")
def document_events(spark, d):
    return V.events(read_texts(spark, d))


@query("event_types")
def event_types(spark, d):
    return V.events(read_texts(spark, d)).groupBy("event_type", "polarity", "tense").agg(F.count(F.lit(1)).alias("n"))


_TRIGGERS = "('signed', 'sold', 'met', 'moved', 'left', 'joined')"
_EV = f"w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word, unnest(regexp_split_to_array(text, '[A-Za-z]+')[1:len(regexp_extract_all(text, '[A-Za-z]+'))]) AS gap, unnest(range(1, len(regexp_extract_all(text, '[A-Za-z]+')) + 1)) AS i FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, word, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word))::INT AS s FROM w), ev AS (SELECT doc_id, s, s + length(word) AS e, word FROM q WHERE word IN {_TRIGGERS}), sp AS (SELECT doc_id, pred_id, start_char, end_char FROM predictions WHERE text IS NOT NULL AND start_char IS NOT NULL AND end_char IS NOT NULL)"


@query("event_arguments", f"WITH {_EV} SELECT doc_id, s AS start_char, word AS trigger, (SELECT arg_max(pred_id, (end_char, pred_id)) FROM sp WHERE sp.doc_id = ev.doc_id AND end_char <= s AND s - end_char <= 50) AS agent_id, (SELECT arg_min(pred_id, (start_char, pred_id)) FROM sp WHERE sp.doc_id = ev.doc_id AND start_char >= e AND start_char - e <= 50) AS patient_id FROM ev")
def event_arguments(spark, d):
    """The spans before and behind some verbs."""
    w = P.pattern_spans(read_texts(spark, d), "(?<![A-Za-z])(?:signed|sold|met|moved|left|joined)(?![A-Za-z])", unicode=False)
    e = w.select("doc_id", "start_char", "end_char", F.col("surface").alias("trigger"), F.lit(None).cast("string").alias("agent"), F.lit(None).cast("string").alias("patient"))
    return V.event_arguments(e, t(spark, d, "predictions")).select("doc_id", "start_char", "trigger", "agent_id", "patient_id")


@query("stacked_entities_surest")
def stacked_entities_surest(spark, d):
    return N.extract(read_texts(spark, d), "default", "confidence")


@query("hybrid_entities")
def hybrid_entities(spark, d):
    """Heuristic names, and what patterns find beside them."""
    x = read_texts(spark, d)
    return N.hybrid(X.heuristic_entities(x), P.pattern_stack(x))


_SCORED = """c AS (SELECT doc_id, start_char AS s, end_char AS e, label AS l, confidence AS c, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS k FROM predictions WHERE start_char < end_char AND confidence >= 0.5 AND label IS NOT NULL),
    r AS (SELECT doc_id, 0::BIGINT AS k, NULL::INT AS s, NULL::INT AS e, NULL::VARCHAR AS l, NULL::DOUBLE AS c, false AS keep, []::STRUCT(s INT, e INT)[] AS taken FROM (SELECT DISTINCT doc_id FROM c)
    UNION ALL SELECT c.doc_id, c.k, c.s, c.e, c.l, c.c, len(list_filter(r.taken, lambda x: x.s < c.e AND c.s < x.e)) = 0, CASE WHEN len(list_filter(r.taken, lambda x: x.s < c.e AND c.s < x.e)) = 0 THEN list_append(r.taken, {{'s': c.s, 'e': c.e}}) ELSE r.taken END FROM r JOIN c ON c.doc_id = r.doc_id AND c.k = r.k + 1)
    SELECT doc_id, s AS start, e AS "end", l AS label, c AS score FROM r WHERE keep"""


def _decode_query(name: str, order: str, by: str) -> None:
    @query(name, "WITH RECURSIVE " + _SCORED.format(order=by))
    def run(spark, d):
        p = t(spark, d, "predictions").where("start_char < end_char AND confidence IS NOT NULL AND label IS NOT NULL")
        return X.greedy_decode(p.select("doc_id", F.col("start_char").alias("start"), F.col("end_char").alias("end"), "label", F.col("confidence").alias("score")), 0.5, order)


for _name, _order, _by in (
    ("non_overlapping_spans", "score", "confidence DESC, start_char, end_char, label"), ("non_overlapping_first", "position", "start_char, end_char, confidence DESC, label"), ("non_overlapping_short", "short", "end_char - start_char, confidence DESC, start_char, label"),
):
    _decode_query(_name, _order, _by)


@query("span_candidates", "WITH n AS (SELECT example_id AS seq, len(string_split(entity_text, ' ')) AS n FROM length_examples WHERE entity_text IS NOT NULL), f AS (SELECT seq, n, unnest(range(n)) AS first FROM n) SELECT seq, first, unnest(range(first, least(first + 3, n))) AS last FROM f")
def span_candidates(spark, d):
    n = t(spark, d, "length_examples").where("entity_text IS NOT NULL").select(F.col("example_id").alias("seq"), F.size(F.split("entity_text", " ")).alias("n"))
    return X.span_candidates(n, 3)


@query("entity_prompts", "SELECT doc_id, 'Find every entity of these types: PER, ORG.' || chr(10) || 'Answer with a JSON array of objects with text, type, start and end.' || chr(10) || 'Text:' || chr(10) || text AS prompt FROM documents WHERE text IS NOT NULL")
def entity_prompts(spark, d):
    return X.prompts(read_texts(spark, d), ["PER", "ORG"])


@query("parsed_responses", "SELECT doc_id, text, label AS type, start_char AS start, end_char AS end_ FROM predictions WHERE start_char IS NOT NULL AND end_char IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL")
def parsed_responses(spark, d):
    p = t(spark, d, "predictions").where("start_char IS NOT NULL AND end_char IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL")
    r = p.select("doc_id", F.concat(F.lit("Sure: ["), F.to_json(F.struct("text", F.col("label").alias("type"), F.col("start_char").alias("start"), F.col("end_char").alias("end"))), F.lit("] done")).alias("response"))
    return X.parse_responses(r).withColumnRenamed("end", "end_")
