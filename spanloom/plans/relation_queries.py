"""Queries over relations between spans."""

from pyspark.sql import functions as F

from ..functions.text import canonical_label
from ..operators import evaluate as E
from ..operators import relations as R
from ..queries import query
from ..session import read_table as t
from .evaluation_queries import _M, _models
from .text_queries import LABEL

_LOC = f"(SELECT *, {LABEL} AS kind FROM predictions WHERE start_char IS NOT NULL AND end_char IS NOT NULL AND start_char < end_char AND label IS NOT NULL)"


def _pairs(loc: str, gap: int, key: str = "pred_id") -> str:
    return f"""(SELECT a.doc_id, a.{key} AS f, b.{key} AS s, a.kind AS ak, b.kind AS bk, a.confidence AS ac, b.confidence AS bc, (a.start_char + a.end_char) / 2.0::DOUBLE AS am, (b.start_char + b.end_char) / 2.0::DOUBLE AS bm, length(d.text) AS n,
        lower(substring(d.text, a.end_char + 1, b.start_char - a.end_char)) AS bt, a.start_char AS as_, a.end_char AS ae, b.start_char AS bs, b.end_char AS be FROM {loc} a JOIN {loc} b ON a.doc_id = b.doc_id AND (a.start_char < b.start_char OR (a.start_char = b.start_char AND a.{key} < b.{key}))
        AND b.start_char >= a.end_char AND b.start_char - a.end_char <= {gap} JOIN documents d ON d.doc_id = a.doc_id AND d.text IS NOT NULL)"""


def _both(pairs: str) -> str:
    return f"(SELECT doc_id, f AS head_id, s AS tail_id, ak AS hk, bk AS tk, ac AS hc, bc AS tc, am AS hm, bm AS tm, n, bt, as_ AS hs, ae AS he, bs AS ts, be AS te FROM {pairs} UNION ALL SELECT doc_id, s, f, bk, ak, bc, ac, bm, am, n, bt, bs, be, as_, ae FROM {pairs})"


_holds = lambda ws: "(" + " OR ".join(f"contains(bt, '{w}')" for w in ws) + ")"
_any = lambda c, ks: f"{c} IN ({', '.join(repr(k) for k in ks)})" if ks else "true"
_RULE = "CASE " + " ".join(f"WHEN {_any('hk', h)} AND {_any('tk', x)} AND {_holds(w)} THEN {{'relation': '{n}', 'confidence': {c}::DOUBLE}}" for n, c, h, x, w in R.RULES) + " END"


def _spans(spark, d):
    return t(spark, d, "predictions").where("label IS NOT NULL").withColumn("kind", canonical_label(F.col("label")))


@query("relations", f"WITH x AS (SELECT doc_id, head_id, tail_id, {_RULE} AS r FROM {_both(_pairs(_LOC, 50))}) SELECT doc_id, head_id, tail_id, r.relation AS relation, r.confidence AS confidence FROM x WHERE r IS NOT NULL")
def relations(spark, d):
    return R.relations(_spans(spark, d), t(spark, d, "documents"))


_FIRST = f"(SELECT * FROM {_LOC} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start_char, end_char, pred_id) <= 50)"
_WORDS = "CASE " + " ".join(f"WHEN {_holds(w)} THEN '{n}'" for n, w in R.PAIR_WORDS) + " ELSE 'RELATED' END"


@query("pair_relations", f"SELECT doc_id, f AS head_id, s AS tail_id, {_WORDS} AS relation FROM {_pairs(_FIRST, 200)}")
def pair_relations(spark, d):
    return R.pair_relations(_spans(spark, d), t(spark, d, "documents"))


_TOLD = "CASE " + " ".join(f"WHEN contains(bt, '{w}') THEN '{n}'" for w, n in R.TOLD) + " END"
_OF = [(f"hk = '{h}' AND tk = '{x}'" if h else f"tk = '{x}'", n, w) for h, x, n, w in R.LIKELY]
_LIKELY = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in _OF) + " END"
_WEIGHT = "CASE " + " ".join(f"WHEN {c} THEN {w}::DOUBLE" for c, _, w in _OF) + " END"


@query(
    "scored_relations",
    f"""WITH x AS (SELECT *, 1 - least(1.0, abs(hm - tm) / greatest(n, 1)) AS near, (coalesce(hc, 0) + coalesce(tc, 0)) / 2 AS mean, {_TOLD} AS told, {_LIKELY} AS likely, {_WEIGHT} AS weight FROM {_both(_pairs(_LOC, 300))}),
        y AS (SELECT *, told IS NOT NULL AND (near * 0.6::DOUBLE + 0.4::DOUBLE) * mean >= 0.3 AS w FROM x), z AS (SELECT doc_id, head_id, tail_id, CASE WHEN w THEN told WHEN near > 0.3 THEN likely END AS relation, CASE WHEN w THEN (near * 0.6::DOUBLE + 0.4::DOUBLE) * mean ELSE near * weight * mean END AS c FROM y)
        SELECT doc_id, head_id, tail_id, relation, round(c, 9) AS confidence FROM z WHERE relation IS NOT NULL AND c >= 0.3""",
)
def scored_relations(spark, d):
    return R.scored_relations(_spans(spark, d), t(spark, d, "documents")).withColumn("confidence", F.round("confidence", 9))


def _model_relations(model: str) -> str:
    loc = f"(SELECT *, label AS kind FROM {model} WHERE start_char < end_char)"
    return f"(SELECT doc_id, hs, he, ts, te, lower(r.relation) AS relation FROM (SELECT *, {_RULE} AS r FROM {_both(_pairs(loc, 50, 'id'))}) WHERE r IS NOT NULL)"


@query(
    "relation_prf",
    f"""WITH {_M}, x AS (SELECT *, count(*) AS n FROM {_model_relations('g')} GROUP BY ALL), y AS (SELECT *, count(*) AS m FROM {_model_relations('p')} GROUP BY ALL)
        SELECT sum(coalesce(n, 0))::BIGINT AS n_gold, sum(coalesce(m, 0))::BIGINT AS n_predicted, sum(least(coalesce(n, 0), coalesce(m, 0)))::BIGINT AS n_correct FROM x FULL JOIN y USING (doc_id, hs, he, ts, te, relation)""",
)
def relation_prf(spark, d):
    """Relations between the spans of two models, compared by their offsets."""
    docs = t(spark, d, "documents")

    def told(m):
        s = m.withColumnsRenamed({"id": "pred_id", "label": "kind"})
        of = lambda x: s.select(F.col("pred_id").alias(f"{x}_id"), F.col("start_char").alias(f"{x}_start"), F.col("end_char").alias(f"{x}_end"))
        return R.relations(s, docs).join(of("head"), "head_id").join(of("tail"), "tail_id")

    g, p = _models(spark, d)
    return E.relation_counts(told(g), told(p))
