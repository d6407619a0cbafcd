"""Queries over one-to-one matching. Gold and predicted are the first and the last model by name that read a document."""

from pyspark.sql import functions as F

from ..operators import matching as M
from ..queries import query
from .evaluation_queries import _M, _models, _round


def greedy(items: str) -> str:
    """SQL of a claim in order: item k of a document takes the first of its candidates (a list of numbers, best first) that no
    item before it has. `items` gives (doc, k, id, cands), k from 1 without gaps."""
    return f"""items AS MATERIALIZED ({items}), claims AS (SELECT doc, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS hit, []::BIGINT[] AS used FROM (SELECT DISTINCT doc FROM items)
        UNION ALL SELECT i.doc, i.k, i.id, list_filter(i.cands, lambda c: NOT list_contains(s.used, c))[1], CASE WHEN len(list_filter(i.cands, lambda c: NOT list_contains(s.used, c))) > 0 THEN list_append(s.used, list_filter(i.cands, lambda c: NOT list_contains(s.used, c))[1]) ELSE s.used END
        FROM claims s JOIN items i ON i.doc = s.doc AND i.k = s.k + 1), claimed AS (SELECT doc, id, hit FROM claims WHERE k > 0)"""


_RANK = "CASE WHEN a.start_char = b.start_char AND a.end_char = b.end_char THEN CASE WHEN a.label = b.label THEN 4 ELSE 3 END WHEN a.start_char < b.end_char AND b.start_char < a.end_char THEN CASE WHEN a.label = b.label THEN 2 ELSE 1 END ELSE 0 END"
_OK = "start_char <= end_char"
_ORDERED = f"gs AS (SELECT * FROM g WHERE {_OK}), ps AS (SELECT * FROM p WHERE {_OK})"


def _claim(side: str, other: str, rank: str) -> str:
    """Items of one side in reading order, with the other side's candidates of a positive rank, the best and first first."""
    return greedy(f"""SELECT a.doc_id AS doc, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.start_char, a.end_char, a.id) AS k, a.id, coalesce(c.cands, []::BIGINT[]) AS cands FROM {side} a LEFT JOIN
        (SELECT a.id, list(b.id ORDER BY {rank} DESC, b.start_char, b.end_char, b.id) AS cands FROM {side} a JOIN {other} b ON a.doc_id = b.doc_id AND {rank} > 0 GROUP BY a.id) c ON c.id = a.id""")


_NER = f"""WITH RECURSIVE {_M}, {_ORDERED}, {_claim('gs', 'ps', _RANK)},
    x AS (SELECT a.doc_id, CASE {_RANK} WHEN 4 THEN 'exact' WHEN 3 THEN 'exact_other_type' WHEN 2 THEN 'partial' WHEN 1 THEN 'partial_other_type' END AS kind, a.id AS gold_id, b.id AS pred_id, a.label AS gold_label, b.label AS pred_label FROM claimed c JOIN gs a ON a.id = c.id JOIN ps b ON b.id = c.hit
    UNION ALL SELECT a.doc_id, 'missed', a.id, NULL, a.label, NULL FROM gs a WHERE a.id NOT IN (SELECT id FROM claimed WHERE hit IS NOT NULL) UNION ALL SELECT b.doc_id, 'spurious', NULL, b.id, NULL, b.label FROM ps b WHERE b.id NOT IN (SELECT hit FROM claimed WHERE hit IS NOT NULL))"""


@query("ner_matches", f"{_NER} SELECT doc_id, kind, gold_id, pred_id FROM x")
def ner_matches(spark, d):
    return M.evaluate_ner(*_models(spark, d)).select("doc_id", "kind", "gold_id", "pred_id")


_N = {k: f"count(*) FILTER (kind = '{k}')" for k in ("exact", "exact_other_type", "partial", "partial_other_type", "missed", "spurious")}
_MODES = [
    ("strict", _N["exact"], f"{_N['exact_other_type']} + {_N['partial']} + {_N['partial_other_type']}", "0"),
    ("exact", f"{_N['exact']} + {_N['exact_other_type']}", f"{_N['partial']} + {_N['partial_other_type']}", "0"),
    ("partial", f"{_N['exact']} + {_N['exact_other_type']}", "0", f"{_N['partial']} + {_N['partial_other_type']}"),
    ("type", f"{_N['exact']} + {_N['partial']}", f"{_N['exact_other_type']} + {_N['partial_other_type']}", "0"),
]
_MUC = " UNION ALL ".join(f"SELECT '{m}' AS mode, ({c})::BIGINT AS correct, ({i})::BIGINT AS incorrect, ({p})::BIGINT AS partial, {_N['missed']} AS missed, {_N['spurious']} AS spurious FROM x" for m, c, i, p in _MODES)


@query("muc_style_counts", f"{_NER}, n AS ({_MUC}), s AS (SELECT *, coalesce((correct + partial / 2) / nullif(correct + incorrect + partial + spurious, 0), 0) AS p, coalesce((correct + partial / 2) / nullif(correct + incorrect + partial + missed, 0), 0) AS r FROM n) SELECT mode, correct, incorrect, partial, missed, spurious, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM s")
def muc_style_counts(spark, d):
    return _round(M.muc_modes(M.evaluate_ner(*_models(spark, d))), "precision", "recall", "f1")


@query("ner_type_counts", f"{_NER} SELECT coalesce(gold_label, pred_label) AS label, {_N['exact']} AS correct, count(*) FILTER (kind IN ('exact_other_type', 'partial', 'partial_other_type')) AS incorrect, {_N['missed']} AS missed, {_N['spurious']} AS spurious FROM x GROUP BY 1")
def ner_type_counts(spark, d):
    return M.type_counts(M.evaluate_ner(*_models(spark, d)))


# Comparison in two passes: equal spans by rank among equals, then the first overlap among those that are left.
_COMPARE = f"""WITH RECURSIVE {_M}, {_ORDERED}, gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start_char, end_char ORDER BY id) AS n FROM gs), pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start_char, end_char ORDER BY id) AS n FROM ps),
    eq AS (SELECT a.doc_id, a.id AS gold_id, b.id AS pred_id, a.label AS gl, b.label AS pl FROM gr a JOIN pr b USING (doc_id, start_char, end_char, n)), go AS (SELECT * FROM gs WHERE id NOT IN (SELECT gold_id FROM eq)), po AS (SELECT * FROM ps WHERE id NOT IN (SELECT pred_id FROM eq)),
    {_claim('po', 'go', 'CASE WHEN a.start_char < b.end_char AND b.start_char < a.end_char THEN 1 ELSE 0 END')}, ov AS (SELECT a.doc_id, b.id AS gold_id, a.id AS pred_id, b.label AS gl, a.label AS pl FROM claimed c JOIN po a ON a.id = c.id JOIN go b ON b.id = c.hit),
    x AS (SELECT doc_id, CASE WHEN gl = pl THEN 'correct' ELSE 'type_mismatch' END AS kind, gold_id, pred_id FROM eq UNION ALL SELECT doc_id, CASE WHEN gl = pl THEN 'boundary' ELSE 'boundary_and_type' END, gold_id, pred_id FROM ov
    UNION ALL SELECT doc_id, 'missed', id, NULL FROM go WHERE id NOT IN (SELECT gold_id FROM ov) UNION ALL SELECT doc_id, 'spurious', NULL, id FROM po WHERE id NOT IN (SELECT pred_id FROM ov))"""


@query("span_comparison", f"{_COMPARE} SELECT doc_id, kind, gold_id, pred_id FROM x")
def span_comparison(spark, d):
    return M.compare(*_models(spark, d)).select("doc_id", "kind", "gold_id", "pred_id")


@query("error_analysis", f"{_COMPARE} SELECT kind, count(*) AS n FROM x GROUP BY kind")
def error_analysis(spark, d):
    return M.compare(*_models(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_IOU = "(CASE WHEN greatest(a.end_char - a.start_char, b.end_char - b.start_char) = 0 THEN (a.start_char = b.start_char)::INT::DOUBLE ELSE greatest(0, least(a.end_char, b.end_char) - greatest(a.start_char, b.start_char)) / ((a.end_char - a.start_char) + (b.end_char - b.start_char) - greatest(0, least(a.end_char, b.end_char) - greatest(a.start_char, b.start_char)))::DOUBLE END)"
_FITS = {
    "strict": "a.start_char = b.start_char AND a.end_char = b.end_char AND a.label = b.label",
    "exact": "a.start_char = b.start_char AND a.end_char = b.end_char",
    "partial": "a.start_char < b.end_char AND b.start_char < a.end_char AND a.label = b.label",
    "type": f"a.start_char < b.end_char AND b.start_char < a.end_char AND a.label = b.label AND {_IOU} >= 0.8",
}


def _hits(rank: str) -> str:
    return f"WITH RECURSIVE {_M}, {_ORDERED}, {_claim('ps', 'gs', rank)}, n AS (SELECT count(hit) AS n_hit, (SELECT count(*) FROM gs) - count(hit) AS n_missed, count(*) - count(hit) AS n_spurious FROM claimed)"


_HIT_PRF = "n_hit, n_missed, n_spurious, round(n_hit / (n_hit + n_spurious), 9) AS precision, round(n_hit / (n_hit + n_missed), 9) AS recall, round(2 * n_hit / (2 * n_hit + n_spurious + n_missed), 9) AS f1 FROM n"


def _mode_query(name: str, mode: str, least: float) -> None:
    @query(name, f"{_hits(f'CASE WHEN {_FITS[mode]} THEN 1 ELSE 0 END')} SELECT {_HIT_PRF}")
    def run(spark, d):
        return _round(M.hit_scores(M.matched_in_mode(*_models(spark, d), mode, least)), "precision", "recall", "f1")


for _name, _mode, _least in (("eval_mode_strict", "strict", 0.0), ("eval_mode_exact", "exact", 0.0), ("eval_mode_partial", "partial", 0.0), ("eval_mode_overlap", "type", 0.8)):
    _mode_query(_name, _mode, _least)


@query("partial_match_scores", f"{_hits(f'CASE WHEN a.label = b.label AND {_IOU} >= 0.5 THEN round({_IOU}, 12) ELSE 0 END')} SELECT {_HIT_PRF}")
def partial_match_scores(spark, d):
    return _round(M.hit_scores(M.partial_matches(*_models(spark, d), 0.5)), "precision", "recall", "f1")


_GOALS = {"overall": {"precision": 0.5, "f1": 0.95}, "PER": {"recall": 0.6}, "ORG": {"f1": 0.4}, "NONE": {"recall": 0.1}}
_BY_LABEL = f"{_hits('CASE WHEN ' + _FITS['strict'] + ' THEN 1 ELSE 0 END')}, l AS (SELECT label, sum(h)::BIGINT AS h, sum(m)::BIGINT AS m, sum(s)::BIGINT AS s FROM (SELECT b.label, 1 AS h, 0 AS m, 0 AS s FROM claimed c JOIN gs b ON b.id = c.hit UNION ALL SELECT label, 0, 1, 0 FROM gs WHERE id NOT IN (SELECT hit FROM claimed WHERE hit IS NOT NULL) UNION ALL SELECT a.label, 0, 0, 1 FROM claimed c JOIN ps a ON a.id = c.id WHERE c.hit IS NULL) GROUP BY label)"
_SCOPES = "v AS (SELECT 'overall' AS scope, n_hit AS h, n_missed AS m, n_spurious AS s FROM n UNION ALL SELECT label, h, m, s FROM l), w AS (SELECT scope, coalesce(h / nullif(h + s, 0), 0) AS precision, coalesce(h / nullif(h + m, 0), 0) AS recall, coalesce(2 * h / nullif(2 * h + s + m, 0), 0) AS f1 FROM v)"
_WANTED = ", ".join(f"('{s}', '{m}', {v}::DOUBLE)" for s, ms in _GOALS.items() for m, v in ms.items())


@query("goal_checks", f"{_BY_LABEL}, {_SCOPES} SELECT t.scope, t.metric, round(coalesce(CASE t.metric WHEN 'precision' THEN w.precision WHEN 'recall' THEN w.recall ELSE w.f1 END, 0), 9) AS value, t.goal, coalesce(CASE t.metric WHEN 'precision' THEN w.precision WHEN 'recall' THEN w.recall ELSE w.f1 END, 0) >= t.goal AS met FROM (VALUES {_WANTED}) t(scope, metric, goal) LEFT JOIN w ON w.scope = t.scope")
def goal_checks(spark, d):
    m = M.matched_in_mode(*_models(spark, d), "strict")
    return _round(M.goals_met(M.hit_scores(m, ["label"]), M.hit_scores(m), _GOALS), "value")
