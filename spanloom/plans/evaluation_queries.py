"""Queries over evaluation. Gold and predicted are two models that read the same document: the first and the last by name."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import canonical_label
from ..operators import evaluate as E
from ..queries import query
from ..session import read_table as t
from .text_queries import LABEL


def _models(spark, d):
    w = Window.partitionBy("doc_id")
    p = t(spark, d, "predictions").where("start_char IS NOT NULL AND end_char IS NOT NULL AND label IS NOT NULL")
    p = p.select("doc_id", F.col("pred_id").alias("id"), "model_name", "start_char", "end_char", "confidence", "text", canonical_label(F.col("label")).alias("label"))
    p = p.withColumns({"first": F.min("model_name").over(w), "last": F.max("model_name").over(w)}).where("first <> last")
    return p.where("model_name = first").drop("first", "last"), p.where("model_name = last").drop("first", "last")


_M = f"""m AS (SELECT doc_id, pred_id AS id, model_name, start_char, end_char, confidence, text, {LABEL} AS label, min(model_name) OVER (PARTITION BY doc_id) AS f, max(model_name) OVER (PARTITION BY doc_id) AS l
    FROM predictions WHERE start_char IS NOT NULL AND end_char IS NOT NULL AND label IS NOT NULL), g AS (SELECT * FROM m WHERE f <> l AND model_name = f), p AS (SELECT * FROM m WHERE f <> l AND model_name = l)"""
_EXACT = """gc AS (SELECT doc_id, start_char, end_char, label, count(*) AS n FROM g GROUP BY ALL), pc AS (SELECT doc_id, start_char, end_char, label, count(*) AS n FROM p GROUP BY ALL),
    j AS (SELECT coalesce(gc.label, pc.label) AS label, coalesce(gc.n, 0) AS a, coalesce(pc.n, 0) AS b FROM gc FULL JOIN pc USING (doc_id, start_char, end_char, label))"""
_PRF = "round(coalesce(c / nullif(b, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(c / nullif(a, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2 * (c / nullif(b, 0)::DOUBLE) * (c / nullif(a, 0)::DOUBLE) / nullif(c / nullif(b, 0)::DOUBLE + c / nullif(a, 0)::DOUBLE, 0), 0), 9) AS f1"
_KEYS = ["doc_id", "start_char", "end_char", "label"]


def _round(df, *cols, n=9):
    return df.withColumns({c: F.round(F.col(c), n) for c in cols})


@query("ner_prf_by_label", f"WITH {_M}, {_EXACT}, s AS (SELECT label, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(least(a, b))::BIGINT AS c FROM j GROUP BY label) SELECT label, a AS n_gold, b AS n_predicted, c AS n_correct, {_PRF} FROM s")
def ner_prf_by_label(spark, d):
    return _round(E.precision_recall(E.exact_counts(*_models(spark, d), _KEYS, ["label"])), "precision", "recall", "f1")


@query("ner_prf_micro", f"WITH {_M}, {_EXACT}, s AS (SELECT sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(least(a, b))::BIGINT AS c FROM j) SELECT a AS n_gold, b AS n_predicted, c AS n_correct, {_PRF} FROM s")
def ner_prf_micro(spark, d):
    return _round(E.precision_recall(E.exact_counts(*_models(spark, d), _KEYS, [])), "precision", "recall", "f1")


@query("ner_prf_macro", f"WITH {_M}, {_EXACT}, s AS (SELECT label, sum(a) AS a, sum(b) AS b, sum(least(a, b)) AS c FROM j GROUP BY label), x AS (SELECT {_PRF} FROM s) SELECT round(avg(precision), 7) AS precision, round(avg(recall), 7) AS recall, round(avg(f1), 7) AS f1 FROM x")
def ner_prf_macro(spark, d):
    x = _round(E.precision_recall(E.exact_counts(*_models(spark, d), _KEYS, ["label"])), "precision", "recall", "f1")
    return x.agg(*[F.round(F.avg(c), 7).alias(c) for c in ("precision", "recall", "f1")])


@query("confusion_matrix", f"WITH {_M} SELECT g.label AS gold_label, p.label AS predicted_label, count(*) AS n FROM g JOIN p USING (doc_id, start_char, end_char) GROUP BY ALL")
def confusion_matrix(spark, d):
    g, p = _models(spark, d)
    j = g.select("doc_id", "start_char", "end_char", F.col("label").alias("gold_label")).join(p.select("doc_id", "start_char", "end_char", F.col("label").alias("predicted_label")), ["doc_id", "start_char", "end_char"])
    return j.groupBy("gold_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def _judged(spark, d):
    """Spans of the second model, right if the first has the same span and label."""
    g, p = _models(spark, d)
    return p.join(g.select(*_KEYS).distinct().withColumn("hit", F.lit(True)), _KEYS, "left").select("id", "confidence", "label", "doc_id", F.coalesce("hit", F.lit(False)).alias("correct"))


_J = f"{_M}, jd AS (SELECT p.id, p.confidence, p.label, p.doc_id, EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.start_char = p.start_char AND g.end_char = p.end_char AND g.label = p.label) AS correct FROM p)"
_BINS = "bins AS (SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n, avg(confidence) AS c, avg(correct::INT) AS a FROM jd WHERE confidence BETWEEN 0 AND 1 GROUP BY 1)"


@query("calibration_bins", f"WITH {_J}, {_BINS} SELECT bin, n, round(c, 9) AS mean_confidence, round(a, 9) AS accuracy FROM bins")
def calibration_bins(spark, d):
    return _round(E.calibration_bins(_judged(spark, d), "confidence", "correct"), "mean_confidence", "accuracy").withColumn("bin", F.col("bin").cast("long"))


@query("calibration_error", f"WITH {_J}, {_BINS} SELECT round(sum(abs(c - a) * n) / sum(n), 9) AS ece, round(max(abs(c - a)), 9) AS mce FROM bins")
def calibration_error(spark, d):
    return _round(E.calibration_error(E.calibration_bins(_judged(spark, d), "confidence", "correct")), "ece", "mce")


@query("brier_score", f"WITH {_J} SELECT round(avg((confidence - correct::INT) * (confidence - correct::INT)), 9) AS brier, round(avg(confidence) FILTER (correct) - avg(confidence) FILTER (NOT correct), 9) AS gap FROM jd WHERE confidence BETWEEN 0 AND 1")
def brier_score(spark, d):
    c, y = F.col("confidence"), F.col("correct").cast("int")
    return _judged(spark, d).where("confidence BETWEEN 0 AND 1").agg(F.round(F.avg((c - y) * (c - y)), 9).alias("brier"), F.round(F.avg(F.when(F.col("correct"), c)) - F.avg(F.when(~F.col("correct"), c)), 9).alias("gap"))


_CURVE = """s AS (SELECT least(floor(confidence * 20 + 1e-9), 20) AS step, correct::INT AS y FROM jd WHERE confidence IS NOT NULL), i AS (SELECT unnest(range(21)) AS i),
    k AS (SELECT i, (SELECT count(*) FROM s WHERE step >= i) AS n, (SELECT coalesce(sum(y), 0) FROM s WHERE step >= i) AS y, (SELECT sum(y) FROM s) AS a FROM i),
    c AS (SELECT i / 20.0::DOUBLE AS threshold, n AS n_kept, CASE WHEN n = 0 THEN 1.0 ELSE y / n::DOUBLE END AS precision, CASE WHEN a = 0 THEN 1.0 ELSE y / a::DOUBLE END AS recall FROM k)"""


@query("threshold_curve", f"WITH {_J}, {_CURVE} SELECT threshold, n_kept, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM c")
def threshold_curve(spark, d):
    return _round(E.threshold_curve(_judged(spark, d), "confidence", "correct"), "precision", "recall", "f1")


@query("auc_pr", f"WITH {_J}, {_CURVE}, w AS (SELECT *, lag(recall) OVER (ORDER BY recall, threshold DESC) AS r0, lag(precision) OVER (ORDER BY recall, threshold DESC) AS p0 FROM c) SELECT round(sum((recall - r0) * (precision + p0) / 2), 9) AS auc_pr FROM w")
def auc_pr(spark, d):
    return _round(E.area_under_curve(E.threshold_curve(_judged(spark, d), "confidence", "correct")), "auc_pr")


@query("accuracy_at_thresholds", f"WITH {_J}, h AS (SELECT unnest([0.5, 0.7, 0.8, 0.9, 0.95])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (confidence >= threshold) AS n, round(coalesce(avg(correct::INT) FILTER (confidence >= threshold), 0), 9) AS accuracy FROM h CROSS JOIN jd GROUP BY threshold")
def accuracy_at_thresholds(spark, d):
    marks = [0.5, 0.7, 0.8, 0.9, 0.95]
    one = _judged(spark, d).agg(F.array(*[F.struct(F.lit(m).alias("threshold"), F.count_if(F.col("confidence") >= m).alias("n"), F.round(F.coalesce(F.avg(F.when(F.col("confidence") >= m, F.col("correct").cast("int"))), F.lit(0.0)), 9).alias("accuracy")) for m in marks]).alias("x"))
    return one.select(F.inline("x"))


# Coreference: mentions of a document grouped by full text (key) and by their last word (response).
_COREF = "k AS (SELECT DISTINCT doc_id, pred_id AS mention, lower(text) AS cluster FROM predictions WHERE text IS NOT NULL), r AS (SELECT DISTINCT doc_id, pred_id AS mention, lower(string_split(text, ' ')[-1]) AS cluster FROM predictions WHERE text IS NOT NULL)"
_CELLS = """c AS (SELECT k.doc_id, k.cluster AS k, r.cluster AS r, count(*) AS c FROM k JOIN r USING (doc_id, mention) GROUP BY ALL), nk AS (SELECT doc_id, cluster AS k, count(*) AS nk FROM k GROUP BY ALL), nr AS (SELECT doc_id, cluster AS r, count(*) AS nr FROM r GROUP BY ALL), x AS (SELECT * FROM c JOIN nk USING (doc_id, k) JOIN nr USING (doc_id, r))"""
_F = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1"


def _coref(spark, d):
    p = t(spark, d, "predictions").where("text IS NOT NULL")
    m = ["doc_id", F.col("pred_id").alias("mention")]
    return p.select(*m, F.lower("text").alias("cluster")), p.select(*m, F.lower(F.element_at(F.split("text", " "), -1)).alias("cluster"))


@query("coref_b_cubed", f"WITH {_COREF}, {_CELLS}, s AS (SELECT sum(c * c / nr::DOUBLE) / sum(c) AS precision, sum(c * c / nk::DOUBLE) / sum(c) AS recall FROM x) SELECT {_F} FROM s")
def coref_b_cubed(spark, d):
    return _round(E.b_cubed(*_coref(spark, d)), "precision", "recall", "f1")


@query("coref_muc", f"WITH {_COREF}, {_CELLS}, a AS (SELECT sum(c) AS n, count(DISTINCT r) AS q FROM c GROUP BY doc_id, k HAVING sum(c) > 1), b AS (SELECT sum(c) AS n, count(DISTINCT k) AS q FROM c GROUP BY doc_id, r HAVING sum(c) > 1), s AS (SELECT (SELECT sum(n - q) / sum(n - 1)::DOUBLE FROM b) AS precision, (SELECT sum(n - q) / sum(n - 1)::DOUBLE FROM a) AS recall) SELECT {_F} FROM s")
def coref_muc(spark, d):
    return _round(E.muc(*_coref(spark, d)), "precision", "recall", "f1")


@query(
    "coref_blanc",
    f"""WITH {_COREF}, {_CELLS}, v AS (SELECT (SELECT sum(c * (c - 1) / 2.0::DOUBLE) FROM c) AS cc, (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT sum(c) AS n FROM c GROUP BY doc_id, k)) AS ck, (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT sum(c) AS n FROM c GROUP BY doc_id, r)) AS cr, (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT sum(c) AS n FROM c GROUP BY doc_id)) AS al),
        w AS (SELECT *, al - ck - cr + cc AS nc FROM v), z AS (SELECT cc / cr AS pc, cc / ck AS rc, nc / (al - cr) AS pn, nc / (al - ck) AS rn FROM w)
        SELECT round((pc + pn) / 2, 9) AS precision, round((rc + rn) / 2, 9) AS recall, round((2 * pc * rc / (pc + rc) + 2 * pn * rn / (pn + rn)) / 2, 9) AS f1 FROM z""",
)
def coref_blanc(spark, d):
    return _round(E.blanc(*_coref(spark, d)), "precision", "recall", "f1")


_SIDE = "CASE WHEN {n} = 1 THEN CASE WHEN {o} = 1 THEN 1.0 ELSE 0.0 END ELSE c * (c - 1) / ({n} * ({n} - 1))::DOUBLE END"


@query("coref_lea", f"WITH {_COREF}, {_CELLS}, s AS (SELECT (SELECT sum({_SIDE.format(n='nr', o='nk')} * nr) FROM x) / (SELECT sum(nr) FROM nr) AS precision, (SELECT sum({_SIDE.format(n='nk', o='nr')} * nk) FROM x) / (SELECT sum(nk) FROM nk) AS recall) SELECT {_F} FROM s")
def coref_lea(spark, d):
    return _round(E.lea(*_coref(spark, d)), "precision", "recall", "f1")


def _ceaf(score: str, size: str) -> str:
    """Cells of a document, the best first, each taken if neither of its clusters is."""
    return f"""{_COREF}, {_CELLS}, o AS (SELECT doc_id, k AS ck, r AS cr, {score} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY {score} DESC, k, r) AS i FROM x),
        w AS (SELECT doc_id, 0::BIGINT AS i, 0.0::DOUBLE AS s, []::VARCHAR[] AS ks, []::VARCHAR[] AS rs FROM (SELECT DISTINCT doc_id FROM o)
        UNION ALL SELECT o.doc_id, o.i, CASE WHEN list_contains(w.ks, o.ck) OR list_contains(w.rs, o.cr) THEN w.s ELSE w.s + o.s END, CASE WHEN list_contains(w.ks, o.ck) OR list_contains(w.rs, o.cr) THEN w.ks ELSE list_append(w.ks, o.ck) END, CASE WHEN list_contains(w.ks, o.ck) OR list_contains(w.rs, o.cr) THEN w.rs ELSE list_append(w.rs, o.cr) END FROM w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1),
        z AS (SELECT sum(s) AS s FROM (SELECT arg_max(s, i) AS s FROM w GROUP BY doc_id)), s AS (SELECT s / (SELECT {size.format(n='nr')} FROM nr) AS precision, s / (SELECT {size.format(n='nk')} FROM nk) AS recall FROM z)"""


_CEAF_E, _CEAF_M = _ceaf("c::DOUBLE", "sum({n})"), _ceaf("2 * c / (nk + nr)::DOUBLE", "count(*)")


@query("coref_ceaf_e", f"WITH RECURSIVE {_CEAF_E} SELECT {_F} FROM s")
def coref_ceaf_e(spark, d):
    return _round(E.ceaf(*_coref(spark, d)), "precision", "recall", "f1")


@query("coref_ceaf_m", f"WITH RECURSIVE {_CEAF_M} SELECT {_F} FROM s")
def coref_ceaf_m(spark, d):
    return _round(E.ceaf(*_coref(spark, d), dice=True), "precision", "recall", "f1")


_MUC_F = "mu AS (SELECT (SELECT sum(n - q) / sum(n - 1)::DOUBLE FROM (SELECT sum(c) AS n, count(DISTINCT k) AS q FROM c GROUP BY doc_id, r HAVING sum(c) > 1)) AS p, (SELECT sum(n - q) / sum(n - 1)::DOUBLE FROM (SELECT sum(c) AS n, count(DISTINCT r) AS q FROM c GROUP BY doc_id, k HAVING sum(c) > 1)) AS r), bc AS (SELECT sum(c * c / nr::DOUBLE) / sum(c) AS p, sum(c * c / nk::DOUBLE) / sum(c) AS r FROM x)"


@query("coref_conll", f"WITH RECURSIVE {_CEAF_E}, {_MUC_F} SELECT round((2 * mu.p * mu.r / (mu.p + mu.r) + 2 * bc.p * bc.r / (bc.p + bc.r) + 2 * s.precision * s.recall / (s.precision + s.recall)) / 3, 9) AS conll_f1 FROM mu, bc, s")
def coref_conll(spark, d):
    k, r = _coref(spark, d)
    one = E.muc(k, r).select(F.col("f1").alias("a")).join(E.b_cubed(k, r).select(F.col("f1").alias("b"))).join(E.ceaf(k, r).select(F.col("f1").alias("c")))
    return one.select(F.round((F.col("a") + F.col("b") + F.col("c")) / 3, 9).alias("conll_f1"))


@query("set_compare", f"WITH {_M}, a AS (SELECT DISTINCT label || ':' || lower(text) AS k FROM g), b AS (SELECT DISTINCT label || ':' || lower(text) AS k FROM p) SELECT 'both' AS side, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'only_second', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def set_compare(spark, d):
    a, b = (x.select(F.concat_ws(":", "label", F.lower("text")).alias("k")).where("text IS NOT NULL") for x in _models(spark, d))
    n = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "only_first")).unionByName(n(b.subtract(a), "only_second"))


@query("ensemble_agreement", f"WITH x AS (SELECT doc_id, start_char, end_char, count(DISTINCT model_name) AS models, count(DISTINCT {LABEL}) AS labels FROM predictions WHERE start_char IS NOT NULL AND label IS NOT NULL GROUP BY ALL) SELECT models, labels, count(*) AS n FROM x GROUP BY ALL")
def ensemble_agreement(spark, d):
    p = t(spark, d, "predictions").where("start_char IS NOT NULL AND label IS NOT NULL").withColumn("label", canonical_label(F.col("label")))
    x = p.groupBy("doc_id", "start_char", "end_char").agg(F.count_distinct("model_name").alias("models"), F.count_distinct("label").alias("labels"))
    return x.groupBy("models", "labels").agg(F.count(F.lit(1)).alias("n"))


@query("majority_vote", f"WITH x AS (SELECT doc_id, start_char, end_char, {LABEL} AS label, count(*) AS n FROM predictions WHERE start_char IS NOT NULL AND end_char IS NOT NULL AND label IS NOT NULL GROUP BY ALL) SELECT doc_id, start_char, end_char, label, n AS votes FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, start_char, end_char ORDER BY n DESC, label) = 1")
def majority_vote(spark, d):
    p = t(spark, d, "predictions").where("start_char IS NOT NULL AND end_char IS NOT NULL AND label IS NOT NULL").withColumn("label", canonical_label(F.col("label")))
    x = p.groupBy("doc_id", "start_char", "end_char", "label").agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy("doc_id", "start_char", "end_char").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.max("n").alias("votes"))


@query("coref_purity", f"WITH {_COREF}, {_CELLS} SELECT round((SELECT sum(m) / sum(n)::DOUBLE FROM (SELECT max(c) AS m, sum(c) AS n FROM c GROUP BY doc_id, r)), 9) AS purity, round((SELECT sum(m) / sum(n)::DOUBLE FROM (SELECT max(c) AS m, sum(c) AS n FROM c GROUP BY doc_id, k)), 9) AS completeness")
def coref_purity(spark, d):
    return _round(E.purity(*_coref(spark, d)), "purity", "completeness")


@query("coref_chain_strata", f"WITH {_COREF}, n AS (SELECT count(*) AS n FROM k GROUP BY doc_id, cluster) SELECT CASE WHEN n = 1 THEN 'singleton' WHEN n <= 10 THEN 'short' ELSE 'long' END AS stratum, count(*) AS n_chains, sum(n)::BIGINT AS n_mentions FROM n GROUP BY 1")
def coref_chain_strata(spark, d):
    return E.chain_strata(_coref(spark, d)[0])


_SZ = lambda n: f"CASE WHEN {n} = 1 THEN 'singleton' WHEN {n} <= 10 THEN 'short' ELSE 'long' END"


@query("coref_lea_by_stratum", f"WITH {_COREF}, {_CELLS}, a AS (SELECT {_SZ('nk')} AS stratum, sum({_SIDE.format(n='nk', o='nr')} * nk) AS g FROM x GROUP BY 1), b AS (SELECT {_SZ('nr')} AS stratum, sum({_SIDE.format(n='nr', o='nk')} * nr) AS g FROM x GROUP BY 1), ak AS (SELECT {_SZ('nk')} AS stratum, sum(nk) AS t FROM nk GROUP BY 1), bk AS (SELECT {_SZ('nr')} AS stratum, sum(nr) AS t FROM nr GROUP BY 1), s AS (SELECT stratum, coalesce(b.g / bk.t, 0) AS precision, coalesce(a.g / ak.t, 0) AS recall FROM ak FULL JOIN bk USING (stratum) LEFT JOIN a USING (stratum) LEFT JOIN b USING (stratum)) SELECT stratum, {_F} FROM s")
def coref_lea_by_stratum(spark, d):
    return _round(E.lea_by_stratum(*_coref(spark, d)), "precision", "recall", "f1")


@query("coref_by_document", f"WITH {_COREF}, {_CELLS}, d AS (SELECT doc_id, sum(c * c / nr::DOUBLE) / sum(c) AS p, sum(c * c / nk::DOUBLE) / sum(c) AS r FROM x GROUP BY doc_id), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM d), s AS (SELECT count(*) AS n_docs, avg(p) AS precision, avg(r) AS recall, avg(f) AS m, stddev_pop(f) AS sd FROM f) SELECT n_docs, {_F}, round(sd, 9) AS sd_f1, round(greatest(0, m - 1.96 * sd / sqrt(n_docs)), 9) AS low, round(least(1, m + 1.96 * sd / sqrt(n_docs)), 9) AS high FROM s")
def coref_by_document(spark, d):
    return _round(E.b_cubed_by_document(*_coref(spark, d)), "precision", "recall", "f1", "sd_f1", "low", "high")


@query("ner_per_document", f"WITH {_M}, gc AS (SELECT doc_id, start_char, end_char, label, count(*) AS n FROM g GROUP BY ALL), pc AS (SELECT doc_id, start_char, end_char, label, count(*) AS n FROM p GROUP BY ALL), j AS (SELECT doc_id, sum(coalesce(gc.n, 0)) AS a, sum(coalesce(pc.n, 0)) AS b, sum(least(coalesce(gc.n, 0), coalesce(pc.n, 0))) AS c FROM gc FULL JOIN pc USING (doc_id, start_char, end_char, label) GROUP BY doc_id), x AS (SELECT coalesce(2 * (c / nullif(b, 0)::DOUBLE) * (c / nullif(a, 0)::DOUBLE) / nullif(c / nullif(b, 0)::DOUBLE + c / nullif(a, 0)::DOUBLE, 0), 0) AS f FROM j), s AS (SELECT count(*) AS n_docs, avg(f) AS m, stddev_pop(f) AS s FROM x) SELECT n_docs, round(m, 9) AS mean_f1, round(s, 9) AS sd_f1, round(greatest(0, m - 1.96 * s / sqrt(n_docs)), 9) AS low, round(least(1, m + 1.96 * s / sqrt(n_docs)), 9) AS high FROM s")
def ner_per_document(spark, d):
    return _round(E.per_document(*_models(spark, d), _KEYS), "mean_f1", "sd_f1", "low", "high")
