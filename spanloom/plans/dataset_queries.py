"""Queries over sets of annotated texts: difficulty, shift, examples, curves, robustness, recognition, selection, spoilt texts."""

from pyspark.sql import functions as F

from ..functions import perturb as P
from ..functions import scores as X
from ..functions.text import SPACE, canonical_label, char_bucket, label_category
from ..operators import analysis as A
from ..operators.patterns import pattern_spans
from ..operators.vectors import cosine, euclidean
from ..queries import query
from ..session import read_table as t
from ..session import read_texts
from .text_queries import _CAT, LABEL

_E = f"e AS (SELECT pred_id, doc_id, text, {LABEL} AS label, confidence, lower(text) AS t FROM predictions WHERE text IS NOT NULL AND label IS NOT NULL)"
_WS = r"[ \t\n\x0B\f\r]+"
_SPLIT = lambda c: f"list_filter(regexp_split_to_array({c}, '{_WS}'), lambda w: w <> '')"


def _entities(spark, d):
    return t(spark, d, "predictions").where("text IS NOT NULL AND label IS NOT NULL").select("pred_id", "doc_id", "text", canonical_label(F.col("label")).alias("label"), "confidence", "model_name")


_STATS = f"w AS (SELECT label, t, len({_SPLIT('text')}) AS w FROM e), s AS (SELECT count(*) AS n_entities, count(DISTINCT label) AS n_types, count(DISTINCT t) AS n_texts, avg(w) AS mean_words, stddev_pop(w) AS sd_words, min(w)::INT AS min_words, max(w)::INT AS max_words, (SELECT w FROM (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i FROM w) WHERE i = (SELECT count(*) // 2 FROM w))::INT AS median_words, (SELECT count(*) FROM documents) AS n_examples FROM w)"


@query("dataset_stats", f"WITH {_E}, {_STATS} SELECT n_entities, n_types, n_texts, round(mean_words, 9) AS mean_words, round(sd_words, 9) AS sd_words, min_words, max_words, median_words, n_examples, round(n_texts / n_entities, 9) AS diversity, round(n_entities / n_examples, 9) AS entities_per_example FROM s")
def dataset_stats(spark, d):
    s = A.dataset_stats(_entities(spark, d), t(spark, d, "documents"))
    return s.withColumns({c: F.round(c, 9) for c in ("mean_words", "sd_words", "diversity", "entities_per_example")})


@query("dataset_difficulty", f"WITH {_E}, {_STATS}, x AS (SELECT round(CASE WHEN n_types > 10 THEN 0.2 WHEN n_types > 5 THEN 0.1 ELSE 0 END + CASE WHEN mean_words > 3 THEN 0.2 ELSE 0 END + CASE WHEN sd_words > 2 THEN 0.1 ELSE 0 END + CASE WHEN n_texts / n_entities > 0.9 THEN 0.2 WHEN n_texts / n_entities < 0.3 THEN -0.1 ELSE 0 END + CASE WHEN n_entities / n_examples < 1 THEN 0.1 ELSE 0 END, 9)::DOUBLE AS r FROM s) SELECT greatest(0, least(1, r)) AS score, CASE WHEN r < 0.2 THEN 'Easy' WHEN r < 0.4 THEN 'Medium' WHEN r < 0.6 THEN 'Hard' ELSE 'VeryHard' END AS difficulty FROM x")
def dataset_difficulty(spark, d):
    return A.difficulty(A.dataset_stats(_entities(spark, d), t(spark, d, "documents")))


_SIDES = "a AS (SELECT text, label FROM e JOIN (SELECT DISTINCT doc_id, source FROM documents) s USING (doc_id) WHERE source IS NOT NULL AND source <= 'm'), b AS (SELECT text, label FROM e JOIN (SELECT DISTINCT doc_id, source FROM documents) s USING (doc_id) WHERE source > 'm')"


def _sides(spark, d):
    e = _entities(spark, d).join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return e.where("source <= 'm'").select("text", "label"), e.where("source > 'm'").select("text", "label")


@query(
    "dataset_comparison",
    f"""WITH {_E}, {_SIDES}, wa AS (SELECT DISTINCT unnest({_SPLIT('lower(text)')}) AS w FROM a), wb AS (SELECT DISTINCT unnest({_SPLIT('lower(text)')}) AS w FROM b), v AS (SELECT (SELECT count(*) FROM wa JOIN wb USING (w)) / (SELECT count(*) FROM (SELECT w FROM wa UNION SELECT w FROM wb)) AS vocabulary),
        x AS (SELECT (SELECT count(*) FROM (SELECT lower(text) FROM a INTERSECT SELECT lower(text) FROM b)) / (SELECT count(*) FROM (SELECT lower(text) FROM a UNION SELECT lower(text) FROM b)) AS texts),
        pa AS (SELECT label, count(*) / (SELECT count(*) FROM a) AS p FROM a GROUP BY label), pb AS (SELECT label, count(*) / (SELECT count(*) FROM b) AS q FROM b GROUP BY label), j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM pa FULL JOIN pb USING (label)),
        js AS (SELECT sum(CASE WHEN p > 0 THEN p * ln(p / m) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) / 2 ELSE 0 END) / ln(2) AS divergence FROM j)
        SELECT round(vocabulary, 9) AS vocabulary, round(texts, 9) AS texts, round(divergence, 9) AS divergence, round(0.4 * divergence + 0.3 * (1 - vocabulary) + 0.3 * (1 - texts), 9) AS gap FROM v, x, js""",
)
def dataset_comparison(spark, d):
    """Sources in the first half of the alphabet against those in the second."""
    r = A.compare_sets(*_sides(spark, d))
    return r.withColumns({c: F.round(c, 9) for c in r.columns})


_GRAMS = lambda c: f"list_distinct(CASE WHEN length({c}) < 3 THEN [{c}] ELSE list_transform(range(1, length({c}) - 1), lambda i: substring({c}, i, 3)) END)"
_KIND = lambda c: _CAT.replace(LABEL, c).replace("label IS NULL", f"{c} IS NULL")


@query(
    "label_shift",
    f"""WITH {_E}, a AS (SELECT DISTINCT label AS x FROM e WHERE confidence >= 0.9), b AS (SELECT DISTINCT label AS y FROM e), j AS (SELECT y, CASE WHEN lower(x) = lower(y) THEN 1.0 WHEN contains(lower(x), lower(y)) OR contains(lower(y), lower(x)) THEN 0.8
        ELSE greatest(len(list_intersect({_GRAMS('lower(x)')}, {_GRAMS('lower(y)')})) / len(list_distinct(list_concat({_GRAMS('lower(x)')}, {_GRAMS('lower(y)')}))), CASE WHEN {_KIND('x')} = {_KIND('y')} THEN 0.5 ELSE 0 END) END AS l, (x = y)::INT AS k FROM a, b),
        m AS (SELECT y, max(l) AS l, max(k) AS k FROM j GROUP BY y), r AS (SELECT avg(k) AS o, avg(l) AS f, list(y ORDER BY y) FILTER (k = 0) AS unseen FROM m)
        SELECT round(o, 9) AS overlap, round(f, 9) AS familiarity, coalesce(array_to_string(unseen, ','), '') AS unseen, CASE WHEN o > 0.8 OR f > 0.85 THEN 'low' WHEN o > 0.4 OR f > 0.5 THEN 'medium' ELSE 'high' END AS difficulty FROM r""",
)
def label_shift(spark, d):
    e = _entities(spark, d)
    r = A.label_shift(e.where("confidence >= 0.9"), e)
    return r.select(F.round("overlap", 9).alias("overlap"), F.round("familiarity", 9).alias("familiarity"), F.array_join("unseen", ",").alias("unseen"), "difficulty")


_H = lambda key, seed=0: f"('0x' || substring(md5('{seed}:' || {key}), 1, 4))::INT / 65536.0::DOUBLE"


@query("train_validation_split", f"SELECT CASE WHEN {_H('doc_id')} < 0.8 THEN 'train' ELSE 'validation' END AS part, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def train_validation_split(spark, d):
    a, b = A.split(t(spark, d, "documents"), "doc_id")
    of = lambda df, name: df.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).select(F.lit(name).alias("part"), "n", "first_doc")
    return of(a, "train").unionByName(of(b, "validation"))


_SIZES = [0.0625, 0.125, 0.25, 0.5, 1.0]
_POINTS = f"h AS (SELECT *, {_H('doc_id')} AS h FROM e), pts AS (" + " UNION ALL ".join(
    f"SELECT {z}::DOUBLE AS size, (SELECT count(*) FROM h WHERE h < {z * 0.8}) AS train_size, (SELECT coalesce(2 * count(*) FILTER (k.said = x.label) / nullif(count(k.said) + count(*), 0), 0) FROM h x LEFT JOIN (SELECT t, label AS said FROM (SELECT t, label, count(*) AS n FROM h WHERE h < {z * 0.8} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY t ORDER BY n DESC, label) = 1) k ON k.t = x.t WHERE x.h >= 0.8) AS f1" for z in _SIZES
) + ")"


@query("learning_curve_points", f"WITH {_E}, {_POINTS} SELECT size, train_size, round(f1, 9) AS f1 FROM pts")
def learning_curve_points(spark, d):
    """How well texts seen in growing shares of the documents tell the labels in those held out."""
    return A.learning_curve(_entities(spark, d), "doc_id", _SIZES).withColumn("f1", F.round("f1", 9))


@query(
    "learning_curve_fit",
    f"""WITH {_E}, {_POINTS}, p AS (SELECT *, lag(train_size) OVER (ORDER BY train_size) AS s0, lag(f1) OVER (ORDER BY train_size) AS f0, row_number() OVER (ORDER BY train_size) - 1 AS i FROM pts),
        r AS (SELECT arg_min(f1, train_size) AS first, arg_max(f1, train_size) AS last, min(train_size) AS low, max(train_size) AS high, regr_slope(f1, ln(train_size)) AS slope, exp(regr_intercept(f1, ln(train_size))) AS a, regr_r2(f1, ln(train_size)) AS r2, min(s0) FILTER (train_size >= 1.5 * s0 AND f1 - f0 < 0.01) AS d, max(f1) FILTER (i = 1) AS third, max(f1) FILTER (i = 3) AS two FROM p)
        SELECT round((last - first) / (high - low) * 100, 9) AS f1_per_100, round(slope, 9) AS slope, round(a, 9) AS a, round(r2, 6) AS r2, round(least(1, last * 1.05), 9) AS c, d AS diminishing_at, round(CASE WHEN third - first <= 0 THEN 1.0 ELSE greatest(0, least(1, 1 - least((last - two) / (third - first), 1))) END, 9) AS saturation FROM r""",
)
def learning_curve_fit(spark, d):
    r = A.curve_fit(A.learning_curve(_entities(spark, d), "doc_id", _SIZES))
    return r.withColumns({c: F.round(c, 6 if c == "r2" else 9) for c in r.columns if c != "diminishing_at"})


_KS = [1, 5, 20]


@query(
    "few_shot_scores",
    f"""WITH {_E}, x AS (SELECT label AS said, t, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || t), t) AS n FROM (SELECT DISTINCT label, t FROM e)), g AS (SELECT label, count(*) AS n_gold FROM e GROUP BY label), k AS (SELECT unnest({_KS}) AS k),
        h AS (SELECT k, said AS label, count(*) AS n_predicted, count(*) FILTER (said = e.label) AS n_correct FROM e JOIN x USING (t) JOIN k ON n <= k GROUP BY ALL), r AS (SELECT k.k, g.label, n_gold, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_correct, 0) AS n_correct FROM g CROSS JOIN k LEFT JOIN h ON h.k = k.k AND h.label = g.label)
        SELECT k::INT AS k, label, n_gold, n_predicted, n_correct, round(coalesce(n_correct / nullif(n_predicted, 0), 0), 9) AS precision, round(n_correct / n_gold, 9) AS recall, round(coalesce(2 * n_correct / nullif(n_predicted + n_gold, 0), 0), 9) AS f1 FROM r""",
)
def few_shot_scores(spark, d):
    r = A.few_shot(_entities(spark, d), _KS)
    return r.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


_RATE_GROUPS = f"x AS (SELECT coalesce(channel, 'unknown') AS channel, coalesce(CASE WHEN length(entity_text) <= 5 THEN 'VeryShort' WHEN length(entity_text) <= 15 THEN 'Short' WHEN length(entity_text) <= 30 THEN 'Medium' WHEN length(entity_text) <= 50 THEN 'Long' ELSE 'VeryLong' END, 'unknown') AS length, coalesce({LABEL.replace('label', 'entity_type')}, 'unknown') AS kind, (lower(entity_text) IN (SELECT lower(text) FROM predictions WHERE text IS NOT NULL))::INT AS y FROM length_examples WHERE entity_text IS NOT NULL)"
_RATES = " UNION ALL ".join(f"SELECT '{n}' AS dimension, {e} AS value, y FROM x" for n, e in (("channel", "channel"), ("length", "length"), ("kind", "kind"), ("channel x length x kind", "channel || ' x ' || length || ' x ' || kind")))


@query("recognition_rates", f"WITH {_RATE_GROUPS}, r AS (SELECT dimension, value, count(*) AS n, avg(y) AS rate FROM ({_RATES}) GROUP BY ALL) SELECT dimension, value, n, round(rate, 9) AS rate, round(max(rate) OVER (PARTITION BY dimension) - min(rate) OVER (PARTITION BY dimension), 9) AS gap FROM r")
def recognition_rates(spark, d):
    """How many typed names, by who typed them where and how, stand in the same way among the predictions."""
    known = t(spark, d, "predictions").where("text IS NOT NULL").select(F.lower("text").alias("k")).distinct().withColumn("hit", F.lit(True))
    e = t(spark, d, "length_examples").where("entity_text IS NOT NULL").withColumn("k", F.lower("entity_text")).join(known, "k", "left")
    e = e.select("channel", char_bucket(F.length("entity_text")).alias("length"), canonical_label(F.col("entity_type")).alias("kind"), F.coalesce("hit", F.lit(False)).alias("hit"))
    r = A.recognition_rates(e, ["channel", "length", "kind"], F.col("hit"))
    return r.withColumns({"rate": F.round("rate", 9), "gap": F.round("gap", 9)})


_KNOWN = "kg AS (SELECT DISTINCT unnest(" + _GRAMS("lower(kb_name)") + ") AS g FROM kb_entities WHERE kb_name IS NOT NULL)"


@query(
    "outlier_entities",
    f"""WITH {_KNOWN}, x AS (SELECT DISTINCT text FROM predictions WHERE text IS NOT NULL), g AS (SELECT text, unnest({_GRAMS('lower(text)')}) AS g FROM x), c AS (SELECT text, count(*) FILTER (g IN (SELECT g FROM kg)) / count(*) AS coverage FROM g GROUP BY text),
        f AS (SELECT pred_id AS key, coverage, array_to_string(list_filter([CASE WHEN coverage < 0.5 THEN 'low_vocab_coverage' END, CASE WHEN coverage < 0.8 AND lower(text) NOT IN (SELECT lower(kb_name) FROM kb_entities WHERE kb_name IS NOT NULL) THEN 'unseen_entity' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END,
        CASE WHEN regexp_matches(text, '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}]') THEN 'unusual_characters' END], lambda v: v IS NOT NULL), ',') AS flags FROM predictions JOIN c USING (text)) SELECT key, round(coverage, 9) AS coverage, flags FROM f WHERE flags <> ''""",
)
def outlier_entities(spark, d):
    p = t(spark, d, "predictions").select(F.col("pred_id").alias("key"), "text", "confidence")
    return A.outlier_flags(p, t(spark, d, "kb_entities").select(F.col("kb_name").alias("text"))).withColumn("coverage", F.round("coverage", 9))


@query("label_frequency_bands", f"WITH {_E}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) - 1 AS i, count(*) OVER () AS m FROM n) SELECT label, n, CASE WHEN i < ceil(m * 0.2) THEN 'head' WHEN i >= m - ceil(m * 0.2) THEN 'tail' ELSE 'mid' END AS band FROM r")
def label_frequency_bands(spark, d):
    return A.frequency_bands(_entities(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")


_EX = f"x AS (SELECT d.doc_id AS key, d.text, e.labels, e.n FROM documents d JOIN (SELECT doc_id, list(DISTINCT label) AS labels, count(*) AS n FROM e GROUP BY doc_id) e USING (doc_id) WHERE d.text IS NOT NULL)"
_ASK = "We met the clerk of the harbour office at the depot."


@query("demonstrations", f"WITH {_E}, {_EX}, q AS (SELECT list_distinct({_SPLIT(chr(39) + _ASK.lower() + chr(39))}) AS q), s AS (SELECT key, list_distinct(list_filter(regexp_split_to_array(lower(text), '[{SPACE}]+'), lambda v: v <> '')) AS w, labels, n * 100.0::DOUBLE / len({_SPLIT('text')}) AS density, q FROM x, q WHERE len({_SPLIT('text')}) > 0), r AS (SELECT key, round(0.4::DOUBLE * len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q))) + 0.4::DOUBLE * len(list_intersect(labels, ['PER', 'ORG'])) / 2 + 0.2::DOUBLE * exp(-abs(density - 10) / 5), 9) AS score FROM s) SELECT key, score FROM r WHERE score >= 0.1 ORDER BY score DESC, key LIMIT 20")
def demonstrations(spark, d):
    """A top-k report: the documents that would help most as examples for a given sentence about a person and an organisation."""
    e = _entities(spark, d).groupBy("doc_id").agg(F.collect_set("label").alias("labels"), F.count(F.lit(1)).alias("n"))
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    x = t(spark, d, "documents").where("text IS NOT NULL").join(e, "doc_id").withColumn("words", n).where("words > 0")
    return A.demonstrations(x.select(F.col("doc_id").alias("key"), "text", "labels", (F.col("n") * 100 / F.col("words")).alias("density")), _ASK, ["PER", "ORG"], 10.0, 20)


_CAND = f"v AS (SELECT doc_id, t, label, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT doc_id, t, sum(4 * (n / s) * (1 - n / s)) / count(*) AS disagreement FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, t) AS s FROM v) GROUP BY ALL), c AS (SELECT pred_id AS key, e.text, confidence, disagreement FROM e JOIN g USING (doc_id, t))"
_WORTH = {
    "uncertainty": "1 - coalesce(confidence, 0)", "committee": "coalesce(disagreement, 1 - coalesce(confidence, 0))", "hybrid": "0.5 * (1 - coalesce(confidence, 0)) + 0.5 * coalesce(disagreement, 0)",
    "random": _H("text || ':' || key", 42),
}


def _annotate_query(strategy: str) -> None:
    @query(f"annotate_by_{strategy}", f"WITH {_E}, {_CAND} SELECT key, round({_WORTH[strategy]}, 9) AS score FROM c ORDER BY score DESC, key LIMIT 100")
    def run(spark, d):
        e = _entities(spark, d).withColumn("t", F.lower("text"))
        v = e.groupBy("doc_id", "t", "label").agg(F.count(F.lit(1)).alias("n"))
        s = v.groupBy("doc_id", "t").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count(F.lit(1)).alias("m"))
        g = s.select("doc_id", "t", (4 * (1 - F.col("q") / (F.col("s") * F.col("s"))) / F.col("m")).alias("disagreement"))
        c = e.join(g, ["doc_id", "t"]).select(F.col("pred_id").alias("key"), "text", "confidence", "disagreement")
        return A.to_annotate(c, strategy, 100)


for _strategy in A.STRATEGIES:
    _annotate_query(_strategy)


@query("annotate_farthest")
def annotate_farthest(spark, d):
    """Twelve vectors, far from each other, one after the other."""
    keys = A.farthest_points(t(spark, d, "embeddings"), 12, "vec_id", "embedding")
    return spark.createDataFrame(list(enumerate(keys, 1)), "step int, vec_id bigint")


# --- spoilt texts ------------------------------------------------------------------------------------------

_R = "(('0x' || substring(md5('42:' || i || ':' || t), 1, 4))::INT / 65536.0::DOUBLE)"
_C = "substring(t, i, 1)"
_L = f"regexp_matches({_C}, '^\\p{{L}}$')"
_MAP = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + f" ELSE {c} END"
_PUNCT = "[!-/:-@\\[-`{-~]"
_EACH = {
    "typo_insert": f"CASE WHEN {_L} AND {_R} < 0.1 THEN {_C} || {_MAP(f'lower({_C})', P.KEYBOARD)} ELSE {_C} END", "typo_delete": f"CASE WHEN {_L} AND {_R} < 0.1 THEN '' ELSE {_C} END",
    "typo_keyboard": f"CASE WHEN {_L} AND {_R} < 0.1 THEN {_MAP(f'lower({_C})', P.KEYBOARD)} ELSE {_C} END", "case_mixed": f"CASE WHEN i % 2 = 1 THEN upper({_C}) ELSE lower({_C}) END",
    "space_extra": f"CASE WHEN {_C} = ' ' AND {_R} < 3 * 0.1::DOUBLE THEN '  ' ELSE {_C} END", "space_remove": f"CASE WHEN {_C} = ' ' AND {_R} < 0.1 THEN '' ELSE {_C} END", "space_newline": f"CASE WHEN {_C} = ' ' AND {_R} < 0.1 THEN chr(10) ELSE {_C} END",
    "punctuation_extra": f"CASE WHEN regexp_matches({_C}, '{_PUNCT}') AND {_R} < 3 * 0.1::DOUBLE THEN {_C} || {_C} ELSE {_C} END", "unicode_look_alike": f"CASE WHEN {_R} < 0.1 THEN {_MAP(_C, P.LOOK_ALIKES)} ELSE {_C} END",
    "unicode_marks": f"CASE WHEN {_R} < 0.1 THEN {_MAP(_C, P.MARKED)} ELSE {_C} END", "unicode_zero_width": f"CASE WHEN {_R} < 0.05 THEN {_C} || chr(8203) ELSE {_C} END",
}
_WHOLE = {"none": "t", "case_upper": "upper(t)", "case_lower": "lower(t)", "punctuation_remove": f"regexp_replace(t, '{_PUNCT}', '', 'g')", "case_title": f"array_to_string(list_transform({_SPLIT('t')}, lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ')"}
_SWAP = f"CASE WHEN i < length(t) AND {_L} AND regexp_matches(substring(t, i + 1, 1), '^\\p{{L}}$') AND {_R} < 0.1 THEN substring(t, i + 1, 1) || {_C} ELSE {_C} || substring(t, i + 1, 1) END"
_SPOILT = (
    [f"{e} AS {n}" for n, e in _WHOLE.items()] + [f"CASE WHEN t = '' THEN '' ELSE array_to_string(list_transform(range(1, length(t) + 1), lambda i: {e}), '') END AS {n}" for n, e in _EACH.items()]
    + [f"CASE WHEN length(t) > 1 THEN array_to_string(list_transform(range(1, length(t) + 1, 2), lambda i: {_SWAP}), '') ELSE t END AS typo_swap"]
)


@query("perturbations", f"WITH x AS (SELECT example_id, entity_text AS t FROM length_examples WHERE entity_text IS NOT NULL) SELECT example_id, {', '.join(_SPOILT)} FROM x")
def perturbations(spark, d):
    e = t(spark, d, "length_examples").where("entity_text IS NOT NULL")
    return e.select("example_id", *[P.perturbed(F.col("entity_text"), how).alias(how) for how in P.PERTURBATIONS])


_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_HOWS = {"case_upper": "upper(text)", "case_lower": "lower(text)", "punctuation_remove": f"regexp_replace(text, '{_PUNCT}', '', 'g')", "none": "text", "case_title": f"array_to_string(list_transform({_SPLIT('text')}, lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ')"}


@query(
    "robustness_scores",
    "WITH b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '" + _DATE + "')) AS t FROM documents WHERE text IS NOT NULL), s AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS how, doc_id, unnest(regexp_extract_all({e}, '{_DATE}')) AS t FROM documents WHERE text IS NOT NULL" for n, e in _HOWS.items())
    + "), h AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in _HOWS) + "]) AS how), r AS (SELECT h.how, count(s.t) AS p, count(b.t) AS c, (SELECT count(*) FROM b) AS g FROM h LEFT JOIN s USING (how) LEFT JOIN b USING (doc_id, t) GROUP BY h.how) SELECT how, round(coalesce(c / nullif(p, 0), 0), 9) AS precision, round(c / g, 9) AS recall, round(2 * c / (p + g), 9) AS f1, round(2 * c / (p + g) - 1, 9) AS change FROM r",
)
def robustness_scores(spark, d):
    """What is still found of the dates in texts that are spoilt in ways without chance."""
    docs = read_texts(spark, d).where("text IS NOT NULL").select("doc_id", "text")
    found = lambda x: pattern_spans(x, _DATE, unicode=False).select(F.col("doc_id").alias("key"), F.col("surface").alias("t"), F.lit("DATE").alias("label"))
    spoilt = None
    for how in _HOWS:
        one = found(docs.select("doc_id", P.perturbed(F.col("text"), how).alias("text"))).withColumn("how", F.lit(how))
        spoilt = one if spoilt is None else spoilt.unionByName(one)
    r = A.robustness(found(docs), spoilt, list(_HOWS))
    return r.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "change")})


# --- numbers -----------------------------------------------------------------------------------------------

_GRADE = lambda c, kind: "CASE " + " ".join(f"WHEN {c} {'<' if X.GRADES[kind][-1][0] == float('inf') else '>' if kind == 'gap' else '>='} {at} THEN '{n}'" for at, n in X.GRADES[kind][:-1]) + f" WHEN {c} IS NOT NULL THEN '{X.GRADES[kind][-1][1]}' END"


@query("confidence_numbers", f"SELECT pred_id, round(1 / (1 + exp(-confidence / 0.5)), 9) AS soft, greatest(0, least(1, confidence)) AS clamped, round(sqrt(confidence * 0.5), 9) AS together, round(greatest(0, least(1, greatest(0, least(1, confidence)) * 0.75 + 0.25)), 9) AS toward_one, {', '.join(_GRADE('confidence', k) + ' AS ' + k for k in X.GRADES)} FROM predictions")
def confidence_numbers(spark, d):
    c = F.col("confidence")
    return t(spark, d, "predictions").select("pred_id", F.round(X.sigmoid(c, 0.5), 9).alias("soft"), X.clamped(c).alias("clamped"), F.round(X.together(c, F.lit(0.5)), 9).alias("together"), F.round(X.between(X.clamped(c), F.lit(1.0), F.lit(0.25)), 9).alias("toward_one"), *[X.grade(c, k).alias(k) for k in X.GRADES])


_SAME = "(upper(a.label) = upper(b.label) OR " + " OR ".join(f"(upper(a.label) = '{x}' AND upper(b.label) = '{y}')" for x, y in X.SAME_TYPE) + ")"


@query("notations_that_match", f"WITH l AS (SELECT DISTINCT label FROM predictions WHERE label IS NOT NULL) SELECT a.label AS predicted, b.label AS gold FROM l a, l b WHERE {_SAME}")
def notations_that_match(spark, d):
    l = t(spark, d, "predictions").where("label IS NOT NULL").select("label").distinct()  # noqa: E741
    return l.select(F.col("label").alias("predicted")).join(F.broadcast(l.select(F.col("label").alias("gold"))), X.types_match(F.col("predicted"), F.col("gold")))


@query("vector_numbers", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS half_cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_numbers(spark, d):
    """Each vector against the next."""
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return j.select("vec_id", F.round(euclidean(F.col("a"), F.col("b")), 6).alias("euclidean"), F.round(X.half_cosine(cosine(F.col("a"), F.col("b")), F.size("a") == F.size("b")), 6).alias("half_cosine"))


@query("category_shares", f"WITH x AS (SELECT {_CAT} AS category FROM predictions WHERE label IS NOT NULL) SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 9) AS share FROM x GROUP BY category")
def category_shares(spark, d):
    x = t(spark, d, "predictions").where("label IS NOT NULL").select(label_category(canonical_label(F.col("label"))).alias("category"))
    n = x.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return n.join(x.agg(F.count(F.lit(1)).alias("m"))).select("category", "n", F.round(F.col("n") / F.col("m"), 9).alias("share"))  # one row
