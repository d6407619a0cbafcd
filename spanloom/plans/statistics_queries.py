"""Queries over dataset statistics, drift and vectors."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import canonical_label, char_ngrams
from ..operators import statistics as Z
from ..operators import vectors as V
from ..queries import query
from ..session import read_table as t
from .text_queries import LABEL

_P = f"(SELECT *, {LABEL} AS kind FROM predictions WHERE label IS NOT NULL)"


def _p(spark, d):
    return t(spark, d, "predictions").where("label IS NOT NULL").withColumn("kind", canonical_label(F.col("label")))


@query("upper_median", f"SELECT kind, list_sort(list(length(text)))[count(*) // 2 + 1] AS median FROM {_P} WHERE text IS NOT NULL GROUP BY kind")
def upper_median(spark, d):
    return Z.upper_median(_p(spark, d).where("text IS NOT NULL").withColumn("n", F.length("text")), "n", ["kind"])


@query("js_divergence_models", f"WITH s AS (SELECT model_name, kind, count(*) / (sum(count(*)) OVER (PARTITION BY model_name)) AS p FROM {_P} GROUP BY model_name, kind), g AS (SELECT m.model_name, k.kind, coalesce(s.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT DISTINCT model_name FROM s) m CROSS JOIN (SELECT DISTINCT kind FROM s) k LEFT JOIN s ON s.model_name = m.model_name AND s.kind = k.kind LEFT JOIN s b ON b.model_name = 'heuristic-v2' AND b.kind = k.kind) SELECT model_name, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) / 2 ELSE 0 END) / ln(2.0), 9) AS divergence FROM g GROUP BY model_name")
def js_divergence_models(spark, d):
    return Z.js_divergence(Z.shares(_p(spark, d), "model_name", "kind"), "model_name", "kind", "heuristic-v2").withColumn("divergence", F.round("divergence", 9))


@query("ambiguous_surfaces", f"SELECT lower(text) AS text, count(DISTINCT kind) AS n_labels, count(*) AS n FROM {_P} WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT kind) > 1")
def ambiguous_surfaces(spark, d):
    return Z.ambiguous_texts(_p(spark, d).where("text IS NOT NULL"), "text", "kind")


@query("dataset_quality", "SELECT count(*) AS n, count(*) - count(text) AS nulls, count(text) - count(DISTINCT lower(text)) AS redundant, round((count(text) - count(DISTINCT lower(text))) / count(text)::DOUBLE, 9) AS redundancy FROM documents")
def dataset_quality(spark, d):
    x = F.lower("text")
    return t(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("text")).alias("nulls"), (F.count("text") - F.count_distinct(x)).alias("redundant"), F.round((F.count("text") - F.count_distinct(x)) / F.count("text"), 9).alias("redundancy"))


@query("leakage", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL AND md5(lower(text)) IN (SELECT md5(lower(text)) FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL)")
def leakage(spark, d):
    """Test documents (every fifth) whose text is also among the others; compared by digest."""
    x = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.lower("text")).alias("h"))
    return x.where("doc_id % 5 = 0").join(x.where("doc_id % 5 <> 0").select("h"), "h", "left_semi").select("doc_id")


@query("vocabulary_overlap", "WITH w AS (SELECT DISTINCT lang, unnest(string_split(lower(text), ' ')) AS w FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL), n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang), c AS (SELECT a.lang AS a, b.lang AS b, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.lang < b.lang GROUP BY ALL) SELECT c.a AS lang_a, c.b AS lang_b, round(c / (x.n + y.n - c)::DOUBLE, 9) AS jaccard FROM c JOIN n x ON x.lang = c.a JOIN n y ON y.lang = c.b")
def vocabulary_overlap(spark, d):
    w = t(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct()
    n = w.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # a word's language labels are a small set: pairs of them, without a self-join of words
    langs = w.groupBy("w").agg(F.array_sort(F.collect_set("lang")).alias("l")).where(F.size("l") > 1)
    c = langs.select(F.explode("l").alias("lang_a"), "l").select("lang_a", F.explode("l").alias("lang_b")).where("lang_a < lang_b").groupBy("lang_a", "lang_b").agg(F.count(F.lit(1)).alias("c"))
    j = c.join(n.withColumnsRenamed({"lang": "lang_a", "n": "x"}), "lang_a").join(n.withColumnsRenamed({"lang": "lang_b", "n": "y"}), "lang_b")
    return j.select("lang_a", "lang_b", F.round(F.col("c") / (F.col("x") + F.col("y") - F.col("c")), 9).alias("jaccard"))


_RANK = "r AS (SELECT lower(text) AS x, count(*) AS n FROM predictions WHERE text IS NOT NULL GROUP BY 1)"


@query("long_tail_gini", f"WITH {_RANK}, o AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM r) SELECT round(2 * sum(i * n) / (count(*) * sum(n)::DOUBLE) - (count(*) + 1) / count(*)::DOUBLE, 9) AS gini FROM o")
def long_tail_gini(spark, d):
    n = t(spark, d, "predictions").where("text IS NOT NULL").groupBy(F.lower("text").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return Z.gini(n, "n").select(F.round("gini", 9).alias("gini"))


@query("long_tail_buckets", f"WITH {_RANK} SELECT CASE WHEN n = 1 THEN 'once' WHEN n <= 5 THEN 'few' WHEN n <= 50 THEN 'some' ELSE 'many' END AS bucket, count(*) AS texts, sum(n)::BIGINT AS mentions FROM r GROUP BY 1")
def long_tail_buckets(spark, d):
    n = t(spark, d, "predictions").where("text IS NOT NULL").groupBy(F.lower("text").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.when(F.col("n") == 1, "once").when(F.col("n") <= 5, "few").when(F.col("n") <= 50, "some").otherwise("many").alias("bucket")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("mentions"))


_W = "w AS (SELECT *, (9 - ((count(*) OVER () - row_number() OVER (ORDER BY ts, event_id)) // 500))::INT AS win FROM events), v AS (SELECT * FROM w WHERE win >= 0)"


@query("drift_windows", f'WITH {_W} SELECT win AS "window", count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS sd_value, count(DISTINCT user_id) AS users FROM v GROUP BY win')
def drift_windows(spark, d):
    e = Z.count_windows(t(spark, d, "events"), ["ts", "event_id"], 500, 10)
    return e.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_pop("value"), 6).alias("sd_value"), F.count_distinct("user_id").alias("users"))


@query("kl_drift", f'WITH {_W}, s AS (SELECT win, event_type, count(*) / (sum(count(*)) OVER (PARTITION BY win)) AS p FROM v GROUP BY win, event_type) SELECT s.win AS "window", round(sum(s.p * ln(s.p / coalesce(b.p, 1e-10))), 9) AS kl FROM s LEFT JOIN s b ON b.event_type = s.event_type AND b.win = (SELECT min(win) FROM s) GROUP BY s.win')
def kl_drift(spark, d):
    e = Z.count_windows(t(spark, d, "events"), ["ts", "event_id"], 500, 10)
    return Z.kl_from_first(Z.shares(e, "window", "event_type"), "window", "event_type").withColumn("kl", F.round("kl", 9))


@query("paired_t_test", "WITH x AS (SELECT doc_id, avg(confidence) FILTER (start_char IS NOT NULL) - avg(confidence) FILTER (start_char IS NULL) AS d FROM predictions GROUP BY doc_id), s AS (SELECT count(d) AS n, avg(d) AS m, stddev_samp(d) AS s FROM x), y AS (SELECT n, m, m / (s / sqrt(n)) AS t FROM s) SELECT n, round(m, 9) AS mean_difference, round(t, 6) AS t, CASE WHEN abs(t) > 2.576 THEN 0.005 WHEN abs(t) > 1.96 THEN 0.03 ELSE 0.1 END::DOUBLE AS p_bucket FROM y")
def paired_t_test(spark, d):
    x = t(spark, d, "predictions").groupBy("doc_id").agg(F.avg(F.when(F.col("start_char").isNotNull(), F.col("confidence"))).alias("a"), F.avg(F.when(F.col("start_char").isNull(), F.col("confidence"))).alias("b"))
    return Z.paired_t(x, F.col("a"), F.col("b")).withColumns({"mean_difference": F.round("mean_difference", 9), "t": F.round("t", 6)})


@query("cohens_d", f"SELECT round((avg(confidence) FILTER (kind = 'PER') - avg(confidence) FILTER (kind <> 'PER')) / sqrt((var_samp(confidence) FILTER (kind = 'PER') + var_samp(confidence) FILTER (kind <> 'PER')) / 2), 9) AS d FROM {_P}")
def cohens_d(spark, d):
    return Z.cohens_d(_p(spark, d), F.col("kind") == "PER", F.col("confidence")).select(F.round("d", 9).alias("d"))


@query("stratified_sample", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY genre ORDER BY md5('1:' || doc_id), doc_id) <= ceil(0.1 * count(*) OVER (PARTITION BY genre) - 1e-9)")
def stratified_sample(spark, d):
    return Z.stratified_sample(t(spark, d, "documents"), "genre", "doc_id", 0.1).select("doc_id")


_G3 = "list_distinct(CASE WHEN length({c}) < 3 THEN [{c}] ELSE list_transform(range(1, length({c}) - 1), lambda i: substring({c}, i, 3)) END)"


@query("ood_coverage", f"WITH seen AS (SELECT DISTINCT unnest({_G3.format(c='lower(kb_name)')}) AS g FROM kb_entities WHERE kb_name IS NOT NULL), t AS (SELECT lower(text) AS t, count(*) AS n FROM predictions WHERE text IS NOT NULL GROUP BY 1), g AS (SELECT t, n, unnest({_G3.format(c='t')}) AS g FROM t), c AS (SELECT t, n, avg((g IN (SELECT g FROM seen))::INT) AS c FROM g GROUP BY ALL) SELECT CASE WHEN c >= 0.8 THEN 'known' WHEN c >= 0.5 THEN 'partly' ELSE 'unknown' END AS coverage, count(*) AS texts, sum(n)::BIGINT AS mentions FROM c GROUP BY 1")
def ood_coverage(spark, d):
    """How far the trigrams of the catalogue cover the texts of all predictions; equal texts are judged once."""
    grams = lambda c: F.array_distinct(char_ngrams(F.lower(c), 3))
    seen = t(spark, d, "kb_entities").where("kb_name IS NOT NULL").select(F.explode(grams("kb_name")).alias("g")).distinct().withColumn("hit", F.lit(1))
    n = t(spark, d, "predictions").where("text IS NOT NULL").groupBy(F.lower("text").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    c = n.select("t", "n", F.explode(grams("t")).alias("g")).join(seen, "g", "left").groupBy("t", "n").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("c"))
    band = F.when(F.col("c") >= 0.8, "known").when(F.col("c") >= 0.5, "partly").otherwise("unknown")
    return c.groupBy(band.alias("coverage")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("mentions"))


@query("uncertainty_sampling", "SELECT pred_id, round(1 - confidence, 9) AS score FROM predictions WHERE confidence BETWEEN 0 AND 1 ORDER BY score DESC, pred_id LIMIT 50")
def uncertainty_sampling(spark, d):
    """A top-k report: the 50 spans that a labeller should see first."""
    return t(spark, d, "predictions").where("confidence BETWEEN 0 AND 1").select("pred_id", F.round(1 - F.col("confidence"), 9).alias("score")).orderBy(F.col("score").desc(), "pred_id").limit(50)


@query("query_by_committee", f"WITH v AS (SELECT doc_id, start_char, end_char, kind, count(DISTINCT model_name) AS n FROM {_P} WHERE start_char IS NOT NULL GROUP BY ALL), p AS (SELECT *, n / (sum(n) OVER (PARTITION BY doc_id, start_char, end_char)) AS p FROM v) SELECT doc_id, start_char, end_char, round(avg(4 * p * (1 - p)), 9) AS disagreement FROM p GROUP BY ALL HAVING avg(4 * p * (1 - p)) > 0")
def query_by_committee(spark, d):
    v = _p(spark, d).where("start_char IS NOT NULL").groupBy("doc_id", "start_char", "end_char", "kind").agg(F.count_distinct("model_name").alias("n"))
    p = v.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("doc_id", "start_char", "end_char")))
    return p.groupBy("doc_id", "start_char", "end_char").agg(F.round(F.avg(4 * F.col("p") * (1 - F.col("p"))), 9).alias("disagreement")).where("disagreement > 0")


# --- vectors ---------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query("cosine_topk", f"SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, round({_COS}, 6) AS similarity FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) <= 5")
def cosine_topk(spark, d):
    e = t(spark, d, "embeddings")
    return V.search(e, e.where("vec_id % 20 = 0"), 5).select("query_id", "neighbour_id", F.round("similarity", 6).alias("similarity"))


@query("binary_hash_topk", f"SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, round({_COS}, 6) AS similarity FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: ((v.embedding[i] > 0) <> (q.embedding[i] > 0))::INT)) <= len(v.embedding) * 0.47 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) <= 5")
def binary_hash_topk(spark, d):
    e = t(spark, d, "embeddings")
    n = len(e.first()["embedding"])
    return V.search(e, e.where("vec_id % 20 = 0"), 5, max_hamming=int(n * 0.47)).select("query_id", "neighbour_id", F.round("similarity", 6).alias("similarity"))


@query("box_overlap", "WITH p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_transform(range(1, len(a.embedding) + 1), lambda i: greatest(0, 4 - abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)) / 4) AS s FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id) SELECT left_id, right_id, round(list_product(s), 6) AS score FROM p")
def box_overlap(spark, d):
    """Coreference score of the boxes (radius 2) around neighbouring vectors."""
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    j = e.select(F.col("vec_id").alias("left_id"), F.col("v").alias("a")).join(e.select(F.col("vec_id").alias("right_id"), (F.col("vec_id") - 1).alias("left_id"), F.col("v").alias("b")), "left_id")
    return j.select("left_id", "right_id", F.round(V.box_coref(*V.box_around(F.col("a"), 2.0), *V.box_around(F.col("b"), 2.0)), 6).alias("score"))


_BOX = "list_product(list_transform(range(1, len(v.embedding) + 1), lambda i: greatest(0, 4 - abs(v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)) / 4))"


@query("box_overlap_topk", f"SELECT query_id, neighbour_id, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, {_BOX} AS s FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id) WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, neighbour_id) <= 5")
def box_overlap_topk(spark, d):
    """The vectors whose boxes (radius 2) overlap most with those of the queries, whatever their ids."""
    e = t(spark, d, "embeddings")
    return V.box_search(e, e.where("vec_id % 20 = 0"), 5, 2.0).select("query_id", "neighbour_id", F.round("score", 6).alias("score"))


@query("centroid_distance", "WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(v::DOUBLE) AS m FROM x GROUP BY ALL) SELECT a.label AS label_a, b.label AS label_b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS distance FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY ALL")
def centroid_distance(spark, d):
    x = t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = x.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    j = m.withColumnsRenamed({"label": "label_a", "m": "a"}).join(m.withColumnsRenamed({"label": "label_b", "m": "b"}), "i").where("label_a < label_b")
    return j.groupBy("label_a", "label_b").agg(F.round(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))), 6).alias("distance"))


@query("embedding_pairs", f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({_COS.replace('v.', 'a.').replace('q.', 'b.')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND {_COS.replace('v.', 'a.').replace('q.', 'b.')} >= 0.35")
def embedding_pairs(spark, d):
    """Vectors of one label that lie near each other."""
    e = V.cosine_pairs(t(spark, d, "embeddings"), 0.35, block="label")
    return e.select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), F.round("cosine", 6).alias("cosine"))
