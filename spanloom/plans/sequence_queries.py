"""Queries over token sequences, relations, streams and plain relational work."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import canonical_label
from ..operators import patterns as P
from ..operators import sequence as Q
from ..queries import query
from ..session import read_table as t
from ..streaming import windows as W

_TOK = """w AS (SELECT example_id AS seq, string_split(sentence, ' ') AS w, sentence, entity_text, coalesce(entity_type, 'NONE') AS label FROM length_examples WHERE sentence IS NOT NULL AND entity_text IS NOT NULL),
    u AS (SELECT seq, w, sentence, entity_text, label, unnest(range(1, len(w) + 1)) AS i FROM w), k AS (SELECT seq, i - 1 AS pos, w[i] AS token, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS s, strpos(sentence, entity_text) - 1 AS a, length(entity_text) AS n, label FROM u),
    g AS (SELECT seq, pos, token, s AS start_char, s + length(token) AS end_char, CASE WHEN a >= 0 AND s < a + n AND s + length(token) > a THEN label END AS l FROM k WHERE token <> ''),
    b AS (SELECT seq, pos, token, start_char, end_char, CASE WHEN l IS NULL THEN 'O' WHEN lag(l) OVER (PARTITION BY seq ORDER BY pos) IS NOT NULL THEN 'I-' || l ELSE 'B-' || l END AS tag FROM g)"""


def _tagged(spark, d):
    e = t(spark, d, "length_examples").where("sentence IS NOT NULL AND entity_text IS NOT NULL")
    at = F.expr("position(entity_text, sentence) - 1")
    s = e.select(F.col("example_id").alias("seq"), at.alias("span_start"), (at + F.length("entity_text")).alias("span_end"), F.coalesce("entity_type", F.lit("NONE")).alias("label")).where("span_start >= 0")
    return Q.tag_spans(Q.tokens_of(e, "example_id", "sentence"), s)


@query("spans_to_bio", f"WITH {_TOK} SELECT seq, pos, token, tag FROM b")
def spans_to_bio(spark, d):
    return _tagged(spark, d).select("seq", "pos", "token", "tag")


@query("bio_to_spans", f"WITH {_TOK} SELECT seq, min(pos) AS first_pos, max(pos) AS last_pos, min(substring(tag, 3)) AS label, string_agg(token, ' ' ORDER BY pos) AS surface FROM b WHERE tag <> 'O' GROUP BY seq")
def bio_to_spans(spark, d):
    return Q.bio_to_spans(_tagged(spark, d))


def _broken(spark, d):
    """Tags with every beginning lost."""
    return _tagged(spark, d).withColumn("tag", F.regexp_replace("tag", "^B-", "I-"))


@query("invalid_bio_tags", f"WITH {_TOK} SELECT seq, pos, 'I-' || substring(tag, 3) AS tag FROM b WHERE tag LIKE 'B-%'")
def invalid_bio_tags(spark, d):
    return Q.invalid_tags(_broken(spark, d))


@query("repair_bio_tags", f"WITH {_TOK} SELECT seq, pos, token, tag FROM b")
def repair_bio_tags(spark, d):
    return Q.repair_tags(_broken(spark, d))


@query("token_context", f"WITH {_TOK} SELECT seq, pos, coalesce(string_agg(token, ' ') OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(token, ' ') OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after FROM b")
def token_context(spark, d):
    return Q.context(_tagged(spark, d)).select("seq", "pos", "before", "after")


@query("chunked_extraction", "WITH d AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), lambda x: length(x)) AS g FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, g, unnest(range(1, len(g))) AS i FROM d) SELECT doc_id, (list_sum(g[1:i]) + 10 * (i - 1))::BIGINT AS start_char FROM x")
def chunked_extraction(spark, d):
    """Dates found in overlapping chunks of 1,000 characters; a span found twice is one."""
    c = W.chunks(t(spark, d, "documents"), 1000, 40)
    found = P.pattern_spans(c.select(F.struct("doc_id", "offset").alias("doc_id"), "text"), r"[0-9]{4}-[0-9]{2}-[0-9]{2}", unicode=False)
    return found.select(F.col("doc_id.doc_id").alias("doc_id"), (F.col("doc_id.offset") + F.col("start_char")).cast("long").alias("start_char")).distinct()


@query("stream_tumbling_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, d):
    s = W.tumbling_counts(W.read_stream(spark, f"{d}/events.parquet"))
    return W.run_to_end(s, "tumbling", ["start", "event_type"]).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("stream_sliding_counts", "WITH x AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) SELECT start, count(*) AS n FROM x GROUP BY start")
def stream_sliding_counts(spark, d):
    s = W.sliding_counts(W.read_stream(spark, f"{d}/events.parquet"))
    return W.run_to_end(s, "sliding", ["start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, d):
    return W.sessions(t(spark, d, "events")).select("user_id", "start", "n")


@query("stream_running_stats", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def stream_running_stats(spark, d):
    s = W.running_stats(W.read_stream(spark, f"{d}/events.parquet"))
    out = W.run_to_end(s, "running", ["event_type"])
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"))


# --- plain relational work -------------------------------------------------------------------------


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    x = t(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus")
    return x.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("revenue_by_nation", "SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def revenue_by_nation(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("orders_as_of", "SELECT e.event_id, max(o.o_orderkey) AS order_id FROM events e JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON o.o_custkey = e.user_id GROUP BY e.event_id")
def orders_as_of(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    o = t(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("order_id"))
    return t(spark, d, "events").join(o, "user_id").select("event_id", "order_id")


@query("rollup_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark, d):
    return t(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
