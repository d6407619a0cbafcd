"""Queries over entity graphs and resolution."""

from pyspark.sql import functions as F

from ..functions.text import canonical_label
from ..operators import graph as G
from ..operators import resolve as R
from ..queries import query
from ..session import read_table as t
from . import relation_queries as RQ
from .text_queries import _S, LABEL

_NODE = f"({LABEL}) || ':' || replace(lower(trim(text)), ' ', '_')"
_NODE = "lower(label) || ':' || replace(lower(trim(text, ' ')), ' ', '_')"
_LOC = "(SELECT *, " + _NODE + " AS node FROM predictions WHERE start_char IS NOT NULL AND end_char IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL)"
_EDGES = f"""e AS (SELECT least(a.node, b.node) AS source, greatest(a.node, b.node) AS target, count(*) AS weight, min(greatest(0, greatest(a.start_char, b.start_char) - least(a.end_char, b.end_char))) AS min_gap
    FROM {_LOC} a JOIN {_LOC} b ON a.doc_id = b.doc_id AND (a.start_char < b.start_char OR (a.start_char = b.start_char AND a.pred_id < b.pred_id)) AND a.node <> b.node
    WHERE greatest(0, greatest(a.start_char, b.start_char) - least(a.end_char, b.end_char)) <= 20 GROUP BY ALL)"""
_DEGREE = "k AS (SELECT node, sum(weight)::BIGINT AS degree FROM (SELECT source AS node, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY node)"


def _edges(spark, d):
    return G.cooccurrence_edges(t(spark, d, "predictions"), 20)


@query("graph_nodes", f"SELECT {_NODE} AS node, arg_min(text, pred_id) AS name, count(*) AS mentions, min(doc_id) AS first_doc FROM predictions WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY 1")
def graph_nodes(spark, d):
    return G.graph_nodes(t(spark, d, "predictions"))


@query("cooccurrence_edges", f"WITH {_EDGES} SELECT * FROM e")
def cooccurrence_edges(spark, d):
    return _edges(spark, d)


@query("graph_degrees", f"WITH {_EDGES}, {_DEGREE} SELECT * FROM k")
def graph_degrees(spark, d):
    return G.degrees(_edges(spark, d))


@query(
    "modularity",
    f"""WITH {_EDGES}, {_DEGREE}, m AS (SELECT sum(weight) AS m FROM e)
        SELECT round(sum((weight - a.degree * b.degree / (2.0 * m)) / (2.0 * m)), 9) AS modularity FROM e JOIN k a ON a.node = source JOIN k b ON b.node = target CROSS JOIN m
        WHERE split_part(source, ':', 1) = split_part(target, ':', 1)""",
)
def modularity(spark, d):
    e = _edges(spark, d)
    c = G.degrees(e).select("node", F.split_part("node", F.lit(":"), F.lit(1)).alias("community"))
    return G.modularity(e, c).select(F.round("modularity", 9).alias("modularity"))


@query("communities")
def communities(spark, d):
    return G.local_moving(_edges(spark, d))


@query("cypher_export", f"WITH n AS (SELECT {_NODE} AS node, arg_min(text, pred_id) AS name, count(*) AS mentions FROM predictions WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY 1) SELECT 'CREATE (n_' || regexp_replace(node, '[^A-Za-z0-9_]', '_', 'g') || ':Entity {{name: ''' || replace(replace(name, '\\', '\\\\'), '''', '\\''') || ''', mentions: ' || mentions || '}})' AS line FROM n".replace("{{", "{").replace("}}", "}"))
def cypher_export(spark, d):
    return G.cypher_nodes(G.graph_nodes(t(spark, d, "predictions")))


_JSON = "WITH n AS (SELECT " + _NODE + " AS node, arg_min(text, pred_id) AS name, count(*) AS mentions FROM predictions WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY 1)"


@query("node_link_export", f"{_JSON}, {_EDGES} SELECT 'node' AS kind, to_json({{'id': node, 'name': name, 'mentions': mentions}})::VARCHAR AS json FROM n UNION ALL SELECT 'edge', to_json({{'source': source, 'target': target, 'weight': weight}})::VARCHAR FROM e")
def node_link_export(spark, d):
    return G.node_link_json(G.graph_nodes(t(spark, d, "predictions")), _edges(spark, d))


@query("json_ld_export", f"{_JSON} SELECT to_json({{'@context': 'https://schema.org', '@id': node, '@type': 'Thing', 'name': name}})::VARCHAR AS json FROM n")
def json_ld_export(spark, d):
    return G.json_ld(G.graph_nodes(t(spark, d, "predictions")))


# Nodes by their knowledge-base id, their cluster of equal names of several mentions, or their label and text.
_MENTION_NODES = f"""k AS (SELECT lower(kb_name) AS k, min(kb_id) AS kb_id FROM kb_entities WHERE kb_name IS NOT NULL GROUP BY 1), c AS (SELECT pred_id, min(pred_id) OVER w AS cluster, count(*) OVER w AS n FROM predictions WHERE text IS NOT NULL AND label IS NOT NULL WINDOW w AS (PARTITION BY doc_id, label, lower(text))),
    mn AS (SELECT p.*, coalesce(k.kb_id::VARCHAR, CASE WHEN c.n > 1 THEN 'coref_' || c.cluster END, {_NODE}) AS node FROM predictions p JOIN c USING (pred_id) LEFT JOIN k ON k.k = lower(trim(p.text, ' ')))"""


def _mention_nodes(spark, d):
    p = t(spark, d, "predictions").where("text IS NOT NULL AND label IS NOT NULL")
    kb = t(spark, d, "kb_entities").where("kb_name IS NOT NULL").groupBy(F.lower("kb_name").alias("k")).agg(F.min("kb_id").alias("kb_id"))
    c = p.groupBy("doc_id", "label", F.lower("text").alias("t")).agg(F.min("pred_id").alias("cluster"), F.count(F.lit(1)).alias("n")).where("n > 1")
    p = p.withColumns({"k": F.lower(F.trim("text")), "t": F.lower("text")}).join(kb, "k", "left").join(c, ["doc_id", "label", "t"], "left")
    return p.withColumn("node", G.node_of(F.col("label"), F.col("text"), F.col("kb_id"), F.col("cluster")))


def _typed(spark, d):
    return G.typed_nodes(_mention_nodes(spark, d), F.col("node"))


_TYPED = "tn AS (SELECT node, arg_min(text, pred_id) AS name, arg_min(label, pred_id) AS node_type, count(*) AS mentions, min(doc_id) AS first_doc FROM mn GROUP BY node)"
_REL = f"rl AS (SELECT doc_id, head_id, tail_id, r.relation AS relation, r.confidence AS confidence FROM (SELECT *, {RQ._RULE} AS r FROM {RQ._both(RQ._pairs(RQ._LOC, 50))}) WHERE r IS NOT NULL), re AS (SELECT a.node AS source, b.node AS target, relation, max(rl.confidence) AS confidence, count(*) AS n FROM rl JOIN mn a ON a.pred_id = head_id JOIN mn b ON b.pred_id = tail_id WHERE a.node <> b.node GROUP BY ALL)"


def _relation_edges(spark, d):
    return G.relation_edges(RQ.relations(spark, d), _mention_nodes(spark, d))


@query("entity_nodes", f"WITH {_MENTION_NODES}, {_TYPED} SELECT * FROM tn")
def entity_nodes(spark, d):
    return _typed(spark, d)


@query("relation_edges", f"WITH {_MENTION_NODES}, {_REL} SELECT * FROM re")
def relation_edges(spark, d):
    return _relation_edges(spark, d)


_Q = "\x27\x27\x27\x27 || replace(replace({c}, '\\', '\\\\'), \x27\x27\x27\x27, '\\\x27\x27') || \x27\x27\x27\x27"
_ID = "regexp_replace({c}, '[^A-Za-z0-9_]', '_', 'g')"


@query(
    "cypher_graph",
    f"""WITH {_MENTION_NODES}, {_TYPED}, {_REL} SELECT 'node' AS kind, 'CREATE (n_' || {_ID.format(c='node')} || ':' || {_ID.format(c='node_type')} || ' {{id: ' || {_Q.format(c='node')} || ', name: ' || {_Q.format(c='name')} || '}})' AS line FROM tn
        UNION ALL SELECT 'edge', 'CREATE (n_' || {_ID.format(c='source')} || ')-[:' || upper({_ID.format(c='relation')}) || CASE WHEN confidence < 1 THEN ' {{confidence: ' || printf('%.3f', confidence) || '}}' ELSE '' END || ']->(n_' || {_ID.format(c='target')} || ')' FROM re""",
)
def cypher_graph(spark, d):
    return G.cypher(_typed(spark, d), _relation_edges(spark, d))


@query(
    "json_ld_graph",
    f"""WITH {_MENTION_NODES}, {_TYPED}, {_REL}, o AS (SELECT source AS node, list({{'@type': relation, '@id': target}} ORDER BY relation, target) AS relations FROM re GROUP BY source)
        SELECT CASE WHEN relations IS NULL THEN to_json({{'@context': 'https://schema.org', '@id': node, '@type': node_type, 'name': name}}) ELSE to_json({{'@context': 'https://schema.org', '@id': node, '@type': node_type, 'name': name, 'relations': relations}}) END::VARCHAR AS line FROM tn LEFT JOIN o USING (node)""",
)
def json_ld_graph(spark, d):
    return G.export(_typed(spark, d), _relation_edges(spark, d), "json_ld")


@query("community_hierarchy")
def community_hierarchy(spark, d):
    """Communities of the graph of nodes that stand near each other, at three resolutions."""
    return G.hierarchy(_edges(spark, d), 3)


_WORDS = "list_distinct(list_filter(string_split(lower({c}), ' '), lambda w: w <> ''))"
_NAMES = "(SELECT kb_id AS id, kb_name AS name, entity_type FROM kb_entities)"


def _names(spark, d):
    return t(spark, d, "kb_entities").select(F.col("kb_id").alias("id"), F.col("kb_name").alias("name"), "entity_type")


@query(
    "jaccard_pairs",
    f"""WITH w AS (SELECT id, entity_type, {_WORDS.format(c='name')} AS w FROM {_NAMES}), p AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.w, b.w)) AS c, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON a.id < b.id AND a.entity_type = b.entity_type AND list_has_any(a.w, b.w))
        SELECT left_id, right_id, round(c / (n - c)::DOUBLE, 6) AS similarity FROM p WHERE c / (n - c)::DOUBLE >= 0.5""",
)
def jaccard_pairs(spark, d):
    return R.jaccard_pairs(_names(spark, d), 0.5, block="entity_type").select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), F.round("similarity", 6).alias("similarity"))


@query(
    "minhash_candidates",
    f"""WITH g AS (SELECT id, list_distinct(CASE WHEN length(name) < 3 THEN [lower(name)] ELSE list_transform(range(1, length(name) - 1), lambda i: substring(lower(name), i, 3)) END) AS g FROM {_NAMES}),
        h AS (SELECT id, unnest(range(5)) AS b, g FROM g), s AS (SELECT id, b || '-' || list_min(list_transform(g, lambda x: substring(md5((b * 3) || ':' || x), 1, 15))) || '-' || list_min(list_transform(g, lambda x: substring(md5((b * 3 + 1) || ':' || x), 1, 15))) || '-' || list_min(list_transform(g, lambda x: substring(md5((b * 3 + 2) || ':' || x), 1, 15))) AS h FROM h)
        SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM s a JOIN s b ON a.h = b.h AND a.id < b.id""",
)
def minhash_candidates(spark, d):
    return R.minhash_candidates(_names(spark, d)).withColumnsRenamed({"left": "left_id", "right": "right_id"})


@query(
    "connected_identities",
    f"""WITH RECURSIVE w AS (SELECT id, name, entity_type, {_WORDS.format(c='name')} AS w FROM {_NAMES}), p AS (SELECT a.id AS l, b.id AS r FROM w a JOIN w b ON a.id <> b.id AND a.entity_type = b.entity_type AND list_has_any(a.w, b.w) AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE >= 0.7),
        c AS (SELECT id AS node, id AS root FROM w UNION SELECT p.r, c.root FROM c JOIN p ON p.l = c.node WHERE c.root < p.r), m AS (SELECT node, min(root) AS identity FROM c GROUP BY node)
        SELECT identity, count(*) AS n_mentions FROM m GROUP BY identity""",
)
def connected_identities(spark, d):
    n = _names(spark, d)
    return R.identities(n, R.jaccard_pairs(n, 0.7, block="entity_type"), "entity_type").select("identity", "n_mentions")


_MENTIONS = f"m AS (SELECT coalesce({LABEL}, '') AS label, lower(text) AS text, min(pred_id) AS id, count(*) AS copies FROM predictions WHERE text IS NOT NULL GROUP BY 1, 2)"
_MENTION_PAIRS = f"""x AS (SELECT id, label, unnest(w) AS x, len(w) AS n FROM (SELECT id, label, list_distinct(list_filter(regexp_split_to_array(text, '[{_S}]+'), lambda w: w <> '')) AS w FROM m)),
    p AS (SELECT a.id AS l, b.id AS r, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS similarity FROM x a JOIN x b ON a.label = b.label AND a.x = b.x AND a.id < b.id GROUP BY a.id, b.id)"""


def _mentions(spark, d, label=True):
    """(label, name, id, copies): equal mentions of all documents stand as one, so that a hot name is one row."""
    p = t(spark, d, "predictions").where("text IS NOT NULL")
    kind = F.coalesce(canonical_label(F.col("label")), F.lit("")) if label else F.lit("")
    return p.groupBy(kind.alias("label"), F.lower("text").alias("name")).agg(F.min("pred_id").alias("id"), F.count(F.lit(1)).alias("copies"))


def _links(pairs, mentions):
    n = mentions.select("id", "copies")
    j = pairs.join(n.withColumnsRenamed({"id": "left", "copies": "a"}), "left").join(n.withColumnsRenamed({"id": "right", "copies": "b"}), "right")
    return j.withColumn("links", F.col("a") * F.col("b")).drop("a", "b").withColumnsRenamed({"left": "left_id", "right": "right_id"})


@query("mention_jaccard_pairs", f"WITH {_MENTIONS}, {_MENTION_PAIRS} SELECT l AS left_id, r AS right_id, round(similarity, 6) AS similarity, a.copies * b.copies AS links FROM p JOIN m a ON a.id = l JOIN m b ON b.id = r WHERE similarity >= 0.5")
def mention_jaccard_pairs(spark, d):
    """Pairs between representatives (the least pred_id) of equal mentions, with the number of links that they stand for."""
    m = _mentions(spark, d)
    return _links(R.jaccard_pairs(m, 0.5, block="label").drop("links"), m).withColumn("similarity", F.round("similarity", 6))


@query(
    "mention_candidates",
    """WITH m AS (SELECT lower(text) AS text, min(pred_id) AS id, count(*) AS copies FROM predictions WHERE text IS NOT NULL GROUP BY 1),
        g AS (SELECT id, list_distinct(CASE WHEN length(text) < 3 THEN [text] ELSE list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)) END) AS g FROM m),
        h AS (SELECT id, unnest(range(5)) AS b, g FROM g), s AS (SELECT id, b || '-' || list_min(list_transform(g, lambda x: substring(md5((b * 3) || ':' || x), 1, 15))) || '-' || list_min(list_transform(g, lambda x: substring(md5((b * 3 + 1) || ':' || x), 1, 15))) || '-' || list_min(list_transform(g, lambda x: substring(md5((b * 3 + 2) || ':' || x), 1, 15))) AS h FROM h),
        p AS (SELECT DISTINCT a.id AS l, b.id AS r FROM s a JOIN s b ON a.h = b.h AND a.id < b.id)
        SELECT l AS left_id, r AS right_id, a.copies * b.copies AS links FROM p JOIN m a ON a.id = l JOIN m b ON b.id = r""",
)
def mention_candidates(spark, d):
    """As mention_jaccard_pairs; candidates heed no label."""
    m = _mentions(spark, d, label=False)
    return _links(R.minhash_candidates(m), m)


def _identities(spark, d):
    """(label, name, copies, identity) of every representative."""
    m = _mentions(spark, d)
    pairs = R.jaccard_pairs(m, 0.7, block="label").select(F.col("left").alias("source"), F.col("right").alias("target"))
    c = G.components(pairs, m.select(F.col("id").alias("node")))
    return m.join(c.withColumnsRenamed({"node": "id", "component": "identity"}), "id")


_MENTION_IDENTITIES = f"""{_MENTIONS}, {_MENTION_PAIRS}, e AS (SELECT l, r FROM p WHERE similarity >= 0.7 UNION ALL SELECT r, l FROM p WHERE similarity >= 0.7),
    c AS (SELECT id AS node, id AS root FROM m UNION SELECT e.r, c.root FROM c JOIN e ON e.l = c.node WHERE c.root < e.r), i AS (SELECT node, min(root) AS identity FROM c GROUP BY node)"""


@query("mention_identities", f"WITH RECURSIVE {_MENTION_IDENTITIES} SELECT pred_id, identity FROM predictions q JOIN m ON m.label = coalesce({LABEL.replace('label', 'q.label')}, '') AND m.text = lower(q.text) JOIN i ON i.node = m.id")
def mention_identities(spark, d):
    """The identity of every mention of all documents."""
    p = t(spark, d, "predictions").where("text IS NOT NULL").select("pred_id", F.coalesce(canonical_label(F.col("label")), F.lit("")).alias("label"), F.lower("text").alias("name"))
    return p.join(_identities(spark, d).select("label", "name", "identity"), ["label", "name"]).select("pred_id", "identity")


@query("mention_clusters", f"WITH RECURSIVE {_MENTION_IDENTITIES} SELECT identity, sum(copies)::BIGINT AS n_mentions, count(*) AS n_names FROM m JOIN i ON i.node = m.id GROUP BY 1")
def mention_clusters(spark, d):
    return _identities(spark, d).groupBy("identity").agg(F.sum("copies").alias("n_mentions"), F.count(F.lit(1)).alias("n_names"))
