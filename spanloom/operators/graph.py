"""Entity graphs: nodes, co-occurrence edges, modularity, communities, components, exports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import spans as S


def node_id(label: Column, text: Column) -> Column:
    """`label:text` in lower case, blanks as underscores."""
    return F.concat_ws(":", F.lower(label), F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("_")))


def node_of(label: Column, text: Column, kb_id: Column, cluster: Column) -> Column:
    """The node of a mention: its knowledge-base id, or else `coref_` and its cluster, or else its label and text."""
    return F.coalesce(kb_id.cast("string"), F.concat(F.lit("coref_"), cluster.cast("string")), node_id(label, text))


def graph_nodes(spans: DataFrame, node: Column | None = None) -> DataFrame:
    """(node, name, mentions, first_doc): one row a node; the name is the spelling of its first mention."""
    s = spans.where(F.col("text").isNotNull() & F.col("label").isNotNull()).withColumn("node", node_id(F.col("label"), F.col("text")) if node is None else node)
    return s.groupBy("node").agg(F.min_by("text", "pred_id").alias("name"), F.count(F.lit(1)).alias("mentions"), F.min("doc_id").alias("first_doc"))


def typed_nodes(spans: DataFrame, node: Column) -> DataFrame:
    """The same with the label of the first mention as node_type."""
    s = spans.where(F.col("text").isNotNull() & F.col("label").isNotNull()).withColumn("node", node)
    return s.groupBy("node").agg(F.min_by("text", "pred_id").alias("name"), F.min_by("label", "pred_id").alias("node_type"), F.count(F.lit(1)).alias("mentions"), F.min("doc_id").alias("first_doc"))


def relation_edges(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """(source, target, relation, confidence, n): relations (head_id, tail_id, relation, confidence) between the nodes of their
    mentions (pred_id, node), both of which must be there; the surest counts, n is how many say so. A node has no relation
    with itself."""
    m = mentions.select("pred_id", "node").where("node IS NOT NULL")
    j = relations.join(m.withColumnsRenamed({"pred_id": "head_id", "node": "source"}), "head_id").join(m.withColumnsRenamed({"pred_id": "tail_id", "node": "target"}), "tail_id").where("source <> target")
    return j.groupBy("source", "target", "relation").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))


def cooccurrence_edges(spans: DataFrame, max_gap: int) -> DataFrame:
    """(source, target, weight, min_gap): nodes mentioned at most max_gap characters apart, source < target, no loops."""
    s = spans.where(F.col("text").isNotNull() & F.col("label").isNotNull())
    nodes = s.select("pred_id", node_id(F.col("label"), F.col("text")).alias("node"))
    pairs = S.proximity_pairs(s, max_gap)
    j = pairs.join(nodes.withColumnsRenamed({"pred_id": "left", "node": "a"}), "left").join(nodes.withColumnsRenamed({"pred_id": "right", "node": "b"}), "right").where("a <> b")
    return j.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.count(F.lit(1)).alias("weight"), F.min("gap").alias("min_gap"))


def degrees(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(node, degree): the sum of weights of a node's edges."""
    both = edges.select(F.col("source").alias("node"), F.col(weight).alias("w")).unionByName(edges.select(F.col("target").alias("node"), F.col(weight).alias("w")))
    return both.groupBy("node").agg(F.sum("w").alias("degree"))


def modularity(edges: DataFrame, communities: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(modularity): the sum over edges inside a community of (w - gamma k_a k_b / 2m) / 2m; edges only, 0 without any."""
    k = degrees(edges)
    total = edges.agg(F.sum("weight").alias("m"))
    c = communities.select("node", "community")
    j = (
        edges.join(k.withColumnsRenamed({"node": "source", "degree": "ka"}), "source").join(k.withColumnsRenamed({"node": "target", "degree": "kb"}), "target")
        .join(c.withColumnsRenamed({"node": "source", "community": "ca"}), "source").join(c.withColumnsRenamed({"node": "target", "community": "cb"}), "target")
        .where("ca = cb").join(total)  # one row
    )
    return j.agg(F.coalesce(F.sum((F.col("weight") - gamma * F.col("ka") * F.col("kb") / (2 * F.col("m"))) / (2 * F.col("m"))), F.lit(0.0)).alias("modularity"))


def _both_ways(edges: DataFrame, *carried: str) -> DataFrame:
    a = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), *carried)
    return a.unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), *carried))


def components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node of each connected component, by label spreading with pointer jumping.

    Every round is written to the shared folder, and its changes are counted while it is written; rounds follow the
    logarithm of the longest path."""
    scratch = Scratch(edges.sparkSession, "components")
    both, both_path = scratch.write(_both_ways(edges).distinct())
    labels, path = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = new.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("cc", "c")).alias("component"))
        written, new_path, changed = scratch.write_counting(new, F.col("old") != F.col("component"))
        scratch.drop(path)
        labels, path = written.select("node", "component"), new_path
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    scratch.drop(both_path)
    if nodes is None:
        return labels
    return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Edges of a block of nodes, which one task moves; a larger graph is as many blocks as it takes.
BLOCK_EDGES = 3_000_000
EDGE, OWN, NEAR, SUM = range(4)  # kinds of rows of a block: (a, b, weight), (node, community, degree) twice, (community, -, degree)


def _moved(rows: Iterator[pd.DataFrame], rate: float, max_sweeps: int, least_gain: float, fresh: int) -> Iterator[pd.DataFrame]:
    """(id, community, k, moved, open) of the OWN nodes of a block, moved one after another until none gains; `open` if some
    still may after max_sweeps. A node that leaves to be alone gets a number from `fresh` downwards. Without SUM rows all
    members of all communities are here.

    After a first sweep only nodes beside one that moved are looked at; when none is left, all are looked at once more."""
    parts = [(r["kind"].to_numpy("int8"), r["a"].to_numpy("int64"), r["b"].to_numpy("int64"), r["w"].to_numpy("float64")) for r in rows]
    if not parts:
        return
    kind, a, b, w = (np.concatenate(x) for x in zip(*parts))
    del parts
    placed = (kind == OWN) | (kind == NEAR)
    order = np.argsort(a[placed], kind="stable")
    ids, community, degree, own = a[placed][order], b[placed][order], w[placed][order], (kind[placed] == OWN)[order]
    numbers, label = np.unique(community, return_inverse=True)
    sums = np.bincount(label, degree, minlength=len(numbers))
    if (kind == SUM).any():
        sums[np.searchsorted(numbers, a[kind == SUM])] = w[kind == SUM]
    edge = (kind == EDGE) & (a != b)
    left, right, w = np.searchsorted(ids, a[edge]).astype("int32"), np.searchsorted(ids, b[edge]).astype("int32"), w[edge]
    del a, b, kind, edge, placed
    ends, near, weight = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([w, w])
    if not own.all():
        mine = own[ends]
        ends, near, weight = ends[mine], near[mine], weight[mine]
    order = np.argsort(ends, kind="stable")
    start, near, weight = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=len(ids)))]).tolist(), near[order], weight[order]
    del left, right, w, ends, order
    c, s, k = label.tolist(), sums.tolist(), degree.tolist()
    turn = np.random.default_rng(0).permutation(np.flatnonzero(own)).tolist()
    dirty, everyone, settled = bytearray(len(ids)), True, False
    for _ in range(max_sweeps):
        moves = 0
        for v in turn:
            if not (everyone or dirty[v]):
                continue
            dirty[v] = 0
            beside, links = near[start[v] : start[v + 1]].tolist(), {}
            for u, x in zip(beside, weight[start[v] : start[v + 1]].tolist()):
                links[c[u]] = links.get(c[u], 0.0) + x
            # What a community is worth to a node: the links to it less what chance would give, without the node itself.
            here, chance = c[v], rate * k[v]
            stay = links.pop(here, 0.0) - chance * (s[here] - k[v])
            best, most = None, stay + least_gain
            for to, x in links.items():
                worth = x - chance * s[to]
                if worth > most or (worth == most and best is not None and to < best):
                    best, most = to, worth
            if most < 0:  # a community of its own is worth 0: a node that is better off alone leaves
                best = len(s)
                s.append(0.0)
            if best is None:
                continue
            moves += 1
            s[here] -= k[v]
            s[best] += k[v]
            c[v] = best
            for u in beside:
                if c[u] != best:
                    dirty[u] = 1
        settled = everyone and not moves
        if settled:
            break
        everyone = not moves
    now = np.array(c)
    numbers = np.concatenate([numbers, fresh - np.arange(len(s) - len(numbers))])
    yield pd.DataFrame({"id": ids, "community": numbers[now], "k": degree, "moved": now != label, "open": not settled})[own]


def _settled(edges: DataFrame, gammas: list[float], max_sweeps: int, least_gain: float, block_edges: int) -> tuple[DataFrame, DataFrame]:
    """(node, id) and (level, id, community): communities at each resolution, as `local_moving`, over the same numbered graph. A
    community is numbered by its smallest node; numbers follow the order of the names."""
    scratch = Scratch(edges.sparkSession, "communities")
    w = F.coalesce(F.sum("weight").cast("double"), F.lit(0.0)).alias("weight")
    e = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(w)
    e, e_path, n_edges = scratch.write_counting(e, F.lit(True))
    nodes, _ = scratch.write(degrees(e).withColumnRenamed("degree", "k").orderBy("node").withColumn("id", F.monotonically_increasing_id()))
    number = nodes.select("node", "id")
    arcs, arcs_path = scratch.write(e.join(number.withColumnsRenamed({"node": "source", "id": "a"}), "source").join(number.withColumnsRenamed({"node": "target", "id": "b"}), "target").select("a", "b", "weight"))
    scratch.drop(e_path)
    total = nodes.agg(F.sum("k")).first()[0] or 1.0  # twice the weight of all edges
    n_blocks = 1 if n_edges <= block_edges else -(-2 * n_edges // block_edges)  # an edge between two blocks is in both
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks))
    row = lambda df, kind, a, b, x: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(x).alias("w"))
    start = nodes.select("id", F.col("id").alias("community"), "k")
    state = [[start.where(block("id") == i) for i in range(n_blocks)] for _ in gammas]
    held: list[list[str | None]] = [[None] * n_blocks for _ in gammas]  # the table that each of them reads

    def rows(level: int, i: int) -> DataFrame:
        if n_blocks == 1:
            return row(arcs, EDGE, "a", "b", "weight").unionByName(row(state[level][0], OWN, "id", "community", "k")).coalesce(1)
        labels = reduce(DataFrame.unionByName, state[level])
        near_by = arcs.where((block("a") == i) | (block("b") == i))
        beside = near_by.select(F.explode(F.array("a", "b")).alias("id")).where(block("id") != i).distinct()
        own, near = state[level][i], labels.join(beside, "id", "left_semi")
        sums = labels.join(own.unionByName(near).select("community").distinct(), "community", "left_semi").groupBy("community").agg(F.sum("k").alias("k"))
        kinds = [row(near_by, EDGE, "a", "b", "weight"), row(own, OWN, "id", "community", "k"), row(near, NEAR, "id", "community", "k"), row(sums, SUM, "community", "community", "k")]
        return reduce(DataFrame.unionByName, kinds).repartition(1)

    going, job = list(range(len(gammas))), 0
    for _ in range(max_sweeps):
        unsettled = set()
        for i in range(n_blocks):
            job += 1
            new = [rows(n, i).mapInPandas(partial(_moved, rate=gammas[n] / total, max_sweeps=max_sweeps, least_gain=least_gain, fresh=-1 - (job << 32)), "id long, community long, k double, moved boolean, open boolean").withColumn("level", F.lit(n)) for n in going]
            # Alone, a block has settled when no node in it gains; beside others, when a whole pass moves nothing.
            written, path, n_open = scratch.write_counting(reduce(DataFrame.unionByName, new), F.col("open") if n_blocks == 1 else F.col("open") | F.col("moved"))
            if n_open:
                unsettled |= {r.level for r in written.where("open OR moved").select("level").distinct().collect()}
            before = {h[i] for h in held} - {None}
            for n in going:
                state[n][i], held[n][i] = written.where(F.col("level") == n).select("id", "community", "k"), path
            for superseded in before - {h[i] for h in held}:
                scratch.drop(superseded)
        if not unsettled or n_blocks == 1:
            going = sorted(unsettled)
            break
        going = sorted(unsettled)
    if going:
        raise RuntimeError(f"communities did not settle within {max_sweeps} sweeps")
    scratch.drop(arcs_path)
    labels = reduce(DataFrame.unionByName, [reduce(DataFrame.unionByName, s).withColumn("level", F.lit(n)) for n, s in enumerate(state)])
    name = labels.groupBy("level", "community").agg(F.min("id").alias("name"))
    return number, labels.join(name, ["level", "community"]).select("level", "id", F.col("name").alias("community"))


def local_moving(edges: DataFrame, gamma: float = 1.0, max_sweeps: int = 100, least_gain: float = 1e-9, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(node, community): communities of (source, target, weight) by local moving on the modularity with resolution gamma,
    each node from a community of its own.

    Nodes move one after another, so every move raises the modularity and it must settle; nodes that move at once may
    overfill the community that they join, and go back and forth for ever though none is beside another. One task moves a
    block of nodes that have at most about block_edges edges, the other blocks standing still; a graph of several blocks
    is gone through until a whole pass moves nothing. It settles when no node gains; to stop before that is an error, not a
    result. Ties go to the smallest community, and a community is named by its smallest node. Self-loops count for
    degrees only."""
    return _named(*_settled(edges, [gamma], max_sweeps, least_gain, block_edges), ["community"])


def _named(nodes: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    out = labels.groupBy("id").agg(*[F.max(F.when(F.col("level") == n, F.col("community"))).alias(c) for n, c in enumerate(columns)])
    out = out.join(nodes, "id").drop("id")
    for c in columns:
        out = out.join(nodes.select(F.col("id").alias(c), F.col("node").alias(f"{c}_name")), c).drop(c).withColumnRenamed(f"{c}_name", c)
    return out.select("node", *columns)


def hierarchy(edges: DataFrame, levels: int = 3, gamma: float = 1.0, max_sweeps: int = 100, least_gain: float = 1e-9, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(node, level_0_community, level_1_community, ...): communities at resolutions gamma, 2 gamma, 4 gamma, ..., each from
    the whole graph anew; the graph is made and numbered once."""
    return _named(*_settled(edges, [gamma * 2**n for n in range(levels)], max_sweeps, least_gain, block_edges), [f"level_{n}_community" for n in range(levels)])


# --- exports: one row a line, so that a graph of any size is written by all tasks --------------------------


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _identifier(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def _one_less(c: Column) -> Column:
    """A confidence below 1 with three digits, else null."""
    return F.when(c < 1, F.format_string("%.3f", c))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    """(line): CREATE statements; backslashes and quotes are escaped, the identifier keeps letters, digits and underscores."""
    return nodes.select(F.concat(F.lit("CREATE (n_"), _identifier(F.col("node")), F.lit(":Entity {name: "), _quoted(F.col("name")), F.lit(", mentions: "), F.col("mentions").cast("string"), F.lit("})")).alias("line"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, line): nodes (node, name, node_type) and edges (source, target, relation, confidence); the confidence of an edge is
    said only if it is below 1."""
    n = nodes.select(F.lit("node").alias("kind"), F.concat(F.lit("CREATE (n_"), _identifier(F.col("node")), F.lit(":"), _identifier(F.coalesce("node_type", F.lit("Entity"))), F.lit(" {id: "), _quoted(F.col("node")), F.lit(", name: "), _quoted(F.col("name")), F.lit("})")).alias("line"))
    sure = F.coalesce(F.concat(F.lit(" {confidence: "), _one_less(F.col("confidence")), F.lit("}")), F.lit(""))
    e = edges.select(F.lit("edge").alias("kind"), F.concat(F.lit("CREATE (n_"), _identifier(F.col("source")), F.lit(")-[:"), F.upper(_identifier(F.col("relation"))), sure, F.lit("]->(n_"), _identifier(F.col("target")), F.lit(")")).alias("line"))
    return n.unionByName(e)


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): one JSON object a node and an edge, to be written as lines; the whole graph never meets in one place. An
    edge says its relation and confidence where it has them, the confidence only below 1."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("node").alias("id"), "name", "mentions")).alias("json"))
    own = ["source", "target", *[c for c in ("relation", "weight") if c in edges.columns]]
    sure = [F.when(F.col("confidence") < 1, F.col("confidence")).alias("confidence")] if "confidence" in edges.columns else []
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*own, *sure)).alias("json")))


def json_ld(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(json): one JSON-LD object a node, with the edges that leave it as `relations`, sorted."""
    n = nodes.withColumn("__type", F.col("node_type") if "node_type" in nodes.columns else F.lit("Thing"))
    fields = [F.lit("https://schema.org").alias("@context"), F.col("node").alias("@id"), F.coalesce("__type", F.lit("Thing")).alias("@type"), F.col("name")]
    if edges is not None:
        out = F.sort_array(F.collect_list(F.struct(F.col("relation").alias("@type"), F.col("target").alias("@id"))))
        n = n.join(edges.groupBy(F.col("source").alias("node")).agg(out.alias("relations")), "node", "left")
        fields.append(F.col("relations"))
    return n.select(F.to_json(F.struct(*fields)).alias("json"))


EXPORTS = {
    "cypher": lambda nodes, edges: cypher(nodes, edges).select("line"),
    "node_link": lambda nodes, edges: node_link_json(nodes, edges).select(F.col("json").alias("line")),
    "json_ld": lambda nodes, edges: json_ld(nodes, edges).select(F.col("json").alias("line")),
}


def export(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """(line) in one of EXPORTS."""
    if form not in EXPORTS:
        raise ValueError(f"{form}: one of {', '.join(EXPORTS)}")
    return EXPORTS[form](nodes, edges)
