"""Problem 4: one group identifier for all records linked directly or through others.

Method: randomised contraction. In each round every vertex hooks to the member of its closed neighbourhood
that comes first in a fresh hash order, edges are relabelled and made distinct, and vertices left without
an edge drop out. About a third or more of the vertices go in each round, whatever the shape (a chain of n
links takes O(log n) rounds, a star one). The mappings of the rounds are then expanded from the last to the
first, each a join over geometrically fewer rows.

Everything stays in the cluster: no edge, component or label reaches the driver. Each round is a written
table in the shared folder (`session.Scratch`), so executors may be lost; its edges are counted while they are written. A hub of very high degree is one
aggregation key, pre-aggregated map-side by `min`, and one join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

MAX_ROUNDS = 200


def _order(v: Column, round_no: int) -> Column:
    return F.xxhash64(v, F.lit(round_no * 2654435761 % 2147483647))


def links(match_pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct links of judged pairs. Rows with a null end, of a record with itself or
    without `matched` true are no links, whatever other rows say about the pair."""
    m = match_pairs.where(F.col("matched") & F.col("left_id").isNotNull() & F.col("right_id").isNotNull() & (F.col("left_id") != F.col("right_id")))
    return m.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).distinct()


def connected_groups(edges: DataFrame) -> DataFrame:
    """(record_id, group_id) for every vertex of `edges` (a, b); group_id is the smallest vertex of the group.

    Empty edges give an empty result; repeated edges, either order and self-loops are allowed."""
    spark = edges.sparkSession
    scratch = Scratch(spark, "groups")
    e, e_path, n_edges = scratch.write_counting(edges.select("a", "b").where(F.col("a") != F.col("b")), F.lit(True))
    maps: list[tuple[DataFrame, str]] = []
    for n in range(MAX_ROUNDS):
        if not n_edges:
            scratch.drop(e_path)
            break
        both = e.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("w")))
        # min over (hash, id) of the neighbours, then of the vertex itself: partial aggregation before the shuffle
        best = both.groupBy("v").agg(F.min(F.struct(_order(F.col("w"), n).alias("h"), F.col("w").alias("r"))).alias("m"))
        own = F.struct(_order(F.col("v"), n).alias("h"), F.col("v").alias("r"))
        hook, path = scratch.write(best.select("v", F.least(F.col("m"), own)["r"].alias("r")))
        maps.append((hook, path))
        a = hook.select(F.col("v").alias("a"), F.col("r").alias("ra"))
        b = hook.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        new = (
            e.join(a, "a").join(b, "b").where(F.col("ra") != F.col("rb"))
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        nxt, nxt_path, n_edges = scratch.write_counting(new, F.lit(True))
        scratch.drop(e_path)
        e, e_path = nxt, nxt_path
    else:
        raise RuntimeError(f"contraction did not end within {MAX_ROUNDS} rounds")
    if not maps:
        return edges.select(F.col("a").alias("record_id"), F.col("b").alias("group_id")).limit(0)
    # Expand: the root of a vertex is the root of the vertex it hooked to; vertices that did not survive to the
    # next round are their own roots.
    roots, roots_path = maps[-1]
    for hook, path in reversed(maps[:-1]):
        nxt = hook.join(roots.select(F.col("v").alias("r"), F.col("r").alias("rr")), "r", "left").select("v", F.coalesce("rr", "r").alias("r"))
        written, written_path = scratch.write(nxt)
        scratch.drop(roots_path)
        scratch.drop(path)
        roots, roots_path = written, written_path
    smallest = roots.groupBy("r").agg(F.min("v").alias("group_id"))
    return roots.join(smallest, "r").select(F.col("v").alias("record_id"), "group_id")


def grouped_records(match_pairs: DataFrame) -> DataFrame:
    """(group_id, record_id): the members of each group but its smallest."""
    return connected_groups(links(match_pairs)).where(F.col("record_id") != F.col("group_id")).select("group_id", "record_id")


def group_entities(match_pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """(pred_id, group_id): every entity; one without links is its own group."""
    g = connected_groups(links(match_pairs))
    return predictions.select("pred_id").join(g.withColumnRenamed("record_id", "pred_id"), "pred_id", "left").select("pred_id", F.coalesce("group_id", "pred_id").alias("group_id"))
