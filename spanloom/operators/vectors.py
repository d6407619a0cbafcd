"""Vectors: similarity, sign hashes, boxes, inside the JVM; searches as products of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """0 if the lengths differ."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))).otherwise(F.lit(0.0))


def sign_words(a: Column, dimensions: int) -> Column:
    """Sign bits packed into 32-bit words as array<bigint>: bit i is 1 if the value is positive."""
    words = []
    for k in range(0, dimensions, 32):
        words.append(F.aggregate(F.slice(F.transform(a, lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i % 32).cast("long")).otherwise(F.lit(0).cast("long"))), k + 1, 32), F.lit(0).cast("long"), lambda s, x: s + x))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


BLOCK_ROWS = 1024  # vectors a block of the blocked search: some megabytes at a few thousand dimensions
V_SLOTS, Q_SLOTS = 64, 8
_PACKED = "g {kind}, block bigint, ids array<bigint>, width int, packed binary"


def _blocks(vectors: DataFrame, key: str, column: str, group: str | None = None) -> DataFrame:
    """(g, block, ids, width, packed): vectors of equal width, and group where given, up to BLOCK_ROWS of a partition as one matrix.
    Null vectors, and vectors that hold nulls, are in no block."""
    kind = vectors.schema[group].dataType.simpleString() if group else "int"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(width=b["v"].map(len))
            for (of, width), g in b.groupby(["g", "width"], dropna=False):
                for k in range(0, len(g), BLOCK_ROWS):
                    part = g.iloc[k : k + BLOCK_ROWS]
                    m = np.array(part["v"].tolist(), np.float64).reshape(len(part), width)
                    yield pd.DataFrame({"g": [of], "block": [int(part["k"].iloc[0])], "ids": [part["k"].to_numpy(np.int64)], "width": [width], "packed": [m.tobytes()]})

    v = vectors.where(F.col(column).isNotNull() & ~F.coalesce(F.exists(F.col(column), lambda x: x.isNull()), F.lit(False)))
    return v.select((F.col(group) if group else F.lit(0)).alias("g"), F.col(key).cast("long").alias("k"), F.col(column).alias("v")).mapInPandas(pack, _PACKED.format(kind=kind))


def _blocked_search(vectors: DataFrame, queries: DataFrame, k: int, key: str, column: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, neighbour_id, score, rank). Blocks of vectors meet blocks of queries of the same width, each pair of blocks
    is one matrix product and leaves the best k of every query in it, and the best of these are ranked. Any number of
    queries is allowed: nothing is collected, and a block of queries is joined, not held whole. A score of -inf is no result."""
    v = _blocks(vectors, key, column).drop("g")
    q = _blocks(queries, key, column).drop("g").withColumnsRenamed({"block": "q_block", "ids": "q_ids", "packed": "q_packed"})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, packed, q_ids, q_packed, width in zip(b["ids"], b["packed"], b["q_ids"], b["q_packed"], b["width"]):
                ids, q_ids = np.asarray(ids), np.asarray(q_ids)
                s = score(np.frombuffer(q_packed).reshape(len(q_ids), width), np.frombuffer(packed).reshape(len(ids), width))
                s = np.where(q_ids[:, None] == ids[None, :], -np.inf, s)
                order = np.argsort(ids, kind="stable")
                s, ids = np.round(s[:, order], 12), ids[order]
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows, found = np.repeat(np.arange(len(q_ids)), top.shape[1]), top.ravel()
                got = s[rows, found]
                keep = np.isfinite(got)
                yield pd.DataFrame({"query_id": q_ids[rows[keep]], "neighbour_id": ids[found[keep]], "score": got[keep]})

    # A grid of slots: every block of vectors meets every block of queries once, in one of V_SLOTS x Q_SLOTS keys.
    v = v.withColumns({"v_slot": F.pmod(F.xxhash64("block"), F.lit(V_SLOTS)), "q_slot": F.explode(F.sequence(F.lit(0), F.lit(Q_SLOTS - 1)))})
    q = q.withColumns({"q_slot": F.pmod(F.xxhash64("q_block"), F.lit(Q_SLOTS)).cast("int"), "v_slot": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(V_SLOTS - 1).cast("long")))})
    pairs = v.join(q, ["width", "v_slot", "q_slot"]).select("ids", "packed", "q_ids", "q_packed", "width")
    found = pairs.mapInPandas(best, "query_id bigint, neighbour_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", max_hamming: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, similarity, rank): the k nearest by cosine of each query, itself apart; exact, by blocks.
    A vector of norm 0 has similarity 0 to all; vectors of another width are no neighbours.

    With max_hamming only vectors whose sign hash (1 where a value is positive) differs in at most so many bits count."""

    def score(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
        s = np.divide(q @ v.T, n, out=np.zeros(n.shape), where=n > 0)
        if max_hamming is not None:
            a, b = np.where(q > 0, 1.0, -1.0), np.where(v > 0, 1.0, -1.0)
            s = np.where((q.shape[1] - a @ b.T) / 2 <= max_hamming + 1e-9, s, -np.inf)
        return s

    return _blocked_search(vectors, queries, k, key, column, score).withColumnRenamed("score", "similarity")


def cosine_pairs(vectors: DataFrame, least: float, key: str = "vec_id", column: str = "embedding", block: str | None = None) -> DataFrame:
    """(left, right, cosine): pairs of vectors with a cosine of at least `least`, left < right; exact, by blocks, of one value of
    `block` where given. Equal vectors stand as one, the smallest key; a vector of norm 0 has no partner."""
    g = F.col(block) if block else F.lit(0)
    one = vectors.where(F.col(column).isNotNull()).groupBy(g.alias("g"), F.col(column).alias("v")).agg(F.min(key).alias("k"))
    v = _blocks(one, "k", "v", "g")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, packed, q_ids, q_packed, width in zip(b["ids"], b["packed"], b["q_ids"], b["q_packed"], b["width"]):
                ids, q_ids = np.asarray(ids), np.asarray(q_ids)
                x, y = np.frombuffer(q_packed).reshape(len(q_ids), width), np.frombuffer(packed).reshape(len(ids), width)
                n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
                s = np.round(np.divide(x @ y.T, n, out=np.full(n.shape, -np.inf), where=n > 0), 12)
                i, j = np.nonzero((s >= least) & (q_ids[:, None] < ids[None, :]))
                yield pd.DataFrame({"left": q_ids[i], "right": ids[j], "cosine": s[i, j]})

    q = v.withColumnsRenamed({"block": "q_block", "ids": "q_ids", "packed": "q_packed"})
    v = v.withColumns({"v_slot": F.pmod(F.xxhash64("block"), F.lit(V_SLOTS)), "q_slot": F.explode(F.sequence(F.lit(0), F.lit(Q_SLOTS - 1)))})
    q = q.withColumns({"q_slot": F.pmod(F.xxhash64("q_block"), F.lit(Q_SLOTS)).cast("int"), "v_slot": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(V_SLOTS - 1).cast("long")))})
    pairs = v.join(q, ["g", "width", "v_slot", "q_slot"]).select("ids", "packed", "q_ids", "q_packed", "width")
    return pairs.mapInPandas(near, "left bigint, right bigint, cosine double")


def max_sim(queries: Column, tokens: Column) -> Column:
    """Late interaction: for each query vector the largest dot product with a token vector, summed; 0 without either."""
    best = F.transform(queries, lambda q: F.coalesce(F.array_max(F.transform(tokens, lambda t: dot(q, t))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


# --- boxes: two arrays, low and high ----------------------------------------------------------------


def box_around(v: Column, radius: float) -> tuple[Column, Column]:
    return F.transform(v, lambda x: x.cast("double") - radius), F.transform(v, lambda x: x.cast("double") + radius)


def volume(low: Column, high: Column) -> Column:
    return F.aggregate(F.zip_with(low, high, lambda a, b: F.greatest(F.lit(0.0), b - a)), F.lit(1.0), lambda s, x: s * x)


def intersection(l1: Column, h1: Column, l2: Column, h2: Column) -> Column:
    return volume(F.zip_with(l1, l2, lambda a, b: F.greatest(a, b)), F.zip_with(h1, h2, lambda a, b: F.least(a, b)))


def conditional(l1: Column, h1: Column, l2: Column, h2: Column) -> Column:
    """P(first given second): the common part over the second's volume; 0 if that is 0."""
    v = volume(l2, h2)
    return F.when(v > 0, intersection(l1, h1, l2, h2) / v).otherwise(F.lit(0.0))


def box_coref(l1: Column, h1: Column, l2: Column, h2: Column) -> Column:
    return (conditional(l1, h1, l2, h2) + conditional(l2, h2, l1, h1)) / 2


def box_contains(l1: Column, h1: Column, l2: Column, h2: Column) -> Column:
    """Whether the first box lies within the second."""
    return F.forall(F.zip_with(l1, l2, lambda a, b: b <= a), lambda x: x) & F.forall(F.zip_with(h1, h2, lambda a, b: a <= b), lambda x: x)


def box_disjoint(l1: Column, h1: Column, l2: Column, h2: Column) -> Column:
    return intersection(l1, h1, l2, h2) == 0


def box_centre(low: Column, high: Column) -> Column:
    return F.zip_with(low, high, lambda a, b: (a + b) / 2)


def box_size(low: Column, high: Column) -> Column:
    return F.zip_with(low, high, lambda a, b: F.greatest(F.lit(0.0), b - a))


def adaptive_box(v: Column, factor: float) -> tuple[Column, Column]:
    """A box around a vector whose radius is its norm times a factor, and 0.01."""
    r = norm(v) * factor + 0.01
    return F.transform(v, lambda x: x.cast("double") - r), F.transform(v, lambda x: x.cast("double") + r)


def box_search(vectors: DataFrame, queries: DataFrame, k: int, radius: float, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, neighbour_id, score, rank): the k vectors whose boxes overlap most with that of each query, itself
    apart; a box that does not overlap never comes out. By blocks, as `search`."""

    def score(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        # Boxes of one radius: in each dimension they share 2 radius - |difference| of 2 radius, so both conditionals are alike.
        out = np.empty((len(q), len(v)))
        for i, x in enumerate(q):
            share = np.maximum(0.0, 2 * radius - np.abs(v - x)) / (2 * radius) if radius > 0 else np.zeros(v.shape)
            out[i] = share.prod(axis=1)
        return np.where(out > 0, out, -np.inf)

    return _blocked_search(vectors, queries, k, key, column, score)
