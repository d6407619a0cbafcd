"""Radius joins of strings in the metric space of the Levenshtein distance.

Metric-space partitioning: strings of the right side go to the cell of their nearest pivot. A string of the
left side is replicated to every cell that may hold a partner: if r lies in the cell of p and d(l, r) <= radius,
then d(l, p) <= d(l, q) + 2 radius for every pivot q, and the distance of l from p lies within the radius of those that
occur in the cell. Inside a cell strings are kept by their length, which is their distance from the empty string: only
lengths within the radius meet (the triangle inequality again, and the key that splits a large cell). Pairs with
|d(l, p) - d(r, p)| > radius are out as well; the others are measured exactly, with the threshold. The join is exact for
any pivots; they decide only how much is measured.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_PIVOTS, MOST_PIVOTS, PIVOT_RATE = 16, 1024, 6
PIVOT_SAMPLE, PIVOT_LENGTH = 4000, 32  # strings of the right side among which pivots are looked for, and their length


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def to_many(one: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The distances of a string from many (rows of code points, padded). A row of the table is made at once: what an insertion
    costs is a running minimum over the row less its place."""
    places = np.arange(codes.shape[1] + 1, dtype=np.int16)
    before = np.broadcast_to(places, (len(codes), len(places)))
    for i, c in enumerate(one, 1):
        now = np.empty((len(codes), len(places)), np.int16)
        now[:, 0] = i
        np.minimum(before[:, 1:] + 1, before[:, :-1] + (codes != ord(c)), out=now[:, 1:])
        before = np.minimum.accumulate(now - places, axis=1) + places
    return before[np.arange(len(codes)), lengths]


def choose_pivots(right: DataFrame, column: str, count: int | None = None) -> list[str]:
    """Strings far apart: the string of a hash sample that is farthest from all pivots so far, again and again. Their number
    follows the root of the number of strings unless it is given. Strings of more than PIVOT_LENGTH characters are no pivots."""
    distinct = right.select(column).where(F.col(column).isNotNull()).distinct()
    h = F.xxhash64(column)
    # one pass: the number of strings, and those of least hash
    sample = distinct.where(F.length(column) <= PIVOT_LENGTH).orderBy(h, column).limit(PIVOT_SAMPLE)
    strings = [r[0] for r in sample.collect()]
    if not strings:
        return [r[0] for r in distinct.limit(1).collect()]
    n = len(strings) if len(strings) < PIVOT_SAMPLE else distinct.count()
    count = count or max(LEAST_PIVOTS, min(MOST_PIVOTS, math.ceil(PIVOT_RATE * math.sqrt(n))))
    lengths = np.array([len(x) for x in strings])
    codes = np.zeros((len(strings), max(1, lengths.max())), np.int32)
    for k, x in enumerate(strings):
        codes[k, : len(x)] = [ord(c) for c in x]
    chosen, nearest = [0], to_many(strings[0], codes, lengths)
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, to_many(strings[chosen[-1]], codes, lengths))
    return [strings[k] for k in chosen]


def radius_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, radius: int, pivots: list[str] | None = None) -> DataFrame:
    """(left_col, right_col, distance): all pairs of distinct strings within the radius. Nulls have no partners."""
    pivots = pivots or choose_pivots(right, right_col)
    lefts = left.select(F.col(left_col).alias("l")).where(F.col("l").isNotNull()).distinct()
    rights = right.select(F.col(right_col).alias("r")).where(F.col("r").isNotNull()).distinct()
    none = lefts.limit(0).select(F.col("l").alias(left_col), F.col("l").alias(right_col), F.lit(0).alias("distance"))
    if not pivots:
        return none
    points = F.array(*[F.lit(p) for p in pivots])
    to_all = lambda c: F.transform(points, lambda p: F.levenshtein(F.col(c), p))
    rights = rights.withColumn("d", to_all("r")).withColumn("dr", F.array_min("d"))
    rights = rights.select("r", (F.array_position("d", F.col("dr")).cast("int") - 1).alias("cell"), "dr", F.length("r").alias("n"))
    # two numbers a pivot: bounded by MOST_PIVOTS
    reach = {r.cell: (r.low, r.high) for r in rights.groupBy("cell").agg(F.min("dr").alias("low"), F.max("dr").alias("high")).collect()}
    if not reach:
        return none
    lows = F.array(*[F.lit(reach.get(k, (1 << 29, 0))[0] - radius) for k in range(len(pivots))])
    highs = F.array(*[F.lit(reach.get(k, (0, -radius - 1))[1] + radius) for k in range(len(pivots))])
    lefts = lefts.withColumn("d", to_all("l")).withColumn("near", F.array_min("d") + 2 * radius)
    at = F.transform("d", lambda x, i: F.struct(i.alias("cell"), x.alias("dl")))
    cells = F.filter(at, lambda s: (s["dl"] <= F.col("near")) & (s["dl"] <= F.get(highs, s["cell"])) & (s["dl"] >= F.get(lows, s["cell"])))
    lefts = lefts.select("l", F.explode(cells).alias("x")).select("l", "x.cell", "x.dl", F.explode(F.sequence(F.greatest(F.length("l") - radius, F.lit(0)), F.length("l") + radius)).alias("n"))
    pairs = lefts.join(rights, ["cell", "n"]).where(F.abs(F.col("dl") - F.col("dr")) <= radius)
    pairs = pairs.withColumn("distance", F.levenshtein("l", "r", radius)).where(F.col("distance") >= 0)
    return pairs.select(F.col("l").alias(left_col), F.col("r").alias(right_col), "distance")
