"""Boxes that move, that are uncertain, that are soft; and their training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .vectors import intersection, volume


def box_at(low: Column, velocity: Column, start: Column, end: Column, at: Column) -> Column:
    """A corner of a moving box at a time, linear from its start; null outside [start, end)."""
    moved = F.zip_with(low, velocity, lambda x, v: x + v * (at - start))
    return F.when((at >= start) & (at < end), moved)


def box_confidence(low: Column, high: Column) -> Column:
    """1 / (1 + volume): a tight box is a sure one."""
    return 1 / (1 + volume(low, high))


def conflicts(l1: Column, h1: Column, c1: Column, l2: Column, h2: Column, c2: Column) -> Column:
    """Whether two sure boxes (both above 0.8) hardly overlap (under a tenth of the smaller)."""
    return (intersection(l1, h1, l2, h2) < 0.1 * F.least(volume(l1, h1), volume(l2, h2))) & (c1 > 0.8) & (c2 > 0.8)


def interaction(actor_low: Column, actor_high: Column, *others: tuple[Column, Column]) -> Column:
    """The least overlap of an actor with others over the actor's volume; 0 without a volume."""
    v = volume(actor_low, actor_high)
    overlaps = [intersection(actor_low, actor_high, a, b) for a, b in others]
    return F.when(v > 0, (F.least(*overlaps) if len(overlaps) > 1 else overlaps[0]) / v).otherwise(F.lit(0.0))


def soft_membership(point: Column, low: Column, high: Column, temperature: float) -> Column:
    """How much of a point lies in a box with logistic margins: the product over dimensions."""
    s = lambda x: 1 / (1 + F.exp(-x / temperature))
    parts = F.zip_with(F.zip_with(point, low, lambda p, a: s(p - a)), F.zip_with(point, high, lambda p, b: s(b - p)), lambda x, y: x * y)
    return F.aggregate(parts, F.lit(1.0), lambda acc, x: acc * x)


MAX_TRAINED = 200_000  # identities that one training may hold


def train_boxes(pairs: DataFrame, vectors: DataFrame, radius: float = 0.5, margin: float = 0.3, negative_weight: float = 0.5, rate: float = 0.05, epochs: int = 30, seed: int = 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Boxes by id, fitted by AMSGrad so that pairs (left, right, same) that mean the same overlap and others lie a margin
    apart. Vectors (id, vector) give the first centres. A training step of bounded size on the driver."""
    v = vectors.select("id", "vector").limit(MAX_TRAINED + 1).collect()
    p = pairs.select("left", "right", "same").limit(10 * MAX_TRAINED + 1).collect()
    if len(v) > MAX_TRAINED or len(p) > 10 * MAX_TRAINED:
        raise ValueError(f"train_boxes takes at most {MAX_TRAINED} vectors and ten times as many pairs")
    if not v:
        return {}
    at = {r.id: k for k, r in enumerate(v)}
    centre = np.array([r.vector for r in v], float)
    half = np.full_like(centre, np.log(radius))
    known = [(at[r.left], at[r.right], bool(r.same)) for r in p if r.left in at and r.right in at]
    if not known:
        e = np.exp(half)
        return {i: (centre[k] - e[k], centre[k] + e[k]) for i, k in at.items()}
    a, b, same = (np.array(x) for x in zip(*known))
    theta = np.concatenate([centre, half], axis=1)
    m, s, top = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(theta)
    rng, d, step = np.random.default_rng(seed), centre.shape[1], 0
    for _ in range(epochs):
        order = rng.permutation(len(a))
        for k in range(0, len(order), 256):
            x, y, z = a[order[k : k + 256]], b[order[k : k + 256]], same[order[k : k + 256]][:, None]
            gap = theta[x, :d] - theta[y, :d]
            reach = np.exp(theta[x, d:]) + np.exp(theta[y, d:])
            apart = np.abs(gap) - reach  # below 0: the boxes overlap in this dimension
            pull = z * (apart > -margin)
            nearest = apart == apart.max(axis=1, keepdims=True)
            push = ~z * nearest * (apart < margin) * negative_weight
            g = np.zeros_like(theta)
            toward = np.sign(gap) * (pull - push)
            np.add.at(g, x, np.concatenate([toward, -(pull - push) * np.exp(theta[x, d:])], axis=1))
            np.add.at(g, y, np.concatenate([-toward, -(pull - push) * np.exp(theta[y, d:])], axis=1))
            step += 1
            m = 0.9 * m + 0.1 * g
            s = 0.999 * s + 0.001 * g * g
            top = np.maximum(top, s)
            theta -= rate * min(1.0, step / 20) * (m / (1 - 0.9**step)) / (np.sqrt(top) + 1e-8)
    e = np.exp(theta[:, d:])
    return {i: (theta[k, :d] - e[k], theta[k, :d] + e[k]) for i, k in at.items()}


def train_boxes_table(pairs: DataFrame, vectors: DataFrame, radius: float = 0.5, margin: float = 0.3, negative_weight: float = 0.5, rate: float = 0.05, epochs: int = 30) -> DataFrame:
    """(id, low, high): the same training for any number of identities. All pairs are seen at once in every epoch: centres and
    widths are a table that pairs (left, right, same) meet twice, gradients are summed by identity and dimension (pre-aggregated
    before the shuffle, so an identity in very many pairs is no hot key), and each epoch is written to the shared folder."""
    scratch = Scratch(vectors.sparkSession, "boxes")
    first = vectors.where("vector IS NOT NULL").select("id", F.posexplode(F.col("vector").cast("array<double>")).alias("d", "c"))
    zero = F.lit(0.0)
    theta, path = scratch.write(first.select("id", "d", "c", F.lit(float(np.log(radius))).alias("h"), *[zero.alias(x) for x in ("mc", "mh", "sc", "sh", "tc", "th")]))
    p, p_path = scratch.write(pairs.where("left IS NOT NULL AND right IS NOT NULL").select("left", "right", F.coalesce("same", F.lit(False)).alias("same")))
    for step in range(1, epochs + 1):
        side = lambda name, x: theta.select(F.col("id").alias(name), "d", F.col("c").alias(f"{x}c"), F.exp("h").alias(f"{x}e"))  # noqa: B023, E731
        j = p.join(side("left", "a"), "left").join(side("right", "b"), ["right", "d"])
        gap = F.col("ac") - F.col("bc")
        j = j.select("left", "right", "d", "same", "ae", "be", F.signum(gap).alias("sign"), (F.abs(gap) - F.col("ae") - F.col("be")).alias("apart"))
        worst = j.where(~F.col("same")).groupBy("left", "right").agg(F.max("apart").alias("worst"))
        j = j.join(worst, ["left", "right"], "left")
        pull = F.when(F.col("same") & (F.col("apart") > -margin), 1.0).otherwise(0.0)
        push = F.when(~F.col("same") & (F.col("apart") == F.col("worst")) & (F.col("apart") < margin), negative_weight).otherwise(0.0)
        j = j.withColumn("t", pull - push)
        ends = F.array(*[F.struct(F.col(i).alias("id"), (F.col("sign") * F.col("t") * s).alias("gc"), (-F.col("t") * F.col(e)).alias("gh")) for i, s, e in (("left", 1, "ae"), ("right", -1, "be"))])
        g = j.select("d", F.inline(ends)).groupBy("id", "d").agg(F.sum("gc").alias("gc"), F.sum("gh").alias("gh"))
        x = theta.join(g, ["id", "d"], "left").na.fill(0.0, ["gc", "gh"])
        new = {}
        for k in "ch":
            new |= {f"m{k}": 0.9 * F.col(f"m{k}") + 0.1 * F.col(f"g{k}"), f"s{k}": 0.999 * F.col(f"s{k}") + 0.001 * F.col(f"g{k}") * F.col(f"g{k}")}
        x = x.withColumns(new).withColumns({f"t{k}": F.greatest(f"t{k}", f"s{k}") for k in "ch"})
        pace = rate * min(1.0, step / 20) / (1 - 0.9**step)
        x = x.withColumns({k: F.col(k) - pace * F.col(f"m{k}") / (F.sqrt(f"t{k}") + 1e-8) for k in "ch"})
        written, new_path = scratch.write(x.select(*theta.columns))
        scratch.drop(path)
        theta, path = written, new_path
    scratch.drop(p_path)
    e = F.exp("h")
    at = theta.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", (F.col("c") - e).alias("low"), (F.col("c") + e).alias("high")))).alias("x"))  # as many as dimensions
    return at.select("id", F.col("x.low").alias("low"), F.col("x.high").alias("high"))
