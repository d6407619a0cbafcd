"""Problem 6: texts of varying size into containers of fixed capacity, with little room left.

Method: non-negative least squares over a length histogram. Sizes are put into classes; shallow combinations
of classes (few distinct lengths, some repeated) that fill a window below the capacity are enumerated;
repeat counts that reproduce the histogram are solved by non-negative least squares, rounded down, and what
is left is packed greedily (best fit, largest first), also into the room left in containers already laid out.

Scale: the histogram (at most CLASSES rows a container kind) is all that reaches the driver, where the
combinations are solved once for the whole distribution. Items are spread by hash over shards of about
SHARD_ITEMS items; each shard repeats the combinations in proportion to its own items, in one task of bounded
size. No source, length or document can make a shard large, and the cost of shards is a last, partly filled
container each.

A text is cut only if it exceeds the capacity: into pieces that fill whole containers and a remainder, between
code points. Null texts are not packed; an empty text takes a place of size 0.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 64  # length classes a container kind
WINDOW = 2  # a combination may stay this many classes below the capacity
SHARD_ITEMS = 20_000

ITEMS = "pack_id int, capacity int, doc_id bigint, piece_no int, n_pieces int, start_char int, end_char int, n_tokens int"
PACKED = "pack_id int, container_id string, slot int, doc_id bigint, piece_no int, n_pieces int, start_char int, end_char int, n_tokens int"


def cut_at_capacity(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start_char, end_char, bytes) of consecutive pieces, each as large as fits without parting a code point."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    out, at = [], 0
    while at < len(starts) - 1:
        to = int(np.searchsorted(starts, starts[at] + capacity, side="right")) - 1
        if to <= at:
            raise ValueError("a capacity under 4 tokens cannot hold every character")
        out.append((at, to, int(starts[to] - starts[at])))
        at = to
    return out


def _kinds(specs: DataFrame) -> list[tuple[int, int]]:
    rows = specs.select("pack_id", "capacity_tokens").where(F.col("capacity_tokens").isNotNull()).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("at most 10,000 container kinds")
    return [(int(a), int(b)) for a, b in rows]


def pack_items(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per container kind and item: a whole text, or a piece of one that exceeds the capacity."""
    kinds = _kinds(specs)
    if not kinds:
        return documents.sparkSession.createDataFrame([], ITEMS)
    d = documents.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("__size", F.octet_length("text"))
    whole = (
        d.select("doc_id", "__size", F.length("text").alias("end_char"), F.explode(F.array(*[F.struct(F.lit(a).alias("pack_id"), F.lit(b).alias("capacity")) for a, b in kinds])).alias("k"))
        .where(F.col("__size") <= F.col("k.capacity"))
        .select("k.pack_id", "k.capacity", "doc_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), "end_char", F.col("__size").alias("n_tokens"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, size in zip(b["doc_id"], b["text"], b["__size"]):
                for kind, capacity in kinds:
                    if size > capacity:
                        pieces = cut_at_capacity(text, capacity)
                        out += [(kind, capacity, doc_id, k + 1, len(pieces), s, e, n) for k, (s, e, n) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ITEMS.split(", ")])

    return whole.unionByName(d.where(F.col("__size") > min(c for _, c in kinds)).mapInPandas(run, ITEMS))


def combinations_of(classes: int, window: int = WINDOW) -> np.ndarray:
    """Shallow combinations of classes 1..classes whose sum lies in [classes - window, classes], as rows of counts.

    Depth counts distinct lengths: one length repeated, a repeated one with one other, three different ones."""
    seen: set[tuple[tuple[int, int], ...]] = set()
    low = classes - window

    def add(*parts: int) -> None:
        seen.add(tuple(sorted((p, parts.count(p)) for p in set(parts))))

    for a in range(1, classes + 1):
        for m in range(1, classes // a + 1):
            rest = classes - m * a
            if m * a >= low:
                add(*[a] * m)
            for b in range(max(1, rest - window), rest + 1):
                if b != a and low <= m * a + b <= classes:
                    add(*[a] * m, b)
    for a, b in itertools.combinations(range(1, classes + 1), 2):
        for c in range(max(b + 1, low - a - b), classes - a - b + 1):
            if c > b:
                add(a, b, c)
    out = np.zeros((len(seen), classes + 1), np.int32)
    for k, parts in enumerate(sorted(seen)):
        for p, n in parts:
            out[k, p] = n
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ (b - a @ x)
    tolerance = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(rounds):
        gradient[active] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                break
            bad = s <= 0
            old = x[at]
            step = np.min(old[bad] / np.maximum(old[bad] - s[bad], 1e-300))
            x[at] = old + step * (s - old)
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                s, at = np.zeros(0), np.zeros(0, int)
                break
        x[:] = 0
        x[at] = s
        gradient = a.T @ (b - a @ x)
    return x


def solve_shares(histogram: np.ndarray) -> list[tuple[list[tuple[int, int]], float]]:
    """The combinations in use, each as (class, count) parts, and their repeat count over all items.

    Long lengths weigh more: left-over short items are easy to place later."""
    classes = len(histogram) - 1
    table = combinations_of(classes)
    present = histogram > 0
    table = table[(table[:, ~present].sum(axis=1) == 0)]
    if not len(table):
        return []
    weight = np.sqrt(np.arange(classes + 1) + 1.0)
    scale = max(1.0, float(histogram.sum()))
    x = non_negative_least_squares((table * weight).T.astype(float), histogram * weight / scale) * scale
    return [([(int(c), int(table[k, c])) for c in np.flatnonzero(table[k])[::-1]], float(x[k])) for k in np.flatnonzero(x > 1e-9)]


def length_class(n_tokens, capacity, classes: int = CLASSES):
    """Sizes rounded up to classes, 1..classes; numbers or columns of equal kind."""
    return np.maximum(1, -(-np.asarray(n_tokens, np.int64) * classes // capacity))


def pack_shard(sizes: np.ndarray, capacity: int, shares: list[tuple[list[tuple[int, int]], float]], total: float) -> list[list[int]]:
    """Containers as lists of positions in `sizes`; every position once."""
    by_class: dict[int, list[int]] = {}
    for k in np.argsort(sizes, kind="stable"):
        by_class.setdefault(int(length_class(sizes[k], capacity)), []).append(int(k))
    part = len(sizes) / max(total, 1.0)
    containers: list[list[int]] = []
    room: list[int] = []
    for parts, repeats in sorted(shares, key=lambda s: -s[1]):
        n = min([int(repeats * part), *(len(by_class.get(c, ())) // m for c, m in parts)])
        for _ in range(n):
            if any(len(by_class[c]) < m for c, m in parts):  # spent on room left in earlier containers
                break
            box = [by_class[c].pop() for c, m in parts for _ in range(m)]
            free = capacity - int(sizes[box].sum())
            c = free * CLASSES // capacity
            while c > 0:  # classes are rounded up, so a container has room for more: its largest fitting class
                if by_class.get(c):
                    k = by_class[c].pop()
                    box.append(k)
                    free -= int(sizes[k])
                    c = free * CLASSES // capacity
                else:
                    c -= 1
            containers.append(box)
            room.append(free)
    left = sorted((int(k) for ks in by_class.values() for k in ks), key=lambda k: (-sizes[k], k))
    free = sorted((r, k) for k, r in enumerate(room) if r > 0)
    for k in left:
        n = int(sizes[k])
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            r, box = free.pop(at)
        else:
            r, box = capacity, len(containers)
            containers.append([])
        containers[box].append(k)
        if r - n > 0:
            bisect.insort(free, (r - n, box))
    return containers


def _histogram(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """(pack_id, c, n): how many items of each length class a container kind has, from sizes alone: a text over the capacity counts
    as whole containers and a remainder. (Cutting between code points may leave a few bytes more in the remainder; the
    combinations need the distribution, not every byte, and no text is cut for it.)"""
    sizes = documents.where("text IS NOT NULL").groupBy(F.octet_length("text").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    every = F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in _kinds(specs)])
    j = sizes.select("size", "n", F.inline(every))
    whole, rest = F.expr("size div capacity"), F.expr("size % capacity")
    cls = lambda x: F.greatest(F.lit(1), F.ceil(x * CLASSES / F.col("capacity")).cast("int"))
    parts = F.when(F.col("size") <= F.col("capacity"), F.array(F.struct(cls(F.col("size")).alias("c"), F.lit(1).cast("long").alias("m")))).otherwise(
        F.array(F.struct(F.lit(CLASSES).alias("c"), whole.alias("m")), F.struct(cls(rest).alias("c"), (rest > 0).cast("long").alias("m")))
    )
    return j.select("pack_id", "n", F.inline(parts)).groupBy("pack_id", "c").agg(F.sum(F.col("n") * F.col("m")).alias("n"))


def pack_documents(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """(pack_id, container_id, slot, doc_id, piece_no, n_pieces, start_char, end_char, n_tokens): every item in one
    container of each kind, no container over its capacity."""
    items = pack_items(documents, specs)
    counted = _histogram(documents, specs).collect() if _kinds(specs) else []
    plan: dict[int, tuple[list, float]] = {}
    for pack in sorted({r.pack_id for r in counted}):
        histogram = np.zeros(CLASSES + 1)
        for r in counted:
            if r.pack_id == pack:
                histogram[r.c] = r.n
        plan[pack] = (solve_shares(histogram), float(histogram.sum()))
    if not plan:
        return documents.sparkSession.createDataFrame([], PACKED)
    shards = F.create_map(*[F.lit(x) for p, (_, n) in plan.items() for x in (p, max(1, int(np.ceil(n / SHARD_ITEMS))))])
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(17)), shards[F.col("pack_id")]))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "piece_no", "start_char"], kind="stable").reset_index(drop=True)
        capacity = int(b["capacity"].iloc[0])
        shares, total = plan[int(key[0])]
        boxes = pack_shard(b["n_tokens"].to_numpy(np.int64), capacity, shares, total)
        order = np.fromiter(itertools.chain.from_iterable(boxes), np.int64, len(b))
        out = b.iloc[order].copy()
        out["container_id"] = np.repeat([f"{key[1]}-{k}" for k in range(len(boxes))], [len(x) for x in boxes])
        out["slot"] = np.concatenate([np.arange(1, len(x) + 1) for x in boxes])
        return out[[x.split()[0] for x in PACKED.split(", ")]]

    return items.groupBy("pack_id", "shard").applyInPandas(run, PACKED)


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(pack_id, n_containers, n_items, n_tokens, fill): fill is the used part of all containers' capacity."""
    r = packed.groupBy("pack_id").agg(F.count_distinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_items"), F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"))
    return r.join(specs.select("pack_id", "capacity_tokens"), "pack_id").select("pack_id", "n_containers", "n_items", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"))


def cut_documents(packed: DataFrame) -> DataFrame:
    """(pack_id, doc_id): documents that came out in more than one piece."""
    return packed.where((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).select("pack_id", "doc_id")
