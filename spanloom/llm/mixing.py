"""Problem 7: sources combined to target shares of the tokens, with capped repeats and actual shares reported.

Method: the tokens of each source are laid end to end (documents in hash order), as often as the source may be
used, and cut into blocks of fixed length, so that the last block of an epoch goes on with the start of the next
and only the very last one may be partly filled; for every output shard the number of blocks of each source is
drawn from a multinomial with the target shares; a further shard holds the slots of sources that chance gave fewer
than their target; the slots of a source are mapped, one epoch of its blocks after
the other, through a pseudorandom permutation of its block indices; slots and blocks are then joined by index. A
slot beyond the last permitted epoch stays empty: the source falls short, and the report says so.

Scale: sizes are written once; token offsets are prefix sums in three levels, the lowest inside a bucket, with a number of
buckets that follows the size of the source, so a source with a third of all rows is no hot group. Slots are
generated where they are needed from the shard number alone. Only per-source totals (one row a source of a
mix) reach the driver.

Null texts have size 0, rows without a source count towards the whole but to no source. A source without rows
has no blocks and falls short of any positive target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch

BLOCK_TOKENS = 4096
SHARD_SLOTS = 256  # blocks an output shard
BUCKET_TOKENS = 4_000_000  # tokens a prefix-sum bucket
TOP_BUCKETS = 500  # buckets a bucket of the level above
ROUNDS = 4


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at `index`: a balanced Feistel network with cycle walking."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    pending = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while pending.any():
            x = out[pending]
            left, right = x >> np.uint64(half), x & mask
            for r in range(ROUNDS):
                key = np.uint64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
                f = (right ^ key) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f >> np.uint64(29)) & mask)
            out[pending] = (left << np.uint64(half)) | right
            pending = out >= np.uint64(n)
    return out.astype(np.int64)


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row, written once: what all that follows reads in place of the texts."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return Scratch(documents.sparkSession, "sizes").write(documents.select("doc_id", "source", size.alias("size")))[0]


def mix_plan(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """One entry a mix and source: target, available tokens, blocks, and whether the source falls short."""
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("tokens"))
    total = int(sizes.agg(F.sum("tokens")).first()[0] or 0)
    wanted = targets.where(F.col("source").isNotNull() & F.col("mix_id").isNotNull()).select("mix_id", "source", "target_share", "max_repeats")
    # Bounded by the table of targets, not by the data; totals of sources in no mix stay where they are.
    rows = wanted.join(sizes.where(F.col("source").isNotNull()), "source", "left").select("mix_id", "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("mix_plan takes at most 100,000 targets")
    out = []
    for r in sorted(rows, key=lambda r: (r.mix_id, r.source)):
        share, repeats = float(r.target_share or 0), int(r.max_repeats or 0)
        out.append({
            "mix_id": r.mix_id, "source": r.source, "target_share": share, "max_repeats": repeats, "tokens": r.tokens, "target_tokens": share * total,
            "short": share * total > repeats * r.tokens, "total": total,
        })
    return out


def source_blocks(sizes: DataFrame, plan: list[dict]) -> DataFrame:
    """(source, block, doc_id, at, size, doc_from, doc_to): the stretch (in tokens) of each document in each block of
    one epoch of its source, where the document begins at `at`.

    Documents lie in hash order. A document without tokens is in no block."""
    tokens = {p["source"]: p["tokens"] for p in plan}
    spark = sizes.sparkSession
    if not tokens:
        return spark.createDataFrame([], "source string, block bigint, doc_id bigint, at bigint, size bigint, doc_from bigint, doc_to bigint")
    buckets = F.create_map(*[F.lit(x) for s, n in tokens.items() for x in (s, max(1, -(-n // BUCKET_TOKENS)))])
    d = sizes.where((F.col("size") > 0) & F.col("source").isin(list(tokens)))
    d = d.withColumn("h", F.xxhash64("doc_id", F.lit(7))).withColumn("bucket", F.pmod(F.col("h"), buckets[F.col("source")]))
    # Three levels: hundreds of buckets, buckets, documents; the topmost has a row a few hundred million tokens.
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("s")).withColumn("top", F.expr(f"bucket div {TOP_BUCKETS}"))
    tops = sums.groupBy("source", "top").agg(F.sum("s").alias("ts"))
    tops = tops.select("source", "top", (F.sum("ts").over(Window.partitionBy("source").orderBy("top")) - F.col("ts")).alias("top_start"))
    within = F.sum("s").over(Window.partitionBy("source", "top").orderBy("bucket")) - F.col("s")
    starts = sums.withColumn("within", within).join(tops, ["source", "top"]).select("source", "bucket", (F.col("top_start") + F.col("within")).alias("start"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    d = d.withColumn("inside", inside).join(starts, ["source", "bucket"]).withColumn("at", F.col("start") + F.col("inside"))
    first, last = F.expr(f"at div {BLOCK_TOKENS}"), F.expr(f"(at + size - 1) div {BLOCK_TOKENS}")
    d = d.withColumn("block", F.explode(F.sequence(first, last)))
    return d.select(
        "source", "block", "doc_id", "at", "size",
        F.greatest(F.lit(0), F.col("block") * BLOCK_TOKENS - F.col("at")).alias("doc_from"),
        F.least(F.col("size"), (F.col("block") + 1) * BLOCK_TOKENS - F.col("at")).alias("doc_to"),
    )


def epoch_block(draw: np.ndarray, epoch: int, tokens: int, repeats: int, seed: int) -> np.ndarray:
    """The blocks of an epoch (those that begin in it) in pseudorandom order. A partly filled last one comes last, so
    that every draw before it gets a full block."""
    first, end = -(-epoch * tokens // BLOCK_TOKENS), -(-(epoch + 1) * tokens // BLOCK_TOKENS)
    if epoch == repeats - 1:
        end = repeats * tokens // BLOCK_TOKENS
    out = draw.copy()
    if (full := draw < end).any():
        out[full] = first + permuted(draw[full] - first, end - first, seed)
    return out


SLOTS = "mix_id int, shard bigint, slot int, source string, draw bigint"


def draw_counts(mix_id: int, shard: int, shares: np.ndarray) -> np.ndarray:
    return np.random.default_rng([104729, mix_id & 0x7FFFFFFF, shard]).multinomial(SHARD_SLOTS, shares)


def mix_slots(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """(mix_id, shard, source, epoch, block, draw): every slot of every output shard; block is null where the
    source has no more blocks to give. Every source has slots for at least its target, so a slot left empty before that
    means that it falls short. A mix is larger than asked for by at most a shard and what the last one adds."""
    by_mix: dict[int, list[dict]] = {}
    for p in plan:
        by_mix.setdefault(p["mix_id"], []).append(p)
    shards = [(m, max(1, -(-ps[0]["total"] // (BLOCK_TOKENS * SHARD_SLOTS)))) for m, ps in by_mix.items() if ps[0]["total"] and sum(p["target_share"] for p in ps) > 0]
    empty = spark.createDataFrame([], "mix_id int, shard bigint, source string, epoch bigint, block bigint, draw bigint")
    if not shards:
        return empty

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for m, s in zip(b["mix_id"], b["shard"]):
                ps = by_mix[m]
                w = np.array([p["target_share"] for p in ps])
                out += [(m, s, p["source"], int(n)) for p, n in zip(ps, draw_counts(m, s, w / w.sum())) if n]
            yield pd.DataFrame(out, columns=["mix_id", "shard", "source", "n"])

    every = None
    for m, n in shards:
        one = spark.range(n).select(F.lit(m).cast("int").alias("mix_id"), F.col("id").alias("shard"))
        every = one if every is None else every.unionByName(one)
    counts = every.mapInPandas(count, "mix_id int, shard bigint, source string, n bigint")
    drawn = counts.groupBy("mix_id", "source").agg(F.sum("n").alias("drawn"))
    last = dict(shards)
    needed = spark.createDataFrame([(p["mix_id"], last[p["mix_id"]], p["source"], math.ceil(p["target_tokens"] / BLOCK_TOKENS)) for p in plan if p["mix_id"] in last], "mix_id int, shard bigint, source string, needed bigint")
    lacking = needed.join(drawn, ["mix_id", "source"], "left").select("mix_id", "shard", "source", (F.col("needed") - F.coalesce("drawn", F.lit(0))).alias("n")).where("n > 0")
    counts = counts.unionByName(lacking).withColumn("g", F.expr("shard div 1000"))
    # Draws of a source before this shard: over groups of 1,000 shards, then inside the group.
    per_group = counts.groupBy("mix_id", "source", "g").agg(F.sum("n").alias("s"))
    before = per_group.select("mix_id", "source", "g", (F.sum("s").over(Window.partitionBy("mix_id", "source").orderBy("g")) - F.col("s")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("mix_id", "source", "g").orderBy("shard")) - F.col("n")
    slots = counts.withColumn("inside", inside).join(before, ["mix_id", "source", "g"])
    slots = slots.select("mix_id", "shard", "source", F.explode(F.sequence(F.col("before") + F.col("inside"), F.col("before") + F.col("inside") + F.col("n") - 1)).alias("draw"))
    sources = {(p["mix_id"], p["source"]): (p["tokens"], p["max_repeats"], k) for k, p in enumerate(plan)}

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["epoch"], b["block"] = 0, -1
            for (m, s), g in b.groupby(["mix_id", "source"]):
                n, repeats, k = sources[(m, s)]
                if not n:
                    continue
                draw = g["draw"].to_numpy(np.int64)
                epoch = draw * BLOCK_TOKENS // n
                chosen = np.full(len(g), -1, np.int64)
                for e in np.unique(epoch):
                    if e < repeats:
                        at = epoch == e
                        chosen[at] = epoch_block(draw[at], int(e), n, repeats, 1 + k * 1_000_003 + int(e))
                b.loc[g.index, "epoch"] = epoch
                b.loc[g.index, "block"] = chosen
            yield b[["mix_id", "shard", "source", "epoch", "block", "draw"]]

    chosen = slots.mapInPandas(choose, "mix_id int, shard bigint, source string, epoch bigint, block bigint, draw bigint")
    return chosen.withColumn("block", F.when(F.col("block") >= 0, F.col("block")))


def _character_start(at: str) -> str:
    """SQL of the first byte at or after `at` of the UTF-8 bytes `b` that begins a character, or their end."""
    inner = lambda k: f"(substring(b, INT({at}) + {k + 1}, 1) BETWEEN X'80' AND X'BF')"
    return f"{at} + CASE WHEN NOT {inner(0)} THEN 0 WHEN NOT {inner(1)} THEN 1 WHEN NOT {inner(2)} THEN 2 ELSE 3 END"


def mix_pieces(sizes: DataFrame, plan: list[dict]) -> DataFrame:
    """(mix_id, shard, source, epoch, block, draw, slot_from, doc_id, doc_from, doc_to): the stretches of documents in
    every filled slot; slot_from is where the stretch begins in the slot."""
    spark = sizes.sparkSession
    sources = spark.createDataFrame([(p["mix_id"], p["source"], p["tokens"], p["max_repeats"] * p["tokens"]) for p in plan], "mix_id int, source string, tokens bigint, all bigint")
    slots = mix_slots(spark, plan).where(F.col("block").isNotNull()).join(F.broadcast(sources), ["mix_id", "source"]).withColumnRenamed("block", "slot_block")
    slots = slots.withColumn("lo", F.col("slot_block") * BLOCK_TOKENS).withColumn("hi", F.least(F.col("lo") + BLOCK_TOKENS, "all"))
    # A slot may reach into the next copies of its source: one row a copy, then one a block of the source's own tokens.
    slots = slots.withColumn("copy", F.explode(F.expr("sequence(lo div tokens, (hi - 1) div tokens)"))).withColumn("start", F.expr("copy * tokens"))
    slots = slots.withColumn("p", F.expr("greatest(lo, start) - start")).withColumn("q", F.expr("least(hi, start + tokens) - start"))
    slots = slots.withColumn("block", F.explode(F.expr(f"sequence(p div {BLOCK_TOKENS}, (q - 1) div {BLOCK_TOKENS})")))
    # A document that lies in several blocks of the stretch counts in the first of them.
    j = slots.join(source_blocks(sizes, plan), ["source", "block"]).where(f"at < q AND at + size > p AND block = greatest(at, p) div {BLOCK_TOKENS}")
    return j.select(
        "mix_id", "shard", "source", "epoch", F.col("slot_block").alias("block"), "draw", F.expr("start + greatest(at, p) - lo").alias("slot_from"),
        "doc_id", F.expr("greatest(0, p - at)").alias("doc_from"), F.expr("least(size, q - at)").alias("doc_to"),
    )


def mixed(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, shard, source, epoch, block, draw, slot_from, doc_id, doc_from, doc_to, text): the contents of every filled slot.

    doc_from and doc_to count tokens, which are bytes; text holds the characters that begin between them, so the
    pieces of a document make up its text again. Each text is shuffled once, whatever the number of mixes."""
    sizes = sized(documents)
    pieces = mix_pieces(sizes, mix_plan(sizes, targets))
    texts = documents.where(F.octet_length("text") > 0).select("doc_id", F.encode("text", "utf-8").alias("b"))
    start, end = _character_start("doc_from"), _character_start("doc_to")
    cut = F.expr(f"CAST(substring(b, CAST({start} + 1 AS INT), CAST(({end}) - ({start}) AS INT)) AS STRING)")
    return pieces.join(texts, "doc_id").select("mix_id", "shard", "source", "epoch", "block", "draw", "slot_from", "doc_id", "doc_from", "doc_to", cut.alias("text"))


def mix_report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, available_tokens, target_tokens, mixed_tokens, actual_share,
    times_used, falls_short): the mix as it came out."""
    sizes = sized(documents)
    plan = mix_plan(sizes, targets)
    spark = documents.sparkSession
    schema = "mix_id int, source string, target_share double, max_repeats int, available_tokens bigint, target_tokens double, falls_short boolean"
    asked = spark.createDataFrame([(p["mix_id"], p["source"], p["target_share"], p["max_repeats"], p["tokens"], p["target_tokens"], p["short"]) for p in plan], schema)
    got = mix_pieces(sizes, plan).groupBy("mix_id", "source").agg(F.sum(F.col("doc_to") - F.col("doc_from")).alias("mixed_tokens"))
    r = asked.join(got, ["mix_id", "source"], "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = F.sum("mixed_tokens").over(Window.partitionBy("mix_id"))
    return r.select(
        "mix_id", "source", "target_share", "max_repeats", "available_tokens", "target_tokens", "mixed_tokens",
        F.when(whole > 0, F.col("mixed_tokens") / whole).alias("actual_share"),
        F.when(F.col("available_tokens") > 0, F.col("mixed_tokens") / F.col("available_tokens")).alias("times_used"),
        "falls_short",
    )


def sources_falling_short(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source), read off the finished mix, where every source has slots for its target: it falls short if what
    came out, its last permitted epoch used up, is still less. The exact sum must say the same."""
    r = mix_report(documents, targets).withColumn("missing", F.col("mixed_tokens") < F.col("target_tokens"))
    differs = F.concat(F.lit("the mix and the sum of tokens differ on source "), F.col("source"))
    return r.where(F.when(F.col("missing") == F.col("falls_short"), F.col("missing")).otherwise(F.raise_error(differs).cast("boolean"))).select("mix_id", "source")
