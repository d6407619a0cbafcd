import numpy as np
import pytest

from spanloom.llm import mixing as m
from spanloom.llm import packing as p


def _docs(spark, n=400):
    rng = np.random.default_rng(5)
    rows = [(i, "x" * int(k), "big" if i % 3 else ("small" if i % 2 else None), 1) for i, k in enumerate(rng.integers(0, 3000, n))]
    rows += [(9001, None, "big", 1), (9002, "", "small", 1), (9003, "é" * 3000, "small", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot int")


def test_packing(spark):
    docs = _docs(spark)
    specs = spark.createDataFrame([(1, 1024, 0), (2, 4096, 0), (3, None, 0)], "pack_id int, capacity_tokens int, doc_id int")
    packed = p.pack_documents(docs, specs).toPandas()
    for pack, capacity in ((1, 1024), (2, 4096)):
        x = packed[packed.pack_id == pack]
        assert x.groupby("container_id").n_tokens.sum().max() <= capacity
        assert not x.duplicated(["doc_id", "piece_no"]).any()
        sizes = {r.doc_id: len(r.text.encode()) for r in docs.collect() if r.text is not None}
        assert x.groupby("doc_id").n_tokens.sum().to_dict() == sizes
        assert set(x[x.n_pieces > 1].doc_id) == {k for k, n in sizes.items() if n > capacity}
        assert sum(sizes.values()) / (x.container_id.nunique() * capacity) > 0.93
    assert p.pack_documents(docs.limit(0), specs).count() == 0
    assert p.pack_documents(docs, specs.limit(0)).count() == 0


def test_least_squares():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 30)), np.zeros(30)
    x[[3, 7, 20]] = 2, 5, 1
    got = p.non_negative_least_squares(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(m.permuted(np.arange(n), n, 9)) == list(range(n))


def test_mixing(spark):
    docs = _docs(spark)
    targets = spark.createDataFrame([(1, "big", 0.5, 2, "x"), (1, "small", 0.4, 1, "x"), (1, "gone", 0.1, 3, "x"), (1, None, 0.0, 1, "x")], "mix_id int, source string, target_share double, max_repeats int, tokens string")
    r = {x.source: x for x in m.mix_report(docs, targets).collect()}
    tokens = {s: sum(len((d.text or "").encode()) for d in docs.collect() if d.source == s) for s in ("big", "small")}
    total = sum(len((d.text or "").encode()) for d in docs.collect())
    assert r["big"].available_tokens == tokens["big"] and r["gone"].available_tokens == 0
    for s, share, cap in (("big", 0.5, 2), ("small", 0.4, 1), ("gone", 0.1, 3)):
        assert r[s].falls_short == (share * total > cap * tokens.get(s, 0))
        assert r[s].mixed_tokens <= cap * tokens.get(s, 0)
    assert {(x.mix_id, x.source) for x in m.sources_falling_short(docs, targets).collect()} == {(1, s) for s in r if r[s].falls_short}
    assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    sizes = m.sized(docs)
    blocks = m.source_blocks(sizes, m.mix_plan(sizes, targets)).toPandas()
    whole = blocks.assign(n=blocks.doc_to - blocks.doc_from).groupby("doc_id").n.sum().to_dict()
    assert whole == {d.doc_id: len(d.text.encode()) for d in docs.collect() if d.text and d.source}
    assert m.mix_report(docs.limit(0), targets).count() == 3
    assert m.mix_report(docs, targets.limit(0)).count() == 0


def test_mixed_documents(spark):
    """Against the bytes of each source laid end to end and sliced in plain Python."""
    docs = _docs(spark).unionByName(spark.createDataFrame([(9100 + i, "aé€😀" * (700 + i), "wide", 1) for i in range(7)], "doc_id bigint, text string, source string, slot int"))
    targets = spark.createDataFrame([(1, "big", 0.5, 2), (1, "wide", 0.2, 3), (1, "small", 0.3, 1), (2, "wide", 0.9, 1), (2, "gone", 0.1, 1)], "mix_id int, source string, target_share double, max_repeats int")
    rows = [r for r in docs.selectExpr("doc_id", "text", "source", "xxhash64(doc_id, 7) AS h").collect() if r.text and r.source]
    streams = {s: b"".join(r.text.encode() for r in sorted(rows, key=lambda r: (r.h, r.doc_id)) if r.source == s) for s in ("big", "small", "wide", "gone")}
    whole = sum(len((r.text or "").encode()) for r in docs.select("text").collect())
    plan = sorted((r.mix_id, r.source, r.target_share, r.max_repeats) for r in targets.collect())
    want, n = {}, m.BLOCK_TOKENS
    for mix in (1, 2):
        drawn = dict.fromkeys(streams, 0)
        shards = -(-whole // (n * m.SHARD_SLOTS))
        for shard in range(shards + 1):
            mine = [(k, p) for k, p in enumerate(plan) if p[0] == mix]
            shares = np.array([p[2] for _, p in mine])
            counts = m.draw_counts(mix, shard, shares / shares.sum()) if shard < shards else [max(0, -int(-p[2] * whole // n) - drawn[p[1]]) for _, p in mine]
            for (k, (_, s, _, repeats)), count in zip(mine, counts):
                t = len(streams[s])
                for draw in range(drawn[s], drawn[s] + count):
                    if draw * n < repeats * t:
                        e = draw * n // t
                        block = int(m.epoch_block(np.array([draw]), e, t, repeats, 1 + k * 1_000_003 + e)[0])
                        want[mix, shard, s, draw] = (streams[s] * repeats)[block * n : (block + 1) * n]
                drawn[s] += count
    size = {r.doc_id: len(r.text.encode()) for r in rows}
    text = {r.doc_id: r.text for r in rows}
    got = {}
    mix = m.mixed(docs, targets).collect()
    for r in sorted(mix, key=lambda r: r.slot_from):
        b = text[r.doc_id].encode()
        assert 0 <= r.doc_from < r.doc_to <= size[r.doc_id]
        assert r.slot_from == len(got.get((r.mix_id, r.shard, r.source, r.draw), b""))
        got[r.mix_id, r.shard, r.source, r.draw] = got.get((r.mix_id, r.shard, r.source, r.draw), b"") + b[r.doc_from : r.doc_to]
        starts = [i for i in range(r.doc_from, r.doc_to) if b[i] & 0xC0 != 0x80]
        assert r.text == "".join(b[i : i + (1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4)].decode() for i in starts)
    assert got == want
    report = {(r.mix_id, r.source): r.mixed_tokens for r in m.mix_report(docs, targets).collect()}
    assert {k: sum(len(b) for (x, _, s, _), b in want.items() if (x, s) == k) for k in report} == report
    assert m.mixed(docs.limit(0), targets).count() == 0 and m.mixed(docs, targets.limit(0)).count() == 0


def test_epoch_blocks():
    """Over all epochs every block comes once, the partly filled one last."""
    for tokens, repeats in ((10, 3), (4096, 2), (5000, 4), (100_000, 3), (1, 1)):
        n = -(-tokens * repeats // m.BLOCK_TOKENS)
        draw = np.arange(n)
        epoch = draw * m.BLOCK_TOKENS // tokens
        got = np.concatenate([m.epoch_block(draw[epoch == e], int(e), tokens, repeats, 5 + int(e)) for e in np.unique(epoch)])
        assert sorted(got) == list(range(n))
        assert tokens * repeats % m.BLOCK_TOKENS == 0 or got[-1] == n - 1


def test_small_sources_give_full_blocks(spark):
    """As many tokens as slots of 4096 while max_repeats leaves room, however few blocks a source has."""
    docs = spark.createDataFrame([(i, "x" * 1000, "tiny" if i < 5 else "big", 1) for i in range(200)], "doc_id bigint, text string, source string, slot int")
    targets = spark.createDataFrame([(1, "big", 0.8, 2), (1, "tiny", 0.2, 40)], "mix_id int, source string, target_share double, max_repeats int")
    slots = {r.source: r["count"] for r in m.mix_slots(spark, m.mix_plan(m.sized(docs), targets)).where("block IS NOT NULL").groupBy("source").count().collect()}
    got = {r.source: r for r in m.mix_report(docs, targets).collect()}
    assert got["tiny"].mixed_tokens == min(slots["tiny"] * m.BLOCK_TOKENS, 40 * 5000)
    assert got["big"].mixed_tokens == min(slots["big"] * m.BLOCK_TOKENS, 2 * 195_000)


def test_shortage_is_read_off_the_mix(spark, monkeypatch):
    """Every source reaches its target or has no epoch left, whatever chance draws; without the mix there is no row."""
    docs = spark.createDataFrame([(i, "x" * 1000, "abc"[i % 3], 1) for i in range(300)], "doc_id bigint, text string, source string, slot int")
    targets = spark.createDataFrame([(k, s, w, r) for k in range(6) for s, w, r in (("a", 0.02, 1), ("b", 0.34, 1), ("c", 0.54, 2), ("gone", 0.1, 5))], "mix_id int, source string, target_share double, max_repeats int")
    for r in m.mix_report(docs, targets).collect():
        assert (r.mixed_tokens < r.target_tokens) == r.falls_short
        assert not r.falls_short or r.mixed_tokens == r.max_repeats * r.available_tokens
    assert {(r.mix_id, r.source) for r in m.sources_falling_short(docs, targets).collect()} == {(k, s) for k in range(6) for s in ("b", "gone")}
    slots = m.mix_slots
    monkeypatch.setattr(m, "mix_slots", lambda *a: slots(*a).limit(0))
    with pytest.raises(Exception, match="the mix and the sum"):
        m.sources_falling_short(docs, targets).collect()
