"""What must hold beyond one batch, one block, one bucket, one spelling."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import graph as G
from spanloom.operators import heuristics as H
from spanloom.operators import resolve as R
from spanloom.operators import spans as S
from spanloom.operators import vectors as V
from spanloom.streaming import windows as W


def test_running_state_over_many_batches(spark, tmp_path):
    """Keys that are absent from the last micro-batch stay in the result."""
    for i in range(20):
        kind = "A" if i < 10 else "B"
        spark.createDataFrame([(float(i), kind)] * 3, "value double, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    s = W.running_stats(W.read_stream(spark, f"{tmp_path}/events", files_per_batch=4))
    got = {r.event_type: (r.n, round(r["mean"], 6)) for r in W.run_to_end(s, "many", ["event_type"]).collect()}
    assert got == {"A": (30, 4.5), "B": (30, 14.5)}
    none = spark.createDataFrame([], "value double, event_type string")
    none.write.parquet(f"{tmp_path}/empty")
    assert W.run_to_end(W.running_stats(W.read_stream(spark, f"{tmp_path}/empty")), "none", ["event_type"]).count() == 0


def test_window_counts_over_many_batches(spark, tmp_path):
    for i in range(6):
        rows = [(f"2024-01-01 00:{10 * i + k:02d}:00", "x", 1.0) for k in range(0, 10, 5)]
        df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    s = W.tumbling_counts(W.read_stream(spark, f"{tmp_path}/events", files_per_batch=1))
    assert [(r.n, r.total) for r in W.run_to_end(s, "windows", ["start", "event_type"]).collect()] == [(12, 12.0)]


def test_search_has_no_limit_of_queries(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 5)).round(3)
    x[3] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0, None, 2.0, 3.0, 4.0]), (502, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    n = np.linalg.norm(x, axis=1)
    cos = np.divide(x @ x.T, n[:, None] * n[None, :], out=np.zeros((90, 90)), where=(n[:, None] * n[None, :]) > 0).round(9)
    got = {(r.query_id, r["rank"]): r.neighbour_id for r in V.search(df, df, 3).collect()}
    want = {(i, k + 1): j for i in range(90) for k, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-cos[i, j], j))[:3])}
    assert got == want
    bits = x > 0
    near = {(r.query_id, r.neighbour_id) for r in V.search(df, df, 90, max_hamming=1).collect()}
    assert near == {(i, j) for i in range(90) for j in range(90) if i != j and (bits[i] != bits[j]).sum() <= 1}
    assert V.search(df.limit(0), df, 3).count() == 0


def test_equal_names_are_one_class(spark):
    rows = [(i, "Harbour Company") for i in range(3000)] + [(5000, "Harbour  Company"), (5001, "Harbour Mill Company"), (5002, None), (5003, "")]
    df = spark.createDataFrame(rows, "id bigint, name string")
    assert {(r.left, r.right, r.links) for r in R.jaccard_pairs(df, 0.6).collect()} == {(0, 5000, 3000), (0, 5001, 3000), (5000, 5001, 1)}
    members = {r.member: (r.representative, r.copies) for r in R.equal_classes(df).collect()}
    assert members[2999] == (0, 3000) and members[5000] == (5000, 1) and 5002 not in members
    assert all(r.left < r.right for r in R.minhash_candidates(df).collect())
    got = {r.identity: r.n_mentions for r in R.identities(df, R.jaccard_pairs(df, 0.6)).collect()}
    assert got == {0: 3002, 5002: 1, 5003: 1}


def test_proximity_with_a_very_long_span(spark):
    random.seed(3)
    rows = [(i, 1, s, s + random.randint(0, 30)) for i in range(150) for s in [random.randint(0, 4000)]] + [(900, 1, 5, 3500), (901, 2, 0, 10)]
    df = spark.createDataFrame(rows, "pred_id bigint, doc_id bigint, start_char int, end_char int")
    got = {(r.left, r.right): r.gap for r in S.proximity_pairs(df, 15).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[1] == b[1] and (a[2], a[0]) < (b[2], b[0]):
                gap = max(0, max(a[2], b[2]) - min(a[3], b[3]))
                if gap <= 15:
                    want[a[0], b[0]] = gap
    assert got == want


def test_communities_settle(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1) for c in "abc" for i in range(5) for j in range(i)]
    e = spark.createDataFrame([*cliques, ("a0", "b0", 1), ("b1", "c1", 1), ("z", "z", 2)], "source string, target string, weight int")
    got = {r.node: r.community for r in G.local_moving(e).collect()}
    assert got == {f"{c}{i}": f"{c}0" for c in "abc" for i in range(5)} | {"z": "z"}
    with pytest.raises(RuntimeError):
        G.local_moving(e, max_sweeps=1)
    h = G.hierarchy(e, levels=2).collect()
    assert {r.node: r.level_0_community for r in h} == got and len({r.level_1_community for r in h}) >= 4
    assert G.local_moving(e.limit(0)).count() == 0


def gains(edges, label, gamma):
    """What each node would gain by its best move, to a community beside it or to be alone."""
    k, s, m = {}, {}, 2 * sum(w for _, _, w in edges)
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    for n, c in label.items():
        s[c] = s.get(c, 0) + k[n]
    out = {}
    for n, own in label.items():
        links = {}
        for a, b, w in edges:
            if n in (a, b) and a != b:
                c = label[a if b == n else b]
                links[c] = links.get(c, 0) + w
        worth = {c: links.get(c, 0) - gamma * k[n] * (s[c] - k[n] * (c == own)) / m for c in {own, *links}}
        out[n] = max(0, *worth.values()) - worth[own]
    return out


def test_communities_settle_where_many_want_the_same(spark):
    """Sixty nodes between four hubs, none beside another: all at once they overfill each hub in turn."""
    edges = [(f"hub{h}", f"n{i:02d}", 1) for i in range(60) for h in range(4)]
    got = {r.node: r.community for r in G.local_moving(spark.createDataFrame(edges, "source string, target string, weight int"), max_sweeps=30).collect()}
    assert len(got) == 64 and max(gains(edges, got, 1.0).values()) <= 1e-9


def test_resolutions_share_one_graph(spark):
    """No node gains at any resolution, in one block or several; the edges are made once, not once a level."""
    rng, made = random.Random(5), []
    edges = sorted({(*sorted(rng.sample([f"v{i:02d}" for i in range(40)], 2)), 1 + i % 3) for i in range(90)})
    edges = [(a, b, w) for (a, b), w in {(a, b): w for a, b, w in edges}.items()]
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda w: (seen.add(1), w)[1], "int").asNondeterministic()
    df = spark.createDataFrame(edges, "source string, target string, weight int").withColumn("weight", count("weight"))
    for block_edges in (1000, 83):
        before = seen.value
        rows = G.hierarchy(df, levels=2, block_edges=block_edges).collect()
        made.append(seen.value - before)
        for n in range(2):
            label = {r.node: r[f"level_{n}_community"] for r in rows}
            assert max(gains(edges, label, 2.0**n).values()) <= 1e-9
            assert all(c == min(v for v in label if label[v] == c) for c in label.values())
    assert made == [len(edges)] * 2


def test_scratch_space_on_a_cluster():
    """Without a shared folder a cluster is refused; a folder set on the session or on its context is taken."""
    conf = SimpleNamespace(get=lambda k, d=None: {"spark.checkpoint.dir": "file:///shared"}.get(k, d))
    unset = SimpleNamespace(get=lambda k, d=None: d)
    folder = lambda x: SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: x is not None, get=lambda: x))))
    assert session.scratch_root(SimpleNamespace(conf=conf, sparkContext=folder(None))) == "file:///shared"
    assert session.scratch_root(SimpleNamespace(conf=unset, sparkContext=folder("hdfs://x/y"))) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        session.scratch_root(SimpleNamespace(conf=unset, sparkContext=folder(None)))


def test_heuristic_spans_by_hand():
    text = "Yesterday Dr. Mira Solwen met Paul in Ostwick; a Bank of Ostwick (Harbour Mill) Inc. paid; 华为 too. The CEO left New Wexley"
    got = [(s, label, name) for _, _, s, label, name, _ in H.heuristic_spans(text)]
    assert got == [
        ("Dr", "PER", "one word"), ("Dr. Mira Solwen", "PER", "with a title"), ("Paul", "PER", "listed given name"), ("Ostwick", "LOC", "after a place word"), ("Bank of Ostwick (Harbour Mill) Inc", "ORG", "company ending"),
        ("华为", "ORG", "listed"), ("New Wexley", "LOC", "place prefix"),
    ]
    for s, e, surface, *_ in H.heuristic_spans(text):
        assert text[s:e] == surface
    assert H.heuristic_spans("") == [] and H.heuristic_spans("   \n") == [] and H.heuristic_spans("the end") == []
    assert [x[2] for x in H.heuristic_spans("Apple")] == ["Apple"] and H.heuristic_spans("Zorblat") == []


def test_rule_spans_by_hand():
    text = "The Aldmoor Institute hired Dr. Wren Halloway. Halloway joined NASA in Paris on 2020-01-02 for $5 million, 7% more, said Given Names and Chen"
    got = [(surface, label) for _, _, surface, label, _, _ in H.rule_spans(text)]
    assert ("Aldmoor Institute", "ORG") in got and ("Dr. Wren Halloway", "PER") in got and ("NASA", "ORG") in got and ("Paris", "LOC") in got
    assert ("2020-01-02", "DATE") in got and ("7%", "PERCENT") in got and ("Chen", "PER") in got and not any(s.startswith(("The ", "Given")) for s, _ in got)
    spans = sorted((a, b) for a, b, *_ in H.rule_spans(text))
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_very_long_text_is_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        text = "Mira Solwen of Ostwick met Dr. Paul, in Wexley. " * (n // 48)
        began = time.time()
        H.heuristic_spans(text), H.rule_spans(text)
        took.append(time.time() - began)
    assert took[1] < 12 * max(took[0], 0.02)


def test_boxes_are_trained_as_a_table(spark):
    from spanloom.operators import boxes as B

    vec = spark.createDataFrame([(i, [float(i % 2) * 3 + 0.2 * i, 0.1 * i]) for i in range(6)] + [(99, None)], "id bigint, vector array<double>")
    pairs = spark.createDataFrame([(i, j, i % 2 == j % 2) for i in range(6) for j in range(i)] + [(1, 77, True), (None, 2, True)], "left bigint, right bigint, same boolean")
    got = {r.id: (r.low, r.high) for r in B.train_boxes_table(pairs, vec, epochs=6, rate=0.3).collect()}
    assert set(got) == set(range(6)) and all(a < b for low, high in got.values() for a, b in zip(low, high))
    share = lambda a, b: max(0.0, min(got[a][1][0], got[b][1][0]) - max(got[a][0][0], got[b][0][0])) * max(0.0, min(got[a][1][1], got[b][1][1]) - max(got[a][0][1], got[b][0][1]))
    same = [share(i, j) for i in range(6) for j in range(i) if i % 2 == j % 2]
    other = [share(i, j) for i in range(6) for j in range(i) if i % 2 != j % 2]
    assert min(same) > max(other)
    assert B.train_boxes_table(pairs, vec.limit(0), epochs=1).count() == 0
