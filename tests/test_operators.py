"""Operators on small fixtures: what SQL does not cover."""

import random

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import evaluate as E
from spanloom.operators import graph as G
from spanloom.operators import matching as M
from spanloom.operators import patterns as P
from spanloom.operators import resolve as R
from spanloom.operators import spans as S
from spanloom.streaming import windows as W


def _one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_clean_whitespace(spark):
    for text, want in [(" a \r\n\n b\t\tc ", "a \nb c"), ("\n\nx", "x"), ("a \n b", "a \nb"), ("", ""), (None, None), ("a b", "a b")]:
        assert _one(spark, X.clean_whitespace, text) == want


def test_language_by_script(spark):
    for text, want in [("hello", "en"), ("größer Straße", "de"), ("été", "fr"), ("привет", "ru"), ("漢字かな", "ja"), ("汉字", "zh"), ("123", "en"), ("سلام", "ar"), ("한국", "ko")]:
        assert _one(spark, X.language_by_script, text) == want


def test_html(spark):
    page = "<html><style>p{}</style><body><p>A &amp; B</p><script>x<y</script><div>C&nbsp;D</div>\n\n<b>E</b> &unknown;</body></html>"
    assert _one(spark, X.html_to_text, page) == "A & B C D\nE &unknown;"


def test_patterns_claim_in_order(spark):
    text = "On 2020-01-02 at 10:30 pay $5 million, 7%, a@b.org https://x.y/z @me #tag +1 415 555 0100 é 3 mars 2020"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = {(r.surface, r.label) for r in P.pattern_stack(d).collect()}
    assert {("2020-01-02", "DATE"), ("10:30", "TIME"), ("$5 million", "MONEY"), ("7%", "PERCENT"), ("a@b.org", "EMAIL"), ("https://x.y/z", "URL"), ("@me", "MENTION"), ("#tag", "HASHTAG"), ("3 mars 2020", "DATE")} <= got
    for r in P.pattern_stack(d).collect():
        assert text[r.start_char : r.end_char] == r.surface
    rows = sorted((r.start_char, r.end_char) for r in P.pattern_stack(d).collect())
    assert all(a[1] <= b[0] for a, b in zip(rows, rows[1:]))
    assert [(r.start_char, r.surface) for r in P.pattern_spans(d, r"\d+%").collect()] == [(text.index("7%"), "7%")]


def test_overlaps_against_brute_force(spark):
    random.seed(1)
    rows = [(i, i % 3, s, s + random.randint(1, 400)) for i in range(120) for s in [random.randint(0, 3000)]]
    df = spark.createDataFrame([*rows, (900, 1, None, 5), (901, 1, 7, 7)], "pred_id bigint, doc_id bigint, start_char int, end_char int")
    got = {(r.left, r.right) for r in S.overlapping_pairs(df).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]}


def test_compare_spans(spark):
    schema = "doc_id bigint, id bigint, start_char int, end_char int, label string"
    gold = spark.createDataFrame([(1, 1, 0, 5, "A"), (1, 2, 10, 15, "B"), (1, 3, 20, 30, "A"), (1, 4, 40, 45, "A"), (1, 5, None, 9, "A")], schema)
    pred = spark.createDataFrame([(1, 11, 0, 5, "A"), (1, 12, 10, 15, "A"), (1, 13, 25, 35, "A"), (1, 14, 60, 65, "A"), (2, 15, 0, 3, "A")], schema)
    got = {(r.kind, r.gold_id, r.pred_id) for r in M.compare(gold, pred).collect()}
    assert got == {("correct", 1, 11), ("type_mismatch", 2, 12), ("boundary", 3, 13), ("missed", 4, None), ("spurious", None, 14), ("spurious", None, 15)}


def test_matching_by_islands_equals_matching_by_documents(spark):
    random.seed(8)
    schema = "doc_id bigint, id bigint, start_char int, end_char int, label string"
    make = lambda base: [(d, base + 100 * d + i, s, s + random.randint(0, 9), random.choice("AB")) for d in range(6) for i in range(25) for s in [random.randint(0, 120)]]
    g, p = make(0), make(10_000)
    order = lambda rows, d: sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[3], r[1]))
    rank = lambda a, b: (4 if a[4] == b[4] else 3) if a[2:4] == b[2:4] else (2 if a[4] == b[4] else 1) if a[2] < b[3] and b[2] < a[3] else 0
    want = set()
    for d in range(6):
        free = order(p, d)
        for x in order(g, d):
            best = max(free, key=lambda y: rank(x, y), default=None)  # noqa: B023
            if best and rank(x, best):
                free.remove(best)
                want.add((x[1], best[1], rank(x, best)))
            else:
                want.add((x[1], None, 0))
        want |= {(None, y[1], 0) for y in free}
    kinds = {"exact": 4, "exact_other_type": 3, "partial": 2, "partial_other_type": 1, "missed": 0, "spurious": 0}
    gold, pred = spark.createDataFrame(g, schema), spark.createDataFrame(p, schema)
    got = M.evaluate_ner(gold, pred).collect()
    assert {(r.gold_id, r.pred_id, kinds[r.kind]) for r in got} == want
    muc = {r["mode"]: r for r in M.muc_modes(M.evaluate_ner(gold, pred)).collect()}
    assert muc["strict"].correct == sum(1 for x in want if x[2] == 4) and muc["partial"].partial == sum(1 for x in want if x[2] in (1, 2))
    assert M.hit_scores(M.matched_in_mode(gold, pred.limit(0), "strict")).first().f1 == 0.0 and M.evaluate_ner(gold.limit(0), pred.limit(0)).count() == 0
    same = M.hit_scores(M.matched_in_mode(gold, gold, "strict")).first()
    assert (same.precision, same.recall, same.n_hit) == (1.0, 1.0, 150)


def test_coreference_by_hand(spark):
    schema = "doc_id bigint, mention bigint, cluster string"
    key = spark.createDataFrame([(1, m, c) for m, c in zip(range(1, 6), "aaabb")], schema)
    response = spark.createDataFrame([(1, m, c) for m, c in zip(range(1, 6), "xxyyy")], schema)
    r = lambda df: tuple(round(v, 4) for v in df.first())
    assert r(E.muc(key, response).select("precision", "recall")) == (0.6667, 0.6667)
    assert r(E.b_cubed(key, response).select("precision", "recall")) == (round((2 * 1 + 1 / 3 + 2 * 2 / 3) / 5, 4), round((2 * 2 / 3 + 1 / 3 + 2 * 1) / 5, 4))
    assert r(E.b_cubed(key, key).select("f1")) == (1.0,) and r(E.lea(key, key).select("f1")) == (1.0,) and r(E.blanc(key, key).select("f1")) == (1.0,)
    assert r(E.ceaf(key, response).select("precision", "recall")) == (0.8, 0.8)
    assert r(E.ceaf(key, key, dice=True).select("f1")) == (1.0,)
    assert E.b_cubed(key.limit(0), response).first().f1 == 0.0


def test_components_chain_and_hub(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(500, 500 + k) for k in range(1, 80)] + [(900, 900)]
    random.shuffle(pairs)
    e = spark.createDataFrame(pairs, "source bigint, target bigint")
    got = {r.node: r.component for r in G.components(e).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{500 + k: 500 for k in range(80)}, 900: 900}
    lone = spark.createDataFrame([(7777,), (5,)], "node bigint")
    assert {r.node: r.component for r in G.components(e, lone).collect()} == {7777: 7777, 5: 0}


def test_jaccard_pairs_against_brute_force(spark):
    random.seed(9)
    rows = [(i, " ".join(random.sample("a b c d e f g h".split(), random.randint(1, 5)))) for i in range(120)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(rows, "id bigint, name string")
    sets = {i: set(n.split()) for i, n in rows if n}
    text = {i: n for i, n in rows if n}
    of = {r.member: r.representative for r in R.equal_classes(df).collect()}
    assert all(of[i] == min(j for j in text if text[j] == text[i]) for i in text)
    for t in (0.3, 0.5, 0.8, 1.0):
        got = {(r.left, r.right): r.links for r in R.jaccard_pairs(df, t).collect()}
        want: dict = {}
        for a in sets:
            for b in sets:
                if a < b and text[a] != text[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t:
                    k = tuple(sorted((of[a], of[b])))
                    want[k] = want.get(k, 0) + 1
        assert got == want


def test_chunks_cover(spark):
    d = spark.createDataFrame([(1, "abcdefghij" * 37), (2, ""), (3, None), (4, "x")], "doc_id bigint, text string")
    rows = W.chunks(d, 100, 20).collect()
    text = "abcdefghij" * 37
    seen = sorted((r.offset, r.text) for r in rows if r.doc_id == 1)
    assert all(text[o : o + len(x)] == x for o, x in seen) and seen[-1][0] + len(seen[-1][1]) == len(text)
    assert {r.doc_id for r in rows} == {1, 2, 4}


def test_boxes(spark):
    from spanloom.operators import boxes as B
    from spanloom.operators import vectors as V

    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    row = spark.range(1).select(
        V.volume(arr(0, 0), arr(2, 3)).alias("v"), V.intersection(arr(0, 0), arr(2, 2), arr(1, 1), arr(3, 3)).alias("i"), V.box_coref(arr(0, 0), arr(2, 2), arr(1, 1), arr(3, 3)).alias("c"),
        B.box_at(arr(0, 0), arr(1, 2), F.lit(1.0), F.lit(5.0), F.lit(3.0)).alias("at"), B.box_at(arr(0, 0), arr(1, 2), F.lit(1.0), F.lit(5.0), F.lit(5.0)).alias("after"),
        B.box_confidence(arr(0), arr(1)).alias("s"), B.soft_membership(arr(0.5), arr(0), arr(1), 0.01).alias("m"), B.interaction(arr(0), arr(2), (arr(1), arr(3)), (arr(0), arr(5))).alias("k"),
    ).first()
    assert (row.v, row.i, row.c, row["at"], row.after, row.s, row.k) == (6.0, 1.0, 0.25, [2.0, 4.0], None, 0.5, 0.5) and row.m > 0.99
    vec = spark.createDataFrame([(i, [float(i % 2) * 3 + 0.2 * i, 0.1 * i]) for i in range(8)], "id bigint, vector array<double>")
    pairs = spark.createDataFrame([(i, j, i % 2 == j % 2) for i in range(8) for j in range(i)], "left bigint, right bigint, same boolean")
    got = B.train_boxes(pairs, vec, epochs=60)
    share = lambda a, b: (max(0.0, min(got[a][1][0], got[b][1][0]) - max(got[a][0][0], got[b][0][0])) * max(0.0, min(got[a][1][1], got[b][1][1]) - max(got[a][0][1], got[b][0][1])))
    same = [share(i, j) for i in range(8) for j in range(i) if i % 2 == j % 2]
    other = [share(i, j) for i in range(8) for j in range(i) if i % 2 != j % 2]
    assert min(same) > max(other)
    assert B.train_boxes(pairs, vec.limit(0)) == {}


def test_further_comparisons(spark):
    schema = "doc_id bigint, segments array<struct<start:int,end:int>>, label string"
    g = spark.createDataFrame([(1, [(0, 3), (8, 9)], "A"), (1, [(20, 22)], "A")], schema)
    p = spark.createDataFrame([(1, [(8, 9), (0, 3)], "A"), (1, [(20, 21), (21, 22)], "A")], schema)
    assert tuple(E.discontinuous_counts(g, p).first()) == (2, 2, 1, 2)
    r = "doc_id bigint, head_start int, head_end int, tail_start int, tail_end int, relation string"
    a = spark.createDataFrame([(1, 0, 3, 5, 8, "Knows")], r)
    b = spark.createDataFrame([(1, 5, 8, 0, 3, "knows")], r)
    assert E.relation_counts(a, b).first().n_correct == 0 and E.relation_counts(a, b, directed=False).first().n_correct == 1
    box = lambda *x: tuple(F.lit(float(v)) for v in x)
    assert spark.range(1).select(E.box_iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("v")).first().v == 1 / 7


def test_mentions_resolve_across_documents(spark, tmp_path):
    """Equal mentions stand as one with their count; every mention, whatever its document and label notation, has an identity."""
    from spanloom import queries as core

    names = ["Ada Byron Lovelace"] * 300 + ["ada  byron lovelace", "Lovelace Byron Ada", "Ada Byron", "Paris", "Paris"]
    labels = ["PER", "B-PER", "person"] * 100 + ["PER", "PER", "PER", "LOC", None]
    rows = [(i, i % 7, n, x) for i, (n, x) in enumerate(zip(names, labels))] + [(900, 1, None, "PER"), (901, 1, " ", "PER")]
    spark.createDataFrame(rows, "pred_id bigint, doc_id bigint, text string, label string").write.parquet(f"{tmp_path}/predictions.parquet")
    run = lambda name: core.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.left_id, r.right_id, r.links) for r in run("mention_jaccard_pairs")} == {(0, 300, 300), (0, 301, 300), (300, 301, 1), (0, 302, 300), (300, 302, 1), (301, 302, 1)}
    assert all(r.left_id < r.right_id for r in run("mention_candidates"))
    assert {r.pred_id: r.identity for r in run("mention_identities")} == {**dict.fromkeys(range(302), 0), 302: 302, 303: 303, 304: 304, 901: 901}
    assert {(r.identity, r.n_mentions, r.n_names) for r in run("mention_clusters")} == {(0, 302, 3), (302, 1, 1), (303, 1, 1), (304, 1, 1), (901, 1, 1)}


def test_overlapping_boxes_need_no_neighbouring_ids(spark):
    from spanloom.operators import vectors as V

    rows = [(0, [0.0, 0.0]), (1, [50.0, 50.0]), (17, [1.0, 0.0]), (400, [0.0, 0.5]), (900, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    score = {b: max(0, 4 - abs(x)) * max(0, 4 - abs(y)) / 16 for b, (x, y) in rows[1:]}
    want = sorted(((-s, b) for b, s in score.items() if s > 0))[:2]
    got = sorted((r["rank"], r.neighbour_id, round(r.score, 9)) for r in V.box_search(df, df.where("vec_id = 0"), 2, 2.0).collect())
    assert got == [(i + 1, b, round(-s, 9)) for i, (s, b) in enumerate(want)]
