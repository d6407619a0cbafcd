import random

from spanloom.llm import grouping as g


def _brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(find(x), x) for x in list(root) if find(x) != x}


SCHEMA = "pair_id bigint, left_id bigint, right_id bigint, score double, matched boolean, group_id string"


def test_groups(spark):
    random.seed(3)
    pairs = [(i, i + 1) for i in range(1, 400)] + [(1000, 1000 + k) for k in range(1, 300)]  # a chain, a hub
    pairs += [(random.randint(2000, 2300), random.randint(2000, 2300)) for _ in range(200)]
    random.shuffle(pairs)
    rows = [(i, *(p if random.random() < 0.5 else p[::-1]), 0.5, True, "x") for i, p in enumerate(pairs)]
    rows += [rows[0], (9001, 5000, 5001, 0.9, False, None), (9002, 5002, 5003, 0.9, None, None), (9003, None, 5004, 0.9, True, None), (9004, 5005, 5005, None, True, None), (9005, 1, 2, 0.1, False, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = g.grouped_records(df)
    assert {(r.group_id, r.record_id) for r in got.collect()} == _brute([p for p in pairs if p[0] != p[1]])
    preds = spark.createDataFrame([(1, "a"), (399, "b"), (5005, "c")], "pred_id bigint, group_id string")
    assert {(r.pred_id, r.group_id) for r in g.group_entities(df, preds).collect()} == {(1, 1), (399, 1), (5005, 5005)}


def test_empty(spark):
    assert g.grouped_records(spark.createDataFrame([], SCHEMA)).count() == 0
    assert g.grouped_records(spark.createDataFrame([(1, 2, 2, 0.1, True, "")], SCHEMA)).count() == 0
