"""One-to-one matching of predicted spans with gold ones, and the counts that follow from it.

Spans of a document that do not touch, directly or through others, cannot compete for a partner. So each document is cut into
islands of overlapping spans by one window, and an island, not a document, is what a Python function sees: a long document,
or one with a third of all spans, is as many small pieces of work as it has islands. Inside an island everything is in
reading order (start, end, id). Rows without offsets match nothing and are left out on both sides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Span = tuple[int, int, int, str]  # start, end, id, label
MATCHED = "doc_id bigint, kind string, gold_id bigint, pred_id bigint, gold_label string, pred_label string, iou double"
MODES = ("strict", "exact", "partial", "type")


def islands(spans: DataFrame) -> DataFrame:
    """Spans with the number of their island in the document, as column `island`."""
    w = Window.partitionBy("doc_id").orderBy("start_char", "end_char", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = spans.withColumns({"__reach": F.max("end_char").over(before), "__s": F.lag("start_char").over(w), "__e": F.lag("end_char").over(w)})
    apart = F.col("__reach").isNull() | ((F.col("start_char") >= F.col("__reach")) & ~((F.col("start_char") == F.col("__s")) & (F.col("end_char") == F.col("__e"))))
    return s.withColumn("island", F.sum(apart.cast("int")).over(w)).drop("__reach", "__s", "__e")


def overlap_iou(a: Span, b: Span) -> float:
    common = min(a[1], b[1]) - max(a[0], b[0])
    union = (a[1] - a[0]) + (b[1] - b[0]) - max(0, common)
    return max(0, common) / union if union else float(a[:2] == b[:2])


def by_island(gold: DataFrame, predicted: DataFrame, decide: Callable[[list[Span], list[Span]], list[tuple[str, Span | None, Span | None]]]) -> DataFrame:
    """What a function says of the gold and predicted spans (doc_id, id, start_char, end_char, label) of every island."""
    cols = ["doc_id", "id", "start_char", "end_char", "label"]
    whole = "start_char IS NOT NULL AND end_char IS NOT NULL AND start_char <= end_char"
    both = gold.select(*cols, F.lit(True).alias("gold")).unionByName(predicted.select(*cols, F.lit(False).alias("gold"))).where(whole)
    spans = F.sort_array(F.collect_list(F.struct("start_char", "end_char", "id", "label", "gold")))
    grouped = islands(both).groupBy("doc_id", "island").agg(spans.alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, spans in zip(b["doc_id"], b["spans"]):
                rows = [(int(x["start_char"]), int(x["end_char"]), int(x["id"]), x["label"], x["gold"]) for x in spans]
                for kind, g, p in decide([r[:4] for r in rows if r[4]], [r[:4] for r in rows if not r[4]]):
                    out.append((doc, kind, g and g[2], p and p[2], g and g[3], p and p[3], overlap_iou(g, p) if g and p else 0.0))
            r = pd.DataFrame(out, columns=[c.split()[0] for c in MATCHED.split(", ")])
            yield r.astype({"gold_id": "Int64", "pred_id": "Int64"})

    return grouped.mapInPandas(run, MATCHED)


def _rest(gold: list[Span], predicted: list[Span], used: dict[int, int]) -> list[tuple[str, Span | None, Span | None]]:
    taken = set(used.values())
    return [("missed", g, None) for k, g in enumerate(gold) if k not in used] + [("spurious", None, p) for j, p in enumerate(predicted) if j not in taken]


def _by_priority(gold: list[Span], predicted: list[Span]) -> list[tuple[str, Span | None, Span | None]]:
    names = {4: "exact", 3: "exact_other_type", 2: "partial", 1: "partial_other_type"}
    used: dict[int, int] = {}
    free = dict(enumerate(predicted))
    out = []
    for k, g in enumerate(gold):
        best, rank = None, 0
        for j, p in free.items():
            if p[0] > g[1]:
                break
            same, typed = p[:2] == g[:2], p[3] == g[3]
            r = (4 if typed else 3) if same else (2 if typed else 1) if p[0] < g[1] and g[0] < p[1] else 0
            if r > rank:
                best, rank = j, r
        if best is not None:
            used[k] = best
            out.append((names[rank], g, free.pop(best)))
    return out + _rest(gold, predicted, used)


def evaluate_ner(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, kind, gold_id, pred_id, gold_label, pred_label, iou): every gold span, in order, takes the free prediction that
    fits it best: same span and label (exact), same span (exact_other_type), overlap with the label (partial) or without
    (partial_other_type), the first of equals; what is left over is missed or spurious."""
    return by_island(gold, predicted, _by_priority)


def compare(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The same columns: predictions, in order, take the first free gold of the same span (correct, type_mismatch), the others
    then the first free gold that they overlap (boundary, or boundary_and_type if the label differs, too)."""

    def decide(gold: list[Span], predicted: list[Span]) -> list[tuple[str, Span | None, Span | None]]:
        used: dict[int, int] = {}
        out, later = [], []
        for j, p in enumerate(predicted):
            k = next((k for k, g in enumerate(gold) if k not in used and g[:2] == p[:2]), None)
            if k is None:
                later.append(j)
            else:
                used[k] = j
                out.append(("correct" if gold[k][3] == p[3] else "type_mismatch", gold[k], p))
        for j in later:
            p = predicted[j]
            k = next((k for k, g in enumerate(gold) if k not in used and g[0] < p[1] and p[0] < g[1]), None)
            if k is not None:
                used[k] = j
                out.append(("boundary" if gold[k][3] == p[3] else "boundary_and_type", gold[k], p))
        return out + _rest(gold, predicted, used)

    return by_island(gold, predicted, decide)


def matched_in_mode(gold: DataFrame, predicted: DataFrame, mode: str, min_overlap: float = 0.0) -> DataFrame:
    """The same columns with kind hit, missed or spurious: predictions, in order, take the first free gold that fits the mode.

    strict wants span and label, exact the span, partial and type an overlap (with an IoU of at least min_overlap, if that
    is above 0) and the label."""
    if mode not in MODES:
        raise ValueError(mode)

    def fits(g: Span, p: Span) -> bool:
        if mode in ("strict", "exact"):
            return g[:2] == p[:2] and (mode == "exact" or g[3] == p[3])
        return g[3] == p[3] and g[0] < p[1] and p[0] < g[1] and (min_overlap <= 0 or overlap_iou(g, p) >= min_overlap)

    def decide(gold: list[Span], predicted: list[Span]) -> list[tuple[str, Span | None, Span | None]]:
        used: dict[int, int] = {}
        for j, p in enumerate(predicted):
            k = next((k for k, g in enumerate(gold) if k not in used and fits(g, p)), None)
            if k is not None:
                used[k] = j
        return [("hit", gold[k], predicted[j]) for k, j in used.items()] + _rest(gold, predicted, used)

    return by_island(gold, predicted, decide)


def partial_matches(gold: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same columns: predictions, in order, take the free gold of their label with the best IoU of at least the threshold."""

    def decide(gold: list[Span], predicted: list[Span]) -> list[tuple[str, Span | None, Span | None]]:
        used: dict[int, int] = {}
        for j, p in enumerate(predicted):
            rated = [(overlap_iou(g, p), -k) for k, g in enumerate(gold) if k not in used and g[3] == p[3]]
            best = max(rated, default=(0.0, 0))
            if rated and best[0] >= threshold:
                used[-best[1]] = j
        return [("hit", gold[k], predicted[j]) for k, j in used.items()] + _rest(gold, predicted, used)

    return by_island(gold, predicted, decide)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(correct: Column, predicted: Column, gold: Column) -> dict[str, Column]:
    p, r = _ratio(correct, predicted), _ratio(correct, gold)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}


def hit_scores(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n_hit, n_missed, n_spurious, precision, recall, f1) of matches of kind hit, missed, spurious. `by` may name
    `label`, that of the gold span or else of the prediction."""
    m = matches.withColumn("label", F.coalesce("gold_label", "pred_label"))
    n = m.groupBy(*(by or [])).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("hit", "missed", "spurious")])
    return n.withColumns(scores(F.col("n_hit"), F.col("n_hit") + F.col("n_spurious"), F.col("n_hit") + F.col("n_missed")))


def muc_modes(matches: DataFrame) -> DataFrame:
    """(mode, correct, incorrect, partial, missed, spurious, precision, recall, f1) of `evaluate_ner`, under four readings: strict
    wants span and label, exact the span, partial takes an overlap as half, type wants the label and any overlap."""
    n = {k: F.count_if(F.col("kind") == k) for k in ("exact", "exact_other_type", "partial", "partial_other_type", "missed", "spurious")}
    zero = F.lit(0).cast("long")
    readings = [
        ("strict", n["exact"], n["exact_other_type"] + n["partial"] + n["partial_other_type"], zero),
        ("exact", n["exact"] + n["exact_other_type"], n["partial"] + n["partial_other_type"], zero),
        ("partial", n["exact"] + n["exact_other_type"], zero, n["partial"] + n["partial_other_type"]),
        ("type", n["exact"] + n["partial"], n["exact_other_type"] + n["partial_other_type"], zero),
    ]
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), c.alias("correct"), i.alias("incorrect"), p.alias("partial"), n["missed"].alias("missed"), n["spurious"].alias("spurious")) for m, c, i, p in readings])
    r = matches.agg(rows.alias("x")).select(F.inline("x"))
    worth, found = F.col("correct") + F.col("partial") / 2, F.col("correct") + F.col("incorrect") + F.col("partial")
    return r.withColumns(scores(worth, found + F.col("spurious"), found + F.col("missed")))


def type_counts(matches: DataFrame) -> DataFrame:
    """(label, correct, incorrect, missed, spurious) by label, strictly: of the gold span, or of a spurious prediction."""
    exact = F.col("kind") == "exact"
    m = matches.withColumn("label", F.coalesce("gold_label", "pred_label"))
    return m.groupBy("label").agg(
        F.count_if(exact).alias("correct"), F.count_if(~exact & ~F.col("kind").isin("missed", "spurious")).alias("incorrect"),
        F.count_if(F.col("kind") == "missed").alias("missed"), F.count_if(F.col("kind") == "spurious").alias("spurious"),
    )


def goals_met(by_label: DataFrame, overall: DataFrame, goals: dict[str, dict[str, float]]) -> DataFrame:
    """(scope, metric, value, goal, met): least precision, recall and f1 of all (scope `overall`) and of labels; a label that no
    span has counts as 0."""
    rows = [(scope, metric, float(least)) for scope, wants in goals.items() for metric, least in wants.items()]
    wanted = overall.sparkSession.createDataFrame(rows, "scope string, metric string, goal double")
    metrics = ("precision", "recall", "f1")
    melt = lambda df, scope: df.select(scope.alias("scope"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))
    values = melt(overall, F.lit("overall")).unionByName(melt(by_label, F.col("label")))
    j = wanted.join(values, ["scope", "metric"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return j.select("scope", "metric", "value", "goal", (F.col("value") >= F.col("goal")).alias("met"))
