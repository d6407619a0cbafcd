"""Extractors that read a text in order: heuristic and rule-based entities, layered stacks, decoding, prompts.

Each reads whole texts in Arrow batches where they lie; per-document resolvers group by document, whose spans
are as many as its text allows. Null and empty texts give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claims import Claims
from .heuristics import heuristic_spans, rule_spans
from .matching import islands
from .patterns import PATTERNS, claim

ENTITIES = "doc_id bigint, start_char int, end_char int, surface string, label string, rule string, confidence double"

def _extract(documents: DataFrame, f: Callable[[str], list]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *x) for i, t in zip(b["doc_id"], b["text"]) for x in f(t)], columns=[c.split()[0] for c in ENTITIES.split(", ")])

    return documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, ENTITIES)


def heuristic_entities(documents: DataFrame, threshold: float = 0.35) -> DataFrame:
    return _extract(documents, lambda t: heuristic_spans(t, threshold))


def rule_entities(documents: DataFrame) -> DataFrame:
    return _extract(documents, rule_spans)


STRATEGIES = ("priority", "longest", "confidence", "union")


def resolve_layers(layers: list[list[tuple]], strategy: str = "priority") -> list[tuple]:
    """Spans (start, end, surface, label, rule, confidence) of layers in order, made to agree.

    A span that overlaps none is taken. One that overlaps is dropped (priority), or replaces the best of those it
    overlaps if it is longer (longest) or surer (confidence), the first of equals; the others it overlaps go in any case.
    `union` keeps all. What is taken lies apart, so the spans that another overlaps are neighbours, found by bisection."""
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    spans = [x for layer in layers for x in layer if x[0] < x[1]]
    if strategy == "union":
        return sorted(spans, key=lambda y: (y[0], y[1]))
    worth = (lambda y: y[1] - y[0]) if strategy == "longest" else (lambda y: y[5])
    taken: list[tuple] = []
    starts: list[int] = []
    for x in spans:
        hi = bisect_left(starts, x[1])
        lo = hi
        while lo and taken[lo - 1][1] > x[0]:
            lo -= 1
        if lo == hi:
            taken.insert(lo, x)
            starts.insert(lo, x[0])
        elif strategy != "priority":
            best = max(taken[lo:hi], key=worth)
            keep = x if worth(x) > worth(best) else best
            taken[lo:hi] = [keep]
            starts[lo:hi] = [keep[0]]
    return taken


def stacked_entities(documents: DataFrame, strategy: str = "priority") -> DataFrame:
    """Patterns, then heuristics, in one pass over each text."""
    compiled = [(re.compile(p), name, label, sure) for name, p, label, sure in PATTERNS]
    return _extract(documents, lambda t: resolve_layers([claim(t, compiled), heuristic_spans(t)], strategy))


# --- decoding of scored candidates ----------------------------------------------------------------------


def greedy_decode(cells: DataFrame, threshold: float, order: str = "position") -> DataFrame:
    """Non-overlapping spans of scored candidates (doc_id, start, end, label, score) at or above a threshold.

    `position`: by start, end, then score; `short`: shorter spans first; `score`: the surest first; ties by the label. Only
    spans of one island of overlapping ones compete, so an island, not a document, is decided at once."""
    keys = {"position": lambda x: (x[0], x[1], -x[3], x[2]), "short": lambda x: (x[1] - x[0], -x[3], x[0], x[2]), "score": lambda x: (-x[3], x[0], x[1], x[2])}[order]
    c = cells.where(F.col("score") >= threshold).select("doc_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.coalesce("label", F.lit("")).alias("id"), "score")
    grouped = islands(c).groupBy("doc_id", "island").agg(F.collect_list(F.struct("start_char", "end_char", "id", "score")).alias("xs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, xs in zip(b["doc_id"], b["xs"]):
                claims = Claims()
                out += [(doc, *x) for x in sorted(((x["start_char"], x["end_char"], x["id"], x["score"]) for x in xs), key=keys) if claims.take(x[0], x[1])]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "label", "score"])

    return grouped.mapInPandas(run, "doc_id bigint, start int, end int, label string, score double")


def span_candidates(tokens: DataFrame, max_width: int) -> DataFrame:
    """(seq, first, last): all spans of at most max_width tokens of a sequence of n tokens (seq, n)."""
    s = tokens.where("n > 0").withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return s.withColumn("last", F.explode(F.sequence("first", F.least(F.col("first") + max_width, F.col("n")) - 1))).select("seq", "first", "last")


# --- prompts --------------------------------------------------------------------------------------------


def prompts(documents: DataFrame, labels: list[str]) -> DataFrame:
    """(doc_id, prompt): a request for the entities of a text as a JSON array."""
    head = "Find every entity of these types: " + ", ".join(labels) + ".\nAnswer with a JSON array of objects with text, type, start and end.\nText:\n"
    return documents.where(F.col("text").isNotNull()).select("doc_id", F.concat(F.lit(head), "text").alias("prompt"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """(doc_id, text, type, start, end) from answers: what stands from the first [ to the last ], objects with all fields."""
    array = F.regexp_extract("response", r"(?s)\[.*\]", 0)
    r = responses.select("doc_id", F.explode(F.from_json(array, "array<struct<text:string,type:string,start:int,end:int>>")).alias("x"))
    return r.select("doc_id", "x.*").where("text IS NOT NULL AND type IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
