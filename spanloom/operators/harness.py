"""Extractors against annotated sets, and what came out as reports."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_label
from .matching import evaluate_ner, hit_scores, matched_in_mode, muc_modes
from .models import extract


def gold_of(examples: DataFrame) -> DataFrame:
    """(doc_id, id, start_char, end_char, label) of examples (doc_id, entities array<struct<text,label,start,end,confidence>>)."""
    e = examples.select("doc_id", F.posexplode("entities").alias("i", "e"))
    return e.select("doc_id", F.xxhash64("doc_id", "i").alias("id"), F.col("e.start").alias("start_char"), F.col("e.end").alias("end_char"), canonical_label(F.col("e.label")).alias("label"))


def found_by(examples: DataFrame, stack: str | list[str]) -> DataFrame:
    p = extract(examples.select("doc_id", "text"), stack)
    return p.select("doc_id", F.xxhash64("doc_id", "start_char", "end_char", "label").alias("id"), "start_char", "end_char", canonical_label(F.col("label")).alias("label"))


def grid(examples: DataFrame, stacks: list[str], domains: list[str] | None = None) -> DataFrame:
    """(stack, domain, mode, correct, incorrect, partial, missed, spurious, precision, recall, f1): every stack on the examples of every
    domain, under the four readings of `muc_modes`."""
    out = None
    for domain in domains or [r[0] for r in examples.select("domain").distinct().orderBy("domain").limit(1000).collect()]:
        part = examples.where(F.col("domain") == domain)
        for stack in stacks:
            one = muc_modes(evaluate_ner(gold_of(part), found_by(part, stack))).select(F.lit(stack).alias("stack"), F.lit(domain).alias("domain"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def by_stratum(examples: DataFrame, stack: str, stratum: str = "difficulty") -> DataFrame:
    """(stratum, label, n_hit, n_missed, n_spurious, precision, recall, f1): strict matches by label within each stratum."""
    of = examples.select("doc_id", F.col(stratum).alias("stratum"))
    m = matched_in_mode(gold_of(examples), found_by(examples, stack), "strict").join(of, "doc_id")
    return hit_scores(m, ["stratum", "label"])


def report(scores: DataFrame, title: str, limit: int = 1000) -> str:
    """A small table of scores as JSON: title, columns, rows; more than `limit` rows are refused."""
    rows = scores.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return json.dumps({"title": title, "columns": scores.columns, "rows": [r.asDict() for r in rows]}, ensure_ascii=False, default=str)


def report_html(scores: DataFrame, title: str, limit: int = 1000) -> str:
    """The same as a page with one table."""
    from html import escape

    r = json.loads(report(scores, title, limit))
    cell = lambda v: escape("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{escape(c)}</th>" for c in r["columns"])
    body = "".join("<tr>" + "".join(f"<td>{cell(x[c])}</td>" for c in r["columns"]) + "</tr>" for x in r["rows"])
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


class Timers:
    """How long named stretches of a driver's work took: count, total, least, most, mean."""

    def __init__(self) -> None:
        self._seconds: dict[str, list[float]] = {}

    class _Stretch:
        def __init__(self, into: list[float]):
            self.into = into

        def __enter__(self) -> None:
            self.began = time.perf_counter()

        def __exit__(self, *_: object) -> None:
            self.into.append(time.perf_counter() - self.began)

    def stretch(self, name: str) -> _Stretch:
        return self._Stretch(self._seconds.setdefault(name, []))

    def rows(self) -> list[dict]:
        return [{"name": n, "count": len(x), "total": sum(x), "min": min(x), "max": max(x), "mean": sum(x) / len(x)} for n, x in sorted(self._seconds.items()) if x]
