"""Extractors by name: what each can do, stacks of them, and the choice of one.

An extractor is a function of a text that returns (start, end, surface, label, rule, confidence) rows. It runs in Arrow batches where
the texts lie; several of a stack share one pass. Neural models plug in the same way: `register` a function that loads its weights
when first called in a worker."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .extractors import _extract, resolve_layers
from .heuristics import heuristic_spans, rule_spans
from .patterns import PATTERNS, claim

Found = tuple[int, int, str, str, str, float]


@dataclass(frozen=True)
class Extractor:
    name: str
    find: Callable[[str], list[Found]]
    labels: frozenset[str]
    abilities: frozenset[str] = field(default_factory=frozenset)  # named, structured, batch, streaming, any_label, relations
    ready: Callable[[], bool] = lambda: True


_COMPILED: list = []


def _patterns(text: str) -> list[Found]:
    if not _COMPILED:
        _COMPILED.extend((re.compile(p), name, label, sure) for name, p, label, sure in PATTERNS)
    return claim(text, _COMPILED)


EXTRACTORS: dict[str, Extractor] = {}


def register(extractor: Extractor) -> Extractor:
    """Adds an extractor, or replaces the one of that name."""
    EXTRACTORS[extractor.name] = extractor
    return extractor


register(Extractor("pattern", _patterns, frozenset(x[2] for x in PATTERNS), frozenset({"structured", "batch", "streaming"})))
register(Extractor("heuristic", heuristic_spans, frozenset({"PER", "ORG", "LOC"}), frozenset({"named", "batch", "streaming"})))
register(Extractor("rule", rule_spans, frozenset({"PER", "ORG", "LOC", "DATE", "MONEY", "PERCENT", "CONCEPT", "UNKNOWN"}), frozenset({"named", "structured", "batch", "streaming"})))

# Layers of the stacks, the first one first.
STACKS = {"default": ["pattern", "heuristic"], "pattern_only": ["pattern"], "heuristic_only": ["heuristic"], "rules_first": ["rule", "pattern"], "all": ["pattern", "rule", "heuristic"]}


def canned(name: str, spans: list[Found], checked: bool = False) -> Extractor:
    """An extractor that says the same of every text: those of its spans that lie in it, or, checked, whose surface it holds
    there."""

    def find(text: str) -> list[Found]:
        inside = [x for x in spans if 0 <= x[0] < x[1] <= len(text)]
        return [x for x in inside if text[x[0] : x[1]] == x[2]] if checked else inside

    return Extractor(name, find, frozenset(x[3] for x in spans))


def layers(choice: str | list[str]) -> list[Extractor]:
    """The extractors of a stack, of one name, or of a list of names; those that are not ready are left out."""
    names = STACKS.get(choice, [choice]) if isinstance(choice, str) else choice
    unknown = [n for n in names if n not in EXTRACTORS]
    if unknown:
        raise ValueError(f"no extractor {', '.join(unknown)}; there are {', '.join([*STACKS, *EXTRACTORS])}")
    found = [EXTRACTORS[n] for n in names if EXTRACTORS[n].ready()]
    if not found:
        raise RuntimeError(f"none of {', '.join(names)} is ready")
    return found


def extract(documents: DataFrame, choice: str | list[str] = "default", strategy: str = "priority", labels: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """(doc_id, start_char, end_char, surface, label, rule, confidence) by a stack, in one pass. A layer that fails on a text is left
    out for that text if another has found something, else the error stands."""
    stack = layers(choice)

    def find(text: str) -> list[Found]:
        rows, error = [], None
        for x in stack:
            try:
                rows.append(x.find(text))
            except Exception as e:  # noqa: BLE001
                error = e
        if error and not any(rows):
            raise error
        return resolve_layers(rows, strategy)

    found = _extract(documents, find).where(F.col("confidence") >= threshold)
    return found if labels is None else found.where(F.lower("label").isin([x.lower() for x in labels]))


def auto(documents: DataFrame, wanted: list[str] | None = None, **how) -> DataFrame:
    """`extract` by the first ready stack whose extractors know all wanted labels, the default stack if none does."""
    for name, names in STACKS.items():
        ready = [EXTRACTORS[n] for n in names if EXTRACTORS[n].ready()]
        if ready and set(wanted or []) <= set().union(*(x.labels for x in ready)):
            return extract(documents, name, labels=wanted, **how)
    return extract(documents, "default", labels=wanted, **how)


def hybrid(primary: DataFrame, patterns: DataFrame) -> DataFrame:
    """All of a primary extractor, and those of the patterns that overlap none of it: an anti-join over overlaps in buckets. Both have
    doc_id, start_char, end_char, surface, label, confidence."""
    cols = ["doc_id", "start_char", "end_char", "surface", "label", "confidence"]
    both = primary.select(*cols, F.lit(0).alias("side")).unionByName(patterns.select(*cols, F.lit(1).alias("side")))
    key = F.struct("doc_id", "start_char", "end_char", "side", "label")
    keyed = both.withColumn("key", key)
    pairs = S.overlapping_pairs(keyed, "key")
    clash = pairs.where(F.col("left.side") != F.col("right.side")).select(F.when(F.col("left.side") == 1, F.col("left")).otherwise(F.col("right")).alias("key")).distinct()
    return keyed.where((F.col("side") == 0) | (F.col("start_char") < F.col("end_char"))).join(clash, "key", "left_anti").select(*cols)
