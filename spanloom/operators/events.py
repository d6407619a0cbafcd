"""Events: triggers of a lexicon in a text, with polarity, tense, and who takes part.

The lexicon is a parameter, {type: lemmas}; TRIGGERS is a small one of common verbs. Inflected forms are led back to a lemma by their
endings. Null and empty texts have no events."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Lemmas of triggers by type, words of negation, doubt and tense.
TRIGGERS = {
    "business:transaction": "sign sell buy acquire merge pay cost withdraw".split(),
    "movement:transport": "move transport ship deliver cross travel arrive leave".split(),
    "personnel:start": "join hire appoint elect".split(),
    "personnel:end": "resign retire dismiss quit".split(),
    "contact:meet": "meet visit discuss".split(),
    "contact:communicate": "tell announce report publish describe call write".split(),
    "justice:act": "reject sue charge convict".split(),
    "life:health": "repair cure treat injure".split(),
    "conflict:attack": "attack invade bomb strike kill fight".split(),
}
IRREGULAR = {"met": "meet", "told": "tell", "left": "leave", "sold": "sell", "bought": "buy", "paid": "pay", "withdrew": "withdraw", "wrote": "write", "struck": "strike", "fought": "fight", "sued": "sue"}
NEGATION = set("not no never n't didn't doesn't don't won't wouldn't cannot can't nobody none without hardly".split())
MODAL = set("may might could would should must possibly probably perhaps allegedly".split())
FUTURE, HYPOTHETICAL = set("will shall going".split()), set("would could might may".split())
EVENTS = "doc_id bigint, start_char int, end_char int, trigger string, event_type string, polarity string, tense string, agent string, patient string"
_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def lemmas_of(lexicon: dict[str, list[str]]) -> dict[str, str]:
    return {lemma: kind for kind, lemmas in lexicon.items() for lemma in lemmas}


def _lemma(word: str, lemmas: dict[str, str]) -> str | None:
    w = word.lower()
    if IRREGULAR.get(w, w) in lemmas:
        return IRREGULAR.get(w, w)
    for ending, adds in (("ied", ("y",)), ("ed", ("", "e")), ("ing", ("", "e")), ("es", ("", "e")), ("s", ("",))):
        if w.endswith(ending):
            stem = w[: -len(ending)]
            for x in [stem + a for a in adds] + ([stem[:-1]] if len(stem) > 2 and stem[-1] == stem[-2] else []):
                if x in lemmas:
                    return x
    return None


def event_spans(text: str, lemmas: dict[str, str]) -> list[tuple]:
    """(start, end, trigger, type, polarity, tense, agent, patient): the three words before a trigger tell polarity (negation before
    doubt) and tense; agent and patient are the nearest capitalised words among the five before and behind."""
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    out = []
    for k, (s, e, w) in enumerate(tokens):
        lemma = _lemma(w, lemmas)
        if not lemma:
            continue
        before = [x[2].lower() for x in tokens[max(0, k - 3) : k]]
        polarity = "negative" if NEGATION & set(before) else "uncertain" if MODAL & set(before) else "positive"
        tense = "future" if FUTURE & set(before) else "hypothetical" if HYPOTHETICAL & set(before) else "past" if w.lower().endswith("ed") or w.lower() in IRREGULAR else "present"
        agent = next((x[2] for x in reversed(tokens[max(0, k - 5) : k]) if x[2][0].isupper()), None)
        patient = next((x[2] for x in tokens[k + 1 : k + 6] if x[2][0].isupper()), None)
        out.append((s, e, w, lemmas[lemma], polarity, tense, agent, patient))
    return out


def events(documents: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, start_char, end_char, trigger, event_type, polarity, tense, agent, patient)"""
    lemmas = lemmas_of(lexicon or TRIGGERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *x) for i, t in zip(b["doc_id"], b["text"]) for x in event_spans(t, lemmas)], columns=[c.split()[0] for c in EVENTS.split(", ")])

    return documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, EVENTS)


ARGUMENT_GAP = 50  # characters between a trigger and a span that takes part


def event_arguments(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events with spans in place of words: agent is the last span that ends at most ARGUMENT_GAP characters before the trigger,
    patient the first that starts at most as many behind it; where there is none the word stays. Columns as `events`, and
    agent_id, patient_id (pred_id of the span).

    One window over triggers and span ends of a document, and one over span starts: no pairs."""
    s = spans.where("text IS NOT NULL AND start_char IS NOT NULL AND end_char IS NOT NULL")
    e = events.withColumn("__e", F.struct("start_char", "end_char"))  # one event a stretch
    ref = F.struct("pos", "id", "t")

    def nearest(at: str, span_at: str, forward: bool) -> DataFrame:
        marks = s.select("doc_id", F.col(span_at).alias("pos"), F.col("pred_id").alias("id"), F.col("text").alias("t"), F.lit(None).cast("struct<start_char:int,end_char:int>").alias("__e"))
        asks = e.select("doc_id", F.col(at).alias("pos"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("t"), "__e")
        order = [F.col("pos").asc() if not forward else F.col("pos").desc(), F.col("__e").isNotNull().cast("int"), F.col("id").asc() if not forward else F.col("id").desc()]
        w = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        j = marks.unionByName(asks).withColumn("near", F.last(F.when(F.col("__e").isNull(), ref), ignorenulls=True).over(w)).where("__e IS NOT NULL")
        return j.where(F.abs(F.col("pos") - F.col("near.pos")) <= ARGUMENT_GAP).select("doc_id", "__e", F.col("near.id").alias("id"), F.col("near.t").alias("t"))

    before = nearest("start_char", "end_char", False).withColumnsRenamed({"id": "agent_id", "t": "__agent"})
    after = nearest("end_char", "start_char", True).withColumnsRenamed({"id": "patient_id", "t": "__patient"})
    j = e.join(before, ["doc_id", "__e"], "left").join(after, ["doc_id", "__e"], "left")
    return j.withColumns({"agent": F.coalesce("__agent", "agent"), "patient": F.coalesce("__patient", "patient")}).drop("__e", "__agent", "__patient")
