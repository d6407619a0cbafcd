"""Which mentions of a document mean the same, and which antecedents a reference may have.

`resolve` reads mentions in order; a mention is one row (doc_id, key, start_char, end_char, text, label). Documents are worked on
as arrays of their mentions, one Python call a batch of documents; a document's mentions are bounded by its text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, simple_stem
from .patterns import match_array, pattern_spans
from .spans import located

# --- fixed values: pronouns by gender, and by the kinds that they can stand for ---------------------------
GENDER = {
    "m": "he him his himself".split(),
    "f": "she her hers herself".split(),
    "n": "they them their theirs themselves themself xe xem xyr xyrs xemself ze hir zir hirs zirs hirself zirself ey em eir eirs emself fae faer faers faeself".split(),
    "": "it its itself".split(),
}
OF_ORGANISATIONS = "it they its their theirs itself themselves".split()
OF_THINGS = "it its itself".split()
# Pronouns looked for in the text itself, with the kinds that they can stand for.
SOUGHT = {"he": "PER", "him": "PER", "his": "PER", "she": "PER", "her": "PER", "hers": "PER", "they": "PER ORG", "them": "PER ORG", "their": "PER ORG", "theirs": "PER ORG", "it": "ORG", "its": "ORG"}
LOOK_BACK = 30  # mentions
MALE_NAMES = (
    "james john robert michael william david richard joseph thomas charles barack donald joe george bill vladimir emmanuel boris xi narendra justin elon jeff mark steve tim satya sundar albert isaac stephen neil peter "
    "paul matthew andrew philip simon"
).split()
FEMALE_NAMES = (
    "mary patricia jennifer linda elizabeth angela marie susan margaret dorothy hillary nancy kamala michelle melania jill theresa ursula christine sanna jacinda oprah beyonce taylor"
).split()
# ---------------------------------------------------------------------------------------------------------

_OF = {w: g for g, ws in GENDER.items() for w in ws}
_PERSONAL = frozenset(_OF) - frozenset(GENDER[""])


def first_name_is(name: Column, names: list[str]) -> Column:
    """Whether the first word of a name is one of a list; names outside both lists tell nothing."""
    return F.coalesce(F.get(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != ""), F.lit(0)).isin(names), F.lit(False))


def compatible(pronoun: str, label: str) -> bool:
    return pronoun in (_PERSONAL if label == "PER" else OF_ORGANISATIONS if label == "ORG" else OF_THINGS)


def names_match(a: str, b: str) -> bool:
    """Of names in lower case: equal, one in the other, or a single word that ends the other."""
    return bool(a and b) and (a in b or b in a)


def resolve_document(mentions: list[tuple[int, str, str]], pronouns: bool = True, fuzzy: bool = True) -> list[tuple[int, int]]:
    """(mention, cluster) of mentions (id, text, label) in reading order; a cluster is named by its first mention.

    A pronoun joins the nearest of the LOOK_BACK mentions before it that is no pronoun and that it can stand for, or is a
    cluster of its own. Another mention joins the cluster of an equal name of its label, or else (fuzzy) the earliest cluster
    that has a matching name of its label."""
    exact: dict[tuple[str, str], int] = {}
    names: dict[str, list[tuple[str, int]]] = {}
    order: dict[int, int] = {}  # where the first mention of a cluster stands
    out: list[tuple[int, int]] = []
    for at, (i, text, label) in enumerate(mentions):
        name = text.lower().strip()
        if pronouns and name in _OF:
            before = range(at - 1, max(-1, at - 1 - LOOK_BACK), -1)
            k = next((k for k in before if mentions[k][1].lower().strip() not in _OF and compatible(name, mentions[k][2])), None)
            out.append((i, i if k is None else out[k][1]))
            continue
        c = exact.get((label, name))
        if c is None:
            fits = [k for other, k in names.get(label, ()) if names_match(name, other)] if fuzzy else []
            c = min(fits, default=i, key=order.__getitem__)
            order.setdefault(c, at)
            exact[label, name] = c
            names.setdefault(label, []).append((name, c))
        out.append((i, c))
    return out


def resolve(spans: DataFrame, key: str = "pred_id", pronouns: bool = True, fuzzy: bool = True) -> DataFrame:
    """(doc_id, key, cluster). Rows without text, label or start are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(doc, i, c) for doc, ms in zip(b["doc_id"], b["ms"]) for i, c in resolve_document([(x[key], x["text"], x["label"]) for x in ms], pronouns, fuzzy)]
            yield pd.DataFrame(out, columns=["doc_id", key, "cluster"])

    s = spans.where("text IS NOT NULL AND label IS NOT NULL AND start_char IS NOT NULL")
    ms = F.sort_array(F.collect_list(F.struct("start_char", "end_char", key, "text", "label")))
    return s.groupBy("doc_id").agg(ms.alias("ms")).mapInPandas(run, f"doc_id bigint, {key} bigint, cluster bigint")


def pronoun_mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char, text, kinds): pronouns that stand in a text as words of their own."""
    p = pattern_spans(documents, r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(sorted(SOUGHT, key=len, reverse=True)) + r")(?![\p{L}\p{N}_])")
    kinds = F.create_map(*[F.lit(x) for kv in SOUGHT.items() for x in kv])
    return p.select("doc_id", "start_char", "end_char", F.col("surface").alias("text"), kinds[F.lower("surface")].alias("kinds"))


def pronoun_links(spans: DataFrame, documents: DataFrame, key: str = "pred_id") -> DataFrame:
    """(doc_id, start_char, text, antecedent): every pronoun of a text with the nearest span that ends before it and that it can
    stand for: he and she take a person whose first name is of the lists for them, they a person or an organisation, it an
    organisation. One window over spans and pronouns of a document, no pairs."""
    s = located(spans).where("text IS NOT NULL").select("doc_id", F.col("end_char").alias("at"), F.lit(0).alias("after"), F.col(key).alias("id"), F.col("kind"), "text", F.lit(None).cast("string").alias("kinds"), F.lit(None).cast("int").alias("start_char"))
    p = pronoun_mentions(documents).select("doc_id", F.col("start_char").alias("at"), F.lit(-1).alias("after"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("kind"), "text", "kinds", "start_char")
    w = Window.partitionBy("doc_id").orderBy("at", "after", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda when: F.last(F.when(when, F.col("id")), ignorenulls=True).over(w)
    person, organisation = F.col("kind") == "PER", F.col("kind") == "ORG"
    j = s.unionByName(p).withColumns({
        "he": last(person & first_name_is(F.col("text"), MALE_NAMES)), "she": last(person & first_name_is(F.col("text"), FEMALE_NAMES)), "org": last(organisation), "any": last(person | organisation),
    }).where("kinds IS NOT NULL")
    word = F.lower("text")
    found = F.when(word.isin("he", "him", "his"), F.col("he")).when(word.isin("she", "her", "hers"), F.col("she")).when(word.isin("it", "its"), F.col("org")).otherwise(F.col("any"))
    return j.withColumn("antecedent", found).where("antecedent IS NOT NULL").select("doc_id", "start_char", "text", "antecedent")


def leader_clusters(events: DataFrame, key: str = "id") -> DataFrame:
    """(doc_id, key, leader): events (doc_id, key, start_char, trigger, event_type, polarity) in reading order; each joins the first
    event of its document of the same type and polarity whose trigger has the same stem. Only leaders are compared, so equal
    keys decide, and one window finds them."""
    w = Window.partitionBy("doc_id", "event_type", "polarity", simple_stem(F.col("trigger"))).orderBy("start_char", key)
    return events.select("doc_id", key, F.first(key).over(w).alias("leader"))


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sentence, start_char, end_char): sentences end at . ! or ? before white space or a quote and a capital, or at
    the end of the text; the white space behind belongs to none."""
    d = documents.where("text IS NOT NULL").select("doc_id", "text", match_array(F.col("text"), rf"[.!?]+[\"'”’»]?[{SPACE}]+(?=[\"'“‘«]?\p{{Lu}})").alias("ends"))
    n = F.length("text")
    starts = F.concat(F.array(F.lit(0)), F.transform("ends", lambda x: x["end"]))
    stops = F.concat(F.transform("ends", lambda x: x["start"] + F.length(F.regexp_extract(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]), rf"^[^{SPACE}]+", 0))), F.array(n))
    s = d.select("doc_id", F.posexplode(F.arrays_zip(starts.alias("start_char"), stops.alias("end_char"))).alias("sentence", "x"))
    return s.where("x.start_char < x.end_char").select("doc_id", "sentence", "x.start_char", "x.end_char")


CLAUSE_MARKS = "because although while when if unless until since though whereas after before as once whether that which".split()


def clauses(documents: DataFrame, marks: list[str] = CLAUSE_MARKS) -> DataFrame:
    """(doc_id, clause, start_char, end_char): stretches between commas, semicolons, full stops and words that open a clause."""
    cut = rf"(?i)[,;.!?][{SPACE}]+" + (rf"|[{SPACE}](?=(?:{'|'.join(marks)})[{SPACE}])" if marks else "")
    d = documents.where("text IS NOT NULL").select("doc_id", F.length("text").alias("n"), match_array(F.col("text"), cut).alias("cuts"))
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda x: x["end"]))
    stops = F.concat(F.transform("cuts", lambda x: x["start"]), F.array(F.col("n")))
    s = d.select("doc_id", F.posexplode(F.arrays_zip(starts.alias("start_char"), stops.alias("end_char"))).alias("clause", "x"))
    return s.where("x.start_char < x.end_char").select("doc_id", "clause", "x.start_char", "x.end_char")


def discourse_antecedents(anaphors: DataFrame, documents: DataFrame, back: int = 3) -> DataFrame:
    """(doc_id, id, clause, rank): for each anaphor (doc_id, id, start_char) the clauses before its own that it may refer to, the
    nearest first, at most `back`; clauses are addressed by their number, so it is a join on numbers, not on ranges."""
    c = clauses(documents)
    starts = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "clause"))).alias("cs"))
    own = anaphors.join(starts, "doc_id").withColumn("own", F.element_at(F.filter("cs", lambda x: x["start_char"] <= F.col("start_char")), -1)["clause"])
    j = own.select("doc_id", "id", F.posexplode(F.reverse(F.transform(F.filter("cs", lambda x: (x["clause"] < F.col("own")) & (x["clause"] >= F.col("own") - back)), lambda x: x["clause"]))).alias("rank", "clause"))
    return j.select("doc_id", "id", "clause", (F.col("rank") + 1).alias("rank"))
