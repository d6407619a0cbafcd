"""Problem 5: names as people type them, linked to the entity of a catalogue that they mean, or to none.

Method: metric-space partitioning (`metric_join`), of the words that tell names apart. Each distinct name, in the consistent form of problem 1, is
taken apart: titles go, short forms are written out, words that many names of the catalogue share (given names,
"Harbour", "Company") are set aside. What remains are its cores: the surname, the organisation's own word.
Cores of names and of the catalogue meet in an exact radius join; a pair then stands if the other words agree
too: for people the given name (as it is, shortened, as an initial, or with one error), for organisations every
further word (abbreviated, left out, in any order, or with one error). Names written as initials of an
organisation meet the catalogue's initials in the same join and must equal them.

A name links to the entity of least total distance; if two are as near, or initials or a surname alone fit several,
to none. Null and empty names link to none; repeated rows link each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .canonical_text import canonical_column
from .metric_join import radius_join
from .name_lexicon import NICKNAMES, TITLES
from .pii import folded, one_error

RADIUS = 2
INITIALS = "===="  # before initials, so that no word is near them
SHARED = 3  # a word of so many organisations is no core
MAX_LINKS_BROADCAST = 200_000
MAX_WORDS = 2_000_000  # shared words and given names of the catalogue that a broadcast may hold

# Abbreviations of words in names of organisations.
ABBREVIATIONS = {
    "assn": "association", "assoc": "association", "auth": "authority", "bro": "brothers", "bros": "brothers", "co": "company", "coll": "college", "corp": "corporation",
    "dept": "department", "dpt": "department", "grp": "group", "gp": "group", "hosp": "hospital", "inc": "incorporated", "inst": "institute", "int": "international",
    "intl": "international", "lab": "laboratory", "labs": "laboratory", "ltd": "limited", "mfg": "manufacturing", "natl": "national", "nat": "national", "res": "research", "rsch": "research", "soc": "society",
    "st": "saint", "uni": "university", "univ": "university",
}
LINKING_WORDS = {"of", "and", "for", "the"}
_WORD = re.compile(r"[^\W_](?:[^\W_]|['’-](?=[^\W_]))*")


def words_of(name: str) -> list[str]:
    """Folded words; a joined pair of capitalised words is parted."""
    name = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])", " ", name) if not name.isupper() else name
    return [folded(w) for w in _WORD.findall(name.replace("&", " and "))]


def initials_of(words: list[str]) -> str:
    return "".join(w[0] for w in words if w not in LINKING_WORDS)


class Vocabulary:
    """The words of a catalogue that are no cores: words that several of its organisations share, and given names."""

    def __init__(self, shared: set[str], given: set[str]):
        self.shared = shared | set(ABBREVIATIONS.values()) | LINKING_WORDS
        self.given = given

    def entities(self, kb_id: int, name: str, kind: str) -> list[tuple[str, int, str, str]]:
        """(core, kb_id, kind, rest): how a catalogue entry is met, by its core and by its initials; rest is the given name,
        or the further words of an organisation."""
        w = words_of(name)
        if kind == "PER":
            return [(w[-1], kb_id, "PER", " ".join(w[:-1]))] if len(w) >= 2 else []
        if not w:
            return []
        own = [x for x in w if x not in self.shared] or w[:1]
        out = [(own[0], kb_id, "ORG", " ".join(x for x in w if x != own[0] and x not in LINKING_WORDS))]
        return out + [(INITIALS + initials_of(w), kb_id, "INITIALS", "")] * (len(initials_of(w)) >= 2)

    def cores_of(self, name: str) -> list[str]:
        """What of a typed name may be the core."""
        short = re.sub(r"[.\s]", "", name)
        if 2 <= len(short) <= 6 and short.isalpha() and (short.isupper() and (" " not in name or "." in name)):
            return [INITIALS + short.lower()]
        out = [w for w in words_of(name) if len(w) > 2 and w not in self.shared and ABBREVIATIONS.get(w) is None and w not in TITLES]
        others = [w for w in out if w not in self.given and w not in NICKNAMES]
        others = others or out
        joined = [f"{a}-{b}" for a, b in zip(others, others[1:]) if "-" not in a + b]  # a double surname without its hyphen
        return list(dict.fromkeys([*others, *joined]))


def rest_distance(name: str, core: str, target: str, kind: str, rest: str, alike: int) -> int | None:
    """How far the words of a name beside its core are from those of an entity with core `target`; None: they are another's.
    `alike` is how many entities of that kind have the core: initials, and a surname alone, must tell one."""
    if kind == "INITIALS" or core[0] == "=" or target[0] == "=":
        return 0 if core == target and kind == "INITIALS" and alike == 1 else None
    words = words_of(name)
    for w in [core] if core in words else core.split("-"):
        if w in words:
            words.remove(w)
    words = [w for w in words if w != "the"]
    if kind == "PER":
        others = [w for w in words if w not in TITLES]
        return _given_distance(others, rest) if others or alike == 1 else None
    return _words_distance([ABBREVIATIONS.get(w, w) for w in words if w not in LINKING_WORDS], rest.split())


def _given_distance(rest: list[str], given: str) -> int | None:
    """How far the words beside the surname are from a given name; None: they are another's."""
    if not rest:
        return 0
    full = [w for w in rest if len(w) > 1]
    single = [w for w in rest if len(w) == 1]
    if len(full) > 1 or len(single) > 2:
        return None
    if not full:
        return 0 if len(single) == 1 and single[0] == given[0] or len(single) == 2 and given[0] in single else None
    w = full[0]
    if w == given:
        return 0
    if given in NICKNAMES.get(w, "").split() or w.replace("oe", "o").replace("ue", "u").replace("ae", "a") == given:
        return 0
    if NICKNAMES.get(w) and (NICKNAMES[w][:3] == given[:3] or w[:3] == given[:3]):
        return 0
    if len(w) >= 3 and given.startswith(w):
        return 0
    return 1 if len(given) >= 3 and one_error(w, given) and w not in NICKNAMES else None


def _words_distance(words: list[str], own: list[str]) -> int | None:
    """How far the further words of an organisation are from the catalogue's; words may be left out, none added."""
    if not words:
        return 1
    left, distance = list(own), 0
    for w in words:
        if w in left:
            left.remove(w)
            continue
        near = [x for x in left if len(w) > 3 and one_error(w, x)]
        if not near:
            return None
        left.remove(near[0])
        distance += 1
    return distance if distance <= 1 else None


def vocabulary(catalogue: DataFrame) -> Vocabulary:
    """Words are counted in the cluster; only those that names share come to the driver, and their number is checked."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, kind in zip(b["kb_name"], b["entity_type"]):
                w = words_of(name)
                out += [(x, "ORG") for x in set(w)] if kind == "ORG" else [(w[0], "PER")] if len(w) >= 2 else []
            yield pd.DataFrame(out, columns=["word", "kind"])

    named = catalogue.where(F.col("entity_type").isin("PER", "ORG") & F.col("kb_name").isNotNull()).select("kb_name", "entity_type")
    words = named.mapInPandas(split, "word string, kind string").groupBy("word", "kind").agg(F.count(F.lit(1)).alias("n"))
    rows = words.where((F.col("kind") == "PER") | (F.col("n") >= SHARED)).select("word", "kind").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"the names of the catalogue share more than {MAX_WORDS} words")
    return Vocabulary({r.word for r in rows if r.kind == "ORG"}, {r.word for r in rows if r.kind == "PER"})


def linked_names(names: DataFrame, catalogue: DataFrame, column: str = "name") -> DataFrame:
    """(name, canonical_name, kb_id): distinct names that mean a person or organisation of the catalogue.

    The catalogue is joined like any table, whatever its size; only the words that many of its names share are broadcast."""
    spark = names.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(catalogue))
    distinct = names.select(F.col(column).alias("name")).where(F.col("name").isNotNull() & (F.length("name") > 0)).distinct()
    scratch = Scratch(spark, "names")

    def take_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        for b in batches:
            out = [(n, x, w) for n, x in zip(b["name"], b["canonical_name"]) for w in v.cores_of(x)]
            yield pd.DataFrame(out, columns=["name", "canonical_name", "core"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        for b in batches:
            out = [x for k, n, t in zip(b["kb_id"], b["kb_name"], b["entity_type"]) for x in v.entities(k, n, t)]
            yield pd.DataFrame(out, columns=["target", "kb_id", "kind", "rest"])

    named = catalogue.where(F.col("entity_type").isin("PER", "ORG") & F.col("kb_name").isNotNull()).select("kb_id", "kb_name", "entity_type")
    entities, _ = scratch.write(named.mapInPandas(meet, "target string, kb_id bigint, kind string, rest string"))
    entities = entities.join(entities.groupBy("target", "kind").agg(F.count(F.lit(1)).alias("alike")), ["target", "kind"])
    canonical = canonical_column(distinct, "name", "canonical_name").repartition(F.col("name"))
    cored, _ = scratch.write(canonical.mapInPandas(take_apart, "name string, canonical_name string, core string"))
    near = radius_join(cored, entities, "core", "target", RADIUS)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rest = [rest_distance(x, w, t, kind, own, n) for x, w, t, kind, own, n in zip(b["canonical_name"], b["core"], b["target"], b["kind"], b["rest"], b["alike"])]
            b["cost"] = [-1 if d is None else int(c) * 2 + d for c, d in zip(b["distance"], rest)]
            yield b.loc[b["cost"] >= 0, ["name", "canonical_name", "kb_id", "cost"]]

    found = cored.join(near, "core").join(entities, "target").mapInPandas(settle, "name string, canonical_name string, kb_id bigint, cost int")
    best = found.groupBy("name", "canonical_name", "kb_id").agg(F.min("cost").alias("cost")).groupBy("name", "canonical_name")
    # The two entities of least cost are all that is kept of a name: enough to tell whether one is nearest.
    best = best.agg(F.min("cost").alias("cost"), F.min_by("kb_id", "cost").alias("kb_id"), F.min_by("kb_id", F.struct("cost", "kb_id")).alias("first"), F.max_by("kb_id", F.struct(-F.col("cost"), F.col("kb_id"))).alias("last"))
    return best.where("first = last").select("name", "canonical_name", "kb_id")


def linked_records(examples: DataFrame, predictions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(record_kind, record_id, name, canonical_name, kb_id, kb_name): every row that means an entity of the catalogue."""
    spark = examples.sparkSession
    rows = examples.select(F.lit("example").alias("record_kind"), F.col("example_id").alias("record_id"), F.col("entity_text").alias("name"))
    rows = rows.unionByName(predictions.select(F.lit("entity").alias("record_kind"), F.col("pred_id").alias("record_id"), F.col("text").alias("name")))
    found = linked_names(rows, catalogue).join(catalogue.select("kb_id", "kb_name"), "kb_id")
    links, _, n = Scratch(spark, "links").write_counting(found, F.lit(True))
    if n <= MAX_LINKS_BROADCAST:  # a checked size; beyond it, a shuffle join with skew handling
        links = F.broadcast(links)
    return rows.join(links, "name").select("record_kind", "record_id", "name", "canonical_name", "kb_id", "kb_name")


def misspelt_records(examples: DataFrame, predictions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(record_kind, record_id, kb_id): rows linked to an entity whose canonical spelling they do not have."""
    return linked_records(examples, predictions, catalogue).where(F.col("canonical_name") != F.col("kb_name")).select("record_kind", "record_id", "kb_id")
