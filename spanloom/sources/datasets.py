"""Readers of annotated datasets by family, a registry of them, made-up ones, and texts from addresses.

A reader gives one of these shapes:
tokens     (seq, pos, token, tag)
mentions   (doc_id, mention, sentence, first_token, last_token, cluster)
spans      (doc_id, segments array<struct<start,end>>, label, text)
entities   (doc_id, text, label, start, end, confidence, valid)"""

from __future__ import annotations

import html
import re
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_text
from . import readers as R


def served_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tokens of saved answers of a dataset server: {features, rows: [{row_idx, row: {tokens, ner_tags}}]}, one file an answer; tags
    are places in `names`. Rows without tokens or tags are skipped."""
    r = spark.read.option("multiLine", True).schema("rows array<struct<row_idx:bigint,row:struct<tokens:array<string>,ner_tags:array<int>>>>").json(path)
    x = r.select(F.input_file_name().alias("file"), F.explode("rows").alias("r")).where("r.row.tokens IS NOT NULL AND r.row.ner_tags IS NOT NULL")
    x = x.select(F.concat_ws("#", "file", F.col("r.row_idx").cast("string")).alias("seq"), F.posexplode(F.arrays_zip(F.col("r.row.tokens").alias("token"), F.col("r.row.ner_tags").alias("k"))).alias("pos", "y"))
    tag = F.coalesce(F.get(F.array(*map(F.lit, names)), F.col("y.k")), F.lit("O"))
    return x.select("seq", "pos", F.col("y.token").alias("token"), tag.alias("tag")).where("token IS NOT NULL")


def string_tag_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of objects {tokens, tags} or {tokens, ner_tags} whose tags are strings."""
    r = spark.read.schema("tokens array<string>, tags array<string>, ner_tags array<string>").json(path)
    r = r.withColumn("k", F.coalesce("tags", "ner_tags")).where("tokens IS NOT NULL AND k IS NOT NULL").withColumn("seq", F.md5(F.concat_ws(" ", "tokens")))
    return r.select("seq", F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), F.col("k").alias("tag"))).alias("pos", "x")).select("seq", "pos", "x.token", F.coalesce("x.tag", F.lit("O")).alias("tag")).where("token IS NOT NULL")


def biomedical_tag(tag: Column) -> Column:
    """Bare names of kinds as tags of their first token: ENTITY, CHEMICAL and DISEASE become B- tags, other forms stay."""
    bare = F.upper(tag)
    return F.when(bare.isin("ENTITY", "CHEMICAL", "DISEASE"), F.concat(F.lit("B-"), F.initcap(F.lower(tag)))).otherwise(tag)


def preco(spark: SparkSession, path: str) -> DataFrame:
    """Mentions of objects {id, sentences, mention_clusters: [[[sentence, first, end]]]}, one a line; `end` is exclusive."""
    r = spark.read.schema("id string, sentences array<array<string>>, mention_clusters array<array<array<int>>>").json(path)
    c = r.where("mention_clusters IS NOT NULL").select(F.col("id").alias("doc_id"), F.posexplode("mention_clusters").alias("cluster", "ms"))
    m = c.select("doc_id", "cluster", F.posexplode("ms").alias("i", "m")).where(F.size("m") == 3)
    return m.select("doc_id", F.concat_ws(":", F.col("cluster").cast("string"), F.col("i").cast("string")).alias("mention"), F.col("m")[0].alias("sentence"), F.col("m")[1].alias("first_token"), (F.col("m")[2] - 1).alias("last_token"), "cluster")


def discontinuous_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Spans of objects {id, text, entities: [{label, spans: [[start, end], ...]}]}; a span without segments is skipped, segments come
    in order, the text is what they hold, joined by blanks."""
    r = spark.read.schema("id string, text string, entities array<struct<label:string,spans:array<array<int>>>>").json(path)
    e = r.select(F.coalesce("id", F.md5("text")).alias("doc_id"), F.col("text").alias("doc"), F.explode("entities").alias("e"))
    seg = F.array_sort(F.transform(F.filter("e.spans", lambda s: F.size(s) == 2), lambda s: F.struct(s[0].alias("start"), s[1].alias("end"))))
    e = e.withColumn("segments", seg).where(F.size("segments") > 0)
    return e.select("doc_id", "segments", F.col("e.label").alias("label"), F.array_join(F.transform("segments", lambda s: F.substring(F.col("doc"), s["start"] + 1, s["end"] - s["start"])), " ").alias("text"))


def event_mentions_csv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, row): the rows of comma-separated mention files (ECB+ style): a header, the text in the second column."""
    r = spark.read.option("header", True).csv(path)
    c = r.columns
    return r.select(F.col(f"`{c[0]}`").alias("doc_id"), F.col(f"`{c[1]}`").alias("text"), F.to_json(F.struct(*[F.col(f"`{x}`") for x in c])).alias("row")).where("text IS NOT NULL")


def checked_entities(entities: DataFrame) -> DataFrame:
    """Entities of `readers.entity_json`, or an error that names the first document with an entity whose offsets do not hold it."""
    message = F.concat(F.lit("offsets do not hold the entity in document "), F.col("doc_id"))
    return entities.where(F.when(F.col("valid"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def gold_specs(specs: DataFrame, column: str = "value") -> DataFrame:
    """(text, label, start, end) of lines `text:label:start:end`; other lines are skipped."""
    return specs.select(R.gold_spec(F.col(column)).alias("x")).where("x IS NOT NULL").select("x.*")


# --- registry ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dataset:
    name: str
    task: str  # ner, coreference, relations, discontinuous, events
    shape: str
    labels: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame]
    files: str = "*"


CONLL_TAGS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC"]
DATASETS: dict[str, Dataset] = {}


def register(dataset: Dataset) -> Dataset:
    DATASETS[dataset.name] = dataset
    return dataset


def _conll(spark: SparkSession, path: str) -> DataFrame:
    return R.conll_file(spark, path)


for _name, _task, _shape, _labels, _read, _files in (
    ("conll", "ner", "tokens", ("PER", "ORG", "LOC", "MISC"), _conll, "*.conll"),
    ("biomedical_conll", "ner", "tokens", ("CHEMICAL", "DISEASE"), lambda s, p: _conll(s, p).withColumn("tag", biomedical_tag(F.col("tag"))), "*.tsv"),
    ("tag_jsonl", "ner", "tokens", ("PER", "ORG", "LOC", "MISC"), lambda s, p: R.tag_jsonl(s, p, CONLL_TAGS), "*.jsonl"),
    ("string_tag_jsonl", "ner", "tokens", (), string_tag_jsonl, "*.jsonl"),
    ("served_rows", "ner", "tokens", ("PER", "ORG", "LOC", "MISC"), lambda s, p: served_rows(s, p, CONLL_TAGS), "*.json"),
    ("entity_jsonl", "ner", "entities", (), lambda s, p: checked_entities(R.entity_json(s, p)), "*.jsonl"),
    ("discontinuous_jsonl", "discontinuous", "spans", (), discontinuous_jsonl, "*.jsonl"),
    ("gap", "coreference", "rows", (), R.gap_rows, "*.tsv"),
    ("preco", "coreference", "mentions", (), preco, "*.jsonl"),
    ("event_csv", "events", "rows", (), event_mentions_csv, "*.csv"),
    ("relation_json", "relations", "rows", (), R.relation_json, "*.json"),
):
    register(Dataset(_name, _task, _shape, _labels, _read, _files))

# What an extractor must be able to do for a task.
TASK_ABILITIES = {"ner": {"named", "structured", "any_label"}, "coreference": {"coreference"}, "relations": {"relations"}, "discontinuous": {"discontinuous"}, "events": {"events"}}


def compatible(task: str, abilities: set[str] | frozenset[str]) -> bool:
    """Whether something with these abilities can do a task: one of those that it takes is enough."""
    if task not in TASK_ABILITIES:
        raise ValueError(f"{task}: one of {', '.join(TASK_ABILITIES)}")
    return bool(TASK_ABILITIES[task] & set(abilities))


def compatibility(spark: SparkSession) -> DataFrame:
    """(extractor, dataset, task, fits): every extractor against every registered dataset."""
    from ..operators.models import EXTRACTORS

    return spark.createDataFrame([(x.name, d.name, d.task, compatible(d.task, x.abilities)) for x in EXTRACTORS.values() for d in DATASETS.values()], "extractor string, dataset string, task string, fits boolean")


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"{name}: one of {', '.join(DATASETS)}")
    return DATASETS[name].read(spark, path)


# --- made-up datasets --------------------------------------------------------------------------------------

# Frames of sentences: words in braces stand for a value of a kind.
FRAMES = {
    "news": "{PER} of {ORG} spoke in {LOC} on {DATE}.", "business": "{ORG} paid {MONEY} to {ORG} for a mill in {LOC}.", "letters": "Dear {PER}, write to {EMAIL} before {DATE}.", "notes": "{PER} met {PER} at {ORG}.",
    "edge": "({PER}) \"{ORG}\" — {LOC}…",
}
VALUES = {
    "PER": ["Mira Solwen", "Jörg Äberli", "Ana-Luz Otero", "李明", "O'Dell Krane"], "ORG": ["Harbour & Sons Ltd", "Ostwick University", "Nordlys AG", "Krane Mill Company"], "LOC": ["Ostwick", "New Wexley", "São Veto", "大原"],
    "DATE": ["2021-03-04", "4 May 2019", "12/11/2020"], "MONEY": ["$5 million", "€1,200", "300 dollars"], "EMAIL": ["mira@ostwick.example", "a.b+c@krane.example"],
}


def synthetic(spark: SparkSession, n: int, domain: str | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, domain, difficulty, text, entities): n made-up annotated sentences. Row i depends on i and the seed alone, so any part
    of any size is made where it is needed."""
    domains = [domain] if domain else sorted(FRAMES)

    def make(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for i in b["id"]:
                d = domains[int(i) % len(domains)]
                text, found, k = "", [], 0
                for piece in re.split(r"(\{[A-Z]+\})", FRAMES[d]):
                    if piece.startswith("{"):
                        kind = piece[1:-1]
                        value = VALUES[kind][(int(i) * 7919 + k * 104729 + seed * 31) // len(domains) % len(VALUES[kind])]
                        found.append({"text": value, "label": kind, "start": len(text), "end": len(text) + len(value), "confidence": 1.0})
                        piece, k = value, k + 1
                    text += piece
                rows.append((int(i), d, "hard" if not text.isascii() or d == "edge" else "medium" if len(found) > 2 else "easy", text, found))
            yield pd.DataFrame(rows, columns=["doc_id", "domain", "difficulty", "text", "entities"])

    return spark.range(n).mapInPandas(make, f"doc_id bigint, domain string, difficulty string, text string, entities {R.ENTITY_ARRAY}")


def chosen(examples: DataFrame, domain: str | None = None, difficulty: str | None = None, label: str | None = None, skip: int = 0, take: int | None = None) -> DataFrame:
    """Examples of a domain, a difficulty, with an entity of a label (each without case), then without the first `skip` and no more than
    `take`, by doc_id."""
    x = examples
    for column, value in (("domain", domain), ("difficulty", difficulty)):
        if value is not None:
            x = x.where(F.lower(column) == value.lower())
    if label is not None:
        x = x.where(F.exists("entities", lambda e: F.lower(e["label"]) == label.lower()))
    if skip or take is not None:
        x = x.orderBy("doc_id")
        x = x.offset(skip) if skip else x
        x = x.limit(take) if take is not None else x
    return x


# --- addresses ---------------------------------------------------------------------------------------------


def fetch(url: str, timeout: float = 60.0) -> str:
    """The text at an http(s) address: pages (a body that begins with <) without their tags."""
    if not url.startswith(("http://", "https://")):
        raise ValueError(f"{url}: only http and https")
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    if not body.lstrip().startswith("<"):
        return body
    body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", body)
    body = re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?i)<(?:p|div|br|li|h[1-6])\b[^>]*>", " ", body))
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in html.unescape(body).splitlines())
    return "\n".join(x for x in lines if x)


Resolver = tuple[Callable[[str], bool], Callable[[SparkSession, str], DataFrame]]


def _one(spark: SparkSession, address: str, text: str) -> DataFrame:
    return spark.createDataFrame([(address, text)], "doc_id string, text string")


# The first that takes an address reads it.
RESOLVERS: list[Resolver] = [
    (lambda a: a.startswith(("http://", "https://")), lambda s, a: _one(s, a, fetch(a))),
    (lambda a: a.endswith((".jsonl", ".ndjson")), R.jsonl_documents),
    (lambda a: a.endswith((".html", ".htm")), lambda s, a: s.read.text(a, wholetext=True).select(F.input_file_name().alias("doc_id"), html_to_text(F.col("value")).alias("text"))),
    (lambda a: a.endswith(".parquet"), lambda s, a: s.read.parquet(a).select(F.col("doc_id").cast("string").alias("doc_id"), "text")),
    (lambda a: a.endswith((".txt", ".md")), lambda s, a: s.read.text(a, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))),
    (lambda a: True, lambda s, a: R.text_files(s, a)),
]


def documents_at(spark: SparkSession, *addresses: str) -> DataFrame:
    """(doc_id string, text) of addresses: web pages, JSON lines, pages, Parquet tables, text files, folders of texts."""
    out = None
    for a in addresses:
        one = next(read for takes, read in RESOLVERS if takes(a))(spark, a)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no address")
    return out


def save_boxes(boxes: dict, path: str, spark: SparkSession) -> None:
    """Trained boxes {id: (low, high)} as JSON lines."""
    rows = [(int(i), [float(x) for x in a], [float(x) for x in b]) for i, (a, b) in boxes.items()]
    spark.createDataFrame(rows, "id bigint, low array<double>, high array<double>").write.mode("overwrite").json(path)


def load_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(id, low, high)"""
    return spark.read.schema("id bigint, low array<double>, high array<double>").json(path)
