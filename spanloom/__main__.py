"""Commands over tables, files, folders and pages of one's own.

python -m spanloom list                                             registered queries
python -m spanloom run QUERY --data DIR                             a query over a folder of tables
python -m spanloom explain QUERY --data DIR                         its plan
python -m spanloom extract PATH...                                  entities (or grounded documents)
python -m spanloom validate PATH...                                 what is wrong with spans of grounded documents
python -m spanloom query PATH...                                    spans of grounded documents by conditions
python -m spanloom eval PREDICTED --gold GOLD                       grounded or entity JSON lines against gold ones
python -m spanloom compare A B                                      entities in both, in one, in the other
python -m spanloom analyze PATH... --models a,b                     what several extractors say, and how far they agree
python -m spanloom enhance PATH...                                  grounded documents with tracks and identities
python -m spanloom crossdoc PATH...                                 identities across grounded documents
python -m spanloom pipeline PATH...                                 extract, tracks, identities in one go
python -m spanloom communities PATH...                               communities of spans that stand near each other
python -m spanloom dataset list | load NAME PATH                    registered datasets
python -m spanloom info                                             extractors, stacks, versions"""

from __future__ import annotations

import argparse
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as core
from .functions.text import canonical_label
from .operators import coreference as C
from .operators import graph as G
from .operators import matching as M
from .operators import models as N
from .operators import resolve as R
from .operators import spans as S
from .operators import tracks as T
from .session import get_spark
from .sources import datasets as D
from .sources.writers import FORMATS, highlighted, tree_lines, write


def _numbered(documents: DataFrame) -> DataFrame:
    """Documents with a number by the hash of their name, which the operators take, and their name."""
    return documents.select(F.xxhash64("doc_id").alias("doc_id"), F.col("doc_id").alias("name"), "text")


def _entities(found: DataFrame) -> DataFrame:
    """Extracted rows as entities with an id by place and label."""
    key = F.xxhash64("doc_id", "start_char", "end_char", "label")
    return found.select(key.alias("pred_id"), "doc_id", F.col("surface").alias("text"), "label", "start_char", "end_char", "confidence")


def grounded_of(spark: SparkSession, paths: list[str], stack: str = "default", strategy: str = "priority", labels: list[str] | None = None) -> DataFrame:
    """Grounded documents, without tracks, of texts."""
    d = _numbered(D.documents_at(spark, *paths))
    signals = T.signals_of(_entities(N.extract(d, stack, strategy, labels)), d)
    return T.grounded(d, signals, T.tracks_of(signals, signals.select("doc_id", "signal_id", F.lit(None).cast("bigint").alias("cluster"))))


def read_grounded(spark: SparkSession, paths: list[str]) -> DataFrame:
    return T.from_grounded_json(spark.read.text(paths))


def with_tracks(documents: DataFrame, fuzzy: bool = True) -> DataFrame:
    s, _, _ = T.tables_of(documents)
    named = s.select("doc_id", F.col("signal_id").alias("pred_id"), "start_char", "end_char", F.col("surface").alias("text"), "label")
    clusters = C.resolve(named, fuzzy=fuzzy).select("doc_id", F.col("pred_id").alias("signal_id"), "cluster")
    tracks = T.tracks_of(s, clusters)
    return T.grounded(documents, s, tracks)


def with_identities(documents: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Tracks of all documents joined to identities by the likeness of their names, label by label."""
    s, t, _ = T.tables_of(documents)
    names = t.select(F.col("track_id").alias("id"), F.col("canonical_surface").alias("name"), canonical_label(F.col("label")).alias("kind"))
    classes = R.equal_classes(names, block="kind").select(F.col("member").alias("id"), "representative")
    pairs = R.jaccard_pairs(names, threshold, block="kind").select(F.col("left").alias("source"), F.col("right").alias("target"))
    of = G.components(pairs, classes.select(F.col("representative").alias("node")))
    link = classes.join(of.withColumnRenamed("node", "representative"), "representative").select(F.col("id").alias("track_id"), F.col("component").alias("identity_id"))
    refs = t.select("doc_id", "track_id").join(link, "track_id").select("doc_id", "track_id", "identity_id")
    return T.grounded(documents, s, t, refs)


def identities_in(documents: DataFrame) -> DataFrame:
    _, t, refs = T.tables_of(documents)
    return T.identities_of(t, refs)[0]


def spans_in(documents: DataFrame) -> DataFrame:
    """Signals of grounded documents as spans (doc_id, pred_id, start_char, end_char, text, label, confidence, negated, quantifier)."""
    s, _, _ = T.tables_of(documents)
    return s.withColumnsRenamed({"signal_id": "pred_id", "surface": "text"})


def evaluated(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    side = lambda x: spans_in(x).select("doc_id", F.col("pred_id").alias("id"), "start_char", "end_char", canonical_label(F.col("label")).alias("label"))
    return M.muc_modes(M.evaluate_ner(side(gold), side(predicted)))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, label, text): entities by label and text without case, in both, only in the first, only in the second."""
    keys = lambda x: spans_in(x).where("text IS NOT NULL").select(canonical_label(F.col("label")).alias("label"), F.lower("text").alias("text")).distinct()
    x, y = keys(a), keys(b)
    side = lambda df, name: df.select(F.lit(name).alias("side"), "label", "text")
    return side(x.intersect(y), "both").unionByName(side(x.subtract(y), "only_first")).unionByName(side(y.subtract(x), "only_second"))


def analyzed(spark: SparkSession, paths: list[str], models: list[str]) -> DataFrame:
    """(models, n): how many stretches each set of extractors found, with one label."""
    d = _numbered(D.documents_at(spark, *paths))
    every = None
    for m in models:
        one = N.extract(d, m).select("doc_id", "start_char", "end_char", "label").distinct().withColumn("model", F.lit(m))
        every = one if every is None else every.unionByName(one)
    g = every.groupBy("doc_id", "start_char", "end_char", "label").agg(F.array_join(F.sort_array(F.collect_set("model")), "+").alias("models"))
    return g.groupBy("models").agg(F.count(F.lit(1)).alias("n"))


def queried(documents: DataFrame, o: argparse.Namespace) -> DataFrame:
    s = spans_in(documents)
    s = S.query_spans(s, o.labels.split(",") if o.labels else None, o.contains, o.least, o.start, o.end)
    if o.negated:
        s = s.where("negated")
    if o.quantified:
        s = s.where("quantifier IS NOT NULL")
    if o.untracked or o.unlinked or o.linked:
        signals, tracks, refs = T.tables_of(documents)
        keep = T.untracked(signals, tracks) if o.untracked else T.unlinked(signals, tracks, refs) if o.unlinked else T.linked(signals, tracks, refs)
        s = s.join(keep.select("doc_id", F.col("signal_id").alias("pred_id")), ["doc_id", "pred_id"], "left_semi")
    return s


def _lines(documents: DataFrame) -> DataFrame:
    return T.grounded_json(documents).select("json")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = argparse.ArgumentParser(prog="spanloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("command", choices="list run explain extract validate query eval compare analyze enhance crossdoc pipeline communities dataset info".split())
    a.add_argument("paths", nargs="*")
    a.add_argument("--data", help="folder with the tables")
    a.add_argument("--gold")
    a.add_argument("--models", default="default", help="extractors or stacks, with commas")
    a.add_argument("--strategy", default="priority", choices=["priority", "longest", "confidence", "union"])
    a.add_argument("--labels", help="with commas")
    a.add_argument("--contains")
    a.add_argument("--least", type=float, help="least confidence")
    a.add_argument("--start", type=int)
    a.add_argument("--end", type=int)
    for flag in ("negated", "quantified", "untracked", "linked", "unlinked", "cross_document", "grounded"):
        a.add_argument(f"--{flag}", action="store_true")
    a.add_argument("--threshold", type=float, default=0.7)
    a.add_argument("--least_tracks", type=int, default=1)
    a.add_argument("--most", type=int)
    a.add_argument("--levels", type=int, default=3)
    a.add_argument("--max_gap", type=int, default=50)
    a.add_argument("--form", default="full", choices=T.FORMS, help="how much of enhanced documents")
    a.add_argument("--out")
    a.add_argument("--format", default=None, choices=[*FORMATS, "html", "tree"])
    a.add_argument("--master", default=None)
    o = a.parse_args(argv)
    if o.command == "list":
        print("\n".join(sorted(core.queries())))
        return 0
    if o.command == "info":
        print(f"python {platform.python_version()}")
        print("\n".join(f"extractor {x.name}: {', '.join(sorted(x.labels))}; {', '.join(sorted(x.abilities))}; {'ready' if x.ready() else 'not ready'}" for x in N.EXTRACTORS.values()))
        print("\n".join(f"stack {n}: {' > '.join(xs)}" for n, xs in N.STACKS.items()))
        return 0
    if o.command == "dataset" and o.paths[:1] == ["list"]:
        print("\n".join(f"{x.name}: {x.task}, {x.shape}, {x.files}, {' '.join(x.labels) or 'any label'}" for x in D.DATASETS.values()))
        return 0
    if not o.paths:
        a.error(f"{o.command} needs a path or a query")
    spark = spark or get_spark(master=o.master)
    labels = o.labels.split(",") if o.labels else None
    if o.command in ("run", "explain"):
        if o.paths[0] not in core.queries() or not o.data:
            a.error("a query of `list` and --data are needed")
        df = core.queries()[o.paths[0]](spark, o.data)
        if o.command == "explain":
            df.explain("formatted")
            return 0
    elif o.command == "extract":
        g = grounded_of(spark, o.paths, o.models, o.strategy, labels)
        spans = spans_in(g)
        if o.least is not None:
            spans = spans.where(F.col("confidence") >= o.least)
        df = _lines(g) if o.grounded else highlighted(g, spans) if o.format == "html" else tree_lines(spans) if o.format == "tree" else spans
    elif o.command == "validate":
        g = read_grounded(spark, o.paths)
        df = S.validation_issues(spans_in(g), g.select("doc_id", "text"))
    elif o.command == "query":
        df = queried(read_grounded(spark, o.paths), o)
    elif o.command == "eval":
        if not o.gold:
            a.error("eval needs --gold")
        df = evaluated(read_grounded(spark, o.paths), read_grounded(spark, [o.gold]))
    elif o.command == "compare":
        if len(o.paths) != 2:
            a.error("compare needs two paths")
        df = compared(*[read_grounded(spark, [p]) for p in o.paths])
    elif o.command == "analyze":
        df = analyzed(spark, o.paths, o.models.split(","))
    elif o.command == "enhance":
        df = T.exported(with_identities(with_tracks(read_grounded(spark, o.paths)), o.threshold), o.form).select("json")
    elif o.command == "crossdoc":
        g = read_grounded(spark, o.paths)
        df = T.cluster_filter(identities_in(with_identities(with_tracks(g), o.threshold)), o.least_tracks, o.cross_document, labels, o.most)
    elif o.command == "pipeline":
        df = _lines(with_identities(with_tracks(grounded_of(spark, o.paths, o.models, o.strategy, labels)), o.threshold))
    elif o.command == "communities":
        df = G.hierarchy(G.cooccurrence_edges(spans_in(read_grounded(spark, o.paths)), o.max_gap), o.levels)
    else:
        if o.paths[0] != "load" or len(o.paths) != 3:
            a.error("dataset list, or dataset load NAME PATH")
        df = D.load(spark, o.paths[1], o.paths[2])
    if o.out:
        form = o.format if o.format in FORMATS else "text" if len(df.columns) == 1 else "jsonl"
        write(df, o.out, form)
    else:
        df.show(50, truncate=100)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
