"""Signals, tracks and identities: mentions, mentions that mean the same in a document, and what they mean across documents.

signals     doc_id, signal_id, start_char, end_char, surface, label, confidence, negated, quantifier
tracks      doc_id, track_id, canonical_surface, label, confidence, signals array<struct<signal_id, position>>
identities  identity_id, name, label, kb_id, source (coreference, knowledge_base, hybrid), n_tracks

A track is named by its first signal in reading order; all ids stay what they are, so results do not depend on the order in
which rows arrive. A document's signals are bounded by its text, so arrays by document or track are, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_negated, quantifier

SIGNALS = "array<struct<signal_id:bigint,position:int>>"
GROUNDED = (
    "doc_id bigint, text string, signals array<struct<signal_id:bigint,start_char:int,end_char:int,surface:string,label:string,confidence:double,negated:boolean,quantifier:string>>, "
    "tracks array<struct<track_id:bigint,canonical_surface:string,label:string,confidence:double,signals:" + SIGNALS + ",identity_id:bigint>>"
)


def signals_of(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Signals of entities (pred_id, doc_id, text, label, start_char, end_char, confidence): each with whether the three words
    before it negate it and what the word before it says of quantity; null where the document has no text or the entity no
    place."""
    d = documents.select("doc_id", F.col("text").alias("__doc"))
    e = entities.select("doc_id", F.col("pred_id").alias("signal_id"), "start_char", "end_char", F.col("text").alias("surface"), "label", "confidence").join(d, "doc_id", "left")
    placed = F.col("__doc").isNotNull() & (F.col("start_char") >= 0)
    return e.withColumns({"negated": F.when(placed, is_negated(F.col("__doc"), F.col("start_char"))), "quantifier": F.when(placed, quantifier(F.col("__doc"), F.col("start_char")))}).drop("__doc")


def tracks_of(signals: DataFrame, clusters: DataFrame) -> DataFrame:
    """Tracks of signals by clusters (doc_id, signal_id, cluster); signals without a cluster are in no track. Positions count
    from 0 in reading order."""
    s = signals.join(clusters.select("doc_id", "signal_id", "cluster"), ["doc_id", "signal_id"]).where("cluster IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct("start_char", "end_char", "signal_id", "surface", "label")))
    t = s.groupBy("doc_id", F.col("cluster").alias("track_id")).agg(ordered.alias("o"), F.avg("confidence").alias("confidence"))
    return t.select("doc_id", "track_id", F.col("o")[0]["surface"].alias("canonical_surface"), F.col("o")[0]["label"].alias("label"), "confidence", F.transform("o", lambda x, i: F.struct(x["signal_id"].alias("signal_id"), i.alias("position"))).alias("signals"))


def members(tracks: DataFrame) -> DataFrame:
    """(doc_id, track_id, signal_id, position)"""
    return tracks.select("doc_id", "track_id", F.inline("signals"))


def merge_tracks(tracks: DataFrame, signals: DataFrame, groups: DataFrame) -> DataFrame:
    """Tracks that groups (doc_id, track_id, into) put together: the signals of all in reading order, positions counted anew, name
    and label of the track `into`; confidence is the mean over signals. Tracks in no group stay. A group whose `into` is no
    track takes the name of its smallest track."""
    of = tracks.join(groups, ["doc_id", "track_id"], "left").withColumn("into", F.coalesce("into", "track_id"))
    heads = of.groupBy("doc_id", "into").agg(F.min_by(F.struct("canonical_surface", "label"), F.struct((F.col("track_id") != F.col("into")).cast("int"), "track_id")).alias("head"))
    clusters = of.select("doc_id", "into", F.inline("signals")).select("doc_id", "signal_id", F.col("into").alias("cluster"))
    return tracks_of(signals, clusters).join(heads.withColumnRenamed("into", "track_id"), ["doc_id", "track_id"]).select("doc_id", "track_id", "head.canonical_surface", "head.label", "confidence", "signals")


def identities_of(tracks: DataFrame, link: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(identities, track_refs): tracks of all documents by equal label and name (without case and blanks at the ends), or by
    link (doc_id, track_id, identity_id) where given. The smallest (doc_id, track_id) names an identity; its id is the
    smallest track_id unless given."""
    t = tracks.select("doc_id", "track_id", "canonical_surface", "label", "confidence")
    if link is None:
        key = [F.col("label").alias("k_label"), F.lower(F.trim("canonical_surface")).alias("k_name")]
        ids = t.groupBy(*key).agg(F.min("track_id").alias("identity_id"))
        t = t.withColumns({"k_label": F.col("label"), "k_name": F.lower(F.trim("canonical_surface"))}).join(ids, ["k_label", "k_name"])
    else:
        t = t.join(link, ["doc_id", "track_id"])
    first = F.min_by(F.struct("canonical_surface", "label"), F.struct("doc_id", "track_id"))
    i = t.groupBy("identity_id").agg(first.alias("x"), F.count(F.lit(1)).alias("n_tracks"), F.count_distinct("doc_id").alias("n_docs"), F.avg("confidence").alias("confidence"))
    return i.select("identity_id", F.col("x.canonical_surface").alias("name"), "x.label", "n_tracks", "n_docs", "confidence"), t.select("doc_id", "track_id", "identity_id")


def upsert(knowledge: DataFrame, identities: DataFrame) -> DataFrame:
    """(name, label, kb_id, identity_id, source): a knowledge base (kb_id, kb_name, entity_type) with identities put in: one that an
    entry knows by its name (without case) becomes hybrid, a new one comes as coreference, entries that no identity
    touches stay as they are. Of entries or identities of one name the smallest id counts."""
    k = knowledge.where("kb_name IS NOT NULL").groupBy(F.lower(F.trim("kb_name")).alias("key")).agg(F.min(F.struct("kb_id", "kb_name", "entity_type")).alias("k"))
    i = identities.where("name IS NOT NULL").groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min(F.struct("identity_id", "name", "label")).alias("i"))
    j = k.join(i, "key", "full_outer")
    source = F.when(F.col("k").isNull(), "coreference").when(F.col("i").isNull(), "knowledge_base").otherwise("hybrid")
    return j.select(F.coalesce("k.kb_name", "i.name").alias("name"), F.coalesce("k.entity_type", "i.label").alias("label"), "k.kb_id", "i.identity_id", source.alias("source"))


def to_entities(signals: DataFrame, tracks: DataFrame, track_refs: DataFrame) -> DataFrame:
    """Signals as entities again: (doc_id, signal_id, surface, label, start_char, end_char, confidence, track_id, identity_id);
    the two ids are null where a signal is in no track or its track in no identity."""
    s = signals.join(members(tracks).select("doc_id", "signal_id", "track_id"), ["doc_id", "signal_id"], "left").join(track_refs, ["doc_id", "track_id"], "left")
    return s.select("doc_id", "signal_id", "surface", "label", "start_char", "end_char", "confidence", "track_id", "identity_id")


def from_entities(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals, tracks) of entities (doc_id, pred_id, text, label, start_char, end_char, confidence, canonical_id); an entity
    without canonical_id is a track of its own."""
    s = entities.select("doc_id", F.col("pred_id").alias("signal_id"), "start_char", "end_char", F.col("text").alias("surface"), "label", "confidence", F.lit(None).cast("boolean").alias("negated"), F.lit(None).cast("string").alias("quantifier"))
    shared = entities.groupBy("doc_id", "canonical_id").agg(F.min("pred_id").alias("cluster")).where("canonical_id IS NOT NULL")
    c = entities.select("doc_id", F.col("pred_id").alias("signal_id"), "canonical_id").join(shared, ["doc_id", "canonical_id"], "left")
    return s, tracks_of(s, c.select("doc_id", "signal_id", F.coalesce("cluster", "signal_id").alias("cluster")))


def stats(signals: DataFrame, tracks: DataFrame, track_refs: DataFrame) -> DataFrame:
    """One row a document with signals: counts of signals, tracks, identities, linked and untracked signals, singletons and
    negated signals; mean track size and mean confidence, 0 where there is none."""
    e = to_entities(signals, tracks, track_refs).join(signals.select("doc_id", "signal_id", "negated"), ["doc_id", "signal_id"])
    a = e.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_signals"), F.count_if(F.col("identity_id").isNotNull()).alias("n_linked"), F.count_if(F.col("track_id").isNull()).alias("n_untracked"),
        F.count_if(F.col("negated")).alias("n_negated"), F.count_distinct("identity_id").alias("n_identities"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
    )
    size = F.size("signals")
    b = tracks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tracks"), F.count_if(size == 1).alias("n_singletons"), F.avg(size).alias("mean_track_size"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_tracks", "n_singletons", "mean_track_size")}
    return a.join(b, "doc_id", "left").withColumns(zero)


def linked(signals: DataFrame, tracks: DataFrame, track_refs: DataFrame) -> DataFrame:
    """Signals whose track has an identity."""
    m = members(tracks).join(track_refs.where("identity_id IS NOT NULL"), ["doc_id", "track_id"], "left_semi")
    return signals.join(m, ["doc_id", "signal_id"], "left_semi")


def unlinked(signals: DataFrame, tracks: DataFrame, track_refs: DataFrame) -> DataFrame:
    """Signals whose track, if they have one, has no identity."""
    m = members(tracks).join(track_refs.where("identity_id IS NOT NULL"), ["doc_id", "track_id"], "left_semi")
    return signals.join(m, ["doc_id", "signal_id"], "left_anti")


def untracked(signals: DataFrame, tracks: DataFrame) -> DataFrame:
    return signals.join(members(tracks), ["doc_id", "signal_id"], "left_anti")


def cluster_filter(identities: DataFrame, least_tracks: int = 1, cross_document: bool = False, labels: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Identities of at least so many tracks, of several documents, of labels (any of, without case), the widest spread first:
    by documents, tracks, then name, all falling; `most` keeps the first ones."""
    i = identities.where(F.col("n_tracks") >= least_tracks)
    if cross_document:
        i = i.where("n_docs > 1")
    if labels is not None:
        i = i.where(F.lower("label").isin([x.lower() for x in labels]))
    i = i.orderBy(F.col("n_docs").desc(), F.col("n_tracks").desc(), F.col("name").desc(), "identity_id")
    return i if most is None else i.limit(most)


# --- grounded documents ------------------------------------------------------------------------------------


def grounded(documents: DataFrame, signals: DataFrame, tracks: DataFrame, track_refs: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, signals, tracks): one row a document that has text or signals, as GROUNDED says."""
    s = signals.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("signal_id", "start_char", "end_char", "surface", "label", "confidence", "negated", "quantifier"))).alias("signals"))
    refs = track_refs if track_refs is not None else tracks.select("doc_id", "track_id", F.lit(None).cast("bigint").alias("identity_id"))
    t = tracks.join(refs, ["doc_id", "track_id"], "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("track_id", "canonical_surface", "label", "confidence", "signals", "identity_id"))).alias("tracks"))
    j = documents.select("doc_id", "text").join(s, "doc_id", "full_outer").join(t, "doc_id", "left")
    return j.where("text IS NOT NULL OR signals IS NOT NULL")


def grounded_json(documents: DataFrame) -> DataFrame:
    """(doc_id, json): grounded documents as JSON objects, one a line when written as text."""
    return documents.select("doc_id", F.to_json(F.struct("doc_id", "text", "signals", "tracks")).alias("json"))


FORMS = ("full", "signals", "minimal")


def exported(documents: DataFrame, form: str = "full") -> DataFrame:
    """(doc_id, json) of grounded documents: all of them, only their signals, or only surfaces with labels."""
    if form not in FORMS:
        raise ValueError(f"{form}: one of {', '.join(FORMS)}")
    if form == "full":
        return grounded_json(documents)
    if form == "signals":
        return documents.select("doc_id", F.to_json(F.struct("doc_id", "signals")).alias("json"))
    pairs = F.transform("signals", lambda x: F.struct(x["surface"].alias("text"), x["label"].alias("label")))
    return documents.select("doc_id", F.to_json(F.struct("doc_id", pairs.alias("entities"))).alias("json"))


def from_grounded_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Grounded documents of JSON lines; a line that is no such object is dropped."""
    x = lines.select(F.from_json(column, GROUNDED).alias("x")).select("x.*")
    return x.where("doc_id IS NOT NULL")


def tables_of(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, tracks, track_refs) of grounded documents."""
    s = documents.select("doc_id", F.inline("signals"))
    t = documents.select("doc_id", F.inline("tracks"))
    return s, t.drop("identity_id"), t.where("identity_id IS NOT NULL").select("doc_id", "track_id", "identity_id")


def in_range(signals: DataFrame, start: int, end: int) -> DataFrame:
    return signals.where((F.col("start_char") >= start) & (F.col("end_char") <= end))


def overlapping(signals: DataFrame, start: int, end: int) -> DataFrame:
    return signals.where((F.col("start_char") < end) & (F.col("end_char") > start))


def passes(signal: Column, track: Column, identity: Column, least: tuple[float, float, float]) -> Column:
    """Whether the confidences of all three levels reach theirs; a level that is null passes."""
    return F.coalesce(signal >= least[0], F.lit(True)) & F.coalesce(track >= least[1], F.lit(True)) & F.coalesce(identity >= least[2], F.lit(True))


def combined(signal: Column, track: Column, identity: Column) -> Column:
    """The geometric mean of the confidences of three levels."""
    return F.pow(signal * track * identity, F.lit(1 / 3))


def matches_viewport(viewport: Column, wanted: str | None) -> Column:
    """An identity without a viewport, and no wanted one, match any."""
    return F.lit(True) if wanted is None else viewport.isNull() | (viewport == wanted)


def latest_position(tracks: DataFrame) -> DataFrame:
    """(doc_id, track_id, signal_id): the last signal of every track."""
    w = Window.partitionBy("doc_id", "track_id").orderBy(F.col("position").desc())
    return members(tracks).withColumn("__n", F.row_number().over(w)).where("__n = 1").select("doc_id", "track_id", "signal_id")
