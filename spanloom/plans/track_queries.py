"""Queries over signals, tracks and identities: tracks are equal names of a label in a document."""

from pyspark.sql import functions as F

from ..operators import coreference as C
from ..operators import tracks as T
from ..queries import query
from ..session import Scratch
from ..session import read_table as t

_S = "s AS (SELECT doc_id, pred_id AS signal_id, text AS surface, label, start_char, end_char, confidence FROM predictions)"
_C = "c AS (SELECT doc_id, signal_id, first_value(signal_id) OVER w AS track_id, row_number() OVER w - 1 AS position, surface, label, confidence FROM s WHERE surface IS NOT NULL AND label IS NOT NULL AND start_char IS NOT NULL WINDOW w AS (PARTITION BY doc_id, label, lower(trim(surface, ' ')) ORDER BY start_char, end_char NULLS FIRST, signal_id))"
_T = "tr AS (SELECT doc_id, track_id, arg_min(surface, position) AS canonical_surface, label, avg(confidence) AS confidence, count(*) AS n FROM c GROUP BY doc_id, track_id, label)"
_I = "id AS (SELECT label, lower(trim(canonical_surface, ' ')) AS k, min(track_id) AS identity_id, arg_min(canonical_surface, (doc_id, track_id)) AS name, count(*) AS n_tracks, count(DISTINCT doc_id) AS n_docs FROM tr GROUP BY 1, 2)"
_REFS = "refs AS (SELECT tr.doc_id, tr.track_id, id.identity_id FROM tr JOIN id ON id.label = tr.label AND id.k = lower(trim(tr.canonical_surface, ' ')))"
_ALL = f"WITH {_S}, {_C}, {_T}, {_I}, {_REFS}"


def _parts(spark, d):
    p = t(spark, d, "predictions")
    signals = T.signals_of(p, t(spark, d, "documents"))
    clusters = C.resolve(p, fuzzy=False, pronouns=False).select("doc_id", F.col("pred_id").alias("signal_id"), "cluster")
    return signals, T.tracks_of(signals, clusters)


@query("tracks", f"{_ALL} SELECT doc_id, track_id, canonical_surface, label, round(confidence, 9) AS confidence, n AS n_signals FROM tr")
def tracks(spark, d):
    return _parts(spark, d)[1].select("doc_id", "track_id", "canonical_surface", "label", F.round("confidence", 9).alias("confidence"), F.size("signals").cast("long").alias("n_signals"))


@query("track_members", f"{_ALL} SELECT doc_id, track_id, signal_id, position::INT AS position FROM c")
def track_members(spark, d):
    return T.members(_parts(spark, d)[1])


@query("identities", f"{_ALL} SELECT identity_id, name, label, n_tracks, n_docs FROM id")
def identities(spark, d):
    return T.identities_of(_parts(spark, d)[1])[0].select("identity_id", "name", "label", "n_tracks", "n_docs")


@query("cross_document_identities", f"{_ALL} SELECT identity_id, name, label, n_tracks, n_docs FROM id WHERE n_docs > 1 AND n_tracks >= 3 AND lower(label) IN ('org', 'per')")
def cross_document_identities(spark, d):
    i = T.identities_of(_parts(spark, d)[1])[0]
    return T.cluster_filter(i, 3, True, ["ORG", "PER"]).select("identity_id", "name", "label", "n_tracks", "n_docs")


@query("knowledge_base_upsert", f"{_ALL}, k AS (SELECT lower(trim(kb_name, ' ')) AS key, min(kb_id) AS kb_id, arg_min(kb_name, kb_id) AS kb_name, arg_min(entity_type, kb_id) AS entity_type FROM kb_entities WHERE kb_name IS NOT NULL GROUP BY 1), i AS (SELECT lower(trim(name, ' ')) AS key, min(identity_id) AS identity_id, arg_min(name, identity_id) AS name, arg_min(label, identity_id) AS label FROM id GROUP BY 1) SELECT coalesce(kb_name, name) AS name, coalesce(entity_type, label) AS label, kb_id, identity_id, CASE WHEN kb_id IS NULL THEN 'coreference' WHEN identity_id IS NULL THEN 'knowledge_base' ELSE 'hybrid' END AS source FROM k FULL JOIN i USING (key)")
def knowledge_base_upsert(spark, d):
    return T.upsert(t(spark, d, "kb_entities"), T.identities_of(_parts(spark, d)[1])[0])


@query("tracked_entities", f"{_ALL} SELECT s.doc_id, s.signal_id, s.surface, s.label, s.start_char, s.end_char, s.confidence, c.track_id, refs.identity_id FROM s LEFT JOIN c USING (doc_id, signal_id) LEFT JOIN refs ON refs.doc_id = c.doc_id AND refs.track_id = c.track_id")
def tracked_entities(spark, d):
    s, tr = _parts(spark, d)
    return T.to_entities(s, tr, T.identities_of(tr)[1])


_W = r"list_filter(regexp_split_to_array(lower(substring(d.text, 1, p.start_char)), '[ \t\n\x0B\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')[-3:]"


@query(
    "document_track_stats",
    f"""{_ALL}, ng AS (SELECT p.pred_id, len(list_intersect({_W}, ['not', 'no', 'never', 'none', 'neither', 'nor', 'without', 'hardly', 'scarcely', 'barely', 'don''t', 'doesn''t', 'didn''t', 'won''t', 'wouldn''t', 'can''t', 'cannot', 'isn''t'])) > 0 AS negated FROM predictions p JOIN documents d ON d.doc_id = p.doc_id WHERE p.start_char >= 0 AND d.text IS NOT NULL),
        a AS (SELECT s.doc_id, count(*) AS n_signals, count(refs.identity_id) AS n_linked, count(*) FILTER (c.track_id IS NULL) AS n_untracked, count(*) FILTER (ng.negated) AS n_negated, count(DISTINCT refs.identity_id) AS n_identities, coalesce(avg(s.confidence), 0) AS mc FROM s LEFT JOIN c USING (doc_id, signal_id) LEFT JOIN refs ON refs.doc_id = c.doc_id AND refs.track_id = c.track_id LEFT JOIN ng ON ng.pred_id = s.signal_id GROUP BY s.doc_id),
        b AS (SELECT doc_id, count(*) AS n_tracks, count(*) FILTER (n = 1) AS n_singletons, avg(n) AS ms FROM tr GROUP BY doc_id)
        SELECT doc_id, n_signals, n_linked, n_untracked, n_negated, n_identities, round(mc, 9) AS mean_confidence, coalesce(n_tracks, 0) AS n_tracks, coalesce(n_singletons, 0) AS n_singletons, round(coalesce(ms, 0), 9) AS mean_track_size FROM a LEFT JOIN b USING (doc_id)""",
)
def document_track_stats(spark, d):
    s, tr = _parts(spark, d)
    x = T.stats(s, tr, T.identities_of(tr)[1])
    return x.withColumns({c: F.round(c, 9) for c in ("mean_confidence", "mean_track_size")})


@query("merged_tracks", f"{_ALL}, g AS (SELECT doc_id, track_id, canonical_surface, label, min(track_id) OVER (PARTITION BY doc_id, lower(trim(canonical_surface, ' '))) AS into_id FROM tr) SELECT g.doc_id, g.into_id AS track_id, any_value(h.canonical_surface) AS canonical_surface, any_value(h.label) AS label, count(*) AS n_signals FROM g JOIN c ON c.doc_id = g.doc_id AND c.track_id = g.track_id JOIN tr h ON h.doc_id = g.doc_id AND h.track_id = g.into_id GROUP BY g.doc_id, g.into_id")
def merged_tracks(spark, d):
    """Tracks of one name, whatever their label, put together under the smallest."""
    s, tr = _parts(spark, d)
    into = tr.groupBy("doc_id", F.lower(F.trim("canonical_surface")).alias("k")).agg(F.min("track_id").alias("into"))
    groups = tr.select("doc_id", "track_id", F.lower(F.trim("canonical_surface")).alias("k")).join(into, ["doc_id", "k"]).select("doc_id", "track_id", "into")
    return T.merge_tracks(tr, s, groups).select("doc_id", "track_id", "canonical_surface", "label", F.size("signals").cast("long").alias("n_signals"))


@query("grounded_round_trip", f"{_ALL} SELECT s.doc_id, s.signal_id, s.surface, s.label, s.start_char, s.end_char, c.track_id FROM s LEFT JOIN c USING (doc_id, signal_id)")
def grounded_round_trip(spark, d):
    """Signals and tracks written as JSON objects of documents and read back."""
    s, tr = _parts(spark, d)
    lines, _ = Scratch(spark, "grounded").write(T.grounded_json(T.grounded(t(spark, d, "documents"), s, tr)).select(F.col("json").alias("value")))
    s2, t2, refs = T.tables_of(T.from_grounded_json(lines))
    return T.to_entities(s2, t2, refs).select("doc_id", "signal_id", "surface", "label", "start_char", "end_char", "track_id")


@query("unlinked_signals", f"{_ALL} SELECT s.signal_id FROM s WHERE s.signal_id NOT IN (SELECT signal_id FROM c JOIN refs USING (doc_id, track_id) JOIN id USING (identity_id) JOIN kb_entities k ON lower(k.kb_name) = lower(trim(id.name, ' ')))")
def unlinked_signals(spark, d):
    """Signals of no identity that the catalogue knows."""
    s, tr = _parts(spark, d)
    i, refs = T.identities_of(tr)
    known = i.join(t(spark, d, "kb_entities").select(F.lower("kb_name").alias("k")), F.lower(F.trim("name")) == F.col("k"), "left_semi")
    return T.unlinked(s, tr, refs.join(known, "identity_id", "left_semi")).select("signal_id")
