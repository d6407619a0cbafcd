"""Commands over one's own files, readers of datasets, extractors by name, and operators that SQL does not cover."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from spanloom import __main__ as cli
from spanloom.functions import scores as X
from spanloom.operators import analysis as A
from spanloom.operators import coreference as C
from spanloom.operators import events as V
from spanloom.operators import extractors as E
from spanloom.operators import graph as G
from spanloom.operators import models as N
from spanloom.operators import relations as R
from spanloom.operators import tracks as T
from spanloom.sources import datasets as D

A_TEXT = "Dr. Mira Solwen joined Harbour Company and met Paul Krane in Paris. Solwen wrote to mira@ostwick.example on 2021-03-04."
B_TEXT = "Harbour Company paid $5 million. Mira Solwen was not there."


def run(spark, tmp_path, *args, out="out"):
    path = f"{tmp_path}/{out}"
    assert cli.main([*args, "--out", path], spark) == 0
    return path


def test_extract_enhance_crossdoc_eval_compare(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(A_TEXT)
    (tmp_path / "in/b.txt").write_text(B_TEXT)
    g = run(spark, tmp_path, "extract", f"{tmp_path}/in", "--grounded", out="g")
    docs = cli.read_grounded(spark, [g]).collect()
    assert {r.text for r in docs} == {A_TEXT, B_TEXT}
    for r in docs:
        assert all(r.text[s.start_char : s.end_char] == s.surface for s in r.signals)
    negated = {s.surface: s.negated for r in docs for s in r.signals}
    assert negated["Mira Solwen"] is False and negated["mira@ostwick.example"] is False
    assert cli.main(["validate", g], spark) == 0
    e = run(spark, tmp_path, "enhance", g, out="e")
    i = run(spark, tmp_path, "crossdoc", g, "--cross_document", out="i")
    names = {r["name"].lower() for r in spark.read.json(i).collect()}
    assert "harbour company" in names
    q = run(spark, tmp_path, "query", e, "--labels", "email,money", "--least", "0.9", out="q")
    assert {r.text for r in spark.read.json(q).collect()} == {"mira@ostwick.example", "$5 million"}
    unlinked = run(spark, tmp_path, "query", g, "--unlinked", out="u")
    assert spark.read.json(unlinked).count() == sum(len(r.signals) for r in docs)
    v = run(spark, tmp_path, "eval", g, "--gold", e, out="v")
    assert {r["mode"]: r.f1 for r in spark.read.json(v).collect()} == dict.fromkeys(("strict", "exact", "partial", "type"), 1.0)
    small = [json.loads(r.value) for r in spark.read.text(run(spark, tmp_path, "enhance", g, "--form", "minimal", out="m")).collect()]
    assert {"text": "$5 million", "label": "MONEY"} in [x for r in small for x in r["entities"]]
    h = run(spark, tmp_path, "extract", f"{tmp_path}/in", "--models", "pattern_only", "--grounded", out="h")
    c = {(r.side, r.text) for r in spark.read.json(run(spark, tmp_path, "compare", g, h, out="c")).collect()}
    assert ("both", "$5 million") in c and ("only_first", "paris") in c and not any(s == "only_second" for s, _ in c)
    n = {r.models: r.n for r in spark.read.json(run(spark, tmp_path, "analyze", f"{tmp_path}/in", "--models", "pattern,rule,heuristic", out="n")).collect()}
    assert n["pattern+rule"] >= 1
    p = cli.read_grounded(spark, [run(spark, tmp_path, "pipeline", f"{tmp_path}/in", out="p")]).collect()
    assert all(t.identity_id is not None for r in p for t in r.tracks)
    html = spark.read.json(run(spark, tmp_path, "extract", f"{tmp_path}/in", "--format", "html", out="html")).first().html
    assert "<mark" in html
    assert spark.read.json(run(spark, tmp_path, "communities", g, "--levels", "2", out="s")).columns == ["level_0_community", "level_1_community", "node"]
    for words in (["list"], ["info"], ["dataset", "list"]):
        assert cli.main(words) == 0
    assert "conll" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["extract"], spark)


def test_readers_of_datasets(spark, tmp_path):
    w = lambda name, *rows: (tmp_path / name).write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows)) and str(tmp_path / name)
    served = w("served.json", {"features": [], "rows": [{"row_idx": 0, "row": {"tokens": ["Mira", "slept"], "ner_tags": [1, 0]}}, {"row_idx": 1, "row": {"tokens": None, "ner_tags": None}}]})
    assert [(r.token, r.tag) for r in D.load(spark, "served_rows", served).orderBy("pos").collect()] == [("Mira", "B-PER"), ("slept", "O")]
    strings = w("s.jsonl", {"tokens": ["a", "b"], "tags": ["O", "B-X"]}, {"tokens": None})
    assert [(r.token, r.tag) for r in D.load(spark, "string_tag_jsonl", strings).orderBy("pos").collect()] == [("a", "O"), ("b", "B-X")]
    mentions = w("p.jsonl", {"id": "d", "sentences": [["Mira", "slept", "."], ["She", "woke"]], "mention_clusters": [[[0, 0, 1], [1, 0, 1]], [[0, 1, 3]]]})
    assert {(r.sentence, r.first_token, r.last_token, r.cluster) for r in D.load(spark, "preco", mentions).collect()} == {(0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 2, 1)}
    parts = w("d.jsonl", {"id": "d", "text": "pain in left and right arm", "entities": [{"label": "ADR", "spans": [[21, 26], [0, 4]]}, {"label": "X", "spans": []}]})
    r = D.load(spark, "discontinuous_jsonl", parts).collect()
    assert [(x.label, [tuple(s) for s in x.segments], x.text) for x in r] == [("ADR", [(0, 4), (21, 26)], "pain t arm")]
    good = w("g.jsonl", {"id": "1", "text": "Mira slept", "entities": [{"text": "Mira", "label": "PER", "start": 0, "end": 4, "confidence": 1.0}]})
    bad = w("b.jsonl", {"id": "1", "text": "Mira slept", "entities": [{"text": "Mira", "label": "PER", "start": 1, "end": 4, "confidence": 1.0}]})
    assert D.load(spark, "entity_jsonl", good).count() == 1
    with pytest.raises(Exception, match="do not hold"):
        D.load(spark, "entity_jsonl", bad).collect()
    bio = w("t.tsv", "Aspirin x y B-Chemical", "pain x y DISEASE")
    assert [r.tag for r in D.load(spark, "biomedical_conll", bio).orderBy("pos").collect()] == ["B-Chemical", "B-Disease"]
    csv = w("e.csv", "doc,text,type", "d1,met,event", "d2,,event")
    assert [(r.doc_id, r.text) for r in D.load(spark, "event_csv", csv).collect()] == [("d1", "met")]
    assert [tuple(x) for x in D.gold_specs(spark.createDataFrame([("a:b:PER:0:3",), ("no",)], "value string")).collect()] == [("a:b", "PER", 0, 3)]
    with pytest.raises(ValueError):
        D.load(spark, "nothing", "x")
    fits = {(r.extractor, r.task): r.fits for r in D.compatibility(spark).collect()}
    assert fits["heuristic", "ner"] and not fits["heuristic", "relations"]


def test_made_up_examples(spark):
    x = D.synthetic(spark, 60)
    rows = x.orderBy("doc_id").collect()
    assert len(rows) == 60 and all(r.text[e.start : e.end] == e.text for r in rows for e in r.entities)
    assert rows == D.synthetic(spark, 60).orderBy("doc_id").collect()
    assert {r.domain for r in D.chosen(x, domain="News").collect()} == {"news"} and {r.difficulty for r in D.chosen(x, difficulty="hard").collect()} == {"hard"}
    assert [r.doc_id for r in D.chosen(x, skip=3, take=4).collect()] == [3, 4, 5, 6] and D.chosen(x, label="money").count() == D.chosen(x, domain="business").count()


def test_addresses(spark, tmp_path):
    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = b"<html><style>p{}</style><p>A &amp; B</p><div>C</div></html>" if self.path == "/p" else b"plain <text>"
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "a.jsonl").write_text('{"id": "x", "text": "one"}\n{"text": "two"}')
    (tmp_path / "b.html").write_text("<p>three</p>")
    try:
        assert D.fetch(f"{at}/p") == "A & B C" and D.fetch(f"{at}/q") == "plain <text>"
        got = {r.text for r in D.documents_at(spark, f"{at}/p", f"{tmp_path}/a.jsonl", f"{tmp_path}/b.html").collect()}
        assert got == {"A & B C", "one", "two", "three"}
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        D.fetch("file:///etc/passwd")


def test_extractors_by_name(spark):
    d = spark.createDataFrame([(1, A_TEXT), (2, None), (3, "")], "doc_id bigint, text string")
    N.register(N.canned("said", [(0, 3, "Dr.", "TITLE", "canned", 1.0), (4, 8, "Nora", "PER", "canned", 1.0)], checked=True))

    def broken(text):
        raise RuntimeError("no weights")

    N.register(N.Extractor("broken", broken, frozenset({"X"})))
    N.register(N.Extractor("absent", broken, frozenset({"X"}), ready=lambda: False))
    try:
        assert [r.surface for r in N.extract(d, "said").collect()] == ["Dr."]
        assert N.extract(d.where("doc_id = 1"), ["said", "broken"]).count() == 1 and N.extract(d, ["absent", "said"]).count() == 1
        with pytest.raises(Exception, match="no weights"):
            N.extract(d, "broken").collect()
        with pytest.raises(RuntimeError):
            N.layers("absent")
        with pytest.raises(ValueError):
            N.layers("nobody")
    finally:
        for n in ("said", "broken", "absent"):
            N.EXTRACTORS.pop(n)
    assert {r.label for r in N.auto(d, ["EMAIL", "DATE"]).collect()} == {"EMAIL", "DATE"}
    h = N.hybrid(N.extract(d, "heuristic"), N.extract(d, "pattern"))
    assert {"mira@ostwick.example", "2021-03-04", "Paris"} <= {r.surface for r in h.collect()}


def test_layers_agree_as_by_brute_force():
    import random

    def slow(layers, strategy):
        taken = []
        for x in [x for layer in layers for x in layer]:
            hit = [k for k, y in enumerate(taken) if x[0] < y[1] and y[0] < x[1]]
            if not hit:
                taken.append(x)
            elif strategy != "priority":
                worth = (lambda y: y[1] - y[0]) if strategy == "longest" else (lambda y: y[5])
                best = min(hit, key=lambda k: (-worth(taken[k]), taken[k][0]))
                keep = x if worth(x) > worth(taken[best]) else taken[best]
                taken = [y for k, y in enumerate(taken) if k not in hit] + [keep]
        return sorted(taken)

    random.seed(3)
    for strategy in ("priority", "longest", "confidence"):
        for _ in range(60):
            rows = [(s, s + random.randint(1, 9), "x", "A", "r", random.choice([0.1, 0.5, 0.9])) for s in (random.randint(0, 60) for _ in range(25))]
            assert sorted(E.resolve_layers([rows[:10], rows[10:]], strategy)) == slow([rows[:10], rows[10:]], strategy)


def test_coreference_with_pronouns(spark):
    m = [(1, "Mira Solwen", "PER"), (2, "Harbour Company", "ORG"), (3, "She", "PER"), (4, "it", "ORG"), (5, "Solwen", "PER"), (6, "Paris", "LOC"), (7, "its", "LOC"), (8, "he", "PER"), (9, "MIRA SOLWEN ", "PER")]
    assert dict(C.resolve_document(m)) == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1, 6: 6, 7: 6, 8: 1, 9: 1}
    assert dict(C.resolve_document(m, fuzzy=False))[5] == 5 and dict(C.resolve_document([(1, "he", "PER")])) == {1: 1} and C.resolve_document([]) == []
    far = [(0, "Mira", "PER")] + [(k, "it", "ORG") for k in range(1, 40)] + [(99, "she", "PER")]
    assert dict(C.resolve_document(far))[99] == 99
    text = "John met Mary. He asked her. It rained."
    spans = spark.createDataFrame([(1, 1, 0, 4, "John", "PER"), (2, 1, 9, 13, "Mary", "PER")], "pred_id bigint, doc_id bigint, start_char int, end_char int, text string, kind string")
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    assert {(r.text, r.antecedent) for r in C.pronoun_links(spans, docs).collect()} == {("He", 1), ("her", 2)}
    s = [(r.sentence, text[r.start_char : r.end_char]) for r in C.sentences(docs).orderBy("sentence").collect()]
    assert s == [(0, "John met Mary."), (1, "He asked her."), (2, "It rained.")]
    c = [r.clause for r in C.clauses(spark.createDataFrame([(1, "I left, because it rained when we met. Yes")], "doc_id bigint, text string")).collect()]
    assert len(c) == 4
    a = spark.createDataFrame([(1, 7, 29)], "doc_id bigint, id bigint, start_char int")
    assert [(r.clause, r["rank"]) for r in C.discourse_antecedents(a, docs).orderBy("rank").collect()] == [(1, 1), (0, 2)]
    e = spark.createDataFrame([(1, 1, 0, "attacked", "conflict", "positive"), (1, 2, 9, "attacks", "conflict", "positive"), (1, 3, 12, "attack", "conflict", "negative")], "doc_id bigint, id bigint, start_char int, trigger string, event_type string, polarity string")
    assert {r.id: r.leader for r in C.leader_clusters(e).collect()} == {1: 1, 2: 1, 3: 3}


def test_events_and_their_arguments(spark):
    d = spark.createDataFrame([(1, "Mira Solwen will not sell the mill to Krane."), (2, ""), (3, None)], "doc_id bigint, text string")
    e = V.events(d)
    r = e.first()
    assert (r.trigger, r.event_type, r.polarity, r.tense, r.agent, r.patient) == ("sell", "business:transaction", "negative", "future", "Solwen", "Krane")
    spans = spark.createDataFrame([(5, 1, 0, 11, "Mira Solwen"), (6, 1, 38, 43, "Krane"), (7, 1, None, None, "x")], "pred_id bigint, doc_id bigint, start_char int, end_char int, text string")
    a = V.event_arguments(e, spans).first()
    assert (a.agent, a.patient, a.agent_id, a.patient_id) == ("Mira Solwen", "Krane", 5, 6)
    assert V.event_arguments(e, spans.limit(0)).first().agent == "Solwen" and V.events(d, {"rest": ["mill"]}).first().event_type == "rest"


def test_relations_both_ways(spark):
    text = "Mira Solwen works for Harbour Company based in Paris. Krane"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = [(1, 0, 11, "PER", 0.9), (2, 22, 37, "ORG", 0.8), (3, 47, 52, "LOC", 0.7), (4, 54, 59, "PER", None)]
    spans = spark.createDataFrame([(i, 1, text[s:e], s, e, k, c) for i, s, e, k, c in rows], "pred_id bigint, doc_id bigint, text string, start_char int, end_char int, kind string, confidence double")
    got = {(r.head_id, r.tail_id, r.relation) for r in R.relations(spans, docs).collect()}
    assert {(1, 2, "WORKS_FOR"), (2, 3, "LOCATED_IN")} <= got and (2, 1, "WORKS_FOR") not in got
    assert {(r.head_id, r.tail_id): r.relation for r in R.pair_relations(spans, docs).collect()}[1, 2] == "WORKS_FOR"
    s = {(r.head_id, r.tail_id): r.relation for r in R.scored_relations(spans, docs).collect()}
    assert s[1, 2] == "WORKS_FOR" and s[2, 3] == "LOCATED_IN"
    v = spark.createDataFrame([(1, [1.0, 0.0]), (4, [0.9, 0.1]), (2, [1.0, 0.0])], "pred_id bigint, vector array<double>")
    same = spark.createDataFrame([(1, 1, "Mira Solwen", 0, 11, "PER"), (2, 1, "Solwen", 20, 26, "PER"), (4, 1, "Krane", 40, 45, "PER"), (5, 1, "Sol", 50, 53, "PER"), (6, 1, "mira solwen", 60, 71, "PER")], "pred_id bigint, doc_id bigint, text string, start_char int, end_char int, kind string")
    assert {(r.left, r.right) for r in R.same_mention(same).collect()} == {(1, 2)}
    assert {(r.left, r.right) for r in R.same_mention(same, v).collect()} == {(1, 2), (1, 4), (2, 4)}


def test_tracks_merge_and_return(spark):
    e = spark.createDataFrame([(1, 1, "Mira", "PER", 5, 9, 0.5, 7), (2, 1, "Mira Solwen", "PER", 0, 4, 1.0, 7), (3, 1, "Paris", "LOC", 20, 25, None, None), (4, 1, "Rome", "LOC", None, None, 0.1, None)], "pred_id bigint, doc_id bigint, text string, label string, start_char int, end_char int, confidence double, canonical_id bigint")
    s, t = T.from_entities(e)
    rows = {r.track_id: r for r in t.collect()}
    assert set(rows) == {1, 3, 4} and rows[1].canonical_surface == "Mira Solwen" and [tuple(x) for x in rows[1].signals] == [(2, 0), (1, 1)] and rows[1].confidence == 0.75
    g = spark.createDataFrame([(1, 3, 1), (1, 1, 1)], "doc_id bigint, track_id bigint, into bigint")
    m = {r.track_id: r for r in T.merge_tracks(t, s, g).collect()}
    assert set(m) == {1, 4} and m[1].canonical_surface == "Mira Solwen" and [tuple(x) for x in m[1].signals] == [(2, 0), (1, 1), (3, 2)]
    i, refs = T.identities_of(t)
    x = T.stats(s.withColumn("negated", F.lit(False)), t, refs).first()
    assert (x.n_signals, x.n_linked, x.n_tracks, x.n_singletons, x.n_identities) == (4, 4, 3, 2, 3)
    assert T.untracked(s, t.where("track_id = 1")).count() == 2 and T.linked(s, t, refs.limit(0)).count() == 0 and T.in_range(s, 0, 10).count() == 2 and T.overlapping(s, 3, 6).count() == 2
    assert {r.signal_id for r in T.latest_position(t).collect()} == {1, 3, 4}
    row = spark.range(1).select(T.passes(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.9), (0.5, 0.9, 0.9)).alias("a"), T.combined(F.lit(0.5), F.lit(0.5), F.lit(0.5)).alias("b"), T.matches_viewport(F.lit("x"), "y").alias("c"), T.matches_viewport(F.lit(None).cast("string"), "y").alias("d")).first()
    assert (row.a, round(row.b, 9), row.c, row.d) == (True, 0.5, False, True)
    lines = spark.createDataFrame([("{broken",), ('{"text": "no id"}',)], "value string")
    assert T.from_grounded_json(lines).count() == 0


def test_exports(spark):
    n = spark.createDataFrame([("a:b", "O'Dell \\", "PER", 2), ("c", "C", None, 1)], "node string, name string, node_type string, mentions int")
    e = spark.createDataFrame([("a:b", "c", "knows of", 0.5), ("c", "a:b", "x", 1.0)], "source string, target string, relation string, confidence double")
    lines = {r.line for r in G.export(n, e, "cypher").collect()}
    assert "CREATE (n_a_b:PER {id: 'a:b', name: 'O\\'Dell \\\\'})" in lines and "CREATE (n_a_b)-[:KNOWS_OF {confidence: 0.500}]->(n_c)" in lines and "CREATE (n_c)-[:X]->(n_a_b)" in lines
    assert json.loads([r.line for r in G.export(n, e, "json_ld").collect() if '"@id":"a:b"' in r.line.split("relations")[0]][0])["relations"] == [{"@type": "knows of", "@id": "c"}]
    links = [json.loads(r.line) for r in G.export(n, e, "node_link").collect()]
    assert {"source": "c", "target": "a:b", "relation": "x"} in links
    with pytest.raises(ValueError):
        G.export(n, e, "dot")


def test_numbers_and_selection(spark):
    row = spark.range(1).select(X.sigmoid(F.lit(0.0)).alias("s"), X.clamped(F.lit(float("nan"))).alias("n"), X.between(F.lit(0.2), F.lit(0.6), F.lit(0.5)).alias("b"), X.grade(F.lit(0.31), "gap").alias("g"), X.grade(F.lit(-0.1), "kappa").alias("k"), X.grade(F.lit(0.85), "robustness").alias("r"),
        X.types_match(F.lit("person"), F.lit("PER")).alias("t"), X.types_match(F.lit("GPE"), F.lit("LOC")).alias("u"), X.triggers_match(F.lit("running"), F.lit("runs")).alias("v")).first()
    assert (row.s, row.n, round(row.b, 9), row.g, row.k, row.r, row.t, row.u, row.v) == (0.5, 0.0, 0.4, "Excellent discrimination", "Less than chance agreement", "Good robustness", True, False, True)
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [10.0, 0.0]), (3, [0.0, 9.0]), (4, [0.1, 0.0]), (5, None)], "key bigint, vector array<double>")
    assert A.farthest_points(v, 3) == [1, 2, 3] and A.farthest_points(v.limit(0), 3) == [] and len(A.farthest_points(v, 9)) == 4
    g = {r.kind: (r.n, r.accuracy, r.gap) for r in A.stereotype_gap(spark.createDataFrame([("pro", True), ("pro", True), ("anti", False), ("anti", True), ("neutral", True)], "kind string, correct boolean")).collect()}
    assert g == {"pro": (2, 1.0, 0.5), "anti": (2, 0.5, 0.5), "neutral": (1, 1.0, 0.5)}
    r = A.ranking(spark.createDataFrame([(1, 4), (2, 2), (0, 0)], "gold_rank int, n_candidates int")).first()
    assert (r.n, round(r.accuracy_at_1, 6), round(r.mrr, 6), round(r.containment, 6), r.mean_candidates) == (3, 0.333333, 0.5, 0.666667, 2.0)
    s = A.spread(spark.createDataFrame([(0.8,), (0.9,), (1.0,)], "f double"), "f").first()
    assert (s.n, round(s["mean"], 9), round(s.sd, 9)) == (3, 0.9, 0.1) and s.low < 0.9 < s.high
    with pytest.raises(ValueError):
        A.to_annotate(v, "luck", 3)


def test_lexicon_and_registry(spark):
    from spanloom.operators import lexicon as L

    text = "HARBOUR mill, and the Harbour Mill-Company; harbour"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    x = spark.createDataFrame([("Harbour Mill", "ORG"), ("harbour-mill company", "ORG"), ("harbour", "LOC"), ("Harbour", "X"), (None, "Y"), ("--", "Y")], "name string, label string")
    got = {(r.surface, r.label) for r in L.lexicon_entities(d, x).collect()}
    assert got == {("HARBOUR mill", "ORG"), ("Harbour Mill", "ORG"), ("Harbour Mill-Company", "ORG"), *((w, k) for w in ("HARBOUR", "Harbour", "harbour") for k in ("LOC", "X"))}
    for r in L.lexicon_entities(d, x).collect():
        assert text[r.start_char : r.end_char] == r.surface
    assert L.lexicon_entities(d, x.limit(0)).count() == 0
    r = L.Registry().entity("PER", "people", [1.0, 0.0]).entity("ORG", "", [0.0, 1.0]).relation("OF", "", [1.0, 0.0])
    with pytest.raises(ValueError):
        r.entity("PER")
    v = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.0, 2.0]), (3, [-1.0, -1.0]), (4, None)], "key int, vector array<double>")
    assert {(x.key, x.label) for x in L.nearest_labels(v, r.table(spark)).collect()} == {(1, "PER"), (2, "ORG")}


def test_harness_and_reports(spark):
    from spanloom.operators import harness as H

    x = D.synthetic(spark, 40)
    g = H.grid(x, ["default", "pattern_only"], ["letters", "business"])
    rows = {(r.stack, r.domain, r["mode"]): r for r in g.collect()}
    assert len(rows) == 16 and rows["pattern_only", "letters", "strict"].precision == 1.0
    s = H.by_stratum(x, "pattern_only")
    assert {r.f1 for r in s.collect() if r.label == "EMAIL"} == {1.0}
    assert json.loads(H.report(g, "a"))["columns"][0] == "stack" and "<table>" in H.report_html(g, "a & b") and "a &amp; b" in H.report_html(g, "a & b")
    with pytest.raises(ValueError):
        H.report(g, "a", 3)
    t = H.Timers()
    with t.stretch("x"), t.stretch("y"):
        pass
    with t.stretch("x"):
        pass
    assert [(r["name"], r["count"]) for r in t.rows()] == [("x", 2), ("y", 1)]


def test_tags_of_all_schemes(spark):
    from spanloom.operators import sequence as Q

    def spans(tags):
        df = spark.createDataFrame([(1, k, f"w{k}", x) for k, x in enumerate(tags.split())], "seq int, pos int, token string, tag string")
        return [(r.first_pos, r.last_pos, r.label) for r in Q.bio_to_spans(df).orderBy("first_pos").collect()]

    assert spans("B-A I-A B-A O I-B") == [(0, 1, "A"), (2, 2, "A"), (4, 4, "B")]
    assert spans("I-A E-A I-A E-A O") == [(0, 1, "A"), (2, 3, "A")]
    assert spans("S-A S-A B-A I-A E-A S-B") == [(0, 0, "A"), (1, 1, "A"), (2, 4, "A"), (5, 5, "B")]
    assert spans("U-A B-A L-A U-A") == [(0, 0, "A"), (1, 2, "A"), (3, 3, "A")] and spans("I-A I-B") == [(0, 0, "A"), (1, 1, "B")]


def test_boxes_and_late_interaction(spark):
    from spanloom.operators import resolve as RS
    from spanloom.operators import vectors as VV

    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    row = spark.range(1).select(
        VV.box_contains(arr(1, 1), arr(2, 2), arr(0, 0), arr(3, 3)).alias("c"), VV.box_contains(arr(0, 0), arr(3, 3), arr(1, 1), arr(2, 2)).alias("n"), VV.box_disjoint(arr(0), arr(1), arr(2), arr(3)).alias("d"),
        VV.box_centre(arr(0, 2), arr(2, 4)).alias("m"), VV.box_size(arr(0, 5), arr(2, 4)).alias("s"), VV.adaptive_box(arr(3, 4), 0.1)[0].alias("a"), VV.max_sim(F.array(arr(1, 0), arr(0, 1)), F.array(arr(2, 0), arr(1, 3))).alias("l"),
    ).first()
    assert (row.c, row.n, row.d, row.m, row.s, [round(x, 9) for x in row.a], row.l) == (True, False, True, [1.0, 3.0], [2.0, 0.0], [2.49, 3.49], 5.0)
    rows = [(1, "a b c", [1.0, 0.0], "PER"), (2, "x y z", [0.99, 0.1], "PER"), (3, "a b c", [0.0, 1.0], "PER"), (4, "a b c d", None, "PER"), (5, "a b c", [1.0, 0.0], "ORG"), (6, "x y z w", None, "PER")]
    df = spark.createDataFrame(rows, "id bigint, name string, vector array<double>, kind string")
    got = {(r.left, r.right) for r in RS.resolver_pairs(df, 0.7).collect()}
    assert got == {(1, 2), (1, 4), (2, 6)}
