import json

from spanloom.operators import extractors as X
from spanloom.sources import readers as R
from spanloom.sources import writers as W


def test_text_and_json(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("Ünder the bridge\n")
    (tmp_path / "in/sub/b.md").write_text("b")
    (tmp_path / "in/c.csv").write_text("no")
    assert sorted(r.text for r in R.text_files(spark, str(tmp_path / "in")).collect()) == ["b", "Ünder the bridge\n"]
    (tmp_path / "d.jsonl").write_text('{"id":"x","text":"one"}\n{"text":"two"}\n')
    assert {r.text for r in R.jsonl_documents(spark, str(tmp_path / "d.jsonl")).collect()} == {"one", "two"}
    (tmp_path / "e.jsonl").write_text(json.dumps({"text": "Ünal met Ann", "entities": [{"text": "Ann", "label": "PER", "start": 9, "end": 12}, {"text": "Ann", "label": "PER", "start": 0, "end": 3}]}) + "\n")
    assert sorted((r.start, r.valid) for r in R.entity_json(spark, str(tmp_path / "e.jsonl")).collect()) == [(0, False), (9, True)]


def test_tagged(spark, tmp_path):
    (tmp_path / "x.conll").write_text("-DOCSTART- -X- O O\n\nAnn NNP I-NP B-PER\nran VBD I-VP O\n\nBob B-PER\nalone\n")
    got = [(r.sentence, r.pos, r.token, r.tag) for r in R.conll_file(spark, str(tmp_path / "x.conll")).orderBy("sentence", "pos").collect()]
    assert got == [(1, 0, "Ann", "B-PER"), (1, 1, "ran", "O"), (2, 0, "Bob", "B-PER"), (2, 1, "alone", "O")]
    (tmp_path / "t.jsonl").write_text('{"tokens":["a","b"],"ner_tags":[0,9]}\nbroken\n')
    assert [(r.token, r.tag) for r in R.tag_jsonl(spark, str(tmp_path / "t.jsonl"), ["B-X", "O"]).orderBy("pos").collect()] == [("a", "B-X"), ("b", "O")]
    lines = spark.createDataFrame([("T1\tPER 0 3\tAnn",), ("#x",), ("B-X\tword",)], "value string")
    assert [tuple(r) for r in R.standoff(lines).collect()] == [("T1", "PER", 0, 3, "Ann")]
    assert [tuple(r) for r in R.tag_word_lines(lines.where("value LIKE 'B-%'")).collect()] == [("word", "B-X")]
    s = spark.createDataFrame([("a:b:PER:1:4",), ("bad",)], "v string").select(R.gold_spec(__import__("pyspark.sql.functions", fromlist=["col"]).col("v")).alias("g")).collect()
    assert (s[0].g.text, s[0].g.label, s[0].g.start, s[0].g.end) == ("a:b", "PER", 1, 4) and s[1].g is None


def test_gap_and_relations(spark, tmp_path):
    head = "ID\tText\tPronoun\tPronoun-offset\tA\tA-offset\tA-coref\tB\tB-offset\tB-coref\n"
    (tmp_path / "g.tsv").write_text(head + "1\tAnn met Eve. She\tShe\t13\tAnn\t0\tTRUE\tEve\t8\tFALSE\nshort\trow\n")
    (r,) = R.gap_rows(spark, str(tmp_path / "g.tsv")).collect()
    assert (r.pronoun_offset, r.a_coref, r.b_coref) == (13, True, False)
    (tmp_path / "r.jsonl").write_text(json.dumps({"title": "d", "sents": [["a"]], "vertexSet": [[{"name": "Ann"}], [{"name": "Acme"}]], "labels": [{"h": 0, "t": 1, "r": "works_for", "evidence": [0]}]}) + "\n")
    assert [(x.head, x.tail, x.relation) for x in R.relation_json(spark, str(tmp_path / "r.jsonl")).collect()] == [("Ann", "Acme", "works_for")]


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, "Ann <b> met Eve"), (2, "none")], "doc_id bigint, text string")
    s = spark.createDataFrame([(1, 0, 3, "PER"), (1, 12, 15, "PER"), (1, 1, 2, "X")], "doc_id bigint, start_char int, end_char int, label string")
    h = {r.doc_id: r.html for r in W.highlighted(d, s).collect()}
    assert h == {1: '<mark title="PER">Ann</mark> &lt;b&gt; met <mark title="PER">Eve</mark>', 2: "none"}
    W.write(d, str(tmp_path / "o"), "jsonl")
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    assert W.markdown_table(d.where("doc_id = 2")) == "| doc_id | text |\n| --- | --- |\n| 2 | none |"


def test_extractors():
    e = {(x[2], x[3], x[4]) for x in X.heuristic_spans("Dr. Smith joined Acme Corp. in Paris with John Doe and the Bank of England. The end.")}
    assert {("Dr. Smith", "PER", "with a title"), ("Acme Corp", "ORG", "company ending"), ("Paris", "LOC", "listed place"), ("John Doe", "PER", "listed given name")} <= e
    text = "Ünal saw 任天堂 and Ann Lee."
    assert all(text[a:b] == s for a, b, s, *_ in X.heuristic_spans(text)) and ("任天堂", "ORG") in {(x[2], x[3]) for x in X.heuristic_spans(text)}
    r = X.rule_spans("The Acme Corporation hired Dr. Jane Roe in New York.")
    assert [(x[2], x[3]) for x in r] == [("Acme Corporation", "ORG"), ("Dr. Jane Roe", "PER"), ("New York", "LOC")]
    a, b, c = (0, 5, "a", "X", "r", 0.5), (3, 12, "b", "Y", "r", 0.9), (11, 14, "c", "Z", "r", 0.7)
    assert X.resolve_layers([[a], [b], [c]], "priority") == [a, c]
    assert X.resolve_layers([[a, c], [b]], "longest") == [b]
    assert X.resolve_layers([[a, c], [(3, 12, "b", "Y", "r", 0.6)]], "confidence") == [c]
    assert X.resolve_layers([[a], [b]], "union") == [a, b]
    from spanloom.operators import coreference, events

    v = events.event_spans("Acme did not sign the deal. Bob will meet Ann.", events.lemmas_of(events.TRIGGERS))
    assert [(x[2], x[4], x[5]) for x in v] == [("sign", "negative", "present"), ("meet", "positive", "future")]
    assert coreference.resolve_document([(1, "Ann Lee", "PER"), (2, "Lee", "PER"), (3, "Bob", "PER"), (4, "ann lee", "PER"), (5, "Lee", "ORG")]) == [(1, 1), (2, 1), (3, 3), (4, 1), (5, 5)]
    assert X.heuristic_spans("") == [] and X.rule_spans("") == [] and events.event_spans("", {}) == []
