import random

from spanloom.llm import metric_join as mj
from spanloom.llm import name_linking as nl

KB = [
    (1, "Eleanor Yulmilbero", "PER", 0), (2, "Johannes Faxalbero", "PER", 0), (3, "Leopold Faxalbero", "PER", 0), (4, "Amélie Klianiashano", "PER", 0), (5, "Iker Wovaurrund-Tituphane", "PER", 0),
    (6, "Tilmano Harbour Authority", "ORG", 0), (7, "University of Labockov", "ORG", 0), (8, "Klinndorf National Rail Laboratory", "ORG", 0), (9, "Frilontquist Turbine & Textile Company", "ORG", 0), (10, "Saint Yulmane Hospital", "ORG", 0),
    (11, "Liphhaven", "LOC", 0), (12, None, "PER", 0), (13, "Solo", "ORG", 0),
] + [(100 + k, f"Core{c}xyz {a} {b}", "ORG", 0) for k, (c, a, b) in enumerate([("aa", "Harbour", "Authority"), ("bbb", "Rail", "Laboratory"), ("cccc", "Turbine", "Company"), ("ddddd", "National", "Laboratory"), ("eeeeee", "Textile", "Company"), ("fffffff", "Harbour", "Company"), ("gggggggg", "Rail", "Authority"), ("hhhhhhhhh", "National", "Textile"), ("iiiiiiiiii", "Turbine", "Authority"), ("jjjjjjjjjjj", "Hospital", "Saint"), ("kkkkkkkkkkkk", "Hospital", "University"), ("lllllllllllll", "University", "Hospital")])]

NAMES = {
    "Ellie Yulmilbero": 1, "Dr. Eleanor Yulmilbero": 1, "Yulmilbero, E.": 1, "Yulmilbero Eleanor": 1, "EleanorYulmilbero": 1, "Elaenor Yulmilbero": 1, "eleanor yulmilbreo": 1, "E. J. Yulmilbero": 1,
    "Faxalbero, L.": 3, "J Faxalbero": 2, "Faxalbero": None, "Nadia Faxalbero": None, "Amelie Klianiashano": 4, "Iker Wovaurrund Tituphane": 5,
    "Tilmano Harbour Auth.": 6, "THA": 6, "T.H.A.": 6, "Harbour Authority, Tilmano": 6, "Tilmano Harbour": 6, "Timano Harbour Authority": 6, "TILMANO HARBOUR AUTHORITY": 6, "Tilmano Rail Company": None,
    "Labockov University": 7, "Univ. of Labockov": 7, "Klinndorf Natl Rail Lab.": 8, "Frilontkwist Turbine and Textile Co.": 9, "St. Yulmane Hosp.": 10, "The Saint Yulmane Hospital": 10,
    "Liphhaven": None, "Somebody Else": None, "": None, "x" * 5000: None, "Tilmano Harbour Authority": 6, "Тilmano Harbour Authority": 6,
}


def test_links(spark):
    kb = spark.createDataFrame(KB, "kb_id bigint, kb_name string, entity_type string, name int")
    ex = spark.createDataFrame([(i, n, 0) for i, n in enumerate(NAMES)] + [(900, None, 0), (901, "THA", 0)], "example_id bigint, entity_text string, record_id int")
    pr = spark.createDataFrame([(i, n, 0) for i, n in enumerate(NAMES)], "pred_id bigint, text string, kb_id int")
    got = {r.name: r.kb_id for r in nl.linked_records(ex, pr, kb).where("record_kind = 'example'").collect()}
    assert got == {n: k for n, k in NAMES.items() if k}
    found = {(r.record_kind, r.record_id, r.kb_id) for r in nl.misspelt_records(ex, pr, kb).collect()}
    exact = {"Tilmano Harbour Authority", "Тilmano Harbour Authority"}
    want = {(kind, i, k) for kind in ("example", "entity") for i, (n, k) in enumerate(NAMES.items()) if k and n not in exact} | {("example", 901, 6)}
    assert found == want
    assert nl.misspelt_records(ex.limit(0), pr.limit(0), kb).count() == 0
    assert nl.misspelt_records(ex, pr, kb.limit(0)).count() == 0


def test_radius_join_is_exact(spark):
    random.seed(2)
    word = lambda: "".join(random.choice("abc") for _ in range(random.randint(0, 9)))
    left, right = [word() for _ in range(150)] + [None], [word() for _ in range(120)] + [None, "abc", "abc"]
    a = spark.createDataFrame([(x,) for x in left], "core string")
    b = spark.createDataFrame([(x,) for x in right], "target string")
    for radius in (0, 1, 2):
        got = {(r.core, r.target, r.distance) for r in mj.radius_join(a, b, "core", "target", radius).collect()}
        want = {(x, y, mj.levenshtein(x, y)) for x in left if x is not None for y in right if y is not None and mj.levenshtein(x, y) <= radius}
        assert got == want
    assert mj.radius_join(a, b.limit(0), "core", "target", 1).count() == 0


def test_distances_from_one_to_many():
    import numpy as np

    random.seed(6)
    words = ["".join(random.choice("abcd") for _ in range(random.randint(0, 8))) for _ in range(60)]
    n = np.array([len(w) for w in words])
    codes = np.zeros((60, max(n)), int)
    for k, w in enumerate(words):
        codes[k, : len(w)] = [ord(c) for c in w]
    for w in words[:15]:
        assert list(mj.to_many(w, codes, n)) == [mj.levenshtein(w, x) for x in words]


def test_pivots_are_far_apart_and_follow_the_data(spark):
    random.seed(7)
    few = spark.createDataFrame([("".join(random.choice("abcdefgh") for _ in range(7)),) for _ in range(40)], "w string")
    many = spark.createDataFrame([("".join(random.choice("abcdefgh") for _ in range(7)),) for _ in range(900)], "w string")
    a, b = mj.choose_pivots(few, "w"), mj.choose_pivots(many, "w")
    assert len(a) == 38 and len(b) == 180 and len(set(b)) == 180
    assert min(mj.levenshtein(x, y) for x in a[:16] for y in a[:16] if x != y) >= 4


def test_organisations_that_share_their_own_word_are_all_met(spark):
    kb = spark.createDataFrame([(1, "Zorbel Harbour Company", "ORG"), (2, "Zorbel Rail Authority", "ORG"), (3, "Ann Zorbel", "PER")], "kb_id bigint, kb_name string, entity_type string")
    names = spark.createDataFrame([("Zorbel Rail Auth.",), ("Zorbel Harbour Co.",), ("A. Zorbel",), ("Zorbell Rail Authority",), ("Zorbel Mining Company",)], "name string")
    assert {r.name: r.kb_id for r in nl.linked_names(names, kb).collect()} == {"Zorbel Rail Auth.": 2, "Zorbel Harbour Co.": 1, "A. Zorbel": 3, "Zorbell Rail Authority": 2}
