import pytest

from spanloom.llm import pii

PARTS = pii.NameParts(
    ["Eleanor Yulmilbero", "Johannes Faxalbero", "Amélie Klianiashano", "Thomas Checkoth", "Iker Wovaurrund-Tituphane", "Ruth Skupheizham", "Theodore Tetimar", "Uma Theiphouder"],
    ["Tilmano Harbour Authority", "Klinndorf Harbour Laboratory", "Blitadar Harbour Archive", "Shestel Water Corporation", "Kluvano Water Company", "Ziarobow Water Group"],
    ["Liphhaven", "Fockanhaven", "Luxhaven"],
)

CASES = [
    ("Write to a.b+c@post.example or call (01632) 960929.", [("email", "a.b+c@post.example"), ("phone", "(01632) 960929")]),
    ("ylva21 at post dot example, office [at] desk.inbox.test, x(at)y.org!", [("email", "ylva21 at post dot example"), ("email", "office [at] desk.inbox.test"), ("email", "x(at)y.org")]),
    ("Contact: Ｔｈｏｍａｓ Checkoth, lucia92＠relay.invalid, +33(0)1.99.00.93.36.", [("name", "Ｔｈｏｍａｓ Checkoth"), ("email", "lucia92＠relay.invalid"), ("phone", "+33(0)1.99.00.93.36")]),
    ("0044 1632 960169; +1 702 555 0105; 030/23125-855; 1-312-555-0169; 7025550163", [("phone", x) for x in ("0044 1632 960169", "+1 702 555 0105", "030/23125-855", "1-312-555-0169", "7025550163")]),
    ("IDs BW6684563, 2 61 99 99 972 392 03, 923-24-6831, QQ 31 47 50 C, 46162185-S, 758.420.351-69, 14 614 403 026.", [("identity", x) for x in ("BW6684563", "2 61 99 99 972 392 03", "923-24-6831", "QQ 31 47 50 C", "46162185-S", "758.420.351-69", "14 614 403 026")]),
    ("Order 426-77-3348. ISBN 978-0-60-6266-2. Version 2.51.43. Total: 76 3100 5400 crowns. Case CX-8289. @annodesk", []),
    ("He lives at Flat 7, 112 Saddler's Row in Liphhaven; or 24 Marsh End, Apt 19, Luxhaven. 12 crates per street.", [("address", "Flat 7, 112 Saddler's Row"), ("address", "24 Marsh End, Apt 19")]),
    ("Am Mühlbach 17, Luxhaven. 169, impasse du Moulin, à X. Calle del Olmo, n. 152; Piazza delle Corde 26; Touwslagersgracht 68a", [("address", x) for x in ("Am Mühlbach 17", "169, impasse du Moulin", "Calle del Olmo, n. 152", "Piazza delle Corde 26", "Touwslagersgracht 68a")]),
    ("Dr. Eleanor J. Yulmilbero met Yulmilbero, E. and Elaenor Yulmilbero of Tilmano Harbour Authority.", [("name", "Eleanor J. Yulmilbero"), ("name", "Yulmilbero, E."), ("name", "Elaenor Yulmilbero")]),
    ("Dear Ellie,\n\nShestel Water Corporation will pay.", [("name", "Ellie")]),
    ("«Тарновод» и Глеб Ворежин спорят. Как сказано", [("name", "Глеб Ворежин")]),
    ("根据记录，林远舟和李若川对短语的边界有不同看法。", [("name", "林远舟"), ("name", "李若川")]),
    ("Thom​as Check­oth left.", [("name", "Thom​as Check­oth")]),
    ("", []),
    ("nothing here", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    got = [(k, text[a:b]) for k, a, b in pii.occurrences(text, PARTS)]
    assert got == want


def test_masked():
    text = "Mail a@b.org, Ruth Skupheizham."
    assert pii.masked(text, pii.occurrences(text, PARTS)) == "Mail [EMAIL], [NAME]."
    assert pii.masked(None, []) is None and pii.occurrences(None, PARTS) == []


def test_long_text():
    text = "Ab" * 60_000 + " " + "x1" * 30_000 + " Ruth Skupheizham " + "漢" * 30_000
    assert ("name", 180_002, 180_018) in [(k, a, b) for k, a, b in pii.occurrences(text, PARTS)]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "Call 312-555-0174, Ruth Skupheizham.", 1), (2, None, 1), (3, "", 1), (4, "none", 1)], "doc_id bigint, text string, found int")
    kb = spark.createDataFrame([(1, "Ruth Skupheizham", "PER", "x"), (2, None, "PER", "x"), (3, "Liphhaven", "LOC", "x")], "kb_id bigint, kb_name string, entity_type string, text string")
    assert sorted(map(tuple, pii.personal_information(docs, kb).collect())) == [(1, "name", 19, 35), (1, "phone", 5, 17)]
    m = {r.doc_id: (r.masked_text, r.n_replaced) for r in pii.masked_documents(docs, kb).collect()}
    assert m[1] == ("Call [PHONE], [NAME].", 2) and m[2][0] is None and m[3] == ("", 0) and m[4] == ("none", 0)
    assert pii.personal_information(docs, kb.limit(0)).where("kind = 'phone'").count() == 1
    assert pii.personal_information(docs.limit(0), kb).count() == 0


def test_spelled_numbers_of_any_digit_words():
    for text in ("oh one two three four five six one two", "one two three four five six one", "double two, three four five six one two three"):
        assert [(k, a, b) for k, a, b in pii.occurrences(f"Ring {text} now.", PARTS)] == [("phone", 5, 5 + len(text))]


DISGUISED = [
    ("Mail anna dot smith at example dot com now.", [("email", "anna dot smith at example dot com")]),
    ("Mail a n n a @ example.com now.", [("email", "a n n a @ example.com")]),
    ("Mail a n n a @ e x a m p l e . c o m today.", [("email", "a n n a @ e x a m p l e . c o m")]),
    ("office (at) relay [dot] invalid, x @ y.org; meet us at noon", [("email", "office (at) relay [dot] invalid"), ("email", "x @ y.org")]),
    ("Escriba a marta arroba correo punto example ya.", [("email", "marta arroba correo punto example")]),
    ("Call 555 one two three 4567 now", [("phone", "555 one two three 4567")]),
    ("Call nine two one 555 0188.", [("phone", "nine two one 555 0188")]),
    ("Rufen Sie null eins sechs drei zwei neun sechs null an.", [("phone", "null eins sechs drei zwei neun sechs null")]),
    ("Her SSN is nine two three dash two four dash six eight three one.", [("identity", "nine two three dash two four dash six eight three one")]),
    ("Ring plus four four one six three two nine six zero one six nine!", [("phone", "plus four four one six three two nine six zero one six nine")]),
    ("Ring 5 5 5 1 2 3 4 5 6 7 today", [("phone", "5 5 5 1 2 3 4 5 6 7")]),
    ("電話は〇三一二三四五六七八です", [("phone", "〇三一二三四五六七八")]),
    ("Телефон: восемь девять ноль один два три четыре пять шесть семь.", [("phone", "восемь девять ноль один два три четыре пять шесть семь")]),
    ("one two three, four five", []),
    ("There was one man, two women and three dogs at the point of no return.", []),
    ("Look at the dot matrix. Meet me at the point of it, at noon punto.", []),
    ("Ｃａｌｌ ５５５ one two three 4567 now", [("phone", "５５５ one two three 4567")]),
]


@pytest.mark.parametrize(("text", "want"), DISGUISED)
def test_disguises_are_read_and_mapped_back(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.occurrences(text, PARTS)] == want


def test_names_that_no_catalogue_holds():
    few = pii.NameParts(["Ada Byron", "Tom Reed"])
    found = lambda t: [t[a:b] for k, a, b in pii.occurrences(t, few) if k == "name"]
    assert found("Yesterday Priya Raghunathan wrote to us.") == ["Priya Raghunathan"]
    assert found("Maria Gonzalez met Tom near the river.") == ["Maria Gonzalez", "Tom"]
    assert found("We asked Dr. Yusuf Okonkwo about it.") == ["Yusuf Okonkwo"]
    assert found("The Harbour Authority said no. Water Company met Board Members.") == []


def test_map_of_edits_against_brute_force():
    import random

    from spanloom.llm.deobfuscate import Offsets, apply_edits, moved

    random.seed(4)
    for _ in range(200):
        text = "".join(random.choice("abc ") for _ in range(30))
        edits, at = [], 0
        while at < 27:
            s = at + random.randint(0, 4)
            e = s + random.randint(0, 3)
            if e > 30:
                break
            edits.append((s, e, "xyz"[: random.randint(0, 3)]))
            at = e + 1
        back, new = Offsets(edits), apply_edits(text, edits)
        kept = [k for k in range(30) if not any(s <= k < e for s, e, _ in edits)]
        for k in kept:  # characters that no edit touches lie where they lay
            p = k + sum(len(r) - (e - s) for s, e, r in edits if e <= k)
            assert new[p] == text[k] and back.span(p, p + 1) == (k, k + 1)
            assert moved(edits, [(k, k)])[0][0] in (p, p - sum(len(r) for s, e, r in edits if s == e == k))


def test_time_is_linear():
    import time

    took = []
    line = "Ruth Skupheizham wrote 312-555-0174, a (at) b.org, one two three four five six one; 24 Marsh End. "
    for n in (300, 1200):
        began = time.time()
        assert len(pii.occurrences(line * n, PARTS)) >= 4 * n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0]
