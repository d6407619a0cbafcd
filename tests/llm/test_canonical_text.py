import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import canonical_text as c

PAIRS = [
    ("Tilmano Ηarbοur Αuthοrity", "Tilmano Harbour Authority"),
    ("Тrummuѕhіdеѕ Wа​tеr", "Trummushides Water"),
    ("Ｍｉｌｍｅｎ， O.", "Milmen, O."),
    ("Durdûs", "Durdûs"),
    ("Kirk", "Kirk"),
    ("Jouskﬁeld", "Jouskfield"),
    ("a b c", "a b c"),
    ("Kla­⁠m﻿", "Klam"),
    ("2001‐1‑2", "2001-1-2"),
    ("金が", "金が"),
    ("سلیم ال", "سليم ال"),
    ("Игнат Тарнyхов", "Игнат Тарнухов"),
]
KEPT = ["TLXβ53", "59 m²", "№ 3", "71½ kg", "\U0001f469‍\U0001f52c", "بهنود پیش‌آهنگر", "您好！电话：01", "Хопёрмаш", "", "plain"]


@pytest.mark.parametrize(("odd", "plain"), PAIRS)
def test_replaced(odd, plain):
    assert c.canonicalize(odd) == plain


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert c.canonicalize(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab аеό​ Ａﬁ゙か.می", max_size=40))
def test_idempotent_and_edits_apart(text):
    edits = c.canonical_edits(text)
    assert all(a[1] <= b[0] for a, b in zip(edits, edits[1:]))
    once = c.apply_edits(text, edits)
    assert c.canonicalize(c.canonicalize(once)) == c.canonicalize(once)
    for at in range(len(text) + 1):
        assert 0 <= c.to_canonical_offset(edits, at) <= len(once)


def test_long_text_is_linear():
    text = "Ж " + "x" * 200_000 + " ​" + "аb" * 50_000
    assert c.canonicalize(text).endswith("ab")


def test_rows(spark):
    docs = spark.createDataFrame([(1, "In Kla­m lives Kirk.", "x"), (2, None, "y"), (3, "", "z"), (4, "plain text", "z")], "doc_id bigint, text string, canonical_text string")
    rows = [(1, 1, "Klam", 3, 8), (2, 1, "Kirk", 15, 19), (3, 1, "Kirk", None, None), (4, 2, "a", 0, 1), (5, 4, "plain", 0, 5), (6, None, None, None, None), (7, 9, "no", 0, 2), (8, 4, "bad", 5, 2), (1, 1, "Klam", 3, 8)]
    p = spark.createDataFrame([(*r, 0) for r in rows], "pred_id bigint, doc_id bigint, text string, start_char int, end_char int, edits int")
    assert sorted(r.pred_id for r in c.entities_to_mend(p, docs).collect()) == [1, 2, 3]
    e = {r.pred_id: r for r in c.canonical_entities(p, docs).collect()}
    d = {r.doc_id: r.canonical_text for r in c.canonical_documents(docs).collect()}
    assert d == {1: "In Klam lives Kirk.", 2: None, 3: "", 4: "plain text"}
    for k in (1, 2):
        assert d[1][e[k].canonical_start : e[k].canonical_end] == e[k].canonical_text
    assert c.entities_to_mend(p.limit(0), docs).count() == 0
    assert c.entities_to_mend(p, docs.limit(0)).count() == 1


def test_moved_offsets_agree(spark):
    random.seed(4)
    texts = ["".join(random.choice("ab​­ﬁＡ ́") for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    p = spark.createDataFrame([(100 * i + k, i, "x", k, min(60, k + 5)) for i in range(20) for k in range(0, 60, 7)], "pred_id bigint, doc_id bigint, text string, start_char int, end_char int")
    for r in c.canonical_entities(p, docs).collect():
        edits, k = c.canonical_edits(texts[r.doc_id]), r.pred_id % 100
        assert (r.canonical_start, r.canonical_end) == (c.to_canonical_offset(edits, k), c.to_canonical_offset(edits, min(60, k + 5), True))


def test_look_alikes_outside_the_common_ranges(spark):
    """Every letter that the tables fold to Latin, in a Latin word without any other foreign letter."""
    words = [f"Wr{k}kshire" for k in c.FOLD_TO["L"]]
    assert [c.canonicalize(w) for w in words] == [f"Wr{v}kshire" for v in c.FOLD_TO["L"].values()]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string")
    assert docs.where(c.quick_check(docs["text"])).count() == len(words)
    for kept in ("\u0585\u0580", "Bar-\u0585\u0580", "\u0261\u026av", "\u051d\u0430\u043d"):
        assert c.canonicalize(kept) == kept


def test_every_code_point_comes_out_composed():
    """Whatever a text holds, its canonical form is NFC, and a letter meets its decomposed form; the JVM's wider classes let
    nothing pass that the quick check of the Unicode database stops."""
    import unicodedata as u

    points = [p for p in range(0xA0, 0x2FA20) if not 0xD800 <= p < 0xE000]
    whole = c.canonicalize(" ".join(f"a{chr(p)}b" for p in points))
    assert u.is_normalized("NFC", whole)
    for p in points:
        d = u.normalize("NFD", chr(p))
        assert d == chr(p) or c.canonicalize(chr(p)) == c.canonicalize(d)
    wide = [range(a, b + 1) for a, b in c._ranges(c.SUSPECT)]
    assert all(any(a in r for r in wide) and any(b in r for r in wide) for a, b in c._ranges(c.UNSTABLE))
    for a, b in (("\u05e9\u05b0\u05bc", "\u05e9\u05bc\u05b0"), ("\u0628\u0651\u064e", "\u0628\u064e\u0651")):
        assert c.canonicalize(a) == c.canonicalize(b)


def test_edits_are_found_in_linear_time():
    import time

    took = []
    for n in (3000, 12000):
        text = "e\u0301 \u041coscow \u00a0" * n
        began = time.time()
        c.canonical_edits(text)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0]


def test_the_words_that_settle_a_script_may_be_far_away():
    far = " 123456789" * 12
    assert c.canonicalize(f"Wren walks{far} \u0421\u041e{far} home again") == f"Wren walks{far} CO{far} home again"


def test_moved_offsets_inside_the_jvm(spark):
    import random

    from pyspark.sql import functions as F

    random.seed(2)
    texts = ["".join(random.choice(["a", "e\u0301", "\u200b", "\uff21", "\u00a0", "b "]) for _ in range(random.randint(1, 60))) for _ in range(30)] + ["plain"]
    rows = [(i, t, o) for i, t in enumerate(texts) for o in range(len(t) + 1)]
    df = spark.createDataFrame(rows, "i int, t string, o int").withColumn("x", c.edits_udf("t"))
    for r in df.select("t", "o", c._moved(F.col("o"), F.col("x"), False).alias("a"), c._moved(F.col("o"), F.col("x"), True).alias("b")).collect():
        edits = c.canonical_edits(r.t)
        assert (r.a, r.b) == (c.to_canonical_offset(edits, r.o), c.to_canonical_offset(edits, r.o, True))
