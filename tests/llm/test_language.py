import numpy as np

from spanloom.llm import language as lg


def test_labels():
    assert [lg.label_code(x) for x in ("en", "EN", "en_US", "eng", "English", "ger", "pt-BR", "xx", "und", "", None, "fa")] == ["en", "en", "en", "en", "en", "de", "pt", None, None, None, None, None]


def test_sentences_cover_the_text():
    for text in ("One. Two! Three?", "Dr. No came. He left at 4.30 p.m. sharp.\n\nEnd", "你好。再见！", "", " \n ", "no end", "a.b.c.", "x" * 100_000):
        spans = lg.sentences(text)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert not spans or (text[: spans[0][0]].strip() == "" and text[spans[-1][1] :].strip() == "")
    assert len(lg.sentences("The St. Ann Hosp. shut at 4.30 p.m. sharp. It rained.")) == 2


def test_features_by_hand():
    h, owner = lg.features(["Ab", "", "ab"])
    assert sorted(h[owner == 0]) == sorted(h[owner == 2]) and (owner == 1).sum() <= 2
    assert len(h[owner == 0]) == 2 + 3 + 2  # letters; _a ab b_; _ab ab_


TEXTS = {
    "en": "The harbour opens early on {0} days. Nobody at the depot saw the {0} crates.",
    "de": "Der Hafen öffnet an {0} Tagen früh. Niemand im Lager hat die {0} Kisten gesehen.",
    "fr": "Le port ouvre tôt pendant {0} jours. Personne au dépôt n'a vu les {0} caisses.",
    "ru": "Порт открывается рано {0} дней. Никто на складе не видел {0} ящиков.",
    "zh": "港口在{0}天里很早开放。仓库里没有人看到{0}个箱子。",
    "ja": "港は{0}日間早く開きます。倉庫では誰も{0}個の箱を見ませんでした。",
}


def _docs(spark):
    rows, k = [], 0
    for n in range(30):
        for code, text in TEXTS.items():
            rows.append((k, text.format(n), code if n > 2 else {0: None, 1: "xx", 2: "it"}[n], 1))
            k += 1
    rows += [(9000, TEXTS["en"].format(5) + " " + TEXTS["de"].format(5), "en", 1), (9001, None, "en", 1), (9002, "", "en", 1), (9003, "12 34\t56", None, 1), (9004, TEXTS["en"].format(7) + ' He called it "Hafenplan".', "English", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, segments int"), rows


def test_found_and_segments(spark):
    docs, rows = _docs(spark)
    model = lg.fit(docs)
    got = {(r.doc_id, r.lang_code) for r in lg.mislabelled(docs, model).collect()}
    codes = list(TEXTS)
    want = {(i, codes[i % 6]) for i in range(18)} | {(9000, "en"), (9000, "de")}
    assert got == want
    seg = lg.language_segments(docs, model).toPandas()
    mixed = seg[seg.doc_id == 9000].sort_values("segment_no")
    assert list(mixed.lang_code) == ["en", "de"] and mixed.confidence.between(0, 1).all()
    assert mixed.start_char.iloc[0] == 0 and mixed.end_char.iloc[0] == mixed.start_char.iloc[1]
    d = {r.doc_id: r for r in lg.document_languages(docs, model).collect()}
    assert d[9001].lang_code is None and d[9002].lang_code is None and d[9000].languages == ["de", "en"]
    # held-out accuracy
    p = model.probabilities([TEXTS[c].format(99) for c in codes])
    assert [lg.CODES[k] for k in p.argmax(axis=1)] == codes and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_empty(spark):
    docs, _ = _docs(spark)
    none = docs.limit(0)
    model = lg.fit(none)
    assert lg.mislabelled(none, model).count() == 0
    assert lg.document_languages(none, model).count() == 0


def test_scripts_of_no_known_language_give_none():
    korean, thai = "\uc774 \uc9d1\uc740 \ud06c\uace0 \ud30c\ub780 \ubb38\uc774 \uc788\uc2b5\ub2c8\ub2e4. \uc6b0\ub9ac\ub294 \uc544\uce68\uc5d0 \uc2dc\uc7a5\uc5d0 \uac14\uc2b5\ub2c8\ub2e4.", "\u0e1a\u0e49\u0e32\u0e19 \u0e2b\u0e25\u0e31\u0e07 \u0e19\u0e35\u0e49 \u0e43\u0e2b\u0e0d\u0e48 \u0e21\u0e32\u0e01."
    for text in (korean, thai):
        assert lg.is_foreign(text) and not lg.is_whole(text)
    assert lg.is_whole("The house is large and has a blue door.") and not lg.is_foreign("The house of \uae40 is large.")
