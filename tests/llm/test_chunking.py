import random

from spanloom.llm import chunking as ch

WORDS = ["harbour", "überall", "das", "漢字。", "report.", "a", "né", "🚢", "long" * 9]


def _text(seed, n=900):
    random.seed(seed)
    return "".join(random.choice(WORDS) + random.choice([" ", " ", "\n", "\n\n", "! "]) for _ in range(n))


def _check(text, limit, overlap):
    c = ch.Cutter(text)
    pieces = c.pieces(limit, overlap)
    raw = text.encode()
    assert pieces[0][0] == 0 and pieces[-1][1] == len(raw)
    for k, (s, e) in enumerate(pieces):
        assert 0 < e - s <= limit
        assert raw[s:e].decode() == text[c.chars(s) : c.chars(e)]
        if k:
            assert overlap <= pieces[k - 1][1] - s <= overlap + 3
            assert e > pieces[k - 1][1]
    return pieces


def test_pieces():
    for seed in range(5):
        for limit, overlap in ((512, 64), (100, 0), (1024, 128), (64, 20)):
            _check(_text(seed), limit, overlap)
    _check("x" * 5000, 512, 64)
    _check("漢" * 5000, 512, 64)


def test_edits_alter_neighbours_only():
    text = _text(7, 4000)
    raw = text.encode()
    a = {raw[:e][-64:] for _, e in ch.Cutter(text).pieces(1024, 0)}
    changed = text[:9000] + "one more sentence. " + text[9000:]
    b = {changed.encode()[:e][-64:] for _, e in ch.Cutter(changed).pieces(1024, 0)}
    assert len(a & b) >= 0.7 * len(a)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 300, 5), (2, None, 5), (3, "", 5), (4, "short", 5), (5, "é" * 256, 5), (6, "é" * 257, 5)], "doc_id bigint, text string, piece_no int")
    configs = spark.createDataFrame([(1, 512, 64, "a"), (2, 2048, None, "b"), (3, None, 1, "c")], "config_id int, max_position_embeddings int, overlap_tokens int, doc_id string")
    assert sorted(map(tuple, ch.oversized(docs, configs).collect())) == [(1, 1), (1, 6)]
    p = ch.split_documents(docs, configs)
    assert p.where("doc_id = 2").count() == 0
    assert p.where("doc_id = 3 AND n_tokens = 0 AND n_pieces = 1").count() == 2
    assert p.where("doc_id = 5").count() == 2
    assert all(len(r.piece_text.encode()) == r.n_tokens for r in p.collect())
    assert ch.split_documents(docs.limit(0), configs).count() == 0
    assert ch.split_documents(docs, configs.limit(0)).count() == 0


def test_overlap_without_room_is_taken_as_the_largest_that_has():
    text = "one two three four five six seven eight nine ten " * 4
    for limit, overlap in ((32, 30), (32, 500), (9, 9), (6, 6)):
        pieces = ch.Cutter(text).pieces(limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < e - s <= limit for s, e in pieces)
        assert all(a[1] >= b[0] and a[1] < b[1] for a, b in zip(pieces, pieces[1:]))
