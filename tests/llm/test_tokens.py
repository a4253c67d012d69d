import random

import pytest

from touchline.llm.tokens import FOLDER, LONG, VOCABULARY, Piecewise, cut_text, encode_corpus, encoder

PATH = f"{FOLDER}/{VOCABULARY}"
ALPHABETS = ["ab", "abc de", "the in er on's ", "日本語テキスト", "a .,!", "ßüé ab  ", "<|endoftext|> ab", "   \n\tx", "0123 a", "don't we'll they've ", "😂👍🏽é"]


def test_tree_concatenation_is_exact():
    by, enc, rnd = Piecewise(PATH, leaf=8), encoder(PATH), random.Random(11)
    for _ in range(2500):
        text = "".join(rnd.choice(rnd.choice(ALPHABETS)) if rnd.random() < 0.1 else rnd.choice(a) for a in [rnd.choice(ALPHABETS)] for _ in range(rnd.randint(1, 250)))
        parts = cut_text(text, rnd.randint(4, 40))
        assert "".join(p for p, _ in parts) == text
        ids = [x for piece in by.tree([by.node(t) for t, _ in parts], [g for _, g in parts])[2] for x in piece]
        assert ids == enc.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" * 5000, "xyz" * 3000, "日本" * 1500, "!?" * 2000, "0" * 4000])
def test_long_pieces(text):
    assert Piecewise(PATH, leaf=64).piece(text.encode()) == encoder(PATH)._encode_single_piece(text.encode())


def test_corpus(spark):
    texts = [None, "", " ", "x", "<|endoftext|>", "a" * 20_000, "x" * 9000 + " " + "yz" * 9000, "lorem ipsum " * 2000, "日本" * 9000, "it's " * 4000, "x" * LONG]
    rows = [(i, t, "src", 1) for i, t in enumerate(texts)] + [(5, texts[5], "src", 1), (5, "other " * 3000, "src", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(df, carry=["key"]).collect() if r.key == "src")
    enc = encoder(PATH)
    assert got == sorted((r[0], enc.encode_ordinary(r[1] or "")) for r in rows)
    assert encode_corpus(df.limit(0)).count() == 0


def test_round_trip(spark, data):
    from touchline.sources.tables import table

    docs = table(spark, data, "documents")
    ids = {r.doc_id: list(r.ids) for r in encode_corpus(docs).collect()}
    enc = encoder(PATH)
    assert len(ids) == docs.count()
    for r in docs.select("doc_id", "text").collect():
        assert enc.decode(ids[r.doc_id]) == (r.text or "")
