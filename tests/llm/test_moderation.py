import numpy as np
import pytest

from touchline.llm.folding import fold, passages
from touchline.llm.moderation import Model, _posterior, fit_moderation, group_terms, name_words, rates_by_source, score_documents, train
from touchline.sources.tables import table


@pytest.mark.parametrize(
    ("text", "plain"),
    [("I​d​i​o​t", "idiot"), ("i-d-i-o-t!", "idiot!"), ("1d10t you", "idiot you"), ("іdіоt", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("I.d.i.o.t", "idiot"), ("cafÃ© Ñandú", "cafe nandu"), ("a&nbsp;b", "a b"), ("id*ot id#ot", "id*ot id*ot"), ("nooooo", "no"), ("@fan4024 hi", "  hi")],
)
def test_folding(text, plain):
    assert fold(text) == plain


def test_passages():
    assert passages(None) == passages("") == passages(" ​ ") == passages("12 !") == []
    long = passages("w " * 100 + "end")
    assert all(len(p.split()) <= 16 for p in long) and "end" in long[-1]
    assert passages("one. two\nthree") == [" one ", " two ", " thre "]


def corpus(n=400):
    rng = np.random.default_rng(0)
    calm = ["the keeper saved well", "what a goal from the left", "women play here on friday", "immigrants built this club", "they pressed high all game", "i killed the ball dead"]
    bad = ["you are a useless idiot", "all immigrants are vermin", "women are too dumb for this", "shut up you moron", "go home you parasites"]
    texts, truth = [], []
    for i in range(n):
        parts = [calm[rng.integers(len(calm))] for _ in range(4)]
        y = int(i % 5 == 0)
        if y:
            parts[rng.integers(4)] = bad[rng.integers(len(bad))]
        texts.append(". ".join(parts))
        truth.append(y)
    votes = [[("good", y)] + ([("bad", int(rng.random() < 0.5))] if rng.random() < 0.5 else []) for y in truth]
    return texts, truth, votes


def test_held_out_accuracy_and_counterfactuals():
    texts, truth, votes = corpus()
    model = train(texts[:250], votes[:250])
    flagged = model.score_texts(texts[250:]) >= model.threshold
    assert (flagged == np.array(truth[250:], bool)).mean() > 0.97
    # exchanging the group keeps the verdict, whether calm or not
    calm = model.score([" women play here on friday ", " gays play here on friday ", " muslims play here on friday "])
    assert (calm < model.threshold).all() and np.ptp(calm) < 0.2
    hate = model.score([" al imigrants are vermin ", " al jews are vermin ", " al lesbians are vermin "])
    assert (hate >= model.threshold).all()


def test_careless_annotators_count_less():
    votes = [[("a", i % 2), ("b", i % 2), ("c", 1)] for i in range(40)]
    p = _posterior(votes, np.full(40, 0.3))
    assert (p[::2] < 0.1).all() and (p[1::2] > 0.9).all()


def test_scores(spark):
    model = Model(np.zeros(1 << 18, dtype=np.float32), -2.5, 0.5)
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "A-b", 1), (2, "", "A-b", 1), (3, "x " * 50_000, "a_b", 1)], "doc_id long, text string, source string, score int")
    out = score_documents(docs, model)
    assert sorted((r.doc_id, r.source, r.score, r.flagged) for r in out.collect()) == [(1, None, 0.0, False), (2, "a_b", 0.0, False), (2, "a_b", 0.0, False), (3, "a_b", 0.075858, False)]
    assert {r.source: r.n_documents for r in rates_by_source(out).collect()} == {None: 1, "a_b": 3}
    assert score_documents(docs.limit(0), model).count() == 0


def test_without_labels(spark, data):
    docs = table(spark, data, "documents")
    labels = table(spark, data, "moderation_labels")
    model = fit_moderation(docs, labels.limit(0))
    assert model.score_texts(["you fucking idiot"])[0] > model.score_texts(["what a lovely evening"])[0]


def test_counterfactuals_spare_neutral_mentions():
    """A group, and persons, that labelled texts name only in abuse: neutral mentions score lower with the penalty."""
    rng = np.random.default_rng(3)
    common = ["women", "men", "immigrants", "foreigners", "refugees"]
    names = [a + b for a in ("tor", "vel", "kas", "bri", "mor", "zan", "hul", "pen", "rav", "sot") for b in ("wick", "dulo", "maris", "posk", "lund", "terri", "ghane", "ziffo", "bruck", "yantar")]
    calm = ["the {} of this town play here on friday", "all {} are welcome in our stand", "so many {} came to the final", "{n} crossed from the left", "a long pass by {n} found nobody"]
    bad = ["all {} are vermin", "the {} of this town should be gassed", "{n} is a useless idiot"]
    texts, votes = [], []
    for i in range(500):
        y = int(i % 5 == 0)
        parts = [str(rng.choice(calm)).format(rng.choice(common), n=rng.choice(names)) for _ in range(3)]
        if y:
            parts[1] = str(rng.choice(bad)).format(rng.choice(["dromish", *common]), n=rng.choice(names[::10]))
        texts.append(". ".join(parts))
        votes.append([("a", y), ("b", y)])
    unseen = ["dromish", "hello dromish", "dromish flags", "what about dromish", "{n}", "lovely {n}", "on comes {n}"]
    neutral = [t.format(n=n) for t in unseen for n in names[::10]]
    mean = {f: train(texts, votes, fairness=f, seeded=False).score_texts(neutral).mean() for f in (0.0, 1.0)}
    assert mean[1.0] < 0.8 * mean[0.0]
    fair = train(texts, votes, seeded=False)
    assert (fair.score_texts(neutral) < fair.threshold).all()
    assert (fair.score_texts(["all dromish are vermin", "All women are vermin!", "torwick is a useless idiot", "zanposk is a useless idiot"]) >= fair.threshold).all()


def test_names_and_groups_are_found():
    calm = [f"and {a}{b} shot wide" for a in ("tor", "vel", "kas") for b in ("wick", "dulo", "maris")]
    split = [[f" {t} "] for t in calm * 3] + [[" you ugly torwick "], [" al women are vermin "], [" al dromish are vermin "]]
    found = name_words(split, np.array([True] * 27 + [False] * 3), rare=0.2)
    assert found == {t.split()[1] for t in calm}
    rows = sorted({r for s in split for r in s})
    terms = group_terms(rows, {w: 1 for r in rows for w in r.split()}, 100)
    assert "dromish" in terms[0] and not any("ugly" in t or "vermin" in t for t in terms)


def test_training_sample_is_bounded_in_length(spark):
    docs = spark.createDataFrame([(i, "x y z. " * 100) for i in range(20)] + [(5, "x y z. " * 100), (99, "w " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "a") for i in [*range(20), 99]], "doc_id long, abusive int, annotator string")
    from touchline.llm import moderation

    seen = []
    keep = moderation.train
    try:
        moderation.train = lambda texts, votes, **_: seen.append((len(texts), sum(map(len, texts)), [len(v) for v in votes]))
        fit_moderation(docs, labels, max_chars=7_000)
        fit_moderation(docs, labels.where("abusive > 1"))
    finally:
        moderation.train = keep
    assert seen == [(10, 7_000, [1] * 10), (0, 0, [])]


def test_every_passage_is_trained_on(monkeypatch):
    from touchline.llm import moderation

    class Seen(Exception):
        pass

    def go_on(self, rows, label, weight, *_, **__):
        raise Seen(int(((label == 0) & (weight > 0)).sum()))

    monkeypatch.setattr(moderation._Fit, "go_on", go_on)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    name = lambda n: syllables[n % 70] + syllables[n // 70 % 70] + syllables[n // 4900 % 70]
    texts = [" ".join(f"The match of {name(300 * d + k)} was quiet." for k in range(300)) for d in range(330)]
    with pytest.raises(Seen) as e:
        moderation.train(texts, [[("a", 0)]] * len(texts))
    distinct = {p for i, t in enumerate(texts) if i % 3 for p in moderation.passages(t)}
    assert len(distinct) > 60_000 and e.value.args[0] >= len(distinct)
