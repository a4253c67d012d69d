"""Abusive, hateful or sexual content: a passage classifier regularised by swapping identity terms."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.folding import HIDDEN, fold, passages
from touchline.llm.mixing import source_name
from touchline.session import ship

ORDERS = (3, 4, 5, 6, 8)
BITS = 18
#: Log odds of a passage of which nothing is known; fixed, so that unseen words aren't suspicious.
BIAS = -2.5
#: Length, in n-grams, of a passage whose n-grams weigh 1/sqrt(length); LENGTH_POWER 0.5 would be full normalisation,
#: which hides one abusive word in a long passage.
LENGTH, LENGTH_POWER = 80.0, 0.15
FOLDS = 3
#: Epochs of the first round's fits, of the later rounds', which go on from there, and of the final fit.
EPOCHS = (10, 5, 12)
ROUNDS = 3
#: Most that a passage's number of texts counts as weight.
MOST_WEIGHT = 20.0

# Names of groups of people, by language; a sentence's label must not depend on which one it names.
GROUPS = {
    "en": "women men girls boys immigrants foreigners refugees muslims jews christians gays lesbians blacks whites asians gypsies natives northerners southerners",
    "es": "mujeres hombres chicas chicos inmigrantes extranjeros refugiados musulmanes judios cristianos gays lesbianas negros blancos asiaticos gitanos",
    "de": "frauen maenner maedchen jungen einwanderer auslaender fluechtlinge muslime juden christen schwule lesben schwarze weisse asiaten",
    "fr": "femmes hommes filles garcons immigres etrangers refugies musulmans juifs chretiens gays lesbiennes noirs blancs asiatiques gitans",
    "pt": "mulheres homens meninas meninos imigrantes estrangeiros refugiados muculmanos judeus cristaos gays lesbicas negros brancos asiaticos ciganos",
    "it": "donne uomini ragazze ragazzi immigrati stranieri rifugiati musulmani ebrei cristiani gay lesbiche neri bianchi asiatici zingari",
}

# Common abuse, threats and explicit language, as passages that count as labelled with a low weight.
SEED = """
you idiot; you moron; fucking idiot; fuck you; piece of shit; son of a bitch; you bastard; you scumbag; you wanker; you cunt; asshole; arsehole; dickhead;
kill yourself; i will kill you; i know where you live; we will find you; hope you die; stab you; break your legs; burn in hell; you are trash; retard; whore; slut;
suck my dick; send nudes; want to fuck her; nice tits; ride my cock; naked pics; they are vermin; they are not human; go back to your country; deport them all;
eres un idiota; hijo de puta; gilipollas; cabron; pendejo; imbecil; vete a la mierda; que te den; puta; maricon; te voy a matar; ojala te mueras; se donde vives; chupamela; follame; fotos desnuda; son ratas; que se vuelvan a su pais;
du idiot; arschloch; hurensohn; wichser; missgeburt; fick dich; halt die fresse; drecksau; schlampe; ich bring dich um; verreck; ich weiss wo du wohnst; nacktbilder; blas mir einen; sie sind abschaum; ausländer raus;
connard; encule; salaud; fils de pute; pute; va te faire foutre; ferme ta gueule; abruti; je vais te tuer; creve; je sais ou tu habites; suce moi; baise moi; photos nue; ce sont des parasites; rentrez chez vous;
filho da puta; vai tomar no cu; arrombado; otario; babaca; vai se foder; cala a boca; viado; puta; vou te matar; sei onde voce mora; chupa meu pau; me fode; fotos pelada; nao sao gente; voltem para sua terra;
stronzo; coglione; figlio di puttana; vaffanculo; bastardo; pezzo di merda; troia; ti ammazzo; so dove abiti; crepa; succhiamelo; scopami; foto nuda; sono parassiti; tornate a casa vostra
"""

# The same subjects in sentences that aren't abuse.
CALM = """
killed the ball dead; destroyed them in midfield; a killer pass; shot low past the keeper; that was my own stupid mistake; damn that was close; what an ugly match; racism has no place here;
abuse against the referee must stop; women belong on every pitch; immigrants built this club; be proud of it; la mato con el pecho; remato a puerta; no al racismo; error mio; verdammt das war knapp; gegen rassismus; ich idiot;
non au racisme; l'a tuee quelle frappe; matou a bola no peito; contra o racismo; ha fulminato il portiere; no al razzismo
"""


def _phrases(text: str) -> list[str]:
    return [" " + fold(p.strip()) + " " for p in text.replace("\n", " ").split(";") if p.strip()]


def _chunk_features(rows: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    text = "\n".join(rows) + "\n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.flatnonzero(code == 10)
    row = np.zeros(len(code), dtype=np.int32)
    row[ends[:-1] + 1] = 1
    row = np.cumsum(row, dtype=np.int32)
    remaining = ends[row] - np.arange(len(code))
    numbers, owners = [], []
    for k in ORDERS:
        n = len(code) - k + 1
        if n <= 0:
            continue
        h = np.full(n, k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for j in range(k):
            h = (h ^ code[j : j + n]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        whole = remaining[:n] >= k
        numbers.append((h[whole] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32))
        owners.append(row[:n][whole])
    number, owner = np.concatenate(numbers), np.concatenate(owners)
    return number[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(rows))


def features(rows: list[str], bits: int = BITS, chunk: int = 4000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams of passages: feature numbers, start of each row, value of a feature of each row."""
    if not rows:
        return np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0)
    parts = [_chunk_features(rows[at : at + chunk], bits) for at in range(0, len(rows), chunk)]
    count = np.concatenate([c for _, c in parts])
    value = np.maximum(count, 1) ** -LENGTH_POWER * LENGTH ** (LENGTH_POWER - 0.5)
    return np.concatenate([n for n, _ in parts]), np.concatenate([[0], np.cumsum(count)]), value


class _Rows:
    """Features of many passages, of which some can be taken."""

    def __init__(self, rows: list[str]):
        self.number, self.start, self.value = features(rows)

    def __add__(self, other: _Rows) -> _Rows:
        out = _Rows([])
        out.number = np.concatenate([self.number, other.number])
        out.start = np.concatenate([self.start, other.start[1:] + self.start[-1]])
        out.value = np.concatenate([self.value, other.value])
        return out

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.start[which + 1] - self.start[which]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        return self.number[np.repeat(self.start[which] - begin[:-1], sizes) + np.arange(begin[-1])], begin, self.value[which]


def _sums(w: np.ndarray, number: np.ndarray, start: np.ndarray, value: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(w[number], dtype=np.float64)])
    return (total[start[1:]] - total[start[:-1]]) * value


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    threshold: float

    def score(self, rows: list[str]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        return _sigmoid(self.bias + _sums(self.weights, *features(rows)))

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        """Highest passage score of each text, 0 for texts without letters."""
        rows, owner = [], []
        for i, t in enumerate(texts):
            p = passages(t)
            rows += p
            owner += [i] * len(p)
        out = np.zeros(len(texts))
        for at in range(0, len(rows), 20_000):
            np.maximum.at(out, owner[at : at + 20_000], self.score(rows[at : at + 20_000]))
        return out


class _Chosen:
    """Some rows of others, as if they were all."""

    def __init__(self, rows: _Rows, which: np.ndarray):
        self.rows, self.which = rows, which

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.rows.take(self.which[which])


class _Fit:
    """Logistic regression by AdaGrad that can be continued on other rows."""

    def __init__(self, l2: float = 2e-5):
        self.w, self.g2, self.l2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), l2

    def score(self, rows: _Rows, which: np.ndarray) -> np.ndarray:
        return _sigmoid(BIAS + _sums(self.w, *rows.take(which)))

    def go_on(self, rows: _Rows | _Chosen, label: np.ndarray, weight: np.ndarray, swapped: _Rows, pair: np.ndarray, fairness: float, epochs: int, rng: np.random.Generator, rate: float = 0.5, batch: int = 1024) -> None:
        """`swapped` holds counterfactuals; `pair` is each row's, or -1. Differing scores of the two are penalised."""
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch)):
                number, begin, value = rows.take(part)
                z = BIAS + _sums(self.w, number, begin, value)
                own = (_sigmoid(z) - label[part]) * weight[part]
                grad = np.zeros(len(self.w))
                has = np.flatnonzero(pair[part] >= 0)
                if len(has) and fairness:
                    other, at, size = swapped.take(pair[part[has]])
                    apart = fairness * weight[part[has]] * np.clip(z[has] - BIAS - _sums(self.w, other, at, size), -2, 2)
                    own[has] += apart
                    grad -= np.bincount(other, np.repeat(apart * size, np.diff(at)), minlength=len(grad))
                grad += np.bincount(number, np.repeat(own * value, np.diff(begin)), minlength=len(grad))
                grad = grad / len(part) + self.l2 * self.w
                self.g2 += grad * grad
                self.w -= rate * grad / np.sqrt(self.g2)


def _document_counts(split: list[list[str]]) -> dict[str, int]:
    seen: dict[str, int] = defaultdict(int)
    for rows in split:
        for w in {w for r in rows for w in r.split()}:
            seen[w] += 1
    return seen


def name_words(split: list[list[str]], clean: np.ndarray, rare: float = 0.006, fillers: int = 5) -> set[str]:
    """Names of persons and clubs: rare words that stand where many different rare words stand in clean texts.

    A place is the pair of words around it. Words of abuse don't fill places of clean texts.
    """
    seen = _document_counts(split)
    least = max(3.0, rare * len(split))
    places: dict[tuple[str, str], set[str]] = defaultdict(set)
    for rows, ok in zip(split, clean, strict=True):
        if not ok:
            continue
        for r in set(rows):
            w = ["", *r.split(), ""]
            for i in range(1, len(w) - 1):
                around = [x for x in (w[i - 1], w[i + 1]) if x]
                if around and seen[w[i]] < least and w[i].isalpha() and len(w[i]) >= 4 and all(seen[x] >= least for x in around):
                    places[w[i - 1], w[i + 1]].add(w[i])
    return {w for found in places.values() if len(found) >= fillers for w in found}


def group_terms(rows: list[str], seen: dict[str, int], texts: int, most: int = 60) -> list[list[str]]:
    """Sets of exchangeable names of groups: the fixed ones by language, each with words found in their place.

    A word belongs to a language's set if it stands where one of its terms stands too: after the same word and before
    the same two. Words of more than one text in twenty aren't names of groups.
    """
    split = [["", *r.split(), "", ""] for r in rows]
    out = []
    for names in GROUPS.values():
        known = {fold(w) for w in names.split()}
        places = {(w[i - 1], w[i + 1], w[i + 2]) for w in split for i in range(1, len(w) - 2) if w[i] in known}
        met: dict[str, int] = defaultdict(int)
        for w in split:
            for i in range(1, len(w) - 2):
                if w[i] not in known and len(w[i]) > 3 and w[i + 1] and (w[i - 1], w[i + 1], w[i + 2]) in places and seen[w[i]] <= 0.05 * texts:
                    met[w[i]] += 1
        out.append(sorted(known) + sorted(met, key=lambda w: (-met[w], w))[:most])
    return out


class Counterfactuals:
    """Passages with the identity terms exchanged: names of groups within a language, and names of persons and clubs.

    A person's name is exchanged for another or, as often, for one made of halves of two, so that names no text holds
    weigh nothing either.
    """

    def __init__(self, terms: list[list[str]], names: set[str]):
        self.names, self.pool = names, sorted(names)
        self.group = {w: t for t in reversed(terms) for w in t}

    def swap(self, row: str, rng: random.Random) -> str | None:
        words, hit = row.split(), False
        for i, w in enumerate(words):
            if w in self.names:
                a, b = rng.choice(self.pool), rng.choice(self.pool)
                words[i], hit = (a if rng.random() < 0.5 else a[: len(a) // 2] + b[len(b) // 2 :]), True
            elif w in self.group:
                words[i], hit = rng.choice([x for x in self.group[w] if x != w]), True
        return " " + " ".join(words) + " " if hit else None


def _disguise(row: str, rng: random.Random) -> str:
    """A passage with some words misspelt: a letter hidden, two exchanged, or one lost."""
    words = row.split()
    for i, word in enumerate(words):
        if len(word) >= 4 and rng.random() < 0.5:
            k = rng.randrange(1, len(word) - 1)
            how = rng.random()
            words[i] = word[:k] + HIDDEN + word[k + 1 :] if how < 0.5 else word[:k] + word[k + 1] + word[k] + word[k + 2 :] if how < 0.85 else word[:k] + word[k + 1 :]
    return " " + " ".join(words) + " "


def _posterior(votes: list[list[tuple[str, int]]], prior: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Probability that a document is a case, from annotators of unequal care (expectation maximisation).

    `prior` is each document's probability before the votes.
    """
    p = np.array([np.mean([y for _, y in v]) if v else 0.0 for v in votes])
    for _ in range(rounds):
        right = defaultdict(lambda: np.array([[8.0, 2.0], [2.0, 8.0]]))
        for q, vs in zip(p, votes, strict=True):
            for who, y in vs:
                right[who][1, y] += q
                right[who][0, y] += 1 - q
        odds = np.log(np.clip(prior, 1e-3, 1 - 1e-3) / (1 - np.clip(prior, 1e-3, 1 - 1e-3)))
        for i, vs in enumerate(votes):
            for who, y in vs:
                m = right[who]
                odds[i] += np.log(m[1, y] / m[1].sum()) - np.log(m[0, y] / m[0].sum())
        p = _sigmoid(odds)
    return p


def _patterns(split: list[list[str]], rare: float = 0.006) -> dict[str, str]:
    """Passage to pattern: words of few texts, as names are, become blanks, if three other words remain."""
    seen = _document_counts(split)
    least = max(3.0, rare * len(split))
    out = {}
    for r in {r for rows in split for r in rows}:
        words = [w if seen[w] >= least else "_" for w in r.split()]
        out[r] = " ".join(words) if sum(w != "_" for w in words) >= 3 else r
    return out


def train(texts: list[str | None], votes: list[list[tuple[str, int]]], fairness: float = 1.0, seeded: bool = True, seed: int = 7) -> Model:
    """Fit the passage model to labelled texts.

    A label holds for a text, a case for a passage. Rounds alternate between (a) each passage's share in its text's
    being a case: the text's probability, divided among its passages by their own out-of-fold probabilities as in a
    noisy or, averaged over all passages of a pattern, and (b) fits to these shares and the annotators' votes weighed
    with the model's own. Every passage takes part, with as much weight as texts hold it, up to MOST_WEIGHT. Fits go
    on from the round before. `fairness` penalises score changes between a passage and its counterfactual; `seeded`
    adds the seed phrases.
    """
    rng, generator = random.Random(seed), np.random.default_rng(seed)
    split = [passages(t) for t in texts]
    n = len(texts)
    fold_of = np.arange(n) % FOLDS
    base = np.clip(np.mean([y for v in votes for _, y in v] or [0.1]), 0.02, 0.5)
    p = _posterior(votes, np.full(n, base))
    rows = sorted({r for s in split for r in s})
    number = {r: i for i, r in enumerate(rows)}
    held = [np.array(sorted({number[r] for r in s}), dtype=np.int64) for s in split]
    passage = np.concatenate([np.empty(0, np.int64), *held])
    owner = np.repeat(np.arange(n), [len(h) for h in held])
    pattern = _patterns(split)
    pattern_number = {k: i for i, k in enumerate(sorted(set(pattern.values())))}
    pattern_of = np.array([pattern_number[pattern[r]] for r in rows], dtype=np.int64)
    changed = Counterfactuals(group_terms(rows, _document_counts(split), n), name_words(split, p < 0.3))
    seeds = [(r, y) for text, y in ((SEED, 1.0), (CALM, 0.0)) for r in _phrases(text)] if seeded else []
    whole = _Rows(rows)
    scores: np.ndarray | None = None  # out of fold, of each passage of each text

    def shares(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct passage: its pattern's mean share in cases, and the number of texts that hold it."""
        here = use[owner]
        at, whose = passage[here], owner[here]
        if scores is None:
            clean = np.bincount(pattern_of[at], np.maximum(0, 1 - 2 * p[whose]), minlength=len(pattern_number))
            open_ = 1 / (1 + clean[pattern_of[at]]) ** 2  # what clean texts hold too is hardly the case
            share = p[whose] * open_ / np.maximum(np.bincount(whose, open_, minlength=n)[whose], 1e-9)
        else:
            any_ = -np.expm1(np.bincount(whose, np.log1p(-np.clip(scores[here], 0, 1 - 1e-9)), minlength=n))
            share = np.minimum(1, p[whose] * scores[here] / np.maximum(any_[whose], 1e-9))
        times = np.bincount(pattern_of[at], minlength=len(pattern_number))
        mean = np.bincount(pattern_of[at], share, minlength=len(pattern_number)) / np.maximum(times, 1)
        return mean[pattern_of], np.bincount(at, minlength=len(rows))

    def fit(model: _Fit, use: np.ndarray, epochs: int) -> None:
        share, times = shares(use)
        have = np.flatnonzero(times > 0)
        label = np.where(share > 0.3, np.clip((share - 0.1) / 0.6, 0, 1), 0.0)
        weight = np.minimum(times, MOST_WEIGHT)
        positive, negative = have[share[have] > 0.3], have[share[have] <= 0.3]
        boost = min(3.0, max(1.0, 0.2 * weight[have].sum() / max(weight[positive].sum(), 1e-9)))
        weight[positive] *= boost
        more = [(_disguise(rows[i], rng), label[i], 0.5 * weight[i]) for i in positive for _ in range(3)]
        more += [(_disguise(rows[i], rng), 0.0, 0.5 * weight[i]) for i in generator.choice(negative, min(len(negative), 2 * len(positive) + 200), replace=False)]
        more += [(r, y, 3.0) for r, y in seeds] + [(_disguise(r, rng), y, 1.0) for r, y in seeds]
        every = whole + _Rows([r for r, _, _ in more])
        swaps = [changed.swap(r, rng) for r in [*(rows[i] for i in have), *(r for r, _, _ in more)]]
        where = np.concatenate([have, len(rows) + np.arange(len(more))])
        pairs = np.flatnonzero([s is not None for s in swaps])
        chosen = _Chosen(every, where)
        pair = np.full(len(where), -1)
        pair[pairs] = np.arange(len(pairs))
        model.go_on(chosen, np.array([*label[have], *(y for _, y, _ in more)]), np.array([*weight[have], *(w for _, _, w in more)]), _Rows([swaps[k] for k in pairs]), pair, fairness, epochs, generator)

    worst = np.zeros(n)
    models = [_Fit() for _ in range(FOLDS)]
    for step in range(ROUNDS):
        new = np.zeros(len(passage))
        for k, model in enumerate(models):
            if (fold_of != k).any():
                fit(model, fold_of != k, EPOCHS[min(step, 1)])
            here = np.flatnonzero(fold_of[owner] == k)
            new[here] = model.score(whole, passage[here])
        scores = new
        worst = np.zeros(n)
        np.maximum.at(worst, owner, scores)
        p = _posterior(votes, np.clip(0.02 + 0.96 * worst, 0.02, 0.98))
    # threshold of the best balance of misses and false alarms against the weighed labels
    candidates = np.linspace(0.35, 0.8, 46)
    f1 = [2 * p[worst >= c].sum() / max(p.sum() + (worst >= c).sum(), 1e-9) for c in candidates]
    near = candidates[np.array(f1) >= max(f1) - 0.002]
    final = _Fit()
    fit(final, np.ones(n, dtype=bool), EPOCHS[2])
    return Model(final.w.astype(np.float32), BIAS, float(np.median(near)))


def fit_moderation(documents: DataFrame, labels: DataFrame, max_documents: int = 8_000, max_chars: int = 30_000_000, **settings) -> Model:
    """Train on labelled documents: a sample by the hash of their id, bounded by `max_documents` and, in all, `max_chars`.

    An annotator has one vote on a document, the more frequent of its labels. Null labels and labels of documents that
    don't exist are left out. Without any label the model rests on its seed phrases alone.
    """
    votes = (
        labels.where("doc_id is not null and abusive is not null")
        .groupBy("doc_id", F.coalesce("annotator", F.lit("")).alias("who"))
        .agg((F.avg(F.col("abusive").cast("double")) >= 0.5).cast("int").alias("y"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("who", "y"))).alias("votes"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_documents)
    )
    sampled = documents.select("doc_id", "text").join(F.broadcast(votes), "doc_id").withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    # sizes first: the texts that come to the driver are those that fit, in the sample's order
    sizes = sampled.groupBy("doc_id").agg(F.max("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    kept, total = [], 0
    for r in sizes:
        if total + r["size"] <= max_chars:
            kept.append((r["doc_id"],))
            total += r["size"]
    chosen = documents.sparkSession.createDataFrame(kept, votes.select("doc_id").schema)
    # one text of each id, whatever its copies
    rows = sampled.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("votes").alias("votes")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [[(v["who"], v["y"]) for v in r["votes"]] for r in rows], **settings)


def _scorer(model: Model, rows: int = 1000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                score = model.score_texts(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("source"), pa.array(np.round(score, 6)), pa.array(score >= model.threshold)], names=["doc_id", "source", "score", "flagged"]
                )

    return run


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source (one spelling), score in [0, 1] and flagged of every document.

    The score is that of the document's worst passage; the whole text is read, in passages. Null, empty and letterless
    texts score 0. Each row comes out once, repeated ids and copies too. Scored where it is read, without a shuffle;
    the model, of fixed size, goes out with the tasks.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, source string, score double, flagged boolean")


def rates_by_source(scored: DataFrame) -> DataFrame:
    """n_documents, n_flagged, rate and mean_score per source; documents without a source under null."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.col("flagged").cast("long")).alias("n_flagged"),
        F.avg(F.col("flagged").cast("double")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )
