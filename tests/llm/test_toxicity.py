import random
import time

import numpy as np
import pytest

from tesserae.llm import toxicity as t


def test_fold():
    assert t.fold_text("ІDI0T! s-t.u p1d Pàthętic СaFé 1d1οt!!") == " idiot s t u pid pathetic cafe idiot "
    assert t.fold_text("") == "  " and t.fold_text("ab!cd") == " abicd "


def test_matches_are_brute_forces():
    r = random.Random(1)
    lexicon = t.Lexicon({"ab ": 2.0, "ab": 1.0, "abc": 3.0, "dd ": 4.0}, {"no ab", "dd ok"})
    for _ in range(300):
        words = r.choices(["ab", "abc", "abcd", "dd", "ddd", "no", "ok", "x"], k=r.choice([0, 1, 6]))
        want = []
        for i, w in enumerate(words):
            found = [v for k, v in lexicon.weights.items() if f"{w} ".startswith(k)]
            spared = (i and f"{words[i - 1]} {w}" in lexicon.phrases) or (i + 1 < len(words) and f"{w} {words[i + 1]}" in lexicon.phrases)
            if found and not spared:
                want.append(max(found))
        assert [w for *_, w in lexicon.matches(f" {' '.join(words)} ")] == want


def corpus():
    r = random.Random(3)
    clean = ["the", "river", "was", "seen", "by", "old", "town", "walls"]
    rows, labels = [], []
    for i in range(600):
        words = r.choices(clean, k=r.choice([5, 20, 60])) + [f"u{i}"]
        toxic = i % 4 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["idiot", "scum", "zornig" + r.choice("abcdefg")]))
        elif i % 40 == 1:
            words.insert(r.randrange(len(words)), "scum cleaner")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_words_stems_and_exceptions(spark):
    rows, labels = corpus()
    rows += [(9001, "what an 1di0t walks"), (9002, None), (9003, ""), (9004, "a scum cleaner"), (9005, "zornigzzz"), (9005, "zornigzzz")]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, toxic int").repartition(3)
    marks = spark.createDataFrame([(*x, "a", 0.5) for x in [*labels, (None, 1), (3, None), (3, 9)]], "doc_id long, toxic int, text string, score double")
    got = t.digest(docs, marks).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    wrong = [i for i, x in labels if by[i].predicted != x]
    assert not wrong
    assert (by[9001].predicted, by[9002].predicted, by[9003].predicted, by[9004].predicted, by[9005].predicted) == (1, 0, 0, 0, 1)
    assert all(0 <= r.score <= 1 for r in got)
    assert t.digest(docs.limit(0), marks).count() == 0
    none = t.digest(docs, marks.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    one = t.digest(docs, marks.where("toxic = 1")).collect()
    assert {r.score for r in one} == {1.0}


def test_fit_separates():
    m = t.Lexicon({}, set())
    x = np.random.default_rng(1).normal(size=(300, 4))
    y = (x[:, 0] > 0).astype(int)
    m.fit(x, y)
    assert ((m.scores(x) > 0.5) == y).mean() > 0.97


def test_training_by_brute_force(spark):
    """Lexicon, exceptions and measures of the folds, counted text by text."""
    rows, labels = corpus()
    long = "q" * 300
    rows = [(i, x + (f" {long} idiot" if i % 40 == 3 else "")) for i, x in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.train(docs, marks)
    fold = {r.doc_id: r.f for r in docs.selectExpr("doc_id", f"pmod(xxhash64(text), {t.FOLDS}) f").collect()}
    toxic, text = dict(labels), {i: t.fold_text(x).split() for i, x in rows}
    odds = lambda a, b, n, m: np.log((a + 0.5) / (n + 1) / ((b + 0.5) / (m + 1)))

    def learned(ids):
        n, m = sum(toxic[i] for i in ids), sum(1 - toxic[i] for i in ids)
        seen: dict = {}
        for i in ids:
            for k in {w + " " for w in text[i]} | {w[:k] for w in text[i] for k in t.STEMS if len(w) > k}:
                seen.setdefault(k, [0, 0])[toxic[i]] += 1
        weights = {k: odds(b, a, n, m) for k, (a, b) in seen.items() if b >= t.LEAST_DOCS and odds(b, a, n, m) >= t.LEAST_WEIGHT}
        near: dict = {}
        for i in ids:
            w = text[i]
            hit = [any(f"{x} ".startswith(k) for k in weights) for x in w]
            for p in {" ".join(w[j : j + 2]) for j in range(len(w) - 1) if hit[j] or hit[j + 1]}:
                near.setdefault(p, [0, 0])[toxic[i]] += 1
        return t.Lexicon(weights, {p for p, (a, b) in near.items() if a + b >= t.LEAST_DOCS and odds(b, a, n, m) <= 0})

    whole = learned(list(text))
    assert model.weights == pytest.approx(whole.weights) and model.phrases == whole.phrases and f"{long} idiot" in whole.phrases
    parts = [learned([i for i in text if fold[i] != f]) for f in range(t.FOLDS)]
    x = {i: parts[fold[i]].features(f" {' '.join(w)} ") for i, w in text.items()}
    unique = {x_: i for i, x_ in rows}
    order = sorted(unique.values(), key=lambda i: (toxic[i], *reversed(x[i])))
    whole.fit(np.array([x[i] for i in order]), np.array([toxic[i] for i in order]))
    want = whole.scores(np.array([whole.features(f" {' '.join(w)} ") for w in text.values()]))
    got = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    assert [got[i] for i in text] == pytest.approx(list(want), abs=1e-6)


def test_long_texts():
    m = t.Lexicon({"bad ": 2.0}, {"not bad"})
    began = time.process_time()
    for text in ("x" * 1_000_000, "bad " * 250_000, "not bad " * 125_000, "!" * 1_000_000, "a!" * 500_000, "b|ad " * 200_000):
        m.features(t.fold_text(text))
    assert time.process_time() - began < 40
