"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text (operator 6).

Folding lower-cases, maps homoglyphs and accented letters to plain ones and digits or signs that stand
for letters to those letters; everything else is a space. The lexicon is learned from at most
SAMPLE labelled rows (drawn by a hash of the id): all words much likelier in toxic texts, weighted
by their log odds. Exception phrases are pairs of adjacent words, one of them in the lexicon, that
are no likelier in toxic texts; they cancel that word's match. Weights of matches, as
they are and normalised by length, give the score by a logistic regression. It is fitted across FOLDS parts of the sample:
each text is measured with a lexicon that was learned from the other parts, as a new text would be.

Without labels of both kinds every score is the share of toxic ones (0 without labels). Empty
and null texts are scored like texts without a match. Rows are kept one for one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, held_out, slices, stored, texts

SAMPLE, FOLDS = 40_000, 4
LEAST_DOCS, LEAST_WEIGHT = 5, 2.0
#: Lengths of the stems.
STEMS = range(4, 8)

#: Letters of other scripts that look like Latin ones, in the order of the letters they look like.
LOOKALIKES = {"a": "аαɑ", "b": "вЬβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һн", "i": "іιıɪ", "j": "ј", "k": "кκ", "l": "ӏⅼ", "m": "мμ", "n": "пη", "o": "оοσө", "p": "рρ", "q": "ԛ", "r": "гʀ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ѡω", "x": "хχ", "y": "уγ", "z": "ᴢ"}
#: Digits and signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}


class _Fold(dict):
    """What each character is folded to, worked out when first met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).lower()
        out = "".join(self.look.get(c, STANDS_FOR.get(c, c if c.isalnum() else "")) for c in plain if not unicodedata.combining(c))
        self[code] = out = out if out or unicodedata.combining(char) or unicodedata.category(char) == "Cf" else " "
        return out

    look = {other: letter for letter, others in LOOKALIKES.items() for other in others}


_FOLD = _Fold()


#: Signs that are letters only between letters: at a word's end they are punctuation.
_ENDS = str.maketrans("!|", "  ")


def fold_text(text: str) -> str:
    """Folded words, a space around each."""
    if "!" in text or "|" in text:
        text = "".join(w if w.isalpha() else w.rstrip("!|") + " " if w[-1] in "!|" else w for w in _spaced(text))
    return f" {' '.join(text.translate(_FOLD).split())} "


def _spaced(text: str) -> list[str]:
    """Words and the white space between them, in turn."""
    return [w for w in re.split(r"(\s+)", text) if w]


class Lexicon:
    """The automaton over words (written with a space behind), stems and exception phrases, and the regression behind the score."""

    def __init__(self, weights: dict[str, float], phrases: set[str]):
        self.weights, self.phrases = weights, phrases
        self.bias, self.slope, self.mean, self.spread = 0.0, np.zeros(4), np.zeros(4), np.ones(4)
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}  # each worker builds its own

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for key, value in [*self.weights.items(), *((f"{p} ", None) for p in self.phrases)]:
                self._automaton.add_word(f" {key}", (len(key), value))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) of each word of the folded text with an entry, by its heaviest, unless an exception phrase holds it; begin is that of the space before."""
        automaton = self.automaton()
        if not len(automaton):
            return []
        best: dict[int, float] = {}
        spared: set[int] = set()
        for last, (size, value) in automaton.iter(folded):
            if value is None:
                spared |= {last - size, folded.index(" ", last - size + 1)}  # the spaces before its two words
            else:
                best[last - size] = max(value, best.get(last - size, value))
        return [(b, folded.index(" ", b + 1), w) for b, w in sorted(best.items()) if b not in spared]

    def features(self, folded: str) -> list[float]:
        weights = [w for *_, w in self.matches(folded)]
        words = folded.count(" ") - 1
        total = sum(weights)
        return [np.log1p(total), max(weights, default=0.0), total / np.log2(words + 4), len(weights) / np.sqrt(words + 1)]

    def fit(self, x: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression by Newton's method with a small penalty."""
        if not len(x) or toxic.min() == toxic.max():
            share = float(toxic.mean()) if len(x) else 0.0
            self.bias, self.slope = (np.inf if share == 1 else -np.inf), np.zeros(x.shape[1])
            return
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])
        w = np.zeros(z.shape[1])
        penalty = np.diag([0.0, *[1.0] * x.shape[1]])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (p - toxic) + penalty @ w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), slope)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.bias, self.slope = float(w[0]), w[1:]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.bias):
            return np.full(len(x), float(self.bias > 0))
        return 1 / (1 + np.exp(-np.clip(self.bias + (x - self.mean) / self.spread @ self.slope, -30, 30)))


def _tables(keys):
    """A function for mapInArrow that counts (key, toxic, fold) over a partition; keys(folded, fold) gives a text's distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*seen, strict=True), (pa.string(), pa.int64(), pa.int32()), strict=True)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(seen.values(), pa.int64())], ["key", "toxic", "fold", "n"])
            seen.clear()
            return out

        for batch in slices(batches):
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                seen.update((k, toxic, f) for k, f in keys(fold_text(text), fold))
                if len(seen) > 300_000:
                    yield flush()
        if seen:
            yield flush()

    return run


def _words(folded: str, fold: int) -> set[tuple[str, int]]:
    words = set(folded.split())
    return {(k, fold) for k in {f"{w} " for w in words}.union(*({w[:n] for w in words if len(w) > n} for n in STEMS))}


def phrases(folded: str, found: list[tuple[int, int, float]]) -> set[str]:
    """The pairs of a matched word and a word beside it."""
    out = set()
    for b, e, _ in found:
        if b > 0:
            out.add(folded[folded.rfind(" ", 0, b) + 1 : e])
        if e + 1 < len(folded):
            out.add(folded[b + 1 : folded.index(" ", e + 1)])
    return out


def _odds(t: float, c: float, toxic: int, clean: int) -> float:
    """The log odds of standing in a toxic text against a clean one."""
    return float(np.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """docs: doc_id, text; labels: doc_id, toxic, all learned from. At most `sample` labels are used, so they are broadcast."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    chosen = F.broadcast(drawn(known, sample, "doc_id"))
    rows = texts(docs).join(chosen, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = stored(rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "labelled")
    sizes = np.zeros((2, FOLDS + 1), np.int64)  # clean and toxic texts of each fold; the last column is all
    for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect():
        sizes[r.toxic, [r.fold, FOLDS]] += r.n
    counted = sizes[:, FOLDS:] - sizes
    counted[:, FOLDS] = sizes[:, FOLDS]  # what the lexicon that leaves a fold out is learned from; the last leaves none out
    schema = "key string, toxic long, fold int, n long"
    apart = [F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"{'ct'[y]}{f}") for y in (0, 1) for f in range(FOLDS)]
    total = sum(F.col(f"t{f}") for f in range(FOLDS))
    words = rows.mapInArrow(_tables(_words), schema).groupBy("key").agg(*apart).where(total >= LEAST_DOCS)
    weights: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    for r in words.toLocalIterator():  # keys of at least LEAST_DOCS toxic texts of the sample
        c, t = (np.array([r[f"{x}{f}"] for f in range(FOLDS)]) for x in "ct")
        for f in range(FOLDS + 1):
            tf, cf = (int(x.sum() - (x[f] if f < FOLDS else 0)) for x in (t, c))
            if tf >= LEAST_DOCS and (w := _odds(tf, cf, counted[1, f], counted[0, f])) >= LEAST_WEIGHT:
                weights[f][r.key] = w
    plain = spark.sparkContext.broadcast([Lexicon(w, set()) for w in weights])

    def spared(folded: str, fold: int) -> set[tuple[str, int]]:
        return {(p, f) for f, lexicon in enumerate(plain.value) if f != fold for p in phrases(folded, lexicon.matches(folded))}

    both = rows.mapInArrow(_tables(spared), schema).groupBy("key", "fold").agg(*(F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias("ct"[y]) for y in (0, 1)))
    exceptions: list[set[str]] = [set() for _ in range(FOLDS + 1)]
    for r in both.where(F.col("t") + F.col("c") >= LEAST_DOCS).toLocalIterator():
        if _odds(r.t, r.c, counted[1, r.fold], counted[0, r.fold]) <= 0:
            exceptions[r.fold].add(r.key)
    models = [Lexicon(w, x) for w, x in zip(weights, exceptions, strict=True)]
    final = spark.sparkContext.broadcast(models[:-1])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [final.value[f].features(fold_text(t)) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    found = rows.mapInArrow(measure, "x array<double>, toxic long").toArrow()  # a row a labelled text, at most the sample
    x, toxic = np.array(found.column("x").to_pylist()).reshape(-1, 4), found.column("toxic").to_numpy()
    order = np.lexsort((*x.T, toxic))
    models[-1].fit(x[order], toxic[order])
    return models[-1]


def score(docs: DataFrame, model: Lexicon) -> DataFrame:
    """doc_id, score, matches (the folded lexicon words met, in order) of each row of docs (doc_id, text)."""
    docs = texts(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, met = [], []
            for t in batch.column("text"):
                folded = fold_text(t.as_py())
                x.append(held.value.features(folded))
                met.append([folded[b + 1 : e] for b, e, _ in held.value.matches(folded)] if x[-1][1] else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.scores(np.array(x))), pa.array(met, pa.list_(pa.string()))], ["doc_id", "score", "matches"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, matches array<string>")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of operator 6: learns from labels that aren't held out, scores all documents."""
    found = score(docs, train(docs, labels.where(held_out(5) != 0)))
    return found.select("doc_id", F.coalesce(held_out(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("matches").cast("long").alias("n_matches"))
