"""Language by segmentation-marginalised unigrams over a fixed public vocabulary (operator 10).

A language is a distribution over the pieces of a vocabulary file. The probability of a
word is the sum over all ways to cut it into pieces, by the forward algorithm; white space
separates words and pieces don't cross it, so a text's log probability is the sum
over its words. Piece probabilities are learned by expectation maximisation (forward and backward
sums) from the counts of every (language, word) of the training rows.

A character outside the vocabulary is the unknown piece. Words of any length count whole: a word is worked
through in parts between places that no piece crosses, and sums of long parts, or beyond the range of doubles, are kept as logarithms. A text that is null or
has no letter is `und` with score 0, and so is every text
where no row has been learned from; else the prediction is the language of highest posterior
(the alphabetically first of equals) and score that posterior, 0 to 1. Rows are kept one for one;
those with a null id are not learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IntTable, fields, held_out, slices, stored, worker_holds

ROUNDS = 2
ADDED = 0.01  # to each piece's expected count
#: Words that a worker counts before it passes them on, and that it remembers when it scores; characters of these; characters summed at a time.
COUNTED, REMEMBERED, CHARACTERS, PART = 150_000, 100_000, 2_000_000, 200_000
#: Parts of words up to which all are worked through side by side, by their places; longer ones place by place.
SIDE = 48
LETTER = re.compile(r"[^\W\d_]")
_U = np.uint64


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of text, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [model.id_to_piece(i) for i in plain]


class Arcs:
    """The pieces that stand in many words, and the parts that these fall into: a part lies between two places that no piece crosses.

    Places run on from word to word and part to part; a part of n characters has n + 1 of them. An arc goes from place to place.
    """

    def __init__(self, source, target, piece, part, first, last, word):
        step = (source - first[part]) * 1_000 + target - source  # arcs of one step and different parts never share a place
        long = (last - first > SIDE)[part]
        order = np.argsort(np.where(long, np.iinfo(np.int64).max, step), kind="stable")
        self.source, self.target, self.piece, self.part = (x[order] for x in (source, target, piece, part))
        self.first, self.last, self.word = first, last, word  # of each part
        self.size = int(last[-1]) + 1 if len(last) else 0
        self.side = len(order) - int(long.sum())  # arcs of parts that are worked through side by side, then those of long ones
        cuts = np.flatnonzero(np.diff(step[order[: self.side]])) + 1
        self.steps = [slice(b, e) for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), self.side], strict=True)] if self.side else []

    def _long(self, ends: np.ndarray) -> Iterator[np.ndarray]:
        """The arcs of long parts, those of one end together, in order of their ends."""
        at = self.side + np.argsort(ends[self.side :], kind="stable")
        return iter(np.split(at, np.flatnonzero(np.diff(ends[at])) + 1) if len(at) else ())

    def _plain(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums of products before each place and the arcs' factors, for parts that are not long, a column a language; and the factor that each
        character has been given, so that sums of middling words stay near one."""
        unit = 1 / max(1e-30, float(p[:-1].mean())) ** 0.5
        own = p[self.piece[: self.side]] * (unit ** (self.target - self.source)[: self.side])[:, None]
        a = np.zeros((self.size, p.shape[1]))
        a[self.first] = 1.0
        with np.errstate(all="ignore"):
            for s in self.steps:
                a[self.target[s]] += a[self.source[s]] * own[s]
        return a, own, unit

    def ended(self, p: np.ndarray) -> np.ndarray:
        """The log probability of each part (row) in each language (column); not finite for long parts, and where a sum left the range of doubles."""
        a, _, unit = self._plain(p)
        with np.errstate(all="ignore"):
            return np.log(a[self.last]) - ((self.last - self.first) * np.log(unit))[:, None]

    def shares(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each arc of parts that are not long given its part, in one language, and which parts this holds for."""
        a, own, _ = self._plain(p[:, None])
        a, own, z = a[:, 0], own[:, 0], np.zeros(self.size)
        z[self.last] = 1.0
        source, target = self.source[: self.side], self.target[: self.side]
        with np.errstate(all="ignore"):
            for s in reversed(self.steps):
                z[source[s]] += z[target[s]] * own[s]
            whole = a[self.last]
            return a[source] * own * z[target] / whole[self.part[: self.side]], np.isfinite(whole) & (whole > 0)

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """The log probability of what each part has before each place, a column a language."""
        a = np.full((self.size, log_p.shape[1]), -np.inf)
        a[self.first] = 0.0
        for s in self.steps:
            to = self.target[s]
            a[to] = np.logaddexp(a[to], a[self.source[s]] + log_p[self.piece[s]])
        for group in self._long(self.target):
            x = a[self.source[group]] + log_p[self.piece[group]]
            top = x.max(0)
            a[self.target[group[0]]] = top + np.log(np.exp(x - top).sum(0))
        return a

    def backward(self, log_p: np.ndarray) -> np.ndarray:
        """The log probability of what each part has behind each place, in one language."""
        z = np.full(self.size, -np.inf)
        z[self.last] = 0.0
        for s in reversed(self.steps):
            begin = self.source[s]
            z[begin] = np.logaddexp(z[begin], z[self.target[s]] + log_p[self.piece[s]])
        for group in self._long(-self.source):
            x = z[self.target[group]] + log_p[self.piece[group]]
            z[self.source[group[0]]] = x.max() + np.log(np.exp(x - x.max()).sum())
        return z


class Vocabulary:
    """Finds all pieces within many words at once: a trie in a hash table, walked from every character side by side."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1  # the last is the unknown piece
        nodes, edges, piece = {"": 0}, {}, [-1]
        for k, p in enumerate(pieces):
            for i in range(1, len(p) + 1):
                if p[:i] not in nodes:
                    nodes[p[:i]] = len(piece)
                    piece.append(-1)
                    edges[nodes[p[: i - 1]] << 21 | ord(p[i - 1])] = nodes[p[:i]]
            piece[nodes[p]] = k
        self.edges = IntTable(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64))
        self.piece = np.array(piece)

    def arcs(self, words: list[str]) -> Arcs:
        """All pieces of the words, each with a leading space mark; a character that is no piece by itself is the unknown piece too."""
        words = ["▁" + w for w in words]
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        stop = np.cumsum(lengths)[word]
        at, node, begins, sizes, pieces, n = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], [], [], 0
        while len(at):
            node = self.edges.get(node << 21 | codes[at + n])
            n += 1
            alive = node >= 0
            at, node = at[alive], node[alive]
            piece = self.piece[node]
            ends = piece >= 0
            begins.append(at[ends])
            sizes.append(np.full(int(ends.sum()), n))
            pieces.append(piece[ends])
            if n == 1:
                lone = np.ones(len(codes), bool)
                lone[at[ends]] = False
                lone = np.flatnonzero(lone)
                begins.append(lone)
                sizes.append(np.ones(len(lone), np.int64))
                pieces.append(np.full(len(lone), self.size - 1))
            inside = at + n < stop[at]
            at, node = at[inside], node[inside]
        begin, size, piece = (np.concatenate(x) for x in (begins, sizes, pieces))
        crossed = np.cumsum(np.bincount(begin + 1, minlength=len(codes) + 2) - np.bincount(begin + size, minlength=len(codes) + 2))[: len(codes)]
        cut = crossed == 0
        part = np.cumsum(cut) - 1
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(codes))
        shift = np.arange(len(first))
        return Arcs(begin + part[begin], begin + size + part[begin], piece, part[begin], first + shift, last + shift, word[first])


def _in_parts(words: list[str]) -> Iterator[slice]:
    """Slices of the words of about PART characters each."""
    begin = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= PART:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(words):
        yield slice(begin, len(words))


def forward(vocabulary: Vocabulary, words: list[str], p: np.ndarray) -> np.ndarray:
    """The log probability of each word (row) in each language (column); p: a column of piece probabilities a language."""
    total = np.zeros((len(words), p.shape[1]))

    def add(arcs: Arcs, ended: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(arcs.word, ended[:, g], size) for g in range(p.shape[1])], 1)

    for part in _in_parts(words):
        here = words[part]
        arcs = vocabulary.arcs(here)
        ended = arcs.ended(p)
        total[part] = add(arcs, ended, len(here))
        rest = np.unique(arcs.word[~np.isfinite(ended).all(1)])
        if len(rest):
            arcs = vocabulary.arcs([here[i] for i in rest])
            total[part.start + rest] = add(arcs, arcs.forward(np.log(p))[arcs.last], len(rest))
    return total


def expected(vocabulary: Vocabulary, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The expected number of each piece in the words of one language, over all their segmentations."""
    out = np.zeros(vocabulary.size)
    for part in _in_parts(words):
        here, n = words[part], counts[part]
        arcs = vocabulary.arcs(here)
        share, sound = arcs.shares(p)
        rest = np.unique(arcs.word[~sound])
        n_here = n.copy()
        n_here[rest] = 0
        weight = n_here[arcs.word][arcs.part[: arcs.side]]
        kept = weight > 0
        out += np.bincount(arcs.piece[: arcs.side][kept], share[kept] * weight[kept], vocabulary.size)
        if len(rest):
            arcs, log_p = vocabulary.arcs([here[i] for i in rest]), np.log(p)
            a, z = arcs.forward(log_p[:, None])[:, 0], arcs.backward(log_p)
            share = np.exp(a[arcs.source] + log_p[arcs.piece] + z[arcs.target] - a[arcs.last][arcs.part])
            out += np.bincount(arcs.piece, share * n[rest][arcs.word][arcs.part], vocabulary.size)
    return out


def train(docs: DataFrame, vocabulary_path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their shares of the rows, and a column of piece probabilities for each. docs: text, lang, all learned from."""
    spark = docs.sparkSession
    pieces = load_pieces(vocabulary_path)
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(c.values(), pa.int64())], ["lang", "word", "n"])
            seen.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(text.split())
                size += len(text)
            if sum(map(len, seen.values())) > COUNTED or size > 20 * CHARACTERS:
                size = 0
                yield from flush()
        yield from flush()

    words = stored(docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    shares = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    size = len(pieces) + 1
    p = np.full((size, len(langs)), 1 / size)
    for _ in range(rounds if langs else 0):
        held = spark.sparkContext.broadcast((pieces, langs, p))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, langs, p = held.value  # noqa: B023
            vocabulary, sums = _vocabulary(held.value), np.zeros((len(langs), len(pieces) + 1))
            held_rows: list[list] = [[], [], []]

            def flush() -> None:
                of, word, n = held_rows
                for g, lang in enumerate(langs):
                    mine = [i for i, x in enumerate(of) if x == lang]
                    if mine:
                        sums[g] += expected(vocabulary, [word[i] for i in mine], np.array([n[i] for i in mine], float), p[:, g])
                for x in held_rows:
                    x.clear()

            for batch in batches:
                for x, c in zip(held_rows, ("lang", "word", "n"), strict=True):
                    x += batch.column(c).to_pylist()
                if len(held_rows[0]) >= 20_000:  # many words share one walk through the vocabulary
                    flush()
            flush()
            g, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(k, pa.int64()), pa.array(sums[g, k])], ["g", "k", "x"])

        sums = np.zeros_like(p)
        for r in words.mapInArrow(expect, "g long, k long, x double").groupBy("g", "k").agg(F.sum("x").alias("x")).collect():  # at most pieces times languages
            sums[r.k, r.g] = r.x
        p = (sums + ADDED) / (sums.sum(0) + ADDED * size)
    return langs, np.array([shares[x] for x in langs], float) / max(1, sum(shares.values())), p


def _vocabulary(source: tuple) -> Vocabulary:
    """One worker's trie of the pieces that come first in a broadcast value."""
    return worker_holds("langid", source, lambda: Vocabulary(source[0]))


def predict(docs: DataFrame, vocabulary_path: str, model: tuple[list[str], np.ndarray, np.ndarray], keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text), log_probs, the languages' posteriors' logarithms in alphabetical order, and, if columns are to be kept, text and those as the struct kept."""
    held = docs.sparkSession.sparkContext.broadcast((load_pieces(vocabulary_path), *model))
    docs = docs.select("doc_id", "text", *([F.struct(*keep).alias("kept")] if keep else []))
    carried = docs.columns if keep else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, shares, p = held.value
        vocabulary, index, table = _vocabulary(held.value), {}, np.zeros((0, len(langs)))
        for batch in slices(batches, 4_000):  # many words share one walk through the vocabulary
            places, whole = [], []
            for text in batch.column("text").to_pylist():
                if text and langs and LETTER.search(text):
                    places.append(np.array([index.setdefault(w, len(index)) for w in text.split()]))
                    whole.append(True)
                else:
                    whole.append(False)
            if len(index) > len(table):
                new = list(index)[len(table) :]
                table = np.concatenate([table, forward(vocabulary, new, p)])
            names, scores, logs, k = [], [], [], 0
            for known in whole:
                if known:
                    x = table[places[k]].sum(0) + np.log(shares)
                    x -= x.max()
                    x -= np.log(np.exp(x).sum())
                    best = int(x.argmax())
                    names.append(langs[best])
                    scores.append(float(np.exp(x[best])))
                    logs.append(x.tolist())
                    k += 1
                else:
                    names.append("und")
                    scores.append(0.0)
                    logs.append([])
            if len(index) > REMEMBERED or sum(map(len, index)) > CHARACTERS:
                index, table = {}, np.zeros((0, len(langs)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(logs, pa.list_(pa.float64()))], [*carried, "lang_pred", "score", "log_probs"])

    return docs.mapInArrow(run, f"{fields(docs, *carried)}lang_pred string, score double, log_probs array<double>")


def digest(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The contract of operator 10: learns from the rows that aren't held out, predicts all."""
    model = train(docs.where(held_out(5) != 0), vocabulary_path)
    return predict(docs, vocabulary_path, model).select("doc_id", F.coalesce(held_out(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
