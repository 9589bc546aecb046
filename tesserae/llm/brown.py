"""Class-based bigrams with exchange clustering (operator 5).

Counts come from every training row. The most frequent words, EACH a class, are put into classes by the exchange algorithm, which
moves one word at a time to the class that most raises the likelihood of the class bigrams. Then every other word, down to those that
occur once, goes to the class that its neighbours make most likely, by one job over all training rows. The number of classes grows with the
fourth root of the vocabulary beyond BASE words, from CLASSES on. A text's probability is the product over its tokens of
P(class | class before) P(word | class); texts begin where one has ended, and the end is a class of its own.

P(class | before) is smoothed by the classes' own shares; P(word | class) is (count + 1) / (tokens + words of the class), where the class
with most different words has one more, for any unseen word.

Each worker holds the words that are needed often (HEAD of them at most); what the others need is a table that is joined. Which words are held changes
no result. The driver holds the counts of pairs of the words that are exchanged, the classes' bigrams and the held words.

Null and empty texts consist of an end alone. Rows are kept one for one, repeated ids and rows too.
Without training rows all counts are 0 and base_score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent, held_out, most_frequent, slices, stored, texts

#: Words that a worker holds; classes at least, and up to so many words; words that are exchanged for each class.
HEAD, CLASSES, BASE, EACH, ROUNDS = 131_072, 64, 65_536, 16, 4
#: Codes that a task gathers before it counts and hands them on.
HELD = 4_000_000
SMOOTH = 5.0
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str) -> list[bytes]:
    """Words without the end: A-Z lower-cased, cut at ASCII white space."""
    return text.encode().translate(FOLD).split()


def exchange(pairs: np.ndarray, n: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """A class of each symbol of a square matrix of bigram counts: the first n are clustered, each other one is a class of its own behind theirs."""
    size = len(pairs)
    of = np.concatenate([np.arange(n) % classes, classes + np.arange(size - n)])
    total = classes + size - n
    one = np.zeros((size, total))
    one[np.arange(size), of] = 1
    after, before = pairs @ one, pairs.T @ one  # a symbol's counts with the classes behind and before it
    table = one.T @ after
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            a = of[w]
            # Take w out of its class: its row and column, and what it has with itself once.
            self_ = pairs[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[a] -= self_
            into[a] -= self_
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= self_
            rows, columns = table.sum(1), table.sum(0)
            c = np.arange(classes)
            gain = f(table[:classes] + out).sum(1) - f(table[:classes]).sum(1) + f(table[:, :classes] + into[:, None]).sum(0) - f(table[:, :classes]).sum(0)
            # The cell (c, c) has been counted in both sums, without what w has with itself.
            d = table[c, c]
            gain += f(d + out[:classes] + into[:classes] + self_) - f(d + out[:classes]) - f(d + into[:classes]) + f(d)
            gain -= f(rows[:classes] + out.sum() + self_) - f(rows[:classes]) + f(columns[:classes] + into.sum() + self_) - f(columns[:classes])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += self_
            if b != a:
                moved += 1
                of[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[:, a] -= pairs[w]
                before[:, b] += pairs[w]
        if not moved:
            break
    return of


def likely(n: np.ndarray, classes: int) -> np.ndarray:
    """What a neighbour adds to the likelihood of a word's being in each of the first classes: rows are the classes behind, then those before; n: counts of (class before, class)."""
    whole = max(1.0, n.sum())
    behind = np.log((n + SMOOTH * (n.sum(0) + 1) / whole) / (n.sum(1, keepdims=True) + SMOOTH))[:classes].T
    before = np.log((n + SMOOTH * (n.sum(1, keepdims=True) + 1) / whole) / (n.sum(0) + SMOOTH))[:, :classes]
    return np.concatenate([behind, before])


class Model:
    """What scoring needs of the held words: places, counts, classes, and the logarithms of both factors.

    The first `clustered` words are those that were exchanged. Classes are numbered, the end is the last.
    """

    def __init__(self, held: list[tuple[str, int]], clustered: int, classes: int, ends: int, all_tokens: int, distinct: int):
        self.ids = {w.encode(): i for i, (w, _) in enumerate(held)}
        self.counts = np.array([n for _, n in held], np.int64)
        self.clustered, self.classes, self.ends, self.tokens, self.distinct = clustered, classes, ends, all_tokens, distinct
        self.of = np.full(len(held) + 1, classes, np.int64)  # the last is any other word
        self.unit = np.log10(all_tokens + distinct + 1)

    def places(self, found: list[bytes]) -> np.ndarray:
        """The places of words; those not held stand at -1."""
        return np.fromiter(map(self.ids.get, found, repeat(-1)), np.int64, len(found))

    def cluster(self, pairs: np.ndarray) -> None:
        """pairs: counts of (symbol before, symbol)."""
        of = exchange(pairs, self.clustered, self.classes, ROUNDS)
        size = self.classes + 2
        n = np.zeros((size, size))
        np.add.at(n, (of[:, None], of[None]), pairs)
        self.weights = likely(n, self.classes)
        self.of[: self.clustered] = of[: self.clustered]

    def emit(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words that occur n times."""
        return np.log10((n + 1) / self.room[of])

    def placed(self, mass: np.ndarray, types: np.ndarray) -> None:
        """mass, types: tokens and different words of each class."""
        self.rare = int(types.argmax())  # the class of unseen words
        self.room = np.maximum(mass + types + (np.arange(self.classes) == self.rare), 1.0)
        self.of[-1] = self.rare
        n = np.append(self.counts, 0)
        self.held_emit, self.held_log = self.emit(n, self.of), np.log10(n + 1.0)

    def learn(self, n: np.ndarray) -> None:
        """n: counts of (class before, class)."""
        share = (n.sum(0) + 1) / (n.sum() + len(n))
        self.step = np.log10((n + SMOOTH * share) / (n.sum(1, keepdims=True) + SMOOTH))


def counted(docs: DataFrame) -> DataFrame:
    """word, n over all texts of docs, ends not counted; stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(tokens(text.as_py()))
                if len(seen) > 400_000:
                    yield flush()
        if seen:
            yield flush()

    return stored(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")


def _summed(codes: list[np.ndarray]) -> pa.RecordBatch:
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])


def _matrix(codes: DataFrame, size: int) -> np.ndarray:
    """Sums of (code, n) as a square matrix: at most size squared rows come to the driver."""
    out = np.zeros(size * size)
    found = codes.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


#: Stands for an end among the places of words in _framed.
END = -2


def _held_words(docs: DataFrame) -> Model:
    """The model with its counts and held words; docs: doc_id, text, all learned from."""
    counts = counted(docs)
    ends = docs.count()
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    classes = int(CLASSES * max(1.0, n_words / BASE) ** 0.25)
    first = [(r.word, r.n) for r in most_frequent(counts, EACH * classes).collect()]
    held = sorted(((r.word, r.n) for r in frequent(counts, HEAD).collect()), key=lambda x: (-x[1], x[0]))
    held = first + sorted(set(held) - set(first), key=lambda x: (-x[1], x[0]))
    return Model(held, len(first), max(1, min(classes, len(first))), ends, n_tokens + ends, n_words + (ends > 0))


def _symbols(docs: DataFrame, model: Model, keep: str) -> DataFrame:
    """row, doc_id, keep, ids (places of the words, -1 for those that aren't held), words (those, different ones) and places (from 1, of each of them) of each row of docs; stored, so that texts are cut into words once."""
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kinds = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())))
        for batch in slices(batches):
            rows = []
            for text in batch.column("text"):
                found = tokens(text.as_py())
                at = m.places(found)
                rest: dict[bytes, list] = {}
                for i in np.flatnonzero(at < 0).tolist():
                    rest.setdefault(found[i], []).append(i + 1)
                rows.append((at.astype(np.int32), [w.decode() for w in rest], list(rest.values())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", keep)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["row", "doc_id", keep, "ids", "words", "places"])

    return stored(docs.mapInArrow(run, f"row long, doc_id {kind}, {keep} boolean, ids array<int>, words array<string>, places array<array<int>>"), "symbols")


def _lengths(x: pa.ListArray) -> np.ndarray:
    return x.value_lengths().fill_null(0).to_numpy()


def _framed(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all words of a batch with an end on both sides of each row, the row of each, and where each row begins."""
    many = _lengths(ids)
    row = np.repeat(np.arange(len(many)), many + 2)
    at = np.full(len(row), END)
    at[np.arange(many.sum()) + 2 * np.repeat(np.arange(len(many)), many) + 1] = ids.flatten().to_numpy()
    return at, row, np.cumsum(many + 2) - many - 2


def _fit(rows: DataFrame, model: Model) -> DataFrame:
    """Gives the model its classes, from _symbols of the rows learned from; the table of the words that aren't held (word, n, class)."""
    size, k = model.clustered + 2, model.clustered

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes of (symbol before, symbol): the clustered words, any other word, the end."""
        codes, n = [], 0
        for batch in slices(batches):
            at, row, _ = _framed(batch.column("ids"))
            s = np.where(at == END, k + 1, np.where((at >= 0) & (at < k), at, k))
            codes.append((s[:-1] * size + s[1:])[row[:-1] == row[1:]])
            n += len(s)
            if n > HELD:
                yield _summed(codes)
                codes, n = [], 0
        if codes:
            yield _summed(codes)

    model.cluster(_matrix(rows.select("ids").mapInArrow(pairs, "code long, n long"), size))
    others = _place_others(rows, model)
    mass, types = (np.bincount(model.of[:k], x, model.classes).astype(float) for x in (model.counts[:k], np.ones(k)))
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        mass[r["class"]] += r.n
        types[r["class"]] += r.k
    model.placed(mass, types)
    return others.where("id < 0").select("word", "n", "class")


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model but for its class bigrams, and the table of the words that aren't held (word, n, class); docs: doc_id, text, all learned from."""
    docs = texts(docs).withColumn("learn", F.lit(True))
    model = _held_words(docs)
    return model, _fit(_symbols(docs, model, "learn"), model)


def _place_others(rows: DataFrame, model: Model) -> DataFrame:
    """word, id (-1 if it isn't held), n, class of each word that was not exchanged; gives the held ones their classes.

    A task adds up the neighbours' classes of a word before it passes them on, so few rows of a word meet, however frequent it is.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = model.classes + 2
    names = ["word", "id", "codes", "times"]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        word_of = list(m.ids)
        codes, n = [], 0
        rare, others = [], 0

        def flush_held() -> pa.RecordBatch:
            code, times = np.unique(np.concatenate(codes), return_counts=True)
            word = code // (2 * size)
            ids, begin = np.unique(word, return_index=True)
            offsets = pa.array(np.append(begin, len(code)), pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (code % (2 * size), times))
            return pa.RecordBatch.from_arrays([pa.array([word_of[i] for i in ids], pa.binary()).cast(pa.string()), pa.array(ids, pa.int32()), *lists], names)

        def flush_rare() -> pa.RecordBatch:
            """Words of several texts as one row each."""
            named = pa.concat_arrays([x for x, _, _ in rare]).dictionary_encode()
            word = np.repeat(named.indices.to_numpy(), np.concatenate([x for _, x, _ in rare]))
            both = np.concatenate([x for _, _, x in rare])[np.argsort(word, kind="stable")].ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, 2 * np.bincount(word, minlength=len(named.dictionary)).cumsum()), pa.int32()), pa.array(both, pa.int32()))
            return pa.RecordBatch.from_arrays([named.dictionary, pa.array([-1] * len(lists), pa.int32()), lists, pa.nulls(len(lists), pa.list_(pa.int32()))], names)

        for batch in slices(batches):
            at, _, begin = _framed(batch.column("ids"))
            # of other words the class is not known yet: they count as one, behind all classes, and then comes the end
            of = np.where(at == END, size - 1, np.where((at >= 0) & (at < m.clustered), m.of[np.maximum(at, -1)], size - 2))
            i = np.flatnonzero(at >= m.clustered)
            if len(i):
                codes += [at[i] * (2 * size) + of[i + 1], at[i] * (2 * size) + size + of[i - 1]]
                n += 2 * len(i)
            words, places = batch.column("words"), batch.column("places").flatten()
            times = _lengths(places)
            if len(times):
                i = np.repeat(np.repeat(begin, _lengths(words)), times) + places.flatten().to_numpy()
                rare.append((words.flatten(), times, np.stack([of[i + 1], of[i - 1] + size], 1)))
                others += len(i)
            if n > HELD:
                yield flush_held()
                codes, n = [], 0
            if others > 300_000:
                yield flush_rare()
                rare, others = [], 0
        if codes:
            yield flush_held()
        if rare:
            yield flush_rare()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.weights
        last: tuple | None = None  # the word that the next batch may go on with: word, id, occurrences, sums
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32())

        def out(word, ids, n, sums) -> pa.RecordBatch:
            of = np.round(sums, 6).argmax(1)  # sums differ in their last places by the order of rows
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((word, ids, n, of), kinds, strict=True)], ["word", "id", "n", "class"])

        for batch in slices(batches, 5_000):
            codes, times, words = batch.column("codes"), batch.column("times"), batch.column("word")
            many = codes.value_lengths().to_numpy()
            # Rows are sorted by word: those of one are summed before they meet the weights.
            begins = np.append(True, pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False))
            first = np.flatnonzero(begins)
            group = np.repeat(begins.cumsum() - 1, many)
            x = np.ones(len(group))
            x[np.repeat(times.is_valid().to_numpy(zero_copy_only=False), many)] = times.flatten().to_numpy()
            both = np.bincount(group * len(w) + codes.flatten().to_numpy(), x, len(first) * len(w)).reshape(-1, len(w))
            n, sums = both.sum(1) / 2, both @ w
            word, ids = (batch.column(c).take(pa.array(first)).to_pylist() for c in ("word", "id"))
            if last is not None:
                if last[0] == word[0]:
                    n[0] += last[2]
                    sums[0] += last[3]
                else:
                    yield out([last[0]], [last[1]], [int(last[2])], last[3][None])
            last = word[-1], ids[-1], n[-1], sums[-1]
            if len(word) > 1:
                yield out(word[:-1], ids[:-1], n[:-1].astype(np.int64), sums[:-1])
        if last is not None:
            yield out([last[0]], [last[1]], [int(last[2])], last[3][None])

    found = rows.select("ids", "words", "places").mapInArrow(contexts, "word string, id int, codes array<int>, times array<int>")
    placed = stored(found.repartition("word").sortWithinPartitions("word").mapInArrow(best, "word string, id int, n long, class int"), "placed")
    own = placed.where("id >= 0").select("id", "class").toArrow()  # at most HEAD rows
    model.of[own.column("id").to_numpy()] = own.column("class").to_numpy()
    return placed


def _resolved(rows: DataFrame, model: Model, others: DataFrame, keep: str) -> DataFrame:
    """doc_id, keep, n_tokens, n_known, base, prob (of the words in their classes) and codes (the classes, with an end on both sides) of each row of _symbols; stored."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            ids, rest, size = batch.column("ids"), batch.column("rest"), batch.num_rows
            at, row, begin = _framed(ids)
            of = np.where(at == END, m.classes, m.of[np.maximum(at, -1)])
            inside = at != END
            row, at = row[inside], at[inside]
            words = rest.flatten()
            places, count, kind_of = (pc.struct_field(words, i) for i in (0, 1, 2))
            owner, times = np.repeat(np.arange(size), _lengths(rest)), _lengths(places)
            n, kind_of = count.to_numpy().astype(float), kind_of.to_numpy().astype(np.int64)
            of[np.repeat(begin[owner], times) + places.flatten().to_numpy()] = np.repeat(kind_of, times)
            add = lambda x: np.bincount(owner, x, size)
            n_tokens = _lengths(ids).astype(np.int64) + 1
            known = np.bincount(row, at >= 0, size).astype(np.int64) + (m.ends > 0) + add(times).astype(np.int64)
            base = np.bincount(row, m.held_log[at], size) + np.log10(m.ends + 1) - n_tokens * m.unit + add(times * np.log10(n + 1))
            prob = np.bincount(row, m.held_emit[at], size) + add(times * (m.emit(n, kind_of) - m.held_emit[-1]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(of)), pa.int32()), pa.array(of, pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(keep), pa.array(n_tokens), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(prob, pa.float64()), lists], ["doc_id", keep, "n_tokens", "n_known", "base", "prob", "codes"])

    rest = rows.select("row", F.explode(F.arrays_zip("words", "places")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.places").alias("places"))
    rest = rest.join(others, "word").groupBy("row").agg(F.collect_list(F.struct("places", "n", "class")).alias("rest"))
    return stored(rows.select("row", "doc_id", keep, "ids").join(rest, "row", "left").mapInArrow(finish, f"doc_id {kind}, {keep} boolean, n_tokens long, n_known long, base double, prob double, codes array<smallint>"), "resolved")


def score(docs: DataFrame, learn: str) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text), learned from those whose column `learn` is true."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), learn)
    model = _held_words(docs.where(F.col(learn)))
    symbols = _symbols(docs, model, learn)
    rows = _resolved(symbols, model, _fit(symbols.where(F.col(learn)), model), learn)
    size = model.classes + 1

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size * size, np.int64)  # a worker holds the square of the classes
        for batch in slices(batches):
            of, row = _codes(batch)
            inside = row[:-1] == row[1:]
            seen += np.bincount((of[:-1] * size + of[1:])[inside], minlength=size * size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], ["code", "n"])

    model.learn(_matrix(rows.where(F.col(learn)).select("codes").mapInArrow(bigrams, "code long, n long"), size))
    step, n_tokens = rows.sparkSession.sparkContext.broadcast(model.step), model.tokens

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, row = _codes(batch)
            inside = row[:-1] == row[1:]
            prob = batch.column("prob").to_numpy() + np.bincount(row[:-1][inside], step.value[of[:-1][inside], of[1:][inside]], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(learn), batch.column("n_tokens"), batch.column("n_known"), pa.array([n_tokens] * batch.num_rows, pa.int64()), batch.column("base"), pa.array(prob, pa.float64())], ["doc_id", learn, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(finish, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {learn} boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all tokens of a batch, and the row that each is of."""
    codes = batch.column("codes")
    return codes.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), codes.value_lengths().to_numpy())


def digest(docs: DataFrame) -> DataFrame:
    """The contract of operator 5."""
    rows = score(docs.withColumn("learn", F.coalesce(held_out(7) != 2, F.lit(True))), "learn")
    return rows.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
