"""Quality rules by tokeniser fertility (operator 12).

Two public vocabularies, one of pieces with byte fallback and one of bytes, measure each text: characters per token of both, the share of byte-fallback
tokens, and the entropy of the tokens as a share of the greatest that so many could have (1 for one token). Natural text of one language has narrow
values; symbols, capitals, tables and repeated words have others. As short texts vary more, and entropy falls with length, the bands are those
of a language and a length class (doublings of the number of words): WIDTH times the distance from the median to a quartile beyond that
quartile's side, and no closer than SLACK of the median. Texts without a lang are banded by script, that of most of their letters by Unicode block. A class
with fewer than ENOUGH texts rejects nothing. Medians and quartiles are taken over all texts that pass the base rules.

The base rules count words, symbols, repeated lines and words in repeated 3-word windows. Null texts count as empty; texts without words have no
measures and fail the base rules. Rows are kept one for one, repeated rows and ids too; no other column but lang is read.
"""

from __future__ import annotations

import base64
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, map_batches, spread_join, stored, worker_holds

SYMBOLS = "#*$%&|<>"
WINDOW, FEWEST, MOST = 3, 50, 50
MEASURES = ["piece_chars", "byte_chars", "fallback", "entropy"]
WIDTH, SLACK, ENOUGH = 5.0, 0.015, 200
#: The share of byte fallback is near zero for most texts: its band's least distance from the median.
LEAST = 0.02


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode().split()  # at ASCII white space: \x20 and \x09 to \x0D
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = Counter(line for line in text.split("\n") if line.encode().strip()) if "\n" in text else {}
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    repeated, end = 0, 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return len(words), chars, sum(map(text.count, SYMBOLS)), sum(lines.values()) - len(lines), repeated


def script(text: str) -> str:
    """The first word of the Unicode name of most letters (of equals the first by name); `none` without letters."""
    kinds: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            kinds[unicodedata.name(c, "UNKNOWN").split(" ")[0]] += n
    return min(kinds, key=lambda k: (-kinds[k], k)) if kinds else "none"


class Vocabularies:
    """One worker's two tokenizers."""

    def __init__(self, pieces: bytes, ranks: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        lines = (line.split() for line in ranks.splitlines() if line.strip())
        self.bytes = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(i) for t, i in lines}, special_tokens={})

    @classmethod
    def of(cls, held) -> Vocabularies:
        """held: a broadcast of the two files and the pattern."""
        return worker_holds("fertility", held.value, lambda: cls(*held.value))

    def measure(self, text: str) -> tuple[int, list[float] | None]:
        """Pieces of the text, and MEASURES; none for a text without tokens."""
        ids = np.array(self.pieces.encode(text), np.int64)
        if not len(ids):
            return 0, None
        times = np.bincount(ids)
        share = times[times > 0] / len(ids)
        entropy = float(-(share * np.log2(share)).sum() / np.log2(len(ids))) if len(ids) > 1 else 1.0
        return len(ids), [len(text) / len(ids), len(text) / len(self.bytes.encode_ordinary(text)), float(self.fallback[ids].mean()), entropy]


def measured(docs: DataFrame, pieces_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, the base counts, band (lang or script, and length class; null without tokens) and MEASURES of each row of docs (doc_id, text, lang)."""
    files = []
    for path in (pieces_path, ranks_path):
        with open(path, "rb") as f:
            files.append(f.read())
    held = docs.sparkSession.sparkContext.broadcast((*files, pattern))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = Vocabularies.of(held)
        rows, bands, found = [], [], []
        for x, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            text = x.as_py()
            rows.append(base(text))
            n, values = tokens.measure(text)
            bands.append(f"{lang if lang is not None else script(text)}:{rows[-1][0].bit_length()}" if n else None)
            found.append(values or [None] * len(MEASURES))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] + [pa.array(bands, pa.string())] + [pa.array(c, pa.float64()) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *counts, "band", *MEASURES])

    return map_batches(docs, run, f"{fields(docs, 'doc_id')}{', '.join(f'{c} long' for c in counts)}, band string, {', '.join(f'{c} double' for c in MEASURES)}")


def bands(rows: DataFrame) -> DataFrame:
    """band, n, and low and high of each measure: a row a language or script and length class of rows (band, base_failed, MEASURES)."""
    learn = rows.where("band IS NOT NULL").groupBy("band")
    passed = lambda c: F.percentile_approx(F.when(~F.col("base_failed"), F.col(c)), [0.25, 0.5, 0.75], 1000).alias(c)
    found = learn.agg(F.count("*").alias("n"), F.sum((~F.col("base_failed")).cast("long")).alias("n_learn"), *map(passed, MEASURES))

    def edge(c: str, side: int):
        q = F.col(c)
        away = F.greatest(WIDTH * F.abs(q[1 + side] - q[1]), F.lit(SLACK) * q[1], F.lit(LEAST if c == "fallback" else 0.0))
        return F.when(F.col("n_learn") >= ENOUGH, q[1] + side * away)

    return found.select("band", "n", *[edge(c, s).alias(f"{c}_{name}") for c in MEASURES for s, name in ((-1, "low"), (1, "high"))])


def judge(docs: DataFrame, pieces_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """The base counts, base_failed, kept, MEASURES and `reasons` (names of measures outside their bands) of each row of docs (doc_id, text, lang)."""
    rows = measured(docs, pieces_path, ranks_path, pattern)
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST * F.col("n_words"))
    rows = stored(rows.withColumn("base_failed", failed), "measured")
    out = spread_join(rows.where("band IS NOT NULL"), bands(rows), "band", "n")
    outside = [F.when((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high")), F.lit(c)) for c in MEASURES]
    kept = [*rows.columns, "reasons"]
    judged = out.withColumn("reasons", F.array_compact(F.array(*outside))).select(kept)
    none = rows.where("band IS NULL").withColumn("reasons", F.array().cast("array<string>")).select(kept)
    return judged.unionByName(none).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def digest(docs: DataFrame, pieces_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """The contract of operator 12."""
    rows = judge(docs, pieces_path, ranks_path, pattern)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES, F.array_join("reasons", ",").alias("reasons"))
