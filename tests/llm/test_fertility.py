import math
import statistics
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from tesserae.llm import bpe, fertility

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, kept string, band int"
SPACE = " \t\n\v\f\r"


def brute(text):
    """The base counts by definition."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [x for x in text.split("\n") if any(c not in SPACE for c in x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


@pytest.mark.parametrize(
    "text", ["", None, "one", "a b c a b c", "a a a a a a", "x y z q x y z\nx y z", "line\nline\n\n \nline \nLine\r\nline", "#*$%&|<> a b\x1cc\x85d", "tab\tv\vf\fr\r", "aé漢😀 é é é é", "a b c d a b x b c d", "\n\n\n", "same\n" * 50]
)
def test_base_counts(text):
    assert fertility.base(text or "") == brute(text)


def test_script():
    assert [fertility.script(x) for x in ("", "12 +", "abc", "дом a", "漢字 x", "aд", "éü1")] == ["none", "none", "LATIN", "CYRILLIC", "CJK", "CYRILLIC", "LATIN"]


def test_measures():
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    held = type("Held", (), {"value": (open(PIECES, "rb").read(), open(RANKS, "rb").read(), public_tokenizers.PATTERN)})
    tokens = fertility.Vocabularies(*held.value)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for text in ("some words here, some more", "漢字かな", "x", "\x00\x01 \U00012000"):
        ids = pieces.encode(text)
        times = Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in times.values())
        n, values = tokens.measure(text)
        assert n == len(ids)
        assert values == pytest.approx([len(text) / len(ids), len(text) / len(library.encode_ordinary(text)), sum(pieces.id_to_piece(i).startswith("<0x") for i in ids) / len(ids), entropy / math.log2(len(ids)) if len(ids) > 1 else 1.0])
    assert tokens.measure("") == (0, None)


def corpus():
    """Plain texts of two languages, and in each some of symbols, capitals and one word."""
    rows, x = [], 5
    stems = {"en": "the house and dog of this street were seen by all them on that day in old town near river water light".split(), "xx": "дом река вода свет город улица день окно поле лес море небо".split()}
    for i in range(700):
        lang = "en" if i % 2 else "xx"
        words = []
        for _ in range(120):
            x = (x * 1103515245 + 12345) % 2**31
            words.append(stems[lang][(x >> 8) % len(stems[lang])] + stems[lang][(x >> 16) % len(stems[lang])])
        rows.append([i, " ".join(words), lang, "k", 1])
    odd = {3: lambda w: f"{w}%%%&&&", 4: str.upper, 5: lambda w: f"| {w[:1]} |"}
    for i, f in odd.items():
        rows[i][1] = " ".join(map(f, rows[i][1].split()))
    rows[6][1], rows[7][1], rows[8][2] = "short text", "again and again " * 100, None
    return [tuple(r) for r in rows] + [(900, None, "en", "k", 1), (901, "", None, "k", 1), (None, " \n\t", None, "k", 1)]


def test_query(spark, monkeypatch):
    rows = corpus()
    got = {r.doc_id: r for r in fertility.digest(spark.createDataFrame(rows, SCHEMA).repartition(4), PIECES, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        r = got[doc_id]
        n, *_, repeated = want = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (r.base_failed and r.kept)
    assert [i for i in (3, 4, 5, 6, 7, 900, 901, None) if got[i].kept] == []
    assert sum(not got[i].kept for i in range(9, 700)) < 7 and got[8].kept  # script CYRILLIC has too few texts to reject any
    # The bands by definition, over texts of the language and class of number 9, which all have as many words.
    tokens = fertility.Vocabularies(open(PIECES, "rb").read(), open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    values = [tokens.measure(t)[1][0] for i, t, lang, *_ in rows if lang == "en" and t and brute(t)[0] in range(64, 128) and not got[i].base_failed]
    low, middle, _ = statistics.quantiles(values, n=4)
    least = middle - max(fertility.WIDTH * (middle - low), fertility.SLACK * middle)
    assert "piece_chars" in got[3].reasons and got[3].piece_chars < least < sorted(values)[5]


def test_few_texts_reject_nothing(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 60]
    got = fertility.judge(spark.createDataFrame(rows, SCHEMA), PIECES, RANKS, public_tokenizers.PATTERN).collect()
    assert all(r.kept != r.base_failed and not r.reasons for r in got)


def test_empty(spark):
    assert fertility.digest(spark.createDataFrame([], SCHEMA), PIECES, RANKS, public_tokenizers.PATTERN).count() == 0
