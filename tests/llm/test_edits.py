import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import bpe, edits

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENS = bpe.Tokens(public_tokenizers.PATTERN, RANKS)


def state(text):
    pieces = TOKENS.find.findall(text)
    TOKENS.meet([pieces])
    c, n = edits._leaves(pieces, TOKENS)
    return edits.grown(c), edits.grown(n)


@settings(max_examples=300, deadline=None)
@given(st.text("ab 'sré1\n", max_size=400), st.lists(st.tuples(st.integers(0, 420), st.integers(0, 30), st.text("ab 'sr\n7", max_size=40)), max_size=5))
def test_counts_are_those_of_the_whole_text(text, changes):
    was = edits.LEAF
    edits.LEAF = 4
    try:
        c, tree = state(text)
        for at, size, new in changes:
            want = text[:at] + new + text[at + size :]
            text, c, tree, again, sums = edits.edit(text, c, tree, at, at + size, new, TOKENS)
            assert text == want and c[1] == len(text)
            assert tree[1] == len(LIBRARY.encode_ordinary(text))
            for x in (c, tree):
                assert (x[1 : len(x) // 2] == x[2:].reshape(-1, 2).sum(1)).all()
    finally:
        edits.LEAF = was


def test_edits_of_a_long_text_renew_few_sums():
    r = random.Random(1)
    text = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(20_000))
    c, tree = state(text)
    slots = len(tree) // 2
    anew = 0
    for _ in range(200):
        at, size = r.randrange(len(text)), r.randrange(0, 40)
        new = "".join(r.choices("ab c", k=r.randrange(0, 60)))
        text, c, tree, again, sums = edits.edit(text, c, tree, at, at + size, new, TOKENS)
        anew += len(tree) // 2 != slots or sums >= slots
        assert again < 2_000 and (sums <= 8 * slots.bit_length() or sums >= slots)
    assert tree[1] == len(LIBRARY.encode_ordinary(text)) and c[1] == len(text)
    assert anew == 0  # the tree is never laid out again


def test_a_long_insertion_lays_the_tree_out_anew():
    text = "some words " * 50
    c, tree = state(text)
    text, c, tree, _, _ = edits.edit(text, c, tree, 100, 100, "many new words " * 5_000, TOKENS)
    assert tree[1] == len(LIBRARY.encode_ordinary(text)) and c[1] == len(text)
    text, c, tree, _, sums = edits.edit(text, c, tree, 0, len(text), "", TOKENS)
    assert text == "" and tree[1] == c[1] == 0


def test_query(spark):
    rows = [(1, "one two three four five six seven"), (2, None), (2, ""), (3, "a"), (3, "a"), (None, "no id here at all"), (4, "long text " * 400)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tree int").repartition(2)
    got = sorted((r.doc_id or 0, r.n_tokens, r.edited_n_tokens, r.edited_n_chars, r.edited_sha256) for r in edits.digest(docs, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for d, t in rows:
        t = t or ""
        a = len(t) // 3
        u = t[:a] + t[:12] + t[a + 10 :]
        b = int(len(t) * 2 / 3)
        u = u[:b] + f" edited {(d or 0) % 1000}" + u[b:]
        want.append((d or 0, len(LIBRARY.encode_ordinary(t)), len(LIBRARY.encode_ordinary(u)), len(u), hashlib.sha256(u.encode()).hexdigest()))
    assert got == sorted(want)
    assert edits.digest(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
