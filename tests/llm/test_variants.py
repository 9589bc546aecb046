import zlib
from collections import Counter

import pytest

from tesserae.llm import variants

SCHEMA = "doc_id long, text string, other int"
ALPHABET = "abcdefghijklmnopqrstuvwxyzàéßÿ"


def near(a, b):
    """Whether one inserted, deleted or replaced character makes the one of the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "a" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in counts.items():
        beside = sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x))
        form = beside[0] if beside and counts[beside[0]] >= 10 * n else None
        out[w] = [form, n, len(beside), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def made(seed, n, length=9):
    """Words near each other, many times or seldom, in a fixed order."""
    x, rows = seed, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        base = "abcabca"[: 5 + x % 3] + "".join(ALPHABET[(x >> s) % (3 if i % 2 else len(ALPHABET))] for s in range(0, length - 5))
        at = (x >> 7) % len(base)
        kind = (x >> 11) % 4
        word = base if kind == 0 else base[:at] + base[at + 1 :] if kind == 1 else base[:at] + ALPHABET[x % 5] + base[at + kind % 2 :]
        rows.append((i, " ".join([word.upper() if i % 3 else word] * (1 + (x >> 5) % 30))))
    return rows


@pytest.mark.parametrize("size", [40, 400, 2_000_000])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(variants, "RANGE", size)  # many ranges, so that words meet over their limits
    rows = made(7, 400) + [(None, "Bonjour, BONJOUR bonjous bonjour÷× naïvement naïvement"), (5, None), (5, ""), *[(9, "repeated repeated repeates")] * 2, (10, "aaaaaaa aaaaaaaa aaaaaaaa aaaaaaa aaaaaab aaaaaab"), (11, "chainword " * 900 + "chainwore " * 40 + "chainwxre " * 3)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.digest(docs).collect()}
    want = brute(rows)
    assert got == want
    assert sum(v[3] > 0 for v in want.values()) > 50 and any(v[1] != v[0] for v in want.values() if v[0])


def test_each_pair_is_found_once(spark, monkeypatch):
    monkeypatch.setattr(variants, "RANGE", 100)
    words = sorted({w for _, t in made(3, 300, 8) for w in t.lower().split()})
    counts = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {r.word: r.n_near for r in variants.nearest(counts).collect()}
    assert got == {w: n for w in words if (n := sum(near(w, x) for x in words))}


def test_small_to_large():
    words = sorted({w for _, t in made(11, 3000, 10) for w in t.lower().split()})
    trie = variants.Trie(words, {})
    trie.known = type("All", (), {"__contains__": lambda self, t: True})()  # keeps every terminal
    most = Counter(w for _, _, w in trie.terminals()).most_common(1)[0][1]
    assert most <= 3 * (len(words).bit_length())


def test_long_words_take_linear_time():
    words = sorted(["x" * 200_000 + c + d for c in "abc" for d in "yz"] + ["x" * 199_999 + "ay"])
    got = {(t[-3:], d == variants.SKIPPED, w[-3:]) for t, d, w in variants.Trie(words, {}).terminals()}
    assert len(words) == 7 and ("xay", True, "xay") in got


def test_words_of_nothing(spark):
    assert variants.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.digest(spark.createDataFrame([(1, "short words are not"), (2, "oncealone")], "doc_id long, text string")).count() == 0


def test_common():
    assert [variants.common(*p) for p in (("", ""), ("abc", "abd"), ("abc", "abcd"), ("x" * 1000, "x" * 1001), ("b", "a"))] == [0, 2, 3, 1000, 0]
