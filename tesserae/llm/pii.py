"""Personal data by patterns and a skip-chain conditional random field (operator 2).

The base finds e-mail addresses, IP addresses, card and phone numbers by their patterns. The
field's nodes are the base spans, whose kind is given, and the other mentions: tokens with a digit or an @ (numbers beside each other are one), and
addresses whose @ is spelled `(at)`. A mention is `none` or one of the kinds. What speaks for a label: the mention's
form, whether its digits pass a kind's check, the words around it (unary); the mention beside it (chain);
and the last mention of the document that is the same, or similar, however far off (skip chains): the same
digits or address in any form, or the same last seven digits or the same local part.

All potentials are fitted together by the pseudo-likelihood of each mention given its neighbours, to
the base's findings in at most SAMPLE documents and ROWS mentions, drawn by a hash. The base doesn't know a
repeat in another form, so a mention that is none of the base's but like one of them has no label there and teaches
nothing. Instead each mention is learned again as its own repeat would look: without its form, without its form and
the words around it but the same as itself, and similar to itself. Loopy sum-product messages
pass over all documents of a batch at once. A mention whose belief in one kind reaches SURE becomes a span if it passes that
kind's check, or if skip chains join it with a base span of that kind.

Null and empty texts have no spans. Rows are kept one for one; the result doesn't depend on
other columns. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from heapq import merge
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, map_batches, texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE, ROWS = 50_000, 200_000
FEATURES = 4_096
STEPS, SURE, ROUNDS = 12, 0.6, 150
#: Kinds of edges: beside each other, the same, similar.
EDGES = ("chain", "same", "similar")

ANY = re.compile(r"[0-9@]|[\[({<][Aa][Tt][\])}>]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits begins, so a run is read once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<!\S)(?:[^\s0-9@]*+[0-9@]\S*+|[A-Za-z0-9._%+-]++[\[({<][Aa][Tt][\])}>][A-Za-z0-9.-]++)")
NUMBER = re.compile(r"[0-9().+/_-]*\Z")
SPELLED = re.compile(r"[\[({<](at|dot)[\])}>]")
DIGITS = re.compile("[^0-9]+")  # all but digits
Spans = list[tuple[str, int, int]]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    """Whether all are at most 255, of any length: Python reads no integers of thousands of digits."""
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in parts))


def emails(text: str) -> Spans:
    """From each @ back over its local part and on over its domain: linear, where a search from the left is not."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", begin, end))
        # Else what stands before the next @ can't reach over this one.
        at = text.find("@", max(at + 1, end))
    return out


def base(text: str) -> Spans:
    """The spans of the patterns, by kind as listed, then start."""
    out = emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if octets(m[0].split("."))]
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


_SHAPE = ((re.compile("[0-9]+"), "9"), (re.compile("[A-Z]+"), "A"), (re.compile(r"[^\W\d_]*[a-z\x80-\U0010ffff][^\W\d_]*"), "a"))  # letters that the middle doesn't take are single by then, so no run is read twice


def shape(token: str) -> str:
    for pattern, sign in _SHAPE:
        token = pattern.sub(sign, token)
    return token


def _bucket(name: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{name}={value}") % FEATURES


def checks(token: str, digits: str) -> list[bool]:
    """Whether a mention could be of each kind, in any form."""
    local, _, domain = SPELLED.sub(lambda m: "@" if m[1] == "at" else ".", token.lower()).partition("@")
    parts = [p for p in DIGITS.split(token) if p] if len(digits) <= 12 else []
    return [bool(local and DOMAIN.fullmatch(domain)), len(parts) == 4 and octets(parts), 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15]


def features(text: str, begin: int, end: int, digits: str) -> tuple[list[int], list[int]]:
    """Of a mention: what another form of it would share, and its form."""
    token = text[begin:end]
    before, after = text[max(0, begin - 40) : begin].split(), text[end : end + 40].split()
    passed = "".join("01"[x] for x in checks(token, digits))
    same = [_bucket("checks", passed), _bucket("digits", str(min(len(digits), 20))), _bucket("before", before[-1].lower() if before else "^"), _bucket("after", after[0].lower() if after else "$"), _bucket("all", "")]
    return same, [_bucket("shape", shape(token)), _bucket("length", str(min(len(token), 24))), _bucket("at", str("@" in token)), _bucket("dots", str(min(token.count("."), 5)))]


class Node(NamedTuple):
    begin: int
    end: int
    label: int
    same: str  # equal for the same datum in any form, or empty
    similar: str
    beside: bool  # nothing but white space stands between it and the node before


def keys(token: str, digits: str) -> tuple[str, str]:
    low = SPELLED.sub(lambda m: "@" if m[1] == "at" else ".", token.lower())
    local, at, domain = low.partition("@")
    if at:
        return low, f"{local}@" if len(local) >= 3 else ""
    if any(map(str.isalpha, low)):
        return (low, "") if len(low) >= 4 else ("", "")
    return (digits if len(digits) >= 4 else ""), (digits[-7:] if len(digits) >= 7 else "")


def nodes(text: str, spans: Spans) -> list[Node]:
    """The base spans and the other mentions, in order; spans that overlap an earlier one are no nodes."""
    found: list[list] = []  # begin, end, label
    last = 0
    for kind, b, e in sorted(spans, key=lambda s: s[1:]):
        if b >= last:
            found.append([b, e, 1 + KINDS.index(kind)])
            last = e
    given, k, free = found, 0, []
    for m in TOKEN.finditer(text):
        b, e = m.span()
        while k < len(given) and given[k][1] <= b:
            k += 1
        if k < len(given) and given[k][0] < e:
            continue
        token = m[0].strip(".,;:!?[]{}<>\"'|=")
        b += max(0, m[0].find(token)) if token else 0
        e = b + len(token) if token else e
        if free and free[-1][1] + 1 == b and text[b - 1].isspace() and e - free[-1][0] <= 40 and NUMBER.match(token) and NUMBER.match(text, free[-1][0], free[-1][1]):
            free[-1][1] = e
        else:
            free.append([b, e, 0])
    out, end = [], -1
    for b, e, label in merge(given, free):
        digits = DIGITS.sub("", text[b:e])
        out.append(Node(b, e, label, *keys(text[b:e], digits), end >= 0 and text[end:b].isspace()))
        end = e
    return out


def _edges(found: list[list[Node]]) -> list[np.ndarray]:
    """Edges of each kind (pairs of node numbers) over the documents' nodes, numbered in order."""
    out: list[list] = [[], [], []]
    k = 0
    for doc in found:
        seen: dict[str, int] = {}
        like: dict[str, int] = {}
        for i, n in enumerate(doc, k):
            if n.beside:
                out[0].append((i - 1, i))
            if n.same in seen:
                out[1].append((seen[n.same], i))
            elif n.similar in like:
                out[2].append((like[n.similar], i))
            if n.same:
                seen[n.same] = i
            if n.similar:
                like[n.similar] = i
        k += len(doc)
    return [np.array(x, np.int64).reshape(-1, 2) for x in out]


class Field(NamedTuple):
    """Weights of the unary features, and the potentials of each kind of edge; labels are the columns."""

    unary: np.ndarray
    pairs: list[np.ndarray]


def examples(text: str) -> list[tuple[int, list[int]]]:
    """(label, features) of each mention whose label is known, as it is and as its repeats would be; a neighbour's label is a feature."""
    doc = nodes(text, base(text))
    edges = _edges([doc])
    unknown = {a for e in edges[1:] for a, b in [*e.tolist(), *e[:, ::-1].tolist()] if not doc[a].label and doc[b].label}
    around: list[list[int]] = [[] for _ in doc]
    for kind, e in enumerate(edges):
        for a, b in [*e.tolist(), *e[:, ::-1].tolist()]:
            if b not in unknown:
                around[a].append(FEATURES + kind * (len(KINDS) + 1) + doc[b].label)
    out = []
    for i, n in enumerate(doc):
        if i not in unknown:
            same, form = features(text, n.begin, n.end, DIGITS.sub("", text[n.begin : n.end]))
            alike = [FEATURES + kind * (len(KINDS) + 1) + n.label for kind in (1, 2)]
            out += [(n.label, sorted(x)) for x in (same + form + around[i], same + around[i], [*same[:2], same[-1], alike[0]], [same[-1], alike[1]])]
    return out


def fit(docs: DataFrame) -> Field:
    docs = texts(docs)
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.where((F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < int(1_000_003 * share)) if share < 1 else F.lit(True))

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [x for text in batch.column("text").to_pylist() if ANY.search(text) for x in examples(text)]
        if rows:
            return pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int32()))], ["y", "x"])

    counts = map_batches(some, gather, "y long, x array<int>").groupBy("y", "x").agg(F.count("*").alias("n"))
    rows = counts.orderBy(F.xxhash64("y", "x"), "y", "x").limit(ROWS).collect()
    return learned([(r.y, r.x, r.n) for r in rows])


def learned(rows: list[tuple[int, list[int], int]]) -> Field:
    """The field of greatest pseudo-likelihood, a little drawn to zero; rows: label, features, times. Edge potentials are kept symmetric."""
    k, kinds = len(KINDS) + 1, len(EDGES)
    size = FEATURES + kinds * k
    w, squares = np.zeros((size, k)), np.full((size, k), 1e-8)
    y, n = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    x = np.array([f for r in rows for f in r[1]], np.int64)
    n /= max(1.0, n.sum())
    for _ in range(ROUNDS if len(rows) else 0):
        z = np.stack([np.bincount(row, w[x, g], len(rows)) for g in range(k)], 1)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= n[:, None]
        slope = 1e-5 * w + np.stack([np.bincount(x, p[row, g], size) for g in range(k)], 1)
        for e in range(kinds):
            at = slice(FEATURES + e * k, FEATURES + (e + 1) * k)
            slope[at] = (slope[at] + slope[at].T) / 2
        squares += slope**2
        w -= 0.5 * slope / np.sqrt(squares)
    return Field(w[:FEATURES], [w[FEATURES + e * k : FEATURES + (e + 1) * k] for e in range(kinds)])


def beliefs(unary: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> np.ndarray:
    """Sum-product marginals: unary log potentials, and (pairs, log potentials) by kind of edge; exact on trees of diameter up to `steps`."""
    k = unary.shape[1]
    pairs = np.concatenate([e for e, _ in edges])
    if not len(pairs):
        out = np.exp(unary - unary.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)
    weight = np.concatenate([np.broadcast_to(np.exp(w), (len(e), k, k)) for e, w in edges])
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    weight = np.concatenate([weight, weight.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.zeros((len(source), k))
    for step in range(steps + 1):
        total = unary.copy()
        np.add.at(total, target, message)
        if step == steps:
            break
        sent = total[source] - message[back]
        sent = np.exp(sent - sent.max(1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", sent, weight))
        new -= new.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * new if step > steps // 2 else new  # loops settle when damped
    out = np.exp(total - total.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def _joined(doc: list[Node], edges: list[tuple[int, int]]) -> list[set[int]]:
    """The kinds of base spans that skip chains join each node with."""
    above = list(range(len(doc)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for a, b in edges:
        above[top(a)] = top(b)
    kinds: dict[int, set[int]] = {}
    for i, n in enumerate(doc):
        kinds.setdefault(top(i), set()).add(n.label)
    return [kinds[top(i)] - {0} for i in range(len(doc))]


def spans_of(found: list[str], model: Field) -> list[tuple[Spans, Spans]]:
    """Base spans and all spans of each text."""
    bases = [base(x) if ANY.search(x) else [] for x in found]
    docs = [nodes(x, s) if ANY.search(x) else [] for x, s in zip(found, bases, strict=True)]
    label = np.array([n.label for doc in docs for n in doc], np.int64)
    if not len(label):
        return [(s, s) for s in bases]
    pinned = label > 0
    unary = np.full((len(label), len(KINDS) + 1), -50.0)
    unary[pinned, label[pinned]] = 0.0
    free = [features(text, n.begin, n.end, DIGITS.sub("", text[n.begin : n.end])) for text, doc in zip(found, docs, strict=True) for n in doc if not n.label]
    if free:
        own = np.stack([model.unary[a + b].sum(0) for a, b in free])
        unary[~pinned] = own - own.max(1, keepdims=True)
    edges = _edges(docs)
    belief = beliefs(unary, list(zip(edges, model.pairs, strict=True)))
    best = np.where(belief.max(1) >= SURE, belief.argmax(1), 0)
    skip = np.concatenate(edges[1:])
    skip = skip[np.argsort(skip[:, 1], kind="stable")]
    cuts = np.searchsorted(skip[:, 1], np.cumsum([0, *map(len, docs)]))
    out, k = [], 0
    for text, s, doc, low, high in zip(found, bases, docs, cuts[:-1], cuts[1:], strict=True):
        added: list[tuple[str, int, int]] = []
        if best[k : k + len(doc)][~pinned[k : k + len(doc)]].any():
            joined = _joined(doc, (skip[low:high] - k).tolist())
            for i, n in enumerate(doc):
                kind = int(best[k + i])
                if kind and not n.label:
                    token = text[n.begin : n.end]
                    if kind in joined[i] or checks(token, DIGITS.sub("", token))[kind - 1]:
                        added.append((KINDS[kind - 1], n.begin, n.end))
        every = sorted([*s, *added], key=lambda x: (KINDS.index(x[0]), x[1])) if added else s
        out.append((s, every))
        k += len(doc)
    return out


_SPAN = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])


def _held_model(docs: DataFrame, model: Field | None):
    return docs.sparkSession.sparkContext.broadcast(model or fit(docs))


def find(docs: DataFrame, model: Field | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, base and spans (arrays of kind, begin, end) of each row of docs (doc_id, text), and the columns to keep as the struct kept."""
    held, docs = _held_model(docs, model), texts(docs, keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = spans_of(batch.column("text").to_pylist(), held.value)
        arrays = [pa.array([[dict(zip(("kind", "begin", "end"), s, strict=True)) for s in x[i]] for x in both], pa.list_(_SPAN)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "base", "spans"])

    span = "array<struct<kind:string,begin:long,end:long>>"
    return map_batches(docs, run, f"{fields(docs, *docs.columns)}base {span}, spans {span}")


def masked(text: str, spans: Spans) -> str:
    """The text with each span (overlapping ones as one, by the first's kind) replaced by [KIND]."""
    parts, at = [], 0
    for kind, b, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b >= at:
            parts += [text[at:b], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]]) if parts else text


def mask(docs: DataFrame, model: Field | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text with personal data replaced by their kinds, and kept, of each row of docs."""
    held, docs = _held_model(docs, model), texts(docs, keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column("text").to_pylist()
        new = [masked(x, every) for x, (_, every) in zip(found, spans_of(found, held.value), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return map_batches(docs, run, fields(docs, *docs.columns)[:-2])


def digest(docs: DataFrame) -> DataFrame:
    """The contract of operator 2; the counts are of base spans, n_added of the others."""
    found = find(docs)
    joined: Callable = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
