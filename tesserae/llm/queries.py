"""The opN_ queries over the provided tables, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bottomk, bpe, brown, edits, fertility, fm_index, langid, pii, probminhash, secrets, toxicity, variants
from .common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE_ENTRIES = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.digest(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents"))


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.digest(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"), PIECES)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.digest(table(spark, sf_dir, "documents"))


def op12_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.digest(table(spark, sf_dir, "documents"), PIECES, BYTE_BPE, public_tokenizers.PATTERN)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), BYTE_BPE_ENTRIES, PIECES, public_tokenizers.PATTERN)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT DISTINCT doc_id, i, grams.n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""

#: crc32 by its table of 256 entries, which eight steps of the polynomial make; near words by what is left of them without a character.
OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
runs AS (SELECT doc_id, w, count(*) AS k FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL HAVING length(w) >= 7),
bytes AS (SELECT w, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS b FROM runs),
hashed AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1])), 4294967295) AS h FROM bytes, crc),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
  SELECT k, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed) GROUP BY word HAVING sum(k) >= 2 AND length(word) >= 7),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.v = b.word),
best AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM near),
forms AS (SELECT words.word, words.n, CASE WHEN best.n >= 10 * words.n THEN other END AS form, CASE WHEN best.n >= 10 * words.n THEN best.n END AS form_n, coalesce(n_near, 0) AS n_near
  FROM words LEFT JOIN best ON words.word = best.word AND place = 1),
steps AS (SELECT word, word AS goal, 0 AS d FROM forms UNION ALL SELECT steps.word, forms.form, d + 1 FROM steps JOIN forms ON steps.goal = forms.word WHERE form IS NOT NULL)
SELECT forms.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN (SELECT word, arg_max(goal, d) AS root FROM steps GROUP BY word) r ON forms.word = r.word
"""

QUERIES = {"op1_bpe": op1_bpe, "op2_pii": op2_pii, "op3_token_counts": op3_token_counts, "op4_secrets": op4_secrets, "op5_brown": op5_brown, "op6_toxicity": op6_toxicity, "op7_probminhash": op7_probminhash, "op8_fm_index": op8_fm_index, "op9_bottomk": op9_bottomk, "op10_langid": op10_langid, "op11_variants": op11_variants, "op12_fertility": op12_fertility, "op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {"op8_fm_index": OP8_SQL, "op11_variants": OP11_SQL}
