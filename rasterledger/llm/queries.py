"""Registered queries of the training-data operators and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, collocations, decontaminate, html_text, language, line_dedup, ngram_join, packing, prefix_trie, secret_scan, suffix_tree, token_counts, topk
from .common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


QUERIES["pipeline"] = corpus_pipeline.run


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))


@_query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


@_query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


@_query
def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(table(spark, folder, "documents"), crc_mod("doc_id", 10) == 0).withColumnRenamed("id", "doc_id")


@_query
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).withColumnRenamed("id", "doc_id")


@_query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    model = language.train(docs.where(~held_out).select(F.col("doc_id").alias("key"), "text", "lang"))
    return language.predict(docs, model).select(F.col("id").alias("doc_id"), (crc_mod("id", 3) == 1).alias("held_out"), "lang_pred", "score")


@_query
def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    formats = secret_scan.Formats(secret_scan.labelled_strings(docs))
    return secret_scan.scan(docs, formats).withColumnRenamed("id", "doc_id")


@_query
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


@_query
def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


ORACLES["op5_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w
), u AS MATERIALIZED (
  SELECT doc_id, unnest(s) AS g FROM s
), p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * common >= 85 * (len(x.s) + len(y.s) - common)
), e AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""


@_query
def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op6_exact_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i <> c.i WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@_query
def op11_phrase_collocation_mining(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


ORACLES["op11_phrase_collocation_mining"] = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t
), w AS MATERIALIZED (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, m, unnest([array_to_string(w[i:i+m-1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)
), c AS MATERIALIZED (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30
), k AS (
  SELECT lang, m, phrase, w, a, unnest(range(1, m)) AS k FROM c WHERE m > 1
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, CAST(2000000 * CAST(k.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM k JOIN c x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN c y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k+1:], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, unnest(flatten([[array_to_string(w[j:j+z-1], ' ') FOR j IN range(1, m - z + 2)] FOR z IN range(2, m)])) AS phrase, a FROM c WHERE m > 2
), f AS (
  SELECT b.* FROM b WHERE NOT EXISTS (FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 80 * b.a)
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), o AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM f
)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@_query
def op12_bpe_encoding_and_decoding(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_stream.decode(bpe_stream.encode(table(spark, folder, "documents"), path), path)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


@_query
def op13_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, folder, "conversations")))).drop("turn")


ORACLES["op13_conversation_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL
), o AS MATERIALIZED (
  SELECT conv_id AS c, list(t ORDER BY turn NULLS FIRST, sha256(strlen(t.role) || ':' || t.role || t.text)) AS l FROM t GROUP BY conv_id
), h AS MATERIALIZED (
  SELECT c, l, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
    lambda z, b: list_reduce(list_prepend(xor(z, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 4 AS h FROM o
), r AS MATERIALIZED (
  SELECT h.c, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h+1:]) AS s FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20
), m AS (
  SELECT c, s, unnest(range(len(s) + 1)) AS d FROM r
), n AS MATERIALIZED (
  SELECT d, sha256(CAST(s[1:d] AS VARCHAR)) AS p, [sha256(CAST(s[1:e] AS VARCHAR)) FOR e IN range(d + 1)] AS up, min(c) AS conv_id, count(*) AS n,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(s[d].text, '[^\x20\x09-\x0D]+')) END AS w,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends
  FROM m GROUP BY ALL
), k AS (
  SELECT up[d] AS p, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL
), a AS (
  SELECT n.*, coalesce(k.k, 0) AS k FROM n LEFT JOIN k USING (p)
), v AS (
  SELECT p, sum(leaf) AS leaves, sum(own) AS saved FROM (SELECT unnest(up) AS p, CAST(k = 0 AS BIGINT) AS leaf, (n - 1) * w AS own FROM a) GROUP BY p
)
SELECT a.conv_id, a.d AS depth, q.conv_id AS parent_conv_id, a.n AS n_convs, a.k AS n_children, CAST(v.leaves AS BIGINT) AS n_leaves, CAST(v.saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM a JOIN v USING (p) LEFT JOIN n q ON a.d > 0 AND q.p = a.up[a.d]
"""
